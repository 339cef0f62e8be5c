import os
import textwrap

import pytest

from framejobs.llm.licenses import KNOWN, scan_licenses

TITLES = {"MIT": "The MIT License (MIT)", "ISC": "ISC License", "0BSD": "Zero-Clause BSD", "BSD-2-Clause": "BSD 2-Clause License", "BSD-3-Clause": "BSD 3-Clause License", "Zlib": "zlib License"}
FILES = {"Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-2.0": "MPL-2.0"} | {
    "GPL-1": "GPL-1.0", "LGPL-2": "LGPL-2.0", "MPL-1.1": "MPL-1.1", "CC0-1.0": "CC0-1.0", "GFDL-1.2": "GFDL-1.2", "GFDL-1.3": "GFDL-1.3", "Artistic": "Artistic-1.0-Perl",
}
FOLDER = "/usr/share/common-licenses"


def ids(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r.license_id for r in scan_licenses(df).orderBy("doc_id").collect()]


def test_titled_and_wrapped_files(spark):
    want, texts = [], []
    for name, title in TITLES.items():
        body = next(t for i, t in KNOWN if i == name)
        for width in range(30, 100, 5):
            want.append(name)
            texts.append(f"{title}\n\nCopyright (c) 2020, Someone\nAll rights reserved.\n\n{textwrap.fill(body, width)}\n")
    assert ids(spark, texts) == want
    assert ids(spark, ["MIT License\n", "MIT License\n\nprose", "Copyright 2020 Someone\n" * 5000, texts[0] + "or not"]) == [None] * 4


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no licence texts here")
def test_whole_long_licences(spark):
    texts = [open(f"{FOLDER}/{f}", encoding="utf-8", errors="replace").read() for f in FILES]
    assert ids(spark, texts) == list(FILES.values())
    assert ids(spark, [t.replace("\n", "\n\n  ") for t in texts]) == list(FILES.values())


def test_spellings_are_whole_words(spark):
    from pyspark.sql import functions as F

    from framejobs.llm.licenses import canonical

    pairs = {
        "the licence licence licences": "the license license licenses", "while still whilst": "while still while", "programme programmer": "program programmer",
        "authorised by the copyright owners": "authorized by the copyright holders", "sub-licence, sub-licensing? sublicence": "sublicense sub licensing sublicense",
        "percentage per cent": "percentage percent", "unorganised organised": "unorganised organized", "organisation": "organization", "fulfilment fulfil fulfilled": "fulfillment fulfill fulfilled",
    }
    df = spark.createDataFrame(list(pairs.items()), "t string, want string")
    assert [(r.got, r.want) for r in df.select(canonical(F.col("t"), False).alias("got"), "want").collect()] == [(w, w) for w in pairs.values()]
