import hashlib

from framejobs.llm.licenses import KNOWN, scan_licenses

EMPTY = hashlib.sha256(b"").hexdigest()


def test_whole_texts_and_notices(spark):
    mit = next(t for i, t in KNOWN if i == "MIT")
    rows = [
        (1, f"Copyright (c) 2020 Someone\nAll rights reserved.\n\n{mit}", "MIT", 2, "MIT,reserved"),
        (2, "  # COPYRIGHT 1999\n" + mit.upper().replace('"', "“").replace(" ", "  "), "MIT", 1, "MIT"),
        (3, mit + " or not", None, 0, ""),
        (4, "prose\nReleased under the M.I.T. Licence!\nReleased under the MIT licence\n* released under the mit license *", None, 2, "MIT"),
        (5, "x\nLicensed under CC BY-NC 4.0.\nAll rights reserved.\nLicensed under the Apache License, version 2.0", None, 3, "Apache-2.0,CC-BY-NC-4.0,reserved"),
        (6, None, None, 0, ""),
        (6, "", None, 0, ""),
        (None, "...\n\n", None, 0, ""),
        (7, "Licensed under the MIT License.", "MIT", 1, "MIT"),
    ]
    df = spark.createDataFrame([(i, t, "x") for i, t, *_ in rows], "doc_id long, text string, digest string").repartition(3)
    got = scan_licenses(df).collect()
    assert sorted(((g.doc_id, g.license_id, g.n_notices, g.notices) for g in got), key=str) == sorted(((i, a, n, x) for i, _, a, n, x in rows), key=str)
    assert {g.text_digest for g in got if g.doc_id == 6} == {EMPTY}
    assert scan_licenses(df.limit(0)).count() == 0
    assert {g.license_id for g in scan_licenses(df, known=[]).collect()} == {None}
