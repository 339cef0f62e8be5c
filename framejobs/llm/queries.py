"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from framejobs.llm.ann import op6_ann
from framejobs.llm.bpe import op12_bpe
from framejobs.llm.decontamination import OP10_SQL, op10_decontamination
from framejobs.llm.html_text import op5_html_text
from framejobs.llm.licenses import OP9_SQL, op9_license
from framejobs.llm.lm_scoring import op2_lm_scoring
from framejobs.llm.packing import op7_packing
from framejobs.llm.simhash import op3_simhash
from framejobs.llm.spelling import OP11_SQL, op11_spelling
from framejobs.llm.suffix_dedup import OP1_SQL, op1_suffix_dedup
from framejobs.llm.toxicity import op8_toxicity
from framejobs.llm.trie import OP13_SQL, op13_prefix_trie
from framejobs.llm.warc import OP4_SQL, op4_warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_suffix_dedup, op2_lm_scoring, op3_simhash, op4_warc, op5_html_text, op6_ann, op7_packing, op8_toxicity, op9_license, op10_decontamination,
        op11_spelling, op12_bpe, op13_prefix_trie,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op1_suffix_dedup": OP1_SQL, "op4_warc": OP4_SQL, "op9_license": OP9_SQL, "op10_decontamination": OP10_SQL, "op11_spelling": OP11_SQL, "op13_prefix_trie": OP13_SQL}
