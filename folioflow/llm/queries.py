"""The queries of this subpackage and, where SQL can state them, their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from folioflow.llm import op06_suffix, op08_substring, op10_warc, op11_spelling, op12_egojoin, op13_divergence
from folioflow.llm.op01_bpe import op1_bpe
from folioflow.llm.op02_toxicity import op2_toxicity
from folioflow.llm.op03_rules import op3_rules
from folioflow.llm.op04_quality import op4_quality
from folioflow.llm.op05_mix import op5_mix
from folioflow.llm.op07_ann import op7_ann
from folioflow.llm.op09_simhash import op9_simhash


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_bpe, op2_toxicity, op3_rules, op4_quality, op5_mix, op06_suffix.op6_suffix, op7_ann, op08_substring.op8_substring, op9_simhash, op10_warc.op10_warc)
    found += (op11_spelling.op11_spelling, op12_egojoin.op12_egojoin, op13_divergence.op13_divergence,)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op6_suffix": op06_suffix.ORACLE, "op8_substring": op08_substring.ORACLE, "op10_warc": op10_warc.ORACLE, "op11_spelling": op11_spelling.ORACLE, "op12_egojoin": op12_egojoin.ORACLE, "op13_divergence": op13_divergence.ORACLE}
