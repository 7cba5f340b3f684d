"""Queries opN_<name> and pipeline, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

import corpus_pipeline
from semspark.llm import chaining, language, mixing, nndescent, packing, pii, secrets, simhash, substrings, topk
from semspark.llm.common import Query


def queries() -> dict[str, Query]:
    return {
        "op1_pii": pii.op1_pii,
        "op2_secrets": secrets.op2_secrets,
        "op3_language": language.op3_language,
        "op4_substrings": substrings.op4_substrings,
        "op5_packing": packing.op5_packing,
        "op6_topk": topk.op6_topk,
        "op7_mixing": mixing.op7_mixing,
        "op8_nndescent": nndescent.op8_nndescent,
        "op9_simhash": simhash.op9_simhash,
        "op10_chaining": chaining.op10_chaining,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    found = {"op4_substrings": substrings.ORACLE, "op6_topk": topk.ORACLE, "op7_mixing": mixing.ORACLE, "op8_nndescent": nndescent.ORACLE}
    return found if corpus_pipeline.ORACLE_SQL is None else found | {"pipeline": corpus_pipeline.ORACLE_SQL}
