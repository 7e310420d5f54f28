"""The queries of this subpackage by name, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusmill.llm import chat, html, langid, lm, mixing, packing, quality, sharding, simhash, topk


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {
        "op1_simhash": simhash.op1,
        "op2_sharding": sharding.op2,
        "op3_topk": topk.op3,
        "op4_packing": packing.op4,
        "op5_langid": langid.op5,
        "op6_chat": chat.op6,
        "op7_quality": quality.op7,
        "op8_mixing": mixing.op8,
        "op9_lm": lm.op9,
        "op10_html": html.op10,
        "pipeline": pipeline,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_sharding": sharding.op2_sql(), "op3_topk": topk.OP3_SQL, "op6_chat": chat.OP6_SQL, "op8_mixing": mixing.OP8_SQL}
