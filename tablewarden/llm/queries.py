"""One query per operator over the test tables, and SQL that checks those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tablewarden.llm import (
    alignment,
    decontaminate,
    jaccard_join,
    langid,
    lexical_search,
    lm_score,
    mixing,
    quality_rules,
    secrets,
    sharding,
    toxicity,
    url_filters,
    weak_labels,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, *tables: str, sql: str | None = None):
    """Register a function of *tables* under *name*."""

    def register(fn: Callable[..., DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: fn(*(spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables))
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return register


@query("op3_toxicity", "documents", "labels")
def op3_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return toxicity.op3(docs, labels)


@query("op5_language_id", "documents")
def op5_language_id(docs: DataFrame) -> DataFrame:
    return langid.op5(docs)


@query("op2_mixing", "documents")
def op2_mixing(docs: DataFrame) -> DataFrame:
    return mixing.op2(docs)


@query("op8_quality_rules", "documents", sql=quality_rules.SQL)
def op8_quality_rules(docs: DataFrame) -> DataFrame:
    return quality_rules.op8(docs)


@query("op10_secrets", "documents", sql=secrets.SQL)
def op10_secrets(docs: DataFrame) -> DataFrame:
    return secrets.op10(docs)


@query("op1_quality_classifier", "documents")
def op1_quality_classifier(docs: DataFrame) -> DataFrame:
    return weak_labels.op1(docs)


@query("op4_lm_score", "documents")
def op4_lm_score(docs: DataFrame) -> DataFrame:
    return lm_score.op4(docs)


@query("op7_decontamination", "documents", "benchmark")
def op7_decontamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return decontaminate.op7(docs, benchmark)


@query("op6_url_filters", "pages", sql=url_filters.SQL)
def op6_url_filters(pages: DataFrame) -> DataFrame:
    return url_filters.op6(pages)


@query("op9_jaccard_join", "documents", sql=jaccard_join.SQL)
def op9_jaccard_join(docs: DataFrame) -> DataFrame:
    return jaccard_join.op9(docs)


@query("op11_sharding", "documents", sql=sharding.SQL)
def op11_sharding(docs: DataFrame) -> DataFrame:
    return sharding.op11(docs)


@query("op12_lexical_search", "documents", "benchmark", sql=lexical_search.SQL)
def op12_lexical_search(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return lexical_search.op12(docs, benchmark)


@query("op13_alignment", "documents")
def op13_alignment(docs: DataFrame) -> DataFrame:
    return alignment.op13(docs)
