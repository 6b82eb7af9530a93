"""The queries of this subpackage; none of them can be written in SQL, so they have tests instead (tests/llm)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


from waypost.llm import addresses, email_layout, matching, names, packing, pii, tokens, truncation
from waypost.session import ship_package, table

CAPACITY = 2048


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return addresses.same_address_pairs(table(spark, sf_dir, "locations"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names.same_name_pairs(table(spark, sf_dir, "locations"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_spans(table(spark, sf_dir, "emails")).drop("end_pos")


def p3_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.redacted(table(spark, sf_dir, "emails"), ["text", "extracted_text"])


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return email_layout.newly_written(table(spark, sf_dir, "emails"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.found_pairs(table(spark, sf_dir, "locations"), table(spark, sf_dir, "parsed_blocks"))


def p6_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.matched(table(spark, sf_dir, "locations"), table(spark, sf_dir, "parsed_blocks"))


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encoded(table(spark, sf_dir, "documents"))


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(tokens.token_counts(table(spark, sf_dir, "documents")), CAPACITY)


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.truncated(table(spark, sf_dir, "documents")).filter("truncated").select("doc_id")


def p9_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.truncation_rates(table(spark, sf_dir, "documents"))


_ALL = (p1_found, p2_found, p3_found, p3_redacted, p5_found, p6_found, p6_confidence, p7_ids, p8_containers, p9_found, p9_rates)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def run(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        def call(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            return f(spark, sf_dir)

        call.__name__ = f.__name__
        return call

    return {f.__name__: run(f) for f in _ALL}


def oracle_sql() -> dict[str, str]:
    return {}
