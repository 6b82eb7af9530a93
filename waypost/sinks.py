"""Outputs: JSON lines, CSV of new items, lookup answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waypost.functions import text as T
from waypost.operators.match import search_key

NEW_COLUMNS = ("name", "address1", "address2", "city", "state", "postal_code", "country", "search_key")


def json_lines(results: DataFrame) -> DataFrame:
    """(value): one JSON object for each result with file, block (its first three lines), parsed and match; nulls are written."""
    match = F.struct("status", "mr8_id", "scores", "diffs", "explanation", "record")
    head = F.array_join(F.slice(F.split("block", "\n"), 1, 3), " ")
    return results.select(F.to_json(F.struct("file", head.alias("block"), F.col("doc").alias("parsed"), match.alias("match")), {"ignoreNullFields": "false"}).alias("value"))


def new_items(results: DataFrame) -> DataFrame:
    """NEW_COLUMNS of the NEW results, the first (by ord) of each canonical key."""
    d = F.col("doc")
    new = results.filter("status = 'NEW'").withColumn("search_key", T.canonical_key(d["name"], d["address1"], d["city"], d["state"], d["postal_code"]))
    first = new.groupBy("search_key").agg(F.min_by("doc", "ord").alias("d"))
    return first.select(*[F.coalesce(F.col(f"d.{c}"), F.lit("")).alias(c) for c in NEW_COLUMNS if c not in ("country", "search_key")], F.lit("US").alias("country"), "search_key").select(*NEW_COLUMNS)


def write_new_items(results: DataFrame, path: str) -> None:
    new_items(results).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def lookup_answer(status: Column, record: Column, explanation_diffs: Column) -> Column:
    """The JSON answer of a lookup: key, id and record of an exact match, else what is missing, with the candidate."""
    yes = F.to_json(F.struct(status.alias("status"), search_key(record, status, "lookup").alias("search_key"), record["id"].alias("id"), record.alias("record")), {"ignoreNullFields": "false"})
    no = F.to_json(F.struct(F.lit("NEEDS_MORE_DATA").alias("status"), F.lit("No exact match; more data is needed.").alias("message"), explanation_diffs.alias("diffs"), record.alias("candidate")), {"ignoreNullFields": "false"})
    return F.when((status == "EXACT") & record.isNotNull(), yes).otherwise(no)
