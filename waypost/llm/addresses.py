"""Problem 1: the same postal address written differently.

Method: parse the components (address_parse), write abbreviations out by dictionaries, bring the parts into one order, correct
misspelt towns and streets by the corpus itself, then join on hierarchical keys - state, town, kind, building number - with
explicit rules for what is missing:

* town missing or not known: the town that most rows with the same state and postal code have;
* town and postal code missing: the only town in which this state has the number and street, if there is just one; rows whose town
  can't be told at all are compared with each other, within one state and postal code;
* direction, street type, unit or postal code missing on one side: no conflict; present and different: conflict (postal codes
  that differ by a swap or one digit are misspellings);
* neither street nor box: the row is in no pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waypost.llm.address_parse import parse
from waypost.llm.spelling import close, corrections
from waypost.session import staged

FIELDS = ("address1", "address2", "city", "state", "postal_code")
PARTS = ("kind", "num", "dir", "core", "type", "unit", "town", "st", "zip")


def _parse_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        cols = [b.column(i).to_pylist() for i in range(b.num_columns - len(FIELDS), b.num_columns)]
        parts = list(zip(*map(parse, *cols))) or [()] * len(PARTS)
        keep = b.num_columns - len(FIELDS)
        yield pa.RecordBatch.from_arrays(
            [b.column(i) for i in range(keep)] + [pa.array(p, pa.string()) for p in parts], names=[*b.schema.names[:keep], *PARTS]
        )


def parsed(df: DataFrame, keep: list[str]) -> DataFrame:
    """The columns of keep and the parsed PARTS (strings, '' where missing) of each row."""
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema] + [f"{p} string" for p in PARTS])
    return df.select(*keep, *[F.col(f).cast("string") for f in FIELDS]).mapInArrow(_parse_batches, schema)


def zip_near(a: Column, b: Column) -> Column:
    d = F.levenshtein(a, b, 2)
    return (d >= 0) & ((d <= 1) | (F.array_sort(F.split(a, "")) == F.array_sort(F.split(b, ""))))


def corrected(rows: DataFrame, onto: DataFrame | None = None) -> DataFrame:
    """parsed() rows with towns and street names corrected by the corpus, and towns filled in by postal codes; other columns are kept.

    rows should be a staged table; onto: these rows with further columns, to be corrected in their stead. Everything is worked out on the distinct places; the rows are shuffled once.
    """
    key = ["kind", "st", "town", "zip", "core"]
    places = staged(rows.groupBy(*key).agg(F.count("*").alias("n")), "towns")
    towns = corrections(places.filter("town <> ''").groupBy("st", F.col("town").alias("word")).agg(F.sum("n").alias("n")), ["st"])
    cores = corrections(places.filter("kind = 'street'").groupBy(F.col("core").alias("word")).agg(F.sum("n").alias("n")), [])
    to = places.join(towns.select("st", F.col("word").alias("town"), F.col("correct").alias("to_town")), ["st", "town"], "left")
    to = to.join(cores.select(F.col("word").alias("core"), F.col("correct").alias("to_core")), "core", "left")
    to = staged(to.withColumns({"to_town": F.coalesce("to_town", "town"), "to_core": F.coalesce("to_core", "core")}), "corrected")
    by_zip = to.filter("kind <> '' and to_town <> '' and zip <> ''").groupBy("st", "zip", "to_town").agg(F.sum("n").alias("n"))
    by_zip = by_zip.groupBy("st", "zip").agg(F.max_by("to_town", F.struct("n", "to_town")).alias("usual"), (F.max("n") / F.sum("n")).alias("share"))
    to = to.join(by_zip.filter("share >= 0.5").drop("share"), ["st", "zip"], "left")
    usual = F.when((F.col("kind") != "") & ((F.col("to_town") == "") | close(F.col("to_town"), F.col("usual"))), F.col("usual"))
    to = to.withColumn("to_town", F.coalesce(usual, "to_town")).filter("to_town <> town or to_core <> core").select(*key, "to_town", "to_core")
    hashed = F.xxhash64(*key).alias("_key")  # sorts faster than five strings; 64 bits tell the distinct places apart
    rows_ = (rows if onto is None else onto).select("*", hashed).join(to.select(hashed, "to_town", "to_core"), "_key", "left").withColumns({"town": F.coalesce("to_town", "town"), "core": F.coalesce("to_core", "core")})
    return rows_.drop("_key", "to_town", "to_core")


def settled(rows: DataFrame) -> DataFrame:
    """corrected() rows, a staged table, that have a street or box, with the last missing towns filled in; other columns are kept.

    A town that can't be told becomes '@' and the postal code, so that such rows are compared with each other.
    """
    known, lost = rows.filter("kind <> '' and town <> ''"), rows.filter("kind <> '' and town = ''")
    key = ["st", "kind", "num", "core"]
    only = known.groupBy(*key).agg(F.min("town").alias("t0"), F.max("town").alias("t1")).filter("t0 = t1").drop("t1")
    lost = lost.join(only, key, "left").withColumn("town", F.coalesce("t0", F.concat(F.lit("@"), "zip"))).drop("t0")
    return known.unionByName(staged(lost.select(known.columns), "lost"))


def located(rows: DataFrame) -> DataFrame:
    """parsed() rows, a staged table, that have a street or box, corrected() and settled()."""
    return settled(staged(corrected(rows.filter("kind <> ''")), "located"))


def same_place(a: str, b: str) -> Column:
    """Whether two located rows (aliases a and b), equal in state, town, kind and number, don't conflict."""
    x, y = (lambda c: F.col(f"{a}.{c}")), (lambda c: F.col(f"{b}.{c}"))
    free = lambda c: (x(c) == "") | (y(c) == "") | (x(c) == y(c))
    core = (x("core") == y("core")) | (~x("core").rlike("[0-9]") & ~y("core").rlike("[0-9]") & close(x("core"), y("core")))
    return free("dir") & free("type") & free("unit") & core & ((x("zip") == "") | (y("zip") == "") | (x("zip") == y("zip")) | zip_near(x("zip"), y("zip")))


def same_address_pairs(df: DataFrame, key: str = "ref_ord") -> DataFrame:
    """(key_a, key_b), key_a < key_b: the pairs of rows whose address denotes the same place, identical spellings included.

    Rows without street and box, with null or blank address fields, are in no pair; rows repeated under the same key pair once.
    An empty table gives no rows; columns beyond key and the address fields are ignored.
    """
    rows = located(staged(parsed(df, [key]), "parsed"))
    pairs = rows.alias("a").join(rows.alias("b"), ["st", "town", "kind", "num"])
    pairs = pairs.filter((F.col(f"a.{key}") < F.col(f"b.{key}")) & same_place("a", "b"))
    return pairs.select(F.col(f"a.{key}").alias(f"{key}_a"), F.col(f"b.{key}").alias(f"{key}_b"))
