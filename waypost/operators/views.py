"""Summaries of a locations table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waypost.functions import text as T


def has_coordinates() -> Column:
    """Both coordinates given; 0 counts as missing."""
    ok = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.col(c) != 0)
    return F.coalesce(ok("latitude") & ok("longitude"), F.lit(False))


def has_name() -> Column:
    return T.trim_all(F.col("name")) != ""


def in_place(df: DataFrame, state: str | None = None, city: str | None = None) -> DataFrame:
    """Rows of a state and of a city, compared without case; None means any."""
    for c, v in (("state", state), ("city", city)):
        if v is not None:
            df = df.filter(F.lower(c) == v.lower())
    return df


def count_by(df: DataFrame, key: Column, name: str) -> DataFrame:
    """(name, n): rows by key, most first; equal counts in the order of their first row."""
    g = df.groupBy(key.alias(name)).agg(F.count("*").alias("n"), F.min("ref_ord").alias("first_ord"))
    return g.orderBy(F.desc("n"), "first_ord")


def by_state(df: DataFrame, located_only: bool = False) -> DataFrame:
    return count_by(df.filter(has_coordinates()) if located_only else df, F.col("state"), "state")


def by_city(df: DataFrame, top: int = 10) -> DataFrame:
    """The top cities, written 'city, state'."""
    return count_by(df, F.concat_ws(", ", F.coalesce("city", F.lit("")), F.coalesce("state", F.lit(""))), "city_state").limit(top)


def coverage(df: DataFrame) -> DataFrame:
    """(total, with_names, with_coordinates, pct_names, pct_coordinates): one row; shares are null for an empty table."""
    g = df.agg(F.count("*").alias("total"), F.count_if(has_name()).alias("with_names"), F.count_if(has_coordinates()).alias("with_coordinates"))
    pct = lambda c: F.when(F.col("total") > 0, F.round(F.lit(100.0) * F.col(c) / F.col("total"), 1))
    return g.withColumn("pct_names", pct("with_names")).withColumn("pct_coordinates", pct("with_coordinates"))


def sample(df: DataFrame, n: int) -> DataFrame:
    """The first n rows in input order."""
    return df.orderBy("ref_ord").limit(n)


def table_line() -> Column:
    """A row as one line of a printed table."""
    pad = lambda c, n: F.rpad(F.substring(T.text(F.col(c)), 1, n), n, " ")
    coord = F.when(has_coordinates(), F.format_string("%.4f, %.4f", "latitude", "longitude")).otherwise("")
    return F.concat_ws(" ", pad("name", 30), pad("city", 20), pad("state", 5), coord)
