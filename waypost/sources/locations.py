"""Location tables from CSV, JDBC or Parquet, brought to one schema by lists of alternative column names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waypost.functions import text as T

# Names under which a column may come, in order of preference.
ALIASES = {
    "id": ["id", "ID", "Id", "Loc No.", "Loc No"], "name": ["name", "Name", "Location Name"], "address1": ["address1", "Address1", "street", "Street"],
    "address2": ["address2", "Address2", "Street2"], "city": ["city", "City", "City/Town"], "state": ["state", "State", "State/Province"],
    "postal_code": ["postal_code", "zip", "Zip", "zip_code", "Postal Code"], "country": ["country", "Country"], "latitude": ["latitude", "Latitude"],
    "longitude": ["longitude", "Longitude"], "search_key": ["search_key", "searchKey", "SearchKey", "Search Key"], "department": ["department", "Department"],
    "warning": ["warning", "Warning"],
}
LENIENT = {"name": ["facility_name", "facility", "location"], "address1": ["addr1", "address"], "address2": ["addr2"], "postal_code": ["zipcode", "postal"], "id": ["location_id"]}


def from_rows(df: DataFrame, order: str | None = None, lenient: bool = False) -> DataFrame:
    """df in the location schema, with ref_ord.

    The first column present under one of its names wins where it isn't null, empty strings included; lenient compares names without
    case, knows more of them, and skips blanks. A single ``Address`` column is split into two. Numbers that can't be read are null, blank ones 0.
    order: a column that gives the input order; otherwise rows are numbered as they are read.
    """
    have = {c.lower() if lenient else c: c for c in df.columns}

    def pick(target: str) -> Column:
        names = ALIASES[target] + (LENIENT.get(target, []) if lenient else [])
        cols = [F.col(f"`{have[k]}`").cast("string") for n in names if (k := n.lower() if lenient else n) in have]
        cols = [F.when(T.trim_all(c) != "", c) if lenient else c for c in cols]
        return F.coalesce(*cols, F.lit(None)) if cols else F.lit(None).cast("string")

    whole = F.col(f"`{have['Address']}`").cast("string") if "Address" in have else F.lit(None).cast("string")
    a1, parts = T.text(pick("address1")), T.split_address_line(whole)
    number = lambda c: F.when(T.trim_all(c) == "", 0.0).otherwise(F.try_cast(T.trim_all(c), "double") if hasattr(F, "try_cast") else T.trim_all(c).try_cast("double"))
    real = lambda c: F.when(~F.isnan(c), c)
    blank = lambda c: F.nullif(T.trim_all(c), F.lit(""))
    return df.select(
        (F.col(order).cast("bigint") if order else F.monotonically_increasing_id()).alias("ref_ord"), pick("id").alias("id"), T.text(pick("name")).alias("name"),
        F.when((a1 == "") & whole.isNotNull(), parts["address1"]).otherwise(a1).alias("address1"),
        F.when((a1 == "") & whole.isNotNull(), parts["address2"]).otherwise(pick("address2")).alias("address2"), T.text(pick("city")).alias("city"),
        T.normalize_state(pick("state")).alias("state"), T.text(pick("postal_code")).alias("postal_code"), F.coalesce(pick("country"), F.lit("US")).alias("country"),
        real(number(pick("latitude"))).alias("latitude"), real(number(pick("longitude"))).alias("longitude"), pick("search_key").alias("search_key"),
        blank(pick("department")).alias("department"), blank(pick("warning")).alias("warning"),
    )


def load_locations(spark: SparkSession, driver: str = "csv", lenient: bool = False, **options: str) -> DataFrame:
    """Locations from a 'csv' (path), 'parquet' (path) or database ('jdbc', 'sqlserver', 'odbc': url, dbtable and other JDBC options).

    A database driver without a url falls back to CSV if a path is given.
    """
    if driver in ("jdbc", "sqlserver", "odbc") and "url" in options:
        return from_rows(spark.read.format("jdbc").options(**{"dbtable": "Locations", **options}).load(), lenient=lenient)
    if driver == "parquet":
        df = spark.read.parquet(options["path"])
        return from_rows(df, "ref_ord" if "ref_ord" in df.columns else None, lenient)
    df = spark.read.option("header", True).option("inferSchema", False).option("multiLine", True).option("escape", '"').csv(options["path"])
    empty_kept = df.select(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in df.columns])
    return from_rows(empty_kept, lenient=lenient)


def health(df: DataFrame) -> dict[str, object]:
    """Whether a source can be read."""
    try:
        df.limit(1).count()
        return {"ok": True, "details": "readable"}
    except Exception as e:  # a connector may fail in any way
        return {"ok": False, "details": str(e).splitlines()[0]}
