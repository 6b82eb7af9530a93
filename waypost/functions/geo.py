"""Distances on the sphere."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from waypost.operators.nearby import great_circle


def metres_between(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Whole metres between two points; null where a coordinate is missing."""
    return F.round(great_circle(lat1, lon1, lat2, lon2)).cast("bigint")
