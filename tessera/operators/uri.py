"""Evidence in URIs: another cell of the row that stands in an entity's URI."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Config
from ..functions import text
from .mapping import KEY


def contains_value(uri: Column, value: Column) -> Column:
    """Whether the URI's last part holds the value, letters and digits compared."""
    return F.contains(text.matching_form(text.last_part(F.lower(uri))), text.matching_form(value))


def uri_evidence(candidates: DataFrame, config: Config) -> DataFrame:
    """KEY and n: how many values of other columns of its row a candidate is the first to hold in its URI."""
    values = candidates.where(F.length("value") >= config.min_uri_value_length).select("table_id", "row_idx", F.col("col_idx").alias("other"), text.matching_form(F.col("value")).alias("v")).where("v <> ''").distinct()
    x = candidates.select(*KEY, F.lower("uri").alias("uri"), text.matching_form(text.last_part(F.lower("uri"))).alias("part"))
    # As many rows as cells, however small their file: by its size Spark would broadcast them.
    held = x.join(values.hint("merge"), ["table_id", "row_idx"]).where((F.col("col_idx") != F.col("other")) & F.contains("part", F.col("v"))).select(*KEY, "uri", "v").distinct()
    first = Window.partitionBy("table_id", "uri", "row_idx", "v").orderBy("col_idx", "rank")
    return held.withColumn("claim", F.row_number().over(first)).where("claim = 1").groupBy(*KEY).agg(F.count("*").alias("n"))


def boost_by_uri(candidates: DataFrame, config: Config, found: DataFrame | None = None) -> DataFrame:
    """Candidates with the score raised by evidence.  found: the same before their types were mapped, so that evidence needs no mapping."""
    x = candidates.join(uri_evidence(candidates if found is None else found, config), KEY, "left")
    score = F.least(F.lit(1.0), F.col("score") + config.uri_boost * F.coalesce("n", F.lit(0)))
    return x.withColumn("score", F.round(score, 12)).drop("n")
