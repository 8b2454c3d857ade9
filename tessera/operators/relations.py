"""Relations between columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import Config


def type_frequencies(candidates: DataFrame) -> DataFrame:
    """table_id, col_idx, type_uri, frequency (scores of the candidates that have it, repeats counted), n (candidates), type_rank."""
    column = ["table_id", "col_idx"]
    n = candidates.groupBy(*column).agg(F.count("*").alias("n"))
    t = candidates.select(*column, "row_idx", "rank", "score", F.posexplode("types").alias("ord", "t"))
    f = t.groupBy(*column, F.col("t.uri").alias("type_uri")).agg(F.round(F.sum("score"), 9).alias("frequency"), F.min(F.struct("row_idx", "rank", "ord")).alias("first"))
    order = Window.partitionBy(*column).orderBy(F.desc("frequency"), "first")
    return f.withColumn("type_rank", F.row_number().over(order)).drop("first").join(n, column)


def column_relations(candidates: DataFrame, relations: DataFrame, config: Config) -> DataFrame:
    """table_id, source_column, target_column, relation, confidence and its order, above the threshold."""
    f = type_frequencies(candidates)
    small = F.broadcast(relations)  # a fixed table of 160 rows
    side = lambda name: f.select("table_id", F.col("col_idx").alias(f"{name}_column"), F.col("type_uri").alias(f"{name}_type"), (F.col("frequency") / F.col("n")).alias(f"{name}_share"), F.col("type_rank").alias(f"{name}_rank"))
    x = side("source").join(small, "source_type").join(side("target"), ["table_id", "target_type"]).where("source_column <> target_column")
    sure = F.round(F.col("confidence") * F.col("source_share") * F.col("target_share"), 9)
    x = x.select("table_id", "source_column", "target_column", "relation", sure.alias("confidence"), "source_rank", "target_rank", "ord")
    return x.where(F.col("confidence") >= config.min_relation_confidence)


def top_relations(relations: DataFrame, config: Config) -> DataFrame:
    """The surest relations of each source column."""
    order = Window.partitionBy("table_id", "source_column").orderBy(F.desc("confidence"), "target_column", "source_rank", "target_rank", "ord")
    x = relations.withColumn("place", F.row_number().over(order)).where(F.col("place") <= config.relations_per_column)
    return x.select("table_id", "source_column", "target_column", "relation", "confidence", "place")


def row_overlap(candidates: DataFrame) -> DataFrame:
    """For each pair of columns, rows where both have candidates over rows where either has."""
    rows = candidates.select("table_id", "row_idx", "col_idx").distinct()
    n = rows.groupBy("table_id", "col_idx").agg(F.count("*").alias("n"))
    other = rows.select("table_id", "row_idx", F.col("col_idx").alias("other"))
    both = rows.join(other, ["table_id", "row_idx"]).where("col_idx <> other").groupBy("table_id", "col_idx", "other").agg(F.count("*").alias("both"))
    x = both.join(n, ["table_id", "col_idx"]).join(n.select("table_id", F.col("col_idx").alias("other"), F.col("n").alias("m")), ["table_id", "other"])
    return x.select("table_id", F.col("col_idx").alias("source_column"), F.col("other").alias("target_column"), (F.col("both") / (F.col("n") + F.col("m") - F.col("both"))).alias("overlap"))
