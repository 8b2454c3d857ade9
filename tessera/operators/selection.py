"""Final answers: a type per column, entities per cell, and both on lists of targets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .column_types import COLUMN


def assign_types(types: DataFrame, headers: DataFrame | None = None) -> DataFrame:
    """cta: table_id, col_idx, header, type_uri, label, confidence, alternatives (by confidence).  Columns without types are left out."""
    entry = F.struct(F.col("place"), F.col("type_uri").alias("uri"), "label", "source", "score", "entity_matches", "confidence")
    x = types.groupBy(*COLUMN).agg(F.sort_array(F.collect_list(entry)).alias("all"))
    first = F.element_at("all", 1)
    rest = F.slice("all", 2, F.greatest(F.size("all") - 1, F.lit(0)))
    x = x.select(*COLUMN, first["uri"].alias("type_uri"), first["label"].alias("label"), first["confidence"].alias("confidence"), rest.alias("alternatives"))
    if headers is not None:
        x = x.join(headers, COLUMN, "left")
    return x


def report(types: DataFrame, most: int = 3) -> DataFrame:
    """assign_types() for readers: the type's label, percent and URI, and label and percent of up to ``most`` alternatives."""
    percent = lambda c: F.concat(F.floor(c * 100 + 0.5), F.lit("%"))
    others = F.transform(F.slice("alternatives", 1, most), lambda a: F.concat(a["label"], F.lit(" - "), percent(a["confidence"])))
    header = [F.col("header")] if "header" in types.columns else []
    return types.select(*COLUMN, *header, F.concat(F.col("label"), F.lit(" - "), percent(F.col("confidence")), F.lit(" - "), F.col("type_uri")).alias("type"), F.array_join(others, ", ").alias("alternatives"))


def cell_entities(candidates: DataFrame) -> DataFrame:
    """cea: every Wikidata candidate of each cell, in order."""
    return candidates.where((F.col("source") != "DBpedia") & (F.col("uri") != "")).select("table_id", "row_idx", "col_idx", "rank", "uri", "label", "confidence")


def best_entity(candidates: DataFrame) -> DataFrame:
    """The first Wikidata candidate of each cell."""
    best = F.min_by(F.struct("uri", "label", "confidence"), "rank")
    return cell_entities(candidates).groupBy("table_id", "row_idx", "col_idx").agg(best.alias("best")).select("table_id", "row_idx", "col_idx", "best.*")


def fill_cta_targets(targets: DataFrame, cta: DataFrame) -> DataFrame:
    """Targets with the new type where there is one, else what they had."""
    found = cta.select("table_id", "col_idx", F.col("type_uri").alias("new"))
    return targets.join(found, ["table_id", "col_idx"], "left").withColumn("result", F.coalesce("new", "result")).drop("new")


def fill_cea_targets(targets: DataFrame, best: DataFrame, tables: DataFrame) -> DataFrame:
    """Targets (row from 1) with the best entity; empty where the table was read but has none; unread tables keep theirs."""
    found = best.select("table_id", (F.col("row_idx") + 1).alias("row"), "col_idx", F.col("uri").alias("new"))
    x = targets.join(found, ["table_id", "row", "col_idx"], "left").join(tables.select("table_id").distinct().withColumn("read", F.lit(True)), "table_id", "left")
    return x.withColumn("uri", F.when(F.col("read"), F.coalesce("new", F.lit(""))).otherwise(F.col("uri"))).drop("new", "read")
