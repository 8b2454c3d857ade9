"""The two annotations as one plan each, for any number of tables at once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from ..functions import seeds, text
from ..operators import column_types, mapping, relations, search, selection, uri
from ..sources import tables
from ..sources.kb import KnowledgeBase
from ..sources.scratch import stored, tidy


@dataclass(frozen=True)
class ColumnTypes:
    types: DataFrame
    relations: DataFrame | None
    candidates: DataFrame


def prepared(cells: DataFrame, config: Config, sampled: bool) -> DataFrame:
    """Cells sampled and corrected; each distinct value is corrected once."""
    if sampled:
        cells = tables.sample_rows(cells, config.sample_size)
    if not config.correct:
        return cells
    corrected = cells.select("value").distinct().withColumn("correct", text.correct(F.col("value"), config.as_of_year))
    corrected = corrected.where("correct <> ''")
    return stored(cells.join(corrected, "value").withColumn("value", F.col("correct")).drop("correct"))


def run_cta(cells: DataFrame, kb: KnowledgeBase, config: Config | None = None) -> ColumnTypes:
    """Types of columns.

    What several branches read (cells, candidates, leading types) is written to the shared checkpoint
    folder once; without that the plan would hold each branch's copy of all before it.
    """
    config = config or Config()
    spark = cells.sparkSession
    equivalents = seeds.type_mapping(spark)
    found = stored(search.search_entities(prepared(cells, config, sampled=True), kb, config))
    candidates = stored(mapping.enhance(found, equivalents))
    related = None
    if config.use_column_relations:
        related = relations.top_relations(relations.column_relations(candidates, seeds.type_relations(spark), config), config)
    if config.use_uri_analysis:
        candidates = stored(uri.boost_by_uri(candidates, config))
    votes = column_types.type_votes(candidates, kb.for_config(config).parents, config)
    leading = stored(column_types.leading_types(votes, config))
    types = column_types.prefer_wikidata(leading, equivalents, config)
    if config.apply_relation_boost and related is not None:
        types = column_types.relation_boost(types, related, seeds.type_relations(spark), config)
    if config.confidence_threshold is not None:
        types = types.where(F.col("confidence") >= config.confidence_threshold)
    headers = cells.groupBy("table_id", "col_idx").agg(F.first("header").alias("header"))
    return ColumnTypes(selection.assign_types(types, headers), related, candidates)


@tidy
def run_cea(cells: DataFrame, kb: KnowledgeBase, config: Config | None = None, mode: str = "all") -> DataFrame:
    """Entities of cells of all rows: every Wikidata candidate, or mode="best", the first."""
    config = config or Config()
    candidates = search.search_entities(prepared(cells, config, sampled=False), kb, config)
    return selection.best_entity(candidates) if mode == "best" else selection.cell_entities(candidates)


@tidy
def run_batch(spark: SparkSession, folder: str, targets_path: str, kb: KnowledgeBase, task: str, config: Config | None = None) -> DataFrame:
    """Targets (task "cta" or "cea") filled in from the folder's tables; only tables with targets are annotated."""
    cells = tables.read_cells(spark, folder)
    if task == "cta":
        targets = tables.read_cta_targets(spark, targets_path)
        wanted = cells.join(targets.select("table_id").distinct(), "table_id", "left_semi")
        return selection.fill_cta_targets(targets, run_cta(wanted, kb, config).types)
    targets = tables.read_cea_targets(spark, targets_path)
    wanted = cells.join(targets.select("table_id").distinct(), "table_id", "left_semi")
    return selection.fill_cea_targets(targets, run_cea(wanted, kb, config, "best"), wanted)
