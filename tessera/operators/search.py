"""Candidates of cells: lookup, ranking, types."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import Config
from ..functions.similarity import search_confidence
from ..sources.kb import KnowledgeBase
from ..sources.scratch import stored, tidy

#: Scores that are equal but for rounding must tie.
DIGITS = 12
DBPEDIA_FIRST = "case when source = 'DBpedia' then 0 else 1 end"


def searchable(cells: DataFrame, config: Config) -> DataFrame:
    """Cells worth a lookup."""
    v = F.col("value")
    return cells.where((F.trim(v) != "") & ~v.isin("0", "-") & (F.length(v) >= config.min_value_length))


def lookup(values: DataFrame, kb: KnowledgeBase, config: Config) -> DataFrame:
    """Search hits of distinct values: value, source, uri, label, raw (confidence), place (DBpedia's hits first)."""
    hits = values.select("value").distinct().join(kb.search, F.col("value") == F.col("query"))
    raw = search_confidence(F.col("value"), F.col("label"), F.col("pos"), F.col("n_results"), config.similarity_weight, config.position_weight)
    place = F.row_number().over(Window.partitionBy("value").orderBy(F.expr(DBPEDIA_FIRST), "pos", "uri"))
    return hits.select("value", "source", "uri", "label", F.round(raw, DIGITS).alias("raw"), place.alias("place"))


def dedupe(hits: DataFrame) -> DataFrame:
    """One hit per value and URI: the surest, the first of equals, at the place of the first."""
    best = F.max_by(F.struct("source", "label", "raw"), F.struct(F.col("raw"), -F.col("place")))
    x = hits.groupBy("value", "uri").agg(best.alias("best"), F.min("place").alias("place"))
    return x.select("value", "uri", "best.*", "place")


def ranked(hits: DataFrame, config: Config, top: bool = True) -> DataFrame:
    """Adds confidence (raw, boosted where the label is the value) and rank; the top candidates above the threshold."""
    exact = F.when(F.lower("label") == F.lower("value"), config.exact_match_boost).otherwise(0.0)
    x = hits.withColumn("confidence", F.round(F.least(F.lit(1.0), F.col("raw") + exact), DIGITS))
    if top:
        x = x.where(F.col("confidence") >= config.min_candidate_confidence)
    order = Window.partitionBy("value").orderBy(F.desc("confidence"), F.desc("raw"), "place")
    x = x.withColumn("rank", F.row_number().over(order))
    return x.where(F.col("rank") <= config.candidates_per_cell) if top else x


def own_types(entities: DataFrame, kb: KnowledgeBase) -> DataFrame:
    """Types of entities(source, uri) in their own knowledge base: source, uri, ord, type_uri, type_label."""
    types = kb.types.withColumnRenamed("entity_uri", "uri")
    return entities.select("source", "uri").distinct().join(types, ["source", "uri"])


def cross_types(hits: DataFrame, kb: KnowledgeBase, config: Config) -> DataFrame:
    """For hits without types or not sure enough: types of the other base's first hit for their name.

    A DBpedia entity's name is its URI's last part with spaces for underscores, a Wikidata entity's its label.
    Returns value, uri, type_source, ord, type_uri, type_label.
    """
    name = F.when(F.col("source") == "DBpedia", F.regexp_replace(F.element_at(F.split("uri", "/"), -1), "_", " ")).otherwise(F.col("label"))
    other = F.when(F.col("source") == "DBpedia", "Wikidata").otherwise("DBpedia")
    typed = own_types(hits, kb).select("source", "uri").distinct().withColumn("typed", F.lit(True))
    needy = hits.join(typed, ["source", "uri"], "left").where(F.col("typed").isNull() | (F.col("confidence") < config.cross_source_below))
    first = kb.search.where("pos = 0").select(F.col("source").alias("type_source"), F.col("query").alias("name"), F.col("uri").alias("entity_uri"))
    found = needy.select("value", "uri", name.alias("name"), other.alias("type_source")).join(first, ["type_source", "name"])
    types = kb.types.withColumnRenamed("source", "type_source")
    return found.join(types, ["type_source", "entity_uri"]).select("value", "uri", "type_source", "ord", "type_uri", "type_label")


def typed_candidates(hits: DataFrame, kb: KnowledgeBase, config: Config) -> DataFrame:
    """Hits with types (array of uri, label, source: DBpedia's first, repeats kept); without any they drop out."""
    own = hits.join(kb.types.withColumnRenamed("entity_uri", "uri"), ["source", "uri"]).select("value", "uri", F.col("source").alias("type_source"), F.lit(0).alias("way"), "ord", "type_uri", "type_label")
    both = own.unionByName(cross_types(hits, kb, config).withColumn("way", F.lit(1)))
    rank = F.when(F.col("type_source") == "DBpedia", 0).otherwise(1)
    order = F.struct(rank.alias("r"), F.col("way"), F.col("ord"), F.struct(F.col("type_uri").alias("uri"), F.col("type_label").alias("label"), F.col("type_source").alias("source")).alias("t"))
    types = both.groupBy("value", "uri").agg(F.transform(F.sort_array(F.collect_list(order)), lambda x: x["t"]).alias("types"))
    return hits.join(types, ["value", "uri"])


@tidy
def search_entities(cells: DataFrame, kb: KnowledgeBase, config: Config) -> DataFrame:
    """candidates: table_id, col_idx, row_idx, rank, header, value, source, uri, label, confidence, score, types.

    Values are looked up once each, however often they stand in cells.
    """
    kb = kb.for_config(config)
    cells = searchable(cells, config)
    # Five branches read the hits; stored, they are looked up once and the plan stays small.
    hits = stored(ranked(dedupe(lookup(cells, kb, config)), config))
    typed = typed_candidates(hits, kb, config).select("value", "rank", "source", "uri", "label", "confidence", F.col("confidence").alias("score"), "types")
    return cells.select("table_id", "col_idx", "row_idx", "header", "value").join(typed, "value").select("table_id", "col_idx", "row_idx", "rank", "header", "value", "source", "uri", "label", "confidence", "score", "types")
