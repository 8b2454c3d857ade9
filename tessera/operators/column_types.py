"""Types of columns: votes of entities, parents, preference for Wikidata."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import Config
from ..functions import text
from ..sources.scratch import stored
from .mapping import to_wikidata

COLUMN = ["table_id", "col_idx"]


def best_entities(candidates: DataFrame) -> DataFrame:
    """One candidate per column and entity: the best score, the first of equals; first is the entity's first place.

    An aggregation, so that a task sends one row per entity, however many cells hold it.
    """
    key = [*COLUMN, "uri"]
    rest = F.struct(*[c for c in candidates.columns if c not in key])
    best = F.max_by(rest, F.struct("score", -F.col("row_idx"), -F.col("rank"))).alias("best")
    x = candidates.groupBy(*key).agg(best, F.min(F.struct("row_idx", "rank")).alias("first"))
    return x.select(*[c if c in key else f"best.{c}" for c in candidates.columns], "first")


def type_events(entities: DataFrame, parents: DataFrame, config: Config) -> DataFrame:
    """The log of a column: each type of each entity, then its parents at a lower weight, in order (seq)."""
    t = entities.select(*COLUMN, "score", "first", F.posexplode("types").alias("ord", "t"))
    direct = t.select(*COLUMN, F.col("t.uri").alias("type_uri"), F.col("t.label").alias("label"), F.col("t.source").alias("source"), F.lit("direct").alias("kind"), "score", F.struct("first", "ord", F.lit(0).alias("way"), F.lit(0).alias("nth")).alias("seq"))
    up = parents.select(F.col("source").alias("parent_source"), F.col("type_uri").alias("child"), F.col("ord").alias("nth"), "parent_uri")
    inherited = t.join(up, (F.col("t.uri") == F.col("child")) & (F.col("t.source") == F.col("parent_source")))
    inherited = inherited.select(*COLUMN, F.col("parent_uri").alias("type_uri"), text.uri_label(F.col("parent_uri")).alias("label"), F.col("parent_source").alias("source"), F.lit("parent").alias("kind"), (F.col("score") * config.parent_weight).alias("score"), F.struct("first", "ord", F.lit(1).alias("way"), "nth").alias("seq"))
    return direct.unionByName(inherited)


def type_votes(candidates: DataFrame, parents: DataFrame, config: Config) -> DataFrame:
    """table_id, col_idx, type_uri, label, source, score, entity_matches, confidence, seq.

    Direct types add up; a parent counts only if it comes before any other event of its type.
    """
    n = candidates.groupBy(*COLUMN).agg(F.count("*").alias("n"))
    events = type_events(best_entities(candidates), parents, config)
    direct = F.col("kind") == "direct"
    x = events.groupBy(*COLUMN, "type_uri").agg(
        F.min_by(F.struct("kind", "score", "label", "source"), "seq").alias("head"),
        F.min("seq").alias("seq"),
        F.sum(F.when(direct, F.col("score")).otherwise(0.0)).alias("direct"),
        F.count(F.when(direct, 1)).alias("matches"),
    )
    parent = F.col("head.kind") == "parent"
    score = F.round(F.col("direct") + F.when(parent, F.col("head.score")).otherwise(0.0), 9)
    x = x.select(*COLUMN, "type_uri", "head.label", "head.source", score.alias("score"), (F.col("matches") + parent.cast("int")).alias("entity_matches"), "seq")
    return x.join(n, COLUMN).withColumn("confidence", F.round(F.col("score") / F.col("n"), 9)).drop("n")


def leading_types(votes: DataFrame, config: Config) -> DataFrame:
    """The first types of a column by score, sure enough, numbered by place."""
    order = Window.partitionBy(*COLUMN).orderBy(F.desc("score"), "seq")
    sure = votes.where(F.col("confidence") >= config.min_type_confidence)
    x = sure.withColumn("place", F.row_number().over(order)).where(F.col("place") <= config.types_per_column)
    return x.select(*COLUMN, "place", "type_uri", "label", "source", "score", "entity_matches", "confidence")


def prefer_wikidata(leading: DataFrame, mapping: DataFrame, config: Config) -> DataFrame:
    """Wikidata types, raised, then Wikidata types that DBpedia types stand for; without any, the types as they were."""
    raised = F.round(F.least(F.lit(1.0), F.col("confidence") + F.least(F.lit(0.3), 0.2 * F.col("confidence") + 0.1)), 9)
    own = leading.where("source = 'Wikidata'").withColumn("confidence", raised).withColumn("block", F.lit(0)).withColumn("sub", F.lit(0))
    known = own.select(*COLUMN, "type_uri")
    made = to_wikidata(leading.where("source = 'DBpedia'"), mapping)
    made = made.select(*COLUMN, "place", F.col("wikidata_type").alias("type_uri"), text.uri_label(F.col("wikidata_type"), "Type").alias("label"), F.lit("Wikidata").alias("source"), "score", "entity_matches", "confidence", F.lit(1).alias("block"), F.col("mapping_ord").alias("sub"))
    made = made.join(known, [*COLUMN, "type_uri"], "left_anti")
    first = Window.partitionBy(*COLUMN, "type_uri").orderBy("place", "sub")
    made = made.withColumn("nth", F.row_number().over(first)).where("nth = 1").drop("nth")
    chosen = own.unionByName(made)
    kept = leading.join(chosen.select(*COLUMN).distinct(), COLUMN, "left_anti").withColumn("block", F.lit(2)).withColumn("sub", F.lit(0))
    order = Window.partitionBy(*COLUMN).orderBy(F.when(F.col("block") == 2, 0.0).otherwise(-F.col("confidence")), "block", "place", "sub")
    x = chosen.unionByName(kept).withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= config.types_per_column)
    return x.select(*COLUMN, F.col("nth").alias("place"), "type_uri", "label", "source", "score", "entity_matches", "confidence")


def relation_boost(types: DataFrame, relations: DataFrame, seeds: DataFrame, config: Config) -> DataFrame:
    """Opt-in: types that fit a relation of their column gain by its confidence.

    A pair of types fits if a direct relation of that name joins them, or if no direct relation has the name.
    """
    types, relations = stored(types), stored(relations)  # read by both directions, whose plan would hold the making of each twice and more
    direct = F.broadcast(seeds.where("direct").select("source_type", "target_type", "relation"))
    names = direct.select("relation").distinct().withColumn("direct", F.lit(True))
    r = relations.select("table_id", "source_column", "target_column", "relation", F.col("confidence").alias("sure")).join(F.broadcast(names), "relation", "left")
    out = []
    for mine, theirs, my_type, their_type in (("source_column", "target_column", "source_type", "target_type"), ("target_column", "source_column", "target_type", "source_type")):
        x = types.select(*COLUMN, "type_uri").join(r.withColumnRenamed(mine, "col_idx").withColumnRenamed(theirs, "other"), COLUMN)
        partner = types.where("place = 1").select("table_id", F.col("col_idx").alias("other"), F.col("type_uri").alias("partner"))
        x = x.join(partner, ["table_id", "other"])
        pairs = direct.select(F.col(my_type).alias("type_uri"), F.col(their_type).alias("partner"), "relation", F.lit(True).alias("fits"))
        x = x.join(pairs.distinct(), ["type_uri", "partner", "relation"], "left").where(F.col("direct").isNull() | F.col("fits"))
        out.append(x.select(*COLUMN, "type_uri", "sure"))
    gain = out[0].unionByName(out[1]).groupBy(*COLUMN, "type_uri").agg(F.sum("sure").alias("gain"))
    x = types.join(gain, [*COLUMN, "type_uri"], "left")
    return x.withColumn("confidence", F.round(F.least(F.lit(1.0), F.col("confidence") + config.relation_boost * F.coalesce("gain", F.lit(0.0))), 9)).drop("gain")
