"""Equivalent types of the two vocabularies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text

KEY = ["table_id", "col_idx", "row_idx", "rank"]


def equivalent_types(types: DataFrame, mapping: DataFrame) -> DataFrame:
    """Mapping rows that match types(type_uri) on either side: two equi-joins, not one with an OR."""
    small = F.broadcast(mapping)  # a fixed table of 54 rows
    left = types.join(small, F.col("type_uri") == F.col("dbpedia_type"))
    right = types.join(small, (F.col("type_uri") == F.col("wikidata_type")) & (F.col("type_uri") != F.col("dbpedia_type")))
    return left.unionByName(right)


def to_wikidata(types: DataFrame, mapping: DataFrame) -> DataFrame:
    """Adds wikidata_type, mapping_confidence and mapping_ord to DBpedia types that have one."""
    small = F.broadcast(mapping.select(F.col("dbpedia_type").alias("type_uri"), "wikidata_type", F.col("confidence").alias("mapping_confidence"), F.col("ord").alias("mapping_ord")))
    return types.join(small, "type_uri")


def mapping_boost(candidates: DataFrame, mapping: DataFrame) -> DataFrame:
    """value, uri, boost and new types of each distinct candidate that has a mapped type, however many cells it stands in."""
    entity = ["value", "uri"]
    types = candidates.groupBy(*entity).agg(F.first("types").alias("types")).select(*entity, F.col("types.uri").alias("uris"), F.posexplode("types").alias("ord", "t"))
    small = F.broadcast(mapping.withColumnRenamed("ord", "mapping_ord"))
    from_dbpedia = types.where(F.col("t.source") == "DBpedia").join(small, F.col("t.uri") == F.col("dbpedia_type"))
    from_wikidata = types.where((F.col("t.source") == "Wikidata")).join(small, F.col("t.uri") == F.col("wikidata_type")).where(F.array_contains("uris", F.col("dbpedia_type")))
    new = F.when(~F.array_contains("uris", F.col("wikidata_type")), F.struct(F.col("ord").alias("a"), F.col("mapping_ord").alias("b"), F.col("wikidata_type").alias("uri")))
    paid = F.col("confidence") * 0.1
    both = from_dbpedia.select(*entity, paid.alias("paid"), new.alias("new")).unionByName(from_wikidata.select(*entity, paid.alias("paid"), F.lit(None).cast("struct<a:int,b:int,uri:string>").alias("new")))
    x = both.groupBy(*entity).agg(F.sum("paid").alias("paid"), F.array_distinct(F.transform(F.sort_array(F.collect_list("new")), lambda n: n["uri"])).alias("new"))
    return x.select(*entity, F.least(F.lit(0.3), F.round("paid", 12)).alias("boost"), "new")


def enhance(candidates: DataFrame, mapping: DataFrame) -> DataFrame:
    """Candidates with mapped Wikidata types added and the score raised by at most 0.3, to 1 at most."""
    label = lambda u: text.uri_label(u, "Type")
    x = candidates.join(mapping_boost(candidates, mapping), ["value", "uri"], "left")
    added = F.transform("new", lambda u: F.struct(u.alias("uri"), label(u).alias("label"), F.lit("Wikidata").alias("source")))
    x = x.withColumn("types", F.when(F.col("new").isNull(), F.col("types")).otherwise(F.concat("types", added)))
    return x.withColumn("score", F.round(F.least(F.lit(1.0), F.col("score") + F.coalesce("boost", F.lit(0.0))), 12)).drop("boost", "new")
