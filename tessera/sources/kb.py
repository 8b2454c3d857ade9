"""Knowledge bases as three DataFrames, so that lookups are joins.

kb_search: source, query, pos, n_results, uri, label (ranked results of a query; optional language)
kb_types: source, entity_uri, ord, type_uri, type_label
kb_parents: source, type_uri, ord, parent_uri
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.seeds import DBPEDIA
from ..functions.similarity import characters


@dataclass(frozen=True)
class KnowledgeBase:
    search: DataFrame
    types: DataFrame
    parents: DataFrame

    def for_config(self, config) -> KnowledgeBase:
        """Sources that are switched on, in the language asked for; DBpedia types of its ontology only."""
        on = [name for name, use in (("DBpedia", config.use_dbpedia), ("Wikidata", config.use_wikidata)) if use]
        search = self.search.where(F.col("source").isin(on))
        if "language" in search.columns:
            search = search.where((F.col("source") == "DBpedia") | (F.col("language") == config.language))
        own = (F.col("source") != "DBpedia") | F.col("type_uri").startswith(DBPEDIA)
        parents = self.parents.where((F.col("source") != "DBpedia") | F.col("parent_uri").startswith(DBPEDIA))
        return KnowledgeBase(search, self.types.where(own), parents)


def build_search(entities: DataFrame, values: DataFrame, limit: int = 5) -> DataFrame:
    """kb_search for values(value) over entities(source, uri, label), without a search service.

    Candidates share a word with the value (equal labels always do); the ``limit`` most similar by
    characters rank, ties by label and uri.
    """
    word = lambda c: F.explode(F.array_distinct(F.array_append(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), F.lower(c)))).alias("word")
    left = values.select(F.col("value").alias("query")).distinct().select("query", word(F.col("query")))
    right = entities.select("source", "uri", "label", word(F.col("label")))
    pairs = left.join(right, "word").where("word <> ''").select("query", "source", "uri", "label").distinct()
    pairs = pairs.withColumn("similarity", characters(F.lower("query"), F.lower("label")))
    by = Window.partitionBy("source", "query").orderBy(F.desc(F.round("similarity", 12)), "label", "uri")
    ranked = pairs.withColumn("pos", F.row_number().over(by) - 1).where(F.col("pos") < limit)
    return ranked.select("source", "query", F.col("pos").cast("int").alias("pos"), F.count("*").over(Window.partitionBy("source", "query")).cast("int").alias("n_results"), "uri", "label")
