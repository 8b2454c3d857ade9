"""What several operators share: scratch tables, words, connected components."""

from __future__ import annotations

import sys
import types

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..sources.scratch import new_folder

#: A word is a run of characters other than these.
SPACE = r"[\x20\x09-\x0D]"
#: Settings while a table is written: shuffle files go as soon as it is there, and Arrow batches are short.
WHILE_SAVING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "512"}


def words(text: Column) -> Column:
    """The words of a text as an array; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), "")


def save(df: DataFrame, *partition_by: str) -> DataFrame:
    """Write to a shared table and read it back: cuts lineage, survives lost executors, frees shuffle files."""
    spark = df.sparkSession
    path, before = new_folder(spark), {key: spark.conf.get(key) for key in WHILE_SAVING}
    try:
        for key, value in WHILE_SAVING.items():
            spark.conf.set(key, value)
        writer = df.write
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.parquet(path)
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    return spark.read.schema(df.schema).parquet(path)


def sliced(batches, rows: int = 512):
    """Arrow batches of at most so many rows.  Spark bounds a batch by 64 MB; this bounds what is worked on at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def worker_cache() -> dict:
    """A dictionary that lives as long as the Python worker."""
    return sys.modules.setdefault("_tessera_worker_cache", types.ModuleType("_tessera_worker_cache")).__dict__


def components(links: DataFrame) -> DataFrame:
    """Connected components of links(a, b): returns (node, component), component the smallest node reachable.

    Alternating large-star and small-star rounds, until a round changes nothing: in each, a node's neighbours
    move to its smallest neighbour, so that depth halves.  Every round is a written table, which counts itself
    as it is written.  Self-links give a component of one.  Empty links give an empty result.
    """
    edges, seen = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v"), None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.unionByName(low.where("m < u").select("u", F.col("m").alias("v")))
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(down.select("u", F.col("m").alias("v")))
        state = Observation()
        found = small.where("u > v").distinct().observe(state, F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("sum"))
        edges = save(found)
        if state.get == seen or not state.get["n"]:
            break
        seen = state.get
    roots = links.select(F.col("a").alias("node")).union(links.select("b")).distinct()
    return roots.join(edges.select(F.col("u").alias("node"), F.col("v").alias("component")), "node", "left").select("node", F.coalesce("component", "node").alias("component"))
