"""Mixing sources to target weights by hash-threshold histograms.

Sizes are counted in words.  Each source gets a target from its weight, at most ``cap`` times its size.
Whole copies of a source are taken as often as they fit; for what is left, the documents below a hash
threshold are taken once more.  The threshold is found by summing sizes by source and hash bucket and
refining only the bucket that the target falls in, so no document is ever sorted.

Null or empty texts have size 0; a null source is a source of its own, the last one; rows equal in id
and text share a hash and are taken alike; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import tidy
from .common import SPACE, save

BITS, LEVELS = 10, 4
#: Source tables of up to this many rows are sent to all executors; larger ones are joined by shuffle.
BROADCAST_SOURCES = 100_000


def measured(docs: DataFrame) -> DataFrame:
    """All columns of docs in the struct ``row`` with size, source and a hash of 40 bits."""
    word = SPACE.replace("[", "[^", 1) + "+"
    return docs.select(
        F.struct("*").alias("row"),
        F.col("source"),
        F.regexp_count(F.coalesce("text", F.lit("")), F.lit(word)).cast("long").alias("size"),
        F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 64 - BITS * LEVELS).alias("hash"),
    )


def targets(by_source: DataFrame, weights: list[float], cap: float, share: float = 1.0) -> DataFrame:
    """(source, source_size) with the target of each source.

    With sources in order of cap * size / weight, those at their cap come first: source i is capped if
    its ratio is at most what the rest of the budget gives a unit of weight of i and all after it.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, map(float, weights))), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    x = by_source.withColumn("weight", weight).withColumn("most", F.col("source_size") * float(cap))
    by_ratio = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    every = Window.partitionBy(F.lit(0))
    before, after = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(0, Window.unboundedFollowing)
    left = F.sum("source_size").over(every) * float(share) - F.coalesce(F.sum("most").over(before), F.lit(0.0))
    x = x.withColumn("unit", left / F.sum("weight").over(after)).withColumn("capped", F.col("most") <= F.col("unit") * F.col("weight"))
    unit = F.max(F.when(~F.col("capped"), F.col("unit"))).over(every)
    return x.select("source", "source_size", F.when(F.col("capped"), F.col("most")).otherwise(unit * F.col("weight")).alias("target"))


def thresholds(sized: DataFrame, weights: list[float], cap: float = 3.0) -> DataFrame:
    """(source, source_size, target, whole, below): take each document ``whole`` times, and once more if hash < below."""
    goal = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, cap)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") + 1e-12)).otherwise(F.lit(0)).cast("long")
    goal = goal.withColumn("whole", whole)
    state = save(goal.withColumn("low", F.lit(0).cast("long")).withColumn("rest", F.greatest(F.lit(0.0), F.col("target") - F.col("whole") * F.col("source_size"))))
    keys = ["source", "source_size", "target", "whole"]
    for level in range(1, LEVELS + 1):
        shift = BITS * (LEVELS - level)
        docs = sized.select(F.col("source").alias("from"), "size", "hash")
        small = F.broadcast(state) if state.count() <= BROADCAST_SOURCES else state
        inside = docs.join(small, F.col("from").eqNullSafe(F.col("source")) & (F.shiftright("hash", shift + BITS) == F.shiftright("low", shift + BITS)))
        histogram = inside.groupBy(*keys, "low", "rest", F.shiftright("hash", shift).alias("bucket")).agg(F.sum("size").alias("tokens"))
        upto = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
        run = histogram.withColumn("sum", F.sum("tokens").over(upto)).withColumn("over", F.col("sum") > F.col("rest"))
        first = run.groupBy(*keys).agg(
            F.min_by(F.struct("bucket", "sum", "tokens", "rest"), F.when(F.col("over"), F.col("bucket"))).alias("edge"),
            F.max("bucket").alias("last"),
        )
        before = F.col("edge.sum") - F.col("edge.tokens")
        if level < LEVELS:
            low, rest = F.shiftleft(F.col("edge.bucket"), shift), F.col("edge.rest") - before
        else:  # one hash value: in or out, whichever is nearer
            nearer = F.col("edge.sum") - F.col("edge.rest") < F.col("edge.rest") - before
            low, rest = F.col("edge.bucket") + nearer.cast("long"), F.lit(0.0)
        none = F.col("edge").isNull()  # all of it fits
        found = save(first.select(*keys, F.when(none, F.shiftleft(F.col("last") + 1, shift)).otherwise(low).alias("low"), F.when(none, F.lit(0.0)).otherwise(rest).alias("rest")))
        # Sources that have no document at their threshold any more keep it.
        settled = state.join(found.select(F.col("source").alias("of")), F.col("source").eqNullSafe(F.col("of")), "left_anti")
        state = save(found.unionByName(settled))
    return state.select(*keys, F.col("low").alias("below"))


def with_copies(sized: DataFrame, limits: DataFrame) -> DataFrame:
    """Adds source_size, target and copies to rows of measured()."""
    limits = limits.withColumnRenamed("source", "of")
    limits = F.broadcast(limits) if limits.count() <= BROADCAST_SOURCES else limits
    joined = sized.join(limits, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    return joined.withColumn("copies", F.col("whole") + (F.col("hash") < F.col("below")).cast("long")).drop("whole", "below")


@tidy
def source_mix(docs: DataFrame, weights: list[float], cap: float = 3.0) -> DataFrame:
    """doc_id, source, size, source_size, target, taken for every document."""
    sized = save(measured(docs).select(F.col("row.doc_id").alias("doc_id"), "source", "size", "hash"))
    out = with_copies(sized, thresholds(sized, weights, cap))
    return out.select("doc_id", "source", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


@tidy
def mixed_documents(docs: DataFrame, weights: list[float], cap: float = 3.0) -> DataFrame:
    """The mix itself, with docs' columns: a document is as many rows as the mix takes it times."""
    sized = measured(docs)
    limits = thresholds(save(sized.select("source", "size", "hash")), weights, cap)
    out = with_copies(sized, limits).where("copies > 0")
    return out.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("row.*")
