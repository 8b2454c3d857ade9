"""What substring and suffix-array dedup share: copies, winnowed anchors, and cutting ranges out of texts.

A winnowed anchor is the least of the k-grams in a window, so equal windows have equal anchors: windows
that recur are found among those whose anchor recurs.  Both operators first collapse exact copies of
whole texts, of which one takes part.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import save, sliced
from .rolling import mix

#: Buckets of documents (2**BUCKET_BITS: what is broadcast); anchors that a task remembers (2**SLOT_BITS).
BUCKET_BITS, SLOT_BITS = 20, 20
#: Anchors in more documents than this are no group: each of their windows is one by itself.
OFTEN = 10_000
ID = ["oid", "tid"]


def identified(docs: DataFrame) -> DataFrame:
    """row (all columns of docs but the text), text (never null), oid (doc_id, nulls first of all), tid (tells apart texts of one oid) and sha (the text's digest)."""
    text = F.coalesce("text", F.lit(""))
    oid = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)))
    return docs.select(F.struct(*[c for c in docs.columns if c != "text"]).alias("row"), text.alias("text"), oid.alias("oid"), F.xxhash64(text).alias("tid"), F.sha2(text, 256).alias("sha"))


def parted(x: DataFrame, ids: DataFrame, by: list[str] = ID) -> tuple[DataFrame, DataFrame]:
    """x in two: rows that ids (of the same oid and tid) may name, and rows that they do not.

    ids are sent to all executors as numbers of buckets, of which there are 2**BUCKET_BITS at most, so that the
    texts of the second part need not be moved.
    """
    bucket = F.pmod(F.xxhash64(*by), F.lit(1 << BUCKET_BITS)).cast("int")
    named = F.broadcast(save(ids.select(bucket.alias("bucket")).distinct()))
    x = x.withColumn("bucket", bucket)
    return x.join(named, "bucket", "left_semi").drop("bucket"), x.join(named, "bucket", "left_anti").drop("bucket")


def copies(x: DataFrame) -> DataFrame:
    """oid, tid, sha, first (the smallest oid with the text) and n of every row whose text occurs twice or more."""
    facts = save(x.select("oid", "tid", "sha"))
    classes = facts.groupBy("sha").agg(F.min("oid").alias("first"), F.count("*").alias("n")).where("n > 1")
    return save(facts.join(classes, "sha"))


def representatives(x: DataFrame, copied: DataFrame) -> DataFrame:
    """x without all but the first of each group of copies."""
    later = copied.where("oid > first").select(*ID).distinct()
    maybe, never = parted(x, later)
    return never.unionByName(maybe.join(later, ID, "left_anti"))


def recurring(reps: DataFrame, anchors: Callable, across_documents: bool) -> DataFrame:
    """oid, anchor, more: the anchors of each document that recur (in another document, or anywhere); written.

    anchors(texts) gives pairs of a text's place in the list and its anchors, with repeats.

    A task sends an anchor to where all tasks' rows of it meet only twice; what it has seen twice recurs, and its
    further rows (more) are dealt out at random.
    """

    def run(batches):
        import numpy as np
        import pyarrow as pa

        slots, times = np.zeros(1 << SLOT_BITS, dtype=np.uint64), np.zeros(1 << SLOT_BITS, dtype=np.int8)
        for batch in sliced(batches, 256):
            found = anchors(batch.column("text").to_pylist())
            unique = [np.unique(x, return_counts=True) for _, x in found]
            flat = np.concatenate([x for x, _ in unique]) if found else np.zeros(0, np.uint64)
            again = (np.concatenate([n for _, n in unique]) if found else np.zeros(0, np.int64)) > 1
            row = np.repeat(np.array([i for i, _ in found], dtype=np.int64), [len(x) for x, _ in unique])
            # Rows of one anchor in a row: how often it was seen before, and each row's place among them.
            order = np.argsort(flat, kind="stable")
            held = flat[order]
            new = np.append(True, held[1:] != held[:-1])[: len(held)]
            first = np.flatnonzero(new)
            count = np.diff(np.append(first, len(held)))
            slot = (held[first] >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
            before = np.where(slots[slot] == held[first], times[slot], 0)
            slots[slot], times[slot] = held[first], np.minimum(before + count, 2)
            nth, total = np.empty(len(held), dtype=np.int64), np.empty(len(held), dtype=np.int64)
            nth[order] = np.arange(len(held)) - np.repeat(first - before, count)
            total[order] = np.repeat(before + count, count)
            more = nth >= 2
            key = np.where(more, mix(row.astype(np.uint64) ^ flat, 11), flat)
            sure = (total > 1) | (again & ~np.bool_(across_documents))
            yield pa.RecordBatch.from_arrays([batch.column("oid").take(pa.array(row)), pa.array(flat.view(np.int64)), pa.array(key.view(np.int64)), pa.array(sure), pa.array(more)], names=["oid", "anchor", "key", "sure", "more"])

    rows = reps.select("oid", "text").mapInArrow(run, "oid long, anchor long, key long, sure boolean, more boolean")
    same = Window.partitionBy("key")
    several = F.min("oid").over(same) != F.max("oid").over(same) if across_documents else F.count("*").over(same) > 1
    return save(rows.withColumn("recurs", F.col("sure") | several).where("recurs").select("oid", "anchor", "more"))


def frequent(again: DataFrame) -> list[int]:
    """Anchors of which more than OFTEN rows and than a millionth of all were dealt out: a million at most."""
    least = max(OFTEN, again.count() // 1_000_000)
    return sorted(r["anchor"] for r in again.where("more").groupBy("anchor").count().where(F.col("count") > least).select("anchor").collect())


def seeded(reps: DataFrame, again: DataFrame) -> DataFrame:
    """oid, tid, text and seeds (the recurring anchors) of the documents that have any."""
    maybe, _ = parted(reps, again, ["oid"])
    return maybe.select(*ID, "text").join(again.groupBy("oid").agg(F.collect_list("anchor").alias("seeds")), "oid")


def values(column) -> list:
    """column.to_pylist(), for integers, lists of integers and bytes in a fraction of the time."""
    import numpy as np
    import pyarrow as pa

    kind, nulls = column.type, column.null_count
    if pa.types.is_integer(kind):
        out = column.fill_null(0).to_numpy().tolist() if nulls else column.to_numpy().tolist()
    elif pa.types.is_list(kind) and pa.types.is_integer(kind.value_type) and not nulls:
        flat, at = values(column.flatten()), column.offsets.to_numpy()
        at = (at - at[0]).tolist()
        return [flat[a:b] for a, b in zip(at, at[1:], strict=False)]
    elif pa.types.is_binary(kind) and len(column) and column.buffers()[2] is not None:
        at = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1]
        raw, at = memoryview(column.buffers()[2])[at[0] : at[-1]].tobytes(), (at - at[0]).tolist()
        out = [raw[a:b] for a, b in zip(at, at[1:], strict=False)]
    else:
        return column.to_pylist()
    if nulls:
        for i in np.flatnonzero(column.is_null().to_numpy(zero_copy_only=False)).tolist():
            out[i] = None
    return out


def grouped(batches, names: list[str], rows: int):
    """Lists of rows (tuples of these columns) of batches that are sorted by the first, of about ``rows``, never parting equals."""
    held: list[tuple] = []
    for batch in batches:
        held += zip(*(values(batch.column(c)) for c in names), strict=True)
        cut = len(held)
        while cut and held[cut - 1][0] == held[-1][0]:
            cut -= 1
        if cut >= rows:
            yield held[:cut]
            held = held[cut:]
    if held:
        yield held


def without(x: DataFrame, ranges: DataFrame, cut: Callable, columns: str) -> DataFrame:
    """row of every document with what cut(text, ranges) gives (a tuple for columns).

    ranges: oid, tid, start, end, any number for a document, overlapping or not.
    """
    grouped = save(ranges.groupBy(*ID).agg(F.collect_list(F.struct("start", "end")).alias("ranges")))
    maybe, never = parted(x, grouped)
    joined = maybe.join(grouped, ID, "left").select("row", "text", "ranges")
    joined = joined.unionByName(never.select("row", "text", F.array().cast(grouped.schema["ranges"].dataType).alias("ranges")))
    names = [c.split()[0] for c in columns.split(",")]
    row_type = joined.schema["row"].dataType.simpleString()
    schema = f"row {row_type}, {columns}"
    fields = list(to_arrow_schema(StructType.fromDDL(columns)))

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in sliced(batches, 256):
            out = []
            ranges = batch.column("ranges")
            ends = ranges.values.field("end").to_numpy(zero_copy_only=False)
            starts = ranges.values.field("start").to_numpy(zero_copy_only=False)
            at = ranges.offsets.to_numpy()
            for text, a, b in zip(batch.column("text").to_pylist(), at, at[1:], strict=False):
                out.append(cut(text, np.stack([starts[a:b], ends[a:b]], axis=1)))
            arrays = [pa.array(x, f.type) for x, f in zip(zip(*out, strict=True) if out else [[]] * len(fields), fields, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("row"), *arrays], names=["row", *names])

    return joined.mapInArrow(run, schema)


def merged(ranges, length: int):
    """Disjoint, ascending, not touching ranges that cover the same places below length."""
    import numpy as np

    if not len(ranges):
        return ranges.reshape(0, 2).astype(np.int64)
    change = np.zeros(length + 1, dtype=np.int64)
    np.add.at(change, np.minimum(ranges[:, 0], length), 1)
    np.add.at(change, np.minimum(ranges[:, 1], length), -1)
    inside = np.concatenate([[0], (np.cumsum(change)[:length] > 0).astype(np.int8), [0]])
    edges = np.flatnonzero(np.diff(inside))
    return edges.reshape(-1, 2)
