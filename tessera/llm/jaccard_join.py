"""N-gram Jaccard join: documents whose sets of word shingles are alike, and their groups.

Equal texts (words lower-cased in A-Z) are one class from the start.  A class is indexed under the rarest
shingles of its set (a prefix long enough that two similar sets share one), and classes that meet there are
candidates if their lengths, the places where they meet and how their shingles spread over ranges of hashes
(a suffix filter) allow the similarity.  A candidate pair is verified once, word by word on both texts: hashes
find candidates, they decide nothing.

Groups need no pair within what is already connected.  In each bucket of the index first only neighbours in two
orders are verified; a bucket whose classes are all connected then is done.  In what is left, every class
outside the bucket's largest group is a candidate with all classes of other groups, so every link between groups
is found.  Buckets that are expected to be large are split for the first step, and joined whole in the second.

A text with fewer words than a shingle is one shingle; null text and text without words have an empty set,
linked with nothing.  Repeated rows are rows of one class.  An empty table has an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import tidy
from .common import components, save, sliced
from .rolling import blocks, mix, windows, word_hashes

#: Counters of the frequency sketch (2**SKETCH_BITS of 4 bytes: what is broadcast), in blocks.
SKETCH_BITS, SKETCH_BLOCK = 20, 4_096
#: Bits of the map of indexed classes (2**MAP_BITS / 8 bytes: what is broadcast).  Beyond what it tells apart, texts
#: that are not needed are kept as well.
MAP_BITS = 26
#: Ranges of hashes (2**SPREAD_BITS) in which a set's shingles are counted.
SPREAD_BITS = 7
#: A bucket expected to hold more than both of these (classes; share of all documents) is split.
SPLIT_ROWS, SPLIT_SHARE = 10_000, 1 / 256


def normal(texts: list[str | None]) -> list[bytes]:
    """Words lower-cased in A-Z, joined by a space."""
    return [b" ".join((t or "").encode().lower().split()) for t in texts]


def class_key(text: bytes) -> bytes | None:
    """128 bits that stand for a normal text."""
    import hashlib

    return hashlib.blake2b(text, digest_size=16).digest() if text else None


def shingle_sets(texts: list[bytes], size: int):
    """The sorted distinct shingle hashes of each normal text."""
    import numpy as np

    for lo, hi in blocks(texts):
        hashes, at = word_hashes(texts[lo:hi])
        for a, b in zip(at, at[1:], strict=False):
            own = hashes[a:b]
            if 0 < len(own) < size:
                yield mix(windows(own, len(own)), len(own))
            else:
                yield np.unique(windows(own, size))


def alike(x: bytes, y: bytes, size: int, percent: int) -> bool:
    """Whether the shingle sets of two normal texts are similar, by their words."""
    import numpy as np

    x, y = x.split(), y.split()
    if min(len(x), len(y)) < size:
        return x == y
    number = {w: i for i, w in enumerate(dict.fromkeys(x + y))}
    word = np.fromiter(map(number.__getitem__, x + y), np.int64, len(x) + len(y))
    # The number of each run of words: of runs one shorter and the next word; renumbered where it would overflow.
    code, most = word, len(number)
    for k in range(1, size):
        if most * len(number) >= 2**62:
            _, code = np.unique(code, return_inverse=True)
            most = int(code.max()) + 1
        code, most = code[:-1] * len(number) + word[k:], most * len(number)
    a, b = np.unique(code[: len(x) - size + 1]), np.unique(code[len(x) :])
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common >= percent * (len(a) + len(b) - common)


def least_common(percent: int, a: Column, b: Column) -> Column:
    """How many shingles sets of these sizes must share: the least i with 100 * i >= percent * (a + b - i)."""
    return F.ceil((a + b) * percent / F.lit(100 + percent) - 1e-9)


def facts_and_sketch(docs: DataFrame, size: int, digest: bool = False) -> DataFrame:
    """Rows of documents (doc_id, n, key, and digest of the text if asked for), and of the sketch (block, counts): in how many documents shingles of a slot are."""
    more = ["digest"] if digest else []

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import zstandard

        slots = np.zeros(1 << SKETCH_BITS, dtype=np.uint32)
        names = ["doc_id", "n", "key", "block", "counts", *more]
        for batch in sliced(batches):
            texts = normal(batch.column("text").to_pylist())
            n = []
            for s in shingle_sets(texts, size):
                n.append(len(s))
                np.add.at(slots, s >> np.uint64(64 - SKETCH_BITS), np.uint32(1))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(map(class_key, texts), pa.binary()), pa.nulls(len(n), pa.int32()), pa.nulls(len(n), pa.binary()), *(batch.column(c) for c in more)], names=names)
        k = len(slots) // SKETCH_BLOCK
        parts = [zstandard.compress(x.tobytes(), 1) for x in slots.reshape(k, -1)]
        yield pa.RecordBatch.from_arrays([pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.binary()), pa.array(range(k), pa.int32()), pa.array(parts, pa.binary()), *(pa.nulls(k, pa.binary()) for _ in more)], names=names)

    columns = [F.col("doc_id").cast("long"), "text", *(text_digest().alias(c) for c in more)]
    return save(docs.select(*columns).mapInArrow(run, "doc_id long, n long, key binary, block int, counts binary" + ", digest binary" * digest))


def text_digest() -> Column:
    """128 bits that stand for the column text."""
    return F.unhex(F.md5("text"))


def joined_blocks(rows: DataFrame, kind: str, how: str) -> dict[int, bytes]:
    """The blocks of compressed numbers in rows(block, counts), added up or or-ed: as many as there are blocks, whatever the size of the corpus."""

    def merge(batches):
        import numpy as np
        import pandas as pd
        import zstandard

        merged: dict = {}
        for rows in batches:
            for block, counts in zip(rows["block"], rows["counts"], strict=True):
                own = np.frombuffer(zstandard.decompress(counts), dtype=kind)
                merged[block] = getattr(np, how)(merged[block], own) if block in merged else own
        yield pd.DataFrame({"block": list(merged), "counts": [x.tobytes() for x in merged.values()]})

    return {r["block"]: bytes(r["counts"]) for r in rows.repartition(8, "block").mapInPandas(merge, "block int, counts binary").collect()}


def sketch_of(rows: DataFrame):
    """The summed sketch: 2**SKETCH_BITS numbers."""
    import numpy as np

    found = joined_blocks(rows.where(F.col("block").isNotNull()).select("block", "counts"), "<u4", "add")
    none = bytes(4 * SKETCH_BLOCK)
    return np.frombuffer(b"".join(found.get(k, none) for k in range((1 << SKETCH_BITS) // SKETCH_BLOCK)), dtype=np.uint32)


def indexed(docs: DataFrame, sketch, n_docs: int, size: int, percent: int) -> DataFrame:
    """(token, part, key, n, place) for the prefix of each class; a class may come from several tasks.

    part is the token, or for a bucket that may be large one of its parts.
    """
    sent = docs.sparkSession.sparkContext.broadcast(sketch)
    most = max(SPLIT_ROWS, int(n_docs * SPLIT_SHARE))

    def run(batches):
        import numpy as np
        import pyarrow as pa

        seen, counts = set(), sent.value
        for batch in sliced(batches):
            out = []
            texts = normal(batch.column("text").to_pylist())
            for text, s in zip(texts, shingle_sets(texts, size), strict=True):
                key = class_key(text)
                if key is None or key in seen:
                    continue
                seen.add(key)
                n = len(s)
                first = n - (percent * n + 99) // 100 + 1
                often = counts[s >> np.uint64(64 - SKETCH_BITS)]
                order = np.lexsort((s, often))[:first]
                token = s[order]
                salt = int.from_bytes(key[:8], "little") % (often[order].astype(np.uint64) // np.uint64(most) + np.uint64(1))
                out.append((token, np.where(often[order] < most, token, mix(token + salt, 8)), key, n, first))
            lengths = [x[4] for x in out]
            none = np.zeros(0, np.uint64)
            tokens, parts = (np.concatenate([x[k] for x in out]) if out else none for k in (0, 1))
            keys = pa.array([x[2] for x in out], pa.binary()).take(pa.array(np.repeat(np.arange(len(out)), lengths)))
            sizes = np.repeat(np.array([x[3] for x in out], dtype=np.int32), lengths)
            places = np.concatenate([np.arange(x, dtype=np.int32) for x in lengths]) if out else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(tokens.view(np.int64)), pa.array(parts.view(np.int64)), keys, pa.array(sizes, pa.int32()), pa.array(places, pa.int32())], names=["token", "part", "key", "n", "place"])

    rows = docs.select("text").mapInArrow(run, "token long, part long, key binary, n int, place int")
    # Buckets of two classes and more; of those, rows whose nearest neighbour by size is near enough.  All rows of split buckets.
    by_part = Window.partitionBy("part")
    by_size = by_part.orderBy("n", "key")
    near = (100 * F.lag("n").over(by_size) >= percent * F.col("n")) | (100 * F.col("n") >= percent * F.lead("n").over(by_size))
    several = F.min("key").over(by_part) != F.max("key").over(by_part)
    kept = rows.withColumn("kept", (F.col("part") != F.col("token")) | (several & near)).where("kept").drop("kept")
    out = save(kept.distinct())
    sent.destroy()
    return out


def texts_of(docs: DataFrame, index: DataFrame, size: int) -> DataFrame:
    """key, spread and packed (the compressed normal text) of the classes in the index, and maybe of others."""

    def mark(batches):
        import numpy as np
        import pyarrow as pa
        import zstandard

        bits = np.zeros((1 << MAP_BITS) // 8, dtype=np.uint8)
        for batch in batches:
            at = map_place(b"".join(batch.column("key").to_pylist()))
            np.bitwise_or.at(bits, at >> 3, np.left_shift(1, at & 7).astype(np.uint8))
        parts = bits.reshape(-1, 1 << 17)
        used = np.flatnonzero(parts.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([zstandard.compress(parts[k].tobytes(), 1) for k in used], pa.binary())], names=["block", "counts"])

    found = joined_blocks(index.select("key").mapInArrow(mark, "block int, counts binary"), "u1", "bitwise_or")
    sent = docs.sparkSession.sparkContext.broadcast(found)

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import zstandard

        seen, pack = set(), zstandard.ZstdCompressor(level=1)
        maps = {k: np.frombuffer(x, dtype=np.uint8) for k, x in sent.value.items()}
        for batch in sliced(batches):
            keys, texts = [], []
            for text in normal(batch.column("text").to_pylist()):
                key = class_key(text)
                if key is None or key in seen:
                    continue
                at = int(map_place(key)[0])
                own = maps.get(at >> 20)
                if own is not None and own[(at >> 3) & (1 << 17) - 1] >> (at & 7) & 1:
                    seen.add(key)
                    keys.append(key)
                    texts.append(text)
            spreads = [np.bincount(s >> np.uint64(64 - SPREAD_BITS), minlength=1 << SPREAD_BITS) for s in shingle_sets(texts, size)]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(spreads, pa.list_(pa.int32())), pa.array(map(pack.compress, texts), pa.binary())], names=["key", "spread", "packed"])

    rows = docs.select("text").mapInArrow(run, "key binary, spread array<int>, packed binary")
    out = save(rows.groupBy("key").agg(F.first("spread").alias("spread"), F.first("packed").alias("packed")))
    sent.destroy()
    return out


def map_place(keys: bytes):
    """The bit in the map of each key."""
    import numpy as np

    return (np.frombuffer(keys, dtype="<u8")[::2] >> np.uint64(64 - MAP_BITS)).astype(np.int64)


def allowed(percent: int) -> Column:
    """Length and positional filter on columns n, place of two rows a and b of one bucket."""
    n, m = F.col("a.n"), F.col("b.n")
    long_enough = (100 * n >= percent * m) & (100 * m >= percent * n)
    return long_enough & (F.least(n - F.col("a.place"), m - F.col("b.place")) >= least_common(percent, n, m))


def spread_allows(percent: int, x: Column, y: Column) -> Column:
    """Suffix filter without sets: how many shingles lie in each range of hashes bounds what is common in it."""
    total = lambda s: F.aggregate(s, F.lit(0), lambda a, b: a + b)
    return total(F.zip_with(x, y, lambda a, b: F.least(a, b))) >= least_common(percent, total(x), total(y))


def verified(pairs: DataFrame, texts: DataFrame, size: int, percent: int, *more: str) -> DataFrame:
    """The pairs (a, b) of keys whose texts are similar, with what else is asked for."""

    def run(batches):
        import pyarrow as pa
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        for batch in sliced(batches):
            keep = [alike(unpack(x), unpack(y), size, percent) for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("a", "b", *more)], names=["a", "b", *more]).filter(pa.array(keep, pa.bool_()))

    joined = pairs.join(texts.select(F.col("key").alias("a"), F.col("packed").alias("x")), "a").join(texts.select(F.col("key").alias("b"), F.col("packed").alias("y")), "b")
    return save(joined.select("a", "b", *more, "x", "y").mapInArrow(run, ", ".join(f"{c} binary" for c in ("a", "b", *more))))


def neighbours(index: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b): in each part of a bucket a class with the one before it and the first by size, and with the three before it in an order by hash."""
    by_part = Window.partitionBy("part")
    by_size, by_hash = by_part.orderBy("n", "key"), by_part.orderBy(F.xxhash64("key", F.pmod("token", F.lit(4))), "key")
    me = F.struct("key", "n", "place", "token")
    others = [F.lag(me).over(by_size), F.first(me).over(by_size), *(F.lag(me, k).over(by_hash) for k in (1, 2, 3))]
    near = index.select(me.alias("a"), F.array(*others).alias("others")).select("a", F.explode("others").alias("b"))
    near = near.where(F.col("b").isNotNull() & (F.col("a.key") != F.col("b.key")) & (F.col("a.token") == F.col("b.token")) & allowed(percent))
    return near.select(F.least("a.key", "b.key").alias("a"), F.greatest("a.key", "b.key").alias("b")).distinct()


def open_buckets(index: DataFrame, groups: DataFrame) -> DataFrame:
    """The rows of buckets that hold classes of several groups, with their group, and ``main``, the group that has most of the bucket."""
    x = index.drop("part").join(groups.withColumnRenamed("node", "key"), "key", "left").withColumn("group", F.coalesce("component", "key")).drop("component")
    counts = x.groupBy("token", "group").agg(F.count("*").alias("count"))
    main = counts.groupBy("token").agg(F.count("*").alias("several"), F.max_by("group", F.struct("count", "group")).alias("main")).where("several > 1")
    return x.join(main.drop("several"), "token")


def left_over(index: DataFrame, groups: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) with their groups (ga, gb) of classes that share a bucket and are not connected."""
    # A pair is made at the first token it shares: not where one of the three before is shared as well.
    earlier = Window.partitionBy("key").orderBy("place")
    x = open_buckets(index, groups)
    x = x.withColumn("before", F.array_compact(F.array(*[F.lag("token", k).over(earlier) for k in (1, 2, 3)])))
    x = save(x.join(texts.select("key", "spread"), "key"))
    apart = F.col("a.group") != F.col("b.group")
    once = (F.col("b.group") == F.col("b.main")) | (F.col("a.key") < F.col("b.key"))
    both = x.where(F.col("group") != F.col("main")).alias("a").join(
        x.alias("b"),
        (F.col("a.token") == F.col("b.token")) & apart & once & allowed(percent) & ~F.arrays_overlap("a.before", "b.before") & spread_allows(percent, F.col("a.spread"), F.col("b.spread")),
    )
    swap = F.col("a.key") > F.col("b.key")
    one, other = F.struct("a.key", "a.group"), F.struct("b.key", "b.group")
    ordered = both.select(F.when(swap, other).otherwise(one).alias("x"), F.when(swap, one).otherwise(other).alias("y"))
    return ordered.select(F.col("x.key").alias("a"), F.col("y.key").alias("b"), F.col("x.group").alias("ga"), F.col("y.group").alias("gb")).distinct()


@tidy
def class_groups(index: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """(node, component) of the classes that are linked with others."""
    pairs = neighbours(index, percent)
    for side in ("a", "b"):
        pairs = pairs.join(texts.select(F.col("key").alias(side), F.col("spread").alias(f"of_{side}")), side)
    tried = save(pairs.where(spread_allows(percent, F.col("of_a"), F.col("of_b"))).select("a", "b"))
    groups = save(components(verified(tried, texts, size, percent)))
    rest = save(left_over(index, groups, texts, percent).join(tried, ["a", "b"], "left_anti"))
    links = verified(rest, texts, size, percent, "ga", "gb").select(F.col("ga").alias("a"), F.col("gb").alias("b")).distinct()
    # Links between groups contract them; a group may be a class that had none before.
    wider = save(components(links)).select(F.col("node").alias("component"), F.col("component").alias("wider"))
    within = groups.join(wider, "component", "left").select("node", F.coalesce("wider", "component").alias("component"))
    alone = wider.join(groups.select("component").distinct(), "component", "left_anti").select(F.col("component").alias("node"), F.col("wider").alias("component"))
    return within.unionByName(alone)


@tidy
def jaccard_groups(docs: DataFrame, size: int = 5, percent: int = 80, digest: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable by links) for every document, and text_digest() if asked for."""
    docs = docs.select("doc_id", "text")
    rows, more = facts_and_sketch(docs, size, digest), ["digest"] if digest else []
    facts = rows.where(F.col("block").isNull()).select("doc_id", F.col("n").alias("n_shingles"), "key", *more)
    index = indexed(docs, sketch_of(rows), facts.count(), size, percent)
    groups = class_groups(index, texts_of(docs, index, size), size, percent)

    classes = facts.where(F.col("key").isNotNull()).groupBy("key").agg(F.min("doc_id").alias("first"))
    named = save(classes.join(groups.withColumnRenamed("node", "key"), "key", "left"))
    smallest = named.where(F.col("component").isNotNull()).groupBy("component").agg(F.min("first").alias("smallest"))
    labels = named.join(smallest, "component", "left").select("key", F.coalesce("smallest", "first").alias("component_id"))
    out = facts.join(labels, "key", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), *more)


@tidy
def first_of_groups(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """docs' columns: of each group the row with the smallest doc_id, of equal rows one.  Rows without words stay.

    A doc_id may stand for several texts, each of which stays or goes by its own group.
    """
    groups = save(jaccard_groups(docs, size, percent, digest=True))
    later = groups.where(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("later"), "digest").distinct()
    others = F.struct(*[c for c in docs.columns if c not in ("doc_id", "text")])
    rest = docs.select("doc_id", "text", others.alias("row")).join(later, (F.col("doc_id") == F.col("later")) & (text_digest() == later["digest"]), "left_anti")
    rest = rest.groupBy("doc_id", "text").agg(F.first("row").alias("row"))
    return rest.select(*[F.col(c) if c in ("doc_id", "text") else F.col("row").getField(c).alias(c) for c in docs.columns])
