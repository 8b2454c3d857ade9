"""Exact top-k by inner product over KD-trees, one for each shard.

Vectors become integers, floor(1024 * x).  A shard's tree splits at medians of the widest dimension down
to leaves; every node has its tight bounding box.  A query visits nodes best first by the bound
sum(max(q * low, q * high)) and stops when the next bound is below its kth score.  Queries first search
one shard; the kth score found there goes along to all others, where it prunes from the start.  Bounds
equal to the kth score are followed, so ties to the smaller id are exact.

Vectors that are null or hold null or non-finite components, and rows without an id, take no part.
Vectors of different lengths are not compared.  A query has no candidate with its own id; repeated rows
are candidates each; queries equal in id and vector are one query, those equal in id alone have a list each.  Scores beyond a long's range are cut to it.  An empty table has an empty result.
"""

from __future__ import annotations

import heapq
import math
import pickle

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import tidy
from .common import save

SCALE = 1024
#: A shard's vectors and numbers, a block's queries, a leaf's vectors, the blocks that a task takes past one tree.
SHARD_ROWS, SHARD_NUMBERS, BLOCK_ROWS, LEAF_ROWS, BLOCKS_A_TASK = 8_192, 1 << 21, 1_024, 128, 32
FOUND = "query_id long, uid long, vec_id long, score long"


def product(a, b):
    """Integer matrix product of float64 arrays of whole numbers, exact, cut to the range of a long."""
    import numpy as np

    most = (float(np.abs(a).max()) if a.size else 0.0) * (float(np.abs(b).max()) if b.size else 0.0) * a.shape[-1]
    if most < 2**53:
        return (a @ b.T).astype(np.int64)
    whole = lambda x: np.array([[int(v) for v in row] for row in x], dtype=object).reshape(x.shape)
    return np.clip(whole(a) @ whole(b).T, -(2**63), 2**63 - 1).astype(np.int64)


def build(ids, vectors, leaf_rows: int = LEAF_ROWS) -> dict:
    """A tree as arrays: rows in leaf order; of each node its box, children (or -1) and rows."""
    import numpy as np

    order, nodes = np.arange(len(ids)), []

    def grow(lo: int, hi: int) -> int:
        own = vectors[order[lo:hi]]
        low, high = own.min(axis=0), own.max(axis=0)
        me = len(nodes)
        nodes.append([low, high, -1, -1, lo, hi])
        widest = int(np.argmax(high - low)) if len(low) else -1
        if hi - lo > leaf_rows and widest >= 0 and high[widest] > low[widest]:
            mid = (hi - lo) // 2
            order[lo:hi] = order[lo:hi][np.argpartition(own[:, widest], mid)]
            nodes[me][2], nodes[me][3] = grow(lo, lo + mid), grow(lo + mid, hi)
        return me

    grow(0, len(ids))
    low, high, left, right, lo, hi = zip(*nodes, strict=True)
    return {"ids": ids[order], "vectors": vectors[order], "low": np.stack(low), "high": np.stack(high), "left": left, "right": right, "lo": lo, "hi": hi}


def search(tree: dict, query_ids, queries, kth, k: int) -> list[list[tuple[int, int]]]:
    """For each query up to k best (score, id) in the tree, of those scoring at least kth (None: any), best first."""
    import numpy as np

    out = []
    bounds = np.maximum(queries, 0) @ tree["high"].T + np.minimum(queries, 0) @ tree["low"].T
    slack = np.abs(queries) @ np.maximum(np.abs(tree["high"]), np.abs(tree["low"])).T * 1e-12  # for bounds past 2**53
    bounds = bounds + slack
    most = float(np.abs(queries).max(initial=0)) * float(max(np.abs(tree["high"]).max(initial=0), np.abs(tree["low"]).max(initial=0))) * max(queries.shape[1], 1)
    exact = (lambda q, v: (v @ q).astype(np.int64)) if most < 2**53 else (lambda q, v: product(q[None], v)[0])
    for i, query in enumerate(query_ids):
        best: list[tuple[int, int]] = []  # a heap of (score, -id): the worst first
        floor = -math.inf if kth[i] is None else kth[i]
        open_nodes = [(-bounds[i, 0], 0)]
        while open_nodes:
            bound, node = heapq.heappop(open_nodes)
            if -bound < (max(floor, best[0][0]) if len(best) == k else floor):
                break
            if tree["left"][node] >= 0:
                for child in (tree["left"][node], tree["right"][node]):
                    heapq.heappush(open_nodes, (-bounds[i, child], child))
                continue
            rows = slice(tree["lo"][node], tree["hi"][node])
            scores, ids = exact(queries[i], tree["vectors"][rows]), tree["ids"][rows]
            least = max(floor, best[0][0]) if len(best) == k else floor
            for j in np.flatnonzero((scores >= least) & (ids != query)):
                item = (int(scores[j]), -int(ids[j]))
                if len(best) < k:
                    heapq.heappush(best, item)
                elif item > best[0]:
                    heapq.heapreplace(best, item)
        out.append([(s, -v) for s, v in sorted(best, reverse=True)])
    return out


def usable(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id and vector (doubles that are whole numbers) of rows that take part."""
    vector = F.col(vector_col).cast("array<double>")
    rows = rows.select(F.col(id_col).cast("long").alias("id"), vector.alias("v"))
    rows = rows.where(F.col("id").isNotNull() & F.col("v").isNotNull())
    rows = rows.where(F.forall("v", lambda x: F.coalesce((x > float("-inf")) & (x < float("inf")), F.lit(False))))
    return rows.withColumn("d", F.size("v"))


def integers(vectors, rows: int):
    import numpy as np

    return np.floor(SCALE * np.array(vectors.tolist(), dtype=np.float64).reshape(rows, -1))


def met(trees: DataFrame, blocks: DataFrame, n_blocks: int, k: int) -> DataFrame:
    """The blocks of queries (shard, d, block, queries) searched in the trees of their shards: rows of FOUND, and each block again, armed with its kth scores.

    A task takes the blocks of one shard, or where there are many some of them.  The tree comes before them, and is
    loaded once.
    """
    parts = max(1, math.ceil(n_blocks / BLOCKS_A_TASK))
    rows = trees.select("shard", "d", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.lit(-1).cast("long").alias("block"), F.col("tree").alias("content"))
    rows = rows.unionByName(blocks.select("shard", "d", F.pmod("block", F.lit(parts)).cast("int").alias("part"), "block", F.col("queries").alias("content")))

    def visit(batches):
        import pyarrow as pa

        place, tree = None, None
        for batch in batches:
            for row in zip(*(batch.column(c) for c in ("shard", "d", "part", "block", "content")), strict=True):
                shard, d, part, block = (x.as_py() for x in row[:4])
                content = pickle.loads(row[4].as_buffer())
                if block < 0:
                    place, tree = (shard, d, part), content
                    continue
                ids, uids, v, kth = content
                found = search(tree, ids, v, kth, k) if place == (shard, d, part) else [[] for _ in ids]
                flat = [(int(q), int(u), vec, score) for q, u, best in zip(ids, uids, found, strict=True) for score, vec in best]
                armed = pickle.dumps((ids, uids, v, [best[-1][0] if len(best) == k else old for best, old in zip(found, kth, strict=True)]))
                columns = list(zip(*flat, strict=True)) if flat else [[]] * 4
                n = len(flat)
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array([*c, None], pa.int64()) for c in columns), pa.array([None] * n + [shard], pa.int32()), pa.array([None] * n + [d], pa.int32()), pa.array([None] * n + [block], pa.int64()), pa.array([None] * n + [armed], pa.binary())],
                    names=["query_id", "uid", "vec_id", "score", "home", "d", "block", "queries"],
                )

    return rows.repartition("shard", "part").sortWithinPartitions("shard", "d", "part", "block").mapInArrow(visit, f"{FOUND}, home int, d int, block long, queries binary")


@tidy
def topk(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding", shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: the k vectors with the highest inner product for each query."""
    points = usable(vectors, id_col, vector_col)
    size = points.agg(F.count("*").alias("rows"), F.sum("d").alias("numbers")).first()
    n_shards = max(1, math.ceil(size["rows"] / shard_rows), math.ceil((size["numbers"] or 0) / SHARD_NUMBERS))
    # Salted by row, so that repeated ids spread as well.
    points = points.withColumn("shard", F.pmod(F.xxhash64("id", F.monotonically_increasing_id()), F.lit(n_shards)).cast("int"))

    def plant(rows):
        import numpy as np
        import pandas as pd

        tree = build(rows["id"].to_numpy(np.int64), integers(rows["v"], len(rows)))
        return pd.DataFrame({"shard": [int(rows["shard"].iloc[0])], "d": [int(rows["d"].iloc[0])], "tree": [pickle.dumps(tree)]})

    trees = save(points.groupBy("shard", "d").applyInPandas(plant, "shard int, d int, tree binary"))

    asked = save(usable(queries, id_col, vector_col).distinct().withColumn("uid", F.monotonically_increasing_id()))
    n_asked = asked.count()
    n_blocks = max(n_shards, math.ceil(n_asked / block_rows))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("id", "uid"), F.lit(n_blocks)))

    def gather(rows):
        import numpy as np
        import pandas as pd

        content = rows["id"].to_numpy(np.int64), rows["uid"].to_numpy(np.int64), integers(rows["v"], len(rows)), [None] * len(rows)
        return pd.DataFrame({"block": [int(rows["block"].iloc[0])], "d": [int(rows["d"].iloc[0])], "queries": [pickle.dumps(content)]})

    blocks = asked.groupBy("block", "d").applyInPandas(gather, "block long, d int, queries binary")
    # Each block of queries is searched in one shard first; its kth scores go along to all others.
    first = save(met(trees, blocks.withColumn("shard", F.pmod("block", F.lit(n_shards)).cast("int")), math.ceil(n_blocks / n_shards), k))
    found = first.where(F.col("queries").isNull()).select("query_id", "uid", "vec_id", "score")
    if n_shards > 1:
        armed = first.where(F.col("queries").isNotNull()).select("home", "d", "block", "queries", F.explode(F.sequence(F.lit(0), F.lit(n_shards - 1))).alias("shard")).where("shard <> home")
        rest = met(trees, armed, n_blocks, k).where(F.col("queries").isNull())
        found = found.unionByName(rest.select("query_id", "uid", "vec_id", "score"))
    best = Window.partitionBy("query_id", "uid").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
