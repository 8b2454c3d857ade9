"""Language identification by prediction by partial matching.

For each language, the counts of bytes after contexts of 0 to ``order`` bytes form a context tree of
variable order (contexts exist where training text had them).  A byte seen n times after its longest
known context costs -log2(n / (total + distinct)); otherwise an escape, -log2(distinct / (total +
distinct)), and the same in the next shorter context, down to 1/256 for any byte.  A text's cost is the
exact code length of all its bytes under these frozen counts; the language with the shortest code wins,
ties to the smaller name, and the score is its posterior under equal priors.

Training takes, per language, at most ``train_rows`` rows with the smallest hash of the id (rows of one id by their
text), and of those as many whole texts as fit in ``train_bytes`` bytes: the two bounds on the sample.

Null text or text without a letter is ``und`` with score 0, as is every text if nothing was learned.
Repeated rows give repeated results; an empty table an empty one.
"""

from __future__ import annotations

import hashlib
import pickle

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import tidy
from .common import save, sliced, worker_cache

ORDER = 3
TRAIN_ROWS, TRAIN_BYTES = 400, 1_000_000
UNKNOWN = "und"
#: Language tables of up to this many rows are sent to all executors; larger ones are joined by shuffle.
BROADCAST_LANGS = 10_000
SLOT_BITS = 20
BLOCK = 1 << 20


def windows_of(texts: list[bytes]):
    """Each byte with the three before it, as 32-bit numbers (zeros before a text), and the texts' lengths."""
    import numpy as np

    pad = b"\0" * ORDER
    x = np.frombuffer(b"".join(pad + t for t in texts), dtype=np.uint8).astype(np.uint32)
    w = (x[:-3] << 24) | (x[1:-2] << 16) | (x[2:-1] << 8) | x[3:] if len(x) > ORDER else np.zeros(0, np.uint32)
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    ends = np.cumsum(lengths + ORDER)
    keep = np.ones(len(x), dtype=bool)
    for k in range(ORDER):
        keep[ends - lengths - ORDER + k] = False
    return w[keep[ORDER:]], lengths


class Tree:
    """The context tree of one language as sorted arrays, one per order."""

    def __init__(self, orders: list[tuple]):
        self.orders = orders

    @classmethod
    def of(cls, texts: list[bytes]) -> Tree:
        import numpy as np

        w, _ = windows_of(texts)
        orders = []
        for k in range(ORDER + 1):
            nodes, counts = np.unique(w & np.uint32((1 << 8 * (k + 1)) - 1) if k < 3 else w, return_counts=True)
            contexts, first = np.unique(nodes >> np.uint32(8), return_index=True)
            totals = np.add.reduceat(counts, first) if len(counts) else counts
            distinct = np.diff(np.append(first, len(nodes)))
            orders.append((nodes, counts.astype(np.float64), contexts, totals.astype(np.float64), distinct.astype(np.float64)))
        return cls(orders)

    def bits(self, w):
        """Code length of the last byte of each window."""
        import numpy as np

        out, open_ = np.zeros(len(w)), np.ones(len(w), dtype=bool)
        for k in range(ORDER, -1, -1):
            nodes, counts, contexts, totals, distinct = self.orders[k]
            if not len(nodes):
                continue
            node = w & np.uint32((1 << 8 * (k + 1)) - 1) if k < 3 else w
            at = np.minimum(np.searchsorted(contexts, node >> np.uint32(8)), len(contexts) - 1)
            known = open_ & (contexts[at] == node >> np.uint32(8))
            of = np.minimum(np.searchsorted(nodes, node), len(nodes) - 1)
            seen = known & (nodes[of] == node)
            whole = totals[at] + distinct[at]
            out[seen] -= np.log2(counts[of[seen]] / whole[seen])
            escaped = known & ~seen
            out[escaped] -= np.log2(distinct[at[escaped]] / whole[escaped])
            open_ &= ~seen
        out[open_] += 8
        return out


class Model:
    def __init__(self, trees: dict[str, Tree]):
        self.langs = sorted(trees)
        self.trees = [trees[x] for x in self.langs]

    def lengths(self, texts: list[bytes], table: dict):
        """Code lengths in bits, a row for each text and a column for each language.

        table: kept between calls; code lengths of windows in slots by hash.
        """
        import numpy as np

        if not table:
            table["key"] = np.zeros(1 << SLOT_BITS, dtype=np.uint32)
            table["full"] = np.zeros(1 << SLOT_BITS, dtype=bool)
            table["bits"] = np.zeros((1 << SLOT_BITS, len(self.langs)), dtype=np.float32)
        w, lengths = windows_of(texts)
        sums = np.zeros((len(texts), len(self.langs)))
        starts = np.cumsum(lengths) - lengths
        for lo in range(0, len(w), BLOCK):
            part = w[lo : lo + BLOCK]
            slot = (part * np.uint32(2654435761)) >> np.uint32(32 - SLOT_BITS)
            miss = ~(table["full"][slot] & (table["key"][slot] == part))
            bits = table["bits"][slot]
            if miss.any():
                new, back = np.unique(part[miss], return_inverse=True)
                costs = np.stack([t.bits(new) for t in self.trees], axis=1).astype(np.float32)
                bits[miss] = costs[back]
                into = (new * np.uint32(2654435761)) >> np.uint32(32 - SLOT_BITS)
                into, one = np.unique(into, return_index=True)
                table["key"][into], table["full"][into], table["bits"][into] = new[one], True, costs[one]
            # Sums over the stretches of this block that belong to one text each.
            first = max(int(np.searchsorted(starts, lo, side="right")) - 1, 0)
            last = int(np.searchsorted(starts, lo + len(part), side="left"))
            own = np.arange(first, last)
            own = own[lengths[own] > 0]
            if len(own):
                sums[own] += np.add.reduceat(bits, np.maximum(starts[own] - lo, 0), axis=0, dtype=np.float64)
        return sums


@tidy
def train(labelled: DataFrame, train_rows: int = TRAIN_ROWS, train_bytes: int = TRAIN_BYTES) -> Model:
    """A model of labelled(text, lang, order): one task learns a language from its bounded sample."""
    by_order = Window.partitionBy("lang").orderBy("order")
    labelled = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text", "order")
    ranked = lambda x: x.withColumn("rank", F.row_number().over(by_order)).where(F.col("rank") <= train_rows)
    # The sample's last hash is found without texts; then only the sample's texts are moved.
    last = save(ranked(labelled.select("lang", "order")).groupBy("lang").agg(F.max("order").alias("last")))
    last = F.broadcast(last) if last.count() <= BROADCAST_LANGS else last
    sample = ranked(labelled.join(last, "lang").where(F.col("order") <= F.col("last")).drop("last"))

    def learn(rows):
        import pandas as pd

        texts, left = [], train_bytes
        for text in rows.sort_values("rank")["text"]:
            raw = text.encode()
            if texts and len(raw) > left:
                continue
            texts.append(raw)
            left -= len(raw)
        return pd.DataFrame({"lang": [rows["lang"].iloc[0]], "tree": [pickle.dumps(Tree.of(texts).orders)]})

    learned = sample.groupBy("lang").applyInPandas(learn, "lang string, tree binary").collect()
    return Model({r["lang"]: Tree(pickle.loads(bytes(r["tree"]))) for r in learned})


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """docs' columns but the text, with lang_pred and score."""
    kept = [c for c in docs.columns if c != "text"]
    sent = docs.sparkSession.sparkContext.broadcast(pickle.dumps([(x, t.orders) for x, t in zip(model.langs, model.trees, strict=True)]))  # bounded by train_bytes for each language
    name = "ppm" + hashlib.sha256(sent.value).hexdigest()

    def run(batches):
        import numpy as np
        import pyarrow as pa

        cache = worker_cache()
        if name not in cache:
            for old in [k for k in cache if k.startswith("ppm")]:
                del cache[old]
            cache[name] = Model({x: Tree(orders) for x, orders in pickle.loads(sent.value)}), {}
        own, table = cache[name]
        for batch in sliced(batches):
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            found, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
            if own.langs:
                clear = [i for i, t in enumerate(texts) if t is not None and any(map(str.isalpha, t))]
                lo = 0
                while lo < len(clear):  # a few megabytes at a time
                    hi, size = lo, 0
                    while hi < len(clear) and (hi == lo or size + len(texts[clear[hi]]) < BLOCK):
                        size += len(texts[clear[hi]])
                        hi += 1
                    bits = own.lengths([texts[i].encode() for i in clear[lo:hi]], table)
                    best = bits.argmin(axis=1)
                    posterior = 1 / np.exp2(np.maximum(bits.min(axis=1, keepdims=True) - bits, -1000)).sum(axis=1)
                    for i, b, p in zip(clear[lo:hi], best, posterior, strict=True):
                        found[i], scores[i] = own.langs[b], float(p)
                    lo = hi
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in kept), pa.array(found, pa.string()), pa.array(scores, pa.float64())], names=[*kept, "lang_pred", "score"])

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept)
    return docs.mapInArrow(run, f"{schema}, lang_pred string, score double")


def held_out_predictions(docs: DataFrame, fold: int = 2, folds: int = 4) -> DataFrame:
    """doc_id, held_out, lang_pred, score: learned from documents outside the fold crc32(doc_id) mod folds, applied to all."""
    docs = docs.select("doc_id", "text", "lang")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == fold, F.lit(False))
    labelled = docs.where(~held_out).select("lang", "text", F.struct(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text")).alias("order"))
    return predict(docs.select("doc_id", held_out.alias("held_out"), "text"), train(labelled))
