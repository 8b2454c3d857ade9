"""Byte-level BPE encoding and decoding with the ranks of a public tokenizer.

Long texts are cut into overlapping chunks that are pre-tokenised in parallel.  Two neighbours are
stitched at the first pre-token boundary of their overlap on which both agree: from there on they would
match alike.  The pieces between stitches are encoded in parallel and their ids joined in order.  A text
whose chunks never agree (a pre-token longer than the overlap) is encoded as one piece.  Decoding
concatenates the bytes of the ids.

Null or empty text has no ids and decodes to no bytes.  Repeated rows give repeated results; an empty
table an empty one.
"""

from __future__ import annotations

import base64
import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sliced, worker_cache

CHUNK, OVERLAP = 65_536, 1_024


class Codec:
    """tiktoken by a rank file's bytes; cheap to send, built once in each Python worker."""

    def __init__(self, rank_file: bytes, pattern: str):
        self.rank_file, self.pattern = rank_file, pattern
        self.name = hashlib.sha256(rank_file + pattern.encode()).hexdigest()

    @classmethod
    def from_path(cls, path: str, pattern: str) -> Codec:
        with open(path, "rb") as f:
            return cls(f.read(), pattern)

    def encoding(self):
        cache = worker_cache()
        if self.name not in cache:
            import tiktoken

            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, self.rank_file.splitlines()) if a}
            cache[self.name] = tiktoken.Encoding("own", pat_str=self.pattern, mergeable_ranks=ranks, special_tokens={})
        return cache[self.name]

    def boundaries(self, text: str) -> list[int]:
        """Where pre-tokens start; the text's end is not among them."""
        import regex

        cache = worker_cache()
        key = "pattern" + self.pattern
        if key not in cache:
            cache[key] = regex.compile(self.pattern)
        return [m.start() for m in cache[key].finditer(text)]


def _encoder(codec: Codec, text_column: str):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        encoding = codec.encoding()
        for batch in sliced(batches):
            ids = [encoding.encode_to_numpy(x or "") for x in batch.column(batch.schema.get_field_index(text_column)).to_pylist()]
            offsets = np.zeros(len(ids) + 1, dtype=np.int32)
            np.cumsum([len(x) for x in ids], out=offsets[1:])
            flat = np.concatenate(ids).astype(np.int32) if ids else np.zeros(0, np.int32)
            kept = [(name, batch.column(i)) for i, name in enumerate(batch.schema.names) if name != text_column]
            yield pa.RecordBatch.from_arrays([*(x for _, x in kept), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=[*(n for n, _ in kept), "ids"])

    return run


def _pretokeniser(codec: Codec, chunk: int, overlap: int):
    def run(batches):
        import pyarrow as pa

        for batch in sliced(batches):
            heads, tails = [], []
            for text, last in zip(batch.column("text").to_pylist(), batch.column("last").to_pylist(), strict=True):
                at = codec.boundaries(text)
                heads.append([x for x in at if x < overlap])
                tails.append([] if last else [x - chunk for x in at if x >= chunk])
            ints = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(heads, ints), pa.array(tails, ints)], names=[*batch.schema.names, "head", "tail"])

    return run


def encode(docs: DataFrame, codec: Codec, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """docs' columns but the text, with ``ids``, the array of token ids."""
    others = [c for c in docs.columns if c != "text"]
    x = docs.select(F.struct(*others).alias("row"), F.coalesce("text", F.lit("")).alias("text"))
    row_type = x.schema["row"].dataType.simpleString()
    short = x.where(F.length("text") <= chunk).mapInArrow(_encoder(codec, "text"), f"row {row_type}, ids array<int>")

    long = x.where(F.length("text") > chunk).withColumn("uid", F.monotonically_increasing_id())
    count = F.ceil(F.length("text") / chunk).cast("int")
    chunks = long.select("uid", "row", "text", count.alias("n"), F.explode(F.sequence(F.lit(0), count - 1)).alias("k"))
    chunks = chunks.select("uid", F.when(F.col("k") == 0, F.col("row")).alias("row"), "k", (F.col("k") == F.col("n") - 1).alias("last"), F.substring("text", F.col("k") * chunk + 1, F.lit(chunk + overlap)).alias("text"))
    chunks = chunks.repartition("uid", "k")
    marked = chunks.mapInArrow(_pretokeniser(codec, chunk, overlap), f"uid long, row {row_type}, k int, last boolean, text string, head array<int>, tail array<int>")
    # One group is one document, which was one row before.
    whole = marked.groupBy("uid").agg(F.sort_array(F.collect_list(F.struct("k", "text", "head", "tail"))).alias("c"), F.first("row", ignorenulls=True).alias("row"))
    ends = F.transform("c", lambda c, k: F.when(k == F.size("c") - 1, F.length(c["text"])).otherwise(F.get(F.array_intersect(c["tail"], F.get("c", k + 1)["head"]), F.lit(0)) + chunk))
    whole = whole.select("uid", "row", "c", ends.alias("ends"))
    pieces = F.transform("c", lambda c, k: F.substring(c["text"], F.when(k == 0, F.lit(0)).otherwise(F.get("ends", k - 1) - chunk) + 1, F.get("ends", k) - F.when(k == 0, F.lit(0)).otherwise(F.get("ends", k - 1) - chunk)))
    one = F.array(F.array_join(F.transform("c", lambda c: F.substring(c["text"], F.lit(1), F.lit(chunk))), ""))
    whole = whole.select("uid", "row", F.when(F.exists("ends", lambda e: e.isNull()), one).otherwise(pieces).alias("pieces"))
    parts = whole.select("uid", "row", F.posexplode("pieces").alias("k", "text")).select("uid", F.when(F.col("k") == 0, F.col("row")).alias("row"), "k", "text")
    coded = parts.repartition("uid", "k").mapInArrow(_encoder(codec, "text"), f"uid long, row {row_type}, k int, ids array<int>")
    joined = coded.groupBy("uid").agg(F.sort_array(F.collect_list(F.struct("k", "ids"))).alias("c"), F.first("row", ignorenulls=True).alias("row"))
    joined = joined.select("row", F.flatten(F.transform("c", lambda c: c["ids"])).alias("ids"))
    return short.unionByName(joined).select("row.*", "ids")


def decode(coded: DataFrame, codec: Codec) -> DataFrame:
    """coded's columns but ids, with ``decoded``, the bytes."""
    kept = [c for c in coded.columns if c != "ids"]

    def run(batches):
        import pyarrow as pa

        encoding = codec.encoding()
        for batch in sliced(batches):
            ids = batch.column(batch.schema.get_field_index("ids"))
            flat, offsets = ids.values.to_numpy(zero_copy_only=False), ids.offsets.to_numpy()
            decoded = [encoding.decode_bytes(flat[a:b].tolist()) for a, b in zip(offsets, offsets[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i, n in enumerate(batch.schema.names) if n != "ids"), pa.array(decoded, pa.binary())], names=[*(n for n in batch.schema.names if n != "ids"), "decoded"])

    schema = ", ".join(f"`{c}` {coded.schema[c].dataType.simpleString()}" for c in kept)
    return coded.mapInArrow(run, schema + ", decoded binary")


def digests(docs: DataFrame, codec: Codec) -> DataFrame:
    """doc_id, n_tokens and the digests of the ids and of the decoded bytes, for every document."""
    coded = encode(docs.select("doc_id", "text"), codec)
    ids_sha256 = F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256)
    coded = coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), ids_sha256.alias("ids_sha256"), "ids")
    return decode(coded, codec).select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))
