"""Token-ID output: a content-addressed store of id streams.

A rolling hash over the ids cuts each document's stream into chunks, so equal passages give equal
chunks wherever they stand.  A chunk is kept once, under the digest of its ids, by the first document
(in id order) that has it; every document has a recipe, the list of its chunks' digests, and the Merkle
root of that list.  Each shard, a range of ascending document ids, ends in a manifest with its counts and
the Merkle root of its documents.  Reading rebuilds every stream from the recipes and fails if a digest
or a root differs.

Layout of a shard: rows in ascending doc_id (nulls first, ties in a fixed order), each with the chunks
it owns, one byte for the width of an id (2 or 4) and a zstd frame of little-endian unsigned ids (an empty document of
owned chunks has an empty frame); the
last row of a shard is its manifest.

Null or empty text is the end id alone.  Repeated rows share all chunks; an empty table is an empty store.
"""

from __future__ import annotations

import hashlib
import json
import zlib
from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..sources.scratch import tidy
from .common import save, sliced, worker_cache

#: Rolling window in ids, mean chunk length in ids (a power of 2), greatest chunk length.
ROLL, MEAN, MOST = 4, 256, 4_096

KEY, FAN = 16, 16
#: keys and lens are packed: KEY bytes and a little-endian unsigned 32-bit number for each chunk; marks has a
#: byte for each chunk, OWNED if the payload holds it, plus LENT if another place refers to it.
ROW = "uid long, doc_id long, kind string, shard int, start long, n_tokens long, keys binary, lens binary, marks binary, borrows boolean, lends boolean, root binary, payload binary"
OWNED, LENT = 1, 2
#: Chunks in more than OFTEN places, the COMMON most frequent, are sent to all executors: COMMON * MOST ids at most.
OFTEN, COMMON = 1_000, 1_000


#: Fixed by the byte-level format: what its pre-tokenizer matches.
BYTE_LEVEL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class Tokens:
    """Ids as the tokenizers library gives them for a byte-level BPE file, without added special tokens.

    The library itself encodes about 3 MB a second and core.  The same vocabulary run as ranks by tiktoken
    gives the same ids three times as fast, so it does the bulk; the library reads the file, encodes texts
    that hold a special token's string, and encodes one text of every batch, chosen by a hash, again: a difference is an
    error, as is a file whose settings or merges ranks can't stand for.
    """

    def __init__(self, json_file: str):
        self.json_file = json_file
        self.name = hashlib.sha256(json_file.encode()).hexdigest()

    @classmethod
    def from_path(cls, path: str) -> Tokens:
        with open(path, encoding="utf-8") as f:
            return cls(f.read())

    def engines(self) -> tuple:
        cache = worker_cache()
        if self.name not in cache:
            import os

            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            import tiktoken
            from tokenizers import Tokenizer, pre_tokenizers

            checked(json.loads(self.json_file))
            tokenizer = Tokenizer.from_str(self.json_file)
            added = {t.content for t in tokenizer.get_added_tokens_decoder().values()}
            byte_of = {c: b for b, c in enumerate(byte_letters(pre_tokenizers.ByteLevel.alphabet()))}
            ranks = {bytes(byte_of[c] for c in token): i for token, i in tokenizer.get_vocab(with_added_tokens=False).items() if token not in added}
            cache[self.name] = tokenizer, tiktoken.Encoding("own", pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens={}), sorted(added)
        return cache[self.name]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        import numpy as np

        tokenizer, ranks, special = self.engines()
        exact = lambda text: np.array(tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        out = [exact(x) if any(s in x for s in special) else ranks.encode_to_numpy(x).tobytes() for x in texts]
        if texts:
            k = zlib.crc32("".join(x[:16] for x in texts).encode()) % len(texts)
            if out[k] != exact(texts[k]):
                raise ValueError("the ranks do not encode as the tokenizers library does")
        return out


def checked(file: dict) -> None:
    """Fails unless merging by rank gives what the file's merges give, after the byte-level split."""
    split, model = file["pre_tokenizer"] or {}, file["model"]
    plain = file["normalizer"] is None and split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
    odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges") if model.get(k)]
    made = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
    if not plain or model["type"] != "BPE" or odd or any(a >= b for a, b in zip(made, made[1:], strict=False)):
        raise ValueError("the file's tokens can't be merged by rank")


def byte_letters(alphabet: list[str]) -> list[str]:
    """The letter that byte-level vocabularies write for each byte.

    Fixed by the format: printable bytes stand for themselves, the others for code points from 256 on, in order.
    """
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    letters = [chr(b) if b in plain else chr(next(others)) for b in range(256)]
    if set(letters) != set(alphabet):
        raise ValueError("not a byte-level alphabet")
    return letters


def cuts(streams: list) -> list[list[int]]:
    """Ends of the chunks of each id array."""
    import numpy as np

    every = np.concatenate(streams) if streams else np.zeros(0, np.uint32)
    x = every.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    rolled = x.copy()
    for k in range(1, ROLL):
        rolled[k:] += x[:-k] << np.uint64(5 * k)
    offsets = np.cumsum([0, *map(len, streams)])
    at = np.flatnonzero((rolled * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(40)) % np.uint64(MEAN) == 0) + 1
    first = np.searchsorted(at, offsets[:-1] + ROLL)  # the window lies in one stream
    last = np.searchsorted(at, offsets[1:])
    out = []
    for begin, end, a, b in zip(offsets.tolist(), offsets[1:].tolist(), first.tolist(), last.tolist(), strict=False):
        ends, done = [], 0
        for cut in [*(at[a:b] - begin).tolist(), end - begin]:
            while cut - done > MOST:
                done += MOST
                ends.append(done)
            if cut > done:
                ends.append(cut)
                done = cut
        out.append(ends)
    return out


def narrowed(ids):
    """Ids in two bytes each if they fit, else in four."""
    return ids.astype("<u2" if not len(ids) or int(ids.max()) < 65_536 else "<u4")


def digest(chunk) -> bytes:
    """Of bytes, or of the bytes of a narrowed id array."""
    return hashlib.sha256(chunk).digest()[:KEY]


def merkle(leaves: list[bytes]) -> bytes:
    """Root over digests, FAN to a node."""
    level = list(leaves) or [b""]
    while len(level) > FAN:
        level = [digest(b"".join(level[i : i + FAN])) for i in range(0, len(level), FAN)]
    return digest(b"root" + b"".join(level))


def _zstd() -> tuple:
    """The worker's compressor and decompressor."""
    cache = worker_cache()
    if "zstd" not in cache:
        import zstandard

        cache["zstd"] = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()
    return cache["zstd"]


def pack(narrow) -> bytes:
    return bytes([narrow.itemsize]) + _zstd()[0].compress(narrow)


def unpack(payload: bytes):
    import numpy as np

    return np.frombuffer(_zstd()[1].decompress(payload[1:]), dtype=f"<u{payload[0]}")


@tidy
def write(docs: DataFrame, tokens: Tokens, end_id: int) -> DataFrame:
    """Encode docs and write the store; returns its rows, manifests included."""

    def encoded(batches):
        import numpy as np
        import pyarrow as pa

        end = np.array([end_id], dtype="<u4").tobytes()
        for batch in sliced(batches, 256):
            n, keys, lens, payloads = [], [], [], []
            raws = [raw + end for raw in tokens.encode([x or "" for x in batch.column("text").to_pylist()])]
            streams = [np.frombuffer(raw, dtype="<u4") for raw in raws]
            for ids, ends in zip(streams, cuts(streams), strict=True):
                narrow = narrowed(ids)
                keys.append(b"".join([digest(narrow[a:b]) for a, b in zip([0, *ends], ends, strict=False)]))
                n.append(len(ids))
                lens.append(np.diff(ends, prepend=0).astype("<u4").tobytes())
                payloads.append(pack(narrow))
            yield pa.RecordBatch.from_arrays(
                [batch.column("uid"), batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(lens, pa.binary()), pa.array(payloads, pa.binary())],
                names=["uid", "doc_id", "n_tokens", "keys", "lens", "payload"],
            )

    numbered = docs.select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("long"), "text")
    staged = save(numbered.mapInArrow(encoded, "uid long, doc_id long, n_tokens long, keys binary, lens binary, payload binary"))

    # Which chunks occur again, and which occurrence comes first: digests and places only, no payload.
    places = staged.select("doc_id", "uid", *exploded_keys())
    owners = save(places.groupBy("key").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "uid", "pos")).alias("owner")).where("n > 1"))
    again = met(places, owners.drop("n"), common_keys(owners))
    is_owner = (F.col("owner.uid") == F.col("uid")) & (F.col("owner.pos") == F.col("pos"))
    notes = again.groupBy("doc_id", "uid").agg(F.collect_list(F.when(~is_owner, F.col("pos"))).alias("foreign"), F.collect_list(F.when(is_owner, F.col("pos"))).alias("lent"))
    notes = notes.select("uid", "doc_id", F.lit(0).alias("after"), "foreign", "lent")
    rows = staged.withColumn("after", F.lit(1)).unionByName(notes, allowMissingColumns=True)
    rows = rows.repartitionByRange("doc_id", "uid").sortWithinPartitions("doc_id", "uid", "after")

    schema = to_arrow_schema(StructType.fromDDL(ROW))

    def shards(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()
        start, roots, note = 0, [], None
        for batch in sliced(batches, 256):
            out: list[list] = [[] for _ in schema]
            read = zip(*(batch.column(c).to_pylist() for c in ("uid", "doc_id", "n_tokens", "keys", "lens", "payload", "after", "foreign", "lent")), strict=True)
            for uid, doc_id, n_tokens, keys, packed, payload, after, foreign, lent in read:
                if not after:
                    note = uid, foreign, lent
                    continue
                _, foreign, lent = note if note and note[0] == uid else (uid, (), ())
                lens = np.frombuffer(packed, dtype="<u4")
                marks = np.full(len(lens), OWNED, dtype=np.uint8)
                if foreign or lent:
                    marks[list(foreign)] = 0
                    marks[list(lent)] |= LENT
                if foreign:
                    payload = pack(unpack(payload)[np.repeat(marks > 0, lens)])
                root = merkle(leaves(keys))
                roots.append(root)
                row = (uid, doc_id, "document", shard, start, n_tokens, keys, packed, marks.tobytes(), bool(foreign), bool(lent), root, payload)
                for column, value in zip(out, row, strict=True):
                    column.append(value)
                start += n_tokens
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema, strict=True)], schema=schema)
        if roots:
            yield pa.RecordBatch.from_pylist([{"kind": "manifest", "shard": shard, "start": len(roots), "n_tokens": start, "root": merkle(roots)}], schema=schema)

    return save(rows.mapInArrow(shards, ROW))


@tidy
def read(store: DataFrame, checksums: bool = False) -> DataFrame:
    """uid, doc_id, start, n_tokens and ``ids`` (little-endian unsigned 32-bit, as bytes) of every document, verified.

    Fails at once if a manifest differs from its shard, and when run if a document differs from its recipe.
    checksums: in place of ids their unsigned CRC-32, ``ids_crc32``.
    """
    broken = [r["shard"] for r in broken_shards(store).collect()]
    if broken:
        raise ValueError(f"shards {sorted(broken)} differ from their manifests")
    name = "ids_crc32" if checksums else "ids"
    documents = store.where("kind = 'document'")
    manifests = store.where("kind = 'manifest'").select("shard", F.col("n_tokens").alias("in_shard"))
    # One row for each file of the store.
    upto = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    base = manifests.select("shard", F.coalesce(F.sum("in_shard").over(upto), F.lit(0)).alias("base"))

    def lend(batches):
        import numpy as np
        import pyarrow as pa

        for batch in sliced(batches, 256):
            keys, chunks = [], []
            for r in batch.to_pylist():
                lens, marks = np.frombuffer(r["lens"], dtype="<u4"), np.frombuffer(r["marks"], dtype=np.uint8)
                ids, ends = unpack(r["payload"]), np.cumsum(lens * (marks > 0))
                for k in np.flatnonzero(marks & LENT):
                    keys.append(r["keys"][KEY * k : KEY * (k + 1)])
                    chunks.append(bytes([ids.itemsize]) + ids[ends[k] - lens[k] : ends[k]].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(chunks, pa.binary())], names=["key", "chunk"])

    def rebuild(batches):
        import numpy as np
        import pyarrow as pa

        for batch in sliced(batches, 256):
            out = []
            read = zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n_tokens", "keys", "lens", "marks", "root", "payload", "parts")), strict=True)
            for doc_id, n_tokens, keys, lens, marks, root, payload, parts in read:
                lens, marks = np.frombuffer(lens, dtype="<u4"), np.frombuffer(marks, dtype=np.uint8)
                ids = unpack(payload)
                ends = np.cumsum(lens * (marks > 0), dtype=np.int64)
                parts = {p["pos"]: np.frombuffer(p["chunk"][1:], dtype=f"<u{p['chunk'][0]}") for p in parts or ()}
                if any(k not in parts for k in np.flatnonzero(marks == 0).tolist()):
                    raise ValueError(f"document {doc_id} lacks a chunk")
                chunks = [ids[e - n : e] if m else parts[k] for k, (n, e, m) in enumerate(zip(lens.tolist(), ends.tolist(), marks.tolist(), strict=True))]
                if b"".join(map(digest, chunks)) != keys or merkle(leaves(keys)) != root or sum(map(len, chunks)) != n_tokens:
                    raise ValueError(f"document {doc_id} differs from its recipe")
                raw = np.concatenate(chunks).astype("<u4").tobytes()
                out.append(zlib.crc32(raw) if checksums else raw)
            kept = ["uid", "doc_id", "shard", "start", "n_tokens"]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in kept), pa.array(out, pa.int64() if checksums else pa.binary())], names=[*kept, name])

    columns = ["uid", "doc_id", "shard", "start", "n_tokens", "keys", "lens", "marks", "root", "payload"]
    result = f"uid long, doc_id long, shard int, start long, n_tokens long, {name} {'long' if checksums else 'binary'}"
    chunks = documents.where("lends").select("keys", "lens", "marks", "payload").mapInArrow(lend, "key binary, chunk binary")
    wanted = documents.where("borrows").select("uid", "marks", *exploded_keys()).where(F.substring("marks", F.col("pos") + 1, F.lit(1)) == F.lit(b"\0")).select("uid", "pos", "key")
    parts = met(wanted, chunks, common_keys(wanted.groupBy("key").agg(F.count("*").alias("n")))).groupBy("uid").agg(F.collect_list(F.struct("pos", "chunk")).alias("parts"))
    parts_type = parts.schema["parts"].dataType
    alone = documents.where("not borrows").select(*columns, F.lit(None).cast(parts_type).alias("parts")).mapInArrow(rebuild, result)
    shared = documents.where("borrows").select(*columns).join(parts, "uid", "left").mapInArrow(rebuild, result)
    return alone.unionByName(shared).join(F.broadcast(base), "shard").select("uid", "doc_id", (F.col("start") + F.col("base")).alias("start"), "n_tokens", name)


def common_keys(counts: DataFrame) -> DataFrame:
    """The keys of counts(key, n) that most rows have, COMMON at most; no other has more than one row in COMMON."""
    return save(counts.where(F.col("n") > OFTEN).orderBy(F.desc("n"), "key").limit(COMMON).select("key"))


def met(many: DataFrame, one: DataFrame, common: DataFrame) -> DataFrame:
    """many joined with one, which has a row for each key: rows of common keys stay where they are."""
    common = F.broadcast(common)
    near = many.join(F.broadcast(one.join(common, "key")), "key")
    return near.unionByName(many.join(common, "key", "left_anti").join(one, "key"))


def exploded_keys() -> list:
    """pos and key of each chunk in the column keys."""
    at = F.explode(F.sequence(F.lit(0), (F.octet_length("keys") / KEY).cast("int") - 1)).alias("pos")
    return [at, F.substring("keys", F.col("pos") * KEY + 1, F.lit(KEY)).alias("key")]


def leaves(keys: bytes) -> list[bytes]:
    return [keys[i : i + KEY] for i in range(0, len(keys), KEY)]


@tidy
def digests(docs: DataFrame, tokens: Tokens, end_id: int) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, read back from the store."""
    return read(write(docs, tokens, end_id), checksums=True).select("doc_id", "start", "n_tokens", "ids_crc32")


def broken_shards(store: DataFrame) -> DataFrame:
    """Shards whose manifest does not fit their documents (none, if the store is whole)."""
    by_shard = store.select("shard", F.struct("kind", "start", "n_tokens", "root").alias("r"))

    def check(shard_rows):
        documents = sorted((r for r in shard_rows["r"] if r["kind"] == "document"), key=lambda r: r["start"])
        manifest = [r for r in shard_rows["r"] if r["kind"] == "manifest"]
        starts = list(accumulate((r["n_tokens"] for r in documents), initial=0))
        whole = len(manifest) == 1 and manifest[0]["start"] == len(documents) and [*(r["start"] for r in documents), manifest[0]["n_tokens"]] == starts and bytes(manifest[0]["root"]) == merkle([bytes(r["root"]) for r in documents])
        import pandas as pd

        return pd.DataFrame({"shard": [] if whole else [int(shard_rows["shard"].iloc[0])]}, dtype="int32")

    return by_shard.groupBy("shard").applyInPandas(check, "shard int")
