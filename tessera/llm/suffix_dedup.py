"""Suffix-array dedup: remove byte strings that also start in a document with a smaller id.

Only suffixes that can repeat are sorted: those at windows whose winnowed anchor (the least 20-byte
sequence of the window) occurs in more than one document.  All suffixes with one anchor meet in one
partition, in blocks, and a block is sorted deep-shallow: multikey quicksort on characters of 8 bytes to
a shallow depth, then blind tries for groups whose common prefix is longer.  In the order, runs with a
common prefix of a whole window are equal strings, and a suffix repeats if its run has a smaller id.

A task sends the same bytes around an anchor only with an id smaller than it sent before, as else they are known to
be repeated.  Anchors that occur very often are not sorted as one group: each window that they are the anchor
of is a group by itself.

Texts are UTF-8 bytes; null is empty.  Documents equal as texts repeat the one with the smallest id
wholly, if as long as a window.  Rows with equal ids are no repeats of each other; a null id is smaller
than any other.  An empty table has an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import tidy
from .common import save, sliced
from .repeats import copies, frequent, grouped, identified, merged, recurring, representatives, seeded, without
from .rolling import blocks, long_windows, minimizers, mix

ANCHOR = 20
#: Bytes sorted by multikey quicksort; its short segments; rows of a block; surroundings that a task remembers.
SHALLOW, SHORT, BLOCK_ROWS, SEEN_ROWS = 24, 2_048, 20_000, 100_000


def _anchored(raw: list[bytes], window: int):
    """For each text with a window: its place in the list, the hashes of its k-grams and the anchor's place of each window."""
    import numpy as np

    table = mix(np.arange(256, dtype=np.uint64), 7)
    for lo, hi in blocks(raw):
        hashes = long_windows(table[np.frombuffer(b"\0".join(raw[lo:hi]), dtype=np.uint8)], ANCHOR)
        places = minimizers(hashes, window - ANCHOR + 1)
        at = 0
        for i in range(lo, hi):
            n = len(raw[i]) - window + 1
            if n > 0:
                yield i, hashes[at : at + len(raw[i])], places[at : at + n] - at
            at += len(raw[i]) + 1


def blind_order(strings: list[bytes]) -> list[int]:
    """The order of distinct strings of one length, by a blind trie.

    An inner node holds the depth at which its children differ and a child for each byte there; what lies
    between is skipped.  A string goes down blindly to a leaf, is compared with that leaf once, and is
    hung in where they first differ.
    """
    root: object = 0
    for i in range(1, len(strings)):
        own, node = strings[i], root
        while type(node) is list:
            node = node[1].get(own[node[0]]) or next(iter(node[1].values()))
            node = node[0] if type(node) is tuple else node
        other = strings[node]
        depth = next(d for d in range(len(own)) if own[d] != other[d])
        parent, node = None, root
        while type(node) is list and node[0] < depth:
            parent, step = node, own[node[0]]
            held = node[1][step]
            node = held[0] if type(held) is tuple else held
        if type(node) is list and node[0] == depth:
            node[1][own[depth]] = (i,)
            continue
        new = [depth, {own[depth]: (i,), other[depth]: node if type(node) is list else (node,)}]
        if parent is None:
            root = new
        else:
            parent[1][step] = new
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        if type(node) is list:
            todo += [node[1][b] for b in sorted(node[1], reverse=True)]
        else:
            out.append(node[0] if type(node) is tuple else node)
    return out


def multikey_quicksort(n: int, character):
    """The order of n strings by their first SHALLOW bytes; character(rows, d) gives the 8 bytes at d of rows as numbers.

    A segment is parted by a pivot character into smaller, equal and greater; the equal ones go on with the next
    character.  Short segments are sorted by all characters that are left.
    """
    import numpy as np

    order, todo = np.arange(n), [(0, n, 0)]
    while todo:
        lo, hi, depth = todo.pop()
        if hi - lo < 2 or depth >= SHALLOW:
            continue
        own = order[lo:hi]
        if hi - lo <= SHORT:
            order[lo:hi] = own[np.lexsort([character(own, d) for d in range(SHALLOW - 8, depth - 1, -8)])]
            continue
        value = character(own, depth)
        sample = np.sort(value[:: max(1, len(value) // 31)])
        pivot = sample[len(sample) // 2]
        less, greater = value < pivot, value > pivot
        equal = ~(less | greater)
        order[lo:hi] = np.concatenate([own[less], own[equal], own[greater]])
        a, b = lo + int(less.sum()), hi - int(greater.sum())
        todo += [(lo, a, depth), (a, b, depth + 8), (b, hi, depth)]
    return order


def suffix_runs(text: bytes, starts, length: int):
    """Order of the suffixes of text at starts by their first ``length`` bytes, and for each in that order the number of its run of equals."""
    import numpy as np

    n = len(starts)
    flat = np.frombuffer(text + bytes(8), dtype=np.uint8)
    eights = np.lib.stride_tricks.sliding_window_view(flat, 8)
    character = lambda rows, d: np.ascontiguousarray(eights[starts[rows] + d]).view(">u8").ravel().astype(np.uint64)
    order = multikey_quicksort(n, character)
    # A new run starts where the shallow characters differ.
    new = np.zeros(n, dtype=bool)
    new[:1] = True
    for depth in range(0, SHALLOW, 8):
        value = character(order, depth)
        new[1:] |= value[1:] != value[:-1]
    run = np.flatnonzero(new)[np.cumsum(new) - 1]
    tied = np.flatnonzero(~new | np.append(~new[1:], False))
    if not len(tied):
        return order, run
    # Deep: groups that are equal over SHALLOW bytes.  Those equal to the end are runs already.
    depths = [*range(SHALLOW, length - 7, 8), length - 8]
    deep = np.stack([character(order[tied], d) for d in depths], axis=1)
    first = np.flatnonzero(np.append(True, run[tied][1:] != run[tied][:-1]))
    sizes = np.diff(np.append(first, len(tied)))
    equal = np.logical_and.reduceat((deep == deep[np.repeat(first, sizes)]).all(axis=1), first)
    for f, size in zip(first[~equal].tolist(), sizes[~equal].tolist(), strict=True):
        at = tied[f : f + size]
        members: dict[bytes, list[int]] = {}
        for o in order[at].tolist():
            s = int(starts[o])
            members.setdefault(text[s + SHALLOW : s + length], []).append(o)
        strings, place = list(members), int(at[0])
        for k in blind_order(strings):
            own = members[strings[k]]
            order[place : place + len(own)], run[place : place + len(own)] = own, place
            place += len(own)
    return order, run


def smaller_before(contexts: list[bytes], owners, window: int):
    """For each context (bytes of some windows in a row) the smallest owner of each of its windows, all in one array."""
    import numpy as np

    lengths = np.array([len(c) for c in contexts], dtype=np.int64)
    counts, begins = lengths - window + 1, np.cumsum(lengths) - lengths
    starts = np.repeat(begins - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
    order, run = suffix_runs(b"".join(contexts), starts, window)
    owner = np.repeat(np.asarray(owners, dtype=np.int64), counts)
    least = np.minimum.reduceat(owner[order], np.flatnonzero(np.append(True, run[1:] != run[:-1])))
    out = np.empty(len(starts), dtype=np.int64)
    out[order] = least[np.cumsum(np.append(True, run[1:] != run[:-1])) - 1]
    return out, np.append(0, np.cumsum(counts))


def repeated_in_block(rows: list[tuple], window: int) -> list[tuple]:
    """Ranges (oid, tid, start, end) of rows (key, oid, tid, starts, context) in order of key whose strings a smaller oid has."""
    import numpy as np

    first: dict[bytes, int] = {}  # a context has one key
    of_key: dict[int, list[bytes]] = {}
    for key, oid, _, _, context in rows:
        held = first.get(context)
        if held is None:
            of_key.setdefault(key, []).append(context)
        if held is None or oid < held:
            first[context] = oid
    # Only where a key has several contexts is there an order to find; all windows of a lone one are its own.
    varied = [c for own in of_key.values() if len(own) > 1 for c in own]
    number = {c: i for i, c in enumerate(varied)}
    if varied:
        least, at = smaller_before(varied, [first[c] for c in varied], window)
        lowest, highest = np.minimum.reduceat(least, at[:-1]).tolist(), np.maximum.reduceat(least, at[:-1]).tolist()
    out = []
    for _, oid, tid, starts, context in rows:
        i = number.get(context)
        if (first[context] if i is None else lowest[i]) >= oid:
            continue
        if i is None or highest[i] < oid:
            out += [(oid, tid, s, s + len(context)) for s in starts]
            continue
        hit = np.flatnonzero(least[at[i] : at[i + 1]] < oid)
        gaps = np.flatnonzero(np.diff(hit) > 1)
        for a, b in zip([hit[0], *hit[gaps + 1]], [*hit[gaps], hit[-1]], strict=True):
            out += [(oid, tid, s + int(a), s + int(b) + window) for s in starts]
    return out


def joined(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ranges that overlap or touch as one, in order."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(ranges):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def surroundings(raw: bytes, hashes, place, seeds, often, window: int):
    """(key, first byte, end) of the windows around each seed of a document: all that it is the anchor of, or if it is frequent one by one."""
    import numpy as np

    begin = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
    end = np.append(begin[1:], len(place))
    anchor = hashes[place[begin]].view(np.int64)
    near = np.isin(anchor, seeds)
    hot = near & np.isin(anchor, often)
    near &= ~hot
    out = [anchor[near], begin[near], end[near] + window - 1]
    if hot.any():
        each = np.concatenate([np.arange(a, b) for a, b in zip(begin[hot].tolist(), end[hot].tolist(), strict=True)])
        key = mix(long_windows(mix(np.frombuffer(raw, dtype=np.uint8).astype(np.uint64), 7), window)[each], 12).view(np.int64)
        out = [np.concatenate(x) for x in zip(out, [key, each, each + window], strict=True)]
    return [x.tolist() for x in out]


def repeated_ranges(reps: DataFrame, window: int) -> DataFrame:
    """oid, tid, start, end in bytes: windows that also start in a document with a smaller oid."""

    def anchors_of(texts):
        import numpy as np

        raw = [t.encode() for t in texts]
        return [(i, hashes[place[np.append(True, place[1:] != place[:-1])]]) for i, hashes, place in _anchored(raw, window)]

    again = recurring(reps, anchors_of, across_documents=True)
    often = frequent(again)
    names = ["key", "oid", "tid", "starts", "end", "context"]

    def contexts(batches):
        """Rows to sort (without an end), and rows that are known to be repeated (without a context)."""
        import numpy as np
        import pyarrow as pa

        types = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.int32(), pa.binary()]
        seen: dict[bytes, int] = {}  # a context has one key
        hot = np.array(often, dtype=np.int64)
        for batch in sliced(batches, 256):
            ids, tids, known = batch.column("oid").to_pylist(), batch.column("tid").to_pylist(), batch.column("seeds")
            raw, out = [t.encode() for t in batch.column("text").to_pylist()], []
            for i, hashes, place in _anchored(raw, window):
                text, oid, tid = raw[i], ids[i], tids[i]
                own: dict[bytes, tuple[int, list[int]]] = {}
                covered: list[tuple[int, int]] = []
                for key, first, end in zip(*surroundings(text, hashes, place, known[i].values.to_numpy(), hot, window), strict=True):
                    own.setdefault(text[first:end], (key, []))[1].append(first)
                for context, (key, starts) in own.items():
                    least = seen.get(context)
                    if least is not None and least < oid:
                        covered += [(s, s + len(context)) for s in starts]
                        continue
                    if least is None and len(seen) >= SEEN_ROWS:
                        seen.clear()
                    seen[context] = oid
                    out.append((key, oid, tid, starts, None, context))
                out += [(hash((oid, tid, s)), oid, tid, [s], end, None) for s, end in joined(covered)]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [[]] * len(types), types, strict=True)], names=names)

    def sort(batches):
        import pyarrow as pa

        for rows in grouped(batches, names, BLOCK_ROWS):
            out = [(r[1], r[2], r[3][0], r[4]) for r in rows if r[5] is None]
            rest = [(*r[:4], r[5]) for r in rows if r[5] is not None]
            out += repeated_in_block(rest, window) if rest else []
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [[]] * 4, [pa.int64(), pa.int64(), pa.int32(), pa.int32()], strict=True)], names=["oid", "tid", "start", "end"])

    rows = seeded(reps, again).mapInArrow(contexts, "key long, oid long, tid long, starts array<int>, end int, context binary")
    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(sort, "oid long, tid long, start int, end int")


@tidy
def remove_repeats(docs: DataFrame, window: int = 50, as_text: bool = False) -> DataFrame:
    """row (docs' columns but the text), n_bytes, n_removed, spans (removed runs in bytes) and kept.

    kept is bytes, or as_text a string, without characters of which a part was removed.
    """
    x = identified(docs)
    copied = copies(x)
    ranges = repeated_ranges(representatives(x, copied), window)
    later = copied.where("oid > first").select("oid", "tid").distinct()
    whole = later.select("oid", "tid", F.lit(0).alias("start"), F.lit(2**31 - 1).alias("end"))
    ranges = save(ranges.unionByName(whole))

    def cut(text, ranges):
        raw = text.encode()
        if len(raw) < window:
            ranges = ranges[:0]
        spans = merged(ranges, len(raw)).tolist()
        kept, last = [], 0
        for a, b in spans:
            kept.append(raw[last:a])
            last = b
        kept = b"".join([*kept, raw[last:]])
        return len(raw), len(raw) - len(kept), spans, kept.decode(errors="ignore") if as_text else kept

    return without(x, ranges, cut, f"n_bytes long, n_removed long, spans array<array<bigint>>, kept {'string' if as_text else 'binary'}")


def digests(docs: DataFrame, window: int = 50) -> DataFrame:
    out = remove_repeats(docs.select("doc_id", "text"), window)
    return out.select("row.doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
