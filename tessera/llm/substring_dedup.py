"""Substring dedup by seed and extend: remove the words of passages that occur more than once.

Seeds are winnowed anchors, the least of the 8-word sequences of a window; documents meet on anchors that
recur.  Occurrences of a seed are extended word by word to the left and to the right, all of them at once: those
that agree so far stay in one class, and a class of one stops.  Two occurrences match over as many words as
their left and right classes agree on, so no pairs are made; matches of a whole window are kept, and those that
touch or overlap join to maximal repeats.  Words are compared, not hashes of them.

A task sends the same surroundings of a seed at most twice, as what it has seen twice is repeated.  Seeds that
occur very often are not extended as one group: each window that they are the anchor of is a group by itself.

Null text has no words.  A text shorter than a window keeps all.  Documents equal as texts are copies: if
long enough, all their words go, as every window starts elsewhere too.  Repeated rows are copies.  An
empty table has an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import tidy
from .common import save, sliced
from .repeats import copies, frequent, grouped, identified, merged, recurring, representatives, seeded, without
from .rolling import blocks, long_windows, minimizers, mix, windows, word_hashes

ANCHOR = 8
ALL = 2**31 - 1
#: Rows that are extended at once; surroundings of seeds that a task remembers.
BLOCK_ROWS, SEEN_ROWS = 20_000, 100_000


def _anchored(texts: list[str], window: int):
    """For each text with a window: its place in the list, its word hashes, anchors and the anchor's place of each window."""
    raw = [t.encode() for t in texts]
    for lo, hi in blocks(raw):
        hashes, at = word_hashes(raw[lo:hi])
        for i, (a, b) in enumerate(zip(at, at[1:], strict=False)):
            if b - a >= window:
                own = hashes[a:b]
                anchors = windows(own, ANCHOR)
                yield lo + i, own, anchors, minimizers(anchors, window - ANCHOR + 1)


def surroundings(own, anchors, place, seeds, often, window: int):
    """(key, first window, windows, words before the seed) of each seed of a document: the windows that it is the anchor of, at once or if it is frequent one by one."""
    import numpy as np

    begin = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
    end = np.append(begin[1:], len(place))
    anchor = anchors[place[begin]].view(np.int64)
    near = np.isin(anchor, seeds)
    hot = near & np.isin(anchor, often)
    near &= ~hot
    out = [anchor[near], begin[near], (end - begin)[near], (place[begin] - begin)[near]]
    if hot.any():
        each = np.concatenate([np.arange(a, b) for a, b in zip(begin[hot].tolist(), end[hot].tolist(), strict=True)])
        key = mix(long_windows(own, window)[each], 12).view(np.int64)
        out = [np.concatenate(x) for x in zip(out, [key, each, np.ones(len(each), np.int64), place[each] - each], strict=True)]
    return [x.tolist() for x in out]


def extended(rows: list[tuple], window: int) -> list[tuple]:
    """Ranges (oid, tid, start, end) of rows (key, oid, tid, start, before, context) in order of key that are repeated.

    start: the context's first word in its document, or null if only its match counts; before: its words before the seed.
    """
    import numpy as np

    number: dict[bytes, int] = {}
    words = [[number.setdefault(w, len(number)) for w in r[5].split()] for r in rows]
    sizes = np.array([len(w) for w in words], dtype=np.int64)
    flat = np.fromiter((w for own in words for w in own), np.int64, int(sizes.sum()))
    begin = np.cumsum(sizes) - sizes
    before = np.array([r[4] for r in rows], dtype=np.int64)
    after = sizes - before - ANCHOR
    key = np.array([r[0] for r in rows], dtype=np.int64)
    group = np.cumsum(np.append(False, key[1:] != key[:-1]))
    reach = window - ANCHOR

    def classes(first, step: int, room):
        """By number of words from the seed on: the class of each row that agrees on them with another row, else -1."""
        out = [group]
        for d in range(1, reach + 1):
            own = np.full(len(rows), -1)
            active = np.flatnonzero((out[-1] >= 0) & (room >= d))
            if len(active):
                _, number_, count = np.unique(out[-1][active] * len(number) + flat[first[active] + step * d], return_inverse=True, return_counts=True)
                shared = count[number_] > 1
                own[active[shared]] = number_[shared]
            out.append(own)
        return out

    # The seed itself: rows of one key may differ in it if hashes collide.
    for k in range(ANCHOR):
        _, group = np.unique(group * len(number) + flat[begin + before + k], return_inverse=True)
    left, right = classes(begin + before, -1, before), classes(begin + before + ANCHOR - 1, 1, after)
    hits = np.zeros((len(rows), reach + 2), dtype=np.int8)  # by words before the seed, from most to none; one column more
    for d in range(reach + 1):
        l, r = left[d], right[reach - d]  # noqa: E741
        both = np.flatnonzero((l >= 0) & (r >= 0) & (before >= d) & (after >= reach - d))
        _, same, count = np.unique(l[both] * (len(rows) + 1) + r[both], return_inverse=True, return_counts=True)
        hits[both[count[same] > 1], reach - d] = 1
    # Windows in a row that match join: from the first window's start to the last one's end.
    edge = np.diff(hits, axis=1, prepend=0)
    row, opens = np.nonzero(edge == 1)
    _, closes = np.nonzero(edge == -1)
    out = []
    for i, a, b in zip(row.tolist(), opens.tolist(), closes.tolist(), strict=True):
        _, oid, tid, start, lead, _ = rows[i]
        if start is not None:
            out.append((oid, tid, start + lead - reach + a, start + lead - reach + b - 1 + window))
    return out


def repeated_ranges(reps: DataFrame, window: int) -> DataFrame:
    """oid, tid, start, end in words: windows that start in more than one place."""

    def anchors_of(texts):
        import numpy as np

        return [(i, anchors[np.unique(place)]) for i, _, anchors, place in _anchored(texts, window)]

    again = recurring(reps, anchors_of, across_documents=False)
    often = frequent(again)
    names, kinds = ["key", "oid", "tid", "start", "end", "before", "context"], "key long, oid long, tid long, start int, end int, before int, context binary"

    def contexts(batches):
        """Rows to extend (without an end), and rows that are known to be repeated (without a context)."""
        import numpy as np
        import pyarrow as pa

        types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]
        seen: dict[bytes, int] = {}  # a context has one key
        hot = np.array(often, dtype=np.int64)
        for batch in sliced(batches, 256):
            ids, tids, known = batch.column("oid").to_pylist(), batch.column("tid").to_pylist(), batch.column("seeds")
            texts, out = batch.column("text").to_pylist(), []
            for i, own, anchors, place in _anchored(texts, window):
                words = texts[i].encode().split()
                for key, first, n, before in zip(*surroundings(own, anchors, place, known[i].values.to_numpy(), hot, window), strict=True):
                    end = first + n - 1 + window
                    context = b" ".join(words[first:end])
                    times = seen.get(context, 0)
                    if not times and len(seen) >= SEEN_ROWS:
                        seen.clear()
                    if times < 2:
                        seen[context] = times + 1
                        out.append((key, ids[i], tids[i], None if times else first, None, before, context))
                    if times:
                        out.append((hash((key, ids[i], first)), ids[i], tids[i], first, end, None, None))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [[]] * len(types), types, strict=True)], names=names)

    def extend(batches):
        import pyarrow as pa

        for rows in grouped(batches, names, BLOCK_ROWS):
            out = [(r[1], r[2], r[3], r[4]) for r in rows if r[6] is None]
            rest = [(*r[:4], *r[5:]) for r in rows if r[6] is not None]
            out += extended(rest, window) if rest else []
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [[]] * 4, [pa.int64(), pa.int64(), pa.int32(), pa.int32()], strict=True)], names=["oid", "tid", "start", "end"])

    rows = seeded(reps, again).mapInArrow(contexts, kinds)
    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(extend, "oid long, tid long, start int, end int")


@tidy
def remove_repeats(docs: DataFrame, window: int = 50) -> DataFrame:
    """row (docs' columns but the text), n_words, n_removed, spans (maximal repeats in words) and kept (the kept words, joined by a space)."""
    x = identified(docs)
    copied = copies(x)
    ranges = repeated_ranges(representatives(x, copied), window)
    whole = copied.select("oid", "tid").distinct().select("oid", "tid", F.lit(0).alias("start"), F.lit(ALL).alias("end"))
    ranges = save(ranges.unionByName(whole))

    def cut(text, ranges):
        words = text.encode().split()
        if len(words) < window:
            ranges = ranges[:0]
        spans = merged(ranges, len(words)).tolist()
        kept, last = [], 0
        for a, b in spans:
            kept += words[last:a]
            last = b
        kept += words[last:]
        return len(words), len(words) - len(kept), spans, b" ".join(kept)

    return without(x, ranges, cut, "n_words long, n_removed long, spans array<array<bigint>>, kept binary")


def digests(docs: DataFrame, window: int) -> DataFrame:
    out = remove_repeats(docs.select("doc_id", "text"), window)
    return out.select("row.doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
