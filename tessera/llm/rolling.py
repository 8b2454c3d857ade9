"""Words and windows of many texts at once, as arrays of 64-bit hashes (numpy, on executors)."""

from __future__ import annotations

ODD, UNDO = 0x9E3779B97F4A7C15, 0xF1DE83E19937733D  # inverse of each other modulo 2**64
#: Bytes of text worked on at a time; places in a word whose spread numbers are kept in a table.
BLOCK, NEAR = 1 << 20, 32


def mix(x, seed: int = 0):
    """Spread 64-bit values (the finaliser of splitmix64)."""
    import numpy as np

    x = x + np.uint64((seed * 0xD1342543DE82EF95 + 0x2545F4914F6CDD1D) % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: int, n: int):
    import numpy as np

    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out) if n else out


def blocks(texts: list[bytes]):
    """Slices of the list of about BLOCK bytes each."""
    lo = 0
    while lo < len(texts):
        hi, size = lo, 0
        while hi < len(texts) and (hi == lo or size + len(texts[hi]) <= BLOCK):
            size += len(texts[hi]) + 1
            hi += 1
        yield lo, hi
        lo = hi


def word_hashes(texts: list[bytes]):
    """Hashes of all words, and where each text's words start (one more than texts).

    A word's hash sums a spread number for each byte at its place, so no pattern of bytes cancels out.
    """
    import numpy as np

    space = np.zeros(256, dtype=bool)
    space[[0x20, *range(0x09, 0x0E)]] = True
    x = np.frombuffer(b" ".join([b"", *texts, b""]), dtype=np.uint8)
    gap = space[x]
    starts, ends = np.flatnonzero(gap[:-1] & ~gap[1:]) + 1, np.flatnonzero(~gap[:-1] & gap[1:]) + 1
    lengths = ends - starts
    first = np.cumsum(lengths) - lengths
    kind = np.int32 if len(x) < 1 << 23 else np.int64  # places times 256 fit
    place = np.arange(lengths.sum(), dtype=kind) - np.repeat(first.astype(kind), lengths)
    far = np.flatnonzero(place >= NEAR)
    letter = place * kind(256) + x[~gap]
    much = letter[far]
    letter[far] = 0
    spread = mix(np.arange(NEAR * 256, dtype=np.uint64), 1)[letter]
    spread[far] = mix(much.astype(np.uint64), 1)
    hashes = mix(np.add.reduceat(spread, first), 2) if len(first) else np.zeros(0, np.uint64)
    offsets = np.cumsum([0, *(len(t) + 1 for t in texts)])
    return hashes, np.searchsorted(starts, offsets)


def windows(hashes, size: int):
    """Hash of each run of ``size`` hashes; empty if there are fewer."""
    import numpy as np

    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    total = np.zeros(n, dtype=np.uint64)
    for k in range(size):
        total += hashes[k : k + n] * np.uint64(pow(ODD, k + 1, 2**64))
    return mix(total, 3)


def long_windows(hashes, size: int):
    """As windows(), by prefix sums, for long windows."""
    import numpy as np

    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    run = np.zeros(len(hashes) + 1, dtype=np.uint64)
    np.cumsum(hashes * powers(ODD, len(hashes)), dtype=np.uint64, out=run[1:])
    return mix((run[size:] - run[:-size]) * powers(UNDO, n), 4)


def minimizers(values, width: int):
    """For each run of ``width`` values the place of the smallest, the last of equals; as many as runs."""
    import numpy as np

    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64)
    # Doubling: the place of the smallest of spans of 1, 2, 4, ..., then of two spans that cover the width.
    place, span = np.arange(len(values)), 1
    while 2 * span <= width:
        a, b = place[:-span], place[span:]
        place = np.where(values[a] < values[b], a, b)
        span *= 2
    a, b = place[:n], place[width - span : width - span + n]
    return np.where(values[a] < values[b], a, b)
