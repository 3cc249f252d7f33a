"""64-bit names of byte strings, for all places of a text at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

#: Two bases and two tables of numbers for bytes: sums by one of them are names, by both names of twice the width.
_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
_BYTES = np.random.default_rng(11).integers(1, 2**63, (2, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(a: np.ndarray) -> np.ndarray:
    a = (a ^ (a >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    a = (a ^ (a >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return a ^ (a >> np.uint64(31))


class Powers:
    """Powers of each base and of its inverse modulo 2**64, as far as they were asked for."""

    known = [(np.ones(1, np.uint64),) * 2] * len(_BASES)

    @classmethod
    def upto(cls, n: int, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.known[which][0]) < n:
            base = _BASES[which]
            steps = [np.full(max(n, 1 << 16), b % 2**64, np.uint64) for b in (base, pow(base, -1, 2**64))]
            cls.known[which] = tuple(np.cumprod(np.concatenate([np.ones(1, np.uint64), s]), dtype=np.uint64) for s in steps)
        return cls.known[which]


def prefix_sums(raw: np.ndarray, which: int = 0) -> np.ndarray:
    up, _ = Powers.upto(len(raw) + 1, which)
    out = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTES[which][raw] * up[: len(raw)], dtype=np.uint64, out=out[1:])
    return out


def names(sums: np.ndarray, starts: np.ndarray, lengths: np.ndarray, which: int = 0) -> np.ndarray:
    """A 64-bit name of each string (start, length): equal strings have equal names."""
    _, down = Powers.upto(len(sums), which)
    return mix((sums[starts + lengths] - sums[starts]) * down[starts]) ^ mix(lengths.astype(np.uint64))


#: Bytes of a word that the sums name; sums modulo 2**64 can be made to collide over many more, whatever the base.
SHORT = 64


def word_hashes(text: str | None) -> np.ndarray:
    """A name of every word of a text, lower-cased in A-Z only. Long words get theirs from a hash of all their bytes."""
    raw = np.frombuffer((text or "").encode("utf-8", "replace").lower(), np.uint8)
    gap = np.ones(len(raw) + 2, bool)
    gap[1:-1] = _SPACE[raw]
    edge = np.flatnonzero(gap[1:] != gap[:-1])
    starts, ends = edge[::2], edge[1::2]
    size = ends - starts
    out = names(prefix_sums(raw), starts, np.minimum(size, SHORT))
    for i in np.flatnonzero(size > SHORT).tolist():
        out[i] = xxhash.xxh3_64_intdigest(raw[starts[i] : ends[i]].tobytes())
    return out


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOWER_BYTES = _BYTES[0][_LOWER]
#: Bytes of texts whose words are named together.
TOGETHER = 1 << 18


def all_word_hashes(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The names that word_hashes() gives, for some texts at a time: the first of these, all their words, and how many each has."""
    texts = texts.fill_null("").cast(pa.large_string())
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(ends, ends[i] + TOGETHER, "right")) - 1)
        raw, edge = data[ends[i] : ends[j]], ends[i : j + 1] - ends[i]
        solid = ~_SPACE[raw]
        first, last = solid.copy(), solid.copy()
        first[1:] &= ~solid[:-1]
        last[:-1] &= ~solid[1:]
        cut = edge[(edge > 0) & (edge < len(raw))]
        first[cut], last[cut - 1] = solid[cut], solid[cut - 1]
        starts = np.flatnonzero(first)
        size = np.flatnonzero(last) + 1 - starts
        up, _ = Powers.upto(len(raw) + 1)
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(_LOWER_BYTES[raw] * up[: len(raw)], dtype=np.uint64, out=sums[1:])
        out = names(sums, starts, np.minimum(size, SHORT))
        for t in np.flatnonzero(size > SHORT).tolist():
            out[t] = xxhash.xxh3_64_intdigest(_LOWER[raw[starts[t] : starts[t] + size[t]]].tobytes())
        yield i, out, np.diff(np.searchsorted(starts, edge))
        i = j
