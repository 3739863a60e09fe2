"""Pieces of folded texts, by which texts and terms meet before they are compared.

Folding keeps ASCII letters (lower-cased), digits, kana, Chinese characters and Hangul, and drops every other character. It goes character by character, so what a text holds, its folded
text holds folded; and lower-casing a text or dropping spaces, punctuation and signs from it leaves its folded text as it was.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle

# these functions travel to executors by value: a worker needs no copy of the repository
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Characters that neither lower-casing nor the normalisations of functions/text.py change.
KEPT = [(0x30, 0x39), (0x61, 0x7A), (0x3041, 0x3096), (0x30A1, 0x30FA), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xAC00, 0xD7A3)]
#: Bytes of text that are folded at once.
STRETCH = 4 << 20


def fold_table() -> np.ndarray:
    """By code point: the character that it folds to, 0 for none. Two signs beyond ASCII have ASCII letters in lower case."""
    table = np.zeros(0x110000, dtype=np.uint16)
    for a, z in KEPT:
        table[a : z + 1] = np.arange(a, z + 1)
    table[0x41:0x5B] = np.arange(0x61, 0x7B)
    table[0x130], table[0x212A] = ord("i"), ord("k")
    return table


def folded(texts: list[str], table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The folded texts one after another, and where each starts."""
    points = np.frombuffer("".join(texts).encode("utf-32-le", "replace"), dtype=np.uint32)
    codes = table[points]
    kept = np.flatnonzero(codes)
    starts = np.cumsum([0, *map(len, texts)])[:-1]
    return codes[kept], np.searchsorted(kept, starts)


def hashes(pieces: np.ndarray) -> np.ndarray:
    """Hashes of pieces of a power of two characters, a row each."""
    words = pieces.astype(np.uint64) if pieces.shape[1] < 4 else np.ascontiguousarray(pieces).view(np.uint64)
    out = np.full(len(words), pieces.shape[1], dtype=np.uint64)
    for k in range(words.shape[1]):
        out = (out ^ words[:, k]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(32)
    return out * np.uint64(0xD6E8FEB86659FD93)


class Known:
    """Sorted hashes, with a table of their first bits that most others fail at."""

    def __init__(self, wanted: np.ndarray):
        self.wanted, bits = wanted, max(12, len(wanted).bit_length() + 4)
        self.shift, self.first = np.uint64(64 - bits), np.zeros(1 << bits, dtype=bool)
        self.first[wanted >> self.shift] = True

    def places(self, made: np.ndarray) -> np.ndarray:
        """Where in ``made`` known hashes are."""
        likely = np.flatnonzero(self.first[made >> self.shift])
        found = np.searchsorted(self.wanted, made[likely]).clip(max=len(self.wanted) - 1)
        return likely[self.wanted[found] == made[likely]]


def stretches(texts: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """Texts of about STRETCH bytes in all, and the first one's number; null as empty, broken characters replaced."""
    ends, at = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64), 0
    while at < len(ends):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + STRETCH, "right")))
        part = pc.fill_null(texts.slice(at, to - at), "")
        try:
            yield at, part.to_pylist()
        except UnicodeDecodeError:
            yield at, [b.decode("utf-8", "replace") for b in part.cast(pa.binary()).to_pylist()]
        at = to


def pieces_of(texts: pa.Array, sizes: list[int], known: Known | None, table: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Numbers of texts and hashes of the pieces that begin in them, of those known, once for each text.

    Pieces are cut from the texts of a stretch one after another. Those that reach into the next text are no harm: each run of 2 * size - 1 characters of a text holds a whole piece.
    """
    for first, part in stretches(texts):
        codes, starts = folded(part, table)
        for n in sizes:
            made = hashes(codes[: len(codes) // n * n].reshape(-1, n))
            at = np.arange(len(made)) if known is None else known.places(made)
            row, g = np.searchsorted(starts, at * n, "right") - 1 + first, made[at]
            order = np.lexsort((g, row))
            row, g = row[order], g[order]
            new = np.ones(len(row), dtype=bool)
            new[1:] = (row[1:] != row[:-1]) | (g[1:] != g[:-1])
            yield row[new], g[new].view(np.int64)


def ends_of(terms: list[str], most: int, table: np.ndarray) -> tuple[int, list[np.ndarray]]:
    """The largest size of piece, up to ``most``, that some term holds wherever it is cut, and the hashes of all such pieces of each end of the terms that allow it. Size 0: nothing is left of the terms."""
    bare = [folded([t], table)[0] for t in terms]
    n = max(((len(t) + 1) // 2 for t in bare), default=0)
    n = min(1 << n.bit_length() >> 1, most)
    ends = {end.tobytes(): end for t in bare if n and len(t) >= 2 * n - 1 for end in (t[: 2 * n - 1], t[len(t) - 2 * n + 1 :])}
    return n, [np.unique(hashes(np.lib.stride_tricks.sliding_window_view(end, n))).view(np.int64) for end in ends.values()]
