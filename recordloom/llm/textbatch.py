"""Words and shingles of Arrow text batches as NumPy arrays, without a Python object per word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_ODD = 0x9E3779B97F4A7C15
_GAPS = b" \t\n\x0b\x0c\r"


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit integers (the finalizer of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def spaced_words() -> np.ndarray:
    """Byte table: white space separates (0), A-Z become lower case, other bytes stay."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    table[list(_GAPS)] = 0
    return table


def plain_words() -> np.ndarray:
    """Byte table: every ASCII byte but letters and digits separates, A-Z become lower case."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    keep = np.zeros(256, bool)
    keep[48:58] = keep[97:123] = keep[65:91] = keep[128:] = True
    table[~keep] = 0
    return table


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, and where each text begins; null is empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def pieces(batch: pa.RecordBatch, text: str = "text", size: int = 1 << 19) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about ``size`` bytes of text, one row at least: bounds working memory."""
    for piece, _ in slices(batch, text, size):
        yield piece


def slices(batch: pa.RecordBatch, text: str = "text", size: int = 1 << 19) -> Iterator[tuple[pa.RecordBatch, int]]:
    """``pieces`` with the bytes of text of each; they are told by lengths alone, without a copy of the texts."""
    at = np.append(0, np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(text)), 0), np.int64)))
    first = 0
    while first < len(batch):
        last = max(first + 1, int(np.searchsorted(at, at[first] + size, "right")) - 1)
        yield batch.slice(first, last - first), int(at[last] - at[first])
        first = last
    pa.default_memory_pool().release_unused()  # what a worker that waits for its next task need not hold


def word_spans(data: np.ndarray, at: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Folded bytes, and start, end and text of every word; words never cross texts."""
    folded = table[data]
    inside = folded != 0
    before, after = np.zeros(len(inside), bool), np.zeros(len(inside), bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    edges = at[1:-1][(at[1:-1] > 0) & (at[1:-1] < len(inside))]
    before[edges] = False
    after[edges - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return folded, starts, ends, np.searchsorted(at, starts, "right") - 1


def word_hashes(folded: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of every word's folded bytes."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    inside = np.repeat(np.cumsum(lengths) - lengths, lengths)
    within = np.arange(int(lengths.sum())) - inside
    powers = np.full(int(lengths.max()), _ODD, np.uint64)
    powers[0] = 1
    powers = np.multiply.accumulate(powers)
    values = folded[np.repeat(starts, lengths) + within].astype(np.uint64) * powers[within]
    return mix(np.add.reduceat(values, np.cumsum(lengths) - lengths) ^ (lengths.astype(np.uint64) << np.uint64(56)))


def shingles(hashes: np.ndarray, doc: np.ndarray, n_docs: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every ``width`` successive words and its text; a shorter text with a word is one shingle."""
    words = np.bincount(doc, minlength=n_docs).astype(np.int64)
    first = np.cumsum(words) - words
    full = np.zeros(0, np.int64)
    if len(hashes) >= width:
        full = np.flatnonzero(doc[: len(doc) - width + 1] == doc[width - 1 :])
    acc = np.zeros(len(full), np.uint64)
    short = np.flatnonzero((words > 0) & (words < width))
    acc_short = np.zeros(len(short), np.uint64)
    factor = np.uint64(_ODD)
    for k in range(width):
        acc = acc * factor + hashes[full + k] if len(full) else acc
        has = words[short] > k
        acc_short[has] = acc_short[has] * factor + hashes[first[short[has]] + k]
    found = np.concatenate([mix(acc), mix(acc_short + np.uint64(1))])
    whose = np.concatenate([doc[full], short])
    order = np.argsort(whose, kind="stable")
    return found[order], whose[order]


def by_text(doc: np.ndarray, n_docs: int) -> np.ndarray:
    """Where each text's run begins in an array ordered by text, with the end."""
    return np.searchsorted(doc, np.arange(n_docs + 1))
