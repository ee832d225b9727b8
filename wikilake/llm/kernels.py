"""Vectorised byte kernels shared by the text operators.

All kernels work on the UTF-8 buffer of a whole Arrow string column at once, so
no Python object is made per token.  Documents are separated by their offsets:
no token crosses from one document into the next.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_P = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_P_INV = pow(_P, -1, 1 << 64)
#: Bytes handled at once; longer batches are cut between documents.
BLOCK = 1 << 18

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_WORD = np.zeros(256, bool)  # letters of ASCII and every byte of a longer code point
_WORD[0x61:0x7B] = True
_WORD[0x80:] = True


def mix(h: np.ndarray) -> np.ndarray:
    """A finalizer of 64-bit hashes (xor-shift and multiply)."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> U64(27))
    h = h * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


_BYTE = mix(np.arange(1, 257, dtype=U64) * U64(0xD6E8FEB86659FD93))
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        out = np.full(max(n, 1 << 16), base, dtype=U64)
        out[0] = 1
        np.multiply.accumulate(out, out=out)
        if len(out) > BLOCK * 2:
            return out  # one very long text: not kept
        _powers[base] = have = out
    return have


def column(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (n + 1) of a string column; a null is an empty text."""
    a = batch.column(name)
    if a.null_count:
        import pyarrow.compute as pc

        a = pc.fill_null(a, "")
    a = a.cast(pa.large_string()) if not pa.types.is_large_string(a.type) else a
    n = len(a)
    _, off, data = a.buffers()
    offsets = np.frombuffer(off, dtype=np.int64)[a.offset : a.offset + n + 1] if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    raw = raw[offsets[0] : offsets[-1]]
    return raw, offsets - offsets[0]


def blocks(raw: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last, bytes, offsets) of runs of whole documents with about BLOCK bytes."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + BLOCK, "right")) - 1)
        yield i, j, raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def lower_ascii(raw: np.ndarray) -> np.ndarray:
    return _LOWER[raw]


def lower_latin(raw: np.ndarray) -> np.ndarray:
    """Lower case of A-Z and of the capital letters U+00C0 to U+00DE."""
    out = _LOWER[raw]
    if len(out) > 1:
        up = (raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] <= 0x9E) & (raw[1:] != 0x97)
        out[1:][up] += 0x20
    return out


def spans(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and document numbers of the maximal runs where `inside` holds."""
    n = len(inside)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    first = np.zeros(n + 1, bool)
    first[offsets[:-1]] = True
    first = first[:n]
    start = inside.copy()
    start[1:] &= ~inside[:-1] | first[1:]
    stop = inside.copy()
    stop[:-1] &= ~inside[1:] | first[1:]
    s, e = np.flatnonzero(start), np.flatnonzero(stop) + 1
    return s, e, np.searchsorted(offsets, s, "right") - 1


def hash_spans(raw: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each raw[s:e]; equal bytes have equal hashes anywhere."""
    if not len(s):
        return np.zeros(0, U64)
    n = len(raw)
    cum = np.zeros(n + 1, U64)
    np.cumsum(_BYTE[raw] * _power(_P, n)[:n], out=cum[1:])
    h = (cum[e] - cum[s]) * _power(_P_INV, n)[s]
    return mix(h ^ ((e - s).astype(U64) * U64(0xA24BAED4963EE407)))


def words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and document numbers of the words [^\\x20\\x09-\\x0D]+, A-Z lower-cased."""
    low = lower_ascii(raw)
    s, e, d = spans(~_SPACE[low], offsets)
    return hash_spans(low, s, e), d


def letter_words(raw: np.ndarray, offsets: np.ndarray, prefix: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of runs of letters and of their first `prefix` bytes, and document numbers."""
    low = lower_latin(raw)
    s, e, d = spans(_WORD[low], offsets)
    return hash_spans(low, s, e), hash_spans(low, s, np.minimum(e, s + prefix)), d


def windows(h: np.ndarray, d: np.ndarray, counts: np.ndarray, mask: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the tokens at the positions of `mask` in each window within one document, and the
    window's first token.  counts: tokens of each document, in order."""
    span = mask[-1] + 1
    n = len(h) - span + 1
    if n <= 0:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    at = np.flatnonzero(d[:n] == d[span - 1 : span - 1 + n])
    out = np.zeros(n, U64)
    for k, p in enumerate(mask):
        out += h[p : p + n] * U64((2 * k + 1) * 0xC2B2AE3D27D4EB4F & (1 << 64) - 1)
        out ^= out >> U64(29)
    return mix(out[at]), at


def sets(h: np.ndarray, d: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashes of each document, sorted within it, and where each document begins (n + 1)."""
    order = np.lexsort((h, d))
    h, d = h[order], d[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    h, d = h[keep], d[keep]
    return h, np.searchsorted(d, np.arange(n_docs + 1))


def lists(values: np.ndarray, at: np.ndarray) -> pa.Array:
    """An Arrow list column of values[at[i]:at[i + 1]]."""
    return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(values))
