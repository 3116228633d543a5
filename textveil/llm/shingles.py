"""Hashes of words and of five-word shingles of many texts at once, in numpy.

Words are [^\\x20\\x09-\\x0D]+ of the UTF-8 text, A-Z lower-cased. A word's hash is
a polynomial over its bytes modulo 2^64, mixed; a shingle's combines five of them.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

from textveil.llm import workers

WIDTH = 5
CHUNK_BYTES = 1 << 19

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_P = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_P, -1, 1 << 64)
_STEP = [pow(0xD6E8FEB86659FD93, i + 1, 1 << 64) for i in range(WIDTH)]
_powers: dict[int, np.ndarray] = workers.store("powers")


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: int, n: int) -> np.ndarray:
    held = _powers.get(base)
    if held is None or len(held) < n:
        steps = np.full(max(n, 1 << 16), base, np.uint64)
        steps[0] = 1
        held = _powers[base] = np.multiply.accumulate(steps)
    return held[:n]


def words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word of all texts, and where each text's words end."""
    joined = b"\n".join(texts) + b"\n"
    raw = np.frombuffer(joined.translate(_LOWER), np.uint8)
    space = _SPACE[raw]
    is_start = ~space
    is_start[1:] &= space[:-1]
    starts = np.flatnonzero(is_start)
    ends = np.searchsorted(starts, np.cumsum([len(t) + 1 for t in texts]))
    if not len(starts):
        return np.zeros(0, np.uint64), ends
    values = (raw.astype(np.uint64) + np.uint64(1)) * powers(_P, len(raw))
    values[space] = 0
    hashes = np.add.reduceat(values, starts) * powers(_INVERSE, len(raw))[starts]
    return mix(hashes), ends


def shingles(hashes: np.ndarray, ends: np.ndarray, pad: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each shingle of all texts, and where each text's end (repeats stay).

    A text of fewer words has its whole sequence as one shingle; a text without
    words has none. pad: texts stand between four boundary words on either side,
    so that any shared first or last words show, in short texts too.
    """
    n = np.diff(ends, prepend=0)
    if pad:
        extra = np.where(n > 0, 2 * (WIDTH - 1), 0)
        padded_ends = np.cumsum(n + extra)
        out = np.full(int(padded_ends[-1]) if len(n) else 0, 0x5BD1E995, np.uint64)
        at = np.repeat(padded_ends - n - extra // 2, n) + np.arange(len(hashes)) - np.repeat(ends - n, n)
        out[at] = hashes
        hashes, ends, n = out, padded_ends, n + extra
    counts = np.where(n >= WIDTH, n - WIDTH + 1, (n > 0).astype(n.dtype))
    out_ends = np.cumsum(counts)
    total = int(out_ends[-1]) if len(counts) else 0
    if not total:
        return np.zeros(0, np.uint64), out_ends
    first = np.repeat(ends - n, counts) + np.arange(total) - np.repeat(out_ends - counts, counts)
    length = np.repeat(np.minimum(n, WIDTH), counts)
    spare = np.concatenate([hashes, np.zeros(WIDTH, np.uint64)])
    value = np.zeros(total, np.uint64)
    for i, step in enumerate(_STEP):
        value += np.where(length > i, spare[first + i] * np.uint64(step), np.uint64(0))
    return mix(value + length.astype(np.uint64)), out_ends


def chunks(texts: Iterable[bytes], size: int = CHUNK_BYTES) -> Iterator[list[bytes]]:
    """Lists of texts of about so many bytes; a longer text stands alone."""
    part, held = [], 0
    for t in texts:
        if part and held + len(t) > size:
            yield part
            part, held = [], 0
        part.append(t)
        held += len(t)
    if part:
        yield part
