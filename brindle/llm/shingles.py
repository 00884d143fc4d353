r"""Word shingles of whole texts as 64-bit hashes, computed column-wise inside Arrow batches.

Words are ``[^\x20\x09-\x0D]+`` after lower-casing A-Z only. A text of at least ``width`` words has the set of its
distinct runs of ``width`` words; a shorter one has its whole word sequence as its one shingle; a text without words
(or a null text) has the empty set.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

WIDTH = 5
#: Bytes of text hashed at once; a longer text is hashed in pieces.
CHUNK_BYTES = 1 << 18

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_BLANK = re.compile(rb"[\x20\x09-\x0D]")
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_STOP = np.zeros(256, np.int64)
_STOP[list(b".,;:!?")] = 1
_P, _K = 0x9E3779B97F4A7C15, np.uint64(0xD1342543DE82EF95)
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse; kept for the usual sizes."""
    usual = CHUNK_BYTES + (1 << 16)
    if _powers and n <= usual:
        return [_powers["up"], _powers["down"]]
    out = []
    for base in (_P, pow(_P, -1, 1 << 64)):
        row = np.full(max(n, usual), base, np.uint64)
        row[0] = 1
        out.append(np.multiply.accumulate(row))
    if n <= usual:
        _powers.update(up=out[0], down=out[1])
    return out


def forget() -> None:
    """Powers go; they are made anew when needed."""
    _powers.clear()


def _parts(raw: bytes) -> Iterator[tuple[int, bytes]]:
    """Pieces of about ``CHUNK_BYTES`` that begin and end with white space, and where they begin; a longer word is whole."""
    at = 0
    while len(raw) - at > CHUNK_BYTES + (1 << 15):
        gap = _BLANK.search(raw, at + CHUNK_BYTES)
        if gap.start() == len(raw) - 1:
            break
        yield at, raw[at : gap.end()]
        at = gap.start()
    yield at, raw[at:]


def words(texts: list[bytes], shape: bool = False) -> tuple[np.ndarray, ...]:
    """Hashes of the words of all texts, in order, and where each text's words begin (one more than texts).

    With ``shape`` also two bits for each word: whether it has bytes beyond ASCII, whether it ends in punctuation.
    """
    raw = b" " + b" ".join(texts).translate(_LOWER) + b" "
    hashes, begin, shapes = [], [], []
    for at, part in _parts(raw):
        buf = np.frombuffer(part, np.uint8)
        inside = ~_SPACE[buf]
        edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        starts, ends = edges[::2], edges[1::2]
        up, down = _power(len(buf))
        total = np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * up[: len(buf)])
        hashed = (total[ends - 1] - total[starts - 1]) * down[starts]
        hashes.append(mix(hashed + (ends - starts).astype(np.uint64) * _K))
        begin.append(starts + at)
        if shape:
            beyond = np.concatenate([[0], np.cumsum(buf > 127)])
            shapes.append((beyond[ends] > beyond[starts]) + 2 * _STOP[buf[ends - 1]])
    sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    first = np.searchsorted(np.concatenate(begin), np.concatenate([[1], 1 + np.cumsum(sizes)]))
    return (np.concatenate(hashes), first, np.concatenate(shapes)) if shape else (np.concatenate(hashes), first)


def shingle_sets(texts: list[bytes], width: int = WIDTH) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its shingles."""
    hashed, first = words(texts)
    runs = hashed[: max(0, len(hashed) - width + 1)].copy()
    for i in range(1, width):
        runs = runs * _K + hashed[i : len(runs) + i]
    runs = mix(runs)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= width:
            yield np.unique(runs[a : b - width + 1])
        elif b > a:
            short = np.uint64(b - a)
            for h in hashed[a:b]:
                short = short * _K + h
            yield mix(np.array([short ^ np.uint64(0x5851F42D4C957F2D)]))
        else:
            yield np.empty(0, np.uint64)


def in_chunks(column: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of texts of about ``most`` bytes with the place of the first; a null counts as empty."""
    held, size, at = [], 0, 0
    for i, text in enumerate(column.cast(pa.binary()) if column.type != pa.binary() else column):
        raw = text.as_py() or b""
        if held and size + len(raw) > most:
            yield at, held
            held, size, at = [], 0, i
        held.append(raw)
        size += len(raw) + 1
    if held:
        yield at, held


__all__ = ["CHUNK_BYTES", "WIDTH", "forget", "in_chunks", "mix", "shingle_sets", "words"]
