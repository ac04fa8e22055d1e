"""Words of whole texts as numpy arrays. A word is a maximal run of bytes other than space and 0x09-0x0D, which is what bytes.split() yields."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

SLICE_BYTES = 2 << 20
_R = np.uint64(0x9E3779B97F4A7C15)  # odd, so that it has an inverse modulo 2**64
_R_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Parts of the batches of about `most` bytes of text (one row at least, however long), with the texts as UTF-8; a null text is empty."""
    for batch in batches:
        text = batch.column(column).cast(pa.binary())
        size = np.cumsum(pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            before = size[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(size, before + most, "right")))
            yield batch.slice(at, to - at), [t or b"" for t in text.slice(at, to - at).to_pylist()]
            at = to


def split(texts: list[bytes]) -> tuple[list[bytes], np.ndarray]:
    """All words of the texts, and where each text's words begin (one entry more than texts)."""
    words: list[bytes] = []
    begins = np.zeros(len(texts) + 1, np.int64)
    for k, text in enumerate(texts):
        words += text.split()
        begins[k + 1] = len(words)
    return words, begins


def numbered(words: list[bytes]) -> tuple[list[bytes], np.ndarray]:
    """The distinct words, and for each word its place among them."""
    place = dict.fromkeys(words)
    for k, word in enumerate(place):
        place[word] = k
    return list(place), np.fromiter(map(place.__getitem__, words), np.int64, len(words))


def hashes(distinct: list[bytes], seed: int = 0) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(w, seed) for w in distinct), np.uint64, len(distinct))


def rolled(values: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of `width` values, by its first; the last width - 1 entries stand for no run and are 0."""
    n, out = len(values), np.zeros(len(values), np.uint64)
    if n < width:
        return out
    power = np.full(n, _R, np.uint64)
    power[0] = 1
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * np.multiply.accumulate(power), dtype=np.uint64)])
    back = np.full(n - width + 1, _R_INV, np.uint64)
    back[0] = 1
    out[: n - width + 1] = (total[width:] - total[: n - width + 1]) * np.multiply.accumulate(back)
    out ^= out >> np.uint64(31)
    out *= np.uint64(0xD6E8FEB86659FD93)
    out ^= out >> np.uint64(32)
    return out


def full_runs(begins: np.ndarray, width: int) -> np.ndarray:
    """For each word, whether a run of `width` words of its own text begins there."""
    ends = np.repeat(begins[1:], np.diff(begins))
    return np.arange(len(ends)) + width <= ends


def sliding(values: np.ndarray, width: int, pick=np.minimum) -> np.ndarray:
    """pick over values[i : i + width]; near the end over what there is."""
    out, have = values.copy(), 1
    while have < width:
        step = min(have, width - have)
        if step >= len(out):
            break
        out[:-step] = pick(out[:-step], out[step:])
        have += step
    return out


def covered(starts: np.ndarray, n: int, width: int) -> np.ndarray:
    """Which of n words lie in a run of `width` that begins at one of `starts` (the runs do not leave their texts)."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, np.minimum(starts + width, n), -1)
    return np.cumsum(change[:n]) > 0


def per_text(flags: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Sum of the flags of each text's words."""
    total = np.concatenate([np.zeros(1, np.int64), np.cumsum(flags, dtype=np.int64)])
    return total[begins[1:]] - total[begins[:-1]]
