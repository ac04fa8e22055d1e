"""Topics learnt from the words of all documents: k-means on a sphere over hashed word counts.

A text's sketch holds the square roots of its words' shares, words lower-cased and hashed to DIMENSIONS places, a byte each. Places are centred
and scaled by mean and deviation over all documents, which weighs down what all texts have, and each sketch then has length 1. Equal sketches count
once in all of this, so that copies, however many, draw no topic to themselves. The k centroids start from a sample of SAMPLE sketches, by the best
of STARTS runs over it; then ROUNDS rounds assign all sketches and move the centroids. Each task sums what it reads, in whole numbers, so that
the result depends on no order; the driver and tasks hold (k + 2) x DIMENSIONS numbers, however many documents there are.

Defined cases: a text without words, or null, has no sketch and the topic `none`, and counts in no sum; rows of equal texts have the same topic;
documents that all have the same sketch are topic-0; fewer distinct sketches than topics make as many topics as there are; ties go to the
smaller number; an empty table gives no topics.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import save

TOPICS, ROUNDS, DIMENSIONS, SAMPLE, STARTS = 8, 5, 256, 1024, 8
_ONE = 4096  # length of a sketch, once scaled
_PIECE = 1 << 20
_SPACE = re.compile(rb"[ \t-\r]")


class _Places(dict):
    """The place of each word, hashed when first seen."""

    def __missing__(self, word: bytes) -> int:
        self[word] = xxhash.xxh3_64_intdigest(word) % DIMENSIONS
        return self[word]


def _pieces(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, a part of about _PIECE bytes at a time."""
    at = 0
    while at < len(text):
        gap = _SPACE.search(text, at + _PIECE)
        to = gap.start() if gap else len(text)
        yield text[at:to].split()
        at = to


def sketch_of(text: bytes | None, places: dict[bytes, int]) -> bytes | None:
    counts = np.zeros(DIMENSIONS, np.int64)
    for words in _pieces(text or b""):
        counts += np.bincount(np.fromiter(map(places.__getitem__, words), np.int64, len(words)), minlength=DIMENSIONS)
    total = counts.sum()
    return np.rint(255 * np.sqrt(counts / total)).astype(np.uint8).tobytes() if total else None


@F.pandas_udf(T.BinaryType())
def _sketches(texts: pd.Series) -> pd.Series:
    places = _Places()
    return pd.Series([sketch_of(t, places) for t in texts], dtype=object)


def sketch(text: Column) -> Column:
    return _sketches(F.lower(text).cast("binary"))


def _matrix(sketches: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(map(bytes, sketches)), np.uint8).reshape(-1, DIMENSIONS).astype(np.int64)


@dataclass(frozen=True)
class Topics:
    mean: np.ndarray
    deviation: np.ndarray
    centroids: np.ndarray  # k x DIMENSIONS

    def scaled(self, x: np.ndarray) -> np.ndarray:
        """Sketches as whole numbers, each of length _ONE or, where nothing tells it from the mean, 0."""
        z = np.divide(x - self.mean, self.deviation, out=np.zeros(x.shape), where=self.deviation > 0)
        length = np.sqrt((z * z).sum(1, keepdims=True))
        return np.rint(_ONE * np.divide(z, length, out=np.zeros(x.shape), where=length > 0)).astype(np.int64)

    def nearest(self, z: np.ndarray) -> np.ndarray:
        return np.argmax(np.rint(z @ self.centroids.T), 1) if len(self.centroids) else np.zeros(len(z), np.int64)

    def of(self, sketch: Column) -> Column:
        """The topic of a sketch."""

        @F.pandas_udf("string")
        def name(sketches: pd.Series) -> pd.Series:
            out = pd.Series(["none"] * len(sketches), dtype=object)
            some = sketches.notna().to_numpy()
            if some.any():
                out[some] = [f"topic-{k}" for k in self.nearest(self.scaled(_matrix(sketches[some])))]
            return out

        return name(sketch)


def moved(centroids: np.ndarray, n: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """Centroids at the mean directions of their sketches; those without any, or whose sketches cancel out, stay."""
    length = np.sqrt((sums.astype(float) ** 2).sum(1, keepdims=True))
    return np.where((n[:, None] > 0) & (length > 0), np.divide(sums, length, out=np.zeros(sums.shape), where=length > 0), centroids)


def _moments(sketches: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, one, two = 0, np.zeros(DIMENSIONS, np.int64), np.zeros(DIMENSIONS, np.int64)
        for part in parts:
            x = _matrix(part["sketch"])
            n, one, two = n + len(x), one + x.sum(0), two + (x * x).sum(0)
        yield pd.DataFrame({"place": np.arange(DIMENSIONS), "n": n, "one": one, "two": two})

    found = sketches.mapInPandas(run, "place int, n long, one long, two long").groupBy("place").agg(F.sum("n").alias("n"), F.sum("one").alias("one"), F.sum("two").alias("two"))
    rows = sorted((r.place, r.n, r.one, r.two) for r in found.collect())  # DIMENSIONS rows
    n = max([1, *(r[1] for r in rows)])
    one, two = (np.array([r[k] for r in rows] or [0] * DIMENSIONS, float) for k in (2, 3))
    return one / n, np.sqrt(np.maximum(two / n - (one / n) ** 2, 0.0))


def _sums(sketches: DataFrame, model: Topics) -> tuple[np.ndarray, np.ndarray]:
    """How many sketches each centroid has, and the sums of them."""
    k = len(model.centroids)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, sums = np.zeros(k, np.int64), np.zeros((k, DIMENSIONS), np.int64)
        for part in parts:
            z = model.scaled(_matrix(part["sketch"]))
            which = model.nearest(z)
            n += np.bincount(which, minlength=k)
            np.add.at(sums, which, z)
        yield pd.DataFrame({"number": np.repeat(np.arange(k), DIMENSIONS), "place": np.tile(np.arange(DIMENSIONS), k), "n": np.repeat(n, DIMENSIONS), "total": sums.ravel()})

    found = sketches.mapInPandas(run, "number int, place int, n long, total long").groupBy("number", "place").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    n, sums = np.zeros(k, np.int64), np.zeros((k, DIMENSIONS), np.int64)
    for r in found.collect():  # k x DIMENSIONS rows
        n[r.number], sums[r.number, r.place] = r.n, r.total
    return n, sums


def _sample(sketches: DataFrame) -> np.ndarray:
    """Up to SAMPLE sketches: of each of so many groups of hashes the least."""
    hashed = sketches.select("sketch", F.xxhash64("sketch").alias("h"))
    least = hashed.groupBy(F.pmod("h", F.lit(SAMPLE)).alias("g")).agg(F.min("h").alias("h")).select("h")  # SAMPLE rows at most
    found = hashed.join(F.broadcast(least), "h", "left_semi").orderBy("h", "sketch").collect()
    return _matrix(pd.Series([r.sketch for r in found], dtype=object))


def started(z: np.ndarray, k: int) -> np.ndarray:
    """Centroids from a sample: of STARTS runs, each from the next k of its rows, the one that comes nearest to all."""
    best, most = np.zeros((0, DIMENSIONS)), -1.0
    for begin in range(0, max(1, min(STARTS * k, len(z) - k + 1)), max(1, k)):
        model = Topics(np.zeros(DIMENSIONS), np.ones(DIMENSIONS), z[begin : begin + k] / _ONE)
        for _ in range(2 * ROUNDS):
            which, sums = model.nearest(z), np.zeros(model.centroids.shape, np.int64)
            np.add.at(sums, which, z)
            model = Topics(model.mean, model.deviation, moved(model.centroids, np.bincount(which, minlength=len(sums)), sums))
        near = float((z @ model.centroids.T).max(1).sum()) if len(z) else 0.0
        if near > most:
            best, most = model.centroids, near
    return best


def fitted(sketches: DataFrame, k: int = TOPICS, rounds: int = ROUNDS) -> Topics:
    """The topics of a table with the column sketch."""
    sketches = save(sketches.select("sketch").where("sketch is not null").distinct(), "sketches")
    model = Topics(*_moments(sketches), np.zeros((0, DIMENSIONS)))
    model = Topics(model.mean, model.deviation, started(model.scaled(_sample(sketches)), k))
    if len(model.centroids):
        for _ in range(rounds):
            model = Topics(model.mean, model.deviation, moved(model.centroids, *_sums(sketches, model)))
    return model
