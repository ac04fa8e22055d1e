"""SimHash near-duplicates by covering locality-sensitive hashing.

Fingerprints are links at `radius` or fewer differing bits. Each bit position gets a vector of radius + 1 bits; for each non-zero v of
as many bits, a table masks the fingerprints to the positions whose vector has an odd product with v. The positions in which two
fingerprints differ span at most `radius` dimensions, so some v is orthogonal to all of them: in that table the two collide, always.

Only different fingerprints enter the tables (copies of any number are one). A bucket yields a spanning forest of its links, not its
pairs. A bucket of more than `block` fingerprints is cut into blocks by a hash, and every pair of blocks is compared in a task of its
own, so that no task holds more than two blocks and no link is lost; small buckets are dealt to lots whose number follows that of
their rows. Components come from rounds of hooking and contraction in Spark.

Defined cases: a null or empty text has fingerprint 0; repeated rows are copies; a null doc_id is never a component's id (a component of
null ids only has a null id); an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattica.operators.graph import components

from . import _words
from ._shared import fits, save, small_batches, table

SHINGLE, SEED, RADIUS, BLOCK, LOT = 4, 42, 4, 4096, 4096
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_EACH_BYTE = np.uint64(0x0101010101010101)


def fingerprint(text: bytes, width: int = SHINGLE) -> int:
    words = text.translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        return _majority(np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([np.zeros(1, np.int64), ends[:-1]])
    digest = xxhash.xxh64_intdigest
    spans = zip(starts[: len(words) - width + 1].tolist(), (ends[width - 1 :] - 1).tolist(), strict=True)
    return _majority(np.fromiter((digest(joined[a:b], SEED) for a, b in spans), np.uint64, len(words) - width + 1))


def _majority(h: np.ndarray) -> int:
    """Bits set in over half of the hashes. Eight bits of each hash are counted at once, a byte for each, 255 hashes at a time."""
    n, total = len(h), np.zeros(64, np.int64)
    at = np.arange(0, n, 255)
    for shift in range(8):
        sums = np.add.reduceat((h >> np.uint64(shift)) & _EACH_BYTE, at)
        total[shift::8] = sums.astype("<u8").view(np.uint8).reshape(-1, 8).sum(0, dtype=np.int64)
    return int(sum(1 << k for k in range(64) if 2 * total[k] > n))


def fingerprints(docs: DataFrame, width: int = SHINGLE, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns to keep and the fingerprint fp (long, the 64 bits as signed) of each text."""
    source = small_batches(docs).select(*[docs[c] for c in keep], docs["text"].alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in _words.slices(batches, "__text"):
            fp = np.array([fingerprint(t, width) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*map(part.column, keep), pa.array(fp)], names=[*keep, "fp"])

    return source.mapInArrow(run, T.StructType([*[source.schema[c] for c in keep], T.StructField("fp", T.LongType())]))


def masks(radius: int = RADIUS, bits: int = 64) -> list[int]:
    """The covering masks as signed longs, one for each non-zero v. Position i gets the vector 1 + i mod (2**(radius+1) - 1)."""
    size = 1 << (radius + 1)
    out = []
    for v in range(1, size):
        mask = sum(1 << i for i in range(bits) if bin((1 + i % (size - 1)) & v).count("1") % 2)
        out.append(mask - (1 << 64) if mask >> 63 else mask)
    return out


def forest(a: np.ndarray, b: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what is linked within a (and between a and b), as many as fingerprints at most."""
    every = a if b is None else np.concatenate([a, b])
    side = np.zeros(len(every), bool) if b is None else np.arange(len(every)) >= len(a)
    left, ends = np.arange(len(every)), ([], [])
    while len(left):
        seen, left = [left[0]], left[1:]
        while seen and len(left):
            k = seen.pop()
            near = np.bitwise_count(every[left] ^ every[k]) <= radius
            if b is not None:
                near &= side[left] != side[k]
            new = left[near]
            left = left[~near]
            seen.extend(new.tolist())
            ends[0].append(np.full(len(new), every[k]))
            ends[1].append(every[new])
    empty = np.zeros(0, np.uint64)
    return tuple(np.concatenate([empty, *x]) for x in ends)


def links(distinct: DataFrame, radius: int = RADIUS, block: int = BLOCK, lot: int = LOT) -> DataFrame:
    """u, v: enough links between different fingerprints to connect all that are linked. distinct: fp, each once."""
    rows = distinct.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks(radius)])).alias("mask", "masked"))
    # a table of its own, so that a hot bucket's rows can be split in the join
    sizes = save(rows.groupBy("mask", "masked").agg(F.count("*").alias("n")).where("n > 1"), "sizes")
    rows = save(rows.join(sizes, ["mask", "masked"]), "buckets")

    def linked(u: np.ndarray, v: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({"u": u.view(np.int64), "v": v.view(np.int64)})

    def within(pdf: pd.DataFrame) -> pd.DataFrame:
        fp, mask, masked = (pdf[c].to_numpy() for c in ("fp", "mask", "masked"))
        order = np.lexsort((fp.view(np.uint64), masked, mask))
        fp, mask, masked = fp[order].view(np.uint64), mask[order], masked[order]
        at = np.flatnonzero(np.concatenate([[True], (mask[1:] != mask[:-1]) | (masked[1:] != masked[:-1]), [True]]))
        two = at[:-1][np.diff(at) == 2]  # most buckets
        near = two[np.bitwise_count(fp[two] ^ fp[two + 1]) <= radius]
        parts = [(fp[near], fp[near + 1]), *(forest(fp[a:b], None, radius) for a, b in zip(at[:-1], at[1:], strict=True) if b - a > 2)]
        return linked(*(np.concatenate([p[k] for p in parts]) for k in (0, 1)))

    n_small, largest = rows.agg(F.count_if(F.col("n") <= block), F.max("n")).first()
    lots = max(1, math.ceil(n_small / lot))
    small = rows.where(F.col("n") <= block).withColumn("lot", F.pmod(F.xxhash64("mask", "masked"), F.lit(lots)))
    # a number of partitions of our own: adaptive execution would see few bytes and merge the lots to one task
    out = small.repartition(min(lots, 20_000), "lot").groupBy("lot").applyInPandas(within, "u long, v long")
    if (largest or 0) > block:
        # every pair of a large bucket's blocks, itself included, is a group
        blocks = F.ceil(F.col("n") / block).cast("int")
        own = F.pmod(F.xxhash64("fp", F.lit(radius)), F.ceil(F.col("n") / block)).cast("int")
        large = rows.where(F.col("n") > block).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        large = large.withColumn("lo", F.least("own", "other")).withColumn("hi", F.greatest("own", "other"))

        def between(pdf: pd.DataFrame) -> pd.DataFrame:
            fp, first = pdf["fp"].to_numpy().view(np.uint64), (pdf["own"] == pdf["lo"]).to_numpy()
            return linked(*forest(np.sort(fp[first]), None if pdf["lo"].iloc[0] == pdf["hi"].iloc[0] else np.sort(fp[~first]), radius))

        out = out.unionByName(large.groupBy("mask", "masked", "lo", "hi").applyInPandas(between, "u long, v long"))
    return out.distinct()


def _rooted(distinct: DataFrame, radius: int, block: int) -> DataFrame:
    """distinct (fp, each once, and least) with root, the same for all fingerprints that links connect."""
    root = components(links(distinct.select("fp"), radius, block))
    # what no link touches is its own component
    return save(distinct.join(root, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "roots")


def one_of_each(docs: DataFrame, columns: list[str], radius: int = RADIUS, width: int = SHINGLE, block: int = BLOCK) -> DataFrame:
    """One row of each component of fingerprints, whatever its doc_id: the one with the smallest id (null last), then the smallest hash of the columns; of
    rows that are equal in all of them, one. Rows are decided on by id and hash, and texts stay where they are while the rows that go are few by measure."""
    docs = docs.select(*columns).withColumn("__content", F.xxhash64(*columns))
    key = ["doc_id", "__content"]
    prints = save(fingerprints(docs, width, (*key,)).groupBy(*key, "fp").agg(F.count("*").alias("n")), "fingerprints")
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "__content")
    rooted = _rooted(save(prints.groupBy("fp").agg(F.min(place).alias("least")), "distinct"), radius, block)
    first = save(rooted.groupBy("root").agg(F.min("least").alias("first")), "first")
    of_print = save(rooted.join(first, "root").select("fp", "first"), "classes")
    decided = save(prints.join(of_print, "fp").select(*key, "n", (place == F.col("first")).alias("stays")), "decided")
    named = lambda rows: rows.select(F.col("doc_id").alias("__id"), F.col("__content").alias("__hash"))
    small = lambda rows: F.broadcast(rows) if fits(rows) else rows
    same = docs["doc_id"].eqNullSafe(F.col("__id")) & (docs["__content"] == F.col("__hash"))
    gone, again = named(decided.where("not stays")), named(decided.where("stays and n > 1"))
    left = docs.join(small(gone), same, "left_anti")
    if again.limit(1).count():
        again = small(again)
        left = left.join(again, same, "left_anti").unionByName(docs.join(again, same, "left_semi").dropDuplicates(key))
    return left.select(*columns)


def near_duplicates(docs: DataFrame, radius: int = RADIUS, width: int = SHINGLE, block: int = BLOCK) -> DataFrame:
    """doc_id, fingerprint (hex), component_id: the smallest doc_id that links reach."""
    prints = save(fingerprints(docs, width), "fingerprints")
    distinct = save(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    with_root = _rooted(distinct, radius, block)
    # a table of its own, so that a hot component's rows can be split in the join
    least = save(with_root.groupBy("root").agg(F.min("least").alias("component_id")), "least")
    classes = save(with_root.join(least, "root").select("fp", "component_id"), "classes")
    return prints.join(classes, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op10_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {"op10_simhash_dedup": op10_simhash_dedup}
