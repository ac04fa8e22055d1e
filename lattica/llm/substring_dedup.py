"""Substring dedup by repeated-phrase automata.

A window is `window` consecutive words of one document; every window that also starts earlier is removed. All steps see whole texts:

1. Documents are dealt to shards of about `shard_bytes` where they are read, and saved in buckets by shard, so that no later step moves a
   text. Documents of the same words are one class, known by a 128-bit hash. All but a class's first lose every word if they hold a window.
2. Each window picks a phrase: of its runs of `phrase` words, one whose hash is least. Equal windows pick equal phrases. Spark gathers the
   shards that hold a picked phrase by the phrase's 64-bit hash; phrases of two classes, or found twice in one text, are confirmed (a hash
   that two phrases share confirms both, which costs work but no result). A shard sends a phrase of `slice_bytes` of text once or twice,
   however many of its documents hold it.
3. A shard meets the hashes of the confirmed phrases that occur in it and streams its documents, slice by slice, through Aho-Corasick
   automata of those phrases, words as letters. A window is located if the phrase that it picks is. Every document streams once and every
   automaton is bounded by its slice, so the work is linear in the corpus.
4. Located windows are grouped by a 128-bit hash; the first of each group stays. What the others cover goes, in the shard that holds it.

Defined cases: a null or empty text has no words and keeps the empty text; rows with the same doc_id and words are one document, so none
precedes the other; rows that share a doc_id but not the words are ordered by a hash of the words; a null doc_id comes after all others;
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _words
from ._shared import save, save_bucketed, small_batches, table

WINDOW, PHRASE, SHARD_BYTES, SLICE_BYTES = 20, 6, 8 << 20, 2 << 20
MOST_BUCKETS = 100_000  # Spark's own limit
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
#: A value of Spark's holds less than 2**31 bytes, and a word and a space take two, so no start needs more bits.
_START_BITS = 30


class _Runs:
    """The words of some texts with the hash of the phrase that begins at each, and the least one of each window."""

    def __init__(self, texts: list[bytes] | list[list[bytes]], window: int, phrase: int):
        if texts and isinstance(texts[0], list):
            self.words, self.begins = list(itertools.chain.from_iterable(texts)), np.cumsum([0, *map(len, texts)])
        else:
            self.words, self.begins = _words.split(texts)
        self.distinct, self.ids = _words.numbered(self.words)
        self.word_hash = _words.hashes(self.distinct)
        p = _words.rolled(self.word_hash[self.ids], phrase)
        self.window_at = _words.full_runs(self.begins, window)
        self.p = np.where(_words.full_runs(self.begins, phrase), p, _NONE)
        self.least = _words.sliding(self.p, window - phrase + 1)

    def picked(self, window: int, phrase: int) -> np.ndarray:
        """Where a phrase begins that some window picks."""
        span = window - phrase + 1
        most = np.where(self.window_at, self.least, np.uint64(0))
        back = np.concatenate([np.zeros(span - 1, np.uint64), most])
        return np.flatnonzero((_words.sliding(back, span, np.maximum)[: len(most)] == self.p) & (self.p != _NONE))


def _order_key(doc_id):
    return F.coalesce(doc_id.cast("long"), F.lit((1 << 63) - 1))


def dealt(docs: DataFrame, shard_bytes: int) -> DataFrame:
    """null_id, id, shard, row, h1, h2, n_words and text: the words joined by one space. A task's rows are cut to shards as they come."""
    source = small_batches(docs).select(docs["doc_id"].isNull().alias("null_id"), _order_key(docs["doc_id"]).alias("id"), docs["text"].cast("binary").alias("text"), F.spark_partition_id().alias("part"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = row = 0
        for part, texts in _words.slices(batches):
            words = [t.split() for t in texts]
            texts = [b" ".join(w) for w in words]
            digest = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, texts)), np.int64).reshape(-1, 2)
            upto = size + np.cumsum([0, *map(len, texts)])
            shard = (part.column("part").to_numpy().astype(np.int64) << 32) + upto[:-1] // shard_bytes
            own = [shard, np.arange(row, row + len(texts)), digest[:, 0], digest[:, 1], np.fromiter(map(len, words), np.int64, len(words))]
            size, row = int(upto[-1]), row + len(texts)
            yield pa.RecordBatch.from_arrays([part.column("null_id"), part.column("id"), *map(pa.array, own), pa.array(texts, pa.binary())], names=["null_id", "id", "shard", "row", "h1", "h2", "n_words", "text"])

    return source.mapInArrow(run, "null_id boolean, id long, shard long, row long, h1 long, h2 long, n_words long, text binary")


def confirmed_phrases(docs: DataFrame, window: int, phrase: int) -> DataFrame:
    """shard, phrase: the hashes of the confirmed phrases that occur in each shard, some repeatedly. docs: shard, h1, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in _words.slices(batches, most=SLICE_BYTES):
            runs = _Runs(texts, window, phrase)
            at = runs.picked(window, phrase)
            owner, p = np.repeat(np.arange(len(texts)), np.diff(runs.begins))[at], runs.p[at]
            order = np.lexsort((owner, p))
            owner, p = owner[order], p[order]
            again = np.zeros(len(p), bool)
            again[1:] = (p[1:] == p[:-1]) & (owner[1:] == owner[:-1])
            # found twice in one text counts like found in another: as the complement of the text's hash
            h1 = np.where(again, ~part.column("h1").to_numpy()[owner], part.column("h1").to_numpy()[owner])
            shard = part.column("shard").to_numpy()[owner]
            # of a phrase in a shard the least and the greatest hash tell as much as all
            order = np.lexsort((h1, p, shard))
            shard, p, h1 = shard[order], p[order], h1[order]
            new = np.concatenate([[True], (p[1:] != p[:-1]) | (shard[1:] != shard[:-1])]) if len(p) else np.zeros(0, bool)
            last = np.concatenate([new[1:], [True]]) if len(p) else new
            first = np.flatnonzero(new)
            takes = new | (last & (h1 != np.repeat(h1[first], np.diff([*first, len(p)]))))
            yield pa.RecordBatch.from_arrays([pa.array(p.view(np.int64)[takes]), pa.array(shard[takes]), pa.array(h1[takes])], names=["phrase", "shard", "h1"])

    found = docs.mapInArrow(run, "phrase long, shard long, h1 long")
    # a phrase that very many shards hold is one row of each task, then one in all; the shards that hold it are found by a join, which can be split
    found = save(found, "phrases")
    twice = save(found.groupBy("phrase").agg(F.min("h1").alias("lo"), F.max("h1").alias("hi")).where("lo != hi").select("phrase"), "confirmed")
    return found.select("shard", "phrase").join(twice, "phrase", "left_semi")


class Phrases:
    """An Aho-Corasick automaton over phrases (rows of word numbers). A word is two letters of disjoint alphabets, so that matches begin at
    words and nodes have few children (their number's square root), which the automaton searches one by one."""

    def __init__(self, phrases: np.ndarray, vocabulary: int):
        used = np.unique(phrases)
        self.code = np.zeros(vocabulary, np.int64)  # 0: any other word
        self.code[used] = np.arange(1, len(used) + 1)
        self.base = math.isqrt(len(used)) + 1
        self.machine = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
        whole, width = self.letters(self.code[phrases].ravel()), 2 * phrases.shape[1]
        for k in range(0, len(whole), width):
            self.machine.add_word(whole[k : k + width])
        self.machine.make_automaton()

    def letters(self, codes: np.ndarray) -> str:
        return (np.stack(np.divmod(codes, self.base), 1) + [1, 1 + self.base]).astype("<u4").tobytes().decode("utf-32-le")

    def last_words(self, codes: np.ndarray) -> np.ndarray:
        """Where in the codes a phrase ends."""
        return np.fromiter((end for end, _ in self.machine.iter(self.letters(codes))), np.int64) // 2


def located_windows(texts: list[list[bytes]], confirmed: np.ndarray, window: int, phrase: int) -> list[np.ndarray]:
    """Of each text, the starts of the windows that pick a confirmed phrase. texts: their words; confirmed: hashes of phrases."""
    runs = _Runs(texts, window, phrase)
    starts = _located(runs, confirmed, window, phrase)
    cuts = np.searchsorted(starts, runs.begins)
    return [starts[a:b] - begin for a, b, begin in zip(cuts[:-1], cuts[1:], runs.begins[:-1], strict=True)]


def _located(runs: _Runs, confirmed: np.ndarray, window: int, phrase: int) -> np.ndarray:
    """The starts, among all words, of the windows that pick a confirmed phrase."""
    n, k = len(runs.ids), len(runs.begins) - 1
    at = runs.picked(window, phrase)
    at = at[np.isin(runs.p[at], confirmed)]
    if not len(at):  # only copies of texts in other shards hold them
        return np.zeros(0, np.int64)
    # all texts of a confirmed hash, so that phrases that share one are located both
    every = runs.ids[at[:, None] + np.arange(phrase)]
    _, first, which = np.unique(runs.p[at], return_index=True, return_inverse=True)
    other = (every != every[first][which]).any(1)
    phrases = np.concatenate([every[first], np.unique(every[other], axis=0)])
    machine = Phrases(phrases, len(runs.distinct))
    # texts follow each other, each closed by a word that no phrase holds
    owner = np.repeat(np.arange(k), np.diff(runs.begins))
    stream, hit = np.zeros(n + k, np.int64), np.zeros(n + k, bool)
    stream[np.arange(n) + owner] = machine.code[runs.ids]
    hit[machine.last_words(stream) - (phrase - 1)] = True
    near = _words.sliding(np.where(hit[np.arange(n) + owner], runs.p, _NONE), window - phrase + 1)
    return np.flatnonzero(runs.window_at & (near == runs.least))


def located(docs: DataFrame, side: DataFrame, window: int, phrase: int) -> DataFrame:
    """shard, row, id, doc, and of the located windows starts and two halves a and b of their hashes; a row for each of docs that has any.
    docs: shard, row, id, h1, text; side: shard, and either a phrase's hash (is_phrase) or the row of a text that is not its class's first."""

    def of_shard(key: tuple, rows: pd.DataFrame, side: pd.DataFrame) -> pd.DataFrame:
        out, is_phrase = [], side["is_phrase"].to_numpy(bool)
        phrases = side["phrase"].to_numpy(np.int64)[is_phrase].view(np.uint64)
        rows = rows[~rows["row"].isin(side["row"].to_numpy(np.int64)[~is_phrase])] if len(phrases) else rows[:0]
        size = np.cumsum([len(t) for t in rows["text"]])
        cuts = [0, *(np.flatnonzero(np.diff(size // SLICE_BYTES)) + 1), len(rows)]
        for begin, end in zip(cuts[:-1], cuts[1:], strict=True):
            part = rows.iloc[begin:end]
            runs = _Runs([bytes(t) for t in part["text"]], window, phrase)
            starts = _located(runs, phrases, window, phrase)
            digest = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, runs.distinct)), np.uint64).reshape(-1, 2)
            a, b = (_words.rolled(digest[:, k][runs.ids], window)[starts].view(np.int64) for k in (0, 1))
            at = np.searchsorted(starts, runs.begins)
            for k, (row, i, h) in enumerate(zip(part["row"], part["id"], part["h1"], strict=True)):
                own = slice(at[k], at[k + 1])
                if at[k] < at[k + 1]:
                    # the upper bits of the document's hash order rows that share an id
                    out.append((key[0], row, i, (h & (1 << 64) - 1) >> (_START_BITS + 1), (starts[own] - runs.begins[k]).astype(np.int32), a[own], b[own]))
        return pd.DataFrame(out, columns=["shard", "row", "id", "doc", "starts", "a", "b"])

    return docs.groupBy("shard").cogroup(side.groupBy("shard")).applyInPandas(of_shard, "shard long, row long, id long, doc long, starts array<int>, a array<long>, b array<long>")


def later_windows(found: DataFrame) -> DataFrame:
    """shard, row, starts: of each text, the starts of located windows that an equal window precedes. found: the rows of located()."""
    each = found.select("id", "doc", F.explode(F.arrays_zip("starts", "a", "b")).alias("w")).select("id", "w.a", "w.b", F.shiftleft("doc", _START_BITS).bitwiseOR(F.col("w.starts").cast("long")).alias("lo"))
    first = each.groupBy("a", "b").agg(F.min(F.struct("id", "lo")).alias("at"))
    start = F.col("at.lo").bitwiseAND(F.lit((1 << _START_BITS) - 1)).cast("int")
    first = first.select("at.id", F.shiftrightunsigned("at.lo", _START_BITS).alias("doc"), start.alias("start")).groupBy("id", "doc").agg(F.collect_list("start").alias("firsts"))
    later = F.when(F.col("firsts").isNull(), F.col("starts")).otherwise(F.array_except("starts", "firsts"))
    return found.select("shard", "row", "id", "doc", "starts").join(first, ["id", "doc"], "left").select("shard", "row", later.alias("starts")).where(F.size("starts") > 0)


def kept_words(docs: DataFrame, side: DataFrame, window: int) -> DataFrame:
    """null_id, id, n_words, n_removed, kept. docs: those of dealt(); side: shard, row, and starts of windows to remove, or null to remove all."""

    def of_shard(key: tuple, rows: pd.DataFrame, side: pd.DataFrame) -> pd.DataFrame:
        goes, n_removed, kept = dict(zip(side["row"], side["starts"], strict=True)), [], []
        for row, n, text in zip(rows["row"], rows["n_words"], rows["text"], strict=True):
            starts = goes.get(row, ())
            if starts is None:
                n_removed.append(n)
                kept.append(b"")
            elif not len(starts):
                n_removed.append(0)
                kept.append(text)
            else:
                gone = _words.covered(np.asarray(starts, np.int64), n, window)
                n_removed.append(int(gone.sum()))
                kept.append(b" ".join(itertools.compress(bytes(text).split(), (~gone).tolist())))
        return rows[["null_id", "id", "n_words"]].assign(n_removed=np.array(n_removed, np.int64), kept=kept)

    return docs.select("null_id", "id", "shard", "row", "n_words", "text").groupBy("shard").cogroup(side.groupBy("shard")).applyInPandas(of_shard, "null_id boolean, id long, n_words long, n_removed long, kept binary")


def deduplicated(docs: DataFrame, window: int = WINDOW, phrase: int = PHRASE, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text (kept words joined by one space). docs: doc_id, text."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # tasks leave shards that are not full, so more buckets than full shards
    texts = save_bucketed(dealt(docs, shard_bytes), "texts", min(MOST_BUCKETS, 16 + 2 * math.ceil(size / shard_bytes)), "shard")
    known = texts.where(F.col("n_words") >= window).select("id", "shard", "row", "h1", "h2")
    # a table of its own, so that the rows of a hot class can be split in the join
    first = save(known.groupBy("h1", "h2").agg(F.min("id").alias("first_id"), F.max("id").alias("last_id")).where("first_id != last_id"), "classes")
    copies = save(known.join(first, ["h1", "h2"]).where("id != first_id").select("shard", "row"), "copies")
    zero = F.lit(0).cast("long")
    phrases = confirmed_phrases(texts.select("shard", "h1", "text"), window, phrase).select("shard", "phrase", zero.alias("row"), F.lit(True).alias("is_phrase"))
    side = phrases.unionByName(copies.select("shard", zero.alias("phrase"), "row", F.lit(False).alias("is_phrase")))
    found = save(located(texts.select("shard", "row", "id", "h1", "text"), side, window, phrase), "located")
    gone = later_windows(found).unionByName(copies.withColumn("starts", F.lit(None).cast("array<int>")))
    out = kept_words(texts, gone, window)
    return out.select(F.when(~F.col("null_id"), F.col("id")).alias("doc_id"), "n_words", "n_removed", F.col("kept").cast("string").alias("kept_text"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


QUERIES = {"op5_substring_dedup": op5_substring_dedup}
#: For tables whose doc_id tells rows apart.
ORACLE_SQL = {
    "op5_substring_dedup": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
w AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS k FROM d),
r AS (SELECT *, string_agg(word, ' ') OVER f AS run, count(*) OVER f AS n FROM w WINDOW f AS (PARTITION BY doc_id ORDER BY k ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)),
later AS (SELECT doc_id, k FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY doc_id, k) AS place FROM r WHERE n = 20) WHERE place > 1),
g AS (SELECT w.doc_id, w.k, word, sum(CASE WHEN later.k IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY w.doc_id ORDER BY w.k ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) > 0 AS gone
  FROM w LEFT JOIN later ON later.doc_id = w.doc_id AND later.k = w.k),
s AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY k) FILTER (NOT gone) AS kept FROM g GROUP BY doc_id)
SELECT d.doc_id, len(words)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN s ON d.doc_id = s.doc_id
"""
}
