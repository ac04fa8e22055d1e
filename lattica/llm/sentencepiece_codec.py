"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie of pieces with log scores.

The vocabulary comes from a model file (a parameter); its size bounds what is broadcast. Pieces are ranked in the file, and a piece's log
score is that of Zipf's law for its rank, or the file's own score. White space is marked by U+2581, one mark is put in front of each text, and what
no piece covers falls back to byte pieces, as do marks that a text itself holds, so that they come back as marks. Pieces with marks elsewhere
than in front, which some models have, are not used, so a text splits into words before each mark, and each distinct word of a slice is segmented once: numpy walks the trie for all words and all starts together, then the best path for all words
position by position. Of equal paths the one whose last piece is longest wins, then the one before it, and so on.

Defined cases: a null text has null ids and decodes to null; an empty text has no ids; unpaired or invalid bytes are replaced as UTF-8 decoding
does; very long words are segmented in slices of their own like any other; repeated rows are encoded each; an empty table gives an
empty result; other columns are only carried if asked for, those named like an added one as <name>_input.
"""

from __future__ import annotations

import os
import pickle
import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _words
from ._shared import small_batches, table, unclashed

MODEL = os.environ.get("LATTICA_PIECE_MODEL", "/opt/tokenizers/piece_bpe_32k.model")
MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, BYTE = 1, 2, 3, 4, 6
UNKNOWN_PENALTY = 10.0
#: Words whose segmentation a Python worker remembers; others are segmented again in each slice.
KNOWN_WORDS = 40_000
#: Text that is segmented at once.
SLICE_BYTES = 256 << 10
_OPEN = -1e30
_LITERAL = ""  # stands among words for a mark of the text's own
#: A run of marks stays with the word that follows it.
_WORD = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = data[at]
        value, shift, at = value | (b & 127) << shift, shift + 7, at + 1
        if b < 128:
            return value, at


def _fields(data: bytes) -> Iterator[tuple[int, int, object]]:
    """(field number, wire type, value) of a protocol buffer message."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(data, at)
        elif kind == 2:
            size, at = _varint(data, at)
            value, at = data[at : at + size], at + size
        else:
            size = 4 if kind == 5 else 8
            value, at = data[at : at + size], at + size
        yield key >> 3, kind, value


def read_pieces(model: bytes) -> list[tuple[str, float, int]]:
    """(piece, score, type) of each id."""
    out = []
    for number, _, value in _fields(model):
        if number == 1:
            piece = {n: v for n, _, v in _fields(value)}
            out.append((piece[1].decode(), struct.unpack("<f", piece.get(2, b"\0\0\0\0"))[0], piece.get(3, NORMAL)))
    return out


def zipf_scores(pieces: list[tuple[str, float, int]]) -> np.ndarray:
    """Log probabilities by Zipf's law over the rank of the file's scores."""
    order = sorted(range(len(pieces)), key=lambda k: (-pieces[k][1], k))
    rank = np.empty(len(pieces))
    rank[order] = np.arange(1, len(pieces) + 1)
    return -np.log(rank) - np.log(np.sum(1 / np.arange(1, len(pieces) + 1)))


class Trie:
    """A double array over UTF-8 bytes: state s goes by byte c to base[s] + c + 1 if check of that is s."""

    def __init__(self, keys: list[bytes]):
        order = sorted(range(len(keys)), key=lambda k: keys[k])
        size = 1 << max(12, (4 * sum(map(len, keys))).bit_length())
        self.base, self.check, self.value = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
        free = bytearray(b"\1") * size
        free[0] = 0
        # states with one child fill the holes behind the states with several, which are placed in front only
        hole, front = 1, 1
        todo = [(0, 0, len(keys), 0)]  # state, range of sorted keys, depth
        while todo:
            state, a, b, depth = todo.pop()
            if a < b and len(keys[order[a]]) == depth:
                self.value[state] = order[a]
                a += 1
            if a == b:
                continue
            heads = [keys[order[k]][depth] + 1 for k in range(a, b)]
            cuts = [0, *(k for k in range(1, len(heads)) if heads[k] != heads[k - 1]), len(heads)]
            codes = [heads[k] for k in cuts[:-1]]
            if len(codes) == 1:
                hole = free.index(1, hole)
                slot = free.index(1, max(hole, codes[0]))
                base = slot - codes[0]
            else:
                base = front
                while not all(free[base + c] for c in codes):
                    base += 1
                front = max(front, base - 256)
            if base + 1024 >= len(free):
                self._grow()
                free += bytearray(b"\1") * len(free)
            self.base[state] = base
            for c, x, y in zip(codes, cuts[:-1], cuts[1:], strict=True):
                free[base + c] = 0
                self.check[base + c] = state
                todo.append((base + c, a + x, a + y, depth + 1))

    def _grow(self) -> None:
        n = len(self.base)
        self.base = np.concatenate([self.base, np.zeros(n, np.int32)])
        self.check, self.value = (np.concatenate([x, np.full(n, -1, np.int32)]) for x in (self.check, self.value))

    def step(self, states: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The next states, -1 where there is none."""
        to = self.base[states] + codes + 1
        return np.where(self.check[to] == states, to, -1)


class Codec:
    def __init__(self, pieces: list[tuple[str, float, int]], scores: np.ndarray | None = None):
        """scores: a log score for each id; Zipf's law over the ranks if not given."""
        # multiples of 2**-20 add up without rounding, so that equal paths are equal
        scores = np.round((zipf_scores(pieces) if scores is None else np.asarray(scores, float)) * (1 << 20)) / (1 << 20)
        usable = [k for k, (text, _, kind) in enumerate(pieces) if kind in (NORMAL, USER) and MARK not in text.lstrip(MARK) and text]
        self.pieces = pieces
        self.trie = Trie([pieces[k][0].encode() for k in usable])
        self.ids, self.scores = np.array(usable, np.int32), scores[usable]
        self.unknown_score = self.scores.min() - UNKNOWN_PENALTY
        self.unknown_id = next((k for k, p in enumerate(pieces) if p[2] == UNKNOWN), 0)
        self.byte_ids = np.full(256, self.unknown_id, np.int32)
        for k, (text, _, kind) in enumerate(pieces):
            if kind == BYTE:
                self.byte_ids[int(text[3:5], 16)] = k
        self.longest = max(len(pieces[k][0].encode()) for k in usable)
        self.is_byte = np.array([p[2] == BYTE for p in pieces])
        spelt = [bytes([int(text[3:5], 16)]) if kind == BYTE else text.replace(MARK, " ").encode() if kind in (NORMAL, USER) else b"" for text, _, kind in pieces]
        # segmentations that later slices use again
        self.known: dict[str, int] = {_LITERAL: 0}
        self.known_ids = self.byte_ids[list(MARK.encode())]
        self.known_at = np.array([0, len(self.known_ids)])
        self.spelling, self.spelt = np.frombuffer(b"".join(spelt), np.uint8), np.cumsum([0, *map(len, spelt)])

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Codec:
        """From a file that the driver can open, or else any that Spark can read."""
        if os.path.exists(path):
            with open(path, "rb") as f:
                return cls(read_pieces(f.read()))
        return cls(read_pieces(bytes(spark.read.format("binaryFile").load(path).first()["content"])))

    def segment(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words (bytes, marks as U+2581), and where each word's ids begin."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(size, kind="stable")
        parts, counts, a = [np.zeros(0, np.int32)], np.zeros(len(words), np.int64), 0
        while a < len(order):
            # words of like length share a matrix of about a million cells
            width = int(1.5 * size[order[a]]) + 8
            b = min(int(np.searchsorted(size[order], width, "right")), a + max(1, (1 << 20) // width))
            ids, n = self._segment([words[k] for k in order[a:b].tolist()])
            parts.append(ids)
            counts[order[a:b]] = n
            a = b
        flat, begins = np.concatenate(parts), np.concatenate([[0], np.cumsum(counts[order])])
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        return _gathered(flat, begins, back)

    def _segment(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        n, size = len(words), np.fromiter(map(len, words), np.int32, len(words))
        width = int(size.max(initial=0)) + 1  # a zero closes each row, and no piece holds one
        if width == 1:
            return np.zeros(0, np.int32), np.zeros(n, np.int64)
        flat = np.frombuffer(b"".join([w.ljust(width, b"\0") for w in words]), np.uint8).astype(np.int32)
        head = (flat & 0xC0) != 0x80  # a character begins
        head &= (np.arange(width, dtype=np.int32) < size[:, None]).ravel()
        heads = np.flatnonzero(head).astype(np.int32)
        # all pieces that begin anywhere: place in flat, length, piece
        place, state, found, length = heads, np.zeros(len(heads), np.int32), [], 0
        while len(place) and length < self.longest:
            state = self.trie.step(state, flat[place + length])
            length += 1
            ok = state >= 0
            place, state = place[ok], state[ok]
            value = self.trie.value[state]
            ends = value >= 0
            found.append((place[ends], np.full(int(ends.sum()), length, np.int32), value[ends]))
            if length == 1:
                alone = found[0][0]
        # a character that is no piece by itself may stand as unknown
        chars = flat[heads]
        chars = np.where(chars < 0x80, 1, np.where(chars < 0xE0, 2, np.where(chars < 0xF0, 3, 4))).astype(np.int32)
        known = np.zeros(len(flat), bool)
        known[alone] = True
        for p, k, _ in found[1:4]:
            known[p[(flat[p] >= 0xC0) & (k == np.where(flat[p] < 0xE0, 2, np.where(flat[p] < 0xF0, 3, 4)))]] = True
        other = ~known[heads]
        row_end = (heads[other] // width) * width + size[heads[other] // width]
        found.append((heads[other], np.minimum(chars[other], row_end - heads[other]).astype(np.int32), np.full(int(other.sum()), -1, np.int32)))
        place, length, value = (np.concatenate(x) for x in zip(*found, strict=True))
        # by end, shorter pieces first, so that among equals the longest is written last
        key = (place % width + length).astype(np.int64) * (self.longest + 1) + length
        if key.max() < 1 << 16:
            key = key.astype(np.uint16)  # numpy then sorts by radix
        order = np.argsort(key, kind="stable")
        place, length, value, key = place[order], length[order], value[order], key[order]
        score = np.where(value >= 0, self.scores[value], self.unknown_score)
        best, by = np.full(len(flat), _OPEN), np.zeros(len(flat), np.int32)  # by: the last piece's number among the found
        best[::width] = 0
        cuts = np.flatnonzero(key[1:] != key[:-1]) + 1
        for a, b in zip([0, *cuts], [*cuts, len(key)], strict=True):
            to = place[a:b] + length[a]
            total = best[place[a:b]] + score[a:b]
            better = np.flatnonzero(total >= best[to])
            to = to[better]
            best[to] = total[better]
            by[to] = better + a
        # backwards, all words at once
        at, live, path = np.arange(n, dtype=np.int64) * width + size, np.flatnonzero(size > 0), []
        while len(live):
            last = by[at[live]]
            path.append((live, last))
            at[live] = place[last]
            live = live[place[last] % width > 0]
        word, last = (np.concatenate(x) for x in zip(*path, strict=True))
        place, length, value = place[last], length[last], value[last]
        order = np.argsort(place, kind="stable")
        word, place, length, value = word[order], place[order], length[order], value[order]
        # what no piece covers becomes its bytes
        times = np.where(value >= 0, 1, length)
        which = np.repeat(np.arange(len(word)), times)
        within = np.arange(len(which)) - np.repeat(np.cumsum(times) - times, times)
        ids = np.where(value[which] >= 0, self.ids[value[which]], self.byte_ids[flat[place[which] + np.where(value[which] >= 0, 0, within)]])
        return ids.astype(np.int32), np.bincount(word[which], minlength=n)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, and where each text's ids begin."""
        words, begins = [], [0]
        for t in texts:
            if t:
                front, *more = t.split(MARK)
                words += _WORD.findall(MARK + front.replace(" ", MARK))
                for part in more:
                    words += [_LITERAL, *_WORD.findall(part.replace(" ", MARK))]
            begins.append(len(words))
        new = [w for w in dict.fromkeys(words) if w not in self.known]
        ids, at = self.segment([w.encode() for w in new])
        ids, at = np.concatenate([self.known_ids, ids]), np.concatenate([self.known_at[:-1], at + self.known_at[-1]])
        for k, w in enumerate(new, len(self.known)):
            self.known[w] = k
        out, places = _gathered(ids, at, np.fromiter(map(self.known.__getitem__, words), np.int64, len(words)))
        if len(self.known) <= KNOWN_WORDS:
            self.known_ids, self.known_at = ids, at
        else:
            for w in new:
                del self.known[w]
        return out, places[begins]

    def decode(self, ids: np.ndarray, begins: np.ndarray) -> list[str]:
        """The text of each range of ids."""
        data, at = _gathered(self.spelling, self.spelt, ids)
        data = data.tobytes()
        cuts = at[begins].tolist()
        return [data[a:b].decode("utf-8", "replace").removeprefix(" ") for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def _gathered(flat: np.ndarray, begins: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The chosen ranges of flat one after the other, and where each begins."""
    size = np.diff(begins)[chosen]
    to = np.concatenate([[0], np.cumsum(size)])
    return flat[np.repeat(begins[:-1][chosen] - to[:-1], size) + np.arange(to[-1])], to


@lru_cache(maxsize=2)
def _unpacked(data: bytes) -> Codec:
    return pickle.loads(data)


def encoded(docs: DataFrame, keep: list[str], model: str = MODEL) -> DataFrame:
    """Columns `keep`, ids, n_bytes (how many ids are byte pieces) and decoded. docs: text and `keep`."""
    spark = docs.sparkSession
    docs, keep = unclashed(docs, keep, ["ids", "n_bytes", "decoded"])
    shared = spark.sparkContext.broadcast(pickle.dumps(Codec.load(spark, model)))
    source = small_batches(docs).select(*[docs[c] for c in keep], docs["text"].alias("__text"))
    schema = T.StructType([*(source.schema[c] for c in keep), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("n_bytes", T.LongType()), T.StructField("decoded", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _unpacked(shared.value)
        for part, raw in _words.slices(batches, "__text", SLICE_BYTES):
            null = part.column("__text").is_null().to_pylist()
            ids, at = codec.encode([t.decode("utf-8", "replace") for t in raw])
            decoded = [None if skip else t for t, skip in zip(codec.decode(ids, at), null, strict=True)]
            n_bytes = pa.array(_words.per_text(codec.is_byte[ids], at), mask=np.array(null, bool))
            listed = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids), mask=pa.array(null))
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), listed, n_bytes, pa.array(decoded, pa.string())], names=[*keep, "ids", "n_bytes", "decoded"])

    return source.mapInArrow(run, schema)


def digest(rows: DataFrame) -> DataFrame:
    """rows of encoded() with doc_id and text: doc_id, n_ids, n_bytes, ids_sha256 (ids joined by commas), round_trip."""
    ids = F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256)
    return rows.select("doc_id", F.when(F.col("ids").isNotNull(), F.size("ids").cast("long")).alias("n_ids"), "n_bytes", ids.alias("ids_sha256"), F.col("decoded").eqNullSafe(F.col("text")).alias("round_trip"))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(encoded(table(spark, sf_dir, "documents"), ["doc_id", "text"]))


QUERIES = {"op3_sentencepiece": op3_sentencepiece}
