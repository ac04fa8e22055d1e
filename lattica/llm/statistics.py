"""Statistics of whole texts that the quality rules and the quality classifier share: one pass, one row in, one row out."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import _words
from ._shared import small_batches

SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\v\f\r"
REPEAT_WORDS = 8
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct", "n_upper", "n_lower", "n_digits", "n_punct", "n_exclaim", "n_pipes", "n_long_words", "n_same_words"]
_PUNCT = b".,;:!?'\"()-"


def _class_table() -> np.ndarray:
    kinds = np.zeros((256, 7), bool)
    kinds[ord("A") : ord("Z") + 1, 0] = kinds[ord("a") : ord("z") + 1, 1] = kinds[ord("0") : ord("9") + 1, 2] = True
    for column, members in ((3, _PUNCT), (4, b"!"), (5, b"|"), (6, SYMBOLS)):
        kinds[list(members), column] = True
    return kinds


_KINDS = _class_table()


def of_texts(texts: list[bytes]) -> dict[str, np.ndarray]:
    """COUNTS of each text. Runs of words are compared within their own text only."""
    words, begins = _words.split(texts)
    distinct, ids = _words.numbered(words)
    out = {"n_words": np.diff(begins)}
    out["n_long_words"] = _words.per_text(np.fromiter((len(w) > 24 for w in distinct), bool, len(distinct))[ids], begins)
    owner = np.repeat(np.arange(len(texts)), out["n_words"])
    # words that equal the one before them
    out["n_same_words"] = _words.per_text(np.concatenate([[False], (ids[1:] == ids[:-1]) & (owner[1:] == owner[:-1])])[: len(ids)], begins)
    # equal runs of one text: sort (text, hash of the run) and look at neighbours
    at = np.flatnonzero(_words.full_runs(begins, REPEAT_WORDS))
    key = _words.rolled(_words.hashes(distinct)[ids], REPEAT_WORDS)[at]
    order = np.lexsort((key, owner[at]))
    key, who = key[order], owner[at][order]
    same = (key[1:] == key[:-1]) & (who[1:] == who[:-1])
    twice = np.zeros(len(at), bool)
    twice[1:] |= same
    twice[:-1] |= same
    out["n_repeat_words"] = _words.per_text(_words.covered(at[order[twice]], len(ids), REPEAT_WORDS), begins)
    pair = np.unique(owner * np.int64(len(distinct) + 1) + ids) if len(ids) else ids
    out["n_distinct"] = np.bincount(pair // (len(distinct) + 1), minlength=len(texts))
    seen = np.stack([np.bincount(np.frombuffer(t, np.uint8), minlength=256) for t in texts])
    kinds = seen @ _KINDS
    for column, name in enumerate(("n_upper", "n_lower", "n_digits", "n_punct", "n_exclaim", "n_pipes", "n_symbols")):
        out[name] = kinds[:, column]
    # code points: all bytes but UTF-8's continuation bytes
    out["word_chars"] = seen[:, :128].sum(1) + seen[:, 192:].sum(1) - seen[:, list(SPACES)].sum(1)
    lines = [[x for x in t.split(b"\n") if x.strip()] for t in texts]
    out["n_lines"] = np.fromiter(map(len, lines), np.int64, len(lines))
    out["n_dup_lines"] = np.fromiter((len(x) - len(set(x)) for x in lines), np.int64, len(lines))
    return out


def with_statistics(docs: DataFrame, keep: list[str]) -> DataFrame:
    """Columns `keep` of docs and COUNTS (long) of column text. A null text counts as empty. Other columns are not read."""
    source = small_batches(docs).select(*[docs[c] for c in dict.fromkeys(keep)], docs["text"].alias("__text"))
    schema = T.StructType([source.schema[c] for c in dict.fromkeys(keep)] + [T.StructField(c, T.LongType()) for c in COUNTS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in _words.slices(batches, "__text"):
            counts = of_texts(texts)
            yield pa.RecordBatch.from_arrays([part.column(c) for c in dict.fromkeys(keep)] + [pa.array(counts[c].astype(np.int64)) for c in COUNTS], names=[*dict.fromkeys(keep), *COUNTS])

    return source.mapInArrow(run, schema)
