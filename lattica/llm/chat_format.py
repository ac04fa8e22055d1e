"""Chat formatting: transcripts are parsed by a hidden Markov model and rendered as canonical turns.

Each line shows a speaker marker (a fixed word and a colon in front of it, or the role that came with the row on the row's first line) and
features: whether a row begins, a question, a command-like head (its first word is one of a list of imperatives), length. States are system,
user and assistant. How conversations begin, how roles follow each other from row to row, and what each role's lines look like is counted in Spark over
the rows that keep their role, with the tables below as if they had been seen PRIOR times; so a table without roles is parsed by those alone. Viterbi finds the most likely roles, with scores in whole millionths of a unit, so that sums are exact in any order. A
marker is taken off a line only if the line's decoded role is the one that it names. A conversation may be of any length: rows are ranged by
conversation and turn into parts; where a conversation reaches over parts, each part's lines become one max-plus matrix (what the best path
from any state to any other scores), the few matrices of a conversation give the states at the parts' borders, and each part is then decoded
by itself, all its conversations at once. No task holds more than a part.

Counts are made part by part, so a step from one part to the next is not among them.

Defined cases: a null text has no lines and keeps one empty turn with the role that the model gives it; null or unknown roles are no marker; null
conversations are one conversation; null turns come first; rows with the same turn go by role, then text; repeated rows are turns each;
of equally likely paths one is taken; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
import re
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import look_up, save, table

ROLES = ["system", "user", "assistant"]
PART_ROWS, PART_BYTES = 20_000, 16 << 20
# Words that mark a speaker.
SPEAKERS = {"system": 0, "instruction": 0, "instructions": 0, "user": 1, "human": 1, "customer": 1, "client": 1, "question": 1, "q": 1, "you": 1, "assistant": 2, "ai": 2, "bot": 2, "agent": 2, "model": 2, "answer": 2, "a": 2, "response": 2}
_MARKER = re.compile(r"\s*(?:[#*>\[(<|]+\s*)?([A-Za-z]{1,12})\s*(?:[\])>|*]+)?\s*:\s*(?:\*\*\s*)?")
COMMANDS = frozenset("add answer calculate change compare convert correct create define describe edit explain extract find fix generate give help implement improve list make outline paraphrase please provide rewrite show solve suggest summarise summarize tell translate write".split())


def _LOG(p: np.ndarray) -> np.ndarray:
    """Logarithms in whole millionths."""
    return np.round(np.log(p) * 1e6)


# By hand: from a line to the next of the same row, and to the first line of the next row.
BEGIN = np.array([0.2, 0.7, 0.1])
INSIDE = np.array([[0.96, 0.02, 0.02], [0.01, 0.96, 0.03], [0.01, 0.03, 0.96]])
ROWS = np.array([[0.1, 0.8, 0.1], [0.02, 0.13, 0.85], [0.02, 0.85, 0.13]])
ASKS, HEADS = np.array([0.05, 0.3, 0.1]), np.array([0.15, 0.2, 0.05])
SIZE, SPREAD = np.array([4.5, 4.2, 5.0]), 1.8
#: How many times a row of those tables counts beside what is seen.
PRIOR = 20.0
START, WITHIN, BETWEEN = _LOG(BEGIN), _LOG(INSIDE), _LOG(ROWS)
MARKED, GIVEN = 0.97, 0.95  # how often a marker, and a given role, are right


def marker(line: str) -> tuple[int, str]:
    """The role that the line's marker names, -1 if none; and the line without it."""
    m = _MARKER.match(line)
    role = SPEAKERS.get(m[1].lower(), -1) if m else -1
    return (role, line[m.end() :]) if role >= 0 else (-1, line)


def _told(right: float) -> np.ndarray:
    """A row for each role that is told, the first for none: log probability of that in each state."""
    return np.concatenate([np.zeros((1, 3)), _LOG(np.where(np.eye(3, dtype=bool), right, (1 - right) / 2))])


MARK, GIVE = _told(MARKED), _told(GIVEN)
STEP = np.stack([WITHIN, BETWEEN])


class Params(NamedTuple):
    """Log probabilities in millionths; size and spread are of the logarithm of a line's length."""

    start: np.ndarray
    step: np.ndarray
    question: np.ndarray
    command: np.ndarray
    size: np.ndarray
    spread: np.ndarray


def _of_rates(start: np.ndarray, between: np.ndarray, asks: np.ndarray, heads: np.ndarray, size: np.ndarray, spread: np.ndarray) -> Params:
    question, command = (np.stack([_LOG(1 - p), _LOG(p)]) for p in (asks, heads))
    return Params(_LOG(start), np.stack([WITHIN, _LOG(between)]), question, command, size, spread)


HAND = _of_rates(BEGIN, ROWS, ASKS, HEADS, SIZE, np.full(3, SPREAD))
#: What is counted: first roles, steps from role to role, and of each role's rows the number, and the shares of questions and command-like heads, sizes and their squares in their lines.
N_COUNTS = 3 + 9 + 5 * 3


def learnt(counts: np.ndarray) -> Params:
    """The parameters from counts and the tables by hand."""
    begin, steps, (n, asks, heads, total, square) = counts[:3], counts[3:12].reshape(3, 3), counts[12:].reshape(5, 3)
    start = (begin + PRIOR * BEGIN) / (begin.sum() + PRIOR)
    between = (steps + PRIOR * ROWS) / (steps.sum(1)[:, None] + PRIOR)
    mean = (total + PRIOR * SIZE) / (n + PRIOR)
    # about the mean, of what was seen and of the prior's own spread and mean
    spread = np.sqrt(np.maximum(0, square - 2 * mean * total + n * mean**2 + PRIOR * (SPREAD**2 + (SIZE - mean) ** 2)) / (n + PRIOR))
    return _of_rates(start, between, (asks + PRIOR * ASKS) / (n + PRIOR), (heads + PRIOR * HEADS) / (n + PRIOR), mean, spread)


def emissions(named: list[int], given: list[int], asks: list[bool], heads: list[bool], sizes: list[int], params: Params = HAND) -> np.ndarray:
    """Log probability of the lines' features, a row for each line and a column for each state."""
    size = np.log1p(np.array(sizes, float))[:, None]
    length = np.round(-5e5 * ((size - params.size) / params.spread) ** 2 - 1e6 * np.log(params.spread))
    return MARK[np.array(named, int) + 1] + GIVE[np.array(given, int) + 1] + params.question[np.array(asks, int)] + params.command[np.array(heads, int)] + length


def _features(text: str | None) -> list[tuple[int, str, str, bool, bool]]:
    """Of each line the role that a marker names, the line with and without it, whether it asks and whether it begins like a command."""
    out = []
    for line in (text or "").split("\n"):
        who, rest = marker(line) if ":" in line else (-1, line)
        out.append((who, line, rest, rest.rstrip().endswith("?"), rest.lstrip().split(" ", 1)[0].rstrip(",").lower() in COMMANDS))
    return out


def _lines(roles: list, texts: list, params: Params = HAND) -> tuple[np.ndarray, np.ndarray, list[int], list[tuple[int, str, str]]]:
    """Emissions, whether a line begins a row, the row of each line, and the lines: the role that a marker names, with and without it."""
    named, given, asks, heads, sizes, first, rows, lines = [], [], [], [], [], [], [], []
    for k, (role, text) in enumerate(zip(roles, texts, strict=True)):
        own = ROLES.index(role) if role in ROLES else -1
        for n, (who, line, rest, ask, head) in enumerate(_features(text)):
            named.append(who)
            given.append(own if n == 0 else -1)
            asks.append(ask)
            heads.append(head)
            sizes.append(len(rest))
            first.append(n == 0)
            rows.append(k)
            lines.append((who, line, rest))
    return emissions(named, given, asks, heads, sizes, params), np.array(first, bool), rows, lines


def _counted(pdf: pd.DataFrame) -> pd.DataFrame:
    """What a part's rows with a role say, as one row of counts."""
    pdf = _ordered(pdf)
    out, before = np.zeros(N_COUNTS), None
    lines = out[12:].reshape(5, 3)
    for none, conv, turn, role, text in zip(pdf["no_conv"], pdf["conv_id"], pdf["turn"], pdf["role"], pdf["text"], strict=True):
        own = ROLES.index(role) if role in ROLES else -1
        if before == (none, conv, own, turn, text):
            continue  # a row that repeats says nothing new
        if own >= 0:
            if before is None or before[:2] != (none, conv):
                out[own] += 1
            elif before[2] >= 0:
                out[3 + 3 * before[2] + own] += 1
            # a line that another speaks is not the row's; a row counts once, however many lines it has
            said = [(1, ask, head, x := math.log1p(len(rest)), x * x) for who, _, rest, ask, head in _features(text) if who in (-1, own)]
            if said:
                lines[:, own] += np.mean(said, axis=0)
        before = (none, conv, own, turn, text)
    return pd.DataFrame({"counts": [out.tolist()]})


def matrix(scores: np.ndarray, first: np.ndarray, params: Params = HAND) -> np.ndarray:
    """Best score from each state before the lines to each state at the last one: a max-plus product, of neighbours by pairs."""
    if not len(scores):
        return np.where(np.eye(3, dtype=bool), 0.0, -np.inf)
    out = params.step[first.astype(int)] + scores[:, None, :]
    while len(out) > 1:
        odd = out[len(out) - len(out) % 2 :]
        out = np.concatenate([(out[0 : len(out) - 1 : 2, :, :, None] + out[1::2, None, :, :]).max(2), odd])
    return out[0]


def decoded(scores: np.ndarray, first: np.ndarray, begins: np.ndarray, before: np.ndarray, last: np.ndarray, params: Params = HAND) -> np.ndarray:
    """The best states of the lines of several sequences, all at once. begins: where each begins, and the end of the last; before: the state
    before it (-1: none); last: its last state (-1: any)."""
    order = np.argsort(-np.diff(begins), kind="stable")  # the longest first, so that those that go on are always in front
    begin, size, before, last = begins[:-1][order], np.diff(begins)[order], before[order], last[order]
    ahead = np.searchsorted(-size, -np.arange(1, (size[0] if len(size) else 0) + 1), "right")  # how many have a line t
    back, path = np.zeros((len(scores), 3), np.int8), np.zeros(len(scores), np.int8)
    best = np.zeros((len(size), 3))
    for t, n in enumerate(ahead.tolist()):
        at = begin[:n] + t
        step = params.step[first[at].astype(int)]
        if t:
            reach = best[:n, :, None] + step
            back[at] = reach.argmax(1)
            best[:n] = reach.max(1) + scores[at]
        else:
            best = np.where((before < 0)[:, None], params.start, step[np.arange(n), before]) + scores[at]
    state = np.where(last < 0, best.argmax(1), last) if len(size) else last
    for t in range(len(ahead) - 1, -1, -1):
        n = ahead[t]
        at = begin[:n] + t
        path[at] = state[:n]
        state[:n] = back[at, state[:n]] if t else state[:n]
    return path


_CONV = ["no_conv", "conv_id"]


def _ordered(pdf: pd.DataFrame) -> pd.DataFrame:
    """Rows by conversation, turn, role and text, nulls first, as Spark ranges them."""
    keys = zip(~pdf["no_conv"], pdf["conv_id"], ~pdf["no_turn"], pdf["turn"], pdf["role"].notna(), pdf["role"].fillna(""), pdf["text"].notna(), pdf["text"].fillna(""), range(len(pdf)), strict=True)
    return pdf.iloc[[k[-1] for k in sorted(keys)]]


def _forward(key: tuple, pdf: pd.DataFrame, params: Params) -> pd.DataFrame:
    """A part of a conversation as matrices."""
    pdf = _ordered(pdf)
    scores, first, _, _ = _lines(pdf["role"].tolist(), pdf["text"].tolist(), params)
    return pd.DataFrame([[*key, (params.start + scores[0]).tolist(), matrix(scores, first, params).ravel().tolist(), matrix(scores[1:], first[1:], params).ravel().tolist()]], columns=[*_CONV, "part", "entry", "all", "rest"])


def _borders(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """The states before and at the end of each part of a conversation."""
    pdf = pdf.sort_values("part")
    best, back = None, []
    for k, row in enumerate(pdf.itertuples()):
        step = np.array(row.entry)[:, None] + np.array(row.rest).reshape(3, 3) if k == 0 else best[:, None] + np.array(row.all).reshape(3, 3)
        back.append(step.argmax(0))
        best = step.max(0)
    last = [int(best.argmax())]
    for b in back[:0:-1]:
        last.append(int(b[last[-1]]))
    last = last[::-1]
    return pd.DataFrame({"no_conv": key[0], "conv_id": key[1], "part": pdf["part"].to_numpy(), "before": [-1, *last[:-1]], "last": last})


def _rendered(pdf: pd.DataFrame, border: pd.DataFrame, params: Params) -> pd.DataFrame:
    """The turns of a part's conversations. border: the states at the ends of those that reach over it."""
    pdf = _ordered(pdf)
    scores, first, owner, lines = _lines(pdf["role"].tolist(), pdf["text"].tolist(), params)
    no_conv, conv, no_turn, turn = (pdf[c].to_numpy() for c in ("no_conv", "conv_id", "no_turn", "turn"))
    own = np.array(owner, int)
    changes = np.flatnonzero(np.diff(no_conv[own]) | (np.diff(conv[own]) != 0)) + 1
    begins = np.concatenate([[0], changes, [len(own)]])
    known = {(a, b): (x, y) for a, b, x, y in zip(border["no_conv"], border["conv_id"], border["before"], border["last"], strict=True)}
    ends = np.array([known.get((no_conv[own[k]], conv[own[k]]), (-1, -1)) for k in begins[:-1]], int)
    path = decoded(scores, first, begins, ends[:, 0], ends[:, 1], params)
    # a piece begins with a row or where the role changes
    cuts = np.flatnonzero(np.concatenate([[True], first[1:] | (path[1:] != path[:-1])]))
    piece = np.arange(len(cuts)) - np.maximum.accumulate(np.where(first[cuts], np.arange(len(cuts)), 0))
    states = path.tolist()
    plain = [rest if named == state else line for (named, line, rest), state in zip(lines, states, strict=True)]
    text = ["\n".join(plain[a:b]).strip() for a, b in zip(cuts, [*cuts[1:], len(plain)], strict=True)]
    at = own[cuts]
    return pd.DataFrame({"no_conv": no_conv[at], "conv_id": conv[at], "no_turn": no_turn[at], "turn": turn[at], "piece": piece, "role": [ROLES[states[k]] for k in cuts], "text": text})


def parsed(rows: DataFrame, part_rows: int = PART_ROWS, part_bytes: int = PART_BYTES, learn: bool = True) -> DataFrame:
    """conv_id, turn, piece, role, text, rendered: each row's lines cut where the role changes. rows: conv_id, turn, role, text. learn: whether rows with a role are counted."""
    source = rows.select(rows["conv_id"].cast("long").alias("conv_id"), rows["turn"].cast("long").alias("turn"), rows["role"].cast("string").alias("role"), rows["text"].cast("string").alias("text"))
    count, size = source.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    parts = max(1, math.ceil(count / part_rows), math.ceil((size or 0) / part_bytes))
    # null ids travel as flags, since pandas has no null among whole numbers; equal rows are told apart, so that ranges can part them
    order = ["conv_id", "turn", "role", "text", "same"]
    flat = source.withColumn("same", F.monotonically_increasing_id()).repartitionByRange(parts, *order)
    flat = flat.select(F.col("conv_id").isNull().alias("no_conv"), F.coalesce("conv_id", F.lit(0)).alias("conv_id"), F.col("turn").isNull().alias("no_turn"), F.coalesce("turn", F.lit(-(1 << 62))).alias("turn"), "role", "text", F.spark_partition_id().alias("part"))
    flat = save(flat, "parts")
    params = HAND
    if learn:
        sums = flat.groupBy("part").applyInPandas(_counted, "counts array<double>").agg(*[F.sum(F.col("counts")[k]) for k in range(N_COUNTS)]).first()  # one row
        params = learnt(np.array([x or 0.0 for x in sums]))
    # no more conversations reach over parts than there are parts
    over = save(flat.groupBy(*_CONV).agg(F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo < hi").select(*_CONV), "over")
    pieces = look_up(flat, over, _CONV).groupBy(*_CONV, "part").applyInPandas(lambda key, pdf: _forward(key, pdf, params), "no_conv boolean, conv_id long, part int, entry array<double>, all array<double>, rest array<double>")
    border = pieces.groupBy(*_CONV).applyInPandas(_borders, "no_conv boolean, conv_id long, part int, before int, last int")
    done = flat.groupBy("part").cogroup(border.groupBy("part")).applyInPandas(lambda pdf, border: _rendered(pdf, border, params), "no_conv boolean, conv_id long, no_turn boolean, turn long, piece int, role string, text string")
    rendered = F.concat(F.lit("<|"), "role", F.lit("|>\n"), "text", F.lit("\n<|end|>\n"))
    return done.select(F.when(~F.col("no_conv"), F.col("conv_id")).alias("conv_id"), F.when(~F.col("no_turn"), F.col("turn")).alias("turn"), "piece", "role", "text", rendered.alias("rendered"))


def recovered(rows: DataFrame, share: float = 0.3, learn: bool = True) -> tuple[int, int]:
    """Of the roles of a share of rows, hidden by a hash of id and turn, how many come back, and how many were hidden. Turns of a conversation must differ."""
    known = rows.where(F.col("role").isin(ROLES)).select("conv_id", "turn", "role", "text", (F.pmod(F.xxhash64("conv_id", "turn"), F.lit(1000)) < 1000 * share).alias("hidden"))
    got = parsed(known.select("conv_id", "turn", F.when(~F.col("hidden"), F.col("role")).alias("role"), "text"), learn=learn).where("piece = 0")
    both = known.where("hidden").select("conv_id", "turn", F.col("role").alias("true_role")).join(got, ["conv_id", "turn"])
    return tuple(both.agg(F.count_if(F.col("role") == F.col("true_role")), F.count("*")).first())


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsed(table(spark, sf_dir, "conversations"))


QUERIES = {"op2_chat_format": op2_chat_format}
