"""PII: base patterns by regular expression, then bootstrapped contextual extraction.

Base entities are seeds. Every base entity, every other token that holds a digit or an @, and every other maximal run of digits with blanks,
round brackets, points and hyphens between them is an occurrence with two lexical contexts: the two words before it, and one word on either
side; a word ends at white space or at another occurrence, which stands as #. Values and words of any length count whole. Spark scores the graph of contexts and values in rounds: a context's confidence for a kind is the score of its distinct values of that
kind over their number, plus its values that are of another kind or can't be of this one by their characters, plus one, if `min_support`
are sure; values not labelled yet count neither way. A value's score is the chance that not all of its confident contexts err; what a round
learns counts in the next one, in every context. Tokens and runs at least `confident` by context and by value that could be of the kind
by their characters become further spans. Base spans are never touched; further spans do not overlap them, nor lie within one another.

Defined cases: a null or empty text has no spans; a null doc_id stays null; repeated rows get equal results each; an empty table
gives an empty result; digits beyond any length are read without conversion; other columns are only carried if asked for, those named
like an added one as <name>_input.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _words
from ._shared import fits as can_be_broadcast
from ._shared import save, small_batches, table, unclashed

KINDS = ["email", "ip", "card", "phone"]
ROUNDS, MIN_SUPPORT, CONFIDENT = 3, 5, 0.8

# The base patterns. Where a match can only begin at the start of a run, a lookbehind says so; it changes no match but keeps
# long runs linear.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_SPACE = frozenset(" \t\n\v\f\r")
_MARK = re.compile("[0-9@]")
_DIGITS = re.compile("[0-9]+")
#: Maximal runs of digits with a card's or a phone's separators, and the digits that such a number can have.
_RUN = re.compile(r"\(?[0-9](?:[ ().-]*+[0-9])*+")
_RUN_DIGITS = range(7, 20)
_EDGES = " \t\n\v\f\r.,;:!?\"'()[]{}<>*#$%&|"


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Each match ends with an @ and a domain; its local part is all that may precede the @, back to the last match."""
    at, floor = text.find("@"), 0
    while at >= 0:
        begin = at
        while begin > floor and text[begin - 1] in _LOCAL:
            begin -= 1
        # a run that was passed over without a match is not walked again
        domain = _DOMAIN.match(text, at) if begin < at else None
        if domain:
            yield begin, domain.end()
        floor = domain.end() if domain else at + 1
        at = text.find("@", floor)


def _byte(part: str) -> bool:
    part = part.lstrip("0") or "0"
    return len(part) <= 3 and int(part) <= 255


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        v = int(d) * (1 + k % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by kind, then start, in code points."""
    out = [(0, a, b) for a, b in _emails(text)]
    out += [(1, *m.span()) for m in _IP.finditer(text) if all(map(_byte, m[0].split(".")))]
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append((2, *m.span()))
    for m in _PHONE.finditer(text):
        if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append((3, *m.span()))
    return out


def _before(text: str, end: int, taken: list[tuple[int, int]]) -> tuple[str, int]:
    """The last word before end and where it begins. taken: all occurrences, sorted, those that overlap merged."""
    while end > 0 and text[end - 1] in _SPACE:
        end -= 1
    k = bisect.bisect_left(taken, (end, -1)) - 1
    floor = taken[k][1] if k >= 0 else 0
    if floor >= end > 0:
        return "#", taken[k][0]
    begin = end
    while begin > floor and text[begin - 1] not in _SPACE:
        begin -= 1
    return _word(text[begin:end]), begin


def _after(text: str, begin: int, taken: list[tuple[int, int]]) -> str:
    while begin < len(text) and text[begin] in _SPACE:
        begin += 1
    k = bisect.bisect_left(taken, (begin, -1))
    ceiling = taken[k][0] if k < len(taken) else len(text)
    if ceiling == begin < len(text):
        return "#"
    end = begin
    while end < ceiling and text[end] not in _SPACE:
        end += 1
    return _word(text[begin:end])


def _word(text: str) -> str:
    """A context word: without marks around it, in lower case, digits as 9."""
    return _key(_DIGITS.sub("9", text.strip(_EDGES)))


def fits(kind: int, value: str) -> bool:
    """Whether the characters of a token allow for the kind."""
    digits = sum(c.isdigit() for c in value)
    return [("@" in value[1:-1]), digits >= 4 and 2 <= value.count(".") + value.count(":") <= 7, digits >= 12, 7 <= digits <= 15 and sum(c.isalpha() for c in value) == 0][kind]


def _key(value: str) -> str:
    """The value in lower case; of long ones, a hash of the whole."""
    return value.lower() if len(value) <= 100 else hashlib.blake2b(value.lower().encode("utf-8", "replace"), digest_size=16).hexdigest()


def _free(taken: list[tuple[int, int]], a: int, b: int) -> bool:
    """Whether no span of `taken`, which is sorted, overlaps a to b."""
    k = bisect.bisect_left(taken, (b, -1)) - 1
    # spans of different kinds may overlap, so that an earlier one may reach further
    return k < 0 or taken[k][1] <= a


def _merged(base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted((a, b) for _, a, b in base):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def occurrences(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int, str, str, str, int]]:
    """(kind or -1, start, end, value, context before, context around, bits of possible kinds) of base spans and of others that could be identifiers."""
    spans = [(kind, a, b, 1 << kind) for kind, a, b in base]
    taken = _merged(base)
    end = 0
    for m in _MARK.finditer(text):
        if m.start() < end:
            continue
        begin, end = m.start(), m.end()
        while begin > 0 and text[begin - 1] not in _SPACE:
            begin -= 1
        while end < len(text) and text[end] not in _SPACE:
            end += 1
        a, b = begin, end
        while a < b and text[a] in _EDGES:
            a += 1
        while b > a and text[b - 1] in _EDGES:
            b -= 1
        if b > a and _free(taken, a, b):
            value = text[a:b]
            may = sum(1 << x for x in range(len(KINDS)) if fits(x, value))
            if may:
                spans.append((-1, a, b, may))
    for m in _RUN.finditer(text):
        a, b = m.span()
        # a run without blanks is a token
        if " " not in m[0] or (a and text[a - 1] not in _EDGES) or (b < len(text) and text[b] not in _EDGES):
            continue
        digits = sum(c.isdigit() for c in m[0])
        if digits in _RUN_DIGITS and _free(taken, a, b):
            spans.append((-1, a, b, (digits >= 12) << 2 | (digits <= 15) << 3))
    out, taken = [], _merged([(0, a, b) for _, a, b, _ in spans])
    for kind, a, b, may in spans:
        one, at = _before(text, a, taken)
        two, _ = _before(text, at, taken)
        out.append((kind, a, b, _key(text[a:b]), f"{two} {one} _", f"{one} _ {_after(text, b, taken)}", may))
    return out


#: Whether `may` holds the kind.
POSSIBLE = "(may & shiftleft(1, kind)) != 0"
_SPAN = "array<struct<k:int,s:int,e:int>>"
_FOUND = "array<struct<k:int,s:int,e:int,value:string,before:string,around:string,may:int>>"


def scanned(docs: DataFrame, keep: list[str]) -> DataFrame:
    """Columns `keep`, base (spans) and seen (occurrences)."""
    source = small_batches(docs).select(*[docs[c] for c in keep], docs["text"].alias("__text"))
    schema = T.StructType([*(source.schema[c] for c in keep), T.StructField("base", T._parse_datatype_string(_SPAN)), T.StructField("seen", T._parse_datatype_string(_FOUND))])
    span = pa.list_(pa.struct([("k", pa.int32()), ("s", pa.int32()), ("e", pa.int32())]))
    seen_type = pa.list_(pa.struct([("k", pa.int32()), ("s", pa.int32()), ("e", pa.int32()), ("value", pa.string()), ("before", pa.string()), ("around", pa.string()), ("may", pa.int32())]))
    names = ["k", "s", "e", "value", "before", "around", "may"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in _words.slices(batches, "__text"):
            base, seen = [], []
            for raw in texts:
                text = raw.decode("utf-8", "replace")
                found = base_spans(text)
                base.append([dict(zip(names, x)) for x in found])  # noqa: B905
                seen.append([dict(zip(names, x, strict=True)) for x in occurrences(text, found)])
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(base, span), pa.array(seen, seen_type)], names=[*keep, "base", "seen"])

    return source.mapInArrow(run, schema)


def confident_patterns(seen: DataFrame, rounds: int, min_support: int, confident: float) -> tuple[DataFrame, DataFrame]:
    """(pattern, kind, trust) and (value, kind, score) after the last round. seen: k, value, pattern, may (two rows per occurrence)."""
    seeds = seen.where("k >= 0").select("value", F.col("k").alias("kind")).distinct().withColumn("score", F.lit(1.0))
    # may: the kinds that a value is of, if it is a base entity, else those that its characters allow
    links = save(seen.groupBy("value", "pattern").agg(F.coalesce(F.bit_or(F.when(F.col("k") >= 0, F.col("may"))), F.bit_or("may")).alias("may")), "links")
    able = [F.count_if(F.col("may").bitwiseAND(1 << kind) != 0).alias(f"able_{kind}") for kind in range(len(KINDS))]
    # no round can make a pattern confident that has fewer than min_support values in all
    size = save(links.groupBy("pattern").agg(F.count("*").alias("size"), *able).where(F.col("size") >= min_support), "sizes")
    links = save(links.join(size.select("pattern"), "pattern", "left_semi"), "links")
    against = F.col("size") - F.element_at(F.array(*[f"able_{kind}" for kind in range(len(KINDS))]), F.col("kind") + 1)
    seeds = save(seeds, "seeds")
    score = seeds
    for _ in range(rounds):
        trust = links.join(score, "value").groupBy("pattern", "kind").agg(F.sum("score").alias("sum"), F.count("*").alias("scored"), F.count_if(F.col("score") >= confident).alias("support"))
        trust = trust.where(F.col("support") >= min_support).join(size, "pattern").select("pattern", "kind", (F.col("sum") / (F.col("scored") + against + 1)).alias("trust"))
        trust = save(trust.where(F.col("trust") >= confident), "trust")
        learnt = links.join(trust, "pattern").where(POSSIBLE).groupBy("value", "kind").agg((1 - F.exp(F.sum(F.log(1 - F.col("trust"))))).alias("score"))
        score = save(seeds.unionByName(learnt).groupBy("value", "kind").agg(F.max("score").alias("score")), "scores")
    return trust, score


def identifiers(docs: DataFrame, keep: list[str] | None = None, rounds: int = ROUNDS, min_support: int = MIN_SUPPORT, confident: float = CONFIDENT) -> DataFrame:
    """Columns `keep` (doc_id if not given), base and spans: arrays of (k, s, e) by kind number, then start; spans holds base and what contexts add."""
    docs, keep = unclashed(docs, keep or ["doc_id"], ["base", "spans", "seen", "more"])
    rows = save(scanned(docs, keep).withColumn("__row", F.monotonically_increasing_id()), "scanned")
    seen = rows.select("__row", F.explode("seen").alias("o")).select("__row", "o.*")
    seen = seen.withColumn("pattern", F.explode(F.array("before", "around"))).drop("before", "around")
    trust, score = confident_patterns(seen, rounds, min_support, confident)
    new = seen.where("k < 0").join(trust, "pattern").join(score.where(F.col("score") >= confident), ["value", "kind"])
    best = Window.partitionBy("__row", "s", "e").orderBy(F.desc("trust"), "kind")
    new = new.where(POSSIBLE).withColumn("rank", F.row_number().over(best)).where("rank = 1")
    # of spans within one another the longest stays
    before = Window.partitionBy("__row").orderBy("s", F.desc("e")).rowsBetween(Window.unboundedPreceding, -1)
    new = new.withColumn("reach", F.max("e").over(before)).where("reach is null or e > reach")
    new = new.groupBy("__row").agg(F.collect_list(F.struct(F.col("kind").alias("k"), "s", "e")).alias("more"))
    # a row for each document that contexts add spans to
    new = save(new, "added")
    out = rows.drop("seen").join(F.broadcast(new) if can_be_broadcast(new) else new, "__row", "left")
    return out.withColumn("spans", F.array_sort(F.concat("base", F.coalesce("more", F.array().cast(_SPAN))))).select(*keep, "base", "spans")


def listed(spans: str):
    """kind:start:end of each span, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["k"] + 1), x["s"], x["e"])), ",")


def redacted(docs: DataFrame, keep: list[str], **how) -> DataFrame:
    """docs' columns `keep`, text among them, with [EMAIL] and so on in place of the spans; overlapping spans are replaced as one."""
    found = identifiers(docs, [*dict.fromkeys([*keep, "text"])], **how)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in _words.slices(batches):
            out = []
            for text, spans, null in zip(texts, part.column("spans").to_pylist(), part.column("text").is_null().to_pylist(), strict=True):
                if null or not spans:
                    out.append(None if null else text)
                    continue
                whole, pieces, end = text.decode("utf-8", "replace"), [], 0
                for s, e, k in sorted((x["s"], x["e"], x["k"]) for x in spans):
                    if s >= end:
                        pieces += [whole[end:s], f"[{KINDS[k].upper()}]"]
                    end = max(end, e)
                out.append("".join([*pieces, whole[end:]]).encode())
            text = pa.array(out, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([text if c == "text" else part.column(c) for c in keep], names=keep)

    return found.drop("base").mapInArrow(run, T.StructType([found.schema[c] for c in keep]))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = identifiers(table(spark, sf_dir, "documents"))
    count = [F.expr(f"cast(size(filter(base, x -> x.k = {k})) as long) as n_{name}") for k, name in enumerate(KINDS)]
    return found.select("doc_id", *count, F.sha2(listed("base").cast("binary"), 256).alias("base_sha256"), listed("spans").alias("spans"))


QUERIES = {"op7_pii": op7_pii}
