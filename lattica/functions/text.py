"""Text keys for joins and comparisons, as built-in expressions (nfkc alone is a vectorised UDF). A null gives a null unless stated."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The characters that Python's str.strip() strips, white space by Unicode and the four information separators.
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: Brackets that may wrap a value.
BRACKETS = "()[]{}<>（）【】「」"
# full-width forms lie at a fixed distance from their ASCII characters
_WIDE = "".join(chr(c + 0xFEE0) for c in range(0x21, 0x7F)) + "\u3000"
_NARROW = "".join(map(chr, range(0x21, 0x7F))) + " "


def trimmed(c: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.trim(c.cast("string"), F.lit(SPACES))


def collapsed(c: Column) -> Column:
    """Trimmed, with each run of white space as one space."""
    return F.regexp_replace(trimmed(c), f"[{SPACES}]+", " ")


def narrowed(c: Column) -> Column:
    """Full-width letters, digits, signs and spaces as ASCII."""
    return F.translate(c.cast("string"), _WIDE, _NARROW)


@F.pandas_udf(T.StringType())
def nfkc(values: pd.Series) -> pd.Series:
    """Unicode's compatibility composition."""
    return values.map(lambda x: unicodedata.normalize("NFKC", x), na_action="ignore")


def unwrapped(c: Column) -> Column:
    """Trimmed, without brackets at the ends."""
    return F.trim(c.cast("string"), F.lit(SPACES + BRACKETS))


def normalised(c: Column) -> Column:
    """Narrow, upper case, letters and digits of all scripts only."""
    return F.regexp_replace(F.upper(narrowed(c)), r"[^\p{L}\p{N}]", "")


def word_set(c: Column) -> Column:
    """Distinct words, narrow and in upper case: runs of letters and digits of any script. Blanks are none."""
    return F.array_distinct(F.filter(F.split(F.upper(narrowed(c)), r"[^\p{L}\p{N}]+"), lambda w: w != ""))


def without(words: Column, stop: list[str]) -> Column:
    """An array without stop words."""
    return F.array_except(words, F.array(*map(F.lit, stop)).cast("array<string>"))


def once_in_a_row(values: Column) -> Column:
    """An array where equal neighbours are one; nulls are equal."""
    return F.filter(values, lambda x, k: (k == 0) | ~x.eqNullSafe(F.get(values, k - 1)))


def whole_number(c: Column) -> Column:
    """A long, or null if the trimmed text is none."""
    return trimmed(c).try_cast("long")


def slug(c: Column) -> Column:
    """Lower-case letters and digits of ASCII, everything between them as one hyphen."""
    return F.trim(F.regexp_replace(F.lower(narrowed(c)), "[^a-z0-9]+", "-"), F.lit("-"))


def excerpt(c: Column, term: Column, around: int) -> Column:
    """The first occurrence of a term in any case with `around` characters on either side, … where text is left out; null if it does not occur."""
    at = F.position(F.lower(term), F.lower(c))
    begin = F.greatest(F.lit(1), at - around)
    end = F.least(F.length(c), at + F.length(term) - 1 + around)
    cut = F.concat(F.when(begin > 1, "…").otherwise(""), F.substring(c, begin, end - begin + 1), F.when(end < F.length(c), "…").otherwise(""))
    return F.when((at > 0) & (term != ""), cut)


def row_id(*columns: Column) -> Column:
    """SHA-256 of the values as JSON, so that neither nulls nor separators within values make different rows equal."""
    return F.sha2(F.to_json(F.struct(*[c.cast("string").alias(f"c{k}") for k, c in enumerate(columns)]), {"ignoreNullFields": "false"}), 256)


def map_checksum(values: Column) -> Column:
    """SHA-256 of a map of strings in the order of its keys."""
    return F.sha2(F.to_json(F.array_sort(F.map_entries(values)), {"ignoreNullFields": "false"}), 256)


def _canonical(c: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.StructType):
        fields = [_canonical(c[f.name], f.dataType).alias(f.name) for f in sorted(kind.fields, key=lambda f: f.name)]
        return F.when(c.isNotNull(), F.struct(*fields)) if fields else c
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: _canonical(x, kind.elementType))
    if isinstance(kind, T.MapType):
        entry = lambda e: F.struct(e["key"].alias("key"), _canonical(e["value"], kind.valueType).alias("value"))
        # keys are unique, so the order of entries is that of their keys, and values, which may not be comparable, are not looked at
        sort = lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0)
        return F.map_from_entries(F.array_sort(F.transform(F.map_entries(c), entry), sort))
    return c


def canonical_json(c: Column, kind: T.DataType) -> Column:
    """A struct, array or map as JSON that does not depend on the order of fields and keys: those are sorted at each level, nulls are written and there
    are no spaces. Elements of arrays keep their order. Null for a null."""
    return F.to_json(_canonical(c, kind), {"ignoreNullFields": "false"})


def json_checksum(c: Column, kind: T.DataType) -> Column:
    """SHA-256 of canonical_json()."""
    return F.sha2(canonical_json(c, kind), 256)


def gram_coverage(part: Column, whole: Column, n: int) -> Column:
    """The share of the distinct runs of n words of one array that the other has as well; null if it has none."""

    def grams(words: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - n + 1, F.lit(1))), lambda k: F.array_join(F.slice(words, k, n), " "))
        return F.when(F.size(words) >= n, F.array_distinct(runs)).otherwise(F.array().cast("array<string>"))

    own = grams(part)
    return F.when(F.size(own) > 0, F.size(F.array_intersect(own, grams(whole))) / F.size(own))


def squeezed(c: Column) -> Column:
    """Narrow, upper case, without white space; empty for a null."""
    return F.coalesce(F.regexp_replace(F.upper(narrowed(c)), f"[{SPACES}]+", ""), F.lit(""))


def first_rule(c: Column, rules: list[tuple[str, str]]) -> Column:
    """The name of the first rule (regular expression, name) that the text holds a match for; null if there is none."""
    out = F.lit(None).cast("string")
    for pattern, name in reversed(rules):
        out = F.when(c.rlike(pattern), name).otherwise(out)
    return out


def lettered_number(c: Column) -> Column:
    """A struct of the letters in front (letters), the number behind them (number) and its width in digits (width) of a text like AB012; null
    for any other text, and for numbers of more than 18 digits, which a long can't hold."""
    parts = lambda n: F.regexp_extract(c, r"^([A-Za-z]+)([0-9]{1,18})$", n)
    return F.when(c.rlike(r"^[A-Za-z]+[0-9]{1,18}$"), F.struct(parts(1).alias("letters"), parts(2).try_cast("long").alias("number"), F.length(parts(2)).alias("width")))


def span(first: Column, last: Column, most: int) -> Column:
    """The texts from one like AB08 to another with the same letters, numbers as wide as the wider one; null if letters differ, the span runs
    backwards or holds more than `most` texts."""
    a, b = lettered_number(first), lettered_number(last)
    size = b["number"] - a["number"]
    width = F.greatest(a["width"], b["width"])
    # without its condition the sequence would be built for spans of any length
    numbers = F.sequence(a["number"], F.when(size.between(0, most - 1), b["number"]).otherwise(a["number"]))
    texts = F.transform(numbers, lambda n: F.concat(a["letters"], F.lpad(n.cast("string"), F.greatest(width, F.length(n.cast("string"))), F.lit("0"))))
    return F.when((a["letters"] == b["letters"]) & size.between(0, most - 1), texts)


def resolve(columns: list[str], name: str) -> str | None:
    """The first column whose name equals another but for case, spaces, hyphens and underscores."""
    plain = lambda x: "".join(c for c in x.lower() if c not in " -_")
    return next((c for c in columns if plain(c) == plain(name)), None)
