"""SimHash fingerprints of documents and the search for near ones, in DataFrame functions alone.

A text's terms are its runs of `width` words (a shorter text is one term, all its words); a term weighs as much as it occurs often. Each occurrence votes with the
bits of its hash on the 64 bits of the fingerprint: +1 for a set bit, -1 for one that is not; a bit is set if its sum is above zero. Votes are
counted as sums of packed lanes, three bits in a long, by partial aggregation in the task that reads the text, so terms are never shuffled: a
text leaves its task as 22 numbers. A text of very many words is cut to pieces whose lanes cannot run over.

Search: fingerprints are cut into radius + 3 blocks, and each choice of three blocks is a table, keyed by those blocks' bits. Two fingerprints
that differ in `radius` bits at most have three blocks in common, so they meet in some table; the first such table counts the pair.
Only different fingerprints enter. A bucket's fingerprints are gathered in parts of `part` at most, and each two parts of a bucket are compared in a row
of their own, inside the row: pairs that are no links are never rows.

Defined cases: a null text is empty; a text without words has fingerprint 0; rows with the same doc_id come in the order of a hash of their texts, a null doc_id after
all others; repeated rows are documents each, and such a row's next document is its equal but for one of them; one document is its own next;
an empty table gives an empty result; other columns are not read. A text is held whole in memory with its words, some 30 times its size.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.sources.shared import in_order

from ._shared import fits, save, table

WIDTH, RADIUS, COMMON, PART, PIECE, RUN = 5, 3, 3, 1024, 1 << 20, 1 << 16
#: Three lanes of 21 bits in a long.
LANES, LANE_BITS = 22, 21
_EACH = 1 | 1 << LANE_BITS | 1 << 2 * LANE_BITS


def words(text: Column) -> Column:
    """The maximal runs of characters other than space and 0x09-0x0D."""
    return F.filter(F.split(F.translate(text, "\t\n\x0b\x0c\r", "     "), " "), lambda w: w != "")


def _terms(df: DataFrame, text: Column, keys: list[str], width: int) -> DataFrame:
    """keys, __row, __piece, __h: a row for each term of each row's text."""
    own = df.select(*keys, F.monotonically_increasing_id().alias("__row"), words(text).alias("__w"))
    n = F.size("__w")
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), n - width + 1), F.lit(PIECE))
    own = own.select(*keys, "__row", "__w", F.posexplode(starts).alias("__piece", "__start"))
    size = F.least(F.lit(PIECE), F.greatest(F.lit(1), n - width + 2 - F.col("__start")))
    # word k of each term; behind the end of a short text there are nulls, which a hash passes over
    shifted = [F.slice("__w", F.col("__start") + k, size) for k in range(width)]
    names = [f"__w{k}" for k in range(width)]
    # a text without words keeps a row, without a term
    rows = own.select(*keys, "__row", "__piece", F.inline_outer(F.arrays_zip(*shifted)).alias(*names))
    return rows.select(*keys, "__row", "__piece", F.when(F.col("__w0").isNotNull(), F.xxhash64(*names)).alias("__h"))


def fingerprints(df: DataFrame, text: Column, keys: list[str], width: int = WIDTH) -> DataFrame:
    """keys and fp (long) of each row of df."""
    lanes = [F.sum(F.shiftrightunsigned("__h", k).bitwiseAND(F.lit(_EACH))).alias(f"s{k}") for k in range(LANE_BITS)]
    lanes.append(F.sum(F.shiftrightunsigned("__h", 3 * LANE_BITS)).alias(f"s{LANE_BITS}"))  # the 64th bit
    votes = _terms(df, text, keys, width).groupBy(*keys, "__row", "__piece").agg(F.count("__h").alias("__n"), *lanes)
    lane = lambda bit: F.shiftrightunsigned(F.coalesce(f"s{bit % LANE_BITS if bit < 63 else LANE_BITS}", F.lit(0)), LANE_BITS * (bit // LANE_BITS) if bit < 63 else 0).bitwiseAND(F.lit((1 << LANE_BITS) - 1))
    # most texts have one piece, so this moves what is one row a text already
    sums = votes.groupBy(*keys, "__row").agg(F.sum("__n").alias("__n"), F.array(*[F.sum(lane(bit)) for bit in range(64)]).alias("__votes"))
    bits = F.transform("__votes", lambda v, k: F.when(2 * v > F.col("__n"), F.call_function("shiftleft", F.lit(1).cast("long"), k)).otherwise(F.lit(0).cast("long")))
    return sums.select(*keys, F.aggregate(bits, F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b)).alias("fp"))


def as_hex(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def likeness(a: Column, b: Column) -> Column:
    """The share of equal bits."""
    return 1 - F.bit_count(a.bitwiseXOR(b)) / F.lit(64.0)


def masks(radius: int = RADIUS, common: int = COMMON) -> list[int]:
    """One mask, as a signed long, for each choice of `common` blocks of the fingerprint."""
    blocks = radius + common
    edges = [64 * k // blocks for k in range(blocks + 1)]
    out = []
    for chosen in combinations(range(blocks), common):
        mask = sum((1 << edges[k + 1]) - (1 << edges[k]) for k in chosen)
        out.append(mask - (1 << 64) if mask >> 63 else mask)
    return out


def _met(distinct: DataFrame, radius: int, part: int) -> DataFrame:
    """t (table), x and y: arrays of fingerprints, each two parts of a bucket in a row. distinct: fp, each once."""
    tables = F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks(radius)])).alias("t", "key")
    rows = distinct.select("fp", tables)
    # tables of their own, so that a hot bucket's rows can be split in the joins
    sizes = save(rows.groupBy("t", "key").agg(F.ceil(F.count("*") / part).cast("int").alias("parts"), (F.count("*") > 1).alias("met")).where("met"), "buckets")
    own = F.pmod(F.xxhash64("fp", "t"), F.col("parts")).cast("int")
    parts = rows.join(sizes, ["t", "key"]).groupBy("t", "key", own.alias("own"), "parts").agg(F.collect_list("fp").alias("fps"))
    parts = save(parts, "parts")
    one = parts.where("parts = 1").select("t", F.col("fps").alias("x"), F.col("fps").alias("y"))
    many = parts.where("parts > 1")
    other = many.select("t", "key", F.col("own").alias("other"), F.col("fps").alias("y"))
    return one.unionByName(many.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).join(other, ["t", "key", "other"]).select("t", F.col("fps").alias("x"), "y"))


def _is_link(x: Column, y: Column, t: Column, radius: int) -> Column:
    """Whether x and y are near, and t is the first table where they meet."""
    apart = x.bitwiseXOR(y)
    earlier = F.slice(F.array(*map(F.lit, masks(radius))), 1, t)
    return (apart != 0) & (F.bit_count(apart) <= radius) & ~F.exists(earlier, lambda m: apart.bitwiseAND(m) == 0)


def link_counts(distinct: DataFrame, radius: int = RADIUS, part: int = PART) -> DataFrame:
    """fp, n_links: how many other fingerprints differ in `radius` bits at most; those without any have no row."""
    found = _met(distinct, radius, part).select(F.explode(F.transform("x", lambda x: F.struct(x.alias("fp"), F.size(F.filter("y", lambda y: _is_link(x, y, F.col("t"), radius))).alias("n")))).alias("c")).select("c.*")
    return found.where("n > 0").groupBy("fp").agg(F.sum("n").alias("n_links"))


def near_pairs(distinct: DataFrame, radius: int = RADIUS, part: int = PART) -> DataFrame:
    """u < v: all pairs of different fingerprints that differ in `radius` bits at most, each once."""
    found = _met(distinct, radius, part).select("t", F.explode("x").alias("u"), "y")
    return found.select("u", F.explode(F.filter("y", lambda y: (F.col("u") < y) & _is_link(F.col("u"), y, F.col("t"), radius))).alias("v"))


KEY = ["doc_id", "hash", "n"]


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("hash"), F.length(text).cast("long").alias("n"))


def _distinct(docs: DataFrame, counts: DataFrame) -> DataFrame:
    """Each document once; texts move only where rows repeat."""
    again = counts.where("copies > 1").select(*[F.col(c).alias(f"__{c}") for c in KEY])
    if not again.limit(1).count():
        return docs
    again = save(again, "repeated")
    same = docs["doc_id"].eqNullSafe(F.col("__doc_id")) & (docs["hash"] == F.col("__hash")) & (docs["n"] == F.col("__n"))
    one = docs.join(again, same, "left_semi").groupBy(*KEY).agg(F.first("text").alias("text"))
    return docs.join(again, same, "left_anti").select(*KEY, "text").unionByName(one.select(*KEY, "text"))


def _same(one: DataFrame, other: str) -> Column:
    """Whether a row's key is that of the columns with a prefix. Neither side has a key on more than a few rows."""
    return one["doc_id"].eqNullSafe(F.col(f"{other}doc_id")) & (one["hash"] == F.col(f"{other}hash")) & (one["n"] == F.col(f"{other}n"))


def _named(df: DataFrame, prefix: str) -> DataFrame:
    return df.withColumnsRenamed({c: f"{prefix}{c}" for c in [*KEY, "fp"] if c in df.columns})


def _followed(counts: DataFrame) -> DataFrame:
    """KEY, next_* and copies: each document, the next one in falling order of doc_id, and how many rows of the table those two are."""
    placed = save(in_order(counts, [F.col("doc_id").desc_nulls_last(), "hash", "n"]), "places")
    last = placed.agg(F.coalesce(F.max("place"), F.lit(0))).first()[0]
    before = F.when(F.col("place") == 0, F.lit(last)).otherwise(F.col("place") - 1)
    follows = _named(placed.select(*KEY, before.alias("place")), "next_")
    pairs = placed.withColumn("copies", F.lit(1).cast("long")).join(follows, "place").drop("place")
    # of equal rows all but one are followed by their equal
    again = placed.where("copies > 1").select(*KEY, (F.col("copies") - 1).alias("copies"), *[F.col(c).alias(f"next_{c}") for c in KEY])
    return save(pairs.unionByName(again), "pairs")


def _edited(one: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs and `edited`: the text with its last third replaced. What moves is the next document's head and the text's own first two thirds."""
    cut = F.floor(F.col("n") / 3).cast("int")
    small = F.broadcast(pairs) if fits(pairs) else pairs
    heads = one.join(small.withColumnsRenamed({c: f"h_{c}" for c in KEY}), _same(one, "next_")).select("h_doc_id", "h_hash", "h_n", "copies", "next_doc_id", "next_hash", "next_n", F.substring(F.col("text"), F.lit(1), F.floor(F.col("h_n") / 3).cast("int")).alias("head"))
    base = one.select(*KEY, F.substring(F.col("text"), F.lit(1), F.col("n").cast("int") - cut).alias("base"))
    return base.join(heads, _same(base, "h_")).select(*KEY, "copies", "next_doc_id", "next_hash", "next_n", F.concat("base", "head").alias("edited"))


def with_edits(docs: DataFrame, width: int = WIDTH, radius: int = RADIUS) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, class_id (the least doc_id with that fingerprint) and n_links
    (how many other fingerprints lie within the radius): each document beside its text with the last third replaced by as many first characters
    of the next document, and beside the next document."""
    docs = _keyed(docs)
    counts = save(docs.groupBy(*KEY).agg(F.count("*").alias("copies")), "counts")
    one = _distinct(docs, counts)
    own = save(fingerprints(one, F.col("text"), KEY, width), "fingerprints")
    edited = _edited(one, _followed(counts)).withColumn("sha", F.unhex(F.sha2("edited", 256)))
    edited = save(_named(fingerprints(edited, F.col("edited"), [*KEY, "copies", "next_doc_id", "next_hash", "next_n", "sha"], width).withColumnRenamed("fp", "edited_fp"), "e_"), "edited")
    classes = save(own.groupBy("fp").agg(F.min("doc_id").alias("class_id")), "classes")
    links = save(link_counts(classes.select("fp"), radius), "links")
    classes = save(classes.join(links.withColumnRenamed("fp", "__fp"), F.col("fp") == F.col("__fp"), "left").select("fp", "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links")), "classes")
    named = save(own.join(classes, "fp").select(*KEY, "fp", "class_id", "n_links"), "named")
    following = own.select(F.col("doc_id").alias("f_doc_id"), F.col("hash").alias("f_hash"), F.col("n").alias("f_n"), F.col("fp").alias("next_fp"))
    rows = edited.join(named, _same(named, "e_"))
    rows = rows.join(following, F.col("next_doc_id").eqNullSafe(F.col("f_doc_id")) & (F.col("next_hash") == F.col("f_hash")) & (F.col("next_n") == F.col("f_n")))
    # a row for each copy, in runs that fit a row
    run = F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1, F.lit(RUN).cast("long"))).alias("__from")
    rows = rows.select("*", run).select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(RUN).cast("long"), F.col("copies") - F.col("__from")))).alias("__copy"))
    return rows.select(
        "doc_id", F.col("n").alias("n_chars"), F.lower(F.hex("sha")).alias("edited_sha256"), as_hex(F.col("fp")).alias("fingerprint"), as_hex(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp")).alias("near_next"), "class_id", "n_links",
    )


def op12_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_edits(table(spark, sf_dir, "documents"))


QUERIES = {"op12_document_fingerprints": op12_document_fingerprints}
