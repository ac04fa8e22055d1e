"""Trie of conversations by their prefixes.

Turns are known by a 128-bit digest of role and text, so texts are read once and never moved. Conversations are rebuilt (a shared head, then
their own turns), and equal ones become one sequence with a weight; its ids are hashed in order, in pieces. The sequences of a first turn form a
subtrie. A lot of small subtries is built at once inside applyInPandas: a dictionary leads from a node and a digest to a node, and since nodes are
numbered after their parents, going through them backwards is a postorder without recursion. A subtrie of more rows than `most` is an inner
node of Spark: its counts are aggregates, its rows are dealt anew by the digest of the next turn at which its sequences part, again and again,
and its totals are the sums of what its children come to, from the deepest round up. What a large subtrie's sequences share up to there, and a subtrie of one sequence
alone, are chains, written row by row however long they are. So there are as many rounds as branches one after the other at which
a subtrie is still too large.

Positions come from sorted ranges, so no task sees all rows of a conversation with very many turns.

Defined cases: rows with a null conv_id are left out; a null role or text is empty; turns are ordered by number, null first, ties by digest;
repeated rows are turns each; c - c % 100 takes % as SQL does, so negative ids go towards zero; an empty table gives an empty result, without a
root; a table of turnless rebuilt conversations gives the root alone; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattica.sources.shared import in_order

from ._shared import look_up, save, table

HEADS, EVERY = 6, 100
#: A subtrie of more rows than MOST, or than twice a task's even share, is dealt anew; one of up to LEAST rows never is.
MOST, LEAST, LOT = 65_536, 256, 65_536
#: Ids in a piece of the hashed list, and turns in a piece of a chain: powers of two.
IDS, PIECE = 12, 12
_NODES = "conv_id long, depth long, parent_conv_id long, up binary, n_convs long, n_children long, n_leaves long, saved_tokens long, end_rep long"


def digests(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, digest (of role and text), n (code points of the text)."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    both = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    return conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.unhex(F.md5(both)).alias("digest"), F.length(text).cast("long").alias("n"))


def rebuilt(conversations: DataFrame, heads: int = HEADS, every: int = EVERY) -> DataFrame:
    """conv_id, d, digest, n: the turns of each rebuilt conversation from d = 1, and a row d = 0 for each that has no digest."""
    # the last column tells repeated rows apart, so that ranges can split them
    turns = digests(conversations).withColumn("tie", F.monotonically_increasing_id())
    placed = save(in_order(turns, ["conv_id", F.col("turn").asc_nulls_first(), "digest", "tie"]).select("conv_id", "digest", "n", "place"), "placed")
    first = save(placed.groupBy("conv_id").agg(F.min("place").alias("first")), "first")
    shared = placed.where(F.col("conv_id") % every == 0).join(first, "conv_id").where(F.col("place") - F.col("first") < heads - 1)
    shared = shared.groupBy(F.col("conv_id").alias("base")).agg(F.array_sort(F.collect_list(F.struct("place", "digest", "n"))).alias("shared"))  # heads - 1 rows each
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(heads)).cast("int")
    convs = first.withColumn("h", h).withColumn("base", F.col("conv_id") - F.col("conv_id") % every).join(shared, "base", "left")
    head = F.slice(F.coalesce("shared", F.array().cast("array<struct<place:bigint,digest:binary,n:bigint>>")), 1, F.col("h"))
    convs = save(convs.select("conv_id", "first", "h", head.alias("head")), "heads")
    given = convs.select("conv_id", F.posexplode("head")).select("conv_id", (F.col("pos") + 1).cast("long").alias("d"), "col.digest", "col.n")
    rest = placed.join(convs.select("conv_id", "first", "h", F.size("head").alias("taken")), "conv_id").withColumn("at", F.col("place") - F.col("first"))
    rest = rest.where("at >= h").select("conv_id", (F.col("taken") + F.col("at") - F.col("h") + 1).alias("d"), "digest", "n")
    root = convs.select("conv_id", F.lit(0).cast("long").alias("d"), F.lit(b"").alias("digest"), F.lit(0).cast("long").alias("n"))
    return save(given.unionByName(rest).unionByName(root), "rebuilt")


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each sequence from its pieces of ids, in order; the hash goes on from batch to batch."""
    key, rep, weight, sha = None, 0, 0, None
    names = ["rep", "weight", "last", "ends_sha256"]
    for batch in batches:
        out = []
        for last, x, y, least, n, ids in zip(*(batch.column(c).to_pylist() for c in ("last", "x", "y", "least", "n", "ids")), strict=True):
            if key != (last, x, y):
                if key:
                    out.append((rep, weight, key[0], sha.hexdigest()))
                key, rep, weight, sha = (last, x, y), least, n, hashlib.sha256(ids.encode())
            else:
                weight += n
                sha.update(b"," + ids.encode())
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 4, (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=names)
    if key:
        yield pa.RecordBatch.from_arrays([pa.array([rep]), pa.array([weight]), pa.array([key[0]]), pa.array([sha.hexdigest()])], names=names)


def sequences(rows: DataFrame) -> DataFrame:
    """rep (the least id), weight (how many conversations), last (the number of turns), ends_sha256 of each distinct sequence of turns."""
    # the order of rows does not matter to an exclusive or of hashes that hold the position, so a long conversation needs no sort
    sign = rows.groupBy("conv_id").agg(F.max("d").alias("last"), F.bit_xor(F.xxhash64("d", "digest")).alias("x"), F.bit_xor(F.xxhash64("digest", "d")).alias("y"))
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    pieces = sign.groupBy("last", "x", "y", F.shiftright("conv_id", IDS).alias("piece")).agg(F.min("conv_id").alias("least"), F.count("*").alias("n"), ids.alias("ids"))
    in_turn = pieces.repartition("last", "x", "y").sortWithinPartitions("last", "x", "y", "piece")
    return save(in_turn.mapInArrow(_hashed, "rep long, weight long, last long, ends_sha256 string"), "sequences")


def tries(pdf: pd.DataFrame) -> pd.DataFrame:
    """The nodes of a lot of subtries; `top` is the depth of their first nodes, `up` names the node above those."""
    order = np.lexsort((pdf["d"], pdf["rep"]))  # the least id comes first, so it makes the nodes that it is in
    reps, weights, ds, tops, sizes = (pdf[c].to_numpy()[order].tolist() for c in ("rep", "weight", "d", "top", "n"))
    turn, label, above = (pdf[c].to_numpy()[order] for c in ("digest", "label", "up"))
    child: dict[tuple[int, bytes], int] = {}
    conv, depths, parent, up, count, size, end = [], [], [], [], [], [], []
    at = -1
    for k, (rep, weight, d) in enumerate(zip(reps, weights, ds, strict=True)):
        top = d == tops[k]
        key = (-1, label[k]) if top else (at, turn[k])
        node = child.get(key)
        if node is None:
            node = child[key] = len(conv)
            conv.append(rep)
            depths.append(d)
            parent.append(-1 if top else at)
            up.append(above[k] if top else None)
            count.append(0)
            size.append(sizes[k])
            end.append(None)
        count[node] += weight
        at = node
        if k + 1 == len(reps) or reps[k + 1] != rep:
            end[node] = rep
    kids, leaves, saved = ([0] * len(conv) for _ in range(3))
    for node in range(len(conv) - 1, -1, -1):
        leaves[node] = leaves[node] or 1
        saved[node] += (count[node] - 1) * size[node]
        p = parent[node]
        if p >= 0:
            kids[p] += 1
            leaves[p] += leaves[node]
            saved[p] += saved[node]
    whole = lambda x: pd.array(x, dtype="Int64")
    return pd.DataFrame({"conv_id": conv, "depth": depths, "parent_conv_id": whole([None if p < 0 else conv[p] for p in parent]), "up": up, "n_convs": count, "n_children": kids, "n_leaves": leaves, "saved_tokens": saved, "end_rep": whole(end)})


def _onward(rows: DataFrame, by: str, value: str) -> DataFrame:
    """rows and `onward`: the sum of a column from a row's d on. It is summed by pieces, so that a long chain is no single task's."""
    rows = rows.withColumn("piece", F.shiftright("d", PIECE))
    pieces = rows.groupBy(by, "piece").agg(F.sum(value).alias("whole"))
    later = F.sum("whole").over(Window.partitionBy(by).orderBy(F.desc("piece"))) - F.col("whole")
    within = F.sum(value).over(Window.partitionBy(by, "piece").orderBy(F.desc("d")))
    return rows.withColumn("within", within).join(pieces.select(by, "piece", later.alias("later")), [by, "piece"]).withColumn("onward", F.col("within") + F.col("later")).drop("piece", "within", "later")


def _long(n: int) -> Column:
    return F.lit(n).cast("long")


def _chains(rows: DataFrame) -> DataFrame:
    """The nodes of sequences that share none with others."""
    rows = _onward(rows.withColumn("own", (F.col("weight") - 1) * F.col("n")), "rep", "own")
    top, last = F.col("d") == F.col("top"), F.col("d") == F.col("last")
    return rows.select(
        F.col("rep").alias("conv_id"), F.col("d").alias("depth"), F.when(~top, F.col("rep")).alias("parent_conv_id"), F.when(top, F.col("up")).alias("up"), F.col("weight").alias("n_convs"),
        F.when(last, _long(0)).otherwise(_long(1)).alias("n_children"), _long(1).alias("n_leaves"), F.col("onward").alias("saved_tokens"), F.when(last, F.col("rep")).alias("end_rep"),
    )


def _counted(rows: DataFrame) -> DataFrame:
    """label, d and what the node there has if all sequences of the subtrie go through one: up, top, conv_id, n_convs, n, end_rep; seqs, lo and hi tell whether they do."""
    h = [F.xxhash64("digest"), F.xxhash64(F.lit(1), "digest")]
    same = (F.min(h[0]) == F.max(h[0])) & (F.min(h[1]) == F.max(h[1]))
    return rows.groupBy("label", "up", "top", "d").agg(F.min("rep").alias("conv_id"), F.sum("weight").alias("n_convs"), F.max("n").alias("n"), F.min(F.when(F.col("last") == F.col("d"), F.col("rep"))).alias("end_rep"), F.count("*").alias("seqs"), same.alias("same"))


def _split(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Where the sequences of each subtrie part (label, s: the first turn that not all have, or not the same), the last node that all go through, and
    the nodes between the subtrie's top and that one."""
    counted = save(_counted(rows), "counted")
    all_of = counted.where(F.col("d") == F.col("top")).select(F.col("label").alias("__of"), F.col("seqs").alias("every"))
    part = F.min(F.when((F.col("seqs") < F.col("every")) | ~F.col("same"), F.col("d"))).alias("s")
    split = save(counted.join(all_of, F.col("label") == F.col("__of")).groupBy("label").agg(part), "split")
    placed = save(counted.join(split, "label").where(F.col("d") < F.col("s")).select("label", "up", "top", "d", "s", "conv_id", "n_convs", "n", "end_rep"), "shared")
    return split, placed.where(F.col("d") == F.col("s") - 1), placed.where(F.col("d") < F.col("s") - 1)


def nodes(rows: DataFrame, most: int | None = None, lot: int = LOT) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, end_rep (the sequence that ends there or null) of each node of the
    trie of sequences: rep, weight, last, d, digest, n."""
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    most = most or max(LEAST, min(MOST, 2 * rows.count() // tasks))
    # the root is counted like any node that Spark counts
    root = rows.where("d = 0").withColumns({"label": F.lit(b""), "up": F.lit(None).cast("binary"), "top": _long(0)})
    inner = [(save(_counted(root), "root"), None)]
    found, open_ = [], rows.where("d > 0").withColumns({"up": F.lit(b""), "top": _long(1)})
    while True:
        label = F.unhex(F.md5(F.concat("up", "digest"))).alias("label")
        dealt = save(open_.join(open_.where("d = top").select("rep", label), "rep"), "dealt")
        sizes = save(dealt.groupBy("label").agg(F.count("*").alias("size"), (F.count_if(F.col("d") == F.col("top")) == 1).alias("alone")), "sizes")
        large = F.col("size") > most
        n = sizes.agg(F.coalesce(F.sum(F.when(~large, F.col("size"))), F.lit(0)).alias("small"), F.count_if(large).alias("large"), F.count_if(large & ~F.col("alone")).alias("inner")).first()
        marked = look_up(dealt, sizes.where(large).select("label", "alone"), ["label"], "left") if n.large else dealt.withColumn("alone", F.lit(None).cast("boolean"))
        parts = []
        if n.small:
            lots = max(2 * tasks, -(-n.small // lot))
            lotted = marked.where("alone is null").withColumn("lot", F.pmod(F.xxhash64("label"), F.lit(lots))).select("lot", "label", "up", "top", "rep", "weight", "d", "digest", "n")
            # a number of partitions of our own: adaptive execution would see few bytes and merge the lots to one task
            parts.append(save(lotted.repartition(min(lots, 20_000), "lot").groupBy("lot").applyInPandas(tries, _NODES), "tries"))
        if n.large > n.inner:
            parts.append(save(_chains(marked.where("alone")), "chains"))
        found.append(parts)
        if not n.inner:
            break
        rest = save(marked.where("not alone").drop("alone"), "open")
        split, bottom, between = _split(rest)
        inner.append((bottom, between))
        open_ = look_up(rest.drop("up", "top"), split, ["label"]).where("d >= s").withColumnsRenamed({"label": "up", "s": "top"})
    out, below = [], []
    for (bottom, between), parts in zip(reversed(inner), reversed(found), strict=True):
        parts = [*parts, *below]
        out += [p.where("up is null").drop("up") for p in parts]
        names = bottom.select(F.col("label").alias("up"), F.col("conv_id").alias("__above"))
        tops = [p.where("up is not null") for p in parts]
        out += [look_up(t, names, ["up"]).withColumn("parent_conv_id", F.col("__above")).drop("up", "__above") for t in tops]
        children = tops[0] if tops else rows.sparkSession.createDataFrame([], _NODES)
        for t in tops[1:]:
            children = children.unionByName(t)
        sums = children.groupBy(F.col("up").alias("__up")).agg(F.count("*").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved"))
        total = F.coalesce("saved", F.lit(0)) + (F.col("n_convs") - 1) * F.col("n")
        top = F.col("d") == F.col("top")
        place = [F.col("d").alias("depth"), F.when(~top, F.col("conv_id")).alias("parent_conv_id"), F.when(top, F.col("up")).alias("up"), "n_convs"]
        done = save(bottom.join(sums, F.col("label") == F.col("__up"), "left").select("label", "conv_id", *place, F.coalesce("n_children", F.lit(0)).alias("n_children"), F.coalesce("n_leaves", F.lit(1)).alias("n_leaves"), total.alias("saved_tokens"), "end_rep"), "inner")
        below = [done.drop("label")]
        if between is not None:
            end = done.select(F.col("label").alias("__end"), "n_leaves", "saved_tokens")
            links = _onward(between.withColumn("own", (F.col("n_convs") - 1) * F.col("n")), "label", "own").join(end, F.col("label") == F.col("__end"))
            below.append(save(links.select("conv_id", *place, _long(1).alias("n_children"), "n_leaves", (F.col("saved_tokens") + F.col("onward")).alias("saved_tokens"), "end_rep"), "links"))
    every = below[0].drop("up")  # the root
    for p in out:
        every = every.unionByName(p)
    return every


def prefix_trie(conversations: DataFrame, heads: int = HEADS, every: int = EVERY, most: int | None = None, lot: int = LOT) -> DataFrame:
    """A row for each node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    rows = rebuilt(conversations, heads, every)
    known = sequences(rows)
    one = save(rows.join(known.select(F.col("rep").alias("conv_id"), "weight", "last"), "conv_id").withColumnRenamed("conv_id", "rep"), "weighted")
    found = save(nodes(one, most, lot), "nodes")
    ends = known.select(F.col("rep").alias("end_rep"), "ends_sha256")
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return found.where("end_rep is not null").join(ends, "end_rep").select(*columns).unionByName(found.where("end_rep is null").withColumn("ends_sha256", F.sha2(F.lit(""), 256)).select(*columns))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))


QUERIES = {"op11_prefix_trie": op11_prefix_trie}
#: The same rows without a trie: every node is counted by the prefix that its conversations share, and belongs to the least of them, so that what
#: lies below a node is the sum of what its conversations have from there on.
ORACLE_SQL = {
    "op11_prefix_trie": f"""
WITH crc AS (
  SELECT list_transform(range(256), lambda n: list_reduce([n::BIGINT, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: xor(c >> 1, 3988292384 * (c & 1)))) AS t
), turns AS (
  SELECT conv_id, turn, md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS digest, length(coalesce(text, '')) AS n FROM conversations WHERE conv_id IS NOT NULL
), placed AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, digest) - 1 AS pos FROM turns
), convs AS MATERIALIZED (
  SELECT conv_id AS c, conv_id - conv_id % {EVERY} AS base, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
    lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) % {HEADS} AS h
  FROM (SELECT DISTINCT conv_id FROM placed), crc
), rebuilt AS (
  SELECT c, pos + 1 AS d, digest, n FROM convs JOIN placed ON conv_id = base WHERE pos < h
  UNION ALL
  SELECT c, pos - h + 1 + (SELECT count(*) FROM placed b WHERE b.conv_id = base AND b.pos < h), digest, n FROM convs JOIN placed ON conv_id = c WHERE pos >= h
  UNION ALL
  SELECT c, 0, '', 0 FROM convs
), keyed AS (
  SELECT c, d, n, string_agg(digest, ' ') OVER (PARTITION BY c ORDER BY d) AS k, max(d) OVER (PARTITION BY c) AS last FROM rebuilt
), member AS MATERIALIZED (
  SELECT *, lag(k) OVER (PARTITION BY c ORDER BY d) AS up FROM keyed
), node AS MATERIALIZED (
  SELECT d, k, any_value(up) AS up, min(c) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(n) AS own,
    sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (last = d), '')) AS ends_sha256
  FROM member GROUP BY d, k
), kids AS (
  SELECT d - 1 AS d, up AS k, count(*) AS n_children FROM node WHERE d > 0 GROUP BY ALL
), owned AS (
  SELECT node.*, coalesce(n_children, 0) AS n_children FROM node LEFT JOIN kids USING (d, k)
), onward AS (
  SELECT m.d, m.k, sum(coalesce(own, 0)) OVER w AS saved, sum(coalesce((n_children = 0)::INTEGER, 0)) OVER w AS leaves
  FROM member m LEFT JOIN owned o ON o.d = m.d AND o.conv_id = m.c WINDOW w AS (PARTITION BY m.c ORDER BY m.d DESC)
), total AS (
  SELECT d, k, sum(saved)::BIGINT AS saved_tokens, sum(leaves)::BIGINT AS n_leaves FROM onward GROUP BY d, k
)
SELECT o.conv_id, o.d::BIGINT AS depth, p.conv_id AS parent_conv_id, o.n_convs, o.n_children, n_leaves, saved_tokens, o.ends_sha256
FROM owned o JOIN total USING (d, k) LEFT JOIN node p ON p.d = o.d - 1 AND p.k = o.up
"""
}
