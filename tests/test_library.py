"""Small tables with nulls, ties, repeated rows, odd boxes and empty sides; results against plain Python."""

import collections
import itertools
import json
import os
import random
import shutil
import subprocess
import sys
import unicodedata

import pytest
from pyspark.sql import functions as F

from lattica.functions import boxes as bx
from lattica.functions import text
from lattica.operators import geometry, graph, joins, relations, series, summaries
from lattica.sources import catalog, files, shared
from lattica.streaming import events

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def _rows(df):
    return collections.Counter(map(tuple, df.collect()))


def test_text_keys(spark):
    values = ["　Ｎ－１２ b ", "\x1c x \x85", "(（a）)", "日本語 テスト", "", None, "a  b\t\nc", "Ａ", "Straße, №5", "ｶﾞ"]
    out = spark.createDataFrame([(v,) for v in values], "v string").select("v", text.trimmed(F.col("v")).alias("t"), text.collapsed(F.col("v")).alias("c"), text.nfkc("v").alias("k"), text.unwrapped(F.col("v")).alias("u"), text.normalised(F.col("v")).alias("n"), text.word_set(F.col("v")).alias("w"), text.slug(F.col("v")).alias("s")).collect()
    assert set(text.SPACES) == {chr(c) for c in range(0x110000) if chr(c).isspace()}
    for r in out:
        if r.v is None:
            assert (r.t, r.c, r.k, r.u, r.n, r.w, r.s) == (None,) * 7
            continue
        assert r.t == r.v.strip() and r.c == " ".join(r.v.split()) and r.k == unicodedata.normalize("NFKC", r.v)
    by = {r.v: r for r in out}
    assert by[values[0]].n == "N12B" and by[values[2]].u == "a" and by[values[3]].n == "日本語テスト" and by[values[3]].w == ["日本語", "テスト"] and by[values[0]].s == "n-12-b"
    one = spark.range(1)
    pick = lambda c: one.select(c).first()[0]
    assert [pick(text.whole_number(F.lit(v))) for v in (" 12 ", "x", "", "1.5", None)] == [12, None, None, None, None]
    assert pick(text.once_in_a_row(F.array(*[F.lit(v).cast("string") for v in ("a", "a", None, None, "b", "a")]))) == ["a", None, "b", "a"]
    assert pick(text.without(F.array(F.lit("a"), F.lit("b")), ["b"])) == ["a"] and pick(text.without(F.array(F.lit("a")), [])) == ["a"]
    assert pick(text.excerpt(F.lit("one two three four"), F.lit("THREE"), 4)) == "…two three fou…" and pick(text.excerpt(F.lit("one"), F.lit("x"), 4)) is None
    assert pick(text.row_id(F.lit("a"), F.lit(None))) != pick(text.row_id(F.lit(None), F.lit("a"))) and pick(text.row_id(F.lit("a,b"), F.lit("c"))) != pick(text.row_id(F.lit("a"), F.lit("b,c")))
    assert pick(text.map_checksum(F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2")))) == pick(text.map_checksum(F.create_map(F.lit("b"), F.lit("2"), F.lit("a"), F.lit("1"))))
    words = lambda s: F.split(F.lit(s), " ")
    assert [pick(text.gram_coverage(words("a b c"), words(s), 2)) for s in ("x a b y", "a b c", "c b a", "a")] == [0.5, 1.0, 0.0, 0.0]
    assert pick(text.gram_coverage(words("a"), words("a b"), 2)) is None
    assert text.resolve(["Wire Label", "b"], "wire_label") == "Wire Label" and text.resolve(["b"], "a") is None


def test_labels_spans_and_rules(spark):
    pick = lambda c: spark.range(1).select(c).first()[0]
    s = lambda v: F.lit(v).cast("string")
    assert [pick(text.span(s(a), s(b), 5)) for a, b in (("A8", "A10"), ("A08", "A10"), ("A9", "A9"), ("A9", "B10"), ("A9", "A8"), ("A1", "A99"), ("A1", None), ("", "A1"))] == [["A08", "A09", "A10"], ["A08", "A09", "A10"], ["A9"], None, None, None, None, None]
    assert tuple(pick(text.lettered_number(s("XY007")))) == ("XY", 7, 3) and pick(text.lettered_number(s("7X"))) is None and pick(text.lettered_number(s("A" + "9" * 40))) is None
    assert [pick(text.first_rule(s(v), [("a", "one"), ("b$", "two")])) for v in ("ab", "b", "c", None)] == ["one", "two", None, None]
    assert [pick(text.squeezed(s(v))) for v in (" a　ｂ\n", None)] == ["AB", ""]
    box = tuple(F.lit(v) for v in (-1.0, 2.0, 30.0, None))
    assert [pick(c) for c in bx.scaled(box, 2.0, 50, 60)] == [0.0, 4.0, 50.0, None] and pick(bx.grid_key(F.lit(1.5), F.lit(-1.5), 3.0)) == "1,0"
    rows = spark.createDataFrame([("k", 1, "b", "2"), ("k", 2, "a", "3"), ("k", 3, "b", "3"), (None, 4, None, "x"), ("j", 5, "c", "7"), ("j", 6, "c", "7")], "g string, at int, v string, n string")
    assert _rows(summaries.collapsed(rows, ["g"], "at", "v", "n")) == collections.Counter([("k", 1, "b,a", 8), (None, 4, "", None), ("j", 5, "c", 7)])
    assert _rows(series.sliding(rows, ["g"], ["at"], "at", 2, "w").select("at", F.array_join("w", "-"))) == collections.Counter([(1, "1-2"), (2, "2-3"), (5, "5-6")])
    assert relations.where_present(rows, {"g": "j", "none": 1}).count() == 2


def _random_boxes(n, seed, size=30):
    r = random.Random(seed)
    out = []
    for k in range(n):
        x, y = r.randint(0, 100), r.randint(0, 100)
        out.append((k, k % 2, float(x), float(y), float(x + r.randint(0, size)), float(y + r.randint(0, 9))))
    # large, odd and unknown ones; one that repeats
    out += [(n, 0, -1e6, -1e6, 1e6, 1e6), (n + 1, 0, 5.0, 5.0, 1.0, 9.0), (n + 2, 0, None, 1.0, 2.0, 2.0), (n + 3, 0, 0.0, 0.0, float("inf"), 1.0), (n + 4, None, 0.0, 0.0, 9.0, 9.0), (n + 5, 0, 3.0, 3.0, 3.0, 3.0), out[0]]
    return out


BOXES = "id long, page int, x0 double, y0 double, x1 double, y1 double"


def _fine(rows):
    return [r for r in rows if None not in r and r[2] <= r[4] and r[3] <= r[5] and max(map(abs, r[2:])) < float("inf")]


def _gap2(a, b):
    return max(0.0, a[2] - b[4], b[2] - a[4]) ** 2 + max(0.0, a[3] - b[5], b[3] - a[5]) ** 2


@pytest.mark.parametrize("cell", [1.0, 16.0, 1000.0])
def test_box_joins_equal_brute_force(spark, cell):
    left, right = _random_boxes(60, 1), _random_boxes(50, 2)
    a, b = spark.createDataFrame(left, BOXES), spark.createDataFrame(right, BOXES)
    pairs = [(p, q) for p in _fine(left) for q in _fine(right) if p[1] == q[1]]
    shared_ = lambda p, q: max(0.0, min(p[4], q[4]) - max(p[2], q[2])) * max(0.0, min(p[5], q[5]) - max(p[3], q[3]))
    assert _rows(geometry.overlaps(a, b, cell)) == collections.Counter((p[1], p[0], q[0], shared_(p, q)) for p, q in pairs if shared_(p, q) > 0)
    near = collections.Counter((p[1], p[0], q[0], _gap2(p, q)) for p, q in pairs if _gap2(p, q) <= cell * cell)
    assert _rows(geometry.within(a, b, cell)) == near
    points = [(k, k % 2, float(k * 7 % 100), float(k * 13 % 100)) for k in range(40)] + [(90, 0, None, 1.0)]
    got = geometry.holding(spark.createDataFrame(points, "id long, page int, x double, y double"), b, cell, 1.0)
    assert _rows(got) == collections.Counter((p[1], p[0], q[0]) for p in points if p[2] is not None for q in _fine(right) if p[1] == q[1] and q[2] - 1 <= p[2] <= q[4] + 1 and q[3] - 1 <= p[3] <= q[5] + 1)


def test_nearest_keeps_k_and_empty_sides(spark):
    left, right = _random_boxes(40, 3)[:40], _random_boxes(40, 4)[:40]
    a, b = spark.createDataFrame(left, BOXES), spark.createDataFrame(right, BOXES)
    want = set()
    for p in left:
        near = sorted((_gap2(p, q), q[0]) for q in right if q[1] == p[1] and _gap2(p, q) <= 144)
        want |= {(p[1], p[0], i, d, n + 1) for n, (d, i) in enumerate(near[:3])}
    assert {tuple(r) for r in geometry.nearest(a, b, 12.0, 3).collect()} == want
    assert geometry.nearest(a.limit(0), b, 12.0).count() == geometry.overlaps(a, b.limit(0), 8.0).count() == 0


def test_crossings_equal_brute_force(spark):
    r = random.Random(5)
    across = [(k, 0, float(r.randint(0, 50)), float(r.randint(0, 50)), float(r.randint(0, 50))) for k in range(30)]
    upright = [(k, 0, float(r.randint(0, 50)), float(r.randint(0, 50)), float(r.randint(0, 50))) for k in range(30)]
    a = spark.createDataFrame(across, "id int, page int, x0 double, x1 double, y double")
    b = spark.createDataFrame(upright, "id int, page int, x double, y0 double, y1 double")
    want = {(h[0], v[0], v[2], h[4]) for h in across for v in upright if min(h[2:4]) <= v[2] <= max(h[2:4]) and min(v[3:]) <= h[4] <= max(v[3:])}
    assert {tuple(x)[1:] for x in geometry.crossings(a, b, 8.0).collect()} == want


def test_rectangles_within_tolerance(spark):
    across = spark.createDataFrame([(1, 0, 0.0, 10.0, 0.0), (2, 0, 10.5, 0.0, 8.0), (3, 0, 0.0, 4.0, 8.0), (4, 1, 0.0, 10.0, 0.0), (5, 0, 3.0, 3.0, 0.0), (6, None, 0.0, 10.0, 8.0)], "id int, page int, x0 double, x1 double, y double")
    upright = spark.createDataFrame([(1, 0, 0.0, 0.0, 8.0), (2, 0, 10.0, 8.5, 0.0), (3, 0, 5.0, 0.0, 8.0), (4, 1, 0.0, 0.0, 8.0)], "id int, page int, x double, y0 double, y1 double")
    assert _rows(geometry.rectangles(across, upright, 4.0, 0.5)) == collections.Counter([(0, 1, 2, 1, 2, 0.0, 0.0, 10.0, 8.0)])
    assert geometry.rectangles(across, upright, 4.0).count() == geometry.rectangles(across.limit(0), upright, 4.0).count() == 0


def _iou(a, b):
    shared_ = max(0.0, min(a[4], b[4]) - max(a[2], b[2])) * max(0.0, min(a[5], b[5]) - max(a[3], b[3]))
    both = (a[4] - a[2]) * (a[5] - a[3]) + (b[4] - b[2]) * (b[5] - b[3]) - shared_
    return shared_ / both if both > 0 else 0.0


def test_suppression_equals_the_loop(spark):
    r = random.Random(7)
    rows = []
    for k in range(120):
        x, y = r.randint(0, 40), r.randint(0, 40)
        rows.append((k, k % 2, float(x), float(y), float(x + 12), float(y + 12), None if k == 5 else float(r.randint(0, 9))))
    rows += [(500, None, 0.0, 0.0, 1.0, 1.0, 1.0), (501, 0, None, 0.0, 1.0, 1.0, 1.0)]
    kept = []
    for b in sorted(rows[:120], key=lambda b: (b[6] is None, -(b[6] or 0), b[0])):
        if all(k[1] != b[1] or _iou(k, b) < 0.4 for k in kept):
            kept.append(b)
    got = geometry.suppressed(spark.createDataFrame(rows, BOXES + ", score double"), 0.4, 8.0)
    assert {tuple(x) for x in got.collect()} == {(b[1], b[0]) for b in kept} | {(0, 501), (None, 500)}


def test_greedy_assignment_equals_the_loop(spark):
    r = random.Random(8)
    pairs = [(a, b, float(r.randint(0, 9))) for a, b in itertools.product(range(25), range(25)) if r.random() < 0.3] + [(None, 1, 0.0)]
    used_a, used_b, want = set(), set(), set()
    for d, a, b in sorted((d, a, b) for a, b, d in pairs if a is not None):
        if a not in used_a and b not in used_b:
            used_a.add(a), used_b.add(b), want.add((a, b, d))
    df = spark.createDataFrame(pairs, "a long, b long, d double")
    assert {tuple(x) for x in joins.greedy_pairs(df, "a", "b", "d").collect()} == want
    assert joins.greedy_pairs(df.limit(0), "a", "b", "d").count() == 0


def test_box_measures(spark):
    value = lambda c: spark.range(1).select(c).first()[0]
    box = lambda *v: tuple(F.lit(x).cast("double") for x in v)
    unit, far, flat = box(0, 0, 2, 2), box(5, 6, 7, 8), box(1, 1, 1, 1)
    assert value(bx.iou(unit, box(1, 0, 3, 2))) == pytest.approx(1 / 3) and value(bx.iou(flat, flat)) == 0.0
    assert value(bx.contained_share(box(1, 1, 3, 3), unit)) == 0.25 and value(bx.contained_share(flat, unit)) is None
    assert value(bx.least_area_share(box(0, 0, 1, 1), unit)) == 1.0 and value(bx.gap(unit, far)) == 25.0 and value(bx.gap(unit, flat)) == 0.0
    assert value(bx.iou(unit, box(None, 0, 1, 1))) is None and value(bx.gap(unit, box(0, 0, None, 1))) is None
    assert [value(bx.border_distance(unit, F.lit(x), F.lit(y))) for x, y in ((1.0, 0.5), (5.0, 6.0), (2.0, 1.0))] == [0.5, 5.0, 0.0]
    line = [F.lit(v) for v in (0.0, 0.0, 10.0, 0.0)]
    assert [value(bx.segment_distance(F.lit(x), F.lit(y), *line)) for x, y in ((5.0, 3.0), (13.0, 4.0), (-3.0, -4.0))] == [3.0, 5.0, 5.0]
    assert value(bx.segment_distance(F.lit(3.0), F.lit(4.0), *[F.lit(0.0)] * 4)) == 5.0 and value(bx.segment_length(*line)) == 10.0
    assert [value(bx.orientation(*map(F.lit, v))) for v in ((0, 0, 5, 0), (0, 0, 0, 5), (1, 1, 1, 1), (0, 0, 5, 5))] == ["h", "v", "point", "other"]
    segments = [((-1, 1, 3, 1), True), ((-1, 3, 3, 3), False), ((1, 1, 1, 1), True), ((-1, 1, 1, 3), True), ((-2, 1, 1, 4), False), ((3, -1, 3, 5), False), ((2, -1, 2, 5), True)]
    for s, want in segments:
        assert value(bx.segment_meets_box(*[F.lit(float(v)) for v in s], unit)) == want, s
    assert [value(c) for c in bx.joined(unit, far)] == [0, 0, 7, 8] and [value(c) for c in bx.centre(far)] == [6, 7] and [value(c) for c in bx.expanded(unit, 1)] == [-1, -1, 3, 3]
    points = spark.createDataFrame([(1.0, 1.0), (2.0, 2.0), (30.0, 30.0), (None, 1.0)], "x double, y double")
    assert [tuple(r) for r in summaries.grid_clusters(points, 10.0, 2).collect()] == [(1.5, 1.5, 2)]


def test_joins_with_nulls_and_clashes(spark):
    a = spark.createDataFrame([(1, "x y"), (2, None), (None, "z"), (3, "")], "id int, t string")
    b = spark.createDataFrame([(1, "Y"), (7, "Ｚ")], "id int, t string")
    assert _rows(joins.token_join(a, b, "id", "id", "t", "t", "left")) == collections.Counter([(1, 1), (2, None), (None, 7), (3, None)])
    assert _rows(joins.token_survey(a, b, F.col("t"), F.col("t"))) == collections.Counter([(2, 2)])
    assert _rows(joins.with_flag(a, b.unionByName(b), ["id"], "there").select("id", "there")) == collections.Counter([(1, True), (2, False), (None, False), (3, False)])
    old = spark.createDataFrame([(None, 1), (1, None), (2, 2), (4, 4)], "k int, v int")
    new = spark.createDataFrame([(None, 1), (1, None), (2, 3), (5, 5)], "k int, v int")
    assert _rows(joins.keyed_diff(old, new, ["k"], ["v"])) == collections.Counter([(None, "matched"), (1, "matched"), (2, "differing"), (4, "missing"), (5, "extra")])
    assert _rows(joins.keyed_diff(old.limit(0), new.where("k = 5"), ["k"], ["v"])) == collections.Counter([(5, "extra")])
    names = spark.createDataFrame([("Ab",), ("abc",), ("",), (None,), ("b",)], "a string")
    other = spark.createDataFrame([("ABC d",), ("ab",), ("x",)], "b string")
    assert _rows(joins.prefix_join(names, other, "a", "b")) == collections.Counter([("Ab", "ABC d"), ("Ab", "ab"), ("abc", "ABC d"), ("abc", "ab")])
    asked = spark.createDataFrame([(1, ["a-1", "B 2"]), (2, None), (3, [None, ""]), (1, ["x"]), (None, ["b2"])], "id int, keys array<string>")
    bank = spark.createDataFrame([("A1", 5, "p"), ("b2", 4, "q"), ("B-2", 6, "r"), (None, 1, "s"), ("", 1, "t")], "name string, at int, what string")
    assert _rows(joins.first_match(asked, bank, "id", F.col("keys"), "name", ["at"]).select("id", "what")) == collections.Counter([(1, "q"), (2, None), (3, None), (None, "q")])
    links = spark.createDataFrame([(1, 2), (2, 1), (1, 2), (3, 1), (4, 4), (None, 1)], "u int, v int")
    assert _rows(joins.reciprocal(links, "u", "v")) == collections.Counter([(1, 2)])
    expected, found = spark.createDataFrame([("k", 1), ("k", 2), ("k", 3), (None, 4)], "k string, e int"), spark.createDataFrame([("k", 10), ("k", 20), (None, 30)], "k string, f int")
    assert _rows(joins.row_match(expected, found, ["k"], "e", "f")) == collections.Counter([(1, 10), (2, 20), (3, None), (4, None)])
    assert _rows(joins.column_overlap(old, new, ["k", "v"])) == collections.Counter([("k", 3, 3, 2), ("v", 3, 3, 1)])


def test_series_with_nulls_ties_and_odd_intervals(spark):
    df = spark.createDataFrame([("a", 1, None), ("a", 2, "x"), ("a", 3, None), (None, 1, "y"), (None, 2, None)], "g string, k int, v string")
    assert _rows(series.forward_fill(df, ["g"], ["k"], ["v"])) == collections.Counter([("a", 1, None), ("a", 2, "x"), ("a", 3, "x"), (None, 1, "y"), (None, 2, "y")])
    assert _rows(series.latest(df, ["g"], [F.desc("k")]).select("g", "k")) == collections.Counter([("a", 3), (None, 2)])
    assert _rows(series.continued(df, ["g"], ["k"], "more").select("k", "more")) == collections.Counter([(1, False), (2, True), (3, True), (1, False), (2, True)])
    spans = [("a", 0, 10), ("a", 2, 3), ("a", 4, 6), ("a", 13, 14), ("a", 20, 20), ("a", 9, 5), ("a", None, 5), ("b", 1, 2), ("b", 1, 2)]
    df = spark.createDataFrame(spans, "g string, s int, e int")
    assert _rows(series.islands(df, ["g"], "s", "e", 3)) == collections.Counter([("a", 0, 14, 4), ("a", 20, 20, 1), ("b", 1, 2, 2)])
    assert _rows(series.covered(df, ["g"], "s", "e")) == collections.Counter([("a", 11, 20), ("b", 1, 1)])
    numbers = spark.createDataFrame([(1, k) for k in range(10)] + [(2, 0)], "g int, k int")
    assert {(r.g, r.k) for r in series.tail_split(numbers, ["g"], ["k"], 0.25, 2).where("held").collect()} == {(1, 7), (1, 8), (1, 9), (2, 0)}
    for f in (lambda d: series.forward_fill(d, ["g"], ["s"], ["e"]), lambda d: series.islands(d, ["g"], "s", "e"), lambda d: series.covered(d, ["g"], "s", "e"), lambda d: series.tail_split(d, ["g"], ["s"], 0.5)):
        assert f(df.limit(0)).count() == 0


def test_long_chains_of_bands_take_few_jobs(spark):
    n, nan = 5000, float("nan")
    rows = spark.range(n).selectExpr("if(id % 2 = 0, null, 1) as g", "cast(id div 2 as double) as v").union(spark.createDataFrame([(1, nan), (1, None)], "g int, v double"))
    spark.sparkContext.setJobGroup("bands", "bands")
    got = {(x.g, x.v): x.band for x in series.bands(rows, ["g"], "v", 2.0, inclusive=True).where("v is not null and not isnan(v)").collect()}
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("bands")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert got == {(g, float(v)): v - v % 3.0 for g in (None, 1) for v in range(n // 2)}
    assert len(jobs) <= 8
    assert [str(x.band) for x in series.bands(rows, ["g"], "v", 2.0).where("v is null or isnan(v)").orderBy("v").collect()] == ["None", "nan"]


def test_bands_equal_the_loop(spark):
    r = random.Random(12)
    rows = [(["a", "b", None][k % 3], r.choice([None, *[x / 2 for x in range(300)]])) for k in range(400)] + [("c", 5.0), ("d", None)]
    want, begin = collections.Counter(), {}
    for g, v in sorted((x for x in rows if x[1] is not None), key=lambda x: (str(x[0]), x[1])):
        begin[g] = v if g not in begin or v >= begin[g] + 2.5 else begin[g]
        want[g, v, begin[g]] += 1
    got = series.bands(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", 2.5)
    assert _rows(got) == want + collections.Counter((g, None, None) for g, v in rows if v is None)
    assert series.bands(got.drop("band").limit(0), ["g"], "v", 2.5).count() == 0


def test_relations(spark, tmp_path):
    a = spark.createDataFrame([(1, "a"), (1, "a"), (None, None)], "k int, v string")
    b = spark.createDataFrame([("a", 1), (None, None)], "v string, k int")
    assert _rows(relations.combined(a, b, "intersect")) == collections.Counter([(1, "a"), (None, None)]) and _rows(relations.combined(a, b, "except", True)) == collections.Counter([(1, "a")])
    assert relations.combined(a, b, "union").count() == 2 and relations.combined(a, b, "union", True).count() == 5
    assert _rows(relations.inserted(b, a.withColumn("v", F.lit("new")), ["k"])) == collections.Counter([("a", 1), (None, None)])
    assert _rows(relations.upserted(a, b.where("k = 1").withColumn("v", F.lit("new")), ["k"])) == collections.Counter([(1, "new"), (None, None)])
    assert _rows(relations.replaced(a, b.limit(0), F.col("k") == 1)) == collections.Counter([(None, None)])
    assert relations.capped_count(a, 2).first() == (2, True) and relations.capped_count(a.limit(0), 2).first() == (0, False)
    assert relations.next_version(a, ["v"], "k").where("v is null").first().k == 1
    lists = spark.createDataFrame([(1, [1, 2]), (2, []), (3, None)], "k int, v array<int>")
    assert relations.unnested(lists, F.col("v"), "x").count() == 2 and relations.unnested(lists, F.col("v"), "x", True).count() == 4
    merged = spark.range(1).select(relations.merged_maps(F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2")), F.create_map(F.lit("b"), F.lit("3"))).alias("m"), relations.merged_maps(F.lit(None).cast("map<string,string>"), F.create_map(F.lit("b"), F.lit("3"))).alias("n")).first()
    assert merged.m == {"a": "1", "b": "3"} and merged.n == {"b": "3"}
    assert relations.positional(a, ["v", None, "v"]).columns == ["c0", "c1", "c2"]
    a.createOrReplaceTempView("some_rows")
    assert relations.read_only(spark, "WITH x AS (SELECT * FROM some_rows) SELECT k FROM x", 2).count() == 2
    for statement in ("DROP VIEW some_rows", "CREATE TABLE t AS SELECT 1", "INSERT INTO some_rows VALUES (1, 'a')", "SHOW TABLES", "SET a = 1"):
        with pytest.raises(ValueError):
            relations.read_only(spark, statement, 1)
    path = str(tmp_path / "t")
    relations.write_partitions(spark.createDataFrame([(1, "x"), (2, "x")], "p int, v string"), path, ["p"])
    relations.write_partitions(spark.createDataFrame([(2, "y")], "p int, v string"), path, ["p"])
    assert _rows(spark.read.parquet(path).select("p", "v")) == collections.Counter([(1, "x"), (2, "y")])
    relations.write_partitions(spark.createDataFrame([(2, "z")], "p int, v string"), path, ["p"], "append")
    assert spark.read.parquet(path).count() == 3
    relations.write_partitions(spark.createDataFrame([(3, "z")], "p int, v string"), path, ["p"], "overwrite")
    assert spark.read.parquet(path).count() == 1


def test_summaries(spark):
    df = spark.createDataFrame([("g", 3, "b"), ("g", 1, "a"), ("g", 2, "b"), (None, 1, None)], "g string, k int, v string")
    assert _rows(summaries.distinct_list(df, ["g"], "v")) == collections.Counter([("g", "a, b"), (None, "")])
    assert {(r.g, tuple(r.v)) for r in summaries.ordered_list(df, ["g"], "k", "v").collect()} == {("g", ("a", "b")), (None, ())}
    profile = {r["column"]: tuple(r)[1:] for r in summaries.column_profile(spark.createDataFrame([(9, "x"), (10, None)], "n int, s string"), ["n", "s"]).collect()}
    assert profile == {"n": (2, 2, 2, "9", "10"), "s": (2, 1, 1, "x", "x")}
    assert summaries.column_profile(df.limit(0), ["k"]).first()[1:] == (0, 0, 0, None, None)
    flags = spark.createDataFrame([(k, ["a", "a"] if k % 2 else ["a", "b"]) for k in range(6)] + [(9, None)], "k int, f array<string>")
    assert {(r.flag, r.n, tuple(r.samples)) for r in summaries.flag_counts(flags, "f", 2, "k").collect()} == {("a", 6, (0, 1)), ("b", 3, (0, 2))}
    assert summaries.progress(df, ["g"], "v", "b", "a").where("g = 'g'").first()[1:] == (3, 2, 1, 0, False)
    assert [r.value for r in summaries.value_sample(df, "v", 1).collect()] == ["a"]
    scored = summaries.word_score(spark.createDataFrame([(1, ["a", "b"], None), (2, ["a"], ["b"]), (3, [], [])], "k int, x array<string>, y array<string>"), ["a", "b", "b"], {"x": 2, "y": 5}, "k", 5)
    assert [tuple(r) for r in scored.collect()] == [(2, 7.0), (1, 4.0)]
    vectors = spark.createDataFrame([(1, [1.0, 0.0], "p"), (2, [2.0, 0.0], "p"), (3, [1.0, 1.0], "q"), (4, None, "r"), (5, [0.0, 0.0], "s"), (6, [1.0], "t"), (7, [None, 1.0], "u")], "k int, v array<double>, c string")
    got = summaries.similar_vectors(vectors, [1.0, 0.0], "k", "v", F.col("c"), 5).collect()
    assert [r.k for r in got] == [1, 3] and got[1].similarity == pytest.approx(0.5**0.5)


def test_graphs(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (4, 4), (9, 8), (1, 2), (None, 1)], "u long, v long")
    assert {(r.node, r.hops) for r in graph.hops(edges, spark.createDataFrame([(1,), (None,)], "node long"), 2).collect()} == {(1, 0), (2, 1), (3, 2)}
    assert {r.node: r.degree for r in graph.degrees(edges).collect()} == {1: 2, 2: 3, 3: 2, 4: 3, 9: 1, 8: 1}
    assert {tuple(r) for r in graph.neighbours(edges, spark.createDataFrame([(4,), (2,)], "node long")).collect()} == {(4, 3), (2, 1), (2, 3)}
    root = {r.node: r.root for r in graph.components(edges).collect()}
    assert root[1] == root[4] != root[9] == root[8] and len(root) == 6
    r, n = random.Random(2), 300
    pairs = [(r.randrange(n), r.randrange(n)) for _ in range(260)] + [(0, k) for k in range(40)]
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        parent[find(a)] = find(b)
    root = {x.node: x.root for x in graph.components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    assert len({(root[k], find(k)) for k in root}) == len({root[k] for k in root}) == len({find(k) for k in root})
    assert graph.components(edges.limit(0)).count() == 0


def test_files_and_catalog(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "q", b', None), (2, "two\nlines", "x")], "k int, v string, w string")
    files.write_csv(df, str(tmp_path / "csv"), ["v", "k", "w"])
    back = files.read_csv(spark, str(tmp_path / "csv"))
    assert back.columns == ["v", "k", "w"] and {(r.k, r.v, r.w) for r in back.collect()} == {("1", 'a "q", b', None), ("2", "two\nlines", "x")}
    one = tmp_path / "one.csv"
    one.write_text('a,b\n1,"x\ny"\n2,\n')
    assert tuple(files.profile(spark, str(one)).first()) == (len('a,b\n1,"x\ny"\n2,\n'), 4, 2, ["a", "b"]) and files.preview(spark, str(one), 1).count() == 1
    files.write_json(df, str(tmp_path / "json"), ["k", "w"])
    assert sorted(json.loads(x.value)["k"] for x in spark.read.text(str(tmp_path / "json")).collect()) == [1, 2]
    many = spark.range(0, 1000, 1, 7).select((999 - F.col("id")).alias("k"), F.when(F.col("id") % 2 == 0, "e").alias("v"))
    head, rows = files.as_dataset(many, "d", ["k"])
    assert tuple(head.first()) == ("d", ["k", "v"], 1000)
    assert [json.loads(r.data)["k"] for r in rows.orderBy("row").collect()] == list(range(1000)) and {r.row for r in rows.collect()} == set(range(1000))
    assert _rows(files.from_dataset(rows, "k long, v string")) == _rows(many)
    df.createOrReplaceTempView("catalogued_rows")
    assert [tuple(r) for r in catalog.tables(spark, "CATALOGUED").collect()] == [("catalogued_rows", True, ["k:int", "v:string", "w:string"])]
    assert catalog.row_estimate(spark, "catalogued_rows")[0] == 2
    cells = spark.createDataFrame([("a\x00b", "x" * 50, None)], "a string, b string, c string")
    assert tuple(catalog.sample(cells, 5, 10).first()) == ("ab", "x" * 10 + "…", None)


def test_newest_and_deduplicated_on_a_stream(spark, tmp_path):
    rows = spark.createDataFrame([(k % 20, k % 3, f"2024-01-01 00:{k % 20:02d}:00") for k in range(40)], "event_id long, user_id long, t string").selectExpr("event_id", "user_id", "cast(t as timestamp) as ts")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    for name, frame, mode in (("newest", events.newest(stream, "user_id"), "complete"), ("once", events.deduplicated(stream, "1 day"), "append")):
        frame.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start().awaitTermination()
    assert _rows(spark.table("newest")) == _rows(events.newest(rows, "user_id")) and spark.table("once").count() == 20 == events.deduplicated(rows).count()


def test_look_up_by_broadcast_and_by_salts(spark):
    rows = spark.createDataFrame([(k % 5 or None, k) for k in range(50)] + [(9, 99)], "k int, v int")
    small = spark.createDataFrame([(None, "n"), (1, "a"), (2, "b"), (2, "c")], "k int, w string")
    for how in ("inner", "left"):
        one, two = (_rows(shared.look_up(rows, small, ["k"], how, fit)) for fit in (True, False))
        assert one == two and sum(one.values()) == 40 + (21 if how == "left" else 0)
    assert shared.fits(small) and shared.fits(small.limit(0))


def test_shared_folder_must_be_named_on_a_cluster(spark):
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "local-cluster[2,1,1024]"

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError):
        shared.shared_folder(Session())
    saved = shared.save(spark.range(3), "thrown-away")
    folder = [p for p in saved.inputFiles()][0].removeprefix("file:").rsplit("/", 1)[0]
    assert os.path.isdir(folder)


def test_saved_tables_and_buckets_can_be_cleared(spark, monkeypatch):
    monkeypatch.setattr(shared, "_saved", [])
    rows = spark.range(100).select("id", (F.col("id") % 7).alias("k"))
    one, two = shared.save(rows, "plain"), shared.save_bucketed(rows, "buckets", 4, "k")
    assert _rows(one) == _rows(two) == _rows(rows)
    # groups by the bucket's column need no shuffle
    plan = two.groupBy("k").count()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    folders = [p.removeprefix("file:") for p in shared._saved]
    assert len(folders) == 2 and all(map(os.path.isdir, folders))
    shared.clear(spark)
    assert not any(map(os.path.exists, folders)) and not shared._saved


def test_the_rest_imports_without_the_corpus_operators(tmp_path):
    for name in ("lattica", "__spark_entry__.py", "bench.py", "corpus_pipeline.py"):
        source = os.path.join(ROOT, name)
        if os.path.isdir(source):
            shutil.copytree(source, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
        elif os.path.exists(source):
            shutil.copy(source, tmp_path / name)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not [n for n in q if n.startswith('op') or n == 'pipeline']; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})
