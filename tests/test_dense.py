"""Spatial operators where boxes lie so densely that they go by blocks, against brute force."""

import collections
import random

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__  # noqa: F401  registers the queries
from lattica.functions import boxes as bx
from lattica.operators import geometry, joins, planar
from lattica.plans import registry

BOXES = "id long, page int, x0 double, y0 double, x1 double, y1 double"


def _boxes(n, seed, width=30):
    r = random.Random(seed)
    rows = [(k * 7919 % 10007, k % 2, float(x := r.randrange(width)), float(y := r.randrange(width)), float(x + r.randrange(1, 9)), float(y + r.randrange(1, 9))) for k in range(n)]
    return [*rows, (20000, None, 0.0, 0.0, 1.0, 1.0), (20001, 0, None, 0.0, 1.0, 1.0)]


def _gap2(p, q):
    return max(0.0, p[2] - q[4], q[2] - p[4]) ** 2 + max(0.0, p[3] - q[5], q[3] - p[5]) ** 2


def _fine(rows):
    return [b for b in rows if b[1] is not None and b[2] is not None]


@pytest.mark.parametrize("ring", [0.25, 1.0])
def test_nearest_in_dense_pages(spark, ring):
    left, right = [*_boxes(150, 1), (30000, 0, 100.0, 5.0, 101.0, 6.0), (30001, 1, 33.0, 45.0, 34.0, 46.0)], _boxes(900, 2)
    a, b = spark.createDataFrame(left, BOXES), spark.createDataFrame(right, BOXES)
    want = set()
    for p in _fine(left):
        near = sorted((_gap2(p, q), q[0]) for q in _fine(right) if q[1] == p[1] and _gap2(p, q) <= 400)
        want |= {(p[1], p[0], i, d, n + 1) for n, (d, i) in enumerate(near[:2])}
    assert geometry._first_touching(a, b, 2, ["id"], ["b_id"])[0].count() > 150
    assert {tuple(x) for x in geometry.nearest(a, b, 20.0, 2, ring).collect()} == want


def test_nearest_by_class_in_dense_pages(spark):
    left, right, reaches = [*_boxes(150, 3), (30000, 0, 36.0, 5.0, 37.0, 6.0)], _boxes(900, 4), {"0": 2.0, "1": 20.0}
    a, b = spark.createDataFrame([(*p, p[0] % 3) for p in left], BOXES + ", class int"), spark.createDataFrame(right, BOXES)
    want = set()
    for p in _fine(left):
        reach = reaches.get(str(p[0] % 3))
        near = sorted((_gap2(p, q), -max(q[4] - q[2], q[5] - q[3]), q[0]) for q in _fine(right) if reach and q[1] == p[1] and _gap2(p, q) <= reach * reach)
        want |= {(p[1], p[0], i, d, n + 1) for n, (d, _, i) in enumerate(near[:3])}
    assert {tuple(x) for x in geometry.nearest_by_class(a, b, "class", reaches, 3).collect()} == want


@pytest.mark.parametrize("n", [40, 900])
def test_mutual_pairs_in_dense_pages(spark, n):
    lone = [(40000 + k, 1, 60.0 + 40 * k, 0.0, 61.0 + 40 * k, 1.0) for k in range(5)]
    left, right = [*_boxes(n, 5), *lone, lone[0]], [*_boxes(n, 6), *[(50000 + x[0], *x[1:]) for x in lone[:4]], (60000, 1, 181.0, 2.0, 182.0, 3.0)]
    pairs = {(p[0], q[0]) for p in _fine(left) for q in _fine(right) if p[1] == q[1] and _gap2(p, q) <= 16}
    of_a, of_b = collections.Counter(a for a, _ in pairs), collections.Counter(b for _, b in pairs)
    got = geometry.mutual_within(spark.createDataFrame(left, BOXES), spark.createDataFrame(right, BOXES), 4.0)
    want = {(a, b) for a, b in pairs if of_a[a] == 1 == of_b[b]}
    assert len(want) >= 3 and collections.Counter(map(tuple, got.collect())) == collections.Counter(want)


def test_only_segments_that_repeat_an_id_are_told_apart(spark):
    r = random.Random(9)
    across = [(k % 40, 0, float(x := r.randrange(30)), float(x + r.randrange(9)), float(k % 40 % 13)) for k in range(120)]
    upright = [(k % 40, 0, float(k % 40 % 11 * 3), float(y := r.randrange(13)), float(y + r.randrange(9))) for k in range(120)]
    want = set()
    for i, _, x0, x1, y in across:
        for j, _, x, y0, y1 in upright:
            if x0 - 1 <= x <= x1 + 1 and y0 - 1 <= y <= y1 + 1:
                own, other = min(abs(x - x0), abs(x - x1)) <= 1, min(abs(y - y0), abs(y - y1)) <= 1
                want.add((0, i, j, x, y, "corner" if own and other else "end" if own or other else "cross"))
    a, b = spark.createDataFrame(across, "id int, page int, x0 double, x1 double, y double"), spark.createDataFrame(upright, "id int, page int, x double, y0 double, y1 double")
    got = geometry.meetings(a, b, 4.0, 1.0)
    assert collections.Counter(map(tuple, got.collect())) == collections.Counter(want)


@pytest.mark.parametrize("per_tile", [40, 300])
def test_assignment_by_tiles_equals_the_loop(spark, monkeypatch, per_tile):
    r = random.Random(11)

    def boxes(n, first):
        rows = [(first + k * 7919 % 10007, k % 2, float(x := r.randrange(120)), float(y := r.randrange(120)), float(x + r.randrange(4)), float(y + r.randrange(4))) for k in range(n)]
        # ids in several places, and on the other page
        return [*rows, *[(*rows[k][:2], 60.0 + k, 60.0, 61.0 + k, 62.0) for k in range(5)], (rows[7][0], 1 - rows[7][1], 50.0, 50.0, 51.0, 51.0), rows[9], (None, 0, 5.0, 5.0, 6.0, 6.0), (20000, None, 0.0, 0.0, 1.0, 1.0), (20001, 0, None, 0.0, 1.0, 1.0)]

    left, right, used, want = boxes(1500, 0), boxes(1400, 30000), (set(), set()), collections.Counter()
    for d, a, b in sorted((_gap2(p, q), p[0], q[0]) for p in _fine(left) for q in _fine(right) if p[1] == q[1] and None not in (p[0], q[0]) and _gap2(p, q) <= 9):
        if a not in used[0] and b not in used[1]:
            used[0].add(a), used[1].add(b)
            want[a, b, d] += 1
    met = []
    monkeypatch.setattr(geometry, "greedy_pairs", lambda pairs, *rest: met.append(pairs.count()) or joins.greedy_pairs(pairs, *rest))
    got = geometry.assigned(spark.createDataFrame(left, BOXES), spark.createDataFrame(right, BOXES), 3.0, 50, per_tile)
    assert collections.Counter(map(tuple, got.collect())) == want
    # most are settled without being paired
    assert met[0] < 500


@pytest.mark.parametrize("inside", [None, 0.8])
def test_suppression_by_tiles_equals_the_loop(spark, monkeypatch, inside):
    r = random.Random(12)
    score = lambda: r.choice([None, float("nan"), -1.0, 0.0, 1.0, 2.0, 3.0])
    rows = [(k * 7919 % 10007, k % 2, float(x := r.randrange(150)), float(y := r.randrange(150)), float(x + r.randrange(3, 7)), float(y + r.randrange(7)), score()) for k in range(2500)]
    rows += [(20000 + k, *x[1:6], score()) for k, x in enumerate(rows[:200])]  # copies in the same places
    kept = collections.defaultdict(list)
    for b in sorted(rows, key=lambda b: (b[6] is None, b[6] == b[6], -(b[6] if b[6] and b[6] == b[6] else 0), b[0])):
        for k in kept[b[1]]:
            w, h = min(k[4], b[4]) - max(k[2], b[2]), min(k[5], b[5]) - max(k[3], b[3])
            if w > 0 and h > 0:
                one, two = ((x[4] - x[2]) * (x[5] - x[3]) for x in (k, b))
                if w * h / (one + two - w * h) >= 0.45 or (inside and w * h / min(one, two) >= inside):
                    break
        else:
            kept[b[1]].append(b)
    want = [(b[1], b[0]) for bs in kept.values() for b in bs] + [(None, 30000), (0, 30001), (0, None)]
    rows += [(30000, None, 0.0, 0.0, 4.0, 4.0, 9.0), (30001, 0, None, 0.0, 4.0, 4.0, 9.0), (None, 0, 0.0, 0.0, 4.0, 4.0, 9.0)]
    met, rounds = [], geometry._suppressed_in_rounds
    monkeypatch.setattr(geometry, "_suppressed_in_rounds", lambda boxes, *rest: met.append(boxes.count()) or rounds(boxes, *rest))
    got = geometry.suppressed(spark.createDataFrame(rows, BOXES + ", score double"), 0.45, 8.0, inside, 100, 200)
    assert collections.Counter(map(tuple, got.collect())) == collections.Counter(want)
    assert met[0] < 500


def test_rounding_by_doubles_equals_the_database(spark):
    values = sorted({p / q for q in [*range(1, 60), 625, 1024, 5120, 10240] for p in range(q)} | {-0.5, -2.0000000005, 1e300, 123456.0000005})
    df = spark.createDataFrame([(v,) for v in [*values, None, float("inf")]], "v double")
    got = {x.v: x.r for x in df.select("v", bx.rounded(F.col("v"), 9).alias("r")).collect()}
    con = duckdb.connect()
    con.execute("create table t (v double)")
    con.executemany("insert into t values (?)", [(v,) for v in got])
    assert dict(con.execute("select v, round(v, 9) from t").fetchall()) == got
    for name in ("pixel_boxes", "box_measures"):
        plan = registry.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        # decimals took most of the time of each pair
        assert "round(" not in plan


@pytest.mark.parametrize("tolerance", [0.0, 1.0])
def test_rectangles_where_segments_cross_densely(spark, monkeypatch, tolerance):
    r = random.Random(7)
    across = [(k, k % 2, float(x := r.randrange(6)), float(x + r.randrange(0, 4)), float(r.randrange(6))) for k in range(120)]
    upright = [(k, k % 2, float(r.randrange(6)), float(y := r.randrange(6)), float(y + r.randrange(0, 4))) for k in range(120)]
    near = lambda p, q: abs(p - q) <= tolerance
    corner = lambda h, v, x, y: h[1] == v[1] and near(v[2], h[x]) and near(h[4], v[y])
    hs, vs, want = [h for h in across if h[2] < h[3]], [v for v in upright if v[3] < v[4]], set()
    for top in hs:
        lefts, rights = [v for v in vs if corner(top, v, 2, 3)], [v for v in vs if corner(top, v, 3, 3)]
        for left in lefts:
            for low in (h for h in hs if corner(h, left, 2, 4)):
                want |= {(top[1], top[0], low[0], left[0], v[0], left[2], top[4], v[2], low[4]) for v in rights if corner(low, v, 3, 4) and left[2] < v[2] and top[4] < low[4]}
    a = spark.createDataFrame([*across, across[0]], "id long, page int, x0 double, x1 double, y double")
    b = spark.createDataFrame([*upright, upright[0]], "id long, page int, x double, y0 double, y1 double")
    if not tolerance:
        # crossings that are no corner were all made before
        monkeypatch.setattr(geometry, "_pairs", None)
    assert len(want) >= 3 and collections.Counter(map(tuple, geometry.rectangles(a, b, 4.0, tolerance).collect())) == collections.Counter(want)


def test_pieces_look_nothing_up_again(spark):
    segments = spark.createDataFrame([(1, 0, 0.0, 0.0, 9.0, 0.0), (2, 0, 4.0, 0.0, 4.0, 5.0), (3, 1, 0.0, 0.0, 9.0, 0.0), (4, 0, 2.0, -0.4, 2.0, -3.0)], BOXES)
    cut = planar.pieces(segments, 4.0, 1.0)
    assert sorted(map(tuple, cut.select("id", "piece", "u", "v").collect())) == [(1, 1, "0,0", "2,0"), (1, 2, "2,0", "4,0"), (1, 3, "4,0", "9,0"), (2, 1, "4,0", "4,5"), (3, 1, "0,0", "9,0"), (4, 1, "2,-3", "2,0")]
    # places meet segments once; what was found was joined with both again before
    assert cut._jdf.queryExecution().optimizedPlan().toString().count("Join Inner") == 1


@pytest.mark.parametrize(("cell", "pad", "want"), [(32.0, 0.0, 8.0), (32.0, 2.0, 12.0), (100.0, 0.0, 25.0), (4.0, 0.0, 4.0)])
def test_cells_are_no_wider_than_boxes_need(spark, monkeypatch, cell, pad, want):
    used, dealt = [], geometry._dealt
    monkeypatch.setattr(geometry, "_dealt", lambda df, others, cell, pad: used.append(cell) or dealt(df, others, cell, pad))
    a, b = [*_boxes(60, 6), (1, 0, 0.0, 0.0, 8.0, 1.0)], _boxes(60, 7)
    got = collections.Counter(tuple(x) for x in geometry._pairs(spark.createDataFrame(a, BOXES), spark.createDataFrame(b, BOXES), cell, pad).select("page", "a_id", "b_id").collect())
    touch = lambda p, q: p[2] - pad <= q[4] and q[2] <= p[4] + pad and p[3] - pad <= q[5] and q[3] <= p[5] + pad
    assert used == [want, want]
    assert got == collections.Counter((p[1], p[0], q[0]) for p in _fine(a) for q in _fine(b) if p[1] is not None and p[1] == q[1] and touch(p, q))


def test_assignment_where_many_touch(spark, monkeypatch):
    r = random.Random(13)
    boxes = lambda first: [(first + k * 7919 % 10007, 0, float(x := r.randrange(60)), float(y := r.randrange(60)), x + 3.0, y + 3.0) for k in range(4000)]
    left, right, used, want, at = boxes(0), boxes(30000), (set(), set()), collections.Counter(), collections.defaultdict(list)
    for q in right:
        at[q[2] // 5, q[3] // 5].append(q)
    near = lambda p: [q for i in (-1, 0, 1) for j in (-1, 0, 1) for q in at[p[2] // 5 + i, p[3] // 5 + j]]
    for d, a, b in sorted((d, p[0], q[0]) for p in left for q in near(p) if (d := _gap2(p, q)) <= 1):
        if a not in used[0] and b not in used[1]:
            used[0].add(a), used[1].add(b)
            want[a, b, d] += 1
    met = []
    monkeypatch.setattr(geometry, "greedy_pairs", lambda pairs, *rest: met.append(pairs.count()) or joins.greedy_pairs(pairs, *rest))
    got = geometry.assigned(spark.createDataFrame(left, BOXES), spark.createDataFrame(right, BOXES), 1.0, 50, 400)
    assert collections.Counter(map(tuple, got.collect())) == want
    # tiles as wide for few settled little, so most met as pairs
    assert met[0] < 1000


@pytest.mark.parametrize(("threshold", "inside"), [(0.0, None), (0.2, None), (0.9, None), (2.0, 0.5)])
def test_suppression_reads_boxes_once(spark, threshold, inside):
    r = random.Random(14)
    rows = [(k * 7919 % 10007, k % 2, float(x := r.randrange(90)), float(y := r.randrange(90)), float(x + r.randrange(3, 7)), float(y + r.randrange(7)), float(r.randrange(5))) for k in range(1200)]
    kept = collections.defaultdict(list)
    for b in sorted(rows, key=lambda b: (-b[6], b[0])):
        for k in kept[b[1]]:
            w, h = min(k[4], b[4]) - max(k[2], b[2]), min(k[5], b[5]) - max(k[3], b[3])
            if w >= 0 and h >= 0:
                one, two = ((x[4] - x[2]) * (x[5] - x[3]) for x in (k, b))
                if (w * h / (one + two - w * h) if one + two > w * h else 0.0) >= threshold or (inside and min(one, two) > 0 and w * h / min(one, two) >= inside):
                    break
        else:
            kept[b[1]].append(b)
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    boxes = spark.createDataFrame(rows, BOXES + ", score double")
    got = geometry.suppressed(boxes.mapInArrow(counted, boxes.schema), threshold, 8.0, inside, 100, 200)
    assert collections.Counter(map(tuple, got.collect())) == collections.Counter((b[1], b[0]) for bs in kept.values() for b in bs)
    # to count, to settle and to return them
    assert read.value == len(rows)


def test_rectangles_need_two_corners(spark):
    found = registry.QUERIES["rectangles"](spark, "/root/testdata/sf0.001")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    # four corners, two pairs of them and both pairs were joined before, and each read the table twice
    assert plan.count("Join Inner") == 3 and "l_orderkey" not in plan
    con = duckdb.connect()
    con.execute("create view lineitem as select * from '/root/testdata/sf0.001/lineitem.parquet'")
    assert collections.Counter(map(tuple, found.collect())) == collections.Counter(con.execute(registry.ORACLE_SQL["rectangles"]).fetchall())


def test_few_segments_that_repeat_an_id_shuffle_no_others(spark, monkeypatch):
    across = spark.createDataFrame([(k // 2, 0, float(k), float(k + 3), float(k % 5)) for k in range(40)], "id int, page int, x0 double, x1 double, y double")
    upright = spark.createDataFrame([(k // 2, 0, float(k), 0.0, float(k % 7)) for k in range(40)], "id int, page int, x double, y0 double, y1 double")
    saved = {}
    monkeypatch.setattr(geometry, "save", lambda df, name: saved.setdefault(name, df))
    plan = geometry.meetings(across, upright, 4.0, 1.0)._jdf.queryExecution().optimizedPlan().toString()
    # both sides were shuffled again for them, and twice each to find them
    assert (plan.count("strategy=merge"), plan.count("strategy=broadcast")) == (1, 2)
    for df in saved.values():
        df.collect()
        assert df._jdf.queryExecution().sparkPlan().toString().count("REPARTITION_BY_COL") == 1
        assert df._jdf.queryExecution().executedPlan().toString().count("ENSURE_REQUIREMENTS") == 0
