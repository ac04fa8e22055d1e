"""Rasters, planar graphs, intervals, chains, pairs and settled collisions against plain loops, with nulls, repeats and empty tables."""

import collections
import random
import time

import numpy as np
import pytest

from lattica.operators import geometry, graph, joins, planar, raster, relations, series, signatures
from lattica.sources import catalog, shared


def _rows(df):
    return collections.Counter(map(tuple, df.collect()))


def _flood(walls, frames):
    size = {}
    for p, w, h in frames:
        if p is not None and w and h and w > 0 and h > 0:
            size[p] = (max(w, size.get(p, (0, 0))[0]), max(h, size.get(p, (0, 0))[1]))
    out = collections.Counter()
    for p, (w, h) in size.items():
        open_ = {(x, y) for x in range(w) for y in range(h)} - {(x, y) for q, x, y in walls if q == p}
        while open_:
            todo = [min(open_, key=lambda c: (c[1], c[0]))]
            open_.discard(todo[0])
            region = []
            while todo:
                x, y = todo.pop()
                region.append((x, y))
                for c in ((x + 1, y), (x - 1, y), (x, y + 1), (x, y - 1)):
                    if c in open_:
                        open_.discard(c)
                        todo.append(c)
            xs, ys = [x for x, _ in region], [y for _, y in region]
            frame = min(xs) == 0 or min(ys) == 0 or max(xs) == w - 1 or max(ys) == h - 1
            out[(p, min(y * w + x for x, y in region), len(region), min(xs), min(ys), max(xs), max(ys), frame)] += 1
    return out


@pytest.mark.parametrize("tile", [5, 8, 64])
def test_regions_of_a_raster(spark, tile):
    r = random.Random(tile)
    walls = [(p, r.randrange(-2, 25), r.randrange(-2, 18)) for p in (1, 2, 5) for _ in range(330)]
    spiral = [(4, x, y) for x in range(23) for y in range(17) if (x % 4 == 1 and y != (0 if x % 8 == 1 else 16))]  # one region that winds through all tiles
    walls += [*spiral, (None, 1, 1), (1, None, 2), (1, 3, None), (9, 1, 1), walls[0]]
    frames = [(1, 23, 17), (2, 23, 17), (3, 9, 9), (4, 23, 17), (5, 20, 1), (5, 23, 16), (6, 0, 4), (None, 4, 4), (7, None, 3)]
    df, f = spark.createDataFrame(walls, "page int, x int, y int"), spark.createDataFrame(frames, "page int, width int, height int")
    want = _flood(walls, frames)
    got = raster.regions(df, f, tile, enclosed=False)
    assert _rows(got) == collections.Counter({k[:-1]: n for k, n in want.items()})
    assert _rows(raster.regions(df, f, tile)) == collections.Counter({k[:-1]: n for k, n in want.items() if not k[-1]})
    assert raster.regions(df.limit(0), f.limit(0), tile).count() == 0


def test_pieces_and_nets(spark):
    r = random.Random(3)
    segments = []
    for k in range(120):
        x, y, n = r.randrange(12), r.randrange(12), r.randrange(5)
        segments.append((k, k % 2, float(x), float(y), float(x + n * (k % 3 > 0)), float(y + n * (k % 3 == 0))))
    segments += [(900, 0, 0.0, 0.0, 3.0, 4.0), (901, 0, None, 0.0, 3.0, 0.0), (902, None, 0.0, 0.0, 3.0, 0.0), (903, 1, 5.0, 40.0, 2.0, 40.0), (904, 1, 3.2, 40.3, 3.2, 44.0), (905, 0, float("nan"), 1.0, 4.0, 1.0)]
    df = spark.createDataFrame(segments, "id int, page int, x0 double, y0 double, x1 double, y1 double")
    cut = shared.save(planar.pieces(df, 4.0, 1.0), "cut")
    flat = {(p, i): (min(a, c), min(b, d), max(a, c), max(b, d)) for i, p, a, b, c, d in segments[:120] + segments[-3:-1]}
    key = lambda x, y: f"{int(np.floor(x + 0.5))},{int(np.floor(y + 0.5))}"
    ends = {(p, x, y) for (p, _), b in flat.items() for x, y in (b[:2], b[2:])}
    want = collections.Counter()
    for (p, i), (x0, y0, x1, y1) in flat.items():
        at = {}
        for q, x, y in ends:
            if q == p and x0 - 0.5 <= x <= x1 + 0.5 and y0 - 0.5 <= y <= y1 + 0.5:
                d = min(max(x, x0), x1) - x0 + min(max(y, y0), y1) - y0
                at[key(x, y)] = min(d, at.get(key(x, y), d))
        order = [k for _, k in sorted((d, k) for k, d in at.items())]
        want.update((p, i, n + 1, u, v) for n, (u, v) in enumerate(zip(order, order[1:], strict=False)))
    assert _rows(cut) == want and any(i == 904 for _, i, *_ in want)
    stops = [(0, 5.0, 5.0), (1, 6.2, 6.0), (0, None, 1.0), (1, 3.0, 3.0), (1, 3.0, 3.0)]
    barred = {(p, key(x, y)) for p, x, y in stops if x is not None}
    parent = {}

    def root(a):
        while parent.setdefault(a, a) != a:
            a = parent[a]
        return a

    for p, i, n, u, v in want:
        a, b = ((p, k, *((i, n, s) if (p, k) in barred else ())) for s, k in (("u", u), ("v", v)))
        parent[root(a)] = root(b)
        parent[root((p, i, n))] = root(a)
    least = collections.defaultdict(lambda: 1 << 40)
    for p, i, n, _, _ in want:
        least[root((p, i, n))] = min(i, least[root((p, i, n))])
    got = planar.nets(cut, spark.createDataFrame(stops, "page int, x double, y double"), 1.0)
    assert _rows(got.select("page", "id", "piece", "net")) == collections.Counter((p, i, n, least[root((p, i, n))]) for p, i, n, _, _ in want)
    assert planar.nets(planar.pieces(df.limit(0), 4.0, 1.0), spark.createDataFrame([], "page int, x double, y double"), 1.0).count() == 0


def test_segments_in_one_place_are_cut_once(spark, monkeypatch):
    r = random.Random(5)
    places = [(k % 2, x := float(r.randrange(9)), y := float(r.randrange(9)), x + (k % 3 > 0) * (n := float(r.randrange(5))), y + (k % 3 == 0) * n) for k in range(50)]
    segments = [(r.random(), *p) for p in places for _ in range(6)]
    segments = [(k, *p) for k, (_, *p) in enumerate(sorted(segments))] + [(900, 0, 0.0, 0.0, 4.0, 0.0), (901, 0, float("nan"), 20.0, 2.0, 20.0), (902, 0, 0.0, 20.0, 4.0, 20.0)]
    df = spark.createDataFrame(segments, "id int, page int, x0 double, y0 double, x1 double, y1 double")
    stops = spark.createDataFrame([(0, 0.0, 20.0), (0, 4.0, 20.0), (0, 0.0, 0.0), (1, 3.0, 3.0), (1, 3.0, 4.0), (1, 6.0, 2.0)], "page int, x double, y double")
    saved = {}

    def save(df, name):
        saved[name] = shared.save(df, name)
        return saved[name]

    monkeypatch.setattr(planar, "save", save)
    got = planar.netted(df, stops, 4.0, 1.0)
    assert saved["cut"].count() <= len(set(places)) * 5 and saved["edges"].count() <= saved["cut"].count()
    cut = shared.save(planar.pieces(df, 4.0, 1.0), "cut")
    assert _rows(cut.where("id = 902").select("piece", "u", "v")) == {(1, "0,20", "4,20"): 1}
    assert _rows(got.drop("net")) == _rows(cut) and _rows(got) == _rows(planar.nets(cut, stops, 1.0))
    barred = {(s.page, f"{int(s.x)},{int(s.y)}") for s in stops.collect()}
    alone = [p for p in got.collect() if (p.page, p.u) in barred and (p.page, p.v) in barred]
    assert alone and all(p.net == p.id for p in alone)


def test_what_is_left_of_intervals(spark):
    r = random.Random(8)
    rows = [(r.choice([1, 2, None]), a := r.randrange(60), a + r.randrange(-1, 9)) for _ in range(60)] + [(1, None, 4), (1, 4, None), (3, 5, 5), (4, 0, 9)]
    other = [(r.choice([1, 2, None]), a := r.randrange(60), a + r.randrange(0, 7)) for _ in range(25)] + [(4, 3, 4), (4, 3, 4), (5, 1, 2)]
    a, b = (spark.createDataFrame(x, "k int, s int, e int") for x in (rows, other))
    want = collections.Counter()
    for k in {x[0] for x in rows}:
        units = lambda x, k=k: {u for q, s, e in x if q == k and s is not None and e is not None for u in range(s, e)}
        left = sorted(units(rows) - units(other))
        runs = [u for u in left if u - 1 not in left], [u + 1 for u in left if u + 1 not in left]
        want.update((k, s, e) for s, e in zip(*runs, strict=True))
    assert _rows(series.remaining(a, b, ["k"], "s", "e")) == want
    assert _rows(series.remaining(a, b.limit(0), [], "s", "e")) == collections.Counter(series.islands(a.where("s < e"), [], "s", "e").select("s", "e").rdd.map(tuple).collect())
    assert series.remaining(a.limit(0), b, ["k"], "s", "e").count() == 0


@pytest.mark.parametrize("anchored", [False, True])
def test_chains_on_two_levels(spark, anchored):
    r = random.Random(4)
    rows = [(r.choice(["a", None]), r.randrange(40), s := r.randrange(50), s + r.randrange(6)) for _ in range(150)]
    df = spark.createDataFrame([*rows, ("a", None, 1, 2), ("a", 3, None, 2), ("a", 3, 9, 2), rows[0]], "k string, y int, s int, e int")
    rows.append(rows[0])
    want = collections.Counter()
    for k in ("a", None):
        line, last = {}, None
        for y in sorted({x[1] for x in rows if x[0] == k}):
            begin = last is None or y - (line[last] if anchored else last) > 2
            line[y], last = (y if begin else line[last]), y
        for begin in set(line.values()):
            piece = sorted((s, e, y) for q, y, s, e in rows if q == k and line[y] == begin)
            while piece:
                island, reach = [piece.pop(0)], None
                reach = island[0][1]
                while piece and piece[0][0] <= reach + 1:
                    island.append(piece.pop(0))
                    reach = max(reach, island[-1][1])
                ys = [y for _, _, y in island]
                want[(k, begin, min(ys), max(ys), min(s for s, _, _ in island), reach, len(island))] += 1
    assert _rows(series.chained(df, ["k"], "y", 2, "s", "e", 1, anchored)) == want
    assert series.chained(df.limit(0), ["k"], "y", 2, "s", "e", 1, anchored).count() == 0


def test_mutual_pairs(spark):
    r = random.Random(6)
    pairs = [(r.randrange(40), r.randrange(40)) for _ in range(45)]
    open_, want = set(pairs), collections.Counter()
    for k in (1, 2, 3):
        a, b = collections.Counter(x for x, _ in open_), collections.Counter(y for _, y in open_)
        now = {(x, y) for x, y in open_ if a[x] == 1 and b[y] == 1}
        want.update((x, y, k) for x, y in now)
        open_ = {(x, y) for x, y in open_ if x not in {p for p, _ in now} and y not in {q for _, q in now}}
    df = spark.createDataFrame([*pairs, pairs[0], (None, 3), (99, None)], "a int, b int")
    assert _rows(joins.mutual_pairs(df, "a", "b", 3)) == want and joins.mutual_pairs(df.limit(0), "a", "b").count() == 0


def test_prefixes_hot_words_and_rows(spark, monkeypatch):
    r = random.Random(2)
    a = [(k, "".join(r.choices("ab", k=r.randrange(7)))) for k in range(40)] + [(90, None), (91, " "), (92, "x" * 5000), (93, "é𝄞é")]
    b = [(k, "".join(r.choices("aB", k=r.randrange(9)))) for k in range(40)] + [(90, None), (92, "X" * 4097), (93, "É𝄞")]
    left, right = spark.createDataFrame(a, "i int, t string"), spark.createDataFrame(b, "j int, u string")
    low = lambda t: (t or "").strip().lower()
    want = collections.Counter((i, j) for i, t in a for j, u in b if low(t) and low(u) and (low(t).startswith(low(u)) or low(u).startswith(low(t))))
    assert _rows(joins.prefix_join(left, right, "t", "u").select("i", "j")) == want
    monkeypatch.setattr(joins, "SPLIT", 4)
    p = spark.createDataFrame([(k, f"hot w{k % 7}") for k in range(50)] + [(60, None), (61, "none")], "i int, t string")
    q = spark.createDataFrame([(k, f"{'hot' if k < 3 else 'w'} w{k}") for k in range(9)], "j int, u string")
    pairs = {(i, j) for i in range(50) for j in range(9) if j < 3 or i % 7 == j}
    assert _rows(joins.token_join(p, q, "i", "j", "t", "u")) == collections.Counter(pairs)
    got = joins.token_rows(p, q, "i", "j", "t", "u")
    assert got.columns == ["i", "t", "j", "u"] and _rows(got.select("i", "j")) == collections.Counter([*pairs, (60, None), (61, None)])


@pytest.mark.parametrize("one_task", [0, 100_000])
def test_collisions_settled_in_rounds_or_in_one_task(spark, one_task):
    r = random.Random(5)
    boxes = [(k, k % 2, x := r.random() * 60, y := r.random() * 60, x + 9 + r.random() * 6, y + 9, r.choice([0.1, 0.5, 0.9, None])) for k in range(90)]
    df = spark.createDataFrame(boxes, "id long, page int, x0 double, y0 double, x1 double, y1 double, score double")

    def shared_area(a, b):
        return max(0, min(a[4], b[4]) - max(a[2], b[2])) * max(0, min(a[5], b[5]) - max(a[3], b[3]))

    area = lambda a: (a[4] - a[2]) * (a[5] - a[3])
    for inside in (None, 0.45):
        kept = []
        for b in sorted(boxes, key=lambda b: (b[6] is None, -(b[6] or 0), b[0])):
            hit = [k for k in kept if k[1] == b[1] and ((s := shared_area(k, b)) / (area(k) + area(b) - s) >= 0.2 or (inside and s / min(area(k), area(b)) >= inside))]
            if not hit:
                kept.append(b)
        assert _rows(geometry.suppressed(df, 0.2, 10.0, inside, one_task)) == collections.Counter((b[1], b[0]) for b in kept)
    pairs = sorted({(r.randrange(20), r.randrange(20)): r.choice([1.0, 2.0, 3.0]) for _ in range(120)}.items(), key=lambda x: (x[1], *x[0]))
    used, want = (set(), set()), collections.Counter()
    for (a, b), d in pairs:
        if a not in used[0] and b not in used[1]:
            used[0].add(a)
            used[1].add(b)
            want[(a, b, d)] += 1
    assert _rows(joins.greedy_pairs(spark.createDataFrame([(a, b, d) for (a, b), d in pairs], "a int, b int, d double"), "a", "b", "d", one_task)) == want


def test_a_long_chain_of_boxes_takes_few_jobs(spark):
    n = 10_000
    rows = spark.range(n).selectExpr("id", "1 as page", "id * 6.0 as x0", "0.0 as y0", "id * 6.0 + 10 as x1", "10.0 as y1", f"({n} - id) * 1.0 as score")
    spark.sparkContext.setJobGroup("chain", "chain")
    kept = {x.id for x in geometry.suppressed(rows, 0.2, 10.0).collect()}
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("chain")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert kept == set(range(0, n, 2)) and len(jobs) <= 20


def test_samples_and_pages_with_totals(spark):
    old = spark.createDataFrame([(" a", None), ("b", "x"), ("c", "x"), ("d", "")], "k string, v string")
    new = spark.createDataFrame([("b", "x"), ("z", None)], "k string, v string")
    assert sorted(map(tuple, joins.overlap_samples(old, new, ["k", "v"], 2).collect())) == [("k", ["a", "c"], ["z"]), ("v", [], [])]
    assert [tuple(r) for r in relations.page_with_total(old, ["k"], 1, 2).collect()] == [("b", "x", 4), ("c", "x", 4)] and relations.page_with_total(old, ["k"], 9, 2).count() == 0


def test_statements_that_reach_further_are_refused(spark):
    spark.range(5).createOrReplaceTempView("five")
    ok = ["SELECT id FROM five", "WITH x AS (SELECT id, upper('a') u FROM five) SELECT count(*) FROM x WHERE id IN (SELECT id FROM five)", "SELECT * FROM range(3)"]
    for statement in ok:
        assert relations.read_only(spark, statement, 9).count()
    reach = "reflect('java.lang.System', 'setProperty', 'lattica.probe', 'x')"
    for statement in (f"SELECT {reach}", f"SELECT id FROM five WHERE id IN (SELECT length({reach}) FROM five)", f"WITH x AS (SELECT java_method('java.lang.System', 'getProperty', 'user.home')) SELECT * FROM x", "SELECT try_reflect('java.lang.System', 'exit', 1)", "SELECT * FROM csv.`/etc/hosts`", "SELECT * FROM text.`/etc/hosts`", "SELECT id FROM five ORDER BY input_file_name()", f"SELECT id FROM five GROUP BY id HAVING max({reach}) = 'a'", "SELECT no_such_function(1)"):  # noqa: F541
        with pytest.raises(ValueError):
            relations.read_only(spark, statement, 1)
    assert spark._jvm.java.lang.System.getProperty("lattica.probe") is None
    assert [r.id for r in relations.read_only_rows(spark, "SELECT id FROM five ORDER BY id", 2, 60)] == [0, 1]
    began = time.time()
    with pytest.raises(Exception, match="(?i)cancel"):
        relations.read_only_rows(spark, "SELECT max(sha2(cast(a.id * b.id AS string), 512)) FROM range(10000000) a JOIN range(10000000) b ON a.id <> b.id", 1, 2)
    assert time.time() - began < 60 and spark.range(3).count() == 3


def test_views_that_reach_further_are_refused(spark):
    spark.range(5).createOrReplaceTempView("five")
    reach = "reflect('java.lang.System', 'setProperty', 'lattica.view', 'x')"
    views = {
        "sly": f"SELECT {reach} AS v, id FROM five",
        "slier": "SELECT id FROM (SELECT * FROM sly WHERE id > 1) WHERE v IS NULL",
        "slyest": f"WITH x AS (SELECT id FROM five WHERE id IN (SELECT length({reach}) FROM five)) SELECT * FROM x",
        "named": "SELECT current_user() AS who",
    }
    for name, body in views.items():
        spark.sql(f"CREATE OR REPLACE TEMP VIEW {name} AS {body}")
    for name in views:
        for statement in (f"SELECT * FROM {name}", f"SELECT id FROM five WHERE EXISTS (SELECT 1 FROM {name})", f"WITH x AS (SELECT * FROM {name}) SELECT count(*) FROM x"):
            with pytest.raises(ValueError, match="a view calls"):
                relations.read_only(spark, statement, 1)
    assert spark._jvm.java.lang.System.getProperty("lattica.view") is None
    spark.sql("CREATE OR REPLACE TEMP VIEW plain AS SELECT upper(cast(id AS string)) AS u, assert_true(id < 9) AS a FROM five")
    assert relations.read_only(spark, "SELECT u FROM plain p JOIN five ON p.u = five.id", 9).count() == 5


def test_row_estimates_come_from_the_catalogue(spark, tmp_path):
    spark.range(7).write.option("path", str(tmp_path / "t")).saveAsTable("lattica_estimated")
    try:
        assert catalog.row_estimate(spark, "lattica_estimated") == (7, False)
        spark.sql("ANALYZE TABLE lattica_estimated COMPUTE STATISTICS")
        assert catalog.row_estimate(spark, "lattica_estimated") == (7, True)
        assert [tuple(r)[-2:] for r in catalog.inventory(spark, "estimated").collect()] == [(7, True)]
        shared.clear(spark)  # what others saved stays
        assert spark.table("lattica_estimated").count() == 7
    finally:
        spark.sql("DROP TABLE lattica_estimated")


def test_template_scores(spark):
    r = np.random.default_rng(3)
    rows = [(k % 3 or None, k, float(v)) for k, v in enumerate(r.integers(0, 9, 60))] + [(1, 900, None), (1, 901, 2.0), (2, 902, 5.0), (2, 903, 5.0), (2, 904, 5.0), (2, 905, 5.0)]
    templates = {"up": [1.0, 2.0, 4.0], "flat": [2.0, 2.0], "long": [0.0, 1.0, 0.0, 1.0]}
    want = {}
    for g in (None, 1, 2):
        own = sorted((k, v) for q, k, v in rows if q == g)
        for i in range(len(own)):
            for name, t in templates.items():
                w = [v for _, v in own[i : i + len(t)]]
                if len(w) == len(t) and None not in w and np.std(w) > 0 and np.std(t) > 0:
                    want[(g, own[i][0], name)] = np.corrcoef(w, t)[0, 1]
    got = {(x.g, x.k, x.template): x.score for x in series.template_scores(spark.createDataFrame(rows, "g int, k int, v double"), ["g"], ["k"], "v", templates, ["k"]).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_running_means(spark):
    r = random.Random(12)
    rows = [(r.choice([1, None]), float(r.randrange(300))) for _ in range(200)] + [(2, float(k)) for k in range(60)] + [(2, 7.0)] * 5 + [(1, None), (1, float("nan"))]
    want = collections.Counter()
    for g in (1, 2, None):
        out = []
        for v in sorted(v for q, v in rows if q == g and v is not None and v == v):
            if out and v - sum(out[-1]) / len(out[-1]) <= 4:
                out[-1].append(v)
            else:
                out.append([v])
        want.update((g, round(sum(c) / len(c), 6), len(c), c[0], c[-1]) for c in out)
    df = spark.createDataFrame(rows, "g int, v double")
    assert collections.Counter((x.g, round(x.centre, 6), x.n, x.lo, x.hi) for x in series.running_means(df, ["g"], "v", 4.0).collect()) == want
    assert series.running_means(df.limit(0), ["g"], "v", 4.0).count() == 0


def test_running_means_of_many_small_groups_and_across_batches(spark):
    # thousands of wide stretches: a pandas group for each took far longer than the pass
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        df = spark.range(3000).selectExpr("if(id % 300 = 7, null, id div 10 + 9007199254740993) as g", "cast(id % 10 * 3 as double) as v")
        rows = sorted(((x.g is None, x.g or 0, x.v) for x in df.collect()))
        want, own, out = collections.Counter(), None, []
        for none, g, v in [*rows, (None, None, None)]:
            if own != (none, g):
                want.update((None if own[0] else own[1], round(sum(c) / len(c), 6), len(c), c[0], c[-1]) for c in out)
                own, out = (none, g), []
            if out and v - sum(out[-1]) / len(out[-1]) <= 4:
                out[-1].append(v)
            elif v is not None:
                out.append([v])
        got = series.running_means(df, ["g"], "v", 4.0)
        assert collections.Counter((x.g, round(x.centre, 6), x.n, x.lo, x.hi) for x in got.collect()) == want
        assert "FlatMapGroups" not in got._jdf.queryExecution().toString()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_traces_stop_at_boundaries(spark):
    r = random.Random(5)
    edges = [(r.randrange(40), r.randrange(40), r.choice("ab")) for _ in range(50)] + [(None, 1, "a"), (3, 3, "a"), (70, 71, None)]
    start, stops = [0, 1, 2, 70, 99, None], [4, 5, 6, 7, 1, None]
    df = spark.createDataFrame(edges, "u int, v int, kind string")
    got = graph.traced(df, spark.createDataFrame([(x,) for x in [*start, 0]], "start int"), spark.createDataFrame([(x,) for x in stops], "node int"), 9)
    ways = collections.defaultdict(set)
    for u, v, k in edges:
        if u is not None and u != v:
            ways[u].add((v, k))
            ways[v].add((u, k))
    want, told = collections.Counter(), {}
    for s in start[:-1]:
        seen, last = {s: (0, None, None)}, [s]
        for hop in range(1, 10):
            found = {}
            for a in last:
                for b, k in ways[a] if a not in stops or hop == 1 else ():
                    if b not in seen and (b not in found or (a, k or "") < (found[b][0], found[b][1] or "")):
                        found[b] = (a, k)
            seen |= {b: (hop, *x) for b, x in found.items()}
            last = list(found)
        want.update((s, n, *x, n in stops) for n, x in seen.items())
        told[s] = "stopped" if any(n in stops and n != s for n in seen) else "alone" if len(seen) == 1 else "closed"
    assert _rows(got) == want
    assert {x.start: x.outcome for x in graph.outcomes(got).collect()} == told


@pytest.mark.parametrize("one_task", [0, 10_000])
def test_components_in_rounds_or_in_one_task(spark, one_task):
    r = random.Random(6)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(120)] + [(k, k + 1) for k in range(300, 420)] + [(None, 1), (7, 7)]
    got = {x.node: x.root for x in graph.components(spark.createDataFrame(edges, "u int, v int"), one_task).collect()}
    parent = {}

    def root(k):
        while parent.setdefault(k, k) != k:
            k = parent[k]
        return k

    for u, v in edges:
        if u is not None and u != v:
            parent[root(u)] = root(v)
    assert got.keys() == parent.keys()
    assert len({(root(k), got[k]) for k in got}) == len({root(k) for k in got}) == len(set(got.values()))


def test_signatures_of_point_sets(spark):
    r = np.random.default_rng(8)
    sets = {k: r.normal(size=(r.integers(3, 30), 2)) * [3, 1] for k in range(20)}
    for k in range(20):  # turned, scaled and moved
        a = r.uniform(0, 6)
        sets[100 + k] = sets[k] @ np.array([[np.cos(a), -np.sin(a)], [np.sin(a), np.cos(a)]]) * r.uniform(0.5, 9) + r.normal(size=2) * 50
    rows = [(k, float(x), float(y)) for k, pts in sets.items() for x, y in pts] + [(500, 1.0, 1.0), (500, 1.0, 1.0), (None, 1.0, 2.0), (0, None, 1.0), (0, float("nan"), 1.0)]
    found = shared.save(signatures.moment_invariants(spark.createDataFrame(rows, "k int, x double, y double"), "k"), "found")
    got = {x.k: np.array([x[c] for c in signatures.NAMES]) for x in found.collect()}
    assert set(got) == set(sets) and all(np.allclose(got[k], got[100 + k], atol=1e-6) for k in range(20))
    near = signatures.near_vectors(found, found, "k", signatures.NAMES, 0.05).collect()
    want = {(a, b) for a in got for b in got if np.abs(got[a] - got[b]).max() <= 0.05}
    assert {(x.a, x.b) for x in near} == want and len(near) == len(want) and {(k, 100 + k) for k in range(20)} <= want
