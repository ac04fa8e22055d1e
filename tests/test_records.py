"""Logs, surveys, schemas and classes of boxes against plain loops, with nulls, repeats and empty tables."""

import collections
import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from lattica.functions import boxes as bx
from lattica.functions import text
from lattica.operators import geometry, joins, relations, series, summaries
from lattica.sources import files


def _rows(df):
    return collections.Counter(map(tuple, df.collect()))


def test_nearest_by_class_equals_the_loop(spark):
    r = random.Random(5)
    box = lambda k, c: (k, r.randrange(2), x := r.randrange(90) * 1.0, y := r.randrange(90) * 1.0, x + r.randrange(12), y + r.randrange(12), c)
    left = [box(k, "abz"[k % 3]) for k in range(90)]
    right = [box(k, "") for k in range(120)]
    bad = [(900, 0, None, 1.0, 2.0, 3.0, "a"), (901, None, 1.0, 1.0, 2.0, 2.0, "a"), (902, 0, 5.0, 5.0, 1.0, 1.0, "b"), (903, 1, float("nan"), 1.0, 2.0, 2.0, "a"), (904, 1, 3.0, 3.0, 4.0, 4.0, None)]
    kind = "id int, page int, x0 double, y0 double, x1 double, y1 double, class string"
    reaches = {"a": 3.0, "b": 15.0}
    want = collections.Counter()
    for i, p, x0, y0, x1, y1, c in left:
        near = []
        for j, q, u0, v0, u1, v1, _ in right:
            d = max(0, x0 - u1, u0 - x1) ** 2 + max(0, y0 - v1, v0 - y1) ** 2
            if p == q and c in reaches and d <= reaches[c] ** 2:
                near.append((d, -max(u1 - u0, v1 - v0), j))
        want.update((p, i, j, d, n + 1) for n, (d, _, j) in enumerate(sorted(near)[:3]))
    a, b = spark.createDataFrame(left + bad, kind), spark.createDataFrame(right + bad[:4], kind)
    assert _rows(geometry.nearest_by_class(a, b, "class", reaches, 3)) == want
    assert geometry.nearest_by_class(a.limit(0), b, "class", reaches, 3).count() == 0 == geometry.nearest_by_class(a, b.limit(0), "class", reaches, 3).count()
    with pytest.raises(ValueError):
        geometry.nearest_by_class(a, b, "class", {}, 3)


def test_kinds_of_meetings(spark):
    across = spark.createDataFrame([(1, 0, 0.0, 10.0, 5.0), (1, 0, 0.0, 10.0, 5.0), (2, 0, None, 1.0, 1.0), (3, 0, 9.0, 2.0, 20.0)], "id int, page int, x0 double, x1 double, y double")
    upright = spark.createDataFrame([(1, 0, 0.5, 5.0, 9.0), (2, 0, 5.0, 5.5, 9.0), (3, 0, 5.0, 0.0, 9.0), (4, 0, 10.0, 1.0, 8.0), (5, 1, 5.0, 0.0, 9.0), (6, 0, 2.0, 19.0, 21.0)], "id int, page int, x double, y0 double, y1 double")
    got = {(r.a_id, r.b_id): r.kind for r in geometry.meetings(across, upright, 4.0, 1.0).collect()}
    assert got == {(1, 1): "corner", (1, 2): "end", (1, 3): "cross", (1, 4): "end", (3, 6): "corner"}
    assert geometry.meetings(across, upright, 4.0, 1.0).count() == 5  # repeated rows once
    assert geometry.meetings(across.limit(0), upright, 4.0).count() == 0


def test_reciprocal_within_and_surveys(spark):
    rows = spark.createDataFrame([("n", 1, 2), ("n", 2, 1), ("m", 3, 4), ("n", 4, 3), (None, 5, 6), (None, 6, 5), ("n", None, 1), ("n", 7, 7), ("n", 1, 2)], "net string, a int, b int")
    assert _rows(joins.reciprocal(rows, "a", "b", ["net"])) == collections.Counter({("n", 1, 2): 1, (None, 5, 6): 1})
    assert _rows(joins.reciprocal(rows, "a", "b")) == collections.Counter({(1, 2): 1, (3, 4): 1, (5, 6): 1})
    left, right = spark.createDataFrame([(" a",), ("b b",), ("",), (None,), ("a",)], "v string"), spark.createDataFrame([("a",), ("x b",), (None,)], "w string")
    assert joins.survey(left, right, "v", "w").first()[:] == (True, None, 1, 2)
    assert joins.survey(left, right, "v", "w", "words").first()[:] == (True, None, 2, 2)
    assert [joins.survey(left, right, *c).first()[:2] for c in (("v", "q"), ("q", "w"), ("p", "q"))] == [(False, "right"), (False, "left"), (False, "both")]
    assert joins.survey(left, right, "v", "q").first()[2:] == (None, None)
    assert joins.survey(left.limit(0), right, "v", "w").first()[:] == (True, None, 0, 0)


def test_replays_and_appended_logs(spark):
    log = spark.createDataFrame([(k, k % 3) for k in range(40)] + [(40, None)], "k int, v int")
    newest = [F.desc("k")]
    got = lambda scan, limit, where: [tuple(r) for r in relations.replayed(log, newest, where, scan, limit).orderBy(F.desc("k")).select("k", "truncated").collect()]
    one = F.col("v") == 1
    assert got(100, 100, one) == [(k, False) for k in range(37, 0, -3)]
    assert got(10, 100, one) == [(37, True), (34, True), (31, True)]  # 40 to 31 were read, there is more behind
    assert got(41, 13, one) == [(k, False) for k in range(37, 0, -3)] and got(41, 2, one) == [(37, True), (34, True)]
    assert got(5, 3, F.col("v") == 9) == [] and relations.replayed(log.limit(0), newest, one, 5, 5).count() == 0
    new = spark.createDataFrame([(1, 99), (2, 100)], "v int, k int")
    assert [r.k for r in relations.appended(log, new, newest, 3).collect()] == [100, 99, 40]
    assert relations.appended(log.limit(0), new, newest, 3).count() == 2


def test_replacing_in_a_region(spark):
    kind = "page int, id int, x0 double, y0 double, x1 double, y1 double"
    old = spark.createDataFrame([(1, 1, 0.0, 0.0, 4.0, 4.0), (1, 2, 3.0, 0.0, 5.0, 4.0), (2, 3, 0.0, 0.0, 4.0, 4.0), (1, 4, None, 0.0, 4.0, 4.0), (None, 5, 0.0, 0.0, 4.0, 4.0)], kind)
    new = spark.createDataFrame([(9, 1, 1.0, 1.0, 2.0, 2.0)], "id int, page int, x0 double, y0 double, x1 double, y1 double")
    assert sorted(r.id for r in relations.replaced_in_region(old, new, 1, (0.0, 0.0, 3.0, 3.0)).collect()) == [2, 3, 4, 5, 9]
    assert relations.replaced_in_region(old.limit(0), new.limit(0), 1, (0.0, 0.0, 3.0, 3.0)).count() == 0


def test_schemas_hints_and_hidden_columns(spark):
    df = spark.createDataFrame([("7", "x", 1.5), ("no", None, None), (None, "y", 2.0)], "`Sheet No` string, Note string, price double")
    out = relations.aligned(df, "sheet bigint, note string, cost int, added string", {"Sheet No": "sheet", "price": "cost"})
    assert out.dtypes == [("sheet", "bigint"), ("note", "string"), ("cost", "int"), ("added", "string")]
    assert _rows(out) == collections.Counter([(7, "x", 1, None), (None, None, None, None), (None, "y", 2, None)])
    with pytest.raises(ValueError):
        relations.aligned(df, "note string", {"price": "NOTE"})
    hints = {"sheet": (["page", "sheet_no", "price"], "int"), "absent": (["nothing"], "string")}
    assert _rows(relations.hinted(df, hints).select("sheet", "absent", "price")) == collections.Counter([(7, None, 1.5), (None, None, None), (2, None, 2.0)])
    assert relations.without_columns(df, ["NOTE", "gone"]).columns == ["Sheet No", "price"]


def test_counts_of_children_and_clean_groups(spark):
    parents = spark.createDataFrame([(1,), (2,), (2,), (None,)], "k int")
    rows = spark.createDataFrame([(1, "bad"), (1, "ok"), (2, "ok"), (None, "bad"), (None, None), (5, "ok")], "k int, v string")
    got = _rows(summaries.child_counts(parents, "k", {"rows": (rows, "k"), "none": (rows.limit(0), "k")}))
    assert got == collections.Counter([(1, 2, 0), (2, 1, 0), (None, 0, 0)])
    assert _rows(summaries.clean_counts(rows, ["k"], "v", ["bad", "ok"], ["bad"])) == collections.Counter([(1, 1, 1, False), (2, 0, 1, True), (None, 1, 0, False), (5, 0, 1, True)])
    assert summaries.clean_counts(rows.limit(0), ["k"], "v", ["bad"], ["bad"]).count() == 0


def test_parts_within_their_page(spark):
    kind = "page int, nodes array<struct<id:string>>, parts array<struct<name:string,parent:string>>"
    pages = [(1, [("a",), ("b",), (None,)], [("p", "a"), ("q", "a"), ("r", None), ("s", "z")]), (2, [("a",)], None), (1, [("a",)], [("t", "a")]), (3, None, [("u", "a")]), (None, [("a",)], [("v", "a")])]
    got = relations.joined_within(spark.createDataFrame(pages, kind), "page", "nodes", "parts", "id", "parent").select("page", "node.id", "part.name")
    assert _rows(got) == collections.Counter([(1, "a", "p"), (1, "a", "q"), (1, "b", None), (1, None, None), (2, "a", None), (1, "a", "t"), (None, "a", "v")])


def test_canonical_json(spark):
    def plain(v):
        if hasattr(v, "asDict"):
            return {k: plain(x) for k, x in v.asDict().items()}
        if isinstance(v, dict):
            return {k: plain(x) for k, x in v.items()}
        return [plain(x) for x in v] if isinstance(v, list) else v

    kind = "row struct<z:string,a:array<struct<y:int,b:map<string,array<int>>>>,m:map<string,struct<d:int,c:string>>>"
    rows = [
        (("é\"\\", [(1, {"q": [3, 1], "p": None}), None, (None, {})], {"k2": (1, None), "k1": None}),),
        ((None, None, None),),
        (("", [], {}),),
        (None,),
    ]
    df = spark.createDataFrame(rows, kind)
    got = df.select("row", text.canonical_json(F.col("row"), df.schema["row"].dataType).alias("j"), text.json_checksum(F.col("row"), df.schema["row"].dataType).alias("s")).collect()
    want = [None if r.row is None else json.dumps(plain(r.row), sort_keys=True, separators=(",", ":"), ensure_ascii=False) for r in got]
    assert [r.j for r in got] == want and want[-1] is None
    assert [r.s for r in got] == [None if w is None else hashlib.sha256(w.encode()).hexdigest() for w in want]


def test_pixel_measures(spark):
    kind = "a_x0 double, a_y0 double, a_x1 double, a_y1 double, b_x0 double, b_y0 double, b_x1 double, b_y1 double"
    rows = [(0.0, 0.0, 4.0, 4.0, 2.0, 0.0, 4.9, 4.0), (1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0), (None, 0.0, 4.0, 4.0, 2.0, 0.0, 4.0, 4.0), (0.0, 0.0, 1.0, 1.0, 5.0, 5.0, 6.0, 6.0)]
    got = [r[0] for r in spark.createDataFrame(rows, kind).select(bx.pixel_iou(bx.box("a_"), bx.box("b_"))).collect()]
    assert got == [0.5, 0.0, None, 0.0]
    ends = "x double, y double, ax double, ay double, bx double, by double"
    points = [(0.0, 3.0, 0.0, 0.0, 10.0, 0.0), (5.0, 5.0, 2.0, 2.0, 2.0, 2.0), (1.0, 0.0, 0.0, 0.0, 1.0, 1.0), (None, 0.0, 0.0, 0.0, 1.0, 1.0)]
    got = [r[0] for r in spark.createDataFrame(points, ends).select(bx.pixel_segment_distance(*map(F.col, ("x", "y", "ax", "ay", "bx", "by")))).collect()]
    assert got[:3] == [3.0, pytest.approx(18**0.5), 1.0] and got[3] is None


def test_first_and_last_lines(spark, tmp_path):
    path = tmp_path / "lines.csv"
    path.write_text("".join(f"row {k}\n" for k in range(1, 1001)))
    got = sorted(map(tuple, files.ends(spark, str(path), 2).collect()), key=lambda r: r[1])
    assert got == [("head", 1, "row 1"), ("head", 2, "row 2"), ("tail", 999, "row 999"), ("tail", 1000, "row 1000")]
    path.write_text("a\nb\n")
    assert sorted(map(tuple, files.ends(spark, str(path), 5).collect())) == [("head", 1, "a"), ("head", 2, "b")]
    path.write_text("")
    assert files.ends(spark, str(path), 5).count() == 0


def test_numbers_and_values_from_neighbours(spark):
    r = random.Random(5)
    rows = [(g, k, r.choice([None, None, 1, 2, 5, 9, -3]), r.choice([None, None, "a", "b"])) for g in (1, 2, None) for k in range(40)] + [(3, 0, None, None), (4, 0, 7, "z")]
    df = spark.createDataFrame(rows, "g int, k int, n int, t string").repartition(3)
    number, text = {}, {}
    for g in (1, 2, None, 3, 4):
        own, most = [x for x in rows if x[0] == g], None
        for at, (_, k, n, t) in enumerate(own):
            number[g, k] = n if n is not None else None if most is None else most + 1
            most = number[g, k] if most is None or (number[g, k] is not None and number[g, k] > most) else most
            before = next((x[3] for x in reversed(own[:at]) if x[3]), None)
            after = next((x[3] for x in own[at + 1 :] if x[3]), None)
            text[g, k] = t or (before if before == after else None)
    assert {(x.g, x.k): x.number for x in series.numbered_on(df, ["g"], ["k"], "n", "number").collect()} == number
    assert {(x.g, x.k): x.t for x in series.agreed_fill(df, ["g"], ["k"], ["t"]).collect()} == text
    assert series.numbered_on(df.limit(0), ["g"], ["k"], "n", "number").count() == series.agreed_fill(df.limit(0), ["g"], ["k"], ["t"]).count() == 0
