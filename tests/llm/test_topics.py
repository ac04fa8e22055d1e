"""Topics learnt from words, against plain loops; phrases that very many shards hold."""

import collections
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lattica.llm import mixing, substring_dedup, topics

SCHEMA = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="module")
def four(spark):
    """Four vocabularies and words that all share, a third of the rows one text, and texts without words."""
    r = random.Random(1)
    own = [[f"w{a}_{k}" for k in range(300)] for a in range(4)]
    shared = [f"c{k}" for k in range(50)]
    rows = [(k, " ".join(r.choices(own[k % 4], k=40) + r.choices(shared, k=60)), "en", f"s{k % 3}") for k in range(400)]
    rows += [(400 + k, rows[0][1].upper(), "en", "s0") for k in range(200)]
    rows += [(600, None, None, None), (601, "", "en", "s1"), (602, " \t\n", "de", None)]
    return rows, spark.createDataFrame(rows, SCHEMA).repartition(5)


def _loop(texts, k, rounds, starts):
    """The same by loops over distinct texts; `starts`: the centroids to begin with."""
    x = []
    for t in texts:
        counts = np.zeros(topics.DIMENSIONS)
        for word, n in collections.Counter(t.lower().encode().split()).items():
            counts[xxhash.xxh3_64_intdigest(word) % topics.DIMENSIONS] += n
        x.append(np.rint(255 * np.sqrt(counts / counts.sum())))
    x = np.array(x)
    z = (x - x.mean(0)) / np.where(x.std(0) > 0, x.std(0), 1)
    z = np.array([np.rint(4096 * v / np.sqrt((v * v).sum())) for v in z])
    c = starts.copy()
    for _ in range(rounds):
        which = [max(range(k), key=lambda j, v=v: (round(float(v @ c[j])), -j)) for v in z]
        for j in range(k):
            total = sum((v for v, w in zip(z, which, strict=True) if w == j), np.zeros(topics.DIMENSIONS))
            if (total != 0).any():
                c[j] = total / np.sqrt((total * total).sum())
    return [max(range(k), key=lambda j, v=v: (round(float(v @ c[j])), -j)) for v in z]


def test_topics_equal_a_loop_and_find_vocabularies(spark, four):
    rows, df = four
    sketches = df.select("doc_id", topics.sketch(F.col("text")).alias("sketch")).cache()
    model = topics.fitted(sketches, k=4)
    got = {x.doc_id: x.topic for x in sketches.select("doc_id", model.of(F.col("sketch")).alias("topic")).collect()}
    assert {got[k] for k in (600, 601, 602)} == {"none"}
    # each vocabulary is one topic, copies in another case included
    assert len({(k % 4, got[k]) for k in range(400)}) == 4 and {got[k] for k in range(400, 600)} == {got[0]}
    starts = topics.fitted(sketches, k=4, rounds=0).centroids
    want = _loop([x[1] for x in rows[:400]], 4, topics.ROUNDS, starts)
    assert [f"topic-{w}" for w in want] == [got[k] for k in range(400)]
    # no order of rows or tasks changes a bit of it
    again = topics.fitted(sketches.repartition(1), k=4)
    assert (again.centroids == model.centroids).all() and (again.mean == model.mean).all()


def test_topics_of_few_and_equal_texts(spark):
    same = spark.createDataFrame([(k, "one text", "en", "s") for k in range(50)], SCHEMA)
    assert {(x.topic, x.sampled is None) for x in mixing.mixed(same).collect()} == {("topic-0", False)}
    none = spark.createDataFrame([(1, None, None, None), (2, "", None, None)], SCHEMA)
    assert [(x.topic, x.probability) for x in mixing.mixed(none).collect()] == [("none", mixing.SHARE)] * 2
    assert mixing.mixed(same.limit(0)).count() == 0
    two = spark.createDataFrame([(1, "a b c", "en", "s"), (2, "d e f", "en", "s")], SCHEMA)
    assert len({x.topic for x in mixing.mixed(two).collect()}) == 2


def test_mixing_tempers_learnt_topics(spark, four):
    rows, df = four
    got = mixing.mixed(df.withColumn("topic", F.lit("own")).withColumn("sketch", F.lit(1)), ["doc_id", "topic"])
    assert set(got.columns) == {"doc_id", "topic_input", "topic", "tokens", "weight", "probability", "sampled"} and got.count() == len(rows)
    x = got.where("tokens > 0").toPandas()
    assert abs((x["tokens"] * x["probability"]).sum() / x["tokens"].sum() - mixing.SHARE) < 1e-9
    # the topic that holds the copies is the largest and is thinned the most
    large = x["topic"].value_counts().idxmax()
    assert x.loc[x["topic"] == large, "probability"].max() < x.loc[x["topic"] != large, "probability"].max()


def test_words_of_long_texts_are_counted_by_pieces(monkeypatch):
    r = random.Random(3)
    text = b" ".join(b"x%d" % r.randrange(500) for _ in range(5000)) + b"\n\t end"
    whole = topics.sketch_of(text, topics._Places())
    monkeypatch.setattr(topics, "_PIECE", 7)
    assert topics.sketch_of(text, topics._Places()) == whole and b" ".join(w for p in topics._pieces(text) for w in p).split() == text.split()


def test_a_phrase_of_all_shards(spark):
    """One passage in every document, each in a shard of its own, against a plain loop."""
    r = random.Random(4)
    passage = [f"p{k}" for k in range(30)]
    rows = []
    for k in range(120):
        own = [f"u{k}_{j}" for j in range(40)]
        at = r.randrange(40)
        rows.append((k, " ".join(own[:at] + passage + own[at:])))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    seen, want = set(), {}
    for k, text in rows:
        w = text.split()
        gone = [False] * len(w)
        for i in range(len(w) - 19):
            if tuple(w[i : i + 20]) in seen:
                gone[i : i + 20] = [True] * 20
            seen.add(tuple(w[i : i + 20]))
        want[k] = (sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g))
    got = {x.doc_id: (x.n_removed, x.kept_text) for x in substring_dedup.deduplicated(df, shard_bytes=100).collect()}
    assert got == want and sum(n for n, _ in want.values()) == 119 * 30
