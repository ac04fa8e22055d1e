"""The pattern graph of personal data against a plain loop, and texts of a megabyte."""

import collections
import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.llm import chat_format, document_fingerprints, mixing, pii, prefix_trie, quality_rules, sentencepiece_codec, simhash_dedup, substring_dedup


def _patterns(seen, rounds, min_support, confident):
    """(pattern, kind, trust) and (value, kind, score) over dictionaries."""
    base, may = collections.defaultdict(dict), {}
    for k, value, pattern, m in seen:
        own = base[value, pattern]
        own["base"] = own.get("base", 0) | (m if k >= 0 else 0)
        own["any"] = own.get("any", 0) | m
        own["is"] = own.get("is", False) or k >= 0
    may = {link: x["base"] if x["is"] else x["any"] for link, x in base.items()}
    of = collections.defaultdict(list)
    for value, pattern in may:
        of[pattern].append(value)
    of = {p: v for p, v in of.items() if len(v) >= min_support}
    seeds = {(value, k): 1.0 for k, value, _, _ in seen if k >= 0}
    score, trust = dict(seeds), {}
    for _ in range(rounds):
        trust = {}
        for p, values in of.items():
            for kind in range(len(pii.KINDS)):
                scores = [score[v, kind] for v in values if (v, kind) in score]
                able = sum(may[v, p] >> kind & 1 for v in values)
                if sum(s >= confident for s in scores) >= min_support:
                    t = sum(scores) / (len(scores) + len(values) - able + 1)
                    if t >= confident:
                        trust[p, kind] = t
        score = dict(seeds)
        for v in {v for v, _ in may}:
            for kind in range(len(pii.KINDS)):
                ts = [t for (p, k), t in trust.items() if k == kind and (v, p) in may and may[v, p] >> kind & 1]
                if ts:
                    score[v, kind] = max(score.get((v, kind), 0), 1 - math.exp(sum(math.log(1 - t) for t in ts)))
    return trust, score


def test_pattern_graph_against_a_loop(spark):
    r = random.Random(4)
    seen = []
    for p in range(14):
        kind = p % len(pii.KINDS)
        for _ in range(r.randint(2, 16)):
            v = r.randrange(40)
            known = v % 3 == 0 and r.random() < 0.9
            seen.append((kind if known else -1, f"v{kind}-{v}", f"p{p}", 1 << kind if known else r.choice([1 << kind, 3 << kind & 15, 15])))
    trust, score = _patterns(seen, 3, 2, 0.5)
    got = pii.confident_patterns(spark.createDataFrame(seen, "k int, value string, pattern string, may int"), 3, 2, 0.5)
    one, two = {(x.pattern, x.kind): x.trust for x in got[0].collect()}, {(x.value, x.kind): x.score for x in got[1].collect()}
    assert one.keys() == trust.keys() and two.keys() == score.keys() and len(trust) > 3 and len(score) > len({(v, k) for k, v, _, _ in seen if k >= 0})
    assert all(abs(one[k] - trust[k]) < 1e-9 for k in one) and all(abs(two[k] - score[k]) < 1e-9 for k in two)


@pytest.fixture(scope="module")
def long_docs(spark):
    r = random.Random(1)
    words = ["".join(r.choices("etaoinsh", k=r.randint(2, 9))) for _ in range(5000)]
    text = " ".join(r.choices(words, k=170_000)) + " mail a.b@c.example now"
    assert len(text) > 1_000_000
    rows = [(k, " ".join(r.choices(words, k=60)), "en", "s", 1) for k in range(30)] + [(100, text, "en", "s", 1), (101, text, "en", "s", 1), (102, "é" * 1_100_000, "en", "s", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)


def test_texts_of_a_megabyte(spark, long_docs):
    text = {x.doc_id: x.text for x in long_docs.collect()}
    words = {k: re.findall(r"[^\x20\x09-\x0D]+", t) for k, t in text.items()}
    rules = {x.doc_id: x.n_words for x in quality_rules.quality_rules(long_docs, min_rows=5).collect()}
    assert rules == {k: len(w) for k, w in words.items()}
    prints = {x.doc_id: (x.fingerprint, x.component_id) for x in simhash_dedup.near_duplicates(long_docs).collect()}
    assert all(p == f"{simhash_dedup.fingerprint(text[k].encode()):016x}" for k, (p, _) in prints.items()) and prints[101][1] == 100
    left = {x.doc_id: (x.n_words, x.n_removed) for x in substring_dedup.deduplicated(long_docs).collect()}
    assert left[100][1] == 0 and left[101] == (len(words[101]), len(words[101])) and left[102] == (1, 0)
    found = {x.doc_id: len(x.base) for x in pii.identifiers(long_docs).collect()}
    assert found[100] == found[101] == 1 and found[102] == 0
    codes = sentencepiece_codec.digest(sentencepiece_codec.encoded(long_docs.where("doc_id >= 100"), ["doc_id", "text"])).collect()
    assert len(codes) == 3 and all(x.round_trip for x in codes)
    assert mixing.mixed(long_docs, ["doc_id"]).count() == 33
    edits = {x.doc_id: x for x in document_fingerprints.with_edits(long_docs).collect()}
    t, n = text[102], len(text[102])
    assert edits[102].edited_sha256 == hashlib.sha256((t[: n - n // 3] + text[101][: n // 3]).encode()).hexdigest()
    assert edits[101].near_next == 1.0 and edits[100].class_id == edits[101].class_id == 100


def test_turns_of_a_megabyte(spark, long_docs):
    turns = long_docs.where("doc_id >= 100").select(F.col("doc_id").alias("conv_id"), F.lit(0).cast("long").alias("turn"), F.lit("user").alias("role"), "text")
    turns = turns.unionByName(turns.select("conv_id", (F.col("turn") + 1).alias("turn"), F.lit("assistant").alias("role"), F.lit("Fine.").alias("text")))
    assert chat_format.parsed(turns).count() == 6
    nodes = prefix_trie.prefix_trie(turns).collect()
    assert {x.n_convs for x in nodes if x.depth == 0} == {3} and sum(x.n_children == 0 for x in nodes) == next(x.n_leaves for x in nodes if x.depth == 0)
    assert np.isfinite([x.saved_tokens for x in nodes]).all()
