"""Prefix tries, document fingerprints and centroid clusters against brute force, with the small tables that break things."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lattica.llm import centroid_clustering, document_fingerprints, prefix_trie

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TURNS = "conv_id long, turn long, role string, text string, depth int, up string, digest string, place long"
NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def _trie(rows, heads=6, every=100):
    """Nodes as a Counter of NODE tuples, by plain dictionaries."""
    convs = collections.defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            key = hashlib.md5(f"{len((role or '').encode())}:{role or ''}{text or ''}".encode()).digest()
            convs[c].append((turn is not None, turn or 0, key, role or "", text or ""))
    own = {c: [x[3:] for x in sorted(t)] for c, t in convs.items()}
    paths = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % heads
        base = int(c - np.fmod(c, every))
        paths[c] = tuple(own.get(base, [])[:h] + own[c][h:])
    member = collections.defaultdict(list)
    for c, p in paths.items():
        for d in range(len(p) + 1):
            member[p[:d]].append(c)
    kids = collections.Counter(p[:-1] for p in member if p)
    leaves, saved = collections.Counter(), collections.Counter()
    for p in sorted(member, key=len, reverse=True):
        leaves[p] = leaves[p] or 1
        saved[p] += (len(member[p]) - 1) * (len(p[-1][1]) if p else 0)
        if p:
            leaves[p[:-1]] += leaves[p]
            saved[p[:-1]] += saved[p]
    ends = lambda p: ",".join(map(str, sorted(c for c in member[p] if paths[c] == p)))
    return collections.Counter((min(m), len(p), min(member[p[:-1]]) if p else None, len(m), kids[p], leaves[p], saved[p], hashlib.sha256(ends(p).encode()).hexdigest()) for p, m in member.items())


def _conversations():
    r = random.Random(7)
    rows = []
    for c in range(0, 330):
        if c == 200:  # an absent base
            continue
        first = r.choice(["hello", "hello", "hello", None, "", "é𝄞"])
        second = r.choice(["again", "again", "b", f"own {c}"])
        turns = [first, second, *(r.choice(["x", "y", "", None]) for _ in range(r.randint(0, 5)))]
        rows += [(c, None if k == 0 and c % 7 == 0 else k, r.choice(["user", None]) if k % 5 == 4 else ["user", "assistant"][k % 2], t) for k, t in enumerate(turns)]
    rows += [(c, k, "user", f"same {k}") for c in range(1000, 1060) for k in range(9)]  # copies
    rows += [(5000, k, "user", f"long {k}") for k in range(700)]  # one long conversation, and one that leaves it late
    rows += [(5017, k, "user", f"long {k}" if k < 650 else "other") for k in range(700)]
    rows += [(-3, 0, "user", "negative"), (-3, 1, "user", "more"), (7001, 0, "user", "turnless"), (9001, 3, "a", "tie"), (9001, 3, "a", "tie"), (9001, 3, "b", "tie"), (None, 0, "user", "x"), rows[3], rows[3], rows[9]]
    return [(*x, 1, "u", "d", 2) for x in rows]


@pytest.mark.parametrize("most", [None, 60])
def test_trie_of_prefixes(spark, most):
    rows = _conversations()
    got = prefix_trie.prefix_trie(spark.createDataFrame(rows, TURNS).repartition(3), most=most, lot=100)
    assert got.columns == NODE
    assert collections.Counter(map(tuple, got.collect())) == _trie(rows)


def test_long_chain_in_rounds(spark):
    """Turns are dealt anew until two conversations part, and a chain of copies is summed by pieces."""
    rows = [(c, k, "user", f"t{k}") for c in (800, 801, 802) for k in range(60)] + [(c, k, "user", f"t{k}" if k < 4 else f"z{c}") for c in (810, 820) for k in range(30)]
    got = prefix_trie.prefix_trie(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), most=10, lot=10)
    assert collections.Counter(map(tuple, got.collect())) == _trie(rows)


def test_trie_of_nothing(spark):
    empty = spark.createDataFrame([], TURNS)
    assert prefix_trie.prefix_trie(empty).count() == 0
    # a conversation whose head is taken from one that is not there, and that has no more
    turnless = next(c for c in range(101, 200) if zlib.crc32(str(c).encode()) % 6 > 0)
    got = prefix_trie.prefix_trie(spark.createDataFrame([(turnless, 0, "user", "x")], "conv_id long, turn long, role string, text string")).collect()
    assert [tuple(r) for r in got] == [(turnless, 0, None, 1, 0, 1, 0, hashlib.sha256(str(turnless).encode()).hexdigest())]


def _fingerprint(text, width=5):
    words = [w.encode() for w in WORD.findall(text)]
    runs = [words[k : k + width] for k in range(max(1, len(words) - width + 1))] if words else []
    votes = np.zeros(64, np.int64)
    for run in runs:
        h = 42
        for w in run:
            h = xxhash.xxh64_intdigest(w, h)
        votes += np.array([1 if h >> k & 1 else -1 for k in range(64)])
    return sum(1 << k for k in range(64) if votes[k] > 0)


def _documents():
    r = random.Random(5)
    words = [f"w{k}" for k in range(400)]
    long = r.choices(words, k=900)
    texts = [None, "", " \n\t", "one", "a b c", "é𝄞 ü x", "x " * 50, " ".join(long), "y" * 3000]
    for k in range(40):
        near = list(long)
        near[r.randrange(900)] = f"changed{k}"
        texts.append(" ".join(near))
    texts += [" ".join(r.choices(words, k=r.choice([3, 12, 90]))).replace("w7", "\x0bw7\r") for _ in range(40)]
    rows = [(None if k in (3, 30) else 2 * k, t, "en", "s", 1, 2, "h", 4) for k, t in enumerate(texts)]
    return [*rows, rows[7], rows[7], rows[0], rows[1], (14, "another text with that id", "en", "s", 1, 2, "h", 4), rows[3]]


DOCS = "doc_id long, text string, lang string, source string, n long, fp long, hash string, copies long"


def _with_edits(rows, radius=3):
    signed = lambda t: int(np.uint64(xxhash.xxh64_intdigest(t.encode(), 42)).astype(np.int64))
    docs = sorted(((d, t or "") for d, t, *_ in rows), key=lambda x: (x[0] is None, -(x[0] or 0), signed(x[1]), len(x[1])))
    prints = {t: _fingerprint(t) for t in {t for _, t in docs}}
    ids = collections.defaultdict(list)
    for d, t in docs:
        ids[prints[t]].append(d)
    near = lambda a, b: 1 - bin(a ^ b).count("1") / 64
    out = collections.Counter()
    for k, (d, t) in enumerate(docs):
        other = docs[(k + 1) % len(docs)][1]
        cut = len(t) // 3
        edited = t[: len(t) - cut] + other[:cut]
        fp, e = prints[t], _fingerprint(edited)
        known = [x for x in ids[fp] if x is not None]
        links = sum(0 < bin(fp ^ g).count("1") <= radius for g in ids)
        out[(d, len(t), hashlib.sha256(edited.encode()).hexdigest(), f"{fp:016x}", f"{e:016x}", near(fp, e), near(fp, prints[other]), min(known) if known else None, links)] += 1
    return out


def test_fingerprints_and_edits(spark):
    rows = _documents()
    got = document_fingerprints.with_edits(spark.createDataFrame(rows, DOCS).repartition(3)).collect()
    want = _with_edits(rows)
    assert collections.Counter(map(tuple, got)) == want
    assert sum(r.n_links > 0 for r in got) > 20  # the near copies


def test_fingerprints_of_few_documents(spark):
    assert document_fingerprints.with_edits(spark.createDataFrame([], DOCS)).count() == 0
    for rows in ([(4, "a b c d e f g", *[None] * 6)], [(None, None, *[None] * 6)] * 3):
        got = document_fingerprints.with_edits(spark.createDataFrame(rows, DOCS)).collect()
        assert collections.Counter(map(tuple, got)) == _with_edits(rows)


def test_fingerprint_of_a_text_in_pieces(spark, monkeypatch):
    r = random.Random(2)
    texts = [" ".join(r.choices([f"w{k}" for k in range(50)], k=n)) for n in (1, 4, 5, 67, 68, 69, 128, 1000)] + ["long words " * 90_000]
    monkeypatch.setattr(document_fingerprints, "PIECE", 64)
    docs = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    got = {r.k: r.fp & (1 << 64) - 1 for r in document_fingerprints.fingerprints(docs, F.col("text"), ["k"]).collect()}
    assert got == {k: _fingerprint(t) for k, t in enumerate(texts)}


@pytest.mark.parametrize("part", [8, 1024])
def test_search_finds_all_near_fingerprints(spark, part):
    r = random.Random(9)
    prints = {r.getrandbits(64) for _ in range(300)}
    for _ in range(12):  # clusters, some bits of which lie in one block
        centre = r.getrandbits(64)
        for _ in range(40):
            prints.add(centre ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 4))))
    prints |= {0, 7, (1 << 64) - 1}
    df = spark.createDataFrame([(int(np.uint64(p).astype(np.int64)),) for p in prints], "fp long")
    want = {(a, b) for a in prints for b in prints if a != b and bin(a ^ b).count("1") <= 3}
    got = document_fingerprints.near_pairs(df, part=part).collect()
    back = lambda x: x & (1 << 64) - 1
    assert len(got) == len(want) // 2 and {(back(x.u), back(x.v)) for x in got} | {(back(x.v), back(x.u)) for x in got} == want
    counts = {back(x.fp): x.n_links for x in document_fingerprints.link_counts(df, part=part).collect()}
    assert counts == dict(collections.Counter(a for a, _ in want))


def _clusters(x, start, rounds):
    c = [list(v) for v in start]
    assign = lambda: [min(range(len(c)), key=lambda j: (sum((a - b) ** 2 for a, b in zip(v, c[j], strict=True)), j)) for v in x]
    for _ in range(rounds):
        own = assign()
        for j in range(len(c)):
            mine = [v for v, k in zip(x, own, strict=True) if k == j]
            if mine:
                c[j] = [sum(col) // len(mine) for col in zip(*mine, strict=True)]
    return assign(), c


@pytest.mark.parametrize("spread", [0.02, 1.0, 3e5])
def test_clusters(spark, spread):
    r = np.random.default_rng(4)
    centres = r.normal(size=(9, 64)) * 0.5
    vectors = [(centres[k % 9] + r.normal(size=64) * spread * 0.3).astype(np.float32).tolist() for k in range(260)]
    rows = [(k, v, 0, "v") for k, v in enumerate(vectors)] + [(None, vectors[0], 0, "v"), (5, vectors[5], 0, "v"), (5, vectors[6], 0, "v")]
    odd = [(900, None, 0, "v"), (901, [], 0, "v"), (902, [0.5] * 63, 0, "v"), (903, [*[0.5] * 63, float("nan")], 0, "v"), (904, [*[0.5] * 63, float("inf")], 0, "v"), (905, [*[0.5] * 63, None], 0, "v")]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, cluster int, v string").repartition(3)
    kept = centroid_clustering.kept_vectors(df)
    start = centroid_clustering.first_centroids(kept)
    whole = [(i, [int(np.floor(256 * float(np.float32(a)))) for a in v]) for i, v, *_ in rows]
    key = lambda x: (x[0] is None, hashlib.sha256(f"2:{x[0]}".encode()).hexdigest(), x[1])
    assert start.tolist() == [v for _, v in sorted(whole, key=key)[:40]]
    state, c = centroid_clustering.clustered(kept, start)
    own, want = _clusters([v for _, v in whole], start.tolist(), 5)
    assert c.tolist() == want
    got = centroid_clustering.with_distances(state, c).collect()
    gap = lambda v, j: sum((a - b) ** 2 for a, b in zip(v, want[j], strict=True))
    assert collections.Counter((x.vec_id, x.cluster, x.distance) for x in got) == collections.Counter((i, j, gap(v, j)) for (i, v), j in zip(whole, own, strict=True))
    if spread < 0.1:  # where vectors cluster, bounds decide most assignments
        assert sum(x.n_scans for x in got) < 3 * len(got)


def test_clusters_of_little(spark, tmp_path):
    kind = "vec_id long, embedding array<float>"
    for name, rows in (("empty", []), ("one", [(3, [0.25] * 64)]), ("same", [(k, [0.25] * 64) for k in range(50)])):
        spark.createDataFrame(rows, kind).write.parquet(f"{tmp_path}/{name}/embeddings.parquet")
        got = centroid_clustering.op13_centroid_clustering(spark, f"{tmp_path}/{name}").collect()
        assert sorted((r.vec_id, r.cluster, r.distance, r.inertia) for r in got) == [(k, 0, 0, 0) for k, _ in rows]
    with pytest.raises(Exception, match="beyond"):
        centroid_clustering.first_centroids(centroid_clustering.kept_vectors(spark.createDataFrame([(1, [1e9] * 64)], kind)))
