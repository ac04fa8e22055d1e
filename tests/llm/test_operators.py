"""Small tables with nulls, empty and long texts, ties, repeated rows, clashing columns; results against brute force."""

import collections
import decimal
import hashlib
import math
import random
import re
import struct
import warnings

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattica.llm import chat_format, html_extraction, mixing, pii, quality_classifier, quality_rules, sentencepiece_codec, simhash_dedup, statistics, substring_dedup, topk_search

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, score double, phrase string, fp long, topic string, id long, shard int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _texts():
    r = random.Random(3)
    words = [f"w{k}" for k in range(300)]
    passage = " ".join(r.choices(words, k=45))
    out = [None, "", " \n\t", "one", "a b c", "x " * 30, passage, passage, passage.replace(" ", "\n", 3), "word " * 3000]
    for k in range(50):
        t = r.choices(words, k=r.choice([5, 30, 120]))
        if k % 3 == 0:
            t[2:2] = passage.split()
        out.append(" ".join(t).replace("w7", "W7\n"))
    mail = "mail bob.x@site.example.org now 10.0.0.255 or 300.1.1.1 card 4111 1111 1111 1111 call +1 (555) 010-9999 é @ a@b"
    return [*out, mail, mail, "#$%& | < >\n#$%& | < >", "a" * 20000, "1" * 5000 + "." + "2" * 30]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(None if k == 3 else 100 - k, t, None if k % 9 == 0 else "en", None if k % 7 == 0 else "s", 1, True, 0.5, "p", 1, "t", 5, 6) for k, t in enumerate(_texts())]
    return spark.createDataFrame([*rows, rows[6], rows[0], rows[20]], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def rows(docs):
    return docs.select("doc_id", "text").collect()


def _as_set(df):
    return collections.Counter(map(tuple, df.collect()))


def test_base_counts(docs, rows):
    got = quality_rules.quality_rules(docs, min_rows=5).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept").collect()
    want = collections.Counter()
    for r in rows:
        t = r.text or ""
        w = WORD.findall(t)
        seen = collections.defaultdict(list)
        for k in range(len(w) - 7):
            seen[tuple(w[k : k + 8])].append(k)
        repeat = len({j for at in seen.values() if len(at) > 1 for k in at for j in range(k, k + 8)})
        lines = [x for x in t.split("\n") if WORD.search(x)]
        want[(r.doc_id, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), repeat, len(w) < 20 or 100 * repeat > 30 * len(w))] += 1
    assert collections.Counter(tuple(r)[:7] for r in got) == want
    assert not any(r.kept for r in got if r.base_failed)


def test_outliers_go_and_others_stay(spark):
    r = random.Random(1)
    text = lambda k: " ".join("".join(r.choices("etaoinshrdlu", k=r.randint(2, 8))) for _ in range(60)) + "."
    rows = [(k, text(k), "en", "s") for k in range(200)] + [(900 + k, " ".join(w + "***" for w in text(k).split()), "en", "s") for k in range(20)]
    got = {x.doc_id: x.kept for x in quality_rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert all(got[k] for k in range(200)) and not any(got[900 + k] for k in range(20))


def _mcd(x):
    """Squared distances by the same estimate, over rows instead of sums, all in one place."""
    p, floor, per_e = x.shape[1], np.array([f for _, f in quality_rules.DIMENSIONS]), quality_rules.BINS_PER_E
    rounded = np.array([[float(decimal.Decimal(repr(float(v))).quantize(decimal.Decimal("0.01"), decimal.ROUND_HALF_UP)) for v in row] for row in x])
    low, centre, high = np.percentile(rounded, [25, 50, 75], axis=0)
    scale = np.maximum((high - low) / 1.349, floor)
    u = (x - centre) / scale
    sign = (u[:, :, None] * u[:, None] / ((u * u).sum(1) + 1e-9)[:, None, None]).mean(0) * p
    chi = lambda share: quality_rules.chi_square(p, share)

    def bins(mean, cov):
        inverse = np.linalg.inv(cov + np.diag(floor**2))
        d2 = np.einsum("ni,ij,nj->n", x - mean, inverse, x - mean)
        return d2, np.floor(np.log(np.maximum(d2, 1e-6)) * per_e)

    def within(last, b):
        rows = x[b <= last]
        return rows.mean(0), np.cov(rows.T, bias=True)

    fits = []
    for mean, cov in ((centre, np.diag(scale**2)), (centre, sign * np.outer(scale, scale))):
        for _ in range(quality_rules.C_STEPS):
            _, b = bins(mean, cov)
            mean, cov = within(np.sort(b)[math.ceil(quality_rules.H_SHARE * len(b)) - 1], b)
        fits.append((np.linalg.slogdet(cov + np.diag(floor**2))[1], mean, cov))
    _, mean, cov = min(fits, key=lambda f: f[0])
    _, b = bins(mean, cov)
    most = np.log(chi(0.975) * np.exp((np.sort(b)[math.ceil(len(b) / 2) - 1] + 0.5) / per_e) / chi(0.5)) * per_e
    mean, cov = within(max(b[b <= most].max(initial=-np.inf), np.sort(b)[math.ceil(quality_rules.H_SHARE * len(b)) - 1]), b)
    d2, b = bins(mean, cov)
    return d2 * min(1.0, chi(0.5) / np.exp((np.sort(b)[math.ceil(len(b) / 2) - 1] + 0.5) / per_e))


def test_outliers_equal_an_estimate_over_rows(spark):
    r = random.Random(11)
    word = lambda: "".join(r.choices("etaoinshrdlu", k=r.randint(2, 9))).capitalize() if r.random() < 0.2 else "".join(r.choices("etaoinshrdlu", k=r.randint(2, 9)))
    rows = []
    for k in range(300):
        text = " ".join(word() + r.choice(["", "", "", "!", ",", "\n", "#"]) for _ in range(r.randint(25, 160)))
        rows.append((k, text if k % 12 else " ".join(w for x in text.split() for w in [x] * 3), ["en", "de"][k % 2], "s"))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {x.doc_id: (x.distance2, x.kept) for x in quality_rules.quality_rules(df).collect() if not x.base_failed}
    vectors = statistics.with_statistics(df, ["doc_id", "lang"]).where("doc_id in (%s)" % ", ".join(map(str, got))).select("doc_id", "lang", *quality_rules.vector()).toPandas()
    cut, kept = quality_rules.SLACK * quality_rules.chi_square(quality_rules.P, 1 - quality_rules.TAIL), []
    for _, part in vectors.groupby("lang"):
        for i, d2 in zip(part["doc_id"], _mcd(part[quality_rules.X].to_numpy()), strict=True):
            assert abs(got[i][0] - d2) <= 1e-6 * max(1, d2) and got[i][1] == (d2 <= cut)
            kept.append(got[i][1])
    assert 0 < sum(kept) < len(kept)


def test_outliers_by_salted_keys(spark, docs, monkeypatch):
    of = lambda: collections.Counter((r.doc_id, r.kept, None if r.distance2 is None else round(r.distance2, 6)) for r in quality_rules.quality_rules(docs, min_rows=5).collect())
    by_broadcast = of()
    monkeypatch.setattr(quality_rules, "fits", lambda small: False)
    assert of() == by_broadcast


def test_simhash_equals_brute_force(docs, rows):
    got = {(r.doc_id, r.fingerprint, r.component_id) for r in simhash_dedup.near_duplicates(docs).collect()}
    prints = [(r.doc_id, simhash_dedup.fingerprint((r.text or "").encode())) for r in rows]
    group = list(range(len(prints)))
    for _ in group:
        for a in range(len(prints)):
            for b in range(len(prints)):
                if bin(prints[a][1] ^ prints[b][1]).count("1") <= 4:
                    group[a] = group[b] = min(group[a], group[b])
    least = {g: min((i for (i, _), h in zip(prints, group, strict=True) if h == g and i is not None), default=None) for g in group}
    assert got == {(i, f"{f:016x}", least[g]) for (i, f), g in zip(prints, group, strict=True)}


def test_masks_cover_and_blocks_lose_nothing(spark):
    r = random.Random(5)
    tables = [m % (1 << 64) for m in simhash_dedup.masks()]
    for _ in range(2000):
        d = sum(1 << b for b in r.sample(range(64), r.randint(1, 4)))
        assert any(m & d == 0 for m in tables)
    centre = r.getrandbits(64)
    prints = {centre ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 3))) for _ in range(300)}
    df = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "fp long")
    for block in (16, 4096):
        root = {x.node: x.root for x in simhash_dedup.components(simhash_dedup.links(df, block=block)).collect()}
        assert len(set(root.values())) == 1 and len(root) == len(prints)


def _removed(rows):
    seen, out = {}, []
    for r in sorted(rows, key=lambda r: (r.doc_id is None, r.doc_id)):
        w = WORD.findall(r.text or "")
        gone = [False] * len(w)
        for k in range(len(w) - 19):
            if seen.setdefault(tuple(w[k : k + 20]), (r.doc_id, k)) != (r.doc_id, k):
                gone[k : k + 20] = [True] * 20
        out.append((r.doc_id, len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return collections.Counter(out)


@pytest.mark.parametrize("shard_bytes", [500, 4 << 20])
def test_substring_dedup_equals_brute_force(docs, rows, shard_bytes):
    assert _as_set(substring_dedup.deduplicated(docs, shard_bytes=shard_bytes)) == _removed(rows)


def test_substring_dedup_of_rows_that_share_an_id(spark):
    words = [f"v{k}" for k in range(30)]
    rows = [(1, " ".join(words)), (1, "\n".join(words)), (2, " x ".join(words)), (3, "\t".join(words)), (None, " ".join(words))]
    got = {(r.doc_id, r.n_removed, r.kept_text) for r in substring_dedup.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(1, 0, " ".join(words)), (2, 0, " x ".join(words)), (3, 30, ""), (None, 30, "")}


def test_located_windows_without_confirmed_phrases():
    texts = [[b"w%d" % (k % 7) for k in range(40)], [], [b"x"] * 3]
    assert [len(x) for x in substring_dedup.located_windows(texts, np.zeros(1, np.uint64), 20, 6)] == [0, 0, 0]
    runs = substring_dedup._Runs(texts, 20, 6)
    assert substring_dedup.located_windows(texts, np.unique(runs.p), 20, 6)[0].tolist() == list(range(21))


def test_pii_base_and_learnt(spark, docs, rows):
    got = pii.identifiers(docs).select("doc_id", pii.listed("base").alias("base")).collect()
    want = collections.Counter()
    for r in rows:
        t, out = r.text or "", []
        out += [f"email:{m.start()}:{m.end()}" for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
        out += [f"ip:{m.start()}:{m.end()}" for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
        for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
            d = re.sub("[^0-9]", "", m[0])
            if 16 <= len(d) <= 19 and pii.luhn(d):
                out.append(f"card:{m.start()}:{m.end()}")
        out += [f"phone:{m.start()}:{m.end()}" for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
        want[(r.doc_id, ",".join(out))] += 1
    assert collections.Counter(map(tuple, got)) == want
    calls = [(k, f"please call us at +1 555 010 {1000 + k} today") for k in range(40)] + [(90, "please call us at 555-010-7777 today")]
    found = {r.doc_id: r.spans for r in pii.identifiers(spark.createDataFrame(calls, "doc_id long, text string")).select("doc_id", pii.listed("spans").alias("spans")).collect()}
    assert found[90] == "phone:18:30"


def _found(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: r.spans for r in pii.identifiers(df).select("doc_id", pii.listed("spans").alias("spans")).collect()}


def test_pii_learns_from_what_it_learnt(spark):
    # ten calls with seeds; unseen values in the same context, half of which stand in another context without seeds; one more only there
    new = [f"555-010-{7000 + k}" for k in range(8)]
    texts = [f"please call us at +1 555 010 {1000 + k} today" for k in range(10)] + [f"please call us at {x} today" for x in new]
    texts += [f"desk line reads {x} always" for x in new] + ["desk line reads 555-010-9999 always"]
    found = _found(spark, texts)
    assert found[len(texts) - 1] == "phone:16:28" and all(found[k] for k in range(10, len(texts)))


def test_pii_takes_numbers_with_blanks_and_long_values(spark):
    texts = [f"please call us at +1 555 010 {1000 + k} today" for k in range(40)] + [f"write mail to a{k}@b.example.org please" for k in range(40)]
    texts += ["please call us at (555) 010 7777 today", "please call us at 020 7946 0958 today", "write mail to " + "é" * 120 + "@näher please"]
    found = _found(spark, texts)
    assert (found[80], found[81], found[82]) == ("phone:18:32", "phone:18:31", "email:14:140")


def test_pii_contexts_are_whole_and_linear(spark):
    # words that differ beyond their fortieth character are other contexts; what is short, or stands beside another occurrence, counts as well
    far = "x" * 60
    texts = [f"{far}a write to a{k}@b.example.org now" for k in range(20)] + [f"{far}a write to q@z now", f"see {far}b", "a"]
    assert _found(spark, texts)[20] == f"email:{len(far) + 11}:{len(far) + 14}"
    seen = pii.occurrences("from a@b.org,c@d.org to e@f", pii.base_spans("from a@b.org,c@d.org to e@f"))
    assert [(x[4], x[5]) for x in seen] == [(" from _", "from _ "), ("#  _", " _ to"), ("# to _", "to _ ")]
    long = "k@l.org;" * 20_000
    assert len(pii.occurrences(long, pii.base_spans(long))) == 20_000


def test_classifier_holds_out_and_orders(spark, docs):
    r = random.Random(2)
    good = lambda: " ".join(r.choices(["alpha", "beta", "gamma", "delta"], k=40)) + "."
    rows = [(k, good() if k % 2 else good().upper().replace(" ", "!! ")) for k in range(400)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(400)] + [(None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    got = quality_classifier.quality_scores(table, labels, features=64).collect()
    assert len(got) == 400 and all(r.predicted == r.doc_id % 2 for r in got if r.held_out)
    none = quality_classifier.quality_scores(docs, labels.limit(0))
    assert none.count() == docs.count() and none.where("score between 0 and 1").count() == docs.count()


def test_ridge_and_pooling_equal_arrays(spark, docs):
    r = np.random.default_rng(3)
    stats = quality_classifier.with_statistics(docs, ["doc_id"])
    labelled = stats.withColumn("quality", (F.pmod(F.xxhash64(*statistics.COUNTS), F.lit(2))).cast("double"))
    rows = labelled.toPandas()
    x = quality_classifier.inputs({c: rows[c].to_numpy() for c in statistics.COUNTS})
    mean, scale = quality_classifier._moments(labelled)
    assert np.allclose(mean, x.mean(0)) and np.allclose(scale, np.sqrt(np.maximum(x.var(0), 1e-4)))
    fourier = quality_classifier.Fourier(mean, scale, 32, 0.2, 7)
    z, y = fourier(x), rows["quality"].to_numpy()
    assert np.allclose(quality_classifier._solve(labelled, fourier, 1e-3), np.linalg.solve(z.T @ z / len(z) + 1e-3 * np.eye(33), z.T @ y / len(z)), atol=1e-8)
    # the kernel that the features stand for
    wide = quality_classifier.Fourier(mean, scale, 40_000, 0.2, 7)
    a, b = x[20:21], x[30:31]
    gap = np.clip((a - mean) / scale, -6, 6) - np.clip((b - mean) / scale, -6, 6)
    assert abs((wide(a)[:, :-1] @ wide(b)[:, :-1].T)[0, 0] - np.exp(-0.02 * (gap**2).sum())) < 0.03
    # pooling: the fit at i is the largest least mean of all runs that hold i
    for _ in range(30):
        w, v = r.integers(1, 9, 12).astype(float), r.random(12)
        of = lambda a, b: (w[a:b] * v[a:b]).sum() / w[a:b].sum()  # noqa: B023, E731
        want = [max(min(of(a, b) for b in range(i + 1, 13)) for a in range(i + 1)) for i in range(12)]
        assert np.allclose(quality_classifier.isotonic(w, v), want)


def test_html(spark):
    page = "<html><body><nav>menu</nav><div class=ad>buy</div><article><h1>Head &amp; more</h1><p>First <b>bold</b>   text, long enough to count as a paragraph.<p>Second&nbsp;one, also long enough to count here.<script>x='</p>'</script></p><div class='comments'>nice!</div></article><footer>foot</footer></body></html>"
    rows = [(1, "http://a.org/1", page), (2, "http://a.org/2", page), (3, None, None), (4, "x", ""), (5, "http://b.org", "<p>only text & <i>words</i> unclosed <a href='>'>link"), (1, "http://a.org/1", page)]
    got = html_extraction.main_text(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("path", F.lit("p")).withColumn("host", F.lit("h"))).collect()
    text = {r.page_id: r.text for r in got}
    assert len(got) == 6 and text[3] == text[4] == ""
    assert text[1] == text[2] == "Head & more First bold text, long enough to count as a paragraph. Second one, also long enough to count here."
    assert text[5] == "only text & words unclosed link"


@pytest.mark.parametrize("around", ['div style="overflow: hidden"', 'div aria-hidden="false"', 'div data-id="ad"', 'div class="col has-sidebar"', "div class=no-sidebar", "div class=comments-open", "div class='share-story'", 'div title="a > b ' + "x" * 5000 + '"'])
@pytest.mark.parametrize("inner", ["div", "article"])
def test_html_keeps_what_holds_the_main_text(around, inner):
    said = "This is running text, long enough to count as a paragraph."
    source = f"<body><div class='site-nav'>menu</div><{around}><{inner}><p>{said}</p><div class='comments'>nice!</div></{inner}></div><div aria-hidden=true>unseen</div><div hidden>no</div><div id=ad-1>buy</div></body>"
    page = html_extraction.Page(source)
    assert page.text(page.path_text(page.tags.index("body"))) == said


def test_html_takes_names_and_tags_exactly():
    said = "This is running text, long enough to count as a paragraph."
    text = lambda source: (lambda page: page.text(page.path_text(1)))(html_extraction.Page(source))
    assert text(f"<body class=article-page><header>Site</header><article><header>Head</header><p>{said}</p><div class='social-history'>kept</div></article></body>") == f"Head {said} kept"
    assert text(f"<body><article><p>{said}</p><div class='comments-list'>gone</div><div id=ad-1>gone</div><ul class='site-nav'><li>gone</ul></article></body>") == said


def test_html_leaves_out_comments_and_keeps_essays():
    said = "This is running text, long enough to count as a paragraph, and it goes on for a while. " * 4
    text = lambda inner: (lambda page: page.text(page.path_text(1)))(html_extraction.Page(f"<body>{inner}</body>"))
    body = f"<p>{said}</p>"
    assert text(f"<main><header><h1>Title</h1></header>{body}<div class='social'>{body}</div><div class='social'><a href=x>Share</a> this</div></main>") == f"Title {said}{said}".strip()
    assert text(f"<article>{body}<div class='share-this-now'>Send it on</div><div class='reader-opinions'>{body}</div><section class='related'><a href=x>{said}</a>{said}</section></article>") == said.strip()


def test_html_pages_that_are_deep(spark):
    """Memory follows the page's size, not its depth; closing tags of what isn't open cost nothing."""
    import time
    import tracemalloc

    n, said = 100_000, "Deep down is running text, long enough to count as a paragraph."
    deep = "<div>" * n + said + "</div>" * n
    mixed = "<ul><li>" * (n // 2) + said + "</table></ol>" * n
    for source in (deep, mixed):
        tracemalloc.start()
        began = time.time()
        page = html_extraction.Page(source)
        path, score = page.best()
        assert page.text(path) == said and score > 0
        assert tracemalloc.get_traced_memory()[1] < 200e6 and time.time() - began < 30
        tracemalloc.stop()
    got = html_extraction.main_text(spark.createDataFrame([(1, "http://d.org", deep), (2, "http://d.org", deep)], "page_id long, url string, html string")).collect()
    assert [r.text for r in got] == [said, said]


def test_html_votes_by_a_loop(spark):
    r = random.Random(4)
    said = lambda: " ".join(r.choices(["one", "two,", "three", "four"], k=r.randint(8, 40)))
    rows = [(k, f"http://{r.choice('abc')}.org/{k}", f"<body><div class=a{k}><p>{said()}</p></div><section id=x><p>{said()}</p></section><main><p>{said() if k % 3 else ''}</p></main></body>") for k in range(60)]
    votes = collections.defaultdict(lambda: [0, 0])
    for _, url, source in rows:
        path, score = html_extraction.Page(source).best()
        v = votes[url[7:12], path]
        v[0] += 1
        v[1] += int(decimal.Decimal(repr(score * 1000)).quantize(decimal.Decimal(1), decimal.ROUND_HALF_UP))
    want = {h: min((p for g, p in votes if g == h), key=lambda p, h=h: (-votes[h, p][0], -votes[h, p][1], p)) for h in {h for h, _ in votes}}
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    voted = html_extraction.votes(df.select(F.substring("url", 8, 5).alias("host"), "html"))
    assert {x.host: x.path for x in html_extraction.winning_paths(voted).collect()} == want
    got = {x.page_id: x.text for x in html_extraction.main_text(df).collect()}
    for k, url, source in rows:
        page = html_extraction.Page(source)
        assert got[k] == (page.text(want[url[7:12]]) or page.text(page.best()[0]) or "")


def test_html_votes_of_a_host_win(spark):
    # three pages of a host agree on where their text is; a fourth has a larger aside in another container
    said = "This is running text, long enough to count, and of two clauses."
    page = "<body><div class=story-12><p>{}</p></div><div class=other><p>{}</p></div></body>"
    rows = [(k, f"http://h.org/{k}", page.format(said * 3, "short note here, no more")) for k in range(3)] + [(3, "http://h.org/3", page.format(said, (said + " ") * 9)), (4, "http://g.org/3", page.format(said, (said + " ") * 9))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_extraction.main_text(df).collect()}
    assert all(got[k] == said * 3 for k in range(3)) and got[3] == said and got[4] == ((said + " ") * 9).strip()


def _brute_top(vectors, k):
    out = set()
    for q in {(i, tuple(v)) for i, v in vectors if i % 20 == 0}:
        scored = sorted(((-int(np.dot(q[1], v)), i) for i, v in vectors if i != q[0]))[:k]
        out |= {(q[0], n + 1, i, -s) for n, (s, i) in enumerate(scored)}
    return out


def test_top_k_equals_brute_force(spark):
    r = np.random.default_rng(4)
    raw = [(int(k), (r.normal(0, 1, 8) + 3 * (k % 5)).tolist()) for k in range(500)] + [(700, [0.5] * 8), (701, [0.5] * 8), (702, [0.5] * 8)]
    bad = [(None, [1.0] * 8), (801, None), (802, [None] + [1.0] * 7), (803, [float("nan")] + [1.0] * 7), (804, [float("inf")] + [1.0] * 7), (805, [])]
    table = spark.createDataFrame(raw + bad, "vec_id long, embedding array<double>").withColumn("score", F.lit(1))
    every = topk_search.vectors(table)
    got = {tuple(x) for x in topk_search.top_k(every.where("id % 20 = 0"), every, 20, shard=100, block=16).collect()}
    assert got == _brute_top([(i, np.floor(64 * np.array(v))) for i, v in raw], 20)
    # components whose products leave the whole doubles, other lengths, a repeated id
    more = [(900, [20000.25] * 8), (901, [1e200, -1e200] * 4), (902, [-3e300] * 8), (903, [1e307] * 8), (20, [0.25] * 8), (906, [1.0, 2.0]), (920, [3.0, -1.0])]
    table = spark.createDataFrame(raw[:120] + more, "vec_id long, embedding array<double>")
    every = topk_search.vectors(table)
    got = {tuple(x) for x in topk_search.top_k(every.where("id % 20 = 0"), every, 20, shard=30, block=3).collect()}
    whole = [(i, [int(np.floor(64 * x)) for x in v]) for i, v in raw[:120] + more if i != 903]
    want = set()
    for i, q in whole:
        if i % 20 == 0:
            scored = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in whole if j != i and len(v) == len(q))[:20]
            want |= {(i, n + 1, j, min(max(-s, -(1 << 63)), (1 << 63) - 1)) for n, (s, j) in enumerate(scored)}
    assert got == want


def test_top_k_prunes_what_lies_in_clusters(spark):
    r = np.random.default_rng(6)
    centres = r.normal(0, 1, (40, 16))
    raw = [(k, (centres[k % 40] * 20 + r.normal(0, 0.1, 16)).tolist()) for k in range(4000)]
    every = topk_search.vectors(spark.createDataFrame(raw, "vec_id long, embedding array<double>"))
    scored, pairs = topk_search.pairs_scored(every.where("id % 20 = 0"), every, shard=400).first()
    assert pairs == 200 * 4000 and scored < 0.25 * pairs
    got = {tuple(x) for x in topk_search.top_k(every.where("id % 20 = 0"), every, shard=400).collect()}
    assert got == _brute_top([(i, np.floor(64 * np.array(v))) for i, v in raw], 20)


def _unigram_model(scores):
    """The same pieces and scores as a unigram model that the library reads."""

    def number(n):
        out = b""
        while True:
            n, b = n >> 7, n & 127
            out += bytes([b | (128 if n else 0)])
            if not n:
                return out

    part = lambda f, d: number(f << 3 | 2) + number(len(d)) + d
    raw, out, k = open(sentencepiece_codec.MODEL, "rb").read(), b"", 0
    pieces = sentencepiece_codec.read_pieces(raw)
    for n, kind, v in sentencepiece_codec._fields(raw):
        if n == 1:
            out += part(1, part(1, pieces[k][0].encode()) + number(2 << 3 | 5) + struct.pack("<f", scores[k]) + number(3 << 3) + number(pieces[k][2]))
            k += 1
        elif n == 2:
            spec = b"".join(number(m << 3 | w) + (number(1 if m == 3 else x) if w == 0 else number(len(x)) + x if w == 2 else x) for m, w, x in sentencepiece_codec._fields(v))
            out += part(2, spec)
        else:
            out += part(n, v)
    return pieces, out


def test_codec_against_the_library_and_round_trip(docs, rows):
    spm = pytest.importorskip("sentencepiece")
    pieces = sentencepiece_codec.read_pieces(open(sentencepiece_codec.MODEL, "rb").read())
    scores = sentencepiece_codec.zipf_scores(pieces)
    pieces, model = _unigram_model(scores)
    library = spm.SentencePieceProcessor(model_proto=model)
    texts = [r.text for r in rows if r.text] + ["  two  spaces ", "日本語 😀 text", "\tx\n", "\u0000 ​"]
    codec = sentencepiece_codec.Codec(pieces)
    ids, at = codec.encode(texts)
    assert codec.decode(ids, at) == texts
    marked = ["▁", "a▁b ▁ c▁▁", "▁▁x", " ▁"]
    assert codec.decode(*codec.encode(marked)) == marked
    worth = lambda x: round(sum(round(scores[k] * 2**20) for k in x) / 2**20, 3)
    for text, a, b in zip(texts, at[:-1], at[1:], strict=True):
        want = library.encode(text)
        # equal, or as good: paths of equal score differ by the library's rounding
        assert ids[a:b].tolist() == want or worth(ids[a:b]) == worth(want)
    got = sentencepiece_codec.encoded(docs, ["doc_id", "text"])
    assert got.where("not (decoded <=> text)").count() == 0 and got.count() == len(rows)


def test_raking_meets_targets(spark, docs):
    cells = spark.createDataFrame([("a", "x", "t", 900), ("a", "y", "u", 50), ("b", "x", "u", 30), ("b", "y", "t", 20), (None, "y", "t", 5), ("c", "x", "t", 0)], "source string, lang string, topic string, n long")
    out = mixing.raked(cells, {"source": {"a": 0.5, "b": 0.4}, "lang": {"x": 0.6, "y": 0.4}}).toPandas()
    share = out["n"] * out["factor"] / out["n"].sum()
    assert abs(share[out["source"] == "a"].sum() - 0.5 / 0.9) < 1e-4 and abs(share[out["lang"] == "x"].sum() - 0.6) < 1e-4
    got = mixing.mixed(docs)
    assert got.count() == docs.count() and got.where("probability is null or probability > 1 or sampled is null").count() == 0


def test_raking_equals_arrays(spark, docs, rows):
    r = np.random.default_rng(8)
    n = r.integers(0, 900, (4, 3, 3)) * (r.random((4, 3, 3)) < 0.8)
    cells = spark.createDataFrame([(f"s{a}", None if b == 0 else f"l{b}", f"t{c}", int(n[a, b, c])) for a, b, c in np.ndindex(n.shape)], "source string, lang string, topic string, n long")
    w = n / n.sum()
    goals = [(n.sum(axis=tuple({0, 1, 2} - {k})) ** 0.7) for k in range(3)]
    goals = [g / g.sum() for g in goals]
    for rounds in (1, 8):
        w = n / n.sum()
        for k in [0, 1, 2] * rounds:
            now = w.sum(axis=tuple({0, 1, 2} - {k}))
            w = w * np.expand_dims(goals[k] / now, tuple({0, 1, 2} - {k}))
        with warnings.catch_warnings(record=True) as said:
            warnings.simplefilter("always")
            got = {(x.source, x.lang, x.topic): x.factor for x in mixing.raked(cells, rounds=rounds, tolerance=1e-12).collect()}
        assert any("away from its targets" in str(x.message) for x in said)
        for a, b, c in np.ndindex(n.shape):
            if n[a, b, c]:
                assert abs(got[f"s{a}", None if b == 0 else f"l{b}", f"t{c}"] - w[a, b, c] * n.sum() / n[a, b, c]) < 1e-9
    # arrays in one task and Spark jobs give the same plan
    for how in ({}, {"given": {"source": {"s0": 0.5, "s1": 0.3, "no": 0.2}, "lang": {None: 0.5, "l1": 0.5}}}, {"share": 0.9}, {"share": 1.0}):
        one, two = ({(x.source, x.lang, x.topic): x for x in mixing.planned(cells, rounds=12, tolerance=1e-9, small=small, **how).collect()} for small in (0, 1000))
        assert one.keys() == two.keys()
        for key, x in one.items():
            assert all(abs(x[c] - two[key][c]) < 1e-9 for c in ("factor", "probability", "source_target", "lang_target", "topic_target")), (how, key)
    assert mixing.planned(cells.withColumn("n", F.lit(0).cast("long"))).where("probability = 0.5 and factor = 1").count() == n.size
    counted = mixing.mixed(docs, topic_of=lambda t: F.when(t.isNull(), "none").otherwise("some")).select("doc_id", "topic", "tokens")
    assert _as_set(counted) == collections.Counter((x.doc_id, "none" if x.text is None else "some", len(WORD.findall(x.text or ""))) for x in rows)


def test_a_scarce_cell_does_not_set_the_size_of_the_sample(spark):
    rows = [(k, "word " * 100, "en", "big") for k in range(900)] + [(k, "wort " * 100, "de", "big") for k in range(900, 1500)] + [(1500, "mot mot", "fr", "small"), (1501, "", "fr", "big"), (1502, None, "none", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = mixing.mixed(df).toPandas().set_index("doc_id")
    assert abs((got["tokens"] * got["probability"]).sum() / got["tokens"].sum() - mixing.SHARE) < 1e-9
    assert got["probability"][1500] > 0.999 and got["probability"][1502] == mixing.SHARE and 650 < got["sampled"].sum() < 850
    assert mixing.mixed(df, share=1.0).where("sampled").count() >= 1500
    # bounded shares: b has half of what its target asks for and is taken whole, the other sources share the rest evenly
    cells = spark.createDataFrame([("a", "x", "t", 600), ("a", "y", "t", 400), ("b", "x", "t", 60), ("b", "y", "t", 40), ("c", "x", "t", 400), ("c", "y", "t", 600)], "source string, lang string, topic string, n long")
    plan = mixing.calibrated(mixing.raked(cells, {"source": {"a": 0.4, "b": 0.2, "c": 0.4}, "lang": {"x": 0.5, "y": 0.5}}), share=1000 / 2100)
    share = {(r.marginal, r.value): r.share for r in mixing.reached(plan).collect()}
    assert all(abs(share[k] - v) < 1e-4 for k, v in {("source", "a"): 0.45, ("source", "b"): 0.1, ("source", "c"): 0.45, ("lang", "x"): 0.5}.items())


def test_chat(spark):
    rows = [(1, 0, "user", "hi\nthere?"), (1, 1, None, "Assistant: well\nHuman: and?"), (None, None, "bad", None), (2, 0, None, ""), (1, 0, "user", "hi\nthere?")]
    rows += [(7, k, ["user", "assistant"][k % 2], f"line {k}") for k in range(300)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("part", F.lit(1)).withColumn("piece", F.lit(1))
    whole, cut = chat_format.parsed(df), chat_format.parsed(df, part_rows=20)
    assert _as_set(whole) == _as_set(cut)
    assert [(r.role, r.text) for r in whole.where("conv_id = 1 and turn = 1").orderBy("piece").collect()] == [("assistant", "well"), ("user", "and?")]
    assert whole.where("conv_id = 7").count() == 300 and whole.where("conv_id is null").count() == 1
    # Viterbi against all paths
    scores, first, _, _ = chat_format._lines(["user", None, "assistant", None], ["a", "b?", "Q: c", "d"])
    paths = {}
    for p in np.ndindex(3, 3, 3, 3):
        paths[p] = chat_format.START[p[0]] + sum(scores[k, p[k]] for k in range(4)) + sum((chat_format.BETWEEN if first[k] else chat_format.WITHIN)[p[k - 1], p[k]] for k in range(1, 4))
    decoded = chat_format.decoded(scores, first, np.array([0, 4]), np.array([-1]), np.array([-1]))
    assert tuple(decoded) == max(paths, key=paths.get)
    # several at once, of different lengths and with given ends, against one by one; matrices against the best path's score
    r = np.random.default_rng(1)
    begins = np.array([0, 3, 4, 11, 12])
    scores, first, before, last = np.round(r.normal(0, 1e6, (12, 3))), r.random(12) < 0.5, np.array([-1, 2, 0, -1]), np.array([1, -1, 2, 0])
    every = chat_format.decoded(scores, first, begins, before, last)
    for k, (a, b) in enumerate(zip(begins[:-1], begins[1:])):
        best = {}
        for p in np.ndindex(*[3] * (b - a)):
            if last[k] in (-1, p[-1]):
                step = lambda n, x: chat_format.STEP[int(first[a + n])][x, p[n]]  # noqa: B023, E731
                best[p] = (chat_format.START[p[0]] if before[k] < 0 else step(0, before[k])) + sum(scores[a + n, p[n]] for n in range(b - a)) + sum(step(n, p[n - 1]) for n in range(1, b - a))
        assert tuple(every[a:b]) == max(best, key=best.get)
    whole = chat_format.matrix(scores[:7], first[:7])
    for x, y in np.ndindex(3, 3):
        score = lambda p: sum(scores[n, p[n]] + chat_format.STEP[int(first[n])][([x, *p])[n], p[n]] for n in range(7))  # noqa: B023, E731
        assert whole[x, y] == max(score((*p, y)) for p in np.ndindex(*[3] * 6))


def test_chat_recovers_hidden_roles(spark):
    """Roles of three rows in ten are hidden from the parser and come back; what it counts is what a loop counts."""
    rows = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    good, n = chat_format.recovered(rows)
    by_hand, _ = chat_format.recovered(rows, learn=False)
    assert n > 100 and good / n > 0.95 and good >= by_hand
    pdf = rows.limit(200).toPandas().sort_values(["conv_id", "turn"])
    counts = np.array(chat_format._counted(pdf.assign(no_conv=False, no_turn=False))["counts"][0])
    first = collections.Counter(g.role.iloc[0] for _, g in pdf.groupby("conv_id"))
    steps = collections.Counter(x for _, g in pdf.groupby("conv_id") for x in zip(g.role, g.role[1:]))
    assert counts[:3].tolist() == [first[r] for r in chat_format.ROLES] and counts[3:12].tolist() == [steps[a, b] for a in chat_format.ROLES for b in chat_format.ROLES]
    assert counts[12:15].sum() == len(pdf)


def test_chat_keeps_what_is_no_marker_and_parts_equal_rows(spark):
    rows = [(1, 0, "user", "My robots are\nModel: T-800\nand more, which I describe at some length here?"), (1, 1, "assistant", "Fine.")]
    rows += [(2, 0, "user", "same words")] * 100 + [(2, None, None, "Summarize this text"), (3, 0, "user", "line\n" * 3000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = chat_format.parsed(df, part_rows=10).collect()
    assert [(r.role, r.text.split("\n")[1:2]) for r in got if r.conv_id == 1] == [("user", ["Model: T-800"]), ("assistant", [])]
    assert sum(r.conv_id == 2 for r in got) == 101


def test_kept_columns_that_clash(spark, docs):
    extra = docs.withColumns({c: F.lit(7) for c in ("tokens", "spans", "base", "n_words", "x0", "key", "ids", "decoded", "probability", "seen")})
    for got, names in (
        (mixing.mixed(extra, ["doc_id", "topic", "tokens", "probability"]), ["topic_input", "tokens_input", "probability_input"]),
        (pii.identifiers(extra, ["doc_id", "spans", "base", "seen"]), ["spans_input", "base_input", "seen_input"]),
        (pii.redacted(extra, ["doc_id", "text", "tokens"]), ["tokens"]),
        (quality_rules.quality_rules(extra, ["doc_id", "kept", "n_words", "x0", "key"]), ["kept_input", "n_words_input", "x0_input", "key_input"]),
        (sentencepiece_codec.encoded(extra, ["doc_id", "ids", "decoded"]), ["ids_input", "decoded_input"]),
    ):
        assert set(names) <= set(got.columns) and len(set(got.columns)) == len(got.columns) and got.count() == docs.count(), names


def test_empty_tables(spark, docs):
    none = docs.limit(0)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    vectors = topk_search.vectors(spark.createDataFrame([], "vec_id long, embedding array<double>"))
    for df in (quality_rules.quality_rules(none), simhash_dedup.near_duplicates(none), substring_dedup.deduplicated(none), pii.identifiers(none), pii.redacted(none, ["doc_id", "text"]), mixing.mixed(none), quality_classifier.quality_scores(none, labels), sentencepiece_codec.encoded(none, ["doc_id"]), topk_search.top_k(vectors, vectors), html_extraction.main_text(spark.createDataFrame([], "page_id long, url string, html string")), chat_format.parsed(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))):
        assert df.count() == 0


def test_pipeline(spark, docs):
    import corpus_pipeline

    step, sizes = docs.select(*corpus_pipeline.DOCUMENTS), []
    for _, stage in corpus_pipeline.STAGES:
        step = corpus_pipeline.save(stage(spark, step, ""), "test")
        sizes.append(step.count())
    assert sizes == sorted(sizes, reverse=True) and step.where("not round_trip").count() == 0
    none = docs.limit(0).select(*corpus_pipeline.DOCUMENTS)
    for _, stage in corpus_pipeline.STAGES:
        none = corpus_pipeline.save(stage(spark, none, ""), "test")
    assert none.count() == 0


def test_pipeline_keeps_one_row_of_each_group(spark, docs):
    """By brute force over rows: every component of fingerprints keeps one row, the one of the smallest id; ids that rows share, or that are null, decide nothing."""
    import corpus_pipeline

    r = random.Random(11)
    other = [" ".join(r.choices([f"v{k}" for k in range(200)], k=40)) for _ in range(11)]
    more = [(None, t, "en", "s", 1) for t in other[:5]] + [(7, t, None, None, None) for t in other[5:8]] + [(7, other[8], "en", "s", 1)] * 3 + [(3, other[0] + " ", "en", "s", 1), (None, other[9], "de", "s", 1), (None, other[9], "en", "s", 1)]
    rows = [tuple(x) for x in docs.select(*corpus_pipeline.DOCUMENTS).collect()] + more
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    prints = [simhash_dedup.fingerprint((x[1] or "").encode()) for x in rows]
    parent = list(range(len(rows)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= simhash_dedup.RADIUS:
                parent[root(i)] = root(j)
    groups = collections.defaultdict(list)
    for k, x in enumerate(rows):
        groups[root(k)].append(x)
    kept = [tuple(x) for x in corpus_pipeline.near_dedup(spark, df, "").collect()]
    of = {}
    for g, members in groups.items():
        of.update(dict.fromkeys(members, g))
    assert sorted(of[x] for x in kept) == sorted(groups)
    order = lambda x: (x[0] is None, x[0] or 0)
    assert all(order(x) == min(map(order, groups[of[x]])) for x in kept)

