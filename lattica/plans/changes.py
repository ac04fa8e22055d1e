"""Queries over two versions of a table: set operations, changes by key, flags, matching of rows, nested values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.functions import text
from lattica.operators import joins, relations, summaries

from .registry import query, table

_SETS = {"union": "UNION", "intersect": "INTERSECT", "except": "EXCEPT"}


def _set(kind: str, every: bool) -> None:
    word = _SETS[kind] + (" ALL" if every else "")

    @query(f"set_{kind}{'_all' if every else ''}", f"SELECT o_custkey AS k FROM orders WHERE o_totalprice > 200000 {word} SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'")
    def run(spark: SparkSession, d: str) -> DataFrame:
        orders = table(spark, d, "orders")
        of = lambda which: orders.where(which).select(F.col("o_custkey").alias("k"))
        return relations.combined(of("o_totalprice > 200000"), of("o_orderstatus = 'F'"), kind, every)


for _kind in _SETS:
    for _every in (False, True):
        _set(_kind, _every)


@query("exists_flag", "SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P') AS pending FROM customer")
def exists_flag(spark: SparkSession, d: str) -> DataFrame:
    pending = table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return joins.with_flag(table(spark, d, "customer").select("c_custkey"), pending, ["c_custkey"], "pending")


@query("insert_if_absent", "SELECT s_suppkey AS k, s_name AS name FROM supplier UNION ALL SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier)")
def insert_if_absent(spark: SparkSession, d: str) -> DataFrame:
    old, new = table(spark, d, "supplier").selectExpr("s_suppkey as k", "s_name as name"), table(spark, d, "customer").selectExpr("c_custkey as k", "c_name as name")
    return relations.inserted(old, new, ["k"])


@query("upsert", "SELECT c_custkey AS k, c_name AS name FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier) UNION ALL SELECT s_suppkey, s_name FROM supplier")
def upsert(spark: SparkSession, d: str) -> DataFrame:
    old, new = table(spark, d, "customer").selectExpr("c_custkey as k", "c_name as name"), table(spark, d, "supplier").selectExpr("s_suppkey as k", "s_name as name")
    return relations.upserted(old, new, ["k"])


@query("replace_rows", "SELECT c_custkey, c_nationkey FROM customer WHERE NOT (c_nationkey = 3) UNION ALL SELECT s_suppkey, s_nationkey FROM supplier WHERE s_nationkey = 3")
def replace_rows(spark: SparkSession, d: str) -> DataFrame:
    new = table(spark, d, "supplier").where("s_nationkey = 3").selectExpr("s_suppkey as c_custkey", "s_nationkey as c_nationkey")
    return relations.replaced(table(spark, d, "customer").select("c_custkey", "c_nationkey"), new, F.col("c_nationkey") == 3)


@query("next_version", "SELECT o_custkey, (coalesce(max(o_orderkey), 0) + 1)::BIGINT AS o_orderkey FROM orders GROUP BY o_custkey")
def next_version(spark: SparkSession, d: str) -> DataFrame:
    return relations.next_version(table(spark, d, "orders"), ["o_custkey"], "o_orderkey")


@query("row_match", "SELECT o_orderkey, l AS line FROM (SELECT o_orderkey, o_custkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders) LEFT JOIN (SELECT l_orderkey * 10 + l_linenumber AS l, l_partkey AS k, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey * 10 + l_linenumber) AS n FROM lineitem) USING (k, n)")
def row_match(spark: SparkSession, d: str) -> DataFrame:
    """Orders and lines with the same number in their customer's and part's place, each used once."""
    orders = table(spark, d, "orders").selectExpr("o_custkey as k", "o_orderkey")
    return joins.row_match(orders, table(spark, d, "lineitem").selectExpr("l_partkey as k", "l_orderkey * 10 + l_linenumber as line"), ["k"], "o_orderkey", "line")


@query("column_overlap", "SELECT 'nation' AS \"column\", (SELECT count(DISTINCT c_nationkey) FROM customer) AS old, (SELECT count(DISTINCT s_nationkey) FROM supplier WHERE s_acctbal > 3000) AS new, (SELECT count(*) FROM (SELECT c_nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier WHERE s_acctbal > 3000)) AS both UNION ALL SELECT 'key', (SELECT count(DISTINCT c_custkey) FROM customer), (SELECT count(DISTINCT s_suppkey) FROM supplier WHERE s_acctbal > 3000), (SELECT count(*) FROM (SELECT c_custkey FROM customer INTERSECT SELECT s_suppkey FROM supplier WHERE s_acctbal > 3000))")
def column_overlap(spark: SparkSession, d: str) -> DataFrame:
    old, new = table(spark, d, "customer").selectExpr("c_nationkey as nation", "c_custkey as key"), table(spark, d, "supplier").where("s_acctbal > 3000").selectExpr("s_nationkey as nation", "s_suppkey as key")
    return joins.column_overlap(old, new, ["nation", "key"])


@query("prefix_join", "SELECT p_brand AS a, b FROM (SELECT DISTINCT p_brand FROM part) JOIN (SELECT DISTINCT 'brand#' || (p_size % 10)::VARCHAR AS b FROM part UNION SELECT 'BRAND#12 large') ON starts_with(lower(p_brand), lower(b)) OR starts_with(lower(b), lower(p_brand))")
def prefix_join(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    other = part.select(F.concat(F.lit("brand#"), (F.col("p_size") % 10).cast("string")).alias("b")).distinct().union(spark.range(1).select(F.lit("BRAND#12 large")))
    return joins.prefix_join(part.select(F.col("p_brand").alias("a")).distinct(), other, "a", "b")


@query("reciprocal_pairs", "WITH e AS (SELECT DISTINCT l_suppkey AS a, l_partkey AS b FROM lineitem WHERE l_suppkey <> l_partkey) SELECT a AS lo, b AS hi FROM e WHERE a < b AND EXISTS (SELECT 1 FROM e f WHERE f.a = e.b AND f.b = e.a)")
def reciprocal_pairs(spark: SparkSession, d: str) -> DataFrame:
    return joins.reciprocal(table(spark, d, "lineitem"), "l_suppkey", "l_partkey")


@query("unnest_words", "SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word FROM part")
def unnest_words(spark: SparkSession, d: str) -> DataFrame:
    return relations.unnested(table(spark, d, "part"), F.split("p_name", " "), "word").select("p_partkey", "word")


@query("json_fields", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, json_extract_string(props, '$.none') AS missing FROM events")
def json_fields(spark: SparkSession, d: str) -> DataFrame:
    field = lambda name: F.get_json_object("props", f"$.{name}")
    return table(spark, d, "events").select("event_id", text.whole_number(field("k")).alias("k"), field("none").alias("missing"))


@query("positional_columns", "SELECT o_orderkey::VARCHAR AS c0, NULL::VARCHAR AS c1, o_orderstatus AS c2, o_orderkey::VARCHAR AS c3 FROM orders")
def positional_columns(spark: SparkSession, d: str) -> DataFrame:
    return relations.positional(table(spark, d, "orders"), ["o_orderkey", None, "o_orderstatus", "o_orderkey"])


@query("merged_maps", "SELECT p_partkey, 'b=' || p_brand || ',s=' || p_size::VARCHAR || ',t=' || p_name AS entries FROM part")
def merged_maps(spark: SparkSession, d: str) -> DataFrame:
    """The second map's entries win."""
    base = F.create_map(F.lit("b"), "p_brand", F.lit("t"), "p_type")
    merged = relations.merged_maps(base, F.create_map(F.lit("t"), F.col("p_name"), F.lit("s"), F.col("p_size").cast("string")))
    listed = F.array_join(F.transform(F.array_sort(F.map_entries(merged)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return table(spark, d, "part").select("p_partkey", listed.alias("entries"))


@query("text_predicates", "SELECT count(*) FILTER (p_name LIKE '%ring') AS suffix, count(*) FILTER (p_name ILIKE '%RED%') AS anywhere, count(*) FILTER (regexp_matches(p_brand, '#1[0-9]$')) AS pattern, count(*) FILTER (p_type IN ('SMALL', 'ECONOMY')) AS listed, count(*) FILTER (p_type NOT IN ('SMALL', 'ECONOMY')) AS unlisted, count(*) FILTER (starts_with(p_name, 'blue')) AS prefix FROM part")
def text_predicates(spark: SparkSession, d: str) -> DataFrame:
    listed = F.col("p_type").isin("SMALL", "ECONOMY")
    tests = {"suffix": F.col("p_name").like("%ring"), "anywhere": F.col("p_name").ilike("%RED%"), "pattern": F.col("p_brand").rlike("#1[0-9]$"), "listed": listed, "unlisted": ~listed, "prefix": F.col("p_name").startswith("blue")}
    return table(spark, d, "part").agg(*[F.count_if(t).alias(name) for name, t in tests.items()])


@query("text_keys", r"SELECT doc_id, regexp_replace(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS slug, sha256('{~c0~:~' || doc_id::VARCHAR || '~,~c1~:~' || lang || '~}') AS id FROM documents".replace("~", '"'))
def text_keys(spark: SparkSession, d: str) -> DataFrame:
    """Slugs of texts (titles are no column of the table) and row ids."""
    return table(spark, d, "documents").select("doc_id", text.slug(F.col("text")).alias("slug"), text.row_id(F.col("doc_id"), F.col("lang")).alias("id"))


_CLEAN = f"regexp_replace(trim(text, '{text.SPACES}'), '[{text.SPACES}]+', ' ', 'g')"
_AT = "strpos(lower(text), 'the')"


@query("text_cleaning", f"""SELECT doc_id, md5({_CLEAN}) AS cleaned, CASE WHEN {_AT} > 0 THEN (CASE WHEN {_AT} > 11 THEN '…' ELSE '' END) || substring(text, greatest(1, {_AT} - 10), least(length(text), {_AT} + 12) - greatest(1, {_AT} - 10) + 1)
|| (CASE WHEN {_AT} + 12 < length(text) THEN '…' ELSE '' END) END AS found, md5(trim(text, '{text.SPACES}{text.BRACKETS}')) AS unwrapped FROM documents""")
def text_cleaning(spark: SparkSession, d: str) -> DataFrame:
    """Whole texts without extra white space and brackets, and what stands around a word."""
    return table(spark, d, "documents").select("doc_id", F.md5(text.collapsed(F.col("text")).cast("binary")).alias("cleaned"), text.excerpt(F.col("text"), F.lit("the"), 10).alias("found"), F.md5(text.unwrapped(F.col("text")).cast("binary")).alias("unwrapped"))


@query("text_words", """SELECT p_partkey, array_to_string(list_filter(string_split(upper(p_name), ' '), lambda w: w <> 'RED'), '+') AS words, TRY_CAST(regexp_extract(p_brand, '[0-9]+') AS BIGINT) AS brand, upper(replace(p_name, ' ', '')) AS name,
CASE WHEN string_split(p_name, ' ')[1] = string_split(p_name, ' ')[2] THEN 1 ELSE len(string_split(p_name, ' ')) END::BIGINT AS changes FROM part""")
def text_words(spark: SparkSession, d: str) -> DataFrame:
    words = text.without(text.word_set(F.col("p_name")), ["RED"])
    changes = F.size(text.once_in_a_row(F.split("p_name", " "))).cast("long")
    return table(spark, d, "part").select("p_partkey", F.array_join(words, "+").alias("words"), text.whole_number(F.regexp_extract("p_brand", "[0-9]+", 0)).alias("brand"), text.normalised(F.col("p_name")).alias("name"), changes.alias("changes"))


@query("gram_coverage", """WITH w AS (SELECT p_partkey, string_split(lower(p_name || ' of ' || p_type || ' size'), ' ') AS a, string_split(lower(p_name || ' of any size'), ' ') AS b FROM part), g AS (SELECT p_partkey, list_distinct(list_transform(range(1, len(a)), lambda k: a[k] || ' ' || a[k + 1])) AS x, list_distinct(list_transform(range(1, len(b)), lambda k: b[k] || ' ' || b[k + 1])) AS y FROM w)
SELECT p_partkey, round(len(list_intersect(x, y)) / len(x), 9) AS share FROM g""")
def gram_coverage(spark: SparkSession, d: str) -> DataFrame:
    """The share of a label's pairs of words that another has as well."""
    label = lambda *more: F.split(F.lower(F.concat("p_name", *[F.lit(x) if isinstance(x, str) else x for x in more])), " ")
    share = text.gram_coverage(label(" of ", F.col("p_type"), " size"), label(" of any size"), 2)
    return table(spark, d, "part").select("p_partkey", F.round(share, 9).alias("share"))


@query("label_parts", """SELECT p_partkey, CASE WHEN p_name LIKE '%ring%' THEN 'ring' WHEN p_name LIKE '%red%' THEN 'red' WHEN regexp_matches(p_name, '^b') THEN 'b' END AS kind, upper(replace(p_name, ' ', '')) AS squeezed, 'P' AS letters, p_size::BIGINT AS number, 4 AS width,
(SELECT string_agg('P' || lpad(k::VARCHAR, 4, '0'), '+' ORDER BY k) FROM range(p_size, p_size + p_size % 4 + 1) r(k)) AS span FROM part""")
def label_parts(spark: SparkSession, d: str) -> DataFrame:
    """Kinds by ordered rules; labels made of letters and a number, and spans of them."""
    label = lambda n: F.concat(F.lit("P"), F.lpad(n.cast("string"), 4, "0"))
    parts = text.lettered_number(label(F.col("p_size")))
    spans = text.span(label(F.col("p_size")), label(F.col("p_size") + F.col("p_size") % 4), 100)
    kind = text.first_rule(F.col("p_name"), [("ring", "ring"), ("red", "red"), ("^b", "b")])
    return table(spark, d, "part").select("p_partkey", kind.alias("kind"), text.squeezed(F.col("p_name")).alias("squeezed"), parts["letters"].alias("letters"), parts["number"].alias("number"), parts["width"].alias("width"), F.array_join(spans, "+").alias("span"))


@query("collapsed_rows", """SELECT l_orderkey, min(l_linenumber) AS place, (SELECT string_agg(f, ',' ORDER BY k, f) FROM (SELECT i.l_returnflag AS f, min(i.l_linenumber) AS k FROM lineitem i WHERE i.l_orderkey = o.l_orderkey GROUP BY 1)) AS l_returnflag,
CASE WHEN min(l_suppkey) = max(l_suppkey) THEN min(l_suppkey) ELSE sum(l_suppkey) END::BIGINT AS l_suppkey FROM lineitem o GROUP BY l_orderkey""")
def collapsed_rows(spark: SparkSession, d: str) -> DataFrame:
    return summaries.collapsed(table(spark, d, "lineitem"), ["l_orderkey"], "l_linenumber", "l_returnflag", "l_suppkey")


@query("nation_rollup", """SELECT n_name, count(DISTINCT c_custkey) AS customers, count(o_orderkey) AS orders, max(o_orderdate) AS last, count(*) FILTER (o_orderstatus = 'F') AS F, count(*) FILTER (o_orderstatus = 'O') AS O, nullif(count(*) FILTER (o_orderstatus IS NOT NULL), 0) AS known
FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey AND c_acctbal > 9000 LEFT JOIN orders ON o_custkey = c_custkey GROUP BY n_name""")
def nation_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Counts of two levels below a nation, the newest date, counts by status, and a denominator that is null where nothing is known."""
    orders = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"), F.max("o_orderdate").alias("last"), F.count_if(F.col("o_orderstatus") == "F").alias("F"), F.count_if(F.col("o_orderstatus") == "O").alias("O"), F.count("o_orderstatus").alias("known"))
    customers = table(spark, d, "customer").where("c_acctbal > 9000").join(orders, "c_custkey", "left")
    of = customers.groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("customers"), F.sum("n").alias("orders"), F.max("last").alias("last"), F.sum("F").alias("F"), F.sum("O").alias("O"), F.sum("known").alias("known"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return table(spark, d, "nation").join(of, "n_nationkey", "left").select("n_name", zero("customers"), zero("orders"), "last", zero("F"), zero("O"), F.nullif(F.col("known"), F.lit(0)).alias("known"))


@query("present_columns", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'")
def present_columns(spark: SparkSession, d: str) -> DataFrame:
    """A filter on a column that the table has, and one on a column that it has not."""
    return relations.where_present(table(spark, d, "orders"), {"o_orderstatus": "F", "project": 7}).select("o_orderkey")


@query("double_classes", "SELECT class, kind, count(*) AS n FROM (SELECT p_type AS class, 'type' AS kind FROM part UNION ALL SELECT p_type || '_large', 'type' FROM part WHERE p_size > 25 UNION ALL SELECT p_brand, 'brand' FROM part) GROUP BY 1, 2")
def double_classes(spark: SparkSession, d: str) -> DataFrame:
    """Counts of classes where a row has one or more: its type, that of large ones again, its brand."""
    each = lambda c, kind: F.struct(c.alias("class"), F.lit(kind).alias("kind"))
    large = F.when(F.col("p_size") > 25, F.concat("p_type", F.lit("_large")))
    rows = table(spark, d, "part").select(F.explode(F.array(each(F.col("p_type"), "type"), each(large, "type"), each(F.col("p_brand"), "brand"))).alias("c"))
    return rows.where("c.class is not null").groupBy("c.class", "c.kind").agg(F.count("*").alias("n"))


@query("first_match", """WITH k AS (SELECT DISTINCT c_custkey, upper(w) AS w FROM (SELECT c_custkey, unnest(['small ' || (c_nationkey % 7)::VARCHAR, 'Brand-' || c_nationkey::VARCHAR]) AS w FROM customer)), n AS (SELECT c_custkey, regexp_replace(w, '[^A-Z0-9]', '', 'g') AS w FROM k),
m AS (SELECT c_custkey, p_partkey, p_brand, row_number() OVER (PARTITION BY c_custkey ORDER BY p_partkey) AS i FROM n JOIN part ON regexp_replace(upper(p_brand), '[^A-Z0-9]', '', 'g') = w) SELECT c.c_custkey, m.p_partkey, m.p_brand FROM customer c LEFT JOIN m ON m.c_custkey = c.c_custkey AND m.i = 1""")
def first_match(spark: SparkSession, d: str) -> DataFrame:
    """The first part of a brand that one of a customer's labels names, in another spelling."""
    labels = F.array(F.concat(F.lit("small "), (F.col("c_nationkey") % 7).cast("string")), F.concat(F.lit("Brand-"), F.col("c_nationkey").cast("string")))
    return joins.first_match(table(spark, d, "customer"), table(spark, d, "part").select("p_partkey", "p_brand"), "c_custkey", labels, "p_brand", ["p_partkey"])


@query("owner_lookup", "SELECT l_orderkey, l_linenumber, l_partkey, s_name AS owner, s_name IS NULL AS open FROM lineitem LEFT JOIN supplier ON s_suppkey = l_suppkey AND s_acctbal > 0")
def owner_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Lines and their supplier if it is solvent; those without one are open."""
    owners = table(spark, d, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_name").alias("owner"))
    return table(spark, d, "lineitem").join(owners, "l_suppkey", "left").select("l_orderkey", "l_linenumber", "l_partkey", "owner", F.col("owner").isNull().alias("open"))


@query("grouped_ids", "SELECT o_custkey, o_orderstatus, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey) AS ids, count(*) AS n FROM orders GROUP BY 1, 2")
def grouped_ids(spark: SparkSession, d: str) -> DataFrame:
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("o_orderkey")), lambda x: x.cast("string")), ",")
    return table(spark, d, "orders").groupBy("o_custkey", "o_orderstatus").agg(ids.alias("ids"), F.count("*").alias("n"))


@query("filtered_newest", "SELECT event_id, user_id FROM events WHERE event_type = 'click' AND user_id % 3 = 1 AND ts >= TIMESTAMP '2024-01-02' ORDER BY ts DESC, event_id DESC LIMIT 100")
def filtered_newest(spark: SparkSession, d: str) -> DataFrame:
    """The newest hundred events that several conditions hold for."""
    some = table(spark, d, "events").where("event_type = 'click' and user_id % 3 = 1 and ts >= timestamp'2024-01-02'")
    return relations.page(some, [F.desc("ts"), F.desc("event_id")], 0, 100).select("event_id", "user_id")


@query("iso_dates", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS at FROM orders")
def iso_dates(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss").alias("at"))


@query("sealed_maps", "SELECT p_partkey, sha256('[{~key~:~b~,~value~:~' || p_brand || '~},{~key~:~t~,~value~:~' || p_type || '~}]') AS seal FROM part".replace("~", '"'))
def sealed_maps(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", text.map_checksum(F.create_map(F.lit("t"), "p_type", F.lit("b"), "p_brand")).alias("seal"))


@query("distinct_list", "SELECT p_brand, string_agg(DISTINCT p_type, ', ' ORDER BY p_type) AS p_type FROM part GROUP BY p_brand")
def distinct_list(spark: SparkSession, d: str) -> DataFrame:
    return summaries.distinct_list(table(spark, d, "part"), ["p_brand"], "p_type")


@query("ordered_list", "SELECT o_custkey, array_to_string(list(o_orderstatus ORDER BY k), ',') AS statuses FROM (SELECT o_custkey, o_orderstatus, min(o_orderkey) AS k FROM orders GROUP BY 1, 2) GROUP BY 1")
def ordered_list(spark: SparkSession, d: str) -> DataFrame:
    listed = summaries.ordered_list(table(spark, d, "orders"), ["o_custkey"], "o_orderkey", "o_orderstatus")
    return listed.select("o_custkey", F.array_join("o_orderstatus", ",").alias("statuses"))


@query("flag_counts", "WITH e AS (SELECT DISTINCT p_partkey, unnest(string_split(p_name, ' ')) AS flag FROM part), r AS (SELECT *, row_number() OVER (PARTITION BY flag ORDER BY p_partkey) AS k FROM e) SELECT flag, count(*) AS n, array_to_string(list(p_partkey ORDER BY p_partkey) FILTER (k <= 5), ',') AS samples FROM r GROUP BY flag")
def flag_counts(spark: SparkSession, d: str) -> DataFrame:
    counted = summaries.flag_counts(table(spark, d, "part").withColumn("words", F.split("p_name", " ")), "words", 5, "p_partkey")
    return counted.select("flag", "n", F.array_join(F.col("samples").cast("array<string>"), ",").alias("samples"))


@query("progress", "SELECT o_custkey, count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS done, count(*) FILTER (o_orderstatus = 'P') AS running, count(*) FILTER (o_orderstatus NOT IN ('F', 'P')) AS open, count(*) = count(*) FILTER (o_orderstatus = 'F') AS complete FROM orders GROUP BY 1")
def progress(spark: SparkSession, d: str) -> DataFrame:
    return summaries.progress(table(spark, d, "orders"), ["o_custkey"], "o_orderstatus", "F", "P")


@query("pivot_with_total", "SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS F, count(*) FILTER (o_orderstatus = 'O') AS O, count(*) AS total FROM orders GROUP BY 1")
def pivot_with_total(spark: SparkSession, d: str) -> DataFrame:
    return summaries.pivot_counts(table(spark, d, "orders"), ["o_orderpriority"], "o_orderstatus", ["F", "O"], "total")


@query("word_score", "SELECT p_partkey, score::DOUBLE AS score FROM (SELECT p_partkey, 3.0 * len(list_intersect(string_split(p_name, ' '), ['red', 'ring'])) + 1.0 * len(list_intersect([lower(p_type)], ['red', 'ring', 'small'])) AS score FROM part) WHERE score > 0 ORDER BY score DESC, p_partkey LIMIT 25".replace("['red', 'ring']))", "['red', 'ring', 'small']))"))
def word_score(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part").select("p_partkey", F.split("p_name", " ").alias("name"), F.array(F.lower("p_type")).alias("type"))
    return summaries.word_score(part, ["red", "ring", "small"], {"name": 3.0, "type": 1.0}, "p_partkey", 25)


@query("similar_vectors", """WITH q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 7), s AS (SELECT vec_id, vec_id % 50 AS content, list_cosine_similarity(embedding, e) AS sim FROM embeddings, q)
SELECT vec_id FROM (SELECT vec_id, sim, row_number() OVER (PARTITION BY content ORDER BY sim DESC, vec_id) AS k FROM s) WHERE k = 1 ORDER BY sim DESC, vec_id LIMIT 10""")
def similar_vectors(spark: SparkSession, d: str) -> DataFrame:
    """The vectors most like the seventh, one of each content; ids, since sums of doubles differ in their last digits."""
    rows = table(spark, d, "embeddings")
    asked = rows.where("vec_id = 7").select("embedding").first()[0]
    return summaries.similar_vectors(rows, asked, "vec_id", "embedding", F.col("vec_id") % 50, 10).select("vec_id")


@query("header_rows", "SELECT o_orderkey, l_linenumber, o_orderdate, l_quantity FROM orders JOIN lineitem ON o_orderkey = l_orderkey")
def header_rows(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").join(table(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", "l_linenumber", "o_orderdate", "l_quantity")
