"""Queries over portraits, tables of results, splits and agreement."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.state import cut
from ..operators import hypergraph as hg, neighbours as nb, portraits, reports as rp
from ..sources import formats
from ..sources.collections import CUSTOMER_SQL, EVENT_SQL, customer_incidence, event_incidence, table
from .edits import VERDICT_SQL, record_verdicts
from .measures import DIST_SQL, NEAR_SQL
from .registry import query

PORTRAIT_SQL = (
    f"{EVENT_SQL}, a AS (SELECT hg, e, count(*) AS a FROM inc GROUP BY hg, e HAVING count(*) > 1), big AS (SELECT i.* FROM inc i JOIN a USING (hg, e)), "
    "near AS (SELECT DISTINCT x.hg, x.e, y.e AS f FROM big x JOIN big y ON x.hg = y.hg AND x.v = y.v AND x.e <> y.e), "
    "walk AS (SELECT hg, e, e AS f, 0 AS l FROM a UNION SELECT w.hg, w.e, n.f, w.l + 1 FROM walk w JOIN near n ON n.hg = w.hg AND n.e = w.f WHERE w.l < (SELECT count(*) FROM a x WHERE x.hg = w.hg)), "
    "far AS (SELECT hg, e, f, min(l) AS l FROM walk GROUP BY hg, e, f), ends AS (SELECT hg, max(l) AS longest FROM far GROUP BY hg), top AS (SELECT hg, max(a) AS largest FROM a GROUP BY hg), "
    "grid AS (SELECT hg, e, a AS m, unnest(range(2, largest + 1)) AS n, longest FROM a JOIN ends USING (hg) JOIN top USING (hg)), full_grid AS (SELECT hg, e, m, n, unnest(range(0, longest + 1)) AS l FROM grid), "
    "k AS (SELECT far.hg, far.e, b.a AS n, l, count(*) AS k FROM far JOIN a b ON b.hg = far.hg AND b.e = far.f GROUP BY ALL), "
    "portrait AS (SELECT g.hg, g.m, g.n, g.l, coalesce(k.k, 0) AS k, count(*) AS times FROM full_grid g LEFT JOIN k ON k.hg = g.hg AND k.e = g.e AND k.n = g.n AND k.l = g.l GROUP BY ALL)"
)


@query(f"WITH RECURSIVE {PORTRAIT_SQL} SELECT hg, m, n, CAST(l AS INT) AS l, k, times FROM portrait")
def fact_portraits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every record how many facts of one size have how many facts of another size at each distance."""
    return portraits.portrait(event_incidence(spark, sf_dir))


@query(
    f"WITH RECURSIVE {PORTRAIT_SQL}, p AS (SELECT *, times / sum(times) OVER (PARTITION BY hg) AS p FROM portrait), ids AS (SELECT DISTINCT hg FROM p), "
    "s AS (SELECT x.hg AS i, y.hg AS j, sum(x.p * log2(2 * x.p / (x.p + y.p)) - x.p + y.p * log2(2 * y.p / (x.p + y.p)) - y.p) AS s FROM p x JOIN p y ON x.m = y.m AND x.n = y.n AND x.l = y.l AND x.k = y.k WHERE x.hg % 100 = 0 AND x.hg <> y.hg GROUP BY ALL) "
    "SELECT q.hg AS i, r.hg AS j, round(greatest(1 + coalesce(s, 0) / 2, 0), 6) + 0.0 AS divergence FROM ids q JOIN ids r ON q.hg <> r.hg LEFT JOIN s ON s.i = q.hg AND s.j = r.hg WHERE q.hg % 100 = 0"
)
def pair_portrait(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divergence of the portraits of query records and all others."""
    found = portraits.portrait_divergence(fact_portraits(spark, sf_dir))
    return found.select("i", "j", F.round("divergence", 6).alias("divergence"))


@query(
    "WITH g AS (SELECT o_orderpriority AS arm, year(o_orderdate) AS bucket, count(*) AS members, count(*) FILTER (o_orderstatus = 'F') AS completed, "
    "quantile_cont(o_totalprice, 0.5) FILTER (o_orderstatus = 'F') AS median, quantile_cont(o_totalprice, 0.9) FILTER (o_orderstatus = 'F') AS p90 FROM orders GROUP BY ALL) "
    "SELECT arm, CAST(bucket AS INT) AS bucket, members, completed, round(completed / members, 6) AS share, round(median, 4) AS median, round(p90, 4) AS p90 FROM g"
)
def yield_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Completed orders and their prices by priority and year."""
    runs = table(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("arm"), F.year("o_orderdate").alias("bucket"), (F.col("o_orderstatus") == "F").alias("done"), F.col("o_totalprice").alias("cost")
    )
    found = rp.yields(runs, ["arm", "bucket"], "done", "cost")
    return found.select("arm", "bucket", "members", "completed", F.round("share", 6).alias("share"), F.round("median", 4).alias("median"), F.round("p90", 4).alias("p90"))


@query(
    "WITH c AS (SELECT event_type AS arm, user_id % 4 AS k, hour(ts) AS m, user_id AS cell, count(*) FILTER (value > 400) AS censored FROM events GROUP BY ALL), f AS (SELECT * FROM c WHERE censored = 0), "
    "b AS (SELECT arm, k, max(m) AS m FROM f GROUP BY ALL) SELECT arm, k, CAST(m AS INT) AS m, min(cell) AS cell FROM b JOIN f USING (arm, k, m) GROUP BY arm, k, m"
)
def clear_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest hour without a value above 400 for each kind of event and group of users, and the first user there."""
    cells = table(spark, sf_dir, "events").groupBy(
        F.col("event_type").alias("arm"), (F.col("user_id") % 4).alias("k"), F.hour("ts").alias("m"), F.col("user_id").alias("cell")
    ).agg(F.count_if(F.col("value") > 400).alias("censored"))
    return rp.frontier(cells, ["arm", "k"], "m", "censored", "cell")


@query(
    f"WITH RECURSIVE {VERDICT_SQL}, "
    "c AS (SELECT hg % 5 AS model, verdict AS reason, count(*) AS times FROM verdict WHERE verdict <> 'accepted' GROUP BY ALL) "
    "SELECT model, reason, times, round(times / sum(times) OVER (PARTITION BY model), 6) AS share FROM c"
)
def rejection_causes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why records are not accepted, in five groups of them."""
    rejected = record_verdicts(spark, sf_dir).where("verdict <> 'accepted'").select((F.col("hg") % 5).alias("model"), F.col("verdict").alias("reason"))
    return rp.causes(rejected, ["model"], "reason").withColumn("share", F.round("share", 6))


@query(
    "WITH e AS (SELECT event_type AS type, CAST(ts AS DATE) AS day, user_id FROM events), b AS (SELECT type, min(day) AS lo, max(day) AS hi FROM e GROUP BY type), "
    "d AS (SELECT type, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS day FROM b), s AS (SELECT type, day, count(DISTINCT user_id) AS seeds FROM e GROUP BY ALL) "
    "SELECT type, day, coalesce(seeds, 0) AS seeds, CASE WHEN seeds IS NULL THEN 'absent' WHEN seeds < 8 THEN 'partial' ELSE 'complete' END AS status FROM d LEFT JOIN s USING (type, day)"
)
def coverage_by_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many users each kind of event and day was seen with, of eight that are expected, days without any included."""
    seen = table(spark, sf_dir, "events").select(F.col("event_type").alias("type"), F.to_date("ts").alias("day"), "user_id")
    ends = seen.groupBy("type").agg(F.min("day").alias("lo"), F.max("day").alias("hi"))
    design = ends.select("type", F.explode(F.sequence("lo", "hi")).alias("day"))
    return rp.coverage(design, seen, ["type", "day"], "user_id", 8)


@query("SELECT o_custkey AS cell, count(DISTINCT o_orderpriority) AS tags FROM orders GROUP BY o_custkey HAVING count(DISTINCT o_orderpriority) > 1")
def cells_with_several_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("cell"), "o_orderpriority")
    return rp.several_tags(rows, ["cell"], "o_orderpriority")


@query(
    "WITH o AS (SELECT DISTINCT o_custkey, o_orderpriority FROM orders), k AS (SELECT o_custkey AS member FROM o GROUP BY o_custkey HAVING count(*) = (SELECT count(DISTINCT o_orderpriority) FROM orders)) "
    "SELECT member FROM k WHERE member NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)"
)
def common_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with orders of every priority, without those in debt."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("member"), F.col("o_orderpriority").alias("arm"))
    debt = table(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("member"))
    return rp.common_members(rows, "member", "arm", debt)


@query(
    "WITH o AS (SELECT o_custkey AS hg, year(o_orderdate) AS y, o_orderpriority AS pattern FROM orders), n AS (SELECT hg, y, pattern, count(*) AS n FROM o GROUP BY ALL) "
    "SELECT a.hg, CAST(a.y AS INT) AS year, a.pattern, a.n - coalesce(b.n, 0) AS times FROM n a LEFT JOIN n b ON b.hg = a.hg AND b.y = a.y - 1 AND b.pattern = a.pattern WHERE a.n > coalesce(b.n, 0)"
)
def added_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each customer's year has beyond the year before, as multisets of priorities."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("hg"), F.year("o_orderdate").alias("year"), F.col("o_orderpriority").alias("pattern"))
    return rp.added(rows, rows.withColumn("year", F.col("year") + 1), ["hg", "year"], "pattern")


DEALT_SQL = "WITH d AS (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY ('0x' || substr(md5(vec_id || '|5'), 1, 8))::BIGINT, vec_id) - 1 AS place, count(*) OVER (PARTITION BY label) AS n FROM embeddings)"


@query(f"{DEALT_SQL} SELECT vec_id, label, place < greatest(round_even(n * 0.8::DOUBLE, 0), 1) AS train FROM d")
def split_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four fifths of each label to learn from, the rest to test."""
    return rp.split(table(spark, sf_dir, "embeddings").select("vec_id", "label"), "vec_id", "label", 0.8, 5)


@query(f"{DEALT_SQL}, s AS (SELECT count(*) AS n, count(DISTINCT label) AS k FROM embeddings) SELECT vec_id, label FROM d, s WHERE s.n <= 200 OR place < greatest(200 // k, 1)")
def stratified_subsample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sampling operator: 200 vectors, as many of each label."""
    return rp.subsample(table(spark, sf_dir, "embeddings").select("vec_id", "label"), "vec_id", "label", 200, 5)


@query(
    "WITH t AS (SELECT DISTINCT o_custkey AS entity, l_partkey AS type FROM orders JOIN lineitem ON l_orderkey = o_orderkey), c AS (SELECT type, count(*) AS carriers FROM t GROUP BY type) "
    "SELECT entity, type, carriers FROM t JOIN c USING (type) QUALIFY row_number() OVER (PARTITION BY entity ORDER BY carriers DESC, type) = 1"
)
def assigned_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's part that most customers have."""
    return rp.most_frequent_type(customer_incidence(spark, sf_dir).select(F.col("hg").alias("entity"), F.col("v").alias("kind")), "entity", "kind")


@query(
    "WITH p AS (SELECT doc_id, lang, source, CAST(n_chars % 7 AS VARCHAR) AS rest FROM documents), l AS (SELECT doc_id, 'lang' AS method, lang AS class FROM p UNION ALL SELECT doc_id, 'source', source FROM p UNION ALL SELECT doc_id, 'rest', rest FROM p), "
    "c AS (SELECT x.method AS a, y.method AS b, x.class AS x, y.class AS y, count(*) AS n FROM l x JOIN l y ON x.doc_id = y.doc_id AND x.method < y.method GROUP BY ALL), s AS (SELECT a, b, sum(n) AS items, sum(n * (n - 1) / 2) AS s FROM c GROUP BY ALL), "
    "p1 AS (SELECT a, b, sum(n * (n - 1) / 2) AS p FROM (SELECT a, b, x, sum(n) AS n FROM c GROUP BY ALL) GROUP BY ALL), p2 AS (SELECT a, b, sum(n * (n - 1) / 2) AS q FROM (SELECT a, b, y, sum(n) AS n FROM c GROUP BY ALL) GROUP BY ALL) "
    "SELECT a, b, CAST(items AS BIGINT) AS items, round((s - p * q / (items * (items - 1) / 2)) / ((p + q) / 2 - p * q / (items * (items - 1) / 2)), 6) AS ari FROM s JOIN p1 USING (a, b) JOIN p2 USING (a, b)"
)
def agreement_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agreement of the documents' partitions by language, source and a remainder of their length."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", (F.col("n_chars") % 7).cast("string").alias("rest"))
    parts = docs.unpivot("doc_id", ["lang", "source", "rest"], "method", "class").withColumnRenamed("doc_id", "item")
    return rp.agreement_of_partitions(parts).withColumn("ari", F.round("ari", 6))


@query(
    f"WITH {EVENT_SQL}, f AS (SELECT hg, e, string_agg(v, ',' ORDER BY v) AS f FROM inc GROUP BY hg, e), w AS (SELECT hg, string_agg(DISTINCT f, ';' ORDER BY f) AS word FROM f GROUP BY hg), r AS (SELECT word, hg % 100003 % 7 AS code FROM w), "
    "g AS (SELECT word, code, count(*) AS own FROM r GROUP BY ALL), s AS (SELECT *, sum(own) OVER (PARTITION BY word) AS n FROM g) "
    "SELECT CAST(sum(own) AS BIGINT) AS items, CAST(sum(CASE WHEN n = 1 THEN 1 ELSE 0 END) AS BIGINT) AS alone, round(sum(CASE WHEN n = 1 THEN 1.0 ELSE own * (own - 1) / (n - 1) END) / sum(own), 6) AS ceiling FROM s"
)
def exact_ceiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well equal records could tell the day of the week."""
    facts = event_incidence(spark, sf_dir).groupBy("hg", "e").agg(F.array_join(F.sort_array(F.collect_list("v")), ",").alias("f"))
    words = facts.groupBy("hg").agg(F.array_join(F.sort_array(F.collect_set("f")), ";").alias("word"))
    rows = words.select("word", (F.col("hg") % 100_003 % 7).alias("code"))
    return rp.exact_ceiling(rows, "word", "code").withColumn("ceiling", F.round("ceiling", 6))


@query(
    f"WITH {DIST_SQL}, b AS (SELECT i, min(d) AS d FROM dist GROUP BY i), t AS (SELECT dist.i, li, lj, 1.0 / count(*) OVER (PARTITION BY dist.i) AS p FROM dist JOIN b ON b.i = dist.i AND b.d = dist.d), "
    "s AS (SELECT count(DISTINCT i) AS n, coalesce(sum(p) FILTER (li <> lj AND li % 3 = lj % 3), 0) AS w, coalesce(sum(p) FILTER (li % 3 <> lj % 3), 0) AS o FROM t) "
    "SELECT round(w / n, 6) + 0.0 AS within, round(o / n, 6) + 0.0 AS other, round(w / nullif(w + o, 0), 6) + 0.0 AS share FROM s"
)
def error_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether wrong nearest labels are of the query's group of labels or of another."""
    dist = cut(nb.near_distances(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", "label", 1))
    found = rp.error_split(nb.label_probabilities(dist), F.col("li") % 3, F.col("lj") % 3)
    return found.select(*[F.round(c, 6).alias(c) for c in ("within", "other", "share")])


@query(f"WITH {NEAR_SQL} SELECT DISTINCT least(i, j) AS a, greatest(i, j) AS b FROM near WHERE r <= 5")
def neighbour_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The undirected graph of the five nearest of each query vector."""
    return rp.neighbour_graph(nb.near_distances(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", "label", 5), 5)


@query(
    f"WITH {CUSTOMER_SQL}, a AS (SELECT hg, e, count(*) AS a FROM inc GROUP BY hg, e), n AS (SELECT hg, count(DISTINCT v) AS n FROM inc GROUP BY hg), k AS (SELECT hg, n + count(*) AS word_length, greatest(2, max(a)) AS pointers FROM a JOIN n USING (hg) GROUP BY hg, n) "
    "SELECT hg, word_length, pointers, CAST(pointers * (pointers - 1) // 2 + 3 * pointers + 1 AS BIGINT) AS alphabet, round(word_length * log2(pointers * (pointers - 1) // 2 + 3 * pointers + 1), 6) AS bits FROM k"
)
def word_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length of each record's word, the pointers and alphabet that it takes, and its bits."""
    return rp.word_sizes(hg.summary(customer_incidence(spark, sf_dir))).withColumn("bits", F.round("bits", 6))


@query("SELECT turn AS slot, count(DISTINCT role) AS symbols FROM conversations GROUP BY turn")
def observed_alphabet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rp.slots(table(spark, sf_dir, "conversations").withColumnRenamed("turn", "slot"), "slot", "role")


@query(
    "WITH d AS (SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY ALL), r AS (SELECT user_id, n / lag(n) OVER (PARTITION BY user_id ORDER BY day) AS r FROM d) "
    "SELECT user_id, count(*) AS steps, round(exp(avg(ln(r))), 6) AS geomean FROM r WHERE r IS NOT NULL GROUP BY user_id"
)
def growth_geomean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Geometric mean of how each user's events of a day grow from the active day before."""
    days = table(spark, sf_dir, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    return rp.mean_ratios(days, "user_id", "day", "n").withColumn("geomean", F.round("geomean", 6))


@query(
    f"WITH {CUSTOMER_SQL}, n AS (SELECT hg, v, v % 5 AS label FROM inc GROUP BY ALL), e AS (SELECT DISTINCT hg, e, CAST(substr(pred, 1, 1) AS BIGINT) AS label FROM inc), "
    "nodes AS (SELECT hg, count(*) AS n, max(label) + 1 AS labels, list({'node': v, 'attrs': {'label': label}} ORDER BY v) AS nodes FROM n GROUP BY hg), "
    "edges AS (SELECT hg, count(*) AS m, max(label) + 1 AS labels, list({'edge': e, 'attrs': {'label': label}} ORDER BY e) AS edges FROM e GROUP BY hg), "
    "met AS (SELECT hg, list({'node': v, 'edge': e} ORDER BY e, v) AS met FROM inc GROUP BY hg) "
    "SELECT hg, CAST(to_json({'network-type': 'undirected', 'metadata': {'n_vertex_labels': nodes.labels, 'n_edge_labels': edges.labels, 'n_nodes': n, 'n_edges': m}, 'nodes': nodes, 'edges': edges, 'incidences': met}) AS VARCHAR) AS value "
    "FROM nodes JOIN edges USING (hg) JOIN met USING (hg)"
)
def interchange_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record as a hypergraph interchange document."""
    inc = customer_incidence(spark, sf_dir)
    return formats.to_hif(inc.select("*", (F.col("v") % 5).alias("vl"), F.substring("pred", 1, 1).cast("long").alias("el")), "vl", "el")
