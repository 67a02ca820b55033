"""Queries over edits, profiles, statistics and formats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..operators import distances, edits, hypergraph as hg, models, statistics as st
from ..operators.sequences import divergence
from ..sources import formats
from ..sources.collections import CUSTOMER_SQL, EVENT_SQL, customer_incidence, event_incidence, table
from .registry import query


@query(
    f"WITH {CUSTOMER_SQL}, s AS (SELECT hg, e, count(*) AS a FROM inc GROUP BY hg, e) "
    "SELECT hg, count(*) AS fact_drops, CAST(sum(CASE WHEN a > 2 THEN a ELSE 0 END) AS BIGINT) AS constant_drops, CAST(sum(a + 1 + CASE WHEN a > 2 THEN a ELSE 0 END) AS BIGINT) AS cost FROM s GROUP BY hg"
)
def down_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many single down-edits every record has, and what they cost together."""
    inc = customer_incidence(spark, sf_dir)
    rows = edits.down_neighbours(inc).join(hg.arity(inc), ["hg", "e"])
    return rows.groupBy("hg").agg(
        F.count_if(F.col("kind") == "fact").alias("fact_drops"), F.count_if(F.col("kind") == "constant").alias("constant_drops"),
        F.sum(edits.edit_cost("kind", "arity")).cast("long").alias("cost"),
    )


@query(
    f"WITH {CUSTOMER_SQL}, f AS (SELECT hg, min(e) AS e FROM inc GROUP BY hg), l AS (SELECT i.hg, dense_rank() OVER (PARTITION BY i.hg ORDER BY i.e) - 1 AS e, v FROM inc i JOIN f ON f.hg = i.hg AND i.e <> f.e) SELECT hg, e, v FROM l"
)
def delete_first_fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    inc = customer_incidence(spark, sf_dir)
    return edits.delete_facts(inc, inc.groupBy("hg").agg(F.min("e").alias("e")))


@query(
    f"WITH {CUSTOMER_SQL}, d AS (SELECT hg, v FROM (SELECT hg, v, row_number() OVER (PARTITION BY hg ORDER BY count(*) DESC, v) AS r FROM inc GROUP BY hg, v) WHERE r = 1) "
    "SELECT i.hg, i.e, i.v FROM inc i LEFT JOIN d ON d.hg = i.hg AND d.v = i.v WHERE d.v IS NULL"
)
def delete_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record without its constant of the highest degree."""
    inc = customer_incidence(spark, sf_dir)
    root = hg.degree(inc).groupBy("hg").agg(F.min(F.struct((-F.col("degree")).alias("d"), "v")).alias("r")).select("hg", "r.v")
    return edits.delete_constants(inc, root)


@query(
    f"WITH {EVENT_SQL}, f AS (SELECT user_id, day, string_agg(v, ',' ORDER BY v) AS f FROM inc GROUP BY user_id, day, e), s AS (SELECT DISTINCT * FROM f), "
    "p AS (SELECT DISTINCT user_id, day FROM s), q AS (SELECT user_id, day, lead(day) OVER (PARTITION BY user_id ORDER BY day) AS next FROM p), "
    "n AS (SELECT user_id, day, count(*) AS n FROM s GROUP BY ALL), c AS (SELECT a.user_id, a.day, b.day AS next, count(*) AS c FROM s a JOIN s b ON a.user_id = b.user_id AND a.f = b.f GROUP BY ALL) "
    "SELECT q.user_id, q.day, CASE WHEN x.n + y.n - 2 * coalesce(c, 0) <= 4 THEN CAST(x.n + y.n - 2 * coalesce(c, 0) AS INT) END AS reach FROM q JOIN n x ON x.user_id = q.user_id AND x.day = q.day "
    "JOIN n y ON y.user_id = q.user_id AND y.day = q.next LEFT JOIN c ON c.user_id = q.user_id AND c.day = q.day AND c.next = q.next"
)
def reach_next_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deletions that make a user's day equal to their next one, null beyond four."""
    inc = event_incidence(spark, sf_dir)
    facts = inc.groupBy("hg", "user_id", "day", "e").agg(F.array_join(F.sort_array(F.collect_list("v")), ",").alias("f"))
    days = facts.groupBy("hg", "user_id", "day").agg(F.collect_set("f").alias("facts"))
    after = days.select("user_id", "day", F.col("hg").alias("a"), F.lead("hg").over(Window.partitionBy("user_id").orderBy("day")).alias("b")).where("b IS NOT NULL")
    return edits.reach(days, after.select("a", "b"), 4).join(after, ["a", "b"]).select("user_id", "day", "reach")


PROFILE_SQL = (
    "facts AS (SELECT hg, e, pred, count(*) AS arity FROM inc GROUP BY ALL), shape AS (SELECT hg, count(*) AS m FROM facts GROUP BY hg), size AS (SELECT hg, count(DISTINCT v) AS n FROM inc GROUP BY hg), "
    "profile AS (SELECT 'arity' AS kind, arity::VARCHAR AS item, count(*) AS c FROM facts GROUP BY ALL UNION ALL SELECT 'pred', pred, count(*) FROM facts GROUP BY ALL "
    "UNION ALL SELECT 'm', m::VARCHAR, count(*) FROM shape GROUP BY ALL UNION ALL SELECT 'n', n::VARCHAR, count(*) FROM size GROUP BY ALL)"
)


@query(f"WITH {CUSTOMER_SQL}, {PROFILE_SQL} SELECT kind, item, c AS n, round(c::DOUBLE / sum(c) OVER (PARTITION BY kind), 6) AS p FROM profile")
def collection_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Histograms of constants, facts, arities and labels of a collection."""
    return models.profile(customer_incidence(spark, sf_dir)).select("kind", "item", "n", F.round("p", 6).alias("p"))


@query(
    "WITH o AS (SELECT o_custkey AS hg, o_orderkey AS e, o_orderpriority AS pred, month(o_orderdate) <= 6 AS early FROM orders), k AS (SELECT early, pred, count(*)::DOUBLE AS n FROM o GROUP BY ALL), "
    "t AS (SELECT early, sum(n) AS t FROM k GROUP BY early), p AS (SELECT pred, coalesce(max(n / t) FILTER (early), 0) AS x, coalesce(max(n / t) FILTER (NOT early), 0) AS y FROM k JOIN t USING (early) GROUP BY pred) "
    "SELECT round(sum(CASE WHEN x > 0 THEN x * log2(2 * x / (x + y)) ELSE 0 END + CASE WHEN y > 0 THEN y * log2(2 * y / (x + y)) ELSE 0 END) / 2, 6) AS jsd FROM p"
)
def label_fidelity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divergence of the labels of facts of the first and the second half of a year."""
    orders = table(spark, sf_dir, "orders").select((F.month("o_orderdate") <= 6).alias("early"), F.col("o_orderpriority").alias("item"))
    grp = orders.groupBy(F.when(F.col("early"), "a").otherwise("b").alias("grp"), "item").agg(F.count("*").alias("n"))
    return divergence(grp).select(F.round("jsd", 6).alias("jsd"))


WL_HIST_SQL = (
    "facts AS (SELECT hg, e, count(*) AS a FROM inc GROUP BY hg, e), colour AS (SELECT i.hg, i.v, string_agg(a, ',' ORDER BY a) AS c FROM inc i JOIN facts USING (hg, e) GROUP BY i.hg, i.v), "
    "hist AS (SELECT hg, c, count(*) AS n FROM colour GROUP BY hg, c), q AS (SELECT DISTINCT hg FROM hist WHERE hg % 100 = 0), every AS (SELECT DISTINCT hg FROM hist), "
    "pairs AS (SELECT q.hg AS i, x.hg AS j FROM q JOIN every x ON q.hg <> x.hg), size AS (SELECT hg, sum(n) AS t FROM hist GROUP BY hg), "
    "shared AS (SELECT a.hg AS i, b.hg AS j, sum(abs(a.n - b.n) - a.n - b.n) AS l1, sum((a.n - b.n) ** 2 / (a.n + b.n) - a.n - b.n) AS chi FROM hist a JOIN hist b USING (c) WHERE a.hg % 100 = 0 GROUP BY ALL)"
)


@query(
    f"WITH {EVENT_SQL}, {WL_HIST_SQL} SELECT p.i, p.j, CAST(x.t + y.t + coalesce(l1, 0) AS BIGINT) AS wl_l1, round((x.t + y.t + coalesce(chi, 0)) / 2.0::DOUBLE, 6) AS wl_chi2 "
    "FROM pairs p JOIN size x ON x.hg = p.i JOIN size y ON y.hg = p.j LEFT JOIN shared s ON s.i = p.i AND s.j = p.j"
)
def pair_wl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances of colour histograms after one refinement, query records against all."""
    colours = hg.refine(event_incidence(spark, sf_dir), 1)
    return distances.histogram_distances(colours, "hg", "colour").select("i", "j", F.col("l1").alias("wl_l1"), F.round("chi2", 6).alias("wl_chi2"))


@query(
    f"WITH {EVENT_SQL}, deg AS (SELECT hg, list(d ORDER BY d DESC) AS ds FROM (SELECT hg, count(*) AS d FROM inc GROUP BY hg, v) GROUP BY hg) "
    "SELECT a.hg AS i, b.hg AS j, CAST(list_sum(list_transform(range(1, greatest(len(a.ds), len(b.ds)) + 1), lambda k: abs(coalesce(a.ds[k], 0) - coalesce(b.ds[k], 0)))) AS BIGINT) AS l1 FROM deg a JOIN deg b ON a.hg <> b.hg WHERE a.hg % 100 = 0"
)
def pair_degree_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distance of sorted degrees, padded with zeros."""
    seqs = hg.degree(event_incidence(spark, sf_dir)).groupBy("hg").agg(F.sort_array(F.collect_list("degree"), asc=False).alias("ds"))
    return distances.padded_l1(seqs, "hg", "ds").select("i", "j", "l1")


@query(
    "WITH g AS (SELECT source, count(*) AS n, count(*) FILTER (toxic = 1) AS k FROM documents JOIN labels USING (doc_id) GROUP BY source), t AS (SELECT sum(k)::DOUBLE / sum(n) AS p FROM g), "
    "z AS (SELECT source, exp(-abs(k::DOUBLE / n - p) / sqrt(p * (1 - p) / n)) AS p FROM g, t), r AS (SELECT *, row_number() OVER (ORDER BY p, source) AS rank, count(*) OVER () AS m FROM z) "
    "SELECT source, round(p, 6) AS p, rank::INT AS rank, round(max(least(1.0::DOUBLE, (m - rank + 1) * p)) OVER (ORDER BY p, source ROWS UNBOUNDED PRECEDING), 6) AS adjusted FROM r"
)
def holm_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tail scores of each source's share of toxic documents against the whole, corrected for the number of sources."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    g = table(spark, sf_dir, "documents").select("doc_id", "source").join(labels, "doc_id").groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("toxic") == 1).alias("k"))
    whole = F.broadcast(g.agg((F.sum("k") / F.sum("n")).alias("q")))
    score = F.exp(-F.abs(F.col("k") / F.col("n") - F.col("q")) / F.sqrt(F.col("q") * (1 - F.col("q")) / F.col("n")))
    return st.holm(g.join(whole).select("source", score.alias("p")), "source", "p").select("source", F.round("p", 6).alias("p"), "rank", F.round("adjusted", 6).alias("adjusted"))


@query(
    "WITH d AS (SELECT c.c_custkey, round(c_acctbal - 4500, 2) AS gap FROM customer c), r AS (SELECT gap, rank() OVER (ORDER BY abs(gap)) + (count(*) OVER (PARTITION BY abs(gap)) - 1) / 2.0::DOUBLE AS r FROM d WHERE gap <> 0), "
    "s AS (SELECT count(*) AS n, sum(r) FILTER (gap > 0) AS plus, sum(r) FILTER (gap < 0) AS minus FROM r) SELECT n, plus, minus, round((plus - minus) / (plus + minus), 6) AS biserial FROM s"
)
def signed_rank_stat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signed ranks of account balances around 4,500."""
    gaps = table(spark, sf_dir, "customer").select(F.round(F.col("c_acctbal") - 4500, 2).alias("gap"))
    return st.signed_ranks(gaps, "gap").withColumn("biserial", F.round("biserial", 6))


@query(
    "WITH d AS (SELECT user_id, date_trunc('day', ts) AS day, count(*) AS n FROM events GROUP BY ALL), s AS (SELECT user_id, n - lag(n) OVER (PARTITION BY user_id ORDER BY day) AS step FROM d) "
    "SELECT user_id, count(*) AS steps, round(avg((step > 0)::INT), 6) AS share FROM s WHERE step IS NOT NULL GROUP BY user_id"
)
def monotone_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = table(spark, sf_dir, "events").groupBy("user_id", F.date_trunc("day", "ts").alias("day")).agg(F.count("*").alias("n"))
    return st.monotone_share(days, "user_id", "day", "n").withColumn("share", F.round("share", 6))


@query(
    "WITH q AS (SELECT event_type, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events GROUP BY event_type) "
    "SELECT e.event_type AS type, round(any_value(q1), 6) AS q1, round(any_value(q3), 6) AS q3, round(avg((value > q3 + 1.5 * (q3 - q1))::INT), 6) AS share FROM events e JOIN q USING (event_type) GROUP BY e.event_type"
)
def heavy_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("type"), "value")
    return st.heavy_tail(rows, "type", "value").select("type", F.round("q1", 6).alias("q1"), F.round("q3", 6).alias("q3"), F.round("share", 6).alias("share"))


@query(
    f"WITH {CUSTOMER_SQL}, s AS (SELECT hg, count(DISTINCT e) AS m, count(*) AS i FROM inc GROUP BY hg) "
    "SELECT round(regr_slope(log10(i), log10(m)), 6) AS slope, round(regr_intercept(log10(i), log10(m)), 6) AS intercept, round(regr_r2(log10(i), log10(m)), 6) AS r2 FROM s"
)
def power_law_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How incidences grow with facts over the knowledge bases."""
    sizes = customer_incidence(spark, sf_dir).groupBy("hg").agg(F.countDistinct("e").alias("m"), F.count("*").alias("i"))
    return st.power_law(sizes, "m", "i").select(*[F.round(c, 6).alias(c) for c in ("slope", "intercept", "r2")])


@query(
    "WITH d AS (SELECT l_quantity AS x, l_extendedprice AS y FROM lineitem), e AS (SELECT min(x) AS lx, max(x) AS hx, min(y) AS ly, max(y) AS hy FROM d), "
    "b AS (SELECT least(floor((x - lx) / ((hx - lx) / 20)), 19) AS i, least(floor((y - ly) / ((hy - ly) / 20)), 19) AS j FROM d, e), c AS (SELECT i, j, count(*)::DOUBLE AS n FROM b GROUP BY ALL), "
    "m AS (SELECT *, sum(n) OVER (PARTITION BY i) AS ni, sum(n) OVER (PARTITION BY j) AS nj, sum(n) OVER () AS t FROM c) SELECT round(sum(n / t * log2(n * t / (ni * nj))), 6) AS bits FROM m"
)
def mi_binned(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_quantity").alias("x"), F.col("l_extendedprice").alias("y"))
    return st.binned_information(rows, "x", "y", 20).select(F.round("bits", 6).alias("bits"))


@query(
    "WITH d AS (SELECT event_type, event_id, value, unnest(range(1, 101)) AS draw FROM events), u AS (SELECT *, ('0x' || substr(md5(event_id || '|' || draw || '|7'), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM d), "
    "w AS (SELECT event_type, draw, value, (u >= 0.36787944)::INT + (u >= 0.73575888)::INT + (u >= 0.91969860)::INT + (u >= 0.98101184)::INT + (u >= 0.99634015)::INT + (u >= 0.99940582)::INT AS w FROM u), "
    "m AS (SELECT event_type, draw, sum(w * value) / sum(w) AS m FROM w GROUP BY ALL), q AS (SELECT event_type, quantile_cont(m, 0.025) AS low, quantile_cont(m, 0.975) AS high FROM m GROUP BY event_type) "
    "SELECT event_type, round(avg(value), 6) AS mean, round(any_value(low), 6) AS low, round(any_value(high), 6) AS high FROM events JOIN q USING (event_type) GROUP BY event_type"
)
def bootstrap_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resampled interval of the mean value of each kind of event."""
    found = st.bootstrap_mean(table(spark, sf_dir, "events").select("event_type", "value", "event_id"), "event_type", "value", "event_id", 100, 7)
    return found.select("event_type", *[F.round(c, 6).alias(c) for c in ("mean", "low", "high")])


@query(
    "SELECT vec_id, label, CAST((row_number() OVER (PARTITION BY label ORDER BY ('0x' || substr(md5(vec_id || '|3'), 1, 8))::BIGINT, vec_id) - 1) % 5 AS INT) AS fold FROM embeddings"
)
def stratified_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.folds(table(spark, sf_dir, "embeddings").select("vec_id", "label"), "vec_id", "label", 5, 3)


DROP_SQL = (
    f"{CUSTOMER_SQL}, f AS (SELECT DISTINCT hg, e FROM inc), pick AS (SELECT hg, e FROM (SELECT hg, e, count(*) OVER (PARTITION BY hg) AS m, "
    "row_number() OVER (PARTITION BY hg ORDER BY ('0x' || substr(md5(hg || '|' || e || '|11'), 1, 8))::BIGINT, e) AS r FROM f) WHERE r = 1 AND m > 1)"
)


@query(f"WITH {DROP_SQL} SELECT i.hg, i.e, i.v FROM inc i LEFT JOIN pick p ON p.hg = i.hg AND p.e = i.e WHERE p.e IS NULL")
def corrupt_missing_fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record without one fact that a seeded digest picks; records of a single fact stay whole."""
    return edits.drop_picked_facts(customer_incidence(spark, sf_dir), 11)


@query(
    f"WITH {DROP_SQL}, m AS (SELECT i.hg, i.e, i.v FROM inc i JOIN pick p ON p.hg = i.hg AND p.e = i.e), o AS (SELECT hg, e, v FROM (SELECT *, row_number() OVER (PARTITION BY hg ORDER BY ('0x' || substr(md5(hg || '|' || v || '|12'), 1, 8))::BIGINT, v) AS r FROM m) WHERE r = 1), "
    "c AS (SELECT DISTINCT i.hg, i.v FROM inc i JOIN pick p ON p.hg = i.hg LEFT JOIN m ON m.hg = i.hg AND m.v = i.v WHERE m.v IS NULL), n AS (SELECT hg, v AS w FROM (SELECT *, row_number() OVER (PARTITION BY hg ORDER BY ('0x' || substr(md5(hg || '|' || v || '|13'), 1, 8))::BIGINT, v) AS r FROM c) WHERE r = 1) "
    "SELECT i.hg, i.e, CASE WHEN o.v IS NOT NULL AND n.w IS NOT NULL THEN n.w ELSE i.v END AS v FROM inc i LEFT JOIN o ON o.hg = i.hg AND o.e = i.e AND o.v = i.v LEFT JOIN n ON n.hg = i.hg"
)
def corrupt_wrong_argument(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record with one constant of one fact exchanged for another of its constants, all picked by seeded digests."""
    return edits.exchange_picked_argument(customer_incidence(spark, sf_dir), 11)


VERDICT_SQL = (
    f"{EVENT_SQL}, a AS (SELECT hg, e, count(*) AS a FROM inc GROUP BY hg, e), reach AS (SELECT hg, min(v) AS v FROM inc GROUP BY hg UNION SELECT x.hg, y.v FROM reach r JOIN inc x ON x.hg = r.hg AND x.v = r.v JOIN inc y ON y.hg = x.hg AND y.e = x.e), "
    "n AS (SELECT hg, count(DISTINCT v) AS n FROM inc GROUP BY hg), k AS (SELECT hg, count(*) AS k FROM reach GROUP BY hg), s AS (SELECT hg, min(a) AS least, count(*) AS facts FROM a GROUP BY hg), "
    "u AS (SELECT hg, count(DISTINCT f) AS kept FROM (SELECT hg, string_agg(v, ',' ORDER BY v) AS f FROM inc GROUP BY hg, e) GROUP BY hg), "
    "verdict AS (SELECT hg, facts, kept, CASE WHEN least < 2 THEN 'unary' WHEN k < n THEN 'disconnected' ELSE 'accepted' END AS verdict FROM s JOIN u USING (hg) JOIN n USING (hg) JOIN k USING (hg))"
)


@query(f"WITH RECURSIVE {VERDICT_SQL} SELECT hg, facts, kept, verdict FROM verdict")
def record_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which records are accepted, or why not, and how many facts stay without repetitions."""
    return edits.verdicts(event_incidence(spark, sf_dir))


@query(
    "WITH f AS (SELECT page_id, string_split(regexp_replace(url, '^[a-z]+://', ''), '/') AS p FROM pages) "
    "SELECT page_id, p[1] AS subject, CASE WHEN len(p) > 1 THEN p[2] END AS relation, CAST(len(p) AS INT) AS fields, array_to_string(list_filter(p[3:], lambda x, i: i % 2 = 1), ',') AS members, array_to_string(list_filter(p[3:], lambda x, i: i % 2 = 0), ',') AS qualifiers FROM f"
)
def statements_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements of variable width, here the parts of page addresses: subject, relation, then values and qualifiers in turn."""
    lines = table(spark, sf_dir, "pages").select("page_id", F.regexp_replace("url", "^[a-z]+://", "").alias("line"))
    found = formats.statements(lines, "line", "/")
    text = lambda c: F.array_join(c, ",").alias(c)
    return found.select("page_id", "subject", "relation", "fields", text("members"), text("qualifiers"))


@query(
    "SELECT o_custkey AS hg, count(*) AS facts, sum(n)::BIGINT AS incidences FROM (SELECT o_custkey, o_orderkey, count(DISTINCT l_partkey) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL) GROUP BY o_custkey"
)
def json_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records written as JSON text and read again."""
    nested = formats.nest(customer_incidence(spark, sf_dir))
    back = formats.from_json(formats.to_json(nested))
    sizes = F.aggregate("facts", F.lit(0).cast("long"), lambda done, f: done + F.size(f["members"]))
    return back.select("hg", F.size("facts").cast("long").alias("facts"), sizes.alias("incidences"))
