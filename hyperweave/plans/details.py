"""Queries over keys, alphabets, votes and merges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import cluster, hypergraph as hg, keys, models, sequences as seq
from ..sources.collections import CUSTOMER_SQL, EVENT_SQL, customer_incidence, event_incidence, table
from .graphs import PRIMAL_SQL, REACH_SQL
from .registry import query
from .sequences import BIGRAM_SQL

LOCAL_SQL = (
    "k AS (SELECT hg, v, string_agg(pred || ':' || a, ',' ORDER BY pred || ':' || a) AS key FROM (SELECT *, count(*) OVER (PARTITION BY hg, e) AS a FROM inc) GROUP BY hg, v)"
)


@query(f"WITH {CUSTOMER_SQL}, {LOCAL_SQL} SELECT hg, v, key FROM k")
def local_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keys.local_keys(customer_incidence(spark, sf_dir))


@query(f"WITH {CUSTOMER_SQL}, {LOCAL_SQL} SELECT hg, v, key, CAST(row_number() OVER (PARTITION BY hg, key ORDER BY v) - 1 AS INT) AS place FROM k")
def fact_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keys.addresses(keys.local_keys(customer_incidence(spark, sf_dir)))


ROOT_SQL = "root AS (SELECT hg, v AS root, d AS degree FROM (SELECT hg, v, count(*) AS d, row_number() OVER (PARTITION BY hg ORDER BY count(*) DESC, v) AS r FROM inc GROUP BY hg, v) WHERE r = 1)"


@query(f"WITH {CUSTOMER_SQL}, {ROOT_SQL} SELECT hg, root, degree FROM root")
def root_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keys.root(customer_incidence(spark, sf_dir))


@query(
    f"WITH {CUSTOMER_SQL}, {ROOT_SQL}, o AS (SELECT i.hg, e, v, count(*) OVER (PARTITION BY i.hg, v) AS n FROM inc i JOIN root ON root.hg = i.hg AND v <> root) SELECT DISTINCT hg, e FROM o WHERE n > 1"
)
def interior_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keys.interior_facts(customer_incidence(spark, sf_dir))


@query(
    f"WITH RECURSIVE {CUSTOMER_SQL}, {PRIMAL_SQL}, {REACH_SQL}, c AS (SELECT hg, v, min(w) AS comp FROM reach GROUP BY hg, v), s AS (SELECT hg, comp, row_number() OVER (PARTITION BY hg ORDER BY count(*) DESC, comp) AS r FROM c GROUP BY hg, comp) "
    "SELECT i.hg, i.e, i.v, i.pred FROM inc i JOIN c USING (hg, v) JOIN s ON s.hg = c.hg AND s.comp = c.comp AND r = 1"
)
def largest_component(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keys.largest_component(customer_incidence(spark, sf_dir)).select("hg", "e", "v", "pred")


@query("SELECT p_type AS type, times, CAST(row_number() OVER (ORDER BY times DESC, p_type) - 1 AS INT) AS id FROM (SELECT p_type, count(*) AS times FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_type)")
def frequency_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("k"))
    types = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.col("p_type").alias("type"))
    return keys.frequency_ids(lines.join(types, "k").select("type"), "type")


@query(
    f"WITH {CUSTOMER_SQL}, a AS (SELECT hg, e, count(*) AS a FROM inc GROUP BY hg, e), s AS (SELECT hg, count(*) AS m, max(a) AS top, sum(a) AS i FROM a GROUP BY hg), n AS (SELECT hg, count(DISTINCT v) AS n FROM inc GROUP BY hg) "
    "SELECT hg, round(i * log2(n) + m * log2(top + 1), 6) AS bits FROM s JOIN n USING (hg)"
)
def incidence_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keys.code_bits(customer_incidence(spark, sf_dir)).select("hg", F.round("bits", 6).alias("bits"))


@query(
    "WITH i AS (SELECT user_id AS grp, CAST(ts AS DATE) AS member, event_type AS pattern FROM events), m AS (SELECT grp, count(DISTINCT member) AS members FROM i GROUP BY grp), c AS (SELECT grp, member, pattern, count(*) AS c FROM i GROUP BY ALL), "
    "t AS (SELECT a.grp, a.pattern, x.c, count(*) AS have FROM c a JOIN (SELECT DISTINCT grp, pattern, c FROM c) x ON x.grp = a.grp AND x.pattern = a.pattern AND a.c >= x.c GROUP BY ALL) "
    "SELECT grp, pattern, max(c) AS copies FROM t JOIN m USING (grp) WHERE 2 * have > members GROUP BY grp, pattern"
)
def pattern_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many events of a kind most of a user's days have."""
    items = table(spark, sf_dir, "events").select(F.col("user_id").alias("grp"), F.to_date("ts").alias("member"), F.col("event_type").alias("pattern"))
    return keys.pattern_vote(items)


@query("SELECT o_custkey AS key, o_orderpriority AS pref, o_orderkey AS id FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority, o_orderkey) AS r FROM orders) WHERE r = 1")
def merge_by_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One order for each customer, by priority and then by number."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderpriority").alias("pref"), F.col("o_orderkey").alias("id"))
    return keys.prefer(rows, ["key"], ["pref", "id"])


@query("SELECT event_type AS type, count(*) AS rows, count(*) - count(DISTINCT (user_id, date_trunc('hour', ts))) AS repeated FROM events GROUP BY event_type")
def audit_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that share an observation key: user and hour."""
    rows = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("type"), "user_id", F.date_trunc("hour", "ts").alias("hour")).agg(F.count("*").alias("n"))
    return rows.groupBy("type").agg(F.sum("n").alias("rows"), (F.sum("n") - F.count("*")).alias("repeated"))


@query(
    f"WITH {BIGRAM_SQL}, a AS (SELECT first, sum(times) AS total, count(*) AS kinds FROM g GROUP BY first), c AS (SELECT last, count(*) AS l FROM g GROUP BY last), k AS (SELECT sum(l) AS k FROM c), "
    "p AS (SELECT first, last, greatest(times - 0.75::DOUBLE, 0) / total + 0.75::DOUBLE * kinds / total * (l / k) AS p FROM g JOIN a USING (first) JOIN c USING (last), k), "
    "s AS (SELECT seq, token AS first, lead(token) OVER (PARTITION BY seq ORDER BY pos) AS last FROM t) SELECT seq, round(sum(ln(p)), 6) AS logp, count(*) AS steps FROM s JOIN p USING (first, last) GROUP BY seq"
)
def sequence_logprob(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-probability of each conversation's roles under the bigram model."""
    roles = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("seq"), F.col("turn").alias("pos"), F.col("role").alias("token"))
    bigrams = seq.ngrams(roles, 2)
    return models.log_probabilities(bigrams, seq.kneser_ney(bigrams)).select("seq", F.round("logp", 6).alias("logp"), "steps")


@query(
    f"WITH {EVENT_SQL}, f AS (SELECT DISTINCT hg, e FROM inc), m AS (SELECT hg, count(*) AS m FROM f GROUP BY hg) "
    "SELECT CASE WHEN m <= 3 THEN '0-3' WHEN m <= 5 THEN '4-5' WHEN m <= 8 THEN '6-8' WHEN m <= 12 THEN '9-12' ELSE '13-' END AS bin, count(*) AS records FROM m GROUP BY bin"
)
def fact_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = event_incidence(spark, sf_dir).select("hg", "e").distinct().groupBy("hg").agg(F.count("*").alias("m"))
    m = F.col("m")
    name = F.when(m <= 3, "0-3").when(m <= 5, "4-5").when(m <= 8, "6-8").when(m <= 12, "9-12").otherwise("13-")
    return sizes.groupBy(name.alias("bin")).agg(F.count("*").alias("records"))


@query(
    f"WITH {CUSTOMER_SQL}, d AS (SELECT hg, v, count(*) AS d FROM inc GROUP BY hg, v), t AS (SELECT p_partkey AS v, p_type AS type FROM part), {PRIMAL_SQL} "
    "SELECT p.hg, p.v, t.type, count(*) AS near FROM primal p JOIN t ON t.v = p.w GROUP BY ALL"
)
def xi_labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours of each constant by their type."""
    types = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("w"), F.col("p_type").alias("type"))
    return hg.primal(customer_incidence(spark, sf_dir)).join(types, "w").groupBy("hg", "v", "type").agg(F.count("*").alias("near"))


@query(
    "WITH d AS (SELECT a.vec_id, a.label AS i, list_sum(list_transform(list_zip(a.embedding, b.c), lambda p: (p[1]::DOUBLE - p[2]) ** 2)) AS r FROM embeddings a JOIN "
    "(SELECT label, list(c ORDER BY k) AS c FROM (SELECT label, u.k, avg(u.x) AS c FROM embeddings, LATERAL (SELECT unnest(range(len(embedding))) AS k, unnest(embedding)::DOUBLE AS x) u GROUP BY label, u.k) GROUP BY label) b USING (label)) "
    "SELECT i AS label, count(*) AS members, round(sum(r) / count(*), 6) AS inertia FROM d GROUP BY i"
)
def cluster_inertia(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean squared distance to each label's centroid, as half of the mean squared distance within it."""
    costs = cluster.mean_costs(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", "label").where("own = label")
    return costs.groupBy("label").agg(F.count("*").alias("members"), F.round(F.avg("mean") / 2, 6).alias("inertia"))
