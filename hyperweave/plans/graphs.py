"""Queries over incidence tables: records, neighbourhoods, components, colours and patterns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..operators import hypergraph as hg, records
from ..sources.collections import CUSTOMER_SQL, EVENT_SQL, ORDER_SQL, customer_incidence, event_incidence, order_incidence, table
from .registry import query

#: Primal pairs and the closure of reachability within each hypergraph, for the oracles.
PRIMAL_SQL = "primal AS (SELECT DISTINCT a.hg, a.v, b.v AS w FROM inc a JOIN inc b ON a.hg = b.hg AND a.e = b.e AND a.v <> b.v)"
REACH_SQL = (
    "reach(hg, v, w) AS (SELECT DISTINCT hg, v, v FROM inc UNION SELECT r.hg, r.v, p.w FROM reach r "
    "JOIN primal p ON p.hg = r.hg AND p.v = r.w)"
)
SHELL_SQL = (
    "walk(hg, v, w, d) AS (SELECT hg, v, w, 1 FROM primal UNION SELECT k.hg, k.v, p.w, k.d + 1 FROM walk k "
    "JOIN primal p ON p.hg = k.hg AND p.v = k.w WHERE k.d < 3), "
    "shell AS (SELECT hg, v, w, min(d) AS d FROM walk WHERE v <> w GROUP BY ALL)"
)


@query(f"WITH {ORDER_SQL}, a AS (SELECT e, count(*) AS arity FROM inc GROUP BY e) SELECT arity, count(*) AS facts FROM a GROUP BY arity")
def arity_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hg.arity(order_incidence(spark, sf_dir), ()).groupBy("arity").agg(F.count("*").alias("facts"))


@query(f"WITH {ORDER_SQL} SELECT v, count(*) AS degree FROM inc GROUP BY v")
def degree_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hg.degree(order_incidence(spark, sf_dir), ())


@query(
    f"WITH {ORDER_SQL}, p AS (SELECT DISTINCT a.v, b.v AS w FROM inc a JOIN inc b ON a.e = b.e AND a.v <> b.v) "
    "SELECT v, count(*) AS neighbours FROM p GROUP BY v"
)
def primal_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hg.primal(order_incidence(spark, sf_dir), ()).groupBy("v").agg(F.count("*").alias("neighbours"))


@query(
    f"WITH {ORDER_SQL}, p AS (SELECT DISTINCT a.v, b.v AS w FROM inc a JOIN inc b ON a.e = b.e AND a.v <> b.v) "
    "SELECT v, count(*) AS neighbours FROM p GROUP BY v ORDER BY neighbours DESC, v LIMIT 10"
)
def primal_degree_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return primal_degree(spark, sf_dir).orderBy(F.desc("neighbours"), "v").limit(10)


@query(
    f"WITH {ORDER_SQL}, top AS (SELECT v FROM inc GROUP BY v ORDER BY count(*) DESC, v LIMIT 1) "
    "SELECT e, v FROM inc WHERE e IN (SELECT e FROM inc JOIN top USING (v))"
)
def ego_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The facts around the constant of the largest degree."""
    inc = order_incidence(spark, sf_dir)
    top = hg.degree(inc, ()).orderBy(F.desc("degree"), "v").limit(1).select("v")
    return hg.ego(inc, top, ()).select("e", "v")


@query(
    f"WITH {ORDER_SQL} SELECT v, count(*) AS facts, min(e) AS first_fact, max(e) AS last_fact FROM inc GROUP BY v"
)
def incident_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    inc = order_incidence(spark, sf_dir)
    return inc.groupBy("v").agg(F.count("*").alias("facts"), F.min("e").alias("first_fact"), F.max("e").alias("last_fact"))


@query(
    f"WITH {CUSTOMER_SQL} SELECT a.hg, a.e AS e1, b.e AS e2, count(*) AS shared FROM inc a "
    "JOIN inc b ON a.hg = b.hg AND a.v = b.v AND a.e < b.e GROUP BY ALL"
)
def edge_overlap_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of a knowledge base that share constants, with how many."""
    inc = customer_incidence(spark, sf_dir)
    left, right = inc.select("hg", "v", F.col("e").alias("e1")), inc.select("hg", "v", F.col("e").alias("e2"))
    return left.join(right, ["hg", "v"]).where("e1 < e2").groupBy("hg", "e1", "e2").agg(F.count("*").alias("shared"))


@query(f"WITH RECURSIVE {CUSTOMER_SQL}, {PRIMAL_SQL}, {SHELL_SQL} SELECT hg, v, count(*) AS near FROM shell WHERE d <= 2 GROUP BY hg, v")
def neighbours_2hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hg.shells(customer_incidence(spark, sf_dir), 2).groupBy("hg", "v").agg(F.count("*").alias("near"))


XI_SQL = (
    f"WITH RECURSIVE {CUSTOMER_SQL}, {PRIMAL_SQL}, {SHELL_SQL}, xi AS (SELECT i.hg, i.v, count(s.w) FILTER (d = 1) AS x1, "
    "count(s.w) FILTER (d = 2) AS x2, count(s.w) FILTER (d = 3) AS x3 FROM (SELECT DISTINCT hg, v FROM inc) i "
    "LEFT JOIN shell s ON s.hg = i.hg AND s.v = i.v GROUP BY i.hg, i.v)"
)


@query(f"{XI_SQL} SELECT hg, v, x1, x2, x3 FROM xi")
def xi_shells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hg.xi(customer_incidence(spark, sf_dir), 3)


@query(f"{XI_SQL} SELECT i.hg, i.e, sum(x1)::BIGINT AS x1, sum(x2)::BIGINT AS x2, sum(x3)::BIGINT AS x3 FROM inc i JOIN xi USING (hg, v) GROUP BY i.hg, i.e")
def eta_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    inc = customer_incidence(spark, sf_dir)
    return hg.eta(inc, hg.xi(inc, 3))


@query(
    f"{XI_SQL}, best AS (SELECT hg, max(x1 * 1000000000000 + x2 * 1000000 + x3) AS k FROM xi GROUP BY hg) "
    "SELECT hg, v FROM xi JOIN best USING (hg) WHERE x1 * 1000000000000 + x2 * 1000000 + x3 = k"
)
def seed_max_xi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All constants that attain the largest shell sizes of their knowledge base, in lexical order."""
    shape = hg.xi(customer_incidence(spark, sf_dir), 3)
    best = shape.groupBy("hg").agg(F.max(F.struct("x1", "x2", "x3")).alias("best"))
    return shape.join(best, "hg").where(F.struct("x1", "x2", "x3") == F.col("best")).select("hg", "v")


@query(
    f"WITH {CUSTOMER_SQL}, {PRIMAL_SQL}, deg AS (SELECT hg, v, count(*) AS d FROM inc GROUP BY hg, v), "
    "near AS (SELECT p.hg, p.v, list(d.d ORDER BY d.d DESC) AS ds FROM primal p JOIN deg d ON d.hg = p.hg AND d.v = p.w GROUP BY p.hg, p.v), "
    "k AS (SELECT deg.hg, deg.v, d, coalesce(ds, []) AS ds FROM deg LEFT JOIN near USING (hg, v)) "
    "SELECT hg, v FROM (SELECT hg, v, rank() OVER (PARTITION BY hg ORDER BY d DESC, ds DESC) AS r FROM k) WHERE r = 1"
)
def seed_neighbour_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All constants of largest degree whose neighbours' sorted degrees are largest too."""
    inc = customer_incidence(spark, sf_dir)
    deg = hg.degree(inc)
    near = hg.primal(inc).join(deg.withColumnRenamed("v", "w"), ["hg", "w"])
    near = near.groupBy("hg", "v").agg(F.sort_array(F.collect_list("degree"), asc=False).alias("around"))
    key = F.struct("degree", F.coalesce("around", F.array().cast("array<bigint>")).alias("around"))
    keyed = deg.join(near, ["hg", "v"], "left").withColumn("key", key)
    best = keyed.groupBy("hg").agg(F.max("key").alias("best"))
    return keyed.join(best, "hg").where("key = best").select("hg", "v")


@query(
    f"WITH RECURSIVE {CUSTOMER_SQL}, {PRIMAL_SQL}, {REACH_SQL} SELECT hg, v, min(w) AS comp FROM reach GROUP BY hg, v"
)
def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hg.components(customer_incidence(spark, sf_dir)).select("hg", "v", "comp")


@query(
    f"WITH RECURSIVE {CUSTOMER_SQL}, {PRIMAL_SQL}, {REACH_SQL}, c AS (SELECT hg, v, min(w) AS comp FROM reach GROUP BY hg, v), "
    "s AS (SELECT hg, comp, count(*) AS size FROM c GROUP BY hg, comp) "
    "SELECT hg, count(*) AS parts, max(size) AS largest, count(*) = 1 AS connected FROM s GROUP BY hg"
)
def connectivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = hg.components(customer_incidence(spark, sf_dir)).groupBy("hg", "comp").agg(F.count("*").alias("size"))
    parts = F.count("*")
    return sizes.groupBy("hg").agg(parts.alias("parts"), F.max("size").alias("largest"), (parts == 1).alias("connected"))


WL_SQL = (
    "c1 AS (SELECT hg, v, list(a ORDER BY a) AS colour FROM (SELECT hg, v, e, pred || ':' || "
    "count(*) OVER (PARTITION BY hg, e) AS a FROM inc) GROUP BY hg, v)"
)


@query(
    f"WITH {CUSTOMER_SQL}, {WL_SQL} SELECT hg, count(*) AS constants, count(DISTINCT colour) AS colours FROM c1 GROUP BY hg"
)
def wl_round1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One round of colour refinement from equal colours."""
    now = hg.refine(customer_incidence(spark, sf_dir), 1)
    return now.groupBy("hg").agg(F.count("*").alias("constants"), F.countDistinct("colour").alias("colours"))


@query(
    f"WITH {CUSTOMER_SQL}, {WL_SQL}, f2 AS (SELECT i.hg, i.e, any_value(pred) AS pred, list(colour ORDER BY colour) AS m FROM inc i "
    "JOIN c1 USING (hg, v) GROUP BY i.hg, i.e), c2 AS (SELECT i.hg, i.v, any_value(c1.colour) AS old, "
    "list({'p': f2.pred, 'm': f2.m} ORDER BY f2.pred, f2.m) AS colour FROM inc i JOIN f2 USING (hg, e) JOIN c1 USING (hg, v) GROUP BY i.hg, i.v), "
    "g AS (SELECT hg, old, colour, count(*) AS size FROM c2 GROUP BY ALL) "
    "SELECT hg, count(*) AS classes, max(size) AS largest FROM g GROUP BY hg"
)
def wl_partition_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The classes of two rounds of colour refinement."""
    sizes = hg.refine(customer_incidence(spark, sf_dir), 2).groupBy("hg", "colour").agg(F.count("*").alias("size"))
    return sizes.groupBy("hg").agg(F.count("*").alias("classes"), F.max("size").alias("largest"))


@query(
    f"WITH {CUSTOMER_SQL} SELECT 'fact' AS side, pred AS label, count(DISTINCT e) AS size FROM inc GROUP BY pred UNION ALL "
    f"SELECT 'constant', p_type, count(DISTINCT v) FROM inc JOIN part ON v = p_partkey GROUP BY p_type"
)
def colour_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The colour classes of the incidence graph: facts by label, constants by type."""
    inc = customer_incidence(spark, sf_dir)
    facts = inc.groupBy(F.col("pred").alias("label")).agg(F.countDistinct("e").alias("size")).select(F.lit("fact").alias("side"), "label", "size")
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("v"), F.col("p_type").alias("label"))
    own = inc.select("v").distinct().join(parts, "v").groupBy("label").agg(F.count("*").alias("size"))
    return facts.union(own.select(F.lit("constant"), "label", "size"))


SHAPE_SQL = (
    "shape AS (SELECT hg, count(DISTINCT v) AS n, count(DISTINCT e) AS m, max(a) AS max_arity FROM "
    "(SELECT *, count(*) OVER (PARTITION BY hg, e) AS a FROM inc) GROUP BY hg)"
)


@query(f"WITH {CUSTOMER_SQL}, {SHAPE_SQL} SELECT hg, n, m, max_arity FROM shape WHERE n <= 24 AND m BETWEEN 3 AND 110 AND max_arity <= 10")
def envelope_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hg.admitted(hg.summary(customer_incidence(spark, sf_dir))).select("hg", "n", "m", "max_arity")


@query(f"WITH {CUSTOMER_SQL} SELECT hg, v, dense_rank() OVER (PARTITION BY hg ORDER BY v) - 1 AS new_v FROM (SELECT DISTINCT hg, v FROM inc)")
def compact_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hg.compact(customer_incidence(spark, sf_dir))


@query("SELECT kind, name, row_number() OVER (PARTITION BY kind ORDER BY name) - 1 AS id FROM (SELECT DISTINCT 'type' AS kind, p_type AS name FROM part UNION SELECT 'pred', o_orderpriority FROM orders)")
def vocabulary_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    types = table(spark, sf_dir, "part").select(F.lit("type").alias("kind"), F.col("p_type").alias("name"))
    preds = table(spark, sf_dir, "orders").select(F.lit("pred").alias("kind"), F.col("o_orderpriority").alias("name"))
    return records.vocabulary(types.union(preds))


@query(
    f"WITH {CUSTOMER_SQL}, {SHAPE_SQL}, q AS (SELECT p, CAST(round_even(p * (SELECT count(*) - 1 FROM shape), 0) AS BIGINT) AS pos FROM (VALUES (0.0), (0.25), (0.5), (0.75), (1.0)) t(p)), "
    "r AS (SELECT n, row_number() OVER (ORDER BY n, hg) - 1 AS pos FROM shape) SELECT CAST(p AS DOUBLE) AS p, n AS constants FROM q JOIN r USING (pos)"
)
def census_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantiles of the number of constants by nearest rank, from running counts of the distinct sizes."""
    sizes = hg.summary(customer_incidence(spark, sf_dir)).select("n")
    return records.nearest_rank(sizes, "n", [0.0, 0.25, 0.5, 0.75, 1.0]).select("p", F.col("n").alias("constants"))


@query(
    "WITH c AS (SELECT p_type AS label, count(*) AS members FROM part GROUP BY p_type) "
    "SELECT label, members, members >= 20 AS frequent, round(members / (SELECT sum(members) FROM c), 6) AS share FROM c"
)
def label_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "part").groupBy(F.col("p_type").alias("label")).agg(F.count("*").alias("members"))
    total = counts.agg(F.sum("members").alias("total"))
    share = F.round(F.col("members") / F.col("total"), 6)
    # The total is one row.
    return counts.join(F.broadcast(total)).select("label", "members", (F.col("members") >= 20).alias("frequent"), share.alias("share"))


KEY_SQL = (
    "facts AS (SELECT hg, e, string_agg(v, ',' ORDER BY v) AS f FROM inc GROUP BY hg, e), "
    "kb AS (SELECT hg, string_agg(f, ';' ORDER BY f) AS k FROM (SELECT DISTINCT hg, f FROM facts) GROUP BY hg)"
)


@query(f"WITH {EVENT_SQL}, {KEY_SQL} SELECT min(hg) AS first_hg, count(*) AS members, k AS facts FROM kb GROUP BY k")
def identity_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Knowledge bases with the same set of facts."""
    keyed = records.fact_keys(event_incidence(spark, sf_dir))
    return keyed.groupBy(F.col("key").alias("facts")).agg(F.min("hg").alias("first_hg"), F.count("*").alias("members"))


INVARIANT_SQL = (
    "deg AS (SELECT hg, string_agg(d, ',' ORDER BY d) AS ds FROM (SELECT hg, count(*) AS d FROM inc GROUP BY hg, v) GROUP BY hg), "
    "ar AS (SELECT hg, string_agg(a, ',' ORDER BY a) AS arities FROM (SELECT hg, count(*) AS a FROM inc GROUP BY hg, e) GROUP BY hg), "
    "inv AS (SELECT hg, ds || '/' || arities AS k FROM deg JOIN ar USING (hg))"
)


@query(f"WITH {EVENT_SQL}, {INVARIANT_SQL} SELECT k AS invariant, count(*) AS members, min(hg) AS first_hg FROM inv GROUP BY k")
def invariant_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes by sorted degrees and arities, which isomorphic hypergraphs share."""
    return records.invariants(event_incidence(spark, sf_dir)).groupBy("invariant").agg(
        F.count("*").alias("members"), F.min("hg").alias("first_hg")
    )


@query(
    f"WITH {EVENT_SQL}, {KEY_SQL}, {INVARIANT_SQL}, j AS (SELECT inv.k AS i, kb.k AS f, count(*) AS n FROM inv JOIN kb USING (hg) GROUP BY ALL), "
    "t AS (SELECT i, sum(n) AS n, sum(n * n) AS sq FROM j GROUP BY i) "
    "SELECT i AS invariant, CAST(n AS BIGINT) AS members, CAST((n * n - sq) / 2 AS BIGINT) AS merged_pairs FROM t"
)
def false_merge_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each invariant the pairs of members with different facts, counted from class sizes, not from pairs."""
    inc = event_incidence(spark, sf_dir)
    both = records.invariants(inc).join(records.fact_keys(inc), "hg").groupBy("invariant", "key").agg(F.count("*").alias("n"))
    sums = both.groupBy("invariant").agg(F.sum("n").alias("members"), F.sum(F.col("n") * F.col("n")).alias("squares"))
    return sums.select("invariant", "members", ((F.col("members") * F.col("members") - F.col("squares")) / 2).cast("long").alias("merged_pairs"))


@query(
    f"WITH {EVENT_SQL}, {KEY_SQL}, own AS (SELECT k, min(hg) AS hg, count(*) AS members FROM kb GROUP BY k), "
    "fs AS (SELECT k, unnest(string_split(k, ';')) AS f FROM own), "
    "down AS (SELECT a.k, coalesce((SELECT string_agg(b.f, ';' ORDER BY b.f) FROM fs b WHERE b.k = a.k AND b.f <> a.f), '') AS less FROM fs a) "
    "SELECT x.hg AS larger, y.hg AS smaller, x.members * y.members AS pairs FROM down d JOIN own x ON x.k = d.k JOIN own y ON y.k = d.less"
)
def one_fact_apart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of knowledge bases that differ by one fact: each key's one-deletion keys meet the other keys."""
    keyed = records.fact_keys(event_incidence(spark, sf_dir))
    own = keyed.groupBy("key").agg(F.min("hg").alias("hg"), F.count("*").alias("members"))
    down = own.select(F.col("hg").alias("larger"), F.col("members").alias("x"), F.split("key", ";").alias("facts"))
    down = down.select("larger", "x", F.explode(F.transform("facts", lambda f: F.array_join(F.array_remove(F.col("facts"), f), ";"))).alias("key"))
    return down.join(own, "key").select("larger", F.col("hg").alias("smaller"), (F.col("x") * F.col("members")).alias("pairs"))


@query(
    f"WITH {CUSTOMER_SQL}, f AS (SELECT DISTINCT hg, pred, e FROM inc) SELECT pred AS pattern, count(*) AS frequency, count(DISTINCT hg) AS records FROM f GROUP BY pred"
)
def pattern_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = customer_incidence(spark, sf_dir).select("hg", "pred", "e").distinct()
    return facts.groupBy(F.col("pred").alias("pattern")).agg(F.count("*").alias("frequency"), F.countDistinct("hg").alias("records"))


@query(
    f"WITH {CUSTOMER_SQL}, f AS (SELECT DISTINCT hg, pred FROM inc) SELECT a.pred AS pattern, b.pred AS other, count(*) AS together "
    "FROM f a JOIN f b ON a.hg = b.hg AND a.pred < b.pred GROUP BY ALL ORDER BY together DESC, pattern, other LIMIT 5"
)
def pattern_cooccurrence_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs of labels that most knowledge bases hold together; a record holds a label of five at most once."""
    return records.cooccurrence(customer_incidence(spark, sf_dir).select("hg", F.col("pred").alias("pattern"))).orderBy(
        F.desc("together"), "pattern", "other"
    ).limit(5)


@query(
    f"WITH {EVENT_SQL}, d AS (SELECT user_id, count(DISTINCT day) AS days FROM inc GROUP BY user_id), "
    "a AS (SELECT user_id, v, count(DISTINCT day) AS on_days FROM inc GROUP BY user_id, v) "
    "SELECT user_id, v, on_days, days FROM a JOIN d USING (user_id) WHERE 2 * on_days > days"
)
def majority_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What strictly more than half of a user's days assert."""
    inc = event_incidence(spark, sf_dir)
    return records.majority(inc.select("user_id", "day", "v"), "user_id", "day", "v").select(
        "user_id", "v", F.col("asserted").alias("on_days"), F.col("members").alias("days")
    )


@query(
    f"WITH {CUSTOMER_SQL}, c AS (SELECT hg, p_type, count(*) AS n FROM (SELECT DISTINCT hg, v FROM inc) JOIN part ON v = p_partkey GROUP BY ALL) "
    "SELECT hg, p_type AS type FROM (SELECT *, row_number() OVER (PARTITION BY hg ORDER BY n DESC, p_type) AS r FROM c) WHERE r = 1"
)
def majority_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most frequent type among each knowledge base's constants, ties to the smallest."""
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("v"), F.col("p_type").alias("type"))
    counts = customer_incidence(spark, sf_dir).select("hg", "v").distinct().join(parts, "v").groupBy("hg", "type").agg(F.count("*").alias("n"))
    return counts.groupBy("hg").agg(F.min(F.struct((-F.col("n")).alias("n"), "type")).alias("best")).select("hg", "best.type")


@query(
    f"WITH {CUSTOMER_SQL}, deg AS (SELECT hg, v, count(*) AS d FROM inc GROUP BY hg, v), m AS (SELECT hg, count(DISTINCT e) AS m FROM inc GROUP BY hg), "
    "s AS (SELECT hg, bool_or(d = m) AND count(*) FILTER (d >= 2) <= 1 AS star FROM deg JOIN m USING (hg) WHERE m >= 2 GROUP BY hg) "
    "SELECT star, count(*) AS records FROM s GROUP BY star"
)
def star_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records where one constant is in every fact and no other is in two."""
    inc = customer_incidence(spark, sf_dir)
    facts = hg.arity(inc).groupBy("hg").agg(F.count("*").alias("m")).where("m >= 2")
    star = hg.degree(inc).join(facts, "hg").groupBy("hg").agg(
        (F.bool_or(F.col("degree") == F.col("m")) & (F.count_if(F.col("degree") >= 2) <= 1)).alias("star")
    )
    return star.groupBy("star").agg(F.count("*").alias("records"))


@query(f"WITH {CUSTOMER_SQL}, p AS (SELECT hg, v, e, row_number() OVER (PARTITION BY hg, e ORDER BY v) - 1 AS role FROM inc) SELECT hg, e, role, v FROM p")
def roles_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of each constant in its fact, by the order of ids."""
    order = Window.partitionBy("hg", "e").orderBy("v")
    return customer_incidence(spark, sf_dir).select("hg", "e", (F.row_number().over(order) - 1).alias("role"), "v")
