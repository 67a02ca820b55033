"""Queries over distances and scores: neighbours, hubness, outliers, clusterings, association and agreement."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.state import cut
from ..operators import agreement, cluster, distances, neighbours as nb, records
from ..sources.collections import EVENT_SQL, event_incidence, table
from .registry import query

#: Query rows (ids divisible by 100) against all others, by Euclidean distance over the first DIMS components.
DIST_SQL = (
    "dist AS (SELECT q.vec_id AS i, x.vec_id AS j, q.label AS li, x.label AS lj, "
    "sqrt(list_sum(list_transform(list_zip(q.embedding, x.embedding), lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) ** 2))) AS d, "
    "sqrt(list_sum(list_transform(list_zip(q.embedding[1:32], x.embedding[1:32]), lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) ** 2))) AS h "
    "FROM embeddings q JOIN embeddings x ON q.vec_id <> x.vec_id WHERE q.vec_id % 100 = 0)"
)
NEAR_SQL = f"{DIST_SQL}, near AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY d, j) AS r FROM dist)"


def _dist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nb.query_distances(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", "label")


def _near(spark: SparkSession, sf_dir: str, k: int, kind: str = "") -> DataFrame:
    return nb.near_distances(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", "label", k, kind)


@query(f"WITH {NEAR_SQL} SELECT i, j, r AS rank, round(d, 6) AS d FROM near WHERE r <= 10")
def knn_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nb.nearest(_near(spark, sf_dir, 10), 10).select("i", "j", "rank", F.round("d", 6).alias("d"))


@query(f"WITH {NEAR_SQL} SELECT i, round(avg(d), 6) AS score FROM near WHERE r <= 5 GROUP BY i")
def knn_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nb.nearest(_near(spark, sf_dir, 5), 5).groupBy("i").agg(F.round(F.avg("d"), 6).alias("score"))


K_OCC_SQL = f"{NEAR_SQL}, occ AS (SELECT e.vec_id AS j, count(n.i) AS times FROM embeddings e LEFT JOIN near n ON n.j = e.vec_id AND n.r <= 10 GROUP BY e.vec_id)"


@query(f"WITH {K_OCC_SQL} SELECT j, times FROM occ")
def k_occurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("j"))
    return nb.occurrences(nb.nearest(_near(spark, sf_dir, 10), 10), ids)


@query(
    f"WITH {K_OCC_SQL}, m AS (SELECT avg(times) AS mu, max(times) AS most FROM occ) SELECT most, "
    "round(coalesce(avg((times - mu) ** 3) / nullif(avg((times - mu) ** 2) ** 1.5, 0), 0), 6) AS skew FROM occ, m GROUP BY most"
)
def hubness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Largest count and population skewness of how often a vector is near."""
    return k_occurrence(spark, sf_dir).agg(F.max("times").alias("most"), F.round(F.coalesce(F.skewness("times"), F.lit(0.0)), 6).alias("skew"))


@query(f"WITH {DIST_SQL} SELECT i, round(min(d) FILTER (li = lj), 6) AS same, round(min(d) FILTER (li <> lj), 6) AS other FROM dist GROUP BY i")
def nearest_same_other(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _near(spark, sf_dir, 1, "label")
    same, other = (F.min(F.when(c, F.col("d"))) for c in (F.col("li") == F.col("lj"), F.col("li") != F.col("lj")))
    return d.groupBy("i").agg(F.round(same, 6).alias("same"), F.round(other, 6).alias("other"))


@query(
    f"WITH {DIST_SQL}, b AS (SELECT i, min(d) AS d FROM dist GROUP BY i) "
    "SELECT dist.i, round(avg((li = lj)::INT), 6) AS p_true FROM dist JOIN b ON b.i = dist.i AND b.d = dist.d GROUP BY dist.i"
)
def loo_nearest_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chance that a nearest other vector, drawn evenly among ties, has the query's label."""
    d = cut(_near(spark, sf_dir, 1))
    best = d.groupBy(F.col("i").alias("q")).agg(F.min("d").alias("best"))
    hit = (F.col("li") == F.col("lj")).cast("int")
    return d.join(best, (d.i == best.q) & (d.d == best.best)).groupBy("i").agg(F.round(F.avg(hit), 6).alias("p_true"))


@query(
    f"WITH {DIST_SQL}, b AS (SELECT i, min(d) AS best FROM dist WHERE li = lj GROUP BY i), "
    "r AS (SELECT b.i, 1 + count(*) FILTER (d < best) + (count(*) FILTER (d = best) - count(*) FILTER (d = best AND li = lj)) / (count(*) FILTER (d = best AND li = lj) + 1.0::DOUBLE) AS rank "
    "FROM dist JOIN b ON b.i = dist.i GROUP BY b.i) SELECT i, round(rank, 6) AS expected_rank, round(1 / rank, 6) AS reciprocal, rank <= 1 AS hit1, rank <= 10 AS hit10 FROM r"
)
def retrieval_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected rank of the first vector with the query's label, ties in random order."""
    return nb.first_hit(_dist(spark, sf_dir)).select(
        "i", F.round("rank", 6).alias("expected_rank"), F.round(1 / F.col("rank"), 6).alias("reciprocal"),
        (F.col("rank") <= 1).alias("hit1"), (F.col("rank") <= 10).alias("hit10"),
    )


@query(
    f"WITH {DIST_SQL}, g AS (SELECT i, d, count(*) AS n, count(*) FILTER (li = lj) AS pos FROM dist GROUP BY i, d), "
    "c AS (SELECT *, sum(n) OVER w AS seen, sum(pos) OVER w AS hits FROM g WINDOW w AS (PARTITION BY i ORDER BY d)) "
    "SELECT i, round(sum(pos * (hits::DOUBLE / seen)) / sum(pos), 6) AS ap FROM c GROUP BY i HAVING sum(pos) > 0"
)
def average_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nb.average_precision(_dist(spark, sf_dir)).select("i", F.round("ap", 6).alias("ap"))


@query(f"WITH {DIST_SQL} SELECT count(*) AS pairs, round(avg(d), 6) AS mean, round(avg(d) ** 2 / (2 * var_pop(d)), 6) AS intrinsic_dim, round(stddev_pop(d) / avg(d), 6) AS spread FROM dist")
def concentration(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("d")
    return _dist(spark, sf_dir).agg(
        F.count("*").alias("pairs"), F.round(F.avg(d), 6).alias("mean"),
        F.round(F.pow(F.avg(d), 2.0) / (2 * F.var_pop(d)), 6).alias("intrinsic_dim"), F.round(F.stddev_pop(d) / F.avg(d), 6).alias("spread"),
    )


@query(f"WITH {DIST_SQL} SELECT round(sqrt(sum((d - h) ** 2) / sum(d ** 2)), 6) AS stress, round(corr(d, h), 6) AS pearson FROM dist")
def kruskal_stress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the first half of the dimensions keeps the distances."""
    return _dist(spark, sf_dir).agg(
        F.round(F.sqrt(F.sum((F.col("d") - F.col("h")) ** 2) / F.sum(F.col("d") ** 2)), 6).alias("stress"), F.round(F.corr("d", "h"), 6).alias("pearson")
    )


@query(
    f"WITH {DIST_SQL}, r AS (SELECT rank() OVER (ORDER BY d) + (count(*) OVER (PARTITION BY d) - 1) / 2.0::DOUBLE AS x, "
    "rank() OVER (ORDER BY h) + (count(*) OVER (PARTITION BY h) - 1) / 2.0::DOUBLE AS y FROM dist) SELECT round(corr(x, y), 6) AS spearman FROM r"
)
def spearman_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agreement.spearman(cut(_dist(spark, sf_dir)), "d", "h").select(F.round("spearman", 6).alias("spearman"))


@query(
    f"WITH {DIST_SQL}, p AS (SELECT DISTINCT i FROM dist ORDER BY i LIMIT 3), "
    "b AS (SELECT a.i, x.j, max(abs(pq.d - px.d)) AS bound, any_value(x.d) AS d FROM dist x JOIN dist a ON a.i = x.i AND a.j = x.j "
    "JOIN p ON p.i <> x.i AND p.i <> x.j JOIN dist pq ON pq.i = p.i AND pq.j = x.i JOIN dist px ON px.i = p.i AND px.j = x.j GROUP BY a.i, x.j) "
    "SELECT count(*) AS pairs, count(*) FILTER (bound > d + 1e-9) AS violations, round(avg(bound / d), 6) AS tightness FROM b"
)
def pivot_lower_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bound that the first three query vectors, as pivots, put on every query distance."""
    found = nb.pivot_tightness(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", "label", 3)
    return found.select("pairs", "violations", F.round("tightness", 6).alias("tightness"))


UNIT_SQL = "e AS (SELECT vec_id AS id, label, u.k, u.x FROM embeddings, LATERAL (SELECT unnest(range(len(embedding))) AS k, unnest(embedding)::DOUBLE AS x) u)"
COST_SQL = (
    f"{UNIT_SQL}, s AS (SELECT label, k, sum(x) AS s FROM e GROUP BY label, k), q AS (SELECT id, label, sum(x * x) AS q FROM e GROUP BY id, label), "
    "n AS (SELECT label, count(*) AS n, sum(q) AS t FROM q GROUP BY label), dots AS (SELECT e.id, s.label, sum(e.x * s.s) AS dot FROM e JOIN s USING (k) GROUP BY e.id, s.label), "
    "cost AS (SELECT q.id, q.label AS own, n.label, n.n, n.n * q.q - 2 * dots.dot + n.t AS c FROM q JOIN dots USING (id) JOIN n ON n.label = dots.label)"
)


@query(
    f"WITH {COST_SQL} SELECT label, id AS medoid, round(c / n, 6) AS cost FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY round(c / n, 6), id) AS r FROM cost WHERE own = label) WHERE r = 1"
)
def medoid_per_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The member of each label with the least mean squared distance to the label's members."""
    costs = cluster.mean_costs(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", "label").where("own = label")
    best = costs.select("label", "id", F.round("mean", 6).alias("cost")).groupBy("label").agg(F.min(F.struct("cost", "id")).alias("b"))
    return best.select("label", F.col("b.id").alias("medoid"), F.col("b.cost").alias("cost"))


SIL_SQL = (
    f"{COST_SQL}, a AS (SELECT id, own, c / nullif(n - 1, 0) AS a FROM cost WHERE own = label), b AS (SELECT id, min(c / n) AS b FROM cost WHERE own <> label GROUP BY id), "
    "sil AS (SELECT own, coalesce((b - a) / greatest(a, b), 0) AS s FROM a JOIN b USING (id))"
)


@query(f"WITH {SIL_SQL} SELECT own AS label, count(*) AS members, round(avg(s), 6) AS silhouette FROM sil GROUP BY own")
def silhouette(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean silhouette of each label by squared distances, from sums over labels, without pairs."""
    found = cluster.silhouettes(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", "label")
    return found.groupBy(F.col("own").alias("label")).agg(F.count("*").alias("members"), F.round(F.avg("silhouette"), 6).alias("silhouette"))


@query(
    f"WITH {UNIT_SQL}, c AS (SELECT label, k, avg(x) AS c FROM e GROUP BY label, k), w AS (SELECT label, avg(r) AS w FROM (SELECT e.id, e.label, sqrt(sum((x - c) ** 2)) AS r FROM e JOIN c USING (label, k) GROUP BY ALL) GROUP BY label), "
    "m AS (SELECT a.label AS i, b.label AS j, sqrt(sum((a.c - b.c) ** 2)) AS m FROM c a JOIN c b ON a.k = b.k AND a.label <> b.label GROUP BY ALL) "
    "SELECT i AS label, round(max((x.w + y.w) / m), 6) AS worst FROM m JOIN w x ON x.label = i JOIN w y ON y.label = j GROUP BY i"
)
def davies_bouldin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each label the largest ratio of spreads to the distance of centroids."""
    return cluster.davies_bouldin(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", "label").select("label", F.round("worst", 6).alias("worst"))


SCORED_SQL = "s AS (SELECT n_chars AS x, quality AS y FROM documents JOIN labels USING (doc_id))"


@query(
    f"WITH {SCORED_SQL}, r AS (SELECT y, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0::DOUBLE AS r FROM s) "
    "SELECT count(*) FILTER (y = 1) AS positives, count(*) FILTER (y = 0) AS negatives, round((sum(r) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2.0::DOUBLE) / (count(*) FILTER (y = 1) * count(*) FILTER (y = 0)), 6) AS auroc FROM r"
)
def auroc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well the length of a document tells its quality, ties by half."""
    return agreement.auroc(_scored(spark, sf_dir), "x", "y").select("positives", "negatives", F.round("auroc", 6).alias("auroc"))


@query(
    f"WITH {SCORED_SQL}, r AS (SELECT y, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0::DOUBLE AS r FROM s) "
    "SELECT round(2 * (sum(r) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2.0::DOUBLE) / (count(*) FILTER (y = 1) * count(*) FILTER (y = 0)) - 1, 6) AS delta FROM r"
)
def cliffs_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agreement.auroc(_scored(spark, sf_dir), "x", "y").select(F.round(2 * F.col("auroc") - 1, 6).alias("delta"))


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("y"))
    return table(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").alias("x")).join(labels, "doc_id")


@query(
    f"WITH {SCORED_SQL}, v AS (SELECT x, count(*) FILTER (y = 1) AS p, count(*) FILTER (y = 0) AS n FROM s GROUP BY x), "
    "t AS (SELECT sum(p) AS tp, sum(n) AS tn FROM v), c AS (SELECT x, lead(x) OVER (ORDER BY x) - x AS step, sum(p) OVER (ORDER BY x) AS cp, sum(n) OVER (ORDER BY x) AS cn FROM v) "
    "SELECT round(sum(step * abs(cp::DOUBLE / tp - cn::DOUBLE / tn)), 6) AS w1 FROM c, t"
)
def w1_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Earth mover's distance between the lengths of good and bad documents."""
    return agreement.wasserstein(_scored(spark, sf_dir), "x", "y").select(F.round("w1", 6).alias("w1"))


PART_SQL = "c AS (SELECT p_brand AS a, p_type AS b, count(*) AS n FROM part GROUP BY ALL)"


@query(
    f"WITH {PART_SQL}, s AS (SELECT sum(n * (n - 1) / 2.0::DOUBLE) AS tog FROM c), ra AS (SELECT sum(n * (n - 1) / 2.0::DOUBLE) AS a FROM (SELECT sum(n) AS n FROM c GROUP BY a)), "
    "rb AS (SELECT sum(n * (n - 1) / 2.0::DOUBLE) AS b FROM (SELECT sum(n) AS n FROM c GROUP BY b)), t AS (SELECT sum(n) * (sum(n) - 1) / 2.0::DOUBLE AS t FROM c) "
    "SELECT round((tog - a * b / t) / ((a + b) / 2 - a * b / t), 6) AS ari, CAST(tog AS BIGINT) AS together, CAST(a - tog AS BIGINT) AS only_a, CAST(b - tog AS BIGINT) AS only_b, CAST(t - a - b + tog AS BIGINT) AS apart FROM s, ra, rb, t"
)
def adjusted_rand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agreement of the partitions by brand and by type, and the confusion counts over pairs, from class sizes."""
    return agreement.rand(table(spark, sf_dir, "part"), "p_brand", "p_type").withColumn("ari", F.round("ari", 6))


@query(
    f"WITH {PART_SQL}, t AS (SELECT sum(n)::DOUBLE AS t FROM c), pa AS (SELECT a, sum(n) AS n FROM c GROUP BY a), pb AS (SELECT b, sum(n) AS n FROM c GROUP BY b), "
    "ha AS (SELECT -sum(n / t * ln(n / t)) AS h FROM pa, t), hb AS (SELECT -sum(n / t * ln(n / t)) AS h FROM pb, t), "
    "mi AS (SELECT sum(c.n / t * ln(c.n * t / (pa.n * pb.n))) AS mi FROM c JOIN pa USING (a) JOIN pb USING (b), t) SELECT round(mi, 6) AS mi, round(mi / sqrt(ha.h * hb.h), 6) AS nmi FROM mi, ha, hb"
)
def mutual_information(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agreement.information(table(spark, sf_dir, "part"), "p_brand", "p_type").select(F.round("mi", 6).alias("mi"), F.round("nmi", 6).alias("nmi"))


KB_SQL = (
    f"{EVENT_SQL}, f AS (SELECT hg, string_agg(v, ',' ORDER BY v) AS f FROM inc GROUP BY hg, e), kb AS (SELECT hg, count(*) AS m FROM f GROUP BY hg), "
    "s AS (SELECT DISTINCT hg, f FROM f), sz AS (SELECT hg, count(*) AS k FROM s GROUP BY hg), deg AS (SELECT hg, v, count(*) AS d FROM inc GROUP BY hg, v)"
)


@query(f"WITH {KB_SQL} SELECT a.hg AS i, b.hg AS j, abs(a.m - b.m) AS size_l1 FROM kb a JOIN kb b ON a.hg <> b.hg WHERE a.hg % 100 = 0")
def pair_size_l1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Difference in the number of facts, query records against all."""
    facts = event_incidence(spark, sf_dir).select("hg", "e").distinct().groupBy("hg").agg(F.count("*").alias("m"))
    return nb.compared_all(facts, "hg", size_l1=F.abs(F.col("q.m") - F.col("x.m")))


@query(
    f"WITH {KB_SQL}, p AS (SELECT a.hg AS i, b.hg AS j FROM kb a JOIN kb b ON a.hg <> b.hg WHERE a.hg % 100 = 0), v AS (SELECT DISTINCT v FROM inc) "
    "SELECT p.i, p.j, CAST(sum(abs(coalesce(x.d, 0) - coalesce(y.d, 0))) AS BIGINT) AS degree_l1 FROM p, v LEFT JOIN deg x ON x.hg = p.i AND x.v = v.v LEFT JOIN deg y ON y.hg = p.j AND y.v = v.v GROUP BY p.i, p.j"
)
def pair_degree_l1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Difference of the constants' degrees, summed: a constant of degree d stands for d items, (v, 1) to (v, d)."""
    deg = event_incidence(spark, sf_dir).groupBy("hg", "v").agg(F.count("*").alias("d"))
    items = deg.select("hg", "v", F.explode(F.sequence(F.lit(1), F.col("d").cast("int"))).alias("n")).select("hg", F.struct("v", "n").alias("item"))
    return distances.set_differences(items, "hg", "item").select("i", "j", F.col("apart").alias("degree_l1"))


@query(
    f"WITH {KB_SQL}, p AS (SELECT a.hg AS i, b.hg AS j, a.k AS x, b.k AS y FROM sz a JOIN sz b ON a.hg <> b.hg WHERE a.hg % 100 = 0), "
    "c AS (SELECT a.hg AS i, b.hg AS j, count(*) AS n FROM s a JOIN s b USING (f) GROUP BY ALL) SELECT p.i, p.j, x + y - 2 * coalesce(n, 0) AS apart FROM p LEFT JOIN c USING (i, j)"
)
def pair_fact_symdiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts that only one of two records asserts."""
    facts = event_incidence(spark, sf_dir).groupBy("hg", "e").agg(F.array_join(F.sort_array(F.collect_list("v")), ",").alias("f"))
    return distances.set_differences(facts.select("hg", "f").distinct(), "hg", "f")


@query(f"WITH {DIST_SQL}, b AS (SELECT i, min(d) AS best FROM dist GROUP BY i), t AS (SELECT dist.* FROM dist JOIN b USING (i) WHERE d = best) SELECT i, lj AS label, round(count(*) / (sum(count(*)) OVER (PARTITION BY i))::DOUBLE, 6) AS p FROM t GROUP BY i, lj")
def nearest_label_probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chance of each label for each query's nearest row, ties drawn by chance."""
    return nb.label_probabilities(cut(_near(spark, sf_dir, 1))).select("i", F.col("lj").alias("label"), F.round("p", 6).alias("p"))


@query(
    f"WITH {DIST_SQL}, b AS (SELECT i, min(d) AS best FROM dist GROUP BY i), t AS (SELECT dist.* FROM dist JOIN b USING (i) WHERE d = best), p AS (SELECT i, li, lj, count(*) / (sum(count(*)) OVER (PARTITION BY i))::DOUBLE AS p FROM t GROUP BY i, li, lj), "
    "o AS (SELECT li AS label, count(DISTINCT i) AS n, coalesce(sum(p) FILTER (li = lj), 0) AS tp FROM p GROUP BY li), w AS (SELECT lj AS label, sum(p) AS told FROM p GROUP BY lj) "
    "SELECT CAST(sum(n) AS BIGINT) AS queries, round(sum(tp) / sum(n), 6) AS accuracy, round(avg(2 * tp / (coalesce(told, 0) + n)), 6) AS macro_f1 FROM o LEFT JOIN w USING (label)"
)
def expected_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected accuracy and macro F1 of the nearest row's label."""
    found = nb.expected_scores(nb.label_probabilities(cut(_near(spark, sf_dir, 1))))
    return found.select("queries", F.round("accuracy", 6).alias("accuracy"), F.round("macro_f1", 6).alias("macro_f1"))


@query(f"WITH {DIST_SQL} SELECT round(min(d) FILTER (li <> lj), 6) AS between, round(max(d) FILTER (li = lj), 6) AS within, round(min(d) FILTER (li <> lj) / max(d) FILTER (li = lj), 6) AS dunn FROM dist")
def dunn_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far apart labels are against how wide they are, from the query rows."""
    return nb.separation(_dist(spark, sf_dir)).select(*[F.round(c, 6).alias(c) for c in ("between", "within", "dunn")])


@query(
    f"WITH {KB_SQL}, key AS (SELECT hg, string_agg(f, ';' ORDER BY f) AS key FROM s GROUP BY hg), p AS (SELECT abs(a.m - b.m) AS d, x.key = y.key AS same FROM kb a JOIN kb b ON a.hg <> b.hg JOIN key x ON x.hg = a.hg JOIN key y ON y.hg = b.hg WHERE a.hg % 100 = 0) "
    "SELECT count(*) FILTER (d = 0) AS zero_pairs, count(*) FILTER (d = 0 AND NOT same) AS false_zeros, count(*) FILTER (d <> 0 AND same) AS equal_pairs_apart FROM p"
)
def zero_pair_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many pairs of query records and others the size distance can't tell apart, and how many of those differ."""
    inc = event_incidence(spark, sf_dir)
    sizes = inc.select("hg", "e").distinct().groupBy("hg").agg(F.count("*").alias("m"))
    return distances.zero_pairs(sizes.join(records.fact_keys(inc), "hg"), "hg", "m", "key")


@query("SELECT q.s_suppkey AS i, x.p_partkey AS j, CAST(levenshtein(q.s_name, x.p_brand || x.p_type) AS INTEGER) AS d FROM supplier q JOIN part x ON TRUE WHERE q.s_suppkey % 100 = 0")
def pair_levenshtein(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edit distances of whole query names against all whole part words; different names and words are compared once."""
    queries = table(spark, sf_dir, "supplier").where("s_suppkey % 100 = 0").select(F.col("s_suppkey").alias("i"), F.col("s_name").alias("a"))
    words = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("j"), F.concat("p_brand", "p_type").alias("b"))
    return nb.compared(queries, words, d=F.levenshtein("a", "b"))


@query("SELECT q.s_suppkey AS i, x.p_partkey AS j, CAST(levenshtein(q.s_name, x.p_brand || x.p_type) AS INTEGER) AS d FROM supplier q JOIN part x ON TRUE WHERE q.s_suppkey % 100 = 0")
def pair_levenshtein_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as ``pair_levenshtein``, under the name that whole strings had when that one cut them."""
    return pair_levenshtein(spark, sf_dir)


@query(
    "WITH g AS (SELECT lang, count(*) AS n, count(*) FILTER (quality = 1) AS good FROM documents JOIN labels USING (doc_id) GROUP BY lang) "
    "SELECT lang, n, good, round((good + 1.9208) / (n + 3.8416) - 1.96 * sqrt(good * (n - good)::DOUBLE / n + 0.9604) / (n + 3.8416), 6) AS low, "
    "round((good + 1.9208) / (n + 3.8416) + 1.96 * sqrt(good * (n - good)::DOUBLE / n + 0.9604) / (n + 3.8416), 6) AS high FROM g"
)
def wilson_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of good documents in each language with its 95 % interval."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    counts = table(spark, sf_dir, "documents").select("doc_id", "lang").join(labels, "doc_id").groupBy("lang").agg(
        F.count("*").alias("n"), F.count_if(F.col("quality") == 1).alias("good")
    )
    low, high = agreement.wilson(F.col("good"), F.col("n"))
    return counts.select("lang", "n", "good", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))
