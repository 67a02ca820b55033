"""Queries over words and token sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.canonical import canonical_classes
from ..operators import sequences as seq, words
from ..sources.collections import EVENT_SQL, event_incidence, table
from .registry import query

WORD_SQL = (
    f"{EVENT_SQL}, r AS (SELECT hg, e, dense_rank() OVER (PARTITION BY hg ORDER BY v) - 1 AS r FROM inc), "
    "f AS (SELECT DISTINCT hg, rs FROM (SELECT hg, e, list(r ORDER BY r) AS rs FROM r GROUP BY hg, e)), "
    "t AS (SELECT hg, count(DISTINCT r) AS n FROM r GROUP BY hg), "
    "w AS (SELECT f.hg, n, repeat('T0 ', n::INT) || string_agg('F0(' || array_to_string(rs, ',') || ')', ' ' ORDER BY rs) AS word, list(rs ORDER BY rs) AS facts FROM f JOIN t USING (hg) GROUP BY f.hg, n)"
)


@query(f"WITH {WORD_SQL} SELECT hg, word FROM w")
def encode_fact_word(spark: SparkSession, sf_dir: str) -> DataFrame:
    return words.encode(event_incidence(spark, sf_dir))


@query(f"WITH {WORD_SQL} SELECT hg, CAST(n AS INT) AS n, CAST(len(facts) AS INT) AS m, array_to_string(list_transform(facts, lambda x: array_to_string(x, '-')), ';') AS facts FROM w")
def decode_fact_word(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words decoded again: constants and facts of each record."""
    found = words.decode(words.encode(event_incidence(spark, sf_dir)))
    text = F.array_join(F.transform("facts", lambda f: F.array_join(f["members"].cast("array<string>"), "-")), ";")
    return found.select("hg", "n", F.size("facts").alias("m"), text.alias("facts"))


ROLE_SQL = "t AS (SELECT conv_id AS seq, turn AS pos, role AS token FROM conversations)"
BIGRAM_SQL = f"{ROLE_SQL}, b AS (SELECT token AS first, lead(token) OVER (PARTITION BY seq ORDER BY pos) AS last FROM t), g AS (SELECT first, last, count(*) AS times FROM b WHERE last IS NOT NULL GROUP BY ALL)"


def _roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("seq"), F.col("turn").alias("pos"), F.col("role").alias("token"))


@query(
    f"WITH {ROLE_SQL}, g AS (SELECT token || ' ' || lead(token) OVER w || ' ' || lead(token, 2) OVER w AS gram, seq FROM t WINDOW w AS (PARTITION BY seq ORDER BY pos)) "
    "SELECT gram, count(*) AS times, count(DISTINCT seq) AS sequences FROM g WHERE gram IS NOT NULL GROUP BY gram"
)
def token_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seq.ngrams(_roles(spark, sf_dir), 3).groupBy("gram").agg(F.count("*").alias("times"), F.countDistinct("seq").alias("sequences"))


@query(
    f"WITH {BIGRAM_SQL}, l AS (SELECT last AS token, count(*) AS l FROM g GROUP BY last), r AS (SELECT first AS token, count(*) AS r FROM g GROUP BY first) "
    "SELECT token, coalesce(l, 0) AS left_kinds, coalesce(r, 0) AS right_kinds FROM l FULL JOIN r USING (token)"
)
def continuation_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seq.continuations(seq.ngrams(_roles(spark, sf_dir), 2)).select("token", F.col("left").alias("left_kinds"), F.col("right").alias("right_kinds"))


@query(
    f"WITH {BIGRAM_SQL}, a AS (SELECT first, sum(times) AS total, count(*) AS kinds FROM g GROUP BY first), c AS (SELECT last, count(*) AS l FROM g GROUP BY last), k AS (SELECT sum(l) AS k FROM c) "
    "SELECT first, last, times, round(greatest(times - 0.75::DOUBLE, 0) / total + 0.75::DOUBLE * kinds / total * (l / k), 6) AS p FROM g JOIN a USING (first) JOIN c USING (last), k"
)
def kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seq.kneser_ney(seq.ngrams(_roles(spark, sf_dir), 2)).select("first", "last", "times", F.round("p", 6).alias("p"))


@query(
    "WITH w AS (SELECT lang AS grp, unnest(string_split(text, ' ')) AS item FROM documents), p AS (SELECT grp, item, count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY grp) AS p FROM w GROUP BY grp, item), "
    "g AS (SELECT DISTINCT grp FROM p), i AS (SELECT DISTINCT item FROM p), x AS (SELECT a.grp AS a, b.grp AS b, coalesce(pa.p, 0) AS x, coalesce(pb.p, 0) AS y FROM g a JOIN g b ON a.grp < b.grp, i "
    "LEFT JOIN p pa ON pa.grp = a.grp AND pa.item = i.item LEFT JOIN p pb ON pb.grp = b.grp AND pb.item = i.item) "
    "SELECT a, b, round(sum(CASE WHEN x > 0 THEN x * log2(2 * x / (x + y)) ELSE 0 END + CASE WHEN y > 0 THEN y * log2(2 * y / (x + y)) ELSE 0 END) / 2, 6) AS jsd FROM x GROUP BY a, b"
)
def profile_jsd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divergence of the languages' word profiles, over whole texts."""
    items = table(spark, sf_dir, "documents").select(F.col("lang").alias("grp"), F.explode(F.split("text", " ")).alias("item"))
    return seq.divergence(items.groupBy("grp", "item").agg(F.count("*").alias("n"))).select("a", "b", F.round("jsd", 6).alias("jsd"))


@query(
    "WITH s AS (SELECT unnest(string_split(text, chr(10))) AS line FROM benchmark), k AS (SELECT DISTINCT unnest(string_split(text, chr(10))) AS line FROM documents) "
    "SELECT count(*) AS samples, count(*) FILTER (line NOT IN (SELECT line FROM k)) AS novel FROM s"
)
def novelty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the benchmark that no document holds."""
    lines = lambda name: table(spark, sf_dir, name).select(F.explode(F.split("text", "\n")).alias("line"))
    return seq.novelty(lines("benchmark"), lines("documents"), "line")


@query(
    "WITH w AS (SELECT lang, len(string_split(text, ' ')) AS words, len(string_split(text, chr(10))) AS lines FROM documents) "
    "SELECT lang, count(*) AS texts, CAST(sum(words) AS BIGINT) AS words, max(words) AS longest, CAST(sum(lines) AS BIGINT) AS lines FROM w GROUP BY lang"
)
def text_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = table(spark, sf_dir, "documents").select("lang", F.size(F.split("text", " ")).cast("long").alias("w"), F.size(F.split("text", "\n")).alias("l"))
    return sizes.groupBy("lang").agg(F.count("*").alias("texts"), F.sum("w").alias("words"), F.max("w").alias("longest"), F.sum("l").alias("lines"))


@query()
def isomorphism_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact isomorphism classes of the users' days, by canonical words of small records."""
    return canonical_classes(event_incidence(spark, sf_dir)).select("word", "members", "first_hg")
