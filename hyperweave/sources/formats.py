"""Formats of collections: nested records, JSON lines, statements of variable width and time-stamped simplices."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

RECORD = "hg long, facts array<struct<pred: string, members: array<long>>>"


def nest(inc: DataFrame) -> DataFrame:
    """(hg, facts): one record a hypergraph, facts sorted by label and members."""
    facts = inc.groupBy("hg", "e").agg(F.first("pred").alias("pred"), F.sort_array(F.collect_list("v")).alias("members"))
    return facts.groupBy("hg").agg(F.sort_array(F.collect_list(F.struct("pred", "members"))).alias("facts"))


def unnest(records: DataFrame) -> DataFrame:
    """(hg, e, v, pred): incidences of nested records, facts numbered from 0."""
    facts = records.select("hg", F.posexplode("facts").alias("e", "f"))
    return facts.select("hg", "e", F.explode("f.members").alias("v"), F.col("f.pred").alias("pred"))


def to_json(records: DataFrame) -> DataFrame:
    return records.select(F.to_json(F.struct(*records.columns)).alias("value"))


def from_json(lines: DataFrame) -> DataFrame:
    return lines.select(F.from_json("value", RECORD).alias("r")).select("r.*")


def write_jsonl(records: DataFrame, path: str) -> None:
    """One record a line, in as many files as there are partitions, with a count beside them that readers check."""
    records.write.mode("overwrite").json(f"{path}/records")
    records.agg(F.count("*").alias("records")).write.mode("overwrite").json(f"{path}/census")


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """The records of ``write_jsonl``; a count that differs from the census is an error."""
    found = spark.read.schema(RECORD).json(f"{path}/records")
    want = spark.read.json(f"{path}/census").first()["records"]
    if found.count() != want:
        raise ValueError(f"{path} holds another number of records than its census says")
    return found


def statements(lines: DataFrame, col: str, sep: str) -> DataFrame:
    """Lines ``subject sep relation sep value [sep qualifier sep value]..``: values and qualifiers in turn after the relation."""
    parts = F.split(F.col(col), sep)
    rest = F.slice(parts, 3, F.greatest(F.size(parts) - 2, F.lit(0)))
    pick = lambda odd: F.filter(rest, lambda x, i: i % 2 == odd)
    own = [c for c in lines.columns if c != col]
    return lines.select(
        *own, parts[0].alias("subject"), F.when(F.size(parts) > 1, F.get(parts, 1)).alias("relation"), F.size(parts).alias("fields"),
        pick(0).alias("members"), pick(1).alias("qualifiers"),
    )


def types_table(spark: SparkSession, path: str) -> DataFrame:
    """(entity, types): tab-separated entity and comma-separated types."""
    rows = spark.read.option("sep", "\t").schema("entity string, types string").csv(path)
    return rows.select("entity", F.split("types", ",").alias("types"))


def simplices(rows: DataFrame) -> DataFrame:
    """(sid, ts, members): flat vertex lists cut by their sizes (nverts, flat, times as arrays), members sorted and distinct."""
    cut = rows.select(F.posexplode(F.arrays_zip("nverts", "times")).alias("sid", "z"), "nverts", "flat")
    start = F.aggregate(F.slice("nverts", F.lit(1), F.col("sid")), F.lit(0), lambda done, n: done + n.cast("int"))
    members = F.slice("flat", start + 1, F.col("z.nverts").cast("int"))
    return cut.select("sid", F.col("z.times").alias("ts"), F.array_sort(F.array_distinct(members)).alias("members"))


def to_hif(inc: DataFrame, vertex_label: str, edge_label: str) -> DataFrame:
    """(hg, value): each hypergraph as a hypergraph interchange document, its nodes, edges and incidences in order.

    The labels are numbers of columns of ``inc``; the numbers of labels are those up to the largest in use. A document
    is as large as its hypergraph.
    """
    node = F.struct(F.col("v").alias("node"), F.struct(F.col(vertex_label).alias("label")).alias("attrs"))
    edge = F.struct(F.col("e").alias("edge"), F.struct(F.col(edge_label).alias("label")).alias("attrs"))
    met = F.array_sort(F.collect_list(F.struct("e", "v")))
    rows = inc.groupBy("hg").agg(
        F.array_sort(F.collect_set(node)).alias("nodes"), F.array_sort(F.collect_set(edge)).alias("edges"), met.alias("met"),
        (F.max(vertex_label) + 1).alias("n_vertex_labels"), (F.max(edge_label) + 1).alias("n_edge_labels"),
    )
    sizes = [F.size("nodes").alias("n_nodes"), F.size("edges").alias("n_edges")]
    incidences = F.transform("met", lambda x: F.struct(x["v"].alias("node"), x["e"].alias("edge"))).alias("incidences")
    doc = F.struct(
        F.lit("undirected").alias("network-type"), F.struct("n_vertex_labels", "n_edge_labels", *sizes).alias("metadata"), "nodes", "edges", incidences
    )
    return rows.select("hg", F.to_json(doc).alias("value"))
