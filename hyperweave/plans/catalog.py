"""The registered queries of the library's own operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import alignments, blocks, corruptions, crossval, details, dissimilarity, edits, graphs, intervals, ladders, language, linkage, matrices, measures, ngrams, reports, scaling, sequences, sources, spectra, temporal  # noqa: F401  they register their queries
from .registry import QUERIES, SQL


def queries():
    return QUERIES


def oracle_sql():
    return SQL


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["arity_histogram"](spark, sf_dir)
