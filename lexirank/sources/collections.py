"""Reading corpora, queries and judgments, as JSON arrays or Parquet, with explicit schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..functions.text import _strip
from ..schemas import DOCUMENTS, QRELS, QUERIES


def open_first(spark: SparkSession, path: str, schema: str, folders: tuple[str, ...] = ("", "dataset/")) -> DataFrame:
    """The first of path and dataset/path that exists; .parquet is read as such, all else as a JSON array."""
    head, _, name = path.rpartition("/")
    tried = [f"{head}/{f}{name}" if head else f"{f}{name}" for f in folders]
    for candidate in tried:
        try:
            if name.endswith(".parquet"):
                return spark.read.schema(schema).parquet(candidate)
            return spark.read.schema(schema).option("multiLine", True).json(candidate)
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
    raise FileNotFoundError(f"none of {', '.join(tried)} exists")


def read_corpus(spark: SparkSession, path: str = "documents.json") -> DataFrame:
    return open_first(spark, path, DOCUMENTS)


def read_queries(spark: SparkSession, path: str = "queries.json") -> DataFrame:
    return open_first(spark, path, QUERIES)


def read_qrels(spark: SparkSession, path: str = "qrels.json", optional: bool = False) -> DataFrame:
    """optional: an absent file is an empty table."""
    try:
        return open_first(spark, path, QRELS)
    except FileNotFoundError:
        if not optional:
            raise
        return spark.createDataFrame([], QRELS)


def read_suggestion_texts(spark: SparkSession, path: str = "queries.json") -> DataFrame:
    """Queries to suggest from: those under dataset/ come first; an absent file is an empty table."""
    try:
        return open_first(spark, path, QUERIES, ("dataset/", ""))
    except FileNotFoundError:
        return spark.createDataFrame([], QUERIES)


def query_texts(queries: DataFrame) -> DataFrame:
    """Distinct trimmed texts that are not blank."""
    text = _strip(F.col("text")).alias("text")
    return queries.select(text).where("text != ''").distinct()


def query_lookup(queries: DataFrame) -> DataFrame:
    """(query_id, text) of queries with an id; of several with one id, one stays."""
    return queries.where(F.coalesce(F.trim(F.col("query_id").cast("string")), F.lit("")) != "").select(F.col("query_id").cast("string").alias("query_id"), "text").dropDuplicates(["query_id"])
