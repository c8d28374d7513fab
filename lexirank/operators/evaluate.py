"""Effectiveness of rankings against relevance judgments, for all queries at once, and the BM25 parameter grid."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.index import Index
from .rank import RANKERS, Ranker, bm25_best, query_terms, rank, top

#: The grid.
K1_GRID, B_GRID = (0.9, 1.2, 1.5, 1.8, 2.0), (0.3, 0.5, 0.65, 0.75, 0.9)


def judgments(qrels: DataFrame) -> DataFrame:
    """Any row judges its document relevant, whatever its grade."""
    return qrels.select(F.col("query_id").cast("string").alias("query_id"), F.col("doc_id").cast("string").alias("doc_id")).distinct()


def flagged(ranking: DataFrame, qrels: DataFrame, keys: Sequence[str] = ("query_id",)) -> DataFrame:
    """ranking with relevant (0 or 1), hits (relevant ones so far) and total_relevant of its query."""
    judged = judgments(qrels)
    sizes = judged.groupBy("query_id").agg(F.count("*").alias("total_relevant"))
    so_far = Window.partitionBy(*keys).orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = ranking.join(judged.withColumn("relevant", F.lit(1)), ["query_id", "doc_id"], "left").join(sizes, "query_id", "left")
    return out.withColumns({"relevant": F.coalesce("relevant", F.lit(0)), "total_relevant": F.coalesce("total_relevant", F.lit(0).cast("long"))}).withColumn("hits", F.sum("relevant").over(so_far))


def discount(place: Column) -> Column:
    return 1.0 / F.log2(place + 1)


def ideal_dcg(n: Column) -> Column:
    """DCG of n relevant documents at the first n ranks."""
    return F.when(n > 0, F.aggregate(F.sequence(F.lit(1).cast("long"), n), F.lit(0.0), lambda acc, i: acc + discount(i))).otherwise(0.0)


def metrics(ranking: DataFrame, queries: DataFrame, qrels: DataFrame, keys: Sequence[str] = ("query_id",)) -> DataFrame:
    """ap, p5, p10, ndcg10 for each query, 0 where it has no judgments or no ranking; keys: query_id and, for grids, more."""
    rel = F.col("relevant")
    precision = lambda k: F.coalesce(F.sum(F.when(F.col("rank") <= k, rel)), F.lit(0)) / F.lit(k)
    per = flagged(ranking, qrels, keys).groupBy(*keys).agg(
        F.sum(F.when(rel == 1, F.col("hits") / F.col("rank"))).alias("gain"), F.max("total_relevant").alias("total"), precision(5).alias("p5"), precision(10).alias("p10"),
        F.sum(F.when((rel == 1) & (F.col("rank") <= 10), discount(F.col("rank")))).alias("dcg"),
    )
    some = F.col("total") > 0
    per = per.select(*keys, F.when(some, F.coalesce("gain", F.lit(0.0)) / F.col("total")).otherwise(0.0).alias("ap"), "p5", "p10", F.when(some, F.coalesce("dcg", F.lit(0.0)) / ideal_dcg(F.least("total", F.lit(10).cast("long")))).otherwise(0.0).alias("ndcg10"))
    return queries.select(F.col("query_id").cast("string").alias("query_id"), F.col("text").alias("query")).join(per, "query_id", "left").fillna(0.0, ["ap", "p5", "p10", "ndcg10"])


def evaluate(index: Index, queries: DataFrame, qrels: DataFrame, model: str | Ranker, depth: int = 25, **params) -> DataFrame:
    return metrics(rank(index, queries, model, depth, **params), queries, qrels)


def means(per_query: DataFrame) -> DataFrame:
    return per_query.agg(*(F.coalesce(F.avg(c), F.lit(0.0)).alias(name) for c, name in (("ap", "map"), ("p5", "mean_p5"), ("p10", "mean_p10"), ("ndcg10", "mean_ndcg10"))))


def compare(index: Index, queries: DataFrame, qrels: DataFrame, models: Sequence[str] | None = None, depth: int = 25) -> DataFrame:
    """One row per model, the best mean average precision first, ties by name."""
    rows = None
    for name in models or list(RANKERS):
        one = means(evaluate(index, queries, qrels, name, depth)).withColumn("model", F.lit(name))
        rows = one if rows is None else rows.unionByName(one)
    place = F.row_number().over(Window.orderBy(F.desc("map"), "model"))  # a row per model
    return rows.withColumn("place", place).withColumn("best", F.col("place") == 1)


def grid_ranking(index: Index, terms: DataFrame, pairs: Sequence[tuple[float, float]], depth: int) -> DataFrame:
    """(variant, query_id, doc_id, pos, rank, score): the ranking of each pair of k1 and b, all from one pass; variant: the
    number of the pair."""
    return top(bm25_best(index, terms, depth, pairs=pairs), index, depth, keys=["variant", "query_id"])


def grid_search(index: Index, queries: DataFrame, qrels: DataFrame, k1_values: Sequence[float] = K1_GRID, b_values: Sequence[float] = B_GRID, depth: int = 25) -> DataFrame:
    """(k1, b, map) in one job, the best first; of equal ones the smallest k1, then b."""
    keys, pairs = ["variant", "query_id"], [(float(k), float(b)) for k in k1_values for b in b_values]
    rel = flagged(grid_ranking(index, query_terms(queries), pairs, depth), qrels, keys)
    ap = rel.groupBy(*keys).agg((F.coalesce(F.sum(F.when(F.col("relevant") == 1, F.col("hits") / F.col("rank"))), F.lit(0.0)) / F.greatest(F.max("total_relevant"), F.lit(1))).alias("ap"))
    n = queries.agg(F.count("*").alias("n"))
    every = queries.sparkSession.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "variant int, k1 double, b double")
    sums = every.join(ap.groupBy("variant").agg(F.sum("ap").alias("s")), "variant", "left").crossJoin(F.broadcast(n))
    return sums.select("k1", "b", F.when(F.col("n") > 0, F.coalesce("s", F.lit(0.0)) / F.col("n")).otherwise(0.0).alias("map")).orderBy(F.round("map", 12).desc(), "k1", "b")


def grid_matrix(grid: DataFrame) -> DataFrame:
    return grid.groupBy("k1").pivot("b").agg(F.first("map")).orderBy("k1")


def report(per_query: DataFrame, queries: DataFrame | None = None) -> DataFrame:
    """Per-query rows, best average precision first, query texts cut to 60 characters. Ties keep the order of queries as
    they were read, or without these go by id."""
    rows = per_query.withColumn("query", F.substring("query", 1, 60))
    if queries is None:
        return rows.orderBy(F.desc("ap"), "query_id")
    place = queries.select(F.col("query_id").cast("string").alias("query_id"), F.monotonically_increasing_id().alias("_place"))
    place = place.groupBy("query_id").agg(F.min("_place").alias("_place"))
    return rows.join(place, "query_id", "left").orderBy(F.desc("ap"), "_place").drop("_place")
