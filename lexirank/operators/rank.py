"""Seven rankers over an index, each for a whole batch of queries in one plan.

A ranker takes (index, query terms, depth) and returns (query_id, doc_id, pos, rank, score). Query terms are
(query_id, term, qf). Ranks order by the score rounded to nine digits, then by corpus position. Scores come from one pass
over the forward table (scan.py), explanations from frames of contributions, (query_id, pos, term, parts, contribution), of
the documents asked about alone. Only matched documents are ranked.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import analyze
from ..plans.index import Index, part
from ..storage import materialize
from .scan import best_documents

Ranker = Callable[[Index, DataFrame, int], DataFrame]


def query_terms(queries: DataFrame, id_col: str = "query_id", text_col: str = "text") -> DataFrame:
    """(query_id, term, qf): the bag of stems of each query."""
    return analyze(queries.select(F.col(id_col).cast("string").alias("query_id"), F.col(text_col).alias("text")), "query_id").groupBy("query_id", "term").agg(F.count("*").cast("double").alias("qf"))


def top(scored: DataFrame, index: Index, depth: int, by: Sequence[Column] | None = None, keys: Sequence[str] = ("query_id",)) -> DataFrame:
    """The first depth documents of each query; scored: (query_id, pos, score), and where by is not given, key."""
    order = by or [F.col("key").desc(), F.col("pos")]
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= depth)
    return ranked.join(index.docs.select("pos", "doc_id"), "pos").select(*keys, "doc_id", "pos", "rank", "score")


def met(index: Index, weighted: DataFrame, near: DataFrame) -> DataFrame:
    """weighted, (query_id, term, ...), met in the documents of near, (query_id, pos): with pos, tf and dl."""
    return feedback_terms(index, near.select("query_id", "pos")).drop("first_pos").join(weighted, ["query_id", "term"])


# BM25


def bm25_query_component(weight: Column, k2: Column) -> Column:
    return weight * (k2 + 1) / (weight + k2)


def _bm25_known(index: Index, terms: DataFrame, weight: str) -> DataFrame:
    known = terms.join(index.terms.select("term", "idf_bm25"), "term").crossJoin(F.broadcast(index.corpus.select("adl", "k1", "b", "k2")))
    return known.withColumn("query_component", bm25_query_component(F.col(weight), F.col("k2")))


def bm25_parts(index: Index, terms: DataFrame, near: DataFrame, weight: str = "qf") -> DataFrame:
    """Contributions of the matched terms to near; terms: (query_id, term, weight), where weights may be fractions."""
    parts = met(index, _bm25_known(index, terms, weight), near)
    parts = parts.withColumn("norm_k", F.col("k1") * ((1 - F.col("b")) + F.col("b") * (F.col("dl") / F.col("adl"))))
    parts = parts.withColumn("doc_component", F.col("tf") * (F.col("k1") + 1) / (F.col("tf") + F.col("norm_k")))
    return parts.withColumn("contribution", F.col("idf_bm25") * F.col("doc_component") * F.col("query_component"))


def bm25_best(index: Index, terms: DataFrame, depth: int, weight: str = "qf", pairs: Sequence[tuple[float, float]] | None = None) -> DataFrame:
    """Candidates by BM25 for each pair of k1 and b, by default the corpus's; variant: the number of the pair."""
    corpus = index.corpus.select("adl", "k1", "b").first()
    adl, pairs = corpus["adl"], pairs or [(corpus["k1"], corpus["b"])]

    def values(tf: np.ndarray, dl: np.ndarray, own: np.ndarray) -> list[np.ndarray]:
        return [own * (tf * (k1 + 1) / (tf + k1 * ((1 - b) + b * (dl / adl)))) for k1, b in pairs]

    known = _bm25_known(index, terms, weight).select("query_id", "term", F.col("query_component").alias("weight"), F.col("idf_bm25").alias("own"))
    return best_documents(index, known, depth, values, len(pairs))


def bm25(index: Index, terms: DataFrame, depth: int, weight: str = "qf") -> DataFrame:
    return top(bm25_best(index, terms, depth, weight), index, depth)


# Vectors


def known_terms(index: Index, terms: DataFrame) -> DataFrame:
    """The index's rows of the terms of terms; the few terms go to the vocabulary, which stays where it is."""
    return index.terms.join(terms.select("term").distinct(), "term", "left_semi")


def query_vector(index: Index, terms: DataFrame) -> DataFrame:
    """(query_id, term, weight): dampened frequency times smoothed IDF, 0 for words outside the index."""
    known = terms.join(known_terms(index, terms).select("term", "idf_smooth"), "term", "left")
    return known.select("query_id", "term", ((F.log("qf") + 1) * F.coalesce("idf_smooth", F.lit(0.0))).alias("weight"))


def vector_parts(index: Index, vector: DataFrame, near: DataFrame) -> DataFrame:
    parts = met(index, vector.join(index.terms.select("term", "idf_smooth"), "term"), near)
    return parts.withColumn("tfidf", (F.log(F.col("tf").cast("double")) + 1) * F.col("idf_smooth")).withColumn("contribution", F.col("weight") * F.col("tfidf"))


def cosine(index: Index, vector: DataFrame, depth: int) -> DataFrame:
    """Candidates among all documents that share a term; queries and documents of length 0 have none."""
    known = materialize(vector, "vector").join(index.terms.select("term", F.col("idf_smooth").alias("own")), "term")
    return best_documents(index, known, depth, lambda tf, dl, own: [(np.log(tf) + 1) * own], cosine=True)


def vsm(index: Index, terms: DataFrame, depth: int) -> DataFrame:
    return top(cosine(index, query_vector(index, terms), depth), index, depth)


# Binary independence


def bim_parts(index: Index, terms: DataFrame, near: DataFrame) -> DataFrame:
    return met(index, terms.join(index.terms.select("term", "idf_bim"), "term"), near).withColumn("contribution", F.col("idf_bim"))


def bim(index: Index, terms: DataFrame, depth: int) -> DataFrame:
    known = terms.join(index.terms.select("term", F.col("idf_bim").alias("own")), "term").withColumn("weight", F.lit(1.0))
    return top(best_documents(index, known, depth, lambda tf, dl, own: [own]), index, depth)


# Language model with Dirichlet smoothing, over matched terms only


def lm_parts(index: Index, terms: DataFrame, near: DataFrame) -> DataFrame:
    known = terms.join(index.terms.select("term", "p_collection"), "term").crossJoin(F.broadcast(index.corpus.select("mu")))
    parts = met(index, known, near).withColumn("p_td", (F.col("tf") + F.col("mu") * F.col("p_collection")) / (F.col("dl") + F.col("mu")))
    return parts.withColumn("contribution", F.col("qf") * F.log("p_td"))


def lm_dirichlet(index: Index, terms: DataFrame, depth: int) -> DataFrame:
    mu = index.corpus.select("mu").first()["mu"]
    known = terms.join(index.terms.select("term", F.col("p_collection").alias("own")), "term").withColumn("weight", F.col("qf"))
    return top(best_documents(index, known, depth, lambda tf, dl, own: [np.log((tf + mu * own) / (dl + mu))], nonzero=True), index, depth)


# Rocchio feedback


def feedback_terms(index: Index, feedback: DataFrame) -> DataFrame:
    """feedback, with pos, by term: tf, first_pos, dl. The forward table's folders without a feedback document are not
    read: the filter on pos is what makes Spark prune them by the join."""
    asked = feedback.where("pos >= 0").withColumn("part", part(F.col("pos")))
    held = index.forward.join(F.broadcast(asked) if _few(feedback) else asked, ["part", "pos"])
    return held.select(*feedback.columns, "dl", F.inline("bag"))


def _few(written: DataFrame, most: int = 500_000) -> bool:
    """Whether a written table of narrow rows is small enough to go to all tasks."""
    return written.count() <= most


def first_pass(index: Index, terms: DataFrame, depth: int) -> DataFrame:
    """BM25's first documents, written, as feedback reads them twice and fusion three times."""
    return materialize(bm25(index, terms, depth), "feedback")


def rocchio_expansions(index: Index, terms: DataFrame, fb_docs: int = 15, fb_terms: int = 25, beta: float = 0.6, first: DataFrame | None = None) -> DataFrame:
    """(query_id, term, weight): the strongest terms of the feedback centroid that the query does not have. The centroid
    divides by fb_docs even if fewer came back; ties go to the term met first in the feedback documents. first: BM25's
    ranking, if it is there already."""
    feedback = first_pass(index, terms, fb_docs) if first is None else first
    held = feedback_terms(index, feedback.where(F.col("rank") <= fb_docs).select("query_id", "pos", "rank"))
    tfidf = (F.log(F.col("tf").cast("double")) + 1) * F.col("idf_smooth")
    met = held.join(index.terms.select("term", "idf_smooth"), "term").groupBy("query_id", "term").agg(F.sum(tfidf).alias("mass"), F.min(F.struct("rank", "first_pos")).alias("met"))
    new = met.join(terms.select("query_id", "term"), ["query_id", "term"], "left_anti").withColumn("weight", F.col("mass") / fb_docs * beta)
    order = Window.partitionBy("query_id").orderBy(F.round("weight", 12).desc(), "met")
    return new.withColumn("place", F.row_number().over(order)).where(F.col("place") <= fb_terms).select("query_id", "term", "weight", "place")


def rocchio_vector(index: Index, terms: DataFrame, fb_docs: int = 15, fb_terms: int = 25, alpha: float = 0.4, beta: float = 0.6) -> DataFrame:
    """The unscaled query vector and the expansions. alpha would scale only terms that are no candidates: it has no
    effect, and is kept for callers that pass it."""
    more = materialize(rocchio_expansions(index, terms, fb_docs, fb_terms, beta), "expansions")
    return query_vector(index, terms).withColumn("from_feedback", F.lit(False)).unionByName(more.select("query_id", "term", "weight").withColumn("from_feedback", F.lit(True)))


def rocchio(index: Index, terms: DataFrame, depth: int, fb_docs: int = 15, fb_terms: int = 25, alpha: float = 0.4, beta: float = 0.6) -> DataFrame:
    return top(cosine(index, rocchio_vector(index, terms, fb_docs, fb_terms, alpha, beta).drop("from_feedback"), depth), index, depth)


# Relevance model


def rm3_feedback(index: Index, terms: DataFrame, fb_docs: int = 10, first: DataFrame | None = None) -> DataFrame:
    """(query_id, pos, doc_id, rank, p): the first documents by BM25, their scores as shares."""
    head = (bm25(index, terms, fb_docs) if first is None else first).where(F.col("rank") <= fb_docs)
    return head.withColumn("mass", F.sum("score").over(Window.partitionBy("query_id"))).where("mass > 0").select("query_id", "pos", "doc_id", "rank", (F.col("score") / F.col("mass")).alias("p"))


def rm3_weights(index: Index, terms: DataFrame, fb_docs: int = 10, fb_terms: int = 20, lam: float = 0.5, first: DataFrame | None = None) -> DataFrame:
    """(query_id, term, weight): the strongest terms of the mixture of the query and its feedback documents. Words
    outside the index keep their share of the query and take a place, though they score nothing. first: BM25's ranking, if
    it is there already."""
    feedback = materialize(rm3_feedback(index, terms, fb_docs, first), "feedback")
    per_query = Window.partitionBy("query_id")
    held = feedback_terms(index, feedback.select("query_id", "pos", "rank", "p")).join(index.terms.select("term", "p_collection"), "term").crossJoin(F.broadcast(index.corpus.select("mu")))
    held = held.withColumn("mass", F.col("p") * ((F.col("tf") + F.col("mu") * F.col("p_collection")) / (F.col("dl") + F.col("mu"))))
    rm1 = held.groupBy("query_id", "term").agg(F.sum("mass").alias("mass")).withColumn("rm1", F.col("mass") / F.sum("mass").over(per_query)).select("query_id", "term", "rm1")
    own = terms.join(feedback.select("query_id").distinct(), "query_id", "left_semi").withColumn("p_q", F.col("qf") / F.sum("qf").over(per_query)).select("query_id", "term", "p_q")
    mixed = rm1.join(own, ["query_id", "term"], "full").select("query_id", "term", (lam * F.coalesce("p_q", F.lit(0.0)) + (1 - lam) * F.coalesce("rm1", F.lit(0.0))).alias("weight"))
    order = per_query.orderBy(F.round("weight", 12).desc(), "term")
    return mixed.withColumn("place", F.row_number().over(order)).where(F.col("place") <= fb_terms).drop("place")


def rm3(index: Index, terms: DataFrame, depth: int, fb_docs: int = 10, fb_terms: int = 20, lam: float = 0.5, first: DataFrame | None = None) -> DataFrame:
    weights = materialize(rm3_weights(index, terms, fb_docs, fb_terms, lam, first), "rm3")
    return bm25(index, weights, depth, "weight")


# Fusion


def rrf_parts(index: Index, terms: DataFrame, depth: int, rankers: Sequence[Ranker] | None = None, k_rrf: int = 60, fb_docs: int = 10) -> DataFrame:
    """(query_id, pos, doc_id, ranker, rank, raw, component): every ranker's ranking down to depth. Without rankers of the
    caller's, BM25 runs once: its ranking is also the first pass of RM3."""
    if rankers is None:
        first = first_pass(index, terms, max(depth, fb_docs))
        lists = [first.where(F.col("rank") <= depth), vsm(index, terms, depth), rm3(index, terms, depth, fb_docs, first=first)]
    else:
        lists = [r(index, terms, depth) for r in rankers]
    lists = [ranking.withColumn("ranker", F.lit(i)) for i, ranking in enumerate(lists)]
    return reduce(DataFrame.unionByName, lists).withColumnRenamed("score", "raw").withColumn("component", 1.0 / (k_rrf + F.col("rank")))


def rrf(index: Index, terms: DataFrame, depth: int, rankers: Sequence[Ranker] | None = None, k_rrf: int = 60) -> DataFrame:
    """Reciprocal rank fusion of rankings twice as deep as asked for, so scores depend on depth. Components are added in
    the rankers' order, which makes sums exact; ties go to the first ranker that returned the document, then its rank."""
    parts, n = rrf_parts(index, terms, 2 * depth, rankers, k_rrf), 3 if rankers is None else len(rankers)
    each = [F.max(F.when(F.col("ranker") == i, F.col("component"))).alias(f"c{i}") for i in range(n)]
    wide = parts.groupBy("query_id", "pos").agg(F.min(F.struct("ranker", "rank")).alias("met"), *each)
    score = reduce(lambda a, b: a + b, [F.coalesce(F.col(f"c{i}"), F.lit(0.0)) for i in range(n)])
    return top(wide.select("query_id", "pos", "met", score.alias("score")), index, depth, [F.col("score").desc(), F.col("met")])


RANKERS: dict[str, Ranker] = {"bm25": bm25, "vsm": vsm, "bim": bim, "lm_dirichlet": lm_dirichlet, "hybrid_rrf": rrf, "rocchio_prf": rocchio, "rm3": rm3}


def rank(index: Index, queries: DataFrame, model: str | Ranker, depth: int = 25, **params) -> DataFrame:
    """Rank all documents for all queries (query_id, text). model: an id of RANKERS, or a ranker of one's own."""
    ranker = RANKERS[model] if isinstance(model, str) else model
    return ranker(index, query_terms(queries), depth, **params)
