"""Paged search, suggestions, documents, models and labelled queries: what a search front end asks for."""

from __future__ import annotations

import math
import re
from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.evaluate import discount, flagged
from ..operators.explain import TITLES
from ..operators.rank import RANKERS, met, query_terms, rank
from ..sources.collections import query_texts
from ..storage import materialize
from .index import Index

#: Paging and suggestion limits.
PAGE_SIZE, MAX_PAGE_SIZE, MAX_DEPTH, MAX_PAGES = 5, 50, 2000, 5
SUGGEST_LIMIT, SUGGEST_CAP, SUGGEST_MIN_CHARS, SUGGEST_EXTRA_WORDS, SUGGEST_MAX_WORDS = 8, 12, 2, 6, 48


def depth_needed(page: int, page_size: int) -> int:
    return max(page_size, min(MAX_PAGES * page_size, MAX_DEPTH), min(page * page_size, MAX_DEPTH))


def page_rows(index: Index, queries: DataFrame, ranking: DataFrame, qrels: DataFrame, page: int = 1, page_size: int = PAGE_SIZE) -> DataFrame:
    """The hits of a page for every query, with display strings and measures; page is clamped to each query's pages.

    Relevance measures are null for queries without judgments."""
    terms, ranking = query_terms(queries), materialize(ranking, "ranking")
    per_query = terms.groupBy("query_id").agg(F.count("*").alias("query_terms"))
    matched = met(index, terms.select("query_id", "term"), ranking).groupBy("query_id", "pos").agg(F.count("*").alias("matched_terms"))
    depth = ranking.groupBy("query_id").agg(F.count("*").alias("depth"))
    pages = F.least(F.lit(MAX_PAGES), F.greatest(F.lit(1), F.ceil(F.col("depth") / page_size)))
    rows = flagged(ranking, qrels).join(depth.withColumn("pages", pages), "query_id").withColumn("page", F.greatest(F.lit(1), F.least(F.lit(page), F.col("pages"))))
    rows = rows.where(F.col("rank").between((F.col("page") - 1) * page_size + 1, F.col("page") * page_size))
    rows = materialize(rows, "page")  # small as read back, so it goes to the texts, which stay where they are
    texts = index.texts.join(rows.select("doc_id").distinct(), "doc_id", "left_semi")
    rows = rows.join(index.docs.select("pos", "dl"), "pos").join(texts, "doc_id").join(matched, ["query_id", "pos"], "left").join(per_query, "query_id").crossJoin(F.broadcast(index.corpus.select("adl")))
    judged = F.col("total_relevant") > 0
    return rows.select(
        "query_id", "page", F.col("pages").alias("pager_total_pages"), "depth", "rank", "doc_id", "score", T.title(F.col("doc_id"), F.col("text")).alias("title"), T.snippet(F.col("text")).alias("snippet"),
        F.col("dl").alias("doc_tokens"), F.when(F.col("adl") > 0, F.round(F.col("dl") / F.col("adl"), 4)).otherwise(0.0).alias("length_ratio"),
        F.coalesce("matched_terms", F.lit(0)).cast("long").alias("matched_terms"), "query_terms", F.round(F.coalesce("matched_terms", F.lit(0)) / F.col("query_terms"), 4).alias("term_coverage"),
        F.when(judged, F.col("relevant") == 1).alias("relevant"), F.when(judged, F.round(F.col("hits") / F.col("rank"), 6)).alias("precision_at_rank"),
        F.when(judged, F.round(F.col("hits") / F.col("total_relevant"), 6)).alias("recall_at_rank"),
        F.when(judged, F.round(F.when(F.col("relevant") == 1, discount(F.col("rank"))).otherwise(0.0), 6)).alias("dcg_increment"),
    )


def search(index: Index, query: str, model: str = "bm25", page: Any = 1, page_size: Any = PAGE_SIZE, query_id: str | None = None, qrels: DataFrame | None = None) -> tuple[dict[str, Any], int]:
    """One page for one query as a payload and a status (200, or 400 with an error)."""
    query = (query or "").strip()
    if not query:
        return {"error": "empty_query"}, 400
    if model not in RANKERS:
        return {"error": "unknown_model"}, 400
    page, page_size = max(1, _int(page, 1)), max(1, min(_int(page_size, PAGE_SIZE), MAX_PAGE_SIZE))
    spark = index.docs.sparkSession
    key = str(query_id).strip() if query_id else None
    queries = spark.createDataFrame([(key or "q", query)], "query_id string, text string")
    own = (qrels if qrels is not None else spark.createDataFrame([], "query_id string, doc_id string")).where(F.col("query_id").cast("string") == (key or ""))
    total = own.select("doc_id").distinct().count() if key else 0
    ranking = rank(index, queries, model, depth_needed(page, page_size))
    hits = [r.asDict() for r in page_rows(index, queries, ranking, own, page, page_size).orderBy("rank").collect()]
    depth = hits[0]["depth"] if hits else 0
    pages = min(MAX_PAGES, max(1, math.ceil(depth / page_size)))
    page = max(1, min(page, pages))
    shown = ("doc_id", "rank", "score", "title", "snippet")
    results = [{k: h[k] for k in shown} | {"metrics": {k: h[k] for k in h if k not in ("query_id", "title", "snippet", "page", "pager_total_pages", "depth")}} for h in hits]
    return {
        "query": query, "model": model, "page": page, "page_size": page_size, "returned": len(hits), "depth": depth, "has_more": page < pages, "pager_max_pages": MAX_PAGES, "pager_total_pages": pages,
        "query_id": key, "qrels_active": total > 0, "total_relevant_in_qrels": total, "results": results,
    }, 200


def _int(value: Any, default: int) -> int:
    try:
        return int(value)
    except (TypeError, ValueError):
        return default


def fuzzy_cutoff(n: int) -> float:
    return 0.45 if n <= 2 else 0.30 if n <= 4 else 0.26


def suggestions(queries: DataFrame, typed: str, limit: Any = SUGGEST_LIMIT) -> DataFrame:
    """(place, text): questions that complete or resemble what was typed. All stems of it must occur, or, if that finds
    nothing, all but one."""
    spark, raw = queries.sparkSession, typed.strip()
    limit = max(1, min(_int(limit, SUGGEST_LIMIT), SUGGEST_CAP))
    if len(raw) < SUGGEST_MIN_CHARS:
        return spark.createDataFrame([], "place int, text string")
    own = spark.createDataFrame([(raw,)], "text string").select(T.stems(F.col("text")).alias("s")).first()["s"]
    budget = min(len(raw.split()) + SUGGEST_EXTRA_WORDS, SUGGEST_MAX_WORDS)
    texts = query_texts(queries).where(T.is_question(F.col("text")) & (T.word_count(F.col("text")) <= budget))
    texts = texts.groupBy(F.lower("text")).agg(F.min("text").alias("text")).select("text")  # the first of those that differ in case only
    found = F.filter(F.lit(own or [""]), lambda s: F.array_contains(F.col("stems"), s))
    prefix = F.startswith(F.lower("text"), F.lit(raw.lower()))
    rows = texts.withColumn("stems", T.stems(F.col("text"))).withColumn("hits", F.size(found) if own else F.lit(0))
    least = [len(own), max(1, len(own) - 1)] if own else [0]
    rows = rows.where(F.col("hits") >= least[-1]).withColumn("fuzzy", T.fuzzy_scores(raw, F.col("text")))  # the slow score for what passed the rest
    rows = rows.where(F.col("fuzzy") >= fuzzy_cutoff(len(raw))).withColumn("score", F.col("fuzzy") + F.when(prefix, 0.5).otherwise(0.0))
    shown = F.when(prefix, F.concat(F.lit(raw), F.expr(f"substring(text, {len(raw) + 1})"))).otherwise(F.col("text"))
    order = [F.desc("hits"), F.desc("score"), F.length("text"), F.lower("text")]
    # texts with all stems come first, so the first rows say whether there are any; of the rows that are shown alike the
    # first stays, and those differ from each other in case at most, which texts no longer do
    head = rows.select("hits", shown.alias("text"), F.row_number().over(Window.orderBy(*order)).alias("place")).where(F.col("place") <= limit)
    best = F.max("hits").over(Window.partitionBy())
    return head.withColumn("best", best).where((F.col("hits") >= least[0]) | (F.col("best") < least[0])).select("place", "text").orderBy("place")


def document(index: Index, doc_id: str) -> tuple[dict[str, Any], int]:
    row = index.texts.where(F.col("doc_id") == doc_id.strip()).select("doc_id", T.title(F.col("doc_id"), F.col("text")).alias("title"), "text", F.length("text").alias("char_count")).first()
    return (row.asDict(), 200) if row else ({"error": "unknown_doc"}, 404)


def models() -> dict[str, Any]:
    return {"models": [{"id": m, "title": TITLES[m]} for m in RANKERS], "default": "bm25"}


def parse_labeled_query(line: str, lookup: dict[str, str] | None = None) -> tuple[str | None, str]:
    """(label, text) of `@id`, `label | text`, `label TAB text`, `number: text`, or plain text."""
    line = line.strip()
    if line.startswith("@"):
        text = (lookup or {}).get(line[1:].strip())
        return (None, "") if text is None else (line[1:].strip(), text)
    for mark in ("|", "\t"):
        label, found, text = line.partition(mark)
        if found and label.strip() and text.strip():
            return label.strip(), text.strip()
    number = re.match(r"^(\d+)\s*:\s*(.+)$", line, re.DOTALL)
    return (number[1], number[2].strip()) if number else (None, line)


def parse_labeled_queries(lines: DataFrame, lookup: DataFrame) -> DataFrame:
    """The same for a column `line`; lookup: (query_id, text)."""
    line = T._strip(F.col("line"))
    split = lambda mark: (T._strip(F.substring_index(line, mark, 1)), T._strip(F.expr("substring(_l, locate('" + mark.replace("\t", "\\t") + "', _l) + 1)")))
    (bar, bar_text), (tab, tab_text) = split("|"), split("\t")
    number = r"^(\d+)\s*:\s*((?s:.+))$"
    rows = lines.withColumn("_l", line).withColumn("_id", F.when(F.startswith(line, F.lit("@")), T._strip(F.substring(F.col("_l"), 2, 1 << 30))))
    rows = rows.join(lookup.select(F.col("query_id").alias("_id"), F.col("text").alias("_text")), "_id", "left")
    has = lambda mark, a, b: F.contains(F.col("_l"), F.lit(mark)) & (a != "") & (b != "")
    label = F.when(F.col("_id").isNotNull(), F.when(F.col("_text").isNotNull(), F.col("_id"))).when(has("|", bar, bar_text), bar).when(has("\t", tab, tab_text), tab)
    label = label.when(F.col("_l").rlike(number), F.regexp_extract("_l", number, 1))
    text = F.when(F.col("_id").isNotNull(), F.coalesce("_text", F.lit(""))).when(has("|", bar, bar_text), bar_text).when(has("\t", tab, tab_text), tab_text)
    text = text.when(F.col("_l").rlike(number), T._strip(F.regexp_extract("_l", number, 2))).otherwise(F.col("_l"))
    return rows.select("line", label.alias("label"), text.alias("text"))
