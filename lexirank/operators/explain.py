"""Why a document has its score: one row per term of the query (or its expansion), and nested payloads for display."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import segments, stems
from ..plans.index import Index
from . import rank as r

#: Characters of a document that are cut into segments for display.
MAX_CHARS = 120_000
RRF_DEPTH = 400
#: Fixed value: what is said of a term that the language model passes over.
NOT_IN_DOC = "Retriever skips documents without postings for this term."
#: Titles of the models.
TITLES = {
    "bm25": "BM25 (Okapi)", "vsm": "Vector space model (TF-IDF cosine)", "bim": "Binary independence model", "lm_dirichlet": "Language model (Dirichlet smoothing)",
    "rocchio_prf": "Rocchio pseudo-relevance feedback + cosine", "rm3": "RM3 → BM25 rescoring", "hybrid_rrf": "Hybrid RRF",
}


def _rows(index: Index, weighted: DataFrame, pairs: DataFrame, parts: DataFrame, seen: bool = True) -> DataFrame:
    """weighted: (query_id, term, ...), pairs: (query_id, doc_id); parts: contributions. Adds status, tf_doc and the rest.

    seen: whether words outside the index have a status of their own."""
    asked = pairs.join(index.docs.select("doc_id", "pos", F.col("dl").alias("doc_len"), F.col("norm").alias("doc_norm")), "doc_id")
    every = weighted.join(asked, "query_id").join(r.known_terms(index, weighted).select("term", F.lit(True).alias("known")), "term", "left")
    rows = every.join(parts, ["query_id", "pos", "term"], "left")
    status = F.when(F.col("contribution").isNotNull(), "matched")
    if seen:
        status = status.when(F.col("known").isNull(), "oov_index")
    return rows.withColumn("status", status.otherwise("missing_in_doc")).withColumn("contribution", F.coalesce("contribution", F.lit(0.0)))


def explain_terms(index: Index, terms: DataFrame, pairs: DataFrame, model: str) -> DataFrame:
    """(query_id, doc_id, term, status, query_weight, doc_weight, contribution, ...) for each pair (query_id, doc_id).

    The contributions of a pair add up to its score, for vector models after division by both lengths."""
    own = pairs.select("query_id", "doc_id").distinct()
    terms = r.materialize(terms.join(own.select("query_id").distinct(), "query_id", "left_semi"), "asked")  # small as read back, so it goes to the vocabulary
    near = r.materialize(index.docs.select("doc_id", "pos").join(own, "doc_id").select("query_id", "pos"), "near")

    def of(parts: DataFrame, *cols: str) -> DataFrame:
        return parts.select("query_id", "pos", "term", *cols, "contribution")

    null = F.lit(None).cast("double")
    if model in ("bm25", "rm3"):
        weighted = terms if model == "bm25" else r.materialize(r.rm3_weights(index, terms), "rm3").withColumnRenamed("weight", "qf")
        weighted = weighted.crossJoin(F.broadcast(index.corpus.select("k2"))).withColumn("query_weight", r.bm25_query_component(F.col("qf"), F.col("k2")))
        weighted = r.materialize(weighted, "weighted")
        rows = _rows(index, weighted, own, of(r.bm25_parts(index, weighted.select("query_id", "term", "qf"), near), "tf", "doc_component"))
        rows = rows.join(r.known_terms(index, weighted).select("term", F.col("idf_bm25").alias("idf")), "term", "left")
        return _pick(rows, F.col("qf"), F.col("query_weight"), F.col("doc_component"), F.col("idf"))
    if model in ("vsm", "rocchio_prf"):
        vector = r.query_vector(index, terms).withColumn("from_feedback", F.lit(False)) if model == "vsm" else r.rocchio_vector(index, terms)
        vector = r.materialize(vector, "vector")
        rows = _rows(index, vector, own, of(r.vector_parts(index, vector.select("query_id", "term", "weight"), near), "tf", "tfidf"), seen=False)
        return _pick(rows, null, F.col("weight"), F.coalesce("tfidf", F.lit(0.0)), null, F.col("from_feedback"))
    if model == "bim":
        weighted = terms.join(r.known_terms(index, terms).select("term", "idf_bim"), "term", "left")
        rows = _rows(index, weighted, own, of(r.bim_parts(index, terms, near), "tf"))
        return _pick(rows, null, F.col("idf_bim"), null, null)
    if model == "lm_dirichlet":
        rows = _rows(index, terms, own, of(r.lm_parts(index, terms, near), "tf", "p_td"))
        return _pick(rows, F.col("qf"), F.col("qf"), F.log("p_td"), null)
    raise ValueError(f"no term rows for {model}")


def _pick(rows: DataFrame, qf: Column, query_weight: Column, doc_weight: Column, idf: Column, from_feedback: Column | None = None) -> DataFrame:
    return rows.select(
        "query_id", "doc_id", "term", "status", qf.alias("qf"), query_weight.alias("query_weight"), doc_weight.alias("doc_weight"), idf.alias("idf"), F.col("tf").alias("tf_doc"), "contribution",
        (F.lit(False) if from_feedback is None else from_feedback).alias("from_feedback"), "doc_len", "doc_norm",
    )


def explain_fusion(index: Index, terms: DataFrame, pairs: DataFrame, depth: int = RRF_DEPTH) -> DataFrame:
    """(query_id, doc_id, ranker, rank, raw_score, rrf_component): one row per ranker, rank null beyond depth. Pairs of
    unknown documents have rows as well. depth is not that of a search, so totals can differ from its scores."""
    names = F.explode(F.array(*[F.struct(F.lit(i).alias("ranker"), F.lit(n).alias("name")) for i, n in enumerate(("BM25", "VSM", "RM3"))]))
    asked = pairs.select("query_id", "doc_id").distinct().withColumn("n", names).select("query_id", "doc_id", "n.ranker", "n.name")
    parts = r.rrf_parts(index, terms, depth).select("query_id", "doc_id", "ranker", "rank", "raw", "component")
    out = asked.join(parts, ["query_id", "doc_id", "ranker"], "left")
    return out.select("query_id", "doc_id", F.col("name").alias("ranker"), "rank", F.coalesce("raw", F.lit(0.0)).alias("raw_score"), F.coalesce("component", F.lit(0.0)).alias("rrf_component"))


def rank_of(ranking: DataFrame, pairs: DataFrame) -> DataFrame:
    """Rank and score of each pair in a ranking; null and 0 where it is not in it."""
    return pairs.join(ranking.select("query_id", "doc_id", "rank", "score"), ["query_id", "doc_id"], "left").fillna(0.0, ["score"])


def document_text(index: Index) -> DataFrame:
    """(doc_id, text): texts as they are cut into segments for display, MAX_CHARS characters at most."""
    return index.texts.select("doc_id", F.substring("text", 1, MAX_CHARS).alias("text"))


def segment_rows(texts: DataFrame, contributing: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, ordinal, text, word, stem, hit) for (keys, text), where contributing has (keys, stems). A word's stem is null
    if it is a stop word or too short; hit: the stem is among the keys' stems."""
    keys = list(keys)
    cut = texts.join(contributing, keys, "left").select(*keys, "stems", F.posexplode(segments(F.col("text"))).alias("ordinal", "s"))
    cut = cut.select(*keys, "ordinal", "s.text", "s.word", "stems").withColumn("stem", F.when(F.col("word"), F.try_element_at(stems(F.lower("text")), F.lit(1))))
    hit = F.coalesce(F.array_contains("stems", F.col("stem")), F.lit(False))
    return cut.select(*keys, "ordinal", "text", "word", "stem", hit.alias("hit"))


def build_explanation(index: Index, query: str, doc_id: str, model: str) -> dict[str, Any]:
    """The payload for one query and document: total, constants, term rows in term order, and highlighted segments."""
    model, query, doc_id = model.strip().lower(), query.strip(), doc_id.strip()
    if model not in r.RANKERS:
        return {"error": "unknown_model"}
    spark = index.docs.sparkSession
    doc = index.docs.where(F.col("doc_id") == doc_id).join(index.texts, "doc_id").select("text", "dl", "norm").first()
    if doc is None and model != "hybrid_rrf":
        return {"error": "unknown_doc"}
    queries = spark.createDataFrame([("q", query)], "query_id string, text string")
    terms = r.query_terms(queries)
    pairs = spark.createDataFrame([("q", doc_id)], "query_id string, doc_id string")
    corpus = index.corpus.first().asDict()
    tokens = queries.select(stems(F.col("text")).alias("s")).first()["s"]
    out: dict[str, Any] = {"model": model, "title": TITLES[model], "doc_id": doc_id, "query": query, "query_tokens": tokens}
    if model == "hybrid_rrf":
        fusion = [row.asDict() for row in explain_fusion(index, terms, pairs).collect()]
        fusion = [{k: f[k] for k in ("ranker", "rank", "raw_score", "rrf_component")} for f in sorted(fusion, key=lambda f: ("BM25", "VSM", "RM3").index(f["ranker"]))]
        out |= {"constants": {"k_rrf": 60, "depth_searched": RRF_DEPTH}, "fusion": fusion, "terms": [], "total_score": sum(f["rrf_component"] for f in fusion)}
        matched = [] if doc is None else [x["term"] for x in explain_terms(index, terms, pairs, "bm25").where("status = 'matched'").select("term").collect()]
    else:
        if model == "rm3":
            first = r.first_pass(index, terms, 10)
            if first.isEmpty():
                return {"error": "no_pass1"}
            feedback = r.rm3_feedback(index, terms, first=first).orderBy("rank").collect()
            if not feedback:
                return {"error": "zero_mass"}
            if not tokens:
                return {"error": "empty_query"}
            out["feedback_docs"] = [{"doc_id": f["doc_id"], "p_feedback": round(f["p"], 8)} for f in feedback]
        rows = [x.asDict() for x in explain_terms(index, terms, pairs, model).orderBy("term").collect()]
        total = sum(x["contribution"] for x in rows)
        out["constants"] = {k: corpus[k] for k in ("k1", "b", "k2", "mu", "adl", "n")} | {"dl": doc["dl"]}
        if model in ("vsm", "rocchio_prf"):
            length = sum(x["query_weight"] ** 2 for x in rows) ** 0.5
            out["constants"] |= {"query_l2_norm": length, "doc_l2_norm": doc["norm"], "dot_product": total}
            total = total / (length * doc["norm"]) if length > 0 and doc["norm"] > 0 else 0.0
        if model == "rocchio_prf":
            best = r.rocchio_expansions(index, terms).orderBy("place").limit(12).collect()
            first = r.bm25(index, terms, 15).orderBy("rank").collect()
            out["expanded_terms_preview"] = [{"term": x["term"], "weight": round(x["weight"], 6)} for x in best]
            out["constants"] |= {"alpha": 0.4, "beta": 0.6, "fb_docs": 15, "fb_terms": 25, "pass1_bm25_docs": [x["doc_id"] for x in first]}
        if model == "rm3":
            out["constants"] |= {"lambda": 0.5, "fb_docs": 10, "fb_terms": 20}
        shown = [{k: v for k, v in x.items() if k not in ("query_id", "doc_id", "doc_len", "doc_norm") and v is not None} for x in rows]
        if model == "lm_dirichlet":
            shown = [x | {"note": NOT_IN_DOC} if x["status"] == "missing_in_doc" else x for x in shown]
        out |= {"terms": shown, "total_score": total}
        matched = [x["term"] for x in rows if x["status"] == "matched"]
    text = doc["text"] if doc else ""
    both = spark.createDataFrame([("query", query), ("doc", text[:MAX_CHARS])], "id string, text string")
    hits = spark.createDataFrame([(i, sorted(set(matched))) for i in ("query", "doc")], "id string, stems array<string>")
    cut = segment_rows(both, hits, ["id"]).orderBy("id", "ordinal").collect()
    out["contributing_stems"] = sorted(set(matched))
    out["query_segments"] = [{"text": s["text"], "word": True, "stem": s["stem"], "indexed": s["stem"] is not None, "contributing": s["hit"]} if s["word"] else {"text": s["text"], "word": False} for s in cut if s["id"] == "query"]
    out["document_truncated"] = len(text) > MAX_CHARS
    out["document_segments"] = [{"text": s["text"], "word": s["word"], "hit": s["hit"]} for s in cut if s["id"] == "doc"]
    return out


def explain_request(index: Index, q: str | None, doc_id: str | None, model: str | None = None) -> tuple[dict[str, Any], int]:
    """build_explanation as a payload and a status: 400 where something is missing or the model is unknown, 404 for an
    unknown document, else 200, also with an error of the feedback pass."""
    q, doc_id = (q or "").strip(), (doc_id or "").strip()
    if not q or not doc_id:
        return {"error": "missing_q_or_doc"}, 400
    out = build_explanation(index, q, doc_id, model or "bm25")
    return out, {"unknown_model": 400, "unknown_doc": 404}.get(out.get("error", ""), 200)
