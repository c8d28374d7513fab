"""The engine's queries by name, over documents as corpus, benchmark as queries, and verbatim passages as judgments."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as T
from .operators import evaluate as ev
from .operators import explain as ex
from .operators import rank as r
from .plans.index import Index, build_index
from .plans.search import depth_needed, page_rows, parse_labeled_queries, suggestions
from .storage import materialize

DEPTH = 25
_INNER = 6  # whole words inside a passage that candidates must hold, at most
#: What is typed where suggestions are asked for: words in all suggestions, a stem of some, and nothing but a stop word.
TYPED = ("Is the", "is ndsh", "are onre of erin")
_built: dict[tuple[str, str, str], Any] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def passages(documents: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, doc_id) where the document holds the query's text; a query without a word is in none.

    Whole words inside the text (all but its first and last) are the join key, so only documents that hold those are
    compared. A text of one or two words has none inside and is looked for in every document."""
    asked = queries.where(F.col("text").rlike(r"\S")).select("query_id", F.col("text").alias("passage"), (F.size(T.word_runs(1)("text")) - 2).alias("n"))
    asked = materialize(asked.withColumn("n", F.least("n", F.lit(_INNER))), "asked")
    lengths = sorted(r["n"] for r in asked.where("n > 0").select("n").distinct().collect())  # six numbers at most
    pairs = None
    for n in lengths:
        keys = materialize(asked.where(F.col("n") == n).select("query_id", F.element_at(T.word_runs(n)("passage"), 2).alias("key")), "keys")
        one = documents.select("doc_id", F.explode(T.word_runs(n)("text")).alias("key")).join(keys, "key").select("query_id", "doc_id")
        pairs = one if pairs is None else pairs.unionByName(one)
    short = documents.join(asked.where("n <= 0").select("query_id", "passage"), F.contains("text", F.col("passage"))).select("query_id", "doc_id")
    if pairs is None:
        return short
    pairs = materialize(pairs.distinct(), "held")  # seldom many, so read back they go to the texts
    both = pairs.join(documents.select("doc_id", "text"), "doc_id").join(asked.select("query_id", "passage"), "query_id")
    return both.where(F.contains("text", F.col("passage"))).select("query_id", "doc_id").unionByName(short)


def _once(what: str, spark: SparkSession, sf_dir: str, make: Callable[[], Any]) -> Any:
    """What a server would keep: made once in a session for a data folder."""
    key = (spark.sparkContext.applicationId, sf_dir, what)
    if key not in _built:
        _built[key] = make()
    return _built[key]


def index_of(spark: SparkSession, sf_dir: str) -> Index:
    return _once("index", spark, sf_dir, lambda: build_index(table(spark, sf_dir, "documents").select("doc_id", "text")))


def asked(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Queries and their terms."""
    queries = table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("query_id"), "text")
    return queries, _once("terms", spark, sf_dir, lambda: materialize(r.query_terms(queries), "query_terms"))


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    return _once("qrels", spark, sf_dir, lambda: materialize(passages(docs, asked(spark, sf_dir)[0]), "qrels"))


def setting(spark: SparkSession, sf_dir: str) -> tuple[Index, DataFrame, DataFrame, DataFrame]:
    """Index, queries, query terms and judgments of a data folder."""
    return index_of(spark, sf_dir), *asked(spark, sf_dir), judged(spark, sf_dir)


def _six(df: DataFrame) -> DataFrame:
    """Doubles to six digits; a negative zero becomes zero."""
    return df.select(*((F.round(c, 6) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def _ranking(model: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        index, (_, terms) = index_of(spark, sf_dir), asked(spark, sf_dir)
        return _six(r.RANKERS[model](index, terms, DEPTH).select("query_id", "doc_id", "rank", "score"))

    return run


def tokens_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each document has each token. A row's tokens are counted where they are; only those of rows that share
    their id, null ids too, come together."""
    docs = table(spark, sf_dir, "documents")
    shared = materialize(docs.groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("_id")), "shared")
    same = F.col("doc_id").eqNullSafe(F.col("_id"))
    counts = lambda rows: rows.select("doc_id", F.inline(T.word_bag(T.kept_tokens(F.col("text"))))).select("doc_id", F.col("term").alias("token"), F.col("tf").alias("n"))
    return counts(docs.join(shared, same, "left_anti")).unionByName(counts(docs.join(shared, same, "left_semi")).groupBy("doc_id", "token").agg(F.sum("n").alias("n")))


def stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "documents").select(F.explode(F.array_distinct(T.kept_tokens(F.col("text")))).alias("word")).distinct()
    return words.select("word", T.stem_all(F.array("word"))[0].alias("stem"))


def doc_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _six(index_of(spark, sf_dir).docs.select("pos", "doc_id", "dl", "norm"))


def corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _six(index_of(spark, sf_dir).corpus)


def term_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = index_of(spark, sf_dir).terms
    return terms.select("term", "df", "ctf", *(F.round(c, 6).alias(c) for c in ("idf_standard", "idf_smooth", "idf_bm25", "bim_pt", "p_collection")), (F.round("idf_bim", 6) + 0.0).alias("idf_bim"))


def postings_tfidf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _six(index_of(spark, sf_dir).postings.select("term", "pos", "tf", "tfidf", "dl"))


def rocchio_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, (_, terms) = index_of(spark, sf_dir), asked(spark, sf_dir)
    return _six(r.rocchio_expansions(index, terms))


def rm3_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, (_, terms) = index_of(spark, sf_dir), asked(spark, sf_dir)
    return _six(r.rm3_weights(index, terms))


def _metrics(spark: SparkSession, sf_dir: str, model: str) -> DataFrame:
    index, queries, terms, qrels = setting(spark, sf_dir)
    return ev.metrics(r.RANKERS[model](index, terms, DEPTH), queries, qrels)


def eval_per_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _six(_metrics(spark, sf_dir, "bm25").drop("query"))


def eval_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _six(ev.means(_metrics(spark, sf_dir, "vsm")))


def model_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, queries, _, qrels = setting(spark, sf_dir)
    return _six(ev.compare(index, queries, qrels, depth=DEPTH))


def bm25_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, queries, _, qrels = setting(spark, sf_dir)
    return _six(ev.grid_search(index, queries, qrels))


def judged_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(spark, sf_dir)


def search_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, queries, terms, qrels = setting(spark, sf_dir)
    ranking = r.bm25(index, terms, depth_needed(2, 5))
    return _six(page_rows(index, queries, ranking, qrels, 2, 5))


def _pairs(spark: SparkSession, sf_dir: str, model: str, depth: int = DEPTH) -> DataFrame:
    """What is explained: the model's own ranking of each query, and the corpus's first document, which it seldom has."""
    index, (_, terms) = index_of(spark, sf_dir), asked(spark, sf_dir)
    first = terms.select("query_id").distinct().crossJoin(F.broadcast(index.docs.where("pos = 0").select("doc_id")))  # one row
    return materialize(r.RANKERS[model](index, terms, depth).select("query_id", "doc_id").unionByName(first).distinct(), "pairs")


def _explanation(model: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        index, (_, terms) = index_of(spark, sf_dir), asked(spark, sf_dir)
        pairs = _pairs(spark, sf_dir, model)
        if model == "hybrid_rrf":
            return _six(ex.explain_fusion(index, terms, pairs))
        return _six(ex.explain_terms(index, terms, pairs, model).select("query_id", "doc_id", "term", "status", "query_weight", "tf_doc", "contribution", "from_feedback"))

    return run


def rank_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank and score of every judged document by BM25, null and 0 for those it does not return."""
    index, _, terms, qrels = setting(spark, sf_dir)
    return _six(ex.rank_of(r.bm25(index, terms, DEPTH), qrels))


def eval_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The per-query report of a ranker that is passed as a function."""
    index, queries, _, qrels = setting(spark, sf_dir)
    return _six(ev.report(ev.evaluate(index, queries, qrels, r.bim, DEPTH), queries))


def own_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fusion of rankers of the caller's."""
    index, (_, terms) = index_of(spark, sf_dir), asked(spark, sf_dir)
    return _six(r.rrf(index, terms, DEPTH, [r.lm_dirichlet, r.bim]).select("query_id", "doc_id", "rank", "score"))


def labelled_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels and texts of lines in all the ways to write them, made from the benchmark."""
    queries = table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("query_id"), "text")
    ways = [F.concat(F.lit("@"), "query_id"), F.concat_ws(" | ", "query_id", "text"), F.concat_ws("\t", "query_id", "text"), F.concat_ws(": ", "query_id", "text"), F.concat(F.lit("  "), F.col("text")), F.concat(F.lit("@none"), "query_id")]
    lines = queries.select(F.explode(F.array(*ways)).alias("line"))
    return parse_labeled_queries(lines, queries).select("line", "label", "text")


def shown_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25's scores as they are shown."""
    index, (_, terms) = index_of(spark, sf_dir), asked(spark, sf_dir)
    return r.bm25(index, terms, DEPTH).select("query_id", "doc_id", T.shown_number(F.round("score", 9)).alias("shown"))


def title_snippet(spark: SparkSession, sf_dir: str) -> DataFrame:
    text, doc_id = F.col("text"), F.col("doc_id").cast("string")
    return table(spark, sf_dir, "documents").select(doc_id.alias("doc_id"), T.title(doc_id, text).alias("title"), T.snippet(text).alias("snippet"), T.console_snippet(text).alias("console"), T.query_echo(text).alias("echo"), F.length(text).cast("long").alias("chars"))


def question_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.is_question(F.col("text")).alias("question"), T.word_count(F.col("text")).cast("long").alias("words"))


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each query, its first three documents and the corpus's first, the runs of characters, with those that contribute
    marked."""
    index, queries, terms, _ = setting(spark, sf_dir)
    pairs = _pairs(spark, sf_dir, "bm25", 3)
    matched = ex.explain_terms(index, terms, pairs, "bm25").where("status = 'matched'").groupBy("query_id", "doc_id").agg(F.collect_set("term").alias("stems"))
    docs = ex.segment_rows(pairs.join(ex.document_text(index), "doc_id"), matched, ["query_id", "doc_id"])
    own = terms.groupBy("query_id").agg(F.collect_set("term").alias("stems")).withColumn("doc_id", F.lit(""))
    both = docs.unionByName(ex.segment_rows(queries.withColumn("doc_id", F.lit("")), own, ["query_id", "doc_id"]))
    return both.select("query_id", "doc_id", "ordinal", "text", "word", "hit")


def paragraph_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.paragraphs(F.col("text"))).alias("place", "paragraph"))


def suggest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suggestions for each of TYPED, from the benchmark's texts and the first sentences of conversations."""
    first = F.concat(F.substring_index("text", ".", 1), F.lit("."))
    texts = table(spark, sf_dir, "benchmark").select("text").unionByName(table(spark, sf_dir, "conversations").select(first.alias("text")))
    rows = [suggestions(texts, typed).select(F.lit(typed).alias("typed"), "place", "text") for typed in TYPED]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        tokens_filtered, stems, doc_stats, corpus_stats, term_stats, postings_tfidf, rocchio_terms, rm3_terms, judged_pairs, eval_per_query, eval_means, model_comparison, bm25_grid, search_page, rank_lookup, eval_report, own_fusion, labelled_queries, shown_scores,
        title_snippet, question_filter, segments, paragraph_split, suggest,
    )
}
QUERIES |= {model: _ranking(model) for model in r.RANKERS}
QUERIES |= {f"explain_{model}": _explanation(model) for model in r.RANKERS}
