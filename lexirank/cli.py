"""Command line: build an index, search it, explain a score, or evaluate all models.

    python -m lexirank.cli build CORPUS INDEX
    python -m lexirank.cli search INDEX [--model bm25] [--queries FILE] LINE
    python -m lexirank.cli explain INDEX --doc ID [--model bm25] LINE
    python -m lexirank.cli evaluate INDEX QUERIES QRELS
    python -m lexirank.cli menu INDEX
"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions.text import console_snippet, query_echo
from .operators import evaluate as ev
from .operators.explain import build_explanation
from .operators.rank import RANKERS, rank
from .plans.index import Index, build_index, require_unique
from .plans.search import PAGE_SIZE, parse_labeled_query
from .session import local_session
from .sources.collections import query_lookup, read_corpus, read_qrels, read_queries


def show(spark: SparkSession, index: Index, model: str, label: str | None, text: str, depth: int = 25) -> None:
    """Print hits, five a page."""
    queries = spark.createDataFrame([(label or "q", text)], "query_id string, text string")
    print(queries.select(F.concat(F.lit(f"[{label}] " if label else ""), query_echo(F.col("text")))).first()[0])
    hits = rank(index, queries, model, depth).join(index.texts, "doc_id").select("rank", "doc_id", "score", console_snippet(F.col("text")).alias("snippet")).orderBy("rank").collect()
    for h in hits:
        if (h["rank"] - 1) % PAGE_SIZE == 0:
            print(f"--- page {(h['rank'] - 1) // PAGE_SIZE + 1} ---")
        print(f"{h['rank']:3d}. {h['doc_id']}  {h['score']:.6f}\n     {h['snippet']}")
    if not hits:
        print("no results")


def report(index: Index, queries, qrels) -> None:
    """The parameter grid, then every model's queries and means, then the comparison."""
    grid = ev.grid_search(index, queries, qrels)
    ev.grid_matrix(grid).show(truncate=False)
    best = grid.first()
    print(f"best: k1={best['k1']} b={best['b']} MAP={best['map']:.4f}")
    for model in RANKERS:
        print(model)
        for row in ev.report(ev.evaluate(index, queries, qrels, model), queries).toLocalIterator():
            print(f"{row['query_id']:>12}  {row['ap']:.4f}  {row['p5']:.4f}  {row['p10']:.4f}  {row['ndcg10']:.4f}  {row['query']}")
    for row in ev.compare(index, queries, qrels).orderBy("place").collect():  # a row per model
        print(f"{row['model']:>14}  {row['map']:.4f}  {row['mean_p5']:.4f}  {row['mean_p10']:.4f}  {row['mean_ndcg10']:.4f}{'  BEST' if row['best'] else ''}")


def menu(spark: SparkSession, index: Index, lookup: dict[str, str]) -> None:
    names = list(RANKERS)
    while True:
        print("  ".join(f"{i}) {n}" for i, n in enumerate(names, 1)), " 0) quit")
        choice = input("model: ").strip()
        if choice in ("", "0"):
            return
        if choice.isdigit() and 1 <= int(choice) <= len(names):
            label, text = parse_labeled_query(input("query: "), lookup)
            show(spark, index, names[int(choice) - 1], label, text) if text else print("empty query")


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="lexirank")
    p.add_argument("command", choices=["build", "search", "explain", "evaluate", "menu"])
    p.add_argument("args", nargs="*")
    p.add_argument("--model", default="bm25", choices=list(RANKERS))
    p.add_argument("--doc")
    p.add_argument("--queries")
    a = p.parse_args(argv)
    spark = local_session()
    if a.command == "build":
        corpus = read_corpus(spark, a.args[0])
        require_unique(corpus)
        build_index(corpus, path=a.args[1])
        return
    index = Index.load(spark, a.args[0])
    lookup = {r["query_id"]: r["text"] for r in query_lookup(read_queries(spark, a.queries)).collect()} if a.queries else {}
    if a.command == "evaluate":
        report(index, read_queries(spark, a.args[1]), read_qrels(spark, a.args[2]))
    elif a.command == "menu":
        menu(spark, index, lookup)
    else:
        label, text = parse_labeled_query(" ".join(a.args[1:]), lookup)
        print(json.dumps(build_explanation(index, text, a.doc or "", a.model), ensure_ascii=False, indent=1)) if a.command == "explain" else show(spark, index, a.model, label, text)


if __name__ == "__main__":
    main()
