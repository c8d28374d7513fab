import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexirank.operators import evaluate as ev
from lexirank.operators import explain as ex
from lexirank.operators import rank as r
from lexirank.operators import scan
from lexirank.plans import search as s
from lexirank.plans.index import build_index

N = 3000


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    rows = [(f"{i:05d}", f"alpha beta {'gamma ' * (i % 7)} own{i}") for i in range(N)]
    return build_index(spark.createDataFrame(rows, "doc_id string, text string").repartition(4), path=str(tmp_path_factory.mktemp("index")))


@pytest.fixture(scope="module")
def queries(spark):
    return spark.createDataFrame([("p", "alpha beta"), ("q", "gamma alpha own17"), ("r", "zebra")], "query_id string, text string")


def most_shuffled(df):
    """The most rows that an exchange of df's plan moves, once it has run."""
    df.collect()
    most, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif name.endswith("QueryStageExec"):
            todo.append(node.plan())
        else:
            moved = node.metrics().get("shuffleRecordsWritten")
            most = max(most, moved.get().value() if moved.isDefined() else 0)
            todo += [node.children().apply(i) for i in range(node.children().size())]
    return most


@pytest.mark.parametrize("model", list(r.RANKERS))
def test_rankings_shuffle_no_postings(index, queries, model):
    """Every document has a word of each query; what is moved are some best ones a task."""
    assert most_shuffled(r.RANKERS[model](index, r.query_terms(queries), 5)) < N / 2


def test_the_grid_shuffles_no_postings(index, queries):
    qrels = queries.sparkSession.createDataFrame([("q", "00017")], "query_id string, doc_id string")
    grid = ev.grid_search(index, queries, qrels, (0.9, 1.5), (0.3, 0.9), 5)
    assert most_shuffled(grid) < N / 2 and grid.first()["map"] == pytest.approx(1 / 3)


@pytest.mark.parametrize("model", [m for m in r.RANKERS if m != "hybrid_rrf"])
def test_explanations_and_pages_read_their_documents_only(index, queries, model):
    terms, pairs = r.query_terms(queries), queries.sparkSession.createDataFrame([("q", "00017"), ("p", "00003")], "query_id string, doc_id string")
    rows = ex.explain_terms(index, terms, pairs, model)
    assert most_shuffled(rows) < N / 2 and rows.where("status = 'matched'").count() >= 5
    page = s.page_rows(index, queries, r.bm25(index, terms, 25), pairs, 2, 5)
    assert most_shuffled(page) < N / 2 and page.count() == 10


def test_a_large_batch_goes_in_groups(index, queries, monkeypatch):
    terms = r.query_terms(queries)
    for model in ("bm25", "vsm", "lm_dirichlet"):
        whole = r.RANKERS[model](index, terms, 30).orderBy("query_id", "rank").collect()
        with monkeypatch.context() as m:
            m.setattr(scan, "GROUP_KEPT", 20)
            assert r.RANKERS[model](index, terms, 30).orderBy("query_id", "rank").collect() == whole and len(whole) == 60


def test_ties_go_by_position_across_tasks(index, queries):
    got = r.bim(index, r.query_terms(queries).where("query_id = 'p'"), 40).orderBy("rank").collect()
    assert [x["pos"] for x in got] == list(range(40)) and len({x["score"] for x in got}) == 1


def test_best_against_sorting():
    rng = np.random.default_rng(1)
    key, pos = rng.integers(0, 40, 5000).astype(float), rng.permutation(5000)
    best = scan.Best(30)
    for i in range(0, 5000, 617):
        best.add(0, key[i : i + 617], pos[i : i + 617], key[i : i + 617])
    order = np.lexsort((pos, -key))[:30]
    assert best.held[0][0].tolist() == key[order].tolist() and best.held[0][1].tolist() == pos[order].tolist()


def test_pieces_are_bounded_and_whole(monkeypatch):
    monkeypatch.setattr(scan, "PIECE_TERMS", 10)
    lists = [["a"] * n for n in (3, 0, 25, 4, 6, 1, 0)] + [None]
    batch = pa.RecordBatch.from_arrays([pa.array(range(8)), pa.array(lists, pa.list_(pa.string()))], ["pos", "term"])
    assert [p.column("pos").to_pylist() for p in scan._pieces(batch)] == [[0, 1], [2], [3, 4], [5, 6, 7]]


def test_bags_of_long_batches(spark, monkeypatch):
    """Words become bags some at a time, with the same result."""
    from lexirank.functions import text as T

    texts = ["cats cat running run the a", None, "", "x1 x1 dogs " * 50, "dogs cats", "the"]
    docs = [w.split() if w else [] for w in texts]
    whole = T._bags(np.cumsum([0, *map(len, docs)]), *T._stemmed(pa.array([w for d in docs for w in d], pa.string())))
    monkeypatch.setattr(T, "BAG_WORDS", 7)
    run = T.stem_bag.func if hasattr(T.stem_bag, "func") else T.stem_bag
    ordered = lambda bags: [sorted(b, key=lambda t: t["first_pos"]) for b in bags.to_pylist()]
    assert ordered(run(pa.array(docs, pa.list_(pa.string())))) == ordered(whole)


def test_positions_are_dense_over_ranges(spark, tmp_path):
    ids = [7 * i % 1009 for i in range(1009)]
    index = build_index(spark.createDataFrame([(i, f"word{i}") for i in ids], "doc_id long, text string").repartition(5), path=str(tmp_path))
    assert [x["doc_id"] for x in index.docs.orderBy("pos").collect()] == [str(i) for i in range(1009)]
    assert index.docs.agg(F.max("pos"), F.min("pos"), F.countDistinct("pos")).first()[:] == (1008, 0, 1009)
    assert index.texts.count() == 1009


def test_rare_terms_meet_their_idf_apart(spark, tmp_path, monkeypatch):
    """Frequent terms take theirs where their postings are; the postings and the bags are the same either way."""
    from lexirank.plans import index as plan

    docs = spark.createDataFrame([(i, f"alpha {'beta ' * (i % 3)} own{i}" if i else None) for i in range(90)], "doc_id long, text string")
    built = []
    for n in (0, 10, 500_000):
        monkeypatch.setattr(plan, "FREQUENT", n)
        built.append(build_index(docs, path=str(tmp_path / str(n))))
    want = built[0].postings.orderBy("term", "pos").collect()
    assert len(want) == 89 * 2 + 60 and all(b.postings.orderBy("term", "pos").collect() == want for b in built[1:])
    bags = lambda b: {x["pos"]: (x["doc_id"], x["dl"], round(x["norm"], 9), sorted(t["term"] for t in x["bag"])) for x in b.forward.collect()}
    assert bags(built[0]) == bags(built[1]) == bags(built[2]) and bags(built[0])[0] == ("0", 0, 0.0, [])


def test_filtered_tokens_of_repeated_ids(spark, tmp_path):
    """Rows of one id count together, null ids too; the words of the others stay where they are."""
    from lexirank.queries import QUERIES

    rows = [(i, f"alpha beta alpha the word{i}", ) for i in range(2000)] + [(7, "alpha x1"), (None, "beta beta"), (None, "beta"), (9, None), (None, None)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    out = QUERIES["tokens_filtered"](spark, str(tmp_path))
    got = {(x["doc_id"], x["token"]): x["n"] for x in out.collect()}
    assert out.columns == ["doc_id", "token", "n"] and len(got) == 2000 * 3 + 2 == out.count()
    assert got[7, "alpha"] == 3 and got[7, "x1"] == 1 and got[None, "beta"] == 3 and got[9, "alpha"] == 2 and got[5, "word5"] == 1
    assert most_shuffled(out) < 100
