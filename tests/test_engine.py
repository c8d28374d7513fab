import math
import re
from collections import Counter, defaultdict

import pytest

from lexirank.functions import text as T
from lexirank.functions.porter import stem
from lexirank.functions.stopwords import english
from lexirank.operators import evaluate as ev
from lexirank.operators import explain as ex
from lexirank.operators import rank as r
from lexirank.plans import search as s
from lexirank.plans.index import Index, build_index, require_unique

DOCS = [("d1", "cat dog cat"), ("d2", "dog fish"), ("d3", "fish bird bird fish cat"), ("d4", "the of"), ("d5", "bird")]
GOLD = {
    "bm25": [("d3", 1.444228414), ("d1", 1.119785594), ("d2", 0.912811006)],
    "vsm": [("d3", 0.733879620), ("d1", 0.608845099), ("d2", 0.5)],
    "bim": [("d3", 0.810930216), ("d1", 0.405465108), ("d2", 0.405465108)],
    "lm_dirichlet": [("d1", -1.297121899), ("d2", -1.298450830), ("d3", -2.598068113)],
    "rocchio_prf": [("d3", 0.763034085), ("d1", 0.635868449), ("d2", 0.538522866), ("d5", 0.047758436)],
    "rm3": [("d3", 0.552415098), ("d1", 0.439177168), ("d2", 0.372174003), ("d5", 0.108740117)],
    "hybrid_rrf": [("d3", 0.049180328), ("d1", 0.048387097), ("d2", 0.047619048), ("d5", 0.015625)],
}


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index"))
    build_index(spark.createDataFrame(DOCS, "doc_id string, text string"), path=path)
    return Index.load(spark, path)


@pytest.fixture(scope="module")
def queries(spark):
    return spark.createDataFrame([("q", "cat fish zebra"), ("none", "the zebra"), ("empty", "")], "query_id string, text string")


@pytest.fixture(scope="module")
def qrels(spark):
    return spark.createDataFrame([("q", "d1", 1), ("q", "d4", 0), ("q", "d4", 1)], "query_id string, doc_id string, relevance int")


@pytest.mark.parametrize("model", list(GOLD))
def test_golden(index, queries, model):
    rows = r.rank(index, queries, model, 10).orderBy("query_id", "rank").collect()
    assert {x["query_id"] for x in rows} == {"q"}  # no row for queries without a known word
    assert [(x["doc_id"], round(x["score"], 9)) for x in rows] == [(d, pytest.approx(v, abs=1e-9)) for d, v in GOLD[model]]
    assert [x["rank"] for x in rows] == list(range(1, len(rows) + 1))


def test_index(index):
    docs = {x["doc_id"]: x for x in index.docs.collect()}
    assert docs["d4"]["dl"] == 0 and docs["d4"]["norm"] == 0.0
    corpus = index.corpus.first()
    assert (corpus["n"], corpus["adl"], corpus["total_tokens"]) == (5, 2.2, 11)


def test_forward_table(spark, index):
    """The forward table has the postings by document, and feedback reads only the folders it needs."""
    want = {(x["pos"], x["term"], x["tf"], x["first_pos"], x["dl"]) for x in index.postings.collect()}
    rows = index.forward.collect()
    assert {(x["pos"], t["term"], t["tf"], t["first_pos"], x["dl"]) for x in rows for t in x["bag"]} == want and {x["pos"] for x in rows} == set(range(5))
    feedback = spark.createDataFrame([("q", 2, 1)], "query_id string, pos long, rank int")
    held = r.feedback_terms(index, feedback)
    assert {(x["query_id"], x["pos"], x["term"], x["tf"]) for x in held.collect()} == {("q", p, t, tf) for p, t, tf, _, _ in want if p == 2}
    assert "dynamicpruning" in held._jdf.queryExecution().executedPlan().toString().lower()


def test_bags_against_counting(spark):
    texts = ["cats cat running run the a", None, "", "of the", "x1 x1 dogs " * 50]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string").select("i", T.stem_bag(T.kept_tokens(T.F.col("text"))).alias("b"), T.stems(T.F.col("text")).alias("s")).orderBy("i").collect()
    for x in got:
        assert {t["term"]: t["tf"] for t in x["b"]} == Counter(x["s"]) and all(x["s"].index(t["term"]) == t["first_pos"] for t in x["b"])
    assert got[0]["s"] == ["cat", "cat", "run", "run"]
    nothing = spark.createDataFrame([(None,)], "w array<string>").select(T.stem_all("w").alias("s"), T.stem_bag("w").alias("b")).first()
    assert nothing["s"] is None and nothing["b"] == []


def test_passages_of_any_length(spark):
    from lexirank.queries import passages

    docs = [("1", "one two three four five six seven eight nine ten"), ("2", "twofold xone two threefold"), ("3", "none"), ("4", None), ("5", "a one two  three b")]
    asked = ["one two three four five six seven eight nine", "one two three", "one two", "one", "", "  ", None, "two three four", "six seven eight nine ten", "two  three"]
    got = passages(spark.createDataFrame(docs, "doc_id string, text string"), spark.createDataFrame([(str(i), t) for i, t in enumerate(asked)], "query_id string, text string")).collect()
    want = Counter((str(i), d) for i, q in enumerate(asked) if q and q.strip() for d, t in docs if t and q in t)
    assert Counter(map(tuple, got)) == want


def test_explain_statuses(index):
    assert ex.explain_request(index, " ", "d1") == ({"error": "missing_q_or_doc"}, 400) and ex.explain_request(index, "cat", None)[1] == 400
    assert ex.explain_request(index, "cat", "d1", "nope")[1] == 400 and ex.explain_request(index, "cat", "d9")[1] == 404
    assert ex.explain_request(index, "zebra", "d1", "rm3") == ({"error": "no_pass1"}, 200)
    out, status = ex.explain_request(index, "cat fish", "d1", "lm_dirichlet")
    assert status == 200 and {t["term"]: t.get("note") for t in out["terms"]} == {"cat": None, "fish": ex.NOT_IN_DOC}


def test_long_queries_are_shown_whole_and_documents_cut(spark, tmp_path):
    long = "cat " * 40_000
    index = build_index(spark.createDataFrame([("d", long), ("e", "dog")], "doc_id string, text string"), path=str(tmp_path))
    out = ex.build_explanation(index, long, "d", "bm25")
    assert "".join(x["text"] for x in out["query_segments"]) == long.strip() and out["document_truncated"]
    assert "".join(x["text"] for x in out["document_segments"]) == long[: ex.MAX_CHARS]


def test_grid_against_every_pair(spark, index, queries, qrels):
    """Leaving documents out by their bounds changes no pair's ranking."""
    for depth in (1, 2, 25):
        for row in ev.grid_search(index, queries, qrels, (0.1, 1.5, 9.0), (0.0, 0.5, 1.0), depth).collect():
            changed = Index(index.docs, index.forward, index.postings, index.terms, index.corpus.withColumns({"k1": T.F.lit(row["k1"]), "b": T.F.lit(row["b"])}))
            assert row["map"] == pytest.approx(ev.means(ev.evaluate(changed, queries, qrels, "bm25", depth)).first()["map"])


def test_report_keeps_the_order_of_queries(spark):
    queries = spark.createDataFrame([(q, f"{q} " * 40) for q in ("z", "a", "m")], "query_id string, text string").coalesce(1)
    per = spark.createDataFrame([("a", "a " * 40, 0.5), ("m", "m " * 40, 0.9), ("z", "z " * 40, 0.5)], "query_id string, query string, ap double")
    assert [x["query_id"] for x in ev.report(per, queries).collect()] == ["m", "z", "a"] and [x["query_id"] for x in ev.report(per).collect()] == ["m", "a", "z"]


def test_own_rankers_are_fused(index, queries):
    terms = r.query_terms(queries)
    got = [(x["doc_id"], x["score"]) for x in r.rrf(index, terms, 5, [r.vsm, r.bim]).orderBy("rank").collect()]
    lists = [{x["doc_id"]: x["rank"] for x in f(index, terms, 10).collect()} for f in (r.vsm, r.bim)]
    want = {d: sum(1 / (60 + ranks[d]) for ranks in lists if d in ranks) for ranks in lists for d in ranks}
    assert dict(got) == pytest.approx(want) and [s for _, s in got] == sorted(want.values(), reverse=True)


def test_alpha_has_no_effect(index, queries):
    terms = r.query_terms(queries)
    a, b = (r.rocchio(index, terms, 10, alpha=x).orderBy("rank").collect() for x in (0.1, 0.9))
    assert a == b


def test_evaluation(index, queries, qrels):
    rows = {x["query_id"]: x for x in ev.evaluate(index, queries, qrels, "bm25").collect()}
    assert rows["q"]["ap"] == 0.25 and rows["q"]["p5"] == 0.2 and rows["q"]["ndcg10"] == pytest.approx(0.386852807)
    assert rows["empty"]["ap"] == 0.0
    assert ev.means(ev.evaluate(index, queries, qrels, "lm_dirichlet")).first()["map"] == pytest.approx(0.5 / 3)
    grid = ev.grid_search(index, queries, qrels).collect()
    assert len(grid) == 25 and (grid[0]["k1"], grid[0]["b"]) == (0.9, 0.3)


@pytest.mark.parametrize("model", [m for m in GOLD if m != "hybrid_rrf"])
def test_explanations_add_up(index, model):
    out = ex.build_explanation(index, " cat fish zebra ", "d3", model.upper())
    assert out["total_score"] == pytest.approx(dict(GOLD[model])["d3"])
    assert {t["term"]: t["status"] for t in out["terms"]}["zebra"] == ("missing_in_doc" if model in ("vsm", "rocchio_prf") else "oov_index")
    assert "".join(x["text"] for x in out["document_segments"]) == DOCS[2][1]


def test_explanation_errors(index):
    assert ex.build_explanation(index, "cat", "d9", "bm25") == {"error": "unknown_doc"}
    assert ex.build_explanation(index, "cat", "d1", "nope") == {"error": "unknown_model"}
    assert ex.build_explanation(index, "zebra", "d1", "rm3") == {"error": "no_pass1"}
    fused = ex.build_explanation(index, "cat", "d9", "hybrid_rrf")
    assert fused["total_score"] == 0 and all(f["rank"] is None for f in fused["fusion"])


def test_search(index, qrels):
    out, status = s.search(index, "cat fish", page=9, page_size=2, query_id="q", qrels=qrels)
    assert status == 200 and out["page"] == 2 and out["depth"] == 3 and out["returned"] == 1 and not out["has_more"]
    assert out["qrels_active"] and out["total_relevant_in_qrels"] == 2 and out["results"][0]["metrics"]["relevant"] is False
    plain, _ = s.search(index, "cat", page="x", page_size=0)
    assert plain["results"][0]["metrics"]["precision_at_rank"] is None and plain["page_size"] == 1
    assert s.search(index, " ")[1] == 400 and s.search(index, "a", "nope")[0] == {"error": "unknown_model"}
    assert s.document(index, "d2")[0]["char_count"] == 8 and s.document(index, "x")[1] == 404


@pytest.mark.parametrize(("line", "want"), [("@659", ("659", "its text")), ("@nope", (None, "")), ("7 | a b", ("7", "a b")), ("7\ta b", ("7", "a b")), ("7: a b", ("7", "a b")), ("| a", (None, "| a")), ("x: a", (None, "x: a")), (" ", (None, ""))])
def test_labels(spark, line, want):
    assert s.parse_labeled_query(line, {"659": "its text"}) == want
    lookup = spark.createDataFrame([("659", "its text")], "query_id string, text string")
    row = s.parse_labeled_queries(spark.createDataFrame([(line,)], "line string"), lookup).first()
    assert (row["label"], row["text"]) == want


def test_suggestions(spark):
    texts = ["What is a cat?", "what is a CAT?", "What is a dog?", "How do birds fly", "Cats are nice.", "  "]
    queries = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "query_id string, text string")
    got = [x["text"] for x in s.suggestions(queries, "what is a c").collect()]
    assert got[0].lower() == "what is a cat?" and len(got) == len({g.lower() for g in got})
    assert [x["text"] for x in s.suggestions(queries, "cat").collect()] and s.suggestions(queries, "w").count() == 0


def plain_suggestions(texts, typed, limit=8):
    """The rules, one text at a time."""
    raw, stop = typed.strip(), english()
    own = [stem(w) for w in re.findall(r"\w+", raw.lower()) if len(w) > 1 and w not in stop]
    budget = min(len(raw.split()) + 6, 48)
    lead = re.compile("^(" + "|".join(T.QUESTION_WORDS) + r")\b", re.IGNORECASE)
    kept = {}
    for t in sorted({t.strip() for t in texts if t and t.strip()}):
        if (t.endswith("?") or lead.search(t)) and len(t.split()) <= budget:
            kept.setdefault(t.lower(), t)
    rows = []
    for t in kept.values():
        have = {stem(w) for w in re.findall(r"\w+", t.lower()) if len(w) > 1 and w not in stop}
        score = T.fuzzy_score(raw, t)
        if score >= s.fuzzy_cutoff(len(raw)):
            starts = t.lower().startswith(raw.lower())
            rows.append((-sum(w in have for w in own), -(score + 0.5 * starts), len(t), t.lower(), raw + t[len(raw) :] if starts else t))
    for least in ([len(own), max(1, len(own) - 1)] if own else [0]):
        found = sorted(x for x in rows if -x[0] >= least)
        if found:
            return [x[-1] for x in found[:limit]]
    return []


def test_suggestions_by_brute_force(spark):
    """On real texts: typed stop words, stems that all occur somewhere, and stems of which one is missing."""
    first = lambda t: t.split(".", 1)[0] + "."
    texts = [first(x["text"]) for x in spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").collect() if x["text"]]
    texts += [x["text"] for x in spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet").collect()] + ["Is heon ea of it?", "IS HEON ea of it?", "is heon onenth", " ", None]
    queries = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "query_id string, text string")
    some = [t for t in texts if t and t.lower().startswith("is ")][:2]
    hits = 0
    for typed in ["Is the", "is heon", "is heon zzzz", "zzzz yyyy", "are on", "wh", *[t[: len(t) // 2] for t in some]]:
        got = [x["text"] for x in s.suggestions(queries, typed).orderBy("place").collect()]
        assert got == plain_suggestions(texts, typed), typed
        hits += len(got)
    assert hits > 10


def test_duplicate_ids_are_refused(spark):
    with pytest.raises(ValueError):
        require_unique(spark.createDataFrame([("a",), ("a",)], "doc_id string"))


def test_stream(spark, index, tmp_path):
    from lexirank.streaming.queries import rank_stream

    spark.createDataFrame([("q", "cat fish zebra")], "query_id string, text string").write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema("query_id string, text string").json(str(tmp_path / "in"))
    rank_stream(index, stream, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3


def test_sources(spark, tmp_path):
    from lexirank.sources.collections import query_lookup, query_texts, read_qrels, read_queries, read_suggestion_texts

    (tmp_path / "dataset").mkdir()
    (tmp_path / "dataset" / "queries.json").write_text('[{"query_id": "1", "text": " b "}, {"query_id": "", "text": "A"}, {"query_id": "3", "text": " "}]')
    queries = read_queries(spark, str(tmp_path / "queries.json"))
    assert sorted(x["text"] for x in query_texts(queries).collect()) == ["A", "b"]
    assert query_lookup(queries).count() == 2
    (tmp_path / "queries.json").write_text('[{"query_id": "9", "text": "root"}]')
    assert read_queries(spark, str(tmp_path / "queries.json")).count() == 1 and read_suggestion_texts(spark, str(tmp_path / "queries.json")).count() == 3
    assert read_suggestion_texts(spark, str(tmp_path / "none.json")).count() == 0
    assert read_qrels(spark, str(tmp_path / "qrels.json"), optional=True).count() == 0
    with pytest.raises(FileNotFoundError):
        read_qrels(spark, str(tmp_path / "qrels.json"))


def test_bm25_against_plain_python(spark, tmp_path):
    """An independent loop over dictionaries, on real texts."""
    rows = [(str(x["doc_id"]), x["text"]) for x in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60).collect()]
    texts = [x["text"] for x in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").limit(3).collect()]
    stop = english()
    cut = lambda t: [stem(w) for w in re.findall(r"\w+", t.lower()) if len(w) > 1 and w not in stop]
    bags = {d: Counter(cut(t)) for d, t in rows}
    lengths = {d: sum(b.values()) for d, b in bags.items()}
    mean, df = sum(lengths.values()) / len(rows), Counter(t for b in bags.values() for t in b)
    index = build_index(spark.createDataFrame(rows, "doc_id string, text string"), path=str(tmp_path))
    got = defaultdict(dict)
    for x in r.rank(index, spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "query_id string, text string"), "bm25", 100).collect():
        got[x["query_id"]][x["doc_id"]] = x["score"]
    for i, text in enumerate(texts):
        want = defaultdict(float)
        for t, qf in Counter(cut(text)).items():
            for d, bag in bags.items():
                if t in bag:
                    idf = math.log((len(rows) - df[t] + 0.5) / (df[t] + 0.5) + 1)
                    want[d] += idf * bag[t] * 2.5 / (bag[t] + 1.5 * (0.25 + 0.75 * lengths[d] / mean)) * qf * 501 / (qf + 500)
        assert got[str(i)] == pytest.approx(dict(want))


def test_fusion_is_explained_to_full_depth(spark, tmp_path):
    """BM25's first document is beyond the first hundred of the vector model."""
    from lexirank.queries import QUERIES

    rare = " ".join(f"rare{i}" for i in range(60))
    rows = [(0, " ".join(["alpha " + rare] * 20))] + [(i, "beta") for i in range(1, 151)] + [(i, " ".join(f"other{i}x{j}" for j in range(60))) for i in range(151, 400)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "alpha beta")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {x["ranker"]: x for x in QUERIES["explain_hybrid_rrf"](spark, str(tmp_path)).where("doc_id = '0'").collect()}
    assert got["BM25"]["rank"] == 1
    assert got["VSM"]["rank"] == 151 and got["VSM"]["raw_score"] > 0 and got["VSM"]["rrf_component"] == pytest.approx(1 / 211, abs=1e-6)
