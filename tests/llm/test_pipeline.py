"""The stages against plain versions, each on what the one before kept."""

import re
from collections import Counter

import public_tokenizers
import pytest
from tokenizers import Tokenizer

pipeline = pytest.importorskip("corpus_pipeline")
from test_similarity import components  # noqa: E402

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = [docs]
    for _, stage in pipeline.STAGES:
        kept.append(pipeline.materialize(stage(spark, kept[-1], SF), "test"))
    good, distinct, near, mixed, tokens = kept[1:]
    assert all(d.columns == COLUMNS for d in (good, distinct, near, mixed))

    quality = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    ids = {r["doc_id"] for r in good.collect()}
    clean = [i for i, v in quality.items() if v == 1]
    junk = [i for i, v in quality.items() if v == 0]
    assert sum(i in ids for i in clean) / len(clean) > 0.9 and sum(i in ids for i in junk) / len(junk) < 0.3

    first = {}
    for r in sorted(good.collect(), key=lambda r: r["doc_id"]):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r["text"] or ""), r["doc_id"])
    assert sorted(r["doc_id"] for r in distinct.collect()) == sorted(first.values())

    rows = [(r["doc_id"], r["text"]) for r in distinct.collect()]
    stay = sorted(i for i, _, c in components(rows) if i == c)
    assert sorted(r["doc_id"] for r in near.collect()) == stay

    have = Counter(r["doc_id"] for r in mixed.collect())
    assert set(have) <= set(stay) and max(have.values()) <= 3

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    text = {r["doc_id"]: r["text"] for r in mixed.collect()}
    got = tokens.collect()
    assert Counter(r["doc_id"] for r in got) == have
    assert all(r["n_tokens"] == len(library.encode(text[r["doc_id"]], add_special_tokens=False).ids) for r in got)


def test_run(spark):
    out = pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and out.count() > 0


ODD = "doc_id long, text string, source string, _n string, row_number string, Quality_Score string, copies string, copy int, times int, size string, target string, component_id string, keep_id string, chunk string, n string"


def odd(spark, rows):
    return spark.createDataFrame([(i, t, s, *"abcd", 1, 2, *"efghij") for i, t, s in rows], ODD)


LONG = " ".join(f"l{i}" for i in range(9000))
ODD_ROWS = [
    (1, "alpha beta", "a"), (1, "gamma delta", "a"), (0, "gamma delta", "a"), (5, "eps z", None), (5, "eps z", None), (None, "alpha beta", "b"), (None, "only null", "b"), (None, "only null", "b"),
    (7, None, "b"), (8, "", "b"), (9, " \n", "b"), (10, LONG, "a"), (11, LONG + " end", "a"), (None, "start " + LONG, None), (12, "word " * 30, "c"), (12, "word " * 30, "c"),
]


def first_of_each(rows, key):
    """One row for each key: the one with the smallest id, null ids last."""
    out = {}
    for i, t, s in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        out.setdefault(key(i, t), (i, t, s))
    return Counter(out.values())


def test_exact_copies_of_odd_rows(spark):
    got = pipeline.drop_copies(spark, odd(spark, ODD_ROWS), SF)
    assert got.columns == odd(spark, []).columns
    assert Counter((r["doc_id"], r["text"], r["source"]) for r in got.collect()) == first_of_each(ODD_ROWS, lambda i, t: re.sub(r"[\x20\x09-\x0D]+", " ", t or ""))


def test_near_copies_of_odd_rows(spark):
    rows = [r for r in ODD_ROWS if r[1] and r[1].strip()]
    got = pipeline.drop_near_copies(spark, odd(spark, ODD_ROWS), SF)
    assert got.columns == odd(spark, []).columns
    near = {LONG: "long", LONG + " end": "long", "start " + LONG: "long"}
    empty = Counter((i, t, s) for i, t, s in ODD_ROWS if not (t and t.strip()))
    assert Counter((r["doc_id"], r["text"], r["source"]) for r in got.collect()) == first_of_each(rows, lambda i, t: near.get(t, t)) + empty


def test_mix_of_odd_rows(spark):
    docs = odd(spark, ODD_ROWS)
    got = pipeline.mix(spark, docs, SF)
    rows = Counter((r["doc_id"], r["text"], r["source"]) for r in got.collect())
    have = Counter(ODD_ROWS)
    assert got.columns == docs.columns and set(rows) <= set(have) and all(n <= 3 * have[r] for r, n in rows.items())
    assert not any(t is None or not t.strip() for _, t, _ in rows)
    words = lambda c: sum(n * len(t.split()) for (_, t, _), n in c.items() if t)
    assert 0.5 * words(have) < words(rows) < 2 * words(have)


def test_quality_of_odd_rows(spark):
    docs = odd(spark, ODD_ROWS)
    got = pipeline.keep_quality(spark, docs, SF)
    assert got.columns == docs.columns and Counter(map(tuple, got.collect())) <= Counter(map(tuple, docs.collect()))


def test_tokens_of_odd_rows(spark):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = Counter((r["doc_id"], r["n_tokens"]) for r in pipeline.tokenize(spark, odd(spark, ODD_ROWS), SF).collect())
    assert got == Counter((i, len(library.encode(t or "", add_special_tokens=False).ids)) for i, t, _ in ODD_ROWS)


@pytest.mark.parametrize("name", [name for name, _ in pipeline.STAGES])
def test_empty_stage(spark, name):
    docs = odd(spark, [])
    got = dict(pipeline.STAGES)[name](spark, docs, SF)
    assert got.count() == 0 and (name == "BPE encoding" or got.columns == docs.columns)


def test_mix_meets_targets(spark):
    """Long documents of sources whose ratio of target to size is on either side of a half."""
    rows = [(i, " ".join(["w"] * (640 + i % 400 if i % 2 else 40 + i % 60)), "abc"[i % 3]) for i in range(900)]
    rows += [(900 + i, " ".join(["w"] * (700 + i)), None) for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    plan = {r["source"]: r["target"] for r in pipeline.mix_sources(docs).collect()}
    words, size, long, longest = Counter(), {i: len(t.split()) for i, t, _ in rows}, Counter(), Counter()
    for r in pipeline.mix(spark, docs, SF).collect():
        words[r["source"]] += size[r["doc_id"]]
        long[r["source"]] += size[r["doc_id"]] >= 640
    for i, _, s in rows:
        longest[s] = max(longest[s], size[i])
    for s, target in plan.items():
        assert abs(words[s] - target) <= longest[s] + 64, s
        have, ratio = sum(size[i] >= 640 for i, _, x in rows if x == s), target / sum(size[i] for i, _, x in rows if x == s)
        assert 0.7 * ratio < long[s] / have < 1.3 * ratio, s
    assert any(t / sum(size[i] for i, _, x in rows if x == s) < 0.5 for s, t in plan.items())
