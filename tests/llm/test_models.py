"""Held-out accuracy and defined cases of the learned operators."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexirank.llm import language, line_rules, quality, toxicity
from lexirank.llm import queries as q

SF = "/root/testdata/sf0.01"
ODD = "doc_id long, text string, score string, label int"
TEXTS = [(1, None), (2, ""), (3, " \n\t "), (4, "12 34 !!"), (5, "word " * 50_000), (6, "日本語 テキスト"), (None, "the thing is here"), (1, None)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, "s", 0) for i, t in TEXTS], ODD)


@pytest.fixture(scope="module")
def labels(spark):
    return {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}


def held(i, parts, remainder):
    return zlib.crc32(str(i).encode()) % parts == remainder


@pytest.mark.parametrize(("name", "label", "parts", "remainder", "least"), [("op2_toxicity", "toxic", 5, 0, 0.9), ("op5_quality", "quality", 4, 2, 0.93)])
def test_held_out_accuracy(spark, labels, name, label, parts, remainder, least):
    rows = q.QUERIES[name](spark, SF).collect()
    assert all(r["held_out"] == held(r["doc_id"], parts, remainder) and 0 <= r["score"] <= 1 for r in rows)
    known = [(r["predicted"], labels[r["doc_id"]][label]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert sum(a == b for a, b in known) / len(known) >= least


def test_language_accuracy(spark):
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    rows = q.QUERIES["op4_language"](spark, SF).collect()
    own = [r for r in rows if r["held_out"]]
    assert len(rows) == len(lang) and sum(r["lang_pred"] == lang[r["doc_id"]] for r in own) / len(own) >= 0.97


def test_mixture_of_languages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language.train(docs, F.lit(True))
    pick = lambda l: " ".join(r["text"] for r in docs.where(F.col("lang") == l).orderBy("doc_id").limit(4).collect())[:3000]  # noqa: E731, E741
    both = spark.createDataFrame([(1, pick("en") + "\n" + pick("es")), (2, pick("de"))], "doc_id long, text string")
    got = {r["doc_id"]: {m["lang"]: m["share"] for m in r["mixture"]} for r in language.identify(both, model).collect()}
    assert set(got[1]) >= {"en", "es"} and min(got[1]["en"], got[1]["es"]) > 0.3 and got[2] == pytest.approx({"de": 1.0}, abs=0.1)


def test_language_cases(spark, odd):
    docs = spark.createDataFrame([(1, "the cat", "en"), (2, "le chat", "fr"), (3, "x", None)], "doc_id long, text string, lang string")
    got = [(r["doc_id"], r["lang_pred"]) for r in language.identify(odd, language.train(docs, F.lit(True))).collect()]
    assert len(got) == len(TEXTS) and all(p == "und" for i, p in got if i in (1, 2, 3, 4)) and all(p != "und" for i, p in got if i in (5, 6, None))
    nothing = language.train(docs.where("false"), F.lit(True))
    assert {r["lang_pred"] for r in language.identify(odd, nothing).collect()} == {"und"}
    assert language.identify(odd.limit(0), nothing).count() == 0


def test_quality_cases(spark, odd):
    labels = spark.createDataFrame([(5, 1), (5, 0), (6, None), (99, 1), (None, 1)], "doc_id long, quality int")
    model = quality.train(odd, labels, F.lit(True))
    rows = quality.apply(odd, model, score_col="_s").collect()
    assert len(rows) == len(TEXTS) and all(0 <= r["_s"] <= 1 for r in rows) and rows[0]["_s"] == rows[1]["_s"]
    untrained = quality.train(odd, labels.where("false"), F.lit(True))
    assert {round(r["_s"], 9) for r in quality.apply(odd, untrained, score_col="_s").collect()} == {0.5}
    assert quality.apply(odd.limit(0), model, score_col="_s").count() == 0
    same = quality.apply(odd, model)
    assert same.columns.count("score") == 1 and all(isinstance(r["score"], float) for r in same.collect())


def some_rows(seed, n, shift):
    rng = np.random.default_rng(seed)
    return np.column_stack([rng.normal(shift, 1, (n, 3)), np.ones(n)])


@pytest.mark.parametrize("prior", [0.2, 0.6, 0.95])
def test_risk_and_its_slope_by_brute_force(prior):
    """The risk by its definition, and its gradient and curvature by differences, where the negative part is above 0 and
    where it is below."""
    p, u, ridge, signs = some_rows(0, 40, 1.0), some_rows(1, 70, 0.2), 0.01, set()
    loss = lambda z, y: math.log1p(math.exp(-z if y else z))
    parts = lambda t: (sum(loss(z, 1) for z in p @ t) / len(p), sum(loss(z, 0) for z in p @ t) / len(p), sum(loss(z, 0) for z in u @ t) / len(u))
    penalty = lambda t: ridge / 2 * sum(x * x for x in t[:-1])
    rng = np.random.default_rng(2)
    for _ in range(20):
        theta = rng.normal(0, 1.5, 4)
        value, negative, g, h = quality.risk(quality.unlabelled_sums(u, theta), p, theta, prior, ridge)
        a, b, c = parts(theta)
        assert negative == pytest.approx(c - prior * b) and value == pytest.approx(prior * a + max(0, c - prior * b) + penalty(theta))
        signs.add(negative > 0)
        falls = (lambda t: (x := parts(t))[0] * prior + x[2] - prior * x[1] + penalty(t)) if negative >= 0 else (lambda t: -((x := parts(t))[2] - prior * x[1]) + penalty(t))
        steps = np.eye(4) * 1e-5
        assert g == pytest.approx([(falls(theta + e) - falls(theta - e)) / 2e-5 for e in steps], abs=1e-5)
        if negative >= 0:  # the unlabelled rows' loss alone is curved: those of positives cancel
            def slope(t):
                return quality.unlabelled_sums(u, t)[2:6] / len(u)

            want = np.array([(slope(theta + e) - slope(theta - e)) / 2e-5 for e in steps]) + ridge * np.eye(4)
            assert h == pytest.approx(want, abs=1e-5)
    assert signs == {True, False} or prior < 0.95


def test_nnpu_separates_and_never_goes_below_a_search():
    rng = np.random.default_rng(0)
    good, bad = rng.normal(1, 0.3, (400, 2)), rng.normal(-1, 0.3, (400, 2))
    one = lambda x: np.column_stack([x, np.ones(len(x))])
    p, u = one(good[:200]), one(np.concatenate([good[200:], bad[:200]]))
    sums = lambda t: quality.unlabelled_sums(u, t)
    theta = quality.fit_nnpu(sums, p, 0.5, ridge=1e-3)
    assert (one(good) @ theta > 0).mean() > 0.95 and (one(bad[200:]) @ theta < 0).mean() > 0.95
    least = min(quality.risk(sums(t), p, t, 0.5, 1e-3)[0] for t in rng.normal(0, 4, (3000, 3)))
    assert quality.risk(sums(theta), p, theta, 0.5, 1e-3)[0] <= least + 1e-2


@pytest.mark.parametrize("share", [0.3, 0.6, 0.85])
def test_prior_from_positives_and_unlabelled(share):
    rng, bins = np.random.default_rng(3), 500
    at = lambda good, n: np.bincount((np.clip(rng.beta(8, 2, n) if good else rng.beta(2, 6, n), 0, 0.999) * bins).astype(int), minlength=bins)
    n = 20_000
    unlabelled = at(True, int(share * n)) + at(False, n - int(share * n))
    assert quality.prior_bound(at(True, 4000), unlabelled) == pytest.approx(share, abs=0.04)
    assert quality.prior_bound(np.zeros(bins), unlabelled) == 0.5


def test_no_negative_label_is_read(spark):
    """Labels of 0 change nothing, and sums in the tasks are those of all rows at once."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 300")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    a = quality.train(docs, labels, F.lit(True))
    b = quality.train(docs, labels.where("quality = 1"), F.lit(True))
    assert a["prior"] == b["prior"] and (a["theta"] == b["theta"]).all()
    x = np.random.default_rng(0).normal(size=(50, len(quality.FEATURES)))
    table = spark.createDataFrame([(v.tolist(),) for v in x], "x array<float>").repartition(5)
    assert quality._added(table, lambda v: v.sum(axis=0)) == pytest.approx(x.sum(axis=0), abs=1e-4)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_automaton_against_distances():
    words = ["idiot", "scum", "pathetic", "worthless", "moron"]
    a = toxicity.Automaton(dict.fromkeys(words, 1.0), {"lowei": 1.0})
    rng = np.random.default_rng(1)
    for _ in range(3000):
        w = list(words[rng.integers(len(words))])
        for _ in range(rng.integers(0, 4)):
            i, c = rng.integers(0, len(w) + 1), "aeiostmzl"[rng.integers(9)]
            w[i : i + rng.integers(0, 2)] = [c] * rng.integers(0, 2)
        w = "".join(w)
        best = min(((distance(w, t), t) for t in words if distance(w, t) <= toxicity.edits(t)), default=None)
        kind = a.match(w) % 4
        assert kind == (0 if best is None else 1 if best[0] == 0 else 2), w
    assert a.match("loweichen") % 4 == 3 and a.match("lowe") == 0 and a.match("") == 0


def test_words_stay_fuzzy_beside_their_beginning(spark):
    rows = [(f"you {('idiot', 'idiots')[i % 2]} t{i}", 1) for i in range(60)] + [(f"fine day t{i}", 0) for i in range(60)]
    lexicon = toxicity.learn_lexicon(spark.createDataFrame(rows, "text string, label int"))
    assert lexicon["beginnings"] and {"idiot", "idiots"} <= set(lexicon["words"])
    a = toxicity.Automaton(lexicon["words"], lexicon["beginnings"])
    assert [a.match(w) % 4 for w in ("idiot", "ldiot", "ldiots", "idiotic", "day")] == [1, 2, 2, 3, 0]


def test_quotations():
    m = toxicity.Matcher({"words": {"idiot": 2.0}, "beginnings": {}})
    x, found = m.features(['He said "you idiot" to him.', "You idiot!", None, ""])
    assert [f[0]["quoted"] for f in found[:2]] == [True, False] and x[0, 0] == 0 and x[1, 0] == pytest.approx(math.log(3)) and not x[2:].any()


def test_toxicity_cases(spark, odd):
    labels = spark.createDataFrame([(1, 0), (2, 1), (3, None), (77, 1)], "doc_id long, toxic int")
    model = toxicity.train(odd, labels, F.lit(True))
    rows = toxicity.score(odd, model).collect()
    assert len(rows) == len(TEXTS) and all(0 <= r["score"] <= 1 for r in rows)
    assert toxicity.score(odd.limit(0), model).count() == 0


def base(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    runs = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often, cover, seen, dup = Counter(runs), set(), set(), 0
    for i, w in enumerate(runs):
        if often[w] > 1:
            cover.update(range(i, i + 5))
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(cover)


def test_base_statistics(spark, odd):
    extra = [(100, "a b c d e f a b c d e"), (101, "x\nx\n x\nx\r\nx"), (102, "#|é<>\n\n"), (103, "\n"), (104, "a\n\na b\na")]
    docs = odd.unionByName(spark.createDataFrame([(i, t, "", 0) for i, t in extra], ODD)).unionByName(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", F.lit("").alias("score"), F.lit(0).alias("label")))
    model = line_rules.train(docs, spark.createDataFrame([], "doc_id long, quality int"))
    cols = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    got = Counter((r["doc_id"], *(r[c] for c in cols)) for r in line_rules.label_lines(docs, model).collect())
    assert got == Counter((r["doc_id"], *base(r["text"])) for r in docs.collect())
    assert line_rules.label_lines(odd.limit(0), model).count() == 0


def test_line_verdicts(spark, labels):
    rows = [r for r in q.QUERIES["op9_line_rules"](spark, SF).collect() if r["doc_id"] in labels]
    for r in rows:
        assert r["base_failed"] == (r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"]) and not (r["base_failed"] and r["kept"])
    good = [r["kept"] for r in rows if labels[r["doc_id"]]["quality"] == 1 and not r["base_failed"]]
    bad = [r["kept"] for r in rows if labels[r["doc_id"]]["quality"] == 0 and not r["base_failed"]]
    assert sum(good) / len(good) > 0.97 and sum(bad) / len(bad) < 0.3


def test_crf_against_all_paths():
    """Likelihood by adding up all labellings of a text, gradient by differences, for texts of unlike lengths."""
    from itertools import product

    rng = np.random.default_rng(5)
    per_doc = np.array([3, 0, 1, 5, 2, 3])
    n, f = int(per_doc.sum()), 3
    x, y = rng.normal(size=(n, f)), rng.integers(0, 2, n)
    chains = line_rules._Chains(per_doc)
    assert sorted(chains.order) == list(range(n))

    def by_paths(theta):
        w, trans, at, total = theta[:-4].reshape(f, 2), theta[-4:].reshape(2, 2), 0, 0.0
        for k in per_doc.tolist():
            weigh = lambda p, at=at: sum(x[at + i] @ w[:, c] for i, c in enumerate(p)) + sum(trans[a, b] for a, b in zip(p, p[1:], strict=False))
            if k:
                total += weigh(y[at : at + k].tolist()) - math.log(sum(math.exp(weigh(p)) for p in product((0, 1), repeat=k)))
            at += k
        return total

    for _ in range(5):
        theta = rng.normal(size=2 * f + 4)
        value, g = line_rules.likelihood(x[chains.order], y[chains.order], chains, theta)
        steps = np.eye(len(theta)) * 1e-5
        assert value == pytest.approx(by_paths(theta)) and g == pytest.approx([(by_paths(theta + e) - by_paths(theta - e)) / 2e-5 for e in steps], abs=1e-6)


def test_language_sets_by_enumeration():
    """On small texts the chosen set and its proportions are those of the best of all sets, each run by plain EM."""
    from itertools import combinations

    rng = np.random.default_rng(7)
    langs, letters = ["a", "b", "c", "d"], "abcdefghij"
    parts = [letters[0:4], letters[2:6], letters[5:9], letters[6:10]]
    text = lambda k, n: " ".join("".join(rng.choice(list(parts[k]), 5)) for _ in range(n))
    counts = np.full((4, 1 << language.BITS), 0.05)
    for k in range(4):
        w = language.Words(pa.array([text(k, 3000)]), language._LETTERS)
        counts[k] += np.bincount(language._grams(w)[w.bytes != 32], minlength=1 << language.BITS)
    model = {"langs": langs, "logp": np.log(counts / counts.sum(axis=1, keepdims=True)).astype(np.float32)}
    texts = [text(0, 8), text(1, 30), text(0, 20) + " " + text(2, 20), text(1, 12) + " " + text(3, 30), text(0, 15) + " " + text(2, 25) + " " + text(3, 15), text(3, 1)]
    got, several = language.mixtures(pa.array(texts), model), 0
    for t, mine in zip(texts, got, strict=True):
        like = []
        for word in t.split():
            w = language.Words(pa.array([word]), language._LETTERS)
            like.append(model["logp"][:, language._grams(w)].astype(float).sum(axis=1))
        like = np.exp(np.array(like) - np.max(like, axis=1, keepdims=True))
        best = None
        for size in range(1, 5):
            for some in combinations(range(4), size):
                p = np.full(size, 1 / size)
                for _ in range(300):
                    share = like[:, some] * p
                    p = (share / share.sum(axis=1, keepdims=True)).mean(axis=0)
                cost = size * math.log(max(2, len(like))) - 2 * np.log((like[:, some] * p).sum(axis=1)).sum()
                if best is None or cost < best[0]:
                    best = cost, some, p
        assert tuple(np.flatnonzero(mine)) == best[1] and mine[list(best[1])] == pytest.approx(best[2], abs=0.02)
        several += len(best[1]) > 1
    assert several >= 3


def plain_toxicity(text, words, beginnings, w):
    """Score by distances of every word to every lexicon entry, and by reading the marks around each match."""
    tokens = (text or "").lower().split()
    opens = [bool(re.match(r"[(\[]*[\"'‘’‚“”„«»‹›]", t)) for t in tokens]
    closes = [bool(re.search(r"[\"'‘’‚“”„«»‹›][)\].,;:!?]*$", t)) for t in tokens]
    sums, hits = [0.0] * 7, []
    for i, token in enumerate(tokens):
        kinds = []
        for part in re.findall(r"[^\W_]+", token):
            near = [distance(part, t) for t in words if distance(part, t) <= toxicity.edits(t)]
            starts = any(part.startswith(b) for b in beginnings)
            kinds.append(1 if 0 in near else 3 if starts else 2 if near else 0)
        kind = min((k for k in kinds if k), default=0)
        if not kind:
            continue
        before = [j for j in range(max(0, i - 12), i + 1) if opens[j] or (j < i and closes[j])]
        after = [j for j in range(i, min(len(tokens), i + 13)) if closes[j] or (j > i and opens[j])]
        quoted = bool(before) and bool(after) and opens[before[-1]] and closes[after[0]]
        sums[kind - 1 + 3 * quoted] += 2.0
        hits.append(i)
    if len(hits) > 1:
        sums[6] = max(sum(a <= b <= a + 12 for b in hits) for a in hits) - 1
    z = sum(math.log1p(v) * x for v, x in zip(sums, w, strict=False)) + w[-1]
    return 1 / (1 + math.exp(-z)), hits


def test_toxicity_by_brute_force(spark):
    words, beginnings = ["idiot", "scum", "pathetic", "worthless"], ["lowl"]
    w = np.array([1.5, 1.0, 0.7, 0.2, 0.1, 0.05, 0.4, -1.2])
    rng, vocabulary = np.random.default_rng(9), ["idiot", "ldiot", "idoit", "idiots", "scum", "skum", "pathetic,", "(patetic)", "wrthles", "lowlife", "low", "day", "fine", "said", '"you', 'idiot"', "“scum”.", "it's", "x_scum", "«", "»", "ídiot"]
    texts = [" ".join(rng.choice(vocabulary, rng.integers(1, 40))) for _ in range(150)] + [None, "", '"', "fine " * 30 + '"scum ' + "day " * 30 + '"']
    model = {"lexicon": {"words": dict.fromkeys(words, 2.0), "beginnings": dict.fromkeys(beginnings, 2.0)}, "w": w}
    rows = toxicity.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()
    for r in rows:
        score, hits = plain_toxicity(texts[r["doc_id"]], words, beginnings, w.tolist())
        assert r["score"] == pytest.approx(score) and [m["position"] for m in r["matches"]] == hits, texts[r["doc_id"]]
    assert len({round(r["score"], 6) for r in rows}) > 50


def test_shared_ids_do_not_widen_the_sample(spark):
    """A labelled id that a thousand rows share gives one row to learn from."""
    docs = spark.createDataFrame([(1, f"bad word {i}") for i in range(1000)] + [(2, "fine"), (3, "fine too")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (3, 0, 1)], "doc_id long, toxic int, quality int")
    assert toxicity.train(docs, labels, F.lit(True))["lexicon"] == {"words": {}, "beginnings": {}}  # one toxic document is too few
    assert line_rules.train(docs, labels)["w"].shape == (line_rules.N_FEATURES, 2)


def test_viterbi_against_all_paths():
    from itertools import product

    rng = np.random.default_rng(2)
    counts = np.array([3, 0, 5, 1, 4])
    scores, trans = rng.normal(size=(13, 2)), rng.normal(size=(2, 2))
    got, at = line_rules.viterbi(scores, counts, trans), 0
    for n in counts:
        if n:
            best = max(product((0, 1), repeat=int(n)), key=lambda p: sum(scores[at + i, y] for i, y in enumerate(p)) + sum(trans[a, b] for a, b in zip(p, p[1:], strict=False)))
            assert tuple(got[at : at + n]) == best
        at += n
