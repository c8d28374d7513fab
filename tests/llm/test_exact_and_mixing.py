import hashlib
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lexirank.llm import mixing
from lexirank.llm.exact_dedup import build_store, digests, exact_dedup, probe_store

SPACES = re.compile(r"[\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, digest string, winner int"  # the last two clash with names used inside


def norm(text):
    return hashlib.sha256(SPACES.sub(" ", text or "").encode()).hexdigest()


def test_exact_dedup_cases(spark):
    texts = ["a b", "a\t\n b", "a  b ", None, "", "x" * 300_000, "x" * 300_000, "é", "a b"]
    rows = [(i, t, "z", 1) for i, t in enumerate(texts)] + [(3, None, "z", 1), (None, "é", "z", 1), (None, "alone", "z", 1)]
    got = exact_dedup(spark.createDataFrame(rows, SCHEMA), rows_per_shard=2).collect()
    assert len(got) == len(rows)
    groups = {}
    for i, t, *_ in rows:
        groups.setdefault(norm(t), []).append(i)
    want = Counter()
    for i, t, *_ in rows:
        ids = groups[norm(t)]
        keep = min((x for x in ids if x is not None), default=None)
        want[i, keep, len(ids), i == keep, norm(t)] += 1
    assert Counter(tuple(x) for x in got) == want


def test_exact_dedup_hot_group(spark):
    rows = [(i, "same" if i % 3 == 0 else f"text {i}", "", 0) for i in range(3000)]
    got = {x["doc_id"]: x for x in exact_dedup(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert len(got) == 3000 and got[2997]["keep_id"] == 0 and got[0]["group_size"] == 1000 and sum(x["kept"] for x in got.values()) == 2001


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA + ", source string")
    assert exact_dedup(empty).count() == 0 and mixing.mix_sources(empty).count() == 0


def test_store_has_no_false_members(spark):
    old = digests(spark.createDataFrame([(i, f"t{i}", "", 0) for i in range(500)], SCHEMA))
    new = digests(spark.createDataFrame([(1000 + i, f"t{i}", "", 0) for i in range(400, 900)], SCHEMA))
    out = probe_store(new, build_store(old, 3), 3).collect()
    assert sum(x["member"] for x in out) == 100 and all((x["winner"] < 1000) == x["member"] for x in out)


def water(sizes, weights):
    """Targets by plain rounds of resharing."""
    target, capped = dict.fromkeys(sizes, 0.0), set()
    total = sum(sizes.values())
    while True:
        free = [s for s in sizes if s not in capped]
        left = total - sum(3 * sizes[s] for s in capped)
        over = [s for s in free if left * weights[s] / sum(weights[x] for x in free) > 3 * sizes[s]]
        if not over:
            return {s: 3.0 * sizes[s] if s in capped else left * weights[s] / sum(weights[x] for x in free) for s in target}
        capped.update(over)


@pytest.mark.parametrize("seed", [0, 1])
def test_mixture(spark, seed):
    import random

    rng = random.Random(seed)
    names = ["b", "a", None, "é", "Z", "a b"]
    rows = [(i, " ".join(["w"] * rng.choice([0, 1, 5, 80, 700])), rng.choice(names if i % 3 else ["a"]), "x") for i in range(600)]
    rows += [(5, None, "b", "x"), (None, "one two", "b", "x"), (7, "one", "tiny", "x"), (7, "one", "tiny", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size string")
    got = mixing.mix_sources(docs, seed=seed)
    out = got.collect()
    assert len(out) == len(rows)
    sizes = Counter()
    for _, t, s, _ in rows:
        sizes[s] += len((t or "").split())
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    want = water(sizes, {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)})
    taken = Counter()
    for x in out:
        assert x["target"] == pytest.approx(want[x["source"]]) and x["source_size"] == sizes[x["source"]] and x["taken"] <= 3 * x["size"]
        taken[x["source"]] += x["taken"]
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 64 + 1e-6  # within a block
    assert Counter(map(tuple, out)) == Counter(map(tuple, mixing.mix_sources(docs, seed=seed).collect()))


@pytest.mark.parametrize("n", [1, 2, 7, 1000])
def test_permutation(spark, n):
    size = F.lit(n).cast("long")
    about = mixing.points(size, F.lit("k"), 3)
    df = spark.range(n).withColumn("y", mixing.permuted(F.col("id"), size, about, 3))
    df = df.withColumn("back", mixing.permuted(F.col("y"), size, F.reverse(about), 3))
    got = df.orderBy("id").collect()
    assert sorted(r["y"] for r in got) == list(range(n)) and (n < 1000 or [r["y"] for r in got] != list(range(n)))
    assert all(r["back"] == r["id"] for r in got)


def spark_hash(seed, *values):
    """xxhash64 of a long and of ints."""
    import struct

    import xxhash

    h = 42
    for v, kind in values:
        h = xxhash.xxh64_intdigest(struct.pack(kind, v), seed=h)
    h = xxhash.xxh64_intdigest(struct.pack("<i", seed), seed=h)
    return h - (1 << 64) if h >= 1 << 63 else h


PLAN = [(0, 10, 25), (1, 4, 12), (2, 1, 0), (3, 9000, 20_000)]


def test_draws_against_a_plain_version(spark):
    plan = spark.createDataFrame(PLAN, "src int, n_blocks long, n_slots long")
    got = {(r["shard"], r["src"]): r["n"] for r in mixing.draws(plan, shard_blocks=100, seed=5).collect()}
    total = sum(p[2] for p in PLAN)
    want = Counter()
    for shard in range(-(-total // 100)):
        for i in range(1, min(100, total - shard * 100) + 1):
            mark, at = spark_hash(5, (shard, "<q"), (i, "<i")) % total, 0
            for src, _, n in PLAN:
                want[shard, src] += at <= mark < at + n
                at += n
    assert got == dict(want) and all(sum(got[h, s] for s in range(4)) == min(100, total - h * 100) for h in range(-(-total // 100)))


def test_slots_meet_the_plan(spark):
    """Stretched to the plan, the shards' slots are all slots of a source once, and close to what was drawn."""
    plan = spark.createDataFrame(PLAN, "src int, n_blocks long, n_slots long")
    drawn = {(r["shard"], r["src"]): r["n"] for r in mixing.draws(plan, shard_blocks=100).collect()}
    rows = mixing.shard_slots(mixing.draws(plan, shard_blocks=100), plan).collect()
    for src, _, n in PLAN:
        runs = sorted((r["first"], r["upto"]) for r in rows if r["src"] == src and r["upto"] > r["first"])
        assert [x for a, b in runs for x in range(a, b)] == list(range(n))
    assert all(abs(r["upto"] - r["first"] - drawn[r["shard"], r["src"]]) <= 2 for r in rows if r["src"] == 3)
    blocks = Counter((r["src"], r["block"]) for r in mixing.mixed_blocks(plan, shard_blocks=100).collect())
    assert all(blocks[0, b] in (2, 3) for b in range(10)) and all(blocks[1, b] == 3 for b in range(4)) and sum(blocks.values()) == sum(p[2] for p in PLAN)
    assert {blocks[3, b] for b in range(9000)} == {2, 3}


def test_blocks_are_what_documents_give(spark):
    """Words by the mix's blocks are the words that mix_sources takes of each document, and repeated rows share alike."""
    rows = [(i, " ".join(["w"] * (13 * i % 200)), "ab"[i % 2]) for i in range(120)] + [(500, "four words of text", "b")] * 70_000
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.mix_sources(docs).collect()
    assert len(out) == len(rows) and all(x["taken"] <= 3 * x["size"] for x in out)
    for s in "ab":
        own = [x for x in out if x["source"] == s]
        assert abs(sum(x["taken"] for x in own) - own[0]["target"]) <= 64


def test_documents_get_what_shards_drew(spark, monkeypatch):
    """A document for each source: its shards are those whose plain draws, stretched to the plan, give its source a slot,
    and its words are those of the blocks that were drawn."""
    sizes = {"a": 6400, "b": 3000, "c": 3207, None: 900, "z": 0}
    order = ["a", "b", "c", "z", None]
    docs = spark.createDataFrame([(i, " ".join(["w"] * sizes[s]), s) for i, s in enumerate(order)], "doc_id long, text string, source string")
    goal = water(sizes, {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)})
    blocks = {s: -(-sizes[s] // 64) for s in order if sizes[s]}
    slots = {s: min(round(goal[s] * n / sizes[s]), 3 * n) for s, n in blocks.items()}
    total, drawn = sum(slots.values()), {s: [] for s in slots}
    for shard in range(-(-total // 10)):
        marks, at = [spark_hash(5, (shard, "<q"), (i, "<i")) % total for i in range(1, min(10, total - shard * 10) + 1)], 0
        for s, n in slots.items():
            drawn[s].append(sum(at <= m < at + n for m in marks))
            at += n
    shards = {s: sum(sum(n[: h + 1]) * slots[s] // sum(n) > sum(n[:h]) * slots[s] // sum(n) for h in range(len(n))) for s, n in drawn.items()}
    assert min(shards.values()) < len(drawn["a"])
    got = {x["source"]: x for x in mixing.mix_sources(docs, shard_blocks=10, seed=5).collect()}
    assert {s: x["n_shards"] for s, x in got.items()} == shards | {"z": 0} and got["z"]["taken"] == 0

    every = mixing.mixed_blocks
    monkeypatch.setattr(mixing, "mixed_blocks", lambda *plan: every(*plan).where("block % 2 = 0"))
    plan = mixing.block_plan(mixing.targets(mixing.sizes(docs)), 3.0, 64)
    left = Counter()
    for x in every(plan, 10, 5).where("block % 2 = 0").join(plan, "src").collect():
        left[x["source_size"]] += min(64, x["source_size"] - 64 * x["block"])
    assert {x["size"]: x["taken"] for x in mixing.mix_sources(docs, shard_blocks=10, seed=5).collect()} == {n: left[n] for n in sizes.values()}


def test_offsets(spark):
    rows = [(s, i, (i * 7 + s) % 11) for s in range(2) for i in range(0, 30_000, 3)]
    got = mixing.ahead(spark.createDataFrame(rows, "s int, i long, v long"), ["s"], "i", "v", "at").collect()
    at = {}
    for r in sorted(got, key=lambda r: (r["s"], r["i"])):
        assert r["at"] == at.get(r["s"], 0)
        at[r["s"]] = r["at"] + r["v"]


def test_mixing_is_native(spark):
    docs = spark.createDataFrame([(1, "a b", "s")], "doc_id long, text string, source string")
    plan = mixing.mix_sources(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
