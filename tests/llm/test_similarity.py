import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexirank.llm import jaccard_join as j
from lexirank.llm.components import connected_components
from lexirank.llm.common import dealt
from lexirank.llm.counting import FRAMES, STEPS, Butterfly, answers, slot_bits
from lexirank.llm.substring_dedup import remove_repeats

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, chunk int, keys string"


def shingles(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) > 4 else {tuple(words)} if words else set()


def components(rows):
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                up[find(a)] = find(b)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        least.setdefault(find(i), []).append(doc_id)
    pick = lambda ids: min((x for x in ids if x is not None), default=None)
    return Counter((rows[i][0], len(sets[i]), pick(least[find(i)])) for i in range(len(rows)))


def near_copies(seed, groups, size):
    rng, rows = random.Random(seed), []
    for g in range(groups):
        words = [f"w{rng.randint(0, 400)}" for _ in range(rng.choice([30, 60, 120]))]
        for _ in range(size):
            own = list(words)
            for _ in range(rng.randint(0, 4)):
                own[rng.randrange(len(own))] = f"x{rng.randint(0, 9999)}"
            rows.append((len(rows), " ".join(own)))
    return rows


@pytest.mark.parametrize("block_sets", [2000, 6])
def test_components_of_near_copies(spark, block_sets):
    rows = near_copies(block_sets, 5, 14) + [(500, "one two"), (501, "ONE  two"), (502, ""), (503, None), (504, "one two three"), (505, "solo"), (None, "solo"), (500, "one two"), (None, "nobody else"), (506, "a " * 20_000)]
    docs = spark.createDataFrame([(i, t, 1, "k") for i, t in rows], SCHEMA)
    got = Counter(map(tuple, j.near_duplicates(docs, block_sets=block_sets).collect()))
    assert got == components(rows)


def test_hot_group(spark):
    rows = near_copies(3, 1, 120) + [(1000 + i, "the same text for a third of all rows here") for i in range(100)]
    docs = spark.createDataFrame([(i, t, 1, "k") for i, t in rows], SCHEMA)
    assert Counter(map(tuple, j.near_duplicates(docs).collect())) == components(rows)


def test_empty(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert j.near_duplicates(docs).count() == 0 and remove_repeats(docs).count() == 0


def some_sets(seed, n):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 1 << 60, 90).astype(np.uint64)
    keys, sizes = [], []
    for _ in range(n):
        own = base[rng.random(90) < rng.choice([0.6, 0.9, 0.97])]
        keys.append(np.sort(np.concatenate([own, rng.integers(0, 1 << 60, rng.integers(0, 12)).astype(np.uint64)])))
        sizes.append(len(keys[-1]) + int(rng.integers(0, 3)))
    links = [[j for j in range(n) if j != i and 100 * (o := len(np.intersect1d(keys[i], keys[j]))) >= 80 * (sizes[i] + sizes[j] - o)] for i in range(n)]
    return keys, np.array(sizes), links


def closed(n, pairs):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_divide_skip_against_counting():
    keys, sizes, links = some_sets(0, 150)
    block, rng = j.Block(keys, sizes, 80), np.random.default_rng(1)
    for i, (key, size) in enumerate(zip(keys, sizes, strict=True)):
        allowed = rng.random(len(keys)) < rng.choice([0.2, 0.9, 1.1])
        allowed[i] = False
        assert list(block.linked(key, int(size), allowed)) == [x for x in links[i] if allowed[x]]


def as_table(keys, sizes, names, **more):
    return pa.table({"rep": pa.array(names, pa.int64()), "n": pa.array(sizes, pa.int64()), "keys": pa.array([k.tobytes() for k in keys], pa.binary()), **more})


@pytest.mark.parametrize("seed", range(6))
def test_block_joins_what_links_join(seed):
    keys, sizes, links = some_sets(seed, 60 + 30 * seed)
    n = len(keys)
    got = j.join_block(as_table(keys, sizes, list(range(n))), 80)
    pairs = list(zip(got["a"].to_pylist(), got["b"].to_pylist(), strict=True))
    assert closed(n, pairs) == closed(n, [(a, b) for a in range(n) for b in links[a]]) and all(b in links[a] for a, b in pairs)
    # two shards, the first joined already: queries of the second find what joins them to the first
    half, comp = n // 2, closed(n, [(a, b) for a in range(n) for b in links[a] if (a < n // 2) == (b < n // 2)])
    main = max(comp, key=comp.count)
    part = lambda r: as_table([keys[i] for i in r], sizes[list(r)], list(r), comp=pa.array([comp[i] for i in r], pa.int64()), main=pa.array([main] * len(r), pa.int64()))
    more = j.join_shard(part(range(half)), part(range(half, n)), 80)
    both = [(i, comp[i]) for i in range(n)] + list(zip(more["a"].to_pylist(), more["b"].to_pylist(), strict=True))
    assert closed(n, both) == closed(n, [(a, b) for a in range(n) for b in links[a]])


def test_connected_components(spark):
    rng = random.Random(3)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(140)] + [(i, i + 1) for i in range(500, 530)] + [(900, x) for x in range(901, 960)]
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for e in edges if e[0] != e[1] for x in e}


@pytest.mark.parametrize(("chunks", "fan", "levels"), [(5, 512, 1), (12, 4, 2), (60, 4, 3)])
def test_butterfly_counts(spark, chunks, fan, levels):
    """Totals that come back through any number of levels are those of the whole corpus, for one and for two keys."""
    grid = Butterfly.of(chunks, fan)
    assert grid.levels == levels and grid.nodes >= chunks
    item = lambda node, i: (node * 7919 + i * i) % 997 * 0x9E3779B97F4A7C15 % (1 << 64)
    items = {c: Counter(item(c, i) for i in range(40 + c)) for c in range(grid.nodes)}
    whole = sum(items.values(), Counter())

    def arrays(c, bits):
        keys = np.array(sorted(items[c]), np.uint64)
        counts = np.array([items[c][int(k)] for k in keys])
        return (keys >> np.uint64(64 - bits), keys)[: 1 if bits == 64 else 2], counts, keys

    for bits in (64, 40):

        def send(key, table):
            keys, counts, _ = arrays(key[0].as_py(), bits)
            return grid.frames(key[0].as_py(), 0, keys, counts, bits)

        def check(key, table, back):
            want = [int(np.ceil(STEPS * np.log2(whole[int(k)]))) for k in arrays(key[0].as_py(), bits)[2]]
            return pa.table({"ok": [answers(back).tolist() == want]})

        nodes = spark.range(grid.nodes).withColumnRenamed("id", "chunk").groupBy("chunk")
        sent = nodes.applyInArrow(send, FRAMES)
        got = nodes.cogroup(grid.count(sent, bits).groupBy("receiver")).applyInArrow(check, "ok boolean").collect()
        assert len(got) == grid.nodes and all(r["ok"] for r in got)
        assert sent.count() <= grid.nodes * grid.fan


def test_frames_grow_as_the_input_does():
    """Frames a chunk sends, all levels together, at 1, 30 and 100,000 GB in chunks of 4 MB (of files)."""
    each = [(g := Butterfly.of(250 * gb)).fan * g.levels for gb in (1, 30, 100_000)]
    assert max(each) <= 3 * 512 and Butterfly.of(250 * 100_000).nodes < 1.02 * 250 * 100_000
    assert slot_bits(0) == 32 and slot_bits(10**14) <= 56


def test_repeated_rows(spark):
    """A hundred thousand repeated rows are spread over the chunks, are one class, and repeat each other's windows."""
    text = " ".join(f"t{i}" for i in range(40))
    docs = spark.range(100_000, numPartitions=4).select(F.lit(7).cast("long").alias("doc_id"), F.lit(text).alias("text"))
    docs = docs.unionByName(spark.createDataFrame([(8, "alone " * 50), (9, text + " and one")], "doc_id long, text string"))
    assert max(r["count"] for r in dealt(docs, "doc_id", "text", 32).groupBy("chunk").count().collect()) < 4_000
    assert Counter(map(tuple, j.near_duplicates(docs).groupBy("doc_id", "n_shingles", "component_id").count().collect())) == Counter([(7, 36, 7, 100_000), (8, 1, 8, 1), (9, 38, 7, 1)])
    assert Counter(map(tuple, remove_repeats(docs).groupBy("doc_id", "n_words", "n_removed", "kept").count().collect())) == Counter([(7, 40, 40, "", 100_000), (8, 50, 50, "", 1), (9, 42, 40, "and one", 1)])


def without_repeats(rows, k):
    words = [WORD.findall(t or "") for _, t in rows]
    often = Counter(tuple(w[i : i + k]) for w in words for i in range(len(w) - k + 1))
    out = Counter()
    for (doc_id, _), w in zip(rows, words, strict=True):
        gone = set()
        for i in range(len(w) - k + 1):
            if often[tuple(w[i : i + k])] > 1:
                gone.update(range(i, i + k))
        out[doc_id, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)] += 1
    return out


def test_substrings(spark):
    rng = random.Random(4)
    word = lambda: rng.choice(["é", "b", "C", "d,", "x" * 90, "ü" * 40]) + str(rng.randint(0, 50))
    shared = [[word() for _ in range(n)] for n in (34, 35, 36, 80)]
    rows = [(i, " ".join(x for _ in range(rng.randint(0, 3)) for x in [word() for _ in range(rng.randint(0, 30))] + rng.choice(shared))) for i in range(80)]
    rows += [(200, None), (201, ""), (202, " \n"), (203, "r " * 5000), (204, "\t".join(shared[2])), (204, "\t".join(shared[2])), (None, "\n".join(shared[3])), (205, "Caps " + " ".join(shared[1]).upper())]
    docs = spark.createDataFrame([(i, t, 1, "k") for i, t in rows], SCHEMA)
    assert Counter(map(tuple, remove_repeats(docs).collect())) == without_repeats(rows, 35)
    assert Counter(map(tuple, remove_repeats(docs, k=3).collect())) == without_repeats(rows, 3)
