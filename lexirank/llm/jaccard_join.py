"""Near-duplicate documents by the Jaccard similarity of their word shingles, exactly, as components of the link graph.

The search is the T-occurrence problem: a document can only link to those that at least T of its shingles' inverted lists
hold. It runs in four steps, each of which loses no link.

1. Counts. Chunks of documents exchange sparse count-min sketches of their shingles (counting.py), so every shingle gets
   an estimate of how many documents hold it, never too low. Shingles of one document only are in no intersection; a
   document of which too many are such has no link at all and is done.
2. Candidates. Documents with equal shingle sets become one class. Each class posts its rarest shingles, so many that a
   link must share one (in DivideSkip's terms, all lists but the T - 1 longest). Classes that meet in a posting are
   candidates; their components, through edges to the smallest class of a posting, are clusters that links never leave.
3. Search. A cluster, or a shard of a large one, is a block with its own inverted index. For a class the short lists are
   merged with a heap that skips what cannot reach the threshold, the long lists are probed by binary search, and those
   that reach the overlap are linked. Only components matter: a class is first searched for among the block's largest
   component, where one link is enough, and only if it has none there among all others. A class outside the largest
   component has then met all others, so no link between components is missed; a block returns one edge per merger.
4. Large clusters. Edges of all shards give components. Classes outside their cluster's largest component, and one of
   each shard's largest, are searched in all shards of the cluster, until every class outside the largest component
   has been: a link that joins components then has an end that was searched everywhere.

Defined cases: null and empty texts have no shingles and are linked with nothing; a text with fewer words than a shingle
has the whole sequence as its one shingle; repeated rows are one class, and rows with words that share an id are linked;
a null id is a row like any other, counts as larger than any id within its class, and has component null only if all of
the component's ids are null; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, Words, dealt, discard, materialize, mix, pieces, release, text_bytes
from .components import connected_components
from .counting import FRAMES, Butterfly, answers, slot_bits

#: What a posting list's length adds to the cost of probing it, in DivideSkip's rule for the number of long lists.
MU = 0.01
_NULL = np.iinfo(np.int64).max
SETS = "doc_id long, n long, d1 long, d2 long, common long, keys binary, prefix array<long>"
EDGES = "a long, b long"


class _Chunk:
    """The distinct shingles of the documents of one chunk, sorted by document."""

    def __init__(self, table: pa.Table, k: int, bits: int):
        w = Words(table["text"], LOWER)
        h = w.hashes()
        keys, at = w.windows(h, k)
        doc = w.doc[at]
        for short in range(1, k):  # texts of fewer words are one shingle
            some, first = w.windows(h, short, short)
            whole = (w.per_doc[w.doc[first]] == short) if len(first) else np.zeros(0, bool)
            keys, doc = np.concatenate([keys, some[whole]]), np.concatenate([doc, w.doc[first][whole]])
        order = np.lexsort((keys, doc))
        keys, doc = keys[order], doc[order]
        new = np.ones(len(keys), bool)
        new[1:] = (keys[1:] != keys[:-1]) | (doc[1:] != doc[:-1])
        self.keys, self.doc, self.n_docs = keys[new], doc[new], w.n_docs
        self.n = np.bincount(self.doc, minlength=w.n_docs) if len(self.doc) else np.zeros(w.n_docs, np.int64)
        self.begin = np.concatenate([[0], np.cumsum(self.n)]).astype(np.int64)
        self.slot, self.which, self.counts = np.unique(self.keys >> np.uint64(64 - bits), return_inverse=True, return_counts=True)

    def digest(self, seed: int) -> np.ndarray:
        """A hash of each document's set."""
        sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(self.keys + np.uint64((seed * 0x9E3779B97F4A7C15) % (1 << 64))), dtype=np.uint64)])
        return (sums[self.begin[1:]] - sums[self.begin[:-1]]).view(np.int64)


def shingle_sets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80, chunk_mb: float = 6) -> DataFrame:
    """One row per document: its set's size n and digest, and, if it can have links, its shared shingles and its prefix.

    common: shingles that another document may hold; keys: those, sorted; prefix: those of them that the document posts.
    chunk_mb: megabytes of text in a chunk; they bound the memory of a task.
    """
    n_bytes = text_bytes(docs, text_col)
    grid, bits = Butterfly.of(pieces(n_bytes, chunk_mb, 32)), slot_bits(n_bytes)
    chunks = dealt(docs, id_col, text_col, grid.nodes).groupBy("chunk")

    def sketch(key: tuple, table: pa.Table) -> pa.Table:
        c = _Chunk(table, k, bits)
        return grid.frames(key[0].as_py(), 0, (c.slot,), c.counts, bits)

    def choose(key: tuple, table: pa.Table, back: pa.Table) -> pa.Table:
        c = _Chunk(table, k, bits)
        totals = answers(back)
        if len(totals) != len(c.slot):
            raise ValueError("a chunk changed between passes")
        estimate = totals[c.which] if len(c.keys) else np.zeros(0, np.uint8)
        common = np.bincount(c.doc[estimate > 0], minlength=c.n_docs) if len(c.doc) else np.zeros(c.n_docs, np.int64)
        keys, prefix = [None] * c.n_docs, [None] * c.n_docs
        for i in np.flatnonzero((100 * common >= percent * c.n) & (c.n > 0)):
            own, seen = c.keys[c.begin[i] : c.begin[i + 1]], estimate[c.begin[i] : c.begin[i + 1]]
            post = len(own) - -(-percent * len(own) // 100) + 1
            first = np.lexsort((own, seen))[:post]
            keys[i] = own[seen > 0].tobytes()
            prefix[i] = own[first[seen[first] > 0]].view(np.int64)
        return pa.table({"doc_id": table["doc_id"], "n": pa.array(c.n, pa.int64()), "d1": pa.array(c.digest(1)), "d2": pa.array(c.digest(2)), "common": pa.array(common, pa.int64()), "keys": pa.array(keys, pa.binary()), "prefix": pa.array(prefix, pa.list_(pa.int64()))})

    counted = grid.count(chunks.applyInArrow(sketch, FRAMES), bits)
    return chunks.cogroup(counted.groupBy("receiver")).applyInArrow(choose, SETS)


class Block:
    """An inverted index over some sets, and the T-occurrence search in it."""

    def __init__(self, keys: list[np.ndarray], sizes: np.ndarray, percent: int):
        self.sizes, self.percent, self.n = sizes, percent, max(1, len(keys))
        flat = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
        owner = np.repeat(np.arange(len(keys)), [len(x) for x in keys])
        order = np.argsort(flat, kind="stable")
        self.terms, list_of = np.unique(flat[order], return_inverse=True)
        self.posts = list_of * self.n + owner[order]  # the lists end to end, each posting with its list's number

    def lists(self, key: np.ndarray) -> np.ndarray:
        """Numbers of the inverted lists of a set's shingles."""
        at = np.searchsorted(self.terms, key)
        at = at[at < len(self.terms)] if len(at) and at[-1] == len(self.terms) else at
        return at[self.terms[at] == key[: len(at)]]

    def links(self, size: int, overlap, other) -> bool:
        return 100 * overlap >= self.percent * (size + other - overlap)

    def linked(self, key: np.ndarray, size: int, allowed: np.ndarray) -> Iterator[int]:
        """The sets among allowed (a mask over the sets) that link, in order. The sets are searched in runs that grow, so
        a search that may end at its first link seldom reads all of the lists."""
        allowed = allowed & (100 * np.minimum(size, self.sizes) >= self.percent * np.maximum(size, self.sizes))
        lists, first, width = self.lists(key), 0, 32
        while first < len(allowed):
            if allowed[first : first + width].any():
                yield from self._linked(lists, size, allowed, first, min(len(allowed), first + width))
            first, width = first + width, 4 * width

    def _linked(self, lists: np.ndarray, size: int, allowed: np.ndarray, first: int, end: int) -> Iterator[int]:
        """The same among the sets from first to end - 1, by DivideSkip: the heap merges the short lists for sets that may
        still reach the threshold, and the long lists are probed for those."""
        least = -(-self.percent * size // 100)
        begin = np.searchsorted(self.posts, lists * self.n + first)
        length = np.searchsorted(self.posts, lists * self.n + end) - begin
        posts = self.posts[np.repeat(begin - (np.cumsum(length) - length), length) + np.arange(length.sum())]
        posts = posts[allowed[posts % self.n]]
        begin = np.searchsorted(posts, lists * self.n)
        length = np.diff(np.append(begin, len(posts)))
        order = np.argsort(length, kind="stable")[np.count_nonzero(length == 0) :]  # lists with a posting, the shortest first
        if len(order) < least:
            return
        n_long = min(least - 1, int(least / (MU * math.log2(int(length[order[-1]]) + 1) + 1)))
        short, long = order[: len(order) - n_long], lists[order[len(order) - n_long :]][::-1] * self.n
        sets = (posts % self.n).tolist()
        pairs, batch = merge_skip([sets[begin[i] : begin[i] + length[i]] for i in short], least - n_long), 4
        while some := list(islice(pairs, batch)):
            found, overlap = (np.array(x, np.int64) for x in zip(*some, strict=True))
            for i in range(0, n_long, 32):  # the longest first; sets that can no longer reach the threshold drop out
                asked = long[i : i + 32, None] + found
                at = np.minimum(np.searchsorted(posts, asked), len(posts) - 1)
                overlap = overlap + (posts[at] == asked).sum(axis=0)
                keep = overlap + max(0, n_long - i - 32) >= least
                found, overlap = found[keep], overlap[keep]
                if not len(found):
                    break
            yield from found[self.links(size, overlap, self.sizes[found])].tolist()
            batch = min(4 * batch, 1024)


def merge_skip(lists: list[list[int]], need: int) -> Iterator[tuple[int, int]]:
    """(number, count) of the numbers that need or more of the sorted lists hold: a heap of the lists' heads, in which
    heads that cannot be held by enough lists are skipped to the first number that can. A head is one integer, the number
    times the lists plus the list."""
    n = len(lists)
    heads, at = [x[0] * n + i for i, x in enumerate(lists)], [0] * n
    heapq.heapify(heads)
    while len(heads) >= need:
        top, popped = heads[0] // n, []
        while heads and heads[0] < (top + 1) * n:
            popped.append(heapq.heappop(heads) % n)
        if len(popped) >= need:
            yield top, len(popped)
            goal = top + 1
        else:
            while len(popped) < need - 1 and heads:
                popped.append(heapq.heappop(heads) % n)
            if not heads:
                return
            goal = heads[0] // n
        for i in popped:
            at[i] = p = bisect_left(lists[i], goal, at[i])
            if p < len(lists[i]):
                heapq.heappush(heads, lists[i][p] * n + i)


class _Labels:
    """Components of some sets as an array of labels, and the pairs that joined them."""

    def __init__(self, names: list[int], comps: list[int]):
        _, self.of = np.unique(np.array(comps, np.int64), return_inverse=True)
        self.names, self.pairs = names, []

    def join(self, x: int, y: int) -> None:
        if self.of[x] != self.of[y]:
            self.pairs.append((self.names[x], self.names[y]))
            self.of[self.of == self.of[y]] = self.of[x]

    def edges(self) -> pa.Table:
        return pa.table({"a": pa.array([p[0] for p in self.pairs], pa.int64()), "b": pa.array([p[1] for p in self.pairs], pa.int64())})


def _sets(table: pa.Table) -> tuple[list[np.ndarray], np.ndarray]:
    return [np.frombuffer(x, np.uint64) for x in table["keys"].to_pylist()], table["n"].to_numpy()


def join_block(table: pa.Table, percent: int) -> pa.Table:
    """Edges (a, b) that join the components among the sets of a block; table: rep, n, keys.

    main is a component that the others are searched in first. A set with a link to it needs no more: sets that stay
    outside are searched everywhere, this one included. Where another component outgrows main, it takes its place.
    """
    keys, sizes = _sets(table)
    block, done = Block(keys, sizes, percent), np.zeros(len(keys), bool)
    labels = _Labels(table["rep"].to_pylist(), table["rep"].to_pylist())
    while True:
        size = np.bincount(labels.of)
        main = labels.of[int(np.argmax(size[labels.of] * len(keys) + np.argsort(np.argsort(sizes))))]
        grown = False
        for i in np.flatnonzero(~done & (labels.of != main)):
            if labels.of[i] == main:
                continue
            near = next(block.linked(keys[i], int(sizes[i]), labels.of == main), None)
            if near is not None:
                labels.join(near, i)
                continue
            done[i] = True
            for j in block.linked(keys[i], int(sizes[i]), (labels.of != main) & (labels.of != labels.of[i])):
                labels.join(i, j)
            if grown := (labels.of == labels.of[i]).sum() > (labels.of == main).sum():
                break
        if not grown:
            return labels.edges()


def join_shard(index: pa.Table, queries: pa.Table, percent: int) -> pa.Table:
    """Edges that join the components of queries with others among the sets of a shard; both tables: rep, n, keys, comp,
    main. Rows of equal comp are joined already; of main, the cluster's largest component, one link is enough."""
    keys, sizes = _sets(index)
    q_keys, q_sizes = _sets(queries)
    block, n = Block(keys, sizes, percent), len(keys)
    labels = _Labels(index["rep"].to_pylist() + queries["rep"].to_pylist(), index["comp"].to_pylist() + queries["comp"].to_pylist())
    of_main = np.flatnonzero(np.array(index["main"].to_pylist()) == np.array(index["comp"].to_pylist()))
    for i in range(len(q_keys)):
        main = labels.of[:n] == labels.of[of_main[0]] if len(of_main) else np.zeros(n, bool)
        if len(of_main) and labels.of[n + i] != labels.of[of_main[0]]:
            near = next(block.linked(q_keys[i], int(q_sizes[i]), main), None)
            if near is not None:
                labels.join(near, n + i)
        for j in block.linked(q_keys[i], int(q_sizes[i]), ~main & (labels.of[:n] != labels.of[n + i])):
            labels.join(n + i, j)
    return labels.edges()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80, block_sets: int = 2000) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (the smallest id reachable by links, its own included)."""
    spark = docs.sparkSession
    every = materialize(shingle_sets(docs, id_col, text_col, k, percent), "sets")
    release(spark)
    some = every.where(F.col("keys").isNotNull()).withColumn("doc_id", F.coalesce("doc_id", F.lit(int(_NULL))))
    # a class: documents of equal sets, under the smallest id; a null id alone is a class without a number to link by
    classes = materialize(some.groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("size")), "classes")

    # sets are wide, so what follows moves them once, and only those of classes that have a candidate are written again
    chosen = classes.select("rep", F.col("d1").alias("_d1"), F.col("d2").alias("_d2"))
    is_rep = (F.col("doc_id") == F.col("rep")) & (F.col("d1") == F.col("_d1")) & (F.col("d2") == F.col("_d2"))
    posts = some.select("doc_id", "d1", "d2", "prefix").join(chosen, is_rep).dropDuplicates(["doc_id", "d1", "d2"]).select("rep", F.explode("prefix").alias("term"))
    posts = materialize(posts, "posts")
    heads = posts.groupBy("term").agg(F.min("rep").alias("head"), F.count("*").alias("times")).where("times > 1").select(F.col("term").alias("of"), "head")
    candidates = posts.join(heads, F.col("term") == F.col("of")).where("rep != head").select(F.col("rep").alias("a"), F.col("head").alias("b"))
    clusters = materialize(connected_components(candidates), "clusters")
    sizes = clusters.groupBy("component").agg(F.count("*").alias("sets")).withColumn("shards", F.ceil(F.col("sets") / block_sets)).withColumnRenamed("component", "cluster")
    members = clusters.select(F.col("node").alias("rep"), F.col("component").alias("cluster")).join(sizes, "cluster")
    members = members.withColumn("shard", F.pmod(F.xxhash64("rep"), F.col("shards")))
    wide = some.select("doc_id", "d1", "d2", "n", "keys").join(members.join(chosen, "rep"), is_rep).dropDuplicates(["doc_id", "d1", "d2"])
    members = materialize(wide.select("rep", "cluster", "shards", "shard", "n", "keys"), "members")
    discard(posts, clusters)
    release(spark)

    def within(key: tuple, table: pa.Table) -> pa.Table:
        return join_block(table, percent)

    def across(key: tuple, index: pa.Table, queries: pa.Table) -> pa.Table:
        return join_shard(index, queries, percent)

    edges = materialize(members.groupBy("cluster", "shard").applyInArrow(within, EDGES), "links")
    large = members.where("shards > 1")
    found = connected_components(edges)
    searched = None
    while not large.isEmpty():
        found = materialize(found, "found")
        placed = large.join(found.select(F.col("node").alias("rep"), F.col("component").alias("comp")), "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))
        counts = placed.groupBy("cluster", "comp").agg(F.count("*").alias("c"))
        main = counts.groupBy("cluster").agg(F.max_by("comp", F.struct("c", -F.col("comp"))).alias("main"))
        placed = materialize(placed.join(main, "cluster"), "placed")
        todo = placed.where("comp != main")
        if searched is None:  # and of each shard one set of every component that is the largest somewhere
            heads = placed.groupBy("cluster", "shard", "comp").agg(F.count("*").alias("c"), F.min("rep").alias("rep")).groupBy("cluster", "shard").agg(F.max_by("rep", F.struct("c", -F.col("rep"))).alias("rep"))
            todo = todo.unionByName(placed.join(heads.select("rep"), "rep", "left_semi")).dropDuplicates(["rep", "keys"])
        else:
            todo = todo.join(searched, "rep", "left_anti")
        todo = materialize(todo.select("rep", "cluster", "shards", "n", "keys", "comp", "main"), "todo")
        if todo.isEmpty():
            discard(placed, todo)
            break
        before = searched
        searched = materialize(todo.select("rep") if before is None else before.unionByName(todo.select("rep")), "searched")
        # queries of a cluster go in batches, each to every shard, so a task holds a shard and a batch
        asked = todo.withColumn("batches", F.ceil(F.count("*").over(Window.partitionBy("cluster")) / block_sets)).withColumn("batch", F.pmod(F.xxhash64("rep", F.lit("batch")), F.col("batches")))
        n_batches = asked.select("cluster", "batches").distinct()
        index = placed.join(n_batches, "cluster").withColumn("batch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("batches") - 1)))
        queries = asked.withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1)))
        cols = ["cluster", "shard", "batch", "rep", "n", "keys", "comp", "main"]
        more = index.select(cols).groupBy("cluster", "shard", "batch").cogroup(queries.select(cols).groupBy("cluster", "shard", "batch")).applyInArrow(across, EDGES)
        last, edges = edges, materialize(edges.unionByName(more), "links")
        discard(last, placed, todo, found, *([] if before is None else [before]))
        found = connected_components(edges)

    labels = found.select(F.col("node").alias("rep"), "component")
    named = classes.select("d1", "d2", "rep", "size").join(labels, "rep", "left").select(F.col("d1").alias("_d1"), F.col("d2").alias("_d2"), "size", F.coalesce("component", "rep").alias("component"))
    total = every.count()
    rows = every.select("doc_id", "n", "d1", "d2", F.col("keys").isNotNull().alias("linked"))
    alone = rows.where(~F.col("linked")).select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    # at most 1,000 classes can hold a thousandth of the rows each; those go to all tasks, so no task gets a hot class
    hot = F.col("size") > F.lit(max(100, total // 1000))
    on = (F.col("d1") == F.col("_d1")) & (F.col("d2") == F.col("_d2"))
    tagged = rows.where("linked").join(F.broadcast(named.where(hot)), on, "left")
    easy = tagged.where(F.col("component").isNotNull())
    rest = tagged.where(F.col("component").isNull()).select("doc_id", "n", "d1", "d2").join(named.where(~hot), on)
    pick = ["doc_id", F.col("n").alias("n_shingles"), F.when(F.col("component") != F.lit(int(_NULL)), F.col("component")).alias("component_id")]
    return alone.unionByName(easy.select(pick)).unionByName(rest.select(pick))

