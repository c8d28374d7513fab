"""Exact dedup against a store of historical digests under a minimal perfect hash.

Texts are equal when they are identical after each run of ASCII white space becomes one space; null counts as empty.
The store is sharded by digest. A shard is one row: the levels of a minimal perfect hash (a collision-free bit per key,
keys that collide go on to the next level), and for each slot the full 32-byte digest, the winner's id and how many
rows it stands for. A lookup computes the slot and compares all 32 bytes, so a text that is not in the store is never
taken for one that is. Nonmembers are grouped among themselves.

Defined cases: null text equals empty text; repeated rows count in the group and all get the same verdict, so rows
with the winner's id and text are all kept; a null id never wins over an id, and where all ids of a group are null,
keep_id is null and the rows are kept; an empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACES, materialize, mix

STORE = "shard long, n long, sizes array<long>, levels binary, digests binary, winners binary, counts binary"
_LEVELS, _GAMMA = 32, 2.0
_NONE = np.iinfo(np.int64).max  # stands for a null id; never smaller than an id


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, digest): SHA-256 of the normalised text in UTF-8."""
    text = F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), SPACES, " ")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.unhex(F.sha2(text, 256)).alias("digest"))


def _slots(levels: bytes, sizes: list[int], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The slot of each key, -1 where no level has its bit."""
    out, base, at = np.full(len(a), -1, np.int64), 0, 0
    left = np.arange(len(a))
    for level, size in enumerate(sizes):
        bits = np.unpackbits(np.frombuffer(levels, np.uint8, (size + 7) // 8, at), count=size, bitorder="little")
        rank = np.cumsum(bits, dtype=np.int64) - 1 + base
        where = _place(a[left], b[left], level, size)
        hit = bits[where] == 1
        out[left[hit]] = rank[where[hit]]
        left, base, at = left[~hit], base + int(bits.sum()), at + (size + 7) // 8
    return out


def _place(a: np.ndarray, b: np.ndarray, level: int, size: int) -> np.ndarray:
    return (mix(a + b * np.uint64(2 * level + 1)) % np.uint64(size)).astype(np.int64)


def _keys(digest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    words = np.ascontiguousarray(digest).view("<u8")
    return words[:, 1], words[:, 2] ^ words[:, 3]


def _matrix(column) -> np.ndarray:
    col = column.combine_chunks().cast(pa.binary(32))
    return np.frombuffer(col.buffers()[1], np.uint8, 32 * len(col), 32 * col.offset).reshape(-1, 32)


def _build(key: tuple, table: pa.Table) -> pa.Table:
    digest = _matrix(table["digest"])
    a, b = _keys(digest)
    left, sizes, levels = np.arange(len(a)), [], []
    for level in range(_LEVELS):
        if not len(left):
            break
        size = max(8, int(_GAMMA * len(left)))
        where = _place(a[left], b[left], level, size)
        alone = np.bincount(where, minlength=size) == 1
        sizes.append(size)
        levels.append(np.packbits(alone, bitorder="little").tobytes())
        left = left[~alone[where]]
    if len(left):
        raise ValueError(f"{len(left)} digests share 128 bits")
    blob = b"".join(levels)
    order = np.empty(len(a), np.int64)
    order[_slots(blob, sizes, a, b)] = np.arange(len(a))
    pick = lambda name: table[name].to_numpy()[order].astype("<i8").tobytes()
    row = {"shard": [key[0].as_py()], "n": [len(a)], "sizes": [sizes], "levels": [blob], "digests": [digest[order].tobytes()], "winners": [pick("winner")], "counts": [pick("n")]}
    return pa.table(row, schema=pa.schema([("shard", pa.int64()), ("n", pa.int64()), ("sizes", pa.list_(pa.int64())), *((c, pa.binary()) for c in ("levels", "digests", "winners", "counts"))]))


def _probe(left: pa.Table, right: pa.Table) -> pa.Table:
    """left: distinct incoming digests of a shard; right: that shard of the store, if any."""
    digest, winner, n = _matrix(left["digest"]), left["winner"].to_numpy().copy(), left["n"].to_numpy().copy()
    member = np.zeros(len(digest), bool)
    if right.num_rows and len(digest):
        row = right.to_pylist()[0]
        slot = _slots(row["levels"], row["sizes"], *_keys(digest))
        stored = np.frombuffer(row["digests"], np.uint8).reshape(-1, 32)
        member[slot >= 0] = (stored[slot[slot >= 0]] == digest[slot >= 0]).all(axis=1)
        hit = slot[member]
        winner[member] = np.minimum(winner[member], np.frombuffer(row["winners"], "<i8")[hit])
        n[member] += np.frombuffer(row["counts"], "<i8")[hit]
    return pa.table({"digest": left["digest"].cast(pa.binary()), "winner": pa.array(winner, pa.int64()), "n": pa.array(n, pa.int64()), "member": pa.array(member)})


def distinct_digests(rows: DataFrame, shards: int) -> DataFrame:
    """One row per digest; Spark combines before the shuffle, so a text with any number of copies costs a row a task."""
    shard = F.pmod(F.conv(F.hex(F.substring("digest", 1, 6)), 16, 10).cast("long"), F.lit(shards))
    return rows.groupBy("digest").agg(F.min(F.coalesce("doc_id", F.lit(int(_NONE)))).alias("winner"), F.count("*").alias("n")).withColumn("shard", shard)


def build_store(rows: DataFrame, shards: int) -> DataFrame:
    """The store over (doc_id, digest) rows; save it as Parquet and probe it with later batches."""
    return distinct_digests(rows, shards).groupBy("shard").applyInArrow(_build, STORE)


def probe_store(rows: DataFrame, store: DataFrame, shards: int) -> DataFrame:
    """(digest, winner, n, member) for each distinct digest of rows; shards as the store was built with."""
    return distinct_digests(rows, shards).groupBy("shard").cogroup(store.groupBy("shard")).applyInArrow(_probe, "digest binary, winner long, n long, member boolean")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows_per_shard: int = 4_000) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    The lower half of the id range is the history, the rest comes in against it; ids and texts may be null.
    """
    rows = materialize(digests(docs, id_col, text_col), "digests")
    low, high, total = rows.agg(F.min("doc_id"), F.max("doc_id"), F.count("*")).first()
    middle = F.lit(((low or 0) + (high or 0)) // 2)
    old = F.coalesce(F.col("doc_id") <= middle, F.lit(False))
    # as many shards as tasks at least, so that all tasks have some
    shards = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // (2 * rows_per_shard)))
    history, batch = rows.where(old), rows.where(~old)
    store = materialize(build_store(history, shards), "mph")
    probed = probe_store(batch, store, shards).select("digest", "winner", "n", "member")
    # a stored digest that came again has its total from the probe; one that did not has it from the store
    known = distinct_digests(history, shards).select("digest", "winner", "n", F.lit(None).cast("boolean").alias("member"))
    groups = materialize(
        known.unionByName(probed).groupBy("digest").agg(F.min("winner").alias("winner"), F.max("n").alias("group_size")), "groups"
    )
    # at most 1,000 digests can hold a thousandth of the rows each: those are broadcast, so no task gets a hot group
    hot = groups.where(F.col("group_size") > F.lit(max(100, total // 1000)))
    cold = groups.where(F.col("group_size") <= F.lit(max(100, total // 1000)))
    tagged = rows.join(F.broadcast(hot), "digest", "left")
    easy = tagged.where(F.col("group_size").isNotNull())
    rest = tagged.where(F.col("group_size").isNull()).select("doc_id", "digest").join(cold, "digest")
    out = easy.select("doc_id", "digest", "winner", "group_size").unionByName(rest.select("doc_id", "digest", "winner", "group_size"))
    keep = F.when(F.col("winner") != F.lit(int(_NONE)), F.col("winner"))
    return out.select("doc_id", keep.alias("keep_id"), "group_size", F.col("doc_id").eqNullSafe(keep).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))
