"""Helpers that several training-data operators share."""

from __future__ import annotations

import gc

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import discard, materialize, scratch  # noqa: F401

#: The white space of every contract in this folder: space, tab, LF, VT, FF, CR.
SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(9)], dtype=np.uint64)
_K1, _K2, _K3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner delete shuffle files that no live plan refers to."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def text_bytes(df: DataFrame, text_col: str) -> int:
    """Bytes of all texts, and sixteen more a row. One scan of a column: sizes of files say little about texts that were
    compressed well, and of what is no file Spark has no size."""
    size = F.coalesce(F.octet_length(F.col(text_col).cast("string")), F.lit(0)).cast("long") + 16
    return df.agg(F.sum(size)).first()[0] or 0


def pieces(n_bytes: int, mb: float, least: int = 4) -> int:
    """How many pieces of about mb megabytes make up so many bytes."""
    return max(least, -(-n_bytes // int(mb * 1e6)))


def dealt(docs: DataFrame, id_col: str, text_col: str, chunks: int) -> DataFrame:
    """(doc_id, text, chunk): rows dealt into chunks by their place in the input, so that rows that repeat are spread as
    all others are. Null texts are empty. For tables read from files, where a row's place is the same in every run of a
    task; the exchange by chunk that follows is read more than once and made once."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")
    place = F.xxhash64(F.monotonically_increasing_id())
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text, F.pmod(place, F.lit(chunks)).alias("chunk"))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * _K2
    x = (x ^ (x >> np.uint64(27))) * _K3
    return x ^ (x >> np.uint64(31))


class Words:
    """The words of a batch of texts as arrays: start, length and document of each word, in order.

    texts: an Arrow string array; null counts as empty. Nothing is cut: a text of any length is taken whole.
    table: 256 bytes that the bytes of the texts are replaced by first, such as LOWER.
    """

    def __init__(self, texts, table: np.ndarray | None = None):
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks() if texts.num_chunks != 1 else texts.chunk(0)
        texts = texts.cast(pa.large_string()).fill_null("")
        n = len(texts)
        _, offsets, data = texts.buffers()
        off = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + n + 1] if n else np.zeros(1, np.int64)
        raw = np.frombuffer(data, dtype=np.uint8)[off[0] : off[-1]] if data is not None and n else np.zeros(0, np.uint8)
        self.offsets = off - off[0]
        self.buf = np.zeros(len(raw) + 8, dtype=np.uint8)
        self.buf[: len(raw)] = raw if table is None else table[raw]
        self.n_docs, size = n, len(raw)
        solid = ~_IS_SPACE[self.buf[:size]]
        edge = np.zeros(size + 1, dtype=bool)
        edge[self.offsets] = True  # texts are laid end to end: a word never crosses from one to the next
        first = solid.copy()
        first[1:] &= ~solid[:-1] | edge[1:size]
        self.start = np.flatnonzero(first)
        last = solid.copy()
        last[:-1] &= ~solid[1:] | edge[1:size]
        self.length = np.flatnonzero(last) + 1 - self.start
        self.doc = np.searchsorted(self.offsets, self.start, side="right") - 1
        self.per_doc = np.bincount(self.doc, minlength=n) if n else np.zeros(0, np.int64)
        self.first_word = np.concatenate([[0], np.cumsum(self.per_doc)]).astype(np.int64)

    def per_text(self, mask: np.ndarray) -> np.ndarray:
        """How many bytes of each text the mask (over all bytes) has."""
        sums = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
        return sums[self.offsets[1:]] - sums[self.offsets[:-1]]

    @property
    def bytes(self) -> np.ndarray:
        return self.buf[: int(self.offsets[-1])]

    def hashes(self, seed: int = 0) -> np.ndarray:
        """A 64-bit hash of each word; different seeds give independent hashes."""
        at = np.lib.stride_tricks.as_strided(self.buf[:8].view("<u8"), shape=(max(0, len(self.buf) - 7),), strides=(1,))
        h = mix(self.length.astype(np.uint64) * _K1 + np.uint64((seed * 0xD6E8FEB86659FD93 + 0x2545F4914F6CDD1D) % (1 << 64)))
        live = np.flatnonzero(self.length <= 64)
        done = 0
        while len(live):
            left = self.length[live] - done
            h[live] = mix((h[live] ^ (at[self.start[live] + done] & _MASKS[np.minimum(left, 8)])) * _K1)
            live, done = live[left > 8], done + 8
        for i in np.flatnonzero(self.length > 64):
            s = self.start[i]
            h[i] = xxhash.xxh3_64_intdigest(self.buf[s : s + self.length[i]].tobytes(), seed=seed + 1)
        return h

    def windows(self, h: np.ndarray, k: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of k words within one document, and the index of each run's first word."""
        n = len(h) - k + 1
        if n <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        base = (0xD1342543DE82EF95 + 2 * seed * 0x9FB21C651E98DF25) % (1 << 64) | 1
        out, have, power, size = None, 0, h, 1
        while size <= k:  # runs of 1, 2, 4 ... words, joined as k has them in binary
            if k & size:
                out = power if out is None else out[: len(out) - size] * np.uint64(pow(base, size, 1 << 64)) + power[have : have + len(out) - size]
                have += size
            power = power[: len(power) - size] * np.uint64(pow(base, size, 1 << 64)) + power[size:] if 2 * size <= k else power
            size *= 2
        whole = np.flatnonzero(self.doc[:n] == self.doc[k - 1 :])
        return mix(out[:n][whole]), whole


def id_column(table: pa.Table, name: str) -> pa.Array:
    col = table.column(name)
    return col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col


def word_count(col):
    """Words of a text column as a JVM expression; null counts none."""
    return F.coalesce(F.regexp_count(col, F.lit(WORD)), F.lit(0)).cast("long")


def held_out(id_col, parts: int, remainder: int):
    """Rows that no label is learned from: crc32 of the id as text, modulo parts, is remainder. A null id is not one."""
    return F.coalesce(F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(parts)) == remainder, F.lit(False))


def sampled(id_col, total: int, bound: int):
    """A filter that keeps about bound of total rows, the same rows in every run."""
    share = min(1.0, bound / max(1, total))
    return F.pmod(F.xxhash64(id_col, F.lit("sample")), F.lit(1_000_000)) < int(share * 1_000_000)


def batches_by_bytes(batches, column: str, limit: int = 4 << 20):
    """Slices of Arrow batches with about limit bytes of text each; a longer text is a slice of its own, taken whole."""
    import pyarrow.compute as pc

    for batch in batches:
        size = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), np.int64)
        ends, start = np.cumsum(size), 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(ends, ends[start] - size[start] + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
