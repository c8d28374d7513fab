"""Language identification as a mixture over each document.

A language is a distribution over byte trigrams of lower-cased letters, hashed into a table and learned from texts of
that language. A word's likelihood under a language is that of its trigrams; a document is a mixture of languages whose
proportions expectation-maximisation finds from its words. The set of languages is chosen by penalised likelihood: from
the likeliest single language it grows by the language that lowers the Bayesian information criterion most, as long as one
does, and only documents in which even the whole mixture could lower it are run again.

Learned from at most about sample_rows texts a language, chosen by a hash of the id; every text is then predicted whole.

Defined cases: `und` with score 0 for null texts and texts without a letter, and for all texts if there is nothing to
learn from; a null id is never held out; ties go to the first language in code point order; repeated rows get equal
results; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, Words, batches_by_bytes

BITS = 16
_LETTERS = LOWER.copy()
_LETTERS[[i for i in range(128) if not chr(i).isalpha()]] = 32


def _grams(w: Words) -> np.ndarray:
    """For each byte of the texts, the slot of the trigram around it."""
    b = w.bytes.astype(np.uint32)
    before, after = np.roll(b, 1), np.roll(b, -1)
    starts = w.offsets[:-1][w.offsets[:-1] < len(b)]
    before[starts] = 32
    after[w.offsets[1:][w.offsets[1:] > 0] - 1] = 32  # texts lie end to end: a trigram never spans two
    return ((before * np.uint32(0x9E3779B1)) ^ (b * np.uint32(0x85EBCA77)) ^ (after * np.uint32(0xC2B2AE3D))) * np.uint32(0x27D4EB2F) >> np.uint32(32 - BITS)


def _count(key: tuple, table: pa.Table) -> pa.Table:
    """Trigram counts of the sampled texts of one language."""
    total = np.zeros(1 << BITS, np.int64)
    for batch in batches_by_bytes(table.to_batches(), "text"):
        w = Words(batch.column("text"), _LETTERS)
        if len(w.bytes):
            total += np.bincount(_grams(w)[w.bytes != 32], minlength=1 << BITS)
    return pa.table({"lang": [key[0].as_py()], "counts": pa.array([total.astype("<i8").tobytes()], pa.binary())})


def train(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_rows: int = 3_000) -> dict:
    """Languages in code point order and the log-probability of each trigram slot under each."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).where(F.col("lang").isNotNull() & learn)
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}  # one row per language
    if not sizes:
        return {"langs": [], "logp": np.zeros((0, 1 << BITS), np.float32)}
    share = F.create_map(*[x for lang, n in sizes.items() for x in (F.lit(lang), F.lit(int(min(1.0, sample_rows / n) * 1_000_000)))])
    picked = rows.where(F.pmod(F.xxhash64("doc_id", F.lit("lang")), F.lit(1_000_000)) < share[F.col("lang")])
    picked = picked.groupBy("lang", "doc_id").agg(F.max("text").alias("text")).select("lang", "text")  # of rows that share an id, one
    found = picked.groupBy("lang").applyInArrow(_count, "lang string, counts binary").collect()  # half a megabyte a language
    counts = {r["lang"]: np.frombuffer(bytes(r["counts"]), "<i8") for r in found}
    langs = sorted(counts, key=lambda x: x.encode())
    table = np.array([counts[x] for x in langs], np.float64) + 0.05
    return {"langs": langs, "logp": np.log(table / table.sum(axis=1, keepdims=True)).astype(np.float32)}


def _sum(values: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Sums of runs of rows; edges: where the runs, none empty, begin."""
    return np.add.reduceat(values, edges, axis=0)


def em(like: np.ndarray, edges: np.ndarray, steps: int = 15) -> tuple[np.ndarray, np.ndarray]:
    """Proportions of the columns and the log-likelihood, for each run of words. like: words x languages, scaled so that
    the largest in a row is 1 (or all are 0 for a language that is out)."""
    n = np.diff(np.append(edges, len(like)))
    pi = np.maximum(_sum(like, edges), 1e-12)
    pi /= pi.sum(axis=1, keepdims=True)
    for _ in range(steps):
        r = like * np.repeat(pi, n, axis=0)
        r /= np.maximum(r.sum(axis=1, keepdims=True), 1e-30)
        pi = _sum(r, edges) / n[:, None]
    total = np.log(np.maximum((like * np.repeat(pi, n, axis=0)).sum(axis=1), 1e-30))
    return pi, _sum(total, edges)


def mixtures(texts, model: dict) -> np.ndarray:
    """Proportions of the languages in each text, 0 for languages outside the chosen set and for texts without words."""
    w, k = Words(texts, _LETTERS), len(model["langs"])
    out = np.zeros((w.n_docs, k))
    if not len(w.start) or not k:
        return out
    slots = _grams(w)
    # bytes from a word's start to the next word's: spaces between count nothing
    solid = w.bytes != 32
    like = np.empty((len(w.start), k), np.float32)
    for i in range(k):
        like[:, i] = np.add.reduceat(np.where(solid, model["logp"][i][slots], np.float32(0)), w.start)
    top = like.max(axis=1, keepdims=True)
    like = np.exp(np.maximum(like - top, -60))
    docs = np.flatnonzero(w.per_doc)
    edges, n = w.first_word[docs], w.per_doc[docs].astype(float)
    _, whole = em(like, edges)
    alone = _sum(np.log(np.maximum(like, 1e-30)).astype(np.float64), edges)  # of each language by itself
    penalty = np.log(np.maximum(n, 2))
    chosen = np.zeros((len(docs), k))
    chosen[np.arange(len(docs)), alone.argmax(axis=1)] = 1
    price = penalty - 2 * alone.max(axis=1)
    again = np.arange(len(docs))
    for size in range(2, k + 1):
        again = again[size * penalty[again] - 2 * whole[again] < price[again]]  # no set of that size is likelier than all languages
        before, grown = chosen[again], np.zeros(len(again), bool)
        for c in range(k):  # the set grows by the language that helps most
            some = np.flatnonzero(before[:, c] == 0)
            if not len(some):
                continue
            of, counts = again[some], n[again[some]].astype(np.int64)
            rows = np.repeat(edges[of] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
            inside = (before[some] > 0).astype(np.float32)
            inside[:, c] = 1
            sub, likely = em(like[rows] * np.repeat(inside, counts, axis=0), np.cumsum(counts) - counts)
            cost = size * penalty[of] - 2 * likely
            better = cost < price[of]
            price[of[better]], chosen[of[better]], grown[some[better]] = cost[better], sub[better], True
        again = again[grown]
    out[docs] = chosen
    return out


def _has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def identify(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, mixture): the strongest language, its proportion, and all proportions above 0."""
    langs = np.array([*model["langs"], "und"], dtype=object)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_by_bytes(batches, "text", 1 << 20):
            pi = mixtures(batch.column("text"), shared.value)
            some = np.array([_has_letter(t) for t in batch.column("text").to_pylist()], bool) & bool(len(langs) > 1)
            pi[some & (pi.sum(axis=1) == 0)] = 1 / max(1, len(langs) - 1)  # letters, but none that the table knows
            best = np.where(some, pi.argmax(axis=1) if pi.shape[1] else -1, -1)
            score = np.where(some, pi.max(axis=1) if pi.shape[1] else 0.0, 0.0)
            parts = [[{"lang": langs[i], "share": float(p[i])} for i in np.flatnonzero(p)] if ok else [] for p, ok in zip(pi, some, strict=True)]
            kind = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(langs[best], pa.string()), pa.array(np.clip(score, 0, 1)), pa.array(parts, kind)], names=["doc_id", "lang_pred", "score", "mixture"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double, mixture array<struct<lang: string, share: double>>")
