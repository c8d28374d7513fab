"""Quality classifier by positive-unlabelled learning.

Trusted positives and unlabelled web text are all that the risk is computed from, no negative label is read: with class
prior p, the risk of a scorer is p R(positives as 1) + max(0, R(unlabelled as 0) - p R(positives as 0)), the non-negative
unbiased risk. Where the second term is negative its gradient is reversed, so the model cannot fit the unlabelled rows as
all negative. The prior is estimated from the same two: a first scorer's scores of held-back positives and of all
unlabelled rows bound it (best bin estimation). With the logistic loss the score is an estimate of the probability of
label 1.

The scorer is additive: each feature of a text (shares of symbols, capitals, repeated words and so on) is bent at its
quantiles and enters linearly. All unlabelled rows count: their features, a few numbers a row, are written once, and each
step of Newton's method adds up their gradients and second derivatives in the tasks. Positives are at most about
sample_rows labelled rows, chosen by a hash of the id; their features come to the driver.

Defined cases: null and empty texts get the score of an empty text; null labels and labels of unknown documents are
ignored, of repeated labels the largest counts; of rows that share a trusted id one is a positive; repeated rows get equal
scores; a null id is never held out; without positives the score is 0.5; other columns are kept by apply, and a column
with the score's name is replaced; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import Words, batches_by_bytes, discard, materialize, mix, sampled

#: Bytes that a feature counts.
SYMBOLS, PUNCTUATION = b"#*$%&|<>@^~_=+\\{}[]", b".,;:?"
#: Penalty of the weights, as if RIDGE positives spoke against each.
RIDGE = 3.0
#: Groups of tasks whose sums come to the driver, and bins of scores that the prior is read from.
LANES, BINS = 16, 2000
FEATURES = ("log_words", "symbols", "capitals", "bangs", "bars", "punctuation", "digits", "letters_a_word", "spread", "same_as_last", "distinct", "distinct_lately", "lines_a_word")


def _table(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_SYMBOL, _POINT, _CAPITAL, _DIGIT = _table(SYMBOLS), _table(PUNCTUATION), _table(bytes(range(65, 91))), _table(b"0123456789")
_LETTER = _table(bytes([*range(65, 91), *range(97, 123), *range(192, 256)]))


def features(texts) -> np.ndarray:
    """One row of FEATURES for each text."""
    w = Words(texts)
    b, n = w.bytes, w.n_docs
    words = np.maximum(w.per_doc, 1).astype(float)
    letters = np.maximum(w.per_text(_LETTER[b]), 1).astype(float)
    h = w.hashes()
    in_doc = mix(h + w.doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _, first = np.unique(in_doc, return_index=True)
    distinct = np.bincount(w.doc[first], minlength=n) if len(first) else np.zeros(n)
    lately = np.zeros(len(h), bool)  # the word is also one of the eight before it
    for back in range(1, 9):
        lately[back:] |= in_doc[back:] == in_doc[:-back]
    per = lambda mask: np.bincount(w.doc[mask], minlength=n) if len(h) else np.zeros(n)
    same = np.zeros(len(h), bool)
    same[1:] = in_doc[1:] == in_doc[:-1]
    mean = w.per_text(np.ones(len(b), bool)) / words
    second = np.bincount(w.doc, weights=w.length.astype(float) ** 2, minlength=n) / words if len(h) else np.zeros(n)
    columns = (
        np.log1p(w.per_doc), w.per_text(_SYMBOL[b]) / words, w.per_text(_CAPITAL[b]) / letters, w.per_text(b == 33) / words, w.per_text(b == 124) / words,
        w.per_text(_POINT[b]) / words, w.per_text(_DIGIT[b]) / words, letters / words, np.sqrt(np.maximum(0, second - mean**2)), per(same) / words,
        distinct / words**0.9, 1 - per(lately) / words, w.per_text(b == 10) / words,
    )
    return np.column_stack(columns).astype(np.float64)


def _bend(x: np.ndarray, knots: np.ndarray) -> np.ndarray:
    """Each feature as its rise within each interval between its knots, 0 to 1: any piecewise linear curve is a sum."""
    span = np.maximum(np.diff(knots, axis=0), 1e-9)
    return np.concatenate([np.clip((x - lo) / s, 0, 1) for lo, s in zip(knots[:-1], span, strict=True)], axis=1)


def _design(x: np.ndarray, knots: np.ndarray) -> np.ndarray:
    """Bent features and, last, a one for the bias."""
    return np.column_stack([_bend(x, knots), np.ones(len(x))])


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def unlabelled_sums(x: np.ndarray, theta: np.ndarray) -> np.ndarray:
    """Of design rows taken as negative: their number, the sum of their logistic losses, and those of the gradient and of
    the second derivatives, in one array that adds up over parts of the rows."""
    z = x @ theta
    s = _sigmoid(z)
    return np.concatenate([[len(x), np.logaddexp(0, z).sum()], s @ x, ((x * (s * (1 - s))[:, None]).T @ x).ravel()])


def risk(sums: np.ndarray, positive: np.ndarray, theta: np.ndarray, prior: float, ridge: float) -> tuple[float, float, np.ndarray, np.ndarray]:
    """Non-negative risk, its negative part before it is cut at 0, and the gradient and second derivatives of what is to
    fall: of the unbiased risk, or, where the negative part is below 0, of that part's opposite."""
    k, n = len(theta), sums[0]
    z = positive @ theta
    as_negative = prior * np.logaddexp(0, z).mean()
    negative = sums[1] / n - as_negative
    slope = sums[2 : 2 + k] / n - prior * _sigmoid(z) @ positive / len(z)  # of the negative part
    curve = sums[2 + k :].reshape(k, k) / n + ridge * np.eye(k)
    penalty = ridge * np.append(theta[:-1], 0.0)
    value = prior * np.logaddexp(0, -z).mean() + max(0.0, negative) + ridge / 2 * float(theta[:-1] @ theta[:-1])
    if negative < 0:
        return value, negative, -slope + penalty, curve
    return value, negative, slope - prior * _sigmoid(-z) @ positive / len(z) + penalty, curve


def fit_nnpu(sums_at: Callable[[np.ndarray], np.ndarray], positive: np.ndarray, prior: float, steps: int = 12, ridge: float | None = None) -> np.ndarray:
    """The parameters with the least non-negative risk that Newton's method meets. sums_at: unlabelled_sums over all
    unlabelled rows; positive: design rows. A step that makes the risk rise is halved. ridge: the weights' penalty, RIDGE
    for the whole sample where it is not given."""
    ridge = RIDGE / len(positive) if ridge is None else ridge
    theta = np.zeros(positive.shape[1])
    theta[-1] = np.log(max(prior, 1e-3) / max(1 - prior, 1e-3))
    best, at, move = np.inf, theta, np.zeros_like(theta)
    for _ in range(steps):
        value, _, g, h = risk(sums_at(theta), positive, theta, prior, ridge)
        if value <= best:
            gain, best, at = best - value, value, theta
            move = -np.linalg.solve(h, g)
            move *= min(1.0, 20 / max(1e-12, float(np.abs(move).max())))
            if gain < 1e-6:
                break
        else:
            move = move / 2
        theta = at + move
    return at


def prior_bound(positive: np.ndarray, unlabelled: np.ndarray, delta: float = 0.1, gamma: float = 0.01) -> float:
    """The share of positives among unlabelled rows, by best bin estimation. Both arrays count scores by bins, the lowest
    first. Above any score the unlabelled rows have the positives' share of the prior, and more; so the least ratio of the
    two tails bounds the prior from above. Its place is chosen with the tails' confidence bounds, so thin tails lose."""
    n_p, n_u = positive.sum(), unlabelled.sum()
    if not n_p or not n_u:
        return 0.5
    tail_p, tail_u = np.cumsum(positive[::-1]) / n_p, np.cumsum(unlabelled[::-1]) / n_u
    slack = np.sqrt(np.log(4 / delta) / (2 * n_u)) + (1 + gamma) * np.sqrt(np.log(4 / delta) / (2 * n_p))
    some = tail_p > 0
    place = np.argmin((tail_u[some] + slack) / tail_p[some])
    return float(np.clip(tail_u[some][place] / tail_p[some][place], 0.01, 0.99))


def score(model: dict, x: np.ndarray) -> np.ndarray:
    return _sigmoid(_design(x, model["knots"]) @ model["theta"])


def _lists(column) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, len(FEATURES))


def _added(table: DataFrame, make: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum of make(features) over all rows of table (x). Tasks add up their rows, LANES groups of tasks are added up
    next, and only those come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = None
        for batch in batches:
            if batch.num_rows:
                own = make(_lists(batch.column("x")))
                total = own if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() % LANES], pa.int64()), pa.array([total.tobytes()], pa.binary())], names=["lane", "sums"])

    def add(key: tuple, rows: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, np.float64) for x in rows["sums"].to_pylist())
        return pa.table({"lane": [key[0].as_py()], "sums": pa.array([total.tobytes()], pa.binary())})

    kind = "lane long, sums binary"
    parts = table.select("x").mapInArrow(run, kind).groupBy("lane").applyInArrow(add, kind).collect()
    return sum(np.frombuffer(bytes(r["sums"]), np.float64) for r in sorted(parts, key=lambda r: r["lane"]))


def train(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_rows: int = 20_000, quantiles: int = 8) -> dict:
    """Fit on rows for which learn (a condition on doc_id) holds: trusted positives, at most about sample_rows of them, and
    all rows as unlabelled. No label but the positives' is read."""
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).alias("label")).where((F.col("label") == 1) & F.col("doc_id").isNotNull() & learn)
    known = known.select("doc_id").distinct()
    trusted = known.where(sampled(F.col("doc_id"), known.count(), sample_rows)).select(F.col("doc_id").alias("_id"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where(learn)
    rows = rows.join(F.broadcast(trusted), F.col("doc_id") == F.col("_id"), "left")  # about sample_rows ids at most
    rows = rows.select("text", F.col("_id").alias("trusted"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_by_bytes(batches, "text"):
            x = features(batch.column("text")).astype(np.float32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * len(FEATURES)), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("trusted"), lists], names=["trusted", "x"])

    table = materialize(rows.mapInArrow(run, "trusted long, x array<float>"), "features")
    chosen = table.where("trusted IS NOT NULL").groupBy("trusted").agg(F.max("x").alias("x")).toArrow()  # a row an id
    chosen = chosen.sort_by("trusted")
    if not chosen.num_rows:
        return {"knots": np.zeros((2, len(FEATURES))), "theta": np.zeros(len(FEATURES) + 1), "prior": 0.5}
    positive = _lists(chosen["x"].combine_chunks())
    at = [i / quantiles for i in range(quantiles + 1)]
    cuts = table.agg(*[F.percentile_approx(F.get("x", F.lit(i)), at, 10_000).alias(f) for i, f in enumerate(FEATURES)]).first()
    knots = np.array([cuts[f] for f in FEATURES], np.float64).T
    design = _design(positive, knots)

    def sums_at(theta: np.ndarray) -> np.ndarray:
        return _added(table, lambda x: unlabelled_sums(_design(x, knots), theta))

    def counts(theta: np.ndarray, x: np.ndarray) -> np.ndarray:
        return np.bincount((_sigmoid(x @ theta) * BINS).astype(np.int64).clip(0, BINS - 1), minlength=BINS).astype(np.float64)

    # half of the positives fit a first scorer, the other half and all unlabelled rows say how its scores are spread
    first = fit_nnpu(sums_at, design[::2], 0.5, steps=6)
    prior = prior_bound(counts(first, design[1::2]), _added(table, lambda x: counts(first, _design(x, knots))))
    theta = fit_nnpu(sums_at, design, prior)
    discard(table)
    return {"knots": knots, "theta": theta, "prior": prior}


def apply(docs: DataFrame, model: dict, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """docs with a score column; all other columns of docs stay."""
    docs = docs.drop(score_col)
    kind = StructType([*docs.schema.fields, StructField(score_col, DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_by_bytes(batches, text_col):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score(model, features(batch.column(text_col))))], names=[*batch.schema.names, score_col])

    return docs.mapInArrow(run, kind)
