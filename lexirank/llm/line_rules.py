"""Quality rules with a line labeller.

Base statistics are exact counts over the whole text. The verdict comes from a linear-chain conditional random field over
the lines of a text: each line has features (shares of symbols, capitals, repeated words and so on), neighbouring labels
have transition weights, and Viterbi decoding marks each line as content or boilerplate. A text is kept if lines of
content hold at least keep_share of its words.

The field is trained here, from document labels: lines of good documents count as content, lines of bad ones first as
boilerplate; after each fit the lines of bad documents are relabelled by decoding, so that clean lines in them become
content, and the field is fitted again from where it was. At most about sample_rows labelled documents, chosen by a hash
of the id, of at most sample_lines lines each, are learned from, whole; texts of any number of lines are decoded whole.

Defined cases: a null or empty text has no words and fails; a line without words has no say in the share; a null id, null
labels and labels of unknown documents are not learned from, of repeated labels the smallest counts, of rows that share a labelled id one; without labels every
line is content; repeated rows get equal results; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, batches_by_bytes, mix, sampled

#: Fixed value: the characters that n_symbols counts.
SYMBOLS = b"#*$%&|<>"
CONTENT, BOILERPLATE = 0, 1
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True
_CAPITAL, _SMALL = np.zeros(256, bool), np.zeros(256, bool)
_CAPITAL[65:91], _SMALL[97:123] = True, True
_SMALL[192:] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
N_FEATURES = 13


class Lines:
    """Base statistics of a batch of texts, and the lines with words as rows of features."""

    def __init__(self, texts):
        w = Words(texts)
        b, n = w.bytes, w.n_docs
        h = w.hashes()
        in_doc = mix(h + w.doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        self.n_words = w.per_doc
        solid = np.zeros(len(b) + 1, np.int64)
        np.add.at(solid, w.start, 1)
        np.add.at(solid, w.start + w.length, -1)
        solid = np.cumsum(solid[:-1]) > 0
        self.word_chars = w.per_text(solid & ((b & 0xC0) != 0x80))
        self.n_symbols = w.per_text(_SYMBOL[b])
        self.n_repeat_words = self._repeated(w, in_doc)
        # lines: a text begins one, and so does each line feed; a text that is empty has one without words
        breaks = np.flatnonzero(b == 10) + 1
        nonempty = np.flatnonzero(np.diff(w.offsets))
        begin = np.union1d(breaks[breaks < len(b)], w.offsets[nonempty]).astype(np.int64)
        ends = np.append(begin[1:], len(b)) if len(begin) else begin
        doc = np.searchsorted(w.offsets, begin, side="right") - 1
        line_of = np.searchsorted(begin, w.start, side="right") - 1
        used, first, count = np.unique(line_of, return_index=True, return_counts=True)
        self.doc, self.words = doc[used], count
        stop = ends[used] - (b[ends[used] - 1] == 10)
        raw, seen = b.tobytes(), set()
        dup = np.zeros(len(used), bool)
        for i, (d, s, e) in enumerate(zip(self.doc.tolist(), begin[used].tolist(), stop.tolist(), strict=True)):
            key = (d, raw[s:e])
            dup[i] = key in seen
            seen.add(key)
        self.n_dup_lines = np.bincount(self.doc[dup], minlength=n) if len(used) else np.zeros(n, np.int64)
        self.per_doc = np.bincount(self.doc, minlength=n) if len(used) else np.zeros(n, np.int64)
        self.x = self._features(w, in_doc, begin[used], stop, first, count, dup)

    @staticmethod
    def _repeated(w: Words, in_doc: np.ndarray, k: int = 5) -> np.ndarray:
        """Words in windows of k that a text has twice or more."""
        keys, at = w.windows(in_doc, k)
        order = np.argsort(keys, kind="stable")
        same = keys[order][1:] == keys[order][:-1]
        twice = np.zeros(len(keys), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        cover = np.zeros(len(in_doc) + k + 1, np.int64)
        np.add.at(cover, at[twice], 1)
        np.add.at(cover, at[twice] + k, -1)
        return np.bincount(w.doc[np.cumsum(cover)[: len(in_doc)] > 0], minlength=w.n_docs) if len(in_doc) else np.zeros(w.n_docs, np.int64)

    @staticmethod
    def _features(w: Words, in_doc: np.ndarray, begin: np.ndarray, stop: np.ndarray, first: np.ndarray, count: np.ndarray, dup: np.ndarray) -> np.ndarray:
        if not len(begin):
            return np.zeros((0, N_FEATURES))
        b = w.bytes
        per = lambda mask: (lambda s: s[stop] - s[begin])(np.concatenate([[0], np.cumsum(mask, dtype=np.int64)]))
        letters = np.maximum(per(_CAPITAL[b] | _SMALL[b]), 1)
        line = np.repeat(np.arange(len(count)), count)
        same, lately = np.zeros(len(in_doc), bool), np.zeros(len(in_doc), bool)
        same[1:] = (in_doc[1:] == in_doc[:-1]) & (line[1:] == line[:-1])
        for back in range(1, 9):
            lately[back:] |= (in_doc[back:] == in_doc[:-back]) & (line[back:] == line[:-back])
        per_word = lambda mask: np.add.reduceat(mask.astype(float), first) / count
        return np.column_stack([
            np.ones(len(count)), np.log1p(count) / 4, np.minimum(per(_SYMBOL[b]) / count, 4), per(_CAPITAL[b]) / letters, np.minimum(per(b == 33) / count, 2),
            np.minimum(per(b == 124) / count, 2), per_word(same), per_word(lately), np.minimum(per(_DIGIT[b]) / count, 4) / 4, dup,
            np.minimum(letters / count, 20) / 10, np.minimum(per((b == 46) | (b == 44)) / count, 1), per(_CAPITAL[b]) > letters / 2,
        ]).astype(float)


def viterbi(scores: np.ndarray, per_doc: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """The best label of each line; scores: lines x 2, texts end to end; trans: from label, to label."""
    labels = np.zeros(len(scores), np.int8)
    begin = np.cumsum(per_doc) - per_doc
    docs = np.argsort(-per_doc, kind="stable")
    docs = docs[per_doc[docs] > 0]  # longest first: those that still have a line are always a head of the list
    if not len(docs):
        return labels
    counts = per_doc[docs]
    best, back = scores[begin[docs]].copy(), []
    for t in range(1, counts[0]):
        live = int(np.searchsorted(-counts, -t, side="left"))
        ways = best[:live, :, None] + trans[None]
        back.append(ways.argmax(axis=1).astype(np.int8))
        best[:live] = ways.max(axis=1) + scores[begin[docs[:live]] + t]
    now = best.argmax(axis=1)
    for t in range(int(counts[0]) - 1, -1, -1):
        live = int(np.searchsorted(-counts, -t, side="left"))
        labels[begin[docs[:live]] + t] = now[:live]
        if t:
            inner = back[t - 1]
            now[: len(inner)] = np.where(counts[: len(inner)] > t, inner[np.arange(len(inner)), now[: len(inner)]], now[: len(inner)])
    return labels


class _Chains:
    """The lines of texts by their place in the text: at each place those of the longest texts come first, so texts that
    still have a line are always a head of the list."""

    def __init__(self, per_doc: np.ndarray):
        docs = np.argsort(-per_doc, kind="stable")
        docs = docs[per_doc[docs] > 0]
        counts, begin = per_doc[docs], (np.cumsum(per_doc) - per_doc)[docs]
        self.live = np.searchsorted(-counts, -np.arange(counts[0] if len(counts) else 0), side="left")  # texts with a line at each place
        self.order = np.concatenate([begin[:m] + t for t, m in enumerate(self.live)]) if len(docs) else np.zeros(0, np.int64)
        self.at = np.concatenate([[0], np.cumsum(self.live)])

    def place(self, values: np.ndarray, t: int) -> np.ndarray:
        """The rows of values, which are ordered by place, that are at place t; a view."""
        return values[self.at[t] : self.at[t + 1]]


def likelihood(x: np.ndarray, y: np.ndarray, chains: _Chains, theta: np.ndarray) -> tuple[float, np.ndarray]:
    """The labels' conditional log-likelihood, and its gradient by forward-backward. x, y: lines ordered by place."""
    w, trans = theta[:-4].reshape(-1, 2), theta[-4:].reshape(2, 2)
    s = x @ w
    alpha, beta = s.copy(), np.zeros_like(s)
    last = len(chains.live) - 1
    pairs, pair_gold, gold = np.zeros((2, 2)), np.zeros((2, 2)), np.eye(2)[y]
    for t in range(1, last + 1):
        a, now = chains.place(alpha, t - 1)[: chains.live[t]], chains.place(alpha, t)
        now += np.logaddexp(a[:, :1] + trans[0], a[:, 1:] + trans[1])
    z = np.zeros(chains.live[0])
    for t in range(last, -1, -1):
        a, m = chains.place(alpha, t), chains.live[t + 1] if t < last else 0
        z[m : chains.live[t]] = np.logaddexp(a[m:, 0], a[m:, 1])  # texts that end here
        if m:
            ahead = chains.place(s, t + 1) + chains.place(beta, t + 1)
            chains.place(beta, t)[:m] = np.logaddexp(ahead[:, :1] + trans[:, 0], ahead[:, 1:] + trans[:, 1])
            pairs += np.exp(a[:m, :, None] + trans + ahead[:, None, :] - z[:m, None, None]).sum(axis=0)
            pair_gold += chains.place(gold, t)[:m].T @ chains.place(gold, t + 1)
    whole = np.concatenate([z[:m] for m in chains.live])
    p = np.exp(alpha + beta - whole[:, None])
    value = float((s * gold).sum() + (pair_gold * trans).sum() - z.sum())
    return value, np.concatenate([(x.T @ (gold - p)).ravel(), (pair_gold - pairs).ravel()])


def fit_crf(x: np.ndarray, y: np.ndarray, per_doc: np.ndarray, start: np.ndarray | None = None, steps: int = 120, rate: float = 0.1, ridge: float = 1e-3) -> np.ndarray:
    """Maximise the conditional likelihood of the labels by Adam, over whole texts."""
    chains = _Chains(per_doc)
    x, y = x[chains.order], y[chains.order]
    theta = np.zeros(2 * x.shape[1] + 4) if start is None else start
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        g = ridge * theta - likelihood(x, y, chains, theta)[1] / len(x)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta = theta - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return theta


def _model(theta: np.ndarray) -> dict:
    return {"w": theta[:-4].reshape(-1, 2), "trans": theta[-4:].reshape(2, 2)}


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_rows: int = 4_000, sample_lines: int = 1_000, rounds: int = 3) -> dict:
    known = labels.select(F.col(id_col).cast("long").alias("_id"), F.col(label_col).cast("int").alias("label")).where(F.col("label").isin(0, 1) & F.col("_id").isNotNull())
    known = known.groupBy("_id").agg(F.min("label").alias("label"))
    sizes = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    share = F.when(F.col("label") == 1, sampled(F.col("_id"), sizes.get(1, 0), sample_rows // 2)).otherwise(sampled(F.col("_id"), sizes.get(0, 0), sample_rows // 2))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.join(F.broadcast(known.where(share)), F.col("doc_id") == F.col("_id"))  # about sample_rows ids
    rows = rows.where(F.coalesce(F.length("text") - F.length(F.translate("text", "\n", "")), F.lit(0)) < sample_lines)
    rows = rows.groupBy("_id", "label").agg(F.max("text").alias("text")).select("label", "text")  # of rows that share an id, one

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_by_bytes(batches, "text"):
            lines = Lines(batch.column("text"))
            cuts = np.split(lines.x, np.cumsum(lines.per_doc)[:-1])
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array([c.ravel() for c in cuts], pa.list_(pa.float64()))], names=["label", "x"])

    sample = rows.mapInArrow(run, "label int, x array<double>").toArrow()
    x = sample["x"].combine_chunks().flatten().to_numpy().reshape(-1, N_FEATURES) if sample.num_rows else np.zeros((0, N_FEATURES))
    if not len(x) or len(sizes) < 2:
        return {"w": np.array([[1.0, 0.0]] + [[0.0, 0.0]] * (N_FEATURES - 1)), "trans": np.zeros((2, 2))}
    per_doc = np.array([len(v) // N_FEATURES for v in sample["x"].to_pylist()])
    bad = np.repeat(sample["label"].to_numpy() == 0, per_doc)
    y, theta = bad.astype(np.int64), None
    for n in range(rounds):
        theta = fit_crf(x, y, per_doc, theta, 40 if n else 120)
        model = _model(theta)
        y = np.where(bad, viterbi(x @ model["w"], per_doc, model["trans"]), CONTENT).astype(np.int64)
    return model


def label_lines(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text", keep_share: float = 0.5) -> DataFrame:
    """(doc_id, the base statistics, content_share, labels, base_failed, kept); labels: one per line that has a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_by_bytes(batches, "text"):
            lines = Lines(batch.column("text"))
            marks = viterbi(lines.x @ model["w"], lines.per_doc, model["trans"])
            content = np.bincount(lines.doc, weights=lines.words * (marks == CONTENT), minlength=batch.num_rows) if len(marks) else np.zeros(batch.num_rows)
            share = content / np.maximum(lines.n_words, 1)
            failed = (lines.n_words < 10) | (100 * lines.n_repeat_words > 20 * lines.n_words)
            edges = pa.array(np.concatenate([[0], np.cumsum(lines.per_doc)]).astype(np.int32))
            longs = [pa.array(v, pa.int64()) for v in (lines.n_words, lines.word_chars, lines.n_symbols, lines.n_dup_lines, lines.n_repeat_words)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *longs, pa.array(share), pa.ListArray.from_arrays(edges, pa.array(marks)), pa.array(failed), pa.array(~failed & (share >= keep_share))],
                names=["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "content_share", "labels", "base_failed", "kept"],
            )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, content_share double, labels array<tinyint>, base_failed boolean, kept boolean")
