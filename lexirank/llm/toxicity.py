"""Toxicity by a learned lexicon that Levenshtein automata search with errors, scored by context.

Learning: words and word beginnings whose documents are toxic far more often than others (log-likelihood ratio) form
the lexicon, kept as a trie. Searching: the automaton that accepts all strings within k edits of a lexicon entry is
intersected with the trie; it is made deterministic state by state as words ask for it, so a word that is near nothing
ends after a few letters. Short entries must match exactly, longer ones allow one or two edits; a beginning must match
exactly and lets any ending follow. Scoring: each match is looked at in a window of words around it. Matches inside
quotation marks are counted apart from the others, so that quoting a term weighs as little as the labels say. A logistic
regression on these counts gives the score.

Learned from at most about sample_rows labelled rows, chosen by a hash of the id; every text is then scored whole.

Defined cases: null and empty texts get the score of a text without matches; null labels and labels of unknown documents
are ignored, of repeated labels the largest counts, of rows that share a labelled id one; a null id is never held out; repeated rows get equal scores; without
toxic rows to learn from the lexicon is empty; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import count, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batches_by_bytes, sampled

KINDS = ("word", "near", "beginning")
WINDOW = 12
#: Lengths of the word beginnings that may enter the lexicon.
STARTS = (3, 4, 5, 6, 7, 8)
#: Marks that open or close a quotation.
QUOTES = "\"'‘’‚“”„«»‹›"
_OPEN, _CLOSE = re.compile(rf"^[(\[]*[{QUOTES}]"), re.compile(rf"[{QUOTES}][)\].,;:!?]*$")
_PART = re.compile(r"[^\W_]+")
#: Words whose verdicts a worker keeps from batch to batch; beyond it, the worker starts anew.
KEPT_WORDS = 500_000


def edits(term: str) -> int:
    """How many edits a lexicon word allows."""
    return 0 if len(term) < 5 else 1 if len(term) < 9 else 2


class Automaton:
    """The product of the lexicon's trie and the Levenshtein automata of its words, determinised as it is used.

    A state of the product is a trie node and a number of edits spent; a state of the deterministic automaton is the set
    of those that the letters read so far allow, without any that another one dominates.
    """

    def __init__(self, words: dict[str, float], beginnings: dict[str, float]):
        self.children: list[dict[str, int]] = [{}]
        self.word: list[int] = [-1]  # edits that the word ending at this node allows, -1 if none does
        self.beginning: list[bool] = [False]
        self.weight: list[float] = [0.0]  # of the entry that ends at this node
        self.reach: list[int] = [0]  # the most edits that any word at or below this node allows
        for term, weight in words.items():
            node = self._insert(term, edits(term))
            self.word[node], self.weight[node] = edits(term), weight
        for term, weight in beginnings.items():
            node = self._insert(term, 0)
            self.beginning[node], self.weight[node] = True, max(weight, self.weight[node])
        self._reset()

    def _insert(self, term: str, allow: int) -> int:
        node = 0
        for c in term:
            self.reach[node] = max(self.reach[node], allow)
            if c not in self.children[node]:
                self.children[node][c] = len(self.children)
                self.children.append({})
                self.word.append(-1)
                self.beginning.append(False)
                self.weight.append(0.0)
                self.reach.append(0)
            node = self.children[node][c]
        self.reach[node] = max(self.reach[node], allow)
        return node

    def _reset(self) -> None:
        self.names: dict[frozenset, int] = {}
        self.states: list[dict[int, int]] = []
        self.moves: list[dict[str, int]] = []
        self.ends: list[tuple[int, int]] = []  # kind (1, 2) and node of the nearest word that is accepted here, else (0, 0)
        self.marks: list[int] = []  # node of the exact beginning that ends here, else 0
        self.start = self._state({0: 0})

    def _state(self, spent: dict[int, int]) -> int:
        """spent: the fewest edits for each node; closed here under leaving out letters of the lexicon word."""
        todo = list(spent.items())
        while todo:
            node, e = todo.pop()
            if spent.get(node) != e:
                continue
            for child in self.children[node].values():
                if e + 1 <= self.reach[child] and spent.get(child, 99) > e + 1:
                    spent[child] = e + 1
                    todo.append((child, e + 1))
        key = frozenset(spent.items())
        if key not in self.names:
            self.names[key] = len(self.states)
            self.states.append(spent)
            self.moves.append({})
            near = min(((e, n) for n, e in spent.items() if e <= self.word[n]), default=None)
            self.ends.append((0, 0) if near is None else (1 + (near[0] > 0), near[1]))
            self.marks.append(next((n for n, e in spent.items() if self.beginning[n] and not e), 0))
        return self.names[key]

    def _move(self, state: int, c: str) -> int:
        spent: dict[int, int] = {}

        def reach(node: int, e: int) -> None:
            if e <= self.reach[node] and spent.get(node, 99) > e:
                spent[node] = e

        for node, e in self.states[state].items():
            for letter, child in self.children[node].items():
                reach(child, e + (letter != c))
            reach(node, e + 1)  # a letter too many
        nxt = self._state(spent) if spent else -1
        self.moves[state][c] = nxt
        return nxt

    def match(self, word: str) -> int:
        """4 * node + kind of the strongest match, kinds counted from 1 as in KINDS; 0 if there is none."""
        if len(self.states) > 100_000:
            self._reset()
        state, begun = self.start, 0
        for c in word:
            nxt = self.moves[state].get(c)
            state = self._move(state, c) if nxt is None else nxt
            if state < 0:
                break
            begun = self.marks[state] or begun
        kind, node = self.ends[state] if state >= 0 else (0, 0)
        if kind == 1 or kind and not begun:
            return 4 * node + kind
        return 4 * begun + 3 if begun else 0


class Matcher:
    """Counts of matches by kind and by whether they are quoted, for batches of texts."""

    def __init__(self, lexicon: dict):
        self.automaton = Automaton(lexicon["words"], lexicon["beginnings"])
        self.index: dict[str, int] = defaultdict(count().__next__)
        self.found = np.zeros(0, np.int32)
        self.weight = np.array(self.automaton.weight)

    def _match(self, token: str) -> int:
        return min((k for part in _PART.findall(token) if (k := self.automaton.match(part))), key=lambda k: k % 4, default=0)

    @staticmethod
    def quoted(tokens: list[str], i: int) -> bool:
        """A quotation opens at or before token i and closes at or after it, within the window."""
        before = next((j for j in range(i, max(-1, i - WINDOW - 1), -1) if _OPEN.search(tokens[j]) or (j < i and _CLOSE.search(tokens[j]))), None)
        after = next((j for j in range(i, min(len(tokens), i + WINDOW + 1)) if _CLOSE.search(tokens[j]) or (j > i and _OPEN.search(tokens[j]))), None)
        return before is not None and after is not None and bool(_OPEN.search(tokens[before])) and bool(_CLOSE.search(tokens[after]))

    def features(self, texts: list[str | None]) -> tuple[np.ndarray, list[list[dict]]]:
        """For each text the logs of the matches' summed weights, by kind and quotation, and its matches."""
        if len(self.index) > KEPT_WORDS:
            self.index, self.found = defaultdict(count().__next__), np.zeros(0, np.int32)
        known, runs, tokens = len(self.index), [], []
        for text in texts:
            words = (text or "").lower().split()
            tokens.append(words)
            runs.append(np.fromiter(map(self.index.__getitem__, words), np.int64, len(words)))
        self.found = np.concatenate([self.found, np.fromiter(map(self._match, islice(self.index, known, None)), np.int32, len(self.index) - known)])
        x, found = np.zeros((len(texts), 2 * len(KINDS) + 1)), []
        for row, (words, run) in enumerate(zip(tokens, runs, strict=True)):
            codes, matches = self.found[run], []
            hits = np.flatnonzero(codes)
            for i in hits:
                kind, weight, q = int(codes[i]) % 4 - 1, self.weight[codes[i] // 4], self.quoted(words, int(i))
                x[row, kind + len(KINDS) * q] += weight
                matches.append({"position": int(i), "term": words[i], "kind": KINDS[kind], "quoted": q})
            if len(hits) > 1:  # the most matches in one window
                x[row, -1] = (np.searchsorted(hits, hits + WINDOW, side="right") - np.arange(len(hits)) - 1).max()
            found.append(matches)
        return np.log1p(x), found


def _fit(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 30) -> np.ndarray:
    """Logistic regression by Newton's method; the last weight is the bias."""
    x1 = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x1.shape[1])
    if not len(y):
        return w
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x1 @ w, -30, 30)))
        g = x1.T @ (p - y) + ridge * w
        w = w - np.linalg.solve((x1 * (p * (1 - p))[:, None]).T @ x1 + ridge * np.eye(len(w)), g)
    return w


def learn_lexicon(rows: DataFrame, least: float = 25.0, ratio: float = 5.0, start_ratio: float = 2.0) -> dict:
    """rows: (text, label). Terms by the documents that hold them; the log-likelihood ratio of the two shares must be
    least, and the share among toxic documents ratio times (for a beginning start_ratio times) that among the others. A
    term's weight is the log of that ratio. Rows are a bounded sample, so their terms are as well."""
    one, zero = rows.agg(F.sum("label"), F.sum(1 - F.col("label"))).first()
    if not one or not zero:
        return {"words": {}, "beginnings": {}}
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1)))
    words = F.filter(words, lambda w: F.length(w).between(3, 30))  # lexicon entries; texts are searched whole
    starts = F.array_distinct(F.flatten(F.transform(words, lambda w: F.transform(F.array(*[F.lit(n) for n in STARTS]), lambda n: F.when(F.length(w) > n, F.concat(w.substr(F.lit(1), n), F.lit("*")))))))
    terms = rows.select("label", F.explode(F.concat(words, F.filter(starts, lambda s: s.isNotNull()))).alias("term"))
    a, b = F.col("a").cast("double"), F.col("b").cast("double")
    n = F.lit(float(one + zero))
    part = lambda k, total: F.when(k > 0, k * F.log(k * n / ((a + b) * F.lit(float(total))))).otherwise(0.0)
    g2 = 2 * (part(a, one) + part(b, zero))  # of the documents that hold the term; those without hardly differ
    found = terms.groupBy("term").agg(F.sum("label").alias("a"), F.sum(1 - F.col("label")).alias("b")).where("a >= 3")
    times = (a + 0.5) / (one + 1) / ((b + 0.5) / (zero + 1))
    found = found.withColumns({"g2": g2, "times": times}).where((F.col("g2") >= least) & (F.col("times") >= F.when(F.endswith("term", F.lit("*")), start_ratio).otherwise(ratio)))
    # strongest first; of nested beginnings the strongest says all, and of equal ones the shortest
    rows_found = found.select("term", "g2", F.log("times").alias("weight")).collect()
    strength, weight = {r["term"]: r["g2"] for r in rows_found}, {r["term"]: r["weight"] for r in rows_found}
    starts: list[str] = []
    for term in sorted((t for t in strength if t.endswith("*")), key=lambda t: (-strength[t], len(t), t)):
        if not any(term[:-1].startswith(s) or s.startswith(term[:-1]) for s in starts):
            starts.append(term[:-1])
    plain = [t for t in strength if not t.endswith("*")]
    # a beginning counts as one if several words of it were found, or none; otherwise it is a piece of that one word
    beginnings = sorted(s for s in starts if sum(t.startswith(s) for t in plain) != 1)
    # words stay beside the beginnings they have: those match exactly, and only words are searched with edits
    return {"words": {t: weight[t] for t in sorted(plain)}, "beginnings": {s: weight[s + "*"] for s in beginnings}}


def train(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_rows: int = 20_000) -> dict:
    """Lexicon and weights, from rows for which learn (a condition on doc_id) holds."""
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label")).where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & learn)
    known = known.groupBy("doc_id").agg(F.max("label").alias("label"))
    total = known.count()
    picked = known.where(sampled(F.col("doc_id"), total, sample_rows)).select(F.col("doc_id").alias("_id"), "label")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.join(F.broadcast(picked), F.col("doc_id") == F.col("_id"))  # about sample_rows ids at most
    rows = rows.groupBy("_id", "label").agg(F.max("text").alias("text")).select("label", "text")  # of rows that share one, one
    lexicon = learn_lexicon(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(lexicon)
        for batch in batches_by_bytes(batches, "text"):
            x, _ = matcher.features(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(list(x), pa.list_(pa.float64()))], names=["label", "x"])

    sample = rows.mapInArrow(run, "label int, x array<double>").toArrow()
    x = np.array(sample["x"].to_pylist(), dtype=float).reshape(-1, 2 * len(KINDS) + 1)
    return {"lexicon": lexicon, "w": _fit(x, sample["label"].to_numpy().astype(float))}


def score(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, matches): matches have the position, term, kind, and whether it is quoted."""
    kind = pa.list_(pa.struct([("position", pa.int64()), ("term", pa.string()), ("kind", pa.string()), ("quoted", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher, w = Matcher(model["lexicon"]), model["w"]
        for batch in batches_by_bytes(batches, "text"):
            x, found = matcher.features(batch.column("text").to_pylist())
            s = 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(s), pa.array(found, kind)], names=["doc_id", "score", "matches"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double, matches array<struct<position: long, term: string, kind: string, quoted: boolean>>")
