"""Byte-level BPE encoding and decoding by prefix-sharing trie traversal.

The greedy merges of BPE have a local form: the encoding of a prefix of a word is the encoding of a shorter prefix plus
one last token, and that token is the only token ending there whose join with the shorter prefix's last token BPE would
keep. So each node of a trie of words needs one value, its last token. The distinct words of a batch are walked in
sorted order, which is a depth-first traversal of their trie: what a word shares with the one before is on the stack
and is not computed again.

Two tokens keep their join if no merge of higher priority crosses it at any step of building them; token numbers are
merge priorities in this vocabulary format. The vocabulary file is a parameter.

Defined cases: null and empty texts have no tokens and decode to the empty text; texts of any length are taken whole, in
batches bounded by bytes; repeated rows are encoded each; other columns are ignored; an empty table gives an empty
result. Strings of special tokens in a text become those tokens, as the tokenizers library does by default.
"""

from __future__ import annotations

import json
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import count, islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_by_bytes

#: Fixed value: the pre-tokenizer pattern of public byte-level BPE vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words whose encodings a worker keeps from batch to batch (some 200 bytes each); beyond it, the worker starts anew.
KEPT_WORDS = 500_000
#: Texts of these characters only, in which every character above U+007F is a letter, are cut by the standard library,
#: which is faster; the pattern is PATTERN with its classes written out.
_LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
_PLAIN = re.compile(rf"[\t-\r -~{_LETTERS}]*")
_PLAIN_WORDS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]+| ?[0-9]+| ?[^\s0-9{_LETTERS}]+|\s+(?!\S)|\s+")
_TOP = 1 << 62


def _byte_of_char() -> dict[str, int]:
    """The alphabet of byte-level vocabularies: printable bytes stand for themselves, the others follow from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Tokens, merges and special tokens of one vocabulary file (tokenizers JSON, byte-level BPE)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        chars = _byte_of_char()
        added = spec.get("added_tokens", [])
        if any(t.get(flag) for t in added for flag in ("lstrip", "rstrip", "single_word")):
            raise ValueError("added tokens that take spaces or whole words only are not supported")
        self.special = {t["content"]: t["id"] for t in sorted(added, key=lambda t: -len(t["content"]))}  # of those that begin alike the longest is tried first
        vocab = spec["model"]["vocab"]
        size = 1 + max([*vocab.values(), *self.special.values()])
        self.bytes: list[bytes] = [b""] * size
        for token, i in vocab.items():
            self.bytes[i] = bytes(chars[c] for c in token)
        for token, i in self.special.items():
            self.bytes[i] = token.encode()
        self.ids = {self.bytes[i]: i for i in vocab.values()}
        self.longest = max(map(len, self.ids))
        self.pair: dict[tuple[int, int], int] = {}
        self.parts: list[tuple[int, int]] = [(i, i) for i in range(size)]
        for merge in spec["model"]["merges"]:
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            a, b = vocab[left], vocab[right]
            self.pair[a, b] = whole = vocab[left + right]
            self.parts[whole] = (a, b)
        # priorities: bytes are below all merges, merges count in the order they are made
        self.words = regex.compile(PATTERN)
        self.split = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        flat = np.frombuffer(b"".join(self.bytes), np.uint8)
        ends = np.cumsum([len(b) for b in self.bytes])
        self.flat, self.begin, self.size = flat, ends - [len(b) for b in self.bytes], np.array([len(b) for b in self.bytes], np.int64)
        self._keeps: dict[tuple[int, int], bool] = {}
        self._forget()

    def _forget(self) -> None:
        self._index: dict[str, int] = defaultdict(count().__next__)
        self._ids, self._counts = np.zeros(0, np.int32), np.zeros(0, np.int64)

    def keeps(self, a: int, b: int) -> bool:
        """Whether BPE leaves the boundary between tokens a and b as it is: the merges that build the two are undone,
        latest first, and no pair across the boundary may have merged before the later of the two was built."""
        known = self._keeps.get((a, b))
        if known is None:
            known = self._keeps[a, b] = self._boundary(a, b)
            if len(self._keeps) > 2_000_000:
                self._keeps.clear()
        return known

    def _boundary(self, a: int, b: int) -> bool:
        bound, pair, parts = _TOP, self.pair, self.parts
        while True:
            if pair.get((a, b), _TOP) < bound:
                return False
            (_, inner_a), (inner_b, _) = parts[a], parts[b]
            whole_a, whole_b = inner_a == a, inner_b == b  # single bytes cannot be undone
            if whole_a and whole_b:
                return True
            if not whole_a and (whole_b or a > b):
                bound, a = a, inner_a
            else:  # of equal merges the left one is made first, so the right one may be met by its own kind
                bound, b = b + 1, inner_b

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        """Token ids of each word; words must be distinct and sorted."""
        find, longest, keeps = self.ids.get, self.longest, self.keeps
        out: list[list[int]] = []
        last: list[int] = []  # for each prefix length of the word before, its last token and that token's start
        cut: list[int] = []
        before = b""
        for word in words:
            n = min(len(before), len(word))
            same = 0
            while same < n and before[same] == word[same]:
                same += 1
            del last[same:], cut[same:]
            for end in range(same + 1, len(word) + 1):
                for start in range(max(0, end - longest), end):
                    token = find(word[start:end])
                    if token is not None and (not start or keeps(last[start - 1], token)):
                        last.append(token)
                        cut.append(start)
                        break
                else:
                    raise ValueError("the vocabulary lacks a byte")
            path, at = [], len(word)
            while at:
                path.append(last[at - 1])
                at = cut[at - 1]
            out.append(path[::-1])
            before = word
        return out

    def pieces(self, text: str) -> list[str]:
        """Pre-tokens and special tokens in order; joined they are the text."""
        find = _PLAIN_WORDS.findall if _PLAIN.fullmatch(text) else self.words.findall
        if self.split is None or not any(s in text for s in self.special):
            return find(text)
        return [w for i, part in enumerate(self.split.split(text)) for w in ([part] if i % 2 else find(part))]

    def _learn(self, words: list[str]) -> None:
        """Encode the words that were met for the first time."""
        ids_of: list[list[int]] = [[self.special[w]] if w in self.special else [] for w in words]
        by_bytes = sorted((w.encode("utf-8", "surrogatepass"), i) for i, w in enumerate(words) if w not in self.special)
        for (_, i), ids in zip(by_bytes, self.encode_words([w for w, _ in by_bytes]), strict=True):
            ids_of[i] = ids
        counts = np.fromiter(map(len, ids_of), np.int64, len(ids_of))
        self._counts = np.concatenate([self._counts, counts])
        self._ids = np.concatenate([self._ids, np.fromiter((x for ids in ids_of for x in ids), np.int32, int(counts.sum()))])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All token ids end to end, and how many each text has."""
        if len(self._index) > KEPT_WORDS:
            self._forget()
        known = len(self._index)
        runs = []
        for text in texts:
            words = self.pieces(text)
            runs.append(np.fromiter(map(self._index.__getitem__, words), np.int64, len(words)))
        self._learn(list(islice(self._index, known, None)))
        begin = np.cumsum(self._counts) - self._counts
        where = np.concatenate(runs) if runs else np.zeros(0, np.int64)
        counts = self._counts[where]
        ends = np.cumsum(np.concatenate([[0], counts]))
        return self._ids[_ragged(begin[where], counts)], np.diff(ends[np.cumsum([0, *map(len, runs)])])

    def decode(self, tokens: np.ndarray, counts: np.ndarray) -> pa.Array:
        """The texts of runs of token ids; bytes that are not UTF-8 become U+FFFD."""
        data = self.flat[_ragged(self.begin[tokens], self.size[tokens])]
        ends = np.cumsum(np.concatenate([[0], self.size[tokens]]))
        offsets = ends[np.concatenate([[0], np.cumsum(counts)])].astype(np.int64)
        try:
            array = pa.LargeStringArray.from_buffers(len(counts), pa.py_buffer(offsets), pa.py_buffer(data))
            array.validate(full=True)
        except pa.ArrowInvalid:
            raw = data.tobytes()
            array = pa.array([raw[a:b].decode("utf-8", "replace") for a, b in zip(offsets, offsets[1:], strict=False)], pa.large_string())
        return array.cast(pa.string())


def _ragged(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The indices begin[0] .. begin[0] + size[0] - 1, begin[1] .. and so on."""
    shift = begin - (np.cumsum(size) - size)
    return np.repeat(shift, size) + np.arange(int(size.sum()))


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def bpe_encode(docs: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text", decode: bool = False) -> DataFrame:
    """(doc_id, ids) of each text, with decode also (decoded), the text that the ids stand for."""
    kind = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))] + [("decoded", pa.string())] * decode)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(vocab_path)
        for batch in batches_by_bytes(batches, "text"):
            tokens, counts = vocab.encode([t or "" for t in batch.column("text").to_pylist()])
            ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(tokens))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), ids] + ([vocab.decode(tokens, counts)] if decode else []), schema=kind)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids array<int>" + ", decoded string" * decode)


def bpe_decode(encoded: DataFrame, vocab_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, decoded) of each run of ids; null counts as no ids, and a null id within a run as none."""
    kind = pa.schema([("doc_id", pa.int64()), ("decoded", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(vocab_path)
        for batch in batches:
            ids = batch.column("ids")
            counts = np.diff(ids.offsets.to_numpy())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), vocab.decode(ids.flatten().to_numpy(zero_copy_only=False).astype(np.int64), counts)], schema=kind)

    clean = F.filter(F.coalesce(F.col(ids_col), F.array().cast("array<int>")), lambda x: x.isNotNull())
    return encoded.select(F.col(id_col).cast("long").alias("doc_id"), clean.alias("ids")).mapInArrow(run, "doc_id long, decoded string")


def bpe_digests(docs: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) from the encoding and its decoding."""
    both = bpe_encode(docs, vocab_path, id_col, text_col, decode=True)
    ids = F.concat_ws(",", F.col("ids").cast("array<string>"))
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids.cast("binary"), 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
