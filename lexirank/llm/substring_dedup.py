"""Removal of passages that occur more than once, by windows of words, with a count-min prefilter.

Texts are dealt into chunks. First pass: each chunk's count-min sketch of its windows is merged with all others, and the
merged counters of its windows come back, never too low. Second pass: only windows estimated as repeated, one in 64 of
the others at most, are sent again, as two independent 64-bit hashes of the whole word sequence, once a chunk with their
number, and are counted exactly: two different sequences count as one only if both hashes meet, which among 10^13 windows
has a chance below 10^-12. Third pass: words covered by a repeated window are removed. The three passes read one shuffle
of the texts.

Copies, however many, are one item a chunk after the first pass, so no task gets more of a hot window than there are
chunks it hears from. Windows are judged on the input, not on what is left.

Defined cases: null and empty texts have no words; texts shorter than a window lose nothing; repeated rows are documents
of their own, so their windows repeat; a null id is an id; other columns are ignored; an empty table gives an empty
result. Words are cut at ASCII white space and unchanged.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import Words, dealt, pieces, text_bytes
from .counting import FRAMES, Butterfly, answers, slot_bits

OUT = "doc_id long, n_words long, n_removed long, kept string"


class _Chunk:
    """The windows of one chunk and what is known of them; the order of its rows does not matter."""

    def __init__(self, table: pa.Table, k: int, bits: int):
        self.words = Words(table["text"])
        self.first, self.at = self.words.windows(self.words.hashes(0), k, 0)
        self.slot, self.which, self.counts = np.unique(self.first >> np.uint64(64 - bits), return_inverse=True, return_counts=True)
        self.k = k

    def suspects(self, estimates: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Windows estimated as repeated: their indices, the distinct ones among them as two keys, and which each is."""
        if len(estimates) != len(self.slot):
            raise ValueError("a chunk changed between passes")
        index = np.flatnonzero(estimates[self.which] > 0)
        second, _ = self.words.windows(self.words.hashes(1), self.k, 1)
        a, b = self.first[index], second[index]
        order = np.lexsort((b, a))
        new = np.ones(len(order), bool)
        new[1:] = (a[order[1:]] != a[order[:-1]]) | (b[order[1:]] != b[order[:-1]])
        which = np.empty(len(order), np.int64)
        which[order] = np.cumsum(new) - 1
        return index, a[order[new]], b[order[new]], which


def _left_out(words: Words, at: np.ndarray, k: int) -> np.ndarray:
    """Which words a window that begins at one of these words covers."""
    cover = np.zeros(len(words.start) + k + 1, np.int64)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + k, -1)
    return np.cumsum(cover)[: len(words.start)] > 0


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 35, chunk_mb: float = 6) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept (its other words, joined by one space).

    chunk_mb: megabytes of text in a chunk; they bound the memory of a task.
    """
    n_bytes = text_bytes(docs, text_col)
    grid, bits = Butterfly.of(pieces(n_bytes, chunk_mb, 32)), slot_bits(n_bytes)

    def sketch(key: tuple, table: pa.Table) -> pa.Table:
        c = _Chunk(table, k, bits)
        return grid.frames(key[0].as_py(), 0, (c.slot,), c.counts, bits)

    def exact(key: tuple, table: pa.Table, back: pa.Table) -> pa.Table:
        c = _Chunk(table, k, bits)
        _, a, b, which = c.suspects(answers(back))
        return grid.frames(key[0].as_py(), 0, (a, b), np.bincount(which, minlength=len(a)), 64)

    def both(key: tuple, estimated: pa.Table, counted: pa.Table) -> pa.Table:
        kind = pa.concat_arrays([pa.array([i] * t.num_rows, pa.int8()) for i, t in enumerate((estimated, counted))])
        return pa.concat_tables([estimated, counted]).append_column("kind", kind)

    def remove(key: tuple, table: pa.Table, back: pa.Table) -> pa.Table:
        c = _Chunk(table, k, bits)
        kind = back["kind"].to_numpy() if back.num_rows else np.zeros(0)
        index, _, _, which = c.suspects(answers(back.filter(pa.array(kind == 0))))
        count = answers(back.filter(pa.array(kind == 1)))
        out = _left_out(c.words, c.at[index[count[which] > 0]], k)
        removed = np.bincount(c.words.doc[out], minlength=table.num_rows) if len(out) else np.zeros(table.num_rows, np.int64)
        kept = []
        for i, t in enumerate(table["text"].to_pylist()):
            own = t.encode("utf-8", "surrogatepass").split()
            if removed[i]:
                gone = out[c.words.first_word[i] : c.words.first_word[i + 1]]
                own = [w for w, g in zip(own, gone.tolist(), strict=True) if not g]
            kept.append(b" ".join(own))
        return pa.table({"doc_id": table["doc_id"], "n_words": pa.array(c.words.per_doc, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept": pa.array(kept, pa.binary()).cast(pa.string())})

    chunks = dealt(docs, id_col, text_col, grid.nodes).groupBy("chunk")
    estimated = grid.count(chunks.applyInArrow(sketch, FRAMES), bits).groupBy("receiver")
    counted = grid.count(chunks.cogroup(estimated).applyInArrow(exact, FRAMES), 64).groupBy("receiver")
    known = estimated.cogroup(counted).applyInArrow(both, FRAMES + ", kind tinyint")
    return chunks.cogroup(known.groupBy("receiver")).applyInArrow(remove, OUT)
