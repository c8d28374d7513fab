"""Count-min counting of hashed items over chunks of a corpus, without a table of the whole corpus in any task.

A chunk's sketch is one row of counters, as wide as the corpus needs (slot_bits), of which almost all are 0, so only the
others are kept: sorted slots, as differences, and their counts. One row is the cheapest depth for a sparse sketch: a
wider row costs a few bits an item, a second row doubles the items. Sketches are merged slice by slice, and each chunk
gets back the merged totals of the slots it sent, in its order. A total is never below the count of any item in its slot.

Chunks and slices meet in a butterfly. There are fan ** levels chunks and as many slices; at each level a node cuts what
it has into fan frames by the next digit of the slice, and the nodes that differ in one digit of the chunk exchange
frames. So a node sends and gets fan frames at each level, and the frames grow in proportion to the input times levels,
where sending each chunk's share straight to each slice would make the product of chunks and slices. What moves at a
level is two to three bytes an item, less where chunks share items, and a fraction of a byte on the way back.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

#: Frames that a node sends at a level, at most.
FAN = 512
#: (receiver, sender, payload): part of a node's sorted items on the way to be counted, or their totals on the way back.
FRAMES = "receiver long, sender long, payload binary"
_SCHEMA = pa.schema([("receiver", pa.int64()), ("sender", pa.int64()), ("payload", pa.binary())])
#: Totals come back as whole steps of their logarithm, so many to a doubling: 0 for 1, more for more, up to 2 ** 42.
STEPS = 6


@dataclass(frozen=True)
class Butterfly:
    """fan ** levels chunks, numbered from 0, and as many slices of the range of keys."""

    fan: int
    levels: int

    @staticmethod
    def of(chunks: int, fan: int = FAN) -> Butterfly:
        """The least one with so many chunks at least."""
        levels = 1
        while fan**levels < chunks:
            levels += 1
        width = max(2, int(chunks ** (1 / levels)))
        while width**levels < chunks:
            width += 1
        return Butterfly(width, levels)

    @property
    def nodes(self) -> int:
        return self.fan**self.levels

    def frames(self, node: int, level: int, keys: tuple[np.ndarray, ...], counts: np.ndarray, bits: int) -> pa.Table:
        """What a node sends at a level (from 0): a frame for each value of the next digit that its items have. keys are
        sorted; the first has so many bits, 32 at least."""
        if not len(counts):
            return _SCHEMA.empty_table()
        weight = self.fan ** (self.levels - 1 - level)
        lead = keys[0] >> np.uint64(bits - 32)
        digit = ((lead * np.uint64(self.nodes)) >> np.uint64(32)) // np.uint64(weight) % np.uint64(self.fan)
        cuts = np.flatnonzero(np.diff(digit, prepend=digit[0] + np.uint64(1)))
        base = node - node // weight % self.fan * weight
        rows = [(base + int(digit[a]) * weight, node, pack(tuple(k[a:b] for k in keys), counts[a:b])) for a, b in zip(cuts, [*cuts[1:], len(counts)], strict=True)]
        return pa.table([list(c) for c in zip(*rows, strict=True)], schema=_SCHEMA)

    def count(self, sent: DataFrame, bits: int) -> DataFrame:
        """From the chunks' frames of level 0, frames with the totals for each chunk (the receiver)."""

        def onward(level: int):
            def run(key: tuple, table: pa.Table) -> pa.Table:
                _, keys, sums, _ = _merge(table)
                return self.frames(key[0].as_py(), level, keys, sums, bits)

            return run

        def totals(key: tuple, table: pa.Table) -> pa.Table:
            cuts, _, sums, which = _merge(table)
            return _reply(table, np.ceil(STEPS * np.log2(sums)).clip(0, 255).astype(np.uint8), cuts, which)

        def backward(key: tuple, table: pa.Table, back: pa.Table) -> pa.Table:
            cuts, _, _, which = _merge(table)
            return _reply(table, answers(back), cuts, which)

        levels = [sent]
        for level in range(1, self.levels):
            levels.append(levels[-1].groupBy("receiver").applyInArrow(onward(level), FRAMES))
        back = levels.pop().groupBy("receiver").applyInArrow(totals, FRAMES)
        while levels:
            back = levels.pop().groupBy("receiver").cogroup(back.groupBy("receiver")).applyInArrow(backward, FRAMES)
        return back


def slot_bits(n_bytes: int) -> int:
    """Bits of a slot for a corpus of so many bytes of text: about 64 counters for each word."""
    return min(64, max(32, (16 * n_bytes).bit_length()))


def _squeeze(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(data)


def _expand(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def _planes(x: np.ndarray) -> bytes:
    """The bytes of 64-bit numbers, all lowest bytes first, then all second ones, and so on."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()


def _numbers(data: bytes, n: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, n).T).view("<u8").ravel()


def pack(keys: tuple[np.ndarray, ...], counts: np.ndarray) -> bytes:
    """Items with counts, sorted by the first key, which is kept as differences."""
    steps = np.diff(keys[0], prepend=np.uint64(0))
    return _squeeze(np.uint32(len(counts)).tobytes() + _planes(counts) + _planes(steps) + b"".join(map(_planes, keys[1:])))


def unpack(payload: bytes) -> tuple[list[np.ndarray], np.ndarray]:
    data = _expand(payload)
    n = int(np.frombuffer(data, np.uint32, 1)[0])
    counts, *keys = (_numbers(data[4 + 8 * n * i : 4 + 8 * n * (i + 1)], n) for i in range((len(data) - 4) // (8 * n)))
    keys[0] = np.cumsum(keys[0], dtype=np.uint64)
    return keys, counts


def _merge(table: pa.Table) -> tuple[np.ndarray, tuple[np.ndarray, ...], np.ndarray, np.ndarray]:
    """All frames of a node: where each ends, the distinct items in order, their counts, and which item each entry is."""
    got = [unpack(p) for p in table["payload"].to_pylist()]
    keys = [np.concatenate([k[i] for k, _ in got]) for i in range(len(got[0][0]))]
    counts = np.concatenate([c for _, c in got])
    order = np.lexsort(keys[::-1]) if len(keys) > 1 else np.argsort(keys[0], kind="stable")
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[order[1:]] != k[order[:-1]]
    first = np.flatnonzero(new)
    which = np.empty(len(order), np.int64)
    which[order] = np.cumsum(new) - 1
    return np.cumsum([len(c) for _, c in got]), tuple(k[order[first]] for k in keys), np.add.reduceat(counts[order], first), which


def _reply(table: pa.Table, codes: np.ndarray, cuts: np.ndarray, which: np.ndarray) -> pa.Table:
    """codes of the distinct items, back to the senders of the frames in the order of their entries."""
    payloads = [_squeeze(c.tobytes()) for c in np.split(codes[which], cuts[:-1])]
    return pa.table([table["sender"], table["receiver"], pa.array(payloads, pa.binary())], schema=_SCHEMA)


def answers(table: pa.Table) -> np.ndarray:
    """The totals of all items of a node, as steps of their logarithm, from its answered frames."""
    rows = sorted(zip(table["sender"].to_pylist(), table["payload"].to_pylist(), strict=True))
    return np.frombuffer(b"".join(_expand(p) for _, p in rows), np.uint8)
