"""Text functions on columns: analysis, display strings, question and word tests, fuzzy scores, segments."""

from __future__ import annotations

import difflib
from collections.abc import Callable, Collection
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from . import porter
from .stopwords import english

#: Word characters: letters, decimal and other numbers, underscore, in any script.
TOKEN = r"([\p{L}\p{N}_]+)"
SEGMENT = r"([\p{L}\p{N}_]+|[^\p{L}\p{N}_]+)"
#: Words that become bags at once.
BAG_WORDS = 250_000
#: Blanks between words, by byte; an odd number, its inverse and another modulo 2^64; bytes whose runs are numbered at once.
BLANK = np.isin(np.arange(256), list(b" \t\n\x0b\f\r"))
BASE, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
UNBASE, RUN_BYTES = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64)), 1 << 20
#: Words that begin a question.
QUESTION_WORDS = (
    "what why how when where who whose which whom can could should would is are was were am do does did has have had must may might shall will "
    "aren't isn't wasn't weren't don't doesn't didn't hasn't haven't hadn't can't cannot"
).split()


def _lists(words: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Offsets of the lists of an array and their words end to end; a null list is an empty one."""
    size = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False)
    return np.concatenate([[0], np.cumsum(size)]).astype(np.int32), words.flatten()


def _stemmed(flat: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """The stem of each word as a number, and the stems; each distinct word is stemmed once."""
    words = flat.dictionary_encode()
    stems = pa.array([porter.stem(w) for w in words.dictionary.to_pylist()], pa.string()).dictionary_encode()
    return stems.indices.to_numpy()[words.indices.to_numpy()].astype(np.int64), stems.dictionary


@F.arrow_udf(ArrayType(StringType()))
def stem_all(words: pa.Array) -> pa.Array:
    """Stems of arrays of words; null stays null."""
    offsets, flat = _lists(words)
    codes, stems = _stemmed(flat)
    out = stems.take(pa.array(codes))
    return pa.ListArray.from_arrays(pa.array(offsets), out, mask=words.is_null())


BAG = ArrayType(StructType([StructField("term", StringType()), StructField("tf", LongType()), StructField("first_pos", IntegerType())]))


@F.arrow_udf(BAG)
def stem_bag(words: pa.Array) -> pa.Array:
    """For each array of words its stems, how often each occurs, and where first; some words at a time."""
    return _some_bags(words, _stemmed)


@F.arrow_udf(BAG)
def word_bag(words: pa.Array) -> pa.Array:
    """The same for the words as they are."""
    return _some_bags(words, _coded)


def _coded(flat: pa.Array) -> tuple[np.ndarray, pa.Array]:
    words = flat.dictionary_encode()
    return words.indices.to_numpy().astype(np.int64), words.dictionary


def _some_bags(words: pa.Array, coded: Callable[[pa.Array], tuple[np.ndarray, pa.Array]]) -> pa.Array:
    offsets, flat = _lists(words)
    out, at = [], 0
    while at < len(words):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + BAG_WORDS, "right")) - 1)
        out.append(_bags(offsets[at : end + 1] - offsets[at], *coded(flat.slice(offsets[at], offsets[end] - offsets[at]))))
        at = end
    return pa.concat_arrays(out) if out else pa.array([], pa.list_(pa.struct([("term", pa.string()), ("tf", pa.int64()), ("first_pos", pa.int32())])))


def _bags(offsets: np.ndarray, codes: np.ndarray, stems: pa.Array) -> pa.Array:
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    _, first, tf = np.unique(doc * max(1, len(stems)) + codes, return_index=True, return_counts=True)
    rows = pa.StructArray.from_arrays([stems.take(pa.array(codes[first])), pa.array(tf, pa.int64()), pa.array(first - offsets[doc[first]], pa.int32())], ["term", "tf", "first_pos"])
    per = np.concatenate([[0], np.cumsum(np.bincount(doc[first], minlength=len(offsets) - 1))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(per), rows)


@cache
def word_runs(n: int) -> Callable[[str], Column]:
    """A function on texts: a number for every n words in a row, in order, alike for equal runs of words between blanks
    (different ones seldom share it). Null has none."""

    @F.arrow_udf(ArrayType(LongType()))
    def run(text: pa.Array) -> pa.Array:
        out, at, size = [], 0, np.concatenate([[0], np.cumsum(pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False))])
        while at < len(text):
            end = max(at + 1, int(np.searchsorted(size, size[at] + RUN_BYTES, "right")) - 1)
            out.append(_runs(text.slice(at, end - at), n))
            at = end
        return pa.concat_arrays(out) if out else pa.array([], pa.list_(pa.int64()))

    return run


def _runs(text: pa.Array, n: int) -> pa.Array:
    text = pa.array(pc.fill_null(text, "").cast(pa.large_binary()))
    ends = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
    data = np.frombuffer(text.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    ends = ends - ends[0]
    word = ~BLANK[data]
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    inside = ends[1:-1][(ends[1:-1] > 0) & (ends[1:-1] < len(data))]  # a text ends a word, too
    first[inside] = word[inside]
    last[inside - 1] = word[inside - 1]
    first, last = np.flatnonzero(first), np.flatnonzero(last) + 1
    # a word's number is the sum of its bytes times powers of an odd number, all modulo 2^64, divided by its first power
    with np.errstate(over="ignore"):
        power, back = (np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(len(data), b, np.uint64))]) for b in (BASE, UNBASE))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:-1], dtype=np.uint64)])
        number = (sums[last] - sums[first]) * back[first]
        number = (number ^ (number >> np.uint64(29))) * MIX
        number ^= number >> np.uint64(32)
        runs = np.zeros(max(0, len(number) - n + 1), np.uint64)
        for i in range(n):
            runs = runs * BASE + number[i : len(runs) + i]
    doc = np.searchsorted(ends, first, "right") - 1
    whole = doc[: len(runs)] == doc[n - 1 : n - 1 + len(runs)]
    per = np.concatenate([[0], np.cumsum(np.bincount(doc[: len(runs)][whole], minlength=len(text)))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(per), pa.array(runs[whole].view(np.int64)))


def raw_tokens(text: Column) -> Column:
    """Lower-cased word runs in order; null has none."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(1))


def kept_tokens(text: Column, stop_words: Collection[str] | None = None) -> Column:
    """Tokens of two characters or more that are no stop words; both tests come before stemming."""
    stop = sorted(english() if stop_words is None else stop_words)
    return F.filter(raw_tokens(text), lambda t: (F.length(t) > 1) & ~t.isin(stop))


def stems(text: Column, stop_words: Collection[str] | None = None) -> Column:
    return stem_all(kept_tokens(text, stop_words))


def analyze(df: DataFrame, id_col: str, text_col: str = "text", stop_words: Collection[str] | None = None) -> DataFrame:
    """(id, position, term): every stem of every text, in order, repeats kept."""
    return df.select(F.col(id_col), F.posexplode(stems(F.col(text_col), stop_words)).alias("position", "term"))


def _strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^[\s\x1c-\x1f\x85\p{Z}]+|[\s\x1c-\x1f\x85\p{Z}]+$", "")


def _one_line(text: Column) -> Column:
    return F.replace(F.coalesce(text, F.lit("")), F.lit("\n"), F.lit(" "))


def _cut(text: Column, over: int, keep: int) -> Column:
    return F.when(F.length(text) > over, F.concat(F.substring(text, 1, keep), F.lit("..."))).otherwise(text)


def title(doc_id: Column, text: Column) -> Column:
    """The first line, or the id if that is blank, cut to 85 characters and dots if over 88."""
    line = _strip(F.substring_index(_strip(F.coalesce(text, F.lit(""))), "\n", 1))
    return _cut(F.when(line == "", doc_id).otherwise(line), 88, 85)


def snippet(text: Column, limit: int = 280) -> Column:
    return _cut(_strip(_one_line(text)), limit, limit - 3)


def console_snippet(text: Column, limit: int = 300) -> Column:
    return _cut(_one_line(text), limit, limit)


def query_echo(text: Column, limit: int = 140) -> Column:
    return _cut(_one_line(text), limit, limit)


def shown_number(x: Column) -> Column:
    """A number with two decimals from 100 on, four from 1 on, else six, by its size without the sign; a dash for null."""
    digits = lambda n: F.replace(F.format_number(x, n), F.lit(","), F.lit(""))
    return F.when(F.abs(x) >= 100, digits(2)).when(F.abs(x) >= 1, digits(4)).otherwise(F.coalesce(digits(6), F.lit("—")))


def is_question(text: Column) -> Column:
    """Ends with a question mark, or begins with a question word."""
    t = _strip(F.coalesce(text, F.lit("")))
    lead = t.rlike("(?i)^(" + "|".join(QUESTION_WORDS) + r")(?![\p{L}\p{N}_])")
    return (t != "") & (F.endswith(t, F.lit("?")) | lead)


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\s\x1c-\x1f\x85\p{Z}]+"))


def segments(text: Column) -> Column:
    """Alternating runs of word and other characters; joined they are the text."""
    runs = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(SEGMENT), F.lit(1))
    return F.transform(runs, lambda r: F.struct(r.alias("text"), r.rlike(r"^[\p{L}\p{N}_]").alias("word")))


def paragraphs(text: Column) -> Column:
    """Trimmed paragraphs between blank lines; lines if there is only one; a notice if there is nothing."""
    part = lambda by: F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), by), _strip), lambda p: p != "")
    many, lines = part(r"\n\n+"), part(r"\n")
    out = F.when(F.size(many) > 1, many).otherwise(lines)
    return F.when(F.size(out) > 0, out).otherwise(F.array(F.lit("(Empty document.)")))


def fuzzy_score(typed: str, candidate: str) -> float:
    """1 if the candidate begins with what was typed, else the larger of the likeness of equally long beginnings and 0.88
    times that of the whole strings (case does not count)."""
    a, b = typed.strip().lower(), candidate.strip().lower()
    if not a or not b:
        return 0.0
    if b.startswith(a):
        return 1.0
    n = min(len(a), len(b))
    ratio = lambda x, y: difflib.SequenceMatcher(None, x, y).ratio()
    return max(ratio(a[:n], b[:n]), 0.88 * ratio(a, b))


def fuzzy_scores(typed: str, candidate: Column) -> Column:
    @F.pandas_udf(DoubleType())
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: fuzzy_score(typed, t or ""))

    return run(candidate)
