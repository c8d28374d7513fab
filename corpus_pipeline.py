"""A training corpus from documents: quality, exact and near duplicates, mixture, tokens.

Each stage takes what the one before kept, as (spark, docs, sf_dir), and returns the columns of documents; the last one
returns tokens. Every stage's result is written as Parquet and read again.

A stage that keeps some rows writes them with a number of their own first and decides by that, so ids may be null, shared
or repeated and columns may have any name but doc_id, text and source twice. Defined cases: a null text is an empty one;
the empty text has a quality like any other, is one group of exact copies, has no near copies, and is in no mix, as it has
no words; of a group of copies one row stays, the one with the smallest id, null ids last; of rows that share that id any
one; a null source is a source of its own; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexirank.llm import quality
from lexirank.llm.bpe import bpe_digests
from lexirank.llm.common import discard, held_out, materialize, read
from lexirank.llm.exact_dedup import exact_dedup
from lexirank.llm.jaccard_join import near_duplicates
from lexirank.llm.mixing import mix_sources, whole_copies

#: A document stays if its estimated probability of being good is at least this.
MIN_QUALITY = 0.7


def _fresh(docs: DataFrame, name: str) -> str:
    """A column name like name that docs does not have, in any case."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def _numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a number for each row, written, so that it is the same whenever it is read; and that column's name."""
    row = _fresh(docs, "row_number")
    return materialize(docs.withColumn(row, F.monotonically_increasing_id()), "numbered"), row


def _one_of_each(docs: DataFrame, row: str, groups: DataFrame, group: str) -> DataFrame:
    """The rows of docs that are the first of their group by doc_id; groups: (doc_id, which is the row's number, group).
    All that is moved for it are numbers, and a group's minimum is made in the tasks before it is moved."""
    ids = docs.select(F.col(row).alias("_n"), F.col("doc_id").cast("long").alias("_id"))
    order = F.struct(F.col("_id").isNull().alias("none"), "_id", "_n")
    first = groups.select(F.col("doc_id").alias("_n"), F.col(group).alias("_group")).join(ids, "_n").groupBy("_group").agg(F.min(order).alias("first"))
    return _rows(docs, row, first.select("first._n"))


def _rows(docs: DataFrame, row: str, numbers: DataFrame) -> DataFrame:
    return docs.join(numbers.withColumnRenamed("_n", row), row, "left_semi").drop(row)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    model, score = quality.train(docs, read(spark, sf_dir, "labels"), ~held_out(F.col("doc_id"), 4, 2)), _fresh(docs, "quality_score")
    return quality.apply(docs, model, score_col=score).where(F.col(score) >= MIN_QUALITY).drop(score)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the smallest id."""
    numbered, row = _numbered(docs)
    return _one_of_each(numbered, row, exact_dedup(numbered, id_col=row), "keep_id")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that near-duplicate links connect, the one with the smallest id; documents without a word stay."""
    numbered, row = _numbered(docs)
    return _one_of_each(numbered, row, near_duplicates(numbered, id_col=row), "component_id")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes its words: once for each full size taken, and for the rest once more with
    the rest's share of its size as the chance. Each source's words come within one document of what the mix takes. The
    draws go by doc_id; the row's number only tells rows of one id apart."""
    numbered, row = _numbered(docs)
    mixed = materialize(mix_sources(numbered, carry=[row]), "mixed")
    times, copy = _fresh(docs, "times"), _fresh(docs, "copy")
    taken = whole_copies(mixed, carry=[row]).where("copies > 0").select(row, F.col("copies").alias(times))
    out = numbered.join(taken, row)
    return out.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times)))).drop(row, times, copy)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokens of each document of the mix: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    import public_tokenizers

    return bpe_digests(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality classifier", keep_quality),
    ("exact dedup", drop_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing sources", mix),
    ("BPE encoding", tokenize),
]

#: Learned scores and pseudorandom draws have no SQL; the stages are tested one by one against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES:
        before, docs = docs, materialize(stage(spark, docs, sf_dir), "stage")
        discard(before)
    return docs
