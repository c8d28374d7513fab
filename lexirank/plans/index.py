"""The index as six tables: docs, forward (each document's terms), postings (each term's documents), terms, corpus, texts."""

from __future__ import annotations

from collections.abc import Collection
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import kept_tokens, stem_bag
from ..schemas import INDEX
from ..storage import discard, materialize, scratch

#: The models' constants.
MU, K1, B, K2 = 2000.0, 1.5, 0.75, 500.0
#: Documents in a folder of the forward table: a few documents' terms are read without the rest.
PART_DOCS = 1 << 16
#: Terms that go to all tasks at most.
FREQUENT = 500_000
PACKED, BAG = ("terms", "tfs", "firsts"), "array<struct<term: string, tf: bigint, first_pos: int>>"


@dataclass(frozen=True)
class Index:
    docs: DataFrame
    forward: DataFrame
    postings: DataFrame
    terms: DataFrame
    corpus: DataFrame
    texts: DataFrame | None = None

    def save(self, path: str) -> None:
        for name in INDEX:
            table = getattr(self, name).write.mode("overwrite").option("compression", "zstd")
            (table.partitionBy("part") if name == "forward" else table).parquet(f"{path}/{name}")

    @staticmethod
    def load(spark: SparkSession, path: str) -> Index:
        return Index(**{name: spark.read.schema(ddl).parquet(f"{path}/{name}") for name, ddl in INDEX.items()})


def starts(placed: DataFrame) -> DataFrame:
    """(_range, _start): the number of rows before each range; a row a range. Rows are numbered inside their ranges, so
    nothing but one count a range comes together."""
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    return placed.groupBy("_range").count().select("_range", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))


def part(pos: Column) -> Column:
    """The folder of the forward table that a position is in."""
    return F.floor(pos / PART_DOCS)


def _packed(bag: str) -> list[Column]:
    """A bag as PACKED, a third of its size when moved; no term has a blank."""
    return [F.array_join(f"{bag}.term", " ").alias("terms"), F.col(f"{bag}.tf").cast("array<int>").alias("tfs"), F.col(f"{bag}.first_pos").alias("firsts")]


def _unpacked() -> Column:
    return F.when(F.size("tfs") > 0, F.arrays_zip(F.split("terms", " "), "tfs", "firsts").cast(BAG)).otherwise(F.array().cast(BAG))


def _with_idf(counts: DataFrame, terms: DataFrame) -> DataFrame:
    """counts with idf_smooth. Terms with at least a FREQUENT-th of all postings, most of them, meet it where they are:
    those terms are FREQUENT at most, and no task gets all postings of one of them. The rest goes to the rest."""
    total = terms.agg(F.sum("df")).first()[0] or 0
    frequent = F.broadcast(terms.where(F.col("df") * FREQUENT >= total).select("term", "idf_smooth"))
    rest = terms.where(F.col("df") * FREQUENT < total).select("term", "idf_smooth")
    return counts.join(frequent, "term").unionByName(counts.join(frequent, "term", "left_anti").join(rest, "term").select(*counts.columns, "idf_smooth"), allowMissingColumns=False)


def _length(bag: Column) -> Column:
    return F.aggregate(bag, F.lit(0).cast("long"), lambda n, t: n + t.tf)


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: str | None = None, stop_words: Collection[str] | None = None, path: str | None = None) -> Index:
    """Build the index and write it to path (else into the shared folder). Ids must be unique; order: the corpus order,
    by default the id's. Null text is empty; documents without a term count in the corpus size and mean length."""
    spark = docs.sparkSession
    path = path or scratch(spark, "index")
    rows = docs.select(F.col(id_col).alias("_id"), F.col(order or id_col).alias("_order"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows.select(F.col("_id").cast("string").alias("doc_id"), "text").write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/texts")
    # texts are dealt into ranges and sorted there, and become bags of stems in the same pass; only bags go on
    bagged = rows.repartitionByRange("_order").sortWithinPartitions("_order").withColumn("bag", stem_bag(kept_tokens(F.col("text"), stop_words)))
    place = F.monotonically_increasing_id()  # the range, and the row in it in the lower 33 bits
    placed = materialize(bagged.select(place.alias("_place"), F.col("_id").cast("string").alias("doc_id"), _length(F.col("bag")).alias("dl"), "bag"), "placed")
    placed, written = placed.withColumn("_range", F.shiftright("_place", 33)), placed
    numbered = placed.join(F.broadcast(starts(placed)), "_range").withColumn("pos", F.col("_start") + F.col("_place").bitwiseAND((1 << 33) - 1))
    counts = numbered.select("pos", "dl", F.inline("bag"))

    totals = placed.agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("total_tokens"))
    corpus = totals.select(
        "n", F.when(F.col("n") > 0, F.col("total_tokens") / F.col("n")).otherwise(0.0).alias("adl"), "total_tokens",
        *(F.lit(v).alias(name) for name, v in (("mu", MU), ("k1", K1), ("b", B), ("k2", K2))),
    )
    corpus.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/corpus")
    corpus = spark.read.schema(INDEX["corpus"]).parquet(f"{path}/corpus")

    n, df = F.col("n").cast("double"), F.col("df").cast("double")
    share = df / n
    clipped = F.least(F.greatest(share, F.lit(1e-12)), F.lit(1 - 1e-12))
    terms = counts.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("ctf")).crossJoin(F.broadcast(corpus))
    terms = terms.select(
        "term", "df", "ctf", F.log(n / df).alias("idf_standard"), (F.log((n + 1) / (df + 1)) + 1).alias("idf_smooth"), F.log((n - df + 0.5) / (df + 0.5) + 1).alias("idf_bm25"),
        F.log((1 - clipped) / clipped).alias("idf_bim"), share.alias("bim_pt"), (F.col("ctf") / F.col("total_tokens")).alias("p_collection"),
    )
    terms.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/terms")
    terms = spark.read.schema(INDEX["terms"]).parquet(f"{path}/terms")

    weight = (F.log(F.col("tf").cast("double")) + 1) * F.col("idf_smooth")
    postings = _with_idf(counts, terms).select("term", "pos", "tf", "first_pos", weight.alias("tfidf"), "dl")
    postings.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/postings")
    postings = spark.read.schema(INDEX["postings"]).parquet(f"{path}/postings")

    norms = postings.groupBy("pos").agg(F.sum(F.col("tfidf") * F.col("tfidf")).alias("square"))
    # a document's bag and its length meet in ranges of positions, so a task writes few folders
    both = numbered.select("pos", "doc_id", "dl", *_packed("bag")).unionByName(norms, allowMissingColumns=True).repartitionByRange("pos")
    whole = both.groupBy("pos").agg(*(F.first(c, ignorenulls=True).alias(c) for c in ("doc_id", "dl", *PACKED)), F.sqrt(F.coalesce(F.sum("square"), F.lit(0.0))).alias("norm"))
    forward = whole.select(part(F.col("pos")).alias("part"), "pos", "doc_id", "dl", "norm", _unpacked().alias("bag"))
    forward.sortWithinPartitions("part", "pos").write.partitionBy("part").mode("overwrite").option("compression", "zstd").parquet(f"{path}/forward")
    forward = spark.read.schema(INDEX["forward"]).parquet(f"{path}/forward")
    forward.select("pos", "doc_id", "dl", "norm").write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/docs")
    discard(written)
    return Index.load(spark, path)


def require_unique(docs: DataFrame, id_col: str = "doc_id") -> None:
    """Raise if an id occurs twice."""
    twice = docs.groupBy(id_col).count().where("count > 1").limit(5).collect()
    if twice:
        raise ValueError(f"ids occur more than once: {[r[0] for r in twice]}")
