"""Mixing sources to target weights, with DataFrame functions only.

The words of a source are laid end to end and packed into blocks of a fixed length. Every output shard draws its number
of blocks per source as a multinomial over the targets: each of its slots has a keyed pseudorandom number, and the numbers
that fall into a source's share are counted in the shard's row. A source's counts, run up through the shards, are
stretched to the blocks that its target stands for, so it comes within a block of it rather than within sampling noise. A source's
slots map to its blocks by a pseudorandom permutation of block indices, one epoch after another; a block is joined to its
slots by index, from the block's side: the permutation is inverted, and the block is taken in each epoch in which its slot
was drawn, by the shard that drew it. Documents are joined to the taken blocks by index too: what is taken of a document
is what is taken of the blocks it lies in. That moves one small row for each block taken and one for each document's
piece of a block.

Nothing is gathered by source: offsets come from sums over (source, bucket of rows), so a source with any share of the
rows is spread over all buckets, and rows that repeat are one row with a number until the end.

Defined cases: a null text has size 0; size 0 takes 0; a null source is a source of its own, after all others; repeated
rows are separate documents; a null id is a value like any other; other columns are ignored, but for those that carry
names; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from .common import materialize, word_count

#: Rows that a bucket of offsets stands for, and copies of a row that are told apart in one go.
BUCKET_ROWS, COPIES = 50_000, 1 << 15
#: Slots that have one key where blocks are joined to their shards, blocks that are unrolled in one go and by one task.
RUN, UNROLL, TASK_BLOCKS = 64, 1 << 12, 1 << 18


def sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", carry: Sequence[str] = ()) -> DataFrame:
    """(doc_id, source, carry, size): words of each text."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), *carry, word_count(F.col(text_col)).alias("size"))


def targets(sized: DataFrame, weights: Sequence[float] = (5, 2, 1), cap: float = 3.0) -> DataFrame:
    """(src, source, source_size, target): each source's share of all words by weight, none above cap times its size.

    Sources that reach their cap are those with the smallest cap per weight; with them taken out, the rest share what is
    left by weight. One row per source, so the one ordering over all sources is small.
    """
    by_point = Window.orderBy(F.col("source").asc_nulls_last())
    src = F.row_number().over(by_point) - 1
    cycle = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("src"), F.lit(len(weights))) + 1).cast("int"))
    every = Window.partitionBy()
    before = Window.orderBy("full_at", "src").rowsBetween(Window.unboundedPreceding, -1)
    s = sized.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("src", src).withColumn("weight", cycle)
    s = s.withColumn("most", F.col("source_size") * F.lit(float(cap))).withColumn("full_at", F.col("most") / F.col("weight"))
    s = s.withColumns({"all_words": F.sum("source_size").over(every).cast("double"), "all_weight": F.sum("weight").over(every)})
    s = s.withColumns({"w_before": F.coalesce(F.sum("weight").over(before), F.lit(0.0)), "m_before": F.coalesce(F.sum("most").over(before), F.lit(0.0))})
    s = s.withColumn("capped", (F.col("all_words") - F.col("m_before")) / (F.col("all_weight") - F.col("w_before")) > F.col("full_at"))
    w_capped, m_capped = (F.coalesce(F.sum(F.when(F.col("capped"), F.col(c))).over(every), F.lit(0.0)) for c in ("weight", "most"))
    s = s.withColumn("level", (F.col("all_words") - m_capped) / (F.col("all_weight") - w_capped))
    return s.select("src", "source", "source_size", F.when(F.col("capped"), F.col("most")).otherwise(F.col("weight") * F.col("level")).alias("target"))


def ahead(df: DataFrame, by: Sequence[str], order: str, value: str, name: str, span: int = 4096) -> DataFrame:
    """df with the sum of value over the rows before, by the long column order, which is unique within by. Runs of span
    numbers are summed up first, so no task holds all rows of one value of by."""
    df = df.withColumn("_span", F.floor(F.col(order) / span))
    of = Window.partitionBy(*by).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    base = df.groupBy(*by, "_span").agg(F.sum(value).alias("_sum")).select(*by, "_span", F.coalesce(F.sum("_sum").over(of), F.lit(0)).alias("_until_span"))
    inside = Window.partitionBy(*by, "_span").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    rows = df.withColumn("_in_span", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return rows.join(base, [*by, "_span"]).withColumn(name, (F.col("_until_span") + F.col("_in_span")).cast("long")).drop("_span", "_until_span", "_in_span")


def _buckets(rows: DataFrame) -> int:
    """Buckets of about BUCKET_ROWS rows, and enough for all tasks to have one of each source."""
    return max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows.count() // BUCKET_ROWS)


def points(n: Column, key: Column, seed: int, rounds: int = 8) -> Column:
    """What a permutation of 0 to n - 1 turns about in each round."""
    return F.transform(F.sequence(F.lit(1), F.lit(rounds)), lambda r: F.pmod(F.xxhash64(key, F.lit(seed), r), n))


def permuted(x: Column, n: Column, about: Column, seed: int) -> Column:
    """The image of x (0 to n - 1) under the pseudorandom permutation that turns about these points.

    Swap-or-not: in each round an index and its mirror image about the round's point change places on a keyed coin. A
    round undoes itself, so the points in reverse give the inverse. The rounds are a fold, one expression, as chained
    columns would double it in every round.
    """

    def swap(at: Column, point: Column) -> Column:
        other = F.pmod(point - at, n)
        coin = F.xxhash64(F.greatest(at, other), point, F.lit(seed)).bitwiseAND(F.lit(1))
        return F.when(coin == 1, other).otherwise(at)

    return F.aggregate(about, x, swap)


def block_plan(goal: DataFrame, cap: float, block_words: int) -> DataFrame:
    """(src, source_size, n_blocks, n_slots): a source's last block may be short, so slots are counted in epochs of the
    whole source; an epoch takes each block once."""
    plan = goal.withColumn("n_blocks", F.ceil(F.col("source_size") / block_words)).where("n_blocks > 0")
    slots = F.least(F.round(F.col("target") * F.col("n_blocks") / F.col("source_size")), F.floor(F.col("n_blocks") * F.lit(float(cap))))
    return plan.select("src", "source_size", "n_blocks", slots.cast("long").alias("n_slots"))


def draws(plan: DataFrame, shard_blocks: int = 4096, seed: int = 0) -> DataFrame:
    """(shard, src, n): how many blocks each output shard of shard_blocks draws from each source, a multinomial with the
    sources' shares of the slots. plan: src, n_slots, a row for each source."""
    before = Window.orderBy("src").rowsBetween(Window.unboundedPreceding, -1)
    deck = plan.select("src", F.coalesce(F.sum("n_slots").over(before), F.lit(0)).alias("at"), "n_slots")
    total = plan.agg(F.sum("n_slots")).first()[0] or 0
    if not total:
        return plan.select(F.lit(0).cast("long").alias("shard"), "src", F.lit(0).cast("long").alias("n")).where("false")
    shares = deck.agg(F.collect_list(F.struct("src", "at", "n_slots")).alias("shares"))  # one row
    shards = plan.sparkSession.range(-(-total // shard_blocks)).withColumnRenamed("id", "shard")
    slots = F.sequence(F.lit(1), F.least(F.lit(shard_blocks), total - F.col("shard") * shard_blocks).cast("int"))
    mark = lambda i: F.pmod(F.xxhash64("shard", i, F.lit(seed)), F.lit(total))
    count = lambda s: F.aggregate(slots, F.lit(0).cast("long"), lambda n, i: n + mark(i).between(s.at, s.at + s.n_slots - 1).cast("long"))
    drawn = F.transform("shares", lambda s: F.struct(s.src.alias("src"), count(s).alias("n")))
    return shards.join(F.broadcast(shares), F.lit(True)).select("shard", F.inline(drawn))


def shard_slots(drawn: DataFrame, plan: DataFrame) -> DataFrame:
    """(shard, src, first, upto): the slots of its source that each shard takes, first to upto - 1. The running counts of
    a source are stretched to its n_slots; a source that no shard has drawn is spread evenly."""
    whole = drawn.groupBy("src").agg(F.sum("n").alias("drawn"), F.count("*").alias("shards")).join(plan.select("src", "n_slots"), "src")
    rows = ahead(drawn, ["src"], "shard", "n", "at").join(whole, "src")
    stretch = lambda x, k: F.expr(f"CAST(CASE WHEN drawn > 0 THEN CAST({x} AS DECIMAL(19,0)) * CAST(n_slots AS DECIMAL(19,0)) div drawn ELSE CAST({k} AS DECIMAL(19,0)) * CAST(n_slots AS DECIMAL(19,0)) div shards END AS BIGINT)")
    return rows.select("shard", "src", stretch("at", "shard").alias("first"), stretch("(at + n)", "(shard + 1)").alias("upto"))


def mixed_blocks(plan: DataFrame, shard_blocks: int = 4096, seed: int = 0) -> DataFrame:
    """(shard, src, epoch, block) for every block of the mix: one row for each block that is taken. Blocks find their shard
    by index: a slot's run of RUN slots and the runs that a shard's slots touch are the key. Tables that grow by unrolling
    look small to the planner, so the join is told to sort rather than to broadcast, and the number of tasks is given."""
    runs = shard_slots(materialize(draws(plan, shard_blocks, seed), "draws"), plan).where("upto > first")
    runs = runs.withColumn("run", F.explode(F.sequence(F.expr(f"first div {RUN}"), F.expr(f"(upto - 1) div {RUN}"))))
    epochs = plan.where("n_slots > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.expr("(n_slots - 1) div n_blocks"))))
    epochs = epochs.withColumn("points", points(F.col("n_blocks"), F.struct("src", "epoch"), seed))
    step = F.expr(f"(n_blocks - 1) div {UNROLL}")
    tasks = max(int(plan.sparkSession.conf.get("spark.sql.shuffle.partitions")), (plan.agg(F.sum("n_slots")).first()[0] or 0) // TASK_BLOCKS)
    parts = epochs.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), step))).repartition(tasks, "src", "epoch", "_part")
    blocks = parts.withColumn("block", F.explode(F.sequence(F.col("_part") * UNROLL, F.least(F.col("n_blocks"), (F.col("_part") + 1) * UNROLL) - 1)))
    slot = F.col("epoch") * F.col("n_blocks") + permuted(F.col("block"), F.col("n_blocks"), F.reverse("points"), seed)
    blocks = blocks.withColumn("slot", slot).where("slot < n_slots").select("src", "epoch", "block", "slot", F.expr(f"slot div {RUN}").alias("run"))
    return blocks.join(runs.hint("merge"), ["src", "run"]).where("slot >= first AND slot < upto").select("shard", "src", "epoch", "block")


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = (5, 2, 1), cap: float = 3.0, block_words: int = 64, shard_blocks: int = 4096, seed: int = 0, carry: Sequence[str] = ()) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken (words, repeats counted), n_shards (output
    shards that take words of it), and the columns that carry names."""
    sized = materialize(sizes(docs, id_col, text_col, source_col, carry), "sizes")
    goal = materialize(targets(sized, weights, cap), "targets")
    blocks = mixed_blocks(block_plan(goal, cap, block_words), shard_blocks, seed).select("src", "block", "shard")

    known = goal.withColumnRenamed("source", "_source")
    own = ["doc_id", "size", *carry]
    rows = sized.groupBy("source", *own).agg(F.count("*").alias("_copies")).withColumn("_words", F.col("size") * F.col("_copies"))
    rows = rows.join(known, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    n_buckets = _buckets(sized)
    rows = rows.withColumn("_bucket", F.pmod(F.xxhash64(*own), F.lit(n_buckets)))
    start = ahead(rows.groupBy("src", "_bucket").agg(F.sum("_words").alias("words")), ["src"], "_bucket", "words", "_base").drop("words")
    inside = Window.partitionBy("src", "_bucket").orderBy(*own).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_lo", F.coalesce(F.sum("_words").over(inside), F.lit(0)))
    rows = rows.join(start, ["src", "_bucket"]).withColumn("_lo", F.col("_lo") + F.col("_base"))

    part = rows.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(_copies - 1) div {COPIES}"))))
    part = part.where("_part = 0").unionByName(part.where("_part > 0").repartition("_part", *own))
    each = part.withColumn("_copy", F.explode(F.sequence(F.col("_part") * COPIES, F.least(F.col("_copies"), (F.col("_part") + 1) * COPIES) - 1)))
    each = each.withColumn("_lo", F.col("_lo") + F.col("_copy") * F.col("size"))
    each = materialize(each.select("src", "_lo", "doc_id", "source", "size", "source_size", "target", *carry), "offsets")

    # a document with words is told apart by its offset; it lies in the blocks from `first` to `last`
    whole = each.where("size > 0").select("src", "_lo", "size", F.expr(f"_lo div {block_words}").alias("first"), F.expr(f"(_lo + size - 1) div {block_words}").alias("last"))
    long = whole.withColumn("from", F.explode(F.sequence("first", "last", F.lit(UNROLL).cast("long"))))
    long = long.where("from = first").unionByName(long.where("from > first").repartition(n_buckets, "src", "from"))
    pieces = long.withColumn("block", F.explode(F.sequence("from", F.least(F.col("last"), F.col("from") + UNROLL - 1))))
    words = F.least(F.col("_lo") + F.col("size"), (F.col("block") + 1) * block_words) - F.greatest(F.col("_lo"), F.col("block") * block_words)
    got = pieces.select("src", "_lo", "block", words.alias("words")).join(blocks.hint("merge"), ["src", "block"])
    got = got.groupBy("src", "_lo", "shard").agg(F.sum("words").alias("words"))
    got = got.groupBy("src", "_lo").agg(F.sum("words").alias("_taken"), F.count("*").alias("_shards"))

    counts = [F.coalesce(F.col(c), F.lit(0).cast("long")).alias(name) for c, name in (("_taken", "taken"), ("_shards", "n_shards"))]
    none = [F.lit(0).cast("long").alias(name) for name in ("taken", "n_shards")]
    shown = ["doc_id", "source", "size", "source_size", "target"]
    found = each.where("size > 0").join(got.hint("merge"), ["src", "_lo"], "left").select(*shown, *counts, *carry)
    return found.unionByName(each.where("size = 0").select(*shown, *none, *carry))


def whole_copies(mixed: DataFrame, seed: int = 0, carry: Sequence[str] = ()) -> DataFrame:
    """(doc_id, source, size, copies, carry) for rows of mix_sources: how often to take each document as a whole.

    A document is taken once for each full size taken of it. Its rest, as a share of its size, is laid end to end with
    those of its source by size, from a pseudorandom start on, and a document whose share crosses a whole number is taken
    once more. So shares are chances, documents of every length have theirs, and a source's words differ from what the mix
    takes by at most the size of its longest document. As in mix_sources, nothing is gathered by source: offsets are sums
    over (source, size), then over buckets of rows. Documents of size 0 have 0 copies.
    """
    unit = 1 << 30  # shares are counted in these parts: sums of integers do not depend on their order
    share = F.when(F.col("size") > 0, F.round(F.expr("taken % size") * F.lit(float(unit)) / F.col("size"))).otherwise(0).cast("long")
    full = F.when(F.col("size") > 0, F.expr("taken div size")).otherwise(0)
    n_buckets = _buckets(mixed)
    rows = mixed.select("doc_id", "source", "size", *carry, full.alias("full"), share.alias("share"), F.pmod(F.xxhash64("doc_id", *carry), F.lit(n_buckets)).alias("bucket"))
    rows = materialize(rows, "shares")

    def before(of: WindowSpec) -> Column:
        return F.coalesce(F.sum("shares").over(of.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))

    sums = rows.groupBy("source", "size", "bucket").agg(F.sum("share").alias("shares"))
    by_size = sums.groupBy("source", "size").agg(F.sum("shares").alias("shares"))
    first = F.pmod(F.xxhash64("source", F.lit(seed)), F.lit(unit))
    by_size = by_size.select(F.col("source").alias("_source"), F.col("size").alias("_size"), (first + before(Window.partitionBy("source").orderBy("size"))).alias("start"))
    base = sums.withColumn("inside", before(Window.partitionBy("source", "size").orderBy("bucket")))
    base = base.join(by_size, F.col("source").eqNullSafe(F.col("_source")) & (F.col("size") == F.col("_size")))
    base = base.select("_source", "_size", F.col("bucket").alias("_bucket"), (F.col("start") + F.col("inside")).alias("base"))
    rows = rows.join(base, F.col("source").eqNullSafe(F.col("_source")) & (F.col("size") == F.col("_size")) & (F.col("bucket") == F.col("_bucket")))
    upto = F.col("base") + F.sum("share").over(Window.partitionBy("source", "size", "bucket").orderBy("doc_id", "full", "share", *carry).rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("upto", upto)
    return rows.select("doc_id", "source", "size", F.expr(f"cast(full + upto div {unit} - (upto - share) div {unit} AS int)").alias("copies"), *carry)
