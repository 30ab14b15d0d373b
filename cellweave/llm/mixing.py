"""Operator 8: mixing sources to target weights.

Documents of a source follow one another in a hash order; their words, taken as tokens, fill
blocks of ``block`` tokens.  A mix consists of slots, one block each, dealt into output shards of
``shard`` slots.  Each shard draws its source counts from the multinomial law of the targets; the
draws that would carry a source past its quota (its target in blocks) go to the sources that are
still short, so each source ends within one block of its target.  A source's k-th slot takes block
``permutation(k mod blocks)`` of pass ``k div blocks``, an affine permutation of the block numbers
that differs by source and pass; slots and blocks then join by block number.  A document thus gets
whole passes plus a part of one.

All of it is DataFrame functions.  Prefix sums run in two levels (hash buckets within a source,
then documents within a bucket), so a source with a third of all rows is spread over many tasks.
Only totals, one number each, come to the driver.

Defined cases: a null text has size 0; a null source is a source of its own, last in order; a
document of size 0 takes no words; a table without words gives targets 0; repeated rows are
documents of their own and share alike up to the order of equal rows; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, digest, input_rows, materialize

#: Primes for the steps of the permutations; no block number is divisible by all.
PRIMES = (2147483647, 2147483629, 2147483587)
CYCLE = (1, 2, 3)
CAP = 3


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """source, source_size -> also target (double).

    Sources by code point, null last, weigh 1, 2, 3 in turn and share the sum of all sizes; none
    gets over ``CAP`` times its size.  Sharing the excess by weight until none is above comes to
    target = min(cap, weight x level).  The level is the largest of (total - caps of the sources
    before) / (weights of the rest) over sources in order of cap / weight.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, CYCLE)), ((F.row_number().over(order) - 1) % len(CYCLE) + 1).cast("int")).cast("double"))
    w = w.withColumn("cap", CAP * F.col("source_size").cast("double")).withColumn("ratio", F.col("cap") / F.col("weight"))
    upto = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    rest = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(0, Window.unboundedFollowing)
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    w = w.withColumn("level", (F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(upto), F.lit(0.0))) / F.sum("weight").over(rest))
    w = w.withColumn("level", F.max("level").over(every))
    return w.select("source", "source_size", F.least(F.col("cap"), F.col("weight") * F.col("level")).alias("target"))


def block_of(k: Column, blocks: Column, source: Column, seed: int) -> Column:
    """Block number of a source's k-th slot: (step x (k mod blocks) + shift) mod blocks.

    The step is the residue of a prime that doesn't divide ``blocks``, hence without a common
    divisor; the shift is hashed from source and pass.  The product is taken in halves of the step, so
    that it fits 64 bits up to 2^46 blocks.
    """
    step = F.lit(PRIMES[-1])
    for p in PRIMES[-2::-1]:
        step = F.when(blocks % p != 0, F.lit(p)).otherwise(step)
    shift = F.pmod(digest(source, F.floor(k / blocks), F.lit(seed)), blocks)
    at, step = F.pmod(k, blocks), step.cast("long") % blocks
    high = at * F.floor(step / 65536) % blocks * 65536 % blocks
    return F.pmod(high + at * (step % 65536) % blocks + shift, blocks)


def in_ranges(points: DataFrame, at: str, ranges: DataFrame, low: str, high: str, width: int) -> DataFrame:
    """Each point with the range [low, high) that holds it: an equi-join on cells of ``width``."""
    cells = ranges.where(F.col(low) < F.col(high)).withColumn("cell", F.explode(F.sequence(F.floor(F.col(low) / width), F.floor((F.col(high) - 1) / width))))
    return points.withColumn("cell", F.floor(F.col(at) / width)).join(cells, "cell").where((F.col(at) >= F.col(low)) & (F.col(at) < F.col(high))).drop("cell")


def mix(docs: DataFrame, block: int = 64, shard: int = 16384, bucket_rows: int = 1024, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", carry: tuple[str, ...] = ()) -> dict[str, DataFrame]:
    """The mix as tables.

    documents: row, doc_id, source, size, source_size, target, first (its first word's number
    within its source) and the carried columns as a struct.  slots: shard, source, k, block.
    parts: row, block, skip (the document's words in front of this part), words, times (how often
    the mix takes the block).
    """
    spark = docs.sparkSession
    base = input_rows(docs, *dict.fromkeys([id_col, source_col, text_col, *carry]))
    base = base.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), n_words(F.col(text_col)).alias("size"), digest(F.col(text_col)).alias("mark"), F.struct(*[F.col(c) for c in carry or (id_col,)]).alias("carried"))
    base = materialize(base.withColumn("row", F.monotonically_increasing_id()), "mix")
    n_docs = base.count()
    n_buckets = max(1, -(-n_docs // bucket_rows))

    # targets, and quotas in whole blocks by cumulative rounding, so that they add up
    goal = targets(base.groupBy("source").agg(F.sum("size").alias("source_size"))).withColumn("blocks", F.ceil(F.col("source_size") / block))
    by_source = Window.orderBy(F.col("source").asc_nulls_last())
    upto = F.coalesce(F.sum(F.coalesce(F.try_divide(F.col("target") * F.col("blocks"), F.col("source_size")), F.lit(0.0))).over(by_source.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0.0))
    goal = goal.withColumn("q_to", F.round(upto).cast("long"))
    goal = goal.withColumn("q_from", F.coalesce(F.lag("q_to").over(by_source), F.lit(0).cast("long")))
    goal = materialize(goal, "mix")
    n_slots = goal.agg(F.coalesce(F.max("q_to"), F.lit(0))).first()[0]
    width = max(1, -(-n_slots // 4096))

    # the first word of each document within its source
    base = base.withColumn("bucket", F.pmod(digest("doc_id", "mark", F.lit(seed)), F.lit(n_buckets)))
    sums = base.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    sums = sums.select("source", "bucket", F.coalesce(F.sum("words").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))
    within = Window.partitionBy("source", "bucket").orderBy("doc_id", "mark", "row").rowsBetween(Window.unboundedPreceding, -1)
    placed = base.select("row", "doc_id", "source", "size", "mark", "bucket").withColumn("inside", F.coalesce(F.sum("size").over(within), F.lit(0)))
    placed = placed.join(sums, placed.source.eqNullSafe(sums.source) & (placed.bucket == sums.bucket)).select(placed["*"], "ahead")
    placed = placed.join(goal, placed.source.eqNullSafe(goal.source)).select("row", "doc_id", placed.source, "size", "source_size", "target", (F.col("ahead") + F.col("inside")).alias("first"))
    placed = materialize(placed, "mix")

    # multinomial source counts per shard
    drawn = spark.range(0, n_slots, 1, max(1, min(8192, n_slots // 200_000))).select(F.floor(F.col("id") / shard).alias("shard"), F.pmod(digest("id", F.lit(seed)), F.lit(max(1, n_slots))).alias("u"))
    counts = in_ranges(drawn, "u", goal.select("source", "q_from", "q_to"), "q_from", "q_to", width).groupBy("shard", "source").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    quota = goal.select("source", "blocks", (F.col("q_to") - F.col("q_from")).alias("quota"))
    counts = counts.withColumn("before", before)
    counts = counts.join(quota, counts.source.eqNullSafe(quota.source)).select("shard", counts.source, "n", "before", "blocks", F.greatest(F.lit(0), F.least(F.col("n"), F.col("quota") - F.col("before"))).alias("held"), "quota")
    counts = materialize(counts, "mix")
    held = counts.where("held > 0").select("shard", "source", "blocks", F.explode(F.sequence(F.col("before"), F.col("before") + F.col("held") - 1)).alias("k"))

    # draws past a quota, numbered over all shards, go to what the other sources lack
    over = counts.where("n > held").select("shard", "source", (F.col("n") - F.col("held")).alias("spare"))
    per_shard = over.groupBy("shard").agg(F.sum("spare").alias("spares")).select("shard", F.coalesce(F.sum("spares").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))
    inside = F.coalesce(F.sum("spare").over(Window.partitionBy("shard").orderBy(F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    over = over.withColumn("inside", inside).join(per_shard, "shard").select("shard", F.explode(F.sequence(F.col("ahead") + F.col("inside"), F.col("ahead") + F.col("inside") + F.col("spare") - 1)).alias("spare"))
    had = counts.groupBy("source").agg(F.sum("n").alias("had"))
    short = quota.join(had, quota.source.eqNullSafe(had.source), "left").select(quota.source, "blocks", F.coalesce("had", F.lit(0)).alias("had"), (F.col("quota") - F.coalesce("had", F.lit(0))).alias("lack")).where("lack > 0")
    short = short.withColumn("lack_to", F.sum("lack").over(by_source.rowsBetween(Window.unboundedPreceding, 0))).withColumn("lack_from", F.col("lack_to") - F.col("lack"))
    moved = in_ranges(over, "spare", short, "lack_from", "lack_to", width).select("shard", "source", "blocks", (F.col("had") + F.col("spare") - F.col("lack_from")).alias("k"))
    slots = held.unionByName(moved).withColumn("block", block_of(F.col("k"), F.col("blocks"), F.col("source"), seed)).drop("blocks")

    # slots meet blocks by number
    times = slots.groupBy("source", "block").agg(F.count(F.lit(1)).alias("times"))
    parts = placed.where("size > 0").select("row", "source", "first", "size", F.explode(F.sequence(F.floor(F.col("first") / block), F.floor((F.col("first") + F.col("size") - 1) / block))).alias("block"))
    start = F.greatest(F.col("first"), F.col("block") * block)
    parts = parts.select("row", "source", "block", (start - F.col("first")).alias("skip"), (F.least(F.col("first") + F.col("size"), (F.col("block") + 1) * block) - start).alias("words"))
    parts = parts.join(times, parts.source.eqNullSafe(times.source) & (parts.block == times.block)).select("row", parts.block, "skip", "words", "times")
    return {"documents": placed, "carried": base.select("row", "carried", F.col("size").alias("all_words")), "slots": slots, "parts": parts}


def taken(mixed: dict[str, DataFrame]) -> DataFrame:
    """documents with taken, the words that the mix takes, repeats counted."""
    sums = mixed["parts"].groupBy("row").agg(F.sum(F.col("words") * F.col("times")).alias("taken"))
    return mixed["documents"].join(sums, "row", "left").withColumn("taken", F.coalesce("taken", F.lit(0)).cast("long"))


def mixed_documents(docs: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The mix as documents with the columns of ``docs``: one row per document and pass.

    A pass that takes all blocks of a document repeats it as it is; a pass that takes some of them
    gives the text of those parts, white space included.  n_chars, where it is a column, follows.
    """
    mixed = mix(docs, text_col=text_col, carry=tuple(docs.columns), **options)
    own = mixed["parts"].groupBy("row").agg(F.min("times").alias("least"), F.sum("words").alias("found"), F.max("times").alias("most"), F.array_sort(F.collect_list(F.struct("skip", "words", "times"))).alias("parts"))
    rows = mixed["carried"].join(own, "row").withColumn("pass", F.explode(F.sequence(F.lit(1).cast("long"), F.col("most"))))
    text = F.col("carried")[text_col]
    pieces = F.regexp_extract_all(text, F.lit(r"([^\x20\x09-\x0D]+[\x20\x09-\x0D]*)"), F.lit(1))
    some = F.array_join(F.flatten(F.transform(F.filter("parts", lambda p: p["times"] >= F.col("pass")), lambda p: F.slice(pieces, (p["skip"] + 1).cast("int"), p["words"].cast("int")))), "")
    rows = rows.withColumn("new_text", F.when((F.col("pass") <= F.col("least")) & (F.col("found") == F.col("all_words")), text).otherwise(some))
    columns = [F.col("new_text").alias(c) if c == text_col else F.length("new_text").cast("long").alias(c) if c == "n_chars" else F.col("carried")[c].alias(c) for c in docs.columns]
    return rows.select(*columns)
