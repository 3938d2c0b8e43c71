"""Chat formatting: conversations logged again and again while they grow are collapsed to the longest, then rendered."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import checkpoint, hot_join, shuffle_tasks

#: Turns of a conversation that one task orders, and that one rendered part holds at most.
PART = 256


def numbered(turns: DataFrame) -> DataFrame:
    """(conv_id, pos, role, text): rows without a conversation are left out, pos is 1, 2, ... by turn (nulls first), role, text.

    Rows are counted first, then put in order as ranges of all conversations, so that neither a conversation of any length nor very many turns of one number, null or equal, meet in one
    task; a range ranks its rows, and the ranges' counts give what comes before.
    """
    order = [F.col("conv_id"), *[F.col(c).asc_nulls_first() for c in ("turn", "role", "text")]]
    counted = turns.where("conv_id is not null").groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("n"))
    ranges = counted.repartitionByRange(shuffle_tasks(turns.sparkSession), *order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    ranges = checkpoint(ranges.withColumn("range", F.shiftright("at", 33)))
    sums = ranges.groupBy("conv_id", "range").agg(F.sum("n").alias("n"))
    before = Window.partitionBy("conv_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each task that holds some of a conversation
    offsets = sums.select("conv_id", "range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    inner = F.sum("n").over(Window.partitionBy("conv_id", "range").orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
    placed = ranges.withColumn("last", inner).join(offsets, ["conv_id", "range"]).withColumn("last", F.col("last") + F.col("earlier"))
    # equal turns in stretches of PART, each then by itself
    stretch = F.explode(F.sequence(F.col("last") - F.col("n") + 1, F.col("last"), F.lit(PART).cast("long")))
    stretches = placed.withColumn("from", stretch)
    return stretches.select("conv_id", F.explode(F.sequence("from", F.least(F.col("from") + PART - 1, F.col("last")))).alias("pos"), "role", "text")


def _rolling(pos: DataFrame) -> DataFrame:
    """Adds h1, h2: 128 bits over all turns up to this one, rolled forward by exclusive or of each turn's hash with its position."""
    turn = [F.xxhash64("pos", F.lit(salt), F.coalesce(F.concat(F.lit("r"), "role"), F.lit("")), F.coalesce(F.concat(F.lit("t"), "text"), F.lit(""))) for salt in (1, 2)]
    rows = pos.select("conv_id", "pos", turn[0].alias("g1"), turn[1].alias("g2")).withColumn("part", F.floor((F.col("pos") - 1) / PART))
    inner = Window.partitionBy("conv_id", "part").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy("conv_id", "part").agg(F.bit_xor("g1").alias("p1"), F.bit_xor("g2").alias("p2"))
    parts = parts.select("conv_id", "part", *[F.coalesce(F.bit_xor(f"p{k}").over(before), F.lit(0).cast("long")).alias(f"q{k}") for k in (1, 2)])
    rolled = rows.select("conv_id", "part", "pos", *[F.bit_xor(f"g{k}").over(inner).alias(f"i{k}") for k in (1, 2)])
    return rolled.join(parts, ["conv_id", "part"]).select("conv_id", "pos", *[F.col(f"i{k}").bitwiseXOR(F.col(f"q{k}")).alias(f"h{k}") for k in (1, 2)])


def maximal(pos: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_same): conversations that are no proper prefix of another, of equal ones the smallest conv_id.

    n_same counts the equal conversations, itself included. Prefix hashes are made distinct before the anti join, so
    a first turn that a third of all conversations share is one row there.
    """
    rolled = checkpoint(_rolling(pos))
    lengths = checkpoint(rolled.groupBy("conv_id").agg(F.max("pos").alias("n_turns")))
    told = hot_join(rolled, lengths, "conv_id", F.col("n_turns"), rolled.count())
    single = told.where("pos = n_turns").groupBy("n_turns", "h1", "h2").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_same"))
    inside = told.where("pos < n_turns").select(F.col("pos").alias("n_turns"), "h1", "h2").distinct()
    return single.join(inside, ["n_turns", "h1", "h2"], "left_anti").select("conv_id", "n_turns", "n_same")


def render(turns: DataFrame) -> DataFrame:
    """(conv_id, part, n_turns, n_same, text): each maximal conversation as <|role|> lines, in parts of PART turns (nearly always one).

    Role null is unknown, text null is empty. Conversations that are equal or begin a longer one are left out. Turns that tie are ordered by role and
    text, and equal turns stay, each at its own place; rows without a conversation are left out, and an empty table gives none.
    """
    pos = checkpoint(numbered(turns))
    kept = checkpoint(maximal(pos))
    line = F.concat(F.lit("<|"), F.coalesce("role", F.lit("unknown")), F.lit("|>\n"), F.coalesce("text", F.lit("")), F.lit("<|end|>\n"))
    rows = hot_join(pos, kept, "conv_id", F.col("n_turns"), pos.count()).withColumn("part", F.floor((F.col("pos") - 1) / PART).cast("long"))
    listed = rows.groupBy("conv_id", "part", "n_turns", "n_same").agg(F.array_sort(F.collect_list(F.struct("pos", line.alias("line")))).alias("lines"))
    return listed.select("conv_id", "part", F.col("n_turns").cast("long").alias("n_turns"), "n_same", F.array_join(F.transform("lines", lambda x: x["line"]), "").alias("text"))
