"""Mixing sources to target weights by Pfair scheduling, in Catalyst only.

Each source's documents, in the order of md5(id), form blocks of `block_rows`. With q of the M
slots of a period, block j (from 0) of a source is released at floor(j*M/q) and due at
ceil((j+1)*M/q); every slot runs the released block that is due first. The quotas add up to M,
so no deadline is missed and after any number of slots each source is less than one block from
its target. A schedule repeats after M slots, so one period is worked out (in one row, by a
higher-order function) and all blocks are placed by it.

A source's documents are ranked in pieces, the leading digits of md5(id), with the sizes of the
pieces before added, so that one hot source is not sorted in one task. The number of pieces does
not change the ranks.

Defined results: a null source is a source of its own, the empty string; a null id counts as an
empty one; repeated rows are placed one after another; a source without a weight in `weights`
gets the smallest quota, one slot; an empty table gives an empty one. in_mix is false from the
first slot on whose source has run out: up to there the shares hold, later they cannot. From there
on the slots of that source stay empty and the others keep theirs, so all rows have a place and
the shares of the rest, among each other, go on.
M doubles until each source can have two slots. The schedule's work is sources times M in one row,
so it is for up to thousands of sources; rows, however many a source has, are in no one task. A
text's length plays no part; other columns come along in the struct, whatever their names.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinmatch.llm.common import quoted, saved, whole

#: Slots of a period up to which the sources' slots are broadcast (8 bytes each); beyond, they are joined on a salted key.
BROADCAST_SLOTS = 1 << 20
SALT = 32


@dataclass(frozen=True)
class Mix:
    #: Target weights; where None, each source's number of rows to the power `alpha`.
    weights: Mapping[str, float] | None = None
    alpha: float = 0.95
    block_rows: int = 16
    slots: int = 1024
    #: Rows of a source ranked in one piece, about.
    piece_rows: int = 50_000


def quotas(counts: DataFrame, mix: Mix) -> DataFrame:
    """source, n, k (number of the source), quota, period: integer quotas by largest remainder, at least 1."""
    if mix.weights is None:
        weight = F.pow(F.col("n").cast("double"), mix.alpha)
    else:
        pairs = [F.lit(x) for s, w in mix.weights.items() for x in (s, float(w))]
        weight = F.coalesce(F.try_element_at(F.create_map(*pairs), "source"), F.lit(0.0)) if pairs else F.lit(0.0)
    every = Window.partitionBy()
    sized = counts.withColumn("w", weight).withColumn("sources", F.count("*").over(every)).withColumn("total", F.sum("w").over(every))
    period = mix.slots * F.pow(2.0, F.greatest(F.lit(0), F.ceil(F.log2(2 * F.col("sources") / F.lit(float(mix.slots)))))).cast("long")
    # One slot for each source, the others by weight.
    share = F.when(F.col("total") > 0, F.col("w") / F.col("total")).otherwise(1 / F.col("sources")) * (F.col("period") - F.col("sources"))
    sized = sized.withColumn("period", period).withColumn("share", share).withColumn("low", F.floor("share"))
    left = F.col("period") - F.col("sources") - F.sum("low").over(every)
    order = Window.orderBy((F.col("low") - F.round("share", 9)), "source")
    sized = sized.withColumn("left", left).withColumn("quota", F.lit(1) + F.col("low") + (F.row_number().over(order) <= F.col("left")).cast("long"))
    return sized.select("source", "n", (F.row_number().over(Window.orderBy("source")) - 1).alias("k"), F.col("quota").cast("long").alias("quota"), "period")


def schedule(quota: DataFrame) -> DataFrame:
    """source, quota, period, j, slot: the slot of each of a source's blocks in one period, earliest deadline first."""
    table = quota.agg(F.array_sort(F.collect_list(F.struct("k", "quota"))).alias("q"), F.max("period").alias("m")).where(F.size("q") > 0)

    def step(acc: Column, t: Column) -> Column:
        def due(q: Column, c: Column) -> Column:
            release, deadline = F.floor(c * F.col("m") / q["quota"]), F.ceil((c + 1) * F.col("m") / q["quota"])
            return F.when((c < q["quota"]) & (release <= t), F.struct(deadline.alias("deadline"), q["k"].alias("k")))

        first = F.array_min(F.zip_with(F.col("q"), acc["done"], due))["k"]
        return F.struct(F.transform(acc["done"], lambda c, i: c + (i == first).cast("long")).alias("done"), F.concat(acc["ran"], F.array(first)).alias("ran"))

    zero = F.struct(F.transform("q", lambda _: F.lit(0).cast("long")).alias("done"), F.array().cast("array<int>").alias("ran"))
    ran = table.select(F.posexplode(F.aggregate(F.sequence(F.lit(0).cast("long"), F.col("m") - 1), zero, step)["ran"]).alias("slot", "k"))
    numbered = ran.withColumn("j", F.row_number().over(Window.partitionBy("k").orderBy("slot")) - 1)
    return numbered.join(F.broadcast(quota), "k").select("source", "quota", "period", "j", "slot")


def mix_sources(df: DataFrame, mix: Mix = Mix(), id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """df's columns in a struct `row`, with mix_source, mix_block, mix_slot (long) and in_mix (boolean)."""
    named = F.coalesce(F.col(quoted(source_col)).cast("string"), F.lit(""))
    rows = df.select(whole(df).alias("row"), named.alias("source"), F.md5(F.coalesce(F.col(quoted(id_col)).cast("string"), F.lit(""))).alias("key"))
    keys = rows.select("source", "key")
    digits, n = 1, keys.count()
    while 16**digits * mix.piece_rows < n and digits < 6:
        digits += 1
    piece = F.substring("key", 1, digits)
    pieces = keys.groupBy("source", piece.alias("piece")).agg(F.count("*").alias("rows"))
    before = F.coalesce(F.sum("rows").over(Window.partitionBy("source").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = pieces.withColumn("before", before).select("source", "piece", "before")
    counts = pieces.groupBy("source").agg(F.sum("rows").alias("n"))
    plan = saved(schedule(quotas(counts, mix)).coalesce(1))
    # The first slot whose source has no block left.
    blocks = F.ceil(F.col("n") / mix.block_rows)
    ends = counts.join(plan, "source").where(F.col("j") == blocks % F.col("quota")).select((F.floor(blocks / F.col("quota")) * F.col("period") + F.col("slot")).alias("end"))
    horizon = ends.agg(F.min("end")).scalar()

    rank = F.col("before") + F.row_number().over(Window.partitionBy("source", "piece").orderBy("key")) - 1
    ranked = rows.withColumn("piece", piece).join(offsets, ["source", "piece"]).withColumn("block", F.floor(rank / mix.block_rows))
    # One row for each source, its slots in a period in order: a period in all, many sources or few.
    slots = plan.groupBy("source").agg(F.max("quota").alias("quota"), F.max("period").alias("period"), F.transform(F.array_sort(F.collect_list(F.struct("j", "slot"))), lambda x: x["slot"]).alias("slots"))
    if plan.count() <= BROADCAST_SLOTS:
        placed = ranked.join(F.broadcast(slots), "source")
    else:
        # A source may have many of the rows, so its key is salted.
        salt = F.pmod(F.xxhash64("key"), F.lit(SALT)).cast("int")
        placed = ranked.withColumn("salt", salt).join(slots.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1)))), ["source", "salt"])
    nth = (F.col("block") % F.col("quota")).cast("int")
    slot = F.floor(F.col("block") / F.col("quota")) * F.col("period") + F.get("slots", nth)
    out = placed.select("row", F.col("source").alias("mix_source"), F.col("block").alias("mix_block"), slot.alias("mix_slot"))
    return out.withColumn("in_mix", F.col("mix_slot") < horizon)
