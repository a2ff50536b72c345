"""Sharding along a Hilbert curve over several metadata dimensions.

Dimensions (by default source, lang and the logarithm of the size) are quantised to `bits` bits,
rows are sorted by their index on the curve, and the order is cut into runs whose row counts are
at most one apart. Rows near in all dimensions meet in a shard, so the ranges of its values are
narrow and readers prune files. Equal texts take the dimensions of the copy with the smallest id
and stand side by side, so that a group is split only by a cut that falls into it.

Ranks come from a range partitioning by a unique order, with the sizes of the partitions before
added; no task holds more than its partition, and the driver gets one number for each.

Defined results: a null text has no bytes and size 1; a text of any length counts whole; null
dimensions are the value 0; ties are broken by CRC, hash and id (null first), and repeated rows
follow one another; with fewer rows than shards some shards are empty; an empty table gives an
empty one; other columns come along in a struct, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinmatch.llm.common import free_name, quoted, saved, whole


#: Groups of copies up to which they are broadcast (about 100 bytes each); beyond, they are joined on a salted key.
BROADCAST_GROUPS = 100_000
SALT = 32


@dataclass(frozen=True)
class Curve:
    dims: tuple[str, ...] = ("source", "lang")  # hashed; the size is the last dimension
    bits: int = 5
    shards: int = 8


def hilbert_index(points: np.ndarray, bits: int) -> np.ndarray:
    """Index on the Hilbert curve of integer points (n, dims) with `bits` bits a dimension.

    By Gray codes: axes are inverted and exchanged from the highest bit to the lowest, then the
    bits of all axes are interleaved and decoded.
    """
    x = [points[:, k].astype(np.int64).copy() for k in range(points.shape[1])]
    n = len(x)
    for bit in range(bits - 1, 0, -1):
        q, low = 1 << bit, (1 << bit) - 1
        for k in range(n):
            on = (x[k] & q) > 0
            swap = np.where(on, 0, (x[0] ^ x[k]) & low)
            x[0] ^= np.where(on, low, 0)
            x[0] ^= swap
            x[k] ^= swap
    for k in range(1, n):
        x[k] ^= x[k - 1]
    flip = np.zeros_like(x[0])
    for bit in range(bits - 1, 0, -1):
        flip ^= np.where(x[-1] & (1 << bit), (1 << bit) - 1, 0)
    out = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for k in range(n):
            out = out << 1 | ((x[k] ^ flip) >> bit & 1)
    return out


def on_curve(dims: list[Column], bits: int) -> Column:
    @F.pandas_udf("long")
    def index(*columns: pd.Series) -> pd.Series:
        return pd.Series(hilbert_index(np.column_stack(columns), bits))

    return index(*dims)


def shard(df: DataFrame, curve: Curve = Curve(), id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """id, size, text_crc32, shard, slot (gapless from 0 in each shard); carry: and `row`, a struct of all columns of df."""
    text = F.coalesce(F.col(quoted(text_col)).cast("string"), F.lit(""))
    top = (1 << curve.bits) - 1
    dims = [F.coalesce(F.pmod(F.xxhash64(F.col(quoted(c))), F.lit(top + 1)) * F.col(quoted(c)).isNotNull().cast("long"), F.lit(0)) for c in curve.dims]
    size = F.octet_length(text).cast("long") + 1
    rows = df.select(
        F.col(quoted(id_col)).alias("row_id"), size.alias("size"), F.crc32(text.cast("binary")).alias("crc"), F.xxhash64(text).alias("hash"),
        F.array(*dims, F.least(F.lit(top), F.floor(F.log2(size) * (top + 1) / 32))).alias("dims"), (whole(df) if carry else F.lit(None).cast("int")).alias("row"),
    )
    group = ["size", "crc", "hash"]
    # Rows whose text stands alone keep their own dimensions; copies take those of the first.
    first = rows.groupBy(*group).agg(F.min(F.struct("row_id", "dims")).alias("first"), F.count("*").alias("n")).where("n > 1")
    first = saved(first.select(*group, F.col("first.dims").alias("theirs")))
    if first.count() <= BROADCAST_GROUPS:
        rows = rows.join(F.broadcast(first), group, "left")
    else:
        # A group of copies may be a large part of all rows, so its key is salted.
        salt = F.pmod(F.xxhash64("row_id"), F.lit(SALT)).cast("int")
        rows = rows.withColumn("salt", salt).join(first.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1)))), [*group, "salt"], "left").drop("salt")
    rows = rows.withColumn("dims", F.coalesce("theirs", "dims")).drop("theirs")
    rows = rows.withColumn("curve", on_curve([F.col("dims")[k] for k in range(len(curve.dims) + 1)], curve.bits)).drop("dims")
    order = ["curve", "crc", "hash", "row_id"]
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranked = saved(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftright("at", 33)
    counts = {r.part: r.n for r in ranked.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()}
    total, offsets = 0, []
    for p in sorted(counts):
        offsets.append((p, total))
        total += counts[p]
    before = df.sparkSession.createDataFrame(offsets, "part long, before long")
    rank = F.col("before") + F.col("at").bitwiseAND((1 << 33) - 1)
    out = ranked.withColumn("part", part).join(F.broadcast(before), "part").withColumn("rank", rank)
    out = out.withColumn("shard", F.floor(F.col("rank") * curve.shards / max(1, total)).cast("int"))
    # The first rank of shard s is the least r with floor(r * shards / total) = s.
    slot = F.col("rank") - F.ceil(F.col("shard").cast("long") * total / F.lit(float(curve.shards))).cast("long")
    return out.select(F.col("row_id").alias(id_col), "size", F.col("crc").alias("text_crc32"), "shard", slot.alias("slot"), *["row"] * carry)


def write_shards(df: DataFrame, path: str, curve: Curve = Curve(), id_col: str = "doc_id", text_col: str = "text") -> None:
    """df's rows with shard and slot as Parquet, a folder for each shard, its files in slot order; df's own columns of such names keep theirs."""
    shard_name, slot_name = (free_name(n, df.columns) for n in ("shard", "slot"))
    out = shard(df, curve, id_col, text_col, carry=True).select("row.*", F.col("shard").alias(shard_name), F.col("slot").alias(slot_name))
    out.repartitionByRange(curve.shards, shard_name, slot_name).sortWithinPartitions(shard_name, slot_name).write.partitionBy(shard_name).parquet(path)
