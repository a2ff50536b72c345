"""What is kept between rounds: listings by site, site links, the last report and the status."""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinmatch.operators.collect import upsert


def stored_listings(spark: SparkSession, path: str, site: str | None = None) -> DataFrame:
    """Stored rows, of one site or of all; the table is partitioned by site, so others are not read."""
    rows = spark.read.parquet(path)
    return rows.where(F.col("site") == site) if site is not None else rows


def with_site_number(rows: DataFrame, sites: DataFrame) -> DataFrame:
    """rows of known sites with their number; sites: site, site_no."""
    return rows.join(sites.select("site", "site_no"), "site")


def site_links(sites: DataFrame) -> DataFrame:
    """site and link of every site that is configured."""
    return sites.select("site", "link")


def save_site_link(sites: DataFrame, changes: DataFrame, allowed: Iterable[str]) -> DataFrame:
    """sites with changed links, new sites added; a site that is not allowed is an error."""
    names = list(allowed)
    wrong = changes.where(F.col("site").isNull() | ~F.col("site").isin(*names)).select("site").first()
    if wrong is not None:
        raise ValueError(f"not a site: {wrong.site!r}; there are {', '.join(names)}")
    return upsert(sites, changes, "site")


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def save_text(spark: SparkSession, path: str, text: str) -> None:
    """text as the file path, written beside it first and then moved there, so that no reader sees a part."""
    fs, at = _fs(spark, path)
    beside = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path + ".part")
    out = fs.create(beside, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    if fs.exists(at):
        fs.delete(at, False)
    if not fs.rename(beside, at):
        raise OSError(f"cannot move {path}.part to {path}")


def read_text(spark: SparkSession, path: str) -> str | None:
    """The file's text, None if there is none."""
    fs, at = _fs(spark, path)
    return spark.read.text(path, wholetext=True).first().value if fs.exists(at) else None


def save_report(spark: SparkSession, path: str, raw: str) -> None:
    """The posted text in place of the last report, as it is."""
    save_text(spark, path, raw)


def last_report(spark: SparkSession, path: str) -> dict | None:
    raw = read_text(spark, path)
    return None if raw is None else json.loads(raw)


def set_status(spark: SparkSession, path: str, status: str) -> None:
    save_text(spark, path, status)


def status(spark: SparkSession, path: str, default: str = "idle") -> str:
    return read_text(spark, path) or default
