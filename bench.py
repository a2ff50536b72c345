"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import sys
import tempfile
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")


def recall(spark, sf_dir: str) -> tuple[float, str]:
    """The share of matches among all pairs of a sport and neighbouring days that blocking keeps, at a scale where these can be scored."""
    from kinmatch.operators import matching
    from kinmatch.plans import queries as q

    rows = matching.saved(matching.with_features(q.listings(spark, sf_dir), q.aliases()))
    a, b = (rows.select(F.col("rid").alias(s), F.col("site_idx").alias(f"site_{s}"), F.col("sport").alias(f"sport_{s}"), F.to_date("date").alias(f"day_{s}")) for s in "ab")
    every = a.join(b, (F.col("sport_a") == F.col("sport_b")) & (F.col("site_a") < F.col("site_b")) & (F.abs(F.datediff("day_a", "day_b")) <= 1))
    every = every.select("a", "b", F.lit(0).alias("day_offset"), F.lit(0).alias("prefix_pos"))
    good = matching.saved(matching.score_pairs(every, rows)).where("reason is null and confidence >= 0.75").select("a", "b")
    kept = good.join(matching.candidate_pairs(rows).select("a", "b"), ["a", "b"], "left_semi")
    return round(kept.count() / max(1, good.count()), 6), sf_dir.rpartition("/")[2]


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="kinmatch-bench-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from kinmatch.operators import matching
    from kinmatch.plans import queries as q

    took: dict[str, float] = {}
    facts: dict[str, float] = {}

    def timed(name, run):
        began = time.time()
        out = run()
        took[name] = round(time.time() - began, 3)
        print(name, took[name], file=sys.stderr, flush=True)
        return out

    rows = timed("features", lambda: matching.saved(matching.with_features(q.listings(spark, SF_DIR), q.aliases())))
    pairs = timed("blocking", lambda: matching.saved(matching.candidate_pairs(rows)))
    # All pairs of the same sport and neighbouring days, counted without making them.
    days = rows.groupBy("site_idx", "sport", F.to_date("date").alias("day")).agg(F.count("*").alias("n"))
    a, b = days.alias("a"), days.alias("b")
    every = a.join(b, (F.col("a.sport") == F.col("b.sport")) & (F.col("a.site_idx") < F.col("b.site_idx")) & (F.abs(F.datediff("a.day", "b.day")) <= 1)).agg(F.sum(F.col("a.n") * F.col("b.n"))).first()[0]
    facts["pairs_unblocked"], facts["pairs_blocked"] = int(every), pairs.count()
    facts["pairs_share"] = round(facts["pairs_blocked"] / every, 6)
    edges = timed("scoring", lambda: matching.saved(matching.score_pairs(pairs, rows)))
    good = edges.where("reason is null and confidence >= 0.75").drop("reason")
    won: list[int] = []
    matched = timed("assignment", lambda: matching.saved(matching.assign(good, won_in=won)))
    facts["assignment_rounds"] = len(won)
    clusters = timed("clustering", lambda: matching.saved(matching.cluster(rows, matched)))
    from kinmatch.operators import report

    timed("report", lambda: report.discrepancies(report.analyse(rows, clusters, 3), q.SITES).collect())
    facts["listings"], facts["matched"] = rows.count(), matched.count()
    for name in ("similarity_chars", "similarity_tokens", "json_scan", "nested_round_trip", "cluster_times", "html_text", "text_fold_documents"):
        timed(name, lambda name=name: q.QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save())
    try:
        from kinmatch.llm.queries import QUERIES as llm
    except ModuleNotFoundError:
        llm = {}
    for name, run in ((k, v) for k, v in llm.items() if k.startswith(("op3_", "op5_", "op7_", "op9_"))):
        timed(name, lambda run=run: run(spark, SF_DIR).write.format("noop").mode("overwrite").save())
    facts["blocking_recall"], facts["recall_at"] = recall(spark, SF_DIR.replace(SF_DIR.rpartition("sf")[2], "0.001"))
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": SF_DIR.rpartition("sf")[2], "facts": facts}))


if __name__ == "__main__":
    main()
