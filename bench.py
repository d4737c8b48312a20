"""Times headline queries; prints one JSON line. BENCH_SF_DIR and BENCH_CPUS set the tables and the cores."""

import json
import os
import time

from pyspark.sql import SparkSession

from cairn.plans import registry

HEADLINE = [
    "confusion_by_arm", "strata_marginals", "ident_bounds", "cluster_bounds", "ipw_metrics", "kappa", "source_quantiles", "stratified_sample", "clustered_sample", "hash_split", "line_islands",
    "enclosing_interval", "j_range_overlap", "j_nested_sites", "near_copy_pairs", "exact_dup_families", "trace_audit", "id_evidence_key", "risk_codes", "reach",
]


def main() -> None:
    d, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.driver.memory", "12g").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    found, took = registry.queries(), {}
    # a fixed piece of work that no change of the library touches: rounds on unlike machines compare by it
    start = time.time()
    spark.range(40_000_000).selectExpr("xxhash64(id) % 1000 as k", "id").groupBy("k").sum("id").write.format("noop").mode("overwrite").save()
    control = round(time.time() - start, 3)
    for name in HEADLINE:
        start = time.time()
        found[name](spark, d).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - start, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "control": control, "sf": os.path.basename(d.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
