"""Times the headline queries and prints one JSON line. BENCH_SF_DIR: the tables; BENCH_CPUS: cores; BENCH_QUERIES: names, comma-separated."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path
from statistics import median

ROOT = Path(__file__).resolve().parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"

HEADLINES = (
    "playlist_filter playlist_drop_reasons facet_rollup latest_per_key trailing_n_all_above margin_rule artist_rollup_examples rating_summary_sets source_quality_composite completeness_crosstab "
    "confusion_wilson_p95 percentile_corpus threshold_f1_sweep pricing_summary tiered_duplicate_match hamming_knn layered_dedup embedding_blocked manifest_full_outer keyed_join_topk as_of_join "
    "rocchio_weights bt_pair_counts fold_and_tokens html_text_triage"
).split()
#: Warm runs of a query, and the seconds of the first run beyond which one warm run has to do.
RUNS, LONG = 3, 5.0


def main() -> None:
    from cataloom import registry
    from cataloom.session import build_session

    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    conf = {"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "12g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"}
    spark = build_session("bench", f"local[{cpus}]", **conf)
    spark.sparkContext.setLogLevel("ERROR")
    queries = registry.queries()
    names = os.environ["BENCH_QUERIES"].split(",") if os.environ.get("BENCH_QUERIES") else HEADLINES
    timed = {}
    for name in names:
        seconds = []
        while len(seconds) < (2 if seconds and seconds[0] > LONG else RUNS + 1):  # the first compiles
            began = time.perf_counter()
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            seconds.append(time.perf_counter() - began)
        timed[name] = round(median(seconds[1:]), 3)
    print(json.dumps({"metric": "total_median_seconds", "value": round(sum(timed.values()), 3), "unit": "sec", "queries": timed, "sf": sf_dir.rstrip("/").rpartition("sf")[2]}))
    spark.stop()


if __name__ == "__main__":
    main()
