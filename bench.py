"""Headline queries over ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line.

The index is built and stored once (that build is a metric of its own); searches then read
the stored index, as a user would. Each query runs once to warm up and three times timed;
the median counts.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from threadloom.operators import identity, index, search, snippets, sorting  # noqa: E402
from threadloom.plans import curation_plans  # noqa: E402
from threadloom.session import build_session  # noqa: E402
from threadloom.sources import model  # noqa: E402

SEARCHES = {
    "j01_and_search": "tion erth",
    "j04_exact_phrase": '"in thatin"',
    "j05_wildcard": "the*ing",
    "j06_exclude": "tion erth -title:the",
    "j08_title_clause": "title:the",
    "j09_multi_clause": '"of that" th*ble -title:and',
}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark = build_session(
        f"local[{cpus}]", "bench", **{"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "16g", "spark.checkpoint.dir": folder},
    )
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}

    def clock(name, run, repeats=3):
        run()
        spent = []
        for _ in range(repeats):
            began = time.perf_counter()
            run()
            spent.append(time.perf_counter() - began)
        times[name] = round(statistics.median(spent), 3)
        print(name, times[name], file=sys.stderr, flush=True)

    sink = lambda df: df.write.format("noop").mode("overwrite").save()
    turns = model.document_messages(spark, sf_dir)
    heads = model.headers(turns)
    clock("a01_posting_build", lambda: sink(index.build_postings(heads, turns)), 2)
    began = time.perf_counter()
    heads.write.parquet(f"{folder}/headers")
    turns.write.parquet(f"{folder}/messages")
    index.write_postings(index.build_postings(heads, turns), f"{folder}/postings")
    times["s04_posting_write"] = round(time.perf_counter() - began, 3)
    stored = {name: spark.read.parquet(f"{folder}/{name}") for name in ("headers", "messages", "postings")}

    for name, raw in SEARCHES.items():
        def run(raw=raw):
            found = search.search(stored["headers"], stored["messages"], stored["postings"], {1: raw}, use_index=True)
            sink(sorting.sorted_list(found, "relevance", "desc", model.NOW_MS, 3000, "conversation_id"))

        clock(name, run)
    clock("w17_best_snippet", lambda: sink(snippets.best_snippets(stored["messages"], "tion erth")))
    clock("o01_activity_list", lambda: sink(sorting.sorted_list(stored["headers"], "activity", "desc", model.NOW_MS, 80)))
    clock("w06_progress_fold", lambda: sink(identity.progress_folds(curation_plans._fold_rows(spark, sf_dir))))
    print(json.dumps({"metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
