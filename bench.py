"""Benchmark: run the headline jobs on $BENCH_SF_DIR with local[$BENCH_CPUS]; print one JSON line.

Each job is forced to completion with the no-op sink (full computation, nothing collected).
The inputs a job reads from files in the reference (C5: the environment files of a built corpus;
C9: the runs' eval logs) are prepared once, untimed, as data preparation; every other job reads
the driver tables directly.
"""
from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from envlab.operators import curves as CV  # noqa: E402
from envlab.operators import encode as EN  # noqa: E402
from envlab.plans.registry import QUERIES, _corpus_b  # noqa: E402
from envlab.session import get_session, materialize, scratch_path  # noqa: E402
from envlab.sources import fixtures as fx  # noqa: E402
from envlab.sources.logs import available_columns, discover_logs, read_eval_logs  # noqa: E402
from envlab.sources.tsv import drop_blank  # noqa: E402

TABLE_JOBS = {
    "corpus_a": "corpus_a",  # C1
    "corpus_b": "corpus_b",  # C2
    "support_report": "support_report",  # C4
    "eval_report": "eval_report",  # C6
    "head_js": "head_js",  # C7 (one evaluation)
    "heads_compact": "heads_compact",  # C7 (per-step log)
    "seed_aggregate": "seed_aggregate",  # C8
    "eval_by_step": "eval_by_step",  # C6, many snapshots
    "loss_moving_avg": "loss_moving_avg",  # W5
    "padded": "padded",  # W8 and F17 on the encoded set
}


def _noop(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def encode_job(spark, lines):
    """C5 on stored lines: vocabulary, ids, one pass."""
    return EN.encode(drop_blank(lines), materialize(EN.build_vocab(lines.where(F.col("env") != "val")), "bench-vocab"))


def curve_job(spark, base):
    """C9 on written logs: discovery, header-aware read, target lrs, one aggregate."""
    lines = discover_logs(spark, base, "eval")
    metrics = CV.select_metrics(list(CV.DEFAULT_METRICS) + ["loss"], available_columns(lines))
    return CV.curve_summary(CV.keep_target_lrs(read_eval_logs(spark, base, lines=lines)), metrics)


def run_all(spark, sf_dir):
    times = {}
    for key, name in TABLE_JOBS.items():
        t0 = time.perf_counter()
        _noop(QUERIES[name](spark, sf_dir))
        times[key] = round(time.perf_counter() - t0, 3)
    # data preparation (untimed): builder B's lines and the runs' eval logs, as files
    lines = materialize(_corpus_b(spark, sf_dir).lines, "bench-lines")
    t0 = time.perf_counter()
    _noop(encode_job(spark, lines))
    times["encoded"] = round(time.perf_counter() - t0, 3)
    logs = scratch_path(spark, "bench-logs")
    fx.write_eval_logs(spark, sf_dir, logs)
    t0 = time.perf_counter()
    _noop(curve_job(spark, logs))
    times["curve_summary"] = round(time.perf_counter() - t0, 3)
    return times


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = get_session(f"local[{cpus}]", shuffle_partitions=cpus)
    # warm-up (not timed): JVM start, JIT and generated-code caches, one pass of every job on a
    # small scale when it exists next to the measured one
    warm = os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.01")
    run_all(spark, warm if os.path.isdir(warm) else sf_dir)
    times = run_all(spark, sf_dir)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    out = {
        "metric": "headline_jobs_total",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(m.group(1)) if m else sf_dir,
        "cpus": cpus,
    }
    print(json.dumps(out))


if __name__ == "__main__":
    main()
