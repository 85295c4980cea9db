"""Times the headline queries and prints one JSON line.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the local threads, ``BENCH_RUNS`` the timed runs of
each query (after one to warm up). The value of a query is the median of its runs.
"""

from __future__ import annotations

import json
import os
import statistics
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from txsieve.operators import model
from txsieve.plans import tables
from txsieve.plans.queries import QUERIES
from txsieve.session import build_session

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "3"))

HEADLINE = [
    "scan_transactions",
    "decode_json",
    "recurrence",
    "enrich",
    "rule_filter",
    "det_prim",
    "undetected",
    "eval_join",
    "eval_metrics",
    "stream_enrich",
    "stream_rule_filter",
    "stream_sink_upsert",
    "stream_screening",
]


def _run(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def _seconds(action: Callable[[], object]) -> float:
    action()
    taken = []
    for _ in range(RUNS):
        start = time.perf_counter()
        action()
        taken.append(time.perf_counter() - start)
    return round(statistics.median(taken), 3)


def _model_seconds(spark: SparkSession) -> dict[str, float]:
    """Fitting includes making the training table, scoring the live one."""
    taken = {}
    for short, name in (("rf", "RANDOM_FOREST"), ("gbt", "GBT"), ("lr", "LOGISTIC_REGRESSION")):
        taken[f"fit_{short}"] = _seconds(lambda: model.train(tables.labelled_history(spark, SF_DIR), name))
        fitted = model.train(tables.labelled_history(spark, SF_DIR), name)
        taken[f"score_{short}"] = _seconds(lambda: _run(model.score(fitted, tables.enriched_live(spark, SF_DIR))))
    return taken


def main() -> None:
    spark = build_session(
        "bench",
        f"local[{CPUS}]",
        spark__ui__enabled="false",
        spark__sql__shuffle__partitions=CPUS,
        spark__driver__memory="8g",
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {name: _seconds(lambda: _run(QUERIES[name](spark, SF_DIR))) for name in HEADLINE}
    seconds |= _model_seconds(spark)
    live = tables.raw_live(spark, SF_DIR).count()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
                "live_rows": live,
                "stream_rule_filter_rows_per_sec": round(live / seconds["stream_rule_filter"]),
                "cpus": int(CPUS),
                "runs": RUNS,
            }
        )
    )


if __name__ == "__main__":
    main()
