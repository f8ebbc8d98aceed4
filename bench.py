"""Time the headline queries; prints one JSON line.

    BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and cores.
"""

from __future__ import annotations

import json
import os
import time

from loanloom.catalog import REGISTRY
from loanloom.session import build_session

HEADLINE = [
    "w0_order_lookback", "w1_previous", "w2_pos", "w3_instalments", "w4_card",
    "f1_application", "f2_bureau_customer", "f3_bureau", "f8_matrix",
    "a1_multi_stat", "a6_group_median", "a25_corr_moments", "j2_attach_payment_sum", "e6_rare",
    "p1_profile", "p3_num_summary", "p10_near_constants", "p18_histogram", "o2_winsorise",
    "d1_dup_rows", "d2_dup_keys", "m1_split", "m2_anova_f",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        spark__sql__shuffle__partitions=cpus,
        spark__ui__enabled="false",
        spark__driver__memory="12g",
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{folder}/orders.parquet").groupBy("o_custkey").count().write.format("noop").mode(
        "overwrite"
    ).save()
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        REGISTRY[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
