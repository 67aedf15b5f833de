"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR names the tables, BENCH_CPUS the cores, BENCH_REPEATS the timed runs
per query (the median counts, after one warm-up run).
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from coordloom import inputs  # noqa: E402
from coordloom.plans import chain_apply  # noqa: E402
from coordloom.queries import QUERIES  # noqa: E402
from coordloom.session import local_session  # noqa: E402

HEADLINE = [
    "coo_build", "matmul_complex", "matmul_componentwise", "matvec", "gram", "cooccurrence",
    "kron", "norm", "abs_square", "reshape", "sum_axis", "sum_axis_fixed", "marginal",
    "zero_prune", "chain3", "compose", "snapshots", "chain_hops", "chain_marginal",
    "axis_apply", "axis_chain", "shift", "identity", "text_files", "parquet_files",
    "chain_componentwise", "chain_marginal_fixed", "chain_text", "matmul_cells", "kron_blocks",
    "matvec_in_place", "chain_in_place",
]


def chain_of_twelve(spark, sf_dir: str):
    """Twelve products in one chain: customers to suppliers and back, six times."""
    p = inputs.customer_supplier_counts(spark, sf_dir).store()
    x = inputs.customer_vector(spark, sf_dir, p.dims[0])
    return chain_apply([p, p.transpose()], x, 6).state.entries()


TIMED = {name: QUERIES[name] for name in HEADLINE} | {"chain_12_products": chain_of_twelve}


def timed(query, spark, sf_dir: str) -> float:
    start = time.perf_counter()
    query(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    repeats = int(os.environ.get("BENCH_REPEATS", "2"))
    spark = local_session(cpus, int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name, query in TIMED.items():
        runs = [timed(query, spark, sf_dir) for _ in range(repeats + 1)][1:]
        seconds[name] = round(statistics.median(runs), 3)
    print(json.dumps({
        "metric": "headline queries, sum of median times",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": Path(sf_dir).name.removeprefix("sf"),
    }), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
