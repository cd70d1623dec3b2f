"""Times the headline queries and prints one JSON line.

The lake's names and ground truth are found first, as they would be read from a table.
Every query then starts without vectors or reports of an earlier one. ``offline_*`` builds
and stores vectors, ``online_*`` searches stored ones and scores the rankings.
"""

import json
import os
import sys
import time

from pyspark.sql import DataFrame, SparkSession

from registered import spark_queries as queries
from registered.lake import carved_lake
from tablekin.operators import metrics, pooling, search
from tablekin.functions.frames import cut
from tablekin.session import configure

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")

HEADLINE = [
    "column_sample", "column_types", "profile_combined", "typed_value_sets", "value_overlap",
    "overlap_stats", "word_ngrams", "vocabulary", "unionable_topk_hash", "unionable_topk_tfidf",
    "unionable_topk_encoder", "bipartite_topk", "metrics_at_k", "dense_topk",
]


def run(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    spark = configure(
        SparkSession.builder.master(f"local[{CPUS}]").appName("bench")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "16g"))
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.ui.enabled", "false")
    ).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    lake = carved_lake(spark, SF_DIR)
    lake.n_columns, lake.gt  # noqa: B018
    run(lake.cells)

    seconds: dict[str, float] = {}

    def timed(name: str, work) -> None:
        start = time.time()
        work()
        seconds[name] = round(time.time() - start, 3)
        print(f"{name} {seconds[name]}", file=sys.stderr)

    for name in HEADLINE:
        timed(name, lambda: run(queries.QUERIES[name](queries.Stored(lake))))
    for method in ("hash", "count", "tfidf"):
        kept: dict[str, DataFrame] = {}
        timed(f"offline_{method}", lambda: kept.update(vectors=cut(search.pool_vectors(
            pooling.table_vectors(getattr(queries.Stored(lake), method), "max")))))

        def online() -> None:
            ranked = cut(search.pooled_top_k(kept["vectors"], lake.gt, queries.K))
            run(metrics.metrics_at_k(metrics.metrics_per_query(ranked, lake.gt, queries.K)))

        timed(f"online_{method}", online)
    print(json.dumps({"metric": "total_time", "value": round(sum(seconds.values()), 3),
                      "unit": "sec", "queries": seconds,
                      "sf": os.path.basename(SF_DIR.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
