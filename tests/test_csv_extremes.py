"""Extremes of the columns of a CSV lake."""

from registered import spark_queries


def test_csv_extremes_are_found_among_different_values(spark):
    class Lake:
        sf_dir = "/root/testdata/sf0.001"

        def __init__(self):
            self.spark = spark

        def table(self, name):
            return spark.read.parquet(f"{self.sf_dir}/{name}.parquet").limit(3)

    plan = spark_queries.csv_lake_cells(spark_queries.Stored(Lake()))._jdf.queryExecution().executedPlan().toString()
    by_value = [line for line in plan.splitlines() if "Aggregate(" in line and "value#" in line.split("functions=")[0]]
    assert by_value and all("HashAggregate(" in line and "min(" not in line for line in by_value)
