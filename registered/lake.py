"""A lake carved from the test tables: slices of one table can be unioned with each other.

Slices are named base__value. The first slice of each base is a query table only, the
second is both a lake and a query table, the others are lake tables. Query tables lack the
last column of their base. Some values are missing or blank, one column is empty, three
tables are in nobody's ground truth, and the ground truth names tables that do not exist.
"""

from dataclasses import dataclass
from functools import cached_property, lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablekin.functions.frames import cut
from tablekin.schema import LAKE, QUERY
from tablekin.sources.ground_truth import ground_truth_edges


def money(name: str) -> str:
    return f"cast(cast({name} as decimal(18,2)) as string)"


@dataclass(frozen=True)
class Base:
    name: str
    slice_by: str
    row_id: str
    columns: dict[str, str]
    query_only: str | None = None
    both: str | None = None


BASES = [
    Base("customer", "c_mktsegment", "c_custkey", {
        "c_custkey": "cast(c_custkey as string)",
        "c_name": "c_name",
        "c_nationkey": "cast(nullif(c_nationkey, 0) as string)",
        "c_acctbal": f"case when c_acctbal >= 500 then {money('c_acctbal')} end",
        "c_note": "cast(null as string)",
        "c_mktsegment": "c_mktsegment",
    }, "AUTOMOBILE", "BUILDING"),
    Base("orders", "o_orderpriority", "o_orderkey", {
        "o_orderkey": "cast(o_orderkey as string)",
        "o_custkey": "cast(o_custkey as string)",
        "o_orderstatus": "o_orderstatus",
        "o_totalprice": money("o_totalprice"),
        "o_orderdate": "case when o_orderstatus <> 'P' "
                       "then date_format(o_orderdate, 'yyyy-MM-dd') end",
    }, "1-URGENT", "2-HIGH"),
    Base("events", "event_type", "event_id", {
        "user_id": "cast(user_id as string)",
        "event_type": "event_type",
        "value": money("value"),
        "props": "props",
    }, "click", "error"),
    Base("part", "p_type", "p_partkey", {
        "p_partkey": "cast(p_partkey as string)",
        "p_name": "case when p_size > 5 then p_name end",
        "p_brand": "case when p_brand = 'Brand#1' then ' ' else p_brand end",
        "p_type": "p_type",
        "p_size": "cast(p_size as string)",
        "p_retailprice": money("p_retailprice"),
    }, "ECONOMY", "LARGE"),
    Base("documents", "lang", "doc_id", {
        "doc_id": "cast(doc_id as string)",
        "text": "text",
        "source": "source",
        "n_chars": "cast(n_chars as string)",
    }, "de", "en"),
    Base("supplier", "'all'", "s_suppkey", {
        "s_suppkey": "cast(s_suppkey as string)",
        "s_name": "s_name",
        "s_nationkey": "cast(s_nationkey as string)",
        "s_acctbal": money("s_acctbal"),
    }),
    Base("nation", "'all'", "n_nationkey", {
        "n_nationkey": "cast(n_nationkey as string)",
        "n_name": "n_name",
        "n_regionkey": "cast(n_regionkey as string)",
    }),
    Base("region", "'all'", "r_regionkey", {
        "r_regionkey": "cast(r_regionkey as string)",
        "r_name": "r_name",
    }),
]


def _sides(base: Base):
    slice_value = F.expr(base.slice_by)
    return (
        F.when(slice_value == F.lit(base.query_only), F.array(F.lit(QUERY)))
        .when(slice_value == F.lit(base.both), F.array(F.lit(LAKE), F.lit(QUERY)))
        .otherwise(F.array(F.lit(LAKE)))
    )


class CarvedLake:
    """The frames of the lake, built lazily from one folder of test tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def _union(self, frames: list[DataFrame]) -> DataFrame:
        union = frames[0]
        for frame in frames[1:]:
            union = union.unionByName(frame)
        return union

    def _table_name(self, base: Base):
        return F.concat(F.lit(base.name + "__"), F.expr(base.slice_by))

    def _cells_of(self, base: Base) -> DataFrame:
        names = list(base.columns)
        position = F.array_position(F.array(*[F.lit(name) for name in names]), F.col("col_name"))
        return (
            self.table(base.name)
            .select(F.explode(_sides(base)).alias("side"),
                    self._table_name(base).alias("table_name"),
                    F.expr(base.row_id).cast("bigint").alias("row_id"),
                    *[F.expr(text).alias(f"_{name}") for name, text in base.columns.items()])
            .withColumnsRenamed({f"_{name}": name for name in names})
            .unpivot(["side", "table_name", "row_id"], names, "col_name", "value")
            .filter(~((F.col("side") == QUERY) & (F.col("col_name") == names[-1])))
            .select("side", "table_name", (position - 1).cast("int").alias("col_pos"),
                    "col_name", "row_id", "value")
        )

    @cached_property
    def cells(self) -> DataFrame:
        return self._union([self._cells_of(base) for base in BASES])

    @cached_property
    def meta(self) -> DataFrame:
        tables = self._union([
            self.table(base.name).select(
                F.lit(number).alias("base"), self._table_name(base).alias("table_name"),
                _sides(base).alias("sides"))
            for number, base in enumerate(BASES)]).distinct()
        columns = F.array(*[
            F.array(*[F.struct(F.lit(pos).alias("col_pos"), F.lit(name).alias("col_name"))
                      for pos, name in enumerate(base.columns)]) for base in BASES])
        lasts = F.array(*[F.lit(len(base.columns) - 1) for base in BASES])
        return cut(
            tables.select("table_name", F.explode("sides").alias("side"),
                          F.get(lasts, "base").alias("last"), F.get(columns, "base").alias("columns"))
            .select("side", "table_name", "last", F.inline("columns"))
            .filter(~((F.col("side") == QUERY) & (F.col("col_pos") == F.col("last"))))
            .select("side", "table_name", "col_pos", "col_name", F.lit("text").alias("source_type"))
        )

    @cached_property
    def n_columns(self) -> int:
        return self.meta.count()

    @cached_property
    def query_names(self) -> DataFrame:
        return self.meta.filter(F.col("side") == QUERY).select("table_name").distinct()

    @cached_property
    def gt_lists(self) -> DataFrame:
        """Per query the list of its candidates, as file names, with one named twice."""
        base = F.substring_index("table_name", "__", 1)
        slices = self.meta.select("side", "table_name").distinct().filter(
            ~F.col("table_name").endswith("__all"))
        # a base has at most six slices
        families = slices.groupBy(base.alias("base")).agg(
            F.array_sort(F.collect_set("table_name")).alias("names"))
        queries = slices.filter(F.col("side") == QUERY).select(
            base.alias("base"), F.col("table_name").alias("query"))
        known = queries.join(families, "base").select(
            "query", F.concat("names", F.array(F.concat("base", F.lit("__RETIRED"))),
                              F.slice("names", 1, 1)).alias("names"))
        flags = self.table("lineitem").select(
            F.concat(F.lit("lineitem__"), "l_returnflag").alias("query")).distinct()
        gone = flags.select("query", F.array(F.col("query"), F.lit("customer__BUILDING")).alias("names"))
        csv = F.lit(".csv")
        return known.unionByName(gone).select(
            F.concat("query", csv).alias("query_table"),
            F.transform("names", lambda name: F.concat(name, csv)).alias("candidates"))

    @cached_property
    def gt(self) -> DataFrame:
        return cut(ground_truth_edges(self.gt_lists))


@lru_cache(maxsize=4)
def _lake(spark: SparkSession, application: str, sf_dir: str) -> CarvedLake:
    return CarvedLake(spark, sf_dir)


def carved_lake(spark: SparkSession, sf_dir: str) -> CarvedLake:
    """The lake of a folder; names and ground truth are found once per session."""
    return _lake(spark, spark.sparkContext.applicationId, sf_dir)
