"""Overlap of all ground-truth pairs of a lake, from cells to summary."""

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablekin.functions.frames import cut, join_small
from tablekin.operators import overlap
from tablekin.operators.typing import column_types, nonempty_columns
from tablekin.schema import TABLE


class OverlapReport:
    """The frames of one report; each is built when first asked for.

    Only cells of tables in a pair are used. Column types, value sets and per-pair results are
    read by several others, so they are cut: cells are scanned for the types and for the value
    sets, and never again.
    """

    def __init__(self, cells: DataFrame, columns_meta: DataFrame, gt: DataFrame,
                 query_list: DataFrame | None = None, exclude_self: bool = True):
        self.cells = cells
        self.columns_meta = columns_meta
        self.gt = gt
        self.query_list = query_list
        self.exclude_self = exclude_self

    @cached_property
    def _tables(self) -> DataFrame:
        return cut(overlap.involved_tables(self.resolved))

    @cached_property
    def _cells(self) -> DataFrame:
        return join_small(self.cells, self._tables, TABLE, self._tables.count(),
                          spread=["row_id"], how="left_semi")

    @cached_property
    def types(self) -> DataFrame:
        meta = self.columns_meta.join(self._tables, TABLE, "left_semi")
        return cut(nonempty_columns(column_types(self._cells, meta)))

    @cached_property
    def value_sets(self) -> DataFrame:
        return cut(overlap.typed_value_sets(self._cells, self.types, self.types.count()))

    @cached_property
    def pairs(self) -> DataFrame:
        return overlap.overlap_pairs(self.gt, self.query_list, self.exclude_self)

    @cached_property
    def resolved(self) -> DataFrame:
        return cut(overlap.resolve_candidates(self.pairs, self.columns_meta))

    @cached_property
    def n_pairs(self) -> int:
        return self.resolved.count()

    @cached_property
    def columns(self) -> DataFrame:
        return cut(overlap.column_overlap(self.resolved, self.types))

    @cached_property
    def value_counts(self) -> DataFrame:
        return cut(overlap.value_counts(self.resolved, self.value_sets, self.n_pairs))

    @cached_property
    def values(self) -> DataFrame:
        return overlap.value_overlap(self.value_counts)

    @cached_property
    def values_by_type(self) -> DataFrame:
        return overlap.value_overlap_by_type(self.value_counts)

    def histograms(self) -> DataFrame:
        """``measure, bin, n, percentage`` of columns and of values."""
        return overlap.overlap_histogram(self.columns).withColumn(
            "measure", F.lit("columns")).unionByName(
            overlap.overlap_histogram(self.values).withColumn("measure", F.lit("values")))

    def histograms_by_type(self) -> DataFrame:
        return overlap.overlap_histogram_by_type(self.values_by_type)

    @cached_property
    def _grouped_stats(self) -> DataFrame:
        return cut(overlap.grouped_stats(overlap.coefficients(
            self.columns, self.values, self.values_by_type)))

    def stats(self) -> DataFrame:
        """Statistics by ``measure``: columns, values, and values:<type>."""
        return overlap.overlap_stats(self._grouped_stats)

    def by_query(self) -> DataFrame:
        return overlap.overlap_by_query(self.gt, self._grouped_stats)

    def summary(self) -> DataFrame:
        return overlap.overlap_summary(self.gt, self.resolved, self.query_list)

    def details(self) -> DataFrame:
        """One row per pair with all its overlaps."""
        types = self.values_by_type.groupBy("query_table", "cand_table").agg(
            F.array_sort(F.collect_list(F.struct(
                "data_type", "query_count", "cand_count", "common", "overlap_coefficient",
                "jaccard"))).alias("by_type"))
        columns = self.columns.select(
            "query_table", "cand_table", "location", F.struct(
                "query_count", "cand_count", "common", "overlap_coefficient", "jaccard",
                "common_columns").alias("column_overlap"))
        values = self.values.select(
            "query_table", "cand_table", F.struct(
                "query_count", "cand_count", "common", "overlap_coefficient", "jaccard"
            ).alias("value_overlap"))
        pair = ["query_table", "cand_table"]
        return columns.join(values, pair).join(types, pair, "left").withColumn(
            "is_self", F.col("query_table") == F.col("cand_table"))

    def write(self, folder: str, name: str) -> None:
        """Summary (with statistics and histograms) and details as JSON folders."""
        def rows(frame: DataFrame, alias: str) -> DataFrame:
            # a few dozen rows whatever the lake
            return frame.agg(F.collect_list(F.struct(*frame.columns)).alias(alias))

        summary = self.summary().withColumn("benchmark_name", F.lit(name)).withColumn(
            "timestamp", F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss")).withColumn(
            "excludes_self_comparisons", F.lit(self.exclude_self))
        for frame, alias in [(self.stats(), "overlap_stats"),
                             (self.histograms(), "overlap_distribution"),
                             (self.histograms_by_type(), "type_distribution")]:
            summary = summary.crossJoin(rows(frame, alias))
        summary.coalesce(1).write.mode("overwrite").json(f"{folder}/{name}_overlap_summary")
        self.details().write.mode("overwrite").json(f"{folder}/{name}_overlap_detailed")
        self.by_query().write.mode("overwrite").json(f"{folder}/{name}_overlap_by_query")
