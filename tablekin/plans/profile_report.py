"""Profile of a lake, from cells to one JSON record."""

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablekin.functions.frames import cut
from tablekin.operators import profile
from tablekin.operators.typing import column_types


class ProfileReport:
    """The frames of one profile; cells are reduced to one record per column first."""

    def __init__(self, cells: DataFrame, columns_meta: DataFrame):
        self.cells = cells
        self.columns_meta = columns_meta

    @cached_property
    def columns(self) -> DataFrame:
        return cut(profile.without_duplicates(column_types(self.cells, self.columns_meta)))

    @cached_property
    def tables(self) -> DataFrame:
        return profile.table_sizes(self.columns)

    def per_side(self) -> DataFrame:
        """One row per side with sizes, missing cells, averages, names and classes."""
        types = profile.profile_column_types(self.columns).groupBy("side").agg(
            F.map_from_entries(F.collect_list(F.struct(
                "data_type", F.struct("n_columns", "pct")))).alias("column_stats"))
        return (
            profile.profile_sizes(self.tables)
            .join(profile.profile_missing(self.tables), "side")
            .join(profile.profile_averages(self.tables), "side")
            .join(profile.profile_unique_columns(self.columns), "side")
            .join(types, "side")
        )

    def combined(self) -> DataFrame:
        return profile.profile_combined(self.columns)

    def write(self, folder: str, name: str) -> None:
        sides = self.per_side()
        record = sides.agg(F.map_from_entries(F.collect_list(F.struct(
            "side", F.struct(*[c for c in sides.columns if c != "side"])))).alias("sides"))
        combined = self.combined()
        whole = combined.select(F.struct(*combined.columns).alias("combined")).crossJoin(record)
        whole.select(F.current_timestamp().alias("timestamp"), "sides", "combined").coalesce(
            1).write.mode("overwrite").json(f"{folder}/{name}_overall")
