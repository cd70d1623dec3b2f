"""How much columns and values of ground-truth pairs overlap."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablekin.functions.frames import cut, join_small
from tablekin.functions.key_filter import only_known
from tablekin.functions.text import word_tokens
from tablekin.functions.values import as_long, float_key, plain_look
from tablekin.operators.statistics import unit_interval_stats
from tablekin.schema import COLUMN, DATA_TYPES, QUERY, TABLE

PAIR = ["query_table", "cand_table"]
TYPE_BITS = {name: 1 << i for i, name in enumerate(DATA_TYPES)}
LIST_TABLES = 64  # tables with a value, up to which it is kept as a list of them
BINS = [f"{low}-{low + 10}" for low in range(0, 100, 10)]


def chosen_edges(gt: DataFrame, query_list: DataFrame | None = None) -> DataFrame:
    """Ground-truth edges, of the listed queries only if a list (``query_table``) is given."""
    edges = gt if query_list is None else gt.join(
        query_list.distinct(), "query_table", "left_semi")
    return edges.distinct()


def overlap_pairs(gt: DataFrame, query_list: DataFrame | None = None,
                  exclude_self: bool = True) -> DataFrame:
    """Query and candidate pairs to compare."""
    edges = chosen_edges(gt, query_list).filter(F.col("cand_table").isNotNull())
    return edges.filter(F.col("query_table") != F.col("cand_table")) if exclude_self else edges


def resolve_candidates(pairs: DataFrame, columns_meta: DataFrame) -> DataFrame:
    """Pairs whose tables exist, with the ``location`` the candidate is taken from.

    Queries must be query tables. Candidates come from the lake, else from the queries.
    """
    tables = columns_meta.select(*TABLE).distinct()
    queries = tables.filter(F.col("side") == QUERY).select(
        F.col("table_name").alias("query_table"))
    # 'lake' sorts before 'query'
    candidates = tables.groupBy(F.col("table_name").alias("cand_table")).agg(
        F.min("side").alias("location"))
    return pairs.join(queries, "query_table", "left_semi").join(candidates, "cand_table").select(
        *PAIR, "location")


def involved_tables(resolved: DataFrame) -> DataFrame:
    """``side, table_name`` of all tables in a pair; the rest of the lake need not be read."""
    queries = resolved.select(F.lit(QUERY).alias("side"), F.col("query_table").alias("table_name"))
    candidates = resolved.select(F.col("location").alias("side"),
                                 F.col("cand_table").alias("table_name"))
    return queries.unionByName(candidates).distinct()


def typed_value_sets(cells: DataFrame, types: DataFrame, n_columns: int) -> DataFrame:
    """Distinct ``side, table_name, value_key``, with ``types``, the types it has as bits.

    Text gives its words, integers their value, floats their value to 8 decimals, anything
    else the raw text; numeric columns that do not parse give words. Numbers of equal value
    share a key, and never with a text. Cells meet the type of their column where they are read;
    keys are made distinct there first, so one small shuffle is all.
    """
    values = cells.filter(F.col("value").isNotNull()).select(*COLUMN, "value", "row_id")
    columns = types.select(
        *COLUMN, "data_type",
        (F.col("data_type").isin("integer", "float") & ~_parses(F.col("data_type"))).alias("_words"))
    typed = join_small(values, columns, COLUMN, n_columns, spread=["row_id"]).withColumn(
        "_look", F.when(F.col("data_type").isin("integer", "float"), plain_look(F.col("value"))))
    value, data_type, look = F.col("value"), F.col("data_type"), F.col("_look")
    as_words = F.col("_words") | (data_type == "string")
    keys = (
        F.when(as_words, word_tokens(value))
        .when(data_type == "integer", F.array(
            F.when(look == "integer", value).otherwise(
                F.coalesce(as_long(value).cast("string"), F.trim(value)))))
        .when(data_type == "float", F.array(float_key(value, look)))
        .otherwise(F.array(value))
    )
    is_text = as_words | (data_type == "other")
    bit = F.when(F.col("_words"), TYPE_BITS["string"])
    for name, value_of_bit in TYPE_BITS.items():
        bit = bit.when(data_type == name, value_of_bit)
    exploded = typed.select(
        *TABLE, bit.alias("types"), F.when(is_text, "s:").otherwise("n:").alias("_kind"),
        F.explode(keys).alias("value_key"))
    return exploded.groupBy(
        *TABLE, F.concat("_kind", "value_key").alias("value_key")
    ).agg(F.bit_or("types").alias("types"))


def value_sets_by_type(value_sets: DataFrame) -> DataFrame:
    """``side, table_name, data_type, value_key``, a row for each type of a value."""
    names = F.array(*[F.when(F.col("types").bitwiseAND(bit) > 0, name)
                      for name, bit in TYPE_BITS.items()])
    return value_sets.select(*TABLE, "value_key", F.explode(names).alias("data_type")).filter(
        F.col("data_type").isNotNull())


def _parses(data_type: Column) -> Column:
    """Whether all values of a numeric column parse as its type."""
    whole = F.coalesce(F.col("all_long"), F.lit(False)) | F.coalesce(F.col("all_uint64"),
                                                                    F.lit(False))
    return F.when(data_type == "integer", whole).otherwise(
        F.coalesce(F.col("all_double"), F.lit(False)))


def _coefficients(common: Column, left: Column, right: Column) -> list[Column]:
    smaller, union = F.least(left, right), left + right - common
    return [
        F.when(smaller > 0, common / smaller).otherwise(0.0).alias("overlap_coefficient"),
        F.when(union > 0, common / union).otherwise(0.0).alias("jaccard"),
    ]


def column_overlap(resolved: DataFrame, columns: DataFrame) -> DataFrame:
    """Shared column names of each pair; ``columns`` are those with values."""
    names = columns.select(*TABLE, "col_name").distinct()
    counts = names.groupBy(*TABLE).agg(F.count("*").alias("n"))
    of_query = names.filter(F.col("side") == QUERY).select(
        F.col("table_name").alias("query_table"), "col_name")
    of_cand = names.select(F.col("side").alias("location"),
                           F.col("table_name").alias("cand_table"), "col_name")
    common = (
        resolved.join(of_query, "query_table")
        .join(of_cand, ["location", "cand_table", "col_name"])
        .groupBy(*PAIR)
        .agg(F.count("*").alias("common"),
             F.array_sort(F.collect_set("col_name")).alias("common_columns"))
    )
    sized = _with_sizes(resolved, counts).join(common, PAIR, "left").withColumn(
        "common", F.coalesce("common", F.lit(0)))
    return sized.select(
        *PAIR, "location", F.col("n_query").alias("query_count"),
        F.col("n_cand").alias("cand_count"), "common",
        *_coefficients(F.col("common"), F.col("n_query"), F.col("n_cand")),
        F.coalesce("common_columns", F.array().cast("array<string>")).alias("common_columns"))


def _with_sizes(resolved: DataFrame, sizes: DataFrame) -> DataFrame:
    of_query = sizes.filter(F.col("side") == QUERY).select(
        F.col("table_name").alias("query_table"), F.col("n").alias("n_query"))
    of_cand = sizes.select(F.col("side").alias("location"),
                           F.col("table_name").alias("cand_table"), F.col("n").alias("n_cand"))
    return (
        resolved.join(of_query, "query_table", "left")
        .join(of_cand, ["location", "cand_table"], "left")
        .withColumn("n_query", F.coalesce("n_query", F.lit(0)))
        .withColumn("n_cand", F.coalesce("n_cand", F.lit(0)))
    )


def _counts(types: Column, prefix: str) -> list[Column]:
    """Aggregates: all values, and those of each type."""
    return [F.count("*").alias(prefix), *[
        F.count_if(types.bitwiseAND(bit) > 0).alias(f"{prefix}_{name}")
        for name, bit in TYPE_BITS.items()]]


def _shared_values(resolved: DataFrame, value_sets: DataFrame, n_pairs: int,
                   list_tables: int) -> DataFrame:
    """A row for each value that both tables of a pair have: ``PAIR, types`` found on both sides.

    Candidates first lose the values that no query has, by a Bloom filter. Values of at most
    ``list_tables`` tables then meet as inverted lists: each value once with the candidates
    that hold it, each query's value once beside them, and only pairs asked for go on. Commoner
    values meet by candidate and value, keys that no row repeats more often than the candidate
    has queries. So no value gathers more than a short list in one place. Which values are commoner
    is counted by hash, of all tables in pairs; where these are few themselves, no value is.
    """
    of_query = join_small(
        value_sets.filter(F.col("side") == QUERY).select(
            F.col("table_name").alias("query_table"), "value_key", F.col("types").alias("_types")),
        resolved.select("query_table").distinct(), ["query_table"], n_pairs,
        spread=["value_key"], how="left_semi")
    of_cand = join_small(
        value_sets.select(F.col("side").alias("location"),
                          F.col("table_name").alias("cand_table"), "value_key", "types"),
        resolved.select("location", "cand_table").distinct(), ["location", "cand_table"], n_pairs,
        spread=["value_key"], how="left_semi")
    of_cand = cut(only_known(of_cand, "value_key", of_query, of_query.count()))

    few = involved_tables(resolved).count() <= list_tables
    key_hash = F.xxhash64("value_key").alias("_hash")
    if not few:
        tables = of_query.select(key_hash).unionByName(of_cand.select(key_hash))
        common = cut(tables.groupBy("_hash").agg(F.count("*").alias("_n")).filter(
            F.col("_n") > list_tables).select("_hash"))
        n_common = common.count()

    def part(sets: DataFrame, how: str, spread: str) -> DataFrame:
        if few:  # nothing is common
            return sets
        return join_small(sets.withColumn("_hash", key_hash), common, ["_hash"], n_common,
                          spread=[spread], how=how).drop("_hash")

    held = part(of_cand, "left_anti", "cand_table").groupBy("value_key").agg(
        F.collect_list(F.struct("cand_table", "types")).alias("_held"))
    listed = part(of_query, "left_anti", "query_table").join(held, "value_key").select(
        "query_table", "value_key", "_types", F.inline("_held"))
    listed = join_small(listed, resolved.select(*PAIR), PAIR, n_pairs, spread=["value_key"],
                        how="left_semi")
    both = [*PAIR, F.col("types").bitwiseAND(F.col("_types")).alias("types")]
    if few:
        return listed.select(*both)

    wanted = join_small(part(of_query, "left_semi", "query_table"), resolved, ["query_table"],
                        n_pairs, spread=["value_key"])
    met = wanted.join(part(of_cand, "left_semi", "cand_table"),
                      ["location", "cand_table", "value_key"])
    return listed.select(*both).unionByName(met.select(*both))


def value_counts(resolved: DataFrame, value_sets: DataFrame, n_pairs: int,
                 list_tables: int = LIST_TABLES) -> DataFrame:
    """One row per pair: values of the query, of the candidate and of both, by type and at all.

    ``list_tables`` decides which way values meet, not the result.
    """
    common = _shared_values(resolved, value_sets, n_pairs, list_tables).groupBy(*PAIR).agg(
        *_counts(F.col("types"), "common"))
    sizes = value_sets.groupBy(*TABLE).agg(*_counts(F.col("types"), "n"))
    names = [c for c in sizes.columns if c not in TABLE]
    query_sizes = sizes.filter(F.col("side") == QUERY).select(
        F.col("table_name").alias("query_table"), *[F.col(c).alias(f"query_{c}") for c in names])
    cand_sizes = sizes.select(
        F.col("side").alias("location"), F.col("table_name").alias("cand_table"),
        *[F.col(c).alias(f"cand_{c}") for c in names])
    return (
        resolved.join(query_sizes, "query_table", "left")
        .join(cand_sizes, ["location", "cand_table"], "left")
        .join(common, PAIR, "left").fillna(0)
    )


def value_overlap(counts: DataFrame) -> DataFrame:
    """Shared values of each pair over all types."""
    return counts.select(
        *PAIR, "location", F.col("query_n").alias("query_count"),
        F.col("cand_n").alias("cand_count"), "common",
        *_coefficients(F.col("common"), F.col("query_n"), F.col("cand_n")))


def value_overlap_by_type(counts: DataFrame) -> DataFrame:
    """Shared values per type; a type found on one side only counts with coefficient 0."""
    per_type = F.array(*[
        F.struct(F.lit(name).alias("data_type"), F.col(f"query_n_{name}").alias("query_count"),
                 F.col(f"cand_n_{name}").alias("cand_count"),
                 F.col(f"common_{name}").alias("common")) for name in DATA_TYPES])
    return counts.select(*PAIR, F.inline(per_type)).filter(
        (F.col("query_count") > 0) | (F.col("cand_count") > 0)
    ).select("*", *_coefficients(F.col("common"), F.col("query_count"), F.col("cand_count")))


def _bin() -> Column:
    """Tenth of the coefficient, in integers: 100 % falls into the last."""
    tenth = F.expr("common * 10 div least(query_count, cand_count)")
    return F.when(F.least("query_count", "cand_count") > 0,
                  F.least(F.lit(9).cast("bigint"), tenth)).otherwise(F.lit(0).cast("bigint"))


def overlap_histogram(overlaps: DataFrame) -> DataFrame:
    """``bin, n, percentage`` of pairs per tenth; empty bins only if there are no pairs.

    ``overlaps`` are per-pair counts of columns or of values.
    """
    counted = overlaps.groupBy(_bin().alias("_bin")).agg(F.count("*").alias("n"))
    every_bin = overlaps.sparkSession.range(10).withColumnRenamed("id", "_bin")
    total = overlaps.agg(F.count("*").alias("_total"))
    return (
        every_bin.join(F.broadcast(counted), "_bin", "left").crossJoin(F.broadcast(total))
        .filter(F.col("n").isNotNull() | (F.col("_total") == 0))
        .select(_bin_name().alias("bin"), F.coalesce("n", F.lit(0)).alias("n"),
                F.when(F.col("_total") > 0, F.col("n") / F.col("_total") * 100)
                .otherwise(0.0).alias("percentage"))
    )


def _bin_name() -> Column:
    return F.element_at(F.array(*[F.lit(name) for name in BINS]),
                        (F.col("_bin") + 1).cast("int"))


def overlap_histogram_by_type(overlaps: DataFrame) -> DataFrame:
    """All ten bins of all four types, with percentages within the type."""
    counted = overlaps.groupBy("data_type", _bin().alias("_bin")).agg(F.count("*").alias("n"))
    totals = counted.groupBy("data_type").agg(F.sum("n").alias("_total"))
    cells = overlaps.sparkSession.range(10).select(
        F.col("id").alias("_bin"),
        F.explode(F.array(*[F.lit(t) for t in DATA_TYPES])).alias("data_type"))
    return (
        cells.join(F.broadcast(counted), ["data_type", "_bin"], "left")
        .join(F.broadcast(totals), "data_type", "left")
        .select("data_type", _bin_name().alias("bin"), F.coalesce("n", F.lit(0)).alias("n"),
                F.coalesce(F.col("n") / F.col("_total") * 100, F.lit(0.0)).alias("percentage"))
    )


def coefficients(columns: DataFrame, values: DataFrame, by_type: DataFrame) -> DataFrame:
    """``query_table, measure, overlap_coefficient``: columns, values, or values of one type."""
    kept = ["query_table", "measure", "overlap_coefficient"]
    return (
        columns.withColumn("measure", F.lit("columns")).select(*kept)
        .unionByName(values.withColumn("measure", F.lit("values")).select(*kept))
        .unionByName(by_type.withColumn(
            "measure", F.concat(F.lit("values:"), "data_type")).select(*kept))
    )


def grouped_stats(long: DataFrame) -> DataFrame:
    """Statistics by measure and by query and measure, from one expansion and one aggregation.

    ``grouping_id`` is 0 for those of a query, else 2.
    """
    return unit_interval_stats(long, "overlap_coefficient", ["query_table", "measure"],
                               [["query_table", "measure"], ["measure"]])


def overlap_stats(grouped: DataFrame) -> DataFrame:
    return grouped.filter(F.col("grouping_id") == 2).drop("grouping_id", "query_table")


def overlap_by_query(gt: DataFrame, grouped: DataFrame) -> DataFrame:
    """Statistics per query and measure. Queries without an analysed pair are left out."""
    counts = gt.distinct().groupBy("query_table").agg(
        F.count("cand_table").alias("total_candidates"))
    return grouped.filter(F.col("grouping_id") == 0).drop("grouping_id").join(
        counts, "query_table")


def overlap_summary(gt: DataFrame, resolved: DataFrame,
                    query_list: DataFrame | None = None) -> DataFrame:
    """One row of counters over the ground truth and the analysed pairs."""
    edges = chosen_edges(gt, query_list)
    is_self = F.col("query_table") == F.col("cand_table")
    found = edges.agg(
        F.count_distinct("query_table").alias("found_queries"),
        F.count_if(is_self).alias("self_pairs"))
    pairs = resolved.groupBy("query_table").agg(F.count("*").alias("n")).agg(
        F.count("*").alias("total_queries"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_relationships"))
    requested = F.lit(None).cast("bigint") if query_list is None else F.col("requested_queries")
    row = found.crossJoin(pairs)
    if query_list is not None:
        row = row.crossJoin(query_list.agg(F.count("*").alias("requested_queries")))
    return row.select(
        "total_queries", "total_relationships",
        F.when(F.col("total_queries") > 0,
               F.col("total_relationships") / F.col("total_queries")).otherwise(0.0)
        .alias("avg_candidates"),
        requested.alias("requested_queries"), "found_queries", "self_pairs",
        (F.col("self_pairs") > 0).alias("queries_as_candidates"))
