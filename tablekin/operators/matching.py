"""Tables compared column by column: similar column pairs and their best alignment."""

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablekin.functions.assignment import best_alignment, edge_matrix, upper_bound
from tablekin.functions.frames import cut, first_per_group, join_small
from tablekin.operators.pruned import DIGITS, all_above
from tablekin.operators.search import candidate_pool, entry_lists, pad_ranking, valid_queries
from tablekin.schema import COLUMN, LAKE, MARK, QUERY, TABLE


def _column_pairs(vectors: DataFrame, column: str, values: list[str], queries: DataFrame, pool: DataFrame,
                  threshold: float) -> DataFrame:
    if threshold < 0:
        raise ValueError("what has no edge would score more than some that have one")
    named = vectors.withColumn("_col", F.col(column).cast("int"))
    own = named.join(queries.withColumnRenamed("query_table", "table_name"), ["side", "table_name"]).select(
        F.col("table_name").alias("query_table"), F.col("_col").alias("query_col"), *values)
    others = named.join(pool, ["side", "table_name"]).select(
        F.col("table_name").alias("cand_table"), F.col("_col").alias("cand_col"), *values)
    return all_above(cut(own), others, ["query_table", "query_col"], ["cand_table", "cand_col"], values, threshold)


def column_pair_similarity(vectors: DataFrame, queries: DataFrame, pool: DataFrame,
                           threshold: float = 0.1) -> DataFrame:
    """Column pairs with cosine above ``threshold`` (>= 0): the edges of each table pair.

    ``vectors`` have unit length. ``queries`` is ``query_table, side``, ``pool`` is
    ``table_name, side``. Query columns are broadcast in blocks, candidate columns stay where
    they lie, and only pairs above the threshold leave a task.
    """
    return _column_pairs(entry_lists(vectors, COLUMN), "col_pos", ["dims", "weights"], queries, pool, threshold)


def dense_column_pairs(vectors: DataFrame, queries: DataFrame, pool: DataFrame,
                       threshold: float = 0.1) -> DataFrame:
    """The same for dense vectors: ``side, table_name, unit_id, vec``, one per column.

    Cosines below the threshold, negative ones included, leave no edge, and a column without
    length is like none.
    """
    return _column_pairs(vectors, "unit_id", ["vec"], queries, pool, threshold)


def _pair_edges(edges: DataFrame) -> DataFrame:
    """One row per table pair; its lists are no longer than columns times columns."""
    return edges.groupBy("query_table", "cand_table").agg(
        F.collect_list(F.struct("query_col", "cand_col", "sim")).alias("edges")
    ).select("query_table", "cand_table", "edges.query_col", "edges.cand_col", "edges.sim")


@F.pandas_udf(T.DoubleType())
def _alignment(left: pd.Series, right: pd.Series, sim: pd.Series) -> pd.Series:
    return pd.Series([best_alignment(edge_matrix(*lists)) for lists in zip(left, right, sim)], dtype=float)


def _solved(pairs: DataFrame) -> DataFrame:
    return pairs.select("query_table", "cand_table", F.round(_alignment("query_col", "cand_col", "sim"), DIGITS).alias("score"))


def bipartite_scores(edges: DataFrame) -> DataFrame:
    """The weight of the best one-to-one alignment of every table pair with an edge."""
    return _solved(_pair_edges(edges))


@F.pandas_udf(T.DoubleType())
def _bound(left: pd.Series, right: pd.Series, sim: pd.Series) -> pd.Series:
    return pd.Series([upper_bound(edge_matrix(*lists)) for lists in zip(left, right, sim)], dtype=float)


def bipartite_candidates(edges: DataFrame, k: int) -> DataFrame:
    """Scores of all pairs that can be among a query's k best; the rest is never solved.

    The k pairs of each query with the highest upper bounds are solved first. The k-th best of their
    scores is sent to all tasks, and of the other pairs only those whose bound reaches it are solved. Which pairs
    that are depends on the edges alone.
    """
    pairs = cut(_pair_edges(edges).withColumn("bound", _bound("query_col", "cand_col", "sim")))
    order = [F.col("bound").desc(), F.col("cand_table")]
    chosen = cut(first_per_group(pairs.select("query_table", "cand_table", "bound"), ["query_table"], order, k,
                                 spread=["cand_table"]).select("query_table", "cand_table"))
    n = chosen.count()
    on = ["query_table", "cand_table"]
    solved = cut(_solved(join_small(pairs, chosen, on, n, spread=["cand_table"], how="left_semi")))
    thresholds = solved.groupBy("query_table").agg(F.count("*").alias("n"), F.min("score").alias("kth")).filter(
        F.col("n") == k).select("query_table", "kth")
    rest = join_small(pairs, chosen, on, n, spread=["cand_table"], how="left_anti")
    # half a unit of the last digit kept can still be rounded to a tie
    reaching = join_small(rest, thresholds, ["query_table"], n, spread=["cand_table"]).filter(
        F.col("bound") >= F.col("kth") - 10.0 ** -DIGITS)
    return solved.unionByName(_solved(reaching))


def query_sides(gt: DataFrame, vectors: DataFrame) -> DataFrame:
    """``query_table, side``: queries use their own copy, else the lake's."""
    own = candidate_pool(vectors, prefer=QUERY).withColumnRenamed("table_name", "query_table")
    return own.join(gt.select("query_table").distinct(), "query_table", "left_semi")


def bipartite_top_k(vectors: DataFrame, gt: DataFrame, k: int = 10, threshold: float = 0.1,
                    exclude_self: bool = False) -> DataFrame:
    """``query_table, cand_table, score, rank`` by best alignment; ties by name, descending.

    ``vectors`` are column vectors, read several times, so stored or cut.
    """
    pool = candidate_pool(vectors, prefer=LAKE)
    edges = column_pair_similarity(vectors, query_sides(gt, vectors), pool, threshold)
    return _rank_edges(edges, gt, pool, k, exclude_self)


def dense_marks(vectors: DataFrame) -> DataFrame:
    """One row per vector that stands for its mark."""
    return vectors.select(*TABLE, F.lit(MARK).alias("dim"))


def dense_bipartite_top_k(vectors: DataFrame, gt: DataFrame, k: int = 10, threshold: float = 0.1,
                          exclude_self: bool = False) -> DataFrame:
    """The same for dense column vectors."""
    marks = dense_marks(vectors)
    pool = candidate_pool(marks, prefer=LAKE)
    edges = dense_column_pairs(vectors, query_sides(gt, marks), pool, threshold)
    return _rank_edges(edges, gt, pool, k, exclude_self)


def _rank_edges(edges: DataFrame, gt: DataFrame, pool: DataFrame, k: int,
                exclude_self: bool) -> DataFrame:
    if exclude_self:
        edges = edges.filter(F.col("query_table") != F.col("cand_table"))
    return pad_ranking(bipartite_candidates(edges, k), valid_queries(gt, pool), pool, k,
                       exclude_self, names_descending=True)
