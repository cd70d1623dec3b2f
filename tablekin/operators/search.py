"""Exact cosine search for the k best candidate tables of each query table.

Scores are rounded to six places before ranking; equal scores rank by name.
"""

import math
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablekin.functions.frames import SALTS, first_per_group
from tablekin.operators.features import l2_normalise
from tablekin.operators.pruned import DIGITS, best_of_all
from tablekin.schema import MARK, QUERY

# query vector entries broadcast at once; more are searched block by block
BLOCK_ENTRIES = 4_000_000


def candidate_pool(vectors: DataFrame, prefer: str = QUERY) -> DataFrame:
    """All tables with a vector, lake and query, one ``side`` for each name.

    A name found on both sides is taken from the preferred one: from the queries when pooled
    vectors are searched, from the lake when columns are matched.
    """
    # 'query' sorts after 'lake'
    pick = F.max("side") if prefer == QUERY else F.min("side")
    return vectors.filter(F.col("dim") == MARK).groupBy("table_name").agg(pick.alias("side"))


def pool_vectors(table_vectors: DataFrame) -> DataFrame:
    """Unit-length vectors of the candidate pool: ``table_name, dim, weight``.

    The query's vector replaces that of a lake table of the same name.
    """
    chosen = F.max("side").over(Window.partitionBy("table_name"))
    kept = table_vectors.withColumn("_side", chosen).filter(F.col("side") == F.col("_side"))
    return l2_normalise(kept.select("table_name", "dim", "weight"), ["table_name"])


def pool_names(vectors: DataFrame) -> DataFrame:
    return vectors.filter(F.col("dim") == MARK).select("table_name").distinct()


def valid_queries(gt: DataFrame, pool: DataFrame) -> DataFrame:
    """Ground-truth queries that have a vector; others leave the averages."""
    return (
        gt.select("query_table").distinct()
        .join(pool.select(F.col("table_name").alias("query_table")), "query_table", "left_semi")
    )


def sample_queries(queries: DataFrame, n: int) -> DataFrame:
    """n queries in md5 order; the n names pass one task."""
    return queries.orderBy(F.md5("query_table"), "query_table").limit(n)


def query_blocks(query_entries: DataFrame, by: list[str]) -> list[DataFrame]:
    """The entries of query vectors, cut so that each part is small enough to broadcast.

    The entries are counted, so they should come from stored vectors. Parts are made by hash
    of the ``by`` columns; results of all parts together do not depend on their number.
    """
    blocks = max(1, math.ceil(query_entries.count() / BLOCK_ENTRIES))
    if blocks == 1:
        return [query_entries]
    part = F.pmod(F.xxhash64(*by), F.lit(blocks))
    return [query_entries.filter(part == block) for block in range(blocks)]


def cosine_pairs(vectors: DataFrame, queries: DataFrame) -> DataFrame:
    """``query_table, cand_table, score`` of all pairs that share an entry.

    The candidates are partitioned by table and the query vectors broadcast block by block,
    so the sum per pair needs no shuffle and only the best k pairs of a task leave it.
    """
    entries = vectors.filter(F.col("dim") != MARK)
    query_vectors = entries.select(
        F.col("table_name").alias("query_table"), "dim", F.col("weight").alias("_qw")
    ).join(queries, "query_table", "left_semi")
    candidates = entries.select(
        F.col("table_name").alias("cand_table"), "dim", "weight").repartition("cand_table")
    parts = [
        candidates.join(F.broadcast(block), "dim")
        .groupBy("query_table", "cand_table")
        .agg(F.round(F.sum(F.col("weight") * F.col("_qw")), DIGITS).alias("score"))
        for block in query_blocks(query_vectors, ["query_table"])
    ]
    return reduce(DataFrame.unionByName, parts)


def _order(names_descending: bool) -> list:
    name = F.col("cand_table")
    return [F.col("score").desc(), name.desc() if names_descending else name]


def top_k(pairs: DataFrame, k: int, names_descending: bool = False,
          salts: int = SALTS) -> DataFrame:
    return first_per_group(pairs, ["query_table"], _order(names_descending), k,
                           spread=["cand_table"], rank="rank", salts=salts)


def pad_ranking(pairs: DataFrame, queries: DataFrame, pool: DataFrame, k: int,
                exclude_self: bool = False, names_descending: bool = False) -> DataFrame:
    """Top k of the scored pairs, filled up with tables of score 0 in name order.

    A query with m < k scored tables needs k - m others. At most m of the first names are
    scored already and one is the query itself, so the first k + 1 names of the pool hold
    them all. ``score`` comes from non-negative weights.
    """
    name = F.col("table_name").desc() if names_descending else F.col("table_name")
    fill = pool.select("table_name").orderBy(name).limit(k + 1)
    zeros = queries.crossJoin(F.broadcast(fill)).select(
        "query_table", F.col("table_name").alias("cand_table"), F.lit(0.0).alias("score"))
    if exclude_self:
        pairs = pairs.filter(F.col("query_table") != F.col("cand_table"))
        zeros = zeros.filter(F.col("query_table") != F.col("cand_table"))
    best = top_k(pairs, k, names_descending).select("query_table", "cand_table", "score")
    merged = best.unionByName(zeros).groupBy("query_table", "cand_table").agg(
        F.max("score").alias("score"))
    # at most 2k + 1 rows per query
    return top_k(merged, k, names_descending, salts=1)


def entry_lists(entries: DataFrame, keys: list[str]) -> DataFrame:
    """One row per vector with its ``dims`` and ``weights``; a vector has at most one entry per dimension."""
    real = F.col("dim") != MARK
    return entries.groupBy(*keys).agg(
        F.collect_list(F.when(real, F.col("dim"))).alias("dims"),
        F.collect_list(F.when(real, F.col("weight"))).alias("weights"))


def pooled_top_k(vectors: DataFrame, gt: DataFrame, k: int = 10,
                 exclude_self: bool = False) -> DataFrame:
    """``query_table, cand_table, score, rank`` by cosine of ``pool_vectors``.

    ``vectors`` is read several times, so it should be stored or cut. Blocks of vectors are multiplied, those
    that cannot hold one of the best left out (see ``pruned``); no row is made per pair or entry. Tables without a common entry score 0.
    """
    queries = valid_queries(gt, pool_names(vectors))
    rows = entry_lists(vectors, ["table_name"])
    asked = rows.withColumnRenamed("table_name", "query_table").join(queries, "query_table", "left_semi")
    return top_k(best_of_all(asked, rows.withColumnRenamed("table_name", "cand_table"), ["dims", "weights"], k,
                             exclude_self), k)


def dense_top_k(queries: DataFrame, candidates: DataFrame, k: int = 10,
                exclude_self: bool = False) -> DataFrame:
    """The same for dense vectors: ``query_table, vec`` against ``cand_table, vec``."""
    return top_k(best_of_all(queries, candidates, ["vec"], k, exclude_self), k)
