"""Precision, recall, F1 and average precision of rankings at every cutoff."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _ratio(top: Column, bottom: Column) -> Column:
    return F.when(bottom > 0, top / bottom).otherwise(F.lit(0.0))


def running_hits(rankings: DataFrame, gt: DataFrame) -> DataFrame:
    """Adds ``hit`` (0/1) and ``hits`` so far, in rank order."""
    relevant = gt.filter(F.col("cand_table").isNotNull()).distinct().withColumn("hit", F.lit(1))
    so_far = Window.partitionBy("query_table").orderBy("rank").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    return (
        rankings.join(relevant, ["query_table", "cand_table"], "left")
        .withColumn("hit", F.coalesce("hit", F.lit(0)))
        .withColumn("hits", F.sum("hit").over(so_far))
    )


def metrics_per_query(rankings: DataFrame, gt: DataFrame, k: int = 10) -> DataFrame:
    """``query_table, cutoff, p, r, f1, ap`` for cutoffs 1 to k of every ranked query.

    Cutoffs past the end of a ranking divide by its length. Relevant tables are all those
    in the ground truth, the query itself included even where rankings leave it out.
    """
    relevant = gt.distinct().groupBy("query_table").agg(F.count("cand_table").alias("n_relevant"))
    ranked = rankings.groupBy("query_table").agg(F.count("*").alias("n_ranked"))
    grid = ranked.join(relevant, "query_table").withColumn(
        "rank", F.explode(F.sequence(F.lit(1), F.lit(k))))
    hits = running_hits(rankings, gt).select("query_table", "rank", "hit")
    so_far = Window.partitionBy("query_table").orderBy("rank").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    at = F.col("rank")
    steps = (
        grid.join(hits, ["query_table", "rank"], "left")
        .withColumn("hit", F.coalesce("hit", F.lit(0)))
        .withColumn("hits", F.sum("hit").over(so_far))
        .withColumn("gain", F.sum(F.col("hit") * F.col("hits") / at).over(so_far))
    )
    p = _ratio(F.col("hits"), F.least(at, "n_ranked"))
    r = _ratio(F.col("hits"), F.col("n_relevant"))
    return (
        steps.withColumn("p", p).withColumn("r", r)
        .withColumn("f1", _ratio(2 * F.col("p") * F.col("r"), F.col("p") + F.col("r")))
        .withColumn("ap", _ratio(F.col("gain"), F.least(at, "n_relevant")))
        .select("query_table", at.alias("cutoff"), "p", "r", "f1", "ap")
    )


def metrics_at_k(per_query: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Means over queries: ``cutoff, p, r, f1, map``."""
    return per_query.groupBy(*(keys or []), "cutoff").agg(
        F.avg("p").alias("p"), F.avg("r").alias("r"),
        F.avg("f1").alias("f1"), F.avg("ap").alias("map"))


def ranking_detail(rankings: DataFrame, gt: DataFrame) -> DataFrame:
    """``query_table, list, position, table_name``: the ranked tables of every ranked query
    (``candidates``) and its ground truth in name order (``ground_truth``), a row for each."""
    ranked = rankings.select(
        "query_table", F.lit("candidates").alias("list"), F.col("rank").cast("int").alias("position"),
        F.col("cand_table").alias("table_name"))
    in_order = Window.partitionBy("query_table").orderBy("cand_table")
    truth = (
        gt.filter(F.col("cand_table").isNotNull()).distinct()
        .join(rankings.select("query_table").distinct(), "query_table", "left_semi")
        .select("query_table", F.lit("ground_truth").alias("list"),
                F.row_number().over(in_order).alias("position"), F.col("cand_table").alias("table_name"))
    )
    return ranked.unionByName(truth)
