"""Sparse column vectors: hashed, count and TF-IDF.

A vector is a set of rows ``side, table_name, col_pos, dim, weight``; absent entries are 0,
and an entry of weight 0 in dimension MARK says that the column has a vector at all.
Values are tokenised one by one and never glued to one large text; n-grams across the
border of two values get the words before the border from a window. The sample leaves the
cells partitioned by column, so counting and normalising need no further shuffle.
"""

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablekin.functions.text import hash_bucket, ngrams, without_stop_words, word_tokens
from tablekin.functions.values import BLANK_PATTERN
from tablekin.operators.sampling import column_sample
from tablekin.schema import COLUMN, LAKE, MARK, TABLE


def column_values(cells: DataFrame, columns_meta: DataFrame, n: int = 1000,
                  include_names: bool = False) -> DataFrame:
    """Sampled values in order; with names, the column name comes first as number 0."""
    values = column_sample(cells, n).select(*COLUMN, "rn", "value")
    if include_names:
        names = columns_meta.select(*COLUMN, F.lit(0).alias("rn"), F.col("col_name").alias("value"))
        values = values.unionByName(names)
    return values


def l2_normalise(weights: DataFrame, keys: list[str]) -> DataFrame:
    """Weights divided by the length of their vector; vectors without weight stay as they are."""
    length = F.sqrt(F.sum(F.col("weight") * F.col("weight")).over(Window.partitionBy(*keys)))
    return weights.withColumn("weight", F.when(length > 0, F.col("weight") / length).otherwise(0.0))


def hashing_counts(values: DataFrame, n_features: int = 4096) -> DataFrame:
    """Token counts per bucket: words of two and more characters, no stop words."""
    tokens = values.select(*COLUMN, F.explode(word_tokens(F.col("value"), 2)).alias("token"))
    return tokens.groupBy(*COLUMN, hash_bucket(F.col("token"), n_features).alias("dim")).agg(
        F.count("*").alias("tf"))


def hash_vectors(values: DataFrame, n_features: int = 4096) -> DataFrame:
    """Vectors of the columns that have text; the hashing method skips blank ones."""
    buckets = F.transform(word_tokens(F.col("value"), 2),
                          lambda token: hash_bucket(token, n_features))
    mark = F.when(F.col("value").rlike(BLANK_PATTERN), F.array().cast("array<int>")).otherwise(
        F.array(F.lit(MARK)))
    counts = values.select(*COLUMN, F.explode(F.concat(mark, buckets)).alias("dim")).groupBy(
        *COLUMN, "dim").agg(F.count("*").alias("tf"))
    weight = F.when(F.col("dim") == MARK, 0.0).otherwise(F.col("tf").cast("double"))
    return l2_normalise(counts.select(*COLUMN, "dim", weight.alias("weight")), COLUMN)


def term_counts(values: DataFrame, stop_words: list[str],
                ngram_range: tuple[int, int] = (1, 2)) -> DataFrame:
    """Counts of word n-grams per column, over the column's values read one after another."""
    low, high = ngram_range
    words = values.select(
        *COLUMN, "rn",
        without_stop_words(word_tokens(F.col("value")), stop_words).alias("words"),
    ).filter(F.size("words") > 0)
    if high == 1:
        terms = words.select(*COLUMN, F.explode("words").alias("term"))
    else:
        # each value has a word, so the last words before it are in the high - 1 values before it
        keep = high - 1
        tail = F.slice("words", F.greatest(F.size("words") - (keep - 1), F.lit(1)), keep)
        before = Window.partitionBy(*COLUMN).orderBy("rn").rowsBetween(-keep, -1)
        context = words.withColumn("_before", F.flatten(F.collect_list(tail).over(before)))
        terms = (
            context.withColumn("_before", F.slice(
                "_before", F.greatest(F.size("_before") - (keep - 1), F.lit(1)), keep))
            .select(*COLUMN, F.concat("_before", "words").alias("words"),
                    F.size("_before").alias("n_before"))
            .select(*COLUMN, F.explode(
                ngrams(F.col("words"), F.col("n_before"), low, high)).alias("term"))
        )
    return terms.groupBy(*COLUMN, "term").agg(F.count("*").alias("tf"))


def vocabulary(counts: DataFrame, max_features: int = 4096,
               extra: Sequence[DataFrame] = ()) -> DataFrame:
    """The most frequent lake terms: ``term, term_id, tf, df``; at most ``max_features`` rows.

    Query terms are counted but take no part: leaving them in keeps this branch of a plan
    equal to the one that builds the vectors, so that Spark runs their shuffle once.
    """
    lake = F.col("side") == LAKE
    per_term = counts.groupBy("term").agg(
        F.coalesce(F.sum(F.when(lake, F.col("tf"))), F.lit(0)).alias("tf"),
        F.count_if(lake).alias("df"))
    for more in extra:
        per_term = per_term.unionByName(
            more.groupBy("term").agg(F.sum("tf").alias("tf"), F.count("*").alias("df")))
    if extra:
        per_term = per_term.groupBy("term").agg(F.sum("tf").alias("tf"), F.sum("df").alias("df"))
    order = [F.col("tf").desc(), F.col("term")]
    top = per_term.filter(F.col("tf") > 0).orderBy(*order).limit(max_features)
    # one task numbers them, but never more than max_features rows
    return top.withColumn("term_id", F.row_number().over(Window.orderBy(*order)) - 1)


def text_count(columns_meta: DataFrame, extra: Sequence[DataFrame] = ()) -> DataFrame:
    """One row ``n_docs``: texts the vocabulary is fitted on, empty ones included."""
    total = columns_meta.agg(F.count_if(F.col("side") == LAKE).alias("n_docs"))
    for more in extra:
        total = total.unionByName(more.agg(F.count("*").alias("n_docs")))
    return total.agg(F.sum("n_docs").alias("n_docs")) if extra else total


def idf_weights(terms: DataFrame, n_docs: DataFrame) -> DataFrame:
    """The vocabulary with smoothed idf: ln((1 + n) / (1 + df)) + 1."""
    return terms.crossJoin(F.broadcast(n_docs)).withColumn(
        "idf", F.log((1 + F.col("n_docs")) / (1 + F.col("df"))) + 1).drop("n_docs")


def _with_marks(vectors: DataFrame, columns_meta: DataFrame) -> DataFrame:
    """Adds the marks: counts and TF-IDF keep empty columns as vectors without weight."""
    return vectors.unionByName(columns_meta.select(
        *COLUMN, F.lit(MARK).alias("dim"), F.lit(0.0).alias("weight")))


def count_vectors(counts: DataFrame, terms: DataFrame, columns_meta: DataFrame) -> DataFrame:
    known = counts.join(F.broadcast(terms.select("term", "term_id")), "term")
    weights = known.select(
        *COLUMN, F.col("term_id").alias("dim"), F.col("tf").cast("double").alias("weight"))
    return _with_marks(l2_normalise(weights, COLUMN), columns_meta)


def tfidf_vectors(counts: DataFrame, weighted_terms: DataFrame,
                  columns_meta: DataFrame) -> DataFrame:
    known = counts.join(F.broadcast(weighted_terms.select("term", "term_id", "idf")), "term")
    weights = known.select(
        *COLUMN, F.col("term_id").alias("dim"), (F.col("tf") * F.col("idf")).alias("weight"))
    return _with_marks(l2_normalise(weights, COLUMN), columns_meta)


def unit_counts(vectors: DataFrame) -> DataFrame:
    """Columns with a vector per table, ``n_units``: the divisor of a mean."""
    return vectors.filter(F.col("dim") == MARK).groupBy(*TABLE).agg(
        F.count("*").alias("n_units"))
