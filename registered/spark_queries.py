"""Every operator as a query over the carved lake or the given tables."""

import math
import uuid
from collections.abc import Callable
from functools import cached_property, lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from registered.lake import BASES, CarvedLake, carved_lake, money
from tablekin.functions import vectors as V
from tablekin.functions.encoders import HashedWords, encode_texts
from tablekin.functions.frames import cut, shared_folder
from tablekin.functions.headers import disambiguate_headers
from tablekin.functions.text import (
    english_stop_words,
    ngrams,
    without_stop_words,
    word_tokens,
)
from tablekin.operators import (
    features,
    matching,
    metrics,
    overlap,
    pooling,
    prep,
    profile,
    sampling,
    search,
    texts,
    typing,
)
from tablekin.plans import experiments, ranking, stored_vectors
from tablekin.plans.overlap_report import OverlapReport
from tablekin.plans.profile_report import ProfileReport
from tablekin.schema import COLUMN, LAKE, QUERY, TABLE
from tablekin.sources.csv_lake import read_csv_lake
from tablekin.sources.frames_lake import read_parquet_lake
from tablekin.sources.result_store import ResultStore
from tablekin.sources.vector_store import VectorStore, table_prints

K = 10
N_FEATURES = 4096
PART_BYTES = 4_000_000  # of texts whose words are counted in one task
SPARSE = {
    "hash": {"sample_size": 1000, "n_features": N_FEATURES, "include_column_names": False},
    "count": {"sample_size": 1000, "max_features": N_FEATURES, "ngram_range": (1, 2),
              "include_column_names": False},
    "tfidf": {"sample_size": 1000, "max_features": N_FEATURES, "ngram_range": (1, 2),
              "include_column_names": False},
}
TYPED_TABLES = ["customer", "events", "lineitem", "nation", "orders", "part", "region", "supplier"]
ENCODER = {"sample_size": 20, "orientation": "vertical", "include_names": True,
           "names_only": False, "deduplicate": True}


class Stored:
    """What a lake's users keep between queries: vectors, rankings and reports, cut once."""

    def __init__(self, lake: CarvedLake):
        self.lake = lake

    @cached_property
    def values(self) -> DataFrame:
        return cut(features.column_values(self.lake.cells, self.lake.meta, 1000))

    @cached_property
    def counts(self) -> DataFrame:
        return cut(features.term_counts(self.values, english_stop_words(), (1, 2)))

    @cached_property
    def terms(self) -> DataFrame:
        return cut(features.idf_weights(features.vocabulary(self.counts, N_FEATURES),
                                        features.text_count(self.lake.meta)))

    @cached_property
    def hash(self) -> DataFrame:
        return cut(features.hash_vectors(self.values, N_FEATURES))

    @cached_property
    def count(self) -> DataFrame:
        return features.count_vectors(self.counts, self.terms, self.lake.meta)

    @cached_property
    def tfidf(self) -> DataFrame:
        return features.tfidf_vectors(self.counts, self.terms, self.lake.meta)

    @cached_property
    def pooled_hash(self) -> DataFrame:
        return cut(search.pool_vectors(pooling.table_vectors(self.hash, "max")))

    @cached_property
    def ranked(self) -> DataFrame:
        return cut(search.pooled_top_k(self.pooled_hash, self.lake.gt, K, True))

    @cached_property
    def edges(self) -> DataFrame:
        return matching.column_pair_similarity(
            self.hash, matching.query_sides(self.lake.gt, self.hash),
            search.candidate_pool(self.hash, LAKE), 0.1)

    @cached_property
    def stats(self) -> DataFrame:
        return typing.column_stats(self.lake.cells, self.lake.meta)

    @cached_property
    def overlap(self) -> OverlapReport:
        return OverlapReport(self.lake.cells, self.lake.meta, self.lake.gt)

    @cached_property
    def profile(self) -> ProfileReport:
        return ProfileReport(self.lake.cells, self.lake.meta)


@lru_cache(maxsize=4)
def stored(lake: CarvedLake) -> Stored:
    return Stored(lake)


def _round(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({name: F.round(name, 6) for name in names})


def _parted(rows: DataFrame, text: str, by: list[str]) -> DataFrame:
    """Rows partitioned by some columns into parts of some PART_BYTES of text, however much there is.

    So a task that counts words holds those of few texts.
    """
    size = rows.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return rows.repartition(max(rows.sparkSession.sparkContext.defaultParallelism, math.ceil(size / PART_BYTES)), *by)


def _documents(w: Stored) -> DataFrame:
    """Texts partitioned by document, so that counting their words shuffles nothing more."""
    return _parted(w.lake.table("documents").select("doc_id", "text"), "text", ["doc_id"])


def _token_counts(df: DataFrame, tokens, name: str = "token") -> DataFrame:
    return df.select("doc_id", F.explode(tokens).alias(name)).groupBy("doc_id", name).agg(
        F.count("*").alias("n"))


# sources, selection, cleaning

def lake_cells(w: Stored) -> DataFrame:
    return w.lake.cells


def _parquet_lake(w: Stored) -> tuple[DataFrame, DataFrame]:
    """Given tables as they are, with their types, all rows and all columns."""
    return read_parquet_lake(w.lake.spark, {
        name: f"{w.lake.sf_dir}/{name}.parquet" for name in TYPED_TABLES}, LAKE)


def parquet_lake_cells(w: Stored) -> DataFrame:
    """What the reader makes of each column: rows, values, different values, and their sum or extremes.

    Equal values of a column are counted together first; row ids are counted by words of 64 bits, one for each run of ids.
    """
    cells, meta = _parquet_lake(w)
    column = ["table_name", "col_pos"]  # all on one side; a place has one name
    number = F.col("value").try_cast("double")
    values = cells.groupBy(*column, "value").agg(F.count("*").alias("_n"))
    per_value = values.groupBy(*column).agg(
        F.sum("_n").alias("n_rows"), F.coalesce(F.sum(F.when(F.col("value").isNotNull(), F.col("_n"))), F.lit(0)).alias("n_values"),
        F.count("value").alias("n_distinct"), F.round(F.sum(number * F.col("_n")), 2).alias("total"),
        F.min("value").alias("least"), F.max("value").alias("most"))
    # shiftleft takes the number of places as a literal only in the API, as a column in SQL
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("row_id").bitwiseAND(F.lit(63)).cast("int"))
    words = cells.groupBy(*column, F.shiftright("row_id", 6).alias("_word")).agg(F.bit_or(bit).alias("_bits"))
    row_ids = words.groupBy(*column).agg(F.sum(F.bit_count("_bits")).alias("n_row_ids"))
    typed = meta.join(per_value, column).join(row_ids, column)
    is_text = F.col("source_type") == "text"
    return typed.select(
        "table_name", "col_pos", "col_name", "source_type", "n_rows", "n_row_ids", "n_values", "n_distinct",
        F.when(~is_text, F.col("total")).alias("total"), F.when(is_text, F.col("least")).alias("least"),
        F.when(is_text, F.col("most")).alias("most"))


# given tables as CSV: column names, one with a line break, and their texts
CSV_TABLES = {base.name: base.columns for base in BASES} | {"lineitem": {
    "l_orderkey": "cast(l_orderkey as string)", "l_linenumber": "cast(l_linenumber as string)",
    "l_quantity": money("l_quantity"), "l_extendedprice": money("l_extendedprice"), "l_returnflag": "l_returnflag",
    "l_shipdate": "date_format(l_shipdate, 'yyyy-MM-dd')"}}
CSV_TABLES["documents"] = {"whole\ntext" if name == "text" else name: text for name, text in CSV_TABLES["documents"].items()}


def csv_lake_cells(w: Stored) -> DataFrame:
    """What the CSV reader makes of whole given tables, written as CSV files by Spark, column by column.

    Equal values of a column are counted together first, by hash; extremes of texts are found among different values.
    """
    folder = f"{shared_folder(w.lake.spark)}/csv-{uuid.uuid4().hex}"
    for name, columns in CSV_TABLES.items():
        table = w.lake.table(name).select(*[F.expr(text).alias(column) for column, text in columns.items()])
        table.write.csv(f"{folder}/{name}", header=True, escape='"', nullValue="", emptyValue="",
                        ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    cells, _ = read_csv_lake(w.lake.spark, f"{folder}/*", LAKE)
    values = cells.groupBy("col_name", "value").agg(F.count("*").alias("_n"))
    return values.groupBy("col_name").agg(
        F.sum("_n").alias("n_rows"), F.coalesce(F.sum(F.when(F.col("value").isNotNull(), F.col("_n"))), F.lit(0)).alias("n_values"),
        F.count("value").alias("n_distinct"), F.coalesce(F.sum(F.octet_length("value") * F.col("_n")), F.lit(0)).alias("n_bytes"),
        F.min("value").alias("least"), F.max("value").alias("most"))


def parquet_column_types(w: Stored) -> DataFrame:
    return typing.column_types(*_parquet_lake(w)).select(
        "table_name", "col_pos", "col_name", "n_rows", "n_values", "data_type")


def disambiguated_headers(w: Stored) -> DataFrame:
    """Headers of the lake after every third name was lost and the others became one name."""
    name = F.when(F.col("col_pos") % 3 == 1, "").otherwise(F.substring_index("table_name", "__", 1))
    return disambiguate_headers(w.lake.meta.withColumn("col_name", name)).select(*COLUMN, "col_name")


def empty_tables(w: Stored) -> DataFrame:
    """Encoder texts where the tables of customers have no rows, nor the suppliers any names."""
    left = w.lake.cells.filter(~F.col("table_name").startswith("customer__")).withColumn(
        "value", F.when(F.col("col_name") != "s_name", F.col("value")))
    return texts.encoder_column_texts(left, w.lake.meta, 20, include_names=False).unionByName(
        texts.header_texts(left, w.lake.meta).withColumn("unit_id", F.lit(-1).cast("long")))


def query_selection(w: Stored) -> DataFrame:
    """Cells per column of the query tables that are lake tables too, asked for by file name."""
    names = w.lake.meta.filter(F.col("side") == LAKE).select(
        F.concat("table_name", F.lit(".csv")).alias("table_name"))
    queries = w.lake.cells.filter(F.col("side") == QUERY)
    return prep.select_tables(queries, names).groupBy("table_name", "col_name").agg(
        F.count("*").alias("n"))


def ground_truth_edges(w: Stored) -> DataFrame:
    return w.lake.gt


def value_type_histogram(w: Stored) -> DataFrame:
    return typing.value_class_histogram(w.lake.cells)


def column_types(w: Stored) -> DataFrame:
    return typing.column_types(w.lake.cells, w.lake.meta).select(
        *COLUMN, "col_name", "n_rows", "n_values", "data_type")


def nonempty_columns(w: Stored) -> DataFrame:
    return typing.nonempty_columns(w.stats).select(*COLUMN, "col_name", "n_values")


# samples and texts

def column_sample(w: Stored) -> DataFrame:
    return sampling.column_sample(w.lake.cells, 1000).select(*COLUMN, "rn", "value")


def distinct_sample(w: Stored) -> DataFrame:
    return sampling.distinct_sample(w.lake.cells, 20).select(*COLUMN, "rn", "value")


def row_sample(w: Stored) -> DataFrame:
    return sampling.row_sample(w.lake.cells, 20)


def column_texts(w: Stored) -> DataFrame:
    return texts.column_texts(w.lake.cells, w.lake.meta, 1000, include_names=True)


def encoder_column_texts(w: Stored) -> DataFrame:
    return texts.encoder_column_texts(w.lake.cells, w.lake.meta, 20)


def encoder_column_texts_plain(w: Stored) -> DataFrame:
    return texts.encoder_column_texts(w.lake.cells, w.lake.meta, 20, include_names=False,
                                      deduplicate=False)


def row_texts(w: Stored) -> DataFrame:
    return texts.row_texts(w.lake.cells, w.lake.n_columns, 20)


def header_texts(w: Stored) -> DataFrame:
    return texts.header_texts(w.lake.cells, w.lake.meta)


# tokens and features

def tokens_hash(w: Stored) -> DataFrame:
    return _token_counts(_documents(w), word_tokens(F.col("text"), 2))


def tokens_word(w: Stored) -> DataFrame:
    return _token_counts(_documents(w), word_tokens(F.col("text")))


def stopword_filter(w: Stored) -> DataFrame:
    return _token_counts(_documents(w), without_stop_words(
        word_tokens(F.col("text")), english_stop_words()))


def word_ngrams(w: Stored) -> DataFrame:
    words = _documents(w).select("doc_id", without_stop_words(
        word_tokens(F.col("text")), english_stop_words()).alias("words"))
    return _token_counts(words, ngrams(F.col("words"), F.lit(0), 1, 2), "term")


def hashing_tf(w: Stored) -> DataFrame:
    values = features.column_values(w.lake.cells, w.lake.meta, 1000)
    return features.hashing_counts(values, N_FEATURES)


def term_counts(w: Stored) -> DataFrame:
    return w.counts


def vocabulary(w: Stored) -> DataFrame:
    return w.terms.select("term", "term_id", "tf", "df")


def _extra_counts(w: Stored) -> DataFrame:
    """Every turn of a conversation as one more text to learn terms from."""
    turns = w.lake.table("conversations").select(
        F.lit("extra").alias("side"),
        F.concat(F.lit("conversations__"), F.col("conv_id").cast("string")).alias("table_name"),
        F.col("turn").cast("int").alias("col_pos"), F.lit(1).alias("rn"), F.col("text").alias("value"))
    return features.term_counts(_parted(turns, "value", COLUMN), english_stop_words(), (1, 2))


def vocabulary_extra(w: Stored) -> DataFrame:
    return features.vocabulary(w.counts, N_FEATURES, [_extra_counts(w)]).select(
        "term", "term_id", "tf", "df")


def idf_weights(w: Stored) -> DataFrame:
    return _round(w.terms.select("term", "df", "idf"), "idf")


def count_vectors(w: Stored) -> DataFrame:
    return _round(w.count, "weight")


def tfidf_vectors(w: Stored) -> DataFrame:
    return _round(w.tfidf.filter(F.col("side") == LAKE), "weight")


def query_vectors(w: Stored) -> DataFrame:
    return _round(w.tfidf.filter(F.col("side") == QUERY), "weight")


def unit_counts(w: Stored) -> DataFrame:
    hashed = features.unit_counts(w.hash).withColumn("method", F.lit("hash"))
    counted = features.unit_counts(w.count).withColumn("method", F.lit("count"))
    return hashed.unionByName(counted)


def encode_texts_query(w: Stored) -> DataFrame:
    units = texts.encoder_column_texts(w.lake.cells, w.lake.meta, 20)
    encoded = encode_texts(units, HashedWords())
    return _round(encoded.select(*TABLE, "unit_id", F.posexplode("vec").alias("pos", "x")), "x")


# pooling, search, matching

def _pooled(agg: str) -> Callable[[Stored], DataFrame]:
    return lambda w: _round(pooling.table_vectors(w.hash, agg), "weight")


def dense_table_vectors(w: Stored) -> DataFrame:
    pooled = pooling.dense_table_vectors(w.lake.table("embeddings"), "mean", ["label"], "embedding")
    return _round(pooled.select("label", F.posexplode("vec").alias("pos", "x")), "x")


def cosine_pairs(w: Stored) -> DataFrame:
    queries = search.valid_queries(w.lake.gt, search.pool_names(w.pooled_hash))
    return search.cosine_pairs(w.pooled_hash, queries)


def dense_cosine(w: Stored) -> DataFrame:
    """Every embedding against the mean of its label; there are few labels."""
    table = w.lake.table("embeddings")
    means = pooling.dense_table_vectors(table, "mean", ["label"], "embedding")
    return table.join(means, "label").select(
        "vec_id", F.round(V.cosine(F.col("embedding"), F.col("vec")), 6).alias("score"))


def candidate_pool(w: Stored) -> DataFrame:
    searched = search.candidate_pool(w.hash, QUERY).withColumnRenamed("side", "searched_side")
    matched = search.candidate_pool(w.hash, LAKE).withColumnRenamed("side", "matched_side")
    return searched.join(matched, "table_name")


def _top_k(method: str, exclude_self: bool = False) -> Callable[[Stored], DataFrame]:
    def query(w: Stored) -> DataFrame:
        pooled = cut(search.pool_vectors(pooling.table_vectors(getattr(w, method), "max")))
        return search.pooled_top_k(pooled, w.lake.gt, K, exclude_self)

    return query


def topk_excluding_self(w: Stored) -> DataFrame:
    return w.ranked


def unionable_topk_encoder(w: Stored) -> DataFrame:
    vectors = ranking.dense_vectors(w.lake.cells, w.lake.meta, ENCODER)
    return ranking.rank_dense(vectors, w.lake.gt, "mean", K)


def dense_topk(w: Stored) -> DataFrame:
    vectors = w.lake.table("embeddings").select(
        F.col("vec_id").cast("string").alias("query_table"), F.col("embedding").alias("vec"))
    return search.dense_top_k(vectors, vectors.withColumnRenamed("query_table", "cand_table"), K,
                              exclude_self=True)


def column_pair_similarity(w: Stored) -> DataFrame:
    return _round(w.edges, "sim")


def bipartite_score(w: Stored) -> DataFrame:
    return matching.bipartite_scores(w.edges)


def bipartite_topk(w: Stored) -> DataFrame:
    return matching.bipartite_top_k(w.hash, w.lake.gt, K, 0.1)


def _encoded(w: Stored) -> DataFrame:
    return cut(ranking.dense_vectors(w.lake.cells, w.lake.meta, ENCODER))


def dense_column_pairs(w: Stored) -> DataFrame:
    vectors = _encoded(w)
    marks = matching.dense_marks(vectors)
    return _round(matching.dense_column_pairs(
        vectors, matching.query_sides(w.lake.gt, marks), search.candidate_pool(marks, LAKE), 0.1), "sim")


def bipartite_topk_encoder(w: Stored) -> DataFrame:
    return ranking.rank_dense(_encoded(w), w.lake.gt, "None", K, threshold=0.1)


def valid_queries(w: Stored) -> DataFrame:
    """Ground-truth queries with a vector, numbered in sampling order."""
    queries = search.valid_queries(w.lake.gt, search.pool_names(w.hash))
    sample = search.sample_queries(queries, 5).withColumn("sampled", F.lit(1))
    return queries.join(sample, "query_table", "left").fillna(0, ["sampled"])


def gt_filtered(w: Stored) -> DataFrame:
    return prep.keep_queries(w.lake.gt, w.lake.query_names)


# metrics

def running_hits(w: Stored) -> DataFrame:
    return metrics.running_hits(w.ranked, w.lake.gt).select(
        "query_table", "cand_table", "rank", "hit", "hits")


def _per_query(w: Stored) -> DataFrame:
    return metrics.metrics_per_query(w.ranked, w.lake.gt, K)


def metrics_per_query(w: Stored) -> DataFrame:
    return _round(_per_query(w), "p", "r", "f1", "ap")


def metrics_at_k(w: Stored) -> DataFrame:
    return _round(metrics.metrics_at_k(_per_query(w)), "p", "r", "f1", "map")


def ranking_detail(w: Stored) -> DataFrame:
    return metrics.ranking_detail(w.ranked, w.lake.gt)


# overlap

PAIR_NUMBERS = ["overlap_coefficient", "jaccard"]
STATS = ["mean", "median", "std", "min", "max", "q1", "q3", "iqr", "p10", "p90"]


def overlap_pairs(w: Stored) -> DataFrame:
    return w.overlap.pairs


def candidate_resolution(w: Stored) -> DataFrame:
    return w.overlap.resolved


def typed_value_sets(w: Stored) -> DataFrame:
    """Of all tables, in a pair or not."""
    types = cut(typing.nonempty_columns(typing.column_types(w.lake.cells, w.lake.meta)))
    return overlap.value_sets_by_type(
        overlap.typed_value_sets(w.lake.cells, types, w.lake.n_columns))


def column_overlap(w: Stored) -> DataFrame:
    return _round(w.overlap.columns, *PAIR_NUMBERS).withColumn(
        "common_columns", F.array_join("common_columns", "|"))


def value_overlap(w: Stored) -> DataFrame:
    return _round(w.overlap.values, *PAIR_NUMBERS)


def value_overlap_by_type(w: Stored) -> DataFrame:
    return _round(w.overlap.values_by_type, *PAIR_NUMBERS)


def overlap_histogram(w: Stored) -> DataFrame:
    return _round(w.overlap.histograms(), "percentage")


def overlap_histogram_by_type(w: Stored) -> DataFrame:
    return _round(w.overlap.histograms_by_type(), "percentage")


def overlap_stats(w: Stored) -> DataFrame:
    return _round(w.overlap.stats(), *STATS)


def overlap_by_query(w: Stored) -> DataFrame:
    return _round(w.overlap.by_query(), *STATS)


def overlap_summary(w: Stored) -> DataFrame:
    return _round(w.overlap.summary().drop("requested_queries"), "avg_candidates")


def overlap_summary_listed(w: Stored) -> DataFrame:
    """The counters for a list of queries: all lake tables, few of which are queries."""
    listed = w.lake.meta.filter(F.col("side") == LAKE).select(
        F.col("table_name").alias("query_table")).distinct()
    report = OverlapReport(w.lake.cells, w.lake.meta, w.lake.gt, listed)
    return _round(report.summary(), "avg_candidates")


# profile

def profile_dedup(w: Stored) -> DataFrame:
    return profile.without_duplicates(w.stats).select(*COLUMN, "col_name", "n_rows", "n_values")


def _tables(w: Stored) -> DataFrame:
    return profile.table_sizes(profile.without_duplicates(w.stats))


def profile_sizes(w: Stored) -> DataFrame:
    return profile.profile_sizes(_tables(w))


def profile_missing(w: Stored) -> DataFrame:
    return profile.profile_missing(_tables(w))


def profile_averages(w: Stored) -> DataFrame:
    return profile.profile_averages(_tables(w))


def profile_column_types(w: Stored) -> DataFrame:
    return profile.profile_column_types(w.profile.columns)


def profile_unique_columns(w: Stored) -> DataFrame:
    return profile.profile_unique_columns(profile.without_duplicates(w.lake.meta))


def profile_combined(w: Stored) -> DataFrame:
    return profile.profile_combined(cut(profile.without_duplicates(w.stats)))


# preparation and experiments

def prep_referenced(w: Stored) -> DataFrame:
    return prep.keep_referenced(prep.table_names(w.lake.meta), w.lake.gt)


def prep_gt_present(w: Stored) -> DataFrame:
    return prep.keep_present(w.lake.gt, prep.table_names(w.lake.meta))


def prep_add_self(w: Stored) -> DataFrame:
    """Own candidates added to a ground truth from which they were taken out."""
    others = w.lake.gt.filter(F.col("query_table") != F.col("cand_table"))
    return prep.add_self(others)


def prep_truncate(w: Stored) -> DataFrame:
    return prep.truncate_tables(w.lake.cells, 1000, w.lake.n_columns)


def prep_sample_queries(w: Stored) -> DataFrame:
    return prep.sample_query_tables(w.lake.meta, 5)


def grid_metrics(w: Stored) -> DataFrame:
    """Mean metrics of every valid combination of a small grid over all methods.

    The ground truth also names a lake table as a query, which is no query.
    """
    grid = {
        "hash": {"embedding_params": {"sample_size": [5, 1000], "n_features": [N_FEATURES],
                                      "include_column_names": [False]},
                 "eval_params": {"agg": ["max", "mean", "None"], "threshold": [0.1]}},
        **{method: {"embedding_params": {name: [value] for name, value in SPARSE[method].items()},
                    "eval_params": {"agg": ["max"]}} for method in ("count", "tfidf")},
        "encoder": {"embedding_params": {name: [value] for name, value in ENCODER.items()},
                    "eval_params": {"agg": ["mean", "None"], "threshold": [0.1]}},
    }
    jobs = experiments.expand_grid(grid)
    lake_only = w.lake.meta.filter(F.col("table_name") == "nation__all").select(
        F.col("table_name").alias("query_table"), F.lit("region__all").alias("cand_table")).distinct()
    result = experiments.grid_metrics(w.lake.cells, w.lake.meta, w.lake.gt.unionByName(lake_only), jobs, K,
                                      exclude_self=True)
    return _round(result.select(
        F.col("params")["method"].alias("method"),
        F.col("params")["sample_size"].cast("int").alias("sample_size"),
        F.col("params")["agg"].alias("agg"), "cutoff", "p", "r", "f1", "map"),
        "p", "r", "f1", "map")


def vector_store_delta(w: Stored) -> DataFrame:
    """Stored vectors of a lake that changed, and whether their table was worked through again.

    Before the change there were no events, other part keys, and a table that is gone now.
    """
    cells, meta = w.lake.cells, w.lake.meta
    gone = F.col("table_name") == "nation__all"

    def before(frame: DataFrame) -> DataFrame:
        return frame.filter(~F.col("table_name").startswith("events__")).unionByName(
            frame.filter(gone).withColumn("table_name", F.lit("gone__all")))

    other_keys = before(cells).withColumn("value", F.when(
        F.col("col_name") == "p_partkey", F.concat("value", F.lit("0"))).otherwise(F.col("value")))
    old, new = (other_keys, before(meta)), (cells, meta)
    old_prints, new_prints = cut(table_prints(*old)), cut(table_prints(*new))
    store = VectorStore(w.lake.spark, f"{shared_folder(w.lake.spark)}/vectors-{uuid.uuid4().hex}")
    found = []
    for method in ("hash", "tfidf"):
        params = ranking.full_params(method, SPARSE[method])
        stored_vectors.refreshed_vectors(store, "carved", method, params, *old, prints=old_prints)
        was = store.table_versions("carved", method, params).select(*TABLE, F.col("version").alias("was"))
        vectors, _ = stored_vectors.refreshed_vectors(store, "carved", method, params, *new, prints=new_prints)
        # one row per table
        versions = store.table_versions("carved", method, params).join(was, TABLE, "left").select(
            *TABLE, (~F.col("version").eqNullSafe(F.col("was"))).alias("rebuilt"))
        found.append(vectors.join(versions, TABLE).withColumn("method", F.lit(method)))
    return _round(found[0].unionByName(found[1]), "weight").select("method", *COLUMN, "dim", "weight", "rebuilt")


def stored_runs(w: Stored) -> DataFrame:
    """Records read back of a run that stopped after its first job and went on with two jobs at once."""
    spark = w.lake.spark
    folder = f"{shared_folder(spark)}/runs-{uuid.uuid4().hex}"
    vectors, results = VectorStore(spark, f"{folder}/vectors"), ResultStore(f"{folder}/results")
    jobs = [experiments.Job(method, SPARSE[method], {"agg": "max"}) for method in ("hash", "count", "tfidf")]
    args = (spark, "carved", w.lake.cells, w.lake.meta, w.lake.gt)
    run = experiments.run_jobs(*args, jobs[:1], vectors, results, K, exclude_self=True)
    experiments.run_jobs(*args, jobs, vectors, results, K, exclude_self=True, run=run, workers=2)
    told = results.runs(spark).select(
        "method", "status", F.col("embedding_params")["sample_size"].cast("int").alias("sample_size"),
        F.col("eval_params")["agg"].alias("agg"), F.inline("metrics"))
    return _round(told.withColumn("cutoff", F.col("cutoff").cast("int")), "p", "r", "f1", "map")


QUERIES: dict[str, Callable[[Stored], DataFrame]] = {
    "lake_cells": lake_cells,
    "parquet_lake_cells": parquet_lake_cells,
    "csv_lake_cells": csv_lake_cells,
    "parquet_column_types": parquet_column_types,
    "disambiguated_headers": disambiguated_headers,
    "empty_tables": empty_tables,
    "query_selection": query_selection,
    "ground_truth_edges": ground_truth_edges,
    "value_type_histogram": value_type_histogram,
    "column_types": column_types,
    "nonempty_columns": nonempty_columns,
    "column_sample": column_sample,
    "distinct_sample": distinct_sample,
    "row_sample": row_sample,
    "column_texts": column_texts,
    "encoder_column_texts": encoder_column_texts,
    "encoder_column_texts_plain": encoder_column_texts_plain,
    "row_texts": row_texts,
    "header_texts": header_texts,
    "tokens_hash": tokens_hash,
    "tokens_word": tokens_word,
    "stopword_filter": stopword_filter,
    "word_ngrams": word_ngrams,
    "hashing_tf": hashing_tf,
    "term_counts": term_counts,
    "vocabulary": vocabulary,
    "vocabulary_extra": vocabulary_extra,
    "idf_weights": idf_weights,
    "count_vectors": count_vectors,
    "tfidf_vectors": tfidf_vectors,
    "query_vectors": query_vectors,
    "unit_counts": unit_counts,
    "encode_texts": encode_texts_query,
    "table_vectors_max": _pooled("max"),
    "table_vectors_mean": _pooled("mean"),
    "table_vectors_sum": _pooled("sum"),
    "dense_table_vectors": dense_table_vectors,
    "cosine_pairs": cosine_pairs,
    "dense_cosine": dense_cosine,
    "candidate_pool": candidate_pool,
    "unionable_topk_hash": _top_k("hash"),
    "unionable_topk_count": _top_k("count"),
    "unionable_topk_tfidf": _top_k("tfidf"),
    "unionable_topk_encoder": unionable_topk_encoder,
    "topk_excluding_self": topk_excluding_self,
    "dense_topk": dense_topk,
    "column_pair_similarity": column_pair_similarity,
    "bipartite_score": bipartite_score,
    "bipartite_topk": bipartite_topk,
    "dense_column_pairs": dense_column_pairs,
    "bipartite_topk_encoder": bipartite_topk_encoder,
    "valid_queries": valid_queries,
    "gt_filtered": gt_filtered,
    "running_hits": running_hits,
    "metrics_per_query": metrics_per_query,
    "metrics_at_k": metrics_at_k,
    "ranking_detail": ranking_detail,
    "overlap_pairs": overlap_pairs,
    "candidate_resolution": candidate_resolution,
    "typed_value_sets": typed_value_sets,
    "column_overlap": column_overlap,
    "value_overlap": value_overlap,
    "value_overlap_by_type": value_overlap_by_type,
    "overlap_histogram": overlap_histogram,
    "overlap_histogram_by_type": overlap_histogram_by_type,
    "overlap_stats": overlap_stats,
    "overlap_by_query": overlap_by_query,
    "overlap_summary": overlap_summary,
    "overlap_summary_listed": overlap_summary_listed,
    "profile_dedup": profile_dedup,
    "profile_sizes": profile_sizes,
    "profile_missing": profile_missing,
    "profile_averages": profile_averages,
    "profile_column_types": profile_column_types,
    "profile_unique_columns": profile_unique_columns,
    "profile_combined": profile_combined,
    "prep_referenced": prep_referenced,
    "prep_gt_present": prep_gt_present,
    "prep_add_self": prep_add_self,
    "prep_truncate": prep_truncate,
    "prep_sample_queries": prep_sample_queries,
    "grid_metrics": grid_metrics,
    "vector_store_delta": vector_store_delta,
    "stored_runs": stored_runs,
}


def run(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES[name](stored(carved_lake(spark, sf_dir)))
