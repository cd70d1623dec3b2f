"""From cells to rankings: vectors of one method, search, scores."""

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablekin.functions.encoders import HashedWords, encode_texts, encoder_name
from tablekin.functions.frames import cut
from tablekin.functions.text import english_stop_words
from tablekin.operators import features
from tablekin.operators.matching import bipartite_top_k, dense_bipartite_top_k, dense_marks
from tablekin.operators.pooling import dense_table_vectors, table_vectors
from tablekin.operators.search import (
    candidate_pool,
    dense_top_k,
    pool_vectors,
    pooled_top_k,
    valid_queries,
)
from tablekin.operators.texts import (
    ENCODER_CHARS,
    encoder_column_texts,
    header_texts,
    row_texts,
)
from tablekin.schema import TABLE

# What a method takes for parameters that are not given.
DEFAULTS: dict[str, dict[str, Any]] = {
    "hash": {"sample_size": 5, "n_features": 1024, "include_column_names": False},
    "count": {"sample_size": 5, "max_features": 1024, "ngram_range": (1, 1),
              "include_column_names": True},
    "tfidf": {"sample_size": 5, "max_features": 1024, "ngram_range": (1, 2),
              "include_column_names": True},
    "encoder": {"sample_size": 10, "orientation": "vertical", "include_names": True,
                "names_only": False, "deduplicate": True, "batch_size": 256,
                "max_chars": ENCODER_CHARS},
}


def with_defaults(method: str, params: dict[str, Any]) -> dict[str, Any]:
    if method not in DEFAULTS:
        raise ValueError(f"no such method: {method}")
    return {**DEFAULTS[method], **params}


def full_params(method: str, params: dict[str, Any], encoder: Callable | None = None) -> dict[str, Any]:
    """All parameters that vectors depend on, those not given and the encoder included.

    An encoder may have a ``name`` and a length limit ``max_chars``; without a name it goes
    by its class or function and what it holds.
    """
    if method != "encoder":
        return with_defaults(method, params)
    encoder = encoder or HashedWords()
    own = {"encoder": encoder_name(encoder)}
    if hasattr(encoder, "max_chars"):
        own["max_chars"] = encoder.max_chars
    return {**with_defaults(method, own), **params}


def sparse_vectors(cells: DataFrame, columns_meta: DataFrame, method: str,
                   params: dict[str, Any], extra: tuple[DataFrame, ...] = ()) -> DataFrame:
    """Column vectors of lake and queries by the hash, count or tfidf method.

    Terms come from the lake alone, and from the ``extra`` term counts if given.
    """
    params = with_defaults(method, params)
    values = features.column_values(cells, columns_meta, params["sample_size"],
                                    params["include_column_names"])
    if method == "hash":
        return features.hash_vectors(values, params["n_features"])
    stop_words = params.get("stop_words")
    counts = cut(features.term_counts(
        values, english_stop_words() if stop_words is None else stop_words,
        tuple(params["ngram_range"])))
    terms = features.vocabulary(counts, params["max_features"], extra)
    if method == "count":
        return features.count_vectors(counts, terms, columns_meta)
    weighted = features.idf_weights(terms, features.text_count(columns_meta, extra))
    return features.tfidf_vectors(counts, weighted, columns_meta)


def encoder_texts(cells: DataFrame, columns_meta: DataFrame, params: dict[str, Any]) -> DataFrame:
    """``side, table_name, unit_id, text``: columns, or rows, or headers as texts."""
    params = with_defaults("encoder", params)
    names, names_only, chars = params["include_names"], params["names_only"], params["max_chars"]
    if names_only and not names:
        raise ValueError("names_only needs include_names")
    if params["orientation"] == "vertical":
        return encoder_column_texts(cells, columns_meta, params["sample_size"], names, names_only,
                                    params["deduplicate"], chars)
    if names_only:
        return header_texts(cells, columns_meta, chars)
    return row_texts(cells, columns_meta.count(), params["sample_size"], names, chars)


def dense_vectors(cells: DataFrame, columns_meta: DataFrame, params: dict[str, Any],
                  encoder: Callable | None = None) -> DataFrame:
    """``side, table_name, unit_id, vec`` by an encoder."""
    params = full_params("encoder", params, encoder)
    texts = encoder_texts(cells, columns_meta, params)
    return encode_texts(texts, encoder or HashedWords(), params["batch_size"])


def rank_sparse(vectors: DataFrame, gt: DataFrame, agg: str, k: int = 10,
                exclude_self: bool = False, threshold: float | None = None) -> DataFrame:
    """Ranking by pooled vectors, or by column matching where ``agg`` is None or 'None'."""
    if agg in (None, "None"):
        if threshold is None:
            raise ValueError("matching needs a threshold")
        return bipartite_top_k(vectors, gt, k, threshold, exclude_self)
    pooled = cut(pool_vectors(table_vectors(vectors, agg)))
    return pooled_top_k(pooled, gt, k, exclude_self)


def rank_dense(vectors: DataFrame, gt: DataFrame, agg: str, k: int = 10,
               exclude_self: bool = False, threshold: float | None = None) -> DataFrame:
    """Ranking by pooled dense vectors, or by column matching where ``agg`` is None or 'None'.

    A query's pooled vector replaces its lake copy.
    """
    if agg in (None, "None"):
        if threshold is None:
            raise ValueError("matching needs a threshold")
        return dense_bipartite_top_k(cut(vectors), gt, k, threshold, exclude_self)
    pooled = cut(dense_table_vectors(vectors, agg, TABLE))
    pool = candidate_pool(dense_marks(pooled))
    candidates = pooled.join(pool, ["side", "table_name"]).select(
        F.col("table_name").alias("cand_table"), "vec")
    queries = candidates.withColumnRenamed("cand_table", "query_table").join(
        valid_queries(gt, pool), "query_table", "left_semi")
    return dense_top_k(queries, candidates, k, exclude_self)
