"""Vectors of a lake kept between its versions: only tables that changed are worked through again."""

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablekin.functions.encoders import HashedWords, encode_texts
from tablekin.functions.frames import cut, join_small
from tablekin.functions.text import english_stop_words
from tablekin.operators import features
from tablekin.plans.ranking import encoder_texts, full_params
from tablekin.schema import TABLE
from tablekin.sources.vector_store import VectorStore, table_prints


def _of(frame: DataFrame, tables: DataFrame | None, n: int, spread: list[str]) -> DataFrame:
    """Rows of the given tables; of all where that is None."""
    return frame if tables is None else join_small(frame, tables, TABLE, n, spread)


def refreshed_vectors(store: VectorStore, lake: str, method: str, params: dict[str, Any], cells: DataFrame,
                      columns_meta: DataFrame, encoder: Callable | None = None,
                      prints: DataFrame | None = None) -> tuple[DataFrame, int]:
    """The vectors of ``sparse_vectors`` or ``dense_vectors``, and how many tables were built.

    Hashed and encoded vectors depend on their own table. Counted ones also depend on the terms of the
    lake: term counts are kept table by table, the terms are chosen from all of them each time, and if they
    or their weights are others than before, all vectors are made again from the kept counts.
    """
    params = full_params(method, params, encoder)
    prints = cut(table_prints(cells, columns_meta)) if prints is None else prints

    def values(tables: DataFrame | None, n: int) -> DataFrame:
        return features.column_values(
            _of(cells, tables, n, ["col_pos", "row_id"]), _of(columns_meta, tables, n, ["col_pos"]),
            params["sample_size"], params["include_column_names"])

    if method == "hash":
        return store.refresh(lake, method, params, prints, lambda tables, n: features.hash_vectors(
            values(tables, n), params["n_features"]))
    if method == "encoder":
        return store.refresh(lake, method, params, prints, lambda tables, n: encode_texts(
            encoder_texts(_of(cells, tables, n, ["col_pos", "row_id"]), _of(columns_meta, tables, n, ["col_pos"]),
                          params), encoder or HashedWords(), params["batch_size"]))

    stop_words = params.get("stop_words")
    stop_words = english_stop_words() if stop_words is None else stop_words
    counted = {name: params[name] for name in ("sample_size", "include_column_names", "ngram_range")}
    counts, n_counted = store.refresh(
        lake, "terms", {**counted, "stop_words": stop_words}, prints,
        lambda tables, n: features.term_counts(values(tables, n), stop_words, tuple(params["ngram_range"])))
    terms = features.vocabulary(counts, params["max_features"])
    if method == "tfidf":
        terms = features.idf_weights(terms, features.text_count(columns_meta))
    terms = cut(terms)
    known = ["term", "term_id"] + ["idf"] * (method == "tfidf")
    shared = terms.agg(F.concat_ws(":", F.count("*"), F.hex(F.bit_xor(F.xxhash64(*known))))).first()[0]
    weigh = features.count_vectors if method == "count" else features.tfidf_vectors
    vectors, n_built = store.refresh(
        lake, method, params, prints, lambda tables, n: weigh(
            _of(counts, tables, n, ["col_pos", "term"]), terms, _of(columns_meta, tables, n, ["col_pos"])), shared)
    return vectors, max(n_counted, n_built)
