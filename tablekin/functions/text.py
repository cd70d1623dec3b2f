"""Tokens and word n-grams of texts."""

from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import Column
from pyspark.sql import functions as F

WORD_CLASS = r"[\p{L}\p{N}_]"


def word_tokens(text: Column, min_chars: int = 1) -> Column:
    """Lower-case words of at least ``min_chars`` characters, in text order."""
    pattern = WORD_CLASS + ("+" if min_chars == 1 else "{%d,}" % min_chars)
    return F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(0))


def english_stop_words() -> list[str]:
    """Spark's English list, the default; any other list can be given instead."""
    return StopWordsRemover.loadDefaultStopWords("english")


def without_stop_words(tokens: Column, stop_words: list[str]) -> Column:
    if not stop_words:
        return tokens
    # isin over literals becomes one hash-set probe per token
    return F.filter(tokens, lambda token: ~token.isin(stop_words))


def ngrams(words: Column, n_before: Column, low: int, high: int) -> Column:
    """All n-grams of ``low`` to ``high`` words that end after the first ``n_before`` words.

    ``words`` should be a plain column. The grams of each length are those one shorter,
    zipped with the words that follow them.
    """
    size = F.size(words)
    lengths = []
    grams = words
    for n in range(1, high + 1):
        if n > 1:
            count = F.greatest(size - (n - 1), F.lit(0))
            grams = F.zip_with(F.slice(grams, 1, count), F.slice(words, n, count),
                               lambda gram, word: F.concat_ws(" ", gram, word))
        if n >= low:
            first = F.greatest(n_before - (n - 2), F.lit(1))
            lengths.append(F.slice(grams, first, size))
    return lengths[0] if len(lengths) == 1 else F.concat(*lengths)


def hash_bucket(token: Column, n_features: int) -> Column:
    """Feature number of a token: its md5 prefix modulo the number of features."""
    prefix = F.conv(F.substring(F.md5(token), 1, 8), 16, 10).cast("bigint")
    return F.pmod(prefix, F.lit(n_features)).cast("int")
