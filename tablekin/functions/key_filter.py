"""A Bloom filter of join keys as a small frame, to drop rows before they are shuffled."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablekin.functions.frames import BROADCAST_ROWS

BITS = 64  # a filter is words of so many bits; a key sets three of one word
KEYS_PER_WORD = 6  # aimed at: some 3 % of other keys pass
MOST_KEYS_PER_WORD = 32  # beyond that nearly all pass


def _word(key: str, n_words: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(n_words))


def _mask(key: str) -> Column:
    """Three bits, from a hash of its own."""
    bits = F.xxhash64(F.col(key), F.lit(1))
    places = [F.shiftrightunsigned(bits, shift).bitwiseAND(F.lit(BITS - 1)).cast("int") for shift in (0, 6, 12)]
    # shiftleft takes the number of places as a literal only in the API, as a column in SQL
    made = [F.call_function("shiftleft", F.lit(1).cast("long"), place) for place in places]
    return made[0].bitwiseOR(made[1]).bitwiseOR(made[2])


def only_known(rows: DataFrame, key: str, known: DataFrame, n_known: int,
               max_words: int = BROADCAST_ROWS) -> DataFrame:
    """``rows`` without most of those whose ``key`` (a text) is not among the ``n_known`` of ``known``.

    No row with a known key is lost; null keys are. The filter has one row a word, so at most
    ``max_words`` are broadcast. Where so many keys are known that nearly all would pass, the
    rows come back as they are.
    """
    n_words = min(max_words, n_known // KEYS_PER_WORD + 1)
    if n_known > n_words * MOST_KEYS_PER_WORD:
        return rows
    words = known.filter(F.col(key).isNotNull()).groupBy(_word(key, n_words).alias("_word")).agg(
        F.bit_or(_mask(key)).alias("_bits"))
    return (
        rows.filter(F.col(key).isNotNull()).withColumn("_word", _word(key, n_words))
        .join(F.broadcast(words), "_word")
        .filter(F.col("_bits").bitwiseAND(_mask(key)) == _mask(key))
        .select(*rows.columns)
    )
