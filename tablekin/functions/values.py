"""Cell values: missing tokens, value classes, numeric text and set keys."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Texts a CSV reader takes as missing (the documented pandas default list).
NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

# How the text of an integer, a decimal and a number of any notation looks.
INTEGER_PATTERN = r"^\s*[-+]?\p{Nd}+\s*$"
FLOAT_PATTERN = r"^\s*[-+]?\p{Nd}+\.\p{Nd}+\s*$"
LETTER_PATTERN = r"\p{L}"
BLANK_PATTERN = r"^\s*$"
INTEGER_TEXT = r"^\s*[-+]?[0-9]+\s*$"
NUMBER_TEXT = r"^\s*[-+]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][-+]?[0-9]+)?\s*$"
INFINITY_TEXT = r"(?i)^\s*[-+]?inf(inity)?\s*$"

UINT64_MAX = "18446744073709551615"


def null_if_missing(value: Column) -> Column:
    """The value, or null where a CSV reader would see a missing cell."""
    return F.when(~value.isin(NA_TOKENS), value)


def strip_csv(name: Column) -> Column:
    """A table name without any ``.csv``."""
    return F.regexp_replace(name, r"\.csv", "")


def plain_look(value: Column) -> Column:
    """integer, float, string or other where that shows without a pattern, else null.

    An integer or a date as Spark would write it; a decimal of such an integer, a point and up to 15 digits; a text that
    starts with an ASCII letter, other than those infinity starts with. ``value_class`` says the same of
    all of these. All integers are 64-bit ones; strings and others are no numbers.
    """
    whole, fraction = F.substring_index(value, ".", 1), F.concat(F.lit("1"), F.substring_index(value, ".", -1))

    def written(text: Column, kind: str) -> Column:
        return text.try_cast(kind).cast("string") == text

    letter = ((value >= "A") & (value < "[")) | ((value >= "a") & (value < "{"))
    first_of_infinity = value.startswith("i") | value.startswith("I")
    decimal = (F.length(whole) + F.length(fraction) == F.length(value)) & (F.length(fraction).between(2, 16))
    # a cast that fails costs more than a pattern, so each is tried on what is likely to be of its kind
    return (
        F.when(letter, F.when(~first_of_infinity, "string"))
        .when(value >= ":", None)
        .when(value.contains("."), F.when(decimal & written(whole, "bigint") & written(fraction, "bigint"), "float"))
        .when((F.length(value) == 10) & value.contains("-") & ~value.startswith("-"), F.when(written(value, "date"), "other"))
        .when((value >= "-") & (F.length(value) < 20), F.when(written(value, "bigint"), "integer"))
    )


def value_class(value: Column) -> Column:
    """null, integer, float, string or other, by the look of one value."""
    return (
        F.when(value.isNull() | value.rlike(BLANK_PATTERN), "null")
        .when(value.rlike(INTEGER_PATTERN), "integer")
        .when(value.rlike(FLOAT_PATTERN), "float")
        .when(value.rlike(LETTER_PATTERN), "string")
        .otherwise("other")
    )


def _squeezed(value: Column) -> Column:
    # the patterns allow blanks at the ends only
    return F.btrim(value, F.lit(" \t\n\x0b\f\r"))


def as_long(value: Column) -> Column:
    """The value as a 64-bit integer, null if it is not the text of one."""
    return F.when(value.rlike(INTEGER_TEXT), _squeezed(value).try_cast("bigint"))


def is_uint64(value: Column) -> Column:
    number = F.when(value.rlike(INTEGER_TEXT), _squeezed(value).try_cast("decimal(38,0)"))
    return F.coalesce(number.between(F.lit("0").cast("decimal(38,0)"),
                                     F.lit(UINT64_MAX).cast("decimal(38,0)")), F.lit(False))


def as_double(value: Column) -> Column:
    """The value as a double, null if a CSV reader would keep it as text.

    Integers beyond 64 bits and decimals beyond the range of a double stay text.
    """
    number = _squeezed(value).try_cast("double")
    infinite = F.abs(number) == F.lit(float("inf"))
    return (
        F.when(value.rlike(INTEGER_TEXT), as_long(value).cast("double"))
        .when(value.rlike(NUMBER_TEXT), F.when(~infinite, number))
        .when(value.rlike(INFINITY_TEXT),
              F.when(value.rlike(r"^\s*-"), F.lit(float("-inf"))).otherwise(F.lit(float("inf"))))
    )


def number_text(number: Column) -> Column:
    """Text of a double that is equal for an integer and a float of the same value.

    Whole numbers a 64-bit integer can hold are written without a fraction.
    """
    whole = (number == F.floor(number)) & (F.abs(number) < F.lit(9.2e18))
    return F.when(whole, number.cast("bigint").cast("string")).otherwise(number.cast("string"))


def float_key(value: Column, look: Column) -> Column:
    """``number_text`` of the value to 8 decimals; ``look`` is its ``plain_look``.

    Of at most 15 digits, 8 of them decimals, a double keeps all: nothing is to be rounded, and an integer is its own text.
    """
    short = F.length(value) <= 15
    few = short & (F.length(F.substring_index(value, ".", -1)) <= 8)
    return (
        F.when((look == "integer") & short, value)
        .when((look == "float") & few, number_text(value.try_cast("double")))
        .otherwise(number_text(F.round(as_double(value), 8)))
    )
