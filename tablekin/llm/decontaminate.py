"""Benchmark decontamination with DataFrame functions only.

Windows of benchmark words are hashed and broadcast; one scan makes every window of every
document beside them, in generated code, and verifies the words of each hash that meets.

Words: A-Z in lower case, then runs of characters outside ASCII punctuation, blanks and control
characters. An item of fewer words than a window is one window. Null or empty texts have no words and
are never contaminated; items without words have no windows; items with a null id count as hits but are
not listed; repeated rows are judged one by one; equal item ids count once; other columns are ignored.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablekin.llm.common import KEY, ascii_lower, keyed, keyed_whole, without

WINDOW = 10
# windows of benchmark items in one broadcast table, some 200 MB at most; more take more scans
BLOCK_WINDOWS = 1_000_000
BETWEEN_WORDS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# the same in texts whose capitals are still there
RAW_BETWEEN_WORDS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
RAW_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def word_array(text: Column, between: str = BETWEEN_WORDS) -> Column:
    joined = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), between, " "))
    return F.filter(F.split(joined, " "), lambda word: word != "")


def _words(text: Column) -> Column:
    return word_array(ascii_lower(text))


def _window_hash(length: int) -> Column:
    return F.xxhash64(F.lit(length), *[F.get("words", F.col("pos") + k) for k in range(length)])


def _window_text(length: Column) -> Column:
    return F.array_join(F.slice("words", F.col("pos") + 1, length), " ")


def item_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(length, window) of all items with the list of items that hold it."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), _words(F.col("text")).alias("words"))
    length = F.least(F.size("words"), F.lit(window))
    return (
        items.filter(F.size("words") > 0)
        .select("item", "words", length.alias("length"),
                F.explode(F.sequence(F.lit(0), F.size("words") - length)).alias("pos"))
        .select("item", "length", _window_text(F.col("length")).alias("window"))
        .groupBy("length", "window").agg(F.array_sort(F.collect_set("item")).alias("items"))
    )


def find_hits(rows: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Of keyed rows: n_words, spans (pos, length) of verified windows in order, and items.

    The spans of a document come from one task, so they are gathered before the shuffle.
    """
    windows = item_windows(benchmark, window)
    sizes = windows.groupBy("length").agg(F.sum(F.size("items") + 1).alias("n")).collect()
    lengths = sorted(row["length"] for row in sizes)
    blocks = max(1, -(-sum(row["n"] for row in sizes) // BLOCK_WINDOWS))
    words = rows.select(KEY, "doc_id", _words(F.col("text")).alias("words"))
    n_words = F.size("words")
    # position -1 stands for the document itself, so that one scan also gives those without hits
    at = words.select(KEY, "doc_id", "words", F.explode(F.sequence(F.lit(-1), n_words - 1)).alias("pos"))
    fits = [F.when((F.col("pos") >= 0) & (F.col("pos") + n <= n_words),
                   F.struct(F.lit(n).alias("length"), _window_hash(n).alias("hash"))) for n in lengths]
    if not fits:
        fits = [F.lit(None).cast("struct<length:int,hash:bigint>")]
    made = at.withColumn("w", fits[0]) if len(fits) == 1 else at.withColumn(
        "w", F.explode(F.filter(F.array(*fits), lambda w: w.isNotNull() | (F.col("pos") < 0))))
    made = made.filter((F.col("pos") < 0) | F.col("w").isNotNull()).select(
        KEY, "doc_id", "words", "pos", F.col("w.length").alias("length"), F.col("w.hash").alias("hash"))
    window_words = F.split("window", " ")
    hashed = windows.select("window", "items", reduce(
        lambda rest, n: F.when(F.col("length") == n, F.xxhash64(
            F.lit(n), *[F.get(window_words, F.lit(k)) for k in range(n)])).otherwise(rest),
        lengths, F.lit(None).cast("bigint")).alias("known_hash"))
    parts = []
    for block in range(blocks):
        known = F.broadcast(hashed.filter(F.pmod("known_hash", F.lit(blocks)) == block))
        # words are compared only where hashes meet: in the join they would be made for all windows
        real = F.col("window") == _window_text(F.col("length"))
        parts.append(made.join(known, F.col("hash") == F.col("known_hash"), "left")
                     .filter((F.col("pos") < 0) | real)
                     .select(KEY, "doc_id", F.when(F.col("pos") < 0, n_words).alias("n"), "items",
                             F.when(F.col("pos") >= 0, F.struct("pos", "length")).alias("span")))
    return reduce(DataFrame.unionByName, parts).groupBy(KEY, "doc_id").agg(
        F.max("n").cast("long").alias("n_words"), F.array_sort(F.collect_list("span")).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))


def _covered(spans: str) -> Column:
    """Words under any of the sorted spans."""
    start = F.struct(F.lit(0).alias("hit"), F.lit(0).alias("upto"))

    def add(acc, span):
        end = span["pos"] + span["length"]
        return F.struct(
            (acc["hit"] + F.greatest(F.lit(0), end - F.greatest(span["pos"], acc["upto"]))).alias("hit"),
            F.greatest(acc["upto"], end).alias("upto"))

    return F.aggregate(spans, start, add, lambda acc: acc["hit"])


def report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of every document."""
    return find_hits(keyed(docs, "text"), benchmark, window).select(
        "doc_id", "n_words", _covered("spans").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents without a single benchmark window, all columns as they are."""
    rows = keyed_whole(docs)
    return without(rows, find_hits(rows, benchmark, window).filter(F.size("spans") > 0))


def cut_spans(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id and text, with the hit words and what follows each of them up to the next word removed."""
    rows = keyed(docs, "text")
    hits = find_hits(rows, benchmark, window).filter(F.size("spans") > 0).select(KEY, "spans")
    text = F.coalesce(F.col("text"), F.lit(""))
    words, between = word_array(text, RAW_BETWEEN_WORDS), F.split(text, RAW_WORD)
    kept = F.transform(words, lambda word, i: F.when(
        F.exists("spans", lambda s: (i >= s["pos"]) & (i < s["pos"] + s["length"])), F.lit("")
    ).otherwise(F.concat(word, F.get(between, i + 1))))
    cleaned = F.concat(F.get(between, F.lit(0)), F.array_join(kept, ""))
    return rows.join(hits, KEY, "left").select(
        "doc_id", F.when(F.col("spans").isNull(), F.col("text")).otherwise(cleaned).alias("text"))
