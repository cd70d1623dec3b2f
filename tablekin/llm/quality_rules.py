"""Quality rules as a decision list learned by sequential covering.

Statistics of every text are counted in Arrow batches. From labelled rows, rules for low quality are
grown one after another (threshold conditions by information gain), pruned on rows held back, and
kept while they are precise there. The list becomes one ordered Spark conditional
expression, so that its verdict is as readable as a hand-written filter.

Words are runs of characters outside ASCII white space. Null and empty texts have no words and
fail the base rules (fewer than 20 words, or over 30 % of words in repeated 8-word windows). Repeated rows are
judged one by one, rows without a label or with a null one are not learned from, several
labels of a document count as the lowest, other columns are ignored. Without labels of both kinds the
list is empty and the base rules decide alone.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablekin.llm.common import KEY, keyed_whole, labelled_sample, released, shipped, without

shipped(__name__)

# fixed values of the base rules
MIN_WORDS, MAX_REPEATED_PERCENT, RUN = 20, 30, 8
SYMBOLS = b"#*$%&|<>"
SPACE = b" \t\n\v\f\r"

SAMPLE_ROWS = 20_000  # labelled rows learned from, at most
MAX_RULES, MAX_CONDITIONS, THRESHOLDS = 12, 4, 64
MIN_PRECISION, MIN_COVERED = 0.7, 5

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_distinct", "n_lines",
          "n_digits", "n_upper", "longest"]
STATISTICS = f"{KEY} long, doc_id long, " + ", ".join(f"{name} long" for name in COUNTS)


def repeated_words(words: list[bytes], run: int = RUN) -> int:
    """Words inside windows of ``run`` (a power of two) words that occur twice or more."""
    n = len(words)
    if n <= run:
        return 0
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(word, len(known)) for word in words), np.int64, n)
    width = 1
    while width < run:
        pairs = ids[:-width] * n + ids[width:]
        _, ids, counts = np.unique(pairs, return_inverse=True, return_counts=True)
        if counts.max() == 1:
            return 0
        width *= 2
    edge = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(counts[ids] > 1)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + run, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def statistics(text: str | None) -> tuple[int, ...]:
    """The numbers named in COUNTS."""
    text = text or ""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    lines = [line for line in data.split(b"\n") if line.strip()]
    chars = len(text) - (len(data) - len(data.translate(None, SPACE)))
    digits = len(data) - len(data.translate(None, b"0123456789"))
    upper = len(data) - len(data.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    symbols = len(data) - len(data.translate(None, SYMBOLS))
    return (len(words), chars, symbols, len(lines) - len(set(lines)), repeated_words(words), len(set(words)),
            len(lines), digits, upper, max(map(len, words), default=0))


def _counted(batches):
    for batch in batches:
        rows = [statistics(text.as_py()) for text in batch.column("text")]
        yield pa.RecordBatch.from_arrays(
            [batch.column(KEY), batch.column("doc_id"), *[pa.array([row[i] for row in rows], pa.int64()) for i in range(len(COUNTS))]],
            [KEY, "doc_id", *COUNTS])


def text_statistics(docs: DataFrame) -> DataFrame:
    """COUNTS of every row; ``_key`` goes along where there is one."""
    key = F.col(KEY) if KEY in docs.columns else F.lit(None).cast("long")
    return docs.select(key.alias(KEY), F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(released(_counted), STATISTICS)


def _share(top: str, bottom: str) -> Column:
    return F.when(F.col(bottom) > 0, F.col(top) / F.col(bottom)).otherwise(F.lit(0.0))


def features() -> dict[str, Column]:
    """What rules may ask for; all are shares or counts of one text."""
    return {
        "words": F.col("n_words").cast("double"),
        "lines": F.col("n_lines").cast("double"),
        "longest_word": F.col("longest").cast("double"),
        "word_length": _share("word_chars", "n_words"),
        "words_per_line": _share("n_words", "n_lines"),
        "symbol_share": _share("n_symbols", "word_chars"),
        "digit_share": _share("n_digits", "word_chars"),
        "upper_share": _share("n_upper", "word_chars"),
        "repeated_lines": _share("n_dup_lines", "n_lines"),
        "repeated_words": _share("n_repeat_words", "n_words"),
        "distinct_words": _share("n_distinct", "n_words"),
    }


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        value = features()[self.feature]
        return value > self.threshold if self.above else value <= self.threshold

    def holds(self, table: dict[str, np.ndarray]) -> np.ndarray:
        value = table[self.feature]
        return value > self.threshold if self.above else value <= self.threshold


Rule = tuple[Condition, ...]


def _holds(rule: Rule, table: dict[str, np.ndarray], n: int) -> np.ndarray:
    out = np.ones(n, bool)
    for condition in rule:
        out &= condition.holds(table)
    return out


def _best_condition(table, bad, covered) -> tuple[float, Condition | None]:
    """The condition of the largest FOIL gain within the covered rows."""
    p0, n0 = (bad & covered).sum(), (~bad & covered).sum()
    base = np.log2(p0 / (p0 + n0))
    best: tuple[float, Condition | None] = (0.0, None)
    for name, values in table.items():
        own = values[covered]
        order = np.argsort(own, kind="stable")
        value, hit = own[order], np.cumsum(bad[covered][order])
        # thresholds stand between two different neighbours; quantiles of them bound the work
        cuts = np.flatnonzero(value[1:] > value[:-1])
        if len(cuts) > THRESHOLDS:
            cuts = np.unique(np.concatenate([cuts[:8], cuts[-8:], cuts[np.linspace(0, len(cuts) - 1, THRESHOLDS).astype(int)]]))
        if not len(cuts):
            continue
        for above in (False, True):
            p = hit[cuts] if not above else p0 - hit[cuts]
            all_rows = cuts + 1 if not above else len(own) - cuts - 1
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(p > 0, p * (np.log2(p / all_rows) - base), -1.0)
            i = int(gain.argmax())
            if gain[i] > best[0] + 1e-9:
                at = cuts[i]
                best = (float(gain[i]), Condition(name, above, float((value[at] + value[at + 1]) / 2)))
    return best


def _grow(table, bad, rows) -> Rule:
    rule: Rule = ()
    covered = rows.copy()
    while len(rule) < MAX_CONDITIONS and (bad & covered).any() and (~bad & covered).any():
        _, condition = _best_condition(table, bad, covered)
        if condition is None:
            break
        rule += (condition,)
        covered &= condition.holds(table)
    return rule


def _worth(rule: Rule, table, bad, rows) -> tuple[float, int]:
    hit = _holds(rule, table, len(bad)) & rows
    p, n = int((bad & hit).sum()), int((~bad & hit).sum())
    return (p + 1) / (p + n + 2), p


def learn_rules(table: dict[str, np.ndarray], bad: np.ndarray, seed: int = 7) -> list[Rule]:
    """Rules for ``bad`` rows, in order; each is grown on two thirds of the rows left and pruned on the rest."""
    rules: list[Rule] = []
    n = len(bad)
    left = np.ones(n, bool)
    draw = np.random.default_rng(seed)
    while len(rules) < MAX_RULES and (bad & left).sum() >= MIN_COVERED and (~bad & left).any():
        held = draw.random(n) < 1 / 3
        rule = _grow(table, bad, left & ~held)
        options = [rule[:size] for size in range(1, len(rule) + 1)]
        if not options:
            break
        worth = [_worth(option, table, bad, left & held) for option in options]
        rule = options[max(range(len(options)), key=lambda i: (round(worth[i][0], 3), -i))]
        hit = _holds(rule, table, n) & left
        precise = (bad & hit).sum() >= MIN_PRECISION * hit.sum() and (bad & hit).sum() >= MIN_COVERED
        if not precise or max(w[0] for w in worth) < MIN_PRECISION:
            break
        rules.append(rule)
        left &= ~hit
    return rules


def failing_rule(rules: list[Rule]) -> Column:
    """The number of the first rule that a row meets, from 1; null if it meets none."""
    out = F.lit(None).cast("int")
    for number in range(len(rules), 0, -1):
        meets = rules[number - 1][0].column()
        for condition in rules[number - 1][1:]:
            meets = meets & condition.column()
        out = F.when(meets, F.lit(number)).otherwise(out)
    return out


def describe(rules: list[Rule]) -> list[str]:
    return [" and ".join(f"{c.feature} {'>' if c.above else '<='} {c.threshold:.6g}" for c in rule) for rule in rules]


def fit_rules(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE_ROWS) -> list[Rule]:
    """Rules from at most ``bound`` labelled documents, which ones is fixed by a hash of their ids."""
    sample = labelled_sample(labels, "quality", bound)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(sample), "doc_id")
    # one text of each picked id, so that the bound holds for rows too
    texts = texts.groupBy("doc_id").agg(F.min("text").alias("text"))
    columns = features()
    rows = (text_statistics(texts).join(F.broadcast(sample), "doc_id")
            .select("doc_id", "label", *[column.alias(name) for name, column in columns.items()]).toPandas()
            .sort_values(["doc_id", *columns], kind="stable"))
    bad = (rows["label"] == 0).to_numpy(bool)
    return learn_rules({name: rows[name].to_numpy(float) for name in columns}, bad)


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words"))


def judged(docs: DataFrame, labelled: DataFrame, labels: DataFrame, bound: int = SAMPLE_ROWS) -> DataFrame:
    """The statistics of ``docs`` with base_failed, the first failed rule and kept; rules come from ``labelled``."""
    rule = failing_rule(fit_rules(labelled, labels, bound))
    return text_statistics(docs).withColumns({"base_failed": base_failed(), "rule": rule}).withColumn(
        "kept", ~F.col("base_failed") & F.col("rule").isNull())


def report(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, the base statistics, base_failed, the first failed rule and kept of every document."""
    return judged(docs.select("doc_id", "text"), docs, labels, bound).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "rule", "kept")


def keep_good(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE_ROWS) -> DataFrame:
    """The documents that pass, with all their columns."""
    rows = keyed_whole(docs)
    return without(rows, judged(rows, docs, labels, bound).filter("not kept"))
