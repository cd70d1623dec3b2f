r"""Chat formatting by prefix-target expansion, with DataFrame functions only.

Every assistant turn is one example: all earlier turns are its context, and only that reply is under
the loss mask. ``example_rows`` explodes a conversation into them, one row each with its context and target as text;
``read_back`` reads turns, trained texts and sizes from these rows. All examples of a
conversation are prefixes of one formatted text, which is what goes through the one shuffle; contexts are cut from it as rows are made.
Turns after the last reply form a last example without a target, so nothing is lost.

A turn is ``<|im_start|>role\ntext<|im_end|>\n``. Control strings inside a text get a backslash after their
first character (one more if they have some already), which reading removes. Turns go by turn
(nulls first), then role and text; null roles and texts count as empty, a null conv_id
is a conversation of its own, repeated rows are turns of their own, other columns are ignored.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
# fixed values: control strings of this and of other common templates
TAILS = r"\|im_start\|>|\|im_end\|>|\|endoftext\|>|s>|/s>|INST\]|/INST\]|SYS>>|/SYS>>"
RAW = rf"(<|\[|<<)(\\*)({TAILS})"
ESCAPED = rf"(<|\[|<<)\\(\\*)({TAILS})"
TURN = r"(?s)<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n"
# in roles only, which end at the first line break
ROLE_CODES = [("%", "%25"), ("\n", "%0A"), ("<", "%3C"), ("[", "%5B")]
TARGET = "assistant"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, RAW, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, "$1$2$3")


def _role_coded(role: Column) -> Column:
    for plain, code in ROLE_CODES:
        role = F.replace(role, F.lit(plain), F.lit(code))
    return role


def _role_read(role: Column) -> Column:
    for plain, code in reversed(ROLE_CODES):
        role = F.replace(role, F.lit(code), F.lit(plain))
    return role


def format_conversations(turns: DataFrame) -> DataFrame:
    """conv_id, formatted text and examples (prefix_end, loss_start, loss_end in code points, and the target text).

    Offsets are running sums that Spark streams through; only the text of one conversation,
    which is one value of the result, comes together.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    role = F.coalesce(F.col("role").cast("string"), F.lit(""))
    head = F.concat(F.lit(START), _role_coded(role), F.lit("\n"))
    body = escape(text)
    rendered = turns.select(
        "conv_id", "turn", role.alias("role"), text.alias("said"),
        F.concat(head, body, F.lit(END + "\n")).alias("chunk"),
        body.alias("body"))
    in_order = Window.partitionBy("conv_id").orderBy(
        F.col("turn").asc_nulls_first(), "role", "said")
    placed = rendered.select(
        "conv_id", "role", "chunk", "body", F.row_number().over(in_order).alias("at"),
        F.sum(F.char_length("chunk").cast("long")).over(
            in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("end"))
    after_text = F.char_length(F.lit(END + "\n"))
    loss_end = F.col("end") - after_text
    example = F.when(F.col("role") == TARGET, F.struct(
        "at", F.col("end").alias("prefix_end"), (loss_end - F.char_length("body")).alias("loss_start"),
        loss_end.alias("loss_end"), F.col("body").alias("target")))
    joined = placed.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("at", "chunk"))).alias("chunks"),
        F.array_sort(F.collect_list(example)).alias("examples"), F.max("end").alias("length"))
    told = F.coalesce(F.get(F.col("examples.prefix_end"), F.size("examples") - 1), F.lit(0))
    tail = F.struct(F.lit(None).cast("int").alias("at"), F.col("length").alias("prefix_end"),
                    F.col("length").alias("loss_start"), F.col("length").alias("loss_end"), F.lit("").alias("target"))
    return joined.select(
        "conv_id", F.array_join(F.col("chunks.chunk"), "").alias("formatted"),
        F.when(told < F.col("length"), F.concat("examples", F.array(tail))).otherwise(F.col("examples"))
        .alias("examples"))


def example_rows(formatted: DataFrame, *carried: str) -> DataFrame:
    """One row per example: conv_id, its number, the context, the target and what closes it, all escaped.

    Context, target and close, one after another, are the text of the example. Other columns may be carried along.
    """
    e = F.col("e")
    return formatted.select("conv_id", *carried, "formatted", F.posexplode("examples").alias("example", "e")).select(
        "conv_id", *carried, "example", F.substring("formatted", F.lit(1), e["loss_start"].cast("int")).alias("context"),
        e["target"].alias("target"), F.when(e["at"].isNotNull(), END + "\n").otherwise("").alias("close"))


def example_texts(formatted: DataFrame) -> DataFrame:
    """One row per example: conv_id, its number, the context and the target text, both escaped."""
    return example_rows(formatted).drop("close")


def read_back(formatted: DataFrame) -> DataFrame:
    """What the output says, one row per example: conv_id, n_turns and turns_sha256 of its conversation, the number of the
    example, the trained text and the characters of its context, target and close."""
    roles = F.regexp_extract_all("formatted", F.lit(TURN), F.lit(1))
    texts = F.regexp_extract_all("formatted", F.lit(TURN), F.lit(2))
    said = F.zip_with(roles, texts, lambda role, text: F.concat(_role_read(role), F.lit("\n"), unescape(text), F.lit("\n")))
    turns = formatted.select("conv_id", "formatted", "examples", F.size(said).cast("long").alias("n_turns"),
                             F.sha2(F.array_join(said, ""), 256).alias("turns_sha256"))
    chars = F.char_length("context").cast("long") + F.char_length("target") + F.char_length("close")
    return example_rows(turns, "n_turns", "turns_sha256").select(
        "conv_id", "n_turns", "turns_sha256", "example", unescape(F.col("target")).alias("trained"), chars.alias("chars"))


def digests(formatted: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256 and formatted_chars (of all examples)."""
    # rows of a conversation lie together already; only its trained texts and numbers are gathered
    whole = read_back(formatted).groupBy("conv_id", "n_turns", "turns_sha256").agg(
        F.array_join(F.array_sort(F.collect_list(F.struct("example", "trained")))["trained"], "").alias("loss"),
        F.sum("chars").alias("formatted_chars"))
    return whole.select(
        "conv_id", "n_turns", "turns_sha256", F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")
