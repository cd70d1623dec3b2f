"""URL filters: allow and block rules of hosts and path beginnings, met by a sort-merge range join.

A rule (host, path, verdict) fits its host and all subdomains of it, where the url's path starts with the rule's;
of the rules that fit a url the one with the longest host and path counts (then the longest host). A rule without
host (empty) fits every host. Hosts of rules are taken in lower case; rules with a null in host, path or verdict are
left out, and of rules with the same host and path the greatest verdict counts, so ``block`` before ``allow``.

The host of a url is what follows its first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; the path
goes on to ``?``, ``#`` or the end. Without ``://``, and of null, both are empty. Where no rule fits, ``default`` counts.

Written label by label from the right, each label closed by a dot, hosts become keys (``com.example.``) of which
a rule's key covers one interval: those that begin with it. Together with the beginning of the path that a rule asks for
as the first part of the key, intervals are nested or apart. Urls are points: their different (host, path as far as any
rule reads it) are found first, by aggregation in the tasks, so a host that holds most pages is a few points. Rules and points are
cut into ranges of the key at sampled points, and sorted. The sweep through a range keeps, for every
number of labels, the last rule passed: the stack of rules that may still be open. A point takes the deepest of them that
it begins with. What is open where a range begins is known from one row per range and depth.

Only DataFrame functions are used. Pages pass through with all their columns; those added replace any of the same name.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablekin.functions.frames import join_small
from tablekin.llm.common import ascii_lower, stage

# ranges are cut at so many points at most, a power of two less one; a range is meant to hold so many points
CUTS, RANGE_POINTS = 1_023, 100_000
SITE = ["_host", "_beginning"]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host, in lower case, and path of a url."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substr(url, at + 3))
    return (F.coalesce(ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1)), F.lit("")),
            F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit("")))


def reversed_host(host: Column) -> Column:
    """``com.example.`` for ``example.com``; empty for an empty host."""
    return F.when(host == "", "").otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit(".")))


def interval_rules(rules: DataFrame) -> DataFrame:
    """Different rules: ``prefix`` (the path), ``key``, ``depth`` (labels), ``rule`` as text, ``length``, ``verdict``."""
    plain = rules.select(ascii_lower(F.col("host")).alias("host"), "path", "verdict").dropna()
    return plain.groupBy("host", "path").agg(F.max("verdict").alias("verdict")).select(
        F.col("path").alias("prefix"), reversed_host(F.col("host")).alias("key"),
        F.when(F.col("host") == "", 0).otherwise(F.size(F.split("host", r"\."))).alias("depth"),
        F.concat("host", "path").alias("rule"), F.length("host").alias("host_length"),
        (F.length("host") + F.length("path")).alias("length"), "verdict")


def _place() -> Column:
    """Where rules and points stand in the order of the sweep; a rule stands before the points at its own key."""
    return F.struct("prefix", "key", "point", *SITE)


def _range_of(place: Column, cuts: list) -> Column:
    """How many of the sorted cuts lie at or before a place, by halving."""
    if not cuts:
        return F.lit(0)
    listed = F.array(*[F.struct(*[F.lit(value).alias(name) for name, value in cut.asDict().items()]) for cut in cuts])
    steps = F.array(*[F.lit(1 << power) for power in reversed(range(len(cuts).bit_length()))])

    def further(low: Column, step: Column) -> Column:
        past = (low + step <= len(cuts)) & (F.get(listed, low + step - 1) <= place)
        return low + F.when(past, step).otherwise(0)

    return F.aggregate(steps, F.lit(0), further)


def sites(pages: DataFrame, longest: int) -> DataFrame:
    """Different hosts with the beginning of the path that rules of ``longest`` characters can read."""
    return pages.select("_host", F.substring("_path", 1, longest).alias("_beginning")).distinct()


def swept(points: DataFrame, rules: DataFrame, depths: list[int], ranges: int) -> DataFrame:
    """The points with ``open``, the deepest rule whose prefix is theirs and whose key they begin with, or null."""
    same = {"point": F.lit(0), "_host": F.lit(""), "_beginning": F.lit("")}
    events = points.withColumns({"point": F.lit(1), "depth": F.lit(None).cast("int"), "found": F.lit(None).cast(
        "struct<rule:string,host_length:int,length:int,verdict:string>")}).unionByName(rules.select(
            "prefix", "key", "depth", F.struct("rule", "host_length", "length", "verdict").alias("found")).withColumns(same))
    # a bounded sample of the points, chosen by a hash, gives the cuts
    wanted = min(CUTS, ranges - 1)
    chosen = points.withColumn("point", F.lit(1)).select(_place().alias("place")).orderBy(
        F.xxhash64("place")).limit(4 * wanted).collect() if wanted else []
    ordered = sorted((row["place"] for row in chosen), key=lambda place: [str(part).encode("utf-8", "surrogatepass") for part in place])
    cuts = [ordered[at * len(ordered) // (wanted + 1)] for at in range(1, wanted + 1)] if ordered else []
    events = stage(events.withColumn("place", _place()).withColumn("range", _range_of(F.col("place"), cuts)).drop("place"))
    # the last rule of each depth in each range is open at the start of later ranges, until another follows
    last = events.filter(F.col("point") == 0).groupBy("range").agg(*[
        F.max(F.when(F.col("depth") == depth, F.struct("prefix", "key", "found"))).alias(f"last{depth}") for depth in depths])
    starts = events.sparkSession.range(len(cuts) + 1).select(F.col("id").cast("int").alias("range"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    carried = starts.join(F.broadcast(last), "range", "left").select("range", *[
        F.last(f"last{depth}", ignorenulls=True).over(before).alias(f"carried{depth}") for depth in depths])
    sweep = Window.partitionBy("range").orderBy("prefix", "key", "point", *SITE).rowsBetween(Window.unboundedPreceding, 0)
    passed = events.select("*", *[
        F.last(F.when(F.col("depth") == depth, F.struct("prefix", "key", "found")), ignorenulls=True).over(sweep).alias(
            f"passed{depth}") for depth in depths]).filter(F.col("point") == 1)
    with_carried = passed.join(F.broadcast(carried), "range", "left")
    stack = [F.coalesce(f"passed{depth}", f"carried{depth}") for depth in depths]
    fits = [F.when((rule["prefix"] == F.col("prefix")) & F.col("key").startswith(rule["key"]), rule["found"]) for rule in stack]
    return with_carried.select("prefix", *SITE, F.coalesce(*reversed(fits)).alias("open"))


def judge_sites(found: DataFrame, rules: DataFrame) -> DataFrame:
    """``_host, _beginning, _rule, _verdict`` of the sites that a rule fits."""
    rules = stage(interval_rules(rules))
    shape = rules.agg(F.collect_set("depth").alias("depths"), F.collect_set(F.length("prefix")).alias("lengths")).first()
    depths, lengths = sorted(shape["depths"]), sorted(shape["lengths"])
    if not depths:
        return found.limit(0).select(*SITE, F.lit("").alias("_rule"), F.lit("").alias("_verdict"))
    reach = F.filter(F.array(*[F.lit(length) for length in lengths]), lambda n: n <= F.length("_beginning"))
    prefixes = rules.groupBy("prefix").count()
    points = found.select(*SITE, F.explode(reach).alias("_n")).select(
        *SITE, F.expr("substring(_beginning, 1, _n)").alias("prefix"))
    points = stage(join_small(points, prefixes.select("prefix"), ["prefix"], prefixes.count(), spread=SITE).withColumn(
        "key", reversed_host(F.col("_host"))))
    n = points.count()
    ranges = max(n // RANGE_POINTS, min(int(found.sparkSession.conf.get("spark.sql.shuffle.partitions")), n // 4)) + 1
    best = swept(points, rules, depths, ranges).filter(F.col("open").isNotNull()).groupBy(*SITE).agg(
        F.max_by("open", F.struct("open.length", "open.host_length")).alias("best"))
    return best.select(*SITE, F.col("best.rule").alias("_rule"), F.col("best.verdict").alias("_verdict"))


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """The pages, read by their ``url``, with ``host``, ``path``, ``rule`` (null where none fits) and ``verdict``."""
    host, path = host_and_path(F.col("url"))
    given = pages.select(F.struct("*").alias("_row"), "url").select("_row", host.alias("_host"), path.alias("_path"))
    longest = rules.agg(F.max(F.length("path"))).first()[0] or 0
    found = stage(sites(given, longest))
    judged = stage(judge_sites(found, rules))
    seen = judged.withColumnRenamed("_beginning", "_begins")
    asked = given.withColumns({"_begins": F.substring("_path", 1, longest), "_nth": F.monotonically_increasing_id()})
    named = join_small(asked, seen, ["_host", "_begins"], judged.count(), spread=["_nth"], how="left")
    added = {"host": F.col("_host"), "path": F.col("_path"), "rule": F.col("_rule"),
             "verdict": F.coalesce("_verdict", F.lit(default))}
    kept = [F.col("_row")[name].alias(name) for name in pages.columns if name.lower() not in added]
    return named.select(*kept, *[column.alias(name) for name, column in added.items()])


def allowed(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """The pages whose verdict is ``allow``, with the columns they came with."""
    whole = pages.select(F.struct("*").alias("_page"), "url")
    return judge(whole, rules, default).filter(F.col("verdict") == "allow").select("_page.*")
