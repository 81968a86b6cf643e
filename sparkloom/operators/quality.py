"""Health, hotspots, dead code and duplicates of callables.

`callables`: file, name, class_name (null for functions), qualified_name, kind, param_count, param_signature,
return_type, access, exported, calls ARRAY, complexity, line_count, nesting_depth, seq.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.constants import MAX_COMPLEXITY, MAX_LINES, MAX_METHODS
from sparkloom.functions.expr import call_category, half_up, health_score, is_entry_point, jaccard, last_part, percent, similarity

CONSTRUCTORS = ("constructor", "__init__")
#: Bounds of scores are held against a limit less so much, as sums of doubles round.
SLACK = 1e-6


def dead_functions(callables: DataFrame, reverse: DataFrame, entry_files: DataFrame, exports: DataFrame) -> DataFrame:
    """Callables that nothing calls: not in an entry file, no constructors. Low confidence if they can be seen from elsewhere.

    `reverse`: callee, caller. `entry_files`: file. `exports`: name."""
    called = reverse.select(F.col("callee").alias("qualified_name")).distinct()
    rows = callables.join(entry_files.select("file").distinct(), "file", "left_anti").filter((F.col("kind") != "method") | ~F.col("name").isin(*CONSTRUCTORS))
    rows = rows.join(called, "qualified_name", "left_anti").join(exports.select("name", F.lit(True).alias("shared")).distinct(), "name", "left")
    public = F.when(F.col("kind") == "method", F.col("access") == "public").otherwise(F.col("exported"))
    low = F.when(F.col("kind") == "method", public).otherwise(public | F.coalesce("shared", F.lit(False)))
    return rows.withColumn("is_exported", public).withColumn("confidence", F.when(low, "low").otherwise("high")).drop("shared")


def dead_summary(callables: DataFrame, dead: DataFrame) -> DataFrame:
    """One row: all callables, dead ones, their lines, those of high confidence, and the share in percent."""
    a = callables.agg(F.count("*").alias("total"))
    b = dead.agg(F.count("*").alias("dead"), F.coalesce(F.sum("line_count"), F.lit(0)).alias("dead_lines"), F.count_if(F.col("confidence") == "high").alias("high_confidence"))
    return a.join(b).withColumn("percentage", half_up(percent(F.col("dead"), F.col("total")), 2))


def dead_exported(functions: DataFrame, reverse: DataFrame, limit: int = 30) -> DataFrame:
    """Exported functions without callers and outside entry files, longest first."""
    called = reverse.select(F.col("callee").alias("qualified_name")).distinct()
    rows = functions.filter((F.col("kind") == "function") & F.col("exported") & ~is_entry_point(F.col("file")))
    return rows.join(called, "qualified_name", "left_anti").orderBy(F.desc("line_count"), "seq").limit(limit)


def _severity(value: Column, limit: int) -> Column:
    return F.when(value > 2 * limit, "critical").otherwise("warning")


def class_metrics(callables: DataFrame) -> DataFrame:
    """(file, class_name, methods, seq) with `god`: more methods than a class should have."""
    rows = callables.filter("class_name is not null").groupBy("file", "class_name").agg(F.count("*").alias("methods"), F.min("seq").alias("seq"))
    return rows.withColumn("god", F.col("methods") > MAX_METHODS)


def hotspots(callables: DataFrame, limit: int | None = 20) -> DataFrame:
    """(type, target, file, metric, value, threshold, severity): critical ones first, then the largest values."""
    over = callables.filter(F.col("complexity") > MAX_COMPLEXITY).select(
        F.lit("high_complexity").alias("type"), F.col("qualified_name").alias("target"), "file", F.lit("complexity").alias("metric"), F.col("complexity").cast("long").alias("value"),
        F.lit(MAX_COMPLEXITY).alias("threshold"), _severity(F.col("complexity"), MAX_COMPLEXITY).alias("severity"), "seq",
    )
    gods = class_metrics(callables).filter("god").select(
        F.lit("god_class").alias("type"), F.col("class_name").alias("target"), "file", F.lit("method_count").alias("metric"), F.col("methods").alias("value"),
        F.lit(MAX_METHODS).alias("threshold"), _severity(F.col("methods"), MAX_METHODS).alias("severity"), "seq",
    )
    ordered = over.unionByName(gods).orderBy("severity", F.desc("value"), "seq", "type")
    return ordered.limit(limit) if limit else ordered


def health(callables: DataFrame, classes: DataFrame, dead: DataFrame) -> DataFrame:
    """One row: the metrics of the health report and its score, which counts dead code of high confidence only."""
    c = callables.agg(
        F.count("*").alias("total_functions"),
        F.coalesce(F.sum("complexity"), F.lit(0)).alias("total_complexity"),
        F.count_if(F.col("complexity") > MAX_COMPLEXITY).alias("over_complexity"),
        F.count_if(F.col("line_count") > MAX_LINES).alias("over_lines"),
        F.min_by("qualified_name", F.struct(-F.col("complexity"), F.col("seq"))).alias("max_function"),
        F.max("complexity").cast("long").alias("max_complexity"),
    )
    k = classes.agg(F.count("*").alias("total_classes")).join(class_metrics(callables).agg(F.count_if("god").alias("god_classes")))
    rows = c.join(k).join(dead_summary(callables, dead).drop("total", "dead_lines"))
    score = health_score(*[F.col(n) for n in ("total_functions", "total_classes", "over_complexity", "over_lines", "god_classes", "high_confidence")])
    mean = F.when(F.col("total_functions") > 0, half_up(F.col("total_complexity") / F.col("total_functions"), 2)).otherwise(0.0)
    return rows.withColumn("avg_complexity", mean).withColumn("score", score)


def gate(report: DataFrame, threshold: int = 70, delta: DataFrame | None = None) -> DataFrame:
    """(passed, reason) of a health row against a threshold and, if given, the trend's delta."""
    low = F.col("score") < threshold
    rows = report.select("score") if delta is None else report.select("score").join(delta.select("delta"), how="left")
    fell = F.lit(False) if delta is None else F.coalesce(F.col("delta") < 0, F.lit(False))
    return rows.select((~low & ~fell).alias("passed"), F.when(low, "score below threshold").when(fell, "score fell").otherwise("ok").alias("reason"))


def _pair(side: str):
    return lambda name: F.col(f"{side}.{name}")


def same_name_groups(callables: DataFrame) -> DataFrame:
    """(base, members, files, max_similarity, same_signature): names defined in several files with alike calls or equal signatures.

    Pairs meet inside a name on a call that they share, and the intersection is counted, as others have similarity
    0. The members of a name are first reduced to distinct call sets, so a name that a framework repeats
    thousands of times with the same body costs nothing more."""
    rows = callables.select(last_part(F.col("qualified_name")).alias("base"), "file", "param_signature", F.array_sort(F.array_distinct("calls")).alias("calls"))
    groups = rows.groupBy("base").agg(F.count("*").alias("members"), F.count_distinct("file").alias("files")).filter("members > 1 and files > 1")
    signed = rows.filter("param_signature <> ''").groupBy("base", "param_signature").agg(F.count("*").alias("n")).filter("n > 1").select("base").distinct().withColumn("same_signature", F.lit(True))
    bodies = rows.join(groups.select("base"), "base", "left_semi").groupBy("base", "calls").agg(F.count("*").alias("n"))
    keyed = bodies.select("base", F.xxhash64("calls").alias("key"), F.size("calls").alias("size"), F.explode("calls").alias("call"))
    met = keyed.alias("a").join(keyed.alias("b"), (F.col("a.base") == F.col("b.base")) & (F.col("a.call") == F.col("b.call")) & (F.col("a.key") < F.col("b.key")))
    shared = met.groupBy(F.col("a.base").alias("base"), F.col("a.key").alias("x"), F.col("b.key").alias("y"), F.col("a.size").alias("m"), F.col("b.size").alias("n")).agg(F.count("*").alias("both"))
    pairs = shared.select("base", (F.col("both") / (F.col("m") + F.col("n") - F.col("both"))).alias("s"))
    best = pairs.unionByName(bodies.filter("n > 1").select("base", F.lit(1.0).alias("s"))).groupBy("base").agg(F.max("s").alias("max_similarity"))
    out = groups.join(best, "base", "left").join(signed, "base", "left").na.fill(0.0, ["max_similarity"]).na.fill(False, ["same_signature"])
    return out.filter("max_similarity > 0.3 or same_signature")


def _marks(low: int) -> Column:
    """64 of 128 bits: the hash of each call sets one."""
    return F.expr(f"aggregate(calls, 0L, (a, c) -> a | if(pmod(xxhash64(c), 128) between {low} and {low + 63}, shiftleft(1L, cast(pmod(xxhash64(c), 64) as int)), 0L))")


def alike_candidates(rows: DataFrame, least: float) -> DataFrame:
    """(i, j): the pairs of `rows` (with categories, calls distinct) that may reach `least`, each once.

    Without a shared call (and with calls on either side) a pair reaches 0.575, or 0.65 if it shares a call category, and
    only with equal parameters. So pairs meet on a call, on having none, and on parameters (with a category, over 0.575) only
    where `least` allows it. What meets is held against a bound before it leaves the join: each row carries 128 bits of
    its calls, and a bit that one side lacks is a call that it lacks."""
    signature = F.when(F.col("param_count") == 0, "s:0").otherwise(F.concat(F.lit("s:"), F.col("param_count").cast("string"), F.lit(":"), F.col("param_signature")))
    keys = F.when(F.size("calls") == 0, F.array(F.lit("none"))).otherwise(F.transform("calls", lambda c: F.concat(F.lit("c:"), c)))
    if least <= 0.575 + SLACK:
        keys = F.concat(F.array(signature), keys)
    elif least <= 0.65 + SLACK:
        keys = F.concat(F.transform("categories", lambda c: F.concat(signature, F.lit(":"), c)), keys)
    same = F.pmod(F.xxhash64(signature), F.lit(1 << 15)).cast("short")
    keyed = rows.select("seq", "line_count", F.size("calls").alias("n"), _marks(0).alias("b0"), _marks(64).alias("b1"), F.when(signature.isNotNull(), same).alias("same"), (F.size("categories") > 0).alias("sorted"), F.array_distinct(F.transform(keys, lambda k: F.xxhash64(k))).alias("keys"))
    # A step of its own: beside the explode all columns would be computed again for each key.
    keyed = keyed.select("seq", "line_count", "n", "b0", "b1", "same", "sorted", F.explode("keys").alias("key"))
    x, y = _pair("x"), _pair("y")

    def shared(a, b) -> Column:
        return a("n") - sum(F.bit_count(a(k).bitwiseAND(F.bitwise_not(b(k)))) for k in ("b0", "b1"))

    categories = F.when(x("sorted") & y("sorted"), 1.0).when(x("sorted") | y("sorted"), 0.0).otherwise(0.5)
    params = F.when(x("same") == y("same"), 1.0).otherwise(0.6)
    # The share of common calls that the pair needs; of two empty sets it is 1.
    need = (least - SLACK - (params * 0.25 + categories * 0.15 + 0.10 + 0.15)) / 0.35
    enough = F.least(shared(x, y), shared(y, x)) * (need + 1) >= need * (x("n") + y("n"))
    close = F.greatest(x("line_count"), y("line_count")) <= 2 * F.greatest(F.least(x("line_count"), y("line_count")), F.lit(1))
    met = keyed.alias("x").join(keyed.alias("y"), (x("key") == y("key")) & (x("seq") < y("seq")) & close & enough)
    return met.select(x("seq").alias("i"), y("seq").alias("j")).distinct()


def cross_name_pairs(callables: DataFrame, named: DataFrame | None = None, least: float = 0.6) -> DataFrame:
    """(name_a, file_a, name_b, file_b, similarity): callables of different names and files that are alike.

    Without equal parameter signatures and without a shared call (or none on either side) a pair reaches 0.55 at
    most, so for any `least` above that (less is an error) candidates meet on what they share, never all with all.
    A ratio of lines over 2 is left out. Pairs of names that a group of `named` (base) joins already are left out too."""
    if least <= 0.55:
        raise ValueError("least must be over 0.55: pairs that share nothing are not looked at")
    rows = callables.withColumn("calls", F.array_distinct("calls")).withColumn("categories", F.array_distinct(F.filter(F.transform("calls", call_category), lambda c: c.isNotNull()))).withColumn("base", last_part(F.col("qualified_name")))
    pairs = alike_candidates(rows, least)
    both = pairs.join(rows.alias("a"), F.col("i") == F.col("a.seq")).join(rows.alias("b"), F.col("j") == F.col("b.seq")).filter((F.col("a.file") != F.col("b.file")) & (F.col("a.base") != F.col("b.base")))
    score = similarity(_pair("a"), _pair("b"))
    if named is not None:
        both = both.join(named.select(F.col("base").alias("n1")), F.col("a.base") == F.col("n1"), "left").join(named.select(F.col("base").alias("n2")), F.col("b.base") == F.col("n2"), "left")
        both = both.filter(~(F.coalesce(F.col("n1") == F.col("n2"), F.lit(False))))
    out = both.withColumn("score", score).filter(F.col("score") >= least)
    return out.select(F.col("a.qualified_name").alias("name_a"), F.col("a.file").alias("file_a"), F.col("b.qualified_name").alias("name_b"), F.col("b.file").alias("file_b"), half_up(F.col("score"), 2).alias("similarity"))


def all_duplicates(callables: DataFrame, least: float = 0.6, scope: str | None = None) -> DataFrame:
    """(kind, name, other, similarity): groups of one name (other: null) and pairs of different names, most alike first.

    `scope`: only callables of files whose path begins so."""
    rows = callables.filter(F.col("file").startswith(scope)) if scope else callables
    named = same_name_groups(rows)
    groups = named.select(F.lit("same-name").alias("kind"), F.col("base").alias("name"), F.lit(None).cast("string").alias("other"), F.col("max_similarity").alias("similarity"))
    pairs = cross_name_pairs(rows, named, least).select(F.lit("cross-name").alias("kind"), F.col("name_a").alias("name"), F.col("name_b").alias("other"), "similarity")
    return groups.unionByName(pairs).orderBy(F.desc("similarity"), "kind", "name", "other")


def copy_calls(members: DataFrame) -> DataFrame:
    """(base, file, name, call, shared): each copy's calls, and whether every copy of its group has them.

    `members`: base, file, name, calls. A row for each call: no group is gathered in one place."""
    copies = members.groupBy("base").agg(F.count("*").alias("copies"))
    each = members.select("base", "file", "name", F.explode(F.array_distinct("calls")).alias("call"))
    held = each.groupBy("base", "call").agg(F.count("*").alias("n")).join(copies, "base")
    held = held.select("base", "call", (F.col("n") == F.col("copies")).alias("shared"))
    return each.join(held, ["base", "call"]).select("base", "file", "name", "call", "shared")
