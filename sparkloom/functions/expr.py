"""Scalar functions as column expressions: names, paths, calls, similarity, scores, buckets."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkloom.functions.constants import BUILTIN_CALLS, CATEGORY_OF_CALL, ENTRY_POINTS, LANGUAGES, NOISE_MEMBERS


def half_up(x: Column, places: int = 0) -> Column:
    """floor(x * 10^n + 0.5) / 10^n on doubles, which is not what `round` does for every double."""
    scale = float(10**places)
    found = F.floor(x.cast("double") * F.lit(scale) + F.lit(0.5))
    return found.cast("double") / F.lit(scale) if places else found


# --- names and search ------------------------------------------------------------------------------------


def tokenize(name: Column) -> Column:
    """Lower-case parts of an identifier: camel case, acronyms and `. _ - /`; single letters are dropped."""
    spaced = F.regexp_replace(name, "([a-z])([A-Z])", "$1 $2")
    spaced = F.regexp_replace(spaced, "([A-Z]+)([A-Z][a-z])", "$1 $2")
    spaced = F.lower(F.regexp_replace(spaced, r"[._\-/]", " "))
    return F.filter(F.split(spaced, r"\s+"), lambda t: F.length(t) > 1)


def token_score(query: Column, name: Column) -> Column:
    """Mean over the query's tokens: 2 for an equal token, 1 if one is a prefix of the other, else 0."""
    hit = lambda t: (
        F.when(F.array_contains(name, t), 2.0).when(F.exists(name, lambda n: n.startswith(t) | t.startswith(n)), 1.0).otherwise(0.0)
    )
    total = F.aggregate(F.transform(query, hit), F.lit(0.0), lambda a, b: a + b)
    return F.when((F.size(query) == 0) | (F.size(name) == 0), 0.0).otherwise(total / F.size(query))


def in_tests(path: Column) -> Column:
    return F.coalesce(path.contains("__tests__") | path.contains(".test.") | path.contains(".spec."), F.lit(False))


def relevance(score: Column, name: Column, kind: Column, path: Column, exported: Column, callers: Column) -> Column:
    """Ten times the score, plus what the entity's place says."""
    return (
        score * 10
        + F.when(F.coalesce(exported, F.lit(False)), 3).otherwise(0)
        + F.least(F.coalesce(callers, F.lit(0)), F.lit(5))
        + F.when(kind == "class", 1).otherwise(0)
        - F.when(name.startswith("_"), 3).otherwise(0)
        - F.when(in_tests(path), 5).otherwise(0)
    ).cast("double")


# --- paths -----------------------------------------------------------------------------------------------


def module_of(path: Column) -> Column:
    """The directory of a path; `.` at the root."""
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise(".")


def module_key(path: Column) -> Column:
    return F.replace(path, F.lit("/"), F.lit("__"))


def language_of(path: Column) -> Column:
    """Language by the last extension, lower-cased; null if unknown."""
    table = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.try_element_at(table, F.lower(F.regexp_extract(path, r"(\.[^.]*)$", 1)))


def content_hash(content: Column) -> Column:
    return F.substring(F.md5(content), 1, 8)


def resolve_path(importer: Column, specifier: Column) -> Column:
    """A specifier relative to its importer: `.` stays, `..` goes up (not beyond the root), others go down."""
    base = F.when(importer.contains("/"), F.split(F.regexp_replace(importer, "/[^/]*$", ""), "/")).otherwise(F.array().cast("array<string>"))
    step = lambda at, s: (
        F.when(s == ".", at).when(s == "..", F.slice(at, 1, F.greatest(F.size(at) - 1, F.lit(0)))).otherwise(F.concat(at, F.array(s)))
    )
    return F.array_join(F.aggregate(F.split(specifier, "/"), base, step), "/")


def is_entry_point(path: Column) -> Column:
    return path.rlike("|".join(f"(?:{p})" for p in ENTRY_POINTS))


def glob_pattern(glob: str, strict: bool = False) -> str:
    """A regular expression for a glob. By default `**` spans one directory at most, as in the rules this is for;
    `strict` gives it its usual meaning."""
    deep = {"**/": "(.*/)?", "**": ".*"} if strict else {"**/": "(.[^/]*/)?", "**": ".[^/]*"}
    table = deep | {"*": "[^/]*"}
    return "^" + "".join(table.get(p, re.sub(r"([.+^${}()|\[\]\\])", r"\\\1", p)) for p in re.split(r"(\*\*/|\*\*|\*)", glob)) + "$"


def last_part(name: Column) -> Column:
    return F.element_at(F.split(name, r"\."), -1)


def class_part(name: Column) -> Column:
    """What stands before the first dot; null without one."""
    return F.when(F.instr(name, ".") > 1, F.substring_index(name, ".", 1))


def method_part(name: Column) -> Column:
    """What stands after the first dot; the name itself without one."""
    return F.when(F.instr(name, ".") > 1, F.regexp_replace(name, r"^[^.]+\.", "")).otherwise(name)


def param_signature(params: Column) -> Column:
    return F.array_join(F.transform(params, lambda p: F.concat(p["name"], F.lit(":"), p["type"])), ",")


# --- calls -----------------------------------------------------------------------------------------------


def normalize_call(call: Column) -> Column:
    """A call's text reduced to a name worth an edge, else null: own members keep any name, builtins go."""
    builtins = sorted(BUILTIN_CALLS)
    t = F.regexp_replace(call, r"^\s+|\s+$", "")
    own = t.rlike(r"^(this|self)\.")
    bare = F.regexp_replace(t, r"^(this|self)\.", "")
    last = F.element_at(F.split(bare, r"\."), -1)
    before = F.regexp_replace(bare, r"(?s)\.[^.]*$", "")
    chained = bare.contains(".") & last.isin(builtins) & ~bare.contains("(") & (before.contains(".") | before.contains("["))
    first = F.when(bare.contains("\n"), F.regexp_replace(F.substring_index(bare, "\n", 1), r"^\s+|\s+$", "")).otherwise(bare)
    gone = bare.contains("\n") & (F.length(first) <= 2)
    paren = F.instr(first, "(")
    short = F.when(F.length(first) > 100, F.when((paren > 0) & (paren <= 80), F.substring_index(first, "(", 1)).otherwise(F.substring(first, 1, 80))).otherwise(first)
    root = F.regexp_extract(short, r"^([a-zA-Z_][\w.]*?)(\(|$)", 1)
    name = F.when(root != "", root).otherwise(short)
    dropped = (F.length(t) <= 1) | (~own & (bare.isin(builtins) | chained)) | gone | (F.length(name) <= 1) | (~own & name.isin(builtins))
    return F.when(~dropped, name)


def filter_calls(calls: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(calls, normalize_call), lambda c: c.isNotNull()))


def telling_calls(calls: Column) -> Column:
    """The calls that are not a built-in member of a plain name."""
    return F.filter(calls, lambda c: ~c.rlike(rf"^\w+\.(?:{'|'.join(NOISE_MEMBERS)})$"))


def truncate_type(written: Column, limit: int = 120) -> Column:
    """A written type of at most `limit` characters: a longer one loses its `Doc(...)` notes, then what annotates
    it, then blanks, and is cut in the end."""
    t = F.regexp_replace(written, r',?\s*Doc\(\s*"""[\s\S]*?"""\s*\)', "")
    t = F.regexp_replace(t, r',?\s*Doc\(\s*"[^"]*"\s*\)', "")
    t = F.regexp_replace(t, r"Annotated\[([^,\]]+),\s*[^\]]+\]", "$1")
    t = F.trim(F.regexp_replace(t, r"\s+", " "))
    short = F.when(F.length(t) > limit, F.concat(F.substring(t, 1, limit - 3), F.lit("..."))).otherwise(t)
    return F.when(F.length(written) <= limit, written).otherwise(short)


def json_bytes(value: Column) -> Column:
    """The UTF-8 bytes of a struct, map or array as JSON; 0 where there is none."""
    return F.coalesce(F.octet_length(F.to_json(value)), F.lit(0))


def finite(value: Column) -> Column:
    """Zero in place of an infinite number or none."""
    return F.when(value.isNull() | F.isnan(value) | (F.abs(value) == float("inf")), 0.0).otherwise(value)


def call_category(call: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in CATEGORY_OF_CALL.items() for x in pair])
    last = F.when(F.instr(call, ".") > 1, F.element_at(F.split(call, r"\."), -1))
    return F.coalesce(F.try_element_at(table, call), F.try_element_at(table, last))


# --- similarity ------------------------------------------------------------------------------------------


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets; 1 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def _closeness(a: Column, b: Column) -> Column:
    return (F.least(a, b) + 1) / (F.greatest(a, b) + 1)


def similarity(a, b) -> Column:
    """Weighted over calls, parameters, return type, shape and call categories. `a`, `b`: columns by name, with
    calls, categories, param_count, param_signature, return_type, complexity, line_count, nesting_depth."""
    n, m = a("param_count"), b("param_count")
    params = (
        F.when((n == 0) & (m == 0), 1.0).when(n == m, F.when(a("param_signature") == b("param_signature"), 1.0).otherwise(0.6)).otherwise(F.least(n, m) / F.greatest(n, m, F.lit(1)) * 0.5)
    )
    r, s = a("return_type"), b("return_type")
    returned = F.when((r == s) & (r != ""), 1.0).when((r == "") | (s == ""), 0.3).otherwise(0.0)
    shape = reduce(lambda x, y: x + y, [_closeness(a(c), b(c)) for c in ("complexity", "line_count", "nesting_depth")]) / 3
    x, y = a("categories"), b("categories")
    categories = F.when((F.size(x) == 0) & (F.size(y) == 0), 0.5).otherwise(jaccard(x, y))
    return jaccard(a("calls"), b("calls")) * 0.35 + params * 0.25 + returned * 0.10 + shape * 0.15 + categories * 0.15


# --- scores ----------------------------------------------------------------------------------------------


def percent(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part.cast("double") / whole * 100).otherwise(0.0)


def health_score(functions: Column, classes: Column, complex_: Column, long_: Column, gods: Column, dead: Column) -> Column:
    penalty = (
        F.least(F.lit(25.0), percent(complex_, functions) * 0.8)
        + F.least(F.lit(20.0), percent(long_, functions) * 0.5)
        + F.least(F.lit(15.0), percent(gods, classes) * 0.5)
        + F.least(F.lit(10.0), percent(dead, functions) * 0.5)
    )
    return F.greatest(F.lit(0), F.floor(F.lit(100.0) - penalty + 0.5)).cast("long")


def instability(afferent: Column, efferent: Column) -> Column:
    return F.coalesce(F.try_divide(efferent.cast("double"), afferent + efferent), F.lit(0.0))


# --- time, sizes, routes ---------------------------------------------------------------------------------


def bucket_start(ts: Column) -> Column:
    """The start of the 5-hour bucket of the day (0, 5, 10, 15, 20) that a time lies in."""
    return F.date_trunc("day", ts) + F.make_dt_interval(F.lit(0), (F.floor(F.hour(ts) / 5) * 5).cast("int"))


def bucket_end(ts: Column) -> Column:
    """Its end: five hours later, but the last bucket ends with the day."""
    hour = F.floor(F.hour(ts) / 5) * 5
    return F.date_trunc("day", ts) + F.make_dt_interval(F.lit(0), F.least(hour + 5, F.lit(24)).cast("int"))


def human_bytes(n: Column) -> Column:
    """`0 B`, `512 B`, `1.5 KB`, ..."""
    k = F.when(n < 1024, 0).when(n < 1024**2, 1).when(n < 1024**3, 2).otherwise(3)
    value = F.format_string("%.1f", n.cast("double") / F.pow(F.lit(1024.0), k))
    return F.when(k == 0, F.concat(n.cast("long").cast("string"), F.lit(" B"))).otherwise(F.concat(value, F.lit(" "), F.element_at(F.array(*map(F.lit, ("KB", "MB", "GB"))), F.greatest(k, F.lit(1)))))


def relative_time(then: Column, now: Column) -> Column:
    """`just now`, `5 minutes ago`, `1 hour ago`, `3 days ago`."""
    seconds = F.unix_timestamp(now) - F.unix_timestamp(then)
    said = lambda n, unit: F.concat(n.cast("string"), F.lit(f" {unit}"), F.when(n == 1, "").otherwise("s"), F.lit(" ago"))
    minutes, hours, days = (F.floor(seconds / n) for n in (60, 3600, 86400))
    return F.when(days > 0, said(days, "day")).when(hours > 0, said(hours, "hour")).when(minutes > 0, said(minutes, "minute")).otherwise("just now")


def route_params(path: Column) -> Column:
    """Names of the `:name` parts of a route."""
    return F.regexp_extract_all(path, F.lit(r":(\w+)"), 1)
