"""Call and import graphs as edge tables: building, reversing, resolving, neighbours, breadth-first exploration.

`edges`: caller, callee (names) or src, dst; names are not unique beyond a project and resolved as described.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkloom.functions.constants import IMPORT_ENDINGS
from sparkloom.functions.expr import class_part, method_part, module_of, resolve_path
from sparkloom.session import cut

MODULE_CALLER = "__module__"


def latest(rows: DataFrame, *keys: str) -> DataFrame:
    """The last row (by `seq`) of each key."""
    fields = [F.col(c) for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*fields), "seq").alias("r")).select(*keys, "r.*")


def call_edges(callables: DataFrame, module_calls: DataFrame | None = None) -> DataFrame:
    """(caller, callee, pos) of the latest callable of each qualified name, and of modules' own calls."""
    rows = callables.select(F.col("qualified_name").alias("caller"), "calls", "seq")
    if module_calls is not None:
        rows = rows.unionByName(module_calls.select(F.concat(F.lit(MODULE_CALLER), "file").alias("caller"), "calls", "seq"))
    return latest(rows, "caller").select("caller", F.posexplode("calls").alias("pos", "callee")).select("caller", "callee", "pos")


def reverse_raw(edges: DataFrame) -> DataFrame:
    """Distinct (callee, caller)."""
    return edges.select("callee", "caller").distinct()


def reverse_resolved(edges: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    """Distinct (callee, caller): each raw edge, and what an unknown callee resolves to.

    A callee that is no key itself resolves, in this order: a bare name to a method of the caller's class; a
    dotted name to the standalone function after its first dot; any name to all methods of that name.
    """
    keys = (edges.select(F.col("caller").alias("key")) if keys is None else keys.select("key")).distinct()
    raw = reverse_raw(edges)
    dotted = F.instr("callee", ".") > 1
    owner = F.when(~F.col("caller").startswith(MODULE_CALLER), class_part(F.col("caller")))
    open_ = raw.join(keys, F.col("callee") == F.col("key"), "left_anti").select("callee", "caller", dotted.alias("dotted"), method_part(F.col("callee")).alias("m"), owner.alias("owner"))
    own = keys.select(F.col("key").alias("own_key"))
    plain = keys.filter(F.instr("key", ".") == 0).select(F.col("key").alias("plain_key"))
    methods = keys.filter((F.instr("key", ".") > 1) & ~F.col("key").startswith(MODULE_CALLER)).select(F.col("key").alias("method_key"), method_part(F.col("key")).alias("m"))
    step = open_.join(own, ~F.col("dotted") & (F.concat(F.col("owner"), F.lit("."), F.col("callee")) == F.col("own_key")), "left")
    step = step.join(plain, F.col("dotted") & (F.col("m") == F.col("plain_key")), "left")
    one = F.coalesce("own_key", "plain_key")
    single = step.filter(one.isNotNull()).select(one.alias("callee"), "caller")
    many = step.filter(one.isNull()).select("m", "caller").join(methods, "m").select(F.col("method_key").alias("callee"), "caller")
    return raw.unionByName(single).unionByName(many).distinct()


def with_callers(keys: DataFrame, reverse: DataFrame) -> DataFrame:
    """(key, called_by): every key, with its distinct callers in order, empty without any."""
    lists = reverse.groupBy(F.col("callee").alias("key")).agg(F.array_sort(F.collect_set("caller")).alias("called_by"))
    return keys.select("key").distinct().join(lists, "key", "left").withColumn("called_by", F.coalesce("called_by", F.array().cast("array<string>")))


def degrees(edges: DataFrame) -> DataFrame:
    """(node, fan_in, fan_out) over distinct edges."""
    pairs = edges.select("caller", "callee").distinct()
    both = pairs.select(F.col("caller").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")).unionByName(pairs.select(F.col("callee").alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o")))
    return both.groupBy("node").agg(F.sum("i").alias("fan_in"), F.sum("o").alias("fan_out"))


def import_edges(files: DataFrame, imports: DataFrame) -> DataFrame:
    """(src, dst, pos): relative imports to the first scanned file among the specifier's candidates; others are external."""
    local = imports.filter(F.col("specifier").rlike("^[./]")).select(F.col("file").alias("src"), "specifier", "seq", resolve_path(F.col("file"), F.col("specifier")).alias("base"))
    tried = local.select("src", "specifier", "seq", F.posexplode(F.array(*[F.concat("base", F.lit(e)) for e in IMPORT_ENDINGS])).alias("k", "path"))
    hit = tried.join(files.select("path"), "path").groupBy("src", "specifier").agg(F.min_by("path", "k").alias("dst"), F.min("seq").alias("pos"))
    return hit.groupBy("src", "dst").agg(F.min("pos").alias("pos"))


def module_edges(edges: DataFrame) -> DataFrame:
    """Distinct (src_module, dst_module) of file edges between different modules."""
    pairs = edges.select(module_of(F.col("src")).alias("src_module"), module_of(F.col("dst")).alias("dst_module"))
    return pairs.filter("src_module <> dst_module").distinct()


def explore(edges: DataFrame, start: str, depth: int | None = 2, direction: str = "both") -> DataFrame:
    """(node, distance, side, via): breadth first from `start`, forwards over callees and then backwards over callers.

    What is reached forwards is not reached again backwards. `via` is the neighbour it was reached from. The
    depth is 2 if none or 0 is given and 5 at most, so the plan is a few joins. No row if `start` is unknown.
    """
    rounds = min(depth or 2, 5)
    pairs = cut(edges.select("caller", "callee").distinct())
    known = pairs.filter((F.col("caller") == start) | (F.col("callee") == start)).limit(1)
    seen = known.select(F.lit(start).alias("node"), F.lit(0).alias("distance"), F.lit("start").alias("side"), F.lit(None).cast("string").alias("via"))
    for side, here, there in (("calls", "caller", "callee"), ("callers", "callee", "caller")):
        if direction not in ("both", side):
            continue
        front = known.select(F.lit(start).alias("node"))
        for k in range(1, rounds + 1):
            step = front.join(pairs, F.col("node") == F.col(here)).groupBy(F.col(there).alias("next")).agg(F.min(here).alias("via"))
            fresh = cut(step.join(seen, F.col("next") == F.col("node"), "left_anti"))
            seen = cut(seen.unionByName(fresh.select(F.col("next").alias("node"), F.lit(k).alias("distance"), F.lit(side).alias("side"), "via")))
            front = fresh.select(F.col("next").alias("node"))
    return seen


def resolve_file(paths: DataFrame, wanted: str) -> DataFrame:
    """The paths that a file argument means: the path itself if it exists, else all that contain it."""
    exact = paths.select("path").distinct().withColumn("exact", F.col("path") == wanted)
    best = exact.agg(F.max("exact").alias("any_exact"))
    return exact.join(F.broadcast(best)).filter(F.when(F.col("any_exact"), F.col("exact")).otherwise(F.col("path").contains(wanted))).select("path")


def dependencies(edges: DataFrame, files: DataFrame) -> DataFrame:
    """(file, imports, imported_by): distinct neighbours of each file on both sides, in order."""
    out = edges.groupBy(F.col("src").alias("file")).agg(F.array_sort(F.collect_set("dst")).alias("imports"))
    back = edges.groupBy(F.col("dst").alias("file")).agg(F.array_sort(F.collect_set("src")).alias("imported_by"))
    none = F.array().cast("array<string>")
    both = files.select(F.col("path").alias("file")).join(out, "file", "left").join(back, "file", "left")
    return both.select("file", F.coalesce("imports", none).alias("imports"), F.coalesce("imported_by", none).alias("imported_by"))


def strongly_connected(edges: DataFrame) -> DataFrame:
    """(node, component) of the strongly connected components with more than one node; named by their smallest.

    Trimming and colouring (Orzan 2004): nodes without edges in or out go, the smallest node that reaches each
    node colours it, and the nodes of a colour that reach its root backwards are a component. Every step is a
    join with a checkpoint; found components leave the graph, so each round has fewer edges.
    """
    edges = cut(edges.select(F.col("src").cast("string"), F.col("dst").cast("string")).filter("src <> dst").distinct())
    found = None
    while True:  # each round finds one component of each colour at least
        while True:  # trim
            before = edges.count()
            inner = edges.select(F.col("dst").alias("n")).intersect(edges.select(F.col("src").alias("n")))
            edges = cut(edges.join(inner, F.col("src") == F.col("n"), "left_semi").join(inner.select(F.col("n").alias("m")), F.col("dst") == F.col("m"), "left_semi"))
            if edges.count() == before:
                break
        if not before:
            break
        colour = cut(edges.select(F.col("src").alias("n")).union(edges.select("dst")).distinct().withColumn("c", F.col("n")))
        while True:  # the smallest node that reaches each one
            step = edges.join(colour, F.col("src") == F.col("n")).groupBy("dst").agg(F.min("c").alias("d"))
            after = cut(colour.join(step, F.col("n") == F.col("dst"), "left").select("n", F.least("c", "d").alias("c"), (F.col("d") < F.col("c")).alias("moved")))
            stop = after.filter("moved").isEmpty()
            colour = after.select("n", "c")
            if stop:
                break
        same = edges.join(colour, F.col("src") == F.col("n")).select("src", "dst", "c").join(colour.select(F.col("n").alias("m"), F.col("c").alias("d")), (F.col("dst") == F.col("m")) & (F.col("c") == F.col("d")), "left_semi")
        same = cut(same)
        reached = cut(colour.filter("n = c").select("n", "c"))
        front = reached
        while not front.isEmpty():  # backwards from the roots, inside a colour
            step = same.join(front.select(F.col("n").alias("m"), F.col("c").alias("d")), (F.col("dst") == F.col("m")) & (F.col("c") == F.col("d"))).select(F.col("src").alias("n"), "c").distinct()
            front = cut(step.join(reached, ["n", "c"], "left_anti"))
            reached = cut(reached.unionByName(front))
        found = reached if found is None else found.unionByName(reached)
        gone = reached.select("n")
        edges = cut(edges.join(gone, F.col("src") == F.col("n"), "left_anti").join(gone, F.col("dst") == F.col("n"), "left_anti"))
    if found is None:
        return edges.sparkSession.createDataFrame([], "node string, component string")
    sizes = found.groupBy("c").count().filter("count > 1").select("c")
    return found.join(sizes, "c").select(F.col("n").alias("node"), F.col("c").alias("component"))


def cycle_edges(edges: DataFrame, components: DataFrame) -> DataFrame:
    """Edges whose ends lie in one strongly connected component."""
    a, b = components.select(F.col("node").alias("src"), "component"), components.select(F.col("node").alias("dst"), F.col("component").alias("other"))
    inside = edges.filter("src <> dst").join(a, "src").join(b, "dst").filter("component = other")
    return inside.drop("other")


def minimum_cuts(inner: DataFrame) -> DataFrame:
    """(component, src, dst, weight): the edge with the fewest symbols of each cycle; no symbols count as one.

    `inner`: component, src, dst, symbols (their number). Ties go to the smallest edge."""
    weight = F.when(F.col("symbols") == 0, 1).otherwise(F.col("symbols"))
    return inner.groupBy("component").agg(F.min(F.struct(weight.alias("weight"), "src", "dst")).alias("e")).select("component", "e.src", "e.dst", "e.weight")


def edge_symbols(edges: DataFrame, imports: DataFrame) -> DataFrame:
    """(src, dst, symbols): the symbols imported along each edge, from the first specifier of the file that fits the target."""
    grouped = imports.groupBy(F.col("file").alias("src"), "specifier").agg(F.min("seq").alias("first"), F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("seq", "symbols"))), lambda x: x["symbols"])).alias("symbols"))
    fits = F.col("dst").endswith(F.regexp_replace("specifier", r"^\./", "")) | F.col("dst").contains(F.col("specifier"))
    hit = edges.join(grouped, "src").filter(fits).groupBy("src", "dst").agg(F.min_by("symbols", "first").alias("symbols"))
    return edges.join(hit, ["src", "dst"], "left").withColumn("symbols", F.coalesce("symbols", F.array().cast("array<string>")))


def node_files(nodes: DataFrame, functions: DataFrame, classes: DataFrame) -> DataFrame:
    """(node, file): a node's file as a function, else as a member of a class by what stands before its first dot."""
    own = functions.groupBy(F.col("name").alias("node")).agg(F.min("file").alias("own"))
    of = classes.groupBy(F.col("name").alias("prefix")).agg(F.min("file").alias("of"))
    prefix = F.when(F.instr("node", ".") > 1, F.substring_index("node", ".", 1))
    rows = nodes.select("node", prefix.alias("prefix")).join(own, "node", "left").join(of, "prefix", "left")
    return rows.select("node", F.coalesce("own", "of").alias("file"))


def hub_scores(edges: DataFrame, exported: DataFrame, methods: DataFrame) -> DataFrame:
    """(node, hub_score): 3 for each caller, 2 for each callee, 5 if exported, 2 if a public method, -10 if private by name.

    `exported`: node. `methods`: node of public methods."""
    base = degrees(edges).join(exported.select("node", F.lit(True).alias("x")).distinct(), "node", "left").join(methods.select("node", F.lit(True).alias("y")).distinct(), "node", "left")
    private = F.element_at(F.split("node", r"\."), -1).startswith("_")
    parts = [F.col("fan_in") * 3, F.col("fan_out") * 2, F.when(F.col("x"), 5).otherwise(0), F.when(F.col("y"), 2).otherwise(0), F.when(private, -10).otherwise(0)]
    return base.select("node", reduce(lambda a, b: a + b, parts).cast("long").alias("hub_score"))


def component_hubs(components: DataFrame, scores: DataFrame) -> DataFrame:
    """(component, size, hub, members): the best hub of each component (ties: the smallest name) and its members in order."""
    rows = components.join(scores, "node", "left").withColumn("hub_score", F.coalesce("hub_score", F.lit(0)))
    return rows.groupBy("component").agg(F.count("*").alias("size"), F.min_by("node", F.struct(-F.col("hub_score"), F.col("node"))).alias("hub"), F.array_sort(F.collect_list("node")).alias("members"))


def search_clusters(results: DataFrame, edges: DataFrame) -> DataFrame:
    """(rank, name, root, size): ranked results grouped under the results that call them.

    `results`: rank, name (a short list). A result's parent is the first result that calls it, by its name or by
    what stands after a dot; roots follow parents until there is none or a node comes again. Two results or
    fewer than two stay alone."""
    order = Window.partitionBy("child").orderBy("parent_rank", "pos")
    names = results.groupBy("name").agg(F.min("rank").alias("rank"))
    calls = names.join(edges, F.col("name") == F.col("caller")).select(F.col("name").alias("parent"), F.col("rank").alias("parent_rank"), "callee", "pos")
    fits = (F.col("callee") == F.col("child")) | F.col("child").endswith(F.concat(F.lit("."), F.col("callee")))
    pairs = calls.join(names.select(F.col("name").alias("child")), fits & (F.col("child") != F.col("parent")))
    parents = pairs.withColumn("r", F.row_number().over(order)).filter("r = 1").select("child", "parent")
    at = cut(names.select("name", F.col("name").alias("root"), F.array("name").alias("path"), F.lit(False).alias("done")))
    links = cut(parents)
    while not at.filter("not done").isEmpty():  # a short list: as many rounds as the longest chain
        step = at.join(links, F.col("root") == F.col("child"), "left")
        again = F.array_contains("path", F.col("parent"))
        stop = F.col("done") | F.col("parent").isNull() | again
        root = F.when(F.col("done") | F.col("parent").isNull(), F.col("root")).when(again, F.col("parent")).otherwise(F.col("parent"))
        at = cut(step.select("name", root.alias("root"), F.when(stop, F.col("path")).otherwise(F.concat("path", F.array("parent"))).alias("path"), F.coalesce(stop, F.lit(True)).alias("done")))
    sizes = at.groupBy("root").agg(F.count("*").alias("size"))
    return names.join(at.select("name", "root"), "name").join(sizes, "root").select("rank", "name", "root", "size")


def cohesion(methods: DataFrame, properties: DataFrame) -> DataFrame:
    """(class_name, method, cluster): LCOM4; methods are linked by a declared property both use, or by a call.

    `methods`: class_name, name, instance_vars, calls. `properties`: class_name, name (declared)."""
    from sparkloom.operators.components import connected_components

    node = lambda c, m: F.concat(c, F.lit("."), m)
    used = methods.select("class_name", F.col("name").alias("method"), F.explode("instance_vars").alias("p")).join(properties.select("class_name", F.col("name").alias("p")).distinct(), ["class_name", "p"])
    first = used.groupBy("class_name", "p").agg(F.min("method").alias("hub"))
    shared = used.join(first, ["class_name", "p"]).select(node("class_name", "method").alias("src"), node("class_name", "hub").alias("dst"))
    names = methods.select("class_name", F.col("name").alias("callee")).distinct()
    called = methods.select("class_name", F.col("name").alias("method"), F.explode("calls").alias("callee")).join(names, ["class_name", "callee"]).select(node("class_name", "method").alias("src"), node("class_name", "callee").alias("dst"))
    alone = methods.select(node("class_name", "name").alias("src"), node("class_name", "name").alias("dst"))
    found = connected_components(shared.unionByName(called).unionByName(alone))
    named = methods.select("class_name", F.col("name").alias("method"), node("class_name", "name").alias("node")).distinct()
    return named.join(found, "node").select("class_name", "method", F.col("component").alias("cluster"))
