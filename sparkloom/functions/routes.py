"""Routes and names from the paths of files, by the conventions of web frameworks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _chain(text: Column, *steps: tuple[str, str]) -> Column:
    for pattern, put in steps:
        text = F.regexp_replace(text, pattern, put)
    return text


def _no_index(route: Column) -> Column:
    route = F.regexp_replace(route, r"/index$", "")
    return F.when(route == "index", "").otherwise(route)


#: Dynamic parts of a path: `[x]`, `[...x]`, `[[...x]]`, `[[x]]` (fixed conventions, in this order).
NUXT_PARTS = ((r"\[\[\.\.\.([^\]]+)\]\]", r":$1(.*)*"), (r"\[\.\.\.([^\]]+)\]", r":$1(.*)"), (r"\[\[([^\]]+)\]\]", r":$1?"), (r"\[([^\]]+)\]", r":$1"))
NEXT_PARTS = ((r"\[\[\.\.\.([^\]]+)\]\]", r":$1(.*)?"), (r"\[\.\.\.([^\]]+)\]", r":$1(.*)"), (r"\[([^\]]+)\]", r":$1"), (r"(?:^|/)\([^)]+\)", ""))
NEXT_LEAVES = "page|route|layout|loading|error|not-found|template|default"
EXTENSIONS = r"\.(tsx?|jsx?|mjs)$"


def nuxt_page(path: Column) -> Column:
    bare = _chain(path, (r"^(?:src/)?pages/", ""), (r"\.vue$", ""), (r"\.tsx?$", ""))
    return F.concat(F.lit("/"), _chain(_no_index(bare), *NUXT_PARTS))


def nuxt_server(path: Column) -> Column:
    bare = _chain(path, (r"^(?:src/)?server/(?:api|routes)/", ""), (r"\.(?:ts|js|mjs)$", ""))
    return F.concat(F.lit("/api/"), _chain(_no_index(bare), *NUXT_PARTS))


def next_page(path: Column) -> Column:
    bare = _chain(path, (r"^(?:src/)?pages/", ""), (EXTENSIONS, ""))
    return F.concat(F.lit("/"), _chain(_no_index(bare), *NEXT_PARTS))


def next_app(path: Column) -> Column:
    bare = _chain(path, (r"^(?:src/)?app/", ""), (EXTENSIONS, ""), (rf"/({NEXT_LEAVES})$", ""))
    bare = F.when(bare.rlike(rf"^({NEXT_LEAVES})$"), "").otherwise(bare)
    route = _chain(F.concat(F.lit("/"), _chain(bare, *NEXT_PARTS)), (r"/+", "/"), (r"/$", ""))
    return F.when(route == "", "/").otherwise(route)


def path_params(route: Column) -> Column:
    """(name, required) of each `:name` part."""
    names = F.regexp_extract_all(route, F.lit(r":([^(/]+)"), 1)
    return F.transform(names, lambda n: F.struct(F.regexp_replace(n, r"\?", "").alias("name"), (~n.endswith("?")).alias("required")))


def component_name(path: Column) -> Column:
    parts = F.split(_chain(path, (r"^(?:src/)?components/", ""), (r"\.vue$", ""), (r"\.tsx?$", "")), "/")
    return F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, 2, 1_000_000))), "")


def _leaf(path: Column, folder: str, *more: tuple[str, str]) -> Column:
    return F.element_at(F.split(_chain(path, (rf"^(?:src/)?{folder}/", ""), *more), "/"), -1)


def composable_name(path: Column) -> Column:
    return _leaf(path, "composables", (r"\.(?:ts|js|mjs)$", ""))


def plugin_name(path: Column) -> Column:
    return _leaf(path, "plugins", (r"\.(client|server)", ""), (r"\.(?:ts|js|mjs)$", ""))


def plugin_mode(path: Column) -> Column:
    return F.when(path.contains(".client."), "client").when(path.contains(".server."), "server").otherwise("universal")


def layout_name(path: Column) -> Column:
    return _leaf(path, "layouts", (r"\.vue$", ""), (r"\.tsx?$", ""))


#: Folders by what Nuxt takes their files for (fixed patterns).
NUXT_FOLDERS = {
    "pages": r"^(?:src/)?pages/", "components": r"^(?:src/)?components/", "composables": r"^(?:src/)?composables/", "middleware": r"^(?:src/)?middleware/",
    "layouts": r"^(?:src/)?layouts/", "plugins": r"^(?:src/)?plugins/", "server_api": r"^(?:src/)?server/api/", "server_middleware": r"^(?:src/)?server/middleware/",
    "server_routes": r"^(?:src/)?server/routes/", "server_plugins": r"^(?:src/)?server/plugins/", "stores": r"^(?:src/)?stores?/", "utils": r"^(?:src/)?utils/",
}


def nuxt_kinds(path: Column) -> Column:
    """All folders of the conventions that a path lies in."""
    return F.array_compact(F.array(*[F.when(path.rlike(p), F.lit(k)) for k, p in NUXT_FOLDERS.items()]))
