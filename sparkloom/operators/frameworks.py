"""Framework knowledge: detection from manifests, synthetic callers, routes, models, middleware.

Frameworks call code that no caller names. Rules give such callables a synthetic caller by decorator, name or
path; a rule table is small and joined by a broadcast with a bounded size (`MAX_RULES` rules).
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.functions import routes
from sparkloom.functions.expr import glob_pattern

MAX_RULES = 1000

#: (framework or "" for all, caller, decorator patterns, name patterns, path globs): fixed values.
RULES: list[tuple[str, str, list[str], list[str], list[str]]] = [
    ("", "__runtime__", [], [
        r"^__(init|del|str|repr|eq|hash|len|iter|next|getitem|setitem|contains|call|bool|enter|exit|new|lt|gt|le|ge|ne|add|sub|mul|truediv|floordiv|mod|pow|and|or|xor|invert|pos|neg|abs|index|format)__$",
        r"^constructor$"], []),
    ("celery", "__celery__", [r"^@celery\.task", r"^@shared_task", r"^@app\.task"], [], []),
    ("pytest", "__pytest__", [r"^@pytest\.fixture", r"^@pytest\.mark"], [r"^test_"], ["**/conftest.py"]),
    ("fastapi", "__fastapi__", [r"^@app\.(get|post|put|delete|patch|options|head|websocket)", r"^@router\.", r"^@.*_router\."], [r"^(lifespan|on_startup|on_shutdown)$"], []),
    ("django", "__django__", [r"^@receiver", r"^@admin\.register", r"^@login_required", r"^@csrf_exempt", r"^@require_http_methods", r"^@permission_required", r"^@(api_view|action|permission_classes)"],
        [r"^(get_queryset|get_context_data|get_object|form_valid|form_invalid|dispatch|get_serializer_class)$"], []),
    ("django-rest-framework", "__django__", [r"^@api_view", r"^@action", r"^@permission_classes"],
        [r"^(list|create|retrieve|update|partial_update|destroy|perform_create|perform_update|perform_destroy|get_queryset|get_serializer_class)$"], []),
    ("flask", "__flask__", [r"^@app\.(route|get|post|put|delete|patch)", r"^@.*\.route", r"^@login_required"], [], []),
    ("nestjs", "__nestjs__", [r"^@(Get|Post|Put|Delete|Patch|Options|Head|All)", r"^@(Controller|Injectable|Module|Middleware)", r"^@(Cron|EventPattern|MessagePattern)", r"^@(Subscribe|OnEvent)"], [], []),
    ("react", "__react__", [], [r"^(componentDidMount|componentWillUnmount|componentDidUpdate|shouldComponentUpdate|getDerivedStateFromProps|getSnapshotBeforeUpdate|render)$", r"^use[A-Z]"], []),
    ("vue", "__vue__", [], [r"^(created|mounted|unmounted|beforeMount|beforeUnmount|beforeCreate|beforeDestroy|activated|deactivated|setup)$"], ["**/composables/use*.ts", "**/composables/use*.js"]),
    ("angular", "__angular__", [], [r"^(ngOnInit|ngOnDestroy|ngOnChanges|ngAfterViewInit|ngAfterContentInit|ngDoCheck)$"], []),
    ("nuxt", "__nuxt__", [], [], ["**/composables/**", "**/server/api/**", "**/server/routes/**", "**/server/middleware/**", "**/middleware/**"]),
    ("next", "__nextjs__", [], [r"^(getServerSideProps|getStaticProps|getStaticPaths|generateMetadata|generateStaticParams)$"],
        ["**/pages/**", "**/app/**/page.tsx", "**/app/**/page.ts", "**/app/**/layout.tsx", "**/app/**/layout.ts", "**/app/**/loading.tsx", "**/app/**/error.tsx"]),
    ("langgraph", "__langgraph__", [r"^@node", r"^@edge", r"^@conditional_edge"], [], []),
    ("express", "__express__", [r"^@(Get|Post|Put|Delete|Patch|Route)"], [], []),
]

#: (framework, kind, what must be there, kind of what must not, what must not): fixed values. Kinds: npm, python, file.
SIGNALS = [
    ("nuxt", "npm", "nuxt", ""), ("nuxt", "file", "nuxt.config.ts", ""), ("nuxt", "file", "nuxt.config.js", ""), ("next", "npm", "next", ""), ("express", "npm", "express", "@nestjs/core"),
    ("nestjs", "npm", "@nestjs/core", ""), ("vue", "npm", "vue", "nuxt"), ("react", "npm", "react", "next"), ("django", "python", "django", ""), ("django", "file", "manage.py", ""),
    ("django-rest-framework", "python", "djangorestframework", ""), ("fastapi", "python", "fastapi", ""), ("flask", "python", "flask", ""), ("pydantic", "python", "pydantic", "fastapi"),
    ("prisma", "file", "prisma/schema.prisma", ""), ("sequelize", "npm", "sequelize", ""), ("mongoose", "npm", "mongoose", ""), ("typeorm", "npm", "typeorm", ""), ("sqlalchemy", "python", "sqlalchemy", ""),
    ("pinia", "npm", "pinia", ""), ("celery", "python", "celery", ""), ("pytest", "python", "pytest", ""), ("langgraph", "python", "langgraph", ""),
]


def detect(manifests: DataFrame) -> DataFrame:
    """(project, framework) found in (project, folder, path, content) of manifests and marker files.

    npm packages are keys of a package.json's dependency maps; Python ones stand anywhere in a requirements or
    pyproject file, in any case. A signal with an exclusion holds in a folder that lacks the excluded one."""
    name = F.element_at(F.split("path", "/"), -1)
    kinds = F.from_json("content", "struct<dependencies:map<string,string>,devDependencies:map<string,string>,peerDependencies:map<string,string>>")
    keys = F.array_distinct(F.flatten(F.array(*[F.coalesce(F.map_keys(kinds[k]), F.array().cast("array<string>")) for k in ("dependencies", "devDependencies", "peerDependencies")])))
    signals = manifests.sparkSession.createDataFrame(SIGNALS, "framework string, kind string, needs string, without string")
    npm = manifests.filter(name == "package.json").select("project", "folder", F.explode(keys).alias("needs"), F.lit("npm").alias("kind"))
    file = manifests.select("project", "folder", F.col("path").alias("needs"), F.lit("file").alias("kind"))
    text = manifests.filter(name.isin("requirements.txt", "pyproject.toml")).select("project", "folder", F.lower("content").alias("content"))
    python = text.join(F.broadcast(signals.filter("kind = 'python'").select("needs").union(signals.filter("kind = 'python' and without <> ''").select("without")).distinct()), F.contains(F.col("content"), F.col("needs"))).select("project", "folder", "needs", F.lit("python").alias("kind"))
    facts = npm.unionByName(file).unionByName(python).distinct()
    hit = facts.join(F.broadcast(signals), ["kind", "needs"])
    bars = facts.select("project", "folder", "kind", F.col("needs").alias("without"))
    return hit.join(bars, ["project", "folder", "kind", "without"], "left_anti").select("project", "framework").distinct()


def synthetic_edges(callables: DataFrame, frameworks: Iterable[str], user_rules: list[tuple[str, list[str], list[str], list[str]]] | None = None, strict_glob: bool = False) -> DataFrame:
    """Distinct (caller, callee): what rules of the detected frameworks, and the user's own, say is called.

    `callables`: file, name, qualified_name, decorators. A rule fits by any of its patterns."""
    active = [r[1:] for r in RULES if not r[0] or r[0] in set(frameworks)] + list(user_rules or [])
    if len(active) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    hits = []
    for caller, decorators, names, globs in active:
        either = lambda ps: "|".join(f"(?:{p})" for p in ps)
        fits = F.lit(False)
        if decorators:
            marks = F.filter(F.coalesce("decorators", F.array().cast("array<string>")), lambda d: d.rlike(either(decorators)))  # noqa: B023  used at once
            fits = fits | (F.size(marks) > 0)
        if names:
            fits = fits | F.col("name").rlike(either(names))
        if globs:
            fits = fits | F.col("file").rlike(either([glob_pattern(g, strict_glob) for g in globs]))
        hits.append(F.when(fits, F.lit(caller)))
    edges = F.array_distinct(F.array_compact(F.array(*hits)))
    return callables.select(F.explode(edges).alias("caller"), F.col("qualified_name").alias("callee")).distinct()


def merge_edges(calls: DataFrame, synthetic: DataFrame) -> DataFrame:
    """Call edges with the synthetic ones, each pair once."""
    return calls.select("caller", "callee").unionByName(synthetic).distinct()


# --- express ---------------------------------------------------------------------------------------------

#: Text inside quotes, and a character or a bracket with all that it closes, brackets inside it included.
QUOTED = r"""(?:'[^']*'|"[^"]*"|`[^`]*`)"""


def _balanced(plain: str, depth: int = 5) -> str:
    """A pattern for one step of text: a character of `plain`, a quoted text, or a balanced bracket."""
    inner = rf"(?:[^()\[\]{{}}'\"`]|{QUOTED})"
    for _ in range(depth):
        inner = rf"(?:[^()\[\]{{}}'\"`]|{QUOTED}|[(\[{{]{inner}*+[)\]}}])"
    return rf"(?:{plain}|{QUOTED}|[(\[{{]{inner}*+[)\]}}])"


ANY = _balanced(r"[^()\[\]{}'\"`]")
ARGUMENT = rf"({_balanced(r"[^,()\[\]{}'\"`]")}++)"
#: An application or a router by name.
OBJECT = r"\b(?i:app|\w*router)\s*\.\s*"
ROUTE = rf"{OBJECT}(?i:(get|post|put|delete|patch|all|options|head))\s*\(\s*['\"`]([^'\"`]+)['\"`]({ANY}*+)\)"
ROUTER = r"\b(\w+)\s*=\s*(?:\w+\s*\.\s*)?Router\s*\(\s*\)"
USE = rf"{OBJECT}(?i:use)\s*\(({ANY}*+)\)"
ERROR_HANDLER = r"function\s+(\w+)\s*\(\s*(?i:err|error)\s*,\s*\w+\s*,\s*\w+\s*,\s*\w+\s*\)"


def _all(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), group)


def express_routes(files: DataFrame) -> DataFrame:
    """(file, method, path, handler, middleware, params) of route registrations. `files`: file, content.

    The last bare argument is the handler (`anonymous` without one), those before it are middleware."""
    found = F.arrays_zip(*[_all(F.col("content"), ROUTE, k).alias(n) for k, n in ((1, "m"), (2, "p"), (3, "a"))])
    rows = files.select("file", F.posexplode(found).alias("pos", "x"))
    args = F.filter(F.transform(_all(F.col("x.a"), ARGUMENT, 1), lambda a: F.regexp_extract(F.trim(a), r"^([\w.]+)$", 1)), lambda a: a != "")
    rows = rows.select("file", "pos", F.upper("x.m").alias("method"), F.col("x.p").alias("path"), args.alias("args"))
    n = F.size("args")
    return rows.select(
        "file", "method", "path", F.coalesce(F.try_element_at("args", F.lit(-1)), F.lit("anonymous")).alias("handler"), F.slice("args", 1, F.greatest(n - 1, F.lit(0))).alias("middleware"),
        _all(F.col("path"), r":(\w+)", 1).alias("params"), "pos",
    )


def express_middleware(files: DataFrame) -> DataFrame:
    """(file, name, global, error_handler) of `use(...)` calls that mount no router, and of standalone error handlers."""
    routers = _all(F.col("content"), ROUTER, 1)
    used = files.select("file", routers.alias("routers"), F.explode(_all(F.col("content"), USE, 1)).alias("a"))
    path = F.regexp_extract("a", r"^\s*['\"`]([^'\"`]+)['\"`]", 1)
    rest = F.regexp_replace("a", r"^\s*['\"`][^'\"`]+['\"`]\s*,?\s*", "")
    name = F.regexp_extract(rest, r"^(?:function\s+)?([A-Za-z_$][\w.$]*)", 1)
    errors = F.col("a").rlike(r"function\s*\w*\s*\(\s*\w+\s*,\s*\w+\s*,\s*\w+\s*,\s*\w+")
    rows = used.select("file", "routers", path.alias("path"), F.when(name.isin("", "function"), "anonymous").otherwise(name).alias("name"), errors.alias("error_handler"))
    rows = rows.filter(~((F.col("path") != "") & F.array_contains("routers", F.col("name")))).select("file", "name", (F.col("path") == "").alias("global"), "error_handler")
    alone = files.select("file", F.explode(_all(F.col("content"), ERROR_HANDLER, 1)).alias("name")).select("file", "name", F.lit(False).alias("global"), F.lit(True).alias("error_handler"))
    return rows.unionByName(alone.join(rows.select("file", "name"), ["file", "name"], "left_anti")).distinct()


# --- next, nuxt ------------------------------------------------------------------------------------------


def next_routes(files: DataFrame) -> DataFrame:
    """(file, route, kind, params): pages (names with `_` are none), app pages and app handlers. `files`: file."""
    pages = F.col("file").rlike(r"^(?:src/)?pages/.*\.(tsx?|jsx?|mjs)$") & ~F.element_at(F.split("file", "/"), -1).startswith("_")
    api = F.col("file").rlike(r"^(?:src/)?pages/api/")
    app = F.regexp_extract("file", r"^(?:src/)?app/(?:.*/)?(page|route)\.(?:tsx?|jsx?|mjs)$", 1)
    kind = F.when(pages & api, "api").when(pages, "page").when(app == "page", "page").when(app == "route", "api")
    route = F.when(pages, routes.next_page(F.col("file"))).otherwise(routes.next_app(F.col("file")))
    rows = files.withColumn("kind", kind).filter("kind is not null").withColumn("route", route)
    return rows.select("file", "route", "kind", routes.path_params(F.col("route")).alias("params"))


def nuxt_files(files: DataFrame) -> DataFrame:
    """(file, kind, name): each file under each convention it fits; the name is a route, component, plugin, ..."""
    rows = files.select("file", F.explode(routes.nuxt_kinds(F.col("file"))).alias("kind"))
    f, k = F.col("file"), F.col("kind")
    name = (
        F.when(k == "pages", routes.nuxt_page(f)).when(k.isin("server_api", "server_routes"), routes.nuxt_server(f)).when(k == "components", routes.component_name(f))
        .when(k == "composables", routes.composable_name(f)).when(k == "plugins", routes.plugin_name(f)).when(k == "layouts", routes.layout_name(f))
        .otherwise(F.regexp_replace(F.element_at(F.split(f, "/"), -1), r"\.[^.]*$", ""))
    )
    return rows.select("file", "kind", name.alias("name"))


# --- django, fastapi -------------------------------------------------------------------------------------

#: Base classes by what a class is then (fixed values).
BASES = {
    "model": "Model models.Model django.db.models.Model AbstractUser AbstractBaseUser PermissionsMixin TimeStampedModel UUIDModel",
    "view": "View TemplateView DetailView ListView CreateView UpdateView DeleteView FormView RedirectView ArchiveIndexView YearArchiveView MonthArchiveView DayArchiveView DateDetailView GenericAPIView APIView ViewSet ModelViewSet ReadOnlyModelViewSet GenericViewSet ListAPIView RetrieveAPIView CreateAPIView DestroyAPIView UpdateAPIView ListCreateAPIView RetrieveUpdateAPIView RetrieveDestroyAPIView RetrieveUpdateDestroyAPIView",
    "middleware": "MiddlewareMixin BaseMiddleware",
    "form": "Form forms.Form ModelForm forms.ModelForm BaseForm BaseModelForm",
    "serializer": "Serializer ModelSerializer HyperlinkedModelSerializer ListSerializer BaseSerializer serializers.Serializer serializers.ModelSerializer serializers.HyperlinkedModelSerializer",
    "admin": "ModelAdmin admin.ModelAdmin TabularInline StackedInline admin.TabularInline admin.StackedInline",
    "pydantic": "BaseModel pydantic.BaseModel BaseSettings SQLModel",
}
KIND_OF_BASE = {b: k for k, bases in BASES.items() for b in bases.split()}
#: Relationship by field type (fixed values).
RELATIONS = {"ForeignKey": "foreign_key", "OneToOneField": "one_to_one", "ManyToManyField": "many_to_many", "GenericForeignKey": "generic_relation", "GenericRelation": "generic_relation"}


def class_kinds(classes: DataFrame) -> DataFrame:
    """(file, name, kind) of classes with a known base. `classes`: file, name, extends, implements."""
    table = F.create_map(*[F.lit(x) for pair in KIND_OF_BASE.items() for x in pair])
    bases = F.concat(F.array("extends"), F.coalesce("implements", F.array().cast("array<string>")))
    kinds = F.array_compact(F.transform(F.array_compact(bases), lambda b: F.try_element_at(table, b)))
    return classes.select("file", "name", F.explode(F.array_distinct(kinds)).alias("kind"))


def model_fields(classes: DataFrame, properties: DataFrame) -> DataFrame:
    """(file, model, field, type, relationship, related) of the models' fields. `properties`: file, class_name, name, type."""
    models = class_kinds(classes).filter(F.col("kind").isin("model", "serializer", "pydantic")).select("file", F.col("name").alias("class_name"))
    table = F.create_map(*[F.lit(x) for pair in RELATIONS.items() for x in pair])
    kind = F.regexp_extract("type", r"(\w+)\s*(?:\(|$)", 1)
    related = F.regexp_extract("type", r"\(\s*['\"]?([\w.]+)", 1)
    rows = properties.join(models.distinct(), ["file", "class_name"])
    return rows.select("file", F.col("class_name").alias("model"), F.col("name").alias("field"), kind.alias("type"), F.try_element_at(table, kind).alias("relationship"), F.when(F.try_element_at(table, kind).isNotNull() & (related != ""), related).alias("related"))


SIGNAL = r"^@?receiver\(\s*\[?\s*([\w.]+)"


def django_signals(callables: DataFrame) -> DataFrame:
    """(file, handler, signal, sender) of `@receiver` decorators."""
    rows = callables.select("file", F.col("qualified_name").alias("handler"), F.explode("decorators").alias("d")).filter(F.col("d").rlike(SIGNAL))
    sender = F.regexp_extract("d", r"sender\s*=\s*([\w.]+)", 1)
    return rows.select("file", "handler", F.regexp_extract("d", SIGNAL, 1).alias("signal"), F.when(sender != "", sender).alias("sender"))


def django_commands(classes: DataFrame) -> DataFrame:
    """(file, name) of management commands."""
    return classes.filter(F.col("file").contains("management/commands/") & (F.col("name") == "Command")).select("file", F.regexp_extract("file", r"([^/]+)\.py$", 1).alias("name"))


FAST_ROUTE = r"^@?(\w+)\.(get|post|put|delete|patch|options|head|websocket|api_route)\(\s*['\"]([^'\"]*)['\"]"


def fastapi_routes(callables: DataFrame) -> DataFrame:
    """(file, method, path, handler, response_model, auth, dependencies) of route decorators."""
    rows = callables.select("file", F.col("qualified_name").alias("handler"), F.explode("decorators").alias("d"), "params").filter(F.col("d").rlike(FAST_ROUTE))
    verb = F.regexp_extract("d", FAST_ROUTE, 2)
    response = F.regexp_extract("d", r"response_model\s*=\s*([\w\[\], .|]+?)\s*(?:,\s*\w+\s*=|\)$)", 1)
    many = F.regexp_extract_all(F.regexp_extract("d", r"methods\s*=\s*\[([^\]]*)\]", 1), F.lit(r"['\"](\w+)['\"]"), 1)
    method = F.when(verb == "websocket", F.array(F.lit("WS"))).when(verb == "api_route", F.transform(many, F.upper)).otherwise(F.array(F.upper(verb)))
    named = F.transform("params", lambda p: F.regexp_extract_all(F.concat_ws(" ", p["type"], p["default"]), F.lit(r"Depends\((\w+)"), 1))
    depends = F.array_distinct(F.flatten(F.coalesce(named, F.array().cast("array<array<string>>"))))
    auth = F.exists(depends, lambda d: F.lower(d).rlike("auth|current_user|token|security"))
    return rows.select("file", "handler", method.alias("methods"), F.regexp_extract("d", FAST_ROUTE, 3).alias("path"), F.when(response != "", response).alias("response_model"), depends.alias("dependencies"), auth.alias("auth"))


def dependency_providers(callables: DataFrame, routes_: DataFrame) -> DataFrame:
    """(file, provider, used_by): functions that routes depend on."""
    used = routes_.select("handler", F.explode("dependencies").alias("name")).groupBy("name").agg(F.array_sort(F.collect_set("handler")).alias("used_by"))
    return callables.join(used, "name").select("file", F.col("name").alias("provider"), "used_by")


def link_urls(patterns: DataFrame, routes_: DataFrame) -> DataFrame:
    """Routes with the URL of the last pattern whose handler they have or end with; each pattern takes the first such route.

    `patterns`: handler, url, seq. `routes_`: handler, seq and more."""
    # A route is found by its handler and by what follows each dot of it, so that the join is one of equal keys.
    words = F.split("handler", r"\.")
    ends = F.transform(F.sequence(F.lit(1), F.size(words)), lambda k: F.array_join(F.slice(words, k, F.size(words)), "."))
    named = routes_.select("seq", F.explode(ends).alias("end")).alias("r")
    first = patterns.alias("p").join(named, F.col("p.handler") == F.col("r.end"))
    first = first.groupBy(F.col("p.seq").alias("pattern"), F.col("p.url").alias("url")).agg(F.min("r.seq").alias("seq"))
    last = first.groupBy("seq").agg(F.max_by("url", "pattern").alias("url"))
    return routes_.join(last, "seq", "left")


# --- more of django, fastapi and nuxt --------------------------------------------------------------------

#: Template-tag kinds by decorator (fixed values).
TAGS = {"simple_tag": "simple_tag", "inclusion_tag": "inclusion_tag", "filter": "filter", "tag": "block_tag"}


def template_tags(callables: DataFrame) -> DataFrame:
    """(file, name, kind) of functions registered as template tags."""
    table = F.create_map(*[F.lit(x) for pair in TAGS.items() for x in pair])
    rows = callables.filter(F.col("file").contains("templatetags/") & F.col("class_name").isNull()).select("file", "name", F.explode("decorators").alias("d"))
    kind = F.try_element_at(table, F.regexp_extract("d", r"^@?(?:register\.)?(\w+)(?:\(|$)", 1))
    return rows.select("file", "name", kind.alias("kind")).filter("kind is not null").distinct()


def django_views(classes: DataFrame, callables: DataFrame) -> DataFrame:
    """(file, view, methods, kind): class-based views with their HTTP methods, and functions with a view's decorator or a first `request`."""
    verbs = ["get", "post", "put", "patch", "delete", "head", "options"]
    views = class_kinds(classes).filter("kind = 'view'").select("file", F.col("name").alias("class_name")).distinct()
    own = callables.filter(F.col("name").isin(*verbs)).groupBy("file", "class_name").agg(F.array_sort(F.collect_set(F.upper("name"))).alias("methods"))
    by_class = views.join(own, ["file", "class_name"], "left").select("file", F.col("class_name").alias("view"), F.coalesce("methods", F.array(F.lit("ALL"))).alias("methods"), F.lit("class").alias("kind"))
    marks = F.filter("decorators", lambda d: d.rlike(r"^@?(?:[\w.]+\.)?(login_required|permission_required|user_passes_test|csrf_exempt|csrf_protect|require_http_methods|require_GET|require_POST|require_safe|api_view|action)\b"))
    listed = F.transform(F.flatten(F.transform(marks, lambda d: F.regexp_extract_all(d, F.lit(r"['\"]([A-Za-z]+)['\"]"), 1))), F.upper)
    first = F.try_element_at("params", F.lit(1))["name"] == "request"
    answers = F.exists("calls", lambda c: c.rlike(r"(?i)(^|\.)(render|redirect|\w*Response|get_object_or_404)$"))
    functions = callables.filter(F.col("class_name").isNull() & ((F.size(marks) > 0) | (first & answers)))
    by_function = functions.select("file", F.col("name").alias("view"), F.when(F.size(listed) > 0, F.array_distinct(listed)).otherwise(F.array(F.lit("ALL"))).alias("methods"), F.lit("function").alias("kind"))
    return by_class.unionByName(by_function)


def django_middleware(classes: DataFrame, callables: DataFrame) -> DataFrame:
    """(file, name): classes with a middleware base, or with both `__init__` and `__call__`."""
    based = class_kinds(classes).filter("kind = 'middleware'").select("file", "name")
    both = callables.filter("class_name is not null").groupBy("file", F.col("class_name").alias("name")).agg(F.bool_or(F.col("name") == "__call__").alias("c"), F.bool_or(F.col("name") == "__init__").alias("i")).filter("c and i").select("file", "name")
    return based.unionByName(both).distinct()


def forms(classes: DataFrame, callables: DataFrame) -> DataFrame:
    """(file, form, validators): forms with their `clean_*` methods."""
    checks = callables.filter(F.col("name").startswith("clean_")).groupBy("file", F.col("class_name").alias("form")).agg(F.array_sort(F.collect_set("name")).alias("validators"))
    rows = class_kinds(classes).filter("kind = 'form'").select("file", F.col("name").alias("form")).distinct().join(checks, ["file", "form"], "left")
    return rows.withColumn("validators", F.coalesce("validators", F.array().cast("array<string>")))


def admin_registrations(classes: DataFrame, callables: DataFrame, module_calls: DataFrame) -> DataFrame:
    """(file, admin, model): admin classes with the model they are registered for. `module_calls`: file, call."""
    admins = class_kinds(classes).filter("kind = 'admin'").select("file", F.col("name").alias("admin")).distinct()
    pattern = r"admin\.site\.register\(\s*(\w+)\s*(?:,\s*(\w+))?"
    called = module_calls.filter(F.col("call").rlike(pattern)).select(F.regexp_extract("call", pattern, 2).alias("admin"), F.regexp_extract("call", pattern, 1).alias("model"))
    marked = classes.select("name", F.explode("decorators").alias("d")).select(F.col("name").alias("admin"), F.regexp_extract("d", r"^@?admin\.register\(\s*(\w+)", 1).alias("model")).filter("model <> ''")
    models = called.unionByName(marked).groupBy("admin").agg(F.min("model").alias("model"))
    return admins.join(models, "admin", "left").select("file", "admin", "model")


#: Where a parameter comes from by a marker in its type (fixed values, in this order).
PARAM_PLACES = [("Query", "query"), ("Path", "path"), ("Body", "body"), ("Header", "header"), ("Cookie", "cookie"), ("Form", "body"), ("File", "body"), ("UploadFile", "body"), ("Depends", "")]


def fastapi_params(callables: DataFrame) -> DataFrame:
    """(file, handler, name, type, required, location) of a route handler's parameters; dependencies are none."""
    rows = callables.filter(F.exists("decorators", lambda d: d.rlike(FAST_ROUTE))).select("file", F.col("qualified_name").alias("handler"), F.explode("params").alias("p"))
    place = F.lit("query")
    for marker, where in reversed(PARAM_PLACES):
        place = F.when(F.contains(F.col("p.type"), F.lit(marker)), where).otherwise(place)
    out = rows.filter(~F.col("p.name").isin("self", "cls")).select("file", "handler", F.col("p.name").alias("name"), F.col("p.type").alias("type"), (~F.coalesce("p.optional", F.lit(False)) & F.col("p.default").isNull()).alias("required"), place.alias("location"))
    return out.filter("location <> ''")


def fastapi_hooks(callables: DataFrame) -> DataFrame:
    """(file, key, name, kind): middleware, event handlers (`event:` keys) and exception handlers (`exception:` keys)."""
    rows = callables.filter("class_name is null").select("file", "name", F.explode("decorators").alias("d"))
    event = F.regexp_extract("d", r"^@?(?:app\.)?on_event\(\s*['\"](\w+)", 1)
    kinds = F.array_compact(F.array(
        F.when(F.contains("d", F.lit("middleware")), F.struct(F.col("name").alias("key"), F.lit("middleware").alias("kind"))),
        F.when(F.col("d").rlike(r"^@?(?:app\.)?on_event\b"), F.struct(F.concat(F.lit("event:"), "name").alias("key"), F.when(event == "", "lifecycle").otherwise(event).alias("kind"))),
        F.when(F.contains("d", F.lit("exception_handler")), F.struct(F.concat(F.lit("exception:"), "name").alias("key"), F.lit("exception_handler").alias("kind"))),
    ))
    return rows.select("file", "name", F.explode(kinds).alias("k")).select("file", "k.key", "name", "k.kind").distinct()


def page_meta(files: DataFrame) -> DataFrame:
    """(file, layout, middleware) of `definePageMeta({...})` in a page's text. `files`: file, content."""
    meta = F.regexp_extract("content", r"(?s)definePageMeta\(\s*\{(.*?)\}\s*\)", 1)
    layout = F.regexp_extract(meta, r"layout\s*:\s*['\"]([^'\"]+)['\"]", 1)
    many = F.regexp_extract_all(F.regexp_extract(meta, r"middleware\s*:\s*\[([^\]]*)\]", 1), F.lit(r"['\"]([^'\"]+)['\"]"), 1)
    single = F.regexp_extract(meta, r"middleware\s*:\s*['\"]([^'\"]+)['\"]", 1)
    middleware = F.when(F.size(many) > 0, many).when(single != "", F.array(single)).otherwise(F.array().cast("array<string>"))
    return files.select("file", F.when(layout != "", layout).alias("layout"), middleware.alias("middleware")).filter("layout is not null or size(middleware) > 0")


def used_by(definitions: DataFrame, uses: DataFrame) -> DataFrame:
    """(name, file, used_by): layouts or components with the files that use them. `definitions`: name, file. `uses`: file, name."""
    lists = uses.groupBy("name").agg(F.array_sort(F.collect_set("file")).alias("used_by"))
    return definitions.join(lists, "name", "left").withColumn("used_by", F.coalesce("used_by", F.array().cast("array<string>")))


def component_uses(callables: DataFrame) -> DataFrame:
    """(file, name): calls that look like components of a template."""
    return callables.select("file", F.explode("calls").alias("name")).filter(F.col("name").rlike("^[A-Z][a-zA-Z]+$")).distinct()


def pinia_stores(callables: DataFrame, imports: DataFrame) -> DataFrame:
    """(file, stores): files that import the store library and define stores, with the exported names."""
    importing = imports.filter(F.col("specifier").isin("pinia", "#imports")).select("file").distinct()
    defining = callables.groupBy("file").agg(F.bool_or(F.array_contains("calls", "defineStore")).alias("defines"), F.array_sort(F.collect_set(F.when(F.col("exported"), F.col("name")))).alias("stores"))
    return defining.filter("defines").join(importing, "file", "left_semi").select("file", "stores")


#: Compiler macros of single-file components and plain calls that stand for them (fixed patterns, in order).
VUE_MACROS = [
    (r"withDefaults\(\s*defineProps<[^>]*>\(\)\s*,", "__withDefaults("), (r"defineProps<[^>]*>\(\)", "__defineProps()"), (r"defineProps\(", "__defineProps("), (r"defineEmits<[^>]*>\(\)", "__defineEmits()"),
    (r"defineEmits\(", "__defineEmits("), (r"defineModel(?:<[^>]*>)?\(", "__defineModel("), (r"defineExpose\(", "__defineExpose("), (r"defineSlots(?:<[^>]*>)?\(", "__defineSlots("), (r"defineOptions\(", "__defineOptions("),
]


def plain_vue(content: Column) -> Column:
    """A component's script with compiler macros as plain calls."""
    for pattern, put in VUE_MACROS:
        content = F.regexp_replace(content, pattern, put)
    return content
