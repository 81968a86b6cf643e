"""Extractors: a file's text to its functions, classes, imports, exports and types, as one nested record.

Python goes through the standard `ast`; TypeScript, JavaScript, Vue, Go and Rust through one scanner that blanks
strings and comments, finds declarations by pattern and their bodies by matching braces. The record's types
are what the source writes; nothing is inferred. A file that can't be read gives a record with `error` set
and no entities, and never fails its task. One Arrow pass, memory bounded by a batch of files.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.session import shipped

PARAM = "struct<name:string,type:string,optional:boolean,default:string>"
CALLABLE = (
    f"struct<name:string,class_name:string,kind:string,params:array<{PARAM}>,return_type:string,access:string,is_async:boolean,is_static:boolean,exported:boolean,"
    "decorators:array<string>,calls:array<string>,complexity:int,line_count:int,nesting_depth:int,instance_vars:array<string>>"
)
RECORD = (
    f"path string, language string, callables array<{CALLABLE}>, classes array<struct<name:string,extends:string,implements:array<string>,decorators:array<string>>>, "
    "properties array<struct<class_name:string,name:string,type:string,access:string>>, imports array<struct<specifier:string,symbols:array<string>,is_default:boolean,is_namespace:boolean>>, "
    "exports array<struct<name:string,kind:string>>, types array<struct<name:string,kind:string,extends:array<string>>>, env_vars array<string>, module_calls array<string>, error string"
)
EMPTY = {k: [] for k in ("callables", "classes", "properties", "imports", "exports", "types", "env_vars", "module_calls")}


def _distinct(items) -> list:
    return list(dict.fromkeys(items))


def _callable(name, class_name=None, **more) -> dict:
    base = {
        "name": name, "class_name": class_name, "kind": "method" if class_name else "function", "params": [], "return_type": "", "access": "public", "is_async": False, "is_static": False,
        "exported": False, "decorators": [], "calls": [], "complexity": 1, "line_count": 1, "nesting_depth": 0, "instance_vars": [],
    }
    return base | more


# --- Python ----------------------------------------------------------------------------------------------

BRANCHES = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.ExceptHandler, ast.IfExp, ast.comprehension)
NESTING = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.Try, ast.With, ast.AsyncWith)
ENV = [
    r"os\.environ\.get\(\s*['\"](\w+)['\"]", r"os\.environ\[\s*['\"](\w+)['\"]\s*\]", r"os\.getenv\(\s*['\"](\w+)['\"]",
    r"(?<![\w.])environ\[\s*['\"](\w+)['\"]\s*\]", r"(?<![\w.])getenv\(\s*['\"](\w+)['\"]",
]


def _complexity(body: list[ast.AST]) -> int:
    total = 1
    for node in (n for b in body for n in ast.walk(b)):
        total += isinstance(node, BRANCHES)
        if isinstance(node, ast.BoolOp):
            total += len(node.values) - 1
    return total


def _nesting(body: list[ast.AST], depth: int = 0) -> int:
    """Levels of control flow; an `elif` is no level of its own."""
    deepest = depth
    for node in body:
        if isinstance(node, ast.If):
            deepest = max(deepest, _nesting(node.body, depth + 1))
            chain = node.orelse
            deepest = max(deepest, _nesting(chain, depth) if len(chain) == 1 and isinstance(chain[0], ast.If) else _nesting(chain, depth + 1) if chain else 0)
        elif isinstance(node, NESTING):
            for part in ("body", "orelse", "finalbody", "handlers"):
                inner = getattr(node, part, [])
                deepest = max(deepest, _nesting(inner, depth + 1) if inner else 0)
        else:
            deepest = max(deepest, _nesting(list(ast.iter_child_nodes(node)), depth))
    return deepest


def _python_params(a: ast.arguments, method: bool) -> list[dict]:
    text = lambda n: ast.unparse(n) if n is not None else None
    plain = [*a.posonlyargs, *a.args]
    defaults = [None] * (len(plain) - len(a.defaults)) + list(a.defaults)
    rows = [(x.arg, x.annotation, d) for x, d in zip(plain, defaults, strict=True)]
    rows += [(f"*{a.vararg.arg}", a.vararg.annotation, None)] if a.vararg else []
    rows += [(x.arg, x.annotation, d) for x, d in zip(a.kwonlyargs, a.kw_defaults, strict=True)]
    rows += [(f"**{a.kwarg.arg}", a.kwarg.annotation, None)] if a.kwarg else []
    if method and rows and rows[0][0] in ("self", "cls"):
        rows = rows[1:]
    return [{"name": n, "type": text(t) or "any", "optional": d is not None, "default": text(d)} for n, t, d in rows]


def _python_callable(node, class_name: str | None) -> dict:
    calls = [ast.unparse(n.func) for b in node.body for n in ast.walk(b) if isinstance(n, ast.Call)]
    used = [n.attr for b in node.body for n in ast.walk(b) if isinstance(n, ast.Attribute) and isinstance(n.value, ast.Name) and n.value.id == "self"]
    decorators = ["@" + ast.unparse(d) for d in node.decorator_list]
    private = "private" if node.name.startswith("__") and not node.name.endswith("__") else "protected" if node.name.startswith("_") and not node.name.startswith("__") else "public"
    return _callable(
        node.name, class_name, params=_python_params(node.args, bool(class_name)), return_type=ast.unparse(node.returns) if node.returns else "None", access=private if class_name else "public",
        is_async=isinstance(node, ast.AsyncFunctionDef), is_static=any(d in ("@staticmethod", "@classmethod") for d in decorators), exported=not node.name.startswith("_") if not class_name else private == "public",
        decorators=decorators, calls=_distinct(re.sub(r"^self\.", "", c) for c in calls), complexity=_complexity(node.body), line_count=node.end_lineno - node.lineno + 1, nesting_depth=_nesting(node.body), instance_vars=_distinct(used),
    )


def python(text: str) -> dict:
    tree, out = ast.parse(text), {k: [] for k in EMPTY}
    functions = (ast.FunctionDef, ast.AsyncFunctionDef)
    for node in tree.body:
        if isinstance(node, functions):
            out["callables"].append(_python_callable(node, None))
        elif isinstance(node, ast.ClassDef):
            bases = [ast.unparse(b) for b in node.bases]
            out["classes"].append({"name": node.name, "extends": bases[0] if bases else None, "implements": bases[1:], "decorators": ["@" + ast.unparse(d) for d in node.decorator_list]})
            for item in node.body:
                if isinstance(item, functions):
                    out["callables"].append(_python_callable(item, node.name))
                elif isinstance(item, ast.AnnAssign) and isinstance(item.target, ast.Name):
                    out["properties"].append({"class_name": node.name, "name": item.target.id, "type": ast.unparse(item.annotation), "access": "private" if item.target.id.startswith("_") else "public"})
                elif isinstance(item, ast.Assign):
                    out["properties"] += [{"class_name": node.name, "name": t.id, "type": "unknown", "access": "private" if t.id.startswith("_") else "public"} for t in item.targets if isinstance(t, ast.Name)]
        elif isinstance(node, ast.Assign) and isinstance(node.value, ast.Call) and isinstance(node.targets[0], ast.Name) and ast.unparse(node.value.func).split(".")[-1] in ("TypedDict", "NamedTuple"):
            out["types"].append({"name": node.targets[0].id, "kind": "type", "extends": []})
    for node in ast.walk(tree):
        if isinstance(node, ast.Import):
            out["imports"] += [{"specifier": a.name, "symbols": [a.asname or a.name], "is_default": False, "is_namespace": True} for a in node.names]
        elif isinstance(node, ast.ImportFrom):
            names = [a.asname or a.name for a in node.names]
            out["imports"].append({"specifier": "." * node.level + (node.module or ""), "symbols": names, "is_default": False, "is_namespace": names == ["*"]})
    listed = re.search(r"(?s)__all__\s*=\s*[\[(](.*?)[\])]", text)
    if listed:
        out["exports"] = [{"name": n, "kind": "variable"} for n in re.findall(r"['\"](\w+)['\"]", listed[1])]
    else:
        out["exports"] = [{"name": c["name"], "kind": "function"} for c in out["callables"] if not c["class_name"] and c["exported"]]
        out["exports"] += [{"name": c["name"], "kind": "class"} for c in out["classes"] if not c["name"].startswith("_")]
    out["env_vars"] = _distinct(m for p in ENV for m in re.findall(p, text))
    return out


# --- languages with braces -------------------------------------------------------------------------------

COMMENTS = re.compile(r"//[^\n]*|/\*.*?\*/", re.S)
STRINGS = re.compile(r"\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`", re.S)
RUST_STRINGS = re.compile(r"\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])'", re.S)
CALL = re.compile(r"(?<![\w.])((?:[A-Za-z_$][\w$]*(?:\?\.|::|\.))*[A-Za-z_$][\w$]*)!?\s*(?:<[\w, ]+>)?\(")
KEYWORDS = {
    "typescript": frozenset("if for while switch catch return function typeof new await super import constructor async else do in of as".split()),
    "go": frozenset("if for switch return func go defer select case".split()),
    "rust": frozenset("if for while loop match return fn as where impl in".split()),
}
CONTROL = {
    "typescript": (re.compile(r"\b(?:if|for|while|case|catch|do)\b|\?(?![.?:])[^:\n]*:|&&|\|\||\?\?"), re.compile(r"\b(?:if|else|for|while|switch|try|do|catch)\b")),
    "go": (re.compile(r"\b(?:if|for|case)\b"), re.compile(r"\b(?:if|for|switch|select)\b")),
    "rust": (re.compile(r"\b(?:if|for|while|loop)\b|=>"), re.compile(r"\b(?:if|for|while|loop|match)\b")),
}


def blanked(text: str, language: str) -> str:
    """The text with comments and the insides of strings blanked, places unchanged."""
    blank = lambda m: re.sub(r"[^\n]", " ", m[0])
    inside = lambda m: m[0][0] + re.sub(r"[^\n]", " ", m[0][1:-1]) + m[0][-1]
    both = re.compile(f"(?P<c>{COMMENTS.pattern})|{(RUST_STRINGS if language == 'rust' else STRINGS).pattern}", re.S)
    return both.sub(lambda m: blank(m) if m["c"] else inside(m), text)


def closing(text: str, at: int, pair: str = "{}") -> int:
    """The place of what closes the bracket at `at`; the end of the text if nothing does."""
    depth = 0
    for k in range(at, len(text)):
        depth += (text[k] == pair[0]) - (text[k] == pair[1])
        if not depth:
            return k
    return len(text) - 1


def _head(body: str, brace: int) -> str:
    """What stands before an opening brace: its line after any other brace, and lines before while brackets stay open."""
    start = max(body.rfind(c, 0, brace) for c in "{}\n") + 1
    while start > 1 and body.count(")", start, brace) > body.count("(", start, brace) and body[start - 1] == "\n":
        start = max(body.rfind(c, 0, start - 1) for c in "{}\n") + 1
    return body[start:brace]


def _metrics(body: str, language: str, receiver: str | None) -> dict:
    decisions, control = CONTROL[language]
    depth = deepest = 0
    stack = []
    for m in re.finditer(r"[{}]", body):
        if m[0] == "{":
            opens = bool(control.search(_head(body, m.start())))
            stack.append(opens)
            depth += opens
            deepest = max(deepest, depth)
        elif stack:
            depth -= stack.pop()
    calls = [re.sub(rf"^(?:this|self{'|' + receiver if receiver else ''})\.", "", c) for c in CALL.findall(body)]
    calls = [c for c in calls if c.split(".")[-1].split("::")[-1] not in KEYWORDS[language]]
    own = re.findall(r"\bthis\.(\w+)" if language == "typescript" else r"\bself\.(\w+)", body)
    return {"calls": _distinct(calls), "complexity": 1 + len(decisions.findall(body)), "nesting_depth": deepest, "instance_vars": _distinct(own)}


def split_top(text: str) -> list[str]:
    """Parts at commas outside of brackets."""
    parts, depth, start = [], 0, 0
    for k, c in enumerate(text):
        depth += (c in "([{<") - (c in ")]}>" and not text[k - 1 : k] in ("=", "-"))
        if c == "," and depth == 0:
            parts.append(text[start:k])
            start = k + 1
    return [p.strip() for p in [*parts, text[start:]] if p.strip()]


def _colon_params(text: str) -> list[dict]:
    out = []
    for part in split_top(text):
        if re.fullmatch(r"&?\s*(?:'\w+\s+)?(?:mut\s+)?self", part):
            continue
        left, _, default = part.partition("=") if "=>" not in part else (part, "", "")
        name, _, kind = left.partition(":")
        name = re.sub(r"^(?:public|private|protected|readonly|mut)\s+", "", name.strip())
        out.append({"name": name.rstrip("?").strip(), "type": kind.strip() or "any", "optional": name.endswith("?") or bool(default), "default": default.strip() or None})
    return out


def _body(text: str, blank: str, start: int, language: str, receiver: str | None = None) -> tuple[dict, int]:
    """Metrics of the callable whose text starts at `start`, and where it ends."""
    brace = blank.find("{", start)
    end = closing(blank, brace) if brace >= 0 else len(blank) - 1
    return _metrics(blank[brace + 1 : end], language, receiver) | {"line_count": text.count("\n", start, end) + 1}, end


def typescript(text: str) -> dict:
    out, blank = {k: [] for k in EMPTY}, blanked(text, "typescript")
    spans = []
    for m in re.finditer(r"((?:@\w+(?:\([^)]*\))?\s+)*)(export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+(\w+)(?:<[^>{]*>)?(?:\s+extends\s+([\w.]+)(?:<[^>{]*>)?)?(?:\s+implements\s+([^{]+))?\s*\{", blank):
        end = closing(blank, m.end() - 1)
        spans.append((m.start(), end))
        out["classes"].append({"name": m[3], "extends": m[4], "implements": split_top(m[5] or ""), "decorators": re.findall(r"@\w+(?:\([^)]*\))?", text[m.start(1) : m.end(1)])})
        if m[2]:
            out["exports"].append({"name": m[3], "kind": "class"})
        at = m.end()
        member = re.compile(r"((?:@\w+(?:\([^)]*\))?\s+)*)((?:(?:public|private|protected|static|async|readonly|abstract|override)\s+)*)(#?\w+)\s*(?:<[^>(]*>)?\(([^)]*)\)\s*(?::\s*([^{;=]+?))?\s*\{")
        field_ = re.compile(r"(?:^|[;{}\n])\s*((?:(?:public|private|protected|static|readonly)\s+)*)(#?\w+)[?!]?\s*(?::\s*([^=;\n]+))?\s*(?:=|;|\n)")
        gaps = []
        while (n := member.search(blank, at, end)) is not None:
            gaps.append(blank[at : n.start()])
            more, stop = _body(text, blank, n.end() - 1, "typescript")
            access = next((a for a in ("private", "protected") if a in n[2]), "private" if n[3].startswith("#") else "public")
            if n[3] not in KEYWORDS["typescript"]:
                out["callables"].append(_callable(n[3], m[3], params=_colon_params(text[n.start(4) : n.end(4)]), return_type=(n[5] or "").strip(), access=access, is_async="async" in n[2], is_static="static" in n[2], exported=access == "public", decorators=re.findall(r"@\w+(?:\([^)]*\))?", text[n.start(1) : n.end(1)]), **more | {"line_count": text.count("\n", n.start(3), stop) + 1}))
            at = stop + 1
        gaps.append(blank[at:end])
        for gap in gaps:
            for f in field_.finditer("\n" + gap + "\n"):
                if f[2] not in KEYWORDS["typescript"] | {"public", "private", "static"}:
                    out["properties"].append({"class_name": m[3], "name": f[2], "type": (f[3] or "any").strip(), "access": next((a for a in ("private", "protected") if a in f[1]), "public")})
    outside = lambda k: not any(a <= k <= b for a, b in spans)
    taken: list[tuple[int, int]] = []
    for m in re.finditer(r"(export\s+)?(default\s+)?(async\s+)?function\s*\*?\s*(\w+)\s*(?:<[^>(]*>)?\(|(export\s+)?(?:const|let|var)\s+(\w+)\s*(?::[^=\n]+)?=\s*(async\s+)?(?:<[^>(]*>\s*)?(?:\(|(\w+)\s*=>)", blank):
        if not outside(m.start()) or any(a <= m.start() <= b for a, b in taken):
            continue
        name, exported, is_async = m[4] or m[6], bool(m[1] or m[5]), bool(m[3] or m[7])
        if m[8]:
            params, rest = m[8], m.end()
        else:
            stop = closing(blank, m.end() - 1, "()")
            params, rest = text[m.end() : stop], stop + 1
        head = re.compile(r"\s*(?::\s*([^{=;]+?)\s*(?==>|[{;\n]))?\s*(?:=>)?\s*(\{)?").match(blank, rest)
        arrow = "=>" in blank[rest : head.end()] or bool(m[8])
        if not m[4] and not arrow:
            continue
        if head[2]:
            more, end = _body(text, blank, head.end() - 1, "typescript")
        else:
            end = min((k for k in (blank.find(";", rest), blank.find("\n", rest)) if k >= 0), default=len(blank) - 1)
            more = _metrics(blank[rest:end], "typescript", None)
        taken.append((m.start(), end))
        out["callables"].append(_callable(name, None, params=_colon_params(params), return_type=(head[1] or "").strip(), exported=exported, is_async=is_async, **more | {"line_count": text.count("\n", m.start(), end) + 1}))
        if exported:
            out["exports"].append({"name": name, "kind": "function" if m[4] else "variable"})
    for m in re.finditer(r"import\s+(?:type\s+)?(?:(\w+)\s*,?\s*)?(?:\*\s+as\s+(\w+)|\{([^}]*)\})?\s*(?:from\s*)?['\"]", blank):
        specifier = re.match(r"[^'\"]*", text[m.end() :])[0]
        named = [re.split(r"\s+as\s+", x.strip())[0].replace("type ", "") for x in (m[3] or "").split(",") if x.strip()]
        out["imports"].append({"specifier": specifier, "symbols": [x for x in (m[1], m[2]) if x and x != "from"] + named, "is_default": bool(m[1]), "is_namespace": bool(m[2])})
    for m in re.finditer(r"(export\s+)?(?:declare\s+)?(interface|type|enum)\s+(\w+)(?:<[^>{=]*>)?(?:\s+extends\s+([^{]+))?\s*[{=]", blank):
        out["types"].append({"name": m[3], "kind": m[2], "extends": split_top(m[4] or "")})
        if m[1]:
            out["exports"].append({"name": m[3], "kind": m[2]})
    for m in re.finditer(r"export\s*\{([^}]*)\}", blank):
        out["exports"] += [{"name": re.split(r"\s+as\s+", x.strip())[-1], "kind": "variable"} for x in m[1].split(",") if x.strip()]
    out["env_vars"] = _distinct(a or b for a, b in re.findall(r"process\.env(?:\.(\w+)|\[['\"](\w+)['\"]\])", text))
    top = [m[1] for m in re.finditer(r"(?:const|let|var)\s+\w+\s*(?::[^=\n]+)?=\s*(?:await\s+)?(?:new\s+)?([\w.]+)\(", blank) if outside(m.start()) and not any(a <= m.start() <= b for a, b in taken)]
    out["module_calls"] = _distinct(top)
    return out


def vue(text: str) -> dict:
    """The setup script, else the script; components of the template are called by every function."""
    blocks = re.findall(r"(?is)<script\b([^>]*)>(.*?)</script>", text)
    script = next((b for a, b in blocks if "setup" in a), blocks[0][1] if blocks else "")
    out = typescript(script)
    template = re.search(r"(?is)<template\b[^>]*>(.*)</template>", text)
    tags = re.findall(r"<([A-Z]\w*|[a-z]+(?:-[a-z0-9]+)+)", template[1]) if template else []
    used = _distinct(t if t[0].isupper() else "".join(p.capitalize() for p in t.split("-")) for t in tags)
    for c in out["callables"]:
        c["calls"] = _distinct([*c["calls"], *used])
    return out


def go(text: str) -> dict:
    out, blank = {k: [] for k in EMPTY}, blanked(text, "go")
    public = lambda n: n[:1].isupper()
    for m in re.finditer(r"\btype\s+(\w+)(?:\[[^\]]*\])?\s+(struct|interface)\s*\{", blank):
        inner = blank[m.end() : closing(blank, m.end() - 1)]
        lines = [x.strip() for x in inner.split("\n") if x.strip()]
        if m[2] == "struct":
            embedded = [x.lstrip("*") for x in lines if re.fullmatch(r"\*?[\w.]+", x)]
            out["classes"].append({"name": m[1], "extends": embedded[0] if embedded else None, "implements": embedded[1:], "decorators": []})
            for x in lines:
                f = re.match(r"((?:\w+\s*,\s*)*\w+)\s+([\w.*\[\]{}()]+)", x)
                if f and not re.fullmatch(r"\*?[\w.]+", x):
                    out["properties"] += [{"class_name": m[1], "name": n.strip(), "type": f[2], "access": "public" if public(n.strip()) else "private"} for n in f[1].split(",")]
        else:
            out["types"].append({"name": m[1], "kind": "interface", "extends": [x for x in lines if re.fullmatch(r"[\w.]+", x)]})
        if public(m[1]):
            out["exports"].append({"name": m[1], "kind": "class" if m[2] == "struct" else "interface"})
    for m in re.finditer(r"\btype\s+(\w+)\s+(?!struct\b|interface\b)=?\s*[\w*\[(]", blank):
        out["types"].append({"name": m[1], "kind": "type", "extends": []})
    known = {c["name"] for c in out["classes"]}
    for m in re.finditer(r"^func\s+(?:\(\s*(\w+)?\s*\*?(\w+)(?:\[[^\]]*\])?\s*\)\s*)?(\w+)\s*(?:\[[^\]]*\])?\(", blank, re.M):
        stop = closing(blank, m.end() - 1, "()")
        params, pending = [], []
        for part in split_top(text[m.end() : stop]):
            words = part.split(None, 1)
            pending.append(words[0])
            if len(words) == 2:
                params += [{"name": n, "type": words[1], "optional": False, "default": None} for n in pending]
                pending = []
        params += [{"name": "_", "type": t, "optional": False, "default": None} for t in pending]
        brace = blank.find("{", stop)
        more, _ = _body(text, blank, stop, "go", m[1])
        if m[2] and m[2] not in known:
            known.add(m[2])
            out["classes"].append({"name": m[2], "extends": None, "implements": [], "decorators": []})
        out["callables"].append(_callable(m[3], m[2], params=params, return_type=blank[stop + 1 : brace].strip() or "void", access="public" if public(m[3]) else "private", exported=public(m[3]), **more | {"line_count": text.count("\n", m.start(), closing(blank, brace)) + 1}))
        if public(m[3]) and not m[2]:
            out["exports"].append({"name": m[3], "kind": "function"})
    for block, one in re.findall(r"(?m)^import\s+(?:\((.*?)\)|([^\n(]+))", COMMENTS.sub("", text), re.S):
        for alias, path in re.findall(r"(?:([\w.]+)\s+)?\"([^\"]+)\"", block or one):
            out["imports"].append({"specifier": path, "symbols": [alias or path.split("/")[-1]], "is_default": False, "is_namespace": True})
    out["env_vars"] = _distinct(re.findall(r"os\.(?:Getenv|LookupEnv)\(\s*\"(\w+)\"", text))
    return out


def rust(text: str) -> dict:
    out, blank = {k: [] for k in EMPTY}, blanked(text, "rust")
    classes: dict[str, dict] = {}
    methods: list[tuple[int, int, str]] = []
    for m in re.finditer(r"(pub(?:\([^)]*\))?\s+)?(struct|enum|trait)\s+(\w+)(?:<[^>{(]*>)?(?::\s*([^{]+))?\s*([{(;])?", blank):
        inner = blank[m.end() : closing(blank, m.end() - 1)] if m[5] == "{" else ""
        if m[2] == "struct":
            classes.setdefault(m[3], {"name": m[3], "extends": None, "implements": [], "decorators": []})
            out["properties"] += [{"class_name": m[3], "name": f[1], "type": f[2].strip(), "access": "public" if f[0] else "private"} for f in re.findall(r"(pub(?:\([^)]*\))?\s+)?(\w+)\s*:\s*([^,\n]+)", inner)]
        else:
            out["types"].append({"name": m[3], "kind": "enum" if m[2] == "enum" else "interface", "extends": [x.strip() for x in (m[4] or "").split("+") if x.strip()]})
            if m[1]:
                out["exports"].append({"name": m[3], "kind": "enum" if m[2] == "enum" else "interface"})
            if m[2] == "trait" and m[5] == "{":
                methods.append((m.end(), closing(blank, m.end() - 1), ""))
    for m in re.finditer(r"\bimpl(?:<[^>{]*>)?\s+(?:([\w:]+)(?:<[^>{]*>)?\s+for\s+)?(\w+)(?:<[^>{]*>)?[^{]*\{", blank):
        c = classes.setdefault(m[2], {"name": m[2], "extends": None, "implements": [], "decorators": []})
        if m[1]:
            c["implements"] = _distinct([*c["implements"], m[1]])
        methods.append((m.end(), closing(blank, m.end() - 1), m[2]))
    for m in re.finditer(r"(pub(?:\([^)]*\))?\s+)?((?:const|unsafe|extern)\s+)*(async\s+)?fn\s+(\w+)\s*(?:<[^>(]*>)?\(", blank):
        owner = next((c for a, b, c in methods if a <= m.start() <= b), None)
        stop = closing(blank, m.end() - 1, "()")
        brace, semi = blank.find("{", stop), blank.find(";", stop)
        if owner == "" or brace < 0 or 0 <= semi < brace:
            continue
        more, end = _body(text, blank, stop, "rust")
        params = re.sub(r"'\w+\s*,?\s*", "", text[m.end() : stop])
        returned = re.sub(r"\s*where\b.*", "", blank[stop + 1 : brace].strip().removeprefix("->").strip(), flags=re.S)
        out["callables"].append(_callable(m[4], owner, params=_colon_params(params), return_type=returned or "()", access="public" if m[1] else "private", is_async=bool(m[3]), is_static=bool(owner) and not re.search(r"\bself\b", params), exported=bool(m[1]), **more | {"line_count": text.count("\n", m.start(), end) + 1}))
        if m[1] and not owner:
            out["exports"].append({"name": m[4], "kind": "function"})
    for m in re.finditer(r"macro_rules!\s*(\w+)", blank):
        out["callables"].append(_callable(f"macro:{m[1]}"))
    for m in re.finditer(r"(?m)^\s*(?:pub\s+)?use\s+([^;]+);", blank):
        for path, symbol in _use(m[1].strip()):
            out["imports"].append({"specifier": path, "symbols": [symbol], "is_default": False, "is_namespace": symbol == "*"})
    out["classes"] = list(classes.values())
    out["env_vars"] = _distinct(a or b for a, b in re.findall(r"env::var(?:_os)?\(\s*\"(\w+)\"|env!\(\s*\"(\w+)\"", text))
    return out


def _use(tree: str, front: str = "") -> list[tuple[str, str]]:
    """(path, name) of every leaf of a `use` tree."""
    head, brace, rest = tree.partition("{")
    if brace:
        return [leaf for part in split_top(rest.rsplit("}", 1)[0]) for leaf in _use(part, front + head.strip())]
    path, _, alias = tree.partition(" as ")
    full = front + path.strip()
    base, _, last = full.rpartition("::")
    return [(base if last != "self" else base, alias.strip() or (base.rpartition("::")[2] if last == "self" else last))]


EXTRACTORS = {"python": python, "typescript": typescript, "javascript": typescript, "vue": vue, "go": go, "rust": rust}


def register(language: str, extractor) -> None:
    """Adds a language: a function from a text to the record's lists."""
    EXTRACTORS[language] = extractor


def parse(files: DataFrame) -> DataFrame:
    """One record for each file (path, language, content) of a known language; see `RECORD`."""
    table = dict(EXTRACTORS)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, language, text in zip(b["path"], b["language"], b["content"], strict=True):
                try:
                    rows.append({"path": path, "language": language} | EMPTY | table[language](text or "") | {"error": None})
                except (SyntaxError, ValueError, KeyError, RecursionError, IndexError) as e:
                    rows.append({"path": path, "language": language} | EMPTY | {"error": f"{type(e).__name__}: {e}"})
            yield pd.DataFrame(rows, columns=["path", "language", *EMPTY, "error"])

    return files.select("path", "language", "content").transform(shipped).mapInPandas(run, RECORD)


def callables(records: DataFrame) -> DataFrame:
    """The canonical rows of callables, in the order of files and then of places in them."""
    c = records.select(F.col("path").alias("file"), F.posexplode("callables").alias("pos", "c")).select("file", "pos", "c.*")
    qualified = F.when(F.col("class_name").isNotNull(), F.concat("class_name", F.lit("."), "name")).otherwise(F.col("name"))
    signature = F.array_join(F.transform("params", lambda p: F.concat(p["name"], F.lit(":"), p["type"])), ",")
    return c.select("*", qualified.alias("qualified_name"), F.size("params").alias("param_count"), signature.alias("param_signature"), F.concat("file", F.lit("#"), F.lpad(F.col("pos").cast("string"), 8, "0")).alias("seq"))


def entities(records: DataFrame, name: str) -> DataFrame:
    """Rows of one of the record's other lists, with file and seq."""
    kind = records.schema[name].dataType.elementType
    rows = records.select(F.col("path").alias("file"), F.posexplode(name).alias("pos", "x"))
    fields = ["x.*"] if hasattr(kind, "fields") else [F.col("x").alias("value")]
    return rows.select("file", *fields, F.concat("file", F.lit("#"), F.lpad(F.col("pos").cast("string"), 8, "0")).alias("seq"))
