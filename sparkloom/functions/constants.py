"""Names and patterns that results depend on, given as text."""

#: Calls that say nothing about relationships between callables (fixed values, by family).
BUILTIN_CALLS = frozenset(
    """
    map filter reduce forEach some every find findIndex includes indexOf join split slice splice push pop
    shift unshift concat flat flatMap sort reverse keys values entries has get set delete clear
    toString valueOf toJSON toFixed toPrecision trim trimStart trimEnd toLowerCase toUpperCase
    replace replaceAll match matchAll search test startsWith endsWith padStart padEnd repeat
    charAt charCodeAt codePointAt normalize parseInt parseFloat isNaN isFinite
    JSON.stringify JSON.parse Object.keys Object.values Object.entries Object.assign Object.create
    Object.freeze Object.defineProperty Array.isArray Array.from Promise.all Promise.resolve
    Promise.reject Promise.allSettled Math.floor Math.ceil Math.round Math.max Math.min Math.abs
    Date.now console.log console.error console.warn console.info process.exit
    isinstance issubclass type id hash dir vars getattr setattr hasattr delattr callable property
    staticmethod classmethod super len range enumerate zip sorted reversed min max sum abs round pow divmod
    str int float bool bytes bytearray list tuple dict frozenset print input open repr format chr ord
    any all next iter
    assert_equal assert_not_equal assert_raises assert_true assert_false assert_is_none assert_is_not_none
    assertEqual assertNotEqual assertRaises assertTrue assertFalse assertIsNone assertIsNotNone assertIn
    assertNotIn assertIs assertIsNot assertGreater assertLess assertAlmostEqual pytest.raises pytest.mark
    fmt.Println fmt.Printf fmt.Sprintf fmt.Fprintf fmt.Errorf make append cap close copy panic recover new println
    vec todo unimplemented dbg assert assert_eq assert_ne eprintln eprint write writeln
    ValueError TypeError KeyError IndexError AttributeError RuntimeError NotImplementedError StopIteration
    IOError OSError FileNotFoundError PermissionError Exception BaseException Error
    """.split()
)

#: Category of a call by its name (fixed values).
CALL_CATEGORIES = {
    "file-io": "readFile writeFile readFileSync writeFileSync existsSync mkdirSync readdir readdirSync unlink unlinkSync stat statSync open close read write",
    "path": "path.join path.resolve path.dirname path.basename path.extname path.relative join resolve",
    "logging": "console.log console.error console.warn log warn error info debug",
    "http": "fetch request get post put delete axios axios.get axios.post",
    "json": "JSON.parse JSON.stringify parse stringify",
    "string": "replace split trim toLowerCase toUpperCase startsWith endsWith includes match search slice substring",
    "array": "map filter reduce forEach find sort concat flat flatMap some every push pop shift unshift splice",
    "async": "Promise.all Promise.resolve Promise.reject Promise.allSettled then catch finally",
    "error": "Error throw TypeError RangeError",
    "validation": "validate assert check verify isValid",
}
CATEGORY_OF_CALL = {call: category for category, calls in CALL_CATEGORIES.items() for call in calls.split()}

#: Extension to language (fixed values).
LANGUAGES = {
    ".ts": "typescript", ".tsx": "typescript", ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript",
    ".py": "python", ".vue": "vue", ".go": "go", ".rs": "rust",
}

#: Thresholds of the health report (fixed values); twice the value is critical.
MAX_COMPLEXITY, MAX_LINES, MAX_METHODS = 10, 50, 10

#: Paths that frameworks, shells or test runners start from (fixed patterns).
ENTRY_POINTS = [
    r"^src/index\.[tj]sx?$", r"^src/main\.[tj]sx?$", r"^src/app\.[tj]sx?$", r"^index\.[tj]sx?$", r"^app\.[tj]sx?$",
    r"^server\.[tj]sx?$", r"^main\.py$", r"^app\.py$", r"/commands/[^/]+\.[tj]sx?$", r"/cli/index\.[tj]sx?$",
    r"/mcp/server\.[tj]sx?$", r"\.test\.[tj]sx?$", r"\.spec\.[tj]sx?$", r"test_.*\.py$", r".*_test\.py$",
]

#: Endings tried for an import, in order (fixed values).
IMPORT_ENDINGS = [".ts", ".tsx", ".js", ".jsx", ".mjs", ".py", "", "/index.ts", "/index.tsx", "/index.js", "/index.jsx"]

#: Built-in members whose calls say nothing about what a function is for (fixed values).
NOISE_MEMBERS = (
    "length", "size", "push", "pop", "shift", "unshift", "splice", "slice", "map", "filter", "reduce", "forEach",
    "find", "some", "every", "includes", "indexOf", "join", "split", "trim", "replace", "match", "test", "exec",
    "has", "get", "set", "add", "delete", "keys", "values", "entries", "toString", "charAt", "startsWith", "endsWith",
)
