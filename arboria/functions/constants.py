"""Word lists, limits and patterns that results depend on."""

# Limits.
MAX_FILES = 600
MAX_SYMBOLS = 8000
MAX_SYMBOLS_PER_LANGUAGE = 3000
SYMBOL_CAPS = {".md": 600, ".mdx": 600, ".txt": 150, ".html": 400, ".css": 200, ".scss": 200, ".json": 100, ".yaml": 100, ".yml": 100, ".toml": 100, "sql": 1000}
MAX_FILE_BYTES = 512_000
CONTEXT_BUDGET = 6000
LEAST_BUDGET = 500
MICRO_FOCUS = 1500
STUB_CHARS = 250
LEAST_SECTION = 120
SEMANTIC_FLOOR = 0.55
STREAM_NODES = 1600
STREAM_LINKS = 320
STREAM_LINK_ZOOM = 8.0
STREAM_NEIGHBOURS = 180
BRIDGES_PER_SYMBOL = 12
EMBEDDING_SIZE = 384

# Languages by file name suffix; any other suffix is a family of its own.
LANGUAGES = {
    ".py": "python", ".pyi": "python", ".js": "jsts", ".mjs": "jsts", ".cjs": "jsts", ".jsx": "jsts", ".ts": "jsts", ".tsx": "jsts",
    ".go": "go", ".rs": "rust", ".dart": "dart", ".java": "java", ".sql": "sql", ".rb": "ruby", ".php": "php", ".swift": "swift",
    ".kt": "kotlin", ".kts": "kotlin", ".c": "c", ".h": "c", ".cc": "cpp", ".cpp": "cpp", ".cxx": "cpp", ".c++": "cpp", ".hpp": "cpp", ".hh": "cpp", ".hxx": "cpp",
}

# What a scan reads and passes over.
TEXT_SUFFIXES = (
    ".py", ".js", ".jsx", ".ts", ".tsx", ".mjs", ".cjs", ".html", ".css", ".scss", ".md", ".mdx", ".json", ".toml", ".yaml", ".yml", ".txt",
    ".ps1", ".sh", ".go", ".rs", ".dart", ".sql", ".swift", ".kt", ".kts", ".c", ".h", ".cc", ".cpp", ".cxx", ".c++", ".hpp", ".hh", ".hxx",
)
SKIPPED_DIRECTORIES = (
    ".git", ".hg", ".svn", ".venv", "venv", "env", "__pycache__", ".pytest_cache", ".mypy_cache", ".ruff_cache", ".python-packages",
    ".plugin-python-packages", ".plugin-mcp-runtime", "node_modules", ".next", "dist", "build", "coverage", ".dart_tool", "out", "outputs",
    "generated", "gen", "Pods", ".tmp",
)
MINIFIED_SUFFIXES = (".min.js", ".min.mjs", ".min.cjs", ".min.css", ".min.ts", ".bundle.js", "_bundle.js", "-bundle.js", ".bundle.css", "-min.js", ".pack.js")
MINIFIED_SNIFFED = (".js", ".mjs", ".cjs", ".jsx", ".ts", ".tsx", ".css", ".scss")
MINIFIED_LINE = 500

# Words.
REFERENCE_STOPWORDS = ("await", "bool", "dict", "except", "false", "float", "for", "if", "int", "len", "list", "max", "min", "none", "print", "range", "return", "self", "str", "super", "true")
BRIDGE_STOPWORDS = (
    "data", "name", "type", "user", "value", "error", "true", "false", "null", "none", "list", "item", "items", "count", "index", "text",
    "json", "string", "number", "object", "array", "status", "result", "results", "message", "label", "title", "input", "output", "field",
    "fields", "table", "query", "params", "param", "body", "headers", "default", "content", "email", "public", "private", "select", "insert",
    "update", "delete", "from", "where", "order", "group", "limit", "offset", "child", "children", "color", "width", "height", "style", "class",
    "props", "state", "event",
)
CRITICAL_WORDS = ("jwt", "secret", "stripe", "paywall", "crypto", "verify", "rpc")
BROAD_HINTS = ("overview", "panoramica", "architettura", "architecture", "come funziona", "how does", "mappa", "map", "tutti", "struttura", "structure", "flow", "flusso")
DETAIL_HINTS = ("implementazione", "implementation", "body", "corpo", "riga", "line", "esattamente", "exact", "bug", "perche", "perché", "why", "definizione completa")
TEST_DOC_WORDS = ("test", "tests", "spec", "readme", "doc", "docs", "pytest", "vitest", "jest")
RUNTIME_PATHS = ("/src/", "/lib/", "/app/", "/api/", "/core/")
TEST_DOC_PATHS = ("/test/", "/tests/", "/spec/", "/docs/", "/doc/")
RISK_WEIGHTS = {"todo": 1, "fixme": 2, "hack": 2, "deprecated": 2, "unsafe": 3, "exception": 1, "error": 1, "mock": 1, "secret": 3, "token": 1}
PREVIEW_GATES = {"directory": 0.84, "file": 0.9, "symbol": 0.97, "section": 0.97, "concept": 0.78}
TYPE_RANKS = {"project": 0, "concept": 1, "directory": 2, "file": 3, "symbol": 4, "section": 4}
SQL_KINDS = {"FUNCTION": "function", "PROCEDURE": "function", "TRIGGER": "function", "TABLE": "class", "VIEW": "class", "TYPE": "class"}

# Patterns (Java regex dialect; (?U) where \w is to be Unicode).
TERM = "[A-Za-z0-9_.$/-]+"
HEADING = r"^(#{1,4})\s+(.+?)\s*$"
CALL = r"(?U)\b([A-Za-z_][A-Za-z0-9_]*)\s*\("
EXTENDS = r"(?U)\bextends\s+([A-Za-z_$][\w$]*)"
PYTHON_BASES = r"(?Um)^\s*class\s+\w+\(([^)]*)\)\s*:"
STRING_LITERAL = r"['\"]([A-Za-z_][A-Za-z0-9_]{3,})['\"]"
RPC_CALL = r"(?U)\.rpc\s*(?:<[^>]+>)?\s*\(\s*(?:r|R|f|F)?['\"]([A-Za-z_][\w$]*)['\"]"
EDGE_CALL = r"(?U)\.functions\s*\.\s*invoke\s*(?:<[^>]+>)?\s*\(\s*(?:r|R|f|F)?['\"]([A-Za-z0-9_-]+)['\"]"
EDGE_PATH = "/functions/v1/([A-Za-z0-9_-]+)"
TABLE_CALL = r"(?U)\.(?:from|into)\s*\(\s*(?:r|R|f|F)?['\"]([A-Za-z_][\w$]*)['\"]"
TABLE_SQL = r"(?iU)\b(?:FROM|JOIN|INTO|UPDATE)\s+(?:ONLY\s+)?\"?([A-Za-z_][\w$]*)"
#: The same in ASCII letters, digits and white space (\t, \n, \f, \r and blank), as SQL engines take \b, \w and \s.
CALL_ASCII = r"(?<![A-Za-z0-9_])([A-Za-z_][A-Za-z0-9_]*)[\t\n\f\r ]*\("
EXTENDS_ASCII = r"(?<![A-Za-z0-9_])extends[\t\n\f\r ]+([A-Za-z_$][A-Za-z0-9_$]*)"
TABLE_SQL_ASCII = r"(?<![A-Za-z0-9_])(?iu)(?:FROM|JOIN|INTO|UPDATE)[\t\n\f\r ]+(?:ONLY[\t\n\f\r ]+)?\"?([A-Za-z_][A-Za-z0-9_$]*)"
SQL_OBJECT = (
    r"(?i)\bCREATE\s+(?:OR\s+REPLACE\s+)?(?:GLOBAL\s+|LOCAL\s+|TEMP\s+|TEMPORARY\s+|UNLOGGED\s+|MATERIALIZED\s+|RECURSIVE\s+)*"
    r"(FUNCTION|PROCEDURE|TABLE|VIEW|TRIGGER|TYPE)\s+(?:IF\s+NOT\s+EXISTS\s+)?"
    r"((?:\"[^\"]+\"|[A-Za-z_][\w$]*)(?:\.(?:\"[^\"]+\"|[A-Za-z_][\w$]*))?)"
)
SCRIPT_DEFINITION = (
    r"(?U)^\s*(?:export\s+)?(?:async\s+)?(?:function|class)\s+([A-Za-z_$][\w$]*)",
    r"(?U)^\s*(?:export\s+)?(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*=\s*(?:async\s*)?\(?[^=]*\)?\s*=>",
)
_C = (
    (r"(?U)^\s*(?:typedef\s+)?(?:struct|union|enum(?:\s+class)?|class|namespace)\s+([A-Za-z_]\w*)\s*(?:final\s*)?(?::[^:;({][^;({]*)?(?:\{.*)?$", "class"),
    (r"(?U)^\s*(?!(?:if|else|for|while|do|switch|case|return|catch|sizeof|typedef|using|delete|new|throw|goto)\b)(?:[A-Za-z_][\w:<>,*&~ \t]*[\s*&])([A-Za-z_~][\w:~]*)\s*\([^;{}]*\)\s*(?:(?:const|noexcept|override|final)\s*)*(?:->\s*[\w:<>*& ]+)?(?::[^;{]*)?(?:\{.*)?$", "function"),
    (r"(?U)^([A-Za-z_]\w*::~?[A-Za-z_]\w*)\s*\([^;{}]*\)\s*(?::[^;{]*)?(?:\{.*)?$", "function"),
)
_JVM_WORDS = "public|protected|private|internal|static|final|abstract|sealed|partial|readonly|synchronized|virtual|override|async|native|default|unsafe|extern|strictfp|new"
_CURLY = (
    (rf"(?U)^\s*(?:@\w+(?:\([^)]*\))?\s+|(?:{_JVM_WORDS})\s+)*(?:class|interface|@interface|enum|struct|record)\s+([A-Za-z_]\w*)", "class"),
    (rf"(?U)^\s*(?:@\w+(?:\([^)]*\))?\s+)*(?:(?:{_JVM_WORDS})\s+)+(?:<[^>]+>\s*)?(?:[\w.<>\[\],?]+\s+)?([A-Za-z_]\w*)\s*\([^;{{]*(?:\{{.*)?$", "function"),
    (r"(?U)^\s*(?!(?:if|else|for|foreach|while|switch|case|return|catch|new|throw|using|lock)\b)[\w.<>\[\],?]+\s+([A-Za-z_]\w*)\s*\([^;{]*\)\s*(?:throws\s+[\w., ]+)?\{.*$", "function"),
)
_KOTLIN_WORDS = "public|private|internal|protected|open|abstract|sealed|data|inner|enum|annotation|value|inline|override|suspend|operator|infix|tailrec|external|actual|expect"
_KOTLIN = (
    (rf"(?U)^\s*(?:@\w+(?:\([^)]*\))?\s+|(?:{_KOTLIN_WORDS})\s+)*(?:class|interface|object)\s+([A-Za-z_]\w*)", "class"),
    (rf"(?U)^\s*(?:@\w+(?:\([^)]*\))?\s+|(?:{_KOTLIN_WORDS})\s+)*fun\s+(?:<[^>]+>\s*)?(?:[\w.<>?]+\.)?([A-Za-z_]\w*)\s*\(", "function"),
)
_SWIFT_WORDS = "public|private|fileprivate|internal|open|final|indirect|static|class|override|mutating|nonmutating|convenience|required"
_SWIFT = (
    (r"(?U)^\s*(?:@\w+(?:\([^)]*\))?\s+)*(?:(?:public|private|fileprivate|internal|open|final|indirect)\s+)*(?:class|struct|enum|protocol|extension|actor)\s+(?!func\b|var\b)([A-Za-z_]\w*)", "class"),
    (rf"(?U)^\s*(?:@\w+(?:\([^)]*\))?\s+)*(?:(?:{_SWIFT_WORDS})\s+)*func\s+([A-Za-z_]\w*)", "function"),
)
_PHP = (
    (r"(?U)^\s*(?:(?:abstract|final|readonly)\s+)*(?:class|interface|trait|enum)\s+([A-Za-z_]\w*)", "class"),
    (r"(?U)^\s*(?:(?:public|protected|private|static|abstract|final)\s+)*function\s+&?\s*([A-Za-z_]\w*)\s*\(", "function"),
)
DEFINITIONS = {
    ".go": ((r"(?U)^\s*func\s+(?:\([^)]*\)\s*)?([A-Za-z_]\w*)\s*\(", "function"), (r"(?U)^\s*type\s+([A-Za-z_]\w*)\s+(?:struct|interface)\b", "class")),
    ".rs": ((r"(?U)^\s*(?:pub\s+)?(?:async\s+)?(?:unsafe\s+)?fn\s+([A-Za-z_]\w*)", "function"), (r"(?U)^\s*(?:pub\s+)?(?:struct|enum|trait|impl|mod)\s+([A-Za-z_]\w*)", "class")),
    ".dart": ((r"(?U)^\s*(?:abstract\s+)?(?:class|mixin|extension|enum)\s+([A-Za-z_]\w*)", "class"), (r"(?U)^\s*(?:[A-Za-z_][\w<>,\s\?]*\s+)?([A-Za-z_]\w*)\s*\([^;{]*\)\s*(?:async\s*)?\{", "function")),
}
DEFINITIONS |= {suffix: _C for suffix in (".c", ".h", ".cc", ".cpp", ".cxx", ".c++", ".hpp", ".hh", ".hxx")}
DEFINITIONS |= {".java": _CURLY, ".cs": _CURLY, ".kt": _KOTLIN, ".kts": _KOTLIN, ".swift": _SWIFT, ".php": _PHP}
RUBY_DEFINITIONS = (("class", r"^\s*(?:class|module)\s+([A-Z]\w*(?:::\w+)*)"), ("function", r"^\s*def\s+(?:self\.)?([A-Za-z_]\w*[?!=]?)"))
