"""Source code: syntax records, imports, call graph, symbol index, data flow, and the keys they are stored under."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstone.operators.graph import MAX_SITES, callees, callers, resolve_callees
from quillstone.operators.ranking import first_per

_ID = "([a-zA-Z_][a-zA-Z0-9_]*)"
#: Patterns of declarations by language and kind; group 1 is the name (2 for C functions).
SYNTAX = {
    "c": {"function": (r"(?:[a-zA-Z_][a-zA-Z0-9_]*\s+)+" + _ID + r"\s*\([^)]*\)\s*\{", 1), "struct": (r"struct\s+" + _ID + r"\s*\{", 1), "class": (r"class\s+" + _ID + r"\s*[:\{]", 1), "import": (r"#include\s*[\"<]([^\">]+)[\">]", 1)},
    "python": {"function": (r"def\s+" + _ID + r"\s*\(", 1), "class": (r"class\s+" + _ID + r"\s*[:\(]", 1), "import": (r"(?:from|import)\s+([a-zA-Z_][a-zA-Z0-9_.]*)", 1)},
    "javascript": {"function": (r"(?:function\s+|const\s+)([a-zA-Z_][a-zA-Z0-9_]*)\s*(?:=\s*\([^)]*\)\s*=>|\()", 1), "class": (r"class\s+" + _ID + r"\s*\{", 1), "import": (r"import\s+.*?\s+from\s+['\"]([^'\"]+)['\"]", 1)},
    "java": {"function": (r"(?:public|private|protected|static|final|abstract|synchronized)\s+(?:<[^>]+>\s+)?[a-zA-Z_][a-zA-Z0-9_<>,\s]*\s+" + _ID + r"\s*\([^)]*\)\s*(?:throws\s+[^{]+)?\{", 1), "class": (r"class\s+" + _ID + r"\s*[\{<]", 1), "import": (r"import\s+([a-zA-Z_][a-zA-Z0-9_.]*(?:\.\*)?);", 1)},
    "go": {"function": (r"func\s+(?:\([^)]*\)\s*)?" + _ID + r"\s*\(", 1), "struct": (r"type\s+" + _ID + r"\s+struct\s*\{", 1), "import": (r"import\s+[\"']([^\"']+)[\"']", 1)},
    "rust": {"function": (r"fn\s+" + _ID + r"\s*\(", 1), "struct": (r"struct\s+" + _ID + r"\s*\{", 1), "import": (r"use\s+([a-zA-Z_][a-zA-Z0-9_:]*);", 1)},
}
SYNTAX["cpp"], SYNTAX["typescript"] = SYNTAX["c"], SYNTAX["javascript"]
#: Words before a parenthesis that call nothing.
CALL_KEYWORDS = ("if", "while", "for", "switch", "return", "sizeof", "typeof", "main")
#: Kinds that a symbol index leaves out, and kinds of chunks that a syntax-tree indexer keeps.
LOW_VALUE_KINDS = ("variable", "member", "field", "local", "parameter")
CHUNK_KINDS = ("declaration", "method", "class", "interface", "type_alias", "enum", "module", "function")
#: Frequent library names without a namespace that are no call targets of interest.
NOISE_NAMES = (
    "Array", "ArrayBuffer", "Boolean", "Buffer", "DataView", "Date", "Error", "Function", "Infinity", "JSON", "Map", "Math", "NaN", "Number", "Object",
    "Promise", "Proxy", "RangeError", "ReferenceError", "RegExp", "Set", "String", "Symbol", "TypeError", "URIError", "WeakMap", "WeakSet",
    "console", "exports", "global", "globalThis", "module", "process", "require", "undefined",
    "at", "concat", "copyWithin", "entries", "every", "fill", "filter", "find", "findIndex", "findLast", "findLastIndex", "flat", "flatMap", "forEach",
    "includes", "indexOf", "join", "keys", "lastIndexOf", "map", "pop", "push", "reduce", "reduceRight", "reverse", "shift", "slice", "some", "sort",
    "splice", "toLocaleString", "toString", "unshift", "values",
    "charAt", "charCodeAt", "codePointAt", "endsWith", "fromCharCode", "match", "matchAll", "normalize", "padEnd", "padStart", "repeat", "replace",
    "replaceAll", "search", "split", "startsWith", "substring", "substr", "toLowerCase", "toUpperCase", "trim", "trimEnd", "trimStart",
    "isFinite", "isInteger", "isNaN", "isSafeInteger", "parseFloat", "parseInt", "toFixed", "toPrecision",
    "abs", "ceil", "floor", "max", "min", "pow", "random", "round", "sqrt", "trunc",
    "getDate", "getDay", "getFullYear", "getHours", "getMilliseconds", "getMinutes", "getMonth", "getSeconds", "getTime", "getTimezoneOffset", "getUTCDate",
    "toISOString", "toUTCString", "exec", "test", "add", "clear", "delete", "get", "has", "set", "size", "catch", "finally", "then",
    "setTimeout", "clearTimeout", "setInterval", "clearInterval", "setImmediate",
    "Effect", "Context", "Layer", "Ref", "Option", "Either", "Schema", "pipe", "fetch", "log", "error", "warn",
)
#: Members of namespaces that are noise as well; of those of fs that are marked so also the name with Sync.
NOISE_MEMBERS = {
    "Array": ("from", "isArray", "of"),
    "Object": (
        "assign", "create", "defineProperties", "defineProperty", "entries", "freeze", "fromEntries", "getOwnPropertyDescriptor", "getOwnPropertyDescriptors",
        "getOwnPropertyNames", "getOwnPropertySymbols", "getPrototypeOf", "hasOwn", "is", "isExtensible", "isFrozen", "isSealed", "keys", "preventExtensions",
        "seal", "setPrototypeOf", "values",
    ),
    "JSON": ("parse", "stringify"),
    "Promise": ("all", "allSettled", "any", "race", "reject", "resolve"),
    "console": ("debug", "error", "info", "log", "trace", "warn"),
    "process": ("cwd", "env", "exit", "nextTick"),
    "Effect": (
        "acquireUseRelease", "all", "andThen", "annotateLogs", "as", "bind", "bindTo", "catch", "catchAll", "catchSome", "catchTag", "catchTags",
        "die", "either", "fail", "filter", "flatMap", "fn", "fork", "forever", "fromNullable", "gen", "if", "ignore", "iterate", "join", "let", "log", "logError",
        "map", "mapBoth", "mapError", "mergeAll", "never", "onExit", "orDie", "optionFromOptional", "provide", "provideLayer", "provideService",
        "provideServiceEffect", "promise", "race", "raceAll", "repeat", "retry", "runFork", "runPromise", "runPromiseExit", "runSync", "schedule", "scoped",
        "sleep", "succeed", "sync", "tap", "tapBoth", "tapError", "timeout", "try", "tryPromise", "unified", "void", "withSpan", "zip", "zipLeft", "zipRight", "zipWith",
    ),
    "Context": ("Service", "Tag", "add", "get", "make", "merge", "empty"),
    "Layer": ("effect", "merge", "provide", "succeed", "sync", "toRuntime"),
    "Ref": ("get", "make", "set", "update", "updateAndGet"),
    "Option": ("flatMap", "fromNullable", "getOrElse", "getOrThrow", "map", "none", "orElse", "some"),
    "Either": ("flatMap", "left", "map", "match", "right", "void"),
    "Schema": (
        "Array", "Boolean", "Class", "Date", "Literal", "Number", "Record", "String", "Struct", "Tuple", "Union", "decode", "decodeUnknown",
        "encode", "encodeUnknown", "optional", "parseJson",
    ),
    "Buffer": ("alloc", "concat", "from", "isBuffer"),
    "path": ("basename", "dirname", "extname", "format", "isAbsolute", "join", "normalize", "parse", "relative", "resolve"),
    "child_process": ("exec", "execFile", "execFileSync", "execSync", "fork", "spawn"),
    "fs": ("existsSync",),
}
NOISE_FS = ("access", "appendFile", "copyFile", "cp", "mkdir", "readFile", "readdir", "rename", "rm", "rmdir", "stat", "writeFile")
NOISE_SYMBOLS = (*NOISE_NAMES, *(f"{space}.{name}" for space, names in NOISE_MEMBERS.items() for name in names), *(f"fs.{name}{sync}" for name in NOISE_FS for sync in ("", "Sync")))
#: Most arguments of a call, most lines and look-ahead of a block, windows of a long body.
MAX_ARGUMENTS, MAX_BLOCK_LINES, BRACE_WITHIN = 20, 500, 10
WINDOW_FROM, WINDOW, OVERLAP, MAX_PARTS = 2000, 1500, 500, 5
#: Most import terms that are compared with all repositories.
MAX_TERMS = 10_000
#: Words that begin a declaration in C.
C_TYPES = ("int", "char", "float", "double", "long", "short", "unsigned", "signed", "void", "bool", "size_t", "struct", "enum", "union", "const", "static", "auto", "uint8_t", "uint16_t", "uint32_t", "uint64_t", "int8_t", "int16_t", "int32_t", "int64_t")
C_KEYWORDS = ("if", "else", "while", "for", "do", "switch", "case", "break", "continue", "return", "goto", "default", "sizeof", "typedef", "extern", "NULL")


def syntax_records(files: DataFrame) -> DataFrame:
    """file, language, kind, name for files (file, language, content), from patterns per language."""
    none = F.array().cast("array<string>")

    def tagged(kind: str) -> Column:
        names = F.when(F.lit(False), none)
        for language, table in SYNTAX.items():
            if kind in table:
                names = names.when(F.col("language") == language, F.regexp_extract_all("content", F.lit(table[kind][0]), table[kind][1]))
        return F.transform(F.coalesce(names, none), lambda n: F.struct(F.lit(kind).alias("kind"), n.alias("name")))

    parts = F.concat(*(tagged(kind) for kind in sorted({k for table in SYNTAX.values() for k in table})))
    return files.select("file", "language", F.explode(parts).alias("_r")).select("file", "language", "_r.kind", "_r.name")


def syntax_json(records: DataFrame) -> DataFrame:
    """file, ast: the records of a file as JSON."""
    nodes = F.array_sort(F.collect_list(F.struct(F.col("kind").alias("type"), "name")))
    return records.groupBy("file", "language").agg(nodes.alias("nodes")).select("file", F.to_json(F.struct("file", "language", "nodes")).alias("ast"))


def syntax_tags(records: DataFrame) -> DataFrame:
    """file, tags: func:x class:y struct:z import:m."""
    short = F.when(F.col("kind") == "function", "func").otherwise(F.col("kind"))
    return records.groupBy("file").agg(F.array_join(F.array_sort(F.collect_list(F.concat(short, F.lit(":"), F.col("name")))), " ").alias("tags"))


def imports(code: Column, language: str) -> dict[str, Column]:
    """libraries, symbols, headers, modules of a source text, distinct, in order."""
    none = F.array().cast("array<string>")
    every = lambda p, g=1: F.regexp_extract_all(code, F.lit(p), g)
    out = {"libraries": none, "symbols": none, "headers": none, "modules": none}
    if language in ("c", "cpp"):
        out["headers"] = every(r"#include\s*[\"<]([^\">]+)[\">]")
        out["libraries"] = F.transform(out["headers"], lambda h: F.split_part(h, F.lit("/"), F.lit(1)))
        calls = F.filter(every(r"\b([a-zA-Z_]\w*)\s*\("), lambda s: ~s.isin(*CALL_KEYWORDS))
        out["symbols"] = F.concat(calls, every(r"\b([a-zA-Z_]\w*(?:::[a-zA-Z_]\w*)+)\s*[({;.]"))
    elif language == "python":
        first = lambda a: F.transform(a, lambda m: F.split_part(m, F.lit("."), F.lit(1)))
        out["modules"] = F.concat(first(every(r"(?m)^import\s+([\w.]+)")), first(every(r"(?m)^from\s+([\w.]+)\s+import")))
        lists = every(r"(?m)^from\s+[\w.]+\s+import([^\n]*)")
        out["symbols"] = F.flatten(F.transform(lists, lambda s: F.filter(F.regexp_extract_all(s, F.lit(r"[a-zA-Z_]\w*"), 0), lambda w: ~w.isin("import", "as", "from"))))
    elif language == "go":
        out["modules"] = every(r"import\s+(?:\(\s*)?\"([^\"]+)\"")
        out["libraries"] = F.transform(out["modules"], lambda m: F.element_at(F.split(m, "/"), -1))
    elif language == "rust":
        out["modules"] = F.transform(every(r"use\s+([\w:]+)"), lambda m: F.split_part(m, F.lit("::"), F.lit(1)))
    elif language in ("javascript", "typescript"):
        out["libraries"] = F.filter(every(r"(?:import\s+.*?from\s+|require\s*\(\s*)['\"]([^'\"]+)['\"]"), lambda m: ~m.startswith("."))
    return {k: F.array_distinct(F.filter(v, lambda x: x != "")) for k, v in out.items()}


def repositories_for(terms: DataFrame, repos: DataFrame) -> DataFrame:
    """repo for import terms (term) and repositories (repo: /code/owner/name): containment either way with
    the name or the owner, also without - _ and dots.  Terms are those of one source file: their number is
    checked before they are broadcast."""
    terms = terms.distinct()
    if terms.limit(MAX_TERMS + 1).count() > MAX_TERMS:
        raise ValueError(f"more than {MAX_TERMS} import terms")
    parts = F.split(F.lower("repo"), "/")
    known = repos.where(F.size(F.split("repo", "/")) >= 3).withColumn("_name", F.element_at(parts, -1)).withColumn("_owner", F.element_at(parts, -2))
    t = F.lower("term")
    bare = lambda c: F.regexp_replace(c, "[-_.]", "")
    either = lambda a, b: F.contains(a, b) | F.contains(b, a)
    match = either(F.col("_name"), t) | either(F.col("_owner"), t) | either(bare(F.col("_name")), bare(t))
    return known.join(F.broadcast(terms), match).select("repo").distinct()


def noise_symbol(name: Column, further: tuple[str, ...] = ()) -> Column:
    """Names that are no functions of interest: punctuation, library names and `further` ones, under three bytes, no lower-case letter."""
    return name.isNull() | name.rlike(r"[()\[\]{}`$\"']") | name.rlike(r"^\s*$") | name.isin(*NOISE_SYMBOLS, *further) | (F.octet_length(name) < 3) | ~name.rlike("[a-z]")


def call_sites(bodies: DataFrame, functions: DataFrame, arguments: bool = False) -> DataFrame:
    """src, dst, file, line[, args]: calls of known functions in bodies (name, file, line_start, content).

    A body is cut into lines, a line into identifiers before parentheses; each joins the function table.
    Self calls, noise names and repeated (callee, caller, file, line) are dropped.  With `arguments` the
    top-level arguments of the first call of that name in the line come along, as flow() needs them."""
    lines = bodies.select(F.col("name").alias("src"), "file", "line_start", F.posexplode(F.split("content", "\n")).alias("_i", "_l"))
    found = F.explode(F.array_distinct(F.regexp_extract_all("_l", F.lit(r"([A-Za-z_][A-Za-z0-9_]*)\s*\("), 1))).alias("token")
    tokens = lines.select("src", "file", (F.col("line_start") + F.col("_i")).alias("line"), *(["_l"] if arguments else []), found)
    tokens = tokens.where(~F.col("token").isin(*CALL_KEYWORDS) & ~noise_symbol(F.col("token")))
    sites = resolve_callees(tokens, functions)
    if not arguments:
        return sites.select("src", "dst", "file", "line").distinct()
    return sites.select("src", "dst", "file", "line", call_arguments("_l", "token").alias("args")).dropDuplicates(["src", "dst", "file", "line"])


@F.udf(returnType=T.ArrayType(T.StringType()), useArrow=True)
def call_arguments(line: str, name: str):
    """The top-level arguments of the first call of `name` in a line, at most 20."""
    at = re.search(rf"(?<![A-Za-z0-9_]){re.escape(name)}\s*\(", line or "")
    if not at:
        return []
    depth, start, out, quote, i = 0, at.end(), [], "", at.end()
    while i < len(line):
        c = line[i]
        if quote:
            if c == "\\":
                i += 1
            elif c == quote:
                quote = ""
        elif c in "\"'":
            quote = c
        elif c in "([{":
            depth += 1
        elif c in ")]}":
            if depth == 0:
                break
            depth -= 1
        elif c == "," and depth == 0:
            out.append(line[start:i].strip())
            start = i + 1
        i += 1
    last = line[start:i].strip()
    return (out + [last] if last or out else out)[:MAX_ARGUMENTS]


@F.udf(returnType=T.IntegerType(), useArrow=True)
def block_end(lines: list[str], start: int):
    """The 0-based line where the block that begins near `start` ends; 0 for a declaration or no brace nearby."""
    depth, opened, comment = 0, False, False
    for n in range(start, min(len(lines), start + MAX_BLOCK_LINES)):
        if not opened and n - start >= BRACE_WITHIN:
            return 0
        i, quote, line = 0, "", lines[n]
        while i < len(line):
            two = line[i : i + 2]
            if comment:
                if two == "*/":
                    comment, i = False, i + 1
            elif quote:
                if line[i] == "\\":
                    i += 1
                elif line[i] == quote:
                    quote = ""
            elif two == "//":
                break
            elif two == "/*":
                comment, i = True, i + 1
            elif line[i] in "\"'":
                quote = line[i]
            elif line[i] == ";" and not opened:
                return 0
            elif line[i] == "{":
                depth, opened = depth + 1, True
            elif line[i] == "}":
                depth -= 1
                if opened and depth == 0:
                    return n
            i += 1
    return min(len(lines), start + MAX_BLOCK_LINES) - 1 if opened else 0


@F.udf(returnType=T.StringType(), useArrow=True)
def full_definition(content: str, start: int):
    """The text from a line to the end of its block."""
    lines = (content or "").split("\n")
    end = block_end.func(lines, start)
    return "\n".join(lines[start : end + 1]) if end else "\n".join(lines[start : start + 1])


@F.udf(returnType=T.ArrayType(T.StructType([T.StructField("part", T.IntegerType()), T.StructField("content", T.StringType())])), useArrow=True)
def body_windows(content: str, signature: str, name: str):
    """A body of over 2000 bytes as itself and windows of 1500 bytes with 500 overlap, five parts at most;
    a window ends at its last line end and begins with the signature (or name) and its part number."""
    raw = (content or "").encode()
    out = [(1, content or "")]
    if len(raw) <= WINDOW_FROM:
        return out

    def floor(i: int) -> int:
        while 0 < i < len(raw) and raw[i] & 0xC0 == 0x80:
            i -= 1
        return i

    offset = floor(WINDOW - OVERLAP)
    while offset < len(raw) and len(out) < MAX_PARTS:
        end = floor(min(len(raw), offset + WINDOW))
        if end < len(raw):
            line = raw.rfind(b"\n", offset, end)
            end = line + 1 if line >= 0 else end
        take = end - offset
        out.append((len(out) + 1, f"{signature or name} // Part {len(out) + 1}\n" + raw[offset:end].decode(errors="ignore")))
        offset = floor(offset + (take - OVERLAP if take > OVERLAP else max(take, 1)))
    return out


@F.udf(returnType=T.ArrayType(T.StructType([T.StructField("variable", T.StringType()), T.StructField("kind", T.StringType()), T.StructField("line", T.IntegerType()), T.StructField("field", T.StringType())])), useArrow=True)
def variable_occurrences(content: str):
    """Definitions, assignments and uses of variables in one C function body, line by line.

    A name after a type word is a definition; before a single = an assignment; any other
    identifier that was defined or assigned before is a use, once a line."""
    out, seen = [], set()
    for number, line in enumerate((content or "").split("\n")):
        line, used = re.sub(r'"(?:\\.|[^"\\])*"|//.*', "", line), set()
        for m in re.finditer(r"[A-Za-z_][A-Za-z0-9_]*", line):
            name, before, after = m.group(), line[: m.start()], line[m.end() :]
            if name in C_TYPES or name in C_KEYWORDS or re.match(r"\s*\(", after) or re.search(r"(->|\.)\s*$", before):
                continue
            field = (re.match(r"\s*(?:->|\.)\s*([A-Za-z_][A-Za-z0-9_]*)", after) or [None, None])[1]
            prior = re.search(r"([A-Za-z_][A-Za-z0-9_]*)[\s*]+$", before)
            if prior and (prior[1] in C_TYPES or prior[1].endswith("_t") or prior[1][0].isupper()):
                kind = "definition"
            elif re.match(r"\s*(?:(?:->|\.)\s*[A-Za-z_]\w*)?\s*(?:[-+*/%&|^]|<<|>>)?=(?!=)", after):
                kind = "assignment"
            elif name in seen and name not in used:
                kind = "usage"
            else:
                continue
            used.add(name)
            seen.add(name)
            out.append((name, kind, number, field))
    return out


def c_word(word: Column) -> Column:
    """type, keyword or name."""
    return F.when(word.isin(*C_TYPES), "type").when(word.isin(*C_KEYWORDS), "keyword").otherwise("name")


def dataflow(bodies: DataFrame) -> DataFrame:
    """variable, function, file, line, kind, field for bodies (name, file, line_start, content)."""
    rows = bodies.select(F.col("name").alias("function"), "file", "line_start", F.explode(variable_occurrences("content")).alias("_o"))
    return rows.select("_o.variable", "function", "file", (F.col("line_start") + F.col("_o.line")).alias("line"), "_o.kind", "_o.field")


def function_index(occurrences: DataFrame) -> DataFrame:
    """function, file, variable, definitions, assignments, usages: the occurrences regrouped by function."""
    kinds = (("definition", "definitions"), ("assignment", "assignments"), ("usage", "usages"))
    return occurrences.groupBy("function", "file", "variable").agg(*(F.count_if(F.col("kind") == k).alias(name) for k, name in kinds))


def field_counts(occurrences: DataFrame) -> DataFrame:
    return occurrences.where("field is not null").groupBy("variable", "field").agg(F.count("*").alias("occurrences"))


def symbol_index(chunks: DataFrame, most: int = MAX_SITES) -> DataFrame:
    """name, symbols: array of {name, kind, file, line}, functions outside headers first; low-value kinds left out;
    of a name that stands at more places the first `most`."""
    first = F.when(F.col("kind").isin("function", "method") & ~F.col("file").endswith(".h"), 0).otherwise(1)
    rows = chunks.where(~F.col("kind").isin(*LOW_VALUE_KINDS)).select(first.alias("p"), "file", F.col("line_start").alias("line"), "kind", "name")
    ordered = F.array_sort(F.collect_list(F.struct("p", "file", "line", "kind", "name")))
    return first_per(rows, most, "name", "p", "file", "line", "kind").groupBy("name").agg(F.transform(ordered, lambda s: F.struct(s["name"].alias("name"), s["kind"].alias("kind"), s["file"].alias("file"), s["line"].alias("line"))).alias("symbols"))


def key_rows(namespace: str, chunks: DataFrame, sites: DataFrame | None = None, occurrences: DataFrame | None = None) -> DataFrame:
    """key, value rows of an analysed repository: chunks, symbols, callers, callees, variables and counts;
    lists hold at most MAX_SITES places of one name."""
    n = F.lit(namespace)
    out = chunks.select(F.concat_ws("/", n, F.lit("chunks"), "file", "name").alias("key"), F.to_json(F.struct(*chunks.columns)).alias("value"))
    out = out.unionByName(symbol_index(chunks).select(F.concat_ws("/", n, F.lit("symbols"), "name").alias("key"), F.to_json("symbols").alias("value")))
    if sites is not None:
        for label, table in (("callers", callers(sites)), ("callees", callees(sites))):
            out = out.unionByName(table.select(F.concat_ws("/", n, F.lit(label), "name").alias("key"), F.to_json(F.struct("count", "sites")).alias("value")))
    if occurrences is not None:
        group = F.array_sort(F.collect_list(F.struct("file", "line", "function", "kind", "field")))
        first = first_per(occurrences, MAX_SITES, "variable", "file", "line", "function", "kind")
        out = out.unionByName(first.groupBy("variable").agg(group.alias("o")).select(F.concat_ws("/", n, F.lit("dataflow/vars"), "variable").alias("key"), F.to_json("o").alias("value")))
        index = function_index(occurrences).groupBy("function").agg(F.array_sort(F.collect_list("variable")).alias("v"))  # as many as a function has variables
        out = out.unionByName(index.select(F.concat_ws("/", n, F.lit("dataflow/_func_index"), "function").alias("key"), F.to_json("v").alias("value")))
    info = chunks.agg(F.count("*").alias("chunks"), F.count_distinct("file").alias("files"))
    return out.unionByName(info.select(F.concat_ws("/", n, F.lit("_meta/info")).alias("key"), F.to_json(F.struct("chunks", "files")).alias("value")))


def symbol_chunk(kv: DataFrame, namespace: str, name: str) -> DataFrame:
    """The chunk of each place a symbol stands at, or its symbol record where there is no chunk."""
    places = kv.where(F.col("key") == f"{namespace}/symbols/{name}").select(F.explode(F.from_json("value", "array<struct<name:string,kind:string,file:string,line:long>>")).alias("s"))
    wanted = places.select(F.concat_ws("/", F.lit(namespace), F.lit("chunks"), "s.file", "s.name").alias("key"), F.to_json("s").alias("record"))
    return wanted.join(kv.select("key", F.col("value").alias("chunk")), "key", "left").select("key", F.coalesce("chunk", "record").alias("value"))


def context(kv: DataFrame, namespace: str, name: str) -> DataFrame:
    """name, symbols, callers, callees, variables: keyed lookups of one name in one row."""
    labels = {f"{namespace}/{part}/{name}": column for part, column in (("symbols", "symbols"), ("callers", "callers"), ("callees", "callees"), ("dataflow/vars", "variables"))}
    rows = kv.where(F.col("key").isin(*labels))
    return rows.agg(F.lit(name).alias("name"), *(F.max(F.when(F.col("key") == k, F.col("value"))).alias(c) for k, c in labels.items()))


def accepted_edges(records: DataFrame, functions: DataFrame) -> DataFrame:
    """Plugin call edges (caller, callee, ...) between known functions, without noise names, as src and dst."""
    known = functions.select(F.col("name").alias("callee")).distinct()
    return records.where(~noise_symbol(F.col("callee")) & (F.col("caller") != F.col("callee"))).join(known, "callee", "left_semi").withColumnsRenamed({"caller": "src", "callee": "dst"})


def chunk_records(records: DataFrame) -> DataFrame:
    """Plugin chunks worth keeping: named declarations, and functions only where assigned or exported."""
    anonymous = F.col("kind").isin("arrow_function", "function_expression")
    return records.where(F.col("kind").isin(*CHUNK_KINDS) | (anonymous & (F.col("assigned") | F.col("exported"))))


def import_edges(records: DataFrame) -> DataFrame:
    """source_file, target_file, kind, symbol: one row a symbol; a side-effect import has the symbol *."""
    symbols = F.when(F.col("kind") == "side_effect", F.array(F.lit("*"))).otherwise(F.split("symbols", r"\s*,\s*"))
    return records.select("source_file", "target_file", "kind", F.explode(symbols).alias("symbol"))


def imported_symbols(terms: DataFrame, symbols: DataFrame, repos: DataFrame, kv: DataFrame, current: str, k: int = 3) -> DataFrame:
    """Symbol records of imported names in the first k repositories that match the import terms."""
    matched = repositories_for(terms, repos.where(F.col("repo") != current)).orderBy("repo").limit(k)  # k rows, so they may be broadcast
    wanted = symbols.select("symbol").distinct().crossJoin(F.broadcast(matched)).select(F.concat_ws("/", "repo", F.lit("symbols"), "symbol").alias("key"))
    return kv.join(wanted, "key").select("key", "value")
