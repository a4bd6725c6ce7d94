"""Structure of source files: imports, definitions, endpoints; and what they resolve to."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_FIELDS = "imports array<string>, classes array<string>, functions array<string>, decorators array<string>, complexity int, parsed boolean"
_BRANCH = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.ExceptHandler, ast.With, ast.AsyncWith, ast.IfExp, ast.comprehension, ast.BoolOp)
_PATTERNS = {
    "js": (r"import\s+(?:[^'\"]*?from\s+)?['\"]([^'\"]+)['\"]|require\(\s*['\"]([^'\"]+)['\"]", r"class\s+([A-Za-z_$][\w$]*)", r"function\s*\*?\s*([A-Za-z_$][\w$]*)|(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*=\s*(?:async\s*)?\([^)]*\)\s*(?::[^=]+)?=>"),
    "go": (r"^\s*(?:import\s+)?(?:[\w.]+\s+)?\"([^\"]+)\"\s*$", r"type\s+(\w+)\s+struct", r"^func\s+(?:\([^)]*\)\s*)?(\w+)"),
    "rs": (r"^\s*(?:pub(?:\([^)]*\))?\s+)?use\s+([^;]+)", r"(?:struct|enum|trait)\s+(\w+)", r"fn\s+(\w+)"),
    "java": (r"^\s*import\s+(?:static\s+)?([\w.*]+)\s*;", r"(?:class|interface|enum|record)\s+(\w+)", r"(?:public|private|protected|static|final|\s)+[\w<>\[\], ?]+\s+(\w+)\s*\([^)]*\)\s*(?:throws[^{]+)?\{"),
}
_PATTERNS["ts"] = _PATTERNS["jsx"] = _PATTERNS["tsx"] = _PATTERNS["js"]
_PATTERNS["sol"] = (r"import\s+(?:[^'\";]*?from\s+)?['\"]([^'\"]+)['\"]", r"(?:contract|interface|library|struct)\s+(\w+)", r"(?:function|modifier|event|error)\s+(\w+)")
#: Languages known by their imports alone.
_PATTERNS |= {e: (r"^\s*#\s*include\s+[<\"]([^>\"]+)[>\"]", r"(?:class|struct|enum|union)\s+(\w+)\s*[:{]", r"^[\w:<>*&\s]+?\b(\w+)\s*\([^;]*\)\s*(?:const\s*)?\{") for e in ("c", "cc", "cpp", "h", "hpp")}
_PATTERNS["cs"] = (r"^\s*using\s+(?:static\s+)?([\w.]+)\s*;", r"(?:class|interface|struct|enum|record)\s+(\w+)", r"(?:public|private|protected|internal|static|async|\s)+[\w<>\[\], ?]+\s+(\w+)\s*\([^)]*\)\s*\{")
_PATTERNS["rb"] = (r"^\s*require(?:_relative)?\s+['\"]([^'\"]+)['\"]", r"^\s*(?:class|module)\s+([\w:]+)", r"^\s*def\s+(?:self\.)?(\w+[?!]?)")
_PATTERNS["php"] = (r"(?:require|include)(?:_once)?\s*\(?\s*['\"]([^'\"]+)['\"]|^\s*use\s+([\w\\]+)", r"(?:class|interface|trait)\s+(\w+)", r"function\s+(\w+)")
_PATTERNS["swift"] = (r"^\s*import\s+(?:class\s+|struct\s+)?([\w.]+)", r"(?:class|struct|enum|protocol)\s+(\w+)", r"func\s+(\w+)")
_PATTERNS["kt"] = (r"^\s*import\s+([\w.*]+)", r"(?:class|interface|object)\s+(\w+)", r"fun\s+(?:<[^>]*>\s*)?(?:[\w.]+\.)?(\w+)")
_COMPILED = {k: tuple(re.compile(p, re.M) for p in v) for k, v in _PATTERNS.items()}


#: Strings are kept, comments go; a mark inside a string begins none.
_NOISE = re.compile(r"(\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\.)*`)|//[^\n]*|/\*(?:[^*]|\*(?!/))*(?:\*/|\Z)", re.S)
_HTTP = re.compile(r"\bfetch\(\s*[`'\"]([^`'\"]+)[`'\"]\s*(?:,\s*\{[^}]*?\bmethod\s*:\s*['\"](\w+)['\"])?|\b(?:axios|api|http|client)\.(get|post|put|patch|delete|head)\(\s*[`'\"]([^`'\"]+)[`'\"]", re.S)


def without_comments(text: str) -> str:
    """The text of a C-like language with every comment as one blank."""
    return _NOISE.sub(lambda m: m[1] or " ", text)


def expand_use(tree: str) -> list[str]:
    """FN52: the paths of a Rust use tree, in order: ``a::{b, c::{self, d as e}}`` names a::b, a::c and a::c::d.

    One pass with a stack of prefixes; aliases are dropped, and a brace that is never closed ends with the text.
    """
    out: list[str] = []
    prefixes, path = [""], ""

    def done() -> None:
        nonlocal path
        name = re.sub(r"\s+as\s+\w+$", "", path.strip())
        if name == "self":
            name = ""
        full = re.sub(r"\s+", "", prefixes[-1] + name)
        if path.strip() and (full := full.removesuffix("::") if not name else full) and full not in out:
            out.append(full)
        path = ""

    for c in tree:
        if c == "{":
            prefixes.append(prefixes[-1] + path.strip())
            path = ""
        elif c == ",":
            done()
        elif c == "}":
            done()
            if len(prefixes) > 1:
                prefixes.pop()
        else:
            path += c
    done()
    return out


def http_calls(text: str) -> list[tuple[str, str]]:
    """FN55: (method, url) of fetch, axios and api calls with a literal url, in upper case and without a query."""
    out = []
    for m in _HTTP.finditer(text):
        url, method = (m[1], m[2] or "GET") if m[1] else (m[4], m[3])
        out.append((method.upper(), re.sub(r"\$\{[^}]*\}", "{}", url).split("?")[0]))
    return out


def _name(node: ast.AST) -> str:
    return ast.unparse(node).split("(")[0]


def analyze(path: str | None, text: str | None) -> tuple:
    """FN49-53: what one file imports and defines; Python by its syntax tree, others by patterns."""
    ext = (path or "").rpartition(".")[2]
    if text is None or ext != "py" and ext not in _COMPILED:
        return ([], [], [], [], 0, False)
    if ext == "py":
        try:
            tree = ast.parse(text)
        except (SyntaxError, ValueError, RecursionError, MemoryError):
            return ([], [], [], [], 0, False)
        imports, classes, functions, decorators, complexity = [], [], [], [], 0
        for node in ast.walk(tree):
            if isinstance(node, ast.Import):
                imports += [a.name for a in node.names]
            elif isinstance(node, ast.ImportFrom):
                imports.append("." * node.level + (node.module or ""))
            elif isinstance(node, ast.ClassDef):
                classes.append(node.name)
                decorators += map(_name, node.decorator_list)
            elif isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
                functions.append(node.name)
                decorators += map(_name, node.decorator_list)
            complexity += isinstance(node, _BRANCH)
        return (imports, classes, functions, decorators, complexity, True)
    if ext not in ("rb", "php"):
        text = without_comments(text)
    found = [[next(g for g in m.groups() if g) for m in p.finditer(text) if any(m.groups())] for p in _COMPILED[ext]]
    if ext == "rs":
        found[0] = [x for tree in found[0] for x in expand_use(tree)]
    return (*[[x.strip() for x in f] for f in found], [], len(re.findall(r"\b(?:if|for|while|case|catch|match)\b", text)), True)


def file_structure(df: DataFrame, keys: list[str], path: str, content: str) -> DataFrame:
    """FN49-53: (keys, imports, classes, functions, decorators, complexity, parsed), one row per input row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (*[pa.list_(pa.string())] * 4, pa.int32(), pa.bool_())
        names = ["imports", "classes", "functions", "decorators", "complexity", "parsed"]
        for batch in batches:
            n = batch.num_columns
            got = [analyze(p, t) for p, t in zip(batch.column(n - 2).to_pylist(), batch.column(n - 1).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns[: n - 2], *[pa.array([g[i] for g in got], type=k) for i, k in enumerate(kinds)]], [*batch.schema.names[: n - 2], *names])

    kinds = dict(df.dtypes)
    return df.select(*keys, F.col(path).alias("_p"), F.col(content).alias("_c")).mapInArrow(run, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", " + _FIELDS)


def resolve_imports(imports: DataFrame, files: DataFrame, group: str) -> DataFrame:
    """JN31: (group, path, import, target): the first candidate path that is a known file of the group.

    ``imports`` has group, path and import (a relative JavaScript path or a
    dotted Python module).  Candidates unfold per import and meet the files by
    equality.
    """
    parent = F.regexp_replace("path", "/?[^/]*$", "")
    raw = F.col("import")
    up = F.size(F.regexp_extract_all(raw, F.lit(r"(\.\./)"), F.lit(1)))
    base = F.array_join(F.slice(F.split(parent, "/"), 1, F.greatest(F.size(F.split(parent, "/")) - up, F.lit(0))), "/")
    tail = F.regexp_replace(raw, r"^(\.{1,2}/)+", "")
    joined = F.ltrim(F.concat_ws("/", base, tail), F.lit("/"))
    js = F.array(joined, *[F.concat(joined, F.lit(e)) for e in (".ts", ".tsx", ".js", ".jsx", "/index.ts", "/index.tsx", "/index.js", "/index.jsx")])
    dotted = F.translate(F.regexp_replace(raw, r"^\.+", ""), ".", "/")
    near = F.ltrim(F.concat_ws("/", parent, dotted), F.lit("/"))
    where = F.when(raw.startswith("."), near).otherwise(dotted)
    py = F.array(F.concat(where, F.lit(".py")), F.concat(where, F.lit("/__init__.py")))
    cand = F.when(raw.rlike(r"^\.{1,2}/"), js).otherwise(py)
    long = imports.select(group, "path", "import", F.posexplode(cand).alias("ord", "target"))
    known = files.select(group, F.col("path").alias("target"))
    hit = long.join(known, [group, "target"])
    return hit.groupBy(group, "path", "import").agg(F.min_by("target", "ord").alias("target"))


#: Extensions tried for a relative import without one, in order (fixed values).
GUESSED = ("js", "ts", "jsx", "tsx", "py", "rs", "java", "go", "cs", "rb", "php", "cpp", "c", "swift", "kt", "sol")


def resolve_relative(imports: DataFrame, files: DataFrame, group: str) -> DataFrame:
    """FN53: (group, path, import, target): relative imports by the file they name, else the file with a guessed extension, or an index file.

    ``imports`` has group, path and import.  An import that is not relative, or names no known file, keeps its own text as target.
    """
    dirs = F.split(F.regexp_replace("path", "/?[^/]*$", ""), "/")
    up = F.size(F.regexp_extract_all("import", F.lit(r"(?:^|/)(\.\.)(?=/|$)"), F.lit(1)))
    base = F.array_join(F.slice(dirs, 1, F.greatest(F.size(dirs) - up, F.lit(0))), "/")
    tail = F.regexp_replace("import", r"^(?:\.{1,2}/)+|^\.{1,2}$", "")
    clean = F.regexp_replace(F.concat_ws("/", base, tail), "^/+|/+$", "")
    guesses = [x for e in GUESSED for x in (F.concat(clean, F.lit(f".{e}")), F.concat(clean, F.lit(f"/index.{e}")))]
    long = imports.filter(F.col("import").startswith(".")).select(group, "path", "import", F.posexplode(F.array(clean, *guesses)).alias("ord", "target"))
    hit = long.join(files.select(group, F.col("path").alias("target")).distinct(), [group, "target"]).groupBy(group, "path", "import").agg(F.min_by("target", "ord").alias("target"))
    return imports.select(group, "path", "import").distinct().join(hit, [group, "path", "import"], "left").withColumn("target", F.coalesce("target", "import"))


def modified_functions(diffs: DataFrame, key: str, text: str) -> DataFrame:
    """FN61: (key, file, functions): names after ``def`` in hunk headers and added lines, a name once, in order of the diff.

    The file is that of the last ``diff --git`` line; lines before the first one name no file and drop out.
    """
    lines = F.split(F.replace(F.col(text), F.lit("\r"), F.lit("")), "\n")
    each = diffs.select(key, F.posexplode(lines).alias("no", "line"))
    file = F.last(F.when(F.col("line").startswith("diff --git"), F.regexp_extract("line", r" b/(.*)$", 1)), ignorenulls=True).over(Window.partitionBy(key).orderBy("no"))
    name = F.trim(F.regexp_extract("line", r"def ([^(]*)", 1))
    hit = each.withColumn("file", file).filter(F.col("file").isNotNull() & F.col("line").rlike(r"^(@@|\+(?!\+\+)).*def ")).withColumn("name", name).filter("name <> ''")
    first = hit.groupBy(key, "file", "name").agg(F.min("no").alias("no"))
    return first.groupBy(key, "file").agg(F.array_sort(F.collect_list(F.struct("no", "name"))).alias("xs")).select(key, "file", F.transform("xs", lambda x: x["name"]).alias("functions"))


def fix_proposals(broken: DataFrame, functions: DataFrame, pairs: DataFrame) -> DataFrame:
    """FN61: (key, file, other, sections, confidence): for each broken contract the functions of the other file that go with the modified ones.

    ``broken`` has commit_id, file and other, ``functions`` commit_id, file and functions, ``pairs`` file, function, other, section and
    confidence.  Without a known pair the confidence is 0.5 and there is no section.
    """
    named = functions.select("commit_id", "file", F.explode("functions").alias("function"))
    hit = broken.select("commit_id", "file", "other").distinct().join(named, ["commit_id", "file"]).join(pairs, ["file", "function", "other"])
    found = hit.groupBy("commit_id", "file", "other").agg(F.array_sort(F.collect_set("section")).alias("sections"), F.round(F.avg("confidence"), 2).alias("confidence"))
    out = broken.select("commit_id", "file", "other").distinct().join(found, ["commit_id", "file", "other"], "left")
    return out.withColumn("sections", F.coalesce("sections", F.array().cast("array<string>"))).na.fill(0.5, ["confidence"])


def import_names(df: DataFrame, keys: list[str], imports: str) -> DataFrame:
    """JN52: (keys, name, module): the names each import statement binds."""
    line = df.select(*keys, F.explode(imports).alias("i"))
    module = F.coalesce(F.nullif(F.regexp_extract("i", r"from\s+['\"]?([^'\" ;]+)['\"]?", 1), F.lit("")), F.nullif(F.regexp_extract("i", r"^(?:import|use)\s+([\w.:]+)", 1), F.lit("")), F.col("i"))
    bound = F.regexp_replace(F.regexp_replace("i", r"^from\s+\S+\s+import\s+|^import\s+|^use\s+|\s+from\s+.*$", ""), r"[{};]", "")
    each = F.transform(F.split(bound, ","), lambda x: F.regexp_replace(F.trim(x), r"^.*\bas\s+", ""))
    return line.select(*keys, F.explode(each).alias("name"), module.alias("module")).filter("name <> ''")
