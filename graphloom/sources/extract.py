"""Source text to nodes and edges: one pass over the files, tagged rows, two projections.

Python is read with the standard library's parser. The other languages have line scanners that know their definitions, imports and
calls by pattern, and match braces to find where a definition ends.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.text import make_id
from graphloom.operators.ranges import enclosing
from graphloom.plans.tables import kept, python_ready

#: Calls that say nothing about the program, by language (JavaScript, Python, Go, PHP, C#).
NOISE = frozenset(
    """
    console.log console.error console.warn console.info console.debug require setTimeout setInterval clearTimeout clearInterval
    parseInt parseFloat isNaN isFinite JSON.parse JSON.stringify Promise.resolve Promise.reject Promise.all Object.keys Object.values
    Object.assign Object.entries Array.isArray Array.from Math.floor Math.ceil Math.round Math.random Math.max Math.min
    String Number Boolean Date.now Error
    print len range str int float bool list dict set tuple type isinstance issubclass hasattr getattr setattr
    super enumerate zip map filter sorted reversed open repr abs min max sum any all next iter
    fmt.Println fmt.Printf fmt.Sprintf fmt.Fprintf fmt.Errorf log.Println log.Printf log.Fatal log.Fatalf
    make append len cap close delete copy new panic recover
    var_dump print_r echo isset unset empty is_null is_array is_string is_int array_map array_filter array_merge
    count strlen substr strpos sprintf implode explode json_encode json_decode intval floatval
    Console.WriteLine Console.Write Console.ReadLine string.IsNullOrEmpty string.IsNullOrWhiteSpace string.Format string.Join string.Concat
    Convert.ToInt32 Convert.ToString Convert.ToBoolean Convert.ToDecimal
    Math.Abs Math.Max Math.Min Math.Floor Math.Ceiling Math.Round DateTime.Now DateTime.UtcNow DateTime.Parse
    Enum.Parse Enum.GetValues Task.FromResult Task.CompletedTask Task.WhenAll Task.WhenAny Object.ReferenceEquals GC.Collect
    nameof typeof sizeof ArgumentNullException ArgumentException InvalidOperationException NotImplementedException NotSupportedException
    """.split()
)
VERBS = frozenset("get post put patch delete head options route".split())
HOLDERS = frozenset("app router blueprint bp api".split())

_WORD = r"(?P<name>[A-Za-z_]\w*)"
#: Definitions by language: node type and pattern.
_DEFINITIONS = {
    "php": [("class", rf"^\s*(?:abstract |final )*class {_WORD}"), ("interface", rf"^\s*interface {_WORD}"), ("function", rf"^\s*(?:(?:public|private|protected|static|abstract|final)\s+)*function {_WORD}\s*\((?P<args>[^)]*)\)")],
    "javascript": [("class", rf"^\s*(?:export )?(?:default )?class {_WORD}"), ("function", rf"^\s*(?:export )?(?:default )?(?:async )?function\*? {_WORD}\s*\((?P<args>[^)]*)\)"), ("function", r"^\s*export default (?:async )?(?:function\b\s*)?\((?P<args>[^)]*)\)"), ("function", r"^\s*(?:module\.)?exports(?:\.(?P<key>\w+))?\s*=\s*(?:async\s+)?(?:function\b\s*(?P<name>\w+)?\s*)?\((?P<args>[^)]*)\)"), ("function", rf"^\s*(?:export )?(?:const|let|var) {_WORD}\s*(?::[^=]+)?=\s*(?:async\s*)?(?:function\b[^(]*)?\((?P<args>[^)]*)\)"), ("method", rf"^\s+(?:(?:public|private|protected|static|async|get|set)\s+)*(?!if\b|for\b|while\b|switch\b|return\b|catch\b){_WORD}\s*\((?P<args>[^)]*)\)\s*(?::[^{{;]+)?\{{")],
    "go": [("function", rf"^func (?:\(\w+ \*?(?P<owner>\w+)\) )?{_WORD}\s*\((?P<args>[^)]*)\)"), ("class", rf"^type {_WORD} struct"), ("interface", rf"^type {_WORD} interface")],
    "csharp": [("constructor", rf"^\s*(?:(?:public|private|protected|internal|static)\s+)+{_WORD}\s*\((?P<args>[^)]*)\)\s*(?::\s*(?:base|this)\b.*)?(?:\{{.*|=>.*)?$"), ("class", rf"^\s*(?:(?:public|private|internal|static|sealed|abstract|partial)\s+)*class {_WORD}"), ("interface", rf"^\s*(?:(?:public|internal)\s+)*interface {_WORD}"), ("method", rf"^\s*(?:(?:public|private|protected|internal|static|async|override|virtual)\s+)+(?P<returns>[\w.]+(?:<[\w\s.<>\[\],?]*>)?[\[\],?]*) {_WORD}\s*\((?P<args>[^)]*)\)")],
}
_DEFINITIONS["typescript"] = [("interface", rf"^\s*(?:export )?interface {_WORD}"), ("class", rf"^\s*(?:export )?enum {_WORD}"), *_DEFINITIONS["javascript"]]
_IMPORT = re.compile(r"""^\s*(?:use ([\w\\]+)|import .*?from ['"]([^'"]+)|import "([^"]+)"|using ([\w.]+);|.*require\(['"]([^'"]+))""")
_CALL = re.compile(r"([A-Za-z_$][\w$]*(?:(?:\.|->|::)[A-Za-z_$][\w$]*)*)\s*\(")
_FETCH = re.compile(r"""\b(?:fetch\(|axios\.\w+\(|http\.(?:Get|Post|Head)\(|http\.NewRequest\([^,'"]*(?:['"][^'"]*['"])?\s*,)\s*['"]([^'"]+)['"]""")
_ROUTE = re.compile(r"""[\[,]\s*(Route|Http(?:Get|Post|Put|Delete|Patch))\b(?:\(\s*(?:path:\s*)?@?['"]([^'"]*)['"])?""")
_SPACE = re.compile(r"^\s*namespace\s+([\w\\.]+)")
_GO_IMPORT = re.compile(r"""^\s*(?:import\s+)?(?:[\w.]+\s+)?"([^"]+)"\s*$""")
_COMMENT = re.compile(r"(?:^|\s)(?://|#(?!\[)|/?\*+)\s?(.*)$")


def without_noise(calls: DataFrame, callee: str) -> DataFrame:
    """calls but those of built-in names, of which there are 149."""
    return calls.filter(~F.col(callee).isin(*sorted(NOISE)))


def _row(kind: str, **more) -> dict:
    return {"kind": kind, "type": None, "name": None, "start_line": None, "end_line": None, "visibility": None, "is_async": False, "parameters": [], "return_type": None, "parent_symbol": None, "summary": "", "owner": None, "target": None, "relation": None, "context": None, "is_bridge": False} | more


def _returns(code: str, m: re.Match, language: str) -> str | None:
    """The return type in a definition's line; null where there is none, for PHP's union types and for Go's result lists."""
    parts = m.groupdict()
    if parts.get("returns") or parts.get("args") is None:
        return parts.get("returns")
    at, depth = m.start("args"), 1
    while at < len(code) and depth:
        depth += (code[at] == "(") - (code[at] == ")")
        at += 1
    rest = code[at:].strip()
    if language == "php":
        found = re.match(r":\s*(\??[\w\\]+)(?!\s*[|&\w\\])", rest)
        return found[1] if found else None
    if language == "go":
        found = re.match(r"(.*?)(?:(?<!interface)(?<!struct)\{|$)", rest)[1].strip()
        return found if re.fullmatch(r"(?:\*|\[|map\[).+|(?!interface\b|struct\b|func\b|chan\b)[\w.]+", found) else None
    if language != "typescript" or not rest.startswith(":"):
        return None
    rest, depth, arrow = rest[1:].strip(), 0, not re.search(r"\bfunction\b", code) and "=" in code[: m.start("args")]
    for i, c in enumerate(rest):  # until the body, the arrow of an arrow function or the end of a signature
        points = rest[i : i + 2] == "=>"
        if not depth and (c == ";" or points and arrow or c == "{" and i and not re.search(r"(?:[|&]|=>)\s*$", rest[:i])):
            return rest[:i].strip() or None
        depth += (c in "([{<") - (c in ")]}" or c == ">" and rest[i - 1 : i] != "=")
    return rest or None


def _arguments(code: str, at: int) -> list[str]:
    """The texts of the arguments that begin at a place in a line, cut at commas outside brackets and quotes."""
    out, depth, quote, begin = [], 0, "", at
    for i in range(at, len(code)):
        c = code[i]
        if quote:
            quote = "" if c == quote else quote
        elif c in "'\"`":
            quote = c
        elif c in "([{" or c == "<" and depth:
            depth += 1
        elif c in ")]}" and depth:
            depth -= 1
        elif c == ")":
            return [x.strip() for x in [*out, code[begin:i]] if x.strip()]
        elif c == "," and not depth:
            out.append(code[begin:i])
            begin = i + 1
    return [x.strip() for x in [*out, code[begin:]] if x.strip()]


def _parameter(argument: str, language: str) -> str:
    """The name of a parameter; empty where it has none (a pattern)."""
    argument = argument.split("=")[0].strip().lstrip("&.")
    if language in ("javascript", "typescript", "go"):
        argument = re.sub(r"^(?:(?:public|private|protected|readonly)\s+)+", "", argument)
        name = re.split(r"[\s:?]", argument)[0]
    else:
        name = (argument.split() or [""])[-1]
    name = name.lstrip("$&.*")
    return name if re.fullmatch(r"\w+", name) else ""


def python_rows(text: str) -> Iterator[dict]:
    def calls(node, owner):
        for c in (x for part in node.body for x in ast.walk(part)):  # not those of decorators and defaults
            if isinstance(c, ast.Call) and (shown := ast.unparse(c.func)) not in NOISE:
                yield _row("edge", owner=owner, target=shown, relation="calls", context=ast.unparse(c)[:200])

    def function(f, prefix, kind):
        args = [a.arg for a in (*f.args.posonlyargs, *f.args.args, *f.args.kwonlyargs) if a.arg not in ("self", "cls")]
        name = prefix + f.name
        yield _row("node", type=kind, name=name, start_line=f.lineno, end_line=f.end_lineno, is_async=isinstance(f, ast.AsyncFunctionDef), parameters=args, return_type=ast.unparse(f.returns) if f.returns else None, visibility="private" if f.name.startswith("_") else "public", summary=ast.get_docstring(f) or "")
        if not prefix:
            for d in f.decorator_list:
                if isinstance(d, ast.Call) and isinstance(d.func, ast.Attribute) and isinstance(d.func.value, ast.Name) and d.func.value.id in HOLDERS and d.func.attr in VERBS and d.args and isinstance(d.args[0], ast.Constant):
                    yield _row("node", type="endpoint", name=str(d.args[0].value), start_line=f.lineno, end_line=f.end_lineno, summary=f"Route: {d.func.attr.upper()} {d.args[0].value}")
                    yield _row("edge", owner=name, target=str(d.args[0].value), relation="defines")
        yield from calls(f, name)

    for node in ast.parse(text).body:
        if isinstance(node, ast.Import | ast.ImportFrom):
            for a in node.names:
                yield _row("edge", owner="__file__", target=f"{node.module or ''}.{a.name}" if isinstance(node, ast.ImportFrom) else a.name, relation="imports")
        elif isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef):
            yield from function(node, "", "function")
        elif isinstance(node, ast.ClassDef):
            yield _row("node", type="class", name=node.name, start_line=node.lineno, end_line=node.end_lineno, summary=ast.get_docstring(node) or "")
            for f in node.body:
                if isinstance(f, ast.FunctionDef | ast.AsyncFunctionDef):
                    yield _row("edge", owner=node.name, target=f"{node.name}.{f.name}", relation="defines")
                    yield from function(f, f"{node.name}.", "method")
    for i, line in enumerate(text.split("\n"), 1):
        if (m := re.match(r"\s*#\s?(.*)$", line)) and len(m[1].strip()) >= 3:
            yield _row("node", type="comment", name=f"comment:{i}", start_line=i, end_line=i, summary=m[1].strip()[:500])


def scanned_rows(text: str, language: str) -> Iterator[dict]:
    lines = text.split("\n")
    rules = [(kind, re.compile(p)) for kind, p in _DEFINITIONS[language]]
    sep = "::" if language == "php" else "."
    depth, open_now, space, group, routes = 0, [], "", False, []  # open_now: (depth at which it closes, row)
    for i, line in enumerate(lines, 1):
        if (m := _COMMENT.search(line)) and len(m[1].strip()) >= 3 and not re.match(r"\s*['\"]", line):
            yield _row("node", type="comment", name=f"comment:{i}", start_line=i, end_line=i, summary=m[1].strip(" */")[:500])
        code = re.sub(r"(?<!:)//.*$", "", line)
        if language == "go" and (group or code.startswith("import")):
            group = not code.strip().startswith(")") and (group or code.rstrip().endswith("("))
            if m := _GO_IMPORT.match(code):
                yield _row("edge", owner="__file__", target=m[1], relation="imports")
        elif m := _IMPORT.match(code):
            yield _row("edge", owner="__file__", target=next(g for g in m.groups() if g), relation="imports")
        if language in ("php", "csharp") and (m := _SPACE.match(code)):
            space = m[1] + ("\\" if language == "php" else ".")
        if language in ("php", "csharp") and "[" in code:
            routes += _ROUTE.findall(code)
        owner = open_now[-1][1]["name"] if open_now else None
        holder = next((r["name"] for _, r in reversed(open_now) if r["type"] in ("class", "interface")), None)
        found = None
        for kind, rule in rules:
            if not (m := rule.match(code)):
                continue
            parts = m.groupdict()
            name = parts.get("name") or parts.get("key") or "__default__"
            if kind == "constructor":
                if not holder or holder.split(".")[-1] != name:
                    continue
                kind = "method"
            base = parts.get("owner") or (holder if kind in ("function", "method") else None)
            args = [x for x in (_parameter(a, language) for a in _arguments(code, m.start("args"))) if x] if parts.get("args") is not None else []
            seen = re.search(r"\b(public|private|protected|internal)\b", code)
            shown = seen[1] if seen else "public" if language == "php" and base else None
            full = f"{base}{sep}{name}" if base else f"{space}{name}"
            found = _row("node", type="method" if base else kind, name=full, start_line=i, end_line=i, is_async=bool(re.search(r"\basync\b", code.split("(")[0] + (code if "=" in code else ""))), parameters=args, return_type=_returns(code, m, language), visibility=shown, summary="enum" if re.match(r"\s*(?:export )?(?:const )?enum ", code) else "")
            if base:
                yield _row("edge", owner=base, target=full, relation="defines")
            yield from _routes(routes, language, found, i)
            routes = []
            break
        for m in _FETCH.finditer(code):
            yield _row("node", type="endpoint", name=m[1], start_line=i, end_line=i)
            yield _row("edge", owner=(found or {}).get("name") or owner or "__file__", target=m[1], relation="networks_to", is_bridge=True, context=code.strip()[:200])
        if found is None and owner:
            for m in _CALL.finditer(code):
                if m[1] not in NOISE and not re.search(r"\bnew\s+$", code[: m.start()]) and m[1] not in ("if", "for", "foreach", "while", "switch", "catch", "return", "function", "using", "lock"):
                    yield _row("edge", owner=owner, target=m[1], relation="calls", context=code[m.start() :].strip()[:200])
        before = depth
        depth += code.count("{") - code.count("}")
        if found:
            open_now.append((before, found))
        while open_now and depth <= open_now[-1][0] and ("}" in code or ";" in code or "=>" in code):
            row = open_now.pop()[1]
            row["end_line"] = i
            yield row
    for _, row in reversed(open_now):
        row["end_line"] = len(lines)
        yield row


def _routes(routes: list[tuple[str, str]], language: str, found: dict, line: int) -> Iterator[dict]:
    """The endpoint that attributes before a definition state. In C# a verb is needed, and the verb is the path if none is given."""
    verb = next((v for v, _ in routes if v != "Route"), None)
    path = next((p for _, p in reversed(routes) if p), None)
    if language == "csharp":
        path = (path or f"/{verb}") if verb and found["type"] == "method" else None
    if path:
        yield _row("node", type="endpoint", name=path, start_line=line, end_line=line, summary=f"Route: {path}")
        yield _row("edge", owner=found["name"], target=path, relation="defines")
        if found["type"] == "class":
            found["summary"] = f"Route: {path}"


_SCHEMA = "path string, language string, error string, n int, kind string, type string, name string, start_line int, end_line int, visibility string, is_async boolean, parameters array<string>, return_type string, parent_symbol string, summary string, owner string, target string, relation string, context string, is_bridge boolean"
_COLUMNS = [c.split()[0] for c in _SCHEMA.split(", ")]


def _extract(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        rows = []
        for path, language, content in zip(frame.path, frame.language, frame.content):
            try:
                text = bytes(content).decode("utf-8", "replace")
                found = list(python_rows(text) if language == "python" else scanned_rows(text, language))
                found.sort(key=lambda r: (r["type"] == "comment", r["start_line"] or 0))
                rows += [r | {"path": path, "language": language, "error": None, "n": k} for k, r in enumerate(found)]
            except Exception as e:  # too deep, too large, not the language: one file that cannot be read is a row of errors, not the end of the scan
                rows.append(_row("error") | {"path": path, "language": language, "error": f"{type(e).__name__}: {e}", "n": 0})
        yield pd.DataFrame(rows, columns=_COLUMNS)


def extract(files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, errors) of files (path, language, content), as schema.NODES and schema.EDGES have them (nodes also with n).

    Files are parsed once and the rows kept. `seq` numbers all rows by path and place in the file. A comment's parent is the symbol
    around it, else the one that ended at most five lines before.
    """
    found = python_ready(files).filter("language is not null").select("path", "language", "content").mapInPandas(_extract, _SCHEMA)
    rows = kept(found.orderBy("path", "n").withColumn("seq", F.monotonically_increasing_id()))
    file = F.col("path").alias("file")
    points = rows.filter("type = 'comment'").select(file, F.col("seq").alias("pid"), F.col("start_line").alias("at"))
    spans = rows.filter("type in ('class', 'interface', 'function', 'method')").select(file, F.col("seq").alias("sid"), F.col("start_line").alias("lo"), F.col("end_line").alias("hi"), F.col("name").alias("parent"))
    parents = enclosing(points, spans.drop("parent"), 5).join(spans.select("sid", "parent"), "sid").select(F.col("pid").alias("seq"), "parent")
    nodes = rows.filter("kind = 'node'").join(parents, "seq", "left").select(
        "seq", "n", make_id(F.col("path"), F.col("name")).alias("id"), "type", "name", file, "start_line", "end_line", "language", "visibility", "is_async",
        F.lit(None).cast("int").alias("complexity_score"), "parameters", "return_type", F.coalesce("parent_symbol", "parent").alias("parent_symbol"), "summary",
    )
    edges = rows.filter("kind = 'edge'").select(
        F.col("seq").alias("edge_id"), make_id(F.col("path"), F.col("owner")).alias("source"), make_id(F.when(F.col("relation").isin("defines", "networks_to"), F.col("path")).otherwise(""), F.col("target")).alias("target"), "relation", "is_bridge",
        F.when(F.col("relation") == "calls", 0.8).otherwise(1.0).alias("confidence"), F.coalesce("context", "target").alias("context"), file,
    )
    return nodes, edges, rows.filter("kind = 'error'").select("path", "error")
