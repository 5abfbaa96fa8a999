"""Facts of Python sources: one parse of each file yields symbols, calls, imports, routes, classes, places of stores and flows.

The parse is the one step that needs Python; it runs batch-wise next to the scan and returns flat rows, and everything
after it is relational. Every row names its file and its place in the file (``ord``); rows of calls name the definitions
around them (``owners``, outermost first, by the ``ord`` of their rows), so what is said of a call can be said of each of them.
"""

from __future__ import annotations

import ast
import re
import warnings
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import calls as shapes
from . import flow, sites
from .flow import Function, dotted

SCHEMA = (
    "path string, fact string, ord int, depth int, scope string, class_name string, owners array<int>, name string, target string, "
    "text string, mode string, flag boolean, line int, line_end int, items array<string>"
)
_COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]
# Decorators that make a function a route, and calls that make a page element an entry.
ROUTE_VERBS = {"get": "GET", "post": "POST", "put": "PUT", "delete": "DELETE", "patch": "PATCH", "head": "HEAD", "options": "OPTIONS", "websocket": "WS"}
GUARDS = {"require_GET": "GET", "require_POST": "POST", "require_PUT": "PUT", "require_PATCH": "PATCH", "require_DELETE": "DELETE", "require_safe": "GET"}
LISTS = ("require_http_methods", "api_view")
PAGE_MODULE, PAGE_NAMES = "streamlit", ("st", "streamlit")
WIDGETS = ("chat_input", "form_submit_button", "button", "file_uploader")
CONNECT = "create_mcp_server"
TOOL_CALLS = ("Tool", "StructuredTool")
FACTORY = re.compile(r"^(?:[\w.]+\.)?mcp\.servers\.([a-z_][a-z0-9_]*)\.server\.create_([a-z_][a-z0-9_]*)_server$")


def _literal(node) -> str | None:
    return node.value if isinstance(node, ast.Constant) and isinstance(node.value, str) else None


def _first_method(node: ast.AST | None) -> str | None:
    return next((x.upper() for x in map(_literal, node.elts) if x), None) if isinstance(node, (ast.List, ast.Tuple)) else None


def _mode(call: ast.Call) -> str | None:
    return next((m for m in (_literal(x) for x in [*call.args[1:2], *(k.value for k in call.keywords if k.arg == "mode")]) if m is not None), None)


def _text(call: ast.Call) -> str | None:
    return next((t for t in map(_literal, call.args) if t is not None), None)


def _shell(call: ast.Call) -> bool:
    return any(k.arg == "shell" and isinstance(k.value, ast.Constant) and k.value.value is True for k in call.keywords)


def _dangerous(call: ast.Call) -> bool:
    name = dotted(call.func)
    return bool(name) and shapes.dangerous(name, _text(call), _mode(call), _shell(call))


def _commits(call: ast.Call) -> bool:
    name = dotted(call.func)
    return bool(name) and "commit" in shapes.shown_by(name)


def route_of(decorator: ast.AST) -> tuple[str, str] | None:
    """(method, path) of a decorator that makes a function a route."""
    if isinstance(decorator, ast.Name):
        return (GUARDS[decorator.id], "") if decorator.id in GUARDS else None
    if not isinstance(decorator, ast.Call):
        return None
    if isinstance(decorator.func, ast.Name):
        method = _first_method(decorator.args[0]) if decorator.func.id in LISTS and decorator.args else None
        return (method, "") if method else None
    verb = decorator.func.attr if isinstance(decorator.func, ast.Attribute) else ""
    path = _literal(decorator.args[0]) if decorator.args else None
    if path is None or verb not in ROUTE_VERBS and verb != "route":
        return None
    return ROUTE_VERBS.get(verb) or _first_method(next((k.value for k in decorator.keywords if k.arg == "methods"), None)) or "GET", path


class _Facts(ast.NodeVisitor):
    def __init__(self, path: str) -> None:
        self.path = path
        self.rows: list[tuple] = []
        self.owners: list[tuple[int, ast.AST]] = []
        self.names: list[flow.Names] = []
        self.depth = 0
        self.in_expression = False
        self.assigned: dict[str, ast.AST] = {}

    def add(self, fact: str, **v) -> int:
        functions = [n for _, n in self.owners if isinstance(n, Function)]
        inside = self.owners[-1][1] if self.owners else None
        around = next((n for _, n in reversed(self.owners) if isinstance(n, ast.ClassDef)), None)
        own = {
            "path": self.path, "fact": fact, "ord": len(self.rows), "depth": self.depth, "scope": functions[-1].name if functions else "<module>",
            "class_name": (inside.name if isinstance(inside, ast.ClassDef) else None) if fact in ("function", "class") else around.name if around else None,
            "owners": [o for o, _ in self.owners],
        } | v
        self.rows.append(tuple(own.get(c) for c in _COLUMNS))
        return len(self.rows) - 1

    def generic_visit(self, node) -> None:
        self.depth += 1
        super().generic_visit(node)
        self.depth -= 1

    def visit_Import(self, node) -> None:
        for a in node.names:
            self.add("import", target=a.name, line=node.lineno)
            self.add("imported", target=a.name)

    def visit_ImportFrom(self, node) -> None:
        if not node.level and node.module:
            self.add("import", target=node.module, line=node.lineno)
        base = node.module or ""
        if node.level:
            folders = self.path.split("/")[:-1]
            package = ".".join(folders[: max(0, len(folders) - node.level + 1)])
            base = ".".join(x for x in (package, base) if x)
        for target in dict.fromkeys([base, *(f"{base}.{a.name}" if base else a.name for a in node.names)]):
            if target:
                self.add("imported", target=target)
        for a in node.names:
            self.add("imported_name", name=a.asname or a.name, target=base, text=a.name)

    def visit_ClassDef(self, node) -> None:
        bases = [b.id for b in node.bases if isinstance(b, ast.Name)]
        grade, shown = flow.of_class(node, _dangerous, _commits)
        at = self.add("class", name=node.name, target=bases[0] if len(node.bases) == 1 and bases else None, text=grade, line=node.lineno, line_end=node.end_lineno, items=[x for x in map(dotted, node.bases) if x], flag=not self.owners)
        self.add("sink_flow", name=node.name, text=grade, items=shown, line=node.lineno, mode="class")
        for d in node.decorator_list:
            self.visit(d)
        self._inside(at, node, node.body)

    def _inside(self, at: int, node: ast.AST, body: list[ast.AST]) -> None:
        self.owners.append((at, node))
        self.depth += 1
        for x in body:
            self.visit(x)
        self.depth -= 1
        self.owners.pop()

    def _function(self, node) -> None:
        grade, shown = flow.of_body(node, _dangerous, _commits)
        at = self.add("function", name=node.name, text=grade, flag=flow.returns_data(node), line=node.lineno, line_end=node.end_lineno, items=flow.parameters(node))
        self.add("sink_flow", name=node.name, text=grade, items=shown, line=node.lineno, mode="function")
        routed = False
        for d in node.decorator_list:
            call = d if isinstance(d, ast.Call) else None
            target = dotted(call.func if call else d)
            if target is not None:
                self.add("decorator", name=node.name, target=target, text=_literal(call.args[0]) if call and call.args else None, flag=call is not None, line=d.lineno, items=flow.parameters(node), mode=str(at))
            route = route_of(d)
            if route:
                routed = True
                self.add("route", name=node.name, mode=route[0], target=route[1], line=node.lineno)
        for framework in sites.upload_frameworks(node, routed):
            self.add("upload", name=node.name, target=framework, line=node.lineno)
        self.names.append(flow.names_of(node))
        self._inside(at, node, [*node.args.defaults, *(d for d in node.args.kw_defaults if d), *node.decorator_list, *node.body])
        self.names.pop()

    visit_FunctionDef = visit_AsyncFunctionDef = _function

    def visit_Expr(self, node) -> None:
        if isinstance(node.value, ast.Constant):
            return  # a text that stands for itself is a comment
        before, self.in_expression = self.in_expression, self.in_expression or not self.owners and self.depth == 1
        self.generic_visit(node)
        self.in_expression = before

    def visit_Constant(self, node) -> None:
        if isinstance(node.value, str) and (m := FACTORY.match(node.value)) and m.group(1) == m.group(2):
            self.add("server_literal", name=m.group(1))

    def visit_If(self, node) -> None:
        t = node.test
        if isinstance(t, ast.Compare) and len(t.ops) == 1 and isinstance(t.ops[0], ast.Eq) and not self.owners and self.depth == 1:
            sides = [t.left, t.comparators[0]]
            if any(isinstance(s, ast.Name) and s.id == "__name__" for s in sides) and any(_literal(s) == "__main__" for s in sides):
                self.add("main", line=node.lineno)
        self.generic_visit(node)

    def _assigned(self, targets, value) -> None:
        call = dotted(value.func) if isinstance(value, ast.Call) else None
        if call:
            by_name = next((_literal(k.value) for k in value.keywords if k.arg == "name"), None)
            by_place = _literal(value.args[0]) if value.args else None
            names = [x for x in map(dotted, targets) if x]
            for name in names:
                self.add("assign", name=name, target=call, text=by_name, mode=by_place, flag=len(names) == 1, line=value.lineno, items=[x for x in (dotted(a) for a in value.args) if x])

    def visit_Assign(self, node) -> None:
        self._assigned(node.targets, node.value)
        self.generic_visit(node)

    def visit_AnnAssign(self, node) -> None:
        self._assigned([node.target], node.value)
        self.generic_visit(node)

    def _behind(self, node: ast.AST | None) -> ast.AST | None:
        """What a name was last assigned, followed to the end; None where that is nowhere or in a circle."""
        passed = set()
        while isinstance(node, ast.Name):
            if node.id in passed:
                return None
            passed.add(node.id)
            node = self.assigned.get(node.id)
        return node

    def _tool_names(self, node: ast.AST | None) -> list[str]:
        """What the members of a list of tools are called, as far as constructors tell."""
        node = self._behind(node)
        if isinstance(node, (ast.List, ast.Tuple)):
            return [x for e in node.elts for x in self._tool_names(e)]
        if not isinstance(node, ast.Call):
            return []
        wraps = isinstance(node.func, ast.Attribute) and node.func.attr == "from_function"
        if not wraps and (dotted(node.func) or "").rpartition(".")[2] not in TOOL_CALLS:
            return []
        named = next((_literal(k.value) for k in node.keywords if k.arg == "name"), None) or (_literal(node.args[0]) if node.args else None)
        inner = dotted(node.args[0]) if wraps and node.args else None
        return [x for x in [named or (inner.rpartition(".")[2] if inner else None)] if x]

    def visit_Call(self, node) -> None:
        target = dotted(node.func)
        if target:
            grade, shown = flow.of_call(node, self.names[-1] if self.names else flow.Names())
            at = self.add("call", target=target, text=_text(node), mode=_mode(node), flag=_shell(node), line=node.lineno, name="expression" if self.in_expression and not self.owners else None)
            if self.names:
                self.add("call_flow", name=target.rpartition(".")[2], text=grade, items=shown, line=node.lineno)
            self._framework(node, target, at)
            if target.rpartition(".")[2] == CONNECT and node.args and _literal(node.args[0]):
                self.add("connects", name=_literal(node.args[0]), line=node.lineno)
            if target.count(".") == 1 and target.partition(".")[0] in PAGE_NAMES and target.partition(".")[2] in WIDGETS:
                self.add("widget", target=target.partition(".")[2], line=node.lineno)
        self.generic_visit(node)

    def _framework(self, node: ast.Call, target: str, at: int) -> None:
        """What agents are given, and what a graph's steps lead to."""
        for k in node.keywords:
            if k.arg == "tools":
                self.add("given", target=target, mode="tools", name=str(at), items=self._tool_names(k.value), line=node.lineno)
            elif k.arg in ("model", "llm"):
                value = self._behind(k.value)
                name = dotted(value.func) if isinstance(value, ast.Call) else dotted(value) if value is not None else None
                self.add("given", target=target, mode="model", name=str(at), items=[name.rpartition(".")[2]] if name else [], line=node.lineno)
        verb = target.rpartition(".")[2]
        first = _literal(node.args[0]) if node.args else None
        if verb == "add_edge" and len(node.args) > 1 and first and _literal(node.args[1]):
            self.add("link", name=first, text=_literal(node.args[1]), target=target, line=node.lineno)
        elif verb == "add_conditional_edges" and first:
            routes = next((x for x in [*node.args[2:3], *(k.value for k in node.keywords if k.arg == "path_map")] if isinstance(x, (ast.Dict, ast.List))), None)
            for x in (routes.values if isinstance(routes, ast.Dict) else routes.elts) if routes is not None else []:
                if _literal(x):
                    self.add("link", name=first, text=_literal(x), target=target, line=node.lineno)


def read(path: str, content: bytes) -> list[tuple]:
    """All facts of one file in the order of its text; none if it does not parse. Bytes that are no UTF-8 are replaced."""
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = ast.parse(content.decode("utf-8-sig", "replace"))
        visitor = _Facts(path)
        visitor.assigned = {t.id: n.value for n in ast.walk(tree) if isinstance(n, ast.Assign) for t in n.targets if isinstance(t, ast.Name)}
        visitor.add("file")
        visitor.visit(tree)
        for s in sites.store_sites(tree):
            visitor.add("site", target=s.family, mode=s.side, text=s.hint, line=s.line, name=s.target)
        return visitor.rows
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return []


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield pd.DataFrame([row for path, content in zip(pdf["path"], pdf["content"]) for row in read(path, bytes(content))], columns=_COLUMNS)


def facts(files: DataFrame) -> DataFrame:
    """(path, fact, ord, ...) of the Python files among (path, language, content); null contents give none."""
    python = files.filter((F.lower(F.trim("language")) == "python") & F.col("content").isNotNull())
    return python.select("path", "content").mapInPandas(_read, SCHEMA)


def symbols(found: DataFrame) -> DataFrame:
    """(path, kind, name, class_name, line, line_end, ord)."""
    kind = F.when(F.col("fact") == "class", "class").when(F.col("class_name").isNotNull(), "method").otherwise("function")
    return found.filter("fact in ('class', 'function')").select("path", kind.alias("kind"), "name", F.when(F.col("fact") == "function", F.col("class_name")).alias("class_name"), "line", "line_end", "ord")


def call_rows(found: DataFrame) -> DataFrame:
    """Calls as ``functions.calls.call_capabilities`` reads them."""
    return found.filter("fact = 'call'").select("path", "scope", "class_name", "owners", F.col("name").alias("place"), "target", F.col("text").alias("first_str_arg"), F.col("mode").alias("open_mode"), F.col("flag").alias("shell_true"), "line", "ord")


def definition_capabilities(found: DataFrame) -> DataFrame:
    """(path, ord, kind, name, class_name, caps): every class and function with all that the calls inside of it show.

    A call counts for each definition around it, so a method and its class have what a function nested in it shows, and two
    classes with a method of one name have each their own.
    """
    spark = found.sparkSession
    shown = shapes.call_capabilities(call_rows(found), shapes.rule_table(spark))
    caps = shown.select("path", F.explode("owners").alias("ord"), "capability").groupBy("path", "ord").agg(F.array_sort(F.collect_set("capability")).alias("caps"))
    return symbols(found).join(caps, ["path", "ord"], "left").withColumn("caps", F.coalesce("caps", F.array().cast("array<string>"))).select("path", "ord", "kind", "name", "class_name", "caps")


def module_capabilities(found: DataFrame) -> DataFrame:
    """(path, caps): what the expression statements of a module show outside of its definitions."""
    shown = shapes.call_capabilities(call_rows(found).filter("place = 'expression'"), shapes.rule_table(found.sparkSession))
    return shown.groupBy("path").agg(F.array_sort(F.collect_set("capability")).alias("caps"))


def symbol_capabilities(found: DataFrame, definitions: DataFrame | None = None) -> DataFrame:
    """(path, name, caps): what a name of a file is known to show, by the first definition that says so.

    Top-level classes come first, each before its methods, then top-level functions, then others by depth; functions that show
    nothing are passed over, so a later one of the same name speaks for them.
    """
    own = definition_capabilities(found) if definitions is None else definitions
    places = found.filter("fact in ('class', 'function')").select("path", "ord", "depth", F.coalesce(F.get("owners", F.lit(0)), F.col("ord")).alias("top"), F.size("owners").alias("around"))
    top_class = (F.col("kind") == "class") & (F.col("around") == 0)
    method = (F.col("kind") == "method") & (F.col("around") == 1)
    rank = F.when(top_class | method, F.struct(F.lit(0).alias("a"), F.col("top").alias("b"), F.when(top_class, 0).otherwise(1).alias("c"), "ord"))
    rank = rank.when(F.col("around") == 0, F.struct(F.lit(1).alias("a"), F.lit(0).alias("b"), F.lit(0).alias("c"), "ord")).otherwise(F.struct(F.lit(2).alias("a"), F.col("depth").alias("b"), F.lit(0).alias("c"), "ord"))
    known = own.join(places, ["path", "ord"]).filter(top_class | (F.col("kind") != "class") & (F.size("caps") > 0))
    return known.groupBy("path", "name").agg(F.min_by("caps", rank).alias("caps"))


def call_graph(found: DataFrame) -> DataFrame:
    """(caller, callee) over bare names: of several definitions of a name the last, by path and place, counts; calls inside of
    nested functions are calls of the function around them as well."""
    definitions = found.filter("fact = 'function'").select("path", "ord", F.col("name").alias("caller"), "depth")
    last = definitions.groupBy("caller").agg(F.max(F.struct("path", "depth", "ord")).alias("l")).select("caller", "l.path", "l.ord")
    bare = found.filter("fact = 'call' and instr(target, '.') = 0").select("path", F.explode("owners").alias("ord"), F.col("target").alias("callee"))
    return bare.join(last, ["path", "ord"]).select("caller", "callee").distinct()


def symbol_calls(found: DataFrame) -> DataFrame:
    """(path, handler, callee, line): every call, for each function around it."""
    functions = found.filter("fact = 'function'").select("path", F.col("ord").alias("owner"), F.col("name").alias("handler"))
    return found.filter("fact = 'call'").select("path", F.explode("owners").alias("owner"), F.col("target").alias("callee"), "line").join(functions, ["path", "owner"]).select("path", "handler", "callee", "line")


def server_usages(found: DataFrame) -> DataFrame:
    """(path, handler, server, line): servers that a function connects to by a literal name."""
    functions = found.filter("fact = 'function'").select("path", F.col("ord").alias("owner"), F.col("name").alias("handler"))
    return found.filter("fact = 'connects'").select("path", F.explode("owners").alias("owner"), F.col("name").alias("server"), "line").join(functions, ["path", "owner"]).select("path", "handler", "server", "line")


def entry_points(found: DataFrame) -> DataFrame:
    """(path, kind, handler, method, target, line, ord): routes, the first main guard of a file, one row per widget and file
    that imports the page framework."""
    none = F.lit(None).cast("string")
    routes = found.filter("fact = 'route'").select("path", F.lit("http").alias("kind"), F.col("name").alias("handler"), F.col("mode").alias("method"), "target", "line", "ord")
    mains = found.filter("fact = 'main'").groupBy("path").agg(F.min("line").alias("line"), F.min("ord").alias("ord")).select("path", F.lit("cli").alias("kind"), F.lit("<module>").alias("handler"), none.alias("method"), none.alias("target"), "line", "ord")
    pages = found.filter((F.col("fact") == "import") & (F.col("target") == PAGE_MODULE)).select("path").distinct()
    widgets = found.filter("fact = 'widget'").join(pages, "path", "left_semi").groupBy("path", "target").agg(F.min("line").alias("line"), F.min("ord").alias("ord")).select("path", F.lit("page").alias("kind"), F.lit("<module>").alias("handler"), none.alias("method"), "target", "line", "ord")
    return routes.unionByName(mains).unionByName(widgets)


def untrusted_reads(found: DataFrame) -> DataFrame:
    """(path, source_type, call_target, line, reader, container, ord): reads of untrusted text at module level, in top-level
    functions and in methods of top-level classes. The first shape of a call gives the type."""
    rules = shapes.rule_table(found.sparkSession)
    calls = found.filter("fact = 'call'").select("path", "ord", "target", "line", "owners")
    typed = shapes.first_source(shapes.evidence(calls.select("path", "ord", "target"), rules), "reads_untrusted", ["path", "ord"])
    top = found.filter("fact in ('class', 'function')").select("path", F.col("ord").alias("o"), "fact", F.col("name").alias("n"))
    outer, inner = top.select("path", F.col("o").alias("o1"), F.col("fact").alias("f1"), F.col("n").alias("n1")), top.select("path", F.col("o").alias("o2"), F.col("fact").alias("f2"), F.col("n").alias("n2"))
    placed = calls.join(typed, ["path", "ord"]).withColumn("o1", F.get("owners", F.lit(0))).withColumn("o2", F.get("owners", F.lit(1))).join(outer, ["path", "o1"], "left").join(inner, ["path", "o2"], "left")
    in_class = F.col("f1") == "class"
    counted = placed.filter(F.col("f1").isNull() | (F.col("f1") == "function") | (in_class & (F.col("f2") == "function")))
    reader = F.when(in_class, F.col("n2")).otherwise(F.col("n1"))
    return counted.select("path", "source_type", F.col("target").alias("call_target"), "line", reader.alias("reader"), F.when(in_class, F.col("n1")).alias("container"), "ord")


def store_sites(found: DataFrame) -> DataFrame:
    """(path, family, side, hint, line, target, ord) of the calls that write to or read from a store."""
    return found.filter("fact = 'site'").select("path", F.col("target").alias("family"), F.col("mode").alias("side"), F.col("text").alias("hint"), "line", F.col("name").alias("target"), "ord")


def sink_flows(found: DataFrame) -> DataFrame:
    """(path, kind, name, class_name, line, grade, evidence): what reaches the dangerous calls of functions and classes."""
    return found.filter("fact = 'sink_flow'").select("path", F.col("mode").alias("kind"), "name", "line", F.col("text").alias("grade"), F.col("items").alias("evidence"))


def call_flows(found: DataFrame) -> DataFrame:
    """(path, scope, callee, line, grade, flow_kind, evidence): the arguments of every call inside of a function."""
    kind = F.when(F.col("text").isin(*flow.DATA), "data").otherwise("control")
    return found.filter("fact = 'call_flow'").select("path", "scope", F.col("name").alias("callee"), "line", F.col("text").alias("grade"), kind.alias("flow_kind"), F.col("items").alias("evidence"))


def local_imports(found: DataFrame) -> DataFrame:
    """(path, imports): the files of the same sources that a file imports, relative imports resolved."""
    dotted_name = F.regexp_replace(F.regexp_replace(F.regexp_replace("path", r"\.py$", ""), "/", "."), r"\.__init__$", "")
    files = found.filter("fact = 'file'").select(dotted_name.alias("target"), F.col("path").alias("other")).groupBy("target").agg(F.min("other").alias("other"))
    named = found.filter("fact = 'imported'").select("path", "target").distinct()
    return named.join(files, "target").groupBy("path").agg(F.array_sort(F.collect_set("other")).alias("imports"))
