"""Places in a file where code writes to or reads from a store, and handlers that take uploads.

Families of stores are a registry, so others can be added; each yields ``Site`` rows of one syntax tree. The literal beginning
of what names the place (a path, a table, a bucket and key) is its hint; two sites with hints of one beginning may be one
place.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Callable, Iterator
from typing import NamedTuple

from .flow import Function, dotted


class Site(NamedTuple):
    family: str
    side: str
    hint: str | None
    line: int
    column: int
    target: str | None = None


def first_literal(node: ast.AST | None) -> str | None:
    """The text an expression begins with: a literal, what stands left of a sum or a path join, the head of a formatted text."""
    while isinstance(node, ast.BinOp):
        node = node.left
    if isinstance(node, ast.JoinedStr):
        node = node.values[0] if node.values else None
    return node.value if isinstance(node, ast.Constant) and isinstance(node.value, str) else None


def argument(call: ast.Call, at: int | None, *keywords: str, keyword_first: bool = False) -> ast.AST | None:
    by_name = next((k.value for name in keywords for k in call.keywords if k.arg == name), None)
    by_place = call.args[at] if at is not None and len(call.args) > at else None
    first, second = (by_name, by_place) if keyword_first else (by_place, by_name)
    return first if first is not None else second


def mode_sides(mode: ast.AST | None) -> list[str]:
    """The sides of an open call: no mode reads, a mode that is no literal says nothing, ``+`` of a reading mode is both."""
    if mode is None:
        return ["read"]
    if not (isinstance(mode, ast.Constant) and isinstance(mode.value, str)):
        return []
    letters = set(mode.value)
    return ["write"] * bool(letters & set("wax+")) + ["read"] * (not letters & set("wax"))


# File calls and the sides of path methods.
OPEN_CALLS = ("open", "builtins.open")
PATHS = ("Path", "pathlib.Path")
PATH_METHODS = {"write_text": "write", "write_bytes": "write", "read_text": "read", "read_bytes": "read"}


def files(tree: ast.Module) -> Iterator[Site]:
    """Files that are opened, or read and written through path objects."""
    for call in _calls(tree):
        name = dotted(call.func) or ""
        if name in OPEN_CALLS or name.startswith("aiofiles.") and name.endswith(".open"):
            yield from _sites("fs", mode_sides(argument(call, 1, "mode")), first_literal(argument(call, 0, "file")), call)
        elif isinstance(call.func, ast.Attribute):
            base = call.func.value
            while isinstance(base, ast.BinOp):
                base = base.left
            if isinstance(base, ast.Call) and dotted(base.func) in PATHS and (path := argument(base, 0, "file")) is not None:
                method = call.func.attr
                sides = [PATH_METHODS[method]] if method in PATH_METHODS else mode_sides(argument(call, 0, "mode")) if method == "open" else []
                yield from _sites("fs", sides, first_literal(path), call)


# What statements are run on, and the words that they begin with.
RECEIVERS = ("cursor", "cur", "conn", "connection", "db", "session", "engine")
STATEMENTS = {"INSERT": "write", "UPDATE": "write", "DELETE": "write", "REPLACE": "write", "MERGE": "write", "SELECT": "read", "PRAGMA": "read", "EXPLAIN": "read", "WITH": "read"}
_NAMED = r"""\s+(?:"(\w+)"|`(\w+)`|(\w+))"""
TABLE_OF = {"write": re.compile(r"\b(?:INTO|UPDATE|FROM)" + _NAMED, re.I), "read": re.compile(r"\bFROM" + _NAMED, re.I)}


def statement(text: str) -> tuple[str | None, str | None]:
    """(side, table) of a statement, by its first word and the first name where its side has the table."""
    word = re.match(r"\s*([A-Za-z_]+)", text)
    side = STATEMENTS.get(word.group(1).upper()) if word else None
    table = TABLE_OF[side].search(text) if side else None
    return side, next((g for g in table.groups() if g), None) if table else None


def databases(tree: ast.Module) -> Iterator[Site]:
    """Statements run on a cursor, connection or session; many rows at once are only written."""
    for call in _calls(tree):
        if isinstance(call.func, ast.Attribute) and call.func.attr in ("execute", "executemany") and (_tail(call.func.value) or "").lstrip("_") in RECEIVERS:
            text = first_literal(argument(call, 0, "sql", "statement"))
            side, table = statement(text) if text is not None else (None, None)
            if side and (side == "write" or call.func.attr == "execute"):
                yield from _sites("db", [side], table, call)


# Object store calls with their side and the places of bucket and key (None: by name only), their usual
# receivers, and what constructs a client.
OBJECT_CALLS = {"put_object": ("write", None, None), "upload_file": ("write", 1, 2), "upload_fileobj": ("write", 1, 2), "get_object": ("read", None, None), "download_file": ("read", 0, 1), "download_fileobj": ("read", 0, 1)}
OBJECT_RECEIVERS = ("s3", "s3_client", "client", "s3_resource", "resource")
CLIENTS = {"boto3.client": "boto3", "boto3.resource": "boto3", "s3fs.S3FileSystem": "s3fs", "Minio": "minio"}


def objects(tree: ast.Module) -> Iterator[Site]:
    """Objects in buckets, through clients by their usual names or by what the file assigns them from."""
    clients = _clients(tree)
    for call, scope in _scoped(tree, None):
        if not (isinstance(call, ast.Call) and isinstance(call.func, ast.Attribute)):
            continue
        method, on = call.func.attr, call.func.value
        made = {clients.get((s, on.id)) for s in {None, scope}} if isinstance(on, ast.Name) else set()
        if method == "open" and "s3fs" in made:
            path = first_literal(argument(call, 0, "path", keyword_first=True))
            if path and path.startswith("s3://"):
                yield from _sites("s3", mode_sides(argument(call, 1, "mode", keyword_first=True)), path.removeprefix("s3://"), call)
        elif method in ("put_object", "get_object") and "minio" in made:
            if not {"Bucket", "Key"} & {k.arg for k in call.keywords}:
                yield from _sites("s3", [OBJECT_CALLS[method][0]], _object(argument(call, 0, "bucket", keyword_first=True), argument(call, 1, "key", keyword_first=True)), call)
        elif method in OBJECT_CALLS and ("boto3" in made or _tail(on) in OBJECT_RECEIVERS):
            side, bucket, key = OBJECT_CALLS[method]
            if bucket is not None or not call.args:
                yield from _sites("s3", [side], _object(argument(call, bucket, "Bucket", keyword_first=True), argument(call, key, "Key", keyword_first=True)), call)


def _object(bucket: ast.AST | None, key: ast.AST | None) -> str | None:
    name = first_literal(bucket)
    return None if name is None else f"{name}/{first_literal(key) or ''}"


def _clients(tree: ast.Module) -> dict[tuple[ast.AST | None, str], str | None]:
    """What client each name of a function (None: of the module) holds after its last assignment."""
    out: dict[tuple[ast.AST | None, str], str | None] = {}
    for node, scope in _scoped(tree, None):
        if isinstance(node, (ast.Assign, ast.AnnAssign)):
            made = dotted(node.value.func) if isinstance(node.value, ast.Call) else None
            kind = next((c for tail, c in CLIENTS.items() if made and (made == tail or made.endswith("." + tail))), None)
            for t in node.targets if isinstance(node, ast.Assign) else [node.target]:
                if isinstance(t, ast.Name):
                    out[scope, t.id] = kind
    return out


def _scoped(node: ast.AST, scope: ast.AST | None) -> Iterator[tuple[ast.AST, ast.AST | None]]:
    yield node, scope
    for child in ast.iter_child_nodes(node):
        yield from _scoped(child, child if isinstance(child, Function) else scope)


def _calls(tree: ast.AST) -> Iterator[ast.Call]:
    return (n for n in ast.walk(tree) if isinstance(n, ast.Call))


def _tail(node: ast.AST) -> str | None:
    return node.id if isinstance(node, ast.Name) else node.attr if isinstance(node, ast.Attribute) else None


def _sites(family: str, sides: list[str], hint: str | None, call: ast.Call) -> Iterator[Site]:
    target = dotted(call.func) or (call.func.attr if isinstance(call.func, ast.Attribute) else None)
    return (Site(family, side, hint, call.lineno, call.col_offset, target) for side in sides)


FAMILIES: dict[str, Callable[[ast.Module], Iterator[Site]]] = {}


def register(name: str, family: Callable[[ast.Module], Iterator[Site]]) -> None:
    """Adds a family of stores; a name stands for one family only."""
    if FAMILIES.get(name, family) is not family:
        raise ValueError(f"store family {name!r} is registered already")
    FAMILIES[name] = family


for _name, _family in (("fs", files), ("db", databases), ("s3", objects)):
    register(_name, _family)


def store_sites(tree: ast.Module) -> list[Site]:
    """Sites of all families, in the order of the text; a family that fails on the file yields nothing for it."""
    out: list[Site] = []
    for family in FAMILIES.values():
        try:
            out += list(family(tree))
        except Exception:  # noqa: BLE001 - one family must not cost the others the file
            continue
    return sorted(out, key=lambda s: (s.line, s.column, s.family, s.side))


# Annotations and defaults of upload parameters, and the containers they may stand in.
UPLOAD_TYPE, CONTAINERS = "UploadFile", ("list", "List", "Optional", "Union", "Annotated", "Sequence", "Iterable")


def _is_upload(annotation: ast.AST | None) -> bool:
    match annotation:
        case ast.Subscript():
            inner = annotation.slice.elts if isinstance(annotation.slice, ast.Tuple) else [annotation.slice]
            return (dotted(annotation.value) or "").rpartition(".")[2] in CONTAINERS and any(map(_is_upload, inner))
        case ast.BinOp():
            return _is_upload(annotation.left) or _is_upload(annotation.right)
    return annotation is not None and (dotted(annotation) or "").rpartition(".")[2] == UPLOAD_TYPE


def upload_frameworks(function: Function, routed: bool) -> list[str]:
    """The frameworks by whose means a routed handler takes files: typed parameters, ``request.files``, ``request.FILES``."""
    if not routed:
        return []
    out = []
    a = function.args
    every = [*a.posonlyargs, *a.args]
    defaults = dict(zip([x.arg for x in every][::-1], a.defaults[::-1])) | {x.arg: d for x, d in zip(a.kwonlyargs, a.kw_defaults) if d is not None}
    for x in [*every, *a.kwonlyargs]:
        made = (dotted(defaults[x.arg].func) or "").rpartition(".")[2] if isinstance(defaults.get(x.arg), ast.Call) else ""
        typed = (dotted(x.annotation) or "") if x.annotation is not None else None
        if made != "Form" and (_is_upload(x.annotation) or made == "File" and typed in (None, "bytes")):
            out.append("fastapi")
            break
    for framework, attribute in (("flask", "files"), ("django", "FILES")):
        if framework == "django" and "request" not in [x.arg for x in every]:
            continue
        for node in ast.walk(function):
            held = node.value if isinstance(node, ast.Subscript) else node.func.value if isinstance(node, ast.Call) and isinstance(node.func, ast.Attribute) and node.func.attr in ("get", "getlist") else None
            if held is not None and dotted(held) == f"request.{attribute}":
                out.append(framework)
                break
    return out
