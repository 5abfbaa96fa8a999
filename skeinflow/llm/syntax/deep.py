"""Reading what nests too deeply for a plain pass: with room for many more levels, and, for the parsers of the standard
library, with chains that recurse folded or with a stack of one's own."""

from __future__ import annotations

import ast
import io
import re
import sys
import threading
import tokenize
import warnings

from .base import DEEPEST, Bad, depth

_FRAMES = 40  # frames a level may take
_JSON = re.compile(r'[ \t\r\n]*(?:([\[\]{},:])|("(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*")|(-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?|true|false|null)(?![\w.+-]))')
#: Operands of a chain that stay.
_KEPT = 40


def with_room(check) -> None:
    """Runs a check in a thread of its own in which rules may nest ``DEEPEST`` levels; raises what it raises."""
    raised: list[BaseException] = []

    def run() -> None:
        try:
            check()
        except BaseException as e:  # noqa: BLE001 - handed to the caller
            raised.append(e)

    recursion, size, limit = sys.getrecursionlimit(), threading.stack_size(), depth.limit
    try:
        sys.setrecursionlimit(DEEPEST * _FRAMES)
        threading.stack_size(512 * 1024 * 1024)
        depth.limit = DEEPEST
        thread = threading.Thread(target=run)
        thread.start()
        thread.join()
    finally:
        depth.limit = limit
        threading.stack_size(size)
        sys.setrecursionlimit(recursion)
    if raised:
        raise raised[0]


def check_json(text: str) -> None:
    """JSON by a stack of its own; any depth."""
    stack: list[str] = []
    expect = "value"
    at, end = 0, len(text.rstrip(" \t\r\n"))
    while at < end:
        m = _JSON.match(text, at)
        if m is None:
            raise Bad(at, "no token")
        mark, string, _ = m.groups()
        at = m.end()
        if expect in ("value", "first value") and mark not in (",", ":", "}") and not (mark == "]" and expect == "value"):
            if mark == "[":
                stack.append("[")
                expect = "first value"
            elif mark == "{":
                stack.append("{")
                expect = "first key"
            elif mark == "]":
                stack.pop()
                expect = "more"
            else:
                expect = "more"
        elif expect in ("key", "first key") and string:
            expect = "colon"
        elif expect == "first key" and mark == "}":
            stack.pop()
            expect = "more"
        elif expect == "colon" and mark == ":":
            expect = "value"
        elif expect == "more" and stack and mark == ",":
            expect = "value" if stack[-1] == "[" else "key"
        elif expect == "more" and stack and mark == ("]" if stack[-1] == "[" else "}"):
            stack.pop()
        else:
            raise Bad(at, "unexpected")
        if not stack and expect == "more" and at < end:
            raise Bad(at, "text behind the value")
    if stack or expect != "more":
        raise Bad(at, "unexpected end")


def fold_python(text: str) -> str:
    """A Python text whose chains that recurse in the parser (signs, operators between plain operands, attributes, branches)
    are cut to ``_KEPT`` links, which changes nothing about whether it is valid."""
    drop: list[tuple[tuple[int, int], tuple[int, int]]] = []
    change: list[tuple[tuple[int, int], tuple[int, int]]] = []
    signs = operands = dots = branches = 0
    last = None
    atom_before = False
    plain = (tokenize.NAME, tokenize.NUMBER, tokenize.STRING)
    words = frozenset("and or not in is if else for lambda await async return yield del assert import from as with while elif".split())
    operators = frozenset("+ - * / // % @ & | ^ << >>".split())
    for t in tokenize.generate_tokens(io.StringIO(text).readline):
        is_sign = t.string in ("+", "-", "~", "not") and not atom_before and t.type in (tokenize.OP, tokenize.NAME)
        signs = signs + 1 if is_sign else 0
        if signs > _KEPT:
            drop.append((t.start, t.end))
        atom = t.type in plain and t.string not in words
        if atom and last is not None and last.string in operators and atom_before is False and operands:
            operands += 1
            if operands > _KEPT:
                drop.append((last.start, t.end))
        elif atom and not (last is not None and last.string == "."):
            operands = 1
        elif t.string not in operators:
            operands = 0
        if last is not None and last.string == "." and t.type == tokenize.NAME:
            dots += 1
            if dots > _KEPT:
                drop.append((last.start, t.end))
        elif t.string != ".":
            dots = 0
        if t.type == tokenize.NAME and t.string == "elif":
            branches += 1
            if branches % _KEPT == 0:
                change.append((t.start, t.end))
        atom_before = atom or t.string in (")", "]", "}")
        if t.type not in (tokenize.NL, tokenize.COMMENT):
            last = t
    lines = text.splitlines(keepends=True)
    for (row, a), (to, b) in sorted(drop + change, reverse=True):
        new = "if" if ((row, a), (to, b)) in set(change) else ""
        if row == to:
            lines[row - 1] = lines[row - 1][:a] + new + lines[row - 1][b:]
        else:  # over lines: the text between stays blank, so lines keep their places
            lines[row - 1] = lines[row - 1][:a] + "\n"
            lines[to - 1] = " " * b + lines[to - 1][b:]
    return "".join(lines)


def check_python(content: bytes) -> None:
    """Python whose syntax tree is too deep for the standard parser: folded, then read again. What is then still too deep has
    been divided into tokens, brackets and indentation without a fault, and is taken for valid."""
    encoding, _ = tokenize.detect_encoding(io.BytesIO(content).readline)
    try:
        folded = fold_python(content.decode(encoding))
    except tokenize.TokenError as e:
        raise SyntaxError(str(e)) from None
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            ast.parse(folded)
    except (RecursionError, MemoryError):
        return
