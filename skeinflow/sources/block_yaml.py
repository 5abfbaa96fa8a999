"""A reader of the plain part of YAML that policies and endpoint configurations use: block mappings and lists, quoted and plain
scalars, flow lists and mappings on one line, block texts and comments. Anchors, tags and several documents raise ValueError."""

from __future__ import annotations

import json
import re

_KEY = re.compile(r"""(?P<key>"(?:[^"\\]|\\.)*"|'(?:[^']|'')*'|[^\s#'"\[\]{},&*!|>%@`-][^#]*?|-[^\s:][^#]*?)\s*:(?:\s+|$)""")
_NUMBER = re.compile(r"[-+]?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][-+]?\d+)?$")
_PLAIN = {"": None, "~": None, "null": None, "true": True, "false": False, "True": True, "False": False, "yes": True, "no": False, "on": True, "off": False}


def scalar(text: str):
    """The value of a scalar or a flow collection on one line."""
    text = text.strip()
    if text[:1] in "[{" and text:
        value, rest = _flow(text)
        if rest.strip():
            raise ValueError(f"text behind a collection: {rest!r}")
        return value
    if text[:1] == '"':
        return json.loads(text)
    if text[:1] == "'":
        if not re.fullmatch(r"'(?:[^']|'')*'", text):
            raise ValueError(f"open quote: {text!r}")
        return text[1:-1].replace("''", "'")
    if text[:1] in tuple("&*!%@`"):
        raise ValueError(f"not supported: {text!r}")
    if text in _PLAIN:
        return _PLAIN[text]
    if _NUMBER.match(text):
        return float(text) if set(text) & set(".eE") else int(text)
    return text


def _flow(text: str):
    closing = {"[": "]", "{": "}"}[text[0]]
    items, rest = ([] if text[0] == "[" else {}), text[1:].lstrip()
    while rest[:1] != closing:
        if not rest:
            raise ValueError("open collection")
        if rest[0] in "[{":
            value, rest = _flow(rest)
        else:
            m = re.match(r"""\s*("(?:[^"\\]|\\.)*"|'(?:[^']|'')*'|[^,\[\]{}]*)""", rest)
            value, rest = m.group(1).strip(), rest[m.end() :]
            if closing == "}":
                key, colon, inner = value.partition(":")
                if not colon and rest[:1] == ":":
                    key, inner, rest = value, "", rest[1:].lstrip()
                if not inner.strip() and rest[:1] in "[{" and rest:
                    inner, rest = _flow(rest)
                else:
                    if not inner and value[:1] in "\"'":
                        m = re.match(r"[^,\[\]{}]*", rest)
                        inner, rest = m.group(), rest[m.end() :]
                    inner = scalar(inner)
                items[str(scalar(key))] = inner
                value = None
            else:
                value = scalar(value)
        if closing == "]":
            items.append(value)
        rest = rest.lstrip()
        if rest[:1] == ",":
            rest = rest[1:].lstrip()
        elif rest[:1] != closing:
            raise ValueError(f"expected , or {closing}: {rest[:20]!r}")
    return items, rest[1:]


def _bare(line: str) -> str:
    """The line without its comment."""
    out, quote = [], ""
    for i, c in enumerate(line):
        if quote:
            quote = "" if c == quote and not (quote == '"' and line[i - 1] == "\\") else quote
        elif c in "\"'" and (not out or out[-1] in " :[{,-"):
            quote = c
        elif c == "#" and (not out or out[-1] in " \t"):
            break
        out.append(c)
    return "".join(out).rstrip()


def load(text: str):
    """The value of a document; None for an empty one."""
    raw = text.lstrip("\ufeff").splitlines()
    lines: list[tuple[int, str, int]] = []
    for n, line in enumerate(raw):
        bare = _bare(line)
        if bare.strip() in ("---", "...") and not bare.startswith(" "):
            if lines and bare == "---":
                raise ValueError("several documents")
            continue
        if bare.strip():
            if bare.lstrip(" ").startswith("\t"):
                raise ValueError("tab in an indentation")
            lines.append((len(bare) - len(bare.lstrip(" ")), bare.strip(), n))
    if not lines:
        return None
    value, at = _block(lines, 0, lines[0][0], raw)
    if at < len(lines):
        raise ValueError(f"unexpected indentation in line {lines[at][2] + 1}")
    return value


def _block(lines, at: int, indent: int, raw):
    if lines[at][1].startswith("- ") or lines[at][1] == "-":
        items = []
        while at < len(lines) and lines[at][0] == indent and (lines[at][1].startswith("- ") or lines[at][1] == "-"):
            rest = lines[at][1][1:]
            inner = indent + 1 + len(rest) - len(rest.lstrip(" "))
            rest = rest.strip()
            if not rest:
                value, at = _nested(lines, at + 1, indent, raw)
            elif _KEY.match(rest):
                lines[at] = (inner, rest, lines[at][2])
                value, at = _block(lines, at, inner, raw)
            else:
                value, at = scalar(rest), at + 1
            items.append(value)
        return items, at
    found = {}
    if not _KEY.match(lines[at][1]):
        return scalar(lines[at][1]), at + 1
    while at < len(lines) and lines[at][0] == indent:
        m = _KEY.match(lines[at][1])
        if not m:
            raise ValueError(f"no key in line {lines[at][2] + 1}")
        key, rest = str(scalar(m.group("key"))), lines[at][1][m.end() :].strip()
        if rest[:1] in "|>" and rest:
            value, at = _text(lines, at, indent, rest, raw)
        elif rest:
            value, at = scalar(rest), at + 1
        else:
            value, at = _nested(lines, at + 1, indent, raw, True)
        found[key] = value
    return found, at


def _nested(lines, at: int, indent: int, raw, list_beside: bool = False):
    if at < len(lines) and (lines[at][0] > indent or list_beside and lines[at][0] == indent and lines[at][1].startswith("-")):
        return _block(lines, at, lines[at][0], raw)
    return None, at


def _text(lines, at: int, indent: int, mark: str, raw):
    start = lines[at][2] + 1
    end = start
    while end < len(raw) and (not raw[end].strip() or len(raw[end]) - len(raw[end].lstrip(" ")) > indent):
        end += 1
    body = raw[start:end]
    margin = min((len(x) - len(x.lstrip(" ")) for x in body if x.strip()), default=0)
    joined = [x[margin:] for x in body]
    while joined and not joined[-1].strip():
        joined.pop()
    value = ("\n" if mark[0] == "|" else " ").join(joined) + ("" if "-" in mark else "\n")
    at += 1
    while at < len(lines) and lines[at][2] < end:
        at += 1
    return value, at
