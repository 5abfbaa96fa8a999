"""YAML 1.2: block structure by indentation, flow collections and scalars by a local grammar."""

from __future__ import annotations

import re

from .base import Bad, TooDeep, depth

_DOUBLE = re.compile(r'"(?:[^"\\]|\\(?:[0abt\tnvfre "/\\N_LP\n\r]|x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}))*"')
_SINGLE = re.compile(r"'(?:[^']|'')*'")
_PROPERTY = re.compile(r"(?:!<[^>\s]*>|![^\s,\[\]{}]*|&[^\s,\[\]{}]+)(?=[\s,\[\]{}]|$)")
_ALIAS = re.compile(r"\*[^\s,\[\]{}]+")
_BLOCK_SCALAR = re.compile(r"[|>](?:[1-9][+-]?|[+-][1-9]?)?[ \t]*(?:#.*)?$")
_CONTROL = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]")
_FORBIDDEN = frozenset(",[]{}#&*!|>'\"%@`")


class Yaml:
    def __init__(self, text: str) -> None:
        if _CONTROL.search(text):
            raise Bad(_CONTROL.search(text).start(), "control character")
        self.lines = text.replace("\r\n", "\n").replace("\r", "\n").split("\n")
        self.i = 0

    def fail(self, why: str):
        raise Bad(self.i, f"line: {why}")

    def peek(self) -> tuple[int, str] | None:
        """Indent and text of the next line with content in this document; comments and blank lines are passed."""
        while self.i < len(self.lines):
            line = self.lines[self.i]
            text = line.lstrip(" ")
            bare = text.strip(" \t")
            if bare == "" or bare[0] == "#":
                self.i += 1
                continue
            if len(text) == len(line) and re.match(r"(---|\.\.\.)(\s|$)", line):
                return None
            if text[0] == "\t":
                self.fail("tab in the indentation")
            return len(line) - len(text), text
        return None

    def file(self) -> None:
        while True:
            while self.peek() is None and self.i < len(self.lines):
                line = self.lines[self.i]
                if line.startswith("..."):
                    if line[3:].strip() and not line[3:].strip().startswith("#"):
                        self.fail("text after the end")
                    self.i += 1
                    continue
                rest = line[3:]
                if rest.strip() and not rest.strip().startswith("#"):
                    self.lines[self.i] = "   " + rest
                    self.document()
                else:
                    self.i += 1
                    self.document()
            if self.i >= len(self.lines):
                return
            if self.lines[self.i].startswith("%"):
                while self.i < len(self.lines) and not self.lines[self.i].startswith("---"):
                    if self.lines[self.i].strip() and self.lines[self.i][0] not in "%#":
                        self.fail("a directive without a document")
                    self.i += 1
                continue
            self.document()

    def document(self) -> None:
        if self.peek() is not None:
            self.node(-1)
            if self.peek() is not None:
                self.fail("text outside the structure")

    def node(self, parent: int) -> None:
        """A block node whose lines are indented by more than ``parent``."""
        indent, text = self.peek()
        while m := _PROPERTY.match(text):
            rest = text[m.end() :].lstrip(" \t")
            if self.key_end(text) is not None:
                break
            if not rest or rest[0] == "#":
                self.i += 1
                following = self.peek()
                if following is None or following[0] <= parent and not (following[0] == parent and following[1].startswith("- ")):
                    return
                indent, text = following
                continue
            self.lines[self.i] = " " * (indent + len(text) - len(rest)) + rest
            text, indent = rest, indent + len(text) - len(rest)
        if text == "-" or text.startswith(("- ", "-\t")):
            self.sequence(indent)
        elif text == "?" or text.startswith("? ") or self.key_end(text) is not None:
            self.mapping(indent)
        else:
            self.inline(text, parent)

    def sequence(self, indent: int) -> None:
        while (at := self.peek()) and at[0] == indent and (at[1] == "-" or at[1].startswith(("- ", "-\t"))):
            self.entry(indent, 1, at[1])
        if at and at[0] > indent:
            self.fail("deeper than the sequence")

    def entry(self, indent: int, marker: int, text: str) -> None:
        """What follows a one-character marker."""
        rest = text[marker:].lstrip(" \t")
        if not rest or rest[0] == "#":
            self.i += 1
            following = self.peek()
            if following and following[0] > indent:
                self.node(indent)
            return
        if "\t" in text[marker : len(text) - len(rest)] and (self.key_end(rest) is not None or rest.startswith("- ")):
            self.fail("tab in the indentation")
        if _BLOCK_SCALAR.match(rest):
            self.i += 1
            self.block_scalar(indent)
            return
        self.lines[self.i] = " " * (indent + len(text) - len(rest)) + rest
        self.node(indent)

    def mapping(self, indent: int) -> None:
        while (at := self.peek()) and at[0] == indent:
            text = at[1]
            if text == "?" or text.startswith("? "):
                self.entry(indent, 1, text)
                at = self.peek()
                if at and at[0] == indent and (at[1] == ":" or at[1].startswith(": ")):
                    self.entry(indent, 1, at[1])
                continue
            if text == "-" or text.startswith("- "):
                self.fail("a sequence entry among keys")
            end = self.key_end(text)
            if end is None:
                self.fail("no key")
            self.value(indent, text[end:])
        if at and at[0] > indent:
            self.fail("deeper than the mapping")

    def value(self, indent: int, rest: str) -> None:
        """What follows the colon of a key on the current line."""
        rest = rest.strip(" \t")
        while m := _PROPERTY.match(rest):
            rest = rest[m.end() :].lstrip(" \t")
        if not rest or rest[0] == "#":
            self.i += 1
            following = self.peek()
            if following and (following[0] > indent or following[0] == indent and (following[1] == "-" or following[1].startswith("- "))):
                if following[0] == indent:
                    self.sequence(indent)
                else:
                    self.node(indent)
            return
        if _BLOCK_SCALAR.match(rest):
            self.i += 1
            self.block_scalar(indent)
            return
        if rest.startswith(("- ", "? ")) or rest == "-":
            self.fail("a block entry after a key")
        self.inline(rest, indent, key=True)

    def block_scalar(self, parent: int) -> None:
        own = None
        while self.i < len(self.lines):
            line = self.lines[self.i]
            text = line.lstrip(" ")
            indent = len(line) - len(text)
            if not text:
                self.i += 1
                continue
            if own is None:
                if indent <= parent:
                    return
                own = indent
            if indent < own:
                if indent > parent and not text.startswith("#"):
                    self.fail("less indented than the scalar")
                return
            self.i += 1

    def key_end(self, text: str) -> int | None:
        """Place after the colon if the line begins with an implicit key."""
        at = 0
        while m := _PROPERTY.match(text, at):
            at = m.end()
            while at < len(text) and text[at] in " \t":
                at += 1
        if at < len(text) and text[at] in "\"'":
            m = (_DOUBLE if text[at] == '"' else _SINGLE).match(text, at)
            if not m:
                return None
            return self.colon(text, m.end())
        if m := _ALIAS.match(text, at):
            return self.colon(text, m.end())
        if at < len(text) and text[at] in "[{":
            try:
                end = _Flow(text).collection(at)
            except Bad:
                return None
            return self.colon(text, end)
        if at < len(text) and text[at] in _FORBIDDEN:
            return None
        m = re.compile(r"(?:[^:#]|:(?=\S)|(?<=\S)#)*").match(text, at)
        end = m.end()
        if end < len(text) and text[end] == ":" and end >= at:
            return end + 1
        return None

    def colon(self, text: str, at: int) -> int | None:
        while at < len(text) and text[at] in " \t":
            at += 1
        if at < len(text) and text[at] == ":" and (at + 1 == len(text) or text[at + 1] in " \t"):
            return at + 1
        return None

    def inline(self, text: str, parent: int, key: bool = False) -> None:
        """A quoted, flow or plain scalar that begins on the current line and may go on over more indented lines."""
        first = text[0]
        if first in "\"'[{":
            start = self.i
            parts = [text]
            # Later lines belong to the node as far as it goes; they must be indented by more than the parent.
            after = [x for x in self.lines[start + 1 :]]
            joined = "\n".join([text, *after])
            if first in "\"'":
                m = (_DOUBLE if first == '"' else _SINGLE).match(joined)
                if not m:
                    self.fail("open quotation")
                end = m.end()
            else:
                end = _Flow(joined).collection(0)
            used = joined.count("\n", 0, end)
            for k in range(1, used + 1):
                line = self.lines[start + k]
                bare = line.lstrip(" ")
                if re.match(r"(---|\.\.\.)(\s|$)", line):
                    self.fail("document mark inside")
                if bare and len(line) - len(bare) <= parent and parent >= 0 and not (first in "[{" and bare[0] in "]}"):
                    self.fail("less indented inside")
            rest = joined[end:].split("\n", 1)[0]
            self.i = start + used
            if rest.strip(" \t") and not (rest.lstrip(" \t").startswith("#") and rest[0] in " \t"):
                self.fail("text after the node")
            del parts
            self.i += 1
            return
        if m := _ALIAS.match(text):
            if text[m.end() :].strip() and not text[m.end() :].strip().startswith("#"):
                self.fail("text after the alias")
            self.i += 1
            return
        self.plain_line(text, True)
        closed = bool(re.search(r"(^|\s)#", text))
        self.i += 1
        while True:
            before = self.i
            at = self.peek()
            if at is None or at[0] <= parent:
                return
            if any(line.lstrip(" \t").startswith("#") for line in self.lines[before : self.i]) or closed:
                self.fail("a scalar goes on after a comment")
            self.plain_line(at[1], False)
            closed = bool(re.search(r"\s#", at[1]))
            self.i += 1

    def plain_line(self, text: str, first: bool) -> None:
        if first and (text[0] in _FORBIDDEN or text[0] in "-?:" and (len(text) == 1 or text[1] in " \t")):
            self.fail("no scalar begins with this")
        bare = re.split(r"(?:^|[ \t])#", text, maxsplit=1)[0].rstrip(" \t")
        if bare.endswith(":") or re.search(r":[ \t]", bare):
            self.fail("a key inside a scalar")


class _Flow:
    def __init__(self, text: str) -> None:
        self.text = text
        self.depth = 0

    def space(self, at: int) -> int:
        text = self.text
        while at < len(text):
            if text[at] in " \t\n":
                at += 1
            elif text[at] == "#" and (at == 0 or text[at - 1] in " \t\n"):
                end = text.find("\n", at)
                at = len(text) if end < 0 else end
            else:
                break
        return at

    def collection(self, at: int) -> int:
        self.depth += 1
        if self.depth > depth.limit:
            raise TooDeep
        text = self.text
        close = "]" if text[at] == "[" else "}"
        at = self.space(at + 1)
        while True:
            if at >= len(text):
                raise Bad(at, "open collection")
            if text[at] == close:
                self.depth -= 1
                return at + 1
            if text[at] == ",":
                raise Bad(at, "no entry")
            if text[at] == "?" and text[at + 1 : at + 2] in (" ", "\n"):
                at = self.space(at + 1)
            at = self.space(self.entry(at))
            if at < len(text) and text[at] == ":":
                at = self.space(at + 1)
                if at < len(text) and text[at] not in ",]}":
                    at = self.space(self.entry(at))
            if at < len(text) and text[at] == ",":
                at = self.space(at + 1)
            elif at < len(text) and text[at] != close:
                raise Bad(at, "no comma")

    def entry(self, at: int) -> int:
        text = self.text
        while m := _PROPERTY.match(text, at):
            at = self.space(m.end())
            if at < len(text) and text[at] in ",]}":
                return at
        if at >= len(text):
            raise Bad(at, "end")
        if text[at] in "[{":
            return self.collection(at)
        if text[at] in "\"'":
            m = (_DOUBLE if text[at] == '"' else _SINGLE).match(text, at)
            if not m:
                raise Bad(at, "open quotation")
            return m.end()
        if m := _ALIAS.match(text, at):
            return m.end()
        if text[at] == ":":
            return at
        if text[at] in _FORBIDDEN or text[at] == "-" and text[at + 1 : at + 2] in (" ", "\n", ",", "]", "}", ""):
            raise Bad(at, "no scalar begins with this")
        while at < len(text) and text[at] not in ",[]{}":
            if text[at] == ":" and (at + 1 >= len(text) or text[at + 1] in " \t\n,[]{}"):
                break
            if text[at] == "#" and text[at - 1] in " \t\n":
                break
            at += 1
        return at


def check(text: str) -> None:
    Yaml(text).file()
