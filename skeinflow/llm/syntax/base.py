"""What the grammars share."""

from __future__ import annotations

import re


class TooDeep(Exception):
    """The text nests deeper than ``depth.limit``."""


class _Depth:
    """How deep rules may nest before a grammar gives up; what gives up is read again with room for ``DEEPEST`` levels."""

    limit = 120


DEEPEST = 50_000
depth = _Depth()


class Bad(Exception):
    """The text is not valid; the place is a character offset."""

    def __init__(self, place: int, why: str = "") -> None:
        super().__init__(f"{why} at {place}")
        self.place = place


def tokenize(pattern: re.Pattern, text: str, skip: frozenset[str]) -> list[tuple[str, str, int]]:
    """(kind, text, place) of all tokens but the skipped kinds; what no group matches is an error."""
    out, at = [], 0
    match = pattern.match
    while at < len(text):
        m = match(text, at)
        if not m or m.end() == at:
            raise Bad(at, "no token")
        kind = m.lastgroup
        if kind not in skip:
            out.append((kind, m.group(), at))
        at = m.end()
    return out


class Stream:
    """Tokens with one place; ``""`` is the kind and text of the end."""

    def __init__(self, tokens: list[tuple[str, str, int]]) -> None:
        end = tokens[-1][2] + 1 if tokens else 0
        self.tokens = [*tokens, ("", "", end)]
        self.i = 0
        self.kind, self.text, self.place = self.tokens[0]
        self.depth = 0

    def go(self, i: int) -> None:
        self.i = i
        self.kind, self.text, self.place = self.tokens[i]

    def next(self) -> str:
        text = self.text
        if self.kind:
            self.go(self.i + 1)
        return text

    def ahead(self, n: int = 1) -> tuple[str, str]:
        return self.tokens[min(self.i + n, len(self.tokens) - 1)][:2]

    def fail(self, why: str = "unexpected"):
        raise Bad(self.place, f"{why} {self.text!r}")

    def eat(self, text: str) -> bool:
        if self.text == text and self.kind not in ("str", ""):
            self.next()
            return True
        return False

    def need(self, text: str) -> None:
        if not self.eat(text):
            self.fail(f"expected {text!r}, not")

    def attempt(self, rule):
        """The rule's result, or None with the place restored where it fails."""
        at = self.i
        try:
            return rule() or True
        except Bad:
            self.go(at)
            return None
