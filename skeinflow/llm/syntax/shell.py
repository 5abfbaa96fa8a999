"""Bash: lists, pipelines and compound commands by a local grammar; words are read character by character."""

from __future__ import annotations

import re

from .base import Bad, TooDeep, depth

_RESERVED = frozenset("if then elif else fi for while until do done case esac select function time { } ! [[ in coproc".split())
_ENDS = frozenset("then elif else fi do done esac }".split())
_OPERATOR = re.compile(r"&&|\|\||\|&|;;&|;&|;;|&>>|&>|<<<|<<-|<<|>>|<&|>&|<>|>\||[|&;()<>]")
_REDIRECT = frozenset("< > >> << <<- <<< <& >& <> >| &> &>>".split())
_NAME = re.compile(r"[A-Za-z_]\w*")
_ASSIGNMENT = re.compile(r"[A-Za-z_]\w*(?:\[[^\]]*\])?\+?=")


class Shell:
    def __init__(self, text: str) -> None:
        self.s = text
        self.at = 0
        self.waiting: list[tuple[str, bool]] = []
        self.depth = 0
        self.kind = ""  # word, op, line or "" at the end
        self.text = ""
        self.plain = False  # a word without any quotation or expansion
        self.start = 0
        self.next()

    def fail(self, why: str = "unexpected"):
        raise Bad(self.start, f"{why} {self.text!r}")

    # tokens
    def next(self) -> None:
        s = self.s
        while self.at < len(s):
            if s[self.at] in " \t\r" and not s.startswith("\r\n", self.at):
                self.at += 1
            elif s.startswith("\\\n", self.at):
                self.at += 2
            elif s[self.at] == "#":
                end = s.find("\n", self.at)
                self.at = len(s) if end < 0 else end
            else:
                break
        self.start = self.at
        if self.at >= len(s):
            self.kind = self.text = ""
            if self.waiting:
                self.waiting = []  # bash warns about a here-document without its end, and takes it
            return
        if s[self.at] == "\n" or s.startswith("\r\n", self.at):
            self.at = s.index("\n", self.at) + 1
            self.kind, self.text = "line", "\n"
            for mark, tabs in self.waiting:
                self.here(mark, tabs)
            self.waiting = []
            return
        if s[self.at] in "<>" and s.startswith("(", self.at + 1):
            self.word()
            return
        m = _OPERATOR.match(s, self.at)
        if m:
            self.kind, self.text, self.at = "op", m.group(), m.end()
            return
        self.word()

    def here(self, mark: str, tabs: bool) -> None:
        s = self.s
        while self.at < len(s):
            end = s.find("\n", self.at)
            line = s[self.at : len(s) if end < 0 else end]
            self.at = len(s) if end < 0 else end + 1
            if (line.lstrip("\t") if tabs else line).rstrip("\r") == mark:
                return

    def word(self) -> None:
        start = self.at
        self.plain = True
        s = self.s
        while self.at < len(s):
            c = s[self.at]
            if c in " \t\r\n;&|()" or c in "<>" and not (s.startswith("(", self.at + 1)):
                if c == "(" and self.at > start and s[self.at - 1] in "?*+@!":
                    self.at += 1
                    self.nested(")")
                    continue
                if c == "(" and _ASSIGNMENT.fullmatch(s, start, self.at):
                    self.at += 1
                    self.array()
                    continue
                break
            self.piece()
        if self.at == start:
            self.fail("no word")
        self.kind, self.text = "word", s[start : self.at]
        self.start = start

    def piece(self) -> None:
        s, c = self.s, self.s[self.at]
        if c == "\\":
            self.plain = False
            self.at += 2
        elif c == "'":
            self.plain = False
            end = s.find("'", self.at + 1)
            if end < 0:
                raise Bad(self.at, "open quotation")
            self.at = end + 1
        elif c == '"':
            self.plain = False
            self.double()
        elif c == "`":
            self.plain = False
            self.back()
        elif c == "$":
            self.dollar()
        elif c in "<>":
            self.plain = False
            self.at += 2
            self.command_in()
        else:
            self.at += 1

    def double(self) -> None:
        s = self.s
        start = self.at
        self.at += 1
        while self.at < len(s):
            c = s[self.at]
            if c == '"':
                self.at += 1
                return
            if c == "\\":
                self.at += 2
            elif c == "`":
                self.back()
            elif c == "$":
                self.dollar(True)
            else:
                self.at += 1
        raise Bad(start, "open quotation")

    def back(self) -> None:
        s, start = self.s, self.at
        self.at += 1
        while self.at < len(s):
            if s[self.at] == "\\":
                self.at += 2
            elif s[self.at] == "`":
                check(s[start + 1 : self.at].replace("\\`", "`"))
                self.at += 1
                return
            else:
                self.at += 1
        raise Bad(start, "open quotation")

    def dollar(self, quoted: bool = False) -> None:
        s = self.s
        self.plain = False
        if s.startswith("$((", self.at):
            at = self.at
            self.at += 3
            try:
                self.arithmetic()
                return
            except Bad:
                self.at = at
        if s.startswith("$(", self.at):
            self.at += 2
            self.command_in()
        elif s.startswith("${", self.at):
            start = self.at
            self.at += 2
            if s.startswith("}", self.at):
                raise Bad(start, "no name")
            while self.at < len(s) and s[self.at] != "}":
                if s[self.at] == "'" and quoted:
                    self.at += 1
                else:
                    self.piece()
            if self.at >= len(s):
                raise Bad(start, "open expansion")
            self.at += 1
        elif s.startswith("$'", self.at) and not quoted:
            m = re.compile(r"\$'(?:[^'\\]|\\.)*'", re.S).match(s, self.at)
            if not m:
                raise Bad(self.at, "open quotation")
            self.at = m.end()
        elif s.startswith('$"', self.at) and not quoted:
            self.at += 1
            self.double()
        else:
            self.at += 1

    def command_in(self) -> None:
        """Commands up to the closing parenthesis; the opening one is read."""
        self.depth += 1
        if self.depth > depth.limit:
            raise TooDeep
        saved = (self.kind, self.text, self.plain, self.start, self.waiting)
        self.waiting = []
        self.next()
        self.lines()
        if not (self.kind == "op" and self.text == ")"):
            self.list_()
        if not (self.kind == "op" and self.text == ")"):
            self.fail("expected ')', not")
        self.kind, self.text, self.plain, self.start, self.waiting = saved
        self.plain = False
        self.depth -= 1

    def arithmetic(self) -> None:
        """Up to the closing double parenthesis; the opening one is read."""
        s, start, depth = self.s, self.at, 0
        while self.at < len(s):
            c = s[self.at]
            if c == "(":
                depth += 1
                self.at += 1
            elif c == ")":
                if not depth:
                    if not s.startswith("))", self.at):
                        raise Bad(start, "open arithmetic")
                    self.at += 2
                    return
                depth -= 1
                self.at += 1
            elif c in "\"'`$\\":
                self.piece()
            else:
                self.at += 1
        raise Bad(start, "open arithmetic")

    def nested(self, close: str) -> None:
        s, start = self.s, self.at
        self.plain = False
        depth = 0
        while self.at < len(s):
            if s[self.at] == close and not depth:
                self.at += 1
                return
            if s[self.at] == "(":
                depth += 1
                self.at += 1
            elif s[self.at] == ")":
                depth -= 1
                self.at += 1
            else:
                self.piece()
        raise Bad(start, "open group")

    def array(self) -> None:
        saved = (self.kind, self.text, self.start)
        while True:
            self.next()
            if self.kind == "op" and self.text == ")":
                break
            if self.kind not in ("word", "line"):
                self.fail()
        self.kind, self.text, self.start = saved
        self.plain = False

    # grammar
    def is_(self, word: str) -> bool:
        return self.kind == "word" and self.plain and self.text == word

    def op(self, text: str) -> bool:
        return self.kind == "op" and self.text == text

    def need(self, word: str) -> None:
        if not self.is_(word):
            self.fail(f"expected {word!r}, not")
        self.next()

    def lines(self) -> None:
        while self.kind == "line":
            self.next()

    def file(self) -> None:
        self.lines()
        if self.kind:
            self.list_()
        if self.kind:
            self.fail()

    def stops(self) -> bool:
        return not self.kind or self.kind == "op" and self.text in (")", ";;", ";&", ";;&") or self.kind == "word" and self.plain and self.text in _ENDS

    def list_(self) -> None:
        """At least one command."""
        while True:
            self.and_or()
            if self.op(";") or self.op("&"):
                self.next()
                self.lines()
            elif self.kind == "line":
                self.lines()
            else:
                return
            if self.stops():
                return

    def body(self, *closers: str) -> None:
        self.lines()
        self.list_()
        if not (self.kind == "word" and self.plain and self.text in closers):
            self.fail("expected an end, not")

    def and_or(self) -> None:
        self.pipeline()
        while self.op("&&") or self.op("||"):
            self.next()
            self.lines()
            self.pipeline()

    def pipeline(self) -> None:
        while self.is_("!") or self.is_("time"):
            timed = self.is_("time")
            self.next()
            if timed and self.is_("-p"):
                self.next()
        self.command()
        while self.op("|") or self.op("|&"):
            self.next()
            self.lines()
            self.command()

    def redirections(self) -> bool:
        found = False
        while True:
            at = (self.at, self.kind, self.text, self.plain, self.start)
            if self.kind == "word" and re.fullmatch(r"\d+|\{\w+\}", self.text) and self.s[self.at : self.at + 1] in ("<", ">") and self.at == self.start + len(self.text):
                self.next()
            if not (self.kind == "op" and self.text in _REDIRECT):
                self.at, self.kind, self.text, self.plain, self.start = at
                return found
            found = True
            operator = self.text
            self.next()
            if self.kind != "word":
                self.fail("no target:")
            if operator in ("<<", "<<-"):
                self.waiting.append((re.sub(r"[\\'\"]", "", self.text), operator == "<<-"))
            self.next()

    def command(self) -> None:
        self.depth += 1
        if self.depth > depth.limit:
            raise TooDeep
        self._command()
        self.depth -= 1

    def _command(self) -> None:
        t = self.text if self.kind == "op" or self.kind == "word" and self.plain else ""
        if t == "(" and self.kind == "op":
            if self.s.startswith("(", self.at):
                at = self.at
                self.at += 1
                try:
                    self.arithmetic()
                    self.next()
                    self.redirections()
                    return
                except Bad:
                    self.at = at
            self.next()
            self.lines()
            self.list_()
            if not self.op(")"):
                self.fail("expected ')', not")
            self.next()
        elif t == "{":
            self.next()
            self.body("}")
            self.next()
        elif t == "if":
            self.next()
            self.body("then")
            self.next()
            self.body("elif", "else", "fi")
            while self.is_("elif"):
                self.next()
                self.body("then")
                self.next()
                self.body("elif", "else", "fi")
            if self.is_("else"):
                self.next()
                self.body("fi")
            self.need("fi")
        elif t in ("while", "until"):
            self.next()
            self.body("do")
            self.do()
        elif t in ("for", "select"):
            self.next()
            if self.op("(") and self.s.startswith("(", self.at):
                self.at += 1
                self.arithmetic()
                self.next()
            else:
                if self.kind != "word":
                    self.fail("no variable:")
                self.next()
                self.lines()
                if self.is_("in"):
                    self.next()
                    while self.kind == "word":
                        self.next()
            if self.op(";"):
                self.next()
            elif self.kind != "line" and not self.is_("do") and not self.is_("{"):
                self.fail()
            self.lines()
            if self.is_("{"):
                self.next()
                self.body("}")
                self.next()
            else:
                self.do()
        elif t == "case":
            self.case()
        elif t == "function":
            self.next()
            if self.kind != "word":
                self.fail("no name:")
            self.next()
            if self.op("("):
                self.next()
                if not self.op(")"):
                    self.fail()
                self.next()
            self.lines()
            self.compound()
        elif t == "coproc":
            self.next()
            self.command()
            return
        elif t == "[[":
            self.test()
        elif self.kind == "word" and self.plain and self.text in _ENDS or self.kind != "word" and not (self.kind == "op" and self.text in _REDIRECT):
            self.fail("no command:")
        else:
            self.simple()
            return
        self.redirections()

    def compound(self) -> None:
        if not (self.op("(") or self.kind == "word" and self.plain and self.text in ("{", "if", "while", "until", "for", "case", "select", "[[")):
            self.fail("no body:")
        self.command()

    def do(self) -> None:
        self.need("do")
        self.body("done")
        self.next()

    def case(self) -> None:
        self.next()
        if self.kind != "word":
            self.fail()
        self.next()
        self.lines()
        self.need("in")
        self.lines()
        while not self.is_("esac"):
            if self.op("("):
                self.next()
            while True:
                if self.kind != "word":
                    self.fail("no pattern:")
                self.next()
                if not self.op("|"):
                    break
                self.next()
            if not self.op(")"):
                self.fail("expected ')', not")
            self.next()
            self.lines()
            if not (self.op(";;") or self.op(";&") or self.op(";;&") or self.is_("esac")):
                self.list_()
            if self.kind == "op" and self.text in (";;", ";&", ";;&"):
                self.next()
                self.lines()
            elif not self.is_("esac"):
                self.fail("expected ';;', not")
        self.next()

    def test(self) -> None:
        """``[[ ... ]]``: balanced, and with something inside."""
        self.next()
        parts = depth = 0
        while not (self.is_("]]") and not depth):
            if not self.kind:
                self.fail("open test")
            if self.op("("):
                depth += 1
            elif self.op(")"):
                depth -= 1
                if depth < 0:
                    self.fail()
            elif self.kind == "op" and self.text in (";", "&"):
                self.fail()
            elif self.kind == "word" and self.text == "=~":
                # The pattern of a match may have bare parentheses.
                m = re.compile(r"[ \t]+(?:\\.|\[[^\]]*\]|\"[^\"]*\"|'[^']*'|\$\{[^}]*\}|\([^\n]*?\)(?=\S*\s)|[^\s\\\[\"'])+").match(self.s, self.at)
                if m:
                    self.at = m.end()
            parts += 1
            self.next()
        if not parts:
            self.fail("empty test")
        self.next()

    def simple(self) -> None:
        words = 0
        if self.kind == "word" and self.s[self.at :].lstrip(" \t").startswith("("):
            name = self.text
            at = (self.at, self.kind, self.text, self.plain, self.start)
            self.next()
            if self.op("("):
                self.next()
                if self.op(")") and not _ASSIGNMENT.match(name):
                    self.next()
                    self.lines()
                    self.compound()
                    return
                self.fail()
            self.at, self.kind, self.text, self.plain, self.start = at
        while True:
            if self.redirections():
                words += 1
                continue
            if self.kind != "word":
                break
            words += 1
            self.next()
        if not words or self.op("("):
            self.fail("no command:")


def check(text: str) -> None:
    Shell(text).file()
