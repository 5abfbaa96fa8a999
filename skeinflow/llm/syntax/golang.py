"""Go: declarations and statements by a local grammar over tokens with automatic semicolons."""

from __future__ import annotations

import re

from .base import Bad, Stream, TooDeep, depth

KEYWORDS = frozenset("break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var".split())
_TOKEN = re.compile(
    r"""(?P<space>[ \t\r]+)|(?P<line>\n)|(?P<comment>//[^\n]*|/\*.*?\*/)
    |(?P<str>"(?:[^"\\\n]|\\.)*"|`[^`]*`)|(?P<rune>'(?:[^'\\\n]|\\(?:[abfnrtv\\'"]|x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}|[0-7]{3}))')
    |(?P<num>(?:0[xX][0-9a-fA-F_]+(?:\.[0-9a-fA-F_]*)?(?:[pP][+-]?\d+)?|0[bB][01_]+|0[oO]?[0-7_]+(?![\d.eE])|\d[\d_]*(?:\.[\d_]*)?(?:[eE][+-]?\d+)?|\.\d[\d_]*(?:[eE][+-]?\d+)?)i?(?![\w.]))
    |(?P<id>[^\W\d]\w*)
    |(?P<op><<=|>>=|&\^=|\.\.\.|&&|\|\||<-|\+\+|--|==|!=|<=|>=|:=|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>|&\^|[-+*/%&|^<>=!()\[\]{},;.:~])""",
    re.X | re.S,
)
_BINARY = {"||": 1, "&&": 2, "==": 3, "!=": 3, "<": 3, "<=": 3, ">": 3, ">=": 3, "+": 4, "-": 4, "|": 4, "^": 4, "*": 5, "/": 5, "%": 5, "<<": 5, ">>": 5, "&": 5, "&^": 5}
_ASSIGN = frozenset("= := += -= *= /= %= &= |= ^= <<= >>= &^=".split())
_ENDS = frozenset(["break", "continue", "fallthrough", "return", "++", "--", ")", "]", "}"])


def _tokens(text: str) -> list[tuple[str, str, int]]:
    out: list[tuple[str, str, int]] = []
    at = 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise Bad(at, "no token")
        kind, value = m.lastgroup, m.group()
        if kind == "line" or kind == "comment" and "\n" in value:
            if out and (out[-1][0] in ("id", "num", "rune", "str") and out[-1][1] not in KEYWORDS or out[-1][1] in _ENDS and out[-1][0] != "str"):
                out.append(("op", ";", at))
        elif kind not in ("space", "comment"):
            out.append((kind, value, at))
        at = m.end()
    if out and out[-1][1] != ";":
        out.append(("op", ";", at))
    return out


class Go(Stream):
    def __init__(self, text: str) -> None:
        super().__init__(_tokens(text))
        self.literals = True  # whether a composite literal may follow a type name here

    def name(self) -> None:
        if self.kind != "id" or self.text in KEYWORDS:
            self.fail("expected a name, not")
        self.next()

    def end(self, *closers: str) -> None:
        if self.text not in closers or self.kind == "str":
            self.need(";")

    # declarations
    def file(self) -> None:
        self.need("package")
        self.name()
        self.need(";")
        while self.eat("import"):
            self.group(self.import_spec)
        while self.kind:
            if not self.declaration() and not self.function():
                self.fail()

    def import_spec(self) -> None:
        if self.text == "." or self.kind == "id":
            self.next()
        if self.kind != "str":
            self.fail()
        self.next()

    def group(self, rule) -> None:
        if self.eat("("):
            while not self.eat(")"):
                rule()
                self.end(")")
        else:
            rule()
        self.need(";")

    def declaration(self) -> bool:
        if self.eat("var") or self.eat("const"):
            self.group(self.value_spec)
        elif self.eat("type"):
            self.group(self.type_spec)
        else:
            return False
        return True

    def value_spec(self) -> None:
        self.name()
        while self.eat(","):
            self.name()
        if self.text not in ("=", ";", ")"):
            self.type()
        if self.eat("="):
            self.expressions()

    def type_spec(self) -> None:
        self.name()
        if self.text == "[":
            self.attempt(self.type_parameters)
        self.eat("=")
        self.type()

    def type_parameters(self) -> None:
        self.need("[")
        while True:
            self.name()
            while self.eat(","):
                self.name()
            self.constraint()
            if not self.eat(","):
                break
            if self.text == "]":
                break
        self.need("]")

    def constraint(self) -> None:
        self.eat("~")
        self.type()
        while self.eat("|"):
            self.eat("~")
            self.type()

    def function(self) -> bool:
        if not self.eat("func"):
            return False
        if self.text == "(":
            self.parameters()
        self.name()
        if self.text == "[":
            self.type_parameters()
        self.signature()
        if self.text == "{":
            self.block()
        self.need(";")
        return True

    def signature(self) -> None:
        self.parameters()
        if self.text == "(" and self.kind == "op":
            self.parameters()
        elif self.starts_type():
            self.type()

    def parameters(self) -> None:
        self.need("(")
        while self.text != ")":
            self.eat("...")
            self.type()
            if self.text not in (",", ")"):
                self.eat("...")
                self.type()
            if not self.eat(","):
                break
        self.need(")")

    # types
    def starts_type(self) -> bool:
        return self.kind == "id" and (self.text not in KEYWORDS or self.text in ("func", "struct", "map", "chan", "interface")) or self.kind == "op" and self.text in ("*", "[", "(", "<-")

    def type(self) -> None:
        if self.eat("*"):
            self.type()
        elif self.eat("("):
            self.type()
            self.need(")")
        elif self.eat("["):
            if not self.eat("]"):
                if not self.eat("..."):
                    self.expression()
                self.need("]")
            self.type()
        elif self.eat("map"):
            self.need("[")
            self.type()
            self.need("]")
            self.type()
        elif self.eat("<-"):
            self.need("chan")
            self.type()
        elif self.eat("chan"):
            self.eat("<-")
            self.type()
        elif self.eat("func"):
            self.signature()
        elif self.eat("struct"):
            self.need("{")
            while not self.eat("}"):
                self.field()
                self.end("}")
        elif self.eat("interface"):
            self.need("{")
            while not self.eat("}"):
                if self.kind == "id" and self.ahead()[1] == "(" and self.text not in KEYWORDS:
                    self.name()
                    self.signature()
                else:
                    self.constraint()
                self.end("}")
        else:
            self.name()
            if self.eat("."):
                self.name()
            if self.text == "[" and self.kind == "op":
                self.attempt(self.type_arguments)

    def type_arguments(self) -> None:
        self.need("[")
        self.type()
        while self.eat(",") and self.text != "]":
            self.type()
        self.need("]")

    def field(self) -> None:
        if self.eat("*"):
            self.type()
        else:
            embedded = self.ahead()[1] in (";", "}", ".") or self.ahead()[0] == "str"
            if embedded:
                self.type()
            else:
                self.name()
                while self.eat(","):
                    self.name()
                self.type()
        if self.kind == "str":
            self.next()

    # statements
    def block(self) -> None:
        self.need("{")
        old, self.literals = self.literals, True
        self.statements()
        self.literals = old
        self.need("}")

    def statements(self) -> None:
        while self.text not in ("}", "case", "default") or self.kind == "str":
            if not self.kind:
                self.fail("end")
            if self.eat(";"):
                continue
            if self.statement():
                continue
            self.end("}")

    def statement(self) -> bool:
        """True if the statement has taken its own end."""
        t = self.text if self.kind != "str" else ""
        if t in ("var", "const", "type"):
            self.declaration()
            return True
        if t == "{":
            self.block()
        elif t == "if":
            self.if_statement()
        elif t == "for":
            self.for_statement()
        elif t in ("switch", "select"):
            self.switch()
        elif t == "return":
            self.next()
            if self.text not in (";", "}"):
                self.expressions()
        elif t in ("go", "defer"):
            self.next()
            self.expression()
        elif t in ("break", "continue"):
            self.next()
            if self.kind == "id":
                self.name()
        elif t == "goto":
            self.next()
            self.name()
        elif t == "fallthrough":
            self.next()
        elif self.kind == "id" and t not in KEYWORDS and self.ahead()[1] == ":":
            self.next()
            self.next()
            if self.text != "}":
                return self.statement()
        else:
            self.simple()
        return False

    def simple(self) -> None:
        if self.text == ";":
            return
        self.expressions()
        if self.text in _ASSIGN and self.kind == "op":
            self.next()
            if self.eat("range"):
                self.expression()
            else:
                self.expressions()
        elif self.text in ("++", "--"):
            self.next()
        elif self.eat("<-"):
            self.expression()

    def header(self, rule) -> None:
        old, self.literals = self.literals, False
        rule()
        self.literals = old

    def if_statement(self) -> None:
        self.need("if")

        def head() -> None:
            self.simple()
            if self.eat(";"):
                self.simple()

        if self.text == "{":
            self.fail("no condition before")
        self.header(head)
        self.block()
        if self.eat("else"):
            if self.text == "if":
                self.if_statement()
            else:
                self.block()

    def for_statement(self) -> None:
        self.need("for")

        def head() -> None:
            if self.text == "{":
                return
            if self.eat("range"):
                self.expression()
                return
            self.simple()
            if self.eat(";"):
                if self.text != ";":
                    self.expression()
                self.need(";")
                if self.text != "{":
                    self.simple()

        self.header(head)
        self.block()

    def switch(self) -> None:
        select = self.next() == "select"

        def head() -> None:
            if self.text != "{":
                self.simple()
                if self.eat(";") and self.text != "{":
                    self.simple()

        if not select:
            self.header(head)
        self.need("{")
        while not self.eat("}"):
            if self.eat("case"):
                if select:
                    self.simple()
                else:
                    self.type_or_expression()
                    while self.eat(","):
                        self.type_or_expression()
            else:
                self.need("default")
            self.need(":")
            old, self.literals = self.literals, True
            self.statements()
            self.literals = old

    def type_or_expression(self) -> None:
        if not self.attempt(self.expression):
            self.type()

    # expressions
    def expressions(self) -> None:
        self.expression()
        while self.eat(","):
            self.expression()

    def expression(self, least: int = 1) -> None:
        self.unary()
        while self.kind == "op" and _BINARY.get(self.text, 0) >= least:
            level = _BINARY[self.text]
            self.next()
            self.expression(level + 1)

    def unary(self) -> None:
        self.depth += 1
        if self.depth > depth.limit:
            raise TooDeep
        while self.kind == "op" and self.text in ("+", "-", "!", "^", "*", "&", "<-", "~"):
            self.next()
        self.primary()
        self.depth -= 1

    def primary(self) -> None:
        named = False
        if self.kind in ("num", "str", "rune"):
            self.next()
        elif self.kind == "op" and self.text == "(":
            self.next()
            old, self.literals = self.literals, True
            self.type_or_expression()
            self.literals = old
            self.need(")")
        elif self.kind == "id" and self.text == "func":
            self.next()
            self.signature()
            if self.text == "{":
                self.block()
        elif self.kind == "op" and self.text == "[" or self.kind == "id" and self.text in ("struct", "map", "chan", "interface"):
            self.type()
            if self.text == "{":
                self.literal()
        else:
            self.name()
            named = True
        while self.kind == "op":
            if self.text == ".":
                self.next()
                if self.eat("("):
                    if not self.eat("type"):
                        self.type()
                    self.need(")")
                    named = False
                else:
                    self.name()
            elif self.text == "(":
                self.call()
                named = False
            elif self.text == "[":
                self.index()
            elif self.text == "{" and named and self.literals:
                self.literal()
                named = False
            else:
                break

    def call(self) -> None:
        self.need("(")
        old, self.literals = self.literals, True
        while self.text != ")" or self.kind == "str":
            self.type_or_expression()
            self.eat("...")
            if not self.eat(","):
                break
        self.literals = old
        self.need(")")

    def index(self) -> None:
        self.need("[")
        old, self.literals = self.literals, True
        parts = 0
        while self.text != "]":
            if self.eat(":") or self.eat(","):
                parts += 1
                continue
            self.type_or_expression()
            if self.text not in (":", ",", "]"):
                self.fail()
            parts += 1
        if not parts:
            self.fail("empty index")
        self.literals = old
        self.need("]")

    def literal(self) -> None:
        self.need("{")
        old, self.literals = self.literals, True
        while self.text != "}" or self.kind == "str":
            self.element()
            if self.eat(":"):
                self.element()
            if not self.eat(","):
                break
        self.literals = old
        self.need("}")

    def element(self) -> None:
        if self.text == "{" and self.kind == "op":
            self.literal()
        else:
            self.expression()


def check(text: str) -> None:
    Go(text).file()
