"""Java: declarations and statements by a local grammar."""

from __future__ import annotations

import re

from .base import Stream, TooDeep, depth, tokenize

KEYWORDS = frozenset(
    """abstract assert boolean break byte case catch char class const continue default do double else enum extends final finally float for goto if
    implements import instanceof int interface long native new package private protected public return short static strictfp super switch synchronized
    this throw throws transient try void volatile while true false null""".split()
)
_PRIMITIVE = frozenset("boolean byte char double float int long short".split())
_MODIFIERS = frozenset("abstract default final native private protected public static strictfp synchronized transient volatile sealed".split())
_TOKEN = re.compile(
    r"""(?P<space>\s+|//[^\n]*|/\*.*?\*/)|(?P<str>\"\"\"[ \t\f]*\r?\n(?:[^\\]|\\.)*?\"\"\"|"(?:[^"\\\n]|\\[btnfrs0-7u'"\\])*")|(?P<chr>'(?:[^'\\\n]|\\(?:[btnfrs'"\\]|[0-7]{1,3}|u+[0-9a-fA-F]{4}))')
    |(?P<num>(?:0[xX][0-9a-fA-F_]+(?:\.[0-9a-fA-F_]*)?(?:[pP][+-]?\d+)?|0[bB][01_]+|\d[\d_]*(?:\.(?:\d[\d_]*)?)?(?:[eE][+-]?\d+)?|\.\d[\d_]*(?:[eE][+-]?\d+)?)[lLfFdD]?(?!\w))
    |(?P<id>(?:[^\W\d]|\$)(?:\w|\$)*)|(?P<op>\.\.\.|->|::|\+\+|--|&&|\|\||==|!=|<=|>=|\+=|-=|\*=|/=|&=|\|=|\^=|%=|<<=|<<|[-+*/%&|^<>=!()\[\]{},;.:?~@])""",
    re.X | re.S,
)
_BINARY = frozenset("|| && | ^ & == != < > <= >= << + - * / %".split())
_ASSIGN = frozenset("= += -= *= /= &= |= ^= %= <<= >>= >>>=".split())


class Java(Stream):
    def __init__(self, text: str) -> None:
        super().__init__(tokenize(_TOKEN, text, frozenset(["space"])))

    def name(self) -> None:
        if self.kind != "id" or self.text in KEYWORDS:
            self.fail("expected a name, not")
        self.next()

    def path(self) -> None:
        self.name()
        while self.text == "." and self.ahead()[0] == "id" and self.ahead()[1] not in KEYWORDS:
            self.next()
            self.name()

    # compilation unit
    def file(self) -> None:
        if self.attempt(self.package_line):
            pass
        while True:
            if self.eat(";"):
                continue
            if not self.eat("import"):
                break
            self.eat("static")
            self.path()
            if self.eat("."):
                self.need("*")
            self.need(";")
        while self.kind:
            if not self.eat(";"):
                self.modifiers()
                self.type_declaration()

    def package_line(self) -> None:
        while self.text == "@":
            self.annotation()
        self.need("package")
        self.path()
        self.need(";")

    def modifiers(self) -> None:
        while True:
            if self.text == "@" and self.ahead()[1] != "interface":
                self.annotation()
            elif self.kind == "id" and (self.text in _MODIFIERS and not (self.text == "default" and self.ahead()[1] in (":", "->")) and not (self.text == "synchronized" and self.ahead()[1] == "(") and not (self.text == "sealed" and self.ahead()[0] == "op")):
                self.next()
            elif self.text == "non" and self.ahead()[1] == "-":
                self.next()
                self.next()
                self.need("sealed")
            else:
                return

    def annotation(self) -> None:
        self.need("@")
        self.path()
        if self.eat("("):
            if self.text != ")":
                while True:
                    self.annotation_value()
                    if not self.eat(","):
                        break
            self.need(")")

    def annotation_value(self) -> None:
        if self.kind == "id" and self.ahead()[1] == "=":
            self.next()
            self.next()
        if self.text == "@":
            self.annotation()
        elif self.eat("{"):
            while self.text != "}":
                self.annotation_value()
                if not self.eat(","):
                    break
            self.need("}")
        else:
            self.ternary()

    def starts_type_declaration(self) -> bool:
        return self.kind == "id" and (self.text in ("class", "interface", "enum") or self.text == "record" and self.ahead()[0] == "id" and self.ahead(2)[1] in ("(", "<")) or self.text == "@" and self.ahead()[1] == "interface"

    def type_declaration(self) -> None:
        if not self.starts_type_declaration():
            self.fail()
        self.eat("@")
        kind = self.next()
        self.name()
        self.type_parameters()
        if kind == "record":
            self.parameters()
        for word in ("extends", "implements", "permits"):
            if self.eat(word):
                self.type()
                while self.eat(","):
                    self.type()
        self.body(kind == "enum")

    def type_parameters(self) -> None:
        if self.eat("<"):
            while True:
                while self.text == "@":
                    self.annotation()
                self.name()
                if self.eat("extends"):
                    self.type()
                    while self.eat("&"):
                        self.type()
                if not self.eat(","):
                    break
            self.need(">")

    def body(self, enum: bool = False) -> None:
        self.need("{")
        if enum:
            while self.text == "@" or self.kind == "id" and self.text not in KEYWORDS:
                while self.text == "@":
                    self.annotation()
                self.name()
                if self.text == "(":
                    self.arguments()
                if self.text == "{":
                    self.body()
                if not self.eat(","):
                    break
            if self.text != "}":
                self.need(";")
        while not self.eat("}"):
            self.member()

    def member(self) -> None:
        if self.eat(";"):
            return
        if self.text == "{" or self.text == "static" and self.ahead()[1] == "{":
            self.eat("static")
            self.block()
            return
        self.modifiers()
        if self.starts_type_declaration():
            self.type_declaration()
            return
        self.type_parameters()
        if self.kind == "id" and self.text not in KEYWORDS and self.ahead()[1] in ("(", "{"):
            self.name()
            if self.text == "(":
                self.parameters()
            self.throws()
            self.block()
            return
        if not self.eat("void"):
            self.type()
        self.name()
        if self.text == "(":
            self.parameters()
            self.dimensions()
            self.throws()
            if self.eat("default"):
                self.annotation_value()
            if not self.eat(";"):
                self.block()
            return
        self.declarators()
        self.need(";")

    def throws(self) -> None:
        if self.eat("throws"):
            self.type()
            while self.eat(","):
                self.type()

    def parameters(self) -> None:
        self.need("(")
        if self.text != ")":
            while True:
                self.modifiers()
                self.type()
                self.eat("...")
                if not self.eat("this"):
                    self.name()
                self.dimensions()
                if not self.eat(","):
                    break
        self.need(")")

    def dimensions(self) -> None:
        while self.text == "[" and self.ahead()[1] == "]":
            self.next()
            self.next()

    def declarators(self) -> None:
        """After the first name."""
        while True:
            self.dimensions()
            if self.eat("="):
                self.initializer()
            if not self.eat(","):
                return
            self.name()

    def initializer(self) -> None:
        if self.eat("{"):
            while self.text != "}" or self.kind == "str":
                self.initializer()
                if not self.eat(","):
                    break
            self.need("}")
        else:
            self.expression()

    # types
    def type(self) -> None:
        while self.text == "@":
            self.annotation()
        if self.kind == "id" and self.text in _PRIMITIVE:
            self.next()
        else:
            self.name()
            self.type_arguments()
            while self.text == "." and self.ahead()[0] == "id":
                self.next()
                self.name()
                self.type_arguments()
        self.dimensions()

    def type_arguments(self) -> None:
        if self.text == "<" and self.kind == "op":
            self.next()
            if self.eat(">"):
                return
            while True:
                while self.text == "@":
                    self.annotation()
                if self.eat("?"):
                    if self.eat("extends") or self.eat("super"):
                        self.type()
                else:
                    self.type()
                if not self.eat(","):
                    break
            self.need(">")

    # statements
    def block(self) -> None:
        self.need("{")
        while not self.eat("}"):
            self.statement()

    def statement(self) -> None:
        t = self.text if self.kind in ("id", "op") else ""
        if not self.kind:
            self.fail("end")
        if t == "{":
            self.block()
        elif t == ";":
            self.next()
        elif t == "if" or t == "while":
            self.next()
            self.condition()
            self.statement()
            if t == "if" and self.eat("else"):
                self.statement()
        elif t == "for":
            self.for_statement()
        elif t == "do":
            self.next()
            self.statement()
            self.need("while")
            self.condition()
            self.need(";")
        elif t == "try":
            self.try_statement()
        elif t == "switch":
            self.switch()
            if self.text == ".":
                self.suffixes()
                self.need(";")
        elif t == "synchronized" and self.ahead()[1] == "(":
            self.next()
            self.condition()
            self.block()
        elif t in ("return", "throw"):
            self.next()
            if t == "throw" or self.text != ";":
                self.expression()
            self.need(";")
        elif t in ("break", "continue"):
            self.next()
            if self.text != ";":
                self.name()
            self.need(";")
        elif t == "yield" and self.ahead()[1] not in ("=", ".", "(", "++", "--", "["):
            self.next()
            self.expression()
            self.need(";")
        elif t == "assert":
            self.next()
            self.expression()
            if self.eat(":"):
                self.expression()
            self.need(";")
        elif self.kind == "id" and t not in KEYWORDS and self.ahead()[1] == ":":
            self.next()
            self.next()
            self.statement()
        elif t in ("@", "final", "abstract", "static", "class", "interface", "enum") or t == "record" and self.starts_type_declaration():
            self.modifiers()
            if self.starts_type_declaration():
                self.type_declaration()
            else:
                self.local()
                self.need(";")
        elif self.attempt(self.local_start):
            self.declarators()
            self.need(";")
        else:
            start = self.i
            self.expression()
            last = self.tokens[self.i - 1]
            words = [x[1] for x in self.tokens[start : self.i] if x[0] == "op"]
            if last[1] not in (")", "++", "--", "]", "}") and not _ASSIGN.intersection(words) and not {"++", "--"}.intersection(words) or last[1] == "]" and not _ASSIGN.intersection(words):
                self.fail("not a statement before")
            self.need(";")

    def local_start(self) -> None:
        self.type()
        self.name()
        if self.text not in ("=", ";", ",", "[", ":"):
            self.fail()

    def local(self) -> None:
        self.type()
        self.name()
        self.declarators()

    def condition(self) -> None:
        self.need("(")
        self.expression()
        self.need(")")

    def for_statement(self) -> None:
        self.need("for")
        self.need("(")
        if not self.eat(";"):
            if self.text in ("final", "@") or self.attempt_local():
                self.modifiers()
                self.type()
                self.name()
                if self.eat(":"):
                    self.expression()
                    self.need(")")
                    self.statement()
                    return
                self.declarators()
            else:
                self.expression_list()
            self.need(";")
        if self.text != ";":
            self.expression()
        self.need(";")
        if self.text != ")":
            self.expression_list()
        self.need(")")
        self.statement()

    def attempt_local(self) -> bool:
        at = self.i
        found = self.attempt(self.local_start)
        self.go(at)
        return bool(found)

    def expression_list(self) -> None:
        self.expression()
        while self.eat(","):
            self.expression()

    def try_statement(self) -> None:
        self.need("try")
        resources = self.eat("(")
        if resources:
            while self.text != ")":
                self.modifiers()
                if self.attempt_local():
                    self.local()
                else:
                    self.expression()
                if not self.eat(";"):
                    break
            self.need(")")
        self.block()
        handlers = 0
        while self.eat("catch"):
            handlers += 1
            self.need("(")
            self.modifiers()
            self.type()
            while self.eat("|"):
                self.type()
            self.name()
            self.need(")")
            self.block()
        if self.eat("finally"):
            handlers += 1
            self.block()
        if not handlers and not resources:
            self.fail("no handler before")

    def switch(self) -> None:
        self.need("switch")
        self.condition()
        self.need("{")
        while not self.eat("}"):
            if self.eat("case"):
                while True:
                    if not self.eat("default") and not self.attempt(self.pattern):
                        self.ternary(False)
                    if not self.eat(","):
                        break
                if self.text == "when":
                    self.next()
                    self.expression(False)
            elif not self.eat("default"):
                self.statement()
                continue
            if self.eat("->"):
                if self.text in ("{", "throw"):
                    self.statement()
                else:
                    self.expression()
                    self.need(";")
            else:
                self.need(":")

    def pattern(self) -> None:
        self.eat("final")
        self.type()
        if self.eat("("):
            while self.text != ")":
                self.pattern()
                if not self.eat(","):
                    break
            self.need(")")
            if self.kind == "id" and self.text != "when":
                self.name()
        else:
            self.name()
        if self.text not in ("->", ":", ",", ")", "when", "&&", "||", ";", "?"):
            self.fail()

    # expressions
    def lambda_start(self) -> None:
        if self.kind == "id":
            self.name()
        else:
            self.need("(")
            if self.text != ")":
                while True:
                    if self.kind == "id" and self.ahead()[1] in (",", ")"):
                        self.name()
                    else:
                        self.modifiers()
                        self.type()
                        self.eat("...")
                        self.name()
                    if not self.eat(","):
                        break
            self.need(")")
        self.need("->")

    def expression(self, arrows: bool = True) -> None:
        self.depth += 1
        if self.depth > depth.limit:
            raise TooDeep
        if arrows and (self.text == "(" and self.kind == "op" or self.kind == "id" and self.ahead()[1] == "->") and self.attempt(self.lambda_start):
            if self.text == "{":
                self.block()
            else:
                self.expression()
        else:
            self.ternary(arrows)
            if self.kind == "op" and self.text in _ASSIGN:
                self.next()
                self.expression()
            elif self.text == ">" and self.ahead()[1] in (">", ">=") and self.kind == "op":
                while self.text == ">":
                    self.next()
                self.need(">=")
                self.expression()
        self.depth -= 1

    def ternary(self, arrows: bool = True) -> None:
        self.binary()
        if self.eat("?"):
            self.expression()
            self.need(":")
            self.expression(arrows)

    def binary(self) -> None:
        self.unary()
        while True:
            if self.text == "instanceof" and self.kind == "id":
                self.next()
                if not self.attempt(self.pattern):
                    self.eat("final")
                    self.type()
                continue
            if self.kind != "op" or self.text not in _BINARY:
                return
            if self.text == ">" and self.ahead()[1] == ">":
                at = self.i
                while self.text == ">" and self.i - at < 3:
                    self.next()
                if self.text == ">=":
                    self.go(at)
                    return
            else:
                self.next()
            self.unary()

    def cast(self) -> None:
        self.need("(")
        primitive = self.text in _PRIMITIVE
        self.type()
        while self.eat("&"):
            self.type()
        self.need(")")
        if primitive:
            if self.text in _BINARY and self.text not in ("+", "-") or self.text in (")", ";", ","):
                self.fail()
        elif not (self.kind in ("id", "str", "num", "chr") and self.text != "instanceof" or self.text in ("(", "!", "~")):
            self.fail()

    def unary(self) -> None:
        while self.kind == "op" and self.text in ("+", "-", "!", "~", "++", "--"):
            self.next()
        if self.text == "(" and self.kind == "op" and self.attempt(self.cast):
            if self.attempt(self.lambda_start):
                if self.text == "{":
                    self.block()
                else:
                    self.expression()
                return
            self.unary()
            return
        self.primary()
        self.suffixes()

    def primary(self) -> None:
        if self.kind in ("num", "str", "chr"):
            self.next()
        elif self.eat("("):
            self.expression()
            self.need(")")
        elif self.kind == "id" and self.text in ("this", "super", "true", "false", "null"):
            self.next()
        elif self.text == "switch" and self.kind == "id":
            self.switch()
        elif self.text == "new" and self.kind == "id":
            self.creation()
        elif self.kind == "id" and (self.text in _PRIMITIVE or self.text == "void"):
            self.next()
            self.dimensions()
            if self.text not in (".", "::"):
                self.fail()
        else:
            self.name()
            if self.text == "<":
                self.attempt(self.generic_reference)
            elif self.text == "[" and self.ahead()[1] == "]":
                self.dimensions()

    def generic_reference(self) -> None:
        self.type_arguments()
        self.dimensions()
        if self.text != "::":
            self.fail()

    def creation(self) -> None:
        self.need("new")
        while self.text == "@":
            self.annotation()
        if self.kind == "id" and self.text in _PRIMITIVE:
            self.next()
        else:
            self.path()
            self.type_arguments()
            while self.eat("."):
                self.name()
                self.type_arguments()
        if self.text == "[":
            sized = 0
            while self.eat("["):
                if self.text != "]":
                    self.expression()
                    sized += 1
                self.need("]")
            if not sized:
                if self.text != "{":
                    self.fail()
                self.initializer()
        else:
            self.arguments()
            if self.text == "{":
                self.body()

    def arguments(self) -> None:
        self.need("(")
        if self.text != ")" or self.kind == "str":
            self.expression_list()
        self.need(")")

    def suffixes(self) -> None:
        while self.kind == "op":
            if self.text == ".":
                self.next()
                if self.text == "<":
                    self.type_arguments()
                if self.text == "new":
                    self.creation()
                elif self.kind == "id" and self.text in ("this", "class", "super"):
                    self.next()
                else:
                    self.name()
            elif self.text == "(":
                self.arguments()
            elif self.text == "[":
                self.next()
                self.expression()
                self.need("]")
            elif self.text in ("++", "--"):
                self.next()
            elif self.text == "::":
                self.next()
                if not self.eat("new"):
                    self.name()
            else:
                return


def check(text: str) -> None:
    Java(text).file()
