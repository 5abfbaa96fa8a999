"""JavaScript (module or script) and TypeScript: statements by a local grammar, tokens read on demand.

Whether ``/`` begins a regular expression and how far a template goes depends on the place in the grammar, so tokens are
not cut beforehand.
"""

from __future__ import annotations

import re

from .base import Bad, TooDeep, depth

RESERVED = frozenset(
    """break case catch class const continue debugger default delete do else enum export extends false finally for function if import in instanceof new
    null return super switch this throw true try typeof var void while with""".split()
)
_SPACE = re.compile(r"(?:[\s\ufeff]+|//[^\n\r\u2028\u2029]*|/\*.*?\*/)+", re.S)
_TOKEN = re.compile(
    r"""(?P<id>(?:[^\W\d]|\$|\\u[0-9a-fA-F]{4}|\\u\{[0-9a-fA-F]+\})(?:[\w$\u200c\u200d]|\\u[0-9a-fA-F]{4}|\\u\{[0-9a-fA-F]+\})*)
    |(?P<num>(?:0[xX][0-9a-fA-F]+(?:_[0-9a-fA-F]+)*n?|0[oO][0-7]+(?:_[0-7]+)*n?|0[bB][01]+(?:_[01]+)*n?|(?:\d+(?:_\d+)*)(?:n|(?:\.(?:\d+(?:_\d+)*)?)?(?:[eE][+-]?\d+)?)|\.\d+(?:_\d+)*(?:[eE][+-]?\d+)?)(?![\w$]))
    |(?P<str>"(?:[^"\\\n\r]|\\(?:\r\n|.))*"|'(?:[^'\\\n\r]|\\(?:\r\n|.))*')
    |(?P<priv>\#(?:[^\W\d]|\$)[\w$]*)
    |(?P<op>>>>=|\.\.\.|===|!==|\*\*=|<<=|>>=|&&=|\|\|=|\?\?=|=>|==|!=|<=|>=|&&|\|\||\?\?|\?\.(?!\d)|\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|\*\*|[-+*/%&|^<>=!()\[\]{},;.:?~@`])""",
    re.X | re.S,
)
_REGEX = re.compile(r"/(?![*/])(?:[^\\/\[\n\r]|\\[^\n\r]|\[(?:[^\]\\\n\r]|\\[^\n\r])*\])+/[\w$]*")
_BINARY = {"??": 1, "||": 2, "&&": 3, "|": 4, "^": 5, "&": 6, "==": 7, "!=": 7, "===": 7, "!==": 7, "<": 8, ">": 8, "<=": 8, ">=": 8, "instanceof": 8, "in": 8, "<<": 9, ">>": 9, ">>>": 9, "+": 10, "-": 10, "*": 11, "/": 11, "%": 11, "**": 12}
_ASSIGN = frozenset("= += -= *= /= %= &= |= ^= <<= >>= >>>= **= &&= ||= ??=".split())
_MEMBER_WORDS = frozenset("static async get set readonly public private protected abstract declare override accessor".split())


class Script:
    def __init__(self, text: str, typed: bool, markup: bool) -> None:
        self.source, self.typed, self.markup = text, typed, markup
        self.at = 2 + (text.find("\n") - 2 if "\n" in text else len(text)) if text.startswith("#!") else 0
        self.kind = self.text = ""
        self.place = self.last_end = 0
        self.line_before = False
        self.depth = 0
        self.functions = 0
        self.in_allowed = True
        self.cover = False  # whether the last primary may be an assignment target with defaults
        self.memo: dict[tuple[int, str], bool] = {}
        self.next()

    # tokens
    def next(self) -> str:
        old = self.text
        self.last_end = self.at
        m = _SPACE.match(self.source, self.at)
        self.line_before = False
        if m:
            gap = m.group()
            self.line_before = "\n" in gap or "\r" in gap
            self.at = m.end()
        self.place = self.at
        if self.at >= len(self.source):
            self.kind = self.text = ""
            return old
        m = _TOKEN.match(self.source, self.at)
        if not m:
            raise Bad(self.at, "no token")
        self.kind, self.text, self.at = m.lastgroup, m.group(), m.end()
        return old

    def state(self):
        return (self.at, self.kind, self.text, self.place, self.last_end, self.line_before, self.depth, self.functions, self.in_allowed)

    def restore(self, s) -> None:
        self.at, self.kind, self.text, self.place, self.last_end, self.line_before, self.depth, self.functions, self.in_allowed = s

    def attempt(self, rule):
        key = (self.place, rule.__name__)
        if self.memo.get(key):
            return None
        s = self.state()
        try:
            return rule() or True
        except Bad:
            self.restore(s)
            self.memo[key] = True
            return None

    def peek(self) -> tuple[str, str, bool]:
        s = self.state()
        try:
            self.next()
            return self.kind, self.text, self.line_before
        except Bad:
            return "op", "?bad", False
        finally:
            self.restore(s)

    def fail(self, why: str = "unexpected"):
        raise Bad(self.place, f"{why} {self.text!r}")

    def op(self, text: str) -> bool:
        return self.text == text and self.kind == "op"

    def word(self, text: str) -> bool:
        return self.text == text and self.kind == "id"

    def eat(self, text: str) -> bool:
        if self.text == text and self.kind in ("op", "id"):
            self.next()
            return True
        return False

    def need(self, text: str) -> None:
        if not self.eat(text):
            self.fail(f"expected {text!r}, not")

    def semicolon(self) -> None:
        if not self.eat(";") and not (self.op("}") or not self.kind or self.line_before):
            self.fail("expected the end, not")

    def name(self) -> None:
        if self.kind != "id" or self.text in RESERVED:
            self.fail("expected a name, not")
        self.next()

    def close_angle(self) -> None:
        self.need(">")

    # statements
    def file(self) -> None:
        while self.kind:
            self.statement(True)

    def block(self) -> None:
        self.need("{")
        old, self.in_allowed = self.in_allowed, True
        while not self.eat("}"):
            self.statement()
        self.in_allowed = old

    def statement(self, top: bool = False) -> None:
        self.depth += 1
        if self.depth > depth.limit:
            raise TooDeep
        self._statement(top)
        self.depth -= 1

    def _statement(self, top: bool) -> None:
        t = self.text if self.kind in ("op", "id") else ""
        if not self.kind:
            self.fail("end")
        if t == "{":
            self.block()
        elif t == ";":
            self.next()
        elif t in ("var", "const") or t == "let" and self.let_declares():
            if t == "const" and self.typed and self.peek()[1] == "enum":
                self.next()
                self.enum()
                return
            self.variables()
            self.semicolon()
        elif t == "function":
            self.function(True)
        elif t == "async" and self.peek()[1:] == ("function", False):
            self.next()
            self.function(True)
        elif t == "class" or t == "@":
            self.decorated_class(True)
        elif t == "if":
            self.next()
            self.condition()
            self.statement()
            if self.eat("else"):
                self.statement()
        elif t == "for":
            self.for_statement()
        elif t in ("while", "with"):
            self.next()
            self.condition()
            self.statement()
        elif t == "do":
            self.next()
            self.statement()
            self.need("while")
            self.condition()
            self.eat(";")
        elif t == "return":
            if not self.functions:
                self.fail("outside a function:")
            self.next()
            if not (self.op(";") or self.op("}") or not self.kind or self.line_before):
                self.expressions()
            self.semicolon()
        elif t in ("break", "continue"):
            self.next()
            if self.kind == "id" and not self.line_before:
                self.name()
            self.semicolon()
        elif t == "throw":
            self.next()
            if self.line_before:
                self.fail("line end before")
            self.expressions()
            self.semicolon()
        elif t == "try":
            self.next()
            self.block()
            done = False
            if self.eat("catch"):
                done = True
                if self.eat("("):
                    self.binding()
                    self.annotation()
                    self.need(")")
                self.block()
            if self.eat("finally"):
                done = True
                self.block()
            if not done:
                self.fail("no handler before")
        elif t == "switch":
            self.next()
            self.condition()
            self.need("{")
            while not self.eat("}"):
                if self.eat("case"):
                    self.expressions()
                else:
                    self.need("default")
                self.need(":")
                while not (self.word("case") or self.word("default") or self.op("}")):
                    self.statement()
        elif t == "debugger":
            self.next()
            self.semicolon()
        elif t == "import" and self.peek()[1] not in ("(", "."):
            if not top:
                self.fail("not at the top:")
            self.import_declaration()
        elif t == "export":
            if not top:
                self.fail("not at the top:")
            self.export_declaration()
        elif self.typed and self.kind == "id" and self.typed_statement(top):
            pass
        elif self.kind == "id" and t not in RESERVED and self.peek()[1] == ":" and self.peek()[0] == "op":
            self.next()
            self.next()
            self.statement()
        else:
            self.expressions()
            self.semicolon()

    def let_declares(self) -> bool:
        kind, text, _ = self.peek()
        return kind == "id" and text not in ("in", "instanceof", "of") or kind == "op" and text in ("[", "{") or text == "of" and kind == "id"

    def variables(self) -> bool:
        """Whether every variable could stand in a for-in head."""
        constant = self.next() == "const"
        while True:
            pattern = self.kind == "op"
            self.binding()
            if self.typed:
                self.eat("!")
            self.annotation()
            if self.eat("="):
                self.assignment()
            elif (pattern or constant and not self.typed) and self.in_allowed:
                self.fail("no value before")
            if not self.eat(","):
                return True

    def binding(self) -> None:
        if self.eat("["):
            while not self.op("]"):
                if self.eat(","):
                    continue
                self.eat("...")
                self.binding()
                if self.eat("="):
                    self.assignment()
                if not self.op("]"):
                    self.need(",")
            self.need("]")
        elif self.eat("{"):
            while not self.op("}"):
                if self.eat("..."):
                    self.binding()
                else:
                    short = self.kind == "id"
                    self.property_name()
                    if self.eat(":"):
                        self.binding()
                    elif not short:
                        self.fail()
                    if self.eat("="):
                        self.assignment()
                if not self.eat(","):
                    break
            self.need("}")
        else:
            self.name()

    def annotation(self) -> None:
        if self.typed and self.op(":"):
            self.next()
            self.type()

    def condition(self) -> None:
        self.need("(")
        self.expressions()
        self.need(")")

    def for_statement(self) -> None:
        self.need("for")
        self.eat("await")
        self.need("(")
        old, self.in_allowed = self.in_allowed, False
        if not self.op(";"):
            if self.word("var") or self.word("const") or self.word("let") and self.let_declares():
                self.variables()
            else:
                self.expressions()
        self.in_allowed = True
        if self.eat("of"):
            self.assignment()
        elif self.eat("in"):
            self.expressions()
        else:
            self.need(";")
            if not self.op(";"):
                self.expressions()
            self.need(";")
            if not self.op(")"):
                self.expressions()
        self.in_allowed = old
        self.need(")")
        self.statement()

    # modules
    def import_declaration(self) -> None:
        self.need("import")
        if self.kind == "str":
            self.next()
        else:
            if self.typed and self.word("type") and self.peek()[1] not in ("from", ",", "="):
                self.next()
            if self.kind == "id" and not self.op("{"):
                self.name()
                if self.typed and self.eat("="):
                    self.expressions()
                    self.semicolon()
                    return
                if self.eat(","):
                    self.import_names()
            else:
                self.import_names()
            self.need("from")
            if self.kind != "str":
                self.fail()
            self.next()
        if self.word("with") or self.word("assert") and not self.line_before:
            self.next()
            self.object()
        self.semicolon()

    def import_names(self) -> None:
        if self.eat("*"):
            self.need("as")
            self.name()
        else:
            self.names(True)

    def names(self, importing: bool) -> None:
        self.need("{")
        while not self.op("}"):
            if self.typed and self.word("type") and self.peek()[1] not in (",", "}", "as"):
                self.next()
            if self.kind not in ("id", "str"):
                self.fail()
            reserved = self.kind == "str" or self.text in RESERVED
            self.next()
            if self.eat("as"):
                if importing:
                    self.name()
                else:
                    self.next()
            elif reserved and importing:
                self.fail()
            if not self.eat(","):
                break
        self.need("}")

    def export_declaration(self) -> None:
        self.need("export")
        if self.eat("default"):
            if self.word("function"):
                self.function(False)
            elif self.word("async") and self.peek()[1:] == ("function", False):
                self.next()
                self.function(False)
            elif self.word("class") or self.op("@") or self.typed and self.word("abstract") and self.peek()[1] == "class":
                self.decorated_class(False)
            elif self.typed and self.word("interface"):
                self.interface()
            else:
                self.assignment()
                self.semicolon()
        elif self.op("*"):
            self.next()
            if self.eat("as"):
                self.next()
            self.need("from")
            self.source_text()
        elif self.op("{") or self.typed and self.word("type") and self.peek()[1] in ("{", "*"):
            self.eat("type")
            if self.eat("*"):
                self.need("from")
                self.source_text()
                return
            self.names(False)
            if self.eat("from"):
                self.source_text()
            else:
                self.semicolon()
        elif self.typed and self.eat("="):
            self.expressions()
            self.semicolon()
        elif self.typed and self.word("as") and self.peek()[1] == "namespace":
            self.next()
            self.next()
            self.name()
            self.semicolon()
        elif self.word("var") or self.word("let") or self.word("const") or self.word("function") or self.word("class") or self.word("async") or self.op("@"):
            self.statement(True)
        elif self.typed and self.kind == "id" and self.typed_statement(True):
            pass
        else:
            self.fail()

    def source_text(self) -> None:
        if self.kind != "str":
            self.fail()
        self.next()
        if self.eat("with"):
            self.object()
        self.semicolon()

    # functions and classes
    def function(self, named: bool) -> None:
        self.need("function")
        self.eat("*")
        if named or self.kind == "id":
            self.name()
        self.function_rest()

    def function_rest(self) -> None:
        """Parameters and body; in TypeScript the body may be missing."""
        self.type_parameters()
        self.parameters()
        if self.typed and self.eat(":"):
            self.return_type()
        if self.op("{"):
            self.body()
        elif self.typed:
            self.semicolon()
        else:
            self.fail()

    def body(self) -> None:
        self.functions += 1
        self.block()
        self.functions -= 1

    def parameters(self) -> None:
        self.need("(")
        old, self.in_allowed = self.in_allowed, True
        while not self.op(")"):
            while self.op("@"):
                self.decorator()
            rest = self.eat("...")
            if self.typed:
                while self.kind == "id" and self.text in _MEMBER_WORDS and self.peek()[0] == "id":
                    self.next()
                if self.word("this"):
                    self.next()
                else:
                    self.binding()
                self.eat("?")
                self.annotation()
            else:
                self.binding()
            if self.eat("="):
                if rest:
                    self.fail()
                self.assignment()
            if not self.eat(","):
                break
            if rest:
                self.fail("after the rest:")
        self.in_allowed = old
        self.need(")")

    def decorator(self) -> None:
        self.need("@")
        if self.op("("):
            self.condition()
        else:
            self.name()
            while self.eat("."):
                self.next()
            if self.op("("):
                self.arguments()

    def decorated_class(self, named: bool) -> None:
        while self.op("@"):
            self.decorator()
        if self.typed:
            self.eat("abstract")
        if self.word("export"):
            self.next()
            self.eat("default")
            named = False
        self.class_(named)

    def class_(self, named: bool) -> None:
        self.need("class")
        if self.kind == "id" and self.text not in ("extends", "implements"):
            self.name()
        elif named:
            self.fail()
        self.type_parameters()
        if self.eat("extends"):
            self.unary_call()
            if self.typed and self.op("<"):
                self.type_arguments()
        if self.typed and self.eat("implements"):
            self.type()
            while self.eat(","):
                self.type()
        self.need("{")
        old, self.in_allowed = self.in_allowed, True
        while not self.eat("}"):
            if not self.eat(";"):
                self.class_member()
        self.in_allowed = old

    def class_member(self) -> None:
        while self.op("@"):
            self.decorator()
        if self.word("static") and self.peek()[1] == "{":
            self.next()
            self.body()
            return
        while self.kind == "id" and self.text in (_MEMBER_WORDS if self.typed else ("static", "async", "get", "set", "accessor")):
            kind, text, _ = self.peek()
            if kind == "op" and text in ("(", "=", ";", "}", ":", "?", "!", "<", ",") or not kind:
                break
            self.next()
        self.eat("*")
        if self.typed and self.op("[") and self.attempt(self.index_signature):
            self.semicolon()
            return
        if self.kind == "priv":
            self.next()
        else:
            self.property_name()
        if self.typed:
            if not self.eat("?"):
                self.eat("!")
        if self.op("(") or self.op("<"):
            self.function_rest()
            return
        self.annotation()
        if self.eat("="):
            self.functions += 1
            self.assignment()
            self.functions -= 1
        self.semicolon()

    def property_name(self) -> None:
        if self.eat("["):
            old, self.in_allowed = self.in_allowed, True
            self.assignment()
            self.in_allowed = old
            self.need("]")
        elif self.kind in ("id", "str", "num"):
            self.next()
        else:
            self.fail()

    # expressions
    def expressions(self) -> None:
        self.assignment()
        while self.eat(","):
            self.assignment()

    def arrow_head(self) -> None:
        """Everything before the body of an arrow function."""
        if self.word("async") and self.peek()[1] in ("(", "<") or self.word("async") and self.peek()[0] == "id" and not self.peek()[2]:
            self.next()
        if self.kind == "id":
            self.name()
        else:
            self.type_parameters()
            self.parameters()
            if self.typed and self.eat(":"):
                self.return_type()
        if self.line_before:
            self.fail()
        self.need("=>")

    def may_be_arrow(self) -> bool:
        if self.op("(") or self.typed and self.op("<"):
            return True
        if self.kind != "id" or self.text in RESERVED:
            return False
        kind, text, _ = self.peek()
        return text == "=>" or self.text == "async" and (text in ("(", "<") or kind == "id")

    def assignment(self) -> None:
        self.depth += 1
        if self.depth > depth.limit:
            raise TooDeep
        if self.may_be_arrow() and self.attempt(self.arrow_head):
            if self.op("{"):
                old, self.in_allowed = self.in_allowed, True
                self.body()
                self.in_allowed = old
            else:
                self.assignment()
        elif self.word("yield") and self.functions:
            self.next()
            if not self.line_before and (self.eat("*") or not (self.kind == "op" and self.text in (")", "]", "}", ",", ";", ":")) and self.kind):
                self.assignment()
        else:
            simple = self.conditional()
            if self.kind == "op" and self.text in _ASSIGN:
                if not simple:
                    self.fail("not a target before")
                self.next()
                self.assignment()
        self.depth -= 1

    def conditional(self) -> bool:
        simple = self.binary(1)
        if self.op("?"):
            simple = False
            self.next()
            old, self.in_allowed = self.in_allowed, True
            self.assignment()
            self.in_allowed = old
            self.need(":")
            self.assignment()
        return simple

    def binary(self, least: int) -> bool:
        simple = self.unary()
        while True:
            if self.typed and self.kind == "id" and self.text in ("as", "satisfies") and not self.line_before:
                self.next()
                if not self.eat("const"):
                    self.type()
                continue
            if self.kind == "op" and self.text == ">":
                self.shift()
            level = _BINARY.get(self.text, 0) if self.kind in ("op", "id") else 0
            if level < least or not level or self.text == "in" and not self.in_allowed:
                return simple
            simple = False
            self.next()
            self.binary(level + 1 if level != 12 else level)

    def shift(self) -> None:
        """Joins ``>`` with what follows; single ones are cut for closing type arguments."""
        m = re.compile(r">{0,2}=?").match(self.source, self.at)
        if m.group():
            self.text += m.group()
            self.at = m.end()

    def unary(self) -> bool:
        if self.kind == "op" and self.text in ("!", "~", "+", "-", "++", "--") or self.kind == "id" and self.text in ("typeof", "void", "delete"):
            self.next()
            self.depth += 1
            if self.depth > depth.limit:
                raise TooDeep
            self.unary()
            self.depth -= 1
            return False
        if self.word("await"):
            kind, text, _ = self.peek()
            if kind in ("id", "num", "str") and text not in ("in", "instanceof", "of") or kind == "op" and text in ("(", "[", "{", "`", "!", "+", "-", "/"):
                self.next()
                self.unary()
                return False
        if self.typed and not self.markup and self.op("<"):
            self.next()
            if not self.eat("const"):
                self.type()
            self.close_angle()
            self.unary()
            return False
        simple = self.unary_call()
        if self.kind == "op" and self.text in ("++", "--") and not self.line_before:
            if not simple:
                self.fail("not a target before")
            self.next()
            return False
        return simple

    def unary_call(self) -> bool:
        if self.word("new"):
            simple = self.new()
        else:
            simple = self.primary()
        return self.suffixes(simple, True)

    def new(self) -> bool:
        self.need("new")
        if self.eat("."):
            self.need("target")
            return False
        if self.word("new"):
            self.new()
        else:
            self.primary()
        self.suffixes(False, False)
        if self.typed and self.op("<"):
            self.attempt(self.type_arguments)
        if self.op("("):
            self.arguments()
        return False

    def suffixes(self, simple: bool, calls: bool) -> bool:
        while self.kind == "op":
            t = self.text
            if t == ".":
                self.next()
                if self.kind not in ("id", "priv"):
                    self.fail()
                self.next()
                simple = True
            elif t == "?.":
                if not calls:
                    self.fail()
                self.next()
                if self.op("("):
                    self.arguments()
                elif self.op("["):
                    self.next()
                    self.index()
                elif self.op("`"):
                    self.fail()
                elif self.typed and self.op("<"):
                    self.type_arguments()
                    self.arguments()
                else:
                    if self.kind not in ("id", "priv"):
                        self.fail()
                    self.next()
                simple = False
            elif t == "[":
                self.next()
                self.index()
                simple = True
            elif t == "(" and calls:
                self.arguments()
                simple = False
            elif t == "`":
                self.template()
                simple = False
            elif t == "!" and self.typed and not self.line_before:
                self.next()
            elif t == "<" and self.typed and calls and self.attempt(self.call_types):
                pass
            else:
                break
        return simple

    def call_types(self) -> None:
        self.type_arguments()
        if not (self.op("(") or self.op("`")):
            self.fail()

    def index(self) -> None:
        old, self.in_allowed = self.in_allowed, True
        self.expressions()
        self.in_allowed = old
        self.need("]")

    def arguments(self) -> None:
        self.need("(")
        old, self.in_allowed = self.in_allowed, True
        while not self.op(")"):
            self.eat("...")
            self.assignment()
            if not self.eat(","):
                break
        self.in_allowed = old
        self.need(")")

    def template(self) -> None:
        """The current token is the opening backtick."""
        source, at = self.source, self.at
        while True:
            if at >= len(source):
                raise Bad(self.place, "open template")
            c = source[at]
            if c == "\\":
                at += 2
            elif c == "`":
                self.at = at + 1
                self.next()
                return
            elif c == "$" and source.startswith("${", at):
                self.at = at + 2
                self.next()
                old, self.in_allowed = self.in_allowed, True
                self.expressions()
                self.in_allowed = old
                if not self.op("}"):
                    self.fail("expected '}', not")
                at = self.at
            else:
                at += 1

    def primary(self) -> bool:
        t = self.text
        if self.kind in ("num", "str"):
            self.next()
            return False
        if self.kind == "id":
            if t == "function":
                self.function(False)
                return False
            if t == "async" and self.peek()[1:] == ("function", False):
                self.next()
                self.function(False)
                return False
            if t == "class":
                self.class_(False)
                return False
            if t in ("this", "null", "true", "false", "super"):
                self.next()
                return False
            if t == "import":
                self.next()
                if not (self.op("(") or self.op(".")):
                    self.fail()
                return False
            self.name()
            return True
        if self.kind == "priv":
            self.next()
            if not self.word("in"):
                self.fail()
            return False
        if t == "(":
            self.next()
            old, self.in_allowed = self.in_allowed, True
            simple = self.conditional_list()
            self.in_allowed = old
            self.need(")")
            return simple
        if t == "[":
            self.next()
            old, self.in_allowed = self.in_allowed, True
            while not self.op("]"):
                if self.eat(","):
                    continue
                self.eat("...")
                self.assignment()
                if not self.op("]"):
                    self.need(",")
            self.in_allowed = old
            self.need("]")
            return True
        if t == "{":
            self.object()
            return True
        if t == "`":
            self.template()
            return False
        if t in ("/", "/="):
            m = _REGEX.match(self.source, self.place)
            if not m:
                self.fail("open expression")
            self.at = m.end()
            self.next()
            return False
        if t == "@":
            self.decorated_class(False)
            return False
        if t == "<" and self.markup:
            self.at = self.element(self.place)
            self.next()
            return False
        self.fail()

    def element(self, at: int) -> int:
        """Past a markup element that begins at the place; expressions in braces are read as such."""
        self.depth += 1
        if self.depth > depth.limit:
            raise TooDeep
        source = self.source
        m = re.compile(r"<\s*([A-Za-z_$][\w$.:-]*)?\s*").match(source, at)
        if not m:
            raise Bad(at, "no element")
        tag, at = m.group(1), m.end()
        while tag:
            m = re.compile(r"\s*(?:([A-Za-z_$][\w$:-]*)\s*(=\s*(?:\"[^\"]*\"|'[^']*'|(?=[{<])))?|(?=\{))").match(source, at)
            if not m:
                break
            at = m.end()
            if m.group(1) is None or m.group(2) and m.group(2)[-1] not in "\"'":
                at = self.element(at) if source.startswith("<", at) else self.braces(at)
        m = re.compile(r"\s*(/?)\s*>").match(source, at)
        if not m:
            raise Bad(at, "open element")
        at = m.end()
        if not m.group(1):
            while True:
                m = re.compile(r"[^<{>}]*").match(source, at)
                at = m.end()
                close = re.compile(r"<\s*/\s*([\w$.:-]*)\s*>").match(source, at)
                if close:
                    if close.group(1) != (tag or ""):
                        raise Bad(at, "another element ends")
                    at = close.end()
                    break
                if source.startswith("<", at):
                    at = self.element(at)
                elif source.startswith("{", at):
                    at = self.braces(at)
                else:
                    raise Bad(at, "open element")
        self.depth -= 1
        return at

    def braces(self, at: int) -> int:
        if not self.source.startswith("{", at):
            raise Bad(at, "no value")
        self.at = at + 1
        self.next()
        if not self.op("}"):
            self.eat("...")
            self.expressions()
            if not self.op("}"):
                self.fail("expected '}', not")
        return self.at

    def conditional_list(self) -> bool:
        start = self.place
        self.expressions()
        return bool(re.fullmatch(r"\s*[\w$.\[\]'\"]+\s*", self.source[start : self.last_end]))

    def object(self) -> None:
        self.need("{")
        old, self.in_allowed = self.in_allowed, True
        while not self.op("}"):
            self.property()
            if not self.eat(","):
                break
        self.in_allowed = old
        self.need("}")

    def property(self) -> None:
        if self.eat("..."):
            self.assignment()
            return
        while self.kind == "id" and self.text in ("async", "get", "set"):
            kind, text, _ = self.peek()
            if kind == "op" and text in ("(", ":", ",", "}", "=", "<"):
                break
            self.next()
        generator = self.eat("*")
        short = self.kind == "id"
        reserved = self.text in RESERVED
        self.property_name()
        if self.op("(") or self.typed and self.op("<"):
            self.function_rest()
        elif generator:
            self.fail()
        elif self.eat(":"):
            self.assignment()
        elif not short or reserved:
            self.fail()
        elif self.eat("="):
            self.assignment()

    # TypeScript
    def typed_statement(self, top: bool) -> bool:
        t = self.text
        kind, text, line = self.peek()
        if line and t not in ("interface",) or kind not in ("id", "str", "op"):
            return False
        if t == "interface" and kind == "id":
            self.interface()
        elif t == "type" and kind == "id" and text not in ("in", "instanceof", "of", "as"):
            self.next()
            self.name()
            self.type_parameters()
            self.need("=")
            self.type()
            self.semicolon()
        elif t == "enum" and kind == "id":
            self.enum()
        elif t in ("namespace", "module") and kind in ("id", "str"):
            self.next()
            if self.kind == "str":
                self.next()
            else:
                self.name()
                while self.eat("."):
                    self.name()
            if self.op("{"):
                self.need("{")
                while not self.eat("}"):
                    self.statement(True)
            else:
                self.semicolon()
        elif t == "abstract" and text == "class":
            self.decorated_class(True)
        elif t == "declare" and kind == "id":
            self.next()
            if self.word("global"):
                self.next()
                self.need("{")
                while not self.eat("}"):
                    self.statement(True)
            else:
                old, self.in_allowed = self.in_allowed, False
                self.statement(top)
                self.in_allowed = old
        else:
            return False
        return True

    def enum(self) -> None:
        self.need("enum")
        self.name()
        self.need("{")
        while not self.op("}"):
            self.property_name()
            if self.eat("="):
                self.assignment()
            if not self.eat(","):
                break
        self.need("}")

    def interface(self) -> None:
        self.need("interface")
        self.name()
        self.type_parameters()
        if self.eat("extends"):
            self.type()
            while self.eat(","):
                self.type()
        self.type_members()

    def type_members(self) -> None:
        self.need("{")
        while not self.op("}"):
            self.type_member()
            if not (self.eat(";") or self.eat(",") or self.op("}") or self.line_before):
                self.fail("expected the end, not")
        self.need("}")

    def type_member(self) -> None:
        if self.op("+") or self.op("-"):
            self.next()
        while self.kind == "id" and self.text in ("readonly", "get", "set"):
            kind, text, _ = self.peek()
            if kind == "op" and text in ("(", ":", "?", ";", ",", "}", "<"):
                break
            self.next()
        if self.op("[") and self.attempt(self.index_signature):
            return
        if self.eat("new"):
            pass
        elif not (self.op("(") or self.op("<")):
            self.property_name()
        self.eat("?")
        if self.op("(") or self.op("<"):
            self.type_parameters()
            self.parameters()
            if self.eat(":"):
                self.return_type()
        else:
            self.annotation()

    def index_signature(self) -> None:
        self.need("[")
        self.name()
        if self.eat("in"):
            self.type()
            if self.eat("as"):
                self.type()
        else:
            self.need(":")
            self.type()
        self.need("]")
        if self.op("+") or self.op("-"):
            self.next()
        self.eat("?")
        self.annotation()

    def type_parameters(self) -> None:
        if not (self.typed and self.op("<")):
            return
        self.next()
        while True:
            while self.kind == "id" and self.text in ("const", "in", "out") and self.peek()[0] == "id":
                self.next()
            self.name()
            if self.eat("extends"):
                self.type()
            if self.eat("="):
                self.type()
            if not self.eat(",") or self.op(">"):
                break
        self.close_angle()

    def type_arguments(self) -> None:
        self.need("<")
        while True:
            self.type()
            if not self.eat(","):
                break
        self.close_angle()

    def return_type(self) -> None:
        if self.word("asserts") and self.peek()[0] == "id" and not self.peek()[2]:
            self.next()
        self.type()
        if self.word("is") and not self.line_before:
            self.next()
            self.type()

    def type(self) -> None:
        self.depth += 1
        if self.depth > depth.limit:
            raise TooDeep
        if (self.op("(") or self.op("<") or self.word("new") or self.word("abstract")) and self.attempt(self.function_type):
            pass
        else:
            self.eat("|") or self.eat("&")
            self.type_operand()
            while self.op("|") or self.op("&"):
                self.next()
                self.type_operand()
            if self.word("extends") and not self.line_before:
                self.next()
                self.type()
                if self.eat("?"):
                    self.type()
                    self.need(":")
                    self.type()
        self.depth -= 1

    def function_type(self) -> None:
        self.eat("abstract")
        self.eat("new")
        self.type_parameters()
        self.parameters()
        self.need("=>")
        self.return_type()

    def type_operand(self) -> None:
        while self.kind == "id" and self.text in ("keyof", "unique", "readonly", "infer") and (self.peek()[0] in ("id", "str") or self.peek()[1] in ("(", "[", "{")) and not self.peek()[2]:
            self.next()
        if self.op("(") and self.attempt(self.function_type):
            return
        if self.kind in ("str", "num"):
            self.next()
        elif self.eat("-"):
            if self.kind != "num":
                self.fail()
            self.next()
        elif self.op("`"):
            typed = self.template_type
            typed()
        elif self.op("{"):
            self.type_members()
        elif self.eat("["):
            while not self.op("]"):
                self.eat("...")
                if self.kind == "id" and self.peek()[1] in (":", "?"):
                    self.next()
                    self.eat("?")
                    self.need(":")
                self.type()
                self.eat("?")
                if not self.eat(","):
                    break
            self.need("]")
        elif self.eat("("):
            self.type()
            self.need(")")
        elif self.word("typeof"):
            self.next()
            if self.word("import"):
                self.import_type()
            else:
                self.next()
            while self.eat("."):
                self.next()
            if self.op("<") and not self.line_before:
                self.type_arguments()
        elif self.word("import"):
            self.import_type()
        elif self.kind == "id" and (self.text not in RESERVED or self.text in ("void", "null", "this", "true", "false")):
            self.next()
            while self.eat("."):
                if self.kind != "id":
                    self.fail()
                self.next()
            if self.op("<") and not self.line_before:
                self.type_arguments()
        else:
            self.fail("expected a type, not")
        while self.op("[") and not self.line_before:
            self.next()
            if not self.op("]"):
                self.type()
            self.need("]")

    def import_type(self) -> None:
        self.need("import")
        self.arguments()
        while self.eat("."):
            self.next()
        if self.op("<"):
            self.type_arguments()

    def template_type(self) -> None:
        at = self.at
        source = self.source
        while True:
            if at >= len(source):
                raise Bad(self.place, "open template")
            if source[at] == "\\":
                at += 2
            elif source[at] == "`":
                self.at = at + 1
                self.next()
                return
            elif source.startswith("${", at):
                self.at = at + 2
                self.next()
                self.type()
                if not self.op("}"):
                    self.fail()
                at = self.at
            else:
                at += 1


def check(text: str, typed: bool = False, markup: bool = False) -> None:
    Script(text, typed, markup).file()
