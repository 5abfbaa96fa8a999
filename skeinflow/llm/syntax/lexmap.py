"""Chunks of a file as maps of lexer states with bracket summaries.

For every state in which a chunk may begin, the map has the state in which it then ends and the brackets it leaves: the
closing ones that have no opening one in the chunk, then the opening ones without a closing one. Maps of neighbouring
chunks combine into the map of both, and the combination is associative, so chunks can be read anywhere and reduced in any
grouping. A file is balanced if the combined map leads from code back to code with no bracket left.

A map may also say that a chunk is ``OPEN``: what stands there can only be told by the grammar (a slash behind a brace, markup
in a script, quotes nested in a formatted text). An open file is never called unbalanced; its grammar decides.

A shell's here-documents end at words of the script's choice, and YAML's scalars at an indentation of any depth: no fixed set
of states describes them, so these files are one chunk.
"""

from __future__ import annotations

import re
from functools import reduce

CODE = "code"
BAD = "bad"
OPEN = "open"
_PAIR = {")": "(", "]": "[", "}": "{"}

# Per language the openings of states, and per state what it may hold and its end.
_OPENINGS = {
    "json": {'"': "string"},
    "go": {'"': "string", "`": "raw", "'": "rune", "//": "line", "/*": "comment"},
    "java": {'"""': "block", '"': "string", "'": "rune", "//": "line", "/*": "comment"},
    "toml": {'"""': "block", "'''": "literals", '"': "string", "'": "literal", "#": "line"},
    "python": {'"""': "block", "'''": "blocks", '"': "text", "'": "texts", "#": "line"},
    "javascript": {"`": "template", "/*": "comment"},
    "typescript": {"`": "template", "/*": "comment"},
}
LANGUAGES = tuple(_OPENINGS)
_STATES = {
    "string": re.compile(r'(?:[^"\\\n]|\\[^\n])*("|\n|$)'),
    "rune": re.compile(r"(?:[^'\\\n]|\\[^\n])*('|\n|$)"),
    "text": re.compile(r'(?:[^"\\\n]|\\.)*("|\n|$)', re.S),
    "texts": re.compile(r"(?:[^'\\\n]|\\.)*('|\n|$)", re.S),
    "raw": re.compile(r"[^`]*(`|$)"),
    "literal": re.compile(r"[^'\n]*('|\n|$)"),
    "block": re.compile(r'(?:(?!""")(?:[^\\]|\\.))*("{3,5}|$)', re.S),
    "blocks": re.compile(r"(?:(?!''')(?:[^\\]|\\.))*('''|$)", re.S),
    "literals": re.compile(r"(?:(?!''').)*('{3,5}|$)", re.S),
    "line": re.compile(r"[^\n]*(\n|$)"),
    "comment": re.compile(r"(?:(?!\*/).)*(\*/|$)", re.S),
    "template": re.compile(r"(?:[^`\\$]|\\.|\$(?!\{))*(`|\$\{|$)", re.S),
}
_SCAN = {language: re.compile("|".join(re.escape(x) for x in sorted(opens, key=len, reverse=True)) + r"|[()\[\]{}]") for language, opens in _OPENINGS.items()}
_PREFIX = re.compile(r"(?<![\w\"'])[fFtT][rR]?$|(?<![\w\"'])[rR][fFtT]$")

_SCRIPT = re.compile(r"//[^\n]*|/\*|'(?:[^'\\\n]|\\.)*'|\"(?:[^\"\\\n]|\\.)*\"|[`(\[{)\]}/'\"]", re.S)
_WORD_BEFORE = re.compile(r"[\w$\u0080-\uffff]+$")
_REGEX = re.compile(r"/(?:[^/\\\[\n]|\\[^\n]|\[(?:[^\]\\\n]|\\[^\n])*\])+/[A-Za-z]*")
_MARKUP = re.compile(r"</[\w$>]|/>|<>|<!--|-->")
# Words of the language behind which an expression begins, and those whose brackets a statement follows.
_BEFORE_VALUE = frozenset("return typeof instanceof in of new delete void throw case do else yield await".split())
_HEADS = frozenset("if while for with".split())


def states(language: str) -> list[str]:
    return [CODE, *dict.fromkeys(_OPENINGS[language].values())]


def _pop(stack: list[str], found: str, closing: list[str]) -> bool:
    """Takes the bracket that ``found`` closes; False if it is another one's."""
    if not stack:
        closing.append(found)
        return True
    return stack.pop() == _PAIR[found]


def read(language: str, chunk: str, state: str) -> tuple[str, str, str]:
    """(end state, unmatched closing brackets, unmatched opening brackets) of one chunk; the end of a line ends nothing
    that may not be open there."""
    if language in ("javascript", "typescript"):
        return _read_script(language, chunk, state)
    at, closing, opening = 0, [], []
    scan, opens = _SCAN[language], _OPENINGS[language]
    formatted = -1
    while True:
        if state != CODE:
            m = _STATES[state].match(chunk, at)
            if m is None:
                return BAD, "", ""
            end = m.group(1)
            if formatted >= 0:
                body = chunk[formatted : m.end()]
                if end in ("", "\n") and "{" in body or body.count("{") != body.count("}"):
                    return OPEN, "", ""
                formatted = -1
            if end == "":
                return state, "".join(closing), "".join(opening)
            if end == "\n" and state != "line":
                return BAD, "", ""
            at, state = m.end(), CODE
        m = scan.search(chunk, at)
        if m is None:
            return CODE, "".join(closing), "".join(opening)
        found = m.group()
        if found in opens:
            state = opens[found]
            if language == "python" and state != "line" and _PREFIX.search(chunk, max(0, m.start() - 3), m.start()):
                formatted = m.end()
        elif found in "([{":
            opening.append(found)
        elif not _pop(opening, found, closing):
            return BAD, "", ""
        at = m.end()


def _value_follows(chunk: str, at: int, closed: tuple[int, bool | None]) -> bool | None:
    """Whether a value may stand at the place, by the token before it; None where the chunk does not tell."""
    end = at
    while end and chunk[end - 1] in " \t\n":
        end -= 1
    if not end:
        return None
    before = chunk[end - 1]
    if before == ")":
        return closed[1] if closed[0] == end else None
    if before in "}/" or chunk[end - 2 : end] in ("++", "--"):
        return None
    word = _WORD_BEFORE.search(chunk, max(0, end - 12), end)
    return word.group() in _BEFORE_VALUE if word else before not in "]`'\".#"


def _read_script(language: str, chunk: str, state: str) -> tuple[str, str, str]:
    """As ``read``, for scripts: templates nest by a bracket of their own (``$``), and a slash begins a regular expression
    where a value may stand."""
    at, closing = 0, []
    stack: list[str] = []
    heads: list[bool] = []  # for each round bracket of the stack whether a statement follows it
    closed: tuple[int, bool | None] = (-1, None)  # the end of the last round bracket that closed, and the same of it
    if language == "javascript" and _MARKUP.search(chunk):
        return OPEN, "", ""
    if state == CODE and chunk.startswith("#!"):
        at = chunk.find("\n") + 1 or len(chunk)
    while True:
        if state != CODE:
            m = _STATES[state].match(chunk, at)
            end = m.group(1)
            if end == "":
                return state, "".join(closing), "".join(stack)
            at, state = m.end(), CODE
            if end == "${":
                stack.append("$")
            continue
        m = _SCRIPT.search(chunk, at)
        if m is None:
            return CODE, "".join(closing), "".join(stack)
        found, at = m.group(), m.end()
        first = found[0]
        if first == "/" and len(found) == 1:
            value = _value_follows(chunk, m.start(), closed)
            m = _REGEX.match(chunk, m.start()) if value else m
            if value is None or m is None:
                return OPEN, "", ""
            at = m.end()
        elif first == "/" or len(found) > 1:
            if found == "/*":
                state = "comment"
        elif first == "`":
            state = "template"
        elif first in "'\"":
            return OPEN, "", ""
        elif first in "([{":
            if first == "(":
                word = _WORD_BEFORE.search(chunk[max(0, m.start() - 12) : m.start()].rstrip())
                heads.append(word is not None and word.group() in _HEADS)
            stack.append(first)
        elif stack and stack[-1] == "$" and first == "}":
            stack.pop()
            state = "template"
        elif not _pop(stack, first, closing):
            return (OPEN if language == "javascript" else BAD), "", ""
        elif first == ")":
            closed = at, heads.pop() if heads else None


def summary(language: str, chunk: str, first: bool) -> dict[str, tuple[str, str, str]]:
    """The map of a chunk; a first chunk begins in code only."""
    return {s: read(language, chunk, s) for s in ([CODE] if first else states(language))}


def combine(a: dict, b: dict) -> dict:
    """The map of two neighbouring chunks."""
    out = {}
    for start, (state, closing, opening) in a.items():
        if state in (BAD, OPEN):
            out[start] = (state, "", "")
            continue
        end, more, left = b[state]
        if end in (BAD, OPEN):
            out[start] = (end, "", "")
            continue
        n = min(len(opening), len(more))
        met = [(more[i], opening[-1 - i]) for i in range(n)]
        if any(o == "$" and c == "}" for c, o in met):
            out[start] = (OPEN, "", "")
        elif any(_PAIR[c] != o for c, o in met):
            out[start] = (BAD, "", "")
        else:
            out[start] = (end, closing + more[n:], opening[: len(opening) - n] + left)
    return out


def balanced(maps: list[dict]) -> bool:
    """Whether the chunks, in order, lead from code to code (or into a last line comment) with no bracket left, as far as
    can be told without the grammar."""
    end, closing, opening = reduce(combine, maps)[CODE]
    return end == OPEN or end in (CODE, "line") and not closing and not opening


def chunks(text: str, size: int) -> list[str]:
    """Pieces of about ``size`` characters that end with a line where there is one."""
    if len(text) <= size:
        return [text]
    out, at = [], 0
    while at < len(text):
        stop = text.find("\n", at + size)
        stop = len(text) if stop < 0 else stop + 1
        out.append(text[at:stop])
        at = stop
    return out
