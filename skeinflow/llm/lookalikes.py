"""One consistent form of texts that look the same.

Characters are folded to what a reader sees: blanks of any width to a plain blank, width forms, ligatures and presentation
forms to their plain letters, invisible characters to nothing, combining sequences to composed letters. What a reader can
tell apart (case, accents, raised and encircled digits, curly and straight quotes) stays apart.

Look-alike letters are settled per token. Every letter has the set of scripts in which its shape occurs; the token's
resolved set is the intersection over its letters. One script left: the token is spelled in it. Several (a whole-script
confusable): the script of the nearest token before it, else after it, that resolves to one of them, else the first of
``SCRIPTS``. None (mixed scripts): each letter by the first script that has its shape. Every choice depends on shapes
alone, so texts of the same look get the same form, and no others do.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Latin letters and the letters of other scripts that have the same shape, place by place.
SHAPES = {
    "CYRILLIC": ("ABCEGHIJKMOPQSTVWXYacdehijopqsvwxy", "АВСЕԌНІЈКМОРԚЅТѴԜХҮасԁеһіјорԛѕѵԝху"),
    "GREEK": ("ABEHIKMNOPTXYZFcjov", "ΑΒΕΗΙΚΜΝΟΡΤΧΥΖϜϲϳον"),
    "ARMENIAN": ("OSLohnu", "ՕՏԼօհոս"),
    "CHEROKEE": ("ABCEGHJKLMPSTVWZ", "ᎪᏴᏟᎬᏀᎻᎫᏦᏞᎷᏢᏚᎢᏙᎳᏃ"),
}
# Latin letters that look like plain ones, and hyphens that look like the plain one.
PLAIN = {"ɑ": "a", "ɡ": "g", "‐": "-", "‑": "-"}
# Kinds of compatibility forms that show the plain characters.
SAME_LOOK = {"<wide>", "<narrow>", "<noBreak>", "<font>", "<initial>", "<medial>", "<final>", "<isolated>", "<compat>"}
# Format characters that are visible, and characters outside that class that are not.
VISIBLE = {0x0600, 0x0601, 0x0602, 0x0603, 0x0604, 0x0605, 0x06DD, 0x070F, 0x08E2, 0x110BD, 0x110CD}
INVISIBLE = {0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0} | set(range(0x180B, 0x1810)) | set(range(0xFE00, 0xFE10))
# Line ends besides the line feed.
LINE_ENDS = "\r\v\f\x85  "

#: The order of choice among scripts.
SCRIPTS = ("LATIN", *SHAPES)


def _fold(code: int) -> str:
    char = chr(code)
    if char == "\n":
        return char
    if char in LINE_ENDS:
        return "\n"
    kind = unicodedata.category(char)
    if kind == "Zs" or char == "\t":
        return " "
    if code in INVISIBLE or (kind == "Cf" and code not in VISIBLE) or kind == "Cc":
        return ""
    if char in PLAIN:
        return PLAIN[char]
    tag, _, plain = unicodedata.decomposition(char).partition(" ")
    if tag not in SAME_LOOK or 0x2474 <= code <= 0x24FF or char == "ſ":
        return char
    plain = "".join(chr(int(x, 16)) for x in plain.split())
    if plain[0] == " " and len(plain) > 1 or plain[0] == "(" and len(plain) > 1:
        return char  # spacing accents and letters in brackets are signs of their own
    return "".join(_fold(ord(x)) for x in plain)


class _Folds(dict):
    def __missing__(self, code: int) -> str:
        self[code] = value = _fold(code)
        return value


_FOLDS = _Folds()


class _Settled(dict):
    """For each character whether it stays as it is whatever it stands beside, but for composition."""

    def __missing__(self, char: str) -> bool:
        folded = _FOLDS[ord(char)]
        self[char] = value = folded == char and not _FOREIGN.search(unicodedata.normalize("NFD", char))
        return value


_SETTLED = _Settled()
_FOREIGN = re.compile("[\u0370-\u058f\u13a0-\u13ff\u1c80-\u1c8f\u1f00-\u1fff\u2de0-\u2dff\ua640-\ua69f\uab70-\uabbf\u051a-\u051d]")  # any letter of these scripts
_CONTROL = re.compile("[\x00-\t\x0b-\x1f\x7f]")
_TOKEN = re.compile(r"(?:[^\W\d_][\u0300-\u036f]*)+")
_SHAPE_OF = {letter: shape for shapes, own in SHAPES.values() for shape, letter in zip(shapes, own)}
_SPELLED = {"LATIN": {s: s for shapes, _ in SHAPES.values() for s in shapes}} | {script: dict(zip(*pair)) for script, pair in SHAPES.items()}


@lru_cache(maxsize=100_000)
def scripts_of(letter: str) -> frozenset[str] | None:
    """Scripts in which the shape of the letter occurs; None for characters without a script of their own."""
    shape = _SHAPE_OF.get(letter, letter)
    found = frozenset(s for s in SCRIPTS if shape in _SPELLED[s])
    if found:
        return found
    if not letter.isalpha():
        return None
    return frozenset([unicodedata.name(letter, "UNKNOWN").split()[0]])


@lru_cache(maxsize=100_000)
def resolve(token: str) -> tuple[frozenset[str] | None, bool]:
    """The token's resolved script set (None: no letters of any script), and whether its stored letters mix scripts."""
    sets = [s for s in map(scripts_of, token) if s is not None]
    if not sets:
        return None, False
    stored = {unicodedata.name(c, "UNKNOWN").split()[0] for c in token if c.isalpha()}
    return frozenset.intersection(*sets), len(stored & set(SCRIPTS)) > 1


def _spell(token: str, script: str | None) -> str:
    out = []
    for letter in token:
        shape = _SHAPE_OF.get(letter, letter)
        if script:
            out.append(_SPELLED[script].get(shape, letter))
        else:
            out.append(next((_SPELLED[s][shape] for s in SCRIPTS if shape in _SPELLED[s]), letter))
    return "".join(out)


def canonical(text: str) -> tuple[str, int, int]:
    """The consistent form of a text, its tokens of mixed scripts and its whole-script confusables.

    The empty text has the empty form, and so have texts of invisible characters only.
    """
    if text.isascii():
        if not _CONTROL.search(text):
            return text, 0, 0
        return text.replace("\r\n", "\n").translate(_FOLDS), 0, 0
    if all(map(_SETTLED.__getitem__, set(text))):
        return unicodedata.normalize("NFC", text), 0, 0
    # Letters are compared without their marks; these stand apart while tokens are spelled.
    text = unicodedata.normalize("NFD", text.replace("\r\n", "\n").translate(_FOLDS))
    if not _FOREIGN.search(text):
        return unicodedata.normalize("NFC", text), 0, 0
    spans, mixed, whole = [], 0, 0
    for m in _TOKEN.finditer(text):
        bare = _strip_marks(m.group())
        found, mixes = resolve(bare)
        spans.append((m.start(), m.end(), found))
        mixed += mixes
    out, end, before = [], 0, None
    following: list[str | None] = [None] * len(spans)
    after = None
    for i in range(len(spans) - 1, -1, -1):
        following[i] = after
        found = spans[i][2]
        if found and len(found) == 1:
            after = next(iter(found))
    for (start, stop, found), after in zip(spans, following):
        out.append(text[end:start])
        token, end = text[start:stop], stop
        if found is None:
            out.append(token)
        elif len(found) == 1:
            (before,) = found
            out.append(_spell(token, before) if before in _SPELLED else token)
        elif found:
            script = before if before in found else after if after in found else next(s for s in SCRIPTS if s in found)
            spelled = _spell(token, script)
            whole += spelled != token
            out.append(spelled)
        else:
            out.append(_spell(token, None))
    out.append(text[end:])
    return unicodedata.normalize("NFC", "".join(out)), mixed, whole


def _strip_marks(token: str) -> str:
    return "".join(c for c in token if not unicodedata.combining(c))


def look_key(text: str) -> str:
    """A 160-bit key of the consistent form."""
    return hashlib.blake2b(canonical(text)[0].encode("utf-8", "surrogatepass"), digest_size=20).hexdigest()


@F.pandas_udf(T.StringType())
def _key(texts: pd.Series) -> pd.Series:
    return texts.map(look_key, na_action="ignore")


@F.pandas_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("mixed", T.IntegerType()), T.StructField("whole", T.IntegerType())]))
def _form(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([(None, None, None) if t is None else canonical(t) for t in texts], columns=["text", "mixed", "whole"])


def look_key_column(text: Column) -> Column:
    """A key that is equal for texts of the same look; null for null."""
    return _key(text)


def canonical_column(text: Column) -> Column:
    """STRUCT<text, mixed, whole> as of ``canonical``; its fields are null for null."""
    return _form(text)
