"""Symbols of the languages that are not parsed here: classes and functions by the lines that begin them, in built-in expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_NAME = r"([A-Za-z_$][A-Za-z0-9_$]*)"
_MARKS = r"(?:(?:public|private|protected|internal|abstract|final|static|sealed|open|data|case|partial|export|default|async|override|virtual)[ \t]+)*"
_TYPE = rf"^[ \t]*{_MARKS}(?:class|interface|enum|record|object|trait|struct|protocol)[ \t]+{_NAME}"
_TYPED = rf"^[ \t]+(?:(?:public|private|protected|internal|static|final|abstract|async|override|virtual)[ \t]+)+[A-Za-z0-9_<>,.?\[\] ]+[ \t]{_NAME}[ \t]*\("
#: By language the (kind, pattern) of lines that begin a symbol; the first group is its name.
PATTERNS: dict[str, tuple[tuple[str, str], ...]] = {
    "javascript": (("class", _TYPE), ("function", rf"^[ \t]*{_MARKS}function[ \t]*\*?[ \t]*{_NAME}")),
    "typescript": (("class", _TYPE), ("function", rf"^[ \t]*{_MARKS}function[ \t]*\*?[ \t]*{_NAME}")),
    "go": (("class", rf"^type[ \t]+{_NAME}[ \t]+(?:struct|interface)"), ("function", rf"^func[ \t]+{_NAME}"), ("method", rf"^func[ \t]+\([^)]*\)[ \t]+{_NAME}")),
    "java": (("class", _TYPE), ("method", _TYPED)),
    "csharp": (("class", _TYPE), ("method", _TYPED)),
    "kotlin": (("class", _TYPE), ("function", rf"^[ \t]*{_MARKS}fun[ \t]+{_NAME}")),
    "scala": (("class", _TYPE), ("function", rf"^[ \t]*{_MARKS}def[ \t]+{_NAME}")),
    "swift": (("class", _TYPE), ("function", rf"^[ \t]*{_MARKS}func[ \t]+{_NAME}")),
    "rust": (("class", rf"^[ \t]*(?:pub[ \t]+)?(?:struct|enum|trait)[ \t]+{_NAME}"), ("function", rf"^[ \t]*(?:pub[ \t]+)?(?:async[ \t]+)?fn[ \t]+{_NAME}")),
    "ruby": (("class", rf"^[ \t]*(?:class|module)[ \t]+{_NAME}"), ("function", rf"^[ \t]*def[ \t]+(?:self\.)?{_NAME}")),
    "php": (("class", _TYPE), ("function", rf"^[ \t]*{_MARKS}function[ \t]+&?{_NAME}")),
    "shell": (("function", rf"^[ \t]*(?:function[ \t]+)?{_NAME}[ \t]*\(\)"),),
}


def line_symbols(files: DataFrame, id: str = "file_id") -> DataFrame:
    """(id, line, kind, name) of the symbols of (id, language, content); texts that are no UTF-8 give none.

    Files, not lines, are what a task reads; each line meets the patterns of its language only.
    """
    lang = F.lower(F.trim("language"))
    texts = files.filter(lang.isin(*PATTERNS) & F.col("content").isNotNull()).select(id, lang.alias("lang"), F.col("content").cast("string").alias("t")).filter(F.is_valid_utf8("t"))
    lines = texts.select(id, "lang", F.posexplode(F.split("t", r"\r?\n")).alias("n", "l"))
    by_kind = []
    for kind in ("class", "function", "method"):
        own = F.lit("")
        for language, patterns in PATTERNS.items():
            for k, pattern in patterns:
                if k == kind:
                    own = F.when(F.col("lang") == language, F.regexp_extract("l", pattern, 1)).otherwise(own)
        by_kind.append(F.struct(F.lit(kind).alias("kind"), own.alias("name")))
    found = F.filter(F.array(*by_kind), lambda s: s["name"] != "")
    return lines.select(id, (F.col("n") + 1).alias("line"), F.explode(found).alias("s")).select(id, "line", "s.kind", "s.name")
