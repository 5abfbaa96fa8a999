"""Whether a text is syntactically valid in its language."""

from __future__ import annotations

import ast
import json
import tomllib
import warnings

from . import deep, golang, java, script, shell, yaml
from .base import Bad, TooDeep

# The language of a path by extension, for the languages that are judged.
BY_EXTENSION = {".py": "python", ".pyi": "python", ".ts": "typescript", ".tsx": "typescript", ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript", ".cjs": "javascript", ".go": "go", ".java": "java", ".sh": "shell", ".bash": "shell", ".yaml": "yaml", ".yml": "yaml", ".json": "json", ".toml": "toml"}
JUDGED = ("python", "javascript", "typescript", "go", "java", "json", "yaml", "toml", "shell")


def _constant(name: str):
    raise ValueError(name)


def fault(language: str, content: bytes, path: str = "") -> str | None:
    """Why the content is not valid in the language; None if it is, or if the language is not judged.

    A byte order mark, CRLF line ends and a missing last line end are no fault. Texts that are not UTF-8 are one, except
    for shell, and for python with a declared encoding. What nests too deeply for a plain pass is read again with room for
    ``DEEPEST`` levels (JSON: any); deeper texts, which no compiler reads, are not valid. Python is as deep as its own parser.
    """
    if language not in JUDGED:
        return None
    try:
        if language == "python":
            try:
                with warnings.catch_warnings():
                    warnings.simplefilter("ignore")
                    ast.parse(content)
            except (RecursionError, MemoryError):
                deep.check_python(content)
            return None
        try:
            text = content.decode("utf-8-sig")
        except UnicodeDecodeError as e:
            if language != "shell":
                return f"not UTF-8: {e.reason}"
            text = content.decode("latin-1")
        try:
            _check(language, text, path)
        except (TooDeep, RecursionError, MemoryError):
            if language == "json":
                deep.check_json(text)
            else:
                deep.with_room(lambda: _check(language, text, path))
        return None
    except (TooDeep, RecursionError, MemoryError):
        return "too deep"
    except Bad as e:
        return str(e)[:200]
    except (SyntaxError, ValueError) as e:
        return str(e)[:200]


def _check(language: str, text: str, path: str) -> None:
    if language == "json":
        json.loads(text, parse_constant=_constant)
    elif language == "toml":
        tomllib.loads(text)
    elif language == "yaml":
        yaml.check(text)
    elif language == "go":
        golang.check(text)
    elif language == "java":
        java.check(text)
    elif language == "shell":
        shell.check(text)
    else:
        script.check(text, language == "typescript", path.lower().endswith((".jsx", ".tsx")) or language == "javascript")
