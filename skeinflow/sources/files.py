"""Scans of source trees: the manifest of kept files, skipped ones with their reasons, and endpoint configurations."""

from __future__ import annotations

import json
import os
import re
import tomllib
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..session import cut_lineage
from . import block_yaml

# What a scan passes by, and what it calls the languages of the files it keeps.
EXCLUDED_DIRS = (
    ".git", ".hg", ".svn", "node_modules", "__pycache__", ".pytest_cache", ".mypy_cache", ".ruff_cache", ".venv", "venv", "env", "dist", "build",
    ".eggs", ".idea", ".vscode", ".ast-cache", ".tree-sitter-cache",
)
EXCLUDED_EXTENSIONS = (
    ".pyc", ".pyo", ".so", ".dylib", ".dll", ".o", ".a", ".jpg", ".jpeg", ".png", ".gif", ".webp", ".svg", ".ico", ".bmp", ".tiff", ".mp3", ".mp4",
    ".mov", ".avi", ".webm", ".wav", ".zip", ".tar", ".gz", ".bz2", ".xz", ".7z", ".rar", ".pdf", ".doc", ".docx", ".xls", ".xlsx", ".ppt", ".pptx",
    ".woff", ".woff2", ".ttf", ".eot", ".db", ".sqlite", ".sqlite3", ".html", ".htm", ".css", ".scss", ".sass", ".less", ".lock",
)
ALLOWED_HIDDEN = (".env", ".gitignore", ".dockerignore")
LARGEST = 10 * 1024 * 1024
LANGUAGES = {
    ".py": "python", ".pyi": "python", ".ts": "typescript", ".tsx": "typescript", ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript",
    ".cjs": "javascript", ".go": "go", ".rs": "rust", ".java": "java", ".kt": "kotlin", ".kts": "kotlin", ".scala": "scala", ".rb": "ruby",
    ".php": "php", ".cs": "csharp", ".swift": "swift", ".c": "c", ".h": "c", ".cc": "cpp", ".cpp": "cpp", ".cxx": "cpp", ".hpp": "cpp",
    ".sh": "shell", ".bash": "shell", ".mako": "mako", ".yaml": "yaml", ".yml": "yaml", ".json": "json", ".toml": "toml", ".ini": "ini",
    ".env": "dotenv", ".sql": "sql", ".md": "markdown",
}
NAMES = {"Dockerfile": "dockerfile", "dockerfile": "dockerfile", "Makefile": "makefile", "makefile": "makefile", ".env": "dotenv", ".gitignore": "gitignore", ".dockerignore": "dockerignore", "README": "markdown"}


def _map(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def extension(name: Column) -> Column:
    """The lower-case extension of a file name, dot included; empty without one (a leading dot begins none)."""
    return F.lower(F.regexp_extract(name, r"[^.](\.[^.]+)$", 1))


def language(path: Column) -> Column:
    """By extension, then by exact file name, else null."""
    name = F.substring_index(path, "/", -1)
    return F.coalesce(F.element_at(_map(LANGUAGES), extension(name)), F.element_at(_map(NAMES), name))


def skip_reason(path: Column, size: Column) -> Column:
    """Why a scan passes the file by; null if it keeps it."""
    parts = F.split(path, "/")
    dirs, name = F.slice(parts, 1, F.size(parts) - 1), F.element_at(parts, -1)
    pruned = F.arrays_overlap(dirs, F.array(*[F.lit(d) for d in EXCLUDED_DIRS])) | F.exists(dirs, lambda d: d.startswith("."))
    return (
        F.when(pruned, "excluded directory")
        .when(name.startswith(".") & ~name.isin(*ALLOWED_HIDDEN), "hidden file")
        .when(extension(name).isin(*EXCLUDED_EXTENSIONS), F.concat(F.lit("excluded extension: "), extension(name)))
        .when(size > LARGEST, F.concat(F.lit("file too large: "), size.cast("string"), F.lit(" bytes")))
    )


def _listing(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    from pyarrow import fs

    for pdf in batches:
        rows = []
        for uri in pdf["uri"]:
            system, name, prefix = _system(uri)
            for f in system.get_file_info(fs.FileSelector(name, recursive=False)):
                link = uri.startswith("file:") and os.path.islink(f.path)
                if not link and f.type in (fs.FileType.File, fs.FileType.Directory):
                    rows.append((prefix + f.path, f.type == fs.FileType.Directory, f.size if f.type == fs.FileType.File else None))
        yield pd.DataFrame(rows, columns=["uri", "is_dir", "size"])


def _system(uri: str):
    """(file system, its path, what makes it a URI again)."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/"), "file:"
    system, name = fs.FileSystem.from_uri(uri)
    return system, name, uri[: len(uri) - len(name)]


def _listed(spark: SparkSession, root: str) -> DataFrame:
    """(uri, path, size) of all files under a root, links not followed.

    Spark's own file sources pass over names that begin with a dot or an underscore, package initialisers among them, so
    directories are listed here: a level of the tree at a time, by the executors, and excluded directories are passed by
    without a word. Only whether a level is left reaches the driver.
    """
    uri = root if re.match(r"^[a-z][a-z0-9+.-]*:", root) else "file:" + os.path.abspath(root)
    base = uri.rstrip("/") + "/"
    base = "file:/" + base.removeprefix("file:").lstrip("/") if base.startswith("file:") else base
    level = spark.createDataFrame([(base.rstrip("/"),)], "uri string")
    found = []
    relative = F.substring("uri", F.lit(len(base) + 1), F.length("uri"))
    while True:
        listed = cut_lineage(level.repartition(F.xxhash64("uri")).mapInPandas(_listing, "uri string, is_dir boolean, size bigint").select("uri", "is_dir", "size", relative.alias("path")))
        name = F.substring_index("path", "/", -1)
        pruned = F.col("is_dir") & (name.isin(*EXCLUDED_DIRS) | name.startswith("."))
        found.append(listed.filter(~F.col("is_dir")).select("uri", "path", "size"))
        level = listed.filter(F.col("is_dir") & ~pruned).select("uri")
        if level.isEmpty():
            return reduce(DataFrame.unionByName, found)


def _contents(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for uri in pdf["uri"]:
            system, name, _ = _system(uri)
            with system.open_input_file(name) as f:
                out.append(f.read())
        yield pd.DataFrame({"path": pdf["path"], "language": pdf["language"], "content": out})


def scan(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """(files, skipped) of a directory tree: (path, language, content, content_hash, size) and (path, reason).

    Paths are relative to ``root``. Files that are passed by are never opened.
    """
    named = _listed(spark, root).withColumn("reason", skip_reason(F.col("path"), F.col("size")))
    kept = named.filter("reason is null").select("uri", "path", language(F.col("path")).alias("language"))
    read = kept.repartition(F.xxhash64("path")).mapInPandas(_contents, "path string, language string, content binary")
    files = read.select("path", "language", "content", F.sha2("content", 256).alias("content_hash"), F.octet_length("content").cast("bigint").alias("size"))
    return files, named.filter("reason is not null").select("path", "reason")


def manifest(files: DataFrame, language: str | None = None) -> DataFrame:
    """(language, n, bytes) of the files of a manifest, or the files of one language."""
    if language is not None:
        return files.filter(F.lower(F.trim("language")) == language)
    return files.groupBy(F.coalesce(F.lower(F.trim("language")), F.lit("")).alias("language")).agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))


def _flatten(value, prefix: str, out: list) -> None:
    if isinstance(value, dict):
        for k, v in value.items():
            _flatten(v, f"{prefix}_{k}" if prefix else str(k), out)
    elif isinstance(value, list):
        for v in value:
            _flatten(v, prefix, out)
    elif value is not None:
        out.append((prefix.upper(), str(value)))


def _structured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for path, lang, content in zip(pdf["path"], pdf["language"], pdf["content"]):
            found: list = []
            try:
                body = bytes(content).decode("utf-8-sig")
                _flatten({"json": json.loads, "toml": tomllib.loads, "yaml": block_yaml.load}[lang](body), "", found)
            except (ValueError, RecursionError):
                found = []
            rows += [(path, i, k, v) for i, (k, v) in enumerate(found)]
        yield pd.DataFrame(rows, columns=["path", "line", "key", "value"])


def config_keys(files: DataFrame) -> DataFrame:
    """(path, line, key, value) of endpoint keys in env files, Python constants, YAML, JSON and TOML files.

    Files that do not parse give none. Nested keys are joined by underscores and upper-cased.
    """
    lines = files.filter("language in ('dotenv', 'python') and content is not null").select("path", F.decode("content", "UTF-8").alias("t"))
    plain = tx.env_lines(lines, "t", "path").select("path", "line", "key", "value")
    nested = files.filter("language in ('json', 'toml', 'yaml') and content is not null").select("path", "language", "content").mapInPandas(_structured, "path string, line int, key string, value string")
    return plain.unionByName(nested).filter(tx.relevant_key(F.col("key")))


def endpoints(keys: DataFrame) -> DataFrame:
    """(provider, model, base_url, path, raw_keys): one endpoint per file that names any of the three, then one per triple.

    The first provider key wins, else the provider that a key's name begins with; exact model and address keys win over
    keys that end like one. Of equal endpoints the first path stands, and raw keys are merged in the order of paths, later ones winning.
    """
    upper = F.upper("key")
    at = F.struct((~upper.isin(*tx.MODEL_KEYS)).alias("x"), "line")
    url_at = F.struct((~upper.isin(*tx.URL_KEYS)).alias("x"), "line")
    is_model, is_url = upper.rlike("(_MODEL|_MODEL_NAME)$"), upper.rlike("(_BASE_URL|_API_BASE|_ENDPOINT|_HOST)$")
    implied = F.lower(F.regexp_extract(upper, "^(OPENAI|ANTHROPIC|OLLAMA)_", 1))
    per = keys.groupBy("path").agg(
        F.min_by("value", F.when(upper.isin(*tx.PROVIDER_KEYS), F.col("line"))).alias("named"),
        F.min_by(implied, F.when(implied != "", F.col("line"))).alias("implied"),
        F.min_by("value", F.when(is_model, at)).alias("model"),
        F.min_by("value", F.when(is_url, url_at)).alias("base_url"),
        F.map_from_entries(F.array_sort(F.collect_set(F.struct("key", "value")))).alias("raw_keys"),
    )
    found = per.withColumn("provider", F.coalesce("named", "implied")).filter("provider is not null or model is not null or base_url is not null")
    return found.groupBy("provider", "model", "base_url").agg(F.min("path").alias("path"), F.map_from_entries(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("path", F.map_entries("raw_keys").alias("e")))), lambda x: x["e"]))).alias("raw_keys"))
