"""String predicates: store hints, modules and files, keys of configurations, answers of models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Keys that name a provider, a model or an address of a model endpoint.
PROVIDER_KEYS = ("LLM_PROVIDER", "LLM_DEFAULT_PROVIDER")
MODEL_KEYS = ("LLM_DEFAULT_MODEL", "LLM_MODEL", "LLM_MODEL_NAME", "OPENAI_MODEL", "ANTHROPIC_MODEL", "OLLAMA_MODEL", "DEFAULT_MODEL")
URL_KEYS = ("OLLAMA_BASE_URL", "OLLAMA_HOST", "OPENAI_BASE_URL", "OPENAI_API_BASE", "ANTHROPIC_BASE_URL", "ANTHROPIC_API_BASE", "LLM_BASE_URL", "LLM_API_BASE", "LLM_ENDPOINT")
_KNOWN_SUFFIX = r"(_MODEL|_MODEL_NAME|_BASE_URL|_API_BASE|_ENDPOINT)$"


def literal_match(a: Column, b: Column) -> Column:
    """How surely two hints name one place: 0.6 equal, 0.3 one begins the other, 0.2 one missing, else null."""
    return (
        F.when(a.isNull() & b.isNull(), F.lit(None).cast("double"))
        .when(a.isNull() | b.isNull(), F.lit(0.2))
        .when(a == b, F.lit(0.6))
        .when(a.startswith(b) | b.startswith(a), F.lit(0.3))
    )


def code_context(file_a: Column, file_b: Column, imports_a: Column, imports_b: Column) -> Column:
    """How close two places are: 0.2 same file, 0.3 a shared local import, 0.1 one imports the other's file, else 0."""
    shared = F.coalesce(F.arrays_overlap(imports_a, imports_b), F.lit(False))
    other = F.coalesce(F.array_contains(imports_a, file_b) | F.array_contains(imports_b, file_a), F.lit(False))
    return F.when(file_a == file_b, 0.2).when(shared, 0.3).when(other, 0.1).otherwise(0.0)


def relevant_key(key: Column) -> Column:
    """Whether a configuration key is about a model endpoint."""
    upper = F.upper(key)
    known = PROVIDER_KEYS + MODEL_KEYS + URL_KEYS
    ends = F.lit(False)
    for k in known:
        ends = ends | upper.endswith("_" + k)
    return F.coalesce(upper.isin(*known) | upper.rlike(_KNOWN_SUFFIX) | ends, F.lit(False))


def server_of_path(path: Column) -> Column:
    """The server a file belongs to: the directory after ``servers`` in a path that also has ``mcp``; null if it is a file."""
    parts = F.split(path, "/")
    at = F.array_position(parts, "servers").cast("int")
    name = F.get(parts, at)
    return F.when(F.array_contains(parts, "mcp") & (at > 0) & (at + 1 < F.size(parts)) & ~name.endswith(".py"), name)


def dotted_suffixes(path: Column) -> Column:
    """Every suffix of a dotted name or of a Python path, as dotted names; a trailing ``__init__`` is no segment."""
    name = F.regexp_replace(F.regexp_replace(path, r"\.py$", ""), "/", ".")
    parts = F.split(F.regexp_replace(name, r"\.__init__$", ""), r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.concat_ws(".", F.slice(parts, i, F.size(parts))))


def match_modules(modules: DataFrame, files: DataFrame) -> DataFrame:
    """(module, file): modules whose dotted segments and the file's path segments agree on the shorter of both.

    Two equality joins on exploded suffixes: the module is a suffix of the file, or the file one of the module.
    """
    whole = F.get(dotted_suffixes(F.col("file")), F.lit(0))
    tails = files.select("file", F.explode(dotted_suffixes(F.col("file"))).alias("k"))
    heads = files.select("file", whole.alias("k"))
    own = modules.select("module", F.get(dotted_suffixes(F.col("module")), F.lit(0)).alias("k"))
    parts = modules.select("module", F.explode(dotted_suffixes(F.col("module"))).alias("k"))
    return own.join(tails, "k").select("module", "file").union(parts.join(heads, "k").select("module", "file")).distinct()


def env_lines(rows: DataFrame, text: str, *keep: str) -> DataFrame:
    """(keep, line, key, value) of the ``KEY=value`` lines of a text; quotes around values are dropped, comments passed."""
    lines = rows.select(*keep, F.posexplode(F.split(F.col(text), r"\r?\n")).alias("line", "t"))
    pattern = r"^\s*(?:export\s+)?([A-Za-z_][A-Za-z0-9_]*)\s*=\s*(.*?)\s*$"
    found = lines.filter(F.col("t").rlike(pattern) & ~F.col("t").rlike(r"^\s*#"))
    return found.select(*keep, "line", F.regexp_extract("t", pattern, 1).alias("key"), F.regexp_replace(F.regexp_extract("t", pattern, 2), "^([\"'])(.*)\\1$", "$2").alias("value"))


def answer_json(text: Column) -> Column:
    """The JSON object in a model's answer: the text without a code fence, else its outermost braces; null if neither is."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(F.trim(text), r"^```[a-zA-Z]*\s*", ""), r"\s*```$", ""))
    braces = F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit(""))

    def valid(x: Column) -> Column:  # inside an array, text after the object is an error as well
        return F.try_parse_json(F.concat(F.lit("["), x, F.lit("]"))).isNotNull()

    return F.coalesce(F.when(valid(bare) & bare.startswith("{"), bare), F.when(valid(braces), braces))


def normal_vote(answer: Column) -> Column:
    """A model's answer as STRUCT<exploitable, confidence, timeout>: what is no real boolean counts as no answer, a
    confidence is kept between 0 and 1."""
    v = F.try_parse_json(answer)
    flag = F.get_json_object(answer, "$.exploitable")
    real = F.schema_of_variant(F.try_variant_get(v, "$.exploitable", "variant")) == "BOOLEAN"
    yes = F.when(F.coalesce(real, F.lit(False)), flag == "true")
    confidence = F.coalesce(F.try_variant_get(v, "$.confidence", "double"), F.lit(0.0))
    return F.struct(yes.alias("exploitable"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), confidence)).alias("confidence"), yes.isNull().alias("timeout"))
