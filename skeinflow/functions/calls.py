"""Call shapes: which capabilities a dotted call target has evidence for."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Call shapes by capability (with the type of an untrusted source behind a slash), as verbs by qualifier; ``*``
# stands for any qualifier, a verb with a trailing ``*`` for all verbs that begin with it, a qualifier with a trailing ``_*``
# for itself and its underscore compounds.
RULES = {
    "executes_code": {
        "subprocess": ("run", "call", "Popen", "check_output", "check_call"),
        "os": ("system", "popen", "execv", "execve", "spawnv"),
        "*": ("eval", "exec", "compile"),
        "pickle": ("loads",),
        "marshal": ("loads",),
        "yaml": ("unsafe_load",),
        "shell": ("run", "execute", "exec"),
        "adapter": ("run", "execute", "exec", "spawn"),
    },
    "executes_shell": {
        "os": ("system", "popen"),
    },
    "executes_shell_if_asked": {
        "subprocess": ("run", "Popen", "call"),
    },
    "reads_filesystem": {
        "*": ("open",),
        "io": ("open",),
        "pathlib.Path": ("read_text", "read_bytes", "open"),
        "os": ("read",),
        "shutil": ("copy", "copytree"),
    },
    "writes_filesystem": {
        "pathlib.Path": ("write_text", "write_bytes"),
        "os": ("write", "remove", "unlink", "rmdir", "makedirs"),
        "shutil": ("move", "rmtree"),
    },
    "db_statement": {
        "cursor": ("execute",),
        "connection": ("execute",),
        "session": ("execute",),
        "engine": ("execute",),
        "cur": ("execute", "executemany"),
        "*": ("text",),
    },
    "reads_db": {
        "db": ("query", "get", "get*", "find*", "list*", "filter*", "all*"),
        "session": ("query", "get", "get*", "find*", "list*", "filter*", "all*"),
        "repository": ("get", "find", "list", "filter", "all", "get*", "find*", "list*", "filter*", "all*"),
        "repo": ("get", "find", "list", "filter", "all", "get*", "find*", "list*", "filter*", "all*"),
        "cur": ("fetchone", "fetchall", "fetchmany"),
        "cursor": ("fetchone", "fetchall", "fetchmany"),
    },
    "writes_db": {
        "db": ("add", "add_all", "delete", "commit", "flush", "merge", "bulk_save_objects", "bulk_insert_mappings", "add*", "delete*", "save*", "create*", "update*"),
        "session": ("add", "add_all", "delete", "commit", "flush", "merge", "bulk_save_objects", "bulk_insert_mappings", "add*", "delete*", "save*", "create*", "update*"),
        "repository": ("add", "delete", "save", "create", "update", "add*", "delete*", "save*", "create*", "update*"),
        "repo": ("add", "delete", "save", "create", "update", "add*", "delete*", "save*", "create*", "update*"),
    },
    "commit": {
        "db": ("commit",),
        "session": ("commit",),
        "repository": ("commit",),
        "repo": ("commit",),
        "transaction": ("commit",),
        "connection": ("commit",),
        "conn": ("commit",),
    },
    "http_egress": {
        "requests": ("get", "post", "put", "patch", "delete", "head", "request"),
        "httpx": ("get", "post", "put", "delete", "request"),
        "aiohttp": ("ClientSession",),
        "urllib.request": ("urlopen", "Request"),
        "client": ("post", "put", "patch", "delete"),
        "adapter": ("post", "put", "patch"),
        "session": ("post", "put", "patch", "request"),
    },
    "reads_env": {
        "os": ("environ", "getenv", "environb"),
        "os.environ": ("get",),
    },
    "calls_llm": {
        "openai.chat.completions": ("create",),
        "openai.Completion": ("create",),
        "anthropic.messages": ("create",),
        "ollama": ("chat", "generate"),
        "litellm": ("completion", "acompletion"),
        "langchain.chat_models": ("ChatOpenAI",),
        "langchain.llms": ("Ollama",),
        "llama_cpp": ("Llama",),
        "vllm": ("LLM",),
        "llm_*": ("invoke", "chat", "complete", "generate"),
        "model_*": ("invoke", "chat", "complete", "generate"),
    },
    "invokes_mcp_tool": {
        "session": ("call_tool",),
        "client": ("call_tool",),
        "mcp_client": ("call_tool",),
        "server": ("call_tool",),
        "fastmcp.client": ("call_tool",),
    },
    "reads_untrusted/rag_corpus": {
        "retriever": ("get_relevant_documents", "invoke"),
        "vectorstore": ("similarity_search", "similarity_search_with_score"),
        "vector_store": ("similarity_search",),
        "collection": ("query", "search"),
    },
    "reads_untrusted/mcp_tool_description": {
        "client": ("list_tools",),
        "server": ("list_tools",),
        "mcp": ("list_tools",),
        "mcp_client": ("list_tools",),
    },
    "reads_untrusted/email_inbox": {
        "imaplib": ("IMAP4", "IMAP4_SSL", "IMAP4_stream"),
        "imap": ("search", "fetch", "uid"),
        "mailbox": ("get_message", "get_messages"),
    },
    "writes_rag_corpus/rag_corpus": {
        "vectorstore": ("add_documents", "add_texts", "upsert", "index"),
        "vector_store": ("add_documents", "add_texts"),
        "collection": ("add", "upsert", "insert"),
    },
    "writes_email_inbox/email_inbox": {
        "smtp": ("send", "sendmail", "send_message"),
        "SMTP": ("sendmail", "send_message"),
        "imap": ("append",),
        "mailbox": ("add", "put"),
    },
}
# Words of secret environment keys, and the keywords that make a statement a write or a read.
SECRET_WORDS = ("KEY", "TOKEN", "SECRET", "PASSWORD", "PASSWD", "CREDENTIAL", "API_KEY", "ACCESS_KEY", "PRIVATE_KEY")
WRITE_WORDS = ("INSERT", "UPDATE", "DELETE", "DROP", "CREATE", "ALTER", "TRUNCATE", "REPLACE")
READ_WORDS = ("SELECT", "PRAGMA", "EXPLAIN")
#: Capabilities that route to others and never describe a node themselves.
ROUTING = ("db_statement", "commit", "executes_shell_if_asked")


def parse_rules(rules: dict[str, dict[str, tuple[str, ...]]] = RULES) -> list[tuple[int, str, str | None, str | None, str, bool, bool]]:
    """(ord, capability, source_type, qualifier, verb, verb_family, qualifier_family) of every shape, in order."""
    out = []
    for head, groups in rules.items():
        capability, _, source_type = head.partition("/")
        for qualifier, verbs in groups.items():
            name = None if qualifier == "*" else qualifier.removesuffix("_*")
            for verb in verbs:
                out.append((len(out), capability, source_type or None, name, verb.removesuffix("*"), verb.endswith("*"), qualifier.endswith("_*")))
    return out


def render_rules(shapes: list[tuple[int, str, str | None, str | None, str, bool, bool]]) -> dict[str, dict[str, tuple[str, ...]]]:
    """The rules that ``parse_rules`` reads as these shapes."""
    out: dict[str, dict[str, tuple[str, ...]]] = {}
    for _, capability, source_type, qualifier, verb, verb_family, qualifier_family in shapes:
        head = f"{capability}/{source_type}" if source_type else capability
        name = "*" if qualifier is None else qualifier + "_*" * qualifier_family
        own = out.setdefault(head, {})
        own[name] = (*own.get(name, ()), verb + "*" * verb_family)
    return out


@lru_cache(maxsize=1)
def _shapes_by_verb() -> tuple[dict[str, list[tuple]], list[tuple]]:
    exact: dict[str, list[tuple]] = {}
    families = []
    for shape in parse_rules():
        if shape[5]:
            families.append(shape)
        else:
            exact.setdefault(shape[4], []).append(shape)
    return exact, families


@lru_cache(maxsize=100_000)
def shown_by(target: str) -> frozenset[str]:
    """The capabilities whose shapes a dotted target has: ``matches`` for one target, where a parse needs it."""
    *before, last = target.split(".")
    exact, families = _shapes_by_verb()
    out = set()
    for _, capability, _, qualifier, verb, _, qualifier_family in [*exact.get(last, ()), *(f for f in families if last.startswith(f[4]))]:
        if qualifier is None:
            out.add(capability)
        elif before and qualifier_family:
            handle = before[-1].lstrip("_")
            if handle == qualifier or handle.startswith(qualifier + "_"):
                out.add(capability)
        else:
            tail = before[-len(qualifier.split(".")) :] if len(before) >= len(qualifier.split(".")) else []
            if tail and ".".join([tail[0].lstrip("_"), *tail[1:]]) == qualifier:
                out.add(capability)
    return frozenset(out)


def dangerous(target: str, text: str | None, mode: str | None, shell: bool) -> bool:
    """Whether a call shows a capability of sinks, by the precedence of ``call_capabilities``."""
    shown = shown_by(target)
    if shown & {"executes_code", "executes_shell", "writes_filesystem", "writes_db", "http_egress"} or shell and "executes_shell_if_asked" in shown:
        return True
    if target == "open" and set(mode or "") & set("wax+"):
        return True
    return "db_statement" in shown and text is not None and any(w in text.upper() for w in WRITE_WORDS)


def rule_table(spark: SparkSession, rules: dict[str, dict[str, tuple[str, ...]]] = RULES) -> DataFrame:
    """The shapes as a frame; its size is that of the rules."""
    return spark.createDataFrame(parse_rules(rules), "rule_ord int, capability string, source_type string, qualifier string, verb string, verb_family boolean, qualifier_family boolean")


def matches(target: Column, qualifier: Column, verb: Column, verb_family: Column, qualifier_family: Column) -> Column:
    """Whether a dotted target has a shape: the last segment is the verb (or begins with it) and the segments before end
    with the qualifier's, leading underscores of the first compared one aside. Null targets match nothing."""
    last = F.substring_index(target, ".", -1)
    # What stands before the last segment, with as many segments as the qualifier has.
    depth = F.size(F.split(qualifier, r"\."))
    parts = F.split(target, r"\.")
    n = F.size(parts)
    tail = F.when(n > depth, F.slice(parts, n - depth, depth))
    first = F.regexp_replace(F.get(tail, F.lit(0)), "^_+", "")
    rest = F.concat_ws(".", F.array_compact(F.concat(F.array(first), F.slice(tail, 2, F.greatest(F.size(tail) - 1, F.lit(0))))))
    handle = F.regexp_replace(F.get(parts, n - 2), "^_+", "")
    named = F.when(qualifier_family, (handle == qualifier) | handle.startswith(F.concat(qualifier, F.lit("_")))).otherwise(rest == qualifier)
    return F.coalesce(F.when(qualifier.isNull(), last == verb).otherwise((n >= 2) & F.when(verb_family, last.startswith(verb)).otherwise(last == verb) & named), F.lit(False))


def evidence(calls: DataFrame, rules: DataFrame, target: str = "target") -> DataFrame:
    """``calls`` with (rule_ord, capability, source_type) for every shape its target has.

    Verbs are joined by equality on every prefix-free verb and on the first two letters of verb families, so no pair of a
    call and a foreign verb is ever compared; the rules are a fixed table and broadcast.
    """
    with_verb = calls.withColumn("_last", F.substring_index(target, ".", -1))
    exact = rules.filter("not verb_family")
    family = rules.filter("verb_family")
    condition = matches(F.col(target), F.col("qualifier"), F.col("verb"), F.col("verb_family"), F.col("qualifier_family"))
    columns = [*calls.columns, "rule_ord", "capability", "source_type"]
    a = with_verb.join(F.broadcast(exact), F.col("_last") == F.col("verb")).filter(condition).select(*columns)
    b = with_verb.join(F.broadcast(family.withColumn("_two", F.substring("verb", 1, 2))), F.substring("_last", 1, 2) == F.col("_two")).filter(condition).select(*columns)
    return a.unionByName(b)


def first_source(evidence_rows: DataFrame, capability: str, key: list[str]) -> DataFrame:
    """(key, source_type): the family of the first shape of the capability each call has."""
    return evidence_rows.filter(F.col("capability") == capability).groupBy(*key).agg(F.min_by("source_type", "rule_ord").alias("source_type"))


def _holds(text: Column, words: tuple[str, ...]) -> Column:
    upper = F.upper(text)
    out = F.lit(False)
    for w in words:
        out = out | upper.contains(w)
    return F.coalesce(out, F.lit(False))


def secret_key(key: Column) -> Column:
    return _holds(key, SECRET_WORDS)


def statement_direction(text: Column) -> Column:
    """``write`` or ``read`` by the keywords anywhere in a statement, writes first; other texts read; null for null."""
    return F.when(text.isNull(), F.lit(None)).when(_holds(text, WRITE_WORDS), "write").otherwise("read")


def writes_in_mode(mode: Column) -> Column:
    """Whether the literal mode of a bare ``open`` writes. For capabilities a mode that is no literal, or none, reads; where the
    sides of a store are asked for, ``operators.sites.mode_sides`` says neither."""
    return F.coalesce(mode.rlike("[wax+]"), F.lit(False))


def call_capabilities(calls: DataFrame, rules: DataFrame) -> DataFrame:
    """(call columns, capability): what each call shows, by the order of precedence of the rules.

    ``calls`` has target, first_str_arg, open_mode, shell_true. Shell by definition comes before shell on request; the bare
    ``open`` reads or writes by its mode; an ORM write beats a statement, whose text then decides; an ORM read counts where
    there is no text; reading a secret environment key counts as both.
    """
    key = calls.columns
    got = evidence(calls, rules).groupBy(*key).agg(F.collect_set("capability").alias("caps"))

    def has(c: str) -> Column:
        return F.array_contains("caps", c)

    text = F.col("first_str_arg")
    statement = has("db_statement") & ~has("writes_db")
    direction = statement_direction(text)
    bare_open = F.col("target") == "open"
    shell = has("executes_shell") | (has("executes_shell_if_asked") & F.coalesce(F.col("shell_true"), F.lit(False)))
    decided = F.array_compact(
        F.array(
            F.when(has("executes_code"), "executes_code"),
            F.when(shell, "executes_shell"),
            F.when(bare_open & writes_in_mode(F.col("open_mode")), "writes_filesystem").when(has("reads_filesystem"), "reads_filesystem"),
            F.when(has("writes_filesystem"), "writes_filesystem"),
            F.when(has("writes_db") | (statement & (direction == "write")), "writes_db"),
            F.when((statement & (F.coalesce(direction, F.lit("read")) == "read") & text.isNotNull()) | (has("reads_db") & text.isNull()), "reads_db"),
            F.when(has("http_egress"), "http_egress"),
            F.when(has("reads_env"), "reads_env"),
            F.when(has("reads_env") & secret_key(text), "reads_secrets"),
            F.when(has("calls_llm"), "calls_llm"),
            F.when(has("invokes_mcp_tool"), "invokes_mcp_tool"),
            F.when(has("reads_untrusted"), "reads_untrusted"),
            F.when(has("writes_rag_corpus"), "writes_rag_corpus"),
            F.when(has("writes_email_inbox"), "writes_email_inbox"),
        )
    )
    return got.select(*key, F.explode(F.array_distinct(decided)).alias("capability"))
