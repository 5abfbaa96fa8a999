"""Building the graph from source facts: classified symbols, entry points, framework components, and the edges between.

Each step is a frame-to-frame transform over ``facts.facts``. Ids are content hashes, so a rebuild of the same sources gives
the same ids, and parallel edges of a kind collapse. Pairs of tools and sinks are made per file by an equality join, as the
edges of a file are what the step returns.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import match_modules, server_of_path
from ..session import cut_lineage
from .closure import closure, inherited
from .facts import call_graph, definition_capabilities, entry_points, server_usages, symbol_calls, symbol_capabilities, symbols
from .graph import SINK_CAPABILITIES, STRUCTURAL_EDGES
from .merge import edge_id, merge_detected
from .scoring import trifecta_hits

# The host of a local scan, names that are no components, and the capabilities that make kinds.
HOST = "localhost"
NO_CLASSES = ("BaseAgent", "BaseDetector", "BaseEvaluator", "BaseRepository")
NO_CLASS_SUFFIX = "(Detector|Evaluator|Schema|Result|Error|Exception|Kind|Envelope|Outcome|Verdict)$"
AGENT_CAPABILITIES = ("calls_llm", "invokes_mcp_tool")
CALLER_CAPABILITIES = (*AGENT_CAPABILITIES, "reads_untrusted")
# Constructors of frameworks, and the provider that a model class's name holds, in order.
AGENT_CALLS = (
    "AgentExecutor", "initialize_agent", "create_react_agent", "create_openai_tools_agent", "create_openai_functions_agent", "create_structured_chat_agent", "create_tool_calling_agent",
    "create_json_chat_agent", "create_xml_agent", "create_self_ask_with_search_agent", "create_conversational_retrieval_agent", "create_agent", "ConversationalChatAgent", "ChatAgent", "ZeroShotAgent",
    "ReActDocstoreAgent", "ReActAgent", "StructuredChatAgent", "OpenAIFunctionsAgent", "OpenAIToolsAgent", "XMLAgent", "SelfAskWithSearchAgent",
)
MODEL_CALLS = (
    "ChatOpenAI", "OpenAI", "AzureChatOpenAI", "ChatAnthropic", "Anthropic", "ChatGoogleGenerativeAI", "ChatVertexAI", "ChatCohere", "ChatMistralAI", "ChatGroq", "ChatBedrock", "ChatFireworks",
    "ChatTogether", "ChatDeepSeek", "Ollama", "OllamaLLM", "ChatOllama", "ChatLiteLLM", "ChatOpenRouter",
)
PROVIDERS = {
    "openai": "openai", "anthropic": "anthropic", "google": "google", "gemini": "google", "vertex": "google", "cohere": "cohere", "mistral": "mistral", "groq": "groq", "bedrock": "aws",
    "fireworks": "fireworks", "together": "together", "deepseek": "deepseek", "ollama": "ollama", "litellm": "litellm", "openrouter": "openrouter",
}

NODE = ["id", "kind", "name", "file", "capabilities", "parent", "line", "framework", "detail", "stage"]
EDGE = ["id", "source_id", "target_id", "kind", "host_id", "flow_kind", "identity_confidence", "via"]


def _id(prefix: Column | str, *parts: Column | str) -> Column:
    prefix = prefix if isinstance(prefix, Column) else F.lit(prefix)
    return F.concat(prefix, F.lit(":"), F.sha2(F.concat_ws(":", prefix, *[p if isinstance(p, Column) else F.lit(p) for p in parts], F.lit(HOST)), 256))


def _last(column: str) -> Column:
    return F.substring_index(column, ".", -1)


def _has(*capabilities: str) -> Column:
    return F.coalesce(F.arrays_overlap("capabilities", F.array(*[F.lit(c) for c in capabilities])), F.lit(False))


def _nodes(rows: DataFrame, **columns) -> DataFrame:
    """Rows as nodes. ``parent`` is the handler of an entry, the class of a method or the server of a tool, ``framework`` what
    detected it, ``detail`` the type of a source, provider or family, ``stage`` the step that made it: of several nodes that a
    name may mean the first step's counts."""
    missing = {"capabilities": F.array().cast("array<string>"), "line": F.lit(None).cast("int"), "stage": F.lit(9)}
    have = {c: columns[c] if c in columns else missing.get(c, F.lit(None).cast("string")) for c in NODE}
    return rows.select(*[have[c].alias(c) for c in NODE])


def edges_of(rows: DataFrame, source: str, target: str, kind: str, confidence: str | None = None, via: Column | str | None = None) -> DataFrame:
    """(EDGE) of the pairs of two columns, each once and none to itself: ``guards`` and links of stores are structural, all
    others control. Of several confidences of one edge the largest stays."""
    real = rows.filter(F.col(source) != F.col(target))
    how = via if isinstance(via, Column) else F.lit(via).cast("string")
    made = real.select(edge_id(F.col(source), F.col(target), F.lit(kind), F.lit(HOST)).alias("id"), F.col(source).alias("source_id"), F.col(target).alias("target_id"), (F.col(confidence) if confidence else F.lit(None).cast("double")).alias("c"), how.alias("v"))
    return made.groupBy("id", "source_id", "target_id").agg(F.max("c").alias("identity_confidence"), F.min("v").alias("via")).select(
        "id", "source_id", "target_id", F.lit(kind).alias("kind"), F.lit(HOST).alias("host_id"), F.lit("structural" if kind in STRUCTURAL_EDGES else "control").alias("flow_kind"), "identity_confidence", "via"
    )


def guardrail_capability(found: DataFrame, definitions: DataFrame, shown: DataFrame) -> DataFrame:
    """(path, name): functions that are no components themselves and are called, by bare name, from one that calls a model or a
    tool or reads untrusted text; they are taken to validate its input."""
    active = F.arrays_overlap("caps", F.array(*[F.lit(c) for c in CALLER_CAPABILITIES]))
    callers = definitions.filter(active).select(F.col("name").alias("caller")).distinct()
    called = call_graph(found).join(callers, "caller", "left_semi").select(F.col("callee").alias("name")).distinct()
    components = shown.filter(F.arrays_overlap("caps", F.array(*[F.lit(c) for c in (*SINK_CAPABILITIES, *AGENT_CAPABILITIES)]))).select("path", "name")
    return symbols(found).filter("kind <> 'class'").select("path", "name").distinct().join(called, "name", "left_semi").join(components, ["path", "name"], "left_anti").select("path", "name")


def credited(shown: DataFrame, validators: DataFrame) -> DataFrame:
    """``shown`` (path, name, caps) with ``validates_input`` for the validators."""
    more = validators.select("path", "name", F.array(F.lit("validates_input")).alias("caps"))
    return shown.unionByName(more).groupBy("path", "name").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("caps")))).alias("caps"))


def class_capabilities(found: DataFrame, definitions: DataFrame) -> DataFrame:
    """(file, name, caps): what the body and the methods of each top-level class show, with its base's own, one level up."""
    top = found.filter("fact = 'class' and flag").select("path", "ord", F.col("target").alias("base"))
    own = definitions.join(top, ["path", "ord"]).groupBy(F.col("path").alias("file"), "name").agg(F.min_by(F.struct("caps", "base"), "ord").alias("d")).select("file", "name", "d.caps", "d.base")
    return inherited(own.select("file", "name", "caps"), own.select("file", "name", "base"))


def symbol_nodes(found: DataFrame, definitions: DataFrame, shown: DataFrame) -> DataFrame:
    """Nodes of classes and functions by what they can do; symbols that show nothing, and excluded names, get none.

    Classes: a sink capability makes a sink, else an agent capability an agent. Functions: a sink capability makes a sink,
    ``validates_input`` without any other a guardrail, an invoked tool or a place below a server directory a tool.
    """
    spans = symbols(found).filter("kind = 'class'").groupBy(F.col("path").alias("file"), "name").agg(F.min("line").alias("line"))
    classes = class_capabilities(found, definitions).withColumnRenamed("caps", "capabilities").join(spans, ["file", "name"])
    kind = F.when(_has(*SINK_CAPABILITIES), "sink").when(_has(*AGENT_CAPABILITIES), "agent")
    of_class = classes.filter(~F.col("name").isin(*NO_CLASSES) & ~F.col("name").rlike(NO_CLASS_SUFFIX)).withColumn("kind", kind).filter("kind is not null")
    a = _nodes(of_class, id=_id(F.col("kind"), F.col("file"), F.col("name")), kind=F.col("kind"), name=F.col("name"), file=F.col("file"), capabilities=F.col("capabilities"), line=F.col("line"), stage=F.lit(1))

    own = shown.select("path", "name", F.col("caps").alias("capabilities"))
    functions = symbols(found).filter("kind <> 'class'").join(own, ["path", "name"], "left").withColumn("capabilities", F.coalesce("capabilities", F.array().cast("array<string>")))
    usable = functions.filter(~F.col("name").startswith("_") & ~(F.col("name").startswith("create_") & F.col("name").endswith("_server")))
    classifying = _has(*SINK_CAPABILITIES, *AGENT_CAPABILITIES)
    kind = F.when(_has(*SINK_CAPABILITIES), "sink").when(_has("validates_input") & ~classifying, "guardrail").when(_has("invokes_mcp_tool") | server_of_path(F.col("path")).isNotNull(), "tool")
    of_function = usable.withColumn("kind", kind).filter("kind is not null")
    parts = [F.col("path"), F.col("name"), F.col("class_name")]
    b = _nodes(of_function, id=_id(F.col("kind"), *parts), kind=F.col("kind"), name=F.col("name"), file=F.col("path"), capabilities=F.col("capabilities"), parent=F.col("class_name"), line=F.col("line"), stage=F.lit(2))
    return _first_of(a.unionByName(b))


def _first_of(nodes: DataFrame) -> DataFrame:
    """One row per id, the first by stage and line."""
    others = [c for c in NODE if c != "id"]
    return nodes.groupBy("id").agg(F.min_by(F.struct(*others), F.struct("stage", "line", "file", "name")).alias("n")).select("id", "n.*").select(*NODE)


def server_nodes(found: DataFrame) -> DataFrame:
    """One node per server directory; its first file stands for it."""
    named = found.select("path").distinct().withColumn("server", server_of_path(F.col("path"))).filter("server is not null").groupBy("server").agg(F.min("path").alias("file"))
    return _nodes(named, id=_id("mcp_server", F.col("server")), kind=F.lit("mcp_server"), name=F.col("server"), file=F.col("file"), stage=F.lit(0))


def entry_nodes(found: DataFrame) -> DataFrame:
    """Nodes of routes, command lines and page widgets, with the handler as ``parent``."""
    entries = entry_points(found)
    what = F.when(F.col("kind") == "http", F.concat_ws(":", "path", "method", F.coalesce(F.nullif("target", F.lit("")), "handler"))).when(F.col("kind") == "cli", F.concat(F.lit("cli:"), F.col("path"))).otherwise(F.concat_ws(":", F.lit("page"), F.col("path"), F.col("target")))
    name = F.when(F.col("kind") == "http", F.concat_ws(" ", "method", "target")).otherwise(F.concat_ws(":", "kind", F.coalesce("target", "path")))
    return _nodes(entries, id=_id("entry_point", what), kind=F.lit("entry_point"), name=name, file=F.col("path"), parent=F.col("handler"), line=F.col("line"), detail=F.col("kind"), stage=F.lit(3)).dropDuplicates(["id"])


def endpoint_nodes(endpoints: DataFrame) -> DataFrame:
    """One node per endpoint configuration of ``sources.files.endpoints``."""
    return _nodes(endpoints, id=_id("llm_endpoint", F.coalesce("provider", F.lit("")), F.coalesce("model", F.lit("")), F.coalesce("base_url", F.lit(""))), kind=F.lit("llm_endpoint"), name=F.concat_ws(":", "provider", "model"), file=F.col("path"))


def _provider(name: Column) -> Column:
    out = F.lit("unknown")
    for hint, provider in reversed(PROVIDERS.items()):
        out = F.when(F.lower(name).contains(hint), provider).otherwise(out)
    return out


def _component(rows: DataFrame, framework: str, kind: Column | str, name: Column, parent: Column | None = None, detail: Column | None = None, capabilities: Column | None = None) -> DataFrame:
    kind = kind if isinstance(kind, Column) else F.lit(kind)
    optional = {k: v for k, v in (("parent", parent), ("detail", detail), ("capabilities", capabilities)) if v is not None}
    return _nodes(rows, id=F.concat(kind, F.lit(":"), F.sha2(F.concat_ws(":", F.lit("framework"), F.lit(framework), kind, F.col("path"), name, F.lit(HOST)), 256)), kind=kind, name=name, file=F.col("path"), line=F.col("line"), framework=F.lit(framework), stage=F.lit(5), **optional)


def _behind(found: DataFrame, pattern: str) -> DataFrame:
    """The facts of the files that import a framework."""
    importing = found.filter((F.col("fact") == "import") & F.col("target").rlike(pattern)).select("path").distinct()
    return found.join(importing, "path", "left_semi")


def _variable() -> Column:
    """What stands before the last dot of a target."""
    return F.expr("left(target, length(target) - length(substring_index(target, '.', -1)) - 1)")


_CHAIN, _GRAPH = r"^langchain([._]|$)", r"^langgraph([._]|$)"


def _steps(found: DataFrame, *verbs: str) -> DataFrame:
    """Calls on the variables of a file that hold a graph of steps."""
    graph = _behind(found, _GRAPH)
    variables = graph.filter((F.col("fact") == "assign") & _last("target").isin("StateGraph", "MessageGraph")).select("path", F.col("name").alias("variable")).distinct()
    return graph.filter(F.col("fact").isin("call", "link") & _last("target").isin(*verbs)).withColumn("variable", _variable()).join(variables, ["path", "variable"], "left_semi")


def _step_kind(name: Column) -> Column:
    like = F.lower(name).isin("tool", "tools", "tool_node", "tools_node") | F.lower(name).rlike("_tools?$")
    return F.when(like, "tool").otherwise("agent")


def framework_nodes(found: DataFrame, definitions: DataFrame) -> DataFrame:
    """Components of agent frameworks, each behind the imports of its framework in the same file.

    Agents, tools and models of chain libraries, steps of graph libraries, servers and their decorated tools, guards, rails,
    callbacks and middleware. A file without the import gives nothing.
    """
    chain, fast, plain = _behind(found, _CHAIN), _behind(found, r"^mcp\.server\.fastmcp"), _behind(found, r"^mcp\.server($|\.)")
    calls = F.col("fact") == "call"
    bodies = definitions.select("path", F.col("ord").cast("string").alias("mode"), "caps")
    tools = chain.filter((F.col("fact") == "decorator") & (_last("target") == "tool")).join(bodies, ["path", "mode"], "left")
    wrapped = chain.filter((F.col("fact") == "assign") & (_last("target").isin("Tool", "StructuredTool") | F.col("target").rlike(r"(^|\.)(Structured)?Tool\.from_function$")))
    parts = [
        _component(chain.filter(calls & _last("target").isin(*AGENT_CALLS)), "langchain", "agent", _last("target")),
        _component(chain.filter(calls & _last("target").isin(*MODEL_CALLS)), "langchain", "llm_endpoint", _last("target"), detail=_provider(_last("target"))),
        _component(tools, "langchain", "tool", F.col("name"), capabilities=F.coalesce("caps", F.array().cast("array<string>")), detail=F.when(F.size("items") > 0, "parameter_match").otherwise("no_args")),
        _component(wrapped.withColumn("shown", F.coalesce("text", "mode", F.substring_index(F.get("items", F.lit(0)), ".", -1), "name")), "langchain", "tool", F.col("shown")),
    ]
    named = _steps(found, "add_node", "add_edge", "add_conditional_edges", "set_entry_point")
    ends = named.filter(calls & F.col("text").isNotNull()).select("path", "text", "line").unionByName(named.filter("fact = 'link'").select("path", F.explode(F.array("name", "text")).alias("text"), "line")).filter("text not in ('__start__', '__end__')")
    parts.append(_component(ends, "langgraph", _step_kind(F.col("text")), F.col("text")))
    for framework, rows, constructor, verb, shown in (("fastmcp", fast, "FastMCP", "tool", ("text", "mode", "name")), ("mcp_python", plain, "Server", "call_tool", ("mode", "text", "name"))):
        servers = rows.filter((F.col("fact") == "assign") & (_last("target") == constructor)).withColumn("server", F.coalesce(*shown))
        parts.append(_component(servers, framework, "mcp_server", F.col("server")))
        served = rows.filter((F.col("fact") == "decorator") & (_last("target") == verb)).withColumn("variable", _variable())
        parts.append(_component(served.join(servers.select("path", F.col("name").alias("variable"), "server"), ["path", "variable"]), framework, "tool", F.col("name"), F.col("server")))
    for framework, pattern, shape, fallback in (("guardrails_ai", r"^guardrails([._]|$)", r"(^|\.)Guard(\.\w+)?$", "Guard"), ("nemo_guardrails", r"^nemoguardrails([._]|$)", r"(^|\.)LLMRails$", "LLMRails")):
        rows = _behind(found, pattern).filter(F.col("target").rlike(shape))
        # A guard is named after the one thing it is assigned to.
        held = rows.filter("fact = 'assign' and flag").groupBy("path", "line").agg(F.min("name").alias("held"))
        guards = rows.filter(calls).join(held, ["path", "line"], "left")
        parts.append(_component(guards, framework, "guardrail", F.coalesce("held", F.lit(fallback))))
    for framework, pattern, base in (("langchain_callback", _CHAIN, "BaseCallbackHandler"), ("fastmcp_middleware", r"^fastmcp([._]|$)", "Middleware")):
        derived = _behind(found, pattern).filter((F.col("fact") == "class") & F.array_join("items", ",").rlike(rf"{base}(,|$)"))
        parts.append(_component(derived, framework, "guardrail", F.col("name")))
    return _first_of(reduce(DataFrame.unionByName, parts))


def framework_edges(found: DataFrame, components: DataFrame) -> DataFrame:
    """Agents to the tools and models they are given, steps of a graph to those they lead to; components of one file only. An
    agent whose tools cannot be told uses all tools of its file."""
    chain = components.filter("framework = 'langchain'")
    agents = chain.filter("kind = 'agent'").select(F.col("id").alias("a"), F.col("file").alias("path"), F.col("name").alias("agent"))
    given = _behind(found, _CHAIN).filter("fact = 'given'").withColumn("agent", _last("target")).join(agents, ["path", "agent"])
    tools = chain.filter("kind = 'tool'").select(F.col("id").alias("t"), F.col("file").alias("path"), "name")
    asked = given.filter("mode = 'tools'")
    by_name = asked.select("path", "a", F.explode("items").alias("name")).join(tools, ["path", "name"])
    unknown = asked.filter(F.size("items") == 0).select("path", "a").join(tools, "path")
    models = chain.filter("kind = 'llm_endpoint'").select(F.col("id").alias("m"), F.col("file").alias("path"), "name")
    used = given.filter("mode = 'model'").select("path", "a", F.explode("items").alias("name")).join(models, ["path", "name"])
    step = components.filter("framework = 'langgraph'").select("id", F.col("file").alias("path"), "name")
    links = _steps(found, "add_edge", "add_conditional_edges").filter("fact = 'link'").select("path", "name", F.col("text").alias("to"))
    leads = links.join(step.withColumnRenamed("id", "s"), ["path", "name"]).join(step.select(F.col("id").alias("e"), "path", F.col("name").alias("to")), ["path", "to"])
    return reduce(DataFrame.unionByName, [edges_of(by_name.select("a", "t").unionByName(unknown.select("a", "t")), "a", "t", "uses_tool"), edges_of(used, "a", "m", "uses_model"), edges_of(leads, "s", "e", "delegates_to")])


def intra_file_edges(nodes: DataFrame) -> DataFrame:
    """Servers provide the tools below their directory, tools of a file have access to its sinks."""
    tools, sinks = nodes.filter("kind = 'tool'"), nodes.filter("kind = 'sink'")
    servers = nodes.filter("kind = 'mcp_server' and framework is null").select(F.col("id").alias("s"), F.col("name").alias("server"))
    provides = tools.select(F.col("id").alias("t"), server_of_path(F.col("file")).alias("server")).join(servers, "server")
    access = tools.select(F.col("id").alias("t"), "file").join(sinks.select(F.col("id").alias("k"), "file"), "file")
    return edges_of(provides, "s", "t", "provides_tool").unionByName(edges_of(access, "t", "k", "has_access_to"))


def _entries(nodes: DataFrame) -> DataFrame:
    """(e, file, handler, detail) of entry points."""
    return nodes.filter("kind = 'entry_point' and parent is not null").select(F.col("id").alias("e"), "file", F.col("parent").alias("handler"), "detail", "line")


def reached_edges(found: DataFrame, nodes: DataFrame) -> DataFrame:
    """Entry points to the sinks of their file whose name the handler reaches over the call graph.

    Handlers are known by name: of several entries with one the last, by file and line, stands for all. Command lines and
    pages reach from every function that calls another and from the modules their file imports; where all of them together
    reach nothing, they are taken to reach every sink.
    """
    graph = call_graph(found)
    entries = _entries(nodes)
    by_name = entries.groupBy("handler").agg(F.max_by("e", F.struct("file", F.coalesce("line", F.lit(0)))).alias("e"))
    sinks = nodes.filter("kind = 'sink'").select(F.col("id").alias("k"), "file", "name")
    named = entries.filter("handler <> '<module>'").select("file", "handler").distinct()
    reach = closure(named.select(F.col("handler").alias("start")), graph.select(F.col("caller").alias("src"), F.col("callee").alias("dst")))
    narrow = named.join(reach, F.col("handler") == F.col("start")).join(sinks, ["file", "name"]).join(by_name, "handler").select("e", "k")
    wide = entries.filter("handler = '<module>'").select("file", "handler").distinct()
    anywhere = graph.select(F.col("caller").alias("name")).union(graph.select("callee")).distinct()
    modules = found.filter("fact = 'import'").select(F.col("path").alias("file"), _last("target").alias("name")).distinct()
    local = sinks.join(wide, "file")
    met = local.join(anywhere, "name", "left_semi").select("handler", "k").union(local.join(modules, ["file", "name"], "left_semi").select("handler", "k")).join(by_name, "handler").select("e", "k")
    some = met.limit(1).select(F.lit("<module>").alias("handler"))
    lost = by_name.filter("handler = '<module>'").join(some, "handler", "left_anti")
    everything = sinks.withColumn("handler", F.lit("<module>")).join(lost, "handler").select("e", "k")
    return edges_of(narrow.union(met), "e", "k", "has_access_to").unionByName(edges_of(everything, "e", "k", "has_access_to", via="cli_fallback"))


def _imported_files(found: DataFrame) -> DataFrame:
    """(file, other): the files that a file's absolute imports may mean."""
    modules = found.filter("fact = 'import'").select(F.col("path").alias("file"), F.col("target").alias("module")).distinct()
    linked = match_modules(modules.select("module").distinct(), found.select(F.col("path").alias("file")).distinct()).select("module", F.col("file").alias("other"))
    return modules.join(linked, "module").filter("file <> other").select("file", "other").distinct()


def delegation_edges(found: DataFrame, nodes: DataFrame) -> DataFrame:
    """Handlers and agents to the agents that their calls mean, and agents to the servers they connect to.

    A call means the agent of its last name in the same file, else in an imported file, else the agent that a function of that
    name in an imported file calls itself; of several the nearest and then the smallest id. A call inside of a handler is the
    entry point's, any other one the first agent's of its file.
    """
    agents = nodes.filter("kind = 'agent'").select(F.col("id").alias("a"), F.col("file").alias("other"), F.col("name").alias("callee"))
    imports = cut_lineage(_imported_files(found))
    calls = cut_lineage(symbol_calls(found).select(F.col("path").alias("file"), "handler", _last("callee").alias("callee")).distinct())
    near = found.select(F.col("path").alias("file"), F.col("path").alias("other")).distinct().withColumn("far", F.lit(0))
    around = near.unionByName(imports.withColumn("far", F.lit(1)))
    direct = calls.join(around, "file").join(agents, ["other", "callee"]).select("file", "handler", "callee", "far", "a")
    inner = calls.select(F.col("file").alias("other"), F.col("handler").alias("callee"), F.col("callee").alias("met"))
    reached = inner.join(around.select(F.col("file").alias("other"), F.col("other").alias("place")), "other").join(agents.select("a", F.col("other").alias("place"), F.col("callee").alias("met")), ["place", "met"]).select("other", "callee", "a").distinct()
    onward = calls.join(imports, "file").join(reached, ["other", "callee"]).select("file", "handler", "callee", F.lit(2).alias("far"), "a")
    targets = direct.unionByName(onward).groupBy("file", "handler", "callee").agg(F.min(F.struct("far", "a"))["a"].alias("a"))
    entries = _entries(nodes).select(F.col("e").alias("s"), "file", "handler")
    own = nodes.filter("kind = 'agent'").groupBy("file").agg(F.min_by("id", F.struct("stage", "line", "id")).alias("s"))
    from_entry = targets.join(entries, ["file", "handler"]).select("s", "a")
    from_agent = targets.join(entries, ["file", "handler"], "left_anti").join(own, "file").select("s", "a")
    classes = symbols(found).filter("kind = 'method'").groupBy(F.col("path").alias("file"), F.col("name").alias("handler")).agg(F.min_by("class_name", "ord").alias("callee"))
    uses = server_usages(found).select(F.col("path").alias("file"), "handler", "server").distinct()
    holder = uses.join(classes, ["file", "handler"], "left").join(agents.select(F.col("a").alias("c"), F.col("other").alias("file"), "callee"), ["file", "callee"], "left").join(own, "file", "left")
    servers = nodes.filter("kind = 'mcp_server' and framework is null").select(F.col("id").alias("v"), F.col("name").alias("server"))
    connects = holder.withColumn("s", F.coalesce("c", "s")).join(servers, "server").select("s", "v")
    return edges_of(from_entry.unionByName(from_agent), "s", "a", "delegates_to", via="call_graph").unionByName(edges_of(connects, "s", "v", "has_access_to"))


def guard_edges(found: DataFrame, nodes: DataFrame) -> DataFrame:
    """Guardrails to the components whose body calls them by name, that they decorate, or whose server they are added to;
    ``via`` has the evidence in order."""
    guards = nodes.filter("kind = 'guardrail'").select(F.col("id").alias("g"), F.col("name").alias("guard"))
    components = nodes.filter("kind in ('agent', 'tool', 'sink')").select(F.col("id").alias("c"), F.col("file").alias("path"), "name")
    called = symbol_calls(found).select("path", F.col("handler").alias("name"), F.split_part("callee", F.lit("."), F.lit(1)).alias("guard"), F.lit("body").alias("how"))
    called = called.unionByName(symbol_calls(found).select("path", F.col("handler").alias("name"), _last("callee").alias("guard"), F.lit("body").alias("how")))
    decorated = found.filter("fact = 'decorator'").select("path", "name", _last("target").alias("guard"), F.lit("decorator").alias("how"))
    by_name = called.unionByName(decorated).distinct().join(guards, "guard").join(components, ["path", "name"]).select("g", "c", "how")
    added = found.filter((F.col("fact") == "call") & (_last("target") == "add_middleware")).select("path", "ord", _variable().alias("variable"), "line")
    made = found.filter("fact = 'call'").select("path", F.col("line"), _last("target").alias("guard"))
    servers = found.filter("fact = 'assign'").select("path", F.col("name").alias("variable"), F.coalesce("text", "mode", "name").alias("server")).distinct()
    tools = nodes.filter("kind = 'tool' and framework is not null and parent is not null").select(F.col("id").alias("c"), F.col("file").alias("path"), F.col("parent").alias("server"))
    registered = added.join(made, ["path", "line"]).join(guards, "guard").join(servers, ["path", "variable"]).join(tools, ["path", "server"]).select("g", "c", F.lit("server").alias("how"))
    shown = by_name.unionByName(registered).groupBy("g", "c").agg(F.array_join(F.array_sort(F.collect_set("how")), ",").alias("how"))
    return edges_of(shown, "g", "c", "guards", via=F.col("how"))


def build(found: DataFrame, endpoints: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the sources whose facts are given, stage by stage.

    Components of frameworks replace the symbols of the same name and file. Nodes carry ``lethal_trifecta`` and the flow of
    what reaches them (``flow``); edges that no node ends at are dropped; of several confidences of one edge the largest stays.
    """
    from . import stages

    found = cut_lineage(found)
    definitions = cut_lineage(definition_capabilities(found))
    shown = symbol_capabilities(found, definitions)
    shown = cut_lineage(credited(shown, guardrail_capability(found, definitions, shown)))
    plain = server_nodes(found).unionByName(symbol_nodes(found, definitions, shown)).unionByName(entry_nodes(found))
    if endpoints is not None:
        plain = plain.unionByName(endpoint_nodes(endpoints))
    plain = cut_lineage(_first_of(plain))
    sources, reads = stages.untrusted_sources(found, plain)
    early = [intra_file_edges(plain), reads, delegation_edges(found, plain), reached_edges(found, plain)]
    components = cut_lineage(framework_nodes(found, definitions))
    first = cut_lineage(reduce(DataFrame.unionByName, early).dropDuplicates(["id"]))
    nodes, edges = merge_detected(plain.unionByName(sources), first, components, framework_edges(found, components))
    nodes, edges = cut_lineage(nodes), cut_lineage(edges)
    more_nodes, more_edges = stages.source_writers(found, nodes, definitions)
    nodes, edges = cut_lineage(_first_of(nodes.unionByName(more_nodes))), cut_lineage(strongest(edges.unionByName(more_edges)))
    edges = cut_lineage(strongest(edges.unionByName(stages.dynamic_tools(nodes, edges)).unionByName(stages.cross_file(found, nodes))))
    entries, entry_edges = stages.server_entries(nodes)
    nodes, edges = cut_lineage(_first_of(nodes.unionByName(entries))), cut_lineage(strongest(edges.unionByName(entry_edges)))
    edges = edges.unionByName(stages.orphan_entries(nodes, edges))
    store_nodes, store_edges = stages.resolve_stores(found, nodes)
    store_nodes = cut_lineage(store_nodes)
    nodes = cut_lineage(_first_of(nodes.unionByName(store_nodes)))
    uploads = cut_lineage(stages.upload_links(found, nodes))
    typed, upload_nodes, upload_edges = stages.upload_sources(found, nodes, uploads)
    nodes = nodes.join(typed.withColumn("_u", F.lit(stages.UPLOADED)), "id", "left").withColumn("detail", F.coalesce("_u", "detail")).select(*NODE)
    nodes = cut_lineage(_first_of(nodes.unionByName(upload_nodes)))
    edges = cut_lineage(strongest(reduce(DataFrame.unionByName, [edges, store_edges, uploads, upload_edges, guard_edges(found, nodes)])))
    ids = nodes.select("id")
    real = edges.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi").join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_semi")
    flows = stages.body_attributes(found, nodes)
    done = nodes.join(flows, "id", "left").withColumn("lethal_trifecta", F.size(trifecta_hits("capabilities")) > 0)
    return done, stages.with_flow_kinds(real).select(*EDGE)


def strongest(edges: DataFrame) -> DataFrame:
    """One row per edge id, of several the one with the largest confidence."""
    others = [c for c in EDGE if c not in ("id", "identity_confidence")]
    kept = edges.groupBy("id").agg(F.max(F.struct(F.coalesce("identity_confidence", F.lit(0.0)).alias("_c"), "identity_confidence", *others)).alias("e"))
    return kept.select("id", "e.*").select(*EDGE)
