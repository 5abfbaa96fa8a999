"""The later stages of graph building: untrusted sources and who writes what they read, tools that are only known at run time,
components of other files, entries of servers, orphans, stores and uploads. Each is a transform over nodes, edges and facts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import literal_match, match_modules, server_of_path
from .build import NO_CLASS_SUFFIX, NO_CLASSES, _first_of, _id, _imported_files, _nodes, edges_of
from .closure import closure
from .facts import call_graph, local_imports, store_sites, symbols, untrusted_reads
from .graph import STRUCTURAL_EDGES
from .merge import combine_signals

# How surely two places are one before anything is known of them, and what adds to it.
BASE, CATALOGUE_BASE, UPLOAD_BASE, UPLOAD_MODULE_BASE = 0.3, 0.5, 0.5, 0.4
EQUAL, SAME_FILE, SHARED_IMPORT, ONE_IMPORTS, IN_BODY = 0.6, 0.2, 0.3, 0.1, 0.2
SURE_UPLOAD = 0.7
MODEL_BASE = 0.2
UPLOADED = "user_upload"
CLIENT_CALLS = ("boto3.client", "boto3.resource", "Storage", "Chroma", "Client", "connect")
MAX_WRITER_EDGES = 1000
CATALOGUE, DECLARED_TYPE = "mcp_catalogue", "mcp_tool_description"
# The capability that writes what a type of source reads.
WRITERS = {"rag_corpus": "writes_rag_corpus", "email_inbox": "writes_email_inbox"}


def named_components(nodes: DataFrame) -> DataFrame:
    """(file, name, id): the first component, by stage and line, that a name or a handler of a file may mean."""
    rows = nodes.filter("file is not null and kind not in ('untrusted_source', 'store')")
    named = rows.select("file", "name", "id", "stage", "line").unionByName(rows.filter("kind = 'entry_point'").select("file", F.col("parent").alias("name"), "id", "stage", "line"))
    return named.filter("name is not null").groupBy("file", "name").agg(F.min_by("id", F.struct("stage", "line", "id")).alias("id"))


def untrusted_sources(found: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): one source per type, call and file, and its access to the component whose body reads it, by the reader's
    name, else by its class's."""
    reads = untrusted_reads(found)
    made = reads.withColumn("name", F.concat_ws(":", "source_type", "call_target"))
    sources = _first_of(_nodes(made, id=_id("untrusted_source", F.col("source_type"), F.col("call_target"), F.col("path")), kind=F.lit("untrusted_source"), name=F.col("name"), file=F.col("path"), parent=F.coalesce("reader", F.lit("<module>")), line=F.col("line"), detail=F.col("source_type"), stage=F.lit(4)))
    known = named_components(nodes).withColumnRenamed("file", "path")
    by_reader = known.select("path", F.col("name").alias("reader"), F.col("id").alias("r"))
    by_class = known.select("path", F.col("name").alias("container"), F.col("id").alias("c"))
    linked = reads.join(by_reader, ["path", "reader"], "left").join(by_class, ["path", "container"], "left").withColumn("to", F.coalesce("r", "c")).filter(F.col("to").isNotNull())
    return sources, edges_of(linked.withColumn("s", _id("untrusted_source", F.col("source_type"), F.col("call_target"), F.col("path"))), "s", "to", "has_access_to")


def _store(rows: DataFrame, family: Column, hint: Column) -> DataFrame:
    return _nodes(rows, id=store_id(family, hint), kind=F.lit("store"), name=F.concat_ws(":", family, hint), parent=hint, detail=family, stage=F.lit(6)).dropDuplicates(["id"])


def store_id(family: Column, hint: Column) -> Column:
    return _id("store", family, hint)


def _linked(found: DataFrame) -> DataFrame:
    """(a, b): files of which one imports the other, both ways."""
    one = _imported_files(found).select(F.col("file").alias("a"), F.col("other").alias("b"))
    return one.union(one.select("b", "a")).distinct()


def source_writers(found: DataFrame, nodes: DataFrame, definitions: DataFrame, max_edges: int = MAX_WRITER_EDGES) -> tuple[DataFrame, DataFrame]:
    """(store nodes, edges): who writes what untrusted sources read.

    A catalogue of tools is written by the servers of the source's file or directory and by those that the sources declare by
    their factory's path, each through a store of its own. Corpora and mailboxes are written by components whose code writes
    such a place in the source's file or one that is import-linked to it, through a store of the source's type and call; the
    store is then as sure as its surest writer. At most ``max_edges`` edges, in the order of sources and writers.
    """
    sources = nodes.filter("kind = 'untrusted_source'").select(F.col("id").alias("s"), "file", F.col("detail").alias("type"), F.expr("substring(name, length(detail) + 2)").alias("call"))
    linked = _linked(found)
    servers = nodes.filter("kind = 'mcp_server'").select(F.col("id").alias("w"), "name", F.col("file").alias("w_file"))
    catalogues = sources.filter(F.col("type") == DECLARED_TYPE)
    exists = found.select("path").distinct().filter(F.col("path").rlike(r"(^|/)mcp/servers/[^/]+/server\.py$")).select(F.regexp_extract("path", r"(?:^|/)mcp/servers/([^/]+)/server\.py$", 1).alias("name"))
    declared = found.filter("fact = 'server_literal'").select("name").distinct().join(exists, "name", "left_semi").join(servers, "name").withColumn("all", F.lit(1))
    of_file = catalogues.join(servers.withColumn("file", F.col("w_file")), "file").select("s", "file", "w", "name", "w_file")
    of_path = catalogues.withColumn("name", server_of_path(F.col("file"))).join(servers, "name").select("s", "file", "w", "name", "w_file")
    anywhere = catalogues.withColumn("all", F.lit(1)).join(declared, "all").select("s", "file", "w", "name", "w_file")
    of_server = reduce(DataFrame.union, [of_file, of_path, anywhere]).distinct().withColumn("store", store_id(F.lit(CATALOGUE), F.col("name"))).withColumn("family", F.lit(CATALOGUE)).withColumn("hint", F.col("name"))
    known = named_components(nodes)
    writing = definitions.select(F.col("path").alias("w_file"), "name", "class_name", F.explode("caps").alias("capability"))
    wanted = [sources.filter(F.col("type") == t).withColumn("capability", F.lit(c)) for t, c in WRITERS.items()]
    reach = sources.select(F.col("file").alias("a"), F.col("file").alias("b")).distinct().union(linked).distinct()
    near = reduce(DataFrame.union, wanted).join(reach.select(F.col("a").alias("file"), F.col("b").alias("w_file")), "file").join(writing, ["w_file", "capability"])
    resolved = near.join(known.select(F.col("file").alias("w_file"), "name", F.col("id").alias("n")), ["w_file", "name"], "left").join(known.select(F.col("file").alias("w_file"), F.col("name").alias("class_name"), F.col("id").alias("c")), ["w_file", "class_name"], "left")
    of_component = resolved.withColumn("w", F.coalesce("n", "c")).filter(F.col("w").isNotNull()).select("s", "file", "w", "w_file", F.col("type").alias("family"), F.col("call").alias("hint")).distinct().withColumn("store", store_id(F.col("family"), F.col("hint")))
    columns = ["s", "file", "w", "w_file", "store", "family", "hint"]
    pairs = of_server.select(*columns).withColumn("base", F.lit(CATALOGUE_BASE)).unionByName(of_component.select(*columns).withColumn("base", F.lit(BASE)))
    met = linked.select(F.col("a").alias("w_file"), F.col("b").alias("file"), F.lit(True).alias("met"))
    context = F.when(F.col("w_file") == F.col("file"), SAME_FILE).when(F.col("met"), ONE_IMPORTS).otherwise(0.0)
    sure = pairs.join(met, ["w_file", "file"], "left").withColumn("sure", combine_signals(F.col("base"), F.array(F.lit(EQUAL), context)))
    writes = edges_of(sure, "w", "store", "writes_to", "sure").join(sure.groupBy("store", F.col("w").alias("source_id")).agg(F.min("s").alias("first")).withColumnRenamed("store", "target_id"), ["source_id", "target_id"])
    feeds = edges_of(sure, "store", "s", "reads_from", "sure").withColumn("first", F.col("target_id"))
    order = Window.orderBy("first", F.coalesce(F.when(F.col("kind") == "writes_to", F.col("source_id")), F.lit("~")), "id")
    every = writes.select(*feeds.columns).unionByName(feeds)
    # The limit bounds what the single-partition rank sees.
    kept = every.orderBy("first", F.coalesce(F.when(F.col("kind") == "writes_to", F.col("source_id")), F.lit("~")), "id").limit(max_edges).withColumn("_n", F.row_number().over(order)).drop("first", "_n")
    return _store(sure, F.col("family"), F.col("hint")), kept


def dynamic_tools(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Agents that read a catalogue of tools use all tools of the servers that write it, directly or through a store."""
    agents = nodes.filter((F.col("kind") == "agent") & F.array_contains("capabilities", "reads_untrusted")).select(F.col("id").alias("a"))
    catalogues = nodes.filter((F.col("kind") == "untrusted_source") & (F.col("detail") == DECLARED_TYPE)).select(F.col("id").alias("s"))
    reads = edges.filter("kind = 'has_access_to'").select(F.col("source_id").alias("s"), F.col("target_id").alias("a")).join(catalogues, "s", "left_semi").join(agents, "a", "left_semi")
    written = edges.filter("kind = 'writes_to'").select(F.col("source_id").alias("w"), F.col("target_id").alias("p"))
    through = edges.filter("kind = 'reads_from'").select(F.col("source_id").alias("p"), F.col("target_id").alias("s")).join(catalogues, "s", "left_semi")
    writers = written.withColumnRenamed("p", "s").join(catalogues, "s", "left_semi").select("w", "s").unionByName(written.join(through, "p").select("w", "s"))
    tools = edges.filter("kind = 'provides_tool'").select(F.col("source_id").alias("w"), F.col("target_id").alias("t"))
    made = edges_of(reads.join(writers, "s").join(tools, "w"), "a", "t", "uses_tool")
    return made.join(edges.select("id"), "id", "left_anti")


def cross_file(found: DataFrame, nodes: DataFrame) -> DataFrame:
    """Framework agents use the framework tools of modules they import; tools have access to sinks of imported files whose name
    they reach over the call graph."""
    modules = found.filter("fact = 'import'").select(F.col("path").alias("file"), F.col("target").alias("module")).distinct()
    agents = nodes.filter("kind = 'agent' and framework is not null").select(F.col("id").alias("a"), "file")
    # A module is the file whose path ends with its own.
    tails = nodes.filter("kind = 'tool' and framework is not null").select(F.col("id").alias("t"), F.col("file").alias("other"), F.split(F.regexp_replace("file", r"\.py$", ""), "/").alias("p")).filter(F.col("other").endswith(".py"))
    tails = tails.select("t", "other", F.explode(F.transform(F.sequence(F.lit(1), F.size("p")), lambda i: F.array_join(F.slice("p", i, F.size("p")), "."))).alias("module"))
    uses = edges_of(agents.join(modules, "file").join(tails, "module").filter("file <> other"), "a", "t", "uses_tool", via="cross_file_import")
    tools = nodes.filter("kind = 'tool'").select(F.col("id").alias("t"), "file", F.col("name").alias("start"))
    sinks = nodes.filter("kind = 'sink'").select(F.col("id").alias("k"), F.col("file").alias("other"), "name")
    linked = match_modules(modules.select("module").distinct(), sinks.select(F.col("other").alias("file")).distinct()).select("module", F.col("file").alias("other"))
    pairs = tools.join(modules, "file").join(linked, "module").filter("file <> other").select("t", "start", "other").distinct()
    reach = closure(pairs.select("start").distinct(), call_graph(found).select(F.col("caller").alias("src"), F.col("callee").alias("dst")))
    return uses.unionByName(edges_of(pairs.join(reach, "start").join(sinks, ["other", "name"]), "t", "k", "has_access_to"))


def server_entries(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): a virtual entry of every framework server, which delegates to the tools that name it as their server."""
    servers = nodes.filter("kind = 'mcp_server' and framework is not null").withColumn("e", _id("entry_point", F.lit("mcp"), F.col("name")))
    entries = _nodes(servers, id=F.col("e"), kind=F.lit("entry_point"), name=F.concat(F.lit("MCP:"), F.col("name")), file=F.col("file"), framework=F.col("framework"), detail=F.lit("mcp"), stage=F.lit(7)).dropDuplicates(["id"])
    tools = nodes.filter("kind = 'tool' and parent is not null and framework is not null").select(F.col("id").alias("t"), F.col("parent").alias("name"))
    return entries, edges_of(servers.select("e", "name").distinct().join(tools, "name"), "e", "t", "delegates_to", via="mcp_entry")


def orphan_entries(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Entries that delegate to nothing are linked to the framework's agent, if there is exactly one."""
    only = nodes.filter("kind = 'agent' and framework is not null").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("a")).filter("n = 1").select("a", F.lit("entry_point").alias("kind"))
    busy = edges.filter("kind = 'delegates_to'").select(F.col("source_id").alias("id"))
    orphans = nodes.filter("kind = 'entry_point'").select("id", "kind").join(busy, "id", "left_anti")
    return edges_of(orphans.join(only, "kind").select(F.col("id").alias("e"), "a"), "e", "a", "delegates_to", via="orphan_entry_to_single_agent")


def with_flow_kinds(edges: DataFrame) -> DataFrame:
    """Edges whose kind is no structural one flow as control, whatever they were made with."""
    return edges.withColumn("flow_kind", F.when(F.col("kind").isin(*STRUCTURAL_EDGES), F.col("flow_kind")).otherwise("control"))


def body_attributes(found: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, flow, returns_data): what reaches the dangerous calls of a sink, and whether a tool returns data.

    The definition is the one of the name on the node's line, else the innermost that holds the line, else the nearest before,
    else the first of the file.
    """
    functions = found.filter("fact in ('function', 'class')").select(F.col("path").alias("file"), "name", F.col("line").alias("start"), "line_end", F.col("text").alias("grade"), F.col("flag").alias("returns"), "fact")
    rows = nodes.filter("kind in ('sink', 'tool') and file is not null").select("id", "kind", "file", "name", "line").join(functions, ["file", "name"])
    line = F.col("line")
    rank = F.when(F.col("start") == line, F.struct(F.lit(0).alias("a"), F.lit(0).alias("b"))).when((F.col("start") <= line) & (line <= F.col("line_end")), F.struct(F.lit(1).alias("a"), (-F.col("start")).alias("b"))).when(F.col("start") < line, F.struct(F.lit(2).alias("a"), (-F.col("start")).alias("b"))).otherwise(F.struct(F.lit(3).alias("a"), F.col("start").alias("b")))
    best = rows.groupBy("id", "kind").agg(F.min_by(F.struct("grade", "returns", "fact"), rank).alias("d"))
    return best.select("id", F.when(F.col("kind") == "sink", F.col("d.grade")).alias("flow"), F.when((F.col("kind") == "tool") & (F.col("d.fact") == "function"), F.col("d.returns")).alias("returns_data"))


def attached(sites: DataFrame) -> DataFrame:
    """Every site with each key (hint of its family) it may mean, and how surely: the same, one that begins like it, or, where
    a site has no hint, any key of the family.

    Prefixes are met by equality: a hint is cut to the lengths that keys of its family have, and a key to those of hints, so no
    site is compared to keys that differ from it.
    """
    keys = sites.filter("hint is not null").select("family", F.col("hint").alias("key")).distinct()
    hinted = sites.filter("hint is not null")
    lengths = keys.select("family", F.length("key").alias("n")).distinct()

    def cut(rows: DataFrame, column: str, to: str) -> DataFrame:
        return rows.join(lengths, "family").filter(F.col("n") <= F.length(column)).withColumn(to, F.substring(column, F.lit(1), F.col("n"))).drop("n")

    down = cut(hinted, "hint", "key").join(keys, ["family", "key"])
    up = hinted.join(cut(keys, "key", "hint"), ["family", "hint"])
    free = sites.filter("hint is null").join(keys, "family")
    columns = [*sites.columns, "key"]
    every = reduce(DataFrame.unionByName, [x.select(*columns) for x in (down, up, free)]).distinct()
    return every.withColumn("literal", literal_match(F.col("hint"), F.col("key")))


def site_context(own: DataFrame, others: DataFrame, imports: DataFrame) -> DataFrame:
    """(family, key, path, context): the closest that a site of the other side attached to the key is to a file: the same file,
    a shared local import, or one imports the other. All of it by equality joins on distinct files."""
    a = own.select("family", "key", "path").distinct()
    b = others.select("family", "key", F.col("path").alias("other")).distinct()
    mine, theirs = imports.select("path", F.explode("imports").alias("i")), imports.select(F.col("path").alias("other"), F.explode("imports").alias("i"))
    apart = F.col("path") != F.col("other")
    same = a.join(b.withColumn("path", F.col("other")), ["family", "key", "path"]).select("family", "key", "path", F.lit(SAME_FILE).alias("c"))
    shared = a.join(mine, "path").join(b.join(theirs, "other"), ["family", "key", "i"]).filter(apart).select("family", "key", "path", F.lit(SHARED_IMPORT).alias("c"))
    to = a.join(mine, "path").join(b.withColumn("i", F.col("other")), ["family", "key", "i"]).filter(apart).select("family", "key", "path", F.lit(ONE_IMPORTS).alias("c"))
    back = b.join(theirs, "other").join(a.withColumn("i", F.col("path")), ["family", "key", "i"]).filter(apart).select("family", "key", "path", F.lit(ONE_IMPORTS).alias("c"))
    return reduce(DataFrame.unionByName, [same, shared, to, back]).groupBy("family", "key", "path").agg(F.max("c").alias("context"))


def store_links(sites: DataFrame, imports: DataFrame, base: float = BASE) -> DataFrame:
    """(path, family, side, hint, line, key, confidence): how surely each site means each of its keys, raised by the closest
    site of the other side. ``sites`` has (path, family, side, hint, line), ``imports`` (path, imports)."""
    placed = attached(sites.select("path", "family", "side", "hint", "line").distinct())
    writes, reads = placed.filter("side = 'write'"), placed.filter("side = 'read'")
    near = site_context(writes, reads, imports).withColumn("side", F.lit("write")).unionByName(site_context(reads, writes, imports).withColumn("side", F.lit("read")))
    signals = F.when(F.col("context") > 0, F.array("literal", "context")).otherwise(F.array("literal"))
    return placed.join(near, ["family", "key", "path", "side"], "left").select("path", "family", "side", "hint", "line", "key", combine_signals(F.lit(base), signals).alias("confidence"))


def resolve_stores(found: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): a store per family and hint; written by the component around a writing call, read by the untrusted
    source on the line of a reading one."""
    links = store_links(store_sites(found), local_imports(found)).withColumn("store", store_id(F.col("family"), F.col("key")))
    spans = found.filter("fact = 'function' or (fact = 'class' and flag)").select("path", "name", F.col("line").alias("start"), "line_end", (F.col("fact") == "class").alias("late"))
    points = links.filter("side = 'write'").select("path", "line").distinct()
    known = named_components(nodes).select(F.col("file").alias("path"), "name", "id")
    around = points.join(spans, "path").filter("start <= line and line <= line_end").join(known, ["path", "name"])
    writer = around.groupBy("path", "line").agg(F.min_by("id", F.struct("late", (-F.col("start")).alias("s"))).alias("w"))
    writes = edges_of(links.filter("side = 'write'").join(writer, ["path", "line"]), "w", "store", "writes_to", "confidence")
    sources = nodes.filter("kind = 'untrusted_source'").groupBy(F.col("file").alias("path"), "line").agg(F.min("id").alias("s"))
    reads = edges_of(links.filter("side = 'read'").join(sources, ["path", "line"]), "store", "s", "reads_from", "confidence")
    return _store(links, F.col("family"), F.col("key")), writes.unionByName(reads)


def upload_entries(found: DataFrame, nodes: DataFrame) -> DataFrame:
    """(e, file, handler, framework): entry points through which files come in; upload widgets of pages are such themselves."""
    entries = nodes.filter("kind = 'entry_point'").select(F.col("id").alias("e"), "file", F.col("parent").alias("handler"), "name", "detail")
    routed = found.filter("fact = 'upload'").select(F.col("path").alias("file"), F.col("name").alias("handler"), F.col("target").alias("framework"))
    pages = entries.filter("detail = 'page' and endswith(name, 'file_uploader')").select("e", "file", "handler", F.lit("streamlit").alias("framework"))
    return entries.filter("detail = 'http'").join(routed, ["file", "handler"]).select("e", "file", "handler", "framework").unionByName(pages).distinct()


def upload_links(found: DataFrame, nodes: DataFrame, threshold: float = SURE_UPLOAD) -> DataFrame:
    """Edges from upload entries to the file stores that code reached from their handler writes: surer in the handler's own body
    and file. Pages reach from what the body of their module calls, and write in it. Links under ``threshold`` are none."""
    uploads = upload_entries(found, nodes)
    sites = store_sites(found).filter("family = 'fs' and side = 'write' and hint is not null").select(F.col("path").alias("w_file"), "line", "hint").distinct()
    spans = symbols(found).filter("kind <> 'class'").select(F.col("path").alias("w_file"), F.col("name").alias("fn"), F.col("line").alias("start"), "line_end")
    held = sites.join(spans, "w_file").filter("start <= line and line <= line_end").select("w_file", "line", "hint", "fn", "start")
    inner = held.groupBy("w_file", "line", "hint").agg(F.max_by("fn", "start").alias("inner"))
    handlers = uploads.filter("handler <> '<module>'").select("e", "file", F.col("handler").alias("start"), "handler")
    module_calls = found.filter("fact = 'call' and size(owners) = 0 and instr(target, '.') = 0").select(F.col("path").alias("file"), F.col("target").alias("start")).distinct()
    pages = uploads.filter("handler = '<module>'").select("e", "file", "handler").join(module_calls, "file").select("e", "file", "start", "handler")
    starts = handlers.unionByName(pages)
    reach = closure(starts.select("start"), call_graph(found).select(F.col("caller").alias("src"), F.col("callee").alias("dst")))
    reached = starts.join(reach, "start").join(held.select("w_file", "line", "hint", F.col("fn").alias("name")), "name").select("e", "file", "handler", "w_file", "line", "hint").distinct().join(inner, ["w_file", "line", "hint"], "left").withColumn("base", F.lit(UPLOAD_BASE))
    bare = sites.join(inner, ["w_file", "line", "hint"], "left_anti").withColumn("file", F.col("w_file"))
    body = uploads.filter("handler = '<module>'").join(bare, "file").select("e", "file", "handler", "w_file", "line", "hint", F.lit(None).cast("string").alias("inner"), F.lit(UPLOAD_MODULE_BASE).alias("base"))
    every = reached.select(*body.columns).unionByName(body)
    signals = F.array_compact(F.array(F.lit(EQUAL), F.when(F.col("w_file") == F.col("file"), SAME_FILE), F.when((F.col("handler") != "<module>") & (F.col("inner") == F.col("handler")), IN_BODY)))
    sure = every.withColumn("sure", combine_signals(F.col("base"), signals)).filter(F.col("sure") >= threshold).withColumn("store", store_id(F.lit("fs"), F.col("hint")))
    return edges_of(sure, "e", "store", "writes_to", "sure")


def upload_sources(found: DataFrame, nodes: DataFrame, uploads: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(typed ids, nodes, edges): what uploads make of the code around them.

    Untrusted sources without a type in the scope of an upload (its file, and files import-linked to it) are of its type. A
    reading call in the scope whose hint may mean a store that the upload's entry writes to becomes a source of that type, once per
    file and call, unless there is one on its line or of its call; it reads from the store, the surer the closer the files are
    (a client that both import, the same file, one importing the other), and the component around the call has access to it.
    """
    linked = _linked(found)
    entries = upload_entries(found, nodes).select("e", "file").distinct()
    scope = entries.select("e", "file", F.col("file").alias("path")).unionByName(entries.join(linked.select(F.col("a").alias("file"), F.col("b").alias("path")), "file").select("e", "file", "path")).distinct()
    old = nodes.filter("kind = 'untrusted_source'")
    typed = old.filter("detail is null or detail = ''").select("id", F.col("file").alias("path")).join(scope.select("path").distinct(), "path", "left_semi").select("id")
    stores = uploads.select(F.col("source_id").alias("e"), F.col("target_id").alias("store")).join(nodes.filter("kind = 'store'").select(F.col("id").alias("store"), F.col("parent").alias("key")), "store")
    sites = store_sites(found).filter("family = 'fs' and side = 'read' and hint is not null and target is not null").select("path", "line", "hint", "target").distinct()
    on_line = old.select(F.col("file").alias("path"), "line").distinct()
    of_call = old.select(F.col("file").alias("path"), F.expr("substring(name, length(detail) + 2)").alias("target")).distinct()
    free = sites.join(on_line, ["path", "line"], "left_anti").join(of_call, ["path", "target"], "left_anti")
    pairs = free.join(scope, "path").join(stores, "e").withColumn("literal", literal_match(F.col("hint"), F.col("key"))).filter("literal is not null")
    clients = found.filter(F.col("target").isin(*CLIENT_CALLS) & (F.col("fact") == "assign") & (F.size("owners") == 0)).select(F.col("path").alias("client")).distinct()
    reach = _imported_files(found).select("file", F.col("other").alias("client")).unionByName(clients.select(F.col("client").alias("file"), "client")).join(clients, "client", "left_semi").distinct()
    shared = pairs.select("file", "path").distinct().join(reach, "file").join(reach.select(F.col("file").alias("path"), "client"), ["path", "client"]).select("file", "path").distinct().withColumn("shared", F.lit(True))
    near = F.when(F.col("shared"), SHARED_IMPORT).when(F.col("file") == F.col("path"), SAME_FILE).otherwise(ONE_IMPORTS)
    sure = pairs.join(shared, ["file", "path"], "left").withColumn("sure", combine_signals(F.lit(BASE), F.array("literal", near))).withColumn("s", _id("untrusted_source", F.lit(UPLOADED), F.col("target"), F.col("path")))
    first = sure.groupBy("s").agg(F.min_by(F.struct("path", "line", "target", "store", "sure"), F.struct("e", "line", "store")).alias("r")).select("s", "r.*")
    spans = found.filter("fact in ('function', 'class')").select("path", "name", F.col("line").alias("start"), "line_end", (F.col("fact") == "class").alias("late"))
    around = first.join(spans, "path").filter("start <= line and line <= line_end").join(named_components(nodes).select(F.col("file").alias("path"), "name", "id"), ["path", "name"])
    readers = around.groupBy("s").agg(F.min_by("id", F.struct("late", (-F.col("start")).alias("b"))).alias("to"))
    made = _nodes(first, id=F.col("s"), kind=F.lit("untrusted_source"), name=F.concat_ws(":", F.lit(UPLOADED), "target"), file=F.col("path"), line=F.col("line"), detail=F.lit(UPLOADED), stage=F.lit(8))
    return typed, made, edges_of(first, "store", "s", "reads_from", "sure").unionByName(edges_of(readers, "s", "to", "has_access_to"))


def answered_stores(found: DataFrame, nodes: DataFrame, answers: DataFrame, required: bool = False) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of sites without a hint for which a model named one: ``answers`` has (path, line, hint).

    Their links are as sure as a model's word alone makes them, nothing is added to it, and say so: they are ``via`` ``llm``. With ``required`` a site
    in the scope of an upload that has no answer raises ValueError.
    """
    scope = upload_entries(found, nodes).select(F.col("file").alias("path")).distinct()
    scope = scope.unionByName(scope.join(_linked(found).select(F.col("a").alias("path"), F.col("b").alias("other")), "path").select(F.col("other").alias("path"))).distinct()
    open_ = store_sites(found).filter("family = 'fs' and hint is null").drop("hint").join(scope, "path", "left_semi")
    named = open_.join(answers.filter("hint is not null and hint <> ''").groupBy("path", "line").agg(F.min("hint").alias("hint")), ["path", "line"], "left")
    if required and not named.filter("hint is null").isEmpty():
        raise ValueError("sites are left without a store")
    links = named.filter("hint is not null").select("path", "family", "side", "line", F.col("hint").alias("key"), F.lit(MODEL_BASE).alias("confidence")).withColumn("store", store_id(F.col("family"), F.col("key")))
    spans = found.filter("fact = 'function'").select("path", "name", F.col("line").alias("start"), "line_end")
    around = links.join(spans, "path").filter("start <= line and line <= line_end").join(named_components(nodes).select(F.col("file").alias("path"), "name", "id"), ["path", "name"])
    holder = around.groupBy("path", "line", "side", "store", "confidence").agg(F.max_by("id", "start").alias("c"))
    writes = edges_of(holder.filter("side = 'write'"), "c", "store", "writes_to", "confidence", via="llm")
    sources = nodes.filter("kind = 'untrusted_source'").groupBy(F.col("file").alias("path"), "line").agg(F.min("id").alias("s"))
    reads = edges_of(links.filter("side = 'read'").join(sources, ["path", "line"]), "store", "s", "reads_from", "confidence", via="llm")
    return _store(links, F.col("family"), F.col("key")), writes.unionByName(reads)


def unclassified(found: DataFrame, nodes: DataFrame) -> DataFrame:
    """(path, kind, name, class_name, line, has_tool, parent_kind): classes and methods that no rule made a component, but for the
    excluded names; ``has_tool`` tells a tool decorator, ``parent_kind`` what their class is."""
    known = nodes.select(F.col("file").alias("path"), "name").distinct()
    rows = symbols(found).filter("kind in ('class', 'method')")
    excluded = F.when(F.col("kind") == "class", F.col("name").isin(*NO_CLASSES) | F.col("name").rlike(NO_CLASS_SUFFIX)).otherwise(F.col("name").startswith("_") | (F.col("name").startswith("create_") & F.col("name").endswith("_server")))
    tools = found.filter((F.col("fact") == "decorator") & (F.substring_index("target", ".", -1) == "tool")).select("path", "name").distinct().withColumn("has_tool", F.lit(True))
    parents = nodes.groupBy(F.col("file").alias("path"), F.col("name").alias("class_name")).agg(F.min("kind").alias("parent_kind"))
    left = rows.filter(~excluded).join(known, ["path", "name"], "left_anti")
    return left.join(tools, ["path", "name"], "left").join(parents, ["path", "class_name"], "left").select("path", "kind", "name", "class_name", "line", F.coalesce("has_tool", F.lit(False)).alias("has_tool"), "parent_kind")


def classified_by_model(pending: DataFrame, answers: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, merged): what a model's answers (path, name, answer_kind, capabilities, part_of_parent) make of pending symbols.

    An answer that is part of its parent, or of a kind that agents own while the parent is an agent, adds its capabilities to the
    parent's node (``merged``: id, capabilities). Others become nodes marked ``llm``; a tool without a decorator below a server
    directory is marked ``llm:undecorated``. What rules have made stays.
    """
    told = pending.join(answers.groupBy("path", "name").agg(F.min(F.struct("answer_kind", "capabilities", "part_of_parent")).alias("a")), ["path", "name"]).select(*pending.columns, "a.*").filter("answer_kind is not null")
    parents = nodes.groupBy(F.col("file").alias("path"), F.col("name").alias("class_name")).agg(F.min("id").alias("parent_id"))
    placed = told.join(parents, ["path", "class_name"], "left").withColumn("up", F.col("parent_id").isNotNull() & (F.coalesce("part_of_parent", F.lit(False)) | ((F.col("parent_kind") == "agent") & F.col("answer_kind").isin("agent", "llm_endpoint"))))
    merged = placed.filter("up").groupBy(F.col("parent_id").alias("id")).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce("capabilities", F.array().cast("array<string>")))))).alias("capabilities"))
    flag = F.when((F.col("answer_kind") == "tool") & ~F.col("has_tool") & server_of_path(F.col("path")).isNotNull(), "llm:undecorated").otherwise("llm")
    own = placed.filter("not up")
    made = _nodes(own, id=_id(F.col("answer_kind"), F.col("path"), F.col("name"), F.col("class_name")), kind=F.col("answer_kind"), name=F.col("name"), file=F.col("path"), capabilities=F.array_sort(F.coalesce("capabilities", F.array().cast("array<string>"))), parent=F.col("class_name"), line=F.col("line"), framework=flag, stage=F.lit(9))
    return _first_of(made), merged
