"""From voters' answers to verdicts: weighted votes, evidence, guardrails, recovered hops."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..tables import clean_key
from .graph import TRAVERSABLE, Graph
from .scoring import trifecta_hits
from .validation import validate_chains


def votes_of(chains: DataFrame, id: str = "id", outputs: str = "voter_outputs") -> DataFrame:
    """(chain_id, pos, voter, exploitable, confidence, evidence, timeout): one row per stored vote."""
    return chains.select(F.col(id).alias("chain_id"), F.posexplode(outputs).alias("pos", "v")).select("chain_id", "pos", clean_key(F.col("v.model")).alias("voter"), "v.exploitable", "v.confidence", "v.evidence", "v.reasoning", F.coalesce("v.timeout", F.lit(False)).alias("timeout"))


def aggregate_votes(votes: DataFrame, weights: DataFrame) -> DataFrame:
    """(chain_id, verdict, confidence, n_valid): the heavier side of the valid answers, and their weighted mean confidence.

    Answers that timed out or say nothing do not count; a voter without a weight weighs 1; a tie, and a chain whose votes
    are all invalid, is ``uncertain``, the latter with confidence 0. Voters are a short table, joined by what AQE picks.
    """
    own = weights.select(clean_key(F.col("name")).alias("voter"), "weight").groupBy("voter").agg(F.max("weight").alias("weight"))
    valid = ~F.col("timeout") & F.col("exploitable").isNotNull()
    w = F.when(valid, F.coalesce("weight", F.lit(1.0)))
    sums = votes.join(own, "voter", "left").groupBy("chain_id").agg(
        F.sum(w).alias("all"), F.sum(w * F.col("confidence")).alias("sure"), F.coalesce(F.sum(F.when(F.col("exploitable"), w)), F.lit(0.0)).alias("yes"), F.coalesce(F.sum(F.when(~F.col("exploitable"), w)), F.lit(0.0)).alias("no"), F.count_if(valid).alias("n_valid")
    )
    tie = F.abs(F.col("yes") - F.col("no")) < 1e-9
    verdict = F.when((F.col("n_valid") == 0) | tie, "uncertain").when(F.col("yes") > F.col("no"), "exploitable").otherwise("not_exploitable")
    return sums.select("chain_id", verdict.alias("verdict"), F.coalesce(F.try_divide("sure", "all"), F.lit(0.0)).alias("confidence"), "n_valid")


def evidence_present(votes: DataFrame, chains: DataFrame, id: str = "id") -> DataFrame:
    """(chain_id, cited, unknown): whether some vote cites an edge of its chain, and how many citations are of no edge."""
    edges = chains.select(F.col(id).alias("chain_id"), F.coalesce("chain_edges", F.array().cast("array<string>")).alias("own"))
    cited = votes.join(edges, "chain_id").withColumn("cites", F.coalesce("evidence", F.array().cast("array<string>")))
    return cited.groupBy("chain_id").agg(F.max(F.coalesce(F.arrays_overlap("cites", "own"), F.lit(False))).alias("cited"), F.sum(F.size(F.array_except("cites", "own"))).cast("bigint").alias("unknown"))


def guardrails_of_chains(chains: DataFrame, graph: Graph, id: str = "id") -> DataFrame:
    """(chain_id, guardrail_id) of the active guardrails on a node of the chain, or on the server (by name) of its tools."""
    cells = chains.select(F.col(id).alias("chain_id"), F.explode("chain_nodes").alias("node")).distinct()
    guards = graph.edges.filter("status = 'active' and kind = 'guards'").select(F.col("source_id").alias("guardrail_id"), F.col("target_id").alias("node"))
    tools = graph.nodes.filter("kind = 'tool'").select(F.col("id").alias("node"), F.get_json_object("attributes", "$.parent_server").alias("server")).filter("server is not null")
    servers = graph.nodes.filter("kind = 'mcp_server'").select(F.col("id").alias("server_id"), F.col("name").alias("server"))
    through = cells.join(tools.join(servers, "server"), "node").select("chain_id", F.col("server_id").alias("node"))
    known = graph.nodes.filter("status = 'active' and kind = 'guardrail'").select(F.col("id").alias("guardrail_id"))
    return cells.unionByName(through).join(guards, "node").select("chain_id", "guardrail_id").distinct().join(known, "guardrail_id", "left_semi")


def hop_edges(chains: DataFrame, graph: Graph, id: str = "id") -> DataFrame:
    """(chain_id, pos, edge_id): for each hop of the chain's nodes the active edge that carries it, traversable ones before
    anchor links, then by id; null where there is none."""
    n = F.col("chain_nodes")
    hops = chains.filter(F.size(n) > 1).select(F.col(id).alias("chain_id"), F.posexplode(F.arrays_zip(F.slice(n, 1, F.size(n) - 1).alias("a"), F.slice(n, 2, F.size(n) - 1).alias("b"))).alias("pos", "h")).select("chain_id", "pos", "h.a", "h.b")
    usable = graph.edges.filter((F.col("status") == "active") & (F.col("flow_kind").isin(*TRAVERSABLE) | (F.col("kind") == "writes_to")))
    best = usable.groupBy(F.col("source_id").alias("a"), F.col("target_id").alias("b")).agg(F.min(F.struct((~F.col("flow_kind").isin(*TRAVERSABLE)).alias("late"), "id")).alias("e"))
    return hops.join(best, ["a", "b"], "left").select("chain_id", "pos", F.col("e.id").alias("edge_id"))


def merged_reasoning(outputs):
    """The reasonings of an array of votes in order, each behind its voter's name."""
    said = F.filter(outputs, lambda v: v["reasoning"].isNotNull())
    return F.array_join(F.transform(said, lambda v: F.concat(F.lit("["), v["model"], F.lit("] "), v["reasoning"])), "\n")


def vote_records(votes: DataFrame, chains: DataFrame, id: str = "id") -> DataFrame:
    """The votes with ``evidence_valid`` and ``evidence_unknown``: what they cite that is no edge of their chain, in order."""
    own = chains.select(F.col(id).alias("chain_id"), F.coalesce("chain_edges", F.array().cast("array<string>")).alias("own"))
    cites = F.coalesce("evidence", F.array().cast("array<string>"))
    unknown = F.filter(cites, lambda e: ~F.coalesce(F.array_contains("own", e), F.lit(False)))
    return votes.join(own, "chain_id").withColumn("evidence_unknown", unknown).withColumn("evidence_valid", F.size("evidence_unknown") == 0).drop("own")


def said_reasoning(votes: DataFrame) -> DataFrame:
    """(chain_id, reasoning): what each vote says behind its voter's name, in order; a vote that timed out says so."""
    part = F.concat(F.lit("["), "voter", F.lit("] "), F.when(F.col("timeout"), "timeout").otherwise(F.coalesce("reasoning", F.lit(""))))
    return votes.groupBy("chain_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", part.alias("p")))), lambda x: x["p"]), "\n\n").alias("reasoning"))


# Levels of validation.
EXISTENCE, SEMANTIC, EVIDENCE = "existence", "semantic", "evidence"


def evaluate_chains(chains: DataFrame, graph: Graph, votes: DataFrame, weights: DataFrame, judge: DataFrame | None = None) -> DataFrame:
    """(id, verdict, confidence, validated, validated_kind, notes) of chains (id, chain_nodes, chain_edges) by their votes.

    The judge's verdict stands where there is one, else the voters'. A chain that the graph does not bear out keeps the notes of
    its validation; of the others those are valid that some vote cites an edge of, and the rest get one note that says why not.
    Chains without votes are uncertain.
    """
    decided = aggregate_votes(votes, weights)
    if judge is not None:
        decided = judged(decided, judge)
    checked = validate_chains(chains, graph)
    cited = evidence_present(votes, chains).join(votes.groupBy("chain_id").agg(F.max(~F.col("timeout")).alias("answered")), "chain_id")
    joined = checked.join(decided.select(F.col("chain_id").alias("id"), "verdict", "confidence"), "id", "left").join(cited.withColumnRenamed("chain_id", "id"), "id", "left")
    has = F.coalesce("cited", F.lit(False))
    why = F.when(~F.coalesce("answered", F.lit(False)), "no edge of the chain is cited (no voter answered)").when(F.coalesce("unknown", F.lit(0)) > 0, F.concat(F.lit("no edge of the chain is cited ("), F.col("unknown").cast("string"), F.lit(" citation(s) of others)"))).otherwise("no edge of the chain is cited")
    return joined.select(
        "id",
        F.coalesce("verdict", F.lit("uncertain")).alias("verdict"),
        F.coalesce("confidence", F.lit(0.0)).alias("confidence"),
        (F.col("ok") & has).alias("validated"),
        F.when(~F.col("ok"), F.col("validated_kind")).when(has, EVIDENCE).otherwise(SEMANTIC).alias("validated_kind"),
        F.when(~F.col("ok"), F.col("notes")).when(has, F.array().cast("array<string>")).otherwise(F.array(why)).alias("notes"),
    )


def group_sides(groups: DataFrame, chains: DataFrame) -> DataFrame:
    """(group_id, side, pos, chain_id, nodes): the chains that stored groups name, by their clean keys; nodes are null where there
    is no such chain. ``groups`` has (id, write_chain_ids, read_chain_ids), ``chains`` (id, chain_nodes)."""
    named = [groups.select(F.col("id").alias("group_id"), F.lit(side).alias("side"), F.posexplode(f"{side}_chain_ids").alias("pos", "chain_id")) for side in ("write", "read")]
    known = chains.select(clean_key(F.col("id")).alias("chain_id"), F.col("chain_nodes").alias("nodes")).dropDuplicates(["chain_id"])
    every = named[0].unionByName(named[1]).withColumn("chain_id", clean_key(F.col("chain_id"))).filter("chain_id <> ''")
    return every.join(known, "chain_id", "left").select("group_id", "side", "pos", "chain_id", "nodes")


def evaluate_groups(groups: DataFrame, chains: DataFrame, graph: Graph, votes: DataFrame, weights: DataFrame) -> DataFrame:
    """(group_id, verdict, confidence, validated, validated_kind, holes, outside, lethal_trifecta) of stored groups.

    A group is valid if every hop of its chains is carried by an edge of the graph and no vote cites an edge beyond those:
    ``holes`` counts chains with a hop that is not, or that are not there, ``outside`` the citations. The trifecta is that of any
    node of a read chain. Votes have the group's id as ``chain_id``.
    """
    sides = group_sides(groups, chains)
    used = sides.filter("nodes is not null").select(F.col("chain_id").alias("id"), F.col("nodes").alias("chain_nodes")).dropDuplicates(["id"])
    carried = hop_edges(used, graph).groupBy("chain_id").agg(F.count_if(F.col("edge_id").isNull()).alias("missing"), F.collect_set("edge_id").alias("edges"))
    cells = sides.join(carried, "chain_id", "left")
    whole = cells.groupBy("group_id").agg(F.count_if(F.col("nodes").isNull() | (F.coalesce("missing", F.lit(0)) > 0)).alias("holes"), F.array_distinct(F.flatten(F.collect_list(F.coalesce("edges", F.array().cast("array<string>"))))).alias("edges"))
    flags = graph.nodes.select(F.col("id").alias("node"), F.coalesce(F.get_json_object("attributes", "$.lethal_trifecta").cast("boolean"), F.size(trifecta_hits("capabilities")) > 0).alias("flag"))
    read = sides.filter("side = 'read'").select("group_id", F.explode("nodes").alias("node")).join(flags.filter("flag"), "node").select("group_id").distinct().withColumn("lethal_trifecta", F.lit(True))
    cites = votes.join(whole.select(F.col("group_id").alias("chain_id"), "edges"), "chain_id").select("chain_id", F.size(F.filter(F.coalesce("evidence", F.array().cast("array<string>")), lambda e: ~F.coalesce(F.array_contains("edges", e), F.lit(False)))).alias("n"))
    outside = cites.groupBy(F.col("chain_id").alias("group_id")).agg(F.sum("n").alias("outside"))
    decided = aggregate_votes(votes, weights).select(F.col("chain_id").alias("group_id"), "verdict", "confidence")
    joined = groups.select(F.col("id").alias("group_id")).join(whole, "group_id", "left").join(outside, "group_id", "left").join(read, "group_id", "left").join(decided, "group_id", "left")
    holes, beyond = F.coalesce("holes", F.lit(0)), F.coalesce("outside", F.lit(0))
    valid = (holes == 0) & (beyond == 0)
    return joined.select("group_id", F.coalesce("verdict", F.lit("uncertain")).alias("verdict"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"), valid.alias("validated"), F.when(valid, SEMANTIC).otherwise(EXISTENCE).alias("validated_kind"), holes.alias("holes"), beyond.cast("bigint").alias("outside"), F.coalesce("lethal_trifecta", F.lit(False)).alias("lethal_trifecta"))


def guardrails_of_groups(groups: DataFrame, chains: DataFrame, graph: Graph) -> DataFrame:
    """(group_id, side, guardrail_id): guardrails on the write side, the read side and the anchor of stored groups. The anchor
    (``untrusted_source_id``) is a side of its own and is left out of the others."""
    anchors = groups.select(F.col("id").alias("group_id"), F.lit("anchor").alias("side"), F.array("untrusted_source_id").alias("nodes"))
    own = groups.select(F.col("id").alias("group_id"), F.col("untrusted_source_id").alias("anchor"))
    sides = group_sides(groups, chains).filter("nodes is not null").join(own, "group_id").select("group_id", "side", F.filter("nodes", lambda n: F.coalesce(n != F.col("anchor"), F.lit(True))).alias("nodes"))
    parts = sides.unionByName(anchors).groupBy("group_id", "side").agg(F.array_distinct(F.flatten(F.collect_list("nodes"))).alias("chain_nodes"))
    found = guardrails_of_chains(parts.withColumn("id", F.struct("group_id", "side")), graph)
    return found.select("chain_id.group_id", "chain_id.side", "guardrail_id")


def payloads(chains: DataFrame, graph: Graph) -> DataFrame:
    """(id, payload): chains (id, chain_nodes, chain_edges) with their nodes, edges and guardrails as one JSON object; records
    that are not there have the kind ``unknown``."""
    n = graph.nodes.select(F.col("id").alias("ref"), "kind", "name", "capabilities", "observed_by", "confidence", "attributes")
    e = graph.edges.select(F.col("id").alias("ref"), "kind", "source_id", "target_id", "flow_kind", "capabilities", "observed_by", "edge_precision", "data_flow_confirmed", "attributes")
    unknown = F.coalesce("kind", F.lit("unknown")).alias("kind")

    def listed(rows: DataFrame, fields: list) -> DataFrame:
        return rows.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.struct(*fields).alias("r")))), lambda x: x["r"]).alias("items"))

    nodes = listed(chains.select("id", F.posexplode("chain_nodes").alias("pos", "ref")).join(n, "ref", "left"), [F.col("ref").alias("id"), unknown, F.coalesce("name", "ref").alias("name"), "capabilities", "observed_by", "confidence", "attributes"])
    edges = listed(chains.select("id", F.posexplode("chain_edges").alias("pos", "ref")).join(e, "ref", "left"), [F.col("ref").alias("id"), unknown, "source_id", "target_id", F.coalesce("flow_kind", F.lit("unknown")).alias("flow_kind"), "capabilities", "observed_by", F.col("edge_precision").alias("precision"), "data_flow_confirmed", "attributes"])
    guards = guardrails_of_chains(chains, graph).join(n.withColumnRenamed("ref", "guardrail_id"), "guardrail_id").groupBy(F.col("chain_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct(F.col("guardrail_id").alias("id"), "kind", "name", "capabilities", "observed_by", "attributes"))).alias("guardrails"))
    whole = chains.select("id").join(nodes.withColumnRenamed("items", "nodes"), "id", "left").join(edges.withColumnRenamed("items", "edges"), "id", "left").join(guards, "id", "left")
    return whole.select("id", F.to_json(F.struct(F.col("id").alias("chain_id"), "nodes", "edges", "guardrails")).alias("payload"))


PROMPT_VERSION = "s1"
SYSTEM_PROMPT = "You judge whether a chain of components lets untrusted input do harm. Answer with one JSON object: exploitable (true or false), confidence (0 to 1), reasoning (text), evidence (ids of edges of the chain that show it)."
JUDGE_PROMPT = "You settle what several reviewers say of one chain of components. Answer with one JSON object: verdict (exploitable, not_exploitable or uncertain), confidence (0 to 1), reasoning (text)."


def prompts(payload: DataFrame, opinions: DataFrame | None = None) -> DataFrame:
    """(id, prompt_version, system, user): what voters are asked about each payload, or, with ``opinions`` (chain_id, reasoning),
    what the judge is asked. Asking is left to a function over batches; where there is none, votes come from a table."""
    if opinions is None:
        return payload.select("id", F.lit(PROMPT_VERSION).alias("prompt_version"), F.lit(SYSTEM_PROMPT).alias("system"), F.concat(F.lit("The chain and its components:\n"), "payload").alias("user"))
    joined = payload.join(opinions.select(F.col("chain_id").alias("id"), "reasoning"), "id", "left")
    return joined.select("id", F.lit(PROMPT_VERSION).alias("prompt_version"), F.lit(JUDGE_PROMPT).alias("system"), F.concat(F.lit("The chain and its components:\n"), "payload", F.lit("\n\nThe reviewers:\n"), F.coalesce("reasoning", F.lit("(none)"))).alias("user"))


def ask(prompted: DataFrame, answer: Callable[[str, str], str | None], models: list[str]) -> DataFrame:
    """(id, model, answer): the answers of each model, from a function of the system's and the user's text; a null answer is one
    that never came."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([(i, m, answer(s, u)) for i, s, u in zip(pdf["id"], pdf["system"], pdf["user"]) for m in models], columns=["id", "model", "answer"])

    return prompted.select("id", "system", "user").mapInPandas(run, f"id {prompted.schema['id'].dataType.simpleString()}, model string, answer string")


def judged(aggregated: DataFrame, judge: DataFrame) -> DataFrame:
    """(chain_id, verdict, confidence): the judge's where it answered, else the voters'."""
    own = judge.select("chain_id", F.col("verdict").alias("jv"), F.col("confidence").alias("jc"))
    return aggregated.join(own, "chain_id", "left").select("chain_id", F.coalesce("jv", "verdict").alias("verdict"), F.when(F.col("jv").isNotNull(), F.col("jc")).otherwise(F.col("confidence")).alias("confidence"))


def best_answer(answers: DataFrame, cache: DataFrame) -> DataFrame:
    """Questions (content_hash, prompt_version, model_id) with their cached answers, null where one must be asked."""
    one = Window.partitionBy("content_hash", "prompt_version", "model_id").orderBy("answer")
    return answers.join(cache.withColumn("_n", F.row_number().over(one)).filter("_n = 1").drop("_n"), ["content_hash", "prompt_version", "model_id"], "left")
