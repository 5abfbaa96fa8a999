"""Queries of the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage
from ..tables import latest, table
from . import consensus as votes
from .handwritten import not_handwritten
from .leaks import leaks
from .lookalike_pairs import look_classes, same_look_members, same_look_pairs
from .lookalikes import canonical_column
from .packing import pack, room_left
from .topn import parted, top_n
from .validity import broken, broken_rates


# --- 2: top N of every group ------------------------------------------------------------------------------------------


def _best_groups(spark: SparkSession, folder: str) -> DataFrame:
    place = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for x in ("high", 0, "medium", 1, "low", 2)]), F.lower(F.trim("priority"))), F.lit(3))
    rows = table(spark, folder, "chain_groups").select("id", "untrusted_source_id", "score", place.alias("place"), "status", "updated_at")
    last = latest(parted(rows, "id", "part"), ["part", "id"], ["untrusted_source_id", "score", "place", "status"]).filter("status = 'active'")
    return top_n(last, "untrusted_source_id", "score", [F.col("place"), F.col("id")], 10, "part")


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return _best_groups(spark, folder).select("untrusted_source_id", F.col("id").alias("group_id"))


# --- 3: files that do not parse ---------------------------------------------------------------------------------------


def _broken(spark: SparkSession, folder: str) -> DataFrame:
    return broken(table(spark, folder, "file_entries"), table(spark, folder, "skipped_files"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return _broken(spark, folder).filter("bad").select("file_id")


def p3_rates(spark: SparkSession, folder: str) -> DataFrame:
    return broken_rates(_broken(spark, folder))


# --- 4: files nobody wrote by hand ------------------------------------------------------------------------------------


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return not_handwritten(table(spark, folder, "file_entries")).filter("other").select("file_id")


def p4_scores(spark: SparkSession, folder: str) -> DataFrame:
    scored = not_handwritten(table(spark, folder, "file_entries"))
    return scored.select("file_id", F.round("score", 4).alias("score"), "other")


# --- 5: consensus of voters -------------------------------------------------------------------------------------------


def _judged(spark: SparkSession, folder: str) -> tuple[DataFrame, votes.Panel]:
    rows = latest(table(spark, folder, "chains").withColumn("votes", votes.answers(F.col("voter_outputs"))), "id", ["id", "verdict", "confidence", "status", "votes"])
    rows = cut_lineage(rows)  # the fit and the result read it
    panel = votes.fit_voters(rows, "votes")
    return votes.consensus(rows, "votes", panel), panel


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    judged, _ = _judged(spark, folder)
    stored = F.when(F.lower(F.trim("verdict")) == "exploitable", True).when(F.lower(F.trim("verdict")) == "not_exploitable", False)
    return judged.filter(F.col("status").isin("active", "stale") & (stored != F.col("consensus"))).select(F.col("id").alias("chain_id"))


def p5_consensus(spark: SparkSession, folder: str) -> DataFrame:
    judged, _ = _judged(spark, folder)
    return judged.select(F.col("id").alias("chain_id"), "consensus", F.round("probability", 6).alias("probability"), F.round("agreement", 6).alias("agreement"), "confidence", "verdict")


def p5_voters(spark: SparkSession, folder: str) -> DataFrame:
    _, panel = _judged(spark, folder)
    rates = panel.rates(spark)
    return rates.select(
        "voter", F.round("answers").cast("bigint").alias("n_answers"), F.round(F.col("knows") - F.col("opposes"), 4).alias("reliability"), F.round("knows", 4).alias("knows"), F.round("opposes", 4).alias("opposes"),
        F.round("yes", 4).alias("guesses_yes"), F.round(F.col("right") / F.greatest("answers", F.lit(1.0)), 4).alias("agrees"), F.col("support_yes").alias("support_of_yes"), F.col("support_no").alias("support_of_no"),
    )


# --- 6: containers of tokens ------------------------------------------------------------------------------------------


def _packed(spark: SparkSession, folder: str) -> DataFrame:
    return pack(table(spark, folder, "documents"), table(spark, folder, "context_budgets"))


def p6_containers(spark: SparkSession, folder: str) -> DataFrame:
    return _packed(spark, folder)


def p6_room(spark: SparkSession, folder: str) -> DataFrame:
    return room_left(_packed(spark, folder), table(spark, folder, "context_budgets"), table(spark, folder, "documents"))


# --- 7: evaluation items in the corpus --------------------------------------------------------------------------------


def _leaks(spark: SparkSession, folder: str) -> DataFrame:
    return leaks(table(spark, folder, "documents"), table(spark, folder, "eval_items"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return _leaks(spark, folder).select("doc_id", "item_id")


def p7_items(spark: SparkSession, folder: str) -> DataFrame:
    found = _leaks(spark, folder).groupBy("item_id").agg(F.count(F.lit(1)).alias("n_docs"), F.round(F.max("share"), 6).alias("largest_share"), F.round(F.max("window_share"), 6).alias("largest_window"))
    return table(spark, folder, "eval_items").select("item_id", "suite").join(found, "item_id", "left").fillna(0, ["n_docs"])


# --- 8: texts of the same look ----------------------------------------------------------------------------------------


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return same_look_pairs(look_classes(table(spark, folder, "documents")))


def p8_classes(spark: SparkSession, folder: str) -> DataFrame:
    return same_look_members(look_classes(table(spark, folder, "documents")))


def p8_forms(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "documents").select("doc_id", canonical_column(F.col("text")).alias("form"), F.col("text"))
    return rows.select("doc_id", F.md5("form.text").alias("form_md5"), F.length("form.text").cast("bigint").alias("n_chars"), "form.mixed", "form.whole", (F.col("form.text") != F.col("text")).alias("changed"))


QUERIES = {"p2_found": p2_found, "p3_found": p3_found, "p3_rates": p3_rates, "p4_found": p4_found, "p4_scores": p4_scores, "p5_found": p5_found, "p5_consensus": p5_consensus, "p5_voters": p5_voters, "p6_containers": p6_containers, "p6_room": p6_room, "p7_found": p7_found, "p7_items": p7_items, "p8_found": p8_found, "p8_classes": p8_classes, "p8_forms": p8_forms}

SQL = {
    "p2_found": """
with last as (select * from chain_groups qualify row_number() over (partition by id order by updated_at desc) = 1)
select untrusted_source_id, id as group_id from last
where status = 'active' and score is not null and not isnan(score)
qualify row_number() over (partition by untrusted_source_id order by score desc,
  case lower(trim(priority)) when 'high' then 0 when 'medium' then 1 when 'low' then 2 else 3 end, id) <= 10
""",
}
