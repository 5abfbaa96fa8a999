"""References to records that do not exist, found by key bitmaps.

Keys are dictionary-encoded: a key's code is its hash bucket (a key range) and its rank within the bucket. Per key range
and day, references and the births and deaths of parents become bitmaps of 64-bit words; words without a set bit are not
stored. A running OR over the days turns births and deaths into the parents that lived all through a day, and
``references AND NOT parents`` leaves the bits that may be orphans. Surviving bits are decoded through the dictionary, and
only their references are looked at again, with the exact times.

Everything is built-in expressions: no Python touches a row, no bitmap is built on the driver. A key that a third of all
references name is one dictionary row per day after map-side combine, and its references are salted in the last join.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from ..tables import clean_key

#: The day of references without a time: after all others, where only parents that never came count as missing.
NO_DAY = 4_000_000
#: The day of birth of parents without a creation time: before all others.
ALWAYS = -4_000_000


@dataclass(frozen=True)
class Citing:
    """A table with array columns of keys: its name, rows, id and time columns, and the target of each array column."""

    name: str
    rows: DataFrame
    fields: dict[str, str]
    id: str = "id"
    at: str = "created_at"


def _day(at: Column) -> Column:
    return F.datediff(at, F.lit("1970-01-01"))


def _cells(field: str, place: int, target: int) -> Column:
    keys = F.coalesce(F.col(field).cast("array<string>"), F.array().cast("array<string>"))
    return F.transform(keys, lambda x: F.struct(F.lit(place).cast("short").alias("place"), F.lit(target).cast("short").alias("target"), clean_key(x).alias("key")))


def references(citing: Iterable[Citing], names: list[str]) -> DataFrame:
    """(place, record_id, target, key, at) of every non-blank array element, one scan per table.

    ``place`` numbers the array columns of ``citing`` in order, ``target`` is an index into ``names``; small numbers keep
    the rows that are shuffled short. Null arrays and null or blank elements are no references. Repeated rows and elements
    stay repeated here.
    """
    parts, place = [], 0
    for c in citing:
        cells = []
        for field, target in c.fields.items():
            cells.append(_cells(field, place, names.index(target)))
            place += 1
        parts.append(c.rows.select(F.col(c.id).cast("string").alias("record_id"), F.col(c.at).alias("at"), F.explode(F.concat(*cells)).alias("r")).select("r.place", "record_id", "r.target", "r.key", "at").filter("key is not null and key <> ''"))
    return reduce(DataFrame.unionByName, parts)


def _parents(targets: dict[str, DataFrame], id: str = "id", created: str = "created_at", updated: str = "updated_at", status: str = "status", gone: str = "stale") -> DataFrame:
    """(target, key, at, updated, gone) of every row of the target tables; ``target`` is the table's place in ``targets``."""
    parts = [rows.select(F.lit(i).cast("short").alias("target"), clean_key(F.col(id).cast("string")).alias("key"), F.col(created).alias("at"), F.col(updated).alias("updated"), F.coalesce(F.lower(F.trim(status)) == gone, F.lit(False)).alias("gone")) for i, rows in enumerate(targets.values())]
    return reduce(DataFrame.unionByName, parts).filter("key is not null and key <> ''")


def dictionary(refs: DataFrame, targets: dict[str, DataFrame], buckets: int) -> DataFrame:
    """One row per key that is cited or there: its code and what is known about it.

    (target, bucket, word, bit, key, days, there, born, died): ``days`` on which it is cited; ``there`` if the target table
    has it; ``born`` the smallest creation time (null: unknown, counts as always there); ``died`` the time of the latest row
    if that row is gone. References and parents are combined in one aggregation with map-side combine, so a key that a third
    of all references name is one short row per task.
    """
    cited = refs.select("target", "key", F.coalesce(_day(F.col("at")), F.lit(NO_DAY)).alias("day"))
    known = _parents(targets).select("target", "key", "at", F.struct("updated", "gone").alias("state"))
    both = cited.unionByName(known, allowMissingColumns=True)
    keys = both.groupBy("target", "key").agg(F.collect_set("day").alias("days"), F.min("at").alias("born"), F.max("state").alias("state"))
    return (
        keys.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int"))
        .withColumn("code", F.row_number().over(Window.partitionBy("target", "bucket").orderBy("key")) - 1)
        .select("target", "bucket", F.shiftright("code", 6).alias("word"), F.expr("shiftleft(1L, code & 63)").alias("bit"), "key", "days", F.col("state").isNotNull().alias("there"), "born", F.when(F.col("state.gone"), F.col("state.updated")).alias("died"))
    )


def survivors(coded: DataFrame) -> DataFrame:
    """(target, bucket, word, left): of each bitmap word the days on which references are left after AND NOT parents.

    ``left`` is an array of (day, bits). A birth counts from the day after, as on the day itself the key may still be
    missing at first; a death counts on its day. Whoever is cited on such a day is looked at with exact times later.
    """
    none = F.lit(0).cast("long")

    def event(day: Column, refs: Column = none, born: Column = none, died: Column = none) -> Column:
        return F.struct(day.alias("day"), refs.alias("refs"), born.alias("born"), died.alias("died"))

    bit = F.col("bit")
    births = F.when(F.col("there"), event(F.coalesce(_day(F.col("born")) + 1, F.lit(ALWAYS)), born=bit))
    deaths = F.when(F.col("died").isNotNull(), event(_day(F.col("died")), died=bit))
    events = F.concat(F.transform("days", lambda day: event(day, refs=bit)), F.filter(F.array(births, deaths), lambda x: x.isNotNull()))
    words = coded.select("target", "bucket", "word", F.explode(events).alias("e")).groupBy("target", "bucket", "word", F.col("e.day").alias("day")).agg(*[F.bit_or(f"e.{c}").alias(c) for c in ("refs", "born", "died")])
    so_far = Window.partitionBy("target", "bucket", "word").orderBy("day").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    there = words.select("target", "bucket", "word", "day", "refs", F.bit_or("born").over(so_far).alias("b"), F.bit_or("died").over(so_far).alias("d"))
    left = there.select("target", "bucket", "word", "day", F.expr("refs & ~(b & ~d)").alias("bits")).filter("bits <> 0")
    return left.groupBy("target", "bucket", "word").agg(F.collect_list(F.struct("day", "bits")).alias("left"))


def _may_contain(rows: DataFrame, wanted: DataFrame, columns: list[str], bits: int) -> DataFrame:
    """``rows`` without most of those whose ``columns`` are not in ``wanted``: a one-hash filter of ``bits`` bits.

    The filter is a table of at most ``bits / 64`` words, whatever the size of ``wanted``, so it can be broadcast; a full
    filter lets every row pass.
    """
    at = F.pmod(F.xxhash64(*columns), F.lit(bits))
    words = wanted.select(F.shiftright(at, 6).cast("int").alias("_slot"), F.expr(f"shiftleft(1L, cast(pmod(xxhash64({', '.join(columns)}), {bits}) & 63 as int))").alias("_b")).groupBy("_slot").agg(F.bit_or("_b").alias("_set"))
    marked = rows.withColumn("_at", at).withColumn("_slot", F.shiftright("_at", 6).cast("int"))
    return marked.join(F.broadcast(words), "_slot").filter("(shiftright(_set, cast(_at & 63 as int)) & 1) = 1").drop("_slot", "_at", "_set")


def orphan_references(citing: list[Citing], targets: dict[str, DataFrame], buckets: int | None = None, salts: int = 16, filter_bits: int = 1 << 23) -> DataFrame:
    """(ref_table, record_id, ref_field, ref_key, month, reason) of every orphan reference, one row each.

    A reference is an orphan if its target has no record of that key (``missing``), only one created later than the citing
    record (``later``), or one that was gone when the citing record was created (``gone``). A citing record without a time
    can only miss its target; a target table without rows makes every reference to it ``missing``. ``month`` is the first
    day of the citing record's month, null without a time. ``buckets`` (default: sixteen for each shuffle partition) is
    the number of key ranges, ``salts`` into how many parts the references to one key are split, ``filter_bits`` the fixed
    size of the filter that keeps references without a surviving bit from being shuffled.
    """
    spark = citing[0].rows.sparkSession
    buckets = buckets or 16 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    refs = references(citing, list(targets))
    coded = dictionary(refs, targets, buckets)
    decoded = coded.filter(F.size("days") > 0).join(survivors(coded), ["target", "bucket", "word"])
    decoded = decoded.select("target", "key", "there", "born", "died", F.explode(F.filter("left", lambda x: x["bits"].bitwiseAND(F.col("bit")) != 0)).alias("left")).select("target", "key", F.col("left.day").alias("day"), "there", "born", "died")
    decoded = cut_lineage(decoded)

    cited = _may_contain(refs.withColumn("day", F.coalesce(_day(F.col("at")), F.lit(NO_DAY))), decoded, ["target", "key", "day"], filter_bits)
    salted = cited.withColumn("salt", F.pmod(F.xxhash64("record_id", "place"), F.lit(salts)).cast("int"))
    spread = decoded.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    reason = F.when(~F.col("there"), "missing").when(F.col("born") > F.col("at"), "later").when(F.col("died") <= F.col("at"), "gone")
    found = salted.join(spread, ["target", "key", "day", "salt"]).withColumn("reason", reason).filter("reason is not null").groupBy("place", "record_id", "key").agg(F.min(F.trunc("at", "month")).alias("month"), F.min("reason").alias("reason"))
    places = [(c.name, field) for c in citing for field in c.fields]
    table_of, field_of = (F.array(*[F.lit(p[i]) for p in places]) for i in (0, 1))
    return found.select(F.get(table_of, F.col("place")).alias("ref_table"), "record_id", F.get(field_of, F.col("place")).alias("ref_field"), F.col("key").alias("ref_key"), "month", "reason")


def orphan_report(found: DataFrame) -> DataFrame:
    """(ref_table, ref_field, month, reason, n_refs, n_records) of ``orphan_references``."""
    return found.groupBy("ref_table", "ref_field", "month", "reason").agg(F.count(F.lit(1)).alias("n_refs"), F.countDistinct("record_id").alias("n_records"))
