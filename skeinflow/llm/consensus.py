"""Consensus of several voters' yes/no answers by a competence-and-spamming mixture.

Every answer has one of three origins: the voter knew the truth and said it (competence), the voter drew it from its own
guess distribution (spamming), or the voter said the opposite of the truth (contrarian, for voters that are worth less
than nothing). Expectation-maximisation yields the truth of every item and the three rates of every voter.

Items with equal answers are one weighted pattern, so the data that the iterations read is bounded by the answer patterns
of the panel, not by the items. An iteration is one aggregation of built-in expressions that returns four numbers per
voter; only those reach the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage
from ..tables import clean_key


@dataclass
class Voter:
    """Rates of one voter: ``knows`` the truth, ``opposes`` it, else guesses yes with probability ``yes``; ``answers`` given."""

    name: str
    knows: float = 0.5
    opposes: float = 0.05
    yes: float = 0.5
    answers: float = 0.0
    right: float = 0.0

    def chance(self, truth: int, answer: int) -> float:
        """Probability of the answer under the truth."""
        guess = (1 - self.knows - self.opposes) * (self.yes if answer else 1 - self.yes)
        return guess + (self.knows if truth == answer else self.opposes)

    def support(self, answer: int) -> float:
        """Log odds that the answer lends to yes."""
        return round(math.log(self.chance(1, answer) / self.chance(0, answer)), 9)

    def refit(self, counts: list[list[float]], steps: int = 10) -> None:
        """New rates from expected ``counts[truth][answer]``; half an answer of each kind keeps them off 0 and 1."""
        self.answers = sum(map(sum, counts))
        self.right = counts[0][0] + counts[1][1]
        for _ in range(steps):
            knows = opposes = 0.5
            guesses = [0.5, 0.5]
            for truth in (0, 1):
                for answer in (0, 1):
                    n, chance = counts[truth][answer], self.chance(truth, answer)
                    direct = self.knows if truth == answer else self.opposes
                    share = n * direct / chance
                    if truth == answer:
                        knows += share
                    else:
                        opposes += share
                    guesses[answer] += n - share
            total = knows + opposes + sum(guesses)
            self.knows, self.opposes, self.yes = knows / total, opposes / total, guesses[1] / sum(guesses)


def answers(outputs: Column) -> Column:
    """The usable answers of an array of votes as ARRAY<STRUCT<voter, yes>>, sorted by voter.

    A vote is usable if it did not time out and says yes or no; of several by one voter (names compared clean) the last in
    the array counts. Votes without a name are not usable; a null array has no votes.
    """
    usable = F.filter(outputs, lambda v: v.isNotNull() & (v["timeout"] == F.lit(False)) & v["exploitable"].isNotNull() & v["model"].isNotNull())
    names = F.reverse(F.transform(usable, lambda v: clean_key(v["model"])))
    said = F.reverse(F.transform(usable, lambda v: v["exploitable"]))
    found = F.transform(F.array_sort(F.array_distinct(names)), lambda n: F.struct(n.alias("voter"), F.get(said, (F.array_position(names, n) - 1).cast("int")).alias("yes")))
    return F.coalesce(F.filter(found, lambda v: v["voter"] != ""), F.array().cast("array<struct<voter:string,yes:boolean>>"))


def _log_odds(codes: Column, support: list[float]) -> Column:
    table = F.array(*[F.lit(x) for x in support])
    return F.aggregate(codes, F.lit(0.0), lambda total, code: total + F.get(table, code))


def _probability(log_odds: Column) -> Column:
    return 1 / (1 + F.exp(-log_odds))


#: Columns of a panel kept as a table.
RATES = "voter string, knows double, opposes double, yes double, answers double, right double, support_yes double, support_no double"


@dataclass
class Panel:
    """The fitted voters: a list on the driver for a short panel, else a table. The rates are the same either way."""

    voters: list[Voter] | None = None
    table: DataFrame | None = None

    def rates(self, spark: SparkSession) -> DataFrame:
        """One row per voter, with the columns of ``RATES``."""
        if self.table is not None:
            return self.table
        return spark.createDataFrame([_row(v) for v in self.voters or []], RATES)


def _row(v: Voter) -> tuple:
    return v.name, v.knows, v.opposes, v.yes, float(v.answers), float(v.right), v.support(1), v.support(0)


def fit_voters(items: DataFrame, votes: str, max_rounds: int = 60, tolerance: float = 1e-4, short_panel: int = 500) -> Panel:
    """Rates of every voter of ``items``, whose column ``votes`` has what ``answers`` returns.

    Starts from unweighted majorities and ends when no voter's support moves by more than ``tolerance``, or after
    ``max_rounds``. The rates of up to ``short_panel`` voters are kept on the driver and become literals of the plans; those
    of more voters stay in a table that is joined. No items, or none with answers, give no voters.
    """
    patterns = cut_lineage(items.select(F.col(votes).alias("votes")).filter(F.size("votes") > 0).groupBy("votes").agg(F.count(F.lit(1)).alias("n")))
    names = [r[0] for r in patterns.select(F.explode(F.col("votes")["voter"]).alias("v")).distinct().limit(short_panel + 1).collect()]
    if len(names) > short_panel:
        return Panel(table=_fit_table(patterns, max_rounds, tolerance))
    if not names:
        return Panel([])
    voters = [Voter(n) for n in sorted(names)]
    coded = cut_lineage(patterns.select(_codes("votes", voters).alias("codes"), "n"))
    support = [1.0 if code % 2 else -1.0 for code in range(2 * len(voters))]
    for _ in range(max_rounds):
        p = _probability(_log_odds(F.col("codes"), support))
        sums = coded.select((F.col("n") * p).alias("yes"), (F.col("n") * (1 - p)).alias("no"), F.explode("codes").alias("code")).groupBy("code").agg(F.sum("no"), F.sum("yes")).collect()
        counts = [[[0.0, 0.0], [0.0, 0.0]] for _ in voters]
        for code, no, yes in sums:
            counts[code // 2][0][code % 2] = no
            counts[code // 2][1][code % 2] = yes
        for voter, own in zip(voters, counts):
            voter.refit(own)
        last, support = support, [v.support(answer) for v in voters for answer in (0, 1)]
        if max(abs(a - b) for a, b in zip(last, support)) <= tolerance:
            break
    return Panel(voters)


def _codes(votes: str, voters: list[Voter]) -> Column:
    index = F.create_map(*[x for i, v in enumerate(voters) for x in (F.lit(v.name), F.lit(2 * i))])
    return F.transform(F.col(votes), lambda v: F.element_at(index, v["voter"]) + v["yes"].cast("int"))


def _refit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for r in pdf.itertuples(index=False):
            voter = Voter(r.voter, r.knows, r.opposes, r.yes)
            voter.refit([[r.no_no, r.no_yes], [r.yes_no, r.yes_yes]])
            rows.append((*_row(voter), max(abs(voter.support(1) - r.support_yes), abs(voter.support(0) - r.support_no))))
        yield pd.DataFrame(rows, columns=[*(c.split()[0] for c in RATES.split(", ")), "moved"])


def _supported(cells: DataFrame, rates: DataFrame, salts: int = 16) -> DataFrame:
    """``cells`` (row, voter, yes, ...) with the support each answer lends; one voter's answers are spread over ``salts`` keys."""
    spread = rates.select("voter", "support_yes", "support_no").withColumn("salt", F.explode(F.array(*[F.lit(k) for k in range(salts)])))
    salted = cells.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(salts)).cast("int"))
    return salted.join(spread, ["voter", "salt"]).withColumn("support", F.when(F.col("yes"), F.col("support_yes")).otherwise(F.col("support_no"))).drop("salt", "support_yes", "support_no")


def _fit_table(patterns: DataFrame, max_rounds: int, tolerance: float) -> DataFrame:
    """The rounds of ``fit_voters`` as joins and aggregations; only the largest movement reaches the driver."""
    numbered = cut_lineage(patterns.withColumn("row", F.monotonically_increasing_id()))
    cells = cut_lineage(numbered.select("row", "n", F.explode("votes").alias("v")).select("row", "n", "v.voter", "v.yes"))
    start = Voter("")
    rates = cells.select("voter").distinct().select("voter", F.lit(start.knows).alias("knows"), F.lit(start.opposes).alias("opposes"), F.lit(start.yes).alias("yes"), F.lit(1.0).alias("support_yes"), F.lit(-1.0).alias("support_no"))
    for _ in range(max_rounds):
        odds = _supported(cells, rates).groupBy("row").agg(F.sum("support").alias("odds")).select("row", _probability(F.col("odds")).alias("p"))
        yes, weight = F.col("yes"), F.col("n") * F.col("p")
        rest = F.col("n") - weight
        counts = cells.join(odds, "row").groupBy("voter").agg(F.sum(F.when(~yes, rest).otherwise(0.0)).alias("no_no"), F.sum(F.when(yes, rest).otherwise(0.0)).alias("no_yes"), F.sum(F.when(~yes, weight).otherwise(0.0)).alias("yes_no"), F.sum(F.when(yes, weight).otherwise(0.0)).alias("yes_yes"))
        moved = cut_lineage(rates.select("voter", "knows", "opposes", "yes", "support_yes", "support_no").join(counts, "voter").mapInPandas(_refit, RATES + ", moved double"))
        rates = moved.drop("moved")
        if moved.agg(F.max("moved")).first()[0] <= tolerance:
            break
    return rates


def consensus(items: DataFrame, votes: str, panel: Panel) -> DataFrame:
    """``items`` with ``consensus`` (true: yes), ``probability`` of it and ``agreement``.

    ``agreement`` is the share of the item's voters that gave the consensus answer. An item without answers, or with
    exactly balanced support, has the consensus null; the agreement is then null as well. Columns that ``items`` has of these
    three names are replaced.
    """
    row, odd = ("_" * max(map(len, items.columns)) + x for x in ("_row", "_odds"))  # longer than any column's name
    if panel.table is None:
        odds = _log_odds(_codes(votes, panel.voters), [v.support(answer) for v in panel.voters for answer in (0, 1)]) if panel.voters else F.lit(0.0)
        rows = items.withColumn(odd, odds)
    else:
        numbered = cut_lineage(items.withColumn(row, F.monotonically_increasing_id()))
        cells = numbered.select(F.col(row).alias("row"), F.explode(votes).alias("v")).select("row", "v.voter", "v.yes")
        sums = _supported(cells, panel.table).groupBy("row").agg(F.sum("support").alias(odd)).withColumnRenamed("row", row)
        rows = numbered.join(sums, row, "left").withColumn(odd, F.coalesce(odd, F.lit(0.0)))
    odds = F.col(odd)
    yes = F.when((F.size(votes) > 0) & (F.abs(odds) > 1e-12), odds > 0)
    same = F.size(F.filter(F.col(votes), lambda v: v["yes"] == (odds > 0)))
    return rows.select(*[c for c in items.columns if c not in ("consensus", "probability", "agreement")], yes.alias("consensus"), F.when(yes.isNotNull(), _probability(F.abs(odds))).alias("probability"), F.when(yes.isNotNull(), same / F.size(votes)).alias("agreement"))
