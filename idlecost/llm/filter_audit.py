"""Filter interaction audit by the potential of the removal game.

The players are filters; a coalition S of them is worth v(S), the documents that fail
at least one of its filters.  The potential of Hart and Mas-Colell is built over all
coalitions from the empty one up: P(S) = (v(S) + sum of P(S without i) over i in S) / |S|.
A filter's Shapley value is P(all) - P(all without it); the differences
v(S with i) - v(S) give what filter i removes as the step after S, in any order.

1. Each document becomes one bit a failing filter; filters look at its text and words.
   Its text is kept as a 256-bit digest only, so nothing below moves texts.
2. The filter on copies fails every document whose text a smaller id has, too.  Rows
   of one id and text are counted first, then rows of one text, part and label: each such
   group keeps its count, its least id and the rows of that id.  So a text that a third
   of all rows share is a few rows before the step that compares its groups.
3. Counts by (part, failing filters), at most 2^n rows a part, hold all the rest.

Potentials are kept times n!, which makes them whole numbers: a Shapley value times n!
is the sum of the filter's removals over all n! orders.

Defined cases: a null text counts as empty, a null part as the empty string, a null
condition as not failing; a row without an id is never a copy and makes none, and has no
label; rows of one id and text are not copies of one another; of repeated labels any that says
1 counts; an empty table has no parts and so no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from idlecost.llm.common import SPACE_CLASS, full_text, table

#: A filter is told by a letter; its condition takes a document's text and its words.
Condition = Callable[[Column, Column], Column]


def _capitals(text: Column) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, "[A-Z]", ""))


# The filters of the contract.  COPIES compares with the whole table.
FILTERS: dict[str, Condition] = {
    "A": lambda text, words: F.size(words) < 200,
    "B": lambda text, words: 100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
    "C": lambda text, words: 100 * _capitals(text) > 3 * F.length(text),
    "D": lambda text, words: text.rlike("[#$%&*|]"),
}
COPIES = "E"


def failing(docs: DataFrame, filters: dict[str, Condition], id_col: str, text_col: str, part_col: str) -> DataFrame:
    """doc_id, part, digest, fails: the filters (bits, in their order) that every row of ``docs`` fails."""
    text = full_text(text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
                       text.alias("text"), F.array_remove(F.split(text, f"[{SPACE_CLASS}]+"), "").alias("words"))
    bits = [F.when(fails(F.col("text"), F.col("words")), 1 << i).otherwise(0) for i, fails in enumerate(filters.values())]
    return rows.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), reduce(add, bits, F.lit(0)).alias("fails"))


def failure_counts(flags: DataFrame, labels: DataFrame, copies_bit: int) -> DataFrame:
    """part, fails, n, good, toxic: documents by part and failing filters, copies included."""
    marks = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"),
        F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    # Rows without an id meet no label; a salt deals them out.
    salt = F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id() + 1).otherwise(0)
    rows = flags.withColumn("salt", salt).join(marks.withColumn("salt", F.lit(0).cast("long")), ["doc_id", "salt"], "left")
    rows = rows.fillna(False, ["good", "toxic"])
    same_row = rows.groupBy("doc_id", "salt", "digest", "part", "fails", "good", "toxic").agg(F.count("*").alias("n"))
    groups = same_row.groupBy("digest", "part", "fails", "good", "toxic", F.col("doc_id").isNull().alias("nameless")).agg(
        F.sum("n").alias("n"), F.min(F.struct("doc_id", "n")).alias("low"))
    least = F.min("low.doc_id").over(Window.partitionBy("digest"))
    copies = F.when(F.col("nameless"), 0).when(F.col("low.doc_id") == least, F.col("n") - F.col("low.n")).otherwise(F.col("n"))
    groups = groups.withColumn("copies", copies)
    split = F.explode(F.array(
        F.struct(F.col("fails").alias("fails"), (F.col("n") - F.col("copies")).alias("n")),
        F.struct(F.col("fails").bitwiseOR(copies_bit).alias("fails"), F.col("copies").alias("n")))).alias("s")
    return groups.select("part", "good", "toxic", split).groupBy("part", F.col("s.fails").alias("fails")).agg(
        F.sum("s.n").alias("n"), F.sum(F.when(F.col("good"), F.col("s.n")).otherwise(0)).alias("good"),
        F.sum(F.when(F.col("toxic"), F.col("s.n")).otherwise(0)).alias("toxic"))


def _worth(of: str, n: int) -> Column:
    """An array with the worth of each coalition: the sum of ``of`` over rows that fail one of its filters."""
    return F.array(*[F.sum(F.when(F.col("fails").bitwiseAND(s) != 0, F.col(of)).otherwise(0)) for s in range(1 << n)])


def potentials(worth: Column, n: int) -> Column:
    """The potential of each coalition times n!, from the worths of all coalitions."""
    def next_one(done: Column, s: Column) -> Column:
        without = [F.when(s.bitwiseAND(1 << i) != 0, F.get(done, s - (1 << i))).otherwise(0) for i in range(n)]
        total = reduce(add, without, F.get(worth, s) * math.factorial(n))
        return F.concat(done, F.array(F.call_function("div", total, F.bit_count(s)).cast("long")))

    return F.aggregate(F.sequence(F.lit(1), F.lit((1 << n) - 1)), F.array(F.lit(0).cast("long")), next_one)


def audit(counts: DataFrame, letters: str) -> DataFrame:
    """One row per part, order of all filters and step, from ``failure_counts``.

    kept: documents left after the step; removed: those it removes; redundant: those that
    fail its filter and went earlier; unique_fails: those that fail no other filter;
    good_lost, toxic_lost: removed ones with that label; shapley: the filter's removed,
    summed over all orders.
    """
    n = len(letters)
    whole = (1 << n) - 1
    games = counts.groupBy("part").agg(F.sum("n").alias("total"), _worth("n", n).alias("worth"), _worth("good", n).alias("good"),
                                       _worth("toxic", n).alias("toxic"))
    games = games.withColumn("potential", potentials(F.col("worth"), n)).withColumn("filter_order", F.lit(""))
    for _ in range(n):  # every order, letter by letter
        left = F.filter(F.array(*map(F.lit, letters)), lambda x: F.instr(F.col("filter_order"), x) == 0)
        games = games.withColumn("filter_order", F.explode(F.transform(left, lambda x: F.concat("filter_order", x))))

    def coalition(some: Column) -> Column:
        return reduce(add, [F.when(F.instr(some, F.lit(x)) > 0, 1 << i).otherwise(0) for i, x in enumerate(letters)])

    steps = games.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(n))))
    steps = steps.withColumns({"before": coalition(F.substr("filter_order", F.lit(1), F.col("step") - 1)),
                               "own": coalition(F.substr("filter_order", F.col("step"), F.lit(1)))})
    after = F.col("before") + F.col("own")

    def lost(worth: str) -> Column:
        return F.get(worth, after) - F.get(worth, F.col("before"))

    return steps.select(
        "part", "filter_order", "step", (F.col("total") - F.get("worth", after)).alias("kept"), lost("worth").alias("removed"),
        (F.get("worth", F.col("own")) - lost("worth")).alias("redundant"),
        (F.get("worth", F.lit(whole)) - F.get("worth", whole - F.col("own"))).alias("unique_fails"),
        lost("good").alias("good_lost"), lost("toxic").alias("toxic_lost"),
        (F.get("potential", F.lit(whole)) - F.get("potential", whole - F.col("own"))).alias("shapley"))


def filter_audit(docs: DataFrame, labels: DataFrame, filters: dict[str, Condition] | None = None, copies: str = COPIES,
                 id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """The audit of ``filters`` and the filter on copies (letter ``copies``) over the rows of ``docs``."""
    filters = FILTERS if filters is None else filters
    counts = failure_counts(failing(docs, filters, id_col, text_col, part_col), labels, 1 << len(filters))
    return audit(counts, "".join(filters) + copies)


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


ORACLE_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
l AS (SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic FROM labels GROUP BY doc_id),
f AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
         CASE WHEN len(words) < 200 THEN 'A' ELSE '' END
         || CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 'B' ELSE '' END
         || CASE WHEN 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 3 * length(t) THEN 'C' ELSE '' END
         || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END
         || CASE WHEN min(d.doc_id) OVER (PARTITION BY t) < d.doc_id THEN 'E' ELSE '' END AS fails
  FROM d LEFT JOIN l ON d.doc_id = l.doc_id),
c AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, fails),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS letter),
o AS (
  SELECT '' AS filter_order
  UNION ALL
  SELECT filter_order || letter FROM o, letters WHERE NOT contains(filter_order, letter)),
s AS (
  SELECT filter_order, CAST(step AS INT) AS step, substr(filter_order, CAST(step AS INT), 1) AS letter,
         substr(filter_order, 1, CAST(step - 1 AS INT)) AS earlier
  FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS step) WHERE length(filter_order) = 5),
p AS (SELECT DISTINCT part FROM c),
r AS (
  SELECT p.part, s.filter_order, s.step, s.letter,
         sum(CASE WHEN translate(c.fails, s.earlier || s.letter, '') = c.fails THEN c.n ELSE 0 END) AS kept,
         sum(CASE WHEN contains(c.fails, s.letter) AND translate(c.fails, s.earlier, '') = c.fails THEN c.n ELSE 0 END) AS removed,
         sum(CASE WHEN contains(c.fails, s.letter) AND translate(c.fails, s.earlier, '') <> c.fails THEN c.n ELSE 0 END) AS redundant,
         sum(CASE WHEN c.fails = s.letter THEN c.n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN contains(c.fails, s.letter) AND translate(c.fails, s.earlier, '') = c.fails THEN c.good ELSE 0 END) AS good_lost,
         sum(CASE WHEN contains(c.fails, s.letter) AND translate(c.fails, s.earlier, '') = c.fails THEN c.toxic ELSE 0 END) AS toxic_lost
  FROM p JOIN c ON c.part = p.part CROSS JOIN s GROUP BY p.part, s.filter_order, s.step, s.letter)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
       CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
       CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley
FROM r
"""
