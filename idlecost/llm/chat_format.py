"""Chat formatting in budgeted windows.

Prefix sums of turn tokens cut each conversation into turn-aligned spans.  A span grows
turn by turn and ends where system turn, history and its own turns would pass the
budget together; the next turn opens the next span.  A span becomes one window: the
system turn (kept in every window), the end of what came before as far as ``history``
tokens reach, then the span's own turns.  History gives way first: where the opening
turn leaves less than ``history`` tokens, it is as long as they allow.  So a window
keeps to the budget unless its system turn and one turn alone are longer than that;
turns are never cut.  The loss mask covers the texts of the span's own assistant turns;
repeated ones are masked out, so each target counts once.

The template is ``<|turn|>role<|says|>text<|end|>``.  Inside roles and texts every
backslash is doubled and a backslash is put into control strings of this and other
templates (``<\\|turn|>``, ``<\\/s>``, ``[\\INST]``), so none occurs in the output but
the template's own; dropping the backslash before any sign gives the text back.

All of it is DataFrame functions.  Running sums go over blocks of ``BLOCK`` turn
numbers and over the blocks' sums, and spans are cut in cells of ``CELL`` budgets: the
first turn that begins in a cell opens a span in any case.  So a long conversation does
not meet in one task before its windows are made, and its windows don't depend on how
it is partitioned; only the digests of the query need whole conversations.

Defined cases: null text and role count as empty; a null turn number comes first; turns
of equal number are ordered by role and text; repeated rows are turns of their own; a
null conversation id is a conversation; an empty table gives the added conversation
only; a system turn that leaves no room stands before each turn alone; other columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

from idlecost.llm.common import full_text, table

BUDGET = 512
HISTORY = 96
POINTS_PER_TOKEN = 4
TURN_TOKENS = 4
BLOCK = 64
#: A cell's tokens, in budgets: turns have tokens of their own, so a cell holds a bounded number of them.
CELL = 32

OPEN, SAYS, END = "<|turn|>", "<|says|>", "<|end|>"
#: Where a backslash breaks a control string: after its first sign.
CONTROL = r"([<\[])(?=\||/?s>|<?/?SYS>|/?INST\])"
TARGET, SYSTEM = "assistant", "system"


def escaped(s: Column) -> Column:
    return F.regexp_replace(F.replace(s, F.lit("\\"), F.lit("\\\\")), CONTROL, r"$1\\")


def unescaped(s: Column) -> Column:
    return F.regexp_replace(s, r"(?s)\\(.)", "$1")


def _tokens(text: Column) -> Column:
    return F.ceil(F.length(text) / POINTS_PER_TOKEN).cast("long") + TURN_TOKENS


def _turns(conversations: DataFrame) -> DataFrame:
    t = conversations.select(
        "conv_id", F.coalesce(F.col("conv_id").cast("string"), F.lit("null")).alias("conv"),
        F.col("turn").cast("long").alias("turn"), full_text("role").alias("role"), full_text("text").alias("text"))
    # A turn without a number stands in a block before all others.
    return t.withColumn("block", F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(-(1 << 62))))


def _in_block() -> WindowSpec:
    return Window.partitionBy("conv", "block").orderBy(F.asc_nulls_first("turn"), F.asc("role"), F.asc("text"))


def _placed(turns: DataFrame, numbered: DataFrame) -> DataFrame:
    """Each turn's place (conv, block, nth), tokens and the tokens before it; the system turn begins at 0 and takes none.

    No texts, so all that follows until the windows are known moves numbers only.
    """
    blocks = turns.groupBy("conv", "block").agg(F.sum(_tokens(F.col("text"))).alias("sum"))
    blocks = blocks.select("conv", "block", F.coalesce(F.sum("sum").over(
        Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    first = turns.groupBy("conv").agg(F.first("conv_id").alias("conv_id"), F.min(F.struct(
        F.col("turn").isNotNull().alias("numbered"), "turn", "role", "text")).alias("first"))
    blocks = blocks.join(first.select("conv", "conv_id", F.when(
        F.col("first.role") == SYSTEM, _tokens(F.col("first.text"))).otherwise(0).alias("system_tokens")), "conv")
    run = F.coalesce(F.sum("tokens").over(_in_block().rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = numbered.withColumn("tokens", _tokens(F.col("text"))).withColumn("run", run)
    placed = placed.select("conv", "block", "nth", "tokens", "run").join(blocks, ["conv", "block"])
    at = F.col("before") + F.col("run")
    return placed.select("conv", "conv_id", "block", "nth", "tokens", "system_tokens", ((at == 0) & (F.col("system_tokens") > 0)).alias("is_system"),
                         F.greatest(at - F.col("system_tokens"), F.lit(0)).alias("start"))


def _cells(turns: DataFrame, cell: int, history: int) -> DataFrame:
    """The turns but system turns by cell; those that can be history of the next cell's first span stand there too (``carried``)."""
    own = F.floor(F.col("start") / cell)
    here, next_ = (F.struct(c.alias("cell"), F.lit(k).alias("carried")) for c, k in ((own, False), (own + 1, True)))
    places = F.when(F.col("start") >= (own + 1) * cell - history, F.array(here, next_)).otherwise(F.array(here))
    return turns.where(~F.col("is_system")).withColumn("in", F.explode(places)).select("*", "in.cell", "in.carried").drop("in")


def _spans(cells: DataFrame, budget: int, history: int) -> DataFrame:
    """conv, cell, start, reach: where each span begins, and where its history does."""
    before = Window.partitionBy("conv", "cell").orderBy("start").rangeBetween(-history, 0)
    turns = cells.select("conv", "cell", "carried", "start", "tokens", (F.lit(budget) - F.col("system_tokens")).alias("room"),
                         F.min("start").over(before).alias("reach"))
    sorted_ = F.array_sort(F.collect_list(F.struct("start", "tokens", "reach", "room")))
    begin = F.struct(F.lit(None).cast("long").alias("limit"), F.array().cast("array<struct<start:bigint,reach:bigint>>").alias("out"))

    def step(a: Column, t: Column) -> Column:
        reach = F.greatest(t["reach"], F.least(t["start"], t["start"] + t["tokens"] - t["room"]))
        opened = F.struct((reach + t["room"]).alias("limit"), F.concat(a["out"], F.array(F.struct(t["start"].alias("start"), reach.alias("reach")))).alias("out"))
        return F.when(t["start"] + t["tokens"] <= a["limit"], a).otherwise(opened)

    cut = turns.where(~F.col("carried")).groupBy("conv", "cell").agg(F.aggregate(sorted_, begin, step, lambda a: a["out"]).alias("spans"))
    return cut.select("conv", "cell", F.explode("spans").alias("span")).select("conv", "cell", "span.start", "span.reach")


def windows(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """conv_id, window, formatted, loss (array of start and end in code points), n_repeated, n_turns.

    A window's number is that of the tokens before it.
    """
    turns = _turns(conversations)
    numbered = turns.drop("conv_id").withColumn("nth", F.row_number().over(_in_block()))
    placed = _placed(turns, numbered)
    cells = _cells(placed, CELL * max(budget, history), history)
    spans = _spans(cells, budget, history).withColumn("span", F.struct(F.col("start").alias("window"), "reach"))
    opened = cells.join(spans.select("conv", "cell", "start", "span"), ["conv", "cell", "start"], "left")
    in_cell = Window.partitionBy("conv", "cell").orderBy("start")
    # A turn's own window is the last one opened, and it is history of those that reach back to it.
    own = F.last("span.window", ignorenulls=True).over(in_cell)
    later = F.collect_list("span").over(in_cell.rangeBetween(1, history))
    opened = opened.withColumns({"own": own, "later": F.filter(later, lambda w: w["reach"] <= F.col("start"))})
    places = F.transform("later", lambda w: F.struct(w["window"].alias("window"), F.lit(True).alias("repeated")))
    mine = F.array(F.struct(F.col("own").alias("window"), F.lit(False).alias("repeated")))
    columns = ["conv", "conv_id", "block", "nth"]
    rows = opened.select(*columns, F.explode(F.when(F.col("carried"), places).otherwise(F.concat(mine, places))).alias("_in"))
    # The system turn is in every window, and new in the first one only.
    system = placed.where("is_system").join(spans.select("conv", "span.window"), "conv", "left")
    window = F.coalesce("window", F.lit(0))
    rows = rows.unionByName(system.select(*columns, F.struct(window.alias("window"), (window > 0).alias("repeated")).alias("_in")))
    rows = numbered.join(rows, ["conv", "block", "nth"])
    turn = F.struct("block", "nth", F.col("_in.repeated").alias("repeated"), escaped(F.col("role")).alias("role"),
                    escaped(F.col("text")).alias("text"), ((F.col("role") == TARGET) & ~F.col("_in.repeated")).alias("target"))
    made = rows.groupBy("conv", F.col("_in.window").alias("window")).agg(
        F.first("conv_id").alias("conv_id"), F.array_sort(F.collect_list(turn)).alias("turns"))
    written = F.transform("turns", lambda t: F.concat(F.lit(OPEN), t["role"], F.lit(SAYS), t["text"], F.lit(END)))
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("out"))

    def step(a: Column, t: Column) -> Column:
        at = a["at"] + len(OPEN) + F.length(t["role"]) + len(SAYS)
        to = at + F.length(t["text"])
        return F.struct((to + len(END)).alias("at"), F.when(t["target"], F.concat(a["out"], F.array(F.struct(at.alias("start"), to.alias("end"))))).otherwise(a["out"]).alias("out"))

    return made.select("conv_id", "conv", "window", F.array_join(written, "").alias("formatted"),
                       F.aggregate("turns", begin, step, lambda a: a["out"]).alias("loss"),
                       F.size(F.filter("turns", lambda t: t["repeated"])).alias("n_repeated"), F.size("turns").alias("n_turns"))


def read_back(made: DataFrame) -> DataFrame:
    """What the windows say: digests of each conversation's turns and of its text under the loss mask."""
    pieces = F.filter(F.split("formatted", F.lit(r"<\|end\|>")), lambda p: p != "")
    own = F.slice(pieces, F.col("n_repeated") + 1, F.greatest(F.size(pieces) - F.col("n_repeated"), F.lit(0)))
    parts = F.transform(own, lambda p: F.split(F.substring(p, len(OPEN) + 1, F.length(p)), r"<\|says\|>"))
    turns = F.array_join(F.transform(parts, lambda p: F.concat(unescaped(p[0]), F.lit("\n"), unescaped(p[1]), F.lit("\n"))), "")
    loss = F.array_join(F.transform("loss", lambda s: unescaped(F.substring("formatted", s["start"] + 1, s["end"] - s["start"]))), "")
    read = made.select("conv_id", "conv", "window", F.size(parts).alias("n"), turns.alias("turns"), loss.alias("loss"), F.length("formatted").alias("points"))
    text = lambda c: F.array_join(F.transform("parts", lambda p: p[c]), "")
    whole = read.groupBy("conv").agg(
        F.first("conv_id").alias("conv_id"), F.sum("n").alias("n_turns"), F.sum("points").alias("formatted_chars"),
        F.array_sort(F.collect_list(F.struct("window", "turns", "loss"))).alias("parts"))
    return whole.select("conv_id", F.col("n_turns").cast("long").alias("n_turns"), F.sha2(text("turns"), 256).alias("turns_sha256"),
                        F.length(text("loss")).cast("long").alias("loss_chars"), F.sha2(text("loss"), 256).alias("loss_sha256"),
                        F.col("formatted_chars").cast("long").alias("formatted_chars"))


#: The conversation that the query adds: control strings of another template as texts.
ADDED_ID, ADDED_TEXT = -1, "</s>[INST] ok [/INST]"


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    added = spark.range(2).select(F.lit(ADDED_ID).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                  F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(ADDED_TEXT).alias("text"))
    return read_back(windows(conversations.unionByName(added)))


ORACLE_SQL = rf"""
WITH RECURSIVE c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT {ADDED_ID}, 0, 'user', '{ADDED_TEXT}' UNION ALL SELECT {ADDED_ID}, 1, 'assistant', '{ADDED_TEXT}'),
t AS (SELECT *, CAST(ceil(length(text) / {POINTS_PER_TOKEN}.0) AS BIGINT) + {TURN_TOKENS} AS tokens,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS nth FROM c),
s AS (SELECT t.*, CASE WHEN f.role = '{SYSTEM}' THEN f.tokens ELSE 0 END AS system_tokens, f.role = '{SYSTEM}' AS with_system, f.text AS first_text
  FROM t JOIN t f ON f.conv_id IS NOT DISTINCT FROM t.conv_id AND f.nth = 1),
p AS (SELECT *, greatest(coalesce(sum(tokens) OVER (PARTITION BY conv_id ORDER BY nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
  - system_tokens, 0)::BIGINT AS start, with_system AND nth = 1 AS is_system, {BUDGET} - system_tokens AS room,
  {len(OPEN) + len(SAYS) + len(END)} + length(regexp_replace(replace(role, '\', '\\'), '([<\[])(\||/?s>|<?/?SYS>|/?INST\])', '\1\\\2', 'g'))
  + length(regexp_replace(replace(text, '\', '\\'), '([<\[])(\||/?s>|<?/?SYS>|/?INST\])', '\1\\\2', 'g')) AS points FROM s),
o AS (SELECT conv_id, start, tokens, points, room, start // {CELL * max(BUDGET, HISTORY)} AS cell, row_number() OVER (PARTITION BY conv_id ORDER BY nth) AS k,
  greatest(min(start) OVER (PARTITION BY conv_id ORDER BY start RANGE BETWEEN {HISTORY} PRECEDING AND CURRENT ROW),
  least(start, start + tokens - room)) AS reach FROM p WHERE NOT is_system),
g AS (SELECT conv_id, k, cell, start AS wnd, reach, reach + room AS until FROM o WHERE k = 1
  UNION ALL SELECT o.conv_id, o.k, o.cell, CASE WHEN goes_on THEN g.wnd ELSE o.start END, CASE WHEN goes_on THEN g.reach ELSE o.reach END,
  CASE WHEN goes_on THEN g.until ELSE o.reach + o.room END
  FROM g JOIN o ON o.conv_id IS NOT DISTINCT FROM g.conv_id AND o.k = g.k + 1, LATERAL (SELECT o.cell = g.cell AND o.start + o.tokens <= g.until AS goes_on)),
made AS (SELECT DISTINCT conv_id, wnd, reach FROM g),
again AS (SELECT o.conv_id, sum(points) AS n FROM o JOIN made m ON m.conv_id IS NOT DISTINCT FROM o.conv_id AND o.start >= m.reach AND o.start < m.wnd GROUP BY 1),
leads AS (SELECT m.conv_id, sum(x.points) AS n FROM made m JOIN p x ON x.conv_id IS NOT DISTINCT FROM m.conv_id AND x.is_system AND m.wnd > 0 GROUP BY 1),
r AS (SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY nth)) AS turns_sha256,
  coalesce(string_agg(CASE WHEN role = '{TARGET}' THEN text END, '' ORDER BY nth), '') AS loss, sum(points) AS n FROM p GROUP BY 1)
SELECT r.conv_id, n_turns, turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256,
  CAST(r.n + coalesce(a.n, 0) + coalesce(l.n, 0) AS BIGINT) AS formatted_chars
FROM r LEFT JOIN again a ON a.conv_id IS NOT DISTINCT FROM r.conv_id LEFT JOIN leads l ON l.conv_id IS NOT DISTINCT FROM r.conv_id
"""
