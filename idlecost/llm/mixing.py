"""Mixing sources to target weights by hierarchical budgeting.

The tree is domain - language - source.  A budget of tokens (words) flows down: each
node's children share it by weight, none beyond what it holds times ``max_epochs``;
what a child can't use goes to its siblings by weight, and a node asks its parent for
no more than all its children hold, so shortages are settled among siblings before
they reach an ancestor.  This water level has a closed form: with the children sorted
by capacity over weight, a child is full if its share of what the earlier ones left
reaches its capacity.  All of it is integer arithmetic over one row a leaf; the
fractions of a token that a level can't split are left over.

Each leaf then takes whole epochs of its documents, and of one more the token prefix
that fits, in the seeded order of that epoch (md5 of seed, epoch and id).  The prefix
ends at a cut key: sums over the first three hex digits find the digit group of the
cut, and only that group's rows are put in order, so a source with a third of all
documents costs no more a task than any other.

Defined cases: null text counts as empty (0 tokens); null or unknown domain, language
or source is a leaf of its own with the default weight; children of weight 0 get
nothing; documents of equal key (repeated ids) are taken together or not at all; an
empty table gives an empty result; other columns are ignored by ``mixture`` and
returned unchanged by ``mix``.
"""

from __future__ import annotations

from collections.abc import Mapping
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from idlecost.llm.common import SPACE_CLASS, full_text, stored, table

LEVELS = ["domain", "lang", "source"]
NONE = "unknown"
HEX = 3


class Mix(NamedTuple):
    """Target weights (integers) by name at each level; names without one have ``default``."""

    domain_of: Mapping[str, str]  # source -> domain
    weights: Mapping[str, Mapping[str, int]]  # level -> name -> weight
    default: int = 1
    percent: int = 80  # of the corpus' tokens
    max_epochs: int = 2
    seed: str = "mix-1"


#: Production parameters: three domains of the sources src0 to src19.
PRODUCTION = Mix(
    domain_of={f"src{i}": "web" if i < 7 else "books" if i < 14 else "forum" for i in range(20)},
    weights={"domain": {"web": 50, "books": 30, "forum": 20}, "lang": {"en": 50, "de": 20, "fr": 15, "es": 15}, "source": {}},
)


def _lookup(names: Column, values: Mapping[str, object], other) -> Column:
    if not values:
        return F.lit(other)
    pairs = F.create_map(*[F.lit(x) for kv in values.items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, names), F.lit(other))


def _tree(docs: DataFrame, mix: Mix, id_col: str, text_col: str, lang_col: str, source_col: str) -> list[Column]:
    source = F.coalesce(F.col(source_col).cast("string"), F.lit(NONE))
    return [_lookup(source, mix.domain_of, NONE).alias("_domain"),
            F.coalesce(F.col(lang_col).cast("string"), F.lit(NONE)).alias("_lang"), source.alias("_source"),
            F.regexp_count(full_text(text_col), F.lit(f"[^{SPACE_CLASS}]+")).cast("long").alias("_tokens")]


def _key(mix: Mix, epoch: Column, id_col: str) -> Column:
    return F.md5(F.concat_ws(":", F.lit(mix.seed), epoch.cast("string"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"))


def _shared_out(nodes: DataFrame, parents: list[str], name: str) -> DataFrame:
    """``nodes`` (cap, weight, parent's budget) with each node's own budget."""
    by = Window.partitionBy(*parents) if parents else Window.partitionBy(F.lit(0))
    order = by.orderBy(F.col("_cap") / F.greatest("_weight", F.lit(1)), name)
    before, onward = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    nodes = nodes.withColumns({"_before": F.coalesce(F.sum("_cap").over(before), F.lit(0)), "_onward": F.sum("_weight").over(onward)})
    full = (F.col("_budget") - F.col("_before")) * F.col("_weight") >= F.col("_cap") * F.col("_onward")
    nodes = nodes.withColumn("_full", full & (F.col("_weight") > 0))
    nodes = nodes.withColumns({"_spent": F.sum(F.when(F.col("_full"), F.col("_cap")).otherwise(0)).over(by),
                               "_left": F.sum(F.when(F.col("_full"), 0).otherwise(F.col("_weight"))).over(by)})
    own = F.when(F.col("_full"), F.col("_cap")).otherwise(
        F.expr("IF(_left > 0, ((_budget - _spent) * _weight) div _left, 0)"))
    return nodes.withColumn("_own", own)


def leaf_budgets(leaves: DataFrame, mix: Mix) -> DataFrame:
    """_domain, _lang, _source, _tokens, _budget of every leaf, from the leaves' tokens."""
    names = [f"_{x}" for x in LEVELS]
    weight = {n: _lookup(F.col(n), mix.weights.get(x, {}), mix.default).cast("long") for n, x in zip(names, LEVELS, strict=True)}
    # Capacity: what a node holds in all epochs, nothing below a weight of 0.
    reach = F.lit(True)
    for n in names:
        reach = reach & (weight[n] > 0)
    leaves = leaves.withColumn("_cap", F.when(reach, F.col("_tokens") * mix.max_epochs).otherwise(0).cast("long"))
    total = leaves.agg(F.coalesce(F.sum("_tokens"), F.lit(0)).alias("_all"), F.coalesce(F.sum("_cap"), F.lit(0)).alias("_most"))
    nodes = total.select(F.least(F.expr(f"_all * {mix.percent} div 100"), F.col("_most")).alias("_budget"))
    for depth in range(1, len(names) + 1):
        own = leaves.groupBy(*names[:depth]).agg(F.sum("_cap").alias("_cap"), F.sum("_tokens").alias("_tokens"))
        parents = names[:depth - 1]
        own = own.join(nodes, parents) if parents else own.crossJoin(F.broadcast(nodes))  # the root is one row
        own = own.withColumn("_weight", weight[names[depth - 1]])
        nodes = _shared_out(own, parents, names[depth - 1]).select(*names[:depth], "_tokens", F.col("_own").alias("_budget"))
        if depth < len(names):
            nodes = nodes.drop("_tokens")
    return nodes


def _cuts(meta: DataFrame, mix: Mix) -> DataFrame:
    """One row a leaf: its whole epochs, and the last key of the next one."""
    names = [f"_{x}" for x in LEVELS]
    leaves = stored(meta.groupBy(*names).agg(F.sum("_tokens").alias("_tokens")), "leaves")
    budgets = leaf_budgets(leaves, mix).select(
        *names, F.expr("CAST(IF(_tokens > 0, _budget div _tokens, 0) AS INT)").alias("_epochs"),
        F.expr("IF(_tokens > 0, _budget % _tokens, 0)").alias("_rest"))
    budgets = stored(budgets, "budgets")
    keyed = meta.join(budgets, names).where(F.col("_epochs") < mix.max_epochs)
    keyed = keyed.withColumn("_key", _key(mix, F.col("_epochs"), "_id")).withColumn("_digits", F.substring("_key", 1, HEX))
    # At most 16^3 rows a leaf.
    groups = keyed.groupBy(*names, "_digits").agg(F.sum("_tokens").alias("_sum"), F.first("_rest").alias("_rest"))
    upto = Window.partitionBy(*names).orderBy("_digits").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    groups = groups.withColumn("_upto", F.sum("_sum").over(upto))
    edge = groups.where("_upto > _rest AND _upto - _sum <= _rest").select(*names, "_digits", (F.col("_rest") - F.col("_upto") + F.col("_sum")).alias("_room"))
    edge = stored(edge, "edge-groups")
    inside = keyed.join(edge, [*names, "_digits"]).withColumn(
        "_run", F.sum("_tokens").over(Window.partitionBy(*names).orderBy("_key")))  # rows of equal key together
    last = inside.where("_run <= _room").groupBy(*names).agg(F.max("_key").alias("_last"))
    ends = edge.join(last, names, "left").select(*names, F.coalesce("_last", "_digits").alias("_cut"))
    # Without an edge group the whole epoch fits: a cut above all keys.
    return stored(budgets.join(ends, names, "left").select(*names, "_epochs", F.coalesce("_cut", F.lit("g")).alias("_cut")), "cuts")


def _selected(rows: DataFrame, cuts: DataFrame, mix: Mix, id_col: str) -> DataFrame:
    """A row for every epoch in which a row is taken, numbered in ``_epoch``."""
    names = [f"_{x}" for x in LEVELS]
    joined = rows.join(cuts, names)
    partly = (F.col("_epochs") < mix.max_epochs) & (_key(mix, F.col("_epochs"), id_col) <= F.col("_cut"))
    times = F.col("_epochs") + F.when(partly, 1).otherwise(0)
    return joined.withColumn("_epoch", F.explode(F.when(times > 0, F.sequence(F.lit(0), times - 1)).otherwise(F.array().cast("array<int>"))))


def _meta(docs: DataFrame, mix: Mix, id_col: str, *cols: str) -> DataFrame:
    return stored(docs.select(F.col(id_col).alias("_id"), *_tree(docs, mix, id_col, *cols)), "mix-rows")


def mixture(docs: DataFrame, mix: Mix = PRODUCTION, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
            source_col: str = "source") -> DataFrame:
    """doc_id, epoch, domain, lang, source, n_tokens of every selection of a document."""
    meta = _meta(docs, mix, id_col, text_col, lang_col, source_col)
    chosen = _selected(meta, _cuts(meta, mix), mix, "_id")
    return chosen.select(F.col("_id").alias("doc_id"), F.col("_epoch").cast("int").alias("epoch"), F.col("_domain").alias("domain"),
                         F.col("_lang").alias("lang"), F.col("_source").alias("source"), F.col("_tokens").alias("n_tokens"))


def mix(docs: DataFrame, mix: Mix = PRODUCTION, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
        source_col: str = "source") -> DataFrame:
    """The selected rows of ``docs``, once for every epoch, all columns unchanged."""
    cols = (text_col, lang_col, source_col)
    cuts = _cuts(_meta(docs, mix, id_col, *cols), mix)
    tree = _tree(docs, mix, id_col, *cols)[:3]
    # The caller's row travels as one column, whatever its columns are called.
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(id_col).alias("_id"), *tree)
    return _selected(rows, cuts, mix, "_id").select("_row.*")


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture(table(spark, sf_dir, "documents"))


def _case(col: str, values: Mapping[str, object], other) -> str:
    quote = lambda v: f"'{v}'" if isinstance(v, str) else str(v)
    return (f"CASE {col} " + " ".join(f"WHEN '{k}' THEN {quote(v)}" for k, v in values.items()) + f" ELSE {quote(other)} END") if values else quote(other)


def _level_sql(depth: int, m: Mix) -> str:
    """The water level of one depth of the tree, in DuckDB SQL."""
    names = LEVELS[:depth]
    by = ", ".join(names[:-1]) or "0"
    join = f"JOIN l{depth - 1} USING ({', '.join(names[:-1])})" if depth > 1 else "CROSS JOIN l0"
    n = ", ".join(names)
    return f"""
a{depth} AS (SELECT {n}, sum(cap) AS cap, {_case(names[-1], m.weights.get(names[-1], {}), m.default)} AS weight FROM leaf GROUP BY {n}),
b{depth} AS (SELECT a.*, budget, coalesce(sum(cap) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS earlier,
  sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS onward
  FROM a{depth} a {join} WINDOW w AS (PARTITION BY {by} ORDER BY CAST(cap AS DOUBLE) / greatest(weight, 1), {names[-1]})),
c{depth} AS (SELECT *, weight > 0 AND (budget - earlier) * weight >= cap * onward AS filled FROM b{depth}),
d{depth} AS (SELECT *, sum(CASE WHEN filled THEN cap ELSE 0 END) OVER (PARTITION BY {by}) AS spent,
  sum(CASE WHEN filled THEN 0 ELSE weight END) OVER (PARTITION BY {by}) AS rest_weight FROM c{depth}),
l{depth} AS (SELECT {n}, CASE WHEN filled THEN cap WHEN rest_weight > 0 THEN ((budget - spent) * weight) // rest_weight ELSE 0 END AS budget FROM d{depth})"""


def oracle_sql(m: Mix = PRODUCTION) -> str:
    return rf"""
WITH d AS (SELECT doc_id, coalesce(lang, '{NONE}') AS lang, coalesce(source, '{NONE}') AS source,
  len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS n_tokens FROM documents),
e AS (SELECT *, {_case('source', m.domain_of, NONE)} AS domain FROM d),
leaf AS (SELECT domain, lang, source, sum(n_tokens) AS tokens, sum(n_tokens) * {m.max_epochs} AS cap FROM e GROUP BY ALL),
l0 AS (SELECT least(sum(tokens) * {m.percent} // 100, sum(cap)) AS budget FROM leaf),{','.join(_level_sql(k, m) for k in (1, 2, 3))},
f AS (SELECT domain, lang, source, CASE WHEN tokens > 0 THEN budget // tokens ELSE 0 END AS epochs,
  CASE WHEN tokens > 0 THEN budget % tokens ELSE 0 END AS rest FROM l3 JOIN leaf USING (domain, lang, source)),
g AS (SELECT e.*, epochs, rest, sum(n_tokens) OVER (PARTITION BY domain, lang, source
    ORDER BY md5(concat('{m.seed}:', CAST(epochs AS BIGINT), ':', coalesce(CAST(doc_id AS VARCHAR), '')))) AS run
  FROM e JOIN f USING (domain, lang, source)),
h AS (SELECT *, epochs + CASE WHEN epochs < {m.max_epochs} AND run <= rest THEN 1 ELSE 0 END AS times FROM g)
SELECT doc_id, CAST(t.epoch AS INTEGER) AS epoch, domain, lang, source, CAST(n_tokens AS BIGINT) AS n_tokens
FROM h JOIN range({m.max_epochs}) AS t(epoch) ON t.epoch < times
"""


ORACLE_SQL = oracle_sql()
