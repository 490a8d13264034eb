"""Mixing sources to target weights, by budgets that flow down a tree of domain, language and source.

Each node gets a token budget and splits it among its children by weight. A child can take no more than its tokens
times ``max_epochs``; what it can't take goes to its siblings by their weights, until they are full too. A node's own
room is the sum of its children's, so what no sibling can take has been given to the node's siblings one level up
before: shortages are met by siblings first and by ancestors after. Budgets are whole tokens (rounded down).

A leaf reads its documents in seeded orders, one for each epoch, and takes the first tokens up to its budget: every
document once for each full epoch, and the last epoch's prefix, whose last document may be cut.

Texts are never shuffled. Their counts are written as a slim table; in it the place where a leaf's prefix ends is found
level by level (256 hash ranges, 256 ranges of one of them, the rows of one of those), so each step handles sums or a
65,536th of a leaf. The places, one row a leaf, are then held against each document where it is read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import workspace, written

KEY = ["domain", "_language", "_leaf"]
MOST_LEAVES = 200_000  # sources whose budgets are broadcast
WORD = r"[^\x20\x09-\x0D]+"
# Whole-number weights; what isn't listed weighs DEFAULT_WEIGHT.
DOMAIN_WEIGHTS = {"d0": 40, "d1": 30, "d2": 20, "d3": 10}
LANGUAGE_WEIGHTS = {"en": 40, "fr": 25, "de": 20, "es": 15}
DEFAULT_WEIGHT = 10
BUDGET_PERCENT, MAX_EPOCHS, SEED = 60, 2, "mix-1"


def domain_of(source: Column) -> Column:
    """A source's domain: the number at the end of its name modulo 4; names without one are in "none"."""
    digits = F.regexp_extract(source, r"([0-9]{1,9})$", 1)
    return F.when(digits != "", F.concat(F.lit("d"), (digits.cast("int") % 4).cast("string"))).otherwise("none")


def weight_of(column: Column, weights: dict[str, int]) -> Column:
    cases = F.lit(DEFAULT_WEIGHT).cast("long")
    for name, w in weights.items():
        cases = F.when(column == name, F.lit(w).cast("long")).otherwise(cases)
    return cases


def _share(nodes: DataFrame, parent: list[str], node: list[str], budget: Column) -> DataFrame:
    """nodes (cap, weight; one row each) with their budgets, given that of the parent on each row."""
    w = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    order = w.orderBy(F.col("cap") / F.col("weight"), *[F.col(c) for c in node])
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    full = F.col("cap") * rest <= F.col("weight") * (budget - before)
    nodes = nodes.withColumn("_full", full)
    left = budget - F.coalesce(F.sum(F.when(F.col("_full"), F.col("cap"))).over(w), F.lit(0))
    weights = F.sum(F.when(~F.col("_full"), F.col("weight"))).over(w)
    nodes = nodes.withColumn("_left", left).withColumn("_weights", weights)
    part = F.expr("(weight * _left) div _weights")
    return nodes.withColumn("budget", F.when(F.col("_full"), F.col("cap")).otherwise(part).cast("long")).drop("_full", "_left", "_weights")


def budgets(leaves: DataFrame, total: Column, max_epochs: int = MAX_EPOCHS, domain_weights=DOMAIN_WEIGHTS, language_weights=LANGUAGE_WEIGHTS, source_weights=None) -> DataFrame:
    """leaves (domain, language, leaf, tokens; one row each) with their budgets.

    total may use ``all_tokens``, the sum over the leaves. Only sums of leaves are handled here: as many rows as there
    are sources.
    """
    leaves = leaves.where(F.col("tokens") > 0).withColumn("cap", F.col("tokens") * max_epochs)
    keys = [["domain"], ["domain", "language"], ["domain", "language", "leaf"]]
    weight = {"domain": weight_of(F.col("domain"), domain_weights), "language": weight_of(F.col("language"), language_weights), "leaf": weight_of(F.col("leaf"), source_weights or {})}
    all_tokens = leaves.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("all_tokens"))
    given = None
    for depth, key in enumerate(keys):
        nodes = leaves.groupBy(*key).agg(F.sum("cap").alias("cap")).withColumn("weight", weight[key[-1]])
        if given is None:
            nodes = nodes.crossJoin(F.broadcast(all_tokens.select(total.cast("long").alias("_of"))))  # one row
        else:
            nodes = nodes.join(given.select(*keys[depth - 1], F.col("budget").alias("_of")), keys[depth - 1])
        given = _share(nodes, keys[depth - 1] if depth else [], key, F.col("_of")).drop("_of", "weight", "cap")
    return leaves.drop("cap").join(given, keys[-1])


def _ends(slim: DataFrame, given: DataFrame, small) -> DataFrame:
    """Where each leaf's last epoch ends: the row (_end, _end_tokens, _end_row) of its order, and its tokens taken (_part).

    slim has a row for each document: key, _hash, n_tokens, _row; small marks a table of a row a leaf. Leaves without a part of an epoch have no row. Each
    level sums up what the one before left, and keeps the range that holds the last token taken.
    """
    ends = given.where("_rest > 0").select(*KEY, "_rest")

    def crossing(sums: DataFrame, order: list[str]) -> DataFrame:
        before = F.coalesce(F.sum("_in").over(Window.partitionBy(*KEY).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        held = sums.withColumn("_at", before).where((F.col("_at") < F.col("_rest")) & (F.col("_rest") <= F.col("_at") + F.col("_in")))
        return held.withColumn("_rest", F.col("_rest") - F.col("_at")).drop("_at", "_in")

    for name, start in (("_top", 1), ("_bin", 3)):  # two hexadecimal digits each: 256 sums a leaf
        slim = slim.withColumn(name, F.substring("_hash", start, 2))
        had = [c for c in ends.columns if c != "_rest"]
        sums = slim.groupBy(*had, name).agg(F.sum("n_tokens").alias("_in")).join(small(ends), had)
        ends = crossing(sums, [name])
    inside = slim.join(small(ends), [*KEY, "_top", "_bin"]).groupBy(*KEY, "_hash", "n_tokens", "_rest")
    ends = crossing(inside.agg(F.sum("n_tokens").alias("_in")), ["_hash", "n_tokens"])
    ends = ends.select(*KEY, F.col("_hash").alias("_end"), F.col("n_tokens").alias("_end_tokens"), F.expr("_rest div n_tokens").alias("_whole"), F.expr("_rest % n_tokens").alias("_part"))
    # of rows that agree in hash and tokens the first _whole are read whole: found by the tasks that read them, then the rows
    tied = slim.join(small(ends), KEY).where("_hash = _end and n_tokens = _end_tokens").select(*KEY, "_whole", "_row", F.shiftright("_row", 33).alias("_task"))
    tasks = tied.groupBy(*KEY, "_whole", "_task").agg(F.count("*").alias("_in")).withColumn("_rest", F.col("_whole") + 1)
    task = crossing(tasks, ["_task"]).drop("_whole")
    place = F.row_number().over(Window.partitionBy(*KEY).orderBy("_row"))
    row = tied.join(small(task), [*KEY, "_task"]).withColumn("_n", place).where("_n = _rest").select(*KEY, F.col("_row").alias("_end_row"))
    return ends.join(row, KEY, "left").select(*KEY, "_end", "_end_tokens", F.coalesce("_end_row", F.lit((1 << 63) - 1)).alias("_end_row"), "_part")


def mix(docs: DataFrame, budget_percent: int = BUDGET_PERCENT, max_epochs: int = MAX_EPOCHS, seed: str = SEED, domain: Column | None = None, **weights) -> DataFrame:
    """docs with domain, n_tokens, copies (full readings) and cut_tokens (tokens of one more, cut reading).

    Tokens are words here. Null text has no tokens; a null language or source is a leaf of its own ("none"). Rows that
    agree in doc_id are read one after the other, and rows that agree in tokens too by their places in the table, so
    docs should be a table as read. Documents with neither copies nor cut_tokens stay in the result with 0 and 0:
    dropping them is the caller's. Columns of these names are replaced. No rows give no rows.

    One row a source is broadcast if there are MOST_LEAVES sources or fewer; with more, rows are joined by a shuffle.
    """
    some = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("none"))
    df = docs.drop("domain", "n_tokens", "copies", "cut_tokens")
    df = df.withColumn("domain", F.coalesce(domain if domain is not None else domain_of(F.col("source")), F.lit("none")))
    df = df.withColumn("_language", some("lang")).withColumn("_leaf", some("source")).withColumn("n_tokens", F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(WORD)).cast("long"))
    df = df.withColumn("_row", F.monotonically_increasing_id())
    folder = workspace(docs.sparkSession)
    slim = written(df.select(*KEY, F.col("doc_id").cast("string").alias("_id"), "n_tokens", "_row"), f"{folder}/slim")
    leaves = slim.groupBy("domain", F.col("_language").alias("language"), F.col("_leaf").alias("leaf")).agg(F.sum("n_tokens").alias("tokens"))
    given = budgets(leaves, F.expr(f"(all_tokens * {int(budget_percent)}) div 100"), max_epochs, **weights)
    given = given.select("domain", F.col("language").alias("_language"), F.col("leaf").alias("_leaf"), F.expr("budget div tokens").alias("_full"), F.expr("budget % tokens").alias("_rest"))
    given = written(given, f"{folder}/given")
    small = F.broadcast if given.count() <= MOST_LEAVES else (lambda x: x)
    place = lambda id_: F.md5(F.concat_ws(":", F.lit(seed), F.col("_full").cast("string"), F.coalesce(id_, F.lit("none"))).cast("binary"))
    ends = _ends(slim.join(small(given.select(*KEY, "_full")), KEY).withColumn("_hash", place(F.col("_id"))), given, small)
    given = written(given.join(ends, KEY, "left").drop("_rest"), f"{folder}/ends")
    df = df.join(small(given), KEY, "left").fillna(0, ["_full"]).withColumn("_hash", place(F.col("doc_id").cast("string")))
    tie = (F.col("_hash") == F.col("_end")) & (F.col("n_tokens") == F.col("_end_tokens"))
    whole = F.expr("_hash < _end or (_hash = _end and n_tokens < _end_tokens)") | (tie & (F.col("_row") < F.col("_end_row")))
    df = df.withColumn("copies", (F.col("_full") + F.when(whole, 1).otherwise(0)).cast("long"))
    df = df.withColumn("cut_tokens", F.when(tie & (F.col("_row") == F.col("_end_row")), F.col("_part")).otherwise(0).cast("long"))
    return df.drop("_language", "_leaf", "_full", "_hash", "_row", "_end", "_end_tokens", "_end_row", "_part")


def op2(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    mixed = mix(docs.select("doc_id", "text", "lang", "source"))
    return mixed.select("doc_id", "domain", "lang", "source", "n_tokens", "copies", "cut_tokens")


def _case(column: str, weights: dict[str, int]) -> str:
    return f"CASE {' '.join(f'WHEN {column} = {chr(39)}{k}{chr(39)} THEN {v}' for k, v in weights.items())} ELSE {DEFAULT_WEIGHT} END"


def _share_sql(name: str, nodes: str, parent: str, order: str) -> str:
    """Two common table expressions: which nodes are full, and each node's budget."""
    part = f"PARTITION BY {parent}" if parent else ""
    return f"""
{name}_f AS (SELECT *, cap * sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
    <= weight * (given - coalesce(sum(cap) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS is_full
  FROM {nodes} WINDOW w AS ({part} ORDER BY cap / weight, {order})),
{name} AS (SELECT *, CASE WHEN is_full THEN cap ELSE
    (weight * (given - coalesce(sum(CASE WHEN is_full THEN cap END) OVER (p), 0))) // sum(CASE WHEN NOT is_full THEN weight END) OVER (p) END AS budget
  FROM {name}_f WINDOW p AS ({part}))"""


OP2_SQL = f"""
WITH d AS (
  SELECT doc_id, lang, source, coalesce(lang, 'none') AS language, coalesce(source, 'none') AS leaf,
    CASE WHEN regexp_matches(source, '[0-9]{{1,9}}$') THEN 'd' || (CAST(regexp_extract(source, '([0-9]{{1,9}})$', 1) AS INTEGER) % 4) ELSE 'none' END AS domain,
    CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS n_tokens
  FROM documents),
leaves AS (SELECT domain, language, leaf, CAST(sum(n_tokens) AS BIGINT) AS tokens, CAST(sum(n_tokens) AS BIGINT) * {MAX_EPOCHS} AS cap FROM d GROUP BY ALL HAVING sum(n_tokens) > 0),
total AS (SELECT CAST(sum(tokens) AS BIGINT) * {BUDGET_PERCENT} // 100 AS given FROM leaves),
n1 AS (SELECT domain, CAST(sum(cap) AS BIGINT) AS cap, {_case("domain", DOMAIN_WEIGHTS)} AS weight, any_value(given) AS given FROM leaves, total GROUP BY domain),
{_share_sql("b1", "n1", "", "domain")},
n2 AS (SELECT l.domain, language, CAST(sum(l.cap) AS BIGINT) AS cap, {_case("language", LANGUAGE_WEIGHTS)} AS weight, any_value(b1.budget) AS given FROM leaves l JOIN b1 USING (domain) GROUP BY l.domain, language),
{_share_sql("b2", "n2", "domain", "domain, language")},
n3 AS (SELECT l.domain, l.language, leaf, l.cap, tokens, {DEFAULT_WEIGHT} AS weight, b2.budget AS given FROM leaves l JOIN b2 USING (domain, language)),
{_share_sql("b3", "n3", "domain, language", "domain, language, leaf")},
e AS (SELECT d.*, coalesce(b3.budget // tokens, 0) AS full_e, coalesce(b3.budget % tokens, 0) AS rest FROM d LEFT JOIN b3 USING (domain, language, leaf)),
o AS (SELECT *, coalesce(sum(n_tokens) OVER (PARTITION BY domain, language, leaf
    ORDER BY md5('{SEED}:' || CAST(full_e AS BIGINT) || ':' || coalesce(CAST(doc_id AS VARCHAR), 'none')), doc_id, n_tokens ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place FROM e),
c AS (SELECT *, greatest(0, least(n_tokens, rest - place)) AS cut FROM o)
SELECT doc_id, domain, lang, source, n_tokens,
  CAST(full_e + CASE WHEN cut = n_tokens AND place < rest THEN 1 ELSE 0 END AS BIGINT) AS copies,
  CAST(CASE WHEN cut = n_tokens AND place < rest THEN 0 ELSE cut END AS BIGINT) AS cut_tokens
FROM c"""
