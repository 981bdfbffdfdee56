"""Mixing sources to target weights by hierarchical budgets (operator 1, native).

A budget of tokens is passed down a tree of domains, their languages, and their
sources. At each node the children share by weight; a child whose tokens, used
max_epochs times, don't fill its share leaves the rest to its siblings, and only
what all siblings together can't take comes back to the level above. (The capacity
of a subtree is known before its share is set, so one pass from the root does it.)

A leaf with quota q of its t tokens is taken floor(q / t) times whole; the rest is
the prefix of one more epoch, in the order of a seeded hash of the id that differs
from epoch to epoch. A document is in the prefix if fewer tokens than that rest
come before it, so the last one is taken whole; documents of one id go together.
Documents without an id are ordered by a hash of their text.

Tokens are the words of the whole text (null: none). Null langs and sources are
the empty string; domains, languages and sources without a weight of their own
get the weight OTHER_WEIGHT. An empty table gives no rows. mix() returns the
columns of its input whatever their names, each row as often as it was taken;
repeated rows are repeated as often each.

No row is shuffled for the sake of order: 4,096 buckets of the hash are summed per
leaf, the bucket where the prefix ends is found, and only its rows are ordered.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, documents, free_name, join_groups, quoted, spool, whole_row

OTHER_WEIGHT = 0.05
LEVELS = ("domain", "lang", "source")


@dataclass(frozen=True)
class Plan:
    """budget_share: of all tokens; max_epochs: how often a token may be used."""

    budget_share: float = 0.75
    max_epochs: int = 2
    seed: int = 20
    sources: dict[str, tuple[str, ...]] = field(
        default_factory=lambda: {
            "web": ("src0",),
            "books": ("src1", "src2", "src3", "src4"),
            "news": ("src5", "src6", "src7", "src8", "src9"),
            "forums": ("src10", "src11", "src12", "src13", "src14"),
        }
    )
    weights: dict[str, dict[str, float]] = field(
        default_factory=lambda: {
            "domain": {"web": 0.4, "books": 0.2, "news": 0.15, "forums": 0.15},
            "lang": {"en": 0.4, "fr": 0.2, "de": 0.2, "es": 0.2},
            "source": {},
        }
    )


def _tree(plan: Plan, lang: Column, source: Column) -> dict[str, Column]:
    lang, source = F.coalesce(lang, F.lit("")), F.coalesce(source, F.lit(""))
    domain = F.lit("other")
    for name, members in plan.sources.items():
        domain = F.when(source.isin(*members), F.lit(name)).otherwise(domain)
    return {"domain": domain, "lang": lang, "source": source}


def _leaf(names: dict[str, Column]) -> Column:
    return F.concat_ws("\x1f", *names.values())


def n_tokens(text: Column) -> Column:
    return F.size(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))).cast("bigint")


def _weight(plan: Plan, level: str) -> Column:
    found = F.lit(OTHER_WEIGHT if plan.weights[level] else 1.0)
    for name, weight in plan.weights[level].items():
        found = F.when(F.col(level) == name, F.lit(float(weight))).otherwise(found)
    return found


def _share_out(nodes: DataFrame, level: str, parents: list[str], plan: Plan) -> DataFrame:
    """nodes(parents, level, cap, budget of the parent) with the node's own budget:
    least(cap, weight * w), at the level w where the siblings use up the budget."""
    ratio = F.col("cap") / _weight(plan, level)
    siblings = Window.partitionBy(*parents) if parents else Window.partitionBy(F.lit(0))
    order = siblings.orderBy("ratio", level)
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    every = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level_if_last = (F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(after)
    return (
        nodes.withColumns({"weight": _weight(plan, level), "ratio": ratio})
        .withColumn("level_here", level_if_last)
        .withColumn("level", F.first(F.when(F.col("ratio") > F.col("level_here"), F.col("level_here")), True).over(every))
        .withColumn("budget", F.coalesce(F.least(F.col("cap"), F.col("weight") * F.col("level")), F.col("cap")))
        .drop("weight", "ratio", "level_here", "level")
    )


def quotas(leaves: DataFrame, plan: Plan) -> DataFrame:
    """leaves(domain, lang, source, tokens): with quota, epochs (whole) and rest."""
    capped = leaves.withColumn("cap", F.col("tokens").cast("double") * plan.max_epochs)
    total = capped.agg((F.sum("tokens") * plan.budget_share).alias("budget")).first()[0] or 0.0
    budgets = None
    for depth in range(len(LEVELS)):
        names = list(LEVELS[: depth + 1])
        nodes = capped.groupBy(*names).agg(F.sum("cap").alias("cap"))
        if budgets is None:
            nodes = nodes.withColumn("budget", F.lit(float(total)))
        else:
            nodes = nodes.join(budgets, names[:-1])
        budgets = spool(_share_out(nodes, names[-1], names[:-1], plan).drop("cap"), "budgets")
    found = capped.drop("cap").join(budgets.withColumnRenamed("budget", "quota"), list(LEVELS))
    epochs = F.when(F.col("tokens") > 0, F.floor(F.col("quota") / F.col("tokens") + 1e-9)).otherwise(F.lit(0)).cast("int")
    return found.withColumn("epochs", epochs).withColumn("rest", F.greatest(F.col("quota") - F.col("epochs") * F.col("tokens"), F.lit(0.0)))


def _order_id(doc_id: Column, text: Column) -> Column:
    return F.coalesce(doc_id.cast("string"), F.concat(F.lit("text "), F.coalesce(F.md5(text.cast("binary")), F.lit(""))))


def _order_key(plan: Plan, order_id: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(plan.seed)), F.col("epochs").cast("string"), order_id))


def _bucket(key: Column) -> Column:
    return F.substring(key, 1, 3)


@dataclass
class Decision:
    """Per leaf its epochs and where the prefix ends; the keys taken in that bucket."""

    leaves: DataFrame
    edge_keys: DataFrame
    rows: DataFrame
    n_rows: int


def decide(docs: DataFrame, plan: Plan, id_col: str = "doc_id", text_col: str = "text") -> Decision:
    names = _tree(plan, F.col("lang"), F.col("source"))
    rows = spool(
        docs.select(
            F.col(quoted(id_col)).alias("doc_id"),
            _order_id(F.col(quoted(id_col)), F.col(quoted(text_col))).alias("order_id"),
            *[c.alias(n) for n, c in names.items()],
            n_tokens(F.col(quoted(text_col))).alias("n_tokens"),
        ).withColumn("leaf", F.concat_ws("\x1f", *LEVELS)),
        "tokens",
    )
    n = rows.count()
    sums = spool(rows.groupBy("leaf", *LEVELS).agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("group_size")), "leaves")
    leaves = spool(quotas(sums, plan), "quotas")
    keyed = spool(
        join_groups(rows.select("order_id", "leaf", "n_tokens"), leaves.where("rest > 0").select("leaf", "group_size", "epochs", "rest"), "leaf", n)
        .withColumn("key", _order_key(plan, F.col("order_id")))
        .withColumn("bucket", _bucket(F.col("key")))
        .select("leaf", "key", "bucket", "n_tokens", "rest"),
        "keys",
    )
    per_bucket = keyed.groupBy("leaf", "bucket").agg(F.sum("n_tokens").alias("total"), F.first("rest").alias("rest"))
    upto = Window.partitionBy("leaf").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    edges = (
        per_bucket.withColumn("upto", F.sum("total").over(upto))
        .where(F.col("upto") >= F.col("rest") - 1e-6)
        .groupBy("leaf")
        .agg(F.min(F.struct("bucket", (F.col("upto") - F.col("total")).alias("before"))).alias("e"))
        .select("leaf", F.col("e.bucket").alias("edge"), F.col("e.before").alias("before"))
    )
    leaves = spool(leaves.join(edges, "leaf", "left"), "edges")
    at_edge = (
        join_groups(keyed.select("leaf", "key", "bucket", "n_tokens"), leaves.where("edge is not null").select("leaf", "group_size", "edge", "before", "rest"), "leaf", n)
        .where("bucket = edge")
        .groupBy("leaf", "key", "before", "rest")
        .agg(F.sum("n_tokens").alias("n_tokens"))
    )
    earlier = Window.partitionBy("leaf").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    place = F.col("before") + F.coalesce(F.sum("n_tokens").over(earlier), F.lit(0))
    edge_keys = at_edge.withColumn("place", place).where(F.col("place") < F.col("rest") - 1e-6).select("key", F.lit(True).alias("taken"))
    return Decision(leaves, spool(edge_keys.distinct(), "edge-keys"), rows, n)


def _with_copies(rows: DataFrame, decision: Decision, plan: Plan, order_id: Column, leaf_name: str, copies_name: str) -> DataFrame:
    """rows, which carry their leaf, with the number of times that each is taken.
    Only rows in a leaf's edge bucket are looked up by key."""
    row = rows.select(F.col(leaf_name).alias("leaf"), order_id.alias("id"), whole_row(rows.drop(leaf_name)).alias("row"))
    summary = decision.leaves.select("leaf", "group_size", "epochs", "rest", "edge", "tokens", "quota")
    keyed = join_groups(row, summary, "leaf", decision.n_rows).withColumn("key", _order_key(plan, F.col("id")))
    at_edge = F.coalesce(_bucket(F.col("key")) == F.col("edge"), F.lit(False))
    more = F.coalesce(_bucket(F.col("key")) < F.col("edge"), F.lit(False))
    plain = keyed.where(~at_edge).withColumn("more", more)
    edge = keyed.where(at_edge).join(decision.edge_keys, "key", "left").withColumn("more", F.coalesce("taken", F.lit(False))).drop("taken")
    return plain.unionByName(edge).select("row", "tokens", "quota", (F.col("epochs") + F.col("more").cast("int")).alias(copies_name))


def mix_report(docs: DataFrame, plan: Plan, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its leaf, the leaf's tokens and quota, and copies."""
    decision = decide(docs, plan, id_col, text_col)
    found = _with_copies(decision.rows, decision, plan, F.col("order_id"), "leaf", "copies")
    return found.select(*[f"row.{c}" for c in ("doc_id", *LEVELS, "n_tokens")], F.col("tokens").alias("leaf_tokens"), F.round("quota", 3).alias("leaf_quota"), "copies")


def mix(docs: DataFrame, plan: Plan, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, each as often as it is taken."""
    decision = decide(docs, plan, id_col, text_col)
    leaf = free_name(docs, "leaf")
    rows = docs.withColumn(leaf, _leaf(_tree(plan, F.col("lang"), F.col("source"))))
    taken = _with_copies(rows, decision, plan, _order_id(F.col(quoted(id_col)), F.col(quoted(text_col))), leaf, "copies").where("copies > 0")
    again = F.explode(F.sequence(F.lit(1), F.col("copies")))
    return taken.select("row", again.alias("copy")).select("row.*")


def op1_source_budgets(spark, sf_dir: str) -> DataFrame:
    return mix_report(documents(spark, sf_dir, "doc_id", "text", "lang", "source"), Plan())


def _oracle(plan: Plan) -> str:
    domain = "CASE " + " ".join(f"WHEN source IN ({', '.join(repr(x) for x in xs)}) THEN '{d}'" for d, xs in plan.sources.items()) + " ELSE 'other' END"

    def weight(level: str) -> str:
        cases = " ".join(f"WHEN '{k}' THEN CAST({w} AS DOUBLE)" for k, w in plan.weights[level].items())
        return f"CASE {level} {cases} ELSE CAST({OTHER_WEIGHT} AS DOUBLE) END" if cases else "CAST(1 AS DOUBLE)"

    def shares(name: str, depth: int) -> str:
        names = LEVELS[: depth + 1]
        keys, parents = ", ".join(names), ", ".join(names[:-1])
        over = f"PARTITION BY {parents}" if parents else ""
        budget = f"JOIN b{depth - 1} USING ({parents})" if depth else f"CROSS JOIN (SELECT sum(tokens) * CAST({plan.budget_share} AS DOUBLE) AS budget FROM leaves)"
        return f"""
n{depth} AS (SELECT {keys}, cap, budget, {weight(names[-1])} AS w, cap / {weight(names[-1])} AS r
       FROM (SELECT {keys}, CAST(sum(tokens) * {plan.max_epochs} AS DOUBLE) AS cap FROM leaves GROUP BY {keys}) {budget}),
l{depth} AS (SELECT *, (budget - coalesce(sum(cap) OVER (ORDER_ ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
              / sum(w) OVER (ORDER_ ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS here FROM n{depth}),
b{depth} AS (SELECT {keys}, coalesce(least(cap, w * m), cap) AS budget FROM (
       SELECT *, first_value(CASE WHEN r > here THEN here END IGNORE NULLS) OVER (ORDER_ ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS m FROM l{depth})),
""".replace("ORDER_", f"{over} ORDER BY r, {names[-1]}")

    return f"""
WITH d AS (SELECT doc_id, {domain} AS domain, lang, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS n_tokens
      FROM (SELECT doc_id, text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents)),
leaves AS (SELECT domain, lang, source, CAST(sum(n_tokens) AS BIGINT) AS tokens FROM d GROUP BY ALL),
{"".join(shares("", i) for i in range(3))}
q AS (SELECT *, CASE WHEN tokens > 0 THEN CAST(floor(budget / tokens + 1e-9) AS INT) ELSE 0 END AS epochs FROM leaves JOIN b2 USING (domain, lang, source)),
k AS (SELECT d.*, tokens, budget, epochs, greatest(budget - epochs * tokens, 0) AS rest, md5('{plan.seed}:' || epochs || ':' || doc_id) AS key FROM d JOIN q USING (domain, lang, source)),
p AS (SELECT *, coalesce(sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM k)
SELECT doc_id, domain, lang, source, n_tokens, tokens AS leaf_tokens, round(budget, 3) AS leaf_quota,
       CAST(epochs + CASE WHEN before < rest - 1e-6 THEN 1 ELSE 0 END AS INT) AS copies
FROM p"""


ORACLE = _oracle(Plan())
