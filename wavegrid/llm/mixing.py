"""Mixing sources to target weights by hierarchical budgeting.

Documents hang on a tree domain - language - source. The token budget runs down the tree by the
children's weights. A child that has fewer tokens than its share (its subtree's tokens times
`max_epochs`) gets what it has; the rest goes to its siblings by their weights, and only what
all siblings together cannot take was, because subtree capacities are known beforehand, never
given to their parent but to the parent's siblings.

Each leaf then takes whole epochs as long as they fit, and of one more epoch a token-prefix: its
documents stand in the order of a 56-bit hash of seed, epoch and doc_id, and those before the
first one whose running token sum exceeds the leaf's rest are taken. The end of the prefix is
found digit by digit of the hash: each step sums the tokens of a leaf's next `DIGIT` bits
(pre-aggregated, so that no leaf's documents meet in a task) and goes on within the digit in which
the rest runs out, until that digit holds one hash alone.

Texts are never moved: what is joined to the documents has one row for each leaf and is sent to
all tasks up to `common.SENT_ROWS` leaves; beyond, Spark joins by an exchange and splits hot
leaves. Budgets are planned on the driver up to `PLANNED_LEAVES` leaves (three names and a number
each) and by Spark aggregations beyond, with the same results.

Edge cases: a null language or source is a name of its own (the empty string); a null or empty
text has no tokens, costs nothing and stands in its leaf's order like any other (so a leaf
without any tokens is taken whole, once); a very long text counts whole and is taken or left
whole; rows of a leaf with the same doc_id (or hash) are taken or left together; an empty table, a budget
of 0 or a weight of 0 on a leaf's path gives no rows; other columns pass through untouched.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavegrid.llm.common import SENT_ROWS, columns_of, cut, documents, free_name, small_side

LEVELS = ("mix_domain", "mix_lang", "mix_source")
WORD = r"[^\x20\x09-\x0D]+"
#: Leaves whose budgets the driver plans at most.
PLANNED_LEAVES = 100_000
#: Bits of a document's place in its leaf's order, and those that a step of the search for a prefix's end decides.
BITS, DIGIT = 56, 8


def shares(amount: float, weights: list[float], capacity: list[float]) -> list[float]:
    """amount by weights, none over its capacity; what one cannot take goes to the others by weight."""
    out, open_ = [0.0] * len(weights), [k for k, w in enumerate(weights) if w > 0]
    left = min(amount, sum(capacity[k] for k in open_))
    while open_ and left > 0:
        total = sum(weights[k] for k in open_)
        full = [k for k in open_ if left * weights[k] >= total * (capacity[k] - out[k])]
        if not full:
            for k in open_:
                out[k] += left * weights[k] / total
            break
        for k in full:
            left -= capacity[k] - out[k]
            out[k] = float(capacity[k])
        open_ = [k for k in open_ if k not in set(full)]
    return out


def leaf_budgets(tokens: Mapping[tuple[str, ...], int], weights: Mapping[tuple[str, ...], float], budget: float, max_epochs: float) -> dict[tuple[str, ...], float]:
    """Each leaf's tokens to take. weights: by path from the root, of any length; 1 where none is given."""

    paths = {p[:k] for p in tokens for k in range(len(LEVELS) + 1)}
    children: dict[tuple[str, ...], list[tuple[str, ...]]] = {}
    for p in sorted(paths):
        if p:
            children.setdefault(p[:-1], []).append(p)
    capacities: dict[tuple[str, ...], float] = {}
    for p in sorted(paths, key=len, reverse=True):
        capacities[p] = tokens[p] * max_epochs if len(p) == len(LEVELS) else sum(capacities[c] for c in children[p] if weights.get(c, 1.0) > 0)
    out: dict[tuple[str, ...], float] = {}

    def down(path, amount):
        if len(path) == len(LEVELS):
            out[path] = amount
            return
        below = children.get(path, [])
        for c, a in zip(below, shares(amount, [weights.get(c, 1.0) for c in below], [capacities[c] for c in below]), strict=True):
            down(c, a)

    if tokens:
        down((), budget)
    return out


def shared_out(children: DataFrame, amounts: DataFrame) -> DataFrame:
    """shares() for all parents at once: (path, amount) from children (path, parent, weight, capacity) and amounts (parent, amount).

    A round sums each parent's open children and closes those that their share would fill; it is
    the last one that closes none.
    """
    able = children.where("weight > 0")
    limits = able.groupBy("parent").agg(F.sum("capacity").alias("most"))
    left = cut(amounts.join(small_side(cut(limits)), "parent").select("parent", F.least("amount", "most").alias("left")))
    open_, done = cut(able), children.where("weight <= 0").select("path", F.lit(0.0).alias("amount"))
    while True:
        totals = cut(open_.groupBy("parent").agg(F.sum("weight").alias("total")).join(left, "parent"))
        share = F.col("left") * F.col("weight")
        tried = cut(open_.join(small_side(totals), "parent").withColumn("full", (F.col("left") > 0) & (share >= F.col("total") * F.col("capacity"))))
        full = tried.where("full")
        if full.isEmpty():
            return done.unionByName(tried.select("path", F.greatest(share / F.col("total"), F.lit(0.0)).alias("amount")))
        done = done.unionByName(full.select("path", F.col("capacity").alias("amount")))
        taken = small_side(cut(full.groupBy("parent").agg(F.sum("capacity").alias("taken"))))
        left = cut(left.join(taken, "parent", "left").select("parent", (F.col("left") - F.coalesce("taken", F.lit(0.0))).alias("left")))
        open_ = cut(tried.where("not full").select("path", "parent", "weight", "capacity"))


def leaf_amounts(leaves: DataFrame, weights: Mapping[tuple[str, ...], float], budget: float, max_epochs: float) -> DataFrame:
    """leaf_budgets() by Spark: (path, amount) from leaves (path, total); a path is an array of names."""
    spark = leaves.sparkSession
    given = F.broadcast(spark.createDataFrame([(list(p), float(w)) for p, w in weights.items()], "path array<string>, weight double"))
    parent = lambda k: F.slice("path", 1, k - 1).alias("parent")
    levels, below = {}, leaves.select("path", (F.col("total") * F.lit(float(max_epochs))).alias("capacity"))
    for k in range(len(LEVELS), 0, -1):
        levels[k] = cut(below.join(given, "path", "left").select("path", parent(k), F.coalesce("weight", F.lit(1.0)).alias("weight"), "capacity"))
        below = levels[k].groupBy(F.col("parent").alias("path")).agg(F.sum(F.when(F.col("weight") > 0, F.col("capacity")).otherwise(0.0)).alias("capacity"))
    amounts = spark.createDataFrame([([], float(budget))], "path array<string>, amount double")
    for k in range(1, len(LEVELS) + 1):
        amounts = shared_out(levels[k], amounts.select(F.col("path").alias("parent"), "amount"))
    return amounts


def planned(leaves: DataFrame, weights: Mapping[tuple[str, ...], float], budget_share: float, max_epochs: int) -> tuple[DataFrame, int]:
    """(path, whole, rest) of the leaves that take part: whole epochs and the tokens of one more (null: no further epoch); the number of leaves."""
    spark = leaves.sparkSession
    count, everything = leaves.agg(F.count(F.lit(1)), F.sum("total")).first()
    budget = budget_share * (everything or 0)
    if count <= PLANNED_LEAVES:
        tokens = {tuple(r.path): r.total for r in leaves.collect()}
        amounts = spark.createDataFrame([(list(p), float(a)) for p, a in leaf_budgets(tokens, weights, budget, max_epochs).items()], "path array<string>, amount double")
    else:
        amounts = leaf_amounts(leaves, weights, budget, max_epochs)
    barred = F.exists(F.array(*[F.slice("path", 1, k) for k in range(1, len(LEVELS) + 1)]), lambda p: F.array_contains(barred_paths(weights), p))
    take = F.floor(F.col("amount") + 1e-6)
    whole = F.when(F.col("total") > 0, F.least(F.lit(max_epochs), F.floor(take / F.col("total")))).otherwise(0).cast("bigint")
    # Without a budget nothing is taken; documents without tokens need one too.
    part = leaves.join(sent(amounts, count), "path").where(F.lit(budget_share > 0) & ~barred).withColumn("whole", whole)
    rest = F.when(F.col("whole") < max_epochs, take - F.col("whole") * F.col("total")).cast("bigint")
    return cut(part.select("path", "whole", rest.alias("rest"))), count


def barred_paths(weights: Mapping[tuple[str, ...], float]) -> Column:
    """The paths of weight 0."""
    paths = [F.array(*map(F.lit, p)) for p, w in weights.items() if w <= 0]
    return F.array(*paths) if paths else F.array().cast("array<array<string>>")


def order_key(seed: int, epoch: Column, doc_id: Column) -> Column:
    """Place of a document in an epoch: the first BITS bits of a hash, as a number."""
    hashed = F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))
    return F.conv(F.substring(hashed, 1, BITS // 4), 16, 10).cast("bigint")


def sent(df: DataFrame, rows: int) -> DataFrame:
    """df, of at most `rows` rows, to be sent to all tasks of a join unless these are too many."""
    return F.broadcast(df) if rows <= SENT_ROWS else df


def prefix_ends(slim: DataFrame, plan: DataFrame, seed: int, count: int) -> DataFrame:
    """(path, end): the keys below end are the leaf's token-prefix of the epoch after its whole ones.

    slim: (path, doc_id, tokens); plan: (path, whole, rest) of `count` rows, where a null rest has no such epoch.
    """
    state = (plan.where("rest is not null").select("path", "whole", "rest", F.lit(0).cast("bigint").alias("start")))
    found = state.select("path", "start").limit(0)
    for shift in range(BITS - DIGIT, -1, -DIGIT):
        rows = slim.join(sent(state, count), "path").withColumn("key", order_key(seed, F.col("whole"), F.col("doc_id")))
        rows = rows.where(F.shiftright("key", shift + DIGIT) == F.col("start")).withColumn("digit", F.shiftright("key", shift))
        sums = rows.groupBy("path", "digit").agg(F.sum("tokens").alias("sum"), (F.min("key") == F.max("key")).alias("single"))
        # At most 2 ** DIGIT rows for each leaf, summed before they are brought together.
        listed = sums.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("digit", "sum", "single"))).alias("sums"))
        none = F.lit(None).cast("struct<digit:bigint,sum:bigint,single:boolean>")
        over = F.aggregate(
            "sums", F.struct(F.col("rest").alias("rest"), none.alias("at")),
            lambda a, s: F.when(a["at"].isNotNull(), a)
            .when(s["sum"] <= a["rest"], F.struct((a["rest"] - s["sum"]).alias("rest"), none.alias("at")))
            .otherwise(F.struct(a["rest"].alias("rest"), s.alias("at"))),
        )
        stepped = cut(listed.join(sent(state, count), "path").select("path", "whole", over.alias("o")))
        ended = F.col("o.at").isNull() | F.col("o.at.single") | F.lit(shift == 0)
        end = F.when(F.col("o.at").isNull(), F.lit(1 << BITS)).otherwise(F.shiftleft("o.at.digit", shift))
        found = found.unionByName(stepped.where(ended).select("path", end.alias("start")))
        state = stepped.where(~ended).select("path", "whole", F.col("o.rest").alias("rest"), F.col("o.at.digit").alias("start"))
        if state.isEmpty():
            break
    return found.withColumnRenamed("start", "end")


def mix(
    docs: DataFrame, domain: Column, weights: Mapping[tuple[str, ...], float], budget_share: float, max_epochs: int = 1, seed: int = 13, column: str = "epoch"
) -> DataFrame:
    """The documents taken, once for each epoch (column `epoch`, from 0); budget_share: tokens to take, as a share of all tokens."""
    names = [free_name(docs, x) for x in LEVELS]
    path, whole, end, epoch = (free_name(docs, x) for x in ("mix_path", "mix_whole", "mix_end", column))
    lang, source, text, doc_id = columns_of(docs, "lang", "source", "text", "doc_id")
    empty = F.lit("")
    leaf = F.array(F.coalesce(domain, empty), F.coalesce(lang, empty), F.coalesce(source, empty))
    slim = cut(docs.select(doc_id.alias("doc_id"), leaf.alias("path"), F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint").alias("tokens")))
    leaves = cut(slim.groupBy("path").agg(F.sum("tokens").alias("total")))
    plan, count = planned(leaves, weights, budget_share, max_epochs)
    decided = plan.join(sent(prefix_ends(slim, plan, seed, count), count), "path", "left").select(
        F.col("path").alias(path), F.col("whole").alias(whole), F.coalesce("end", F.lit(0)).alias(end)
    )
    partial = F.when(order_key(seed, F.col(whole), doc_id) < F.col(end), 1).otherwise(0)
    named = docs.withColumn(path, leaf).join(sent(cut(decided), count), path)
    taken = named.withColumn(epoch, F.explode(F.when(F.col(whole) + partial > 0, F.sequence(F.lit(0), (F.col(whole) + partial - 1).cast("int")))))
    return taken.select(*columns_of(docs, *docs.columns), epoch, *[F.get(F.col(path), k).alias(n) for k, n in enumerate(names)])


def default_domain(source: Column) -> Column:
    """The query's domains: sources by the number in their name, in three domains."""
    digits = F.regexp_extract(F.coalesce(source, F.lit("")), r"(\d{1,9})$", 1)
    return F.when(digits == "", "other").otherwise(F.concat(F.lit("domain"), (F.when(digits == "", "0").otherwise(digits).cast("bigint") % 3).cast("string")))


#: The query's target weights by path; 1 where none is given.
WEIGHTS = {
    ("domain0",): 0.5, ("domain1",): 0.3, ("domain2",): 0.2,
    ("domain0", "en"): 0.4, ("domain0", "de"): 0.3, ("domain0", "fr"): 0.2, ("domain0", "es"): 0.1, ("domain0", "en", "src0"): 2.0,
}


def op4_source_mixing(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    out = mix(docs, default_domain(F.col("source")), WEIGHTS, budget_share=0.7, max_epochs=2)
    return out.select("doc_id", F.col("mix_domain").alias("domain"), "lang", "source", "epoch")


def op4_sql(weights: Mapping[tuple[str, ...], float] = WEIGHTS, share: float = 0.7, epochs: int = 2, seed: int = 13) -> str:
    """DuckDB SQL for op4: at each level children are sorted by capacity over weight; those that the level of filling reaches are full."""
    given = ", ".join(f"('{'/'.join(p)}', {float(w)})" for p, w in weights.items())
    level = "WITH t AS (SELECT doc_id, lang, source, coalesce(lang, '') AS l, coalesce(source, '') AS s, CASE WHEN regexp_extract(coalesce(source, ''), '(\\d{1,9})$', 1) = '' THEN 'other' ELSE 'domain' || (CAST(regexp_extract(source, '(\\d{1,9})$', 1) AS BIGINT) % 3) END AS d, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS n FROM documents)"
    level += f", w(p, w) AS (VALUES {given}), g AS (SELECT d, l, s, sum(n) AS total FROM t GROUP BY ALL)"
    level += ", c3 AS (SELECT d || '/' || l || '/' || s AS p, d || '/' || l AS up, CAST(total AS DOUBLE) * " + str(epochs) + " AS cap FROM g)"
    for k, up in ((3, "split_part(up, '/', 1)"), (2, "''")):
        level += f", c{k - 1} AS (SELECT up AS p, {up} AS up, sum(CASE WHEN coalesce(w, 1) > 0 THEN cap ELSE 0 END) AS cap FROM c{k} LEFT JOIN w USING (p) GROUP BY up)"
    level += f", a0 AS (SELECT '' AS p, {share} * sum(total) AS a FROM g)"
    for k in (1, 2, 3):
        level += f""", o{k} AS (SELECT c.p, c.up, coalesce(w, 1) AS w, cap, least(a, sum(cap) OVER (PARTITION BY c.up)) AS a FROM c{k} c LEFT JOIN w USING (p) JOIN a{k - 1} ON a{k - 1}.p = c.up WHERE coalesce(w, 1) > 0),
r{k} AS (SELECT *, a - coalesce(sum(cap) OVER (PARTITION BY up ORDER BY cap / w, p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest, sum(w) OVER (PARTITION BY up ORDER BY cap / w, p ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open FROM o{k}),
f{k} AS (SELECT *, rest * w >= cap * open AS filled FROM r{k}),
a{k} AS (SELECT p, CASE WHEN filled THEN cap ELSE (a - coalesce(sum(cap) FILTER (WHERE filled) OVER v, 0)) * w / sum(w) FILTER (WHERE NOT filled) OVER v END AS a FROM f{k} WINDOW v AS (PARTITION BY up))"""
    return level + f""", plan AS (
  SELECT g.*, CAST(floor(a + 1e-6) AS BIGINT) AS take, CASE WHEN total > 0 THEN least({epochs}, CAST(floor(a + 1e-6) AS BIGINT) // total) ELSE 0 END AS whole FROM g JOIN a3 ON a3.p = d || '/' || l || '/' || s),
k AS (SELECT t.*, total, take, whole, md5('{seed}:' || whole || ':' || coalesce(CAST(doc_id AS VARCHAR), ''))[1:14] AS key FROM t JOIN plan USING (d, l, s)),
run AS (SELECT *, whole + CASE WHEN whole < {epochs} AND sum(n) OVER (PARTITION BY d, l, s ORDER BY key RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) <= take - whole * total THEN 1 ELSE 0 END AS times FROM k)
SELECT doc_id, d AS domain, lang, source, CAST(unnest(range(CAST(times AS BIGINT))) AS INTEGER) AS epoch FROM run"""
