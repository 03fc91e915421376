"""Quality classifier: a sparse rule ensemble over text statistics.

Statistics of each text feed shallow boosted trees; every path from a root to a node becomes a
conjunctive rule; lasso logistic regression over the rules keeps few of them; the kept rules are
compiled into one Spark column expression that gives the score.

Training rows: labels whose crc32(doc_id as text) mod 5 is not 0, of these at most `bound` by a
hash of the doc_id (a documented bound of the fit; scoring covers all rows). labels, lang, source
and doc_id are no inputs of a score.

Edge cases: null and empty texts have statistics of 0 and a score like any other; very long texts
are measured whole, in time in proportion to their length; with no training rows or a single label
the score is constant (the label's share, 1 without rows); null labels are left out; repeated rows
are scored one by one; an empty table gives an empty result; other columns pass through untouched.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavegrid.llm.common import columns_of, documents, free_name, hashed_sample, in_small_batches, release
from wavegrid.llm.quality_rules import WHITE, class_counts, repeated_words

STATISTICS = (
    "log_words", "word_length", "lower", "upper", "digits", "spaces", "symbols", "marks", "other",
    "pipe_words", "distinct", "short_words", "repeated", "dup_lines", "line_words", "ended_lines", "ended_words", "shouted",
)
FOLDS = 5
BOUND = 6_000


def statistics(text: str | None) -> tuple[float, ...]:
    """The statistics of a text, in the order of STATISTICS."""
    raw = (text or "").encode()
    words = raw.split()
    n, size = max(1, len(words)), max(1, len(text or ""))
    c = class_counts(raw) / size
    n_repeat, number, ids = repeated_words(words)
    count = np.bincount(ids, minlength=len(number)) if len(words) else np.zeros(0)
    distinct = list(number)
    of = lambda test: float(sum(k for w, k in zip(distinct, count.tolist(), strict=True) if test(w))) / n
    lines = [x for x in raw.split(b"\n") if x.strip(WHITE)]
    m = max(1, len(lines))
    return (
        float(np.log1p(len(words))), float((1 - c[3]) * size / n), *map(float, c),
        of(lambda w: w == b"|"), len(distinct) / n, of(lambda w: len(w) <= 3), n_repeat / n, (len(lines) - len(set(lines))) / m, n / m,
        sum(x.rstrip(WHITE)[-1:] in b".!?" for x in lines) / m, of(lambda w: w[-1:] in b".,!?;:"), of(lambda w: len(w) > 2 and w.isupper()),
    )


def with_statistics(docs: DataFrame, column: str) -> DataFrame:
    """docs with a struct of statistics."""

    def measure(text: pa.Array) -> pa.Array:
        release()
        rows = np.array([statistics(t.as_py()) for t in text], float).reshape(-1, len(STATISTICS))
        return pa.StructArray.from_arrays([pa.array(rows[:, k]) for k in range(len(STATISTICS))], names=list(STATISTICS))

    measured = F.arrow_udf(measure, "struct<" + ", ".join(f"{x} double" for x in STATISTICS) + ">").asNondeterministic()
    return in_small_batches(docs).withColumn(column, measured(*columns_of(docs, "text")))


Rule = tuple[tuple[int, bool, float], ...]


def grow(x: np.ndarray, residual: np.ndarray, depth: int, columns: np.ndarray, least: int, path: Rule, out: list[Rule]) -> list[tuple[np.ndarray, Rule]]:
    """Splits rows by the best squared-error cut; returns the leaves' rows and appends every path below the root to out."""
    if path:
        out.append(path)
    rows = np.arange(len(residual))
    if depth == 0 or len(rows) < 2 * least:
        return [(rows, path)]
    best = (1e-9, None, 0.0)
    total, n = residual.sum(), len(residual)
    for j in columns:
        for cut in np.unique(np.quantile(x[:, j], np.linspace(0.04, 0.96, 16))):
            left = x[:, j] <= cut
            k = int(left.sum())
            if least <= k <= n - least:
                s = residual[left].sum()
                gain = s * s / k + (total - s) ** 2 / (n - k) - total * total / n
                if gain > best[0]:
                    best = (gain, j, float(cut))
    if best[1] is None:
        return [(rows, path)]
    _, j, cut = best
    leaves = []
    for above in (False, True):
        on = (x[:, j] > cut) == above
        for r, p in grow(x[on], residual[on], depth - 1, columns, least, (*path, (int(j), above, cut)), out):
            leaves.append((rows[on][r], p))
    return leaves


def applies(rule: Rule, x: np.ndarray) -> np.ndarray:
    on = np.ones(len(x), bool)
    for j, above, cut in rule:
        on &= (x[:, j] > cut) == above
    return on


def tree_rules(x: np.ndarray, y: np.ndarray, trees: int = 16, depth: int = 3, rate: float = 0.2, seed: int = 3) -> list[Rule]:
    """The distinct paths of boosted trees."""
    rng = np.random.default_rng(seed)
    score = np.zeros(len(y))
    rules: list[Rule] = []
    for _ in range(trees):
        sample = rng.random(len(y)) < 0.7
        if sample.sum() < 20:
            sample[:] = True
        columns = rng.choice(x.shape[1], max(1, 2 * x.shape[1] // 3), replace=False)
        residual = y - 1 / (1 + np.exp(-score))
        leaves = grow(x[sample], residual[sample], depth, np.sort(columns), max(5, len(y) // 200), (), rules)
        for rows, path in leaves:
            r = residual[sample][rows]
            p = (y[sample][rows] - r).clip(0.01, 0.99)
            score[applies(path, x)] += rate * r.sum() / max((p * (1 - p)).sum(), 1e-6)
    return list(dict.fromkeys(rules))


def lasso(z: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 400) -> tuple[np.ndarray, float]:
    """Weights and intercept of L1-penalised logistic regression, by accelerated proximal gradient."""
    n = len(y)
    step = 4 * n / max(np.linalg.norm(z, 2) ** 2 + n, 1e-9)
    share = y.mean().clip(1e-3, 1 - 1e-3)
    w, b, t = np.zeros(z.shape[1]), float(np.log(share / (1 - share))), 1.0
    u, c = w.copy(), b
    for _ in range(rounds):
        r = 1 / (1 + np.exp(-(z @ u + c))) - y
        new = u - step * (z.T @ r) / n
        new = np.sign(new) * np.maximum(np.abs(new) - step * penalty, 0)
        new_b = c - step * r.mean()
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        u, c = new + (t - 1) / t2 * (new - w), new_b + (t - 1) / t2 * (new_b - b)
        w, b, t = new, new_b, t2
    return w, b


def fit(x: np.ndarray, y: np.ndarray, penalty: float = 5e-4) -> tuple[list[tuple[Rule, float]], float]:
    """Kept rules with their weights, and the intercept."""
    if not len(y):
        return [], 7.0
    if len(set(y.tolist())) < 2 or len(y) < 20:
        share = (y.sum() + 0.5) / (len(y) + 1)
        return [], float(np.log(share / (1 - share)))
    rules = tree_rules(x, y)
    if not rules:
        return [], float(np.log(y.mean() / (1 - y.mean())))
    z = np.stack([applies(r, x) for r in rules], 1).astype(float)
    w, b = lasso(z, y, penalty)
    return [(r, float(v)) for r, v in zip(rules, w, strict=True) if abs(v) > 1e-4], b


def compiled(rules: list[tuple[Rule, float]], intercept: float, column: str) -> Column:
    """The score as a column expression over the statistics in `column`."""
    total = F.lit(intercept)
    for rule, weight in rules:
        test = F.lit(True)
        for j, above, cut in rule:
            value = F.col(f"{column}.{STATISTICS[j]}")
            test = test & ((value > cut) if above else (value <= cut))
        total = total + F.when(test, weight).otherwise(0.0)
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def fold(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS


def training_rows(docs: DataFrame, labels: DataFrame, target: str, bound: int) -> DataFrame:
    """(text, target) of at most `bound` labelled rows outside fold 0, chosen by a hash of the doc_id."""
    chosen = labels.select(*columns_of(labels, "doc_id", target)).where((fold(F.col("doc_id")) != 0) & F.col(target).isNotNull() & F.col("doc_id").isNotNull())
    # At most `bound` rows of two numbers: small enough to be sent to every task.
    chosen = hashed_sample(chosen, "doc_id", bound)
    return docs.select(*columns_of(docs, "doc_id", "text")).join(F.broadcast(chosen), "doc_id").select("text", target)


def rule_model(docs: DataFrame, labels: DataFrame, target: str = "quality", bound: int = BOUND) -> tuple[list[tuple[Rule, float]], float]:
    rows = with_statistics(training_rows(docs, labels, target, bound), "s").select(F.col(target).cast("double").alias("y"), "s.*").toPandas()
    rows = rows.sort_values([*STATISTICS, "y"])
    return fit(rows[list(STATISTICS)].to_numpy(float), rows["y"].to_numpy(float))


def quality_scores(docs: DataFrame, model: tuple[list[tuple[Rule, float]], float], column: str = "score") -> DataFrame:
    """docs with the column `score`."""
    name, stats = free_name(docs, column), free_name(docs, "statistics")
    scored = with_statistics(docs, stats)
    return scored.select(*columns_of(docs, *docs.columns), compiled(*model, stats).alias(name))


def op5_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    model = rule_model(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = quality_scores(docs, model)
    return out.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def crc_fold(doc_id: int) -> int:
    """fold() for one id, for tests."""
    return zlib.crc32(str(doc_id).encode()) % FOLDS
