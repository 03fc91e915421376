"""Corpus operators against brute-force versions and on hard cases."""

import hashlib
import json
import math
import random
import re
import shutil
import struct
import time
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tests.conftest import DATA
from wavegrid.llm import bpe, common, graph, licenses, mixing, ngram_join, pii, quality_model, quality_rules, queries, syncmers, token_rollup, toxicity

SF = f"{DATA}/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, quality string, epoch string, kept string, rep string, tokens string, word string, k string, key string, score string"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def hard_rows():
    """Nulls in any column, empty and very long texts, ties, repeated rows; extra columns bear names used inside operators."""
    rng = random.Random(5)
    long = " ".join(rng.choice(WORDS) for _ in range(30_000))
    base = [rng.choice(WORDS) for _ in range(120)]
    texts = [None, "", " \n\t ", "one", "one two three", "ONE two three", long, long + " end", " ".join(base), " ".join(base[:-3] + ["x", "y", "z"]),
             " ".join(["q"] + base[1:]), " ".join(base).upper(), "x" * 50_000, "a@b.co 10.0.0.1 +1 (212) 555-0134, 4111 1111 1111 1111",
             "Released under the MIT License.\ncc by nc cc by nc", "<|endoftext|> é́ \U0001f600 \x00\x1c     x", "same line\n" * 60]
    rows = [(k, t, "en" if k % 3 else None, "s1" if k % 2 else None, None if t is None else len(t)) for k, t in enumerate(texts)]
    rows += [(None, "null id " * 30, None, None, None), rows[8], rows[8], (30, texts[8], "en", "s1", None), (31, texts[6], "de", "s2", None)]
    return [(*r, *["clash"] * 9) for r in rows]


@pytest.fixture(scope="module")
def hard(spark):
    return spark.createDataFrame(hard_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def small(spark):
    return common.documents(spark, SF)


def texts_of(df):
    return {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}


# --- 1: n-gram Jaccard join


def shingles(text):
    w = (text or "").encode().lower().split()
    return frozenset([b" ".join(w[k : k + 5]) for k in range(len(w) - 4)] if len(w) >= 5 else [b" ".join(w)] if w else [])


def joined_by_force(rows):
    """doc_id -> (n, component, links), all pairs compared. rows: (doc_id, text) with distinct ids."""
    sets = [(i, shingles(t)) for i, t in rows]
    parent = {i: i for i, _ in sets}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    links = Counter()
    for x, (i, a) in enumerate(sets):
        for j, b in sets[x + 1 :]:
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                links[i] += 1
                links[j] += 1
                p, q = sorted((find(i), find(j)))
                parent[q] = p
    return {i: (len(s), find(i), links[i]) for i, s in sets}


def near_rows(seed, groups=6, size=40):
    """Chains of near copies at all similarities around the threshold, exact copies and texts that share passages."""
    rng = random.Random(seed)
    rows, passage = [], [rng.choice(WORDS) + str(rng.random()) for _ in range(30)]
    for g in range(groups):
        text = [f"{rng.choice(WORDS)}{rng.randrange(999)}" for _ in range(rng.choice([7, 12, 40, 90]))]
        for _ in range(size):
            t = list(text)
            for _ in range(rng.randrange(0, 5)):
                t[rng.randrange(len(t))] = f"new{rng.randrange(10**6)}"
            if rng.random() < 0.2:
                text = t
            if rng.random() < 0.3:
                t = t[: len(t) // 2] + passage + t[len(t) // 2 :]
            rows.append((len(rows) * 3, " ".join(t)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_join_equals_all_pairs(spark, seed, monkeypatch):
    if seed == 2:  # large groups are cut into chunks
        monkeypatch.setattr(ngram_join, "CHUNK_CLASSES", 7)
        monkeypatch.setattr(ngram_join, "small_side", lambda df: df)
    rows = near_rows(seed)
    got = ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in got} == joined_by_force(rows)


def test_join_with_frequent_shingles(spark, monkeypatch):
    """A line that all documents share, and one that a third share: the same links, with and without frequent ones being told."""
    rng = random.Random(3)
    rows = []
    for i, t in near_rows(5, groups=5, size=30):
        line = "this line is in every one of the documents of this table"
        rows.append((i, f"{line}\n{t}\nand this one is in a third of them as it goes" if rng.random() < 0.33 else f"{line}\n{t}"))
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(6)
    want = joined_by_force(rows)
    seen = []
    plain = ngram_join.frequent
    monkeypatch.setattr(ngram_join, "frequent", lambda noted: (seen.append(plain(noted)), seen[-1])[1])
    for least in (10**9, 20, 2):
        monkeypatch.setattr(ngram_join, "LEAST_FREQUENT", least)
        monkeypatch.setattr(ngram_join, "CHUNK_CLASSES", 9)
        got = ngram_join.near_duplicates(df).collect()
        assert {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in got} == want
    assert not len(seen[0]) and len(seen[2]) > 3 and len(seen[4]) > len(seen[2])


def test_join_of_repeated_ids(spark):
    """Rows that share a doc_id are one node; each row has the links of its own text."""
    rng = random.Random(9)
    words = [f"w{k}" for k in range(400)]
    a, b, c = (" ".join(rng.sample(words, 60)) for _ in range(3))
    near = a + " and more"
    rows = [(5, a), (9, a), (3, b), (9, b), (5, c), (20, near), (21, near), (5, a), (30, c), (3, ""), (40, None), (50, " ".join(rng.sample(words, 60)))]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)).collect()))
    links = {a: 4, b: 1, c: 1, near: 4}
    want = sorted((i, len(shingles(t)), i if not t or i == 50 else 3, links.get(t, 0)) for i, t in rows)
    assert got == want


def test_join_of_hard_rows(hard, empty):
    rows = ngram_join.near_duplicates(hard).collect()
    assert len(rows) == hard.count()
    by = defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
    for k in (0, 1, 2):
        assert (by[k][0].n_shingles, by[k][0].component_id, by[k][0].n_links) == (0, k, 0)
    assert by[4][0].component_id == by[5][0].component_id == 4 and by[4][0].n_shingles == 1
    assert {by[k][0].component_id for k in (8, 9, 10, 11, 30)} == {8} and by[31][0].component_id == by[7][0].component_id == 6
    assert by[None][0].n_links == 0
    assert ngram_join.near_duplicates(empty).count() == 0


def test_search_reaches_all_overlaps():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 50))) for _ in range(80)]
    index = ngram_join.Index(sets)
    for q in sets:
        need = ngram_join.least_overlap(len(q))
        want = {i: len(np.intersect1d(q, s)) for i, s in enumerate(sets)}
        assert index.search(q, len(q)) == {i: n for i, n in want.items() if n >= need}


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(250)] + [(k, k + 1) for k in range(1000, 1060)] + [(2000, k) for k in range(2001, 2100)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    parent = {}

    def find(a):
        while parent.setdefault(a, a) != a:
            a = parent[a]
        return a

    for a, b in edges:
        p, q = sorted((find(a), find(b)))
        parent[q] = p
    assert got == {n: find(n) for n in parent if any(n in e and e[0] != e[1] for e in edges)}


# --- 2: token counts


def test_token_totals(spark, tmp_path):
    schema = "op string, source string, lang string, tokenizer string, tokens bigint, old_tokens bigint, documents string"
    batch = lambda *rows: spark.createDataFrame([(*r, "clash") for r in rows], schema)
    totals = token_rollup.TokenTotals(spark, str(tmp_path / "totals"))
    assert totals.totals().count() == 0
    first = batch(("insert", "a", "en", "t1", 10, None), ("insert", "a", "en", "t1", 5, None), ("insert", None, None, "t1", None, None))
    assert totals.apply("b1", first) and not totals.apply("b1", first)
    assert totals.apply("b2", batch(("revise", "a", "en", "t1", 7, 10), ("delete", "a", "en", "t1", 5, None), ("delete", None, None, "t1", 0, None)))
    assert totals.apply("b3", batch())
    assert [tuple(r) for r in totals.totals().collect()] == [("a", "en", "t1", 1, 7)]
    again = token_rollup.TokenTotals(spark, str(tmp_path / "totals"))
    assert not again.apply("b2", batch(("insert", "z", "en", "t1", 1, None))) and again.totals().count() == 1
    with pytest.raises(Exception, match="unknown op"):
        totals.apply("b4", batch(("upsert", "a", "en", "t1", 1, None)))
    assert totals.committed() == ["b1", "b2", "b3"]
    with pytest.raises(ValueError):
        totals.apply("a/b", first)
    # A snapshot covers the batches so far; later ones are added to it, and their data are all that is read.
    assert totals.compact() and not totals.compact()
    shutil.rmtree(tmp_path / "totals" / "data" / json.loads((tmp_path / "totals" / "batches" / "b1").read_text())["data"])
    assert not totals.apply("b1", first) and totals.apply("b5", batch(("insert", "a", "en", "t1", 3, None), ("insert", "b", "en", "t2", 4, None)))
    assert totals.compact() and again.compact() is False
    assert totals.apply("b6", batch(("delete", "b", "en", "t2", 4, None)))
    assert [tuple(r) for r in again.totals().collect()] == [("a", "en", "t1", 2, 10)]
    # An attempt that no marker names, as a lost driver leaves it, counts nothing.
    token_rollup.deltas(first).write.parquet(str(tmp_path / "totals" / "data" / "lost"))
    assert [tuple(r) for r in totals.totals().collect()] == [("a", "en", "t1", 2, 10)]


def test_token_rollup_of_hard_rows(spark, hard, empty, tmp_path, tokenizer):
    """The registered query on nulls, empty and long texts and repeated rows, and on an empty table; a real vocabulary as a version."""
    for k, docs in enumerate((hard, empty)):
        docs.write.parquet(str(tmp_path / f"{k}/documents.parquet"))
        want = defaultdict(lambda: [0, 0])
        for r in docs.collect():
            t = r.text or ""
            for version, n in (("words-1", len(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t))), ("bytes-1", -(-len(t.encode()) // 4))):
                want[r.source, r.lang, version][0] += 1
                want[r.source, r.lang, version][1] += n
        got = queries.QUERIES["op2_token_rollup"](spark, str(tmp_path / str(k))).collect()
        assert {(r.source, r.lang, r.tokenizer): [r.documents, r.tokens] for r in got} == want
    changes = token_rollup.vocabulary_tokens(hard, bpe.default_vocabulary(), "count").select(
        F.lit("insert").alias("op"), "source", "lang", F.lit("byte_bpe_50k").alias("tokenizer"), F.col("count").alias("tokens"), F.lit(None).cast("bigint").alias("old_tokens")
    )
    assert token_rollup.deltas(changes).agg(F.sum("tokens")).first()[0] == sum(encoded_by_library(tokenizer, r.text or "")[0] for r in hard.collect())


def severities_by_force(texts, weights, theta):
    out = {}
    for i, t in texts.items():
        names = set()
        for w in re.findall(r"[^\W\d_]+", (t or "").lower()):
            names |= {f"w:{w}"} | {f"p{k}:{w[:k]}" for k in (3, 4, 5) if len(w) > k}
        x = sum(weights.get(p, 0.0) for p in {xxhash.xxh3_64_intdigest(n.encode()) % 2**20 for n in names})
        over = [1 / (1 + math.exp(min(500, max(-500, th - x)))) for th in theta]
        each = [a - b for a, b in zip([1, *over], [*over, 0], strict=True)]
        out[i] = sum(k * p for k, p in enumerate(each)), over[0], each.index(max(each))
    return out


def test_toxicity_query_equals_brute_force(spark, small):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = toxicity.severity_model(small, labels)
    assert len(model[0]) > 3 and list(model[1]) == sorted(model[1])
    want = severities_by_force(texts_of(small), *model)
    got = queries.QUERIES["op3_toxicity"](spark, SF).collect()
    assert {r.doc_id for r in got} == want.keys()
    for r in got:
        assert (r.severity, r.score) == pytest.approx(want[r.doc_id][:2], abs=1e-9) and r.grade == want[r.doc_id][2] and r.toxic == (r.score >= toxicity.TOXIC_FROM)


def test_features_of_the_fit_are_counted_by_spark(spark, small, monkeypatch):
    """The model from Spark's counts equals one fitted to the features of all training rows at once."""
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = sorted(((r.text, r.toxic) for r in quality_model.training_rows(small, labels, "toxic", toxicity.BOUND).collect()), key=repr)
    seen = {}
    monkeypatch.setattr(toxicity, "fit", lambda x, y: (seen.update(x=x, y=y), ([], [], [0.0, 1.0]))[1])
    toxicity.severity_model(small, labels)
    x = toxicity.Sparse.of([toxicity.places_of(t) for t, _ in rows])
    assert seen["x"].places.tolist() == x.places.tolist() and seen["x"].count.tolist() == x.count.tolist() and seen["x"].n == len(rows)
    assert sorted((y > 0).item() for y in seen["y"]) == sorted(bool(y) for _, y in rows)


def test_sql_of_corpus_queries(spark):
    con = duckdb.connect()
    for t in ("documents", "labels", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    for name, sql in queries.ORACLE_SQL.items():
        got, want = queries.QUERIES[name](spark, SF), con.sql(sql)
        columns = sorted(got.columns)
        assert columns == sorted(want.columns)
        order = [want.columns.index(c) for c in columns]
        assert sorted(map(repr, ([r[c] for c in columns] for r in got.collect()))) == sorted(repr([r[i] for i in order]) for r in want.fetchall()), name


# --- 3 and 5: models


def area(score, y):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(y))
    rank[order] = np.arange(1, len(y) + 1)
    n = y.sum()
    return (rank[y == 1].sum() - n * (n + 1) / 2) / (n * (len(y) - n))


@pytest.mark.parametrize("name, column, label, least", [("op5_quality_classifier", "score", "quality", 0.97), ("op3_toxicity", "score", "toxic", 0.9)])
def test_held_out_accuracy(spark, name, column, label, least):
    sf = f"{DATA}/sf0.01"
    rows = queries.QUERIES[name](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", F.col(label).alias("y")), "doc_id").where("held_out").toPandas()
    assert len(rows) > 30 and all(zlib.crc32(str(i).encode()) % 5 == 0 for i in rows.doc_id)
    assert area(rows[column].to_numpy(), rows.y.to_numpy()) >= least
    assert rows[column].between(0, 1).all()


def test_models_on_hard_rows(spark, hard, empty):
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    one = spark.createDataFrame([(k, 1, 0) for k in range(1, 20)], "doc_id bigint, quality int, toxic int")
    for labels in (none, one):
        model = quality_model.rule_model(hard, labels)
        out = quality_model.quality_scores(hard, model)
        assert out.count() == hard.count() and out.columns == [*hard.columns, "_score"] and out.where("_score not between 0 and 1").count() == 0
        scored = toxicity.expected_severity(hard, toxicity.severity_model(hard, labels))
        assert scored.where("toxicity.p_toxic between 0 and 1").count() == hard.count()
    assert quality_model.quality_scores(empty, model).count() == 0
    assert toxicity.expected_severity(empty, toxicity.severity_model(empty, one)).count() == 0


def test_rules_as_columns_equal_rules_in_numpy(spark, small):
    rng = np.random.default_rng(0)
    x = np.array([quality_model.statistics(t) for t in texts_of(small).values()])
    y = (x[:, 4] + rng.normal(scale=0.01, size=len(x)) > np.median(x[:, 4])).astype(float)
    rules, b = quality_model.fit(x, y)
    assert rules
    scored = {r.doc_id: r.score for r in quality_model.quality_scores(small.select("doc_id", "text"), (rules, b)).collect()}
    for (i, t), row in zip(texts_of(small).items(), x, strict=True):
        total = b + sum(w for r, w in rules if quality_model.applies(r, np.array([row]))[0])
        assert scored[i] == pytest.approx(1 / (1 + np.exp(-total)))


def statistics_by_force(text):
    """The statistics from their definitions, on characters and words as they stand."""
    t = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    n, size = max(1, len(words)), max(1, len(t))
    classes = [len(re.findall(c, t)) / size for c in ("[a-z]", "[A-Z]", "[0-9]", r"[\x20\x09-\x0D]", r"[#*$%&|<>]", r"[^a-zA-Z0-9#*$%&|<>\x20\x09-\x0D\x80-\U0010FFFF]", r"[^\x00-\x7F]")]
    of = lambda test: float(sum(map(test, words))) / n
    thrice = Counter(zip(words, words[1:], words[2:], strict=False))
    repeated = {i for k in range(len(words) - 2) if thrice[tuple(words[k : k + 3])] > 1 for i in (k, k + 1, k + 2)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    m = max(1, len(lines))
    ended = lambda x: re.sub(r"[\x20\x09-\x0D]+$", "", x)[-1] in ".!?"
    shouted = lambda w: len(w.encode()) > 2 and bool(re.search("[A-Z]", w)) and not re.search("[a-z]", w)
    return (
        float(np.log1p(len(words))), float((1 - classes[3]) * size / n), *classes, of(lambda w: w == "|"), len(set(words)) / n, of(lambda w: len(w.encode()) <= 3), len(repeated) / n,
        (len(lines) - len(set(lines))) / m, n / m, sum(map(ended, lines)) / m, of(lambda w: w[-1] in ".,!?;:"), of(shouted),
    )


def test_quality_query_equals_brute_force(spark, small):
    """The registered query: statistics by their definitions, learnt from the rows outside the held-out fold, scored rule by rule."""
    texts = texts_of(small)
    label = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 0 for i in texts}
    x = {i: statistics_by_force(t) for i, t in texts.items()}
    learnt = sorted((*x[i], float(label[i])) for i in texts if label.get(i) is not None and not held[i])
    rules, b = quality_model.fit(np.array([r[:-1] for r in learnt]), np.array([r[-1] for r in learnt]))
    got = {r.doc_id: r for r in queries.QUERIES["op5_quality_classifier"](spark, SF).collect()}
    assert got.keys() == texts.keys() and rules
    for i, r in got.items():
        total = b + sum(w for rule, w in rules if all((x[i][j] > cut) == above for j, above, cut in rule))
        assert r.held_out == held[i] and r.score == pytest.approx(1 / (1 + math.exp(-total)), abs=1e-9)
        assert r.predicted == int(r.score >= 0.3)


def test_thresholds_share_weights():
    rng = np.random.default_rng(1)
    rows = [np.unique(rng.integers(0, 40, 12)).astype(np.int32) for _ in range(600)]
    severity = np.array([int(3 in r) + int(7 in r) for r in rows])
    places, w, theta = toxicity.fit(toxicity.Sparse.of(rows), severity, penalty=0.005)
    weight = dict(zip(places.tolist(), w.tolist(), strict=True))
    assert theta[0] < theta[1] and min(weight[3], weight[7]) > 5 * max(abs(v) for k, v in weight.items() if k not in (3, 7))


# --- 4: mixing


def budgets_by_force(tokens, weights, budget, epochs):
    """Leaf -> budget, by bisection of each family's level of filling."""
    paths = {p[:k] for p in tokens for k in range(1, 4)}
    weight = lambda p: max(0.0, weights.get(p, 1.0))
    capacity = lambda p: sum(n for leaf, n in tokens.items() if leaf[: len(p)] == p and all(weight(leaf[:k]) > 0 for k in range(len(p) + 1, 4))) * epochs
    given = {(): budget}
    for k in range(1, 4):
        for parent in {p[:-1] for p in paths if len(p) == k}:
            family = [(p, weight(p), capacity(p)) for p in paths if len(p) == k and p[:-1] == parent]
            low, high = 0.0, 1e15
            for _ in range(200):
                level = (low + high) / 2
                low, high = (low, level) if sum(min(c, level * w) for _, w, c in family) > given[parent] else (level, high)
            given |= {p: min(c, low * w) for p, w, c in family}
    return {p: given[p] for p in tokens}


def mixed_by_force(rows, weights, share, epochs, seed):
    """(doc_id, epoch) taken, by sorting each leaf. rows: (doc_id, leaf path, tokens)."""
    tokens = Counter()
    for _, leaf, n in rows:
        tokens[leaf] += n
    target = budgets_by_force(tokens, weights, share * sum(tokens.values()), epochs)
    out = []
    for leaf, total in tokens.items():
        if share <= 0 or any(weights.get(leaf[:k], 1) <= 0 for k in range(1, 4)):
            continue
        take = int(target[leaf] + 1e-5)
        whole = min(epochs, take // total) if total else 0
        mine = [(i, n) for i, p, n in rows if p == leaf]
        out += [(i, e) for i, _ in mine for e in range(whole)]
        if whole < epochs:
            key = lambda i, e=whole: hashlib.md5(f"{seed}:{e}:{'' if i is None else i}".encode()).hexdigest()[:14]
            upto = Counter()
            for i, n in mine:
                upto[key(i)] += n
            rest, run = take - whole * total, 0
            for k in sorted(upto):
                run += upto[k]
                if run > rest:
                    break
                out += [(i, whole) for i, _ in mine if key(i) == k]
    return sorted(out, key=repr)


def mixing_rows(df):
    rows = df.withColumn("d", mixing.default_domain(F.col("source"))).collect()
    return [(r.doc_id, (r.d, r.lang or "", r.source or ""), len((r.text or "").encode().split())) for r in rows]


def mixed(df, *args, **kwargs):
    got = mixing.mix(df, mixing.default_domain(F.col("source")), *args, **kwargs)
    return sorted(map(tuple, got.select("doc_id", got.columns[len(df.columns)]).collect()), key=repr)


@pytest.mark.parametrize("share, epochs", [(0.7, 2), (0.3, 1), (1.6, 3), (0.0, 1)])
def test_mixing_equals_sorting(spark, small, share, epochs):
    assert mixed(small, mixing.WEIGHTS, share, epochs, seed=9) == mixed_by_force(mixing_rows(small), mixing.WEIGHTS, share, epochs, 9)


def test_mixing_of_many_leaves_is_planned_by_spark(small, monkeypatch):
    weights = mixing.WEIGHTS | {("domain1", "fr"): 0.0, ("domain2", "en"): 9.0}
    plain = mixed(small, weights, 0.8, 2)
    assert plain == mixed_by_force(mixing_rows(small), weights, 0.8, 2, 13)
    monkeypatch.setattr(mixing, "PLANNED_LEAVES", 0)
    monkeypatch.setattr(mixing, "SENT_ROWS", 0)
    assert mixed(small, weights, 0.8, 2) == plain


def test_mixing_of_a_hot_leaf(spark):
    """One leaf has nine tenths of the rows, with copies and texts without tokens; another has no tokens at all."""
    rng = random.Random(8)
    rows = [(k // 2 if k % 7 == 0 else k, "en" if k % 10 else "de", "src1", " ".join(["w"] * rng.choice([0, 1, 1, 2, 50]))) for k in range(3000)]
    rows += [(k, "fr", "src2", " ") for k in range(5000, 5040)]
    df = spark.createDataFrame(rows, "doc_id bigint, lang string, source string, text string").repartition(5)
    for share in (0.37, 1.2):
        assert mixed(df, {}, share, 2) == mixed_by_force(mixing_rows(df), {}, share, 2, 13)
    texts = mixing.mix(df, F.lit("d"), {}, 0.5)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in texts and "SortMergeJoin" not in texts and "hashpartitioning" not in texts


def test_shortage_goes_to_siblings_first():
    tokens = {("a", "x", "1"): 10, ("a", "x", "2"): 1000, ("a", "y", "3"): 1000, ("b", "z", "4"): 1000}
    got = mixing.leaf_budgets(tokens, {}, 400, 1)
    assert got[("a", "x", "1")] == 10 and got[("a", "x", "2")] == pytest.approx(90) and got[("a", "y", "3")] == pytest.approx(100) and got[("b", "z", "4")] == pytest.approx(200)
    assert sum(mixing.leaf_budgets(tokens, {("b",): 0.0}, 9999, 1).values()) == 2010


def test_mixing_of_hard_rows(hard, empty):
    domain = mixing.default_domain(F.col("source"))
    out = mixing.mix(hard, domain, {}, 5.0, 2)
    assert out.columns == [*hard.columns, "_epoch", "mix_domain", "mix_lang", "mix_source"]
    counts = Counter(r.doc_id for r in out.collect())
    assert counts[6] == 2 and counts[8] == 6
    for share in (0.3, 1.1):
        assert mixed(hard, {}, share, 2) == mixed_by_force(mixing_rows(hard), {}, share, 2, 13)
    assert mixing.mix(empty, domain, {}, 1.0).count() == 0


# --- 6: quality rules


def base_by_force(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    count = Counter(windows)
    covered = {k + d for k, w in enumerate(windows) if count[w] > 1 for d in range(3)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered), n < 50 or 100 * len(covered) > 50 * n


def test_base_rules(hard, small, empty):
    for docs in (hard, small):
        rows = quality_rules.quality_rules(docs)
        name = rows.columns[-1]
        for r in rows.collect():
            q = r[name]
            assert (q.n_words, q.word_chars, q.n_symbols, q.n_dup_lines, q.n_repeat_words, q.base_failed) == base_by_force(r.text)
            assert not (q.base_failed and q.kept)
    assert quality_rules.quality_rules(hard).columns[-1] == "_quality"
    assert quality_rules.quality_rules(empty).count() == 0


def test_references_count_all_documents(small):
    refs = quality_rules.references(small)
    rows = [(r.lang, r.text) for r in small.collect()]
    for lang in {g for g, _ in rows}:
        words = Counter(w for g, t in rows if g == lang for w in t.encode().split() if len(w.decode()) <= 4)
        top = sorted(words.items(), key=lambda x: (-x[1], x[0]))[:40]
        assert list(refs[lang][1]) == [w for w, _ in top] and refs[lang][2].tolist() == [n for _, n in top]
        assert refs[lang][0][2] == sum(c in "0123456789" for g, t in rows if g == lang for c in t)
    plan = quality_rules.reference_rows(quality_rules.language_counts(small, 4))._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_each_of_many_languages_has_its_own_reference(spark, monkeypatch):
    """Of more languages than are sent to all tasks, in two scripts, each is compared with itself: by a broadcast and by an exchange."""
    rng, rows = random.Random(8), []
    for lang in range(300):
        letters = "abcdefghijklmnopqrstuvwxyz" if lang % 2 else "αβγδεζηθικλμνξοπρστυφχψω"
        words = ["".join(rng.choice(letters) for _ in range(4)) for _ in range(30)]
        rows += [(4 * lang + k, " ".join(rng.choice(words) for _ in range(150)), f"l{lang}" if lang else None, "clash", "clash") for k in range(3 + (lang < 9))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, language string, reference string").repartition(3)
    limits = {"min_reference_chars": 1000}
    refs = quality_rules.references(docs)
    assert len(refs) == 300
    want = {r[0]: quality_rules.measure(r[1], r[2], refs, quality_rules.LIMITS | limits) for r in rows}
    assert all(m[-1] and m[-2] < 0.65 and m[-3] < 0.33 for m in want.values())
    for bound in (quality_rules.SENT_REFERENCES, 0):
        monkeypatch.setattr(quality_rules, "SENT_REFERENCES", bound)
        out = quality_rules.quality_rules(docs, limits)
        assert out.columns == [*docs.columns, "quality"]
        assert sorted((r.doc_id, tuple(r.quality)) for r in out.collect()) == sorted(want.items())


def test_distance():
    assert quality_rules.js_distance(np.array([1.0, 0]), np.array([0, 5.0])) == pytest.approx(1)
    assert quality_rules.js_distance(np.array([1.0, 2]), np.array([2.0, 4])) == pytest.approx(0, abs=1e-9)


# --- 7: licenses


def licenses_by_force(text, threshold=0.85):
    """Every run of every template's length, over the words of the whole text."""
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    at = [(k, label) for p, label in licenses.PHRASES.items() for k in range(len(words)) if words[k : k + len(p.split())] == p.split()]
    labels, best, blocks = {x for _, x in at}, 1.0 if at else 0.0, 0
    for label, t in licenses.TEMPLATES:
        distinct, n = set(t.split()), len(t.split()) + len(t.split()) // 8
        if len(distinct & set(words)) < threshold * len(distinct) - 1e-9:
            continue
        covered = -1
        for k in range(len(words)):
            share = len(distinct.intersection(words[k : k + n])) / len(distinct)
            if share >= threshold - 1e-9 and words[k] in distinct:
                labels.add(label)
                best = max(best, share)
                blocks += k > covered
                covered = max(i for i in range(k, min(k + n, len(words))) if words[i] in distinct)
    starts = [k for k, _ in at]
    return len(words), len(at), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in at})), ",".join(sorted(labels)), best, blocks


def test_licenses(spark, hard, small, empty):
    extra = spark.createDataFrame([(k + 1000, t) for k, t in enumerate(
        ["permission is hereby granted, free of charge, to any person obtaining a copy of this software and the documentation files", "licensed under CC-BY-NC 4",
         "x\nThis work is licensed under a Creative Commons Attribution 4.0 International License\ny", "under the\nMIT license", "apache license version 2 apache license version 2"])],
        "doc_id bigint, text string")
    for docs in (hard, small, extra):
        out = licenses.license_scan(docs).collect()
        want = defaultdict(set)
        for r in docs.select("doc_id", "text").collect():
            want[r.doc_id].add(licenses_by_force(r.text))
        got = defaultdict(set)
        for r in out:
            best = 1.0 if r.n_base else max((f.containment for f in r.found), default=0.0)
            got[r.doc_id].add((r.n_words, r.n_base, r.first_word, r.last_word, ",".join(r.base), ",".join(sorted({*r.base, *(f.label for f in r.found)})), best, len(r.found)))
        assert got == want
    assert licenses.license_scan(empty).count() == 0


def test_wrapped_licenses(spark):
    """A template is found wherever it is wrapped: over lines, comment marks and empty lines, within other text."""
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal"
    bsd = "# Redistribution and use in source and binary forms, with or without\n# modification, are permitted provided that the following conditions\n#\n# are met:"
    gpl = "This program is free software: you can redistribute it and/or modify\n it under the terms of the GNU General Public License as published by\n the Free Software Foundation"
    # The words of a template far from each other are none.
    apart = "\n".join(f"{w} {'filler ' * 30}" for w in licenses.TEMPLATES[1][1].split())
    texts = [mit, f"{'word ' * 50}\n{mit}\n{'word ' * 50}", bsd, gpl, "\n".join(licenses.TEMPLATES[6][1].split()), apart, mit.replace("is hereby granted, free", "x y z v"),
             "the mit team released a new tool and the license was discussed under pressure", "Creative Commons Attribution-NonCommercial 4.0", "a b Creative Commons Attribution 4.0 International License"]
    out = licenses.license_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()
    got = {r.doc_id: {f.label: f.containment for f in r.found} for r in out}
    assert got == {0: {"mit": 1.0}, 1: {"mit": 1.0}, 2: {"bsd": 1.0}, 3: {"gpl-3": 1.0}, 4: {"gpl-3": 1.0}, 5: {}, 6: {}, 7: {}, 8: {"cc-by-nc": 1.0}, 9: {"cc-by": 1.0}}
    at = {r.doc_id: [(f.template, f.first, f.last) for f in r.found] for r in out}
    assert at[0] == [(1, 0, 21)] and at[1] == [(1, 50, 71)] and at[9] == [(20, 2, 7)]


def test_every_block_of_a_template_is_found(spark):
    """Two grants in one text, short templates side by side, series of equal runs, and overlapping runs that are one block."""
    mit = "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"
    short, gap = "gnu lesser general public license", "w " * 51
    texts = [f"{mit} {gap}{mit}", f"{short} {gap}{short} {gap}{short}", f"{short} {short}", f"{short} " * 50, f"{short} x y z " * 4 + gap + short, f"{mit} {mit} {gap}{gap}{mit[:60]}"]
    out = {r.doc_id: [(f.template, f.first, f.last) for f in r.found] for r in licenses.license_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()}
    assert out[0] == [(1, 0, 19), (1, 71, 90)] and out[1] == [(8, 0, 4), (8, 56, 60), (8, 112, 116)]
    for k, t in enumerate(texts):
        assert len(out[k]) == licenses_by_force(t)[-1], t[:60]
    rng = random.Random(3)
    vocabulary = (short + " x " + licenses.TEMPLATES[15][1]).split()
    texts = [" ".join(rng.choice(vocabulary) if rng.random() < 0.5 else rng.choice([short, "x y z", licenses.TEMPLATES[15][1]]) for _ in range(rng.randrange(5, 60))) for _ in range(60)]
    out = licenses.license_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()
    assert {r.doc_id: len(r.found) for r in out} == {k: licenses_by_force(t)[-1] for k, t in enumerate(texts)}


def test_licenses_of_each_row(spark):
    """Rows without or with the same doc_id stay apart, also where their counts are equal."""
    texts = ["this is licensed under CC BY-NC 4.0", "see licensed under apache license v2.0", "plain text of seven words and more"]
    rows = [(i, t) for i in (None, 7) for t in (*texts, texts[0])]
    out = licenses.license_scan(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)).collect()
    assert len(out) == len(rows)
    for i in (None, 7):
        got = sorted((r.n_words, r.n_base, tuple(sorted(f.label for f in r.found))) for r in out if r.doc_id == i)
        want = sorted((licenses_by_force(t)[0], licenses_by_force(t)[1], tuple(sorted({*licenses_by_force(t)[5].split(",")} - {""}))) for j, t in rows if j == i)
        assert got == want


# --- 8: fingerprints


def spark_hash(*parts):
    """xxhash64 of Spark, of strings and signed 64-bit numbers."""
    seed = 42
    for x in parts:
        seed = xxhash.xxh64_intdigest(x.encode() if isinstance(x, str) else struct.pack("<q", x), seed)
    return struct.unpack("<q", struct.pack("<Q", seed))[0]


def anchors_by_force(text):
    """(unit number, hash) of each anchor, from the definition."""
    units = []
    for w in re.findall(r"[^\x20\x09-\x0D]+", text):
        units += [w] if len(w) <= 24 else list(w)
    if len(units) < 5:
        units = list(text)
    if len(units) < 5:
        return [(0, spark_hash(text))] if text else []
    kmers = []
    for k in range(len(units) - 4):
        inner = [spark_hash(*units[k + j : k + j + 2]) for j in range(4)]
        kmers.append((k, spark_hash(inner[0], inner[2], inner[3]), min(inner) in (inner[0], inner[3])))
    chosen = [(k, h) for k, h, edge in kmers if edge]
    return chosen or [min(((k, h) for k, h, _ in kmers), key=lambda x: (x[1], x[0]))]


def likeness_by_force(a, b):
    first = [{h: min(at for at, g in x if g == h) for h in {h for _, h in x}} for x in (a, b)]
    moved = [first[1][h] - at for at, h in sorted((at, h) for h, at in first[0].items() if h in first[1])]
    kept = sum(m == 0 or m in moved[max(0, i - 1) : i] or m in moved[i + 1 : i + 2] for i, m in enumerate(moved))
    every = len(first[0].keys() | first[1].keys())
    return kept / every if every else 1.0


def test_fingerprint_query_equals_brute_force(spark, small, tmp_path):
    """The registered query on the small table, and on texts of few words, without spaces and without words."""
    rng = random.Random(4)
    odd = ["", " ", "ab", "abcd", "abcde", "one two", "one two three four", "a b c d e"] + [" ".join(rng.sample(WORDS, n)) for n in (5, 5, 5, 6, 6, 7, 8, 9, 10, 10) for _ in range(3)]
    odd += ["".join(rng.choice("的一是不了人我在有他这为之大来") for _ in range(n)) for n in (30, 400, 4000)] + ["x" * 300, "\U0001f600" * 30, "base64" * 40 + " end", " ".join(["same"] * 60)]
    odd += [odd[-3], odd[9]]
    spark.createDataFrame(list(enumerate(odd)), "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    for folder, rows in ((SF, sorted(texts_of(small).items())), (str(tmp_path), list(enumerate(odd)))):
        out = {r.doc_id: r for r in queries.QUERIES["op8_syncmer_fingerprints"](spark, folder).collect()}
        assert out.keys() == {i for i, _ in rows}
        for k, (i, t) in enumerate(rows):
            t, after = t or "", rows[(k + 1) % len(rows)][1] or ""
            q = len(t) // 4
            edited = t[: len(t) - q] + after[:q]
            assert out[i].n_chars == len(t) and out[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
            a, b, c = map(anchors_by_force, (t, edited, after))
            assert bool(a) == bool(t)
            whole = lambda x: sorted((h, min(at for at, g in x if g == h)) for h in {h for _, h in x}) if len(x) < 3000 else None
            for f, x in ((out[i].fingerprint, a), (out[i].edited_fingerprint, b)):
                assert whole(x) in (None, syncmers.unpacked(f)), t
            assert out[i].sketch == "".join(f"{h & 0xFFFFFFFFFFFFFFFF:016x}" for h in sorted({h for _, h in a})[:256])
            # What is returned is enough for the likeness.
            returned = [[(at, h) for h, at in syncmers.unpacked(f)] for f in (out[i].fingerprint, out[i].edited_fingerprint)]
            assert len(returned[0]) > 3000 or out[i].near_edited == pytest.approx(likeness_by_force(*returned))
            assert out[i].near_edited == pytest.approx(likeness_by_force(a, b)) and out[i].near_next == pytest.approx(likeness_by_force(a, c))


def test_fingerprints(spark, hard, small, empty):
    out = syncmers.fingerprints(small).select("text", F.length("text").alias("n"), "near_edited", "near_next").collect()
    long = [r for r in out if r.n > 800]
    assert len(long) > 50 and all(r.near_edited > 0.2 and r.near_next < 0.2 for r in long)
    done = syncmers.fingerprints(hard).collect()
    assert len(done) == hard.count() and sum(r.doc_id is None for r in done) == 1
    assert syncmers.fingerprints(empty).count() == 0
    one = spark.createDataFrame([(5, "abcd efgh")], "doc_id bigint, text string")
    assert syncmers.fingerprints(one).first().edited == "abcd efab"[:7] + "ab"


def test_sketch_is_near_the_exact_share(spark):
    rng = random.Random(12)
    rows = []
    for k in range(40):
        words = [f"w{rng.randrange(10**6)}" for _ in range(6000)]
        rows.append((" ".join(words), " ".join(words[: 150 * k] + [f"v{rng.randrange(10**6)}" for _ in range(6000 - 150 * k)])))
    df = syncmers.with_fingerprints(spark.createDataFrame(rows, "a string, b string"), {"a": "x", "b": "y"})
    exact = F.size(F.array_intersect("x_hash", "y_hash")) / F.size(F.array_union("x_hash", "y_hash"))
    errors = [abs(r.e - r.s) for r in df.select(exact.alias("e"), syncmers.sketch_likeness(syncmers.sketch(F.col("x_hash")), syncmers.sketch(F.col("y_hash"))).alias("s")).collect()]
    assert max(errors) < 0.1 and sum(errors) / len(errors) < 0.03


def test_anchors_do_not_depend_on_context(spark):
    rng = random.Random(6)
    passage = " ".join(f"w{rng.randrange(10**6)}" for _ in range(80))
    df = spark.createDataFrame([(f"{passage}", f"{' '.join(f'z{rng.randrange(10**6)}' for _ in range(33))} {passage} tail of it")], "a string, b string")
    r = syncmers.with_anchors(df, {"a": "x", "b": "y"}).first()
    at = {a.hash: a.at for a in r.y}
    assert {at.get(a.hash, -1) - a.at for a in r.x} == {33} and len(r.x) > 20
    # A passage that is moved as a whole counts in full.
    near = syncmers.with_likeness(syncmers.with_fingerprints(df, {"a": "x", "b": "y"}), "near", "x", "y").first().near
    assert near == pytest.approx(len(r.x) / len(r.y), abs=0.05)


# --- 9: BPE


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.default_vocabulary())
    t.no_truncation()
    t.no_padding()
    return t


def encoded_by_library(tokenizer, text):
    ids = tokenizer.encode(text or "", add_special_tokens=False).ids
    decoded = tokenizer.decode(ids, skip_special_tokens=False)
    return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()


def test_bpe_equals_the_library(spark, hard, small, empty, tokenizer):
    for docs in (hard, small):
        out = bpe.bpe_tokens(docs, bpe.default_vocabulary())
        for r in out.collect():
            assert (r.bpe.n_tokens, r.bpe.ids_sha256, r.bpe.decoded_sha256) == encoded_by_library(tokenizer, r.text)
            assert len(r.bpe.ids) == 4 * r.bpe.n_tokens
    assert bpe.bpe_tokens(empty, bpe.default_vocabulary()).count() == 0
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.QUERIES["op9_bpe"](spark, SF).collect()}
    assert got == {i: encoded_by_library(tokenizer, t) for i, t in texts_of(small).items()}


def test_bpe_of_random_texts(tokenizer):
    import json

    codec = bpe.Codec(json.load(open(bpe.default_vocabulary(), encoding="utf-8")))
    rng = random.Random(8)
    for _ in range(1500):
        letters = rng.choice(["ab", "the of and", "abc \n\t\x0b\x1c\x85　", "éèñß中\U0001f600", "'s'll I ", "<|endoftext|>", "0½٣ ", "՘\U0001df48a "])
        text = "".join(rng.choice(letters) if rng.random() < 0.8 else rng.choice(["<|endoftext|>", " hello", "\x00", chr(rng.randrange(32, 0xD7FF))]) for _ in range(rng.randrange(40)))
        ids = codec.encode(text)
        want = tokenizer.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want, text
        assert codec.decode(ids) == tokenizer.decode(want, skip_special_tokens=False)


# --- 10: PII


def luhn(digits):
    return sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(digits[::-1])) % 10 == 0


def spans_by_force(t):
    digits = lambda m: re.sub("[^0-9]", "", m.group())
    out = [(0, *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(1, *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m.group().split("."))]
    out += [(2, *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 13 <= len(digits(m)) <= 19 and luhn(digits(m))]
    return out + [(3, *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(digits(m)) <= 15]


def test_base_spans():
    rng = random.Random(9)
    for _ in range(20_000):
        t = "".join(rng.choice(["a", "@", ".", "1", "25", "0", "+", "-", " ", "(", ")", "4111111111111111", "b@c.d", "é", "\n", "٣"]) for _ in range(rng.randrange(22)))
        assert pii.base_spans(t) == spans_by_force(t), t


@pytest.fixture(scope="module")
def entity_model(small):
    return pii.train(pii.sample_texts(small, 400))


def test_added_spans(entity_model):
    found = lambda t: {(pii.KINDS[k], t[s:e]) for k, s, e in pii.added_spans(t, pii.scores_of(*entity_model), pii.base_spans(t))}
    assert ("phone", "212-555-0187") in found("call 212-555-0187 today")
    assert ("secret", "2c8ba23e1529b2de52654cb5a51fb56a01") in found('token = "2c8ba23e1529b2de52654cb5a51fb56a01"')
    assert not found("under the Apache License, Version 2.0.\nborn in 1984, page 12 of 340; 3.14159")
    t = "mail a@b.co from 10.0.0.1"
    assert all(y <= s or x >= e for _, x, y in pii.added_spans(t, pii.scores_of(*entity_model), pii.base_spans(t)) for _, s, e in pii.base_spans(t))


def test_windows_reach_beyond_each_trigger(entity_model):
    found = lambda t: {(pii.KINDS[k], t[s:e]) for k, s, e in pii.added_spans(t, pii.scores_of(*entity_model), pii.base_spans(t))}
    text = "Call 5 now or write to our manager jane.doe (at) example (dot) org"
    assert pii.windows(text) == [(0, len(text))]
    assert ("email", "jane.doe (at) example (dot) org") in found(text)
    assert ("email", "jane.doe at example dot org") in found("please write to jane.doe at example dot org about it")
    long = "word " * 30
    for mark in ("7", "@", "(at)", "[at]", "(dot)", "[dot]", "at x dot y"):
        line = f"{long}{mark} 3 {long}"
        # At least MARGIN on either side, and the words at the edges are whole.
        start, end = 150 - (mark[0] == "a") - pii.MARGIN, line.index("3") + 1 + pii.MARGIN
        while line[start - 1] != " ":
            start -= 1
        while line[end] != " " and line[end - 1] != " ":
            end += 1
        assert pii.windows(f"{line}\n{long}") == [(start, end)]
    assert not pii.windows(f"{long} at noon. the dot, {long}") and pii.windows("a 1\nb") == [(0, 3)]


def test_long_windows_and_addresses_are_whole(entity_model):
    scores = pii.scores_of(*entity_model)
    found = lambda t: {(pii.KINDS[k], t[s:e]) for k, s, e in pii.added_spans(t, pii.scores_of(*entity_model), pii.base_spans(t))}
    # One line and window of more than 4000 characters: each key is whole, wherever it stands.
    rng = random.Random(3)
    keys = ["".join(rng.choice("0123456789abcdef") for _ in range(60)) for _ in range(150)]
    line = " ".join(f'{k % 7} = "{key}"' for k, key in enumerate(keys))
    assert pii.windows(line) == [(0, len(line))] and len(line) > 9000
    assert {("secret", key) for key in keys} <= found(line)
    assert pii.best_entities(line, 0, len(line), scores) == pii.Lattice(line, 0, len(line), scores.number).best(scores.weights)
    for address in ("doe (at) example (dot) co (dot) uk", "a.b.c.d.e.f.g.h (at) i (dot) j (dot) k (dot) example (dot) org", f"jane.doe (at) {'n' * 90} (dot) example (dot) org"):
        assert ("email", address) in found(f"write to {address}, please")
    # Labels of any length are learnt.
    parts = "a-b-c-d-e-f-g-h-i-j (at) example (dot) org"
    lattice = pii.Lattice(parts, 0, len(parts), lambda names: [], [(0, 0, len(parts))])
    assert lattice.gold == {0: (len(lattice.tokens), 0)} and len(lattice.tokens) > pii.MAX_TOKENS


def whole_lines(text, scores):
    """The model's entities of each line, labelled as one window from end to end."""
    out, at = [], 0
    for line in text.split("\n"):
        out += pii.best_entities(text, at, at + len(line), scores)
        at += len(line) + 1
    return out


def test_addresses_of_any_length_are_whole_at_every_place(entity_model):
    scores = pii.scores_of(*entity_model)
    rng = random.Random(12)
    word = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    for n in range(1, 201):
        local, domain = word(min(n, 64)), word(n)
        address = rng.choice(["{} (at) {} (dot) org", "{}(at){}.org", "{} [at] {} [dot] org", "{} (@) {}.org"]).format(local, domain)
        before = "word " * rng.randrange(1, 40) + word(rng.randrange(1, 60)) + " "
        text = f"{before}{address}, {'word ' * 40}"
        spans = pii.added_spans(text, scores, [])
        assert (0, len(before), len(before) + len(address)) in spans, (n, address)
        assert pii.redacted(text, spans).startswith(before + "[EMAIL], word")


def test_windows_lose_nothing_that_whole_lines_give(entity_model, small):
    scores = pii.scores_of(*entity_model)
    lines = [t for t in texts_of(small).values() if t and len(t) < 4000]
    extra = [f"{'w ' * k}{'y' * k} jane.{'x' * k} (at) {'d' * 2 * k} (dot) org and {'z' * k}\n7 {'k' * k} sk-proj-a1b2c3d4-e5f6a7b8 {'m' * k}" for k in range(1, 90, 4)]
    for t in lines + extra:
        assert pii.added_spans(t, scores, []) == whole_lines(t, scores), t[:80]


def test_forms_in_capitals_and_keys_of_groups(entity_model):
    scores = pii.scores_of(*entity_model)
    found = lambda t: {(pii.KINDS[k], t[s:e]) for k, s, e in pii.added_spans(t, scores, pii.base_spans(t))}
    for kind, entity in (("email", "jane (@) example.org"), ("email", "jane AT example DOT org"), ("email", "JANE.DOE (AT) EXAMPLE (DOT) ORG"), ("secret", "sk-proj-a1b2c3d4-e5f6a7b8"), ("secret", "pk_live_51Habc92kdLm3")):
        assert (kind, entity) in found(f"please use {entity} from now on"), entity
    assert not found("the covid-19-2020-2021-wave page; see report-final-2019-05-17-draft, LOOK AT us")


def test_keys_are_whole_wherever_they_stand(entity_model):
    scores, key = pii.scores_of(*entity_model), "2c8ba23e1529b2de52654cb5a51fb56a01"
    for offset in range(0, 8001, 97):
        t = ("1 " * offset)[:offset].rstrip() + f' "{key}" ' + "1 " * 40
        assert ("secret", key) in {(pii.KINDS[k], t[s:e]) for k, s, e in pii.added_spans(t, scores, pii.base_spans(t))}, offset


def test_time_is_in_proportion_to_length(entity_model):
    scores = pii.scores_of(*entity_model)
    for t in ("1" * 1_000_000, "1" * 500_000 + "." + "2" * 500_000, "12 " * 300_000, "+1" * 300_000, "a@" * 300_000, "1." * 300_000):
        began = time.time()
        pii.base_spans(t)
        assert time.time() - began < 2, t[:4]
    began = time.time()
    assert pii.added_spans("7" * 1_000_000, scores, []) == [] and len(pii.added_spans("a1" * 500_000, scores, [])) == 1
    assert time.time() - began < 10


def test_best_labelling_is_the_best_of_all(entity_model):
    """Against the listing of every labelling of short texts."""
    scores = pii.scores_of(*entity_model)
    for text in ("at 10.0.0.1 or", "call 212-555-0187", "x (at) y (dot) org", "12-34 5678901"):
        tokens, whole = pii.tokens_of(text, 0, len(text))

        def labellings(i):
            if i == len(tokens):
                yield 0.0, []
                return
            for j, k in pii.segments(text, tokens, i, whole.get(i, set())):  # noqa: B023
                own = sum(scores.weights[f] for f in scores.number(pii.features(text, tokens, i, j, k)))  # noqa: B023
                for value, rest in labellings(j):
                    yield own + value, ([(k, tokens[i][0], tokens[j - 1][1])] if k != pii.OTHER else []) + rest  # noqa: B023

        every = list(labellings(0))
        assert len(every) > 1
        assert pii.best_entities(text, 0, len(text), scores) == max(every, key=lambda x: x[0])[1]
        assert pii.Lattice(text, 0, len(text), scores.number).best(scores.weights) == max(every, key=lambda x: x[0])[1]


def test_pii_query_equals_brute_force(spark, small, entity_model):
    """The registered query: base counts and hash by the contract's patterns; all spans by labelling each text anew."""
    texts = texts_of(small)
    joined = lambda spans: ",".join(f"{pii.KINDS[k]}:{s}:{e}" for k, s, e in sorted(spans))
    got = {r.doc_id: r for r in queries.QUERIES["op10_pii"](spark, SF).collect()}
    assert got.keys() == texts.keys()
    for i, t in texts.items():
        base, r = spans_by_force(t or ""), got[i]
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == n for k, _, _ in base) for n in range(4))
        assert r.base_sha256 == hashlib.sha256(joined(base).encode()).hexdigest()
        number = pii.scores_of(*entity_model).number
        found = [x for s, e in pii.windows(t or "") for x in pii.Lattice(t, s, e, number).best(entity_model[1])]
        assert r.spans == joined(base + [x for x in found if all(x[2] <= s or x[1] >= e for _, s, e in base)])


def test_sample_counts_copies_once(spark):
    rows = [("call +1 212 555 0134 now",)] * 400 + [(f"number {k} of the list, mail a{k}@b.co",) for k in range(30)]
    got = pii.sample_texts(spark.createDataFrame(rows, "text string"), 20)
    assert len(got) == len(set(got)) == 20


def test_gradient_is_the_slope():
    numbers = {}
    text = "call +1 212 555 0134 now"
    lattice = pii.Lattice(text, 0, len(text), lambda names: [numbers.setdefault(x, len(numbers)) for x in names], [(3, 5, 20)])
    w = np.random.default_rng(2).normal(size=len(numbers)) * 0.1
    value, slope = lattice.gradient(w)
    for f in list(slope)[:12]:
        step = w.copy()
        step[f] += 1e-5
        assert (lattice.gradient(step)[0] - value) / 1e-5 == pytest.approx(slope[f], abs=1e-3)


def test_pii_of_hard_rows(hard, empty, entity_model):
    rows = pii.find_spans(hard, model=entity_model, redact=True).collect()
    assert len(rows) == hard.count()
    for r in rows:
        assert [(pii.KINDS.index(s.kind), s.start, s.end) for s in r.pii.base] == spans_by_force(r.text or "")
        assert (r.pii.redacted is None) == (r.text is None)
    assert next(r.pii.redacted for r in rows if r.doc_id == 13) == "[EMAIL] [IP] [PHONE], [CARD]"
    assert pii.find_spans(empty).count() == 0


# --- helpers


def test_hashed_sample_is_bounded_and_stable(spark):
    df = spark.range(5000).withColumn("v", F.col("id") % 3)
    a = [r.id for r in common.hashed_sample(df, "id", 100).collect()]
    assert len(a) == 100 and a == [r.id for r in common.hashed_sample(df.repartition(7), "id", 100).collect()]
    ordered = [r.id for r in df.orderBy(F.xxhash64("id")).limit(100).collect()]
    assert a == ordered
    assert common.hashed_sample(df.limit(0), "id", 100).count() == 0 and common.hashed_sample(df.limit(7), "id", 100).count() == 7


def test_a_cluster_must_name_a_shared_folder(monkeypatch):
    class Session:
        class sparkContext:  # noqa: N801
            master = "spark://host:7077"
            getCheckpointDir = staticmethod(lambda: None)

        conf = {}

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(Session)


def test_what_an_operator_kept_is_freed():
    first = common.once(("a",), lambda: [1])
    assert common.once(("a",), lambda: [2]) is first and common.once(("b",), lambda: [3]) == [3] and common.once(("a",), lambda: [4]) == [4]
    common.release()
    assert common.once(("a",), lambda: [5]) == [5]
    common.release()


def test_nothing_else_imports_the_subpackage():
    import pathlib

    root = pathlib.Path(common.__file__).parents[1]
    others = [p for p in root.rglob("*.py") if "llm" not in p.parts[len(root.parts) :]]
    assert len(others) > 10 and not [p for p in others if "wavegrid.llm" in p.read_text() or "import llm" in p.read_text()]
