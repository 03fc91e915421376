"""Sketch dedup, vector codes and the conversation trie against brute force and on hard cases."""

import hashlib
import math
import random
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import DATA
from tests.llm.test_corpus import WORDS, hard_rows, near_rows
from tests.llm.test_corpus import SCHEMA as HARD
from wavegrid.llm import common, queries, sketch_dedup, turn_trie, vector_codes

SF = f"{DATA}/sf0.001"


# --- 11: sketch dedup


def pairs_of_words(text):
    w = (text or "").encode().lower().split()
    return frozenset([b" ".join(w[k : k + 2]) for k in range(len(w) - 1)] if len(w) >= 2 else w)


def deduped_by_force(rows):
    """(n, component, kept) of each row, all pairs compared. rows: (doc_id, text)."""
    sets = [pairs_of_words(t) for _, t in rows]
    parent = {}

    def find(a):
        while parent.setdefault(a, a) != a:
            a = parent[a]
        return a

    for x, (i, _) in enumerate(rows):
        for y in range(x):
            a, b, j = sets[x], sets[y], rows[y][0]
            if i is None or j is None or not a or not b:
                continue
            if i == j or 100 * len(a & b) >= 80 * len(a | b):
                p, q = sorted((find(i), find(j)))
                parent[q] = p
    out = []
    for (i, _), s in zip(rows, sets, strict=True):
        c = i if i is None or not s else find(i)
        out.append((i, len(s), c, i is None or i == c))
    return sorted(out, key=repr)


def deduped(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in sketch_dedup.near_copies(df).collect()), key=repr)


@pytest.mark.parametrize("seed,block", [(1, 1024), (2, 6), (3, 2)])
def test_dedup_equals_all_pairs(spark, seed, block, monkeypatch):
    """Also where large components are cut into small blocks, so that open bands are compared again."""
    monkeypatch.setattr(sketch_dedup, "BLOCK_CLASSES", block)
    if seed == 3:
        monkeypatch.setattr(sketch_dedup, "SENT_ROWS", 0)
        monkeypatch.setattr(common, "SENT_ROWS", 0)
    rows = near_rows(seed)
    assert deduped(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)) == deduped_by_force(rows)


def test_chunks_of_large_groups_meet_again(spark, monkeypatch):
    """Two tight families with a chain of texts between them, in blocks of three."""
    monkeypatch.setattr(sketch_dedup, "BLOCK_CLASSES", 3)
    rng = random.Random(4)
    words = [f"w{k}" for k in range(200)]
    rows = []
    for step in range(0, 60, 6):
        text = [f"v{k}" if k < step else w for k, w in enumerate(words)]
        for _ in range(12 if step in (0, 54) else 1):
            t = list(text)
            t[rng.randrange(60, 200)] = f"x{rng.random()}"
            rows.append((len(rows), " ".join(t)))
    rng.shuffle(rows)
    want = deduped_by_force(rows)
    assert {r[2] for r in want} == {0}
    assert deduped(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)) == want


def test_dedup_of_hard_rows(spark):
    rows = hard_rows()
    assert deduped(spark.createDataFrame(rows, HARD).repartition(3)) == deduped_by_force([r[:2] for r in rows])
    assert sketch_dedup.near_copies(spark.createDataFrame([], HARD)).collect() == []


def test_sketch_fills_and_is_near_the_similarity():
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 30, 300, 20_000):
        s = np.unique(rng.integers(-(2**63), 2**63, n))
        a = sketch_dedup.sketch(s)
        assert (a != sketch_dedup.EMPTY).all() and (a >> sketch_dedup.VALUE_BITS).max() < 2 * sketch_dedup.T
        assert (sketch_dedup.sketch(s[rng.permutation(len(s))]) == a).all()
    for n in (5, 50, 2000):
        shares = []
        for _ in range(30):
            s = rng.integers(-(2**63), 2**63, 2 * n)
            shares.append(np.mean(sketch_dedup.sketch(np.sort(s[: n + n // 2])) == sketch_dedup.sketch(np.sort(s[n // 2 :]))))
        same = (n + n // 2) - n // 2
        assert abs(np.mean(shares) - same / (2 * n)) < 0.02


def test_sketch_equals_the_rounds_one_by_one():
    rng = np.random.default_rng(2)
    for n in (1, 7, 100, 3000):
        s = np.sort(rng.integers(-(2**63), 2**63, n))
        want = [None] * sketch_dedup.T
        for i in range(2 * sketch_dedup.T):
            if None not in want:
                break
            h = sketch_dedup.mixed(s.view(np.uint64) ^ sketch_dedup.ROUND_SEEDS[i]).tolist()
            here = defaultdict(list)
            for x in h:
                here[x >> int(sketch_dedup.BIN_SHIFT) if i < sketch_dedup.T else i - sketch_dedup.T].append(x & (2**48 - 1))
            for b, values in here.items():
                if want[b] is None:
                    want[b] = i << 48 | min(values)
        assert sketch_dedup.sketch(s).tolist() == want


def test_a_family_of_near_copies_is_not_compared_pair_by_pair(monkeypatch):
    import pyarrow as pa

    rng = np.random.default_rng(3)
    base = np.unique(rng.integers(-(2**63), 2**63, 400))
    sets = [np.sort(np.append(base, rng.integers(-(2**63), 2**63, 3))) for _ in range(200)]
    calls = []
    plain = sketch_dedup.linked
    monkeypatch.setattr(sketch_dedup, "linked", lambda a, b: (calls.append(1), plain(a, b))[1])
    block = pa.table({"of": range(200), "side": [2] * 200, "keys": [sketch_dedup.bands_of(s).tolist() for s in sets], "shingles": pa.array([s.tolist() for s in sets], pa.list_(pa.int64()))})
    assert sketch_dedup.verified(block).num_rows == 199 and len(calls) < 400


# --- 12: vector codes


def codes_by_force(rows, parts=16, entries=64, rounds=2):
    """[(vec_id, label, code, error)] and the codebooks. rows: (vec_id, embedding, label)."""
    rows = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    rows.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not rows:
        return [], []
    rows = [r for r in rows if len(r[1]) == len(rows[0][1])]
    m = len(rows[0][1]) // parts
    q = [[[math.floor(256 * x) for x in v[p * m : (p + 1) * m]] for p in range(parts)] for _, v, _ in rows]
    books = [[q[k][p] for k in range(min(entries, len(q)))] for p in range(parts)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), k) for k, c in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            held = defaultdict(list)
            for x in q:
                held[nearest(x[p], books[p])[1]].append(x[p])
            books[p] = [[sum(c) // len(held[k]) for c in zip(*held[k], strict=True)] if k in held else e for k, e in enumerate(books[p])]
    out = []
    for (i, _, label), x in zip(rows, q, strict=True):
        at = [nearest(x[p], books[p]) for p in range(parts)]
        out.append((i, label, "".join(f"{k:02x}" for _, k in at), sum(d for d, _ in at)))
    return out, books


VECTORS = "vec_id bigint, embedding array<float>, label int, code string, error string, p string"


def vectors(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash", "clash") for r in rows], VECTORS).repartition(3)


def given_vectors(seed, n, length=32, grid=None):
    rng = random.Random(seed)
    value = (lambda: rng.choice(grid) / 256) if grid else (lambda: float(np.float32(rng.gauss(0, 0.125))))
    return [(k, [value() for _ in range(length)], rng.choice([None, 0, 1, 2])) for k in range(n)]


@pytest.mark.parametrize("rows", [given_vectors(1, 300), given_vectors(2, 200, 16, [-1, 0, 1]), given_vectors(3, 40, 48), given_vectors(4, 150, 16, [2**20, 2**20 + 1, -(2**21)])])
def test_codes_equal_brute_force(spark, rows):
    """Random vectors, many ties, fewer vectors than entries, and integers beyond the precision of 32-bit floats."""
    found, books = vector_codes.product_codes(vectors(spark, rows))
    want, wanted_books = codes_by_force(rows)
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(want, key=repr)
    assert books.tolist() == wanted_books


def test_codes_of_hard_rows(spark):
    rng = random.Random(7)
    good = [float(np.float32(rng.gauss(0, 1))) for _ in range(16)]
    rows = [(5, good, 1), (5, good, None), (5, [-x for x in good], 1), (None, good, None), (2, None, 1), (3, [None, *good[1:]], 1), (4, [math.nan, *good[1:]], 1), (6, [math.inf, *good[1:]], 2),
            (7, [], 1), (8, good * 2, 1), (9, [0.0] * 16, None), (10, [float(np.float32(3e12)), *good[1:]], 3), (11, [float(np.float32(-3e12)), *good[1:]], 3)]
    found, books = vector_codes.product_codes(vectors(spark, rows))
    want, wanted_books = codes_by_force(rows)
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(want, key=repr) and len(want) == 7
    assert books.tolist() == wanted_books
    found, books = vector_codes.product_codes(vectors(spark, rows[4:7]))
    assert found.collect() == [] and books.size == 0
    assert vector_codes.product_codes(spark.createDataFrame([], VECTORS))[0].collect() == []
    with pytest.raises(ValueError, match="cannot be cut"):
        vector_codes.product_codes(vectors(spark, [(1, [1.0] * 17, 0)]))


def test_huge_components_are_exact():
    x = np.array([[2**70, 0], [5, 2**40]], object)
    book = np.array([[2**70 + 1, 0], [2**70, 1], [0, 2**40]], object)
    at, d = vector_codes.nearest(x, book)
    assert at.tolist() == [0, 2] and d.tolist() == [1, 25]


@pytest.mark.parametrize("size", [3, 200, 2**14, 2**24, 2**27])
def test_screening_never_loses_the_nearest(size):
    """Entries whose distances are equal or differ by one, at all magnitudes."""
    rng = np.random.default_rng(size)
    x = rng.integers(-size, size, (500, 4))
    book = np.concatenate([x[rng.integers(0, 500, 30)] + rng.integers(-1, 2, (30, 4)), rng.integers(-size, size, (34, 4))])
    at, d = vector_codes.nearest(x, book)
    exact = ((x[:, None].astype(object) - book[None].astype(object)) ** 2).sum(axis=2)
    assert at.tolist() == exact.argmin(axis=1).tolist() and d.tolist() == exact.min(axis=1).tolist()


def test_codes_decode_to_their_entries(spark):
    rows = given_vectors(5, 100)
    found, books = vector_codes.product_codes(vectors(spark, rows))
    given = dict((i, v) for i, v, _ in rows)
    for r in found.collect():
        back = vector_codes.decoded(r.code, books)
        assert ((np.floor(256 * np.array(given[r.vec_id])) - 256 * back) ** 2).sum() == r.error


# --- 13: conversation trie


def rebuilt_by_force(rows):
    """conv_id -> turns. rows: (conv_id, turn, role, text)."""
    own = defaultdict(list)
    for c, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        own[c].append((role or "", text or ""))
    out = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = own.get(c - int(math.fmod(c, 100)), [])[:h] + own[c][h:]
    return own, out


def trie_by_force(convs):
    members = defaultdict(list)
    for c, turns in sorted(convs.items()):
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[q] for q in children[p]) if children[p] else 1
        saved[p] = sum(saved[q] for q in children[p]) + ((len(members[p]) - 1) * len(p[-1][1]) if p else 0)
    out = []
    for p, cs in members.items():
        ends = ",".join(str(c) for c in cs if len(convs[c]) == len(p))
        out.append((cs[0], len(p), members[p[:-1]][0] if p else None, len(cs), len(children[p]), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out)


TURNS = "conv_id bigint, turn bigint, role string, text string, name string, n string, key string, d string"


def given_turns(seed, convs=60, longest=9):
    """Conversations that share beginnings, copies, ties, nulls, repeated rows, other heads of hundreds, and negative ids."""
    rng = random.Random(seed)
    rows = [(None, 0, "user", "no id"), (7, None, None, None), (7, 3, "user", ""), (7, 3, "user", "tie"), (7, 3, "user", "tie"), (7, 3, "assistant", "tie"), (205, 0, "user", "x" * 3000), (205, 0, "user", "x" * 2999 + "y"), (205, 0, "user", "x" * 3000)]
    # Of a hundred without a first conversation, those whose head is longer than one turn have no turns.
    rows += [(c, 0, "user", "alone") for c in range(1001, 1011)]
    talks = [[("user", rng.choice(WORDS))] for _ in range(4)]
    for _ in range(convs):
        talk = list(rng.choice(talks))[: rng.randrange(1, longest)]
        while len(talk) < longest and rng.random() < 0.7:
            talk.append((rng.choice(["user", "assistant"]), " ".join(rng.choices(WORDS[:3], k=2))))
        talks.append(talk)
        c = rng.choice([rng.randrange(-250, 400), 100 * rng.randrange(-2, 4)])
        rows += [(c, t, *x) for t, x in enumerate(talk)]
    rng.shuffle(rows)
    return rows


def trie_rows(df):
    return sorted(tuple(r) for r in df.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect())


@pytest.mark.parametrize("seed,run", [(1, 1024), (2, 4)])
def test_trie_equals_brute_force(spark, seed, run, monkeypatch, tmp_path):
    """Also where conversations are cut into runs of four turns, and ids into short strings."""
    monkeypatch.setattr(turn_trie, "RUN", run)
    monkeypatch.setattr(turn_trie, "RUN_BYTES", 20 if run == 4 else 65_536)
    monkeypatch.setattr(turn_trie, "SENT_ROWS", 0 if run == 4 else 10**6)
    rows = given_turns(seed, longest=23 if run == 4 else 9)
    df = spark.createDataFrame([(*r, "clash", "clash", "clash", "clash") for r in rows], TURNS).repartition(4)
    own, convs = rebuilt_by_force(rows)
    assert trie_rows(turn_trie.conversation_trie(df)) == trie_by_force(own)
    df.write.parquet(f"{tmp_path}/conversations.parquet")
    want = trie_by_force(convs)
    assert trie_rows(queries.QUERIES["op13_turn_trie"](spark, str(tmp_path))) == want
    assert any(n == 0 for n in map(len, convs.values())) and max(r[3] for r in want if r[1] > 0) > 3


def test_trie_of_one_long_conversation_and_of_none(spark, monkeypatch):
    monkeypatch.setattr(turn_trie, "RUN", 16)
    rows = [(c, t, "user", f"turn {t}" if t < 150 or c == 1 else f"{c} {t}", *["x"] * 4) for c in (1, 2, 3) for t in range(200)]
    df = spark.createDataFrame(rows, TURNS).repartition(3)
    assert trie_rows(turn_trie.conversation_trie(df)) == trie_by_force(rebuilt_by_force([r[:4] for r in rows])[0])
    assert turn_trie.conversation_trie(spark.createDataFrame([], TURNS)).collect() == []


def test_equal_turns_may_be_in_several_ranges(spark):
    """A turn that is repeated very often is dealt to several ranges, and its places are still dense."""
    df = spark.createDataFrame([(1, 0, "user", "again", *["x"] * 4)] * 500 + [(1, 1, "user", "end", *["x"] * 4)], TURNS).repartition(5)
    rows = turn_trie.ordered(df).collect()
    assert sorted(r.pos for r in rows) == list(range(501)) and [r.chars for r in rows if r.pos == 500] == [3]


# --- all


@pytest.mark.parametrize("name", ["op11_sketch_dedup", "op12_vector_codes", "op13_turn_trie"])
def test_sql_of_new_queries(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = queries.QUERIES[name](spark, SF)
    want = con.sql(queries.ORACLE_SQL[name])
    columns = sorted(got.columns)
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    a, b = sorted(repr(tuple(r[c] for c in columns)) for r in got.collect()), sorted(repr(tuple(r[i] for i in at)) for r in want.fetchall())
    assert a and a == b


def test_equal_rows_meet_everywhere(spark):
    """Whole tables of copies."""
    docs = spark.range(60).select(F.col("id").alias("doc_id"), F.lit("the same text of a few words").alias("text"))
    assert [tuple(r) for r in sketch_dedup.near_copies(docs).groupBy("component_id").agg(F.count(F.when(F.col("kept"), 1)), F.count(F.lit(1))).collect()] == [(0, 1, 60)]
