"""Vector code compression: product codes of integer vectors, exact to the last bit.

A vector's components become integers, floor(256 x), and are cut into PARTS equal consecutive
parts. Each part position has a codebook of up to ENTRIES entries, which starts as that part of
the smallest vec_ids' vectors and is moved in ROUNDS rounds to the floor of the mean of the parts
that it is nearest to.

The nearest entry is screened by matrix products in float32: for a part x and an entry c,
|c|^2 - 2 x c differs from |x - c|^2 by the same number for all entries. With u = 2^-24 a float32
product sum of m terms of rounded factors is off by (m + 2) u / (1 - (m + 2) u) * |x| |c| at most,
in any order of summation, so each entry has an interval that holds its exact value. Where only
the best entry's interval reaches below the least upper end, it is the nearest; all entries whose
intervals do are compared again in 64-bit integers, and of equal ones the first is taken.
Integers too large for 64-bit squares are compared as Python's, which have no bound.

The codebooks (PARTS x ENTRIES x part length integers) are all that is sent to the tasks; a task
returns its sums for each entry, so a round's exchange grows with tasks, not with rows.

Edge cases: rows whose vector is null or holds null, NaN or an infinity are dropped, and rows whose
vector has another length than that of the smallest vec_id, which must be a multiple of PARTS;
without kept rows the result is empty. Repeated vec_ids are rows of their own; the first vectors
are taken in the order of vec_id, then of the vectors; a null vec_id comes last. With fewer rows
than ENTRIES there are as many entries. Null labels belong together. An error beyond 64 bits
raises. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavegrid.llm.common import columns_of, cut, small_side

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Vectors that are compared at once.
STEP = 2048
U = 2.0**-24


def whole(batch_values: pa.Array, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows that are kept, and their integers (rows, length): int64, or Python's where these are too large."""
    sizes = np.asarray(batch_values.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False))
    on = np.flatnonzero(sizes == length)
    flat = batch_values.take(pa.array(on)).flatten().cast(pa.float64())
    values = np.asarray(flat.fill_null(math.nan).to_numpy(zero_copy_only=False), float).reshape(len(on), length)
    good = np.isfinite(values).all(axis=1)
    scaled = np.floor(SCALE * values[good])
    if len(scaled) and np.abs(scaled).max() >= 2.0**62:
        exact = np.array([math.floor(SCALE * x) if abs(x) < 1e300 else math.floor(x) * SCALE for x in values[good].ravel().tolist()], object)
        return on[good], exact.reshape(-1, length)
    return on[good], scaled.astype(np.int64)


def fits(length: int, *arrays: np.ndarray) -> bool:
    """Whether squared distances of parts of so many components stay below 2^62."""
    most = max([1, *(int(abs(a).max()) for a in arrays if a.size)])
    return all(a.dtype != object for a in arrays) and length * (2 * most) ** 2 < 2**62


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, squared distance) of each part's nearest entry, the first of equal ones. x: (rows, m), book: (entries, m)."""
    m = x.shape[1]
    if not fits(m, x, book):
        x, book = x.astype(object), book.astype(object)
        d = np.stack([((x - c) ** 2).sum(axis=1) for c in book], axis=1)
        at = d.argmin(axis=1)
        return at, d[np.arange(len(x)), at]
    xf, cf = x.astype(np.float64), book.astype(np.float64)
    squares = (cf * cf).sum(axis=1)
    products = (x.astype(np.float32) @ book.astype(np.float32).T).astype(np.float64)
    value = squares - 2 * products
    gamma = (m + 2) * U / (1 - (m + 2) * U)
    norms = np.sqrt((xf * xf).sum(axis=1))[:, None] * np.sqrt(squares)
    # The double-precision steps above are off by far less than a part in 2^40 of their terms.
    radius = (2 * gamma * norms + (squares + 2 * np.abs(products)) * 2.0**-40) * (1 + 2.0**-20)
    reach = value - radius <= (value + radius).min(axis=1, keepdims=True)
    at = value.argmin(axis=1)
    unsure = np.flatnonzero(reach.sum(axis=1) > 1)
    if len(unsure):
        i, j = np.nonzero(reach[unsure])
        d = ((x[unsure[i]] - book[j]) ** 2).sum(axis=1)
        # In order of row, distance and place: a row's first is its nearest entry, the first of equal ones.
        order = np.lexsort((j, d, i))
        first = np.concatenate([[True], i[order][1:] != i[order][:-1]])
        at[unsure[i[order][first]]] = j[order][first]
    return at, ((x - book[at]) ** 2).sum(axis=1)


def first_books(rows: DataFrame, parts: int, entries: int) -> tuple[int, np.ndarray]:
    """The vectors' length and the codebooks (parts, entries, part length) of the smallest vec_ids."""
    def finite(v):
        return v.isNotNull() & ~F.isnan(v) & (F.abs(v) < math.inf)

    kept = rows.where(F.col("embedding").isNotNull() & F.forall("embedding", finite))
    order = [F.asc_nulls_last("vec_id"), F.asc("embedding")]
    head = kept.orderBy(*order).limit(1).collect()
    length = len(head[0].embedding) if head else 0
    if length % parts:
        raise ValueError(f"vectors of {length} components cannot be cut into {parts} equal parts")
    if not length:
        return 0, np.zeros((parts, 0, 0), np.int64)
    found = kept.where(F.size("embedding") == length).orderBy(*order).limit(entries).collect()
    _, values = whole(pa.array([r.embedding for r in found], pa.list_(pa.float64())), length)
    return length, np.ascontiguousarray(values.reshape(len(found), parts, length // parts).transpose(1, 0, 2))


def moved(rows: DataFrame, length: int, books: np.ndarray) -> np.ndarray:
    """The codebooks after one round."""
    parts, entries, m = books.shape
    sent = rows.sparkSession.sparkContext.broadcast(books)

    def sums(batches):
        count, total = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, m), object)
        for batch in batches:
            _, values = whole(batch.column("embedding"), length)
            for begin in range(0, len(values), STEP):
                x = values[begin : begin + STEP].reshape(-1, parts, m)
                for p in range(parts):
                    at, _ = nearest(x[:, p], sent.value[p])
                    count[p] += np.bincount(at, minlength=entries)
                    part = np.zeros((entries, m), x.dtype)
                    np.add.at(part, at, x[:, p])
                    total[p] += part
        p, k = (a.ravel() for a in np.indices((parts, entries)))
        on = count.ravel() > 0
        # Sums as digits of base 2^48, so that they have no bound and Spark can add them up.
        flat = total.reshape(-1, m)[on]
        digits = [[[int(v) >> 96, int(v) >> 48 & (1 << 48) - 1, int(v) & (1 << 48) - 1] for v in row] for row in flat]
        each = [x for row in digits for x in row]
        pk = [np.repeat(a[on], m) for a in (p, k)]
        yield pa.record_batch(
            [pa.array(pk[0], pa.int32()), pa.array(pk[1], pa.int32()), pa.array(np.tile(np.arange(m), int(on.sum())), pa.int32()), pa.array(np.repeat(count.ravel()[on], m), pa.int64()),
             *[pa.array([x[d] for x in each], pa.int64()) for d in range(3)]],
            names=["p", "k", "i", "n", "high", "mid", "low"],
        )

    each = rows.select("embedding").mapInArrow(sums, "p int, k int, i int, n bigint, high bigint, mid bigint, low bigint")
    wide = [F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("high", "mid", "low")]
    out = books.astype(object)
    # One row for each number of the codebooks.
    for r in each.groupBy("p", "k", "i").agg(F.sum("n").alias("n"), *wide).collect():
        out[r.p, r.k, r.i] = ((int(r.high) << 96) + (int(r.mid) << 48) + int(r.low)) // r.n
    return out.astype(np.int64) if all(abs(v) < 2**62 for v in out.ravel().tolist()) else out


def codes(rows: DataFrame, length: int, books: np.ndarray) -> DataFrame:
    """(vec_id, label, code, error)."""
    parts, entries, m = books.shape
    sent = rows.sparkSession.sparkContext.broadcast(books)
    kinds = dict(rows.dtypes)

    def encode(batches):
        digits = np.array([f"{k:02x}" for k in range(max(entries, 1))])
        for batch in batches:
            on, values = whole(batch.column("embedding"), length)
            texts, errors = [], []
            for begin in range(0, len(values), STEP):
                x = values[begin : begin + STEP].reshape(-1, parts, m)
                found = [nearest(x[:, p], sent.value[p]) for p in range(parts)]
                texts += ["".join(row) for row in digits[np.stack([at for at, _ in found], axis=1)].tolist()]
                errors += np.stack([d.astype(object) for _, d in found], axis=1).sum(axis=1).tolist()
            kept = pa.array(on, pa.int64())
            yield pa.record_batch([batch.column("vec_id").take(kept), batch.column("label").take(kept), pa.array(texts, pa.string()), pa.array(errors, pa.int64())], names=["vec_id", "label", "code", "error"])

    return rows.select("vec_id", "label", "embedding").mapInArrow(encode, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error bigint")


def product_codes(embeddings: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """((vec_id, label, code, error), codebooks) of embeddings (vec_id, embedding, label); the codebooks are (parts, entries, part length)."""
    if not 1 <= entries <= 256:
        raise ValueError("a code has two hexadecimal digits a part, so there are at most 256 entries")
    rows = embeddings.select(*columns_of(embeddings, "vec_id", "embedding", "label"))
    length, books = first_books(rows, parts, entries)
    for _ in range(rounds if length else 0):
        books = moved(rows, length, books)
    return codes(rows.where(F.lit(bool(length))), length, books), books


def decoded(code: str, books: np.ndarray) -> np.ndarray:
    """The vector that a code stands for."""
    return np.concatenate([books[p, int(code[2 * p : 2 * p + 2], 16)] for p in range(len(books))]) / SCALE


def op12_vector_codes(spark, sf_dir: str) -> DataFrame:
    found, books = product_codes(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    found = cut(found)
    # A label may have a third of all rows: sums are partial before the exchange, and the larger side of the join can be split.
    by_label = cut(found.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error")))
    told = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    joined = found.join(small_side(by_label), found.label.eqNullSafe(by_label.of))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(told).alias("codebooks_sha256"))


def _round(last: int) -> str:
    """CTEs of one round: the nearest entries by the codebooks cb{last}, then cb{last + 1}."""
    floor = "CAST((s - ((s % n) + n) % n) // n AS BIGINT)"
    return f"""
nn{last} AS (SELECT vec_id, rid, p, min(struct_pack(d := d, k := k)) AS best FROM (
  SELECT q.vec_id, q.rid, q.p, c.k, list_sum(list_transform(list_zip(q.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM q JOIN cb{last} c ON q.p = c.p) GROUP BY ALL),
sm{last} AS (SELECT p, k, i, CAST(sum(x) AS BIGINT) AS s, CAST(count(*) AS BIGINT) AS n FROM (
  SELECT nn{last}.p, best.k AS k, unnest(range(1, len(v) + 1)) AS i, unnest(v) AS x FROM nn{last} JOIN q ON q.rid = nn{last}.rid AND q.p = nn{last}.p) GROUP BY ALL),
cb{last + 1} AS (SELECT c.p, c.k, coalesce(m.v, c.v) AS v FROM cb{last} c LEFT JOIN (SELECT p, k, list({floor} ORDER BY i) AS v FROM sm{last} GROUP BY ALL) m ON m.p = c.p AND m.k = c.k),"""


OP12_SQL = f"""
WITH e AS (SELECT vec_id, label, embedding, row_number() OVER (ORDER BY vec_id, embedding) AS rid FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
q AS MATERIALIZED (SELECT vec_id, rid, CAST(p AS BIGINT) AS p, v[p * w + 1:(p + 1) * w] AS v FROM (
  SELECT vec_id, rid, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v, len(embedding) // {PARTS} AS w FROM e), range({PARTS}) AS r(p)),
cb0 AS (SELECT p, rid - 1 AS k, v FROM q WHERE rid <= {ENTRIES}),
{"".join(_round(k) for k in range(ROUNDS))}
fin AS (SELECT vec_id, rid, p, min(struct_pack(d := d, k := k)) AS best FROM (
  SELECT q.vec_id, q.rid, q.p, c.k, list_sum(list_transform(list_zip(q.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM q JOIN cb{ROUNDS} c ON q.p = c.p) GROUP BY ALL),
cod AS (SELECT vec_id, rid, string_agg(format('{{:02x}}', CAST(best.k AS BIGINT)), '' ORDER BY p) AS code, CAST(sum(best.d) AS BIGINT) AS error FROM fin GROUP BY ALL),
bk AS (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY p, k, i)) AS h FROM (SELECT p, k, unnest(range(len(v))) AS i, unnest(v) AS x FROM cb{ROUNDS}))
SELECT cod.vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, bk.h AS codebooks_sha256 FROM cod JOIN e ON e.rid = cod.rid, bk
"""
