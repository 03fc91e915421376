"""MinHash near-dedup by fast similarity sketching, banding and exact verification.

A document's set holds its distinct two-word shingles. Two documents link when their sets' Jaccard
similarity is at least 0.8; of each group of linked documents the smallest doc_id is kept.

1. Fast similarity sketching (Dahlgaard, Knudsen and Thorup 2017): in round i < T every element is
   hashed to a bin and a value; in round T + i all elements go to bin i. A coordinate keeps the
   smallest value of the first round that fills it, so after 2 T rounds at the latest all are filled,
   and after one where a set has many more elements than T. Two sets agree in a coordinate with
   the probability of their similarity, and the share of equal coordinates is concentrated about it
   as with T independent permutations.
2. Equal sets form a class; its smallest doc_id represents it.
3. Banding: BANDS bands of ROWS coordinates each. Classes that agree in a band are candidates. At
   a similarity of 0.8 two sets agree in none of them with a probability of (1 - 0.8^5)^51 = 2e-9,
   at 0.9 of 2e-20.
4. Candidates are verified on their full sets, within blocks of bounded size, where pairs that
   agree in a band are compared unless they are in one group already: a family of near copies costs
   about its number of classes, not its square. Components of candidates that fit into a block are
   done at once. Larger ones are dealt out twice, so that similar classes meet in small blocks; then
   only bands that still hold classes of several groups are open, and only chunks of different
   groups that share an open band are brought together. So no pair of candidates is left out.

Shingles are compared by 64-bit hashes, classes by 128-bit hashes of their sets, beyond the
grouping by the first 64 bits of these.

Edge cases: without words, or with a null text, the set is empty, linked with nothing, and the row
is kept; with one word the whole sequence is one shingle; rows with words that share a doc_id are
one node of a component, whatever their texts; a null doc_id takes part in no link and its row is
kept; an empty table gives an empty result; very long texts are handled whole; other columns are
not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavegrid.llm.common import SENT_ROWS, columns_of, counted, cut, documents, in_small_batches, once, sent
from wavegrid.llm.graph import components
from wavegrid.llm.ngram_join import MULTIPLIER, WordHashes, mixed, shared_ids

WORDS = 2
#: Coordinates of a sketch, a power of two; its bands and their coordinates.
T, BANDS, ROWS = 256, 51, 5
#: Classes and shingles of a block.
BLOCK_CLASSES, BLOCK_SHINGLES = 1024, 400_000
#: Hashes that are computed at once, as far as one round has no more.
AT_ONCE = 8192

ROUND_SEEDS = np.array([xxhash.xxh3_64_intdigest(f"round {i}".encode()) for i in range(2 * T)], np.uint64)
VALUE_BITS = np.uint64(48)
VALUE_MASK = np.uint64((1 << 48) - 1)
BIN_SHIFT = np.uint64(64 - (T - 1).bit_length())
EMPTY = np.uint64(2**64 - 1)


def shingle_set(text: str | None, hashes: dict) -> np.ndarray:
    """The sorted hashes of a text's distinct shingles."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.int64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    width = min(WORDS, len(words))
    out = np.full(len(words) - width + 1, width, np.uint64)
    for k in range(width):
        out = mixed(out * MULTIPLIER + h[k : len(h) - width + 1 + k])
    return np.unique(out.view(np.int64))


def sketch(s: np.ndarray) -> np.ndarray:
    """The T coordinates of a set that is not empty: the round above 48 bits of the smallest value in it."""
    elements = s.view(np.uint64)
    out = np.full(T, EMPTY)
    step, i = max(1, AT_ONCE // len(s)), 0
    while i < 2 * T:
        end = min(i + step, T if i < T else 2 * T)
        h = mixed(elements[None, :] ^ ROUND_SEEDS[i:end, None])
        value = (np.arange(i, end, dtype=np.uint64)[:, None] << VALUE_BITS) | (h & VALUE_MASK)
        if i < T:
            np.minimum.at(out, (h >> BIN_SHIFT).ravel().astype(np.int64), value.ravel())
        else:
            np.minimum(out[i - T : end - T], value.min(axis=1), out=out[i - T : end - T])
        if (out != EMPTY).all():
            break
        i = end
    return out


def bands_of(s: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each band's coordinates and number."""
    coordinates = sketch(s)[: BANDS * ROWS].reshape(BANDS, ROWS)
    out = np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(ROWS):
        out = mixed(out * MULTIPLIER + coordinates[:, k])
    return out.view(np.int64)


def key_of(s: np.ndarray) -> tuple[bytes, int]:
    key = xxhash.xxh3_128_digest(s.tobytes())
    return key, int.from_bytes(key[:8], "little", signed=True)


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, n, key, k, bands) of each row: set size, 128-bit hash of the set, its first 64 bits, and its bands where a task meets the set first (else null)."""

    def sign(batches):
        hashes, seen = once(("word hashes",), WordHashes), set()
        for batch in batches:
            n, key, k, bands = [], [], [], []
            for text in batch.column(1):
                s = shingle_set(text.as_py(), hashes)
                n.append(len(s))
                full, short = key_of(s)
                key.append(full)
                k.append(short)
                new = len(s) and full not in seen
                if new:
                    seen.add(full)
                bands.append(bands_of(s) if new else None)
            yield pa.record_batch(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(key, pa.binary()), pa.array(k, pa.int64()), pa.array(bands, pa.list_(pa.int64()))], names=["doc_id", "n", "key", "k", "bands"]
            )

    return in_small_batches(docs).select(*columns_of(docs, "doc_id", "text")).mapInArrow(sign, "doc_id bigint, n bigint, key binary, k bigint, bands array<bigint>")


def with_sets(texts: DataFrame) -> DataFrame:
    """(k, shingles) from (k, text), of the texts whose set is k's."""

    def emit(batches):
        hashes = once(("word hashes",), WordHashes)
        for batch in batches:
            kept, found = [], []
            for i, (k, text) in enumerate(zip(batch.column("k").to_pylist(), batch.column("text"), strict=True)):
                s = shingle_set(text.as_py(), hashes)
                if len(s) and key_of(s)[1] == k:
                    kept.append(i)
                    found.append(s)
            offsets = pa.array(np.concatenate([[0], np.cumsum([len(s) for s in found])]).astype(np.int32))
            values = pa.array(np.concatenate(found) if found else np.empty(0, np.int64))
            yield pa.record_batch([batch.column("k").take(pa.array(kept, pa.int64())), pa.ListArray.from_arrays(offsets, values)], names=["k", "shingles"])

    return texts.select("k", "text").mapInArrow(emit, "k bigint, shingles array<bigint>")


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether 100 * intersection >= 80 * union, of sorted sets."""
    if 5 * min(len(a), len(b)) < 4 * max(len(a), len(b)):
        return False
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    both = int((b[at] == a).sum())
    return 100 * both >= 80 * (len(a) + len(b) - both)


def verified(block: pa.Table) -> pa.Table:
    """(u, v): a tree of links between the groups (column `of`) of a block's classes.

    side: 0 and 1 are compared with each other, 2 among themselves. Pairs of one group are skipped.
    """
    of, side, keys = (block.column(c).to_pylist() for c in ("of", "side", "keys"))
    sets = [np.asarray(x.values) for x in block.column("shingles")]
    parent: dict[int, int] = {c: c for c in of}

    def root(c):
        while parent[c] != c:
            parent[c] = parent[parent[c]]
            c = parent[c]
        return c

    holders: dict[int, list[int]] = {}
    edges = []
    for i in sorted(range(len(of)), key=lambda i: (side[i] == 0, len(sets[i]))):
        tried = set()
        for h in keys[i]:
            others = holders.get(h, ())
            for j in others:
                if j in tried:
                    continue
                tried.add(j)
                a, b = root(of[i]), root(of[j])
                if a != b and linked(sets[i], sets[j]):
                    a, b = min(a, b), max(a, b)
                    parent[b] = a
                    edges.append((b, a))
        if side[i] != 0:
            for h in keys[i]:
                holders.setdefault(h, []).append(i)
    return pa.table({"u": pa.array([u for u, _ in edges], pa.int64()), "v": pa.array([v for _, v in edges], pa.int64())})


def many(classes, size):
    """Blocks that so many classes and shingles need."""
    return F.greatest(F.ceil(classes / F.lit(BLOCK_CLASSES)), F.ceil(size / F.lit(BLOCK_SHINGLES)), F.lit(1)).cast("long")


def dealt(rows: DataFrame, by: list[str]) -> DataFrame:
    """rows (k, n and the columns by) with `chunk`: those with equal `by` are together, cut by hash into chunks of bounded size; small ones are bundled."""
    groups = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_classes"), F.sum("n").alias("_size")).withColumn("_own", many(F.col("_classes"), F.col("_size")))
    small = F.col("_own") == 1
    groups, (_, classes, size) = counted(groups, F.sum(F.when(small, F.col("_classes"))), F.sum(F.when(small, F.col("_size"))))
    bundles = max(1, -(-2 * (classes or 0) // BLOCK_CLASSES), -(-2 * (size or 0) // BLOCK_SHINGLES))
    joined = rows.join(sent(groups.where("_own > 1").select(*by, "_own")), by, "left")
    own = F.xxhash64(*by, F.pmod(F.xxhash64("k"), F.col("_own")))
    return joined.withColumn("chunk", F.when(F.col("_own").isNotNull(), own).otherwise(F.pmod(F.xxhash64(*by), F.lit(bundles)))).drop("_own")


def compared(blocks: DataFrame, sets: DataFrame, partitions: int) -> DataFrame:
    """(u, v): links found in blocks (k, of, keys, block, side), with the sets (k, shingles)."""
    rows = blocks.join(sets, "k").repartition(partitions, "block")
    return rows.groupBy("block").applyInArrow(verified, "u bigint, v bigint")


def open_blocks(held: DataFrame, groups: DataFrame) -> DataFrame | None:
    """(k, of, keys, block, side) of the chunks that are still to be compared; None if no band holds classes of several groups.

    held: (k, n, h) of large components; groups: (node, component), what is linked so far.
    """
    placed = held.join(groups, held.k == groups.node, "left").select("k", "n", "h", F.coalesce("component", "k").alias("of"))
    placed, _ = counted(placed)
    several, (n,) = counted(placed.groupBy("h").agg(F.min("of").alias("a"), F.max("of").alias("z")).where("a <> z").select("h"))
    if not n:
        return None
    still = placed.join(F.broadcast(several) if n <= SENT_ROWS else several, "h")
    members, _ = counted(still.groupBy("k", "n", "of").agg(F.sort_array(F.collect_set("h")).alias("keys")))
    # A group's classes are in chunks of their own if they are many, else with those of the same smallest open band.
    sizes = sent(members.groupBy("of").agg(many(F.count(F.lit(1)), F.sum("n")).alias("own")))
    pure = members.join(sizes, "of").withColumn("large", F.col("own") > 1)
    alone = pure.where("large").select("k", "n", "of", "keys", F.xxhash64("of", F.pmod(F.xxhash64("k"), F.col("own"))).alias("chunk"), F.col("of").alias("only"))
    mixed_ = dealt(pure.where("not large").select("k", "n", "of", "keys", F.element_at("keys", 1).alias("near")), ["near"])
    chunked, _ = counted(alone.unionByName(mixed_.select("k", "n", "of", "keys", "chunk", F.lit(None).cast("bigint").alias("only"))))
    holders, _ = counted(chunked.select("chunk", "only", F.explode("keys").alias("h")).distinct())
    # Of each band, the group with most chunks is met by the others' chunks only, never by itself.
    counts = holders.where("only is not null").groupBy("h", "only").agg(F.count(F.lit(1)).alias("chunks"))
    main = counts.groupBy("h").agg(F.max(F.struct("chunks", "only"))["only"].alias("main"))
    told = holders.join(sent(main), "h", "left")
    rest = told.where("only is null or main is null or only <> main").select("h", F.col("chunk").alias("one"), F.col("only").alias("only1"))
    met = rest.join(holders.select("h", F.col("chunk").alias("two"), F.col("only").alias("only2")), "h")
    met = met.where("only1 is null or only2 is null or only1 <> only2").select(F.least("one", "two").alias("one"), F.greatest("one", "two").alias("two")).distinct()
    pairs, (n,) = counted(met.withColumn("block", F.monotonically_increasing_id()))
    itself = F.col("one") == F.col("two")
    sides = pairs.select(F.col("one").alias("chunk"), "block", F.when(itself, 2).otherwise(0).alias("side")).unionByName(
        pairs.where(~itself).select(F.col("two").alias("chunk"), "block", F.lit(1).alias("side"))
    )
    return chunked.join(F.broadcast(sides) if n <= SENT_ROWS else sides, "chunk").select("k", "of", "keys", "block", "side")


def linked_classes(held: DataFrame, classes: DataFrame, sets: DataFrame, partitions: int) -> DataFrame:
    """(u, v): links that make up the components of classes (k, n), by k. held: (k, h) of the bands that several classes share."""
    first = held.groupBy("h").agg(F.min("k").alias("first"))
    tied = components(held.join(first, "h").select(F.col("k").alias("u"), F.col("first").alias("v")))
    keys = held.groupBy("k").agg(F.collect_set("h").alias("keys"))
    found, _ = counted(keys.join(tied, keys.k == tied.node).join(classes, "k").select("k", "n", "keys", "component"))
    sizes = found.groupBy("component").agg(F.count(F.lit(1)).alias("classes"), F.sum("n").alias("size"))
    # Each large component has over BLOCK_CLASSES classes (or very long texts): there are few of them.
    large = sent(sizes.where(many(F.col("classes"), F.col("size")) > 1).select("component"))
    block = lambda rows, turn: rows.select("k", F.col("k").alias("of"), "keys", F.xxhash64(F.lit(turn), "chunk").alias("block"), F.lit(2).alias("side"))
    small = block(dealt(found.join(large, "component", "left_anti"), ["component"]), "small")
    crowd, (n,) = counted(found.join(large, "component"))
    turns = [block(dealt(crowd.withColumn("near", f("keys")), ["component", "near"]), name) for name, f in (("first", F.array_min), ("second", F.array_max))]
    edges, _ = counted(compared(small.unionByName(turns[0]).unionByName(turns[1]), sets, partitions))
    if not n:
        return edges
    of_crowd = crowd.select("k", "n", F.explode("keys").alias("h"))
    blocks = open_blocks(of_crowd, components(edges))
    return edges if blocks is None else edges.unionByName(counted(compared(blocks, sets, partitions))[0])


def near_copies(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of docs (columns doc_id and text)."""
    signed = cut(signatures(docs))
    rows = signed.where("n > 0 and doc_id is not null")
    # A task's first row of a set has its bands; one of them is taken.
    classes = cut(rows.groupBy("key", "k").agg(F.min("doc_id").alias("rep"), F.max("n").alias("n"), F.max("bands").alias("bands")))
    # Most bands are one class's alone: what is counted and joined for all of them is kept narrow.
    ties = classes.select("k", F.explode("bands").alias("h"))
    several = ties.groupBy("h").agg(F.count(F.lit(1)).alias("held")).where("held > 1").select("h")
    held, _ = counted(ties.join(several, "h"))
    alive, (n,) = counted(held.select("k").distinct().join(classes.select("k", "rep", "n"), "k"))
    reps = alive.select("k", "rep")
    texts = docs.select(*[c.alias(a) for c, a in zip(columns_of(docs, "doc_id", "text"), ("rep", "text"), strict=True)]).join(F.broadcast(reps) if n <= SENT_ROWS else reps, "rep")
    sets = with_sets(texts)
    ids = shared_ids(rows, classes)
    sets = cut(sets if ids is None else sets.dropDuplicates(["k"]))
    # Several blocks for each partition, since a task's time is not in proportion to its bytes.
    partitions = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    edges = linked_classes(held, alive.select("k", "n"), sets, partitions)
    by_rep = edges.join(reps.withColumnsRenamed({"k": "u", "rep": "ru"}), "u").join(reps.withColumnsRenamed({"k": "v", "rep": "rv"}), "v").select(F.col("ru").alias("u"), F.col("rv").alias("v"))
    joined = components(by_rep if ids is None else by_rep.unionByName(ids))
    of_class = classes.join(joined, classes.rep == joined.node, "left").select("key", F.coalesce("component", "rep").alias("component_id"))
    # Equal sets may be very many: the join's skewed side is the documents', which Spark can split.
    out = signed.select("doc_id", "n", "key").join(of_class, "key", "left")
    component = F.when(F.col("n") > 0, F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id"))
    out = out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), component).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op11_sketch_dedup(spark, sf_dir: str) -> DataFrame:
    return near_copies(documents(spark, sf_dir).select("doc_id", "text"))


OP11_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (
  SELECT DISTINCT doc_id, hash(s) AS s FROM (
    SELECT doc_id, unnest(CASE WHEN len(w) >= 2 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) ELSE w END) AS s FROM d)),
n AS (SELECT d.doc_id, count(s) AS n FROM d LEFT JOIN sh USING (doc_id) GROUP BY d.doc_id),
f AS (SELECT s, count(*) AS df FROM sh GROUP BY s),
pr AS (SELECT doc_id, s, n FROM (SELECT sh.doc_id, sh.s, n.n, row_number() OVER (PARTITION BY sh.doc_id ORDER BY df, sh.s) AS p FROM sh JOIN f USING (s) JOIN n USING (doc_id)) WHERE p <= n - (4 * n + 4) // 5 + 1),
cd AS (SELECT DISTINCT a.doc_id AS i, b.doc_id AS j FROM pr a JOIN pr b ON a.s = b.s AND a.doc_id < b.doc_id AND 5 * least(a.n, b.n) >= 4 * greatest(a.n, b.n)),
o AS (SELECT i, j, count(*) AS o FROM cd JOIN sh a ON a.doc_id = i JOIN sh b ON b.doc_id = j AND b.s = a.s GROUP BY i, j),
l AS (SELECT i, j FROM o JOIN n a ON a.doc_id = i JOIN n b ON b.doc_id = j WHERE 100 * o >= 80 * (a.n + b.n - o)),
e AS (SELECT i, j FROM l UNION ALL SELECT j, i FROM l),
r AS (SELECT i, j FROM e UNION SELECT r.i, e.j FROM r JOIN e ON r.j = e.i)
SELECT n.doc_id, CAST(n.n AS BIGINT) AS n_shingles, coalesce(least(n.doc_id, (SELECT min(j) FROM r WHERE r.i = n.doc_id)), n.doc_id) AS component_id,
       n.doc_id = coalesce(least(n.doc_id, (SELECT min(j) FROM r WHERE r.i = n.doc_id)), n.doc_id) AS kept
FROM n
"""
