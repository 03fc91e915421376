"""N-gram Jaccard join: exact near-duplicate groups by T-occurrence search with DivideSkip.

A document's set holds its distinct five-word shingles. Two documents link when their sets'
Jaccard similarity is at least 0.75.

1. Equal sets form a class, represented by its smallest doc_id; only representatives go on.
2. Overlap filter: two linked sets, put in order of shingle hash, have at least c shingles in
   common among their first n - 0.75 n + c. The shingles of these prefixes are counted over all
   documents; a class with too few that others share has no link and is done.
3. For what remains, all shingles are counted. A class with fewer than 0.75 n shared shingles is
   done. The others' rarest shingles, as many as a link cannot do without, tie classes into
   candidate groups (connected components): every link is inside one group.
4. Small groups are bundled, large ones cut into chunks of classes of like size and, as far as
   possible, with the same smallest prefix shingle. A task is a pair of chunks whose sizes allow
   a link and that share a prefix shingle (or a chunk with itself): a link shares one, so pairs of
   chunks without one are never brought together. A task indexes its classes by shingle and
   searches each class's lists: short lists are merged with a heap, candidates that lack no more
   than the long lists can give are looked up there by bisection (T-occurrence search,
   DivideSkip), and those that reach the required overlap are links.
5. A task returns, for each class, its number of links and the root of its local tree of links,
   so rows stay in proportion to classes. Components of these trees are the result.

Frequent shingles, as of a line that all documents share, are told beforehand: tasks note what
stands in a fair share of their sets. There are at most a few hundred times as many as a set has
on average, whatever the corpus. They count as shared without being counted, and as the most
frequent of all in the order of step 3 (any order gives all links), so that no task gets the rows
of one of them.

Shingles are compared by 64-bit hashes, classes by 128-bit hashes of their sets (within steps 2 to
5 by the first 64 bits).

Edge cases: without words, or with a null text, the set is empty and linked with nothing, also
where other rows have the same doc_id; with fewer than five words the whole sequence is one
shingle; rows with words that share a doc_id are one node of a component, whatever their texts,
and each has the number of its own text's links; a null doc_id takes part in no link; an empty
table gives an empty result; very long texts are handled whole.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wavegrid.llm.common import columns_of, cut, documents, in_small_batches, release, small_side
from wavegrid.llm.graph import components

WORDS = 5
#: Similarity 3/4: the numerator and denominator of the overlap bounds below.
EXTRA = 0.10
#: Classes and shingles that a task indexes at once.
CHUNK_CLASSES, CHUNK_SHINGLES = 256, 400_000
#: A shingle is frequent that stands in about 1 / FREQUENT of the sets and in LEAST_FREQUENT at least; runs of a task note
#: what stands in 1 / FREQUENT_LOCAL of theirs. Shingles of a run.
FREQUENT, FREQUENT_LOCAL, LEAST_FREQUENT, RUN_SHINGLES = 100, 400, 256, 300_000
#: Weight of a bisection against a step of the heap, in DivideSkip's choice of the long lists.
MU = 0.01

MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    """64-bit hash of each word, kept for words seen before (for sketch_dedup; here a word is hashed each time, which costs less)."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 200_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads all input bits."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def shingle_set(text: str | None) -> np.ndarray:
    """The sorted hashes of a text's distinct shingles: polynomials of the words' hashes, spread once."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.int64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    width = min(WORDS, len(words))
    n = len(words) - width + 1
    out = np.full(n, width, np.uint64)
    for k in range(width):
        out *= MULTIPLIER
        out += h[k : n + k]
    out = mixed(out).view(np.int64)
    out.sort()
    return out[np.concatenate([[True], out[1:] != out[:-1]])]


def least_overlap(n):
    """Shingles that a set of n must have in common with any set it links to: 3 n / 4, rounded up."""
    return (3 * n + 3) // 4


def allowance(n: int) -> int:
    return max(1, math.ceil(EXTRA * n))


class Frequent:
    """What stands in at least 1 / FREQUENT_LOCAL of the sets of a run of a task (in 2 at least), equal sets counted once."""

    def __init__(self):
        self.seen: set[int] = set()
        self.parts: list[np.ndarray] = []
        self.size = 0

    def add(self, k: int, part: np.ndarray) -> None:
        if k not in self.seen:
            self.seen.add(k)
            self.parts.append(part)
            self.size += len(part)

    def take(self) -> tuple[int, np.ndarray]:
        """The number of sets and rows (h, n) of the frequent hashes since the last call."""
        sets = len(self.parts)
        values, count = np.unique(np.concatenate(self.parts) if self.parts else np.empty(0, np.int64), return_counts=True)
        on = count >= max(2, sets / FREQUENT_LOCAL)
        self.__init__()
        return sets, np.stack([values[on], count[on]], axis=1)


def noted_array(noted: list[np.ndarray | None]) -> pa.Array:
    """Lists of (h, n), null where nothing was noted."""
    offsets = np.concatenate([[0], np.cumsum([0 if x is None else len(x) for x in noted])])
    rows = np.concatenate([np.empty((0, 2), np.int64), *[x for x in noted if x is not None]])
    missing = np.array([x is None for x in noted] + [False])
    pairs = pa.StructArray.from_arrays([pa.array(rows[:, 0]), pa.array(rows[:, 1])], names=["h", "n"])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32(), mask=missing), pairs)


def frequent(noted: DataFrame) -> np.ndarray:
    """The hashes, rising, that stand in about 1 / FREQUENT of all sets or more, from the columns sets and frequent of the runs."""
    total = noted.agg(F.sum("sets")).first()[0] or 0
    each = noted.select(F.explode("frequent").alias("f")).groupBy("f.h").agg(F.sum("f.n").alias("n"))
    rows = each.where(F.col("n") >= max(LEAST_FREQUENT, total / FREQUENT - total / FREQUENT_LOCAL)).select("h").collect()
    return np.array(sorted(r.h for r in rows), np.int64)


def among(part: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which of part are among the rising known."""
    if not len(known):
        return np.zeros(len(part), bool)
    return known[np.minimum(np.searchsorted(known, part), len(known) - 1)] == part


def prefix_of(s: np.ndarray) -> np.ndarray:
    n = len(s)
    return s[: min(n, n - least_overlap(n) + allowance(n))]


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, n, key, k, sets, frequent): set size, 128-bit hash of the set and its first 64 bits, for each row.

    sets and frequent are null but on the last row of each run: the number of its distinct sets
    and what is frequent in their prefixes.
    """

    def sign(batches):
        release()
        run = Frequent()
        for batch in batches:
            n, key, k, sets, noted = [], [], [], [], []
            last = batch.num_rows - 1
            for i, text in enumerate(batch.column(1)):
                s = shingle_set(text.as_py())
                n.append(len(s))
                key.append(xxhash.xxh3_128_digest(s.tobytes()))
                k.append(int.from_bytes(key[-1][:8], "little", signed=True))
                if len(s):
                    run.add(k[-1], prefix_of(s).copy())
                count, found = run.take() if i == last or run.size > RUN_SHINGLES else (None, None)
                sets.append(count)
                noted.append(found)
            yield pa.record_batch(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(key, pa.binary()), pa.array(k, pa.int64()), pa.array(sets, pa.int64()), noted_array(noted)],
                names=["doc_id", "n", "key", "k", "sets", "frequent"],
            )

    return in_small_batches(docs).select(*columns_of(docs, "doc_id", "text")).mapInArrow(sign, "doc_id bigint, n bigint, key binary, k bigint, sets bigint, frequent array<struct<h bigint, n bigint>>")


def prefixes(docs: DataFrame, hot: np.ndarray) -> DataFrame:
    """(k, h, hot): the hashes of each set's prefix but frequent ones; k names the set. Equal sets within a task count once.

    A row whose hot is not 0 tells how many frequent ones the prefix has; its h means nothing.
    """
    sent = docs.sparkSession.sparkContext.broadcast(hot)

    def emit(batches):
        release()
        known = sent.value
        seen = set()
        for batch in batches:
            ks, hs, hots = [], [], []
            size = 0

            def rows():
                arrays = [np.concatenate(x) for x in (ks, hs, hots)]  # noqa: B023
                return pa.record_batch([pa.array(x) for x in arrays], names=["k", "h", "hot"])

            for text in batch.column(0):
                s = shingle_set(text.as_py())
                if not len(s):
                    continue
                k = int.from_bytes(xxhash.xxh3_128_digest(s.tobytes())[:8], "little", signed=True)
                if k in seen:
                    continue
                seen.add(k)
                part = prefix_of(s)
                on = among(part, known)
                part = part[~on]
                n = np.zeros(len(part), np.int32)
                if count := int(on.sum()):
                    part, n = np.append(part, k), np.append(n, np.int32(count))
                ks.append(np.full(len(part), k))
                hs.append(part)
                hots.append(n)
                size += len(part)
                if size > 200_000:
                    yield rows()
                    ks, hs, hots, size = [], [], [], 0
            if ks:
                yield rows()

    return docs.select(*columns_of(docs, "text")).mapInArrow(emit, "k bigint, h bigint, hot int")


def with_sets(docs: DataFrame) -> DataFrame:
    """(k, rep, copies, n, shingles, sets, frequent) from (k, rep, copies, text), of the texts whose set is k's; sets and frequent as in signatures."""

    def emit(batches):
        release()
        run = Frequent()
        for batch in batches:
            kept, found = [], []
            for i, (k, text) in enumerate(zip(batch.column("k").to_pylist(), batch.column("text"), strict=True)):
                s = shingle_set(text.as_py())
                if len(s) and int.from_bytes(xxhash.xxh3_128_digest(s.tobytes())[:8], "little", signed=True) == k:
                    kept.append(i)
                    found.append(s)
            sets, noted = [], []
            for i, (at, s) in enumerate(zip(kept, found, strict=True)):
                run.add(batch.column("k")[at].as_py(), s)
                count, frequent = run.take() if i == len(kept) - 1 or run.size > RUN_SHINGLES else (None, None)
                sets.append(count)
                noted.append(frequent)
            sizes = [len(s) for s in found]
            offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
            values = pa.array(np.concatenate(found) if found else np.empty(0, np.int64))
            at = pa.array(kept, pa.int64())
            yield pa.record_batch(
                [*[batch.column(c).take(at) for c in ("k", "rep", "copies")], pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(offsets, values), pa.array(sets, pa.int64()), noted_array(noted)],
                names=["k", "rep", "copies", "n", "shingles", "sets", "frequent"],
            )

    kind = "k bigint, rep bigint, copies bigint, n bigint, shingles array<bigint>, sets bigint, frequent array<struct<h bigint, n bigint>>"
    return docs.select("k", "rep", "copies", "text").mapInArrow(emit, kind)


class Index:
    """Inverted lists over sets; shingles with equal lists share one list."""

    def __init__(self, sets: list[np.ndarray]):
        sizes = [len(s) for s in sets]
        values = np.concatenate(sets) if sets else np.empty(0, np.int64)
        order = np.argsort(values, kind="stable")
        owner = np.repeat(np.arange(len(sets), dtype=np.int32), sizes)[order]
        values = values[order]
        begin = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.empty(0, int)
        end = np.append(begin[1:], len(values))
        self.shingles = values[begin] if len(values) else values
        known: dict[bytes, int] = {}
        self.lists: list[list[int]] = []
        of = np.empty(len(begin), np.int64)
        for i, (a, b) in enumerate(zip(begin.tolist(), end.tolist(), strict=True)):
            raw = owner[a:b].tobytes()
            if (k := known.get(raw)) is None:
                k = known[raw] = len(self.lists)
                self.lists.append(owner[a:b].tolist())
            of[i] = k
        self.list_of = of

    def search(self, query: np.ndarray, n: int) -> dict[int, int]:
        """Number -> overlap, of all sets whose overlap with the query reaches least_overlap(n)."""
        if not len(self.shingles):
            return {}
        at = np.minimum(np.searchsorted(self.shingles, query), len(self.shingles) - 1)
        ids, weight = np.unique(self.list_of[at[self.shingles[at] == query]], return_counts=True)
        need = least_overlap(n)
        if weight.sum() < need:
            return {}
        # (length, weight, list), the longest first
        own = sorted(((len(self.lists[i]), w, self.lists[i]) for i, w in zip(ids.tolist(), weight.tolist(), strict=True)), key=lambda x: -x[0])
        allowed = min(need - 1, int(need / (MU * math.log2(max(2, own[0][0])) + 1)))
        long, heavy = [], 0
        for k, (length, w, members) in enumerate(own):
            if length < 2 or heavy + w > allowed:
                break
            long.append((w, members))
            heavy += w
        short = own[len(long) :]
        found: dict[int, int] = {}
        for member, w in heapq.merge(*[zip(members, repeat(w)) for _, w, members in short], key=None):
            found[member] = found.get(member, 0) + w
        out = {}
        for member, overlap in found.items():
            left = heavy
            if overlap + left < need:
                continue
            for w, members in long:
                i = bisect_left(members, member)
                if i < len(members) and members[i] == member:
                    overlap += w
                left -= w
                if overlap + left < need:
                    break
            if overlap >= need:
                out[member] = overlap
        return out


def links_of(block: pa.Table) -> pa.Table:
    """(k, rep, links, root) of the classes of a task that have links in it; root is the smallest rep of a local tree.

    side: 0 and 1 are searched against each other, 2 among themselves.
    """
    ks, reps, copies, n, side = (block.column(c).to_pylist() for c in ("k", "rep", "copies", "n", "side"))
    sets = [np.asarray(x.values) for x in block.column("shingles")]
    parent = list(range(len(reps)))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    indexed = [i for i, s in enumerate(side) if s != 0]
    index = Index([sets[i] for i in indexed])
    links = [0] * len(reps)
    for i, s in enumerate(side):
        if s == 1:
            continue
        for at, overlap in index.search(sets[i], n[i]).items():
            j = indexed[at]
            if i == j or s == 2 and j > i or 7 * overlap < 3 * (n[i] + n[j]):
                continue
            links[i] += copies[j]
            links[j] += copies[i]
            a, b = root(i), root(j)
            if a != b:
                if reps[a] > reps[b]:
                    a, b = b, a
                parent[b] = a
    on = [i for i, x in enumerate(links) if x]
    return pa.table({
        "k": pa.array([ks[i] for i in on], pa.int64()), "rep": pa.array([reps[i] for i in on], pa.int64()), "links": pa.array([links[i] for i in on], pa.int64()),
        "root": pa.array([reps[root(i)] for i in on], pa.int64()),
    })


def parted(sets: DataFrame, hot: np.ndarray) -> DataFrame:
    """(k, n, rest, hot): the shingles of each set but frequent ones, and these."""
    sent = sets.sparkSession.sparkContext.broadcast(hot)

    def part(batches):
        for batch in batches:
            rest, found = [], []
            for x in batch.column("shingles"):
                s = np.asarray(x.values)
                on = among(s, sent.value)
                rest.append(s[~on])
                found.append(s[on])
            yield pa.record_batch([batch.column("k"), batch.column("n"), pa.array(rest, pa.list_(pa.int64())), pa.array(found, pa.list_(pa.int64()))], names=["k", "n", "rest", "hot"])

    return sets.select("k", "n", "shingles").mapInArrow(part, "k bigint, n bigint, rest array<bigint>, hot array<bigint>")


def candidates(sets: DataFrame, hot: np.ndarray) -> DataFrame:
    """(k, n, component, prefix) of the classes that may have links; hot: the frequent shingles."""
    by_shingle = Window.partitionBy("h")
    each = parted(sets, hot)
    counted = each.select("k", F.explode("rest").alias("h")).withColumn("df", F.count(F.lit(1)).over(by_shingle)).where("df > 1")
    # A group is one class's shingles.
    shared = counted.groupBy("k").agg(F.collect_list(F.struct("df", "h")).alias("shared"))
    none = F.array().cast("array<struct<df:bigint,h:bigint>>")
    most = F.transform("hot", lambda h: F.struct(F.lit(2**62).alias("df"), h.alias("h")))
    rare = each.select("k", "n", "hot").join(shared, "k", "left").select("k", "n", F.sort_array(F.concat(F.coalesce("shared", none), most)).alias("rare"))
    needed = F.floor((3 * F.col("n") + 3) / 4)
    # The rarest n - needed + 1 shingles, of which the first n - size(rare) are the class's own alone.
    prefix = F.transform(F.slice("rare", 1, (F.size("rare") - needed + 1).cast("int")), lambda x: x["h"])
    kept = cut(rare.where(F.size("rare") >= needed).select("k", "n", prefix.alias("prefix")))
    ties = kept.select("k", F.explode("prefix").alias("h"))
    first = ties.groupBy("h").agg(F.min("k").alias("first"))
    tied = components(ties.join(first, "h").select(F.col("k").alias("u"), F.col("first").alias("v")))
    return kept.join(tied, kept.k == tied.node).select("k", "n", "component", "prefix")


def chunks(large: DataFrame) -> DataFrame:
    """(k, component, band, chunk, prefix) of the classes of large groups.

    Bands are of sizes by a factor over 4/3, so that linked sets are in the same band or in
    neighbouring ones. Classes with the same smallest prefix shingle go to the same chunk, or to
    chunks of their own by hash if they are too many for one.
    """
    many = lambda classes, size: F.greatest(F.ceil(classes / F.lit(CHUNK_CLASSES)), F.ceil(size / F.lit(CHUNK_SHINGLES)), F.lit(1)).cast("long")
    banded = large.withColumn("band", F.floor(F.log("n") / F.lit(math.log(1.34)))).withColumn("near", F.array_min("prefix"))
    near = banded.groupBy("component", "band", "near").agg(F.count(F.lit(1)).alias("classes"), F.sum("n").alias("size")).withColumn("own", many(F.col("classes"), F.col("size")))
    near = cut(near)
    crowded = small_side(cut(near.where("own > 1").select("component", "band", "near", "own")))
    bundled = near.where("own = 1").groupBy("component", "band").agg(many(F.sum("classes"), F.sum("size")).alias("bundles"))
    joined = banded.join(crowded, ["component", "band", "near"], "left").join(small_side(cut(bundled)), ["component", "band"], "left")
    alone = F.concat(F.col("near").cast("string"), F.lit(":"), F.pmod(F.xxhash64("k"), F.col("own")).cast("string"))
    chunk = F.when(F.col("own").isNotNull(), alone).otherwise(F.concat(F.lit("b"), F.pmod(F.xxhash64("near"), F.col("bundles")).cast("string")))
    return joined.select("k", "component", "band", chunk.alias("chunk"), "prefix")


def tasks(found: DataFrame) -> DataFrame:
    """(k, block, side): a row for each task that a class takes part in."""
    groups = found.groupBy("component").agg(F.count(F.lit(1)).alias("classes"), F.sum("n").alias("size"))
    groups = cut(groups.withColumn("large", (F.col("classes") > CHUNK_CLASSES) | (F.col("size") > CHUNK_SHINGLES)))
    total = groups.where("not large").agg(F.sum("classes"), F.sum("size")).first()
    bundles = max(1, -(-(total[0] or 0) // CHUNK_CLASSES), -(-(total[1] or 0) // CHUNK_SHINGLES))
    # Each large group has over CHUNK_CLASSES classes (or very long texts): there are few of them.
    large = small_side(cut(groups.where("large").select("component")))
    small = found.join(large, "component", "left_anti").select("k", (-1 - F.pmod(F.xxhash64("component"), F.lit(bundles))).alias("block"), F.lit(2).alias("side"))
    parts = cut(chunks(found.join(large, "component")))
    holders = parts.select("component", "band", "chunk", F.explode("prefix").alias("h")).distinct()
    one, two = (holders.select("h", "component", *[F.col(c).alias(f"{c}{x}") for c in ("band", "chunk")]) for x in "12")
    same = F.col("band1") == F.col("band2")
    met = one.join(two, ["h", "component"]).where(same & (F.col("chunk1") <= F.col("chunk2")) | (F.col("band2") == F.col("band1") + 1))
    # The numbers of the pairs hold for both sides, as they are kept by the cut.
    pairs = cut(met.select("component", "band1", "chunk1", "band2", "chunk2").distinct().withColumn("block", F.monotonically_increasing_id()))
    itself = same & (F.col("chunk1") == F.col("chunk2"))
    first = pairs.select("component", F.col("band1").alias("band"), F.col("chunk1").alias("chunk"), "block", F.when(itself, 2).otherwise(0).alias("side"))
    second = pairs.where(~itself).select("component", F.col("band2").alias("band"), F.col("chunk2").alias("chunk"), "block", F.lit(1).alias("side"))
    return small.unionByName(parts.join(first.unionByName(second), ["component", "band", "chunk"]).select("k", "block", "side"))


def shared_ids(rows: DataFrame, classes: DataFrame) -> DataFrame | None:
    """(u, v): representatives of the classes that have a doc_id in common; None without repeated ids."""
    repeated = cut(rows.groupBy("doc_id").count().where("count > 1").select("doc_id"))
    if repeated.isEmpty():
        return None
    held = rows.join(small_side(repeated), "doc_id").select("doc_id", "key").distinct().join(classes.select("key", "rep"), "key").select("doc_id", "rep").distinct()
    return cut(held.join(held.groupBy("doc_id").agg(F.min("rep").alias("v")), "doc_id").select(F.col("rep").alias("u"), "v").where("u <> v").distinct())


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links) for each row of docs (columns doc_id and text).

    n_links: rows linked with this one, copies included.
    """
    signed = cut(signatures(docs))
    hot = frequent(signed.where("sets is not null"))
    rows = signed.where("n > 0 and doc_id is not null").select("doc_id", "n", "key", "k")
    classes = cut(rows.groupBy("key", "k").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.max("n").alias("n")))
    by_shingle = Window.partitionBy("h")
    several = F.min("k").over(by_shingle) != F.max("k").over(by_shingle)
    shared = prefixes(docs, hot).select("k", "h", "hot", several.alias("several")).where("several or hot > 0")
    counts = shared.groupBy("k").agg((F.count_distinct(F.when(F.col("hot") == 0, F.col("h"))) + F.max("hot")).alias("n_shared"))
    partner = F.floor((3 * F.col("n") + 3) / 4)
    alive = cut(classes.join(counts, "k").where(F.col("n_shared") >= F.greatest(F.lit(1), F.ceil(F.lit(EXTRA) * partner - 1e-6))).select("k", "rep", "copies"))
    # Few classes are left as a rule: then the texts of the others need not be moved.
    texts = docs.select(*[c.alias(a) for c, a in zip(columns_of(docs, "doc_id", "text"), ("rep", "text"), strict=True)]).join(small_side(alive), "rep")
    sets = cut(with_sets(texts))
    ids = shared_ids(rows, classes)
    one_each = sets.drop("sets", "frequent")
    if ids is not None:
        one_each = cut(one_each.dropDuplicates(["k"]))
    # Several blocks for each partition, since a task's time is not in proportion to its bytes.
    partitions = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hot_sets = frequent(sets.where("sets is not null"))
    blocks = one_each.join(tasks(cut(candidates(one_each, hot_sets))), "k").repartition(partitions, "block")
    found = cut(blocks.groupBy("block").applyInArrow(links_of, "k bigint, rep bigint, links bigint, root bigint"))
    links = found.groupBy("k").agg(F.sum("links").alias("links"))
    edges = found.select(F.col("rep").alias("u"), F.col("root").alias("v"))
    joined = components(edges if ids is None else edges.unionByName(ids))
    of_class = classes.select("key", "k", "rep", "copies").join(links, "k", "left").join(joined, classes.rep == joined.node, "left")
    of_class = of_class.select("key", F.coalesce("component", "rep").alias("component_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    # Equal sets may be very many: the join's skewed side is the documents', which Spark can split.
    out = signed.select("doc_id", "n", "key").join(of_class, "key", "left")
    linked = F.col("n") > 0
    return out.select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(linked, F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"),
        F.when(linked & F.col("doc_id").isNotNull(), F.coalesce("n_links", F.lit(0))).otherwise(F.lit(0)).cast("bigint").alias("n_links"),
    )


def op1_ngram_join(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir).select("doc_id", "text"))
