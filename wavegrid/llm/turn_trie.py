"""Conversation prefix trie by prefix-doubling naming.

Each conversation is a sequence of turns (role, text). Every distinct sequence of a conversation's
first d turns is a node of depth d; the conversations that begin with it are its members.

1. Turns are ordered by a range sort over the whole table, so that a conversation of any length is
   spread over tasks; a turn's place is its rank less its conversation's first rank.
2. Naming: distinct turns get dense numbers, and in each following round the distinct pairs of
   neighbouring blocks of 2^j turns get dense numbers as blocks of 2^(j + 1). Blocks begin at
   multiples of their length, so each round has half as many rows as the one before, and there are
   as many rounds as the longest conversation has binary digits.
3. A prefix of d turns is the blocks of d's binary digits, the largest first: block k of 2^j turns
   (k even) stands in the prefixes of (k + 1) 2^j to (k + 2) 2^j - 1 turns. Equal lists of names
   of equal depth are equal prefixes: one grouping by them gives the nodes.
4. A node is known by its depth and its smallest member. What is summed over a subtree is charged,
   for each node, to its smallest member; a sum over a conversation's deeper nodes and then over a
   node's members is the sum over the node's subtree, without walking the tree level by level.
   Conversations are cut into runs of RUN turns for it, so no task has a whole long conversation.

Turns are compared by the SHA-256 of role and text. Hot turns, pairs and nodes are counted with
partial sums and joined back; nothing of a node's members meets in one task but the ids of those
that end there, which are streamed into its digest as the digest asks for it.

Edge cases: rows are ordered by turn, null first, ties by role, then text; rows that are wholly
equal are turns of their own; a null role or text is an empty one; rows without conv_id take no
part; texts of any length are handled whole; without conversations there is no node, not even the
root; other columns are not read.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wavegrid.llm.common import SENT_ROWS, columns_of, cut, small_side

#: Turns of a conversation that are summed in one window.
RUN = 1024
#: Code points of a turn that take part in the choice of ranges; turns that are no longer may be dealt to several ranges where they are equal.
SHOWN = 256
#: Bytes of ids that are joined before they are sent to a digest.
RUN_BYTES = 65_536
#: Turns of a conversation that the query puts before others' turns at most.
HEAD = 5

FIRST = 1 << 33  # monotonically_increasing_id(): partition * FIRST + row


def ranked(rows: DataFrame, at: str, name: str) -> tuple[DataFrame, int]:
    """rows, which must be cut, with `at` (partition and row) replaced by dense numbers from 0 in the same order; their number."""
    part = F.shiftright(at, 33)
    # One row for each partition.
    sizes = sorted(rows.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect())
    base, total = [], 0
    for p, n in sizes:
        base.append((p, total))
        total += n
    bases = rows.sparkSession.createDataFrame(base, "_part bigint, _base bigint")
    placed = rows.withColumn("_part", part).join(F.broadcast(bases), "_part")
    return placed.withColumn(name, F.col("_base") + F.col(at) % FIRST).drop("_part", "_base", at), total


def named(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows with a column `name`, a dense number for the distinct values of keys, instead of them."""
    names, total = ranked(cut(rows.select(*keys).distinct().withColumn("_at", F.monotonically_increasing_id())), "_at", "name")
    return rows.join(F.broadcast(names) if total <= SENT_ROWS else names, keys).drop(*keys)


def ordered(turns: DataFrame) -> DataFrame:
    """(conv_id, pos, key, chars) of turns (conv_id, turn, role, text): place from 0, digest of role and text, code points of the text."""
    conv, turn, role, text = columns_of(turns, "conv_id", "turn", "role", "text")
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    said = F.concat(role, F.lit("\0"), text)
    key = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))
    # Equal short turns may be dealt to several ranges.
    tie = F.when((F.length(said) <= SHOWN) & (F.instr(role, "\0") == 0), F.monotonically_increasing_id()).otherwise(F.lit(2**63 - 1))
    rows = turns.where(conv.isNotNull()).select(
        conv.cast("bigint").alias("conv_id"), turn.alias("turn"), said.alias("said"), role.alias("role"), key.alias("key"), F.length(text).cast("bigint").alias("chars"), tie.alias("tie"),
    )
    ranges = rows.repartitionByRange("conv_id", F.asc_nulls_first("turn"), F.substring("said", 1, SHOWN), "tie")
    placed = ranges.sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "said", "role").select("conv_id", "key", "chars", F.monotonically_increasing_id().alias("_at"))
    ranks, _ = ranked(cut(placed), "_at", "rank")
    starts = ranks.groupBy("conv_id").agg(F.min("rank").alias("start"))
    return ranks.join(starts, "conv_id").select("conv_id", (F.col("rank") - F.col("start")).alias("pos"), "key", "chars")


def named_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, pos, name, chars): ordered() with dense numbers for the digests."""
    return cut(named(cut(ordered(turns)), ["key"]))


def rebuilt(turns: DataFrame, convs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The query's conversations: (conv_id, pos, name, chars) and (conv_id, n).

    Conversation c has the first h original turns of c - c % 100, then its own after its first h,
    with h the CRC-32 of c in decimal modulo 6. A head is HEAD turns at most, and about a hundred
    conversations share one.
    """
    heads = turns.where(F.col("pos") < HEAD).groupBy(F.col("conv_id").alias("root")).agg(F.sort_array(F.collect_list(F.struct("pos", "name", "chars"))).alias("head"))
    plan = convs.select("conv_id", "n", (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 6).cast("int").alias("h"), (F.col("conv_id") - F.col("conv_id") % 100).alias("root"))
    none = F.array().cast("array<struct<pos:bigint,name:bigint,chars:bigint>>")
    plan = plan.join(heads, "root", "left").select("conv_id", "n", "h", F.slice(F.coalesce("head", none), F.lit(1), F.col("h")).alias("head"))
    plan = cut(plan.withColumn("put", F.size("head")))
    first = plan.select("conv_id", F.inline("head"))
    moved = turns.join(plan.select("conv_id", "h", "put"), "conv_id").where("pos >= h").select("conv_id", (F.col("pos") - F.col("h") + F.col("put")).alias("pos"), "name", "chars")
    return cut(first.unionByName(moved)), plan.select("conv_id", (F.col("put") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).cast("bigint").alias("n"))


def prefixes(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """(conv_id, d, key, chars, n) for each prefix of d > 0 turns: its list of block names and the length of its last text; n is the conversation's turns."""
    level = cut(turns.join(convs, "conv_id").select("conv_id", "n", F.col("pos").alias("i"), "name", "chars"))
    parts = [level.select("conv_id", "n", (F.col("i") + 1).alias("d"), F.lit(-1).alias("level"), F.col("chars").alias("name"))]
    longest = convs.agg(F.max("n")).first()[0] or 0
    level = level.drop("chars")
    for j in range(max(longest, 1).bit_length()):
        size = 1 << j
        if j:
            odd = F.col("i") % 2 == 1
            pairs = level.groupBy("conv_id", F.expr("i div 2").alias("i")).agg(
                F.max("n").alias("n"), F.max(F.when(~odd, F.col("name"))).alias("a"), F.max(F.when(odd, F.col("name"))).alias("b")
            )
            level = cut(named(pairs.where("a is not null and b is not null"), ["a", "b"]))
        begin = (F.col("i") + 1) * size
        inside = level.where("i % 2 = 0").withColumn("last", F.least(begin + (size - 1), F.col("n")))
        # A block's prefixes, at most RUN at a time.
        runs = inside.select("conv_id", "n", "name", "last", F.explode(F.sequence(begin, F.col("last"), F.lit(RUN))).alias("from"))
        each = runs.select("conv_id", "n", F.explode(F.sequence("from", F.least(F.col("from") + (RUN - 1), F.col("last")))).alias("d"), F.lit(j).alias("level"), "name")
        parts.append(each)
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    names = F.transform(F.sort_array(F.collect_list(F.when(F.col("level") >= 0, F.struct("level", "name")))), lambda x: x["name"])
    return rows.groupBy("conv_id", "d").agg(names.alias("key"), F.max(F.when(F.col("level") < 0, F.col("name"))).alias("chars"), F.max("n").alias("n"))


def id_digests(ends: DataFrame) -> DataFrame:
    """(depth, node, ends_sha256) of ends (depth, node, conv_id): the digest of a node's ids, rising, comma-joined.

    Ids are joined to strings of about RUN_BYTES where a range sort has brought them, then a
    node's strings are fed to its digest in order, one at a time.
    """

    def join(batches):
        key, ids, size = None, [], 0
        for batch in batches:
            out = []
            for d, node, c in zip(*(batch.column(n).to_pylist() for n in ("depth", "node", "conv_id")), strict=True):
                if (d, node) != key or size > RUN_BYTES:
                    if ids:
                        out.append((*key, int(ids[0]), ",".join(ids)))
                    key, ids, size = (d, node), [], 0
                ids.append(str(c))
                size += len(ids[-1]) + 1
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)], names=["depth", "node", "first", "ids"])
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*key, int(ids[0]), ",".join(ids))], names=["depth", "node", "first", "ids"])

    def digest(batches):
        key, state = None, None
        for batch in batches:
            out = []
            for d, node, ids in zip(*(batch.column(n).to_pylist() for n in ("depth", "node", "ids")), strict=True):
                if (d, node) != key:
                    if key:
                        out.append((*key, state.hexdigest()))
                    key, state = (d, node), hashlib.sha256()
                else:
                    state.update(b",")
                state.update(ids.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)], names=["depth", "node", "ends_sha256"])
        if key:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*key, state.hexdigest())], names=["depth", "node", "ends_sha256"])

    runs = ends.repartitionByRange("depth", "node", "conv_id").sortWithinPartitions("depth", "node", "conv_id").mapInArrow(join, "depth bigint, node bigint, first bigint, ids string")
    return runs.repartition("depth", "node").sortWithinPartitions("depth", "node", "first").mapInArrow(digest, "depth bigint, node bigint, ends_sha256 string")


def trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """The nodes of the conversations' trie, from turns (conv_id, pos, name, chars) and convs (conv_id, n), both cut.

    (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256):
    conv_id is the node's smallest member; saved_tokens counts, over the subtree, the code points
    of a node's last turn once for each member but one.
    """
    members = cut(prefixes(turns, convs))
    going = F.col("n") > F.col("d")
    nodes = cut(members.groupBy("d", "key").agg(F.min("conv_id").alias("node"), F.count(F.lit(1)).alias("n_convs"), F.count(F.when(going, True)).alias("n_going")))
    own = F.col("node") == F.col("conv_id")
    rows = members.join(nodes, ["d", "key"]).select(
        "conv_id", "d", "node", "n_convs", F.when(own, (F.col("n_convs") - 1) * F.col("chars")).otherwise(0).alias("saved"),
        F.when(own & (F.col("n_going") == 0), 1).otherwise(0).alias("leaf"), (F.col("n") == F.col("d")).alias("end"),
    )
    rows = cut(rows)
    # Runs of turns, each with its neighbours of the runs before and after, which are not summed.
    run = F.expr(f"d div {RUN}")
    at = F.explode(F.when(F.col("d") % RUN == 0, F.array(run, run - 1)).when(F.col("d") % RUN == RUN - 1, F.array(run, run + 1)).otherwise(F.array(run)))
    inner = F.col("run") == run
    runs = rows.withColumn("run", at).withColumns({"saved": F.when(inner, F.col("saved")).otherwise(0), "leaf": F.when(inner, F.col("leaf")).otherwise(0)})
    by_run = Window.partitionBy("conv_id", "run").orderBy("d")
    after = Window.partitionBy("conv_id", "run").orderBy(F.desc("d"))
    runs = runs.select(
        "conv_id", "d", "run", "node", "n_convs", F.lag("node").over(by_run).alias("parent"), (F.lead("node").over(by_run) == F.col("conv_id")).alias("begins"),
        F.sum("saved").over(after).alias("saved"), F.sum("leaf").over(after).alias("leaves"),
    ).where(inner)
    # Only conversations of more than one run have later runs.
    long = convs.where(F.col("n") >= RUN).select("conv_id")
    totals = rows.join(small_side(cut(long)), "conv_id").groupBy("conv_id", run.alias("run")).agg(F.sum("saved").alias("saved"), F.sum("leaf").alias("leaf"))
    rest = Window.partitionBy("conv_id").orderBy(F.desc("run")).rowsBetween(Window.unboundedPreceding, -1)
    later = cut(totals.select("conv_id", "run", F.coalesce(F.sum("saved").over(rest), F.lit(0)).alias("more_saved"), F.coalesce(F.sum("leaf").over(rest), F.lit(0)).alias("more_leaves")))
    runs = runs.join(small_side(later), ["conv_id", "run"], "left")
    whole = cut(
        runs.groupBy(F.col("d").alias("depth"), "node").agg(
            F.max("n_convs").alias("n_convs"), F.max("parent").alias("parent"), F.count(F.when(F.col("begins"), True)).alias("n_children"),
            F.sum(F.col("leaves") + F.coalesce("more_leaves", F.lit(0))).alias("n_leaves"), F.sum(F.col("saved") + F.coalesce("more_saved", F.lit(0))).alias("saved_tokens"),
        )
    )
    everyone = convs.agg(F.min("conv_id").alias("node"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0")
    below = whole.where("depth = 1").agg(F.count(F.lit(1)).alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
    root = everyone.crossJoin(below).select(
        F.lit(0).cast("bigint").alias("depth"), "node", "n_convs", F.lit(None).cast("bigint").alias("parent"), "n_children",
        F.coalesce("n_leaves", F.lit(1)).alias("n_leaves"), F.coalesce("saved_tokens", F.lit(0)).alias("saved_tokens"),
    )
    smallest = convs.agg(F.min("conv_id")).first()[0]
    whole = whole.withColumn("parent", F.when(F.col("depth") == 1, F.lit(smallest).cast("bigint")).otherwise(F.col("parent")))
    turnless = convs.where("n = 0").select(F.lit(0).cast("bigint").alias("depth"), F.lit(smallest).cast("bigint").alias("node"), "conv_id")
    ended = id_digests(rows.where("end").select(F.col("d").alias("depth"), "node", "conv_id").unionByName(turnless))
    out = whole.unionByName(root).join(ended, ["depth", "node"], "left")
    numbers = [F.col(c).cast("bigint").alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    return out.select(F.col("node").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), *numbers, F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"))


def conversation_trie(turns: DataFrame) -> DataFrame:
    """trie() of a table (conv_id, turn, role, text)."""
    rows = named_turns(turns)
    return trie(rows, cut(rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))))


def op13_turn_trie(spark, sf_dir: str) -> DataFrame:
    rows = named_turns(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return trie(*rebuilt(rows, cut(rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")))))


#: CRC-32 of a conversation's number in decimal, bit by bit: each byte, then eight steps.
CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(CAST(c.conv_id AS VARCHAR), ''), lambda x: [ord(x)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
  lambda a, b: CASE WHEN b >= 0 THEN xor(a, b) WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END), 4294967295)"""
OP13_SQL = f"""
WITH c AS (
  SELECT conv_id, list(struct_pack(r := coalesce(role, ''), t := coalesce(text, '')) ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS w
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
b AS (SELECT c.conv_id, c.w, CAST({CRC} % 6 AS BIGINT) AS h, o.w AS o FROM c LEFT JOIN c o ON o.conv_id = c.conv_id - c.conv_id % 100),
s AS (SELECT conv_id, list_concat(coalesce(o[1:h], []), w[h + 1:]) AS w FROM b),
m AS (SELECT conv_id, d, w[1:d] AS p, len(w) AS n, CASE WHEN d > 0 THEN length(w[d].t) ELSE 0 END AS chars FROM (SELECT conv_id, w, unnest(range(0, len(w) + 1)) AS d FROM s)),
nd AS (SELECT d, p, min(conv_id) AS node, count(*) AS n_convs, max(n) AS deepest, max(chars) AS chars FROM m GROUP BY d, p),
k AS (SELECT m.conv_id, m.d, m.n, nd.node FROM m JOIN nd ON m.d = nd.d AND m.p = nd.p),
up AS (SELECT nd.d, nd.node, k.node AS parent FROM nd LEFT JOIN k ON k.conv_id = nd.node AND k.d = nd.d - 1),
ch AS (SELECT d - 1 AS d, parent AS node, count(*) AS n FROM up WHERE d > 0 GROUP BY ALL),
sb AS (SELECT k.d, k.node, count(*) FILTER (nd.deepest = nd.d) AS leaves, sum((nd.n_convs - 1) * nd.chars) AS saved FROM nd JOIN k ON k.conv_id = nd.node AND k.d <= nd.d GROUP BY ALL),
en AS (SELECT d, node, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) AS ids FROM k WHERE d = n GROUP BY ALL)
SELECT nd.node AS conv_id, CAST(nd.d AS BIGINT) AS depth, up.parent AS parent_conv_id, CAST(nd.n_convs AS BIGINT) AS n_convs, CAST(coalesce(ch.n, 0) AS BIGINT) AS n_children,
       CAST(sb.leaves AS BIGINT) AS n_leaves, CAST(sb.saved AS BIGINT) AS saved_tokens, sha256(coalesce(en.ids, '')) AS ends_sha256
FROM nd JOIN up ON up.d = nd.d AND up.node = nd.node JOIN sb ON sb.d = nd.d AND sb.node = nd.node
LEFT JOIN ch ON ch.d = nd.d AND ch.node = nd.node LEFT JOIN en ON en.d = nd.d AND en.node = nd.node
"""
