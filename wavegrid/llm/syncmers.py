"""Document fingerprints by closed syncmers.

A text's units are its words (runs without white space); a run of more than `LONG_WORD` code
points, as in scripts without spaces, gives its code points instead, and so does a text of fewer
than 5 units. Units give overlapping s-mers (2 units) and k-mers (5 units). A k-mer is chosen if
the smallest hash of its inner s-mers lies at its first or last s-mer. The choice depends on the
k-mer's own units alone, so an unchanged passage gives the same anchors wherever it stands.

A fingerprint is the set of the anchors' hashes, each with the unit number of its first place.
The likeness of two fingerprints is positional: hashes in both are paired, in the order of the
first text; a pair counts if it is moved by as many units as the pair before or after it, or not
at all; the likeness is the number of these pairs over that of all hashes of both. It covers all
anchors, however long the text. `packed` is a fingerprint's form to store, all hashes with their
places (12 bytes each, in Base64), from which `unpacked` gives them back. `text_of(sketch)` is a
compact form beside it, the `SIZE` smallest hashes; `sketch_likeness` estimates the plain share of common hashes from it (exact up to SIZE
hashes in both; for longer texts measured in the tests: within 0.1, on average within 0.03).

Edge cases: a null text counts as empty; an empty text has an empty fingerprint, and two empty
fingerprints are alike by 1; every other text has at least one anchor: the k-mer of smallest hash
where none is chosen, the hash of the whole text where it has fewer than 5 code points; rows with
the same doc_id stand in the order of their texts; a null doc_id stands before all others; a
single document is its own next document; a very long text is handled whole, within its row; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import math
import struct

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wavegrid.llm.common import columns_of, documents

LONG_WORD = 24
WHITE = r"\x20\x09-\x0D"
#: Whole words up to LONG_WORD code points, the code points of longer ones.
UNIT = rf"(?<![^{WHITE}])[^{WHITE}]{{1,{LONG_WORD}}}+(?![^{WHITE}])|[^{WHITE}]"
SIZE = 256
K, S = 5, 2
#: Ranges of doc_id that a table is dealt to: one for so many rows, and not more than so many.
RANGE_ROWS, MAX_RANGES = 5_000, 16_384


def with_anchors(df: DataFrame, texts: dict[str, str]) -> DataFrame:
    """df with an array of (at, hash) for each of the named text columns, in text order."""
    out = df.withColumns({f"_{a}_u": F.regexp_extract_all(F.col(t), F.lit(UNIT), F.lit(0)) for t, a in texts.items()})
    points = lambda t: F.regexp_extract_all(F.col(t), F.lit("(?s)."), F.lit(0))
    out = out.withColumns({f"_{a}_w": F.when(F.size(f"_{a}_u") >= K, F.col(f"_{a}_u")).otherwise(points(t)) for t, a in texts.items()})

    def smers(units: str) -> Column:
        w = F.col(units)
        return F.zip_with(F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))), F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0))), lambda a, b: F.xxhash64(a, b))

    out = out.withColumns({f"_{a}_s": smers(f"_{a}_w") for a in texts.values()})
    none = F.array().cast("array<struct<at:int,hash:bigint>>")

    def kmers(s: str, only=None) -> Column:
        at = lambda i: F.get(F.col(s), i)
        every = F.sequence(F.lit(0), F.size(F.col(s)) - (K - S + 1))
        return F.transform(F.filter(every, only) if only else every, lambda i: F.struct(i.alias("at"), F.xxhash64(at(i), at(i + 2), at(i + 3)).alias("hash")))

    def closed(s: str) -> Column:
        at = lambda i: F.get(F.col(s), i)
        chosen = kmers(s, lambda i: F.least(at(i), at(i + 3)) <= F.least(at(i + 1), at(i + 2)))
        return F.when(F.size(F.col(s)) >= K - S + 1, chosen)

    def smallest(s: str) -> Column:
        least = F.array_min(F.transform(kmers(s), lambda x: F.struct(x["hash"].alias("hash"), x["at"].alias("at"))))
        return F.array(F.struct(least["at"].alias("at"), least["hash"].alias("hash")))

    out = out.withColumns({f"_{a}_c": closed(f"_{a}_s") for a in texts.values()})
    whole = lambda t: F.when(F.length(t) > 0, F.array(F.struct(F.lit(0).alias("at"), F.xxhash64(F.col(t)).alias("hash"))))
    found = lambda t, a: F.when(F.col(f"_{a}_c").isNull(), F.coalesce(whole(t), none)).when(F.size(f"_{a}_c") > 0, F.col(f"_{a}_c")).otherwise(smallest(f"_{a}_s"))
    out = out.withColumns({a: found(t, a) for t, a in texts.items()})
    return out.drop(*[f"_{a}_{x}" for a in texts.values() for x in "uwsc"])


def with_fingerprints(df: DataFrame, texts: dict[str, str]) -> DataFrame:
    """df with the fingerprint of each of the named text columns: arrays <name>_hash, rising, and <name>_at."""
    out = with_anchors(df, {t: f"_{a}" for t, a in texts.items()})
    out = out.withColumns({f"_{a}_o": F.sort_array(F.transform(f"_{a}", lambda x: F.struct(x["hash"], x["at"]))) for a in texts.values()})
    first = lambda o: F.filter(o, lambda x, i: (i == 0) | (F.get(F.col(o), i - 1)["hash"] != x["hash"]))
    out = out.withColumns({f"_{a}_f": first(f"_{a}_o") for a in texts.values()})
    out = out.withColumns({f"{a}_hash": F.transform(f"_{a}_f", lambda x: x["hash"]) for a in texts.values()})
    out = out.withColumns({f"{a}_at": F.transform(f"_{a}_f", lambda x: x["at"]) for a in texts.values()})
    return out.drop(*[f"_{a}{x}" for a in texts.values() for x in ("", "_o", "_f")])


def with_likeness(df: DataFrame, column: str, a: str, b: str) -> DataFrame:
    """df with the likeness of two fingerprints (see the module), in a time of n log n."""
    both, pairs = f"_{column}_b", f"_{column}_p"
    side = lambda name, k: F.zip_with(f"{name}_hash", f"{name}_at", lambda h, t: F.struct(h.alias("hash"), F.lit(k).alias("side"), t.alias("at")))
    out = df.withColumn(both, F.when(F.arrays_overlap(f"{a}_hash", f"{b}_hash"), F.sort_array(F.concat(side(a, 0), side(b, 1)))))

    def pair(x: Column, i: Column) -> Column:
        after = F.get(F.col(both), i + 1)
        return F.when((x["side"] == 0) & (after["hash"] == x["hash"]), F.struct(x["at"].alias("at"), (after["at"] - x["at"]).alias("moved")))

    out = out.withColumn(pairs, F.sort_array(F.filter(F.transform(both, pair), lambda x: x.isNotNull())))
    like = lambda x, j: F.coalesce(x["moved"] == F.get(F.col(pairs), j)["moved"], F.lit(False))
    kept = F.filter(pairs, lambda x, i: (x["moved"] == 0) | like(x, i - 1) | like(x, i + 1))
    size = F.size(f"{a}_hash") + F.size(f"{b}_hash")
    value = F.when(size == 0, 1.0).when(F.col(both).isNull(), 0.0).otherwise(F.size(kept) / F.greatest(size - F.size(pairs), F.lit(1)))
    return out.withColumn(column, value).drop(both, pairs)


def sketch(hashes: Column, size: int = SIZE) -> Column:
    """The smallest hashes of a fingerprint, whose hashes are rising."""
    return F.slice(hashes, 1, size)


def sketch_likeness(a: Column, b: Column, size: int = SIZE) -> Column:
    """Share of common hashes among the smallest of both sketches."""
    both = F.slice(F.sort_array(F.array_union(a, b)), 1, size)
    common = F.size(F.array_intersect(both, F.array_intersect(a, b)))
    return F.when(F.size(both) == 0, 1.0).otherwise(common / F.greatest(F.size(both), F.lit(1)))


def text_of(fingerprint: Column) -> Column:
    return F.array_join(F.transform(fingerprint, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), "")


def packed(name: str) -> Column:
    """The fingerprint in the columns <name>_hash and <name>_at as a string."""
    each = F.zip_with(f"{name}_hash", f"{name}_at", lambda h, t: F.concat(F.lpad(F.hex(h), 16, "0"), F.lpad(F.hex(t), 8, "0")))
    return F.translate(F.base64(F.unhex(F.array_join(each, ""))), "\r\n", "")


def unpacked(text: str) -> list[tuple[int, int]]:
    """(hash, place) of a packed fingerprint."""
    return list(struct.iter_unpack(">qi", base64.b64decode(text)))


def range_of(begins: list[int]) -> Column:
    """The number of the range that `key` lies in, looked up in two steps: among every `step`-th bound, then among those between."""
    literal = lambda values: F.array(*[F.lit(x).cast("bigint") for x in values])
    step = int(len(begins) ** 0.5) + 1
    upto = lambda values: F.size(F.filter(values, lambda b: b <= F.col("key")))
    block = upto(literal(begins[::step])) - 1
    return block * step + upto(F.slice(literal(begins), block * step + 1, step)) - 1


def even(begins: list[int], size: dict[int, int], n: int) -> list[int]:
    """Of the beginnings of small ranges those that cut all into about n ranges of the same size, as far as the small ones allow."""
    share, out, filled = sum(size.values()) / n, [], math.inf
    for k, begin in enumerate(begins):
        if filled + size.get(k, 0) / 2 > share:
            out.append(begin)
            filled = 0
        filled += size.get(k, 0)
    return out


def dealt(docs: DataFrame) -> DataFrame:
    """(doc_id, text, key, range, extra): rows dealt to ranges of doc_id, by one exchange.

    The ranges begin at ids of the table (quantiles, sent to all tasks, at most MAX_RANGES) and
    hold about as many bytes each, wherever long texts stand; the row that begins a range also
    goes to the range before it (extra), behind that range's rows, so that every document's
    successor is found within a range. After the last range comes the first.
    """
    spark = docs.sparkSession
    doc_id, text = columns_of(docs, "doc_id", "text")
    lowest = F.lit(-(2**63)).cast("bigint")
    keyed = docs.select(doc_id.alias("doc_id"), F.coalesce(text, F.lit("")).alias("text"), F.coalesce(doc_id.cast("bigint"), lowest).alias("key"))
    rows, first, last = keyed.agg(F.count(F.lit(1)), F.min("key"), F.max("key")).first()
    n = min(MAX_RANGES, max(2, 2 * int(spark.conf.get("spark.sql.shuffle.partitions")), rows // RANGE_ROWS))
    fine = min(MAX_RANGES, 8 * n)
    cuts = keyed.agg(F.percentile_approx("key", F.array(*[F.lit(k / fine) for k in range(1, fine)]), F.lit(4 * fine))).first()[0] if first != last else []
    begins = sorted({first, *(cuts or [])} - {None}) or [-(2**63)]
    if len(begins) > n:
        sizes = keyed.select(range_of(begins).alias("small"), (F.octet_length("text") + 64).alias("bytes")).groupBy("small").agg(F.sum("bytes").alias("bytes"))
        begins = even(begins, dict(sizes.collect()), n)
    bounds = F.array(*[F.lit(x).cast("bigint") for x in begins])
    before = F.when(F.get(bounds, F.col("own")) == F.col("key"), F.array(F.struct(F.pmod(F.col("own") - 1, F.size(bounds)).alias("range"), F.lit(True).alias("extra"))))
    here = F.array(F.struct(F.col("own").alias("range"), F.lit(False).alias("extra")))
    to = F.explode(F.concat(here, F.coalesce(before, F.array().cast("array<struct<range:int,extra:boolean>>"))))
    return keyed.withColumn("own", range_of(begins)).withColumn("to", to).select("doc_id", "text", "key", "to.range", "to.extra").repartition("range")


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, text, edited) with the fingerprints (_hash, _at) own, next and changed, and near_edited and near_next.

    edited: the last quarter of the text replaced by the beginning of the next document's; changed
    is its fingerprint.
    """
    order = Window.partitionBy("range").orderBy("extra", "key", "text")
    own = with_fingerprints(dealt(docs), {"text": "own"})
    following = {f"next_{x}": F.lead(c).over(order) for x, c in (("text", "text"), ("hash", "own_hash"), ("at", "own_at"))}
    pairs = own.withColumns(following).where("not extra")
    quarter = F.floor(F.length("text") / 4).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.length("text") - quarter), F.substring("next_text", F.lit(1), quarter))
    found = with_fingerprints(pairs.withColumn("edited", edited).drop("next_text"), {"edited": "changed"})
    found = with_likeness(with_likeness(found, "near_edited", "own", "changed"), "near_next", "own", "next")
    return found.select("doc_id", "text", "edited", *[f"{a}_{x}" for a in ("own", "changed", "next") for x in ("hash", "at")], "near_edited", "near_next")


def op8_syncmer_fingerprints(spark, sf_dir: str) -> DataFrame:
    out = fingerprints(documents(spark, sf_dir))
    return out.select(
        "doc_id", F.length("text").cast("bigint").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        packed("own").alias("fingerprint"), packed("changed").alias("edited_fingerprint"), "near_edited", "near_next", text_of(sketch(F.col("own_hash"))).alias("sketch"),
    )
