"""Token counts: totals by source, language and tokenizer version, kept up to date by deltas.

A batch of changes holds rows (op, source, lang, tokenizer, tokens, old_tokens): `insert` adds a
document and its tokens, `delete` takes both away, `revise` replaces old_tokens by tokens. Only
the batch's signed sums, one row for each changed total, are written. `compact` writes the totals
as a snapshot with the names of the batches that it covers, so that reading takes one snapshot and
the batches since, however many there were.

Commits: data are written to a folder of their own attempt, which nobody reads before a marker
names it. The marker is one small file, named by the batch and put in place by one rename of a
file (or, in an object store, one put): an attempt is read whole or not at all, also by readers
beside it, and of two attempts for one batch only the one that the marker names counts. So
applying a batch again (after a lost driver, or by mistake) changes nothing. Where several writers
may apply the same batch at the same time, the store must refuse to put a marker twice (HDFS and
local disks do) or the one put last counts; either way the batch counts once.

Edge cases: null source, lang or tokenizer are groups of their own; null token counts count as
0; a null or empty text has 0 tokens and is a document; very long texts are counted whole; an
unknown op raises; an empty batch is committed too; repeated rows in a batch each count; an empty
table gives no totals; other columns are ignored. Totals that come back to no documents and no
tokens are left out.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wavegrid.llm.common import columns_of, cut, documents, free_name, shared_dir

KEYS = ("source", "lang", "tokenizer")
DELTAS = "source string, lang string, tokenizer string, documents bigint, tokens bigint"


def deltas(changes: DataFrame) -> DataFrame:
    """Signed sums of a batch, pre-aggregated before the exchange, however hot a source is."""
    op, tokens, old = columns_of(changes, "op", "tokens", "old_tokens")
    tokens, old = (F.coalesce(c.cast("bigint"), F.lit(0).cast("bigint")) for c in (tokens, old))
    sign = F.when(op == "insert", 1).when(op == "delete", -1).when(op == "revise", 0)
    checked = F.when(sign.isNull(), F.raise_error(F.concat(F.lit("unknown op "), F.coalesce(op, F.lit("null"))))).otherwise(sign)
    by = F.when(op == "insert", tokens).when(op == "delete", -tokens).otherwise(tokens - old)
    return (
        changes.select(*columns_of(changes, *KEYS), checked.cast("bigint").alias("documents"), by.alias("tokens"))
        .groupBy(*KEYS).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens"))
        .where("documents <> 0 or tokens <> 0")
    )


class TokenTotals:
    """Totals in a folder that driver and executors share: data/ (attempts), batches/ and snapshots/ (markers)."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._path = self._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, kind: str) -> list[str]:
        here = self._path(f"{self.path}/{kind}")
        if not self._fs.exists(here):
            return []
        return sorted(x for s in self._fs.listStatus(here) if not (x := s.getPath().getName()).startswith((".", "_")))

    def _read(self, kind: str, name: str) -> dict:
        stream = self._fs.open(self._path(f"{self.path}/{kind}/{name}"))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _mark(self, kind: str, name: str, content: dict) -> bool:
        """Puts a marker in place whole; False if there is one already."""
        final, made = self._path(f"{self.path}/{kind}/{name}"), self._path(f"{self.path}/{kind}/.{name}-{uuid.uuid4().hex}")
        self._fs.mkdirs(final.getParent())
        stream = self._fs.create(made, False)
        stream.write(bytearray(json.dumps(content).encode()))
        stream.close()
        if not self._fs.exists(final) and self._fs.rename(made, final):
            return True
        self._fs.delete(made, False)
        return False

    def _data(self, rows: DataFrame) -> str:
        name = uuid.uuid4().hex
        rows.write.parquet(f"{self.path}/data/{name}")
        return name

    def committed(self) -> list[str]:
        """Names of the committed batches."""
        return self._names("batches")

    def apply(self, batch_id: str, changes: DataFrame) -> bool:
        """Commits a batch; False, without reading it, if it is committed already."""
        if not batch_id or "/" in batch_id or ":" in batch_id or batch_id.startswith((".", "_")):
            raise ValueError(f"not a batch id: {batch_id!r}")
        if self._fs.exists(self._path(f"{self.path}/batches/{batch_id}")):
            return False
        return self._mark("batches", batch_id, {"data": self._data(deltas(changes))})

    def _state(self) -> tuple[dict, list[str]]:
        """The last snapshot and the batches that it does not cover."""
        names = self._names("snapshots")
        snapshot = self._read("snapshots", names[-1]) if names else {"data": None, "covered": []}
        return snapshot, sorted(set(self.committed()) - set(snapshot["covered"]))

    def _totals(self, snapshot: dict, batches: list[str]) -> DataFrame:
        data = [snapshot["data"]] * (snapshot["data"] is not None) + [self._read("batches", b)["data"] for b in batches]
        if not data:
            return self.spark.createDataFrame([], DELTAS)
        rows = self.spark.read.schema(DELTAS).parquet(*[f"{self.path}/data/{x}" for x in data])
        return rows.groupBy(*KEYS).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens")).where("documents <> 0 or tokens <> 0")

    def totals(self) -> DataFrame:
        """(source, lang, tokenizer, documents, tokens) over the committed batches."""
        return self._totals(*self._state())

    def compact(self) -> bool:
        """Writes a snapshot of the totals; False if no batch has come since the last one.

        Of two compactions at a time one counts; batches committed meanwhile are not covered and
        are added by readers. Batches that a snapshot covers need no longer be read, so their data
        may be deleted; their markers stay, since they tell what has been applied.
        """
        snapshot, since = self._state()
        if not since:
            return False
        number = 1 + int((self._names("snapshots") or ["0"])[-1])
        data = self._data(self._totals(snapshot, since))
        return self._mark("snapshots", f"{number:012d}", {"data": data, "covered": sorted({*snapshot["covered"], *since})})


#: The query's tokenizers and what each counts in a text.
def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def byte_quarters(text: Column) -> Column:
    return F.ceil(F.coalesce(F.octet_length(text), F.lit(0)) / 4).cast("bigint")


def letter_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")), F.lit(0)).cast("bigint")


def counted(docs: DataFrame, tokenizers: Mapping[str, Column]) -> DataFrame:
    """docs with a column for each tokenizer's count of the text."""
    return docs.withColumns({free_name(docs, name): count for name, count in tokenizers.items()})


def vocabulary_tokens(docs: DataFrame, vocabulary: str, column: str = "tokens") -> DataFrame:
    """docs with the number of tokens under a byte-pair vocabulary file, for use as a tokenizer version."""
    from wavegrid.llm.bpe import bpe_tokens

    name, found = free_name(docs, column), free_name(docs, "bpe")
    return bpe_tokens(docs, vocabulary, keep_ids=False).select(*columns_of(docs, *docs.columns), F.col(f"{found}.n_tokens").alias(name))


def op2_token_rollup(spark, sf_dir: str) -> DataFrame:
    """All documents enter under two tokenizers; one is then replaced by a revised count for all of
    them; documents of fewer than 50 words leave and enter again under the revised counts, so that
    the totals are those of the whole table; each batch is applied twice, and a snapshot lies
    between the batches."""
    docs = documents(spark, sf_dir)
    text = F.col("text")
    rows = counted(docs, {"words": word_count(text), "letters": letter_words(text), "quarters": byte_quarters(text)})
    rows = cut(rows.select("source", "lang", "words", "letters", "quarters"))
    totals = TokenTotals(spark, f"{shared_dir(spark)}/token-totals-{uuid.uuid4().hex}")
    change = lambda df, op, tokenizer, tokens, old: df.select(F.lit(op).alias("op"), "source", "lang", F.lit(tokenizer).alias("tokenizer"), F.col(tokens).alias("tokens"), (F.col(old) if old else F.lit(None).cast("bigint")).alias("old_tokens"))
    short = rows.where("words < 50")
    both = lambda df, op, words: change(df, op, "words-1", words, None).unionByName(change(df, op, "bytes-1", "quarters", None))
    batches = {
        "1-load": both(rows, "insert", "words"),
        "2-recount": change(rows, "revise", "words-1", "letters", "words"),
        "3-leave": both(short, "delete", "letters"),
        "4-return": both(short, "insert", "letters"),
    }
    for name, batch in batches.items():
        totals.apply(name, batch)
        totals.apply(name, batch)
        if name == "2-recount":
            totals.compact()
    return totals.totals()


#: \x3A-\x40 and the like are the same sets in DuckDB's regular expressions.
OP2_SQL = r"""
WITH counted AS (
  SELECT source, lang,
         coalesce(len(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), 0) AS letters,
         CAST(ceil(coalesce(strlen(text), 0) / 4.0) AS BIGINT) AS quarters
  FROM documents
)
SELECT source, lang, 'words-1' AS tokenizer, CAST(count(*) AS BIGINT) AS documents, CAST(sum(letters) AS BIGINT) AS tokens FROM counted GROUP BY source, lang
UNION ALL
SELECT source, lang, 'bytes-1', CAST(count(*) AS BIGINT), CAST(sum(quarters) AS BIGINT) FROM counted GROUP BY source, lang
"""
