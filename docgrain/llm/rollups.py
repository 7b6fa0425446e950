"""Token totals by source, language and tokenizer version, maintained from signed changes."""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ["source", "lang", "tokenizer"]
_TOTALS = "source string, lang string, tokenizer string, docs long, tokens long"

# Tokenizer versions that are a plain expression over the text.
PATTERNS = {"words-1": "[^\\x20\\x09-\\x0D]+", "alnum-1": "[0-9A-Za-z]+|[^\\x00-\\x7F]"}


def pattern_counts(text: Column, pattern: str) -> Column:
    """Matches of a pattern in a text; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(pattern)), F.lit(0)).cast("long")


def count_tokens(
    docs: DataFrame,
    patterns: Mapping[str, str] = PATTERNS,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    lang_col: str = "lang",
) -> DataFrame:
    """(doc_id, source, lang, tokenizer, tokens): a row per document and tokenizer version."""
    text = F.col(text_col).cast("string")
    counts = [F.struct(F.lit(v).alias("v"), pattern_counts(text, p).alias("n")) for v, p in patterns.items()]
    return docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).cast("string").alias("source"),
        F.col(lang_col).cast("string").alias("lang"),
        F.explode(F.array(*counts)).alias("c"),
    ).select("doc_id", "source", "lang", F.col("c.v").alias("tokenizer"), F.col("c.n").alias("tokens"))


def count_bpe_tokens(
    docs: DataFrame,
    ranks_file: str,
    pattern: str,
    version: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    lang_col: str = "lang",
) -> DataFrame:
    """The same rows with a byte-pair tokenizer: ``ranks_file`` lists base64 tokens and ranks.

    The file must lie at that path on every machine; each Python worker loads it once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import base64

        import tiktoken

        with open(ranks_file, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        coder = tiktoken.Encoding(version, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        for batch in batches:
            n = [len(coder.encode_ordinary(t or "")) for t in batch.column("t").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(n, pa.int64())], names=["doc_id", "source", "lang", "tokens"]
            )

    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(source_col).cast("string").alias("source"),
        F.col(lang_col).cast("string").alias("lang"),
        F.col(text_col).cast("string").alias("t"),
    )
    counted = rows.mapInArrow(run, "doc_id long, source string, lang string, tokens long")
    return counted.select("doc_id", "source", "lang", F.lit(version).alias("tokenizer"), "tokens")


def inserts(counted: DataFrame) -> DataFrame:
    """Signed changes that add documents."""
    return counted.select(*KEYS, F.lit(1).cast("long").alias("docs"), "tokens")


def deletes(counted: DataFrame) -> DataFrame:
    """Signed changes that take documents away, with the counts they were added with."""
    return counted.select(*KEYS, F.lit(-1).cast("long").alias("docs"), (-F.col("tokens")).alias("tokens"))


def revisions(before: DataFrame, after: DataFrame) -> DataFrame:
    """Signed changes that replace counts (and keys, if those changed) of documents."""
    return deletes(before).union(inserts(after))


class TokenRollup:
    """Additive totals under a folder that all executors share.

    A batch is a table of signed changes ``(source, lang, tokenizer, docs, tokens)`` with an id.
    It is summed per key before the shuffle and written under its id as one delta; Spark's success file is the commit.
    A batch that is committed is not applied again, whoever replays it; one that broke off leaves no
    success file, is not read, and is overwritten by the retry. Batches may be committed in any
    order, since sums commute. :meth:`compact` folds the deltas into a new base that names the
    batches it holds; readers use the newest complete base and the deltas it does not name, so a
    reader never counts a batch twice.

    A null source, language or tokenizer is a key of its own; null amounts count as zero. Keys whose documents and
    tokens are back at zero are not listed.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    # Names of folders, one per batch or base, come to the driver; never totals.

    def _children(self, folder: str) -> list[str]:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{folder}")
        fs = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(path)]
        done = jvm.org.apache.hadoop.fs.Path
        return sorted(n for n in names if fs.exists(done(f"{self.root}/{folder}/{n}/_SUCCESS")))

    def batches(self) -> list[str]:
        """Ids of the committed batches that no base has absorbed yet, and of those in the base."""
        return sorted({*self._deltas(), *self._absorbed(self._base())})

    def _deltas(self) -> list[str]:
        return [n.removeprefix("batch=") for n in self._children("deltas")]

    def _base(self) -> str | None:
        return max(self._children("base"), default=None)

    def _absorbed(self, base: str | None) -> set[str]:
        if base is None:
            return set()
        return {r[0] for r in self.spark.read.text(f"{self.root}/absorbed/{base}").collect()}

    def commit(self, batch_id: str, changes: DataFrame) -> bool:
        """Apply a batch; False if it had been applied before."""
        if not batch_id.replace("-", "").replace("_", "").isalnum():
            raise ValueError(f"batch id {batch_id!r}: letters, digits, - and _ only")
        if batch_id in self.batches():
            return False
        summed = _sums(changes.select(*KEYS, "docs", "tokens"))
        summed.write.mode("overwrite").parquet(f"{self.root}/deltas/batch={batch_id}")
        return True

    def totals(self) -> DataFrame:
        """(source, lang, tokenizer, docs, tokens): current totals."""
        base = self._base()
        absorbed = self._absorbed(base)
        paths = [f"{self.root}/base/{base}"] if base else []
        paths += [f"{self.root}/deltas/batch={b}" for b in self._deltas() if b not in absorbed]
        if not paths:
            return self.spark.createDataFrame([], _TOTALS)
        return _sums(self.spark.read.schema(_TOTALS).parquet(*paths)).filter("docs <> 0 OR tokens <> 0")

    def compact(self) -> None:
        """Fold all committed batches into a new base. The base counts once its success file is there,
        which is after the list of its batches."""
        names, totals = self.batches(), self.totals()
        base = f"v{int((self._base() or 'v0')[1:]) + 1:09d}"
        rows = self.spark.createDataFrame([(n,) for n in names], "value string")
        rows.coalesce(1).write.mode("overwrite").text(f"{self.root}/absorbed/{base}")
        totals.write.mode("overwrite").parquet(f"{self.root}/base/{base}")


def _sums(changes: DataFrame) -> DataFrame:
    amount = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c)
    return changes.groupBy(*KEYS).agg(amount("docs"), amount("tokens"))
