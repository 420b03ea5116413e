"""Token counts as delta-maintained rollups.

Totals by source, language and tokenizer version are sums of signed deltas: inserts add, deletes subtract,
revised counts do both. A batch is one folder; it counts from the moment its success marker is there, so that a
replayed batch id changes nothing and a half-written one is not read and can be written again.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mapped, scratch, table, wider, word_count, written
from .tokens import Encoder

KEYS = ("source", "lang", "tokenizer")
#: Letters and digits in runs, every other sign alone.
SIGNS = r"[\p{L}\p{N}]+|[^\p{L}\p{N}\x20\x09-\x0D]"


def sign_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(SIGNS)), F.lit(0)).cast("long")


def with_tokens(docs: DataFrame, tokenizer: str | None = None, version: str = "word_bpe_49k", text: str = "text") -> DataFrame:
    """``docs`` with tokenizer (the version's name) and tokens (long): ids that the tokenizer's file gives each text, without
    special ones. ``tokenizer`` is a file on every executor. Null and empty texts have 0, repeated rows count alike; columns
    of these names are replaced, all others stay; an empty table gives an empty one."""
    docs = docs.drop("tokens", "tokenizer")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(tokenizer)
        for batch in batches:
            at = batch.schema.get_field_index(text)
            counts = []
            for begin in range(0, batch.num_rows, 256):
                counts += [len(ids) // 4 for ids in encoder.ids(batch.column(at).slice(begin, 256).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(counts, pa.int64())], [*batch.schema.names, "tokens"])

    return mapped(docs, run, wider(docs.schema, tokens="long")).withColumn("tokenizer", F.lit(version))


def delta(rows: DataFrame, sign: int = 1) -> DataFrame:
    """Signed totals of rows with source, lang, tokenizer and tokens; one row a group, summed before any shuffle.

    Null keys are keys, null tokens count 0, repeated rows count again, extra columns are left out, no rows give none."""
    return rows.groupBy(*KEYS).agg((F.count("*") * sign).alias("docs"), (F.coalesce(F.sum("tokens"), F.lit(0)) * sign).cast("long").alias("tokens"))


def revision(before: DataFrame, after: DataFrame) -> DataFrame:
    """Delta that takes the earlier counts back and adds the later ones, under their own keys; either may be empty."""
    both = delta(before, -1).unionByName(delta(after))
    return both.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))


class Rollup:
    """Totals below ``folder`` (on storage that the whole cluster shares).

    Batches that a snapshot holds are known by its list of ids, which stays a table; their folders go one snapshot later, so
    that a reader who began before it ends in peace, and no listing grows with the age of the rollup.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        path = spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        self.fs = path.getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def _ids(self, kind: str) -> list[str]:
        if not self.fs.exists(self._path("")):
            return []
        names = [s.getPath().getName() for s in self.fs.listStatus(self._path(""))]
        return sorted(n.partition("=")[2] for n in names if n.startswith(f"{kind}=") and self.fs.exists(self._path(f"{n}/_SUCCESS")))

    def folded(self, snapshot: str | None = None) -> DataFrame:
        """(batch): ids of the batches inside the last snapshot, or the given one."""
        last = [snapshot] if snapshot else self._ids("snapshot")[-1:]
        paths = [f"{self.folder}/folded={k}" for k in last]
        return self.spark.read.schema("batch string").parquet(*paths) if paths else self.spark.createDataFrame([], "batch string")

    def _open(self, snapshot: str | None = None) -> list[str]:
        """Ids of the batch folders that the last snapshot does not hold."""
        there = self._ids("batch")
        held = {r["batch"] for r in self.folded(snapshot).where(F.col("batch").isin(there)).collect()}  # of the folders that are there
        return [b for b in there if b not in held]

    def committed(self) -> DataFrame:
        """(batch): ids of the batches that count, those inside the snapshot included."""
        there = self.spark.createDataFrame([(b,) for b in self._open()], "batch string")
        return self.folded().unionByName(there)

    def commit(self, batch: str, rows: DataFrame) -> bool:
        """Write the batch's delta; False, with nothing done, if this id is committed already."""
        if not self.committed().where(F.col("batch") == batch).isEmpty():
            return False
        rows.select(*KEYS, "docs", "tokens").write.mode("overwrite").parquet(f"{self.folder}/batch={batch}")
        return True

    def compact(self) -> None:
        """Fold all committed batches into a new snapshot, so that totals read one folder; its list of ids is written first.
        What the snapshot before it had folded, and older snapshots, are removed."""
        ids = self.committed()
        if ids.isEmpty():
            return
        before = self._ids("snapshot")
        k = f"{int(before[-1]) + 1 if before else 0:06d}"
        gone = set(self._ids("batch")) - set(self._open()) if before else set()
        ids.write.mode("overwrite").parquet(f"{self.folder}/folded={k}")
        self.totals().write.mode("overwrite").parquet(f"{self.folder}/snapshot={k}")
        for name in [f"batch={b}" for b in gone] + [f"{kind}={old}" for old in before[:-1] for kind in ("snapshot", "folded")]:
            self.fs.delete(self._path(name), True)

    def totals(self) -> DataFrame:
        """docs and tokens by source, lang and tokenizer; groups of which nothing is left are dropped."""
        last = self._ids("snapshot")[-1:]
        paths = [f"{self.folder}/snapshot={k}" for k in last] + [f"{self.folder}/batch={b}" for b in self._open()]
        schema = "source string, lang string, tokenizer string, docs long, tokens long"
        rows = self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)
        sums = rows.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        return sums.where("docs <> 0 or tokens <> 0")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after three batches and a replay: all documents come in, English ones are recounted by a later
    tokenizer version, those labelled as of low quality go."""
    docs = table(spark, sf_dir, "documents")
    words, signs = word_count(F.col("text")).alias("words"), F.when(F.col("lang") == "en", sign_count(F.col("text"))).alias("signs")
    counts = written(docs.select("doc_id", "source", "lang", words, signs))
    first = counts.select("doc_id", "source", "lang", F.lit("words-1").alias("tokenizer"), F.col("words").alias("tokens"))
    later = counts.select("doc_id", "source", "lang", F.lit("signs-2").alias("tokenizer"), F.col("signs").alias("tokens")).where("lang = 'en'")
    now = first.where("lang is distinct from 'en'").unionByName(later)
    gone = table(spark, sf_dir, "labels").where("quality = 0").select("doc_id")
    rollup = Rollup(spark, scratch(spark))
    rollup.commit("1", delta(first))
    recounted = revision(first.where("lang = 'en'"), later)
    rollup.commit("2", recounted)
    rollup.commit("3", delta(now.join(gone, "doc_id", "left_semi"), -1))
    rollup.commit("2", recounted)
    return rollup.totals()


OP9_SQL = r"""
SELECT source, lang, CASE WHEN lang = 'en' THEN 'signs-2' ELSE 'words-1' END AS tokenizer, COUNT(*)::BIGINT AS docs,
  SUM(CASE WHEN lang = 'en' THEN COALESCE(len(regexp_extract_all(text, '[\p{L}\p{N}]+|[^\p{L}\p{N}\x20\x09-\x0D]')), 0)
           ELSE COALESCE(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) END)::BIGINT AS tokens
FROM documents WHERE NOT EXISTS (SELECT 1 FROM labels WHERE labels.doc_id = documents.doc_id AND quality = 0)
GROUP BY ALL
"""
