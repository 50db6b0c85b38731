"""Exact dedup with a persistent digest index.

The index is a Parquet table bucketed and sorted by digest, with one row for each distinct text that was ever kept. Its
bucket count is stored beside it, so it is read alike in every session, and writers that meet lose nothing. A delivery is reduced to one row per digest
before any join (copies combine on the map side, so a text with a third of all rows is a few rows by then) and dealt
by the index's buckets; the anti-join that finds new digests and the join that looks the known ones up then meet the
index bucket by bucket, and the index is never shuffled. The join that gives every row its verdict reads both sides
through plain exchanges, which adaptive execution can split when a digest is hot.
"""

from __future__ import annotations

import hashlib
import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from arcweave.llm.store import ascii_lower, discard, fresh_path, shuffle_partitions, stored, table

INDEX_SCHEMA = "digest BINARY, keep_id BIGINT"


class DigestIndex:
    """digest -> keep_id, kept below `path`.

    path/layout has a file per generation of the index: how many buckets it has, and the folder of its rows. A file is
    created only if it is absent, so of several writers one names a generation and the others follow it; the newest
    generation counts. An index that exists is opened with the count it has, whatever the session's settings; asking for
    another one raises ValueError (compact() changes it). A new index takes `buckets`, or as many as there are shuffle
    partitions: about one for each 100 MB of digests expected, that is 2.5 million texts, is right.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        self.spark, self.path = spark, path.rstrip("/")
        self._layout = spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/layout")
        self._files = self._layout.getFileSystem(spark._jsc.hadoopConfiguration())
        if not self._refresh():
            self._publish(0, buckets or max(8, shuffle_partitions(spark)), self._new_folder())
            self._refresh()
        if buckets is not None and buckets != self.buckets:
            raise ValueError(f"the index at {path} has {self.buckets} buckets, not {buckets}; compact() changes them")

    def _new_folder(self) -> str:
        return f"rows-{uuid.uuid4().hex}"

    def _refresh(self) -> bool:
        """Turn to the newest generation; whether there is one."""
        if not self._files.exists(self._layout):
            return False
        names = [f.getPath() for f in self._files.listStatus(self._layout)]
        if not names:
            return False
        newest = max(names, key=lambda p: p.getName())
        for _ in range(100):  # a file that was just created may not have its line yet
            stream = self._files.open(newest)
            try:
                line = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            finally:
                stream.close()
            if line.endswith("\n"):
                buckets, folder = line.split()
                self._open(int(newest.getName().removeprefix("generation-")), int(buckets), folder)
                return True
            time.sleep(0.1)
        raise RuntimeError(f"{newest} is not complete; its writer failed, remove it")

    def _open(self, generation: int, buckets: int, folder: str) -> None:
        self.generation, self.buckets, self.folder = generation, buckets, folder
        self.name = self._table(folder, buckets)

    def _table(self, folder: str, buckets: int) -> str:
        location = f"{self.path}/{folder}"
        name = "digest_index_" + hashlib.md5(location.encode()).hexdigest()
        if not self.spark.catalog.tableExists(name):
            self.spark.sql(
                f"CREATE TABLE {name} ({INDEX_SCHEMA}) USING parquet OPTIONS (path '{location}') "
                f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS"
            )
        return name

    def _publish(self, generation: int, buckets: int, folder: str) -> bool:
        """Name a generation, unless another writer has: False then."""
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/layout/generation-{generation:012d}")
        try:
            out = self._files.create(at, False)
        except Py4JJavaError:
            if self._files.exists(at):
                return False
            raise
        out.writeBytes(f"{buckets} {folder}\n")
        out.close()
        return True

    def _append(self, rows: DataFrame, folder: str, buckets: int) -> None:
        """A file per bucket."""
        writer = rows.repartition(buckets, "digest").write.mode("append").format("parquet")
        writer.option("path", f"{self.path}/{folder}").bucketBy(buckets, "digest").sortBy("digest").saveAsTable(self._table(folder, buckets))

    def rows(self) -> DataFrame:
        """The index, read bucket by bucket. A digest that two writers appended at once is there twice."""
        self.spark.catalog.refreshTable(self.name)  # other writers append too
        return self.spark.table(self.name)

    def known(self, keys: DataFrame) -> DataFrame:
        """`keys` (digest once each, and more) that the index has, with keep_id: the largest if writers raced."""
        dealt = keys.repartition(self.buckets, "digest")
        found = self.rows().groupBy("digest").agg(F.max("keep_id").alias("keep_id"))  # within buckets: no exchange
        return found.hint("merge").join(dealt, "digest")

    def ingest(self, delivery: DataFrame) -> None:
        """Append the digests of `delivery` (doc_id, digest) that the index lacks; the largest doc_id represents each.

        The first rows are stored before the join, or the optimizer would push it below their aggregate, where a text's
        copies still meet; the new ones before they are appended, as Spark doesn't append to what it reads. A failed
        append commits nothing, so it can be repeated.
        """
        firsts = stored(delivery.groupBy("digest").agg(F.max("doc_id").alias("keep_id")), "digest-firsts")
        written = None
        while written != self.folder:  # once, or again if a compaction moved the index while this one wrote
            self._refresh()
            written, buckets = self.folder, self.buckets
            dealt = firsts.repartition(buckets, "digest")
            new = stored(dealt.join(self.rows().select("digest").hint("merge"), "digest", "left_anti"), "digest-delta")
            self._append(new, written, buckets)
            discard(new)
            self._refresh()
        discard(firsts)

    def compact(self, buckets: int | None = None) -> None:
        """A new generation with one file per bucket and one row per digest, in `buckets` buckets if given.

        Each append adds a file to every bucket; a compaction now and then keeps their number small. What others append
        to the earlier generation until the new one is named is carried over then; who appends later finds it named and
        appends again. A compaction that fails leaves the index as it was, and so does one that another was faster than.
        The earlier generation's folder stays for those who still read it.
        """
        self._refresh()
        old, generation, size, folder = self.rows(), self.generation + 1, buckets or self.buckets, self._new_folder()
        self._append(old.groupBy("digest").agg(F.max("keep_id").alias("keep_id")), folder, size)
        if self._publish(generation, size, folder):
            before = self.name
            self._refresh()
            self.spark.catalog.refreshTable(before)
            late = self.spark.table(before).groupBy("digest").agg(F.max("keep_id").alias("keep_id"))
            missed = stored(late.join(self.spark.table(self._table(folder, size)).select("digest").hint("merge"), "digest", "left_anti"), "digest-missed")
            self._append(missed, folder, size)
            discard(missed)
        else:
            self._refresh()


def digests(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id and SHA-256 of the text with A-Z lower-cased; null counts as empty."""
    norm = ascii_lower(F.coalesce(F.col(text), F.lit("")))
    return docs.select("doc_id", F.unhex(F.sha2(norm.cast("binary"), 256)).alias("digest"))


def exact_dedup(docs: DataFrame, index: DigestIndex, deliveries: int = 2) -> DataFrame:
    """One row per row of `docs`: doc_id, keep_id, group_size, kept, text_sha256.

    `docs` reaches the index in `deliveries` parts from the largest doc_ids down, so that of equal texts within docs
    the largest doc_id stays; a text which the index knew before keeps the id that the index has for it. group_size
    counts rows of `docs`. Rows without doc_id come last and are kept only through another row's id, so a text that
    only such rows have has keep_id null and kept false. Rows that repeat a kept doc_id with the same text are all kept.
    An empty table gives no rows. Other columns of `docs` are not read. doc_id must be a number: TypeError else.
    """
    if not isinstance(docs.schema["doc_id"].dataType, NumericType):
        raise TypeError("doc_id must be a number")
    marks = stored(digests(docs), "digests")
    low, high = marks.agg(F.min("doc_id"), F.max("doc_id")).first()
    edges = [] if low is None else [high - (high - low) * k // deliveries for k in range(1, deliveries)]
    at = F.coalesce(sum(((F.col("doc_id") <= e).cast("int") for e in edges), F.lit(0)), F.lit(len(edges)))
    for part in range(len(edges) + 1):
        index.ingest(marks.where(at == part))
    sizes = marks.groupBy("digest").agg(F.count(F.lit(1)).alias("group_size"))
    groups = stored(index.known(sizes), "digest-groups")
    return marks.join(groups, "digest").select(
        "doc_id",
        "keep_id",
        "group_size",
        F.coalesce(F.col("doc_id") == F.col("keep_id"), F.lit(False)).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = DigestIndex(spark, fresh_path(spark, "digest-index"))
    return exact_dedup(table(spark, sf_dir, "documents"), index)


OP7_SQL = """
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
           FROM documents),
g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY 1)
SELECT d.doc_id, g.keep_id, CAST(g.group_size AS BIGINT) AS group_size, d.doc_id = g.keep_id AS kept, d.text_sha256
FROM d JOIN g USING (text_sha256)
"""
