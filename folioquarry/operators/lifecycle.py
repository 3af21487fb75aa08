"""A corpus of parquet tables: append, replace, delete, resume, outcomes, integrity, versions.

A corpus is a folder of version folders. A version has the parquet parts that it added and a list, ``_PARTS``, of the parts
that make up each of its tables: an append writes the new rows and names the old parts again, so its cost follows what is
new. The list is written in one piece, beside its place, and renamed there last: a version is published once it has one,
the newest is current, readers see all of a change or none of it, and a failed write leaves nothing but a folder that no
list names.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioquarry.plans.runtime import cut

FORMAT = 2


def append_new(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Incoming rows whose file digest and content digest are both unknown; of incoming rows with one digest the least id."""
    fresh = incoming.join(existing.where("sha256 is not null").select("sha256").distinct(), "sha256", "left_anti")
    fresh = fresh.join(existing.where("content_sha256 is not null").select("content_sha256").distinct(), "content_sha256", "left_anti")
    keep = fresh.groupBy(F.coalesce("content_sha256", "sha256", F.col("doc_id").cast("string")).alias("_k")).agg(F.min("doc_id").alias("doc_id"))
    return fresh.join(keep.select("doc_id"), "doc_id", "left_semi")


def to_ingest(listing: DataFrame, done: DataFrame) -> DataFrame:
    """Files that a resumed run still has to read: by identity of path, size and time."""
    return listing.join(done.where("source_identity is not null").select("source_identity").distinct(), "source_identity", "left_anti")


def descendants(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """``root``, ``id`` of everything below each root over (id, parent) edges, the root included; cycles end."""
    e = cut(edges.select("id", "parent").where("id is not null and parent is not null").distinct())
    seen = cut(roots.select(F.col("id").alias("root"), "id").distinct())
    front = seen
    while True:  # every round finds new descendants or ends it
        nxt = front.join(e.select(F.col("id").alias("child"), F.col("parent").alias("id")), "id").select("root", F.col("child").alias("id")).distinct()
        front = cut(nxt.join(seen, ["root", "id"], "left_anti"))
        if not front.limit(1).count():
            break
        seen = cut(seen.unionByName(front))
    return seen


def without(tables: dict[str, DataFrame], family: DataFrame) -> dict[str, DataFrame]:
    """Every table without the rows of the documents in ``family`` (id)."""
    ids = family.select(F.col("id").alias("doc_id")).distinct()
    return {n: t.join(ids, "doc_id", "left_anti") if "doc_id" in t.columns else t for n, t in tables.items()}


def replace(tables: dict[str, DataFrame], family: DataFrame, new: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The tables with a family of documents exchanged for new rows."""
    kept = without(tables, family)
    return {n: t.unionByName(new[n], allowMissingColumns=True) if n in new else t for n, t in kept.items()}


def file_index(docs: DataFrame) -> DataFrame:
    """``path`` to ``doc_id``: whole paths, and base names where only one document has them."""
    d = docs.where("source_path is not null").select("doc_id", F.col("source_path").alias("path"), F.regexp_extract("source_path", r"([^/\\]+)$", 1).alias("base"))
    alias = d.groupBy("base").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("doc_id")).where("n = 1").select(F.col("base").alias("path"), "doc_id")
    return d.select("path", "doc_id").unionByName(alias).distinct()


def latest_outcomes(outcomes: DataFrame, order: str = "outcome_id") -> DataFrame:
    """One outcome per file: a success clears failures; among equals the last."""
    rank = F.struct((F.col("status") == "parsed").cast("int").alias("a"), F.col(order).alias("b"))
    rest = [c for c in outcomes.columns if c != "source_path"]
    return outcomes.where("source_path is not null").groupBy("source_path").agg(F.max_by(F.struct(*rest), rank).alias("r")).select("source_path", "r.*")


def counters(outcomes: DataFrame) -> DataFrame:
    """Corpus counters in one row."""
    return outcomes.agg(
        F.count(F.lit(1)).alias("files"), F.count_if(F.col("status") == "parsed").alias("parsed"), F.count_if(F.col("status") == "parse_failed").alias("failed"),
        F.coalesce(F.sum("scanned_pages_total"), F.lit(0)).alias("scanned_pages"), F.coalesce(F.sum("scanned_pages_untranscribed"), F.lit(0)).alias("untranscribed_pages"), F.count_distinct("doc_id").alias("documents"),
    )


def merge_transcriptions(pages: DataFrame, got: DataFrame) -> DataFrame:
    """Page texts with transcriptions in place of scans; an empty transcription is a failure and leaves the page as it was."""
    g = got.select("doc_id", "page", F.col("text").alias("_t"))
    ok = F.length(F.trim(F.coalesce("_t", F.lit("")))) > 0
    j = pages.join(g, ["doc_id", "page"], "left")
    return j.select("doc_id", "page", F.when(ok, F.col("_t")).otherwise(F.col("text")).alias("text"), F.when(ok, "transcribed").when(F.col("_t").isNotNull(), "failed").otherwise("kept").alias("outcome"))


def dangling(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    """Rows whose key the parent table lacks: empty for a sound corpus."""
    return child.where(F.col(key).isNotNull()).join(parent.select(key).distinct(), key, "left_anti")


def rowset_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of one set only, with multiplicity, and whose they are."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def order_diff(a: DataFrame, b: DataFrame, index: str) -> DataFrame:
    """Positions at which two ordered results differ."""
    rest = [c for c in a.columns if c != index]
    x = a.select(index, F.struct(*rest).alias("_a"))
    y = b.select(index, F.struct(*rest).alias("_b"))
    return x.join(y, index, "full").where(~F.col("_a").eqNullSafe(F.col("_b"))).select(index)


class Corpus:
    """The versions of a corpus folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._fs = jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._p = lambda x: jvm.org.apache.hadoop.fs.Path(x)

    def versions(self) -> list[int]:
        if not self._fs.exists(self._p(self.path)):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._p(self.path))]
        return sorted(int(n[2:]) for n in names if n.startswith("v=") and n[2:].isdigit())

    def current(self) -> int | None:
        return next((v for v in reversed(self.versions()) if self._fs.exists(self._p(f"{self.path}/v={v}/_PARTS"))), None)

    def parts(self, version: int | None = None) -> dict[str, list[str]]:
        """The folders of each table of a version."""
        v = self.current() if version is None else version
        if v is None or not self._fs.exists(self._p(f"{self.path}/v={v}/_PARTS")):
            raise FileNotFoundError(f"no published version in {self.path}" if version is None else f"version {version} isn't published")
        stream = self._fs.open(self._p(f"{self.path}/v={v}/_PARTS"))
        try:
            said = json.loads(bytes(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
        finally:
            stream.close()
        if said["format"] != FORMAT:
            raise ValueError(f"format {said['format']} of {self.path} isn't {FORMAT}: migrate it")
        return said["tables"]

    def _write(self, tables: dict[str, DataFrame], kept: dict[str, list[str]], before: bool) -> int:
        v = max([*self.versions(), 0]) + 1
        names = {n: list(p) for n, p in kept.items()}
        for name, df in tables.items():
            df.write.mode("error").parquet(f"{self.path}/v={v}/{name}")
            names[name] = [*(names.get(name, []) if before else []), f"v={v}/{name}"]
        aside = self._p(f"{self.path}/v={v}/_PARTS.{uuid.uuid4().hex}")
        out = self._fs.create(aside, False)
        out.write(bytearray(json.dumps({"format": FORMAT, "tables": names}).encode()))
        out.close()
        if self._fs.exists(self._p(f"{self.path}/v={v}/_PARTS")) or not self._fs.rename(aside, self._p(f"{self.path}/v={v}/_PARTS")):
            raise RuntimeError(f"version {v} of {self.path} was published by another writer")
        return v

    def publish(self, tables: dict[str, DataFrame], keep: bool = False) -> int:
        """A version of these tables whole; with ``keep`` the others stay as they were. Raises where a write fails, leaving the published version."""
        old = self.parts() if keep and self.current() is not None else {}
        return self._write(tables, {n: p for n, p in old.items() if n not in tables}, before=False)

    def append(self, tables: dict[str, DataFrame]) -> int:
        """A version with new rows for these tables; only they are written."""
        return self._write(tables, self.parts() if self.current() is not None else {}, before=True)

    def compact(self) -> int:
        """A version with one part for each table that has several."""
        return self.publish({n: self.table(n) for n, p in self.parts().items() if len(p) > 1}, keep=True)

    def table(self, name: str, version: int | None = None) -> DataFrame:
        parts = self.parts(version)
        if name not in parts:
            raise KeyError(f"{self.path} has no table {name}")
        return self.spark.read.option("mergeSchema", str(len(parts[name]) > 1).lower()).parquet(*[f"{self.path}/{p}" for p in parts[name]])

    def migrate(self, change: dict, names: Iterable[str] = ()) -> int:
        """A new version with the changed tables rewritten by their functions and the others as they were."""
        return self.publish({n: f(self.table(n)) for n, f in change.items()}, keep=True)


def export(df: DataFrame, path: str, kind: str = "csv") -> None:
    """Rows as CSV, JSON or Parquet files, one per partition; nested columns go into CSV as JSON text."""
    if kind not in ("csv", "json", "parquet"):
        raise ValueError("kind must be csv, json or parquet")
    if kind == "csv":
        nested = [f.name for f in df.schema.fields if f.dataType.typeName() in ("array", "map", "struct")]
        df = df.withColumns({c: F.to_json(c) for c in nested}) if nested else df
        df.write.option("header", "true").option("escape", '"').csv(path)
    else:
        getattr(df.write, kind)(path)
