"""Versioned chunk tables: build aside, check, publish by compare-and-set, read under a lease, clear what nobody holds.

Everything lies under one base folder of the shared file system:

- ``version=V``: the chunks of a version, never rewritten; ``postings/V`` its inverted index; ``vectors/version=V/batch=i`` its vectors
- ``commits/N``: the N-th publication; its file is created exclusively, so of two builders that began after the same
  publication one wins and the other's version is marked as failed
- ``marks/V/STATE``: building (with an expiry), failed, retired
- ``leases/V/ID``: a reader, with an expiry

Coordination files number as many as versions, batches and readers, not as rows, and are the only thing the driver lists.
"""

from __future__ import annotations

import hashlib
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import content_hash, normalize_text, utf16_length
from ..functions.vectors import DIMS, Embedder, embed, embed_texts
from ..operators.chunks import Sizes, chunk_documents
from . import commits
from .postings import Postings, build_postings

BUILD_SECONDS, LEASE_SECONDS, KEPT = 6 * 3600, 600, 2


class IndexFailed(RuntimeError):
    """A built version did not pass its checks, or another one was published first."""


class IndexStale(RuntimeError):
    """The version that vectors are appended to is no longer the current one, or its documents have changed."""


def fingerprint(sizes: Sizes) -> str:
    return hashlib.sha256(f"range-v1:{sizes.target}:{sizes.whole}:{sizes.overlap}".encode()).hexdigest()


class IndexStore:
    def __init__(self, spark: SparkSession, base: str) -> None:
        self.spark, self.base = spark, base.rstrip("/")

    # Publications

    def history(self) -> list[dict]:
        """Publications in their order; one that is still being written is not among them."""
        found = (commits.read(self.spark, f"{self.base}/commits/{n}") for n in commits.names(self.spark, f"{self.base}/commits"))
        return [c for c in found if c is not None]

    def current(self) -> str | None:
        past = self.history()
        return past[-1]["version"] if past else None

    def _mark(self, version: str, state: str, **body) -> bool:
        return commits.create_new(self.spark, f"{self.base}/marks/{version}/{state}", {"at": time.time(), **body})

    def state(self, version: str) -> str:
        """retired, published, failed or building."""
        marks = commits.names(self.spark, f"{self.base}/marks/{version}")
        if "retired" in marks:
            return "retired"
        if any(c["version"] == version for c in self.history()):
            return "published"
        return "failed" if "failed" in marks else "building"

    def begin(self, seconds: float = BUILD_SECONDS) -> tuple[str, int]:
        """A new version in state building, and the number its publication must get."""
        number = len(commits.names(self.spark, f"{self.base}/commits"))
        version = f"v{time.time_ns()}-{uuid.uuid4().hex[:8]}"
        self._mark(version, "building", expires=time.time() + seconds)
        return version, number

    def publish(self, version: str, number: int, **body) -> None:
        """Make ``version`` the current one, unless the place ``number`` is taken or the version has been given up."""
        if "failed" in commits.names(self.spark, f"{self.base}/marks/{version}"):
            raise IndexFailed(f"{version} has been given up")
        if not commits.create_new(self.spark, f"{self.base}/commits/{number:012d}", {"version": version, "at": time.time(), **body}):
            self._mark(version, "failed", reason="another version was published first")
            raise IndexFailed(f"{version}: another version was published first")

    def recover(self, now: float | None = None) -> list[str]:
        """Mark versions as failed whose builder has not published them before their expiry; their names."""
        now, published, lost = now or time.time(), {c["version"] for c in self.history()}, []
        for v in commits.names(self.spark, f"{self.base}/marks"):
            marks = commits.names(self.spark, f"{self.base}/marks/{v}")
            begun = commits.read(self.spark, f"{self.base}/marks/{v}/building") or {"expires": 0}
            if v not in published and not {"failed", "retired"} & set(marks) and begun["expires"] < now and self._mark(v, "failed", reason="the builder did not finish"):
                lost.append(v)
        return lost

    def build(self, docs: DataFrame, sizes: Sizes = Sizes()) -> str:  # noqa: B008
        """A new version from ``docs`` (doc_id, text): written, checked against its documents, indexed, published."""
        version, number = self.begin()
        try:
            n = self._write(docs, sizes, version)
        except BaseException as e:
            self._mark(version, "failed", reason=str(e)[:500])
            raise
        self.publish(version, number, n_chunks=n, fingerprint=fingerprint(sizes))
        return version

    def _write(self, docs: DataFrame, sizes: Sizes, version: str) -> int:
        path = f"{self.base}/version={version}"
        hashes = docs.select(F.col("doc_id").alias("_d"), content_hash(F.col("text")).alias("content_hash"))
        chunk_documents(docs, sizes).join(hashes, F.col("doc_id") == F.col("_d")).drop("_d").write.parquet(path)
        chunks = self.spark.read.parquet(path)
        n = chunks.count()
        wrong = chunks.filter((utf16_length(F.col("text")) != F.col("end") - F.col("start")) | (F.col("start") < 0)).count()
        repeated = chunks.groupBy("doc_id", "chunk_index").count().filter("count > 1").count()
        missing = docs.filter(F.length(F.trim(normalize_text(F.col("text")))) > 0).join(chunks.select("doc_id").distinct(), "doc_id", "left_anti").filter(F.col("text").rlike(r"[^\s\x0b]")).count()
        if wrong or repeated or missing:
            raise IndexFailed(f"{wrong} chunks off their range, {repeated} repeated positions, {missing} documents without chunks")
        build_postings(chunks.select(F.struct("doc_id", "chunk_index").alias("doc_id"), "text"), f"{self.base}/postings/{version}")
        return n

    # Reading

    def read(self, version: str | None = None) -> DataFrame:
        """The chunks of a version, the current one by default."""
        version = version or self.current()
        if version is None or self.state(version) == "retired":
            raise LookupError("INDEX_UNAVAILABLE")
        return self.spark.read.parquet(f"{self.base}/version={version}")

    def search(self, queries: DataFrame, k: int = 10, version: str | None = None) -> DataFrame:
        """query_id, doc_id, chunk_index, score and rank of the ``k`` best chunks of each query (query_id, text), from the stored postings."""
        version = version or self.current()
        if version is None or self.state(version) == "retired":
            raise LookupError("INDEX_UNAVAILABLE")
        hits = Postings(self.spark, f"{self.base}/postings/{version}").search(queries, k)
        return hits.select("query_id", "doc_id.doc_id", "doc_id.chunk_index", "score", "rank")

    def stale(self, docs: DataFrame, version: str | None = None) -> DataFrame:
        """doc_ids whose text has changed since a version, or is not in it."""
        now = docs.select("doc_id", content_hash(F.col("text")).alias("now"))
        then = self.read(version).select("doc_id", "content_hash").distinct()
        return now.join(then, "doc_id", "left").filter(~F.col("now").eqNullSafe(F.col("content_hash"))).select("doc_id")

    @contextmanager
    def lease(self, version: str | None = None, seconds: float = LEASE_SECONDS) -> Iterator[str]:
        """A version that ``clear`` leaves alone until the block ends or the lease expires; yields its name."""
        version = version or self.current()
        if version is None:
            raise LookupError("INDEX_UNAVAILABLE")
        path = f"{self.base}/leases/{version}/{uuid.uuid4().hex}"
        commits.create_new(self.spark, path, {"expires": time.time() + seconds})
        try:
            # The lease is written before the mark is looked for, and clear looks for leases after it marks: one sees the other.
            if self.state(version) in ("retired", "failed"):
                raise LookupError("INDEX_UNAVAILABLE")
            yield version
        finally:
            commits.remove(self.spark, path)

    def _held(self, version: str, now: float) -> bool:
        folder = f"{self.base}/leases/{version}"
        held = (commits.read(self.spark, f"{folder}/{n}") for n in commits.names(self.spark, folder))
        return any(h is not None and h["expires"] > now for h in held)

    def retired(self, now: float | None = None) -> list[str]:
        """Versions that nothing keeps: all but the current and the previous one, those being built and those under a lease."""
        now, published = now or time.time(), [c["version"] for c in self.history()]
        every = commits.names(self.spark, f"{self.base}/marks")
        keep = set(published[-KEPT:]) | {v for v in every if v not in published and "failed" not in commits.names(self.spark, f"{self.base}/marks/{v}")}
        return [v for v in every if v not in keep and not self._held(v, now)]

    def clear(self, now: float | None = None) -> list[str]:
        """Remove the tables of the retired versions; what a reader took meanwhile is left for the next time.  Marks and commits stay."""
        now, gone = now or time.time(), []
        for v in self.retired(now):
            self._mark(v, "retired")
            if self._held(v, now):
                continue
            for path in (f"version={v}", f"postings/{v}", f"vectors/version={v}"):
                commits.remove(self.spark, f"{self.base}/{path}")
            gone.append(v)
        return gone

    # Vectors

    def append_vectors(self, docs: DataFrame, n_batches: int = 16, dims: int = DIMS, embedder: Embedder = embed, version: str | None = None, model: str = "local") -> int:
        """Embed the chunks of a version batch by batch; returns the number of batches done by this call.

        A chunk's batch is a hash of its place, so a second call, in any process, makes the same batches and
        does those that have no commit.  Before each commit the version must still be the current one and ``docs``
        still what it was built from; otherwise IndexStale, and the batches so far stay.  A batch whose writer died
        has no commit: its files are not read, and are overwritten.
        """
        version = version or self.current()
        plan = f"{self.base}/vector-commits/{version}/plan"
        mine = {"batches": n_batches, "dims": dims, "model": model}
        if not commits.create_new(self.spark, plan, mine) and (told := commits.read(self.spark, plan)) != mine:
            raise ValueError(f"the version's vectors were begun as {told}")
        chunks, done = self.read(version), 0
        part = F.pmod(F.xxhash64("doc_id", "chunk_index"), F.lit(n_batches))
        for i in range(n_batches):
            if commits.read(self.spark, f"{self.base}/vector-commits/{version}/{i:06d}") is not None:
                continue
            attempt = uuid.uuid4().hex[:12]
            rows = embed_texts(chunks.filter(part == i).select(F.struct("doc_id", "chunk_index").alias("doc_id"), "text"), dims, embedder)
            rows.select("doc_id.doc_id", "doc_id.chunk_index", "embedding").write.parquet(f"{self.base}/vectors/version={version}/batch={i}-{attempt}")
            if self.current() != version or not self.stale(docs, version).isEmpty():
                raise IndexStale(f"{version} is no longer what its documents are")
            done += commits.create_new(self.spark, f"{self.base}/vector-commits/{version}/{i:06d}", {"folder": f"batch={i}-{attempt}"})
        return done

    def vectors(self, version: str | None = None) -> DataFrame:
        """doc_id, chunk_index and embedding of the committed batches of a version."""
        version = version or self.current()
        folder = f"{self.base}/vector-commits/{version}"
        done = [commits.read(self.spark, f"{folder}/{n}") for n in commits.names(self.spark, folder) if n != "plan"]
        paths = [f"{self.base}/vectors/version={version}/{c['folder']}" for c in done if c is not None]
        if not paths:
            raise LookupError("VECTORS_UNAVAILABLE")
        return self.spark.read.parquet(*paths).select("doc_id", "chunk_index", "embedding")
