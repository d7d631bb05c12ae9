"""Versioned tables: immutable Parquet folders and a manifest that says which are current.

A commit writes the changed tables to new folders and then one manifest, by creating a
file that must not exist yet; so readers see all of a change or none, and two writers
can't both make the same version. Chunks, embeddings and documents are partitioned by
domain, and a change rewrites the domains it touches.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brackwater.functions.crypto import opened, sealed
from brackwater.schema import SEALED, TABLES

PARTITIONED = ("documents", "chunks", "embeddings")


class Conflict(RuntimeError):
    """Another writer committed first."""


class Files:
    """Small files through Hadoop's file systems, so a store may lie on any of them."""

    def __init__(self, spark: SparkSession):
        self.jvm, self.conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, path: str):
        p = self.jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.conf), p

    def names(self, path: str) -> list[str]:
        fs, p = self._at(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def read(self, path: str) -> str:
        fs, p = self._at(path)
        stream = fs.open(p)
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, path: str, text: str, overwrite: bool = False) -> None:
        fs, p = self._at(path)
        if not overwrite and fs.exists(p):
            raise Conflict(path)
        stream = fs.create(p, overwrite)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def create_whole(self, path: str, text: str) -> None:
        """Write beside it and rename to it, which fails if it exists."""
        fs, p = self._at(path)
        beside = path + "." + uuid.uuid4().hex
        self.create(beside, text)
        if fs.exists(p) or not fs.rename(self._at(beside)[1], p):
            fs.delete(self._at(beside)[1], False)
            raise Conflict(path)

    def delete(self, path: str) -> None:
        fs, p = self._at(path)
        fs.delete(p, True)

    def size(self, path: str) -> int:
        fs, p = self._at(path)
        return fs.getContentSummary(p).getLength() if fs.exists(p) else 0


class Store:
    """The tables of schema.TABLES under a root folder; with a key, names and texts lie there sealed."""

    def __init__(self, spark: SparkSession, root: str, key: bytes | None = None):
        self.spark, self.root, self.files, self.key = spark, root.rstrip("/"), Files(spark), key

    def version(self) -> int:
        """The current version; 0 before any commit."""
        names = [n for n in self.files.names(f"{self.root}/_versions") if n.endswith(".json")]
        return int(names[-1][:-5]) if names else 0

    def manifest(self, version: int | None = None) -> dict[str, list]:
        """table -> list of [folder, domain or null] of a version."""
        version = self.version() if version is None else version
        return json.loads(self.files.read(f"{self.root}/_versions/{version:012d}.json")) if version else {}

    def table(self, name: str, domain_ids: list[int] | None = None, version: int | None = None) -> DataFrame:
        """A table, of some domains only if they are given: then only their folders are read."""
        parts = self.manifest(version).get(name, [])
        if domain_ids is not None:
            parts = [p for p in parts if p[1] is None or p[1] in domain_ids]
        schema = TABLES[name]
        if not parts:
            return self.spark.createDataFrame([], schema)
        found = self.at(name, *(p[0] for p in parts))
        return found if domain_ids is None or "domain_id" not in schema.names else found.where(F.col("domain_id").isin(domain_ids))

    def at(self, name: str, *paths: str) -> DataFrame:
        """The rows of folders of a table."""
        found = self.spark.read.schema(TABLES[name]).parquet(*paths)
        return found.withColumns({c: opened(F.unbase64(c), self.key, f"{name}.{c}") for c in SEALED.get(name, ())}) if self.key else found

    def put(self, name: str, df: DataFrame, kind: str = "append") -> str:
        """Write rows as a folder of a table, which a commit may name later."""
        path = f"{self.root}/{name}/{uuid.uuid4().hex}-{kind}"
        df = df.select([F.col(f.name).cast(f.dataType) for f in TABLES[name].fields])
        if self.key:
            df = df.withColumns({c: F.base64(sealed(F.col(c), self.key, f"{name}.{c}")) for c in SEALED.get(name, ())})
        df.write.parquet(path)
        return path

    def commit(self, changes: dict[str, DataFrame | str], domain_id: int | None = None, appends: dict[str, DataFrame | str] | None = None, base: int | None = None) -> int:
        """Replace tables (for a domain, of partitioned tables that domain's part) and append to others, by rows or by folders that put() wrote; the new version."""
        base = self.version() if base is None else base
        now = self.manifest(base)
        for kind, tables in (("replace", changes), ("append", appends or {})):
            for name, df in tables.items():
                path = df if isinstance(df, str) else self.put(name, df, kind)
                part = [path, domain_id if name in PARTITIONED else None]
                kept = now.get(name, [])
                if kind == "replace":
                    kept = [p for p in kept if name in PARTITIONED and domain_id is not None and p[1] != domain_id]
                now[name] = [*kept, part]
        self.publish(now, base)
        return base + 1

    def rekey(self, key: bytes | None) -> int:
        """Write all tables again under another key, or under none; the new version, which alone it opens."""
        base, other, now = self.version(), Store(self.spark, self.root, key), {}
        for name, parts in self.manifest(base).items():
            now[name] = []
            for path, domain in parts:
                plain = Store(self.spark, self.root, self.key)
                plain.manifest = lambda version=None, name=name, path=path, domain=domain: {name: [[path, domain]]}
                to = f"{self.root}/{name}/{uuid.uuid4().hex}-rekey"
                df = plain.table(name)
                if key:
                    df = df.withColumns({c: F.base64(sealed(F.col(c), key, f"{name}.{c}")) for c in SEALED.get(name, ())})
                df.write.parquet(to)
                now[name].append([to, domain])
        other.publish(now, base)
        self.key = key
        return base + 1

    def publish(self, manifest: dict[str, list], base: int) -> None:
        """Make a manifest the version after base."""
        self.files.create_whole(f"{self.root}/_versions/{base + 1:012d}.json", json.dumps(manifest))

    def drop_domain(self, domain_id: int, others: dict[str, DataFrame]) -> int:
        """Forget the domain's parts and replace the other tables."""
        base = self.version()
        version = self.commit(others, base=base)
        now = self.manifest(version)
        for name in PARTITIONED:
            now[name] = [p for p in now.get(name, []) if p[1] != domain_id]
        self.publish(now, version)
        return version + 1

    def vacuum(self, keep: int = 1, also: list[dict] | None = None) -> list[str]:
        """Delete folders that neither the last ``keep`` versions nor the given manifests name."""
        last = self.version()
        manifests = [self.manifest(v) for v in range(max(1, last - keep + 1), last + 1)] + (also or [])
        used = {p[0].rsplit("/", 1)[1] for m in manifests for parts in m.values() for p in parts}
        gone = []
        for name in TABLES:
            for folder in self.files.names(f"{self.root}/{name}"):
                if folder not in used:
                    self.files.delete(f"{self.root}/{name}/{folder}")
                    gone.append(folder)
        return gone
