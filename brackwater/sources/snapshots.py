"""Backups of a store: full and differential snapshots, restoring and pruning.

Tables are immutable folders, so a snapshot is the list of them. A full one copies
every folder; a differential copies those that its full parent hasn't.
"""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brackwater.sources.store import Store


def prune_plan(records: DataFrame, keep: int) -> DataFrame:
    """(id, kind, parent, kept) of backup records (id, kind, created_at, parent): the newest ``keep`` fulls stay with their differentials."""
    fulls = records.where("kind = 'full'").orderBy(F.col("created_at").desc(), F.col("id").desc()).limit(keep).select(F.col("id").alias("full_id"))
    owner = F.when(F.col("kind") == "full", F.col("id")).otherwise(F.col("parent"))
    return records.withColumn("owner", owner).join(F.broadcast(fulls), F.col("owner") == F.col("full_id"), "left").select("id", "kind", "parent", F.col("full_id").isNotNull().alias("kept"))


def want_full(count: int, full_every: int) -> bool:
    """Whether the count-th scheduled backup, from 1, is a full one."""
    return full_every <= 1 or count % full_every == 1


def kind_of_backup(count: Column, full_every: int) -> Column:
    """want_full() of a column, by the names of the kinds."""
    return F.when(F.lit(full_every <= 1) | (count % max(full_every, 1) == 1), "full").otherwise("differential")


class Snapshots:
    """The backups of a store in a folder of their own."""

    def __init__(self, store: Store, folder: str):
        self.store, self.folder, self.files = store, folder.rstrip("/"), store.files

    def list(self) -> list[dict]:
        """Records, oldest first."""
        if "catalog.json" not in self.files.names(self.folder):
            return []
        return json.loads(self.files.read(f"{self.folder}/catalog.json"))

    def _save(self, records: list[dict]) -> None:
        self.files.create(f"{self.folder}/catalog.json", json.dumps(records), overwrite=True)

    def _take(self, kind: str, created_at: int, parent: dict | None) -> dict:
        have = {tuple(p) for parts in (parent or {}).get("saved", {}).values() for p in parts}
        record_id = f"{created_at:015d}-{len(self.list()):03d}-{kind}"
        saved, copied = {}, 0
        for name, parts in self.store.manifest().items():
            saved[name] = []
            for path, domain in parts:
                folder = path.rsplit("/", 1)[1]
                known = next((p for p in have if p[0].rsplit("/", 1)[1] == folder), None)
                if known is None:
                    to = f"{self.folder}/{record_id}/{name}/{folder}"
                    self.store.spark.read.parquet(path).write.parquet(to)
                    copied += self.files.size(to)
                else:
                    to = known[0]
                saved[name].append([to, domain])
        record = {"id": record_id, "kind": kind, "created_at": created_at, "parent": parent and parent["id"], "bytes": copied, "saved": saved}
        self._save([*self.list(), record])
        return record

    def full(self, created_at: int) -> dict:
        """Copy all."""
        return self._take("full", created_at, None)

    def differential(self, created_at: int) -> dict:
        """Copy what the last full snapshot hasn't; there has to be one."""
        fulls = [r for r in self.list() if r["kind"] == "full"]
        if not fulls:
            raise ValueError("no full backup to compare with; take a full one first")
        return self._take("differential", created_at, fulls[-1])

    def restore(self, record_id: str) -> int:
        """Make a snapshot's tables the next version; the version."""
        record = next((r for r in self.list() if r["id"] == record_id), None)
        if record is None:
            raise KeyError(record_id)
        base = self.store.version()
        self.store.publish(record["saved"], base)
        return base + 1

    def prune(self, keep: int) -> int:
        """Drop all but the newest ``keep`` fulls and their differentials; how many went."""
        records = self.list()
        fulls = [r["id"] for r in records if r["kind"] == "full"]
        doomed = set(fulls[: max(0, len(fulls) - keep)])
        gone = [r for r in records if r["id"] in doomed or r["parent"] in doomed]
        self._save([r for r in records if r not in gone])
        for r in gone:
            self.files.delete(f"{self.folder}/{r['id']}")
        return len(gone)

    def manifests(self) -> Iterable[dict]:
        """What vacuum() has to spare."""
        return [r["saved"] for r in self.list()]
