"""A table of committed batches behind a manifest.

Every batch is a folder of its own; a manifest names the folders that count.
It is written last and as one small file, so a reader sees a batch whole or not
at all, and a batch that is repeated after a failure is either unknown, and
written again, or known, and left alone.

Folders merge by size: as soon as ``fanout`` of one tier are there, one folder
of the next tier takes their place.  A row is rewritten once per tier, and the
manifest names at most ``fanout`` folders a tier, so listing and rewriting per
batch do not grow with the number of batches.  Replaced folders stay until
``KEEP`` more manifests are written, for readers that still use them.

One writer at a time, as a stream's batches are.
"""

import json
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voltrail.sources.tables import folder_system, list_files, list_folders, read_text, remove_folders, write_text

FANOUT = 8
#: Folders are named like partitions, so that real ones may lie below them.
FOLDER = "_folder"
#: Manifests that stay readable.
KEEP = 4


@dataclass(frozen=True)
class Entry:
    """A folder that counts: its batches, rows, tier, and what was observed."""

    folder: str
    first: int
    last: int
    rows: int
    tier: int = 0
    facts: dict = field(default_factory=dict)


@dataclass(frozen=True)
class Manifest:
    version: int = 0
    last: int = -1
    schema: str | None = None
    entries: tuple[Entry, ...] = ()
    retired: tuple[tuple[int, str], ...] = ()  # version that dropped it, folder

    def text(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def of(cls, text: str) -> "Manifest":
        found = json.loads(text)
        entries = tuple(Entry(**e) for e in found.pop("entries"))
        return cls(**{**found, "entries": entries, "retired": tuple(map(tuple, found["retired"]))})


class BatchLog:
    """``merge`` is applied to the rows of folders that are merged, and to all
    rows on reading: give the function that keeps the latest copy to hold a
    table of latest copies.  ``facts`` are aggregates kept per folder, under
    names starting with ``min_``, ``max_`` or ``sum_``."""

    def __init__(
        self,
        spark: SparkSession,
        root: str,
        partition_by: tuple[str, ...] = (),
        merge: Callable[[DataFrame], DataFrame] | None = None,
        facts: dict[str, Column] | None = None,
        fanout: int = FANOUT,
    ):
        if fanout < 2:
            raise ValueError("at least two folders make a merge")
        self.spark, self.root, self.partition_by = spark, root, tuple(partition_by)
        self.merge, self.facts, self.fanout = merge, facts or {}, fanout

    # --- manifests

    def manifest(self) -> Manifest:
        """The newest manifest that is whole."""
        for name in sorted(list_files(self.spark, f"{self.root}/log"), reverse=True):
            try:
                return Manifest.of(read_text(self.spark, f"{self.root}/log/{name}"))
            except ValueError:
                continue  # cut off while it was written
        return Manifest()

    def _next(self) -> int:
        """A version no file has, a cut one included."""
        return 1 + max(map(int, list_files(self.spark, f"{self.root}/log")), default=0)

    def _publish(self, new: Manifest) -> None:
        log = f"{self.root}/log"
        write_text(self.spark, f"{log}/{new.version:020d}", new.text())
        _, system = folder_system(self.spark, log)
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        for name in sorted(list_files(self.spark, log))[:-KEEP]:
            system.delete(path(f"{log}/{name}"), False)

    # --- writing

    def _write(self, rows: DataFrame, first: int, last: int, tier: int) -> Entry | None:
        seen = Observation()
        folder = f"{FOLDER}={first:012d}-{last:012d}-{uuid.uuid4().hex}"
        spread = rows.hint("rebalance", *self.partition_by) if self.partition_by else rows
        counted = spread.observe(seen, F.count(F.lit(1)).alias("rows"), *[c.alias(n) for n, c in self.facts.items()])
        counted.write.partitionBy(*self.partition_by).parquet(f"{self.root}/data/{folder}")
        facts = dict(seen.get)
        return Entry(folder, first, last, n, tier, facts) if (n := facts.pop("rows")) else None

    def commit(self, rows: DataFrame, batch: int, **about) -> bool:
        """Add a batch, once; False if it is known already.

        Batches come in rising order, as a stream numbers them.  ``about`` is
        noted with the batch's folder.
        """
        now = self.manifest()
        if batch <= now.last:
            return False
        entry = self._write(self.merge(rows) if self.merge else rows, batch, batch, 0)
        entry = entry and replace(entry, facts={**entry.facts, **about})
        schema = self._widened(now.schema, rows.schema)
        entries = (*now.entries, *([entry] if entry else []))
        self._publish(self._swept(replace(now, version=self._next(), last=batch, schema=schema, entries=entries)))
        self._compact()
        return True

    def _compact(self) -> None:
        """Merge the folders of every tier that is full."""
        while full := self._full(now := self.manifest()):
            rows = self._of(now, full)
            merged = self._write(
                self.merge(rows) if self.merge else rows, full[0].first, full[-1].last, full[0].tier + 1
            )
            kept = [e for e in now.entries if e not in full] + ([merged] if merged else [])
            version = self._next()
            dropped = tuple((version, e.folder) for e in full)
            entries = tuple(sorted(kept, key=lambda e: e.first))
            new = replace(now, version=version, entries=entries, retired=(*now.retired, *dropped))
            self._publish(self._swept(new))

    def _full(self, now: Manifest) -> list[Entry]:
        for tier in sorted({e.tier for e in now.entries}):
            own = [e for e in now.entries if e.tier == tier]
            if len(own) >= self.fanout:
                return own[: self.fanout]
        return []

    def _swept(self, new: Manifest) -> Manifest:
        """Remove folders that no manifest still kept names."""
        old = [f for v, f in new.retired if v <= new.version - KEEP]
        remove_folders(self.spark, f"{self.root}/data", old)
        return replace(new, retired=tuple((v, f) for v, f in new.retired if v > new.version - KEEP))

    def remove_orphans(self) -> list[str]:
        """Remove folders of writes that failed before their manifest.  Run it
        while nothing writes."""
        now = self.manifest()
        known = {e.folder for e in now.entries} | {f for _, f in now.retired}
        found = [f for f in list_folders(self.spark, f"{self.root}/data") if f not in known]
        remove_folders(self.spark, f"{self.root}/data", found)
        return found

    @staticmethod
    def _widened(old: str | None, new: T.StructType) -> str:
        known = T.StructType.fromJson(json.loads(old)) if old else T.StructType()
        more = [f for f in new.fields if f.name not in known.fieldNames()]
        return T.StructType([*known.fields, *more]).json()

    # --- reading

    def _of(self, now: Manifest, entries) -> DataFrame:
        schema = T.StructType.fromJson(json.loads(now.schema)) if now.schema else T.StructType()
        if not entries:
            return self.spark.createDataFrame([], schema)
        data = f"{self.root}/data"
        reader = self.spark.read.schema(schema).option("basePath", data)
        return reader.parquet(*[f"{data}/{e.folder}" for e in entries]).drop(FOLDER)

    def read(self, where: Column | None = None) -> DataFrame:
        """The rows of all committed batches; ``where`` may only look at what
        copies of a row have in common."""
        now = self.manifest()
        rows = self._of(now, now.entries)
        rows = rows if where is None else rows.filter(where)
        return self.merge(rows) if self.merge and len(now.entries) > 1 else rows
