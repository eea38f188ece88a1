"""A live mirror on plain parquet: current rows, kept up by batches of changes, as a log-structured table.

A batch is written as one more *run*: its newest change per key, sorted by key. Nothing older is read or rewritten,
so a batch costs what it holds. A manifest per version names the runs that make up the table; readers fold these, so a
batch is visible as a whole or not at all. When small runs have gathered, they are folded into one: a run takes part
once those smaller than it hold ``growth`` times its rows together. Sizes therefore stay in a geometric row, a
table of N rows has some log N runs, and a row is rewritten some log N times.

Folding takes the newest change per key in whatever order runs came, so repeated batches, replays through a new
checkpoint and late changes are safe, and tombstones keep deleted keys deleted. Two writers may work at once: a version
is created exclusively, and who comes second adds its run to what the first has published. A compaction that
finds one of its inputs gone is given up; another has done that work.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.operators.state import ORDER, latest_change
from tidelog.sinks.store import Store


@dataclass(frozen=True)
class Run:
    folder: str
    rows: int


@dataclass
class Mirror:
    spark: SparkSession
    path: str
    keys: list[str]
    schema: T.StructType
    order: tuple[str, ...] = tuple(ORDER)
    growth: float = 1.0
    most_small: int = 4

    @property
    def _store(self) -> Store:
        return Store(self.spark, self.path)

    # -- reading -----------------------------------------------------------

    def _versions(self) -> list[int]:
        return sorted(int(n.removesuffix(".json")) for n in self._store.names("manifest") if n[0] != ".")

    def version(self) -> int:
        """Newest complete batch or compaction, -1 before the first."""
        return max(self._versions(), default=-1)

    def runs(self, version: int | None = None) -> list[Run]:
        """Runs of a version, the newest by default. Some log N of them."""
        version = self.version() if version is None else version
        return [] if version < 0 else [Run(**r) for r in json.loads(self._store.read(f"manifest/{version:012d}.json"))["runs"]]

    def _read(self, runs: list[Run]) -> DataFrame:
        """Newest change per key of some runs. One run has each key once."""
        if not runs:
            return self.spark.createDataFrame([], self.schema)
        rows = self.spark.read.schema(self.schema).parquet(*[f"{self.path}/data/{r.folder}" for r in runs])
        return rows if len(runs) == 1 else latest_change(rows, self.keys, list(self.order))

    def state(self, tombstones: bool = False) -> DataFrame:
        rows = self._read(self.runs())
        return rows if tombstones else rows.where("is_deleted = 0")

    # -- writing -----------------------------------------------------------

    def _write(self, rows: DataFrame) -> Run:
        """A run of rows with one per key. The window that made them so has sorted them by key."""
        folder, seen = f"run-{uuid.uuid4().hex}", Observation()
        rows.observe(seen, F.count(F.lit(1)).alias("rows")).write.parquet(f"{self.path}/data/{folder}")
        return Run(folder, seen.get["rows"])

    def _publish(self, added: Run, replaced: list[Run]) -> bool:
        """Make the next version; False if a run to be replaced is no longer there."""
        while True:
            version = self.version()
            runs = self.runs(version)
            if not set(replaced) <= set(runs):
                return False
            entries = [vars(r) for r in [*[r for r in runs if r not in replaced], added]]
            if self._store.create(f"manifest/{version + 1:012d}.json", json.dumps({"runs": entries})):
                return True

    def apply(self, changes: DataFrame) -> None:
        """Add one batch. One shuffle: each task ships its newest row per key."""
        newest = latest_change(changes.select(*self.schema.fieldNames()), self.keys, list(self.order))
        self._publish(self._write(newest), [])

    def compact(self, whole: bool = False) -> bool:
        """Fold the small runs into one, if there are enough of them (``whole``: all runs); True if that was done."""
        runs = sorted(self.runs(), key=lambda r: r.rows)
        due = len(runs) if whole else 0
        smaller = sum(r.rows for r in runs)
        for n in range(len(runs), self.most_small - 1, -1):
            smaller -= runs[n - 1].rows
            if not due and runs[n - 1].rows <= self.growth * smaller:
                due = n
        if due < 2:
            return False
        return self._publish(self._write(self._read(runs[:due])), runs[:due])

    def vacuum(self, keep: int = 2, orphans_after_hours: float | None = None) -> int:
        """Delete all manifests but the newest ``keep``, and the runs that only those named.

        What a writer has not published yet is in no manifest and stays. Runs of writers that died are
        deleted if they are in no manifest and older than ``orphans_after_hours``.
        """
        versions, store = self._versions(), self._store
        dropped, kept = versions[:-keep], versions[-keep:]
        used = {r.folder for v in kept for r in self.runs(v)}
        gone = {r.folder for v in dropped for r in self.runs(v)} - used
        if orphans_after_hours is not None:
            others = (n for n in store.names("data") if n not in used | gone)
            gone |= {n for n in others if store.age_seconds(f"data/{n}") > 3600 * orphans_after_hours}
        for folder in gone:
            store.delete(f"data/{folder}")
        for v in dropped:
            store.delete(f"manifest/{v:012d}.json")
        return len(dropped)
