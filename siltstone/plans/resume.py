"""Stages that go on where a run ended: stored results with a commit marker and a fingerprint of all that made them.

A stage's fingerprint is made from its name, its version, its settings and the fingerprints of its inputs; a source's from
its files, their sizes and times. A result lies in a folder named by the fingerprint and counts once its marker is there,
which is written last. So a run that was killed repeats the stage it was in and no other; a changed setting, version or
source repeats that stage and those that depend on it. Results and markers lie in a store that all machines share.
"""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession

MARKER = "committed.json"


@dataclass(frozen=True)
class Stage:
    """``make`` gets its inputs by name and its settings, and returns a DataFrame; change ``version`` with its code."""

    name: str
    make: Callable[[dict[str, DataFrame], dict[str, Any]], DataFrame]
    inputs: tuple[str, ...] = ()
    settings: dict[str, Any] = field(default_factory=dict)
    version: int = 1


def _path(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def source_fingerprint(spark: SparkSession, path: str) -> str:
    """A digest of the files below a path: their names, sizes and times of change."""
    files, at = _path(spark, path)
    found, listed = [], files.listFiles(at, True)
    while listed.hasNext():
        s = listed.next()
        found.append((s.getPath().toString(), s.getLen(), s.getModificationTime()))
    return hashlib.sha256(json.dumps(sorted(found)).encode()).hexdigest()


class Run:
    """Runs stages in order over Parquet sources (name to path); events as in ``stages.run_stages``, and ``kept`` for a stored result."""

    def __init__(self, spark: SparkSession, root: str, sources: dict[str, str], on_event: Callable[[dict], None] = lambda e: None):
        self.spark, self.root, self.on_event = spark, root.rstrip("/"), on_event
        self.prints = {name: source_fingerprint(spark, path) for name, path in sources.items()}
        self.frames = {name: spark.read.parquet(path) for name, path in sources.items()}

    def fingerprint(self, stage: Stage) -> str:
        made_from = [stage.name, stage.version, stage.settings, [self.prints[i] for i in stage.inputs]]
        return hashlib.sha256(json.dumps(made_from, sort_keys=True).encode()).hexdigest()

    def marker(self, folder: str) -> dict | None:
        """What is said of a committed result."""
        files, at = _path(self.spark, f"{folder}/{MARKER}")
        if not files.exists(at):
            return None
        return json.loads(self.spark.read.text(f"{folder}/{MARKER}", wholetext=True).first().value)

    def _commit(self, folder: str, **said) -> None:
        files, at = _path(self.spark, f"{folder}/{MARKER}")
        out = files.create(at, True)
        try:
            out.write(bytearray(json.dumps(said).encode()))
        finally:
            out.close()

    def stage(self, stage: Stage) -> DataFrame:
        """The stage's stored result, made now if it is not there."""
        if unknown := [i for i in stage.inputs if i not in self.prints]:
            raise KeyError(f"{stage.name}: no stage or source before it is called {', '.join(unknown)}")
        print_ = self.fingerprint(stage)
        folder = f"{self.root}/{stage.name}-{print_[:16]}"
        if self.marker(folder) is not None:
            self.on_event({"event": "kept", "stage": stage.name})
        else:
            self.on_event({"event": "start", "stage": stage.name})
            began = time.perf_counter()
            try:
                made = stage.make({i: self.frames[i] for i in stage.inputs}, stage.settings)
                made.write.mode("overwrite").parquet(f"{folder}/rows")
                self._commit(folder, fingerprint=print_, settings=stage.settings, version=stage.version, seconds=round(time.perf_counter() - began, 2))
            except Exception as e:
                self.on_event({"event": "error", "stage": stage.name, "message": f"{type(e).__name__}: {e}"})
                raise
            self.on_event({"event": "done", "stage": stage.name, "seconds": round(time.perf_counter() - began, 2)})
        self.prints[stage.name], self.frames[stage.name] = print_, self.spark.read.parquet(f"{folder}/rows")
        return self.frames[stage.name]

    def all(self, stages: list[Stage]) -> dict[str, DataFrame]:
        out = {s.name: self.stage(s) for s in stages}
        self.on_event({"event": "finished"})
        return out
