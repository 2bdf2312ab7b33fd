"""Records beside a graph: JSON documents replaced as a whole, a log of progress, a write lock, kept facts and histories.

Everything is a small file on the file system Spark reaches; tables that grow with the input are Parquet.
"""

from __future__ import annotations

import json
import os
import time
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STALE_SECONDS = 300
MOST_FAILURES = 200


class Files:
    """Reading and replacing small files by way of Hadoop's file systems."""

    def __init__(self, spark: SparkSession):
        self.jvm, self.conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, path: str):
        p = self.jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.conf)

    def read(self, path: str) -> str | None:
        p, fs = self._at(path)
        if not fs.exists(p):
            return None
        stream = fs.open(p)
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, path: str, text: str) -> bool:
        """A new file; False if there is one. This is what a lock rests on."""
        p, fs = self._at(path)
        try:
            out = fs.create(p, False)
        except Exception:
            if fs.exists(p):
                return False
            raise
        out.write(bytearray(text.encode()))
        out.close()
        return True

    def replace(self, path: str, text: str) -> None:
        """Readers see the old text or the new one, never a part."""
        p, fs = self._at(path)
        fresh, _ = self._at(f"{path}.{uuid.uuid4().hex}")
        self.create(fresh.toString(), text)
        fs.delete(p, False)
        fs.rename(fresh, p)

    def delete(self, path: str) -> None:
        p, fs = self._at(path)
        fs.delete(p, True)

    def names(self, path: str) -> list[str]:
        p, fs = self._at(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


class Records:
    """The records of one graph's folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.files = spark, root.rstrip("/"), Files(spark)

    def write(self, name: str, value: dict) -> None:
        self.files.replace(f"{self.root}/{name}.json", json.dumps(value, sort_keys=True))

    def read(self, name: str) -> dict | None:
        text = self.files.read(f"{self.root}/{name}.json")
        return None if text is None else json.loads(text)

    # progress: the last state, and every event as a file of its own, so that writers never meet
    def report(self, run: str, event: str, phase: str, now: float | None = None, **more) -> None:
        at = time.time() if now is None else now
        row = {"runId": run, "event": event, "phase": phase, "timestamp": time.strftime("%Y-%m-%dT%H:%M:%S", time.gmtime(at)) + f".{int(at * 1000) % 1000:03d}Z", "pid": os.getpid(), **more}
        self.files.create(f"{self.root}/progress/{int(at * 1000):015d}-{uuid.uuid4().hex[:8]}.json", json.dumps(row))
        self.write("progress-state", row | {"at": at})

    def progress(self, now: float | None = None) -> dict | None:
        """The last state; ``stale`` if a run that hasn't ended gave no sign for five minutes."""
        row = self.read("progress-state")
        if row is None:
            return None
        late = (time.time() if now is None else now) - row["at"] > STALE_SECONDS
        return row | {"status": "ended" if row["event"] in ("completed", "failed") else "stale" if late else "running"}

    def events(self, limit: int = 50) -> list[dict]:
        """The last events, oldest first; broken ones are left out."""
        out = []
        for name in self.files.names(f"{self.root}/progress")[-limit:]:
            try:
                out.append(json.loads(self.files.read(f"{self.root}/progress/{name}") or ""))
            except ValueError:
                continue
        return out

    # the write lock
    def lock(self, owner: str, now: float | None = None) -> bool:
        """Takes the lock if it is free, or left by an owner that gave no sign for five minutes."""
        at = time.time() if now is None else now
        body = json.dumps({"owner": owner, "at": at})
        path = f"{self.root}/write.lock"
        if self.files.create(path, body):
            return True
        state = self.lock_state(at)
        if state and state["stale"]:
            self.files.delete(path)
            return self.files.create(path, body)
        return False

    def lock_state(self, now: float | None = None) -> dict | None:
        text = self.files.read(f"{self.root}/write.lock")
        if text is None:
            return None
        try:
            held = json.loads(text)
        except ValueError:
            held = {"owner": None, "at": 0}
        return held | {"stale": (time.time() if now is None else now) - held["at"] > STALE_SECONDS}

    def unlock(self, owner: str) -> None:
        state = self.lock_state()
        if state and state["owner"] == owner:
            self.files.delete(f"{self.root}/write.lock")

    @contextmanager
    def writing(self, owner: str):
        """Holds the write lock; raises if another run has it."""
        if not self.lock(owner):
            raise RuntimeError(f"another run writes: {self.lock_state()}")
        try:
            yield
        finally:
            self.unlock(owner)

    # facts that the next run can use again
    def keep_facts(self, name: str, files: DataFrame, facts: DataFrame, settings: str) -> None:
        """files and facts of a generation as Parquet, with the hash of all settings that made them."""
        at = f"{self.root}/facts/{name}"
        files.write.mode("overwrite").parquet(f"{at}/files")
        facts.write.mode("overwrite").parquet(f"{at}/facts")
        self.write(f"facts/{name}/made", {"settings": settings})

    def facts(self, name: str, settings: str) -> tuple[DataFrame, DataFrame] | None:
        """What ``keep_facts`` kept, or None if other settings made it."""
        made = self.read(f"facts/{name}/made")
        if made is None or made["settings"] != settings:
            return None
        return tuple(self.spark.read.parquet(f"{self.root}/facts/{name}/{part}") for part in ("files", "facts"))

    # embeddings by input
    def keep_embeddings(self, vectors: DataFrame) -> None:
        """vectors (input_hash, model, embedding): adds those that aren't kept yet."""
        at = f"{self.root}/embeddings"
        kept = self.embeddings()
        fresh = vectors.dropDuplicates(["input_hash", "model"])
        if kept is not None:
            fresh = fresh.join(kept.select("input_hash", "model"), ["input_hash", "model"], "left_anti")
        fresh.write.mode("append").parquet(at)

    def embeddings(self) -> DataFrame | None:
        at = f"{self.root}/embeddings"
        return self.spark.read.parquet(at) if self.files.names(at) else None

    # failures of index runs
    def add_failures(self, rows: list[dict]) -> None:
        """rows (repo, path_prefix, file_paths, failure_kind, last_failed_at): of each place and kind the latest stays, the
        most recent ``MOST_FAILURES`` in all."""
        every = [*((self.read("failures") or {}).get("entries", [])), *rows]
        latest: dict[tuple, dict] = {}
        for r in every:
            paths = sorted({p.replace("\\", "/") for p in r.get("file_paths") or []})
            r = r | {"path_prefix": r["path_prefix"].replace("\\", "/"), "file_paths": paths or None}
            key = r["repo"], tuple(paths) or r["path_prefix"], r["failure_kind"]
            if key not in latest or latest[key]["last_failed_at"] <= r["last_failed_at"]:
                latest[key] = r
        ordered = sorted(sorted(latest.values(), key=lambda r: (r["repo"], r["path_prefix"], r["failure_kind"])), key=lambda r: r["last_failed_at"], reverse=True)
        self.write("failures", {"entries": ordered[:MOST_FAILURES]})

    def failures(self) -> DataFrame:
        kind = "repo string, path_prefix string, file_paths array<string>, failure_kind string, last_failed_at string"
        names = [c.split()[0] for c in kind.split(", ")]
        return self.spark.createDataFrame([tuple(r.get(n) for n in names) for r in (self.read("failures") or {}).get("entries", [])], kind)


def reused(wanted: DataFrame, kept: DataFrame | None, model: str) -> tuple[DataFrame, DataFrame]:
    """wanted (id, input_hash) -> (those with an embedding kept for the model, distinct input hashes still to embed)."""
    hashes = wanted.select("input_hash").distinct()
    if kept is None:
        return wanted.withColumn("embedding", F.lit(None).cast("array<double>")).limit(0), hashes
    have = kept.filter(F.col("model") == model).select("input_hash", "embedding")
    return wanted.join(have, "input_hash").select("id", "input_hash", "embedding"), hashes.join(have, "input_hash", "left_anti")
