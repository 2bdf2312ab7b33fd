"""Generations of a graph: immutable Parquet folders, a pointer to the active one, tombstones for failed ones."""

from __future__ import annotations

import json
import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from graphloom.operators.symbols import dangling


class GraphStore:
    """Writes and reads generations below a folder on any file system Spark reaches; readers keep the one they opened."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def write(self, nodes: DataFrame, edges: DataFrame, check: bool = True) -> str:
        """A new generation's name: nodes and edges in folders by kind. A failed one gets ``failed.json`` and the error."""
        name = f"{datetime.now(timezone.utc):%Y%m%dT%H%M%S}-{uuid.uuid4().hex[:8]}"
        at = f"{self.root}/generations/{name}"
        try:
            nodes.write.partitionBy("kind").parquet(f"{at}/nodes")
            edges.write.partitionBy("kind").parquet(f"{at}/edges")
            written = [self.spark.read.schema(df.schema).parquet(f"{at}/{part}") for part, df in (("nodes", nodes), ("edges", edges))]
            if check and not dangling(written[1], written[0]).isEmpty():
                raise ValueError("an edge ends at no node")
            self._put(f"{at}/manifest.json", {"generation": name, "nodes": written[0].count(), "edges": written[1].count(), "schemas": [df.schema.jsonValue() for df in (nodes, edges)]})
        except Exception as e:
            self._put(f"{at}/failed.json", {"generation": name, "error": str(e)[:2000]})
            raise
        return name

    def publish(self, name: str) -> None:
        """Makes a generation the active one: a new pointer file renamed over the old one."""
        self._put(f"{self.root}/current.json", {"generation": name})

    def active(self) -> str | None:
        text = self._get(f"{self.root}/current.json")
        return json.loads(text)["generation"] if text else None

    def manifest(self, name: str) -> dict | None:
        text = self._get(f"{self.root}/generations/{name}/manifest.json")
        return json.loads(text) if text else None

    def open(self, name: str | None = None) -> tuple[DataFrame, DataFrame]:
        """Nodes and edges of a generation, the active one by default; later publishing doesn't change them."""
        name = name or self.active()
        if name is None:
            raise LookupError("nothing is published")
        at = f"{self.root}/generations/{name}"
        text = self._get(f"{at}/manifest.json")
        if text is None:
            raise LookupError(f"generation {name} isn't whole")
        schemas = [StructType.fromJson(x) for x in json.loads(text)["schemas"]]
        return tuple(self.spark.read.schema(x).parquet(f"{at}/{part}") for part, x in zip(("nodes", "edges"), schemas))

    def _path(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return jvm, p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _put(self, path: str, value: dict) -> None:
        jvm, p, fs = self._path(path)
        fresh = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
        out = fs.create(fresh, True)
        out.write(bytearray(json.dumps(value).encode()))
        out.close()
        fs.delete(p, False)
        fs.rename(fresh, p)

    def _get(self, path: str) -> str | None:
        jvm, p, fs = self._path(path)
        if not fs.exists(p):
            return None
        stream = fs.open(p)
        try:
            return jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
