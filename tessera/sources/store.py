"""The store: a snapshot of records and chunks with changes on top, in numbered generations, and append-only logs.

A change writes the rows that it adds or alters, the ids that it removes and the chunks of new records, each under a path
of its own, and then a manifest that names all tables of the next generation. A manifest is created without overwriting:
of two writers that saw the same generation one gets a Conflict and starts again. Readers see one generation or the next,
never a mix. After COMPACT changes the tables are written together again; chunks go on without being made anew.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera import schema

#: Changes on top of a snapshot before the next commit writes a new one.
COMPACT = 8
CHANGE = f"{schema.RECORD}, removed boolean"


class Conflict(RuntimeError):
    """Another writer took the generation that this one was about to write."""


class Store:
    """Tables under a root: records and chunks by generation; audit, training, runs and suites as logs."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _fs(self, path):
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def exists(self, name: str) -> bool:
        path = self._path(name)
        return self._fs(path).exists(path)

    def generation(self) -> int:
        """The current generation; 0 before the first write."""
        path = self._path("generations")
        if not self._fs(path).exists(path):
            return 0
        return max((int(s.getPath().getName()) for s in self._fs(path).listStatus(path) if s.getPath().getName().isdigit()), default=0)

    def manifest(self, generation: int | None = None) -> dict:
        """The tables of a generation: a snapshot (or none) and changes of records, and tables of chunks."""
        g = self.generation() if generation is None else generation
        if not g:
            return {"generation": 0, "snapshot": None, "changes": [], "chunks": []}
        path = self._path(f"generations/{g}")
        stream = self._fs(path).open(path)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _read(self, name: str, ddl: str) -> DataFrame:
        return self.spark.read.schema(ddl).parquet(f"{self.root}/{name}")

    def records(self, at: dict | None = None) -> DataFrame:
        """Records of a manifest (the current one): of each id the row of the last change, else that of the snapshot."""
        at = at or self.manifest()
        base = self._read(at["snapshot"], schema.RECORD) if at["snapshot"] else self.spark.createDataFrame([], schema.RECORD)
        changes = None
        for n, name in enumerate(at["changes"]):
            one = self._read(name, CHANGE).withColumn("_n", F.lit(n))
            changes = one if changes is None else changes.union(one)
        if changes is None:
            return base
        last = changes.withColumn("_last", F.max("_n").over(Window.partitionBy("id"))).where("_n = _last")
        untouched = base.join(changes.select(F.col("id").alias("_id")).distinct(), F.col("id") == F.col("_id"), "left_anti")
        return untouched.unionByName(last.where("not removed").drop("removed", "_n", "_last"))

    def chunks(self, at: dict | None = None) -> DataFrame:
        """Chunks of a manifest. Those of records that were removed since the last snapshot are still there; retrieval
        joins chunks to visible records, so nothing finds them."""
        at = at or self.manifest()
        if not at["chunks"]:
            return self.spark.createDataFrame([], schema.CHUNK)
        return self.spark.read.schema(schema.CHUNK).parquet(*(f"{self.root}/{name}" for name in at["chunks"]))

    def get(self, record_id: str) -> DataFrame:
        return self.records().where(F.col("id") == record_id).limit(1)

    def commit(self, at: dict, changed: DataFrame, removed: DataFrame | None = None, chunks: DataFrame | None = None) -> int:
        """Writes the generation after the manifest at: changed rows (schema.RECORD), removed ids (id), chunks of new records.

        Tables are sorted by id, so that lookups read few row groups. The generation before stays for readers."""
        own, g = uuid.uuid4().hex, at["generation"] + 1
        rows = changed.select(*(c.split()[0] for c in schema.columns(schema.RECORD))).withColumn("removed", F.lit(False))
        if removed is not None:
            rows = rows.unionByName(removed.select("id").withColumn("removed", F.lit(True)), allowMissingColumns=True)
        rows.sortWithinPartitions("id").write.parquet(f"{self.root}/records/{own}")
        new = {"generation": g, "snapshot": at["snapshot"], "changes": [*at["changes"], f"records/{own}"], "chunks": list(at["chunks"])}
        if chunks is not None:
            chunks.sortWithinPartitions("record_id", "chunk_index").write.parquet(f"{self.root}/chunks/{own}")
            new["chunks"].append(f"chunks/{own}")
        written = [f"records/{own}", f"chunks/{own}"]
        if len(new["changes"]) > COMPACT:
            new = self.compacted(new)
            written += [new["snapshot"], *new["chunks"]]
        path = self._path(f"generations/{g}")
        fs = self._fs(path)
        try:
            stream = fs.create(path, False)
        except Py4JJavaError as e:
            for name in written:
                self._fs(self._path(name)).delete(self._path(name), True)
            raise Conflict(f"generation {g} was written by another writer") from e
        stream.write(bytearray(json.dumps(new).encode()))
        stream.close()
        self._clean(g)
        return g

    def compacted(self, at: dict) -> dict:
        """The manifest with one snapshot of records and one table of the chunks that they still have."""
        own = uuid.uuid4().hex
        records = self.records(at)
        records.sortWithinPartitions("id").write.parquet(f"{self.root}/records/{own}")
        left = self._read(f"records/{own}", schema.RECORD).select(F.col("id").alias("record_id"))
        self.chunks(at).join(left, "record_id", "left_semi").sortWithinPartitions("record_id", "chunk_index").write.parquet(f"{self.root}/chunks/{own}")
        return {"generation": at["generation"], "snapshot": f"records/{own}", "changes": [], "chunks": [f"chunks/{own}"]}

    def _clean(self, g: int) -> None:
        """Removes what only generations before the previous one name. Tables that no manifest names belong to writers at work."""
        if g <= 2:
            return
        keep, old = [self.manifest(g), self.manifest(g - 1)], self._path(f"generations/{g - 2}")
        if not self._fs(old).exists(old):
            return
        names = lambda m: {m["snapshot"], *m["changes"], *m["chunks"]} - {None}
        for name in names(self.manifest(g - 2)) - names(keep[0]) - names(keep[1]):
            self._fs(self._path(name)).delete(self._path(name), True)
        self._fs(old).delete(old, True)

    def append_json(self, name: str, rows: DataFrame, by: str | None = None) -> None:
        """Appends rows to a log of JSON lines; nulls are written."""
        w = rows.write.mode("append").option("ignoreNullFields", "false")
        (w.partitionBy(by) if by else w).json(f"{self.root}/{name}")

    def append(self, name: str, rows: DataFrame) -> None:
        rows.write.mode("append").parquet(f"{self.root}/{name}")

    def log(self, name: str, ddl: str) -> DataFrame:
        return self.spark.read.schema(ddl).parquet(f"{self.root}/{name}") if self.exists(name) else self.spark.createDataFrame([], ddl)

    def count(self, name: str, key: str) -> int:
        """The sum of the values of an operations log under a key."""
        return int(self.log("operations", "key string, value long").where(F.col("key") == key).agg(F.coalesce(F.sum("value"), F.lit(0))).first()[0])

    def add(self, **values: int) -> None:
        self.append("operations", self.spark.createDataFrame(list(values.items()), "key string, value long"))

