"""Counts of a stream in generations, so that reading them does not read all batches there ever were.

Each micro-batch leaves its values in a folder of its own.  :func:`compact` sums closed batches into a generation: the values of
its documents, each once, and the counts that follow from them.  ``FAN`` generations of one level become one of the next, so a
value is rewritten once a level.  A manifest names the generations and the last batch in them; it is written beside the former
one and takes effect by a rename, so a compaction that ends half way leaves unused folders and changes nothing.  The newest
batch stays open: it may still be repeated.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkveil.operators.collate import merged_counts

FAN = 4
VALUES = "doc_id bigint, category string, value string, n bigint"
COUNTS = "doc_id bigint, category string, n_items bigint"
_HOME = "_generations"


class _Folder:
    """The little that is needed of the Hadoop file system."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm = spark.sparkContext._jvm
        self.path = path.rstrip("/")
        self.fs = self._at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def names(self, folder: str = "") -> list[str]:
        at = self._at(folder)
        return [f.getPath().getName() for f in self.fs.listStatus(at)] if self.fs.exists(at) else []

    def has(self, name: str) -> bool:
        return self.fs.exists(self._at(name))

    def read(self, name: str) -> str:
        stream = self.fs.open(self._at(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def put(self, name: str, text: str) -> None:
        """Write a file that is there whole or not at all; one that exists already is an error."""
        part = f"{name}.{uuid.uuid4().hex}"
        stream = self.fs.create(self._at(part))
        stream.write(bytearray(text.encode()))
        stream.close()
        if self.has(name) or not self.fs.rename(self._at(part), self._at(name)):
            self.fs.delete(self._at(part), False)
            raise RuntimeError(f"{self.path}/{name} was written by another compaction")

    def drop(self, name: str) -> None:
        self.fs.delete(self._at(name), True)


def _manifest(folder: _Folder) -> tuple[int, dict]:
    numbers = [int(n.removesuffix(".json")) for n in folder.names(_HOME) if n.endswith(".json")]
    if not numbers:
        return 0, {"upto": -1, "generations": []}
    return max(numbers), json.loads(folder.read(f"{_HOME}/{max(numbers)}.json"))


def _open_batches(folder: _Folder, upto: int) -> list[int]:
    found = [int(n.removeprefix("batch=")) for n in folder.names() if n.startswith("batch=")]
    return sorted(b for b in found if b > upto and folder.has(f"batch={b}/_SUCCESS"))


def _values(spark: SparkSession, out: str, batches: list[int], generations: list[dict]) -> DataFrame:
    paths = [f"{out}/batch={b}" for b in batches] + [f"{out}/{_HOME}/{g['folder']}/values" for g in generations]
    return spark.read.schema(VALUES).parquet(*paths)


def _store(spark: SparkSession, out: str, values: DataFrame, level: int) -> dict:
    name = f"level{level}-{uuid.uuid4().hex}"
    path = f"{out}/{_HOME}/{name}"
    values.groupBy("doc_id", "category", "value").agg(F.sum("n").alias("n")).write.parquet(f"{path}/values")
    merged_counts(spark.read.schema(VALUES).parquet(f"{path}/values")).write.parquet(f"{path}/counts")
    return {"folder": name, "level": level}


def compact(spark: SparkSession, out: str, fan: int = FAN) -> bool:
    """Sum all closed batches but the newest into a generation, merge generations of a level, and commit; False: nothing to do."""
    out = out.rstrip("/")
    folder = _Folder(spark, out)
    number, state = _manifest(folder)
    batches = _open_batches(folder, state["upto"])[:-1]
    if not batches:
        return False
    generations = [*state["generations"], _store(spark, out, _values(spark, out, batches, []), 0)]
    level = 0
    while len(same := [g for g in generations if g["level"] == level]) >= fan:
        merged = _store(spark, out, _values(spark, out, [], same), level + 1)
        generations = [g for g in generations if g["level"] != level] + [merged]
        level += 1
    folder.put(f"{_HOME}/{number + 1}.json", json.dumps({"upto": batches[-1], "generations": generations}))
    return True


def clean(spark: SparkSession, out: str) -> None:
    """Delete batches, generations and manifests that the newest manifest has replaced; not while others read or compact."""
    out = out.rstrip("/")
    folder = _Folder(spark, out)
    number, state = _manifest(folder)
    used = {g["folder"] for g in state["generations"]}
    for name in folder.names():
        if name.startswith("batch=") and int(name.removeprefix("batch=")) <= state["upto"]:
            folder.drop(name)
    for name in folder.names(_HOME):
        if name not in used and name != f"{number}.json":
            folder.drop(f"{_HOME}/{name}")


def read(spark: SparkSession, out: str) -> DataFrame:
    """``(doc_id, category, n_items)`` of all batches so far."""
    out = out.rstrip("/")
    folder = _Folder(spark, out)
    _, state = _manifest(folder)
    batches, generations = _open_batches(folder, state["upto"]), state["generations"]
    if not batches and not generations:
        return spark.createDataFrame([], COUNTS)
    if not generations:
        return merged_counts(_values(spark, out, batches, []))
    counts = [spark.read.schema(COUNTS).parquet(f"{out}/{_HOME}/{g['folder']}/counts") for g in generations]
    ids = [c.select("doc_id").distinct() for c in counts]
    if batches:
        ids.append(_values(spark, out, batches, []).select("doc_id").distinct())
    single, listed = counts[0], ids[0]
    for c in counts[1:]:
        single = single.unionByName(c)
    for i in ids[1:]:
        listed = listed.unionByName(i)
    # In several parts, or in open batches only: their values are summed.
    open_ids = _values(spark, out, batches, []).select("doc_id").distinct() if batches else spark.createDataFrame([], "doc_id bigint")
    several = listed.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id").unionByName(open_ids).distinct()
    again = merged_counts(_values(spark, out, batches, generations).join(several, "doc_id", "left_semi"))
    return single.join(several, "doc_id", "left_anti").unionByName(again)
