"""Rule counts over arriving shards that go on where they stopped, compacted level by level."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession

from strandlens.operators import blocks as B

#: Versions of the counts that are kept: the current one, and the one that readers may still hold.
KEEP = 2
#: Parts of one level that become a part of the next.
FAN = 16


def files(spark: SparkSession, path: str):
    """The folder's file system and path, whatever store it is on."""
    context = spark.sparkContext
    folder = context._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(context._jsc.hadoopConfiguration()), folder


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the finished versions: those whose folder has the mark that is written last."""
    system, folder = files(spark, path)
    if not system.exists(folder):
        return []
    names = [x.getPath().getName() for x in system.listStatus(folder)]
    numbers = [int(x.removeprefix("version=")) for x in names if x.startswith("version=")]
    return sorted(k for k in numbers if system.exists(files(spark, f"{path}/version={k}/_SUCCESS")[1]))


def manifest(spark: SparkSession, path: str, number: int) -> list[dict]:
    """The parts of a finished version: their folders' names and levels, oldest first."""
    system, file = files(spark, f"{path}/version={number}/parts")
    stream = system.open(file)
    try:
        return json.loads(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def current(spark: SparkSession, path: str) -> DataFrame | None:
    """The blocks of the newest finished version; None before the first."""
    done = versions(spark, path)
    return read(spark, path, manifest(spark, path, done[-1])) if done else None


def read(spark: SparkSession, path: str, parts: list[dict]) -> DataFrame:
    return spark.read.schema(B.SCHEMA).parquet(*[f"{path}/{x['at']}" for x in parts])


def write_text(spark: SparkSession, path: str, text: str) -> None:
    system, file = files(spark, path)
    out = system.create(file, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def merge(batch: DataFrame, number: int, path: str, places: list[int]) -> None:
    """Adds a batch to the counts as version `number`. A batch that is already in is left out, and one that was stopped
    before its version was finished is written anew from the version before it, so that nothing counts twice or gets lost.
    Older versions than KEEP go, with the parts that only they have.

    A version lists the parts that it is made of. A batch writes a part of its own, and FAN parts of one level become one of the
    next, so that a row is written once a level and not with every batch."""
    spark = batch.sparkSession
    done = versions(spark, path)
    if done and done[-1] >= number:
        return
    held = {k: manifest(spark, path, k) for k in done}
    parts = [*(held[done[-1]] if done else []), {"at": f"blocks-{number}.0", "level": 0}]
    B.packed(batch, places).write.mode("overwrite").parquet(f"{path}/{parts[-1]['at']}")
    gone = []
    while len(parts) >= FAN and parts[-FAN]["level"] == parts[-1]["level"]:
        level = parts[-1]["level"] + 1
        gone += parts[-FAN:]
        parts[-FAN:] = [{"at": f"blocks-{number}.{level}", "level": level}]
    if gone:  # of those that are made and merged at once only the last is written
        made = [x for x in gone if not (x["level"] and x["at"].startswith(f"blocks-{number}."))]
        B.compacted(read(spark, path, made), len(places)).write.mode("overwrite").parquet(f"{path}/{parts[-1]['at']}")
    write_text(spark, f"{path}/version={number}/parts", json.dumps(parts))
    write_text(spark, f"{path}/version={number}/_SUCCESS", "")
    old = done[: max(0, len(done) + 1 - KEEP)]
    kept = {x["at"] for k in done[len(old) :] for x in held[k]} | {x["at"] for x in parts}
    unused = {x["at"] for k in old for x in held[k]} | {x["at"] for x in gone if x["at"].startswith(f"blocks-{number}.")}
    for name in [*[f"version={k}" for k in old], *sorted(unused - kept)]:
        system, folder = files(spark, f"{path}/{name}")
        system.delete(folder, True)


def guard(spark: SparkSession, path: str, parameters: dict) -> None:
    """Writes down the parameters' hash beside the counts, and refuses counts that other parameters made."""
    mark = hashlib.md5(json.dumps(parameters, sort_keys=True).encode()).hexdigest()[:12]
    system, folder = files(spark, f"{path}/parameters={mark}")
    others = [x.getPath().getName() for x in system.listStatus(folder.getParent())] if system.exists(folder.getParent()) else []
    if any(x.startswith("parameters=") and x != f"parameters={mark}" for x in others):
        raise ValueError("the counts were made with other parameters")
    system.mkdirs(folder)


def count_rules(spark: SparkSession, source: str, schema, path: str, places: list[int], most_files: int = 1000, **thresholds) -> DataFrame:
    """Counts the shard files (family, hallmarks, cdr3, v) that have arrived since the last call, at most `most_files` in a
    batch, and returns the rules of all counted so far. `path` holds the stream's own state, the counts and the hash of their
    parameters, which belong together. Thresholds (operators.blocks.rules_of) may change between calls: they don't touch counts."""
    guard(spark, path, {"places": sorted(places), "form": "blocks"})
    counts = f"{path}/counts"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", most_files).parquet(source)
    query = stream.writeStream.foreachBatch(lambda batch, number: merge(batch, number, counts, places)).option("checkpointLocation", f"{path}/stream").trigger(availableNow=True).start()
    query.awaitTermination()
    found = current(spark, counts)
    return B.rules_of(spark.createDataFrame([], B.SCHEMA) if found is None else found, places, **thresholds)
