"""Parquet tables read through manifests, compacted in place.

A table is a folder of Parquet files and a folder ``_manifests`` of numbered lists of the files
that make up each version. Readers take the files of the latest list, so a compaction that is
writing new files changes nothing for them until its list is in place; the list is written
under a temporary name and renamed, and the rename fails if another compaction numbered the same
version first. A folder without lists is version 0: all Parquet files under it.

Compaction packs the files below a target size into groups of at most that size, first fit by
falling size, and writes each group of two or more as one file, in one job. Files of the
target size and above, and small files that no other fits beside, are not rewritten. Old files
stay, so that readers of earlier versions go on; :func:`files_of` names what a version holds.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFESTS = "_manifests"
#: Size of a compacted file, a parameter of :func:`compact_in_place`.
TARGET_BYTES = 128 * 1024 * 1024


def _fs(spark: SparkSession, path: str):
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()), jpath


def _versions(spark: SparkSession, table: str) -> list[int]:
    fs, folder = _fs(spark, f"{table.rstrip('/')}/{MANIFESTS}")
    if not fs.exists(folder):
        return []
    names = [status.getPath().getName() for status in fs.listStatus(folder)]
    return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))


def _listed(spark: SparkSession, table: str) -> list[tuple[str, int]]:
    """Parquet files under ``table`` with their sizes; hidden and ``_`` folders left out."""
    fs, folder = _fs(spark, table)
    found = fs.listFiles(folder, True)
    out = []
    while found.hasNext():
        status = found.next()
        path = status.getPath()
        parts = path.toUri().getPath()[len(folder.toUri().getPath()) :].split("/")
        if any(p.startswith(("_", ".")) for p in parts if p) or not path.getName().endswith(".parquet"):
            continue
        out.append((path.toString(), status.getLen()))
    return sorted(out)


def files_of(spark: SparkSession, table: str, version: int | None = None) -> list[tuple[str, int]]:
    """``(path, bytes)`` of the files of a version, the latest by default."""
    versions = _versions(spark, table)
    chosen = version if version is not None else (versions[-1] if versions else 0)
    if chosen == 0 and 0 not in versions:
        return _listed(spark, table)
    fs, path = _fs(spark, f"{table.rstrip('/')}/{MANIFESTS}/v{chosen:010d}.json")
    stream = fs.open(path)
    try:
        text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    return [(entry["path"], entry["bytes"]) for entry in json.loads(text)["files"]]


def read_table(spark: SparkSession, table: str, version: int | None = None) -> DataFrame:
    """Rows of a version of ``table``, the latest by default."""
    files = [path for path, _ in files_of(spark, table, version)]
    if not files:
        raise FileNotFoundError(f"no Parquet files in {table!r}")
    return spark.read.parquet(*files)


def _write_manifest(spark: SparkSession, table: str, version: int, files: list[tuple[str, int]]) -> None:
    folder = f"{table.rstrip('/')}/{MANIFESTS}"
    fs, temporary = _fs(spark, f"{folder}/.v{version:010d}-{uuid.uuid4().hex}.json")
    out = fs.create(temporary, False)
    try:
        body = json.dumps({"version": version, "files": [{"path": p, "bytes": b} for p, b in files]})
        out.write(bytearray(body.encode("utf-8")))
    finally:
        out.close()
    final = _fs(spark, f"{folder}/v{version:010d}.json")[1]
    if fs.exists(final) or not fs.rename(temporary, final):
        fs.delete(temporary, False)
        raise RuntimeError(f"version {version} of {table!r} was written by another compaction")


def pack(sizes: list[int], target: int) -> list[list[int]]:
    """Groups of indices of files below ``target``, each at most ``target`` bytes in all.

    First fit by falling size; files of ``target`` bytes or more are in no group.
    """
    groups: list[list[int]] = []
    room: list[int] = []
    for i in sorted((i for i, s in enumerate(sizes) if s < target), key=lambda i: (-sizes[i], i)):
        for g, left in enumerate(room):
            if sizes[i] <= left:
                groups[g].append(i)
                room[g] -= sizes[i]
                break
        else:
            groups.append([i])
            room.append(target - sizes[i])
    return groups


def compact_in_place(spark: SparkSession, table: str, target_bytes: int = TARGET_BYTES) -> dict[str, int]:
    """Rewrite groups of small files of the latest version as one file each; a new version.

    Returns the numbers of files rewritten, kept and written, and the new version (the old one
    if nothing was worth rewriting). The driver sees file names and sizes, never rows.
    """
    versions = _versions(spark, table)
    current = versions[-1] if versions else 0
    files = files_of(spark, table)
    groups = [g for g in pack([b for _, b in files], target_bytes) if len(g) > 1]
    if not groups:
        return {"rewritten": 0, "kept": len(files), "written": 0, "version": current}
    chosen = {files[i][0]: g for g, members in enumerate(groups) for i in members}
    # Listings write ``file:/x``, Spark's file metadata ``file:///x``: both lose the scheme's slashes.
    plain = lambda path: F.regexp_replace(path, r"^[A-Za-z][A-Za-z0-9+.-]*:/+", "/")
    places = spark.createDataFrame(list(chosen.items()), "path string, compact_group int")
    places = places.select(plain(F.col("path")).alias("path"), "compact_group")
    rows = spark.read.parquet(*chosen).withColumn("path", plain(F.col("_metadata.file_path")))
    grouped = rows.join(places, "path").drop("path")
    out = f"{table.rstrip('/')}/compacted-{uuid.uuid4().hex}"
    grouped.repartition(len(groups), "compact_group").write.partitionBy("compact_group").parquet(out)
    written = _listed(spark, out)
    kept = [f for f in files if f[0] not in chosen]
    if not versions:
        # The listing that was version 0 is fixed, as the new files now lie in the folder too.
        _write_manifest(spark, table, 0, files)
    _write_manifest(spark, table, current + 1, kept + written)
    return {"rewritten": len(chosen), "kept": len(kept), "written": len(written), "version": current + 1}
