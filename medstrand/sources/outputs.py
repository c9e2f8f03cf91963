"""Several tables of one job that appear together, or not at all."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

# How a table is written where Parquet will not do: ``(df, path)``; it must not overwrite.
Writer = Callable[[DataFrame, str], None]


def _path(spark: SparkSession, text: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(text)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    where, files = _path(spark, path)
    return files.exists(where)


def require_absent(spark: SparkSession, paths: list[str]) -> None:
    """Stops a job before its first scan when any of its outputs is there already, naming all of them.

    One output inside another, or given twice, is refused as well.
    """
    ends = sorted(p.rstrip("/") + "/" for p in paths)
    nested = [(a, b) for a, b in zip(ends, ends[1:]) if b.startswith(a)]
    if nested:
        raise ValueError(f"outputs within one another: {nested}")
    found = [p for p in paths if exists(spark, p)]
    if found:
        raise FileExistsError(f"outputs exist already: {found}")


def _move(spark: SparkSession, source: str, target: str) -> None:
    (a, files), (b, _) = _path(spark, source), _path(spark, target)
    # A move onto a folder that is there would put the table inside it.
    if files.exists(b) or not (files.mkdirs(b.getParent()) and files.rename(a, b)):
        raise OSError(f"cannot move {source} to {target}")


def _delete(spark: SparkSession, path: str) -> None:
    where, files = _path(spark, path)
    files.delete(where, True)


def write_together(
    spark: SparkSession,
    tables: Mapping[str, DataFrame],
    manifest: str,
    writers: Mapping[str, Writer] | None = None,
) -> dict[str, int]:
    """Write each ``path: frame``, all staged first, then moved, then named in ``manifest``; gives rows by path.

    All targets and the manifest must be absent. Each table is written beside its target, in a hidden
    folder that scans pass over, so moving it copies nothing on a file system with renames. When a
    table fails, nothing has been moved; when a move fails, those before it are taken back. The
    manifest is written last: ``read_together`` refuses a job whose driver ended between the moves.
    """
    require_absent(spark, [*tables, manifest])
    job = uuid.uuid4().hex
    staged = {path: f"{path.rstrip('/').rpartition('/')[0]}/.staged-{job}-{i}" for i, path in enumerate(tables)}
    rows: dict[str, int] = {}
    moved: list[str] = []
    try:
        for path, df in tables.items():
            seen = Observation(f"rows-{uuid.uuid4().hex}")
            watched = df.observe(seen, F.count(F.lit(1)).alias("rows"))
            (writers or {}).get(path, lambda frame, to: frame.write.parquet(to))(watched, staged[path])
            rows[path] = seen.get["rows"]
        for path in tables:
            _move(spark, staged[path], path)
            moved.append(path)
        _write_manifest(spark, manifest, {"job": job, "tables": [{"path": p, "rows": n} for p, n in rows.items()]}, job)
    except BaseException:
        for path in [*moved, *staged.values()]:
            _delete(spark, path)
        raise
    return rows


def _write_manifest(spark: SparkSession, manifest: str, content: dict, job: str) -> None:
    aside = f"{manifest.rpartition('/')[0]}/.manifest-{job}"
    where, files = _path(spark, aside)
    try:
        out = files.create(where, False)
        out.write(bytearray(json.dumps(content, indent=1).encode()))
        out.close()
        _move(spark, aside, manifest)
    except BaseException:
        _delete(spark, aside)
        raise


def read_manifest(spark: SparkSession, manifest: str) -> dict[str, int]:
    """Rows by path of a job that ended; an error when it did not."""
    if not exists(spark, manifest):
        raise FileNotFoundError(f"no manifest {manifest}: the job has not ended, or failed")
    text = spark.read.text(manifest, wholetext=True).first()["value"]
    return {t["path"]: t["rows"] for t in json.loads(text)["tables"]}


def read_together(spark: SparkSession, manifest: str) -> dict[str, DataFrame]:
    """The Parquet tables of a job that ended, by path."""
    return {path: spark.read.parquet(path) for path in read_manifest(spark, manifest)}
