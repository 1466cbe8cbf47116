"""Cases, snapshots, calibrations, facts and graphs on disk, and result sinks."""

from __future__ import annotations

import json
import os
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewake.operators.select import newest
from tidewake.sources.files import ADAPTERS, hashed

CASE_DEFAULTS = {"budget": 10_000, "depth": 2, "top_k": 20, "min_recall": 1.0}
_LISTS = ("changed", "must_include", "must_exclude")
CASE_SCHEMA = "name string, task string, changed array<string>, must_include array<string>, must_exclude array<string>, budget int, depth int, top_k int, min_recall double"


def load_cases(spark: SparkSession, path: str) -> DataFrame:
    """Cases of a JSON file {version, defaults, cases}; defaults fill what a case leaves out.

    A case without a name, without changed or must_include ids, or with a list that isn't
    one of strings, is an error, as is a file without cases.
    """
    raw = spark.read.option("multiLine", True).option("mode", "FAILFAST").schema(f"version int, defaults struct<budget int, depth int, top_k int, min_recall double>, cases array<struct<{CASE_SCHEMA}>>").json(path)
    rows = raw.select("defaults", F.explode_outer("cases").alias("c"))
    pick = {k: F.coalesce(F.col(f"c.{k}"), F.col(f"defaults.{k}"), F.lit(v)) for k, v in CASE_DEFAULTS.items()}
    out = rows.select("c.name", F.coalesce("c.task", F.lit("")).alias("task"), *[F.coalesce(F.col(f"c.{k}"), F.array().cast("array<string>")).alias(k) for k in _LISTS], *[v.alias(k) for k, v in pick.items()])
    wrong = F.when(F.col("name").isNull() | (F.col("name") == ""), "a case has no name").when(F.size("changed") == 0, "a case has no changed ids").when(F.size("must_include") == 0, "a case has no must_include ids")
    wrong = wrong.when(~F.col("min_recall").between(0.0, 1.0), "min_recall isn't from 0 to 1")
    return out.withColumn("name", F.when(wrong.isNotNull(), F.raise_error(F.concat_ws(": ", wrong, "name"))).otherwise(F.col("name")))


def save_cases(cases: DataFrame, path: str) -> None:
    """A case a line would not be that format: the file is one object, written by the driver, as cases are written by hand."""
    rows = [r.asDict() for r in cases.toLocalIterator()]
    with open(path, "w", encoding="utf-8") as f:
        json.dump({"version": 1, "cases": rows}, f, indent=2, ensure_ascii=False)


def save_state(symbols: DataFrame, path: str) -> None:
    """A snapshot of symbols(id, code, file)."""
    symbols.select("id", "code", "file").write.mode("overwrite").parquet(path)


def load_state(spark: SparkSession, path: str) -> DataFrame:
    """A snapshot; without one, an empty table."""
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], "id string, code string, file string")


def save_calibration(calibration: dict, path: str) -> None:
    with open(path, "w", encoding="utf-8") as f:
        json.dump(calibration, f, indent=2)


def load_calibration(path: str) -> dict | None:
    try:
        with open(path, encoding="utf-8") as f:
            got = json.load(f)
    except (OSError, ValueError):
        return None
    return got if isinstance(got, dict) else None


def write_rows(rows: DataFrame, path: str, kind: str = "csv") -> None:
    """Result rows as csv (with a header), json lines or parquet; lines are appended."""
    writer = rows.write.mode("append")
    (writer.option("header", True) if kind == "csv" else writer).format(kind).save(path)


class FactCache:
    """Facts of files by content, below a shared folder.

    Each build appends the facts of files that no build had, as a folder of its own that
    counts once its _SUCCESS file stands. Graphs are kept by the repository's state hash.
    """

    def __init__(self, folder: str):
        self.folder = folder.removeprefix("file://").rstrip("/")

    def _builds(self, name: str) -> list[str]:
        top = f"{self.folder}/{name}"
        return sorted(f"file://{top}/{x}" for x in os.listdir(top) if os.path.exists(f"{top}/{x}/_SUCCESS")) if os.path.isdir(top) else []

    def facts(self, files: DataFrame, extension: str = ".py") -> tuple[DataFrame, int]:
        """(facts of files(rel_file, content), number of files that had to be parsed)."""
        spark, extract = files.sparkSession, ADAPTERS[extension]
        h = hashed(files)
        keys = h.select(F.col("rel_file").alias("file"), "file_hash")
        seen = self._builds("seen")
        old = spark.read.parquet(*seen).distinct() if seen else spark.createDataFrame([], "file string, file_hash string")
        misses = h.join(old, (h["rel_file"] == old["file"]) & (h["file_hash"] == old["file_hash"]), "left_anti").select("rel_file", "content", "file_hash")
        mark = misses.select(F.col("rel_file").alias("file"), "file_hash")
        build = uuid.uuid4().hex
        new = extract(misses).join(mark, "file")
        new.write.parquet(f"file://{self.folder}/facts/{build}")
        # what was parsed is told last: a build that stops half-way is parsed again
        done = spark.read.parquet(f"file://{self.folder}/facts/{build}")
        mark.write.parquet(f"file://{self.folder}/seen/{build}")
        parsed = spark.read.parquet(f"file://{self.folder}/seen/{build}").count()
        known = self._builds("facts")
        all_ = spark.read.parquet(*known).distinct() if known else done
        return all_.join(keys, ["file", "file_hash"], "left_semi").drop("file_hash"), parsed

    def get_graph(self, spark: SparkSession, state: str) -> DataFrame | None:
        path = f"{self.folder}/graphs/{state}"
        return spark.read.parquet(f"file://{path}") if os.path.exists(f"{path}/_SUCCESS") else None

    def put_graph(self, edges: DataFrame, state: str, keep: int = 5) -> None:
        """Write a graph and remove all but the newest."""
        import shutil

        edges.write.mode("overwrite").parquet(f"file://{self.folder}/graphs/{state}")
        top, spark = f"{self.folder}/graphs", edges.sparkSession
        have = [("graphs", x, os.path.getmtime(f"{top}/{x}")) for x in os.listdir(top)]
        stay = {r.id for r in newest(spark.createDataFrame(have, "key string, id string, at double"), keep).collect()}
        for _, x, _ in have:
            if x not in stay:
                shutil.rmtree(f"{top}/{x}", ignore_errors=True)

    def forget(self, spark: SparkSession, file: str) -> None:
        """Drop all facts of one file, by rewriting the builds that have it."""
        for name in ("seen", "facts"):
            for path in self._builds(name):
                df = spark.read.parquet(path)
                if df.where(F.col("file") == file).isEmpty():
                    continue
                df.where(F.col("file") != file).write.parquet(f"file://{self.folder}/{name}/{uuid.uuid4().hex}")
                import shutil

                shutil.rmtree(path.removeprefix("file://"), ignore_errors=True)
