"""Source files as a table: (rel_file, content), paths like ``./pkg/mod.py``."""

from __future__ import annotations

import os
import re
import subprocess
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewake.functions.script_facts import CONFIGS, EXTENSIONS
from tidewake.operators import resolve
from tidewake.runtime import arrow

#: Files that one task reads.
FILES_A_TASK = 500

#: Folders that hold no sources of one's own.
EXCLUDED = frozenset(".git .hg .svn .tox .nox .venv venv env __pycache__ .mypy_cache .pytest_cache .ruff_cache .eggs .idea .vscode node_modules site-packages build dist".split())
#: Readers of facts by extension: files(rel_file, content) to facts.
ADAPTERS: dict[str, Callable[[DataFrame], DataFrame]] = {e: resolve.extract_facts for e in (".py", *EXTENSIONS)}
#: Of scripts: minified files, tests by name, and folders of what is built or taken over.
_NOT_INDEXED = re.compile(r"\.min\.[^/]*$|\.(test|spec)\.[^/.]+$|(^|/)(static|staticfiles|assets|public|vendors?|coverage|\.next|\.nuxt|out)/", re.IGNORECASE)


def indexable_extensions() -> tuple[str, ...]:
    return tuple(sorted(ADAPTERS))


def adapter_for_path(path: str):
    return ADAPTERS.get(os.path.splitext(path)[1])


def excluded(path):
    """Whether a folder of the path (not its last part) is one of EXCLUDED, or an egg's."""
    parts = F.split(path, "/")
    return F.exists(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: p.isin(*sorted(EXCLUDED)) | p.endswith(".egg-info"))


def should_index(path):
    """False for scripts that are minified, tests by name, or in folders of what is built or taken over."""
    script = F.col(path).rlike(r"\.([tj]sx?|[mc]js)$")
    return ~(script & F.lower(F.col(path)).rlike(_NOT_INDEXED.pattern))


def tracked_paths(root: str) -> list[str] | None:
    """Paths that git knows or would add, and that exist; None where git can't tell."""
    try:
        out = subprocess.run(["git", "-C", root, "ls-files", "--cached", "--others", "--exclude-standard", "-z"], capture_output=True, check=True, timeout=600).stdout
    except (OSError, subprocess.SubprocessError):
        return None
    return sorted({p for p in out.decode("utf-8", "surrogateescape").split("\0") if p and os.path.isfile(os.path.join(root, p))})


def walked_paths(root: str) -> list[str]:
    """Paths of files below root, folders of EXCLUDED left out."""
    out = []
    for base, folders, names in os.walk(root):
        folders[:] = sorted(x for x in folders if x not in EXCLUDED and not x.endswith(".egg-info"))
        out += [os.path.relpath(os.path.join(base, n), root) for n in names]
    return sorted(out)


def discover(spark: SparkSession, root: str, extensions=None) -> DataFrame:
    """(rel_file, content) of the source files below root, and of scripts' configs: those that git tells of, else all but the excluded.

    Executors read the files, from a folder that they share. (Spark's own file sources pass
    over names with a leading underscore, and so over every __init__.py.)
    """
    root, wanted = os.path.abspath(root), tuple(extensions or indexable_extensions())
    known = tracked_paths(root)
    configs = CONFIGS if set(wanted) & set(EXTENSIONS) else ()  # they tell what scripts' imports mean
    names = [p for p in (walked_paths(root) if known is None else known) if p.endswith(wanted) or os.path.basename(p) in configs]
    paths = spark.createDataFrame([(f"./{p}",) for p in names], "rel_file string").where(~excluded("rel_file") & should_index("rel_file"))

    def read(batches):
        for b in batches:
            kept, content = [], []
            for p in b.column("rel_file").to_pylist():
                try:
                    with open(os.path.join(root, p), "rb") as f:
                        content.append(f.read())
                    kept.append(p)
                except FileNotFoundError:  # gone since it was listed
                    continue
            if kept:
                yield pa.RecordBatch.from_arrays([pa.array(kept, pa.string()), pa.array(content, pa.binary())], names=["rel_file", "content"])

    return arrow(paths.repartition(max(1, len(names) // FILES_A_TASK)), read, "rel_file string, content binary")


def encoding_problems(files: DataFrame) -> DataFrame:
    """(rel_file) of files that aren't UTF-8, each once."""
    return files.where(~F.is_valid_utf8(F.col("content").cast("string"))).select("rel_file").distinct()


def once(rows: DataFrame, *keys: str) -> DataFrame:
    """The first row of each key, by all columns: a warning is told once a session and file."""
    w = Window.partitionBy(*keys).orderBy(*[c for c in rows.columns if c not in keys] or list(keys))
    return rows.withColumn("tw_rn", F.row_number().over(w)).where("tw_rn = 1").drop("tw_rn")


def hashed(files: DataFrame) -> DataFrame:
    return files.withColumn("file_hash", F.sha2(F.col("content"), 256))


def source_hash(text):
    return F.sha2(F.encode(text, "utf-8"), 256)


def state_hash(files: DataFrame) -> DataFrame:
    """One row: a hash of all paths and contents, whatever their order and partitions.

    Hashes are taken of the sorted (path, hash) lines of each of 4,096 buckets of paths, and
    over the buckets in order, so no task has all lines.
    """
    line = F.concat("rel_file", F.lit("\0"), F.sha2(F.col("content"), 256), F.lit("\n"))
    b = files.select(F.substring(F.sha2(F.col("rel_file").cast("binary"), 256), 1, 3).alias("bucket"), line.alias("line"))
    parts = b.groupBy("bucket").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("line")), "").cast("binary"), 256).alias("h"))
    every = F.array_sort(F.collect_list(F.concat_ws(":", "bucket", "h")))
    return parts.agg(F.sha2(F.array_join(every, "\n").cast("binary"), 256).alias("state"))
