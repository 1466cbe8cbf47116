"""What git tells of a repository, as tables. Executors run git where the folder is shared."""

from __future__ import annotations

import os
import re
import subprocess

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewake.runtime import arrow

#: Commits that one task reads.
CHUNK = 500
#: Commits of a history at most.
MOST_COMMITS = 3_000


def run_git(root: str, *args: str, timeout: int = 600) -> bytes:
    """git's output; empty where it fails."""
    try:
        return subprocess.run(["git", "-C", root, *args], capture_output=True, check=True, timeout=timeout).stdout
    except (OSError, subprocess.SubprocessError):
        return b""


def _checked(ref: str | None) -> str | None:
    if ref is not None and (not ref or ref.startswith("-") or re.search(r"[\s\0]", ref)):
        raise ValueError(f"not a ref: {ref!r}")
    return ref


def _range(ref: str, against: str | None) -> list[str]:
    return [x for x in (_checked(ref), _checked(against)) if x]


def changed_files(spark: SparkSession, root: str, ref: str = "HEAD~1", against: str | None = None, extensions=(".py",)) -> DataFrame:
    """(rel_file) of files added, copied, modified or renamed between ref and against, or the working tree."""
    out = run_git(root, "diff", "--name-only", "--diff-filter=ACMR", "-z", *_range(ref, against), "--")
    names = sorted(p for p in out.decode("utf-8", "surrogateescape").split("\0") if p.endswith(tuple(extensions)))
    return spark.createDataFrame([(f"./{p}",) for p in names], "rel_file string")


def patches(files: DataFrame, root: str, ref: str = "HEAD~1", against: str | None = None, context: int = 3) -> DataFrame:
    """(rel_file, patch): each file's unified diff."""
    between = _range(ref, against)

    def read(batches):
        for b in batches:
            paths = b.column("rel_file").to_pylist()
            text = [run_git(root, "diff", f"-U{context}", *between, "--", p).decode("utf-8", "replace") for p in paths]
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(text, pa.string())], names=["rel_file", "patch"])

    return arrow(files.select("rel_file"), read, "rel_file string, patch string")


def hunks(patched: DataFrame) -> DataFrame:
    """(file, hstart, hend) of new lines of patches(rel_file, patch) without context; a pure deletion marks one line."""
    heads = F.regexp_extract_all("patch", F.lit(r"(?m)^@@ -[0-9,]+ \+([0-9]+(?:,[0-9]+)?) @@"), F.lit(1))
    h = patched.select(F.col("rel_file").alias("file"), F.explode(heads).alias("h"))
    start, size = F.split("h", ",")[0].cast("int"), F.coalesce(F.try_element_at(F.split("h", ","), F.lit(2)).cast("int"), F.lit(1))
    return h.select("file", start.alias("hstart"), (start + F.greatest(size, F.lit(1)) - 1).alias("hend"))


def blobs(wanted: DataFrame, root: str) -> DataFrame:
    """(commit, rel_file, content) of wanted(commit, rel_file); content is null where git has none."""

    def read(batches):
        for b in batches:
            commits, paths = b.column("commit").to_pylist(), b.column("rel_file").to_pylist()
            asked = "".join(f"{_checked(c)}:{p.removeprefix('./')}\n" for c, p in zip(commits, paths, strict=True))
            done = subprocess.run(["git", "-C", root, "cat-file", "--batch"], input=asked.encode("utf-8", "surrogateescape"), capture_output=True, timeout=3600).stdout
            out, at = [], 0
            for _ in paths:
                end = done.find(b"\n", at)
                head = done[at:end].split(b" ")
                if end < 0 or head[-1] == b"missing" or len(head) != 3 or head[1] != b"blob":
                    out.append(None)
                    at = end + 1 if end >= 0 else at
                    continue
                size = int(head[2])
                out.append(done[end + 1 : end + 1 + size])
                at = end + 2 + size
            yield pa.RecordBatch.from_arrays([pa.array(commits, pa.string()), pa.array(paths, pa.string()), pa.array(out, pa.binary())], names=["commit", "rel_file", "content"])

    return arrow(wanted.select("commit", "rel_file"), read, "commit string, rel_file string, content binary")


def _chunks(spark: SparkSession, root: str, most: int) -> DataFrame:
    n = min(most, int(run_git(root, "rev-list", "--count", "--no-merges", "HEAD").strip() or 0))
    return spark.createDataFrame([(a, min(CHUNK, n - a)) for a in range(0, n, CHUNK)], "skip int, n int").repartition(max(1, -(-n // CHUNK)))


def history(spark: SparkSession, root: str, most: int = MOST_COMMITS, extensions: tuple = (".py",)) -> DataFrame:
    """(commit, ord, subject, file) of the newest commits without merges; newer ones have a higher ord."""

    def read(batches):
        for b in batches:
            for skip, n in zip(b.column("skip").to_pylist(), b.column("n").to_pylist(), strict=True):
                text = run_git(root, "log", "--no-merges", "--name-only", "-z", f"--skip={skip}", f"-n{n}", "--format=%x01%H%x02%s%x02", "HEAD").decode("utf-8", "replace")
                rows = []
                for i, part in enumerate(text.split("\x01")[1:]):
                    commit, subject, names = part.split("\x02", 2)
                    rows += [(commit, -(skip + i), subject, f"./{f}") for f in (x.strip("\n") for x in names.split("\0")) if f.endswith(extensions)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int32(), pa.string(), pa.string()), strict=True)], names=["commit", "ord", "subject", "file"])

    return arrow(_chunks(spark, root, most), read, "commit string, ord int, subject string, file string")


def history_hunks(commit_files: DataFrame, root: str) -> DataFrame:
    """(commit, file, hstart, hend): new lines of each commit's files against its parent."""

    def read(batches):
        for b in batches:
            commits, files = b.column("commit").to_pylist(), b.column("file").to_pylist()
            text = [run_git(root, "show", "-U0", "--format=", _checked(c), "--", f).decode("utf-8", "replace") for c, f in zip(commits, files, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(commits, pa.string()), pa.array(files, pa.string()), pa.array(text, pa.string())], names=["commit", "file", "patch"])

    p = arrow(commit_files.select("commit", "file"), read, "commit string, file string, patch string")
    h = hunks(p.select(F.concat_ws("\0", "commit", "file").alias("rel_file"), "patch"))
    return h.select(F.split("file", "\0")[0].alias("commit"), F.split("file", "\0")[1].alias("file"), "hstart", "hend")


def is_repository(root: str) -> bool:
    return os.path.isdir(root) and bool(run_git(root, "rev-parse", "--git-dir"))
