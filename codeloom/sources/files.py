"""Source trees as tables of files."""

from __future__ import annotations

import json
import os
import re
import subprocess

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codeloom.functions.names import priority
from codeloom.functions.paths import base_name, relative_path

# Endings that are read; directories and parts of file names that are not.
ENDINGS = ("py", "js", "jsx", "ts", "tsx")
SKIPPED_FOLDERS = ("__pycache__", "venv", "env", "node_modules", "dist", "build", "htmlcov", "docs", "documentation", "examples")
SKIPPED_NAMES = ("test_", "tests_", "_test.py", "_tests.py", "conftest.py", "setup.py", "__init__.py")
#: What a cut to the first by priority takes, if one is asked for: trees of more files, share kept, least number kept.
LARGE_TREE, KEPT_SHARE, LEAST_KEPT = 1000, 0.8, 100


def wanted(path: Column) -> Column:
    """Whether a relative path is analysed: an ending that is read, no hidden or skipped folder, no skipped name."""
    folders = F.slice(F.split(path, "/"), 1, F.size(F.split(path, "/")) - 1)
    skipped = F.exists(folders, lambda x: x.startswith(".") | x.isin(*SKIPPED_FOLDERS))
    name = F.lower(base_name(path))
    return name.rlike(r"\.(?:" + "|".join(ENDINGS) + ")$") & ~skipped & ~name.rlike("|".join(map(re.escape, SKIPPED_NAMES)))


def scan(spark: SparkSession, root: str, repo_id: str, everything: bool = False) -> DataFrame:
    """(repo_id, file_path, content, n_bytes, fetched_at) of the files under root; undecodable bytes are replaced."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if not everything:
        reader = reader.option("pathGlobFilter", "*.{" + ",".join(ENDINGS) + "}")
    path = relative_path(F.col("path"), os.path.abspath(root))
    rows = reader.load(root).select(
        F.lit(repo_id).alias("repo_id"),
        path.alias("file_path"),
        F.decode(F.col("content"), "UTF-8").alias("content"),
        F.col("length").alias("n_bytes"),
        F.col("modificationTime").cast("timestamp_ntz").alias("fetched_at"),
    )
    return rows if everything else rows.where(wanted(F.col("file_path")))


def prioritised(files: DataFrame, large: int | None = None, share: float = KEPT_SHARE, least: int = LEAST_KEPT) -> DataFrame:
    """files with their priority; with large, of each repository of more files than that only the first `share` by
    priority, ties by path, but not fewer than `least`.

    Where the cut falls follows from counts per repository and priority, which are few; only the files of that priority
    are ranked. Extra columns stay.
    """
    rows = files.withColumn("priority", priority(F.col("file_path"), F.col("n_bytes")))
    if large is None:
        return rows
    counts = rows.groupBy("repo_id", "priority").agg(F.count(F.lit(1)).alias("n_"))
    per = W.partitionBy("repo_id")
    above = F.coalesce(F.sum("n_").over(per.orderBy(F.desc("priority")).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    counts = counts.withColumn("all_", F.sum("n_").over(per)).withColumn("above_", above)
    keep = F.when(F.col("all_") <= large, F.col("all_")).otherwise(F.greatest(F.lit(least), F.floor(F.col("all_") * share)))
    counts = counts.select("repo_id", "priority", F.least("n_", keep - F.col("above_")).alias("left_"), "n_").where("left_ > 0")
    met = rows.join(counts, ["repo_id", "priority"]).select(*rows.columns, "left_", "n_")
    rank = F.row_number().over(W.partitionBy("repo_id", "priority").orderBy("file_path"))
    partly = met.where("left_ < n_").withColumn("r_", rank).where("r_ <= left_").drop("r_")
    return met.where("left_ = n_").unionByName(partly).drop("left_", "n_")


def clone(address: str, folder: str, depth: int | None = 1, timeout: int = 300) -> str:
    """Clone a repository into folder and give the folder, for scan(); depth None: with its whole history."""
    command = ["git", "clone", "--quiet", *(["--depth", str(depth)] if depth else []), "--", address, folder]
    done = subprocess.run(command, capture_output=True, text=True, timeout=timeout, env=os.environ | {"GIT_TERMINAL_PROMPT": "0"})
    if done.returncode:
        raise RuntimeError(f"git clone failed: {done.stderr.strip()}")
    return folder


def is_remote(address: str) -> bool:
    """Whether an address names a repository elsewhere rather than a folder."""
    return address.startswith(("http://", "https://", "git@", "ssh://"))


# Sizes of repositories by number of files, and the settings of each.
SIZES = ((20, "small"), (50, "medium"), (150, "large"))
PRESETS = {
    "small": {"file_batch": 5, "storage_batch": 25, "timeout": 300},
    "medium": {"file_batch": 10, "storage_batch": 50, "timeout": 600},
    "large": {"file_batch": 15, "storage_batch": 100, "timeout": 1800},
    "huge": {"file_batch": 25, "storage_batch": 200, "timeout": 3600},
}


def size_class(n: Column) -> Column:
    out = F.lit("huge")
    for most, name in reversed(SIZES):
        out = F.when(n <= most, name).otherwise(out)
    return out


def settings(n_files: int, **own) -> dict:
    name = next((name for most, name in SIZES if n_files <= most), "huge")
    return PRESETS[name] | own


def load_tags(path: str) -> dict:
    """The tag settings of a repository; the defaults if there are none."""
    try:
        with open(path, encoding="utf-8") as f:
            return json.load(f)
    except FileNotFoundError:
        return {"auto_tags": [], "manual_tags": {}}


def save_tags(path: str, tags: dict) -> None:
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        json.dump(tags, f, indent=2)
