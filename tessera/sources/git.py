"""What the engine asks of git, as DataFrames. A command runs on the driver, where
the working copy is; its output is what the caller's limits allow."""

from __future__ import annotations

import subprocess

from pyspark.sql import DataFrame, SparkSession


def _git(root: str, *args: str) -> str:
    return subprocess.run(["git", "-C", root, *args], capture_output=True, text=True, check=True).stdout


def is_repository(root: str) -> bool:
    return subprocess.run(["git", "-C", root, "rev-parse", "--git-dir"], capture_output=True).returncode == 0


def current_branch(root: str) -> str:
    return _git(root, "rev-parse", "--abbrev-ref", "HEAD").strip()


def working_tree(spark: SparkSession, root: str) -> DataFrame:
    """(status, relative_path) of changed and untracked files."""
    rows = [(x[:2].strip(), x[3:].split(" -> ")[-1].strip('"')) for x in _git(root, "status", "--porcelain").splitlines()]
    return spark.createDataFrame(rows, "status string, relative_path string")


def commit_files(spark: SparkSession, root: str, limit: int = 500) -> DataFrame:
    """(commit, file) of the latest commits, for co-change."""
    rows, commit = [], ""
    for x in _git(root, "log", f"-{limit}", "--name-only", "--format=%x00%H").splitlines():
        if x.startswith("\0"):
            commit = x[1:]
        elif x:
            rows.append((commit, x))
    return spark.createDataFrame(rows, "commit string, file string")


def diffs(spark: SparkSession, root: str, base: str = "HEAD") -> DataFrame:
    """(relative_path, diff) of the working tree against ``base``."""
    rows = []
    for part in _git(root, "diff", "--unified=0", base).split("diff --git ")[1:]:
        new = next((x[6:] for x in part.splitlines() if x.startswith("+++ b/")), None)
        if new:
            rows.append((new, part))
    return spark.createDataFrame(rows, "relative_path string, diff string")


def name_status(spark: SparkSession, root: str, base: str, head: str) -> DataFrame:
    """Name-status lines between two branches, in a column ``line``."""
    return spark.createDataFrame([(x,) for x in _git(root, "diff", "--name-status", f"{base}...{head}").splitlines() if x], "line string")
