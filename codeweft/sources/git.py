"""git history as rows: log parsing in Spark, repository discovery and revisions on the driver."""

from __future__ import annotations

import subprocess
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Arguments of the log whose text ``parse_log`` reads: a header per commit, then touched paths, then a blank line.
LOG_FORMAT = ["--pretty=# %h|%an|%ct|%ae", "--name-only"]


def parse_log(logs: DataFrame, text: str = "log") -> DataFrame:
    """``(repo, hash, author, ts, email, file)`` of ``logs(repo, log)``, one row per touched path; a commit without paths has one with null.

    A commit starts at '# hash|name|epoch|mail'; lines that are no such header and not blank are paths.  The hash stands before the
    first bar, mail and time behind the last two, so a name may hold bars.
    """
    blocks = logs.select("repo", F.explode(F.split(F.concat(F.lit("\n"), F.col(text)), "\n# ")).alias("block")).where(F.col("block").contains("|"))
    lines = F.split("block", "\n")
    head = F.split(lines[0], r"\|")
    paths = F.filter(F.slice(lines, F.lit(2), F.size(lines)), lambda x: F.trim(x) != "")
    cut = blocks.select("repo", head.alias("h"), paths.alias("paths")).where(F.size("h") >= 4)
    name = F.array_join(F.slice("h", F.lit(2), F.size("h") - 3), "|")
    return cut.select("repo", F.col("h")[0].alias("hash"), name.alias("author"), F.try_to_number(F.element_at("h", -2), F.lit("S999999999999999999")).cast("bigint").alias("ts"), F.element_at("h", -1).alias("email"), F.explode_outer("paths").alias("file"))


def read_log(spark: SparkSession, repository: str, since: str = "1.year") -> DataFrame:
    """Commits of a repository on the driver's disk since ``since``."""
    out = subprocess.run(["git", "-C", repository, "log", f"--since={since}", *LOG_FORMAT], capture_output=True, text=True, check=True).stdout
    return parse_log(spark.createDataFrame([(repository, out)], "repo string, log string"))


def find_root(path: str) -> str | None:
    """The folder above ``path`` that holds .git, or None."""
    here = Path(path).resolve()
    for folder in [here, *here.parents]:
        if (folder / ".git").exists():
            return str(folder)
    return None


def _git(repository: str, *args: str) -> str:
    return subprocess.run(["git", "-C", repository, *args], capture_output=True, text=True, check=True).stdout.strip()


def resolve(repository: str, ref: str) -> str | None:
    """The commit that a branch, tag or hash stands for, also one known by its remote only; None where there is none."""
    for name in (ref, f"origin/{ref}"):
        try:
            return _git(repository, "rev-parse", "--verify", "--quiet", f"{name}^{{commit}}")
        except subprocess.CalledProcessError:
            continue
    return None


def merge_base(repository: str, ref: str) -> str:
    """The last commit that HEAD and ``ref`` share."""
    return _git(repository, "merge-base", "HEAD", ref)


def worktree(repository: str, ref: str, target: str) -> str:
    """A detached working tree of ``ref`` at ``target``, so that two revisions can be scanned side by side."""
    _git(repository, "worktree", "add", "--detach", target, ref)
    return target


def checkout(repository: str, ref: str) -> None:
    """Switch the repository's own working tree to ``ref``; raises where local changes stand in the way."""
    _git(repository, "checkout", "--quiet", ref)
