"""Commit history of a git work tree, and the forges' exports.

The driver asks git for the commits' names only; what each changed is read in tasks, a slice of commits each, so the log of a
large history is never on the driver. Executors need the work tree (a shared folder), as they need any other source.
"""

from __future__ import annotations

import os
import re
import subprocess

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions.text import issue_refs

CHANGE = "commit string, author string, email string, ts timestamp, subject string, path string, old_path string, status string, added long, deleted long"
STATUS = {"A": "Added", "M": "Modified", "D": "Deleted", "R": "Renamed", "C": "Copied", "T": "Modified"}
HUNK = re.compile(r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@")


def git(repo: str, *args: str) -> str:
    return subprocess.run(["git", "-c", "core.quotepath=off", "-C", repo, *args], capture_output=True, check=True).stdout.decode("utf-8", "replace")


def forced(repo: str, last: str | None) -> bool:
    """SRC2: whether the last commit read is no ancestor of HEAD any more, so that all has to be read again."""
    if not last:
        return False
    return subprocess.run(["git", "-C", repo, "merge-base", "--is-ancestor", last, "HEAD"], capture_output=True).returncode != 0


def commit_names(repo: str, last: str | None = None, most: int = 0) -> list[str]:
    """SRC1: oldest first, after `last` unless history was rewritten; the newest `most` of them (0: all)."""
    span = "HEAD" if not last or forced(repo, last) else f"{last}..HEAD"
    return git(repo, "rev-list", *([f"--max-count={most}"] if most else []), span).split()[::-1]


def parse_log(text: str) -> list[tuple]:
    """Rows of CHANGE from what `git log --raw --numstat` prints; a commit without changes gives a row without a path."""
    out = []
    for entry in text.split("\x1e")[1:]:
        head, _, body = entry.partition("\n")
        sha, name, mail, at, subject = head.split("\x1f")
        base = (sha, name, mail, pd.Timestamp(int(at), unit="s"), subject)
        status, stats = {}, {}
        for line in body.split("\n"):
            if line.startswith(":"):
                meta, *paths = line.split("\t")
                code = meta.split()[-1][0]
                status[paths[-1]] = (code, paths[0] if len(paths) > 1 else None)
            elif line.count("\t") == 2:
                a, d, path = line.split("\t")
                stats[new_path(path)] = (int(a) if a != "-" else 0, int(d) if d != "-" else 0)
        out += [(*base, p, old, STATUS.get(code, "Modified"), *stats.get(p, (0, 0))) for p, (code, old) in status.items()] or [(*base, None, None, None, None, None)]
    return out


def new_path(shown: str) -> str:
    """A numstat's path after a rename, which it shows as 'a/{b => c}/d' or 'b => c'."""
    if " => " not in shown:
        return shown
    m = re.match(r"^(.*)\{(.*) => (.*)\}(.*)$", shown)
    return re.sub("//+", "/", m[1] + m[3] + m[4]) if m else shown.split(" => ")[1]


def history(spark: SparkSession, repo: str, last: str | None = None, most: int = 0, each: int = 500) -> DataFrame:
    """SRC1-4: a row a file that a commit changed, against its first parent; renames found by likeness; binary files count 0 lines."""
    names = commit_names(repo, last, most)
    slices = [(" ".join(names[i : i + each]),) for i in range(0, len(names), each)]
    if not slices:
        return spark.createDataFrame([], CHANGE)
    fmt = "--format=%x1e%H%x1f%an%x1f%ae%x1f%at%x1f%s"

    def run(it):
        for b in it:
            for s in b["names"]:
                text = subprocess.run(["git", "-c", "core.quotepath=off", "-C", repo, "log", "--no-walk=unsorted", "--stdin", "--root", "-m", "--first-parent", "-M", "--raw", "--numstat", fmt], input=s.replace(" ", "\n").encode(), capture_output=True, check=True).stdout
                yield pd.DataFrame(parse_log(text.decode("utf-8", "replace")), columns=[c.split()[0] for c in CHANGE.split(", ")]).astype({"added": "Int64", "deleted": "Int64"})

    return spark.createDataFrame(slices, "names string").repartition(len(slices)).mapInPandas(run, CHANGE)


def tags(spark: SparkSession, repo: str) -> DataFrame:
    """SRC6: (tag, commit, ts), tags of tags peeled."""
    rows = [tuple(x.split("\x1f")) for x in git(repo, "for-each-ref", "refs/tags", "--format=%(refname:short)%1f%(if)%(*objectname)%(then)%(*objectname)%(else)%(objectname)%(end)%1f%(creatordate:unix)").splitlines()]
    return spark.createDataFrame([(t, c, int(at or 0)) for t, c, at in rows], "tag string, commit string, at long").select("tag", "commit", F.timestamp_seconds("at").alias("ts"))


def release_commits(tags_: DataFrame, commits: DataFrame) -> DataFrame:
    """SRC7: commits (commit, n: place from the oldest on, along first parents) with the first release at or after them. Only the
    releases are put in order; commits meet the stretches between them by blocks of places, so no task walks through all."""
    from pyspark.sql import Window as W

    t = commits.join(tags_.select("commit", "tag"), "commit").groupBy("n").agg(F.min("tag").alias("release"))
    t = t.withColumn("lo", F.coalesce(F.lag("n").over(W.orderBy("n")) + 1, F.lit(0)))
    t = t.select("release", "lo", F.col("n").alias("hi"), F.explode(F.sequence(F.floor(F.col("lo") / 1024), F.floor(F.col("n") / 1024))).alias("block"))
    return commits.withColumn("block", F.floor(F.col("n") / 1024)).join(t, "block").filter("n BETWEEN lo AND hi").select("release", "commit")


def name_status(spark: SparkSession, repo: str, old: str, new: str) -> DataFrame:
    """SRC31: (status, path, old_path) between two commits."""
    rows = []
    for line in git(repo, "diff", "--name-status", "-M", old, new).splitlines():
        code, *p = line.split("\t")
        rows.append((STATUS.get(code[0], "Modified"), p[-1], p[0] if len(p) > 1 else None))
    return spark.createDataFrame(rows, "status string, path string, old_path string")


def hunks(patch: str) -> list[tuple[int, int, int, int]]:
    """SRC4: (old start, old lines, new start, new lines) of a patch's hunks."""
    return [(int(m[1]), int(m[2] or 1), int(m[3]), int(m[4] or 1)) for line in patch.splitlines() if (m := HUNK.match(line))]


PULL = "number bigint, title string, state string, body string, merged_at string, merge_commit_sha string, user struct<login:string>"
ISSUE = "number bigint, title string, state string, body string, labels array<struct<name:string>>, user struct<login:string>, pull_request string"
MERGE = "iid bigint, title string, state string, description string, merged_at string, author struct<username:string>, merge_commit_sha string"


def pulls(raw: DataFrame, after: int = 0, forge: str = "github") -> DataFrame:
    """SRC25, SRC26: raw (value: a pull or merge request in JSON) above a number: name, author, merge, and the issues it closes."""
    if forge == "github":
        j = raw.select(F.from_json("value", PULL).alias("j")).select("j.*")
        p = j.select("number", "title", "state", "body", F.col("user.login").alias("author"), "merged_at", "merge_commit_sha", F.concat(F.lit("PR#"), "number").alias("name"))
    else:
        j = raw.select(F.from_json("value", MERGE).alias("j")).select("j.*")
        p = j.select(F.col("iid").alias("number"), "title", "state", F.col("description").alias("body"), F.col("author.username").alias("author"), "merged_at", "merge_commit_sha", F.concat(F.lit("MR!"), "iid").alias("name"))
    p = p.filter(F.col("number") > after)
    return p.withColumn("merged_at", F.try_to_timestamp("merged_at")).withColumn("resolves", issue_refs(F.coalesce("body", F.lit("")), strict=False))


def issues(raw: DataFrame, after: int = 0) -> DataFrame:
    """SRC25: issues above a number; those that are pull requests are left out."""
    j = raw.select(F.from_json("value", ISSUE).alias("j")).select("j.*").filter("pull_request IS NULL").filter(F.col("number") > after)
    return j.select("number", F.concat(F.lit("Issue#"), "number").alias("name"), "title", "state", F.col("user.login").alias("author"), F.transform(F.coalesce("labels", F.array().cast("array<struct<name:string>>")), lambda x: x["name"]).alias("labels"))


def mentions(pulls_: DataFrame, issues_: DataFrame) -> DataFrame:
    """(pull, issue) where the body names '#n': numbers are taken from the texts, so the join is on equality."""
    n = pulls_.select(F.col("number").alias("pull"), F.explode(F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce("body", F.lit("")), F.lit(r"#(\d+)"), F.lit(1)), lambda x: x.cast("long")))).alias("issue"))
    return n.join(issues_.select(F.col("number").alias("issue")), "issue").select("pull", "issue")


def worktree_exists(repo: str) -> bool:
    return os.path.exists(os.path.join(repo, ".git"))
