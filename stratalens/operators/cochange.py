"""Files that change together, and votes of commits for files."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratalens.functions import fixed

from .scratch import PART_ROWS, spread


def cochange_pairs(commit_files: DataFrame, commit: str = "sha", file: str = "file", support: int = 1, most_files: int | None = None) -> DataFrame:
    """a, b, n: pairs a < b of files in the same commit and in how many commits, with at least ``support``.

    Pairs are made by one self-join on the commit. A commit of k files makes k(k-1)/2 pairs; ``most_files`` leaves sweeping
    commits out where the caller wants that. Commits, and then pairs, whose number the commits' sizes tell, are dealt to
    partitions of bounded rows, so the tables that a task sorts and counts stay small; few pairs are combined before the
    shuffle.
    """
    both = commit_files.select(F.col(commit).alias("c"), F.col(file).alias("f")).where("c IS NOT NULL AND f IS NOT NULL")
    rows = commit_files.count()
    cf = spread(both, rows, "c").distinct()
    sizes = cf.groupBy("c").agg(F.count("*").alias("k"))
    if most_files is not None:
        cf = cf.withColumn("_n", F.count("*").over(Window.partitionBy("c"))).where(F.col("_n") <= most_files).drop("_n")
        sizes = sizes.where(F.col("k") <= most_files)
    pairs = cf.select("c", F.col("f").alias("a")).join(cf.select("c", F.col("f").alias("b")), "c").where("a < b").select("a", "b")
    if rows > PART_ROWS // 8:
        pairs = spread(pairs, int(sizes.agg(F.sum(F.col("k") * (F.col("k") - 1) / 2)).first()[0] or 0), "a", "b")
    return pairs.groupBy("a", "b").agg(F.count("*").alias("n")).where(F.col("n") >= support)


def partners(pairs: DataFrame, k: int = 5) -> DataFrame:
    """file, partner, n: each file's k most frequent partners; ties by partner."""
    both = pairs.select(F.col("a").alias("file"), F.col("b").alias("partner"), "n").union(pairs.select(F.col("b").alias("file"), F.col("a").alias("partner"), "n"))
    w = Window.partitionBy("file").orderBy(F.desc("n"), "partner")
    return both.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= k).drop("_rank")


def commit_votes(commits: DataFrame, commit_files: DataFrame, terms: list[str], message: str = "message", order: str = "ord") -> DataFrame:
    """file, votes, first_commits, boost: commits whose message holds a term vote for their files."""
    low = F.lower(F.col(message))
    hit = F.lit(False)
    for t in terms:
        hit = hit | F.contains(low, F.lit(t.lower()))
    voters = commits.where(hit).select("sha", F.col(order).alias("_ord"))
    votes = commit_files.select("sha", "file").distinct().join(voters, "sha").groupBy("file").agg(F.count("*").alias("votes"), F.slice(F.transform(F.array_sort(F.collect_list(F.struct("_ord", "sha"))), lambda x: x.sha), 1, 3).alias("first_commits"))
    return votes.withColumn("boost", fixed.COMMIT_VOTE + fixed.COMMIT_VOTE_MORE * (F.col("votes") - 1))


def cochange_boost(candidates: DataFrame, pairs: DataFrame, voted: DataFrame) -> DataFrame:
    """Candidate files that change together with a voted file, and what that adds."""
    both = pairs.select(F.col("a").alias("file"), F.col("b").alias("other")).union(pairs.select(F.col("b").alias("file"), F.col("a").alias("other")))
    near = both.join(voted.select(F.col("file").alias("other")), "other", "left_semi").select("file").distinct()
    return candidates.join(near, "file", "left_semi").withColumn("boost", F.lit(fixed.COCHANGE_BOOST))
