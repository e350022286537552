"""Co-change of files in commits, and checks that sum up a graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .steps import dealt


def _small(commits: DataFrame, max_files: int) -> DataFrame:
    """Commits of at most max_files files, so that a commit gives a bounded number of pairs."""
    sizes = commits.groupBy("sha").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") <= max_files)
    return commits.join(sizes.select("sha"), "sha", "left_semi")


def cochange(commits: DataFrame, max_files: int = 50, least: int = 3) -> DataFrame:
    """(file_a, file_b, n, jaccard, last_epoch) of files that changed together in `least` commits or more."""
    some = _small(commits, max_files)
    a, b = some.select("sha", F.col("file").alias("file_a"), "epoch"), some.select("sha", F.col("file").alias("file_b"))
    pairs = dealt(a.join(b, "sha").filter("file_a < file_b"), commits.count(), "file_a", "file_b").groupBy("file_a", "file_b").agg(F.count(F.lit(1)).alias("n"), F.max("epoch").alias("last_epoch")).filter(F.col("n") >= least)
    each = some.groupBy("file").agg(F.count(F.lit(1)).alias("c"))
    out = pairs.join(each.select(F.col("file").alias("file_a"), F.col("c").alias("ca")), "file_a").join(each.select(F.col("file").alias("file_b"), F.col("c").alias("cb")), "file_b")
    return out.select("file_a", "file_b", "n", F.round(F.col("n") / (F.col("ca") + F.col("cb") - F.col("n")), 8).alias("jaccard"), "last_epoch")


def partners(commits: DataFrame, file, least: int = 1) -> DataFrame:
    """(file, n, share) of what changed along with one file; share is of that file's commits."""
    own = commits.filter(F.col("file") == file).select("sha")
    total = own.count()
    with_it = commits.join(own, "sha", "left_semi").filter(F.col("file") != file)
    return with_it.groupBy("file").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least).withColumn("share", F.round(F.col("n") / max(total, 1), 8))


def audit(nodes: DataFrame, edges: DataFrame, most_uncalled: float = 0.5) -> DataFrame:
    """A row for each check: (check, value, passed)."""
    called = edges.filter("kind = 'calls'").select(F.col("target_id").alias("id")).distinct().withColumn("called", F.lit(True))
    f = nodes.join(called, "id", "left").agg(
        F.count(F.lit(1)).alias("symbols"),
        F.count_if((F.col("kind").isin("function", "method")) & F.col("called").isNull() & ~F.col("exported")).alias("dead"),
        F.count_if(F.col("kind").isin("function", "method")).alias("functions"),
        F.count_if(F.col("docstring").isNull()).alias("undocumented"),
    )
    checks = F.array(
        F.struct(F.lit("symbols").alias("check"), F.col("symbols").alias("value"), (F.col("symbols") > 0).alias("passed")),
        F.struct(F.lit("dead").alias("check"), F.col("dead").alias("value"), (F.col("dead") <= F.col("functions") * most_uncalled).alias("passed")),
        F.struct(F.lit("undocumented").alias("check"), F.col("undocumented").alias("value"), (F.col("undocumented") * 2 < F.col("symbols")).alias("passed")),
    )
    return f.select(F.explode(checks).alias("c")).select("c.*")
