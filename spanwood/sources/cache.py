"""A cache of parsed files by content: what is known is not parsed again."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import extract as E

#: Goes up with every change of what an extractor finds.
VERSION = 1
#: Fixed value: the bytes of source text that a task parses, some.
BUDGET = 2 << 20
_SCHEMA = f"hash string, language string, version int, {E.PARSED.removeprefix('file string, ')}"


class ParseCache:
    """Results by content hash, language and extractor version, in a folder. Each run adds a part of its own, which counts once it is whole."""

    def __init__(self, spark: SparkSession, path: str, version: int = VERSION):
        self.spark, self.path, self.version = spark, path.rstrip("/"), version

    def known(self) -> DataFrame:
        """All results of this version. Two runs at once may have parsed one text twice, to the same result."""
        context = self.spark.sparkContext
        at = context._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = at.getFileSystem(context._jsc.hadoopConfiguration())
        parts = [s.getPath() for s in fs.listStatus(at)] if fs.exists(at) else []
        whole = [p.toString() for p in parts if fs.exists(context._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
        rows = [self.spark.read.schema(_SCHEMA).parquet(p) for p in sorted(whole)]
        found = reduce(DataFrame.unionByName, rows, self.spark.createDataFrame([], _SCHEMA)).filter(F.col("version") == self.version)
        return found.dropDuplicates(["hash", "language"]) if len(whole) > 1 else found

    def parse(self, files: DataFrame, budget: int = BUDGET) -> tuple[DataFrame, int]:
        """PARSED rows of files(path, language, text), and how many texts had to be parsed for them.

        Texts that are new, each once however many files hold it, are parsed in tasks of some `budget` bytes and added. A text
        that can't be parsed costs one row, with its error, and is not tried again in this version.
        """
        keyed = files.filter(F.col("language").isin(sorted(E.LANGUAGES))).select("path", "language", F.coalesce("text", F.lit("")).alias("text")).withColumn("hash", F.sha2("text", 256))
        new = keyed.join(self.known().select("hash", "language"), ["hash", "language"], "left_anti")
        # equal texts meet by their hash, and any of them will do
        new = new.groupBy("hash", "language").agg(F.min("path").alias("first"), F.max(F.octet_length("text")).alias("size"))
        n, size = new.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
        if n:
            texts = keyed.join(new.select("hash", "language", F.col("first").alias("path")), ["hash", "language", "path"], "left_semi").dropDuplicates(["hash", "language"])
            dealt = texts.repartition(max(1, -(-size // budget)), "hash")
            parsed = E.parsed(dealt.select(F.col("hash").alias("path"), "language", "text"), also=["language"])
            parsed.withColumnRenamed("file", "hash").withColumn("version", F.lit(self.version)).select(*[c.split()[0] for c in ("hash", "language", "version")], "definitions", "calls", "imports", "bases", "error").write.parquet(f"{self.path}/part-{uuid.uuid4().hex}")
        out = keyed.select(F.col("path").alias("file"), "hash", "language").join(self.known(), ["hash", "language"])
        return out.select("file", "definitions", "calls", "imports", "bases", "error"), n
