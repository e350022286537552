"""A graph that is kept up to date with changes of files, a version for each batch.

Files define symbols and refer to names. A reference leads to the symbol of that name in its own file, else in its folder,
else to an exported one anywhere, each time the one of smallest id. So a file's edges depend on other files, and a change
must write anew the edges of more files than it names: its write set.

A version holds what a batch replaced and nothing else: the files it names with their symbols and references, and the edges
of its write set. A file's rows are those of the last version that wrote it. A version counts once its last part is there.
While a batch is under way a marker says so; whoever finds it there builds all edges anew.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators.steps import cut, discard

SYMBOLS = "file string, id long, name string, exported boolean"
REFERENCES = "file string, source_id long, name string, kind string"
EDGES = "file string, source_id long, target_id long, kind string"
FILES = "file string, ts timestamp, tie long, present boolean"
#: Gives the symbols and references of files(file, ts, tie), as SYMBOLS and REFERENCES.
Parse = Callable[[DataFrame], tuple[DataFrame, DataFrame]]


def newest(changes: DataFrame) -> DataFrame:
    """The last change (file, ts, tie, present) of each file: a burst of changes to it counts as one."""
    return changes.groupBy("file").agg(F.max(F.struct("ts", "tie", "present")).alias("c")).select("file", "c.ts", "c.tie", "c.present")


def least(symbols: DataFrame, *keys: str) -> DataFrame:
    return symbols.groupBy(*keys).agg(F.min("id").alias("target"))


def resolved(references: DataFrame, symbols: DataFrame) -> DataFrame:
    """Edges of references to symbols. For every key there is one candidate, so a common name makes no more rows."""
    symbols = symbols.withColumn("dir", X.directory(F.col("file")))
    out = references.distinct().withColumn("dir", X.directory(F.col("file")))
    tiers = [(symbols, ["name", "file"]), (symbols, ["name", "dir"]), (symbols.filter("exported"), ["name"])]
    for k, (some, keys) in enumerate(tiers):
        out = out.join(least(some, *keys).withColumnRenamed("target", f"t{k}"), keys, "left")
    return out.select("file", "source_id", F.coalesce("t0", "t1", "t2").alias("target_id"), "kind").filter("target_id is not null").distinct()


class GraphState:
    """The graph in a folder."""

    def __init__(self, spark: SparkSession, path: str, parse: Parse):
        self.spark, self.path, self.parse = spark, path.rstrip("/"), parse

    # files and folders

    def _hadoop(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _fs(self):
        return self._hadoop("").getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        """Versions that count, from the last full one on."""
        fs, path = self._fs(), self._hadoop("")
        names = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
        done = sorted(int(n[1:]) for n in names if n[1:].isdigit() and fs.exists(self._hadoop(f"{n}/edges/_SUCCESS")))
        full = [v for v in done if fs.exists(self._hadoop(f"v{v:06}/full"))]
        return [v for v in done if v >= full[-1]] if full else done

    def _part(self, name: str, schema: str, since: int = -1, until: int | None = None) -> DataFrame:
        parts = [self.spark.read.schema(schema).parquet(f"{self.path}/v{v:06}/{name}").withColumn("version", F.lit(v)) for v in self.versions() if v > since and (until is None or v <= until)]
        return reduce(DataFrame.unionByName, parts, self.spark.createDataFrame([], f"{schema}, version int"))

    def _live(self, name: str, schema: str, of: str, until: int | None = None) -> DataFrame:
        """Rows of a part that the last version to write their file has, by its list `of` of files."""
        last = self._part(of, "file string", until=until).groupBy("file").agg(F.max("version").alias("version"))
        return self._part(name, schema, until=until).join(last, ["file", "version"], "left_semi").drop("version")

    # what there is

    def files(self, until: int | None = None) -> DataFrame:
        """The last change of each file known."""
        return self._live("files", FILES, "files", until)

    def symbols(self, until: int | None = None) -> DataFrame:
        return self._live("symbols", SYMBOLS, "files", until)

    def references(self, until: int | None = None) -> DataFrame:
        return self._live("references", REFERENCES, "files", until)

    def edges(self, until: int | None = None) -> DataFrame:
        return self._live("edges", EDGES, "wrote", until)

    # changes

    def apply(self, changes: DataFrame, full: bool = False) -> int | None:
        """Bring the graph up to changes(file, ts, tie, present); the new version's number, or None if nothing is new.

        Only a file's newest change counts, and only if it is newer than the one known, so batches may come twice, late
        and in any split. Null files are left out. A first batch, one after a batch that broke off, and one with `full`
        write all edges; the version then stands alone.
        """
        fs, marker = self._fs(), self._hadoop("in_progress")
        broken = fs.exists(marker)
        fs.create(marker, True).close()
        known = self.versions()
        full = full or broken or not known
        before = self.files().select("file", F.struct("ts", "tie").alias("known"))
        new = newest(changes.filter("file is not null")).join(before, "file", "left")
        new = cut(new.filter(F.col("known").isNull() | (F.struct("ts", "tie") > F.col("known"))).select("file", "ts", "tie", "present"))
        if new.isEmpty() and not full:
            fs.delete(marker, False)
            return None
        symbols, references = (cut(df) for df in self.parse(new.filter("present")))
        old = self.symbols()
        kept = old.join(new, "file", "left_anti")
        now = kept.unionByName(symbols)
        asked = self.references().join(new, "file", "left_anti").unionByName(references)
        wrote = new.select("file")
        if full:
            wrote = wrote.unionByName(asked.select("file")).distinct()
        else:
            touched = old.join(new, "file", "left_semi").unionByName(symbols).select("name").distinct()
            wrote = wrote.unionByName(self._depending(asked, old.join(touched, "name", "left_semi"), now.join(touched, "name", "left_semi"))).distinct()
        wrote = cut(wrote)
        edges = resolved(asked.join(wrote, "file", "left_semi"), now)
        # a version that broke off is never read, and its number is not used again
        version = max([int(s.getPath().getName()[1:]) for s in fs.listStatus(self._hadoop("")) if s.getPath().getName()[1:].isdigit()], default=-1) + 1
        at = f"{self.path}/v{version:06}"
        whole = full and bool(known)
        (self.files().join(new, "file", "left_anti").unionByName(new) if whole else new).write.parquet(f"{at}/files")
        (now if whole else symbols).write.parquet(f"{at}/symbols")
        (asked if whole else references).write.parquet(f"{at}/references")
        wrote.write.parquet(f"{at}/wrote")
        if full:
            fs.create(self._hadoop(f"v{version:06}/full"), True).close()
        edges.write.parquet(f"{at}/edges")
        fs.delete(marker, False)
        for df in (new, symbols, references, wrote):
            discard(df)
        return version

    @staticmethod
    def _depending(references: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
        """Files with a reference whose candidate in its folder, or anywhere, is another one after the change."""

        def moved(condition: str, *keys: str) -> DataFrame:
            pick = [least(df.withColumn("dir", X.directory(F.col("file"))).filter(condition), *keys) for df in (before, after)]
            both = pick[0].withColumnRenamed("target", "was").join(pick[1], list(keys), "full_outer")
            return both.filter(~F.col("was").eqNullSafe(F.col("target"))).select(*keys)

        placed = references.select("file", "name", X.directory(F.col("file")).alias("dir"))
        near = placed.join(moved("true", "name", "dir"), ["name", "dir"], "left_semi")
        far = placed.join(moved("exported", "name"), "name", "left_semi")
        return near.select("file").unionByName(far.select("file"))

    def delta(self, version: int) -> DataFrame:
        """(change, source_id, target_id, kind) of edges that a version added or removed, from its write set's edges alone."""
        wrote = self.spark.read.schema("file string").parquet(f"{self.path}/v{version:06}/wrote")
        now = self.spark.read.schema(EDGES).parquet(f"{self.path}/v{version:06}/edges")
        was = self.edges(until=version - 1).join(wrote, "file", "left_semi")
        cols = ["source_id", "target_id", "kind"]
        gone, new = was.select(*cols).exceptAll(now.select(*cols)), now.select(*cols).exceptAll(was.select(*cols))
        return gone.withColumn("change", F.lit("removed")).unionByName(new.withColumn("change", F.lit("added"))).select("change", *cols)

    def watch(self, stream: DataFrame, checkpoint: str, pushed: Callable[[int, DataFrame], None] | None = None) -> None:
        """Apply all that a stream of changes(file, ts, tie, present) has, batch by batch, and push each version's delta."""

        def build(batch: DataFrame, _: int) -> None:
            version = self.apply(batch)
            if version is not None and pushed:
                pushed(version, self.delta(version))

        stream.writeStream.foreachBatch(build).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def present(event_type: Column) -> Column:
    """Whether an event leaves its file there."""
    return event_type != "error"
