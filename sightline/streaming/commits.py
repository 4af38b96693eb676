"""Tables that grow by commits: what one commit writes, to however many tables, is seen as a whole or not at all.

A commit writes its rows as Parquet files first and then one small file, named by the commit's number, that tells where they
are. Readers go by these files, so rows that a lost writer left behind are never seen. A commit of an id that is there
already changes nothing, which makes replays of a streaming batch harmless. Writers that meet take turns: the one that
comes second takes the next number, or is told so if what it wrote rests on what it had read.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sightline.sources.folders import names, put_new, qualified

_COMMIT = "version bigint, id string, tables map<string, string>"


class Outdated(Exception):
    """Another commit has come between what a writer read and its own."""


class Commits:
    """The commits below a folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, qualified(spark, path)

    def _files(self, since: int = -1) -> list[str]:
        return [n for n in names(self.spark, f"{self.path}/commits") if n.endswith(".json") and int(n[:-5]) > since]

    def version(self) -> int:
        """The last commit's number; -1 before the first."""
        return max((int(n[:-5]) for n in self._files()), default=-1)

    def told(self, since: int = -1) -> DataFrame:
        """(version, id, tables) of the commits after `since`."""
        files = [f"{self.path}/commits/{n}" for n in self._files(since)]
        return self.spark.read.schema(_COMMIT).json(files) if files else self.spark.createDataFrame([], _COMMIT)

    def has(self, commit_id: str) -> bool:
        return not self.told().filter(F.col("id") == commit_id).isEmpty()

    def commit(self, tables: dict[str, DataFrame], commit_id: str | None = None, expected: int | None = None) -> int | None:
        """Adds rows to the tables, and returns the commit's number; None if commit_id was committed before.

        expected is the version that the rows rest on: Outdated is raised if there is a later one.
        """
        commit_id = commit_id or uuid.uuid4().hex
        if self.has(commit_id):
            return None
        folders = {name: f"data/{name}/{uuid.uuid4().hex}" for name in tables}
        for name, df in tables.items():
            df.write.parquet(f"{self.path}/{folders[name]}")
        while True:
            last = self.version()
            if expected is not None and last != expected:
                raise Outdated(f"version {last} is there, {expected} was read")
            # a replay may have come first while the rows were written
            if self.has(commit_id):
                return None
            text = json.dumps({"version": last + 1, "id": commit_id, "tables": folders})
            if put_new(self.spark, f"{self.path}/commits/{last + 1:012d}.json", text):
                return last + 1

    def read(self, name: str, schema: str, since: int = -1, until: int | None = None) -> DataFrame:
        """The rows of a table from the commits after `since`, up to and with `until`, with _version, the number of theirs."""
        told = self.told(since).filter(F.col("tables")[name].isNotNull())
        if until is not None:
            told = told.filter(F.col("version") <= until)
        told = told.select("version", F.concat(F.lit(f"{self.path}/"), F.col("tables")[name]).alias("folder"))
        found = told.collect()  # a row a commit
        if not found:
            return self.spark.createDataFrame([], schema).withColumn("_version", F.lit(0).cast("long"))
        rows = self.spark.read.schema(schema).parquet(*[r["folder"] for r in found])
        folder = F.regexp_replace(F.input_file_name(), "/[^/]*$", "")
        # stores write a path in several ways; a commit's folder has a name of its own
        own = self.spark.createDataFrame([(r["folder"].rsplit("/", 1)[1], r["version"]) for r in found], "_folder string, _version long")
        return rows.withColumn("_folder", F.regexp_extract(folder, "([^/]+)$", 1)).join(F.broadcast(own), "_folder").drop("_folder")

    def latest(self, name: str, schema: str, keys: list[str], until: int | None = None) -> DataFrame:
        """The row that the last commit has of each key, with _version. Keys are unique within a commit."""
        newest = Window.partitionBy(*keys).orderBy(F.col("_version").desc())
        return self.read(name, schema, until=until).withColumn("_nth", F.row_number().over(newest)).filter("_nth = 1").drop("_nth")

    def new_commits(self) -> DataFrame:
        """The commits as a stream, for whoever follows them with a position of their own (a checkpoint)."""
        return self.spark.readStream.schema(_COMMIT).option("maxFilesPerTrigger", 1000).json(f"{self.path}/commits")


def follow(commits: Commits, name: str, schema: str, since: int, emit: Callable[[DataFrame], None]):
    """A foreachBatch function for new_commits(): hands emit the rows that the commits after `since` added to a table, in one
    DataFrame with _version. A subscriber that has read a table up to `since` gets every later row once, whenever it
    begins to follow; one that begins again goes on where its checkpoint says."""

    def write(batch: DataFrame, epoch: int) -> None:
        found = sorted(r["version"] for r in batch.filter(F.col("version") > since).select("version").collect())
        if found:
            rows = commits.read(name, schema, since=found[0] - 1, until=found[-1])
            emit(rows.filter(F.col("_version").isin(found)))

    return write


def change_rows(commits: Commits, channels: dict[str, tuple[str, str]], key: str, wanted: list[str], since: int | None, state: str) -> tuple[DataFrame, int]:
    """(channel, version, key, body) that a subscriber of the wanted keys gets next, and the number up to which that is.

    channels name a table and its schema each. With since None the subscriber is new: it gets the last row that the state
    channel has of its keys, and then, with the number returned, all channels' rows from there on; nothing is lost or
    doubled in between, as both sides go by the commits' numbers.
    """
    until = commits.version()
    out = []
    for channel, (name, schema) in channels.items():
        if since is None:
            if channel != state:
                continue
            rows = commits.latest(name, schema, [key], until)
        else:
            rows = commits.read(name, schema, since, until)
        own = [c for c in rows.columns if c != "_version"]
        out.append(rows.filter(F.col(key).isin(*wanted)).select(F.lit(channel).alias("channel"), F.col("_version").alias("version"), F.col(key).alias("key"), F.to_json(F.struct(*own)).alias("body")))
    first, *rest = out
    for df in rest:
        first = first.unionByName(df)
    return first, until


def worked_out_once(commits: Commits, name: str, schema: str, wanted: DataFrame, work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """A read-through store: the rows of the wanted recordings (video_id, mark), worked out only where they are not yet there.

    mark tells a recording's state (its file's size and time, a hash of its frames): with another mark it is worked out
    anew. work gets the missing (video_id, mark) and returns rows of schema, which has video_id. Two writers may work out
    the same recording; what the first commit holds counts.
    """
    marks = "video_id bigint, mark string"
    wanted = wanted.select("video_id", "mark").distinct()

    def known() -> DataFrame:
        first = commits.read(f"{name}_marks", marks).groupBy("video_id", "mark").agg(F.min("_version").alias("_version"))
        return wanted.join(first, ["video_id", "mark"])

    missing = wanted.join(commits.read(f"{name}_marks", marks), ["video_id", "mark"], "left_anti")
    if not missing.isEmpty():
        commits.commit({name: work(missing), f"{name}_marks": missing})
    return commits.read(name, schema).join(known(), ["video_id", "_version"]).drop("_version", "mark")
