"""A cache of results by key: only keys that it lacks are computed, and a repeated or killed append leaves every key once.

The keys' space is cut into ranges when the cache is made. An append writes the ranges that it touches anew, old rows and new ones merged in order of their keys,
into a folder of its own, and then commits by giving one small file its final name: it lists where each range lies. Until then readers see the state before; folders of
appends that never committed are not read. Two appends at once cannot both take the next name: the later one merges again."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

RANGES, TRIES = 64, 5


class ResultCache:
    """Results in ``path`` by the columns ``on``; ``schema`` is the DDL of a row."""

    def __init__(self, spark: SparkSession, path: str, on: list[str], schema: str):
        self.spark, self.path, self.on = spark, path.rstrip("/"), on
        self.schema = spark.createDataFrame([], schema).schema
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._files = self._path(self.path).getFileSystem(conf)
        self._context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._files.getUri(), conf)
        self._no_options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)

    def state(self) -> dict:
        """The last commit: its number, the ranges' limits, and the folder of each range that has rows."""
        found = self._files.globStatus(self._path(f"{self.path}/commit-*.json")) or []
        names = sorted(s.getPath().getName() for s in found)
        if not names:
            return {"number": 0, "limits": None, "folders": {}}
        text = self.spark.read.text(f"{self.path}/{names[-1]}", wholetext=True).first()["value"]
        return json.loads(text)

    def rows(self, ranges: list[int] | None = None) -> DataFrame:
        """All rows, or those of some ranges."""
        folders = self.state()["folders"]
        paths = [f"{self.path}/{folder}/range={k}" for k, folder in folders.items() if ranges is None or int(k) in ranges]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def missing(self, keys: DataFrame) -> DataFrame:
        """The distinct keys that the cache lacks."""
        return keys.select(*self.on).distinct().join(self.rows().select(*self.on), self.on, "left_anti")

    def _first_key(self):
        return F.col(self.on[0]).cast("string")

    def _ranged(self, rows: DataFrame, limits: list[str]) -> DataFrame:
        return rows.withColumn("range", F.size(F.filter(F.array(*map(F.lit, limits)) if limits else F.array().cast("array<string>"), lambda c: c <= self._first_key())))

    def append(self, results: DataFrame) -> None:
        """Adds the results whose keys the cache lacks; of results that repeat a key one is kept, the smallest."""
        columns = [f.name for f in self.schema]
        new = results.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema))
        for _ in range(TRIES):
            state = self.state()
            limits = state["limits"]
            if limits is None:
                # places that cut the first results' keys into about equal ranges; later keys fall between them
                spread = new.select(F.xxhash64(*self.on).alias("h"), self._first_key().alias("k")).where(F.col("h") % 16 == 0).select("k").distinct().orderBy(F.xxhash64("k")).limit(16 * RANGES).collect()
                drawn = sorted({r["k"] for r in spread if r["k"] is not None})
                limits = sorted({drawn[i * len(drawn) // RANGES] for i in range(1, RANGES)}) if drawn else []
            ranged = self._ranged(new, limits)
            touched = sorted(r["range"] for r in ranged.select("range").distinct().collect())
            if not touched:
                return
            both = ranged.withColumn("is_new", F.lit(1)).unionByName(self._ranged(self.rows(touched), limits).withColumn("is_new", F.lit(0)))
            one = Window.partitionBy(*self.on).orderBy("is_new", *(c for c in columns if c not in self.on))
            merged = both.withColumn("turn", F.row_number().over(one)).where("turn = 1").select("range", *columns)
            folder = f"rows-{uuid.uuid4().hex}"
            merged.repartitionByRange("range", *self.on).sortWithinPartitions("range", *self.on).write.partitionBy("range").parquet(f"{self.path}/{folder}")
            folders = state["folders"] | {str(k): folder for k in touched}
            if self._commit({"number": state["number"] + 1, "limits": limits, "folders": folders}):
                return
        raise RuntimeError(f"other appends came first {TRIES} times")

    def _commit(self, state: dict) -> bool:
        """Whether the state became the next commit."""
        draft, final = self._path(f"{self.path}/draft-{uuid.uuid4().hex}"), self._path(f"{self.path}/commit-{state['number']:012d}.json")
        out = self._files.create(draft)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        try:
            self._context.rename(draft, final, self._no_options)
        except Exception as error:
            self._files.delete(draft, False)
            if "FileAlreadyExists" in str(error):
                return False
            raise
        return True
