"""Stored runs as tables: keyed commits and sealed versions, column projection, top-k retention, merging, campaigns, clean copies.

A run is a folder with a table of feature rows; rows are identified by instance_id and family_index. Appends go to the log,
sealed rows to shards, and both are read together.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quarry.operators.relational import audited, union_sealed_and_log

KEY = ["instance_id", "family_index"]
#: Parts of a run beside its feature rows, with their columns; the first ones, up to the number, are the key.
PARTS = {
    "instances": ("instance_id string, domain_id string, size int, seed long, params map<string,double>", 1),
    "instance_features": ("instance_id string, size int, generator string, scalars map<string,double>", 1),
    "reports": ("instance_id string, representation string, complexity double, status string", 2),
}


class Run:
    """A run's tables under one folder of the shared store.

    Appended rows are commits: folders of a part, such as log/<key>. Sealed rows are versions: shard/<number>. A pointer file,
    pointer/<number>, names the shard of that number and the commits of the log that it holds; the largest number is the run's
    state. Commits, versions and pointers are written under staging/ and come into being by one rename each, so a job that stops
    between any two steps leaves the state as it was, and a repeat adds nothing: a commit whose key is there, or sealed, is
    done, and a version that no pointer names is written anew. Sealed keys stay in the pointer: one short text a commit.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.jvm = spark._jvm.org.apache.hadoop.fs

    def at(self, name: str):
        """(file system, place) of a name in the run's folder."""
        place = self.jvm.Path(f"{self.path}/{name}" if name else self.path)
        return place.getFileSystem(self.spark._jsc.hadoopConfiguration()), place

    def names(self, folder: str) -> list[str]:
        files, place = self.at(folder)
        return sorted(f.getPath().getName() for f in files.listStatus(place)) if files.exists(place) else []

    def moved(self, staged: str, name: str) -> bool:
        """Renames what was staged; False where the name is taken."""
        files, place = self.at(name)
        files.mkdirs(place.getParent())
        return not files.exists(place) and files.rename(self.at(staged)[1], place)

    def staged(self, rows: DataFrame) -> str:
        name = f"staging/{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/{name}")
        return name

    def state(self) -> tuple[int, list[str]]:
        """(number of the shard, keys of the commits that it holds); (0, []) before the first seal."""
        numbers = [int(n) for n in self.names("pointer") if n.isdigit()]
        if not numbers:
            return 0, []
        text = self.spark.read.text(f"{self.path}/pointer/{max(numbers)}", wholetext=True).first()[0]
        return max(numbers), json.loads(text)

    def append(self, rows: DataFrame, part: str = "log", key: str | None = None) -> None:
        """A commit of rows; with a key, only the first of that key counts."""
        key = key or uuid.uuid4().hex
        if key in self.names(part) or (part == "log" and key in self.state()[1]):
            return
        staged = self.staged(rows)
        if not self.moved(staged, f"{part}/{key}"):
            self.reset(staged)

    def persist(self, rows: DataFrame, arrays: DataFrame | None, key: str) -> None:
        """Instance rows and their arrays under one key; arrays first, so that no row that is there lacks them."""
        if arrays is not None:
            self.append(arrays.select(*KEY, "values"), "arrays", key)
        self.append(rows, "log", key)

    def table(self, part: str, but: list[str] = ()) -> DataFrame | None:
        """The part's commits, without those named in `but`; None where there are none."""
        kept = [f"{self.path}/{part}/{n}" for n in self.names(part) if n not in set(but)]
        return self.spark.read.option("mergeSchema", True).parquet(*kept) if kept else None

    def shard(self) -> DataFrame | None:
        number, _ = self.state()
        return self.spark.read.parquet(f"{self.path}/shard/{number}") if number else None

    def seal(self) -> None:
        """All rows that the run has become a new shard. Readers follow the pointer; the last shard stays until vacuum()."""
        number, sealed = self.state()
        fresh = [n for n in self.names("log") if n not in set(sealed)]
        if not fresh:
            return
        self.reset(f"shard/{number + 1}")  # of a seal that stopped before its pointer
        if not self.moved(self.staged(self.features()), f"shard/{number + 1}"):
            raise RuntimeError(f"shard {number + 1} is being sealed by another job")
        staged = f"staging/{uuid.uuid4().hex}"
        files, place = self.at(staged)
        out = files.create(place)
        out.write(bytearray(json.dumps([*sealed, *fresh]).encode()))
        out.close()
        if not self.moved(staged, f"pointer/{number + 1}"):
            raise RuntimeError(f"shard {number + 1} was sealed by another job")

    def vacuum(self) -> None:
        """Removes what is not part of the state: sealed commits, older shards and pointers, leftovers of stopped jobs. No other
        job may be reading or writing the run."""
        number, sealed = self.state()
        old = [f"{p}/{n}" for p in ("shard", "pointer") for n in self.names(p) if n != str(number)]
        self.reset("staging", *[f"log/{n}" for n in self.names("log") if n in set(sealed)], *old)

    def features(self) -> DataFrame | None:
        """Sealed rows, and logged rows that are not sealed."""
        _, sealed = self.state()
        shard, log = self.shard(), self.table("log", sealed)
        if shard is None or log is None:
            return log if shard is None else shard
        return union_sealed_and_log(shard, log, KEY)

    def put(self, part: str, rows: DataFrame, key: str | None = None) -> None:
        """A commit of rows of a typed part: a missing column or another type raises, and so does a null in the key, before
        anything is there to read."""
        wanted, keys = StructType.fromDDL(PARTS[part][0]), PARTS[part][1]
        have = {f.name: f.dataType for f in rows.schema}
        wrong = [f"{f.name}: {have[f.name].simpleString() if f.name in have else 'missing'}, not {f.dataType.simpleString()}" for f in wanted if have.get(f.name) != f.dataType]
        if wrong:
            raise TypeError(f"{part}: " + "; ".join(wrong))
        names = wanted.names
        checked = [F.coalesce(F.col(c), F.raise_error(F.lit(f"{part} without {c}")).cast(wanted[c].dataType)).alias(c) for c in names[:keys]]
        self.append(rows.select(*checked, *names[keys:]), part, key)

    def get(self, part: str) -> DataFrame:
        """The typed part: of rows with one key the one of the first commit by name, whatever the order of files."""
        wanted, keys = StructType.fromDDL(PARTS[part][0]), PARTS[part][1]
        commits = self.names(part)
        if not commits:
            return self.spark.createDataFrame([], wanted)
        rows = reduce(DataFrame.union, [self.spark.read.schema(wanted).parquet(f"{self.path}/{part}/{c}").withColumn("_commit", F.lit(c)) for c in commits])
        names = wanted.names
        # of equal keys in one commit the smallest by its text: maps have no order
        order = F.struct("_commit", F.to_json(F.struct(*names)))
        first = F.min_by(F.struct(*names[keys:]), order).alias("row")
        return rows.groupBy(*names[:keys]).agg(first).select(*names[:keys], *[F.col("row")[c].alias(c) for c in names[keys:]])

    def reset(self, *parts: str) -> None:
        """Removes parts of the run: all of it if none is named."""
        for name in parts or ("",):
            files, place = self.at(name)
            files.delete(place, True)

    def save_arrays(self, arrays: DataFrame, key: str | None = None) -> None:
        """Appends arrays (instance_id, family_index, values)."""
        self.append(arrays.select(*KEY, "values"), "arrays", key)

    def arrays(self) -> DataFrame:
        found = self.table("arrays")
        return found if found is not None else self.spark.createDataFrame([], "instance_id long, family_index int, values array<double>")

    def completed(self) -> DataFrame:
        rows = self.features()
        return rows.select(*KEY).distinct() if rows is not None else self.spark.createDataFrame([], "instance_id long, family_index int")

    def complete(self, expected: int) -> bool:
        """Whether every expected row is there."""
        return self.completed().count() >= expected

    def export(self, target: str, form: str = "parquet") -> None:
        """One flat table with columns in order of name, identity first."""
        rows = self.features()
        if rows is not None:
            writer = rows.select(ordered_fields(rows)).write.mode("error")
            writer.option("header", True).csv(target) if form == "csv" else writer.parquet(target)


def ordered_fields(rows: DataFrame) -> list[str]:
    """Identity columns first, then the others by name."""
    first = [c for c in (*KEY, "size", "generator") if c in rows.columns]
    return [*first, *sorted(set(rows.columns) - set(first))]


def projected(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Identity and the named columns that exist: a scan reads no others."""
    return rows.select([c for c in ordered_fields(rows) if c in columns or c in (*KEY, "size", "generator")])


def retained(rows: DataFrame, target: str, scores: DataFrame, most: int) -> DataFrame:
    """Identity, target and the `most` columns with the strongest correlation (scores: candidate, r); ties by name."""
    kept = scores.where("r IS NOT NULL").orderBy(F.desc(F.abs("r")), "candidate").limit(most).collect()  # at most `most` names
    return projected(rows, [target, *[r["candidate"] for r in kept]])


def merged_runs(runs: dict[str, DataFrame]) -> DataFrame:
    """Rows of several runs under one schema, each with its run's name; columns that a run lacks are null there."""
    named = [rows.withColumn("run_id", F.lit(name)) for name, rows in sorted(runs.items())]
    out = named[0]
    for rows in named[1:]:
        out = out.unionByName(rows, allowMissingColumns=True)
    return out


def campaign(shards: dict[str, DataFrame]) -> DataFrame:
    """Sealed shards together; of rows with one key the one of the first shard by name stays."""
    first = F.min_by(F.struct("*"), F.col("run_id")).alias("row")
    return merged_runs(shards).groupBy(*KEY).agg(first).select("row.*")


def clean(rows: DataFrame, target: str, catalog: DataFrame) -> DataFrame:
    """The rows without columns that the audit blocks; identity and target stay."""
    names = [c for c in rows.columns if c not in (*KEY, "size", "generator", target)]
    listed = rows.sparkSession.createDataFrame([(n,) for n in names], "feature string")
    allowed = {r["feature"] for r in audited(listed, catalog).where("NOT blocked").collect()}  # names of columns
    return rows.select([c for c in rows.columns if c not in names or c in allowed])


def manifest(runs: dict[str, DataFrame]) -> DataFrame:
    """Per run: rows, instances, sizes, a fingerprint of the rows and a mark of their keys; neither depends on the rows' order. The
    mark is the sum of 60-bit digests of the keys' text."""
    rows = merged_runs(runs)
    columns = [c for c in rows.columns if c != "run_id"]
    text = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in KEY])
    digest = F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("decimal(20,0)")
    return rows.groupBy("run_id").agg(
        F.count("*").alias("rows"), F.countDistinct("instance_id").alias("instances"), F.countDistinct("size").alias("sizes"),
        F.bit_xor(F.xxhash64(*columns)).alias("fingerprint"), F.sum(digest).cast("string").alias("mark"),
    )


def missing_instances(rows: DataFrame, instances: DataFrame) -> DataFrame:
    """Instance records to add: instances that have rows and no record, with the size and generator of their first row."""
    per = rows.groupBy("instance_id").agg(F.min_by(F.struct("size", "generator"), "family_index").alias("first"))
    return per.join(instances.select("instance_id").distinct(), "instance_id", "left_anti").select("instance_id", "first.*")


def numeric_columns(rows: DataFrame, prefix: str = "") -> list[str]:
    """Names of numeric columns that are no identity, optionally of one family such as `metric.`."""
    kinds = ("double", "float", "int", "bigint", "smallint", "tinyint")
    return [c for c, t in rows.dtypes if (t in kinds or t.startswith("decimal")) and c not in (*KEY, "size", "seed") and c.startswith(prefix)]


def with_arrays(rows: DataFrame, arrays: DataFrame, vector: str = "values") -> DataFrame:
    """rows with their stored array; null where none is stored. Arrays: KEY and the vector; of repeated keys one counts."""
    return rows.join(arrays.select(*KEY, vector).dropDuplicates(KEY), KEY, "left")


def with_target(rows: DataFrame, targets: DataFrame, target: str) -> DataFrame:
    """rows with the target of their key; null where it is missing."""
    return rows.join(targets.select(*KEY, target).dropDuplicates(KEY), KEY, "left")
