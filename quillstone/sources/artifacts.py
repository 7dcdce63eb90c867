"""Sources and sinks: artifacts with explicit schemas, integrity-checked caches, versioned publication, a ledger of appends.

A publication writes each table into a folder of its version, then the checksums of its files, and a pointer last; readers follow the
pointer, so they see all tables of one version or none. Everything goes through Spark's file systems.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.utils import AnalysisException

from quillstone.operators.checks import require_empty, row_violations


def read_json(spark: SparkSession, path: str, schema: StructType | str, default: DataFrame | None = None, multiline: bool = True) -> DataFrame:
    """JSON with its schema; malformed text fails, and only a missing path gives the default."""
    try:
        return spark.read.schema(schema).option("multiLine", multiline).option("mode", "FAILFAST").json(path)
    except AnalysisException as error:
        if default is not None and error.getCondition() == "PATH_NOT_FOUND":
            return default
        raise


def cached_bytes(spark: SparkSession, folder: str, meta: DataFrame) -> DataFrame:
    """(path, content, usable, reason) of cached files against their metadata (path, format, sha256, byte_count)."""
    files = spark.read.format("binaryFile").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("path"), "content")
    joined = files.join(meta, "path", "left")
    reason = F.when(F.col("sha256").isNull(), "no metadata").when(F.col("format") != 1, "other format").when(F.octet_length("content") != F.col("byte_count"), "length differs").when(F.sha2("content", 256) != F.col("sha256"), "checksum differs")
    return joined.select("path", "content", reason.isNull().alias("usable"), reason.alias("reason"))


def store_sources(sources: DataFrame, folder: str) -> None:
    """Adds fetched sources (url, content binary) to a cache: contents first, then their metadata, which readers check contents against."""
    named = sources.select(F.sha2(F.col("url"), 256).alias("key"), "url", "content")
    named.write.mode("append").parquet(f"{folder}/content")
    named.select("key", "url", F.lit(1).alias("format"), F.sha2("content", 256).alias("sha256"), F.octet_length("content").cast("long").alias("byte_count"), F.current_timestamp().alias("stored_at")).write.mode("append").parquet(f"{folder}/meta")


def cached_sources(spark: SparkSession, folder: str) -> DataFrame:
    """(url, content) of the cache: of each address the content that its last metadata describe; contents without them, or others, are to be fetched anew."""
    meta = spark.read.parquet(f"{folder}/meta").where("format = 1")
    last = meta.groupBy("key").agg(F.max_by(F.struct("url", "sha256", "byte_count"), F.struct("stored_at", "sha256")).alias("m")).select("key", "m.*")
    content = spark.read.parquet(f"{folder}/content").select("key", "content").withColumn("real", F.sha2("content", 256))
    found = content.join(last, (content["key"] == last["key"]) & (F.col("real") == F.col("sha256")) & (F.octet_length("content") == F.col("byte_count")))
    return found.select(last["url"], "content").dropDuplicates(["url"])


def file_digests(spark: SparkSession, folder: str) -> DataFrame:
    """(file, length, sha256) of the data files below a folder, from their bytes and before any is decoded."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(folder)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file"), "length", F.sha2("content", 256).alias("sha256"))


def publish(tables: dict[str, DataFrame], folder: str, version: str, config: dict | None = None) -> None:
    """Writes all tables of a version, the checksums of their files, then the pointer. A failure before leaves the old version in force."""
    spark = next(iter(tables.values())).sparkSession
    digests = None
    for name, df in tables.items():
        path = f"{folder}/version={version}/{name}"
        df.write.mode("errorifexists").parquet(path)
        one = file_digests(spark, path).select(F.lit(name).alias("table"), "*")
        digests = one if digests is None else digests.union(one)
    digests.write.mode("errorifexists").parquet(f"{folder}/version={version}/_files")
    manifest = json.dumps({"version": version, "tables": sorted(tables), "config": config or {}}, sort_keys=True)
    row = spark.createDataFrame([(version, manifest, _last_turn(spark, folder) + 1)], "version string, manifest string, turn long")
    row.coalesce(1).write.mode("append").parquet(f"{folder}/_published")


def _pointers(spark: SparkSession, folder: str) -> DataFrame | None:
    try:
        return spark.read.schema("version string, manifest string, turn long").parquet(f"{folder}/_published")
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def _last_turn(spark: SparkSession, folder: str) -> int:
    found = _pointers(spark, folder)
    return found.agg(F.coalesce(F.max("turn"), F.lit(-1))).first()[0] if found is not None else -1


def manifest(spark: SparkSession, folder: str, version: str | None = None) -> dict:
    """What was published as the given version, or as the last one: the last by turn, whatever became of the files' times."""
    found = _pointers(spark, folder)
    if found is None:
        raise ValueError("nothing is published")
    chosen = found.where(F.col("version") == version) if version else found
    row = chosen.agg(F.max_by("manifest", "turn")).first()[0]
    if row is None:
        raise ValueError(f"version {version} is not published")
    return json.loads(row)


def file_violations(spark: SparkSession, folder: str, version: str) -> DataFrame:
    """Files of a version that are missing, unexpected or whose bytes differ from those published."""
    path = f"{folder}/version={version}"
    said = spark.read.parquet(f"{path}/_files").select("file", F.col("sha256").alias("said"))
    tables = manifest(spark, folder, version)["tables"]
    real = None
    for name in tables:
        one = file_digests(spark, f"{path}/{name}")
        real = one if real is None else real.union(one)
    joined = said.join(real.select("file", "sha256"), "file", "full_outer")
    return row_violations(joined, "file", F.col("file"), [(F.col("sha256").isNull(), "missing"), (F.col("said").isNull(), "unexpected"), (F.col("said") != F.col("sha256"), "checksum differs")])


def published(spark: SparkSession, folder: str, name: str, version: str | None = None, verify: bool = False) -> DataFrame:
    """A table of the given or the last published version; `verify` compares the checksums of the version's files first."""
    chosen = manifest(spark, folder, version)["version"]
    if verify:
        require_empty(file_violations(spark, folder, chosen))
    return spark.read.parquet(f"{folder}/version={chosen}/{name}")


class Ledger:
    """A table to which several writers append in transactions.

    A batch is written to a folder of its own and comes into force with an entry in the log: a file with the batch's name, renamed to
    the next number, which fails where another writer has taken it. That writer's batch is then checked against, and the next number
    is tried. Readers see the batches of the log, so a batch is there in whole or not at all. The driver holds one name an append.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: str):
        self.spark, self.folder, self.schema = spark, folder.rstrip("/"), schema
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(f"{self.folder}/_log").toUri(), spark._jsc.hadoopConfiguration())
        self._files = self._path(f"{self.folder}/_log").getFileSystem(spark._jsc.hadoopConfiguration())
        self._files.mkdirs(self._path(f"{self.folder}/_log"))

    def _entries(self) -> list[str]:
        """The batches in force, in order of their numbers."""
        log = self.spark.read.text(f"{self.folder}/_log").select("value", F.col("_metadata.file_name").alias("n"))
        return [r["value"] for r in sorted(log.collect(), key=lambda r: r["n"])]

    def read(self) -> DataFrame:
        return self._read(self._entries())

    def _read(self, entries: list[str]) -> DataFrame:
        paths = [f"{self.folder}/{e}" for e in entries]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def append(self, batch: DataFrame, check: Callable[[DataFrame, DataFrame], DataFrame], attempts: int = 20) -> int:
        """Appends the batch if check(rows there, batch) gives no violation, else nothing; returns the entry's number."""
        name = f"batch-{uuid.uuid4().hex}"
        own = f"{self.folder}/{name}"
        batch.write.parquet(own)
        written = self.spark.read.schema(self.schema).parquet(own)
        try:
            for _ in range(attempts):
                entries = self._entries()
                bad = check(self._read(entries), written).limit(3).collect()
                if bad:
                    raise ValueError("; ".join(map(str, bad)))
                if self._claim(len(entries), name):
                    return len(entries)
            raise RuntimeError("other writers kept taking the next entry")
        except BaseException:
            self._files.delete(self._path(own), True)
            raise

    def _claim(self, number: int, name: str) -> bool:
        made, entry = self._path(f"{self.folder}/_log/.{name}"), self._path(f"{self.folder}/_log/{number:012d}")
        out = self._files.create(made, False)
        out.write(bytearray(name, "ascii"))
        out.close()
        gateway = self.spark.sparkContext._gateway
        try:
            self._context.rename(made, entry, gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 0))
        except Exception:
            self._files.delete(made, False)
            if self._files.exists(entry):
                return False
            raise
        return True


def write_guarded(df: DataFrame, source: str, output: str, overwrite: bool = False) -> None:
    """Writes where nothing is, or over what is if told so, but never over the source."""
    if source.rstrip("/") == output.rstrip("/"):
        raise ValueError("output is the source")
    df.write.mode("overwrite" if overwrite else "errorifexists").json(output)


def load_guarded(spark: SparkSession, folder: str, names: list[str], version: str | None = None, verify: bool = True) -> tuple[dict[str, DataFrame], str | None]:
    """(tables, load_error): all tables of a published version, or none and why; a broken store is a state, not a crash."""
    try:
        chosen = manifest(spark, folder, version)
        if missing := sorted(set(names) - set(chosen["tables"])):
            return {}, f"tables are missing: {', '.join(missing)}"
        if verify:
            require_empty(file_violations(spark, folder, chosen["version"]))
        return {n: spark.read.parquet(f"{folder}/version={chosen['version']}/{n}") for n in names}, None
    except (ValueError, AnalysisException) as error:
        return {}, f"artifacts are unreadable or malformed: {str(error).splitlines()[0][:200]}"

