"""Ingestion as a stream over a landing folder: one state machine for each slot, failures as rows, restart from the checkpoint.

A landed file holds filings (ticker, fiscal_year, document_id, cik, filing_date, content). Filings of a slot meet its state: nothing yet, `failed`
or `completed`, with the digest of the content last read. A filing is read, its stated identity compared with its slot, and gives one
outcome row; whatever goes wrong in it is the reason of that row and touches no other slot. Content that was already read is not read again;
other content for a slot is, and may complete a failed slot or replace a completed one.

Outcomes and blocks are written by micro-batch, each to a folder of its own number that a repeated batch overwrites, so that a run which is killed and
started again from its checkpoint reads what is left and writes nothing twice. State lives in RocksDB under the checkpoint.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import StructType, _parse_datatype_string

from quillstone.functions.shipping import ship
from quillstone.operators import text, xbrl

LANDED = "ticker string, fiscal_year int, document_id string, cik string, filing_date string, content string"
BLOCKS = "array<struct<ord: int, text: string, location: string, is_table: boolean>>"
OUTCOME = f"ticker string, fiscal_year int, document_id string, digest string, attempt int, state string, reason string, parsed_count int, unresolved_count int, blocks {BLOCKS}"
_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def read_filing(content: str) -> dict:
    """What a filing states and holds: identity (the dei fields), blocks and observations."""
    return {"identity": xbrl.stated_identity(content), "blocks": text.html_blocks_of(content), "observations": xbrl.observations_of(content)}


def misfit(stated: dict, row: Row) -> str | None:
    """The first way in which a stated identity does not fit the slot of a landed row."""
    if any(stated.get(k) is None for k in ("documenttype", "documentfiscalyearfocus", "entitycentralindexkey")):
        return "identity field missing or stated in several ways"
    if stated["documenttype"] != "10-K":
        return "not an annual report"
    if stated["entitycentralindexkey"].zfill(10) != (row["cik"] or "").zfill(10):
        return "CIK differs"
    return None if stated["documentfiscalyearfocus"] == str(row["fiscal_year"]) else "fiscal year differs"


class SlotMachine(StatefulProcessor):
    """The state machine of a slot."""

    def __init__(self, reader: Callable[[str], dict]) -> None:
        self.reader = reader
        self.kind = _parse_datatype_string("digest string, state string, attempt int")  # on the driver: workers have no session

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.slot = handle.getValueState("slot", self.kind)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:  # noqa: N802, N803
        known = self.slot.get() if self.slot.exists() else None
        digest, state, attempt = known if known else (None, None, 0)
        for row in sorted(rows, key=lambda r: (r["filing_date"] or "", r["document_id"] or "")):
            own = hashlib.sha256((row["content"] or "").encode("utf-8", "surrogatepass")).hexdigest()
            if own == digest:
                continue
            digest, attempt = own, attempt + 1
            outcome = self.outcome(row)
            state = outcome["state"]
            yield Row(ticker=row["ticker"], fiscal_year=row["fiscal_year"], document_id=row["document_id"], digest=digest, attempt=attempt, **outcome)
        self.slot.update((digest, state, attempt))

    def outcome(self, row: Row) -> dict:
        """state, reason, counts and blocks of a filing; one that cannot be read is a failure of its slot alone."""
        failed = lambda why: {"state": "failed", "reason": why, "parsed_count": None, "unresolved_count": None, "blocks": None}
        try:
            if not row["content"]:
                return failed("not downloaded")
            found = self.reader(row["content"])
            if why := misfit(found["identity"], row):
                return failed(why)
            parsed = sum(o["status"] == "parsed" for o in found["observations"])
            blocks = [Row(**b) for b in found["blocks"]]
            return {"state": "completed", "reason": None, "parsed_count": parsed, "unresolved_count": len(found["observations"]) - parsed, "blocks": blocks}
        except Exception as error:  # any error of a reader belongs to its filing
            return failed(f"unreadable: {type(error).__name__}")

    def close(self) -> None:
        pass


def outcomes(landed: DataFrame, reader: Callable[[str], dict] = read_filing) -> DataFrame:
    """The outcomes of a stream of landed filings."""
    ship(landed.sparkSession)
    schema: StructType = _parse_datatype_string(OUTCOME)
    return landed.groupBy("ticker", "fiscal_year").transformWithState(SlotMachine(reader), schema, "Append", "None")


@contextmanager
def rocks(spark: SparkSession, partitions: int | None = None) -> Iterator[None]:
    """State that outgrows memory, and the only store for processors of state: for queries that start within. With `partitions`, state is dealt out to at
    most so many: each costs every micro-batch a store and a Python worker, whether it holds rows or not."""
    wanted = {"spark.sql.streaming.stateStore.providerClass": _PROVIDER}
    shuffle = "spark.sql.shuffle.partitions"
    if partitions is not None:
        wanted[shuffle] = str(min(partitions, int(spark.conf.get(shuffle))))
    before = {key: spark.conf.get(key, None) for key in wanted}
    for key, value in wanted.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value) if value else spark.conf.unset(key)


def start(spark: SparkSession, landing: str, folder: str, reader: Callable[[str], dict] = read_filing, per_trigger: int = 100, each: Callable[[int], None] | None = None) -> StreamingQuery:
    """Reads what has landed and not been read before, then ends. `each` is called with the number of a micro-batch before it is written."""

    def write(batch: DataFrame, number: int) -> None:
        if each is not None:
            each(number)
        batch.persist()
        try:
            batch.drop("blocks").write.mode("overwrite").parquet(f"{folder}/outcomes/batch={number}")
            found = batch.where("state = 'completed'").select("ticker", "fiscal_year", "document_id", "digest", F.explode("blocks").alias("b"))
            found.select("ticker", "fiscal_year", "document_id", "digest", "b.*").write.mode("overwrite").parquet(f"{folder}/blocks/batch={number}")
        finally:
            batch.unpersist()

    landed = spark.readStream.schema(LANDED).option("maxFilesPerTrigger", per_trigger).parquet(landing)
    with rocks(spark):
        return outcomes(landed, reader).writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()


def states(spark: SparkSession, folder: str, slots: DataFrame) -> DataFrame:
    """(ticker, fiscal_year, state, reason, document_id, digest, attempt) of each slot (ticker, fiscal_year): its last outcome, `pending` without one."""
    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in _parse_datatype_string(OUTCOME) if f.name != "blocks")
    seen = spark.read.schema(kind).parquet(f"{folder}/outcomes")
    last = seen.withColumn("turn", F.row_number().over(Window.partitionBy("ticker", "fiscal_year").orderBy(F.desc("attempt")))).where("turn = 1")
    joined = slots.select("ticker", "fiscal_year").distinct().join(last, ["ticker", "fiscal_year"], "left")
    return joined.select("ticker", "fiscal_year", F.coalesce("state", F.lit("pending")).alias("state"), "reason", "document_id", "digest", "attempt")


def status(found: DataFrame) -> str:
    """`completed` if every slot is, else `acquisition_incomplete`: nothing is published before."""
    return "completed" if found.where("state <> 'completed'").isEmpty() else "acquisition_incomplete"


def blocks(spark: SparkSession, folder: str, found: DataFrame) -> DataFrame:
    """The blocks of the filings that complete their slots now; those of replaced content stay out."""
    kind = "ticker string, fiscal_year int, document_id string, digest string, ord int, text string, location string, is_table boolean"
    good = found.where("state = 'completed'").select("ticker", "fiscal_year", "digest")
    return spark.read.schema(kind).parquet(f"{folder}/blocks").join(good, ["ticker", "fiscal_year", "digest"], "left_semi")
