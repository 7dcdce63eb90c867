"""Sources of filings: company submissions and facts as JSON, and an interface for fetching with allow-list and retries."""

from __future__ import annotations

import re
import time
from collections.abc import Callable
from dataclasses import dataclass, field
from email.utils import parsedate_to_datetime
from urllib.parse import urlsplit

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.operators.ingestion import transpose

HOSTS = ("www.sec.gov", "data.sec.gov")
TRANSIENT = (408, 429, 500, 502, 503, 504)
_COLUMNS = ["accessionNumber", "filingDate", "reportDate", "form", "primaryDocument"]
_TABLE = "struct<" + ",".join(f"{c}:array<string>" for c in _COLUMNS) + ">"
SUBMISSIONS = f"cik string, filings struct<recent:{_TABLE},files:array<struct<name:string>>>"


def submissions(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(filings, violations) of raw submissions (url, content string, cik: whose they should be): recent tables and archives.

    A main file holds `filings`, an archive the table itself; files of another company, archives with odd names and tables of
    unequal columns are violations and give no rows.
    """
    parsed = raw.withColumn("main", F.from_json("content", SUBMISSIONS)).withColumn("archive", F.from_json("content", _TABLE)).withColumn("is_main", F.col("main.filings").isNotNull())
    name = F.element_at(F.split("url", "/"), -1)
    other = F.col("is_main") & ~F.lpad(F.col("main.cik"), 10, "0").eqNullSafe(F.col("cik"))
    odd = ~F.col("is_main") & ~name.rlike(r"^CIK\d{10}-submissions-\d+\.json$")
    foreign = ~F.col("is_main") & ~name.startswith(F.concat(F.lit("CIK"), F.col("cik"), F.lit("-")))
    marked = parsed.withColumn("reason", F.when(F.col("main").isNull() & F.col("archive").isNull(), "not a JSON object").when(other, "entity differs").when(odd, "unexpected archive name").when(foreign, "archive of another entity"))
    tables = marked.where("reason IS NULL").withColumn("t", F.when(F.col("is_main"), F.col("main.filings.recent")).otherwise(F.col("archive"))).select("url", "cik", *(F.col("t")[c].alias(c) for c in _COLUMNS))
    rows, uneven = transpose(tables, ["url", "cik"], _COLUMNS)
    return rows.drop("ord"), marked.where("reason IS NOT NULL").select("url", "cik", "reason").union(uneven)


def source_hashes(raw: DataFrame) -> DataFrame:
    """(cik, hashes): a map of each source's address to the checksum of its content."""
    return raw.groupBy("cik").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("url", F.sha2(F.col("content"), 256).alias("sha"))))).alias("hashes"))


def allowed(url: str, hosts: tuple[str, ...] = HOSTS) -> bool:
    parts = urlsplit(url)
    return parts.scheme == "https" and parts.hostname in hosts and not (parts.username or parts.password or parts.port or parts.query or parts.fragment)


def retry_after(header: str | None, now: float, cap: float = 60.0) -> float | None:
    """Seconds to wait by a Retry-After header, in seconds or as a date; capped; None where it says nothing."""
    if not header:
        return None
    if re.fullmatch(r"\d+", header.strip()):
        return min(float(header), cap)
    try:
        return min(max(0.0, parsedate_to_datetime(header).timestamp() - now), cap)
    except (TypeError, ValueError):
        return None


@dataclass
class Fetcher:
    """Fetches allowed addresses through a transport (url -> status, headers, body), spaced and retried. No redirects."""

    transport: Callable[[str], tuple[int, dict[str, str], bytes]]
    attempts: int = 4
    spacing: float = 0.25
    clock: Callable[[], float] = time.time
    sleep: Callable[[float], None] = time.sleep
    _last: float = field(default=float("-inf"), init=False)

    def get(self, url: str) -> bytes:
        if not allowed(url):
            raise ValueError("address is not allowed")
        for n in range(self.attempts):
            self.sleep(max(0.0, self._last + self.spacing - self.clock()))
            self._last = self.clock()
            status, headers, body = self.transport(url)
            if status == 200:
                return body
            if status not in TRANSIENT or n + 1 == self.attempts:
                raise OSError(f"status {status}")
            wait = retry_after(headers.get("Retry-After"), self.clock())
            self.sleep(wait if wait is not None else min(0.5 * 2**n, 60.0))
        raise OSError("no attempt left")
