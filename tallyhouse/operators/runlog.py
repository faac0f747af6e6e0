"""A log of runs that can be trusted after a crash.

Each attempt of a run writes an opening entry before it does anything and a final entry when it has ended, well or not; entries are small files that are
written whole or not at all and never again. So a killed attempt is one without a final entry, a repeated final entry changes nothing, and a run that has ended well is not done twice.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhouse.sources import shared

ENTRY = "run string, attempt int, at double, ok boolean, counts map<string, bigint>, error string"
LONGEST_ERROR = 500


class RunLog:
    def __init__(self, spark: SparkSession, folder: str, clock: Callable[[], float] = time.time):
        self.spark, self.folder, self.clock = spark, folder.rstrip("/"), clock

    def _put(self, run: str, attempt: int, kind: str, **more: object) -> bool:
        return shared.put_text(self.spark, f"{self.folder}/{run}/{attempt:06d}-{kind}.json", json.dumps({"run": run, "attempt": attempt, "at": self.clock()} | more))

    def open(self, run: str) -> int:
        """The number of a new attempt, whose opening entry is written."""
        attempt = 1 + max((int(n[:6]) for n in shared.names(self.spark, f"{self.folder}/{run}") if n[:6].isdigit()), default=0)
        while not self._put(run, attempt, "open"):
            attempt += 1  # another has just taken that number
        return attempt

    def close(self, run: str, attempt: int, ok: bool, counts: dict[str, int] | None = None, error: str | None = None) -> bool:
        """Write the final entry; False if the attempt has one."""
        return self._put(run, attempt, "final", ok=ok, counts=counts or {}, error=error[:LONGEST_ERROR] if error else None)

    def done(self, run: str) -> bool:
        """Whether the run has ended well. If the log can't be read the answer is yes: what is done twice can't be undone, what is missed can be made up."""
        try:
            finals = [n for n in shared.names(self.spark, f"{self.folder}/{run}") if n.endswith("-final.json")]
            return any(json.loads(shared.read_text(self.spark, f"{self.folder}/{run}/{n}"))["ok"] for n in finals)
        except Exception:  # unsure: whatever the reason, the careful answer
            return True

    def run(self, run: str, work: Callable[[], dict[str, int]]) -> str:
        """Do the work and log it: "done", or "already" if it had been. An error is logged and raised again."""
        if self.done(run):
            return "already"
        attempt = self.open(run)
        try:
            counts = work()
        except BaseException as e:
            self.close(run, attempt, False, error=f"{type(e).__name__}: {e}")
            raise
        self.close(run, attempt, True, counts)
        return "done"

    def table(self) -> DataFrame:
        """(run, attempt, started, finished, ok, counts, error) of every attempt; finished is null for those that were killed or still run."""
        entries = self.spark.read.schema(ENTRY).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").json(self.folder).withColumn("final", F.col("_metadata.file_name").endswith("-final.json"))
        of = lambda c: F.max(F.when(F.col("final"), F.col(c)))
        counts = F.first(F.when(F.col("final"), F.col("counts")), ignorenulls=True)
        return entries.groupBy("run", "attempt").agg(F.min(F.when(~F.col("final"), F.col("at"))).alias("started"), of("at").alias("finished"), F.coalesce(of("ok"), F.lit(False)).alias("ok"), counts.alias("counts"), of("error").alias("error"))
