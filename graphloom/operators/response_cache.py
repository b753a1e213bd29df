"""Cache of responses by component and path of breadcrumbs, with expiry.

Saves and clears add segments: rows with their turn, the newest of which holds for its (component, key); a cleared entry is a row without a body that says so. A segment is partitioned by day,
so that expired days are dropped unread. After MOST segments, and at a sweep, what holds is written as one segment. Every change is one record (commits.py), so readers see whole states.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.functions.scalars import breadcrumb_key
from graphloom.operators import commits

#: Fixed value: days that an entry lives.
DAYS = 7
MOST = 16
_ROWS = "component_id string, key string, saved timestamp, body string, gone boolean, turn long"
_NAME = "responses"


class ResponseCache:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _segments(self) -> dict[str, str]:
        return commits.record(self.spark, self.path, _NAME)["tables"]

    def _rows(self, since: Column | None = None) -> DataFrame:
        out = self.spark.createDataFrame([], _ROWS)
        for folder in self._segments().values():
            part = self.spark.read.schema(f"{_ROWS}, day date").parquet(folder)
            out = out.unionByName((part if since is None else part.filter(F.col("day") >= F.to_date(since))).drop("day"))
        return out

    def _holding(self, since: Column | None = None) -> DataFrame:
        """The newest row of each entry, unless it was cleared. Days before `since` aren't read: an entry's newest row lies on no earlier day than its others, as long as clocks don't run backwards by a day."""
        place = F.row_number().over(Window.partitionBy("component_id", "key").orderBy(F.desc("turn"), F.desc("saved"), "body"))
        return self._rows(since).withColumn("_r", place).filter("_r = 1 and not gone").drop("_r")

    def _add(self, rows: DataFrame) -> None:
        turn = max([0, *(int(n) for n in self._segments())]) + 1
        made = rows.withColumns({"turn": F.lit(turn).cast("long"), "day": F.to_date("saved")}).select(*[c.split()[0] for c in _ROWS.split(", ")], "day")
        folder = commits.write(made, self.path, _NAME, "segment", ("day",))
        commits.commit(self.spark, self.path, _NAME, lambda old: old | {str(max([0, *map(int, old)]) + 1): folder})
        if len(self._segments()) > MOST:
            self._compact(None)

    def _compact(self, since: Column | None) -> None:
        seen = self._segments()
        if not seen:
            return
        rows = self._holding(since) if since is None else self._holding(since).filter(F.col("saved") >= since)
        folder = commits.write(rows.withColumn("day", F.to_date("saved")), self.path, _NAME, "segment", ("day",))
        commits.commit(self.spark, self.path, _NAME, lambda old: {k: v for k, v in old.items() if k not in seen} | {max(seen, key=int): folder})

    def save(self, rows: DataFrame) -> None:
        """Add or replace the entries of rows (component_id, crumbs, saved, body); of rows of one entry the latest holds."""
        self._add(rows.select("component_id", breadcrumb_key(F.col("crumbs")).alias("key"), "saved", "body", F.lit(False).alias("gone")))

    def entries(self, now: Column | None = None) -> DataFrame:
        """component_id, key, saved, body of all entries, or of those that live at `now`."""
        since = None if now is None else now - F.expr(f"INTERVAL {DAYS} DAYS")
        rows = self._holding(since)
        return (rows if since is None else rows.filter(F.col("saved") >= since)).select("component_id", "key", "saved", "body")

    def get(self, component: str, crumbs: Column, now: Column | None = None) -> DataFrame:
        """saved and body of one entry; with `now`, only if it lives."""
        return self.entries(now).filter((F.col("component_id") == component) & (F.col("key") == breadcrumb_key(crumbs))).select("saved", "body")

    def clear(self, component: str, crumbs: Column | None = None) -> None:
        """Drop a component's entries, or the one of a path of breadcrumbs."""
        there = self._holding().filter(F.col("component_id") == component)
        there = there if crumbs is None else there.filter(F.col("key") == breadcrumb_key(crumbs))
        self._add(there.withColumns({"body": F.lit(None).cast("string"), "gone": F.lit(True)}).drop("turn"))

    def clear_expired(self, now: Column) -> int:
        """Drop what has expired, and give how many entries that was."""
        since = now - F.expr(f"INTERVAL {DAYS} DAYS")
        expired = self._holding().filter(F.col("saved") < since).count()
        self._compact(since)
        return expired
