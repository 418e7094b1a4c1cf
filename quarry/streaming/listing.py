"""Continuous scans over a folder's listing: a stream source of listings and the change of every path as keyed state.

``FolderListing`` is a streaming data source without contents: each trigger lists the folder anew, in the tasks, hidden names
and all, and stamps the rows with the trigger's time.  ``listing_changes`` keeps one small state row a path (mtime,
size, dictionary fingerprint) in the state store and lets through what is new, changed, or gone.  The scan then opens the changed
files by path, as the batch jobs do, so no content travels through the stream and files of any size are taken.
"""

from __future__ import annotations

import time
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quarry.sources.files import children, file_system, qualified

LISTED = "path string, rel_path string, size long, mtime timestamp, error string, listed_at timestamp"
CHANGED = "rel_path string, path string, size long, mtime timestamp, error string, change string, listed_at timestamp"
STATE = "mtime_us long, size long, fingerprint string, path string, expires long"
WIDE = 64                 # folders that a trigger's planning goes down to, if there are so many


class _Folder(InputPartition):
    def __init__(self, rel: str, deep: bool, at: int):
        self.rel, self.deep, self.at = rel, deep, at


_EPOCH = datetime.fromtimestamp(0, timezone.utc)


def _utc(micros: int) -> datetime:
    return _EPOCH + timedelta(microseconds=micros)


def _micros(at: datetime | None) -> int | None:
    """Microseconds since 1970; a time without a zone is of the worker's own."""
    return None if at is None else (at.astimezone(timezone.utc) - _EPOCH) // timedelta(microseconds=1)


class _ListingReader(DataSourceStreamReader):
    """Offsets are trigger times in ms; the rows of a trigger are the listing at that time, whatever came before."""

    def __init__(self, options: dict):
        self.root, self.exclude = options["path"], options.get("exclude") or None

    def initialOffset(self):
        return {"at": 0}

    def latestOffset(self):
        return {"at": int(time.time() * 1000)}

    def partitions(self, start, end):
        """Folders to list, one a task; planning itself goes down until there are ``WIDE`` of them and holds their names only."""
        system, base = self._system()
        out, todo = [], [""]
        while todo and len(todo) < WIDE:
            out += [_Folder(rel, False, end["at"]) for rel in todo]
            todo = [own for rel in todo for own, folder, *_ in self._own(system, base, rel) if folder]
        return out + [_Folder(rel, True, end["at"]) for rel in todo]

    def _system(self):
        system, base = file_system(self.root)
        return system, base.rstrip("/")

    def _own(self, system, base, rel):
        try:
            for name, folder, size, mtime, error in children(system, f"{base}/{rel}".rstrip("/") or "/"):
                own = f"{rel}/{name}" if rel else name
                if own != self.exclude:
                    yield own, folder, size, mtime, error
        except Exception as e:
            yield rel, False, None, None, f"{type(e).__name__}: {e}"

    def read(self, partition):
        system, base = self._system()
        at, todo = _utc(1000 * partition.at), [partition.rel]
        while todo:
            for own, folder, size, mtime, error in self._own(system, base, todo.pop()):
                if not folder:
                    yield f"{self.root}/{own}", own, size, None if mtime is None else _utc(mtime), error, at
                elif partition.deep:
                    todo.append(own)

    def commit(self, end):
        pass


class FolderListing(DataSource):
    """``spark.readStream.format("folder_listing").option("path", folder)``; ``exclude`` is a folder below it that is left out."""

    @classmethod
    def name(cls):
        return "folder_listing"

    def schema(self):
        return LISTED

    def streamReader(self, schema):
        return _ListingReader(self.options)


def listing_stream(spark: SparkSession, root: str, exclude: str | None = None) -> DataFrame:
    spark.dataSource.register(FolderListing)
    return spark.readStream.format("folder_listing").option("path", qualified(spark, root)).option("exclude", exclude or "").load()


class _Changes(StatefulProcessor):
    """One path's state; a timer after its last listing, which each listing renews, finds it gone."""

    def __init__(self, fingerprint: str):
        self.fingerprint = fingerprint

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("seen", STATE)

    def handleInputRows(self, key, rows, timerValues):
        latest = max(rows, key=lambda r: (r.listed_at, _micros(r.mtime) or 0, r.size or -1))
        old = self.state.get() if self.state.exists() else None
        if old is not None:
            self.handle.deleteTimer(old[4])
        expires = _micros(latest.listed_at) // 1000 + 1
        self.handle.registerTimer(expires)
        new = (_micros(latest.mtime), latest.size, self.fingerprint, latest.path, expires)
        self.state.update(new)
        if old is None or tuple(old[:3]) != new[:3]:
            yield Row(rel_path=key[0], path=latest.path, size=latest.size, mtime=latest.mtime, error=latest.error,
                      change="new" if old is None else "changed", listed_at=latest.listed_at)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        # a timer that the path's last listing set; the watermark has passed it, so a later listing was without the path
        old = self.state.get() if self.state.exists() else None
        if old is None or old[4] != expiredTimerInfo.getExpiryTimeInMs():
            return
        self.state.clear()
        yield Row(rel_path=key[0], path=old[3], size=old[1], mtime=None if old[0] is None else _utc(old[0]), error="", change="gone",
                  listed_at=_utc(1000 * timerValues.getCurrentWatermarkInMs()))

    def close(self) -> None:
        pass


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def listing_changes(listings: DataFrame, fingerprint: str) -> DataFrame:
    """A stream of listings to the paths that are ``new``, ``changed`` (mtime, size or dictionary) or ``gone`` since the one before.

    ``listings`` has the columns of ``LISTED``; all rows of one listing have one ``listed_at``.  State is one row a path in the
    RocksDB state store, spread by path; nothing is held in memory.  A path that is listed again after it was gone is new.
    That a path is gone is told in the batch after, when the watermark has passed its last listing; ``listed_at`` then is
    the time of the listing without it (listings are expected one a batch, in order).
    """
    listings.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    return (listings.withWatermark("listed_at", "0 seconds").groupBy("rel_path")
            .transformWithState(statefulProcessor=_Changes(fingerprint), outputStructType=CHANGED, outputMode="Update", timeMode="EventTime"))
