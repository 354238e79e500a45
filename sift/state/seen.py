"""What was seen before, kept in append-only Parquet logs.

    <root>/_commits/<number>.json   what stands: see ``sift.state.commits``
    <root>/sightings/run=<run>      one row per fingerprint of a batch
    <root>/rejects/run=<run>        rows of the batch that are no postings, and why
    <root>/routed/run=<run>         the new rows of the batch that have a route
    <root>/notified/run=<run>       fingerprints alerted by the batch
    <root>/collected/run=<run>      what the batch brought, until it is committed
    <root>/base_<K>_<run>           the merged state up to batch K, bucketed by key
    <root>/bloom_<K>_<run>          which keys each of its buckets may hold

Every try of a batch writes files under a name of its own. One commit makes its
sightings and rejects the batch's, another its routed rows and marks; until then nobody
sees them, so a run that breaks off before its first commit leaves no trace.

Any number of writers may share a store. A batch has its place among the others when it
is committed: it is new against all batches with lower ids, and these are committed by
then. A writer that finds its id passed by another's is moved behind it, with the files
it has written, or is refused where the id was given by hand. Committing a batch id again
replaces what stood for it and comes to the same result. A batch is remembered as soon as
its sightings are committed: if it breaks off after that, later batches take its postings
as known, and they are alerted only when the same batch id is run again.
"""

from __future__ import annotations

import hashlib
import time
import uuid
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from sift.operators.dedup import KEY, not_known, not_known_small
from sift.schema import COLLECTED, NOTIFIED, REJECT, ROUTED, SIGHTING, STATE
from sift.state import bloom
from sift.state.commits import Commits, Conflict, View

_LOGS = {
    "collected": COLLECTED, "rejects": REJECT, "sightings": SIGHTING, "routed": ROUTED,
    "notified": NOTIFIED,
}

# Keys of a batch up to this many rows (about 100 bytes each once hashed) are
# broadcast instead of shuffling the state.
SMALL_BATCH_ROWS = 500_000
# Keys that may be known are looked up one by one up to this many: in hundreds of
# buckets more of them would open every bucket anyway.
LOOKED_UP_KEYS = 10_000

STATE_COLUMNS = [
    "fingerprint", "first_seen", "last_seen", "score", "source", "company", "title", "url",
    "notified",
]


@dataclass
class Batch:
    """One try of a batch. ``batch_id`` is final once it is committed."""

    batch_id: int | None
    #: Whether the id was given by hand: another is never taken instead.
    fixed: bool
    run: str
    #: The last commit that was there when the try began.
    began: int
    feed: str | None = None
    feed_batch: int | None = None
    #: How often its commit was decided; more than once where another writer was first.
    tries: int = 0
    #: Postings taken in and rejects of each source, as the writing job counted them.
    counts: dict[str, tuple[int, int]] | None = None


class SeenStore:
    """Folder-backed state; ``root`` must be reachable from every executor."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = 256) -> None:
        self.spark = spark
        self.root = root.rstrip("/")
        self.buckets = buckets
        self._commits = Commits(spark, self.root)

    # ---- layout ---------------------------------------------------------------

    def _path(self, name: str, run: str) -> str:
        return f"{self.root}/{name}/run={run}"

    def _empty(self, name: str) -> DataFrame:
        # Read from no rows rather than from a list, so that plans look alike.
        parsed = F.from_json(F.col("id").cast("string"), _LOGS[name]).alias("row")
        return self.spark.range(0).select(parsed).select("row.*")

    def _log(self, name: str, runs: dict[int, str]) -> DataFrame:
        """The given batches of a log, each read from its run's folder."""
        if not runs:
            return self._empty(name)
        columns = [f for f in _LOGS[name] if f.name != "batch_id"]
        schema = StructType([*columns, StructField("run", StringType())])
        reader = self.spark.read.schema(schema).option("basePath", f"{self.root}/{name}")
        rows = reader.parquet(*[self._path(name, run) for run in runs.values()])
        # One short row a batch that no merged table has taken in.
        named = self.spark.createDataFrame([(run, n) for n, run in runs.items()], "run string, batch_id bigint")
        return rows.join(F.broadcast(named), "run").select(*_LOGS[name].fieldNames())

    def _read(self, name: str, run: str, batch_id: int | None) -> DataFrame:
        """One run of a log, found by its path: the folders of others are not listed."""
        columns = [f for f in _LOGS[name] if f.name != "batch_id"]
        rows = self.spark.read.schema(StructType(columns)).parquet(self._path(name, run))
        return rows.withColumn("batch_id", F.lit(batch_id).cast("bigint"))

    def _of(self, name: str, batch_id: int) -> DataFrame:
        run = self._commits.refreshed().run_of(name, batch_id)
        return self._empty(name) if run is None else self._read(name, run, batch_id)

    def write(self, rows: DataFrame, name: str, batch: Batch) -> DataFrame:
        """Write rows of a log for a try and read them back; nobody else sees them yet."""
        columns = [c for c in _LOGS[name].fieldNames() if c != "batch_id"]
        rows.select(*columns).write.mode("overwrite").parquet(self._path(name, batch.run))
        return self._read(name, batch.run, batch.batch_id)

    # ---- batch ids --------------------------------------------------------------

    def next_batch_id(self) -> int:
        """One past every batch id given out so far."""
        return self._commits.refreshed().newest + 1

    def begin(self, batch_id: int | Batch | None = None, feed: str | None = None, feed_batch: int | None = None) -> Batch:
        """A new try of a batch.

        Without an id it gets the next one when it is committed. A stream's batch gets
        the id of its first try, if that was committed, or the one it was promised.
        """
        if isinstance(batch_id, Batch):
            return batch_id
        fixed = batch_id is not None
        if feed is not None and not fixed:
            batch_id = self.batch_id_for(feed, feed_batch)
        began = self._commits.refreshed().version
        return Batch(batch_id, fixed, f"r{uuid.uuid4().hex}", began, feed, feed_batch)

    def batch_id_for(self, feed: str, feed_batch: int) -> int:
        """The batch id of a stream's batch: that of its first try, or a new one kept for it."""

        def decide(view: View) -> dict | None:
            if feed_batch in view.feeds.get(feed, {}):
                return None
            return {"kind": "reserve", "batch_id": view.newest + 1, "feed": feed, "feed_batch": feed_batch}

        self._commits.commit(decide)
        return self._commits.view.feeds[feed][feed_batch]

    # ---- one batch --------------------------------------------------------------

    def commit(self, batch: Batch, *logs: str) -> Batch:
        """Make the written ``logs`` of a try the batch's: sightings and rejects, in one step.

        If another writer has committed a higher id, a new batch takes the next one. An id
        given by hand may lie below what was there when the try began; if it was passed
        since, ``Conflict`` is raised and nothing is committed. So it is where merged state
        has passed the id.
        """

        def decide(view: View) -> dict:
            batch.tries += 1
            n = batch.batch_id
            if n is None:
                n = view.newest + 1
            elif view.run_of("sightings", n) is None and self._passed(view, n, batch.began if batch.fixed else -1):
                if batch.fixed:
                    raise Conflict(f"batch {n} was passed by another writer's")
                n = view.newest + 1
            entry = {"kind": "batch", "batch_id": n, "run": batch.run, "logs": list(logs)}
            return entry | {"feed": batch.feed, "feed_batch": batch.feed_batch}

        batch.batch_id = self._commits.commit(decide)["batch_id"]
        self._remove(self._path("collected", batch.run))
        return batch

    @staticmethod
    def _passed(view: View, batch_id: int, began: int) -> bool:
        later = any(n >= batch_id and version > began for n, version in view.since.items())
        return later or any(m["upto"] >= batch_id for m in view.merges)

    def rejects_of(self, batch_id: int) -> DataFrame:
        """Rejects of a batch; none for one that was given postings only."""
        return self._of("rejects", batch_id)

    def sightings_of(self, batch_id: int) -> DataFrame:
        return self._of("sightings", batch_id)

    def routed_of(self, batch_id: int) -> DataFrame:
        """The new rows of a batch that have a route, alerted or not."""
        return self._of("routed", batch_id)

    def filter_new(self, rows: DataFrame, batch_id: int, n_rows: int | None = None) -> DataFrame:
        """Rows not seen before this batch, whatever this batch has written itself.

        ``n_rows`` is the counted size of ``rows``. When it is small, recent logs are read
        in place, and of merged state only its filters and the buckets of keys that pass
        them; otherwise both sides meet by key.
        """
        view = self._commits.refreshed()
        merge = self._merge(view, batch_id)
        recent = self._log("sightings", self._recent(view, batch_id, merge))
        if n_rows is None or n_rows > SMALL_BATCH_ROWS:
            return not_known(rows, *([recent] if merge is None else [self._base(merge), recent]))
        new = not_known_small(rows, recent)
        if merge is None:
            return new
        perhaps = self._perhaps_known(rows.select(KEY), merge)
        found = perhaps.limit(LOOKED_UP_KEYS + 1).collect()
        if len(found) > LOOKED_UP_KEYS:
            return not_known_small(new, self._base(merge))
        known = self._looked_up(merge, [row[0] for row in found])
        return new.join(F.broadcast(known), KEY, "left_anti")

    def _perhaps_known(self, keys: DataFrame, merge: dict) -> DataFrame:
        """Keys of a small batch that the filters of the merged state do not exclude."""
        table = self.spark.read.parquet(f"{self.root}/bloom_{merge['upto']}_{merge['run']}")
        return bloom.perhaps_known(keys, table, merge["buckets"], merge["blocks"])

    def _looked_up(self, merge: dict, keys: list[str]) -> DataFrame:
        """Those of a few keys that the merged state has; other buckets are not opened."""
        return self._base(merge).where(F.col(KEY).isin(keys)).select(KEY)

    def mark_notified(self, fingerprints: DataFrame, batch: int | Batch) -> None:
        """Mark what a batch has alerted; with a try of it, its routed rows as well."""
        logs = ["routed", "notified"] if isinstance(batch, Batch) else ["notified"]
        if not isinstance(batch, Batch):
            batch = self.begin(batch)
        self.write(fingerprints, "notified", batch)
        entry = {"kind": "marks", "batch_id": batch.batch_id, "run": batch.run, "logs": logs}
        self._commits.commit(lambda view: entry)

    # ---- the state --------------------------------------------------------------

    def state(self, before: int | None = None) -> DataFrame:
        """One row per fingerprint, as it stood before the given batch."""
        return self._merged(self._commits.refreshed(), before).select(*STATE_COLUMNS)

    @staticmethod
    def _recent(view: View, before: int | None, merge: dict | None) -> dict[int, str]:
        """Sightings before a batch that a merge has not taken in."""
        after = -1 if merge is None else merge["upto"]
        runs = view.runs.get("sightings", {})
        return {n: run for n, run in sorted(runs.items()) if n > after and (before is None or n < before)}

    @staticmethod
    def _marks(view: View, before: int | None, merge: dict | None) -> dict[int, str]:
        """Marks before a batch that a merge has not taken in, also late ones of older batches."""
        taken = set() if merge is None else set(merge["marks"])
        runs = view.runs.get("notified", {})
        return {n: run for n, run in sorted(runs.items()) if run not in taken and (before is None or n < before)}

    def _merged(self, view: View, before: int | None, buckets: int | None = None) -> DataFrame:
        merge = self._merge(view, before)
        parts = [
            sighting_states(self._log("sightings", self._recent(view, before, merge))),
            notified_states(self._log("notified", self._marks(view, before, merge))),
        ]
        if merge is not None:
            parts.append(self._base(merge))
        return merge_states(parts, buckets)

    def compact(self, upto: int) -> None:
        """Merge all batches up to ``upto`` into one bucketed table, with filters beside it.

        Later batches then join with it without moving it. The rows are brought
        into their buckets by the shuffle that merges them, so each bucket is one
        file; choose the number of buckets for about a gigabyte of keys each. A
        replay of a batch at or below ``upto`` still sees the right past: only tables
        merged before that batch are used. Merging up to the same batch again does
        nothing. If another writer replaces one of these batches, or marks its alerts,
        while they are merged, they are merged anew.
        """
        while not self._compacted(upto):
            pass

    def _compacted(self, upto: int) -> bool:
        view = self._commits.refreshed()
        if any(m["upto"] == upto for m in view.merges):
            return True
        before = self._merge(view, upto + 1)
        taken = self._recent(view, upto + 1, before), self._marks(view, upto + 1, before)
        run = f"r{uuid.uuid4().hex}"
        writer = self._merged(view, upto + 1, self.buckets).write.format("parquet").mode("overwrite")
        writer = writer.bucketBy(self.buckets, KEY).sortBy(KEY)
        merge = {"upto": upto, "buckets": self.buckets, "run": run}
        writer.option("path", self._base_path(merge)).saveAsTable(self._name(merge))
        keys = self.spark.table(self._name(merge)).select(KEY)
        blocks = bloom.blocks_for(keys.count(), self.buckets)
        table = bloom.filters(keys, self.buckets, blocks).sortWithinPartitions("bucket", "block")
        table.write.mode("overwrite").parquet(f"{self.root}/bloom_{upto}_{run}")
        marks = [*(before["marks"] if before else []), *taken[1].values()]
        entry = {"kind": "merge", **merge, "blocks": blocks, "marks": marks}

        def decide(view: View) -> dict | None:
            if any(m["upto"] == upto for m in view.merges):
                return None
            now = self._merge(view, upto + 1)
            same = now == before and (self._recent(view, upto + 1, now), self._marks(view, upto + 1, now)) == taken
            if not same:
                raise Conflict(f"the batches up to {upto} have changed")
            return entry

        try:
            done = self._commits.commit(decide) is not None
            kept = done or any(m["upto"] == upto for m in self._commits.view.merges)
        except Conflict:
            done = kept = False
        if not done:
            self._drop(entry)
        return kept

    def expire(self, upto: int) -> None:
        """Delete what the newest table merged at or below ``upto`` has taken in.

        Older tables go, and the logs of the batches in it; so listings stay short, and
        the commits before become one. Those batches cannot be run again.
        """
        last = self._merge(self._commits.refreshed(), upto + 1)
        if last is None:
            return
        gone: dict = {}

        def decide(view: View) -> dict:
            gone.update(merges=[m for m in view.merges if m["upto"] < last["upto"]], runs=[], since=view.snapshot_at)
            kept = View(newest=view.newest, since={n: v for n, v in view.since.items() if n > last["upto"]})
            kept.merges = [m for m in view.merges if m["upto"] >= last["upto"]]
            for log, runs in view.runs.items():
                stays = {n: r for n, r in runs.items() if n > last["upto"] or (log == "notified" and r not in last["marks"])}
                kept.runs[log] = stays
                gone["runs"] += [(log, r) for n, r in runs.items() if n not in stays]
            for feed, given in view.feeds.items():
                latest = max(given)
                kept.feeds[feed] = {k: n for k, n in given.items() if n > last["upto"] or k == latest}
            return kept.snapshot()

        self._commits.commit(decide)
        self._commits.log.remove_before(gone["since"])
        for merge in gone["merges"]:
            self._drop(merge)
        for log, run in gone["runs"]:
            self._remove(self._path(log, run))

    def vacuum(self, older_than: float = 7 * 86400) -> int:
        """Delete files of tries that were never committed or have been replaced.

        ``older_than`` is in seconds and must exceed the longest run: a try that still
        writes looks the same. The number of folders deleted is returned.
        """
        live, limit, n = self._commits.refreshed().live(), time.time() - older_than, 0
        for name in _LOGS:
            for folder, changed in self._folders(f"{self.root}/{name}", "run="):
                if folder.rpartition("run=")[2] not in live and changed <= limit:
                    self._remove(folder)
                    n += 1
        for kind in ("base_", "bloom_"):
            for folder, changed in self._folders(self.root, kind):
                if folder.rpartition("_")[2] not in live and changed <= limit:
                    self._remove(folder)
                    n += 1
        return n

    def _batch_folders(self, name: str) -> list[str]:
        return [path for path, _ in self._folders(f"{self.root}/{name}", "run=")]

    def _folders(self, path: str, prefix: str) -> list[tuple[str, float]]:
        """Folders below a path whose names begin with ``prefix``, and when they changed."""
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = where.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(where):
            return []
        found = [(str(s.getPath().toString()), s.getModificationTime() / 1000) for s in fs.listStatus(where)]
        return [f for f in found if f[0].rpartition("/")[2].startswith(prefix)]

    def _remove(self, path: str) -> None:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)

    def _drop(self, merge: dict) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self._name(merge)}")
        self._remove(self._base_path(merge))
        self._remove(f"{self.root}/bloom_{merge['upto']}_{merge['run']}")

    def _base_path(self, merge: dict) -> str:
        return f"{self.root}/base_{merge['upto']}_{merge['run']}"

    def _name(self, merge: dict) -> str:
        place = hashlib.sha256(self.root.encode()).hexdigest()[:16]
        return f"sift_seen_{place}_{merge['upto']}_{merge['run']}"

    def _table(self, upto: int) -> str:
        """The catalog's name of the table merged up to a batch."""
        return next(self._name(m) for m in self._commits.refreshed().merges if m["upto"] == upto)

    @staticmethod
    def _merge(view: View, before: int | None) -> dict | None:
        """The newest merge below ``before``."""
        found = [m for m in view.merges if before is None or m["upto"] < before]
        return max(found, key=lambda m: m["upto"], default=None)

    def _base(self, merge: dict) -> DataFrame:
        name = self._name(merge)
        if not self.spark.catalog.tableExists(name):
            columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in STATE)
            self.spark.sql(
                f"CREATE TABLE {name} ({columns}) USING parquet"
                f" CLUSTERED BY (fingerprint) SORTED BY (fingerprint)"
                f" INTO {merge['buckets']} BUCKETS LOCATION {_quoted(self._base_path(merge))}"
            )
        return self.spark.table(name)


def _quoted(text: str) -> str:
    escaped = text.replace("\\", "\\\\").replace("'", "\\'")
    return f"'{escaped}'"


def sighting_states(sightings: DataFrame) -> DataFrame:
    """Each sighting as a state of its own, ready to be merged."""
    return sightings.select(
        "fingerprint",
        F.col("now").alias("first_seen"),
        F.col("now").alias("last_seen"),
        F.col("last_score").alias("score"),
        "source", "company", "title", "url",
        F.lit(False).alias("notified"),
        F.col("batch_id").alias("first_batch"),
        F.col("batch_id").alias("last_batch"),
        F.lit(None).cast("bigint").alias("notified_batch"),
    )


def notified_states(notified: DataFrame) -> DataFrame:
    """Notification marks in the same shape, with nothing else known."""
    return notified.select("fingerprint", F.col("batch_id").alias("notified_batch"))


def merge_states(parts: list[DataFrame], buckets: int | None = None) -> DataFrame:
    """Union the parts and fold them by fingerprint in one shuffle.

    The oldest part gives the descriptive columns, the newest the score. Marks
    for a fingerprint that was not there yet when they were made do not count.
    """
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part, allowMissingColumns=True)
    if buckets is not None:
        whole = whole.repartition(buckets, "fingerprint")
    described = F.struct("source", "company", "title", "url")
    folded = whole.groupBy("fingerprint").agg(
        F.min("first_seen").alias("first_seen"),
        F.max("last_seen").alias("last_seen"),
        F.max_by("score", "last_batch").alias("score"),
        F.min_by(described, F.col("first_batch")).alias("_first"),
        F.min("first_batch").alias("first_batch"),
        F.max("last_batch").alias("last_batch"),
        F.max("notified_batch").alias("notified_batch"),
    )
    notified = F.coalesce(F.col("notified_batch") >= F.col("first_batch"), F.lit(False))
    known = folded.where(F.col("first_batch").isNotNull())
    return known.select("*", "_first.*", notified.alias("notified")).select(*STATE.fieldNames())
