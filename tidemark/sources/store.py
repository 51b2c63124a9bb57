"""The Parquet store: rows in folders by commit, database and partition key, and a log of versions per database.

``root/.data/<kind>/c=<commit>/db=<db>/partition_key=<key>/`` holds rows, sorted by name and time within files. Which folders are
live is said by the newest file of ``root/<db>/_log``: a version is one small JSON file that is made whole and then renamed, so a
write, a seal, a rewrite or a removal is seen entirely or not at all, and nothing is read twice. A version also names the
database's catalog (names, ids, pinned types, first and last times), its rollup checkpoints, the next arrival number, the newest batch of each stream, and which
partitions are open. All access goes through Spark and Hadoop's file system, so root may be in any store. A database has one
writer at a time: a second one fails at its commit.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterable, Sequence
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import shared
from ..functions import names, timeutil
from ..schema import CHECKPOINTS, EVENTS, MAX_EVENTS, MAX_METRICS, SAMPLES

SCHEMAS = {"samples": SAMPLES, "events": EVENTS}
NAME = {"samples": "metric", "events": "name"}
CAPACITY = {"samples": MAX_METRICS, "events": MAX_EVENTS}
CATALOG = "db string, name string, id int, value_type string, first_ts_ns bigint, last_ts_ns bigint"
#: Versions of a database that are kept beside the newest.
KEPT = 10


class Conflict(RuntimeError):
    """Another writer has committed to the database in between."""


@dataclass(frozen=True)
class Part:
    """A live folder: rows of one kind, commit and partition key. staged: accepted, not sealed; batch: the stream's batch that wrote it; archive: its bucket."""

    kind: str
    commit: str
    key: str
    staged: bool = False
    batch: str = ""
    archive: str = ""


@dataclass(frozen=True)
class State:
    """A version of a database."""

    version: int = 0
    next_seq: int = 0
    parts: tuple[Part, ...] = ()
    catalog: int = 0
    checkpoints: int = 0
    batches: dict[str, int] = field(default_factory=dict)
    open: tuple[str, ...] = ()
    sealed: tuple[str, ...] = ()
    mode: str = ""

    def live(self, kind: str) -> list[Part]:
        return [p for p in self.parts if p.kind == kind and not p.archive]

    def text(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def of(cls, text: str) -> State:
        v = json.loads(text)
        return cls(**{**v, "parts": tuple(Part(**p) for p in v["parts"]), "open": tuple(v["open"]), "sealed": tuple(v["sealed"])})


def columns_of(kind: str) -> list[str]:
    return [c.split(" ")[0] for c in SCHEMAS[kind].split(", ")]


class Store:
    def __init__(self, spark: SparkSession, root: str, mode: str = "day", codec: str = "zstd", modes: dict[str, str] | None = None):
        """mode: the partition mode of databases; modes: those of single databases."""
        for m in (mode, *(modes or {}).values()):
            if m not in timeutil.PARTITION_MODES:
                raise ValueError(f"unknown partition mode {m!r}")
        self.spark, self.root, self.mode, self.codec, self.modes = spark, root.rstrip("/"), mode, codec, dict(modes or {})

    def mode_of(self, db: str, state: State | None = None) -> str:
        """A database's partition mode: the one that it was made with."""
        return (state or self.state(db)).mode or self.modes.get(db, self.mode)

    # files

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path
        return path, path(self.root).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _exists(self, path: str) -> bool:
        make, fs = self._fs()
        return fs.exists(make(path))

    def _children(self, path: str) -> list[str]:
        make, fs = self._fs()
        return sorted(x.getPath().getName() for x in fs.listStatus(make(path)) if x.isDirectory()) if fs.exists(make(path)) else []

    def _files(self, path: str) -> list[str]:
        """The whole JSON files of a folder."""
        make, fs = self._fs()
        found = [x.getPath().getName() for x in fs.listStatus(make(path))] if fs.exists(make(path)) else []
        return sorted(f for f in found if f.endswith(".json") and not f.startswith("."))

    def _load(self, path: str) -> str:
        make, fs = self._fs()
        stream = fs.open(make(path))
        try:
            return self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _save(self, path: str, text: str) -> None:
        make, fs = self._fs()
        out = fs.create(make(path), True)
        out.write(bytearray(text.encode()))
        out.close()

    def _delete(self, path: str) -> None:
        make, fs = self._fs()
        fs.delete(make(path), True)

    def _bytes(self, path: str) -> int:
        make, fs = self._fs()
        return fs.getContentSummary(make(path)).getLength() if fs.exists(make(path)) else 0

    def path(self, db: str, part: Part) -> str:
        return f"{self.root}/.data/{part.kind}/c={part.commit}/db={db}/partition_key={part.key}"

    # versions

    def _versions(self, db: str) -> list[int]:
        return sorted(int(f.removesuffix(".json")) for f in self._files(f"{self.root}/{db}/_log"))

    def state(self, db: str) -> State:
        """The newest version; one of number 0 if there is none."""
        known = self._versions(db)
        return State.of(self._load(f"{self.root}/{db}/_log/{known[-1]:012d}.json")) if known else State()

    def commit(self, db: str, state: State) -> State:
        """Make state, which was made from the newest version, the next one."""
        names.check_database(db)
        state = replace(state, version=state.version + 1, mode=self.mode_of(db, state))
        make, fs = self._fs()
        folder = f"{self.root}/{db}/_log"
        target, temporary = make(f"{folder}/{state.version:012d}.json"), make(f"{folder}/.{uuid.uuid4().hex}")
        self._save(temporary.toString(), state.text())
        if fs.exists(target) or not fs.rename(temporary, target):
            fs.delete(temporary, False)
            raise Conflict(f"database {db} has a version {state.version} already")
        for old in self._versions(db)[: -KEPT - 1]:
            fs.delete(make(f"{folder}/{old:012d}.json"), False)
        return state

    def databases(self, include_internal: bool = False) -> list[str]:
        """Databases that have a version, whether rows of them were imported, streamed or rolled up."""
        found = [d for d in self._children(self.root) if names.is_database(d) and (include_internal or d != names.INTERNAL)]
        return [d for d in found if self._versions(d)]

    def partitions(self, db: str, kind: str = "samples") -> list[str]:
        return sorted({p.key for p in self.state(db).live(kind) if not p.staged})

    # writing

    def put(self, rows: DataFrame, kind: str = "samples") -> str:
        """Write rows of any databases (columns db, partition_key) under a new commit, seen by nobody yet; its name.

        Rows are spread by ranges of database, key, name and time, so that a large partition is many files with narrow statistics.
        """
        name = NAME[kind]
        made = uuid.uuid4().hex
        ranged = rows.select(*columns_of(kind)).repartitionByRange("db", "partition_key", name, "ts_ns").sortWithinPartitions("db", "partition_key", name, "ts_ns", "seq")
        writer = ranged.write.partitionBy("db", "partition_key").option("compression", self.codec)
        writer = writer.option(f"parquet.bloom.filter.enabled#{name}", "true").option(f"parquet.bloom.filter.expected.ndv#{name}", "4096")
        writer.parquet(f"{self.root}/.data/{kind}/c={made}")
        return made

    def written(self, commit: str, kind: str = "samples") -> list[str]:
        """The databases that a commit has rows of."""
        return [x.removeprefix("db=") for x in self._children(f"{self.root}/.data/{kind}/c={commit}") if x.startswith("db=")]

    def admit(self, db: str, commit: str, kind: str = "samples", staged: bool = False, stream: str = "", batch: int = -1, drop: Iterable[Part] = (), change: Callable[[State], State] | None = None, base: State | None = None) -> int:
        """Make what put has written of a database live, with its names in the catalog, in one version; the number of rows.

        drop: parts that the commit replaces; their rows are in the catalog already. base: the version that the rows were judged against.
        """
        before = self.state(db) if base is None else base
        folder = f"{self.root}/.data/{kind}/c={commit}/db={db}"
        keys = [x.removeprefix("partition_key=") for x in self._children(folder) if x.startswith("partition_key=")]
        tag = f"{stream}:{batch}" if stream else ""
        added = [Part(kind, commit, k, staged, tag) for k in keys]
        gone = set(drop)
        after = replace(before, parts=(*[p for p in before.parts if p not in gone], *added))
        n = 0
        if not keys and not gone and not stream and change is None:
            return n
        if keys and not gone:
            g = self.read(db, added).groupBy(F.col(NAME[kind]).alias("name")).agg(
                F.count("*").alias("n"), F.min("seq").alias("first"), F.max("seq").alias("newest"), F.min_by("value_type", "seq").alias("value_type"), F.min("ts_ns").alias("first_ts_ns"), F.max("ts_ns").alias("last_ts_ns"))
            n, newest, after = self._with_catalog(db, kind, g, after)
            after = replace(after, next_seq=max(before.next_seq, newest + 1))
        if stream:
            after = replace(after, batches={**after.batches, stream: batch})
        self.commit(db, after if change is None else change(after))
        return n

    def _with_catalog(self, db: str, kind: str, found: DataFrame, state: State) -> tuple[int, int, State]:
        """Rows and newest arrival of found (a row per name), and the state with a catalog that has them: new names get the next ids by first arrival."""
        rows = sorted(found.limit(CAPACITY[kind] + 1).collect(), key=lambda r: (r["first"], r["name"]))  # bounded by what a catalog holds
        every = self._catalog_of(db, state)
        known = every.setdefault(kind, {})
        for r in rows:
            old = known.get(r["name"])
            known[r["name"]] = [old[0], old[1], min(old[2], r["first_ts_ns"]), max(old[3], r["last_ts_ns"])] if old else [len(known) + 1, r["value_type"], r["first_ts_ns"], r["last_ts_ns"]]
        if len(known) > CAPACITY[kind]:
            raise ValueError(f"{db} would have more than {CAPACITY[kind]} names of {kind}")
        number = state.version + 1
        self._save(f"{self.root}/{db}/_catalog/{number}.json", json.dumps(every))
        self._forget(db, "_catalog", state.catalog)
        return sum(r["n"] for r in rows), max(r["newest"] for r in rows), replace(state, catalog=number)

    def _forget(self, db: str, what: str, newest: int) -> None:
        """Delete snapshots before the one that the newest version names."""
        for x in self._files(f"{self.root}/{db}/{what}"):
            if int(x.removesuffix(".json")) < newest:
                self._delete(f"{self.root}/{db}/{what}/{x}")

    def _keyed(self, db: str, rows: DataFrame) -> DataFrame:
        return rows.withColumn("db", F.lit(names.check_database(db))).withColumn("partition_key", timeutil.partition_key(F.col("ts_ns"), self.mode_of(db)))

    def write(self, db: str, rows: DataFrame, kind: str = "samples") -> int:
        """Seal rows of one database as they are; their number. What may be accepted is the engine's to say."""
        return self.admit(db, self.put(self._keyed(db, rows), kind), kind)

    def stage(self, db: str, rows: DataFrame, kind: str = "samples") -> int:
        """Accept rows without sealing them."""
        return self.admit(db, self.put(self._keyed(db, rows), kind), kind, staged=True)

    def seal(self, db: str, kind: str = "samples") -> None:
        """Move staged rows into sealed files, in one version."""
        staged = [p for p in self.state(db).live(kind) if p.staged]
        if staged:
            self.admit(db, self.put(self.read(db, staged), kind), kind, drop=staged)
            for p in staged:
                self._delete(self.path(db, p))

    # reading

    def read(self, db: str, parts: Sequence[Part], kind: str | None = None) -> DataFrame:
        """The rows of parts, all of one kind."""
        kind = kind or (parts[0].kind if parts else "samples")
        if not parts:
            return shared.local(self.spark, [], SCHEMAS[kind])
        reader = self.spark.read.schema(f"{SCHEMAS[kind]}, c string").option("basePath", f"{self.root}/.data/{kind}")
        return reader.parquet(*[self.path(db, p) for p in parts]).select(*columns_of(kind))

    def scan(self, db: str, kind: str = "samples", start_ns: int | None = None, end_ns: int | None = None, wanted: Sequence[str] | None = None) -> DataFrame:
        """Sealed and staged rows in an inclusive time range. Only folders whose key may be in the range are listed; within them the filters reach the row groups."""
        if start_ns is not None and end_ns is not None and end_ns < start_ns:
            raise ValueError("the end is before the start")
        state = self.state(db)
        mode, parts = self.mode_of(db, state), state.live(kind)
        keyed = mode != "forever"
        if keyed and start_ns is not None:
            parts = [p for p in parts if p.key >= timeutil.partition_key_of(start_ns, mode)]
        if keyed and end_ns is not None:
            parts = [p for p in parts if p.key <= timeutil.partition_key_of(end_ns, mode)]
        df = self.read(db, parts, kind)
        if start_ns is not None:
            df = df.where(F.col("ts_ns") >= start_ns)
            df = df.where(F.col("partition_key") >= timeutil.partition_key_of(start_ns, mode)) if keyed else df
        if end_ns is not None:
            df = df.where(F.col("ts_ns") <= end_ns)
            df = df.where(F.col("partition_key") <= timeutil.partition_key_of(end_ns, mode)) if keyed else df
        return df if wanted is None else df.where(F.col(NAME[kind]).isin(list(wanted)))

    def streamed(self, db: str, kind: str = "samples") -> DataFrame:
        """The rows that batches of streams have written, until they are rewritten."""
        return self.read(db, [p for p in self.state(db).live(kind) if p.batch], kind)

    # catalog

    def _catalog_of(self, db: str, state: State) -> dict[str, dict[str, list]]:
        """kind, name: id, value_type, first_ts_ns, last_ts_ns."""
        return json.loads(self._load(f"{self.root}/{db}/_catalog/{state.catalog}.json")) if state.catalog else {}

    def catalog(self, db: str, kind: str = "samples", state: State | None = None) -> DataFrame:
        """db, name, id, value_type, first_ts_ns, last_ts_ns of a database's metrics or events: 65,535 and 1,023 rows at most, held by the driver."""
        rows = self._catalog_of(db, state or self.state(db)).get(kind, {})
        return shared.local(self.spark, [(db, name, *entry) for name, entry in rows.items()], CATALOG)

    # checkpoints of rollups

    def checkpoints(self, db: str) -> DataFrame | None:
        """db, job_id, completed_ts_ns, seq: one row per job (a pattern's: per job and metric), the newest."""
        state = self.state(db)
        if not state.checkpoints:
            return None
        rows = json.loads(self._load(f"{self.root}/{db}/_checkpoints/{state.checkpoints}.json"))
        return shared.local(self.spark, [(db, job, *entry) for job, entry in rows.items()], CHECKPOINTS)

    def add_checkpoints(self, db: str, done: Iterable[tuple[str, int]]) -> None:
        """Take over pairs of job and completed time. Call it after the rows they speak of are committed: after a failure between the two the periods are found there."""
        state = self.state(db)
        number = state.version + 1
        rows = json.loads(self._load(f"{self.root}/{db}/_checkpoints/{state.checkpoints}.json")) if state.checkpoints else {}
        rows.update({job: [at, number] for job, at in done})
        self._save(f"{self.root}/{db}/_checkpoints/{number}.json", json.dumps(rows))
        self.commit(db, replace(state, checkpoints=number))
        self._forget(db, "_checkpoints", state.checkpoints)

    def drop_checkpoints(self, db: str) -> None:
        state = self.state(db)
        if state.checkpoints:
            self.commit(db, replace(state, checkpoints=0))

    # maintenance

    def rewrite(self, db: str, key: str, kind: str = "samples") -> dict[str, int]:
        """Pack a partition's sealed folders into one of fewer, sorted files; the same rows. An open or staged partition is refused.

        The new folder takes the place of the old ones in one version, and these are deleted after it. Returns bytes before, after and saved
        (which may be negative).
        """
        state = self.state(db)
        mine = [p for p in state.live(kind) if p.key == key]
        if key in state.open or any(p.staged for p in mine):
            raise ValueError(f"partition {key} of {db} is active")
        if not mine:
            raise KeyError(key)
        before = sum(self._bytes(self.path(db, p)) for p in mine)
        old = self.read(db, mine, kind)
        made = uuid.uuid4().hex
        fresh = Part(kind, made, key)
        old.drop("db", "partition_key").repartitionByRange(max(1, before >> 27), NAME[kind], "ts_ns").sortWithinPartitions(NAME[kind], "ts_ns", "seq").write.option("compression", self.codec).parquet(self.path(db, fresh))
        rows = [df.agg(F.count("*"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")), F.bit_xor(F.xxhash64(F.lit(7), *df.columns))).first() for df in (old, self.read(db, [fresh], kind))]
        if rows[0] != rows[1]:
            raise RuntimeError(f"rewritten partition {key} differs")
        after = self._bytes(self.path(db, fresh))
        self.commit(db, replace(state, parts=(*[p for p in state.parts if p not in mine], fresh)))
        for p in mine:
            self._delete(self.path(db, p))
        return {"source_bytes": before, "dest_bytes": after, "saved_bytes": before - after}

    def remove(self, db: str, key: str) -> None:
        """Drop a partition, of samples and events, staged or sealed."""
        state = self.state(db)
        mine = [p for p in state.parts if p.key == key and not p.archive]
        self.commit(db, replace(state, parts=tuple(p for p in state.parts if p not in mine)))
        for p in mine:
            self._delete(self.path(db, p))

    def archive(self, db: str, key: str, bucket: str) -> None:
        """Take a partition out of what is read and put it to its archive bucket. One version; no file is moved."""
        state = self.state(db)
        self.commit(db, replace(state, parts=tuple(replace(p, archive=bucket) if p.key == key and not p.archive else p for p in state.parts)))

    def archived(self, db: str, bucket: str, kind: str = "samples") -> DataFrame:
        return self.read(db, [p for p in self.state(db).parts if p.kind == kind and p.archive == bucket], kind)

    def wipe(self, db: str) -> None:
        """All rows and names of a database go; numbers of arrival go on."""
        state = self.state(db)
        if state.version:
            self.commit(db, State(version=state.version, next_seq=state.next_seq, checkpoints=state.checkpoints, batches=state.batches, mode=state.mode))
            for p in state.parts:
                self._delete(self.path(db, p))

    def vacuum(self, older_ms: int = 86_400_000) -> list[str]:
        """Delete commits that no database's newest version has a folder of, left by writers that failed more than older_ms ago; their names."""
        make, fs = self._fs()
        live = {p.commit for d in self.databases(True) for p in self.state(d).parts}
        gone = []
        for kind in SCHEMAS:
            for x in self._children(f"{self.root}/.data/{kind}"):
                folder = make(f"{self.root}/.data/{kind}/{x}")
                if x.removeprefix("c=") not in live and fs.getFileStatus(folder).getModificationTime() + older_ms <= time.time() * 1000:
                    fs.delete(folder, True)
                    gone.append(x.removeprefix("c="))
        return gone
