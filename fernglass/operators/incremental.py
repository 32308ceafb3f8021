"""Incremental processing with the target as state: each output row holds its source key and version, and a run publishes
one whole new target version or none."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Parts of an ISO 8601 instant: date, time with optional fraction, offset.
_ISO = r"^\s*(\d{4}-\d{2}-\d{2})[T ](\d{2}:\d{2}(?::\d{2})?(?:\.\d{1,6})?)\d*\s*([Zz]|[+-]\d{2}(?::?\d{2})?)?\s*$"


def instant(text: Column) -> Column:
    """An ISO 8601 text with any offset as a timestamp in UTC; no offset means UTC, other text is null."""
    parts = F.regexp_replace(text, _ISO, "$1 $2 $3")
    zoned = F.regexp_replace(F.regexp_replace(parts, r"\s*[Zz]?$", ""), r"\s+([+-]\d{2})$", "$1:00")
    zoned = F.regexp_replace(zoned, r"\s+([+-]\d{2}):?(\d{2})$", "$1:$2")
    stamped = F.when(zoned.rlike(r"[+-]\d{2}:\d{2}$"), zoned).otherwise(F.concat(zoned, F.lit("+00:00")))
    return F.when(text.rlike(_ISO), F.try_to_timestamp(stamped))


def version_key(value: Column) -> Column:
    """A content version for comparison: without letter case and outer blanks; null and blank are null."""
    key = F.lower(F.trim(value))
    return F.when(key != "", key)


def succeeded_runs(runs: DataFrame) -> DataFrame:
    """``run_id, finished`` of runs whose row with the latest ``finished_at`` has status ok.

    Rows without a readable ``finished_at`` never finish a run. Of rows of one run with the same instant, ok counts only if all are ok
    (a tie is not a proof of success). Null run ids are dropped."""
    rows = runs.select("run_id", instant(F.col("finished_at")).alias("finished"), (F.lower(F.trim("status")) == "ok").alias("ok"))
    rows = rows.filter(F.col("run_id").isNotNull() & F.col("finished").isNotNull())
    last = rows.groupBy("run_id", "finished").agg(F.min(F.coalesce("ok", F.lit(False))).alias("ok"))
    last = last.groupBy("run_id").agg(F.max(F.struct("finished", "ok")).alias("last"))
    return last.filter("last.ok").select("run_id", F.col("last.finished").alias("finished"))


def committed_versions(log: DataFrame, runs: DataFrame) -> DataFrame:
    """``doc_id, committed_hash``: the target's state, one row per document with a record that is not failed in a succeeded run.

    The run that finished last wins, then its latest record; ties take the greatest run id and hash, so that the result does
    not depend on row order. A null hash that wins stays null (nothing is committed). The aggregate is a map-side combined
    maximum, so a document that holds most of the log costs no task more than a row per partition."""
    rows = log.filter(F.col("doc_id").isNotNull() & (F.coalesce(F.lower(F.trim("outcome")), F.lit("")) != "failed"))
    rows = rows.join(succeeded_runs(runs), "run_id")
    order = F.struct("finished", "recorded_at", "run_id", version_key(F.col("content_hash")).alias("committed_hash"))
    return rows.groupBy("doc_id").agg(F.max(order).alias("last")).select("doc_id", F.col("last.committed_hash").alias("committed_hash"))


def pending_documents(documents: DataFrame, log: DataFrame, runs: DataFrame) -> DataFrame:
    """``doc_id`` of every document that the next run must process, each once.

    Retracted documents are left out. A document is pending if its hash is null or blank, differs from its committed one, or
    nothing is committed: the source anti-joined with the target on key and version. ``mtime`` and ``last_seen_run`` are not
    looked at, as neither proves that the text changed. Empty tables give no rows; repeated rows of a document are one."""
    source = documents.filter(F.col("doc_id").isNotNull() & (F.coalesce(F.lower(F.trim("lifecycle")), F.lit("active")) != "retracted"))
    source = source.select("doc_id", version_key(F.col("content_hash")).alias("committed_hash"))
    done = committed_versions(log, runs).filter(F.col("committed_hash").isNotNull())
    return source.join(done, ["doc_id", "committed_hash"], "left_anti").select("doc_id").distinct()


class ConflictError(RuntimeError):
    """Another run published from the same base, or holds the lock."""


#: Layers of a version before it is written anew as one, and versions that are kept for readers that still have them open.
LAYERS, VERSIONS = 8, 3


class _Folder:
    """Files under a folder of any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        jvm = spark.sparkContext._jvm
        self.spark, self.folder, self._path = spark, folder.rstrip("/"), jvm.org.apache.hadoop.fs.Path
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path(self.folder).getFileSystem(conf)
        self._context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), conf)
        self._rename = jvm.org.apache.hadoop.fs.Options.Rename

    def at(self, name: str):
        return self._path(f"{self.folder}/{name}")

    def names(self, inside: str = "") -> list[str]:
        path = self.at(inside) if inside else self._path(self.folder)
        return sorted(f.getPath().getName() for f in self._fs.listStatus(path)) if self._fs.exists(path) else []

    def text(self, name: str) -> str:
        stream = self._fs.open(self.at(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def put_new(self, name: str, text: str) -> None:
        """Write a file that must not be there yet: all of it under another name, then one rename that fails where the name is taken."""
        temporary = self.at(f".{uuid.uuid4().hex}")
        out = self._fs.create(temporary, True)
        out.write(bytearray(text.encode()))
        out.close()
        option = self.spark.sparkContext._gateway.new_array(self._rename, 1)
        option[0] = self._rename.NONE
        try:
            self._fs.mkdirs(self.at(name).getParent())
            self._context.rename(temporary, self.at(name), option)
        except Py4JJavaError as error:
            self._fs.delete(temporary, False)
            raise ConflictError(f"{name} is there already") from error

    def drop(self, name: str) -> None:
        self._fs.delete(self.at(name), True)


class WriterLock:
    """One writer at a time: a file that one creates and the others find. Contention raises after ``wait`` seconds; a lock older than ``abandoned`` is taken over."""

    def __init__(self, spark: SparkSession, folder: str, wait: float = 0.0, abandoned: float = 24 * 3600.0) -> None:
        self.files, self.wait, self.abandoned, self.mine = _Folder(spark, folder), wait, abandoned, uuid.uuid4().hex

    def __enter__(self) -> WriterLock:
        until = time.monotonic() + self.wait
        while True:
            try:
                self.files.put_new("LOCK", json.dumps({"holder": self.mine, "since": time.time()}))
                return self
            except ConflictError:
                try:
                    since = json.loads(self.files.text("LOCK"))["since"]
                except (Py4JJavaError, ValueError, KeyError):
                    since = time.time()  # it went just now, or isn't whole yet
                if time.time() - since > self.abandoned:
                    self.files.drop("LOCK")
                elif time.monotonic() >= until:
                    raise
                else:
                    time.sleep(min(0.2, max(0.0, until - time.monotonic())))

    def __exit__(self, *_: object) -> None:
        if json.loads(self.files.text("LOCK"))["holder"] == self.mine:
            self.files.drop("LOCK")


class VersionedTarget:
    """A table of versions under one folder. A version is a small file that names layers: a whole table, and after it what each run changed.

    A run writes the rows it adds or replaces and the keys whose older rows they take the place of, then one version file; nothing else is written again.
    The version file's number is one more than that of the version the run started from, and is created by a rename that fails if it is
    there: of two runs from one base the second raises and changes nothing. A crash before the rename leaves the old version, after it the
    new one. After ``LAYERS`` layers a version is written as one again, and versions but the last ``VERSIONS`` go with the layers that only they have."""

    def __init__(self, spark: SparkSession, folder: str, key: str = "doc_id") -> None:
        self.spark, self.folder, self.key = spark, folder.rstrip("/"), key
        self.files = _Folder(spark, folder)

    def number(self) -> int:
        """The number of the published version, 0 before the first."""
        return max((int(n[:-5]) for n in self.files.names("versions") if n.endswith(".json") and n[:-5].isdigit()), default=0)

    def current(self) -> dict | None:
        """The published version, or None: its number, run and layers."""
        number = self.number()
        return json.loads(self.files.text(f"versions/{number:012d}.json")) if number else None

    def read(self) -> DataFrame | None:
        """The published rows, or None before the first run."""
        version = self.current()
        return None if version is None else self._rows(version["layers"])

    def _rows(self, layers: list[str]) -> DataFrame:
        load = lambda layer, part: self.spark.read.parquet(f"{self.folder}/{layer}/{part}")
        out, gone = load(layers[-1], "rows"), None
        for older, newer in zip(reversed(layers[:-1]), reversed(layers)):
            gone = load(newer, "gone") if gone is None else gone.unionByName(load(newer, "gone"))
            out = out.unionByName(load(older, "rows").join(gone, self.key, "left_anti"), allowMissingColumns=True)
        return out

    def publish(self, rows: DataFrame, run_id: str, base: int | None = None) -> None:
        """A version that has ``rows`` and nothing else."""
        base = self.number() if base is None else base
        layer = f"layers/{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.folder}/{layer}/rows")
        rows.select(self.key).limit(0).write.parquet(f"{self.folder}/{layer}/gone")
        self._commit(base, run_id, [layer])

    def apply(self, rows: DataFrame, gone: DataFrame, run_id: str, base: int | None = None) -> bool:
        """A version with ``rows`` added, after the rows of the keys ``gone`` have left; whether there was anything to change."""
        base = self.number() if base is None else base
        if not base:
            self.publish(rows, run_id, base)
            return True
        layer = f"layers/{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.folder}/{layer}/rows")
        gone.select(self.key).distinct().write.parquet(f"{self.folder}/{layer}/gone")
        written = [self.spark.read.parquet(f"{self.folder}/{layer}/{part}").limit(1).count() for part in ("rows", "gone")]
        if not any(written):
            self.files.drop(layer)
            return False
        layers = [*json.loads(self.files.text(f"versions/{base:012d}.json"))["layers"], layer]
        if len(layers) > LAYERS:
            self.publish(self._rows(layers), run_id, base)
            self.files.drop(layer)
        else:
            self._commit(base, run_id, layers)
        return True

    def _commit(self, base: int, run_id: str, layers: list[str]) -> None:
        self.files.put_new(f"versions/{base + 1:012d}.json", json.dumps({"version": base + 1, "run_id": run_id, "layers": layers}))
        self._prune()

    def _prune(self) -> None:
        """Drop versions but the last ones and, of layers that no version names, those that older versions had: a run under way keeps what it writes."""
        names = [n for n in self.files.names("versions") if n.endswith(".json")]
        named = lambda some: {x for n in some for x in json.loads(self.files.text(f"versions/{n}"))["layers"]}
        old, kept = names[:-VERSIONS], named(names[-VERSIONS:])
        for layer in sorted(named(old) - kept):
            self.files.drop(layer)
        for name in old:
            self.files.drop(f"versions/{name}")


def one_per_key(rows: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """The first row of each key by ``order``; rows without a key are left out."""
    window = Window.partitionBy(key).orderBy(*order)
    return rows.filter(F.col(key).isNotNull()).withColumn("_row", F.row_number().over(window)).filter("_row = 1").drop("_row")


def process_changes(target: VersionedTarget, source: DataFrame, transform: Callable[[DataFrame], DataFrame], run_id: str, key: str = "doc_id", version: str = "content_hash") -> None:
    """One run: ``transform`` the source rows whose (key, version) the target lacks, and publish them in place of their keys' rows; only changes are written.

    ``transform`` must keep ``key`` and ``version``. Rows whose key left the source leave the target; rows with a null or blank
    version are processed every run. Running it twice with the same source changes nothing; of two runs at once one raises ``ConflictError``."""
    keyed = one_per_key(source.withColumn("_version", version_key(F.col(version))), key, [F.desc_nulls_last("_version")])
    base = target.number()
    before = target.read()
    if before is None:
        target.publish(transform(keyed.drop("_version")), run_id, base)
        return
    have = before.select(key, version_key(F.col(version)).alias("_version"))
    fresh = keyed.join(have.distinct(), [key, "_version"], "left_anti").drop("_version")
    gone = have.join(keyed.select(key, "_version"), [key, "_version"], "left_anti").select(key)
    target.apply(transform(fresh), gone, run_id, base)
