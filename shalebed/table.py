"""Versioned copy-on-write tables: reads, changes, snapshots and the change feed."""

from __future__ import annotations

import functools
import time
import urllib.parse
import uuid
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field as _field
from enum import Enum
from typing import Any

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .errors import ConflictError, PrimaryKeyExistError, StorageExistError, StorageNotFoundError, UserInputError, VersionNotFoundError
from .functions import schema as S
from .plans.predicate import Predicate, as_column
from .plans.views import View
from .sources import records
from .sources.log import Log, Store

MAIN = "main"
DELETE, ADD = "DELETE", "ADD"
#: Bytes of data files that one task sorts in a compaction.
RANGE_BYTES = 16 << 20


@dataclass
class JobResult:
    class State(Enum):
        SUCCEEDED = 1
        FAILED = 2
        SKIPPED = 3

    state: State
    message: str = ""
    snapshot_id: int | None = None
    stats: dict[str, int] = _field(default_factory=dict)


def mutation(f: Callable) -> Callable:
    """Refused changes become a failed result; other errors pass. What was written aside is removed."""

    @functools.wraps(f)
    def run(self, *args, **kwargs) -> JobResult:
        try:
            self.log.reload()
            return f(self, *args, **kwargs) or JobResult(JobResult.State.SKIPPED)
        except (ConflictError, PrimaryKeyExistError, UserInputError) as e:
            return JobResult(JobResult.State.FAILED, str(e))
        finally:
            self.clear()

    return run


class Dataset(View):
    """A table in one location. The handle keeps the current branch."""

    def __init__(self, spark: SparkSession, location: str):
        self.spark, self.location = spark, location.rstrip("/")
        self.log, self.branch = Log(Store(spark, self.location)), MAIN
        #: options of the Parquet writer for new data files, e.g. maxRecordsPerFile or parquet.block.size
        self.write_options: dict[str, Any] = {}
        self._aside: list[str] = []

    def aside(self) -> str:
        """A new folder below the table, removed at the end of the change."""
        self._aside.append(f"tmp/{uuid.uuid4().hex}")
        return self._aside[-1]

    def clear(self) -> None:
        while self._aside:
            self.log.store.delete(self._aside.pop())

    # --- creation -------------------------------------------------------------------------

    @classmethod
    def create(cls, spark: SparkSession, location: str, schema: T.StructType | str, primary_keys: list[str], record_fields: list[str] | None = None, **extra) -> Dataset:
        schema = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
        S.check(schema, primary_keys, record_fields or [])
        out = cls(spark, location)
        if out.log.exists():
            raise StorageExistError(f"{location} holds a table already")
        root = {"snapshot_id": 0, "parent": None, "create_time": time.time(), "manifests": [], "added": [], "deleted": [], "stats": {"num_rows": 0, "num_files": 0, "bytes": 0}}

        def first(state: dict) -> None:
            if state:
                raise StorageExistError(f"{location} holds a table already")
            state |= {"schema": S.numbered(schema).jsonValue(), "primary_keys": list(primary_keys), "record_fields": list(record_fields or []), "refs": {MAIN: ["branch", 0]}, "snapshots": {"0": root}} | extra

        out.log.put(first)
        return out

    @classmethod
    def load(cls, spark: SparkSession, location: str) -> Dataset:
        out = cls(spark, location)
        if not out.log.exists():
            raise StorageNotFoundError(f"{location} holds no table")
        out.log.reload()
        return out

    # --- description ----------------------------------------------------------------------

    @property
    def schema(self) -> T.StructType:
        return T.StructType.fromJson(self.log.state["schema"])

    @property
    def primary_keys(self) -> list[str]:
        return self.log.state["primary_keys"]

    @property
    def record_fields(self) -> list[str]:
        return self.log.state["record_fields"]

    def plan(self, udfs: dict) -> dict:
        return {"op": "read", "location": self.location}

    def leaves(self) -> list[Dataset]:
        return [self]

    # --- versions -------------------------------------------------------------------------

    def snapshot(self, version: int | str | None = None) -> dict:
        version = self.branch if version is None else version
        if isinstance(version, str):
            if version not in self.log.state["refs"]:
                raise VersionNotFoundError(f"No tag or branch {version}")
            version = self.log.state["refs"][version][1]
        if str(version) not in self.log.state["snapshots"]:
            raise VersionNotFoundError(f"No snapshot {version}")
        return self.log.state["snapshots"][str(version)]

    def versions(self) -> DataFrame:
        """snapshot_id, create_time and tag_or_branch (null if none), newest first."""
        self.log.reload()
        snaps = self.spark.createDataFrame([(s["snapshot_id"], s["create_time"]) for s in self.log.state["snapshots"].values()], "snapshot_id long, create_time double")
        refs = self.spark.createDataFrame([(v[1], k) for k, v in self.log.state["refs"].items()], "snapshot_id long, tag_or_branch string")
        return snaps.join(refs, "snapshot_id", "left").withColumn("create_time", F.timestamp_seconds("create_time")).orderBy(F.desc("snapshot_id"), "tag_or_branch")

    def _add_ref(self, name: str, kind: str, snapshot_id: int | None) -> None:
        def change(state: dict) -> None:
            if not name or name == MAIN:
                raise UserInputError(f"{name!r} can't be the name of a {kind}")
            if name in state["refs"]:
                raise UserInputError(f"{name} exists already")
            at = state["refs"][MAIN][1] if snapshot_id is None else snapshot_id
            if str(at) not in state["snapshots"]:
                raise VersionNotFoundError(f"No snapshot {at}")
            state["refs"][name] = [kind, at]

        self.log.put(change)

    def _remove_ref(self, name: str, kind: str) -> None:
        def change(state: dict) -> None:
            if state["refs"].get(name, [None])[0] != kind:
                raise VersionNotFoundError(f"No {kind} {name}")
            if name == MAIN or name == self.branch:
                raise UserInputError(f"Branch {name} is in use")
            del state["refs"][name]

        self.log.put(change)

    def add_tag(self, tag: str, snapshot_id: int | None = None) -> None:
        self._add_ref(tag, "tag", snapshot_id)

    def remove_tag(self, tag: str) -> None:
        self._remove_ref(tag, "tag")

    def add_branch(self, branch: str) -> None:
        self._add_ref(branch, "branch", None)

    def remove_branch(self, branch: str) -> None:
        self._remove_ref(branch, "branch")

    def set_current_branch(self, branch: str) -> None:
        self.log.reload()
        if self.log.state["refs"].get(branch, [None])[0] != "branch":
            raise UserInputError(f"{branch} is not a branch")
        self.branch = branch

    # --- files ----------------------------------------------------------------------------

    def _path(self, file: str) -> str:
        return file if "://" in file or file.startswith(("/", "file:")) else f"{self.location}/{file}"

    def _manifest_schema(self) -> T.StructType:
        keys = [f for f in self.schema if f.name in self.primary_keys]
        stats = [T.StructField(f"{p}{f.name}", f.dataType) for f in keys for p in ("_MIN_", "_MAX_")]
        return T.StructType([T.StructField("file", T.StringType()), T.StructField("num_rows", T.LongType()), T.StructField("bytes", T.LongType()), *stats])

    def _manifest(self, manifests: list[str]) -> DataFrame:
        if not manifests:
            return self.spark.createDataFrame([], self._manifest_schema())
        return self.spark.read.schema(self._manifest_schema()).parquet(*(self._path(m) for m in manifests))

    def index_manifest(self, filter_: Predicate | None = None, snapshot_id: int | str | None = None) -> DataFrame:
        """A row for each data file of a version: file, num_rows, bytes and bounds of the keys; those that may match ``filter_``."""
        self.log.reload()
        out = self._manifest(self.snapshot(snapshot_id)["manifests"])
        test = filter_.may_match(self.primary_keys) if isinstance(filter_, Predicate) else None
        return out if test is None else out.where(test)

    def record_manifest(self, snapshot_id: int | str | None = None) -> DataFrame:
        """file, field and num_rows of each record file written up to a version."""
        self.log.reload()
        paths = [(p, f) for s in self._ancestors(self.snapshot(snapshot_id)["snapshot_id"]) for f, ps in s.get("records", {}).items() for p in ps]
        out = self.spark.createDataFrame([], "file string, field string, num_rows long")
        for p, f in paths:
            rows = self.spark.read.parquet(self._path(p)).select(F.col("_metadata.file_path").alias("file"))
            out = out.unionByName(rows.groupBy("file").agg(F.count(F.lit(1)).alias("num_rows")).withColumn("field", F.lit(f)))
        return out

    def index_files(self, version: int | str | None = None) -> list[str]:
        """Full paths of the data files of a version."""
        return self._files(self.index_manifest(None, version))

    def _files(self, manifest: DataFrame) -> list[str]:
        return [self._path(r[0]) for r in manifest.select("file").collect()]

    def _scan(self, files: list[str]) -> DataFrame:
        schema = S.physical(self.schema, self.record_fields)
        return self.spark.read.schema(schema).parquet(*files) if files else self.spark.createDataFrame([], schema)

    def _named(self, manifest: DataFrame) -> DataFrame:
        """A scan of a manifest's files, with the path of each row's file as _p."""
        files = self._files(manifest)
        return self._scan(files).withColumn("_p", F.col("_metadata.file_path") if files else F.lit(None).cast("string"))

    def _write(self, *parts: DataFrame) -> tuple[str, dict]:
        """Write rows of the physical schema to a new folder, one frame after the other; the manifest's path and the sums."""
        txn = f"data/{uuid.uuid4().hex}"
        for df in parts:
            df.write.options(**self.write_options).mode("append").parquet(f"{self.location}/{txn}")
        return self._describe(self._scan([f"{self.location}/{txn}"]), lambda: F.concat(F.lit(f"{txn}/"), F.col("_metadata.file_name")))

    def _describe(self, rows: DataFrame, name: Callable[[], Column]) -> tuple[str, dict]:
        keys = [x for k in (f.name for f in self.schema if f.name in self.primary_keys) for x in (F.min(f"`{k}`").alias(f"_MIN_{k}"), F.max(f"`{k}`").alias(f"_MAX_{k}"))]
        stats = rows.groupBy(name().alias("file")).agg(F.count(F.lit(1)).alias("num_rows"), F.first("_metadata.file_size").alias("bytes"), *keys)
        return self._put_manifest(stats)

    def _put_manifest(self, stats: DataFrame) -> tuple[str, dict]:
        path = f"metadata/manifests/{uuid.uuid4().hex}"
        stats.select(self._manifest_schema().names).coalesce(1).write.parquet(f"{self.location}/{path}")
        n = self._manifest([path]).agg(F.count(F.lit(1)), F.sum("num_rows"), F.sum("bytes")).first()
        return path, {"num_files": n[0], "num_rows": n[1] or 0, "bytes": n[2] or 0}

    # --- reads ----------------------------------------------------------------------------

    def read(self, filter_: Predicate | Column | str | None = None, fields: list[str] | None = None, version: int | str | None = None, reference_read: bool = False) -> DataFrame:
        """Rows of a version, in schema order; record fields as bytes, or as addresses if ``reference_read``."""
        self.log.reload()
        return self._rows(self._files(self.index_manifest(filter_, version)), filter_, fields, reference_read, version)

    df = read

    def _rows(self, files, filter_=None, fields=None, reference_read=False, version=None) -> DataFrame:
        out = self._scan(files)
        if filter_ is not None:
            out = out.where(as_column(filter_))
        names = self.schema.names if fields is None else list(fields)
        if missing := set(names) - set(self.schema.names):
            raise UserInputError(f"No such fields: {sorted(missing)}")
        out = out.select(*(f"`{n}`" for n in self.schema.names if n in names))
        for f in [] if reference_read else [r for r in self.record_fields if r in names]:
            # of a filtered table only the record files that its addresses point into are read
            paths = self._record_paths(f) if filter_ is None else records.files_of(out, f, self.location)
            out = records.fetch(out, f, paths, self.location)
        return out.select(*(f"`{n}`" for n in names))

    def read_all(self, *args, **kwargs) -> pa.Table | None:
        """All rows as an Arrow table; None if there are none."""
        out = self.read(*args, **kwargs).toArrow()
        return out if out.num_rows else None

    def read_batches(self, batch_size: int = 16, **kwargs) -> Iterator[pa.Table]:
        """Arrow tables of ``batch_size`` rows, partition by partition."""
        rows = self.read(**kwargs)
        schema, held = rows.limit(0).toArrow().schema, []
        for row in rows.toLocalIterator(prefetchPartitions=True):
            held.append(row.asDict(recursive=True))
            if len(held) == batch_size:
                yield pa.Table.from_pylist(held, schema)
                held = []
        if held:
            yield pa.Table.from_pylist(held, schema)

    def to_temp_view(self, name: str, **kwargs) -> None:
        self.read(**kwargs).createOrReplaceTempView(name)

    def _record_paths(self, field: str) -> list[str]:
        return sorted({self._path(p) for s in self.log.state["snapshots"].values() for p in s.get("records", {}).get(field, [])})

    # --- changes --------------------------------------------------------------------------

    def frame(self, data: Any) -> DataFrame:
        """A DataFrame of this table's schema from a DataFrame, an Arrow table, pandas, a dict of columns or a list of rows."""
        if isinstance(data, DataFrame):
            missing = set(self.schema.names) - set(data.columns)
            if missing:
                raise UserInputError(f"The data lack fields {sorted(missing)}")
            return data.select(*(F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in self.schema))
        if isinstance(data, dict):
            data = S.serialize(data, self.schema)
            data = [tuple(r) for r in zip(*(data[n] for n in self.schema.names), strict=True)]
            return self.spark.createDataFrame(data, self.schema)
        return self.frame(self.spark.createDataFrame(data, self.schema) if isinstance(data, list) else self.spark.createDataFrame(data))

    def _store(self, df: DataFrame) -> tuple[str, dict, dict]:
        placed, where = records.place(df, self.record_fields, self.location, self.aside()) if self.record_fields else (df, {})
        return *self._write(placed), where

    def _head(self) -> dict:
        return self.snapshot(self.branch)

    def _commit(self, parent: dict, manifests: list[str], added: list[str], deleted: list[str], rec: dict | None = None, **extra) -> JobResult:
        n = self._manifest(manifests).agg(F.count(F.lit(1)), F.sum("num_rows"), F.sum("bytes")).first()
        stats = {"num_files": n[0], "num_rows": n[1] or 0, "bytes": n[2] or 0}
        made = {}

        def change(state: dict) -> None:
            if state["refs"].get(self.branch, [None, None])[1] != parent["snapshot_id"]:
                raise ConflictError(f"Branch {self.branch} has been modified since the change began")
            at = max(map(int, state["snapshots"])) + 1
            made["id"] = at
            state["snapshots"][str(at)] = {"snapshot_id": at, "parent": parent["snapshot_id"], "create_time": time.time(), "manifests": manifests, "added": added, "deleted": deleted, "records": rec or {}, "stats": stats} | extra
            state["refs"][self.branch] = ["branch", at]

        self.log.put(change)
        return JobResult(JobResult.State.SUCCEEDED, "", made["id"], {k: stats[k] - parent["stats"][k] for k in stats})

    @mutation
    def append(self, data: Any) -> JobResult | None:
        """Add rows; keys are not checked. No rows: SKIPPED."""
        parent = self._head()
        manifest, stats, where = self._store(self.frame(data))
        return self._commit(parent, [*parent["manifests"], manifest], [manifest], [], where) if stats["num_rows"] else None

    @mutation
    def append_from(self, sources: Callable[[], Iterable] | list[Callable[[], Iterable]]) -> JobResult | None:
        """Add what functions without arguments yield (dicts of columns or Arrow tables), each run in a task of its own."""
        sources = sources if isinstance(sources, list) else [sources]
        kinds, arrow = self.schema, None
        arrow = self.spark.createDataFrame([], kinds).toArrow().schema

        def run(batches):
            for b in batches:
                for i in b.column("id").to_pylist():
                    for got in sources[i]():
                        got = got if isinstance(got, pa.Table) else pa.table(S.serialize(got, kinds))
                        yield from got.select(arrow.names).cast(arrow).to_batches()

        df = self.spark.range(0, len(sources), 1, len(sources)).mapInArrow(run, kinds)
        parent = self._head()
        manifest, stats, where = self._store(df)
        return self._commit(parent, [*parent["manifests"], manifest], [manifest], [], where) if stats["num_rows"] else None

    @mutation
    def append_parquet(self, pattern: str) -> JobResult | None:
        """Register Parquet files elsewhere without copying them. No match: SKIPPED."""
        if self.record_fields:
            raise UserInputError("A table with record fields can't take foreign Parquet files")
        try:
            names = self.spark.read.parquet(pattern).columns
        except AnalysisException as e:
            if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                return None
            raise
        if missing := set(self.schema.names) - set(names):
            raise UserInputError(f"The files lack fields {sorted(missing)}")
        found = self.spark.read.schema(S.physical(self.schema, [])).parquet(pattern)
        parent = self._head()
        # a URI in which signs are percent-encoded; decoded, as the reader takes plain paths
        manifest, stats = self._describe(found, lambda: F.col("_metadata.file_path"))
        rows = [tuple(r) for r in self._manifest([manifest]).collect()]
        if not rows:
            return None
        decoded = [(urllib.parse.unquote(r[0].removeprefix("file://")), *r[1:]) for r in rows]
        manifest, stats = self._put_manifest(self.spark.createDataFrame(decoded, self._manifest_schema()))
        return self._commit(parent, [*parent["manifests"], manifest], [manifest], [])

    @mutation
    def append_records(self, pattern: str, index_fn: Callable[[dict], dict], column: str | None = None) -> JobResult | None:
        """Register Parquet files that hold one record field; ``index_fn`` gives the other fields of a record."""
        if len(self.record_fields) != 1:
            raise UserInputError("Exactly one record field is needed")
        rows = records.index_foreign(self.spark, pattern, column or self.record_fields[0], self.record_fields[0], self.schema, index_fn)
        parent = self._head()
        manifest, stats = self._write(rows)
        return self._commit(parent, [*parent["manifests"], manifest], [manifest], [], {self.record_fields[0]: [pattern]}) if stats["num_rows"] else None

    def _touched(self, hits: DataFrame, manifest: DataFrame) -> DataFrame:
        """Manifest rows of the files that hold ``hits`` (rows of a scan, with its file path as _p).

        What reaches the driver is paths of files, as in any read.
        """
        plain = lambda p: "/" + urllib.parse.unquote(p).removeprefix("file:").lstrip("/") if p.startswith("file:") else p
        found = {plain(r[0]) for r in hits.select("_p").distinct().collect()}
        at = lambda f: f"/{self._path(f).removeprefix('file:').lstrip('/')}" if "://" not in self._path(f) or f.startswith("file:") else self._path(f)
        return self.spark.createDataFrame([tuple(r) for r in manifest.collect() if at(r["file"]) in found], self._manifest_schema())

    def _rewrite(self, parent: dict, touched: DataFrame, keep: Callable[[DataFrame], DataFrame], gone: Callable[[DataFrame], DataFrame]) -> tuple[list[str], list[str]]:
        """Write the survivors of the touched files; new manifests and the folder of deleted keys."""
        old = self._scan(self._files(touched))
        deleted = f"metadata/changes/{uuid.uuid4().hex}"
        gone(old).select(*(f"`{k}`" for k in self.primary_keys)).write.parquet(f"{self.location}/{deleted}")
        rest = self._manifest(parent["manifests"]).join(touched.select("file"), "file", "left_anti")
        survivors, stats = self._write(keep(old))
        manifest, n = self._put_manifest(rest.unionByName(self._manifest([survivors])) if stats["num_rows"] else rest)
        return [manifest] if n["num_files"] else [], [deleted]

    @mutation
    def delete(self, filter_: Predicate | Column | str) -> JobResult | None:
        """Remove rows for which ``filter_`` is true (not null). Only files that hold one are rewritten; none: SKIPPED."""
        parent, test = self._head(), as_column(filter_)
        manifest = self.index_manifest(filter_, parent["snapshot_id"])
        touched = self._touched(self._named(manifest).where(test), manifest)
        if touched.isEmpty():
            return None
        manifests, deleted = self._rewrite(parent, touched, lambda df: df.where(~F.coalesce(test, F.lit(False))), lambda df: df.where(test))
        return self._commit(parent, manifests, [], deleted)

    @mutation
    def delete_keys(self, data: DataFrame) -> JobResult | None:
        """Remove the rows whose keys stand in ``data`` (columns of the keys, any number of rows). None: SKIPPED."""
        pk, path = self.primary_keys, f"{self.location}/{self.aside()}"
        data.select(*(F.col(f"`{k}`").cast(self.schema[k].dataType).alias(k) for k in pk)).distinct().write.parquet(path)
        keys, parent = self.spark.read.parquet(path), self._head()
        manifest = self._matching(keys, parent)
        touched = self._touched(self._named(manifest).join(keys, pk, "left_semi"), manifest)
        if touched.isEmpty():
            return None
        manifests, deleted = self._rewrite(parent, touched, lambda o: o.join(keys, pk, "left_anti").select(o.columns), lambda o: o.join(keys, pk, "left_semi"))
        return self._commit(parent, manifests, [], deleted)

    def _matching(self, keys: DataFrame, parent: dict) -> DataFrame:
        """Manifest rows of the files whose bounds meet the bounds of ``keys``."""
        bounds = keys.agg(*(f(f"`{k}`") for k in self.primary_keys for f in (F.min, F.max))).first()
        out = self._manifest(parent["manifests"])
        for i, k in enumerate(self.primary_keys):
            lo, hi = bounds[2 * i], bounds[2 * i + 1]
            out = out.where(F.coalesce((F.col(f"`_MAX_{k}`") >= F.lit(lo)) & (F.col(f"`_MIN_{k}`") <= F.lit(hi)), F.lit(True))) if lo is not None else out.where("false")
        return out

    def _staged(self, data: Any) -> DataFrame:
        """The input, written once: it is read several times."""
        path = f"{self.location}/{self.aside()}"
        df = self.frame(data)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def _write_keys(self, data: Any, replace: bool, **extra) -> JobResult | None:
        parent, df, pk = self._head(), self._staged(data), self.primary_keys
        keys = df.select(*(f"`{k}`" for k in pk))
        if df.isEmpty() and not extra:
            return None
        if not keys.where(" or ".join(f"`{k}` is null" for k in pk)).isEmpty():
            raise UserInputError("A primary key of the input is null")
        if not keys.groupBy(*(f"`{k}`" for k in pk)).count().where("count > 1").isEmpty():
            raise PrimaryKeyExistError("A primary key stands twice in the input")
        manifest = self._matching(keys, parent)
        scan = self._named(manifest)
        if not replace:
            if not scan.join(keys, pk, "left_semi").isEmpty():
                raise PrimaryKeyExistError("Primary key to insert already exist")
            manifests, deleted = parent["manifests"], []
        else:
            touched = self._touched(scan.join(keys, pk, "left_semi"), manifest)
            manifests, deleted = parent["manifests"], []
            if not touched.isEmpty():
                manifests, deleted = self._rewrite(parent, touched, lambda o: o.join(keys, pk, "left_anti").select(o.columns), lambda o: o.join(keys, pk, "left_semi"))
        new, stats, where = self._store(df)
        return self._commit(parent, [*manifests, new], [new], deleted, where, **extra)

    @mutation
    def insert(self, data: Any) -> JobResult | None:
        """Add rows whose keys are new; FAILED if one is not."""
        return self._write_keys(data, False)

    @mutation
    def upsert(self, data: Any) -> JobResult | None:
        """Replace rows of the same keys and add the others, in one snapshot."""
        return self._write_keys(data, True)

    # --- change feed ----------------------------------------------------------------------

    def _ancestors(self, snapshot_id: int) -> list[dict]:
        out, at = [], snapshot_id
        while at is not None:
            out.append(self.log.state["snapshots"][str(at)])
            at = out[-1]["parent"]
        return out

    def changed(self, start: int | str, end: int | str) -> list[dict]:
        """Snapshots after ``start`` up to ``end``, oldest first."""
        self.log.reload()
        a, b = self.snapshot(start)["snapshot_id"], self.snapshot(end)["snapshot_id"]
        if a >= b:
            raise UserInputError(f"The start {a} must be before the end {b}")
        line = self._ancestors(b)
        if a not in [s["snapshot_id"] for s in line]:
            raise UserInputError(f"Snapshot {a} is not an ancestor of {b}")
        return [s for s in reversed(line) if s["snapshot_id"] > a]

    def deleted_rows(self, snap: dict) -> DataFrame:
        keys = T.StructType([T.StructField(f.name, f.dataType) for f in self.schema if f.name in self.primary_keys])
        return self.spark.read.schema(keys).parquet(*(self._path(p) for p in snap["deleted"])) if snap["deleted"] else self.spark.createDataFrame([], keys)

    def added_rows(self, snap: dict, filter_=None, fields=None, reference_read: bool = False) -> DataFrame:
        return self._rows(self._files(self._manifest(snap["added"])), filter_, fields, reference_read)

    # --- maintenance ----------------------------------------------------------------------

    @mutation
    def compact(self, files: int = 1) -> JobResult | None:
        """Rewrite the current version's files into ``files`` of them, sorted by key; rows and feed don't change.

        Ranges of about ``RANGE_BYTES`` are sorted each by a task of its own and then
        copied in order, so that no task sorts a whole file.
        """
        parent = self._head()
        if parent["stats"]["num_files"] <= files:
            return None
        rows = self._scan(self._files(self._manifest(parent["manifests"])))
        keys, path = [f"`{k}`" for k in self.primary_keys], f"{self.location}/{self.aside()}"
        n = files * max(1, -(-parent["stats"]["bytes"] // (files * RANGE_BYTES)))
        rows.repartitionByRange(n, *keys).sortWithinPartitions(*keys).write.parquet(path)
        # names tell the order; a partition of several files would be read by their sizes
        ranges = sorted(self.spark.read.schema(rows.schema).parquet(path).inputFiles())
        ends = [-(-len(ranges) * i // files) for i in range(files + 1)]
        copies = [functools.reduce(DataFrame.union, [self.spark.read.schema(rows.schema).parquet(r) for r in ranges[a:b]]).coalesce(1) for a, b in zip(ends, ends[1:], strict=False) if a < b]
        # a job for each: a union of frames of one partition may be one partition
        manifest, _ = self._write(*(copies or [rows]))
        return self._commit(parent, [manifest], [], [])

