"""Views: map, filter and join over tables, their change feed, and materialised views."""

from __future__ import annotations

import posixpath
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import StorageNotFoundError, UserInputError, VersionNotFoundError
from .predicate import field


@dataclass(frozen=True)
class Range:
    """Keys from ``min_`` up to ``max_``, which belongs to it only if ``include_max``."""

    min_: Any
    max_: Any
    include_max: bool = False


class View:
    """What can be read, followed, and built on. ``df`` takes the filter on source rows, fields and a version."""

    spark: Any
    schema: T.StructType
    primary_keys: list[str]

    def df(self, filter_=None, fields=None, version=None, reference_read: bool = False) -> DataFrame:
        raise NotImplementedError

    def leaves(self) -> list:
        raise NotImplementedError

    def plan(self, udfs: dict) -> dict:
        raise NotImplementedError

    def transform(self, rows: DataFrame) -> DataFrame:
        """What the view makes of rows of its only table; a table takes them as they are."""
        return rows

    def read_all(self, **kwargs):
        out = self.df(**kwargs).toArrow()
        return out if out.num_rows else None

    def map_batches(self, fn: Callable[[dict], dict], output_schema: T.StructType | str, input_fields: list[str] | None = None, batch_size: int | None = None, primary_keys: list[str] | None = None) -> View:
        return MapView(self, fn, output_schema, input_fields, batch_size, primary_keys)

    def filter(self, fn: Callable[[dict], bool], input_fields: list[str] | None = None) -> View:
        return FilterView(self, fn, input_fields)

    def join(self, right: View, keys: list[str], left_fields: list[str] | None = None, right_fields: list[str] | None = None, how: str = "inner", left_reference_read: bool = False, right_reference_read: bool = False, partition_fn: Callable[[Range], list[Range]] | None = None) -> View:
        return JoinView(self, right, keys, left_fields, right_fields, how, left_reference_read, right_reference_read, partition_fn)

    def diff(self, start: int | str, end: int | str) -> DataFrame:
        """_snapshot_id, _change_type and the rows: deleted keys (other fields null) and added rows, which pass through the view."""
        (leaf,) = self.leaves() if len(self.leaves()) == 1 else [None]
        if leaf is None:
            raise UserInputError("The changes of a join can't be followed")
        out = None
        for snap in leaf.changed(start, end):
            for df in self.snapshot_changes(leaf, snap):
                out = df if out is None else out.unionByName(df, allowMissingColumns=True)
        return out

    def snapshot_changes(self, leaf, snap: dict) -> list[DataFrame]:
        tag = lambda df, kind: df.select(F.lit(snap["snapshot_id"]).cast("long").alias("_snapshot_id"), F.lit(kind).alias("_change_type"), "*")
        added = self.transform(leaf.added_rows(snap))
        gone = leaf.deleted_rows(snap)
        for f in added.schema:
            if f.name not in gone.columns:
                gone = gone.withColumn(f.name, F.lit(None).cast(f.dataType))
        return [tag(gone.select(added.columns), "DELETE"), tag(added, "ADD")]

    def materialize(self, location: str) -> MaterializedView:
        """Keep the view's plan and functions at ``location``, with an empty table for its rows."""
        from ..table import Dataset

        if len(self.leaves()) != 1:
            raise UserInputError("A view of one table can be materialised; a join can't")
        if missing := set(self.leaves()[0].primary_keys) - set(self.schema.names):
            raise UserInputError(f"The view must hold the keys of its source to follow its deletes; it lacks {sorted(missing)}")
        udfs: dict[str, bytes] = {}
        plan = self.plan(udfs)
        Dataset.create(self.spark, location, self.schema, self.primary_keys, [], plan=plan, udfs=list(udfs))
        store = Dataset.load(self.spark, location).log.store
        for name, data in udfs.items():
            store.put_new(f"metadata/udfs/{name}.pkl", data)
        return MaterializedView.load(self.spark, location)


def _batched(frames: Iterator[pd.DataFrame], size: int | None) -> Iterator[pd.DataFrame]:
    if not size:
        yield from frames
        return
    held = None
    for pdf in frames:
        held = pdf if held is None or held.empty else pd.concat([held, pdf], ignore_index=True)
        while len(held) >= size:
            yield held.iloc[:size].reset_index(drop=True)
            held = held.iloc[size:]
    if held is not None and len(held):
        yield held.reset_index(drop=True)


class _Unary(View):
    def __init__(self, input_: View, fn: Callable, input_fields: list[str] | None):
        self.input, self.fn, self.spark = input_, fn, input_.spark
        self.input_fields = list(input_fields or input_.schema.names)
        if missing := set(self.input_fields) - set(input_.schema.names):
            raise UserInputError(f"The input has no fields {sorted(missing)}")
        if not set(input_.primary_keys) <= set(self.input_fields):
            raise UserInputError(f"The fields must hold the primary keys {input_.primary_keys}")

    def leaves(self) -> list:
        return self.input.leaves()

    def _input(self, filter_, version) -> DataFrame:
        from ..table import Dataset

        # the filter and the fields go to the table itself, below the functions
        return self.input.df(filter_=filter_, version=version, **({"fields": self.input_fields} if isinstance(self.input, Dataset) else {}))

    def df(self, filter_=None, fields=None, version=None, reference_read: bool = False) -> DataFrame:
        out = self._apply(self._input(filter_, version).select(*(f"`{f}`" for f in self.input_fields)))
        return out.select(*(f"`{f}`" for f in fields)) if fields else out

    def transform(self, rows: DataFrame) -> DataFrame:
        return self._apply(self.input.transform(rows).select(*(f"`{f}`" for f in self.input_fields)))

    def _udf(self, udfs: dict) -> str:
        udfs[name := f"udf{len(udfs)}"] = cloudpickle.dumps(self.fn)
        return name


class MapView(_Unary):
    """``fn`` on batches: a dict of numpy columns in, a dict of columns out (of any number of rows)."""

    def __init__(self, input_, fn, output_schema, input_fields=None, batch_size=None, primary_keys=None):
        super().__init__(input_, fn, input_fields)
        self.schema = T._parse_datatype_string(output_schema) if isinstance(output_schema, str) else output_schema
        self.batch_size, self.primary_keys = batch_size, list(primary_keys or input_.primary_keys)
        if not set(self.primary_keys) <= set(self.schema.names):
            raise UserInputError(f"The output must hold the primary keys {self.primary_keys}")

    def _apply(self, rows: DataFrame) -> DataFrame:
        fn, size, names = self.fn, self.batch_size, self.schema.names

        def run(frames):
            for pdf in _batched(frames, size):
                out = fn({c: pdf[c].to_numpy() for c in pdf.columns})
                yield pd.DataFrame({n: list(out[n]) for n in names})

        return rows.mapInPandas(run, self.schema)

    def plan(self, udfs: dict) -> dict:
        return {"op": "map", "input": self.input.plan(udfs), "udf": self._udf(udfs), "schema": self.schema.jsonValue(), "fields": self.input_fields, "batch_size": self.batch_size, "keys": self.primary_keys}


class FilterView(_Unary):
    """Rows (dicts of ``input_fields``) for which ``fn`` is true."""

    def __init__(self, input_, fn, input_fields=None):
        super().__init__(input_, fn, input_fields)
        self.schema = T.StructType([f for f in input_.schema if f.name in self.input_fields])
        self.primary_keys = input_.primary_keys

    def _apply(self, rows: DataFrame) -> DataFrame:
        fn = self.fn

        def run(frames):
            for pdf in frames:
                yield pdf[[bool(fn(r)) for r in pdf.to_dict("records")]]

        return rows.mapInPandas(run, rows.schema)

    def plan(self, udfs: dict) -> dict:
        return {"op": "filter", "input": self.input.plan(udfs), "udf": self._udf(udfs), "fields": self.input_fields}


class JoinView(View):
    """Equi-join on one key that is a primary key of both sides; the strategy is Spark's, or ranges given by ``partition_fn``."""

    def __init__(self, left, right, keys, left_fields, right_fields, how, left_reference, right_reference, partition_fn):
        if len(keys) != 1:
            raise UserInputError("Exactly one join key is supported")
        (self.key,) = keys
        for side in (left, right):
            if self.key not in side.primary_keys:
                raise UserInputError(f"Join key {self.key} must be a primary key of both sides")
        self.left, self.right, self.how, self.spark = left, right, how, left.spark
        self.references, self.partition_fn = (left_reference, right_reference), partition_fn
        self.fields = [[n for n in side.schema.names if n != self.key and (f is None or n in f)] for side, f in ((left, left_fields), (right, right_fields))]
        for f, asked, side in zip(self.fields, (left_fields, right_fields), (left, right), strict=True):
            if missing := set(asked or []) - set(side.schema.names):
                raise UserInputError(f"No such fields: {sorted(missing)}")
            if not f:
                raise UserInputError("Each side must give a field beside the join key")
        if both := set(self.fields[0]) & set(self.fields[1]):
            raise UserInputError(f"Both sides give fields {sorted(both)}")
        self.primary_keys = [self.key]
        self.schema = T.StructType([left.schema[self.key], *(left.schema[n] for n in self.fields[0]), *(right.schema[n] for n in self.fields[1])])

    def leaves(self) -> list:
        return [*self.left.leaves(), *self.right.leaves()]

    def _side(self, i: int, filter_=None) -> DataFrame:
        side = (self.left, self.right)[i]
        return side.df(filter_=filter_, fields=[self.key, *self.fields[i]], reference_read=self.references[i])

    def df(self, filter_=None, fields=None, version=None, reference_read: bool = False) -> DataFrame:
        if filter_ is not None or version is not None:
            raise UserInputError("Filter and version belong to the sides of a join; filter its result instead")
        if self.partition_fn is None:
            out = self._joined(self._side(0), self._side(1))
        else:
            out = self._by_ranges()
        names = fields or self.schema.names
        return out.select(*(f"`{n}`" for n in names))

    def _joined(self, left: DataFrame, right: DataFrame) -> DataFrame:
        return left.join(right, self.key, self.how)

    def _bounds(self, side: View):
        """Smallest and largest key of a side: of a table from its manifest, without reading a data file."""
        if hasattr(side, "index_manifest"):
            return side.index_manifest().agg(F.min(f"`_MIN_{self.key}`"), F.max(f"`_MAX_{self.key}`")).first()
        return side.df(fields=[self.key]).agg(F.min(self.key), F.max(self.key)).first()

    def _by_ranges(self) -> DataFrame:
        if self.how != "inner":
            raise UserInputError("Only an inner join can be done by ranges")
        bounds = [self._bounds(side) for side in (self.left, self.right)]
        out = self._joined(self._side(0), self._side(1)).limit(0)
        if any(b[0] is None for b in bounds):
            return out
        whole = Range(max(b[0] for b in bounds), min(b[1] for b in bounds), True)
        parts = self.partition_fn(whole) if whole.min_ <= whole.max_ else []
        key = field(self.key)
        for r in parts:
            # as a predicate, so that each side's files are pruned
            test = (key >= r.min_) & ((key <= r.max_) if r.include_max else (key < r.max_))
            part = self._joined(self._side(0, test), self._side(1, test))
            out = part if r is parts[0] else out.unionByName(part)
        return out


def view_of(spark, plan: dict, load: Callable[[str], Callable], base: str) -> View:
    """The view that a stored plan describes."""
    from ..table import Dataset

    if plan["op"] == "read":
        at = plan["location"]
        return Dataset.load(spark, at if at.startswith("/") or "://" in at else posixpath.normpath(posixpath.join(base, at)))
    inner = view_of(spark, plan["input"], load, base)
    if plan["op"] == "map":
        return MapView(inner, load(plan["udf"]), T.StructType.fromJson(plan["schema"]), plan["fields"], plan["batch_size"], plan["keys"])
    return FilterView(inner, load(plan["udf"]), plan["fields"])


class MaterializedView:
    """A table that follows a view's source snapshot by snapshot. Load only what you trust: stored functions run."""

    def __init__(self, dataset, view: View):
        self.dataset, self.view = dataset, view

    @classmethod
    def load(cls, spark, location: str) -> MaterializedView:
        from ..table import Dataset

        dataset = Dataset.load(spark, location)
        if "plan" not in dataset.log.state:
            raise StorageNotFoundError(f"{location} is not a materialised view")
        load = lambda name: cloudpickle.loads(dataset.log.store.read(f"metadata/udfs/{name}.pkl"))
        return cls(dataset, view_of(spark, dataset.log.state["plan"], load, location))

    def df(self, **kwargs) -> DataFrame:
        """The stored rows, which may lag behind the source."""
        return self.dataset.read(**kwargs)

    def refresh(self, target_version: int | str | None = None) -> list:
        """Follow the source up to a version (its head by default); a result for each of its snapshots, none if up to date."""
        (source,) = self.view.leaves()
        source.log.reload()
        self.dataset.log.reload()
        done = self.dataset.snapshot().get("source_snapshot_id", 0)
        target = source.snapshot(target_version)["snapshot_id"]
        head = source.snapshot()["snapshot_id"]
        if target > head:
            raise VersionNotFoundError(f"Snapshot {target} is past the source's head {head}")
        if target <= done:
            return []
        return [self._follow(source, snap) for snap in source.changed(done, target)]

    def _follow(self, source, snap: dict):
        """Delete the keys that the snapshot deleted and add what the view makes of its added rows, in one commit."""
        mv = self.dataset
        try:
            added = mv._staged(self.view.transform(source.added_rows(snap)))
            gone, keys, parent = source.deleted_rows(snap), source.primary_keys, mv._head()
            manifests, deleted = parent["manifests"], []
            if snap["deleted"]:
                # files are pruned by the view's own keys, where these are the source's too
                manifest = mv._matching(gone, parent) if set(keys) == set(mv.primary_keys) else mv._manifest(manifests)
                touched = mv._touched(mv._named(manifest).join(gone, keys, "left_semi"), manifest)
                if not touched.isEmpty():
                    manifests, deleted = mv._rewrite(parent, touched, lambda o: o.join(gone, keys, "left_anti").select(o.columns), lambda o: o.join(gone, keys, "left_semi"))
            new, stats, where = mv._store(added)
            some = bool(stats["num_rows"])
            return mv._commit(parent, [*manifests, new] if some else manifests, [new] if some else [], deleted, where, source_snapshot_id=snap["snapshot_id"])
        finally:
            mv.clear()
