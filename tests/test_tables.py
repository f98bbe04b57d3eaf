"""Behaviour of the table layer that its queries don't show: states, refusals, conflicts, pruning, what is left behind."""

import os
import random
import threading

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from shalebed import errors
from shalebed.operators import Dataset, DirCatalog, JobResult, RandomAccess, compare, field
from shalebed.plans.predicate import Both, Either, as_column

DONE, FAILED, SKIPPED = JobResult.State.SUCCEEDED, JobResult.State.FAILED, JobResult.State.SKIPPED


@pytest.fixture
def table(spark, tmp_path):
    t = Dataset.create(spark, str(tmp_path / "t"), "id long, x double, s string", ["id"])
    for lo in (0, 10, 20):
        assert t.append(t.frame({"id": list(range(lo, lo + 10)), "x": [i / 2 for i in range(lo, lo + 10)], "s": [f"s{i}" for i in range(lo, lo + 10)]}).coalesce(1)).state is DONE
    return t


def ids(df):
    return sorted(r.id for r in df.collect())


def test_states_and_messages(table):
    none = {"id": [], "x": [], "s": []}
    assert table.append(none).state is SKIPPED and table.insert(none).state is SKIPPED and table.upsert(none).state is SKIPPED
    assert table.delete(field("id") > 99).state is SKIPPED
    got = table.insert({"id": [3, 77], "x": [0.0, 0.0], "s": ["", ""]})
    assert (got.state, got.message) == (FAILED, "Primary key to insert already exist")
    assert table.insert({"id": [77, 77], "x": [0.0, 0.0], "s": ["", ""]}).state is FAILED
    for change in (table.insert, table.upsert):
        got = change({"id": [None, 5], "x": [0.0, 0.0], "s": ["", ""]})
        assert got.state is FAILED and "null" in got.message
    assert table.append(table.read().drop("s")).state is FAILED
    assert ids(table.read()) == list(range(30)) and table.snapshot()["snapshot_id"] == 3


def test_nothing_is_left_aside(table):
    table.upsert({"id": [1, 40], "x": [9.0, 9.0], "s": ["new", "new"]})
    table.insert({"id": [1], "x": [9.0], "s": ["new"]})
    table.delete_keys(table.read(field("id") == 2))
    assert not os.listdir(os.path.join(table.location, "tmp"))
    assert ids(table.read()) == [i for i in [*range(30), 40] if i != 2]


def test_conflict_on_one_branch(spark, table):
    other = Dataset.load(spark, table.location)
    row = {"id": [50], "x": [0.0], "s": ["a"]}
    parent = other._head()
    manifest, _, _ = other._store(other.frame(row))
    assert table.append(row).state is DONE
    with pytest.raises(errors.ConflictError, match="has been modified"):
        other._commit(parent, [*parent["manifests"], manifest], [manifest], [])
    assert ids(table.read()) == [*range(30), 50]


def test_writers_at_once_on_branches_of_their_own(spark, table):
    results = {}
    for b in ("left", "right"):
        table.add_branch(b)

    def write(b, key):
        t = Dataset.load(spark, table.location)
        t.set_current_branch(b)
        results[b] = t.append({"id": [key], "x": [0.0], "s": [b]}).state

    threads = [threading.Thread(target=write, args=a) for a in (("left", 100), ("right", 200))]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert set(results.values()) == {DONE}
    assert ids(table.read(version="left"))[-1] == 100 and ids(table.read(version="right"))[-1] == 200 and ids(table.read())[-1] == 29


def test_references(table):
    table.add_tag("one", 1)
    assert ids(table.read(version="one")) == list(range(10))
    for name, error in (("one", errors.UserInputError), ("main", errors.UserInputError), ("", errors.UserInputError)):
        with pytest.raises(error):
            table.add_tag(name)
    with pytest.raises(errors.VersionNotFoundError):
        table.add_tag("two", 99)
    with pytest.raises(errors.VersionNotFoundError):
        table.remove_branch("one")
    with pytest.raises(errors.UserInputError):
        table.set_current_branch("one")
    table.add_branch("b")
    table.set_current_branch("b")
    with pytest.raises(errors.UserInputError):
        table.remove_branch("b")
    table.set_current_branch("main")
    table.remove_branch("b")
    table.remove_tag("one")
    with pytest.raises(errors.VersionNotFoundError):
        table.read(version="one")
    with pytest.raises(errors.VersionNotFoundError):
        table.read(version=99)


@pytest.mark.parametrize(("schema", "keys", "records"), [("id long", [], []), ("id long", ["no"], []), ("id long, b binary", ["id"], ["no"]), ("id long, b binary", ["b"], ["b"]), ("id long, s string", ["id"], ["s"])])
def test_refused_schemas(spark, tmp_path, schema, keys, records):
    with pytest.raises(errors.TableError):
        Dataset.create(spark, str(tmp_path / "t"), schema, keys, records)


def test_create_and_load_refusals(spark, table, tmp_path):
    with pytest.raises(errors.StorageExistError):
        Dataset.create(spark, table.location, "id long", ["id"])
    with pytest.raises(errors.StorageNotFoundError):
        Dataset.load(spark, str(tmp_path / "none"))


def test_catalog(spark, tmp_path):
    c = DirCatalog(spark, str(tmp_path / "c"))
    assert c.datasets() == []
    t = c.create_dataset("a", "id long, x double", ["id"])
    t.append({"id": [1], "x": [0.5]})
    mv = c.materialize("m", t.filter(lambda b: [x > 0 for x in b["x"]] if isinstance(b["x"], list) else b["x"] > 0))
    mv.refresh()
    assert sorted(c.datasets()) == ["a", "m"] and sorted(c.register()) == ["a", "m"]
    assert spark.sql("SELECT a.id FROM a JOIN m USING (id)").count() == 1
    c.delete_dataset("a")
    assert c.datasets() == ["m"]
    with pytest.raises(errors.StorageNotFoundError):
        c.delete_dataset("a")
    with pytest.raises(errors.StorageNotFoundError):
        c.dataset("a")


def test_batches_keep_the_schema(table):
    table.append({"id": [30], "x": [None], "s": [None]})
    got = list(table.read_batches(batch_size=7))
    assert [b.num_rows for b in got] == [7, 7, 7, 7, 3] and len({b.schema for b in got}) == 1
    assert sorted(pa.concat_tables(got)["id"].to_pylist()) == list(range(31))
    assert table.read_all(filter_=field("id") > 99) is None and table.read_all().num_rows == 31


def test_pruned_files(table):
    count = lambda p: table.index_manifest(p).count()
    assert [count(p) for p in (None, field("id") < 10, field("id") >= 20, field("id") == 15, field("id").isin(1, 25), field("x") > 99)] == [3, 1, 1, 1, 2, 3]
    assert count(compare(">", 1, 2)) == 0 and count(compare("<", 1, 2)) == 3 and count(~compare("<", 1, 2)) == 0
    assert count(compare(">", 10, field("id"))) == 1
    assert ids(table.read(field("s").is_null())) == [] and len(ids(table.read(~field("s").is_null()))) == 30
    assert ids(table.read(~field("id").isin([1, 2]) & (field("id") < 4))) == [0, 3]


def test_pruning_loses_nothing(table):
    rng = random.Random(4)

    def some(depth):
        if depth == 0 or rng.random() < 0.3:
            f = field(rng.choice(["id", "id", "x"]))
            if rng.random() < 0.2:
                return f.isin(rng.sample(range(35), 3))
            p = compare(rng.choice(["<", "<=", ">", ">=", "==", "!="]), *rng.sample([f, rng.randrange(-2, 33)], 2))
        else:
            p = rng.choice([Both, Either])(some(depth - 1), some(depth - 1))
        return ~p if rng.random() < 0.3 else p

    rows = table.read().cache()
    for _ in range(25):
        p = some(3)
        assert ids(table.read(p)) == ids(rows.where(as_column(p)))


def test_foreign_files(spark, table, tmp_path):
    assert table.append_parquet(str(tmp_path / "none" / "*.parquet")).state is SKIPPED
    rows = spark.createDataFrame([(60, 1.0, "a b")], "id long, x double, s string")
    rows.write.parquet(str(tmp_path / "in"))
    rows.drop("s").write.parquet(str(tmp_path / "less"))
    assert table.append_parquet(str(tmp_path / "in")).state is DONE
    got = table.append_parquet(str(tmp_path / "less"))
    assert got.state is FAILED and "lack" in got.message
    assert ids(table.read()) == [*range(30), 60]


def test_write_options(table):
    table.write_options = {"maxRecordsPerFile": 2}
    table.append(table.read(field("id") < 8).withColumn("id", F.col("id") + 100).coalesce(1))
    assert table.index_manifest(field("id") >= 100).count() == 4


@pytest.mark.parametrize("files", [1, 2])
def test_compaction_sorts_ranges_not_whole_files(spark, tmp_path, monkeypatch, files):
    from shalebed import table as T

    t = Dataset.create(spark, str(tmp_path / "t"), "id long, x double", ["id"])
    for k in range(3):
        t.append(spark.range(k, 3000, 3).selectExpr("id", "rand(1) as x"))
    monkeypatch.setattr(T, "RANGE_BYTES", t.snapshot()["stats"]["bytes"] // 9, raising=False)
    before, sorts, sort = sorted(map(tuple, t.read().collect())), [], type(t.read()).repartitionByRange

    def told(self, n, *cols):
        sorts.append(n)
        return sort(self, n, *cols)

    monkeypatch.setattr(type(t.read()), "repartitionByRange", told)
    assert t.compact(files).state is DONE and sorts[0] >= 9
    held = [[r.id for r in spark.read.parquet(p).coalesce(1).collect()] for p in t.index_files()]
    assert len(held) == files and all(h == sorted(h) for h in held)
    assert files == 1 or max(min(held)) < min(max(held))
    assert sorted(map(tuple, t.read().collect())) == before
    assert not os.listdir(os.path.join(t.location, "tmp"))


@pytest.fixture
def records(spark, tmp_path):
    t = Dataset.create(spark, str(tmp_path / "r"), "id long, b binary, c binary", ["id"], ["b", "c"])
    for lo in range(0, 40, 10):
        t.append(spark.createDataFrame([(i, f"b{i}".encode(), None if i % 5 == 0 else f"c{i}".encode()) for i in range(lo, lo + 10)], t.schema).coalesce(1))
    return t


def test_a_filtered_read_opens_only_the_records_it_needs(records):
    opened = lambda df: {f for f in df.inputFiles() if "/records/" in f}
    assert len(opened(records.read())) == 8
    one = records.read(field("id") == 17)
    assert len(opened(one)) == 2 and [(r.b, r.c) for r in one.collect()] == [(b"b17", b"c17")]
    assert records.read(field("id") == 99).count() == 0
    assert records.record_manifest().count() == 8 and {r.field for r in records.record_manifest().collect()} == {"b", "c"}
    assert not os.listdir(os.path.join(records.location, "tmp"))


def test_random_access(records):
    records.delete(field("id") == 3)
    order = [i for i in range(40) if i != 3]
    one, two = RandomAccess(records, "b", load=bytes.decode), RandomAccess(records, ["c", "b"])
    assert len(one) == 39 and [one[i] for i in (0, 3, -1)] == ["b0", "b4", "b39"]
    assert one[[5, 38, 5]] == ["b6", "b39", "b6"] and one[2:6] == [f"b{i}" for i in order[2:6]]
    assert two[4] == {"c": None, "b": b"b5"} or two[4]["b"] == b"b5"
    with pytest.raises(IndexError):
        one[39]
    one.close()
    two.close()
    assert not os.listdir(os.path.join(records.location, "tmp"))


def test_random_access_of_any_size_stays_off_the_driver(spark, records, monkeypatch):
    records.delete(field("id") == 3)
    two = RandomAccess(records, ["c", "b"])
    got = sorted((r.id, r.b, r.c) for r in two.frame(spark.createDataFrame([(0,), (-1,), (3,), (3,), (5,)], "at int")).collect())
    assert got == [(0, b"b0", None), (4, b"b4", b"c4"), (4, b"b4", b"c4"), (6, b"b6", b"c6"), (39, b"b39", b"c39")]
    for bad in (39, -40, None):
        with pytest.raises(IndexError):
            two.frame(spark.createDataFrame([(bad,)], "at long"))
    kind = type(records.read())
    seen, collect = [], kind.collect

    def told(self):
        seen.extend(out := collect(self))
        return out

    monkeypatch.setattr(kind, "collect", told)
    from shalebed import queries

    pages = queries.queries()["random_access_rows"](spark, "/root/testdata/sf0.001")
    assert len(seen) < 100 and not any(isinstance(v, (bytes, str)) and len(v) > 300 for r in seen for v in r)
    assert pages.count() == spark.read.parquet("/root/testdata/sf0.001/pages.parquet").count() > 0


def test_a_view_must_hold_the_keys_of_its_source(spark, tmp_path):
    t = Dataset.create(spark, str(tmp_path / "t"), "id long, turn long, x double", ["id", "turn"])
    t.append({"id": [1, 1, 2], "turn": [0, 1, 0], "x": [1.0, 2.0, 3.0]})
    with pytest.raises(errors.UserInputError, match="keys of its source"):
        t.map_batches(lambda b: {"id": b["id"], "x": b["x"]}, "id long, x double", primary_keys=["id"]).materialize(str(tmp_path / "no"))
    mv = t.map_batches(lambda b: {"id": b["id"], "turn": b["turn"], "y": b["x"]}, "id long, turn long, y double", primary_keys=["id"]).materialize(str(tmp_path / "mv"))
    mv.refresh()
    t.delete(field("x") == 1.0)
    t.upsert({"id": [1, 3], "turn": [1, 0], "x": [9.0, 4.0]})
    mv.refresh()
    assert sorted((r.id, r.turn, r.y) for r in mv.df().collect()) == [(1, 1, 9.0), (2, 0, 3.0), (3, 0, 4.0)]
    assert mv.refresh() == []


def test_changes_through_a_view(table):
    view = table.map_batches(lambda b: {"id": b["id"], "y": [2 * x for x in b["x"]]}, "id long, y double")
    table.upsert({"id": [1, 90], "x": [7.0, 8.0], "s": ["a", "b"]})
    got = sorted((r._change_type, r.id, r.y) for r in view.diff(3, 4).collect())
    assert got == [("ADD", 1, 14.0), ("ADD", 90, 16.0), ("DELETE", 1, None)]
