"""Query functions over the driver's tables and the SQL they are compared with.

Each builds a table from whole source tables by the operation it is about, and reads it.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.schema import file_field, full_path
from .operators import Dataset, DirCatalog, RandomAccess, Range, field
from .streaming.feed import follow

_Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None) -> Callable:
    def add(f):
        _Q[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def _home(spark: SparkSession) -> str:
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{(shared or tempfile.mkdtemp(prefix='shalebed-')).rstrip('/')}/{uuid.uuid4().hex}"


def _src(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _table(spark: SparkSession, sf: str, name: str, keys: list[str], records: list[str] | None = None, df: DataFrame | None = None, at: int | None = None) -> Dataset:
    """A table of a source's rows; two appends, cut at key ``at``, if that is given."""
    df = _src(spark, sf, name) if df is None else df
    out = Dataset.create(spark, _home(spark), df.schema, keys, records)
    for part in [df] if at is None else [df.where(F.col(keys[0]) < at), df.where(F.col(keys[0]) >= at)]:
        out.append(part)
    return out


def _orders(spark: SparkSession, sf: str, at: int | None = 1000) -> Dataset:
    return _table(spark, sf, "orders", ["o_orderkey"], at=at)


_O = "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders"


@query(_O)
def read_all(spark, sf):
    return _orders(spark, sf).read()


@query("SELECT o_orderpriority, o_orderkey FROM orders")
def read_fields(spark, sf):
    return _orders(spark, sf).read(fields=["o_orderpriority", "o_orderkey"])


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey >= 1000 AND o_orderkey < 1200")
def read_pk_range_pruned(spark, sf):
    k = field("o_orderkey")
    return _orders(spark, sf).read((k >= 1000) & (k < 1200), ["o_orderkey", "o_totalprice"])


@query(f"{_O} WHERE NOT (o_orderkey >= 900)")
def read_not(spark, sf):
    return _orders(spark, sf).read(~(field("o_orderkey") >= 900))


@query(f"{_O} WHERE o_orderkey < 50 OR o_orderkey > 1400")
def read_or(spark, sf):
    return _orders(spark, sf).read((field("o_orderkey") < 50) | (field("o_orderkey") > 1400))


@query(f"{_O} WHERE o_orderkey <> 7")
def read_ne(spark, sf):
    return _orders(spark, sf).read(field("o_orderkey") != 7)


@query(f"{_O} WHERE o_totalprice > 100000 AND o_orderstatus = 'O'")
def read_non_pk(spark, sf):
    return _orders(spark, sf).read((field("o_totalprice") > 100000.0) & (field("o_orderstatus") == "O"))


@query("SELECT conv_id, turn, role FROM conversations WHERE conv_id = turn OR turn > conv_id")
def read_field_vs_field(spark, sf):
    out = _table(spark, sf, "conversations", ["conv_id", "turn"])
    return out.read((field("conv_id") == field("turn")) | (field("turn") > field("conv_id")), ["conv_id", "turn", "role"])


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem")
def read_lineitem(spark, sf):
    return _table(spark, sf, "lineitem", ["l_orderkey", "l_linenumber"]).read(fields=["l_orderkey", "l_linenumber", "l_quantity"])


@query(f"{_O} WHERE o_orderkey < 1000")
def time_travel_snapshot(spark, sf):
    return _orders(spark, sf).read(version=1)


@query(f"{_O} WHERE o_orderkey < 1000")
def time_travel_tag(spark, sf):
    t = _orders(spark, sf)
    t.add_tag("first", 1)
    t.delete(field("o_orderkey") < 500)
    return t.read(version="first")


@query(f"{_O} WHERE o_orderkey >= 1000")
def branch_read(spark, sf):
    t = _orders(spark, sf)
    t.add_branch("side")
    t.set_current_branch("side")
    t.delete(field("o_orderkey") < 1000)
    t.set_current_branch("main")
    t.delete(field("o_orderkey") > 0)
    return t.read(version="side")


@query(f"{_O} WHERE NOT (o_totalprice < 50000)")
def delete_rows(spark, sf):
    t = _orders(spark, sf)
    t.delete(field("o_totalprice") < 50000.0)
    return t.read()


@query(f"{_O} WHERE o_orderkey >= 1000")
def delete_whole_file(spark, sf):
    t = _orders(spark, sf)
    t.delete(field("o_orderkey") < 1000)
    return t.read()


@query(f"{_O}")
def delete_nothing(spark, sf):
    t = _orders(spark, sf)
    t.delete(field("o_orderkey") < -5)
    return t.read()


@query(f"{_O}")
def insert_new(spark, sf):
    src = _src(spark, sf, "orders")
    t = _table(spark, sf, "orders", ["o_orderkey"], df=src.where("o_orderkey % 3 <> 0"))
    t.insert(src.where("o_orderkey % 3 = 0"))
    return t.read()


@query(f"{_O}")
def insert_conflict_unchanged(spark, sf):
    t = _orders(spark, sf)
    t.insert(_src(spark, sf, "orders").where("o_orderkey = 3 OR o_orderkey = 5"))
    return t.read()


@query("SELECT o_orderkey, o_custkey, o_orderstatus, CASE WHEN o_orderkey % 5 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice, o_orderdate, o_orderpriority FROM orders UNION ALL SELECT o_orderkey + 10000000, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders WHERE o_orderkey % 50 = 0")
def upsert_orders(spark, sf):
    src = _src(spark, sf, "orders")
    t = _orders(spark, sf)
    t.upsert(src.where("o_orderkey % 5 = 0").withColumn("o_totalprice", F.col("o_totalprice") + 1).unionByName(src.where("o_orderkey % 50 = 0").withColumn("o_orderkey", F.col("o_orderkey") + 10000000)))
    return t.read()


@query("SELECT conv_id, turn, CASE WHEN turn = 0 THEN 'changed' ELSE role END AS role, text FROM conversations")
def upsert_composite_key(spark, sf):
    t = _table(spark, sf, "conversations", ["conv_id", "turn"])
    t.upsert(_src(spark, sf, "conversations").where("turn = 0").withColumn("role", F.lit("changed")))
    return t.read()


@query("SELECT 2 AS snap, 'ADD' AS kind, o_orderkey, o_totalprice FROM orders WHERE o_orderkey >= 1000")
def diff_add(spark, sf):
    return _told(_orders(spark, sf).diff(1, 2))


def _told(df: DataFrame) -> DataFrame:
    return df.select(F.col("_snapshot_id").cast("int").alias("snap"), F.col("_change_type").alias("kind"), "o_orderkey", "o_totalprice")


@query("SELECT 3 AS snap, 'DELETE' AS kind, o_orderkey, CAST(NULL AS DOUBLE) AS o_totalprice FROM orders WHERE o_totalprice < 50000")
def diff_delete(spark, sf):
    t = _orders(spark, sf)
    t.delete(field("o_totalprice") < 50000.0)
    return _told(t.diff(2, 3))


@query("SELECT 3 AS snap, 'DELETE' AS kind, o_orderkey, CAST(NULL AS DOUBLE) AS o_totalprice FROM orders WHERE o_orderkey % 7 = 0 UNION ALL SELECT 3, 'ADD', o_orderkey, o_totalprice + 1 FROM orders WHERE o_orderkey % 7 = 0")
def diff_upsert(spark, sf):
    t = _orders(spark, sf)
    t.upsert(_src(spark, sf, "orders").where("o_orderkey % 7 = 0").withColumn("o_totalprice", F.col("o_totalprice") + 1))
    return _told(t.diff(2, 3))


def _priced(cols):
    return {"p_partkey": cols["p_partkey"], "price": cols["p_retailprice"] * 2, "size": cols["p_size"] + 1}


_PRICED = "p_partkey long, price double, size int"


@query("SELECT p_partkey, p_retailprice * 2 AS price, CAST(p_size + 1 AS INTEGER) AS size FROM part")
def map_batches_price(spark, sf):
    return _table(spark, sf, "part", ["p_partkey"]).map_batches(_priced, _PRICED, ["p_partkey", "p_retailprice", "p_size"]).df()


@query("SELECT p_partkey, p_retailprice * 2 AS price FROM part WHERE p_size + 1 > 25")
def map_chain(spark, sf):
    view = _table(spark, sf, "part", ["p_partkey"]).map_batches(_priced, _PRICED, batch_size=100)
    return view.filter(lambda r: r["size"] > 25, ["p_partkey", "size", "price"]).map_batches(lambda c: {k: c[k] for k in ("p_partkey", "price")}, "p_partkey long, price double").df()


@query("SELECT p_partkey, p_size FROM part WHERE p_size % 2 = 0")
def filter_udf(spark, sf):
    return _table(spark, sf, "part", ["p_partkey"]).filter(lambda r: r["p_size"] % 2 == 0, ["p_partkey", "p_size"]).df()


@query("SELECT p_partkey, p_retailprice * 2 AS price, CAST(p_size + 1 AS INTEGER) AS size FROM part")
def mv_refresh(spark, sf):
    mv = _table(spark, sf, "part", ["p_partkey"], at=700).map_batches(_priced, _PRICED).materialize(_home(spark))
    mv.refresh()
    return mv.df()


@query("SELECT p_partkey, CASE WHEN p_partkey % 9 = 0 THEN 14.0 ELSE p_retailprice * 2 END AS price FROM part WHERE p_partkey >= 100")
def mv_refresh_incremental(spark, sf):
    t = _table(spark, sf, "part", ["p_partkey"], at=700)
    mv = t.map_batches(_priced, _PRICED).materialize(_home(spark))
    mv.refresh(1)
    t.upsert(_src(spark, sf, "part").where("p_partkey % 9 = 0").withColumn("p_retailprice", F.lit(7.0)))
    mv.refresh()
    t.delete(field("p_partkey") < 100)
    mv.refresh()
    return mv.df(fields=["p_partkey", "price"])


def _sizes(batch):
    return {"conv_id": batch["conv_id"], "turn": batch["turn"], "size": [len(t) for t in batch["text"]]}


@query("SELECT conv_id, turn, CASE WHEN turn % 2 = 1 THEN 3 ELSE length(text) END AS size FROM conversations WHERE turn <> 2")
def mv_refresh_composite_key(spark, sf):
    src = _src(spark, sf, "conversations")
    t = _table(spark, sf, "conversations", ["conv_id", "turn"])
    mv = t.map_batches(_sizes, "conv_id long, turn long, size long", primary_keys=["conv_id"]).materialize(_home(spark))
    mv.refresh()
    t.upsert(src.where("turn % 2 = 1").withColumn("text", F.lit("new")))
    t.delete(field("turn") == 2)
    mv.refresh()
    return mv.df()


@query("SELECT page_id, html FROM pages WHERE page_id % 3 = 0")
def record_field_filtered(spark, sf):
    df = _src(spark, sf, "pages").withColumn("html", F.col("html").cast("binary"))
    t = _table(spark, sf, "pages", ["page_id"], ["html"], df, at=40)
    return t.read(F.col("page_id") % 3 == 0, ["page_id", "html"]).withColumn("html", F.col("html").cast("string"))


@query("SELECT d.doc_id, d.lang, d.n_chars, l.quality, l.toxic FROM documents d JOIN labels l USING (doc_id)")
def join_docs_labels(spark, sf):
    return _docs(spark, sf).join(_table(spark, sf, "labels", ["doc_id"]), ["doc_id"], ["lang", "n_chars"]).df()


def _docs(spark, sf, records=None):
    df = _src(spark, sf, "documents")
    return _table(spark, sf, "documents", ["doc_id"], records, df.withColumn("text", F.col("text").cast("binary")) if records else df)


@query("SELECT d.doc_id, d.source, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id)")
def join_left(spark, sf):
    return _docs(spark, sf).join(_table(spark, sf, "labels", ["doc_id"]), ["doc_id"], ["source"], ["toxic"], how="left").df()


@query("SELECT d.doc_id, d.lang, l.quality FROM documents d JOIN labels l USING (doc_id)")
def join_partitioned(spark, sf):
    def halves(r: Range) -> list[Range]:
        middle = (r.min_ + r.max_) // 2
        return [Range(r.min_, middle), Range(middle, r.max_, r.include_max)]

    return _docs(spark, sf).join(_table(spark, sf, "labels", ["doc_id"]), ["doc_id"], ["lang"], ["quality"], partition_fn=halves).df()


@query("SELECT d.doc_id, true AS addressed, l.quality FROM documents d JOIN labels l USING (doc_id)")
def join_reference(spark, sf):
    view = _docs(spark, sf, ["text"]).join(_table(spark, sf, "labels", ["doc_id"]), ["doc_id"], ["text"], ["quality"], left_reference_read=True)
    return view.df().select("doc_id", (F.col("text._FILE").isNotNull() & (F.col("text._ROW_ID") >= 0)).alias("addressed"), "quality")


@query("SELECT doc_id, text, lang FROM documents")
def record_field_read(spark, sf):
    return _docs(spark, sf, ["text"]).read(fields=["doc_id", "text", "lang"]).withColumn("text", F.col("text").cast("string"))


@query(f"{_O}")
def append_parquet_zero_copy(spark, sf):
    t = Dataset.create(spark, _home(spark), _src(spark, sf, "orders").schema, ["o_orderkey"])
    t.append_parquet(f"{sf}/orders.parquet")
    return t.read()


@query("SELECT CAST(sum(n) AS BIGINT) AS num_rows, min(lo) AS lo, max(hi) AS hi FROM (SELECT count(*) AS n, min(o_orderkey) AS lo, max(o_orderkey) AS hi FROM orders)")
def manifest_stats(spark, sf):
    return _orders(spark, sf).index_manifest().agg(F.sum("num_rows").alias("num_rows"), F.min("_MIN_o_orderkey").alias("lo"), F.max("_MAX_o_orderkey").alias("hi"))


@query("SELECT * FROM (VALUES (2, 'main'), (1, 'one'), (0, NULL)) t(snapshot_id, tag_or_branch)")
def versions_refs(spark, sf):
    t = _table(spark, sf, "region", ["r_regionkey"], at=2)
    t.add_tag("one", 1)
    return t.versions().select(F.col("snapshot_id").cast("int").alias("snapshot_id"), "tag_or_branch")


@query("SELECT vec_id, min(x) AS lo, max(x) AS hi FROM (SELECT vec_id, unnest(embedding) AS x FROM embeddings) GROUP BY vec_id")
def explode_min_max(spark, sf):
    t = _table(spark, sf, "embeddings", ["vec_id"])
    return t.read(fields=["vec_id", "embedding"]).select("vec_id", F.explode("embedding").alias("x")).groupBy("vec_id").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))


@query("SELECT page_id, html FROM pages")
def random_access_rows(spark, sf):
    """Every page by its position, last one first, in one request."""
    src = _src(spark, sf, "pages").withColumn("html", F.col("html").cast("binary"))
    rows = RandomAccess(_table(spark, sf, "pages", ["page_id"], ["html"], src), "html")
    return rows.frame(spark.range(len(rows)).select(-1 - F.col("id"))).withColumn("html", F.col("html").cast("string"))


@query("SELECT page_id, url FROM pages")
def record_index_function(spark, sf):
    path = _home(spark)
    _src(spark, sf, "pages").select(F.to_json(F.struct("page_id", "url")).cast("binary").alias("blob")).write.parquet(path)
    t = Dataset.create(spark, _home(spark), "page_id long, url string, blob binary", ["page_id"], ["blob"])

    def index(r):
        import json

        return json.loads(r["blob"])

    t.append_records(path, index)
    return t.read().select("page_id", F.get_json_object(F.col("blob").cast("string"), "$.url").alias("url"))


@query("SELECT CAST(i AS BIGINT) AS id, CAST(i * i AS DOUBLE) AS x FROM range(0, 400) t(i)")
def append_from_functions(spark, sf):
    def source(k):
        def run():
            for a in range(k * 100, k * 100 + 100, 25):
                yield {"id": list(range(a, a + 25)), "x": [float(i * i) for i in range(a, a + 25)]}

        return run

    t = Dataset.create(spark, _home(spark), "id long, x double", ["id"])
    t.append_from([source(k) for k in range(4)])
    return t.read()


@query("SELECT page_id, 'pages/' || url AS path FROM pages")
def file_type_path(spark, sf):
    t = Dataset.create(spark, _home(spark), _src(spark, sf, "pages").select("page_id").schema.add(file_field("url", "pages")), ["page_id"])
    t.append(_src(spark, sf, "pages"))
    return t.read().select("page_id", full_path(t.schema["url"]).alias("path"))


@query("SELECT event_type, count(*) AS n, max(event_id) AS last FROM events GROUP BY event_type")
def catalog_sql(spark, sf):
    c = DirCatalog(spark, _home(spark))
    c.create_dataset("events_kept", _src(spark, sf, "events").schema, ["event_id"]).append(_src(spark, sf, "events"))
    c.register()
    return spark.sql("SELECT event_type, count(*) AS n, max(event_id) AS last FROM events_kept GROUP BY event_type")


@query("SELECT event_id, event_type FROM events WHERE event_id % 7 <> 3")
def follow_feed(spark, sf):
    t = _table(spark, sf, "events", ["event_id"], at=600)
    t.delete(F.col("event_id") % 7 == 3)
    copy = Dataset.create(spark, _home(spark), "event_id long, event_type string", ["event_id"])

    def sink(changes, _):
        copy.delete_keys(changes.where("_change_type = 'DELETE'"))
        copy.append(changes.where("_change_type = 'ADD'"))

    follow(t, sink, "copy")
    return copy.read()


@query(f"{_O}")
def compacted(spark, sf):
    t = _orders(spark, sf)
    t.compact(1)
    return t.read()


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_Q)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
