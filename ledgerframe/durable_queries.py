"""The catalogue's queries that go through a session: rows are staged, checked, written to a versioned table of several
files, committed and read back."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .audit import search as trail_search
from .audit.scope import Actor, audit_scope
from .audit.spec import AuditSpec
from .catalogue import models, read
from .errors import NotSupported, WriteFailed
from .functions.ordinals import shared_folder
from .model import ForeignKey, TableModel
from .operators.filtering import Scope
from .operators.graph import Branch, SelfReference
from .options import AuditOptions, WriteOptions
from .queries import ORACLES, QUERIES, query
from .session import Session

__all__ = ["ORACLES", "QUERIES"]


def _session(spark: SparkSession, tables: dict[str, tuple[TableModel, DataFrame]], **kinds) -> Session:
    """A new store with the tables, each in files of a few."""
    at = f"{shared_folder(spark)}/ledgerframe/store-{uuid.uuid4().hex}"
    s = Session(spark, at, [m for m, _ in tables.values()], **({"write": WriteOptions()} | kinds))
    for name, (model, df) in tables.items():
        s.load(name, df.repartitionByRange(4, *[F.col(c) for c in (model.key or model.columns[:1])]))
    return s


def _customers(spark, d, model: TableModel | None = None, **kinds) -> Session:
    return _session(spark, {"customer": (model or models()["customer"].but(references=()), read(spark, d, "customer"))}, **kinds)


def _refused(df: DataFrame, write) -> DataFrame:
    """The rows after a write that must be refused, with what refused it."""
    try:
        write()
        told = "nothing"
    except (WriteFailed, NotSupported) as e:
        told = type(e).__name__
    return df.withColumn("refused", F.lit(told))


@query("SELECT * FROM customer UNION ALL SELECT c_custkey + 1000000, c_name || '-new', c_nationkey, c_acctbal, c_mktsegment FROM customer WHERE c_acctbal > 9000")
def session_insert(spark, d):
    s = _customers(spark, d)
    s.insert("customer", s.read("customer").where("c_acctbal > 9000").withColumns({"c_custkey": F.col("c_custkey") + 1_000_000, "c_name": F.concat("c_name", F.lit("-new"))}))
    return s.read("customer")


@query("SELECT c_custkey, c_name, c_nationkey, CASE WHEN c_nationkey < 10 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal, c_mktsegment FROM customer")
def session_update(spark, d):
    s = _customers(spark, d)
    s.update("customer", s.read("customer").where("c_nationkey < 10").withColumns({"c_acctbal": F.col("c_acctbal") + 1, "c_mktsegment": F.lit("X")}), exclude=("c_mktsegment",))
    return s.read("customer")


@query("SELECT c_custkey, c_name, c_nationkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 1.5 ELSE c_acctbal END AS c_acctbal, c_mktsegment FROM customer")
def session_update_match_on(spark, d):
    """One source row changes many rows of several files."""
    s = _customers(spark, d)
    s.update("customer", spark.createDataFrame([("BUILDING", 1.5)], "c_mktsegment string, c_acctbal double"), match_on=("c_mktsegment",))
    return s.read("customer")


@query("SELECT * FROM customer WHERE c_acctbal >= 0")
def session_delete(spark, d):
    s = _customers(spark, d)
    s.delete("customer", s.read("customer").where("c_acctbal < 0").select("c_custkey"))
    return s.read("customer")


_KEYED = "SELECT c_custkey, c_name, c_nationkey, CASE WHEN c_nationkey = 3 THEN c_acctbal + 5 ELSE c_acctbal END AS c_acctbal, c_mktsegment FROM customer"


def _keyed_source(s: Session) -> DataFrame:
    c = s.read("customer").select("c_name", "c_nationkey", "c_acctbal", "c_mktsegment")
    known = c.where("c_nationkey = 3").withColumn("c_acctbal", F.col("c_acctbal") + 5)
    return known.unionAll(c.where("c_nationkey = 7").withColumn("c_name", F.concat("c_name", F.lit("-two"))))


@query(f"{_KEYED} UNION ALL SELECT (SELECT max(c_custkey) FROM customer) + row_number() OVER (ORDER BY c_name), c_name || '-two', c_nationkey, c_acctbal, c_mktsegment FROM customer WHERE c_nationkey = 7")
def session_merge_generated_keys(spark, d):
    """Matches stand in some files only; new keys follow the largest of the whole table."""
    s = _customers(spark, d, models()["customer"].but(references=(), generated={"c_custkey": "sequence"}))
    s.merge("customer", _keyed_source(s), match_on=("c_name",))
    return s.read("customer")


@query(f"""{_KEYED} UNION ALL SELECT (SELECT max(c_custkey) FROM customer) + k * (SELECT count(*) FROM customer WHERE c_nationkey = 7) + row_number() OVER (PARTITION BY k ORDER BY c_name), c_name || tail, c_nationkey, c_acctbal, c_mktsegment
FROM customer, (VALUES (0, '-two'), (1, '-three')) v(k, tail) WHERE c_nationkey = 7""")
def session_merge_no_match_keys(spark, d):
    """A second merge that meets no row goes on where the first one's keys ended."""
    s = _customers(spark, d, models()["customer"].but(references=(), generated={"c_custkey": "sequence"}))
    source = _keyed_source(s)
    s.merge("customer", source, match_on=("c_name",))
    s.merge("customer", source.where("c_nationkey = 7").withColumn("c_name", F.regexp_replace("c_name", "-two", "-three")), match_on=("c_name",))
    return s.read("customer")


_SYNC = "s AS (SELECT s_suppkey, s_name, s_nationkey, s_acctbal + 10 AS s_acctbal FROM supplier WHERE s_acctbal > 0 UNION ALL SELECT s_suppkey + 100000, s_name, s_nationkey, s_acctbal FROM supplier WHERE s_acctbal > 0 AND s_nationkey < 5)"


@query(f"WITH {_SYNC} SELECT *, (SELECT count(*) FROM supplier WHERE s_suppkey NOT IN (SELECT s_suppkey FROM s) AND s_nationkey < 15) AS gone FROM (SELECT * FROM s UNION ALL SELECT * FROM supplier WHERE s_suppkey NOT IN (SELECT s_suppkey FROM s) AND NOT s_nationkey < 15)")
def session_synchronize(spark, d):
    s = _session(spark, {"supplier": (models()["supplier"].but(references=()), read(spark, d, "supplier"))})
    kept = s.read("supplier").where("s_acctbal > 0")
    source = kept.withColumn("s_acctbal", F.col("s_acctbal") + 10).unionAll(kept.where("s_nationkey < 5").withColumn("s_suppkey", F.col("s_suppkey") + 100_000))
    r = s.synchronize("supplier", source, scope=Scope.sql("t.s_nationkey < :most", most=15))
    return s.read("supplier").withColumn("gone", F.lit(r.deleted).cast("bigint"))


@query("SELECT *, 'ConstraintViolation' AS refused FROM customer")
def session_update_unique(spark, d):
    """A row may not take another's unique name."""
    s = _customers(spark, d)
    first = s.read("customer").agg(F.min("c_name")).first()[0]
    rows = s.read("customer").orderBy(F.desc("c_custkey")).limit(1).withColumn("c_name", F.lit(first))
    return _refused(s.read("customer"), lambda: s.update("customer", rows))


@query("SELECT c_custkey, CASE WHEN c_nationkey = 4 THEN 'n-' || c_custkey ELSE c_name END AS c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def session_update_unique_moved(spark, d):
    """Unique values that move to free ones are no clash."""
    s = _customers(spark, d)
    s.update("customer", s.read("customer").where("c_nationkey = 4").select("c_custkey", F.concat(F.lit("n-"), "c_custkey").alias("c_name")))
    return s.read("customer")


@query("SELECT *, 'ConstraintViolation' AS refused FROM customer")
def session_merge_unique(spark, d):
    """A merge by key may not bring a second row with a stored unique name."""
    s = _customers(spark, d)
    rows = s.read("customer").where("c_nationkey = 2").withColumn("c_custkey", F.col("c_custkey") + 9_000_000)
    return _refused(s.read("customer"), lambda: s.merge("customer", rows))


def _related(spark, d) -> Session:
    return _session(spark, {"customer": (models()["customer"].but(references=()), read(spark, d, "customer")), "orders": (models()["orders"].but(filters={}), read(spark, d, "orders"))})


@query("SELECT *, 'ConstraintViolation' AS refused FROM customer")
def session_delete_parent(spark, d):
    """A row that others refer to stays."""
    s = _related(spark, d)
    used = s.read("orders").agg(F.min("o_custkey").alias("c_custkey"))
    return _refused(s.read("customer"), lambda: s.delete("customer", used))


@query("SELECT * FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def session_delete_unreferenced(spark, d):
    s = _related(spark, d)
    s.delete("customer", s.read("customer").join(s.read("orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey"))
    return s.read("customer")


@query("SELECT *, 'ConstraintViolation' AS refused FROM orders")
def session_insert_orphan(spark, d):
    s = _related(spark, d)
    rows = s.read("orders").where("o_orderkey < 5").withColumns({"o_orderkey": F.col("o_orderkey") + 9_000_000, "o_custkey": F.lit(-1).cast("bigint")})
    return _refused(s.read("orders"), lambda: s.insert("orders", rows))


@query("SELECT c_custkey, c_name, c_nationkey, c_acctbal + 1 AS c_acctbal, c_mktsegment FROM customer WHERE c_nationkey < 12 UNION ALL SELECT * FROM customer WHERE c_nationkey >= 12 AND c_nationkey < 20")
def session_transaction(spark, d):
    """Two writes in one commit; a nested one that fails is undone alone."""
    s = _customers(spark, d)
    with s.transaction():
        s.update("customer", s.read("customer").where("c_nationkey < 12").withColumn("c_acctbal", F.col("c_acctbal") + 1))
        try:
            with s.transaction():
                s.delete("customer", s.read("customer").where("c_nationkey < 3").select("c_custkey"))
                raise KeyError
        except KeyError:
            pass
        s.delete("customer", s.read("customer").where("c_nationkey >= 20").select("c_custkey"))
    return s.read("customer")


@query("SELECT * FROM customer")
def session_time_travel(spark, d):
    s = _customers(spark, d)
    s.delete("customer", s.read("customer").where("c_nationkey < 9").select("c_custkey"))
    return s.read("customer", version=1)


def _current(s: Session) -> DataFrame:
    c = s.read("customer")
    now = c.where("c_nationkey <> 0").withColumn("c_acctbal", F.when(F.col("c_nationkey") < 9, F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal")))
    now = now.withColumn("c_mktsegment", F.when(F.col("c_nationkey").isin(8, 9), F.lit("MOVED")).otherwise(F.col("c_mktsegment")))
    return now.unionAll(c.where("c_custkey < 30").withColumns({"c_custkey": F.col("c_custkey") + 5_000_000, "c_name": F.concat("c_name", F.lit("+"))}))


_NOW = """SELECT c_custkey, c_name, c_nationkey, CASE WHEN c_nationkey < 9 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal, CASE WHEN c_nationkey IN (8, 9) THEN 'MOVED' ELSE c_mktsegment END AS c_mktsegment FROM customer WHERE c_nationkey <> 0
UNION ALL SELECT c_custkey + 5000000, c_name || '+', c_nationkey, c_acctbal, c_mktsegment FROM customer WHERE c_custkey < 30"""


@query(_NOW)
def save_changes(spark, d):
    s = _customers(spark, d)
    s.save_changes("customer", _current(s), s.read("customer"))
    return s.read("customer")


@query(f"""WITH now AS ({_NOW}), d AS (SELECT CASE WHEN o.c_custkey IS NULL THEN 'Added' WHEN n.c_custkey IS NULL THEN 'Deleted' ELSE 'Modified' END AS state,
CASE WHEN o.c_custkey IS NULL THEN 'c_custkey,c_name,c_nationkey,c_acctbal,c_mktsegment||' WHEN n.c_custkey IS NULL THEN '||c_custkey' ELSE concat_ws(',', CASE WHEN o.c_acctbal <> n.c_acctbal THEN 'c_acctbal' END, CASE WHEN o.c_mktsegment <> n.c_mktsegment THEN 'c_mktsegment' END) || '||c_custkey' END AS shape
FROM customer o FULL JOIN now n ON o.c_custkey = n.c_custkey WHERE o.c_custkey IS NULL OR n.c_custkey IS NULL OR o.c_acctbal <> n.c_acctbal OR o.c_mktsegment <> n.c_mktsegment)
SELECT state, shape, count(*) AS n, count(*) >= 40 AS accelerated, CASE WHEN count(*) < 40 THEN 'below threshold' END AS reason FROM d GROUP BY ALL""")
def save_changes_partitions(spark, d):
    """How a save is planned: changes of one shape together, and which are worth a set-based write."""
    s = _customers(spark, d, write=WriteOptions(threshold=40))
    done, declined = [], {}
    s.events.subscribe(lambda e: done.append(e.facts) if e.name == "PartitionExecuted" else declined.update({(e.facts["state"], e.facts["shape"]): e.facts["reason"]}) if e.name == "PartitionDeclined" else None)
    s.save_changes("customer", _current(s), s.read("customer"))
    rows = [(f["state"], f["shape"], f["rows"], f["accelerated"], declined.get((f["state"], f["shape"]))) for f in done if "shape" in f]
    return spark.createDataFrame(rows, "state string, shape string, n bigint, accelerated boolean, reason string")


_TENANT = AuditOptions(clock=lambda: dt.datetime(2024, 1, 2, 3, 4, 5), tenant_column="c_mktsegment")


def _audited(spark, d) -> Session:
    s = _customers(spark, d, audit=_TENANT, audit_specs={"customer": AuditSpec()})
    with audit_scope(actor=Actor("u1", "Ann"), correlation_id="one"):
        s.update("customer", s.read("customer").where("c_nationkey < 10").withColumn("c_acctbal", F.col("c_acctbal") + 1))
    with audit_scope(actor=Actor("u2", "Bob"), correlation_id="two"), s.transaction():
        s.delete("customer", s.read("customer").where("c_nationkey >= 22").select("c_custkey"))
        s.insert("customer", read(spark, d, "customer").where("c_nationkey >= 22").withColumn("c_custkey", F.col("c_custkey") + 7_000_000))
    return s


_TRAIL = """(SELECT c_custkey::VARCHAR AS entity_key, 2 AS operation, 'Bulk.Update' AS source, 'u1' AS actor_id, c_mktsegment AS tenant_id, 'one' AS correlation_id FROM customer WHERE c_nationkey < 10
UNION ALL SELECT c_custkey::VARCHAR, 3, 'Bulk.Delete', 'u2', c_mktsegment, 'two' FROM customer WHERE c_nationkey >= 22 UNION ALL SELECT (c_custkey + 7000000)::VARCHAR, 1, 'Bulk.Insert', 'u2', c_mktsegment, 'two' FROM customer WHERE c_nationkey >= 22)"""
_TOLD = ["entity_key", "operation", "source", "actor_id", "tenant_id", "correlation_id"]


@query(f"SELECT * FROM {_TRAIL}")
def session_audit_trail(spark, d):
    return _audited(spark, d).audit_trail().select(*_TOLD)


@query(f"SELECT * FROM {_TRAIL} WHERE actor_id = 'u2'")
def audit_by_actor(spark, d):
    return trail_search.by_actor(_audited(spark, d).audit_trail(), "u2", dt.datetime(2024, 1, 1)).select(*_TOLD)


@query(f"SELECT * FROM {_TRAIL} WHERE tenant_id = 'BUILDING'")
def audit_by_tenant(spark, d):
    return trail_search.by_tenant(_audited(spark, d).audit_trail(), "BUILDING").select(*_TOLD)


@query(f"SELECT * FROM {_TRAIL} WHERE correlation_id = 'one'")
def audit_by_correlation(spark, d):
    return trail_search.by_correlation(_audited(spark, d).audit_trail(), "one").select(*_TOLD)


@query("SELECT o_orderkey, c_name, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey")
def session_graph_generated_keys(spark, d):
    """Customers with their orders nested, keys of both drawn by the store; references by name show that they fit."""
    customer = models()["customer"].but(references=(), generated={"c_custkey": "sequence"})
    orders = models()["orders"].but(filters={})
    orders = orders.but(references=(ForeignKey(("o_custkey",), "customer", ("c_custkey",)),))
    rows = read(spark, d, "orders").groupBy("o_custkey").agg(F.collect_list(F.struct("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")).alias("own"))
    parents = read(spark, d, "customer").join(rows, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_name", "c_nationkey", "c_acctbal", "c_mktsegment", "own")
    s = _session(spark, {"customer": (customer, read(spark, d, "customer").limit(0)), "orders": (orders, read(spark, d, "orders").limit(0))})
    s.insert_graph("customer", parents, (Branch("own", orders, "o_custkey", "c_custkey"),))
    return s.read("orders").join(s.read("customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name", "o_totalprice")


@query("SELECT c.c_name AS name, p.c_name AS parent, c.c_custkey > 1 AS has_parent, true AS later FROM customer c LEFT JOIN customer p ON c.c_custkey > 1 AND p.c_custkey = c.c_custkey // 2")
def session_graph_self_reference(spark, d):
    """A tree whose rows refer to each other by numbers of their own; the store's keys take their place."""
    schema = "id bigint, name string, parent_id bigint"
    model = TableModel("tree", spark.createDataFrame([], schema).schema, key=("id",), generated={"id": "sequence"}, references=(ForeignKey(("parent_id",), "tree", ("id",)),))
    s = _session(spark, {"tree": (model, spark.createDataFrame([], schema))})
    rows = read(spark, d, "customer").select((F.col("c_custkey") * 3).alias("number"), F.when(F.col("c_custkey") > 1, F.floor(F.col("c_custkey") / 2) * 3).alias("above"), F.col("c_name").alias("name"))
    s.insert_graph("tree", rows, (), own=SelfReference("number", "above", "parent_id"))
    t = s.read("tree")
    p = t.select(F.col("id").alias("p_id"), F.col("name").alias("parent"))
    return t.join(p, F.col("parent_id") == F.col("p_id"), "left").select("name", "parent", F.col("parent_id").isNotNull().alias("has_parent"), F.coalesce(F.col("id") > F.col("parent_id"), F.lit(True)).alias("later"))
