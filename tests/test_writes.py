import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerframe import tracking
from ledgerframe.audit.scope import Actor, audit_scope, current_scope
from ledgerframe.audit.spec import AuditSpec, plan_audit
from ledgerframe.errors import AuditNotSupported, ConcurrencyConflict, ConstraintViolation, NotConfigured, WriteNotSupported
from ledgerframe.functions.ordinals import uuid7, with_dense_ordinal
from ledgerframe.functions.payload import contains, decimal_text, key_text
from ledgerframe.model import ForeignKey, model_of
from ledgerframe.observers import Needs
from ledgerframe.operators import changes as ch
from ledgerframe.operators import graph
from ledgerframe.operators.filtering import Scope
from ledgerframe.options import Atomicity, AuditOptions, Call, Op, OnUnsupported, QueryOptions, WriteOptions
from ledgerframe.plans.partition import CHANGES, plan_partitions
from ledgerframe.plans.write_plan import plan_write
from ledgerframe.session import Session

SCHEMA = "id long, tenant string, v double, note string"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def table(spark, **facts):
    return model_of(frame(spark, []), "t", key=("id",), **facts)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


ROWS = [(1, "a", 1.0, None), (2, "a", 2.0, "x"), (3, "b", 3.0, None), (4, None, 4.0, "y")]


def test_plans_refuse(spark):
    m, src = table(spark), frame(spark, ROWS)
    refused = [
        (Op.INSERT, Call(match_on=("id",))), (Op.UPDATE, Call(include=("v",), exclude=("note",))), (Op.UPDATE, Call(insert_only=("v",))), (Op.UPDATE, Call(exclude=("id",))),
        (Op.UPDATE, Call(exclude=("v", "note", "tenant"))), (Op.MERGE, Call(scope=Scope.eq("v", 1))), (Op.INSERT, Call(include_graph=True, include=("v",))), (Op.UPDATE, Call(include=("zz",))),
    ]
    for op, call in refused:
        with pytest.raises(WriteNotSupported):
            plan_write(m, op, src, call)
    for other in (m.but(key=()), m.but(tokens=frozenset({"v"})), m.but(temporal=True), m.but(mapped=False)):
        with pytest.raises(WriteNotSupported):
            plan_write(other, Op.UPDATE, src)
    with pytest.raises(WriteNotSupported):
        plan_write(m.but(generated={"v": "id * 2"}), Op.INSERT, src, Call(include=("v",)))
    with pytest.raises(WriteNotSupported):
        plan_write(m, Op.UPDATE, src.drop("id"))


def test_update_and_delete_conflicts(spark):
    m, t = table(spark), frame(spark, ROWS)
    missing = frame(spark, [(1, "a", 9.0, None), (99, "a", 9.0, None)])
    twice = frame(spark, [(1, "a", 9.0, None), (1, "a", 8.0, None)])
    for f, op in ((ch.update, Op.UPDATE), (ch.delete, Op.DELETE)):
        for src in (missing, twice):
            with pytest.raises(ConcurrencyConflict):
                f(t, src, plan_write(m, op, src))
    with pytest.raises(ConcurrencyConflict):
        ch.merge(t, twice, plan_write(m, Op.MERGE, twice))


def test_null_matches_nothing(spark):
    m, t = table(spark), frame(spark, ROWS)
    src = frame(spark, [(10, None, 5.0, "n")])
    c = ch.merge(t, src, plan_write(m, Op.MERGE, src, Call(match_on=("tenant",))))
    assert c.result == ch.BulkResult(inserted=1) and c.next.count() == 5


def test_unknown_scope_keeps_rows(spark):
    m, t = table(spark), frame(spark, ROWS)
    src = frame(spark, [(1, "a", 1.5, None)])
    scope = Scope.eq("tenant", "a")
    c = ch.merge(t, src, plan_write(m, Op.SYNCHRONIZE, src, Call(scope=scope)), scope)
    assert rows_of(c.next.select("id")) == [(1,), (3,), (4,)] and c.result == ch.BulkResult(0, 1, 1)


def test_synchronize_refusals(spark):
    m, src = table(spark), frame(spark, ROWS)
    with pytest.raises(WriteNotSupported):
        ch.check_synchronize(m, src, None, False)
    with pytest.raises(WriteNotSupported):
        ch.check_synchronize(m, src.limit(0), None, True)
    with pytest.raises(WriteNotSupported):
        ch.check_synchronize(m.but(filters={"f": "v > 0"}), src, None, True)
    ch.check_synchronize(m, src, Scope.eq("tenant", "a"), False)


def test_merge_with_nothing_to_update(spark):
    m, t = table(spark), frame(spark, ROWS)
    src = t.select("id").unionAll(spark.range(50, 51).toDF("id"))
    c = ch.merge(t, src, plan_write(m, Op.MERGE, src))
    assert c.result == ch.BulkResult(inserted=1)


def test_merge_assigns_sequences(spark):
    m = table(spark, generated={"id": "sequence"})
    src = frame(spark, [(0, "a", 7.0, "n"), (0, "zz", 8.0, "m")]).drop("id")
    t = frame(spark, [(5, "a", 1.0, None)])
    c = ch.merge(t, src, plan_write(m, Op.MERGE, src, Call(match_on=("tenant",))))
    assert rows_of(c.next) == [(5, "a", 7.0, "n"), (6, "zz", 8.0, "m")]


@given(st.dictionaries(st.integers(0, 12), st.integers(0, 3), max_size=8), st.dictionaries(st.integers(0, 12), st.integers(4, 6), max_size=8), st.sampled_from([Op.MERGE, Op.SYNCHRONIZE]))
@settings(max_examples=8, deadline=None)
def test_merge_against_a_dictionary(spark, target, source, op):
    make = lambda d: spark.createDataFrame([(k, "a", float(v), None) for k, v in d.items()], SCHEMA)
    src = make(source)
    c = ch.merge(make(target), src, plan_write(table(spark), op, src))
    d = ch.merge(make(target), src, plan_write(table(spark), op, src), small=True)
    assert rows_of(c.next) == rows_of(d.next) and rows_of(c.changes) == rows_of(d.changes)
    want = {**({} if op is Op.SYNCHRONIZE else target), **source}
    assert {r.id: r.v for r in c.next.collect()} == want
    assert c.result == ch.BulkResult(len(source.keys() - target.keys()), len(source.keys() & target.keys()), len(target.keys() - source.keys()) if op is Op.SYNCHRONIZE else 0)


def test_dense_ordinals(spark):
    df = spark.range(1000, numPartitions=7).withColumn("x", -F.col("id"))
    got = {r.x: r.n for r in with_dense_ordinal(df, "n", [F.col("x")], 5).collect()}
    assert got == {-i: 5 + (999 - i) for i in range(1000)}
    ids = [r.i for r in spark.range(50).select(uuid7().alias("i")).collect()]
    assert len(set(ids)) == 50 and all(len(i) == 36 and i[14] == "7" for i in ids)


def test_table_order_and_cycles(spark):
    base = table(spark)
    a = base.but(name="a", references=(ForeignKey(("id",), "b", ("id",)), ForeignKey(("id",), "a", ("id",))))
    b = base.but(name="b")
    assert [m.name for m in graph.table_order([a, b])] == ["b", "a"]
    with pytest.raises(WriteNotSupported, match="circle"):
        graph.table_order([a, b.but(references=(ForeignKey(("id",), "a", ("id",)),))])


def test_depth_with_a_circle(spark):
    df = spark.createDataFrame([(1, None), (2, 1), (3, 2), (8, 9), (9, 8)], "id long, parent long")
    assert {r.id: r.depth for r in graph.with_depth(df, "id", "parent").collect()} == {1: 0, 2: 1, 3: 2, 8: 0, 9: 0}


def test_partitions(spark):
    one = lambda i, table, state, n, write: [(i + k, table, state, write, [], ["id"], False, table == "json") for k in range(n)]
    rows = one(0, "t", "Added", 120, ["a", "b"]) + one(200, "t", "Added", 3, ["b", "a"]) + one(300, "json", "Modified", 150, ["a"])
    df = spark.createDataFrame(rows, CHANGES)
    got = [(p.table, p.n, p.reason) for p in plan_partitions(df, WriteOptions())]
    assert got == [("t", 120, None), ("t", 3, "below threshold"), ("json", 150, "part of a JSON column")]
    with pytest.raises(WriteNotSupported):
        plan_partitions(df, WriteOptions(on_unsupported=OnUnsupported.RAISE))


# payload forms


@pytest.mark.parametrize("text,want", [("1.50", "1.5"), ("1.500", "1.5"), ("0.00", "0"), ("100.00", "100"), ("-1.50", "-1.5"), ("-0.00", "0"), ("10.10", "10.1"), ("9.99", "9.99"), ("1.05", "1.05"), ("0.001", "0.001"), ("100", "100")])
def test_decimals(spark, text, want):
    scale = len(text.split(".")[1]) if "." in text else 0
    df = spark.createDataFrame([(text,)], "s string").select(decimal_text(F.col("s").cast(f"decimal(18,{scale})")).alias("d"))
    assert df.first().d == want


def test_keys(spark):
    from pyspark.sql import types as T

    df = spark.createDataFrame([("a|b", "c"), ("a", "b|c"), (None, "x")], "p string, q string")
    got = [r.k for r in df.select(key_text([(F.col("p"), T.StringType()), (F.col("q"), T.StringType())]).alias("k")).collect()]
    assert got == ["a\\|b|c", "a|b\\|c", "|x"]
    blob = spark.createDataFrame([(bytearray([1, 2, 3]),)], "b binary").select(key_text([(F.col("b"), T.BinaryType())]).alias("k"))
    assert blob.first().k == "AQID"


def test_containment(spark):
    df = spark.createDataFrame([('{"a":{"b":1,"c":null},"l":["x","y"]}',), ("{}",)], "j string")
    ask = lambda w: [r.r for r in df.select(contains(F.col("j"), w).alias("r")).collect()]
    assert ask({"a": {"b": 1}}) == [True, False] and ask({"l": ["y"]}) == [True, False] and ask({"a": {"c": None}}) == [True, False] and ask({"a": {"b": 2}}) == [False, False]


# sessions


@pytest.fixture()
def session(spark, tmp_path):
    m = table(spark, checks={"positive": "v >= 0"}, defaults={"note": "none"})
    s = Session(spark, f"file://{tmp_path}/store", [m], QueryOptions(), WriteOptions(), AuditOptions(tenant_column="tenant"), {"t": AuditSpec(mask={"note": None})})
    s.load("t", frame(spark, ROWS))
    return s


def test_bulk_and_saved_changes_tell_the_same(session, spark, tmp_path):
    strip = lambda s: sorted((r.entity_key, r.operation, r.tenant_id, r.changes) for r in s.audit_trail().collect())
    now = session.read("t").where("id <> 3").withColumn("v", F.when(F.col("id") == 1, 5.0).otherwise(F.col("v"))).unionAll(frame(spark, [(7, "c", 7.0, "s")]))
    assert session.save_changes("t", now) == ch.BulkResult(1, 1, 1)
    other = Session(spark, f"file://{tmp_path}/other", list(session.models.values()), QueryOptions(), WriteOptions(), session.audit_options, session.audit_specs)
    other.load("t", frame(spark, ROWS))
    other.delete("t", frame(spark, ROWS).where("id = 3").select("id"))
    other.update("t", frame(spark, [(1, "a", 5.0, None)]))
    other.insert("t", frame(spark, [(7, "c", 7.0, "s")]))
    assert strip(session) == strip(other) and len(strip(session)) == 3
    assert rows_of(session.read("t")) == rows_of(other.read("t"))
    assert any('"note":"***"' in x[3] for x in strip(session))


def test_failed_writes_leave_nothing(session, spark):
    before = rows_of(session.read("t")), session.store.versions()
    for bad in (frame(spark, [(1, "z", 1.0, None)]), frame(spark, [(20, "z", -1.0, None)]), frame(spark, [(None, "z", 1.0, None)])):
        with pytest.raises(ConstraintViolation):
            session.insert("t", bad)
    assert (rows_of(session.read("t")), session.store.versions()) == before


def test_savepoints_and_conflicts(session, spark):
    with session.transaction():
        session.insert("t", frame(spark, [(10, "a", 1.0, None)]))
        with pytest.raises(ZeroDivisionError):
            with session.transaction():
                session.insert("t", frame(spark, [(11, "a", 1.0, None)]))
                1 / 0
    assert rows_of(session.read("t").select("id")) == [(1,), (10,), (2,), (3,), (4,)]
    base = session.store.manifest()
    session.delete("t", frame(spark, [(10, None, None, None)]).select("id"))
    with pytest.raises(ConcurrencyConflict):
        session.store.commit(base, base.with_files("t", []))


def test_observers_progress_and_untouched_files(session, spark):
    seen, steps = [], []

    class Watch:
        def observes(self, model, op):
            return Needs.ALL

        def observed(self, o, tx):
            seen.append((o.op, o.rows.count(), o.before.count()))

    session.observers.append(Watch())
    session.insert("t", frame(spark, [(i, "q", 1.0, None) for i in range(30, 36)]), batch_size=2, on_progress=steps.append)
    assert steps[-1].fraction == 1.0 and sum(n for _, n, _ in seen) == 6
    kept_files = set(session.store.manifest().files["t"])
    session.update("t", frame(spark, [(1, "a", 6.0, None)]))
    assert len(kept_files & set(session.store.manifest().files["t"])) >= 1 and seen[-1] == (Op.UPDATE, 1, 1)
    old = session.read("t", version=1)
    assert old.count() == 4


def test_rows_in_memory_and_staging(session, spark):
    from ledgerframe.functions.ordinals import shared_folder

    assert session.insert("t", [{"id": 80, "v": 1.0}, {"id": 81, "tenant": "m", "v": 2.0}]).inserted == 2
    assert session.insert_stream("t", ({"id": i, "v": 0.5} for i in range(90, 97)), batch=3).inserted == 7
    assert rows_of(session.read("t").where("id = 80")) == [(80, None, 1.0, "none")]
    with pytest.raises(WriteNotSupported):
        session.insert_stream("t", [], call=Call(include_graph=True))
    left = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/ledgerframe")
    names = [s.getPath().getName() for s in left.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(left)]
    assert not [n for n in names if n.startswith(("staged", "marked", "fresh", "entries"))]


def test_graph_insert(spark, tmp_path):
    m = table(spark)
    parents = spark.createDataFrame([(1, "a", [(10, 5.0)]), (2, "b", [(20, 6.0), (21, 7.0)])], "id long, tenant string, kids array<struct<kid:long,amount:double>>")
    kid = model_of(spark.createDataFrame([], "kid long, amount double, parent long"), "kid", key=("kid",), references=(ForeignKey(("parent",), "t", ("id",)),))
    s = Session(spark, f"file://{tmp_path}/g", [m, kid], write=WriteOptions())
    assert s.insert_graph("t", parents, (graph.Branch("kids", kid, "parent", "id"),)).inserted == 5
    assert rows_of(s.read("kid")) == [(10, 5.0, 1), (20, 6.0, 2), (21, 7.0, 2)]


def test_configuration_is_required(spark, tmp_path):
    s = Session(spark, f"file://{tmp_path}/s", [table(spark)])
    with pytest.raises(NotConfigured):
        s.insert("t", frame(spark, ROWS))
    with pytest.raises(NotConfigured):
        s.audit_trail()
    with pytest.raises(NotConfigured):
        Session(spark, f"file://{tmp_path}/s2", [table(spark)], audit=AuditOptions())


def test_audit_refusals(spark):
    m, o = table(spark), AuditOptions()
    with pytest.raises(AuditNotSupported):
        AuditSpec(exclude=frozenset({"v"}), mask={"v": None})
    with pytest.raises(AuditNotSupported):
        AuditSpec(audited=False, mask={"v": None})
    with pytest.raises(AuditNotSupported):
        plan_audit(m.but(key=()), None, o)
    with pytest.raises(AuditNotSupported):
        plan_audit(m, AuditSpec(exclude=frozenset({"zz"})), o)
    with pytest.raises(AuditNotSupported):
        AuditOptions(external=True)
    AuditOptions(external=True, atomicity=Atomicity.BEST_EFFORT)


def test_audit_scopes_nest():
    with audit_scope(actor=Actor("1"), reason="r", a="x") as outer:
        with audit_scope(reason="s", b="y"):
            inner = current_scope()
            assert inner.actor == Actor("1") and inner.reason == "s" and inner.metadata == {"a": "x", "b": "y"} and inner.correlation_id == outer.correlation_id
        assert current_scope() == outer
    assert current_scope() is None


def test_tracking_scopes_close_in_any_order():
    a, b = tracking.no_tracking(), tracking.tracking()
    assert tracking.current() is tracking.Tracking.TRACKING
    a.close()
    assert tracking.current(tracking.Tracking.NO_TRACKING) is tracking.Tracking.TRACKING
    b.close()
    assert tracking.current(tracking.Tracking.NO_TRACKING) is tracking.Tracking.NO_TRACKING
