"""Sessions over the store: keys, constraints, conflicts, vacuum, fallbacks and where the trail goes."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerframe.audit.spec import AuditSpec
from ledgerframe.errors import ConcurrencyConflict, ConstraintViolation, NotConfigured, NotSupported, QueryNotSupported, WriteNotSupported
from ledgerframe.functions.ordinals import shared_folder
from ledgerframe.model import Converter, ForeignKey, TableModel, model_of
from ledgerframe.observers import Needs
from ledgerframe.operators import changes as ch
from ledgerframe.operators import keyset, paging
from ledgerframe.operators.graph import Branch
from ledgerframe.operators.sorting import ASC, DESC, SortTerm, apply_order
from ledgerframe.options import Atomicity, AuditOptions, OnSinkFailure, OnUnsupported, Op, WriteOptions
from ledgerframe.session import Session
from ledgerframe.sources import store as st

SCHEMA = "id long, code string, v double"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def model(spark, **facts):
    return model_of(frame(spark, []), "t", **({"key": ("id",)} | facts))


def opened(spark, path, m, n=20, **kinds):
    s = Session(spark, f"file://{path}", [m], **({"write": WriteOptions()} | kinds))
    s.load("t", frame(spark, [(i, f"c{i}", float(i)) for i in range(1, n + 1)]).repartitionByRange(4, "id"))
    assert len(s.store.manifest().of("t")) == 4
    return s


def ids(df):
    return sorted(r.id for r in df.select("id").collect())


def test_generated_keys_follow_the_whole_table(spark, tmp_path):
    s = opened(spark, tmp_path, model(spark, uniques=(("code",),), generated={"id": "sequence"}))
    rows = [("c2", 0.5), ("n1", 1.0), ("n2", 2.0)]
    assert s.merge("t", spark.createDataFrame(rows, "code string, v double"), match_on=("code",)) == ch.BulkResult(2, 1, 0)
    assert ids(s.read("t")) == list(range(1, 23))
    s.delete("t", s.read("t").where("id = 22").select("id"))
    s.insert("t", spark.createDataFrame([("n3", 0.0)], "code string, v double"))
    assert ids(s.read("t"))[-1] == 23  # a number isn't given twice
    assert s.store.manifest().next == {"t.id": 24}


def test_uniques_hold_on_every_write(spark, tmp_path):
    s = opened(spark, tmp_path, model(spark, uniques=(("code",),)))
    for write in (
        lambda: s.merge("t", frame(spark, [(50, "c3", 0.0)])), lambda: s.update("t", frame(spark, [(4, "c3", 0.0)])), lambda: s.insert("t", frame(spark, [(60, "c3", 0.0)])),
        lambda: s.merge("t", frame(spark, [(4, "c9", 0.0)])), lambda: s.merge("t", frame(spark, [(70, "x", 0.0), (71, "x", 0.0)])), lambda: s.merge("t", frame(spark, [(5, "fresh", 0.0)]), match_on=("code",)),
        lambda: s.save_changes("t", s.read("t").unionAll(frame(spark, [(80, "c1", 0.0)])), s.read("t")),
    ):
        with pytest.raises(ConstraintViolation):
            write()
    assert s.store.versions() == [1]
    s.update("t", frame(spark, [(4, "c3", 0.0), (3, "c4", 0.0)]))  # values that change places
    assert {r.id: r.code for r in s.read("t").where("id in (3, 4)").collect()} == {3: "c4", 4: "c3"}
    assert s.merge("t", frame(spark, [(90, None, 0.0), (91, None, 0.0)])).inserted == 2  # nulls are no values


def test_references_hold_both_ways(spark, tmp_path):
    parent = model(spark)
    child = TableModel("kid", T._parse_datatype_string("k long, of long"), key=("k",), references=(ForeignKey(("of",), "t", ("id",)),))
    s = Session(spark, f"file://{tmp_path}", [parent, child], write=WriteOptions())
    s.load("t", frame(spark, [(i, "x", 0.0) for i in range(4)]).repartition(2))
    s.load("kid", spark.createDataFrame([(1, 2), (2, None)], "k long, of long"))
    for write in (
        lambda: s.delete("t", spark.createDataFrame([(2,)], "id long")), lambda: s.synchronize("t", frame(spark, [(0, "y", 1.0)]), allow_full_table_delete=True),
        lambda: s.insert("kid", spark.createDataFrame([(3, 77)], "k long, of long")), lambda: s.update("kid", spark.createDataFrame([(1, 77)], "k long, of long")),
        lambda: s.save_changes("t", s.read("t").where("id <> 2"), s.read("t")),
    ):
        with pytest.raises(ConstraintViolation):
            write()
    s.delete("kid", spark.createDataFrame([(1,)], "k long"))
    assert s.delete("t", spark.createDataFrame([(2,)], "id long")).deleted == 1


def test_commits_of_other_tables_do_not_clash(spark, tmp_path):
    other = model(spark).but(name="u")
    make = lambda: Session(spark, f"file://{tmp_path}", [model(spark), other], write=WriteOptions())
    a, b = make(), make()
    a.load("t", frame(spark, [(1, "x", 0.0)]))
    with a.transaction():
        a.insert("t", frame(spark, [(2, "x", 0.0)]))
        b.insert("u", frame(spark, [(1, "x", 0.0)]))
    assert ids(b.read("t")) == [1, 2] and ids(a.read("u")) == [1]
    with pytest.raises(ConcurrencyConflict):
        with a.transaction():
            a.update("t", frame(spark, [(2, "y", 0.0)]))
            b.insert("t", frame(spark, [(3, "x", 0.0)]))
    assert ids(a.read("t")) == [1, 2, 3]


def test_many_versions_read_back(spark, tmp_path):
    s = opened(spark, tmp_path, model(spark), n=4)
    for i in range(st.EVERY + 3):
        base = s.store.manifest()
        s.store.commit(base, base.with_files("u" if i % 2 else "t", [*base.of("u" if i % 2 else "t"), f"file:/f{i}"]))
    again = st.Store(spark, f"file://{tmp_path}")
    assert again.latest() == st.EVERY + 4 and len(again.manifest().of("t")) == 4 + 10 and len(again.manifest().of("u")) == 9
    assert len(again.manifest(st.EVERY).of("u")) == 7 and again.manifest().tables() == ["t", "u"]
    with pytest.raises(NotSupported):
        again.manifest(999)


def test_vacuum_spares_open_transactions(spark, tmp_path):
    s = opened(spark, tmp_path, model(spark))
    other = Session(spark, f"file://{tmp_path}", [model(spark)], write=WriteOptions())
    with s.transaction():
        s.insert("t", frame(spark, [(100, "x", 0.0)]))
        assert other.store.vacuum(retention_hours=0) == 0
    assert 100 in ids(other.read("t"))
    s.update("t", frame(spark, [(1, "y", 0.0)]))
    assert s.store.vacuum() == 0  # younger than the retention time
    import time

    time.sleep(1.1)
    assert s.store.vacuum(retention_hours=0) == 1 and len(ids(s.read("t"))) == 21
    with pytest.raises(NotSupported):
        s.read("t", version=1)
    assert s.store.vacuum(retention_hours=0) == 0 and s.store.versions() == [s.store.latest()]


def test_declined_writes_take_the_plain_path(spark, tmp_path):
    told = []
    no = lambda plan: "not here"
    s = opened(spark, tmp_path / "a", model(spark), write=WriteOptions(declines=no))
    s.events.subscribe(lambda e: told.append((e.name, e.facts.get("reason"), e.facts.get("rows"), e.facts.get("accelerated"))))
    assert s.update("t", frame(spark, [(1, "y", 0.0)])).updated == 1 and s.delete("t", frame(spark, [(2, "y", 0.0)]).select("id")).deleted == 1
    assert told == [("ExplicitFallback", "not here", 1, None), ("PartitionExecuted", None, 1, False)] * 2 and len(ids(s.read("t"))) == 19
    with pytest.raises(WriteNotSupported, match="not here"):
        s.merge("t", frame(spark, [(1, "y", 0.0)]))
    strict = opened(spark, tmp_path / "b", model(spark), write=WriteOptions(declines=no, on_unsupported=OnUnsupported.RAISE))
    with pytest.raises(WriteNotSupported):
        strict.insert("t", frame(spark, [(100, "y", 0.0)]))


def test_many_files_are_narrowed_first(spark, tmp_path):
    s = opened(spark, tmp_path, model(spark), write=WriteOptions(narrow_files=2))
    before = set(s.store.manifest().of("t"))
    assert s.merge("t", frame(spark, [(1, "y", 0.0), (99, "z", 1.0)])) == ch.BulkResult(1, 1, 0)
    assert len(before & set(s.store.manifest().of("t"))) == 3 and ids(s.read("t")) == [*range(1, 21), 99]
    with pytest.raises(ConcurrencyConflict):
        s.delete("t", frame(spark, [(500, "y", 0.0)]).select("id"))


def test_saved_changes_check_tokens_and_shapes(spark, tmp_path):
    s = opened(spark, tmp_path, model(spark, tokens=frozenset({"v"}), procedures=frozenset({"Deleted"})))
    before = s.read("t")
    now = before.where("id <> 7").withColumn("code", F.when(F.col("id") == 3, "moved").otherwise(F.col("code")))
    told = []
    s.events.subscribe(lambda e: told.append((e.facts["state"], e.facts["reason"])) if e.name == "PartitionDeclined" else None)
    assert s.save_changes("t", now, before) == ch.BulkResult(0, 1, 1)
    assert sorted(told) == [("Deleted", "stored procedure"), ("Modified", "below threshold")]
    with pytest.raises(ConcurrencyConflict):  # row 3 is what was read no more
        s.save_changes("t", before.where("id <> 3").unionAll(frame(spark, [(3, "again", 3.5)])), before.withColumn("v", F.col("v") + 1))
    strict = opened(spark, tmp_path / "x", model(spark, procedures=frozenset({"Deleted"})), write=WriteOptions(on_unsupported=OnUnsupported.RAISE))
    with pytest.raises(WriteNotSupported, match="stored procedure"):
        strict.save_changes("t", strict.read("t").where("id > 1"), strict.read("t"))


def test_trail_in_another_store(spark, tmp_path):
    options = AuditOptions(external=True, atomicity=Atomicity.BEST_EFFORT, tenant_column=None, batch_threshold=2)
    with pytest.raises(NotConfigured):
        opened(spark, tmp_path / "n", model(spark), audit=options, audit_specs={"t": AuditSpec()})
    s = opened(spark, tmp_path / "a", model(spark), audit=options, audit_specs={"t": AuditSpec()}, audit_path=f"file://{tmp_path}/trail")
    batched = []
    s.events.subscribe(lambda e: batched.append((e.facts["count"], e.facts["batched"])) if e.name == "EntriesWritten" else None)
    s.insert("t", frame(spark, [(50, "x", 0.0)]))
    s.delete("t", frame(spark, [(1, "", 0.0), (2, "", 0.0)]).select("id"))
    assert batched == [(1, False), (2, True)] and s.audit_trail().count() == 3 and s.store.manifest().tables() == ["t"]
    with pytest.raises(ZeroDivisionError):
        with s.transaction():
            s.insert("t", frame(spark, [(51, "x", 0.0)]))
            1 / 0
    assert s.audit_trail().count() == 3


def test_sinks_that_fail(spark, tmp_path):
    def bad(told, tx):
        raise OSError("no sink")

    for n, (atomicity, failure, kept) in enumerate([(Atomicity.SAME_TRANSACTION, OnSinkFailure.IGNORE, False), (Atomicity.BEST_EFFORT, OnSinkFailure.IGNORE, True), (Atomicity.BEST_EFFORT, OnSinkFailure.RAISE, False)]):
        s = opened(spark, tmp_path / str(n), model(spark), sink=bad, audit=AuditOptions(atomicity=atomicity, on_sink_failure=failure, tenant_column=None), audit_specs={"t": AuditSpec()})
        failed = []
        s.events.subscribe(lambda e: failed.append(e.name))
        if kept:
            s.insert("t", frame(spark, [(50, "x", 0.0)]))
        else:
            with pytest.raises(OSError):
                s.insert("t", frame(spark, [(50, "x", 0.0)]))
        assert "SinkFailed" in failed and (50 in ids(s.read("t"))) == kept


def test_observers_get_what_they_need(spark, tmp_path):
    seen = {}

    class Watch:
        def __init__(self, needs):
            self.needs = needs

        def observes(self, model, op):
            return self.needs

        def observed(self, o, tx):
            seen[self.needs] = (o.rows.count(), o.before.count(), o.removed.count())

    s = opened(spark, tmp_path, model(spark))
    for needs, update, delete in ((Needs.ROWS, (1, 0, 0), (0, 1, 1)), (Needs.ALL, (1, 1, 0), (0, 1, 1))):
        s.observers = [Watch(needs)]
        s.update("t", frame(spark, [(5, "y", 0.0)]))
        assert seen[needs] == update
        s.delete("t", s.read("t").where("id = 10" if needs is Needs.ROWS else "id = 11").select("id"))
        assert seen[needs] == delete
    s.observers = [Watch(Needs.NOTHING)]
    s.update("t", frame(spark, [(5, "z", 0.0)]))
    assert Needs.NOTHING not in seen


def test_a_failure_without_a_savepoint_dooms_the_transaction(spark, tmp_path):
    s = opened(spark, tmp_path, model(spark))
    with pytest.raises(ConcurrencyConflict, match="savepoint"):
        with s.transaction():
            s.insert("t", frame(spark, [(50, "x", 0.0)]))
            with pytest.raises(ConstraintViolation):
                s.insert("t", frame(spark, [(50, "x", 0.0)]), savepoint=False)
    assert 50 not in ids(s.read("t"))


def test_graphs_by_the_insert_option(spark, tmp_path):
    kid = TableModel("kid", T._parse_datatype_string("k long, name string, of long"), key=("k",), generated={"k": "sequence"}, references=(ForeignKey(("of",), "t", ("id",)),))
    m = model(spark, generated={"id": "sequence"}, nested=(Branch("near", kid, "of", "id"), Branch("far", kid, "of", "id")))
    s = Session(spark, f"file://{tmp_path}", [m, kid], write=WriteOptions())
    rows = spark.createDataFrame([("a", 1.0, [("a1",), ("a2",)], [("a3",)]), ("b", 2.0, [], [("b1",)])], "code string, v double, near array<struct<name:string>>, far array<struct<name:string>>")
    assert s.insert("t", rows, include_graph=True).inserted == 6
    joined = s.read("kid").join(s.read("t"), F.col("of") == F.col("id")).select("name", "code")
    assert sorted(map(tuple, joined.collect())) == [("a1", "a"), ("a2", "a"), ("a3", "a"), ("b1", "b")]
    assert s.insert("t", rows, include_graph=True).inserted == 6 and ids(s.read("t")) == [1, 2, 3, 4]
    for write in (lambda: s.update("t", rows, include_graph=True), lambda: s.insert("kid", spark.createDataFrame([("x",)], "name string"), include_graph=True)):
        with pytest.raises(WriteNotSupported):
            write()


def test_shared_folder_is_required_off_local_masters():
    class Conf:
        def get(self, *_):
            return None

    class Fake:
        conf, sparkContext = Conf(), type("C", (), {"master": "spark://far:7077"})()

    with pytest.raises(NotConfigured):
        shared_folder(Fake())


def test_cursors_of_converted_keys(spark):
    upper = Converter(lambda v: v.upper() if v else None, lambda v: v.lower(), order_preserving=True)
    keys = keyset.KeysetBuilder(model(spark, required=frozenset({"code"}), converters={"code": upper})).ascending("code").ascending("id").build()
    df = frame(spark, [(1, "A", 0.0), (2, "B", 0.0), (3, "C", 0.0)])
    assert ids(keyset.page_frame(df, keys, 5, keys.cursor_at(["b", 2]))) == [3]
    assert keys.modelled(df.first()) == {"code": "a", "id": 1}
    for bad in (["Mixed", 1], [None, 1], ["b"]):
        with pytest.raises(QueryNotSupported):
            keys.cursor_at(bad)


@pytest.mark.parametrize("direction", [ASC, DESC])
def test_deep_pages(spark, direction):
    df = spark.range(3000).select("id", F.when(F.col("id") % 7 > 0, F.col("id") * 37 % 101).alias("x"), F.timestamp_seconds(F.col("id") * 37 % 997).cast("timestamp_ntz").alias("ts"), F.col("id").cast("string").alias("s"))
    for lead in ("x", "ts", "s"):
        terms = [SortTerm(lead, direction), SortTerm("id")]
        for offset in (0, 300, 1500, 2990, 5000):
            want = [r.id for r in apply_order(df, terms).offset(offset).limit(20).collect()]
            assert [r.id for r in paging.deep_slice(df, terms, offset, 20).collect()] == want
    deep = paging.to_page(df, paging.PageRequest.of(100, 20), paging.QueryOptions(max_offset_rows=50), terms=terms)
    assert len(deep.items) == 20 and deep.total == 3000
