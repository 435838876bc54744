import datetime as dt
import decimal

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerframe.catalogue import models, read
from ledgerframe.errors import NotSupported, QueryNotSupported, WriteNotSupported
from ledgerframe.events import EventBus
from ledgerframe.model import Converter, TableModel
from ledgerframe.operators import codec, filtering, keyset, paging, sorting
from ledgerframe.options import Checks, CountStrategy, Numbering, OnWarning, QueryOptions
from ledgerframe.plans.advisor import Advisor
from ledgerframe.streaming.batches import stream, stream_batches


@pytest.fixture(scope="module")
def orders(spark, data):
    return read(spark, data, "orders")


def keys(**flags):
    b = keyset.KeysetBuilder(models()["orders"]).descending("o_orderdate").ascending("o_orderkey")
    return b.build()


# filters


def test_inactive_filters_return_their_source(orders):
    assert filtering.where_if(orders, False, F.lit(True)) is orders
    assert filtering.where_if_not_null(orders, None, lambda v: F.lit(v)) is orders
    assert filtering.where_between(orders, "o_orderdate") is orders
    assert filtering.search(orders, filtering.SearchSpec(("o_orderstatus",)), " ") is orders


def test_empty_list_matches_nothing(orders):
    assert filtering.where_in(orders, "o_orderkey", []).count() == 0


def test_long_list_becomes_a_join_and_is_reported(orders):
    told = []
    got = filtering.where_in(orders, "o_orderkey", range(1, 50), most=10, advise=told.append)
    assert told == [49] and got.count() == orders.where("o_orderkey between 1 and 49").count()


def test_between_is_half_open_and_pushed_down(spark, data, capsys):
    df = filtering.where_between(read(spark, data, "orders"), "o_orderdate", dt.datetime(1994, 1, 1), dt.datetime(1995, 1, 1))
    df.explain("formatted")
    plan = capsys.readouterr().out
    assert "GreaterThanOrEqual(o_orderdate" in plan and "LessThan(o_orderdate" in plan


def test_search_needs_fields():
    with pytest.raises(QueryNotSupported):
        filtering.SearchSpecBuilder().build()


def test_search_takes_wildcards_literally(spark):
    df = spark.createDataFrame([("a%b",), ("axb",), (None,)], "s string")
    assert [r.s for r in filtering.search(df, filtering.SearchSpec(("s",)), "%").collect()] == ["a%b"]


def test_scopes_refuse_what_they_cannot_say(spark):
    with pytest.raises(WriteNotSupported):
        filtering.Scope.where("a", "<", None)
    with pytest.raises(WriteNotSupported):
        filtering.Scope.where("a", "~", 1)
    with pytest.raises(WriteNotSupported):
        filtering.Scope.sql("t.a = 1") & filtering.Scope.eq("b", 2)
    with pytest.raises(WriteNotSupported):
        filtering.Scope.sql("t.a = 1", most=3).within(spark.range(1), models()["orders"], "in__")


def test_sql_scope_binds_values(spark):
    df = spark.createDataFrame([("it's",), ("x",)], "s string")
    model = TableModel("t", df.schema)
    inside = lambda text, **args: filtering.Scope.sql(text, **args).within(df, model, "in__").where("in__").count()
    assert inside("t.s = :v", v="it's") == 1 and inside("t.s = :v -- {or} ':x'", v="it's") == 1 and inside("t.s = ':v' or t.s = :v", v="t.:v ' x") == 0


# sorting


@pytest.mark.parametrize("bad", ["total,,placed", "total:desc:asc", "total:sideways", "-total:desc", "-", ":desc"])
def test_malformed_sort_terms(bad):
    assert sorting.SortRequest.try_parse(bad) is None
    with pytest.raises(QueryNotSupported):
        sorting.SortRequest.parse(bad)


def test_sort_request_reads_back():
    r = sorting.SortRequest.parse(" total:Descending , +placed,-id ")
    assert [(f.name, f.direction) for f in r.fields] == [("total", "desc"), ("placed", "asc"), ("id", "desc")]
    assert sorting.SortRequest.parse(str(r)) == r
    assert not sorting.SortRequest.parse("  ")


def test_sort_spec_refusals():
    b = sorting.SortSpecBuilder
    with pytest.raises(QueryNotSupported):
        b().build()
    with pytest.raises(QueryNotSupported):
        b().allow("a").build()
    with pytest.raises(QueryNotSupported):
        b().allow("a").allow("A")
    with pytest.raises(QueryNotSupported):
        b().allow("a").default_order("b").build()
    spec = b().allow("a").tiebreaker("id").build()
    with pytest.raises(QueryNotSupported, match="allowed: a"):
        spec.resolve("b")
    with pytest.raises(QueryNotSupported):
        spec.resolve("a,A:desc")


def test_tiebreaker_is_appended_once():
    spec = sorting.SortSpecBuilder().allow("id").allow("a").default_order("a").tiebreaker("id").build()
    assert [t.path for t in spec.resolve("")] == ["a", "id"]
    assert [(t.path, t.direction) for t in spec.resolve("-ID")] == [("id", "desc")]


# pages


def test_page_requests():
    options = QueryOptions()
    assert paging.PageRequest.of(3).resolve(options) == (40, 20)
    assert paging.PageRequest.of(1, 5000).resolve(options) == (0, 100)
    assert paging.PageRequest.of(0, 7).resolve(QueryOptions(numbering=Numbering.ZERO_BASED)) == (0, 7)
    for bad in (lambda: paging.PageRequest.of(-1), lambda: paging.PageRequest.of(1, 0), lambda: paging.PageRequest.of(0).resolve(options), lambda: paging.PageRequest.of(2**31).resolve(options)):
        with pytest.raises(QueryNotSupported):
            bad()
    with pytest.raises(NotSupported):
        QueryOptions(default_page_size=200)


def test_offset_counts(orders):
    df, n = orders.orderBy("o_orderkey"), orders.count()
    last = -(-n // 100)
    p = paging.to_page(df, paging.PageRequest.of(last, 100))
    assert p.total == n and p.total_pages == last and not p.has_next and p.has_previous
    p = paging.to_page(df, paging.PageRequest.of(1, 100), QueryOptions(count=CountStrategy.HAS_NEXT_PROBE))
    assert p.total is None and p.has_next and len(p.items) == 100
    assert paging.to_page(df, paging.PageRequest.of(1), QueryOptions(count=CountStrategy.NONE)).has_next is None


# keysets


def test_keyset_definitions_refuse():
    m = models()["orders"]
    with pytest.raises(QueryNotSupported):
        keyset.KeysetBuilder(m).build()
    with pytest.raises(QueryNotSupported):
        keyset.KeysetBuilder(m).ascending("o_orderkey").descending("o_orderkey").build()
    with pytest.raises(NotSupported):
        keyset.KeysetBuilder(m).ascending("nothing").build()
    with pytest.raises(QueryNotSupported, match="may be null"):
        keyset.KeysetBuilder(m).ascending("o_orderpriority").ascending("o_orderkey").build().validate()
    with pytest.raises(QueryNotSupported, match="doesn't name a row"):
        keyset.KeysetBuilder(m).ascending("o_orderdate").build().validate()
    with pytest.raises(QueryNotSupported, match="doesn't name a row"):
        keyset.KeysetBuilder(models()["lineitem"]).ascending("l_orderkey").ascending("l_linenumber").build().validate()
    keyset.KeysetBuilder(models()["lineitem"]).ascending("l_orderkey").allow_non_unique().build().validate()
    odd = m.but(converters={"o_orderkey": Converter(str, int)})
    with pytest.raises(QueryNotSupported, match="order of its own"):
        keyset.KeysetBuilder(odd).ascending("o_orderkey").build().validate()
    keyset.KeysetBuilder(odd).ascending("o_orderkey").allow_converted().build().validate()


@pytest.mark.parametrize("bad", ["", " ", "not base64url!!", "YWJj", None])
def test_malformed_cursors(bad):
    assert keyset.KeysetCursor.try_parse(bad) is None


def test_cursor_belongs_to_its_ordering(orders):
    page = keyset.keyset_page(orders, keys(), 3)
    other = keyset.KeysetBuilder(models()["orders"]).ascending("o_orderdate").ascending("o_orderkey").build()
    with pytest.raises(QueryNotSupported, match="another ordering"):
        keyset.keyset_page(orders, other, 3, page.next)
    c = keyset.KeysetCursor.parse(page.next)
    with pytest.raises(QueryNotSupported, match="number of values"):
        keys().boundary(keyset.KeysetCursor(c.fingerprint, c.direction, c.values[:1]))


@pytest.mark.parametrize("size", [3, 7, 50])
def test_three_ways_to_walk(orders, size):
    few = orders.where("o_orderkey <= 120").cache()
    k = keys()
    whole = [r.o_orderkey for r in k.order(few).collect()]
    forward = [r.o_orderkey for p in keyset.walk(few, k, size) for r in p.items]
    by_offset = [r.o_orderkey for i in range(0, len(whole), size) for r in paging.slice_frame(k.order(few), i, size).collect()]
    page, pages = None, []
    for page in keyset.walk(few, k, size):
        pass
    back = [r.o_orderkey for r in page.items]
    while page.previous:
        page = keyset.keyset_page(few, k, size, page.previous)
        assert page.has_next
        back = [r.o_orderkey for r in page.items] + back
    assert forward == whole == by_offset == back


def test_boundary_reaches_the_scan(spark, data, capsys):
    df = read(spark, data, "orders")
    page = keyset.keyset_page(df, keys(), 5)
    keyset.page_frame(df, keys(), 5, keyset.KeysetCursor.parse(page.next)).explain("formatted")
    plan = capsys.readouterr().out
    assert "LessThanOrEqual(o_orderdate" in plan and "TakeOrderedAndProject" in plan


def test_batches(orders):
    few = orders.where("o_orderkey <= 100")
    got = list(stream_batches(few, keys(), 30))
    assert all(got) and sum(map(len, got)) == few.count() and all(len(b) == 30 for b in got[:-1])
    assert sum(1 for _ in stream(few, keys(), 30)) == few.count()
    with pytest.raises(QueryNotSupported):
        stream_batches(few, keyset.KeysetBuilder(models()["orders"]).ascending("o_orderdate").build())


SAMPLES = [
    (5, T.IntegerType()), (-(2**62), T.LongType()), (0.1, T.DoubleType()), (decimal.Decimal("1.50"), T.DecimalType(10, 2)), (True, T.BooleanType()), ("a|b %é", T.StringType()),
    (dt.date(2024, 2, 29), T.DateType()), (dt.datetime(2024, 1, 1, 1, 2, 3, 4), T.TimestampNTZType()), (bytearray(b"\x00\xff"), T.BinaryType()), (dt.timedelta(days=1, microseconds=5), T.DayTimeIntervalType()),
]


@pytest.mark.parametrize("value,kind", SAMPLES)
def test_codec_round_trip(value, kind):
    assert codec.decode(codec.encode(value, kind), kind) == value


def test_codec_refuses():
    with pytest.raises(QueryNotSupported):
        codec.decode("2", T.BooleanType())
    with pytest.raises(QueryNotSupported):
        codec.decode("x", T.LongType())
    with pytest.raises(QueryNotSupported):
        codec.encode([1], T.ArrayType(T.LongType()))


@given(st.text(), st.integers(-(2**63), 2**63 - 1))
@settings(max_examples=50, deadline=None)
def test_tokens_round_trip(text, number):
    text = text.encode("utf-8", "ignore").decode()
    c = keyset.KeysetCursor("ab", keyset.FORWARD, (text, str(number)))
    assert keyset.KeysetCursor.try_parse(c.token()) == c


# advisor


def test_advisor_behaviours(orders):
    bus, heard = EventBus(), []
    bus.subscribe(heard.append)
    silent = Advisor(models()["orders"], QueryOptions(checks=Checks.ALL, on_warning=OnWarning.IGNORE), bus)
    assert silent.offset(orders, 10**6) == [] and not heard
    told = Advisor(models()["orders"], QueryOptions(checks=Checks.DEEP_OFFSET), bus)
    assert [f.check for f in told.offset(orders.orderBy("o_orderkey"), 10**6)] == [Checks.DEEP_OFFSET] and [e.name for e in heard] == ["DEEP_OFFSET"]
    strict = Advisor(models()["orders"], QueryOptions(checks=Checks.ALL, on_warning=OnWarning.RAISE), bus)
    with pytest.raises(QueryNotSupported, match="DEEP_OFFSET.*NON_DETERMINISTIC_ORDER"):
        strict.offset(orders.orderBy("o_totalprice"), 10**6)
