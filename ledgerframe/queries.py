"""The driver's catalogue: a query for each operator over whole tables, and the same in DuckDB SQL.

Order-sensitive queries return `rn`, the row's place in its page.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from .audit import search as trail_search
from .audit.entry import entries
from .audit.scope import Actor, AuditScope
from .audit.spec import AuditSpec, plan_audit
from .catalogue import models, read
from .functions.ordinals import with_dense_ordinal
from .functions.payload import decimal_text, key_text
from .operators import changes as ch
from .operators import filtering as fl
from .model import TableModel
from .operators import graph, keyset, paging, sorting
from .options import AuditOptions, Call, Checks, CountStrategy, Numbering, Op, QueryOptions, WriteOptions
from .plans.advisor import Advisor
from .plans.partition import by_shape, with_eligibility
from .plans.write_plan import plan_write
from .session import difference
from .streaming.batches import stream_batches

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def add(f: Query) -> Query:
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


def numbered(page: DataFrame, terms: list[sorting.SortTerm]) -> DataFrame:
    """A page, at most as large as a page may be, with its rows' places."""
    return page.withColumn("rn", F.row_number().over(W.orderBy(*[t.column() for t in terms])).cast("bigint"))


# filters


@query("SELECT * FROM orders WHERE o_totalprice > 200000")
def filter_where_if(spark, d):
    return fl.where_if(read(spark, d, "orders"), True, F.col("o_totalprice") > 200000)


@query("SELECT * FROM orders")
def filter_where_if_inactive(spark, d):
    return fl.where_if(read(spark, d, "orders"), False, F.col("o_totalprice") > 200000)


@query("SELECT * FROM orders WHERE o_orderpriority = '1-URGENT'")
def filter_where_if_not_null(spark, d):
    df = fl.where_if_not_null(read(spark, d, "orders"), "1-URGENT", lambda v: F.col("o_orderpriority") == v)
    return fl.where_if_not_null(df, None, lambda v: F.col("o_orderstatus") == v)


@query("SELECT * FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')")
def filter_where_in(spark, d):
    return fl.where_in(read(spark, d, "orders"), "o_orderpriority", ["1-URGENT", "2-HIGH", "1-URGENT"])


@query("SELECT * FROM orders WHERE false")
def filter_where_in_empty(spark, d):
    return fl.where_in(read(spark, d, "orders"), "o_orderpriority", [])


@query("SELECT * FROM orders WHERE o_orderkey BETWEEN 1 AND 3000")
def filter_where_in_large(spark, d):
    return fl.where_in(read(spark, d, "orders"), "o_orderkey", range(1, 3001))


@query("SELECT * FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size < 10)")
def filter_where_in_semi_join(spark, d):
    return fl.where_in_rows(read(spark, d, "lineitem"), "l_partkey", read(spark, d, "part").where("p_size < 10"), "p_partkey")


#: Bounds on exact stored dates: the first and last of a few orders, found at run time.
_BOUNDS = "(SELECT min(o_orderdate) AS low, max(o_orderdate) AS high FROM orders WHERE o_orderkey BETWEEN 11 AND 14)"


def _bounds(orders: DataFrame) -> tuple[dt.datetime, dt.datetime]:
    r = orders.where("o_orderkey BETWEEN 11 AND 14").agg(F.min("o_orderdate").alias("low"), F.max("o_orderdate").alias("high")).first()
    return r.low, r.high


@query(f"SELECT orders.* FROM orders, {_BOUNDS} WHERE o_orderdate >= low AND o_orderdate < high")
def filter_where_between(spark, d):
    orders = read(spark, d, "orders")
    return fl.where_between(orders, "o_orderdate", *_bounds(orders))


@query(f"SELECT orders.* FROM orders, {_BOUNDS} WHERE o_orderdate < high")
def filter_where_between_open_lower(spark, d):
    orders = read(spark, d, "orders")
    return fl.where_between(orders, "o_orderdate", None, _bounds(orders)[1])


@query(f"SELECT orders.* FROM orders, {_BOUNDS} WHERE o_orderdate >= low")
def filter_where_between_open_upper(spark, d):
    orders = read(spark, d, "orders")
    return fl.where_between(orders, "o_orderdate", _bounds(orders)[0], None)


@query(f"SELECT orders.* FROM orders, {_BOUNDS} WHERE o_orderdate >= high AND o_orderdate < low")
def filter_where_between_inverted(spark, d):
    orders = read(spark, d, "orders")
    return fl.where_between(orders, "o_orderdate", *_bounds(orders)[::-1])


@query(f"SELECT count(*) FILTER (o_orderdate = low AND o_orderdate < high) AS at_low, 0::BIGINT AS at_high, count(*) FILTER (o_orderdate >= low AND o_orderdate < high) AS inside FROM orders, {_BOUNDS}")
def filter_where_between_ends(spark, d):
    """Rows on the bounds themselves: the lower is in, the upper isn't."""
    orders = read(spark, d, "orders")
    low, high = _bounds(orders)
    at = lambda v: F.count(F.when(F.col("o_orderdate") == F.lit(v).cast("timestamp_ntz"), 1))
    return fl.where_between(orders, "o_orderdate", low, high).agg(at(low).alias("at_low"), at(high).alias("at_high"), F.count(F.lit(1)).alias("inside"))


@query("SELECT * FROM customer WHERE (c_acctbal > 5000 AND c_mktsegment = 'BUILDING') OR NOT (c_nationkey < 20)")
def filter_predicates_and_or_not(spark, d):
    rich = fl.all_of(F.col("c_acctbal") > 5000, F.col("c_mktsegment") == "BUILDING")
    return read(spark, d, "customer").where(fl.any_of(rich, fl.negate(F.col("c_nationkey") < 20)))


@query("SELECT * FROM customer WHERE c_acctbal >= 100 AND c_nationkey <> 3")
def filter_comparisons(spark, d):
    return read(spark, d, "customer").where(fl.compare(F.col("c_acctbal"), ">=", 100.0) & fl.compare(F.col("c_nationkey"), "<>", 3))


@query("SELECT * FROM part WHERE contains(p_name, 'e') OR contains(p_type, 'e')")
def search_contains(spark, d):
    return fl.search(read(spark, d, "part"), fl.SearchSpecBuilder().field("p_name").field("p_type").build(), " e ")


@query("SELECT * FROM customer WHERE starts_with(c_name, 'Customer#00000001') OR starts_with(c_mktsegment, 'Customer#00000001')")
def search_starts_with(spark, d):
    return fl.search(read(spark, d, "customer"), fl.SearchSpec(("c_name", "c_mktsegment"), fl.Match.STARTS_WITH), "Customer#00000001")


@query("SELECT * FROM customer WHERE c_mktsegment = 'BUILDING'")
def search_exact(spark, d):
    return fl.search(read(spark, d, "customer"), fl.SearchSpec(("c_mktsegment",), fl.Match.EXACT), "BUILDING")


@query("SELECT * FROM part")
def search_blank(spark, d):
    return fl.search(read(spark, d, "part"), fl.SearchSpec(("p_name",)), "   ")


@query("SELECT * FROM orders WHERE o_orderstatus <> 'F'")
def query_filter_applied(spark, d):
    return models()["orders"].filtered(read(spark, d, "orders"))


@query("SELECT * FROM orders")
def query_filter_ignored(spark, d):
    return models()["orders"].filtered(read(spark, d, "orders"), ignore={"open"})


# sorting


def _sort_spec() -> sorting.SortSpec:
    b = sorting.SortSpecBuilder().allow("total", "o_totalprice").allow("placed", "o_orderdate").allow("status", "o_orderstatus")
    return b.default_order("placed", sorting.DESC).tiebreaker("o_orderkey").build()


def _sorted(spark, d, request: str) -> DataFrame:
    """Every row with its place in the requested order; places come from counts of sorted ranges."""
    terms = _sort_spec().resolve(request)
    return with_dense_ordinal(read(spark, d, "orders"), "rn", [t.column() for t in terms], 1).select("rn", "o_orderkey")


@query("SELECT row_number() OVER (ORDER BY o_orderstatus, o_totalprice DESC, o_orderkey) AS rn, o_orderkey FROM orders")
def sort_requested(spark, d):
    return _sorted(spark, d, "Status:ascending, -total")


@query("SELECT row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey) AS rn, o_orderkey FROM orders")
def sort_default(spark, d):
    return _sorted(spark, d, " ")


@query("SELECT row_number() OVER (ORDER BY o_orderstatus, o_orderkey) AS rn, o_orderkey FROM orders")
def sort_tiebreaker(spark, d):
    return _sorted(spark, d, "+status")


# offset pages

_BY_DATE = [sorting.SortTerm("o_orderdate", sorting.DESC), sorting.SortTerm("o_orderkey")]
_ORDERED = "SELECT row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey) AS n, o_orderkey, o_orderdate FROM orders"


def _offset_page(spark, d, request: paging.PageRequest, options: QueryOptions) -> DataFrame:
    offset, size = request.resolve(options)
    ordered = sorting.apply_order(read(spark, d, "orders"), _BY_DATE)
    return numbered(paging.slice_frame(ordered, offset, size), _BY_DATE).select("rn", "o_orderkey", "o_orderdate")


def _page_sql(offset: int, size: int) -> str:
    return f"SELECT n - {offset} AS rn, o_orderkey, o_orderdate FROM ({_ORDERED}) WHERE n > {offset} AND n <= {offset + size}"


@query(_page_sql(40, 20))
def offset_page(spark, d):
    return _offset_page(spark, d, paging.PageRequest.of(3), QueryOptions())


@query(_page_sql(60, 20))
def offset_page_zero_based(spark, d):
    return _offset_page(spark, d, paging.PageRequest.of(3), QueryOptions(numbering=Numbering.ZERO_BASED))


@query(_page_sql(100, 100))
def offset_page_clamped(spark, d):
    return _offset_page(spark, d, paging.PageRequest.of(2, 5000), QueryOptions())


@query("SELECT * FROM (" + _page_sql(0, 0) + ")")
def offset_page_past_end(spark, d):
    return _offset_page(spark, d, paging.PageRequest.of(1_000_000, 100), QueryOptions())


def _deep(spark, d, terms: list[sorting.SortTerm]) -> DataFrame:
    orders = read(spark, d, "orders")
    total = orders.count()
    return numbered(paging.deep_slice(orders, terms, total * 9 // 10, 100), terms)


@query("SELECT n - t AS rn, o_orderkey, o_orderdate FROM (" + _ORDERED + "), (SELECT count(*) * 9 // 10 AS t FROM orders) WHERE n > t AND n <= t + 100")
def offset_page_deep(spark, d):
    return _deep(spark, d, _BY_DATE).select("rn", "o_orderkey", "o_orderdate")


@query("SELECT n - t AS rn, o_orderkey FROM (SELECT row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS n, o_orderkey FROM orders), (SELECT count(*) * 9 // 10 AS t FROM orders) WHERE n > t AND n <= t + 100")
def offset_page_deep_ascending(spark, d):
    return _deep(spark, d, [sorting.SortTerm("o_totalprice"), sorting.SortTerm("o_orderkey")]).select("rn", "o_orderkey")


def _page_facts(spark, d, options: QueryOptions, page: int) -> DataFrame:
    ordered = sorting.apply_order(read(spark, d, "orders"), _BY_DATE)
    p = paging.to_page(ordered, paging.PageRequest.of(page, 50), options)
    row = (p.page, p.size, len(p.items), p.total, p.total_pages, p.has_next, p.has_previous)
    return spark.createDataFrame([row], "page bigint, size bigint, items bigint, total bigint, total_pages bigint, has_next boolean, has_previous boolean")


@query("SELECT 2::BIGINT AS page, 50::BIGINT AS size, least(50, count(*) - 50) AS items, count(*) AS total, ceil(count(*) / 50)::BIGINT AS total_pages, count(*) > 100 AS has_next, true AS has_previous FROM orders")
def offset_total_count(spark, d):
    return _page_facts(spark, d, QueryOptions(), 2)


@query("SELECT 1::BIGINT AS page, 50::BIGINT AS size, 50::BIGINT AS items, NULL::BIGINT AS total, NULL::BIGINT AS total_pages, count(*) > 50 AS has_next, false AS has_previous FROM orders")
def offset_has_next_probe(spark, d):
    return _page_facts(spark, d, QueryOptions(count=CountStrategy.HAS_NEXT_PROBE), 1)


@query("SELECT 1::BIGINT AS page, 50::BIGINT AS size, 50::BIGINT AS items, NULL::BIGINT AS total, NULL::BIGINT AS total_pages, NULL::BOOLEAN AS has_next, false AS has_previous")
def offset_none(spark, d):
    return _page_facts(spark, d, QueryOptions(count=CountStrategy.NONE), 1)


# keyset pages


def order_keys() -> keyset.KeysetDefinition:
    return keyset.KeysetBuilder(models()["orders"]).descending("o_orderdate").ascending("o_orderkey").build()


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page of orders, by the first page's cursor."""
    keys, orders = order_keys(), read(spark, sf_dir, "orders")
    first = keyset.keyset_page(orders, keys, 20)
    return numbered(keyset.page_frame(orders, keys, 20, keyset.KeysetCursor.parse(first.next)), list(keys.terms))


@query(_page_sql(0, 20))
def keyset_first(spark, d):
    keys = order_keys()
    return numbered(keyset.page_frame(read(spark, d, "orders"), keys, 20), list(keys.terms)).select("rn", "o_orderkey", "o_orderdate")


@query(_page_sql(20, 20))
def keyset_next(spark, d):
    return entry(spark, d).select("rn", "o_orderkey", "o_orderdate")


@query(_page_sql(20, 20))
def keyset_backward(spark, d):
    keys, orders = order_keys(), read(spark, d, "orders")
    page = keyset.keyset_page(orders, keys, 20)
    for _ in range(2):
        page = keyset.keyset_page(orders, keys, 20, page.next)
    back = keyset.page_frame(orders, keys, 20, keyset.KeysetCursor.parse(page.previous))
    return numbered(back, list(keys.terms)).select("rn", "o_orderkey", "o_orderdate")


@query("""SELECT row_number() OVER (ORDER BY l_shipdate, l_orderkey DESC, l_linenumber, l_partkey) AS rn, l_shipdate, l_orderkey, l_linenumber, l_partkey FROM lineitem
WHERE l_shipdate > '1995-06-01' OR (l_shipdate = '1995-06-01' AND (l_orderkey < 3000 OR (l_orderkey = 3000 AND l_linenumber > 1) OR (l_orderkey = 3000 AND l_linenumber = 1 AND l_partkey > 10)))
ORDER BY l_shipdate, l_orderkey DESC, l_linenumber, l_partkey LIMIT 30""")
def keyset_mixed(spark, d):
    keys = keyset.KeysetBuilder(models()["lineitem"]).ascending("l_shipdate").descending("l_orderkey").ascending("l_linenumber").ascending("l_partkey").allow_non_unique().build()
    keys.validate()
    cursor = keyset.KeysetCursor(keys.fingerprint, keyset.FORWARD, ("1995-06-01T00:00:00.000000", "3000", "1", "10"))
    page = keyset.page_frame(read(spark, d, "lineitem"), keys, 30, cursor)
    return numbered(page, list(keys.terms)).select("rn", "l_shipdate", "l_orderkey", "l_linenumber", "l_partkey")


@query("SELECT (row_number() OVER (ORDER BY s_acctbal DESC, s_suppkey) - 1) // 30 AS page, row_number() OVER (ORDER BY s_acctbal DESC, s_suppkey) AS rn, s_suppkey FROM supplier")
def keyset_full_walk(spark, d):
    model = models()["supplier"].but(required=frozenset({"s_acctbal"}))
    keys = keyset.KeysetBuilder(model).descending("s_acctbal").ascending("s_suppkey").build()
    keys.validate()
    rows, n = [], 0
    for i, page in enumerate(keyset.walk(read(spark, d, "supplier"), keys, 30)):
        for r in page.items:
            n += 1
            rows.append((i, n, r.s_suppkey))
    return spark.createDataFrame(rows, "page bigint, rn bigint, s_suppkey bigint")


#: One column of each type that a cursor carries, as an expression over orders.
_TYPED = {
    "int": ("int(o_custkey)", T.IntegerType()), "decimal": ("cast(o_totalprice AS decimal(18, 2))", T.DecimalType(18, 2)), "string": ("o_orderstatus", T.StringType()),
    "date": ("date(o_orderdate)", T.DateType()), "boolean": ("o_orderstatus = 'F'", T.BooleanType()), "binary": ("binary(concat(o_orderstatus, 'xy'))", T.BinaryType()),
}


def _typed_keys() -> dict[str, keyset.KeysetDefinition]:
    schema = T.StructType([T.StructField("o_orderkey", T.LongType()), *[T.StructField(f"{k}_", t) for k, (_, t) in _TYPED.items()]])
    model = TableModel("typed", schema, key=("o_orderkey",), required=frozenset(f"{k}_" for k in _TYPED))
    return {k: keyset.KeysetBuilder(model).ascending(f"{k}_").ascending("o_orderkey").build() for k in _TYPED}


@query(f"""SELECT o_orderkey, translate(rtrim(to_base64(encode('1|{order_keys().fingerprint}|f|' || strftime(o_orderdate, '%Y-%m-%dT%H%%3A%M%%3A%S.%f') || '|' || o_orderkey)), '='), '+/', '-_') AS token
FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 20""")
def keyset_tokens(spark, d):
    keys = order_keys()
    page = keyset.keyset_page(read(spark, d, "orders"), keys, 20)
    return spark.createDataFrame([(r.o_orderkey, keys.cursor(r).token()) for r in page.items], "o_orderkey bigint, token string")


@query("""SELECT o_orderkey, kind, translate(rtrim(to_base64(encode('1|' || print || '|f|' || value || '|' || o_orderkey)), '='), '+/', '-_') AS token FROM (
SELECT o_orderkey, unnest([{'kind': 'int', 'value': (o_custkey::INT)::VARCHAR}, {'kind': 'decimal', 'value': (o_totalprice::DECIMAL(18, 2))::VARCHAR}, {'kind': 'string', 'value': o_orderstatus}, {'kind': 'date', 'value': (o_orderdate::DATE)::VARCHAR},
{'kind': 'boolean', 'value': CASE WHEN o_orderstatus = 'F' THEN '1' ELSE '0' END}, {'kind': 'binary', 'value': to_base64(encode(o_orderstatus || 'xy'))}], recursive := true), FROM orders WHERE o_orderkey < 20) JOIN (VALUES PRINTS) p(kind2, print) ON kind = kind2""".replace("PRINTS", ", ".join(f"('{k}', '{x.fingerprint}')" for k, x in _typed_keys().items())))
def keyset_token_types(spark, d):
    rows = read(spark, d, "orders").where("o_orderkey < 20").selectExpr("o_orderkey", *[f"{e} AS {k}_" for k, (e, _) in _TYPED.items()]).collect()
    told = [(r.o_orderkey, k, keys.cursor(r).token()) for r in rows for k, keys in _typed_keys().items()]
    for k, keys in _typed_keys().items():  # each reads back as what it was made of
        for r in rows:
            assert keys.boundary(keyset.KeysetCursor.parse(keys.cursor(r).token())) == [r[f"{k}_"], r.o_orderkey]
    return spark.createDataFrame(told, "o_orderkey bigint, kind string, token string")


@query("SELECT (row_number() OVER (ORDER BY s_suppkey) - 1) // 40 AS batch, s_suppkey FROM supplier")
def stream_batches_by_key(spark, d):
    keys = keyset.KeysetBuilder(models()["supplier"]).ascending("s_suppkey").build()
    rows = [(i, r.s_suppkey) for i, batch in enumerate(stream_batches(read(spark, d, "supplier"), keys, 40)) for r in batch]
    return spark.createDataFrame(rows, "batch bigint, s_suppkey bigint")


@query("""SELECT * FROM (VALUES ('deep', 'DEEP_OFFSET'), ('deep', 'ENTITY_PROJECTION'), ('ties', 'NON_DETERMINISTIC_ORDER'), ('ties', 'MISSING_INDEX'), ('ties', 'ENTITY_PROJECTION'),
('join', 'COLLECTION_INCLUDE'), ('join', 'MISSING_INDEX'), ('join', 'ENTITY_PROJECTION'), ('list', 'LARGE_IN_CLAUSE'), ('keys', 'ENTITY_PROJECTION')) t(case_name, finding)""")
def advisor_findings(spark, d):
    options = QueryOptions(checks=Checks.ALL)
    advisor, orders = Advisor(models()["orders"], options), read(spark, d, "orders")
    lines = read(spark, d, "lineitem")
    by_key = orders.orderBy("o_orderkey")
    found = {
        "deep": advisor.offset(by_key, 60_000), "ties": advisor.offset(orders.orderBy("o_totalprice"), 0),
        "join": advisor.offset(orders.join(lines, orders.o_orderkey == lines.l_orderkey).where(F.col("o_orderpriority") == "1-URGENT").orderBy("o_orderkey"), 0),
        "list": advisor.in_list(5_000), "keys": advisor.keyset(orders, keyset.KeysetBuilder(models()["orders"]).ascending("o_orderdate").ascending("o_orderkey").build()),
    }
    return spark.createDataFrame([(k, f.check.name) for k, fs in found.items() for f in fs], "case_name string, finding string")


# bulk writes


def _customers(spark, d) -> DataFrame:
    return read(spark, d, "customer")


def _new_customers(spark, d) -> DataFrame:
    c = _customers(spark, d).where("c_acctbal > 9000")
    return c.select((F.col("c_custkey") + 1_000_000).alias("c_custkey"), F.concat("c_name", F.lit("-new")).alias("c_name"), "c_nationkey", "c_acctbal", "c_mktsegment")


@query("SELECT * FROM customer UNION ALL SELECT c_custkey + 1000000, c_name || '-new', c_nationkey, c_acctbal, c_mktsegment FROM customer WHERE c_acctbal > 9000")
def bulk_insert(spark, d):
    source = _new_customers(spark, d)
    return ch.insert(_customers(spark, d), source, plan_write(models()["customer"], Op.INSERT, source)).next


@query("SELECT (SELECT max(c_custkey) FROM customer) + row_number() OVER (ORDER BY c_name) AS c_custkey, c_name || '-copy' AS c_name FROM customer WHERE c_acctbal < 0")
def bulk_insert_generated_keys(spark, d):
    model = models()["customer"].but(generated={"c_custkey": "sequence"})
    source = _customers(spark, d).where("c_acctbal < 0").select(F.concat("c_name", F.lit("-copy")).alias("c_name"), "c_nationkey", "c_acctbal", "c_mktsegment")
    return ch.insert(_customers(spark, d), source, plan_write(model, Op.INSERT, source), ["c_name"]).inserted_rows.select("c_custkey", "c_name")


@query("SELECT c_custkey + 5000000 AS c_custkey, c_name, c_nationkey, NULL::DOUBLE AS c_acctbal, 'NONE' AS c_mktsegment FROM customer")
def bulk_insert_defaults(spark, d):
    model = models()["customer"].but(defaults={"c_mktsegment": "NONE", "c_acctbal": 1.0})
    source = _customers(spark, d).select((F.col("c_custkey") + 5_000_000).alias("c_custkey"), "c_name", "c_nationkey", F.lit(None).cast("double").alias("c_acctbal"))
    return ch.insert(_customers(spark, d), source, plan_write(model, Op.INSERT, source)).inserted_rows


def _raised(spark, d) -> DataFrame:
    return read(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select("o_orderkey", "o_custkey", "o_orderdate", (F.col("o_totalprice") * 2).alias("o_totalprice"), F.lit("X").alias("o_orderstatus"), F.lit("0-NOW").alias("o_orderpriority"))


def _update(spark, d, **call) -> DataFrame:
    source = _raised(spark, d)
    return ch.update(read(spark, d, "orders"), source, plan_write(models()["orders"], Op.UPDATE, source, Call(**call))).next


def _updated_sql(**new: str) -> str:
    cols = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]
    return "SELECT " + ", ".join(f"CASE WHEN o_orderpriority = '1-URGENT' THEN {new[c]} ELSE {c} END AS {c}" if c in new else c for c in cols) + " FROM orders"


@query(_updated_sql(o_totalprice="o_totalprice * 2", o_orderstatus="'X'", o_orderpriority="'0-NOW'"))
def bulk_update(spark, d):
    return _update(spark, d)


@query(_updated_sql(o_totalprice="o_totalprice * 2"))
def bulk_update_include(spark, d):
    return _update(spark, d, include=("o_totalprice",))


@query(_updated_sql(o_totalprice="o_totalprice * 2", o_orderstatus="'X'"))
def bulk_update_exclude(spark, d):
    return _update(spark, d, exclude=("o_orderpriority",))


@query("SELECT o_orderkey, o_custkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'U' WHEN '5-LOW' THEN 'L' ELSE o_orderstatus END AS o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders")
def bulk_update_match_on_many(spark, d):
    source = spark.createDataFrame([("1-URGENT", "U"), ("5-LOW", "L")], "o_orderpriority string, o_orderstatus string")
    plan = plan_write(models()["orders"], Op.UPDATE, source, Call(match_on=("o_orderpriority",)))
    return ch.update(read(spark, d, "orders"), source, plan).next


@query("SELECT * FROM orders WHERE o_totalprice >= 50000")
def bulk_delete(spark, d):
    source = read(spark, d, "orders").where("o_totalprice < 50000").select("o_orderkey")
    return ch.delete(read(spark, d, "orders"), source, plan_write(models()["orders"], Op.DELETE, source)).next


@query("SELECT * FROM lineitem WHERE NOT (l_returnflag = 'R' AND l_linestatus = 'F')")
def bulk_delete_match_on(spark, d):
    source = spark.createDataFrame([("R", "F")], "l_returnflag string, l_linestatus string")
    plan = plan_write(models()["lineitem"], Op.DELETE, source, Call(match_on=("l_returnflag", "l_linestatus")))
    return ch.delete(read(spark, d, "lineitem"), source, plan).next


def _merge_source(spark, d) -> DataFrame:
    o = read(spark, d, "orders").where("o_orderdate >= '1996-01-01'")
    old = o.withColumn("o_totalprice", F.col("o_totalprice") + 1).withColumn("o_orderpriority", F.lit("9-MERGED"))
    return old.unionAll(old.withColumn("o_orderkey", F.col("o_orderkey") + 10_000_000))


_MERGE_SOURCE = "s AS (SELECT o_orderkey + k AS o_orderkey, o_custkey, o_orderstatus, o_totalprice + 1 AS o_totalprice, o_orderdate, '9-MERGED' AS o_orderpriority FROM orders, (VALUES (0), (10000000)) v(k) WHERE o_orderdate >= '1996-01-01')"


def _merged(spark, d, **call) -> ch.ChangeSet:
    source = _merge_source(spark, d)
    return ch.merge(read(spark, d, "orders"), source, plan_write(models()["orders"], Op.MERGE, source, Call(**call)))


@query(f"WITH {_MERGE_SOURCE} SELECT coalesce(t.o_orderkey, s.o_orderkey) AS o_orderkey, coalesce(s.o_custkey, t.o_custkey) AS o_custkey, coalesce(s.o_orderstatus, t.o_orderstatus) AS o_orderstatus, coalesce(s.o_totalprice, t.o_totalprice) AS o_totalprice, coalesce(s.o_orderdate, t.o_orderdate) AS o_orderdate, coalesce(s.o_orderpriority, t.o_orderpriority) AS o_orderpriority FROM orders t FULL JOIN s ON t.o_orderkey = s.o_orderkey")
def bulk_merge(spark, d):
    return _merged(spark, d).next


@query(f"WITH {_MERGE_SOURCE} SELECT coalesce(t.o_orderkey, s.o_orderkey) AS o_orderkey, coalesce(s.o_custkey, t.o_custkey) AS o_custkey, coalesce(s.o_orderstatus, t.o_orderstatus) AS o_orderstatus, coalesce(s.o_totalprice, t.o_totalprice) AS o_totalprice, coalesce(s.o_orderdate, t.o_orderdate) AS o_orderdate, coalesce(t.o_orderpriority, s.o_orderpriority) AS o_orderpriority FROM orders t FULL JOIN s ON t.o_orderkey = s.o_orderkey")
def bulk_merge_insert_only(spark, d):
    return _merged(spark, d, insert_only=("o_orderpriority",)).next


@query(f"WITH {_MERGE_SOURCE} SELECT count(*) FILTER (t.o_orderkey IS NULL) AS inserted, count(*) FILTER (t.o_orderkey IS NOT NULL) AS updated, 0::BIGINT AS deleted, count(*) AS total FROM s LEFT JOIN orders t ON t.o_orderkey = s.o_orderkey")
def bulk_merge_counts(spark, d):
    r = _merged(spark, d).result
    return spark.createDataFrame([(r.inserted, r.updated, r.deleted, r.total)], "inserted bigint, updated bigint, deleted bigint, total bigint")


@query(f"WITH {_MERGE_SOURCE} SELECT CASE WHEN t.o_orderkey IS NULL THEN 'INSERT' ELSE 'UPDATE' END AS op, s.o_orderkey, t.o_totalprice AS was, s.o_totalprice AS now FROM s LEFT JOIN orders t ON t.o_orderkey = s.o_orderkey")
def bulk_merge_actions(spark, d):
    return _merged(spark, d).changes.select("op", F.col("new.o_orderkey").alias("o_orderkey"), F.col("old.o_totalprice").alias("was"), F.col("new.o_totalprice").alias("now"))


def _sync_source(spark, d) -> DataFrame:
    s = read(spark, d, "supplier").where("s_acctbal > 0")
    return s.withColumn("s_acctbal", F.col("s_acctbal") + 10).unionAll(s.where("s_nationkey < 5").withColumn("s_suppkey", F.col("s_suppkey") + 100_000))


_SYNC_SOURCE = "s AS (SELECT s_suppkey, s_name, s_nationkey, s_acctbal + 10 AS s_acctbal FROM supplier WHERE s_acctbal > 0 UNION ALL SELECT s_suppkey + 100000, s_name, s_nationkey, s_acctbal FROM supplier WHERE s_acctbal > 0 AND s_nationkey < 5)"


def _synchronized(spark, d, scope: fl.Scope | None = None) -> ch.ChangeSet:
    source = _sync_source(spark, d)
    ch.check_synchronize(models()["supplier"], source, scope, allow_full_table_delete=scope is None)
    return ch.merge(read(spark, d, "supplier"), source, plan_write(models()["supplier"], Op.SYNCHRONIZE, source, Call(scope=scope)), scope)


@query(f"WITH {_SYNC_SOURCE} SELECT * FROM s")
def bulk_synchronize(spark, d):
    return _synchronized(spark, d).next


@query(f"WITH {_SYNC_SOURCE} SELECT * FROM s UNION ALL SELECT * FROM supplier WHERE s_suppkey NOT IN (SELECT s_suppkey FROM s) AND NOT (s_nationkey >= 10 AND s_nationkey < 15)")
def bulk_synchronize_scoped(spark, d):
    return _synchronized(spark, d, fl.Scope.where("s_nationkey", ">=", 10) & fl.Scope.where("s_nationkey", "<", 15)).next


@query(f"WITH {_SYNC_SOURCE} SELECT * FROM s UNION ALL SELECT * FROM supplier WHERE s_suppkey NOT IN (SELECT s_suppkey FROM s) AND NOT (s_nationkey < 12 AND s_name <> 't.s_name '':a'' :most')")
def bulk_synchronize_sql_scope(spark, d):
    """Values are bound: one holds what looks like the target's alias, a marker and quotes, one marker begins another."""
    scope = fl.Scope.sql("t.s_nationkey < :a AND t.s_name <> :ab AND t.s_name <> ':a'", a=12, ab="t.s_name ':a' :most")
    return _synchronized(spark, d, scope).next


@query(f"WITH {_SYNC_SOURCE} SELECT * FROM supplier WHERE s_suppkey NOT IN (SELECT s_suppkey FROM s)")
def bulk_synchronize_removed_rows(spark, d):
    return ch.removed_rows(_synchronized(spark, d).changes)


@query("SELECT o_orderkey AS old_o_orderkey, o_custkey AS old_o_custkey, o_orderstatus AS old_o_orderstatus, o_totalprice AS old_o_totalprice, o_orderdate AS old_o_orderdate, o_orderpriority AS old_o_orderpriority FROM orders WHERE o_orderpriority = '1-URGENT'")
def bulk_before_images(spark, d):
    source = _raised(spark, d)
    return ch.before_images(read(spark, d, "orders"), source, plan_write(models()["orders"], Op.UPDATE, source))


@query("SELECT * FROM (VALUES (0::BIGINT, 'region'), (1, 'nation'), (2, 'customer'), (3, 'orders')) t(place, table_name)")
def bulk_graph_order(spark, d):
    found = graph.table_order([models()[n] for n in ("orders", "nation", "customer", "region")])
    return spark.createDataFrame([(i, m.name) for i, m in enumerate(found)], "place bigint, table_name string")


@query("SELECT o_orderkey, c_custkey + 700 AS o_custkey FROM orders JOIN customer ON o_custkey = c_custkey")
def bulk_graph_fk_fixup(spark, d):
    parents = _customers(spark, d).select(F.col("c_custkey").alias("temp"), (F.col("c_custkey") + 700).alias("c_custkey"))
    children = read(spark, d, "orders").select("o_orderkey", "o_custkey", F.col("o_custkey").alias("parent_temp"))
    return graph.with_parent_keys(children, parents, "parent_temp", "temp", "c_custkey", "o_custkey").select("o_orderkey", "o_custkey")


@query("SELECT c_custkey, CASE WHEN c_custkey < 2 THEN 0 ELSE floor(log2(c_custkey)) END::BIGINT AS depth FROM customer")
def bulk_graph_self_reference_depth(spark, d):
    tree = _customers(spark, d).select("c_custkey", F.when(F.col("c_custkey") > 1, F.floor(F.col("c_custkey") / 2)).alias("parent"))
    return graph.with_depth(tree, "c_custkey", "parent").select("c_custkey", F.col("depth").cast("bigint").alias("depth"))


@query("""WITH c AS (SELECT event_id AS seq, 'events' AS "table", CASE event_type WHEN 'click' THEN 'Added' WHEN 'view' THEN 'Modified' ELSE 'Deleted' END AS state, CASE WHEN user_id < 50 THEN 'ts,value' ELSE 'value,ts' END || '||event_id' AS shape FROM events)
SELECT "table", state, shape, count(*) AS n, min(seq) AS first_seq, CASE WHEN count(*) < 100 THEN 'below threshold' END AS reason FROM c GROUP BY ALL""")
def partition_by_shape(spark, d):
    two = F.when(F.col("user_id") < 50, F.array(F.lit("ts"), F.lit("value"))).otherwise(F.array(F.lit("value"), F.lit("ts")))
    state = F.when(F.col("event_type") == "click", "Added").when(F.col("event_type") == "view", "Modified").otherwise("Deleted")
    changes = read(spark, d, "events").select(
        F.col("event_id").alias("seq"), F.lit("events").alias("table"), state.alias("state"), two.alias("write"), F.array().cast("array<string>").alias("read"), F.array(F.lit("event_id")).alias("condition"),
        F.lit(False).alias("procedure"), F.lit(False).alias("json_path"),
    )
    return with_eligibility(by_shape(changes), WriteOptions()).select("table", "state", "shape", "n", "first_seq", "reason")


@query("""WITH c AS (SELECT o_orderkey + CASE WHEN o_orderkey <= 10 THEN 90000000 ELSE 0 END AS o_orderkey, o_totalprice + CASE WHEN o_orderstatus = 'P' THEN 5 ELSE 0 END AS o_totalprice FROM orders WHERE o_orderpriority <> '5-LOW')
SELECT CASE WHEN o.o_orderkey IS NULL THEN 'INSERT' WHEN c.o_orderkey IS NULL THEN 'DELETE' ELSE 'UPDATE' END AS op, coalesce(o.o_orderkey, c.o_orderkey) AS o_orderkey, o.o_totalprice AS was, c.o_totalprice AS now
FROM orders o FULL JOIN c ON o.o_orderkey = c.o_orderkey WHERE o.o_orderkey IS NULL OR c.o_orderkey IS NULL OR o.o_totalprice IS DISTINCT FROM c.o_totalprice""")
def save_changes_diff(spark, d):
    orders = read(spark, d, "orders")
    now = orders.where("o_orderpriority <> '5-LOW'").withColumn("o_orderkey", F.when(F.col("o_orderkey") <= 10, F.col("o_orderkey") + 90_000_000).otherwise(F.col("o_orderkey")))
    now = now.withColumn("o_totalprice", F.when(F.col("o_orderstatus") == "P", F.col("o_totalprice") + 5).otherwise(F.col("o_totalprice")))
    diff = difference(orders, now, models()["orders"])
    return diff.select("op", F.coalesce("old.o_orderkey", "new.o_orderkey").alias("o_orderkey"), F.col("old.o_totalprice").alias("was"), F.col("new.o_totalprice").alias("now"))


# audit

_AUDIT = AuditOptions(clock=lambda: dt.datetime(2024, 1, 2, 3, 4, 5), tenant_column=None)
_J = {c: f"coalesce(to_json({c})::VARCHAR, 'null')" for c in ("c_acctbal", "c_custkey", "c_mktsegment", "c_name", "c_nationkey")}


def _object(columns: dict[str, str]) -> str:
    return "'{' || " + " || ',' || ".join(f"'\"{c}\":' || {v}" for c, v in columns.items()) + " || '}'"


_KEY = "'\"key\":{\"c_custkey\":' || c_custkey || '}'"


def _told(plan_spec: AuditSpec, changes: DataFrame, source: str, options: AuditOptions = _AUDIT, scope: AuditScope | None = None, table: str = "customer", before: bool = True) -> DataFrame:
    plan = plan_audit(models()[table], plan_spec, options)
    return entries(plan, changes, source, options, before, scope or AuditScope(correlation_id="c"))


def _shown(told: DataFrame) -> DataFrame:
    return told.select("entity_type", "entity_key", "operation", "source", "changes")


def _changed_customers(spark, d) -> ch.ChangeSet:
    source = _customers(spark, d).where("c_nationkey < 10").withColumn("c_acctbal", F.col("c_acctbal") + 1).withColumn("c_mktsegment", F.when(F.col("c_custkey") % 2 == 0, F.lit("EVEN \"é\"")).otherwise(F.col("c_mktsegment")))
    return ch.update(_customers(spark, d), source, plan_write(models()["customer"], Op.UPDATE, source))


_INSERTED = f"'{{\"op\":\"insert\",' || {_KEY} || ',\"new\":' || {_object(_J)} || '}}'"


@query(f"SELECT 'customer' AS entity_type, c_custkey::VARCHAR AS entity_key, 1 AS operation, 'Bulk.Insert' AS source, {_INSERTED} AS changes FROM (SELECT c_custkey + 1000000 AS c_custkey, c_name || '-new' AS c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer WHERE c_acctbal > 9000)")
def audit_insert(spark, d):
    source = _new_customers(spark, d)
    change = ch.insert(_customers(spark, d), source, plan_write(models()["customer"], Op.INSERT, source))
    return _shown(_told(AuditSpec(), change.changes, "Bulk.Insert"))


_EVEN = "c_custkey % 2 = 0 AND c_mktsegment IS DISTINCT FROM 'EVEN \"é\"'"
_UPDATED = (
    f"'{{\"op\":\"update\",' || {_KEY} || ',\"changed\":[\"c_acctbal\"' || CASE WHEN {_EVEN} THEN ',\"c_mktsegment\"' ELSE '' END || '],\"old\":{{\"c_acctbal\":' || {_J['c_acctbal']} || CASE WHEN {_EVEN} THEN ',\"c_mktsegment\":' || {_J['c_mktsegment']} ELSE '' END"
    f" || '}},\"new\":{{\"c_acctbal\":' || to_json(c_acctbal + 1)::VARCHAR || CASE WHEN {_EVEN} THEN ',\"c_mktsegment\":' || to_json('EVEN \"é\"')::VARCHAR ELSE '' END || '}}}}'"
)
_UPDATE_ROWS = f"SELECT 'customer' AS entity_type, c_custkey::VARCHAR AS entity_key, 2 AS operation, 'Bulk.Update' AS source, {_UPDATED} AS changes FROM customer WHERE c_nationkey < 10"


@query(_UPDATE_ROWS)
def audit_update(spark, d):
    return _shown(_told(AuditSpec(), _changed_customers(spark, d).changes, "Bulk.Update"))


@query(f"SELECT 'customer' AS entity_type, c_custkey::VARCHAR AS entity_key, 3 AS operation, 'Bulk.Delete' AS source, '{{\"op\":\"delete\",' || {_KEY} || ',\"old\":' || {_object(_J)} || '}}' AS changes FROM customer WHERE c_acctbal < 0")
def audit_delete(spark, d):
    source = _customers(spark, d).where("c_acctbal < 0").select("c_custkey")
    change = ch.delete(_customers(spark, d), source, plan_write(models()["customer"], Op.DELETE, source))
    return _shown(_told(AuditSpec(), change.changes, "Bulk.Delete"))


def _merged_customers(spark, d, op: Op) -> ch.ChangeSet:
    c = _customers(spark, d)
    source = c.where("c_nationkey < 5").withColumn("c_acctbal", F.col("c_acctbal") + 1).unionByName(_new_customers(spark, d))
    return ch.merge(c, source, plan_write(models()["customer"], op, source))


_PLAIN = f"'{{\"op\":\"update\",' || {_KEY} || ',\"changed\":[\"c_acctbal\"],\"old\":{{\"c_acctbal\":' || {_J['c_acctbal']} || '}},\"new\":{{\"c_acctbal\":' || to_json(c_acctbal + 1)::VARCHAR || '}}}}'"
_MERGED = f"""SELECT 'customer' AS entity_type, c_custkey::VARCHAR AS entity_key, 2 AS operation, 'SOURCE' AS source, {_PLAIN} AS changes FROM customer WHERE c_nationkey < 5
UNION ALL SELECT 'customer', c_custkey::VARCHAR, 1, 'SOURCE', {_INSERTED} FROM (SELECT c_custkey + 1000000 AS c_custkey, c_name || '-new' AS c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer WHERE c_acctbal > 9000)"""


@query(_MERGED.replace("SOURCE", "Bulk.Merge"))
def audit_merge(spark, d):
    return _shown(_told(AuditSpec(), _merged_customers(spark, d, Op.MERGE).changes, "Bulk.Merge"))


@query(_MERGED.replace("SOURCE", "Bulk.Synchronize") + f" UNION ALL SELECT 'customer', c_custkey::VARCHAR, 3, 'Bulk.Synchronize', '{{\"op\":\"delete\",' || {_KEY} || ',\"old\":' || {_object(_J)} || '}}' FROM customer WHERE c_nationkey >= 5")
def audit_synchronize(spark, d):
    return _shown(_told(AuditSpec(), _merged_customers(spark, d, Op.SYNCHRONIZE).changes, "Bulk.Synchronize"))


_MASKED = {**_J, "c_acctbal": "'\"***\"'", "c_name": "'\"' || upper(substr(c_name, 1, 4)) || '\"'"}


@query(f"SELECT c_custkey::VARCHAR AS entity_key, '{{\"op\":\"delete\",' || {_KEY} || ',\"old\":' || {_object(_MASKED)} || '}}' AS changes FROM customer WHERE c_acctbal < 0")
def audit_mask(spark, d):
    source = _customers(spark, d).where("c_acctbal < 0").select("c_custkey")
    change = ch.delete(_customers(spark, d), source, plan_write(models()["customer"], Op.DELETE, source))
    spec = AuditSpec(mask={"c_acctbal": None, "c_name": lambda c: F.upper(F.substring(c, 1, 4))})
    return _told(spec, change.changes, "Bulk.Delete").select("entity_key", "changes")


@query(f"SELECT c_custkey::VARCHAR AS entity_key, '{{\"op\":\"delete\",' || {_KEY} || ',\"old\":' || {_object({c: v for c, v in _J.items() if c not in ('c_name', 'c_acctbal')})} || '}}' AS changes FROM customer WHERE c_acctbal < 0")
def audit_exclude(spark, d):
    source = _customers(spark, d).where("c_acctbal < 0").select("c_custkey")
    change = ch.delete(_customers(spark, d), source, plan_write(models()["customer"], Op.DELETE, source))
    return _told(AuditSpec(exclude=frozenset({"c_name", "c_acctbal"})), change.changes, "Bulk.Delete").select("entity_key", "changes")


@query("""SELECT doc_id::VARCHAR AS entity_key, '{"op":"insert","key":{"doc_id":' || doc_id || '},"new":{"doc_id":' || doc_id || ',"lang":' || to_json(lang) || ',"n_chars":' || n_chars || ',"source":' || to_json(source) || ',"text":' || to_json(substr(regexp_replace(text, '[^a-z ]', '', 'g'), 1, 64)) || '}'
|| CASE WHEN length(regexp_replace(text, '[^a-z ]', '', 'g')) > 64 THEN ',"__truncated":true' ELSE '' END || '}' AS changes FROM documents""")
def audit_truncate(spark, d):
    docs = read(spark, d, "documents").withColumn("text", F.regexp_replace("text", "[^a-z ]", ""))
    options = AuditOptions(clock=_AUDIT.clock, tenant_column=None, max_value_length=64)
    change = ch.insert(docs.limit(0), docs, plan_write(models()["documents"], Op.INSERT, docs))
    return _told(AuditSpec(), change.changes, "Bulk.Insert", options, table="documents").select("entity_key", "changes")


@query(f"SELECT c_custkey::VARCHAR AS entity_key, '{{\"op\":\"update\",' || {_KEY} || ',\"partial\":true,\"new\":' || {_object({**_J, 'c_acctbal': 'to_json(c_acctbal + 1)::VARCHAR'})} || '}}' AS changes FROM customer WHERE c_nationkey < 5")
def audit_partial(spark, d):
    source = _customers(spark, d).where("c_nationkey < 5").withColumn("c_acctbal", F.col("c_acctbal") + 1)
    change = ch.update(_customers(spark, d), source, plan_write(models()["customer"], Op.UPDATE, source))
    return _told(AuditSpec(), change.changes, "Bulk.Update", before=False).select("entity_key", "changes")


@query("SELECT count(*) AS n, '{\"reason\":\"audit \\\"q\\\"\",\"batch\":\"7\",\"zone\":\"é\"}' AS meta FROM customer WHERE c_nationkey < 10")
def audit_meta(spark, d):
    scope = AuditScope(reason='audit "q"', metadata={"zone": "é", "batch": "7"}, correlation_id="c")
    told = _told(AuditSpec(), _changed_customers(spark, d).changes, "Bulk.Update", scope=scope)
    return told.select(F.get_json_object("changes", "$.meta").alias("meta")).groupBy("meta").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT c_custkey, CASE WHEN x = '-0' THEN '0' ELSE x END AS digits FROM (SELECT c_custkey, regexp_replace(round(c_acctbal / 10, 1)::DECIMAL(18, 4)::VARCHAR, '\\.?0+$', '') AS x FROM customer)")
def audit_decimal_canonical(spark, d):
    return _customers(spark, d).select("c_custkey", decimal_text(F.round(F.col("c_acctbal") / 10, 1).cast("decimal(18,4)")).alias("digits"))


@query("SELECT l_orderkey, l_linenumber, replace(replace(l_returnflag || '\\' || l_linestatus || '|', '\\', '\\\\'), '|', '\\|') || '|' || l_orderkey AS entity_key FROM lineitem")
def audit_entity_key(spark, d):
    odd = F.concat("l_returnflag", F.lit("\\"), "l_linestatus", F.lit("|"))
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", key_text([(odd, T.StringType()), (F.col("l_orderkey"), T.LongType())]).alias("entity_key"))


@query("SELECT c_mktsegment AS tenant_id, 'u1' AS actor_id, 'Ann' AS actor_name, 'User' AS actor_type, TIMESTAMP '2024-01-02 03:04:05' AS occurred_at, count(*) AS n FROM customer WHERE c_acctbal < 0 GROUP BY ALL")
def audit_tenant_and_actor(spark, d):
    source = _customers(spark, d).where("c_acctbal < 0").select("c_custkey")
    change = ch.delete(_customers(spark, d), source, plan_write(models()["customer"], Op.DELETE, source))
    scope = AuditScope(actor=Actor("u1", "Ann", "User"), tenant_id="outer", correlation_id="c")
    told = _told(AuditSpec(tenant_column="c_mktsegment"), change.changes, "Bulk.Delete", scope=scope)
    return told.groupBy("tenant_id", "actor_id", "actor_name", "actor_type", "occurred_at").agg(F.count(F.lit(1)).alias("n"))


def _trail(spark, d) -> DataFrame:
    return _told(AuditSpec(), _changed_customers(spark, d).changes, "Bulk.Update")


@query(f"SELECT entity_key, changes FROM ({_UPDATE_ROWS}) WHERE entity_key = (SELECT min(c_custkey)::VARCHAR FROM customer WHERE c_nationkey < 10)")
def audit_history(spark, d):
    first = _customers(spark, d).where("c_nationkey < 10").agg(F.min("c_custkey")).first()[0]
    return trail_search.history(_trail(spark, d), "customer", str(first)).select("entity_key", "changes")


@query(f"SELECT entity_key FROM ({_UPDATE_ROWS}) WHERE json_extract_string(changes, '$.new.c_mktsegment') = 'EVEN \"é\"' AND json_extract_string(changes, '$.op') = 'update'")
def audit_containment(spark, d):
    return trail_search.having(_trail(spark, d), {"op": "update", "new": {"c_mktsegment": 'EVEN "é"'}}).select("entity_key")


@query(f"SELECT entity_key FROM ({_UPDATE_ROWS}) WHERE list_contains(from_json(json_extract(changes, '$.changed'), '[\"VARCHAR\"]'), 'c_mktsegment')")
def audit_changed_contains(spark, d):
    return trail_search.changing(_trail(spark, d), "c_mktsegment").select("entity_key")


@query(f"SELECT entity_key, json_extract_string(changes, '$.old.c_mktsegment') AS was FROM ({_UPDATE_ROWS})")
def audit_json_path(spark, d):
    return trail_search.path_value(_trail(spark, d), "$.old.c_mktsegment", "was").select("entity_key", "was")
