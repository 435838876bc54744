"""Models of the driver's tables."""

from __future__ import annotations

from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .model import ForeignKey, TableModel

L, I, S, D, N = T.LongType(), T.IntegerType(), T.StringType(), T.DoubleType(), T.TimestampNTZType()


def _schema(**kinds: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, k) for n, k in kinds.items()])


@cache
def models() -> dict[str, TableModel]:
    found = [
        TableModel("region", _schema(r_regionkey=I, r_name=S), key=("r_regionkey",)),
        TableModel("nation", _schema(n_nationkey=I, n_name=S, n_regionkey=I), key=("n_nationkey",), references=(ForeignKey(("n_regionkey",), "region", ("r_regionkey",)),)),
        TableModel("customer", _schema(c_custkey=L, c_name=S, c_nationkey=I, c_acctbal=D, c_mktsegment=S), key=("c_custkey",), uniques=(("c_name",),), references=(ForeignKey(("c_nationkey",), "nation", ("n_nationkey",)),)),
        TableModel("supplier", _schema(s_suppkey=L, s_name=S, s_nationkey=I, s_acctbal=D), key=("s_suppkey",), references=(ForeignKey(("s_nationkey",), "nation", ("n_nationkey",)),)),
        TableModel("part", _schema(p_partkey=L, p_name=S, p_brand=S, p_type=S, p_size=I, p_retailprice=D), key=("p_partkey",)),
        TableModel("orders", _schema(o_orderkey=L, o_custkey=L, o_orderstatus=S, o_totalprice=D, o_orderdate=N, o_orderpriority=S), key=("o_orderkey",), required=frozenset({"o_orderdate", "o_totalprice"}), layout=(("o_orderdate", "o_orderkey"),), references=(ForeignKey(("o_custkey",), "customer", ("c_custkey",)),), filters={"open": "o_orderstatus <> 'F'"}),
        TableModel("lineitem", _schema(l_orderkey=L, l_partkey=L, l_suppkey=L, l_linenumber=I, l_quantity=D, l_extendedprice=D, l_discount=D, l_tax=D, l_returnflag=S, l_linestatus=S, l_shipdate=N), required=frozenset({"l_orderkey", "l_linenumber", "l_shipdate", "l_partkey"})),
        TableModel("events", _schema(event_id=L, ts=N, user_id=L, event_type=S, value=D, props=S), key=("event_id",)),
        TableModel("documents", _schema(doc_id=L, text=S, lang=S, source=S, n_chars=L), key=("doc_id",)),
        TableModel("labels", _schema(doc_id=L, quality=I, toxic=I), key=("doc_id",)),
    ]
    return {m.name: m for m in found}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
