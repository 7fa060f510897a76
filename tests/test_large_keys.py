"""Ledger ids of large tables, which a bigint cannot hold."""

from datetime import datetime, timedelta

import pytest

from oddsmith.functions.columns import with_ranges
from oddsmith.plans import all_queries

LINE = """l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double,
l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz"""


def lines(shift):
    at = datetime(1995, 1, 1)
    return [(o + shift, o % 40, o % 9, n, float(o % 50), 1.0, (o % 11) / 100, (o % 9) / 100, "ARN"[o * n % 3], "FO"[o % 2], at + timedelta(days=o % 300)) for o in range(300) for n in (3, 4)]


@pytest.mark.parametrize("key", ["h06_replay_comparison", "h02_binary_gate"])
def test_results_do_not_depend_on_the_size_of_keys(spark, tmp_path, key):
    got = []
    for shift in (0, 54_000_000):
        folder = str(tmp_path / str(shift))
        spark.createDataFrame(lines(shift), LINE).write.parquet(f"{folder}/lineitem.parquet")
        got.append(sorted(map(str, all_queries()[key](spark, folder).collect())))
    assert got[0] and got[0] == got[1]


def test_ranges_of_decimals_beyond_a_bigint(spark):
    df = spark.range(1000).selectExpr("cast(id as decimal(21, 0)) * 100000000000000000 AS v").selectExpr("cast(v as decimal(21, 0)) AS v")
    got = [r._b for r in with_ranges(df, "v", "_b", 100).orderBy("v").collect()]
    assert got == sorted(got) and len(set(got)) == 10
