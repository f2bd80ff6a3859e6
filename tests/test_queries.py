"""Registered queries against their SQL on the smallest data."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
SOME = (
    "key_child", "key_region", "key_decode", "vec_arith", "geo_dist_approx", "evec_wrap", "tree_partition", "tree_py", "tree_exchange", "tree_local_roots", "part_bisection", "win_exclusive_scan", "join_direct", "join_dtt", "agg_bh_com",
    "agg_p2p", "agg_ewald_real", "agg_vdw", "join_exclusion", "src_plummer", "sink_write_sources", "join_let_anti", "join_uniform_m2l",
    "fmm", "agg_m2p", "agg_verify_fmm", "sph_eval_multipole", "sph_eval_multipole_theta", "sph_eval_local", "sph_far", "agg_periodic_m2l", "agg_normalize", "agg_load_balance", "exch_upstream", "exch_alltoallv2", "sink_report",
    "sink_debug_dump", "sink_vtk", "tree_gpu", "tree_lookup", "map_py", "map_pair_overloads", "join_product_mutual", "flt_mac_bh", "flt_mac_fmm", "agg_bh_force_walked", "win_scan_operators",
)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    return con


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    tidy = lambda v: round(float(v), 6) if isinstance(v, float) else v
    return sorted((tuple(tidy(r[i]) for i in order) for r in data), key=str)


@pytest.mark.parametrize("name", SOME)
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, DATA)
    want = duck.sql(entry.oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows(df.columns, df.collect()) == rows(want.columns, want.fetchall())


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
