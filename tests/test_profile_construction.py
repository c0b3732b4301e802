import duckdb
from oracle import SF, plain, rows_of

from corvata.plans.queries import SQL, profile_construction


def test_profiles_of_all_suppliers(spark):
    """Against the registered SQL without its filter on suppliers."""
    con = duckdb.connect()
    con.sql(f"create view lineitem as from '{SF}/lineitem.parquet'")
    want = con.sql(SQL["profile_construction"].replace(" WHERE l_suppkey % 5 = 0", "")).select("profile_key, role, centre, tolerance").fetchall()
    got = profile_construction(spark, SF).select("profile_key", "role", "centre", "tolerance").collect()
    assert rows_of(got) == rows_of(want)
    assert any(plain(r[0]) % 5 for r in want)
