"""The anti-join reads every order, whatever its date."""

import duckdb

from mizan.plans import search_queries


def test_orders_of_every_year_count(spark, tmp_path):
    con = duckdb.connect()
    con.execute(f"COPY (SELECT * FROM (VALUES (1, 'A'), (2, 'A'), (3, 'B')) v(c_custkey, c_mktsegment)) TO '{tmp_path}/customer.parquet' (FORMAT parquet)")
    con.execute(f"COPY (SELECT * FROM (VALUES (1, TIMESTAMP '1993-05-01'), (2, TIMESTAMP '1997-05-01')) v(o_custkey, o_orderdate)) TO '{tmp_path}/orders.parquet' (FORMAT parquet)")
    run, sql = search_queries.QUERIES["join14_anti"]
    assert [tuple(r) for r in run(spark, str(tmp_path)).collect()] == [("B", 1)]
    for t in ("customer", "orders"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet')")
    assert con.execute(sql).fetchall() == [("B", 1)]
