"""Queries against their SQL on small tables that hold what only larger or odder ones do."""

import duckdb

from caseloom.plans import catalogue

from .test_queries import rows


def both(spark, folder, name, **tables):
    """Rows of a query and of its SQL over tables given as SQL."""
    con = duckdb.connect()
    for t, sql in tables.items():
        con.sql(f"copy ({sql}) to '{folder}/{t}.parquet'")
        con.sql(f"create view {t} as select * from read_parquet('{folder}/{t}.parquet')")
    return rows(catalogue.queries()[name](spark, str(folder)).toPandas()), rows(con.sql(catalogue.oracle_sql()[name]).df())


EVENTS = "select event_id::bigint as event_id, timestamp '2024-01-01' + interval (second) second as ts, user_id::bigint as user_id, event_type, value::double as value, props from (values {}) as t(event_id, second, user_id, event_type, value, props)"


def test_operations_of_no_time(spark, tmp_path):
    events = [(1, 0, 0, "view", 0, 5), (2, 1, 0, "error", 0, 3), (3, 2, 1, "view", 0, 0), (4, 3, 1, "error", 2, 1), (5, 4, 2, "view", 4, 8), (6, 5, 2, "error", 2, 1), (7, 6, 3, "view", 3, 1)]
    got, want = both(spark, tmp_path, "ops_comparison", events=EVENTS.format(", ".join(f"({a}, {b}, {c}, '{e}', {v}, '{{\"k\": {k}}}')" for a, b, c, e, v, k in events)))
    assert len(got) == 4 and got == want


def test_normal_forms_beyond_ascii(spark, tmp_path):
    texts = ["the éco rr", "the ecoé", "the co é", "the diſtrict x", "the v.\x0bx", "the v. é", "the v. ſ", "a''sé b", "İstanbul ΑΣ inc.", " the big　", "of éU.S.é", "the  big  ", "", " "]
    values = ", ".join(f"({n}, '{t}')" for n, t in enumerate(texts))
    got, want = both(spark, tmp_path, "text_normal", documents=f"select doc_id::bigint as doc_id, text from (values {values}) as t(doc_id, text)")
    assert len(got) == len(texts) and got == want


def many_events(users, copies, n):
    """So many copies of n events a user, no two copies side by side."""
    return f"select (c * {users * n} + u * {n} + e)::bigint as event_id, timestamp '2024-01-01' + interval (e * 3000 + u) second as ts, u::bigint as user_id, ['signup', 'view', 'purchase', 'error'][(e * 7 + u) % 4 + 1] as event_type, e::double as value, '{{\"k\": 1}}' as props from range({users}) a(u), range({copies}) b(c), range({n}) d(e) order by hash(event_id)"


def test_pairs_of_more_rows_than_a_frame(spark, tmp_path):
    got, want = both(spark, tmp_path, "stream_pairs", events=many_events(5, 600, 20))
    assert len(got) == 5 and got == want


def test_pairs_over_files_in_no_order_of_time(spark, tmp_path):
    con = duckdb.connect()
    con.sql(f"create table events as {many_events(5, 1, 200)}")
    (tmp_path / "events.parquet").mkdir()
    for n in range(8):  # the latest first
        con.sql(f"copy (from events where value::int // 25 = {7 - n}) to '{tmp_path}/events.parquet/part-{n}.parquet'")
    got = rows(catalogue.queries()["stream_pairs"](spark, str(tmp_path)).toPandas())
    assert got == rows(con.sql(catalogue.oracle_sql()["stream_pairs"]).df())


def test_sessions_stay_in_files(spark, tmp_path):
    con = duckdb.connect()
    con.sql(f"copy ({many_events(7, 3, 60)}) to '{tmp_path}/events.parquet'")
    got = catalogue.queries()["stream_sessions"](spark, str(tmp_path))
    assert got.inputFiles()  # the driver holds none of them
    con.sql(f"create view events as select * from read_parquet('{tmp_path}/events.parquet')")
    assert rows(got.toPandas()) == rows(con.sql(catalogue.oracle_sql()["stream_sessions"]).df())


def test_pattern_files_hold_many_parts(spark, tmp_path):
    con = duckdb.connect()
    con.sql(f"copy (select (n * 200)::bigint as p_partkey, 'hot \"bolt\" ' || n as p_name, 'Brand#' || n % 2 as p_brand, 'LARGE' as p_type, (n % 50)::int as p_size from range(200) t(n)) to '{tmp_path}/part.parquet'")
    got = catalogue.queries()["pattern_files"](spark, str(tmp_path))
    assert len(got.inputFiles()) == 4
    con.sql(f"create view part as select * from read_parquet('{tmp_path}/part.parquet')")
    assert rows(got.toPandas()) == rows(con.sql(catalogue.oracle_sql()["pattern_files"]).df())


def test_the_last_written_of_equal_versions_stays(spark, tmp_path):
    duckdb.connect().sql(f"copy (select n::bigint as c_custkey, n::double as c_acctbal from range(0, 100200) t(n)) to '{tmp_path}/customer.parquet'")
    got = {r.id: (r.version, r.value) for r in catalogue.queries()["store_upsert"](spark, str(tmp_path)).filter("id >= 100000 and id < 100200").collect()}
    want = {k: (2, k - 100000.0) if k % 5 == 0 else (2, k + 1.0) if k % 3 == 0 else (1, float(k)) for k in range(100000, 100200)}
    assert got == want
