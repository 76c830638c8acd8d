import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from cairnlake import session

    s = session.build(4, **{"spark.sql.shuffle.partitions": "4", "spark.default.parallelism": "4"})
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture(scope="session")
def data():
    return DATA


@pytest.fixture(scope="session")
def same_as_sql(spark):
    """Compares a query with its SQL on the small tables."""
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in sorted(os.listdir(DATA)):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{DATA}/{f}')")

    def plain(x):
        if isinstance(x, float):
            return "nan" if x != x else round(x, 9) + 0.0
        return tuple(map(plain, x)) if isinstance(x, (list, tuple)) else x

    def check(query, sql):
        df = query(spark, DATA)
        got = df.collect()
        r = con.execute(sql)
        names = [c[0] for c in r.description]
        assert sorted(names) == sorted(df.columns)
        at = [names.index(c) for c in df.columns]
        want = [tuple(plain(row[i]) for i in at) for row in r.fetchall()]
        assert sorted((tuple(map(plain, x)) for x in got), key=repr) == sorted(want, key=repr)

    return check
