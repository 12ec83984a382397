"""Text queries against their SQL in DuckDB, on the smallest tables and where several tokens make a url rule."""

import glob
import os
import random

import duckdb
import pytest

from tideline.llm import urls
from tideline.llm.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f if os.path.isfile(f) else f + '/*.parquet'}'")
    return c


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(v[i] for i in order) for v in values), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_its_sql(spark, duck, name):
    df, want = QUERIES[name](spark, SF), duck.sql(ORACLE[name])
    assert rows(df.columns, df.collect()) == rows(want.columns, want.fetchall())


def test_mined_url_rules_equal_their_sql(spark, tmp_path):
    rng = random.Random(7)
    pages, labels = [], []
    for k in range(900):
        h, p, q = rng.choice(["a.x.org", "b.x.org", "shop.y.org", "m.y.org"]), rng.choice(["buy", "read"]), rng.choice(["ref", "page", ""])
        pages.append((k, f"https://{h}/{p}/{k}" + (f"?{q}=2" if q else "")))
        labels.append((k, 0 if (h.endswith("y.org") and p == "buy") or (h == "a.x.org" and q == "ref" and p == "read") else 1, 1 if rng.random() < 0.02 else 0))
    pages += [(None, None), (1000, "ftp://m.y.org/buy"), (1001, "http://net/es/a"), (1002, "nothing")]
    spark.createDataFrame(pages, "page_id long, url string").write.parquet(f"file://{tmp_path}/pages.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"file://{tmp_path}/labels.parquet")
    c = duckdb.connect()
    for name in ("pages", "labels"):
        c.sql(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    df, want = urls.op2_url_filter(spark, f"file://{tmp_path}"), c.sql(urls.ORACLE_SQL)
    got = rows(df.columns, df.collect())
    assert got == rows(want.columns, want.fetchall()) and sum("block" in r for r in got) > 200
