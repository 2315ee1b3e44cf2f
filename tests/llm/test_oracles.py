"""The SQL of the corpus operators gives their rows."""

import duckdb
import pandas as pd
import pytest

from punctaria.llm import registry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_same_rows(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(registry.SQL[name]).fetchdf()
    got = registry.QUERIES[name](spark, SF).select(*want.columns).toPandas()
    # Null numbers are NaN in one frame and NA in the other, and make whole numbers floats.
    plain = lambda v: "-" if pd.isna(v) else str(int(v)) if isinstance(v, float) and v.is_integer() else str(v)
    key = lambda df: sorted(tuple(map(plain, r)) for r in df.itertuples(index=False))
    assert key(got) == key(want)
