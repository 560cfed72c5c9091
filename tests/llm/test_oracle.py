"""Training-data queries against their DuckDB SQL on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from baitline.llm.queries import ORACLE, REGISTRY
from tests.conftest import SF_SMALL


def comparable(pdf):
    """Rows in order; nulls, whatever stands for them, as empty strings."""
    return sorted(["" if pd.isna(x) else x if isinstance(x, str) else repr(float(x)) for x in r] for r in pdf.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    got, want = REGISTRY[name](spark, SF_SMALL).toPandas(), con.execute(ORACLE[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    assert comparable(got[cols]) == comparable(want[cols])
