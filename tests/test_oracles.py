"""Every registered query of the library proper against its SQL oracle, on the smallest tables."""

import duckdb
import pytest

from quillspark.plans import mining, search

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
ALL = search.QUERIES | mining.QUERIES
ORACLES = search.ORACLES | mining.ORACLES


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(str(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_oracle(spark, duck, name):
    df = ALL[name](spark, SF)
    cursor = duck.execute(ORACLES[name])
    columns = [c[0] for c in cursor.description]
    assert canonical(df.columns, [tuple(r) for r in df.collect()]) == canonical(columns, cursor.fetchall())


def test_every_other_query_has_a_test():
    """tests/test_models.py asserts on the queries that SQL cannot express."""
    from pathlib import Path

    body = (Path(__file__).parent / "test_models.py").read_text()
    assert all(f"{name}(" in body for name in set(ALL) - set(ORACLES))
