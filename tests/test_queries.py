"""Every registered query of the library itself against its SQL on the smallest tables."""

import duckdb
import pytest

from plumbline.plans import QUERIES, SQL

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

#: The smallest raster is three cells wide, and no seam of its parts has a gap; tests/test_scenes.py plants one.
MAY_BE_EMPTY = {"j12_seams", "m08_bridges"}


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(str(round(float(r[i]), 6)) if isinstance(r[i], float) else str(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, db, name):
    got = QUERIES[name](spark, SF)
    if name not in SQL:
        assert got.count() > 0 or name in MAY_BE_EMPTY
        return
    want = db.execute(SQL[name])
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert plain(got.columns, [tuple(r) for r in got.collect()]) == plain(columns, want.fetchall())


def test_results_do_not_depend_on_partitions(spark):
    from plumbline.operators import cells
    from plumbline.plans.fixtures import points
    from plumbline.plans.queries import KNOBS

    p = points(spark, SF)
    runs = [sorted(map(tuple, cells.tree_filter(p.repartition(n), p["cls"].isin("error", "view"), KNOBS).collect())) for n in (1, 7)]
    assert runs[0] == runs[1]


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0 and set(e.oracle_sql()) <= set(e.queries())
