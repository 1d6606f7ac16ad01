"""Every query of the engine against its SQL, on the smallest tables."""

import os

import pandas as pd
import pytest

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(df):
    def cell(x):
        if x is None or x is pd.NA or x != x:
            return None
        return round(float(x), 6) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)

    df = df[sorted(df.columns)].astype(object)
    return sorted((tuple(map(cell, r)) for r in df.values.tolist()), key=str)


@pytest.fixture(scope="module")
def duck(small):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        p = f"{small}/{t}.parquet"
        con.execute(f"create view {t} as select * from '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return con


def _names(kind):
    from tidewell.plans.registry import ORACLE, QUERIES

    return [n for n in QUERIES if (n in ORACLE) == kind]


@pytest.mark.parametrize("name", _names(True))
def test_equals_sql(spark, small, duck, name):
    from tidewell.plans.registry import ORACLE, QUERIES

    got, expected = QUERIES[name](spark, small).toPandas(), duck.sql(ORACLE[name]).df()
    assert sorted(got.columns) == sorted(expected.columns)
    assert rows(got) == rows(expected)


#: Of queries without SQL the columns that name a row, and what its other columns may be; their operators have brute-force tests.
WITHOUT_SQL = {
    "rank_explored": (["user_id", "position"], None),
    "selection_v1": (["story_id"], ("reason", {"global_rank", "capacity", "category_limit", "publisher_cap", "duplicate_suppression"})),
    "selection_v2": (["story_id"], ("reason", {"global_rank", "capacity", "category_limit", "publisher_cap", "duplicate_suppression"})),
    "story_clusters": (["article_id"], None),
    "story_memberships": (["article_id"], None),
    "history_matches": (["story_id"], None),
    "portfolio_automatic": (["source_id"], ("role", {"selected", "explore", "probe", "skipped"})),
}


@pytest.mark.parametrize("name", _names(False))
def test_without_sql(spark, small, name):
    from tidewell.plans.registry import QUERIES

    key, values = WITHOUT_SQL[name]
    got = QUERIES[name](spark, small).toPandas()
    assert len(got) and not got.duplicated(key).any() and not got[key].isna().any().any()
    if values:
        assert set(got[values[0]]) <= values[1]
    if name.startswith("selection"):
        chosen = got[got.selected]
        assert len(chosen) and chosen.groupby("run_id").size().max() <= 12 and got[~got.selected].selection_rank.isna().all()
    if name.startswith("story"):
        assert set(got.story_id) <= set(got.article_id) and len(got) == 200
    if name == "rank_explored":
        assert (got.groupby("user_id").position.max() == 199).all() and (got[got.is_exploration].position % 10 == 9).all()


@pytest.mark.parametrize("name", ["selection_scores", "policy_gate"])
def test_texts_are_judged_once(spark, small, name):
    from tidewell.plans.registry import QUERIES

    plan = QUERIES[name](spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [doc_id") == 1
