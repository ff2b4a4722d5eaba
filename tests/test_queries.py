"""Every query with SQL against DuckDB on the small tables, and the others for rows."""

import duckdb
import numpy as np
import pytest

from lociflow import queries
from lociflow.operators.distributions import fit_beta
from lociflow.operators.hmm import emissions

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("lineitem", "orders", "events", "documents", "part", "nation"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def normal(df):
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if str(df[c].dtype).startswith("float"):
            df[c] = df[c].astype("float64")
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_against_sql(spark, duck, name):
    got, want = normal(queries.QUERIES[name](spark, SF).toPandas()), normal(duck.sql(queries.SQL[name]).df())
    assert list(got.columns) == list(want.columns) and len(got) == len(want)
    for c in got.columns:
        assert ((got[c] == want[c]) | (got[c].isna() & want[c].isna())).all(), c


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_rows(spark, name):
    assert queries.QUERIES[name](spark, SF).count() > 0


def test_hmm_trained(spark):
    """Against a plain Baum-Welch with scaled probabilities, of ten rounds or until no rate grows."""
    rows = queries.observations(spark, SF).toPandas().sort_values(["segment", "i"])
    step, shapes, total = np.array(queries.TWO.transitions), queries.TWO.shapes, None
    for _ in range(10):
        start = np.array([step[1, 0], step[0, 1]]) / (step[0, 1] + step[1, 0])
        moves, w, logs, total = np.zeros((2, 2)), np.zeros(2), np.zeros((2, 2)), 0.0
        for _, s in rows.groupby("segment"):
            m, u = s["m"].to_numpy(), s["u"].to_numpy()
            e, f, scale = np.exp(emissions(m, u, shapes)), [], []
            for k in range(len(e)):
                x = (f[-1] @ step if k else start) * e[k]
                scale.append(x.sum())
                f.append(x / x.sum())
            b = np.ones(2)
            for k in range(len(e) - 1, -1, -1):
                p = f[k] * b
                share = np.clip(m[k] / (m[k] + u[k]), 0.01, 0.99)
                w += p
                logs += np.outer([np.log(share), np.log(1 - share)], p)
                if k:
                    moves += f[k - 1][:, None] * step * (e[k] * b) / scale[k]
                b = step @ (e[k] * b) / scale[k]
            total += np.log(scale).sum()
        new = moves / moves.sum(axis=1, keepdims=True)
        if all((new[i, 1 - i] - step[i, 1 - i]) / max(new[i, 1 - i], step[i, 1 - i]) < 1e-10 for i in (0, 1)):
            break
        step, shapes = new, [fit_beta(*(logs[:, i] / w[i])) for i in (0, 1)]
    found = queries.QUERIES["hmm_trained"](spark, SF).collect()
    assert [x for r in found for x in (r.alpha, r.beta)] == pytest.approx([x for s in shapes for x in s], rel=1e-6)
    assert found[0].log_likelihood == pytest.approx(total, rel=1e-9)


def test_observations_above_ten_reads(spark, tmp_path):
    spark.createDataFrame([(1, 1, 620.0), (2, 1, 40.0)], "event_id bigint, user_id bigint, value double").write.parquet(str(tmp_path / "events.parquet"))
    assert sorted((r.m, r.u) for r in queries.observations(spark, str(tmp_path)).collect()) == [(0.0, 10.0), (12.0, 0.0)]
    assert queries.QUERIES["hmm_posterior"](spark, str(tmp_path)).count() == 2
