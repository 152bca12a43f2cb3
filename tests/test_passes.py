import numpy as np
import pandas as pd
import pytest

from disputa.operators import assign, calibrate

NAMES = [*(f"d{i}" for i in range(11)), "extra", "neg", "judge", "ord", "answer"]


def _judged(n=240, seed=4):
    rng = np.random.default_rng(seed)
    frame = pd.DataFrame(rng.normal(size=(n // 2, 11)) * (rng.random((n // 2, 11)) < 0.6), columns=NAMES[:11]).assign(extra=rng.normal(size=n // 2), neg=rng.integers(0, 2, n // 2).astype(float))
    frame = frame.assign(triplet_id=range(n // 2), source_id=np.arange(n // 2) // 2).loc[np.repeat(np.arange(n // 2), 2)].reset_index(drop=True)
    return frame.assign(judge=rng.integers(0, 3, n), ord=rng.choice([-1, 1], n), answer=rng.integers(0, 3, n))


def test_tables_of_one_shape_are_assigned_together_as_each_alone():
    rng = np.random.default_rng(1)
    tables = [(rng.integers(0, 4, (n, m)) / 4, np.full(n, 1.0), np.full(m, 1.4)) for n, m in rng.integers(0, 6, (300, 2))]
    for one, together in zip((assign.bipartite_match(*t) for t in tables), assign.bipartite_matches(tables)):
        assert one.tolist() == together.tolist()


def test_replicates_are_fitted_in_step_without_a_group_for_each(spark):
    rows, warm = _judged(), calibrate.start(3)
    draws = calibrate.cluster_draws(spark.createDataFrame(rows[["source_id"]].drop_duplicates()), 3)
    got = calibrate.bootstrap_fits(spark.createDataFrame(rows), draws, 3, warm)
    assert "FlatMapGroups" not in got._jdf.queryExecution().optimizedPlan().toString()
    times = draws.toPandas().groupby(["rep", "source_id"]).size().rename("weight").astype(float).reset_index()
    found = {(r["rep"], r["param"]): r["value"] for r in got.collect()}
    assert len(found) == 33
    for rep, own in times.groupby("rep"):
        want = calibrate.costs(calibrate.fit(rows.merge(own, on="source_id"), 3, warm))
        assert [found[rep, p] for p in calibrate.vocab.PARAMETERS] == pytest.approx(want.tolist(), abs=1e-9)


def test_folds_are_fitted_in_step_without_a_group_for_each(spark):
    got = calibrate.cross_validated(spark.createDataFrame(_judged()), 3, folds=3)
    assert "FlatMapGroups" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(r["triplet_id"] for r in got.collect()) == list(range(120))


def test_profile_without_derivatives_is_the_objective(spark):
    rows, x = _judged(), calibrate.start(3) + np.random.default_rng(2).normal(size=21) * 0.2
    z, t = np.linspace(-40, 40, 90), np.full(90, 0.3)
    assert np.isfinite(calibrate.log_likelihoods(z, t, np.arange(90) % 3)).all()
    got = calibrate.profile(calibrate.weighted(spark.createDataFrame(rows)), x, 3, points=4).collect()
    for r in got:
        at = x.copy()
        at[calibrate.vocab.PARAMETERS.index(r["param"])] = np.log(np.expm1(max(r["value"], 1e-6)))
        assert r["nll"] == pytest.approx(calibrate.objective(at, *calibrate._arguments(rows), 3)[0], abs=1e-8)
