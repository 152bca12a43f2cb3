import hashlib

from disputa.operators import stats


def _draw(seed, b, k):
    return int(hashlib.md5(f"{seed}:{b}:{k}".encode()).hexdigest()[:8], 16)


def test_packed_draws_are_the_md5_of_seed_replicate_and_place():
    for seed, b, first, n in ((1, 0, 0, 1005), (12, 99, 99_990, 20), (1, 7, 10**7 - 3, 6), (10**30, 10**8, 10**15, 3)):
        assert stats.draws(seed, b, first, n).tolist() == [_draw(seed, b, k) for k in range(first, first + n)]


def test_bootstrap_of_many_blocks_and_parts_with_nulls_is_brute_force(spark, monkeypatch):
    monkeypatch.setattr(stats, "DRAWN", 16)
    monkeypatch.setattr(stats, "BLOCK", 8)
    lists = {"a": [(i * 7919) % 101 / 3 if i % 9 else None for i in range(75)], "b": [None, 2.0], "c": [4.0]}
    rows = [(k, i, v) for k, vs in lists.items() for i, v in enumerate(vs)] + [(None, i, 1.0) for i in range(3)]
    got = stats.bootstrap_ci(spark.createDataFrame(rows, "k string, at long, v double").repartition(3), ["k"], "v", "at", replicates=40, alpha=0.1)
    want = {}
    for k, vs in lists.items():
        means = []
        for b in range(40):
            hit = [v for v in (vs[_draw(1, b, i) % len(vs)] for i in range(len(vs))) if v is not None]
            means.append(round(sum(hit) / len(hit), 9) if hit else None)
        means.sort(key=lambda m: (m is None, m))  # as SQL orders: nulls last
        want[k] = (means[2], means[37])
    assert {r["k"]: (r["low"], r["high"]) for r in got.collect()} == want


def test_bootstrap_makes_no_row_for_each_draw_and_broadcasts_no_values(spark):
    rows = spark.range(3000).selectExpr("id % 2 AS k", "id AS at", "cast(id AS double) AS v")
    out = stats.bootstrap_ci(rows, ["k"], "v", "at", replicates=20)
    out.collect()
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    joins = [x for x in plan.splitlines() if "Join" in x]
    assert len(joins) == 1 and "[key" in joins[0].replace("(", "[")
