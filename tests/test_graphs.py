import itertools
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from disputa.functions import graph as G
from disputa.operators import assign, build, calibrate, fold, ged, score, stats, text


def brute(cost, delete, insert):
    n, m = cost.shape
    best = float("inf")
    for k in range(min(n, m) + 1):
        for rows in itertools.combinations(range(n), k):
            for columns in itertools.permutations(range(m), k):
                c = sum(cost[i, j] for i, j in zip(rows, columns)) + sum(delete[i] for i in range(n) if i not in rows) + sum(insert[j] for j in range(m) if j not in columns)
                best = min(best, c)
    return best


def test_assignment_is_optimal():
    rng = random.Random(1)
    for _ in range(150):
        n, m = rng.randint(0, 4), rng.randint(0, 4)
        draw = (lambda: rng.randint(0, 2)) if rng.random() < 0.5 else rng.random
        cost, delete, insert = np.array([[draw() for _ in range(m)] for _ in range(n)], float).reshape(n, m), np.ones(n), np.ones(m)
        got = assign.bipartite_match(cost, delete, insert)
        total = sum(cost[i, j] if j >= 0 else 1 for i, j in enumerate(got)) + m - (got >= 0).sum()
        assert total == pytest.approx(brute(cost, delete, insert))
        assert len(set(got[got >= 0])) == (got >= 0).sum()
    with pytest.raises(ValueError):
        assign.linear_sum_assignment(np.array([[np.nan]]))
    assert assign.linear_sum_assignment(np.ones((4, 4))).tolist() == [0, 1, 2, 3]


def test_most_pairs():
    rng = np.random.default_rng(2)
    for _ in range(100):
        near = rng.random((rng.integers(0, 5), rng.integers(0, 5))) < 0.4
        n, m = near.shape
        best = max((k for k in range(min(n, m) + 1) for r in itertools.combinations(range(n), k) for c in itertools.permutations(range(m), k) if all(near[i, j] for i, j in zip(r, c))), default=0)
        assert assign.most_pairs(near) == best
    assert assign.most_pairs(np.array([[0.99, 0.56], [0.56, 0.50]]) >= 0.55) == 2


def passes(pred, gold):
    left, done, out = Counter(gold), [], Counter()
    pairs = Counter((a, b) for a, b, _ in gold)
    rest = []
    for e in pred:
        if left[e]:
            left[e] -= 1
            pairs[e[:2]] -= 1
            out["exact"] += 1
        else:
            rest.append(e)
    for name, turn in (("typed", False), ("turned", True)):
        todo, rest = rest, []
        for a, b, k in todo:
            pair = (b, a) if turn else (a, b)
            if pairs[pair] > 0:
                pairs[pair] -= 1
                out[name] += 1
            else:
                rest.append((a, b, k))
    return out["exact"], out["typed"], out["turned"], len(rest), sum(pairs.values())


def test_edges_match_like_the_passes(spark):
    rng = random.Random(3)
    p, g, want = [], [], {}
    for key in range(200):
        edge = lambda: (rng.choice("xyz"), rng.choice("xyz"), rng.choice("kl"))
        pred, gold = [edge() for _ in range(rng.randint(0, 6))], [edge() for _ in range(rng.randint(0, 6))]
        p += [(key, *e) for e in pred]
        g += [(key, *e) for e in gold]
        if pred or gold:
            want[key] = passes(pred, gold)
    df = lambda rows: spark.createDataFrame(rows, "cmp_id long, from_id string, to_id string, kind string")
    pairs = spark.createDataFrame([(k, c, c) for k in range(200) for c in "xyz"], "cmp_id long, a string, b string")
    got = {r.cmp_id: (r.exact, r.type_substituted, r.direction_substituted, r.inserted, r.deleted) for r in ged.edge_breakdown(df(p), df(g), pairs, True).collect()}
    assert got == want


NODES = "graph_id string, pos int, node_id string, type string, text string, scheme string, speaker string, timestamp string, confidence string"


def node(i, name, kind, scheme="", stamp="", grade="", text="t "):
    return ("g", i, name, kind, text, scheme, "", stamp, grade)


def test_normalize_and_rules(spark):
    nodes = spark.createDataFrame([node(0, "L0", "L"), node(1, "Y0", "YA", "Asserting"), node(2, "I0", "I"), node(3, "I1", "I"), node(4, "S", "RA"), node(5, "Z", "L"), node(6, "Y1", "YA", "odd"), node(7, "Q", "XX")], NODES)
    edges = spark.createDataFrame([("g", 0, "L0", "Y0"), ("g", 1, "Y0", "I0"), ("g", 2, "I0", "S"), ("g", 3, "S", "I1"), ("g", 4, "L0", "Y0"), ("g", 5, "I0", "I1"), ("g", 6, "S", "S"), ("g", 7, "I0", "no")], "graph_id string, pos int, from_id string, to_id string")
    found = Counter(r.rule for r in fold.violations(nodes, edges).collect())
    # two anchors of Y0 by the repeated edge; S has two outputs and an input from its last one by its loop; Y1 has neither end nor force.
    assert found == {"R1": 1, "R2": 1, "R5": 3, "R8": 1, "R9": 2, "R10": 1}
    report = fold.normalize_report(nodes, edges).first()
    assert (report.dropped_edges, report.dropped_isolated_l, report.dropped_other, report.dropped_node_ids, report.violations) == (4, 1, 2, "Q,Y1,Z", 0)
    kept, links = fold.normalize(nodes, edges)
    assert {r.text for r in kept.collect()} == {"t"} and links.count() == 4
    empty = nodes.limit(0), edges.limit(0)
    assert fold.violations(*empty).count() == 0 and fold.relations(*empty).count() == 0


def test_order_breaks_cycles_and_ties(spark):
    nodes = spark.createDataFrame([node(i, f"L{i}", "L", stamp=s) for i, s in enumerate(["3", "1", "2", "2"])] + [node(10, "T0", "TA"), node(11, "T1", "TA")], NODES)
    arrows = [("L0", "T0"), ("T0", "L1"), ("L1", "T1"), ("T1", "L0")]
    edges = spark.createDataFrame([("g", i, a, b) for i, (a, b) in enumerate(arrows)], "graph_id string, pos int, from_id string, to_id string")
    order = [r.node_id for r in fold.locution_order(nodes, edges).orderBy("idx").collect()]
    assert order == ["L2", "L3", "L1", "L0"]


def test_relation_passes_prefer_exact(spark):
    inst = lambda rows: spark.createDataFrame([("g", i, *r) for i, r in enumerate(rows)], "graph_id string, inst long, type string, src string, dst string")
    same = spark.createDataFrame([("g", x, x) for x in "abc"], "graph_id string, a string, b string")
    got = score.relation_outcomes(inst([("CA", "a", "b"), ("RA", "a", "b"), ("RA", "c", "b"), ("MA", "q", "b")]), inst([("RA", "a", "b"), ("CA", "b", "c")]), same).orderBy("inst").collect()
    assert [r.outcome for r in got] == ["spurious", "correct", "reversed", "spurious"]
    assert got[2].gold_type == "CA"


def test_distance_of_small_changes(spark):
    nodes = spark.createDataFrame([("k", x, "I", "") for x in "ab"], "cmp_id string, node_id string, type string, scheme string")
    edge = lambda *rows: spark.createDataFrame([("k", *r) for r in rows], "cmp_id string, from_id string, to_id string, kind string")
    same = spark.createDataFrame([("k", x, x, 1.0) for x in "ab"], "cmp_id string, a string, b string, cos double")
    gold = edge(("a", "b", "support"))
    cost = lambda pred: ged.distance(nodes, nodes, pred, gold, same, same, True).first().ged
    assert [cost(gold), cost(edge(("a", "b", "attack"))), cost(edge(("b", "a", "support"))), cost(gold.limit(0))] == [0.0, 0.75, 1.0, 1.0]


def test_all_nodes_are_assigned(spark):
    rng = random.Random(3)
    made = lambda kinds: [("g", i, f"n{i}", k, rng.choice(["Asserting", "Arguing", "Challenging"]) if k == "YA" else "") for i, k in enumerate(kinds)]
    pred, gold = made(["I", "I", "L", "RA", "CA", "YA", "YA", "TA"]), made(["I", "L", "L", "MA", "RA", "YA", "TA", "TA", "I"])
    schema = "graph_id string, pos int, node_id string, type string, scheme string"
    cos = {(a[2], b[2]): round(rng.random(), 3) for a in pred for b in gold if a[3] == b[3] and a[3] in ("I", "L")}
    got = ged.assign_all(spark.createDataFrame(pred, schema), spark.createDataFrame(gold, schema), spark.createDataFrame([("g", *k, v) for k, v in cos.items()], "graph_id string, a string, b string, cos double")).collect()
    family = {"Asserting": 0, "Arguing": 0, "Challenging": 1}

    def cost(a, b):
        if a[3] == b[3]:
            return 1 - cos[a[2], b[2]] if a[3] in ("I", "L") else 0 if a[3] != "YA" or a[4] == b[4] else 0.5 if family[a[4]] == family[b[4]] else 1
        return 0.75 if {a[3], b[3]} <= {"RA", "CA", "MA"} else 1e6

    table = np.array([[cost(a, b) for b in gold] for a in pred])
    whole = assign.bipartite_match(table, np.ones(len(pred)), np.ones(len(gold)))
    spent = lambda pairs: sum(table[i, j] for i, j in pairs) + len(pred) + len(gold) - 2 * len(pairs)
    assert spent([(int(r.a[1:]), int(r.b[1:])) for r in got]) == pytest.approx(spent([(i, j) for i, j in enumerate(whole.tolist()) if j >= 0]))
    assert len({r.a for r in got}) == len({r.b for r in got}) == len(got) and {r.graph_id for r in got} == {"g"}


def test_statistics(spark):
    rows = spark.createDataFrame([("k", i, float(v)) for i, v in enumerate([2, 4, 4, 4, 5, 5, 7, 9])], "k string, i int, v double")
    d = stats.describe(rows, ["k"], "v").first()
    assert (d.n, d.mean, round(d.sd, 3)) == (8, 5.0, 2.138)
    tests = spark.createDataFrame([("a", 0.01), ("b", 0.02), ("c", 0.03), ("d", 0.04)], "name string, p double")
    assert [round(r.p_holm, 6) for r in stats.holm(tests, [], "p", ["name"]).orderBy("name").collect()] == [0.04, 0.06, 0.06, 0.06]
    pairs = spark.createDataFrame([("k", float(x), float(x) - 1, 1.0) for x in range(10, 14)], "k string, x double, y double, diff double")
    assert stats.cliffs_delta(pairs, ["k"]).first().delta == pytest.approx(sum((x > y) - (x < y) for x in range(10, 14) for y in range(9, 13)) / 16)
    w = stats.wilcoxon(pairs, ["k"]).first()
    assert (w.w_plus, w.w_minus) == (10.0, 0.0)


def test_transcript(spark):
    doc = "Intro\nAnna\n[0:00:01] Hello\r\nthere.\n\nWords: 12\nBob\n[0:00:05] Yes.\n[0:00:07] Again."
    got = [(r.turn, r.speaker, r.stamp, r.body) for r in text.turns(spark.createDataFrame([("d", doc)], "doc string, text string")).orderBy("turn").collect()]
    assert got == [(1, "Anna", "[0:00:01]", "Hello there."), (2, "Bob", "[0:00:05]", "Yes."), (3, "", "[0:00:07]", "Again.")]


def test_build_and_speakers(spark):
    said = spark.createDataFrame([("g", 0, "Anna", "one"), ("g", 1, "Bob", "two")], "graph_id string, idx long, speaker string, text string")
    nodes, edges = build.baseline(said)
    assert fold.violations(nodes, edges).count() == 0 and Counter(r.type for r in nodes.collect()) == {"L": 2, "I": 2, "YA": 2, "TA": 1}
    one = spark.createDataFrame([("Anna : x : y",), (" : x",), ("none",)], "t string").select(G.speaker_of(F.lit(""), F.col("t")).alias("s"), G.locution_text(F.col("t")).alias("b")).collect()
    assert [(r.s, r.b) for r in one] == [("Anna", "x : y"), ("", ": x"), ("", "none")]


def test_fit_gradient_and_edits():
    rng = np.random.default_rng(4)
    n, j = 60, 3
    args = [rng.normal(size=(n, 11)), rng.normal(size=n), rng.integers(0, 2, n).astype(float), rng.integers(0, j, n), rng.choice([-1, 1], n), rng.integers(0, 3, n), j]
    x = calibrate.start(j) + rng.normal(size=12 + 3 * j) * 0.1
    _, grad = calibrate.objective(x, *args)
    for i in range(len(x)):
        e = np.zeros(len(x))
        e[i] = 1e-6
        assert grad[i] == pytest.approx((calibrate.objective(x + e, *args)[0] - calibrate.objective(x - e, *args)[0]) / 2e-6, abs=1e-4)
    best = calibrate.minimise(lambda v: calibrate.objective(v, *args), x)
    assert calibrate.objective(best, *args)[0] < calibrate.objective(x, *args)[0]
    props, links, log = calibrate.edited(["a", "b", "c"], [("a", "b", "RA")], ["R-rev", "P-add", "P-del", "X-surf", "R-del"], np.random.default_rng(1))
    assert links == [("b", "a", "RA")] and props == ["a", "b", "n1"] and [k for k, _, _ in log] == ["R-rev", "P-add", "P-del", "X-surf"]


def test_alternating_fit_recovers_costs():
    import pandas as pd

    rng, wanted, judges = np.random.default_rng(6), np.array(calibrate.vocab.THETA), 2
    wanted[0], wanted[1] = 1.6, 0.6
    cells = [(f"{t}|{s}", f"a{i}", f"b{j}", rng.random()) for t in range(120) for s in "AB" for i in range(rng.integers(2, 5)) for j in range(3)]
    cells = pd.DataFrame(cells, columns=["cmp_id", "a", "b", "cos"])
    sizes = cells.groupby("cmp_id").a.nunique()

    def solve(theta):
        got = calibrate.rematch(cells, list(theta))
        by = {k: v for k, v in got.groupby("cmp_id")}
        rows = []
        for t in range(120):
            phi = {}
            for s in "AB":
                cos = by[f"{t}|{s}"].cos.to_numpy() if f"{t}|{s}" in by else np.zeros(0)
                k = calibrate.vocab.KNOTS
                phi[s] = [3 - len(cos), sizes[f"{t}|{s}"] - len(cos), *(np.clip((k[i] - cos) / (k[i] - k[i + 1]), 0, 1).sum() for i in range(4)), *[0] * 5]
            rows.append((t, *np.subtract(phi["B"], phi["A"]), 0.0, 0.0))
        names = ["triplet_id", *(f"d{i}" for i in range(11)), "extra", "neg"]
        return pd.DataFrame(rows, columns=names), tuple(got[["cmp_id", "a", "b"]].itertuples(index=False, name=None))

    truth, _ = solve(wanted)
    delta = truth[[f"d{i}" for i in range(11)]].to_numpy(float) @ wanted
    asked = [(t, j, o, 0 if (z := delta[t] + rng.logistic() * 0.3) > 0.5 else 1 if z < -0.5 else 2) for t in range(120) for j in range(judges) for o in (1, -1)]
    answers = pd.DataFrame(asked, columns=["triplet_id", "judge", "ord", "answer"])
    got = calibrate.fit_alternating(solve, answers, judges)
    assert (got.converged or got.cycled) and got.rounds <= 20
    found = calibrate.costs(got.x)
    assert found[0] > found[1] and abs(found[0] / found[1] - 1.6 / 0.6) < abs(1 - 1.6 / 0.6)
    again, signature = solve(found)
    assert calibrate.fit_alternating(lambda theta: (again, signature), answers, judges, got.x).rounds == 1  # nothing moves: one round
