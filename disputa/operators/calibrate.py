"""Learning the costs of the edit distance from three-way judgments.

The distance is linear in its eleven costs once propositions are matched, so features are computed by joins over a
matching, and fitting works on a small table of feature differences: one row for each triplet.
"""

from __future__ import annotations

from collections.abc import Callable, Generator, Hashable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from disputa.functions import vocab
from disputa.functions.graph import substitution_basis
from disputa.operators.assign import bipartite_match, match
from disputa.operators.passes import both_sides, match_in_passes
from disputa.operators.stats import draw, running
from disputa.sources.scratch import written

N = len(vocab.PARAMETERS)
KEY = "cmp_id"


def substitution(cosine: Column, theta: list[float] | None = None) -> Column:
    """Cost of substituting propositions with this cosine."""
    theta = theta or vocab.THETA
    out = F.lit(0.0)
    for value, basis in zip(theta[2:6], substitution_basis(cosine)):
        out = out + value * basis
    return out


def features(matching: DataFrame, variant_props: DataFrame, reference_props: DataFrame, variant_edges: DataFrame, reference_edges: DataFrame) -> DataFrame:
    """(cmp_id, f0..f10, edge_extra): features of matched graphs.

    matching: (cmp_id, a, b, cos); props: (cmp_id, prop_id); edges: (cmp_id, pos, from_id, to_id, kind). Same pair and kind
    match first, then the i-th left on each side of the same pair, then of the swapped pair.
    """
    counted = lambda df, name: df.groupBy(KEY).agg(F.count("*").alias(name))
    cos = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("cos")))
    h = substitution_basis(cos)
    m = matching.groupBy(KEY).agg(F.count("*").alias("matched"), *(F.sum(x).alias(f"h{i}") for i, x in enumerate(h)))
    to = lambda end: matching.select(KEY, F.col("a").alias(end), F.col("b").alias(f"m_{end}"))
    v = variant_edges.join(to("from_id"), [KEY, "from_id"], "left").join(to("to_id"), [KEY, "to_id"], "left")
    ends = lambda a, b: F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), F.concat_ws("\x1e", a, b))
    shape = lambda df, a, b: df.select(KEY, F.col("pos").cast("long").alias("id"), "pos", F.col("kind").alias("type"), ends(a, b).alias("ends"), ends(b, a).alias("turned"))
    rows = both_sides(shape(v, "m_from_id", "m_to_id"), shape(reference_edges, "from_id", "to_id"))
    found = match_in_passes(rows, KEY, [("exact", False, True), ("type", False, False), ("direction", True, False)]).filter("side = 0 AND partner IS NOT NULL").select(KEY, F.col("type").alias("kind"), F.col("partner_type").alias("rkind"), F.col("outcome").alias("how"))
    pair = F.concat_ws("+", F.least("kind", "rkind"), F.greatest("kind", "rkind"))
    typed = lambda x: F.count_if((F.col("how") == "type") & (pair == x))
    e = found.groupBy(KEY).agg(F.count("*").alias("edges"), typed("CA+RA").alias("ra_ca"), typed("MA+RA").alias("ra_ma"), typed("CA+MA").alias("ca_ma"), F.count_if(F.col("how") == "direction").alias("turned"))
    out = variant_props.select(KEY).unionByName(reference_props.select(KEY)).distinct()
    for df in (m, e, counted(variant_props, "nv"), counted(reference_props, "nr"), counted(variant_edges, "ev"), counted(reference_edges, "er")):
        out = out.join(df, KEY, "left")
    out = out.fillna(0)
    phi = [F.col("nr") - F.col("matched"), F.col("nv") - F.col("matched"), *(F.col(f"h{i}") for i in range(4)), F.col("er") - F.col("edges"), F.col("ra_ca"), F.col("ra_ma"), F.col("ca_ma"), F.col("turned")]
    return out.select(KEY, *(x.cast("double").alias(f"f{i}") for i, x in enumerate(phi)), (F.col("ev") - F.col("edges")).cast("double").alias("edge_extra"))


def learned_cost(theta: list[float] | None = None) -> Column:
    """The distance of a ``features`` row."""
    out = F.col("edge_extra") * vocab.EDGE_EXTRA
    for i, value in enumerate(theta or vocab.THETA):
        out = out + F.col(f"f{i}") * value
    return out


def log_likelihood(answer: Column, z: Column, tau: Column) -> Column:
    """Log-likelihood of an answer (0: A, 1: B, 2: tie) of an ordered logit with a band of ties."""
    sigmoid = lambda x: 1 / (1 + F.exp(-x))
    log_sigmoid = lambda x: F.when(x < 0, x - F.log1p(F.exp(x))).otherwise(-F.log1p(F.exp(-x)))
    tie = F.greatest(1 - sigmoid(z - tau) - sigmoid(-z - tau), F.lit(1e-12))
    return F.when(answer == 0, log_sigmoid(z - tau)).when(answer == 1, log_sigmoid(-z - tau)).otherwise(F.ln(tie))


def majority(judgments: DataFrame) -> DataFrame:
    """(triplet_id, majority): the single most frequent answer; null if two share the lead."""
    n = judgments.groupBy("triplet_id", "answer").agg(F.count("*").alias("n"))
    top = n.groupBy("triplet_id").agg(F.max("n").alias("n"))
    return n.join(top, ["triplet_id", "n"]).groupBy("triplet_id").agg(F.when(F.count("*") == 1, F.max("answer")).alias("majority"))


def agreement(deltas: DataFrame, votes: DataFrame) -> DataFrame:
    """(n, rate): how often the smaller distance is the majority's; ties of the majority are left out, equal distances count half. deltas: (triplet_id, delta), delta = B - A."""
    both = deltas.join(votes.filter("majority < 2"), "triplet_id")
    right = F.when(F.abs("delta") < 1e-9, 0.5).otherwise((F.when(F.col("delta") > 0, 0).otherwise(1) == F.col("majority")).cast("double"))
    return both.agg(F.count("*").alias("n"), F.avg(right).alias("rate"))


def judge_diagnostics(judgments: DataFrame) -> DataFrame:
    """(judge, n, tie_percent, consistency): consistency is the share of triplets with the same answer in both orders."""
    base = judgments.groupBy("judge").agg(F.count("*").alias("n"), (100 * F.avg((F.col("answer") == 2).cast("double"))).alias("tie_percent"))
    both = judgments.groupBy("judge", "triplet_id").agg(F.countDistinct("ord").alias("orders"), F.countDistinct("answer").alias("answers")).filter("orders = 2")
    return base.join(both.groupBy("judge").agg(F.avg((F.col("answers") == 1).cast("double")).alias("consistency")), "judge", "left")


def decision(low90: Column, high90: Column, low95: Column, high95: Column, estimate: Column, current: Column, margin: float) -> Column:
    """keep if the 90 % interval is near the current cost, change if the 95 % interval and the estimate are off it, else undecided."""
    return F.when((low90 >= current - margin) & (high90 <= current + margin), "keep").when(((current < low95) | (current > high95)) & (F.abs(estimate - current) >= margin), "change").otherwise("undecided")


def robust_sd(value: str) -> Column:
    return (F.percentile(value, 0.8413) - F.percentile(value, 0.1587)) / 2


def uniform(seed: int, *parts: Column) -> Column:
    """A number in [0, 1) from md5 of the parts."""
    return draw(seed, *parts) / F.lit(float(1 << 32))


def plans(triplets: DataFrame, seed: int = 7) -> DataFrame:
    """(triplet_id, plan): T1 10 %, T2 10 %, T3 70 %, T4 10 %."""
    u = uniform(seed, F.col("triplet_id"))
    return triplets.select("triplet_id", F.when(u < 0.1, "T1").when(u < 0.2, "T2").when(u < 0.9, "T3").otherwise("T4").alias("plan"))


def random_sources(n: int, size: int, spark, seed: int = 3) -> DataFrame:
    """(source_id, child, parent, kind): trees whose propositions are skipped with 0.15; CA 0.25, MA 0.15, else RA."""
    cells = spark.range(n).select(F.col("id").alias("source_id"), F.explode(F.sequence(F.lit(1).cast("long"), F.lit(size - 1).cast("long"))).alias("child"))
    u = lambda k: uniform(seed + k, F.col("source_id"), F.col("child"))
    return cells.filter(u(0) >= 0.15).select("source_id", "child", F.floor(u(1) * F.col("child")).cast("long").alias("parent"), F.when(u(2) < 0.25, "CA").when(u(2) < 0.4, "MA").otherwise("RA").alias("kind"))


def simulated(deltas: DataFrame, judges: int = 3, sigma: float = 1.0, noise: float = 0.1, tau: float = 0.5, seed: int = 5) -> DataFrame:
    """(triplet_id, judge, ord, answer): judges share an error by triplet (Box-Muller) and answer at random with ``noise``."""
    t = F.col("triplet_id")
    shared = F.sqrt(-2 * F.ln(1 - uniform(seed, t))) * F.cos(2 * np.pi * uniform(seed + 1, t)) * sigma
    rows = deltas.withColumn("e", shared).withColumn("judge", F.explode(F.sequence(F.lit(0), F.lit(judges - 1)))).withColumn("ord", F.explode(F.array(F.lit(1), F.lit(-1))))
    z = F.col("delta") + F.col("e")
    u = lambda k: uniform(seed + k, t, F.col("judge"), F.col("ord"))
    lean = 1 / (1 + F.exp(-(z - tau)))
    other = 1 / (1 + F.exp(z + tau))
    said = F.when(u(2) < lean, 0).when(u(2) < lean + other, 1).otherwise(2)
    return rows.select("triplet_id", "judge", "ord", F.when(u(3) < noise, F.floor(u(4) * 3)).otherwise(said).cast("int").alias("answer"))


# ---- Fitting: a small dense problem in numpy.


def _softplus(x: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, x)


def _split(x: np.ndarray, judges: int) -> tuple[np.ndarray, float, np.ndarray, np.ndarray, np.ndarray]:
    return _softplus(x[:N]), x[N], np.exp(x[N + 1 : N + 1 + judges]), np.exp(x[N + 1 + judges : N + 1 + 2 * judges]), x[N + 1 + 2 * judges :]


def likelihood(x: np.ndarray, phi: np.ndarray, extra: np.ndarray, neg: np.ndarray, judge: np.ndarray, order: np.ndarray, answer: np.ndarray, judges: int, weight: np.ndarray | float = 1.0) -> tuple[float, np.ndarray]:
    """Negative log-likelihood of weighted rows and its gradient: sums over rows, so parts of a table add up. x: raw costs, theta_neg, log beta, log tau, pi of each judge."""
    theta, theta_neg, beta, tau, pi = _split(x, judges)
    delta = phi @ theta + extra + theta_neg * neg
    z = beta[judge] * delta + pi[judge] * order
    t = tau[judge]
    a, b = 1 / (1 + np.exp(-np.clip(z - t, -500, 500))), 1 / (1 + np.exp(-np.clip(-z - t, -500, 500)))
    tie = np.maximum(1 - a - b, 1e-12)
    ll = np.where(answer == 0, -np.logaddexp(0, -(z - t)), np.where(answer == 1, -np.logaddexp(0, z + t), np.log(tie)))
    dz = weight * np.where(answer == 0, 1 - a, np.where(answer == 1, -(1 - b), (-a * (1 - a) + b * (1 - b)) / tie))
    dt = weight * np.where(answer == 0, -(1 - a), np.where(answer == 1, -(1 - b), (a * (1 - a) + b * (1 - b)) / tie))
    by = lambda v: np.bincount(judge, v, judges)
    grad = np.concatenate([-(phi.T @ (dz * beta[judge])) * (1 - np.exp(-theta)), [-(dz * beta[judge] * neg).sum()], -by(dz * delta) * beta, -by(dt) * tau, -by(dz * order)])
    return -float((weight * ll).sum()), grad


def penalty(x: np.ndarray, judges: int, ridge: float = 0.5, shrink: float = 1e-4) -> tuple[float, np.ndarray]:
    """What costs far from the current ones and other parameters far from 0 are charged, and its gradient."""
    theta, theta_neg, beta, tau, pi = _split(x, judges)
    gap, rest = theta - np.array(vocab.THETA), np.concatenate([[theta_neg], np.log(beta), np.log(tau), pi])
    return float(ridge * gap @ gap + shrink * rest @ rest), np.concatenate([2 * ridge * gap * (1 - np.exp(-theta)), 2 * shrink * rest])


def objective(x: np.ndarray, phi: np.ndarray, extra: np.ndarray, neg: np.ndarray, judge: np.ndarray, order: np.ndarray, answer: np.ndarray, judges: int, weight: np.ndarray | float = 1.0) -> tuple[float, np.ndarray]:
    """Penalised negative log-likelihood and its gradient."""
    (value, grad), (more, pull) = likelihood(x, phi, extra, neg, judge, order, answer, judges, weight), penalty(x, judges)
    return value + more, grad + pull


def _arguments(rows: pd.DataFrame) -> list[np.ndarray]:
    return [rows[[f"d{i}" for i in range(N)]].to_numpy(float), *(rows[c].to_numpy() for c in ("extra", "neg", "judge", "ord", "answer"))]


def weighted(rows: DataFrame, *keys: str) -> DataFrame:
    """Equal rows (keys, d0..d10, extra, neg, judge, ord, answer) as one with their number as weight."""
    return rows.groupBy(*keys, *(f"d{i}" for i in range(N)), "extra", "neg", "judge", "ord", "answer").agg(F.count("*").cast("double").alias("weight"))


def curvature(x: np.ndarray, phi: np.ndarray, extra: np.ndarray, neg: np.ndarray, judge: np.ndarray, order: np.ndarray, answer: np.ndarray, judges: int, weight: np.ndarray) -> np.ndarray:
    """The rows' second derivatives by z and tau, carried to the parameters: a matrix without negative eigenvalues, which adds up over parts of a table."""
    theta, theta_neg, beta, tau, pi = _split(x, judges)
    delta, one, steep = phi @ theta + extra + theta_neg * neg, np.eye(judges)[judge], beta[judge]
    z, t = steep * delta + pi[judge] * order, tau[judge]
    a, b = 1 / (1 + np.exp(-np.clip(z - t, -500, 500))), 1 / (1 + np.exp(-np.clip(-z - t, -500, 500)))
    p, q, tie = a * (1 - a), b * (1 - b), np.maximum(1 - a - b, 1e-12)
    both = (p * (1 - 2 * a) + q * (1 - 2 * b)) / tie
    zz = np.select([answer == 0, answer == 1], [p, q], both + ((q - p) / tie) ** 2)
    tt = np.select([answer == 0, answer == 1], [p, q], both + ((q + p) / tie) ** 2)
    zt = np.select([answer == 0, answer == 1], [-p, q], (q * (1 - 2 * b) - p * (1 - 2 * a)) / tie + (q - p) * (q + p) / tie**2)
    rest = np.zeros_like(one)
    by_z = np.hstack([steep[:, None] * phi * (1 - np.exp(-theta)), (steep * neg)[:, None], one * (steep * delta)[:, None], rest, one * order[:, None]])
    by_t = np.hstack([np.zeros((len(phi), N + 1)), rest, one * t[:, None], rest])
    mixed = by_z.T @ ((weight * zt)[:, None] * by_t)
    return by_z.T @ ((weight * zz)[:, None] * by_z) + by_t.T @ ((weight * tt)[:, None] * by_t) + mixed + mixed.T


def summed(rows: DataFrame, judges: int, x: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Objective, gradient and curvature over a ``weighted`` table of any size: tasks add up their rows, and one row of sums by task goes to the driver."""
    k = len(x)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(1 + k + k * k)
        for frame in frames:
            args = [x, *_arguments(frame), judges, frame["weight"].to_numpy()]
            value, grad = likelihood(*args)
            total += np.concatenate([[value], grad, curvature(*args).ravel()])
        yield pd.DataFrame({"sums": [total]})

    total = np.sum([np.array(r[0]) for r in rows.mapInPandas(run, "sums array<double>").collect()] or [np.zeros(1 + k + k * k)], axis=0)
    return charged(x, judges, total[0], total[1 : 1 + k], total[1 + k :].reshape(k, k))


def summed_lanes(rows: DataFrame, judges: int, points: dict[int, np.ndarray], lanes: Callable[[pd.DataFrame, list[int]], Iterator[tuple[int, np.ndarray, np.ndarray]]]) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """``summed`` for several fits in one pass. ``lanes`` gives, for a batch of rows, (lane, places, weights) of the rows that a fit weighs. Sums are added up before they go to the driver."""
    k = len(next(iter(points.values())))
    size = 1 + k + k * k

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals = {lane: np.zeros(size) for lane in points}
        for frame in frames:
            args = _arguments(frame)
            for lane, at, weight in lanes(frame, list(points)):
                own = [points[lane], *(a[at] for a in args), judges, weight]
                value, grad = likelihood(*own)
                totals[lane] += np.concatenate([[value], grad, curvature(*own).ravel()])
        for lane, total in totals.items():
            yield pd.DataFrame({"lane": lane, "cell": np.arange(size), "s": total})

    totals = {lane: np.zeros(size) for lane in points}
    for r in rows.mapInPandas(run, "lane long, cell long, s double").groupBy("lane", "cell").agg(F.sum("s")).collect():
        totals[r[0]][r[1]] = r[2]
    return {lane: charged(points[lane], judges, t[0], t[1 : 1 + k], t[1 + k :].reshape(k, k)) for lane, t in totals.items()}


def charged(x: np.ndarray, judges: int, value: float, grad: np.ndarray, curve: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Value, gradient and curvature of the likelihood with those of the penalty."""
    more, pull = penalty(x, judges)
    steep = np.concatenate([(1 - np.exp(-_softplus(x[:N]))) ** 2, np.full(len(x) - N, 2e-4)])
    return value + more, grad + pull, curve + np.diag(steep)


def _search(x: np.ndarray, steps: int = 60, tolerance: float = 1e-6) -> Generator[np.ndarray, tuple[float, np.ndarray, np.ndarray], tuple[np.ndarray, float]]:
    """Damped Gauss-Newton steps that yield the points to be evaluated. Ends when a step can't gain a millionth of the value."""
    value, grad, curve = yield x
    damp = 1e-3
    for _ in range(steps):
        step = np.linalg.solve(curve + damp * np.diag(np.maximum(np.diag(curve), 1e-8)), grad)
        if grad @ step < tolerance * max(1.0, abs(value)):
            break
        got, new_grad, new_curve = yield x - step
        if got < value:
            x, value, grad, curve, damp = x - step, got, new_grad, new_curve, damp / 5
        else:
            damp *= 10
    return x, value


def newton_many(fun: Callable[[dict[int, np.ndarray]], dict[int, tuple[float, np.ndarray, np.ndarray]]], starts: dict[int, np.ndarray]) -> dict[int, tuple[np.ndarray, float]]:
    """(x, value) of several fits in step: each pass over the table evaluates the points of all fits that have not ended."""
    searches, found = {lane: _search(x) for lane, x in starts.items()}, {}
    points = {lane: next(search) for lane, search in searches.items()}
    while points:
        got, following = fun(points), {}
        for lane in points:
            try:
                following[lane] = searches[lane].send(got[lane])
            except StopIteration as end:
                found[lane] = end.value
        points = following
    return found


def newton(fun: Callable[[np.ndarray], tuple[float, np.ndarray, np.ndarray]], x: np.ndarray) -> tuple[np.ndarray, float]:
    """(x, value) after damped Gauss-Newton steps: some ten passes over the table, where each pass is a job."""
    return newton_many(lambda points: {0: fun(points[0])}, {0: x})[0]


def minimise(fun, x: np.ndarray, steps: int = 5000, memory: int = 10, tolerance: float = 1e-6) -> np.ndarray:
    """Limited-memory BFGS with backtracking."""
    value, grad = fun(x)
    s, y = [], []
    for _ in range(steps):
        if np.abs(grad).max() < tolerance:
            break
        q, saved = grad.copy(), []
        for a, b in zip(reversed(s), reversed(y)):
            k = (a @ q) / (a @ b)
            saved.append(k)
            q -= k * b
        q *= (s[-1] @ y[-1]) / (y[-1] @ y[-1]) if s else 1 / max(1.0, np.linalg.norm(grad))
        for (a, b), k in zip(zip(s, y), reversed(saved)):
            q += a * (k - (b @ q) / (a @ b))
        slope, step = grad @ q, 1.0
        if slope <= 0:
            q, slope = grad, grad @ grad
        while step > 1e-12:
            new = x - step * q
            got, new_grad = fun(new)
            if got <= value - 1e-4 * step * slope:
                break
            step /= 2
        else:
            break
        if (new - x) @ (new_grad - grad) > 1e-12:
            s, y = [*s, new - x][-memory:], [*y, new_grad - grad][-memory:]
        x, value, grad = new, got, new_grad
    return x


def start(judges: int) -> np.ndarray:
    return np.concatenate([np.log(np.expm1(np.array(vocab.THETA))), np.zeros(1 + 3 * judges)])


def fit(rows: pd.DataFrame, judges: int, warm: np.ndarray | None = None) -> np.ndarray:
    """Raw parameters that fit (d0..d10, extra, neg, judge, ord, answer, weight) rows of feature differences B - A."""
    args = [*_arguments(rows), judges, rows["weight"].to_numpy()]

    def fun(x: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        value, grad = likelihood(x, *args)
        return charged(x, judges, value, grad, curvature(x, *args))

    return newton(fun, start(judges) if warm is None else warm)[0]


def costs(x: np.ndarray) -> np.ndarray:
    return _softplus(x[:N])


@dataclass(frozen=True)
class Alternated:
    """Raw parameters, their objective under the matching that they make optimal, rounds taken, and how the rounds ended."""

    x: np.ndarray
    value: float
    rounds: int
    converged: bool = False
    cycled: bool = False


def alternate(solve: Callable[[np.ndarray], tuple[Callable, Hashable]], x: np.ndarray, descend: Callable, most: int = 20) -> Alternated:
    """Fits costs and matchings in turn: costs under fixed matchings, then matchings under the new costs.

    ``solve`` gives, for costs, the objective under the best matchings, and a signature of these; ``descend`` minimises such
    an objective from a point. Rounds end when the
    signature stays; if an earlier one comes back, or after ``most`` rounds, the parameters with the least objective under
    their own best matchings are returned.
    """
    fun, now = solve(costs(x))
    seen, best = {now}, None
    for turn in range(1, most + 1):
        x = descend(fun, x)
        fun, then = solve(costs(x))
        made = Alternated(x, fun(x)[0], turn, converged=then == now)
        if best is None or made.value < best.value:
            best = made
        if made.converged:
            return made
        if then in seen:
            return replace(best, rounds=turn, cycled=True)
        seen.add(then)
        now = then
    return replace(best, rounds=most)


def fit_alternating(solve: Callable[[np.ndarray], tuple[pd.DataFrame, Hashable]], answers: pd.DataFrame, judges: int, warm: np.ndarray | None = None, most: int = 20) -> Alternated:
    """``alternate`` over small tables: ``solve`` gives feature differences (triplet_id, d0..d10, extra, neg) and a signature. answers: (triplet_id, judge, ord, answer)."""

    def objectives(theta: np.ndarray) -> tuple[Callable, Hashable]:
        frame, signature = solve(theta)
        args = _arguments(answers.merge(frame, on="triplet_id"))
        return lambda x: objective(x, *args, judges), signature

    return alternate(objectives, start(judges) if warm is None else warm, minimise, most)


def fit_triplets(sources: DataFrame, variants: DataFrame, cells: DataFrame, answers: DataFrame, judges: int, warm: np.ndarray | None = None) -> Alternated:
    """``alternate`` over tables of any size: propositions are matched anew in tasks each round, and tasks sum the objective."""

    def objectives(theta: np.ndarray) -> tuple[Callable, Hashable]:
        found = matched(cells, theta.tolist())
        pair = found.agg(F.count("*"), F.bit_xor(F.xxhash64(KEY, "a", "b"))).first()
        rows = weighted(differences(found, sources, variants).join(answers, "triplet_id"))
        judged = written(rows, "judged")
        return lambda x: summed(judged, judges, x), tuple(pair)

    return alternate(objectives, start(judges) if warm is None else warm, lambda fun, x: newton(fun, x)[0])


# Kinds and strengths of changed propositions, least similarity to what they were, and the width above it; unrelated ones.
EDIT_SIMILARITY = {"P-para": {"weak": (0.9, 0.07), "medium": (0.83, 0.07), "strong": (0.75, 0.08)}, "P-shift": {"small": (0.6, 0.15), "medium": (0.45, 0.15), "large": (0.25, 0.2)}, "P-neg": {"": (0.85, 0.1)}}
UNRELATED = (0.1, 0.35)


def triplet_cells(sources: DataFrame, variants: DataFrame, seed: int = 23) -> DataFrame:
    """(cmp_id, a_pos, b_pos, a, b, cos): simulated similarity of each proposition of a variant to each of its source.

    sources: (triplet_id, source_id, props, links); variants: those of ``perturb``. Unchanged propositions have 1, changed
    ones a number by kind and strength, different ones a low number that all triplets of a source share.
    """
    paired = variants.join(sources.select("triplet_id", "source_id", F.col("props").alias("whole")), "triplet_id")
    a = paired.select(comparison(), "triplet_id", "source_id", "side", "log", "whole", F.posexplode("props").alias("a_pos", "a"))
    cells = a.select("*", F.posexplode("whole").alias("b_pos", "b"))
    edit = F.get(F.filter("log", lambda e: (e["b"] == F.col("a")) & e["a"].isin(*EDIT_SIMILARITY)), F.lit(0))
    own, u = F.lit(1.0), uniform(seed, F.col("triplet_id"), F.col("side"), F.col("a"))
    for kind, strengths in EDIT_SIMILARITY.items():
        for strength, (least, width) in strengths.items():
            own = F.when((edit["a"] == kind) & (edit["c"] == strength), least + width * u).otherwise(own)
    new = uniform(seed + 1, F.col("triplet_id"), F.col("side"), F.col("a"), F.col("b"))
    other = uniform(seed + 2, F.col("source_id"), F.least("a", "b"), F.greatest("a", "b"))
    low = UNRELATED[0] + UNRELATED[1] * F.when(F.array_contains("whole", F.col("a")), other).otherwise(new)
    return cells.select(KEY, "a_pos", "b_pos", "a", "b", F.when(F.col("a") == F.col("b"), own).otherwise(low).alias("cos"))


def comparison() -> Column:
    return F.concat_ws("|", "triplet_id", "side").alias(KEY)


def matched(cells: DataFrame, theta: list[float]) -> DataFrame:
    """(cmp_id, a, b, cos): best matching of each comparison under the costs, written once."""
    cos = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("cos")))
    priced = cells.withColumns({"cost": substitution(cos, theta), "delete": F.lit(theta[1]), "insert": F.lit(theta[0])}).drop("cos")
    return written(match(priced).select(KEY, "a", "b").join(cells.select(KEY, "a", "b", "cos"), [KEY, "a", "b"]), "matched")


def differences(matching: DataFrame, sources: DataFrame, variants: DataFrame) -> DataFrame:
    """(triplet_id, source_id, d0..d10, extra, neg): features of variant B less those of A, and negated propositions likewise."""
    whole = variants.select(comparison(), "triplet_id", "side", "props", "links", "log").join(sources.select("triplet_id", "source_id", F.col("props").alias("whole"), F.col("links").alias("all")), "triplet_id")
    props = lambda c: whole.select(KEY, F.explode(c).alias("prop_id"))
    edges = lambda c: whole.select(KEY, F.posexplode(c).alias("pos", "e")).select(KEY, "pos", F.col("e.a").alias("from_id"), F.col("e.b").alias("to_id"), F.col("e.c").alias("kind"))
    phi = features(matching, props("props"), props("whole"), edges("links"), edges("all"))
    each = whole.select(KEY, "triplet_id", "source_id", F.when(F.col("side") == "B", 1.0).otherwise(-1.0).alias("sign"), F.size(F.filter("log", lambda e: e["a"] == "P-neg")).alias("negated")).join(phi, KEY, "left").fillna(0.0)
    signed = lambda c, name: F.sum(F.col("sign") * F.col(c)).alias(name)
    return each.groupBy("triplet_id", "source_id").agg(*(signed(f"f{i}", f"d{i}") for i in range(N)), signed("edge_extra", "extra"), signed("negated", "neg"))


def _numbered(rows: DataFrame, *order: str) -> DataFrame:
    """rows with ``i``, their place in the order from 0 on, without one task that sorts all."""
    return running(rows.withColumn("one", F.lit(1).cast("long")), [], list(order), "one").select(*rows.columns, F.col("before").cast("long").alias("i"))


def cluster_draws(sources: DataFrame, replicates: int, seed: int = 11) -> DataFrame:
    """(rep, place, source_id): sources drawn with replacement; a source drawn twice is two clusters."""
    numbered = written(_numbered(sources.select("source_id"), "source_id"), "numbered")
    n = numbered.count()
    draws = numbered.select(F.col("i").alias("place"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(replicates - 1).cast("long"))).alias("rep"))
    return draws.select("rep", "place", F.pmod(draw(seed, F.col("rep"), F.col("place")), F.lit(max(1, n))).alias("i")).join(numbered, "i").select("rep", "place", "source_id")


def bootstrap_fits(rows: DataFrame, draws: DataFrame, judges: int, warm: np.ndarray) -> DataFrame:
    """(rep, param, value) of a fit for each replicate; a source drawn n times weighs n.

    All replicates are fitted in step: a row knows which replicates drew its source, and each pass over the table sums all of them, so no task holds a replicate.
    """
    times = draws.groupBy("rep", "source_id").agg(F.count("*").alias("times")).groupBy("source_id").agg(F.collect_list(F.struct(F.col("rep").cast("int").alias("rep"), F.col("times").cast("int").alias("times"))).alias("drawn"))
    table = written(weighted(rows, "source_id").join(times, "source_id").select("*", F.col("drawn.rep").alias("reps"), F.col("drawn.times").alias("times")).drop("drawn"), "drawn")
    reps = [r[0] for r in table.select(F.explode("reps").alias("rep")).distinct().collect()]

    def lanes(frame: pd.DataFrame, wanted: list[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        if len(frame):
            rep, row = np.concatenate(frame["reps"].to_list()), np.repeat(np.arange(len(frame)), frame["reps"].map(len))
            weight = np.concatenate(frame["times"].to_list()) * frame["weight"].to_numpy()[row]
            order = np.argsort(rep, kind="stable")
            rep, row, weight = rep[order], row[order], weight[order]
            for lane in wanted:
                a, b = np.searchsorted(rep, [lane, lane + 1])
                if a < b:
                    yield lane, row[a:b], weight[a:b]

    found = newton_many(lambda points: summed_lanes(table, judges, points, lanes), {rep: warm for rep in reps})
    return rows.sparkSession.createDataFrame([(rep, name, float(value)) for rep, (x, _) in found.items() for name, value in zip(vocab.PARAMETERS, costs(x))], "rep long, param string, value double")


def cross_validated(rows: DataFrame, judges: int, folds: int = 5, seed: int = 13) -> DataFrame:
    """(triplet_id, delta) of triplets left out of the fit; folds deal sources by the order of their draws. Folds are fitted in step by passes over the table, so no task holds a fold."""
    sources = rows.select("source_id").distinct().withColumn("h", draw(seed, F.col("source_id")))
    dealt = written(rows.join(_numbered(sources, "h", "source_id").select("source_id", F.pmod("i", F.lit(folds)).cast("int").alias("fold")), "source_id"), "dealt")
    table = written(weighted(dealt, "fold"), "folds")

    def lanes(frame: pd.DataFrame, wanted: list[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        for lane in wanted:
            at = np.flatnonzero(frame["fold"].to_numpy() != lane)
            yield lane, at, frame["weight"].to_numpy()[at]

    found = newton_many(lambda points: summed_lanes(table, judges, points, lanes), {fold: start(judges) for fold in range(folds)})
    delta = F.lit(None).cast("double")
    for fold, (x, _) in found.items():
        own = F.col("extra") + F.lit(float(x[N])) * F.col("neg")
        for i, value in enumerate(costs(x)):
            own = own + F.lit(float(value)) * F.col(f"d{i}")
        delta = F.when(F.col("fold") == fold, own).otherwise(delta)
    return dealt.dropDuplicates(["triplet_id"]).select("triplet_id", delta.alias("delta"))


def log_likelihoods(z: np.ndarray, t: np.ndarray, answer: np.ndarray) -> np.ndarray:
    """The log-likelihood of each row, as in ``likelihood``, without derivatives."""
    out = np.empty(len(z))
    lean, other, tie = (np.flatnonzero(answer == k) for k in range(3))
    out[lean], out[other] = -np.logaddexp(0, t[lean] - z[lean]), -np.logaddexp(0, z[other] + t[other])
    z, t = z[tie], t[tie]
    out[tie] = np.log(np.maximum(1 - 1 / (1 + np.exp(-np.clip(z - t, -500, 500))) - 1 / (1 + np.exp(-np.clip(-z - t, -500, 500))), 1e-12))
    return out


def profile(rows: DataFrame, x: np.ndarray, judges: int, points: int = 61, most: float = 3.0) -> DataFrame:
    """(param, value, nll): slices of the objective along each cost. Tasks sum the whole grid over their rows of a ``weighted`` table, so no task holds all.

    Along a cost only the rows that have its feature change, so only these are evaluated for each point.
    """
    grid = [(i, most * k / (points - 1)) for i in range(N) for k in range(points)]

    def at(i: int, value: float) -> np.ndarray:
        out = x.copy()
        out[i] = np.log(np.expm1(max(value, 1e-6)))
        return out

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(len(grid))
        theta, theta_neg, beta, tau, pi = _split(x, judges)
        for frame in frames:
            (phi, extra, neg, judge, order, answer), weight = _arguments(frame), frame["weight"].to_numpy()
            delta, steep, shift, t = phi @ theta + extra + theta_neg * neg, beta[judge], pi[judge] * order, tau[judge]
            still = weight * log_likelihoods(steep * delta + shift, t, answer)
            for i in range(N):
                own = np.flatnonzero(phi[:, i])
                rest = still.sum() - still[own].sum()
                d, f, s, h, u, w, said = delta[own], phi[own, i], steep[own], shift[own], t[own], weight[own], answer[own]
                for k in range(points):
                    moved = _softplus(at(i, grid[i * points + k][1])[i]) - theta[i]
                    total[i * points + k] -= rest + (w * log_likelihoods(s * (d + f * moved) + h, u, said)).sum()
        yield pd.DataFrame({"cell": np.arange(len(grid)), "nll": total})

    cells = rows.sparkSession.createDataFrame([(k, vocab.PARAMETERS[i], value, penalty(at(i, value), judges)[0]) for k, (i, value) in enumerate(grid)], "cell long, param string, value double, charged double")
    sums = rows.mapInPandas(run, "cell long, nll double").groupBy("cell").agg(F.sum("nll").alias("nll"))
    return cells.join(F.broadcast(sums), "cell").select("param", "value", (F.col("nll") + F.col("charged")).alias("nll"))


def rematch(costs_table: pd.DataFrame, theta: list[float]) -> pd.DataFrame:
    """Matched (cmp_id, a, b, cos) of complete (cmp_id, a, b, cos) tables under given costs."""
    out = []
    for key, cells in costs_table.groupby("cmp_id", sort=True):
        table = cells.pivot(index="a", columns="b", values="cos").sort_index().sort_index(axis=1)
        cos = np.clip(table.to_numpy(float), 0, 1)
        k = vocab.KNOTS
        sub = sum(theta[2 + i] * np.clip((k[i] - cos) / (k[i] - k[i + 1]), 0, 1) for i in range(4))
        got = bipartite_match(sub, np.full(len(cos), theta[1]), np.full(cos.shape[1], theta[0]))
        out += [(key, table.index[i], table.columns[j], cos[i, j]) for i, j in enumerate(got) if j >= 0]
    return pd.DataFrame(out, columns=["cmp_id", "a", "b", "cos"])


# Kinds of edits and their weights in contrast triplets; those that leave the graph as it is.
EDIT_WEIGHTS = {"P-para": 0.12, "P-shift": 0.12, "P-neg": 0.05, "P-del": 0.05, "P-add": 0.08, "P-del+R": 0.12, "R-del": 0.11, "R-add": 0.08, "R-type": 0.17, "R-rev": 0.08, "X-spk": 0.01, "X-surf": 0.01}
NO_GRAPH_CHANGE = ["X-spk", "X-surf"]
SAME_KIND = ["P-para", "P-shift", "P-del+R", "R-del", "R-type"]


def changes_graph(edits: Column) -> Column:
    """Whether an array of edit kinds has one that changes the graph."""
    return F.exists(edits, lambda e: ~e.isin(NO_GRAPH_CHANGE))


def edit_bounds() -> list[tuple[str, float]]:
    """(kind, upper end) of the kinds' pieces of [0, 1), in order; the last kind has what is left."""
    out, below = [], 0.0
    for kind, weight in EDIT_WEIGHTS.items():
        below = round(below + weight, 9)
        out.append((kind, below))
    return out


def edit_kind(u: Column) -> Column:
    """The kind of a uniform number, by the weights."""
    bounds = edit_bounds()
    out = F.lit(bounds[-1][0])
    for kind, above in reversed(bounds[:-1]):
        out = F.when(u < above, kind).otherwise(out)
    return out


def edit_plans(triplets: DataFrame, seed: int = 7) -> DataFrame:
    """(triplet_id, plan, side, step, kind): the kinds of both variants' edits; in T1, A's are the first of B's."""
    t = F.col("triplet_id")
    u = lambda k, *more: uniform(seed + k, t, *more)
    planned = plans(triplets, seed).withColumns({"na": F.when(F.col("plan") == "T1", 1 + F.floor(u(1) * 2)).when(F.col("plan") == "T3", 1 + F.floor(u(1) * 3)).otherwise(1).cast("int"), "more": F.floor(u(2) * F.when(F.col("plan") == "T1", 2).otherwise(3)).cast("int")})
    planned = planned.withColumn("nb", F.when(F.col("plan") == "T1", F.col("na") + 1 + F.col("more")).when(F.col("plan") == "T2", 2).when(F.col("plan") == "T3", 1 + F.col("more")).otherwise(1).cast("int"))
    each = planned.withColumn("side", F.explode(F.array(F.lit("A"), F.lit("B")))).withColumn("step", F.explode(F.sequence(F.lit(1), F.when(F.col("side") == "A", F.col("na")).otherwise(F.col("nb")))))
    drawn = F.when(F.col("plan") == "T1", edit_kind(u(3, F.col("step")))).otherwise(edit_kind(u(3, F.col("side"), F.col("step"))))
    same = F.element_at(F.array(*(F.lit(k) for k in SAME_KIND)), (1 + F.floor(u(4) * len(SAME_KIND))).cast("int"))
    kind = F.when(F.col("plan") == "T2", same).when(F.col("plan") == "T4", F.when(F.col("side") == "A", "X-surf").otherwise("X-spk")).otherwise(drawn)
    return each.select("triplet_id", "plan", "side", F.col("step").cast("long").alias("step"), kind.alias("kind"))


def edited(props: list[str], links: list[tuple[str, str, str]], kinds: list[str], random: np.random.Generator) -> tuple[list[str], list[tuple[str, str, str]], list[tuple[str, str, str]]]:
    """(propositions, links, log) after edits in turn; one without a target that no edit has touched is left out.

    The log has (kind, target, detail); targets of links read from>to.
    """
    props, links, log = list(props), list(links), []
    used, fixed = set(), set()
    choose = lambda options: options[int(random.integers(len(options)))] if options else None
    for kind in kinds:
        if kind in NO_GRAPH_CHANGE:
            log.append((kind, "", ""))
        elif kind in ("P-para", "P-shift", "P-neg"):
            target = choose([p for p in props if p not in used and not p.startswith("n")])
            if target is not None:
                detail = "" if kind == "P-neg" else choose(["weak", "medium", "strong"] if kind == "P-para" else ["small", "medium", "large"])
                used.add(target)
                log.append((kind, target, detail))
        elif kind in ("P-del", "P-del+R"):
            degree = {p: sum(p in (a, b) for a, b, _ in links) for p in props}
            target = choose([p for p in props if p not in used and (degree[p] == 0 if kind == "P-del" else 1 <= degree[p] <= 2)])
            if target is not None:
                props.remove(target)
                links = [x for x in links if target not in x[:2]]
                used.add(target)
                log.append((kind, target, ""))
        elif kind == "P-add":
            target = f"n{1 + sum(k == 'P-add' for k, _, _ in log)}"
            props.append(target)
            used.add(target)
            log.append((kind, target, ""))
        elif kind == "R-add":
            linked = {frozenset(x[:2]) for x in links}
            free = [p for p in props if p not in used]
            pair = choose([(a, b) for a in free for b in free if a != b and frozenset((a, b)) not in linked])
            if pair is not None:
                new = (*pair, choose(vocab.RELATION_TYPES))
                links.append(new)
                fixed.add(new)
                log.append((kind, f"{new[0]}>{new[1]}", new[2]))
        else:
            old = choose([x for x in links if x not in fixed])
            if old is not None:
                at, new = links.index(old), None
                if kind == "R-type":
                    new = (old[0], old[1], choose([k for k in vocab.RELATION_TYPES if k != old[2]]))
                elif kind == "R-rev":
                    new = (old[1], old[0], old[2])
                links[at : at + 1] = [new] if new else []
                fixed |= {new} if new else set()
                log.append((kind, f"{old[0]}>{old[1]}", new[2] if kind == "R-type" else old[2]))
    return props, links, log


def perturb(graphs: DataFrame, edits: DataFrame, seed: int = 19) -> DataFrame:
    """(triplet_id, side, props, links, log) of plans (triplet_id, plan, side, step, kind) on graphs (triplet_id, props, links).

    Both variants of a T1 triplet draw alike, as A's edits are the first of B's; those of other plans draw apart. Edits of a variant depend on those before them, so each variant is worked off in turn; variants are packed into tasks.
    """
    ordered = edits.groupBy("triplet_id", "plan", "side").agg(F.array_sort(F.collect_list(F.struct("step", "kind"))).alias("kinds")).join(graphs, "triplet_id")
    text = "array<struct<a string, b string, c string>>"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for t, plan, side, kinds, props, links in zip(*(frame[c] for c in ("triplet_id", "plan", "side", "kinds", "props", "links"))):
                own = 0 if plan == "T1" or side == "A" else 1
                got = edited(list(props), [(x["a"], x["b"], x["c"]) for x in links], [k["kind"] for k in kinds], np.random.default_rng((seed, int(t), own)))
                pack = lambda xs: [{"a": a, "b": b, "c": c} for a, b, c in xs]
                rows.append((t, side, got[0], pack(got[1]), pack(got[2])))
            yield pd.DataFrame(rows, columns=["triplet_id", "side", "props", "links", "log"])

    return ordered.mapInPandas(run, f"triplet_id long, side string, props array<string>, links {text}, log {text}")


def instruction(kind: Column, target: Column, detail: Column) -> Column:
    """What a writer is told to do for an edit."""
    source, goal = F.substring_index(target, ">", 1), F.substring_index(target, ">", -1)
    texts = {
        "P-para": F.format_string("Say %s in other words (%s), with the same meaning.", target, detail),
        "P-shift": F.format_string("Make %s a different claim on its topic (%s change) and keep its relations.", target, detail),
        "P-neg": F.format_string("Turn %s into its negation and change nothing else.", target),
        "P-del": F.format_string("Take %s out.", target),
        "P-del+R": F.format_string("Take %s out, and every relation that it has.", target),
        "P-add": F.format_string("Add %s, a claim on the topic that is related to nothing.", target),
        "R-del": F.format_string("Leave %s and %s as they are, but no longer related.", source, goal),
        "R-add": F.format_string("Relate %s to %s as %s, claims unchanged.", source, goal, detail),
        "R-type": F.format_string("Make the relation of %s to %s one of type %s.", source, goal, detail),
        "R-rev": F.format_string("Swap the ends of the relation of %s to %s.", source, goal),
        "X-spk": F.lit("Exchange the speakers."),
        "X-surf": F.lit("Reword an utterance; claims and relations stay."),
    }
    out = F.lit("")
    for name, text in texts.items():
        out = F.when(kind == name, text).otherwise(out)
    return out


def problems(checked: Column, realized: Column, unintended: Column, naturalness: Column) -> Column:
    """The list of what is wrong with a checked edit."""
    return F.array_compact(F.array(F.when(~checked, "unchecked"), F.when(checked & ~realized, "unrealized"), F.when(unintended > 0, "unintended"), F.when(naturalness < 3, "unnatural")))


def unrealized(variants: DataFrame) -> DataFrame:
    """(kind, n, same): variants with an edit of this kind, and those whose text stayed as it was. variants: (triplet_id, side, kinds, same)."""
    each = variants.select("same", F.explode(F.array_distinct("kinds")).alias("kind")).filter("kind <> 'X-spk'")
    return each.groupBy("kind").agg(F.count("*").alias("n"), F.count_if("same").alias("same"))


def verified(variants: DataFrame) -> DataFrame:
    """(kind, n, first, again, failed) of (kinds, tries, passed): passed at the first try, at a later one, never."""
    each = variants.select("tries", "passed", F.explode(F.array_distinct("kinds")).alias("kind"))
    return each.groupBy("kind").agg(F.count("*").alias("n"), F.count_if(F.col("passed") & (F.col("tries") == 1)).alias("first"), F.count_if(F.col("passed") & (F.col("tries") > 1)).alias("again"), F.count_if(~F.col("passed")).alias("failed"))


def allocation_hits(triplets: DataFrame, near: float = 0.5) -> DataFrame:
    """(near_target, n, hit): how often triplets meant to be near have a difference below ``near``, and others not. triplets: (near_target, delta)."""
    return triplets.filter("near_target IS NOT NULL").groupBy("near_target").agg(F.count("*").alias("n"), F.count_if((F.abs("delta") < near) == F.col("near_target")).alias("hit"))


def answers_by_plan(judgments: DataFrame, planned: DataFrame) -> DataFrame:
    """(plan, answer, n) of judgments by the type of their triplets."""
    return judgments.join(planned, "triplet_id").groupBy("plan", "answer").agg(F.count("*").alias("n"))


def map_answer(raw: Column, order: Column) -> Column:
    """0: A, 1: B, 2: tie, of an answer (first, second, tie) that saw A first if order is 1."""
    return F.when(raw == "tie", 2).when((raw == "first") == (order == 1), 0).otherwise(1)
