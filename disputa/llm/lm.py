"""Scores of texts under a gated recurrent language model with a class-factored output.

Tokens are lower-case (A-Z only) words without white space and one end. Counts cover every training text. The network
predicts the ``HEADS`` most frequent tokens one by one and all others as one of eight shapes (by last byte and by
whether non-ASCII bytes occur); inside a shape the smoothed counts decide, so probabilities cover the whole
vocabulary and one unseen token for each shape. Weights are trained by truncated backpropagation in numpy on every
training text: a first network from a bounded sample, where training starts, is sent to all shards of these texts, each
shard trains it on its own texts, and the weights are averaged by tokens. Texts are dealt to shards of about ``SHARD``
tokens by hash, so shards grow in number with the corpus and weights do not depend on how the table is stored. Scoring
runs many texts side by side and carries each one's state from window to window until its end.

Counts of the ``COMMON`` most frequent tokens go with the tasks (a fixed size); counts of all others are joined by
token in a shuffle, so no table that grows with the corpus is broadcast or collected.

Defined results: a null or empty text is one end token; repeated rows give repeated rows; a null id counts as the
empty text for the split; extra columns do not matter; without training texts, counts are 0 and the network untrained.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from disputa.llm.common import Scratch, bounded, fold_case, mix, remainder, runs, span_hashes, steps, table, utf8, words

#: Outputs of the network: single tokens in classes of equal size, and shapes of all other tokens, each a class of its own.
HEADS, SHAPES, CLASSES = 4096, 8, 32
MEMBERS = HEADS // CLASSES
#: Tokens whose counts are sent to every task.
COMMON = 1 << 17
#: Texts of the first network at most, those with the lowest hash of the id; passes over them.
FIT_ROWS, EPOCHS = 1500, 2
#: Tokens of a shard, its lanes (fewer in a small one, for enough steps) and its rate; weights of a row of sums.
SHARD, SHARD_LANES, SHARD_RATE, CHUNK = 1 << 21, 512, 0.01, 4096
HIDDEN, WINDOW, LANES, RATE, SEED = 16, 16, 48, 0.02, 7
#: Texts scored side by side; steps after which outputs are computed for all of them.
SCORE_LANES, SCORE_WINDOW = 512, 16
#: Size of a table of heads (a power of 2).
PLACES = 1 << 18
#: States whose outputs are computed at once, few enough for a processor's cache.
ROWS = 256
END = int(mix(np.array([0xE17D], np.uint64)).view(np.int64)[0])


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(token hashes with an end after each text, shapes, offsets of the texts)."""
    data, spans = utf8(texts)
    data = fold_case(data)
    starts, ends, first = words(data, spans)
    hashes = span_hashes(data, starts, ends).view(np.int64)
    wide = np.concatenate(([0], np.cumsum(data > 127)))
    last = data[ends - 1] if len(ends) else data[:0]
    plain = ((last >= 97) & (last <= 122)) | (last > 127) | ((last >= 48) & (last <= 57))
    shape = np.where(plain, 0, np.where(last == 46, 1, np.where(last == 44, 2, 3))) + 4 * (wide[ends] > wide[starts])
    offsets = first + np.arange(len(first))
    out, shapes = np.full(offsets[-1], END), np.zeros(offsets[-1], np.int8)
    at = np.arange(len(hashes)) + np.repeat(np.arange(len(spans) - 1), np.diff(first))
    out[at], shapes[at] = hashes, shape
    return out, shapes, offsets


def count(docs: DataFrame) -> DataFrame:
    """(token, shape, n) over all texts, summed in each task before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[np.ndarray, ...]] = []

        def merged() -> tuple[np.ndarray, ...]:
            keys, shapes, n = (np.concatenate(x) for x in zip(*found))
            unique, index, inverse = np.unique(keys, return_index=True, return_inverse=True)
            return unique, shapes[index], np.bincount(inverse, n, len(unique)).astype(np.int64)

        def rows() -> Iterator[pa.RecordBatch]:
            arrays = merged()
            for at in range(0, len(arrays[0]), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(a[at : at + (1 << 16)]) for a in arrays], names=["token", "shape", "n"])

        for batch in batches:
            for part in steps(batch):
                hashes, shapes, _ = tokens(part.column("text"))
                unique, index, n = np.unique(hashes, return_index=True, return_counts=True)
                found.append((unique, shapes[index], n))
                if sum(len(f[0]) for f in found) > 1 << 21:
                    found = [merged()]
                    if len(found[0][0]) > 1 << 20:
                        yield from rows()
                        found = []
        if found:
            yield from rows()

    return bounded(docs).select("text").mapInArrow(run, "token long, shape byte, n long").groupBy("token").agg(F.min("shape").alias("shape"), F.sum("n").alias("n"))


@dataclass
class Network:
    """heads: hashes of the single outputs; weights by name."""

    heads: np.ndarray
    w: dict[str, np.ndarray] = field(default_factory=dict)

    def __post_init__(self) -> None:
        # Tables from bits of a hash to the head that has them; heads whose place is taken go to the next table.
        self.places, left, shift = [], np.arange(len(self.heads)), 0
        while len(left):
            found, at = np.zeros(PLACES, np.int16), self._place(self.heads[left], shift)
            found[at] = left
            self.places.append((shift, found))
            left, shift = left[found[at] != left], (shift + 18) % 64
        if not self.w:
            random, size = np.random.default_rng(SEED), HEADS + SHAPES
            self.w = {"x": random.normal(0, 0.3, (size, 3 * HIDDEN)), "u": random.normal(0, 0.3, (HIDDEN, 2 * HIDDEN)), "v": random.normal(0, 0.3, (HIDDEN, HIDDEN)), "c": random.normal(0, 0.1, (HIDDEN, CLASSES + SHAPES)), "cb": np.zeros(CLASSES + SHAPES), "m": random.normal(0, 0.1, (CLASSES, HIDDEN, MEMBERS)), "mb": np.zeros((CLASSES, MEMBERS))}
            self.w = {k: v.astype(np.float32) for k, v in self.w.items()}

    def outputs(self, hashes: np.ndarray, shapes: np.ndarray) -> np.ndarray:
        """The output that stands for each token: its own, or that of its shape."""
        out = (HEADS + shapes.astype(np.int64)).astype(np.int16)
        for shift, found in self.places:
            at = found[self._place(hashes, shift)]
            out = np.where(self.heads[at] == hashes, at, out)
        return out

    @staticmethod
    def _place(hashes: np.ndarray, shift: int) -> np.ndarray:
        return (hashes >> shift) & (PLACES - 1)


def _gates(w: dict[str, np.ndarray], given: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(inputs of update, reset and candidate by step and lane, weights of the state for update and reset), each part contiguous; update and reset halved, as a sigmoid is half a hyperbolic tangent of the half."""
    x = w["x"].take(given.reshape(-1), 0).reshape(-1, 3, HIDDEN).transpose(1, 0, 2).reshape(3, *given.shape, HIDDEN)
    x[:2] *= np.float32(0.5)
    return x, w["u"].reshape(HIDDEN, 2, HIDDEN).transpose(1, 0, 2) * np.float32(0.5)


def _step(h: np.ndarray, x: np.ndarray, u: np.ndarray, v: np.ndarray, zr: np.ndarray, reset: np.ndarray, candidate: np.ndarray, move: np.ndarray, out: np.ndarray) -> None:
    """The state ``out`` after ``h`` and the inputs ``x`` of one step (see ``_gates``); gates, reset state, candidate and move are kept."""
    np.matmul(h, u, out=zr)
    zr += x[:2]
    np.tanh(zr, out=zr)
    zr *= np.float32(0.5)
    zr += np.float32(0.5)
    np.multiply(zr[1], h, out=reset)
    np.matmul(reset, v, out=candidate)
    candidate += x[2]
    np.tanh(candidate, out=candidate)
    np.subtract(candidate, h, out=move)
    np.multiply(zr[0], move, out=out)
    out += h


def _given(grid: np.ndarray, begin: np.ndarray, at: int, size: int, live: int) -> np.ndarray:
    """What comes before each output of a window of a grid by step and lane: the output before it, or the first shape where a text begins or a lane has ended."""
    given = np.full((size, live), HEADS, np.int64)
    skip = 1 if at == 0 else 0
    given[skip:] = grid[at + skip - 1 : at + size - 1, :live]
    given[begin[at : at + size, :live] | (given < 0)] = HEADS
    return given


def _outputs(w: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """The weights with the bias as a last row, less what no logit of a state, whose values are within -1 and 1, is above; of one class or of many."""
    return np.concatenate((w, (bias - (bias + np.abs(w).sum(-2)).max(-1, keepdims=True))[..., None, :]), -2).astype(np.float32)


def _log_probability(flat: np.ndarray, target: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Log-probability of one target of each state (its last value is 1) under ``_outputs``."""
    out, ones, rows = np.empty(len(flat), np.float32), np.ones(w.shape[1], np.float32), np.arange(ROWS)
    for at in range(0, len(flat), ROWS):
        x = flat[at : at + ROWS] @ w
        own = x[rows[: len(x)], target[at : at + ROWS]]
        np.exp(x, out=x)
        out[at : at + ROWS] = own - np.log(np.maximum(x @ ones, np.float32(1e-37)))
    return out


def _gradients(flat: np.ndarray, target: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(gradient of ``_outputs``, gradient of each state) of the negative log-probability of one target of each state."""
    grad, back, ones, rows = np.zeros_like(w), np.empty((len(flat), HIDDEN), np.float32), np.ones(w.shape[1], np.float32), np.arange(ROWS)
    turned = np.ascontiguousarray(w[:HIDDEN].T)
    for at in range(0, len(flat), ROWS):
        own = flat[at : at + ROWS]
        x = own @ w
        np.exp(x, out=x)
        total = np.maximum(x @ ones, np.float32(1e-37))
        x[rows[: len(x)], target[at : at + ROWS]] -= total
        share = (np.float32(1) / total)[:, None]
        grad += (own * share).T @ x
        np.multiply(x @ turned, share, out=back[at : at + ROWS])
    return grad, back


def _factored(target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(class, member of the class) of outputs; shapes have no members."""
    return np.where(target < HEADS, target // MEMBERS, target - HEADS + CLASSES), target % MEMBERS


def _by_class(klass: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """(order by class of the outputs that are single tokens, cuts between classes)."""
    order = np.argsort(klass.astype(np.int16), kind="stable")
    cut = np.searchsorted(klass[order], np.arange(CLASSES + 1)).tolist()
    return order[: cut[-1]], cut


def lanes(lengths: np.ndarray, n: int) -> list[list[int]]:
    """Texts dealt to ``n`` lanes, longest first, each to the lane with the least so far."""
    import heapq

    heap = [(0, k) for k in range(n)]
    out: list[list[int]] = [[] for _ in range(n)]
    for i in np.argsort(-lengths, kind="stable").tolist():
        load, k = heapq.heappop(heap)
        out[k].append(i)
        heapq.heappush(heap, (load + int(lengths[i]), k))
    return out


def _grid(outputs: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(outputs, index of the text, whether a text begins) by lane and step, -1 where a lane has ended; longest lanes first."""
    lengths = np.diff(offsets)
    dealt = [x for x in lanes(lengths, min(n, max(1, len(lengths)))) if x]
    dealt.sort(key=lambda x: -int(lengths[x].sum()))
    width = int(lengths[dealt[0]].sum()) if dealt else 0
    grid, owner, begin = np.full((len(dealt), width), -1, np.int16), np.full((len(dealt), width), -1, np.int32), np.zeros((len(dealt), width), bool)
    for k, texts in enumerate(dealt):
        at = 0
        for i in texts:
            size = int(lengths[i])
            grid[k, at : at + size], owner[k, at : at + size], begin[k, at] = outputs[offsets[i] : offsets[i + 1]], i, True
            at += size
    return grid, owner, begin


def score(net: Network, outputs: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Natural log-probability of each text's outputs, states carried through whole texts."""
    grid, owner, begin = _grid(outputs, offsets, SCORE_LANES)
    live_until = (grid >= 0).sum(1)
    grid, owner, begin = (np.ascontiguousarray(x.T) for x in (grid, owner, begin))
    result, w = np.zeros(len(offsets) - 1), net.w
    classes, members = _outputs(w["c"], w["cb"]), _outputs(w["m"], w["mb"])
    h = np.zeros((grid.shape[1], HIDDEN), np.float32)
    for at in range(0, len(grid), SCORE_WINDOW):
        live = int(np.searchsorted(-live_until, -at, "left"))  # lanes that still have tokens here
        size = min(SCORE_WINDOW, len(grid) - at)
        states = np.ones((size, live, HIDDEN + 1), np.float32)
        h = h[:live].copy()
        x, u = _gates(w, _given(grid, begin, at, size, live))
        zr, (reset, candidate, move, after) = np.empty((2, live, HIDDEN), np.float32), np.empty((4, live, HIDDEN), np.float32)
        for t in range(size):
            h[begin[at + t, :live]] = 0
            _step(h, x[:, t], u, w["v"], zr, reset, candidate, move, after)
            h, after = after, h
            states[t, :, :HIDDEN] = h
        target, whose = grid[at : at + size, :live].reshape(-1), owner[at : at + size, :live].reshape(-1)
        used = np.flatnonzero(target >= 0)
        flat, target, whose = states.reshape(-1, HIDDEN + 1)[used], target[used].astype(np.int64), whose[used]
        klass, member = _factored(target)
        logp = _log_probability(flat, klass, classes)
        order, cut = _by_class(klass)
        flat, member, inner = flat[order], member[order], np.empty(len(order), np.float32)
        for k in range(CLASSES):
            if cut[k] < cut[k + 1]:
                own = slice(cut[k], cut[k + 1])
                inner[own] = _log_probability(flat[own], member[own], members[k])
        logp[order] += inner
        result += np.bincount(whose, logp, len(result))
    return result


def train(net: Network, texts: list[np.ndarray], totals: np.ndarray | None, lanes: int = LANES, epochs: int = EPOCHS, top_rate: float = RATE) -> Network:
    """Truncated backpropagation through windows, Adam steps; output biases start from the corpus counts ``totals``, if given."""
    w = net.w
    if totals is not None:
        share, shapes = np.maximum(totals[:HEADS], 0.5).reshape(CLASSES, MEMBERS), np.maximum(totals[HEADS:], 0.5)
        classes = np.concatenate((share.sum(1), shapes))
        w["cb"] = np.log(classes / classes.sum()).astype(np.float32)
        w["mb"] = np.log(share / share.sum(1, keepdims=True)).astype(np.float32)
    if not texts:
        return net
    offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    grid, _, begin = _grid(np.concatenate(texts), offsets, lanes)
    live_until = (grid >= 0).sum(1)
    grid, begin = np.ascontiguousarray(grid.T), np.ascontiguousarray(begin.T)
    first, second, step = {k: np.zeros_like(v) for k, v in w.items()}, {k: np.zeros_like(v) for k, v in w.items()}, 0
    H = HIDDEN
    total_steps = epochs * -(-len(grid) // WINDOW)
    for _ in range(epochs):
        h = np.zeros((grid.shape[1], H), np.float32)
        for at in range(0, len(grid), WINDOW):
            live = int(np.searchsorted(-live_until, -at, "left"))  # the others have ended: nothing is to be learnt from them
            size = min(WINDOW, len(grid) - at)
            grads = {k: np.zeros_like(v) for k, v in w.items() if k in ("m", "mb")}
            starts = begin[at : at + size, :live]
            given = _given(grid, begin, at, size, live)
            x, u = _gates(w, given)
            zr, (old, reset, candidate, move) = np.empty((2, size, live, H), np.float32), np.empty((4, size, live, H), np.float32)
            states, h = np.ones((size, live, H + 1), np.float32), h[:live]
            for t in range(size):
                np.multiply(h, ~starts[t][:, None], out=old[t])
                h = np.empty_like(h)
                _step(old[t], x[:, t], u, w["v"], zr[:, t], reset[t], candidate[t], move[t], h)
                states[t, :, :H] = h
            target = grid[at : at + size, :live].astype(np.int64)
            used = np.nonzero(target >= 0)
            flat, goal = states[used], target[used]
            if not len(goal):
                break
            (klass, member), n = _factored(goal), len(goal)
            got, dflat = _gradients(flat, klass, _outputs(w["c"], w["cb"]))
            grads["c"], grads["cb"] = got[:H] / n, got[H] / n
            order, cut = _by_class(klass)
            inner, member, dinner, members = flat[order], member[order], np.empty((len(order), H), np.float32), _outputs(w["m"], w["mb"])
            for k in range(CLASSES):
                if cut[k] < cut[k + 1]:
                    own = slice(cut[k], cut[k + 1])
                    got, dinner[own] = _gradients(inner[own], member[own], members[k])
                    grads["m"][k], grads["mb"][k] = got[:H] / n, got[H] / n
            dflat[order] += dinner
            dstates = np.zeros((size, live, H), np.float32)
            dstates[used] = dflat / n
            # What a gradient of the state is multiplied by for that of each gate and of the state before.
            (z, r), dx = zr, np.empty((3, size, live, H), np.float32)
            keep = 1 - z
            by_z, by_r, by_candidate = move * z * keep, old * r * (1 - r), z * (1 - candidate * candidate)
            dh, vt, ut = np.zeros_like(h), np.ascontiguousarray(w["v"].T), np.ascontiguousarray(w["u"].T).reshape(2, H, H)
            for t in reversed(range(size)):
                dh += dstates[t]
                np.multiply(dh, by_candidate[t], out=dx[2, t])
                drh = dx[2, t] @ vt
                np.multiply(dh, by_z[t], out=dx[0, t])
                np.multiply(drh, by_r[t], out=dx[1, t])
                dh *= keep[t]
                drh *= r[t]
                dh += drh
                back = np.matmul(dx[:2, t], ut)
                dh += back[0]
                dh += back[1]
                dh *= ~starts[t][:, None]
            dx = dx.reshape(3, -1, H)
            grads["u"] = np.concatenate(np.matmul(old.reshape(-1, H).T, dx[:2]), 1)
            grads["v"] = reset.reshape(-1, H).T @ dx[2]
            used_rows, place = np.flatnonzero(np.bincount(given.reshape(-1))), np.empty(HEADS + SHAPES, np.int64)
            place[used_rows] = np.arange(0, len(used_rows) * H, H)
            place = (place[given.reshape(-1)][:, None] + np.arange(H)).reshape(-1)
            grads["x"] = np.concatenate([np.bincount(place, d.reshape(-1), len(used_rows) * H).reshape(-1, H) for d in dx], 1).astype(np.float32)
            step += 1
            rate = top_rate * (1 - step / (total_steps + 1))
            norm = math.sqrt(sum(float(np.vdot(g, g)) for g in grads.values()))
            scale, tiny = np.float32(min(1.0, 1.0 / max(norm, 1e-12))), np.float32(1e-6)
            for k, g in grads.items():
                at_rows = used_rows if k == "x" else slice(None)  # inputs that did not occur stay as they are
                g *= scale
                one, two = first[k][at_rows], second[k][at_rows]
                one *= np.float32(0.9)
                one += np.float32(0.1) * g
                g *= g
                g *= np.float32(0.01)
                two *= np.float32(0.99)
                two += g
                if k == "x":
                    first[k][at_rows], second[k][at_rows] = one, two
                np.divide(two, np.float32(1 - 0.99**step), out=g)
                np.sqrt(g, out=g)
                g += tiny
                np.divide(one, g, out=g)
                g *= np.float32(rate / (1 - 0.9**step))
                w[k][at_rows] -= g
    return net


def train_shards(training: DataFrame, net: Network, tokens_all: int) -> Network:
    """The average, by tokens, of the networks that shards of all (doc_id, text) rows make of ``net``; only sums of weights reach the driver."""
    spark = training.sparkSession
    shards = max(1, round(tokens_all / SHARD))
    shared = spark.sparkContext.broadcast(net)
    names = sorted(net.w)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            for part in steps(batch):
                hashes, shapes, offsets = tokens(part.column("text"))
                out = own.outputs(hashes, shapes)
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array([out[a:b].tobytes() for a, b in zip(offsets, offsets[1:])], pa.binary())], names=["doc_id", "outputs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for rows in runs(batches, ["shard"]):
            texts = [np.frombuffer(x, np.int16) for x in rows.column("outputs").to_pylist()]
            n = sum(len(t) for t in texts)
            made = train(Network(own.heads, {k: v.copy() for k, v in own.w.items()}), texts, None, min(SHARD_LANES, max(8, n // (200 * WINDOW))), 1, SHARD_RATE)
            flat = np.concatenate([made.w[k].reshape(-1) for k in names]).astype(np.float64) * n
            cuts = range(0, len(flat), CHUNK)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(cuts))), pa.array([rows.column("shard")[0].as_py()] * len(cuts), pa.int64()), pa.array([n] * len(cuts), pa.int64()), pa.array([flat[a : a + CHUNK].tobytes() for a in cuts], pa.binary())], names=["chunk", "shard", "n", "sums"])

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in runs(batches, ["chunk"]):
            sums = sum(np.frombuffer(x.as_py(), np.float64) for x in rows.column("sums"))
            yield pa.RecordBatch.from_arrays([rows.column("chunk").slice(0, 1).combine_chunks(), pa.array([(sums / sum(rows.column("n").to_pylist())).tobytes()], pa.binary())], names=["chunk", "weights"])

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    coded = bounded(training).select("doc_id", "text").mapInArrow(encode, "doc_id long, outputs binary").withColumn("draw", F.xxhash64("doc_id", "outputs")).withColumn("shard", F.pmod("draw", F.lit(shards)))
    made = coded.repartition(max(parts, shards), "shard").sortWithinPartitions("shard", "draw").select("shard", "outputs").mapInArrow(run, "chunk long, shard long, n long, sums binary")
    got = made.repartition(min(parts, 16), "chunk").sortWithinPartitions("chunk", "shard").mapInArrow(total, "chunk long, weights binary").toArrow().sort_by("chunk")
    if not got.num_rows:
        return net
    flat, at, w = np.concatenate([np.frombuffer(x, np.float64) for x in got.column("weights").to_pylist()]), 0, {}
    for k in names:
        w[k] = flat[at : at + net.w[k].size].reshape(net.w[k].shape).astype(np.float32)
        at += net.w[k].size
    return Network(net.heads, w)


@dataclass
class Model:
    """The network, the counts of the common tokens (sorted by hash) and the totals of the corpus."""

    net: Network
    common: np.ndarray
    common_n: np.ndarray
    n: int
    v: int
    shape_n: np.ndarray
    shape_v: np.ndarray

    @property
    def base_total(self) -> float:
        return math.log10(self.n + 0.5 * (self.v + 1))

    def shape_totals(self) -> np.ndarray:
        return np.log10(self.shape_n + 0.5 * (self.shape_v + 1))


def fit(training: DataFrame, counts: DataFrame, fit_rows: int = FIT_ROWS) -> Model:
    """The model of (doc_id, text) rows whose ``count`` table is ``counts``."""
    spark = training.sparkSession
    top = counts.orderBy(F.desc("n"), "token").limit(COMMON).toArrow()
    token, n = top.column("token").to_numpy(), top.column("n").to_numpy()
    heads = np.concatenate((token[:HEADS], token[:0]))
    if END in token and END not in heads:
        heads = np.append(heads[: HEADS - 1], END)
    head_n = dict(zip(token.tolist(), n.tolist()))
    own = [head_n[h] for h in heads.tolist()]
    # By shape: tokens and distinct tokens that aren't outputs of their own.
    is_head = F.col("token").isin(heads.tolist()) if len(heads) else F.lit(False)
    totals = {r[0]: (r[1], r[2], r[3], r[4]) for r in counts.groupBy("shape").agg(F.sum("n"), F.count("*"), F.coalesce(F.sum(F.when(~is_head, F.col("n"))), F.lit(0)), F.count(F.when(~is_head, 1))).collect()}
    shape_n, shape_v = (np.array([totals.get(k, (0, 0, 0, 0))[i] for k in range(SHAPES)], np.float64) for i in (2, 3))
    net = Network(heads)
    chosen = {r[0] for r in training.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows).collect()}
    shared = spark.sparkContext.broadcast((chosen, heads))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, own_heads = shared.value
        own_net = Network(own_heads)
        for batch in batches:
            kept = batch.filter(pa.array([i in ids for i in batch.column("doc_id").to_pylist()], pa.bool_()))
            for part in steps(kept):
                hashes, shapes, offsets = tokens(part.column("text"))
                out = own_net.outputs(hashes, shapes)
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array([out[a:b].tobytes() for a, b in zip(offsets, offsets[1:])], pa.binary())], names=["doc_id", "outputs"])

    got = training.select("doc_id", "text").mapInArrow(run, "doc_id long, outputs binary").groupBy("doc_id").agg(F.min("outputs").alias("outputs")).toArrow().sort_by("doc_id")
    size = np.zeros(HEADS + SHAPES)
    size[: len(own)], size[HEADS:] = own, shape_n
    train(net, [np.frombuffer(x, np.int16) for x in got.column("outputs").to_pylist()], size)
    net = train_shards(training, net, int(sum(t[0] for t in totals.values())))
    order = np.argsort(token, kind="stable")
    return Model(net, token[order], n[order], int(sum(t[0] for t in totals.values())), int(sum(t[1] for t in totals.values())), shape_n, shape_v)


PARTS = "doc_id long, sig long, token long, rows long, n_tokens long, n_known long, base double, score double, shape byte, n long"


def scores(docs: DataFrame, model: Model, counts: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score), a row for each row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        names = [f.split()[0] for f in PARTS.split(", ")]
        shape_totals = own.shape_totals()
        held: list[tuple] = []
        pending = 0

        def scored() -> pa.RecordBatch:
            outputs = np.concatenate([x[4] for x in held])
            cut = np.concatenate(([0], np.cumsum(np.concatenate([x[2] for x in held]))))
            logp = score(own.net, outputs, cut) / math.log(10)
            k = len(logp)
            sums = [np.concatenate([x[3][i] for x in held]) for i in range(3)]
            return pa.RecordBatch.from_arrays([pa.concat_arrays([x[0] for x in held]), pa.array(np.concatenate([x[1] for x in held])), pa.nulls(k, pa.int64()), pa.array(np.ones(k, np.int64)), pa.array(np.diff(cut)), pa.array(sums[0].astype(np.int64)), pa.array(sums[1]), pa.array(sums[2] + logp), pa.nulls(k, pa.int8()), pa.nulls(k, pa.int64())], names=names)

        for batch in batches:
            for part in steps(batch):
                hashes, shapes, offsets = tokens(part.column("text"))
                unique, index, inverse = np.unique(hashes, return_index=True, return_inverse=True)
                shape = shapes[index].astype(np.int64)
                out = own.net.outputs(unique, shape)
                at = np.minimum(np.searchsorted(own.common, unique), max(0, len(own.common) - 1))
                known = own.common[at] == unique if len(own.common) else np.zeros(len(unique), bool)
                c = own.common_n[at] if len(own.common) else np.zeros(len(unique))
                base = np.where(known, np.log10(c + 0.5) - own.base_total, 0.0)
                rest = np.where(known & (out >= HEADS), np.log10(c + 0.5) - shape_totals[shape], 0.0)
                n = part.num_rows
                whose = np.repeat(np.arange(n), np.diff(offsets))
                sums = [np.bincount(whose, x[inverse], n) for x in (known, base, rest)]
                text_sig = np.bincount(whose, minlength=n).astype(np.uint64)
                if len(hashes):
                    text_sig = mix(np.add.reduceat(mix(hashes.view(np.uint64)) * (2 * (np.arange(len(hashes)) - offsets[whose]).astype(np.uint64) + np.uint64(1)), offsets[:-1]) + text_sig)
                held.append((part.column("doc_id").cast(pa.int64()), text_sig.view(np.int64), np.diff(offsets), sums, out[inverse]))
                pending += len(hashes)
                # Tokens beyond the common ones: one row for each text and token, to be joined with their counts.
                far = np.flatnonzero(~known[inverse])
                if len(far):
                    pair = whose[far] * len(unique) + inverse[far]
                    distinct, n_far = np.unique(pair, return_counts=True)
                    text, token = distinct // len(unique), distinct % len(unique)
                    k = len(distinct)
                    nil, zero = pa.array(np.zeros(k, np.int64)), pa.array(np.zeros(k))
                    yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()).take(pa.array(text)), pa.array(text_sig.view(np.int64)[text]), pa.array(unique[token]), nil, nil, nil, zero, zero, pa.array(shape[token].astype(np.int8)), pa.array(n_far)], names=names)
                if pending > 3_000_000:
                    yield scored()
                    held, pending = [], 0
        if held:
            yield scored()

    spark = docs.sparkSession
    scratch = Scratch(spark)
    parts = scratch.keep(docs.select("doc_id", "text").mapInArrow(run, PARTS), "parts")
    shape_total = F.element_at(F.lit(model.shape_totals().tolist()), F.col("shape").cast("int") + 1)
    c = F.coalesce(F.col("c"), F.lit(0))
    far = (
        parts.filter("token IS NOT NULL")
        .join(counts.select("token", F.col("n").alias("c")), "token", "left")
        .groupBy("doc_id", "sig")
        .agg(F.sum(F.when(c > 0, F.col("n")).otherwise(0)).alias("n_known"), F.sum(F.col("n") * (F.log10(c + 0.5) - model.base_total)).alias("base"), F.sum(F.col("n") * (F.log10(c + 0.5) - shape_total)).alias("score"))
        .select("doc_id", "sig", F.lit(0).cast("long").alias("rows"), F.lit(0).cast("long").alias("n_tokens"), "n_known", "base", "score")
    )
    near = parts.filter("token IS NULL").select(*far.columns)
    summed = near.unionByName(far).groupBy("doc_id", "sig").agg(*(F.sum(x).alias(x) for x in ("rows", "n_tokens", "n_known", "base", "score")))
    each = lambda x: F.col(x) / F.col("rows")
    return summed.select("doc_id", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))).alias("_"), each("n_tokens").cast("long").alias("n_tokens"), each("n_known").cast("long").alias("n_known"), F.lit(model.n).cast("long").alias("train_tokens"), each("base").alias("base_score"), each("score").alias("score")).drop("_")


def op7_gru_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = remainder("doc_id", 5) == 1
    training = docs.filter(~held_out).select("doc_id", "text")
    counts = Scratch(spark).keep(count(training), "counts")
    model = fit(training, counts)
    return scores(docs, model, counts).select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
