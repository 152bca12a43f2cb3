"""Near-duplicate texts: an exact Jaccard join on word shingles by adaptive multi-match prefixes.

Every document's shingles are put in one global order, rare ones first, by an estimate of how many documents hold them.
Two sets with a Jaccard similarity of t share at least l tokens within their first n - ceil(t n) + l ones, for any l.
A document with a costly prefix (many estimated candidates) takes a larger l: its prefix is longer, but a candidate must
share that many prefix tokens (the smaller l of the two) before it is verified on the whole sets.

Steps: (1) one pass hashes the shingles, gives every document the digest of its set, and counts shingles in a sketch of
fixed size, which any order may use, as the order need only be the same for all; equal sets are a class, and only one
member of a class, its smallest id, takes part in links and components. (2) A second pass sends prefix tokens to buckets;
a task sends a class once, and tokens whose share of all is large are salted. (3) A document that shares many prefix tokens
with a pivot, a member of its buckets, joins the group of the one it shares most with. Members of a group are dealt to
blocks and compared whole inside them, a group of several blocks twice; what is not connected by then is compared with all
other blocks of its group. So a group of copies costs two comparisons of blocks, not one for each two blocks. (4) Only
pairs of different components and groups that share a bucket are left: they need enough shared prefix tokens, and the
place of the first shared token and both sizes must allow the overlap (positional filter). A large bucket is cut into
blocks, each two of which are a key of the join. The pairs are verified, and join components. No pair is lost.

Shingles are 64-bit hashes; two of 10**10 pairs of documents would be judged on a false equality with probability 1e-4.

Defined results: case is folded for A-Z, words are runs without ASCII white space; with fewer words than a shingle's, the
whole sequence is one; a null or empty text has no shingles and is its own component; rows with one id are one node,
whatever their texts, and each row is returned; a null id has a null component; extra columns do not matter; an empty
table stays empty.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from disputa.llm.common import Scratch, bounded, fold_case, mix, runs, span_hashes, steps, table, utf8, words
from disputa.llm.components import components

#: Words of a shingle; similarity in hundredths; largest l; counters of the sketch (a power of 2) and of one slice.
WIDTH, SIMILAR, MOST_MATCHES, COUNTERS, SLICE = 5, 75, 8, 1 << 20, 1 << 14
#: Cost of verifying a candidate, in prefix tokens; a bucket above this share of a partition is salted.
VERIFY_COST, SALT_SHARE = 4.0, 0.25
#: Shingles of a block of a group, and rows of a block of a bucket. A document joins a group if it shares one in so many of
#: its shingles, as prefix tokens; others only take part in the exact join of what is left.
BLOCK, BUCKET_BLOCK, GROUP_SHARE = 1 << 18, 1024, 24


def shingles(texts: pa.Array, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingle hashes of all texts, sorted inside each text; offsets)."""
    data, spans = utf8(texts)
    data = fold_case(data)
    starts, ends, first = words(data, spans)
    hashes = span_hashes(data, starts, ends)
    n = np.diff(first)
    count = np.where(n >= width, n - width + 1, (n > 0).astype(np.int64))
    offsets = np.concatenate(([0], np.cumsum(count)))
    begin = np.arange(offsets[-1]) - np.repeat(offsets[:-1] - first[:-1], count)
    whole = np.repeat(n, count)
    out = np.zeros(len(begin), np.uint64)
    for k in range(width):
        step = hashes[np.minimum(begin + k, max(0, len(hashes) - 1))] if len(hashes) else hashes
        out = np.where(k < whole, mix(out * np.uint64(0xD6E8FEB86659FD93) + step + np.uint64(1)), out) if k and (whole < width).any() else mix(out * np.uint64(0xD6E8FEB86659FD93) + step + np.uint64(1))
    for a, b in zip(offsets.tolist(), offsets[1:].tolist()):
        out[a:b].sort()
    return _distinct(out, offsets)


def _distinct(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keep = np.ones(len(values), bool)
    keep[1:] = values[1:] != values[:-1]
    keep[offsets[:-1][offsets[:-1] < len(values)]] = True
    return values[keep], np.concatenate(([0], np.cumsum(keep)))[offsets]


def _sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Wrapping sums of runs, 0 for empty ones."""
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)))
    return total[offsets[1:]] - total[offsets[:-1]]


def digests(hashes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit digests of each set."""
    return _sums(mix(hashes + np.uint64(0x51)), offsets).view(np.int64), _sums(mix(hashes ^ np.uint64(0xA5A5A5A5A5A5A5A5)), offsets).view(np.int64)


def _slices(counts: np.ndarray) -> Iterator[tuple[int, bytes]]:
    for k in range(len(counts) // SLICE):
        part = counts[k * SLICE : (k + 1) * SLICE]
        if part.any():
            yield k, zlib.compress(part.astype(np.uint32).tobytes(), 1)


def total_counts(slices: DataFrame) -> np.ndarray:
    """The sum of all tasks' counters: rows (slice, counts) are summed as a stream, a slice in one task; the result has a fixed size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, counts in zip(batch.column("slice").to_pylist(), batch.column("counts").to_pylist()):
                held[k] = held.get(k, 0) + np.frombuffer(zlib.decompress(counts), np.uint32).astype(np.int64)
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([zlib.compress(v.tobytes(), 1) for v in held.values()], pa.binary())], names=["slice", "counts"])

    n = int(slices.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = np.zeros(COUNTERS, np.int64)
    for row in slices.repartition(n, "slice").mapInArrow(run, "slice int, counts binary").collect():
        out[row["slice"] * SLICE : (row["slice"] + 1) * SLICE] = np.frombuffer(zlib.decompress(row["counts"]), np.int64)
    return out


FIRST = "doc_id long, n long, k1 long, k2 long, slice int, counts binary"


def _first_pass(docs: DataFrame) -> DataFrame:
    """A row for each document (its set's size and digests) and, from each task, the slices of its counters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(COUNTERS, np.int64)
        names = [f.split()[0] for f in FIRST.split(", ")]
        for batch in batches:
            for part in steps(batch):
                hashes, offsets = shingles(part.column("text"))
                counts += np.bincount((hashes & np.uint64(COUNTERS - 1)).astype(np.int64), minlength=COUNTERS)
                k1, k2 = digests(hashes, offsets)
                nil = pa.nulls(part.num_rows, pa.int32())
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array(np.diff(offsets)), pa.array(k1), pa.array(k2), nil, pa.nulls(part.num_rows, pa.binary())], names=names)
        rows = list(_slices(counts))
        if rows:
            nil = pa.nulls(len(rows), pa.int64())
            yield pa.RecordBatch.from_arrays([nil, nil, nil, nil, pa.array([k for k, _ in rows], pa.int32()), pa.array([c for _, c in rows], pa.binary())], names=names)

    return docs.select("doc_id", "text").mapInArrow(run, FIRST)


# A posting's meta: size of the set (28 bits), place of the token in the order (26), rank as a pivot (5), l (4).
N_BITS, PLACE_BITS, RANK_BITS, L_BITS = 28, 26, 5, 4


def _meta(name: str, column: str = "meta") -> Column:
    shift, bits = {"l": (0, L_BITS), "rank": (L_BITS, RANK_BITS), "place": (L_BITS + RANK_BITS, PLACE_BITS), "n": (L_BITS + RANK_BITS + PLACE_BITS, N_BITS)}[name]
    return F.shiftrightunsigned(column, shift).bitwiseAND(F.lit((1 << bits) - 1))


def least_overlap(n: np.ndarray | int) -> np.ndarray | int:
    """Tokens that a set of n must share with any similar set."""
    return -(-SIMILAR * n // 100)


def prefix(estimates: np.ndarray, load: float) -> tuple[int, int, int]:
    """(length of the prefix, l, rank as a pivot) of a set whose tokens, in order, have these estimates.

    Candidates that share l tokens of a prefix are at most the sum of its tokens' other holders divided by l.
    """
    n = len(estimates)
    need = int(least_overlap(n))
    base = n - need
    most = min(MOST_MATCHES, need)
    others = np.maximum(0.0, estimates[: base + most] - load)
    upto = np.cumsum(others)
    l = np.arange(1, most + 1)
    cost = base + l + VERIFY_COST * upto[base : base + most] / l
    best = int(cost.argmin())
    hot = np.count_nonzero(others[: base + best + 1] > load + 3)
    return base + best + 1, best + 1, (31 * hot) // (base + best + 1)


def _postings(docs: DataFrame, sketch: np.ndarray, partitions: int) -> DataFrame:
    """(token, salt, id, meta) of prefix tokens; a task sends the sets it has seen before no second time."""
    total = float(sketch.sum())
    load = total / COUNTERS
    # Sums of counters are at most the shingles of a prefix times this, by partition.
    mean = max(1.0, 0.27 * total / partitions)
    shared = docs.sparkSession.sparkContext.broadcast(sketch.astype(np.float32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, seen = shared.value, set()
        classes = np.minimum(63, np.floor(2 * np.log2(counts + 1.0))).astype(np.uint64) << np.uint64(58)
        for batch in batches:
            for part in steps(batch):
                hashes, offsets = shingles(part.column("text"))
                k1, k2 = digests(hashes, offsets)
                cell = (hashes & np.uint64(COUNTERS - 1)).astype(np.int64)
                keys = classes[cell] | (hashes >> np.uint64(6))
                tokens, places, sizes, cells = [], [], [], []
                ids, metas = [], []
                for i, (doc_id, a, b, x, y) in enumerate(zip(part.column("doc_id").to_pylist(), offsets.tolist(), offsets[1:].tolist(), k1.tolist(), k2.tolist())):
                    if a == b or doc_id is None or (x, y) in seen:
                        continue
                    seen.add((x, y))
                    order = np.argsort(keys[a:b], kind="stable")
                    where = cell[a:b][order]
                    size, l, rank = prefix(counts[where], load)
                    tokens.append(keys[a:b][order[:size]])
                    cells.append(where[:size])
                    places.append(np.arange(size))
                    sizes.append(size)
                    ids.append(doc_id)
                    metas.append((b - a) << (L_BITS + RANK_BITS + PLACE_BITS) | rank << L_BITS | l)
                if ids:
                    token, cell, id_ = np.concatenate(tokens), np.concatenate(cells), np.repeat(np.array(ids, np.int64), sizes)
                    meta = np.repeat(np.array(metas, np.int64), sizes) | np.concatenate(places) << (L_BITS + RANK_BITS)
                    salts = np.maximum(1, np.ceil((counts[cell] - 2 * load) / (SALT_SHARE * mean))).astype(np.uint64)
                    salt = np.where(salts > 1, (mix(id_.view(np.uint64)) % salts).astype(np.int64), -1)
                    yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(np.minimum(salt, 32000).astype(np.int16)), pa.array(id_), pa.array(meta)], names=["token", "salt", "id", "meta"])

    return docs.select("doc_id", "text").mapInArrow(run, "token long, salt short, id long, meta long")


def _buckets(postings: DataFrame, partitions: int) -> DataFrame:
    """(token, salt, id, meta, pivot) of buckets with two ids at least, and of all salted ones.

    The pivot has the highest rank, then the smallest id. Rows come sorted, so a task holds one run at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[np.ndarray, ...] | None = None

        def done(token: np.ndarray, salt: np.ndarray, id_: np.ndarray, meta: np.ndarray) -> pa.RecordBatch:
            new = np.ones(len(token), bool)
            new[1:] = (token[1:] != token[:-1]) | (salt[1:] != salt[:-1])
            first = np.flatnonzero(new)
            size = np.diff(np.append(first, len(token)))
            rank = (meta >> L_BITS) & ((1 << RANK_BITS) - 1)
            run_of = np.repeat(np.arange(len(first)), size)
            order = np.lexsort((id_, -rank, run_of))
            pivot = id_[order[first]]
            keep = np.repeat(size > 1, size) | (salt >= 0)
            return pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (token, salt, id_, meta, pivot[run_of])], names=["token", "salt", "id", "meta", "pivot"])

        for batch in batches:
            if not batch.num_rows:
                continue
            now = tuple(batch.column(c).to_numpy(zero_copy_only=False) for c in ("token", "salt", "id", "meta"))
            if held is not None:
                now = tuple(np.concatenate(x) for x in zip(held, now))
            token, salt = now[0], now[1]
            last = np.flatnonzero((token != token[-1]) | (salt != salt[-1]))
            cut = int(last[-1]) + 1 if len(last) else 0
            if cut:
                yield done(*(x[:cut] for x in now))
            held = tuple(x[cut:] for x in now)
        if held is not None and len(held[0]):
            yield done(*held)

    placed = postings.repartition(partitions, "token", "salt").sortWithinPartitions("token", "salt")
    return placed.mapInArrow(run, "token long, salt short, id long, meta long, pivot long")


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, hashes) of the documents whose ids are in ``wanted``, and by chance of others: a filter of fixed size lets them through."""
    cells = lambda column: F.pmod(F.xxhash64(column), F.lit(COUNTERS))

    def marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            counts[batch.column("cell").to_numpy()] = 1
        rows = list(_slices(counts))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int32()), pa.array([c for _, c in rows], pa.binary())], names=["slice", "counts"])

    marked = total_counts(wanted.select(cells("id").alias("cell")).mapInArrow(marks, "slice int, counts binary")) > 0
    shared = docs.sparkSession.sparkContext.broadcast(np.packbits(marked))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let = np.unpackbits(shared.value).astype(bool)
        for batch in batches:
            batch = batch.filter(pa.array(let[batch.column("cell").to_numpy()]))
            for part in steps(batch):
                hashes, offsets = shingles(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array([hashes[a:b].tobytes() for a, b in zip(offsets, offsets[1:])], pa.binary())], names=["id", "hashes"])

    return docs.filter("doc_id IS NOT NULL").select("doc_id", "text", cells(F.col("doc_id").cast("long")).alias("cell")).mapInArrow(run, "id long, hashes binary")


def _similar(sets: list[np.ndarray], size: int = 4096) -> np.ndarray:
    """The boolean table of similar pairs of sorted sets. Only hashes that two sets hold are counted, by products of incidence tables."""
    n = np.array([len(x) for x in sets])
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), n)
    _, inverse, times = np.unique(flat, return_inverse=True, return_counts=True)
    column = np.cumsum(times > 1) - 1
    held = times[inverse] > 1
    owner, column = owner[held], column[inverse[held]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    size = min(size, max(64, (1 << 22) // len(sets)))
    shared = np.zeros((len(sets), len(sets)), np.float32)
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, size):
        a, b = np.searchsorted(column, [at, at + size])
        table = np.zeros((len(sets), size), np.float32)
        table[owner[a:b], column[a:b] - at] = 1
        shared += table @ table.T
    return (shared > 0) & ((100 + SIMILAR) * shared.astype(np.float64) >= SIMILAR * (n[:, None] + n[None, :]))


def _forest(near: np.ndarray) -> list[tuple[int, int]]:
    """(a, b) links of a spanning forest of a symmetric boolean table."""
    seen, out = np.zeros(len(near), bool), []
    for start in range(len(near)):
        if seen[start]:
            continue
        seen[start], todo = True, [start]
        while todo:
            i = todo.pop()
            new = np.flatnonzero(near[i] & ~seen)
            seen[new] = True
            out += [(i, int(j)) for j in new]
            todo += new.tolist()
    return out


#: Sets that are compared in one table of pairs; more of them are compared table by table.
TILE = 1024


def _linked(ids: np.ndarray, sets: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links that connect all similar ones of these sets; the smallest ids are the hubs."""
    order = np.argsort(ids, kind="stable")
    tiles = [order[at : at + TILE // 2] for at in range(0, len(order), TILE // 2)]
    for i, one in enumerate(tiles):
        for two in tiles[i + 1 :] or ([order[:0]] if len(tiles) == 1 else []):
            both = np.concatenate((one, two))
            links = np.array(_forest(_similar([sets[k] for k in both])), np.int64).reshape(-1, 2)
            yield ids[both[links[:, 0]]], ids[both[links[:, 1]]]


def _compared(pieces: DataFrame, docs: DataFrame, partitions: int) -> DataFrame:
    """(a, b) links that connect all similar members of each piece (cluster, x, y, id), whole sets compared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in runs(batches, ["cluster", "x", "y"]):
            if rows.num_rows < 2:
                continue
            held = [np.frombuffer(x, np.uint64) for x in rows.column("hashes").to_pylist()]
            for a, b in _linked(rows.column("id").to_numpy(), held):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    placed = pieces.join(_sets(docs, pieces.select("id").distinct()), "id").select("cluster", "x", "y", "id", "hashes").repartition(partitions, "cluster", "x", "y").sortWithinPartitions("cluster", "x", "y")
    return placed.mapInArrow(run, "a long, b long").filter("a <> b").distinct()


def _group_links(groups: DataFrame, docs: DataFrame, partitions: int, scratch: Scratch) -> DataFrame:
    """(a, b) links that connect all similar members of each group (id, n, cluster).

    A group is cut into blocks of about ``BLOCK`` shingles. First, members of a block are compared; groups of several blocks are
    dealt anew and compared again. Members that are then not of the component that most are of meet every block of the group.
    """
    sizes = scratch.keep(groups.groupBy("cluster").agg(F.ceil(F.sum("n") / BLOCK).cast("long").alias("blocks")), "sizes")
    dealt = groups.join(sizes, "cluster").select("id", "cluster", "blocks")
    block = lambda seed: F.pmod(F.xxhash64(F.lit(seed), "id"), F.col("blocks"))
    once = dealt.select("id", "cluster", block(1).alias("x"), F.lit(1).cast("long").alias("y"))
    twice = dealt.filter("blocks > 1").select("id", "cluster", block(2).alias("x"), F.lit(2).cast("long").alias("y"))
    links = scratch.keep(_compared(once.unionByName(twice), docs, partitions), "links")
    if sizes.filter("blocks > 1").isEmpty():
        return links
    labels = scratch.keep(components(links, scratch), "labels")
    named = scratch.keep(dealt.filter("blocks > 1").join(labels, "id", "left").select("id", "cluster", "blocks", F.coalesce("component", "id").alias("label")), "named")
    counted = named.groupBy("cluster", "label").agg(F.count("*").alias("times")).groupBy("cluster").agg(F.max_by("label", F.struct("times", "label")).alias("main"), F.sum("times").alias("all"), F.max("times").alias("most"))
    counted = scratch.keep(counted.filter("most < all"), "counted")
    if counted.isEmpty():
        return links
    # The others of a group are blocks (x) of their own; each meets every block (y) of the whole group.
    left = named.join(counted, "cluster").withColumn("others", F.ceil(F.col("blocks") * (F.col("all") - F.col("most")) / F.col("all")).cast("long"))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    own = left.filter("label <> main").select("id", "cluster", F.pmod(F.xxhash64(F.lit(3), "id"), F.col("others")).alias("x"), every("blocks").alias("y"))
    all_ = left.select("id", "cluster", every("others").alias("x"), block(1).alias("y"))
    more = scratch.keep(_compared(scratch.keep(own.unionByName(all_).distinct(), "pieces"), docs, partitions), "links")
    return links.unionByName(more)


def _verified(tries: DataFrame, docs: DataFrame) -> DataFrame:
    """The (a, b, label_a, label_b) rows whose whole sets are similar."""
    sets = _sets(docs, tries.select(F.col("a").alias("id")).unionByName(tries.select(F.col("b").alias("id"))))
    one, two = (sets.select(F.col("id").alias(side), F.col("hashes").alias(f"set_{side}")) for side in "ab")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for i, (x, y) in enumerate(zip(batch.column("set_a"), batch.column("set_b"))):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.concatenate((x, y))
                both.sort()
                shared = int(np.count_nonzero(both[1:] == both[:-1]))
                if shared and 100 * shared >= SIMILAR * (len(x) + len(y) - shared):
                    good.append(i)
            yield batch.select(["label_a", "label_b"]).take(pa.array(good, pa.int64()))

    return tries.join(two, "b").join(one, "a").select("label_a", "label_b", "set_a", "set_b").mapInArrow(run, "label_a long, label_b long").distinct()


NAMED = ["token", "rep", "cluster", "label", "meta"]


def _mixed(named: DataFrame, partitions: int) -> DataFrame:
    """Distinct rows of the buckets that hold several components and groups, with the bucket's ``size``; a task holds one bucket at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(rows: list[np.ndarray]) -> pa.RecordBatch:
            order = np.lexsort((rows[4], rows[1], rows[0]))
            rows = [x[order] for x in rows]
            new = np.ones(len(order), bool)
            new[1:] = (rows[0][1:] != rows[0][:-1]) | (rows[1][1:] != rows[1][:-1]) | (rows[4][1:] != rows[4][:-1])
            rows = [x[new] for x in rows]
            first = np.flatnonzero(np.concatenate(([True], rows[0][1:] != rows[0][:-1])))
            size = np.diff(np.append(first, len(rows[0])))
            several = [np.minimum.reduceat(x, first) < np.maximum.reduceat(x, first) for x in (rows[2], rows[3])]
            keep = np.repeat(several[0] & several[1], size)
            return pa.RecordBatch.from_arrays([*(pa.array(x[keep]) for x in rows), pa.array(np.repeat(size, size)[keep])], names=[*NAMED, "size"])

        held: list[np.ndarray] | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            now = [batch.column(c).to_numpy() for c in NAMED]
            if held is not None:
                now = [np.concatenate(x) for x in zip(held, now)]
            other = np.flatnonzero(now[0] != now[0][-1])
            cut = int(other[-1]) + 1 if len(other) else 0
            if cut:
                yield done([x[:cut] for x in now])
            held = [x[cut:] for x in now]
        if held is not None and len(held[0]):
            yield done(held)

    return named.repartition(partitions, "token").sortWithinPartitions("token").mapInArrow(run, ", ".join(f"{c} long" for c in [*NAMED, "size"]))


def _left(found: DataFrame, known: DataFrame, partitions: int, scratch: Scratch) -> DataFrame:
    """(token, rep, cluster, label, n, place, l, size): what the buckets hold of pairs that may still join components."""
    meta = F.col("meta").bitwiseAND(F.lit(~(((1 << RANK_BITS) - 1) << L_BITS))).alias("meta")
    named = found.select("token", "salt", "id", meta).join(known, "id").select("salt", *NAMED)
    hot = scratch.keep(named.filter("salt >= 0").select(*NAMED).distinct(), "hot")
    sizes = hot.groupBy("token").agg(F.count("*").alias("size"), F.min("label").alias("low"), F.max("label").alias("high"), F.min("cluster").alias("c1"), F.max("cluster").alias("c2"))
    sizes = scratch.keep(sizes.filter("low < high AND c1 < c2").select("token", "size"), "sizes")
    rows = _mixed(named.filter("salt < 0").select(*NAMED), partitions).unionByName(hot.join(sizes, "token"))
    return scratch.keep(rows.select("token", "rep", "cluster", "label", _meta("n").alias("n"), _meta("place").alias("place"), _meta("l").alias("l"), "size"), "left")


def _tries(left: DataFrame) -> DataFrame:
    """(a, b, label_a, label_b) pairs of different components and groups that share enough prefix tokens early enough."""
    caps = left.groupBy("rep", "n").agg(F.min("place").alias("from"))
    # Without a token of its own base prefix in some bucket, a set can't reach the overlap.
    capped = left.join(caps, ["rep", "n"]).withColumn("cap", F.col("n") - F.col("from")).filter(F.col("cap") >= F.ceil(F.lit(SIMILAR) * F.col("n") / F.lit(100)))
    blocks = F.ceil(F.col("size") / BUCKET_BLOCK).cast("long")
    own = F.pmod(F.xxhash64("rep"), blocks)
    other = F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1))
    side = lambda s, x, y: capped.select("token", x.alias("x"), y.alias("y"), *(F.col(c).alias(f"{c}_{s}") for c in ("rep", "n", "place", "l", "label", "cap", "cluster")))
    need = F.ceil(F.lit(SIMILAR) * (F.col("n_a") + F.col("n_b")) / F.lit(100 + SIMILAR))
    apart = (F.col("cluster_a") != F.col("cluster_b")) & (F.col("cluster_a") != F.col("rep_b")) & (F.col("cluster_b") != F.col("rep_a"))
    fits = (F.col("label_a") < F.col("label_b")) & apart & (F.least("cap_a", "cap_b") >= need)
    pairs = side("a", own, other).join(side("b", other, own), ["token", "x", "y"]).filter(fits)
    pairs = pairs.groupBy("rep_a", "rep_b", "n_a", "n_b").agg(F.count("*").alias("met"), F.min("place_a").alias("place_a"), F.min("place_b").alias("place_b"), F.min(F.least("l_a", "l_b")).alias("l"), F.min("label_a").alias("label_a"), F.min("label_b").alias("label_b"))
    pairs = pairs.filter((F.col("met") >= F.col("l")) & (F.least(F.col("n_a") - F.col("place_a"), F.col("n_b") - F.col("place_b")) >= need))
    return pairs.select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b"), "label_a", "label_b").distinct()


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id), a row for each row of ``docs``."""
    spark = docs.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    scratch = Scratch(spark)
    docs = bounded(docs).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    first = scratch.keep(_first_pass(docs), "sets")
    sketch = total_counts(first.filter("slice IS NOT NULL").select("slice", "counts"))
    rows = first.filter("slice IS NULL").select("doc_id", "n", "k1", "k2")
    filled = rows.filter("n > 0 AND doc_id IS NOT NULL")
    reps = scratch.keep(filled.groupBy("k1", "k2", "n").agg(F.min("doc_id").alias("rep")), "reps")
    members = scratch.keep(filled.join(reps, ["k1", "k2", "n"]).select("doc_id", "rep", "n").distinct(), "members")
    scratch.drop(reps)

    found = scratch.keep(_buckets(_postings(docs, sketch, partitions), partitions), "buckets")
    scratch.release()
    # Salted tokens: the pivot of all salts.
    top = found.filter("salt >= 0").groupBy("token").agg(F.max(F.struct(_meta("rank").alias("rank"), (-F.col("pivot")).alias("least"))).alias("top")).select("token", (-F.col("top.least")).alias("all"))
    top = scratch.keep(top, "top")
    n = _meta("n").alias("n")
    tried = found.filter("salt < 0").select("id", "pivot", n).unionByName(found.filter("salt >= 0").join(top, "token").select("id", F.col("all").alias("pivot"), n))
    met = tried.filter("id <> pivot").groupBy("id", "pivot").agg(F.count("*").alias("met"), F.max("n").alias("n")).filter(F.col("met") * GROUP_SHARE >= F.col("n"))
    rep_of = lambda name, as_: members.select(F.col("doc_id").alias(name), F.col("rep").alias(as_)).distinct()
    best = met.groupBy("id").agg(F.max_by("pivot", F.struct("met", -F.col("pivot"))).alias("pivot"))
    # A document's group is that of its pivot; a pivot belongs to its own group too.
    stars = scratch.keep(best.join(rep_of("id", "b"), "id").join(rep_of("pivot", "a"), "pivot").filter("a <> b").groupBy("b").agg(F.min("a").alias("a")), "stars")
    scratch.drop(top)
    sized = members.filter("doc_id = rep").groupBy("rep").agg(F.max("n").alias("n"))
    groups = stars.select(F.col("b").alias("rep"), F.col("a").alias("cluster")).unionByName(stars.select(F.col("a").alias("rep"), F.col("a").alias("cluster")).distinct())
    groups = scratch.keep(groups.join(sized, "rep").select(F.col("rep").alias("id"), "n", "cluster"), "groups")
    # An id with several texts is one node: its classes are linked.
    twins = members.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).filter("a < b").select("doc_id", "a")
    twins = members.join(scratch.keep(twins, "twins"), "doc_id").select("a", F.col("rep").alias("b")).filter("a <> b")
    links = scratch.keep(_group_links(groups, docs, partitions, scratch).unionByName(twins).distinct(), "links")
    scratch.release()
    labels = scratch.keep(components(links, scratch), "labels")

    # What is left: pairs of different components and groups in a bucket.
    classes = members.select("rep").distinct().join(stars.select(F.col("b").alias("rep"), F.col("a").alias("cluster")), "rep", "left").join(labels.withColumnRenamed("id", "rep"), "rep", "left")
    classes = scratch.keep(classes.select("rep", F.coalesce("cluster", "rep").alias("cluster"), F.coalesce("component", "rep").alias("label")), "classes")
    known = scratch.keep(members.select(F.col("doc_id").alias("id"), "rep").distinct().join(classes, "rep"), "known")
    scratch.drop(groups, stars, links, classes)
    left = _left(found, known, partitions, scratch)
    scratch.drop(found)
    scratch.release()
    tries = scratch.keep(_tries(left), "tries")
    scratch.drop(left)
    more = scratch.keep(_verified(tries, docs).select(F.col("label_a").alias("a"), F.col("label_b").alias("b")), "more")
    scratch.release()
    joined = scratch.keep(components(more, scratch), "joined")
    final = known.select(F.col("id").alias("doc_id"), F.col("label").alias("id")).distinct().join(joined, "id", "left").select("doc_id", F.coalesce("component", "id").alias("component")).distinct()
    final = scratch.keep(final, "final")
    scratch.drop(known, tries, more, joined, labels, members)
    return rows.join(final, "doc_id", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
