"""Byte-level BPE encoding and decoding.

Pre-tokens are found without a regular expression: code points become classes, classes become transition
functions of a small automaton, and because composing functions is associative the states of a whole batch are
found by a blocked scan. The slices go through a cached pair merge; byte offsets are kept beside the ids, and
decoding gathers the vocabulary's bytes by id.

Defined results: a null text counts as empty; an empty text has no ids and decodes to no bytes; repeated rows give
repeated rows; further columns of the input do not matter; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from disputa.llm.common import bounded, code_points, mix, span_hashes, steps, table, utf8

#: Longest cache of merged pre-tokens in a worker, by number of pre-tokens.
CACHE_ENTRIES = 1 << 17
#: Bytes of text of a step: pre-tokens that repeat in it are looked up once.
TEXT_STEP = 1 << 20
#: Code points in a step of the blocked scan that each lane goes through.
LANE = 256

# Symbols of the automaton: what a code point can do, with the two code points after it taken into account.
LETTER, NUMBER, OTHER, JOIN, WHITE, SHORT, LONG = range(7)
# States: inside a run of letters, numbers, others or white space; after a space that opens a token; with 2 or 1 more
# code points of a contraction to come; after a contraction.
IN_LETTER, IN_NUMBER, IN_OTHER, IN_WHITE, OPENED, TWO_LEFT, ONE_LEFT, DONE = range(8)


def _transitions() -> tuple[np.ndarray, np.ndarray]:
    """(next state, whether the code point opens a token) by symbol and state."""
    step = np.zeros((7, 8), np.uint8)
    opens = np.zeros((7, 8), bool)
    plain = {LETTER: IN_LETTER, NUMBER: IN_NUMBER, OTHER: IN_OTHER}
    for symbol in range(7):
        for state in range(8):
            if state == TWO_LEFT:
                step[symbol, state] = ONE_LEFT
            elif state == ONE_LEFT:
                step[symbol, state] = DONE
            elif symbol in plain:
                step[symbol, state] = plain[symbol]
                opens[symbol, state] = state not in (plain[symbol], OPENED)
            elif symbol == JOIN:
                step[symbol, state], opens[symbol, state] = OPENED, True
            elif symbol == WHITE:
                step[symbol, state], opens[symbol, state] = IN_WHITE, state != IN_WHITE
            elif state in (IN_OTHER, OPENED):  # the apostrophe belongs to a run of other characters
                step[symbol, state] = IN_OTHER
            else:
                step[symbol, state], opens[symbol, state] = (ONE_LEFT if symbol == SHORT else TWO_LEFT), True
    return step, opens


STEP, OPENS = _transitions()


@lru_cache(1)
def char_classes() -> np.ndarray:
    """0 letter, 1 number, 2 other, 3 white space, for all code points, from the Unicode database."""
    out = np.full(0x110000, 2, np.uint8)
    for code in range(0x110000):
        kind = unicodedata.category(chr(code))
        if kind[0] == "L":
            out[code] = 0
        elif kind[0] == "N":
            out[code] = 1
    # The white space of Unicode.
    for code in (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000):
        out[code] = 3
    return out


def pre_tokens(codes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sorted first positions of all pre-tokens of the texts codes[offsets[i]:offsets[i+1]].

    A virtual white-space-free boundary lies between texts: each text starts a token of its own.
    """
    n = len(codes)
    if not n:
        return np.zeros(0, np.int64)
    kind = char_classes()[codes]
    last = np.zeros(n, bool)  # last code point of its text
    last[offsets[1:][offsets[1:] > offsets[:-1]] - 1] = True
    white = kind == 3
    after = np.zeros(n, bool)  # followed, in its text, by something that isn't white space
    after[:-1] = ~white[1:] & ~last[:-1]
    symbols = kind.copy()
    symbols[white] = WHITE
    # The last white space before a word: a space joins the word, anything else is a token by itself. The rest of the run before it is one token.
    symbols[white & after & (codes == 32)] = JOIN
    alone = white & after & (codes != 32)
    quote = np.flatnonzero((codes == 39) & ~last)
    if len(quote):
        follow = codes[quote + 1]
        one = np.isin(follow, [ord(c) for c in "stmd"])
        longer = quote + 1 < n - 1
        longer &= ~last[quote + 1]
        second = codes[np.minimum(quote + 2, n - 1)]
        two = longer & (((follow == ord("r")) | (follow == ord("v"))) & (second == ord("e")) | (follow == ord("l")) & (second == ord("l")))
        symbols[quote[one]] = SHORT
        symbols[quote[two]] = LONG
    # Work by lanes: compose the transition functions of each lane, scan the lanes' functions, then run the states.
    lanes = -(-n // LANE)
    padded = np.zeros(lanes * LANE, np.uint8)
    padded[:n] = symbols
    begin = np.zeros(lanes * LANE, bool)
    begin[offsets[:-1][offsets[:-1] < n]] = True
    grid, begins = np.ascontiguousarray(padded.reshape(lanes, LANE).T), np.ascontiguousarray(begin.reshape(lanes, LANE).T)
    flat, shifted, any_begin = STEP.reshape(-1), grid << 3, begins.any(1)
    function = np.broadcast_to(np.arange(8, dtype=np.uint8)[:, None], (8, lanes)).copy()
    for k in range(LANE):
        if any_begin[k]:
            function[:, begins[k]] = DONE
        function = flat.take(shifted[k] + function)
    function = np.ascontiguousarray(function.T)
    state, entry = DONE, np.zeros(lanes, np.uint8)
    scanned, gap = function.copy(), 1
    while gap < lanes:  # inclusive scan of the lanes' functions by doubling
        scanned[gap:] = np.take_along_axis(scanned[gap:], scanned[:-gap].copy(), 1)
        gap *= 2
    entry[0], entry[1:] = state, scanned[:-1, state]
    opens = np.zeros((LANE, lanes), bool)
    now, flat_opens = entry, OPENS.reshape(-1)
    for k in range(LANE):
        if any_begin[k]:
            now = np.where(begins[k], np.uint8(DONE), now)
        now = shifted[k] + now
        opens[k] = flat_opens.take(now)
        now = flat.take(now)
    opens |= begins
    flags = np.ascontiguousarray(opens.T).reshape(-1)[:n]
    flags[alone] = True
    return np.flatnonzero(flags)


NO_PAIR = np.int64(1 << 40)


def _slots(keys: np.ndarray, size: int) -> np.ndarray:
    return (mix(keys) & np.uint64(size - 1)).astype(np.int64)


class Tokenizer:
    """Ranks of a vocabulary file with base64 tokens and ranks by line; merging is cached by pre-token."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            pairs = [line.split() for line in lines if line.strip()]
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in pairs}
        size = max(self.ranks.values()) + 1
        tokens = [b""] * size
        for token, rank in self.ranks.items():
            tokens[rank] = token
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        self.firsts = np.zeros(size + 1, np.int64)
        np.cumsum(self.lengths, out=self.firsts[1:])
        self.data = np.frombuffer(b"".join(tokens), np.uint8)
        self.cache: dict[bytes, tuple[int, ...]] = {}
        self.bytes_ids = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        keys, values = [], []
        for token, rank in self.ranks.items():
            for k in range(1, len(token)):
                if (a := self.ranks.get(token[:k])) is not None and (b := self.ranks.get(token[k:])) is not None:
                    keys.append((a << 20) | b)
                    values.append(rank)
        key, value = np.array(keys, np.int64), np.array(values, np.int64)
        size = 1 << (2 * len(keys)).bit_length()
        self.pair_keys, self.pair_values = np.full(size, -1, np.int64), np.zeros(size, np.int64)
        slot = _slots(key, size)
        while len(key):
            free = np.flatnonzero(self.pair_keys[slot] < 0)
            won = free[np.unique(slot[free], return_index=True)[1]]
            self.pair_keys[slot[won]], self.pair_values[slot[won]] = key[won], value[won]
            rest = np.ones(len(key), bool)
            rest[won] = False
            key, value, slot = key[rest], value[rest], (slot[rest] + 1) & (size - 1)

    def merge(self, piece: bytes) -> tuple[int, ...]:
        """Ids of one pre-token: the pair with the lowest rank merges first, the leftmost of equals."""
        return (whole,) if (whole := self.ranks.get(piece)) is not None else self._merge_long(piece)

    def merge_many(self, pieces: list[bytes]) -> list[tuple[int, ...]]:
        """``merge`` of many pre-tokens in step: every round merges one pair in each of those that still have one."""
        out: list[tuple[int, ...]] = [()] * len(pieces)
        left = []
        for i, piece in enumerate(pieces):
            if (whole := self.ranks.get(piece)) is not None:
                out[i] = (whole,)
            elif len(piece) > 64:
                out[i] = self._merge_long(piece)
            else:
                left.append(i)
        if not left:
            return out
        lengths = np.array([len(pieces[i]) for i in left])
        part = self.bytes_ids[np.frombuffer(b"".join([pieces[i] for i in left]), np.uint8)]
        owner = np.repeat(np.array(left), lengths)
        ended: list[tuple[np.ndarray, np.ndarray]] = []
        rank = np.full(len(part), NO_PAIR)
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        rank[inner] = self.pair_ranks(part[inner], part[inner + 1])
        while len(part):
            first = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
            size = np.diff(np.append(first, len(part)))
            low = np.minimum.reduceat(rank, first)
            still = low < NO_PAIR
            if not still.all():
                over = np.repeat(~still, size)
                ended.append((owner[over], part[over]))
                part, owner, rank, low, size = part[~over], owner[~over], rank[~over], low[still], size[still]
                if not len(part):
                    break
            hit = np.flatnonzero(rank == np.repeat(low, size))
            hit = hit[np.concatenate(([True], owner[hit[1:]] != owner[hit[:-1]]))]
            part[hit] = rank[hit]
            keep = np.ones(len(part), bool)
            keep[hit + 1] = False
            at = hit - np.arange(len(hit))
            part, owner, rank = part[keep], owner[keep], rank[keep]
            for i in (at, at[at > 0] - 1):
                new = np.full(len(i), NO_PAIR)
                inside = np.flatnonzero(i + 1 < len(part))
                inside = inside[owner[i[inside]] == owner[i[inside] + 1]]
                new[inside] = self.pair_ranks(part[i[inside]], part[i[inside] + 1])
                rank[i] = new
        for owners, parts in ended:
            cut = np.flatnonzero(np.concatenate(([True], owners[1:] != owners[:-1], [True])))
            listed = parts.tolist()
            for i, a, b in zip(owners[cut[:-1]].tolist(), cut[:-1].tolist(), cut[1:].tolist()):
                out[i] = tuple(listed[a:b])
        return out

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of the token that each pair makes, NO_PAIR if none, by an open-addressed table."""
        key = (left << 20) | right
        slot = _slots(key, len(self.pair_keys))
        out = np.full(len(key), NO_PAIR)
        rest = np.arange(len(key))
        while len(rest):
            there = self.pair_keys[slot]
            same = there == key[rest]
            out[rest[same]] = self.pair_values[slot[same]]
            go = ~same & (there >= 0)
            rest, slot = rest[go], (slot[go] + 1) & (len(self.pair_keys) - 1)
        return out

    def _merge_long(self, piece: bytes) -> tuple[int, ...]:
        """The same by a heap, for long runs of one class: time by n log n."""
        ranks, n = self.ranks, len(piece)
        end = list(range(1, n + 1))  # of the part that begins here; 0: no part begins here
        before = list(range(-1, n - 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            middle = end[i]
            if not middle or middle >= n or end[middle] != stop:
                continue
            end[i], end[middle] = stop, 0
            if stop < n:
                before[stop] = i
                if (r := ranks.get(piece[i : end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            if (left := before[i]) >= 0 and (r := ranks.get(piece[left:stop])) is not None:
                heapq.heappush(heap, (r, left, stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : end[i]]])
            i = end[i]
        return tuple(out)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids of all texts in a row, offsets of the texts in the ids, first byte of each token within its text)."""
        codes, offsets = code_points(texts)
        data, spans = utf8(texts)
        starts = pre_tokens(codes, offsets)
        width = 1 + (codes > 0x7F).astype(np.int64) + (codes > 0x7FF) + (codes > 0xFFFF)
        at_byte = np.zeros(len(codes) + 1, np.int64)
        np.cumsum(width, out=at_byte[1:])
        first, last = at_byte[starts], at_byte[np.append(starts[1:], len(codes))] if len(starts) else np.zeros(0, np.int64)
        _, index, inverse = np.unique(span_hashes(data, first, last), return_index=True, return_inverse=True)
        raw, cache = data.tobytes(), self.cache
        pieces = [raw[a:b] for a, b in zip(first[index].tolist(), last[index].tolist())]
        found = [cache.get(piece) for piece in pieces]
        new = [i for i, x in enumerate(found) if x is None]
        if new:
            if len(cache) + len(new) > CACHE_ENTRIES:
                cache.clear()
            for i, x in zip(new, self.merge_many([pieces[i] for i in new])):
                found[i] = x
                if len(pieces[i]) <= 64:
                    cache[pieces[i]] = x
        counts = np.array([len(x) for x in found], np.int64)
        flat = np.array([i for x in found for i in x], np.int64)
        base = np.concatenate(([0], np.cumsum(counts)))[:-1]
        each = counts[inverse]
        total = np.zeros(len(each) + 1, np.int64)
        np.cumsum(each, out=total[1:])
        ids = flat[np.arange(total[-1]) - np.repeat(total[:-1] - base[inverse], each)] if len(each) else np.zeros(0, np.int64)
        by_text = total[np.searchsorted(starts, offsets)]
        byte = np.concatenate(([0], np.cumsum(self.lengths[ids])))
        return ids, by_text, byte[:-1] - np.repeat(spans[:-1], np.diff(by_text))

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of a run of ids."""
        size = self.lengths[ids]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ids) else 0
        return self.data[np.arange(total) + np.repeat(self.firsts[ids] - (ends - size), size)].tobytes()


@lru_cache(2)
def tokenizer(path: str) -> Tokenizer:
    return Tokenizer(path)


def vocabulary_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encode(docs: DataFrame, path: str | None = None, text: str = "text", ids: str = "token_ids", starts: str = "token_starts") -> DataFrame:
    """All columns of ``docs`` with the ids of the whole text and the byte at which each token begins.

    ``path`` names a vocabulary file that every executor can read; by default the installed one. Columns that already
    have the names of the new ones are replaced.
    """
    from pyspark.sql import types as T

    path = path or vocabulary_path()
    keep = [c for c in docs.columns if c not in (ids, starts)]
    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField(ids, T.ArrayType(T.IntegerType())), T.StructField(starts, T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizer(path)
        for batch in batches:
            for part in steps(batch, text, TEXT_STEP):
                found, by_text, first = own.encode(part.column(text))
                lists = [pa.ListArray.from_arrays(pa.array(by_text, pa.int32()), pa.array(found, pa.int32())), pa.ListArray.from_arrays(pa.array(by_text, pa.int32()), pa.array(first, pa.int64()))]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), *lists], names=[*keep, ids, starts])

    return bounded(docs).select(*keep).mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str | None = None, ids: str = "token_ids", out: str = "decoded") -> DataFrame:
    """All columns of ``encoded`` with the bytes of its ids; a null list decodes to no bytes."""
    from pyspark.sql import types as T

    path = path or vocabulary_path()
    keep = [c for c in encoded.columns if c != out]
    schema = T.StructType([*(encoded.schema[c] for c in keep), T.StructField(out, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizer(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                rows = [own.decode(np.asarray(x, np.int64)) if x is not None else b"" for x in (v.values.to_numpy() if v.is_valid else None for v in part.column(ids))]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(rows, pa.binary())], names=[*keep, out])

    return bounded(encoded).select(*keep).mapInArrow(run, schema)


def encode_checked(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, source, n_tokens, token_ids, decoded_sha256) of (doc_id, source, text) rows, the digest being of the decoded ids."""
    path = path or vocabulary_path()
    names = ["doc_id", "source", "n_tokens", "token_ids", "decoded_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizer(path)
        for batch in batches:
            for part in steps(batch, "text", TEXT_STEP):
                found, by_text, _ = own.encode(part.column("text"))
                data = own.decode(found)
                at_byte = np.concatenate(([0], np.cumsum(own.lengths[found])))[by_text].tolist()
                decoded = [hashlib.sha256(data[a:b]).hexdigest() for a, b in zip(at_byte, at_byte[1:])]
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), part.column("source").cast(pa.string()), pa.array(np.diff(by_text), pa.int64()), pa.ListArray.from_arrays(pa.array(by_text, pa.int32()), pa.array(found, pa.int32())), pa.array(decoded)], names=names)

    return bounded(docs).select("doc_id", "source", "text").mapInArrow(run, "doc_id long, source string, n_tokens long, token_ids array<int>, decoded_sha256 string")


DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """The query's digests: encodes, decodes the ids by the vocabulary's bytes, and hashes both, one pass over the texts."""
    path = path or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizer(path)
        names = [str(i).encode() for i in range(len(own.lengths))]
        for batch in batches:
            for part in steps(batch, "text", TEXT_STEP):
                found, by_text, _ = own.encode(part.column("text"))
                data = own.decode(found)
                at_byte = np.concatenate(([0], np.cumsum(own.lengths[found])))[by_text].tolist()
                listed, cut = found.tolist(), by_text.tolist()
                ids_hash = [hashlib.sha256(b" ".join([names[i] for i in listed[a:b]])).hexdigest() for a, b in zip(cut, cut[1:])]
                decoded = [hashlib.sha256(data[a:b]).hexdigest() for a, b in zip(at_byte, at_byte[1:])]
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array(np.diff(by_text), pa.int64()), pa.array(ids_hash), pa.array(decoded)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return bounded(docs).select("doc_id", "text").mapInArrow(run, DIGESTS)


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
