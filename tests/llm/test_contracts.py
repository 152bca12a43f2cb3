"""Each registered query by name, over a small folder with nulls, empty and very long texts, ties, repeated rows and clashing columns."""

import collections
import hashlib
import importlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import tiktoken
import tiktoken.load

import corpus_pipeline
from disputa.llm import bpe, common, html, langid, lm, mixing, registry
from test_operators import components_of, sets

WORDS = {"en": ["the", "river", "stone", "walks", "under", "morning"], "de": ["der", "fluß", "stein", "geht", "unter", "grün"]}


def remainder(doc_id, m):
    return zlib.crc32(str("" if doc_id is None else doc_id).encode()) % m


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    out = []
    for i in range(160):
        lang = "en" if i % 3 else "de"
        words = [rng.choice(WORDS[lang]) + rng.choice(["", "s", "er", str(rng.randint(0, 99))]) for _ in range(rng.randint(6, 60))]
        out.append((i, " ".join(words) + ("###" * 20 if i % 7 == 0 else ""), lang, f"s{i % 4 // 2 * 3}"))
    texts = [r[1] for r in out]
    near = texts[5].split() * 3
    out += [(200, " ".join(near), "en", "s0"), (201, " ".join([*near[:-1], "other"]), "en", None), (202, texts[9], None, "s0"), (202, texts[9], None, "s0")]
    out += [(300, None, None, None), (301, "", "en", "s0"), (302, " \t\n", "en", "s0"), (303, "Ends </s>", "en", "s3"), (None, "no id at all", "en", "s0"), (None, texts[3], "en", "s0")]
    out += [(400, texts[11], "en", "s0"), (400, texts[14], "de", "s3"), (500, "long words go on " * 20000, "en", "s0")]
    return out


@pytest.fixture(scope="module")
def folder(tmp_path_factory, rows):
    at = tmp_path_factory.mktemp("tables")
    clash = ["component_id", "score", "lang_pred", "quality_score", "mix_epoch", "token_ids", "feature", "n_tokens"]

    def write(kept, where):
        where.mkdir(exist_ok=True)
        columns = {"doc_id": pa.array([r[0] for r in kept], pa.int64()), "text": pa.array([r[1] for r in kept], pa.string()), "lang": pa.array([r[2] for r in kept], pa.string()), "source": pa.array([r[3] for r in kept], pa.string())}
        columns["n_chars"] = pa.array([len(r[1] or "") for r in kept], pa.int64())
        pq.write_table(pa.table(columns | {c: pa.array(["x"] * len(kept), pa.string()) for c in clash}), where / "documents.parquet")
        ids = [r[0] for r in kept if r[0] is not None and r[0] < 160] * 2
        pq.write_table(pa.table({"doc_id": pa.array(ids, pa.int64()), "quality": pa.array([int(i % 7 != 0) for i in ids], pa.int32()), "toxic": pa.array([0] * len(ids), pa.int32())}), where / "labels.parquet")
        rng = np.random.default_rng(3)
        base = rng.normal(size=(40, 8)).astype(np.float32) + 1
        vectors = [*base.tolist(), *(base[:20] + rng.normal(size=(20, 8)) * 0.05).tolist(), base[0].tolist(), None, [], [0.0] * 8, [None] * 8, [float("nan")] * 8] if kept else []
        pq.write_table(pa.table({"vec_id": pa.array(range(len(vectors)), pa.int64()), "embedding": pa.array(vectors, pa.list_(pa.float32())), "label": pa.array([0] * len(vectors), pa.int32()), "component_id": pa.array(["x"] * len(vectors), pa.string())}), where / "embeddings.parquet")
        pages = [(i, f"http://h{i % 2}.example/{i}", f"<body><nav>Menu</nav><article><p>Story {i} of ours.</p><div class=k9><p>Write to the desk</p></div></article></body>") for i in range(40)] + [(90, None, None), (91, "http://x/", ""), (92, "http://x/", "<p>a" + " b" * 200000)]
        pages = pages if kept else []
        pq.write_table(pa.table({"page_id": pa.array([p[0] for p in pages], pa.int64()), "url": pa.array([p[1] for p in pages], pa.string()), "html": pa.array([p[2] for p in pages], pa.string()), "text": pa.array([1] * len(pages), pa.int32())}), where / "pages.parquet")
        said = [(c, t, "user" if t % 2 == 0 else "assistant", None if t == 3 else f"say {c} {t} </s>[INST]") for c in range(5) for t in range(4)] if kept else []
        pq.write_table(pa.table({"conv_id": pa.array([s[0] for s in said], pa.int64()), "turn": pa.array([s[1] for s in said], pa.int64()), "role": pa.array([s[2] for s in said], pa.string()), "text": pa.array([s[3] for s in said], pa.string())}), where / "conversations.parquet")
        return str(where)

    return write(rows, at / "full"), write([], at / "empty")


def run(spark, folder, name):
    return registry.QUERIES[name](spark, folder[0])


COLUMNS = {
    "op1_ngram_jaccard": "doc_id bigint, n_shingles bigint, component_id bigint",
    "op3_prefix_targets": "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint",
    "op4_quality": "doc_id bigint, held_out boolean, score double, predicted int",
    "op5_language_id": "doc_id bigint, held_out boolean, lang_pred string, score double",
    "op6_vector_neardup": "vec_id bigint, n_links bigint, component_id bigint, kept boolean",
    "op7_gru_scores": "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double",
    "op8_progressive_jpeg": "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string",
    "op9_main_text": "page_id bigint, url string, text string, n_chars bigint",
    "op10_byte_bpe": "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns_and_empty_tables(spark, folder, name):
    got = registry.QUERIES[name](spark, folder[1])
    types = dict(got.dtypes)
    for column in COLUMNS[name].split(", "):
        assert types[column.split()[0]] == column.split()[1]
    assert got.count() == (name == "op3_prefix_targets")  # conversation -1


def test_texts_join(spark, folder, rows):
    got = run(spark, folder, "op1_ngram_jaccard").collect()
    assert len(got) == len(rows)
    held = collections.defaultdict(list)
    for r in rows:
        if r[0] is not None:
            held[r[0]].append(sets(r[1]))
    ids = sorted(held)
    similar = lambda a, b: a and b and 100 * len(a & b) >= 75 * len(a | b)
    want = components_of(ids, [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if any(similar(x, y) for x in held[a] for y in held[b])])
    assert all(r.component_id == want.get(r.doc_id) for r in got)
    assert collections.Counter((r.doc_id, r.n_shingles) for r in got) == collections.Counter((r[0], len(sets(r[1]))) for r in rows)


def test_mix_is_a_prefix_of_each_permutation(spark, folder, rows):
    got = run(spark, folder, "op2_temperature_mix").collect()
    taken = collections.Counter((r.source, r.doc_id, r.n_tokens) for r in got)
    totals = collections.Counter()
    for r in rows:
        totals[r[3]] += len((r[1] or "").split())
    names = sorted(totals, key=lambda s: (s is not None, s or ""))
    plan = mixing.solve([totals[s] for s in names])
    docs = spark.read.parquet(f"{folder[0]}/documents.parquet")
    for s, quota in zip(names, plan.quotas):
        full, rest = divmod(quota, totals[s])
        from pyspark.sql import functions as F

        block, place = mixing._keys(F.lit(full).cast("long"), "doc_id")
        keyed = docs.filter(F.col("source").eqNullSafe(s)).select("doc_id", mixing.word_count("text").alias("n"), block.alias("b"), place.alias("p")).collect()
        groups = collections.defaultdict(list)
        for r in keyed:
            groups[(r.b, r.p)].append(r)
        want, used, open_ = collections.Counter(), 0, True
        for key in sorted(groups):
            used += sum(r.n for r in groups[key])
            open_ &= used <= rest and rest > 0
            for r in groups[key]:
                want[(s, r.doc_id, r.n)] += full + open_
        assert {k: v for k, v in taken.items() if k[0] == s} == {k: v for k, v in want.items() if v}


def test_quality_columns(spark, folder, rows):
    got = run(spark, folder, "op4_quality").collect()
    assert collections.Counter(r.doc_id for r in got) == collections.Counter(r[0] for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) and r.held_out == (remainder(r.doc_id, 5) == 0) for r in got)
    judged = [(r.score, r.doc_id % 7 != 0) for r in got if r.doc_id is not None and r.doc_id < 160 and r.held_out]
    assert sum((s >= 0.5) == y for s, y in judged) >= 0.9 * len(judged)


def test_language_columns_and_exact_sets(spark, folder, rows):
    got = run(spark, folder, "op5_language_id").collect()
    assert all(r.held_out == (remainder(r.doc_id, 4) == 2) and 0 <= r.score <= 1 for r in got)
    grams = lambda t: {t[i : i + n] for n in langid.ORDERS for i in range(len(t) - n + 1)}
    known, times = collections.defaultdict(set), collections.Counter()
    for r in rows:
        if r[1] is not None and r[2] and remainder(r[0], 4) != 2:
            times[r[2]] += 1
            known[r[2]] |= set().union(*(grams(f" {w} ") for w in re.findall(r"[^\W\d_]+", r[1].lower())))
    right = total = 0
    for r in got:
        (text,) = {x[1] for x in rows if x[0] == r.doc_id} if r.doc_id is not None and r.doc_id < 160 else (None,)
        if text is None:
            continue
        mine = [g for w in re.findall(r"[^\W\d_]+", text.lower()) for g in grams(f" {w} ")]
        total += 1
        right += max(known, key=lambda k: (sum(g in known[k] for g in mine), times[k])) == r.lang_pred
    assert right >= 0.97 * total
    assert {(r.doc_id, r.lang_pred, r.score) for r in got if r.doc_id in (300, 301, 302)} == {(i, "und", 0.0) for i in (300, 301, 302)}


def test_three_hundred_languages(spark):
    rng = random.Random(1)
    made = []
    for k in range(300):
        letters = [chr(0x4E00 + 8 * k + j) for j in range(8)]
        made += [(i + 3 * k, "".join(rng.choice(letters) for _ in range(40)), f"l{k:03}") for i in range(3)]
    docs = spark.createDataFrame(made, "doc_id long, text string, lang string")
    filters = langid.fit(docs)
    assert len(filters.languages) == 300
    assert all(r.lang_pred == r.lang for r in langid.predict(docs.filter("doc_id % 3 = 0"), filters).collect())


def test_vectors_by_brute_force(spark, folder):
    vectors = pq.read_table(f"{folder[0]}/embeddings.parquet").column("embedding").to_pylist()
    good = {i: np.array(v, float) / np.linalg.norm(v) for i, v in enumerate(vectors) if v and None not in v and np.isfinite(v).all() and any(v)}
    links = [(a, b) for a in good for b in good if a < b and good[a] @ good[b] >= 0.9]
    want = components_of(range(len(vectors)), links)
    got = {r.vec_id: r for r in run(spark, folder, "op6_vector_neardup").collect()}
    degree = collections.Counter(x for pair in links for x in pair)
    assert len(got) == len(vectors)
    assert sum(got[i].n_links for i in got) >= 0.9 * 2 * len(links) and all(got[i].n_links <= degree[i] for i in got)
    assert all(got[i].kept == (got[i].component_id == i) and got[i].component_id >= want[i] for i in got)


def plain_score(net, outputs):
    """The log-probability of one text, token by token."""
    w, h, before, total = {k: v.astype(float) for k, v in net.w.items()}, np.zeros(lm.HIDDEN), lm.HEADS, 0.0
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    softmax = lambda x: np.exp(x - x.max()) / np.exp(x - x.max()).sum()
    for out in outputs.tolist():
        gates = w["x"][before]
        z, r = np.split(sigmoid(gates[: 2 * lm.HIDDEN] + h @ w["u"]), 2)
        h = (1 - z) * h + z * np.tanh(gates[2 * lm.HIDDEN :] + (r * h) @ w["v"])
        classes = softmax(h @ w["c"] + w["cb"])
        members = [softmax(h @ w["m"][k] + w["mb"][k]) for k in range(lm.CLASSES)]
        every = np.concatenate([*(classes[k] * members[k] for k in range(lm.CLASSES)), classes[lm.CLASSES :]])
        assert every.sum() == pytest.approx(1) and len(every) == lm.HEADS + lm.SHAPES
        total, before = total + math.log(every[out]), out
    return total


def test_model_scores_equal_a_plain_loop():
    rng = np.random.default_rng(2)
    net = lm.Network(np.arange(50, dtype=np.int64))
    texts = [rng.integers(0, lm.HEADS + lm.SHAPES, n).astype(np.int16) for n in (1, 5, 40)]
    lm.train(net, texts * 3, None, 3, 2)
    cut = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    assert lm.score(net, np.concatenate(texts), cut) == pytest.approx([plain_score(net, t) for t in texts], rel=1e-4)


def test_model_columns(spark, folder, rows):
    got = run(spark, folder, "op7_gru_scores").collect()
    assert collections.Counter(r.doc_id for r in got) == collections.Counter(r[0] for r in rows)
    trained = [r for r in rows if remainder(r[0], 5) != 1]
    n = sum(len((r[1] or "").split()) + 1 for r in trained)
    assert {r.train_tokens for r in got} == {n} and all(math.isfinite(r.score) and r.held_out == (remainder(r.doc_id, 5) == 1) for r in got)
    assert collections.Counter((r.doc_id, r.n_tokens) for r in got) == collections.Counter((r[0], len((r[1] or "").split()) + 1) for r in rows)


def test_media_columns(spark, folder, rows):
    got = run(spark, folder, "op8_progressive_jpeg").collect()
    padded = lambda b: b + b"\xff" * ((-len(b)) % 576 if b else 576)
    want = collections.Counter()
    for r in rows:
        data = (r[1] or "").encode()
        full = padded(data)
        want[(r[0], len(data), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-32:]))] += 1
    assert collections.Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got) == want


def test_pages_lose_what_recurs_in_articles(spark, folder):
    got = {r.page_id: r.text for r in run(spark, folder, "op9_main_text").collect()}
    assert all(got[i] == f"Story {i} of ours." for i in range(40))  # no name says that the box is boilerplate
    assert got[90] == got[91] == "" and got[92] == "a" + " b" * 200000


def test_pages_keep_main_text():
    kept = "<article><div class='related-work'>one</div><p id='discussion'>Discussion of results</p><p class='notice-board'>two</p><math>x</math><div class='comments'>bad</div></article>"
    page = f"<body><nav>menu</nav>{kept}<article>second</article><article class='comment'>bad</article><footer>f</footer></body>"
    assert html.Page(page).text() == "one\nDiscussion of results\ntwo\nx\nsecond"
    assert html.Page("<main><article>teaser</article><p>The long main text</p></main>").text() == "teaser\nThe long main text"
    assert html.Page("a < b <c").text() == "a < b"


@pytest.mark.parametrize("bad", ["<a " * 350000, "<b>" * 60000 + "</i>" * 60000, '<a "' * 200000 + ">", '<a ">" ' * 100001, "<!" * 300000], ids=range(5))
def test_broken_pages_take_linear_time(bad):
    import time

    began = time.process_time()
    html.Page(bad).text()
    assert time.process_time() - began < 8


def test_tokens_equal_the_library(spark, folder, rows):
    import public_tokenizers

    ranks = tiktoken.load.load_tiktoken_bpe(bpe.vocabulary_path())
    library = tiktoken.Encoding("x", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = collections.Counter()
    for r in rows:
        ids = library.encode_ordinary(r[1] or "")
        want[(r[0], len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r[1] or "").encode()).hexdigest())] += 1
    assert collections.Counter(tuple(r) for r in run(spark, folder, "op10_byte_bpe").select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()) == want


def test_formats_by_name(spark, folder):
    got = {r.conv_id: r for r in run(spark, folder, "op3_prefix_targets").collect()}
    assert set(got) == {-1, 0, 1, 2, 3, 4}
    loss = "".join([f"say 2 1 </s>[INST]", ""])
    assert got[2].n_turns == 4 and got[2].loss_chars == len(loss) and got[2].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()


def test_pipeline_stages(spark, folder):
    docs, scratch, before = common.table(spark, folder[0], "documents"), common.Scratch(spark), None
    for name, stage in corpus_pipeline.STAGES:
        docs = scratch.keep(stage(spark, docs, folder[0]), "stage")
        found = docs.collect()
        if name == "language ID":
            assert not {300, 301, 302} & {r.doc_id for r in found} and {202, 400} <= {r.doc_id for r in found}
        elif name == "n-gram Jaccard join":
            texts = collections.defaultdict(list)
            for r in before:
                texts[r.doc_id].append(sets(r.text))
            ids = sorted(i for i in texts if i is not None)
            links = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if any(x and y and 100 * len(x & y) >= 75 * len(x | y) for x in texts[a] for y in texts[b])]
            least = components_of(ids, links)
            want = {(r.doc_id, r.text) for r in before if r.doc_id is None or least[r.doc_id] == r.doc_id}
            assert {(r.doc_id, r.text) for r in found} == want and len([r for r in found if r.doc_id is not None]) == len({x for x in want if x[0] is not None})
        elif name.startswith("mixing"):
            times = collections.Counter((r.doc_id, r.text) for r in found)
            assert set(times) == {(r.doc_id, r.text) for r in before}
        elif name.startswith("byte"):
            assert all(r.decoded_sha256 in {hashlib.sha256((b.text or "").encode()).hexdigest() for b in before if b.doc_id == r.doc_id} and r.n_tokens == len(r.token_ids) for r in found)
            continue
        assert docs.columns == corpus_pipeline.COLUMNS
        assert before is None or {r.doc_id for r in found} <= {r.doc_id for r in before}
        before = found
    assert importlib.import_module("__spark_entry__").queries()["pipeline"] is corpus_pipeline.run
