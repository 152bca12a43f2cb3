import base64
import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from disputa.llm import bpe, chat, html, jpeg, langid, lm, mixing, neardup_texts, neardup_vectors, quality

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, texts, langs=None, sources=None, first=0):
    rows = [(first + i, t, langs[i] if langs else "en", sources[i] if sources else f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def sets(text, width=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(zip(*(w[i:] for i in range(width)))) if len(w) >= width else frozenset([tuple(w)] if w else [])


def components_of(ids, links):
    up = {i: i for i in ids}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


# ---- Byte-level BPE


def test_bpe_equals_the_library():
    tiktoken, vocab = pytest.importorskip("tiktoken"), pytest.importorskip("public_tokenizers")
    with open(bpe.vocabulary_path(), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    own, theirs = bpe.tokenizer(bpe.vocabulary_path()), tiktoken.Encoding("own", pat_str=vocab.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(1)
    alphabet = list("abst'rvelm d\n\t  .!?19é 漢😀'’ _  ")
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 50))) for _ in range(1500)] + ["", None, "'s", "a" * 700, "ab" * 2000, " " * 300 + "x", "don't we'll I've'd"]
    ids, cut, first = own.encode(pa.array(texts))
    for i, t in enumerate(texts):
        mine = ids[cut[i] : cut[i + 1]]
        assert mine.tolist() == theirs.encode_ordinary(t or "")
        assert own.decode(mine) == (t or "").encode()
        starts = first[cut[i] : cut[i + 1]]
        assert starts.tolist() == np.concatenate(([0], np.cumsum(own.lengths[mine])))[:-1].tolist()


def test_bpe_frames(spark):
    docs = docs_of(spark, ["Hello world", None, "", "Hello world"]).withColumn("token_ids", F.lit("clash"))
    got = bpe.decode(bpe.encode(docs)).orderBy("doc_id").collect()
    assert [bytes(r.decoded) for r in got] == [b"Hello world", b"", b"", b"Hello world"] and got[0].token_ids == got[3].token_ids
    digest = bpe.digests(docs).orderBy("doc_id").first()
    assert digest.decoded_sha256 == hashlib.sha256(b"Hello world").hexdigest() and digest.ids_sha256 == hashlib.sha256(" ".join(map(str, got[0].token_ids)).encode()).hexdigest()
    assert bpe.digests(docs.limit(0)).count() == 0


# ---- Chat formatting


def test_chat_round_trip(spark):
    rng = random.Random(3)
    parts = ["\\", "n", "\n", "<", "|", "<|im_end|>", "[INST]", "</s>", "é", "<<SYS>>", "<|im_start|>user\n", "\r"]
    rows = [(c, t, rng.choice(["user", "assistant", "system", "a\\n\\", "x\ny\n\nz", "\\\\n"]), "".join(rng.choice(parts) for _ in range(rng.randint(0, 7)))) for c in range(60) for t in range(rng.randint(1, 4))]
    rows += [(None, 0, None, None), (None, 1, "assistant", None)]
    made = chat.examples(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1))).cache()
    want = collections.defaultdict(list)
    for c, _, r, x in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        want[c].append((r or "", x or ""))
    assert {r.conv_id: [(x.role, x.text) for x in r.t] for r in made.groupBy("conv_id").agg(F.max_by("formatted", "n_turns").alias("f")).select("conv_id", chat.parsed(F.col("f")).alias("t")).collect()} == dict(want)
    for r in chat.read_back(made).collect():
        replies = "".join(x for role, x in want[r.conv_id] if role == "assistant")
        assert (r.n_turns, r.loss_chars, r.loss_sha256) == (len(want[r.conv_id]), len(replies), hashlib.sha256(replies.encode()).hexdigest())
    assert all(x.target_turn is None or x.target_turn == x.n_turns for x in made.collect())
    assert made.filter("formatted RLIKE '</s>' OR formatted LIKE '%[INST]%'").count() == 0


# ---- Progressive JPEG


def test_jpeg_round_trip_and_plain_reader(monkeypatch):
    rng = np.random.default_rng(0)
    for n in (0, 1, 576, 576 * 7, 576 * 60):
        payload = rng.integers(0, 256, n, dtype=np.uint8).tobytes()
        image = jpeg.decode(jpeg.encode(payload))
        assert jpeg.payload_of(image) == payload and jpeg.to_rgb(image).shape == (image.height, image.width, 3)
    file = jpeg.encode(payload)
    for name in ("_fixed", "_refined_whole", "_first_fast"):
        monkeypatch.setattr(jpeg, name, lambda *a: False)
    plain = jpeg.decode(file)
    assert all((a.blocks == b.blocks).all() for a, b in zip(plain.components, image.components))
    with pytest.raises(ValueError):
        jpeg.decode(b"no")


def test_jpeg_runs_and_refinement():
    """A grey file of two blocks, written bit by bit: a run of zeros, an end of band over blocks, and new coefficients in a refinement."""
    symbols = [0x00, 0x01, 0x02, 0x10, 0x21, 0x31, 0x11, 0x41]
    table = lambda kind: jpeg._segment(0xC4, jpeg._table(kind, 0, 4, symbols))
    code = {s: f"{i:04b}" for i, s in enumerate(symbols)}
    pack = lambda bits: int(bits + "1" * (-len(bits) % 8), 2).to_bytes(-(-len(bits) // 8), "big").replace(b"\xff", b"\xff\x00")
    scan = lambda a, b, h, l: jpeg._segment(0xDA, bytes([1, 1, 0, a, b, h << 4 | l]))
    head = b"\xff\xd8" + jpeg._QUANT + jpeg._segment(0xC2, bytes([8, 0, 8, 0, 16, 1, 1, 0x11, 0])) + table(0) + table(1)
    first = code[0x02] + "11" + code[0x01] + "0"  # 3, then 3 - 1
    band = code[0x21] + "1" + code[0x10] + "0"  # two zeros, then 1 << 1; an end of band over two blocks
    refine = code[0x11] + "1" + "1" + code[0x10] + "0"
    # in the first block: skip one zero, correct nothing before it, new +1 at 2; then the rest: a correction bit of 3 is read on the way out
    refine = code[0x11] + "1" + code[0x10] + "0" + "1"
    image = jpeg.decode(head + scan(0, 0, 0, 0) + pack(first) + scan(1, 63, 0, 1) + pack(band) + scan(1, 63, 1, 0) + pack(refine) + b"\xff\xd9")
    blocks = image.components[0].blocks.reshape(-1, 64)
    assert blocks[0, :5].tolist() == [3, 0, 1, 3, 0] and blocks[1, :5].tolist() == [2, 0, 0, 0, 0] and not blocks[:, 5:].any()


def test_jpeg_columns(spark):
    got = {r.doc_id: r for r in jpeg.stored_features(docs_of(spark, ["a", None, "", "a", "é" * 900])).collect()}
    assert got[0][1:] == got[3][1:] and got[1].n_bytes == 0 and got[1].payload_bytes == 576 and got[4].n_bytes == 1800
    payload = "a".encode() + b"\xff" * 575
    assert got[0].payload_sha256 == hashlib.sha256(payload).hexdigest() and got[0].tail_crc32 == zlib.crc32(payload[-32:])
    files = spark.createDataFrame([(1, jpeg.encode(b"x" * 900)), (2, None)], "id int, jpeg binary")
    rows = {r.id: r for r in jpeg.tensors(files).collect()}
    assert len(rows[1].rgb) == rows[1].height * rows[1].width * 3 and rows[2].rgb is None


# ---- Language, quality


def speech(rng, syllables, n):
    return " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(n))


def test_language(spark):
    rng = random.Random(2)
    kinds = {"aa": ["ba", "lu", "ti"], "bb": ["xo", "kri", "ze"], "cc": ["ß", "mü", "öl"]}
    texts, langs = zip(*[(speech(rng, s, rng.randint(3, 30)), k) for k, s in kinds.items() for _ in range(60)])
    filters = langid.fit(docs_of(spark, texts, langs))
    asked = docs_of(spark, [speech(rng, s, 8) for s in kinds.values()] + [None, "", "123 !!", "ÞÞÞ"]).withColumn("lang_pred", F.lit("x"))
    got = [(r.lang_pred, r.lang_score) for r in langid.predict(asked, filters).orderBy("doc_id").collect()]
    assert [g[0] for g in got[:3]] == ["aa", "bb", "cc"] and got[3:6] == [("und", 0.0)] * 3 and got[6] == ("aa", 0.0)
    assert langid.predict(asked.limit(0), filters).count() == 0
    nothing = langid.fit(docs_of(spark, ["x"], [None]))
    assert {r.lang_pred for r in langid.predict(asked, nothing).collect()} == {"und"}


def test_quality(spark):
    rng = random.Random(4)
    good = [speech(rng, ["ba", "lu", "ti", "no"], 30) + "." for _ in range(80)]
    bad = [" ".join(w + rng.choice(["###", "%%%"]) for w in speech(rng, ["ba", "lu", "ti", "no"], 30).split()) for _ in range(80)]
    docs = docs_of(spark, good + bad)
    labels = spark.createDataFrame([(i, int(i < 80)) for i in range(160) if i % 4] + [(9999, None), (1, 1)], "doc_id long, quality int")
    model = quality.fit(docs, labels)
    got = {r.doc_id: r.quality_score for r in quality.predict(docs, model).collect()}
    assert sum((got[i] >= 0.5) == (i < 80) for i in range(0, 160, 4)) >= 38
    odd = [r.quality_score for r in quality.predict(docs_of(spark, [None, "", "x" * 20000]), model).collect()]
    assert len(odd) == 3 and all(0 <= s <= 1 for s in odd)
    none = quality.fit(docs, labels.limit(0))
    assert {r.quality_score for r in quality.predict(docs, none).collect()} == {0.5}


# ---- Language model


def test_language_model(spark):
    rng = random.Random(5)
    texts = [" ".join(["The", "cat" if i % 2 else "dog"] * rng.randint(1, 8) + [f"w{i}"]) for i in range(60)] + [None, "", "The cat", "The cat"]
    docs = docs_of(spark, texts)
    training = docs.filter("doc_id % 5 <> 1").select("doc_id", "text")
    counts = lm.count(training)
    got = collections.defaultdict(list)
    for r in lm.scores(docs, lm.fit(training, counts), counts).collect():
        got[r.doc_id].append(r)
    cut = lambda t: [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")] + [None]
    c = collections.Counter(w for i, t in enumerate(texts) if i % 5 != 1 for w in cut(t))
    n, v = sum(c.values()), len(c)
    for i, t in enumerate(texts):
        (r,) = got[i]
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in cut(t)))
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(cut(t)), sum(c[w] > 0 for w in cut(t)), n) and math.isfinite(r.score)
    assert got[62][0].score == pytest.approx(got[63][0].score)
    assert lm.scores(docs.limit(0), lm.fit(training, counts), counts).count() == 0


def test_language_model_learns_from_all_texts(spark, monkeypatch):
    docs = docs_of(spark, [" ".join("abcdefgh"[(i + k) % 8] for k in range(40)) for i in range(1200)])
    counts = lm.count(docs)
    monkeypatch.setattr(lm, "SHARD", 25000)
    model = lm.fit(docs, counts, fit_rows=0)  # what is learned comes from the shards
    rows = lm.scores(docs, model, counts).collect()
    assert sum(r.score for r in rows) > 0.8 * sum(r.base_score for r in rows)  # the order of words is known
    again = lm.fit(docs.repartition(5, "text"), counts, fit_rows=0).net.w
    assert all(np.allclose(again[k], w, atol=1e-4) for k, w in model.net.w.items())


def test_every_training_text_changes_the_weights(spark):
    docs = docs_of(spark, [" ".join("abcdefgh"[(i * k) % 8] for k in range(20 + i)) for i in range(8)]).select("doc_id", "text")
    net = lm.Network(np.sort(lm.tokens(pa.array(["a b c d e f g h"]))[0]))
    weights = lambda rows: np.concatenate([w.reshape(-1) for w in lm.train_shards(rows, net, 300).w.values()])
    whole = weights(docs)
    assert not any(np.array_equal(weights(docs.filter(f"doc_id <> {i}")), whole) for i in range(8))


def test_nothing_is_stepped_for_lanes_that_have_ended(monkeypatch):
    net, seen, factored = lm.Network(np.arange(50, dtype=np.int64)), [], lm._factored
    monkeypatch.setattr(lm, "_factored", lambda x: (seen.append(net.w["x"][lm.HEADS].copy()), factored(x))[1])  # once a step
    texts = [(np.arange(k) % 50).astype(np.int16) for k in (6 * lm.WINDOW, 5)]
    lm.train(net, texts, None, 2, 1)
    # The first shape is the input where texts begin, all of it in the first step, and of a lane that has ended.
    assert len(seen) == 6 and not np.array_equal(seen[0], seen[1]) and all(np.array_equal(x, seen[1]) for x in seen[2:])


def test_states_are_carried():
    net = lm.Network(np.arange(10, dtype=np.int64))
    rng = np.random.default_rng(1)
    texts = [rng.integers(0, 10, k).astype(np.int16) for k in (1, 40, 7, 100, 33)]
    cut = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    together = lm.score(net, np.concatenate(texts), cut)
    alone = [lm.score(net, t, np.array([0, len(t)]))[0] for t in texts]
    assert together == pytest.approx(alone, rel=1e-4)


# ---- Mixing


def test_mixture(spark):
    plan = mixing.solve([36] + [3] * 19, 0.95, 4.0)
    assert mixing.entropy(plan.weights) == pytest.approx(0.95 * math.log(20), abs=1e-6) and min(q / t for q, t in zip(plan.quotas, [36] + [3] * 19)) >= 1 - 0.02
    tight = mixing.solve([36] + [3] * 19, 0.999, 1.5)
    assert max(q / t for q, t in zip(tight.quotas, [36] + [3] * 19)) <= 1.5 + 0.2 and mixing.solve([], 0.9, 2).quotas == [] and mixing.solve([0, 0], 0.9, 2).budget == 0
    rng = random.Random(6)
    texts = [" ".join("w" for _ in range(rng.randint(0, 9))) for _ in range(400)]
    sources = [None if i % 50 == 0 else "big" if i % 2 else f"s{i % 4}" for i in range(400)]
    docs = docs_of(spark, texts + [None], sources=sources + ["big"]).withColumn("mix_epoch", F.lit("clash"))
    rows = mixing.mix(docs).collect()
    seen = collections.Counter(r.doc_id for r in rows)
    assert set(seen) == set(range(401))
    size = lambda rs: sum(len((r.text or "").split()) for r in rs)
    names = sorted(set(sources), key=lambda s: (s is not None, s or ""))
    totals = [size([r for r in docs.collect() if r.source == s]) for s in names]
    for s, quota in zip(names, mixing.solve(totals).quotas):
        spent = size([r for r in rows if r.source == s])
        assert quota - 9 <= spent <= quota
    assert mixing.mix(docs.limit(0)).count() == 0


# ---- Pages


def test_main_text(spark):
    page = "<html><body><header><h1>Site</h1></header><nav>n</nav><div class='cookie-notice'>We use</div><main><article><header><h1>T&eacute;st</h1></header><p>One <i>two</i>\nthree&nbsp;four<p>Second<br>line</p><ul><li>a<li>b</ul><div class=\"share-bar\">S</div><form>x<input></form><!-- c --><section id=comments><p>Nice!</p></section><script>var a='</p>'</script></article></main><footer>f</footer></body></html>"
    assert html.Page(page).text() == "Tést\nOne two three four\nSecond line\na\nb"
    # Without an article, what recurs on a host's pages goes; a copy of a page is no recurrence.
    plain = lambda i: f"<body><div><p>All about us</p></div><div><p>Story {i} is long.</p></div></body>"
    rows = [(i, "http://H.example/x", plain(i)) for i in range(6)] + [(6, "http://h.example:80/y", plain(0)), (7, "http://few.example/", plain(7)), (8, None, None), (9, "http://h.example/", "")]
    got = {r.page_id: r.text for r in html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(0))).collect()}
    assert got[3] == "Story 3 is long." and got[6] == "Story 0 is long." and got[7] == "All about us\nStory 7 is long." and got[8] == got[9] == ""
    assert html.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_template_inside_articles(spark):
    box = "<div class=x1><p>More from <i>our</i> desk</p><ul><li>Write to us</ul></div>"
    page = lambda i, more="": f"<body><p>Menu {more}</p><article><h2>Summary</h2><p>Story {i} is <b>our</b> own.</p>{box}{'<p>Shared passage.</p>' if i % 4 == 0 else ''}</article></body>"
    rows = [(i, "http://h.example/", page(i)) for i in range(12)] + [(20 + i, "http://h.example/", page(12, i)) for i in range(30)]  # one article on 30 pages
    rows += [(60 + i, "http://few.example/", page(i)) for i in range(9)]
    got = {r.page_id: r.text for r in html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1] == "Summary\nStory 1 is our own." and got[4] == got[1].replace("1", "4") + "\nShared passage."
    assert got[20] == "Summary\nStory 12 is our own.\nShared passage." and "our desk\nWrite to us" in got[61]


# ---- Near-duplicates


def test_vectors(spark):
    rng = np.random.default_rng(7)
    base = rng.normal(size=(40, 16))
    vectors = [*base.tolist(), *(base[:6] + 0.1 * rng.normal(size=(6, 16))).tolist(), *[base[0].tolist()] * 3, *(base[1] + 0.05 * rng.normal(size=(25, 16))).tolist(), (3 * base[2]).tolist(), None, [0.0] * 16, [float("nan")] * 16, [1.0, None], [], [1.0, 2.0]]
    frame = spark.createDataFrame([(i, v, i % 3) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: r for r in neardup_vectors.near_duplicates(frame, recall=0.999).collect()}
    good = [i for i, v in enumerate(vectors) if v and len(v) == 16 and np.isfinite(np.array(v, float)).all() and any(v)]
    unit = np.array([np.array(vectors[i], np.float32).astype(float) for i in good])
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.9
    links = [(good[a], good[b]) for a, b in zip(*np.nonzero(near)) if a < b]
    want = components_of(range(len(vectors)), links)
    assert {i: got[i].component_id for i in got} == want and len(got) == len(vectors)
    for k, i in enumerate(good):
        assert got[i].n_links == near[k].sum() - 1
    assert neardup_vectors.near_duplicates(frame.limit(0)).count() == 0


def test_vectors_of_a_dense_topic(spark, monkeypatch):
    monkeypatch.setattr(neardup_vectors, "BLOCK", 32)  # hot buckets take several blocks
    rng = np.random.default_rng(11)
    topic = rng.normal(size=64) / 8
    base = topic + 0.5 * rng.normal(size=(1500, 64)) / 8  # mutual cosine about 0.8
    near = base[:300] + 0.29 * rng.normal(size=(300, 64)) / 8  # about 0.94 to its original
    vectors = np.concatenate([base, near]).astype(np.float32)
    unit = vectors.astype(float) / np.linalg.norm(vectors.astype(float), axis=1, keepdims=True)
    close = np.triu(unit @ unit.T >= 0.9, 1)
    order = rng.permutation(len(vectors)).tolist()
    frame = spark.createDataFrame([(order[i], v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>")
    got = {r.vec_id: r.component_id for r in neardup_vectors.near_duplicates(frame).collect()}
    links = [(order[a], order[b]) for a, b in zip(*np.nonzero(close))]
    want = components_of(range(len(vectors)), links)
    assert np.median((unit @ unit.T)[:1500, :1500]) > 0.75 and len(links) >= 250
    assert all(want[got[i]] == want[i] for i in got)
    assert sum(got[a] == got[b] for a, b in links) >= neardup_vectors.RECALL * len(links)


def test_texts(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    common = [word() for _ in range(40)]
    texts = [None, "", "  \n", "One two", "one TWO", "a b c d e", "a b c d e"]
    for size in (12, 40, 90, 300):
        for _ in range(4):
            base = [word() for _ in range(size)]
            if size == 90:
                base[:40] = common
            for _ in range(rng.randint(1, 12)):
                copy = list(base)
                for _ in range(rng.randint(0, max(1, size // 14))):
                    at = rng.randrange(len(copy))
                    copy[at : at + rng.randint(0, 1)] = [word()] * rng.randint(0, 2)
                texts.append(" ".join(copy))
    texts += [texts[-1]] * 3
    rng.shuffle(texts)
    docs = docs_of(spark, texts).repartition(3).withColumn("n", F.lit(1)).withColumn("component", F.lit("x"))
    held = [sets(t) for t in texts]
    links = [(i, j) for i in range(len(texts)) for j in range(i) if held[i] and held[j] and 100 * len(held[i] & held[j]) >= 75 * len(held[i] | held[j])]
    want = components_of(range(len(texts)), links)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup_texts.near_duplicates(docs).collect()}
    assert got == {i: (len(held[i]), want[i]) for i in range(len(texts))}


def test_group_comparison():
    rng = np.random.default_rng(9)
    sets_ = [np.unique(rng.integers(0, 60, rng.integers(1, 40)).astype(np.uint64)) for _ in range(60)] + [np.arange(20, dtype=np.uint64)] * 2
    near = neardup_texts._similar(sets_, 16)
    for i, a in enumerate(sets_):
        for j, b in enumerate(sets_):
            shared = len(np.intersect1d(a, b))
            assert near[i, j] == (shared > 0 and 100 * shared >= 75 * (len(a) + len(b) - shared))
    assert components_of(range(62), neardup_texts._forest(near)) == components_of(range(62), list(zip(*np.nonzero(near))))


def test_prefixes_share_enough():
    """Two similar sets share at least the smaller l of tokens in their prefixes, whatever the estimates."""
    rng = np.random.default_rng(10)
    for _ in range(300):
        base = rng.choice(400, rng.integers(1, 80), replace=False)
        a, b = (np.union1d(rng.choice(base, max(1, int(len(base) * rng.uniform(0.85, 1))), replace=False), rng.integers(0, 400, rng.integers(0, 4))) for _ in range(2))
        shared = len(np.intersect1d(a, b))
        if 100 * shared < 75 * len(np.union1d(a, b)):
            continue
        estimates = rng.integers(1, 50, 400)
        order = np.lexsort((np.arange(400), estimates))
        rank = np.empty(400, int)
        rank[order] = np.arange(400)
        cut = []
        for s in (a, b):
            s = s[np.argsort(rank[s])]
            size, l, _ = neardup_texts.prefix(estimates[s], 5.0)
            cut.append((s[:size], l))
        assert len(np.intersect1d(cut[0][0], cut[1][0])) >= min(cut[0][1], cut[1][1])


def test_groups_and_buckets_of_many_blocks(spark, monkeypatch):
    rng = random.Random(12)
    base = [f"w{k}" for k in range(60)]
    texts = []
    for i in range(90):  # a group whose members are similar to some of the others only
        words = list(base)
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(60)] = f"x{rng.randint(0, 30)}"
        texts.append(" ".join(words))
    for i in range(40):  # other texts that all begin alike
        texts.append(" ".join(base[:9] + [f"y{rng.randint(0, 60)}" for _ in range(12)]))
    texts += texts[95:99] + [texts[3]]
    monkeypatch.setattr(neardup_texts, "BLOCK", 400)
    monkeypatch.setattr(neardup_texts, "BUCKET_BLOCK", 8)
    held = [sets(t) for t in texts]
    links = [(a, b) for a in range(len(texts)) for b in range(a) if 100 * len(held[a] & held[b]) >= 75 * len(held[a] | held[b])]
    want = components_of(range(len(texts)), links)
    assert {r.doc_id: r.component_id for r in neardup_texts.near_duplicates(docs_of(spark, texts)).collect()} == want and len(set(want.values())) > 2


def test_tiles_compare_everything(monkeypatch):
    monkeypatch.setattr(neardup_texts, "TILE", 8)
    rng = np.random.default_rng(4)
    held = [np.unique(rng.choice(40, 30).astype(np.uint64)) for _ in range(37)]
    ids = rng.permutation(37)
    got = components_of(range(37), [(int(a), int(b)) for x, y in neardup_texts._linked(ids, held) for a, b in zip(x, y)])
    near = lambda x, y: 100 * len(set(x) & set(y)) >= 75 * len(set(x) | set(y))
    assert got == components_of(range(37), [(int(ids[i]), int(ids[j])) for i in range(37) for j in range(i) if near(held[i].tolist(), held[j].tolist())])
