"""Learned operators: held-out accuracy, agreement of tasks with plain numpy, odd rows."""

import random
import re
import sys
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablewarden.llm import langid, lm_score, toxicity, weak_labels
from tablewarden.llm.common import bounded_sample, even_choice
from tablewarden.llm.tokens import chunks, letters, runs, shingles, words


def prose(rng, n, words_):
    return " ".join(rng.choice(words_) for _ in range(n))


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


# -- tokens ------------------------------------------------------------------------------------------------------


def test_words_are_those_of_bytes_split(corpus, odd_rows):
    texts = [(r[1] or "").encode() for r in [*corpus, *odd_rows]]
    seen = {}
    for c in chunks(texts):
        t = words(c)
        for row, a, z in zip(c.rows, t.first[:-1], t.first[1:], strict=True):
            plain = texts[row].lower().split()
            assert z - a == len(plain)
            for w, h in zip(plain, t.hash[a:z].tolist(), strict=True):
                assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)


def test_equal_windows_have_equal_hashes():
    t = words(next(chunks([b"a b c a b c a b", b"a b"])))
    assert runs(t.hash, (0, 1))[0] == runs(t.hash, (0, 1))[3] == runs(t.hash, (0, 1))[8]
    assert runs(t.hash, (0, 1))[0] != runs(t.hash, (0, 2))[1]
    assert [len(x) for x in shingles(words(next(chunks([b"a b c d e f", b"a b", b"", b" "]))))] == [2, 1, 0, 0]


def test_long_words_do_not_collide():
    def thue_morse(n, flip=0):
        return bytes(b"ab"[(bin(i).count("1") + flip) % 2] for i in range(n))

    h = words(next(chunks([thue_morse(2048) + b" " + thue_morse(2048, 1)]))).hash
    assert h[0] != h[1]


def test_letters_fold_latin_capitals():
    a, b = (letters(next(chunks([t.encode()]))).hash.tolist() for t in ("ÉCOLE Über", "école über"))
    assert a == b


# -- language ID -------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def languages(docs):
    return langid.op5(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()


def test_language_held_out_accuracy(languages):
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in languages)
    held = [r for r in languages if r["held_out"]]
    assert len(held) > 30 and np.mean([r["lang"] == r["lang_pred"] for r in held]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in languages)


def test_language_scores_do_not_see_labels(docs, languages):
    swapped = docs.withColumn("lang", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, "xx").otherwise(F.col("lang"))).withColumn("source", F.lit("z"))
    again = by_id(langid.op5(swapped))
    assert all(again[r["doc_id"]]["score"] == r["score"] and again[r["doc_id"]]["lang_pred"] == r["lang_pred"] for r in languages)


def test_unknown_script_is_rejected(docs):
    model = langid.fit(docs, F.lit(True))
    r = langid.identify(docs.sparkSession.createDataFrame([(1, "这是一个没有见过的语言 他们说"), (2, "12 34")], "doc_id long, text string"), model)
    got = by_id(r)
    assert got[1]["rejected"] and got[2]["rejected"] and got[2]["lang_pred"] == "und"


def test_repeated_rows_take_no_class_away(spark):
    """One row 20,000 times among 40 others of its language: counts are of distinct rows, small classes stay whole."""
    rng = random.Random(8)
    rows = [(i, prose(rng, 30, "the house of stone and river".split()), "en") for i in range(400)] + [(1000 + i, prose(rng, 30, "das haus der stein und fluss".split()), "de") for i in range(40)]
    again = spark.range(20_000).select(F.lit(5000).cast("long").alias("doc_id"), F.lit("der fluss und das haus").alias("text"), F.lit("de").alias("lang"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").unionByName(again)
    sample = bounded_sample(docs, "lang", 100, ["doc_id", "text"]).distinct().groupBy("lang").count()
    got = {r["lang"]: r["count"] for r in sample.collect()}
    assert got["de"] == 41 and 60 < got["en"] < 150
    assert langid.fit(docs, F.lit(True)).classes == ["de", "en"]
    votes = docs.select("doc_id", "text")
    assert {r["kept"] for r in weak_labels.classify(votes).select("kept").distinct().collect()} <= {True, False}


def test_long_rows_lose_different_features():
    f = np.arange(1000)
    a, b = even_choice(f, 1, 100), even_choice(f, -2, 100)
    assert len(a) == len(b) == 100 and len(set(a) & set(b)) < 40 and (np.diff(a) > 0).all()
    assert (even_choice(f[::-1], 3, 1000) == f).all()


def test_words_of_any_length_are_learnt(spark):
    """A language without spaces: what tells it apart stands behind the first characters of its only word."""
    rows = [(i, "abc" * 30 + ("xyz" if i % 2 else "uvw") * 60, "a" if i % 2 else "b") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs, F.lit(True))
    found = langid.identify(spark.createDataFrame([(1, "xyz" * 20), (2, "uvw" * 20)], "doc_id long, text string"), model).collect()
    assert {r["doc_id"]: r["lang_pred"] for r in found} == {1: "a", 2: "b"}


def test_wrong_labels_do_not_move_the_rejection_bar():
    rng = np.random.default_rng(11)
    vocabulary = {"en": "the of and to in is that for it as was with house river stone walking".split(), "de": "der die das und den von zu mit sich des auf ist haus fluss stein gehen".split()}
    truth = [("en", "de")[i % 2] for i in range(2000)]
    texts = [" ".join(rng.choice(vocabulary[x], int(rng.integers(8, 60)))).encode() for x in truth]
    for noise in (0.0, 0.02, 0.05):
        labels = [("de" if x == "en" else "en") if rng.random() < noise else x for x in truth]
        model = langid.train(texts, labels)
        p, known = model.predict(texts)
        kept = (p.max(axis=1) >= model.least) & (known >= model.least_known)
        assert kept.mean() > 0.97, (noise, model.least)
        assert np.mean([model.classes[k] == x for k, x in zip(p.argmax(axis=1), truth, strict=True)]) > 0.97


def test_language_of_odd_rows(odd, none):
    rows = langid.op5(odd).collect()
    assert len(rows) == 10
    assert {r["lang_pred"] for r in rows if r["doc_id"] in (None, 1, 2, 3)} == {"und"}
    assert {r["score"] for r in rows if r["doc_id"] in (None, 1, 2, 3)} == {0.0}
    assert langid.op5(none).count() == 0


# -- toxicity ----------------------------------------------------------------------------------------------------


def test_toxicity_learns_pairs_and_skips(spark):
    rng = np.random.default_rng(2)
    fill = "the of and to house river stone made light other".split()
    rows = []
    for i in range(400):
        w = [fill[k] for k in rng.integers(0, 10, 30)]
        if i % 4 == 0:
            at = int(rng.integers(0, 28))
            w[at], w[at + 2] = "you", "fool"  # only the two together, one word apart, are bad
        else:
            w[3], w[20] = "you", "fool"
        rows.append((i, " ".join(w), int(i % 4 == 0)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    got = toxicity.op3(df.select("doc_id", "text"), df.select("doc_id", "toxic"), toxicity.FtrlOptions(l1=1.0)).join(df, "doc_id").collect()
    held = [r for r in got if r["held_out"]]
    assert len(held) > 40 and np.mean([r["predicted"] == r["toxic"] for r in held]) > 0.95


def test_weights_are_sparse_and_scores_are_sums():
    texts = [b"good day to you", b"bad bad fool", b"", None]
    f = toxicity.features(texts, 1 << 12)
    model = toxicity.train(f[:2] * 20, np.array([0, 1] * 20), np.ones(40), toxicity.FtrlOptions(buckets=1 << 12, l1=0.5))
    assert 0 < len(model.index) <= len(np.unique(np.concatenate(f)))
    dense = model.dense()
    plain = [1 / (1 + np.exp(-(model.bias + dense[x].sum()))) for x in f]
    assert np.allclose(toxicity.score(texts, model, dense), plain)


def test_toxicity_of_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(4, 0, 1), (4, 0, 1), (5, 1, 0), (6, 1, 0), (None, 1, 1), (99, 0, 1), (8, 1, None)], "doc_id long, quality int, toxic int")
    rows = toxicity.op3(odd, labels).collect()
    assert len(rows) == 10 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)
    assert len({r["score"] for r in rows if r["doc_id"] in (1, 2, 3)}) == 1
    assert toxicity.op3(none, labels).count() == 0
    assert {r["score"] for r in toxicity.op3(odd, labels.limit(0)).collect()} == {0.5}


# -- weak labels -------------------------------------------------------------------------------------------------


def plain_metrics(text):
    """The nine metrics of one text, a word at a time; letters are A-Z, a-z and everything beyond ASCII."""
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if x]
    if not w:
        return [0.0] * 9
    n, chars = len(w), sum(map(len, w))
    symbols = [sum(c in "#*$%&|<>{}[]\\^~=_@" for c in x) for x in w]
    alpha = [sum(c.isascii() and c.isalpha() or not c.isascii() for c in x) for x in w]
    windows = [tuple(w[i : i + 5]) for i in range(n - 4)]
    return [
        n, sum(symbols) / chars, sum(a == 0 for a in alpha) / n, len(set(w)) / (2 * n) ** 0.5,
        1 - len(set(windows)) / len(windows) if windows else 0.0, sum(0 < a <= 3 for a in alpha) / n, chars / n,
        sum(any(c in ".!?" for c in x) for x in w) / n, sum(k > 0 for k in symbols) / n,
    ]


def test_metrics_and_patterns_equal_a_plain_count(docs, corpus, odd_rows):
    texts = [r[1] for r in [*corpus, *odd_rows]]
    for c in chunks([None if t is None else t.encode() for t in texts]):
        got = weak_labels.measure(c)
        for row, m in zip(c.rows, got, strict=True):
            assert m == pytest.approx(plain_metrics(texts[row]), abs=1e-12), texts[row]
    # what the query says of a document is what a plain reading of the labellers' table says
    seen = by_id(weak_labels.op1(docs))
    for doc_id, text, *_ in corpus:
        votes = 0
        for value, x in zip(plain_metrics(text), weak_labels.LABELLERS, strict=True):
            bad, good = (any(low <= value < high for low, high in ranges) for ranges in (x.bad, x.good))
            votes = votes * 3 + (0 if bad else 2 if good else 1)
        assert seen[doc_id]["pattern"] == votes


def test_scorer_equals_plain_descent():
    """Training against a loop over single weights in dictionaries."""
    rng = np.random.default_rng(3)
    o = weak_labels.WeakOptions(buckets=64, epochs=3)
    rows = [np.unique(rng.integers(0, 64, rng.integers(0, 9))) for _ in range(40)]
    metrics, target = rng.random((40, 9)) * 30, rng.random(40)
    got = weak_labels.train(rows, metrics, target, o)

    weight, seen, shape_weight, shape_seen, bias, bias_seen = {}, {}, [0.0] * 18, [1e-4] * 18, 0.0, 1e-4
    order = np.random.default_rng(23)
    for _ in range(o.epochs):
        for i in order.permutation(40):
            m = [np.log1p(metrics[i][0]) / 5, *(min(x, 20) for x in metrics[i][1:])]
            m[3], m[6] = m[3] / 5, m[6] / 5
            m += [x * x for x in m]
            scale = 1 / max(1, len(rows[i])) ** 0.5
            z = bias + sum(a * b for a, b in zip(m, shape_weight, strict=True)) + sum(scale * weight.get(f, 0.0) for f in rows[i].tolist())
            e = 1 / (1 + np.exp(-min(max(z, -30), 30))) - target[i]
            for f in rows[i].tolist():
                seen[f] = seen.get(f, 1e-4) + (e * scale) ** 2
                w = weight.get(f, 0.0)
                weight[f] = w - o.rate * (0.1 * e * scale / seen[f] ** 0.5 + o.l2 * w)
            for j, x in enumerate(m):
                shape_seen[j] += (e * x) ** 2
                shape_weight[j] -= o.rate * e * x / shape_seen[j] ** 0.5
            bias_seen += e * e
            bias -= o.rate * e / bias_seen**0.5
    assert got.weight == pytest.approx([weight.get(f, 0.0) for f in range(64)])
    assert got.shape_weight == pytest.approx(shape_weight) and got.bias == pytest.approx(bias)


def test_expectation_maximisation_recovers_accuracies():
    rng = np.random.default_rng(8)
    truth = rng.random(20_000) < 0.8
    blame = np.array([0.7, 0.5, 0.6, 0.4])
    votes = np.where(truth[:, None], np.where(rng.random((20_000, 4)) < 0.02, 0, 2), np.where(rng.random((20_000, 4)) < blame, 0, 2))
    code, inverse, n = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    good, tables, share = weak_labels.expectation_maximisation(code, n.astype(float), weak_labels.WeakOptions(prior=0.02))
    assert np.abs(share[1] - 0.8) < 0.05
    assert np.abs(tables[:, 0, 0] - blame).max() < 0.1
    assert ((good[inverse.ravel()] > 0.5) == truth).mean() > 0.93


def test_pattern_codes_round_trip():
    codes = np.arange(weak_labels.VOTES ** len(weak_labels.LABELLERS))[::37]
    v = weak_labels.votes_of(codes)
    assert (v @ (weak_labels.VOTES ** np.arange(len(weak_labels.LABELLERS))[::-1]) == codes).all()


def test_quality_keeps_prose_and_drops_junk(spark, corpus):
    junk = [(1000 + i, t, None, None, 0) for i, t in enumerate(["spam " * 300, "| a | b | " * 60, "x### y$$$ z&&& " * 40, "BUY!!! NOW!!!"] * 12)]
    df = spark.createDataFrame([*corpus, *junk], "doc_id long, text string, lang string, source string, n_chars long").repartition(2)
    got = by_id(weak_labels.op1(df))
    prose = [got[i]["kept"] for i, t, *_ in corpus if len(t.split()) >= 40]
    assert np.mean(prose) > 0.95
    assert np.mean([got[r[0]]["kept"] for r in junk]) < 0.1


def test_quality_of_odd_rows(odd, none):
    rows = weak_labels.op1(odd).collect()
    assert len(rows) == 10
    assert not any(r["kept"] for r in rows if r["doc_id"] in (None, 1, 2, 3, 4))
    same = [r[1:] for r in rows if r["doc_id"] in (7, 8)]
    assert same[0] == same[1] == same[2]
    assert weak_labels.op1(none).count() == 0


# -- LM scoring --------------------------------------------------------------------------------------------------


def test_scores_are_sums_of_masked_predictions(docs, corpus):
    o = lm_score.LmOptions(buckets=1 << 10, classes=16, own=8, hidden=6, batch=32)
    got = by_id(lm_score.log_likelihood(docs, o))
    vocab, net = lm_score.fit(docs.select(F.col("text").cast("binary").alias("text")), o)

    def buckets(t):
        """Shape of each token in the lowest place, its hash above."""
        h = words(next(chunks([t.encode()]))).hash
        raw = re.findall(rb"[^\x20\x09-\x0D]+", t.encode())
        shape = [
            (w[-1:] in b".!?") + 2 * (b"A" <= w[:1] <= b"Z") + 4 * any(x >= 128 for x in w) + 8 * (w[-1:] in b",;:)]}\"'") + 16 * (len(w) > 6)
            for w in raw
        ]
        return np.array([int(x) % 128 * 8 + s % 8 for x, s in zip(h, shape, strict=True)])

    counts = np.zeros(o.buckets)
    for _, t, *_ in corpus:
        np.add.at(counts, buckets(t), 1)
    smooth = counts + o.smoothing
    for i, t, *_ in corpus[::40]:
        b = buckets(t)
        c = vocab.cls[b].astype(int)
        total = 0.0
        for k in range(len(b)):
            h = net.bias.copy().astype(float)
            for s, d in enumerate(net.sides):
                h += net.inputs[s][c[k + d] if 0 <= k + d < len(b) else o.classes]
            z = np.tanh(h) @ net.outputs + net.prior
            total += z[c[k]] - np.log(np.exp(z).sum()) + np.log(smooth[b[k]] / smooth[vocab.cls == c[k]].sum())
        assert got[i]["n_tokens"] == len(b) and abs(got[i]["log_prob"] - total) < 1e-3 * abs(total)


def test_learning_lowers_the_loss(docs, corpus):
    o = lm_score.LmOptions(buckets=1 << 10, classes=64, own=48, batch=64)
    b = docs.select(F.col("text").cast("binary").alias("text"))
    vocab, net = lm_score.fit(b, o)
    texts = [t.encode() for _, t, *_ in corpus]
    n, total = lm_score.pseudo_log_likelihood(texts, vocab, net)
    _, before = lm_score.pseudo_log_likelihood(texts, vocab, lm_score.Network(o))
    assert total.sum() / n.sum() > before.sum() / n.sum() + 0.3


def test_texts_beat_their_shuffles(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    vocab, net = lm_score.fit(docs.select(F.col("text").cast("binary").alias("text")))
    rng = random.Random(3)
    texts = [r.text.split() for r in docs.select("text").collect() if len(r.text.split()) > 50]
    mixed = [rng.sample(w, len(w)) for w in texts]
    a, b = (lm_score.pseudo_log_likelihood([" ".join(w).encode() for w in x], vocab, net)[1] for x in (texts, mixed))
    assert len(texts) > 100 and (a > b).mean() > 0.95


def test_words_of_a_class_are_told_apart_by_their_surroundings(spark):
    pairs = [("red", "wine"), ("tin", "roof"), ("wet", "moss"), ("old", "king")]
    texts = [" ".join(f"{a} {b}" for a, b in random.Random(i).choices(pairs, k=60)) for i in range(400)]
    docs = spark.createDataFrame([(t,) for t in texts], "text string").select(F.col("text").cast("binary").alias("text")).coalesce(2)
    o = lm_score.LmOptions(buckets=1 << 10, classes=9, own=1, batch=64, slots=16)
    vocab, net = lm_score.fit(docs, o)
    assert np.allclose(np.bincount(vocab.cls, np.exp(vocab.share) * np.exp(np.where(vocab.cls < o.own, 0, vocab.odds[np.maximum(vocab.cls, 1) - 1, vocab.slot]))), 1, atol=1e-3)
    n, total = lm_score.pseudo_log_likelihood([t.encode() for t in texts], vocab, net)
    plain = lm_score.LmOptions(buckets=1 << 10, classes=9, own=1, batch=64)
    _, before = lm_score.pseudo_log_likelihood([t.encode() for t in texts], *lm_score.fit(docs, plain))
    assert total.sum() / n.sum() > before.sum() / n.sum() + 0.5


def some_positions(o, n, classes, seed=5):
    """A vocabulary, and *n* positions whose targets are all of *classes*."""
    rng = np.random.default_rng(seed)
    vocab = lm_score.vocabulary(np.arange(o.buckets), rng.integers(1, 50, o.buckets), o)
    code, cls = vocab.around(o), vocab.cls.astype(int)
    mine = rng.choice(np.flatnonzero(np.isin(cls, classes)), n)
    around = code[rng.integers(0, o.buckets, (n, 2 * o.reach))].astype(int)
    around[:3, 0] = o.classes
    return vocab, around, cls[mine], vocab.slot[mine]


@pytest.mark.parametrize("slots", [1, 4])
def test_a_learning_step_equals_plain_loops(slots):
    o = lm_score.LmOptions(buckets=1 << 8, classes=12, own=4, hidden=5, slots=slots)
    vocab, around, target, slot = some_positions(o, 60, [0, 2, 3, 5, 6, 9])
    net = lm_score.Network(o, odds=vocab.odds)
    net.values[net.inputs.size :] = np.random.default_rng(2).normal(0, 0.3, len(net.values) - net.inputs.size)
    old = [x.astype(float) for x in net._views(net.values.copy())]
    inputs, outputs, bias, prior, leaves, tilt = old
    grads, logs = [np.zeros_like(x) for x in old], []
    for x, c, s in zip(around, target, slot, strict=True):
        h = np.tanh(bias + sum(inputs[k, x[k]] for k in range(len(x))))
        p = np.exp(h @ outputs + prior)
        p /= p.sum()
        logs.append(np.log(p[c]))
        p[c] -= 1
        back = outputs @ p
        grads[1] += np.outer(h, p)
        grads[3] += p
        if slots > 1 and c >= o.own:
            q = np.exp(h @ leaves[c - o.own] + tilt[c - o.own] + vocab.odds[c - o.own].astype(float))
            q /= q.sum()
            logs[-1] += np.log(q[s])
            q[s] -= 1
            back = back + leaves[c - o.own] @ q
            grads[4][c - o.own] += np.outer(h, q)
            grads[5][c - o.own] += q
        back = back * (1 - h * h)
        grads[2] += back
        for k in range(len(x)):
            grads[0][k, x[k]] += back
    assert np.allclose(net.log_probability(around, target, slot), logs, atol=1e-4)
    net.learn(around, target, slot)
    for now, was, g in zip(net._views(net.values), old, grads, strict=True):
        g = g / len(target)
        assert np.allclose(now, was - o.rate * g / np.sqrt(1e-6 + g * g), atol=2e-4)


def test_a_step_makes_no_more_calls_for_more_classes():
    o = lm_score.LmOptions(buckets=1 << 10, classes=40, own=8, slots=16)

    def calls(classes, act):
        vocab, *positions = some_positions(o, 512, classes)
        net, seen = lm_score.Network(o, odds=vocab.odds), []
        sys.setprofile(lambda frame, event, arg: seen.append(event) if event.endswith("call") else None)
        try:
            getattr(net, act)(*positions)
        finally:
            sys.setprofile(None)
        return len(seen)

    for act in ("learn", "log_probability"):
        assert calls(np.arange(8, 40), act) <= calls([8], act) + 3


def test_every_position_is_learnt(spark):
    docs = spark.createDataFrame([("a b c",), ("d",), (None,), ("e f g h i",)], "text string").select(F.col("text").cast("binary").alias("text")).coalesce(1)
    o = lm_score.LmOptions(buckets=1 << 10, classes=16, own=8)
    vocab, _ = lm_score.fit(docs, o)
    shared = spark.sparkContext.broadcast(vocab)
    parted = docs.withColumn("part", F.lit(0).cast("long"))
    learnt = [parted.mapInPandas(lm_score._learn(o, shared, None, turn), lm_score._NETWORKS).first()["weight"] for turn in range(o.rounds)]
    assert sum(learnt) == 9


def test_networks_are_averaged_by_a_tree(spark, docs):
    from tablewarden.llm.common import Scratch

    rows = [(p, float(p + 1), [float(p + 1), 2.0 * (p + 1)]) for p in range(9)]
    df = spark.createDataFrame(rows, "part long, weight double, values array<double>")
    got = lm_score._average(df, 9, Scratch(spark), "t", lm_score.LmOptions(fan_in=2))
    assert np.allclose(got, [1.0, 2.0])


def test_lm_of_odd_rows(odd, none):
    o = lm_score.LmOptions(buckets=1 << 10, classes=16, own=8)
    rows = lm_score.op4(odd, o).collect()
    assert len(rows) == 10
    for r in rows:
        if r["doc_id"] in (None, 1, 2, 3):
            assert r["n_tokens"] == 0 and r["log_prob"] == 0 and r["mean_log_prob"] is None
        else:
            assert r["n_tokens"] > 0 and r["log_prob"] < 0 and r["perplexity"] > 1
    assert lm_score.op4(none, o).count() == 0
