"""Language, quality, toxicity: held-out accuracy, and awkward rows."""

import zlib

import numpy as np
import pytest

from pixelframe.llm import op03_language, op05_quality, op08_toxicity, queries
from pixelframe.llm.hashing import mix
from pixelframe.llm.sampling import labelled_texts

from .helpers import documents, empty, rows

SF = "/root/testdata/sf0.01"


def test_language_query_on_held_out_rows(spark):
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    out = queries.op3_language(spark, SF).collect()
    assert len(out) == len(lang)
    held = [r for r in out if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1 for r in out)
    assert np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in held]) > 0.97


def brute_distance(top, profile, size):
    place = {c: k for k, c in enumerate(profile.tolist())}
    return sum(abs(place[c] - k) if c in place else size for k, c in enumerate(top.tolist())) / (size * len(top))


def test_out_of_place_distance():
    texts = {"en": "the cat and the dog " * 5, "de": "der hund und die katze " * 5}
    own = {k: op03_language.ranked(*op03_language.grams(t), 50) for k, t in texts.items()}
    p = op03_language.Profiles(own, 50)
    for t in ("the hund and die dog", "x", "katze katze"):
        top = op03_language.ranked(*op03_language.grams(t), 50)
        assert np.allclose(p.distances(top), [brute_distance(top, own[k], 50) for k in p.languages])
    assert p.predict("the dog and the cat")[0] == "en" and p.predict("die katze")[0] == "de"
    assert p.predict(None) == p.predict("12 .") == ("und", 0.0)


def test_grams_mark_ends():
    codes, counts = op03_language.grams("Ab ab")
    e, a, b = 0x5F, ord("a"), ord("b")
    two = lambda x, y: x << 21 | y
    want = {a: 2, b: 2, two(e, a): 2, two(a, b): 2, two(b, e): 2, two(e, a) << 21 | b: 2, two(a, b) << 21 | e: 2, two(b, e) << 21 | a: 1}
    assert dict(zip(codes.tolist(), counts.tolist(), strict=True)) == want


def test_language_of_awkward_rows(spark):
    docs = documents(spark)
    p = op03_language.learn(docs)
    out = op03_language.identify(docs, p, keep=tuple(c for c in docs.columns if c != "doc_id"), pred_col="lang here", score_col="own")
    assert out.columns == [*docs.columns, "lang here", "own"]
    found = [{"lang_pred": r["lang here"], "score": r["own"], "text": r["text"]} for r in out.collect()]
    with pytest.raises(ValueError):
        op03_language.identify(docs, p, keep=("score",))
    assert len(found) == len(rows())
    assert all(r["lang_pred"] == "und" and r["score"] == 0 for r in found if not any(c.isalpha() for c in r["text"] or ""))
    none = op03_language.learn(empty(spark))
    assert none.languages == [] and op03_language.identify(empty(spark), p).count() == 0
    assert {r["lang_pred"] for r in op03_language.identify(docs, none).collect()} == {"und"}


def scores(spark, name, label):
    out = queries.queries()[name](spark, SF).collect()
    truth = {r["doc_id"]: r[label] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert len(out) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 for r in out)
    return [(r["score"], r["predicted"], truth[r["doc_id"]]) for r in out if r["held_out"] and truth.get(r["doc_id"]) is not None]


def test_quality_query_on_held_out_rows(spark):
    got = scores(spark, "op5_quality", "quality")
    assert all(p == int(s >= 0.3) for s, p, _ in got)
    assert np.mean([p == y for _, p, y in got]) > 0.93


def test_toxicity_query_on_held_out_rows(spark):
    got = scores(spark, "op8_toxicity", "toxic")
    assert all(p == int(s >= 0.5) for s, p, _ in got)
    assert np.mean([p == y for _, p, y in got]) > 0.93
    assert not any(p for _, p, y in got if y == 0)


def test_sample_is_bounded_and_keeps_the_fold_out(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    some = labelled_texts(docs, labels, "quality", 50, op05_quality.features)
    assert 20 < len(some) < 100
    held = {r["text"] for r in docs.join(labels, "doc_id").select("doc_id", "text").collect() if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0}
    learnt = {r["text"] for r in docs.join(labels, "doc_id").select("doc_id", "text").collect() if zlib.crc32(str(r["doc_id"]).encode()) % 5}
    assert {t for t, _ in some} <= learnt and held


def test_classifiers_without_labels(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for op, label in ((op05_quality, "quality"), (op08_toxicity, "toxic")):
        model = op.learn(documents(spark), labels, label)
        out = op05_quality.score_texts(documents(spark), model, keep=("text", "score"), score_col="own").collect()
        assert len(out) == len(rows()) and all(0 <= r["own"] <= 1 for r in out)
        assert op05_quality.score_texts(empty(spark), model).count() == 0
        with pytest.raises(ValueError):
            op05_quality.score_texts(documents(spark), model, keep=("score",))


def test_quality_learns_a_plain_difference():
    good = [("a calm and quiet text about gardens and birds number %d" % k, 1) for k in range(60)]
    bad = [("BUY!! NOW!! CHEAP!! %d!!" % k, 0) for k in range(60)]
    m = op05_quality.train(good + bad, epochs=6)
    assert m.score("a calm text about birds") > 0.5 > m.score("CHEAP!! BUY!!")
    assert 0 <= m.score("") <= 1 and m.score("") == m.score(None)


def softmax_by_hand(model, text):
    f = op05_quality.features(text, model.bits)
    z = sum(float(model.weight[k]) for k in f) / len(f) + model.bias
    return 1 / (1 + np.exp(-z))


def test_quality_score_is_the_mean_of_features():
    m = op05_quality.train([("one two three", 1), ("ONE!! TWO!!", 0)] * 5)
    for t in ("one", "one two two", "é è"):
        assert m.score(t) == pytest.approx(softmax_by_hand(m, t))


def test_non_negative_risk_finds_the_telling_words():
    rng = np.random.default_rng(5)
    plain = lambda: " ".join(f"w{k}" for k in rng.integers(0, 300, 30))
    toxic = [plain() + " nastiness" for _ in range(60)]
    unlabelled = [plain() for _ in range(540)] + [plain() + " nastiness" for _ in range(60)]
    m = op08_toxicity.train(toxic, unlabelled, 0.1)
    assert m.score("such nastiness here") > 0.5 > m.score("such w1 w2 w3 here")
    assert m.score(None) == m.score("") < 0.5
    assert op08_toxicity.train([], unlabelled, 0.1).score("nastiness") < 0.5


def test_copies_do_not_teach_their_words():
    sets = [np.unique(mix(np.arange(1, 101, dtype=np.uint64) + np.uint64(k * 1000))) for k in range(3)]
    near = sets[0].copy()
    near[::40] += np.uint64(1)
    assert op08_toxicity._unlike([sets[0], near, sets[1], sets[2], sets[0], np.zeros(0, np.uint64)]) == [0, 2, 3]


ALL = (1 << 64) - 1


def mixed(h):
    h = (h ^ h >> 32) * 0xD6E8FEB86659FD93 & ALL
    return h ^ h >> 29


def hashed(data, salt):
    return mixed((sum((b + 1) * pow(0x9E3779B97F4A7C15, k, 1 << 64) for k, b in enumerate(data)) + salt * 0xA0761D6478BD642F) & ALL)


def quality_features_by_hand(text, bits):
    data = (text or "").encode()
    found = data.split()
    whole = [hashed(w, 1) for w in found]
    out = whole + [1 if a == b else mixed((b * 3 + a) & ALL) for a, b in zip(whole, whole[1:])]
    kind = lambda b: sum(b >= edge for edge in (33, 48, 58, 65, 91, 97, 123, 128))
    out += [mixed(kind(w[0]) * 64 + kind(w[-1]) * 8 + min(len(w), 7) + (1 << 20)) for w in found]
    out += [hashed(data[k : k + n], n) for n in (3, 4, 5) for k in range(len(data) - n + 1)]
    return sorted(h >> (64 - bits) for h in out)


TEXTS = ["one two two", "", None, " a", "Größe, 3 x\n(y)  z", "ab", "w " * 300]


def test_quality_features_are_as_counted_by_hand():
    for text in TEXTS:
        for bits in (18, 6):
            assert sorted(op05_quality.features(text, bits).tolist()) == quality_features_by_hand(text, bits)


def test_quality_steps_are_as_by_hand():
    """Two epochs of gradient steps, written out over dicts and loops."""
    rows_, bits, dim, rate, seed = [("good plain words", 1), ("BAD!! 11", 0), ("", 1), ("good plain words", 1)], 8, 3, 0.5, 7
    m = op05_quality.train(rows_, bits, dim, 2, rate, seed)
    rng = np.random.default_rng(seed)
    vec = ((rng.random((1 << bits, dim)) - 0.5) / dim).tolist()
    layer, bias, step = [[0.0, 0.0] for _ in range(dim)], [0.0, 0.0], 0
    for _ in range(2):
        for k in rng.permutation(4):
            f, label = quality_features_by_hand(rows_[k][0], bits), rows_[k][1]
            share = {i: f.count(i) / len(f) for i in f}
            now = rate * (1 - step / 8)
            step += 1
            hidden = [sum(vec[i][d] * s for i, s in share.items()) for d in range(dim)]
            z = [sum(hidden[d] * layer[d][c] for d in range(dim)) + bias[c] for c in (0, 1)]
            p = [np.exp(z[c]) / (np.exp(z[0]) + np.exp(z[1])) - (c == label) for c in (0, 1)]
            back = [sum(layer[d][c] * p[c] for c in (0, 1)) for d in range(dim)]
            for d in range(dim):
                for c in (0, 1):
                    layer[d][c] -= now * hidden[d] * p[c]
            for c in (0, 1):
                bias[c] -= now * p[c] * 0.1
            for i, s in share.items():
                for d in range(dim):
                    vec[i][d] -= now * len(share) ** 0.5 * s * back[d]
    want = [sum(v[d] * (layer[d][1] - layer[d][0]) for d in range(dim)) for v in vec]
    assert np.allclose(m.weight, want, atol=1e-6) and m.bias == pytest.approx(bias[1] - bias[0])


def test_quality_query_is_as_its_model_on_every_text(spark):
    sf = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = op05_quality.learn(docs, labels)
    out = {r["doc_id"]: r["score"] for r in queries.op5_quality(spark, sf).collect()}
    for r in docs.limit(25).collect():
        f = quality_features_by_hand(r["text"], model.bits)
        z = model.bias + (sum(float(model.weight[k]) for k in f) / len(f) if f else 0.0)
        assert out[r["doc_id"]] == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-6)


def toxic_features_by_hand(text):
    out, word = [], bytearray()
    for b in (text or "").lower().encode() + b" ":
        if b >= 128 or b == 39 or chr(b).isalnum():
            word.append(b)
            continue
        if word:
            out += [hashed(word, 9), *(hashed(word[:n], n) for n in (4, 5, 6) if len(word) >= n)]
        word = bytearray()
    return sorted(out)


def test_toxicity_features_are_as_counted_by_hand():
    for text in [*TEXTS, "Don't shout, ANGRYWORD it's überlang"]:
        assert sorted(op08_toxicity.features(text).tolist()) == toxic_features_by_hand(text)


def plain_risk(w, prior, p_rows, u_rows):
    """The corrected risk's two parts by loops over rows."""
    z = lambda rows, k: w[-1] + sum(w[f] for r, f in zip(rows[0], rows[1], strict=True) if r == k)
    loss = lambda v: np.log(1 + np.exp(-v))
    p, u = ([z(rows, k) for k in range(rows[2])] for rows in (p_rows, u_rows))
    return prior * np.mean([loss(v) for v in p]), np.mean([loss(-v) for v in u]) - prior * np.mean([loss(-v) for v in p])


def test_risk_and_gradient_are_as_differences_tell():
    rng = np.random.default_rng(11)
    below = above = 0
    for trial in range(30):
        p_rows, u_rows = ((np.repeat(np.arange(n), 3), rng.integers(0, 5, 3 * n), n) for n in (6, 9))
        w, prior = rng.normal(size=6) * 2, 0.7 if trial % 2 else 0.2
        first, rest = plain_risk(w, prior, p_rows, u_rows)
        assert np.allclose(op08_toxicity.risk(op08_toxicity.logits(w, p_rows), op08_toxicity.logits(w, u_rows), prior), (first, rest))
        below, above = below + (rest < 0), above + (rest >= 0)
        follow = lambda v: sum(plain_risk(v, prior, p_rows, u_rows)) if rest >= 0 else -plain_risk(v, prior, p_rows, u_rows)[1]  # noqa: E731, B023
        want = [(follow(w + d) - follow(w - d)) / 2e-5 for d in np.eye(6) * 1e-5]
        assert np.allclose(op08_toxicity.gradient(w, p_rows, u_rows, prior), want, atol=1e-6)
    assert below and above


def test_toxicity_query_is_as_its_model_on_every_text(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = op08_toxicity.learn(docs, labels)
    weight = dict(zip(model.hashes.tolist(), model.weights.tolist(), strict=True))
    out = {r["doc_id"]: r["score"] for r in queries.op8_toxicity(spark, sf).collect()}
    assert weight
    for r in docs.limit(60).collect():
        z = model.bias + sum(weight.get(h, 0.0) for h in set(toxic_features_by_hand(r["text"])))
        assert out[r["doc_id"]] == pytest.approx(1 / (1 + np.exp(-z)))


def test_long_texts_teach_whole(spark, monkeypatch):
    """Long and repeated labelled texts: learning from features found apart is learning from the texts."""
    from pixelframe.llm import sampling

    texts = ["calm gardens and quiet birds " * 40 + "end", "BUY!! NOW!! " * 50, None, "", "short"]
    docs = spark.createDataFrame([(k, t, 1.0) for k, t in enumerate(texts * 3)] + [(1, texts[1], 2.0)], "doc_id long, text string, _label double")
    labels = spark.createDataFrame([(k, int(k % 5 != 1), int(k % 5 == 1)) for k in range(15)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    whole = op05_quality.learn(docs, labels), op08_toxicity.learn(docs, labels)
    monkeypatch.setattr(sampling, "LONG", 10)
    apart = op05_quality.learn(docs, labels), op08_toxicity.learn(docs, labels)
    assert np.array_equal(whole[0].weight, apart[0].weight) and whole[0].bias == apart[0].bias
    assert np.array_equal(whole[1].hashes, apart[1].hashes) and np.allclose(whole[1].weights, apart[1].weights)
