"""Embedding links, SimHash groups, components, benchmark passages, against brute force."""

import random

import numpy as np
import xxhash

from pixelframe.llm import op06_embedding, op09_decontaminate, op10_simhash, queries
from pixelframe.llm.components import connected_components
from pyspark.sql import functions as F

from .helpers import documents, empty, rows


def roots(nodes, links):
    up = {n: n for n in nodes}

    def top(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in links:
        a, b = sorted((top(a), top(b)))
        up[b] = a
    return {n: top(n) for n in nodes}


def test_components(spark):
    rng = random.Random(2)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(400, 460)] + [(500, 500), (400, None)]
    found = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()}
    real = [(a, b) for a, b in links if b is not None and a != b]
    assert found == roots({n for p in real for n in p}, real)
    assert connected_components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def brute_fingerprint(text, words):
    w = [x for x in (text or "").encode().lower().replace(b"\x0b", b" ").split() if x]
    if not w:
        return 0
    shingles = [b" ".join(w[k : k + words]) for k in range(max(1, len(w) - words + 1))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def test_fingerprints():
    for text in ("", None, "one", "One two", "a b c", "a b c d  e\tf", "é É x y z z z z", "w " * 500, "the cat sat on the mat " * 30):
        for n in (3, 5):
            assert op10_simhash.fingerprint(text, n) == brute_fingerprint(text, n)


def _near(rng, fp, n):
    for b in rng.sample(range(64), n):
        fp ^= 1 << b
    return fp


def test_links_of_fingerprints(spark, monkeypatch):
    rng = random.Random(9)
    fps = {rng.getrandbits(64) for _ in range(40)}
    for fp in list(fps)[:25]:
        fps |= {_near(rng, fp, rng.randint(1, 4)) for _ in range(4)}
    centre = rng.getrandbits(64)
    fps |= {_near(rng, centre, rng.randint(0, 5)) for _ in range(250)}  # keys with many members
    fps |= {centre ^ (1 << b) for b in range(64)} | {0, 1, (1 << 64) - 1}
    fps = sorted(fps)
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    df = spark.createDataFrame([(k, signed(f)) for k, f in enumerate(fps)] + [(1000, signed(fps[5])), (None, signed(fps[0])), (None, 77)], "doc_id long, fp long")
    found = {r["doc_id"]: r["component_id"] for r in op10_simhash.group(df).collect() if r["doc_id"] is not None}
    monkeypatch.setattr(op10_simhash, "HOT", 5)
    assert op10_simhash.hot_keys(df.select("fp").distinct()).count() > 33
    assert found == {r["doc_id"]: r["component_id"] for r in op10_simhash.group(df).collect() if r["doc_id"] is not None}
    monkeypatch.setattr(op10_simhash, "HOT", 0)  # every key is spread
    assert found == {r["doc_id"]: r["component_id"] for r in op10_simhash.group(df).collect() if r["doc_id"] is not None}
    links = [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 2] + [(1000, 5)]
    assert found == roots([*range(len(fps)), 1000], links)


def test_large_keys_in_one_pass_and_in_many(monkeypatch):
    rng = np.random.default_rng(3)
    for place in (32, 5):
        other = np.zeros(500, np.uint64) + np.uint64(999)
        for k in range(500):
            for b in rng.integers(0, 32, rng.integers(0, 6)):
                other[k] ^= np.uint64(1) << np.uint64(b)
        own = np.uint64(0x1234) & ~np.uint64(32) | (rng.integers(0, 2, 500).astype(np.uint64) << np.uint64(5) if place == 5 else np.uint64(0))
        fps, key = np.unique(own | other << np.uint64(32)), place << 32
        i, j = np.triu_indices(len(fps), 1)
        ok = op10_simhash._linked(np.full(len(i), key), fps[i], fps[j])
        want = op10_simhash.forest(len(fps), i[ok], j[ok])
        for held in (1 << 17, 16):
            monkeypatch.setattr(op10_simhash, "HELD", held)
            a, b = op10_simhash.large_key(key, fps)
            assert (op10_simhash.forest(len(fps), np.searchsorted(fps, a), np.searchsorted(fps, b)) == want).all()


def test_simhash_documents(spark):
    out = op10_simhash.near_duplicates(documents(spark)).collect()
    assert len(out) == len(rows())
    by = {r["doc_id"]: r for r in out}
    assert all(r["fingerprint"] == f"{brute_fingerprint(t, 3):016x}" for i, t, *_ in rows() if i is not None for r in [by[i]])
    assert by[1]["component_id"] == 0 and by[4]["component_id"] == by[5]["component_id"] == 3
    assert op10_simhash.near_duplicates(empty(spark)).count() == 0
    kept = op10_simhash.first_of_each(documents(spark))
    assert kept.columns == documents(spark).columns
    assert sorted(r["doc_id"] for r in kept.where("doc_id is not null").collect()) == [0, 0, 2, 3, 6, 7, 8, 9, 10]


def test_simhash_query(spark, sf_dir):
    out = queries.op10_simhash(spark, sf_dir).collect()
    fps = {r["doc_id"]: int(r["fingerprint"], 16) for r in out}
    links = [(a, b) for a in fps for b in fps if a < b and (fps[a] ^ fps[b]).bit_count() <= 2]
    assert {r["doc_id"]: r["component_id"] for r in out} == roots(fps, links)


def brute_embedding(rows_, threshold):
    ok = {i: np.array(v, np.float64) for i, v in rows_ if v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    links = [(a, b) for a in ok for b in ok if a < b and len(ok[a]) == len(ok[b]) and ok[a] @ ok[b] / (np.sqrt(ok[a] @ ok[a]) * np.sqrt(ok[b] @ ok[b])) >= threshold]
    n = {i: 0 for i, _ in rows_}
    for a, b in links:
        n[a] += 1
        n[b] += 1
    r = roots([i for i, _ in rows_], links)
    return {i: (n[i], r[i], r[i] == i) for i, _ in rows_}


def test_embedding_links(spark):
    rng = np.random.default_rng(8)
    base = rng.normal(size=(60, 16))
    data = [v.tolist() for v in base] + [(base[k % 20] + rng.normal(size=16) * s).tolist() for k, s in enumerate(rng.choice([0.02, 0.2, 0.4, 0.6], 120))]
    data += [(base[3] + rng.normal(size=16) * 0.05).tolist() for _ in range(80)]
    data += [data[0], data[0], (np.array(data[1]) * 3).tolist(), None, [], [0.0] * 16, [float("nan")] + [1.0] * 15, [float("inf")] * 16, [None] + [1.0] * 15, [1.0, 2.0], [2.0, 4.0], [1.0] * 15]
    table = [(i, [None if x is None else float(np.float32(x)) for x in v] if v is not None else None) for i, v in enumerate(data)]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in table], "vec_id long, embedding array<float>, label int, id string")
    want = brute_embedding(table, 0.9)
    for block, pivots in ((4096, 256), (40, 8)):
        out = op06_embedding.near_duplicates(df, block=block, pivots=pivots).collect()
        assert {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in out} == want
    assert op06_embedding.near_duplicates(df.where("1 = 0")).count() == 0


def test_embedding_links_of_extreme_vectors_and_text_ids(spark):
    data = [[1e200, 2e200], [1.0, 2.1], [1e-200, 2e-200], [2e-310, 4.2e-310], [1e-200, -1e-200], [-1e308, 1e308], [3.0, 4.0, 0.0], [5e-324, 0.0], [1.0, 1e-9]]
    df = spark.createDataFrame([(f"v{k}", v) for k, v in enumerate(data)], "key string, body array<double>")
    found = {r["key"]: tuple(r)[1:] for r in op06_embedding.near_duplicates(df, id_col="key", vector_col="body", block=4, pivots=3).collect()}
    groups = [{0, 1, 2, 3}, {4}, {5}, {6}, {7, 8}]
    assert found == {f"v{k}": (len(g) - 1, f"v{min(g)}", k == min(g)) for g in groups for k in g}


def test_cells_apart_never_meet(spark):
    """Vectors in well separated bundles of two lengths: most pairs of cells and blocks are left out, and no link is lost."""
    rng = np.random.default_rng(21)
    data = []
    for d, bundles in ((24, 12), (6, 3)):
        middle = rng.normal(size=(bundles, d))
        data += [(m / np.sqrt(m @ m) + rng.normal(size=d) * 0.02).tolist() for m in middle for _ in range(40)]
    data.append(rng.normal(size=200).tolist())  # one vector far longer than all others changes nothing for them
    table = [(i, v) for i, v in enumerate(data)]
    seen, may_meet = [], op06_embedding.may_meet
    op06_embedding.may_meet = lambda cells, centre, threshold: seen.append((len(cells), out := may_meet(cells, centre, threshold))) or out
    try:
        got = op06_embedding.near_duplicates(spark.createDataFrame(table, "vec_id long, embedding array<double>"), block=16, pivots=60).collect()
    finally:
        op06_embedding.may_meet = may_meet
    assert {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in got} == brute_embedding(table, 0.9)
    cells, pairs = seen[0]
    assert cells > 20 and len(pairs) < cells * (cells + 1) // 2 * 0.35


def test_trees_prune_pairs_of_nodes():
    """A traversal of separated bundles computes few of all distances."""
    rng = np.random.default_rng(22)
    middle = rng.normal(size=(20, 32))
    x = op06_embedding.unit(np.repeat(middle, 50, axis=0) + rng.normal(size=(1000, 32)) * 0.05).astype(np.float32)
    x = x[rng.permutation(1000)]
    tree = op06_embedding.CoverTree(x)
    pairs = [p for a, b in op06_embedding.close_pairs(tree, x, tree, x, 0.4) for p in zip(a.tolist(), b.tolist(), strict=True)]
    i, j = np.nonzero(np.triu(x @ x.T >= 1 - 0.4**2 / 2, 1))
    want = set(zip(i.tolist(), j.tolist(), strict=True))
    assert want <= {tuple(sorted(p)) for p in pairs} and len(pairs) == len(set(pairs)) < 1.2 * len(want) < 0.1 * 1000 * 999 / 2


def test_traversal_of_noise_gathers_few_pairs(monkeypatch):
    """Directionless noise with some near copies, also with components that tell nothing first: pairs come from matrix products, and hardly more of them than links are looked at one by one."""
    rng = np.random.default_rng(23)
    x = rng.normal(size=(3000, 64))
    x[2800:] = x[:200] + rng.normal(size=(200, 64)) * 0.2
    gathered, einsum = [], np.einsum
    monkeypatch.setattr(np, "einsum", lambda spec, u, v: gathered.append(len(u)) or einsum(spec, u, v))
    for blank in (0, 40):
        y = x.copy()
        y[:, :blank] = 0
        y = op06_embedding.unit(y).astype(np.float32)
        tree = op06_embedding.CoverTree(y)
        gathered.clear()
        pairs = {tuple(sorted(p)) for a, b in op06_embedding.close_pairs(tree, y, tree, y, 0.4) for p in zip(a.tolist(), b.tolist(), strict=True)}
        i, j = np.nonzero(np.triu(y @ y.T >= 1 - 0.4**2 / 2, 1))
        assert set(zip(i.tolist(), j.tolist(), strict=True)) <= pairs and len(pairs) < 1.2 * len(i)
        assert blank or sum(gathered) < 8 * len(y)


def test_cover_tree_keeps_its_bounds():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 8))
    x[50:] = x[rng.integers(0, 50, 150)] + rng.normal(size=(150, 8)) * 0.05
    x = (x / np.sqrt((x * x).sum(1))[:, None]).astype(np.float32)
    t = op06_embedding.CoverTree(x)

    def below(k):
        kids = t.children[k]
        return [t.centre[k]] if not len(kids) else [p for c in kids for p in below(c)]

    for k in range(len(t.centre)):
        inside = below(k)
        assert t.centre[k] in inside
        assert np.sqrt(((x[inside] - x[t.centre[k]]) ** 2).sum(1)).max() <= t.radius[k] + 1e-3
    assert sorted(below(0)) == list(range(200))


ITEMS = ["What is the capital city of the small island state in the northern sea? It is the old harbour town of Vellmark on the east coast.", "Name the metal that melts in a warm hand and was found in eighteen seventy five by a French chemist. The answer is gallium, of course, as told.", None, "", "short item"]
TAIL = "and then some other words follow that no test has ever held in any of its many questions or answers at all " * 5


def test_contaminated(spark):
    half = ITEMS[0].split("? ")[0]
    texts = [TAIL, TAIL + ITEMS[0] + " " + TAIL, ITEMS[1].upper().replace(".", " !"), half + " " + TAIL, None, "", TAIL * 30 + ITEMS[1], "so this short item here", ITEMS[0] + " " + ITEMS[1]]
    docs = documents(spark, texts)
    bench = spark.createDataFrame([(k, t, 0.5) for k, t in enumerate(ITEMS)], "item_id long, text string, score double")
    out = op09_decontaminate.contaminated(docs, bench)
    assert sorted((r["doc_id"], r["item_id"]) for r in out.collect()) == [(1, 0), (2, 1), (6, 1), (7, 4), (8, 0), (8, 1)]
    kept = op09_decontaminate.clean(docs, bench)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0) for r in kept.select("doc_id").collect()) == [(False, 0), (True, 0), (True, 0), (True, 3), (True, 4), (True, 5)]
    assert op09_decontaminate.contaminated(empty(spark), bench).count() == 0
    assert op09_decontaminate.contaminated(docs, bench.where("1 = 0")).count() == 0
    assert op09_decontaminate.clean(docs, bench.where("1 = 0")).count() == docs.count()


def test_search_is_as_scoring_every_item():
    rng = random.Random(6)
    words = [f"w{k}" for k in range(60)]
    items = [(k, " ".join(rng.choices(words, k=rng.randint(5, 30)))) for k in range(80)]
    for blocks in (80, 64, 7, 1):
        ix = op09_decontaminate.Index(items, blocks)
        every = list(range(ix.block_max.shape[1]))
        for _ in range(60):
            terms = rng.sample(range(len(ix.term)), rng.randint(1, 30))
            threshold = rng.choice([0.1, 0.3, 0.6])
            score = {}
            for t in terms:
                for i, g in zip(ix.items[t], ix.impacts[t], strict=True):
                    score[i] = score.get(i, 0) + g
            assert sorted(i for i, _ in ix.search(terms, threshold, every)) == sorted(i for i, s in score.items() if s >= threshold)


def test_bounds_pass_every_passage_over_the_threshold():
    rng = random.Random(7)
    words = [f"w{k}" for k in range(400)]
    items = [(k, " ".join(rng.choices(words, k=20))) for k in range(30)]
    ix = op09_decontaminate.Index(items, 8)
    for _ in range(40):
        text = rng.choices(words, k=rng.randint(0, 300))
        if rng.random() < 0.7:
            text[50:50] = items[rng.randrange(30)][1].split()
        passed = {(a, i) for a, _, terms, blocks in ix.passages(text, 0.6) for i, _ in ix.search(terms, 0.6, blocks)}
        for a in range(0, max(1, len(text) - ix.longest), ix.longest):
            terms = {ix.term[w] for w in text[a : a + 2 * ix.longest] if w in ix.term}
            for i in range(30):
                s = sum(g for t in terms for k, g in zip(ix.items[t], ix.impacts[t], strict=True) if k == i)
                assert (s >= 0.6) == ((a, i) in passed) or abs(s - 0.6) < 1e-9


def test_a_benchmark_in_several_indexes(spark, sf_dir, monkeypatch):
    whole = sorted((r["doc_id"], r["item_id"]) for r in queries.op9_decontamination(spark, sf_dir).collect())
    docs, bench = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    held = {(d["doc_id"], b["item_id"]) for d in docs.collect() for b in bench.collect() if b["text"] in d["text"]}
    assert held and held <= set(whole)
    one = sorted(map(tuple, queries.op9_decontamination(spark, sf_dir).collect()))
    monkeypatch.setattr(op09_decontaminate, "SHARD", 7)
    several = sorted(map(tuple, queries.op9_decontamination(spark, sf_dir).collect()))
    assert [r[:2] for r in several] == [r[:2] for r in one] == whole and np.allclose([r[2:] for r in several], [r[2:] for r in one], rtol=0, atol=1e-12)
    assert op09_decontaminate.clean(docs, bench).count() == docs.count() - len({d for d, _ in whole})
    assert docs.select(F.count("*")).first()[0] > len(whole)


def test_scores_do_not_depend_on_the_number_of_indexes(spark, monkeypatch):
    """Items of one vocabulary, texts near the threshold: scores of many indexes are those of one, whatever the shard."""
    rng = random.Random(12)
    words = [f"w{k}" for k in range(300)]
    items = [(k, " ".join(rng.choices(words, k=rng.randint(8, 30)))) for k in range(90)] + [(90, None), (91, " .")]
    texts = []
    for k in range(40):
        t = items[k][1].split()
        for at in rng.sample(range(len(t)), len(t) * rng.randint(0, 4) // 10):
            t[at] = "changed"
        texts.append(" ".join(rng.choices(words, k=40) + t + rng.choices(words, k=40)))
    bench = spark.createDataFrame(items, "item_id int, text string")
    one = op09_decontaminate.Index(items)
    for limit, value in (("SHARD", 13), ("SHARD_WORDS", 200)):
        monkeypatch.setattr(op09_decontaminate, limit, value)
        many = list(op09_decontaminate.indexes(bench))
        assert len(many) > 5 and sum(len(ix.ids) for ix in many) == len(one.ids)
        for t in texts:
            got = {ix.ids[k]: v for ix in many for k, v in ix.find(t, 0.4, 0.0).items()}
            want = {one.ids[k]: v for k, v in one.find(t, 0.4, 0.0).items()}
            assert got.keys() == want.keys() and all(np.allclose(got[i], want[i], rtol=0, atol=1e-12) for i in want)
        monkeypatch.undo()
    out = op09_decontaminate.contaminated(spark.createDataFrame([("a", texts[0] + " " + items[3][1])], "key string, body string"), bench, id_col="key", text_col="body")
    assert out.schema["item_id"].dataType.simpleString() == "int" and ("a", 3) in {tuple(r)[:2] for r in out.collect()}
