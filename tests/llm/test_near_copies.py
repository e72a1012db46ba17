"""Groups of near copies against the exact similarity of every pair."""

import random

import numpy as np

import corpus_pipeline
from pixelframe.llm import near_copies

from .helpers import documents, empty, rows
from .test_duplicates import roots

SF = "/root/testdata/sf0.001"


def brute(texts):
    sets = {}
    for i, t in texts.items():
        w = (t or "").encode("utf-8", "surrogatepass").lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    links = [(a, b) for a in sets for b in sets if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    return roots(sets, links)


def copies():
    """Pairs just over and under 0.8, a chain, and a group of many near copies of one text."""
    rng = random.Random(5)
    fresh = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    texts = []
    for edits in (1, 2, 3, 4, 5):
        base = fresh(204)
        near = list(base)
        for k in range(edits):
            near[20 + 40 * k] = "changed"
        texts += [base, near]
    chain = fresh(200)
    for _ in range(5):
        texts.append(list(chain))
        for k in rng.sample(range(200), 3):
            chain[k] = "next"
    base = fresh(60)
    for _ in range(60):
        near = list(base)
        for k in rng.sample(range(60), rng.randint(1, 3)):
            near[k] = f"x{rng.randrange(10**6)}"
        texts.append(near)
    return {i: " ".join(t) for i, t in enumerate(texts)}


def grouped(spark, texts):
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    return {r["doc_id"]: r["component_id"] for r in near_copies.near_copies(df).collect()}


def test_groups_are_those_of_every_pair(spark, monkeypatch):
    texts = copies()
    want = brute(texts)
    assert [want[2 * k + 1] == 2 * k for k in range(5)] == [True, True, True, True, False]
    assert grouped(spark, texts) == want
    monkeypatch.setattr(near_copies, "BLOCK", 8)  # large groups in many tasks
    assert grouped(spark, texts) == want


def test_similar_counts_whole_sets():
    sets = [np.arange(a, a + 90, dtype=np.uint64) for a in (0, 10, 11, 500)] + [np.zeros(0, np.uint64)]
    assert list(zip(*(x.tolist() for x in near_copies.similar(sets)), strict=True)) == [(0, 1), (1, 2)]


def test_stage_removes_near_copies_of_four_fifths(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = brute({r["doc_id"]: r["text"] for r in docs.collect()})
    kept = {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, SF).select("doc_id").collect()}
    assert kept == {i for i, c in want.items() if i == c} and not kept & {145, 177}


def test_awkward_rows(spark):
    out = near_copies.near_copies(documents(spark)).collect()
    assert len(out) == len(rows())
    by = {r["doc_id"]: r["component_id"] for r in out}
    assert by[1] == 0 and by[3] == by[4] == by[5] == 3 and by[None] is None
    assert near_copies.first_of_each(empty(spark)).count() == 0


def test_fingerprints_propose_without_bands(spark):
    """Candidates are all pairs of classes with equal fingerprints or two differing bits, and of close ones that share a half but for one bit; no bands are needed, and empty sets are left out."""
    fps = {1: 0x0123456789ABCDEF, 2: 0x0123456789ABCDEF, 3: 0x0123456789ABCDEF ^ 1 << 3 ^ 1 << 40, 4: 0x0123456789ABCDEF ^ 0x7F, 5: 0x7EDCBA9876543210, 6: 0x0123456789ABCDEF ^ 0x3F00 ^ 0x3F << 32}
    classes = spark.createDataFrame([(c, f, [c]) for c, f in fps.items()] + [(7, fps[1], [])], "cls long, fp long, keys array<long>")
    found = roots([*fps, 7], [tuple(r) for r in near_copies.candidates(classes).collect()])
    assert found == {1: 1, 2: 1, 3: 1, 4: 1, 5: 5, 6: 6, 7: 7}


def test_fingerprint_counts_bits_of_whole_sets():
    for s in (near_copies.shingles(" ".join(f"w{k}" for k in range(n))) for n in (0, 3, 6, 7, 90)):
        want = sum(1 << b for b in range(64) if 2 * sum(int(h) >> b & 1 for h in s) > len(s))
        assert near_copies.fingerprint(s) & (1 << 64) - 1 == want
