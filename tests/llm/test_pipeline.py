"""The pipeline's stages against brute force, and run() against its stages."""

import corpus_pipeline
import public_tokenizers as P
import tiktoken
from pyspark.sql import functions as F

from pixelframe.llm import op02_bpe, op03_language, op05_quality, op09_decontaminate
from pixelframe.llm.queries import QUALITY

from .helpers import documents, empty
from .test_near_copies import brute

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = [r["doc_id"] for r in docs.collect()]
    names = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        rows = docs.collect()
        out = stage(spark, docs, SF)
        assert sorted(out.columns) == sorted(docs.columns)
        kept = {r["doc_id"] for r in out.collect()}
        texts = {r["doc_id"]: r["text"] for r in rows}
        if name == "language":
            p = op03_language.learn(docs)
            want = {i for i, t in texts.items() if (v := p.predict(t))[0] != "und" and v[1] >= corpus_pipeline.LEAST_LANGUAGE_SCORE}
        elif name == "quality":
            m = op05_quality.learn(docs, spark.read.parquet(f"{SF}/labels.parquet"))
            want = {i for i, t in texts.items() if m.score(t) >= QUALITY}
        elif name == "near_duplicates":
            want = {i for i, c in brute(texts).items() if i == c}  # five-word shingles, 0.8 or more: what stages without a contract take
        else:
            ix = op09_decontaminate.Index([tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()])
            want = {i for i, t in texts.items() if not ix.find(t, op09_decontaminate.THRESHOLD, op09_decontaminate.OVERLAP)}
        assert kept == want and kept
        docs = docs.where(docs["doc_id"].isin(sorted(kept)))
        names.append(name)
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=op02_bpe.load_ranks(P.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    want = {r["doc_id"]: len(enc.encode_ordinary(r["text"] or "")) for r in docs.collect()}
    got = {r["doc_id"]: r["n_tokens"] for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == want and len(got) < len(seen)


def test_stages_on_awkward_rows(spark):
    more = {"lang_pred": "x", "score_": "y", "cls": "z", "keys": "k", "h": "h"}
    for docs in (documents(spark), empty(spark)):
        for name, value in more.items():
            docs = docs.withColumn(name, F.lit(value))
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF)
            assert out.count() <= docs.count() and (name == "encoding" or out.columns == docs.columns)
