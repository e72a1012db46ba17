"""Language ID by rank-order profiles.

A profile is a language's most frequent letter n-grams (one to three letters, word ends marked) in order of frequency.
A document's own most frequent n-grams are compared with each profile by out-of-place distance: the sum over them of
how far their ranks lie apart, or the profile's size for one that the profile lacks."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_scratch, fold, materialize, rows_of, ship_code
from .sampling import taken

#: n-grams of a profile and of a document that are ranked.
SIZE = 400
#: Documents of one language that its profile is learned from, about; the sample is by a hash of doc_id.
MOST_DOCS = 1500
_END = 0x5F


@lru_cache(1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def grams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of a whole text as integers (21 bits a character, so that no two coincide) and how often each occurs."""
    chars = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), "<u4")
    letter = _letters()[chars]
    if not letter.any():
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    c = np.where(letter, chars, _END)[letter | np.concatenate(([False], letter[:-1]))].astype(np.uint64)
    c = np.concatenate(([_END], c, [_END] if c[-1] != _END else [])).astype(np.uint64)
    two = c[:-1] << np.uint64(21) | c[1:]
    three = two[:-1] << np.uint64(21) | c[2:]
    return np.unique(np.concatenate((c[c != _END], two, three)), return_counts=True)


def ranked(codes: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The size most frequent codes, most frequent first, ties by code."""
    if len(codes) > size:
        least = np.partition(counts, len(counts) - size)[len(counts) - size]
        keep = counts >= least
        codes, counts = codes[keep], counts[keep]
    return codes[np.lexsort((codes, -counts))][:size]


class Profiles:
    """Ranked n-grams by language."""

    def __init__(self, by_language: dict[str, np.ndarray], size: int = SIZE):
        self.size = size
        self.languages = sorted(by_language)
        self.tables = []
        for lang in self.languages:
            order = np.argsort(by_language[lang])
            self.tables.append((by_language[lang][order], order))

    def distances(self, top: np.ndarray) -> np.ndarray:
        """Out-of-place distance to each language, as a share of the largest possible."""
        out = np.ones(len(self.tables))
        at = np.arange(len(top))
        for k, (codes, rank) in enumerate(self.tables):
            if len(codes):
                i = np.minimum(np.searchsorted(codes, top), len(codes) - 1)
                out[k] = np.where(codes[i] == top, np.minimum(np.abs(rank[i] - at), self.size), self.size).sum() / (self.size * len(top))
        return out

    def predict(self, text: str | None) -> tuple[str, float]:
        """Language and score. The score is the second-best language's share of the two smallest distances, 0.5 to 1; with one language, 1 less the distance; 0 for `und`."""
        codes, counts = grams(text)
        if not len(codes) or not self.languages:
            return "und", 0.0
        d = self.distances(ranked(codes, counts, self.size))
        best = int(np.argmin(d))
        if len(d) == 1:
            return self.languages[0], float(1 - d[0])
        second = float(np.partition(d, 1)[1])
        return self.languages[best], second / (second + float(d[best])) if second > 0 else 0.5


def learn(docs: DataFrame, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text", folds: int = 3, held_out: int = 1, size: int = SIZE, most_docs: int = MOST_DOCS) -> Profiles:
    """Profiles of every language that rows outside the held-out fold are labelled with.

    The n-grams of a hash sample of about most_docs documents a language are counted on the executors; size n-grams a
    language reach the driver. Rows with a null id, text or language teach nothing; repeated rows count each; other
    columns are not read; an empty table gives no language."""
    ship_code(docs.sparkSession)
    rows = docs.where((fold(id_col, folds) != held_out) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    number = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not number:
        return Profiles({}, size)
    rate = F.element_at(F.create_map(*[F.lit(x) for lang, n in number.items() for x in (lang, min(1.0, most_docs / n))]), F.col("lang"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for langs, texts in rows_of(batch, most_bytes=1 << 20):
                for lang in sorted(set(langs)):
                    found = [grams(t) for x, t in zip(langs, texts, strict=True) if x == lang]
                    codes, where = np.unique(np.concatenate([c for c, _ in found]), return_inverse=True)
                    counts = np.bincount(where, np.concatenate([n for _, n in found]), len(codes)).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes.astype(np.int64)), pa.array(counts)], ["lang", "code", "n"])

    counted = rows.where(taken("id", rate)).select("lang", "text").mapInArrow(run, "lang string, code long, n long")
    counted = materialize(counted.groupBy("lang", "code").agg(F.sum("n").alias("n")), "grams")
    # The n-th largest count of each language is found by counts of counts, so that ranking needs no task with all n-grams of a language.
    at_least = counted.groupBy("lang", "n").agg(F.count("*").alias("codes"))
    more = F.sum("codes").over(Window.partitionBy("lang").orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, -1))
    cut = at_least.withColumn("more", F.coalesce(more, F.lit(0))).where(F.col("more") < size).groupBy("lang").agg(F.min("n").alias("least"))
    kept = counted.join(F.broadcast(cut), "lang").where("n >= least")  # a row a language
    first = kept.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "code"))).where(F.col("place") <= size)
    top: dict[str, list[int]] = {}
    for r in first.select("lang", "code").orderBy("lang", "place").collect():  # size rows a language
        top.setdefault(r["lang"], []).append(r["code"])
    drop_scratch(counted)
    return Profiles({lang: np.array(codes, np.uint64) for lang, codes in top.items()}, size)


def identify(docs: DataFrame, profiles: Profiles, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), pred_col: str = "lang_pred", score_col: str = "score") -> DataFrame:
    """(id, lang_pred, score), and the columns named in keep, of every row.

    Whole texts are read. A column named in keep may not have the name of pred_col or score_col, which can be chosen;
    others are not read. Null texts and texts without a letter are `und` with score 0; ties go to the first language
    by name; a null id stays null; repeated rows stay; no rows give no rows. A map over rows, without a shuffle."""
    ship_code(docs.sparkSession)
    names = [id_col, *keep]
    if {pred_col, score_col} & set(names):
        raise ValueError(f"{pred_col} or {score_col} is a column of the documents: choose other names")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [profiles.predict(t) for part in rows_of(batch.select([0])) for t in part[0]]
            cols = [batch.column(i + 1) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([*cols, pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], [*names, pred_col, score_col])

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names)
    return docs.select(F.col(text_col).alias(f"_text {score_col}"), *names).mapInArrow(run, f"{schema}, `{pred_col}` string, `{score_col}` double")
