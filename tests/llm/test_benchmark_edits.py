"""Benchmark items with a changed word, and clean texts."""

import random

from pixelframe.llm import op09_decontaminate as op9

ITEMS = [
    "What is the capital city of the small island state in the northern sea? It is the old harbour town of Vellmark.",
    "Name the metal that melts in a warm hand and was found by a French chemist. The answer is gallium.",
    " ".join(f"long{k}" for k in range(70)) + ". " + " ".join(f"reply{k}" for k in range(45)) + ".",
]
TAIL = "and then some other words follow that no test has ever held in any of its many questions or answers at all " * 4


def found(ix, text):
    return set(ix.find(text, op9.THRESHOLD, op9.OVERLAP))


def test_every_item_with_one_changed_word_is_found(spark, sf_dir):
    items = [*enumerate(ITEMS, 10**6), *map(tuple, spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect())]
    ix = op9.Index(items)
    for k, (_, text) in enumerate(items):
        words = op9.tokens(text)
        for at in range(len(words)):
            assert k in found(ix, TAIL + " ".join([*words[:at], "zzchanged", *words[at + 1 :]]) + " " + TAIL)
        for at in (1, len(words) - 2):  # a word more, a word less
            assert k in found(ix, " ".join([*words[:at], "zzmore", *words[at:]])) and k in found(ix, " ".join(words[:at] + words[at + 1 :]))


def test_clean_texts_are_not_found():
    ix = op9.Index(list(enumerate(ITEMS)))
    rng = random.Random(3)
    question, answer = ITEMS[0].split("? ")
    mixed = op9.tokens(ITEMS[0])
    rng.shuffle(mixed)
    for text in (TAIL, question + " " + TAIL, answer + " " + TAIL, " ".join(mixed), question + "? It is the new mountain village of Ostheim."):
        assert not found(ix, text)


def test_edits_are_as_counted_cell_by_cell():
    rng = random.Random(4)
    for _ in range(400):
        side, words = ([rng.choice("abcd") for _ in range(rng.randint(1, 12))] for _ in range(2))
        words *= rng.randint(0, 2)
        row = list(range(len(side) + 1))
        least = row[-1]
        for w in words:
            new = [0]
            for k, s in enumerate(side):
                new.append(min(row[k] + (s != w), row[k + 1] + 1, new[-1] + 1))
            row = new
            least = min(least, row[-1])
        assert op9.edits(side, words) == least
