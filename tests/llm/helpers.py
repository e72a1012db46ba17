"""Small tables with all the awkward rows."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, n_tokens int, fp long, id long, component string"
TEXTS = [
    "The cat sat on the mat, and the dog ran after the ball in the garden.",
    "The cat sat on the mat, and the dog ran after the ball in the garden.",
    "Der Hund und die Katze sind im Garten, aber das Haus ist leer und still.",
    None,
    "",
    "   \n\t ",
    "12345 67890",
    "word " * 4000,
    "  two  spaces\n\nand lines   and more wide ",
    "日本語のテキスト and 🙂 signs, naïve café ½²³ <|endoftext|>",
    "x" * 30000,
]


def rows(texts=None):
    out = [(k, t, "de" if t and t.startswith("Der") else "en" if t else None, "s", None, 0.5, 7, 3, 4, "c") for k, t in enumerate(TEXTS if texts is None else texts)]
    return [*out, (None, "a row without an id", None, None, None, None, None, None, None, None)] + out[:1]


def documents(spark, texts=None):
    return spark.createDataFrame(rows(texts), DOCS)


def empty(spark):
    return spark.createDataFrame([], DOCS)
