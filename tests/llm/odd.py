"""Documents that operators must put up with."""

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars int, size int, body string, "
    "slot int, digest string, fp long, cell int, tile int, n long, word string, string long, "
    "row long, bucket int, length long, label int, share double, part int, score double"
)
CLASHING = (7, "b", 1, "d", 5, 6, 7, 8, "w", 9, 10, 11, 12, 1, 0.5, 3, 0.1)
LONG = "word and more words " * 20_000


def rows():
    texts = [
        (1, "The same text, twice."),
        (2, "The  same\ttext,\ntwice. "),
        (3, "Thesametext,twice."),
        (4, None),
        (5, ""),
        (6, " \n\t"),
        (7, LONG),
        (8, LONG.upper()),
        (None, "A text without an id."),
        (None, "The same text, twice."),
        (10, "repeated row"),
        (10, "repeated row"),
        (11, "Ünïcödé — 漢字 \U0001f600 text\x00with a zero"),
        (12, "one"),
        (13, "<|endoftext|> spelled out"),
    ]
    out = []
    for k, (doc_id, text) in enumerate(texts):
        lang = None if k % 3 == 0 else "en"
        source = None if k % 4 == 0 else f"s{k % 2}"
        n_chars = None if text is None else len(text)
        out.append((doc_id, text, lang, source, n_chars, *CLASHING))
    return out


def documents(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
