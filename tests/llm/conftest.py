import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, bucket string, score double, k string, place int"


def document(doc_id, text):
    return doc_id, text, "en", "s", None if text is None else len(text), 7, "b", 0.1, "k", 3


ODD = [
    document(1, "One plain text of some words. It has two sentences, and numbers 12 and 2024."),
    document(2, None),
    document(3, ""),
    document(None, "A text without an id, of the same words as others."),
    document(None, None),
    document(4, " \n\t  "),
    document(5, "same row twice, same row twice"),
    document(5, "same row twice, same row twice"),
    document(6, "wörter " * 9000 + "ende"),
    document(7, "x" * 20000),
    document(8, "<|endoftext|> inside <|startoftext|>and  two  spaces\r\n\x1c ÀÉ Σας \U0001f642"),
    document(9, 'token = "9b0b3c6a43eb78aa99cbd7049c572391524f37a8" mail a.b@c.example.org, 10.0.0.1 +1 (212) 555-0147'),
    document(10, "One plain text of some words. It has two sentences, and numbers 12 and 2025."),
]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
