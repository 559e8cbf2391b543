import pytest

#: Names that operators use inside; as further columns of their input they must not disturb them.
CLASHING = ["value", "fingerprint", "text_sha256", "root", "n", "place", "block", "word", "copy", "bin", "cell", "rank",
            "arc", "score", "language", "keep_id", "size", "law", "shard", "slot", "position", "source", "lang_pred",
            "first", "best", "group_size", "kept", "learning", "start", "length", "toxic", "row", "key", "number"]

LONG = " ".join(f"word{i % 977}" for i in range(30_000))

TEXTS = [
    (1, "The cat sat on the mat, and the dog sat by the door."),
    (2, "The cat sat on the mat, and the dog sat by the door."),
    (3, None),
    (4, ""),
    (None, "x y"),
    (5, " \t\n "),
    (6, LONG),
    (6, LONG),
    (7, "The cat sat on the mat, and the dog sat by the door!"),
    (8, "12345 --- 678"),
    (9, "Äpfel, Öl und Übermut; été déjà vu"),
    (None, None),
]


@pytest.fixture
def odd_docs(spark):
    """Null ids and texts, blank and very long texts, copies, a repeated row, and clashing further columns."""
    rows = [(i, t, "en" if t else None, "s", *range(len(CLASHING) - 1)) for i, t in TEXTS]
    names = [c for c in CLASHING if c != "source"]
    schema = "doc_id long, text string, lang string, source string, " + ", ".join(f"`{c}` int" for c in names)
    return spark.createDataFrame([r[: 4 + len(names)] for r in rows], schema).repartition(3)


@pytest.fixture
def no_docs(odd_docs):
    return odd_docs.filter("1 = 0")


@pytest.fixture
def sample(spark):
    return lambda name: spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet")
