import random

import pytest
from public_tokenizers import path

from tallymark.llm.common import saved

SCHEMA = "doc_id long, text string, n long, id long, key string, score double, doc string, part int, n_words int, `a b` int"


@pytest.fixture(scope="session")
def tokenizer():
    return path("byte_bpe_50k.json")


def near(text, rnd, edits):
    ws = text.split(" ")
    for _ in range(edits):
        ws[rnd.randrange(len(ws))] = "edit" + str(rnd.randrange(10 ** 6))
    return " ".join(ws)


def texts():
    """(doc_id, text): plain prose, copies, near copies, junk, nulls, blanks, a very long text, ties and repeated rows."""
    rnd = random.Random(5)
    vocab = ["".join(rnd.choice("aeioulnrst") for _ in range(rnd.randint(2, 7))) for _ in range(400)]

    def prose(n):
        return " ".join(rnd.choice(vocab) + (".\n" if rnd.random() < 0.07 else "") for _ in range(n)).replace("\n ", "\n")

    out = [prose(rnd.randint(12, 160)) for _ in range(60)]
    out += [out[0]] * 6 + [out[1], out[1].upper()]
    out += [near(out[2], rnd, 1) for _ in range(8)] + [near(out[3], rnd, 4) for _ in range(4)]
    out += [prose(6), "one two", "one two", "Solo", "", " \t\n\r\x0b\x0c ", None, None, "é 漢 x y <|endoftext|> <|im_end|>z"]
    out += [" ".join(w + "%%%" for w in prose(40).split()) for _ in range(6)]
    out += ["\n".join(["the same line again here"] * 12), prose(20000), prose(30) + " " + "w" * 4000]
    rows = list(enumerate(out))
    return rows + [rows[5], rows[5], (7, out[7]), (None, out[8]), (None, None)]


@pytest.fixture(scope="session")
def rows():
    return texts()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return saved(spark.createDataFrame([(k, t, 1, 2, "k", 0.5, "d", 3, 4, 5) for k, t in rows], SCHEMA).repartition(3))


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark, rows):
    """Junk is bad; every fourth text counts as toxic. One label is null, one id has two rows, one id is unknown."""
    known = [(k, 0 if t and "%%%" in t else 1, int(k % 4 == 0)) for k, t in rows if k is not None]
    return spark.createDataFrame([*known, (1, None, None), (99999, 1, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
