import random

import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, n long, f long, size long, bucket long, token string, shard int, range int, kept string, rank long, length long, component_id long"


def prose(r, n):
    return " ".join("".join(r.choice("aeioulnrstdm") for _ in range(r.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="session")
def texts():
    """Texts with copies, near copies, shared passages, nulls, empty, short and long ones; ids with gaps and repeats."""
    r = random.Random(11)
    shared = prose(r, 70)
    out = []
    for i in range(60):
        words = prose(r, r.randint(1, 160)).split()
        if i % 5 == 0:
            words += shared.split()
        out.append((3 * i + 1, " ".join(words)))
    base = prose(r, 120)
    for i in range(25):  # near copies of one text
        words = base.split()
        for _ in range(i % 4):
            words[r.randrange(len(words))] = "edit"
        out.append((1000 + i, " ".join(words)))
    out += [(2000 + i, base) for i in range(12)]
    out += [(3000 + i, shared + " " + prose(r, 20)) for i in range(8)]
    out += [(4000, None), (4001, ""), (4002, " \n\t "), (4003, "uno"), (4004, "UNO"), (4005, "a b c d"), (4006, "a b c d e"), (4007, "😀 ñ 日本語 " * 30), (4008, prose(r, 6000)), (4009, "!!! 123"), (4010, base.upper())]
    out += [(4011, "repeat " + base), (4011, "repeat " + base), (None, "no id " + shared), (4012, "x" * 5000), (-5, "negative id " + prose(r, 40))]
    return out


@pytest.fixture(scope="session")
def docs(spark, texts):
    """The texts with the columns of documents and others whose names operators use within."""
    rows = [(i, t, ["en", "de", None][n % 3], f"s{n % 4}", len(t or ""), n, n, n, n, "t", n, n, "k", n, n, n) for n, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, COLUMNS).repartition(5).cache()


@pytest.fixture(scope="session")
def nothing(docs):
    return docs.limit(0)
