import random

import pytest

WORDS = "the of and alpha beta gamma delta omega river stone cloud light paper green quiet north".split()
DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + r.choice(["", "s", "ing", "ed"]) for _ in range(n))


@pytest.fixture(scope="session")
def texts():
    """Null, empty, blank, very short, long, copied, nearly copied and odd texts by id."""
    base = prose(1, 120)
    words = base.split()
    near = " ".join([*words[:60], "changed", *words[61:]])
    out = {1: None, 2: "", 3: " \n\t ", 4: "One", 5: "ONE", 6: base, 7: base.upper(), 8: near, 9: prose(2, 3000),
           10: "\x00\x1c odd\u0085 é日本 😀 \n\n!", 11: "a\tb\nc\x0bd", 12: prose(3, 30)}
    for i in range(20, 32):  # a group of copies that differ from the base in one word each
        out[i] = " ".join([*words[:i], f"w{i}", *words[i + 1 :]])
    return out


@pytest.fixture(scope="session")
def docs(spark, texts):
    rows = [(i, t, ["en", None, "de"][i % 3], f"s{i % 2}", None if t is None else len(t)) for i, t in texts.items()]
    rows += [rows[5], (None, "text without an id", None, None, None)]  # a repeated row, a null id
    return spark.createDataFrame(rows, DOC_SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOC_SCHEMA)


@pytest.fixture(scope="session")
def clashing(docs):
    """The documents with extra columns that have the names of results."""
    from pyspark.sql import functions as F

    names = ("kept id key sig comp n size lang_pred score severity p_toxic words lines rest full rank part ahead was "
             "key_ ids body bucket hits names n_matches dice at first").split()
    return docs.select("*", *(F.lit("x").alias(n) for n in names))
