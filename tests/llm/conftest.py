import random

import pytest
from pyspark.sql import types as T

#: Columns of ``documents``, and others whose names the operators use inside.
DOCUMENTS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.IntegerType()),
        *(T.StructField(c, T.StringType()) for c in ("key", "size", "row", "text_key", "number", "taken", "line", "kept", "rank")),
    ]
)
FILL = ("x",) * 9


def sentence(rng: random.Random, words: int) -> str:
    return " ".join("".join(rng.choices("abcdefgh", k=rng.randint(2, 6))) for _ in range(words)) + "."


@pytest.fixture(scope="session")
def texts():
    """Copies, near copies, shared passages and lines, odd texts, repeated rows, nulls everywhere."""
    rng = random.Random(3)
    passage = sentence(rng, 90)
    found = ["\n".join(sentence(rng, 30) for _ in range(4)) for _ in range(40)]
    found += found[:6] + [found[7]] * 5
    for i in range(8, 16):
        words = found[i].split(" ")
        words[rng.randrange(len(words))] = "changed"
        found.append(" ".join(words))
    found += [f"{sentence(rng, 20)}\n{passage}\n{sentence(rng, 25)}" for _ in range(6)]
    found += [f"{sentence(rng, 30)}\nShared line of all sites.\n{sentence(rng, 10)}" for _ in range(12)]
    found += [None, None, "", " \n\t ", "one", "one", "two words", "a b c d", "aa " * 300, "x" * 3000, "é ß   ü 漢字 " * 60]
    found += [" ".join(sentence(rng, 50) for _ in range(150)), "na&&& na*** " * 40, "Home | News | About | More | Login"]
    return found


@pytest.fixture(scope="session")
def documents(spark, texts):
    rows = [(i, t, "en", f"s{i % 7}", 1, *FILL) for i, t in enumerate(texts)]
    rows += [rows[3], rows[3], (None, texts[2], None, None, None, *(None,) * 9), (None, None, None, None, None, *(None,) * 9)]
    return spark.createDataFrame(rows, DOCUMENTS).repartition(3)


@pytest.fixture(scope="session")
def stored(spark, documents, tmp_path_factory):
    """The documents as a stored table, as the pipeline reads them."""
    path = str(tmp_path_factory.mktemp("documents") / "documents.parquet")
    documents.write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], DOCUMENTS)
