"""A quality classifier without labels: overlapping heuristics, their accuracies by EM, a hashed linear scorer."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trackline.llm.quality_rules import MARKED, SEPARATOR_WORDS, repeated_words
from trackline.session import write_shared

#: Documents the scorer is trained on, about; posterior labels come from all documents.
TRAINING = 6_000
#: Places of the hashed features.
BITS = 14
EPOCHS = 12
ABSTAIN, BAD, GOOD = 0, 1, 2
#: A labeller says bad from its first limit on, good up to its second; in between it abstains.
LABELLERS = {
    "marked": (0.2, 0.02),
    "shouted": (0.5, 0.2),
    "separated": (0.2, 0.05),
    "repeated": (0.3, 0.05),
    "one_word": (0.3, 0.15),
    "few_kinds": (0.9, 0.7),
    "short": (1.0, 0.5),
    "open_ends": (0.9, 0.5),
}
#: Labellers are made not to accuse wrongly: before counting, one is taken to call so many good
#: documents bad, and bad ones, with this weight against the corpus, and never more good ones than
#: MOST_FALSE. So what shows one flaw only is bad, though most labellers like it.
BAD_OF_GOOD, BAD_OF_BAD, TRUST, MOST_FALSE = 0.002, 0.125, 0.5, 0.005
#: Ends of sentences in several scripts, and what may stand after them.
SENTENCE_ENDS = (
    *(".", "!", "?", "…", "»", "”", '"', ")", ":", ";"),
    *"。．！？：；｡」』）",  # Chinese, Japanese
    *"।॥؟۔؛։።။។",  # Devanagari, Arabic, Urdu, Armenian, Ethiopic, Burmese, Khmer
)


def shares(text: str, words: list[bytes]) -> list[float]:
    """What the labellers look at, each from 0 (good) to 1 (bad)."""
    n = len(words)
    if not n:
        return [0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0, 1.0]
    counts = Counter(words)
    marked = sum(c for w, c in counts.items() if MARKED.search(w))
    separated = sum(counts[w] for w in SEPARATOR_WORDS)
    lowers, uppers = sum(map(str.islower, text)), sum(map(str.isupper, text))
    lines = [s for line in text.split("\n") if (s := line.rstrip())]
    ended = sum(line.endswith(SENTENCE_ENDS) for line in lines)
    return [
        marked / n,
        uppers / (lowers + uppers) if lowers + uppers else 0.0,
        separated / n,
        repeated_words(words) / n,
        max(counts.values()) / n if n >= 20 else 0.2,
        1 - len(counts) / n if n >= 20 else 0.8,
        max(0.0, 1 - n / 100),
        1 - ended / len(lines) if lines else 1.0,
    ]


def votes_of(found: list[float]) -> int:
    """The votes as one number, two bits a labeller."""
    number = 0
    for k, (value, (bad, good)) in enumerate(zip(found, LABELLERS.values())):
        number |= (BAD if value >= bad else GOOD if value <= good else ABSTAIN) << 2 * k
    return number


def em(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """Dawid and Skene's estimate: per pattern the probability of good, and (class, labeller, vote) rates.

    The rates are free only within what BAD_OF_GOOD, BAD_OF_BAD, TRUST and MOST_FALSE, set by hand, leave.

    Labellers are taken as independent within a class; one that abstains tells nothing.
    """
    votes = patterns[:, None] >> 2 * np.arange(len(LABELLERS)) & 3
    shown = np.stack([votes == BAD, votes == GOOD], axis=2).astype(float)
    start = np.array([[BAD_OF_BAD, 1 - BAD_OF_BAD], [BAD_OF_GOOD, 1 - BAD_OF_GOOD]])
    rates = np.repeat(start[:, None, :], len(LABELLERS), axis=1)
    total = max(1.0, counts.sum())
    accused = float(counts[(votes == BAD).any(axis=1)].sum() / total)
    weight, prior = TRUST * total, np.clip([accused, 1 - accused], 0.01, 0.99)
    for _ in range(rounds):
        score = np.log(prior) + np.einsum("plv,clv->pc", shown, np.log(rates))
        posterior = np.exp(score - score.max(axis=1, keepdims=True))
        posterior /= posterior.sum(axis=1, keepdims=True)
        mass = posterior * counts[:, None]
        votes_by = np.einsum("pc,plv->clv", mass, shown) + weight * start[:, None, :]
        new = votes_by / votes_by.sum(axis=2, keepdims=True)
        false = np.minimum(new[1, :, 0], MOST_FALSE)
        new[1] = np.stack([false, 1 - false], axis=1)
        prior = np.clip(mass.sum(axis=0) / total, 1e-6, 1 - 1e-6)
        moved, rates = np.abs(new - rates).max(), new
        if moved < 1e-9:
            break
    return posterior[:, 1], rates


def hashed(text: str, found: list[float]) -> tuple[np.ndarray, np.ndarray]:
    """Places and values of a text: damped counts of its three-byte strings, and the sizes of the shares in steps."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8).astype(np.uint32)
    if len(data) >= 3:
        mixed = (data[:-2] * np.uint32(0x9E3779B1)) ^ (data[1:-1] * np.uint32(0x85EBCA77)) ^ (data[2:] * np.uint32(0xC2B2AE3D))
        counts = np.bincount((mixed * np.uint32(0x27D4EB2F)) >> np.uint32(32 - BITS), minlength=1 << BITS)
        place = np.flatnonzero(counts)
        value = np.log1p(counts[place])
        value /= np.linalg.norm(value)
    else:
        place, value = np.zeros(0, np.int64), np.zeros(0)
    steps = [(k * 16 + min(15, int(v * 10)) + 1) * 0x9E3779B1 >> 7 & (1 << BITS) - 1 for k, v in enumerate(found)]
    return np.concatenate([place, steps]).astype(np.uint16), np.concatenate([value, np.full(len(steps), 0.5)]).astype(np.float32)


def train(rows: list[tuple[np.ndarray, np.ndarray, float]]) -> tuple[np.ndarray, float]:
    """A logistic scorer on soft labels by AdaGrad, rows in the given order."""
    weights, squares = np.zeros(1 << BITS), np.full(1 << BITS, 1e-6)
    constant, constant_squares = 0.0, 1e-6
    for _ in range(EPOCHS):
        for place, value, label in rows:
            p = 1 / (1 + np.exp(-np.clip(weights[place] @ value + constant, -30, 30)))
            gradient = (p - label) * value
            squares[place] += gradient**2
            weights[place] -= 0.3 * gradient / np.sqrt(squares[place])
            constant_squares += (p - label) ** 2
            constant -= 0.3 * (p - label) / np.sqrt(constant_squares)
    return weights, constant


def score_quality(
    docs: DataFrame, key: str = "doc_id", text: str = "text", training: int = TRAINING
) -> DataFrame:
    """Quality of every whole text, from 0 to 1, learned without labels.

    Eight heuristic labellers vote good, bad or nothing on every document. The counts of their
    vote patterns over all documents (at most 3**8) go to expectation maximisation, which gives
    the labellers' rates per class and each pattern's probability of being good. About
    ``training`` documents, drawn by a hash of their text, then train a linear scorer on hashed
    three-byte strings and steps of the labellers' measures, which scores all documents.

    Returns the key, ``votes`` (two bits a labeller), ``label`` (probability by the votes),
    ``score`` and ``kept`` (score of 0.5 or more). Null and empty texts are scored as empty, and
    are bad by votes. Repeated rows are scored alike, null keys are kept. Without documents of
    both kinds the score follows the one kind there is. An empty table gives no rows. Other
    columns are not read.
    """
    chosen = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [votes_of(shares(t, t.encode("utf-8", "surrogatepass").split())) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, type=pa.int32())], names=["chance", "votes"])

    voted = write_shared(
        chosen.select(F.pmod(F.xxhash64("text"), F.lit(1 << 30)).alias("chance"), "text").mapInArrow(vote, "chance long, votes int"),
        "quality-votes",
    )
    patterns = voted.groupBy("votes").count().collect()
    if not patterns:
        patterns = [{"votes": 0, "count": 0}]
    numbers = np.array([p["votes"] for p in patterns], dtype=np.int64)
    counts = np.array([p["count"] for p in patterns], dtype=np.float64)
    posterior, _ = em(numbers, counts)
    label = dict(zip(numbers.tolist(), posterior.tolist()))
    limit = int(min(1.0, training / max(1.0, counts.sum())) * (1 << 30))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for t in batch.column(0).to_pylist():
                found = shares(t, t.encode("utf-8", "surrogatepass").split())
                place, value = hashed(t, found)
                rows.append((place.tobytes(), value.astype(np.float16).tobytes(), label[votes_of(found)]))
            columns = list(zip(*rows)) if rows else [()] * 3
            kinds = (pa.binary(), pa.binary(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(columns, kinds)], names=["place", "value", "label"])

    drawn = chosen.where(F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < limit).select("text").dropDuplicates(["text"])
    sample = drawn.mapInArrow(features, "place binary, value binary, label double").collect()
    rows = sorted(
        (bytes(r["place"]), bytes(r["value"]), r["label"]) for r in sample
    )
    weights, constant = train(
        [(np.frombuffer(p, np.uint16).astype(np.int64), np.frombuffer(v, np.float16).astype(np.float64), y) for p, v, y in rows]
    )
    schema = T.StructType(
        [
            T.StructField(key, docs.schema[key].dataType),
            T.StructField("votes", T.IntegerType()),
            T.StructField("label", T.DoubleType()),
            T.StructField("score", T.DoubleType()),
            T.StructField("kept", T.BooleanType()),
        ]
    )

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for t in batch.column(1).to_pylist():
                found = shares(t, t.encode("utf-8", "surrogatepass").split())
                place, value = hashed(t, found)
                p = 1 / (1 + np.exp(-np.clip(weights[place] @ value + constant, -30, 30)))
                votes = votes_of(found)
                out.append((votes, label.get(votes, 0.5), float(p), bool(p >= 0.5)))
            columns = list(zip(*out)) if out else [()] * 4
            kinds = (pa.int32(), pa.float64(), pa.float64(), pa.bool_())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, type=k) for c, k in zip(columns, kinds))], names=schema.names
            )

    return chosen.mapInArrow(score, schema)
