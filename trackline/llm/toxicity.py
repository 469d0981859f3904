"""Toxicity scores: misspelled lexicon terms found by Levenshtein automata, weighed by context."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trackline.llm.common import cut
from trackline.session import write_shared

#: Labelled documents that lexicon and weights are learned from, at most (about).
TRAINING = 20_000
#: Lengths of word beginnings that can be stems.
STEMS = range(3, 9)
#: A term occurs in so many toxic documents, in so many different surroundings, and so many times
#: as often (by documents) as in others.
MIN_DOCUMENTS, MIN_SURROUNDINGS, MIN_LIFT = 4, 6, 15.0
#: A stem has so many different endings.
MIN_ENDINGS = 3
#: Words before a term that report it, and words that aim it at a reader.
REPORTING = frozenset(
    "said says saying wrote writes written called calls calling quote quotes quoted quoting word words term terms slur "
    "slurs insult insults phrase phrases expression reported reports".split()
)
AIMED = frozenset("you your yours you're youre u ur yourself".split())
WINDOW = 4
#: Words a quotation lasts at most.
QUOTATION = 40
OPENING, CLOSING = "\"“„«‘‹", "\"”“»’›"
EDGE = "".join(chr(c) for c in range(0x21, 0x7F) if not chr(c).isalnum()) + "“”„«»‘’‹›¡¿…–—·•"
FEATURES = ("hit", "hits", "misspelled", "quoted", "evidence", "aimed", "share")


def tokens_of(text: str) -> list[str]:
    return text.lower().split()


def edits_for(term: str) -> int:
    """Edits a whole word may have: none below four letters, two from nine."""
    return 0 if len(term) < 4 else 1 if len(term) < 9 else 2


@dataclass
class Node:
    children: dict[str, "Node"] = field(default_factory=dict)
    word: int = -1
    stem: int = -1
    #: Most edits that any word below allows.
    edits: int = 0


class Lexicon:
    """Words and stems in a trie, intersected with the Levenshtein automata of all its words.

    A state is the set of trie nodes that the letters read so far can have led to, each with the
    edits used: a letter may be replaced, left out or added, or two neighbours swapped. States are
    made when first reached and kept, so reading a word costs one lookup a letter, and most words
    end in the empty state after a few. Stems and ``strict`` words allow no edits; ``clean`` words
    are no misspellings.
    """

    def __init__(
        self,
        words: list[str],
        stems: list[str],
        clean: frozenset[str] = frozenset(),
        strict: frozenset[str] = frozenset(),
    ) -> None:
        self.terms = [*words, *stems]
        self.clean = clean
        self.edits = [0 if w in strict else edits_for(w) for w in words] + [0] * len(stems)
        self.root = Node()
        for i, term in enumerate(self.terms):
            node, edits = self.root, self.edits[i]
            node.edits = max(node.edits, edits)
            for letter in term:
                node = node.children.setdefault(letter, Node())
                node.edits = max(node.edits, edits)
            if i < len(words):
                node.word = i
            else:
                node.stem = i
        self.steps: dict[tuple[int, str], int] = {}
        self.states: list[tuple[dict, int]] = []
        self.numbers: dict[frozenset, int] = {}
        self.start = self._number(self._closed({(id(self.root), ""): (self.root, 0)}), -1)

    def _number(self, state: dict, stem: int) -> int:
        name = frozenset((k, e) for k, (_, e) in state.items()) | {("stem", stem)}
        if name not in self.numbers:
            self.numbers[name] = len(self.states)
            self.states.append((state, stem))
        return self.numbers[name]

    @staticmethod
    def _add(state: dict, node: Node, edits: int, swapped: str = "") -> bool:
        key = (id(node), swapped)
        if edits > node.edits or (key in state and state[key][1] <= edits):
            return False
        state[key] = (node, edits)
        return True

    def _closed(self, state: dict) -> dict:
        """With the nodes that letters left out lead to."""
        todo = [(n, e) for (_, swapped), (n, e) in state.items() if not swapped]
        while todo:
            node, edits = todo.pop()
            for child in node.children.values():
                if self._add(state, child, edits + 1):
                    todo.append((child, edits + 1))
        return state

    def _step(self, number: int, letter: str) -> int:
        state, stem = self.states[number]
        after: dict = {}
        for (_, swapped), (node, edits) in state.items():
            if swapped:
                if swapped == letter:
                    self._add(after, node, edits)
                continue
            self._add(after, node, edits + 1)
            for name, child in node.children.items():
                self._add(after, child, edits + (name != letter))
                if name != letter and letter in child.children:
                    self._add(after, child.children[letter], edits + 1, name)
        if stem < 0:
            stem = max((n.stem for (_, s), (n, e) in after.items() if not s and e == 0), default=-1)
        return self._number(self._closed(after), stem)

    def find(self, word: str) -> tuple[int, int]:
        """The term that a word is (-1: none) and its edits."""
        number = self.start
        for letter in word:
            key = (number, letter)
            follow = self.steps.get(key)
            if follow is None:
                follow = self.steps[key] = self._step(number, letter)
            number = follow
            if not self.states[number][0]:
                break
        state, stem = self.states[number]
        best = min(
            ((e, n.word) for (_, s), (n, e) in state.items() if not s and n.word >= 0 and e <= self.edits[n.word]),
            default=(99, -1),
        )
        if best[0] == 0:
            return best[1], 0
        if stem >= 0:
            return stem, 0
        if best[1] >= 0 and word not in self.clean:
            return best[1], best[0]
        return -1, 0


class Reader:
    """Features of texts: hits of the lexicon and their surroundings."""

    def __init__(self, lexicon: Lexicon, weights: np.ndarray) -> None:
        self.lexicon, self.weights = lexicon, weights
        self.memo = _Found(lexicon)

    def features(self, text: str) -> list[float]:
        tokens = tokens_of(text)
        if len(self.memo) > 500_000:
            self.memo = _Found(self.lexicon)
        found = list(map(self.memo.__getitem__, tokens))
        places = [i for i, f in enumerate(found) if f]
        if not places:
            return [0.0] * len(FEATURES)
        quoted = self._quoted(tokens, places)
        hits = misspelled = in_quotes = aimed = 0
        terms: set[int] = set()
        for i in places:
            term, edits = found[i]
            near = [t.strip(EDGE) for t in tokens[max(0, i - WINDOW) : i + WINDOW + 1]]
            before = near[: min(i, WINDOW)]
            if i in quoted or REPORTING.intersection(before):
                in_quotes += 1
                continue
            hits += 1
            misspelled += edits > 0
            aimed += bool(AIMED.intersection(near))
            terms.add(term)
        evidence = min(12.0, sum(float(self.weights[t]) for t in terms))
        share = math.sqrt(hits / len(tokens))
        return [float(hits > 0), *map(math.log1p, (hits, misspelled, in_quotes)), evidence, math.log1p(aimed), share]

    @staticmethod
    def _quoted(tokens: list[str], places: list[int]) -> set[int]:
        """Places between an opening and a closing quotation mark."""
        inside: set[int] = set()
        for i in places:
            low = max(0, i - QUOTATION)
            for k in range(i, low - 1, -1):
                if k < i and tokens[k][-1] in CLOSING:
                    break
                if tokens[k][0] in OPENING:
                    ends = range(i, min(len(tokens), k + QUOTATION))
                    if any(tokens[e].rstrip(".,;:!?")[-1:] in CLOSING and (e > k or len(tokens[e]) > 1) for e in ends):
                        inside.add(i)
                    break
        return inside


class _Found(dict):
    """Term and edits of each token, None where there is none."""

    def __init__(self, lexicon: Lexicon) -> None:
        super().__init__()
        self.lexicon = lexicon

    def __missing__(self, token: str) -> tuple[int, int] | None:
        word = token.strip(EDGE)
        found = self.lexicon.find(word) if word else (-1, 0)
        self[token] = out = found if found[0] >= 0 else None
        return out


def term_counts(sample: DataFrame) -> DataFrame:
    """Per ``term`` (words as w:, beginnings as p:) documents that have it: ``toxic`` and ``other``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, list[int]] = {}

        def flush() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays(
                [pa.array(list(seen)), pa.array([c[1] for c in seen.values()]), pa.array([c[0] for c in seen.values()])],
                names=["term", "toxic", "other"],
            )
            seen.clear()
            return batch

        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                terms: set[str] = set()
                for word in {t.strip(EDGE) for t in tokens_of(text)}:
                    if word:
                        terms.add("w:" + word)
                        terms.update("p:" + word[:n] for n in STEMS if n < len(word))
                for term in terms:
                    seen.setdefault(term, [0, 0])[toxic] += 1
                if len(seen) > 300_000:
                    yield flush()
        if seen:
            yield flush()

    counted = sample.select("text", "toxic").mapInArrow(count, "term string, toxic long, other long")
    return counted.groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))


def learn_lexicon(sample: DataFrame) -> tuple[list[str], list[str], dict[str, float]]:
    """Words and stems of toxic documents, and the logarithm of how much more frequent they are there.

    Copies of one document would make any rare word of it look toxic; so terms have to occur in
    different surroundings too (the words before and after).
    """
    totals = sample.agg(F.sum("toxic"), F.count("*")).first()
    toxic_docs = totals[0] or 0
    if not toxic_docs or toxic_docs == totals[1]:
        return [], [], {}
    lift = (F.col("toxic") / toxic_docs) / ((F.col("other") + 0.5) / (totals[1] - toxic_docs))
    chosen = term_counts(sample).where((F.col("toxic") >= MIN_DOCUMENTS) & (lift >= MIN_LIFT))
    rows = chosen.select("term", "toxic", F.log(lift).alias("weight")).collect()
    weights = {r["term"]: float(r["weight"]) for r in rows}
    toxic = sample.where("toxic = 1").select("text")

    def surroundings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: set[tuple[str, str, str]] = set()
            for text in batch.column(0).to_pylist():
                words = ["", *(t.strip(EDGE) for t in tokens_of(text)), ""]
                for i in range(1, len(words) - 1):
                    word = words[i]
                    for term in ("w:" + word, *("p:" + word[:n] for n in STEMS if n < len(word))):
                        if term in weights:
                            out.add((term, word, f"{words[i - 1]} {words[i + 1]}"))
            columns = list(zip(*out)) if out else [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, type=pa.string()) for c in columns], names=["term", "word", "around"])

    places = toxic.mapInArrow(surroundings, "term string, word string, around string")
    kept = (
        places.groupBy("term")
        .agg(F.count_distinct("around").alias("surroundings"), F.count_distinct("word").alias("endings"))
        .where(F.col("surroundings") >= MIN_SURROUNDINGS)
        .where(F.col("term").startswith("w:") | (F.col("endings") >= MIN_ENDINGS))
        .collect()
    )
    # All that pass: the thresholds and the size of the sample bound them.
    terms = sorted(r["term"] for r in kept)
    words = [t[2:] for t in terms if t.startswith("w:")]
    begun = {t[2:] for t in terms if t.startswith("p:")}
    stems = sorted(s for s in begun if not any(s[:n] in begun for n in range(1, len(s))))
    return words, stems, {t: weights["w:" + t] for t in words} | {f"{t}*": weights["p:" + t] for t in stems}


def near_misses(sample: DataFrame, words: list[str], stems: list[str]) -> tuple[frozenset[str], ...]:
    """Words of harmless documents that come near a term, those among them seen once, and strict terms.

    Words of harmless documents are ``clean``. What further near misses tell depends on how many a
    document brings: harmless ones are as frequent as words seen in one harmless document only
    (Good and Turing's estimate), toxic ones as those seen in toxic documents alone. Both are rates
    per document, so terms do not turn strict because more text is labelled.
    """
    if not words:
        return frozenset(), frozenset(), frozenset()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(words, stems)
        for batch in batches:
            seen: dict[tuple[str, str], list[int]] = {}
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for word in {t.strip(EDGE) for t in tokens_of(text)} - {""}:
                    term, edits = lexicon.find(word)
                    if edits:
                        seen.setdefault((word, lexicon.terms[term]), [0, 0])[toxic] += 1
            rows = [(*k, toxic, other) for k, (other, toxic) in seen.items()]
            columns = list(zip(*rows)) if rows else [()] * 4
            kinds = (pa.string(), pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, type=k) for c, k in zip(columns, kinds)], names=["word", "term", "toxic", "other"]
            )

    counted = sample.select("text", "toxic").mapInArrow(count, "word string, term string, toxic long, other long")
    near = counted.groupBy("word", "term").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other")).collect()
    totals = sample.agg(F.sum("toxic"), F.count("*")).first()
    ratio = (totals[1] - totals[0] + 1) / (totals[0] + 1)
    new = {w: [0.5, 0.5] for w in words}
    for r in near:
        if not r["other"]:
            new[r["term"]][1] += r["toxic"]
        elif r["other"] == 1:
            new[r["term"]][0] += 1
    clean = frozenset(r["word"] for r in near if r["other"])
    once = frozenset(r["word"] for r in near if r["other"] == 1)
    return clean, once, frozenset(w for w, (o, t) in new.items() if t * ratio <= o)


def fit(rows: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Weights of a logistic model with a small ridge, by Newton's method; the last is the constant."""
    x = np.column_stack([rows, np.ones(len(rows))])
    w = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], 1.0)
    ridge[-1] = 1e-3
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - toxic) + ridge * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge), gradient)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def held_out(key: F.Column) -> F.Column:
    return (F.crc32(F.coalesce(key.cast("string"), F.lit(""))) % 5) == 0


def score_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
    training: int = TRAINING,
) -> DataFrame:
    """Toxicity of every whole text, from 0 to 1.

    About ``training`` labelled documents outside the held-out fold, drawn by a hash of the key,
    teach a lexicon of words and stems and the weights of a logistic model. Misspelled terms are
    found by the automata of the lexicon; near misses that are words of harmless documents do not
    count, and neither do those of terms whose new near misses are rarer in toxic documents. Terms in quotation marks or after reporting words are counted apart from abuse. Labels and keys
    are not inputs of a score.

    Returns the key, ``held_out``, ``score`` and ``predicted`` (1 from 0.5). Null and empty texts
    get the score of a text without terms. Repeated rows are scored alike; a null key is hashed as
    an empty one. Labels that are null or that contradict each other count as the greater; without
    labels of both kinds the share of toxic ones (0 without any) is the score of all. An empty
    table gives no rows. Other columns are not read.
    """
    known = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).where(~held_out(F.col(key)))
    known = known.groupBy(F.col(key).alias("key")).agg(F.max(F.col(label).cast("int")).alias("toxic"))
    known = cut(known)
    count = known.count()
    if count > training:
        known = known.where(F.pmod(F.xxhash64("key"), F.lit(1_000_000)) < int(training / count * 1_000_000))
    chosen = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    sample = write_shared(chosen.join(known, "key").select("text", "toxic"), "toxicity-sample")
    words, stems, named = learn_lexicon(sample)
    evidence = np.array([named[t] for t in words] + [named[f"{t}*"] for t in stems])

    clean, once, strict = near_misses(sample, words, stems)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A word that only one harmless document knows counts there as it would in a new document.
        reader = Reader(Lexicon(words, stems, clean - once, strict), evidence)
        for batch in batches:
            rows = [reader.features(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows, type=pa.list_(pa.float64())), batch.column(1)], names=["features", "toxic"]
            )

    rows = sample.select("text", "toxic").mapInArrow(describe, "features array<double>, toxic int")
    # Patterns of features with counts: texts without terms, the most, are one row.
    gathered = rows.groupBy("features", "toxic").count().collect()
    if gathered:
        x = np.repeat(np.array([r["features"] for r in gathered]), [r["count"] for r in gathered], axis=0)
        y = np.repeat(np.array([float(r["toxic"]) for r in gathered]), [r["count"] for r in gathered])
        weights = fit(x, y) if 0 < y.sum() < len(y) else np.append(np.zeros(x.shape[1]), 40.0 if y.sum() else -40.0)
    else:
        weights = np.append(np.zeros(len(FEATURES)), -40.0)
    schema = T.StructType(
        [
            T.StructField(key, docs.schema[key].dataType),
            T.StructField("held_out", T.BooleanType()),
            T.StructField("score", T.DoubleType()),
            T.StructField("predicted", T.IntegerType()),
        ]
    )

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(Lexicon(words, stems, clean, strict), evidence)
        for batch in batches:
            x = np.array([reader.features(t) for t in batch.column(2).to_pylist()]).reshape(-1, len(FEATURES))
            p = 1 / (1 + np.exp(-np.clip(x @ weights[:-1] + weights[-1], -30, 30)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=schema.names
            )

    return chosen.select("key", held_out(F.col("key")).alias("held_out"), "text").mapInArrow(score, schema)
