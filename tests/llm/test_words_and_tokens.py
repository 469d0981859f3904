"""Operators on words and tokens against brute force, with odd rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from trackline.llm import period_runs, queries, token_alignment, window_dedup

WORD = r"[^\x20\x09-\x0D]+"
BYTES = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def words(text):
    return re.findall(WORD, text or "")


@pytest.fixture(scope="module")
def numbered(stored):
    """All rows with a key of their own, so that brute force can tell repeated rows apart."""
    return [r.asDict() for r in stored.collect()]


@pytest.fixture(scope="module")
def given(spark, numbered, nothing, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("given") / "documents.parquet")
    odd = [
        {"doc_id": 5000, "text": "a b " * 30 + "c"},
        {"doc_id": 5001, "text": "ab\x00c <|endoftext|> </s> <s> ▁ é漢字 \U0001f600 \r\n\t x"},
        {"doc_id": 5002, "text": "x  y   z " * 9},
        {"doc_id": 5003, "text": " ".join(f"w{i % 200}" for i in range(3000))},
        {"doc_id": 5004, "text": " ".join(f"w{i * i % 131}" for i in range(60_000))},
        {"doc_id": 5005, "text": "no<0x41>yes " * 20},
    ]
    blank = dict.fromkeys(numbered[0])
    rows = numbered + [{**blank, **o} for o in odd]
    spark.createDataFrame([tuple(r[c] for c in nothing.columns) for r in rows], nothing.schema).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


def by_key(rows):
    found = defaultdict(list)
    for key, *rest in rows:
        found[key].append(tuple(rest))
    return {k: sorted(v, key=str) for k, v in found.items()}


# Windows


def expected_windows(rows, size):
    first = {}
    largest = 1 << 63
    for key, text in rows:
        w = words(text)
        for i in range(len(w) - size + 1):
            window = tuple(w[i : i + size])
            first[window] = min(first.get(window, largest), largest if key is None else key)
    for key, text in rows:
        w, gone = words(text), set()
        for i in range(len(w) - size + 1):
            if first[tuple(w[i : i + size])] < (largest if key is None else key):
                gone.update(range(i, i + size))
        yield key, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)


@pytest.mark.parametrize("size", [50, 3])
def test_windows_of_earlier_documents_go(given, nothing, size, monkeypatch):
    rows = [(r.doc_id, r.text) for r in given.collect()]
    want = by_key(expected_windows(rows, size))
    assert sum(r[1] for v in want.values() for r in v) > 500
    got = window_dedup.drop_windows(given, window=size)
    assert got.columns == ["doc_id", "n_words", "n_removed", "kept"]
    assert by_key(map(tuple, got.collect())) == want
    assert window_dedup.drop_windows(nothing).count() == 0


def test_windows_in_many_blocks_and_shards(given, monkeypatch):
    """Blocks of one document and many shards give what one block gives."""
    want = sorted(map(str, window_dedup.drop_windows(given, window=5).collect()))
    monkeypatch.setattr(window_dedup, "SHARD_BYTES", 1 << 12)
    small = window_dedup.in_blocks
    monkeypatch.setattr(window_dedup, "in_blocks", lambda d, k, t: small(d, k, t, 1))
    assert sorted(map(str, window_dedup.drop_windows(given, window=5).collect())) == want


def test_blocks_are_exchanged_once(given):
    done = window_dedup.drop_windows(given)
    done.collect()
    plan = done._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("FileScan") == 1 and plan.count("ReusedExchange") == 2


def test_sketch_never_underestimates():
    rng = np.random.default_rng(1)
    codes = np.concatenate([rng.integers(0, 1 << 32, 20_000), rng.integers(0, 400, 2000)]).astype("<u4")
    real = Counter(codes.tolist())
    found = window_dedup.estimates(codes)
    exact = np.array([real[c] for c in codes.tolist()])
    assert (found >= exact).all()
    assert ((found >= 2) & (exact == 1)).mean() < 0.05


def test_equal_high_hashes_are_told_apart():
    high = np.array([7, 7, 7, 9], dtype=np.uint64)
    low = np.array([2, 1, 2, 1], dtype=np.uint64)
    groups = window_dedup.Groups(high, low, np.array([5, 4, 3, 1]))
    assert list(zip(groups.high.tolist(), groups.low.tolist(), groups.first.tolist())) == [(7, 1, 4), (7, 2, 3), (9, 1, 1)]


# Runs


def expected_runs(w, least=6, periods=4):
    found = {}
    for q in range(1, len(w) // periods + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            start = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i - start + q >= max(least, periods * q):
                found.setdefault((start, i - start + q), q)
    return sorted((s, n, q) for (s, n), q in found.items())


def collapse(w, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


@pytest.mark.parametrize("least,periods", [(6, 4), (3, 3), (12, 5)])
def test_runs_of_random_words(least, periods):
    rng = random.Random(least)
    for _ in range(400):
        docs = []
        for _ in range(rng.randint(1, 5)):
            n, kinds = rng.choice([0, 1, 3, 6, 10, 30, 80]), rng.choice([1, 2, 3, 8])
            w = [rng.randrange(kinds) for _ in range(n)]
            if rng.random() < 0.6 and n > 4:
                a = rng.randrange(n)
                p = rng.randint(1, max(1, (n - a) // 3))
                w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
            docs.append(w)
        flat = np.array([x for d in docs for x in d], dtype=np.int64)
        owner, start, length, period = period_runs.runs_of(flat, np.array([len(d) for d in docs]), least, periods)
        got = list(zip(owner.tolist(), start.tolist(), length.tolist(), period.tolist()))
        assert got == [(d, *r) for d, w in enumerate(docs) for r in expected_runs(w, least, periods)]


def test_runs_of_documents(given, nothing, monkeypatch):
    found = period_runs.find_runs(given)
    assert found.columns == ["doc_id", "n_words", "runs", "collapsed"]
    got = by_key((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in found.collect())
    want = by_key(
        (r.doc_id, len(w), runs, collapse(w, runs))
        for r in given.collect()
        for w in [words(r.text)]
        for runs in [expected_runs(w) if len(w) < 9000 else period_runs_by_steps(w)]
    )
    assert got == want
    assert sum(len(r[1]) for v in want.values() for r in v) >= 5
    assert period_runs.find_runs(nothing).count() == 0
    with pytest.raises(ValueError):
        period_runs.find_runs(given, least_periods=2)


def period_runs_by_steps(w):
    """Runs of a long text by comparing it with itself moved by each period."""
    ids = {x: i for i, x in enumerate(dict.fromkeys(w))}
    a, found = np.array([ids[x] for x in w]), {}
    for q in range(1, len(a) // 4 + 1):
        same = np.concatenate([[0], (a[q:] == a[:-q]).view(np.int8), [0]])
        steps = np.diff(same)
        for s, e in zip(np.flatnonzero(steps == 1).tolist(), np.flatnonzero(steps == -1).tolist()):
            if e - s + q >= max(6, 4 * q):
                found.setdefault((s, e - s + q), q)
    return sorted((s, n, q) for (s, n), q in found.items())


def test_query_of_runs(spark, given, tmp_path):
    given.write.parquet(str(tmp_path / "documents.parquet"))
    got = by_key(map(tuple, queries.op12_period_runs(spark, str(tmp_path)).collect()))
    want = []
    for r in given.collect():
        w = words(r.text)
        n = len(w)
        if n > 9000:
            continue
        h = zlib.crc32(str(r.doc_id).encode()) if r.doc_id is not None else 1
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        runs = expected_runs(w)
        best = min(runs, key=lambda x: (-x[1], x[0], x[2])) if runs else (None, None, None)
        lines = "".join("%d,%d,%d\n" % x for x in runs)
        want.append(
            (r.doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None)
            + tuple(hashlib.sha256(t.encode()).hexdigest() for t in (lines, collapse(w, runs)))
        )
    want = by_key(want)
    assert {k: got[k] for k in want} == want


# Tokens


def expected_tokens(rows):
    coder = Tokenizer.from_file(BYTES)
    coder.encode_special_tokens = True
    pieces = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    letters = token_alignment.byte_letters()
    spell = {i: bytes(letters[c] for c in t) for t, i in coder.get_vocab().items()}

    def piece(i):
        shown = pieces.id_to_piece(i)
        return bytes([int(shown[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", shown) else shown.replace("▁", " ").encode()

    total, found = Counter(), []
    for key, text in rows:
        a = coder.encode(" " + text, add_special_tokens=False).ids if text else []
        b = pieces.encode(text) if text else []
        want = (" " + (text or "")).encode()
        if b"".join(spell[i] for i in a) != want or b"".join(map(piece, b)) != want:
            a, b = [], []
        ends_a = np.cumsum([len(spell[i]) for i in a]).tolist()
        ends_b = np.cumsum([len(piece(i)) for i in b]).tolist()
        cuts = sorted(set(ends_a) & set(ends_b))
        groups = [([], []) for _ in cuts]
        for side, ids, ends in ((0, a, ends_a), (1, b, ends_b)):
            for i, e in zip(ids, ends):
                groups[sum(c < e for c in cuts) if len(cuts) < 300 else int(np.searchsorted(cuts, e))][side].append(i)
        links = [
            (i, j)
            for i, s, e in zip(a, [0, *ends_a], ends_a)
            for j, s2, e2 in overlapping(b, ends_b, s, e)
        ]
        total.update(links)
        found.append((key, len(a), len(b), groups, links))
    best = defaultdict(int)
    for (_, j), n in total.items():
        best[j] = max(best[j], n)
    for key, n_a, n_b, groups, links in found:
        shown = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        yield (
            key, n_a, n_b, len(groups), len(links),
            sum(total[x] == best[x[1]] for x in links), sum(total[x] for x in links), shown,
        )


def overlapping(ids, ends, start, end):
    at = int(np.searchsorted(ends, start, side="right"))
    while at < len(ids) and (ends[at - 1] if at else 0) < end:
        yield ids[at], ends[at - 1] if at else 0, ends[at]
        at += 1


def test_tokens_of_both_kinds(given, nothing, monkeypatch):
    rows = given.select("doc_id", F.when(F.col("doc_id") == 5004, F.substring("text", 1, 5000)).otherwise(F.col("text")).alias("text"), "key", "size")
    want = by_key(expected_tokens([(r.doc_id, r.text) for r in rows.collect()]))
    done = token_alignment.align(rows, BYTES, PIECES)
    assert done.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]
    assert by_key(map(tuple, done.collect())) == want
    assert want[5001][0][0] == 0 < want[5002][0][0]
    assert token_alignment.align(nothing, BYTES, PIECES).count() == 0
    monkeypatch.setattr(token_alignment, "BLOCK_BYTES", 1)
    assert by_key(map(tuple, token_alignment.align(rows, BYTES, PIECES).collect())) == want


def test_fast_ids_equal_slow_ids():
    coder = token_alignment.ByteTokenizer(BYTES)
    assert coder.fast is not None and coder.library is None
    rng = random.Random(5)
    letters = [chr(i) for i in range(0x250) if i != 0x7F]
    for _ in range(300):
        text = "".join(rng.choices(letters[9:] + list("  \n\n'sabcde 12"), k=60))
        assert coder.encode(text) == coder.slow.encode(text, add_special_tokens=False).ids


def test_query_of_tokens(spark, given, tmp_path):
    given.where("doc_id < 60").write.parquet(str(tmp_path / "documents.parquet"))
    rows = queries.op13_token_alignment(spark, str(tmp_path)).collect()
    whole = token_alignment.align(given.where("doc_id < 60"), BYTES, PIECES).collect()
    digests = by_key((r.doc_id, hashlib.sha256(r.groups.encode()).hexdigest() if r.n_groups else "") for r in whole)
    assert by_key((r.doc_id, r.groups_sha256) for r in rows) == digests
