"""Operators on documents against brute force, with odd rows."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from trackline.llm import (
    bagminhash,
    line_dedup,
    mixing,
    packing,
    quality_model,
    quality_rules,
    suffix_dedup,
    toxicity,
)

WORD = r"[^\x20\x09-\x0D]+"
PATH = public_tokenizers.path("word_bpe_49k.json")


def words(text):
    return re.findall(WORD, text or "")


# Quality rules


def test_counts_of_quality_rules(documents):
    rows = quality_rules.assess(documents).collect()
    assert len(rows) == documents.count()
    by_id = {r.doc_id: r for r in rows if r.doc_id is not None}
    for d in documents.collect():
        if d.doc_id is None:
            continue
        text, w, got = d.text or "", words(d.text), by_id[d.doc_id]
        grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        twice = Counter(grams)
        hit = {k for i, g in enumerate(grams) if twice[g] > 1 for k in range(i, i + 5)}
        lines = text.split("\n")
        duplicates = sum(line in lines[:i] and bool(words(line)) for i, line in enumerate(lines))
        assert (got.n_words, got.word_chars) == (len(w), sum(map(len, w)))
        assert got.n_symbols == len(re.findall(r"[#*$%&|<>]", text))
        assert (got.n_dup_lines, got.n_repeat_words) == (duplicates, len(hit))
        assert got.base_failed == (len(w) < 10 or 100 * len(hit) > 20 * len(w))
        assert got.kept <= (not got.base_failed)


def test_line_rules():
    rules = quality_rules.Rules()
    clean = "The quick brown fox jumps over the lazy dog today."
    text = f"{clean}\nHome | News | About | Contact\n{clean[::-1]}\nlorem ipsum dolor\n{clean.upper()}"
    *_, failed, kept, cleaned, removed = quality_rules.judge(text, rules)
    assert (failed, kept, removed) == (False, True, 2)
    assert cleaned == f"{clean}\n{clean[::-1]}\n{clean.upper()}"
    junk = " ".join(f"word{i}***" for i in range(30))
    assert quality_rules.judge(f"{junk}\n{clean}", rules)[6] is False
    many = [str(i).encode() for i in range(9000)] + [b"0", b"1", b"2", b"3", b"4"]
    assert quality_rules.repeated_words(many) == 10


def test_keep_clean_keeps_columns(documents, nothing):
    kept = quality_rules.keep_clean(documents)
    assert kept.dtypes == documents.dtypes
    found = {r.doc_id for r in kept.collect()}
    assert 20 in found and not {r.doc_id for r in documents.where("text is null").collect()} & found - {None}
    assert quality_rules.keep_clean(nothing).count() == quality_rules.assess(nothing).count() == 0


# Mixing


def water_fill(sizes, share=1.5, most=2.0):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    left, todo, target = sum(sizes.values()) * share, set(order), {}
    while todo:
        level = left / sum(weight[s] for s in todo)
        full = {s for s in todo if level * weight[s] > most * sizes[s]}
        for s in full or todo:
            target[s] = most * sizes[s] if full else level * weight[s]
        left -= sum(target[s] for s in full)
        todo -= full or todo
    return target


def test_mix_meets_targets(documents, nothing):
    rows = mixing.mix(documents).collect()
    assert len(rows) == documents.count()
    sizes = defaultdict(int)
    for d in documents.collect():
        sizes[d.source] += len(words(d.text))
    target = water_fill(sizes)
    by_target = defaultdict(int)
    for r in rows:
        assert r.taken <= 2 * r.size
        by_target[round(r.target, 6)] += r.taken
    assert {round(t, 6) for t in target.values()} == set(by_target)
    for s, t in target.items():
        same = sum(1 for x in target.values() if round(x, 6) == round(t, 6))
        assert abs(by_target[round(t, 6)] - t * same) <= same
    again = mixing.mix(documents.repartition(2)).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))
    assert mixing.mix(nothing).count() == 0


def test_take_repeats_documents(stored):
    expected = Counter()
    for r in mixing.mix(stored).collect():
        expected[r.doc_id] += r.taken
    got = Counter()
    taken = mixing.take(stored)
    assert taken.dtypes == stored.dtypes
    for r in taken.collect():
        got[r.doc_id] += len(words(r.text))
    ids = [i for i in expected if i not in (3, None)]
    assert {i: got[i] for i in ids} == {i: expected[i] for i in ids}


# Packing


def test_pack_places_every_token_once(documents, nothing):
    rows = packing.pack(documents, PATH, with_ids=True).collect()
    coder = Tokenizer.from_file(PATH)
    texts = defaultdict(list)
    for d in documents.collect():
        texts[d.doc_id].append(d.text or "")
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    assert set(pieces) == set(texts)
    for key, found in texts.items():
        want = Counter(tuple(coder.encode(t, add_special_tokens=False).ids + [2]) for t in found)
        if len(want) == 1 and sum(want.values()) == 1:
            parts = sorted(pieces[key], key=lambda r: r.start)
            assert [i for p in parts for i in p.ids] == list(next(iter(want)))
            assert [p.start for p in parts] == list(np.cumsum([0] + [p.length for p in parts[:-1]]))
        assert sum(p.length for p in pieces[key]) == sum(len(k) * n for k, n in want.items())
    for found in sequences.values():
        end = 0
        for offset, length in sorted(found):
            assert offset == end
            end += length
        assert end == 4096 or end & (end - 1) == 0
    assert packing.pack(nothing, PATH).count() == 0


@pytest.mark.parametrize("lengths,room", [({5: 3, 7: 2, 11: 1}, 26), ({2: 9}, 7), ({4: 1, 9: 1}, 3), ({3: 4, 8: 3, 13: 2}, 40)])
def test_best_fill_is_best(lengths, room):
    chosen = packing.best_fill(sorted(lengths.items(), reverse=True), room)
    assert all(chosen[k] <= lengths[k] for k in chosen)
    sums = {0}
    for k, n in lengths.items():
        sums = {s + k * c for s in sums for c in range(n + 1)}
    assert sum(k * n for k, n in chosen.items()) == max(s for s in sums if s <= room)


# Repeated strings


def test_suffix_dedup_against_all_substrings(stored, nothing, monkeypatch):
    def check(rows):
        counts = Counter()
        table = stored.collect()
        for d in table:
            raw = (d.text or "").encode()
            counts.update(raw[p : p + 400] for p in range(len(raw) - 399))
        want = Counter()
        for d in table:
            raw = (d.text or "").encode()
            gone = bytearray(len(raw))
            for p in range(len(raw) - 399):
                if counts[raw[p : p + 400]] > 1:
                    gone[p : p + 400] = b"\1" * 400
            spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
            kept = hashlib.sha256(bytes(b for b, g in zip(raw, gone) if not g)).hexdigest()
            want[d.doc_id, len(raw), sum(gone), spans, kept] += 1
        assert Counter(map(tuple, rows)) == want
        assert sum(k[2] for k in want) > 3000

    check(suffix_dedup.remove_repeats(stored).collect())
    # Every anchor over many shards: strings meet as digests only.
    monkeypatch.setattr(suffix_dedup, "MOST_KINDS", 1)
    check(suffix_dedup.remove_repeats(stored).collect())
    assert suffix_dedup.remove_repeats(nothing).count() == 0


def test_suffix_order_and_prefixes():
    rng = np.random.default_rng(5)
    for _ in range(15):
        pieces = [bytes(rng.choice([97, 98], size=rng.integers(1, 50)).astype("u1")) for _ in range(8)] + [b"a" * 40] * 2
        data = np.frombuffer(b"".join(pieces), np.uint8)
        sizes = np.array(list(map(len, pieces)))
        ends, piece = np.repeat(np.cumsum(sizes), sizes), np.repeat(np.arange(len(pieces)), sizes)
        order = suffix_dedup.suffix_order(data, ends, piece)
        raw = data.tobytes()
        assert list(order) == sorted(range(len(raw)), key=lambda p: (*(x + 1000 for x in raw[p : ends[p]]), piece[p]))
        prefix = suffix_dedup.common_prefixes(data, ends, order)
        for p, q in zip(order, order[1:]):
            a, b = raw[p : ends[p]], raw[q : ends[q]]
            n = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
            assert prefix[q] == n


# Near duplicates


def classes(table):
    sets, owners = {}, defaultdict(list)
    for d in table:
        w = words(d.text)
        if w:
            owners[d.text].append(d.doc_id)
            sets[d.text] = Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))
    parent = {t: t for t in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    keys = list(sets)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            shared, union = sum((sets[a] & sets[b]).values()), sum((sets[a] | sets[b]).values())
            if shared >= 0.8 * union:
                parent[find(a)] = find(b)
    least = {}
    for t in sets:
        known = [i for i in owners[t] if i is not None]
        least[find(t)] = min([*known, least.get(find(t), 10**9)])
    return {t: least[find(t)] for t in sets}


def test_near_duplicates_against_all_pairs(documents, nothing):
    table = documents.collect()
    want = classes(table)
    expected = Counter((d.doc_id, want.get(d.text, d.doc_id)) for d in table)
    rows = bagminhash.near_duplicates(documents).collect()
    assert Counter((r.doc_id, r.class_id) for r in rows) == expected
    assert all(r.kept == (r.doc_id == r.class_id) for r in rows)
    assert bagminhash.near_duplicates(nothing).count() == 0


def test_keep_one(stored):
    kept = bagminhash.keep_one(stored)
    assert kept.dtypes == stored.dtypes
    table = stored.collect()
    want = classes(table)
    found = [r.doc_id for r in kept.collect() if words(r.text)]
    assert sorted(found) == sorted(set(want.values()))


def test_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(1)
    values = np.sort(rng.integers(0, 2**63, 60).astype(np.uint64))
    a = np.sort(np.repeat(values, rng.integers(1, 9, 60)))
    b = np.sort(np.repeat(values, rng.integers(1, 9, 60)))
    true = bagminhash.similarity(a, b)
    x, y = (bagminhash.signatures([m], 4096)[0] for m in (a, b))
    assert abs((x == y).mean() - true) < 5 * (true * (1 - true) / 4096) ** 0.5
    together = bagminhash.signatures([a, b, a[:1], np.zeros(0, np.uint64)], 128)
    assert (together[0] == bagminhash.signatures([a], 128)[0]).all()
    assert (together[2] == bagminhash.signatures([a[:1]], 128)[0]).all()


# Lines


@pytest.mark.parametrize("several_texts", [False, True])
def test_lines_of_many_sites_go(documents, nothing, several_texts):
    rows = line_dedup.clean(documents, several_texts=several_texts).collect()
    sites, texts = defaultdict(set), defaultdict(set)
    for d in documents.collect():
        for line in (d.text or "").split("\n"):
            sites[line.strip(" \t\n\x0b\x0c\r")].add("" if d.source is None else "s" + d.source)
            texts[line.strip(" \t\n\x0b\x0c\r")].add(d.text)
    boilerplate = {x for x in sites if x and len(sites[x]) >= 5 and len(texts[x]) > several_texts}
    for r in rows:
        lines = (r.row.text or "").split("\n")
        bad = [x for x in lines if x.strip(" \t\n\x0b\x0c\r") in boilerplate]
        assert r.n_removed == len(bad)
        assert r.cleaned == (r.row.text if not bad else "\n".join(x for x in lines if x not in bad))
    # The shared line, the passage, and without several texts the four lines of a text copied to six sites.
    assert sum(r.n_removed for r in rows) == 12 + 6 + (0 if several_texts else 6 * 4)
    cleaned = line_dedup.remove_boilerplate(documents)
    assert cleaned.dtypes == documents.dtypes and cleaned.count() == documents.count()
    assert line_dedup.clean(nothing).count() == 0


def test_a_site_of_any_copy_counts(spark, nothing):
    """Copies on sites that sort late are sites as well; null is one site."""
    rows = [("a line\nalone a", s) for s in ("m", "n", None)] + [("a line\nalone b", s) for s in ("m", "z", "y", "n")]
    docs = spark.createDataFrame([(i, t, "en", s, 1, *("x",) * 9) for i, (t, s) in enumerate(rows)], nothing.schema)
    assert {r.n_removed for r in line_dedup.clean(docs, min_sites=5).collect()} == {1}
    assert {r.n_removed for r in line_dedup.clean(docs, min_sites=6).collect()} == {0}


# Quality without labels and toxicity


def test_quality_model_tells_junk(spark, documents, nothing):
    rows = quality_model.score_quality(documents).collect()
    assert len(rows) == documents.count()
    by_id = {r.doc_id: r for r in rows}
    assert by_id[20].kept and by_id[20].label > 0.5
    assert all(0 <= r.score <= 1 for r in rows)
    posterior, rates = quality_model.em(np.array([0b1010101010101010, 0b1010101010101001]), np.array([90.0, 10.0]))
    assert posterior[0] > 0.5 > posterior[1]
    assert quality_model.score_quality(nothing).count() == 0


@pytest.mark.parametrize("line", ["他们说了很多话。", "行きますか？", "यह एक वाक्य है।", "هل هذا صحيح؟", "「そうです」", "یہ ایک جملہ ہے۔"])
def test_sentences_of_other_scripts_end(line):
    assert quality_model.shares(line, line.encode().split())[7] == 0.0


def test_automata_find_misspellings():
    lexicon = toxicity.Lexicon(["idiot", "pathetic", "disgusting", "bad"], ["scum"], frozenset(["idiom"]))
    for word, term, edits in [
        ("idiot", "idiot", 0), ("id1ot", "idiot", 1), ("idoit", "idiot", 1), ("idiiot", "idiot", 1), ("idot", "idiot", 1),
        ("disgussting", "disgusting", 1), ("dsigustin", "disgusting", 2), ("scumbag", "scum", 0), ("bad", "bad", 0),
    ]:
        number, found = lexicon.find(word)
        assert (lexicon.terms[number], found) == (term, edits), word
    for word in ("idiom", "bat", "patio", "skum", "", "x" * 50):
        assert lexicon.find(word)[0] == -1, word

    def distance(a, b):
        d = {(i, 0): i for i in range(len(a) + 1)} | {(0, j): j for j in range(len(b) + 1)}
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
                if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                    d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
        return d[len(a), len(b)]

    rng = np.random.default_rng(0)
    terms = ["abcab", "bbaca", "acbacbabc"]
    lexicon = toxicity.Lexicon(terms, [])
    for _ in range(1500):
        word = "".join(rng.choice(list("abc"), rng.integers(3, 11)))
        near = [t for t in terms if distance(word, t) <= toxicity.edits_for(t)]
        number, edits = lexicon.find(word)
        assert (number >= 0) == bool(near)
        assert number < 0 or edits == min(distance(word, t) for t in near)


def test_quotations_are_no_abuse():
    reader = toxicity.Reader(toxicity.Lexicon(["idiot"], []), np.array([3.0]))
    place = dict(zip(toxicity.FEATURES, range(7)))
    assert reader.features("you are an idiot today")[place["hit"]] == 1
    for text in ('they wrote "what an idiot he is" there', "the word idiot is old", "«idiot» is french"):
        got = reader.features(text)
        assert got[place["hit"]] == 0 and got[place["quoted"]] > 0, text
    assert reader.features('an "open mark and then an idiot')[place["hit"]] == 1
    assert reader.features("") == [0.0] * 7


def test_toxicity_learns(spark, nothing):
    rng = np.random.default_rng(2)
    plain = [f"w{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(400):
        text = list(rng.choice(plain, 40))
        if i % 4 == 0:
            for k in rng.integers(0, 40, 3):
                text[k] = str(rng.choice(["blockhead", "nincompoop"]))
        rows.append((i, " ".join(text)))
        labels.append((i, int(i % 4 == 0)))
    rows += [(1000, "w1 w2 w3 blokhead w4 w5 nincompop w7 w8"), (1001, None), (None, "w1"), (1001, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    known = spark.createDataFrame(labels + [(None, 1), (5000, None)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.score_toxicity(docs, known).collect()}
    assert all(got[i].predicted == y for i, y in labels)
    assert got[1000].predicted == 1 and got[1001].predicted == 0
    assert got[7].held_out == (zlib.crc32(b"7") % 5 == 0)
    none = toxicity.score_toxicity(docs, known.limit(0)).collect()
    assert len(none) == len(rows) and all(r.predicted == 0 for r in none)
    assert toxicity.score_toxicity(nothing, known).count() == 0


def test_misspellings_count_among_many_near_words(spark):
    rng = np.random.default_rng(8)
    plain = [f"w{i}" for i in range(300)] + ["lover", "lower", "laser", "poser", "loses", "scam", "slum", "scud"] * 8
    rows, labels = [], []
    for i in range(400):
        text = list(rng.choice(plain, 40))
        if i % 4 == 0:
            for k in rng.integers(0, 40, 3):
                text[k] = str(rng.choice(["loser", "scum"]))
        rows.append((i, " ".join(text)))
        labels.append((i, int(i % 4 == 0)))
    rows += [(1000, "w1 w2 w3 l0ser w4 w5 sc0m w7 w8"), (1001, "w1 lover w3 lower w4 scam w5 slum w7")]
    known = spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.score_toxicity(spark.createDataFrame(rows, "doc_id long, text string"), known).collect()}
    assert all(got[i].predicted == y for i, y in labels)
    assert got[1000].predicted == 1 and got[1001].predicted == 0


def test_lexicon_has_all_terms(spark):
    rng = np.random.default_rng(9)
    terms = [f"{chr(97 + i % 26)}{i}" for i in range(6000)]
    rows = [(" ".join(rng.permutation(terms)), 1) for _ in range(6)] + [(f"plain{i % 7}", 0) for i in range(100)]
    words, _, weights = toxicity.learn_lexicon(spark.createDataFrame(rows, "text string, toxic int"))
    assert words == sorted(terms) and weights.keys() >= set(terms)


def test_suffixes_shorter_than_a_key_are_ordered():
    """Eight bytes are read at once from every place, also where fewer are left of a string."""
    pieces = [b"a", b"ab\x00", b"aaaaaaa", b"aaaaaaaa", b"", b"ab", b"\xff" * 9, b"ab\x00"]
    sizes = np.array([len(p) for p in pieces])
    stops = np.cumsum(sizes)
    ends, piece = np.repeat(stops, sizes), np.repeat(np.arange(len(pieces)), sizes)
    data = b"".join(pieces)
    order = suffix_dedup.suffix_order(np.frombuffer(data, np.uint8), ends, piece)
    want = sorted(range(len(data)), key=lambda i: ([b + 1 for b in data[i : ends[i]]], piece[i]))
    assert order.tolist() == want


def test_equal_surroundings_stand_in_the_array_once(monkeypatch):
    """A kind that occurs often is repeated as a whole; the array needs it once, for other kinds."""
    rng = np.random.default_rng(8)
    often, alone = (bytes(rng.integers(0, 256, 450).astype("u1")) for _ in range(2))
    pieces = [often, b"x" * 7 + often[:420] + b"y" * 3, alone, alone[:399] + b"z"]
    kinds = {"anchor": [1, 1, 2, 2], "around": [1, 2, 3, 4], "count": [51, 31, 51, 1], "copies": [3, 1, 1, 1]}
    table = pa.table({**kinds, "parts": [1] * 4, "bytes": pieces})
    sorted_bytes = []
    order = suffix_dedup.suffix_order
    monkeypatch.setattr(suffix_dedup, "suffix_order", lambda data, *a: sorted_bytes.append(len(data)) or order(data, *a))
    found = suffix_dedup.shard_repeats(table).to_pylist()
    assert sorted((r["around"], r["low"], r["high"]) for r in found) == [(1, 0, 51), (2, 7, 28)]
    assert sorted_bytes == [sum(map(len, pieces))]


def test_suffix_order_of_a_large_shard():
    """Keys of over 2 MiB do not fit one number with their places."""
    rng = np.random.default_rng(9)
    part = rng.integers(97, 100, 400_000).astype("u1")
    data = np.concatenate([part, rng.integers(97, 100, 1_400_000).astype("u1"), part, part[:300_000]])
    sizes = np.array([1_000_000, 800_000, 700_000])
    ends, piece = np.repeat(np.cumsum(sizes), sizes), np.repeat(np.arange(3), sizes)
    order = suffix_dedup.suffix_order(data, ends, piece)
    assert np.array_equal(np.sort(order), np.arange(len(data)))
    raw = data.tobytes()
    for at in rng.integers(1, len(data), 2000):
        p, q = order[at - 1], order[at]
        assert (raw[p : ends[p]], piece[p]) < (raw[q : ends[q]], piece[q])
