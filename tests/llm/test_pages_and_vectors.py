"""HTML extraction and vector near duplicates."""

import contextlib
import os
import threading
from urllib.parse import urlparse

import numpy as np
import pytest

from trackline.llm import html_text, vector_dedup
from trackline.llm.common import components
from trackline.session import shared_dir

BODY = "<p>First   para of {0}, with <b>bold</b>&amp;more text.<br>And on.</p><p>Second para of {0}, which is a bit longer.</p>"
TEXT = "First para of {0}, with bold&more text. And on.\n\nSecond para of {0}, which is a bit longer."


def page(main, extra=""):
    return (
        "<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a='<p>no</p>';</script></head>"
        "<body class='has-sidebar'><nav><ul><li><a href='/'>Home</a></ul></nav><header><h1>Site</h1></header>"
        "<div class='cookie-notice'>We use cookies to make this site a better place.</div>"
        f"<div class='wrap'>{main}<div class='sidebar'><p>Other long words that are no part of it, and more of them.</p></div></div>"
        f"{extra}<form><p>Name and some words here.</p></form><footer>&copy; us</footer></body></html>"
    )


def test_extract(spark):
    comments = "<section id='comments'><article class='comment'><p>A reader says much, at length, and again and again and again.</p></article></section>"
    rows = [(i, "https://a.example/x", page(f"<div class='post-{i}'>{BODY.format(i)}</div>", comments)) for i in range(5)]
    # One page whose text lies mostly in an inner part: its host knows better.
    inner = "<div class='post-9'><p>Short lead of the page.</p><div><p>" + "Long inner part of the text, on and on. " * 20 + "</p></div></div>"
    rows.append((9, "https://a.example/y", page(inner)))
    rows += [(20, None, None), (21, "https://b.example/", ""), (22, "https://b.example/", "<p>cut off &am"), (22, "https://b.example/", "<p>cut off &am")]
    rows += [(None, "nonsense", "<div><<p>a &lt; b</p></div></section>"), (23, "https://b.example/", "<div>" * 3000 + "<p>deep</p>")]
    schema = "page_id long, url string, html string, path string, text string, host string, number string"
    pages = spark.createDataFrame([(*r, "x", "y", "z", "0") for r in rows], schema)
    got = html_text.extract(pages).collect()
    assert len(got) == len(rows) and got[0].asDict().keys() == {"page_id", "url", "text", "n_chars", "path"}
    by_id = {r.page_id: r for r in got}
    for i in range(5):
        assert by_id[i].text == TEXT.format(i)
        assert by_id[i].path == "html>body.has-sidebar>div.wrap>div.post-0"
    assert by_id[9].text.startswith("Short lead of the page.\n\nLong inner")
    assert by_id[20].text == by_id[21].text == "" and by_id[22].text == "cut off &am"
    assert by_id[None].text == "<\n\na < b" or by_id[None].text.endswith("a < b")
    assert by_id[23].text == "deep"
    assert all(r.n_chars == len(r.text) for r in got)
    assert html_text.extract(pages.limit(0)).count() == 0


def test_extract_keeps_what_stands_beside_the_largest_part(spark):
    long = "<p>" + "The long part goes on and on. " * 20 + "</p>"
    mains = {
        "lead": f"<article><h1>Title {{0}}</h1><p>lead {{0}}</p><div class=entry>{long}</div></article>",
        "two": f"<article><section>{long * 4}</section><section><h2>Title {{0}}</h2><p>lead {{0}}</p></section></article>",
        "list": f"<div class=post><h1><a href=x>Title {{0}}</a></h1><p>lead {{0}}</p><ul><li>{'Long item of words, on and on. ' * 20}</li></ul></div>",
        "table": f"<div class=post><h1>Title {{0}}</h1><p>lead {{0}}</p><table><tr><td>{'Long cell of words, on and on. ' * 20}</td></tr></table></div>",
    }
    # All pages of a host are built alike; one host has a single page.
    rows = [(f"{k}{i}", f"http://{k}.example/{i}", page(m.format(i))) for k, m in mains.items() for i in range(1 if k == "list" else 3)]
    got = html_text.extract(spark.createDataFrame(rows, "page_id string, url string, html string")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert f"Title {r.page_id[-1]}" in r.text and f"lead {r.page_id[-1]}" in r.text and "on and on." in r.text, r
        assert "Other long words" not in r.text and "cookies" not in r.text


@pytest.mark.parametrize(
    "source,text",
    [
        ("<body><form id='aspnetForm'><div><h1>T</h1><p>Body text here.</p></div></form></body>", "T\n\nBody text here."),
        ('<div id="page" class="sidebar-right"><p>Text.</p></div>', "Text."),
        ('<div class="ad-free-layout"><p>Text.</p></div>', "Text."),
        ('<article class="post-search-engine"><p>Text.</p></article>', "Text."),
        ('<main><h1>A</h1><div class="social-science"><p>Essay.</p></div></main>', "A\n\nEssay."),
        ("<article><p>Prose.</p><section id='reply-to-critics'><p>More.</p></section></article>", "Prose.\n\nMore."),
        ('<p>One <strong class="alert">two</strong> three.</p>', "One two three."),
        ('<article><p>Prose.</p><div><span class="share">Share</span></div></article>', "Prose."),
        ('<p>One <span style="display: none">two</span> three.</p>', "One three."),
        ("<article><p>Short.</p></article><div class='comments'><p>" + "A reader. " * 90 + "</p></div>", "Short."),
        ("<article><p>Short.</p></article><div class='site-footer-inner'><p>Us.</p></div>", "Short."),
        ("<div class=t><h1>Title</h1></div><div class=x><p>" + "On and on. " * 9 + "</p></div>", "Title\n\n" + ("On and on. " * 9).strip()),
        ("<article><p>" + "On and on. " * 50 + "</p></article><div><p>Most read today</p></div>", ("On and on. " * 50).strip()),
    ],
)
def test_names_and_wrappers(source, text):
    found = html_text.parse(source)
    best = max(html_text.candidates(found), key=lambda c: c[1])[0]
    assert html_text.text_of(found, best) == text


def test_host_votes_change_a_text(spark):
    """A page whose box is longer than its article is read as the other pages of its host are."""
    def built(article, box):
        return f"<body><div class='post'><p>{article}</p></div><div class='box'><p>{box}</p></div></body>"

    rows = [(i, "https://h.example/", built("Article of its own, told at length. " * 30 + str(i), "Most read.")) for i in range(6)]
    odd = built("A short article of fifty words or so. " * 6, "Stories that others read, one after the other. " * 3)
    rows += [(7, "https://h.example/odd", odd), (8, "https://other.example/odd", odd)]
    found = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert "Stories" not in found[7] and found[7].startswith("A short article")
    assert "Stories" in found[8] and found[8].startswith("A short article")
    assert all("Most read" not in found[i] for i in range(6))


def test_linked_blocks_of_an_article_stay():
    linked = "<a href=x>{}</a>"
    main = (
        f"<article><p>Some prose of the article, in one sentence.</p><table><tr><td>{linked.format('Cell name')}</td></tr></table>"
        f"<dl><dt>{linked.format('Term')}</dt></dl><figure><figcaption>{linked.format('Caption')}</figcaption></figure>"
        f"<blockquote>{linked.format('Quoted')}</blockquote><div>{linked.format('Boxed')}</div><ul><li>{linked.format('Source one')}</li></ul></article>"
    )
    found = html_text.parse(page(main))
    text = html_text.text_of(found, html_text.candidates(found)[0][0])
    assert text.split("\n\n") == ["Some prose of the article, in one sentence.", "Cell name", "Term", "Caption", "Quoted", "Boxed", "Source one"]
    assert html_text.candidates(html_text.parse("<ul><li><a href=x>Only a menu</a></li></ul>")) == []


@pytest.mark.parametrize("source", ["", "<", "<p", "a<b", "<div", "</p></div>", "<script>x", "<!--", "<a href='", "&#x110000; &#0;", "<p/>x<br/>y"])
def test_parse_never_fails(source):
    found = html_text.parse(source)
    for path, _ in html_text.candidates(found):
        html_text.text_of(found, path)


def brute(rows, cosine=0.95):
    fine = [
        (k, np.array(v, dtype=float))
        for k, v in rows
        if v and all(x is not None and np.isfinite(x) for x in v) and any(v)
    ]
    size = max(len(v) for _, v in fine)
    x = np.array([np.pad(v, (0, size - len(v))) for _, v in fine])
    x /= np.abs(x).max(axis=1)[:, None]
    x /= np.linalg.norm(x, axis=1)[:, None]
    near = x @ x.T >= cosine
    np.fill_diagonal(near, False)
    label = np.arange(len(fine))
    for _ in range(len(fine)):
        label = np.array([min(label[i], *label[near[i]]) if near[i].any() else label[i] for i in range(len(fine))])
    keys = [k for k, _ in fine]
    least = {c: min((k for k, l in zip(keys, label) if l == c and k is not None), default=None) for c in label}
    linked = {i: (int(near[i].sum()), least[label[i]]) for i in range(len(fine))}
    out, at = [], 0
    for k, v in rows:
        if at < len(fine) and fine[at][0] == k and v and len(v) == len(fine[at][1]) and np.array_equal(np.array(v, dtype=float), fine[at][1]):
            out.append((k, *linked[at]))
            at += 1
        else:
            out.append((k, 0, k))
    return out


def test_vectors_against_all_pairs(spark, monkeypatch):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(60, 6))
    rows = [(int(i), [float(x) for x in v]) for i, v in enumerate(base)]
    for i in range(60, 220):
        v = base[i % 25] + rng.normal(size=6) * rng.choice([0.02, 0.1, 0.3])
        rows.append((i, [float(x) for x in v]))
    rows += [(300, rows[0][1]), (300, rows[0][1]), (301, [2 * x for x in rows[1][1]]), (302, None), (303, []), (304, [0.0] * 6)]
    rows += [(305, [float("nan")] * 6), (306, [None, 1.0, 0.0, 0.0, 0.0, 0.0]), (307, [float("inf")] * 6), (308, rows[2][1][:4]), (None, rows[5][1])]
    rows += [(309, [1e200] * 6), (310, [1e-200] * 6)]
    schema = "vec_id long, embedding array<double>, label int, node string, cell string"
    vectors = spark.createDataFrame([(k, v, 1, "x", "y") for k, v in rows], schema)
    want = sorted(map(str, brute(rows)))
    for cell, block in ((500, 1024), (20, 7)):
        monkeypatch.setattr(vector_dedup, "CELL", cell)
        monkeypatch.setattr(vector_dedup, "BLOCK", block)
        got = vector_dedup.near_vectors(vectors).collect()
        assert sorted(str((r.vec_id, r.n_links, r.component_id)) for r in got) == want
        assert all(r.kept == (r.vec_id == r.component_id) for r in got)
    assert vector_dedup.near_vectors(vectors.limit(0)).count() == 0


def test_cells_of_one_direction_are_visited():
    got = vector_dedup.reach_of(np.array([1.0000000000000002, 1.0, 2.0, 0.5]), np.array([1, 2, 0, 3]), 0.3)
    assert got[0] == got[1] == pytest.approx(0.3) and got[2] == -1 and got[3] == pytest.approx(np.arccos(0.5) + 0.3)


def test_links_across_cells_of_one_direction(spark, monkeypatch):
    rng = np.random.default_rng(11)
    rows = []
    for g in range(40):  # two directions close to each other, each the centre of its own cell
        base = rng.normal(size=16)
        rows += [(2 * g, [float(x) for x in base]), (2 * g + 1, [float(x) for x in base + rng.normal(size=16) * 0.02])]
    monkeypatch.setattr(vector_dedup, "CELL", 1)
    got = vector_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted(str((r.vec_id, r.n_links, r.component_id)) for r in got) == sorted(map(str, brute(rows)))


class Disk:
    """The most bytes in Spark's local folders and in the shared one while a block runs, beyond those at its start."""

    def __init__(self, spark):
        local = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
        self.tops = [*(d.getAbsolutePath() for d in local), urlparse(shared_dir(spark)).path]
        self.most, self.over = 0, threading.Event()

    def used(self):
        found = 0
        for path in (f"{d}/{f}" for top in self.tops for d, _, names in os.walk(top) for f in names):
            with contextlib.suppress(OSError):  # files go meanwhile
                found += os.lstat(path).st_size
        return found

    def watch(self):
        while not self.over.wait(0.02):
            self.most = max(self.most, self.used() - self.start)

    def __enter__(self):
        self.start, self.thread = self.used(), threading.Thread(target=self.watch)
        self.thread.start()
        return self

    def __exit__(self, *_):
        self.over.set()
        self.thread.join()


def test_vectors_without_clusters_are_not_copied(spark, monkeypatch):
    rng = np.random.default_rng(17)
    base = rng.normal(size=(4000, 64)).astype(np.float32)
    base[3000:3300] = base[:300] + rng.normal(size=(300, 64)).astype(np.float32) * 0.05
    base[3300:3330] = base[0] + rng.normal(size=(30, 64)).astype(np.float32) * 0.02
    vectors = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(base)], "vec_id long, embedding array<float>")
    monkeypatch.setattr(vector_dedup, "CELL", 100)
    monkeypatch.setattr(vector_dedup, "BLOCK", 16)
    monkeypatch.setattr(vector_dedup, "SENT", 700 * 256, raising=False)  # six portions, and parts of cells
    with Disk(spark) as disk:
        got = vector_dedup.near_vectors(vectors).collect()
    assert disk.most < 8 * base.nbytes, disk.most / base.nbytes
    unit = base.astype(float) / np.linalg.norm(base.astype(float), axis=1)[:, None]
    near = unit @ unit.T >= 0.95
    assert near.sum() > 5000 and {r.vec_id: r.n_links for r in got} == dict(enumerate((near.sum(axis=1) - 1).tolist()))
    label = np.arange(len(base))
    for _ in range(6):
        label = np.array([label[row].min() for row in near])
    assert {r.vec_id: r.component_id for r in got} == dict(enumerate(label.tolist()))


@pytest.mark.parametrize("size", [3, 40])
def test_sketches_never_fall_below_the_cosine(size):
    rng = np.random.default_rng(5)
    rows = vector_dedup.unit(rng.normal(size=(900, size)) * np.linspace(2, 0.1, size))
    basis = vector_dedup.basis_of(rows, 0.95)
    short = vector_dedup.sketch(rows, basis)
    assert (short @ short.T >= rows @ rows.T - vector_dedup.ROUNDING).all()
    assert basis.shape[1] <= size and (size == 3 or basis.shape[1] < size)


def test_links_of_blocks_are_all_found(monkeypatch):
    rng = np.random.default_rng(8)
    raw = rng.normal(size=(900, 8))
    raw[400:] = raw[:500] + rng.normal(size=(500, 8)) * rng.choice([0.05, 0.2, 0.4], (500, 1))
    rows = vector_dedup.unit(raw)
    centres, basis = vector_dedup.centres_of(rows, 60), vector_dedup.basis_of(rows, 0.9)
    cell, own = vector_dedup.nearest(rows, centres)
    for block in (7, 1024):
        monkeypatch.setattr(vector_dedup, "BLOCK", block)
        side = vector_dedup.Side(cell, np.arange(900), np.ones(900, dtype=int), own, raw, basis, np.arccos(0.9))
        pairs = {(side.node[a], side.node[b]) for x, y in vector_dedup.linked(side, side, centres, 0.9) for a, b in zip(x, y, strict=True)}
        want = {(a, b) for a, b in np.argwhere(rows @ rows.T >= 0.9).tolist() if cell[b] <= cell[a]}
        assert pairs == want and len({(cell[a], cell[b]) for a, b in want if cell[a] != cell[b]}) > 30


def test_components(spark):
    rng = np.random.default_rng(6)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 90, (60, 2))] + [(i, i + 1) for i in range(200, 260)] + [(5, 5)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        if a != b:
            parent[max(find(a), find(b))] = min(find(a), find(b))
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()}
    assert got == {x: find(x) for x in parent}
