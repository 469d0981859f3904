"""Main text of web pages by paths that the pages of a host agree on."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Elements that can hold an article.
CONTAINERS = frozenset("html body main article section div center td table tbody tr ul ol dl figure blockquote details".split())
#: Elements that begin a block of text of their own.
BLOCKS = frozenset(
    "p h1 h2 h3 h4 h5 h6 pre li dt dd th caption figcaption address summary hr hgroup thead tfoot".split()
)
#: Elements that are never part of an article.
OUTSIDE = frozenset(
    "head nav header footer aside noscript template svg math object video audio canvas select button "
    "fieldset menu dialog map datalist".split()
)
#: Elements that surround articles unless they hold the page.
SOFT = frozenset(["form"])
#: Elements whose content is no markup; it is skipped up to their end tag.
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
#: Blocks that a new block of the same family closes.
CLOSES = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"),
    "td": ("td", "th"), "th": ("td", "th"), "tbody": ("thead", "tbody", "tfoot"),
}
#: A close tag or an implied end does not reach beyond these.
FENCES = frozenset("html body table td th ul ol dl div section article main aside nav header footer form blockquote figure".split())
#: Parts of class names and ids of what surrounds articles.
MARKERS = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs masthead footer sidebar aside widget widgets ad ads adv advert "
    "advertisement adsense banner promo promotion sponsor sponsored cookie cookies consent gdpr notice notices alert "
    "popup modal overlay newsletter subscribe subscription signup share sharing social related recommended "
    "recommendations comment comments commentlist respond reply replies responses disqus discussion form search login "
    "pagination pager toolbar skip topbar header".split()
)
#: Parts that may follow a marker in a name; after any other word the marker says what a text is about.
ENDINGS = frozenset(
    "left right top bottom middle main primary secondary first second box bar block list lists wrapper wrap container "
    "area section content contents inner outer item items link links button buttons icon icons panel unit slot title "
    "heading label text body row column col group holder zone region module posts post articles stories news topics "
    "thread author meta count desktop mobile fixed sticky small large tabs tab".split()
)
#: Markers of what readers write; an element that has one is never the page itself.
READERS = ("comment", "repl", "respond", "disqus", "discussion", "talkback")
#: A marked element that holds this share of the prose of a page surrounds the page, not something beside it.
WHOLE = 0.9
#: Beginnings of such parts, whatever follows.
STARTS = ("comment", "advert", "sidebar", "breadcrumb", "newsletter", "cookie", "navbar", "talkback", "adbox", "adslot", "adunit")
#: How much likelier an element of these kinds holds the article.
LIKELY = {"article": 1.1, "main": 1.05}
#: How likely a container is whose prose lies in several others, against one whose prose does not.
SPREAD = 0.9
#: Of containers with the same text the innermost counts a little more.
DEEPER = 0.0005
#: Containers of a lower score are not proposed.
LEAST_SCORE = 0.5
TITLES = frozenset("h1 h2".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Roles of the same.
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
#: Before these words a marker says something about the page, not about the element.
QUALIFIERS = frozenset("has with without no is".split())

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(>|\Z)", re.S)
ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'=<>`]+)))?""")
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


@dataclass
class Page:
    """Containers (parent, label, mark) and the blocks (container, element, text, characters in links) of a page.

    A mark is 0, 1 for a container that surrounds articles by its name, and 2 for one of readers' texts.
    """

    parents: list[int] = field(default_factory=lambda: [-1])
    labels: list[str] = field(default_factory=lambda: [""])
    marks: list[int] = field(default_factory=lambda: [0])
    blocks: list[tuple[int, str, str, int]] = field(default_factory=list)

    def path(self, at: int) -> str:
        steps = []
        while at > 0:
            steps.append(self.labels[at])
            at = self.parents[at]
        return ">".join(reversed(steps))


def attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(text)}


def parts(name: str) -> list[str]:
    return [p.lower() for p in PART.findall(name)]


def is_outside(tag: str, given: dict[str, str], in_article: bool) -> bool:
    """Whether an element is never part of an article, by its tag or role, or is not shown."""
    if tag in ("html", "body", "main"):
        return False
    if tag in OUTSIDE and not (tag == "header" and in_article):
        return True
    if given.get("role", "").lower() in ROLES or "hidden" in given or given.get("aria-hidden", "").lower() == "true":
        return True
    return "display:none" in given.get("style", "").lower().replace(" ", "")


def mark_of(tag: str, given: dict[str, str], in_article: bool) -> int:
    """Whether the names of an element say that it surrounds articles (1) or holds readers' texts (2).

    A marker counts as the end of a name, or before words of place and form: ``site-footer`` and
    ``sidebar-right`` are marked, ``social-science`` is not.
    """
    if tag in ("html", "body", "main"):
        return 0
    found = int(tag in SOFT)
    for name in (*given.get("class", "").split(), given.get("id", "")):
        words = parts(name)
        closed = True
        for at in range(len(words) - 1, -1, -1):
            part = words[at]
            marker = part in MARKERS or part.startswith(STARTS)
            if closed and marker and not (at and words[at - 1] in QUALIFIERS) and not (part == "header" and in_article):
                found = max(found, 2 if part.startswith(READERS) else 1)
            closed = closed and (marker or part in ENDINGS or part.isdigit())
    return found


def label(tag: str, given: dict[str, str]) -> str:
    """Tag and classes of an element; digits are generalised, as they number pages and posts."""
    names = sorted({re.sub(r"\d+", "0", c) for c in given.get("class", "").split()})
    return ".".join([tag, *names])


def parse(source: str) -> Page:
    """Blocks outside menus, adverts and so on. Never fails: broken markup is read as browsers would."""
    page = Page()
    # Open elements: tag, its container, whether it is outside (2: but for headings), whether it
    # lies in an article.
    stack: list[tuple[str, int, int, bool]] = [("", 0, 0, False)]
    words: list[str] = []
    linked, links, plain = 0, 0, False
    element = ""

    def close_block() -> None:
        nonlocal linked, plain
        text = " ".join("".join(words).split())
        if text and plain:  # a block of nothing but marked inline elements is a button or a label
            page.blocks.append((stack[-1][1], element, text, min(linked, len(text))))
        words.clear()
        linked, plain = 0, False

    def pop_to(depth: int) -> None:
        nonlocal element
        close_block()
        del stack[depth:]
        element = stack[-1][0]

    position, size = 0, len(source)
    while position < size:
        bracket = source.find("<", position)
        token = TOKEN.match(source, bracket) if bracket >= 0 else None
        if bracket >= 0 and token is None:  # a bracket that opens nothing is text
            stop = bracket + 1
        else:
            stop = bracket if bracket >= 0 else size
        if stop > position and not stack[-1][2]:
            text = html.unescape(source[position:stop])
            words.append(text)
            plain = plain or not text.isspace()
            if links:
                linked += len(text.strip())
        position = stop
        if token is None:
            continue
        position = token.end()
        tag = (token[2] or "").lower()
        if not tag or not token[4]:  # comments, declarations and tags cut off at the end
            continue
        if tag == "a":
            links = 0 if token[1] else 1
        elif tag in ("br", "wbr"):
            words.append(" ")
        elif tag in RAW:
            if not token[1]:
                end = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(source, position)
                position = source.find(">", end.start()) + 1 if end else size
                position = position or size
        elif tag in CONTAINERS or tag in BLOCKS or tag in OUTSIDE or tag in SOFT:
            if token[1]:
                depth = len(stack) - 1
                while depth > 0 and stack[depth][0] != tag and not (tag in BLOCKS and stack[depth][0] in FENCES):
                    depth -= 1
                if depth > 0 and stack[depth][0] == tag:
                    pop_to(depth)
                else:
                    close_block()
                links = 0
                continue
            if tag == "hr":
                close_block()
                continue
            # A block ends an open paragraph; an item ends the item before it.
            depth = len(stack) - 1
            ends = CLOSES.get(tag, ())
            while depth > 0 and stack[depth][0] not in ("p", "h1", "h2", "h3", "h4", "h5", "h6", *ends):
                if stack[depth][0] in FENCES and stack[depth][0] not in ends:
                    depth = 0
                    break
                depth -= 1
            if depth > 0:
                pop_to(depth)
            close_block()
            given = attributes(token[3]) if token[3] else {}
            _, container, outside, in_article = stack[-1]
            if outside != 1 and is_outside(tag, given, in_article):
                outside = 1
            elif outside == 2 and tag in HEADINGS:
                outside = 0
            elif outside == 0 and tag == "header":  # of an article: its title, not its lines
                outside = 2
            mark = mark_of(tag, given, in_article) if given or tag in SOFT else 0
            if (tag in CONTAINERS or mark) and not outside:
                page.parents.append(container)
                page.labels.append(label(tag, given))
                page.marks.append(mark)
                container = len(page.parents) - 1
            if not token[3].endswith("/") or tag in CONTAINERS or tag in SOFT:
                stack.append((tag, container, outside, in_article or tag in ("article", "main")))
                element = tag
        elif token[3] and not token[1] and "=" in token[3]:
            # An inline element that is hidden is skipped; one that is marked stays if its block has other text.
            given = attributes(token[3])
            hidden = is_outside("", given, stack[-1][3])
            if hidden or mark_of("", given, stack[-1][3]):
                end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(source, position)
                if end:
                    inner = source[position : end.start()]
                    if not hidden and not stack[-1][2] and not holds_blocks(inner):
                        words.append(html.unescape(TOKEN.sub("", inner)))
                    position = end.end()
    close_block()
    return without_marked(page)


def holds_blocks(source: str) -> bool:
    return any(m[2] and (m[2].lower() in CONTAINERS or m[2].lower() in BLOCKS) for m in TOKEN.finditer(source))


def without_marked(page: Page) -> Page:
    """The page without the blocks of marked containers, but for those that hold almost all of it."""
    if not any(page.marks):
        return page
    held = [0] * len(page.parents)
    for block in page.blocks:
        held[block[0]] += 0 if is_linked(block) else len(block[2])
    for at in range(len(page.parents) - 1, 0, -1):
        held[page.parents[at]] += held[at]
    gone = [False] * len(page.parents)
    for at in range(1, len(page.parents)):
        mark = page.marks[at]
        gone[at] = gone[page.parents[at]] or mark == 2 or (mark == 1 and held[at] < WHOLE * held[0])
        if mark == 1 and not held[0]:
            gone[at] = True
    page.blocks = [b for b in page.blocks if not gone[b[0]]]
    return page


def is_linked(block: tuple[int, str, str, int]) -> bool:
    """Blocks of links, as menus have them; paragraphs and headings are none, even if all of their text is a link."""
    _, element, text, linked = block
    return linked * 2 > len(text) and element not in ("p", "pre", *HEADINGS)


def prose_of(page: Page) -> list[int]:
    """Characters of prose of every block; blocks of links count only inside an article or main element."""
    within = [False] * len(page.parents)
    for at in range(1, len(page.parents)):
        within[at] = within[page.parents[at]] or page.labels[at].split(".")[0] in ("article", "main")
    return [len(b[2]) if within[b[0]] or not is_linked(b) else 0 for b in page.blocks]


def candidates(page: Page) -> list[tuple[str, float]]:
    """Paths of containers that may hold the article, with scores from 0 to about 1.

    A score is the share of the prose of the page, times the share of prose in the text of the
    containers, so menus that nobody marked count against them. Containers whose prose lies in
    several others are less likely to be the article than one of those, unless they are an article
    element; article and main elements are likelier than others. Paths that score less than half
    are not proposed. Containers of one path count together.
    """
    prose = prose_of(page)
    whole = sum(prose)
    if not whole or all(b[3] * 2 > len(b[2]) for b in page.blocks):
        return []
    held, size = [0] * len(page.parents), [0] * len(page.parents)
    for block, n in zip(page.blocks, prose):
        held[block[0]] += n
        size[block[0]] += len(block[2])
    # A container around one that is spread is spread as well.
    inner = [0] * len(page.parents)
    spread = [False] * len(page.parents)
    for at in range(len(page.parents) - 1, -1, -1):
        spread[at] = (spread[at] or inner[at] > 1) and page.labels[at].split(".")[0] != "article"
        if at:
            up = page.parents[at]
            held[up] += held[at]
            size[up] += size[at]
            inner[up] += held[at] > 0
            spread[up] |= spread[at]
    paths: dict[str, list] = {}
    for at in range(len(page.parents)):
        if held[at]:
            weight = LIKELY.get(page.labels[at].split(".")[0], 1.0) * (SPREAD if spread[at] else 1.0)
            found = paths.setdefault(page.path(at), [0, 0, weight])
            found[0] += held[at]
            found[1] += size[at]
            found[2] = min(found[2], weight)
    scores = [
        (path, n / whole * n / text * weight * (1 + DEEPER * path.count(">"))) for path, (n, text, weight) in paths.items()
    ]
    return [(path, score) for path, score in scores if score >= LEAST_SCORE]


def text_of(page: Page, path: str | None) -> str:
    """The blocks of all containers with the path, and prose that stands in the containers around them.

    A title or lead beside the container of the text, and headings before it, belong to the article.
    """
    if path is None:
        return ""
    inside = [False] * len(page.parents)
    around = [False] * len(page.parents)
    for at in range(len(page.parents)):
        inside[at] = (at > 0 and inside[page.parents[at]]) or page.path(at) == path
    for at in range(len(page.parents) - 1, 0, -1):
        around[page.parents[at]] |= inside[at] or around[at]
    kept, begun = [], False
    for block in page.blocks:
        container, element, text, _ = block
        begun = begun or inside[container]
        title = not begun and element in TITLES and not is_linked(block)
        if inside[container] or title or (around[container] and not is_linked(block)):
            kept.append(text)
    return "\n\n".join(kept)


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", source: str = "html") -> DataFrame:
    """The main text of every page.

    First every page scores its containers by their share of its prose and how little else they
    hold. Scores are summed per host and generalised path (tags and classes from the root, digits
    levelled), which is a count per key and no group that must fit into one task. Then each page
    takes, among the paths it proposed, the one that its host's pages voted for most (of equals the
    first in code points), and its text is extracted again from all containers with that path, with
    titles and prose that stand around them. So a box beside the article that no name marks goes
    where the host's pages agree on the article.

    Menus, headers, footers, sidebars, notices, adverts, forms and reader comments are left out by
    tag, role, class and id, unless a marked element holds almost all prose of the page; in the
    chosen container nothing else is, also no lists or tables of links. Blocks are joined by two
    line feeds; white space in a block is one space. Returns the key, the url, ``text``,
    ``n_chars`` and ``path``. Null and empty pages, and pages without text of their own, have an
    empty text and a null path. A null url is a host of its own.
    Repeated rows vote each and give a row each. An empty table gives no rows. Other columns are
    not read. ``pages`` is read twice and has to give its rows in the same order, as stored tables do.
    """
    host = F.lower(F.coalesce(F.regexp_extract(F.col(url), r"^[^:/?#]+://(?:[^/?#@]*@)?([^/?#]*)", 1), F.lit("")))
    rows = pages.select(
        F.monotonically_increasing_id().alias("number"),
        host.alias("host"),
        F.col(key).alias("key"),
        F.col(url).alias("url"),
        F.coalesce(F.col(source), F.lit("")).alias("html"),
    )

    def propose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [
                (number, host, path, score)
                for number, host, source in zip(*(batch.column(c).to_pylist() for c in range(3)))
                for path, score in candidates(parse(source))
            ]
            columns = list(zip(*out)) if out else [()] * 4
            kinds = (pa.int64(), pa.string(), pa.string(), pa.float64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, type=k) for c, k in zip(columns, kinds)], names=["number", "host", "path", "score"]
            )

    proposed = rows.select("number", "host", "html").mapInArrow(propose, "number long, host string, path string, score double")
    # Whole millionths, so that the sum does not depend on its order.
    votes = proposed.groupBy("host", "path").agg(F.sum(F.round(F.col("score") * 1_000_000).cast("long")).alias("votes"))
    chosen = (
        proposed.join(votes, ["host", "path"])
        .groupBy("number")
        .agg(F.min(F.struct((-F.col("votes")).alias("against"), "path")).alias("best"))
        .select("number", F.col("best.path").alias("path"))
    )
    joined = rows.join(chosen, "number", "left").select("key", "url", "html", "path")
    schema = T.StructType(
        [
            T.StructField(key, pages.schema[key].dataType),
            T.StructField(url, pages.schema[url].dataType),
            T.StructField("text", T.StringType()),
            T.StructField("n_chars", T.LongType()),
            T.StructField("path", T.StringType()),
        ]
    )

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [
                text_of(parse(source), path) if path is not None else ""
                for source, path in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, type=pa.string()), pa.array(list(map(len, texts)), type=pa.int64()), batch.column(3)],
                names=schema.names,
            )

    return joined.mapInArrow(read, schema)
