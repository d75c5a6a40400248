"""Main text of web pages by the maximum-scoring subsequence.

A page is a sequence of tokens: words, which score positive, and tags, which score negative. The article is
the contiguous run with the largest sum, found by one linear scan. The weights are log-odds learned from
labelled pages: for a word by where it stands (in an element marked as content; outside one, on a page that
has such; on a page without marks; in a link; in a block that reads like a notice; after a heading that opens readers'
comments or links to other pages), for a tag by its name and whether it stands in content. The last two kinds of words have
negative weights, so that the scan ends before an unmarked footer or list of comments. How much tags weigh against words is
learned too: of a few factors the one that gets most of the labelled pages right.

Elements that never belong to an article (scripts, styles, menus, forms, elements that classes, ids or roles
name as adverts, notices, comments and so on) are not searched: each is one strongly negative token, wherever it
stands, and one that lies within the chosen run is left out of the text. A name alone does not remove a page's
article: names of a state (``with-sidebar``, ``share-enabled``) do not count, a content name beside it decides,
and an element that holds the page's content (see ``_wrappers``) is searched like any other.

The text joins the run's blocks in page order by a blank line. Within a block, character references are
decoded, white space becomes one space and inline markup disappears; ``<br>`` is white space.

Defined results: null and empty pages, and pages without words, give the empty text. Of runs with equal sums the first
counts. Repeated rows give equal rows, an empty table none. Only page_id, url and html are read, so further columns may
have any name. Pages of any length are taken whole, in one pass. Unclosed and stray tags are tolerated.
"""

from __future__ import annotations

import html as html_lib
import math
import random
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import pieces, rows

# Names of HTML elements and of usual classes, ids and roles.
NEVER = frozenset("script style nav footer aside form noscript template iframe svg button select textarea object canvas dialog menu head title".split())
RAW = frozenset("script style textarea title noscript iframe template svg".split())
#: Of them those that may close themselves, or be left open without taking the rest of the page along.
FOREIGN = frozenset("svg iframe noscript template".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
NOT_CONTENT = frozenset("ad ads advert adverts advertisement advertising adbox banner promo promotion sponsor sponsored cookie cookies consent gdpr notice alert menu nav navbar navigation topbar toolbar sidebar side rail footer foot comment comments reply replies discussion disqus share sharing social related recommended newsletter subscribe signup popup modal overlay breadcrumb breadcrumbs widget login search pagination pager complementary contentinfo copyright".split())
CONTENT = frozenset("content article post entry story main body text maincontent articlebody postbody".split())

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<[/!?a-zA-Z][^>]*+(?:>|\Z)|([^<]++)|(<)""", re.S)
ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role|itemprop|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
NAMES = re.compile(r"[A-Za-z][a-z]*|[A-Z]+")


#: Names that tell a state or a layout, not what an element is.
STATE = re.compile(r"(?:has|with|without|no|is|show|hide)(?:[-_A-Z].*)|.*[-_](?:enabled|disabled|open|closed|on|off|allowed)", re.S)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

# How blocks of notices begin or end, and headings of what follows an article (fixed values). A sentence of an article may speak of
# cookies or rights; a notice begins so, or is little more than that.
NOTICE = re.compile(r"\s*(?:©|&copy;|\(c\)\s*\d{4}|copyright\s+(?:©|&copy;|\(c\)|\d{4}))|\s*(?:we|this (?:site|website)|our (?:site|website)) uses? cookies\b|(?:\S+\s+){0,8}all rights reserved\W*$|(?:\S+\s+){0,12}accept (?:all )?cookies\W*$", re.I)
COUNTED = re.compile(r"\s*\(?\d+\)?\s+(?:reader |user )?(?:comments?|responses|replies)\s*:?\s*|\s*(?:reader |user )?(?:comments?|responses|replies|discussion)\s*\(\d+\):?\s*|\s*(?:leave|post|add|write) a (?:reply|comment)\b.*", re.I | re.S)
NAMED = re.compile(r"\s*(?:reader |user )?(?:comments?|responses|replies|discussion):?\s*|\s*(?:related|more|recommended|popular|latest|recent) (?:articles?|posts?|stories|news|links|reading|content)\b.*|\s*you (?:may|might) also like\b.*", re.I | re.S)
#: Elements that end what a heading has opened.
HOLDERS = frozenset("div section article main body td aside blockquote dl ul ol li table form fieldset".split())


@lru_cache(maxsize=4096)
def marked(tag: str, attributes: str) -> int:
    """-1: not content, 1: content, 0: neither, -2: a header, which is content only inside of it; -3 and -4: named like
    one that is not content or like a header, unless it holds the page's content."""
    if tag in NEVER:
        return -1
    good = bad = head = False
    for key, *values in ATTRIBUTE.findall(attributes) if attributes else ():
        value = "".join(values)
        if key.lower() == "hidden" or (key.lower() == "aria-hidden" and value.lower() == "true"):
            return -1
        for name in value.split():
            if STATE.fullmatch(name):
                continue
            names = {x.lower() for x in NAMES.findall(name)} | {x.lower() for x in re.split(r"[_-]+", name)}
            if names & NOT_CONTENT:
                bad = True
            elif names & {"header", "masthead"}:
                head = True
            elif names & CONTENT:
                good = True
    if tag == "header":
        return -2
    if good or tag in ("article", "main"):
        return 1
    return 0 if tag in ("html", "body") else -3 if bad else -4 if head else 0


class _Node:
    """A named element: its words outside links and outside named elements in it, those of them in content, its headings and paragraphs, its largest content element."""

    def __init__(self, parent: _Node | None):
        self.parent, self.shown = parent, parent is None
        self.free = self.inside = self.h1 = self.prose = self.largest = 0


def _wrappers(nodes: list[_Node]) -> None:
    """Show the named elements that hold the page's content, from the outside in.

    Such is one with a content element of more words than all content elsewhere on the page, or, on a page without
    words in content elements, one with the only ``<h1>`` and more words than are outside; or,
    where there is no other text at all, the longest one with paragraphs.
    """
    whole = [[n.free, n.h1, n.prose, n.largest] for n in nodes]
    at = {id(n): k for k, n in enumerate(nodes)}
    children: list[list[int]] = [[] for _ in nodes]
    for k in range(len(nodes) - 1, 0, -1):
        up = at[id(nodes[k].parent)]
        children[up].append(k)
        mine, theirs = whole[k], whole[up]
        whole[up] = [mine[0] + theirs[0], mine[1] + theirs[1], mine[2] + theirs[2], max(mine[3], theirs[3])]
    free, inside, h1, level = nodes[0].free, nodes[0].inside, nodes[0].h1, children[0]
    while level:
        found = []
        for k in level:
            words, titles, _, largest = whole[k]
            if largest > inside if largest else titles and not inside and not h1 and words > free:
                found.append(k)
        if not found and not free:
            found = sorted((k for k in level if whole[k][2]), key=lambda k: -whole[k][0])[:1]
        for k in found:
            nodes[k].shown = True
        free, inside, h1 = (x + sum(getattr(nodes[k], name) for k in found) for x, name in ((free, "free"), (inside, "inside"), (h1, "h1")))
        level = [c for k in found for c in children[k]]


@lru_cache(maxsize=64)
def _end(tag: str) -> re.Pattern:
    return re.compile(rf"</{tag}\b[^>]*>", re.I)


def tokens(page: str) -> list[tuple[str, object, str]]:
    """(class, count of words or 1, text) of each token, in order. Text tokens keep their raw text; block
    borders have the text ``\\0`` and white space from ``<br>`` has a space."""
    out: list[list] = []
    stack: list[tuple[str, int, _Node, int]] = []  # open elements: marks, named element around, words before
    node = _Node(None)
    nodes, content_in, total = [node], [], 0
    open_tags: Counter[str] = Counter()
    endless: set[str] = set()  # elements whose end does not come any more
    cut = content = link = 0  # how many of them are not content, content, links

    def leave(mark: int, around: _Node, before: int) -> _Node:
        if mark > 0:
            node.largest = max(node.largest, total - before)
        return around

    at, n = 0, len(page)
    while at < n:
        m = TOKEN.match(page, at)
        at = m.end()
        closing, tag, attributes, text, stray = m.groups()
        if stray:
            text = stray
        if text is not None:
            if not cut:
                words = len(text.split())
                kind = "word:in" if content else "word:link" if link else "word:out"
                out.append([kind if words else "space", words, text, node, False])
                if kind != "word:link":
                    total += words
                    node.free += words
                    node.inside += words if content else 0
            continue
        if tag is None:
            continue
        tag = tag.lower()
        if closing:
            if not open_tags[tag]:
                continue
            k = len(stack) - 1
            while stack[k][0] != tag:  # what lies above is closed too, so each element is passed once
                k -= 1
            was, inner = cut, node
            for name, mark, around, before in reversed(stack[k:]):
                cut, content, link = cut - (mark == -1), content - (mark > 0), link - (name == "a")
                node = leave(mark, around, before)
                open_tags[name] -= 1
            del stack[k:]
            if not cut and not was:
                out.append([f"/{tag}:in" if content else f"/{tag}", 1, "\0" if tag in BLOCKS else "", inner, False])
            continue
        mark = marked(tag, attributes)
        if mark == -2:
            mark = 0 if content else -1
        elif mark == -4:
            mark = 0 if content else -3
        single = tag in VOID or attributes.rstrip().endswith("/") and tag not in BLOCKS
        if tag == "p" and not single:  # a paragraph ends where the next one starts
            while open_tags["p"] and stack and stack[-1][0] in ("p", "b", "i", "em", "strong", "span"):
                name, old, outer, before = stack.pop()
                open_tags[name] -= 1
                cut, content = cut - (old == -1), content - (old > 0)
                node = leave(old, outer, before)
                if name == "p":
                    break
        named = mark == -3 and not single
        around = node
        if named and not cut:
            node = _Node(around)
            nodes.append(node)
        if not cut:
            node.h1 += tag == "h1"
            node.prose += tag == "p" or tag in HEADINGS
            out.append(["cut" if mark == -1 or mark == -3 and single else f"{tag}:in" if content else tag, 1, "\0" if tag in BLOCKS else " " if tag == "br" else "", node, named])
        if tag in RAW and not (single and tag in FOREIGN):
            end = None if tag in endless else _end(tag).search(page, at)
            if end is None:
                endless.add(tag)
            at = end.end() if end else at if tag in FOREIGN else n
            continue
        if single:
            continue
        stack.append((tag, mark, around, total))
        open_tags[tag] += 1
        cut, content, link = cut + (mark == -1), content + (mark > 0), link + (tag == "a")
        if mark > 0 and not cut:
            content_in.append(node)
    for _, mark, around, before in reversed(stack):
        node = leave(mark, around, before)
    if len(nodes) > 1:
        _wrappers(nodes)
        for t in out:
            if t[4] and not t[3].shown:  # the element itself is one token of what is around it
                t[0], t[3] = "cut", t[3].parent
        out = [t for t in out if t[3].shown]
    if not any(c.shown for c in content_in):
        for t in out:
            if t[0] == "word:out":
                t[0] = "word:free"
    _what_follows(out)
    return [tuple(t[:3]) for t in out]


def _what_follows(out: list[list]) -> None:
    """Reclass words outside content that stand in a notice, or after a heading of comments or links, up to the end of what
    holds the heading. Such a heading is a heading element, or a block of its own, of eight words at most.

    One that counts comments or asks for one is such wherever it stands. One that only has such a name can also be a section of the
    article: it counts where no block stands before it in what holds it (elements with blocks of their own may), and until the next heading there.
    """
    depth, until, named, at, heading = 0, None, False, 0, False
    filled = [0]  # blocks so far that stand in each open holder itself
    for k in range(len(out) + 1):
        kind, border = (out[k][0].removesuffix(":in"), out[k][2] == "\0") if k < len(out) else ("", True)
        if not border:
            continue
        block = [t for t in out[at:k] if t[0] in ("word:out", "word:free", "word:link")]
        if block:
            text, words = "".join(t[2] for t in out[at:k] if t[2] != "\0"), sum(t[1] for t in block)
            free = all(t[0] != "word:in" for t in out[at:k])
            if named and heading and until == depth:
                until = None
            if until is None and free and words <= 8 and (heading or depth):
                counted = COUNTED.fullmatch(text)
                if counted or (not filled[-1] and NAMED.fullmatch(text)):
                    until, named = depth, not counted
            new = "word:after" if until is not None else "word:notice" if free and words <= 40 and NOTICE.match(text) else None
            for t in block if new else ():
                t[0] = new
            filled[-1] += 1
        at, heading = k + 1, kind in HEADINGS
        if kind in HOLDERS:
            depth += 1
            filled.append(0)
        elif kind[1:] in HOLDERS and kind[0] == "/":
            depth -= 1
            if len(filled) > 1:
                filled.pop()
            if until is not None and depth < until:
                until = None


def best_run(scores: list[float]) -> tuple[int, int]:
    """Start and end of the contiguous run with the largest sum (the first and longest of equal ones)."""
    best, run, start, found = 0.0, 0.0, 0, (0, 0)
    for i, s in enumerate(scores):
        if run < 0:
            run, start = 0.0, i
        run += s
        if run > best or (run == best and found[1] and found[0] == start):
            best, found = run, (start, i + 1)
    return found


def scores_of(sequence: list[tuple[str, int, str]], weights: dict[str, float]) -> list[float]:
    other = lambda kind: weights["tag:in" if kind.endswith(":in") else "tag"]
    return [(weights.get(kind, 0.0) * n if kind.startswith("word") else 0.0 if kind == "space" else weights.get(kind, other(kind))) for kind, n, _ in sequence]


def extract(page: str | None, weights: dict[str, float]) -> str:
    if not page:
        return ""
    sequence = tokens(page)
    start, end = best_run(scores_of(sequence, weights))
    text = "".join(t.replace("\0", " ") if kind.startswith("word") else t for kind, _, t in sequence[start:end] if kind not in ("word:notice", "word:after"))
    return "\n\n".join(block for raw in text.split("\0") if (block := " ".join(html_lib.unescape(raw).split())))


# Labelled pages ----------------------------------------------------------------------------------


def labelled_pages(n: int = 400, seed: int = 0) -> list[tuple[str, str]]:
    """(page, article's words between markers) in many layouts; words of the article start with ``~``."""
    rng = random.Random(seed)
    syllables = "ka lo mi tu ren sa vel dor pin est on".split()

    def words(k: int, mark: str = "") -> str:
        return " ".join(mark + "".join(rng.choices(syllables, k=rng.randint(1, 3))) for _ in range(k))

    def links(k: int) -> str:
        return "<ul>" + "".join(f'<li><a href="/{i}">{words(rng.randint(1, 2))}</a></li>' for i in range(k)) + "</ul>"

    def paragraph() -> str:
        inner = words(rng.choice([1, 3, 8, 20, 40, 80]), "~")
        if rng.random() < 0.2:
            inner = f"<b>{inner}</b> {words(4, '~')}"
        if rng.random() < 0.2:
            inner += f' <a href="/x">{words(2, "~")}</a> {words(5, "~")}'
        return f"<p>{inner}{'' if rng.random() < 0.2 else '</p>'}"

    def table() -> str:
        row = lambda cell, k: "<tr>" + "".join(f"<{cell}>{words(rng.randint(1, 3), '~')}</{cell}>" for _ in range(k)) + "</tr>"
        k = rng.randint(2, 5)
        inner = "".join(row("td", k) for _ in range(rng.choice([1, 3, 8, 20])))
        return f"<table><thead>{row('th', k)}</thead><tbody>{inner}</tbody></table>" if rng.random() < 0.5 else f"<table>{inner}</table>"

    def code() -> str:
        return f"<pre><code>{words(rng.randint(2, 20), '~')}</code></pre>"

    def figure() -> str:
        return f'<figure><img src="/x.png"><figcaption>{words(6, "~")}</figcaption></figure>'

    def terms() -> str:
        return "<dl>" + "".join(f"<dt>{words(1, '~')}</dt><dd>{words(5, '~')}</dd>" for _ in range(rng.randint(1, 5))) + "</dl>"

    out = []
    for i in range(n):
        body = f"<h1>{words(rng.randint(2, 7), '~')}</h1>"
        for _ in range(rng.choice([1, 2, 4, 8, 12])):
            if rng.random() < 0.15:
                body += rng.choice([table, code, figure, terms])()
            if rng.random() < 0.05:
                body += f"<h2>~{rng.choice(['Discussion', 'Comments', 'Responses'])}</h2>{paragraph()}"
            body += rng.choices([paragraph(), f"<h2>{words(3, '~')}</h2>", f"<ul><li>{words(6, '~')}</li><li>{words(9, '~')}</li></ul>", f"<blockquote>{words(15, '~')}</blockquote>", f'<div class="ad">{words(9)}</div>'], [8, 1, 1, 1, 1])[0]
        hinted = rng.random() < 0.6
        if hinted:
            article = rng.choice(["<article>{}</article>", "<main>{}</main>", '<div class="post-content">{}</div>', '<div id="content">{}</div>', "<main><article>{}</article></main>"]).format(body)
        else:
            article = rng.choice(["<div>{}</div>", "<table><tr><td>{}</td></tr></table>", "<section>{}</section>"]).format(body)
        top = rng.choice(["<nav>{}</nav>", "<header>{}</header>", '<div class="menu">{}</div>', "<div>{}</div>"]).format(links(rng.randint(3, 8)))
        notice = rng.choice(["", f'<div class="cookie-notice">{words(12)}</div>', f"<div>{words(4)}</div>", f'<div class="ad">{words(8)}</div>'])
        side = rng.choice(["", f"<aside>{words(15)}</aside>", f'<div class="sidebar">{links(4)}</div>', f"<div>{links(4)}</div>"])
        after = rng.choice(["", f'<div class="comments"><p>{words(20)}</p><p>{words(9)}</p></div>', f"<form><label>{words(2)}</label><input></form>"])
        after += rng.choice(["", "", f"<div><h3>{rng.randint(1, 40)} Comments</h3><ul><li><p>{words(9)}</p></li><li><p>{words(20)}</p></li></ul></div>", f"<div><h4>Related articles</h4>{links(3)}</div>", f"<div><p>Leave a reply</p><p>{words(6)}</p></div>"])
        foot = rng.choice(["<footer>{}</footer>", '<div class="footer">{}</div>', "<div>{}</div>", "<p>{}</p>"]).format(rng.choice([f"&copy; {words(4)}", f"Copyright 2021 {words(3)}. All rights reserved."]))
        out.append(f"<!DOCTYPE html><html><head><title>{words(4)}</title></head><body>{top}{notice}{article}{side}{after}{foot}</body></html>")
    return out


#: What the negative weights are multiplied by, of which the one that gets most labelled pages right is taken.
FACTORS = (1.0, 1.25, 1.5, 2.0, 2.5, 3.0, 4.0)


@lru_cache(maxsize=4)
def learned(n: int = 400, seed: int = 0) -> dict[str, float]:
    """Weights from labelled pages: log-odds of lying in the article's run; words stay above 0, tags below. How much tags weigh against
    words is what gets most of the pages right."""
    inside, outside, sequences = Counter(), Counter(), []
    for page in labelled_pages(n, seed):
        sequence = tokens(page)
        ours = [i for i, (_, _, t) in enumerate(sequence) if "~" in t]
        for i, (kind, k, _) in enumerate(sequence):
            (inside if ours and ours[0] <= i <= ours[-1] else outside)[kind] += k
        sequences.append((sequence, (ours[0], ours[-1] + 1) if ours else (0, 0)))
    weights = {}
    for kind in {*inside, *outside}:
        odds = math.log((inside[kind] + 0.5) / (outside[kind] + 0.5))
        beside = kind in ("word:after", "word:notice")
        weights[kind] = min(-0.5, odds) if beside else max(0.02, odds) if kind.startswith("word") else min(-0.05, odds)
    weights = {"word:after": -0.5, "word:notice": -0.5} | weights | {"word:link": min(weights["word:link"], 0.3), "cut": min(-2.0, weights["cut"]), "tag": -1.0, "tag:in": -0.05, "space": 0.0}
    scaled = [{k: w * f if w < 0 else w for k, w in weights.items()} for f in FACTORS]

    def right(w: dict[str, float]) -> int:
        words = lambda sequence, start, end: sum(n for kind, n, _ in sequence[start:end] if kind.startswith("word"))
        found = [(s, best_run(scores_of(s, w)), run) for s, run in sequences]
        return sum(words(s, *a) == words(s, *b) == words(s, max(a[0], b[0]), min(a[1], b[1])) for s, a, b in found)

    return max(scaled, key=right)


def main_text(pages: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """``page_id, url, text`` of every row; nothing is shuffled."""
    sent = pages.sparkSession.sparkContext.broadcast(weights or learned())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "html"):
            texts = [extract(h, sent.value) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    schema = T.StructType([pages.schema["page_id"], pages.schema["url"], T.StructField("text", T.StringType())])
    return rows(pages, "page_id", "url", "html").mapInArrow(run, schema)


def op3_html_extract(spark, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    return main_text(spark.read.parquet(f"{sf_dir}/pages.parquet")).withColumn("n_chars", F.length("text").cast("long"))
