"""Main text of web pages as the maximum-scoring subsequence of their words and tags.

A page is a sequence of words and tags. Words score positive and tags negative,
by weights learned from labelled pages: the log odds of a word in the article
by its surroundings (zone, link, kind of block; bounded in foreign zones, which an article may go round), and for each tag how rarely it
stands within the article. One linear scan finds the contiguous run with the
highest sum. Its blocks are the text; parts of the run in the zones that an
article never owns (menus, adverts, forms, comments ...) are left out. Such a zone costs
nothing within an article element and at most FOREIGN_COST elsewhere, so a long one doesn't split the run.

A class, id or role that only names foreign things makes its element foreign. One that
also says other things does so unless the element holds at least half of the page's words (of those in article
elements, if there are any); what follows "has", "no", "with" ... in a name says nothing of the element itself,
and a header of an entry, post, article ... is the article's. Time is linear in the page, however its tags nest.

The labelled pages are made here: LABELLED_PAGES pages of five layouts, each fragment
marked as article or not.
"""

from __future__ import annotations

import html
import math
import random
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sketchlake.llm.runtime import ship

LABELLED_PAGES = 150
_MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.DOTALL)
_UNCLOSED = re.compile("<[a-zA-Z/!?]")  # after the last ">", what follows is lost
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_NO_DISPLAY = re.compile(r"(?:^|;)\s*display\s*:\s*none", re.IGNORECASE)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")

RAW = frozenset("script style title textarea template noscript iframe svg annotation annotation-xml canvas noembed noframes xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split())
FOREIGN = frozenset("nav footer aside form button select menu dialog head search".split())
FOREIGN_NAMES = frozenset("ad ads advert adverts advertisement advertising adsense adsbygoogle banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs masthead header footer sidebar aside widget related recommended recommendations share sharing social cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login search comment comments commentlist reply replies respond disqus pagination pager skip copyright".split())
OWN = frozenset("html body article main".split())
#: After these, a part of a name is about what else is there or not.
ABOUT_OTHERS = frozenset("has have no not non with without hide hides show shows".split())
#: A header of these is the article's.
OF_ARTICLE = frozenset("entry post article story content hentry headline".split())
#: The most that one foreign zone outside article elements takes from a run; a few words of a paragraph.
FOREIGN_COST = 40.0


def attributes(rest: str) -> dict[str, str]:
    """Attributes of a tag by lower-cased name; of equal names the first counts."""
    found: dict[str, str] = {}
    for name, *value in _ATTRIBUTE.findall(rest):
        found.setdefault(name.lower(), "".join(value))
    return found


def hidden(own: dict[str, str]) -> bool:
    return own.get("hidden", "false").lower() not in ("false", "until-found") or own.get("aria-hidden", "").lower() == "true" or bool(_NO_DISPLAY.search(own.get("style", "")))


def named_foreign(own: dict[str, str]) -> str:
    """"only" if class, id and role name nothing but foreign things, "also" if other things too, else ""."""
    foreign = other = False
    for token in " ".join(own.get(a, "") for a in ("class", "id", "role")).split():
        parts = [part.lower() for part in _PART.findall(token)]
        for part in parts:
            if part in ABOUT_OTHERS:
                other = True
                break
            foreign, other = (True, other) if part in FOREIGN_NAMES and not (part == "header" and heads_article(parts)) else (foreign, True)
    return "" if not foreign else "also" if other else "only"


def heads_article(parts: list[str]) -> bool:
    return not OF_ARTICLE.isdisjoint(parts)


class _Reader:
    """Walks a page and gives its pieces: ("tag", name, separator, block number, zone) and ("text", surroundings, string, block number, zone).

    The zone is "" or, in a foreign part, "inner" within an article element and "outer" elsewhere.
    """

    def __init__(self, forms: bool, names: bool = True):
        self.forms, self.names = forms, names

    def pieces(self, page: str) -> Iterator[tuple]:
        named: list[tuple[str, int, int]] = []
        walked = list(self._walk(page, named))
        out_of = self._foreign(walked, named)
        for what, name, text, block, (foreign, article, link, kind, within) in walked:
            out = foreign or out_of[within]
            zone = "" if not out else "inner" if article else "outer"
            yield what, ("foreign" if out else "article" if article else "none", link, kind) if what == "text" else name, text, block, zone

    @staticmethod
    def _foreign(walked: list[tuple], named: list[tuple[str, int, int]]) -> list[bool]:
        """Of each named element (sort, article elements around it, named element around it; the last entry: none), whether what it holds is foreign.

        It is not if it holds at least half of the words: of those in article elements opened within it, or else of all.
        An element whose names are all foreign must hold half of all words and an article element.
        """
        n = len(named)
        sure = [False] * (n + 1)  # in an element whose names are all foreign
        for i, (sort, _, around) in enumerate(named):
            sure[i] = sort == "only" or sure[around]
        unsure_words, unsure_in_article = 0, 0
        # of each element: words, those in article elements opened within it, and of both those not surely foreign
        words, inner, free, free_inner = ([0] * (n + 1) for _ in range(4))
        for what, _, text, _, (foreign, article, _, _, within) in walked:
            if what != "text" or foreign:
                continue
            k = len(text.split())
            deeper = within != -1 and article > named[within][1]
            words[within] += k
            inner[within] += k * deeper
            if not sure[within]:
                free[within] += k
                free_inner[within] += k * deeper
                unsure_words += k
                unsure_in_article += k * (article > 0)
        for i in range(n - 1, -1, -1):
            _, outside, around = named[i]
            beyond = around != -1 and outside > named[around][1]  # an article element lies between the two
            words[around] += words[i]
            inner[around] += words[i] if beyond else inner[i]
            free[around] += free[i]
            free_inner[around] += free[i] if beyond else free_inner[i]
        everything = words[-1]
        out = [False] * (n + 1)
        for i, (sort, outside, around) in enumerate(named):
            if sort == "also":
                whole, held = (unsure_in_article, free_inner[i]) if unsure_in_article and not outside else (unsure_words, free[i])
                ours = whole > 0 and 2 * held >= whole
            else:
                ours = inner[i] > 0 and 2 * words[i] >= everything
            out[i] = not ours or out[around]
        return out

    def _walk(self, page: str, named: list[tuple[str, int, int]]) -> Iterator[tuple]:
        """Pieces with what they stand in, at last the innermost named element (-1: none); ``named`` is filled with them."""
        stack: list[tuple[str, bool, bool]] = []
        where: dict[str, list[int]] = {}  # places on the stack by name
        blocks: list[int] = []  # and of block elements
        foreign = article = link = block = at = 0
        kind = "other"
        within = -1
        last = page.rfind(">") + 1

        def surroundings() -> tuple:
            return foreign > 0, article, link > 0, kind, within

        while True:
            found = _MARKUP.search(page, at, last)
            text = page[at : found.start()] if found else _UNCLOSED.split(page[at:], 1)[0]
            if text:
                yield "text", "", text, block, surroundings()
            if not found:
                return
            at = found.end()
            closing, name, rest = (found[1], found[2], found[3]) if found[2] else (found[4], found[5], found[6])
            if not name:
                if found[0].startswith(("<!--", "<![CDATA[")) and at == last and not found[0].endswith(("-->", "]]>")):
                    return
                continue
            name = name.lower()
            if name in RAW and not closing:
                end = re.compile(f"</{re.escape(name)}", re.IGNORECASE).search(page, at)
                if not end:
                    return
                at = page.find(">", end.end()) + 1 or len(page)
                continue
            if name in BLOCK:
                block += 1
            yield "tag", name, "br" if name == "br" else "", block, surroundings()
            depth = len(stack)
            if closing:
                if not where.get(name):
                    continue
                depth = where[name][-1]
            elif name in BLOCK and blocks and (stack[blocks[-1]][0] == "p" or name == stack[blocks[-1]][0] == "li"):
                depth = blocks[-1]
            while len(stack) > depth:
                gone, was_foreign, was_named = stack.pop()
                where[gone].pop()
                if gone in BLOCK:
                    blocks.pop()
                foreign -= was_foreign
                if was_named:
                    within = named[within][2]
                article -= gone in ("article", "main")
                link -= gone == "a"
            if not closing and name not in VOID and not rest.rstrip().endswith("/"):
                given = attributes(rest) if name not in OWN else {}
                heads = name == "header" and not article and not heads_article([p.lower() for a in ("class", "id") for p in _PART.findall(given.get(a, ""))])
                is_foreign = name not in OWN and (name in FOREIGN and (name != "form" or self.forms) or heads or hidden(given))
                sort = named_foreign(given) if self.names and not is_foreign and (name in BLOCK or name in ("span", "a", "ins")) else ""
                where.setdefault(name, []).append(len(stack))
                if name in BLOCK:
                    blocks.append(len(stack))
                stack.append((name, is_foreign, bool(sort)))
                foreign += is_foreign
                if sort:
                    named.append((sort, article, within))
                    within = len(named) - 1
                article += name in ("article", "main")
                link += name == "a"
            inner = stack[blocks[-1]][0] if blocks else ""
            kind = "heading" if inner[:1] == "h" and inner[1:].isdigit() else "text" if inner in ("p", "blockquote", "pre") else "item" if inner in ("li", "dt", "dd", "td", "th") else "other"


def labelled_pages(n: int = LABELLED_PAGES) -> Iterator[list[tuple[str, bool]]]:
    """Pages as fragments of markup with whether each is of the article."""
    dice = random.Random(11)
    words = lambda a, b: " ".join("".join(dice.choice("aeioulnrst") for _ in range(dice.randint(2, 9))) for _ in range(dice.randint(a, b)))
    links = lambda k: "".join(f'<li><a href="/{i}">{words(1, 3)}</a></li>' for i in range(k))
    for i in range(n):
        body = f"<h1>{words(2, 10)}</h1>"
        for _ in range(dice.randint(1, 9)):
            body += dice.choice([f"<p>{words(4, 60)}</p>", f"<p>{words(3, 20)} <a href='/x'>{words(1, 2)}</a> {words(3, 20)}", f"<h2>{words(1, 5)}</h2><p><b>{words(2, 6)}</b> {words(5, 40)}<br>{words(3, 9)}</p>", f"<ul><li>{words(3, 15)}</li><li>{words(3, 15)}</li></ul>", f"<blockquote>{words(5, 30)}</blockquote>", f"<table><tr><td>{words(1, 3)}</td><td>{words(1, 3)}</td></tr></table>"])
        menu, foot = f"<nav><ul>{links(dice.randint(3, 12))}</ul></nav>", f"<footer>&copy; {words(2, 12)}</footer>"
        advert = f'<div class="{dice.choice(["ad", "advert", "banner promo", "cookie-notice", "newsletter"])}">{words(3, 25)}</div>'
        side = f'<aside><h3>{words(1, 3)}</h3><ul>{links(5)}</ul></aside>'
        comments = f'<div id="comments"><h3>{words(1, 2)}</h3><p>{words(5, 40)}</p><form><input name="q"><button>{words(1, 2)}</button></form></div>'
        layout = i % 5
        if layout == 0:
            yield [(menu, False), (advert, False), (f"<article>{body}</article>", True), (foot, False)]
        elif layout == 1:
            yield [(f"<header>{words(1, 4)}</header>{menu}", False), (f"<main>{body}</main>", True), (side + comments + foot, False)]
        elif layout == 2:
            yield [(f'<div id="header">{words(1, 5)}</div><ul class="menu">{links(6)}</ul>', False), (f'<div class="content">{body}</div>', True), (f'<div class="sidebar">{words(5, 20)}</div>{foot}', False)]
        elif layout == 3:
            yield [(f"<ul>{links(8)}</ul><div><a href='/'>{words(1, 2)}</a></div>", False), (body, True), (f"<div><a href='/a'>{words(1, 3)}</a> <a href='/b'>{words(1, 3)}</a></div>{foot}", False)]
        else:
            yield [(menu + advert, False), (f"<section>{body}", True), (comments, False), (f"<ul>{links(4)}</ul>", False)]


@lru_cache(maxsize=1)
def weights() -> tuple[dict, dict]:
    """Scores of a word by its surroundings, and of a tag by its name; fitted to the labelled pages."""
    words: dict[bool, Counter] = {True: Counter(), False: Counter()}
    tags: dict[bool, Counter] = {True: Counter(), False: Counter()}
    for page in labelled_pages():
        ends, whole = [], ""
        for fragment, ours in page:
            whole += fragment
            ends.append((len(whole), ours))
        at = 0
        for fragment, ours in page:
            # surroundings are those of the whole page; a fragment closes what it opens or leaves it open to the end
            for piece in _Reader(True).pieces(whole[at : at + len(fragment)]):
                if piece[0] == "text":
                    words[ours][piece[1]] += len(piece[2].split())
                else:
                    tags[ours][piece[1]] += 1
            at += len(fragment)
    total = {k: sum(c.values()) for k, c in words.items()}
    score = {}
    for zone in ("foreign", "article", "none"):
        for linked in (False, True):
            for kind in ("heading", "text", "item", "other"):
                key = (zone, linked, kind)
                odds = math.log((words[True][key] + 0.5) / (total[True] + 1)) - math.log((words[False][key] + 0.5) / (total[False] + 1))
                prior = {"foreign": -3.0, "article": 1.5, "none": 0.5}[zone] - (1.0 if linked else 0.0)
                seen = words[True][key] + words[False][key]
                odds = (odds * seen + prior * 20) / (seen + 20)
                score[key] = min(max(odds, -1.5), -1.0) if zone == "foreign" else max(odds, 0.05) if not linked else max(odds, -2.0)
    cost = {name: -0.05 - 1.5 * (tags[False][name] + 0.5) / (tags[True][name] + tags[False][name] + 1) for name in {*tags[True], *tags[False]}}
    return score, cost


def _run(pieces: list[tuple]) -> tuple[int, int]:
    """The first and last + 1 piece of the contiguous run with the highest sum; (0, 0) if no sum is positive."""
    score, cost = weights()
    best, span, now, begin, lost = 0.0, (0, 0), 0.0, 0, 0.0
    for i, piece in enumerate(pieces):
        gain = 0.0 if piece[4] == "inner" else score[piece[1]] * len(piece[2].split()) if piece[0] == "text" else cost.get(piece[1], -0.5)
        if piece[4] == "outer":
            gain = max(gain, -FOREIGN_COST - lost)
            lost += gain
        elif not piece[4]:
            lost = 0.0
        if now <= 0:
            now, begin = 0.0, i
        now += gain
        if now > best:
            best, span = now, (begin, i + 1)
    return span


def main_text(page: str | None) -> str:
    """The article's text: blocks in page order joined by an empty line, white space within a block made one space."""
    for forms, names in ((True, True), (False, True), (True, False), (False, False)):  # some pages are one form, or have foreign names all over; only a page without text otherwise is read so
        pieces = list(_Reader(forms, names).pieces(page or ""))
        first, last = _run(pieces)
        blocks: list[str] = []
        now, held = -1, []
        for piece in [*pieces[first:last], ("text", ("end",), "", -2)]:
            if piece[3] != now:
                if text := " ".join("".join(held).split()):
                    blocks.append(text)
                now, held = piece[3], []
            if piece[0] == "tag":
                held.append(" " if piece[2] else "")
            elif piece[1][0] not in ("foreign", "end"):
                held.append(html.unescape(piece[2]))
        if blocks:
            return "\n\n".join(blocks)
    return ""


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, 256):
            part = batch.slice(lo, 256)
            texts = [main_text(x) for x in part.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], ["row", "text", "n_chars"])


def extract_text(pages: DataFrame, html_column: str = "html") -> DataFrame:
    """``row`` (the page's columns other than the html), ``text`` and ``n_chars`` (its code points).

    A null or empty page, or one without a positive run, has the empty text. Every
    page is read whole; broken markup (unclosed or crossed tags, quotes and comments)
    is read as browsers roughly do. Repeated rows are read each; an empty table
    gives no rows.
    """
    ship(pages.sparkSession)
    others = [pages[f"`{c}`"] for c in pages.columns if c != html_column]
    packed = pages.select(F.struct(*others).alias("row"), F.col(html_column).cast("string").alias("html"))
    schema = T.StructType().add("row", packed.schema["row"].dataType).add("text", "string").add("n_chars", "long")
    return packed.mapInArrow(_extract, schema)
