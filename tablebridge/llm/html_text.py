"""Main text of HTML pages by two-pass block rules.

A page is cut into blocks. The first pass adds up evidence on each block: its link density, its stop-word density and
length, and a smaller shift from its container (article or main against menus, notices and the like). Clear sums decide a
block; the second pass lets the ambiguous rest, mostly short blocks, inherit the label of the nearest decided neighbours. On
a page without a clearly good block and without an article element, any evidence for a block decides.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

SHORT = 40  # code points below which a text says nothing of itself
LONG = 140  # from which on stop-word density alone makes a block good
LINKS = 0.4  # share of code points in links above which a block is bad
STOP_HIGH, STOP_LOW = 0.25, 0.1
#: Evidence that makes a block good; its negative makes it bad.
CLEAR = 1.0
#: Shift of a block in an article or main element, and of one in a boilerplate container.
MAIN, BOILERPLATE = 0.5, -2.0

# Element names.
_BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
_CONTAINERS = frozenset("article aside blockquote details dialog div dl fieldset figure footer form header li main menu nav ol section table td ul span".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title iframe".split())  # no markup inside: up to their end tag, or the page's end
_UNSEEN = frozenset("noscript template svg object select button canvas video audio math".split())  # not text of the page
_BOILERPLATE = frozenset("nav footer aside form menu dialog".split())
_MAIN = frozenset("article main".split())
# Words in class, id and role that mark boilerplate, words that may follow them, and those that mark the article.
_BAD_CUES = frozenset(
    "ad ads adbox adslot advert adverts advertisement advertising alert banner breadcrumb breadcrumbs comment comments commentlist complementary consent contentinfo cookie cookies copyright"
    " disclaimer disqus footer gdpr legal login masthead menu modal nav navbar navigation newsletter notice notices notification overlay pager pagination popup promo promotion promoted"
    " related recommended reply replies respond search share sharing sidebar signup skip social sponsor sponsored subscribe subscription tags toolbar topbar widget widgets".split()
)
_FILLERS = frozenset("area articles bar block bottom box button buttons container content form group icons inner item left link links list panel post posts right row section site slot text thread top unit wrap wrapper".split())
_HEAD_CUES = frozenset("header banner".split())
_MAIN_CUES = frozenset("article articlebody content entry main maincontent post story".split())
# Frequent function words of English, German, French and Spanish.
STOP_WORDS = frozenset(
    "a an and are as at be but by for from had has have he her his i in is it its not of on or she that the they this to was were what which who will with you"
    " aber als am auch auf aus bei bin das dass dem den der des die ein eine einem einen einer es für hat ich ihr im ist mit nach nicht noch nur oder sich sie sind und vom von war wie wir zu zum zur"
    " au aux avec ce ces dans de des du elle en est et il ils je la le les leur lui mais ne nous on ou par pas pour qu que qui sa se ses son sur un une vous"
    " al como con del el ella en era es está esta este fue ha hay la las lo los más me mi muy no o para pero por que se sin su sus un una y ya".split()
)
_NAME = re.compile(r"(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'=<>`]+)))?")
_VALUE = re.compile(r"=\s*[\"']|>")
_WORDS = re.compile(r"[^\W\d_]+")
_END = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I) for name in _RAW}
_SAME = {name: re.compile(rf"<(/?){name}(?=[\s/>])", re.I) for name in _UNSEEN}


@dataclass
class Block:
    text: str
    linked: int
    heading: bool
    main: bool
    boilerplate: bool
    label: str = ""
    rule: str = ""


def _marked(value: str, main: bool) -> bool:
    """Whether a class, id or role marks boilerplate. Outside the article any of its words may; inside a whole name must, up to words that may follow (ad-slot, but not notice-period)."""
    for name in value.lower().split():
        words = re.findall(r"[a-z0-9]+", name)
        if words and (words[0] in _BAD_CUES and all(w in _BAD_CUES or w in _FILLERS or w.isdigit() for w in words) if main else not _BAD_CUES.isdisjoint(words) or not _HEAD_CUES.isdisjoint(words)):
            return True
    return False


class _Page:
    def __init__(self) -> None:
        self.blocks: list[Block] = []
        self.parts: list[str] = []
        self.linked = 0
        self.in_link = 0
        self.heading = False
        self.breaks = 0
        self.unseen = False  # inside an unclosed element that is no text, until the next block
        self.stack: list[tuple[str, bool, bool]] = []  # container's name, in the main part, boilerplate
        self.open_names: Counter = Counter()

    @property
    def state(self) -> tuple[bool, bool]:
        return self.stack[-1][1:] if self.stack else (False, False)

    def data(self, raw: str) -> None:
        if not raw or self.unseen:
            return
        text = html.unescape(raw) if "&" in raw else raw
        if not text.isspace():
            self.breaks = 0
        self.parts.append(text)
        if self.in_link:
            self.linked += len("".join(text.split()))

    def end_block(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                main, boilerplate = self.state
                self.blocks.append(Block(text, self.linked, self.heading, main, boilerplate))
            self.parts = []
        self.linked, self.breaks, self.unseen = 0, 0, False

    def push(self, name: str, main: bool, boilerplate: bool) -> None:
        self.stack.append((name, main, boilerplate))
        self.open_names[name] += 1

    def open(self, name: str, attributes: str) -> None:
        main, boilerplate = self.state
        if name in _BOILERPLATE or (name == "header" and not main):
            boilerplate = True
        if name in _MAIN:
            main = True
        for key, *values in _ATTRIBUTE.findall(attributes):
            key, value = key.lower(), next((v for v in values if v), "")
            if key in ("class", "id", "role"):
                if _marked(value, main):
                    boilerplate = True
                elif not _MAIN_CUES.isdisjoint(re.findall(r"[a-z0-9]+", value.lower())):
                    main = True
            elif (key == "style" and "display:none" in value.lower().replace(" ", "")) or key == "hidden" or (key == "aria-hidden" and value.lower() == "true"):
                boilerplate = True
        self.push(name, main, boilerplate)

    def close(self, name: str) -> None:
        if not self.open_names[name]:
            return
        while self.stack:
            last = self.stack.pop()[0]
            self.open_names[last] -= 1
            if last == name:
                return


def _tag_end(page: str, at: int, last: dict[str, int]) -> int:
    """The place of the `>` that ends the tag whose name ends at `at`, not one inside a quoted value; -1 where none does. Every search ends at a match, so a page is scanned once."""
    i = at
    while i <= last[">"] and (m := _VALUE.search(page, i)):
        if m[0] == ">":
            return m.end() - 1
        quote = m[0][-1]
        if m.end() > last[quote]:
            break  # the value is never closed: the next > ends the tag
        i = page.index(quote, m.end()) + 1
    return page.find(">", at) if at <= last[">"] else -1


def blocks(page: str) -> list[Block]:
    """The page's text blocks in order, with the cues of their containers."""
    p, at, last = _Page(), 0, {c: page.rfind(c) for c in ("<", ">", "'", '"', "-->")}
    while at <= last["<"]:
        start = page.index("<", at)
        if page.startswith("<!--", start):
            p.data(page[at:start])
            at = page.index("-->", start + 4) + 3 if last["-->"] >= start + 4 else len(page)
            continue
        m = _NAME.match(page, start + 1)
        if not m:
            if page.startswith(("<!", "<?", "</"), start):  # a declaration or a stray end: no text
                p.data(page[at:start])
                at = page.index(">", start) + 1 if last[">"] > start else len(page)
            else:
                p.data(page[at : start + 1])
                at = start + 1
            continue
        p.data(page[at:start])
        end = _tag_end(page, m.end(), last)
        if end < 0:
            at = len(page)  # an unfinished tag
            break
        closing, name, attributes = bool(m[1]), m[2].lower(), page[m.end() : end]
        at = end + 1
        if name in _RAW or name in _UNSEEN:
            if not closing and not attributes.endswith("/"):
                at = _skipped(p, page, name, at)
            continue
        if name == "br":
            p.breaks += 1
            if p.breaks > 1:
                p.end_block()
            else:
                p.parts.append(" ")
        elif name == "a":
            p.in_link = 0 if closing else 1
        if name in _BLOCKS:
            p.end_block()
            p.in_link = 0
            p.heading = not closing and len(name) == 2 and name[0] == "h" and name[1].isdigit()
        if name in _CONTAINERS or (name in _BLOCKS and name not in _VOID and not p.heading and attributes):
            if closing:
                p.close(name)
            elif name != "span":
                p.open(name, attributes)
            elif any(_marked(v, p.state[0]) for k, *vs in _ATTRIBUTE.findall(attributes) if k.lower() in ("class", "id", "role") for v in vs):
                p.end_block()
                p.open(name, attributes)
            else:
                p.push(name, *p.state)
        elif closing and name in _BLOCKS:
            p.close(name)
    p.data(page[at:])
    p.end_block()
    return p.blocks


def _skipped(p: _Page, page: str, name: str, at: int) -> int:
    """Where the page goes on after the opening tag of an element that is no text. One that is not closed before the next of its kind ends at the next block."""
    if name in _RAW:
        end = _END[name].search(page, at)
        return end.end() if end else len(page)
    same = _SAME[name].search(page, at)
    if same and same[1]:
        return page.find(">", same.end()) + 1 or len(page)
    p.unseen = True
    return at


def _evidence(b: Block) -> tuple[float, str]:
    """The sum of what speaks for a block and against it, and the rule that gave most of it."""
    n = len(b.text)
    if b.linked > LINKS * len(b.text.replace(" ", "")):
        return -3.0 + MAIN * b.main, "links"
    words = _WORDS.findall(b.text.lower())
    density = sum(w in STOP_WORDS for w in words) / max(len(words), 1)
    if n < SHORT:
        own, rule = 0.0, "short"
    elif density >= STOP_HIGH:
        own, rule = (2.0, "dense and long") if n >= LONG else (0.5, "dense")
    elif density >= STOP_LOW:
        own, rule = (0.5, "some stop words") if n >= LONG else (0.0, "some stop words")
    else:
        own, rule = -1.0, "few stop words"
    return own + MAIN * b.main + BOILERPLATE * b.boilerplate, rule + (" + container" if b.main or b.boilerplate else "")


def classify(found: list[Block]) -> list[Block]:
    """Both passes: every block gets the label good or bad, and the rule that gave it."""
    told = [_evidence(b) for b in found]
    first = ["good" if e >= CLEAR else "bad" if e <= -CLEAR else "" for e, _ in told]
    if "good" not in first and not any(b.main for b in found):
        # no block is long and no container marks the article: what little speaks for a block decides
        first = ["good" if e > 0 else label for (e, _), label in zip(told, first, strict=True)]
    # an ambiguous block of the article asks the article's own text, another one all that is not of it; boilerplate never becomes text
    side = [b.main and not b.boilerplate for b in found]

    def nearest(order: range) -> list[int | None]:
        """For each block the last decided one before it in the order, on its own side."""
        out: list[int | None] = [None] * len(found)
        last: dict[bool, int | None] = {True: None, False: None}
        for i in order:
            out[i] = last[side[i]]
            if first[i] and not (side[i] and told[i][1] == "links"):
                last[side[i]] = i
        return out

    before, after = nearest(range(len(found))), nearest(range(len(found) - 1, -1, -1))
    for i, b in enumerate(found):
        x, y = before[i], after[i]
        if first[i]:
            b.label, b.rule = first[i], told[i][1]
            continue
        b.rule = "neighbours"
        if b.boilerplate:
            b.label, b.rule = "bad", "container alone"
        elif x is None and y is None:
            b.label, b.rule = ("good" if b.main else "bad"), "container alone"
        elif x is None or y is None or first[x] == first[y]:
            b.label = first[y if x is None else x]
        elif b.heading:
            b.label = first[y]
        elif i - x != y - i:
            b.label = first[x if i - x < y - i else y]
        else:
            b.label = "good" if b.main else "bad"
    return found


def main_text(page: str | None) -> str:
    """The article of a page: its good blocks, joined by line feeds. Null and empty pages give an empty text."""
    return "\n".join(b.text for b in classify(blocks(page)) if b.label == "good") if page else ""


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for each row of pages (page_id, url, html), in any order.

    A null or empty page gives an empty text, one without an article too; repeated rows give equal results, an empty table none. Other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x) for x in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    source = pages.select("page_id", "url", "html")
    kinds = dict(source.dtypes)
    return source.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
