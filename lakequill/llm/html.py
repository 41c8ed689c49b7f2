"""Main text of web pages by two passes of block rules.

The first pass classifies every block by stop-word density, length and link
density; the second lets ambiguous short blocks inherit the label of the
nearest decided neighbours.  Mark-up decides before that what the rules never
see: navigation, page headers and footers, asides, forms, scripts, and boxes
whose class says advert, notice, comment and the like.
"""

from __future__ import annotations

import html
import re
from bisect import bisect
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

# Stop words of the languages served, by language.
STOP_WORDS = {
    "en": "the of and to in a is that for it as was with be by on not he this are or at from his an but have had they you were which all we there been has when who will more if out so what up into than them can only other some could these may then do any my now such like our over me even most made after also did many before must through where much your well down should because each just those people how too good very make still see",
    "de": "der die das und in den von zu mit sich des auf für ist im dem nicht ein eine einen einem einer als auch es an er so dass kann über aus bei nach wie oder nur war sind hat wird werden um noch wir ich sie man mehr zum zur durch aber vor",
    "fr": "le la les de des du et en un une que qui dans pour est par sur au aux avec pas plus se ne ce il elle sont ou son sa ses nous vous mais comme leur être cette on entre",
    "es": "el la los las de del que en y a se por un una para con no su al lo como más pero sus le ya o este sí porque esta entre cuando muy sin sobre es ser también me hasta hay donde",
}
# Elements that never hold main text, that start a block, and that have no end tag.
NEVER = frozenset("head nav aside footer form script style noscript template svg annotation annotation-xml button select textarea iframe menu dialog object canvas audio video map label input datalist".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
# Words in class, id or role that mark a box as not main text, and words that mark a mere wrapper.
BOX = re.compile(
    r"(?:ads?(?:\d+|box|slot|unit|sense|block|banner|container|wrap|bygoogle)?|advert(?:s|isements?|ising|isers?|orials?)?|sponsor(?:s|ed|ship)?|promo(?:s|ted|tions?|tional|box|bar)?|cookies?(?:bar|banner|box|consent|notice|policy|law)?|consent|gdpr"
    r"|notices?|notifications?(?:bar)?|alerts?|popups?|modals?|overlay|newsletters?(?:box|form|signup)?|subscri(?:be|bers?|ption|ptions)(?:box|form)?|signup|login"
    r"|comments?(?:\d+|area|authors?|body|box|content|count|form|items?|list|meta|section|text|threads?|wrap|wrapper)?|disqus(?:thread)?|repl(?:y|ies)|respond|responses?|discussion"
    r"|related(?:articles?|content|items?|links?|news|posts?|stories)?|recommend(?:ed|ations?)|trending|breadcrumbs?|paginat(?:ion|or)|pager|sidebars?|side|aside|nav|navbar|navigation|navi|menus?|menubar|topbar|toolbar|footers?|foot|masthead|banners?"
    r"|social(?:bar|buttons|icons|links|media|share|sharing)?|shar(?:e|ing)(?:bar|box|buttons?|links?|this)?|widgets?(?:area)?|search(?:bar|box|form)?|skip|copyright|disclaimer|contentinfo|complementary|dialog|hidden|offscreen|paywall|teasers?|outbrain|taboola)"
)
PAGE_HEADER = frozenset(["header", "head", "siteheader", "pageheader"])
WRAPPER = frozenset("wrap wrapper layout container page site with has no without main content article".split())
COMMENT = re.compile(r"comments?(?:\d+|area|authors?|body|box|content|count|form|items?|list|meta|section|text|threads?|wrap|wrapper)?|disqus(?:thread)?|repl(?:y|ies)|respond")
# Of the words of boxes those that also name parts of an article, elements that may be a box in an article, words beside them in the id of a box, and names of what isn't shown.
AMBIGUOUS = re.compile(r"notices?|alerts?|promo(?:s|ted|tions?|tional)?|sponsor(?:s|ed|ship)?|responses?|discussion|related(?:articles?|content|items?|links?|news|posts?|stories)?|recommend(?:ed|ations?)|trending|side|foot|banners?|social(?:media)?|shar(?:e|ing)|widgets?|search|skip|copyright|disclaimer|overlay|dialog|menus?|teasers?|complementary")
CONTAINER = frozenset("center dd details div dl fieldset figure header hgroup li ol section table tbody td tr ul".split())
PART = re.compile(r"\d+|area|bar|block|box|buttons?|container|form|inner|items?|links?|list|posts?|section|thread")
UNSEEN = frozenset(["hidden", "offscreen", "visually-hidden"])
# Boxes that pages leave open, and those of them that may stand around a whole page.
LEFT_OPEN = frozenset("nav aside header footer form menu".split())
AROUND = frozenset("nav header form".split())

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")
TOKEN = re.compile(r"[a-z0-9]+")
LETTERS = re.compile(r"[^\W\d_]+")

MAIN = re.compile(r"<(?:article|main|h1)\b", re.I)

# The thresholds of the block rules, in characters and shares.
SHORT, LONG, LINKS, STOP_LOW, STOP_HIGH = 70, 200, 0.2, 0.10, 0.20


def _boxed(tag: str, attributes: str, inside: bool, code: bool = False) -> str:
    """Whether an element starts a box that is not main text; inside: it stands in an article; code: in a code sample.

    Returns "hard" where nothing in the box is main text, "soft" where its name may
    also be that of a part of the article, so that the block rules decide, else "".
    """
    if tag in NEVER or tag == "header" and not inside:
        return "hard"
    if tag in ("html", "body", "main") or "=" not in attributes and "hidden" not in attributes:
        return ""
    low = attributes.lower()
    if re.search(r"(?:^|\s)hidden(?:\s|=|/|$)|display\s*:\s*none|visibility\s*:\s*hidden|aria-hidden\s*=\s*[\"']?true", low):
        return "hard"
    container, kind = tag in CONTAINER or "-" in tag, ""
    for name, a, b, c in ATTRIBUTE.findall(low):
        if name in ("class", "id", "role"):
            value = a or b or c
            tokens = TOKEN.findall(value)
            if tag == "article":
                if any(COMMENT.fullmatch(t) for t in tokens):
                    return "hard"
            elif inside and not container or code or name == "id" and tag in HEADING:
                if name == "class" and not UNSEEN.isdisjoint(value.split()):
                    return "hard"
            elif not any(t in WRAPPER for t in tokens) or any(COMMENT.fullmatch(t) for t in tokens):
                found = [t for t in tokens if BOX.fullmatch(t)]
                if inside and name == "id" and not all(t in found or PART.fullmatch(t) for t in tokens):
                    continue  # a longer name of a part of the article
                if not inside and (found or any(t in PAGE_HEADER for t in tokens)) or not all(AMBIGUOUS.fullmatch(t) for t in found):
                    return "hard"
                kind = "soft" if found else kind
    return kind


def blocks(page: str) -> list[tuple[str, float, bool, bool, int]]:
    """Blocks outside of hard boxes, in page order: text, share of characters in links, in an article, a heading, number of the soft box or 0."""
    out: list[tuple[str, float, bool, bool, int]] = []
    stack: list[tuple[str, bool, bool, bool]] = []  # tag, starts a box, starts an article, starts a soft box
    boxes = articles = opened = 0
    soft: list[int] = []
    link = heading = False
    parts: list[str] = []
    linked: list[str] = []

    def close() -> None:
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                in_links = " ".join(html.unescape("".join(linked)).split()) if linked else ""
                out.append((text, len(in_links) / len(text), articles > 0, heading, soft[-1] if soft else 0))
        parts.clear()
        linked.clear()

    def leave(depth: int) -> None:
        nonlocal boxes, articles
        while len(stack) > depth:
            _, box, article, doubtful = stack.pop()
            if doubtful:
                close()
                soft.pop()
            boxes -= box
            articles -= article

    def say(text: str) -> None:
        if text and not boxes:
            parts.append(text)
            if link:
                linked.append(text)

    ends_of: dict[str, list[int]] = {}

    def ends_after(tag: str, at: int) -> int:
        if tag not in ends_of:
            ends_of[tag] = [m.start() for m in re.finditer(rf"</{tag}\b", page, re.I)]
        return len(ends_of[tag]) - bisect(ends_of[tag], at)

    at, n = 0, len(page)
    while at < n:
        m = TAG.search(page, at)
        if not m:
            say(page[at:])
            break
        say(page[at : m.start()])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            if m[0].startswith("<![CDATA["):
                say(html.escape(m[0][9:].removesuffix("]]>")))
            continue
        ends, attributes = bool(m[1] or m[4]), m[3] if m[2] else m[6] or ""
        if tag in BLOCK:
            close()
            link = False if tag in ("p", "div", "li", "article", "section") else link
            heading = tag in HEADING and not ends
        elif tag == "br":
            say(" ")
        if ends:
            link = link and tag != "a"
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    leave(i)
                    break
                if stack[i][0] in ("article", "main", "body", "nav", "aside", "footer") and tag not in BLOCK:
                    break
            continue
        if tag in BLOCK and stack and stack[-1][0] == "p":  # an open paragraph ends where a block starts
            leave(len(stack) - 1)
        if tag in RAW:  # its content is not mark-up
            end = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else n
            continue
        if tag == "a":
            link = True
        if tag in VOID or attributes.rstrip().endswith("/") and tag not in BLOCK:
            continue
        if tag == "li":  # ends the item before it in the same list
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in ("ul", "ol", "menu"):
                    break
                if stack[i][0] == "li":
                    leave(i)
                    break
        kind = _boxed(tag, attributes, articles > 0, any(x[0] == "pre" for x in stack))
        box, doubtful = kind == "hard", kind == "soft"
        if box and tag in LEFT_OPEN:
            same = [i for i, x in enumerate(stack) if x[0] == tag and x[1]]
            if ends_after(tag, at) <= len(same):  # too few end tags: one before was left open, or this one is
                if same:
                    leave(same[0])
                elif tag not in ("aside", "footer") or MAIN.search(page, at):
                    box = False
        if tag in ("main", "article") and not box and boxes and all(x[0] in AROUND for x in stack if x[1]):  # the boxes stand around the page
            stack[:] = [(x[0], False, *x[2:]) for x in stack]
            boxes = 0
        article = not box and (tag in ("article", "main") or bool(re.search(r"role\s*=\s*[\"']?(?:main|article)|itemprop\s*=\s*[\"']?articleBody", attributes)))
        if box or doubtful or article or tag in BLOCK:
            if box or doubtful:
                close()
            if doubtful:
                opened += 1
                soft.append(opened)
            stack.append((tag, box, article, doubtful))
            boxes += box
            articles += article
    close()
    return out


def density(text: str, stop: frozenset[str]) -> float:
    words = LETTERS.findall(text.lower())
    return sum(w in stop for w in words) / len(words) if words else 0.0


def classify(found: list[tuple[str, float, bool, bool, int]], stop: frozenset[str]) -> list[bool]:
    """Both passes: True for blocks of main text.

    Where the page declares an article with text, blocks outside it are decided
    as bad, and blocks inside it need no stop words to be good.  In a soft box a block that isn't short
    is good if it is long or has stop words and few links, and short blocks see no
    neighbours but those of the box.  A short block
    without a decided neighbour on one side takes the label of the other side.  An article
    without a good block keeps all that stands in no soft box.

    Where no article is declared, stop words decide only on pages that have them:
    if no block is good by the first pass, or under STOP_LOW of the words of the
    blocks that aren't short are stop words, length and links decide alone.  If no
    block is good then, those without links are, copyright lines apart, given that
    they have SHORT characters together; a page of less has no main text.
    """
    declared = any(inside for _, _, inside, _, _ in found)
    first: list[str] = []
    shares = [density(text, stop) for text, *_ in found]
    for (text, links, inside, heading, box), stops in zip(found, shares, strict=True):
        if box and (links > LINKS or "©" in text and len(text) < LONG):
            first.append("bad")
        elif box and len(text) >= SHORT:
            first.append("good" if len(text) > LONG or stops >= STOP_LOW else "bad")
        elif declared and not inside or links > LINKS * (2 if inside else 1) or "©" in text and len(text) < LONG and not inside:
            first.append("bad")
        elif len(text) < SHORT:
            first.append("bad" if links > 0 and not inside else "short")
        elif stops >= STOP_HIGH or inside:
            first.append("good" if len(text) > LONG or inside else "near")
        elif stops >= STOP_LOW:
            first.append("near")
        else:
            first.append("bad")
    plain = [links <= LINKS and not ("©" in text and len(text) < LONG) for text, links, *_ in found]
    if not declared:
        long = [i for i, x in enumerate(plain) if x and len(found[i][0]) >= SHORT]
        words = [len(LETTERS.findall(found[i][0])) for i in long]
        unserved = sum(shares[i] * n for i, n in zip(long, words, strict=True)) < STOP_LOW * sum(words)
        if unserved or "good" not in first:
            for i in long:
                if first[i] == "bad":
                    first[i] = "good" if unserved and len(found[i][0]) > LONG else "near"
    labels = list(first)

    def neighbour(i: int, step: int, near: bool) -> str | None:
        j = i + step
        while 0 <= j < len(first):
            if found[j][4] == found[i][4] and (first[j] in ("good", "bad") or near and first[j] == "near"):
                if not (declared and found[i][2] and not found[j][2]):  # an article's edge is no neighbour
                    return first[j]
            j += step
        return "good" if declared and found[i][2] and not found[i][4] else None

    for i, label in enumerate(first):
        if label == "short":
            sides = {neighbour(i, -1, False), neighbour(i, 1, False)} - {None}
            if len(sides) < 2:
                labels[i] = sides.pop() if sides else "good" if "near" in first and not found[i][4] else "bad"
            else:
                labels[i] = "good" if neighbour(i, -1, True) != "bad" and neighbour(i, 1, True) != "bad" or found[i][2] else "bad"
    for i, label in enumerate(first):
        if label == "near":
            labels[i] = "good" if "good" in (neighbour(i, -1, False), neighbour(i, 1, False)) or not any(x == "good" for x in first) else "bad"
    for i, (_, _, _, heading, _) in enumerate(found):  # a heading belongs to the text right after it
        if heading and first[i] == "short" and labels[i] == "bad" and i + 1 < len(found) and labels[i + 1] == "good":
            labels[i] = "good"
    if declared and "good" not in labels:  # an article of links only is these links
        return [inside and not box for _, _, inside, _, box in found]
    if not declared and "good" not in labels:
        rest = [x and (links == 0 or len(text) >= SHORT) for x, (text, links, *_) in zip(plain, found, strict=True)]
        if sum(len(text) for x, (text, *_) in zip(rest, found, strict=True) if x) >= SHORT:
            return rest
    return [x == "good" for x in labels]


def main_text(page: str | None, stop: frozenset[str]) -> str:
    found = blocks(page or "")
    return " ".join(text for (text, *_), good in zip(found, classify(found, stop), strict=True) if good)


def extract_pages(pages: DataFrame, *, languages: tuple[str, ...] = ("en", "de", "fr", "es")) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every row of ``pages`` (page_id, url, html).

    Character references are decoded, white space inside a block (any Unicode
    white space) becomes one space, blocks are trimmed and joined by one space.

    Null or empty html, or no main text: empty text, 0.  Unclosed or crossing
    tags: an end tag closes up to its own start, one without a start does
    nothing; navigation, headers and forms without an end tag are no boxes (asides
    and footers only if an article, main or h1 follows), and an article or main in a
    navigation, header or form ends them.  Null ids and urls stay; repeated rows stay; no rows: no rows; other
    columns are ignored.  Pages are read whole, one at a time; no shuffle.
    """
    stop = frozenset(w for x in languages for w in STOP_WORDS[x].split())

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(x.as_py(), stop) for x in b.column("html")]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", "html").mapInArrow(extract, f"page_id {kind}, url string, text string, n_chars bigint")
