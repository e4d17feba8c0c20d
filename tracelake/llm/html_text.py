"""Main text of web pages by two passes over blocks.

A page is cut into blocks at block-level tags. The first pass labels a block by where it stands,
its link density, its length and its stop-word density; what these leave open stays undecided.
In the second pass an undecided block takes the label of the nearest decided block of its region
(the article, or the rest of the page).
"""

from __future__ import annotations

import html
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame

#: Frequent function words of the languages read here.
STOP_WORDS = frozenset("""
the of and to in is that it for was on are as with be by this from at or an not but have had has he she they his her its
you we which their will would can there been if more when who what so no one all were said up out into than them then
de la le les et des en un du une que est pour qui dans par plus pas au sur ne se ce il elle sont avec aux ou son sa ses
mais nous vous leur on tout cette ces comme être fait si lui y
der die das und den von zu mit sich auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird
bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man sein wurde
el los las y del con por una su para al lo como más o pero sus ha este sí porque esta entre cuando muy sin sobre también
me hasta hay donde quien desde todo nos durante todos uno les ni contra otros ese eso ante ellos e
""".split())

#: Tags that end a block, and tags whose content is never main text.
BLOCK = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset
figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p
pre section select summary table tbody td tfoot th thead title tr ul""".split())
NEVER = frozenset("nav aside footer form button select fieldset menu dialog head svg iframe object canvas audio video map".split())
RAW = ("script", "style", "template", "noscript", "textarea", "title", "xmp", "noframes")
#: Words in class, id or role that mark a part as no article text.
MARKS = frozenset("""ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner menu nav
navbar navigation breadcrumb breadcrumbs sidebar sidebars widget widgets footer masthead comment comments respond replies
reply disqus cookie cookies consent gdpr notice notices popup modal overlay share sharing social related recommended
recommendations newsletter subscribe subscription signup login search pagination pager toolbar copyright skip
complementary contentinfo alert alertdialog form teaser teasers outbrain taboola""".split())
#: Elements that HTML never closes.
EMPTY = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HOLDERS = frozenset("article main".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

PIECE = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>"
    rf"|<(?P<raw>{'|'.join(RAW)})\b(?:[^>\"']++|\"[^\"]*\"|'[^']*')*+>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-z][^\s/>]*)(?P<rest>(?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(?P<end2>/?)(?P<tag2>[a-z][^\s/>]*)(?P<rest2>[^>]*)>|<(?=[/a-z])[^>]*\Z", re.I | re.S)
MARKED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)
NAME = re.compile(r"[a-z]+")
CLOSING = re.compile(r"</([a-zA-Z][a-zA-Z0-9]*)")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")

#: First pass: blocks from so many words on are decided by their stop words and links alone.
LONG_WORDS, STOP_SHARE, LINK_SHARE = 12, 0.12, 0.5


def marked(rest: str) -> bool:
    """Whether an element's attributes say that it is no main text."""
    if not rest:
        return False
    if HIDDEN.search(rest):
        return True
    return any(word in MARKS for found in MARKED.findall(rest)
               for word in NAME.findall(CAMEL.sub(" ", "".join(found)).lower()))


def blocks(page: str) -> list[tuple[str, str, str, float]]:
    """(text, region, tag, link share) of every block in page order; region is out, page or main."""
    out: list[tuple[str, str, str, float]] = []
    parts: list[str] = []
    open_tags: list[tuple[str, str]] = []  # element, the region around it
    count: Counter[str] = Counter()  # open tags by name
    last_end = {m[1].lower(): m.start() for m in CLOSING.finditer(page)}
    region, tag, linked, breaks, link = "page", "", 0, 0, 0

    def close() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append((text, region, tag, min(1.0, linked / len(text))))
            parts.clear()
        linked = 0

    at = 0
    for m in PIECE.finditer(page):
        if m.start() > at:
            text = html.unescape(page[at:m.start()])
            parts.append(text)
            if link:
                linked += len(text.strip())
            if breaks and text.strip():
                breaks = 0
        at = m.end()
        name = (m["tag"] or m["tag2"] or "").lower()
        if not name:
            continue
        ends, rest = m["end"] or m["end2"], m["rest"] or m["rest2"] or ""
        if name == "br":
            breaks += 1
            parts.append(" ")
            if breaks > 1:
                close()
            continue
        if name == "a":
            link = max(0, link - 1) if ends else link + (not rest.rstrip().endswith("/"))
            continue
        splits = name in BLOCK
        if splits:
            close()
            breaks = link = 0
            tag = name if not ends else ""
        if name in EMPTY or rest.rstrip().endswith("/"):
            continue
        if not ends:
            apart = name in NEVER or (name == "header" and region != "main") or marked(rest)
            if name in HOLDERS or apart or splits and name != "p":
                if (name in HOLDERS or apart) and last_end.get(name, -1) < at:
                    if apart and not splits:
                        continue
                    if name not in HOLDERS:
                        continue  # never closed: it can't be told how far it goes
                open_tags.append((name, region))
                count[name] += 1
                if apart and name not in ("body", "html"):
                    if not splits:
                        close()
                    region = "out"
                elif name in HOLDERS and region != "out":
                    region = "main"
        elif count[name]:  # each open tag is passed over and taken off at most once
            if not splits:
                close()
            while True:
                last, region = open_tags.pop()
                count[last] -= 1
                if last == name:
                    break
    parts.append(html.unescape(page[at:]))
    close()
    return out


def first_pass(block: tuple[str, str, str, float], held: bool) -> bool | None:
    """True: main text, False: not, None: undecided. ``held``: the page has an article or main part."""
    text, region, tag, links = block
    if region == "out" or held and region == "page" or links > LINK_SHARE:
        return False
    words = text.split()
    if len(words) < LONG_WORDS or tag in HEADINGS:
        return None
    stops = sum(w.lower() in STOP_WORDS or w.strip(" .,;:!?\"'()[]*#%&$").lower() in STOP_WORDS for w in words)
    if stops >= STOP_SHARE * len(words):
        return True
    return None if region == "main" else False


def main_text(page: str | None) -> str:
    """Main text, one line per block; empty if the page has none."""
    found = blocks(page or "")
    held = any(b[1] == "main" for b in found)
    labels = [first_pass(b, held) for b in found]
    size = len(found)
    # Second pass: distances to the decided blocks before and after, within one region.
    before: list[tuple[int, bool] | None] = [None] * size
    seen: dict[str, tuple[int, bool]] = {}
    for i in range(size):
        if labels[i] is not None:
            seen[found[i][1]] = (i, labels[i])
        before[i] = seen.get(found[i][1])
    seen = {}
    kept = []
    for i in range(size - 1, -1, -1):
        label = labels[i]
        region, tag = found[i][1], found[i][2]
        if label is not None:
            seen[region] = (i, label)
        else:
            left, right = before[i], seen.get(region)
            if left and right and left[1] != right[1]:
                near = right if tag in HEADINGS or right[0] - i < i - left[0] else left
                label = near[1]
            elif left or right:
                label = (left or right)[1]
            else:
                label = region == "main"
        if label:
            kept.append(found[i][0])
    return "\n".join(reversed(kept))


def extract(df: DataFrame, column: str = "html") -> DataFrame:
    """Adds ``text``, the main text of each whole page in ``column``.

    A null or empty page, and one without main text, gives an empty string. Each row gives one
    row, repeated rows too, and an empty table none. Other columns stay as they are; a column
    named ``text`` is replaced.
    """
    kept = [f for f in df.schema.fields if f.name != "text"]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "text string"])

    def run(batches):
        for batch in batches:
            at = {n: i for i, n in enumerate(batch.schema.names)}
            texts = [main_text(p) for p in batch.column(at[column]).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(at[f.name]) for f in kept] + [pa.array(texts, pa.string())],
                                             names=[f.name for f in kept] + ["text"])

    return df.mapInArrow(run, schema)
