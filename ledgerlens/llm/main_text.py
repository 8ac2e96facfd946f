"""Main text of web pages: two passes of rules over text blocks.

A page is cut into blocks at block-level tags. Pass one labels each block: markup that never holds
article text is bad; otherwise link density, stop-word density and length decide between ``good``,
``bad`` and, for blocks too short to tell, ``short``. Pass two gives every short block the label of
its nearest decided neighbours. Blocks inside ``<article>`` or ``<main>`` are decided among
themselves, from the prior that the author marked them as content. Where ``<main>`` has good ones,
or articles hold at least half of all good text, nothing outside counts; where articles hold less,
they are cards that point to other pages, and the text outside is the page's own.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame

from .text import over_arrow

# Tags that start or end a block.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details div dl dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main nav ol option p pre "
    "section select summary table tbody td tfoot th thead title tr ul button textarea label".split())
# Elements whose text is no page text at all.
RAW_TAGS = frozenset("script style noscript template svg iframe math object canvas".split())
# Those whose content is not markup; those that nest; those that "/>" closes.
FLAT_TAGS = frozenset("script style noscript iframe".split())
NESTING_TAGS = RAW_TAGS - FLAT_TAGS
FOREIGN_TAGS = frozenset(("svg", "math"))
# Elements that hold no article text.
BAD_TAGS = frozenset("head title nav aside footer form button select textarea option label "
                     "fieldset menu dialog".split())
MAIN_TAGS = frozenset(("article", "main"))
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Words of class, id and role attributes that name page furniture.
BAD_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion nav "
    "navbar navigation menu breadcrumb breadcrumbs sidebar side header masthead footer comment "
    "comments reply replies respond disqus cookie cookies consent gdpr notice notices alert popup "
    "modal newsletter subscribe signup login share sharing social related recommended widget "
    "toolbar pagination pager copyright legal disclaimer complementary contentinfo search "
    "form tags skip".split())
# Parts of a name that say how an element is laid out, not what it holds.
LAYOUT_NAMES = frozenset(
    "area bar block body bottom box container div group holder inner item items left list outer "
    "right section top wrap wrapper".split())
# First parts of names for furniture that is there or absent elsewhere.
ABSENT_NAMES = frozenset("no not has with without".split())
# Parts of names that speak of an article.
ARTICLE_NAMES = frozenset("article post entry story".split())
# Parts of names before which "header" means the heading of an article.
HEADED_NAMES = ARTICLE_NAMES | {"content"}
# Elements whose ``<header>`` is their own, not the site's.
SECTION_TAGS = frozenset(("article", "main", "section"))
# Names that hide an element, as they are.
HIDDEN_NAMES = frozenset(("hidden", "visually-hidden"))
# Frequent words of the four languages of the tables, plus their articles.
STOP_WORDS = frozenset(
    "the a an of and to in is that it was for on are as with his they be at this have from or by "
    "one had not but what all were when we there can your which their if do will how about many "
    "then them these so some her would make like him into time has more no way could my than been "
    "der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch es an "
    "er hat aus bei sind noch nach wird einer um am sie wie war einen zum über so oder "
    "le la les de des un une et à en du dans que qui est pour pas par sur avec au aux ce ne se son "
    "sa ses il elle nous vous ils on plus ou mais comme tout sont été cette leur "
    "el los las y se del por con una su para es al lo como más pero sus este ha o entre cuando muy "
    "sin sobre también me hasta hay donde quien desde todo nos durante".split())

TOKEN = re.compile(
    r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:\s+|/|[^>\s\"'=]+|=\s*\"[^\"]*\"|=\s*'[^']*'|=|\"|')*)(?:>|$)"
    r"|</?$",
    re.DOTALL)
# Elements that a new one of the same kind ends, past these elements only.
SELF_ENDING = frozenset("p li tr td th dd dt option".split())
INLINE_TAGS = frozenset("b i em strong span".split())
ATTRIBUTE = re.compile(r"""([^\s"'/>=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
NO_DISPLAY = re.compile(r"(?:^|;)\s*display\s*:\s*none\b")
SPACE = re.compile(r"\s+")


@dataclass
class Block:
    """A stretch of text between block tags, and where it stood."""

    text: str
    linked: int      # characters of it inside links
    cut: bool        # inside page furniture
    main: bool       # inside the part marked as content
    sole: bool       # and that part is ``<main>``


def name_parts(token: str) -> list[str]:
    """Words of a name: ``mainNav_left`` has three."""
    return re.findall(r"[a-z]+", CAMEL.sub("-", token).lower())


def names_furniture(token: str) -> bool:
    """Does this name speak of page furniture?

    The last part that is not about layout decides: ``ad``, ``post-comments`` and ``main-nav`` do,
    and so does what starts with such a word (``comment-count``). ``no-sidebar`` speaks of an
    element elsewhere, and ``entry-header`` of the heading of an article.
    """
    if token.lower() in HIDDEN_NAMES:
        return True
    parts = name_parts(token)
    if not parts or parts[0] in ABSENT_NAMES:
        return False
    while len(parts) > 1 and parts[-1] in LAYOUT_NAMES:
        parts.pop()
    if parts[-1] == "header" and not HEADED_NAMES.isdisjoint(parts):
        return False
    return parts[0] in BAD_NAMES or parts[-1] in BAD_NAMES


def furniture(tag: str, attributes: str, sectioned: bool) -> tuple[bool, bool]:
    """Does this element hold page furniture, and is it a part whose header is its own?

    A ``<header>`` outside all such parts (``sectioned`` is false) is the site's, unless its name
    says that it heads an article.
    """
    own = tag in SECTION_TAGS
    if tag in BAD_TAGS:
        return True, own
    if tag in ("html", "body"):
        return False, own
    named = heads = False
    for name, value in ATTRIBUTE.findall(attributes) if attributes else ():
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" or name == "style" and NO_DISPLAY.search(value.lower()):
            return True, own
        if name in ("class", "id", "role"):
            tokens = value.split()
            named = named or any(map(names_furniture, tokens))
            heads = heads or any(not ARTICLE_NAMES.isdisjoint(name_parts(t)) for t in tokens)
    # what the author marked as the page's main part is no furniture by its layout's name
    cut = named and tag != "main" or tag == "header" and not (sectioned or heads)
    return cut, own or heads and not cut


def after_flat(page: str, tag: str, at: int) -> int:
    """Place after the end of an element whose content is no markup: its first closing tag."""
    stop = re.compile(rf"</{tag}\s*>", re.IGNORECASE).search(page, at)
    return stop.end() if stop else len(page)


def nested_ends(page: str) -> dict[int, int]:
    """Where the closed elements that nest end, by the end of their start tags."""
    ends: dict[int, int] = {}
    opened: dict[str, list[int]] = {tag: [] for tag in NESTING_TAGS}
    at = 0
    while match := TOKEN.search(page, at):
        at, tag = match.end(), (match[2] or "").lower()
        if tag in FLAT_TAGS and not match[1]:
            at = after_flat(page, tag, at)
        elif tag in NESTING_TAGS and match[1]:
            if opened[tag]:
                ends[opened[tag].pop()] = at
        elif tag in NESTING_TAGS and not (tag in FOREIGN_TAGS and match[0].endswith("/>")):
            opened[tag].append(at)
        if at >= len(page):
            break
    return ends


def blocks_of(page: str) -> list[Block]:
    """Cut a page into blocks; tolerates tags that are never closed and pages that break off."""
    found: list[Block] = []
    pieces: list[str] = []
    # open elements that matter: tag, is it furniture, is a header in it its own
    stack: list[tuple[str, bool, bool]] = []
    linked = links = at = 0
    nested: dict[int, int] | None = None

    def close() -> None:
        nonlocal linked
        text = SPACE.sub(" ", html.unescape("".join(pieces))).strip()
        if text:
            found.append(Block(text, linked, any(cut for _, cut, _ in stack),
                               any(t in MAIN_TAGS for t, _, _ in stack),
                               any(t == "main" for t, _, _ in stack)))
        pieces.clear()
        linked = 0

    def end(tag: str, through: frozenset[str] | None = None) -> None:
        """Leave the innermost open ``tag``; ``through``: only past such elements."""
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] == tag:
                close()
                del stack[k:]
                return
            if through is not None and stack[k][0] not in through:
                return

    while at < len(page):
        match = TOKEN.search(page, at)
        text = page[at:match.start()] if match else page[at:]
        if text:
            pieces.append(text)
            linked += len(html.unescape(text).strip()) if links else 0
        if not match:
            break
        at, tag = match.end(), (match[2] or "").lower()
        if tag in FLAT_TAGS and not match[1]:
            at = after_flat(page, tag, at)
        elif tag in NESTING_TAGS and not match[1]:
            if not (tag in FOREIGN_TAGS and match[0].endswith("/>")):
                nested = nested_ends(page) if nested is None else nested
                # unclosed, only the tag goes; what a template holds is never shown
                at = nested.get(at, len(page) if tag == "template" else at)
        elif tag == "br":
            pieces.append(" ")
        elif tag and match[1]:
            if tag == "a":
                links = max(0, links - 1)
            if tag in BLOCK_TAGS:
                close()
            end(tag)
        elif tag:
            cut, own = furniture(tag, match[3], any(o for _, _, o in stack))
            if tag in BLOCK_TAGS or cut:
                close()
                links = 0
            if tag in SELF_ENDING:
                end(tag, INLINE_TAGS)
            if (tag in BLOCK_TAGS or cut) and tag not in VOID_TAGS and not match[0].endswith("/>"):
                stack.append((tag, cut, own))
            links += tag == "a"
    close()
    return found


def first_labels(blocks: list[Block], max_link_density: float, min_stop_words: float,
                 short_chars: int) -> list[str]:
    """First pass: ``cut`` for furniture, else ``good``, ``bad`` or, if too short to tell, ``short``."""
    labels = []
    for b in blocks:
        words = b.text.lower().split()
        stops = sum(w.strip(".,;:!?()\"'") in STOP_WORDS for w in words) / len(words)
        if b.cut:
            label = "cut"
        elif b.linked > max_link_density * len(b.text):
            label = "short" if b.main else "bad"
        elif stops >= min_stop_words and len(b.text) >= short_chars:
            label = "good"
        elif b.main:
            label = "good" if len(b.text) >= short_chars else "short"
        else:
            label = "short" if len(b.text) < short_chars else "bad"
        labels.append(label)
    return labels


def settled(labels: list[str], main: list[bool]) -> list[str]:
    """Second pass: short blocks take the label of the nearest decided neighbour on their side.

    The earlier neighbour counts on a tie. Without one, a block marked as content is good and any
    other is bad. Cut blocks are no neighbours.
    """
    out = list(labels)
    for side in (True, False):
        own = [k for k, m in enumerate(main) if m == side and labels[k] != "cut"]
        decided = [(n, k) for n, k in enumerate(own) if labels[k] != "short"]
        j = 0
        for n, k in enumerate(own):
            if labels[k] == "short":
                while j + 1 < len(decided) and abs(decided[j + 1][0] - n) < abs(decided[j][0] - n):
                    j += 1
                out[k] = labels[decided[j][1]] if decided else "good" if side else "bad"
    return out


def marked_part(blocks: list[Block], labels: list[str], min_share: float) -> bool:
    """Is the part marked as content the page's main text?

    It is if ``<main>`` has good blocks, or if articles hold ``min_share`` of the good text.
    """
    good = [b for b, label in zip(blocks, labels) if label == "good"]
    inside = sum(len(b.text) for b in good if b.main)
    return any(b.sole for b in good) or inside >= min_share * sum(len(b.text) for b in good)


def extract(page: str | None, max_link_density: float = 0.5, min_stop_words: float = 0.05,
            short_chars: int = 60, min_marked_share: float = 0.5) -> str:
    """Main text of one page, blocks joined by a line break; empty if there is none."""
    blocks = blocks_of(page or "")
    labels = settled(first_labels(blocks, max_link_density, min_stop_words, short_chars),
                     [b.main for b in blocks])
    if any(b.main and label == "good" for b, label in zip(blocks, labels)):
        side = marked_part(blocks, labels, min_marked_share)
        labels = [label if b.main == side else "bad" for b, label in zip(blocks, labels)]
    return "\n".join(b.text for b, label in zip(blocks, labels) if label == "good")


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url",
              html_col: str = "html", **rules: float) -> DataFrame:
    """One row per page: id, url and ``text``.

    A null or empty page, or one without main text, gives an empty text. Repeated rows give
    repeated results. Only the three named columns are read.
    """
    kinds = dict(pages.dtypes)

    def run(batch):
        return (batch.column(0), batch.column(1),
                [extract(page, **rules) for page in batch.column(2).to_pylist()])

    return over_arrow(pages.select(id_col, url_col, html_col),
                      f"`{id_col}` {kinds[id_col]}, `{url_col}` {kinds[url_col]}, text string", run)
