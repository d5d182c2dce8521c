"""Main text of web pages by tree scoring.

Paragraphs pass points for their length and commas to their ancestors, an ancestor's points are discounted by its link
density, and the best container is kept with those siblings that score well; what is in a menu, header, footer, sidebar,
notice, advert, form (form controls too), script, style or reader comment never counts; nor does what is only shown in place of media or
scripts (noscript, iframe, canvas, audio, video). What names an element as such is a class or id word that is known for it alone, or
made up of known words only (`site-menu`, not `market-share`). Blocks that are links and nothing else go only as a list of them. One
map-only pass over pages, linear in a page's length whatever its depth; a page is the unit of work.

Null or empty html, and pages without text: text is '' and n_chars 0. Null page_id or url stay null. Repeated rows give
repeated rows. Other columns, whatever their names, are ignored. Containers that tie: the first in page order.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections import defaultdict

from pyspark.sql import DataFrame, SparkSession

from .common import per_row, table

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)([^>]*+)>",
    re.DOTALL,
)
#: One attribute: its name and, by its quotes, its value; a value is consumed with its name, so that nothing in it is taken for one.
_ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>][^\s>]*)))?|\"[^\"]*\"|'[^']*'")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript iframe template svg annotation annotation-xml select button canvas audio video".split())
_BLOCK = frozenset(
    "html body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table caption thead tbody tfoot tr td th blockquote pre figure figcaption hr header footer nav aside form fieldset address details summary center hgroup search dialog head".split()
)
_NEVER = frozenset("head nav footer aside form dialog search".split())
#: Words of class and id names: of elements that are no part of an article,
_UNLIKELY = frozenset(
    "ad ads adbox advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner sidebar sidebars rail menu menus nav navbar navigation topnav breadcrumb breadcrumbs pagination pager header masthead topbar footer cookie cookies consent gdpr notice notices notification alert popup modal overlay comment comments commentlist disqus replies share sharing social related recommended widget subscribe subscription newsletter signup login form search".split()
)
#: of these, those that name such an element beside any other word,
_STRONG = frozenset("ad ads adbox advert adverts advertisement advertising adsense sponsored sidebar sidebars navbar topnav breadcrumb breadcrumbs pagination masthead cookie cookies gdpr popup commentlist disqus newsletter".split())
#: and words that stand beside them without naming anything else.
_BESIDE = frozenset(
    "site page main top bottom left right global primary secondary sub mini mobile desktop sticky fixed float floating box bar block list lists link links button buttons btn icon icons wrap wrapper container inner outer section area panel pane item items module post posts article articles content blog user account email media field toggle message msg text title drop down dropdown slot unit zone col column row group js id wp the".split()
)
#: Beside these a word tells a state or the way a page is laid out.
_STATES = frozenset("no not non has have with without is are open closed enabled disabled active off".split())
#: Headers of an article, not of a site.
_OWN_HEADER = frozenset("article entry post story section content chapter title figure table".split())
#: Whole class words of main and article elements that are readers' comments.
_REPLIES = frozenset("comment comments commentlist disqus replies".split())
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar".split())
_CLOSES = {t: frozenset({"p"}) for t in _BLOCK} | {"li": frozenset({"p", "li"}), "dt": frozenset({"p", "dt", "dd"}), "dd": frozenset({"p", "dt", "dd"}), "tr": frozenset({"p", "td", "th", "tr"}), "td": frozenset({"p", "td", "th"}), "th": frozenset({"p", "td", "th"})}
#: Elements that an implied end tag doesn't reach over.
_WALL = frozenset("html body main article section div ul ol dl table blockquote td th figure form".split())
_SCORED = frozenset("p pre blockquote td li dd".split())
#: Blocks that make up menus where they are links only.
_LISTED = frozenset("li td th div dd dt".split())
_HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())


def _no_article(word: str, in_article: bool) -> bool:
    """Whether a word of a class or id attribute names an element that is no part of an article."""
    if word in _UNLIKELY:
        return word != "header" or not in_article
    parts = [x for x in re.split(r"[_:-]+", word) if x and not x.isdigit()]
    known = _UNLIKELY.intersection(parts)
    if not known or not _STATES.isdisjoint(parts):
        return False
    if known == {"header"} and (in_article or not _OWN_HEADER.isdisjoint(parts)):
        return False
    return not _STRONG.isdisjoint(parts) or all(x in _UNLIKELY or x in _BESIDE or x in _OWN_HEADER for x in parts)


def _dropped(tag: str, attributes: str, in_article: bool) -> bool:
    if tag in _NEVER or tag == "header" and not in_article:
        return True
    if not attributes or tag in ("html", "body"):
        return False
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = (m[1] or "").lower(), (m[2] or m[3] or m[4] or "").lower()
        if name == "class" and "hidden" in (whole := value.split()):
            return True
        if name == "class" and tag in ("main", "article"):
            if not _REPLIES.isdisjoint(whole):
                return True
        elif name in ("class", "id") and tag not in ("main", "article"):
            if any(_no_article(x, in_article) for x in value.split()):
                return True
        elif name == "role":
            if value in _ROLES:
                return True
        elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"(?<![\w-])display\s*:\s*none", value):
            return True
    return False


def blocks(page: str) -> tuple[list[tuple[str, int, int, str]], list[int], list[str]]:
    """The page's text blocks (text, element, link characters, tag) outside of dropped elements; each element's parent and tag."""
    parents, tags = [-1], ["#root"]
    stack, dropped, links, articles = [0], 0, 0, 0  # dropped: depth of the outermost dropped element on the stack
    places: dict[str, list[int]] = defaultdict(list)  # of each tag on the stack
    on_block, on_wall = [0], [0]  # places of block elements, and of walls
    found: list[tuple[str, int, int, str]] = []
    text: list[str] = []
    linked = 0

    def flush() -> None:
        nonlocal linked
        if text:
            s = "".join(text)
            if "&" in s:
                s = html.unescape(s)
            if s := " ".join(s.split()):
                at = stack[on_block[-1]]
                found.append((s, at, min(linked, len(s)), tags[at]))
            text.clear()
        linked = 0

    def pop(to: int) -> None:
        nonlocal dropped, links, articles
        for i in reversed(stack[to:]):
            places[tags[i]].pop()
            links -= tags[i] == "a"
            articles -= tags[i] in ("article", "main")
        del stack[to:]
        for on in (on_block, on_wall):
            while on[-1] >= to:
                on.pop()
        if dropped and len(stack) <= dropped:
            dropped = 0

    def say(s: str) -> None:
        nonlocal linked
        if s and not dropped:
            text.append(s)
            if links:
                linked += len(s)

    at = 0
    while m := _TAG.search(page, at):
        say(page[at : m.start()])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if m[1] or m[4]:
            if tag in _BLOCK:
                flush()
            if places[tag] and (tag in _BLOCK or places[tag][-1] > on_block[-1]):
                pop(places[tag][-1])
            continue
        if tag == "br":
            say(" ")
        if tag in _BLOCK:
            flush()
            closes, k = _CLOSES[tag], len(on_wall) - 1
            while k > 0 and tags[stack[on_wall[k]]] in closes:
                k -= 1
            wall = on_wall[k]
            ends = [p[i] for t in closes if (p := places[t]) and (i := bisect_right(p, wall)) < len(p)]
            if ends:
                pop(min(ends))
        if tag in _VOID:
            continue
        if tag in _RAW:
            end = re.compile(rf"</{tag}\s*>", re.IGNORECASE).search(page, at)
            at = end.end() if end else len(page)
            continue
        if (m[3] or m[6] or "").endswith("/") and tag not in _BLOCK:
            continue
        parents.append(stack[-1])
        tags.append(tag)
        places[tag].append(len(stack))
        if tag in _BLOCK:
            on_block.append(len(stack))
        if tag in _WALL:
            on_wall.append(len(stack))
        stack.append(len(tags) - 1)
        links += tag == "a"
        articles += tag in ("article", "main")
        if not dropped and _dropped(tag, m[3] or m[6] or "", articles > 0):
            dropped = len(stack) - 1
    say(page[at:])
    flush()
    return found, parents, tags


def main_text(page: str | None) -> str:
    found, parents, tags = blocks(page or "")
    if not found:
        return ""
    # Of each element: characters and link characters below it (link density counts all), blocks, blocks that are but links, and points.
    n, linked, many, bare, points = ([0] * len(tags) for _ in range(5))
    last: dict[int, str] = {}
    scored = set()
    for s, at, in_links, tag in found:
        n[at] += len(s)
        linked[at] += in_links
        many[at] += 1
        bare[at] += in_links >= 0.8 * len(s)
        last[at] = s
        if tag not in _HEADING:
            to = parents[at] if tag in _SCORED else at
            points[to] += (1 + s.count(",") + min(len(s) / 100, 3)) * (1 - in_links / len(s))
            scored.add(to)
    for i in range(len(tags) - 1, 0, -1):  # an ancestor gets half of what the element below it has
        up = parents[i]
        n[up] += n[i]
        linked[up] += linked[i]
        many[up] += many[i]
        bare[up] += bare[i]
        points[up] += points[i] / 2
        if i in scored:
            scored.add(up)
    score = {i: (points[i] + (25.0 if tags[i] in ("article", "main") else 0.0)) * (1 - linked[i] / n[i]) for i in scored if i > 0}
    if not score:
        score = {found[0][1]: 1.0}
    best = max(score, key=lambda i: (score[i], -i))
    up = best
    while up > 0:  # sections of one article belong together
        if tags[up] in ("article", "main") and score.get(up, 0) > 0:
            best = up
        up = parents[up]
    least, keep = max(10.0, score.get(best, 0) * 0.2), {best}
    if best > 0 and tags[best] not in ("body", "html"):
        for i, parent in enumerate(parents):
            if parent == parents[best] and n[i] and i != best:
                few = n[i] > 80 and linked[i] < 0.25 * n[i] or linked[i] == 0 and i in last and last[i].endswith((".", "!", "?"))
                if score.get(i, 0) >= least or tags[i] == "h1" and i < best or tags[i] == "p" and i in last and few:
                    keep.add(i)
    inside: dict[int, bool] = {-1: False}
    for i, parent in enumerate(parents):
        inside[i] = i in keep or inside[parent]

    def listed(at: int, in_links: int, s: str, tag: str) -> bool:
        """Whether a block is one of a list of links: what stands beside it is links, too."""
        if in_links < 0.8 * len(s) or tag not in _LISTED or tags[best] in ("article", "main"):
            return False
        up = parents[at]
        return bare[up] > 1 and bare[up] == many[up]

    return "\n\n".join(s for s, at, in_links, tag in found if inside[at] and not listed(at, in_links, s, tag))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) of each row of pages (page_id, url, html)."""

    def rows(found: list[str | None]) -> list[tuple]:
        return [(t, len(t)) for t in map(main_text, found)]

    return per_row(pages, ["page_id", "url"], "html", rows, "text string, n_chars long")


def op1_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
