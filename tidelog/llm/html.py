"""Main text of web pages by minimum-cut labelling.

A page is cut into blocks of text. What a block looks like (length, sentence, share of links, the place it stands in)
gives the cost of calling it content or boilerplate: edges to the two terminals. Neighbours in page order and in the
DOM are joined by smoothness edges, whose sum outweighs most costs, so that a one-word paragraph or a line of links
goes with what is around it. The minimum cut is the cheapest labelling.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter, deque
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

#: A comment, declaration or tag as browsers read them: quotes count after = alone, what is cut short ends with the page.
TOKEN = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*+(?:>|\Z)|</(?![a-z])[^>]*+(?:>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-z][^\s/>]*+)(?P<rest>(?:[^>=]++|=\s*+(?:\"[^\"]*\"|'[^']*')?+)*+)(?:>|\Z)",
    re.I | re.S,
)
NAMES = re.compile(r"(?<![\w-])(?:class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
WORD = re.compile(r"[a-z]+|[A-Z][a-z]*")
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose text isn't shown as text: read up to their end tag. Without one, the first kind takes the rest of the page, the second nothing.
RAW = frozenset("script style title textarea iframe xmp noembed noframes".split())
UNSEEN = frozenset("noscript template svg math select object canvas audio video button option datalist".split())
#: Open elements that a start tag closes, up to the nearest container.
CLOSES = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "tr": {"td", "th", "tr", "p"}}
SCOPES = frozenset("article aside blockquote body details div fieldset figure footer form header html li main nav ol section table td th ul".split())
#: Elements and names that tell the place of a block. A name is a class or id by its words; "with-sidebar" or "share-enabled" name no place.
CHROME_TAGS = frozenset("nav footer aside menu dialog header".split())
CHROME_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs consent contentinfo cookie cookies disclaimer footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notification outbrain overlay pager pagination popup promo promotion recommended related search share sharing sidebar signup skip social sponsor sponsored subscribe taboola toolbar topbar widget alert".split()
)
COMMENT_NAMES = frozenset("comment comments disqus discussion replies reply respond".split())
BODY_TAGS, BODY_NAMES = frozenset({"article", "main"}), frozenset("article articlebody content entry main post story text".split())
MODIFIERS = frozenset("has with without no not is js enabled disabled active open closed".split())
#: Costs by place: none known, article, chrome by name or by a form around it, chrome by element, readers' comments.
NONE, BODY, NAMED, CHROME, COMMENT = range(5)
PLACE = (0.0, 0.7, -1.6, -1.6, -2.2)
#: Smoothness: neighbours in page order (halved for each step between their parents), next of a parent, next of a grandparent.
NEXT, SIBLING, COUSIN = 0.6, 0.5, 0.3
#: Steps up from a block beyond which blocks aren't near in the DOM: an edge there would weigh next to nothing.
REACH = 8
#: Edges between blocks of unlike places count so much less.
ACROSS = 0.5


class Block(NamedTuple):
    text: str
    links: float  # share of link characters
    path: tuple[int, ...]  # ids of the elements around its own, innermost last, REACH at most
    place: int
    giver: int  # id of the element that gave the place
    heading: bool


def place_names(rest: str) -> set[str]:
    """The words of the class names, ids and roles of a start tag, without those that only modify."""
    out = set()
    for n in NAMES.finditer(rest):
        for token in (n[1] or n[2] or n[3] or "").split():
            words = [w.lower() for w in WORD.findall(token)]
            if len(words) == 1 or not MODIFIERS.intersection(words):
                out.update(words)
    return out


def place_of(tag: str, names: set[str], around: int) -> int:
    """The place that an element gives its text, from its tag, its names and the place around it."""
    if around in (CHROME, COMMENT):  # an <article> in there is a teaser or a comment
        return COMMENT if names & COMMENT_NAMES else around
    if tag in CHROME_TAGS and not (tag == "header" and around == BODY):
        return CHROME
    if tag in ("html", "body"):
        return around
    if names & COMMENT_NAMES:
        return COMMENT
    if tag in BODY_TAGS:
        return BODY
    if tag == "form" or names & CHROME_NAMES:
        return NAMED
    return BODY if names & BODY_NAMES else around


def blocks(page: str) -> list[Block]:
    """The blocks of text of a page in page order."""
    out: list[Block] = []
    stack: list[tuple[str, int, int, int]] = [("", 0, NONE, 0)]  # tag, id, place, giver
    scope = stack[:]  # those of the stack that are blocks
    open_: Counter[str] = Counter()
    held: list[str] = []
    links, number, at = 0, 0, 0
    unclosed: set[str] = set()

    def flush():
        nonlocal held, links
        if held and (text := " ".join("".join(held).split())):
            own = scope[-1]
            out.append(Block(text, min(1.0, links / len(text)), tuple(s[1] for s in scope[-REACH - 1 : -1]), own[2], own[3], own[0] in ("h1", "h2", "h3")))
        held, links = [], 0

    def say(raw: str):
        nonlocal links
        if raw:
            text = html.unescape(raw) if "&" in raw else raw
            held.append(text)
            if open_["a"]:
                links += len(" ".join(text.split()))

    def close(k: int):
        for s in stack[k:]:
            open_[s[0]] -= 1
            if s[0] in BLOCKS:
                scope.pop()
        del stack[k:]

    m = TOKEN.search(page)
    while m:
        say(page[at : m.start()])
        at = m.end()
        tag = (m["tag"] or "").lower()
        if tag in BLOCKS:
            flush()
        elif tag == "br":
            held.append(" ")
        if m["end"]:
            for k in range(len(stack) - 1 if open_[tag] else 0, 0, -1):
                if stack[k][0] == tag:
                    close(k)
                    break
                if stack[k][0] in SCOPES and tag not in SCOPES:
                    break
        elif tag in RAW or tag in UNSEEN:
            held.append(" ")
            if tag not in unclosed and not m["rest"].endswith("/"):
                end = re.compile(rf"</{tag}(?=[\s/>])[^>]*+(?:>|\Z)", re.I).search(page, at)
                if end:
                    at = end.end()
                elif tag in RAW:
                    at = len(page)
                else:
                    unclosed.add(tag)
        elif tag and tag not in VOID and not (m["rest"].endswith("/") and tag not in BLOCKS):
            shut = CLOSES.get(tag) or ({"p"} if tag in BLOCKS else {"a"} if tag == "a" else ())
            for k in range(len(stack) - 1 if any(open_[x] for x in shut) else 0, 0, -1):
                if stack[k][0] in shut:
                    close(k)
                    break
                if stack[k][0] in SCOPES:
                    break
            number += 1
            place, giver = stack[-1][2:]
            if tag in BLOCKS:
                new = place_of(tag, place_names(m["rest"]), place)
                if new != place:
                    place, giver = new, number
            open_[tag] += 1
            stack.append((tag, number, place, giver))
            if tag in BLOCKS:
                scope.append(stack[-1])
        m = TOKEN.search(page, at)
    say(page[at:])
    flush()
    return out


def costs(found: list[Block]) -> list[float]:
    """How much dearer it is to call each block boilerplate than content (negative: cheaper).

    A block of most of its article's text anchors it, however short. A form or a named element that holds over half
    of the text of a page without an article is a frame around it, and gives no place.
    """
    held: dict[int, int] = {}
    for b in found:
        held[b.giver] = held.get(b.giver, 0) + len(b.text)
    total, article = sum(held.values()), any(b.place == BODY for b in found)
    out = []
    for b in found:
        words = b.text.count(" ") + 1
        score = 1.2 * min(1.0, math.log2(words + 1) / 5) - 1.0 - 2.0 * b.links
        if words >= 4 and b.text[-1] in ".!?…\"'”»。":
            score += 0.3
        if not (b.place == NAMED and not article and 2 * held[b.giver] > total):
            score += PLACE[b.place]
        if b.place == BODY:
            score += 0.5 * len(b.text) / held[b.giver] + (0.4 if b.heading else 0)
        out.append(score)
    return out


def edges(found: list[Block]) -> list[tuple[int, int, float]]:
    """Smoothness edges between blocks that are near in page order or in the DOM."""
    out, last = [], {}
    for j, b in enumerate(found):
        ties = []
        if j:
            a = found[j - 1]
            up = {x: k for k, x in enumerate(reversed(a.path))}
            steps = next((k + up[x] for k, x in enumerate(reversed(b.path)) if x in up), None)
            ties.append((j - 1, NEXT * 0.5**steps if steps is not None else 0.0))
        for level, weight in ((1, SIBLING), (2, COUSIN)):
            if len(b.path) >= level:
                key = (level, b.path[-level])
                if key in last:
                    ties.append((last[key], weight))
                last[key] = j
        out += [(i, j, w if found[i].place == b.place else w * ACROSS) for i, w in ties]
    return out


def minimum_cut(costs: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """The labelling (True: content) that minimises the costs of labels plus the weights of edges between unlike ones.

    Of equal ones the one with the fewest blocks of content. Maximum flow by augmenting paths, one block of positive
    cost after the other: a search goes to the nearest block that still takes flow, and what it finds closed stays closed, so
    pages of very many blocks take local searches alone.
    """
    near: list[dict[int, float]] = [{} for _ in costs]
    for i, j, w in edges:
        if i != j:
            near[i][j] = near[i].get(j, 0.0) + w
            near[j][i] = near[j].get(i, 0.0) + w
    take = [max(0.0, -c) for c in costs]
    content = [False] * len(costs)
    for source, c in enumerate(costs):
        left = max(0.0, c)
        while left > 1e-12 and not content[source]:
            came: dict[int, int] = {source: source}
            queue, goal = deque([source]), -1
            while queue:
                i = queue.popleft()
                if take[i] > 1e-12:
                    goal = i
                    break
                for j, w in near[i].items():
                    if w > 1e-12 and j not in came and not content[j]:
                        came[j] = i
                        queue.append(j)
            if goal < 0:  # nothing that is reached takes more: the source side
                for i in came:
                    content[i] = True
                break
            path, i = [], goal
            while came[i] != i:
                path.append((came[i], i))
                i = came[i]
            f = min([left, take[goal], *(near[a][b] for a, b in path)])
            left -= f
            take[goal] -= f
            for a, b in path:
                near[a][b] -= f
                near[b][a] += f
    return content


def main_text(page: str | None) -> str:
    """The content blocks of a page, one a line."""
    found = blocks(page or "")
    return "\n".join(b.text for b, keep in zip(found, minimum_cut(costs(found), edges(found))) if keep)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row.

    Null, empty and textless pages give an empty text; broken markup is read as browsers do; a tag cut short ends with the page. Repeated rows
    come out as they went in. Only page_id, url and html are read. Empty input: empty result.
    """

    def run(batches):
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column("html")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"]
            )

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kind}, url string, text string, n_chars bigint")
