"""Main text of html pages by two-pass block rules.

A scanner cuts the page at block tags, in time linear in the page; script,
style and the like are skipped whole; comments, nav, header (outside the
article), footer, aside, forms and elements whose class, id or role names an
advert, a notice, a menu, a share bar or a comment section are excluded
containers.  Inside an article or main element fewer names exclude, and an id
only as a whole, as headings and sections carry ids of their own.  An article
or main element bounds the text.  Tokens of a class that tell an element's
state, topic or layout (``has-sidebar``, ``category-legal``) name nothing.
Where names exclude the only article element, or leave no block of more than
some words, the page is read again with names as whole tokens only, then with
those of comments, adverts and cookie notices only; tags exclude always.

Pass one judges each block alone: link density, length and stop-word density
make it good, bad, or, if short or a heading, undecided.  On a page that holds
next to none of the known stop words (another language), length and link
density alone decide.  Inside an article link-dense blocks are undecided, not
bad, as lists of links may be its text.  Pass two gives undecided blocks the
label of the nearest decided neighbour (at equal distance, good if both are);
headings take the side that follows; excluded containers are no neighbours.
Where no neighbour is decided, blocks stay inside an article, and on a page
without any decided block those without many links stay.

Defined results: null and empty html give the empty string, html without tags
its own text; unclosed and stray tags close at the next fitting one, the end
tag of an inline element only inside its block; a tag that meets another "<"
before its ">" is text; a block goes on after an excluded inline element;
unknown character references stay as text; white space inside a block is one
space.  Repeated rows and ids each give a row; extra columns are not read.
"""

import html as html_lib
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segq.llm.common import tune

#: Stop words of the four languages in use; fixed values, replaceable.
STOP_WORDS = frozenset(
    "a an and are as at be by for from has he in is it its of on or that the this to was were will with you not but have had they his her "
    "der die das und ist ein eine einen den dem des von zu mit sich auf für im nicht auch es an als wie oder aus bei "
    "le la les un une et est en de du des que qui dans pour par sur pas au avec ce il elle ne se sont plus "
    "el los las un una y en de del que por con para se su al lo como más o es no".split()
)
SKIP = frozenset("script style noscript template svg iframe object head title select button textarea canvas video audio".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
EXCLUDE = frozenset("nav footer aside form menu dialog".split())
#: Names of what is left out; fixed values.  A class or role matches by any of
#: its tokens, as a whole or at a hyphen or underscore.
OUTER = (
    r"ads?|advert\w*|adsense|banner|promo\w*|sponsor\w*|cookies?|consent|gdpr|notices?|newsletter|subscri\w*|sidebars?|side-?bar|menu\w*|nav\w*|breadcrumbs?|footer|masthead|header|comments?|comment-?list|disqus|replies|reply|respond|discussion|share|sharing|social|related|recommend\w*|popup|modal|overlay|login|signup|search|pagination|pager|toolbar|widget\w*|copyright|legal|disclaimer"
)
BAD_NAME = re.compile(rf"(?<![a-z])({OUTER})(?![a-z])")
#: Names that exclude inside an article.
INNER = r"ads?|advert\w*|adsense|banner|promo\w*|sponsor\w*|cookies?|consent|gdpr|notices?|newsletter|subscri\w*|sidebars?|side-?bar|menu\w*|nav\w*|breadcrumbs?|footer|comments?|comment-?list|disqus\w*|respond|share|sharing|social|related|recommend\w*|popup|modal|overlay|login|signup|pagination|pager|toolbar|widget\w*"
INNER_NAME = re.compile(rf"(?<![a-z])({INNER})(?![a-z])")
#: Tokens that say something about an element and do not name it: its state,
#: its topic, its kind, or that it is laid out around such a part.
MODIFIER = re.compile(r"(has|no|non|not|with|without|category|cat|tag|topic|type|format|is|post|hentry|status|author|section-type|theme|skin|js|u|l)[-_].*|.*[-_]{1,2}(with|without|has|no|above|below|left|right|top|bottom)[-_].*|.*[-_](layout|grid|theme|page|enabled|disabled|visible|hidden|open|closed|less|free)")
#: Names that always exclude, also where stricter readings of names give a page
#: no text: reader comments, adverts and notices of cookies.
ALWAYS = re.compile(r"comments?|comment[-_]?list|disqus\w*|respond|ads?|advert\w*|adsense|cookies?|cookie[-_].*|consent|gdpr")
#: Readings of names, strictest first.
ANY_PART, WHOLE, SURE = 0, 1, 2
#: Possessive parts: a tag is tried once, up to the next "<" outside quotes.
TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^<>=]++|=\s*+(?:"[^"]*+"|'[^']*+'|))*+)>""", re.S)
NAMES = re.compile(r"""(?<![\w-])(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
ENDS = {name: re.compile(rf"</{name}(?![a-z0-9:-])[^<>]*+>?", re.I) for name in SKIP}
SPACE = re.compile(r"\s+")
SHORT, LONG, LINKS, LOW, HIGH, KNOWN = 70, 200, 0.33, 0.10, 0.20, 0.03
GOOD, BAD, OPEN = 1, 0, 2


class Block:
    __slots__ = ("parts", "linked", "tag", "inside", "out")

    def __init__(self, tag: str, inside: bool, out: bool):
        self.parts, self.linked, self.tag, self.inside, self.out = [], 0, tag, inside, out

    def text(self) -> str:
        return SPACE.sub(" ", html_lib.unescape("".join(self.parts))).strip()


class Open:
    """Open elements: (name, excludes, bounds, excludes by its tag), with the
    places of each name and of blocks, so that no end tag searches the stack."""

    def __init__(self):
        self.items, self.places, self.blocks, self.out, self.inside, self.tags = [], {}, [], 0, 0, 0

    def push(self, name: str, bad: bool, main: bool, tag: bool) -> None:
        self.places.setdefault(name, []).append(len(self.items))
        if name in BLOCK:
            self.blocks.append(len(self.items))
        self.items.append((name, bad, main, tag))
        self.out += bad
        self.tags += tag
        self.inside += main

    def pop(self) -> None:
        name, bad, main, tag = self.items.pop()
        self.places[name].pop()
        if name in BLOCK:
            self.blocks.pop()
        self.out -= bad
        self.inside -= main
        self.tags -= tag

    def close(self, name: str) -> None:
        """Close the innermost element of the name and what is inside it."""
        if self.places.get(name):
            while self.items[-1][0] != name:
                self.pop()
            self.pop()

    def inline(self, name: str) -> bool:
        """Whether an inline element of the name is open in the innermost block."""
        places = self.places.get(name)
        return bool(places) and places[-1] > (self.blocks[-1] if self.blocks else -1)

    def top(self) -> str:
        return self.items[-1][0] if self.items else ""


def excludes(name: str, rest: str, inside: bool, reading: int = ANY_PART) -> bool:
    """Whether the element's class, id or role names something left out."""
    for kind, value in NAMES.findall(rest):
        tokens = value.strip("\"'").lower().split()
        whole = reading == WHOLE or (inside and kind.lower() == "id")
        for token in tokens:
            if reading == SURE:
                found = ALWAYS.fullmatch(token)
            elif MODIFIER.fullmatch(token):
                found = None
            else:
                names = INNER_NAME if inside else BAD_NAME
                found = names.fullmatch(token) if whole else names.search(token)
            if found:
                return True
    return False


def blocks_of(page: str, reading: int = ANY_PART) -> tuple[list[tuple[str, float, str, bool, bool]], bool, bool]:
    """(text, link density, tag, inside the article, excluded) of each block,
    whether the page has an article or main element, and whether it has one
    only inside an element that a name excludes."""
    found: list[Block] = []
    stack, endless, links, has_main, lost = Open(), set(), 0, False, False
    now, held = Block("", False, False), None  # held: a block that an excluded inline element interrupts
    at, size = 0, len(page)
    while at < size:
        m = TOKEN.search(page, at)
        text = page[at : m.start()] if m else page[at:]
        if text:
            now.parts.append(text)
            if links:
                now.linked += len(SPACE.sub(" ", html_lib.unescape(text)).strip())
        if not m:
            break
        at = m.end()
        if m[2] is None:
            continue
        name, closing, rest = m[2].lower(), m[1] == "/", m[3]
        if name == "br":
            now.parts.append("\n")
            continue
        if name == "a":
            links = 0 if closing else 1
            continue
        if not closing and name in SKIP and not rest.rstrip().endswith("/"):
            end = None if name in endless else ENDS[name].search(page, at)
            if end is None:
                endless.add(name)  # none further on either
            at = end.end() if end else (size if name in ("script", "style", "template", "textarea") else at)
            if name not in ("script", "style", "noscript", "template"):
                now.parts.append(" ")
            continue
        block = name in BLOCK
        if not block and name not in VOID:
            if name in SKIP or not (stack.inline(name) or (not closing and NAMES.search(rest))):
                continue
        if closing:
            stack.close(name)
        elif name not in VOID:
            if name in ("p", "li", "dt", "dd", "tr", "td", "th") and stack.top() == name:  # their end tags may be left out
                stack.pop()
            main = name in ("article", "main") and not stack.out
            lost |= name in ("article", "main") and stack.out > 0 and not stack.tags
            tag = name in EXCLUDE or (name == "header" and not stack.inside)
            bad = tag or (not main and name not in ("body", "html") and excludes(name, rest, stack.inside > 0, reading))
            stack.push(name, bad, main, tag)
            has_main |= main
        out, inside = stack.out > 0, stack.inside > 0
        if block:
            found += [now] if held is None else [held, now]
            held = None
            links = 0
            now = Block(name, inside, out)
        elif now.out != out:
            if out:
                held, now = now, Block(now.tag, inside, True)
            elif held is not None:
                now, held = held, None
            else:
                found.append(now)
                now = Block(now.tag, inside, False)
    found += [now] if held is None else [held, now]
    rows = []
    for b in found:
        text = b.text()
        if text:
            rows.append((text, min(1.0, b.linked / len(text)), b.tag, b.inside, b.out))
    return rows, has_main, lost and not has_main


def stop_words(text: str) -> tuple[int, int]:
    """How many words are stop words, and how many words there are."""
    words = text.lower().split()
    return sum(w.strip(".,;:!?\"'()") in STOP_WORDS for w in words), len(words)


def heading(tag: str) -> bool:
    return tag[:1] == "h" and tag[1:].isdigit()


def first_pass(text: str, density: float, tag: str, inside: bool, out: bool, has_main: bool, stop: float, known: bool) -> int:
    if out or (has_main and not inside):
        return BAD
    if density > LINKS:
        return OPEN if inside else BAD
    if heading(tag) or len(text) < SHORT:
        return OPEN
    if stop >= HIGH or (len(text) >= LONG and (stop >= LOW or not known)):
        return GOOD
    return OPEN if stop >= LOW or inside or not known else BAD


def labels(rows: list[tuple[str, float, str, bool, bool]], has_main: bool) -> list[bool]:
    counts = [stop_words(r[0]) for r in rows]
    own = [c for c, r in zip(counts, rows) if not r[4]]
    known = sum(c[0] for c in own) >= KNOWN * sum(c[1] for c in own)
    marks = [first_pass(*r, has_main, c[0] / max(1, c[1]), known) for r, c in zip(rows, counts)]
    n = len(marks)

    def nearest(order) -> list[tuple[int, int] | None]:
        """(place, label) of the decided neighbour before each block."""
        out, last = [None] * n, None
        for i in order:
            out[i] = last
            if marks[i] != OPEN and not rows[i][4]:
                last = (i, marks[i])
        return out

    before, after = nearest(range(n)), nearest(range(n - 1, -1, -1))
    decided = any(m != OPEN and not r[4] for m, r in zip(marks, rows))
    keep = []
    for i, (mark, row) in enumerate(zip(marks, rows)):
        left, right = before[i], after[i]
        if mark != OPEN:
            keep.append(mark == GOOD)
        elif has_main and left is None and right is None:
            keep.append(True)
        elif not decided:
            keep.append(row[1] <= LINKS)
        elif heading(row[2]) and right is not None:
            keep.append(right[1] == GOOD)
        elif left is None or right is None:
            keep.append((left or right)[1] == GOOD)
        elif i - left[0] == right[0] - i:
            keep.append(left[1] == right[1] == GOOD)
        else:
            keep.append((left if i - left[0] < right[0] - i else right)[1] == GOOD)
    return keep


def good(rows: list[tuple[str, float, str, bool, bool]], keep: list[bool]) -> bool:
    """Whether a block that was kept is more than a short one."""
    return any(k and len(r[0]) >= SHORT for r, k in zip(rows, keep))


def main_text(page: str | None) -> str:
    first = None
    for reading in (ANY_PART, WHOLE, SURE):
        rows, has_main, lost = blocks_of(page or "", reading)
        keep = labels(rows, has_main)
        text = "\n".join(r[0] for r, k in zip(rows, keep) if k)
        if not lost and (good(rows, keep) or not any(r[4] for r in rows)):
            return text
        first = text if first is None else first
        if not lost and text and not any(len(r[0]) >= SHORT for r in rows if r[4]):
            break  # what is excluded holds no article either
    return first if not good(rows, keep) else text


def html_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""
    tune(pages.sparkSession)

    def extract(htmls: pd.Series) -> pd.DataFrame:
        texts = [main_text(x) for x in htmls]
        return pd.DataFrame({"text": texts, "n_chars": [len(x) for x in texts]})

    found = F.pandas_udf(extract, "text string, n_chars bigint")(F.coalesce(F.col(html_col), F.lit("")))
    return pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), found.alias("x")).select("page_id", "url", "x.*")
