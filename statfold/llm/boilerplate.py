"""Main text of HTML pages by two-pass block rules.

A page is cut at its block-level tags. What stands in menus, page headers, footers, sidebars, forms and the
like goes by its element; what a class, id or role calls so goes too, unless it turns out to hold the main element,
or most of the text of a page without a marked article: names are habits, not facts. Of the other blocks the first pass decides the clear ones by link density, length
and stop-word density; in the second the short ones take the label of their nearest decided neighbours.
"""

from __future__ import annotations

import html as _html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from statfold.llm.common import field, pieces

LONG_CHARS = 140       # blocks from this length on are decided by their words
LINK_DENSITY = 0.5     # share of characters in links above which a block is a list of links
STOP_DENSITY = 0.05    # share of stop words from which a long block is running text

# fixed values: frequent function words of English, German, French and Spanish
STOP_WORDS = frozenset("""
a an and are as at be been but by can could did do does for from had has have he her his how if in into is it its me
my no not of on or our she so than that the their them then there these they this to up was we were what when which
who will with would you your
aber als am auch auf aus bei das dass dem den der des die durch ein eine einem einen einer er es für hat ich ihr im
ist mit nach nicht noch nur oder sein sich sie sind und von vor war wie wir zu zum zur über
au aux avec ce ces cette dans de des du elle en est et il ils je la le les leur lui mais ne nous on ou où par pas pour
qu que qui sa sans se ses son sont sur un une vous
al como con del el ella en entre era es ese esta este ha hay la las lo los más me muy no o para pero por que se sin
sobre son su sus también un una y ya
""".split())

BLOCK_TAGS = frozenset("""
address article aside blockquote body caption center col colgroup dd details dialog dir div dl dt fieldset figcaption
figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p
pre section select summary table tbody td tfoot th thead title tr ul
""".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW_TAGS = frozenset("script style title textarea noscript template iframe svg math noframes xmp".split())
#: elements that never hold article text
DROP_TAGS = frozenset("""
aside audio button canvas datalist dialog fieldset footer form head label menu nav object optgroup option select video
""".split())
#: words of class and id, and roles, of such elements
DROP_WORDS = frozenset("""
ad ads adsense advert advertisement advertising adverts banner breadcrumb breadcrumbs comment comments consent cookie
cookies copyright disclaimer disqus footer gdpr login masthead menu modal nav navbar navigation newsletter notice
notification overlay pager pagination popup promo promoted promotion recommended related replies reply respond search
share sharing sidebar signup skip social sponsor sponsored subscribe subscription teaser toolbar topbar widget
alert alertdialog complementary contentinfo
""".split())
#: words that stand beside them in a name without changing what it says
PLACE_WORDS = frozenset("""
site page main global top bottom left right primary secondary post article entry section block box container wrapper
list area inner outer bar item items sticky fixed mobile desktop js id
""".split())
#: reader comments, which may well be longer than the article
COMMENT_WORDS = frozenset("comment comments disqus replies reply respond".split())
DROP_ROLES = frozenset("""
alert alertdialog banner complementary contentinfo dialog form menu menubar navigation note search toolbar tooltip
""".split())
HEADER_WORDS = frozenset("header".split())
MOST = 0.5   # share of the page's text above which a wrapper is kept whatever it is called

_COMMENT = r"<!--.*?(?:-->|\Z)"
_PLAIN_TAG = r"<(?P<close2>/?)(?P<name2>[a-zA-Z][^\s/>]*)(?P<attrs2>[^>]*+)(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)"
_TAG = re.compile(_COMMENT + r"""|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)"""
                  r"""(?P<attrs>(?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|""" + _PLAIN_TAG, re.S)
# once a quote has run to the end of the page, later tags end at their first >: reading on is linear
_LOOSE_TAG = re.compile(_COMMENT + "|(?P<close>(?!))(?P<name>)(?P<attrs>)|" + _PLAIN_TAG, re.S)
_ATTR = re.compile(r"""([^\s"'=<>/]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>"']++)))?""")
_NAMED = re.compile(r"hidden|class|id|role|style", re.I)
_NONE = re.compile(r"display\s*:\s*none", re.I)
_SPLIT = re.compile(r"[^a-zA-Z]+|(?<=[a-z])(?=[A-Z])")
_WORD = re.compile(r"[^\W\d_]+")


@dataclass
class Block:
    text: str
    links: int               # characters in links
    container: bool          # inside article or main
    named: tuple[int, ...]   # the wrappers around it that are called something else than text


@dataclass
class Wrapper:
    """An element whose name says that it holds no article text."""
    comments: bool
    main: bool = False   # holds the main element
    mass: int = 0        # characters of running text


def _named(name: str, attrs: str, inside: bool) -> Wrapper | None:
    """The element as a wrapper if its attributes say that it holds no article text.

    Only whole names count: each word of a class or id must be such a word or one of place.
    """
    if name in ("html", "body", "main") or not attrs or not _NAMED.search(attrs):
        return None
    for key, *values in _ATTR.findall(attrs):
        key, value = key.lower(), "".join(values)
        if key == "hidden" and value.lower() not in ("false", "until-found"):
            return Wrapper(False)
        if (key == "aria-hidden" and value.strip().lower() == "true") or (key == "style" and _NONE.search(value)):
            return Wrapper(False)
        if key == "role" and value.strip().lower() in DROP_ROLES:
            return Wrapper(False)
        if key in ("class", "id"):
            for token in value.split():
                words = {w.lower() for w in _SPLIT.split(token) if w}
                told = words & DROP_WORDS or (not inside and words & HEADER_WORDS)
                if told and words <= DROP_WORDS | PLACE_WORDS | HEADER_WORDS:
                    return Wrapper(bool(words & COMMENT_WORDS))
    return None


def _dropped(name: str, inside: bool) -> bool:
    """True for elements that hold no article text."""
    return name in DROP_TAGS or (name == "header" and not inside)


def blocks(page: str) -> list[Block]:
    """Text blocks of a page in order, without those that go by their markup."""
    out: list[Block] = []
    wrappers: list[Wrapper] = []
    stack: list[tuple[str, bool, bool, tuple]] = []  # (element, dropped, container, wrappers) of what is open
    tags = _TAG
    count: dict[str, int] = {}  # open elements by name
    parts: list[str] = []
    linked: list[str] = []
    links = 0
    at, end = 0, len(page)

    def close() -> None:
        nonlocal parts, linked
        if parts:
            raw = "".join(parts)
            text = " ".join((_html.unescape(raw) if "&" in raw else raw).split())
            if text:
                link = " ".join(_html.unescape("".join(linked)).split())
                out.append(Block(text, len(link), bool(stack) and stack[-1][2], stack[-1][3] if stack else ()))
            parts, linked = [], []

    while at < end:
        m = tags.search(page, at)
        stop = m.start() if m else end
        if stop > at and not (stack and stack[-1][1]):
            parts.append(page[at:stop])
            if links:
                linked.append(page[at:stop])
        if not m:
            break
        at = m.end()
        name = (m["name"] or m["name2"] or "").lower()
        if not name:
            continue
        if m["name2"]:
            tags = _LOOSE_TAG
        if name == "br":
            parts.append(" ")
            continue
        if name in BLOCK_TAGS:
            close()
            links = 0
        if m["close"] or m["close2"]:
            if name == "a":
                links = max(0, links - 1)
            for k in range(len(stack) - 1, -1, -1) if count.get(name) else ():
                if stack[k][0] == name:
                    if name not in BLOCK_TAGS and any(x[0] in BLOCK_TAGS for x in stack[k + 1:]):
                        break  # a stray end of an inline element closes no block
                    if stack[-1][1:] != (stack[k - 1][1:] if k else (False, False, ())):
                        close()
                    for x, *_ in stack[k:]:
                        count[x] -= 1
                    del stack[k:]
                    break
            continue
        attrs = m["attrs"] or m["attrs2"] or ""
        if name in RAW_TAGS and not attrs.rstrip().endswith("/"):
            over = re.compile(rf"</{re.escape(name)}\b[^>]*+(?:>|\Z)", re.I).search(page, at)
            at = over.end() if over else end
            continue
        if name in VOID_TAGS or attrs.rstrip().endswith("/"):
            continue
        if name == "a":
            links += 1
        if name in ("p", "li", "dt", "dd", "option", "tr", "td", "th") and stack and stack[-1][0] == name:
            stack.pop()  # their end tags may be left out
            count[name] -= 1
        held = bool(stack) and stack[-1][2]
        container = held or name in ("article", "main")
        gone, around = (stack[-1][1], stack[-1][3]) if stack else (False, ())
        if not gone and _dropped(name, held):
            gone = True
            close()
        if not gone:
            wrapper = _named(name, attrs, held)
            if name == "main":
                for w in around:
                    wrappers[w].main = True
            if wrapper:
                close()
                around = (*around, len(wrappers))
                wrappers.append(wrapper)
        stack.append((name, gone, container, around))
        count[name] = count.get(name, 0) + 1
    close()
    return _kept(out, wrappers)


def _kept(found: list[Block], wrappers: list[Wrapper]) -> list[Block]:
    """The blocks outside all wrappers, and those in wrappers that hold the main element or most of the text.

    How much a wrapper holds counts only where no article or main element stands outside all wrappers.
    """
    if not wrappers:
        return found
    total = 0
    for b in found:
        size = len(b.text) if b.links <= LINK_DENSITY * len(b.text) else 0
        total += size
        for w in b.named:
            wrappers[w].mass += size
    marked = any(b.container and not b.named for b in found)
    kept = [w.main or not marked and (w.mass >= total if w.comments else w.mass > MOST * total) for w in wrappers]
    return [b for b in found if all(kept[w] for w in b.named)]


def stop_density(text: str) -> float:
    found = _WORD.findall(text.lower())
    return sum(w in STOP_WORDS for w in found) / len(found) if found else 0.0


def _first_pass(b: Block) -> bool | None:
    """Whether a block is article text, or None if it is too short to tell."""
    if b.links > LINK_DENSITY * len(b.text):
        return False
    if not b.container and b.text.lstrip().startswith(("©", "(c) ", "(C) ", "Copyright")):
        return False
    if len(b.text) >= LONG_CHARS:
        return b.container or stop_density(b.text) >= STOP_DENSITY
    return None


def _marked(found: list[Block]) -> bool:
    """True if article and main elements hold the larger share of the running text (a teaser does not)."""
    if not any(b.container for b in found):
        return False
    running = [b for b in found if b.links <= LINK_DENSITY * len(b.text)]
    spoken = [b for b in running if stop_density(b.text) >= STOP_DENSITY] or running
    inside = sum(len(b.text) for b in spoken if b.container)
    return 2 * inside >= sum(len(b.text) for b in spoken)


def main_text(page: str) -> str:
    """The article of a page: its blocks joined by one space, empty if there is none."""
    found = blocks(page)
    if _marked(found):  # what stands outside the article is not part of it
        found = [b for b in found if b.container]
    first = [_first_pass(b) for b in found]
    before, after, last = [], [], None
    for k, label in enumerate(first):
        last = k if label is not None else last
        before.append(last)
    last = None
    for k in range(len(first) - 1, -1, -1):
        last = k if first[k] is not None else last
        after.append(last)
    after.reverse()
    keep = []
    for k, label in enumerate(first):
        if label is None:  # of two neighbours equally near the one that is text counts; none: it stays
            p, n = before[k], after[k]
            near = min((k - p if p is not None else len(first)), (n - k if n is not None else len(first)))
            told = [first[j] for j in (p, n) if j is not None and abs(j - k) == near]
            label = any(told) if told else True
        keep.append(label)
    return " ".join(b.text for b, ok in zip(found, keep) if ok)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Rows (id, url, text, n_chars), one per page: the main text of the whole html.

    Null and empty pages, and pages without an article, have an empty text; an empty table gives an empty one.
    Null ids and urls, repeated rows and extra columns are ordinary. Pages of any length are read whole, in time
    that grows with the length. Between equally near neighbours of different kinds a short block counts as text.
    """
    schema = T.StructType([field(pages, id_col, id_col), field(pages, url_col, url_col),
                           T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    from pyspark.sql.pandas.types import to_arrow_schema
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 2):
            texts = [main_text(x or "") for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(arrow.field(0).type), batch.column(1).cast(arrow.field(1).type),
                 pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], schema=arrow)
    return pages.select(F.col(id_col), F.col(url_col), F.col(html_col).alias("_html")).mapInArrow(run, schema)
