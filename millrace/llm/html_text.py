"""Main text of HTML pages by two passes of block rules.

A page is read once, tag by tag, into blocks: the text between two block-level
tags, with its characters inside links and the elements that it stands in.
Scripts, styles, comments and the like give no text.

Pass one looks at a block alone and calls it

* bad: inside an element that is by name, role, class or id a menu, page header
  or footer, sidebar, notice, advert, form or reader comment; or more than
  ``LINKS`` of its characters are in links; or it holds a copyright sign outside
  an article; or it is long, outside an article and poor in stop words;
* good: longer than ``LONG`` characters with a share of stop words of ``RICH``;
* near good: rich in stop words but shorter, or between ``POOR`` and ``RICH``;
* short: the rest (fewer than ``SHORT`` characters, or a long block that is poor
  in stop words but holds no link or stands in an article).

Pass two decides near good blocks and then short ones by the nearest decided
blocks before and after them: by their label if they agree; if not, near good
ones are good, a heading goes with what follows it, and others with the nearer
block, then with the one that shares more of its enclosing elements, then they
are bad. Inside an
``article`` or ``main`` element only its own blocks are neighbours, its edges
count as good, and bad elements inside it are passed over.

Where such elements hold at least half of the good characters of a page, what
lies outside them is not main text. A page in which no block has a share of
``POOR`` of known stop words is in a language without a list here: its blocks
are judged by length and links alone.

Character references are decoded once; white space inside a block, line breaks
included, becomes one space; blocks are joined in page order by an empty line.
Every page is worked on alone and whole in the task that reads it; no shuffle.

Rows: null and empty pages, and pages without main text, give an empty text; a
page without an id or address keeps nulls there; repeated rows each give a row;
an empty table gives none; other columns are not read, whatever their names.
Malformed markup is never an error: an end tag without its start is passed over,
an unclosed comment, script or style runs to the end of the page, an unfinished
tag at the end gives nothing, and a ``<`` that begins no tag is text.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import common

SHORT, LONG = 70, 200
POOR, RICH = 0.12, 0.2
LINKS = 0.2

# Frequent function words of European languages, by language
STOP_WORDS = frozenset((
    "the of and to in a is that for it was on with as be by at this are from or an not have has he she they we you i "
    "but his her their its which were been will would can there what when who if more no so all one do out up about "
    "der die das und ist in zu den von mit sich des auf für im dem nicht ein eine als auch es an werden aus er hat dass "
    "sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch "
    "le la les de des du et un une est en que qui dans pour pas au sur par il elle ce se ne son sa ses avec plus ou aux "
    "sont mais nous vous leur cette ces ont été comme être tout fait l d qu c s n j "
    "el los las del y una por con no su para lo como más pero sus este entre cuando muy sin sobre ser tiene también me "
    "hasta hay donde quien desde todo nos durante todos uno les ni contra otros ese eso ante ellos e esto mí "
    "il di che non per sono del della dei delle alla nel anche ma gli ha questo come più io "
    "o que não uma os as do da dos das em no na para com se por mais foi ao ele "
    "het een van niet zijn dat op te voor met ook maar aan bij").split())
# Characters that do the same work in scripts written without spaces
STOP_CHARACTERS = frozenset("的了是在和有不我也这就人一の に は を が で と も し た て る な".replace(" ", ""))

# Element names of HTML
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption "
                   "figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p "
                   "pre search section select button datalist summary table tbody td tfoot th thead tr ul caption".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript template iframe noembed noframes xmp svg object canvas audio "
                "video math".split())
BAD_ELEMENTS = frozenset("nav footer aside form dialog menu select button datalist search fieldset".split())
REGIONS = frozenset(("article", "main"))
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSED_BY = {"li": ("ul", "ol", "menu", "dir"), "dt": ("dl",), "dd": ("dl",), "td": ("tr", "table"), "th": ("tr", "table"),
             "tr": ("table",), "option": ("select", "datalist")}
BAD_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar "
                      "toolbar".split())
# Words of classes and ids; the first set whole, the second as beginnings
BAD_WORDS = frozenset("ad ads adv nav menu banner notice alert modal popup overlay consent gdpr sidebar aside widget share "
                      "sharing social related footer masthead topbar toolbar login signup signin register search form "
                      "toc skip rail legal copyright disclaimer reply replies respond responses".split())
BAD_STEMS = ("advert", "adsense", "sponsor", "promo", "navbar", "navig", "breadcrumb", "cookie", "newsletter", "subscri",
             "pagina", "recommend", "disqus", "comment", "dropdown", "teaser", "outbrain", "taboola")
GOOD_WORDS = frozenset("content article main post entry body text story page wrapper container".split())
DENIALS = frozenset("has with no without show hide is js".split())

_OTHER = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?/][^>]*(?:>|\Z)", re.S)
_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_QUOTED_TAG = re.compile(r"<(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>")
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_WORD = re.compile(r"[^\W\d_]+")
_UNSPACED = re.compile("[぀-ヿ㐀-鿿]")
_RAW_END = {n: re.compile(rf"</{n}(?=[\s/>]|\Z)", re.I) for n in RAW}


@dataclass(slots=True)
class Block:
    text: str
    in_links: int
    path: tuple[int, ...]       # numbers of the enclosing elements, outermost first
    region: int                 # the outermost article or main around it, or -1
    bad: bool                   # inside a bad element
    heading: bool
    share: float = 0.0
    label: str = ""


# -------------------------------------------------------------- reading a page


def _attributes(tag: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(tag)}


def bad_names(value: str) -> bool:
    """Whether a class or id attribute names something beside the main text."""
    found = False
    for name in value.split():
        parts = [p.lower() for p in _PART.findall(name)]
        if parts and all(p in GOOD_WORDS for p in parts):
            return False
        if parts and parts[0] not in DENIALS and any(p in BAD_WORDS or p.startswith(BAD_STEMS) for p in parts):
            found = True
    return found


def _is_bad(name: str, tag: str, inside_region: bool) -> bool:
    if name in BAD_ELEMENTS or name == "header" and not inside_region:
        return True
    if "=" not in tag and "hidden" not in tag or name in ("html", "body"):
        return False
    a = _attributes(tag)
    if "hidden" in a or a.get("aria-hidden", "").lower() == "true" or a.get("role", "").lower() in BAD_ROLES:
        return True
    if "display:none" in a.get("style", "").replace(" ", "").lower():
        return True
    return name != "main" and (bad_names(a.get("class", "")) or bad_names(a.get("id", "")))


def blocks(page: str) -> list[Block]:
    """The blocks of a page, in order."""
    out: list[Block] = []
    text: list[str] = []
    linked: list[str] = []
    stack: list[tuple[str, int, bool, int]] = []  # name, number, bad, region
    number, link = 0, -1                          # link: depth of the stack at the open link

    def flush() -> None:
        whole = " ".join(html.unescape("".join(text)).split()) if text else ""
        if whole:
            in_links = len(" ".join(html.unescape("".join(linked)).split())) if linked else 0
            out.append(Block(whole, in_links, tuple(s[1] for s in stack), stack[-1][3] if stack else -1,
                             bool(stack) and stack[-1][2], any(s[0] in HEADINGS for s in stack)))
        text.clear()
        linked.clear()

    def cut(depth: int) -> None:
        nonlocal link
        del stack[depth:]
        if link > depth:
            link = -1

    def add(piece: str) -> None:
        text.append(piece)
        if link >= 0:
            linked.append(piece)

    pos, end = 0, len(page)
    while pos < end:
        at = page.find("<", pos)
        if at < 0:
            add(page[pos:])
            break
        if at > pos:
            add(page[pos:at])
        m = _NAME.match(page, at)
        if not m:
            other = _OTHER.match(page, at)
            if other:
                if other[0].startswith("<![CDATA["):
                    add(html.escape(other[0][9:].removesuffix("]]>"), quote=False))
                pos = other.end()
            else:
                add("&lt;")
                pos = at + 1
            continue
        close = page.find(">", m.end())
        if close < 0:
            break  # an unfinished tag
        tag = page[at: close + 1]
        if tag.count('"') % 2 or tag.count("'") % 2:
            quoted = _QUOTED_TAG.match(page, at)
            tag = quoted[0] if quoted else tag
        pos = at + len(tag)
        name = m[1].lower()
        if tag[1] == "/":
            if name == "a":
                link = -1
            elif name in BLOCKS:
                flush()
                depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), None)
                if depth is not None:
                    cut(depth)
            elif name == "br":
                add(" ")
            continue
        if name in RAW:
            if not tag.endswith("/>") or name in ("script", "style", "title", "textarea", "iframe"):
                ends = _RAW_END[name].search(page, pos)
                stop = page.find(">", ends.end()) if ends else -1
                pos = stop + 1 if stop >= 0 else end
            add(" ")
        elif name == "a":
            link = len(stack) if "href" in tag.lower() else -1
        elif name == "br":
            add(" ")
        elif name in BLOCKS:
            flush()
            while stack and stack[-1][0] in ("p", *HEADINGS):  # no other block stands inside these
                cut(len(stack) - 1)
            if name in CLOSED_BY:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] in CLOSED_BY[name]:
                        break
                    if stack[i][0] == name or name in ("dt", "dd", "td", "th") and stack[i][0] in ("dt", "dd", "td", "th"):
                        cut(i)
                        break
            if name in VOID:
                continue
            number += 1
            above = stack[-1] if stack else ("", 0, False, -1)
            bad = above[2] and not (name in REGIONS and _only_forms(stack)) or _is_bad(name, tag, above[3] >= 0)
            region = number if name in REGIONS and above[3] < 0 and not bad else above[3]
            stack.append((name, number, bad, region))
    flush()
    return out


def _only_forms(stack: list[tuple]) -> bool:
    """Whether the bad elements around are forms only: some pages are one form."""
    return all(s[0] == "form" or not s[2] or i and stack[i - 1][2] for i, s in enumerate(stack))


# ------------------------------------------------------------- the two passes


def stop_share(text: str) -> float:
    """Share of stop words among the words; a character is a word in scripts without spaces."""
    words = _WORD.findall(text.lower())
    if not words:
        return 0.0
    unspaced = _UNSPACED.findall(text)
    if len(unspaced) * 4 > len(words):
        return sum(c in STOP_CHARACTERS for c in unspaced) / len(unspaced)
    return sum(w in STOP_WORDS for w in words) / len(words)


def first_pass(found: list[Block]) -> None:
    for b in found:
        b.share = stop_share(b.text)
    known = any(b.share >= POOR and len(b.text) >= SHORT and not b.bad and b.in_links <= LINKS * len(b.text) for b in found)
    for b in found:
        n = len(b.text)
        rich = b.share if known else 1.0
        if b.bad or b.in_links > LINKS * n or "©" in b.text and b.region < 0:
            b.label = "bad"
        elif n < SHORT:
            b.label = "short"
        elif rich >= RICH:
            b.label = "good" if n > LONG else "near"
        elif rich >= POOR:
            b.label = "near"
        else:
            b.label = "short" if b.region >= 0 or not b.in_links else "bad"


def _shared(a: Block, b: Block) -> int:
    """Number of enclosing elements that two blocks share."""
    n = 0
    for x, y in zip(a.path, b.path):
        if x != y:
            break
        n += 1
    return n


def _near(found: list[Block], order: range) -> list[int | None]:
    """The nearest decided block on one side of each block, as a place; in the block's own region."""
    last: dict[int, int] = {}
    near: list[int | None] = [None] * len(found)
    for i in order:
        b = found[i]
        near[i] = last.get(b.region)
        if b.label in ("good", "bad") and not (b.bad and b.region >= 0):
            last[b.region] = i
    return near


def _inherit(found: list[Block], undecided: str) -> None:
    """Decide the blocks of one label by their nearest decided neighbours."""
    before, after = _near(found, range(len(found))), _near(found, range(len(found) - 1, -1, -1))
    labels = {}
    for i, b in enumerate(found):
        if b.label != undecided:
            continue
        edge = "good" if b.region >= 0 else "bad"
        x, y = before[i], after[i]
        lx, ly = found[x].label if x is not None else edge, found[y].label if y is not None else edge
        if lx == ly or b.label == "near":
            labels[i] = "good" if "good" in (lx, ly) else "bad"
        elif b.heading:
            labels[i] = ly
        else:
            to_x = (i - x, -_shared(b, found[x])) if x is not None else (len(found), 0)
            to_y = (y - i, -_shared(b, found[y])) if y is not None else (len(found), 0)
            labels[i] = lx if to_x < to_y else ly if to_y < to_x else "bad"
    for i, label in labels.items():
        found[i].label = label


def second_pass(found: list[Block]) -> list[bool]:
    """Whether each block is main text; linear in the number of blocks."""
    for undecided in ("near", "short"):
        _inherit(found, undecided)
    size = sum(len(b.text) for b in found if b.label == "good")
    inside = sum(len(b.text) for b in found if b.label == "good" and b.region >= 0)
    only_regions = inside and 2 * inside >= size
    return [b.label == "good" and (b.region >= 0 or not only_regions) for b in found]


def main_text(page: str | None) -> str:
    found = blocks(page or "")
    first_pass(found)
    return "\n\n".join(b.text for b, keep in zip(found, second_pass(found)) if keep)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        raw, offsets = common.text_buffer(b.column("html"))
        for lo, hi in common.slices(offsets):
            texts = [main_text(raw[offsets[k]: offsets[k + 1]].tobytes().decode()) for k in range(lo, hi)]
            part = b.slice(lo, hi - lo)
            yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string())],
                                             names=["page_id", "url", "text"])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text) of every page."""
    common.start(pages.sparkSession)
    rows = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).cast("string").alias("url"),
                        F.col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(_rows, "page_id bigint, url string, text string")
