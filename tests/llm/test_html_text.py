"""Block rules against written-out pages, a tree parser with full scans, and the marked articles of the test pages."""

import html
import re
from html.parser import HTMLParser

import pyarrow.parquet as pq
import pytest

from millrace.llm import html_text as H
from millrace.llm.queries import QUERIES

PROSE = ("The river that runs through the old town was for a long time the only way to bring wood and stone to the "
         "market, and the people who lived on its banks knew it as well as they knew each other. ")
OTHER = ("In the summer of that year the water was so low that it was possible to walk from one side to the other, and "
         "many of the houses on the north side have marks on their walls that show how high it had been before. ")


def page(body: str) -> str:
    return f"<!DOCTYPE html><html lang=en><head><title>T</title><style>p{{}}</style></head><body>{body}</body></html>"


NAV = '<nav><ul>' + ''.join(f'<li><a href="/{i}">Page number {i}</a></li>' for i in range(6)) + '</ul></nav>'
CASES = {
    "article": (f"{NAV}<header><h1>Site of the town</h1></header><article><h1>The river</h1><p>{PROSE}</p><p>Short.</p>"
                f"<p>{OTHER}</p></article><aside><p>{OTHER}</p></aside><footer>&copy; 2024 {PROSE}</footer>",
                ["The river", PROSE, "Short.", OTHER]),
    "no article element": (f"{NAV}<div id=w><h2>The river</h2><p>{PROSE}</p><p>Short.</p><p>{OTHER}</p></div><div>&copy; {PROSE}</div>",
                           ["The river", PROSE, "Short.", OTHER]),
    "comments": (f"<article><p>{PROSE}</p></article><section id='comments'><h3>2 comments</h3><article class=comment><p>{OTHER}</p>"
                 f"</article></section>", [PROSE]),
    "comments inside": (f"<article><p>{PROSE}</p><div class='post-comments'><p>{OTHER}</p></div></article>", [PROSE]),
    "notice, advert, form": (f"<div class='cookie-notice'><p>{OTHER}</p></div><main><p>{PROSE}</p><div class='ad-slot'>{OTHER}</div>"
                             f"<form><p>{OTHER}</p><input value='x'><textarea>{OTHER}</textarea></form></main>", [PROSE]),
    "link list": (f"<div><p>{PROSE}{PROSE}</p><p>{OTHER}</p><ul><li><a href=a>{PROSE}</a></li><li><a href=b>More</a></li></ul></div>",
                  [PROSE + PROSE, OTHER]),
    "link inside prose": (f"<div><p>{PROSE}<a href='x'>the bridge</a> {OTHER}</p></div>", [f"{PROSE}the bridge {OTHER}"]),
    "page in one form": (f"<form id=aspnet><div class=menu>{OTHER}</div><article><p>{PROSE}</p></article></form>", [PROSE]),
    "scripts and comments": (f"<article><!-- {OTHER} --><script>var t='</p>' + \"<article>\";</script><p>{PROSE}<script>x()</script></p>"
                             f"<style>p > a {{}}</style><noscript>{OTHER}</noscript><p hidden>{OTHER}</p></article>", [PROSE]),
    "references": ("<article><p>Fish &amp; chips &lt;b&gt; &eacute;&#233;&#xE9; &amp;amp; 1 < 2 a<5 &copy; &nbsp; end</p></article>",
                   ["Fish & chips <b> ééé &amp; 1 < 2 a<5 © end"]),
    "white space": ("<article><p>  one\n\t two <br> three<br/>four </p>\n\n<p> </p><pre>a\n  b</pre></article>",
                    ["one two three four", "a b"]),
    "not closed": (f"<article><h1>Head<p><b>{PROSE}<br><p>{OTHER}<ul><li>one<li>two</ul></div></article>",
                   ["Head", PROSE, OTHER, "one", "two"]),
    "quoted end of tag": (f"<article><p title='a > b' data-x=\"</p>\">{PROSE}</p></article>", [PROSE]),
    "classes that only mention": (f"<div class='content with-sidebar'><p>{PROSE}</p><p>{OTHER}</p></div>", [PROSE, OTHER]),
    "unknown language": ("<div>" + "<p>" + "Zorv klam brusk wendol pitra. " * 9 + "</p>" + "</div>", ["Zorv klam brusk wendol pitra. " * 9]),
    "unspaced script": ("<article><p>" + "これは川についての長い文章です。" * 9 + "</p></article>", ["これは川についての長い文章です。" * 9]),
    "one word": ("<article><h1>Be.</h1><p><b>Be.<br></article>" + NAV, ["Be.", "Be."]),
    "only a menu": (NAV, []),
    "plain text": (PROSE + OTHER, [PROSE + OTHER]),
}


@pytest.mark.parametrize("name", CASES)
def test_written_pages(name):
    body, want = CASES[name]
    assert H.main_text(page(body)).split("\n\n") == [" ".join(w.split()) for w in want] or (not want and H.main_text(page(body)) == "")


@pytest.mark.parametrize("text", ["", None, "<", "<>", "</", "<a", "<!--", "<!", "<p", "<script>", "</p></p>", "<p><p><p>", "&", "&#0;",
                                  "<a href='", "\x00", "<p>" * 3000 + "x", "<div>" * 3000 + "</div>" * 4000])
def test_malformed_pages_are_no_error(text):
    assert isinstance(H.main_text(text), str)


class Tree(HTMLParser):
    """Blocks by the tree parser of the standard library, for well-formed pages."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.path, self.found, self.now, self.skip = [], [], ["", ""], 0

    def cut(self):
        t, a = (" ".join(x.split()) for x in self.now)
        if t:
            self.found.append((t, len(a), [p for p in self.path]))
        self.now = ["", ""]

    def handle_starttag(self, tag, attrs):
        if tag in H.RAW:
            self.skip += 1
        elif tag in H.BLOCKS:
            self.cut()
            if self.path and self.path[-1][0] == "p":
                self.path.pop()
            self.path.append((tag, dict(attrs), len(self.found), object()))
        elif tag in ("a", "br"):
            self.path += [("a", {}, 0, object())] if tag == "a" else []
            self.now[0] += " " if tag == "br" else ""

    def handle_endtag(self, tag):
        if tag in H.RAW:
            self.skip -= 1
        elif tag in H.BLOCKS or tag == "a":
            if tag != "a":
                self.cut()
            for i in range(len(self.path) - 1, -1, -1):
                if self.path[i][0] == tag:
                    del self.path[i:]
                    break

    def handle_data(self, data):
        if not self.skip:
            self.now[0] += data
            if any(p[0] == "a" for p in self.path):
                self.now[1] += data


def plain_version(text):
    """Both passes by full scans over the tree parser's blocks."""
    t = Tree()
    t.feed(text or "")
    t.close()
    t.cut()
    B = []
    for words, linked, path in t.found:
        names = [p[0] for p in path]
        region = next((p[3] for p in path if p[0] in ("article", "main")), None)
        bad = any(p[0] in H.BAD_ELEMENTS or p[0] == "header" and not any(q in H.REGIONS for q in names[:names.index("header")])
                  or "hidden" in p[1] or p[0] not in ("html", "body", "main") and (
                      H.bad_names(p[1].get("class", "") or "") or H.bad_names(p[1].get("id", "") or "")) for p in path)
        B.append({"t": words, "a": linked, "path": [p[3] for p in path], "region": region, "bad": bad, "h": any(n in H.HEADINGS for n in names),
                  "s": H.stop_share(words)})
    known = any(b["s"] >= H.POOR and len(b["t"]) >= H.SHORT and not b["bad"] and b["a"] <= H.LINKS * len(b["t"]) for b in B)
    for b in B:
        s, n = (b["s"] if known else 1), len(b["t"])
        if b["bad"] or b["a"] > H.LINKS * n or ("©" in b["t"] and b["region"] is None):
            b["l"] = "bad"
        elif n < H.SHORT or (s < H.POOR and (b["region"] or not b["a"])):
            b["l"] = "short"
        else:
            b["l"] = "bad" if s < H.POOR else "good" if s >= H.RICH and n > H.LONG else "near"
    for kind in ("near", "short"):
        new = {}
        for i, b in enumerate(B):
            if b["l"] != kind:
                continue
            mates = [j for j, c in enumerate(B) if c["region"] is b["region"] and c["l"] in ("good", "bad") and not (c["bad"] and c["region"])]
            x, y = max((j for j in mates if j < i), default=None), min((j for j in mates if j > i), default=None)
            lx, ly = ((B[j]["l"] if j is not None else "good" if b["region"] else "bad") for j in (x, y))

            def away(j):
                return (abs(i - j), -sum(1 for _ in iter_same(b["path"], B[j]["path"]))) if j is not None else (len(B), 0)
            new[i] = (lx if lx == ly else "good" if kind == "near" else ly if b["h"]
                      else lx if away(x) < away(y) else ly if away(y) < away(x) else "bad")
        for i, label in new.items():
            B[i]["l"] = label
    good = [b for b in B if b["l"] == "good"]
    inside = [b for b in good if b["region"]]
    if inside and 2 * sum(len(b["t"]) for b in inside) >= sum(len(b["t"]) for b in good):
        good = inside
    return "\n\n".join(b["t"] for b in good)


def iter_same(a, b):
    for x, y in zip(a, b):
        if x is not y:
            return
        yield x


def test_equals_the_plain_version_without_region_marks_too():
    """The marked articles of the test pages, and the same pages with less and less markup to go by."""
    rows = pq.read_table("/root/testdata/sf0.01/pages.parquet").to_pylist()
    undo = [("<article>", "<div>"), ("</article>", "</div>"), ("<nav>", "<div>"), ("</nav>", "</div>"), ("<footer>", "<div>"),
            ("</footer>", "</div>"), ('class="ad"', 'class="x"')]
    for r in rows:
        p = re.sub("<script>.*?</script>", "", (r["html"] or "").replace("<b>", "").replace("</b>", ""))
        for i in range(0, len(undo) + 1):
            if i:
                p = p.replace(*undo[i - 1])
            if i in (0, 2, 4, 6, 7):
                assert H.main_text(p) == plain_version(p), (r["page_id"], i)


def articles(p):
    a = re.search(r"<article>(.*?)(</article>|\Z)", p, re.S)[1]
    parts = [re.sub("<[^>]*>", " ", x) for x in re.split("</?(?:p|h1)>", a)]
    return "\n\n".join(x for x in (" ".join(html.unescape(x).split()) for x in parts) if x)


def kept_and_added(got, want):
    """Shares of the wanted characters that are there, and of the given ones that were not wanted."""
    g, w = got.split("\n\n"), want.split("\n\n")
    return sum(len(x) for x in w if x in g), sum(map(len, w)), sum(len(x) for x in g if x not in w), sum(map(len, g))


def test_recall_where_the_article_is_not_marked():
    total = [0, 0, 0, 0]
    for r in pq.read_table("/root/testdata/sf0.01/pages.parquet").to_pylist():
        p = r["html"]
        for a, b in (("<article>", "<div>"), ("</article>", "</div>"), ('class="ad"', "")):
            p = p.replace(a, b)
        total = [x + y for x, y in zip(total, kept_and_added(H.main_text(p), articles(r["html"])))]
    assert total[0] >= 0.93 * total[1] and total[2] <= 0.02 * total[3]


def test_query_gives_the_marked_articles(spark):
    sf = "/root/testdata/sf0.001"
    given = {r["page_id"]: r for r in pq.read_table(f"{sf}/pages.parquet").to_pylist()}
    out = QUERIES["op11_block_rule_text"](spark, sf).collect()
    assert len(out) == len(given)
    for r in out:
        assert r["text"] == articles(given[r["page_id"]]["html"]) and r["url"] == given[r["page_id"]]["url"]
        assert r["n_chars"] == len(r["text"])


def test_edges(spark):
    long = "<article>" + f"<p>{PROSE}</p>" * 20_000 + "</article>"
    rows = [(1, "u", None), (2, None, ""), (None, "u", "<article><p>x</p></article>"), (3, "u", long), (3, "u", long), (4, "u", "<b>")]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "page_id long, url string, html string, text string, n_chars int")
    out = sorted(((r["page_id"] is None, r["page_id"] or 0, r["url"], r["text"]) for r in H.extract(df).collect()), key=repr)
    assert [r[3] for r in out] == ["", "", *[("\n\n".join([PROSE.strip()] * 20_000))] * 2, "", "x"]
    assert H.extract(df.limit(0)).count() == 0
