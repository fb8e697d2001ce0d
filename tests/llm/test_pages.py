"""Archives and pages."""

import base64
import gzip
import hashlib
import math
import random
from collections import Counter

import pytest

from sumwell.llm import html_density, warc
from sumwell.llm.html_density import extract_main_text, main_text, parse
from sumwell.llm.scratch import Scratch
from sumwell.llm.warc import archive_round_trip, chunk_rows, read_archives, repeated_payloads, write_archives

PAGES = [
    (1, "http://a", "<p>same</p>"), (2, "http://b", "<p>same</p>"), (3, None, None), (4, "http://d", ""), (5, "http://e\nx", "é漢" * 5000), (6, "http://f", "x\r\n\r\nWARC/1.1\r\n\r\n"), (7, "http://g", "<p>same</p>"), (8, "http://h", "y" * 100_000),
]
SCHEMA = "page_id long, url string, html string, digest string, size long, data string"


def pages(spark, rows=PAGES):
    return spark.createDataFrame([(*r, "d", 1, "x") for r in rows], SCHEMA).repartition(3)


@pytest.mark.parametrize("chunk", [1 << 18, 1000, 7])
def test_round_trip(spark, chunk):
    rows = PAGES if chunk > 7 else PAGES[:4] + PAGES[5:7]
    got = {r["page_id"]: r for r in archive_round_trip(pages(spark, rows), chunk=chunk).collect()}
    last = {}
    for i, _, h in rows:
        last[h or ""] = max(i, last.get(h or "", 0))
    assert len(got) == len(rows)
    for i, _, h in rows:
        data = (h or "").encode()
        g = got[i]
        assert (g["payload_bytes"], g["payload_digest"], g["verified"]) == (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), True)
        first = last[h or ""] == i
        assert (g["record_type"], g["refers_to"]) == (("response", None) if first else ("revisit", last[h or ""]))


def test_chunks_and_files(spark):
    s = Scratch(spark, "w")
    p = pages(spark)
    again = s.write(repeated_payloads(p, 1), "again")
    manifest = s.write(write_archives(chunk_rows(p, again, 4096), s.path("files"), 200), "manifest")
    assert manifest.count() > 3  # archives end at 200 bytes
    rows = read_archives(manifest, 4096).collect()
    body = {}
    for r in sorted(rows, key=lambda r: (r["record_id"], r["chunk_no"])):
        assert len(r["data"]) <= 4096
        body[r["record_id"]] = body.get(r["record_id"], b"") + bytes(r["data"])
        assert r["digest_so_far"] == hashlib.sha1(body[r["record_id"]]).hexdigest()
    texts = {i: (h or "").encode() for i, _, h in PAGES}
    assert all(body[i] == (b"" if i in (1, 2) else t) for i, t in texts.items())
    assert {r["record_id"] for r in rows if r["record_type"] == "revisit"} == {1, 2}  # empty payloads are below the limit
    for r in manifest.collect():
        raw = gzip.open(r["file"].removeprefix("file://")).read()
        assert raw.count(b"WARC-Record-ID: ") == r["records"] and raw.startswith(b"WARC/1.1\r\nWARC-Type: ")


@pytest.mark.parametrize("most", [100_000, 1])
def test_repeated_rows_and_shared_page_ids(spark, monkeypatch, most):
    monkeypatch.setattr(warc, "MAX_BROADCAST", most)
    rows = [(1, "u", "<p>a</p>"), (1, "u", "<p>a</p>"), (1, "u", "<p>b</p>"), (2, "v", "<p>b</p>"), (2, "v", "<p>b</p>"), (3, "w", None), (3, "w", ""), (None, "x", "<p>b</p>"), (None, "x", "alone"), (None, "y", "alone"), (None, "y", "once")]
    rows += [(10 + k, "z", "many") for k in range(40)]
    got = Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"], r["verified"]) for r in archive_round_trip(pages(spark, rows)).collect())
    last = {}
    for i, _, h in rows:
        if i is not None:
            last[h or ""] = max(i, last.get(h or "", i))

    def record(i, h):
        data, top = (h or "").encode(), last.get(h or "")
        return (i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), *(("response", None) if i == top else ("revisit", top)), True)

    assert got == Counter(record(i, h) for i, _, h in rows)


def test_a_revisit_has_no_bytes_of_its_own(spark):
    s = Scratch(spark, "w")
    p = pages(spark, PAGES[:2])
    again = repeated_payloads(p, 0)
    s.write(write_archives(chunk_rows(p, again), s.path("files")), "manifest")
    rows = [r for r in read_archives(spark.read.parquet(s.path("manifest"))).collect() if r["record_type"] == "revisit"]
    assert len(rows) == 1 and rows[0]["bytes_so_far"] == 0 and rows[0]["payload_length"] == len(PAGES[0][2])


def test_no_pages(spark):
    assert archive_round_trip(pages(spark, [])).count() == 0 and extract_main_text(pages(spark, [])).count() == 0


ARTICLE = "<article><h1>Title &amp; more</h1><p><b>First  part<br><p>Second\n part with <a href=x>a link</a> and text that goes on for a while.</p><p>Third one, long enough to count as text &eacute;&#233;&#x41;.</article>"
TEXT = "Title & more\nFirst part\nSecond part with a link and text that goes on for a while.\nThird one, long enough to count as text ééA."


@pytest.mark.parametrize(
    "page,want",
    [
        ("<html><head><title>t</title><style>p{}</style><script>var t='</p>';</script></head><body><nav><ul><li><a href=/a>Home</a><li><a href=/b>News</a></ul></nav><div class=\"ad box\">Buy now, a long advert text.</div>" + ARTICLE + "<footer>&copy; us</footer></body></html>", TEXT),
        ("<body><div id='sidebar'><p>side text that is rather long, longer than the text itself maybe</p></div><div id=main>" + ARTICLE + "<section class='comments'><p>reader says something long about it all, on and on</p></section><form><p>Your name</p></form></div>", TEXT),
        ("<body><header><p>Site name and slogan</p></header><div role=dialog>cookies</div>" + ARTICLE + "<aside>related</aside><p hidden>no</p>", TEXT),
        ("<p>only text", "only text"),
        ("plain", "plain"),
        ("", ""),
        (None, ""),
        ("<nav><a href=x>menu</a></nav>", ""),
        ("<!-- <p>no</p> --><body><p>yes &lt;b&gt;</p></body>", "yes <b>"),
        ("<body><p>kept</p><p>cut off <a href='x", "kept\ncut off"),
        ("<body><div><p>one</p>\n<p>two</p></div><table><tr><td>x<td>y</table>", "one\ntwo\nx\ny"),
        ("<p>" * 3000 + "deep" + "<div>" * 5000 + " end" + "</p>" * 3000, "deep\nend"),
    ],
)
def test_main_text(page, want):
    assert main_text(page) == want


def test_extraction_query(spark):
    rows = [(1, "u", ARTICLE), (2, None, None), (1, "u", ARTICLE), (None, "v", "<p>x</p>"), (4, "w", "<p>" + "word " * 100_000 + "</p>")]
    got = sorted(((str(r["page_id"]), r["url"], r["text"], r["n_chars"]) for r in extract_main_text(pages(spark, rows)).collect()), key=str)
    assert got == sorted([("1", "u", TEXT, len(TEXT)), ("2", None, "", 0), ("1", "u", TEXT, len(TEXT)), ("None", "v", "x", 1), ("4", "w", ("word " * 100_000).strip(), 499_999)], key=str)


LONG = [f"line {k} of the article " + "with some words of text " * 12 for k in range(6)]


@pytest.mark.parametrize("name", ["share-price-analysis", "related-work", "ad-hoc-networks", "social", "signup-page", "page with-comments", "notice-of-appeal"])
def test_names_do_not_remove_an_article(name):
    extra = "<div class='ad-box'>Buy now, a long advert text.</div><div class='related-posts'><p>see this as well, it is good</p></div><ol id=comment-list-2><li>a reader's remark, long enough to be text of its own</li></ol>"
    for article in ("<div class='{0}'>{1}</div>", "<div id={0!r}><div class='ad'>Buy more</div>{1}</div>"):
        page = "<body>" + LINKS + article.format(name, _paragraphs(LONG)) + extra + "</body>"
        assert main_text(page) == "\n".join(t.strip() for t in LONG)


@pytest.mark.parametrize("name", ["comments", "post-comments", "comment-list", "sideBar_left", "cookie-consent-banner-2", "social-media", "newsletter signup"])
def test_named_parts_go(name):
    side = "".join(f"<p>another voice {k} " + "says something at length about it " * 9 + "</p>" for k in range(12))
    page = "<body><article>" + _paragraphs(LONG) + f"</article><div class='{name}'>{side}</div></body>"
    assert main_text(page) == "\n".join(t.strip() for t in LONG)


def brute_densities(page):
    """Densities and sums by the formula, recursively over the parsed tree."""
    root, out = parse(page), {}
    whole = lambda n: [n.chars, n.link_chars] if not n.children else [sum(x) for x in zip([n.chars, n.link_chars], *[whole(c) for c in n.children if not isinstance(c, str)], strict=True)]
    c_b, lc_b = whole(root)

    def density(c, lc, t, lt):
        base = math.log(c / max(1, c - lc) * lc + lc_b / max(1, c_b) * c + math.e)
        return c / max(1, t) * max(0, math.log(c / max(1, lc) * max(1, t) / max(1, lt))) / max(0.05, math.log(base)) if c else 0.0

    def go(n):
        below = [go(c) for c in n.children if not isinstance(c, str) and not c.cut]
        c, lc, t, lt = (own + sum(b[k] + (k == 2) for b in below) for k, own in enumerate((n.chars, n.link_chars, n.tags, n.links)))
        own = n.chars * math.log(max(1, n.chars)) / max(0.05, math.log(math.log(lc_b / max(1, c_b) * n.chars + math.e))) if n.chars else 0.0
        out[id(n)] = (density(c, lc, t, lt), sum(b[4] for b in below) + own)
        return c, lc, t, lt, out[id(n)][0]

    go(root)
    return root, out


def test_densities_equal_the_formula():
    r = random.Random(3)

    def tree(depth):
        if not depth or r.random() < 0.2:
            return r.choice(["some text of a node ", "<a href=/x>a link</a> and text ", "x", "<b>bold</b> words here "]) * r.randrange(0, 9)
        return "".join(f"<{t}>{tree(depth - 1)}</{t}>" for t in r.choices(["div", "p", "section", "ul", "nav"], k=r.randrange(1, 4)))

    for _ in range(60):
        page = "<body>" + tree(4) + "</body>"
        root, want = brute_densities(page)
        kept, _ = html_density._score(root)
        assert all(want[id(n)] == pytest.approx((n.density, n.density_sum)) for n in kept)


LINKS = "<nav><ul>" + "".join(f"<li><a href=/{k}>menu item {k}</a></li>" for k in range(30)) + "</ul></nav>"
PARTS = [[f"part {a} paragraph {b} " + "some words of the article " * n for b in range(5)] for a, n in enumerate((12, 11, 10))]


def _paragraphs(texts):
    return "".join(f"<p>{t}</p>" for t in texts)


@pytest.mark.parametrize(
    "page",
    [
        "<article><section>{0}</section><section>{1}</section><section>{2}</section></article>",
        "<div class=part>{0}</div><div class=advert><p>Buy now, a long advert text.</p></div><div class=part>{1}</div><div><div>{2}</div></div>",
        "<div>{0}<table><tr><td>{1}</td></tr></table></div><ul><li><a href=/x>a list of</a></li><li><a href=/y>links</a></li></ul><blockquote>{2}</blockquote>",
    ],
)
def test_article_in_several_containers(page):
    page = "<body>" + LINKS + page.format(*map(_paragraphs, PARTS)) + "<footer>&copy; us</footer></body>"
    assert main_text(page) == "\n".join(t.strip() for part in PARTS for t in part)


def test_short_lead_and_loose_text_beside_a_long_list():
    lead, loose = "A lead that is much shorter than the list. " * 5, "Text of the body itself, of some length. " * 8
    items = ["an item of the list that goes on for a while " * 6 for _ in range(20)]
    page = "<body>" + LINKS + f"<p>{lead}</p><ol>" + "".join(f"<li>{t}" for t in items) + f"</ol>{loose}<div><a href=/z>see this as well</a></div></body>"
    assert main_text(page) == "\n".join(t.strip() for t in [lead, *items, loose])


@pytest.mark.parametrize("links", ["", LINKS])
@pytest.mark.parametrize("n", [2, 3, 10, 40])
def test_all_of_many_sections(n, links):
    texts = [[f"section {a} line {b} " + "words of it " * (3 if a % 4 == 2 else 25) for b in range(5)] for a in range(n)]
    page = "<body>" + links + "<main>" + "".join(f"<section>{_paragraphs(t)}</section>" for t in texts) + "</main><div><a href=/q>see this as well</a></div></body>"
    assert main_text(page) == "\n".join(t.strip() for part in texts for t in part)
