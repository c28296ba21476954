import gzip
import json
import random
import time
from html.parser import HTMLParser

import pytest

from tessera.llm import warc


def members(data):
    out = []
    while data:
        headers, block = warc.parse(data)
        size = data.index(b"\r\n\r\n") + 4 + len(block) + 4
        out.append((headers, block))
        data = data[size:]
    return out


PAGE = """<!DOCTYPE html><html><head><title>A &amp; <b>B</b></title><style>p{x}</style><script>var t="</p>";</script></head>
<body><!-- no --><p>One  <i>two</i> &lt;three&gt;<br>four</p><ul><li><a class=x href="/a?b=1&amp;c=2">five</a></li><li><a href='/d'>six</a> <a href=/e>7</a></ul></body></html>"""


def test_text_links_and_title():
    assert warc.plain_text(PAGE) == "A & B\nOne two <three>\nfour\nfive\nsix 7"
    assert warc.links(PAGE) == ["/a?b=1&c=2", "/d", "/e"]
    assert warc.title(PAGE) == "A & B"
    assert warc.plain_text("<script>never closed <p>x") == "" and warc.plain_text("1 < 2 <b>b") == "1 < 2 b"


def test_records_are_linked_and_keep_headers():
    source = warc.response(7, "http://e.org/é", PAGE)
    headers, block = warc.parse(source)
    metadata, conversion = warc.derive_record(source)
    (m, facts), (c, text) = warc.parse(metadata), warc.parse(conversion)
    facts = json.loads(facts)
    assert facts["source"] == headers and facts["http"]["status"] == 200
    assert m["WARC-Refers-To"] == c["WARC-Refers-To"] == headers["WARC-Record-ID"]
    assert m["WARC-Target-URI"] == c["WARC-Target-URI"] == "http://e.org/é"
    assert len({headers["WARC-Record-ID"], m["WARC-Record-ID"], c["WARC-Record-ID"]}) == 3
    assert m["WARC-Type"] == "metadata" and c["WARC-Type"] == "conversion"
    assert facts["payload"]["digest-ok"] and facts["payload"]["block-digest-ok"]
    assert facts["payload"]["digest"] == headers["WARC-Payload-Digest"] == warc.digest(PAGE.encode())
    assert c["WARC-Block-Digest"] == warc.digest(text) and text.decode() == warc.plain_text(PAGE)
    assert warc.derive_record(source) == (metadata, conversion)


def test_odd_records():
    assert warc.derive_record(warc.derive_record(warc.response(1, "u", "x"))[0]) is None
    changed = warc.response(1, "u", "abc").replace(b"abc", b"abd")
    assert not json.loads(warc.parse(warc.derive_record(changed)[0])[1])["payload"]["digest-ok"]
    for broken in (b"", b"junk", warc.response(1, "u", "abc")[:-20], warc.build({"WARC-Type": "response"}, b"no http")):
        metadata, conversion = warc.derive_record(broken)
        assert json.loads(warc.parse(metadata)[1])["error"] and warc.parse(conversion)[1] == b""


def test_tables(spark, tmp_path):
    pages = [(1, "http://a", PAGE, "x"), (2, None, None, "x"), (2, "", "", "x"), (None, "http://b\r\nX: y", "<p>" * 50_000 + "end", None), (1, "http://a", PAGE, "x")]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string, record string")
    derived = warc.derive(warc.responses(frame))
    rows = warc.digests(derived).collect()
    assert len(rows) == len(pages)
    for r in rows:
        assert r.metadata_refers_to == r.conversion_refers_to == r.response_id and r.payload_ok and r.status == 200
    assert sorted((str(r.page_id), r.title, r.n_links, r.text_length) for r in rows)[:2] == [("1", "A & B", 3, len(warc.plain_text(PAGE)))] * 2
    warc.write(derived, str(tmp_path / "out"))
    assert warc.save(spark, str(tmp_path / "out"), str(tmp_path / "files")) == len(list((tmp_path / "files").glob("*.warc.w?t.gz")))
    again = warc.read(spark, str(tmp_path / "files")).collect()
    assert sorted(bytes(r.record)[:20] for r in again)[0].startswith(b"WARC/1.0") and len(again) == 2 * len(pages)
    assert {warc.field(warc.parse(bytes(r.record))[0], "WARC-Block-Digest") for r in again} >= {r.conversion_digest for r in rows}
    files = spark.read.parquet(str(tmp_path / "out")).collect()
    read = {k: [m for f in files if f.kind == k for m in members(gzip.decompress(bytes(f.data)))] for k in ("wat", "wet")}
    assert [len(x) for x in read.values()] == [len(pages)] * 2
    assert {h["WARC-Block-Digest"] for h, _ in read["wet"]} == {r.conversion_digest for r in rows}
    assert warc.digests(warc.derive(warc.responses(frame.limit(0)))).collect() == []


class Plain(HTMLParser):
    """The same rules by the library's parser: which tags break lines, what is left out."""

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.out, self.links, self.titles, self.skip, self.title = [], [], [], None, None
        self.feed(page)
        self.close()

    def handle_starttag(self, tag, attrs):
        if self.skip:
            return
        if tag == "a" and dict(reversed(attrs)).get("href") is not None:
            self.links.append(dict(reversed(attrs))["href"])
        if tag in warc.DROPPED:
            self.skip = tag
            self.out.append(" ")
        elif tag in warc.BREAKS:
            if tag == "title" and self.title is None:
                self.title = []
            self.out.append("\n")

    def handle_endtag(self, tag):
        if self.skip:
            self.skip = None if tag == self.skip else self.skip
        elif tag in warc.BREAKS:
            if tag == "title" and self.title is not None and not self.titles:
                self.titles.append(" ".join("".join(self.title).split()))
            self.out.append("\n")

    def handle_data(self, data):
        if not self.skip:
            self.out.append(data)
            if self.title is not None and not self.titles:
                self.title.append(data)

    def handle_comment(self, data):
        self.out.append("" if self.skip else " ")

    handle_decl = handle_pi = unknown_decl = handle_comment

    def text(self):
        lines = [" ".join(x.split()) for x in "".join(self.out).split("\n")]
        return "\n".join(x for x in lines if x)


def same(page):
    text, title, links = warc.scan(page)
    want = Plain(page)
    assert "\n".join(x for x in (" ".join(y.split()) for y in text.split("\n")) if x) == want.text(), page
    assert title == (want.titles or [""])[0] and links == want.links, page


def test_random_pages_equal_the_librarys_parser():
    rng = random.Random(4)
    texts = ["one", " two ", "a &amp; b", "&lt;p&gt;", "1 < 2", "x > y", "é", "&#233;", "\n", '"', "'"]

    def tree(depth):
        if depth == 0 or rng.random() < 0.3:
            return rng.choice(texts)
        tag = rng.choice(["p", "div", "b", "i", "a", "li", "span", "H2", "td", "custom-x", "svg"])
        attributes = "".join(rng.choice([' class=x', ' title="a > b"', " href='/q?a=1&amp;b=2'", " href=/u", ' HREF="w"', " data-href=no", " checked", ' x = "y"']) for _ in range(rng.randrange(3)))
        inner = "".join(tree(depth - 1) for _ in range(rng.randrange(4)))
        return rng.choice([f"<{tag}{attributes}>{inner}</{tag}>"] * 5 + [f"<br/>{inner}", f"<!-- {rng.choice(['c', '<p>', '<title>old</title>'])} -->{inner}", f"<script>{'if (a<b) {}'}</script>{inner}", f"<style>p>a</style>{inner}"])

    for _ in range(1500):
        same("<!DOCTYPE html><html><head><title>T &amp; t</title></head><body>" + "".join(tree(4) for _ in range(3)) + "</body></html>")


def test_all_pages_equal_the_librarys_parser(spark):
    for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect():
        same(r.html or "")


@pytest.mark.parametrize("unit", ["<a ", "<a href=", '<a href="', "<title>", "<script", "<script>", "<!--", "<!", "</", "<p '", "&", "<", "< a", "<a =", "<a  ", "<p/", '<b x="y">', "</script "])
def test_hostile_pages_take_linear_time(unit):
    page = unit * (2_000_000 // len(unit))
    began = time.time()
    warc.scan(page)
    assert time.time() - began < 10


def test_title_of_a_comment_and_odd_status():
    assert warc.title("<!-- <title>old</title> --><title>new</title>") == "new" and warc.title("<title>open") == ""
    assert warc.links('<a data-href="no" href="yes">') == ["yes"]
    for status in ("99999999999", "20", "2000", "abc", "²³¹"):
        record = warc.build({"WARC-Type": "response"}, f"HTTP/1.1 {status} OK\r\n\r\nx".encode())
        assert json.loads(warc.parse(warc.derive_record(record)[0])[1])["error"] == "no HTTP response"
    folded = b"WARC/1.0\r\nwarc-type: response\r\nX: a\r\n b\r\ncontent-length: 0\r\n\r\n"
    assert warc.parse(folded)[0]["X"] == "a b" and warc.derive_record(folded) is not None


def test_records_of_plain_and_packed_files():
    records = [warc.response(i, f"u{i}", f"<p>{i}</p>\r\n\r\n") for i in range(5)]
    for data in (b"".join(records), b"".join(map(gzip.compress, records)), gzip.compress(b"".join(records))):
        assert [warc.parse(x) for x in warc.records_of(data)] == [warc.parse(x) for x in records]
    assert list(warc.records_of(b"")) == [] and list(warc.records_of(b"junk")) == [b"junk"]
