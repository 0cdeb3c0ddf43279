import gzip
import time
import zlib
from html.parser import HTMLParser

from helpers import SF, rows, table

from veridoc.llm import warc as W
from veridoc.llm.queries import queries


class Plain(HTMLParser):
    """Visible words by the standard parser."""

    def __init__(self):
        super().__init__()
        self.out, self.hide = [], 0

    def handle_starttag(self, tag, attrs):
        self.hide += tag in ("script", "style", "title")
        self.out.append(" ") if tag not in ("b", "a") else None

    def handle_endtag(self, tag):
        self.hide -= tag in ("script", "style", "title")
        self.out.append(" ") if tag not in ("b", "a") else None

    def handle_data(self, data):
        if not self.hide:
            self.out.append(data)


def test_text_is_what_a_parser_shows(spark):
    for page in table(spark, "pages").limit(50).collect():
        p = Plain()
        p.feed(page["html"])
        p.close()
        assert W.to_text(page["html"]).split() == "".join(p.out).split()


def test_links_and_digests(spark):
    pages = table(spark, "pages")
    sources = {r["source_id"]: r for r in W.responses(pages).collect()}
    made = queries()["op2_warc"](spark, SF).collect()
    assert len(made) == 2 * len(sources)
    for r in made:
        source = sources[r["page_id"]]
        headers, body = W.split_http(bytes(source["block"]))
        assert r["refers_to"] == source["record_id"] and r["target_uri"] == source["target_uri"] and r["source_headers"] == headers
        assert r["payload_digest"] == source["payload_digest"] == W.digest(body)
        assert r["block_digest"] == W.digest(r["content"].encode()) and r["length"] == len(r["content"].encode())


def test_round_trip_of_files(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a/", "<title>T &amp; U</title><p>x<br>y &lt; z<script>1</p></script>"), (2, None, None), (3, "http://b/", ""), (3, "http://b/", "<!-- never closed <p>x"), (4, "u", "a < b <img alt='>'>c <a href=/q?a=1&amp;b=2>d</a>")], "page_id long, url string, html string").withColumn("block", W.F.lit(1))
    responses = W.responses(pages)
    derived = W.derive(responses)
    members = W.serialize(responses.union(derived)).collect()
    (tmp_path / "x.warc.gz").write_bytes(b"".join(bytes(m["member"]) for m in members))
    again = W.read_records(spark, str(tmp_path / "x.warc.gz"))
    keep = ("record_id", "type", "date", "target_uri", "content_type", "refers_to", "block_digest", "length", "block")
    assert sorted(rows(again.select(*keep)), key=str) == sorted(rows(responses.union(derived).select(*keep)), key=str)
    assert sorted(rows(W.derive(again).drop("source_id")), key=str) == sorted(rows(derived.drop("source_id")), key=str)
    text = {(r["source_id"], r["type"]): bytes(r["block"]).decode() for r in derived.collect() if r["source_id"] in (1, 2, 4)}
    assert text[1, "conversion"] == "x\ny < z" and text[2, "conversion"] == ""
    assert text[4, "conversion"] == "a < b c d" and "outlink: /q?a=1&b=2\r\n" in text[4, "metadata"]
    assert "title: T & U\r\n" in text[1, "metadata"]
    assert rows(W.derive(W.responses(pages.limit(0)))) == []


def test_unclosed_markup_takes_time_in_proportion():
    for piece in ("<div ", "<script ", '<a href="', "<!-- ", "<title>", "<a x=' ", "<p class=a'b ", "</script ", "<script>"):
        times = []
        for n in (100_000, 1_000_000):
            page = "x" + piece * (n // len(piece))
            start = time.time()
            W.Page(page).describe("", "")
            W.to_text(page)
            times.append(time.time() - start)
        assert times[1] < 2 + 30 * times[0], piece
        assert W.to_text(page).startswith("x")


def test_bodies_are_decoded_by_their_headers():
    text = "<p>é ü 漢</p>"
    head = lambda *x: "HTTP/1.1 200 OK\r\n" + "".join(f"{y}\r\n" for y in x)
    raw = text.encode()
    chunked = b"5;x=1\r\n" + raw[:5] + b"\r\n" + f"{len(raw) - 5:x}".encode() + b"\r\n" + raw[5:] + b"\r\n0\r\n\r\n"
    assert W.decoded(head(), raw) == W.decoded(head("Content-Type: text/html; charset=nonsense"), raw) == text
    assert W.decoded(head("Content-Type: text/html; charset=utf-16"), text.encode("utf-16")) == text
    assert W.decoded(head(), b"<meta charset=latin-1>\xe9") == "<meta charset=latin-1>é"
    assert W.decoded(head("Content-Encoding: gzip"), gzip.compress(raw)) == W.decoded(head("Content-Encoding: gzip"), raw) == text
    assert W.decoded(head("Content-Encoding: deflate"), zlib.compress(raw)) == text
    assert W.decoded(head("Transfer-Encoding: chunked"), chunked) == W.decoded(head("Transfer-Encoding: chunked"), raw) == text


def test_blocks_that_hold_the_bytes_between_records(spark, tmp_path):
    made = W._batch([(None, f"<urn:{i}>", "resource", "d", "u", "text/plain", None, "", W.digest(b), W.digest(b), len(b), b) for i, b in enumerate([b"a\r\n\r\nWARC/1.1\r\nWARC-Type: x\r\n\r\nb", b"", b"\xff\x00" * 500, b"end\r\n\r\n"])])
    data = b"".join(map(W.spell, made.to_pylist()))
    for name, packed in (("x.warc", data), ("y.warc.gz", b"".join(gzip.compress(W.spell(r)) for r in made.to_pylist()))):
        (tmp_path / name).write_bytes(packed)
        got = sorted((r["record_id"], bytes(r["block"])) for r in W.read_records(spark, str(tmp_path / name)).collect())
        assert got == sorted((r["record_id"], r["block"]) for r in made.to_pylist())
