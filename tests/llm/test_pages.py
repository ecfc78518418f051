"""Page operators and the pipeline."""

import base64
import hashlib
import io
import zlib

from risegraph.llm import html_text, warc

PAGES = "page_id long, url string, html string, doc_id long, text string, sha1 string"


def pages(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", "y") for r in rows], PAGES) if rows else spark.createDataFrame([], PAGES)


def test_main_text():
    body = "<article><h1>A title</h1><p>First &amp; long paragraph of the article with many words in it.</p><p>Short.</p></article>"
    around = ("<nav><ul><li><a href='/a'>One</a><li><a href='/b'>Two</a></ul></nav><div class='cookie-notice'>We use cookies and more.</div>"
              "{}<div class=\"comments\"><p>A reader's long comment that is nothing of the article itself.</p></div>"
              "<form>Name <input><button>Send</button></form><footer>&copy; someone</footer><script>var a = '<p>no</p>';</script>")
    expected = "A title\n\nFirst & long paragraph of the article with many words in it.\n\nShort."
    assert html_text.main_text(f"<html><head><title>T</title></head><body>{around.format(body)}</body></html>") == expected
    assert html_text.main_text("<body>" + around.format(body.replace("article>", "div>"))) == expected
    assert html_text.main_text(around.format(body)[:-30]) == expected
    assert html_text.main_text("") == "" and html_text.main_text("<p></p>") == "" and html_text.main_text("only text") == "only text"
    assert html_text.main_text("<p>a\n\t b<br>c &#x41;&lt;&am") == "a b c A<&am"
    assert html_text.main_text("<p>x</p>" * 3000).count("x") == 3000
    assert html_text.main_text("<div>" * 2000 + "deep") == "deep"


LONG = "<p>A paragraph that is long enough to be the text of a page, with some more words.</p>"
WORDS = "A paragraph that is long enough to be the text of a page, with some more words."


def test_wrapped_articles_and_inline_marks():
    for around in ("<div class='layout has-sidebar'>{}</div>", "<div id='page' class='with-banner'>{}</div>", "<form>{}</form>",
                   "<div class='search-page'><div class='no-ads'>{}</div></div>"):
        for own in ("<article>%s</article>", "<main>%s</main>", "<article class='sidebar-left'>%s</article>"):
            assert html_text.main_text(around.format(own % LONG)) == WORDS
    # without anything else, what a form or a mark encloses is content; beside other text it isn't
    assert html_text.main_text(f"<form>{LONG}</form>") == html_text.main_text(f"<div class=widget>{LONG}</div>") == WORDS
    assert html_text.main_text(f"<form>{LONG}</form><p>Other text of the page.</p>") == "Other text of the page."
    assert html_text.main_text("<article><p>One <span class='related-term'>word</span> <b id=ad>in</b> it.</p></article>") == "One word in it."
    # a reader's article among the comments doesn't count beside the page's own
    assert html_text.main_text(f"<article><p>Mine is here.</p></article><section class=comments><article>{LONG}</article></section>") == "Mine is here."
    assert html_text.main_text(f"<aside><article>{LONG}</article></aside><p>Mine is here.</p>") == "Mine is here."


def test_the_smoothed_ratio_decides_without_markup():
    menu = "".join(f"<div><a href='/{i}'>Menu item {i}</a></div>" for i in range(8))
    body = f"<h2>A title</h2>{LONG}<p>Short.</p>{LONG * 2}<div><a>A list of</a> <a>links inside</a></div>{LONG}"
    page = f"<div><div>{menu}</div><div>{body}</div><div>{menu}</div></div>"
    expected = "\n\n".join(["A title", WORDS, "Short.", WORDS, WORDS, "A list of links inside", WORDS])
    assert html_text.main_text(page) == expected
    lines = html_text.LineEvents()
    lines.feed(page)
    assert len(lines.finish()) == 16 + 7
    tags = "".join(f"<div><b>{i}</b><b>x</b><b>y</b></div>" for i in range(9))  # many tags, few characters, no link
    assert html_text.main_text(f"<div>{tags}{LONG * 3}{tags}</div>").count(WORDS) == 3
    assert len(html_text.main_text(f"<div>{tags}{LONG * 3}{tags}</div>").split("\n\n")) < 12


def test_extract(spark):
    rows = [(1, "u", "<p>Some text</p>"), (2, None, None), (None, "v", ""), (1, "u", "<p>Some text</p>")]
    got = sorted(map(tuple, html_text.extract(pages(spark, rows)).collect()), key=str)
    assert got == sorted([(1, "u", "Some text", 9), (2, None, "", 0), (None, "v", "", 0), (1, "u", "Some text", 9)], key=str)
    assert html_text.extract(pages(spark, [])).collect() == []


def test_warc_round_trip(spark):
    long = "".join(chr(97 + i % 26) for i in range(300_000))
    rows = [(1, "http://a/", "same"), (2, "http://b/?q=\"x\"\r\n", "same"), (3, None, None), (4, "u", ""), (5, "u", long), (6, "u", long),
            (7, "u", "é\r\n\r\nWARC/1.1\r\n\r\n"), (None, "u", "same"), (None, "u", "alone"), (1, "http://a/", "same"), (0, "u", "last")]
    expected = []
    first = {}
    for p, _, h in rows:
        if p is not None:
            first[h or ""] = min(p, first.get(h or "", p))
    for p, _, h in rows:
        raw = (h or "").encode()
        ref = first.get(h or "")
        ref = None if ref == p else ref
        expected.append((p, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if ref is None else "revisit", ref))
    assert sorted(map(tuple, warc.warc_round_trip(pages(spark, rows)).collect()), key=str) == sorted(expected, key=str)
    small = {r["page_id"]: r for r in warc.warc_round_trip(pages(spark, rows), min_bytes=5).collect()}
    assert small[2]["record_type"] == "response" and small[6]["refers_to"] == 5
    assert warc.warc_round_trip(pages(spark, [])).collect() == []


def test_normalised_members_and_index():
    records = []
    for i, (payload, ref) in enumerate([(b"x" * 200_000, None), (b"", None), (b"x" * 200_000, 0)]):
        head, http = warc.record_head(i, f"http://h/{i}", len(payload), hashlib.sha1(payload).digest(), ref)
        records.append(head + http + (payload if ref is None else b"") + b"\r\n\r\n")
    cut = len(records[0]) // 2
    whole = b"".join(records)
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    second = zlib.compressobj(6, zlib.DEFLATED, 31)  # a stream of two members, cut inside a record
    source = packer.compress(whole[:cut]) + packer.flush() + second.compress(whole[cut:]) + second.flush()
    sink = io.BytesIO()
    index = warc.normalise_stream(io.BytesIO(source), sink)
    assert [x[2] for x in index] == [0, 1, 2] and index[0][3] == "http://h/0"
    for record, (at, n, _, _) in zip(records, index):
        member = sink.getvalue()[at:at + n]
        inflater = zlib.decompressobj(31)
        assert inflater.decompress(member) == record and inflater.eof and not inflater.unused_data
    assert warc.read_record(io.BytesIO(sink.getvalue()[index[2][0]:]))["refers_to"] == 0


def test_pipeline_stages_take_effect(spark):
    import corpus_pipeline as p
    from risegraph.llm.queries import table
    sf = "/root/testdata/sf0.001"
    names = [n for n, _ in p.STAGES]
    assert names == ["quality_rules", "exact_dedup", "ngram_join", "pii", "packing"]
    docs = table(spark, sf, "documents")
    columns, sizes = docs.columns, [docs.count()]
    for _, stage in p.STAGES[:-1]:
        docs = p.written(stage(spark, docs, sf), "pipeline-test")
        assert docs.columns == columns
        sizes.append(docs.count())
    assert sizes[0] > sizes[1] >= sizes[2] >= sizes[3] == sizes[4] > 0
    assert docs.filter("text rlike '[A-Za-z0-9]@[A-Za-z0-9-]+[.]'").count() == 0
    pieces = p.STAGES[-1][1](spark, docs, sf)
    assert pieces.select("doc_id").distinct().count() == sizes[-1]
