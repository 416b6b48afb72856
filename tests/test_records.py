"""Digests, anchors, worksheets and gates on small fixtures: nulls, empty tables, repeated rows and ties."""

from leafmill.functions import segments
from leafmill.operators import anchors, digests, gates, glossary, layout, worksheets
from pyspark.sql import functions as F


def test_digests_tell_nulls_order_and_ranges_apart(spark, rows):
    unit = "book_id string, part_no int, pos int, id string, part string, kind string, source string, target string"
    base = [("x", 1, n, f"b{n:05}", "body", "para", f"s{n}", f"t{n}") for n in range(3000)]
    variants = [base, base[:-1], [*base[:5], ("x", 1, 5, "b00005", "body", "para", None, "t5"), *base[6:]], [*base[:5], ("x", 1, 5, "b00005", "body", "para", "", "t5"), *base[6:]], [("x", 1, 1 - n, *r[3:]) if (n := r[2]) < 2 else r for r in base]]
    found = [digests.bilingual_digests(spark.createDataFrame(v, unit).repartition(7)).first().digest for v in variants]
    assert len(set(found)) == 5 and all(d.startswith("meaning4:") for d in found)
    assert digests.bilingual_digests(spark.createDataFrame(base, unit).repartition(3)).first().digest == found[0]
    assert digests.target_digests(spark.createDataFrame(variants[2], unit)).first() == digests.target_digests(spark.createDataFrame(base, unit)).first()
    assert digests.bilingual_digests(spark.createDataFrame([], unit)).collect() == []
    files = spark.createDataFrame([("s", 1, "a", "h"), ("s", 2, None, None)], "subject string, pos int, name string, sha256 string")
    swapped = files.withColumn("pos", -F.col("pos"))
    assert digests.evidence_digests(files).first() != digests.evidence_digests(swapped).first()


def test_anchors_and_links(spark, rows):
    given = spark.createDataFrame([("a/x.xhtml", "n1"), ("a/y.xhtml", "n1"), ("a/y.xhtml", "n2")], "document string, fragment string")
    named = {(r.document, r.fragment): r.name for r in anchors.named_anchors(given).collect()}
    assert named["a/y.xhtml", "n2"] == "n2" and named["a/x.xhtml", "n1"] != named["a/y.xhtml", "n1"] and named["a/x.xhtml", "n1"].endswith("-n1")
    links = spark.createDataFrame([(1, "a/x.xhtml", "#n1"), (2, "a/x.xhtml", "y.xhtml#n2"), (3, "a/x.xhtml", "../a/./y.xhtml#n2"), (4, "a/x.xhtml", "http://z/#n2"), (5, "a/x.xhtml", "y.xhtml"), (6, "a/x.xhtml", "#gone"), (7, "a/x.xhtml", None)], "link_key long, document string, href string")
    got = {r.link_key: r.name for r in anchors.resolved_links(links, given).collect()}
    assert got == {1: named["a/x.xhtml", "n1"], 2: "n2", 3: "n2", 6: None}
    held = spark.createDataFrame([("b", 2, "b2", "n"), ("b", 1, "b1", "n"), ("b", 1, "b1", "m")], "book_id string, pos int, id string, name string")
    wanted = spark.createDataFrame([("b", "n"), ("b", "n"), (None, "m")], "book_id string, name string")
    assert rows(anchors.settled_anchors(held, wanted)) == [("b", 1, "b1", "n")]


def test_section_order_walks_forward(spark, rows):
    sizes = {"A": 400, "B": 500, "C": 600, "?": 999}
    views = [(d, k, sizes[c], 600) for d, walk in (("ok", "AABBC"), ("back", "ACBBA"), ("odd", "A?B")) for k, c in enumerate(walk, 1)]
    declared = [(d, n, w, 600) for d in ("ok", "back", "odd") for n, w in ((1, 400), (2, 500), (3, 600))] + [("one", 1, 400, 600)]
    got = anchors.section_order(spark.createDataFrame(views, "document string, page int, width int, height int"), spark.createDataFrame(declared, "document string, no int, width int, height int"))
    assert rows(got) == [("back", 3, 2, 3), ("back", 5, 1, 2)]


def test_neighbours_stay_in_their_part_and_separators(spark, rows):
    units = spark.createDataFrame([("b", 0, 0, "title", "metadata", "T"), ("b", 1, 1, "b1", "body", "one"), ("b", 1, 2, "b2", "body", None)], "book_id string, part_no int, pos int, id string, part string, target string")
    assert rows(anchors.part_neighbours(units).select("id", "before", "after")) == [("b1", "", ""), ("b2", "one", ""), ("title", "", "")]
    cuts = spark.createDataFrame([("o", 1, 0, "a\r\n\rb c"), ("o", 2, 4, "a\r\n\rb c"), ("o", 3, 6, "a\r\n\rb c"), ("o", 4, 3, None)], "owner string, id int, offset int, text string")
    assert rows(anchors.separators(cuts)) == [("o", 2, "\n\n")]


def test_worksheets_read_back(spark, tmp_path):
    body = "@@ no header\n```\n\\@@ x\n<!-- c\nplain"
    units = [("b", 0, 1, "b1", "para", body), ("b", 0, 2, "b2", "heading1", "Title"), ("b", 1, 3, "b3", "para", None)]
    df = spark.createDataFrame(units, "book_id string, chunk_no int, pos int, id string, kind string, text string")
    sheets = worksheets.worksheets(df)
    text = sheets.where("chunk_no = 0").first().sheet
    assert [(u, k, t, p) for u, k, t, p in segments.parse_reply(text)] == [("b1", "para", body, None), ("b2", "heading1", "Title", None)]
    size = df.where("id = 'b1'").select(worksheets.rendered_size(F.col("id"), F.col("kind"), F.col("text")).alias("n")).first().n
    assert size > len(body) and worksheets.worksheets(df.limit(0)).collect() == []
    worksheets.write_worksheets(sheets, str(tmp_path / "w"))
    assert spark.read.parquet(str(tmp_path / "w/manifest")).count() == 2 and spark.read.text(str(tmp_path / "w/sheets")).count() > 4
    pages = spark.createDataFrame([("b", 2, "two"), ("b", 1, "one"), ("b", 3, None)], "book_id string, page int, text string")
    worksheets.write_sidecars(pages, str(tmp_path / "s"))
    assert spark.read.json(str(tmp_path / "s/records")).count() == 3


def test_logs_hold_no_text(spark, tmp_path):
    schema = "at string, kind string, stage string, cause string, blocks long, text string"
    events = spark.createDataFrame([("t", "stage", "s", None, 5, "secret"), ("t", "refused", "s", "c", -1, "secret"), ("t", "free text", "s", None, 1, "secret")], schema)
    for _ in range(2):
        worksheets.append_events(events, str(tmp_path / "log"))
    log = spark.read.parquet(str(tmp_path / "log"))
    assert log.count() == 4 and "text" not in log.columns and {r.blocks for r in log.collect()} == {5, None}


def test_stamps_and_passes(spark, rows):
    stamps = ["2025-01-02T03:04:05Z", "2025-13-02T03:04:05Z", "2025-01-02 03:04:05", "2025-02-30T00:00:00Z", "", None]
    got = spark.createDataFrame(list(enumerate(stamps)), "n int, s string").select("n", worksheets.strict_stamp(F.col("s")).isNotNull().alias("v"))
    assert [r.v for r in got.orderBy("n").collect()] == [True, False, False, False, False, False]
    passes = spark.createDataFrame([(1, 2, False, False, True), (2, 2, True, False, True), (3, 0, None, None, True), (4, 2, False, True, True), (5, 2, False, False, None)], "n int, e int, a boolean, r boolean, c boolean")
    state = passes.select("n", "c", worksheets.fluency_state(F.col("e"), F.col("a"), F.col("r")).alias("s"))
    got = state.select("n", "s", worksheets.fluency_refusal(F.col("s"), F.lit("apply"), F.col("c")), worksheets.fluency_refusal(F.col("s"), F.lit("verdict"), F.col("c")))
    assert rows(got) == [(1, "proposed", None, "edits-unapplied"), (2, "applied", "already-applied", None), (3, "approved-no-change", None, None), (4, "refused", "refused", "refused"), (5, "proposed", "stale-edits", "edits-unapplied")]


def test_names_terms_and_styles(spark, rows):
    names = [(1, "Then Elizabeth Bennet", ["near elizabeth"]), (2, "The Alice's", ["Alice said no"]), (3, "James’ The", []), (4, "The And", None), (5, "Paris", ["He went to Paris."]), (6, "Poole", ["Mrs. Poole came"])]
    df = spark.createDataFrame(names, "n int, name string, contexts array<string>")
    assert [r.t for r in df.select("n", glossary.trimmed_name(F.col("name")).alias("t")).orderBy("n").collect()] == ["Elizabeth Bennet", "Alice", "James’ The".replace("’ The", "’"), "", "Paris", "Poole"]
    kinds = df.select("n", glossary.name_category(F.regexp_replace("name", "^The |'s$", ""), F.coalesce("contexts", F.array())).alias("c"))
    assert {r.n: r.c for r in kinds.collect() if r.n in (2, 5, 6)} == {2: "person", 5: "place", 6: "person"}
    bank = spark.createDataFrame([("a", 2, "lamp", "later", None), ("a", 1, "lamp", "چراغ / لامپ", "n"), ("b", 1, "lamp", "ل", None), ("a", 3, "x", None, None)], "bank string, seq int, en string, fa string, note string")
    texts = spark.createDataFrame([(1, "Two lamps, one lamp."), (2, None), (3, "")], "unit int, text string")
    assert rows(glossary.term_briefs(texts, bank).select("unit", "bank", "fa")) == [(1, "a", "چراغ / لامپ"), (1, "b", "ل")]
    found = glossary.persian_hits(spark.createDataFrame([(1, "یک چراغها"), (2, None), (3, "")], "unit int, text string"), bank)
    assert rows(found) == [(1, "lamp")]
    spans = spark.createDataFrame([(1, 16, "Arial", False), (2, 2, "GlyphLess", False), (3, 0, "X-BoldOblique", None), (4, 18, "X", True), (5, None, None, None)], "n int, f int, font string, ocr boolean")
    got = spans.select("n", layout.span_style(F.col("f"), F.col("font"), F.col("ocr")).alias("s")).select("n", "s.*")
    assert rows(got) == [(1, True, False), (2, False, False), (3, True, True), (4, False, False), (5, False, False)]
    shares = layout.coloured_share(spark.createDataFrame([(1, 16, 93), (1, 17, 7), (2, 0, 5)], "page_key int, saturation int, n int"))
    assert rows(shares) == [(1, 0.07, True), (2, 0.0, False)]


def test_assets_and_copied_runs(spark, rows):
    images = spark.createDataFrame([("b", "i1", "p", "h"), ("b", "i2", "q", None), ("b", "i3", None, "h"), ("b", "i4", "r", "h")], "book_id string, id string, asset string, sha256 string")
    assets = spark.createDataFrame([("p", "h"), ("q", "z"), ("r", "z"), ("r", "z")], "path string, sha256 string")
    assert rows(gates.asset_gate(images, assets).select("code", "unit")) == [("asset-missing", "i3"), ("asset-modified", "i4")]
    text = "".join(chr(97 + k % 26) + str(k) for k in range(60))
    cases = [(text, "x" + text[7:47] + "y"), (text, text[7:46] + "!"), (text[:39], text), (None, text), (text, None)]
    got = spark.createDataFrame([(n, *c) for n, c in enumerate(cases)], "n int, s string, t string").select("n", gates.copied_run(F.col("s"), F.col("t")).alias("run"))
    assert {r.n: r.run for r in got.collect()} == {0: text[7:47], 1: None, 2: None, 3: None, 4: None}
