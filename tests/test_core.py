"""Core operators on small fixtures, with nulls, ties, repeated rows and empty tables."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from leafmill.operators import blocks as B
from leafmill.operators import gates, glossary, jobs, layout, references, state

T = dt.datetime
BLOCK = "book_id string, pos int, id string, type string, level int, text string, target string, page int"
REFS = "ref_table string, ref_key long, owner string, ref_id string, seen_at timestamp_ntz"
RECORDS = "owner string, id string, loaded_at timestamp_ntz, deleted_at timestamp_ntz"


def test_orphan_references(spark, rows, monkeypatch):
    records = [("a", "b1", T(2024, 1, 1), None), ("a", "b1", T(2024, 3, 1), None), ("a", "b2", T(2024, 1, 1), T(2024, 2, 1)), ("a", "B3 ", T(2024, 5, 1), None), (None, "b9", None, None)]
    refs = [("l", 1, "a", " B1#x", T(2024, 1, 2)), ("l", 1, "a", " B1#x", T(2024, 1, 2)), ("l", 2, "a", "b2", T(2024, 1, 5)), ("l", 3, "a", "b2", T(2024, 2, 1)),
            ("l", 4, "a", "b3", T(2024, 1, 1)), ("l", 5, "a", "zz", None), ("l", 6, "a", None, T(2024, 1, 1)), ("r", 1, None, "b1", T(2024, 1, 1)), ("l", 7, "a", "b1", None)]
    r, k = spark.createDataFrame(refs, REFS), spark.createDataFrame(records, RECORDS)
    expected = [("l", 3, "deleted"), ("l", 4, "not yet loaded"), ("l", 5, "absent"), ("r", 1, "absent")]
    for heavy in (10_000, 1):  # by shuffle, then by broadcast of heavy buckets
        monkeypatch.setattr(references, "HEAVY_ROWS", heavy)
        assert rows(references.orphan_references(r, k).select("ref_table", "ref_key", "reason")) == expected
    counts = {(x[0], x[1]): (x[2], x[3]) for x in rows(references.orphan_counts(r, k))}
    assert counts["l", T(2024, 1, 1)] == (3, 1) and counts["l", None] == (2, 1)
    assert rows(references.orphan_references(r.limit(0), k)) == []
    assert len(rows(references.orphan_references(r, k.limit(0)))) == 7


def _fold(blocks, budget):
    """The chunking rule, block by block."""
    cap, out, no, size, prose, n = int(budget * 1.35), [], 1, 0, False, 0
    for kind, level, text in blocks:
        cost, opens = len(text or ""), kind == "heading" and (level or 9) <= 2
        if n and (opens or size + cost > cap) and not (opens and size < budget * 0.25 and not prose):
            no, size, prose, n = no + 1, 0, False, 0
        out.append(no)
        size, n = size + cost, n + 1
        prose = prose or (kind in ("paragraph", "blockquote", "verse") and cost > 120)
        if size >= budget and not opens:
            no, size, prose, n = no + 1, 0, False, 0
    return out


@pytest.mark.parametrize("budget", [300, 700])
def test_chunks_follow_the_fold(spark, budget):
    rng = random.Random(budget)
    books = {f"b{k}": [(rng.choice(["heading", "paragraph", "paragraph", "listitem"]), rng.choice([1, 2, 3, None]), rng.choice([None, "x" * rng.randrange(500)])) for _ in range(40)] for k in range(5)}
    data = [(b, i, f"id{i}", kind, level, text, None, None) for b, blocks in books.items() for i, (kind, level, text) in enumerate(blocks)]
    got = {(r.book_id, r.pos): r.chunk_no for r in jobs.chunks(spark.createDataFrame(data, BLOCK), budget).collect()}
    for b, blocks in books.items():
        assert [got[b, i] for i in range(len(blocks))] == _fold(blocks, budget)
    assert jobs.chunks(spark.createDataFrame([], BLOCK)).collect() == []


def test_positional_joins(spark, rows):
    data = [("x", 1, "b1", "paragraph", None, "a [[fn:fn0001]] `[[fn:fn0009]]`", "", 0), ("x", 2, "b2", "heading", 1, "T", None, 3), ("x", 3, "b3", "paragraph", None, None, "t", None)]
    b = spark.createDataFrame(data, BLOCK)
    notes = spark.createDataFrame([("x", "fn0001", "b3", "source", "n", None), ("x", "fn0002", "b2", "translator", "", "")], "book_id string, id string, anchor_block string, origin string, text string, target string")
    assert [r[-1] for r in rows(B.page_of_block(b).select("pos", "on_page"))] == [1, 3, 3]
    assert [r[-1] for r in rows(B.chapter_of_block(b).select("pos", "chapter"))] == ["front", "b2", "b2"]
    assert rows(B.note_references(b, "text")) == [("x", "b1", 1, 1, "fn0001")]
    assert rows(B.note_pages(b, notes)) == [("x", "fn0001", 1), ("x", "fn0002", 3)]
    codes = {r.code for r in gates.note_gate(b, notes).collect()}
    assert codes == {"footnote-unreferenced", "footnote-anchor-mismatch", "footnote-untranslated"}
    assert B.book_stats(b.limit(0), notes.limit(0)).collect() == []


def test_copied_run_and_lengths(spark, rows):
    long = "The quick brown fox jumps over the lazy dog and runs away again " * 2
    data = [("x", 1, "b1", "paragraph", None, long, "ab " + long[5:60], 1), ("x", 2, "b2", "paragraph", None, "short", "short", 1), ("x", 3, "b3", "paragraph", None, None, None, 1)]
    b = spark.createDataFrame(data, BLOCK)
    assert rows(gates.copied_gate(b).select("unit", "detail")) == [("b1", long[5:45])]
    assert rows(gates.length_gate(b).select("code", "unit")) == [("possible-omission", "b1")]


def test_components_match_a_union_find(spark):
    rng = random.Random(3)
    edges = [(f"n{rng.randrange(60)}", f"n{rng.randrange(60)}") for _ in range(45)] + [(f"c{i}", f"c{i + 1}") for i in range(30)] + [(None, "z")]
    parent = {x: x for e in edges if None not in e for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a and b:
            low, high = sorted((root(a), root(b)))
            parent[high] = low
    got = {r.node: r.component for r in state.components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert got == {x: min(y for y in parent if root(y) == root(x)) for x in parent}


def test_parent_cycles(spark, rows):
    children = [("a", "b"), ("b", "c"), ("c", "a"), ("d", "a"), ("e", "f"), ("f", None), ("g", "g")]
    assert rows(state.parent_cycles(spark.createDataFrame(children, "id string, parent string"))) == [("a",), ("b",), ("c",), ("g",)]


@pytest.mark.parametrize(("letters", "decision"), [("ABC", "rounds-exhausted"), ("AA", "no-new-evidence"), ("ABA", "oscillating"), ("AB", "")])
def test_repair_episodes(spark, letters, decision):
    reports = [("k", i, str(i), "s", w, "report") for i, w in enumerate(letters)]
    got = state.repair_episodes(spark.createDataFrame(reports, "key string, at int, event string, source string, wording string, kind string")).first()
    assert (got.decision, got.attempts, got.state) == (decision, len(letters), "open")


def test_closed_episode_recurs_with_what_was_rejected(spark):
    reports = [("k", 1, "1", "s", "A", "report"), ("k", 2, "2", "s", "", "absent"), ("k", 3, "3", "s", "A", "report"), ("k", 4, "3", "s", "A", "report")]
    got = state.repair_episodes(spark.createDataFrame(reports, "key string, at int, event string, source string, wording string, kind string")).first()
    assert tuple(got)[1:] == ("open", 1, 1, 1, "oscillating")


def test_merge_is_all_or_nothing(spark, rows):
    units = spark.createDataFrame([("x", "b1", None), ("x", "b2", "old"), ("y", "b1", "old")], "book_id string, id string, target string")
    replies = spark.createDataFrame([("x", "b1", "new"), ("y", "b1", "new"), ("y", "nope", "new")], "book_id string, id string, target string")
    assert rows(state.merged_replies(units, replies).select("book_id", "id", "target", "merged")) == [("x", "b1", "new", True), ("x", "b2", "old", False), ("y", "b1", "old", False)]


def test_forms_stand_alone(spark, rows):
    texts = spark.createDataFrame([("x", "b1", "Ann and Anna, Ann Lee."), ("x", "b2", None), ("y", "b1", "Ann")], "book_id string, unit string, text string")
    entries = spark.createDataFrame([("x", "g1", "Ann", ["Ann Lee", ""]), ("x", "g2", "(odd", None)], "book_id string, id string, source string, aliases array<string>")
    assert rows(glossary.form_frequencies(texts, entries)) == [("x", "g1", 3), ("x", "g2", 0)]


def test_spans_and_segments(spark, rows):
    spans = spark.createDataFrame([("o", 0, 5, 12), ("o", 4, 3, 12), ("o", 9, 2, 12)], "owner string, offset long, length long, whole long")
    assert rows(jobs.span_problems(spans)) == [("o", 11, "uncovered"), ("o", 4, "overlap"), ("o", 9, "gap")]
    ids = spark.createDataFrame([("b1#2",), ("b1#alt",), ("b1",)], "unit string").select("unit", jobs.segment_owner(F.col("unit")), jobs.segment_index(F.col("unit")))
    assert rows(ids) == [("b1", "b1", None), ("b1#2", "b1", 2), ("b1#alt", "b1#alt", None)]


def test_layout_ties_and_medians(spark, rows):
    sizes = spark.createDataFrame([("p", 10, 5, 2), ("p", 12, 5, 1), ("q", 9, 1, 1)], "k string, size int, w int, at int")
    assert rows(layout.weighted_mode(sizes, "k", "size", "w", "at")) == [("p", 12), ("q", 9)]
    values = spark.createDataFrame([("a", 1), ("a", 2), ("a", 3), ("a", 4), ("b", None)], "k string, v int")
    assert rows(layout.upper_median(values, "k", "v")) == [("a", 3)]
