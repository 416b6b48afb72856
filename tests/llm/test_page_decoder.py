"""The decoder of scanned pages: every path on small streams, and that both results come from its path."""

import math
import random

from leafmill.llm import scanned_pages
from leafmill.llm.scanned_pages import Division, Facts, decode


def said(words, steps):
    out = []
    for k, n, how, meant in steps:
        if how == "hyphened":
            out.append("-".join(words[k : k + n]))
        elif n == 1 and out and "-" in out[-1] and words[k] in out[-1].split("-"):
            continue
        else:
            out += meant or ["".join(words[k : k + n])]
    return out


def test_joins_splits_and_confusions():
    facts = Facts(1e6, {"square": 5, "the": 50000, "cat": 10000, "lantern": 40}, {"1antern": ("lantern", 40.0)}, {"thecat": ("the", "cat")})
    words = "the squ are 1antern thecat".split()
    assert said(words, decode(words, facts)) == ["the", "square", "lantern", "the", "cat"]
    assert said(["squ", "are"], decode(["squ", "are"], facts, gaps={})) == ["squ", "are"]
    assert said(["squ", "are"], decode(["squ", "are"], Facts(6.0, {"square": 5}))) == ["square"]
    assert decode([], facts) == []


def test_hyphens_compete():
    words = ["well", "worn", "and"]
    two = lambda joined, compound, upper=False, mark="-": decode(words, Facts(100.0), {}, {0: (mark, upper, Division(joined, compound))})[0][2]
    assert two(0, 0) == two(3, 1) == "unhyphen" and two(1, 3) == two(0, 0, True) == "hyphened" and two(1, 3, mark="¬") == "unhyphen"
    fixed = decode(["lan", "tem"], Facts(100.0), {}, {0: ("-", False, Division(30.0, 0.0, 0.0, False, "lantern"))})
    assert fixed == [(0, 2, "unhyphen", ("lantern",))]


def test_path_is_the_best_of_all():
    rng = random.Random(2)
    for _ in range(200):
        words = [rng.choice("abcd") * rng.randint(1, 2) for _ in range(6)]
        counts = {w + v: float(rng.randint(0, 30)) for w in ["", *words] for v in words}
        facts = Facts(500.0, counts)
        cost = lambda w: math.log(500.0 / max(counts.get(w, 0.0), scanned_pages.UNKNOWN))

        def least(k):
            if k == len(words):
                return 0.0
            ways = [cost(words[k]) + least(k + 1)]
            if k + 1 < len(words) and counts.get(words[k] + words[k + 1]):
                ways.append(cost(words[k] + words[k + 1]) + scanned_pages.JOINED + least(k + 2))
            return min(ways)

        total = sum(cost("".join(words[k : k + n])) + scanned_pages.JOINED * (n == 2) for k, n, _, _ in decode(words, facts))
        assert abs(total - least(0)) < 1e-9


def test_results_come_from_the_path(spark):
    body = "   The miller found the lantern near the river. The\nminer left. The lan-\ntern was found, and the squ are was large. The square is here, a square it is.\nThe 1antern near the river and one more lan-"
    texts = [(p, "b", p, f"{'tern was' if p > 1 else 'So it'} {'anna boris clara david emil fritz gustav hanna'.split()[p - 1]} lit.\n{body}", "en") for p in range(1, 9)]
    df = spark.createDataFrame(texts, "page_key long, book_id string, page int, text string, lang string")
    words = spark.createDataFrame([("en", "lantern"), ("en", "square")], "lang string, word string")
    got = {(r.line_no, r.defect) for r in scanned_pages.damaged_lines(df, words).where("page_key = 3").collect()}
    assert got == {(3, "hyphen"), (4, "misread"), (5, "misread"), (5, "hyphen")}
    parts = scanned_pages.repaired_pages(df, words)
    text = " ".join(r.text for r in scanned_pages.whole_paragraphs(parts).orderBy("page", "paragraph_no").collect())
    assert "square was large" in text and "one more lantern was clara lit." in text and "lan-" not in text[:-20] and "1antern" not in text


def test_without_the_decoder_nothing_is_found(monkeypatch):
    facts = Facts(1e5, {"1antern": 1.0, "squ": 0.0, "are": 0.0, "square": 9.0}, {"1antern": ("lantern", 40.0)})
    page = [(1, "The lan-"), (2, "tern and a 1antern in the squ are")], None, False, facts, {1: Division(40.0, 0.0, 40.0, True, "lantern")}
    rows, _ = scanned_pages.read_page(*page)
    assert [r[4:] for r in rows] == [(True, False), (False, True)] and [r[2] for r in rows] == ["The lan", "tern and a lantern in the square"]
    monkeypatch.setattr(scanned_pages, "decode", lambda words, *rest: [(k, 1, "keep", None) for k in range(len(words))])
    rows, _ = scanned_pages.read_page(*page)
    assert [r[4:] for r in rows] == [(False, False), (False, False)]


def test_breaks_are_the_best_division():
    lines = ["   The keeper slept all night in the cold tower of stone", "and nobody came to see him in the morning or later that", "day.", "   Then it rained on the tower and on the road to the town", "for a week."]
    assert scanned_pages._breaks(lines, [False] * 5) == [0, 3]
    assert scanned_pages._breaks([], []) == [] and scanned_pages._breaks(["x"], [False]) == [0]
