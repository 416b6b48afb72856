"""One case or more for every rule of both sets, and that no rule has work left after a rewrite."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from leafmill.functions import persian

FIRST = [
    ("كتاب يا علـى", "کتاب یا علی"), ("٢٣ و 45", "۲۳ و ۴۵"), ("او گفت \"بیا\" و رفت", "او گفت «بیا» و رفت"), ("رفت... و", "رفت… و"), ("رفت , آمد ; چه ?", "رفت، آمد؛ چه؟"), ("رفت ،آمد", "رفت، آمد"),
    ("« رفت »", "«رفت»"), ("کتاب ها", "کتاب‌ها"), ("بزرگ ترین خانه", "بزرگ‌ترین خانه"), ("تری ترین", "تری ترین"), ("می رود", "می‌رود"), ("می سفید", "می سفید"), ("a 12/5/2020 v1.2 x.y@z.ir", "a 12/5/2020 v1.2 x.y@z.ir"), ("دو  سه", "دو سه"), ("`كد , ها` و", "`كد , ها` و"),
]
SECOND = [
    ("مدرسة كجا", "مدرسه کجا"), ("او ــ رفت", "او – رفت"), ("کتـاب", "کتاب"), ("سال 2020 بود", "سال ۲۰۲۰ بود"), ("مدل a4 بود", "مدل a4 بود"), ("1. مورد 2", "1. مورد ۲"), ("۵%", "۵٪"), ("رفت, آمد", "رفت، آمد"), ("1,000 تا", "۱,۰۰۰ تا"), ("\"سلام\" گفت", "«سلام» گفت"),
    ("رفت... و", "رفت… و"), ("می رود", "می‌رود"), ("کتاب ها", "کتاب‌ها"), ("های و هوی", "های و هوی"), ("بزرگ ترین", "بزرگ‌ترین"), ("خانه ای", "خانه‌ای"), ("که ای", "که ای"), ("رفت ،آمد", "رفت، آمد"), ("دو   سه  ", "دو سه"), ("« رفت", "«رفت"), ("The cost, is 5", "The cost, is 5"), ("`a , b` رفت", "`a , b` رفت"),
]


@pytest.mark.parametrize(("text", "want"), FIRST)
def test_first_set(text, want):
    assert persian.fixed(text) == want


@pytest.mark.parametrize(("text", "want"), SECOND)
def test_second_set(text, want):
    assert persian.normalised(text)[0] == want and persian.normalised(want)[0] == want


@pytest.mark.parametrize(
    ("text", "codes"),
    [("كتاب", ["arabic-forms"]), ("«رفت", ["guillemets"]), ('"رفت', ["latin-quotes"]), ("رفت؟!", ["double-punctuation"]), ("زیبا تر", ["zwnj-comparative"]), ("رفتabc", ["script-collision"]),
     ("only latin", ["untranslated"]), ("رفت and then a long run of latin words", ["untranslated-run"]), ("می سفید", ["zwnj-prefix-undecided"]), ("چوب ترین", ["zwnj-comparative-undecided"]), ("", []), ("`x` رفت", [])],
)
def test_lint(text, codes):
    assert persian.lint(text) == codes


def test_suggestions_and_changes():
    assert persian.suggestions("زیبا تر — میروم میز نمیدانم توسط او") == ["maybe_comparative_tar", "maybe_glued_mi", "maybe_glued_mi", "em_dash", "style"]
    assert persian.suggestions("`می‌باشد`") == [] and persian.suggestions("توسط او", style=False) == []
    assert persian.line_changes("a\nb\nc", "a\nx\nc") == [(2, "b", "x")]


@given(st.text(alphabet="کتاب هامی‌رودترین ,،؛?!.:\"«»12۳aB`-\nـ%", max_size=40))
@settings(max_examples=400, deadline=None)
def test_tokens_are_whole_and_second_set_settles(text):
    for latin in (True, False):
        assert "".join(t.text for t in persian.tokens(text, latin)) == text
    out = persian.normalised(text)[0]
    for _ in range(3):
        out = persian.normalised(out)[0]
    assert persian.normalised(out)[0] == out
