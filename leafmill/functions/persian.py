"""Persian typography: two independent rule sets over tokens.

A text is cut into tokens: words, digits, blanks, line ends, single marks, and
literals (code, addresses, versions, and in the first set any Latin word) that no rule
touches. A rule looks at a token and its neighbours. Both sets are idempotent.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql.types import ArrayType, MapType, StringType, IntegerType

from leafmill.functions.markup import by_text, prose

ZWNJ = "‌"

# Letters, digits and punctuation of Persian text.
LETTERS = "ء-غف-يٮ-ۓۺ-ۿ"
LETTERS_B = "ء-يٮ-ەۺ-ۼۿ"
DIGITS = str.maketrans("0123456789٠١٢٣٤٥٦٧٨٩", "۰۱۲۳۴۵۶۷۸۹" * 2)
ARABIC_DIGITS = str.maketrans("٠١٢٣٤٥٦٧٨٩", "۰۱۲۳۴۵۶۷۸۹")
LATIN_DIGITS = str.maketrans("۰۱۲۳۴۵۶۷۸۹٠١٢٣٤٥٦٧٨٩", "0123456789" * 2)
CHARACTERS = {ord("ي"): "ی", ord("ى"): "ی", ord("ك"): "ک", ord("ـ"): None, 0xA0: " ", 0x200B: None, 0xFEFF: None}
SUFFIXES = "هایشان هایتان هایمان هایی هایم هایت هایش های ها تری ترین".split()
ENCLITICS, FUNCTION_WORDS = "اند ایم اید ام ات اش ای".split(), set("که چه نه به سه بله آنچه چنانچه اگرچه گرچه".split())

# Stems of common verbs (present and past) and the endings of finite forms; adjectives that take a comparative.
PRESENT = "کن رو گوی آی خواه دان توان بین شنو خور گیر ده زن نویس خوان پرس ساز آور بر افت مان نشین خیز گذار شو باش دار یاب فروش خر کش پوش ریز".split()
PAST = "کرد رفت گفت آمد خواست دانست توانست دید شنید خورد گرفت داد زد نوشت خواند پرسید ساخت آورد برد افتاد ماند نشست برخاست گذاشت شد بود داشت یافت فروخت خرید کشید پوشید ریخت".split()
PRESENT_ENDS, PAST_ENDS = "م ی د یم ید ند".split(), ["", *"م ی یم ید ند".split()]
VERB_FORMS = {s + e for s in PRESENT for e in PRESENT_ENDS} | {s + e for s in PAST for e in PAST_ENDS}
COMPARABLE = set("بزرگ کوچک خوب بد زیبا بلند کوتاه قوی ضعیف مهم سریع کند جوان پیر زشت سخت آسان گرم سرد تند نزدیک دور پایین بالا کم بیش سنگین سبک روشن تاریک".split())

WORD, DIGIT, LATIN, BLANK, LINE, MARK, LITERAL = "word", "digit", "latin", "blank", "line", "mark", "literal"
_PERSIAN, _PERSIAN_B = re.compile(f"[{LETTERS}]"), re.compile(f"[{LETTERS_B}]")
_IN_WORD = re.compile(f"[{LETTERS}{LETTERS_B}ً-ْٰۀـيكىة{ZWNJ}]")
_ADDRESS = set("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_.:/+-@'’%")


@dataclass
class Token:
    kind: str
    text: str


def _is_digit(c: str) -> bool:
    return c.isdigit() and (c in "0123456789" or "٠" <= c <= "٩" or "۰" <= c <= "۹")


def _address(run: str, latin_words: bool) -> tuple[int, str]:
    """(length, kind) of what begins a run of address characters."""
    end = len(run)
    while end and not run[end - 1].isalnum():
        end -= 1
    name, at, host = run[:end].partition("@")
    if at and name and "." in host.strip("."):
        return end, LITERAL
    if run[0].isalpha() and run[0].isascii():
        body = next((k for k, c in enumerate(run[:end]) if c in ":/+@%" or (c == "." and not latin_words)), end)
        if run[:1] == "v" and re.fullmatch(r"v[0-9]+(\.[0-9]+)+", run[:end]):
            return end, LITERAL
        while body and not run[body - 1].isalnum():
            body -= 1
        return body, LITERAL if latin_words else LATIN
    digits = len(run) - len(run.lstrip("0123456789"))
    if digits:
        parts = re.split(r"[.:/-]", run[:end])
        if all(p.isdigit() for p in parts) and len(parts) > (1 if latin_words else 2) and (latin_words or set(run[:end]) <= set("0123456789.")):
            return end, LITERAL
        return digits, DIGIT
    return 1, MARK


def tokens(text: str, latin_words: bool) -> list[Token]:
    """The tokens of a text. With ``latin_words`` Latin words and dates are literals too; else fenced and indented code is."""
    out: list[Token] = []
    k, n = 0, len(text)
    while k < n:
        c, fresh = text[k], not k or text[k - 1] == "\n"
        end, kind = k + 1, MARK
        if c == "`":
            fence = "```" if not latin_words and text.startswith("```", k) else "`"
            close = text.find(fence, k + len(fence))
            if close >= 0 and (fence == "```" or latin_words or "\n" not in text[k:close]):
                end, kind = close + len(fence), LITERAL
        elif fresh and not latin_words and (text.startswith("    ", k) or c == "\t") and (line := text[k:].split("\n", 1)[0]).strip():
            end, kind = k + len(line), LITERAL
        elif c == "\n":
            kind = LINE
        elif c in " \t":
            kind = BLANK
            while end < n and text[end] in " \t":
                end += 1
        elif c.isascii() and c.isalnum():
            low = text[k : k + 8].lower()
            if low.startswith(("http://", "https://", "www.")):
                kind = LITERAL
                while end < n and not text[end].isspace():
                    end += 1
            else:
                while end < n and text[end] in _ADDRESS:
                    end += 1
                size, kind = _address(text[k:end], latin_words)
                end = k + size
        elif _is_digit(c):
            kind = DIGIT
            while end < n and _is_digit(text[end]):
                end += 1
        elif _IN_WORD.match(c):
            kind = WORD
            while end < n and _IN_WORD.match(text[end]):
                end += 1
        out.append(Token(kind, text[k:end]))
        k = end
    return out


def _written(ts: list[Token]) -> str:
    return "".join(t.text for t in ts)


def is_verb_form(word: str) -> bool:
    return word.replace(ZWNJ, "") in VERB_FORMS


def _stem(word: str) -> str:
    """The last run of letters of a word."""
    found = re.search(f"[{LETTERS}]+$", word)
    return found.group() if found else ""


def _gapped(ts: list[Token]) -> Iterator[tuple[int, str, str]]:
    """(place, word, next word) of words with one blank of spaces between them; the place is the blank's."""
    for k in range(1, len(ts) - 1):
        if ts[k].kind == BLANK and not ts[k].text.strip(" ") and ts[k - 1].kind == ts[k + 1].kind == WORD:
            yield k, ts[k - 1].text, ts[k + 1].text


def _takes_suffix(word: str, suffix: str) -> bool | None:
    """Whether a suffix joins the word before it; None where the lexicon does not tell."""
    stem = _stem(word)
    if len(stem) < 2 or suffix not in SUFFIXES:
        return False
    return True if suffix not in ("تری", "ترین") or stem in COMPARABLE else None


def _takes_prefix(prefix: str, verb: str) -> bool | None:
    if prefix not in ("می", "نمی"):
        return False
    return True if is_verb_form(verb) else None


def _joined(ts: list[Token], joins: Callable[[str, str], bool]) -> tuple[list[Token], int]:
    """Blanks between words that belong together become joiners; how many did."""
    places = {k for k, word, following in _gapped(ts) if joins(word, following)}
    out: list[Token] = []
    for k, t in enumerate(ts):
        if k in places:
            out[-1] = Token(WORD, out[-1].text + ZWNJ)
        elif k - 1 in places:
            out[-1] = Token(WORD, out[-1].text + t.text)
        else:
            out.append(t)
    return out, len(places)


def _ellipses(ts: list[Token], after: Callable[[Token | None], bool]) -> tuple[list[Token], int]:
    """Runs of three dots or more as one mark, where ``after`` allows the token before them."""
    out: list[Token] = []
    k = hits = 0
    while k < len(ts):
        run = k
        while run < len(ts) and ts[run].text == ".":
            run += 1
        if run - k > 2 and after(out[-1] if out else None):
            out.append(Token(MARK, "…"))
            hits += 1
            k = run
        else:
            out.append(ts[k])
            k += 1
    return out, hits


def _fixed_run(ts: list[Token]) -> list[Token]:
    for t in ts:
        if t.kind != LITERAL:
            t.text = t.text.translate(CHARACTERS).translate(ARABIC_DIGITS)
            t.kind = BLANK if t.text and not t.text.strip(" ") else t.kind
    ts = [t for t in ts if t.text]
    # quotation marks in pairs with something between
    opened = None
    for k, t in enumerate(ts):
        if t.text in ('"', "“", "”") and t.kind == MARK:
            if opened is not None and t.text != "“" and k > opened + 1:
                ts[opened].text, t.text, opened = "«", "»", None
            elif opened is None and t.text != "”":
                opened = k
    ts, _ = _ellipses(ts, lambda before: True)
    out: list[Token] = []
    for k, t in enumerate(ts):
        solid = next((x for x in reversed(out) if x.kind != BLANK), None)
        if t.kind == MARK:
            if t.text in ",;?" and solid is not None and (_PERSIAN.match(solid.text[-1:]) or "۰" <= solid.text[-1:] <= "۹") and (len(out) < 2 or out[-1].kind != BLANK or not out[-1].text.strip(" ")):
                t = Token(MARK, {",": "،", ";": "؛", "?": "؟"}[t.text])
            if t.text in "،؛؟!:.»…":
                while out and (out[-1].kind == BLANK or (t.text == "»" and out[-1].kind == LINE)):
                    out.pop()
        elif t.kind in (BLANK, LINE) and out and out[-1].text == "«":
            continue
        elif t.kind == WORD and _PERSIAN.match(t.text) and out and out[-1].kind == MARK and out[-1].text in "،؛؟!:":
            out.append(Token(BLANK, " "))
        out.append(t)
    for k, t in enumerate(out):
        near = (out[k - 1].text[-1:] if k else "") + (out[k + 1].text[:1] if k + 1 < len(out) else "")
        if t.kind == DIGIT and not any(c.isalnum() or c in "_.:/-" for c in near):
            t.text = t.text.translate(DIGITS)
    for _ in range(3):
        out, suffixes = _joined(out, lambda word, following: _takes_suffix(word, following) is True)
        out, prefixes = _joined(out, lambda word, following: _takes_prefix(word, following) is True)
        if not suffixes + prefixes:
            break
    return [Token(BLANK, " ") if t.kind == BLANK and len(t.text) > 1 else t for t in out]


def fixed(text: str) -> str:
    """The first rule set, for translated prose."""
    return _written(_fixed_run(tokens(text, latin_words=True)))


def lint(text: str) -> list[str]:
    """Codes of what a rewrite cannot decide."""
    shown = prose(text)
    if not shown.strip():
        return []
    persian, latin = sum("\u0600" <= c <= "\u06ff" for c in shown), sum(c.isascii() and c.isalpha() for c in shown)
    ts = tokens(shown, latin_words=False)
    pairs = list(_gapped(ts))
    marks = [t.text if t.kind == MARK else "" for t in ts]
    doubled = any(a and b and a in "،؛؟!" and b in "،؛؟!" for a, b in zip(marks, marks[1:], strict=False))
    meets = any({a.kind, b.kind} == {WORD, LATIN} for a, b in zip(ts, ts[1:], strict=False))
    codes = [
        ("arabic-forms", any(c in "يكىـ" or "٠" <= c <= "٩" for c in shown)),
        ("guillemets", shown.count("«") != shown.count("»")),
        ("latin-quotes", any(c in '"“”' for c in shown)),
        ("double-punctuation", doubled),
        ("zwnj-comparative", any(following == "تر" and len(_stem(word)) > 1 for _, word, following in pairs)),
        ("script-collision", meets),
        ("untranslated", persian == 0 and latin > 0),
        ("untranslated-run", persian > 0 and latin > 0.3 * (persian + latin) and bool(re.search(r"[A-Za-z][A-Za-z ,;'-]{24,}[A-Za-z]", shown))),
    ]
    undecided = sum(_takes_prefix(word, following) is None for _, word, following in pairs)
    loose = sum(_takes_suffix(word, following) is None for _, word, following in pairs)
    return [code for code, found in codes if found] + ["zwnj-prefix-undecided"] * min(3, undecided) + ["zwnj-comparative-undecided"] * loose


def is_persian_line(line: str) -> bool:
    return sum(bool(_PERSIAN_B.match(c)) for c in line) > sum(c.isascii() and c.isalpha() for c in line)


class _Hits(dict):
    def add(self, name: str, n: int = 1) -> None:
        if n:
            self[name] = self.get(name, 0) + n


def _near(t: Token | None, last: bool) -> bool:
    """Whether a token's facing character is a Persian letter, digit or joiner."""
    c = t.text[-1 if last else 0] if t and t.text and t.kind != LITERAL else ""
    return bool(c) and (bool(_PERSIAN_B.match(c)) or c == ZWNJ or "۰" <= c <= "۹" or "٠" <= c <= "٩")


#: What a sentence mark in Latin form becomes, with the name of its rule.
_TURNED = {",": ("،", "comma"), ";": ("؛", "semicolon"), "?": ("؟", "question-mark")}


def _line_marks(ts: list[Token], persian: bool, hits: _Hits) -> list[Token]:
    """Percent signs, sentence marks and quotation marks of one line."""
    solid = [t for t in ts if t.kind != BLANK]
    at = {id(t): k for k, t in enumerate(solid)}
    for k, t in enumerate(ts):
        before, after = (ts[k - 1] if k else None), (ts[k + 1] if k + 1 < len(ts) else None)
        if t.kind != MARK:
            continue
        if t.text == "%" and before and "۰" <= before.text[-1:] <= "۹":
            t.text = "٪"
            hits.add("percent")
        elif t.text in _TURNED:
            in_number = t.text == "," and before and after and before.kind == after.kind == DIGIT
            follower = solid[at[id(t)] + 1] if at[id(t)] + 1 < len(solid) else None
            flanked = _near(before, True) and _near(follower, False)
            own = persian and not (before and before.text[-1:].isascii() and before.text[-1:].isalpha())
            if not in_number and (own or flanked):
                t.text, name = _TURNED[t.text]
                hits.add(name)
    opened: dict[str, int] = {}
    for k, t in enumerate(ts):
        if t.kind != MARK or t.text not in '"“”':
            continue
        start = opened.pop("“" if t.text == "”" else '"', None) if t.text != "“" else None
        if start is None:
            if t.text != "”":
                opened[t.text] = k
            continue
        inner = _written(ts[start + 1 : k])
        if is_persian_line(inner) or (persian and not any(c.isascii() and c.isalpha() for c in inner)):
            ts[start].text, t.text = "«", "»"
            hits.add("quotation")
    return ts


def _spaced(ts: list[Token], persian: bool, hits: _Hits) -> list[Token]:
    """Blanks around marks in a line, and blanks that are too long or end it."""
    out: list[Token] = []
    for k, t in enumerate(ts):
        after = ts[k + 1] if k + 1 < len(ts) else None
        if t.kind == BLANK and out:
            closing = after is not None and after.kind == MARK
            if closing and ((after.text in "،؛؟»" and (persian or _near(out[-1], True))) or (after.text in ".!:" and persian)):
                hits.add("blank-before-mark")
                continue
            if out[-1].text == "«":
                hits.add("blank-after-quotation")
                continue
            if after is None:
                hits.add("blank-at-end")
                continue
            if len(t.text) > 1:
                hits.add("long-blank")
                t = Token(BLANK, " ")
        elif t.kind == BLANK and after is None:
            hits.add("blank-at-end")
            continue
        out.append(t)
    spaced: list[Token] = []
    for t, after in zip(out, [*out[1:], None], strict=False):
        spaced.append(t)
        opens = t.kind == MARK and (t.text in "،؛؟" or (t.text == "!" and persian))
        if opens and after is not None and not after.text[0].isspace() and after.text[0] not in "»)]،؛؟!.…":
            hits.add("blank-behind-mark")
            spaced.append(Token(BLANK, " "))
    return spaced


def _words_of_line(ts: list[Token], hits: _Hits) -> list[Token]:
    """Ellipses, and joiners instead of blanks inside words."""
    ts, n = _ellipses(ts, lambda before: before is not None and before.kind == WORD)
    hits.add("ellipsis", n)
    rules = [
        ("prefix", lambda word, following: word in ("می", "نمی")),
        ("plural", lambda word, following: following in SUFFIXES[:-2]),
        ("superlative", lambda word, following: following == "ترین"),
        ("enclitic", lambda word, following: following in ENCLITICS and len(word) > 1 and word.endswith("ه") and word not in FUNCTION_WORDS),
    ]
    for name, joins in rules:
        apart = {id(ts[k + 1]) for k, _, f in _gapped(ts) if f in SUFFIXES and "".join(t.text for t in ts[k + 2 : k + 6]).startswith(" و هوی")}
        if name == "plural" and apart:
            # "hay o huy" is a phrase of its own
            held = [t for t in ts if id(t) in apart]
            for t in held:
                t.kind = MARK
            ts, n = _joined(ts, joins)
            for t in held:
                t.kind = WORD
        else:
            ts, n = _joined(ts, joins)
        hits.add(name, n)
    return ts


def normalised(text: str, digits: str = "persian") -> tuple[str, dict[str, int]]:
    """The second rule set, line by line: the text and how often each rule changed it. ``digits``: persian, latin or keep."""
    hits = _Hits()
    ts = tokens(text, latin_words=False)
    letters = str.maketrans("يىكة", "ییکه")
    for k, t in enumerate(ts):
        if t.kind != WORD:
            continue
        hits.add("letters", sum(c in "يىكة" for c in t.text))
        t.text = t.text.translate(letters)
        if t.text.strip("ـ") == "" and (not k or ts[k - 1].kind in (BLANK, LINE)) and (k + 1 == len(ts) or ts[k + 1].kind in (BLANK, LINE)):
            t.text, t.kind = "–", MARK
            hits.add("kashida-dash")
        elif "ـ" in t.text:
            hits.add("kashida", t.text.count("ـ"))
            t.text = t.text.replace("ـ", "")
    ts = [t for t in ts if t.text]
    whole = is_persian_line(_written([t for t in ts if t.kind != LITERAL]))
    table, of = (ARABIC_DIGITS, "٠١٢٣٤٥٦٧٨٩") if digits == "persian" else (LATIN_DIGITS, "۰۱۲۳۴۵۶۷۸۹٠١٢٣٤٥٦٧٨٩")
    if digits != "keep":
        for t in ts:
            if t.kind == DIGIT:
                hits.add("digits", sum(c in of for c in t.text))
                t.text = t.text.translate(table)
    lines: list[list[Token]] = [[]]
    for t in ts:
        if t.kind == LINE:
            lines.append([])
        else:
            lines[-1].append(t)
    out = []
    for line in lines:
        shown = _written([t for t in line if t.kind != LITERAL])
        persian = is_persian_line(shown)
        latin = any(c.isascii() and c.isalpha() for c in shown)
        first = 1 if line and line[0].kind == BLANK else 0
        marker = line[first : first + 3]
        head = first + 2 if len(marker) == 3 and marker[0].kind == DIGIT and marker[1].text in (".", ")") and marker[2].kind == BLANK else 0
        rest = line[head:]
        if digits == "persian" and (persian or (whole and not latin)):
            for k, t in enumerate(rest):
                mixed = any(x.kind == LATIN or x.text in "-_" for x in (rest[k - 1 : k] if k else []) + rest[k + 1 : k + 2])
                if t.kind == DIGIT and t.text[0].isascii() and not mixed:
                    t.text = t.text.translate(DIGITS)
                    hits.add("digits")
        rest = _words_of_line(_spaced(_line_marks(rest, persian, hits), persian, hits), hits)
        out.append(_written(line[:head]) + _written(rest))
    return "\n".join(out), dict(hits)


# Phrases of machine or office Persian, and words in "mi" that are no verbs.
STYLE = [
    r"می‌باشد|می‌باشند|میباشد",
    r"می‌گردد|می‌گردند",
    r"مورد\s+\S+\s+قرار\s+(?:می‌گیرد|گرفت|گرفته|داد|می‌دهد)",
    r"\bدارای\b",
    r"\bتوسط\b",
    r"\bبه عنوان\b|\bبه‌عنوان\b",
    r"\bبه منظور\b|\bبه‌منظور\b|\bدر راستای\b|\bدر جهت\b",
    r"لازم به ذکر است|شایان ذکر است|قابل ذکر است|قابل توجه است که",
    r"نه تنها .{0,60}? بلکه",
    r"\bدر نهایت\b|\bدر پایان\b|\bبه طور کلی\b|\bدر مجموع\b",
    r"\bاین امر\b|\bاین موضوع\b|\bاین مسئله\b",
    r"\bایفا می‌کند\b|\bنقش (?:مهم|کلیدی|حیاتی)",
    r"\bیک\s+\S+ی?\s+است\b",
]
MI_WORDS = set(
    "میز میزان میزبان میان میانه میانگین میانبر میدان میوه میهن میهمان میمون میل میلاد میلادی میلیون میلیارد میله "
    "میخ میت میثاق میراث میکروب میکرو مینا مینو میش میگو میکده میکس میثم میرزا میر میگرن میناکاری میخانه میخک "
    "میدانی میلی میکروفون میکروسکوپ میکروفر میلیمتر میلی‌متر میانی میدانها میوه‌ها میزها میلها میخها میسر میکائیل "
    "میناب میامی میگل میلان میکل میکی میترا میثاق‌نامه".split()
)


def _glued(word: str) -> bool:
    """Whether a word may be a verb with its prefix glued on."""
    letters = re.match(f"[{LETTERS_B}]*", word).group()
    stem = letters.removeprefix("ن") if letters.startswith("نمی") else letters
    return stem.startswith("می") and len(stem) > 2 and stem not in MI_WORDS and stem.rstrip("ی") not in MI_WORDS


def suggestions(text: str, style: bool = True) -> list[str]:
    """A code for each place that the second rule set leaves to a reader; ``style`` adds phrases that are sometimes right."""
    ts = tokens(text, latin_words=False)
    comparatives = sum(following == "تر" for _, _, following in _gapped(ts))
    glued = sum(t.kind == WORD and _glued(t.text) for t in ts)
    found = ["maybe_comparative_tar"] * comparatives + ["maybe_glued_mi"] * glued + ["em_dash"] * sum(t.text == "—" for t in ts)
    shown = _written([t if t.kind != LITERAL else Token(LITERAL, "\0") for t in ts])
    return found + ["style"] * (sum(len(re.findall(x, shown)) for x in STYLE) if style else 0)


def line_changes(before: str, after: str) -> list[tuple[int, str, str]]:
    """(line, before, after) of every line that a rewrite changed."""
    return [(n, a, b) for n, (a, b) in enumerate(zip(before.split("\n"), after.split("\n"), strict=False), 1) if a != b]


fa_fix = by_text(fixed, StringType())
fa_lint = by_text(lint, ArrayType(StringType()))
fa_normalize = by_text(lambda t: normalised(t)[0], StringType())
fa_rule_hits = by_text(lambda t: normalised(t)[1], MapType(StringType(), IntegerType()))
fa_suggestions = by_text(suggestions, ArrayType(StringType()))
