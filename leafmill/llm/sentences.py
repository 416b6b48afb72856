"""Sentence units in any language and script.

A linear-chain model tags every character as boundary or inside. Only characters
that may end a unit (an end mark with what closes behind it, a Thai space, a line
end) can be boundaries, so the chain runs over these places alone. Each place has
cues: what the mark is, the word before, what follows, quotations. Their weights, and
those of a tag after a tag, maximise the likelihood of two kinds of text whose
boundaries are known, by gradients from forward-backward sums; places that nobody
labelled count as hidden:

- lines of the corpus joined with the next ones, for Thai stripped of punctuation:
  the old line end is a boundary, and places whose cues leave no doubt are inside;
- the seeds below, labelled by hand.

Viterbi decoding finds the best path. Cues rest on statistics of all documents:

- a word before a full stop that never stands at a line end is an abbreviation;
- a word behind a number with a full stop that never opens a line goes on;
- in scripts without upper case, a word before dots that never ends a line is a pause.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.session import checkpoint

#: Words rarer than this share of their kind are not in the model; so it has at most 1 / RARE words of a kind.
RARE = 1e-5
#: Texts (expected number, by hash) whose joined lines train the weights, and the most frequent kinds of joined lines that are used.
FIT_TEXTS, FIT_KINDS = 1000, 300
#: Steps and rate of the training, strength of the prior, weight of a seed against a joined line.
STEPS, RATE, PRIOR, SEED_WEIGHT = 30, 0.7, 0.02, 4.0

# Common abbreviations that never end a sentence (titles, references, units before a value).
ABBREVIATIONS = set(
    "mr mrs ms dr prof st capt col gen lt sgt rev hon gov sen rep messrs mme mlle hr fr frau hrn vol vols pp p no nos nr bd bde s "
    "cf vgl ed eds ch chap fig figs art sec al ca approx env t tome vs e.g i.e z.b d.h u.a c.-à-d z b d h p.m a.m bzw evtl ggf inkl "
    "sog jan feb mar apr jun jul aug sep sept oct nov dec "
    "ج ص ق.م ه.ش ه.ق نک ر.ک ش د م डॉ प्रो पृ क्र सं श्री".split()
)
# Words that go on after a German ordinal.
AFTER_ORDINAL = set("januar jänner februar märz april mai juni juli august september oktober november dezember jahr jahrhundert kapitel auflage band mal".split())
# Verbs that report speech, as stems that a clause beside a quotation holds.
REPORTING = regex.compile(
    r"\b(?:said|says|asked|asks|cried|cries|shouted|whispered|replied|answered|called|murmured|exclaimed|added|"
    r"sagte|fragte|rief|antwortete|flüsterte|schrie|erwiderte|meinte|"
    r"dit|demanda|cria|répondit|murmura|ajouta|s'écria|chuchota|"
    r"پرسید|گفت|پاسخ|جواب|می‌گوید|कहा|पूछा|बोला|बोली|चिल्लाया|चिल्लाई)\b|فریاد زد|داد زد|说|問|问|喊|叫|答道|言っ|叫ん|尋ね|聞い|答え"
)
# Quotation marks and brackets.
OPENERS = dict(zip("“„«‹‘‚「『（([{【〈《»›", "”“»›’‘」』）)]}】〉》«‹", strict=True))
ALWAYS_OPEN, ALWAYS_CLOSE = set("„‚「『（([{【〈《"), set("”」』）)]}】〉》")

MARK = regex.compile(r"(?:[.!?。！？…؟।॥｡]|\.\.\.)+")
NOTE = regex.compile(r"\[\[fn:[^\]\n]*\]\]")
QUOTES = regex.compile(r"""[“”„«»‹›‘’‚"「」『』（）()【】〈〉《》{}]|\[\[fn:[^\]\n]*\]\]|[\[\]]""")
LAST_WORD = regex.compile(r"[^\s\"“”„«»‹›「」『』（）()\[\]…]+$")
FIRST_WORD = regex.compile(r"\W*(\w[\w‌'’]*)")
LOWER, UPPER, WORD = regex.compile(r"\p{Ll}"), regex.compile(r"\p{Lu}|\p{Lt}"), regex.compile(r"[\p{L}\p{M}\p{Nd}]")
CJK = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}。！？｡]")
THAI, CASED = regex.compile(r"\p{Thai}"), regex.compile(r"[\p{Latin}\p{Greek}\p{Cyrillic}\p{Armenian}]")
THAI_SPACE = regex.compile(r"[^\S\n]+")
PUNCTUATION = regex.compile(r"[^\p{L}\p{M}\p{N}\s]")
NUMERAL, LATIN = regex.compile(r"\p{Nd}"), regex.compile(r"\p{Latin}")


#: Lines labelled by hand: a bar stands where a unit ends inside the line.
SEEDS = """
She closed the shop.| Nobody came back.| Why had they left?| He could not say!
Dr. Hale met Mrs. Poole at St. Anne on Jan. 4 and they talked.| Then both left.
The parcel weighed 3.5 kg (see p. 12, vol. 2).| It came by boat.
J. R. Stone wrote it.| A. Lind read it.
"Where is the key?" asked Tom.| "I lost it."| He sat down.
"Stop!" she cried.| The horse stopped.
"It rains.| We should go."| They went.
“We are late.| Hurry,” he said.| “The gate closes.| It is six,” said Ann.| She ran.
Tom said: “The boat is gone.”| No one spoke.
“No... not yet,” he said.| The lamp… went out.| They waited...| Then it rang.
He left (it was late).| (It had rained.)| She stayed.
Look at www.lamp.org or v. 2.1.4 of it.| It works.
What?!| Really?| Yes.
Note this.[[fn:n1]]| And that.
The price fell, e.g. in May, i.e. too late.| Sold!
He wrote to Messrs. Bell and Co. and waited.| Nothing came.
Der Müller schlief.| Warum kam niemand?| Er wusste es nicht!
Am 3. Mai kam Dr. Weiß, z. B. mit Hrn. Kurz, d. h. zu spät.| Er ging.
Das 4. Kapitel steht in Bd. 2 auf S. 14.| Es ist kurz.
„Wo ist das Boot?“, fragte Anna.| „Fort.“| Sie ging.
„Halt!“ rief er.| Niemand hielt.| Das Licht… erlosch.| Er kam im Jahr 1812.| Dann war Ruhe.
»Ich gehe.| Komm mit.«| Sie kam.
Le meunier dormait.| Pourquoi partir ?| Il ne savait pas !
M. Petit et Mme. Roux vinrent, cf. p. 9.| Ils parlèrent.
« Où est la clef ? » demanda Paul.| « Perdue. »| Il sortit.
« Arrêtez ! » cria-t-elle.| La voiture passa.| La lampe… tomba.| Il dit : « C'est fini. »| Puis rien.
می‌گفتند … گاهی … که او رفت.| کسی ندید.
او آرام نشست…| در باز شد…| باد آمد.
او رفت (نک. ص. ۳.) به شهر.| شب شد.
वह रुका…| दरवाज़ा खुला।
He paid (not at once.)| She smiled.
آسیابان خوابید.| چرا کسی نیامد؟| او نمی‌دانست!
«کلید کجاست؟» پرسید مریم.| «گم شد.»| او رفت.
«بایست!» فریاد زد.| اسب ایستاد.| نک. ج. ۲، ص. ۱۴، دربارهٔ ماه.| تمام شد.
磨坊主睡着了。|为什么没人来？|他不知道！
“站住！”她喊道。|马停了。|他说：“船走了。”|没人回答……只有风。|天亮了。
“下雨了。|我们走吧。”|他们走了。
「鍵はどこだ？」と彼は聞いた。|誰も答えない。|雨が降る……らしい。|「行こう。」と母が言った。
「待って！」と彼女は叫んだ。|馬は止まった。|なぜだ？|朝が来た。
चक्कीवाला सो गया।| कोई क्यों नहीं आया?| वह नहीं जानता था!
"चाबी कहाँ है?" उसने पूछा।| "खो गई।"| वह चला गया।
डॉ. वर्मा और श्री. मिश्र आए, पृ. ४ देखो।| वे बैठे।
คนเฝ้าประตูหลับ| ไม่มีใครมา| เขาหนัก 4 กิโลกรัม| เรือออกช้า ๆ แล้ว| มี| Old Lamp| อยู่
""".strip().split("\n")

#: A place: where a unit may end, its cues, and whether it closes a quotation around the place before it.
Place = tuple[int, tuple[str, ...], bool]


@dataclass
class SentenceModel:
    """What decoding needs: words of the corpus, lower-cased, weights of cues and of tags after tags (linked, before, here)."""

    abbreviations: set[str] = field(default_factory=set)
    after_number: set[str] = field(default_factory=set)
    pauses: set[str] = field(default_factory=set)
    weights: dict[str, float] = field(default_factory=lambda: dict(_seed_weights()[0]))
    steps: dict[tuple[bool, int, int], float] = field(default_factory=lambda: dict(_seed_weights()[1]))


def _roles(line: str) -> tuple[dict[int, int], list[tuple[int, int]]]:
    """Closing marks (place -> place of their opener) of a line, and the spans of its note tokens."""
    closes, stack, notes = {}, [], []
    for found in QUOTES.finditer(line):
        c, at = found.group(), found.start()
        if len(c) > 1:
            notes.append(found.span())
            continue
        top = stack[-1] if stack else None
        if c in ("’", "'") and at and at + 1 < len(line) and line[at - 1].isalpha() and line[at + 1].isalpha():
            continue
        if top and (c == top[1]):
            closes[at] = stack.pop()[0]
        elif c == '"':
            stack.append((at, '"'))
        elif c in ALWAYS_CLOSE or c == "’":
            match = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][1] == c), None)
            closes[at] = stack[match][0] if match is not None else -1
            if match is not None:
                del stack[match:]
        elif c in OPENERS:
            stack.append((at, OPENERS[c]))
    return closes, notes


def _class(c: str) -> str:
    if not c:
        return "none"
    if NUMERAL.match(c):
        return "numeral"
    if c == "ๆ":
        return "repeat"
    return "latin" if LATIN.match(c) else "other"


def _report_follows(rest: str) -> bool:
    """Whether ``rest``, behind a quotation that opened its unit, starts with its reporting clause."""
    if rest.startswith("と"):
        return True
    stop = regex.search(r"[.!?。！？…؟।:：“„«「\"\n]", rest)
    clause = rest[: stop.start()] if stop else rest
    if stop and stop.group() in ":：“„«「\"…":
        return False
    return bool(REPORTING.search(clause))


def _following(nxt: str) -> str:
    if UPPER.match(nxt):
        return "upper"
    if nxt in OPENERS or nxt == '"':
        return "open"
    return "wide" if CJK.match(nxt) else "numeral" if NUMERAL.match(nxt) else "other"


#: Cues that leave no doubt that a place is inside.
SURE = {"joined", "lower", "goes-on"}


def _last_word(line: str, at: int) -> str:
    reach = 40
    while True:
        low = max(0, at - reach)
        found = LAST_WORD.search(line, low, at)
        if found is None or found.start() > low or not low:
            return found.group().lower() if found else ""
        reach *= 4


def _cues(line: str, at: int, mark: str, end: int, closed: list[int], before: int, model: SentenceModel) -> tuple[str, ...]:
    """What speaks for or against a unit's end at ``end``; the mark starts at ``at``, ``closed`` are openers of the quotes it closes."""
    rest = line[end:]
    bare = rest.lstrip()
    nxt = bare[0]
    full = regex.search(r"[。！？｡।॥؟]", mark) is not None
    if len(bare) == len(rest) and not closed and not full and WORD.match(nxt):
        return ("joined",)  # numbers, versions, addresses, initials written together
    if LOWER.match(nxt):
        return ("lower",)
    if nxt in ",;:،؛，；、)]）»”’」』-–—/":
        return ("goes-on",)
    follows = _following(nxt)
    quoted = [q for q in closed if line[q] not in "([（{【"]
    if quoted:  # a quotation and its reporting clause
        reported = not line[before : quoted[-1]].strip() and _report_follows(bare)
        return ("reported",) if reported else ("quoted", f"next:{follows}")
    word = _last_word(line, at)
    if "…" in mark or mark.startswith(".."):
        if UPPER.match(bare.lstrip("".join(OPENERS) + " \u00a0\u202f")[:1]):
            return ("dots:upper",)
        if CASED.match(nxt) or CJK.match(nxt):
            return ("dots:cased",)
        return ("dots:pause",) if word in model.pauses or not word else ("dots:word",)
    if mark == ".":
        if closed and line[closed[-1]] in "(（[" and line[before : closed[-1]].strip():
            return ("bracket:upper",) if follows == "upper" else ("bracket:other",)
        if word and word[-1].isdigit():
            follower = FIRST_WORD.match(bare)
            return ("ordinal",) if follower and follower.group(1).lower() in model.after_number | AFTER_ORDINAL else ("number", f"next:{follows}")
        letters = word.strip(".")
        if len(letters) == 1 and letters.isalpha() and CASED.match(letters):
            return ("initial",)
        if letters in model.abbreviations or letters in ABBREVIATIONS:
            return ("abbreviation",)
        return ("stop", f"next:{follows}")
    return ("full" if full else "strong", f"next:{follows}")


def _marks(line: str, model: SentenceModel) -> list[Place]:
    """The places in a line behind an end mark, but for the line's end."""
    places: list[Place] = []
    if not MARK.search(line):
        return places
    closes, notes = _roles(line)
    noted = dict(notes)
    done = 0
    for found in MARK.finditer(line):
        if found.start() < done or any(a <= found.start() < b for a, b in notes):
            continue
        end, closed = found.end(), []
        while end < len(line):
            jump = end
            while jump < len(line) and line[jump].isspace():
                jump += 1
            if end in noted:
                end = noted[end]
            elif end in closes:
                closed.append(closes[end])
                end += 1
            elif jump > end and jump in closes and closes[jump] >= 0 and line[jump] in "»›":
                closed.append(closes[jump])
                end = jump + 1
            elif MARK.match(line, end):
                end = MARK.match(line, end).end()
            else:
                break
        done = end
        if not line[end:].strip():
            break
        inner = [q for q in closed if q >= 0]
        limit = inner[-1] if inner else end
        # a quotation that began earlier opens the unit that began with it
        before = max([e for e, cues, _ in places if e <= limit and not SURE.intersection(cues)], default=0)
        linked = bool(inner and places and places[-1][0] > inner[-1])
        places.append((end, _cues(line, found.start(), found.group(), end, inner, before, model), linked))
    return places


def _thai_spaces(line: str) -> list[Place]:
    kinds = ((m.start(), _class(line[m.start() - 1 : m.start()]), _class(line[m.end() : m.end() + 1])) for m in THAI_SPACE.finditer(line))
    return [(at, (f"space:{left}:{right}",), False) for at, left, right in kinds if "none" not in (left, right)]


def _scores(cues: tuple[str, ...], linked: bool, model: SentenceModel) -> tuple[float, tuple[float, ...]]:
    """The score of a boundary at a place, and of (inside, boundary) here after inside and after a boundary."""
    step = model.steps
    return sum(model.weights.get(c, 0.0) for c in cues), tuple(step.get((linked, a, b), 0.0) for a in (0, 1) for b in (0, 1))


def _decode(places: list[Place], model: SentenceModel) -> list[int]:
    """Ends on the best path of the chain; before the first place stands a boundary, the line's start."""
    inside, edge = -math.inf, 0.0
    back: list[tuple[int, int]] = []
    for _, cues, linked in places:
        score, (ii, ib, bi, bb) = _scores(cues, linked, model)
        stay, cut = (inside + ii, edge + bi), (inside + ib + score, edge + bb + score)
        back.append((int(stay[1] > stay[0]), int(cut[1] > cut[0])))
        inside, edge = max(stay), max(cut)
    state, ends = int(edge > inside), []
    for k in range(len(places) - 1, -1, -1):
        if state:
            ends.append(places[k][0])
        state = back[k][state]
    return ends[::-1]


def is_thai(line: str) -> bool:
    return THAI.search(line) is not None and len(THAI.findall(line)) * 2 >= len(LATIN.findall(line))


def line_places(line: str, model: SentenceModel) -> list[Place]:
    """All places inside a line that may end a unit."""
    places = _marks(line, model)
    if is_thai(line):
        marked = {e for e, _, _ in places}
        places = sorted([*places, *(x for x in _thai_spaces(line) if x[0] not in marked)])
    return places


def line_ends(line: str, model: SentenceModel) -> list[int]:
    """Where each unit of one line ends, counted from the line's start."""
    stripped = line.rstrip()
    if not stripped:
        return []
    ends = [e for e in _decode(line_places(stripped, model), model) if stripped[:e].strip()]
    return [*ends, len(stripped)]


def text_ends(text: str, model: SentenceModel, known: dict[str, list[int]] | None = None) -> list[int]:
    """Where each unit of a text ends; ``known`` keeps lines that recur."""
    ends, start = [], 0
    for line in text.split("\n"):
        found = known.get(line) if known is not None else None
        if found is None:
            found = line_ends(line, model)
            if known is not None and len(line) < 400:
                if len(known) > 50_000:
                    known.clear()
                known[line] = found
        ends += [start + e for e in found]
        start += len(line) + 1
    return ends


#: What is trained on: for each place its cues, whether it is linked, and its tag (1, 0, or None where nobody knows).
Sequence = tuple[tuple[tuple[str, ...], bool, int | None], ...]


def _seeded(model: SentenceModel) -> list[Sequence]:
    out = []
    for seed in SEEDS:
        parts = seed.split("|")
        line, ends = "".join(parts), set()
        for k in range(1, len(parts)):
            ends.add(len("".join(parts[:k])))
        out.append(tuple((cues, linked, int(end in ends)) for end, cues, linked in line_places(line, model)))
    return [x for x in out if x]


def _sure(cues: tuple[str, ...]) -> bool:
    return bool(SURE.intersection(cues)) or any(c.startswith("space:") and ("numeral" in c or "repeat" in c or c == "space:latin:latin") for c in cues)


def joined_lines(text: str, model: SentenceModel) -> Iterator[Sequence]:
    """Each line joined with the next one; of Thai lines all punctuation is taken off first."""
    lines = [x.strip() for x in text.split("\n") if x.strip()]
    for first, second in zip(lines[::2], lines[1::2], strict=False):
        if is_thai(first) and is_thai(second):
            first, second = (PUNCTUATION.sub("", x).strip() for x in (first, second))
        glue = "" if CJK.search(first[-1:]) else " "
        places = line_places(f"{first}{glue}{second}", model)
        labelled = tuple((cues, linked, 0 if _sure(cues) else 1 if end == len(first) and not cues[0].startswith("dots") and cues != ("reported",) else None) for end, cues, linked in places)
        if any(tag is not None for *_, tag in labelled):
            yield labelled


def _sums(sequence: Sequence, model: SentenceModel, known: bool, add: Callable[[object, float], None]) -> None:
    """``add`` the expected count of each cue and step, over all paths or over those that keep the ``known`` tags."""
    low = -1e9
    ahead, scores = [(low, 0.0)], []
    for cues, linked, tag in sequence:
        score, (ii, ib, bi, bb) = _scores(cues, linked, model)
        allowed = (0.0 if not known or tag != 1 else low, 0.0 if not known or tag != 0 else low)
        scores.append((score, ii, ib, bi, bb, allowed))
        inside, edge = ahead[-1]
        ahead.append((_log_sum(inside + ii, edge + bi) + allowed[0], _log_sum(inside + ib, edge + bb) + score + allowed[1]))
    total = _log_sum(*ahead[-1])
    after = (0.0, 0.0)
    for k in range(len(sequence) - 1, -1, -1):
        (cues, linked, _), (score, ii, ib, bi, bb, allowed) = sequence[k], scores[k]
        to = (after[0] + allowed[0], after[1] + score + allowed[1])
        for a, b, step in ((0, 0, ii), (0, 1, ib), (1, 0, bi), (1, 1, bb)):
            share = math.exp(min(0.0, ahead[k][a] + step + to[b] - total))
            add((linked, a, b), share)
            if b:
                for cue in cues:
                    add(cue, share)
        after = _log_sum(ii + to[0], ib + to[1]), _log_sum(bi + to[0], bb + to[1])


def _log_sum(a: float, b: float) -> float:
    high = max(a, b)
    return high + math.log1p(math.exp(min(a, b) - high))


def train(model: SentenceModel, sequences: dict[Sequence, float]) -> SentenceModel:
    """Weights that make the known tags likely: adaptive gradient steps with a normal prior."""
    squares: dict[object, float] = {}
    for _ in range(STEPS):
        slope: dict[object, float] = {}
        for sequence, times in sequences.items():
            for known in (True, False):
                sign = times if known else -times

                def add(name: object, share: float, sign: float = sign) -> None:
                    slope[name] = slope.get(name, 0.0) + sign * share

                _sums(sequence, model, known, add)
        for name, g in slope.items():
            table = model.weights if isinstance(name, str) else model.steps
            g -= PRIOR * table.get(name, 0.0)
            squares[name] = squares.get(name, 0.0) + g * g
            if g:
                table[name] = table.get(name, 0.0) + RATE * g / math.sqrt(squares[name])
    return model


def _seed_sequences(model: SentenceModel) -> dict[Sequence, float]:
    sequences: dict[Sequence, float] = {}
    for sequence in _seeded(model):
        sequences[sequence] = sequences.get(sequence, 0.0) + SEED_WEIGHT
    return sequences


@lru_cache(1)
def _seed_weights() -> tuple[dict[str, float], dict[tuple[bool, int, int], float]]:
    """Weights from the seeds alone, where there is no corpus."""
    model = SentenceModel(weights={}, steps={})
    train(model, _seed_sequences(model))
    return model.weights, model.steps


def _kinds(batches: Iterator[pa.RecordBatch], shared: Broadcast) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts: dict[str, int] = {}
        for text in batch.column(0).to_pylist():
            for sequence in joined_lines(text, shared.value):
                kind = json.dumps(sequence)
                counts[kind] = counts.get(kind, 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], names=["kind", "n"])


def trained(model: SentenceModel, texts: DataFrame) -> SentenceModel:
    """Weights from the seeds and from joined lines of about ``FIT_TEXTS`` texts, the most frequent ``FIT_KINDS`` kinds of them."""
    sequences = _seed_sequences(model)
    total = max(1, texts.count())
    sample = texts.where(F.pmod(F.xxhash64("text"), F.lit(total)) < FIT_TEXTS)
    shared = texts.sparkSession.sparkContext.broadcast(model)
    kinds = sample.mapInArrow(lambda batches: _kinds(batches, shared), "kind string, n long").groupBy("kind").agg(F.sum("n").alias("n"))
    for row in kinds.orderBy(F.desc("n"), "kind").limit(FIT_KINDS).collect():
        sequence = tuple((tuple(cues), linked, tag) for cues, linked, tag in json.loads(row.kind))
        sequences[sequence] = sequences.get(sequence, 0.0) + math.log1p(row.n)
    return train(model, sequences)


def fit(documents: DataFrame) -> SentenceModel:
    """The model: statistics of all texts, counted in documents, then weights."""
    texts = documents.where(F.col("text").isNotNull()).select("text")
    each = lambda pattern: F.regexp_extract_all("text", F.lit(pattern), 1)
    kinds = [
        ("stop", each(r"(?<!\S)[\p{Ps}\p{Pi}\p{Pf}\"]*([^\s…]+)\.(?=\s|$)")),
        ("end", each(r"(?m)(?<!\S)[\p{Ps}\p{Pi}\p{Pf}\"]*(\S+?)[.!?؟।]+[\p{Pe}\p{Pi}\p{Pf}\"]*[ \t]*$")),
        ("dots", each(r"(?<!\S)([^\s….]+)(?:…|\.\.\.)(?=\s)")),
        ("number", each(r"\p{Nd}\. +([^\s\p{P}]+)")),
        ("start", each(r"(?m)^[\p{P}\s]*([^\s\p{P}]+)")),
    ]

    def tagged(kind: str, found: Column) -> Column:
        return F.transform(F.array_distinct(found), lambda w: F.struct(F.lit(kind).alias("kind"), F.lower(w).alias("word")))

    words = F.flatten(F.array(*[tagged(kind, found) for kind, found in kinds]))
    counted = texts.select(F.explode(words).alias("w")).groupBy("w.kind", "w.word").agg(F.count(F.lit(1)).alias("n"))
    counted = checkpoint(counted)
    model = _model(counted)
    return trained(model, texts)


def _model(counted: DataFrame) -> SentenceModel:
    """Words that end or open lines are looked up in the exact counts; only the words found are cut by ``RARE``."""
    model = SentenceModel(weights={}, steps={})
    of = lambda kind: counted.where(F.col("kind") == kind).select("word", F.col("n").alias(f"n_{kind}"))
    totals = {r.kind: r.total for r in counted.groupBy("kind").agg(F.sum("n").alias("total")).collect()}  # five rows
    least = lambda kind: max(2, RARE * totals.get(kind, 0))
    stops = of("stop").where(F.col("n_stop") >= least("stop"))
    sums = stops.join(of("end"), "word", "left").agg(F.sum("n_end").alias("ends"), F.sum("n_stop").alias("stops")).first()
    share = min(0.9, max(0.02, (sums.ends or 0) / max(sums.stops or 0, 1)))
    # log-odds that a word which never ends a line is an abbreviation
    enough = -F.col("n_stop") * math.log(1 - share) > 5
    for row in stops.where(enough).join(of("end"), "word", "left_anti").toLocalIterator():  # at most 1 / RARE words of each kind
        if any(c.isalpha() for c in row.word):
            model.abbreviations.add(row.word)
    often = F.col("n_number") >= max(9, least("number"))
    for row in of("number").where(often).join(of("start"), "word", "left_anti").toLocalIterator():
        if not row.word[0].isdigit():
            model.after_number.add(row.word)
    for row in of("dots").where(F.col("n_dots") >= least("dots")).join(of("end"), "word", "left_anti").toLocalIterator():
        model.pauses.add(row.word)
    return model


def _tag(batches: Iterator[pa.RecordBatch], shared: Broadcast) -> Iterator[pa.RecordBatch]:
    known: dict[str, list[int]] = {}
    for batch in batches:
        ids, ends = [], []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            found = text_ends(text, shared.value, known)
            ids += [doc_id] * len(found)
            ends += found
        yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field(0).type), pa.array(ends, pa.int32())], names=["doc_id", "end_pos"])


def sentence_ends(documents: DataFrame, model: SentenceModel | None = None) -> DataFrame:
    """(doc_id, end_pos): the place just behind the last character of each unit.

    Null, empty and blank texts have no units; repeated rows of a document give
    each unit once. The model is fit on all texts of ``documents`` unless given.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model or fit(documents))
    rows = documents.where(F.col("text").isNotNull()).select("doc_id", "text")
    kind = dict(documents.dtypes)["doc_id"]
    return rows.mapInArrow(lambda batches: _tag(batches, shared), f"doc_id {kind}, end_pos int").distinct()
