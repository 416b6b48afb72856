"""Sentence alignment of a passage and its rough translation.

Terms of both languages get vectors in one space from the singular value
decomposition of the term-by-term matrix of paired texts, X^T Y, for each pair of
languages. The matrix is never built: subspace iteration multiplies it from both
sides, each partition adding up its texts. Terms are hashed, so a vector table has
a fixed size. A first model comes from whole passages, a second from the lines the
first pairs.

Lines are matched as windows of one to three neighbours, by the cosine less the mean
of each side's nearest neighbours (the margin), in any order: windows that are each
other's best partners pair up, then those of the lines that are left, until none are.
"""

from __future__ import annotations

import unicodedata
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  pa.compute
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.session import checkpoint, spread

#: Hashed terms of a language in a pair, dimensions of the vectors, rounds of subspace iteration, rows of a table in one block.
TERMS, DIMENSIONS, ROUNDS, BLOCK = 1 << 13, 128, 2, 512
#: Nearest neighbours in the margin, least margin of a pair, most lines in a window, gain that each merged line must bring.
NEIGHBOURS, LEAST_MARGIN, MERGED, MERGE_GAIN = 4, 0.12, 3, 0.02
#: Pairs of languages that one model holds: it bounds the memory of a task and of the driver.
PAIRS = 8
#: Weight of equal numbers and names, and of equal relative places, in a similarity.
EQUAL, PLACE = 0.5, 0.1

WORD = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}]|\p{Nd}+|[\p{L}\p{M}‌'’-]+")


# Frequent words by which languages of the Latin script are told apart.
FREQUENT = {
    "en": set("the of and in to a that was is his her with for on at by from who".split()),
    "de": set("der die das und in den dem des ein eine einen von im am auf mit wer zu".split()),
    "fr": set("le la les de des du et un une dans à au sur qui en par que l d".split()),
    "es": set("el la los las de del y en un una que por con su al quien".split()),
    "it": set("il lo la gli di del della e in un una che per con nel chi".split()),
}
SCRIPTS = {"fa": r"\p{Arabic}", "ja": r"\p{Hiragana}\p{Katakana}", "zh": r"\p{Han}", "hi": r"\p{Devanagari}", "th": r"\p{Thai}", "ru": r"\p{Cyrillic}"}
RUNS = regex.compile("|".join(f"(?P<{name}>[{letters}]+)" for name, letters in SCRIPTS.items()) + r"|(?P<other>\p{L}+)")
LANGUAGES = [*FREQUENT, *SCRIPTS]


def language(text: str) -> int:
    """The number of the language a text is most likely in; tags may be missing."""
    counts: dict[str, int] = {}
    words = []
    for run in RUNS.finditer(text):
        counts[run.lastgroup] = counts.get(run.lastgroup, 0) + len(run.group())
        if run.lastgroup == "other":
            words.append(run.group().casefold())
    best = max(SCRIPTS, key=lambda name: counts.get(name, 0))
    if 2 * counts.get(best, 0) > sum(counts.values()):
        return LANGUAGES.index(best)
    return max(range(len(FREQUENT)), key=lambda k: sum(map(FREQUENT[LANGUAGES[k]].__contains__, words)))


@lru_cache(1 << 16)
def _word(word: str) -> tuple[tuple[int, ...], str | None]:
    """Hashed terms of a word, and how it is written in any language if it is a number or a Latin name."""
    plain, alike = word.casefold().strip("'’-"), None
    if not plain:
        return (), None
    if plain[0].isdigit():
        plain = alike = "".join(str(unicodedata.digit(c, c)) for c in plain)
    elif word[0].isupper():
        alike = "".join(c for c in unicodedata.normalize("NFD", plain) if not unicodedata.combining(c))
    whole = zlib.crc32(plain.encode()) % TERMS
    return (whole, zlib.crc32(("^" + plain[:5]).encode()) % TERMS) if len(plain) > 6 else (whole,), alike


def terms(line: str) -> tuple[list[int], list[str]]:
    """Hashed terms of a line, and those that are written alike in any language (numbers, Latin names)."""
    ids, alike = [], []
    for word in WORD.findall(line):
        own, same = _word(word)
        ids += own
        if same is not None:
            alike.append(same)
    return ids, alike


@dataclass
class Model:
    """For each pair of languages that occurs its number; for each side weights of terms, their rows, and vectors in these rows."""

    pairs: dict[int, int]
    weights: tuple[np.ndarray, np.ndarray] | None = None
    rows: tuple[np.ndarray, np.ndarray] | None = None
    vectors: tuple[np.ndarray, np.ndarray] | None = None

    def base(self, pair: int) -> int | None:
        """Where the terms of a pair of languages begin, None if the model does not hold it."""
        at = self.pairs.get(pair)
        return None if at is None else at * TERMS

    def bags(self, lines: list[list[int]], side: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(line, row, weight) of the known terms of all lines, each line's weights with norm 1."""
        size = len(self.weights[side])
        of = np.repeat(np.arange(len(lines)), [len(x) for x in lines])
        ids = np.fromiter((i for x in lines for i in x), np.int64, len(of))
        unique, counts = np.unique(of * size + ids, return_counts=True)
        of, ids = np.divmod(unique, size)
        known = self.weights[side][ids] > 0
        of, ids, counts = of[known], ids[known], counts[known]
        values = (1 + np.log(counts)) * self.weights[side][ids]
        norms = np.sqrt(np.bincount(of, values**2, len(lines)))
        return of, self.rows[side][ids], (values / norms[of]).astype(np.float32)


#: What is added up comes as columns of a batch: for each side the offsets of its bags, and their entries.
Add = Callable[[pa.RecordBatch, np.ndarray], None]


def _entries(batch: pa.RecordBatch, column: str) -> tuple[np.ndarray, np.ndarray]:
    """The flat entries of a list column and the row of each."""
    lists = batch.column(column)
    return lists.flatten().to_numpy(zero_copy_only=False), pa.compute.list_parent_indices(lists).to_numpy(zero_copy_only=False)


def _added(table: np.ndarray, rows: np.ndarray, values: np.ndarray) -> None:
    """``table[rows] += values`` with rows that repeat."""
    order = np.argsort(rows, kind="stable")
    found, starts = np.unique(rows[order], return_index=True)
    if len(found):
        table[found] += np.add.reduceat(values[order], starts, axis=0)


def _summed(texts: DataFrame, size: int, columns: int, add: Add) -> np.ndarray:
    """The sum over all partitions of a table that ``add`` fills from the bags in ``texts``.

    Partitions send the rows they touched, in blocks; blocks are added up apart,
    and the table of 2 * ``size`` rows, the target's below the source's, returns.
    """
    schema = "block int, at binary, data binary"

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros((2 * size, columns), np.float32)
        for batch in batches:
            for low in range(0, len(batch), 1000):
                add(batch.slice(low, 1000), table)
        yield from emit(table)

    def emit(table: np.ndarray, start: int = 0) -> Iterator[pa.RecordBatch]:
        for low in range(0, len(table), BLOCK):
            part = table[low : low + BLOCK]
            at = np.flatnonzero(part.any(axis=1))
            if len(at):
                row = [(start + low) // BLOCK], [at.astype(np.int32).tobytes()], [part[at].tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array(row[0], pa.int32()), pa.array(row[1], pa.binary()), pa.array(row[2], pa.binary())], names=["block", "at", "data"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, at, data in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                held = blocks.setdefault(block, np.zeros((BLOCK, columns), np.float32))
                held[np.frombuffer(at, np.int32)] += np.frombuffer(data, np.float32).reshape(-1, columns)
        for block, held in blocks.items():
            yield from emit(held, block * BLOCK)

    table = np.zeros((2 * size, columns), np.float32)
    for row in texts.mapInArrow(fill, schema).repartition("block").mapInArrow(merge, schema).collect():
        table[row.block * BLOCK + np.frombuffer(row["at"], np.int32)] += np.frombuffer(row["data"], np.float32).reshape(-1, columns)
    return table


def _weights(bags: DataFrame, pairs: int) -> tuple[np.ndarray, np.ndarray]:
    size = pairs * TERMS

    def count(batch: pa.RecordBatch, table: np.ndarray) -> None:
        for side, column in enumerate(("source", "target")):
            ids, of = _entries(batch, column)
            distinct = np.unique(of.astype(np.int64) * size + ids) % size
            table[:, 0] += np.bincount(distinct + side * size, minlength=len(table))
            if not side:
                firsts = np.unique(of, return_index=True)[1]
                table[:, 1] += np.bincount(ids[firsts] // TERMS * TERMS, minlength=len(table))

    table = _summed(bags, size, 2, count)
    total = np.tile(np.repeat(np.maximum(1, table[:size:TERMS, 1]), TERMS), 2)
    idf = np.log((1 + total) / (1 + table[:, 0])).astype(np.float32)
    idf[table[:, 0] < 2] = 0  # a term of one text tells nothing about another
    return idf[:size], idf[size:]


def fit(bags: DataFrame, pairs: dict[int, int], dimensions: int = DIMENSIONS, rounds: int = ROUNDS) -> Model:
    """The model of paired bags of terms: (source array<int>, target array<int>)."""
    context = bags.sparkSession.sparkContext
    model = Model(pairs, _weights(bags, len(pairs)))
    known = [np.flatnonzero(w > 0) for w in model.weights]
    model.rows = tuple(np.zeros(len(w), np.int32) for w in model.weights)
    for rows, at in zip(model.rows, known, strict=True):
        rows[at] = np.arange(len(at))
    # where each pair's rows begin and end
    cuts = [np.searchsorted(at, np.arange(len(pairs) + 1) * TERMS) for at in known]
    size = max(len(at) for at in known)
    shared_model = context.broadcast(model)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns = []
            for side, name in enumerate(("source", "target")):
                of, rows, values = shared_model.value.bags(b.column(name).to_pylist(), side)
                ends = pa.array(np.searchsorted(of, np.arange(len(b) + 1)), pa.int32())
                columns += [pa.ListArray.from_arrays(ends, pa.array(rows, pa.int32())), pa.ListArray.from_arrays(ends, pa.array(values, pa.float32()))]
            yield pa.RecordBatch.from_arrays(columns, names=["r0", "v0", "r1", "v1"])

    weighed = checkpoint(bags.mapInArrow(weigh, "r0 array<int>, v0 array<float>, r1 array<int>, v1 array<float>"))

    def product(given: np.ndarray, side: int) -> np.ndarray:
        """X^T Y given for side 0, Y^T X given for side 1."""
        shared = context.broadcast(given.astype(np.float16))

        def add(batch: pa.RecordBatch, table: np.ndarray) -> None:
            vectors = shared.value
            (other, of), (weights, _) = _entries(batch, f"r{1 - side}"), _entries(batch, f"v{1 - side}")
            texts = np.zeros((len(batch), dimensions), np.float32)
            _added(texts, of, vectors[other].astype(np.float32) * weights[:, None])
            (own, of), (weights, _) = _entries(batch, f"r{side}"), _entries(batch, f"v{side}")
            _added(table, own + side * size, texts[of] * weights[:, None])

        summed = _summed(weighed, size, dimensions, add)[side * size : side * size + len(known[side])]
        shared.destroy()
        return summed

    def orthonormal(table: np.ndarray, side: int) -> np.ndarray:
        """The columns of each pair's rows made orthonormal; a pair with few terms gets fewer columns."""
        out = np.zeros_like(table)
        for low, high in zip(cuts[side][:-1], cuts[side][1:], strict=True):
            if high > low:
                q = np.linalg.qr(table[low:high])[0]
                out[low:high, : q.shape[1]] = q
        return out

    right = np.random.default_rng(1).standard_normal((len(known[1]), dimensions)).astype(np.float32)
    for k in range(rounds):
        left = orthonormal(product(right, 0), 0)
        basis = product(left, 1)
        right = orthonormal(basis, 1) if k + 1 < rounds else basis
    for p in range(len(pairs)):
        ls, rs = (slice(cuts[side][p], cuts[side][p + 1]) for side in (0, 1))
        if rs.stop == rs.start:
            continue
        v, s, w = np.linalg.svd(basis[rs], full_matrices=False)
        scale = np.where(s > 1e-4 * max(s[0], 1e-9), (s / max(s[0], 1e-9)) ** 0.25, 0)
        turned = left[ls] @ w.T * scale
        left[ls], right[rs] = 0, 0
        left[ls, : len(s)], right[rs, : len(s)] = turned, v * scale
    shared_model.destroy()
    model.vectors = left.astype(np.float16), right.astype(np.float16)
    return model


def _unit(rows: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(norms > 1e-9, norms, 1)


@dataclass
class _Side:
    """Windows of a text: unit vectors, first line and number of lines of each, alike terms of each line, places."""

    vectors: np.ndarray
    first: np.ndarray
    size: np.ndarray
    numbers: list[int]
    alike: list[set[str]]

    @classmethod
    def of(cls, lines: list[str], model: Model, side: int, base: int) -> _Side:
        numbers = [k for k, line in enumerate(lines, 1) if line.strip()]
        found = [terms(lines[k - 1]) for k in numbers]
        at, rows, values = model.bags([[base + i for i in ids] for ids, _ in found], side)
        single = np.zeros((len(numbers), model.vectors[side].shape[1]), np.float32)
        _added(single, at, model.vectors[side][rows].astype(np.float32) * values[:, None])
        # a merged window holds the terms of all its lines
        sums = np.vstack([np.zeros_like(single[:1]), np.cumsum(single, axis=0)])
        n = len(numbers)
        sizes = range(1, min(MERGED, n) + 1)
        vectors = [sums[k:] - sums[: n + 1 - k] for k in sizes]
        first = np.concatenate([np.arange(n + 1 - k) for k in sizes]) if n else np.zeros(0, int)
        size = np.repeat(list(sizes), [n + 1 - k for k in sizes]) if n else np.zeros(0, int)
        return cls(_unit(np.vstack(vectors)) if n else single, first, size, numbers, [set(same) for _, same in found])

    def holds(self, common: list[str]) -> np.ndarray:
        """Which of the ``common`` terms each window holds."""
        own = np.array([[c in a for c in common] for a in self.alike], np.float32)
        sums = np.vstack([np.zeros_like(own[:1]), np.cumsum(own, axis=0)])
        return (sums[self.first + self.size] - sums[self.first] > 0).astype(np.float32)

    @property
    def places(self) -> np.ndarray:
        return (self.first + self.size / 2) / len(self.numbers)

    def lines(self, window: int) -> list[int]:
        low = self.first[window]
        return self.numbers[low : low + self.size[window]]


def _mean_top(scores: np.ndarray, k: int) -> np.ndarray:
    k = min(k, scores.shape[1])
    return np.partition(scores, -k, axis=1)[:, -k:].mean(axis=1) if k else np.zeros(len(scores))


def _best_part(scores: np.ndarray, side: _Side) -> np.ndarray:
    """For every window of a side (rows) the best score of its lines alone and of its smaller windows."""
    n, out = len(side.numbers), np.full_like(scores, -np.inf)
    best, low = scores[:n], n
    for k in range(2, min(MERGED, n) + 1):
        high = low + n + 1 - k
        out[low:high] = np.maximum(best[:-1], best[1:])
        best, low = np.maximum(out[low:high], scores[low:high]), high
    return out


def match(text: str, target: str, pair: int, model: Model) -> list[tuple[list[int], list[int], float]]:
    """Pairs of windows (source lines, target lines, margin) that are each other's best partners."""
    base = model.base(pair)
    if base is None:
        return []
    s, t = _Side.of(text.split("\n"), model, 0, base), _Side.of(target.split("\n"), model, 1, base)
    n, m = len(s.numbers), len(t.numbers)
    if not n or not m or not s.vectors.shape[1]:
        return []
    scores = s.vectors @ t.vectors.T
    common = sorted(set().union(*s.alike) & set().union(*t.alike))
    if common:
        a, b = s.holds(common), t.holds(common)
        both = a @ b.T
        scores += EQUAL * both / np.maximum(a.sum(axis=1)[:, None] + b.sum(axis=1)[None, :] - both, 1)
    scores += PLACE * (1 - np.minimum(1, np.abs(s.places[:, None] - t.places[None, :]) * 4))
    # windows' usual best scores, taken among single lines
    margins = scores - (_mean_top(scores[:, :m], NEIGHBOURS + 1)[:, None] + _mean_top(scores[:n].T, NEIGHBOURS + 1)[None, :]) / 2
    # a merged window must beat its parts; lines merged on both sides must have no partners of their own
    merged = s.size[:, None] + t.size[None, :] - 2
    worse = np.maximum(_best_part(scores, s), _best_part(scores.T, t).T) + MERGE_GAIN * merged > scores
    apart = np.maximum(_best_part(margins, s), _best_part(margins.T, t).T) >= LEAST_MARGIN
    worse |= apart & (s.size[:, None] > 1) & (t.size[None, :] > 1)
    ranked = np.where(worse | (margins < LEAST_MARGIN), -np.inf, scores + margins)
    found = []
    while True:
        i, j = np.arange(len(ranked)), ranked.argmax(axis=1)
        mutual = (ranked[i, j] > -np.inf) & (ranked.argmax(axis=0)[j] == i)
        i, j = i[mutual], j[mutual]
        if not len(i):
            return found
        for k in np.argsort(-ranked[i, j], kind="stable"):
            x, y = i[k], j[k]
            if ranked[x, y] == -np.inf:  # a line of it was taken in this round
                continue
            found.append((s.lines(x), t.lines(y), float(margins[x, y])))
            ranked[(s.first < s.first[x] + s.size[x]) & (s.first[x] < s.first + s.size)] = -np.inf
            ranked[:, (t.first < t.first[y] + t.size[y]) & (t.first[y] < t.first + t.size)] = -np.inf


def _bags(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    """Bags of whole passages while the model has no vectors, then of the lines that it pairs."""
    kind = pa.list_(pa.int32())
    for b in batches:
        bags: tuple[list, list] = ([], [])
        for text, target, pair in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
            base = model.base(pair)
            sides = [(text, target)]
            if model.vectors is not None:
                lines, others = text.split("\n"), target.split("\n")
                sides = [(" ".join(lines[k - 1] for k in own), " ".join(others[k - 1] for k in other)) for own, other, _ in match(text, target, pair, model)]
            for pair_of in sides:
                for bag, words in zip(bags, pair_of, strict=True):
                    bag.append([base + i for i in terms(words)[0]])
        yield pa.RecordBatch.from_arrays([pa.array(side, kind) for side in bags], names=["source", "target"])


def learn(passages: DataFrame, pairs: dict[int, int], dimensions: int = DIMENSIONS, rounds: int = ROUNDS) -> Model:
    """The model of all ``passages`` (text, target, pair): first of passages, then of the lines that pair up by it."""
    context, model = passages.sparkSession.sparkContext, Model(pairs)
    for _ in range(2):
        shared = context.broadcast(model)
        bags = checkpoint(passages.mapInArrow(lambda b: _bags(b, shared.value), "source array<int>, target array<int>"))  # noqa: B023
        shared.destroy()
        model = fit(bags, pairs, dimensions, rounds)
    return model


def aligned_lines(passages: DataFrame, key: str = "worksheet_id") -> DataFrame:
    """(key, text_line, target_line): pairs of lines that render each other, each once.

    ``passages`` has the key, text and target. Lines are split at ``\\n`` and
    numbered from 1; blank ones pair with nothing, nor do null or empty sides.
    Repeated rows of a key count once. Pairs of languages have models of their own,
    ``PAIRS`` at a time, so neither a task nor the driver holds more than these.
    """
    kind = dict(passages.dtypes)[key]
    known = passages.where("text is not null and target is not null")
    once = known.groupBy(key).agg(F.max(F.struct("text", "target")).alias("p")).select(key, "p.*")

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes = [language(s) * len(LANGUAGES) + language(t) for s, t in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(codes, pa.int32())], names=[key, "text", "target", "pair"])

    # matching takes more time than reading: spread even small tables over all cores
    once = checkpoint(once.repartition(spread(passages)).mapInArrow(told, f"{key} {kind}, text string, target string, pair int"))
    seen = sorted(row.pair for row in once.select("pair").distinct().collect())  # at most the square of LANGUAGES
    schema = f"{key} {kind}, text_line int, target_line int"
    out = once.sparkSession.createDataFrame([], schema)
    for low in range(0, len(seen), PAIRS):
        held = {pair: k for k, pair in enumerate(seen[low : low + PAIRS])}
        mine = once if len(held) == len(seen) else once.where(F.col("pair").isin(list(held)))
        model = once.sparkSession.sparkContext.broadcast(learn(mine.select("text", "target", "pair"), held))
        out = out.unionByName(mine.mapInArrow(_pairing(key, model), schema))
    return out


def _pairing(key: str, model: Broadcast) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for of, text, target, languages in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                rows += [(of, i, j) for own, other, _ in match(text, target, languages, model.value) for i in own for j in other]
            keys, own, other = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(keys, b.schema.field(0).type), pa.array(own, pa.int32()), pa.array(other, pa.int32())], names=[key, "text_line", "target_line"])

    return pair
