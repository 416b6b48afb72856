"""Spans of at least a given length that stand verbatim in more than one record.

Of every text some windows are kept so that any two equal spans of ``least``
characters keep a window in common (winnowing: of each run of neighbouring
windows the one with the least hash). First each partition counts its windows in
a count-min sketch; the merged sketch never counts too little, so a window it
counts once is nowhere else. A second pass groups the others exactly; on each shift
of two records with equal windows the texts are compared as a whole.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.session import checkpoint

#: Characters of a span, and of a window; both are counted in code points.
LEAST, WINDOW = 200, 100
#: Rows of a sketch, and the least and greatest power of two of cells in a row.
DEPTH, MIN_BITS, MAX_BITS = 3, 18, 24

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_MIX = [np.uint64(x) for x in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0x9FB21C651E98DF25, 0xD6E8FEB86659FD93)]
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


@lru_cache(4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(int(_BASE), -1, 1 << 64)
    up, down = np.full(n, _BASE, np.uint64), np.full(n, np.uint64(inverse), np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def _sliding(values: np.ndarray, width: int, ufunc: np.ufunc, fill: np.uint64) -> np.ndarray:
    """The extreme of each ``width`` neighbours, by the place of the first of them."""
    n = len(values)
    padded = np.full(-(-(n + width) // width) * width, fill, np.uint64)
    padded[:n] = values
    blocks = padded.reshape(-1, width)
    ahead = ufunc.accumulate(blocks, axis=1).ravel()
    behind = ufunc.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return ufunc(behind[:n], ahead[width - 1 : width - 1 + n])


def kept_windows(texts: list[str], least: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, place, hash) of the windows kept of texts with ``least`` characters or more."""
    lengths = np.array([len(t) for t in texts], np.int64)
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    n, run = len(codes), least - window + 1
    if not n:
        return (np.empty(0, np.int64),) * 2 + (np.empty(0, np.uint64),)
    size = 1 << (n + 1).bit_length()
    up, down = _powers(size)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((codes + np.uint64(1)) * up[:n], dtype=np.uint64)])
    ends = np.cumsum(lengths)
    starts = ends - lengths
    hashes = np.full(n, _NONE, np.uint64)
    count = max(0, n - window + 1)
    hashes[:count] = (sums[window : window + count] - sums[:count]) * down[:count]
    hashes ^= hashes >> np.uint64(33)
    hashes *= _MIX[0]
    hashes ^= hashes >> np.uint64(29)
    of = np.repeat(np.arange(len(texts)), lengths)
    place = np.arange(n) - starts[of]
    last = lengths[of]
    hashes[place > last - window] = _NONE
    lows = _sliding(hashes, run, np.minimum, _NONE)
    lows[place > last - least] = 0  # no whole run of windows starts here
    behind = np.zeros(n + run - 1, np.uint64)
    behind[run - 1 :] = lows
    best = _sliding(behind, run, np.maximum, np.uint64(0))[:n]
    kept = np.flatnonzero((best == hashes) & (hashes != _NONE))
    return of[kept], place[kept], hashes[kept]


def _cells(hashes: np.ndarray, row: int, bits: int) -> np.ndarray:
    return (((hashes ^ (hashes >> np.uint64(31))) * _MIX[row + 1]) >> np.uint64(64 - bits)).astype(np.int64)


def _sketch(batches: Iterator[pa.RecordBatch], least: int, window: int, bits: int) -> Iterator[pa.RecordBatch]:
    rows = np.zeros((DEPTH, 1 << bits), np.uint8)
    seen = False
    for batch in batches:
        _, _, hashes = kept_windows(batch.column(2).to_pylist(), least, window)
        seen = seen or len(hashes) > 0
        for k in range(DEPTH):
            cells, n = np.unique(_cells(hashes, k, bits), return_counts=True)
            rows[k, cells] = np.minimum(2, rows[k, cells] + np.minimum(2, n))
    if seen:
        packed = [zlib.compress(rows[k].tobytes(), 1) for k in range(DEPTH)]
        yield pa.RecordBatch.from_arrays([pa.array(range(DEPTH), pa.int32()), pa.array(packed, pa.binary())], names=["row", "counts"])


def _merge(batches: Iterator[pa.RecordBatch], bits: int, last: bool = False) -> Iterator[pa.RecordBatch]:
    """Sums of counts by row; in the ``last`` step only whether a cell counts more than one window, as bits."""
    merged: dict[int, np.ndarray] = {}
    for batch in batches:
        for row, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            counts = np.frombuffer(zlib.decompress(packed), np.uint8)
            merged[row] = np.minimum(2, merged.get(row, np.zeros(1 << bits, np.uint8)) + counts)
    for row, counts in merged.items():
        data = np.packbits(counts > 1) if last else counts
        yield pa.RecordBatch.from_arrays([pa.array([row], pa.int32()), pa.array([zlib.compress(data.tobytes(), 1)], pa.binary())], names=["row", "counts"])


def merged_sketch(texts: DataFrame, least: int, window: int, bits: int) -> list[np.ndarray]:
    """For each row of the sketch the cells that counted more than one window, as bits.

    Merged in two steps (by row and a share of the partitions, then by row), so no
    task holds more than one sketch; ``DEPTH`` * 2**bits / 8 bytes reach the driver.
    """
    schema = "row int, counts binary"
    parts = texts.mapInArrow(lambda b: _sketch(b, least, window, bits), schema)
    step = parts.repartition(F.col("row"), F.spark_partition_id() % 8).mapInArrow(lambda b: _merge(b, bits), schema)
    final = step.repartition("row").mapInArrow(lambda b: _merge(b, bits, True), schema)
    sketch = [np.zeros(1 << bits >> 3, np.uint8) for _ in range(DEPTH)]
    for row in final.collect():
        sketch[row["row"]] |= np.frombuffer(zlib.decompress(row["counts"]), np.uint8)
    return sketch


def _period(window: str) -> int:
    """The least period of a window, at most its length."""
    return next((p for p in range(1, len(window)) if window.startswith(window[p:])), len(window))


def _runs(texts: list[str], of: np.ndarray, place: np.ndarray, hashes: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """(text number, first, last, step, hash) of the places of equal windows in a text.

    Places at most half a window apart lie in a periodic stretch, so they are
    multiples of the window's period apart and become one row; others have step 0.
    """
    order = np.lexsort((place, hashes, of))
    of, place, hashes = of[order], place[order], hashes[order]
    near = np.zeros(len(of), bool)
    near[1:] = (of[1:] == of[:-1]) & (hashes[1:] == hashes[:-1]) & (np.diff(place) <= window // 2)
    first = np.flatnonzero(~near)
    last = np.append(first[1:], len(of))[: len(first)] - 1
    step = np.zeros(len(first), np.int64)
    for k in np.flatnonzero(last > first):
        at = place[first[k]]
        step[k] = _period(texts[of[first[k]]][at : at + window])
    return of[first], place[first], place[last], step, hashes[first]


def _repeated(batches: Iterator[pa.RecordBatch], least: int, window: int, bits: int, shared: Broadcast) -> Iterator[pa.RecordBatch]:
    sketch = shared.value
    for batch in batches:
        texts = batch.column(2).to_pylist()
        of, place, hashes = kept_windows(texts, least, window)
        keep = np.ones(len(hashes), bool)
        for k in range(DEPTH):
            cells = _cells(hashes, k, bits)
            keep &= (sketch[k][cells >> 3] >> (7 - (cells & 7)).astype(np.uint8) & 1).astype(bool)
        of, first, last, step, hashes = _runs(texts, of[keep], place[keep], hashes[keep], window)
        of = pa.array(of)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(of), batch.column(1).take(of), *(pa.array(x.astype(np.int32)) for x in (first, last, step)), pa.array(hashes.view(np.int64))],
            names=["key", "field", "first", "last", "step", "hash"],
        )


def _spans(batches: Iterator[pd.DataFrame], least: int) -> Iterator[pd.DataFrame]:
    """Every longest equal span of two texts on each of the shifts at which they have a window in common."""
    for pairs in batches:
        out = []
        for row in pairs.itertuples(index=False):
            a = np.frombuffer(row.text_a.encode("utf-32-le", "surrogatepass"), np.uint32)
            b = np.frombuffer(row.text_b.encode("utf-32-le", "surrogatepass"), np.uint32)
            for shift in row.shifts:
                at_a, at_b = int(max(shift, 0)), int(max(-shift, 0))
                n = min(len(a) - at_a, len(b) - at_b)
                if n < least:
                    continue
                off = np.concatenate([[-1], np.flatnonzero(a[at_a : at_a + n] != b[at_b : at_b + n]), [n]])
                lengths = np.diff(off) - 1
                for k in np.flatnonzero(lengths >= least):
                    left = int(off[k]) + 1
                    out.append((row.a, row.field_a, at_a + left, row.b, row.field_b, at_b + left, int(lengths[k])))
        yield pd.DataFrame(out, columns=["a", "field_a", "start_a", "b", "field_b", "start_b", "length"])


def field_texts(rows: DataFrame, key: str, fields: list[str], least: int = LEAST) -> DataFrame:
    """(key, field, text) of every field of at least ``least`` characters; repeated rows may recur."""
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in fields]))
    return rows.select(F.col(key).alias("key"), each.alias("f")).select("key", "f.*").where(F.length("text") >= least)


def shared_spans(rows: DataFrame, key: str, fields: list[str], least: int = LEAST, window: int = WINDOW) -> DataFrame:
    """(a, field_a, start_a, b, field_b, start_b, length), a < b: every longest equal span of two records.

    A span is counted in code points and lies within one field of each record.
    Null, empty and shorter fields have none; repeated rows of a key count once;
    a text that repeats itself inside a record makes no pair. Where many records
    hold one span, all their pairs are rows, as the result is defined by pairs;
    the join's skew handling splits such spans.
    """
    spark = rows.sparkSession
    texts = field_texts(rows, key, fields, least)
    total = texts.agg(F.sum(F.length("text"))).first()[0] or 0
    windows = 2 * total // (least - window + 2)
    bits = min(MAX_BITS, max(MIN_BITS, int(4 * windows).bit_length()))
    sketch = spark.sparkContext.broadcast(merged_sketch(texts, least, window, bits))
    kind = dict(rows.dtypes)[key]
    found = texts.mapInArrow(lambda b: _repeated(b, least, window, bits, sketch), f"key {kind}, field string, first int, last int, step int, hash long")
    found = checkpoint(found.distinct())
    repeated = found.groupBy("hash").agg((F.min("key") != F.max("key")).alias("more")).where("more").select("hash")
    places = checkpoint(found.join(repeated, "hash"))
    x, y = places.alias("x"), places.alias("y")
    pairs = x.join(y, (F.col("x.hash") == F.col("y.hash")) & (F.col("x.key") < F.col("y.key")))
    # all shifts of two rows of places; the same window has the same period in both
    shifts = F.sequence(F.col("x.first") - F.col("y.last"), F.col("x.last") - F.col("y.first"), F.greatest(F.lit(1), "x.step", "y.step"))
    pairs = pairs.select(F.col("x.key").alias("a"), F.col("x.field").alias("field_a"), F.col("y.key").alias("b"), F.col("y.field").alias("field_b"), F.explode(shifts).alias("shift"))
    pairs = checkpoint(pairs.groupBy("a", "field_a", "b", "field_b").agg(F.collect_set("shift").alias("shifts")))
    involved = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("key"), F.col("field_a").alias("field")), F.struct(F.col("b").alias("key"), F.col("field_b").alias("field")))).alias("i"))
    involved = involved.select("i.*").distinct()
    needed = checkpoint(texts.join(involved, ["key", "field"], "left_semi").groupBy("key", "field").agg(F.max("text").alias("text")))
    side = lambda s: needed.select(F.col("key").alias(s), F.col("field").alias(f"field_{s}"), F.col("text").alias(f"text_{s}"))
    both = pairs.join(side("a"), ["a", "field_a"]).join(side("b"), ["b", "field_b"])
    schema = f"a {kind}, field_a string, start_a int, b {kind}, field_b string, start_b int, length int"
    return both.select("a", "field_a", "b", "field_b", "shifts", "text_a", "text_b").mapInPandas(lambda b: _spans(b, least), schema).distinct()


def _covered(spans: Column) -> Column:
    """Characters covered by sorted (start, end) spans."""
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("sum"))
    step = lambda acc, s: F.struct(
        F.greatest(acc["end"], s["end"]).alias("end"), (acc["sum"] + F.greatest(F.lit(0), s["end"] - F.greatest(acc["end"], s["start"]))).alias("sum")
    )
    return F.aggregate(spans, zero, step, lambda acc: acc["sum"])


def shared_shares(rows: DataFrame, key: str, fields: list[str], least: int = LEAST) -> DataFrame:
    """(key, n_chars, n_shared, share): of every record how much of its fields stands elsewhere.

    A record without any text has no characters and the share 0.
    """
    spans = shared_spans(rows, key, fields, least)
    ends = F.explode(F.array(*[F.struct(F.col(s).alias("key"), F.col(f"field_{s}").alias("field"), F.col(f"start_{s}").alias("start"), (F.col(f"start_{s}") + F.col("length")).alias("end")) for s in "ab"]))
    merged = spans.select(ends.alias("e")).select("e.*").groupBy("key", "field").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("spans"))
    covered = merged.select("key", _covered(F.col("spans")).alias("n")).groupBy("key").agg(F.sum("n").cast("int").alias("n_shared"))
    sizes = rows.groupBy(F.col(key).alias("key")).agg(F.max(sum((F.coalesce(F.length(f), F.lit(0)) for f in fields), F.lit(0))).alias("n_chars"))
    joined = sizes.join(covered, "key", "left")
    n = F.coalesce("n_shared", F.lit(0))
    return joined.select("key", "n_chars", n.alias("n_shared"), F.when(F.col("n_chars") > 0, n / F.col("n_chars")).otherwise(0.0).alias("share"))
