"""Periodic runs: stretches of words that repeat with a period, by multi-scale minimizers.

A run is a stretch of consecutive words with smallest period q and ``max(LEAST, 2 * q)`` words or more that no
neighbouring word extends with that period. All of a document's runs are found, as follows.

1. Periods below SHORT: direct scans at each lag.
2. Scale P = SHORT, 2 * SHORT, ... has the periods from P to below 2 * P and windows of P / 2 words. Of each
   window the smallest hash of P / 4 words in a row is taken, the leftmost of equal ones. A window in the first
   half of a run has its copy one period on, and so has its minimum: pairs of equal minima at a distance in the
   scale's range are seeds, which are extended on the words themselves. Hashes never decide about a run.
3. Windows inside a run of a period of P / 4 or less, which lower scales have found, have as many equal minima as
   words and are left out. A run of the scale all of whose windows are such is made of two runs of one short
   period that touch; its periods follow from their phases and are seeds too.

Documents are worked on together in one array, with a number of its own between two of them, so that nothing is
equal across. Words are ``[^\\x20\\x09-\\x0D]+`` of the text as it is. Null and empty texts have no words and no runs;
every row is answered, also rows that repeat a doc_id and rows with a null one; an empty table gives no rows;
further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST, SHORT = 12, 32
#: About so many words are worked on together; a longer document alone.
TOGETHER = 200_000
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
Runs = tuple[np.ndarray, np.ndarray, np.ndarray]  # start, end, period
SCHEMA = "doc_id bigint, n_words bigint, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string"


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _M2
    return h ^ (h >> np.uint64(29))


def at_lag(a: np.ndarray, q: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of the stretches of period q with ``max(LEAST, 2 * q)`` words or more."""
    if len(a) <= q:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    other = np.concatenate([[-1], np.flatnonzero(a[q:] != a[:-q]), [len(a) - q]])
    hit = np.flatnonzero(np.diff(other) > max(LEAST, 2 * q) - q)
    return other[hit] + 1, other[hit + 1] + q


def same_from(a: np.ndarray, p: int, q: int) -> int:
    """The end of the stretch of words from p on that are equal to those q further on."""
    step = 64
    while p + q < len(a):
        n = min(step, len(a) - p - q)
        other = np.flatnonzero(a[p : p + n] != a[p + q : p + q + n])
        if len(other):
            return p + int(other[0])
        p, step = p + n, 2 * step
    return p


def same_to(a: np.ndarray, p: int, q: int) -> int:
    """The start of the stretch of words up to p that are equal to those q further on."""
    step = 64
    while p > 0:
        n = min(step, p)
        other = np.flatnonzero(a[p - n : p] != a[p - n + q : p + q])
        if len(other):
            return p - n + int(other[-1]) + 1
        p, step = p - n, 2 * step
    return 0


def window_minima(h: np.ndarray, width: int) -> np.ndarray:
    """The place of the smallest of the ``width`` (a power of two, plus one) hashes from each place on, the leftmost of equal ones."""
    value, place, have = h, np.arange(len(h)), 1
    while have < width:
        step = min(have, width - have)
        right = value[step:] < value[: len(value) - step]
        value, place = np.where(right, value[step:], value[: len(value) - step]), np.where(right, place[step:], place[: len(place) - step])
        have += step
    return place


def equal_pairs(h: np.ndarray, places: np.ndarray, doc: np.ndarray, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, distance) of the pairs of equal hashes in a document from ``scale`` to below 2 * ``scale`` apart."""
    order = np.lexsort((places, h[places]))
    p, v = places[order], h[places][order]
    i, found = np.arange(len(p)), [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for step in range(1, len(p)):
        i = i[i + step < len(p)]
        apart = p[i + step] - p[i]
        near = (v[i + step] == v[i]) & (apart < 2 * scale) & (doc[p[i + step]] == doc[p[i]])
        i, apart = i[near], apart[near]
        if not len(i):
            break
        far = apart >= scale
        found.append((p[i[far]], apart[far]))
    return tuple(np.concatenate(x) for x in zip(*found))


def touching(a: np.ndarray, known: Runs, scale: int) -> list[tuple[int, int]]:
    """(place, period) of the seeds of the scale where two runs of one short period touch."""
    start, end, period = known
    use = np.flatnonzero((4 * period <= scale) & (end - start >= scale))
    use = use[np.lexsort((start[use], period[use]))]
    seeds = []
    for x, y in zip(use[:-1], use[1:]):
        d, seam = int(period[x]), int(end[x])
        if period[y] != d or start[y] > seam:
            continue
        most = min(2 * scale - 1, seam - int(start[x]), int(end[y] - start[y]))
        for q in range(scale, min(scale + d - 1, most) + 1):
            if np.array_equal(a[seam : seam + d], a[seam - q : seam - q + d]):
                seeds += [(seam - k, k) for k in range(q, most + 1, d)]
    return seeds


def runs_of(a: np.ndarray, doc: np.ndarray, longest: int) -> Runs:
    """All runs of the array of word numbers; ``doc`` has each place's document, of ``longest`` words at most."""
    found: dict[tuple[int, int], int] = {}  # a stretch that a shorter period has too is that period's
    for q in range(1, min(SHORT, longest // 2 + 1)):
        for s, e in zip(*(x.tolist() for x in at_lag(a, q))):
            found.setdefault((s, e), q)
    with np.errstate(over="ignore"):
        h, gram, scale = mixed(a.astype(np.uint64) * _M1 + _M2), 1, SHORT
        while 2 * scale <= longest:
            while 4 * gram < scale:
                h, gram = mixed(h[: len(h) - gram] * _M1 + h[gram:]), 2 * gram
            known = tuple(np.array(x, np.int64) for x in (*zip(*found), list(found.values()))) if found else (np.zeros(0, np.int64),) * 3
            places = window_minima(h, gram + 1)
            inside = np.zeros(len(places) + 1, np.int64)
            short = (known[2] <= gram) & (known[1] - known[0] >= 2 * gram)
            np.add.at(inside, known[0][short], 1)
            np.add.at(inside, known[1][short] - 2 * gram + 1, -1)
            places = np.unique(places[np.cumsum(inside[:-1]) == 0])
            p, q = equal_pairs(h, places, doc, scale)
            # a run goes on by more than a gram to the left or right of its seed
            right, left = np.minimum(p + gram, len(h) - 1), np.maximum(p - gram, 0)
            keep = (h[right] == h[np.minimum(right + q, len(h) - 1)]) | (h[left] == h[np.minimum(left + q, len(h) - 1)])
            seeds = sorted({*zip(q[keep].tolist(), p[keep].tolist()), *((d, at) for at, d in touching(a, known, scale))})
            lag, until = 0, 0
            for d, at in seeds:
                if d == lag and at < until:
                    continue
                s, until, lag = same_to(a, at, d), same_from(a, at, d), d
                if until + d - s >= max(LEAST, 2 * d):
                    found.setdefault((s, until + d), d)
            scale *= 2
    if not found:
        return (np.zeros(0, np.int64),) * 3
    start, end, period = (np.array(x, np.int64) for x in (*zip(*found), list(found.values())))
    order = np.lexsort((period, start))
    return start[order], end[order], period[order]


def together(texts: list[str | None]) -> Iterator[list[list[bytes]]]:
    """The words of the texts, some documents at a time."""
    held, size = [], 0
    for text in texts:
        held.append(text.encode("utf-8", "surrogatepass").split() if text else [])
        size += len(held[-1])
        if size >= TOGETHER:
            yield held
            held, size = [], 0
    if held:
        yield held


def searched(docs: list[list[bytes]]) -> Iterator[tuple[int, list[tuple[int, int, int]], bytes]]:
    """(words, runs, collapsed text) of each document."""
    numbers: dict[bytes, int] = {}
    sizes = np.array([len(d) for d in docs], np.int64)
    begins = np.cumsum(sizes + 1) - sizes - 1
    a = np.empty(int(sizes.sum()) + len(docs), np.int64)
    for k, (d, at) in enumerate(zip(docs, begins.tolist())):
        a[at : at + len(d)] = [numbers.setdefault(w, len(numbers)) for w in d]
        a[at + len(d)] = -1 - k
    start, end, period = runs_of(a, np.repeat(np.arange(len(docs)), sizes + 1), int(sizes.max(initial=0)))
    again = np.zeros(len(a) + 1, np.int64)
    np.add.at(again, start + period, 1)
    np.add.at(again, end, -1)
    keep = np.cumsum(again) == 0
    cuts = np.searchsorted(start, begins).tolist() + [len(start)]
    for k, (d, at) in enumerate(zip(docs, begins.tolist())):
        i, j = cuts[k], cuts[k + 1]
        own = zip((start[i:j] - at).tolist(), (end[i:j] - start[i:j]).tolist(), period[i:j].tolist())
        yield len(d), list(own), b" ".join(d if i == j else [d[x] for x in np.flatnonzero(keep[at : at + len(d)]).tolist()])


def found_in(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
    for batch in batches:
        at = 0
        for some in together(batch.column(1).to_pylist()):
            n, runs, texts = zip(*searched(some))
            runs = [[dict(zip(("start", "length", "period"), r)) for r in x] for x in runs]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(some)), pa.array(n, pa.int64()), pa.array(runs, kind), pa.array(texts, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "runs", "collapsed"])
            at += len(some)


def find_runs(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, runs (start, length, period, by start and period), collapsed: the words that no run repeats, joined by one space."""
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(found_in, SCHEMA)


def word_array(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """doc_id and text of the documents; one in ten, by the checksum of its number, repeats its words with a period from some word on."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)
    rows = docs.select("doc_id", "text", g.alias("g"), word_array(F.col("text")).alias("ws"), (F.coalesce(h % 10, F.lit(1)) == 0).alias("marked"))
    rows = rows.withColumn("n", F.size("ws").cast("long")).withColumn("marked", F.col("marked") & (F.col("n") > 0))
    rows = rows.withColumn("a", F.when(F.col("marked"), F.expr("g % n"))).withColumn("p", F.when(F.col("marked"), 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))))
    again = F.expr("array_join(transform(sequence(0L, n - 1), i -> ws[CAST(IF(i < a, i, a + (i - a) % p) AS INT)]), ' ')")
    return rows.select("doc_id", F.when(F.col("marked"), again).otherwise(F.col("text")).alias("text"))
