"""Benchmark decontamination: BM25 with block-max WAND, then verified overlap.

Test items are indexed; every training passage is a query. Items fall into length classes (powers of
two); a class is searched with overlapping windows of twice its length, one length apart, so that every
stretch of text as long as an item lies whole in some window. Scores are divided by the item's score
against itself, hence one threshold serves all items, and all items at or above it are retrieved:

* postings of a term are sorted by item and cut into blocks that know their largest impact;
* windows whose sum of upper bounds stays below the threshold in every range of items are left out at once, first by ranges of 8 items
  and all windows of a text together, then by ranges of 2 items and the window's distinct terms;
* else, in the ranges that are left, the cursors move as in WAND: the pivot is the first item at which the bounds reach the threshold,
  the block maxima at the pivot are checked before scoring, and a failed check skips to the end of the
  shallowest block.

A retrieved pair counts when the window holds at least ``overlap`` of the item's question n-grams and of
its answer n-grams (the answer: the last quarter of the words; n is a third of the part's words, 1 to 5, so that
one changed word leaves half of the n-grams of any part).

Items are sent to the tasks in shards of at most SHARD_WORDS words, one pass over the documents for each,
so nothing unbounded is broadcast; document frequencies are counted over all items beforehand. Null and
empty texts have no passages; items without words match nothing; an item_id with several texts is found by any of
them; repeated rows are each searched, and ``contaminated`` returns a pair once; further columns are ignored
by it and kept by ``drop_contaminated``.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.shared import stash
from .text import ascii_lower, words

K1, B = 1.2, 0.75
BLOCK = 32
#: Words of items in one shard of the index.
SHARD_WORDS = 2_000_000
LEAST_CLASS = 16
#: Most cells of a table of bounds by term and range of items; least items in a range of the coarse and the fine table; what sums of bounds may lose by rounding.
RANGE_CELLS, COARSE, FINE, ROUNDING = 4_000_000, 3, 2, 1e-5
SIGNS = b".,;:!?\"'()[]{}<>|*#$%&"
NGRAM = 5


def edges(ws: list[bytes]) -> list[bytes]:
    """Words without signs at their edges."""
    return [w.strip(SIGNS) or w for w in ws]


def grams(ws: list[bytes], n: int) -> list[bytes]:
    return [b" ".join(ws[i : i + n]) for i in range(len(ws) - n + 1)]


class Item:
    def __init__(self, item_id: int, ws: list[bytes]):
        self.item_id, self.words = item_id, ws
        cut = max(1, len(ws) - max(1, len(ws) // 4)) if len(ws) > 1 else len(ws)
        self.question, self.answer = ws[:cut], ws[cut:]

    def overlaps(self, window: list[bytes]) -> tuple[float, float]:
        """Shares of the question's and the answer's n-grams in the window; an item of one word has no answer and 1.0."""
        out = []
        for part in (self.question, self.answer):
            n = max(1, min(NGRAM, len(part) // 3)) if part else 0
            own = grams(part, n) if n else []
            held = set(grams(window, n)) if own else ()
            out.append(sum(g in held for g in own) / len(own) if own else 1.0)
        return out[0], out[1]


class Index:
    """Postings of one length class, impacts divided by each item's score against itself."""

    def __init__(self, items: list[Item], df: dict[bytes, int], n_items: int, mean_words: float):
        self.items = sorted(items, key=lambda x: x.item_id)
        self.postings: dict[bytes, tuple[list[int], list[float], list[float], float]] = {}
        found: defaultdict[bytes, list[tuple[int, float]]] = defaultdict(list)
        for number, item in enumerate(self.items):
            norm = K1 * (1 - B + B * len(item.words) / mean_words)
            impact = {t: math.log(1 + (n_items - df[t] + 0.5) / (df[t] + 0.5)) * n * (K1 + 1) / (n + norm) for t, n in Counter(item.words).items()}
            total = sum(impact.values())
            for t, x in impact.items():
                found[t].append((number, x / total))
        for t, own in found.items():
            numbers, impacts = [x for x, _ in own], [x for _, x in own]
            peaks = [max(impacts[i : i + BLOCK]) for i in range(0, len(impacts), BLOCK)]
            self.postings[t] = numbers, impacts, peaks, max(peaks)
        self.bound = {t: p[3] for t, p in self.postings.items()}

    def range_bounds(self, terms: list[bytes], least: int) -> np.ndarray:
        """Largest impact of each term in each range of items; as many ranges as RANGE_CELLS allows, ``least`` items or more in each."""
        ranges = max(1, min(math.ceil(len(self.items) / least), RANGE_CELLS // max(1, len(terms))))
        out = np.zeros((len(terms), ranges), np.float32)
        for row, t in enumerate(terms):
            for number, impact in zip(*self.postings[t][:2]) if t in self.postings else ():
                at = number * ranges // len(self.items)
                out[row, at] = max(out[row, at], impact)
        return out

    def range(self, r: int, ranges: int) -> tuple[int, int]:
        """The first item of range r and the first after it."""
        return -(-r * len(self.items) // ranges), -(-(r + 1) * len(self.items) // ranges)

    def search(self, terms: list[bytes], threshold: float, begin: int, end: int) -> list[tuple[int, float]]:
        """(item number, score) of all items from begin up to end that the distinct terms score at or above the threshold."""
        cursors = [[bisect_left(p[0], begin), *p] for p in map(self.postings.__getitem__, terms)]  # place, numbers, impacts, peaks, bound
        cursors = [c for c in cursors if c[0] < len(c[1]) and c[1][c[0]] < end]
        out = []
        while cursors:
            cursors.sort(key=lambda c: c[1][c[0]])
            reach, pivot_at = 0.0, -1
            for i, c in enumerate(cursors):
                reach += c[4]
                if reach >= threshold:
                    pivot_at = i
                    break
            if pivot_at < 0:
                break
            pivot = cursors[pivot_at][1][cursors[pivot_at][0]]
            while pivot_at + 1 < len(cursors) and cursors[pivot_at + 1][1][cursors[pivot_at + 1][0]] == pivot:
                pivot_at += 1
            # block maxima at the pivot, and where the first of these blocks ends
            peak, stop = 0.0, end
            for c in cursors[: pivot_at + 1]:
                at = bisect_left(c[1], pivot, c[0])
                if at < len(c[1]):
                    block = at // BLOCK
                    peak += c[3][block]
                    last = (block + 1) * BLOCK
                    stop = min(stop, c[1][last - 1] + 1 if last <= len(c[1]) else end)
            if peak >= threshold:
                score = 0.0
                for c in cursors[: pivot_at + 1]:
                    at = bisect_left(c[1], pivot, c[0])
                    if at < len(c[1]) and c[1][at] == pivot:
                        score += c[2][at]
                if score >= threshold:
                    out.append((pivot, score))
                target = pivot + 1
            else:
                following = cursors[pivot_at + 1][1][cursors[pivot_at + 1][0]] if pivot_at + 1 < len(cursors) else end
                target = max(pivot + 1, min(stop, following))
            for c in cursors[: pivot_at + 1]:
                c[0] = bisect_left(c[1], target, c[0])
            cursors = [c for c in cursors if c[0] < len(c[1]) and c[1][c[0]] < end]
        return out


class Searcher:
    """Searches texts in the index of one shard. Raw words map to numbers of indexed terms, 0 for all others."""

    def __init__(self, classes: dict[int, Index]):
        self.classes = classes
        self.terms = [b"", *dict.fromkeys(t for index in classes.values() for t in index.bound)]
        coarse = {length: index.range_bounds(self.terms, COARSE) for length, index in classes.items()}
        self.fine = {length: index.range_bounds(self.terms, FINE) for length, index in classes.items()}
        ends = np.cumsum([x.shape[1] for x in coarse.values()]).tolist()
        self.columns = {length: slice(end - x.shape[1], end) for (length, x), end in zip(coarse.items(), ends)}
        self.coarse = np.concatenate(list(coarse.values()), axis=1) if coarse else np.zeros((1, 0), np.float32)
        self.number = {t: i for i, t in enumerate(self.terms)}

    def likely(self, numbers: np.ndarray, threshold: float) -> Iterator[tuple[int, np.ndarray]]:
        """For each length class the places of the windows whose bounds reach the threshold in some coarse range."""
        n, held = len(numbers), np.flatnonzero(numbers)
        if not len(held):
            return
        cell = held // LEAST_CLASS
        starts = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
        widest = max(self.classes) // LEAST_CLASS
        sums = np.zeros(((n // (widest * LEAST_CLASS) + 2) * widest, self.coarse.shape[1]), np.float32)
        sums[cell[starts]] = np.add.reduceat(self.coarse[numbers[held]], starts, axis=0)
        for length in self.classes:
            windows = len(range(0, max(1, n - length), length))
            step = length // LEAST_CLASS
            own = sums[: (windows + 1) * step, self.columns[length]].reshape(windows + 1, step, -1).sum(axis=1)
            yield length, ((own[:-1] + own[1:]).max(axis=1) >= threshold - ROUNDING).nonzero()[0]

    def __call__(self, text: str | None, threshold: float, overlap: float) -> dict[int, tuple[float, float, float]]:
        """item_id -> (score, question overlap, answer overlap) of the verified items of a text, the best window of each."""
        raw = words(text)
        out: dict[int, tuple[float, float, float]] = {}
        known = self.number.get  # a word with a sign at an edge stands for the one without
        numbers = np.array([known(w) or (known(w.strip(SIGNS), 0) if w[-1] in SIGNS or w[0] in SIGNS else 0) for w in raw], np.int64)
        for length, places in self.likely(numbers, threshold):
            index, fine = self.classes[length], self.fine[length]
            for at in (places * length).tolist():
                inside = np.array(list(set(numbers[at : at + 2 * length].tolist())))
                ranges = np.flatnonzero(fine[inside].sum(axis=0) >= threshold - ROUNDING).tolist()
                if not ranges:
                    continue
                window, terms = None, [t for i in inside.tolist() if (t := self.terms[i]) in index.bound]
                for number, score in (x for r in ranges for x in index.search(terms, threshold, *index.range(r, fine.shape[1]))):
                    item = index.items[number]
                    window = window or edges(raw[at : at + 2 * length])
                    q, a = item.overlaps(window)
                    if q >= overlap and a >= overlap and (item.item_id not in out or (score, q, a) > out[item.item_id]):
                        out[item.item_id] = (score, q, a)
        return out


def shards(items: DataFrame) -> Iterator[dict[int, Index]]:
    """The index by length class, one shard after the other."""
    rows = items.where(F.col("item_id").isNotNull()).select("item_id", "text").distinct()
    tokens = F.filter(F.split(ascii_lower(F.coalesce("text", F.lit(""))), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    rows = stash(rows.select("item_id", "text", F.size(tokens).cast("long").alias("n")).where("n > 0"))
    n_items, mean, total = rows.agg(F.count(F.lit(1)), F.avg("n"), F.sum("n")).first()
    if not n_items:
        return

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text in zip(batch.column(0), batch.column(1).to_pylist()):
                own = list(set(edges(words(text))))
                yield pa.RecordBatch.from_arrays([pa.array([key.as_py()] * len(own), pa.int64()), pa.array(own, pa.binary())], ["item_id", "term"])

    of_item = rows.select("item_id", "text").mapInArrow(terms, "item_id bigint, term binary")
    df = stash(of_item.groupBy("term").agg(F.count(F.lit(1)).alias("df")))
    parts = max(1, math.ceil(total / SHARD_WORDS))
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("item_id"), F.lit(parts)))
    for shard in range(parts):
        own = rows.where(F.col("shard") == shard)
        frequency = {bytes(r[0]): r[1] for r in own.select("item_id").join(of_item, "item_id").select("term").distinct().join(df, "term").collect()} if parts > 1 else {bytes(r[0]): r[1] for r in df.collect()}
        classes: defaultdict[int, list[Item]] = defaultdict(list)
        for r in own.select("item_id", "text").collect():
            ws = edges(words(r[1]))
            classes[max(LEAST_CLASS, 1 << (len(ws) - 1).bit_length())].append(Item(r[0], ws))
        yield {length: Index(group, frequency, n_items, mean) for length, group in sorted(classes.items())}


def contaminated(docs: DataFrame, items: DataFrame, threshold: float = 0.5, overlap: float = 0.5) -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap): verified pairs, the best passage of each."""
    spark = docs.sparkSession
    found = None
    for classes in shards(items):
        shipped = spark.sparkContext.broadcast(classes)

        def run(batches: Iterator[pa.RecordBatch], shipped=shipped) -> Iterator[pa.RecordBatch]:
            search = Searcher(shipped.value)
            for batch in batches:
                rows = [(k, i, *x) for k, t in zip(batch.column(0).to_pylist(), batch.column(1)) for i, x in search(t.as_py(), threshold, overlap).items()]
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows), KINDS)] if rows else [pa.array([], kind) for kind in KINDS], NAMES)

        part = docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, item_id bigint, score double, question_overlap double, answer_overlap double")
        found = part if found is None else found.union(part)
    if found is None:
        return spark.createDataFrame([], "doc_id bigint, item_id bigint, score double, question_overlap double, answer_overlap double")
    best = F.max(F.struct("score", "question_overlap", "answer_overlap"))
    return found.groupBy("doc_id", "item_id").agg(best.alias("best")).select("doc_id", "item_id", "best.*")


NAMES = ["doc_id", "item_id", "score", "question_overlap", "answer_overlap"]
KINDS = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()]


def drop_contaminated(docs: DataFrame, items: DataFrame, threshold: float = 0.5, overlap: float = 0.5) -> DataFrame:
    """The rows without a verified item, with all their columns; each task decides on its own rows."""
    at = docs.columns.index("text")
    for classes in shards(items):
        shipped = docs.sparkSession.sparkContext.broadcast(classes)

        def run(batches: Iterator[pa.RecordBatch], shipped=shipped) -> Iterator[pa.RecordBatch]:
            search = Searcher(shipped.value)
            for batch in batches:
                keep = [not search(t.as_py(), threshold, overlap) for t in batch.column(at)]
                yield batch.filter(pa.array(keep, pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
