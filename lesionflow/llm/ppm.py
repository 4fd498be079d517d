"""Language-model scores by prediction by partial matching (PPM) over byte contexts of whole texts.

A text is its words (A-Z lower-cased, ``[^\\x20\\x09-\\x0D]+``) joined by single spaces, and one END byte, which no
word can hold; ORDER END bytes stand before it. Every byte, spaces and the END included, is predicted from
the ORDER bytes before it, across word borders. The trie of contexts gives each longest context the counts of the
bytes that followed it in all training texts; a shorter context counts a byte once for each context, one byte
longer, that it followed (update exclusion). Coding goes from the longest context to the empty one: of total
count M, a byte of count c has probability (2 c - 1) / 2 M and the escape has kinds / 2 M (method D); after an escape
the bytes of the context that was left are excluded below. Under the empty context all bytes that never
occurred are alike. ``score`` is the text's log10 probability: the sum over its bytes.

A byte's code length depends on its window of ORDER + 1 bytes alone. Hence Spark scores distinct windows:

1. ``deal`` cuts every task's documents into blocks of BLOCK_BYTES and puts out, with the documents, each block's
   distinct windows and words with their training counts, packed by bucket (windows by the three bytes next to
   the symbol, so that all contexts of three bytes and more are whole in one bucket; words by checksum).
2. Buckets are added up over all blocks: word counts, and the windows of the trie. Contexts of two bytes and fewer
   (2^24 cells at most) are summed over all buckets and go to all tasks.
3. Every bucket gives its windows their code lengths and answers each block once; blocks meet their answers
   and their documents in one shuffle.

Null and empty texts hold the END only; a null doc_id trains; repeated rows are scored (and trained on)
each; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.shared import stash
from .text import words

ORDER = 5
#: Bytes of a context whose counts all tasks hold.
LOW = 2
END = b"\n"
#: Bytes of text in a block, in one step of a block, and for each bucket.
BLOCK_BYTES, STEP_BYTES, BUCKET_BYTES = 32_000_000, 1_000_000, 400_000_000
#: Kinds of rows: a block's documents come after what was found for it.
TEXT, WORDS, WINDOWS = 2, 0, 1
DEALT = "kind int, tag bigint, bucket int, doc_id bigint, text string, packed binary, counts binary"
SYMBOL = np.uint64(255)


def is_held_out(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 10 == 0


def windows(bodies: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The windows of all bytes of the texts, and where each text's begin. Of a window's six bytes the most significant one is the byte
    before the symbol, then the one before that; the symbol is the least significant."""
    gap = END * ORDER
    a = np.frombuffer(gap + gap.join(b + END for b in bodies), np.uint8).astype(np.uint64)
    n = len(a) - ORDER
    key = a[ORDER:].copy()
    for i in range(ORDER):
        key |= a[i : i + n] << np.uint64(8 * (i + 1))
    lengths = np.array([len(b) + 1 for b in bodies])
    starts = np.cumsum(lengths + ORDER) - lengths - ORDER
    keep = np.ones(n, bool)
    for i in range(1, ORDER + 1):
        keep[starts[1:] - i] = False
    return key[keep], np.cumsum(lengths) - lengths


def added(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys with their sums."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def packed(keys: np.ndarray) -> bytes:
    """Six bytes of each key, byte by byte of all keys: sorted keys make long runs."""
    return keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : ORDER + 1].T.tobytes()


def unpacked(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // (ORDER + 1), 8), np.uint8)
    out[:, : ORDER + 1] = np.frombuffer(data, np.uint8).reshape(ORDER + 1, -1).T
    return out.view("<u8").ravel()


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    mixed = (keys >> np.uint64(24)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)
    return (mixed % np.uint64(buckets)).astype(np.int64)


class Block:
    """What the documents of a block hold."""

    def __init__(self) -> None:
        self.trained: Counter = Counter()
        self.other: set[bytes] = set()
        self.found: list[tuple[np.ndarray, np.ndarray]] = []
        self.waiting: tuple[list[bytes], list[bytes]] = [], []
        self.held = self.size = 0

    def add(self, ws: list[bytes], held_out: bool) -> None:
        body = b" ".join(ws)
        if held_out:
            self.other.update(ws)
        else:
            self.trained.update(ws)
        self.waiting[held_out].append(body)
        self.held += len(body) + ORDER + 1
        self.size += len(body) + ORDER + 1
        if self.held >= STEP_BYTES:
            self.count()

    def count(self) -> None:
        for held_out, bodies in enumerate(self.waiting):
            if bodies:
                keys, n = np.unique(windows(bodies)[0], return_counts=True)
                self.found.append((keys, n * (1 - held_out)))
                bodies.clear()
        self.held = 0
        if len(self.found) > 12:
            self.found = [self.whole()]

    def whole(self) -> tuple[np.ndarray, np.ndarray]:
        return added(np.concatenate([k for k, _ in self.found]), np.concatenate([n for _, n in self.found]))

    def rows(self, buckets: int) -> Iterator[tuple[int, int, bytes, bytes]]:
        """(kind, bucket, packed, counts)."""
        self.count()
        dealt: defaultdict[int, list[bytes]] = defaultdict(list)
        for w in self.trained:
            dealt[zlib.crc32(w) % buckets].append(w)
        for w in self.other.difference(self.trained):
            dealt[zlib.crc32(w) % buckets].append(w)
        for bucket, ws in dealt.items():
            yield WORDS, bucket, b" ".join(ws), np.fromiter(map(self.trained.__getitem__, ws), "<u4", len(ws)).tobytes()
        if not self.found:
            return
        keys, n = self.whole()
        at = bucket_of(keys, buckets)
        order = np.argsort(at, kind="stable")
        at, keys, n = at[order], keys[order], n[order]
        cuts = np.r_[0, np.flatnonzero(np.diff(at)) + 1, len(at)]
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            yield WINDOWS, int(at[a]), packed(keys[a:b]), n[a:b].astype("<u4").tobytes()


def deal(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kinds = ["kind", "tag", "bucket", "doc_id", "text", "packed", "counts"], [pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.binary(), pa.binary()]
        tag, block = TaskContext.get().partitionId() << 24, Block()

        def found() -> Iterator[pa.RecordBatch]:
            rows = []
            for kind, bucket, data, counts in block.rows(buckets):
                rows.append((kind, tag, bucket, None, None, data, counts))
                if len(rows) == 64:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

        def texts(part: pa.RecordBatch) -> pa.RecordBatch:
            n = part.num_rows
            return pa.RecordBatch.from_arrays([pa.array([TEXT] * n, kinds[0]), pa.array([tag] * n, kinds[1]), pa.nulls(n, kinds[2]), part.column(0), part.column(1), pa.nulls(n, kinds[5]), pa.nulls(n, kinds[6])], names)

        for batch in batches:
            start = 0
            for i, (key, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1))):
                block.add(words(text.as_py()), is_held_out(key))
                if block.size >= BLOCK_BYTES:
                    yield texts(batch.slice(start, i + 1 - start))
                    yield from found()
                    start, tag, block = i + 1, tag + 1, Block()
            if start < batch.num_rows:
                yield texts(batch.slice(start))
        yield from found()

    return run


def by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Iterator[tuple]]]:
    """Of rows sorted by their first column: each bucket with an iterator over its rows."""
    from itertools import groupby

    rows = (r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns)))
    return groupby(rows, key=lambda r: r[0])


def word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(tag, packed, counts) with the counts over all blocks, and a row without tag for each bucket: (sum, kinds) of its words."""

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64()))], ["tag", "packed", "counts", "total", "kinds"])

    for _, rows in by_bucket(batches):
        own = [r[1:] for r in rows]
        total: dict[bytes, int] = {}
        for _, data, counts in own:
            ws, n = data.split(b" "), np.frombuffer(counts, "<u4").tolist()
            for w, m in zip(ws, n):
                total[w] = total.get(w, 0) + m
        yield batch_of([(None, None, None, sum(total.values()), sum(n > 0 for n in total.values()))])
        for tag, data, _ in own:
            ws = data.split(b" ")
            yield batch_of([(tag, data, np.fromiter(map(total.__getitem__, ws), "<i8", len(ws)).tobytes(), None, None)])


def trie(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bucket, packed, counts): all windows of a bucket with their training counts."""
    for bucket, rows in by_bucket(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        for _, _, data, counts in rows:
            held.append((unpacked(data), np.frombuffer(counts, "<u4").astype(np.int64)))
            size += len(held[-1][0])
            if size > 4_000_000:
                held = [added(*(np.concatenate(x) for x in zip(*held)))]
                size = 0
        keys, n = added(*(np.concatenate(x) for x in zip(*held)))
        yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([packed(keys)], pa.binary()), pa.array([n.astype("<i8").tobytes()], pa.binary())], ["bucket", "packed", "counts"])


def shortened(keys: np.ndarray, order: int, of: int) -> np.ndarray:
    """Windows of contexts of ``of`` bytes cut to contexts of ``order`` bytes."""
    return keys >> np.uint64(8 * (of + 1 - order)) << np.uint64(8) | keys & SYMBOL


def low_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(cell, n): contexts of LOW bytes with what follows, counted by the longer contexts of the bucket, which it holds whole."""
    for batch in batches:
        for data, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            keys = unpacked(data)[np.frombuffer(counts, "<i8") > 0]
            longer = np.unique(shortened(keys, LOW + 1, ORDER))
            cells, n = np.unique(shortened(longer, LOW, LOW + 1), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(cells.astype(np.int64)), pa.array(n)], ["cell", "n"])


class Level:
    """Contexts of one length: sorted windows with counts, and for each context the sum, the number of kinds, and ``below``, what the same bytes count in the context that is one byte shorter."""

    def __init__(self, order: int, keys: np.ndarray, counts: np.ndarray, lower: Level | None):
        self.order, self.keys, self.counts = order, keys, counts
        contexts = keys >> np.uint64(8)
        first = np.flatnonzero(np.r_[True, contexts[1:] != contexts[:-1]]) if len(keys) else np.zeros(0, np.int64)
        self.contexts, self.kinds = contexts[first], np.diff(np.r_[first, len(keys)])
        self.total, self.below = np.zeros(0), np.zeros(0)
        if len(keys):
            self.total = np.add.reduceat(counts, first)
            if lower is not None:
                self.below = np.add.reduceat(lower.counts[np.searchsorted(lower.keys, shortened(keys, order - 1, order))], first)

    def at(self, of: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the wanted stand in the sorted ones, and whether they do."""
        if not len(of):
            return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
        at = np.minimum(np.searchsorted(of, wanted), len(of) - 1)
        return at, of[at] == wanted


def levels(keys: np.ndarray, counts: np.ndarray, order: int, lower: Level | None) -> list[Level]:
    """From the given order down to the one above ``lower`` (or to the empty context)."""
    cut = [(keys, counts)]
    for k in range(order - 1, lower.order if lower else -1, -1):
        cut.append(np.unique(shortened(cut[-1][0], k, k + 1), return_counts=True))
    out: list[Level] = []
    for k, (own, n) in zip(range(lower.order + 1 if lower else 0, order + 1), reversed(cut)):
        lower = Level(k, own, n, lower)
        out.append(lower)
    return out[::-1]


def code_lengths(chain: list[Level], wanted: np.ndarray) -> np.ndarray:
    """log10 probability of the symbol of each window, from the longest context to the empty one."""
    out, open_ = np.zeros(len(wanted)), np.ones(len(wanted), bool)
    left_total, left_kinds = np.zeros(len(wanted)), np.zeros(len(wanted))  # what is excluded, counted in the present context
    for level in chain:
        keys = shortened(wanted, level.order, ORDER)
        at, seen = level.at(level.contexts, keys >> np.uint64(8))
        if not seen.any():
            continue
        mass, kinds = np.zeros(len(wanted)), np.zeros(len(wanted))
        mass[seen], kinds[seen] = level.total[at[seen]], level.kinds[at[seen]]
        new = kinds - left_kinds
        live = open_ & seen & (new > 0)
        place, hit = level.at(level.keys, keys)
        hit &= live
        whole = 2 * (mass - left_total)
        out[hit] += np.log10((2 * level.counts[place[hit]] - 1) / whole[hit])
        escaped = live & ~hit
        out[escaped] += np.log10(new[escaped] / whole[escaped])
        open_ &= ~hit
        left_kinds[seen] = kinds[seen]
        if level.order:
            left_total[seen] = level.below[at[seen]]
    out[open_] -= np.log10(256 - left_kinds[open_])
    return out


def answers(low: tuple[np.ndarray, np.ndarray]):
    """Of rows (bucket, tag or null for the trie, packed, counts), the trie's first: (tag, packed, counts), the code lengths of a block's windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lower = levels(*low, LOW, None)
        for _, rows in by_bucket(batches):
            keys, lengths = np.zeros(0, np.uint64), np.zeros(0)
            for _, tag, data, counts in rows:
                own = unpacked(data)
                if tag is None:
                    n, keys = np.frombuffer(counts, "<i8"), own
                    lengths = code_lengths([*levels(keys[n > 0], n[n > 0], ORDER, lower[0]), *lower], keys)
                else:
                    found = lengths[np.searchsorted(keys, own)].astype("<f4").tobytes()
                    yield pa.RecordBatch.from_arrays([pa.array([tag], pa.int64()), pa.array([data], pa.binary()), pa.array([found], pa.binary())], ["tag", "packed", "counts"])

    return run


class Table:
    """Code lengths by window, looked up for whole arrays: places by multiplication, the next place where one is taken."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, (2 * len(keys)).bit_length())
        self.keys = np.full(1 << self.bits, np.uint64(2**64 - 1))
        self.values = np.zeros(1 << self.bits)
        at, mask = self.place(keys), (1 << self.bits) - 1
        while len(keys):
            free = self.keys[at] == np.uint64(2**64 - 1)
            self.keys[at[free]] = keys[free]
            placed = self.keys[at] == keys
            self.values[at[placed]] = values[placed]
            keys, values, at = keys[~placed], values[~placed], (at[~placed] + 1) & mask

    def place(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        at, mask = self.place(keys), (1 << self.bits) - 1
        wrong = np.flatnonzero(self.keys[at] != keys)
        while len(wrong):
            at[wrong] = (at[wrong] + 1) & mask
            wrong = wrong[self.keys[at[wrong]] != keys[wrong]]
        return self.values[at]


def scored(n: int, v: int, ends: int):
    """Scores documents from a stream sorted by (tag, kind): what was found for a block, then its documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        floor = math.log10(n + 0.1 * (v + 1))
        end = math.log10(ends + 0.1)
        current, known, found, table = None, {}, [], None
        kinds = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
        names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

        def judged(held: list[tuple[int | None, list[bytes]]]) -> pa.RecordBatch:
            keys, starts = windows([b" ".join(ws) for _, ws in held])
            scores = np.add.reduceat(table(keys), starts).tolist()
            out = []
            for (key, ws), score in zip(held, scores):
                x = np.fromiter(map(known.__getitem__, ws), np.float64, len(ws))  # log10(c + 0.1), above 0 where c > 0
                out.append((key, is_held_out(key), len(ws) + 1, int((x > 0).sum()) + (ends > 0), n, float(x.sum()) + end - (len(ws) + 1) * floor, score))
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

        for batch in batches:
            held, size = [], 0
            for tag, kind, key, text, data, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), *(batch.column(i) for i in (3, 4, 5))):
                if tag != current:
                    if held:
                        yield judged(held)
                    held, size, current, known, found, table = [], 0, tag, {}, [], None
                if kind == WORDS:
                    c = np.frombuffer(counts.as_buffer(), "<i8")
                    known.update(zip(data.as_py().split(b" "), np.log10(c + 0.1).tolist()))
                elif kind == WINDOWS:
                    found.append((unpacked(data.as_py()), np.frombuffer(counts.as_py(), "<f4").astype(np.float64)))
                else:
                    if table is None:
                        table = Table(*(np.concatenate(x) for x in zip(*found)))
                        found = []
                    held.append((key, words(text.as_py())))
                    size += len(text.as_py() or "")
                    if size >= STEP_BYTES // 4:
                        yield judged(held)
                        held, size = [], 0
            if held:
                yield judged(held)

    return run


def score_documents(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(size / BUCKET_BYTES))
    dealt = stash(docs.select("doc_id", "text").mapInArrow(deal(buckets), DEALT), compression="zstd")
    trains = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(10)) != 0, F.lit(True))
    ends = dealt.where((F.col("kind") == TEXT) & trains).count()

    in_buckets = dealt.where(F.col("kind") == WORDS).select("bucket", "tag", "packed", "counts").repartition(buckets, "bucket").sortWithinPartitions("bucket")
    counted = stash(in_buckets.mapInArrow(word_counts, "tag bigint, packed binary, counts binary, total bigint, kinds bigint"))
    count, kinds = counted.agg(F.coalesce(F.sum("total"), F.lit(0)), F.coalesce(F.sum("kinds"), F.lit(0))).first()
    n, v = count + ends, kinds + (ends > 0)

    seen = dealt.where(F.col("kind") == WINDOWS).select("bucket", "tag", "packed", "counts")
    whole = stash(seen.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(trie, "bucket int, packed binary, counts binary"))
    cells = whole.select("packed", "counts").mapInArrow(low_cells, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()  # 2^24 rows at most
    order = np.argsort(cells.column("cell").to_numpy())
    low = cells.column("cell").to_numpy()[order].astype(np.uint64), cells.column("n").to_numpy()[order]

    both = whole.select("bucket", F.lit(None).cast("long").alias("tag"), "packed", "counts").union(seen)
    lengths = both.repartition(buckets, "bucket").sortWithinPartitions("bucket", F.col("tag").asc_nulls_first()).mapInArrow(answers(low), "tag bigint, packed binary, counts binary")
    nothing = F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("text")
    stream = (
        counted.where("tag IS NOT NULL").select("tag", F.lit(WORDS).alias("kind"), *nothing, "packed", "counts")
        .union(lengths.select("tag", F.lit(WINDOWS).alias("kind"), *nothing, "packed", "counts"))
        .union(dealt.where(F.col("kind") == TEXT).select("tag", "kind", "doc_id", "text", "packed", "counts"))
    )
    ordered = stream.repartition(buckets, "tag").sortWithinPartitions("tag", "kind")
    return ordered.mapInArrow(scored(n, v, ends), "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")
