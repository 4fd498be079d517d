"""Byte-level BPE by merge replay over a corpus block.

Each task cuts its documents into blocks of bounded size, splits them with the tokenizer's pattern and
lays the block's distinct unseen words end to end. An inverted index from token pair to positions drives
the merges: the lowest rank that occurs anywhere is replayed at all its positions, and only the touched
neighbours enter the index anew. Words then map to id strings and documents are joined from them, so
nothing is shuffled and memory follows the block, not the corpus. A bounded table of words carries over
from block to block.

A word that is itself a token takes that token at once, and a word in which a merge makes a pair of lower
rank waits until that pair is done; both as the tiktoken library does. Null text is empty; empty text has
no ids; repeated rows and further columns do no harm; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import heapq
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of text and new pieces in a block; rows in an output batch.
BLOCK_CHARS, BLOCK_PIECES, ROWS_OUT = 24_000_000, 250_000, 1_000


#: What may count as white space; no other character comes near a single space that is cut at.
SPACES = [c for c in map(chr, range(0x3001)) if c.isspace()]


def read_ranks(path: str) -> dict[bytes, int]:
    """A tiktoken rank file: a base64 token and its rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Merges:
    """Ranks of token pairs, looked up for whole arrays of pairs at once."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        found = {}
        for token, r in ranks.items():
            for i in range(1, len(token)):
                if (a := ranks.get(token[:i])) is not None and (b := ranks.get(token[i:])) is not None:
                    found[a << 32 | b] = r
        self.keys = np.array(sorted(found), np.int64)
        self.of = np.array([found[k] for k in self.keys.tolist()], np.int32)
        self.bytes = np.array([ranks[bytes([b])] for b in range(256)], np.int32)

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair, -1 where there is none."""
        if not len(self.keys):
            return np.full(len(a), -1, np.int32)
        key = a.astype(np.int64) << 32 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.of[at], np.int32(-1))


def distinct(places: np.ndarray) -> np.ndarray:
    """Sorted, without repeats."""
    places = np.sort(places)
    keep = np.ones(len(places), bool)
    np.not_equal(places[1:], places[:-1], out=keep[1:])
    return places[keep]


def replay(words: list[bytes], merges: Merges) -> tuple[np.ndarray, np.ndarray]:
    """How many ids each word has, and the ids of all words end to end; all merges are replayed over all words together.

    ``pair[i]`` is the rank of the pair that begins at position i, -1 where none does; the index holds
    positions by rank, some of them stale, and ``pair`` tells which still hold."""
    ranks = merges.ranks
    whole = np.array([ranks.get(w, -1) for w in words], np.int64)
    rest = [w for w in words if w not in ranks]
    if not rest:
        return np.ones(len(words), np.int64), whole.astype(np.int32)
    lengths = np.array([len(w) for w in rest])
    ids = merges.bytes[np.frombuffer(b"".join(rest), np.uint8)]
    ends = np.cumsum(lengths)
    owner = np.repeat(np.arange(len(rest), dtype=np.int32), lengths)
    n = len(ids)
    after, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
    after[ends - 1], before[ends - lengths] = -1, -1
    pair = np.full(n, -1, np.int32)
    heads = np.flatnonzero(after >= 0).astype(np.int32)
    for a in range(0, len(heads), 500_000):  # in parts, as a lookup takes many times its input's room
        some = heads[a : a + 500_000]
        pair[some] = merges(ids[some], ids[some + 1])
    index: dict[int, list[np.ndarray]] = {}
    heap: list[int] = []

    def enter(places: np.ndarray) -> None:
        found = pair[places]
        places, found = places[found >= 0], found[found >= 0]
        if not len(places):
            return
        order = np.argsort(found, kind="stable")
        places, found = places[order], found[order]
        cuts = np.flatnonzero(np.diff(found)) + 1
        for r, group in zip(found[np.r_[0, cuts]].tolist(), np.split(places, cuts)):
            if r not in index:
                heapq.heappush(heap, r)
                index[r] = [group]
            else:
                index[r].append(group)

    enter(heads)
    taken, alive = np.zeros(n, bool), np.ones(n, bool)
    while heap:
        r = heapq.heappop(heap)
        held = index.pop(r)
        at = held[0] if len(held) == 1 else np.concatenate(held)
        at = at[pair[at] == r]
        if not len(at):
            continue
        if len(held) > 1:
            at = distinct(at)
        open_ = at
        taken[at] = True
        follows = (p := before[at]) >= 0
        if (follows & taken[p]).any():  # pairs that share a token: the left one is merged
            for i in at[follows & taken[p]].tolist():
                taken[i] = not taken[before[i]]
            taken_now = taken[at]
            taken[at] = False
            at = at[taken_now]
            taken[at] = True
        k = after[after[at]]
        inner = k >= 0
        # Where merging one place makes a pair of lower rank, also with the place merged next to it, the word's other places wait for it.
        lower = np.zeros(len(at), bool)
        between = merges(np.full(int(inner.sum()), r, np.int32), ids[k[inner]])
        lower[inner] = (between >= 0) & (between < r)
        if (next_to := taken[k] & inner).any():
            lower |= next_to & (0 <= (twice := int(merges(np.array([r], np.int32), np.array([r], np.int32))[0])) < r)
        p = before[at]
        outer = p >= 0
        ahead = merges(ids[p[outer]], np.full(int(outer.sum()), r, np.int32))
        lower[outer] |= (ahead >= 0) & (ahead < r)
        if lower.any():
            slow = np.isin(owner[at], owner[at[lower]])
            _, first = np.unique(owner[at], return_index=True)
            now = ~slow
            now[first] = True
            taken[at[~now]] = False
            if slow.any():  # with the places that were passed over for a left one that now waits
                heapq.heappush(heap, r)
                index[r] = [open_[np.isin(owner[open_], owner[at[slow]])]]
            at, k, inner = at[now], k[now], inner[now]
        taken[at] = False
        gone = after[at]
        pair[gone], alive[gone] = -1, False
        ids[at] = r
        after[at] = k
        before[k[inner]] = at[inner]
        pair[at] = -1
        pair[at[inner]] = merges(ids[at[inner]], ids[k[inner]])
        p = before[at]
        p = p[p >= 0]
        pair[p] = merges(ids[p], ids[after[p]])
        enter(distinct(np.concatenate([at, p])))
    kept = np.flatnonzero(alive)
    counts = np.ones(len(words), np.int64)
    counts[whole < 0] = np.bincount(owner[kept], minlength=len(rest))
    out = np.empty(int(counts.sum()), np.int32)
    single = np.repeat(whole >= 0, counts)
    out[single], out[~single] = whole[whole >= 0], ids[kept]
    return counts, out


def spread(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """values[start : start + length] of each pair, end to end."""
    stops = np.cumsum(lengths)
    return values[np.repeat(starts - stops + lengths, lengths) + np.arange(stops[-1] if len(stops) else 0)]


class Numbered(dict):
    """Numbers of strings; a new one gets the next number of the list that it joins, which holds those not yet encoded."""

    def __init__(self, new: list[str], lead: str = "", counter: list[int] | None = None):
        self.new, self.lead, self.counter = new, lead, [0] if counter is None else counter

    def __missing__(self, piece: str) -> int:
        self.new.append(self.lead + piece)
        self[piece] = found = self.counter[0]
        self.counter[0] += 1
        return found


class Strings:
    """Ids of numbered strings, end to end."""

    def __init__(self) -> None:
        self.ids, self.at, self.len = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, lengths: np.ndarray, ids: np.ndarray) -> None:
        self.at = np.concatenate([self.at, len(self.ids) + np.cumsum(lengths) - lengths])
        self.len = np.concatenate([self.len, lengths])
        self.ids = np.concatenate([self.ids, ids.astype(np.uint32)])

    def of(self, numbers: np.ndarray) -> np.ndarray:
        return spread(self.ids, self.at[numbers], self.len[numbers])


class Codec:
    """Encodes and decodes the documents of a task; ids are numpy arrays of unsigned 32-bit integers.

    No match of the pattern runs over a single space between two other characters into what precedes it, so
    texts are first cut there; the pieces, which repeat much more than documents do, are split into words once."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.merges, self.find = Merges(ranks), regex.compile(pattern).findall
        self.cut = regex.compile(r"(?<=\S)(?= \S)").split
        ordered = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, r in ranks.items():
            ordered[r] = token
        self.token_bytes = np.frombuffer(b"".join(ordered), np.uint8)
        self.token_len = np.array([len(t) for t in ordered], np.int64)
        self.token_at = np.cumsum(self.token_len) - self.token_len
        self.clear()

    def clear(self) -> None:
        self.new_pieces: list[str] = []
        self.new_words: list[str] = []
        self.seen = [0]
        self.raw, self.spaced = Numbered(self.new_pieces, "", self.seen), Numbered(self.new_pieces, " ", self.seen)
        self.words, self.pieces, self.of_words = Numbered(self.new_words), Strings(), Strings()

    def note(self, text: str | None) -> array:
        """The numbers of the text's pieces."""
        if not text:
            return array("I")
        if any(c in text and (f" {c}" in text or f"{c} " in text) for c in SPACES):
            return array("I", map(self.raw.__getitem__, self.cut(text)))
        first, *rest = text.split(" ")
        out = array("I", [self.raw[first]])
        out.extend(map(self.spaced.__getitem__, rest))
        return out

    def settle(self) -> None:
        """Encodes the pieces that came since the last call."""
        gc.disable()  # nothing here has cycles, and the many small objects would be searched for them again and again
        try:
            numbers, each = array("I"), array("I")
            for piece in self.new_pieces:
                own = self.find(piece)
                each.append(len(own))
                numbers.extend(map(self.words.__getitem__, own))
            self.new_pieces.clear()
            self.of_words.add(*replay([w.encode("utf-8") for w in self.new_words], self.merges))
            self.new_words.clear()
            numbers, each = (np.frombuffer(x, np.uint32) if len(x) else np.zeros(0, np.uint32) for x in (numbers, each))
            ends = np.r_[0, np.cumsum(self.of_words.len[numbers])]
            stops = np.cumsum(each)
            self.pieces.add(ends[stops] - ends[stops - each], self.of_words.of(numbers))
        finally:
            gc.enable()

    def encode(self, noted: array) -> np.ndarray:
        numbers = np.frombuffer(noted, np.uint32) if len(noted) else np.zeros(0, np.uint32)
        return self.pieces.of(numbers)

    def decode(self, ids: np.ndarray) -> bytes:
        return spread(self.token_bytes, self.token_at[ids], self.token_len[ids]).tobytes()


def coded(make: Callable[[], Codec], report: Callable[[Codec, np.ndarray], tuple], kinds: list[pa.DataType], names: list[str]):
    """A mapInArrow function over (doc_id, text): report's columns for each document, block by block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, held, chars = make(), [], 0

        def finish() -> Iterator[pa.RecordBatch]:
            codec.settle()
            for a in range(0, len(held), ROWS_OUT):
                part = held[a : a + ROWS_OUT]
                rows = zip(*(report(codec, codec.encode(noted)) for _, noted in part))
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in part], pa.int64()), *(pa.array(c, k) for c, k in zip(rows, kinds))], names)
            held.clear()
            if codec.seen[0] > BLOCK_PIECES:
                codec.clear()

        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                held.append((key, codec.note(text := text.as_py())))
                chars += len(text) if text else 0
                if chars > BLOCK_CHARS or len(codec.new_pieces) > BLOCK_PIECES:
                    yield from finish()
                    chars = 0
        if held:
            yield from finish()

    return run


def stored(ids: np.ndarray) -> bytes:
    """Little-endian unsigned 32-bit integers."""
    return ids.astype("<u4").tobytes()


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """doc_id and ids (binary, little-endian unsigned 32-bit) of every row."""
    shipped = docs.sparkSession.sparkContext.broadcast(ranks)  # the vocabulary's size bounds it
    run = coded(lambda: Codec(shipped.value, pattern), lambda codec, ids: (stored(ids),), [pa.binary()], ["doc_id", "ids"])
    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, ids binary")


def decode(encoded: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """doc_id and decoded (binary) of rows (doc_id, ids)."""
    shipped = encoded.sparkSession.sparkContext.broadcast(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(shipped.value, "")
        for batch in batches:
            out = [codec.decode(np.frombuffer(ids, "<u4")) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["doc_id", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, decoded binary")


def round_trip(docs: DataFrame, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row: encoded, then decoded from the ids."""
    shipped = docs.sparkSession.sparkContext.broadcast(ranks)

    def report(codec: Codec, ids: np.ndarray) -> tuple:
        return len(ids), hashlib.sha256(stored(ids)).hexdigest(), hashlib.sha256(codec.decode(ids)).hexdigest()

    run = coded(lambda: Codec(shipped.value, pattern), report, [pa.int64(), pa.string(), pa.string()], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
