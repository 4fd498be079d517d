"""Toxicity scores from a learnt lexicon, with Levenshtein automata for misspelled terms.

1. Lexicon. Over all labelled training rows, each word is counted in toxic texts by its distinct pairs of
   neighbours (so that copies of one text count once) and in other texts by its occurrences. Words, and
   word beginnings as stems, whose toxic rate stands out by a log-likelihood ratio become terms.
2. Search. Terms and stems stand in a trie. The Levenshtein automaton of each distinct word of a block
   (bit-parallel states, one mask for each number of edits) runs through the trie, so all terms, and stems of
   a beginning of the word, within the allowed edits are found at once: none below 5 letters, 1 below 8, else
   2. Words that no entry can be near to are left out by a lossless filter. Case, look-alike letters of other
   scripts and digits used as letters are folded first.
3. Context. A hit inside quotation marks (within a window of words) or right after a word of report counts
   as quotation; a hit with a second-person word in its window counts as abuse.
4. Score. A logistic model over the sums of hits, fitted on ``FIT_ROWS`` labelled training rows at most.

Labels, lang, source and doc_id are no inputs of a score. Null and empty texts score as a text without
hits. Documents without label or with several labels (the highest counts) are allowed; repeated rows are
scored each; without labelled training rows the score is 0; further columns are ignored.
"""

from __future__ import annotations

import math
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.shared import stash
from .text import likely_in

#: Most labelled rows that the logistic model is fitted on.
FIT_ROWS = 20_000
#: Least log-likelihood ratio and least ratio of rates of a term.
LEAST_LLR, LEAST_RATIO = 40.0, 8.0
WINDOW = 6

#: Look-alike letters, digits and signs used as letters, quotation marks, words of report, second-person words.
LOOKALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "һ": "h", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h",
    "α": "a", "ο": "o", "ε": "e", "ρ": "p", "υ": "u", "ι": "i", "κ": "k", "ν": "v", "τ": "t",
    "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s",
}
OPENING, CLOSING = "\"“„«‘‹", "\"”“»’›"
REPORT = frozenset("said says say quoted quote quotes called wrote writes reads phrase word term insult slur sagte sagt nannte wort zitat dijo dice palabra cita dit disait mot citation".split())
SECOND_PERSON = frozenset("you your youre yours u ur du dich dir dein deine ihr euch sie tú tu te ti usted vosotros ustedes vous toi votre vos".split())


def folded(token: str) -> str:
    """Lower case, edges without signs, compatibility and look-alike letters mapped, runs of a letter cut to two."""
    token = unicodedata.normalize("NFKC", token).lower()
    a, b = 0, len(token)
    while a < b and not token[a].isalnum():
        a += 1
    while b > a and not token[b - 1].isalnum():
        b -= 1
    token = token[a:b]
    if not token or token.isdigit():
        return token
    if not (token.isascii() and token.isalpha()):
        token = "".join(LOOKALIKES.get(c, c) for c in token if c.isalnum() or c in "@$")
    out = []
    for c in token:
        if len(out) < 2 or out[-1] != c or out[-2] != c:
            out.append(c)
    return "".join(out)


def edits_for(n: int) -> int:
    return 0 if n < 5 else 1 if n < 8 else 2


class Filter:
    """Which words can lie within the allowed edits of an entry; none that does is missed, few others pass.

    Two words within k edits have a common rest after up to k letters are left out of each. The hashes of the
    entries' rests set bits of a table; a word passes when one of its own rests has its bit set. For a stem, the
    rests of the word's beginning of the stem's length are looked up, as no edit moves a matched letter out of it."""

    BITS, BASE, MIX = 27, 0x9E3779B97F4A7C15, 0xD1B54A32D192ED03

    def __init__(self, terms: list[str], stems: list[str]):
        self.table = np.zeros(1 << self.BITS - 3, np.uint8)
        self.stem_lengths = sorted({len(x) for x in stems})
        for salt, entries in enumerate((terms, stems)):
            for n in {len(x) for x in entries}:
                for at in self.places(self.letters([x for x in entries if len(x) == n], n), edits_for(n), salt):
                    np.bitwise_or.at(self.table, at >> 3, np.uint8(1) << (at & 7).astype(np.uint8))

    @staticmethod
    def letters(words: list[str], n: int) -> np.ndarray:
        return np.array(words, f"<U{n}").view(np.uint32).reshape(len(words), n)

    def places(self, letters: np.ndarray, k: int, salt: int) -> Iterator[np.ndarray]:
        """For each choice of up to k letters to leave out, the bits of the words' rests."""
        n = letters.shape[1]
        back = pow(self.BASE, -1, 1 << 64)
        powers = np.array([pow(self.BASE, i, 1 << 64) for i in range(n)], np.uint64)
        before = np.zeros((n + 1, len(letters)), np.uint64)
        np.cumsum((letters * powers).T, axis=0, out=before[1:])
        once, twice = np.uint64(back), np.uint64(back * back % (1 << 64))

        def bit(h: np.ndarray) -> np.ndarray:
            return ((h + np.uint64(salt)) * np.uint64(self.MIX) >> np.uint64(64 - self.BITS)).astype(np.int64)

        yield bit(before[n])
        if k >= 1:
            for i in range(n):
                yield bit(before[i] + (before[n] - before[i + 1]) * once)
        if k >= 2:
            for i in range(n):
                for j in range(i + 1, n):
                    yield bit(before[i] + (before[j] - before[i + 1]) * once + (before[n] - before[j + 1]) * twice)

    def passing(self, words: list[str]) -> list[str]:
        by_length: dict[int, list[str]] = {}
        for w in words:
            if len(w) >= 5:
                by_length.setdefault(len(w), []).append(w)
        out = []
        for n, some in by_length.items():
            letters = self.letters(some, n)
            found = np.zeros(len(some), bool)
            k = edits_for(n)
            for salt, m, e in [(0, n, k), *((1, min(n, m), min(k, edits_for(m))) for m in self.stem_lengths)]:
                for at in self.places(letters[:, :m], e, salt):
                    found |= (self.table[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
            out += [some[i] for i in np.flatnonzero(found)]
        return out


class Trie:
    """All terms and stems of 5 letters or more, for misspellings; shorter ones match exactly.

    A term is met by a whole word, a stem by some beginning of a word."""

    def __init__(self, terms: dict[str, float], stems: dict[str, float]):
        self.next: list[dict[str, int]] = [{}]
        self.term: list[str | None] = [None]
        self.stem: list[str | None] = [None]
        self.terms, self.stems = terms, stems
        self.stem_lengths = sorted({len(x) for x in stems}, reverse=True)
        self.filter: Filter | None = None
        for words, ends in ((terms, self.term), (stems, self.stem)):
            for word in words:
                if len(word) < 5:
                    continue
                at = 0
                for c in word:
                    if c not in self.next[at]:
                        self.next[at][c] = len(self.next)
                        self.next.append({})
                        self.term.append(None)
                        self.stem.append(None)
                    at = self.next[at][c]
                ends[at] = word

    def exact(self, word: str) -> tuple[str, float, int] | None:
        if word in self.terms:
            return "term", self.terms[word], 0
        for n in self.stem_lengths:
            if n <= len(word) and word[:n] in self.stems:
                return "stem", self.stems[word[:n]], 0
        return None

    def find(self, word: str) -> tuple[str, float, int] | None:
        """('term' or 'stem' or 'near', weight, number of edits) of the best entry, or None."""
        return self.exact(word) or self.nearest(word, edits_for(len(word)))

    def find_all(self, words: list[str]) -> dict[str, tuple[str, float, int]]:
        """The words with an entry, and what ``find`` gives for them."""
        if self.filter is None:
            self.filter = Filter([t for t in self.terms if len(t) >= 5], [t for t in self.stems if len(t) >= 5])
        out = {w: hit for w in words if (hit := self.exact(w))}
        for w in self.filter.passing([w for w in words if w not in out]):
            hit = self.nearest(w, edits_for(len(w)))
            if hit:
                out[w] = hit
        return out

    def nearest(self, word: str, k: int) -> tuple[str, float, int] | None:
        """The term or stem with fewest edits (1 to k), by the word's Levenshtein automaton run through the trie.

        Bit i of mask e: the path so far matches the first i letters of the word with e edits."""
        n = len(word)
        if not k:
            return None
        masks: dict[str, int] = {}
        for i, c in enumerate(word):
            masks[c] = masks.get(c, 0) | 1 << i
        full, accept = (1 << n + 1) - 1, 1 << n
        start = [(1 << e + 1) - 1 for e in range(k + 1)]  # e letters of the word skipped
        best = None
        stack = [(0, tuple(start))]
        while stack:
            node, state = stack.pop()
            for entry, weights, ends in ((self.term[node], self.terms, accept), (self.stem[node], self.stems, full)):
                if entry:
                    for e, m in enumerate(state):
                        if m & ends and e <= edits_for(len(entry)):
                            if e and (best is None or (e, -weights[entry]) < (best[2], -best[1])):
                                best = ("near", weights[entry], e)
                            break
            for c, child in self.next[node].items():
                own = masks.get(c, 0)
                now = [(state[0] & own) << 1]
                for e in range(1, k + 1):
                    # a match, a substituted letter, a letter the word lacks, a letter the term lacks
                    now.append(((state[e] & own) << 1 | state[e - 1] << 1 | state[e - 1] | now[e - 1] << 1) & full)
                if now[k]:
                    stack.append((child, tuple(now)))
        return best


class Reader(dict):
    """What each raw token of a text is: 0 for nothing of interest, a hit, or a context mark."""

    def __init__(self, trie: Trie, ordinary: frozenset[str] = frozenset()):
        self.trie, self.ordinary = trie, ordinary

    def prepare(self, texts: list[str | None]) -> None:
        """Looks up the new tokens of several texts at once."""
        if len(self) > 500_000:
            self.clear()
        new = {t: folded(t) for t in {t for text in texts if text for t in text.split()}.difference(self)}
        hits = self.trie.find_all(list({w for w in new.values() if len(w) >= 3}))
        for token, word in new.items():
            self[token] = self.mark(word, hits.get(word))

    def mark(self, word: str, hit: tuple[str, float, int] | None):
        if hit and not (hit[0] == "near" and word in self.ordinary):
            return (*hit, word)
        return "report" if word in REPORT else "you" if word in SECOND_PERSON else 0

    def __missing__(self, token: str):
        word = folded(token)
        mark = self[token] = self.mark(word, self.trie.find(word) if len(word) >= 3 else None)
        return mark


#: Texts whose new tokens are looked up together.
TOGETHER = 1000


def features_of(reader: Reader, texts: pa.Array) -> Iterator[list[float]]:
    """``features`` of each text."""
    for at in range(0, len(texts), TOGETHER):
        some = texts.slice(at, TOGETHER).to_pylist()
        reader.prepare(some)
        yield from (features(reader, t) for t in some)


def features(reader: Reader, text: str | None) -> list[float]:
    """Counts and weights of hits, by kind and context."""
    tokens = text.split() if text else []
    marks = list(map(reader.__getitem__, tokens))
    exact = stem = near = quoted = abuse = 0.0
    weight = 0.0
    distinct = set()
    for i, mark in enumerate(marks):
        if type(mark) is not tuple:
            continue
        kind, w, _, word = mark
        around = marks[max(0, i - WINDOW) : i + WINDOW + 1]
        inside = any(t[0] in OPENING for t in tokens[max(0, i - WINDOW) : i + 1]) and any(t.rstrip(".,;:!?")[-1:] in CLOSING and t for t in tokens[i : i + WINDOW + 1])
        if inside or "report" in marks[max(0, i - 2) : i]:
            quoted += 1
            continue
        if "you" in around:
            abuse += 1
        if kind == "term":
            exact += 1
        elif kind == "stem":
            stem += 1
        else:
            near += 1
        weight += w
        distinct.add(word)
    n = len(tokens)
    return [math.log1p(exact + near), math.log1p(stem), math.log1p(len(distinct)), math.log1p(abuse), math.log1p(quoted), math.log1p(weight), 100 * (exact + stem + near) / (n + 20)]



class Model:
    """Lexicon and coefficients, of the size of the toxic vocabulary and of what lies near to it; Spark sends larger ones to tasks as a broadcast."""

    def __init__(self, terms: dict[str, float], stems: dict[str, float], coefficients: list[float] | None = None, ordinary: frozenset[str] = frozenset()):
        self.terms, self.stems, self.coefficients, self.ordinary = terms, stems, coefficients, ordinary

    def reader(self) -> Reader:
        return Reader(Trie(self.terms, self.stems), self.ordinary)

    def score(self, x: list[float]) -> float:
        if self.coefficients is None:
            return 0.0
        z = self.coefficients[0] + sum(a * b for a, b in zip(self.coefficients[1:], x))
        return 1 / (1 + math.exp(-max(-35.0, min(35.0, z))))


def word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, around, toxic, n) of the task's texts: by pair of neighbours in toxic texts, in all in others."""
    import zlib

    known: dict[str, str] = {}
    counts: Counter = Counter()

    def out() -> pa.RecordBatch:
        keys = list(counts)
        return pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys]), pa.array([k[1] for k in keys], pa.int64()), pa.array([k[2] for k in keys], pa.int32()), pa.array(counts.values(), pa.int64())], ["word", "around", "toxic", "n"])

    for batch in batches:
        for text, toxic in zip(batch.column(0), batch.column(1).to_pylist()):
            tokens = (text.as_py() or "").split()
            if len(known) > 500_000:
                known.clear()
            for t in set(tokens).difference(known):
                known[t] = folded(t)
            ws = list(map(known.__getitem__, tokens))
            if toxic:
                counts.update((w, zlib.crc32(f"{a} {b}".encode()), 1) for a, w, b in zip(["", *ws], ws, [*ws[1:], ""]) if len(w) >= 3)
            else:
                counts.update((w, 0, 0) for w in ws if len(w) >= 3)
        if len(counts) > 400_000:
            yield out()
            counts.clear()
    if counts:
        yield out()


def outstanding(counts: DataFrame, word: str) -> list[tuple[str, float]]:
    """All entries (word, a toxic, b other) that stand out, with the log of their ratio of rates."""
    total = counts.agg(F.sum("a").alias("a_all"), F.sum("b").alias("b_all")).first()
    a_all, b_all = float(total[0] or 0), float(total[1] or 0)
    if not a_all or not b_all:
        return []
    a, b = F.col("a"), F.col("b")
    share = F.lit(a_all / (a_all + b_all))
    expected = (a + b) * share
    llr = 2 * (a * F.log(a / expected) + F.when(b > 0, b * F.log(b / ((a + b) * (1 - share)))).otherwise(0.0))
    ratio = ((a + 0.5) / a_all) / ((b + 0.5) / b_all)
    found = counts.where(a > 0).select(word, llr.alias("llr"), ratio.alias("ratio")).where((F.col("llr") >= LEAST_LLR) & (F.col("ratio") >= LEAST_RATIO))
    return [(r[0], math.log(r["ratio"])) for r in found.collect()]


def near_misses(by_word: DataFrame, model: Model) -> frozenset[str]:
    """Words of other texts that lie near a term by chance: all that are seen twice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(model.terms, model.stems)
        for batch in batches:
            words = batch.column(0).to_pylist()
            hits = trie.find_all(words)
            keep = [w in hits and hits[w][0] == "near" for w in words]
            yield batch.filter(pa.array(keep, pa.bool_()))

    found = by_word.where((F.col("b") >= 2) & (F.col("b") >= F.col("a"))).select("word").mapInArrow(run, "word string")
    return frozenset(r[0] for r in found.collect())


def is_held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1


def learn(docs: DataFrame, labels: DataFrame) -> Model:
    """Lexicon from all labelled rows that are not held out, coefficients from FIT_ROWS of them at most."""
    train = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~is_held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    texts = docs.select("doc_id", "text").where(F.col("doc_id").isNotNull() & ~is_held_out(F.col("doc_id")))
    rows = stash(likely_in(texts, train).join(train, "doc_id").select("doc_id", "text", "toxic"))
    counts = rows.select("text", "toxic").mapInArrow(word_counts, "word string, around bigint, toxic int, n bigint")
    counts = counts.groupBy("word", "around", "toxic").agg(F.sum("n").alias("n"))
    by_word = stash(counts.groupBy("word").agg(F.sum(F.col("toxic")).alias("a"), F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("b")))
    # A stem has several forms, none of which makes up most of it; terms are all words that stand out, those of a stem too.
    begun = by_word.where(F.length("word") >= 4).withColumn("stem", F.explode(F.expr("transform(sequence(3, least(length(word) - 1, 8)), i -> substring(word, 1, i))")))
    begun = begun.groupBy("stem").agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.count(F.when(F.col("a") > 0, 1)).alias("forms"), F.max("a").alias("most")).where("forms >= 4 AND most <= 0.5 * a")
    stems = dict(outstanding(begun, "stem"))
    terms = dict(outstanding(by_word, "word"))
    model = Model(terms, stems, ordinary=near_misses(by_word, Model(terms, stems)))

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = model.reader()
        for batch in batches:
            xs = list(features_of(reader, batch.column(0)))
            yield pa.RecordBatch.from_arrays([pa.array(xs, pa.list_(pa.float64())), batch.column(1)], ["x", "toxic"])

    share = min(1.0, FIT_ROWS / max(1, rows.count()))
    drawn = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)))
    sample = drawn.select("text", "toxic").mapInArrow(measured, "x array<double>, toxic int").limit(FIT_ROWS).collect()
    if sample:
        model.coefficients = fit(np.array([[1.0, *r[0]] for r in sample]), np.array([float(r[1] > 0) for r in sample]))
    return model


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 0.5, rounds: int = 60) -> list[float]:
    """Logistic regression by Newton steps with a small ridge on all but the constant."""
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[0] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (y - p) - penalty * w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w.tolist()


def scored(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = model.reader()
        for batch in batches:
            scores = list(map(model.score, features_of(reader, batch.column(1))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], ["doc_id", "score"])

    return run


def score_toxicity(docs: DataFrame, model: Model, limit: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    out = docs.select("doc_id", "text").mapInArrow(scored(model), "doc_id bigint, score double")
    return out.select("doc_id", F.coalesce(is_held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= limit).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, model: Model, limit: float = 0.7) -> DataFrame:
    """The rows that score below the limit, with all their columns."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = model.reader()
        for batch in batches:
            keep = [model.score(x) < limit for x in features_of(reader, batch.column(at))]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
