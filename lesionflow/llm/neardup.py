"""Near duplicates: one-permutation hashing, banded buckets, star-shaped candidates, confirmed links.

1. Each document's set of distinct 5-word shingles becomes 64-bit hashes. One permutation splits them into
   BINS bins and keeps the smallest of each; empty bins borrow from filled ones by optimal densification
   (each empty bin has its own fixed order of bins to try). BANDS bands of ROWS bins give bucket keys: a
   pair at similarity 0.75 shares none with probability 5e-6.
2. Documents with equal sets are one class from here on, so copies cost nothing.
3. Stars: in each bucket every class is paired with the bucket's smallest class. Pairs whose sketches
   could not belong to linked sets (ESTIMATE) are left out; the rest is confirmed on full shingle sets, and
   confirmed links give components.
4. The rest, exactly: a star misses links between two members neither of which is the centre. In a bucket that
   holds several components, every member outside the largest one is compared with all members, in pairs of
   blocks of bounded size. A first pass over sketches keeps the members that may have a link; they meet again
   with their full sets, and the task itself confirms links, joins components as it finds them, leaves out pairs
   already joined, and puts out only links that join two components. A pair is looked at in the first band
   that holds it. So no table of pairs grows with the square of a group, and no bucket, group or partner list
   is cut.

Words: A-Z lower-cased, ``[^\\x20\\x09-\\x0D]+``. With fewer words the whole sequence is one shingle; a
document without words has an empty set and no links. Two sets are linked when
100 * intersection >= 75 * union. Rows that repeat a doc_id are one document (their shingles are those of
the largest text); null doc_ids are left out of ``near_groups`` and kept by ``drop_near_copies``; an empty
table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.components import components
from ..plans.shared import stash
from .text import likely_in, without, words

SHINGLE, SIMILAR = 5, 75
BINS, BANDS, ROWS = 256, 32, 4
#: Least share of equal bins of sketches that may belong to linked sets: 0.75 less four standard deviations or more, for
#: sets of SMALL shingles or more, of TINY or more, and below (borrowed bins make the shares of small sets uneven).
ESTIMATE, SMALL, SMALL_ESTIMATE, TINY, TINY_ESTIMATE = 0.64, 200, 0.6, 24, 0.4
#: Most classes and about as many shingles as may be in one block of a bucket.
BLOCK, BLOCK_SHINGLES = 1024, 1_000_000
_M = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)
_PROBES = np.random.Generator(np.random.PCG64(20_240_229)).integers(0, BINS, (BINS, 4 * BINS))  # each empty bin's order of bins to try


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > 300_000:
            self.clear()
        self[word] = found = xxhash.xxh3_64_intdigest(word)
        return found


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(_M[1])
    h = (h ^ (h >> np.uint64(29))) * np.uint64(_M[2])
    return h ^ (h >> np.uint64(32))


def shingles(hashes: WordHashes, text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles."""
    ws = words(text)
    n = len(ws)
    h = np.fromiter(map(hashes.__getitem__, ws), np.uint64, n)
    if not n:
        return h
    with np.errstate(over="ignore"):
        if n < SHINGLE:
            whole = np.uint64(n)
            for x in h:
                whole = mixed(np.array([whole * np.uint64(_M[0]) + x], np.uint64))[0]
            return np.array([whole], np.uint64)
        m = n - SHINGLE + 1
        total = h[:m] * np.uint64(_M[0])
        for i in range(1, SHINGLE):
            total = total + h[i : i + m] * np.uint64(_M[i])
        return np.unique(mixed(total))


def sketch(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """BINS bytes of the densified bins, and the bucket keys of the bands."""
    bins = (s >> np.uint64(56)).astype(np.int64)  # sorted, so each bin's first is its smallest
    first = np.ones(len(s), bool)
    np.not_equal(bins[1:], bins[:-1], out=first[1:])
    values, filled = np.zeros(BINS, np.uint64), np.zeros(BINS, bool)
    values[bins[first]], filled[bins[first]] = s[first], True
    empty = np.flatnonzero(~filled)
    source = np.arange(BINS)
    if len(empty):
        hits = filled[_PROBES[empty]]
        at = hits.argmax(axis=1)
        lent = _PROBES[empty, at]
        none = ~hits[np.arange(len(empty)), at]
        lent[none] = bins[0]
        source[empty] = lent
    values = values[source]
    with np.errstate(over="ignore"):
        fine = mixed(values + np.arange(BINS, dtype=np.uint64))
        banded = values[: BANDS * ROWS * (BINS // (BANDS * ROWS))].reshape(-1, ROWS)[:BANDS]
        keys = np.arange(1, BANDS + 1, dtype=np.uint64)
        for r in range(ROWS):
            keys = mixed(keys * np.uint64(_M[3]) + banded[:, r])
    return fine.astype(np.uint8), keys.view(np.int64)


def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import hashlib

    hashes = WordHashes()
    for batch in batches:
        sets = [shingles(hashes, t.as_py()) for t in batch.column(1)]
        marks = [sketch(s) if len(s) else (np.zeros(0, np.uint8), np.zeros(0, np.int64)) for s in sets]
        yield pa.RecordBatch.from_arrays([
            batch.column(0), pa.array(map(len, sets), pa.int64()), pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
            pa.array([m.tobytes() for m, _ in marks], pa.binary()), pa.array([k for _, k in marks], pa.list_(pa.int64())),
        ], ["doc_id", "n_shingles", "digest", "sketch", "bands"])


def full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingles(hashes, t.as_py()).tobytes() for t in batch.column(1)], pa.binary())], ["id", "set"])


def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs (a, b) whose full sets are linked."""
    for batch in batches:
        keep = []
        for x, y in zip(batch.column(2), batch.column(3)):
            s, t = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            both = len(np.intersect1d(s, t, assume_unique=True))
            keep.append(100 * both >= SIMILAR * (len(s) + len(t) - both))
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def may_link(n_a: np.ndarray, n_b: np.ndarray, equal: np.ndarray) -> np.ndarray:
    """Whether sets of these sizes with so many equal bins may be linked."""
    small, large = np.minimum(n_a, n_b), np.maximum(n_a, n_b)
    return (100 * small >= SIMILAR * large) & (equal >= np.where(small >= SMALL, ESTIMATE, np.where(small >= TINY, SMALL_ESTIMATE, TINY_ESTIMATE)) * BINS)


def possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs (a, b) of (a, b, n_a, n_b, sketch_a, sketch_b) whose sketches may belong to linked sets."""
    for batch in batches:
        x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, BINS) for i in (4, 5))
        keep = may_link(batch.column(2).to_numpy(), batch.column(3).to_numpy(), (x == y).sum(axis=1))
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def sets_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, set) of the documents in ``wanted`` (doc_id), the set of the largest text where a doc_id repeats."""
    wanted = stash(wanted)
    few = likely_in(docs.select("doc_id", "text"), wanted)  # so that the join moves few texts that it drops
    sets = stash(few.join(wanted, "doc_id", "left_semi").mapInArrow(full_sets, "id bigint, set binary"))
    return sets.groupBy("id").agg(F.max_by("set", F.struct(F.length("set"), "set")).alias("set")) if has_repeats(sets) else sets


def confirmed(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) of doc_ids whose full shingle sets are linked. Sets are made for documents in pairs only."""
    sets = sets_of(docs, pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct())
    first = pairs.join(sets.withColumnsRenamed({"id": "a", "set": "set_a"}), "a")
    both = first.join(sets.withColumnsRenamed({"id": "b", "set": "set_b"}), "b").select("a", "b", "set_a", "set_b")
    return both.mapInArrow(judged, "a bigint, b bigint")


def has_repeats(sets: DataFrame) -> bool:
    return not sets.groupBy("id").count().where("count > 1").isEmpty()


def blocks_of(members: DataFrame) -> DataFrame:
    """Pairs (i, j) of blocks of each bucket (key) that holds several components: the members outside its largest component (minor) are cut
    into blocks i, all members into blocks j. Every member goes to its own block j with each i, a minor one also to its own i with each j."""
    parts = members.groupBy("key", "component").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("shingles"))
    largest = F.max(F.struct("size", "shingles", "component"))
    sizes = parts.groupBy("key").agg(largest.alias("most"), F.sum("size").alias("size"), F.sum("shingles").alias("shingles"), F.count(F.lit(1)).alias("parts")).where("parts > 1")

    def blocks(size: str, shingles: str) -> Column:
        return F.greatest(F.ceil(F.expr(size) / BLOCK), F.ceil(F.expr(shingles) / BLOCK_SHINGLES)).cast("int")

    sizes = sizes.select("key", F.col("most.component").alias("main"), blocks("size - most.size", "shingles - most.shingles").alias("n_i"), blocks("size", "shingles").alias("n_j"))
    rows = members.join(sizes, "key").withColumn("minor", F.col("component") != F.col("main"))
    rows = rows.withColumns({"own_i": F.pmod(F.xxhash64("id", F.lit(1)), "n_i").cast("int"), "own_j": F.pmod(F.xxhash64("id"), "n_j").cast("int")})
    across = F.transform(F.sequence(F.lit(0), F.col("n_i") - 1), lambda i: F.struct(i.alias("i"), F.col("own_j").alias("j"), (F.col("minor") & (i == F.col("own_i"))).alias("asks"), F.lit(True).alias("asked")))
    down = F.filter(F.transform(F.sequence(F.lit(0), F.col("n_j") - 1), lambda j: F.struct(F.col("own_i").alias("i"), j.alias("j"), F.lit(True).alias("asks"), F.lit(False).alias("asked"))), lambda x: F.col("minor") & (x["j"] != F.col("own_j")))
    return rows.select("key", "band", "id", "n", "component", "minor", F.explode(F.concat(across, down)).alias("at")).select("key", "at.i", "at.j", "at.asks", "at.asked", "band", "id", "n", "component", "minor")


def groups_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each (key, i, j), the first three columns, of batches sorted by them."""
    held: list[pa.RecordBatch] = []
    current = None
    for batch in batches:
        if not batch.num_rows:
            continue
        marks = np.stack([batch.column(c).to_numpy() for c in range(3)])
        cuts = [0, *(np.flatnonzero((marks[:, 1:] != marks[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            mark = marks[:, a].tolist()
            if mark != current and held:
                yield pa.Table.from_batches(held).combine_chunks()
                held = []
            current = mark
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


class Group:
    """A pair of blocks of a bucket: which of its members may be linked, by size, sketch and band."""

    def __init__(self, rows: pa.Table):
        self.ids, self.n, self.parts, self.band = (rows.column(c).to_numpy() for c in ("id", "n", "component", "band"))
        self.asks, self.asked, self.minor = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("asks", "asked", "minor"))
        self.sketches = np.frombuffer(b"".join(rows.column("sketch").to_pylist()), np.uint8).reshape(-1, BINS)
        self.keys = np.frombuffer(b"".join(rows.column("keys").to_pylist()), np.int64).reshape(-1, BANDS)

    def partners(self, a: int) -> np.ndarray:
        """The members that member a may be linked with, likeliest first; two minor members are compared once, by the smaller id."""
        far = np.flatnonzero(self.asked & (self.parts != self.parts[a]) & (~self.minor | (self.ids > self.ids[a])))
        far = far[100 * np.minimum(self.n[far], self.n[a]) >= SIMILAR * np.maximum(self.n[far], self.n[a])]
        if self.band[a] and len(far):
            far = far[~(self.keys[far, : self.band[a]] == self.keys[a, : self.band[a]]).any(axis=1)]
        if not len(far):
            return far
        equal = (self.sketches[far] == self.sketches[a]).sum(axis=1)
        keep = may_link(np.full(len(far), self.n[a]), self.n[far], equal)
        return far[keep][np.argsort(-equal[keep], kind="stable")]


def possible_members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of members that have a partner in their group, or are one."""
    for rows in groups_of(batches):
        group = Group(rows)
        used = np.zeros(rows.num_rows, bool)
        for a in np.flatnonzero(group.asks).tolist():
            far = group.partners(a)
            used[far] = True
            used[a] |= len(far) > 0
        if used.any():
            yield from rows.filter(pa.array(used)).to_batches()


def joining_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b) component labels that a link confirmed on full sets joins; rows as in ``possible_members``, with their ``set``."""
    above: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := above.get(x, x)) != x:
            above[x] = above.get(up, up)
            x = up
        return x

    for rows in groups_of(batches):
        group, found = Group(rows), []
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in rows.column("set")]
        _, local = np.unique(np.concatenate(sets), return_inverse=True)  # shingles by number in the group
        local = np.split(local.astype(np.int32), np.cumsum([len(x) for x in sets])[:-1])
        flag = np.zeros(max(int(x.max()) for x in local) + 1, bool)
        for a in np.flatnonzero(group.asks).tolist():
            far, step = group.partners(a), 4
            flag[local[a]] = True
            while len(far):
                own = root(int(group.parts[a]))
                far = far[[root(int(p)) != own for p in group.parts[far]]]
                some, far, step = far[:step], far[step:], 4 * step
                if not len(some):
                    break
                lengths = group.n[some]
                both = np.add.reduceat(flag[np.concatenate([local[b] for b in some])].astype(np.int32), np.cumsum(lengths) - lengths)
                for b in some[100 * both >= SIMILAR * (len(local[a]) + lengths - both)].tolist():
                    p, q = root(int(group.parts[a])), root(int(group.parts[b]))
                    if p != q:
                        above[max(p, q)] = min(p, q)
                        found.append((p, q))
            flag[local[a]] = False
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], ["a", "b"])


GROUPED = "key bigint, i int, j int, asks boolean, asked boolean, band int, id bigint, n bigint, component bigint, minor boolean, sketch binary, keys binary"


def open_links(docs: DataFrame, members: DataFrame, leading: DataFrame, whole: DataFrame) -> DataFrame:
    """(a, b): components of ``whole`` (node, component) that a link which the stars missed joins."""
    parts = members.select("key", "band", "id", "n").join(whole.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    packed = F.expr("unhex(array_join(transform(bands, k -> lpad(hex(k), 16, '0')), ''))")
    rows = blocks_of(parts).join(leading.select("id", "sketch", packed.alias("keys")), "id").select(*GROUPED.replace(",", "").split()[::2])
    place = ("key", "i", "j")
    used = stash(rows.repartition(*place).sortWithinPartitions(*place, "id").mapInArrow(possible_members, GROUPED))
    sets = sets_of(docs, used.select(F.col("id").alias("doc_id")).distinct())
    return used.join(sets, "id").select(*used.columns, "set").repartition(*place).sortWithinPartitions(*place, "id").mapInArrow(joining_links, "a bigint, b bigint")


def near_groups(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every document."""
    docs = docs.where(F.col("doc_id").isNotNull())
    marks = stash(docs.select("doc_id", "text").mapInArrow(sketched, "doc_id bigint, n_shingles bigint, digest binary, sketch binary, bands array<bigint>"))
    if not marks.groupBy("doc_id").count().where("count > 1").isEmpty():
        marks = stash(marks.groupBy("doc_id").agg(F.max_by(F.struct("n_shingles", "digest", "sketch", "bands"), F.struct("n_shingles", "digest")).alias("m")).select("doc_id", "m.*"))
    classes = marks.where("n_shingles > 0").groupBy("digest").agg(F.min("doc_id").alias("id"))
    of_class = stash(marks.where("n_shingles > 0").select("doc_id", "digest").join(classes, "digest").select("doc_id", "id"))
    leaders = of_class.where("doc_id = id").select("doc_id")
    leading = stash(marks.join(leaders, "doc_id", "left_semi").select(F.col("doc_id").alias("id"), F.col("n_shingles").alias("n"), "sketch", "bands"))
    keyed = leading.select("id", "n", F.posexplode("bands").alias("band", "key"))
    stars = keyed.groupBy("key").agg(F.min("id").alias("centre"), F.count(F.lit(1)).alias("size")).where("size > 1")
    members = stash(keyed.join(stars, "key").select("key", "band", "id", "n", "centre"))
    pairs = members.where("id <> centre").select(F.col("centre").alias("a"), F.col("id").alias("b")).distinct()
    side = leading.select("id", "n", "sketch")
    pairs = pairs.join(side.withColumnsRenamed({"id": "a", "n": "n_a", "sketch": "sketch_a"}), "a").join(side.withColumnsRenamed({"id": "b", "n": "n_b", "sketch": "sketch_b"}), "b")
    pairs = pairs.select("a", "b", "n_a", "n_b", "sketch_a", "sketch_b").mapInArrow(possible, "a bigint, b bigint")
    pairs = stash(pairs)
    first = stash(components(confirmed(docs, pairs)))
    # what stars leave open joins components, which keep their smallest document as label
    joined = components(stash(open_links(docs, members, leading, first))).select(F.col("node").alias("component"), F.col("component").alias("joined"))
    whole = first.withColumnRenamed("node", "id")
    component = of_class.join(whole, "id", "left").withColumn("component", F.coalesce("component", "id")).join(joined, "component", "left").select("doc_id", F.coalesce("joined", "component").alias("component_id"))
    out = marks.select("doc_id", "n_shingles").join(component, "doc_id", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return out.withColumn("kept", F.col("doc_id") == F.col("component_id"))


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """The rows whose document stays (one of each component), with all their columns."""
    return without(docs, stash(near_groups(docs).where("NOT kept").select("doc_id")))
