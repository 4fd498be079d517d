"""Exact Jaccard join of shingle sets by partitioning the universe of shingles.

1. A document's set of distinct 3-word shingles is hashed to 64 bits. Equal sets are one class; its smallest doc_id
   stands for it.
2. Size bands. Two sets of sizes a <= b that are linked differ in (a + b) / 19 shingles or fewer and lie in one band or
   in neighbouring ones, so a set is indexed in its own band and, where it may have smaller partners there, in the one below.
3. A band cuts the universe of shingles into m segments by hash. H being the most differences of a linked pair of the
   band, a value of 1 (the subsets in that segment are equal) or 2 (they differ by one shingle at most) is given to each
   segment, H + 1 in all: then one segment at least holds, as H + 1 segments cannot all take one difference more than
   they may. A segment of value 2 indexes its subset and all subsets with one shingle deleted.
4. Allocation by cost: for each band m = H + 1 (all values 1) stands against two thirds and half of that, in which the
   segments are raised to 2 where it costs least. The cost is measured on all documents: index rows plus pairs that would meet,
   counted on one in SAMPLE of the possible keys. It changes what the join costs, never what it returns.
5. Documents with a common key are candidates. In each bucket all members are compared with the smallest doc_id first; confirmed
   links give components. Of buckets of up to FEW members that still hold several, the distinct pairs across components are compared. Larger
   ones are worked through in pairs of blocks, inside tasks that leave out pairs already joined or met under an earlier
   segment and put out only links that join components.
6. Every link is confirmed on full sets: 100 * intersection >= 90 * union. No bucket, pair or partner list is cut. Sets are moved only for pairs that
   parities of their shingles leave: sets differ in one shingle at least for each bit of their signatures that differs, so no link is lost.

Words: A-Z lower-cased, ``[^\\x20\\x09-\\x0D]+``. With fewer than three words the whole sequence is one shingle; a document without
words has an empty set and no links. Sets under SMALLEST shingles are linked with equal sets only, as any other set differs by too
much. Rows that repeat a doc_id are one document (the largest set counts); null doc_ids are left out; an empty table gives no rows; further
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.components import components
from ..plans.shared import stash
from .neardup import WordHashes, blocks_of, groups_of, has_repeats, mixed
from .text import likely_in, without, words

SHINGLE = 3
#: 100 * intersection >= SIMILAR * union; so 19 * differences <= a + b, and sizes 9 and 10 are the smallest different ones.
SIMILAR, PER_DIFFERENCE, SMALLEST = 90, 19, 9
#: Bands whose H is larger are not weighed: their subsets are indexed as they are.
WEIGHED = 63
#: One in so many keys is counted for the costs; a pair of sets of PAIR shingles costs as much as an index row.
SAMPLE, PAIR = 64, 500
#: Members of a bucket's centre that are compared in one task's group.
STAR = 512
#: Members up to which a bucket gives pairs (120 at most, and each only once for all buckets); beyond, blocks of the bucket meet.
FEW = 16
#: Shingles that are hashed to subsets together, and documents whose sets are held together.
TOGETHER, DOCUMENTS = 400_000, 1000
_W = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)

Plan = tuple[int, frozenset[int]]  # number of segments, those of value 2


def band_starts() -> np.ndarray:
    """The smallest size of each band; a band reaches to 1 / 0.81 of it."""
    starts = [SMALLEST]
    while starts[-1] < 1 << 40:
        starts.append(starts[-1] * 100 // 81 + 1)
    return np.array(starts)


STARTS = band_starts()


def most_differences(band: int) -> int:
    """Of a linked pair whose smaller set is in the band."""
    largest = int(STARTS[band + 1]) - 1
    return (largest + largest * 100 // SIMILAR) // PER_DIFFERENCE


def bands_of(n: int) -> list[int]:
    """The bands in which a set of n shingles is indexed."""
    if n < SMALLEST:
        return []
    own = int(np.searchsorted(STARTS, n, "right")) - 1
    return [own, own - 1] if own and 100 * (int(STARTS[own]) - 1) >= SIMILAR * n else [own]


def choices(band: int) -> list[int]:
    """Numbers of segments that are weighed for the band."""
    whole = most_differences(band) + 1
    return sorted({whole, -(-2 * whole // 3), -(-whole // 2)}, reverse=True)


def plain(band: int) -> Plan:
    return most_differences(band) + 1, frozenset()


def shingle_set(hashes: WordHashes, text: str | None) -> np.ndarray:
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
                whole = mixed(np.array([whole * np.uint64(_W[0]) + x], np.uint64))[0]
            return np.array([whole], np.uint64)
        m = n - SHINGLE + 1
        return np.unique(mixed(h[:m] * np.uint64(_W[0]) + h[1 : m + 1] * np.uint64(_W[1]) + h[2:] * np.uint64(_W[2])))


def subsets(s: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(segment of each shingle, value of each shingle, sum of the values in each segment): a subset is known by its sum."""
    segment = ((s >> np.uint64(9)) % np.uint64(m)).astype(np.int64)
    value = mixed(s ^ np.uint64(_W[1]))
    total = np.zeros(m, np.uint64)
    np.add.at(total, segment, value)
    return segment, value, total


def key_of(held: np.ndarray, segment: np.ndarray, band: np.ndarray) -> np.ndarray:
    return mixed(held * np.uint64(_W[0]) + mixed((segment + (band.astype(np.int64) << 40)).astype(np.uint64) * np.uint64(_W[2]))).view(np.int64)


def keys_of(s: np.ndarray, band: int, plan: Plan) -> tuple[np.ndarray, np.ndarray]:
    """(key, segment) of the set in the band: each segment's subset, and the subsets with one deletion where the value is 2."""
    m, raised = plan
    with np.errstate(over="ignore"):
        segment, value, total = subsets(s, m)
        at, held = np.arange(m), total
        if raised:
            gone = np.flatnonzero(np.isin(segment, np.array(sorted(raised))))
            at, held = np.concatenate([at, segment[gone]]), np.concatenate([total, total[segment[gone]] - value[gone]])
        return key_of(held, at, np.full(len(at), band)), at


def segmented(sets: list[np.ndarray], ms: list[int]) -> tuple[np.ndarray, ...]:
    """``subsets`` of several sets at once: (entry, segment, value, slot) of each shingle, (entry, segment, total) of each slot."""
    sizes, m = np.array([len(s) for s in sets]), np.array(ms)
    flat, entry = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    segment = ((flat >> np.uint64(9)) % m.astype(np.uint64)[entry]).astype(np.int64)
    value, base = mixed(flat ^ np.uint64(_W[1])), np.cumsum(m) - m
    slot, total = base[entry] + segment, np.zeros(int(m.sum()), np.uint64)
    np.add.at(total, slot, value)
    of = np.repeat(np.arange(len(sets)), m)
    return entry, segment, value, slot, of, np.arange(len(total)) - base[of], total


def some_sets(sets: list[np.ndarray]) -> Iterator[list[tuple[int, int]]]:
    """(number of the set, band) for all bands of the sets, about TOGETHER shingles at a time."""
    held, size = [], 0
    for k, s in enumerate(sets):
        for band in bands_of(len(s)):
            held.append((k, band))
            size += len(s)
        if size >= TOGETHER:
            yield held
            held, size = [], 0
    if held:
        yield held


def lists(docs: list[np.ndarray], columns: list[list[np.ndarray]], n: int) -> tuple[pa.Array, list[np.ndarray]]:
    """(offsets of n lists, values of each column in the lists' order) from parts: the number of each value's list, and the values."""
    doc = np.concatenate(docs) if docs else np.zeros(0, np.int64)
    order = np.argsort(doc, kind="stable")
    offsets = np.searchsorted(doc[order], np.arange(n + 1)).astype(np.int32)
    return pa.array(offsets, pa.int32()), [np.concatenate(c)[order] if c else np.zeros(0, np.int64) for c in columns]


def weighed_keys(sets: list[np.ndarray]) -> pa.Array:
    """For each set the sampled keys of all choices of its bands."""
    docs, columns = [], [[] for _ in range(5)]
    with np.errstate(over="ignore"):
        for some in some_sets(sets):
            some = [(k, band) for k, band in some if most_differences(band) <= WEIGHED]
            for choice in range(3):
                use = [(k, band, choices(band)[choice]) for k, band in some if choice < len(choices(band))]
                if not use:
                    continue
                number, band, m = (np.array(c) for c in zip(*use))
                h = np.array([most_differences(b) for b in band])
                entry, segment, value, slot, of, at, total = segmented([sets[k] for k in number], m.tolist())
                for deleted, where, place, held in ((False, of, at, total), (True, entry, segment, total[slot] - value)):
                    hit = np.flatnonzero((mixed(held + place.astype(np.uint64)) % np.uint64(SAMPLE) == 0) & ((m <= h)[where] if deleted else True))
                    docs.append(number[where[hit]])
                    for c, v in zip(columns, (band[where[hit]], m[where[hit]], place[hit], held[hit].view(np.int64), np.full(len(hit), deleted))):
                        c.append(v)
    offsets, values = lists(docs, columns, len(sets))
    kinds = [("band", pa.int32()), ("m", pa.int32()), ("segment", pa.int32()), ("subset", pa.int64()), ("deleted", pa.bool_())]
    fields = [pa.array(v.astype(bool) if k == "deleted" else v, t) for v, (k, t) in zip(values, kinds)]
    return pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(fields, [k for k, _ in kinds]))


def all_keys(sets: list[np.ndarray], plans: dict[int, Plan]) -> pa.Array:
    """For each set its index keys, those of ``keys_of`` in its bands."""
    docs, keys = [], []
    with np.errstate(over="ignore"):
        for some in some_sets(sets):
            number, band = (np.array(c) for c in zip(*some))
            used = [plans.get(b) or plain(b) for b in band.tolist()]
            entry, segment, value, slot, of, at, total = segmented([sets[k] for k in number], [m for m, _ in used])
            parts = [(of, at, total)]
            if any(more for _, more in used):
                raised = np.zeros(len(total), bool)
                starts = np.cumsum([0, *(m for m, _ in used)])
                raised[[int(starts[e]) + k for e, (_, more) in enumerate(used) for k in more]] = True
                gone = np.flatnonzero(raised[slot])
                parts.append((entry[gone], segment[gone], total[slot[gone]] - value[gone]))
            for where, place, held in parts:
                docs.append(number[where])
                keys.append(key_of(held, place, band[where]))
    offsets, (values,) = lists(docs, [keys], len(sets))
    return pa.ListArray.from_arrays(offsets, pa.array(values, pa.int64()))


def some_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield from (batch.slice(at, DOCUMENTS) for at in range(0, batch.num_rows, DOCUMENTS))


def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import hashlib

    hashes = WordHashes()
    for batch in some_rows(batches):
        sets = [shingle_set(hashes, t.as_py()) for t in batch.column(1)]
        digests = pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, sets), pa.int64()), digests, weighed_keys(sets)], ["doc_id", "n_shingles", "digest", "weighed"])


def allocated(costs: list[tuple[int, int, int, int, int, int, int]]) -> dict[int, Plan]:
    """The cheapest plan of each band, from rows (band, m, segment, rows and pairs at value 1, rows and pairs at value 2)."""
    by_choice: dict[tuple[int, int], dict[int, tuple[float, float]]] = {}
    for band, m, segment, rows, pairs, rows_2, pairs_2 in costs:
        each = int(STARTS[band]) / PAIR
        by_choice.setdefault((band, m), {})[segment] = rows + each * pairs, rows_2 + each * pairs_2
    best: dict[int, tuple[float, Plan]] = {}
    for (band, m), of in sorted(by_choice.items()):
        more = sorted(range(m), key=lambda k: (of.get(k, (0, 0))[1] - of.get(k, (0, 0))[0], k))[: most_differences(band) + 1 - m]
        cost = sum(c for c, _ in of.values()) + sum(of[k][1] - of[k][0] for k in more if k in of)
        if band not in best or (cost, -m) < (best[band][0], -best[band][1][0]):
            best[band] = cost, (m, frozenset(more))
    return {band: plan for band, (_, plan) in best.items()}


def measured(classes: DataFrame) -> dict[int, Plan]:
    """Plans from the sampled keys (weighed) of one document of each class; bands and segments bound what is collected."""
    keys = classes.select(F.explode("weighed").alias("k")).select("k.*").groupBy("band", "m", "segment", "subset").agg(F.count_if(~F.col("deleted")).alias("own"), F.count(F.lit(1)).alias("both"))
    pairs = {f"pairs_{c}": F.sum(F.col(c) * (F.col(c) - 1) / 2) for c in ("own", "both")}
    found = keys.groupBy("band", "m", "segment").agg(F.sum("own").alias("rows"), pairs["pairs_own"].alias("pairs"), F.sum("both").alias("rows_2"), pairs["pairs_both"].alias("pairs_2"))
    return allocated([tuple(r) for r in found.collect()])


def index_rows(docs: DataFrame, plans: dict[int, Plan]) -> DataFrame:
    """(key, id, n) of the index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in some_rows(batches):
            sets = [shingle_set(hashes, t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, sets), pa.int64()), all_keys(sets, plans)], ["id", "n", "keys"])

    packed = stash(docs.select("doc_id", "text").mapInArrow(run, "id bigint, n bigint, keys array<bigint>"))
    return packed.select(F.explode("keys").alias("key"), "id", "n")


def where_is(key: int, s: np.ndarray, plans: dict[int, Plan]) -> tuple[Plan, int]:
    """The plan and the segment of one of the set's keys."""
    for band in bands_of(len(s)):
        plan = plans.get(band) or plain(band)
        keys, at = keys_of(s, band, plan)
        hit = np.flatnonzero(keys == key)
        if len(hit):
            return plan, int(at[hit[0]])
    raise ValueError("the set has no such key")


def signature(s: np.ndarray) -> np.ndarray:
    """How many shingles fall on each bit, even or odd; a power of two of bits, four for each shingle and 64 at least."""
    bits = max(64, 1 << (4 * len(s)).bit_length())
    return np.packbits(np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits).astype(np.uint8) & 1)


def least_differences(x: np.ndarray, y: np.ndarray) -> int:
    """Shingles that two sets of these signatures differ in at least: a bit that differs takes one. The longer one is folded to the other's length."""
    if len(x) < len(y):
        x, y = y, x
    return int(np.bitwise_count(np.bitwise_xor.reduce(x.reshape(-1, len(y))) ^ y).sum())


def full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    for batch in some_rows(batches):
        sets = [shingle_set(hashes, t.as_py()) for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, sets), pa.int64()), pa.array([signature(s).tobytes() for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], ["id", "n", "sign", "set"])


def sets_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, n, sign, set) of the documents in ``wanted`` (doc_id), the largest set where a doc_id repeats."""
    wanted = stash(wanted)
    few = likely_in(docs.select("doc_id", "text"), wanted)  # so that the join moves few texts that it drops
    sets = stash(few.join(wanted, "doc_id", "left_semi").mapInArrow(full_sets, "id bigint, n bigint, sign binary, set binary"))
    return sets.groupBy("id").agg(F.max_by(F.struct("n", "sign", "set"), F.struct("n", "set")).alias("s")).select("id", "s.*") if has_repeats(sets) else sets


def only(sets: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, set) of those in ``wanted`` (doc_id) and few others."""
    return likely_in(sets.select(F.col("id").alias("doc_id"), "set"), wanted).withColumnRenamed("doc_id", "id")


def possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs (a, b) of (a, b, n_a, n_b, sign_a, sign_b) whose signatures may belong to linked sets."""
    for batch in batches:
        size = batch.column(2).to_numpy() + batch.column(3).to_numpy()
        apart = [least_differences(*(np.frombuffer(x.as_buffer(), np.uint8) for x in both)) for both in zip(batch.column(4), batch.column(5))]
        yield batch.select(["a", "b"]).filter(pa.array(PER_DIFFERENCE * np.array(apart, np.int64) <= size))


def linked(s: np.ndarray, t: np.ndarray) -> bool:
    both = len(np.intersect1d(s, t, assume_unique=True))
    return 100 * both >= SIMILAR * (len(s) + len(t) - both)


def star_links(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets are linked: signatures meet first; of the pairs that they leave, a centre's set goes once to each STAR of its
    members, which follow it in a task."""
    sets = sets_of(docs, pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct())
    for c in ("a", "b"):
        pairs = pairs.join(sets.select(F.col("id").alias(c), F.col("n").alias(f"n_{c}"), F.col("sign").alias(f"sign_{c}")), c)
    pairs = stash(pairs.select("a", "b", "n_a", "n_b", "sign_a", "sign_b").mapInArrow(possible, "a bigint, b bigint"))
    sets = only(sets, pairs.select(F.explode(F.array("a", "b")).alias("doc_id")))
    groups = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / STAR).cast("int").alias("groups"))
    centres = groups.join(sets.withColumnRenamed("id", "a"), "a").select("a", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("g"), F.lit(None).cast("bigint").alias("b"), "set")
    members = pairs.join(groups, "a").select("a", F.pmod(F.xxhash64("b"), "groups").cast("int").alias("g"), "b")
    members = members.join(sets.withColumnRenamed("id", "b"), "b").select("a", "g", "b", "set")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre = np.zeros(0, np.uint64)
        for batch in batches:
            keep = []
            for b, x in zip(batch.column(2).to_pylist(), batch.column(3)):
                s = np.frombuffer(x.as_buffer(), np.uint64)
                if b is None:
                    centre = s.copy()
                keep.append(b is not None and linked(centre, s))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return centres.union(members).repartition("a", "g").sortWithinPartitions("a", "g", F.col("b").asc_nulls_first()).mapInArrow(run, "a bigint, b bigint")


def labelled(members: DataFrame, whole: DataFrame) -> DataFrame:
    """Members (key, id, n) with the component of ``whole`` (node, component), their own id where they have none."""
    return members.join(whole.withColumnRenamed("node", "id"), "id", "left").select("key", "id", "n", F.coalesce("component", "id").alias("component"))


def pairs_of_few(members: DataFrame) -> DataFrame:
    """Distinct pairs (a, b) across components of buckets of up to FEW members, of sizes that may be linked."""
    held = members.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("id", "n", "component"))).alias("m")).where("exists(m, x -> x.component <> m[0].component)")
    both = F.expr(f"filter(flatten(transform(m, x -> transform(m, y -> struct(x AS x, y AS y)))), p -> p.x.id < p.y.id AND p.x.component <> p.y.component AND 100 * least(p.x.n, p.y.n) >= {SIMILAR} * greatest(p.x.n, p.y.n))")
    return held.select(F.explode(both).alias("p")).select(F.col("p.x.id").alias("a"), F.col("p.y.id").alias("b")).distinct()


def component_pairs(links: DataFrame, whole: DataFrame) -> DataFrame:
    """The components (a, b) of the ends of links."""
    for c in ("a", "b"):
        links = links.join(whole.select(F.col("node").alias(c), "component"), c, "left").withColumn(c, F.coalesce("component", c)).drop("component")
    return links.select("a", "b").distinct()


def relabelled(whole: DataFrame, joined: DataFrame) -> DataFrame:
    """``whole`` (node, component) after links (a, b) between components; labels without a node of ``whole`` are nodes of their own."""
    merged = components(joined).select(F.col("node").alias("component"), F.col("component").alias("joined"))
    moved = whole.join(merged, "component", "left").select("node", F.coalesce("joined", "component").alias("component"))
    return moved.union(merged.join(whole.select(F.col("node").alias("component")), "component", "left_anti").select(F.col("component").alias("node"), F.col("joined").alias("component")))


def partners(rows: pa.Table, a: int) -> np.ndarray:
    """The members of a pair of blocks that its member a is compared with, those of sizes that may be linked; two minor members are compared once, by the smaller id."""
    ids, n, part, asked, minor = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("id", "n", "component", "asked", "minor"))
    far = np.flatnonzero(asked & (part != part[a]) & (~minor | (ids > ids[a])))
    return far[100 * np.minimum(n[far], n[a]) >= SIMILAR * np.maximum(n[far], n[a])]


def possible_members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of members whose signature leaves a partner in their group, or that are one."""
    for rows in groups_of(batches):
        n, asks = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("n", "asks"))
        signs = [np.frombuffer(x.as_buffer(), np.uint8) for x in rows.column("sign")]
        used = np.zeros(rows.num_rows, bool)
        for a in np.flatnonzero(asks).tolist():
            far = partners(rows, a)
            # signatures of one length are compared together
            for length in {len(signs[b]) for b in far}:
                own = far[[len(signs[b]) == length for b in far]]
                short = min(length, len(signs[a]))
                mine = np.bitwise_xor.reduce(signs[a].reshape(-1, short))
                theirs = np.bitwise_xor.reduce(np.stack([signs[b] for b in own]).reshape(len(own), -1, short), axis=1)
                near = own[PER_DIFFERENCE * np.bitwise_count(theirs ^ mine).sum(axis=1, dtype=np.int64) <= n[a] + n[own]]
                used[near] = True
                used[a] |= len(near) > 0
        if used.any():
            yield from rows.drop_columns(["sign"]).filter(pa.array(used)).to_batches()


def open_links(docs: DataFrame, members: DataFrame, plans: dict[int, Plan]) -> DataFrame:
    """(a, b): components of the members (key, id, n, component) of buckets of more than FEW that a link inside a bucket joins."""
    columns, place = ("key", "i", "j", "asks", "asked", "id", "n", "component", "minor"), ("key", "i", "j")
    rows = stash(blocks_of(members.withColumn("band", F.lit(0))).select(*columns))
    sets = sets_of(docs, rows.select(F.col("id").alias("doc_id")).distinct())
    kinds = ", ".join(f"{c} {dict(rows.dtypes)[c]}" for c in columns)
    rows = stash(rows.join(sets.select("id", "sign"), "id").select(*columns, "sign").repartition(*place).sortWithinPartitions(*place, "id").mapInArrow(possible_members, kinds))
    sets = only(sets, rows.select(F.col("id").alias("doc_id")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        above: dict[int, int] = {}

        def root(x: int) -> int:
            while (up := above.get(x, x)) != x:
                above[x] = above.get(up, up)
                x = up
            return x

        for table in groups_of(batches):
            found = []
            n, part, asks = (table.column(c).to_numpy(zero_copy_only=False) for c in ("n", "component", "asks"))
            sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("set")]
            plan, segment = where_is(int(table.column("key")[0].as_py()), sets[0], plans)
            with np.errstate(over="ignore"):
                earlier = np.stack([subsets(s, plan[0])[2][:segment] for s in sets])
            _, local = np.unique(np.concatenate(sets), return_inverse=True)
            local = np.split(local.astype(np.int32), np.cumsum(n)[:-1])
            flag = np.zeros(max(int(x.max()) for x in local) + 1, bool)
            for a in np.flatnonzero(asks).tolist():
                far = partners(table, a)
                far = far[~(earlier[far] == earlier[a]).any(axis=1)]
                flag[local[a]] = True
                step = 4
                while len(far):
                    own = root(int(part[a]))
                    far = far[[root(int(p)) != own for p in part[far]]]
                    some, far, step = far[:step], far[step:], 4 * step
                    if not len(some):
                        break
                    both = np.add.reduceat(flag[np.concatenate([local[b] for b in some])].astype(np.int32), np.cumsum(n[some]) - n[some])
                    for b in some[100 * both >= SIMILAR * (n[a] + n[some] - both)].tolist():
                        p, q = root(int(part[a])), root(int(part[b]))
                        if p != q:
                            above[max(p, q)] = min(p, q)
                            found.append((p, q))
                flag[local[a]] = False
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], ["a", "b"])

    return rows.join(sets, "id").select(*columns, "set").repartition(*place).sortWithinPartitions(*place, "id").mapInArrow(run, "a bigint, b bigint")


def join_groups(docs: DataFrame, plans: dict[int, Plan] | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id of every document. ``plans``: allocation by band instead of the measured one."""
    docs = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    weighed = "array<struct<band: int, m: int, segment: int, subset: bigint, deleted: boolean>>"
    marks = stash(docs.mapInArrow(marked, f"doc_id bigint, n_shingles bigint, digest binary, weighed {weighed}"))
    if has_repeats(marks.withColumnRenamed("doc_id", "id")):
        marks = stash(marks.groupBy("doc_id").agg(F.max_by(F.struct("n_shingles", "digest", "weighed"), F.struct("n_shingles", "digest")).alias("m")).select("doc_id", "m.*"))
    classes = stash(marks.where("n_shingles > 0").groupBy("digest").agg(F.min("doc_id").alias("id"), F.first("n_shingles").alias("n_shingles"), F.min_by("weighed", "doc_id").alias("weighed")))
    plans = measured(classes) if plans is None else plans
    of_class = stash(marks.where("n_shingles > 0").select("doc_id", "digest", "n_shingles").join(classes.select("digest", "id"), "digest").select("doc_id", "n_shingles", "id"))
    index = index_rows(without(docs, of_class.where("doc_id <> id").select("doc_id")), plans)  # one document of each class
    shared = stash(index.groupBy("key").agg(F.min("id").alias("centre"), F.count(F.lit(1)).alias("size")).where("size > 1"))
    likely = likely_in(index.select(F.col("key").alias("doc_id"), "id", "n"), shared.select(F.col("key").alias("doc_id"))).withColumnRenamed("doc_id", "key")
    members = stash(likely.join(shared, "key").select("key", "id", "n", "centre", "size"))
    size = classes.select(F.col("id").alias("centre"), F.col("n_shingles").alias("n_centre"))
    fits = 100 * F.least("n", "n_centre") >= SIMILAR * F.greatest("n", "n_centre")
    pairs = members.where("id <> centre").groupBy("centre", "id").agg(F.max("n").alias("n")).join(size, "centre").where(fits)
    links = stash(star_links(docs, stash(pairs.select(F.col("centre").alias("a"), F.col("id").alias("b")))))  # components read them twice
    whole = stash(components(links))
    # a bucket of two has been compared
    few, larger = (members.where(some).select("key", "id", "n") for some in (f"size BETWEEN 3 AND {FEW}", f"size > {FEW}"))
    whole = stash(relabelled(whole, stash(component_pairs(star_links(docs, stash(pairs_of_few(labelled(few, whole)))), whole))))
    whole = stash(relabelled(whole, stash(open_links(docs, stash(labelled(larger, whole)), plans))))
    filled = of_class.join(whole.withColumnRenamed("node", "id"), "id", "left").select("doc_id", "n_shingles", F.coalesce("component", "id").alias("component_id"))
    return filled.union(marks.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
