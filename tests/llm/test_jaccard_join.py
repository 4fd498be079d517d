"""The join against all pairs of documents."""

import random

import numpy as np
import pyarrow as pa
import pytest
from lesionflow.llm import catalog, jaccard_join
from lesionflow.llm.text import words


def every_component(docs):
    """{doc_id: (size, component)} from all pairs."""
    sets = {}
    for doc_id, text in docs:
        ws = words(text)
        own = {tuple(ws[i : i + 3]) for i in range(len(ws) - 2)} if len(ws) >= 3 else ({tuple(ws)} if ws else set())
        sets[doc_id] = max(sets.get(doc_id, set()), own, key=len)
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            small, large = sorted((len(sets[a]), len(sets[b])))
            if small and 100 * small >= 90 * large:
                both = len(sets[a] & sets[b])
                if 100 * both >= 90 * (len(sets[a]) + len(sets[b]) - both):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    return {d: (len(s), find(d)) for d, s in sets.items()}


def edited(rnd, ws, edits):
    ws = list(ws)
    for _ in range(edits):
        at, kind = rnd.randrange(len(ws)), rnd.randrange(3)
        ws[at : at + (kind != 1)] = [] if kind == 0 else [f"e{rnd.randrange(10**6)}"]
    return ws


def groups_of_copies(seed, groups, most):
    rnd = random.Random(seed)
    docs = []
    for _ in range(groups):
        base = [f"w{rnd.randrange(5000)}" for _ in range(rnd.choice([9, 11, 12, 15, 20, 24, 40, 60, 150, 400]))]
        docs += [edited(rnd, base, rnd.choice([0, 1, 1, 2, 3, len(base) // 60, len(base) // 40])) for _ in range(rnd.randrange(1, most))]
    rnd.shuffle(docs)
    return [(k * 3 + 1, " ".join(d)) for k, d in enumerate(docs)]


def raised(band):
    """As many segments of value 2 as can be."""
    whole = jaccard_join.most_differences(band) + 1
    m = -(-whole // 2)
    return m, frozenset(range(whole - m))


@pytest.mark.parametrize("plans", [None, {}, {b: raised(b) for b in range(40)}])
def test_components_of_all_pairs(spark, plans):
    docs = groups_of_copies(5, 60, 12)
    want = every_component(docs)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.join_groups(spark.createDataFrame(docs, "doc_id bigint, text string"), plans).collect()}
    assert got == want
    assert len({c for _, c in want.values()}) < len(docs) - 40


def test_linked_pairs_share_a_key():
    """Each plan finds pairs at exactly the limit, of all small sizes and of larger ones."""
    import numpy as np

    rng = np.random.default_rng(2)
    for a in [*range(9, 120), 300, 555]:
        for b in {a, a + 1, a * 100 // 90} if 100 * a >= 90 * (a + 1) else {a}:
            both = -(-9 * (a + b) // 19)
            if both > a or 100 * both < 90 * (a + b - both):
                continue
            pool = rng.integers(1, 2**63, a + b - both, np.uint64)
            s, t = np.sort(pool[:a]), np.sort(np.concatenate([pool[:both], pool[a:]]))
            common = [x for x in jaccard_join.bands_of(a) if x in jaccard_join.bands_of(b)]
            assert common
            for plan in (jaccard_join.plain, raised):
                assert any(np.intersect1d(jaccard_join.keys_of(s, x, plan(x))[0], jaccard_join.keys_of(t, x, plan(x))[0]).size for x in common), (a, b, plan)


def test_keys_of_many_sets_at_once():
    import numpy as np

    rng = np.random.default_rng(3)
    sets = [np.sort(rng.integers(0, 2**63, n).astype(np.uint64)) for n in (0, 1, 8, 9, 30, 90, 400, 0, 33)]
    for plans in ({}, {b: raised(b) for b in range(40)}):
        many = jaccard_join.all_keys(sets, plans).to_pylist()
        for s, keys in zip(sets, many):
            own = [k for b in jaccard_join.bands_of(len(s)) for k in jaccard_join.keys_of(s, b, plans.get(b) or jaccard_join.plain(b))[0].tolist()]
            assert sorted(keys) == sorted(own)
            if keys:
                plan, segment = jaccard_join.where_is(keys[-1], s, plans)
                assert segment < plan[0]
    found = jaccard_join.weighed_keys(sets).to_pylist()
    assert len(found) == len(sets) and not found[0] and not found[2] and all(k["band"] in jaccard_join.bands_of(len(s)) for s, x in zip(sets, found) for k in x)


def test_large_buckets(spark, monkeypatch):
    """Buckets of every size go through blocks, and through pairs."""
    docs = groups_of_copies(11, 25, 40)
    want = every_component(docs)
    for few in (2, 1000):
        monkeypatch.setattr(jaccard_join, "FEW", few)
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.join_groups(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
        assert got == want


def test_allocation_takes_the_cheapest():
    band = 6
    whole = jaccard_join.most_differences(band) + 1
    half = -(-whole // 2)
    dear = [(band, whole, k, 10, 10**6, 10, 10**6) for k in range(whole)]
    cheap = [(band, half, k, 10, 0, 10 if k else 10**5, 0) for k in range(half)]
    m, two = jaccard_join.allocated(dear + cheap)[band]
    assert m == half and len(two) == whole - half and (0 not in two or whole - half == half)
    assert jaccard_join.allocated([(band, whole, 0, 1, 0, 1, 0)] + [(band, half, k, 9, 9, 9, 9) for k in range(half)])[band] == (whole, frozenset())


def test_rows_odd(spark):
    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [(5, None), (6, ""), (7, " \t\n"), (8, "A b"), (9, "a B "), (10, "a"), (None, "a b"), (11, "one two three four"), (11, "x"), (12, "ONE two\x0bthree four"), (3, long), (2, long + " more"), (4, "b a")]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id bigint, text string, key int, n int")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.join_groups(docs).collect()}
    assert got == {5: (0, 5), 6: (0, 6), 7: (0, 7), 8: (1, 8), 9: (1, 8), 10: (1, 10), 11: (2, 11), 12: (2, 11), 3: (29998, 2), 2: (29999, 2), 4: (1, 4)}
    assert jaccard_join.join_groups(docs.limit(0)).count() == 0


def test_query_keeps_its_contract(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in catalog.QUERIES["op13_jaccard_join"](spark, sf_dir).collect()}
    assert got == every_component(docs)


def test_signatures_leave_every_linked_pair_and_few_others():
    rng = np.random.default_rng(21)
    rows, links = [], 0
    for n in [9, 10, 16, 17, 40, 100, 300, 1000, 5000] * 12:
        s = rng.integers(0, 1 << 63, n).astype(np.uint64)
        k = int(rng.integers(0, 1 + n // 3))
        t = np.concatenate([s[k // 2 :], rng.integers(0, 1 << 63, k - k // 2).astype(np.uint64)])
        x, y = jaccard_join.signature(s), jaccard_join.signature(t)
        apart = len(np.setxor1d(s, t))
        assert jaccard_join.least_differences(x, y) == jaccard_join.least_differences(y, x) <= apart
        assert jaccard_join.linked(np.sort(s), np.sort(t)) == (19 * apart <= len(s) + len(t))
        links += 19 * apart <= len(s) + len(t)
        rows.append((len(rows), -1, len(s), len(t), x.tobytes(), y.tobytes(), 19 * apart <= len(s) + len(t)))
    names = ["a", "b", "n_a", "n_b", "sign_a", "sign_b"]
    batch = pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows])
    left = {r["a"] for b in jaccard_join.possible(iter([batch])) for r in b.to_pylist()}
    assert {r[0] for r in rows if r[-1]} <= left and links > 20 and len(left) < links + 20


def test_sets_move_for_possible_pairs_only_and_the_index_has_one_document_of_each_class(spark, monkeypatch):
    moved, indexed = [], []
    only, index = jaccard_join.only, jaccard_join.index_rows
    monkeypatch.setattr(jaccard_join, "only", lambda sets, wanted: moved.append(wanted.distinct().count()) or only(sets, wanted))
    monkeypatch.setattr(jaccard_join, "index_rows", lambda docs, plans: indexed.append(docs.count()) or index(docs, plans))
    rng = np.random.default_rng(22)
    base = [f"w{i}" for i in range(300)]
    docs = [(0, " ".join(base))]
    for i in range(1, 25):  # every other one shares most of the text and is no link
        ws = list(base)
        for at in rng.choice(300, 2 if i % 2 else 14, replace=False):
            ws[at] = f"x{i}_{at}"
        docs.append((i, " ".join(ws)))
    docs += [(100 + i, t) for i, t in docs]  # copies
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.join_groups(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    assert got == {i: 0 if i % 100 == 0 or i % 100 % 2 else i % 100 for i, _ in docs}
    assert indexed == [25] and max(moved) <= 13
