"""Runs against every lag of every text, and the query against its contract written out plainly."""

import hashlib
import random
import re
import zlib

from lesionflow.llm import catalog, runs


def every_run(ws):
    """(start, length, period) of all runs, lag by lag."""
    found = {}
    for q in range(1, len(ws) // 2 + 1):
        i = 0
        while i < len(ws) - q:
            j = i
            while j < len(ws) - q and ws[j] == ws[j + q]:
                j += 1
            if j + q - i >= max(12, 2 * q):
                found.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted(((s, e - s, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))


def kept_words(ws, found):
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    return [w for i, w in enumerate(ws) if i not in gone]


def odd_words(rnd):
    n, kind = rnd.randrange(400), rnd.randrange(7)
    if kind == 0:
        return [rnd.choice("ab") for _ in range(n)]
    if kind == 1:
        return [str(rnd.randrange(200)) for _ in range(n)]
    if kind == 2:
        base = [rnd.choice("abc") for _ in range(rnd.randrange(1, 150))]
        return [base[i % len(base)] for i in range(n)]
    if kind == 3:
        x, y = ["a"], ["a", "b"]
        while len(y) < n + 1:
            x, y = y, y + x
        return y[:n]
    if kind == 4:  # runs of one short period that touch, and copies of them
        out = []
        while len(out) < n:
            out += ["ab"[rnd.randrange(2)]] * rnd.randrange(1, 60) if rnd.random() < 0.5 else ["a", "b"] * rnd.randrange(1, 60)
            if rnd.random() < 0.5:
                out += out[-rnd.randrange(1, len(out) + 1) :]
        return out
    if kind == 5:
        return (["a", "b"] * rnd.randrange(1, 80) + ["a"]) * 2 + [rnd.choice("abc") for _ in range(rnd.randrange(9))]
    out = []
    while len(out) < n:
        out += [rnd.choice("abc") for _ in range(rnd.randrange(1, 70))] * rnd.randrange(1, 4)
    return out


def test_all_runs_of_structured_texts():
    rnd = random.Random(7)
    for _ in range(25):
        docs = [odd_words(rnd) for _ in range(12)]
        for ws, (n, found, text) in zip(docs, runs.searched([[w.encode() for w in d] for d in docs])):
            want = every_run(ws)
            assert n == len(ws) and found == want, ws
            assert text.decode() == " ".join(kept_words(ws, want))


def test_scales_of_long_periods():
    rnd = random.Random(3)
    for p in (31, 32, 63, 64, 65, 700, 2048, 3000):
        base = [str(rnd.randrange(10**6)) for _ in range(p)]
        ws = ["x", "y"] + base + base + base[: p // 3] + ["z"]
        (_, found, _), = runs.searched([[w.encode() for w in ws]])
        assert found == [(2, 2 * p + p // 3, p)]


def test_rows_odd(spark):
    rows = [(1, None, 7), (1, "", 7), (None, "a " * 30, 7), (2, "\t\n ", 7), (2, "a\x0bb c " * 20, 7), (3, "one " * 100_000, 7), (4, "Ab ab " * 6, 7)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n_words int")
    found = sorted(runs.find_runs(docs).collect(), key=lambda r: (r["doc_id"] or 0, r["n_words"]))
    assert [(r["doc_id"], r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in found] == [
        (None, 30, [(0, 30, 1)], "a"), (1, 0, [], ""), (1, 0, [], ""), (2, 0, [], ""), (2, 40, [(0, 40, 2)], "a b c"),
        (3, 100_000, [(0, 100_000, 1)], "one"), (4, 12, [(0, 12, 2)], "Ab ab"),
    ]
    assert runs.find_runs(docs.limit(0)).count() == 0


def test_query_keeps_its_contract(spark, sf_dir):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    got = {r["doc_id"]: r for r in catalog.QUERIES["op11_runs"](spark, sf_dir).collect()}
    assert got.keys() == docs.keys()
    some = 0
    for doc_id, text in docs.items():
        ws = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        h, n = zlib.crc32(str(doc_id).encode()), len(ws)
        if n > 6000 and doc_id % 5:
            continue  # plain lags take n * n steps
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            ws = ws[:a] + [ws[a + (i - a) % p] for i in range(a, n)]
        want = every_run(ws)
        best = min(want, key=lambda r: (-r[1], r[0], r[2]), default=None)
        row = got[doc_id]
        assert row["n_runs"] == len(want)
        assert (row["start"], row["length"], row["period"]) == (best or (None,) * 3)
        assert row["exponent_milli"] == (1000 * best[1] // best[2] if best else None)
        assert row["runs_sha256"] == hashlib.sha256("".join("%d,%d,%d\n" % r for r in want).encode()).hexdigest()
        assert row["collapsed_sha256"] == hashlib.sha256(" ".join(kept_words(ws, want)).encode()).hexdigest()
        some += bool(want)
    assert some > 5
