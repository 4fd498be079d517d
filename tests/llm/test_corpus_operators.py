"""The corpus operators against brute-force versions, round trips and held-out figures."""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from lesionflow.llm import bpe, catalog, chat, decontam, exact_dedup, neardup, ppm, sharding, surrogates, toxicity, url_reputation
from lesionflow.llm.text import words

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, digest string, bucket int, key string"


def docs_of(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x", 1, "k") for i, t in texts], DOCS)


ODD = [(1, None), (2, ""), (3, "  \n"), (4, "a"), (5, "long " * 20000), (6, "same text here and more of it"), (7, "same  text\there and more of it"), (7, "same  text\there and more of it"), (None, "an id is missing here, is it not")]


@pytest.fixture(scope="module")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def test_bpe_equals_the_tiktoken_library(spark, documents):
    import public_tokenizers as P
    import tiktoken

    ranks = bpe.read_ranks(P.path("byte_bpe_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    more = [(-1, None), (-2, ""), (-3, " \x1c a\x85 b \n c  d\t e"), (-4, "aaaa" * 3000), (-5, "I'll  don't 日本 <|endoftext|>"), (-6, " x"), (-7, "x ")]
    docs = documents.select("doc_id", "text").union(spark.createDataFrame(more, "doc_id bigint, text string"))
    texts = {r[0]: r[1] or "" for r in docs.collect()}
    for r in bpe.round_trip(docs, ranks, P.PATTERN).collect():
        ids = library.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
    back = bpe.decode(bpe.encode(docs, ranks, P.PATTERN), ranks)
    assert {r[0]: bytes(r[1]).decode() for r in back.collect()} == texts
    assert bpe.encode(docs.limit(0), ranks, P.PATTERN).count() == 0


def merged_one_by_one(word, ranks):
    parts = [bytes([b]) for b in word]
    while len(parts) > 1:
        best = min(((ranks.get(a + b, 10**9), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))))
        if best[0] == 10**9:
            break
        parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
    return [ranks[p] for p in parts]


def replayed(some, merges):
    counts, ids = bpe.replay(some, merges)
    ends = [0, *counts.cumsum().tolist()]
    return {w: ids[a:b].tolist() for w, a, b in zip(some, ends, ends[1:])}


def test_bpe_lower_rank_after_a_merge_waits():
    import random

    random.seed(5)
    ranks = {bytes([b]): b + 1000 for b in range(256)} | {b"ab": 300, b"abc": 5, b"bc": 400}
    merges = bpe.Merges(ranks)
    for word in (b"abcabc", b"ababcab", b"bcabcbc"):
        assert replayed([word], merges)[word] == merged_one_by_one(word, ranks)
    assert replayed([b"bbbbb"], bpe.Merges({bytes([b]): b + 1000 for b in range(256)} | {b"bb": 77, b"bbb": 18}))[b"bbbbb"] == [18, 77]
    for _ in range(60):
        made = {bytes(random.choices(b"abc", k=random.randint(2, 5))) for _ in range(random.randint(2, 14))}
        ranks = {bytes([b]): b + 1000 for b in range(256)} | dict(zip(made, random.sample(range(900), len(made))))
        some = list({bytes(random.choices(b"abc", k=random.randint(1, 14))) for _ in range(120)})
        got = replayed(some, bpe.Merges(ranks))
        for word in some:
            assert got[word] == ([ranks[word]] if word in ranks else merged_one_by_one(word, ranks)), (word, made)


def test_url_rules_and_odd_urls(spark):
    rows = [(1, "https://A.example.NET/en/1?x"), (2, "http://b.net/x"), (3, "http://x.example.com/de/5#t"), (4, "ftp://q.org/fr/"), (5, None), (6, "no scheme"), (7, "http://host.org"), (8, "http://net?x"), (8, "http://net?x")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string")
    outcomes = spark.createDataFrame([(7, 1)] + [(9, 0)], "page_id bigint, bad int")
    got = sorted(url_reputation.judge_urls(pages, outcomes, catalog.URL_RULES).collect())
    by = {r.page_id: r for r in got}
    assert len(got) == len(rows)
    assert (by[1].host, by[1].path, by[1].rule, by[1].verdict) == ("a.example.net", "/en/1", "example.net/en/", "allow")
    assert (by[2].rule, by[2].verdict) == ("net/", "block")
    assert (by[3].rule, by[3].verdict) == ("example.com/de/", "block")
    assert by[4].rule == "org/fr/" and by[5].host == by[6].host == by[6].path == ""
    assert by[8].host == "net" and by[8].path == "" and by[8].rule is None
    assert url_reputation.judge_urls(pages.limit(0), outcomes, catalog.URL_RULES).count() == 0


def test_urls_with_further_columns_and_of_any_length(spark):
    long = "http://" + "a." * 30_000 + "co.uk/" + "p" * 100_000
    pages = spark.createDataFrame([(1, long, "x", "y"), (2, "http://www.shop.co.uk/", "x", "y"), (3, "http://shop.co.uk/", "x", "y")], "page_id bigint, url string, host string, domain string")
    got = {r.page_id: r for r in url_reputation.judge_urls(pages, spark.createDataFrame([(3, 1)], "page_id bigint, bad int"), catalog.URL_RULES).collect()}
    assert len(got[1].host) == 60_005 and len(got[1].path) == 100_001 and got[2].host == "www.shop.co.uk"
    named = spark.createDataFrame([(h,) for h in ("www.shop.co.uk", "shop.co.uk", "x.example.com", "com", "")], "h string")
    assert [tuple(r) for r in named.select(url_reputation.domain_of(F.col("h")), url_reputation.suffix_of(F.col("h"))).collect()] == [("shop.co.uk", "co.uk")] * 2 + [("example.com", "com"), ("com", "com"), ("", "")]


def test_reputation_shrinks_to_the_domain(spark):
    rows = [("a.bad.com", 1)] * 60 + [("b.bad.com", None)] + [("x.good.com", 0)] * 60 + [("y.good.com", 1)]
    got = {r.host: r for r in url_reputation.reputation(spark.createDataFrame(rows, "host string, bad int")).collect()}
    assert got["a.bad.com"].bad_lower > 0.6 > got["x.good.com"].mean
    assert got["b.bad.com"].mean > got["y.good.com"].mean or got["b.bad.com"].mean > 0.4
    assert all(r.bad_lower < r.mean for r in got.values())


def edit_distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_automaton_equals_edit_distance():
    import random

    random.seed(4)
    terms = {"idiot": 5.0, "worthless": 5.0, "moron": 5.0, "pathetic": 5.0}
    trie = toxicity.Trie(terms, {})
    for _ in range(4000):
        base = list(random.choice(list(terms)))
        for _ in range(random.randint(0, 3)):
            i = random.randrange(len(base) + 1)
            kind = random.randrange(3)
            base[i : i + (kind > 0)] = [random.choice("idotwrhlesmnpac")] if kind < 2 else []
        word = "".join(base)
        best = min(((edit_distance(word, t), t) for t in terms if edit_distance(word, t) <= min(toxicity.edits_for(len(word)), toxicity.edits_for(len(t)))), default=None)
        got = trie.find(word)
        assert (got is None) == (best is None), word
        if best:
            assert got[2] == best[0], word


def test_toxicity_learns_catches_misspellings_and_spares_quotation(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.learn(docs, labels)
    out = toxicity.score_toxicity(docs, model)
    rows = out.join(labels, "doc_id").where("held_out").collect()
    caught = sum(r.predicted for r in rows if r.toxic) / max(1, sum(r.toxic for r in rows))
    wrong = sum(r.predicted for r in rows if not r.toxic) / max(1, sum(1 - r.toxic for r in rows))
    assert caught > 0.6 and wrong < 0.05
    score = lambda t: model.score(toxicity.features(model.reader(), t))
    assert score("an idi0t and a worthlless thing") > score("a plain thing")
    assert score('he wrote "idiot" there') < score("that idiot there")
    assert all(0 <= r.score <= 1 for r in out.collect())
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in out.collect())
    odd = docs_of(spark, ODD)
    assert toxicity.score_toxicity(odd, model).count() == len(ODD)
    assert toxicity.drop_toxic(odd, model).columns == odd.columns
    assert toxicity.learn(docs.limit(0), labels).coefficients is None


def test_decontamination_equals_brute_force(spark, sf_dir, documents):
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    got = {(r.doc_id, r.item_id) for r in decontam.contaminated(documents, items).collect()}
    grams = lambda ws: {tuple(ws[i : i + 5]) for i in range(len(ws) - 4)}
    held = {r.item_id: grams(decontam.edges(words(r.text))) for r in items.collect()}
    want, never = set(), set()
    for r in documents.collect():
        own = grams(decontam.edges(words(r.text)))
        for item, g in held.items():
            share = len(own & g) / len(g)
            want |= {(r.doc_id, item)} if share == 1 else set()
            never |= {(r.doc_id, item)} if share < 0.3 else set()
    assert want and want <= got and not got & never
    kept = {r.doc_id for r in decontam.drop_contaminated(documents, items).collect()}
    assert kept == {r.doc_id for r in documents.collect()} - {d for d, _ in got}


def test_decontamination_scores_equal_brute_force(spark, sf_dir, documents):
    """Every window against every item by plain BM25; the pairs, their best scores and overlaps must be the same."""
    items = [r for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect() if words(r.text)]
    held = [(r.item_id, decontam.edges(words(r.text))) for r in items]
    df, mean = Counter(t for _, ws in held for t in set(ws)), sum(len(ws) for _, ws in held) / len(held)

    def impacts(ws):
        idf = lambda t: math.log(1 + (len(held) - df[t] + 0.5) / (df[t] + 0.5))
        out = {t: idf(t) * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * len(ws) / mean)) for t, n in Counter(ws).items()}
        return {t: x / sum(out.values()) for t, x in out.items()}

    def share(part, window):
        n = max(1, min(5, len(part) // 3))
        own = [part[i : i + n] for i in range(len(part) - n + 1)]
        there = {tuple(window[i : i + n]) for i in range(len(window) - n + 1)}
        return sum(tuple(g) in there for g in own) / len(own)

    indexed = [(item, ws, impacts(ws), max(16, 1 << (len(ws) - 1).bit_length())) for item, ws in held]
    want = {}
    for r in documents.collect():
        ws = decontam.edges(words(r.text))
        for length in {x[3] for x in indexed}:
            for at in range(0, max(1, len(ws) - length), length):
                window = ws[at : at + 2 * length]
                terms = set(window)
                for item, own, impact, of in indexed:
                    if of == length and (score := sum(x for t, x in impact.items() if t in terms)) >= 0.5:
                        cut = len(own) - max(1, len(own) // 4)
                        found = (round(score, 6), share(own[:cut], window), share(own[cut:], window))
                        if min(found[1:]) >= 0.5:
                            want[r.doc_id, item] = max(found, want.get((r.doc_id, item), found))
    docs, bench = documents.select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    got = {(r.doc_id, r.item_id): (round(r.score, 6), r.question_overlap, r.answer_overlap) for r in decontam.contaminated(docs, bench).collect()}
    assert got == want and want


def test_one_changed_word_does_not_hide_an_item(spark):
    said = "which of these many rivers flows through the old town of the northern plain and what is it called by those who live along its lower banks today".split()
    items = spark.createDataFrame([(1, " ".join(said)), (1, "an item with one more text is found by either of them as well"), *((i, f"filler item number {i} speaks of other things such as {i * 7} and {i * 11}") for i in range(2, 30))], "item_id bigint, text string")
    rows = [(i, "he asked " + " ".join([*said[:i], "zebra", *said[i + 1 :]]) + " and left") for i in range(len(said))]
    rows += [(100, "an item with one more text is found by either of them as well")]
    got = decontam.contaminated(spark.createDataFrame(rows, "doc_id bigint, text string"), items)
    assert {r.doc_id for r in got.where("item_id = 1").collect()} == {r[0] for r in rows}


def test_wand_retrieves_all_above_the_threshold():
    import random

    random.seed(1)
    items = [decontam.Item(i, [b"w%d" % min(random.randrange(60), random.randrange(60)) for _ in range(random.randint(1, 30))]) for i in range(150)]
    df = Counter(t for i in items for t in set(i.words))
    index = decontam.Index(items, df, len(items), 15.0)
    for _ in range(200):
        terms = list({b"w%d" % random.randrange(60) for _ in range(25)})
        scores = defaultdict(float)
        for t in terms:
            if t in index.postings:
                for number, x in zip(*index.postings[t][:2]):
                    scores[number] += x
        got = dict(index.search([t for t in terms if t in index.bound], 0.5, 0, len(items)))
        assert set(got) == {n for n, s in scores.items() if s >= 0.5}


def test_decontamination_odd_rows_and_shards(spark, monkeypatch):
    said = "one two three four five six seven eight nine ten eleven twelve"
    items = spark.createDataFrame([(1, said), (2, None), (3, ""), (4, "other words that nobody says at all here"), (5, "word")], "item_id bigint, text string")
    docs = docs_of(spark, [*ODD, (50, f"before {said.upper()}, after")])
    monkeypatch.setattr(decontam, "SHARD_WORDS", 10)
    got = decontam.contaminated(docs, items).collect()
    assert [(r.doc_id, r.item_id) for r in got] == [(50, 1)]
    assert decontam.drop_contaminated(docs, items).count() == len(ODD)
    assert decontam.contaminated(docs, items.limit(0)).count() == 0


def test_shards_are_even_and_match_the_mixture(spark, documents, monkeypatch):
    monkeypatch.setattr(sharding, "ROWS_PER_BUCKET", 17)
    rows = sharding.shard_rows(documents, 16).collect()
    n = documents.count()
    sizes = Counter(r.shard for r in rows)
    assert len(rows) == n and max(sizes.values()) - min(sizes.values()) <= 1
    for shard, m in sizes.items():
        assert sorted(r.slot for r in rows if r.shard == shard) == list(range(m))
    for source, total in Counter(r.source for r in rows).items():
        per = Counter(r.shard for r in rows if r.source == source)
        assert all(abs(per[s] - total / 16) <= 2 for s in range(16))
    texts = {r.doc_id: r.text or "" for r in documents.collect()}
    assert all(r.size == len(texts[r.doc_id].encode()) + 1 and r.text_crc32 == zlib.crc32(texts[r.doc_id].encode()) for r in rows)
    odd = docs_of(spark, ODD).withColumn("source", F.when(F.col("doc_id") > 3, F.col("source")))
    assert sharding.shard_rows(odd, 16).count() == len(ODD)
    assert sharding.shard_rows(odd.limit(0), 16).count() == 0


def test_surrogates_hide_cohere_and_stay_distinct(spark, monkeypatch):
    text = 'Ab.c24@Mail4.example.com AB.C24@MAIL4.EXAMPLE.COM +1 (643) 555-5742 4111 1111 1111 1111 4111-1111-1111-1111 10.0.0.1 "73d74656391396c3efc1d06034ff67f14d73d746" Mrs. Anna Smith, Mr Carl Smith, Г-жа Ольга Петрова'
    docs = docs_of(spark, [*ODD, (90, text), (91, "again 10.0.0.1")])
    got = {r.doc_id: r for r in surrogates.mask(docs, "k").collect()}
    new = got[90].text
    for secret in ("Mail4", "643", "4111", "10.0.0.1", "73d7", "Anna", "Smith", "Ольга"):
        assert secret.lower() not in new.lower()
    a, b, *rest = new.split(" ")
    assert a.upper() == b and a.endswith(".com") and rest[0] == "+1"
    assert "Mrs. " in new and "Г-жа " in new
    cards = [new[i : i + 19] for i in (new.index(rest[3]), new.index(rest[3]) + 20)]
    digits = [int(c) for c in cards[0] if c.isdigit()]
    assert [c.replace("-", " ") for c in cards][0] == cards[1].replace("-", " ")
    assert sum(d if i % 2 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(digits)) % 10 == 0
    assert got[91].text.split()[1] in new and got[1].text is None and got[2].text == ""
    assert surrogates.mask(docs, "k").count() == docs.count()
    assert surrogates.mask(docs.limit(0), "k").count() == 0
    entities = spark.createDataFrame([("ssn", str(i)) for i in range(10)], "kind string, entity string")
    monkeypatch.setattr(surrogates, "MOST_IDLE", 3)
    with pytest.raises(ValueError):  # ten one-digit entities leave no free surrogate
        surrogates.distinct_surrogates(entities, "k")
    many = spark.createDataFrame([("number", f"{i:03d}") for i in range(100)], "kind string, entity string")
    out = surrogates.distinct_surrogates(many, "k").collect()
    assert len({r.new for r in out}) == 100 and not {r.new for r in out} & {r.entity for r in out}


def test_surrogates_of_all_documents_keep_form_and_identity(spark):
    """Every mention of every document, found by an independent engine: the rest of the text stays, and forms, kinds and identities hold."""
    import regex

    find = regex.compile(surrogates.PATTERN)
    kinds = {k: regex.compile(f"(?:{p})") for k, p in surrogates.KINDS.items()}
    extra = [(-1, "IBAN DE89 3704 0044 0532 0130 00, DE89370400440532013000"), (-2, "ABCDEF0123456789ABCDEF0123456789"), (-3, None), (-4, "Mrs. Anna Smith, Dr. Anna Smith, Mrs. Smith")]
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").union(spark.createDataFrame(extra, "doc_id bigint, text string"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    new_of, old_of, seen = {}, {}, 0
    for r in surrogates.mask(docs, "k").collect():
        old = texts[r.doc_id]
        spans = list(find.finditer(old)) if old else []
        assert r.entities == len(spans)
        if not spans:
            assert r.text == old
            continue
        at = shift = 0
        for m in spans:
            assert r.text[at + shift : m.start() + shift] == old[at : m.start()]
            seen += 1
            mention, kind = m[0], next(k for k, p in kinds.items() if p.fullmatch(m[0]))
            if kind == "name":  # the length of names changes
                there = kinds["name"].match(r.text, m.start() + shift)
                assert there and there[0].split(" ")[0] == mention.split(" ")[0] and there[0].split(" ")[1:] != mention.split(" ")[1:]
                new = there[0]
                identity, written = mention.split(" ")[-1].lower(), new.split(" ")[-1].lower()
            elif kind == "ip":
                new = kinds["ip"].match(r.text, m.start() + shift)[0]
                identity, written = mention, new
            else:
                new = r.text[m.start() + shift : m.end() + shift]
                identity, written = (regex.sub(r"[^\p{L}\p{N}]", "", x).lower() for x in (mention, new))
                if kind != "secret":
                    assert [(c.isdigit(), c.isalpha(), c.isupper()) for c in new] == [(c.isdigit(), c.isalpha(), c.isupper()) for c in mention]
            assert kinds[kind].fullmatch(new), (mention, new)
            identity = (kind, "+" * mention.startswith("+") + identity)
            assert new_of.setdefault(identity, written) == written and old_of.setdefault((kind, written), identity) == identity
            at, shift = m.end(), shift + len(new) - len(mention)
        assert r.text[at + shift :] == old[at:]
    assert seen > 50 and not {(k, i) for k, i in new_of} & set(old_of)
    iban = new_of["iban", "de89370400440532013000"].upper()
    assert int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def test_surrogates_of_very_long_words_take_little_time(spark):
    import time

    rows = [(1, "x" * 1_000_000), (2, "7" * 1_000_000), (3, "a@" * 300_000), (4, "é" * 500_000 + "@b.example.org"), (5, "a.b@" + "c." * 100_000)]
    began = time.time()
    got = {r.doc_id: r for r in surrogates.mask(spark.createDataFrame(rows, "doc_id bigint, text string"), "k").collect()}
    assert time.time() - began < 60 and all(got[d].text == t for d, t in rows)


def test_exact_groups_equal_brute_force_at_any_split(spark, documents):
    docs = documents.select("doc_id", "text").union(spark.createDataFrame([(i, "hot  text") for i in range(10_000, 10_150)] + [(20_000, None), (20_001, "")], "doc_id bigint, text string"))
    import re

    groups = defaultdict(list)
    for r in docs.collect():
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "")].append(r.doc_id)
    want = {d: (min(ids), len(ids), hashlib.sha256(t.encode()).hexdigest()) for t, ids in groups.items() for d in ids}
    for k in (2, 255):
        got = exact_dedup.exact_groups(docs, k).collect()
        assert {r.doc_id: (r.keep_id, r.group_size, r.text_sha256) for r in got} == want
        assert all(r.kept == (r.doc_id == r.keep_id) for r in got)
        assert sorted(r.doc_id for r in exact_dedup.drop_exact_copies(docs, k).collect()) == sorted(min(ids) for ids in groups.values())
    odd = docs_of(spark, ODD)
    kept = exact_dedup.drop_exact_copies(odd)
    assert kept.columns == odd.columns and sorted(r.doc_id for r in kept.collect() if r.doc_id) == [1, 3, 4, 5, 6]
    assert exact_dedup.exact_groups(odd.limit(0)).count() == 0


def test_exact_copies_with_clashing_columns(spark):
    rows = [(1, "a  b", "one", 7), (1, "a b", "two", 8), (2, "a b", "three", 9), (3, "c", "four", 10), (None, "c", "five", 11)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, digest_of_text string, __digest int").withColumn("ID_that_stays", F.lit(1))
    kept = exact_dedup.drop_exact_copies(docs)
    assert kept.columns == docs.columns
    got = sorted((r.doc_id, r.digest_of_text) for r in kept.collect())
    assert [d for d, _ in got] == [1, 3] and got[0][1] in ("one", "two") and got[1][1] == "four"


def ppm_by_the_book(train, text):
    """log10 probability of a text under PPM with method D escapes, exclusion and update exclusion; train: words of the training texts."""
    table = defaultdict(Counter)
    for ws in train:
        whole = ppm.END * ppm.ORDER + b" ".join(ws) + ppm.END
        for i in range(ppm.ORDER, len(whole)):
            for k in range(ppm.ORDER, -1, -1):
                own = table[whole[i - k : i]]
                own[whole[i]] += 1
                if own[whole[i]] > 1:
                    break

    def code_length(context, symbol):
        total, excluded = 0.0, set()
        for k in range(len(context) + 1):
            own = {s: n for s, n in table.get(context[k:], {}).items() if s not in excluded}
            if not own:
                continue
            if symbol in own:
                return total + math.log10((own[symbol] - 0.5) / sum(own.values()))
            total += math.log10(len(own) / 2 / sum(own.values()))
            excluded |= own.keys()
        return total - math.log10(256 - len(excluded))

    def of(ws):
        whole = ppm.END * ppm.ORDER + b" ".join(ws) + ppm.END
        return sum(code_length(whole[i - ppm.ORDER : i], whole[i]) for i in range(ppm.ORDER, len(whole)))

    return of(text) if text is not None else code_length


def test_ppm_equals_brute_force(spark, documents):
    more = [(-1, None), (-20, ""), (-21, "Zz \x1c\x85 日本 " + "x" * 3000), (None, "no id, yet it trains"), (3, "an id twice"), (3, "an id twice")]
    docs = documents.select("doc_id", "text").union(spark.createDataFrame(more, "doc_id bigint, text string"))
    rows = [(r.doc_id, words(r.text)) for r in docs.collect()]
    held = {d: d is not None and zlib.crc32(str(d).encode()) % 10 == 0 for d, _ in rows}
    train = [ws for d, ws in rows if not held[d]]
    counts = Counter(w for ws in train for w in ws)
    n, v = sum(counts.values()) + len(train), len(counts) + 1
    got = ppm.score_documents(docs).collect()
    assert Counter(r.doc_id for r in got) == Counter(d for d, _ in rows)
    texts, by = dict(rows), {r.doc_id: r for r in got}
    for d, r in by.items():
        if d == 3:
            continue
        ws = texts[d]
        base = sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws) + math.log10((len(train) + 0.1) / (n + 0.1 * (v + 1)))
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[d], len(ws) + 1, sum(counts[w] > 0 for w in ws) + 1, n)
        assert r.base_score == pytest.approx(base, abs=1e-6) and r.score < 0
    table = ppm_by_the_book(train, None)
    for d in (d for d in by if d != 3 and (held[d] or d in (-1, -20, -21))):
        whole = ppm.END * ppm.ORDER + b" ".join(texts[d]) + ppm.END
        want = sum(table(whole[i - ppm.ORDER : i], whole[i]) for i in range(ppm.ORDER, len(whole)))
        assert by[d].score == pytest.approx(want, rel=1e-5)
    assert ppm.score_documents(docs_of(spark, ODD)).count() == len(ODD)
    assert ppm.score_documents(docs.limit(0)).count() == 0
    untrained = ppm.score_documents(spark.createDataFrame([(-1, "ab")], "doc_id bigint, text string").where("doc_id < 0")).collect()
    assert untrained[0].score < 0


def test_ppm_beats_the_base_and_knows_word_order(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    got = ppm.score_documents(docs).where("held_out").agg(F.avg("score"), F.avg("base_score")).first()
    assert got[0] > got[1]
    train = [b"one two three four".split(), b"one two five".split()]
    assert ppm_by_the_book(train, b"one two three".split()) > ppm_by_the_book(train, b"three one two".split())


def test_ppm_probabilities_sum_to_one():
    import numpy as np

    rng = np.random.default_rng(1)
    bodies = [bytes(rng.integers(97, 100, 40).astype(np.uint8)) for _ in range(6)]
    keys, counts = np.unique(ppm.windows(bodies)[0], return_counts=True)
    chain = ppm.levels(keys, counts, ppm.ORDER, None)
    for context in (keys[5], keys[50], np.uint64(int.from_bytes(b"zzzzz?", "big"))):
        every = (context >> np.uint64(8) << np.uint64(8)) | np.arange(256, dtype=np.uint64)
        assert (10 ** ppm.code_lengths(chain, every)).sum() == pytest.approx(1.0)


def linked_components(texts):
    sets = {d: frozenset(zip(*(w[i:] for i in range(5)))) if len(w) >= 5 else frozenset([tuple(w)] if w else []) for d, w in ((d, words(t)) for d, t in texts.items())}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: find(d) for d in sets}, {d: len(s) for d, s in sets.items()}


def test_near_groups_equal_brute_force(spark, documents, monkeypatch):
    import random

    random.seed(3)
    monkeypatch.setattr(neardup, "BLOCK", 8)
    base = [f"word{random.randrange(400)}" for _ in range(120)]
    family = []
    for i in range(80):  # a family whose members often link through others only
        own = list(base)
        for _ in range(random.randrange(9)):
            own[random.randrange(120)] = f"x{random.randrange(10**6)}"
        family.append((50_000 + i, " ".join(own)))
    more = family + [(60_000, "a b c"), (60_001, "A  b c"), (60_002, None), (60_003, " "), (60_004, "a b c d e f g h"), (60_005, "a b c d e f g h i")]
    docs = documents.select("doc_id", "text").union(spark.createDataFrame(more, "doc_id bigint, text string"))
    got = {r.doc_id: r for r in neardup.near_groups(docs).collect()}
    want, sizes = linked_components({r.doc_id: r.text for r in docs.collect()})
    assert {d: r.component_id for d, r in got.items()} == want
    assert {d: r.n_shingles for d, r in got.items()} == sizes
    assert all(r.kept == (r.doc_id == r.component_id) for r in got.values())
    kept = neardup.drop_near_copies(docs)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(d for d, c in want.items() if d == c)


def test_near_groups_lose_no_pair_at_the_limit(spark):
    """2,000 pairs of texts whose similarity is 96 / 128 = 0.75 exactly, and 500 at 95 / 127, just below."""
    import random

    random.seed(11)
    word = lambda: f"w{random.randrange(10**9)}"
    rows = []
    for i in range(2_500):
        shared = [word() for _ in range(100 if i < 2_000 else 99)]
        rows += [(2 * i, " ".join(shared + [word() for _ in range(16)])), (2 * i + 1, " ".join(shared + [word() for _ in range(16)]))]
    got = {r.doc_id: r.component_id for r in neardup.near_groups(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    found = sum(got[2 * i + 1] == 2 * i for i in range(2_000))
    assert found >= 1_999  # each is missed with a chance of about 3e-5
    assert all(got[2 * i + 1] == 2 * i + 1 for i in range(2_000, 2_500))


def test_near_groups_join_a_family_by_links_that_no_star_has(spark, monkeypatch):
    """A chain: each text links with the next ones only, and ids are shuffled so that centres lie anywhere."""
    import random

    random.seed(12)
    monkeypatch.setattr(neardup, "BLOCK", 16)
    monkeypatch.setattr(neardup, "BLOCK_SHINGLES", 2_000)
    flow = [f"w{i}" for i in range(1_500)]
    ids = random.sample(range(1_000), 140)
    rows = [(d, " ".join(flow[10 * i : 10 * i + 104])) for i, d in enumerate(ids)]
    rows += [(2_000 + i, " ".join(flow[24 * i : 24 * i + 104])) for i in range(50)]
    got = {r.doc_id: r.component_id for r in neardup.near_groups(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == linked_components(dict(rows))[0]


def test_near_groups_of_odd_rows(spark):
    odd = docs_of(spark, ODD)
    got = {r.doc_id: r for r in neardup.near_groups(odd).collect()}
    assert set(got) == {1, 2, 3, 4, 5, 6, 7} and got[7].component_id == 6 and got[1].n_shingles == 0
    assert neardup.drop_near_copies(odd).columns == odd.columns
    assert neardup.near_groups(odd.limit(0)).count() == 0


def test_chat_round_trip_merging_and_loss(spark):
    said = "<|im_end|><|im_start|>assistant ok"
    rows = [(1, 0, "user", said), (1, 1, "assistant", said), (2, 0, "user", "a"), (2, 1, "user", "b\\<|x"), (2, 2, "assistant", None), (2, 3, "assistant", "c"), (3, None, None, "only"), (4, 5, "user", "t"), (4, 5, "user", "t"), (5, 0, "assistant", "\\\\|<<|>\n")]
    turns = spark.createDataFrame([(*r, "extra", 1) for r in rows], "conv_id bigint, turn bigint, role string, text string, formatted string, segments int")
    out = chat.format_chat(turns).select("conv_id", "formatted", chat.parse_chat(F.col("formatted")).alias("turns"), chat.loss_text(F.col("segments")).alias("loss")).collect()
    got = {r.conv_id: r for r in out}
    for c in {r[0] for r in rows}:
        own = [(r[2] or "", r[3] or "") for r in rows if r[0] == c]
        assert [(t.role, t.text) for t in got[c].turns] == own
        assert got[c].loss == "".join(t for role, t in own if role == "assistant")
    assert got[2].formatted.count(chat.START) == 2 and got[2].formatted.count(chat.CONT) == 2
    assert chat.format_chat(turns.limit(0)).count() == 0


def test_every_operator_has_a_query_and_passes_no_rows_by(spark, sf_dir):
    assert sorted(int(k[2:].split("_")[0]) for k in catalog.QUERIES) == list(range(1, 14))
    rows = catalog.op10_chat(spark, sf_dir)
    assert rows.where("conv_id = -1").count() == 1


def test_pipeline_keeps_clean_documents_and_applies_every_decision(spark, sf_dir):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "decontamination", "bpe"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, rows, sf_dir)
        assert after.columns == docs.columns
        after = spark.createDataFrame(after.collect(), after.schema)
        texts, kept = {r.doc_id: r.text for r in rows.collect()}, {r.doc_id for r in after.collect()}
        if name == "near_dedup":
            want, _ = linked_components(texts)
            assert kept == {d for d, c in want.items() if d == c}
        assert kept <= set(texts) and len(kept) > 0.6 * len(texts)
        rows = after
    assert {r.doc_id for r in corpus_pipeline.run(spark, sf_dir).collect()} == {r.doc_id for r in rows.collect()}


def test_pipeline_on_odd_documents(spark, sf_dir, tmp_path):
    """Nulls in every column, empty, very long and repeated texts and rows, further columns; and an empty table."""
    import corpus_pipeline

    given = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(40)
    odd = [(-1, None, None, None, None), (-2, "", "en", "s", 0), (-3, "  \n", "en", "s", 3), (-4, "long " * 30_000, "en", "s", 5), (-5, "x" * 200_000, None, "s", 5), (-6, "same text here", "en", "s", 1), (-7, "same  text\there", "en", "s", 1), (-7, "same  text\there", "en", "s", 1), (None, "an id is missing here and the text is kept as it is", "en", "s", 1)]
    both = given.select("doc_id", "text", "lang", "source", "n_chars").union(spark.createDataFrame(odd, "doc_id bigint, text string, lang string, source string, n_chars bigint"))
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").write.parquet(str(tmp_path / f"{name}.parquet"))
    both.withColumns({"digest": F.lit("d"), "is_likely": F.lit(True), "component_id": F.lit(7)}).write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = [r.doc_id for r in got]
    assert len(ids) == len(set(ids)) and {-4, -5} <= set(ids) and -6 not in ids and -7 in ids
    assert len({-1, -2} & set(ids)) == 1 and None in ids  # null and empty are one text
    assert next(r for r in got if r.doc_id == -5).n_tokens > 10_000
    both.limit(0).write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
