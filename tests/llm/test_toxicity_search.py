"""The search of misspelt words against edit distances, and the lexicon against its floors."""

from __future__ import annotations

import random

from lesionflow.llm import toxicity

from .test_corpus_operators import docs_of, edit_distance


def changed(rng: random.Random, word: str, edits: int) -> str:
    letters = list(word)
    for _ in range(edits):
        i, kind = rng.randrange(len(letters) + 1), rng.randrange(3)
        letters[i : i + (kind > 0)] = [rng.choice("idotwrhlesmnpac")] if kind < 2 else []
    return "".join(letters)


def test_misspelt_words_of_a_stem_are_found():
    trie = toxicity.Trie({"worthless": 5.0, "worthlessly": 5.0}, {"worthl": 4.0, "idiot": 4.0})
    assert trie.find("worthlos")[0] == "stem"
    for word in ("wrothless", "worhtlessly", "wortless", "vorthlos", "idoitish", "idxotenhaft"):
        want = word != "idoitish"  # two edits inside a stem of five letters
        assert (trie.find(word) is not None) == want, word
        assert (word in trie.find_all([word])) == want, word


def test_search_equals_edit_distances_of_terms_and_beginnings():
    rng = random.Random(5)
    terms, stems = {"worthless": 5.0, "moron": 4.0, "pathetic": 3.0, "scumbags": 2.0}, {"worthl": 2.5, "idiot": 3.5, "patheti": 1.5, "despicab": 4.5, "ach": 1.0}
    trie = toxicity.Trie(terms, stems)
    words = sorted({changed(rng, rng.choice([*terms, *stems]), rng.randint(0, 4)) + rng.choice(["", "", "ish", "enhaft"]) for _ in range(2000)})
    found = trie.find_all(words)
    for word in words:
        allowed = lambda x: min(toxicity.edits_for(len(word)), toxicity.edits_for(len(x)))
        near = [d for t in terms if (d := edit_distance(word, t)) <= allowed(t)]
        near += [d for s in stems if (d := min(edit_distance(word[:n], s) for n in range(len(word) + 1))) <= allowed(s)]
        assert (word in found, trie.find(word)) == (bool(near), found.get(word)), word
        if near:
            assert found[word][2] == min(near), word


def test_lexicon_keeps_all_entries_that_stand_out(spark):
    rng = random.Random(6)
    letters = "bcdfghklmnprstvz"
    roots = [f"{a}{v}{b}" for v, (a, b) in zip("aeiou" * 16, rng.sample([(a, b) for a in letters for b in letters], 80))]
    forms = [root + end for root in roots for end in ("abel", "ebon", "ifur", "olad", "umex")]
    plain = [f"q{a}{b}{end}" for a in letters[:8] for b in letters[:5] for end in ("ar", "ero", "ilu", "oka", "umi", "ase", "ete", "iso", "oru", "uva")]
    texts = [" ".join(rng.sample(forms + plain[::2] if i % 3 == 0 else plain, 400)) for i in range(300)]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(300)], "doc_id bigint, toxic int")
    model = toxicity.learn(docs_of(spark, list(enumerate(texts))), labels)
    assert set(forms) <= set(model.terms) and set(roots) <= set(model.stems)


def test_all_ordinary_words_near_a_term_are_kept(spark):
    term, some, others = "worthless", "bcdfgjkmpq", "bdfgjkmpqz"
    near = {term[:i] + a + term[i + 1 : j] + b + term[j + 1 :] for i in range(9) for j in range(i + 1, 9) for a in some for b in others}
    near |= {term[:i] + a + term[i:j] + b + term[j:] for i in range(9) for j in range(i, 9) for a in some for b in others}
    assert len(near) > 5000
    counts = spark.createDataFrame([(w, 0, 2) for w in sorted(near)], "word string, a bigint, b bigint")
    assert toxicity.near_misses(counts, toxicity.Model({term: 5.0}, {})) == near
