"""Phone surrogates as they are written."""

from __future__ import annotations

from lesionflow.llm import surrogates

from .test_corpus_operators import docs_of


def digits(text: str) -> str:
    return "".join(c for c in text if c.isdigit())


def test_phones_are_alike_in_both_formats(spark):
    texts = ["+1 (643) 555-5742", "+16435555742", "+49 30 1234 5678", "+493012345678"]
    got = {r.doc_id: r.text for r in surrogates.mask(docs_of(spark, list(enumerate(texts))), "k").collect()}
    assert digits(got[0]) == digits(got[1]) != digits(texts[0]) and digits(got[0])[0] == "1"
    assert digits(got[2]) == digits(got[3]) != digits(texts[2]) and digits(got[2])[:2] == "49"


def test_written_phones_are_distinct_in_a_small_space(spark):
    real = [f"+1 {i * 37:05d}"[:5] + "-" + f"{i * 37:05d}"[2:] for i in range(2000)]
    got = [r.text for r in surrogates.mask(docs_of(spark, list(enumerate(real))), "k").collect()]
    written = {digits(t) for t in got}
    assert len(written) == 2000 and not written & {digits(t) for t in real} and all(w[0] == "1" for w in written)
