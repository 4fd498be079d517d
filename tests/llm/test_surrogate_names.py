"""Whole names leave the text, in every way of writing."""

import re

from lesionflow.llm import surrogates


def luhn(number):
    digits = [int(c) for c in reversed(re.sub(r"[^0-9]", "", number))]
    return sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(digits)) % 10 == 0


def masked(spark, *texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    return [r.text for r in surrogates.mask(rows, "k").orderBy("doc_id").collect()]


def test_no_part_of_a_found_name_stays(spark):
    names = ["Mr. McDonald", "Ms. Anne-Marie Jones-Lee", "Frau Müller-Lüdenscheidt", "Mr. O'Brien", "Mr. D’Angelo", "Mr. J. Smith", "Mrs. J. R. Smith", "MR. SMITH", "DR SMITH", "Dr. J.-P. Dupont", "Г-н Иванов", "Mr. DeVito Jr"]
    parts = ["Mc", "Donald", "Anne", "Marie", "Jones", "Lee", "Müller", "Lüdenscheidt", "Brien", "Angelo", "Smith", "SMITH", "Dupont", "Иванов", "DeVito"]
    for text, name in zip(masked(spark, *(f"Then {n} said so." for n in names)), names):
        assert text.startswith(f"Then {name.split(' ')[0]} ") and text.endswith(" said so."), text
        middle = text.removeprefix("Then ").removesuffix(" said so.")
        assert not any(p in middle for p in parts), text
        if name == name.upper() and "Г" not in name:
            assert middle == middle.upper()


def test_initials_become_initials_and_names_stay_one_person(spark):
    one, two, three, four = masked(spark, "Mr. J. Smith and Mr. Smith", "MR. SMITH came", "Mr. Smith's car, Mr J. Smith", "Mr. Smith-Jones")
    family = re.fullmatch(r"Mr\. [A-Z]\. (\w+) and Mr\. (\w+)", one)
    assert family and family[1] == family[2] and two == f"MR. {family[1].upper()} came"
    assert re.fullmatch(rf"Mr\. {family[1]}'s car, Mr [A-Z]\. {family[1]}", three) and three[-len(family[1]) - 3] == one[4]
    assert family[1] not in four


def test_numbers_with_check_digits_keep_them(spark):
    valid, other = "378282246310005", "378282246310006"
    a, b = masked(spark, f"paid {valid} ok", f"paid {other} ok")
    assert luhn(valid) and not luhn(other)
    assert re.fullmatch(r"paid \d{15} ok", a) and valid not in a and luhn(a) and re.fullmatch(r"paid \d{15} ok", b) and other not in b
