"""What an expert's free text says: shown form, measured pairs, features, labels, kinds of new lesion."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The abbreviations that are written out; everything else stays as it was entered.
SPELT_OUT = {"CRET": "complete resection of the enhancing tumour", "PRET": "partial resection of the enhancing tumour", "T2-Progr.": "T2 progression"}
#: Two numbers of a measurement, loosely written and with the unit after both.
LOOSE_PAIR = r"(\d+(?:\.\d+)?)\s*(?:mm)?\s*[x×X]\s*(\d+(?:\.\d+)?)\s*(?:mm)?"
STRICT_PAIR = r"(?i)(\d+(?:\.\d+)?)\s*mm\s*[x×]\s*(\d+(?:\.\d+)?)\s*mm"
#: Features of the raw text.
FEATURES = {
    "cret": r"\bCRET\b", "pret": r"\bPRET\b", "t2_progression": r"(?i)T2-?Progr", "new_lesion": r"(?i)\bnew\b", "non_target": r"(?i)non-?target",
    "avastin": r"(?i)avastin|bevacizu", "temodal": r"(?i)temodal|temozolo",
}
#: Labels of the shown text in lower case, several of which may hold, and whether a rule on volumes can see them.
LABELS = [
    ("measured target lesion", r"(?<!non-)(?<!non )target l", True), ("non-target lesion", r"non-?\s?target", False), ("new lesion", r"\bnew\b", False),
    ("T2/FLAIR progression", r"t2 progression|t2-progr", False), ("non-measurable lesion", r"non-?measurable", False), ("in irradiated field", r"irradiated", False),
    ("resection status", r"resection of the enhancing", True),
]


def raw(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def shown(text: Column) -> Column:
    """The text as entered, abbreviations spelt out; '' for blank text and ``none``."""
    out = F.trim(raw(text))
    for short, full in SPELT_OUT.items():
        out = F.replace(out, F.lit(short), F.lit(full))
    return F.when(F.lower(F.trim(raw(text))) == "none", "").otherwise(out)


def pairs(text: Column, pattern: str) -> Column:
    """array<struct<product, first, a, b>> of all measurements in the text; ``first`` is larger for earlier ones."""
    one, two = (F.regexp_extract_all(raw(text), F.lit(pattern), F.lit(i)) for i in (1, 2))
    return F.transform(F.arrays_zip(one.alias("a"), two.alias("b")), lambda p, i: F.struct(
        (p["a"].cast("double") * p["b"].cast("double")).alias("product"), (-i).alias("first"), p["a"].cast("double").alias("a"), p["b"].cast("double").alias("b")))


def features(text: Column) -> dict[str, Column]:
    return {k: F.regexp_like(raw(text), F.lit(p)) for k, p in FEATURES.items()}


def labels(text: Column) -> Column:
    """All labels of a text, in fixed order; ``none recorded`` for blank text, ``other`` where none fits."""
    lower = F.lower(shown(text))
    found = F.filter(F.array(*(F.when(F.regexp_like(lower, F.lit(p)), k) for k, p, _ in LABELS)), lambda x: x.isNotNull())
    return F.when(F.size(found) > 0, found).when(F.trim(lower) == "", F.array(F.lit("none recorded"))).otherwise(F.array(F.lit("other")))


def new_lesion_kind(text: Column) -> Column:
    """The kind of new lesion that is named in so many words, the first that fits; '' where none is."""
    lower = F.lower(raw(text))
    out = F.lit("")
    for kind, fits in (
        ("new (other)", F.regexp_like(lower, F.lit(r"new .*l\."))), ("new non-target", F.contains(lower, F.lit("new non-target l"))),
        ("new non-measurable", F.contains(lower, F.lit("new non-measurable l"))), ("new target", F.contains(lower, F.lit("new target l"))),
    ):
        out = F.when(fits, kind).otherwise(out)
    return out


def any_new_kind(text: Column) -> Column:
    """The looser form: any ``new``, by what follows it."""
    lower = F.lower(raw(text))
    out = F.when(F.contains(lower, F.lit("new")), "other").otherwise("")
    for kind in ("non-meas", "non-target", "target"):
        out = F.when(F.contains(lower, F.lit(f"new {kind}")), {"non-meas": "non-measurable"}.get(kind, kind)).otherwise(out)
    return out


def disagreement(volume: Column, text: Column) -> Column:
    """1: nothing enhances; 2: the expert cites a new lesion or T2 progression; 3: the rest."""
    cited = F.regexp_like(raw(text), F.lit(r"(?i)\bnew\b")) | F.regexp_like(raw(text), F.lit(r"(?i)T2[- ]?Progr"))
    return F.when(F.coalesce(volume == 0, F.lit(False)), 1).when(cited, 2).otherwise(3)


def signed_percent(x: Column) -> Column:
    """A fraction as a signed whole percentage, halves to even."""
    return F.concat(F.when(x < 0, "-").otherwise("+"), F.bround(F.abs(x) * 100, 0).cast("long").cast("string"), F.lit("%"))


def detail(volume: Column, vs_nadir: Column, vs_baseline: Column) -> Column:
    """The volume of a call and the two changes it was judged by."""
    bits = F.array(
        F.concat(F.format_number(volume, 0), F.lit(" mm3")),
        F.when(vs_nadir.isNotNull(), F.concat(signed_percent(vs_nadir), F.lit(" vs nadir"))).when(volume > 0, "nadir was 0"),
        F.when(vs_baseline.isNotNull(), F.concat(signed_percent(vs_baseline), F.lit(" vs baseline"))),
    )
    return F.when(volume.isNull(), "no enhancing measurement").otherwise(F.array_join(bits, "   "))


def cleaned_rating(text: Column) -> Column:
    """``Post-Op/PD`` counts as PD; ``None``, ``nan`` and missing are NULL."""
    own = F.trim(text)
    return F.when(own == "Post-Op/PD", "PD").when(~own.isin("None", "nan"), own)


def idh_status(text: Column) -> Column:
    own = F.trim(F.lower(raw(text)))
    return F.when(F.regexp_like(own, F.lit("r132|mut")), "mutant").when(F.regexp_like(own, F.lit("wt|wild")), "wildtype").when(F.contains(own, F.lit("neg")), "IDH1-neg (seq. required)").otherwise("unknown")


def mgmt_status(text: Column) -> Column:
    own = F.trim(F.lower(text))
    return F.when(~own.isin("na", "nan", ""), own)


def number(text: Column) -> Column:
    """The text as a number, NULL where it is none."""
    return F.trim(text).try_cast("double")
