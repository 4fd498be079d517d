"""What is read out of expert texts, case by case."""

from pyspark.sql import functions as F

from lesionflow.functions import rationale


def one(spark, text, make):
    return spark.createDataFrame([(text,)], "t string").select(make(F.col("t")).alias("x")).first().x


def test_shown_text_keeps_what_was_entered(spark):
    for text, want in {
        "Target L.: 1 12mm x 13mm": "Target L.: 1 12mm x 13mm", " None ": "", None: "", "  ": "", "CRET": "complete resection of the enhancing tumour",
        "PRET, T2-Progr.": "partial resection of the enhancing tumour, T2 progression", "Progr. of L. 2": "Progr. of L. 2",
    }.items():
        assert one(spark, text, rationale.shown) == want


def test_pairs_with_decimals_signs_and_units(spark):
    loose = lambda t: [(p.a, p.b) for p in one(spark, t, lambda c: rationale.pairs(c, rationale.LOOSE_PAIR))]
    strict = lambda t: [(p.a, p.b) for p in one(spark, t, lambda c: rationale.pairs(c, rationale.STRICT_PAIR))]
    assert loose("12.5mm x 8.5mm") == strict("12.5mm x 8.5mm") == [(12.5, 8.5)]
    assert loose("10mm × 9mm") == strict("10mm × 9mm") == [(10, 9)]
    assert loose("12 x 13 and 4 X 5mm") == [(12, 13), (4, 5)] and strict("12 x 13 and 4 X 5mm") == []
    assert loose(None) == []
    best = one(spark, "3mm x 4mm, 4mm x 3mm", lambda c: F.array_max(rationale.pairs(c, rationale.LOOSE_PAIR)))
    assert (best.a, best.b) == (3, 4)  # of equal products the first


def test_labels_tell_target_from_non_target(spark):
    for text, want in {
        "non-target L.: 1": ["non-target lesion"], "non target l. 2": ["non-target lesion"], "Target L. 1, new": ["measured target lesion", "new lesion"],
        "nonmeasurable": ["non-measurable lesion"], "CRET": ["resection status"], "": ["none recorded"], "None": ["none recorded"], "renewed": ["other"],
        "T2-Progr. in irradiated field": ["T2/FLAIR progression", "in irradiated field"],
    }.items():
        assert one(spark, text, rationale.labels) == want


def test_features_and_kinds(spark):
    flags = lambda t: {k for k, c in rationale.features(F.col("t")).items() if spark.createDataFrame([(t,)], "t string").select(c).first()[0]}
    assert flags("CRET cret PRETX Bevacizumab temozolomide NEW nontarget t2progr") == {"cret", "avastin", "temodal", "new_lesion", "non_target", "t2_progression"}
    assert flags(None) == set()
    for text, kind, loose in (("new target L. 1", "new target", "target"), ("New non-measurable L.", "new non-measurable", "non-measurable"), ("new bright L. 2", "new (other)", "other"), ("renewed", "", "other"), ("stable", "", "")):
        assert (one(spark, text, rationale.new_lesion_kind), one(spark, text, rationale.any_new_kind)) == (kind, loose)


def test_detail_and_cleaning(spark):
    row = spark.createDataFrame([(12345.0, 0.125, -0.001), (40.0, None, None), (0.0, None, -1.0), (None, None, None)], "v double, n double, b double")
    got = [r[0] for r in row.select(rationale.detail(F.col("v"), F.col("n"), F.col("b"))).collect()]
    assert got == ["12,345 mm3   +12% vs nadir   -0% vs baseline", "40 mm3   nadir was 0", "0 mm3   -100% vs baseline", "no enhancing measurement"]
    assert [one(spark, t, rationale.cleaned_rating) for t in (" Post-Op/PD", "Pre-Op", "None", "nan", None)] == ["PD", "Pre-Op", None, None, None]
    assert [one(spark, t, rationale.idh_status) for t in ("IDH1 R132H", "WT", "neg.", None)] == ["mutant", "wildtype", "IDH1-neg (seq. required)", "unknown"]
    assert [one(spark, t, rationale.mgmt_status) for t in (" Methylated", "NA", None)] == ["methylated", None, None]
    assert [one(spark, t, rationale.number) for t in (" 12.5", "n/a", None)] == [12.5, None, None]
