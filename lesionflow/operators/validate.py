"""Checks of grids and records as rows with a status and a code."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars

#: Tolerances of grid alignment.
TRANSLATION, DIRECTION, SPACING = 1e-3, 1e-3, 1e-4


def geometry(grids: DataFrame) -> DataFrame:
    """Adds voxel volume, spacings, anisotropy, isotropy and number of voxels to grids with a00..a22, nx, ny, nz."""
    a = scalars.affine()
    s = scalars.spacing(a)
    rows = grids.withColumns({"voxel_mm3": scalars.voxel_volume(a), "s0": s[0], "s1": s[1], "s2": s[2]})
    rows = rows.withColumn("anisotropy", scalars.anisotropy([F.col("s0"), F.col("s1"), F.col("s2")]))
    return rows.withColumns({"isotropic": F.col("anisotropy") <= 1.01, "n_voxels": F.col("nx").cast("long") * F.col("ny") * F.col("nz")})


def grid_alignment(grids: DataFrame) -> DataFrame:
    """(patient, status, code) of each mask against its reference: shape, spacing, direction, translation in this order; a missing side passes with its own code."""
    c = scalars.cosines(scalars.affine())
    wide = geometry(grids).withColumns({f"c{i}{j}": c[i][j] for i in range(3) for j in range(3)})
    names = ["nx", "ny", "nz", "s0", "s1", "s2", "t0", "t1", "t2", *(f"c{i}{j}" for i in range(3) for j in range(3))]
    side = lambda role: wide.where(F.col("role") == role).select("patient", F.struct(*names).alias(role))
    both = side("mask").join(side("mask_reference"), "patient", "full")
    m, r = F.col("mask"), F.col("mask_reference")
    worst = lambda cols: F.greatest(*(F.abs(m[x].cast("double") - r[x].cast("double")) for x in cols))
    code = (
        F.when(m.isNull() | r.isNull(), "pair_missing").when((m["nx"] != r["nx"]) | (m["ny"] != r["ny"]) | (m["nz"] != r["nz"]), "shape_mismatch")
        .when(worst(["s0", "s1", "s2"]) > SPACING, "spacing_mismatch").when(worst([f"c{i}{j}" for i in range(3) for j in range(3)]) > DIRECTION, "direction_mismatch")
        .when(worst(["t0", "t1", "t2"]) > TRANSLATION, "translation_mismatch").otherwise("aligned")
    )
    return both.select("patient", code.alias("code")).withColumn("status", F.when(F.col("code").isin("aligned", "pair_missing"), "pass").otherwise("fail"))


def chronology_violations(scans: DataFrame) -> DataFrame:
    """Scans whose week lies before that of the scan ahead of them in rn order."""
    w = Window.partitionBy("patient").orderBy("rn")
    return scans.withColumn("ahead", F.last("week", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))).where("week < ahead").select("patient", "timepoint", "week", "ahead")


def record_violations(records: DataFrame) -> DataFrame:
    """Treatment records (surgeries, rt_start, rt_end) that break an invariant: (patient, violation)."""
    found = F.filter(F.array(
        F.when(F.exists("surgeries", lambda s: s.isNull() | F.isnan(s)), "week_not_finite"),
        F.when(F.col("surgeries") != F.array_sort("surgeries"), "surgeries_not_ordered"),
        F.when(F.col("rt_end") < F.col("rt_start"), "radiotherapy_ends_before_start"),
    ), lambda x: x.isNotNull())
    return records.select("patient", F.explode(found).alias("violation"))


def readiness(scans: DataFrame) -> DataFrame:
    """Per patient: scans, usable (volume known), assessable (usable, dated and rated), ready (two assessable or more)."""
    usable = F.col("enhancing_mm3").isNotNull()
    assessable = usable & F.col("week").isNotNull() & F.col("rating").isNotNull()
    rows = scans.groupBy("patient").agg(F.count(F.lit(1)).alias("n_scans"), F.count(F.when(usable, 1)).alias("usable"), F.count(F.when(assessable, 1)).alias("assessable"))
    return rows.withColumn("ready", F.col("assessable") >= 2)
