"""Imaged particles: geometry, size classes, length-to-carbon conversion and biomass."""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from biascomp.functions.numeric import ratio, valid_or_null
from biascomp.operators import composition
from biascomp.operators.groups import add_group_aggs, share

# Scanner resolution and categories left out of the benchmark.
PIXEL_MM = 0.0106
FIXED_DEPTH_M = 210.0
SPLIT_FACTOR = 8 / 3
EXCLUDED_CATEGORIES = [
    "Hyperiidea", "part<Crustacea", "dark<sphere", "multiple organisms", "head<Chaetognatha",
    "egg<Actinopterygii", "other<living", "Insecta",
]

# Length (mm) to carbon (µg) per relation, as
#   carbon = c2 * (c * (k * (L / b - a)) ** e) ** e2
# with a, b the total-length conversion, k the length scale, c and e the allometry and c2, e2 the
# outer conversion. Relations whose published conversion is not applied keep a = 0 and b = 1.
RELATIONS: dict[str, tuple[float, float, float, float, float, float, float]] = {
    # name: (a, b, k, c, e, c2, e2)
    "copepods": (0.0, 1.0, 670.0, 10**-6.76, 2.512, 1.0, 1.0),
    "copepods_pl": (0.031, 1.2, 1000.0, 10**-6.76, 2.512, 1.0, 1.0),
    "calanoids_pl": (0.038, 1.2, 1000.0, 10**-6.76, 2.512, 1.0, 1.0),
    "oithona": (0.0, 1.0, 640.0, 10**-6.76, 2.512, 1.0, 1.0),
    "euphausiids": (0.0, 1.0, 1.04, 10**-0.473, 3.174, 1.0, 1.0),
    "euphausiids_tl": (0.34, 2.0, 1.0, 10**-0.473, 3.174, 1.0, 1.0),
    "ostracods": (0.0, 1.0, 1.0, 17.072 * 0.398, 2.545, 1.0, 1.0),
    "hyperiids": (0.0, 1.0, 1.0, 10**2.314 * 1000 * 0.365, 2.957, 1.0, 1.0),
    "hyperiids_tl": (0.17, 1.5, 1.0, 10**2.314 * 1000 * 0.365, 2.957, 1.0, 1.0),
    "crustacea_other": (0.0, 1.0, 1.0, 0.133 * 1000, 2.44, 1.0, 1.0),
    "crustacea_other_tl": (0.064, 1.7, 1.0, 0.133 * 1000, 2.44, 1.0, 1.0),
    "appendicularians": (0.0, 1.0, 0.262, 38.8, 2.574, 0.49, 1.12),
    "appendicularians_tl": (0.074, 0.59, 1.0, 38.8, 2.574, 0.49, 1.12),
    "doliolids": (0.0, 1.0, 0.963, 0.51, 2.28, 1.0, 1.0),
    "salps": (0.0, 1.0, 1.001, 1.49, 2.0, 1.0, 1.0),
    "pyrosomes": (0.0, 1.0, 1.0, 0.111 * 0.113 * 1000, 1.90, 1.0, 1.0),
    "thecosomes": (0.0, 1.0, 1.0, 10**1.469, 3.102, 1.0, 1.0),
    "chaetognaths": (0.0, 1.0, 1.0, 0.0956, 2.9093, 1.0, 1.0),
    "chaetognaths_tl": (0.25, 4.2, 1.0, 0.0956, 2.9093, 1.0, 1.0),
    "polychaetes": (0.0, 1.0, 1.0, 7.58, 1.3848, 1.0, 1.0),
    "hydrozoans": (0.0, 1.0, 1.0, 20.47, 0.834, 1.0, 1.0),
}

# Relation per category when only the equivalent diameter is used.
ESD_RELATIONS = {
    "Copepoda<Maxillopoda": "copepods",
    "Calanoida": "copepods_pl",
    "Oithonidae": "copepods_pl",
    "Harpacticoida": "copepods_pl",
    "Poecilostomatoida": "copepods_pl",
    "Eucalanidae": "copepods_pl",
    "Euphausiacea": "euphausiids",
    "Hydrozoa": "hydrozoans",
    "Polychaeta": "polychaetes",
    "Ostracoda": "ostracods",
    "Eumalacostraca": "crustacea_other_tl",
    "tetrazoid": "pyrosomes",
    "Salpida": "salps",
    "Hyperiidea": "hyperiids_tl",
    "Pteropoda": "thecosomes",
    "Doliolida": "doliolids",
    "Chaetognatha": "chaetognaths_tl",
}
# Relation per category when feret length is used; the listed copepods still use
# the equivalent diameter.
FERET_RELATIONS = {
    "Copepoda<Maxillopoda": "copepods_pl",
    "Calanoida": "calanoids_pl",
    "Oithonidae": "oithona",
    "Harpacticoida": "copepods_pl",
    "Poecilostomatoida": "copepods_pl",
    "Eucalanidae": "copepods_pl",
    "Euphausiacea": "euphausiids",
    "Hydrozoa": "hydrozoans",
    "Polychaeta": "polychaetes",
    "Ostracoda": "ostracods",
    "Eumalacostraca": "euphausiids",
    "tetrazoid": "pyrosomes",
    "Salpida": "salps",
    "Hyperiidea": "hyperiids",
    "Pteropoda": "thecosomes",
    "Doliolida": "doliolids",
    "Chaetognatha": "chaetognaths",
    "Oikopleuridae": "appendicularians",
}
ESD_IN_FERET_MODE = [
    "Copepoda<Maxillopoda", "Calanoida", "Harpacticoida", "Poecilostomatoida", "Eucalanidae",
]
DEFAULT_MODE_CHANGES = {"Eumalacostraca": "crustacea_other"}


def valid(df: DataFrame, status: str = "status", hierarchy: str = "hierarchy") -> DataFrame:
    """Validated living objects."""
    dead = F.lower(F.col(hierarchy)).contains("not-living")
    return df.where((F.col(status) == "validated") & ~dead)


def drop_categories(df: DataFrame, category: str = "category", names: Sequence[str] = EXCLUDED_CATEGORIES) -> DataFrame:
    return df.where(~F.col(category).isin(list(names)))


def geometry(df: DataFrame, pixel_mm: float | str = PIXEL_MM) -> DataFrame:
    """Millimetre lengths and areas, three equivalent diameters and the sample concentration.

    ``pixel_mm`` is the pixel size of all objects, or the name of the column that holds each one's.
    """
    pixel = F.col(pixel_mm) if isinstance(pixel_mm, str) else F.lit(pixel_mm)
    length = {n: F.col(f"{n}_px") * pixel for n in ("feret", "major", "minor")}
    area = {n: F.col(f"{n}_px") * F.pow(pixel, F.lit(2.0)) for n in ("area", "area_exc")}
    ellipse = F.lit(math.pi) * length["major"] / 2 * length["minor"] / 2

    def diameter(a: Column) -> Column:
        return 2 * F.sqrt(a / math.pi)

    return df.withColumns(
        {
            **{f"{n}_mm": c for n, c in length.items()},
            **{f"{n}_mm2": c for n, c in area.items()},
            "ellipse_mm2": ellipse,
            "esd_mm": diameter(area["area"]),
            "esd_exc_mm": diameter(area["area_exc"]),
            "esd_ellipse_mm": diameter(ellipse),
            "sample_conc": ratio("sub_part", "tot_vol") * F.col("depth_max"),
        }
    )


def size_class(df: DataFrame, length: str = "feret_mm") -> DataFrame:
    """Size class by the first rule that holds, and its numeric code."""
    x = F.col(length)
    label = (
        F.when(x <= 0.5, "0.2-0.5").when((x >= 0.5) & (x < 1), "0.5-1").when(x <= 2, "1-2").when(x > 2, ">2")
    )
    codes = {"0.2-0.5": 0.2, "0.5-1": 0.5, "1-2": 1.0, ">2": 2.0}
    lookup = F.create_map(*[F.lit(v) for v in chain.from_iterable(codes.items())])
    return df.withColumn("size_fraction", label).withColumn("size_code", lookup[F.col("size_fraction")])


def _relations(mode: str) -> dict[str, str]:
    if mode == "esd":
        return ESD_RELATIONS
    return FERET_RELATIONS if mode == "feret" else {**FERET_RELATIONS, **DEFAULT_MODE_CHANGES}


def length_to_carbon(
    df: DataFrame, mode: str = "feret", category: str = "category", out: str = "carbon_ug"
) -> DataFrame:
    """Carbon content of each object from its length; NULL without a relation or a valid length.

    The coefficients travel in the plan as one constant map, so no join is needed. A mode other
    than ``esd`` or ``feret`` is the feret table with its default changes.
    """
    names = "a b k c e c2 e2".split()
    table = list(
        chain.from_iterable(
            (F.lit(cat), F.struct(*[F.lit(float(v)).alias(n) for n, v in zip(names, RELATIONS[rel])]))
            for cat, rel in _relations(mode).items()
        )
    )
    q = F.create_map(*table)[F.col(category)]
    length = F.col("esd_mm")
    if mode != "esd":
        length = F.when(F.col(category).isin(ESD_IN_FERET_MODE), length).otherwise(F.col("feret_mm"))
    base = q["k"] * (length / q["b"] - q["a"])
    carbon = q["c2"] * F.pow(q["c"] * F.pow(base, q["e"]), q["e2"])
    return df.withColumn(out, F.when(base > 0, carbon))


def biomass(
    df: DataFrame, sample: str = "sample_id", category: str = "category", carbon: str = "carbon_ug",
    clr_part: Sequence[str] | None = None,
) -> DataFrame:
    """Counts and biomass per sample, size class and category, with sample totals, shares, areal
    values and the log-ratio of areal biomass (per sample unless ``clr_part`` says otherwise)."""
    keys = [sample, "size_fraction", "size_code"]
    cells = df.groupBy(*keys, category).agg(
        F.count(F.lit(1)).alias("n"),
        (F.coalesce(F.sum(carbon), F.lit(0.0)) / 1000).alias("carbon_mg"),
        F.avg("sample_conc").alias("sample_conc"),
    )
    # one row per category of the fixed list: groups are small whatever the number of objects
    cells = add_group_aggs(
        cells, [sample, "size_fraction"], {"total": F.sum("n"), "carbon_mg_sample": F.sum("carbon_mg")}, bounded=True
    )
    cells = cells.withColumns(
        {
            "relative_abundance": ratio("n", "total"),
            "ln_carbon_taxon": F.ln(F.col("carbon_mg") * 1000),
            "ln_carbon_sample": F.ln(F.col("carbon_mg_sample") * 1000),
            "carbon_mg_m2": F.col("carbon_mg") * F.col("sample_conc"),
            "carbon_mg_m2_sample": F.col("carbon_mg_sample") * F.col("sample_conc"),
            "abundance_m2": F.col("n") * F.col("sample_conc"),
        }
    )
    cells = cells.withColumn("biomass_share", ratio("carbon_mg_m2", "carbon_mg_m2_sample"))
    part = [sample] if clr_part is None else clr_part
    return composition.clr(cells, part, "carbon_mg_m2", "biomass_clr", bounded=clr_part is None)


def relative_abundance(df: DataFrame, sample: Sequence[str], cell: Sequence[str]) -> DataFrame:
    """Share of each cell in the objects of its sample."""
    counts = df.groupBy(*sample, *cell).agg(F.count(F.lit(1)).alias("n"))
    return share(counts, sample, "n", "relative_abundance")


def biomass_areal(
    weights: DataFrame, volumes: DataFrame, depths: DataFrame, key: str, weight: str = "biomass_dry",
    depth: str = "fixed", depth_m: float = FIXED_DEPTH_M,
) -> DataFrame:
    """Dry weight of the whole catch per square metre.

    The weighed split is scaled up, negative weights become NULL, missing depths the default.
    ``depth`` chooses between the fixed tow depth and the depth column.
    """
    joined = weights.join(volumes, key, "left").join(depths, key, "left")
    scaled = F.col(weight) * SPLIT_FACTOR
    clean = joined.withColumns(
        {weight: valid_or_null(scaled, scaled >= 0), "depth_m": F.coalesce("depth_m", F.lit(depth_m))}
    )
    used = F.lit(depth_m) if depth == "fixed" else F.col("depth_m")
    return clean.withColumn("biomass_mg_m2", ratio(weight, "volume_m3") * used)
