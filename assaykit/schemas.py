"""Registries and record types."""

from __future__ import annotations

from pyspark.sql import types as T

# Property -> (category, canonical unit).
FIELDS = {
    "si_content": ("composition", "wt%"), "al_content": ("composition", "wt%"), "cu_content": ("composition", "wt%"),
    "isolated_cu_content": ("composition", "wt%"), "si_al_ratio": ("composition", "1"), "cu_al_ratio": ("composition", "1"),
    "cu_per_cage": ("composition", "1"), "isolated_cu_al_ratio": ("composition", "1"), "isolated_cu_per_cage": ("composition", "1"),
    "anr": ("condition", "1"), "critical_anr": ("performance", "1"), "hydrothermal_temperature": ("synthesis", "degC"),
    "hydrothermal_time": ("synthesis", "h"), "temperature": ("condition", "degC"), "pressure": ("condition", "bar"),
    "ghsv": ("condition", "h^-1"), "no_inlet": ("condition", "ppm"), "no2_inlet": ("condition", "ppm"), "nh3_inlet": ("condition", "ppm"),
    "o2_inlet": ("condition", "%"), "h2o_inlet": ("condition", "%"), "so2_inlet": ("condition", "ppm"), "time_on_stream": ("condition", "h"),
    "no_conversion": ("performance", "%"), "nox_conversion": ("performance", "%"), "nh3_conversion": ("performance", "%"),
    "n2_selectivity": ("performance", "%"), "n2o_concentration": ("performance", "ppm"), "t50": ("performance", "degC"), "t90": ("performance", "degC"),
    "bet_surface_area": ("characterization", "m2/g"), "pore_volume": ("characterization", "cm3/g"), "pore_diameter": ("characterization", "nm"),
    "crystallite_size": ("characterization", "nm"), "acid_amount": ("characterization", "mmol/g"), "activation_energy": ("characterization", "kJ/mol"),
    "apparent_activation_energy": ("characterization", "kJ/mol"), "active_site_distance": ("characterization", "Å"),
    "active_site_type": ("characterization", "text"), "acid_site_type": ("characterization", "text"), "mo_oxidation_state": ("characterization", "1"),
    "coordination_number": ("characterization", "1"), "bond_distance": ("characterization", "Å"), "turnover_frequency": ("performance", "s^-1"),
    "calcination_temperature": ("synthesis", "degC"), "calcination_time": ("synthesis", "h"), "loading": ("composition", "wt%"),
}
# Header spellings of properties.
ALIASES = {
    "si_content": ["si content"], "al_content": ["al content"], "cu_content": ["cu content"], "si_al_ratio": ["si/al ratio"],
    "cu_al_ratio": ["cu/al ratio"], "cu_per_cage": ["cu-ion per cha cage"], "temperature": ["temperature", "reaction temperature", "温度", "反应温度"],
    "ghsv": ["ghsv", "空速"], "no_conversion": ["no conversion", "no转化率"], "nox_conversion": ["nox conversion", "nox转化率"],
    "nh3_conversion": ["nh3 conversion"], "n2_selectivity": ["n2 selectivity", "n2选择性"], "pressure": ["pressure", "reaction pressure", "反应压力"],
    "bet_surface_area": ["bet surface area", "surface area", "sbet", "比表面积"], "pore_volume": ["pore volume", "孔容"],
    "pore_diameter": ["pore diameter", "孔径"], "coordination_number": ["cn", "coordination number"],
    "bond_distance": ["r", "bond distance", "interatomic distance"], "active_site_distance": ["active site distance"],
    "apparent_activation_energy": ["apparent activation energy"], "turnover_frequency": ["tof", "tofs", "turnover frequency"],
}
DECISIONS = ("target", "review", "non_target")

BLOCK = T.StructType([
    T.StructField("source", T.StringType()), T.StructField("kind", T.StringType()), T.StructField("locator", T.StringType()),
    T.StructField("ord", T.LongType()), T.StructField("text", T.StringType()), T.StructField("row", T.MapType(T.StringType(), T.StringType())),
])
BIBLIOGRAPHIC = T.StructType([
    T.StructField("ord", T.LongType()), T.StructField("doi", T.StringType()), T.StructField("title", T.StringType()),
    T.StructField("abstract", T.StringType()), T.StructField("year", T.IntegerType()), T.StructField("journal", T.StringType()),
    T.StructField("authors", T.ArrayType(T.StringType())), T.StructField("source_names", T.ArrayType(T.StringType())),
    T.StructField("source_ids", T.MapType(T.StringType(), T.StringType())),
])


def header_map() -> dict[str, str]:
    """Header spelling -> property."""
    out: dict[str, str] = {}
    for name in FIELDS:
        for spelling in (name, name.replace("_", " "), *ALIASES.get(name, [])):
            out.setdefault(spelling, name)
    return out
