"""Numbers, units and scales, as Column expressions. Nothing missing ever becomes zero."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import norm

# Accepted spellings of units, by canonical unit; conversions (factor, offset).
ACCEPTED = {
    "degC": ["degc", "c", "℃"], "h^-1": ["h^-1", "h-1", "1/h"], "%": ["%", "percent", "vol%"], "ppm": ["ppm", "ppmv"],
    "m2/g": ["m2/g", "m2g-1"], "cm3/g": ["cm3/g", "cm3g-1"], "nm": ["nm"], "mmol/g": ["mmol/g"], "kJ/mol": ["kj/mol"],
    "h": ["h", "hr", "hours"], "wt%": ["wt%", "wt.%"], "1": ["1", "ratio", "dimensionless"], "bar": ["bar"],
    "Å": ["å", "angstrom"], "s^-1": ["s^-1", "s-1", "1/s"],
}
CONVERTED = {("degC", "k"): (1.0, -273.15), ("h", "min"): (1 / 60, 0.0), ("mmol/g", "umol/g"): (1 / 1000, 0.0), ("mmol/g", "μmol/g"): (1 / 1000, 0.0), ("mmol/g", "µmol/g"): (1 / 1000, 0.0)}
ABSOLUTE_ZERO = -273.15
EV_TO_KJ_MOL = 96.4853321233100184
NUMBER = r"[+-]?(?:\d+(?:\.\d*)?|\.\d+)(?:[eE][+-]?\d+)?"
NUMBER_WORDS = {"one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10, "一": 1, "二": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9, "十": 10}


def finite(c: Column) -> Column:
    """The double, or null where it isn't finite."""
    value = c.cast("double")
    return F.when(~F.isnan(value) & (F.abs(value) < F.lit(float("inf"))), value)


def number(c: Column) -> Column:
    """A finite number written in full; null for anything else."""
    text = F.trim(c)
    return finite(F.when(text.rlike(f"^{NUMBER}$"), text.try_cast("double")))


def unit_key(c: Column) -> Column:
    return F.replace(F.replace(F.lower(norm(c)), F.lit(" "), F.lit("")), F.lit("°"), F.lit("deg"))


def exact_scalar(c: Column) -> Column:
    """An exact scalar: thousands commas and an uncertainty in the last digits are read; ranges,
    bounds and formulas are not."""
    text = F.regexp_replace(norm(c), r"(?<=\d),(?=\d{3}(?:\D|$))", "")
    centre = F.regexp_extract(text, r"^([+-]?(?:\d+(?:\.\d*)?|\.\d+))\(\d+\)$", 1)
    return number(F.when(centre != "", centre).otherwise(text))


def quantity(raw: Column, unit: Column, target: Column, accepted: dict = ACCEPTED, converted: dict = CONVERTED) -> Column:
    """struct(value, issue): an exact scalar in the canonical unit ``target``.

    Issues: non_scalar_or_missing, unknown_unit, non_finite, out_of_range. The unit tables are
    literals, so no join is needed.
    """
    text = F.regexp_replace(norm(raw), r"(?<=\d),(?=\d{3}(?:\D|$))", "")
    text = F.regexp_replace(text, r"^([+-]?(?:\d+(?:\.\d*)?|\.\d+))\(\d+\)$", "$1")
    scales = {(t, u): (1.0, 1.0, 0.0) for t, spellings in accepted.items() for u in spellings}
    scales |= {k: (1.0, 1.0, offset) if factor == 1.0 else (1.0, float(round(1 / factor)), 0.0) for k, (factor, offset) in converted.items()}
    known = F.create_map(*[x for (t, u), (_, over, offset) in scales.items() for x in (F.lit(f"{t}|{u}"), F.struct(F.lit(over).alias("over"), F.lit(offset).alias("offset")))])
    step = F.struct(
        F.when(F.coalesce(text.rlike(f"^{NUMBER}$"), F.lit(False)), text.try_cast("double")).alias("x"),
        F.try_element_at(known, F.concat(target, F.lit("|"), unit_key(F.coalesce(unit, F.lit(""))))).alias("scale"),
    )

    def judged(s: Column) -> Column:
        value = s["x"] / s["scale"]["over"] + s["scale"]["offset"]
        outside = F.when(target.isin("%", "wt%"), ~value.between(0, 100)).when(target == "degC", value < ABSOLUTE_ZERO).otherwise(value < 0)
        issue = F.when(s["x"].isNull(), "non_scalar_or_missing").when(s["scale"].isNull(), "unknown_unit").when(finite(value).isNull(), "non_finite").when(outside, "out_of_range")
        return F.struct(F.when(issue.isNull(), value).alias("value"), issue.alias("issue"))

    # an array of one, so that each step is computed once
    return F.element_at(F.transform(F.array(step), judged), 1)


def standard_target(value: Column, unit: Column, energy: Column | None = None) -> Column:
    """struct(y, y_unit, method): % to fraction, kJ/mol to eV for energies; invalid gives null y."""
    energy = F.lit(False) if energy is None else energy
    percent, fraction = unit == "%", unit == "fraction"
    y = F.when(percent & value.between(0, 100), value * 0.01).when(fraction & value.between(0, 1), value)
    y = F.when(percent | fraction, y).when(energy & (unit == "kJ/mol"), value / EV_TO_KJ_MOL).when(energy, value).when(value >= 0, value)
    target = F.when(percent | fraction, "fraction").when(energy, "eV").otherwise(unit)
    method = F.when(percent, "percent_to_fraction").when(energy & (unit == "kJ/mol"), "kJ_mol_to_eV").otherwise("identity")
    return F.struct(finite(y).alias("y"), target.alias("y_unit"), method.alias("method"))


def calibrate(pixel: Column, pixel1: Column, pixel2: Column, value1: Column, value2: Column, log: Column) -> Column:
    """A pixel on a two-point axis; null for equal anchors, or anchors a log axis can't have."""
    share = F.try_divide(pixel - pixel1, pixel2 - pixel1)
    linear = value1 + share * (value2 - value1)
    power = F.when((value1 > 0) & (value2 > 0), F.pow(F.lit(10.0), F.log10(value1) + share * (F.log10(value2) - F.log10(value1))))
    return F.when(value1 != value2, F.when(log, power).otherwise(linear))


def resolution(pixel: Column, *axis: Column) -> Column:
    """What one pixel is worth at a place of the axis."""
    return F.abs(calibrate(pixel + 0.5, *axis) - calibrate(pixel - 0.5, *axis))


def round_half_up(c: Column, digits: int) -> Column:
    """floor(x * 10^d + 0.5) / 10^d: the same on every engine."""
    scale = 10.0**digits
    return F.floor(c * scale + 0.5) / scale


def utility(y: Column, mode: Column, low: Column, high: Column, left: Column, right: Column) -> Column:
    """struct(score, clipped): 0-100 by a single metric's goal; null where it is disabled."""
    up, down = (y - low) / (high - low), (high - y) / (high - low)
    inside = F.when(y < left, (y - low) / (left - low)).when(y > right, (high - y) / (high - right)).otherwise(1.0)
    u = F.when(mode == "higher", up).when(mode == "lower", down).when(mode == "target_range", inside)
    score = F.when(u.isNotNull(), round_half_up(F.least(F.greatest(u, F.lit(0.0)), F.lit(1.0)) * 100, 2))
    return F.struct(score.alias("score"), (~u.between(0, 1)).alias("clipped"))


def year(c: Column) -> Column:
    """The first plausible year of a text."""
    return F.nullif(F.regexp_extract(c, r"\b((?:19|20)\d{2})\b", 1), F.lit("")).try_cast("int")


def fresh(at: Column, now: Column, seconds: int = 86_400) -> Column:
    age = now.cast("timestamp").cast("double") - at.cast("timestamp").cast("double")
    return (age >= 0) & (age < seconds)


def spoken_number(c: Column) -> Column:
    """A number in digits or one of the number words."""
    words = F.create_map(*[F.lit(x) for kv in NUMBER_WORDS.items() for x in (kv[0], float(kv[1]))])
    return F.coalesce(number(c), F.try_element_at(words, F.lower(F.trim(c))))


def value_label(operator: Column, value: Column, high: Column, unit: Column) -> Column:
    symbol = F.create_map(*[F.lit(x) for kv in {"eq": "", "gt": ">", "ge": "≥", "lt": "<", "le": "≤", "approx": "≈", "range": "", "unknown": "?"}.items() for x in kv])
    shown = F.concat(F.try_element_at(symbol, operator), value.cast("string"), F.when(operator == "range", F.concat(F.lit("–"), high.cast("string"))).otherwise(F.lit("")))
    return F.rtrim(F.concat(shown, F.lit(" "), F.coalesce(unit, F.lit(""))))
