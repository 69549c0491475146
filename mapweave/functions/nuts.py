"""Countries and statistical regions (NUTS)."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from mapweave.schema import EU

# NUTS code, ISO code where it differs, name. The first 27 are members of the Union.
COUNTRIES = [
    ("AT", "AT", "Austria"), ("BE", "BE", "Belgium"), ("BG", "BG", "Bulgaria"), ("CY", "CY", "Cyprus"), ("CZ", "CZ", "Czechia"), ("DE", "DE", "Germany"),
    ("DK", "DK", "Denmark"), ("EE", "EE", "Estonia"), ("EL", "GR", "Greece"), ("ES", "ES", "Spain"), ("FI", "FI", "Finland"), ("FR", "FR", "France"),
    ("HR", "HR", "Croatia"), ("HU", "HU", "Hungary"), ("IE", "IE", "Ireland"), ("IT", "IT", "Italy"), ("LT", "LT", "Lithuania"), ("LU", "LU", "Luxembourg"),
    ("LV", "LV", "Latvia"), ("MT", "MT", "Malta"), ("NL", "NL", "Netherlands"), ("PL", "PL", "Poland"), ("PT", "PT", "Portugal"), ("RO", "RO", "Romania"),
    ("SE", "SE", "Sweden"), ("SI", "SI", "Slovenia"), ("SK", "SK", "Slovakia"),
    ("CH", "CH", "Switzerland"), ("IS", "IS", "Iceland"), ("LI", "LI", "Liechtenstein"), ("NO", "NO", "Norway"), ("UK", "GB", "United Kingdom"),
    ("AL", "AL", "Albania"), ("BA", "BA", "Bosnia and Herzegovina"), ("ME", "ME", "Montenegro"), ("MD", "MD", "Moldova"), ("MK", "MK", "North Macedonia"),
    ("RS", "RS", "Serbia"), ("TR", "TR", "Türkiye"), ("UA", "UA", "Ukraine"), ("XK", "XK", "Kosovo"),
]
MEMBERS = 27
PATTERN = "^[A-Z]{2}[A-Z0-9]{0,3}$"


def _look_up(pairs: list[tuple[str, str]], key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in pairs for x in kv]), key)


def iso_countries(spark: SparkSession) -> list[str]:
    """ISO 3166-1 alpha-2 codes as the JVM has them, and the user-assigned code of Kosovo."""
    return sorted({*spark._jvm.java.util.Locale.getISOCountries(), "XK"})


def is_country(code: Column, iso: list[str]) -> Column:
    return F.coalesce(code.isin(EU, *iso), F.lit(False))


def is_nuts_country(code: Column) -> Column:
    return F.coalesce(code.isin(EU, *[c[0] for c in COUNTRIES]), F.lit(False))


def is_valid(code: Column) -> Column:
    return F.coalesce(code.rlike(PATTERN) & ((code == EU) | F.substring(code, 1, 2).isin(*[c[0] for c in COUNTRIES])), F.lit(False))


def level(code: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(3), F.length(F.trim(code)) - 2))


def parent(code: Column) -> Column:
    c = F.trim(code)
    return F.when(F.length(c) > 2, F.substring(c, F.lit(1), F.length(c) - 1))


def ancestors(code: Column) -> Column:
    """Nearest first; empty for countries."""
    c = F.trim(code)
    longer = F.length(c) > 2
    sizes = F.sequence(F.when(longer, F.length(c) - 1).otherwise(2), F.lit(2), F.lit(-1))
    return F.when(longer, F.transform(sizes, lambda n: F.substring(c, F.lit(1), n))).otherwise(F.array().cast("array<string>"))


def country(code: Column) -> Column:
    return F.substring(F.trim(code), 1, 2)


def within(code: Column, ancestor: Column) -> Column:
    """By prefix, whatever its length."""
    return F.startswith(F.trim(code), F.trim(ancestor))


def to_iso(code: Column) -> Column:
    return _look_up([(n, i) for n, i, _ in COUNTRIES], country(code))


def from_iso(iso: Column) -> Column:
    return _look_up([(i, n) for n, i, _ in COUNTRIES], F.upper(F.trim(iso)))


def of_country(code: Column) -> Column:
    return F.when(code == EU, F.lit(EU)).otherwise(from_iso(code))


def country_name(code: Column) -> Column:
    """By NUTS code: ISO codes that differ from it have no name here."""
    return _look_up([(n, name) for n, _, name in COUNTRIES], country(code))


def is_member(code: Column) -> Column:
    return F.coalesce(country(code).isin(*[c[0] for c in COUNTRIES[:MEMBERS]]), F.lit(False))
