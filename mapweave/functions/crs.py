"""Names of coordinate reference systems: spellings, equivalents, axis order."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Crs:
    code: str
    name: str
    kind: str
    axis: str
    aliases: tuple[str, ...] = field(default=())

    @property
    def units(self) -> str:
        return "degree" if self.kind == "geographic" else "metre"

    @property
    def authority(self) -> str:
        return "OGC" if self.code.startswith("CRS") else "EPSG"


# Systems that European services advertise, with the axis order of their authority and other spellings.
KNOWN = [
    Crs("CRS:84", "WGS 84 longitude-latitude", "geographic", "lonlat", ("CRS84", "OGC:CRS84", "URN:OGC:DEF:CRS:OGC:1.3:CRS84", "URN:OGC:DEF:CRS:OGC:2:84", "URN:OGC:DEF:CRS:OGC::CRS84")),
    Crs("EPSG:4326", "WGS 84", "geographic", "latlon", ("WGS84", "WGS 84")),
    Crs("EPSG:4258", "ETRS89", "geographic", "latlon", ("ETRS89",)),
    Crs("EPSG:6706", "RDN2008", "geographic", "latlon", ("RDN2008",)),
    Crs("EPSG:4230", "ED50", "geographic", "latlon", ("ED50",)),
    Crs("EPSG:4171", "RGF93 v1", "geographic", "latlon", ("RGF93",)),
    Crs("EPSG:3857", "WGS 84 / Pseudo-Mercator", "projected", "lonlat", ("EPSG:900913", "EPSG:3785", "EPSG:102100", "EPSG:102113", "OSGEO:41001", "GOOGLE:PROJECTION")),
    Crs("EPSG:3035", "ETRS89-extended / LAEA Europe", "projected", "latlon", ("ETRS89-LAEA", "LAEA")),
    Crs("EPSG:3034", "ETRS89-extended / LCC Europe", "projected", "latlon"),
    Crs("EPSG:3003", "Monte Mario / Italy zone 1", "projected", "lonlat", ("GAUSS-BOAGA-OVEST",)),
    Crs("EPSG:3004", "Monte Mario / Italy zone 2", "projected", "lonlat", ("GAUSS-BOAGA-EST",)),
    Crs("EPSG:6707", "RDN2008 / TM32 (N-E)", "projected", "latlon"),
    Crs("EPSG:6708", "RDN2008 / TM33 (N-E)", "projected", "latlon"),
    Crs("EPSG:7791", "RDN2008 / UTM zone 32N", "projected", "lonlat"),
    Crs("EPSG:7792", "RDN2008 / UTM zone 33N", "projected", "lonlat"),
    Crs("EPSG:25832", "ETRS89 / UTM zone 32N", "projected", "lonlat"),
    Crs("EPSG:25833", "ETRS89 / UTM zone 33N", "projected", "lonlat"),
    Crs("EPSG:25830", "ETRS89 / UTM zone 30N", "projected", "lonlat"),
    Crs("EPSG:25831", "ETRS89 / UTM zone 31N", "projected", "lonlat"),
    Crs("EPSG:32632", "WGS 84 / UTM zone 32N", "projected", "lonlat"),
    Crs("EPSG:32633", "WGS 84 / UTM zone 33N", "projected", "lonlat"),
    Crs("EPSG:32628", "WGS 84 / UTM zone 28N", "projected", "lonlat"),
    Crs("EPSG:2154", "RGF93 v1 / Lambert-93", "projected", "lonlat", ("LAMBERT93",)),
    Crs("EPSG:27700", "OSGB36 / British National Grid", "projected", "lonlat", ("BNG",)),
    Crs("EPSG:28992", "Amersfoort / RD New", "projected", "lonlat", ("RDNEW",)),
    Crs("EPSG:31370", "BD72 / Belgian Lambert 72", "projected", "lonlat"),
    Crs("EPSG:2180", "ETRF2000-PL / CS92", "projected", "latlon"),
    Crs("EPSG:3006", "SWEREF99 TM", "projected", "latlon"),
    Crs("EPSG:3067", "ETRS89 / TM35FIN(E,N)", "projected", "lonlat"),
    Crs("EPSG:5514", "S-JTSK / Krovak East North", "projected", "lonlat"),
    Crs("EPSG:23030", "ED50 / UTM zone 30N", "projected", "lonlat"),
    Crs("EPSG:23031", "ED50 / UTM zone 31N", "projected", "lonlat"),
]
# Codes of the same space.
SAME = [["EPSG:3857", "EPSG:900913", "EPSG:3785", "EPSG:102100", "EPSG:102113"], ["EPSG:4326", "CRS:84"], ["EPSG:4258", "EPSG:4937"]]
DIGITS = "0123456789"


def split_name(value: str) -> tuple[str, str] | None:
    """Authority and identifier of a tidied name. The number of parts between the separators tells which kind of spelling it is."""
    def word(x: str, more: str = "") -> bool:
        return bool(x) and all(c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ-" + DIGITS + more for c in x)

    def checked(authority: str, identifier: str) -> tuple[str, str] | None:
        return (authority, identifier) if word(authority) and word(identifier, "._") else None

    if value.startswith("URN:"):
        parts = [x for x in value.split(":") if x]
        named = len(parts) in (6, 7) and parts[1] in ("OGC", "X-OGC") and parts[2:4] == ["DEF", "CRS"]
        return checked(parts[4], parts[-1]) if named else None
    if "://" in value:
        page, _, fragment = value.partition("#")
        if fragment:
            return ("EPSG", fragment) if "EPSG" in page and not fragment.strip(DIGITS) else None
        parts = page.split("/")  # scheme, nothing, host, DEF, CRS, authority, version, identifier
        named = len(parts) == 8 and parts[2].removeprefix("WWW.") == "OPENGIS.NET" and parts[3:5] == ["DEF", "CRS"]
        return checked(parts[5], parts[7]) if named else None
    parts = value.replace("::", ":").split(":")
    if len(parts) == 2:
        return checked(*parts)
    letters = value.rstrip(DIGITS)
    number = value[len(letters) :]
    if not 3 <= len(number) <= 6 or len(parts) > 1:
        return None
    if not letters:
        return "EPSG", number
    return (letters, number) if 3 <= len(letters) <= 6 and not letters.strip("ABCDEFGHIJKLMNOPQRSTUVWXYZ") else None


class Registry:
    """Known systems; add() extends it at run time. Groups of equivalents stay as they are."""

    def __init__(self, known: list[Crs] | None = None):
        self.by_code: dict[str, Crs] = {}
        self.alias: dict[str, str] = {}
        for c in KNOWN if known is None else known:
            self.add(c)

    def add(self, c: Crs) -> None:
        self.by_code[c.code] = c
        for spelling in (c.code, c.code.replace(":", "::", 1), c.code.replace(":", "", 1), *c.aliases, *(a.replace(":", "::", 1) for a in c.aliases)):
            self.alias[" ".join(spelling.split()).upper()] = c.code

    def _look_up(self, table: dict[str, str], key: Column) -> Column:
        return F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)

    def parse(self, text: Column) -> Column:
        """Struct of authority and identifier; null for anything else. The same rules as split_name, over columns."""
        value = tidy(text)
        word = lambda x, more="": x.rlike(f"^[A-Z0-9{more}-]+$")
        checked = lambda a, i: F.when(word(a) & word(i, "._"), F.struct(a.alias("authority"), i.alias("identifier")))
        at = lambda parts, i: F.get(parts, F.lit(i))

        parts = F.filter(F.split(value, ":"), lambda x: x != "")
        urn = F.size(parts).isin(6, 7) & at(parts, 1).isin("OGC", "X-OGC") & (at(parts, 2) == "DEF") & (at(parts, 3) == "CRS")
        of_urn = F.when(urn, checked(at(parts, 4), F.element_at(parts, -1)))

        page, fragment = F.substring_index(value, "#", 1), F.substring_index(value, "#", -1)
        steps = F.split(page, "/")
        place = (F.size(steps) == 8) & at(steps, 2).isin("OPENGIS.NET", "WWW.OPENGIS.NET") & (at(steps, 3) == "DEF") & (at(steps, 4) == "CRS")
        of_fragment = F.when(F.contains(page, F.lit("EPSG")) & (F.translate(fragment, DIGITS, "") == ""), F.struct(F.lit("EPSG").alias("authority"), fragment.alias("identifier")))
        of_url = F.when(F.contains(value, F.lit("#")) & (fragment != ""), of_fragment).when(place, checked(at(steps, 5), at(steps, 7)))

        pair = F.split(F.replace(value, F.lit("::"), F.lit(":")), ":")
        letters = F.rtrim(value, F.lit(DIGITS))
        number = F.substring(value, F.length(letters) + 1, F.length(value))
        plain = (F.size(pair) == 1) & F.length(number).between(3, 6)
        authority = F.when(letters == "", "EPSG").when(F.length(letters).between(3, 6) & letters.rlike("^[A-Z]+$"), letters)
        of_plain = F.when(F.size(pair) == 2, checked(at(pair, 0), at(pair, 1))).when(plain & authority.isNotNull(), F.struct(authority.alias("authority"), number.alias("identifier")))
        return F.when(F.startswith(value, F.lit("URN:")), of_urn).when(F.contains(value, F.lit("://")), of_url).otherwise(of_plain)

    def normalise(self, text: Column) -> Column:
        """The canonical code; unknown codes as authority and identifier; anything else tidied."""
        value = tidy(text)
        p = self.parse(text)
        candidate = F.when((p["authority"] == "OGC") & p["identifier"].rlike("^(CRS)?84$"), F.lit("CRS:84")).otherwise(F.concat_ws(":", p["authority"], p["identifier"]))
        return F.coalesce(self._look_up(self.alias, value), F.when(p.isNotNull(), F.coalesce(self._look_up(self.alias, candidate), candidate)), value)

    def known(self, text: Column) -> Column:
        """The canonical code of a known system, else null."""
        code = self.normalise(text)
        return F.when(code.isin(*self.by_code), code)

    def definition(self, text: Column) -> Column:
        """Struct of code, name, kind, axis order and units of a known system, else null."""
        rows = {c.code: F.struct(F.lit(c.code).alias("code"), F.lit(c.name).alias("name"), F.lit(c.kind).alias("kind"), F.lit(c.axis).alias("axis_order"), F.lit(c.units).alias("units")) for c in self.by_code.values()}
        return F.element_at(F.create_map(*[x for k, v in rows.items() for x in (F.lit(k), v)]), self.normalise(text))

    def equivalents(self, text: Column) -> Column:
        code = self.normalise(text)
        groups = [F.when(code.isin(*g), F.array(*[F.lit(c) for c in g])) for g in SAME]
        return F.coalesce(*groups, F.array(code))

    def same(self, a: Column, b: Column) -> Column:
        a, b = self.normalise(a), self.normalise(b)
        return same_codes(a, b)

    def is_geographic(self, text: Column) -> Column:
        return F.coalesce(self.normalise(text).isin(*[c.code for c in self.by_code.values() if c.kind == "geographic"]), F.lit(False))

    def latitude_first(self, text: Column, version: Column | None = None) -> Column:
        """WMS 1.1 is always longitude first, and so is every unknown system."""
        return self.code_latitude_first(self.normalise(text), version)

    def code_latitude_first(self, code: Column, version: Column | None = None) -> Column:
        """The same for codes that are canonical already, as in layer rows."""
        first = F.coalesce(code.isin(*[c.code for c in self.by_code.values() if c.axis == "latlon"]), F.lit(False))
        return first if version is None else first & ~F.coalesce(version.isin("1.1.0", "1.1.1"), F.lit(False))

    def axis_order(self, text: Column, version: Column | None = None) -> Column:
        return F.when(self.latitude_first(text, version), "latlon").otherwise("lonlat")


def tidy(text: Column) -> Column:
    return F.upper(F.trim(F.regexp_replace(F.trim(text), r"\s+", " ")))


def same_codes(a: Column, b: Column) -> Column:
    """Whether canonical codes are equal or equivalent."""
    out = a == b
    for g in SAME:
        out = out | (a.isin(*g) & b.isin(*g))
    return out


REGISTRY = Registry()
