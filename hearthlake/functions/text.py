"""Text keys and classifiers as columns."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def _marked() -> tuple[str, str]:
    """Lower-case letters of the Latin blocks that are an ASCII letter with marks, and those letters."""
    pairs = [(c, unicodedata.normalize("NFD", c)[0]) for c in map(chr, [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]) if c == c.lower()]
    pairs = [(c, p) for c, p in pairs if p != c and p.isascii()]
    return "".join(c for c, _ in pairs), "".join(p for _, p in pairs)


MARKED, PLAIN = _marked()
# Prefixes of streets, house numbers.
STREET_PREFIX = r"^(ul|al|pl|os|skr|bulw|aleja|bulwar|osiedle)\s+"
HOUSE_NUMBER = r"(\d+[a-z]?(?:\s+[a-z]?\d+[a-z]?)*)$"


def norm_key(s: Column) -> Column:
    """Lower case, marks off (but l with stroke, which has none), other characters to single spaces."""
    plain = F.translate(F.regexp_replace(F.lower(s), "[\u0300-\u036f]", ""), MARKED, PLAIN)
    return F.trim(F.regexp_replace(F.regexp_replace(plain, "[^a-z0-9 ]", " "), r"\s+", " "))


def norm_district(s: Column) -> Column:
    """norm_key with l for l with stroke, and nothing but letters and digits."""
    return F.regexp_replace(norm_key(F.translate(F.lower(s), "ł", "l")), "[^a-z0-9]", "")


def norm_street(s: Column, spaces: bool = True) -> Column:
    """norm_key of what comes after the prefix; l with stroke is deleted; without ``spaces`` so are they."""
    keyed = F.regexp_replace(norm_key(F.translate(F.lower(s), "ł", "")), STREET_PREFIX, "")
    return keyed if spaces else F.translate(keyed, " ", "")


def tidy_district(s: Column) -> Column:
    """Trimmed, lower case, single spaces; empty is null."""
    return F.nullif(F.regexp_replace(F.lower(F.trim(s)), r"\s+", " "), F.lit(""))


def street_number(address: Column) -> tuple[Column, Column]:
    """(street, number) of the part before the first comma; both null without a street."""
    keyed = norm_key(F.get(F.split(address, ","), F.lit(0)))
    street = F.nullif(F.trim(F.regexp_replace(F.regexp_replace(keyed, STREET_PREFIX, ""), r"\s*" + HOUSE_NUMBER, "")), F.lit(""))
    number = F.nullif(F.regexp_replace(F.regexp_extract(keyed, HOUSE_NUMBER, 1), r"\s", ""), F.lit(""))
    return street, F.when(street.isNotNull(), number)


def street_key(street: Column) -> Column:
    s = F.regexp_replace(F.lower(F.coalesce(street, F.lit(""))), r"\bul\.?\s+", "")
    return F.trim(F.regexp_replace(s, r"\s+", " "))


def clip(s: Column, most: int = 20_000) -> Column:
    """White space collapsed, trimmed, cut; empty is null."""
    return F.nullif(F.left(F.trim(F.regexp_replace(s, r"\s+", " ")), F.lit(most)), F.lit(""))


def first_number(s: Column) -> Column:
    """The first number of a text with space-grouped thousands and a decimal comma or point."""
    found = F.regexp_extract(F.translate(s, "  ", "  "), r"(\d{1,3}(?: \d{3})+(?:[.,]\d+)?|\d+(?:[.,]\d+)?)", 1)
    return F.regexp_replace(F.translate(found, ",", "."), " ", "").try_cast("double")


def content_hash(version: str, *parts: Column, between: str = "\u0000") -> Column:
    return F.sha2(F.concat_ws(between, F.lit(version), *(F.coalesce(p, F.lit("")) for p in parts)), 256)


def flags(s: Column, patterns: dict[str, str]) -> list[Column]:
    """One boolean for each pattern; null text has none set."""
    return [F.coalesce(s.rlike(f"(?iu){p}"), F.lit(False)).alias(name) for name, p in patterns.items()]


def positive_number(json: str, key: str) -> Column:
    """A JSON value over 0 if it is a number, not a string that looks like one; else 0."""
    value = F.try_variant_get(F.try_parse_json(F.col(json)), f"$.{key}", "variant")
    number = F.schema_of_variant(value).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL|INT|SMALLINT|TINYINT)")
    found = F.try_variant_get(value, "$", "double")
    return F.when(number & (found > 0), found).otherwise(0.0)


def labels(s: Column | str, between: str = ";") -> Column:
    """Parts of a list in one string, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(s, between), lambda x: F.trim(x)), lambda x: x != "")


def key_range(key: Column, prefix: str) -> Column:
    """Keys with the prefix as a half-open range, which a scan can skip files by."""
    return (key >= prefix) & (key < prefix[:-1] + chr(ord(prefix[-1]) + 1))


# What portals call the three kinds, feeds that had flats only, and words of titles.
KINDS = {
    "apartment": "apartment flat block tenement ribbon serviced_apartment aparthotel condominium loft mieszkanie kawalerka apartament".split(),
    "house": [
        *"house dom domy cabin cottage chalet tiny_house bungalow townhouse villa vacation_home farmhouse farmstay ranch barn hut treehouse earthhouse dome houseboat".split(),
        *"shepherds_hut shipping_container tipi tower castle cave nature_eco_lodge casa_particular".split(), "shepherds hut",
    ],
    "plot": "plot land place terrain działka dzialka dzialki grunt grunty".split(),
}
FLAT_FEEDS = "otodom otodom-rent olx morizon gratka domiporta nieruchomosci-online rynekpierwotny".split()
PLOT_WORDS = "dzia[łl]k|nieruchomo[śćs]c gruntow|grunt(?:owa|owej|owe|owych)?\\s+niezabudow"
BUILT_PLOT_WORDS = "grunt(?:owa|owej|owe|owych)?\\s+zabudow"
HOUSE_WORDS = "budynek mieszkalny|dom(?:y|ek)? (?:jednorodzinny|wolnostoj|w zabudowie)|bli[źni]niak|segment(?:y|ów)?\\b|domek letniskow"
FLAT_WORDS = "\\bmieszkanie|\\bapartament|\\bpok[óo]j do wynaj"
FLAG_WORDS = {
    "panoramic_view": "panoram|widok na miasto|panorama miasta|widok z wysokiego piętra|widok z okna na miasto",
    "mountain_view": "widok na tatry|widok na góry|widok na beskidy|widok na karpaty|widok na pasmo",
    "water_view": "widok na wisłę|widok na rzekę|widok na jezioro|widok na zalew|pierwsza linia brzegowa|brzeg rzeki|nad wodą|nad jeziorem|nad rzeką",
    "park_view": "widok na park|przy parku|obok parku|w pobliżu parku|park naprzeciwko|park za rogiem",
    "forest_view": "widok na las|przy lesie|obok lasu|nad lasem|las za domem|las za działką",
    "quiet": "cicha okolica|spokojna okolica|spokojna ulica|cicha ulica|zielona i cicha|kameralna okolica",
    "air_conditioning": "klimatyzac",
    "fireplace": "kominek|kominkiem",
    "energy_efficient": "energooszczęd|niskoenergetycz|pasywn|rekuperac|pompa ciepła|fotowoltaik|panel fotowoltaiczny",
    "renovated": "po remoncie|po generalnym remoncie|odświeżon|wysoki standard|nowoczesne wykończenie|nowa instalacja",
    "south_facing": "południow|ekspozycja południowa|nasłonecznion|słoneczn",
    "utilities": "media|prąd|energia elektryczna|wodociąg|woda z sieci|kanalizacja|gaz ziemny|szambo|studnia",
    "building_permit": "pozwolenie na budowę|pozwolenia na budowę|mpzp|plan zagospodarowania przestrzennego|warunki zabudowy",
    "flood_risk": "zalewow|powódź|powodzi|teren zalewowy|ryzyko powodzi",
    "busy_road": "ruchliwa|głośna ulica|przy głównej drodze|przy trasie|hałas|duży ruch samochodów",
}


def uniqueness_flags(s: Column) -> dict[str, Column]:
    """The flags of FLAG_WORDS by name."""
    return dict(zip(FLAG_WORDS, flags(s, FLAG_WORDS), strict=True))


def property_kind(source: Column, title: Column, kind: Column, external_id: Column) -> Column:
    """apartment, house or plot by the portal's type, else words of the title, else what the feed has; null without evidence.

    Investments are none of these, whatever their title says.
    """
    said = F.lower(F.coalesce(kind, F.lit("")))
    words = F.coalesce(title, F.lit(""))
    has = lambda p: words.rlike(f"(?iu){p}")
    stand_in = F.coalesce(external_id.startswith("inv-"), F.lit(False))
    none = F.lit(None).cast("string")
    out = F.when((source == "budujesie") | ((source == "investmap") & stand_in) | (said == "inwestycja"), none)
    for name, types in KINDS.items():
        out = out.when(said.isin(types), name)
    out = out.when(has(PLOT_WORDS), F.when(has(BUILT_PLOT_WORDS), "house").otherwise("plot")).when(has(HOUSE_WORDS), "house").when(has(FLAT_WORDS), "apartment")
    return out.when((source == "investmap") | source.isin(FLAT_FEEDS), "apartment")
