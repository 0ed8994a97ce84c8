"""What an offer's prose states: heating, the kind of building, monthly fees. All as columns.

A phrase that is negated within the 60 characters before it states nothing. Word characters are ASCII ones, as in the patterns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import cut
from .crs import once

LOOK_BACK = 60
# Patterns of the lexicon in the order in which they are tried, and what negates one.
HEATING = {
    "district": r"ogrzewani\w*[^.;,]{0,20}(?:miejsk|osiedlow|sieciow)\w*|(?:z\s+)?sieci\s+miejsk\w*|ciep[łl]o\s+systemow\w*|energi\w*\s+ciepln\w*\s+z\s+sieci|\bmpec\b|\bc\.?o\.?\s+miejsk\w*",
    "heatPump": r"pomp\w*\s+ciep[łl]a",
    "gas": r"ogrzewani\w*[^.;,]{0,20}gazow\w*|piec\w*\s+gazow\w*|kocio[łl]\w*\s+gazow\w*|kot[łl]owni\w*\s+gazow\w*",
    "electric": r"ogrzewani\w*[^.;,]{0,20}elektryczn\w*|grzejnik\w*\s+elektryczn\w*|piec\w*\s+akumulacyjn\w*|mat\w*\s+grzewcz\w*|kabl\w*\s+grzewcz\w*",
    "coalWood": r"ogrzewani\w*[^.;,]{0,20}(?:w[ęe]glow\w*|drewn\w*|drzew\w*)|piec\w*\s+(?:w[ęe]glow\w*|kaflow\w*)|kominek\w*\s+(?:z\s+p[łl]aszczem|w\s+salonie)|ekogroszek",
    "oil": r"ogrzewani\w*[^.;,]{0,20}olejow\w*|piec\w*\s+olejow\w*",
}
STYLES = {
    "tenement": r"kamienic\w*|kamieniczk\w*",
    "largePanel": r"wielk\w*\s+p[łl]yt\w*|wielkop[łl]yt\w*|p[łl]yt\w*\s+prefabrykowan\w*|prefabryk\w*",
    "apartment": r"apartamentowiec|wie[żz]owiec|wysoko[śs]ciowiec",
    "block": r"\bw\s+bloku\b|\bblok(?:u|iem|i|ów)?\b",
}
NEGATION = r"\b(?:bez|brak|nie|nie\s+posiada|pozbawion\w*|zamiast)\b[^.;,]{0,25}$"
KINDS = {
    "heatPump": r"pompa|heat[ _-]?pump",
    "district": r"miejsk|urban|district|sie[ćc]\s*miejsk|mpec|systemow|c\.?o\.",
    "electric": r"elektr|electric",
    "gas": r"gaz|gas",
    "coalWood": r"w[ęe]g|coal|drewno|wood|kominek",
    "oil": r"olej|oil",
}
AMOUNT = r"(\d{1,3}(?:[ \x{a0}]\d{3})+|\d{2,6})(?:[.,]\d{1,2})?\s*(?:zł|zl\b|pln\b)"
FEE = r"(?:czynsz|op[łl]at\w*|koszt\w*)[^.:!\n]{0,30}?(?:administracyjn\w*|eksploatacyjn\w*)"
FEE_LINE = r"(?:op[łl]at\w*|czynsz|koszt\w*)[^.:!\n]{0,24}(?:administracyjn\w*|eksploatacyjn\w*)|czynsz[^.:!\n]{0,12}dodatkow\w*"
RENT = r"czynsz[^.:!\n]{0,12}(?:najmu|za\s+najem|najmu\s+w\s+wysoko)"
ANCHOR = r"(?:\bczynsz\b|\bop[łl]at\w*)"
DEPOSIT = r"\bkaucj\w*|\bdepozyt\w*|\bzagwarantowan\w*|\bcaution\b"
FEES = {"ogrzewanie": r"\bogrzewanie\b|\bogrzew\.\b|(?:\bco\b)", "prad": r"\bpr[ąa]d\b|\bprad\b", "woda": r"\bwoda\b|\bwody\b", "gaz": r"\bgaz\b", "smieci": r"[śs]mieci"}
LEAST_FEE, MOST_FEE, REACH, KEPT = 20, 20_000, 60, 240


def java(pattern: str) -> str:
    """Case-insensitive, with edges of words between ASCII characters."""
    return "(?iu)" + pattern.replace(r"\b", r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))")


def first_stated(s: Column, patterns: dict[str, str]) -> Column:
    """The name of the first pattern whose first match isn't negated; null without one."""
    flat = F.regexp_replace(s, r"\s+", " ")
    found = []
    for name, pattern in patterns.items():
        at = F.regexp_instr(flat, F.lit(java(pattern)))
        start = F.greatest(at - LOOK_BACK, F.lit(1))
        before = F.substring(flat, start, at - start)
        found.append(F.when((at > 0) & ~before.rlike(java(NEGATION)), name))
    return F.coalesce(*found)


def heating_stated(s: Column) -> Column:
    return first_stated(s, HEATING)


def building_stated(s: Column) -> Column:
    return first_stated(s, STYLES)


def heating_kind(value: Column) -> Column:
    """Of a portal's code or label; ``unknown`` where nothing fits."""
    return F.coalesce(*(F.when(F.lower(value).rlike(java(p)), kind) for kind, p in KINDS.items()), F.lit("unknown"))


def heating_of(column: Column, attribute: Column, fact: Column, s: Column) -> Column:
    """struct<kind, source>: the first source that says anything decides, even if it says nothing that is known."""
    sources = [("column", F.nullif(F.trim(column), F.lit(""))), ("features", F.nullif(F.trim(attribute), F.lit(""))), ("facts", F.nullif(F.trim(fact), F.lit(""))), ("prose", heating_stated(s))]
    said = [F.when(v.isNotNull(), F.struct(heating_kind(v).alias("kind"), F.lit(name).alias("source"))) for name, v in sources]
    return F.coalesce(*said, F.struct(F.lit("unknown").alias("kind"), F.lit("none").alias("source")))


def _amount(window: Column) -> Column:
    n = F.regexp_replace(F.regexp_extract(window, java(AMOUNT), 1), "[  ]", "").try_cast("int")
    return once(n, lambda v: F.when(v.between(LEAST_FEE, MOST_FEE), v))


def _may_have_amount(s: Column) -> Column:
    """Cheap, and true wherever a part of the text has an amount."""
    return s.rlike(r"\d\d") & s.rlike("(?iu)zł|zl|pln")


def fees(s: Column, rent: Column | None = None) -> Column:
    """struct<czynsz, ogrzewanie, prad, woda, gaz, smieci, text> of the monthly fees that a text names; null if it names none.

    An amount stands behind its word in the same line. For the administrative fee an explicit phrase anywhere comes first, then the
    first line that has one, then the first line that isn't the rent itself. Lines of deposits don't count.
    """
    plain = F.regexp_replace(s, "<[^>]+>", "\n")
    lines = F.filter(F.split(plain, "\r?\n"), lambda x: _may_have_amount(x) & ~x.rlike(java(DEPOSIT)))
    named = java(f"({FEE})(?=([^\\n]{{0,{REACH}}}))")
    phrases = F.zip_with(F.regexp_extract_all(plain, F.lit(named), F.lit(1)), F.regexp_extract_all(plain, F.lit(named), F.lit(2)), lambda m, w: F.when(~m.rlike(java(RENT)), _amount(w)))
    explicit = F.get(F.array_compact(phrases), F.lit(0))
    behind = lambda x, words: _amount(F.regexp_extract(x, java(f"(?:{words})(.{{0,{REACH}}})"), 1))

    def czynsz(rows: Column) -> Column:
        said = F.filter(F.transform(rows, lambda x: F.struct(F.when(~x.rlike(java(RENT)), behind(x, ANCHOR)).alias("n"), x.rlike(java(FEE_LINE)).alias("admin"))), lambda x: x["n"].isNotNull())
        own = lambda x: ~x["admin"] & (F.lit(True) if rent is None else rent.isNull() | (F.abs(x["n"] - rent) >= 1))
        return once(said, lambda f: F.coalesce(F.get(F.filter(f, lambda x: x["admin"]), F.lit(0))["n"], F.get(F.filter(f, own), F.lit(0))["n"]))

    first = lambda rows, words: F.get(F.array_compact(F.transform(rows, lambda x: behind(x, words))), F.lit(0))
    named_fees = once(lines, lambda rows: F.struct(F.coalesce(explicit, czynsz(rows)).alias("czynsz"), *(first(rows, words).alias(k) for k, words in FEES.items())))
    short = F.left(F.trim(F.regexp_replace(plain, r"\s+", " ")), F.lit(KEPT))
    whole = once(named_fees, lambda f: F.when(F.coalesce(*(f[k] for k in ("czynsz", *FEES))).isNotNull(), F.struct(*(f[k].alias(k) for k in ("czynsz", *FEES)), short.alias("text"))))
    return F.when(_may_have_amount(s) & s.rlike(java(r"czynsz|op[łl]at|koszt|\bco\b|ogrzew|" + "|".join(FEES.values()))), whole)  # most texts name none


def with_fees(offers: DataFrame, key: str, building: str, district: str, fee: str = "fees") -> DataFrame:
    """offers with ``fee`` filled in and ``estimated``: the offer's own, else those of the first offer of its building, or, where the building isn't
    known, of its district."""
    offers = cut(offers)  # what texts state is found once, not for each of the three uses
    known = offers.filter(F.col(fee).isNotNull())
    donor = lambda by, name: known.filter(F.col(by).isNotNull()).groupBy(by).agg(F.min_by(fee, key).alias(name))
    j = offers.join(donor(building, "__b"), building, "left").join(donor(district, "__d"), district, "left")
    given = F.when(F.col(building).isNotNull(), F.col("__b")).otherwise(F.col("__d"))
    out = j.withColumn("estimated", F.col(fee).isNull() & given.isNotNull()).withColumn(fee, F.coalesce(F.col(fee), given))
    return out.select(*offers.columns, "estimated")
