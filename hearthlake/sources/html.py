"""Listing fields from stored web pages, mostly as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The entities that pages use most.
ENTITIES = {"&nbsp;": " ", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&lt;": "<", "&gt;": ">", "&amp;": "&"}


def decode_entities(s: Column) -> Column:
    for entity, char in ENTITIES.items():
        s = F.replace(s, F.lit(entity), F.lit(char))
    return s


def text_of(html: Column) -> Column:
    """Visible text: scripts, styles, comments and tags off, entities decoded, white space collapsed."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", " ")
    return F.trim(F.regexp_replace(decode_entities(bare), r"\s+", " "))


def tag(html: Column, name: str) -> Column:
    return F.nullif(F.trim(decode_entities(F.regexp_extract(html, rf"(?is)<{name}\b[^>]*>(.*?)</{name}\s*>", 1))), F.lit(""))


def attribute(html: Column, name: str, attr: str) -> Column:
    return F.nullif(F.regexp_extract(html, rf"""(?is)<{name}\b[^>]*\b{attr}\s*=\s*["']([^"']*)["']""", 1), F.lit(""))


def ld_json(html: Column) -> Column:
    """All ld+json blocks as strings."""
    return F.regexp_extract_all(html, F.lit(r"""(?is)<script[^>]*type=["']application/ld\+json["'][^>]*>(.*?)</script>"""), F.lit(1))


def state_json(html: Column, script_id: str) -> Column:
    """The JSON of <script id=...>, as a variant; null if it isn't JSON."""
    return F.try_parse_json(F.nullif(F.regexp_extract(html, rf"""(?is)<script[^>]*\bid=["']{script_id}["'][^>]*>(.*?)</script>""", 1), F.lit("")))


def links(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """key, position, href."""
    found = F.regexp_extract_all(F.col(html), F.lit(r"""(?is)<a\b[^>]*\bhref\s*=\s*["']([^"']*)["']"""), F.lit(1))
    return pages.select(key, F.posexplode(found).alias("position", "href"))


def slug_kind(url: Column, kinds: dict[str, str]) -> Column:
    """The kind whose name is a whole segment of the url's path."""
    path = F.split(F.coalesce(F.regexp_extract(url, r"^[^?#]*", 0), F.lit("")), "/")
    out = F.lit(None).cast("string")
    for name, kind in reversed(list(kinds.items())):
        out = F.when(F.array_contains(path, name), kind).otherwise(out)
    return out


def nodes_of_type(blocks: Column, kind: str) -> Column:
    """Of ld+json blocks the nodes of a type, as variants: the block itself or members of its @graph; broken blocks have none."""
    parsed = F.transform(blocks, lambda b: F.try_parse_json(b))
    spread = F.flatten(F.transform(parsed, lambda v: F.concat(F.array(v), F.coalesce(F.try_variant_get(v, "$.@graph", "array<variant>"), F.array().cast("array<variant>")))))
    return F.filter(spread, lambda v: F.try_variant_get(v, "$.@type", "string") == kind)


def absolute_url(base: Column, href: Column) -> Column:
    """href as seen from a page: whole urls stay, //host, /path, ?query and relative paths follow the base."""
    scheme = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*):", 1)
    host = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1)
    page = F.regexp_extract(base, r"^([^?#]*)", 1)
    folder = F.when(page == host, F.concat(host, F.lit("/"))).otherwise(F.regexp_replace(page, "[^/]*$", ""))
    return (
        F.when(href.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:"), href).when(href.startswith("//"), F.concat(scheme, F.lit(":"), href)).when(href.startswith("/"), F.concat(host, href))
        .when(href.startswith("?") | href.startswith("#") | (href == ""), F.concat(page, href)).otherwise(F.concat(folder, href))
    )
