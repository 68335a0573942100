"""Column expressions that the jobs share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a browser's trim takes for white space, at either end of a text.
_TRIM = r"^[\s\p{Z}\x{FEFF}]+|[\s\p{Z}\x{FEFF}]+$"
#: What form encoding writes otherwise than component encoding.
_KEPT = {"+": "%20", "%21": "!", "%27": "'", "%28": "(", "%29": ")", "%7E": "~"}


def encode_component(text: Column) -> Column:
    """Percent-encoding of a text as part of a URL; null stays null."""
    out = F.url_encode(text)
    for form, kept in _KEPT.items():
        out = F.replace(out, F.lit(form), F.lit(kept))
    return out


def decode_component(text: Column) -> Column:
    """The text behind ``encode_component``; what can't be decoded gives null."""
    return F.try_url_decode(text)


def trim_unicode(text: Column) -> Column:
    return F.regexp_replace(text, _TRIM, "")


def two_digits(n: Column) -> Column:
    """At least two digits; longer numbers are not cut."""
    return F.format_string("%02d", n)


def round_half_up(x: Column) -> Column:
    """The nearest whole number, halves towards positive infinity."""
    return F.floor(x + F.lit(0.5))


def if_null(x: Column, other: Column) -> Column:
    """``other`` only for null; an empty text is kept."""
    return F.coalesce(x, other)


def if_empty(x: Column, other: Column) -> Column:
    """``other`` for null and for an empty text."""
    return F.coalesce(F.nullif(x, F.lit("")), other)


def to_number(text: Column) -> Column:
    """A number from an attribute: null and blank texts are 0, other texts that are no number are NaN."""
    trimmed = trim_unicode(F.coalesce(text, F.lit("")))
    return F.when(trimmed == "", F.lit(0.0)).otherwise(F.coalesce(trimmed.try_cast("double"), F.lit(float("nan"))))


def with_suffix(n: Column, suffix: Column) -> Column:
    return F.concat(n.cast("string"), F.coalesce(suffix, F.lit("")))


def escape_attribute(text: Column) -> Column:
    return F.replace(text, F.lit('"'), F.lit("&quot;"))


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """``x`` held between the bounds; null stays null."""
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def url_path(url: Column) -> Column:
    """The path of an absolute or relative URL, without query and fragment; also of URLs that strict parsers refuse."""
    return F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)?([^?#]*)", 1)


def url_host(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)


def normalise_path(url: Column, strip_index: bool = True) -> Column:
    """Path without a final ``index.html`` (if ``strip_index``) and without final slashes; an empty one becomes ``/``."""
    path = url_path(url)
    if strip_index:
        path = F.regexp_replace(path, r"index\.html\z", "")
    return if_empty(F.regexp_replace(path, r"/+\z", ""), F.lit("/"))


def link_scheme(href: Column) -> Column:
    """mail, phone, secure, plain, anchor, path or relative."""
    return (
        F.when(href.isNull(), None)
        .when(href.startswith("mailto:"), "mail")
        .when(href.startswith("tel:"), "phone")
        .when(href.startswith("https:"), "secure")
        .when(href.startswith("http:"), "plain")
        .when(href.startswith("#"), "anchor")
        .when(href.startswith("/"), "path")
        .otherwise("relative")
    )
