"""Deep links that carry a message."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalar as S


def compose_lead(df: DataFrame, target: str, title: str, fields: Mapping[str, Column], out: str = "link") -> DataFrame:
    """Adds a link to ``target`` whose text is ``title`` and a labelled line for each field, trimmed; missing fields are empty."""
    lines = [F.concat(F.lit(f"{label}: "), S.trim_unicode(F.coalesce(c, F.lit("")))) for label, c in fields.items()]
    message = F.concat_ws("\n", F.lit(title), *lines)
    return df.withColumn(out, F.concat(F.lit(f"{target}?text="), S.encode_component(message)))


def compose_request(df: DataFrame, target: str, template: str, item: Column, out: str = "link") -> DataFrame:
    """Adds a link whose text is one sentence, ``template`` with %s for the item."""
    return df.withColumn(out, F.concat(F.lit(f"{target}?text="), S.encode_component(F.format_string(template, item))))


def decode_links(df: DataFrame, link: str) -> DataFrame:
    """Adds ``target`` and ``message`` of links that carry a text; others give null."""
    target = F.nullif(F.regexp_extract(link, r"^([^?#]*)\?", 1), F.lit(""))
    return df.withColumn("target", target).withColumn("message", S.decode_component(F.nullif(F.regexp_extract(link, r"[?&]text=([^&#]*)", 1), F.lit(""))))
