"""Enrichment: prompt building, the pluggable scorer call, and profile parsing.

The scorer (a model call in the tracked pipeline) is user code: ``enrich_with``
runs it with ``mapInPandas`` over Arrow batches of (key, prompt) rows, after
all cheap filters, so it only sees candidates.  Everything around it (prompt
text, fence cutting, JSON parsing, flag coercion, typed profile fields) is
JVM-side: ``parse_profile`` is a chain of built-in expressions over VARIANT.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import dims, schemas
from ..functions.scalars import _c, py_strip

PROMPT_SLOTS = ("site_name", "title", "summary")


def build_prompt(template: str, site_name, title, summary) -> Column:
    """Fill ``{site_name}``, ``{title}``, ``{summary}`` slots of a template (doubled braces are literal)."""
    parts = []
    rest = template.replace("{{", "\u0002").replace("}}", "\u0003")
    cols = {"site_name": _c(site_name), "title": _c(title), "summary": _c(summary)}
    while True:
        i = rest.find("{")
        if i < 0:
            break
        j = rest.index("}", i)
        parts.append(F.lit(rest[:i]))
        parts.append(F.coalesce(cols[rest[i + 1 : j]], F.lit("")))
        rest = rest[j + 1 :]
    parts.append(F.lit(rest))
    out = F.concat(*parts)
    return F.replace(F.replace(out, F.lit("\u0002"), F.lit("{")), F.lit("\u0003"), F.lit("}"))


def enrich_with(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], key: str = "entry_ord", prompt: str = "prompt") -> DataFrame:
    """Call ``fn`` on Arrow batches of ``(key, prompt)``; it returns ``(key, raw_text)``.

    Batches stream through the Python worker (``mapInPandas``), so memory is
    bounded by the Arrow batch size, not by the partition or the table.
    """
    key_type = dict(df.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = fn(pdf[[key, prompt]])
            yield out[[key, "raw_text"]]

    return df.select(key, prompt).mapInPandas(run, f"{key} {key_type}, raw_text string")


def cut_json_text(raw) -> Column:
    """Model text -> JSON candidate: ```json fence, else ``` fence, else first '{' to last '}'."""
    r = F.coalesce(_c(raw), F.lit(""))
    fenced_json = F.regexp_extract(r, r"(?s)```json(.*?)(?:```|$)", 1)
    fenced = F.regexp_extract(r, r"(?s)```(.*?)(?:```|$)", 1)
    braces = F.regexp_extract(r, r"(?s)(\{.*\})", 1)
    return py_strip(
        F.when(r.contains("```json"), fenced_json).when(r.contains("```"), fenced).when(r.contains("{"), braces).otherwise(r)
    )


def coerce_flag(v: Column, path: str = "$.is_6g_relevant") -> Column:
    """Python truthiness of the flag: bool as is; strings 1/true/yes; numbers != 0; JSON null false; absent null."""
    x = F.variant_get(v, path, "variant")
    kind = F.schema_of_variant(x)
    s = F.lower(py_strip(F.try_variant_get(x, "$", "string")))
    num = F.try_variant_get(x, "$", "double")
    return (
        F.when(x.isNull(), F.lit(None).cast("boolean"))
        .when(kind == "BOOLEAN", F.try_variant_get(x, "$", "boolean"))
        .when(kind == "STRING", s.isin(dims.TRUE_STRINGS))
        .when(kind == "VOID", F.lit(False))
        .when(kind.startswith("ARRAY") | kind.startswith("OBJECT"), F.to_json(x).isin("[]", "{}") == F.lit(False))
        .otherwise(F.coalesce(num != 0, F.lit(False)))
    )


def parse_profile(raw) -> Column:
    """Raw model text -> M3 profile struct; null when it is not a JSON object."""
    v = F.try_parse_json(cut_json_text(raw))
    is_obj = F.schema_of_variant(v).startswith("OBJECT")

    def get(field: str, typ: str) -> Column:
        return F.try_variant_get(v, f"$['{field}']", typ)

    fields = []
    for f in schemas.PROFILE.fields:
        if f.name == "is_6g_relevant":
            fields.append(coerce_flag(v).alias(f.name))
        else:
            fields.append(get(f.name, f.dataType.simpleString()).alias(f.name))
    return F.when(v.isNotNull() & is_obj, F.struct(*fields))
