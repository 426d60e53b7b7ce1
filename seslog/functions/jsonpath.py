"""Reading one field of a JSON text, with the reason where there is none."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from seslog.functions.text import trim_space


def segments(path: str) -> list[str | int]:
    """Parts of a path like ``$.a[0]["b"]``."""
    text = re.sub(r"^\.+", "", re.sub(r"^\$", "", path.strip()))
    text = re.sub(r"""\[(?:(\d+)|"([^"]+)"|'([^']+)')\]""", lambda m: "." + next(g for g in m.groups() if g is not None), text)
    return [int(p) if p.isdigit() else p for p in text.split(".") if p]


def extract(source: Column, path: str) -> tuple[Column, Column]:
    """(value as text, reason): reason is empty, not-json or not-found; NULL when the field exists."""
    parts = segments(path)
    if not parts:
        return F.lit(None).cast("string"), F.lit("empty")
    variant_path = "$" + "".join(f"[{p}]" if isinstance(p, int) else f"['{p}']" for p in parts)
    document = F.try_parse_json(source)
    found = F.try_variant_get(document, variant_path, "variant")
    value = F.try_variant_get(document, variant_path, "string")
    reason = (
        F.when(source.isNull() | (trim_space(source) == ""), "empty").when(document.isNull(), "not-json")
        .when(found.isNull(), "not-found")
    )
    return value, reason
