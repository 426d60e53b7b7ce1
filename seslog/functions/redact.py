"""Removing inline data, encrypted content and machine wrappers from texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from seslog.functions.text import SPACE, nonempty, normalize_text, trim_space

# Fixed value: what counts as an inline data URI.
DATA_URI = r"data:([a-zA-Z0-9.+-]+/[a-zA-Z0-9.+-]+)?(?:;[^,]*)?,[A-Za-z0-9+/=._~%-]+"
DATA_PARTS = r"(?s)^data:([^;,]+)?((?:;[^,]*)?),(.*)$"
DEFAULT_MEDIA = "application/octet-stream"


def is_data_uri(value: Column) -> Column:
    return value.rlike(DATA_PARTS)


def data_media(uri: Column) -> Column:
    return F.coalesce(nonempty(F.regexp_extract(uri, DATA_PARTS, 1)), F.lit(DEFAULT_MEDIA))


def data_bytes(uri: Column) -> Column:
    """Decoded size: from the base64 length and padding, else the length of the percent-decoded text."""
    data = F.regexp_extract(uri, DATA_PARTS, 3)
    clean = F.regexp_replace(data, SPACE, "")
    padding = F.when(clean.endswith("=="), 2).when(clean.endswith("="), 1).otherwise(0)
    packed = F.greatest(F.lit(0), F.floor(F.length(clean) * 3 / 4) - padding)
    plain = F.length(F.coalesce(F.try_url_decode(data), data))
    return F.when(F.contains(F.regexp_extract(uri, DATA_PARTS, 2), F.lit(";base64")), packed).otherwise(plain)


def redact_data_uris(text: Column) -> Column:
    """Each inline data URI replaced by its media type and size."""

    def token(uri: Column) -> Column:
        size = data_bytes(uri)
        note = F.when(size > 0, F.concat(F.lit(" ~"), size.cast("string"), F.lit(" bytes"))).otherwise("")
        return F.concat(F.lit("[redacted data URI "), data_media(uri), note, F.lit("]"))

    found = F.array_distinct(F.regexp_extract_all(text, F.lit(DATA_URI), F.lit(0)))
    # Longest first, so that one URI being the start of another is not replaced inside it.
    longest_first = F.array_sort(found, lambda a, b: F.length(b) - F.length(a))
    replaced = F.aggregate(longest_first, text, lambda acc, uri: F.replace(acc, uri, token(uri)))
    return F.when(text.rlike(DATA_URI), replaced).otherwise(text)


def redact_json(json_text: Column) -> Column:
    """JSON text with encrypted content replaced by its length and inline data removed."""
    found = F.array_distinct(F.regexp_extract_all(json_text, F.lit(r'"encrypted_content":"((?:[^"\\]|\\.)*)"'), F.lit(1)))

    def hide(acc: Column, content: Column) -> Column:
        whole = F.concat(F.lit('"encrypted_content":"'), content, F.lit('"'))
        size = F.length(F.regexp_replace(content, r"\\(u[0-9a-fA-F]{4}|.)", "x"))
        return F.replace(
            acc, whole, F.concat(F.lit('"encrypted_content":"[encrypted_content redacted length='), size.cast("string"), F.lit(']"'))
        )

    hidden = F.when(json_text.contains('"encrypted_content":"'), F.aggregate(found, json_text, hide)).otherwise(json_text)
    return redact_data_uris(hidden)


WRAPPER = r"(?is)^(#?\s*AGENTS\.md instructions|# In app browser:|# Files mentioned by the user:|<environment_context>|<permissions instructions>)"
REQUEST = r"(?is)(?:^|\n)## My request for Codex:\s*(.*)$"
MACHINE_ONLY = r"(?is)^(#?\s*AGENTS\.md instructions|In app browser:|Files mentioned by the user:|<environment_context>|<permissions instructions>)"
NOTIFICATION = r"(?is)^<subagent_notification>\s*(.*?)\s*</subagent_notification>$"


def is_notification_text(text: Column) -> Column:
    """A JSON object that is a sub-agent notification, possibly wrapped in its tag."""
    trimmed = trim_space(text)
    body = F.coalesce(nonempty(trim_space(F.regexp_extract(trimmed, NOTIFICATION, 1))), trimmed)
    looks = body.rlike(r"(?s)^\{.*\}$")
    parsed = F.try_parse_json(F.when(looks, body))
    kind = F.try_variant_get(parsed, "$.type", "string")
    ids = [F.try_variant_get(parsed, f"$.{k}", "string") for k in ("agent_path", "agent_id")]
    named = F.coalesce(nonempty(ids[0]), nonempty(ids[1])).isNotNull()
    return F.coalesce(looks & parsed.isNotNull() & ((kind == "subagent_notification") | named), F.lit(False))


def is_machine_only(text: Column) -> Column:
    """Texts written by the host, not by a person (blank texts included)."""
    flat = normalize_text(text)
    return (flat == "") | flat.rlike(MACHINE_ONLY) | is_notification_text(text)


def clean_user_text(value: Column) -> Column:
    """What the user asked: the part after the request marker, or the text without leading machine context."""
    raw = trim_space(F.coalesce(value, F.lit("")))
    wrapped = raw.rlike(WRAPPER)
    asked = F.when(wrapped & raw.rlike(REQUEST), F.regexp_extract(raw, REQUEST, 1))
    agents = raw.rlike(r"(?i)^#?\s*AGENTS\.md instructions")
    closing = r"(?i)</environment_context>"
    after_env = F.when(raw.rlike(closing), trim_space(F.regexp_replace(raw, r"(?is)^.*?</environment_context>", ""))).otherwise("")
    text = F.when(agents, after_env).otherwise(raw)
    for heading in ("# In app browser:", "# Files mentioned by the user:"):
        # The heading itself goes; the marker goes only where it follows the heading at once.
        text = F.regexp_replace(text, rf"(?i)^{heading}(?:\n## My request for Codex:\s*)?", "")
    text = trim_space(F.regexp_replace(text, r"(?is)^<environment_context>.*?</environment_context>\s*", ""))
    stripped = F.when(text.rlike(r"(?i)^<permissions instructions>"), "").otherwise(text)
    result = trim_space(F.coalesce(asked, F.when(wrapped, stripped).otherwise(raw)))
    return F.when(is_machine_only(result), "").otherwise(result)
