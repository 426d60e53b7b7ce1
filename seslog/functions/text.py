"""Text helpers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the white space a log producer's ``\s`` matches, which is wider than Java's.
SPACE = r"[\s\x0b   -     　﻿]"


def nonempty(value: Column) -> Column:
    """NULL for an empty text, so that coalesce skips it like a falsy value."""
    return F.nullif(value, F.lit(""))


def first_nonempty(*values: Column) -> Column:
    return F.coalesce(*[nonempty(v) for v in values])


# Fixed value: the same white space as single characters.
SPACE_CHARS = (
    " \t\n\r\x0b\x0c\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
)


def trim_space(value: Column) -> Column:
    return F.btrim(value, F.lit(SPACE_CHARS))


def rtrim_space(value: Column) -> Column:
    return F.rtrim(value, F.lit(SPACE_CHARS))


def normalize_text(value: Column) -> Column:
    """White space collapsed to single blanks and trimmed; NULL becomes ''."""
    return F.trim(F.regexp_replace(F.coalesce(value, F.lit("")), f"{SPACE}+", " "))


def first_line(value: Column, limit: int | None = None) -> Column:
    """The normalized text, shortened to ``limit`` characters with an ellipsis."""
    text = normalize_text(value)
    if limit is None:
        return text
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit - 1), F.lit("…"))).otherwise(text)


def contains_text(value: Column, expected: str) -> Column:
    """Substring test on normalized lower-cased texts."""
    needle = " ".join(expected.split()).lower()
    return F.lower(normalize_text(value)).contains(needle)


def joined_text(*values: Column, sep: str = "\n") -> Column:
    """Non-empty values joined in order."""
    return F.concat_ws(sep, *[nonempty(v) for v in values])


def byte_tokens(value: Column) -> Column:
    """Token estimate from UTF-8 bytes: ceil(bytes / 4), at least 1; NULL for an empty text."""
    return F.when(F.length(value) > 0, F.greatest(F.lit(1), F.ceil(F.octet_length(value) / 4)).cast("long"))


def char_tokens(value: Column) -> Column:
    """Token estimate from characters: ceil(length / 4), at least 1; 0 for an empty text."""
    return F.when(F.length(value) > 0, F.greatest(F.lit(1), F.ceil(F.length(value) / 4))).otherwise(0).cast("long")


def one_decimal(value: Column) -> Column:
    """Text with one decimal of a value in [1, 2^20): nearest tenth of the exact binary value, upper one on a tie."""
    scale = F.when(value < 1024, F.lit(2**52)).otherwise(F.lit(2**42)).cast("decimal(20,0)")
    exact = (value * scale.cast("double")).cast("bigint").cast("decimal(20,0)")
    lower = F.floor(exact * 10 / scale).cast("bigint")
    up = (exact * 20) >= ((lower * 2 + 1).cast("decimal(18,0)") * scale)
    tenths = F.when(up, lower + 1).otherwise(lower)
    return F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"))


def format_bytes(value: Column) -> Column:
    n = F.coalesce(value, F.lit(0))
    return (
        F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B")))
        .when(n < 1024 * 1024, F.concat(one_decimal(n / 1024), F.lit(" KB")))
        .otherwise(F.concat(one_decimal(n / 1024 / 1024), F.lit(" MB")))
    )


def compact_number(value: Column) -> Column:
    n = F.coalesce(value, F.lit(0))
    return (
        F.when(n >= 1_000_000, F.concat(one_decimal(n / 1_000_000), F.lit("M")))
        .when(n >= 1_000, F.concat(one_decimal(n / 1_000), F.lit("K")))
        .otherwise(n.cast("string"))
    )


def _minutes_seconds(ms: Column) -> Column:
    rest = F.floor((ms % 60_000) / 1000 + 0.5)
    return F.concat(F.floor(ms / 60_000).cast("string"), F.lit("m "), rest.cast("string"), F.lit("s"))


def report_duration(ms: Column) -> Column:
    """Duration text of the execution report: ms, then seconds with at most one decimal, then minutes and seconds."""
    tenths = F.floor(ms / 100 + 0.5)
    seconds = F.concat(
        F.floor(tenths / 10).cast("string"),
        F.when(tenths % 10 != 0, F.concat(F.lit("."), (tenths % 10).cast("string"))).otherwise(""),
    )
    return (
        F.when(ms.isNull(), "未记录")
        .when(ms < 1000, F.concat(ms.cast("string"), F.lit(" ms")))
        .when(ms < 60_000, F.concat(seconds, F.lit(" s")))
        .otherwise(_minutes_seconds(ms))
    )


def short_duration(ms: Column) -> Column:
    """Duration text of the step lists: one decimal only below ten seconds."""
    return (
        F.when(ms.isNull(), "")
        .when(ms < 1000, F.concat(ms.cast("string"), F.lit(" ms")))
        .when(ms < 10_000, F.concat(one_decimal(ms / 1000), F.lit(" s")))
        .when(ms < 60_000, F.concat(F.floor(ms / 1000 + 0.5).cast("string"), F.lit(" s")))
        .otherwise(_minutes_seconds(ms))
    )


def slashes(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def strip_long_path_prefix(path: Column) -> Column:
    return F.regexp_replace(path, r"^\\\\\?\\", "")


def short_path(path: Column) -> Column:
    """First two and last segment of a path with more than three segments."""
    text = F.coalesce(path, F.lit(""))
    parts = F.filter(F.split(strip_long_path_prefix(text), r"[\\/]+"), lambda p: p != "")
    shortened = F.concat(F.get(parts, 0), F.lit("/"), F.get(parts, 1), F.lit("/…/"), F.element_at(parts, -1))
    return F.when(F.size(parts) <= 3, text).otherwise(shortened)


def clean_file_name(value: Column, limit: int | None = None) -> Column:
    """The name with unsafe characters replaced; cut only where the caller names a limit."""
    clean = F.regexp_replace(value, r'[\x00-\x1f<>:"/\\|?*]', "_")
    return clean if limit is None else F.substring(clean, 1, limit)


def fence_size(value: Column) -> Column:
    """Back-ticks needed to fence a text: one more than its longest run, at least three."""
    runs = F.transform(F.regexp_extract_all(F.coalesce(value, F.lit("")), F.lit("(`+)"), F.lit(1)), F.length)
    return F.greatest(F.lit(3), F.coalesce(F.array_max(runs), F.lit(0)) + 1)


def fill_template(template: Column, values: dict[str, Column]) -> Column:
    """Replace each {key} by its value, unknown keys by nothing."""
    text = template
    for key, value in values.items():
        text = F.replace(text, F.lit("{" + key + "}"), F.coalesce(value, F.lit("")))
    return F.regexp_replace(text, r"\{[a-zA-Z0-9_]+\}", "")


def clean_filled(value: Column) -> Column:
    """Collapse white space and drop the punctuation an empty value leaves behind."""
    text = F.regexp_replace(value, f"{SPACE}+", " ")
    text = F.regexp_replace(text, r" +([：:，,。;；])", "$1")
    return trim_space(F.regexp_replace(text, r"[：:，,;；]\s*$", ""))


def readable_output(output: Column, label: str, preview: int = 160) -> Column:
    """One line: label, number of lines and characters, start of the text."""
    text = F.coalesce(output, F.lit(""))
    start = first_line(text, preview)
    line = F.concat(
        F.lit(f"{label} · "), F.size(F.split(text, "\n")).cast("string"), F.lit(" 行 / "), F.length(text).cast("string"),
        F.lit(" 字符"), F.when(start != "", F.concat(F.lit(" · "), start)).otherwise(""),
    )
    return F.when(text == "", F.lit(f"{label} · 无输出")).otherwise(first_line(line, max(220, preview + 80)))


def url_part(value: Column, fallback: str) -> Column:
    """Percent-encoded value; blanks as %20 and the characters a URI component keeps left alone."""
    text = F.coalesce(nonempty(trim_space(value.cast("string"))), F.lit(fallback))
    encoded = F.url_encode(text)
    for source, target in (("+", "%20"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        encoded = F.replace(encoded, F.lit(source), F.lit(target))
    return encoded


def evidence_id(source, session, thread=None, turn=None, event=None, node=None, entity: str = "object") -> Column:
    """Stable id of a source, session, thread, turn, event or node."""
    thread = F.lit(None).cast("string") if thread is None else thread
    parts = [
        F.concat(F.lit("source:"), url_part(source, "unknown")),
        F.concat(F.lit("session:"), url_part(session, "unknown")),
        F.concat(F.lit("thread:"), url_part(thread, "root")),
    ]
    for name, value in (("turn", turn), ("event", event), ("node", node)):
        if value is not None:
            part = F.concat(F.lit(f"{name}:"), url_part(value, "unknown"))
            parts.append(F.when(value.isNotNull(), part))
    parts.append(F.lit(f"object:{entity}"))
    return F.concat_ws("|", *parts)


# What a redacted credential is written as.
HIDDEN = "[redacted]"
CREDENTIAL_LABELS = {"authorization-bearer": "authorization=Bearer ", "bearer": "Bearer ", "token": "token=", "authorization": "authorization="}


def redact_secrets(message: Column) -> Column:
    """First non-blank line with user info of URLs, bearer values and labelled tokens removed, however long it is.

    A line is cut at its credentials, and each credential is replaced by what its own first words say it is. A label
    whose value is another label takes that one along, so that no value is left behind.
    """
    lines = F.filter(F.split(message, "\r?\n"), lambda line: trim_space(line) != "")
    line = trim_space(F.coalesce(F.get(lines, 0), F.lit("")))
    line = F.regexp_replace(line, r"(?i)(?<=[a-z0-9+.-]://)[^@/\s]+(?=@)", HIDDEN)
    bearer = r"bearer\s+[a-z0-9._~+/=-]+"
    label = r"(?:token|authorization)[=:]\s*"
    credential = rf"(?i)authorization\s*[=:]\s*{bearer}|{bearer}|{label}(?:{label}|bearer\s+)*\S+"

    def written(found: Column) -> Column:
        small = F.lower(found)
        name = (
            F.when(small.rlike(r"^authorization\s*[=:]\s*bearer\s"), "authorization-bearer")
            .when(small.startswith("bearer"), "bearer")
            .otherwise(F.regexp_extract(small, "^(token|authorization)", 1))
        )
        return F.concat(F.element_at(F.create_map(*[F.lit(x) for pair in CREDENTIAL_LABELS.items() for x in pair]), name), F.lit(HIDDEN))

    shown = F.transform(F.regexp_extract_all(line, F.lit(credential), F.lit(0)), written)
    pieces = F.zip_with(F.split(line, credential), shown, lambda plain, hidden: F.concat(plain, F.coalesce(hidden, F.lit(""))))
    return F.array_join(pieces, "")
