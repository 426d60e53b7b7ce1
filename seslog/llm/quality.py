"""Quality rules (Spark functions only): counts of each text, and the divergence of its histograms from its language.

Base rules work on words (runs of other than space and the five ASCII control blanks) and lines. The method's rule compares two
histograms of a document, of character classes and of common words, with those of all documents of its language by the
Jensen-Shannon distance (0 to 1). Short texts have noisy histograms, so a distance counts only from a least length on.

References are sums over all documents that pass the base rules, one small row per value of `lang`.

Defined cases: a null text has no words and fails; a null language is a language of its own; repeated rows count each;
an empty table gives no rows. Columns other than id, text and lang are not read by `measure`; `keep` keeps all columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seslog.llm.common import fresh_name, stage

LEAST_WORDS, MOST_REPEATED_PERCENT = 50, 50
LEAST_CHARS_FOR_CLASSES, LEAST_WORDS_FOR_COMMON = 200, 100
MOST_CLASS_DISTANCE, MOST_WORD_DISTANCE = 0.28, 0.285
MOST_BROADCAST_LANGUAGES = 10_000

BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
# Frequent words of the languages that references are made for.
COMMON_WORDS = [
    "the", "of", "and", "to", "a", "in", "is", "it", "that", "with", "for", "be",
    "der", "die", "das", "und", "ist", "nicht", "mit", "den", "ein", "zu", "von", "auf",
    "le", "la", "les", "et", "est", "une", "dans", "pour", "que", "de", "du", "des",
    "el", "los", "las", "y", "es", "en", "un", "con", "por", "se", "lo", "del",
]
CLASSES = ["lower", "upper", "digit", "blank", "symbol", "mark"]


def _class_codes() -> tuple[str, str]:
    """Each ASCII character, and the letter of its class; all others are the rest."""
    codes = {**{c: "B" for c in BLANKS}, **{c: "S" for c in SYMBOLS}}
    chars = [chr(c) for c in range(128)]
    kind = [codes.get(c) or ("L" if "a" <= c <= "z" else "U" if "A" <= c <= "Z" else "D" if "0" <= c <= "9" else "M") for c in chars]
    return "".join(chars), "".join(kind)


def _occurrences(text: Column, letter: str) -> Column:
    return (F.octet_length(text) - F.octet_length(F.replace(text, F.lit(letter), F.lit("")))).cast("long")


def counts(df: DataFrame, doc_id: str, text: str, lang: str) -> DataFrame:
    """All counts of each row; a chain of projections, so that no array is computed twice."""
    chars, kinds = _class_codes()
    whole = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split("t", "\n"), lambda line: F.octet_length(F.btrim(line, F.lit(BLANKS))) > 0)
    words = F.filter(F.split("t", r"[\x20\x09-\x0D]+"), lambda w: F.octet_length(w) > 0)
    split = df.select(F.col(doc_id).alias("doc_id"), F.col(lang).alias("lang"), whole.alias("t")).select(
        "doc_id", "lang", F.char_length("t").cast("long").alias("chars"), F.translate("t", chars, kinds).alias("codes"), lines.alias("lines"), words.alias("words")
    )
    windows = F.when(F.size("words") >= 3, F.sequence(F.lit(0), F.size("words") - 3)).otherwise(F.array().cast("array<int>"))
    at = lambda i: F.get(F.col("words"), i)
    counted = split.select(
        "doc_id",
        "lang",
        "chars",
        F.size("words").cast("long").alias("n_words"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        *[_occurrences(F.col("codes"), letter).alias(name) for name, letter in zip(CLASSES, "LUDBSM")],
        F.filter("words", lambda w: w.isin(COMMON_WORDS)).alias("common"),
        F.transform(windows, lambda i: F.xxhash64(at(i), at(i + 1), at(i + 2))).alias("windows"),
    )
    ranked = counted.withColumn("repeats", F.size("windows") - F.size(F.array_distinct("windows"))).withColumn(
        "sorted", F.when(F.col("repeats") > 0, F.array_sort(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    )
    near = lambda k: F.get(F.col("sorted"), k)["h"]
    shared = F.filter(
        F.transform("sorted", lambda x, k: F.when((near(k - 1) == x["h"]) | (near(k + 1) == x["h"]), x["i"])), lambda i: i.isNotNull()
    )
    placed = ranked.withColumn("places", F.when(F.col("repeats") > 0, F.sort_array(shared)))
    steps = F.transform("places", lambda p, k: F.least(F.lit(3), F.coalesce(F.get(F.col("places"), k + 1) - p, F.lit(3) + F.size("places") * 0)))
    return placed.select(
        "doc_id",
        "lang",
        "chars",
        "n_words",
        "n_dup_lines",
        *CLASSES,
        *[(F.size("common") - F.size(F.array_remove("common", w))).cast("long").alias(f"w{i}") for i, w in enumerate(COMMON_WORDS)],
        F.coalesce(F.aggregate(steps, F.lit(0).cast("long"), lambda s, x: s + x), F.lit(0)).cast("long").alias("n_repeat_words"),
    )


def _shares(names: list[str], whole: str) -> Column:
    """Shares of the named counts, and of the rest, in their whole (which is not 0)."""
    rest = F.col(whole) - sum((F.col(n) for n in names[1:]), F.col(names[0]))
    return F.transform(F.array(*[F.col(n).cast("double") for n in names], rest.cast("double")), lambda x: x / F.col(whole))


def divergence(p: Column, q: Column) -> Column:
    """The Jensen-Shannon distance (root of the divergence in bits) of two arrays of shares."""
    part = lambda a, b: F.when(a > 0, a * F.log2(2 * a / (a + b))).otherwise(0.0)
    total = F.aggregate(F.zip_with(p, q, lambda a, b: part(a, b) + part(b, a)), F.lit(0.0), lambda s, x: s + x)
    return F.sqrt(F.when(total > 0, total / 2).when(total.isNotNull(), 0.0))


def measure(df: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """One row per row of df with its counts, base_failed, both distances (null where too short) and kept."""
    failed = (F.col("n_words") < LEAST_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MOST_REPEATED_PERCENT)
    rows = stage(counts(df, doc_id, text, lang).withColumn("base_failed", failed))
    names = [*CLASSES, *[f"w{i}" for i in range(len(COMMON_WORDS))]]
    sums = rows.filter(~F.col("base_failed")).groupBy(F.col("lang").alias("of")).agg(*[F.sum(n).alias(n) for n in ["chars", "n_words", *names]])
    common = [f"w{i}" for i in range(len(COMMON_WORDS))]
    references = stage(sums.select("of", _shares(CLASSES, "chars").alias("ref_classes"), _shares(common, "n_words").alias("ref_words")))
    if references.count() <= MOST_BROADCAST_LANGUAGES:
        references = F.broadcast(references)
    # each histogram is its own projection: null where the text is too short for it
    own = rows.withColumn("classes", F.when(F.col("chars") >= LEAST_CHARS_FOR_CLASSES, _shares(CLASSES, "chars"))).withColumn(
        "common", F.when(F.col("n_words") >= LEAST_WORDS_FOR_COMMON, _shares(common, "n_words"))
    )
    joined = own.join(references, F.col("lang").eqNullSafe(F.col("of")), "left").withColumn(
        "class_distance", divergence(F.col("classes"), F.col("ref_classes"))
    ).withColumn("word_distance", divergence(F.col("common"), F.col("ref_words")))
    far = (F.coalesce("class_distance", F.lit(0.0)) > MOST_CLASS_DISTANCE) | (F.coalesce("word_distance", F.lit(0.0)) > MOST_WORD_DISTANCE)
    return joined.select(
        "doc_id",
        "n_words",
        (F.col("chars") - F.col("blank")).alias("word_chars"),
        F.col("symbol").alias("n_symbols"),
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        (~F.col("base_failed") & ~far).alias("kept"),
        "class_distance",
        "word_distance",
    )


def keep(df: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """df without the rows that the rules reject. Rows with the same text and language share one verdict."""
    key = fresh_name(df, "quality_key")
    keyed = df.withColumn(key, F.sha2(F.concat_ws("\x1f", F.coalesce(F.col(lang), F.lit("\x1e")), F.coalesce(F.col(text), F.lit("\x1e"))), 256))
    rejected = measure(keyed, key, text, lang).filter("not kept").select(F.col("doc_id").alias(key)).distinct()
    return keyed.join(rejected, key, "left_anti").select(*df.columns)
