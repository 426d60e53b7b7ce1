"""The stages of the pipeline, each on what the one before it kept, against brute force on a small corpus."""

import hashlib
import math
import random
import re

from tokenizers import Tokenizer

import corpus_pipeline
from seslog.llm import quality, vocabulary
from test_operators import VOICES, brute_lines

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def corpus():
    """Documents and items: clean ones, copies, near copies, shared passages, item passages, junk, mojibake and nulls."""
    r = random.Random(21)
    fresh = lambda n, lang: [r.choice(VOICES[lang]) if r.random() < 0.5 else "".join(r.choice("abcdefghio") for _ in range(r.randint(3, 8))) for _ in range(n)]
    lines = lambda n, lang: "\n".join(" ".join(fresh(r.randint(15, 40), lang)) for _ in range(n))
    docs = []
    for i in range(50):
        lang = r.choice(["en", "de"])
        docs.append((i * 3, lines(r.randint(3, 7), lang), lang))
    shared = lines(3, "en")
    items = [(f"i{k}", " ".join(fresh(25, "en"))) for k in range(4)] + [("short", "tiny item"), ("empty", ""), ("null", None)]
    for k in range(3):
        docs.append((200 + k, f"{lines(3, 'en')}\n{shared}\n{lines(2, 'en')}", "en"))
        one_line = fresh(120, "en")  # copies of more lines lose their equal lines to line dedup first
        docs.append((205 + k, " ".join(one_line), "en"))
        one_line[r.randrange(120)] = "changed"
        docs.append((210 + k, " ".join(one_line), "en"))
        docs.append((220 + k, docs[10 + k][1], docs[10 + k][2]))
        docs.append((230 + k, f"{lines(3, 'en')} {' '.join(items[k][1].upper().split()[5:17])} {lines(2, 'en')}", "en"))
    docs += [(300, None, "en"), (301, "", "en"), (302, "too few words", "en"), (303, "buy now " * 90, "en"), (304, lines(4, "en"), None)]
    docs += [(305, " ".join("Ã¤Ã¶Ã¼ï¿½Ã" * 2 for _ in range(20)) + " " + " ".join(f"ï¿½Ã{k}Ã¶Ã¼" * 2 for k in range(60)), "en")]
    docs += [(306, " ".join("#" * (1 + k % 5) + f"|{k * 7919}|" for k in range(120)), "de")]
    return [(i, t, lang, "s", None if t is None else len(t)) for i, t, lang in docs], items


def shares(counts, whole):
    return [c / whole for c in counts] + [(whole - sum(counts)) / whole]


def distance(p, q):
    part = lambda a, b: a * math.log2(2 * a / (a + b)) if a > 0 else 0.0
    return math.sqrt(max(sum(part(a, b) + part(b, a) for a, b in zip(p, q)) / 2, 0.0))


def classes(text):
    tests = [lambda c: "a" <= c <= "z", lambda c: "A" <= c <= "Z", lambda c: "0" <= c <= "9", lambda c: c in quality.BLANKS, lambda c: c in quality.SYMBOLS]
    counts = [sum(map(t, text)) for t in tests]
    return [*counts, sum(c < "\x80" for c in text) - sum(counts)]


def base_failed(text):
    w = words_of(text)
    windows = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
    repeated = {k + j for k, x in enumerate(windows) if windows.count(x) > 1 for j in range(3)}
    return len(w) < 50 or 100 * len(repeated) > 50 * len(w)


def brute_quality(docs):
    good = [d for d in docs if not base_failed(d[1])]
    of = {}
    for d in good:
        of.setdefault(d[2], []).append(d[1])
    add = lambda rows: [sum(x) for x in zip(*rows)]
    common = lambda t: [words_of(t).count(w) for w in quality.COMMON_WORDS]
    ref = {k: (shares(add(map(classes, v)), sum(map(len, v))), shares(add(map(common, v)), sum(len(words_of(t)) for t in v))) for k, v in of.items()}
    out = []
    for d in good:
        t, n = d[1], len(words_of(d[1]))
        far = len(t) >= quality.LEAST_CHARS_FOR_CLASSES and distance(shares(classes(t), len(t)), ref[d[2]][0]) > quality.MOST_CLASS_DISTANCE
        far |= n >= quality.LEAST_WORDS_FOR_COMMON and distance(shares(common(t), n), ref[d[2]][1]) > quality.MOST_WORD_DISTANCE
        if not far:
            out.append(d)
    return out


def brute_cut(docs):
    docs = sorted(docs)
    seen, once = {}, []
    for d in docs:
        if d[1] not in seen:
            seen[d[1]] = d[0]
            once.append(d[1])
    cut = dict(zip(once, brute_lines(once, 50)))
    out = []
    for i, t, lang, source, n in docs:
        new = cut[t] if seen[t] == i else ""
        if new == t or new.strip(quality.BLANKS):
            out.append((i, new, lang, source, n if new == t else len(new)))
    return out


def brute_near(docs):
    sets = []
    for d in docs:
        w = words_of(re.sub("[A-Z]", lambda m: m[0].lower(), d[1]))
        sets.append({tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))} if w else set())
    root = [d[0] for d in docs]
    for a in range(len(docs)):
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                low, high = sorted((root[a], root[b]))
                root = [low if x == high else x for x in root]
    return [d for d, x in zip(docs, root) if d[0] == x]


def brute_clean(docs, items):
    word = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = {tuple(w[k : k + 10]) for w in (word(t) for _, t in items) if w for k in range(max(len(w) - 9, 1))}
    held = lambda w: any(tuple(w[k : k + n]) in windows for n in {len(x) for x in windows} for k in range(len(w) - n + 1))
    return [d for d in docs if not held(word(d[1]))]


def test_stages(spark, tmp_path):
    rows, items = corpus()
    spark.createDataFrame(rows, COLUMNS).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    want = rows
    steps = [brute_quality, brute_cut, brute_near, lambda d: brute_clean(d, items)]
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    lost = []
    for k, ((name, stage), brute) in enumerate(zip(corpus_pipeline.STAGES, steps)):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        before, want = want, brute(want)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        assert sorted(map(tuple, docs.collect()), key=str) == sorted(want, key=str), name
        lost.append({d[0] for d in before} - {d[0] for d in want})
    assert {300, 301, 302, 303, 305, 306} <= lost[0] and 304 not in lost[0]
    assert {220, 221, 222} <= lost[1] and {210, 211, 212} <= lost[2] and {230, 231, 232} <= lost[3]
    library = Tokenizer.from_file(vocabulary.default_path())
    done = {r.doc_id: r for r in corpus_pipeline.STAGES[4][1](spark, docs, str(tmp_path)).collect()}
    assert sorted(done) == sorted(d[0] for d in want)
    for d in want:
        assert list(done[d[0]].ids) == library.encode(d[1], add_special_tokens=False).ids
        assert done[d[0]].decoded_sha256 == hashlib.sha256(d[1].encode()).hexdigest()


def test_a_task_encodes_or_decodes(spark):
    """Never both: the Python workers of both at once took an executor above its memory."""
    docs = spark.createDataFrame([(1, "some text"), (2, None)], "doc_id long, text string")
    out = corpus_pipeline.encoding(spark, docs, "")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and "MapInArrow" not in plan
    assert sorted((r.doc_id, len(r.ids), r.decoded_sha256) for r in out.collect())[1] == (2, 0, hashlib.sha256(b"").hexdigest())
