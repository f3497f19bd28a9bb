"""Decontamination, spelling variants and importance resampling against brute force."""

import collections
import hashlib
import math
import random
import re
from zlib import crc32

import pytest
from compare import difference
from pyspark.sql import functions as F
from quire.llm import decontamination, queries, resampling, spelling

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, fp string, `row` int, n long, words string, WORD string"


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(UPPER))


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "x", 1, 2, "y", "z") for i, t in texts], SCHEMA).repartition(3)


@pytest.mark.parametrize("name", ["op11_decontamination", "op12_spelling", "op13_resampling"])
def test_query_equals_sql(spark, sf, db, name):
    assert difference(queries.QUERIES[name](spark, sf), queries.ORACLE_SQL[name], db) == ""


def hits_of(texts, items, span=10):
    runs = collections.defaultdict(set)
    for i, t in items:
        w = words_of(t)
        n = min(span, len(w))
        for k in range(len(w) - n + 1 if w else 0):
            runs[tuple(w[k : k + n])].add("" if i is None else str(i))
    out = []
    for i, t in texts:
        w, hit, found = words_of(t), set(), set()
        for n in {len(r) for r in runs}:
            for k in range(len(w) - n + 1):
                if own := runs.get(tuple(w[k : k + n])):
                    hit |= set(range(k, k + n))
                    found |= own
        out.append((i, len(w), len(hit), tuple(sorted(found)), bool(hit)))
    return collections.Counter(out)


def hard_case(seed):
    """Texts of few words, so that runs repeat and overlap, with items inside, at the ends and cut short."""
    rng = random.Random(seed)
    word = lambda: rng.choice(["a", "B", "c3", "é", "Ö", "中文", "x_y", "it's"])
    items = [(k, " ".join(word() for _ in range(rng.choice([1, 2, 3, 4, 5, 9, 10, 11, 14, 40])))) for k in range(12)]
    items += [(3, "one two three four five six seven eight nine ten eleven"), (None, "Alone, again: one-two three four five six seven eight nine ten"), (77, None), (78, " ,. "), (10, "a a a a a a a a a a a a")]
    texts = [(k, " ".join(word() for _ in range(rng.randrange(60)))) for k in range(40)]
    texts += [(100 + k, f"lead {t or ''}\ntail {t or ''}") for k, (_, t) in enumerate(items)]
    texts += [(200, "one two three four five six seven eight nine"), (201, "ONE two\tthree four, five six seven eight nine ten"), (None, "a " * 3000), (202, None), (202, ""), (202, "a " * 30), (203, "w" * 50000)]
    return texts + texts[:3], items


@pytest.mark.parametrize("settings", [{}, {"table_rows": 0, "broadcast_bytes": 0}, {"gram": 1}, {"gram": 10, "table_rows": 3}])
def test_decontamination_equals_brute_force(spark, settings):
    texts, items = hard_case(1)
    frame_items = spark.createDataFrame([(i, t, "clash", 1) for i, t in items], "item_id long, text string, run string, span int")
    got = decontamination.decontaminate(frame(spark, texts), frame_items, **settings).collect()
    assert collections.Counter((r.doc_id, r.n_words, r.n_hit, tuple(r["items"]), r.contaminated) for r in got) == hits_of(texts, items)


def test_decontamination_of_other_spans(spark):
    texts, items = hard_case(2)
    got = decontamination.decontaminate(frame(spark, texts), spark.createDataFrame(items, "item_id long, text string"), span=6, gram=3).collect()
    assert collections.Counter((r.doc_id, r.n_words, r.n_hit, tuple(r["items"]), r.contaminated) for r in got) == hits_of(texts, items, 6)


def test_fingerprints_are_few_and_miss_no_shared_run(spark):
    rng = random.Random(3)
    shared = [f"s{k}" for k in range(10)]
    rows = [(k, [f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(30))] + shared + [f"v{rng.randrange(10**6)}" for _ in range(300)]) for k in range(30)]
    df = spark.createDataFrame(rows, "id long, words array<string>").select("id", "words", decontamination.fingerprints(F.col("words"), 10).alias("fp"))
    rows = df.collect()
    for a in rows:
        assert len(a.fp) == len(a.words) - 9
        assert len(set(a.fp)) < 0.4 * len(a.fp)  # a quarter in the mean, for windows of seven
        assert all(set(a.fp) & set(b.fp) for b in rows)


def test_decontamination_without_rows(spark):
    items = spark.createDataFrame([(1, "one two three")], "item_id long, text string")
    none, docs = frame(spark, []), frame(spark, [(1, "one two three"), (None, None)])
    assert decontamination.decontaminate(none, items).count() == 0
    assert {tuple(r) for r in decontamination.decontaminate(docs, items.limit(0)).select("doc_id", "n_hit", "contaminated").collect()} == {(1, 0, False), (None, 0, False)}
    clean = decontamination.keep_clean(docs, items)
    assert clean.columns == docs.columns and [r.doc_id for r in clean.collect()] == [None]


def forms_of(texts, min_length=7, min_count=2, ratio=10, one_in=31):
    counts = collections.Counter()
    for i, t in texts:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(UPPER)
            h = crc32(f"{'' if i is None else i}:{run}".encode())
            if len(run) and h % one_in == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += len(run) >= min_length
    n = {w: c for w, c in counts.items() if c >= min_count}

    def is_near(a, b):
        a, b = sorted((a, b), key=len)
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        return len(b) == len(a) + 1 and any(b[:p] + b[p + 1 :] == a for p in range(len(b)))

    near = {w: [v for v in n if abs(len(v) - len(w)) < 2 and is_near(v, w)] for w in n}
    form = {w: min(v, key=lambda x: (-n[x], x)) for w, v in near.items() if v}
    form = {w: f for w, f in form.items() if n[f] >= ratio * n[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {(w, form.get(w), root(w), n[w], len(near[w]), n[form[w]] if w in form else None) for w in n}


def spelled(seed):
    rng = random.Random(seed)
    texts, base = [], ["aabbaab", "abababa", "éàÿéàÿé", "bbbbbbb", "aaaaaaaa"]
    for k in range(60):
        w = rng.choice(base)
        for _ in range(rng.randrange(4)):
            p = rng.randrange(len(w))
            w = rng.choice([w[:p] + w[p + 1 :], w[:p] + rng.choice("abé") + w[p:], w[:p] + rng.choice("abÿ") + w[p + 1 :]])
        base.append(w)
        texts.append((k % 50 or None, f"{w.upper()} " * rng.choice([1, 1, 2, 3, 30, 400]) + rng.choice(["", "-short 12", w])))
    return texts + [(60, None), (61, ""), (62, "z" * 300), (63, "z" * 300), (64, "z" * 299), (65, "z" * 299)] + texts[:5] + [(k, f"chainab{'cde'[:k % 4]} " * 11 ** (3 - k % 4)) for k in range(100, 104)]


@pytest.mark.parametrize("seed", [1, 2])
def test_spelling_equals_brute_force(spark, seed):
    texts = spelled(seed)
    got = [tuple(r) for r in spelling.group_variants(frame(spark, texts)).collect()]
    want = forms_of(texts)
    assert len(got) == len(want) and set(got) == want and any(r[1] for r in want) and any(r[2] != r[1] and r[1] for r in want)
    got = [tuple(r) for r in spelling.group_variants(frame(spark, texts), min_length=5, min_count=1, ratio=2, drop_one_in=3).collect()]
    assert set(got) == forms_of(texts, 5, 1, 2, 3)


def test_spelling_of_an_empty_table(spark):
    got = spelling.group_variants(frame(spark, []))
    assert got.count() == 0 and got.columns == ["word", "form", "root", "n", "n_near", "form_n"]


def test_a_group_gives_no_pairs(spark):
    vocabulary = [(k, f"prefix{chr(97 + k)}suffix", k + 1) for k in range(26)]
    df = spark.createDataFrame(vocabulary, "id long, word string, n long")
    groups = spelling.variant_groups(df)
    assert groups.count() == sum(1 + len(w) + len(re.sub(r"(.)\1+", r"\1", w)) for _, w, _ in vocabulary)
    got = {r.id: (r.n_near, r.best["id"]) for r in spelling.near_words(df).collect()}
    assert got == {k: (25, 25 if k < 25 else 24) for k in range(26)}


def draw_of(texts, target, max_run=1, buckets=10_000, percent=10, min_words=20, seed=2024):
    def features(text):
        w = words_of(text)
        return [crc32(" ".join(w[i : i + r]).encode()) % buckets for r in range(1, max_run + 1) for i in range(len(w) - r + 1)]

    own = [features(t) for _, t in texts]
    s, t = collections.Counter(b for f in own for b in f), collections.Counter(b for x in target for b in features(x))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b in range(buckets)]
    rows = []
    for (i, text), f in zip(texts, own, strict=True):
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        rows.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words_of(text))])
    able = sorted((r for r in rows if r[5] >= min_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    for k, r in enumerate(able[: len(able) * percent // 100]):
        r[4] = k + 1
    return collections.Counter(tuple(r[:5]) for r in rows)


@pytest.mark.parametrize("settings", [{}, {"max_run": 3, "buckets": 97, "percent": 37, "min_words": 5, "seed": 7}])
def test_resampling_equals_brute_force(spark, settings):
    rng = random.Random(4)
    word = lambda: rng.choice(["alpha", "Beta", "gamma7", "é", "中文", "don't"])
    texts = [(k, " ".join(word() for _ in range(rng.randrange(60)))) for k in range(150)]
    texts += [(None, "alpha " * 30), (None, None), (500, ""), (501, " \n"), (502, "w" * 3000), (503, "beta x" * 40_000), (504, "alpha " * 20), (504, "alpha " * 20), (504, "alpha " * 25)]
    target = ["Alpha beta", None, "", "gamma7 中文 " * 50]
    got = resampling.resample(frame(spark, texts), spark.createDataFrame([(t, "c") for t in target], "text string, doc_id string"), **settings).collect()
    assert collections.Counter(map(tuple, got)) == draw_of(texts, target, **settings)


def test_streams_are_the_same_in_pieces():
    text = " ".join(f"w{k % 50}" for k in range(3000)).encode()
    folded = text.translate(resampling.FOLD)
    assert sum(resampling._blocks(folded, 64), []) == folded.split()
    known = resampling._Buckets(1000, kept=3)
    assert [known[w] for w in folded.split()] == [crc32(w) % 1000 for w in folded.split()] and len(known) == 3


def test_resampling_without_rows(spark):
    docs, target = frame(spark, [(1, "a b c")]), spark.createDataFrame([], "text string")
    assert resampling.resample(frame(spark, []), docs).count() == 0
    assert [tuple(r) for r in resampling.resample(docs, target, min_words=1, percent=100).select("doc_id", "n_features", "rank").collect()] == [(1, 3, 1)]
