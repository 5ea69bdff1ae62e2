"""Lexical search, line dedup and spelling variants against brute force, and on unusual rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnlake.llm import lexical, line_runs, spellings
from tarnlake.session import stored

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{i % 977}x{chr(97 + i % 26) * 4}" for i in range(60_000))
UNUSUAL = [
    (1, None, "en", "a", 0), (2, "", None, None, None), (3, " \n\t ", "en", "a", 4), (None, "no id here at all", "en", None, 17),
    (None, "no id here at all", "en", None, 17), (5, "same text of seven words in all", "de", "b", 31),
    (5, "same text of seven words in all", "de", "b", 31), (6, "same text of seven words in all", "fr", "b", 31),
    (7, LONG, "en", "a", len(LONG)), (8, "x \n\ny z 日本語 \U0001f600 Straße\r\n'll \x0b\x0c end", "ja", "c", 1),
    (9, "Same TEXT of seven words in all \t\nsame text of seven words in all\nother", "en", "a", 1),
    (10, "Été ÉTUDE études étude", "fr", "a", 1), (-4, "OTHER\n same text of seven words in all", "en", "a", 1),
]
BENCHMARK = [
    (1, "Same words in ALL"), (1, "words here"), (2, None), (3, "日本語 \U0001f600 end"), (None, "same words"),
    (4, "w1xbbbb w2xcccc nowhere"), (5, "  "), (6, "id id ID at"),
]


@pytest.fixture(scope="module")
def unusual(spark):
    return spark.createDataFrame(UNUSUAL, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame(BENCHMARK, "item_id long, text string")


def clash(df):
    names = ["lines", "line_doc", "line_copy", "line_gone", "doc", "copy", "pos", "gone", "batch", "h1", "word", "n", "ids", "term", "lane"]
    return df.withColumns({name: F.lit("mine") for name in names})


def table(spark, texts):
    return spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in texts], DOCS)


# --- lexical search ---------------------------------------------------------------------------------

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def ranked(docs, items, k=10):
    counted = [(i, Counter(TERM.findall((t or "").translate(LOWER)))) for i, t in docs]
    counted = [(i, c) for i, c in counted if c]
    n_docs, total = len(counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(term for _, c in counted for term in c)
    by = {}
    for item, text in items:
        if item is not None:
            by.setdefault(item, set()).update(TERM.findall((text or "").translate(LOWER)))
    out = []
    for item, own in by.items():
        scores = []
        for i, c in counted:
            m = 10 + 90 * sum(c.values()) * n_docs // total
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m))
                        for t in own if t in c)
            if score > 0:
                scores.append((-score, i is None, i or 0))
        out += [(item, rank, None if missing else i, -score) for rank, (score, missing, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=repr)


def found(df):
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect()), key=repr)


def test_lexical_unusual(spark, unusual, empty, items):
    expected = ranked([(r[0], r[1]) for r in UNUSUAL], BENCHMARK)
    assert found(lexical.report(clash(unusual).repartition(3), clash(items))) == expected and len(expected) > 10
    assert lexical.report(empty, items).count() == 0 and lexical.report(unusual, items.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_lexical_blocks(spark, monkeypatch, seed):
    """Many small blocks and ties; searches that open one range at a time, or all."""
    draw = random.Random(seed)
    vocabulary = [f"t{k}" for k in range(60)]
    docs = [(i, " ".join(draw.choices(vocabulary, [1 / (k + 1) for k in range(60)], k=draw.randint(0, 25)))) for i in range(400)]
    wanted = [(i, " ".join(draw.choices(vocabulary, k=draw.randint(1, 12)))) for i in range(30)]
    expected = ranked(docs, wanted)
    number = {t: k for k, t in enumerate(vocabulary)}
    counted = [(i, Counter(t.split())) for i, t in docs if t]
    n_docs, total = len(counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    m = np.array([10 + 90 * sum(c.values()) * n_docs // total for _, c in counted], np.int64)
    codes = [(int(lexical._spread(np.array([number[t]]))[0]) << 1) | int(lexical._spread(np.array([d]))[0])
             for d, (_, c) in enumerate(counted) for t, tf in c.items() for _ in range(tf)]
    places, frequencies = np.unique(np.array(codes, np.uint64), return_counts=True)
    levels = 9
    treap = lexical.Treap([i for i, _ in counted], m, [t.encode() for t in vocabulary], levels,
                          *lexical.Treap.pack(places, frequencies, m, levels), frequencies)
    for width in (1, 7, 1000):
        monkeypatch.setattr(lexical, "WIDTH", width)
        got = []
        for item, text in wanted:
            own = sorted(set(text.split()))
            weights = [math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) for t in own]
            best = treap.best([t.encode() for t in own], weights, 10, [])
            got += [(item, rank, i, -score) for rank, (score, _, i) in enumerate(best, 1)]
        assert sorted(got, key=repr) == expected
    spread = spark.createDataFrame([(i, t) for i, t in docs], "doc_id long, text string").repartition(7)
    assert found(lexical.report(spread, spark.createDataFrame(wanted, "item_id long, text string"))) == expected


def test_lexical_many_items_go_to_lanes(spark, monkeypatch):
    monkeypatch.setattr(lexical, "BROADCAST_BYTES", 10)
    monkeypatch.setattr(lexical, "GROUP_ITEMS", 4)
    docs = [(i, f"alpha beta{i % 7} gamma{i % 11} word{i}") for i in range(200)]
    wanted = [(i, f"beta{i % 7} gamma{i % 5} word{i * 3}") for i in range(25)]
    got = lexical.report(spark.createDataFrame(docs, "doc_id long, text string").repartition(5),
                         spark.createDataFrame(wanted, "item_id long, text string"))
    assert found(got) == ranked(docs, wanted)


def test_bounds_are_never_below_impacts():
    tf, m = np.meshgrid(np.array([1, 2, 3, 10, 1000, 10**6]), np.array([10, 11, 100, 1000, 10**7]))
    exact = lexical.impact(tf.ravel(), m.ravel())
    assert ((exact // lexical._STEP + 1) * lexical._STEP > exact).all() and exact.max() // lexical._STEP + 1 <= 255


# --- line dedup -------------------------------------------------------------------------------------

def deduplicated(rows):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    last = (1 << 63) - 1

    def key(line):
        return line.strip(" \t\n\x0b\x0c\r").translate(low)

    first = {}
    for i, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= 10:
                first[key(line)] = min(first.get(key(line), last), last if i is None else i)
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(key(x)) < 10 or first[key(x)] >= (last if i is None else i)]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def digests(rows):
    return sorted(((i, n, gone, hashlib.sha256(t.encode()).hexdigest()) for i, n, gone, t in rows), key=repr)


def judged(df):
    return sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in df.collect()), key=repr)


def test_lines_unusual(spark, unusual, empty):
    rows = [(r[0], r[1]) for r in UNUSUAL]
    assert judged(line_runs.report(clash(unusual).repartition(3))) == digests(deduplicated(rows))
    kept = line_runs.drop_repeated_lines(clash(unusual))
    assert kept.columns == clash(unusual).columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == sorted(((i, t) for i, _, _, t in deduplicated(rows)), key=repr)
    assert line_runs.report(empty).count() == 0


@pytest.mark.parametrize("batches", [1, 2, 7])
def test_lines_in_batches(spark, batches):
    """The number of batches, and so of merges, changes nothing; one line is in a third of all documents."""
    draw = random.Random(batches)
    pool = [f"Common line number {k}" for k in range(40)]
    texts = [(i * 3, "\n".join((["the one HOT line of all"] if i % 3 == 0 else []) + [
        draw.choice([" ", "", "\t"]) + draw.choice(pool).upper() if draw.random() < 0.5 else f"line {draw.random()}"
        for _ in range(draw.randint(0, 12))])) for i in range(300)]
    expected = deduplicated(texts)
    got = line_runs.without_repeated(table(spark, texts).repartition(5), batches=batches)
    rows = [(r.doc_id, r.lines.n_lines, r.lines.n_dropped, r.lines.kept) for r in got.collect()]
    assert sorted(rows, key=repr) == expected and sum(r[2] for r in expected) > 300


def test_runs_are_levelled_and_merged_in_place(spark):
    """Five batches leave one run of four and one of one; runs are merged without a shuffle or a sort."""
    runs = line_runs.LineRuns(spark)
    seen = set()
    for batch in range(5):
        keys = [(batch * 10 + k, batch + k, batch + k + 1) for k in range(10)]
        lines = stored(spark.createDataFrame(keys, "doc long, h1 long, h2 long"), "batch-lines")
        doubled = {(r.h1, r.h2): r.stays for r in runs.add(lines).collect()}
        own = {(h1, h2) for _, h1, h2 in keys}
        assert doubled == {key: None for key in own & seen}
        seen |= own
    runs._compact()
    assert [len(names) for names in runs.levels] == [1, 0, 1]
    names = [name for level in runs.levels for name in level]
    assert sorted(tuple(r) for name in names for r in spark.table(name).collect()) == sorted(seen)
    with line_runs.session_conf(spark, line_runs._SORTED_BUCKETS):
        joined = spark.table(names[0]).join(spark.table(names[1]).hint("merge"), ["h1", "h2"], "left_anti")
        plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan and "Sort [" not in plan
    runs.close()


# --- spelling variants ------------------------------------------------------------------------------

def neighbours(words):
    alphabet = sorted({c for w in words for c in w})
    near = {}
    for w in words:
        own = {w[:i] + w[i + 1:] for i in range(len(w))}
        own |= {w[:i] + a + w[i + 1:] for i in range(len(w)) for a in alphabet}
        own |= {w[:i] + a + w[i:] for i in range(len(w) + 1) for a in alphabet}
        near[w] = {x for x in own if x in words and x != w}
    return near


def spelled(rows):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{i}:{run}".encode())
            if i is not None and h % 97 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    counts = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    near = neighbours(counts)
    form = {}
    for w, own in near.items():
        best = min(own, key=lambda x: (-counts[x], x), default=None)
        if best is not None and counts[best] >= 2 * counts[w]:
            form[w] = best

    def root(w):
        return root(form[w]) if w in form else w

    return sorted(((w, form.get(w), root(w), n, len(near[w]), counts[form[w]] if w in form else None) for w, n in counts.items()), key=repr)


def variants_of(df):
    return sorted(((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()), key=repr)


def test_spellings_unusual(spark, unusual, empty):
    rows = [(r[0], r[1]) for r in UNUSUAL]
    assert variants_of(spellings.report(clash(unusual).repartition(3))) == spelled(rows)
    assert spellings.report(empty).count() == 0


def test_spellings_of_many_variants(spark, monkeypatch):
    """Chains of forms, ties, letters beyond ASCII; tables of counts that are emptied all the time."""
    monkeypatch.setattr(spellings, "HELD_WORDS", 50)
    draw = random.Random(5)
    letters = "abcdeéß×É"
    words = ["".join(draw.choices(letters, k=draw.randint(4, 9))) for _ in range(60)]
    for _ in range(500):
        w = draw.choice(words)
        i = draw.randrange(len(w))
        words.append(draw.choice([w[:i] + w[i + 1:], w[:i] + draw.choice(letters) + w[i:], w[:i] + draw.choice(letters) + w[i + 1:]]) or "abcde")
    rows = [(i, " ".join(draw.choices(words, [1 / (k + 1) for k in range(len(words))], k=60)).upper().replace("É", "é")) for i in range(300)]
    rows = [(i, t.replace("SS", "ß")) for i, t in rows]
    expected = spelled(rows)
    assert sum(1 for w in expected if w[2] != w[1] and w[1]) > 5
    assert variants_of(spellings.report(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))) == expected


def test_hot_chunks_grow(spark):
    """Thousands of words share their first half and hundreds their last; no chunk pairs them all, and no pair is lost."""
    draw = random.Random(9)
    words = {"aaaaaaaaaa" + "".join(draw.choices("abcdef", k=10)) for _ in range(1500)}
    words |= {"".join(draw.choices("xyz", k=10)) + "zzzzzzzzzz" for _ in range(300)}
    for w in draw.sample(sorted(words), 300):
        i = draw.randrange(len(w))
        words |= {w[:i] + w[i + 1:], w[:i] + "g" + w[i + 1:], w[:i] + "g" + w[i:]}
    rows = spark.createDataFrame([(w, 3) for w in sorted(words)], "word string, n long")
    got = {}
    for r in spellings.near_words(rows).collect():
        got.setdefault(r.word, []).append(r.other)
    expected = {w: sorted(own) for w, own in neighbours(words).items() if own}
    assert {w: sorted(own) for w, own in got.items()} == expected


def test_spoiled_runs():
    for run in ("abcdefgh", "étude"):
        crc = zlib.crc32(b"12:")
        hits = [k for k in range(2000) if zlib.crc32((run + "x" * k).encode(), crc) % 97 == 0]
        assert hits and all(len(spellings.spoiled(run + "x" * k, crc)) == len(run) + k - 1 for k in hits)
        assert spellings.spoiled(run + "x" * (hits[0] + 1), crc) in (run + "x" * (hits[0] + 1), run + "x" * hits[0])
