"""Line dedup, collocations and hard negatives against brute force and their SQL twins."""

import random
import re
import string
from collections import Counter, defaultdict
from glob import glob
from math import floor

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from claimforge.llm import collocations, hard_negatives, line_dedup, queries

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_matches_sql(name, spark, small):
    df = queries.QUERIES[name](spark, small)
    duck = duckdb.connect()
    for f in glob(f"{small}/*.parquet"):
        duck.execute(f"create view {f.rsplit('/', 1)[1][:-8]} as select * from '{f}'")
    found = duck.execute(queries.ORACLE[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(tuple, df.select(*names).collect())) == sorted(found.fetchall())


# --- lines ---
def lines_by_hand(rows, min_chars=1, min_documents=10):
    key = lambda line: line.strip(line_dedup.BLANK).translate(LOWER)
    held = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            held[key(line)].add(i if i is not None else ("text", t or ""))
    gone = {k for k, v in held.items() if len(k) >= min_chars and len(v) >= min_documents}
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if key(x) not in gone]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=repr)


def cut(spark, rows, **how):
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"key": F.lit(1), "h1": F.lit("x"), "lines": F.lit(2.0), "position": F.lit(None).cast("int"), "salt": F.lit(3)}).repartition(5)
    found = line_dedup.without_shared_lines(docs, **how)
    assert found.columns == ["doc_id", "text", "n_lines", "n_dropped"]
    return sorted(map(tuple, found.collect()), key=repr)


def test_lines_as_brute_force(spark, prose, odd_rows):
    r = random.Random(4)
    pool = [prose(i, 3) for i in range(12)] + ["", " ", "\tÉcole", "école", "ÉCOLE ", "\x1fx", "x\xa0", "🙂"]
    rows = [(i, "\n".join(r.choice(pool) for _ in range(r.randint(0, 9)))) for i in range(120)]
    rows += odd_rows + [(None, "a\nnone"), (None, "a\nnone"), (None, "b\nnone")] + [(7, "other\ntext"), (7, "other\ntext"), (7, "other")]
    for how in ({}, {"min_documents": 3}, {"min_chars": 0, "min_documents": 2}, {"min_chars": 8, "min_documents": 4}, {"min_documents": 1}):
        assert cut(spark, rows, **how) == lines_by_hand(rows, **how)


def test_a_line_that_all_documents_hold_and_a_text_of_many_lines(spark):
    rows = [(i, f"Shared Line\nown {i}\n  shared line\t") for i in range(3000)] + [(3000, "\n".join(f"l{i % 7}" if i % 2 else "shared line" for i in range(60_000)))]
    assert cut(spark, rows) == lines_by_hand(rows)


def test_documents_are_counted_by_id_and_unnamed_ones_by_text(spark):
    rows = [(1, "same\nx")] * 12 + [(None, "same\ny")] * 12 + [(2, None), (3, "")]
    assert cut(spark, rows) == lines_by_hand(rows) == sorted([(1, "same\nx", 2, 0)] * 12 + [(None, "same\ny", 2, 0)] * 12 + [(2, "", 1, 0), (3, "", 1, 0)], key=repr)


def test_lines_of_odd_and_empty_tables(spark, odd, odd_rows, empty):
    got = sorted(map(tuple, line_dedup.without_shared_lines(odd, min_documents=2).collect()), key=repr)
    assert got == lines_by_hand(odd_rows, min_documents=2)
    assert line_dedup.without_shared_lines(empty).count() == 0


# --- phrases ---
def phrases_by_hand(rows, at_least, covered=80, per_lang=2000):
    f, total = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = lang or "und"
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            w = [x for x in re.split("[ \t]", piece) if x]
            total[lang] += len(w)
            for n in range(1, 5):
                f[lang].update(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    out = []
    for lang, counts in f.items():
        known = {p: a for p, a in counts.items() if len(p) > 1 and a >= at_least}
        inside = lambda p, q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
        scored = []
        for p, a in known.items():
            if any(len(q) > len(p) and 100 * b >= covered * a and inside(p, q) for q, b in known.items()):
                continue
            score, k = min((2000000 * a // (counts[p[:k]] + counts[p[k:]]), k) for k in range(1, len(p)))
            scored.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, left, right, total[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(scored)[:per_lang])]
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2])
def test_phrases_as_brute_force(spark, seed):
    """Words of which one starts a third of all phrases, words that sort around the blank, other alphabets, and a piece of very many equal words."""
    r = random.Random(seed)
    words = ["a", "A", "b", "ab", "a\x01", "\x02", "é", "É", "日本", "🙂", "the", "c", "d"]
    rows = []
    for i in range(150):
        n = r.randint(0, 60)
        text = "".join(("the" if r.random() < 0.3 else r.choice(words)) + r.choice([" ", " ", " ", "  ", "\t", "\n", ", ", ". ", "\x0b", " :"]) for _ in range(n))
        rows.append((r.choice(["en", "de", None]), r.choice([text, text, text, None, ""]) if i % 9 == 0 else text))
    rows += [("en", "x " * 5000), ("en", "q w e r t y " * 40), ("xx", "only once"), ("en", " \t ,,")]
    docs = spark.createDataFrame(rows, "lang string, text string").withColumns({c: F.lit(1) for c in ("doc_id", "phrase", "n", "part", "words", "rank")}).repartition(5)
    for at_least, covered, per_lang in ((2, 80, 2000), (5, 100, 7)):
        got = sorted(map(tuple, collocations.collocations(docs, at_least, covered, per_lang).collect()))
        assert got == phrases_by_hand(rows, at_least, covered, per_lang) and got


def test_phrases_of_odd_and_empty_tables(spark, odd, odd_rows, empty):
    assert sorted(map(tuple, collocations.collocations(odd, 2).collect())) == phrases_by_hand([("en", t) for _, t in odd_rows], 2)
    assert collocations.collocations(empty).count() == 0


def test_blocks_and_false_marks_change_no_count(spark, prose):
    rows = [("en", prose(i % 7, 40)) for i in range(60)]
    docs = spark.createDataFrame(rows, "lang string, text string").coalesce(1)
    assert sorted(map(tuple, collocations.collocations(docs, 6, mark_bits=64, block_chars=500).collect())) == phrases_by_hand(rows, 6)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(*[st.integers(0, 3)] * 4), min_size=1, max_size=60), st.sampled_from([4, 2**17, 2**40]))
def test_distinct_rows(rows, size):
    columns, n = collocations.distinct_rows([np.array(c, np.int64) for c in zip(*rows, strict=True)], size)
    assert dict(zip(zip(*(c.tolist() for c in columns), strict=True), n.tolist(), strict=True)) == Counter(rows)


def test_scores_beyond_64_bits(spark):
    """2,000,000 times a count of 10**16 isn't a long."""
    big = 10**16
    row = spark.range(1).select(F.lit(big + 1).alias("a"), F.array(F.lit(3 * big)).alias("lefts"), F.array(F.lit(2 * big + 5)).alias("rights"))
    assert row.selectExpr("cast(2000000 as decimal(38, 0)) * a div (cast(lefts[0] as decimal(20, 0)) + rights[0]) as s").first().s == 2000000 * (big + 1) // (5 * big + 5)


# --- hard negatives ---
def negatives_by_hand(rows, every=5, positives=5, negatives=3):
    known = {}
    for i, y, v in rows:
        if i is None or y is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        q = [floor(256 * x) for x in v]
        known.setdefault(i, []).append((y, len(v), q))
    known = {i: min(v, key=lambda x: (x[0], x[1], hard_negatives.packed(np.array(x[2], np.int64)))) for i, v in known.items()}
    out = []
    for a in (i for i in known if i % every == 0):
        y, n, q = known[a]
        score = {i: sum(x * z for x, z in zip(q, w, strict=True)) for i, (_, m, w) in known.items() if m == n and i != a}
        order = sorted(score, key=lambda i: (-score[i], i))
        for p in [i for i in order if known[i][0] == y][:positives]:
            fit = [i for i in order if known[i][0] != y and 50 * score[p] <= 100 * score[i] <= 95 * score[p]][:negatives]
            out += [(a, p, r + 1, i, score[p], score[i]) for r, i in enumerate(fit)]
    return sorted(out)


def mined(spark, rows, **how):
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").withColumns({c: F.lit("z") for c in ("score", "slot", "dim", "codes", "limits", "a", "b", "side")}).repartition(3)
    return sorted(map(tuple, hard_negatives.hard_negatives(df, lambda i: i % 5 == 0, F.col("label"), **how).collect()))


def test_hard_negatives_as_brute_force(spark, monkeypatch):
    """Over several tiles, with a vector that a third of all rows hold, ties, repeated ids, other lengths, and rows that take no part."""
    monkeypatch.setattr(hard_negatives, "BLOCK", 40)
    monkeypatch.setattr(hard_negatives, "ANCHOR_BLOCK", 16)
    r = np.random.default_rng(3)
    rows = [(i, int(r.integers(0, 3)), [0.5, 0.25, -0.5, 0.75] if i % 3 == 0 else r.normal(size=4).round(2).tolist()) for i in range(-20, 200)]
    rows += [(300, None, [1.0] * 4), (301, 1, None), (302, 1, [1.0, None, 1.0, 1.0]), (303, 1, [float("nan"), 1.0, 1.0, 1.0]), (304, 1, [float("inf")] * 4), (None, 1, [1.0] * 4)]
    rows += [(305, 1, [1.0, 2.0]), (310, 1, [2.0, 2.0]), (311, 1, [1.5, 2.0]), (312, 2, [1.0, 1.5]), (315, 1, []), (316, 1, []), (317, 2, []), (40, 1, [1.0] * 4), (40, 0, [2.0] * 4), (45, 1, [0.0] * 4)]
    got = mined(spark, rows)
    assert got == negatives_by_hand(rows) and len(got) > 100
    assert mined(spark, rows, positives=2, negatives=1) == negatives_by_hand(rows, positives=2, negatives=1)


def test_hard_negatives_of_few_rows_and_empty_tables(spark):
    assert mined(spark, [(0, 1, [1.0])]) == mined(spark, [(0, 1, [1.0]), (1, 1, [1.0])]) == mined(spark, []) == []
    zeros = [(0, 1, [0.0]), (1, 1, [0.0]), (2, 2, [0.0])]
    assert mined(spark, zeros) == negatives_by_hand(zeros) == [(0, 1, 1, 2, 0, 0)]


@pytest.mark.parametrize("size", [10, 2**11, 2**25, 2**30, 2**40, 2**62])
def test_products_are_exact(size):
    r = np.random.default_rng(size % 97)
    a, b = r.integers(-size, size, (5, 8)), r.integers(-size, size, (6, 8))
    want = [[max(-(2**63) + 1, min(2**63 - 1, sum(x * y for x, y in zip(u, v, strict=True)))) for v in b.tolist()] for u in a.tolist()]
    assert hard_negatives.products(a, b).tolist() == want


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(-40, 40), min_size=1, max_size=12), st.integers(1, 4))
def test_best_keeps_first_of_ties(values, k):
    row, column = hard_negatives.best(np.array([values, values]), k)
    want = sorted(range(len(values)), key=lambda i: (-values[i], i))[:k]
    assert column.tolist() == want * 2 and row.tolist() == [0] * len(want) + [1] * len(want)
