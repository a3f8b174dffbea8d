"""Terms, the block index and the blocked matrix search against brute force."""

import os
import pathlib
import random
import re
import subprocess
import sys
import zipfile
from collections import Counter
from math import log, sqrt

import numpy as np
import pyspark
from pyspark.sql import functions as F

from claimforge.operators import dense, retrieval, terms


def words_by_hand(text):
    """As Python's own word pattern splits, which is Unicode's."""
    w = [x for x in re.findall(r"(?u)\b\w\w+\b", text.lower()) if x not in terms.english_stop_words()]
    return Counter(w + [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)])


TEXTS = ["Die Müller Straße über Öl façade привет мир", "the code_1 of a claim x²y 日本語 テキスト", "", "a", "No stop-word's here: ½ ٣٤ été naïve", "claim claim code claim", None]


def test_words_of_all_alphabets(spark):
    assert len(terms.english_stop_words()) == 318
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "id int, text string")
    got = {}
    for r in terms.terms(rows, "id", "text").collect():
        got.setdefault(r.id, {})[r.term] = r.tf
    assert got == {i: c for i, t in enumerate(TEXTS) if (c := words_by_hand(t or ""))}
    assert set(got[0]) >= {"müller", "straße", "öl", "façade", "привет", "привет мир"}
    assert {r.term for r in terms.terms(rows.where("id = 1"), "id", "text", ()).collect()} >= {"the", "of", "the code_1"}


def test_weights_by_hand(spark):
    texts = [(i, t) for i, t in enumerate(TEXTS) if t is not None] * 1
    rows = spark.createDataFrame(texts, "id int, text string")
    tf = terms.terms(rows, "id", "text")
    got = {(r.id, r.term): r.weight for r in terms.tfidf(tf, terms.vocabulary(tf, rows), "id").collect()}
    counts = {i: words_by_hand(t) for i, t in texts}
    df = Counter(t for c in counts.values() for t in c)
    want = {}
    for i, c in counts.items():
        w = {t: (1 + log(n)) * (log((1 + len(texts)) / (1 + df[t])) + 1) for t, n in c.items()}
        want |= {(i, t): x / sqrt(sum(y * y for y in w.values())) for t, x in w.items()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    hashed = terms.hashing_vectors(tf, "id", 8).collect()
    assert all(abs(sum(r.weight**2 for r in hashed if r.id == i) - 1) < 1e-9 for i in {r.id for r in hashed})


def vectors(seed, n, topics=12):
    """Rows of a few terms around a topic; one term is in every row."""
    r = random.Random(seed)
    out = []
    for i in range(n):
        topic = r.randrange(topics)
        w = {"common": 0.1, **{f"t{topic}.{r.randrange(6)}": r.choice([1, 2, 3]) for _ in range(4)}, f"t{topic}": 4.0, f"x{r.randrange(40)}": 0.5}
        norm = sqrt(sum(x * x for x in w.values()))
        out += [(i, t, x / norm) for t, x in w.items()]
    return out


def test_block_search_is_exact_and_leaves_blocks_out(spark):
    corpus, asked = vectors(1, 600), vectors(2, 15)
    index = terms.indexed(spark.createDataFrame(corpus, "key long, term string, weight double"), "key", 20).cache()
    queries = spark.createDataFrame(asked, "query_id long, term string, weight double")
    of_row, of_query = ({i: {t: w for j, t, w in rows if j == i} for i in {r[0] for r in rows}} for rows in (corpus, asked))
    want = {}
    for q, wq in of_query.items():
        scores = {i: round(s, 6) for i, w in of_row.items() if (s := sum(x * w[t] for t, x in wq.items() if t in w)) > 0}
        want[q] = [(i, scores[i]) for i in sorted(scores, key=lambda i: (-scores[i], i))[:7]]
    got = {}
    for r in terms.sparse_search(queries, index, "query_id", "key", 7).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.key, round(r.score, 6)))
    assert got == want
    blocks = index.select("block").distinct().count()
    reached = terms.reachable(queries.select("query_id", "term", F.col("weight").alias("wq")), index, "query_id", "key", 7).count()
    assert blocks >= 30 and reached < 0.5 * blocks * len(of_query)
    assert terms.sparse_search(queries.where("query_id < 0"), index, "query_id", "key", 3).count() == 0


def test_fewer_rows_than_asked_for(spark):
    index = terms.indexed(spark.createDataFrame([(1, "a", 1.0), (2, "a", 0.6), (2, "b", 0.8), (3, "c", 1.0)], "key long, term string, weight double"), "key")
    queries = spark.createDataFrame([(0, "a", 1.0), (1, "z", 1.0)], "q long, term string, weight double")
    assert sorted(map(tuple, terms.sparse_search(queries, index, "q", "key", 5).collect())) == [(0, 1, 1.0, 1), (0, 2, 0.6, 2)]


def test_blocked_matrix_search_as_brute_force(spark):
    r = np.random.default_rng(7)
    rows = [(i, [1.0, 0.0, 0.0, 0.0] if i % 3 == 0 else r.normal(size=4).tolist(), "x") for i in range(300)]
    rows += [(400, None, "x"), (401, [1.0, None, 0.0, 0.0], "x"), (None, [1.0] * 4, "x"), (402, [0.0] * 4, "x"), (403, [1.0, 2.0], "x"), (404, [2.0, 4.0], "x"), (405, [], "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, side string").repartition(5)
    got = sorted(map(tuple, dense.dense_search(df.where("vec_id % 5 = 0 or vec_id > 399"), df, 6, block_rows=40, query_rows=16).collect()))
    known = {i: np.array(v) for i, v, _ in rows if i is not None and v is not None and None not in v}
    unit = {i: v / (np.sqrt(v @ v) or 1) for i, v in known.items()}
    want = []
    for q in (i for i in known if i % 5 == 0 or i > 399):
        scores = {i: round(float(unit[q] @ u), 6) + 0.0 for i, u in unit.items() if i != q and len(u) == len(unit[q])}
        want += [(q, i, scores[i], n + 1) for n, i in enumerate(sorted(scores, key=lambda i: (-scores[i], i))[:6])]
    assert got == sorted(want)
    assert dense.dense_search(df.limit(0), df, 3).count() == 0


def test_blanks_of_unicode_part_words(spark):
    section = spark.createDataFrame([("d", "one two three\x1cfour\x85five\n six\tseven")], "document_id string, text string")
    assert retrieval.windows(section, 3, 1).orderBy("window_index").select("chunk_text").collect()[0][0] == "one two three"
    assert retrieval.windows(section, 100, 1).first().chunk_text.split(" ") == "one two three four five six seven".split()


def test_queries_are_named_where_neither_a_session_nor_sparks_jars_are_at_hand(tmp_path):
    """The registry loads with pyspark read from a zip file, as under spark-submit, before there is a session."""
    home = pathlib.Path(pyspark.__file__).parent
    with zipfile.ZipFile(tmp_path / "pyspark.zip", "w") as z:
        for f in [*home.rglob("*.py"), *home.rglob("error-conditions.json")]:
            z.write(f, f"pyspark/{f.relative_to(home)}")
    code = "import pyspark, __spark_entry__ as e; assert '.zip' in pyspark.__file__; print(len(e.queries()) > 50 and len(e.oracle_sql()) > 50)"
    env = os.environ | {"PYTHONPATH": f"{tmp_path / 'pyspark.zip'}:{pathlib.Path(__file__).resolve().parents[1]}"}
    assert subprocess.run([sys.executable, "-c", code], env=env, capture_output=True, text=True, timeout=120).stdout.strip() == "True"
