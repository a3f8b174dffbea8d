"""Near duplicates, passages and fingerprints against brute force."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from claimforge.llm import components, imatch, near_dedup, substring_dedup
from claimforge.llm.common import batch_shingles, shingle_hashes, words_of


def brute_components(rows):
    sets = {i: set(shingle_hashes(words_of(t or "")).tolist()) for i, t in rows if i is not None}
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 85 * len(x | y):
                p, q = find(a), find(b)
                parent[max(p, q)] = min(p, q)
    return {i: find(i) for i in ids}


def family(prose, seed, copies, edits):
    """Copies of a text with a few words changed each."""
    words, r = prose(seed, 300).split(), random.Random(seed)
    out = []
    for _ in range(copies):
        w = list(words)
        for _ in range(r.randint(0, edits)):
            w[r.randrange(len(w))] = f"edit{r.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def test_near_duplicates_as_brute_force(spark, prose, odd_rows, odd, empty):
    texts = family(prose, 1, 40, 8) + family(prose, 2, 10, 3) + [prose(s, 200) for s in range(50, 80)]
    rows = [(i * 3, t) for i, t in enumerate(texts)]
    found = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in found} == brute_components(rows)
    rows = near_dedup.near_duplicates(odd).collect()
    assert len(rows) == len(odd_rows) and all(r.kept for r in rows if r.doc_id is None)
    assert {r.doc_id: r.component_id for r in rows if r.doc_id is not None} == brute_components(odd_rows)
    assert near_dedup.near_duplicates(empty).count() == 0


def test_a_hub_joins_copies_that_are_not_alike(spark, prose):
    hub, r = prose(7, 300).split(), random.Random(7)
    rows = []
    for i in range(120):
        w = list(hub)
        for at in [] if i == 60 else r.sample(range(0, 300, 10), 4):
            w[at + r.randrange(4, 9) if at < 290 else at] = f"edit{r.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, prose(900 + i, 100)) for i in range(10)]
    want = brute_components(rows)
    assert sum(c == 0 for c in want.values()) > 100
    assert len(set(brute_components([r for r in rows if r[0] != 60]).values())) > 50
    found = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in found} == want


def test_form_letters(spark, prose):
    """Letters that fill a form's gaps differently, most of them too different to link, each with a near copy."""
    form, r = prose(11, 400).split(), random.Random(11)
    rows = []
    for i in range(150):
        w = list(form)
        for at in r.sample(range(400), 6):
            w[at : at + 1] = prose(5000 + i * 400 + at, r.randint(1, 6)).split()
        twin = list(w)
        for at in r.sample(range(len(w)), 3):
            twin[at] = f"edit{r.randrange(10**6)}"
        rows += [(i * 2, " ".join(w)), (i * 2 + 1, " ".join(twin))]
    r.shuffle(rows)
    want = brute_components(rows)
    assert 20 < len(set(want.values())) < 290
    found = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in found} == want


def test_one_id_with_several_texts(spark, prose):
    """Such an id is linked with what either of its texts is linked with."""
    a, b, c = prose(21, 100), prose(22, 100), prose(23, 100)
    rows = [(1, a), (2, a), (2, b), (3, b + " more"), (4, c), (5, c), (5, ""), (6, None), (7, a + " x"), (9, c), (9, c)]
    found = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_shingles > 0, r.component_id) for r in found) == [(1, True, 1), (2, True, 1), (2, True, 1), (3, True, 1), (4, True, 4), (5, False, 5), (5, True, 4), (6, False, 6), (7, True, 1), (9, True, 4), (9, True, 4)]


@settings(max_examples=50, deadline=None)
@given(st.sets(st.integers(0, 2**64 - 1), min_size=1, max_size=80), st.sets(st.integers(0, 2**64 - 1), max_size=80))
def test_parity_is_a_bound(a, b):
    x, y = (np.array(sorted(s), np.uint64) for s in (a, b))
    bits = np.unpackbits((near_dedup.parity_of(x) ^ near_dedup.parity_of(y)).view(np.uint8)).sum()
    assert bits <= len(a ^ b)


def test_signatures_estimate_similarity_with_lower_variance():
    r, errors = np.random.default_rng(3), []
    for _ in range(60):
        base = r.integers(0, 2**63, 120, dtype=np.uint64)
        a, b = (np.unique(np.concatenate([base, r.integers(0, 2**63, 60, dtype=np.uint64)])) for _ in range(2))
        s = near_dedup.signatures([a, b])
        errors.append((s[0] == s[1]).mean() - 120 / 240)
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < (0.25 / near_dedup.SIGNATURE) ** 0.5


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    found = {r.id: r.component for r in components.components(edges, "a", "b").collect()}
    assert found == {i: 0 for i in range(41)} | {100: 100, 101: 100}


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 30), min_size=1, max_size=80), st.integers(1, 12))
def test_compact_windows_are_the_cartesian_tree(values, width):
    values = values + values[::-1]
    h = np.array(values, np.uint64) << np.uint64(20)
    bits, want = len(values).bit_length(), []

    def descend(lo, hi):
        if hi - lo + 1 >= width:
            c = min(range(lo, hi + 1), key=lambda i: (int(h[i]) >> bits, i))
            want.append((lo, c, hi))
            descend(lo, c - 1)
            descend(c + 1, hi)

    bounds = [0, len(h) // 2, len(h) // 2, len(h) - min(3, len(h) // 2), len(h)]
    for a, b in zip(bounds, bounds[1:], strict=False):
        descend(a, b - 1)
    got = substring_dedup.compact_windows(h, np.array(bounds), width)
    assert sorted(zip(*(x.tolist() for x in got), strict=True)) == sorted(want)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab \t\u00a0", max_size=40), max_size=6))
def test_shingles_of_a_batch_are_those_of_each_text(texts):
    h, bounds = batch_shingles(texts)
    assert len(bounds) == len(texts) + 1
    for i, t in enumerate(texts):
        assert h[bounds[i] : bounds[i + 1]].tolist() == shingle_hashes(words_of(t)).tolist()


def test_shared_passages_are_found_and_cut(spark, prose, odd, empty):
    passage = prose(99, 70)
    rows = [(i, f"{prose(200 + i, 120)} {passage} {prose(300 + i, 90)}") for i in range(12)] + [(50 + i, prose(400 + i, 200)) for i in range(10)]
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    found = substring_dedup.repeated_passages(df).collect()
    assert {r.doc_id for r in found} == set(range(1, 12)) and all(r.source_doc_id == 0 for r in found)
    assert all(abs(r.first_word - 120) <= 3 and abs(r.end_word - 190) <= 3 for r in found)
    cut = {r.doc_id: r for r in substring_dedup.without_repeats(df).collect()}
    assert passage in cut[0].text and all(passage not in cut[i].text and len(cut[i].text) == cut[i].n_chars for i in range(1, 12))
    assert all(cut[i].text == t for i, t in rows if i >= 50)
    assert {r.doc_id for r in substring_dedup.repeated_passages(odd).collect()} >= {8}
    assert substring_dedup.repeated_passages(empty).count() == 0 and substring_dedup.without_repeats(odd).count() == odd.count()


def edited(text, r, every=0, edits=0):
    """The text with each `every`-th word replaced, or some words replaced, put in or taken out."""
    w = text.split()
    if every:
        w = [f"new{r.randrange(10**6)}" if i % every == every // 2 else x for i, x in enumerate(w)]
    for _ in range(edits):
        at = r.randrange(5, len(w) - 5)
        w[at : at + 1] = [[], [f"new{r.randrange(10**6)}"], [w[at], f"new{r.randrange(10**6)}"]][r.randrange(3)]
    return " ".join(w)


def test_recall_where_earlier_documents_hold_edited_or_partial_copies(spark, prose):
    """Every exact repeat of 50 words and more is found, and 0.95 of those with few edits, though an earlier document holds the
    passage with every tenth word replaced, and a frequent line stands inside."""
    r = random.Random(5)
    line = prose(9999, 20)
    rows, exact, near = [], {}, {}

    def put(text):
        n = len(rows)
        rows.append((n, f"{prose(10_000 + n, 60)} {text} {prose(20_000 + n, 60)}"))
        return n

    for i in range(25):
        put(line)
    for i in range(150):
        passage = prose(30_000 + i, (60, 50, 100, 200)[i % 4])
        if i % 3 == 0:
            w = passage.split()
            passage = " ".join([*w[:15], *line.split(), *w[35:]])
        for kind in ((0, 1), (1, 0))[i % 2] if i % 5 else (1, 0, 1):
            put(edited(passage, r, every=10) if kind == 0 else passage)
        if i % 4 == 1:
            put(edited(passage, r, every=9))
        if i % 2:
            exact[put(passage)] = len(passage.split())
        else:
            exact[put(passage)] = len(passage.split())
            near[put(edited(passage, r, edits=len(passage.split()) // 50))] = len(passage.split())
    found = {}
    for p in substring_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        found.setdefault(p.doc_id, []).append((p.first_word, p.end_word))

    def covered(i, n):
        """The share of the passage's words that is reported."""
        return len({w for a, b in found.get(i, []) for w in range(a, b)} & set(range(60, 60 + n))) / n

    assert all(covered(i, n) >= 0.9 for i, n in exact.items())
    assert sum(covered(i, n) >= 0.6 for i, n in near.items()) >= 0.95 * len(near)
    assert not set(found) & set(range(25))


def brute_repeats(rows, n=50):
    """(doc_id, place) of every run of n words that an earlier document, or an earlier place of the same one, holds."""
    seen, repeated = {}, set()
    for i, t in sorted(rows):
        words = words_of(t)
        for at in range(len(words) - n + 1):
            if seen.setdefault(tuple(words[at : at + n]), (i, at)) != (i, at):
                repeated.add((i, at))
    return repeated


def test_repeated_passages_as_brute_force(spark, prose):
    """Copies, passages of 50 words and more in several documents, twice in one, nested and with edits, short lines in many: every
    repeated run of 50 words is in reported passages, and every reported passage is as alike as stated, by sets of whole shingles.

    A passage ends where it ends in the holder that it was held against; another holder may share a chance word more at an end. So up
    to three words of a run may be missing.
    """
    r = random.Random(17)
    passages = [prose(70_000 + k, r.choice([50, 51, 55, 70, 120])) for k in range(8)]
    line, rows = prose(71_000, 15), []
    for i in range(60):
        parts = [prose(72_000 + i, r.randint(10, 80))]
        for _ in range(r.randint(0, 2)):
            some = r.choice(passages)
            parts += [edited(some, r, edits=1) if r.random() < 0.2 else some, prose(73_000 + 100 * i + len(parts), r.randint(5, 60))]
        if r.random() < 0.4:
            parts += [line, prose(74_000 + i, 30)]
        rows.append((i, "  ".join(parts)))
    rows += [(60 + k, rows[3 * k][1]) for k in range(5)] + [(70, f"{passages[0]} {prose(75_000, 20)} {passages[0]}"), (71, prose(75_001, 49)), (72, "")]
    found = substring_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    texts, reported = {i: words_of(t) for i, t in rows}, set()
    for p in found:
        ours, theirs = texts[p.doc_id][p.first_word : p.end_word], texts[p.source_doc_id][p.source_first_word : p.source_end_word]
        a, b = ({tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (ours, theirs))
        assert (p.source_doc_id, p.source_first_word) < (p.doc_id, p.first_word) and len(ours) >= 50
        assert len(a & b) / len(a | b) >= 0.8 and abs(len(a & b) / len(a | b) - p.similarity) < 1e-9
        reported |= {(p.doc_id, w) for w in range(p.first_word, p.end_word)}
    repeated = brute_repeats(rows)
    missing = [len({(i, w) for w in range(at, at + 50)} - reported) for i, at in repeated]
    assert len(repeated) > 500 and max(missing) <= 3 and sum(map(bool, missing)) <= 0.02 * len(missing)


def test_each_text_of_an_id_loses_its_own_repeats_only(spark, prose):
    passage, other = prose(41, 80), prose(42, 150)
    rows = [(1, f"{prose(43, 60)} {passage}"), (2, f"{prose(44, 60)} {passage} {prose(45, 60)}"), (2, other), (3, None), (3, f"{passage} {prose(46, 60)}"), (3, f"{passage} {prose(46, 60)}")]
    df = spark.createDataFrame([(i, t, "x", 7) for i, t in rows], "doc_id long, text string, tie string, n_chars long")
    got = sorted((r.doc_id, r.text or "", r.tie, r.n_chars) for r in substring_dedup.without_repeats(df).collect())
    want = [rows[0], (2, f"{prose(44, 60)} {prose(45, 60)}"), (2, other), (3, ""), (3, f" {prose(46, 60)}"), (3, f" {prose(46, 60)}")]
    assert [(i, t) for i, t, *_ in got] == sorted(want) and all(n == len(t) or not t for _, t, _, n in got)


def test_ties_across_tasks_change_nothing(spark, prose):
    """A passage that very many documents hold is dealt over several tasks; all but its first holder are found."""
    passage = prose(51, 70)
    rows = [(i, f"{prose(60_000 + i, 30)} {passage}") for i in range(200)]
    found = substring_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {p.doc_id for p in found} == set(range(1, 200)) and all(p.source_doc_id < p.doc_id for p in found)


def test_fingerprints(spark, prose, odd, odd_rows, empty):
    rows = [(i, prose(i, 150)) for i in range(40)]
    found = {r.doc_id: r for r in imatch.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    texts = dict(rows)
    for i, r in found.items():
        nxt = texts[i - 1 if i else 39]
        third = len(texts[i]) // 3
        assert r.edited_sha256 == hashlib.sha256((texts[i][: len(texts[i]) - third] + nxt[:third]).encode()).hexdigest()
    assert sum(r.near_edited > r.near_next for r in found.values()) >= 38
    out = imatch.fingerprints(odd).collect()
    assert len(out) == len(odd_rows) and len({r.fingerprint for r in out if r.doc_id in (4, 8)}) == 1
    assert imatch.fingerprints(empty).count() == 0


def test_fingerprints_as_brute_force(spark, prose):
    """Lexicon, fingerprints, edited texts and likeness, each from its definition."""
    rows = [(i * 7, " ".join(prose(i % 45, 60).split() + [f"word{i % k}" for k in (3, 11, 90)])) for i in range(90)]
    rows += [(5, None), (6, ""), (8, "Éa_1 word0 WORD0 日本語"), (None, prose(3, 60)), (1000, prose(7, 12_000)), (9, "!?")]
    texts = [(i, t or "") for i, t in rows]
    df = Counter(w for _, t in texts for w in set(re.findall(r"\w+", t.lower())))
    low, high = imatch.IDF_BAND
    band = {w for w, n in df.items() if low <= math.log(len(texts) / n) <= high}
    assert 0 < len(band) < len(df)

    def mark(text):
        own = set(re.findall(r"\w+", text.lower()))
        kept = own & band or own
        h = np.array(sorted(xxhash.xxh3_64_intdigest(w) for w in kept), np.uint64)
        out = []
        for i, rate in enumerate(r for r in imatch.RATES for _ in range(imatch.PER_RATE)):
            draws = imatch.mix(h ^ imatch.mix(np.array([i], np.uint64) + np.uint64(0x51ED27)))
            chosen = h[(draws >> np.uint64(11)).astype(float) / 2**53 < rate]
            out.append(f"{xxhash.xxh3_64_intdigest(chosen.tobytes()) % 16**imatch.DIGITS:06x}" if len(chosen) else "." * imatch.DIGITS)
        return out

    def alike(a, b):
        held = [x == y for x, y in zip(a, b) if "." not in x or "." not in y]
        return sum(held) / len(held) if held else 1.0

    order = sorted(texts, key=lambda r: -math.inf if r[0] is None else r[0], reverse=True)
    want = []
    for (i, t), (_, follower) in zip(order, order[1:] + order[:1]):
        third = len(t) // 3
        edited = t[: len(t) - third] + follower[:third]
        a, b = mark(t), mark(edited)
        want.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), "".join(a), "".join(b), alike(a, b), alike(a, mark(follower))))
    got = [tuple(r) for r in imatch.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    by_id = lambda r: (r[0] is None, r[0] or 0)
    assert sorted(got, key=by_id) == sorted(want, key=by_id)


def test_memberships_are_the_draws_below_each_rate_and_shared_by_all_texts():
    h = np.random.default_rng(8).integers(0, 2**64, 5000, dtype=np.uint64)
    bits = imatch.memberships(h)
    for i, rate in enumerate(r for r in imatch.RATES for _ in range(imatch.PER_RATE)):
        draws = imatch.mix(h ^ imatch.mix(np.array([i], np.uint64) + np.uint64(0x51ED27)))
        assert ((bits >> np.uint64(i) & np.uint64(1)).astype(bool) == ((draws >> np.uint64(11)).astype(float) / 2**53 < rate)).all()


def test_windows_hold_every_run_in_repeating_stretches_too(spark, prose):
    """The text of every run of 46 shingles lies in a window of each function; a stretch of one word is a repeat of itself but for its start,
    and a passage from the middle of a stretch with one line again and again is found."""
    line, fill = prose(81, 12), [prose(82 + i, 9) for i in range(40)]
    stretch = " ".join(f"{line} {f}" for f in fill)
    texts = ["same same " * 300, f"{prose(130, 30)} {stretch} {prose(131, 30)}"]
    of, key, lo, c, hi, _ = substring_dedup.windows_of(texts)
    for i, t in enumerate(texts):
        runs = substring_dedup.runs_of(shingle_hashes(words_of(t)))
        for f in range(substring_dedup.FUNCTIONS):
            here = (of == i) & (key % substring_dedup.FUNCTIONS == f)
            held = Counter(s for a, m, b in zip(lo[here], c[here], hi[here]) for s in range(max(a, m - 45), min(m, b - 45) + 1))
            assert set(held.values()) == {1} and {*runs[[*held]].tolist()} == {*runs.tolist()} and (i == 0 or len(held) == len(runs))
    rows = [(1, texts[0]), (2, texts[1])] + [(10 + i, f"{prose(140 + i, 30)} {' '.join(stretch.split()[i * 21 + 200 : i * 21 + 260])} {prose(180 + i, 30)}") for i in range(12)]
    covered = {}
    for p in substring_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        covered.setdefault(p.doc_id, set()).update(range(p.first_word, p.end_word))
    assert len(covered[1]) >= 590 and all(len(covered.get(10 + i, set()) & set(range(30, 90))) >= 57 for i in range(12))


def test_exact_repeats_behind_many_holders_of_their_halves(spark, prose):
    """Whole passages stand in one document among twenty that hold one half of it, and again in a last one: all are found, with the whole one as their source."""
    rows, want, last = [], [], []
    for k in range(24):
        words = prose(90_000 + k, 60).split()
        for i in range(20):
            rows.append((100 * k + i, f"{prose(91_000 + 100 * k + i, 50)} {' '.join(words[:30] if i % 2 else words[30:])} {prose(94_000 + 100 * k + i, 50)}"))
        rows[-10] = (rows[-10][0], f"{prose(97_000 + k, 50)} {' '.join(words)} {prose(97_100 + k, 50)}")
        last.append((10_000 + k, f"{prose(97_200 + k, 50)} {' '.join(words)} {prose(97_300 + k, 50)}"))
        want.append((10_000 + k, rows[-10][0]))
    found = substring_dedup.repeated_passages(spark.createDataFrame(rows + last, "doc_id long, text string")).collect()
    assert sorted({(p.doc_id, p.source_doc_id) for p in found if p.first_word <= 50 and p.end_word >= 110}) == want


def test_hashes_of_runs_tell_runs_apart():
    r = np.random.default_rng(4)
    h = imatch.mix(r.integers(0, 2, 4000).astype(np.uint64))
    h[2000:2100] = h[100:200]
    runs, width = substring_dedup.runs_of(h), substring_dedup.WIDTH
    assert len(runs) == len(h) - width + 1 and len({*runs.tolist()}) == len({h[i : i + width].tobytes() for i in range(len(runs))}) < len(runs)
    assert len(substring_dedup.runs_of(h[: width - 1])) == 0 and len(substring_dedup.runs_of(h[:width])) == 1 and len(substring_dedup.runs_of(h[:3])) == 0


def test_an_exact_copy_counts_beside_a_denser_stretch_of_some_of_its_words():
    h = np.arange(1000, dtype=np.uint64)
    passage = np.r_[h[:40], np.repeat(h[500], 20)]
    pivot = np.r_[h[700:710], passage, h[710:720], np.repeat(h[500], 200)]
    assert substring_dedup.verified(passage, pivot, [(0, 59, 0, len(pivot) - 1)], False) == [(0, 59, 10, 69, 1.0)]


def plain_places(seeds):
    """Places of one pair's seeds (lo, centre, hi, pivot centre, strong), one window's end after the other."""
    seeds = sorted(set(seeds))
    ends = sorted([(s[0], 0, i) for i, s in enumerate(seeds)] + [(s[2] + 1, -1, i) for i, s in enumerate(seeds)])
    out, count, since = [], 0, None
    for at, what, i in ends:
        count += (1 if what == 0 else -1) * (substring_dedup.AGREE if seeds[i][4] else 1)
        if count >= substring_dedup.AGREE and since is None:
            since = at
        elif count < substring_dedup.AGREE and since is not None:
            reach = [(c, int((hi - lo + 1) / substring_dedup.SIMILARITY) + 1) for lo, _, hi, c, _ in seeds if lo <= at - 1 and hi >= since]
            if at - since >= substring_dedup.WIDTH:
                out.append((since, at - 1, max(0, min(c - n for c, n in reach)), max(c + n for c, n in reach)))
            since = None
    return out


def test_places_of_many_pairs_as_a_plain_sweep_wherever_batches_end(spark):
    """Windows of 60 pairs, weak and strong, repeated, touching and nested; a pair's windows lie in several Arrow batches of seven rows."""
    r, rows = random.Random(3), []
    for pair in range(60):
        for _ in range(r.choice([1, 2, 5, 30])):
            lo = r.randrange(400)
            rows.append((pair // 3, 7, pair % 3, 8, lo, lo + r.randrange(46), lo + 45 + r.choice([0, 1, 10, 100]), r.randrange(500), r.random() < 0.3))
    rows += r.sample(rows, 50)
    want = {}
    for d, _, p, _, *seed in rows:
        want.setdefault((d, p), []).append(tuple(seed))
    want = {k: found for k, v in want.items() if (found := plain_places(v))}
    df = spark.createDataFrame(rows, "doc_id long, tie int, pivot long, ptie int, lo int, centre int, hi int, pcentre int, strong boolean")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
        got = substring_dedup.place_table(df.coalesce(1).sortWithinPartitions("doc_id", "tie", "pivot", "ptie")).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert len(got) == len(want) and {(x.doc_id, x.pivot): [tuple(p) for p in x.places] for x in got} == want
    for x in got:
        lo, hi, plo, phi = zip(*x.places, strict=True)
        assert (x.lo, x.hi, x.plo, x.phi) == (min(lo), max(hi), min(plo), max(phi)) and (x.tie, x.ptie) == (7, 8)


def test_first_holders_as_groups_in_memory_wherever_batches_end(spark):
    r = random.Random(4)
    rows = [(r.choice([1, 1, 1, r.randrange(60)]), r.randrange(40), r.randrange(2), r.randrange(3)) for _ in range(400)]
    groups = {}
    for k, *own in rows:
        groups.setdefault(k, []).append(tuple(own))
    want = sorted((k, *own, *min(g)) for k, g in groups.items() if len(g) > 1 for own in g)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
        got = substring_dedup.with_first(spark.createDataFrame(rows, "k long, doc_id long, tie int, at int"), "k", "at").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert sorted(map(tuple, got)) == want


def test_copies_are_joined_by_their_first_holder_and_move_only_the_words_they_share(spark, prose):
    """Windows of copies that agree with their value's first one take no part in the join of fours, but those of the task's first value; the last of
    long texts that share one passage is found by parts of both."""
    order = ["key", "doc_id", "tie", "centre"]
    windows = substring_dedup.window_table(substring_dedup.tied(spark.createDataFrame([(i, prose(1, 400)) for i in range(20)], "doc_id long, text string")))
    found = substring_dedup.matched(windows.coalesce(1).sortWithinPartitions(*order), True)
    assert windows.count() > 20 * 20 and substring_dedup.fours(found.where(f"kind = {substring_dedup.IN_CROWD}")).count() <= 20 * substring_dedup.FOURS
    passage = prose(2, 60)
    rows = [(i, f"{prose(300 + i, 700 + 100 * i)} {passage} {prose(400 + i, 900)}") for i in range(5)] + [(9, f"{prose(500, 300)} {passage} {prose(501, 100)} {passage}")]
    got = {(p.doc_id, p.source_doc_id, p.first_word, p.end_word, p.source_first_word, p.source_end_word) for p in substring_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {(i, 0, 700 + 100 * i, 760 + 100 * i, 700, 760) for i in range(1, 5)} | {(9, 0, 300, 360, 700, 760), (9, 0, 460, 520, 700, 760)} <= got
