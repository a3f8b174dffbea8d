"""Near-duplicate passages by compact windows.

A text's shingle hashes, hashed anew by each of a few functions, give a Cartesian tree per function. A node whose subtree
is at least as wide as the shortest passage sought is a compact window (left, centre, right): every passage in it that
holds the centre has the centre's value as its min-hash. Passages of two texts that are alike share such values under most
functions, so equal values are candidates. All windows of the corpus are put in order of (value, document, place); each is held
against the first of its value and the two before it. Windows carry a few bits of the shingles around
their centres: those of an exact repeat agree on four in a row of eight at least, which is enough for a candidate; others become one where
windows of two functions overlap (the interval join). Candidates are verified on the shingles of both texts.

Values with three holders and more (crowded ones) have all their windows joined besides, by equality, so that no group of holders is paired out:
- windows that agree on four places in a row around the centre, with the first that does, for each such four;
- for windows of one function: each of their runs of the shortest passage's length, by the hash of the whole run, with the first that holds it; runs
  with four places in a row that no other window of the value shares are left out, as they can't be repeats. Such a run lies in just one window of a function, and in a like window
  wherever else it stands; so every exact repeat is found.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch_shingles, dealt_copies, discarded, keyed, mix, n_partitions, passes, prepare, read, released, shingles_of, words_of, written

#: Words of a shingle, and of the shortest passage.
SHINGLE_WORDS, PASSAGE_WORDS = 5, 50
SIMILARITY = 0.8
#: Hash functions, and how many of them have to agree on a place where the shingles around a window's centre don't.
FUNCTIONS, AGREE = 4, 2
#: Places around a centre of which a byte each is kept, and how many have to agree. The shortest passage has four of them
#: on one side of its centre at least, wherever that lies.
AROUND = np.array([-20, -15, -10, -5, 5, 10, 15, 20])
AROUND_AGREE = 4
#: Holders of a value from which on it is crowded: a window may have earlier ones then that it isn't held against in order.
CROWDED = 3
#: Each run of so many places around a centre (a four), and all of them as bits.
FOURS = len(AROUND) - AROUND_AGREE + 1
ALL_FOURS = (1 << FOURS) - 1
#: What a row of matched() is.
CANDIDATE, EDGE, IN_CROWD, SHARED = 0, 1, 2, 3
#: Members of a group that one copy of a pivot's text serves, at least.
PIVOT_SHARE = 256
#: Bytes of packed words in an Arrow batch, about.
PACKED_BYTES = 1 << 22
#: Window rows per Arrow batch: they are short.
WINDOW_ROWS = 16_384
WORD = re.compile(r"[^\x20\x09-\x0D]+")

U64 = np.uint64
WIDTH = PASSAGE_WORDS - SHINGLE_WORDS + 1


def nearest_smaller(v: list[int]) -> tuple[list[int], list[int]]:
    """For each place the nearest smaller value's place to its left and right (-1 and len if none), by one stack: the
    Cartesian tree's subtree bounds."""
    left, right, stack = [-1] * len(v), [len(v)] * len(v), []
    for i, x in enumerate(v):
        while stack and v[stack[-1]] > x:
            right[stack.pop()] = i
        left[i] = stack[-1] if stack else -1
        stack.append(i)
    return left, right


def compact_windows(h: np.ndarray, bounds: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(left, centre, right), inclusive, of all compact windows at least `width` wide of hash sequences that lie end to end.

    Centres are the minima of sliding windows of that width. A centre's nearest smaller values are such minima too (else
    its subtree would be narrower), so the tree is built over the minima alone. Equal values are ordered by place: the
    place stands in the lowest bits.
    """
    n = len(h)
    none = np.empty(0, np.int64)
    if n < width:
        return none, none, none
    bits = U64(n.bit_length())
    v = (h >> bits << bits) | np.arange(n, dtype=U64)
    least, span = v, 1
    while span < width:
        step = min(span, width - span)
        least = np.minimum(least[: len(least) - step], least[step:])
        span += step
    sequence = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    least = least[sequence[: n - width + 1] == sequence[width - 1 :]]
    if not len(least):
        return none, none, none
    minima = least[np.r_[True, least[1:] != least[:-1]]]
    centres = (minima & ((U64(1) << bits) - U64(1))).astype(np.int64)
    # a value below all others between sequences ends every subtree there
    of = sequence[centres]
    breaks = np.flatnonzero(of[1:] != of[:-1]) + 1
    left, right = nearest_smaller(np.insert(minima, breaks, U64(0)).tolist())
    real = np.ones(len(minima) + len(breaks), bool)
    real[breaks + np.arange(len(breaks))] = False
    place = np.full(len(real) + 2, -1, np.int64)  # index len: n; index -1: -1
    place[:-2][real] = centres
    place[-2] = n
    left, right = np.array(left)[real], np.array(right)[real]
    stands = np.r_[real, False, False]
    lo = np.where(stands[left], place[left] + 1, bounds[of])
    hi = np.where(stands[right], place[right] - 1, bounds[of + 1] - 1)
    wide = hi - lo + 1 >= width
    return lo[wide], centres[wide], hi[wide]


def around(h: np.ndarray, centres: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A byte of each shingle around each centre, as int64; places outside the text get bytes that agree with nothing in particular."""
    at = centres[:, None] + AROUND[None, :]
    inside = (at >= begins[:, None]) & (at < ends[:, None])
    own = mix(h[centres][:, None] + (ends - begins).astype(U64)[:, None] + np.arange(len(AROUND), dtype=U64)[None, :])
    return np.where(inside, h[np.clip(at, 0, max(0, len(h) - 1))] >> U64(24), own).astype(np.uint8).reshape(-1, 8).view(np.int64)[:, 0]


def runs_of(shingles: np.ndarray) -> np.ndarray:
    """A hash of each run of WIDTH shingles, from hashes of runs of twice the length before."""
    h, span = shingles, 1
    while 2 * span <= WIDTH:
        h = mix(h[: max(0, len(h) - span)] * U64(0x9E3779B97F4A7C15) + h[span:])
        span *= 2
    return mix(h[: max(0, len(h) - (WIDTH - span))] * U64(0x9E3779B97F4A7C15) + h[WIDTH - span :])


def windows_of(texts: list[str], width: int = WIDTH) -> tuple[np.ndarray, ...]:
    """(text number, key, left, centre, right, around) of all functions' compact windows of each text.

    Every run of `width` shingles lies in one window of each function, that of its least value. A stretch that repeats a few words exactly has
    a window for each turn; from its third turn on a window is left out if all its runs are those of the window before, shifted: the
    first two hold every run's text, and the second one's window reaches to the end of the stretch.
    """
    shingles, bounds = batch_shingles(texts, SHINGLE_WORDS)
    runs, out = runs_of(shingles), []
    for f in range(FUNCTIONS):
        h = mix(shingles * U64(0x9E3779B97F4A7C15) + U64(f + 1))
        lo, c, hi = compact_windows(h, bounds, width)
        of = np.searchsorted(bounds, c, "right") - 1
        key = mix(h[c] ^ U64(f << 60)) & ~U64(FUNCTIONS - 1) | U64(f)  # the function stands in the lowest bits
        order = np.argsort(key, kind="stable")  # of one key, texts and places stay in order
        k, p, o = key[order], c[order], of[order]
        close = np.flatnonzero((k[1:] == k[:-1]) & (o[1:] == o[:-1]) & (p[1:] - p[:-1] < width)) + 1
        shift, opens = p[close] - p[close - 1], np.maximum(lo[order[close]], p[close] - width + 1)
        ends = np.minimum(p[close], hi[order[close]] - width + 1)
        at = np.minimum(opens[:, None] + np.arange(width), ends[:, None])
        turn = np.zeros(len(c), bool)
        turn[close] = (opens - shift >= bounds[o[close]]) & (runs[at] == runs[np.maximum(at - shift[:, None], 0)]).all(axis=1)
        if len(close):
            stays = np.ones(len(c), bool)
            stays[order[turn & np.r_[False, turn[:-1]]]] = False
            of, key, lo, c, hi = of[stays], key[stays], lo[stays], c[stays], hi[stays]
        begin, end = bounds[of], bounds[of + 1]
        out.append((of, key, lo - begin, c - begin, hi - begin, around(shingles, c, begin, end)))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


WINDOW = "key long, doc_id long, tie int, centre int, lo int, hi int, around long"


def window_table(texts: DataFrame) -> DataFrame:
    """(key, doc_id, tie, centre, lo, hi, around) of every text."""

    def run(batches):
        for batch in batches:
            texts, doc, tie = batch.column("text").to_pylist(), batch.column("doc_id").to_numpy(), batch.column("tie").to_numpy()
            for some in passes(texts):
                of, key, lo, c, hi, near = windows_of(texts[some])
                rows = [key.view(np.int64), doc[some][of], tie[some][of], c.astype(np.int32), lo.astype(np.int32), hi.astype(np.int32), near]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in rows], names=["key", "doc_id", "tie", "centre", "lo", "hi", "around"])

    return texts.mapInArrow(run, WINDOW)


def matched(windows: DataFrame, edges: bool) -> DataFrame:
    """Candidates (doc_id, tie, lo, centre, hi, around, pivot, ptie, pcentre, strong, key, kind, fours) from windows in order.

    Each window's first choice is the first of its key, then the one before it, then the one before that. If the shingles around
    the centres agree with a choice, that is its one (strong) candidate; else the first two are weak candidates. With `edges` there are rows
    without pivot too: the first and last window of each task (EDGE), as keys may go on in the next task, and all windows of crowded keys
    (IN_CROWD); those of a task's first and last key count as crowded. `fours` has a bit for each four of theirs that agrees with the key's first
    window, which is their candidate then; a first window has none, but rows of its own with the fours that others of the function 0 agree on (SHARED).
    A task can't tell which is the first window of the key that it begins with: there all bits are 0.
    """
    columns = ["key", "doc_id", "tie", "centre", "lo", "hi", "around"]
    out_columns = ["doc_id", "tie", "lo", "centre", "hi", "around", "pivot", "ptie", "pcentre", "strong", "key", "kind", "fours"]

    def out_batch(w, at, of, strong, kind=CANDIDATE, fours=0):
        one = lambda c, t, i: pa.nulls(len(at), t) if i is None else pa.array(w[c][i], t)
        own = [one(c, t, at) for c, t in (("doc_id", pa.int64()), ("tie", pa.int32()), ("lo", pa.int32()), ("centre", pa.int32()), ("hi", pa.int32()), ("around", pa.int64()))]
        theirs = [one(c, t, of) for c, t in (("doc_id", pa.int64()), ("tie", pa.int32()), ("centre", pa.int32()))]
        return pa.RecordBatch.from_arrays([*own, *theirs, pa.array(np.broadcast_to(strong, len(at)), pa.bool_()), one("key", pa.int64(), at), pa.array(np.full(len(at), kind), pa.int32()), pa.array(np.broadcast_to(fours, len(at)), pa.int32())], names=out_columns)

    def run(batches):
        held, first_key, told = None, None, False
        for batch in batches:
            if not batch.num_rows:
                continue
            w = {c: batch.column(c).to_numpy() for c in columns}
            if edges and first_key is None:
                yield out_batch(w, np.array([0]), None, False, EDGE)
                first_key = w["key"][0]
            known = 0
            if held is not None:
                known = len(held["key"])
                w = {c: np.concatenate([held[c], w[c]]) for c in columns}
            # repeated rows of one document count once
            again = np.r_[False, np.all([w[c][1:] == w[c][:-1] for c in ("key", "doc_id", "tie", "centre")], axis=0)]
            known -= int(again[:known].sum())
            w = {c: v[~again] for c, v in w.items()}
            n = len(w["key"])
            new = np.r_[True, w["key"][1:] != w["key"][:-1]]
            first = np.maximum.accumulate(np.where(new, np.arange(n), 0))
            at = np.arange(known, n)
            bits = w["around"].view(np.uint8).reshape(-1, 8)
            choices = [first[at], np.maximum(at - 1, first[at]), np.maximum(at - 2, first[at])]
            agree = [((bits[at] == bits[c]).sum(axis=1) >= AROUND_AGREE) & (c < at) for c in choices]
            strong = np.any(agree, axis=0)
            best = np.select(agree, choices, default=0)
            yield out_batch(w, at[strong], best[strong], True)
            # the second turn of a repeating stretch stands for those after it: held against the first one, whatever else it is like
            own = agree[1] & (w["doc_id"][at] == w["doc_id"][choices[1]]) & (w["tie"][at] == w["tie"][choices[1]]) & (best < at - 1)
            yield out_batch(w, at[own], choices[1][own], True)
            for c, unlike in ((choices[0], choices[0] < at), (choices[1], (choices[1] < at) & (choices[1] > choices[0]))):
                weak = ~strong & unlike
                yield out_batch(w, at[weak], c[weak], False)
            if edges:
                # held windows have been told if their key was crowded by then; of one that isn't crowded all are held
                sizes = np.diff(np.r_[np.flatnonzero(new), n])
                crowd = (np.repeat(sizes, sizes) >= CROWDED) | (w["key"] == first_key)
                if known:
                    before = w["key"] == w["key"][0]
                    crowd = np.where(before, (crowd | told) & ((np.arange(n) >= known) | (not told)), crowd)
                    told = told and bool(before[-1])
                told = told or bool(crowd[-1])
                crowd = np.flatnonzero(crowd)
                like = bits[crowd] == bits[first[crowd]]
                fours = sum(like[:, k : k + AROUND_AGREE].all(axis=1).astype(np.int32) << k for k in range(FOURS))
                fours = np.where((first[crowd] == crowd) | (w["key"][crowd] == first_key), 0, fours)
                yield out_batch(w, crowd, None, False, IN_CROWD, fours)
                shared = np.zeros(n, np.int32)
                np.bitwise_or.at(shared, first[crowd], fours)
                firsts = np.flatnonzero((shared != 0) & (w["key"] & (FUNCTIONS - 1) == 0))
                yield out_batch(w, firsts, None, False, SHARED, shared[firsts])
            keep = np.unique([first[-1], max(n - 2, first[-1]), n - 1])
            held = {c: v[keep] for c, v in w.items()}
        if edges and held is not None:
            yield out_batch(held, np.array([len(held["key"]) - 1]), None, False, EDGE)
            if not told:
                yield out_batch(held, np.arange(len(held["key"])), None, False, IN_CROWD)

    return windows.mapInArrow(run, "doc_id long, tie int, lo int, centre int, hi int, around long, pivot long, ptie int, pcentre int, strong boolean, key long, kind int, fours int")


def with_first(rows: DataFrame, key: str, place: str) -> DataFrame:
    """Rows whose key others have too, with the first (doc_id, tie, place) of that key as (of_doc, of_tie, of_at). All columns are whole numbers. A large
    key's sorted rows stream past: only its first row and the one before are held."""
    order, columns = [key, "doc_id", "tie", place], rows.columns
    own = ["doc_id", "tie", place]

    def run(batches):
        held, of = None, None  # the row before, and the first one of its key
        for batch in batches:
            if not batch.num_rows:
                continue
            w = {c: batch.column(c).to_numpy() for c in columns}
            if held is not None:
                w = {c: np.r_[held[c], w[c]] for c in columns}
            n, k = len(w[key]), w[key]
            new = np.r_[True, k[1:] != k[:-1]]
            first = np.maximum.accumulate(np.where(new, np.arange(n), 0))
            holder = [w[c][first] for c in own]
            if of is not None:
                for x, c in zip(holder, own, strict=True):
                    x[first == 0] = of[c]
            other = np.any([x != w[c] for x, c in zip(holder, own, strict=True)], axis=0)
            some = np.flatnonzero(np.r_[~new[1:], False] | other)
            some = some[some < n - 1]
            yield pa.RecordBatch.from_arrays([*(pa.array(w[c][some]) for c in columns), *(pa.array(x[some]) for x in holder)], names=[*columns, "of_doc", "of_tie", "of_at"])
            held, of = {c: w[c][-1:] for c in columns}, {c: x[-1] for x, c in zip(holder, own, strict=True)}
        if held is not None and any(held[c][0] != of[c] for c in own):
            yield pa.RecordBatch.from_arrays([*(pa.array(held[c]) for c in columns), *(pa.array([of[c]], pa.from_numpy_dtype(held[c].dtype)) for c in own)], names=[*columns, "of_doc", "of_tie", "of_at"])

    kinds = dict(rows.dtypes)
    sorted_rows = rows.repartition(n_partitions(rows.sparkSession), key).sortWithinPartitions(*order)
    return sorted_rows.mapInArrow(run, ", ".join([*(f"{c} {kinds[c]}" for c in columns), "of_doc long", "of_tie int", "of_at int"]))


def fours(crowd: DataFrame) -> DataFrame:
    """Windows in crowds by each four places in a row around their centres, with the first window of the key that agrees on them: (slot, four,
    function, doc_id, tie, lo, centre, hi, of_doc, of_tie, of_at). A slot is a hash of key, four and the places' bytes, so that rows are sorted by one number.
    Fours that agree with the key's first window are left out: that is their candidate already."""
    some = [F.struct(F.xxhash64("key", F.lit(k), F.shiftrightunsigned("around", 8 * k).bitwiseAND(0xFFFFFFFF)).alias("slot"), F.lit(k).alias("four")) for k in range(FOURS)]
    function = F.col("key").bitwiseAND(FUNCTIONS - 1).cast("int").alias("function")
    rows = crowd.where(F.col("fours") != ALL_FOURS).select(function, "doc_id", "tie", "lo", "centre", "hi", "fours", F.explode(F.array(*some)).alias("s"))
    rows = rows.where("(fours >> s.four) & 1 = 0").select("s.slot", "s.four", "function", "doc_id", "tie", "lo", "centre", "hi")
    return with_first(rows, "slot", "centre")


def run_table(texts: DataFrame, shared: DataFrame) -> DataFrame:
    """(run, doc_id, tie, at): the runs of WIDTH shingles around the centres of these windows (doc_id, tie, lo, centre, hi, fours) of which
    each four within is shared with another window (its bit is in a row's `fours`); others can't be repeats."""
    places = shared.groupBy("doc_id", "tie").agg(F.collect_list(F.struct("centre", "lo", "hi", "fours")).alias("places"))
    before, four = np.arange(WIDTH), np.arange(FOURS)
    # for each number of shingles that a run holds before the centre: the fours within it, a bit each
    within = (AROUND[four][None, :] >= -before[:, None]) & (AROUND[four + AROUND_AGREE - 1][None, :] <= WIDTH - 1 - before[:, None])
    wanted = (within << four).sum(axis=1)

    def run(batches):
        for batch in batches:
            docs, ties = batch.column("doc_id").to_numpy(), batch.column("tie").to_numpy()
            held, fields = batch.column("places"), [x.to_numpy() for x in batch.column("places").flatten().flatten()]
            begins = np.r_[0, np.cumsum(held.value_lengths().to_numpy())]
            rows, n = [], 0
            for i, shingles in enumerate(shingles_of(batch.column("text").to_pylist())):
                h = runs_of(shingles)
                c, lo, hi, k = (x[begins[i] : begins[i + 1]] for x in fields)
                order = np.argsort(c, kind="stable")
                c, lo, hi, k = c[order].astype(np.int64), lo[order], hi[order], k[order].astype(np.int64)
                starts = np.flatnonzero(np.r_[True, c[1:] != c[:-1]])
                has = np.bitwise_or.reduceat(k, starts)
                c, lo, hi = c[starts], lo[starts], hi[starts]
                at = c[:, None] - before[None, :]
                at = np.sort(at[(at >= lo[:, None]) & (at <= hi[:, None] - WIDTH + 1) & ((has[:, None] & wanted) == wanted)])
                rows.append((h[at].view(np.int64), np.full(len(at), docs[i]), np.full(len(at), ties[i]), at.astype(np.int32)))
                n += len(at)
                if n >= WINDOW_ROWS or i == len(docs) - 1:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*rows, strict=True)], names=["run", "doc_id", "tie", "at"])
                    rows, n = [], 0

    return texts.join(places.hint("merge"), ["doc_id", "tie"]).select("doc_id", "tie", "text", "places").mapInArrow(run, "run long, doc_id long, tie int, at int")


def repeats(runs: DataFrame) -> DataFrame:
    """Seeds (doc_id, tie, pivot, ptie, lo, centre, hi, pcentre, strong): stretches of runs that stand at the same distance in their first holder."""
    later = with_first(runs, "run", "at").where("doc_id != of_doc or tie != of_tie or at != of_at")
    later = later.select("doc_id", "tie", F.col("of_doc").alias("pivot"), F.col("of_tie").alias("ptie"), "at", (F.col("of_at") - F.col("at")).alias("off"))
    ends = later.groupBy("doc_id", "tie", "pivot", "ptie", "off").agg(F.min("at").alias("lo"), F.max("at").alias("hi"))
    return ends.select("doc_id", "tie", "pivot", "ptie", "lo", F.col("lo").alias("centre"), (F.col("hi") + WIDTH - 1).alias("hi"), (F.col("lo") + F.col("off")).alias("pcentre"), F.lit(True).alias("strong"))


def places_of(pair: np.ndarray, lo: np.ndarray, centre: np.ndarray, hi: np.ndarray, pcentre: np.ndarray, strong: np.ndarray, agree: int = AGREE, similar: float = SIMILARITY, width: int = WIDTH) -> tuple[np.ndarray, ...]:
    """Interval join of matched windows, those of many pairs at once (`pair` ascends): (pair, from, to, pivot from, pivot to) of each place where
    a strong window lies, or enough windows overlap, in order; places too short for a passage are left out.

    A sweep over the windows' ends counts those open at each place, a strong one as many; a stretch where at least `agree` are open becomes
    one place. A passage in a window is at most 1 / similar times as long in the pivot and holds its centre there, which bounds the pivot's part.
    """
    order = np.lexsort((strong, pcentre, hi, centre, lo, pair))
    rows = [x[order].astype(np.int64) for x in (pair, lo, centre, hi, pcentre, strong)]
    once = np.r_[True, np.any([x[1:] != x[:-1] for x in rows], axis=0)]
    pair, lo, centre, hi, pcentre, strong = (x[once] for x in rows)
    weight = np.where(strong == 1, agree, 1)
    at, of = np.r_[hi + 1, lo], np.r_[pair, pair]
    sweep = np.lexsort((np.arange(len(at)) >= len(hi), at, of))  # of one place, windows that end come first
    on = np.r_[False, np.cumsum(np.r_[-weight, weight][sweep]) >= agree]
    at, of = at[sweep], of[sweep]
    starts, ends = np.flatnonzero(on[1:] & ~on[:-1]), np.flatnonzero(~on[1:] & on[:-1])
    wide = at[ends] - at[starts] >= width
    since, to, of = at[starts][wide], at[ends][wide] - 1, of[starts][wide]
    # the windows that overlap a place bound its part of the pivot; places of a pair are disjoint and in order
    far = int(hi.max(initial=0)) + 2
    first, last = np.searchsorted(of * far + to, pair * far + lo), np.searchsorted(of * far + since, pair * far + hi, "right")
    held = np.maximum(last - first, 0)
    seed = np.repeat(np.arange(len(lo)), held)
    place = np.arange(len(seed)) - np.repeat(np.cumsum(held) - held, held) + np.repeat(first, held)
    reach = ((hi - lo + 1) / similar).astype(np.int64) + 1
    plo, phi = np.full(len(of), np.iinfo(np.int64).max), np.zeros(len(of), np.int64)
    np.minimum.at(plo, place, (pcentre - reach)[seed])
    np.maximum.at(phi, place, (pcentre + reach)[seed])
    return of, since, to, np.maximum(plo, 0), phi


PAIR = "doc_id long, tie int, pivot long, ptie int"
PLACE = "struct<lo: int, hi: int, plo: int, phi: int>"


def place_table(seeds: DataFrame) -> DataFrame:
    """(doc_id, tie, pivot, ptie, places, lo, hi, plo, phi) of each pair with a place, from its seeds: one row each, in order of pairs within
    partitions. The last four are the bounds of all places. A task holds the seeds of one pair, and a batch."""
    ids, columns, ends = ["doc_id", "tie", "pivot", "ptie"], ["lo", "centre", "hi", "pcentre", "strong"], ["lo", "hi", "plo", "phi"]

    def out_batch(w):
        new = np.r_[True, np.any([w[c][1:] != w[c][:-1] for c in ids], axis=0)]
        of, *found = places_of(np.cumsum(new) - 1, *(w[c] for c in columns))
        opens = np.flatnonzero(np.r_[True, of[1:] != of[:-1]]) if len(of) else np.empty(0, np.int64)
        rows = np.flatnonzero(new)[of[opens]]
        ints = [x.astype(np.int32) for x in found]
        places = pa.ListArray.from_arrays(pa.array(np.r_[opens, len(of)].astype(np.int32)), pa.StructArray.from_arrays([pa.array(x) for x in ints], names=ends))
        bounds = [f.reduceat(x, opens) if len(opens) else x for f, x in zip((np.minimum, np.maximum, np.minimum, np.maximum), ints, strict=True)]
        return pa.RecordBatch.from_arrays([*(pa.array(w[c][rows]) for c in ids), places, *map(pa.array, bounds)], names=[*ids, "places", *ends])

    def run(batches):
        open_pair: list[dict] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            w = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in ids + columns}
            goes_on = bool(open_pair) and all(open_pair[-1][c][-1] == w[c][0] for c in ids)
            starts = np.flatnonzero(np.r_[not goes_on, np.any([w[c][1:] != w[c][:-1] for c in ids], axis=0)])
            if len(starts):
                whole = [*open_pair, {c: v[: starts[-1]] for c, v in w.items()}]
                if sum(len(x["lo"]) for x in whole):
                    yield out_batch({c: np.concatenate([x[c] for x in whole]) for c in w})
                open_pair, w = [], {c: v[starts[-1] :] for c, v in w.items()}
            open_pair.append(w)
        if open_pair:
            yield out_batch({c: np.concatenate([x[c] for x in open_pair]) for c in open_pair[0]})

    return seeds.select(*ids, *columns).mapInArrow(run, f"{PAIR}, places array<{PLACE}>, lo int, hi int, plo int, phi int")


def verified(a: np.ndarray, b: np.ndarray, places: list[tuple[int, int, int, int]], itself: bool, width: int = WIDTH, similar: float = SIMILARITY, at: int = 0, pivot_at: int = 0) -> list[tuple[int, int, int, int, float]]:
    """(from, to, pivot from, pivot to, similarity), in shingles, of passages of `a` at these places that the pivot `b` has too. All
    places are those of whole texts, of which `a` and `b` may be parts that begin at `at` and `pivot_at`.

    Shingles of the place that the pivot's place also holds score 1 - similar, others -similar; maximal stretches of no
    negative start or end, at least `width` long, are passages; their Jaccard similarity with what they match is checked.
    In a text held against itself the later copy is the passage.
    """
    out = []
    for lo, hi, plo, phi in places:
        part, whole = a[lo - at : hi + 1 - at], b[plo - pivot_at : phi + 1 - pivot_at]
        # small numbers for the hashes, those of both parts: sets of shingles are marks then
        values, code = np.unique(np.r_[part, whole], return_inverse=True)
        ours, theirs = code[: len(part)], code[len(part) :]
        if itself:
            first = np.full(len(values), 1 << 60)
            first[theirs[::-1]] = np.arange(len(whole))[::-1] + plo  # the first place is put last
            hit = first[ours] < np.arange(lo, lo + len(part))
        else:
            held = np.zeros(len(values), bool)
            held[theirs] = True
            hit = held[ours]
        ends = np.flatnonzero(np.diff(np.r_[False, hit, False].astype(np.int8)))
        runs = ends.reshape(-1, 2).tolist()
        merged: list[list[int]] = []
        for start, end in runs:
            if merged and (start - merged[-1][1]) <= (1 - similar) * (end - merged[-1][0]):
                merged[-1] = [merged[-1][0], end]
            else:
                merged.append([start, end])
        todo = merged
        while todo:
            start, end = todo.pop()
            if end - start < width:
                continue
            passage = part[start:end]
            mine, other = np.zeros(len(values), bool), np.zeros(len(values), bool)
            mine[ours[start:end]] = True
            at_both = np.flatnonzero(mine[theirs])
            # of the pivot's place: the densest stretch as long as the passage, with room for what was put in
            room = int((end - start) / similar)
            best = int(np.argmax(np.searchsorted(at_both, at_both + room) - np.arange(len(at_both))))
            last = int(np.searchsorted(at_both, at_both[best] + room)) - 1
            other[theirs[at_both[best] : at_both[last] + 1]] = True
            both = np.count_nonzero(mine & other)
            likeness = both / (np.count_nonzero(mine) + np.count_nonzero(other) - both)
            if likeness >= similar:
                out.append((lo + start, lo + end - 1, plo + int(at_both[best]), plo + int(at_both[last]), likeness))
                continue
            # the densest stretch may be one that repeats a few of the words: an exact copy counts wherever it stands
            copies = [p for p in np.flatnonzero(whole[: max(0, len(whole) - len(passage) + 1)] == passage[0]).tolist() if (not itself or plo + p < lo + start) and np.array_equal(whole[p : p + len(passage)], passage)]
            if copies:
                out.append((lo + start, lo + end - 1, plo + copies[0], plo + copies[0] + len(passage) - 1, 1.0))
            else:  # several stretches with too much between: each by itself
                todo += [r for r in runs if start <= r[0] and r[1] <= end and r[1] - r[0] >= width and r != [start, end]]
    return out


def tied(docs: DataFrame) -> DataFrame:
    """(doc_id, text, tie): tie tells different texts under one id apart, and puts them in order."""
    return keyed(docs).where("doc_id is not null").withColumn("tie", F.xxhash64("text").bitwiseAND(0x7FFFFFFF).cast("int"))


def candidates(texts: DataFrame) -> DataFrame:
    """As place_table(): places of a text that resemble places of a text before it."""
    spark = texts.sparkSession
    n = n_partitions(spark)
    table = written(window_table(texts), "windows")
    prepare(spark, WINDOW_ROWS)
    order = ["key", "doc_id", "tie", "centre"]
    found = written(matched(table.repartitionByRange(n, *order).sortWithinPartitions(*order), True), "matched")
    discarded(table)
    released(spark)
    # two rows for each task: where a key goes on from one task to the next
    edges = found.where(F.col("kind") == EDGE).select(*[c.split()[0] for c in WINDOW.split(", ")]).coalesce(1).sortWithinPartitions(*order)
    both = found.where(F.col("kind") == CANDIDATE).unionAll(matched(edges, False))
    columns = ["doc_id", "tie", "pivot", "ptie", "lo", "centre", "hi", "pcentre", "strong"]
    alike = written(fours(found.where(F.col("kind") == IN_CROWD)), "fours")
    released(spark)
    prepare(spark)
    shared = ["doc_id", "tie", "lo", "centre", "hi"]
    with_others = alike.where("function = 0").select(*shared, F.expr("1 << four").alias("fours"))
    with_first_one = found.where(F.col("kind").isin(IN_CROWD, SHARED) & (F.col("fours") != 0) & (F.col("key").bitwiseAND(FUNCTIONS - 1) == 0)).select(*shared, "fours")
    copied = written(repeats(run_table(texts, with_others.unionAll(with_first_one))), "repeats")
    released(spark)
    prepare(spark, WINDOW_ROWS)
    others = alike.where("doc_id != of_doc or tie != of_tie or centre != of_at")
    others = others.select("doc_id", "tie", F.col("of_doc").alias("pivot"), F.col("of_tie").alias("ptie"), "lo", "centre", "hi", F.col("of_at").alias("pcentre"), F.lit(True).alias("strong"))
    seeds = both.select(*columns).unionAll(others).unionAll(copied.select(*columns))
    pairs = written(place_table(seeds.repartition(n, *columns[:4]).sortWithinPartitions(*columns[:4])), "seeds")
    prepare(spark)
    discarded(found, alike, copied)
    return pairs


def passages(docs: DataFrame) -> DataFrame:
    """As repeated_passages(), with the tie of the text that each passage stands in."""
    spark = docs.sparkSession
    prepare(spark)
    n = n_partitions(spark)
    texts = tied(docs)
    pairs = candidates(texts)
    released(spark)
    of_pivot = F.struct(F.col("pivot").alias("doc_id"), F.col("ptie").alias("tie")).alias("pivot")
    dealt_pairs = pairs.select(F.struct("doc_id", "tie").alias("doc_id"), of_pivot, "places", "lo", "hi", "plo", "phi")
    roles = dealt_copies(dealt_pairs, PIVOT_SHARE, "places", "lo", "hi", pivots={"lo": (F.min, "plo"), "hi": (F.max, "phi")})
    roles = roles.select(F.col("doc_id.doc_id").alias("doc_id"), F.col("doc_id.tie").alias("tie"), "roles")
    id_type = "struct<doc_id: long, tie: int>"

    def squeeze(batches):
        """A row for each role: of the text only the words that it needs, those of shingles lo to hi."""
        pack = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            texts, roles = batch.column("text").to_pylist(), batch.column("roles")
            pivot, copy, is_member, places, los, his = roles.flatten().flatten()
            n = roles.value_lengths().to_numpy()
            begins, of, los, his = np.r_[0, np.cumsum(n)], np.repeat(np.arange(len(n)), n), los.to_numpy(), his.to_numpy()
            packed, begin, held = [], 0, 0
            for i, text in enumerate(texts):
                words = words_of(text)
                packed += [pack(b" ".join(words[a : b + SHINGLE_WORDS])) for a, b in zip(los[begins[i] : begins[i + 1]].tolist(), his[begins[i] : begins[i + 1]].tolist(), strict=True)]
                held += sum(map(len, packed[begins[i] - begin :]))
                if held > PACKED_BYTES or i == len(texts) - 1:
                    some, rows = slice(begin, int(begins[i + 1])), pa.array(of[begin : begins[i + 1]])
                    cut = [x[some] for x in (pivot, copy, is_member, places)]
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(rows), batch.column("tie").take(rows), pa.array(packed, pa.binary()), *cut, pa.array(los[some])], names=["doc_id", "tie", "packed", "pivot", "copy", "is_member", "places", "at"])
                    packed, begin, held = [], some.stop, 0

    dealt = (
        texts.join(roles.hint("merge"), ["doc_id", "tie"])
        .select("doc_id", "tie", "text", "roles")
        .mapInArrow(squeeze, f"doc_id long, tie int, packed binary, pivot {id_type}, copy long, is_member boolean, places array<{PLACE}>, at int")
        .repartition(n, "pivot", "copy")
        .sortWithinPartitions("pivot", "copy", "is_member", "doc_id", "tie")
    )
    names = ["doc_id", "tie", "first_word", "end_word", "source_doc_id", "source_first_word", "source_end_word", "similarity"]

    def verify(batches):
        grow = zstandard.ZstdDecompressor()
        held, held_at, of, last = np.empty(0, U64), 0, None, None
        for batch in batches:
            rows = []
            shingled = shingles_of([grow.decompress(p).decode("utf-8", "surrogatepass") for p in batch.column("packed").to_pylist()])
            for s, doc, tie, pivot, copy, is_member, places, at in zip(shingled, *(batch.column(c).to_pylist() for c in ("doc_id", "tie", "pivot", "copy", "is_member", "places", "at")), strict=True):
                key = (pivot["doc_id"], pivot["tie"], copy)
                if not is_member:
                    held, held_at, of, last = s, at, key, None
                    continue
                if key != of or last == (doc, tie):
                    continue
                last = (doc, tie)
                found = verified(s, held, [(p["lo"], p["hi"], p["plo"], p["phi"]) for p in places], (doc, tie) == key[:2], at=at, pivot_at=held_at)
                rows += [(doc, tie, i, j + SHINGLE_WORDS, pivot["doc_id"], p, q + SHINGLE_WORDS, like) for i, j, p, q, like in found]
            types = [pa.int64(), pa.int32(), *[pa.int64()] * 5, pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True) if rows else [[]] * 8, types, strict=True)], names=names)

    return dealt.mapInArrow(verify, "doc_id long, tie int, first_word long, end_word long, source_doc_id long, source_first_word long, source_end_word long, similarity double")


def repeated_passages(docs: DataFrame) -> DataFrame:
    """(doc_id, first_word, end_word, source_doc_id, source_first_word, source_end_word, similarity): passages of at least
    50 words that a document with a smaller id (or an earlier place of the same document) holds too, word places from 0, ends
    exclusive. The first holder of a passage has no row for it.

    Null, empty and shorter texts have none. Rows with a null doc_id take no part. Repeated rows of one doc_id count as one
    document; different texts under one doc_id are documents of their own, in order of a hash of the text. An empty table gives no rows;
    other columns are not read.
    """
    return passages(docs).drop("tie").distinct()


def without_ranges(text: str, ranges: list[tuple[int, int]]) -> str:
    """The text without these word ranges, in any order and overlapping or not (and the white space before each removed word)."""
    if not ranges:
        return text
    ends = [m.span() for m in WORD.finditer(text)]
    out, at, done = [], 0, 0
    for a, b in sorted(ranges):
        a = max(a, done)
        if a < min(b, len(ends)):
            out.append(text[at : ends[a - 1][1] if a else 0])
            done = min(b, len(ends))
            at = ends[done - 1][1]
    return "".join([*out, text[at:]])


def without_repeats(docs: DataFrame) -> DataFrame:
    """The rows of documents, all columns, their texts without repeated passages (the first holder keeps its own) and
    n_chars anew where there is one. Null texts stay null; a text that is all repeats becomes empty. Of different texts under
    one doc_id each loses its own repeats only; repeated rows all lose the same."""
    ranges = passages(docs).groupBy(F.col("doc_id").alias("of_doc"), F.col("tie").alias("of_tie")).agg(F.collect_set(F.struct("first_word", "end_word")).alias("ranges"))
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    tie = F.xxhash64("text").bitwiseAND(0x7FFFFFFF).cast("int")
    rows = rows.join(ranges.hint("merge"), (F.col("id") == F.col("of_doc")) & (tie == F.col("of_tie")), "left")

    def cut(batches):
        for batch in batches:
            texts = [None if t is None else without_ranges(t, [(r["first_word"], r["end_word"]) for r in rs or []]) for t, rs in zip(batch.column("text").to_pylist(), batch.column("ranges").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(texts, pa.string())], names=["row", "new_text"])

    row_type = docs.schema.simpleString()
    new = rows.select("row", "text", "ranges").mapInArrow(cut, f"row {row_type}, new_text string")
    fresh = {"text": F.col("new_text"), "n_chars": F.length("new_text").cast("long")}
    return new.select(*(fresh[c].alias(c) if c in fresh else F.col(f"row.`{c}`").alias(c) for c in docs.columns))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All repeated passages of all documents."""
    return repeated_passages(read(spark, sf_dir, "documents"))
