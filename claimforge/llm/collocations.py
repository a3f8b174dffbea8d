"""Phrase collocation mining over count streams in prefix and suffix order.

Phrases of 1 to 4 words are counted in rounds of one more word. A phrase can be frequent only if the phrases without its first and without its
last word are, so each round counts only what the last one leaves: its frequent phrases are marked in a bit set of fixed size, whose false marks cost
work and change no count. A block of texts is counted in one task by sorting word numbers, and Spark sums the blocks.

The frequent phrases are then laid out twice: as a stream sorted by words from the first on, and one sorted by words from the last on. In prefix order a
phrase comes after all its beginnings and before all its extensions, so one walk with a stack reads off the counts of its beginnings and of its
extensions by one word to the right; in suffix order the same walk gives the counts of its ends and of its extensions to the left. The streams are cut
into ranges at any place: the phrases that are open at the start of a range, at most one of each length, are carried over to it, as
sums are in a prefix sum. So a first word that a third of all phrases share is spread over many tasks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SALTS, mix, n_partitions, prepare, read, word_hashes, written

MOST_WORDS, LEAST_COUNT, PER_LANG = 4, 30, 2000
#: A phrase goes if a longer one that holds it has so many hundredths of its count.
COVERED = 80
#: Characters of a block that is counted at once, and rows of a batch it is handed on in.
BLOCK_CHARS, OUT_ROWS = 1 << 24, 1 << 17
#: Bits that mark the frequent phrases of a round (16 MB, whatever the corpus): with many more phrases than that it keeps out less.
MARKS = 1 << 27
#: A-Z to a-z, a tab to a blank, and what ends a piece to a line end.
BYTES = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t.,;:!?\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz " + b"\n" * 9)
KEYS = [f"k{i}" for i in range(MOST_WORDS)]


def tokenised(texts: list[str]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct words, number of each word in them, number of its piece) of texts end to end."""
    b = np.frombuffer("\n".join(texts).encode("utf-8", "surrogatepass").translate(BYTES), np.uint8)
    inside = (b != 10) & (b != 32)
    edges = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).view(np.int8)))
    starts, lengths = edges[::2], edges[1::2] - edges[::2]
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(b[inside])]).dictionary_encode()
    return words.dictionary, words.indices.to_numpy().astype(np.int64), np.searchsorted(np.flatnonzero(b == 10), starts)


def distinct_rows(columns: list[np.ndarray], size: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The distinct rows of columns of numbers below size, and how often each occurs."""
    key, top, kept = columns[0], size, []
    for c in columns[1:]:
        if top * size >= 2**62:
            u, key = np.unique(key, return_inverse=True)
            top = len(u)
            kept.append(u)
        else:
            kept.append(None)
        key, top = key * size + c, top * size
    u, n = np.unique(key, return_counts=True)
    out = []
    for before in reversed(kept):
        u, last = np.divmod(u, size)
        out.append(last)
        if before is not None:
            u = before[u]
    return [u, *reversed(out)], n


def folded(lang: str, hashes: list[np.ndarray]) -> np.ndarray:
    """A hash of each row of word hashes (one column for each place), in order."""
    h = np.full(len(hashes[0]), word_hashes([lang.encode()])[0])
    for w in hashes:
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + w)
    return h


def marked(marks: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = h % np.uint64(64 * len(marks))
    return (marks[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) > 0


def block_counts(lang: str, texts: list[str], words: int, marks: np.ndarray | None) -> list[pa.RecordBatch]:
    """(lang, phrase, n) of the phrases of so many words whose two parts of one word less are marked; with one word also a row without a
    phrase, that has the number of all words."""
    known, code, piece = tokenised(texts)
    n_windows = len(code) - words + 1
    if n_windows <= 0:
        return []
    keep = piece[: n_windows] == piece[words - 1 :]
    if marks is not None:
        of_word = word_hashes(known.to_pylist())
        n_parts = n_windows + 1
        part = marked(marks, folded(lang, [of_word[code[i : i + n_parts]] for i in range(words - 1)]))
        keep &= part[:-1] & part[1:]
    at = np.flatnonzero(keep)
    if not len(at):
        return []
    found, n = distinct_rows([code[at + i] for i in range(words)], len(known))
    out = []
    for some in (slice(a, a + OUT_ROWS) for a in range(0, len(n), OUT_ROWS)):
        columns = [known.take(pa.array(c[some])) for c in found]
        phrase = columns[0] if words == 1 else pc.binary_join_element_wise(*columns, pa.scalar(b" ", pa.large_binary()))
        out.append(counts_batch(lang, phrase.cast(pa.binary()).cast(pa.string()), n[some]))
    if words == 1:
        out.append(counts_batch(lang, pa.nulls(1, pa.string()), np.array([len(code)])))
    return out


def counts_batch(lang: str, phrase: pa.Array, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([lang] * len(n), pa.string()), phrase, pa.array(n.astype(np.int64))], names=["lang", "phrase", "n"])


def counted(texts: DataFrame, words: int, marks=None, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(lang, phrase, n): all occurrences of phrases of so many words that may be frequent, counted by block and summed."""

    def run(batches):
        held: dict[str, list[str]] = {}
        size = 0

        def flush():
            for lang, some in held.items():
                yield from block_counts(lang, some, words, None if marks is None else np.frombuffer(marks.value, np.uint64))

        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if size and size + len(text) > block_chars:
                    yield from flush()
                    held, size = {}, 0
                held.setdefault(lang, []).append(text)
                size += len(text)
        yield from flush()

    return texts.mapInArrow(run, "lang string, phrase string, n long").groupBy("lang", "phrase").agg(F.sum("n").alias("n"))


def marks_of(phrases: DataFrame, size: int = MARKS) -> bytes:
    """The bit set of a round's frequent phrases: at most so many bits come to the driver, however many phrases there are."""

    def run(batches):
        for batch in batches:
            h = []
            for lang, phrase in zip(batch.column("lang").to_pylist(), batch.column("phrase").to_pylist(), strict=True):
                h.append(folded(lang, [word_hashes([w]) for w in phrase.encode().split(b" ")])[0])
            at = np.array(h, np.uint64) % np.uint64(size)
            place, which = np.unique(at >> np.uint64(6), return_inverse=True)
            bits = np.zeros(len(place), np.uint64)
            np.bitwise_or.at(bits, which, np.uint64(1) << (at & np.uint64(63)))
            yield pa.RecordBatch.from_arrays([pa.array(place.view(np.int64)), pa.array(bits.view(np.int64))], names=["place", "bits"])

    found = phrases.select("lang", "phrase").mapInArrow(run, "place long, bits long").groupBy("place").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(size // 64, np.uint64)
    out[found.column("place").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return out.tobytes()


def ordered(phrases: DataFrame, from_last: bool) -> DataFrame:
    """(part, lang, k0.., words, n): a stream of phrases in prefix order (or suffix order), cut into ranges; k are the words, '' after the end."""
    w = F.split("phrase", " ")
    keys = [F.coalesce(F.get(F.reverse(w) if from_last else w, F.lit(i)), F.lit("")).alias(k) for i, k in enumerate(KEYS)]
    rows = phrases.select("lang", *keys, F.size(w).alias("words"), "n")
    return written(rows.repartitionByRange(n_partitions(phrases.sparkSession), "lang", *KEYS).withColumn("part", F.spark_partition_id()), "ordered")


def walked(stream: DataFrame, from_last: bool) -> DataFrame:
    """(lang, phrase, a, parts, wider) of the phrases of two words and more: the counts of its beginnings (ends) from the shortest on, and of its
    most frequent extension by one word. A phrase open at the end of a range comes again from each range that it reaches into, without a and parts.
    """
    n = n_partitions(stream.sparkSession)
    order = ["lang", *KEYS]
    lasts = [F.max(F.when(F.col("words") == d, F.struct(*order, "words", "n"))).alias(f"last{d}") for d in range(1, MOST_WORDS)]
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    open_ = stream.groupBy("part").agg(*lasts).select("part", *(F.last(f"last{d}", ignorenulls=True).over(before).alias(f"open{d}") for d in range(1, MOST_WORDS)))
    carried = open_.select("part", F.explode(F.array(*(f"open{d}" for d in range(1, MOST_WORDS)))).alias("x")).where("x is not null").select("part", "x.*", F.lit(True).alias("carried"))
    rows = stream.withColumn("carried", F.lit(False)).unionByName(carried).repartition(n, "part").sortWithinPartitions("part", *order)

    def walk(batches):
        out: list[tuple] = []
        stack: list[list] = []
        within = None

        def close():
            words, n, is_carried, parts, wider = stack.pop()
            if len(words) > 1 and (wider or not is_carried):
                out.append((within[1], " ".join(reversed(words) if from_last else words), None if is_carried else n, parts, wider))

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("part", "lang", "words", "n", "carried", *KEYS)]
            for part, lang, size, n, is_carried, *keys in zip(*columns, strict=True):
                words = keys[:size]
                while stack and (within != (part, lang) or stack[-1][0] != words[: len(stack[-1][0])]):
                    close()
                within = (part, lang)
                if stack and len(stack[-1][0]) == size - 1:
                    stack[-1][4] = max(stack[-1][4], n)
                if not is_carried and len(stack) != size - 1:
                    raise ValueError(f"a part of a frequent phrase isn't frequent: {lang} {words}")
                stack.append([words, n, is_carried, None if is_carried else [x[1] for x in stack], 0])
            yield flushed(out)
            out = []
        while stack:
            close()
        yield flushed(out)

    def flushed(out):
        types = (pa.string(), pa.string(), pa.int64(), pa.list_(pa.int64()), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names=["lang", "phrase", "a", "parts", "wider"])

    return rows.mapInArrow(walk, "lang string, phrase string, a long, parts array<long>, wider long")


def collocations(docs: DataFrame, at_least: int = LEAST_COUNT, covered: int = COVERED, per_lang: int = PER_LANG, mark_bits: int = MARKS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first phrases of each language.

    A-Z is lowered; texts are split into pieces at `.,;:!?` and line ends, pieces into words at blanks and tabs. A null or empty text has no
    words; a null lang is `und`; repeated rows all count; ids and other columns are not read; an empty table gives no rows. Ties go to the more
    frequent phrase, then to the first in the order of bytes.
    """
    spark = docs.sparkSession
    prepare(spark)
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    levels, marks = [], None
    for words in range(1, MOST_WORDS + 1):
        known = written(counted(texts, words, marks, block_chars).where((F.col("n") >= at_least) | F.col("phrase").isNull()), f"phrases{words}")
        levels.append(known)
        if words < MOST_WORDS:
            marks = spark.sparkContext.broadcast(marks_of(known.where("phrase is not null"), mark_bits))
    phrases = levels[0].where("phrase is not null")
    for level in levels[1:]:
        phrases = phrases.unionAll(level)
    totals = levels[0].where("phrase is null").select("lang", F.col("n").alias("n"))
    left, right = (walked(ordered(phrases, from_last), from_last) for from_last in (False, True))
    none = F.lit(None).cast("array<long>")
    both = left.withColumnRenamed("parts", "lefts").withColumn("rights", none).unionByName(right.withColumnRenamed("parts", "rights").withColumn("lefts", none))
    found = both.groupBy("lang", "phrase").agg(F.max("a").alias("a"), F.max("lefts").alias("lefts"), F.max("rights").alias("rights"), F.max("wider").alias("wider"))
    # a longer phrase that holds this one is no more frequent than one of its extensions by one word, so those decide
    alone = found.where(F.col("wider") * 100 < F.col("a") * covered)
    cuts = F.expr("""array_min(transform(sequence(1, size(lefts)), k -> struct(
        cast(2000000 as decimal(38, 0)) * a div (cast(lefts[k - 1] as decimal(20, 0)) + rights[size(rights) - k]) as score, k, lefts[k - 1] as l, rights[size(rights) - k] as r)))""")
    scored = alone.withColumn("cut", cuts).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)).alias("salt"))
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    first = scored.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= per_lang)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= per_lang)
    return ranked.join(totals.hint("merge"), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score").withColumn("rank", F.col("rank").cast("long"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2,000 best phrases of each language."""
    return collocations(read(spark, sf_dir, "documents"))


#: The same rows in DuckDB.
SQL = f"""with pieces as (select lang, [w for w in regexp_split_to_array(piece, '[ \\t]+') if w <> ''] as w from (
  select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) as piece from documents)),
 grams as (select lang, m, array_to_string(w[i : i + m - 1], ' ') as phrase from (select lang, w, m, unnest(range(1, len(w) - m + 2)) as i from pieces, (select unnest(range(1, {MOST_WORDS + 1})) as m))),
 f as (select lang, phrase, any_value(m) as m, count(*) as n from grams group by lang, phrase having count(*) >= {LEAST_COUNT}),
 totals as (select lang, sum(len(w))::bigint as n from pieces group by lang),
 cuts as (select c.lang, c.phrase, c.n as a, k, x.n as l, y.n as r, ((2000000::hugeint * c.n) // (x.n + y.n))::bigint as score from (select *, unnest(range(1, m)) as k, string_split(phrase, ' ') as w from f where m > 1) c
  join f x on x.lang = c.lang and x.phrase = array_to_string(c.w[1 : k], ' ') join f y on y.lang = c.lang and y.phrase = array_to_string(c.w[k + 1 :], ' ')),
 best as (select * from cuts qualify row_number() over (partition by lang, phrase order by score, k) = 1),
 alone as (select * from best b where not exists (select 1 from f z where z.lang = b.lang and z.m > len(string_split(b.phrase, ' ')) and contains(' ' || z.phrase || ' ', ' ' || b.phrase || ' ') and 100 * z.n >= {COVERED} * b.a))
select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, n, score from alone join totals using (lang) qualify rank <= {PER_LANG}"""
