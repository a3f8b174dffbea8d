"""Secret scans, in DataFrame functions only.

Three fixed kinds are found by pattern (assign, access, hex). Beside them, long runs of encoding characters go
through a battery of randomness tests: their encoding is inferred from the characters they have, and chi-squared
uniformity over its alphabet, a runs test on character classes and lag-one serial correlation give p-values for "this is
random". A run is cleared when randomness is rejected; the Benjamini-Hochberg step that decides this works on each length
class by itself, over all runs of the corpus, so short runs, where the tests have little power, don't borrow from long ones.
What can't be cleared is reported as kind `random`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import keyed, read

#: Fixed patterns of the three kinds, in their order.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{32,}"
RUN = r"[A-Za-z0-9+/_=-]{20,}"
KINDS = ("assign", "access", "hex", "random")
ASSIGN_CHARS, ACCESS_CHARS = 8, 16
#: What stands for a secret in a redacted text.
MASK = "[SECRET]"
#: Share of false clearances the procedure allows for.
LEVEL = 0.05
#: Length classes: the logarithm of the length to this base.
LENGTH_BASE = 1.5
#: Steps of p-values (powers of ten by halves) in the histogram that the step-up procedure reads.
P_STEPS = 40

#: Matches that are walked together: appending to what a block has found copies at most so many.
BLOCK = 256

SPAN = "array<struct<start: int, kind: int, end: int, piece: string>>"
#: Alphabet size and chance that two neighbours are of different classes (digit, lower, upper, other), by encoding.
ENCODINGS = "array(struct(16 AS size, 0.46875D AS change), struct(32 AS size, 0.3047D AS change), struct(36 AS size, 0.4012D AS change), struct(62 AS size, 0.6223D AS change), struct(64 AS size, 0.6445D AS change))"


def bound(value: Column, use) -> Column:
    """use(value) with value worked out once, although lambdas in it refer to it many times."""
    return F.transform(F.array(value), use)[0]


def spans(text: Column, kind: int, pattern: str, group: int, keep) -> Column:
    """Leftmost non-overlapping matches as (start, kind, end, piece), code points, where keep(match, group) holds.

    The parts between matches give the places: the text split by the pattern, walked together with its matches. The walk goes by blocks
    of BLOCK matches, each from where the lengths of the blocks before it end, so its time is linear in the matches (but for one addition
    per pair of blocks).
    """
    walk = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("all"), F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("part"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(x["all"])
        span = F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), x["all"].alias("piece"))
        kept = F.when(x["all"].isNotNull() & keep(x["all"], x["part"]), F.concat(acc["out"], F.array(span))).otherwise(acc["out"])
        return F.struct(F.coalesce(end, start).alias("at"), kept.alias("out"))

    none = F.from_json(F.lit("[]"), SPAN)
    size = lambda x: F.length(x["gap"]) + F.coalesce(F.length(x["all"]), F.lit(0))
    total = lambda numbers: F.aggregate(numbers, F.lit(0), lambda a, n: a + n)

    def dealt(blocks: Column) -> Column:
        lengths = F.transform(F.slice(blocks, 1, F.size(blocks) - 1), lambda block: F.aggregate(block, F.lit(0), lambda a, x: a + size(x)))
        return bound(lengths, lambda before: F.transform(blocks, lambda block, i: F.aggregate(block, F.struct(total(F.slice(before, 1, i)).alias("at"), none.alias("out")), step, lambda acc: acc["out"])))

    cut = lambda w: F.transform(F.sequence(F.lit(0), F.floor((F.size(w) - 1) / BLOCK).cast("int")), lambda b: F.slice(w, b * BLOCK + 1, BLOCK))
    found = F.flatten(bound(walk, lambda w: bound(cut(w), dealt)))
    return F.when(text.rlike(pattern), found).otherwise(none)


def base_spans(text: Column) -> Column:
    yes = F.lit(True)
    return F.concat(
        spans(text, 0, ASSIGN, 2, lambda _, value: F.length(value) >= ASSIGN_CHARS),
        spans(text, 1, ACCESS, 0, lambda m, _: F.length(m) >= ACCESS_CHARS),
        spans(text, 2, HEX, 0, lambda *_: yes),
    )


def tested(runs: Column) -> list[tuple[str, Column]]:
    """Steps, each reading the one before by name, to (start, kind, end, piece, length_class, p_step) of runs that look like
    an encoding of bytes.

    p_step is -2 log10 of the battery's p-value for randomness, whole, at most P_STEPS; an upper case run with digits
    is base32 only if it has none of 0, 1, 8 and 9.
    """
    named = F.transform(
        runs,
        lambda r: F.struct(
            *(r[c].alias(c) for c in ("start", "kind", "end", "piece")),
            F.split(F.regexp_replace(r["piece"], "=+$", ""), "").alias("chars"),
            F.when(r["piece"].rlike("[+/_=-]"), 4).when(r["piece"].rlike("^([0-9a-f]+|[0-9A-F]+)$"), 0).when(r["piece"].rlike("^[A-Z2-7]+$"), 1).when(r["piece"].rlike("^([0-9a-z]+|[0-9A-Z]+)$"), 2).otherwise(3).alias("encoding"),
        ),
    )
    measured = F.expr("""transform(named, r -> named_struct('r', r, 'n', cast(size(r.chars) as double), 'e', {encodings}[r.encoding],
        'squares', aggregate(array_distinct(r.chars), 0D, (s, c) -> s + pow(size(filter(r.chars, x -> x = c)), 2)),
        'runs', 1D + size(filter(sequence(1, size(r.chars) - 1), i -> CASE WHEN r.chars[i] BETWEEN '0' AND '9' THEN 0 WHEN r.chars[i] BETWEEN 'a' AND 'z' THEN 1 WHEN r.chars[i] BETWEEN 'A' AND 'Z' THEN 2 ELSE 3 END
            <> CASE WHEN r.chars[i - 1] BETWEEN '0' AND '9' THEN 0 WHEN r.chars[i - 1] BETWEEN 'a' AND 'z' THEN 1 WHEN r.chars[i - 1] BETWEEN 'A' AND 'Z' THEN 2 ELSE 3 END)),
        'codes', transform(r.chars, c -> cast(ascii(c) as double))))""".format(encodings=ENCODINGS))
    moments = F.expr("""transform(measured, m -> named_struct('m', m, 'mean', aggregate(m.codes, 0D, (s, x) -> s + x) / m.n))""")
    serial = F.expr("""transform(moments, q -> named_struct('m', q.m, 'var', aggregate(q.m.codes, 0D, (s, x) -> s + pow(x - q.mean, 2)),
        'lag', aggregate(sequence(1, size(q.m.codes) - 1), 0D, (s, i) -> s + (q.m.codes[i] - q.mean) * (q.m.codes[i - 1] - q.mean))))""")
    scores = F.expr("""transform(serial, q -> named_struct('m', q.m,
        'z', greatest(
            (q.m.squares * q.m.e.size / q.m.n - q.m.n - (q.m.e.size - 1)) / sqrt(2 * (q.m.e.size - 1) * (q.m.n - 1) / q.m.n),
            (1 + (q.m.n - 1) * q.m.e.change - q.m.runs) / sqrt((q.m.n - 1) * q.m.e.change * (1 - q.m.e.change)),
            coalesce(abs(try_divide(q.lag, q.var) + 1 / q.m.n) * sqrt(q.m.n), 99D) - 0.5)))""")
    # the battery's p-value: the upper tail at its largest statistic, for three tests
    out = F.expr(f"""transform(scores, q -> named_struct('start', q.m.r.start, 'kind', q.m.r.kind, 'end', q.m.r.end, 'piece', q.m.r.piece,
        'length_class', cast(floor(ln(q.m.n) / ln({LENGTH_BASE}D)) as int),
        'p_step', least({P_STEPS}, greatest(0, cast(floor(-2 * log10(least(1D, 3D / (1D + exp(least(600D, 1.5976D * least(30D, q.z) + 0.070566D * pow(least(30D, q.z), 3))))))) as int)))))""")
    return [("named", named), ("measured", measured), ("moments", moments), ("serial", serial), ("scores", scores), ("runs_tested", out)]


def with_runs(docs: DataFrame, text: str) -> DataFrame:
    """Adds runs_tested: the tested runs of a text column; runs without both a letter and a digit are no encoding."""
    t = F.col(text)
    alike = lambda m, _: m.rlike("[0-9]") & m.rlike("[A-Za-z]")
    df = docs.withColumn("runs_found", spans(t, 3, RUN, 0, alike))
    names = ["runs_found"]
    for name, column in tested(F.col("runs_found")):
        df = df.withColumn(name, column)
        names.append(name)
    return df.drop(*names[:-1])


def clearing_steps(docs: DataFrame) -> dict[int, int]:
    """For each length class the p_step from which runs are cleared (Benjamini-Hochberg over the whole corpus).

    Counts by (length class, p_step) are all that leaves the executors: some hundred numbers, whatever the input.
    """
    runs = with_runs(keyed(docs), "text").select(F.explode("runs_tested").alias("r"))
    histogram = runs.groupBy("r.length_class", "r.p_step").count().collect()
    out: dict[int, int] = {}
    for length in {h.length_class for h in histogram}:
        counts = {h.p_step: h["count"] for h in histogram if h.length_class == length}
        total, seen = sum(counts.values()), 0
        for step in range(P_STEPS, 0, -1):
            seen += counts.get(step, 0)
            if seen and 10 ** (-step / 2) <= LEVEL * seen / total:
                out[length] = step  # the largest p-value that still passes
    return out


def with_spans(docs: DataFrame, clearing: dict[int, int], text: str = "text") -> DataFrame:
    """Adds base and extra: arrays of (start, kind, end, piece), each in order of start, then kind."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    limits = F.create_map(*(F.lit(x) for pair in (clearing or {-1: 0}).items() for x in pair))
    df = with_runs(docs.withColumn("scanned", t), "scanned")
    uncleared = F.filter("runs_tested", lambda r: r["p_step"] < F.coalesce(limits[r["length_class"]], F.lit(P_STEPS + 1)))
    extra = F.transform(uncleared, lambda r: F.struct(*(r[c].alias(c) for c in ("start", "kind", "end", "piece"))))
    return df.withColumn("base", F.array_sort(base_spans(F.col("scanned")))).withColumn("extra", extra).drop("runs_tested", "scanned")


def listed(found: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, a row for each row of documents.

    Null and empty texts have no spans (counts 0, the digest of nothing, an empty list). Repeated rows are each scanned;
    a null doc_id stays null; an empty table gives no rows; other columns are not read.
    """
    found = with_spans(keyed(docs), clearing_steps(docs))
    of = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    every = F.array_sort(F.concat("base", "extra"))
    return found.select("doc_id", of(0).alias("n_assign"), of(1).alias("n_access"), of(2).alias("n_hex"), F.sha2(listed(F.col("base")).cast("binary"), 256).alias("base_sha256"), listed(every).alias("spans"))


def redacted(docs: DataFrame) -> DataFrame:
    """The rows of documents, all columns, with MASK in place of each secret (overlapping ones together) and n_chars anew
    where there is one; texts without secrets, null ones too, stay as they are."""
    found = with_spans(docs.select(F.struct("*").alias("row"), F.col("text").cast("string").alias("text")), clearing_steps(docs))
    # walk the spans in order: what stands between the end of the last and the start of the next is kept
    masked = F.expr(f"""aggregate(array_sort(concat(base, extra)), named_struct('at', 0, 'out', ''),
        (acc, s) -> named_struct('at', greatest(acc.at, s.end),
            'out', CASE WHEN s.start >= acc.at AND NOT (s.start = acc.at AND acc.at > 0) THEN concat(acc.out, substring(text, acc.at + 1, s.start - acc.at), '{MASK}') ELSE acc.out END),
        acc -> concat(acc.out, substring(text, acc.at + 1, length(text))))""")
    new = found.withColumn("new_text", F.when(F.size("base") + F.size("extra") > 0, masked).otherwise(F.col("text")))
    fresh = {"text": F.col("new_text"), "n_chars": F.length("new_text").cast("long")}
    return new.select(*(fresh[c].alias(c) if c in fresh else F.col(f"row.`{c}`").alias(c) for c in docs.columns))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of all whole texts."""
    return scan(read(spark, sf_dir, "documents"))
