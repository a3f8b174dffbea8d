"""Token counts by a finite-state transducer compiled from a merge vocabulary.

The transducer reads characters; each transition carries how many tokens the encoding of what has been read grows by
(it may shrink). A state is what the future can depend on: the longest read suffix that starts some token, and, for
each place in it, the last token of the encoding up to there with the tokens from there to the end. States and
transitions are built when first needed and then kept. A character that no token of more characters holds, and a word
mark after something else, put the machine into a state that doesn't depend on the past.

Texts are cut into chunks. A chunk's state map leads from entry states to (exit state, tokens). Its entry states are those that the
characters before it leave open: one if the machine restarts among them, else the states that runs from each of the last
CONTEXT_CHARS places end in, mostly few, as runs meet soon. Maps compose associatively: a parallel prefix scan composes runs of chunks
first, each in a task, and then the runs' maps. No text travels with a map. Where the true entry state isn't among those of a map, it
is asked for, and that chunk is run again from it, until no text is open. A text of one chunk is counted by itself; the
chunks of longer ones are rows of the job, so that a very long one is spread over many tasks, with or without spaces.
"""

from __future__ import annotations

import json
import re
from functools import cache

import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import MEMO_ENTRIES, discarded, keyed, n_partitions, prepare, read, written

TOKENIZER = "piece_bpe_32k.model"
TOKEN_LIMIT = 4096
#: Characters of a chunk, and chunks of a run.
CHUNK_CHARS, RUN = 1 << 15, 64
#: Characters before a chunk that its entry states are sought in.
CONTEXT_CHARS = 128
MARK = "▁"
#: The state before anything has been read, or after something that no token spans.
START = 0


class Transducer:
    """Deterministic transducer for a sentencepiece BPE model with byte fallback and identity normalisation."""

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.get_piece_size())
        plain = [i for i in ids if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        #: The order in which merges win: higher score first.
        self.rank = {model.id_to_piece(i): -model.get_score(i) for i in plain}
        self.starts = {p[:n] for p in self.rank for n in range(1, len(p) + 1)}
        self.longest = max(map(len, self.rank))
        if any(MARK in p.lstrip(MARK) or "\n" in p for p in self.rank):
            raise ValueError("a token of this model holds a line end, or a word mark after something else")
        self.usable = {p for p in self.rank if self.merged(p) == [p]}
        self.apart: dict[tuple[str, str], bool] = {}
        #: Of a suffix: in which of its places a token may still start.
        self.alive: dict[str, list[bool]] = {}
        self.words = Words(self)
        self.forget()

    def forget(self) -> None:
        """Only the start state is known; steps[state] holds a state's transitions."""
        self.states: list[tuple] = [("", ((None, 0),))]
        self.number: dict[tuple, int] = {self.states[0]: START}
        self.steps: list[dict[str, tuple[int, int]]] = [{}]
        self.compiled = 0

    def state(self, state: tuple) -> int:
        """The number of a state, a new one if it is new."""
        if state not in self.number:
            self.number[state] = len(self.states)
            self.states.append(state)
            self.steps.append({})
        return self.number[state]

    def merged(self, text: str) -> list[str]:
        """The definition: merge the adjacent pair of best rank, leftmost first."""
        rank, never, parts = self.rank.get, float("inf"), list(text)
        ranks = [rank(a + b, never) for a, b in zip(parts, parts[1:], strict=False)]
        while ranks and (best := min(ranks)) < never:
            i = ranks.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del ranks[i]
            if i:
                ranks[i - 1] = rank(parts[i - 1] + parts[i], never)
            if i < len(ranks):
                ranks[i] = rank(parts[i] + parts[i + 1], never)
        return parts

    def stay_apart(self, a: str, b: str) -> bool:
        if (a, b) not in self.apart:
            if len(self.apart) > MEMO_ENTRIES:
                self.apart.clear()
            self.apart[a, b] = self.merged(a + b) == [a, b]
        return self.apart[a, b]

    def step(self, state: int, char: str) -> tuple[int, int]:
        """(next state, tokens gained): compiled on first use."""
        suffix, places = self.states[state]
        if char not in self.rank:  # no token holds it: a token for each of its bytes, and nothing spans it
            out = (START, len(char.encode("utf-8", "surrogatepass")))
        else:
            read = suffix + char
            for n in range(min(len(read), self.longest), 0, -1):
                token, place = read[-n:], places[-n]
                if place is None or token not in self.usable:
                    continue
                last, after = place
                if last is None or self.stay_apart(last, token):
                    break
            gained = 1 - after
            kept = read
            while kept and kept not in self.starts:
                kept = kept[1:]
            grown = [*(p and (p[0], p[1] + gained) for p in places), (token, 0)][-len(kept) - 1 :]
            # a place where no token can start any more doesn't matter
            if kept not in self.alive:
                self.alive[kept] = [not kept[i:] or kept[i:] in self.starts for i in range(len(kept) + 1)]
            new = (kept, tuple([p if yes else None for p, yes in zip(grown, self.alive[kept], strict=True)]))
            out = (self.state(new), gained)
        self.steps[state][char] = out
        self.compiled += 1
        return out

    def run(self, state: int, text: str) -> tuple[int, int]:
        """Exit state and tokens gained over a text."""
        steps, total = self.steps, 0
        for char in text:
            state, gained = steps[state].get(char) or self.step(state, char)
            total += gained
        return state, total

    def runs(self, entries: set[int], text: str) -> dict[int, tuple[int, int]]:
        """run() from each of these states, side by side: runs that meet in a state go on as one."""
        live = {e: (0, [(e, 0)]) for e in entries}
        at = 0
        while len(live) > 1 and at < len(text):
            met: dict[int, tuple[int, list[tuple[int, int]]]] = {}
            for state, (total, held) in live.items():
                new, gained = self.steps[state].get(text[at]) or self.step(state, text[at])
                total += gained
                if new in met:
                    met[new][1].extend((e, total + less - met[new][0]) for e, less in held)
                else:
                    met[new] = (total, held)
            live, at = met, at + 1
        if len(live) == 1:
            [(state, (total, held))] = live.items()
            state, gained = self.run(state, text[at:])
            live = {state: (total + gained, held)}
        return {e: (state, total + less) for state, (total, held) in live.items() for e, less in held}

    def spelt(self, state: int) -> str:
        """A state in a form that other tasks read."""
        return json.dumps(self.states[state])

    def read(self, spelt: str) -> int:
        suffix, places = json.loads(spelt)
        return self.state((suffix, tuple(p and tuple(p) for p in places)))

    def bound(self) -> None:
        """Between texts: forget what has been compiled once there is too much of it."""
        self.words.bound()
        if self.compiled > 3 * MEMO_ENTRIES // 2:
            self.forget()


class Words(dict):
    """Tokens of a word from the start state, counted when first asked for. Two generations: words asked for since the last change stay."""

    def __init__(self, machine: Transducer):
        self.machine, self.older = machine, {}

    def __missing__(self, word: str) -> int:
        out = self[word] = self.older.get(word) or self.machine.run(START, word)[1]
        return out

    def bound(self) -> None:
        if len(self) > MEMO_ENTRIES:
            self.older = dict(self)
            self.clear()


@cache
def transducer(path: str) -> Transducer:
    return Transducer(path)


#: Words: the machine restarts before a mark that follows something else, and after a line end, which no token holds.
_WORD = re.compile(f"{MARK}+[^{MARK}\n]*\n*|[^{MARK}\n]+\n*|\n+")


#: Entry state -> (exit state, tokens), states as spelt; the entry None stands for all: the machine restarts at the cut.
StateMap = dict[str | None, tuple[str, int]]


def marked(text: str) -> str:
    """The text as the model reads it."""
    return MARK + text.replace(" ", MARK) if text else ""


def cut(text: str, chunk_chars: int, context: int) -> list[tuple[str, str]]:
    """(characters before it, chunk) of a text as the model reads it."""
    return [(text[max(0, i - context) : i], text[i : i + chunk_chars]) for i in range(0, len(text), chunk_chars)]


def entry_states(machine: Transducer, before: str) -> set[int]:
    """States that the machine may be in after these characters, whatever stood before them (nearly always: see missing links)."""
    words = _WORD.findall(before)
    if len(words) > 1:
        return {machine.run(START, words[-1])[0]}
    return {machine.run(START, before[i:])[0] for i in range(len(before))} or {START}


def state_map(machine: Transducer, before: str, chunk: str, entries: set[int] | None = None) -> StateMap:
    """The map of a chunk from what its context leaves open, or from these entry states."""
    words = _WORD.findall(chunk)
    restart = len(_WORD.findall(before[-1:] + chunk[:1])) == 2
    known = {START} if restart else entry_states(machine, before) if entries is None else entries
    out = machine.runs(known, words[0])
    if len(words) > 1:
        last, rest = machine.run(START, words[-1])[0], sum(map(machine.words.__getitem__, words[1:]))
        out = {e: (last, n + rest) for e, (_, n) in out.items()}
    return {None if restart else machine.spelt(e): (machine.spelt(x), n) for e, (x, n) in out.items()}


def after(first: StateMap, second: StateMap) -> tuple[StateMap, set[str]]:
    """The composition of two state maps, itself a state map, and the entry states that the second one lacks."""
    whole, missing = {}, set()
    for entry, (state, n) in first.items():
        to = second.get(state) or second.get(None)
        if to:
            whole[entry] = (to[0], n + to[1])
        else:
            missing.add(state)
    return whole, missing


def count(machine: Transducer, text: str) -> int:
    """Tokens of a whole text in one go."""
    machine.bound()
    return sum(map(machine.words.__getitem__, _WORD.findall(marked(text))))


#: A row is an entry of the map of a chunk (at) or of a run of chunks; without an exit it is a missing link: chunk `at` lacks the entry.
MAP = "digest string, run long, at long, entry string, exit string, tokens long"
MAP_COLUMNS = ("digest", "run", "at", "entry", "exit", "tokens")


def as_batch(rows: list[tuple]) -> pa.RecordBatch:
    """Rows of maps as Arrow."""
    types = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
    columns = zip(*rows, strict=True) if rows else [[]] * len(types)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=list(MAP_COLUMNS))


def composed(maps: DataFrame, part: str) -> DataFrame:
    """One map for all chunks of a run (part `at`), or for all runs of a text (part `run`), composed in order of the part, with
    the links that are missing. Entries that stand twice (of repeated texts) count once."""
    key_columns, chunks_a_part = (("digest", "run"), 1) if part == "at" else (("digest",), RUN)

    def fold(batches):
        key, place, whole, piece, rows = None, None, None, {}, []

        def closed():
            """What has been composed, with the piece that ends here."""
            if whole is None:
                return piece
            out, missing = after(whole, piece)
            rows.extend((key[0], key[1] if part == "at" else place, place * chunks_a_part, e, None, None) for e in sorted(missing))
            return out

        def result():
            rows.extend((key[0], key[1] if part == "at" else 0, 0, e, x, n) for e, (x, n) in closed().items())

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in MAP_COLUMNS), strict=True):
                of = dict(zip(MAP_COLUMNS, row, strict=True))
                now = tuple(of[c] for c in key_columns)
                if now != key:
                    if key:
                        result()
                    key, place, whole, piece = now, of[part], None, {}
                elif of[part] != place:
                    whole, place, piece = closed(), of[part], {}
                if of["exit"] is None:
                    rows.append(row)
                else:
                    piece[of["entry"]] = (of["exit"], of["tokens"])
            yield as_batch(rows)
            rows.clear()
        if key:
            result()
            yield as_batch(rows)

    dealt = maps.repartition(n_partitions(maps.sparkSession), *key_columns).sortWithinPartitions(*key_columns, part)
    return dealt.mapInArrow(fold, MAP)


def chunked(texts: DataFrame, context: int) -> DataFrame:
    """(digest, at, before, chunk) of (digest, text)."""

    def run(batches):
        for batch in batches:
            for digest, text in zip(batch.column("digest").to_pylist(), batch.column("text").to_pylist(), strict=True):
                chunks = cut(marked(text), CHUNK_CHARS, context)
                for i in range(0, len(chunks), RUN):
                    before, chunk = zip(*chunks[i : i + RUN], strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array([digest] * len(chunk)), pa.array(range(i, i + len(chunk)), pa.int64()), pa.array(before), pa.array(chunk)], names=["digest", "at", "before", "chunk"])

    return texts.mapInArrow(run, "digest string, at long, before string, chunk string").repartition(n_partitions(texts.sparkSession), "digest", "at")


def chunk_maps(chunks: DataFrame, path: str) -> DataFrame:
    """The maps of chunks; from the states in the column `entries`, if there is one."""

    def run(batches):
        machine = transducer(path)
        for batch in batches:
            machine.bound()
            columns = [batch.column(c).to_pylist() for c in ("digest", "at", "before", "chunk")]
            entries = batch.column("entries").to_pylist() if "entries" in batch.schema.names else [None] * batch.num_rows
            rows = []
            for d, at, before, chunk, wanted in zip(*columns, entries, strict=True):
                one = state_map(machine, before, chunk, wanted and {machine.read(e) for e in wanted})
                rows += [(d, at // RUN, at, e, x, n) for e, (x, n) in one.items()]
            yield as_batch(rows)

    return chunks.mapInArrow(run, MAP)


def long_counts(texts: DataFrame, path: str, context: int = CONTEXT_CHARS) -> DataFrame:
    """(digest, n_tokens) of (digest, text): chunks as rows.

    Maps, and totals with the links that are missing, are written; a missing link names a chunk and a state, from which that chunk is
    run as well. Each round closes at least the first open link of each text, so it ends; runs mostly meet within the context,
    and then there is one round.
    """
    maps = written(chunk_maps(chunked(texts, context), path), "maps")
    while True:
        found = written(composed(composed(maps, "at"), "run"), "totals")
        totals = found.where("exit is not null")
        asked = found.where("exit is null").join(totals.select("digest").hint("merge"), "digest", "left_anti")
        if asked.isEmpty():
            discarded(maps)
            return totals.select("digest", F.col("tokens").alias("n_tokens"))
        asked = asked.groupBy("digest", "at").agg(F.collect_set("entry").alias("entries"))
        again = chunked(texts.join(asked.select("digest").distinct().hint("merge"), "digest", "left_semi").dropDuplicates(["digest"]), context)
        more = written(maps.unionAll(chunk_maps(again.join(asked.hint("merge"), ["digest", "at"]), path)), "maps")
        discarded(maps, found)
        maps = more


def counts(docs: DataFrame, limit: int = TOKEN_LIMIT, tokenizer: str | None = None, context: int = CONTEXT_CHARS) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit, a row for each row of documents.

    Null and empty texts have no bytes and no tokens; repeated rows are each counted; a null doc_id stays null; an empty
    table gives no rows; other columns are not read. Texts are counted whole, whatever their length; those of more than one
    chunk are known by their digest while their chunks are apart.
    """
    prepare(docs.sparkSession)
    path = tokenizer or public_tokenizers.path(TOKENIZER)

    def run(batches):
        machine = transducer(path)
        for batch in batches:
            n = pa.array([count(machine, t) for t in batch.column("text").to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), n], names=["doc_id", "n_bytes", "n_tokens"])

    texts = keyed(docs).select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "text")
    is_long = F.length("text") >= CHUNK_CHARS
    short = texts.where(~is_long).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
    rows = texts.where(is_long).withColumn("digest", F.sha2(F.col("text").cast("binary"), 256))
    long = rows.select("doc_id", "n_bytes", "digest").join(long_counts(rows.select("digest", "text"), path, context).hint("merge"), "digest").select("doc_id", "n_bytes", "n_tokens")
    return short.unionAll(long).withColumn("over_limit", F.col("n_tokens") > limit)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all whole texts."""
    return counts(read(spark, sf_dir, "documents"))
