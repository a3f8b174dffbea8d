"""Byte-level BPE in linear time: longest matches with backtracking over memoised token compatibility.

Bytes are mapped to Latin-1 characters, so that a pyahocorasick trie gives the longest token at a place. A sequence
of tokens is the one that ranked merging makes exactly when each adjacent pair is compatible: merging the pair's own
bytes gives that pair back. The encoder takes the longest match, falls back to shorter ones where the pair with
the token before isn't compatible, and never tries a place twice that led nowhere.
"""

from __future__ import annotations

import hashlib
from functools import cache
from itertools import chain

import ahocorasick
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import MEMO_ENTRIES, keyed, prepare, read
from .tokens import ranks_of_tiktoken

TOKENIZER = "byte_bpe_multi_50k.tiktoken"
#: Above every rank.
NEVER = 1 << 40


class Bpe:
    """Encoder and decoder for one vocabulary of ranked byte strings."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.tokens = ranks, {r: b for b, r in ranks.items()}
        self.names = {r: str(r) for r in self.tokens}
        self.longest = max(map(len, ranks))
        self.cut = regex.compile(pattern).findall
        self.trie = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
        for b in ranks:
            self.trie.add_word(b.decode("latin-1"))
        self.pairs: dict[tuple[bytes, bytes], bool] = {}
        self.edges: dict[tuple[bytes, int], list[tuple[bytes, int]]] = {}
        self.known: dict[str, tuple[int, ...]] = {}
        self.usable = {b for b in ranks if self.whole(b)}

    def halves(self, token: bytes) -> list[bytes]:
        """The two tokens whose merge makes this one: merge the pair of lowest rank, leftmost first, down to two."""
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            rank, at = min((self.ranks.get(a + b, NEVER), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if rank == NEVER:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def edge(self, token: bytes, side: int) -> list[tuple[bytes, int]]:
        """What stands at an edge (0 left, 1 right) while the token is being merged, each with the rank of the merge that ends it."""
        key = (token, side)
        if key not in self.edges:
            if len(self.edges) > MEMO_ENTRIES:
                self.edges.clear()
            below = self.halves(token) if len(token) > 1 else []
            grown = [*self.edge(below[-side], side)[:-1], (below[-side], self.ranks[token])] if below else []
            self.edges[key] = [*grown, (token, NEVER)]
        return self.edges[key]

    def whole(self, token: bytes) -> bool:
        """Whether merging the token's bytes gives the token."""
        return len(token) == 1 or len(self.halves(token)) == 2

    def compatible(self, a: bytes, b: bytes) -> bool:
        """Whether a and b stay apart when their joined bytes are merged: no merge across comes before those inside."""
        ok = self.pairs.get((a, b))
        if ok is None:
            if len(self.pairs) > MEMO_ENTRIES:
                self.pairs.clear()
            rank = self.ranks.get
            ok = self.pairs[a, b] = not any((r := rank(x + y, NEVER)) < x_ends and r <= y_ends and r < NEVER for x, x_ends in self.edge(a, 1) for y, y_ends in self.edge(b, 0))
        return ok

    def piece(self, data: bytes) -> list[bytes]:
        """Tokens of one pre-token."""
        if data in self.usable:
            return [data]
        text, usable, pairs = data.decode("latin-1"), self.usable, self.pairs
        out: list[bytes] = []
        dead, at, size = set(), 0, self.trie.longest_prefix(text)
        while at < len(data):
            while size:  # the next shorter match that is a token, leads to no dead place and fits the token before
                token = data[at : at + size]
                if token in usable and at + size not in dead and (not out or (pairs[out[-1], token] if (out[-1], token) in pairs else self.compatible(out[-1], token))):
                    break
                size -= 1
            if size:
                out.append(token)
                at += size
                size = self.trie.longest_prefix(text[at : at + self.longest]) if at < len(data) else 0
            else:
                dead.add(at)
                if not out:
                    raise ValueError("this vocabulary can't encode every byte string")
                size = len(out[-1]) - 1
                at -= len(out.pop())
        return out

    def encode(self, text: str) -> list[int]:
        """Ids of a text, each match of the pattern on its own."""
        known, parts = self.known, self.cut(text)
        if len(known) > MEMO_ENTRIES:
            known.clear()
        for p in {p for p in parts if p not in known}:
            known[p] = tuple(self.ranks[t] for t in self.piece(p.encode()))
        return list(chain.from_iterable(map(known.__getitem__, parts)))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


@cache
def bpe(path: str) -> Bpe:
    return Bpe(ranks_of_tiktoken(path), public_tokenizers.PATTERN)


def encoded(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """(doc_id, ids array<int>, decoded binary) of every whole text; null is empty, no ids and no bytes."""
    prepare(docs.sparkSession)
    path = tokenizer or public_tokenizers.path(TOKENIZER)

    def run(batches):
        coder = bpe(path)
        for batch in batches:
            ids = [coder.encode(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32())), pa.array([coder.decode(x) for x in ids], pa.binary())], names=["doc_id", "ids", "decoded"])

    return keyed(docs).mapInArrow(run, "doc_id long, ids array<int>, decoded binary")


def digests(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, a row for each row of documents.

    Null and empty texts have 0 tokens and the digests of nothing; repeated rows are each encoded; a null doc_id stays
    null; an empty table gives no rows; other columns are not read.
    """
    prepare(docs.sparkSession)
    path = tokenizer or public_tokenizers.path(TOKENIZER)

    def run(batches):
        coder = bpe(path)
        for batch in batches:
            n, a, b = [], [], []
            for text in batch.column("text").to_pylist():
                ids = coder.encode(text)
                n.append(len(ids))
                a.append(hashlib.sha256(",".join(map(coder.names.__getitem__, ids)).encode()).hexdigest())
                b.append(hashlib.sha256(coder.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return keyed(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text encoded and decoded again."""
    return digests(read(spark, sf_dir, "documents"))
