"""Encoders and packing against the public libraries."""

import hashlib
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from claimforge.llm import bpe, packing, token_count

TEXT = st.text(alphabet=st.one_of(st.sampled_from("abcdeitnorsh AB.,'\n\t 019▁<>|"), st.characters(exclude_categories=["Cs"])), max_size=200)
RANKS = bpe.ranks_of_tiktoken(P.path(bpe.TOKENIZER))
LIBRARY = tiktoken.Encoding("library", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})
PIECES = sentencepiece.SentencePieceProcessor(model_file=P.path(token_count.TOKENIZER))


@settings(max_examples=200, deadline=None)
@given(TEXT)
def test_bpe_is_the_librarys(text):
    coder = bpe.bpe(P.path(bpe.TOKENIZER))
    ids = coder.encode(text)
    assert ids == LIBRARY.encode_ordinary(text) and coder.decode(ids) == text.encode()


def test_tokens_of_any_length_are_found():
    """A vocabulary with a token of 512 bytes, which may stand anywhere in a text."""
    ranks = {bytes([b]): b for b in range(256)} | {b"a" * 2**k: 255 + k for k in range(1, 10)}
    coder, library = bpe.Bpe(ranks, r".+"), tiktoken.Encoding("long", pat_str=r".+", mergeable_ranks=ranks, special_tokens={})
    for text in ("a" * 700, "b" + "a" * 700, "ab" * 3 + "a" * 1537 + "c" + "a" * 511):
        assert coder.encode(text) == library.encode_ordinary(text)


@settings(max_examples=200, deadline=None)
@given(TEXT)
def test_counts_are_the_librarys(text):
    assert token_count.count(token_count.transducer(P.path(token_count.TOKENIZER)), text) == len(PIECES.encode(text))


#: Besides the usual texts, some that hardly have a restart.
SPACELESS = st.text(alphabet=st.sampled_from("aaabexyz \n"), max_size=120) | st.text(alphabet=st.sampled_from("ae"), max_size=120) | st.integers(0, 150).map(lambda n: " " * n)


@settings(max_examples=200, deadline=None)
@given(TEXT | SPACELESS, st.integers(1, 40), st.integers(1, 60), st.randoms())
def test_maps_compose_in_any_order(text, size, context, r):
    """From the entry states that contexts leave open, and from those that were missing, whatever the order of composition."""
    machine = token_count.transducer(P.path(token_count.TOKENIZER))
    chunks = token_count.cut(token_count.marked(text), size, context)
    first = [token_count.state_map(machine, *c) for c in chunks]
    if text:
        for _ in range(len(chunks) + 1):
            state, n, at = machine.spelt(token_count.START), 0, 0
            for at, one in enumerate(first):
                if not (to := one.get(state) or one.get(None)):
                    break
                state, n = to[0], n + to[1]
            else:
                break
            first[at] |= token_count.state_map(machine, *chunks[at], {machine.read(state)})
        assert n == len(PIECES.encode(text))
        maps = list(first)
        while len(maps) > 1:
            i = r.randrange(len(maps) - 1)
            maps[i : i + 2] = [token_count.after(*maps[i : i + 2])[0]]
        whole = maps[0]
        assert (whole.get(machine.spelt(token_count.START)) or whole[None])[1] == n


def long_texts(prose):
    chars = "".join(chr(0x4E00 + (i * i * 7 + i // 3) % 3000) for i in range(5 * token_count.CHUNK_CHARS))
    return {1: prose(1, 400_000), 2: "x" * 100_000 + " " * 70_000 + "y", 3: "z" * (token_count.CHUNK_CHARS - 1), 4: "z " * token_count.CHUNK_CHARS, 7: chars, 8: prose(3, 90_000).replace(" ", ""), None: prose(2, 20_000)}


@pytest.mark.parametrize("context", [token_count.CONTEXT_CHARS, 2])
def test_very_long_texts_are_spread_over_tasks(spark, prose, context):
    """With and without spaces; with a context too short to find entry states in, the missing ones are asked for."""
    texts = long_texts(prose)
    rows = [*texts.items(), (1, texts[1]), (5, texts[2]), (6, "short")]
    df = spark.createDataFrame([(i, t) for i, t in rows], "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.n_bytes, r.n_tokens) for r in token_count.counts(df, context=context).collect())
    assert got == sorted((i or -1, len(t.encode()), len(PIECES.encode(t))) for i, t in rows)


def test_chunks_without_a_restart_leave_few_states_open(prose):
    """Characters without spaces: a handful of entry states a chunk, the true one among them; no text in a map."""
    machine = token_count.transducer(P.path(token_count.TOKENIZER))
    for key in (7, 8):
        text = long_texts(prose)[key]
        maps = [token_count.state_map(machine, *c) for c in token_count.cut(token_count.marked(text), 1000, token_count.CONTEXT_CHARS)]
        assert max(map(len, maps)) <= 16
        whole = maps[0]
        for one in maps[1:]:
            whole, missing = token_count.after(whole, one)
            assert not missing
        assert sum(n for _, n in whole.values()) == len(PIECES.encode(text))


def test_bpe_query_over_odd_rows(odd, odd_rows, empty):
    rows = sorted((r.doc_id or -1, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.digests(odd).collect())
    want = []
    for i, t in odd_rows:
        ids = LIBRARY.encode_ordinary(t or "")
        want.append((i or -1, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert rows == sorted(want) and bpe.digests(empty).count() == 0


def test_count_query_over_odd_rows(odd, odd_rows, empty):
    rows = sorted((r.doc_id or -1, r.n_bytes, r.n_tokens, r.over_limit) for r in token_count.counts(odd).collect())
    want = [(i or -1, len((t or "").encode()), n := len(PIECES.encode(t or "")), n > 4096) for i, t in odd_rows]
    assert rows == sorted(want) and token_count.counts(empty).count() == 0


def test_packing_is_gapless_and_exact(odd, odd_rows, empty):
    library = Tokenizer.from_file(P.path(packing.TOKENIZER))
    rows = packing.pack(odd, window=64).collect()
    seen = {}
    for r in rows:
        seen.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s, pieces in seen.items():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at == 64 or s == max(seen)
    docs = sorted((i or -1, [*library.encode(t or "", add_special_tokens=False).ids, 0]) for i, t in odd_rows)
    assert sum(r.length for r in rows) == sum(len(ids) for _, ids in docs)
    for r in rows:
        alike = [ids for i, ids in docs if i == (r.doc_id or -1) and len(ids) == r.doc_tokens]
        assert any(zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32 for ids in alike)
    assert packing.pack(empty).count() == 0
