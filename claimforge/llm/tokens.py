"""Reading public byte-level BPE vocabularies."""

from __future__ import annotations

import base64
import json
import re
from collections.abc import Iterable


def byte_alphabet() -> dict[str, int]:
    """The printable characters that stand for bytes in a byte-level BPE vocabulary file."""
    keep = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in keep]
    return {chr(b): b for b in keep} | {chr(256 + i): b for i, b in enumerate(rest)}


def ranks_of_json(path: str) -> tuple[dict[bytes, int], dict[str, int]]:
    """(byte tokens -> id, special strings -> id) of a tokenizers file whose ids follow its merges' order."""
    spec = json.load(open(path, encoding="utf-8"))
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    alphabet = byte_alphabet()
    ranks = {bytes(map(alphabet.__getitem__, t)): i for t, i in spec["model"]["vocab"].items() if t not in special}
    for at, merge in enumerate(spec["model"]["merges"]):
        left, right = merge.split(" ") if isinstance(merge, str) else merge
        if spec["model"]["vocab"][left + right] != 256 + at:
            raise ValueError("ids of this file don't follow its merges")
    return ranks, special


def split_special(text: str, special: Iterable[str]) -> list[str]:
    """The text cut at special strings; those strings stand at odd places."""
    special = list(special)
    if not any(s in text for s in special):
        return [text]
    return re.split("(" + "|".join(map(re.escape, special)) + ")", text)


def ranks_of_tiktoken(path: str) -> dict[bytes, int]:
    """Byte tokens -> rank of a .tiktoken file."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
