"""Token ids of the public byte-level vocabulary.

The ids are those of `tokenizers` with the vocabulary file given and add_special_tokens=False: a special token that
stands in a text is one id, and what is between them is encoded apart. They are computed by tiktoken from the same file,
because its ids are equal (tests compare them) at a quarter of the time; where tiktoken gives up on a text, or the file
has special tokens that take blanks or whole words with them, `tokenizers` encodes it.
"""

from __future__ import annotations

import json
import re
from functools import cache

#: The vocabulary's pattern and the printable stand-ins of its bytes, fixed by its format.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@cache
def _slow(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@cache
def _fast(path: str):
    """The encoding, the ids of special tokens, and the pattern that finds them; None if it can't be used."""
    import tiktoken

    with open(path, encoding="utf-8") as f:
        data = json.load(f)
    added = data.get("added_tokens", [])
    if any(x.get(flag) for x in added for flag in ("single_word", "lstrip", "rstrip", "normalized")):
        return None
    special = {x["content"]: x["id"] for x in added}
    byte_of = {chr(b): b for b in PRINTABLE} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(PRINTABLE))}
    ranks = {bytes(byte_of[c] for c in token): i for token, i in data["model"]["vocab"].items() if token not in special}
    cut = re.compile("(" + "|".join(re.escape(x) for x in sorted(special, key=len, reverse=True)) + ")") if special else None
    return tiktoken.Encoding("velamen", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), special, cut


def encode(text: str, path: str | None = None) -> list[int]:
    path = path or default_vocabulary()
    if fast := _fast(path):
        encoding, special, cut = fast
        try:
            if cut is None or not cut.search(text):
                return encoding.encode_ordinary(text)
            return [i for k, part in enumerate(cut.split(text)) for i in ([special[part]] if k % 2 else encoding.encode_ordinary(part))]
        except BaseException as e:  # a panic of its regular expressions is no Exception
            if isinstance(e, KeyboardInterrupt | SystemExit):
                raise
    return _slow(path).encode(text, add_special_tokens=False).ids
