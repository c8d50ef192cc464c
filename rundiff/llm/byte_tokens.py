"""Token ids of texts by a byte-level tokenizer file.

Such a tokenizer cuts a text by a fixed pattern and merges bytes inside each piece only. A quick encoder of the same
pattern and merges does most texts; what it might do differently or slowly goes to the tokenizer itself.
"""

import json
import re
from array import array

from rundiff.llm.tokens import _byte_letters

_STRETCH = 1 << 20  # characters of a text handled at a time
_LONGEST_QUICK = 500  # characters without a change to or from white space

# The pattern of byte-level tokenizers without one of their own.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

# characters that every version of the character tables puts into the same class
_SETTLED = re.compile("[\x00-\x1b\x20-ɏ‐-‧€]*")
_WIDE_GAP = re.compile(r"\s{%d}" % _LONGEST_QUICK)
_CUT = re.compile(r"(?<=\S)\s")  # no piece goes on over white space after another character


def encoder(path):
    """A function from a text to its ids as little-endian unsigned 32-bit numbers, for the tokenizer file at ``path``."""
    import tiktoken

    letters = {letter: byte for byte, letter in _byte_letters().items()}
    with open(path, encoding="utf-8") as file:
        stored = json.load(file)
    special = {t["content"] for t in stored["added_tokens"]}
    # in a byte-level vocabulary a token's id is the rank of its merge
    ranks = {bytes([letters[c] for c in token]): i for token, i in stored["model"]["vocab"].items() if token not in special}
    quick = tiktoken.Encoding("quick", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    kept = []

    def exact(text):
        if not kept:  # seldom needed, and slow to load
            from tokenizers import Tokenizer

            kept.append(Tokenizer.from_file(path))
        return kept[0].encode(text, add_special_tokens=False).ids

    def stretch(text):
        plain = _SETTLED.fullmatch(text) and max(map(len, text.split()), default=0) <= _LONGEST_QUICK and not _WIDE_GAP.search(text)
        return array("I", quick(text) if plain else exact(text)).tobytes()

    def encode(text):
        if any(s in text for s in special):
            return array("I", exact(text)).tobytes()
        out, at = [], 0
        while len(text) - at > _STRETCH:
            cut = _CUT.search(text, at + _STRETCH)
            to = cut.start() if cut else len(text)
            out.append(stretch(text[at:to]))
            at = to
        out.append(stretch(text[at:]))
        return b"".join(out)

    return encode
