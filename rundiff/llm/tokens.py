"""Token ids of texts by a public tokenizer, one white-space word at a time.

The tokenizer drops white space and no token spans it, so the ids of a text are those of its words in order.
Words repeat, so a task keeps the ids of those it has seen lately, up to a bound.
"""

import re
from array import array

_MOST_WORDS = 60_000  # words in the young half of a memo
_MOST_PIECES = 140_000  # pieces of words in the young half of a memo
_LONGEST_KEPT = 64  # characters; longer words are seldom seen twice
_LONGEST_QUICK = 500  # characters; the quick encoder takes the square of a word's length
_PIECE = 1 << 20  # characters of a text handled at a time

# U+001C to U+001F end a word for str.split but are symbols to the tokenizer; texts with them are cut elsewhere
_ODD = re.compile("[\x1c-\x1f]")
_SPACE = re.compile(r"[ \t\n\r]+")
# letters for which lower case and composition need no context
_PLAIN = re.compile("[!-~À-ÖØ-öø-įı-ňŊ-ſ]+")
_PLAIN_TEXT = re.compile("[\t\n\r -~À-ÖØ-öø-įı-ňŊ-ſ‐-‧€]*")
_MARKS = re.compile(r"[.,](?:[^\s\w]|_)|(?:[^\s\w]|_)[.,]")  # a stop or comma that is part of a longer piece


def _byte_letters():
    """The letter that stands for each byte in a byte-level vocabulary: printable bytes are themselves, others follow U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


class Memo(dict):
    """Remembers what ``make`` gave for a word, in two halves: a full young half becomes the old one, and what is
    asked for again moves back, so frequent words stay while rare ones go."""

    def __init__(self, make, most):
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, word):
        ids = self.old.get(word)
        if ids is None:
            ids = self.make(word)
        if len(word) <= _LONGEST_KEPT:
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
            self[word] = ids
        return ids


def _piece_encoder(stored, exact):
    """A function from a lower-case piece that the tokenizer does not split further to its ids.

    The merges of the file are those of byte strings whose last byte ends the word, and a token's id is the rank of
    its merge. No text in UTF-8 has the byte that stands for the end.
    """
    import tiktoken

    bytes_of = {letter: byte for byte, letter in _byte_letters().items()}
    special, suffix = {t["content"] for t in stored["added_tokens"]}, stored["model"]["end_of_word_suffix"]
    ranks = {}
    for token, i in stored["model"]["vocab"].items():
        if token not in special:
            ends = token.endswith(suffix)
            ranks[bytes([bytes_of[c] for c in token.removesuffix(suffix)]) + b"\xff" * ends] = i
    quick = tiktoken.Encoding("pieces", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._encode_single_piece
    return lambda piece: array("I", quick(piece.encode() + b"\xff")).tobytes() if len(piece) <= _LONGEST_QUICK else exact(piece)


def new_encoder(path):
    """A function from a text to its ids as bytes, for the tokenizer file at ``path``.

    The fast way is for tokenizers that lower-case, split by a pattern and need no context across white space,
    like the one of the packing query; the pattern is read from the file.
    """
    import json

    import regex
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    with open(path, encoding="utf-8") as file:
        stored = json.load(file)
    split = regex.compile(stored["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]).findall
    exact = lambda text: array("I", tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
    pieces = Memo(_piece_encoder(stored, exact), _MOST_PIECES).__getitem__

    def of_word(word):
        return b"".join(map(pieces, split(word.lower()))) if _PLAIN.fullmatch(word) and "<|" not in word else exact(word)

    look = Memo(of_word, _MOST_WORDS).__getitem__

    def of_lower(word):
        if word.isalpha() or len(word) == 1:
            return pieces(word)
        return b"".join(map(pieces, split(word)))

    look_lower = Memo(of_lower, _MOST_WORDS).__getitem__

    def encode_part(text):
        if not _PLAIN_TEXT.fullmatch(text) or "<|" in text:
            return b"".join(map(look, text.split()))
        text = text.lower()
        if not _MARKS.search(text):  # stops and commas are pieces of their own, and words without them repeat more often
            text = text.replace(",", " , ").replace(".", " . ")
        return b"".join(map(look_lower, text.split()))

    def encode(text):
        if _ODD.search(text):
            return b"".join(map(look, [w for w in _SPACE.split(text) if w]))
        if len(text) <= _PIECE:
            return encode_part(text)
        out, at = [], 0
        while at < len(text):
            to = at + _PIECE
            if to < len(text):
                gap = _SPACE.search(text, to)
                to = gap.end() if gap else len(text)
            out.append(encode_part(text[at:to]))
            at = to
        return b"".join(out)

    return encode
