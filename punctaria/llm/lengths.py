"""Token counts and ids of whole texts with a public byte-pair vocabulary."""

from __future__ import annotations

import base64
import re

import numpy as np

#: Default vocabulary file; a parameter everywhere.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
END = 50256
# Fixed value: how the vocabulary's texts are cut before merging, in the form that never goes back over what it has read.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
#: Texts above this go to the encoder in pieces, as it recurses over long runs of white space.
PIECE = 100_000
# Fixed value: the pattern's white space.
_WHITE = r"\t-\r \x85\xa0  -     　"
_RUN = re.compile(f"[{_WHITE}]+")

_loaded: dict = {}


def vocabulary(spark, path: str = VOCABULARY) -> bytes:
    """The vocabulary file's content, read once by the driver (under 1 MB) and sent with the functions."""
    with open(path, "rb") as f:
        return f.read()


def pieces(text: str):
    """(piece, is_run) whose ids one after the other are those of the whole text.

    The pattern starts a token wherever white space starts, so a text may be cut before any run of it. A run of more than ``PIECE`` characters is a piece of its own, without its
    last character where something follows: the pattern leaves that one to the token behind.
    """
    at, end = 0, len(text)
    for run in _RUN.finditer(text):
        lo, hi = run.span()
        long = hi - lo > PIECE
        if lo > at and (long or lo - at >= PIECE):
            yield text[at:lo], False
            at = lo
        if long:
            stop = hi if hi == end else hi - 1
            yield text[lo:stop], True
            at = stop
    if at < end:
        yield text[at:], False


def _lists(content: bytes):
    """A function from a text to the list of its token ids."""
    key = hash(content)
    if key not in _loaded:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in content.splitlines() if line)}
        if max(ranks.values()) > 0xFFFF:
            raise ValueError("the vocabulary has more than 65536 ids")
        _loaded[key] = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    encode_ordinary, encode_run = _loaded[key].encode_ordinary, _loaded[key]._encode_single_piece

    def encode(text: str) -> list[int]:
        if len(text) <= PIECE:
            return encode_ordinary(text)
        out: list[int] = []
        for piece, run in pieces(text):
            out += encode_run(piece.encode()) if run else encode_ordinary(piece)
        return out

    return encode


def encoder(content: bytes):
    """A function from a text to its token ids, an array of 16-bit numbers."""
    lists = _lists(content)

    def encode(text: str) -> np.ndarray:
        ids = lists(text)
        return np.fromiter(ids, np.uint16, len(ids))

    return encode


def counter(content: bytes):
    """A function from a text to its number of tokens."""
    lists = _lists(content)
    return lambda text: len(lists(text))
