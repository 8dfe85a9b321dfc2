"""Ids of the lower-casing word tokenizer, word by word with a memory.

The tokenizer drops white space and never joins what stands on both sides of it,
so a text's ids are those of its chunks between spaces and line ends, one after
the other. Chunks repeat, hence each worker remembers the ids of many.
Chunks of plain letters, digits and signs go through the byte-pair merges at
once; all others go through the tokenizers library.
"""

from __future__ import annotations

import os
import sys
from array import array
from functools import lru_cache

import regex

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
#: Chunks that a worker remembers before it starts anew, and characters of the longest of them: texts without spaces are long chunks.
REMEMBERED, LONGEST = 100_000, 64
#: ASCII signs and letters, and Latin-1 letters: composed, with one lower-case letter each.
_PLAIN = regex.compile(r"[!-~À-ÖØ-öø-ÿ]*+")
_PIECE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
assert sys.byteorder == "little" and array("I").itemsize == 4
_END = b"\xff"  # ends a word; no UTF-8 byte


class WordIds:
    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        # vocabulary entries spell bytes as printable characters, byte 255 never among them
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in shown}
        byte_of |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
        ranks: dict[bytes, int] = {}
        for token, number in self.whole.get_vocab(with_added_tokens=False).items():
            end = token.endswith("</w>")
            data = bytes(byte_of[c] for c in (token[:-4] if end else token))
            ranks[data + _END if end else data] = number
        # the end mark merges first, with the byte before it: all 256 such pairs are in the vocabulary
        assert all(bytes([i]) + _END in ranks for i in range(256))
        ranks[_END] = max(ranks.values()) + 1000
        self.merges = tiktoken.Encoding("words", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
        self.single = self.merges._core_bpe.encode_single_piece
        self.memory: dict[str, bytes] = {"": b""}

    def _chunk(self, chunk: str) -> bytes:
        if chunk.isascii() and chunk.isalpha():
            return array("I", self.single(chunk.lower().encode() + _END)).tobytes()
        if _PLAIN.fullmatch(chunk) and "<|" not in chunk:
            ids: list[int] = []
            for piece in _PIECE.findall(chunk.lower()):
                ids += self.single(piece.encode() + _END)
            return array("I", ids).tobytes()
        return array("I", self.whole.encode(chunk, add_special_tokens=False).ids).tobytes()

    def ids(self, text: str) -> bytes:
        """The text's ids as little-endian unsigned 32-bit numbers."""
        memory = self.memory
        chunks = text.replace("\n", " ").split(" ")
        new = set(chunks).difference(memory)
        long = {c: self._chunk(c) for c in new if len(c) > LONGEST}  # of this text alone
        if len(memory) + len(new) > REMEMBERED:
            memory.clear()
            memory[""] = b""
            new = set(chunks).difference(memory)
        if len(new) > REMEMBERED:  # a text of so many different chunks is gone through without a memory
            return b"".join(long[c] if c in long else self._chunk(c) for c in chunks)
        for c in new.difference(long):
            memory[c] = self._chunk(c)
        return b"".join([long[c] if c in long else memory[c] for c in chunks] if long else map(memory.__getitem__, chunks))


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    return WordIds(path)
