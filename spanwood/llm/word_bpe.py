"""Encoding with a tokenizers file chunk by chunk: white space parts chunks, and a bounded memo holds their ids."""

from __future__ import annotations

import json
import re
from array import array
from functools import lru_cache

import regex
import tiktoken
from tokenizers import Tokenizer

#: Chunks that the memo holds before it starts anew (about 25 MB).
MEMO = 30_000
#: Characters up to here are composed already and lower-cased one by one alike everywhere; other chunks go to the library.
PLAIN = 0x24F
#: White space for Python, but not for the tokenizer.
ODD_SPACE = re.compile("[\x1c-\x1f]")


class _Memo(dict):
    def __init__(self, make):
        self.make = make

    def __missing__(self, chunk: str) -> bytes:
        if len(self) >= MEMO:
            self.clear()
        out = self.make(chunk)
        if len(chunk) < 64:  # long chunks seldom come again
            self[chunk] = out
        return out


def _byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of bytes that byte-level vocabularies are written in (public since 2019)."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(rest)}


class WordBpe:
    """Encodes texts as the file's tokenizer does without special tokens; special tokens' strings are ordinary text.

    White space ends a word for this kind of tokenizer, so that a chunk's ids don't depend on its neighbours. For plain
    chunks, words are merged by a byte-pair table made from the file, with a byte that UTF-8 never has as the end of a
    word; all other chunks go through the library.
    """

    END = b"\xff"

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pattern, end = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"], spec["model"]["end_of_word_suffix"]
        plain = "".join(map(chr, range(PLAIN + 1)))
        cls = {p: "".join(map(re.escape, regex.findall(p, plain))) for p in (r"\p{L}", r"\p{N}", r"\s")}
        pattern = re.sub(r"\\p\{[LN]\}|\\s", lambda m: cls[m[0]], pattern)
        self.words = re.compile(pattern).findall
        self.plain = re.compile(f"[\0-\u012f\u0131-{chr(PLAIN)}]*").fullmatch
        alphabet = _byte_alphabet()
        ranks = {}
        for token, k in spec["model"]["vocab"].items():
            word = token.removesuffix(end)
            ranks[bytes(map(alphabet.__getitem__, word)) + (self.END if word != token else b"")] = k
        self.merge = tiktoken.Encoding("words", pat_str=".", mergeable_ranks=ranks, special_tokens={})._encode_single_piece
        self.memo = _Memo(self._encode)

    def _encode(self, chunk: str) -> bytes:
        if not chunk.isascii() and not self.plain(chunk):
            return array("I", self.tokenizer.encode(chunk, add_special_tokens=False).ids).tobytes()
        ids = array("I")
        for word in self.words(chunk.lower()):
            ids.extend(self.merge(word.encode() + self.END))
        return ids.tobytes()

    def packed(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit numbers."""
        chunks = text.split() if not ODD_SPACE.search(text) else regex.split(r"\s+", text)
        return b"".join(map(self.memo.__getitem__, chunks))


@lru_cache(4)
def shared(path: str) -> WordBpe:
    """One encoder for each worker process, so that its memo outlives a task."""
    return WordBpe(path)
