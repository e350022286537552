"""Byte-level BPE as a lazily determinised finite-state transducer, and streaming decode.

The nondeterministic machine guesses token borders. Its states pair the last token with a place in the trie of all
tokens; a border after token t is open if t follows the last token in some canonical encoding, which the two tokens'
merges alone decide. A prefix of a text has one canonical encoding, so the guesses alive at a time are few, and a wrong
one dies within the longest token's length. Determinising carries the guesses as a set, each with the tokens not
emitted yet; what all of them have in common goes out at once. Deterministic states and transitions are made when a
text first needs them.
"""

from __future__ import annotations

import base64
import codecs
import hashlib
import re
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blank

#: Deterministic states, token pairs and chunks that are kept before each store starts anew.
STATES, PAIRS, MEMO = 200_000, 1_000_000, 500_000


def load_ranks(path: str) -> dict[bytes, int]:
    """Tokens and ranks of a rank file: base64, space, decimal number on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class Transducer:
    """Encodes byte strings by merge ranks."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {k: t for t, k in ranks.items()}
        self.trie: list[dict[int, int]] = [{}]
        self.token_at = [-1]
        for token, rank in ranks.items():
            node = 0
            for b in token:
                if b not in self.trie[node]:
                    self.trie[node][b] = len(self.trie)
                    self.trie.append({})
                    self.token_at.append(-1)
                node = self.trie[node][b]
            self.token_at[node] = rank
        self.halves: dict[int, tuple[int, int] | None] = {}
        self.pairs: dict[tuple[int, int], bool] = {}
        self._forget()

    def _forget(self) -> None:
        self.ids: dict[tuple, int] = {}
        self.states: list[tuple] = []
        self.next: list[dict[int, tuple[int, tuple[int, ...]]]] = []
        self.start = self._state(((-1, 0, ()),))

    def _state(self, guesses: tuple) -> int:
        if guesses not in self.ids:
            self.ids[guesses] = len(self.states)
            self.states.append(guesses)
            self.next.append({})
        return self.ids[guesses]

    def _halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge is this one; None for single bytes; (-1, -1) if merges never give it."""
        if token not in self.halves:
            text = self.tokens[token]
            parts = [text[i : i + 1] for i in range(len(text))]
            while len(parts) > 2:
                rank, at = min(((self.ranks.get(parts[i] + parts[i + 1], token), i) for i in range(len(parts) - 1)), default=(token, 0))
                if rank >= token:
                    break
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            self.halves[token] = None if len(text) == 1 else (self.ranks[parts[0]], self.ranks[parts[1]]) if len(parts) == 2 else (-1, -1)
        return self.halves[token]

    def follows(self, left: int, right: int) -> bool:
        """Whether the encoding of left's and right's bytes together is just these two tokens.

        Undoing the latest merge on either side of the border again and again shows every pair of tokens that ever met
        there; the border stands if none of them would have merged before the later of the two was made.
        """
        key = (left, right)
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            known = self.pairs[key] = self._halves(right) != (-1, -1) and self._meets(left, right)
        return known

    def _meets(self, left: int, right: int) -> bool:
        # a merge of equal rank goes to the left first: one across the border comes before one right of it
        before = (1 << 62, 0)
        while True:
            joint = self.ranks.get(self.tokens[left] + self.tokens[right])
            if joint is not None and (joint, 1) < before:
                return False
            of_left, of_right = self._halves(left), self._halves(right)
            if of_left is None and of_right is None:
                return True
            if of_right is None or (of_left is not None and left > right):
                before, left = (left, 0), of_left[1]
            else:
                before, right = (right, 2), of_right[0]
            if left < 0 or right < 0:
                return False

    def _advance(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        guesses, trie, pairs = [], self.trie, self.pairs
        for last, node, held in self.states[state]:
            to = trie[node].get(byte)
            if to is None:
                continue
            if trie[to]:
                guesses.append((last, to, held))
            token = self.token_at[to]
            if token >= 0:
                fits = last < 0 and self._halves(token) != (-1, -1)
                if last >= 0:
                    fits = pairs.get((last, token))
                    if fits is None:
                        fits = self.follows(last, token)
                if fits:
                    guesses.append((token, 0, (*held, token)))
        out = guesses[0][2]
        for _, _, held in guesses:
            while out and held[: len(out)] != out:
                out = out[:-1]
        if out:
            n = len(out)
            guesses = [(last, node, held[n:]) for last, node, held in guesses]
        # guesses keep the order of their parents, so that equal sets are equal tuples
        rest = tuple(guesses)
        if len(self.states) >= STATES:
            self._forget()
            return self._state(rest), out
        to = self.next[state][byte] = (self._state(rest), out)
        return to

    def encode(self, piece: bytes) -> list[int]:
        """The ids of one piece; a piece that is a token is that token."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        out: list[int] = []
        state = self.start
        for byte in piece:
            step = self.next[state].get(byte) or self._advance(state, byte)
            state = step[0]
            if step[1]:
                out += step[1]
        return out + next(list(held) for _, node, held in self.states[state] if node == 0)


class _Memo(dict):
    def __init__(self, make):
        self.make = make

    def __missing__(self, chunk: str) -> bytes:
        if len(self) >= MEMO:
            self.clear()
        out = self.make(chunk)
        if len(chunk) < 64:
            self[chunk] = out
        return out


#: White space beside a space: there, a chunk's ids depend on its neighbour.
_CROWDED = re.compile(r"\s | \s")


class Codec:
    """Encodes and decodes texts by a rank file and a splitting pattern, without special tokens."""

    def __init__(self, path: str, pattern: str):
        self.transducer = Transducer(load_ranks(path))
        self.split = regex.compile(pattern).findall
        self.spaced = _Memo(lambda chunk: self._encode(" " + chunk))
        self.pieces = _Memo(lambda piece: array("I", self.transducer.encode(piece.encode())).tobytes())
        self.bytes_of = [self.transducer.tokens.get(k, b"") for k in range(max(self.transducer.tokens, default=-1) + 1)]

    def _encode(self, text: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, self.split(text)))

    def encode(self, text: str) -> array:
        """The ids. Single spaces part chunks that are encoded, or remembered, one by one."""
        if _CROWDED.search(text):
            packed = self._encode(text)
        else:
            first, *rest = text.split(" ")
            packed = self._encode(first) + b"".join(map(self.spaced.__getitem__, rest))
        ids = array("I")
        ids.frombytes(packed)
        return ids

    def decode(self, ids: Iterable[int], block: int = 65_536) -> Iterator[str]:
        """The text in parts, from ids taken block by block; a character cut by a block's end waits for its rest.

        Bytes that are not UTF-8 come out as U+FFFD.
        """
        utf8 = codecs.getincrementaldecoder("utf-8")("replace")
        ids = ids if isinstance(ids, (list, array)) else list(ids)
        for at in range(0, len(ids), block):
            yield utf8.decode(b"".join(map(self.bytes_of.__getitem__, ids[at : at + block])))
        yield utf8.decode(b"", final=True)


@lru_cache(4)
def shared(path: str, pattern: str) -> Codec:
    """One codec for each worker process, so that its automaton outlives a task."""
    return Codec(path, pattern)


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>) of each whole text; a null text is an empty one and has no ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = shared(path, pattern)
        for batch in batches:
            ids = [codec.encode(t.as_py()).tolist() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), blank(text_col).alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text) of (doc_id, ids); null ids give a null text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = shared(path, pattern)
        for batch in batches:
            texts = [None if ids is None else "".join(codec.decode(ids)) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Digests of encode and of decode after it, in one pass that keeps ids in the task: doc_id, n_tokens, ids_sha256, decoded_sha256.

    Null texts are empty ones. Rows are taken one by one, repeated ones too; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = shared(path, pattern)
        decimal = [str(k) for k in range(len(codec.bytes_of))].__getitem__
        for batch in batches:
            n, of_ids, of_text = [], [], []
            for text in batch.column(1):
                ids = codec.encode(text.as_py())
                n.append(len(ids))
                of_ids.append(hashlib.sha256(",".join(map(decimal, ids)).encode()).hexdigest())
                digest = hashlib.sha256()
                for part in codec.decode(ids):
                    digest.update(part.encode())
                of_text.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), blank(text_col).alias("text")).mapInArrow(run, schema)
