"""Overlapping pieces of a text for embeddings, cut where its structure allows."""

from __future__ import annotations

from bisect import bisect_right

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bytes of a token, typical and least; tokens kept for a piece's header; share of the budget that overlaps, and
#: up to which a text is one piece; least bytes of the window in which a cut is sought.
TYPICAL, LEAST, HEADER, OVERLAP, WHOLE, WINDOW = 2.5, 2.0, 30, 0.15, 0.85, 200
#: Lines that end a block, and lines that open one.
ENDS, OPENS = (b"}", b"});", b"},", b");"), (b"{", b"} else {", b"} else if")


def _borders(data: bytes) -> tuple[list[int], list[int]]:
    """Places behind line ends where a cut may be, and their ranks: blank line 3, end of a block 2, line at the margin 1."""
    places, ranks, at = [], [], 0
    while (end := data.find(b"\n", at)) >= 0:
        line = data[at:end]
        bare = line.strip()
        rank = 3 if not bare else 2 if bare in ENDS else 0 if bare in OPENS else int(line[:1] not in (b" ", b"\t"))
        if rank:
            places.append(end + 1)
            ranks.append(rank)
        at = end + 1
    return places, ranks


def pieces(text: str | None, signature: str, max_tokens: int) -> list[tuple[int, str, bool]]:
    """(index, text, whether it is the whole) of a text's pieces; none of an empty one or without a budget.

    A piece's body has no more than the budget less the header, at the least bytes of a token. Its end is the border of the
    best rank in a window before that, less up to half a rank for the distance, and behind the last piece's end; without one
    it is the limit, between two characters. The next piece starts an overlap before, at most half a piece. Each byte is
    looked at once, and each border once a window.
    """
    if not text or max_tokens <= 0:
        return []
    data = text.encode("utf-8", "surrogatepass")
    found = spans(data, max_tokens)
    if len(found) == 1:
        return [(0, text, True)]
    bodies = [data[a:b].decode("utf-8", "surrogatepass") for a, b in found]
    if signature:
        bodies = [f"// [{signature} — chunk {k + 1}/{len(bodies)}]\n{b}" for k, b in enumerate(bodies)]
    return [(k, b, False) for k, b in enumerate(bodies)]


def spans(data: bytes, max_tokens: int) -> list[tuple[int, int]]:
    """Starts and ends of the pieces' bodies in bytes."""
    room = max_tokens - HEADER if max_tokens > HEADER else max_tokens // 2
    most = max(1, int(room * LEAST))
    if len(data) <= most and int(len(data) / TYPICAL) <= int(max_tokens * WHOLE):
        return [(0, len(data))]
    overlap, radius = min(int(max_tokens * OVERLAP * TYPICAL), most // 2), max(WINDOW, most // 10)
    places, ranks = _borders(data)
    out, start, done = [], 0, 0
    while True:
        if len(data) - start <= most:
            out.append((start, len(data)))
            return out
        limit = start + most
        low, high = bisect_right(places, max(done, limit - radius)), bisect_right(places, limit)
        end = max(range(low, high), key=lambda k: (ranks[k] - 0.5 * (limit - places[k]) / radius, -k), default=None)
        if end is not None:
            end = places[end]
        else:
            end = _character(data, limit, start)
            while end == start or (end < len(data) and data[end] & 0xC0 == 0x80):  # one character is more than the limit
                end += 1
        out.append((start, end))
        done = end
        after = _character(data, end - overlap, start)
        start = after if after > start else end


def _character(data: bytes, at: int, start: int) -> int:
    """The last place up to `at` where a character begins, or start."""
    while at > start and at < len(data) and data[at] & 0xC0 == 0x80:
        at -= 1
    return max(at, start)


def text_pieces(text: Column, signature: Column, max_tokens: int) -> Column:
    """pieces() of a column, as array<struct<index int, text string, is_original boolean>>; an empty array for null."""

    def run(texts: pd.Series, signatures: pd.Series) -> pd.Series:
        return pd.Series([[dict(zip(("index", "text", "is_original"), p, strict=True)) for p in pieces(t, s or "", max_tokens)] for t, s in zip(texts, signatures, strict=True)])

    return F.pandas_udf(run, "array<struct<index:int,text:string,is_original:boolean>>")(text, signature)
