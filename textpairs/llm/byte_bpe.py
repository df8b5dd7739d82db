"""Byte-level BPE: ids of whole texts and texts of ids, by backtracking over longest vocabulary matches."""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textpairs.llm.common import col

RANKS = "byte_bpe_50k.tiktoken"
CACHED = 200_000
HEAD = 4
NEVER = 1 << 62
ENCODED = "struct<ids:array<int>,decoded:binary>"


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in file if line.strip())}


class _Pieces(dict):
    """Ids of the pieces met so far, as 32-bit integers. When half full, what was not met since the last time is given up."""

    def __init__(self, pairs: BytePairs):
        super().__init__()
        self.pairs, self.half = pairs, -(-pairs.cached // 2)
        self.before: dict[str, bytes] = {}

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= self.half:
            self.before = dict(self)
            self.clear()
        ids = self.before.get(piece)
        if ids is None:
            ids = array("i", self.pairs.encode_piece(piece.encode())).tobytes()
        self[piece] = ids
        return ids


class BytePairs:
    """Encoder for one vocabulary of byte strings and merge ranks.

    A sequence of tokens is the one the merges give exactly when every token is, on its own, and every two
    neighbours are. So the longest match is taken at each place, given up for the next shorter one where it does not
    go with the token before, and a place from which nothing goes on is marked and never tried again: a text of n
    bytes takes a number of steps in proportion to n. A match is looked for from the longest token with the same first
    bytes downwards. What goes with what is decided once per pair and remembered.
    """

    def __init__(self, ranks: dict[bytes, int], cached: int = CACHED):
        self.ranks, self.cached = ranks, cached
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.sizes = {rank: len(token) for token, rank in ranks.items()}
        # The longest token with these first bytes.
        self.reach: dict[bytes, int] = {}
        for token in ranks:
            if len(token) >= HEAD:
                self.reach[token[:HEAD]] = max(len(token), self.reach.get(token[:HEAD], 0))
        self.pieces = _Pieces(self)
        self.strings = pa.array([self.tokens.get(i) for i in range(max(self.tokens) + 1)], pa.binary())
        self.pairs: dict[int, bool] = {}
        self.shorter: dict[int, int | None] = {}
        self.single: dict[int, bool] = {}

    def merged(self, data: bytes) -> list[int]:
        """The merges done one by one; for the few bytes of one or two tokens. Only a merge's neighbours are ranked anew."""
        ranks = self.ranks
        parts = [data[i : i + 1] for i in range(len(data))]
        costs = [ranks.get(data[i : i + 2], NEVER) for i in range(len(data) - 1)]
        while costs and (least := min(costs)) != NEVER:
            at = costs.index(least)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del costs[at]
            if at < len(costs):
                costs[at] = ranks.get(parts[at] + parts[at + 1], NEVER)
            if at:
                costs[at - 1] = ranks.get(parts[at - 1] + parts[at], NEVER)
        return [ranks[p] for p in parts]

    def _fits(self, last: int | None, token: int) -> bool:
        if last is None:
            if token not in self.single:
                self.single[token] = self.merged(self.tokens[token]) == [token]
            return self.single[token]
        key = last << 32 | token
        found = self.pairs.get(key)
        if found is None:
            if len(self.pairs) >= self.cached:
                self.pairs.clear()
            found = self.pairs[key] = self.merged(self.tokens[last] + self.tokens[token]) == [last, token]
        return found

    def _shorter(self, token: int) -> int | None:
        if token not in self.shorter:
            data = self.tokens[token]
            ends = (self.ranks.get(data[:n]) for n in range(len(data) - 1, 0, -1))
            self.shorter[token] = next((rank for rank in ends if rank is not None), None)
        return self.shorter[token]

    def encode_piece(self, piece: bytes) -> list[int]:
        ranks, n = self.ranks.get, len(piece)
        whole = ranks(piece)
        if whole is not None:
            return [whole]
        sizes, pairs, reach, at = self.sizes, self.pairs.get, self.reach.get, 0
        out: list[int] = []
        dead = bytearray(n + 1)
        while True:
            end = min(at + reach(piece[at : at + HEAD], HEAD - 1), n)
            while (token := ranks(piece[at:end])) is None and end > at:
                end -= 1
            while True:
                while token is not None:
                    if not dead[at + sizes[token]]:
                        fits = pairs(out[-1] << 32 | token) if out else self.single.get(token)
                        if self._fits(out[-1] if out else None, token) if fits is None else fits:
                            break
                    token = self._shorter(token)
                if token is not None:
                    break
                if not out:
                    raise ValueError("the vocabulary lacks a byte of the text")
                dead[at] = 1
                token = out.pop()
                at -= sizes[token]
            out.append(token)
            at += sizes[token]
            if at == n:
                return out

    def forget(self) -> None:
        self.pieces = _Pieces(self)
        self.pairs.clear()

    def encode(self, pieces: Iterable[str]) -> bytes:
        """Ids of a text's pieces as 32-bit integers."""
        return b"".join(map(self.pieces.__getitem__, pieces))

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> pa.Array:
        """The bytes of many texts, whose ids lie one after the other and end at ``ends`` (from 0)."""
        found = self.strings.take(pa.array(ids))
        _, offsets, data = found.buffers()
        cuts = np.frombuffer(offsets, np.int32)[ends] if len(ids) else np.zeros(len(ends), np.int32)
        return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(cuts.tobytes()), data or pa.py_buffer(b"")])


@lru_cache(maxsize=2)
def encoder(path: str) -> BytePairs:
    """One per Python worker."""
    return BytePairs(read_ranks(path))


def encode_batch(pairs: BytePairs, split: regex.Pattern, texts: pa.Array) -> pa.Array:
    each = [pairs.encode(split.findall(text.as_py() or "")) for text in texts]
    ends = np.cumsum([0, *(len(ids) // 4 for ids in each)])
    ids = np.frombuffer(b"".join(each), dtype=np.int32)
    arrays = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids))
    return pa.StructArray.from_arrays([arrays, pairs.decode(ids, ends)], names=["ids", "decoded"])


def encoded(text: Column, path: str, pattern: str) -> Column:
    """``ids`` of a text and ``decoded``, the bytes that these ids stand for.

    What the encoder remembers lives as long as a task: workers are kept for the stages that follow.
    """

    @F.arrow_udf(ENCODED)
    def encode_texts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        pairs, split = encoder(path), regex.compile(pattern)
        try:
            for texts in batches:
                yield encode_batch(pairs, split, texts)
        finally:
            pairs.forget()
            pa.default_memory_pool().release_unused()

    return encode_texts(text)


def encode_documents(
    docs: DataFrame,
    path: str | None = None,
    pattern: str = public_tokenizers.PATTERN,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """``doc_id, ids, decoded``: token ids of every whole text and the bytes they decode to.

    ``pattern`` cuts a text into pieces that are encoded apart; special tokens are ordinary text. ``path`` names a
    rank file that every executor can read.

    Null or empty text has no ids and decodes to no bytes. Rows are independent: null or repeated keys are kept as
    they are, an empty table gives no rows, other columns are left out. A text is held in one task, nothing else.
    """
    path = path or public_tokenizers.path(RANKS)
    rows = docs.select(col(key).alias("doc_id"), encoded(col(text), path, pattern).alias("e"))
    return rows.select("doc_id", "e.ids", "e.decoded")
