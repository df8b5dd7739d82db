"""Greedy word-piece lengths by a linear longest-match automaton that never builds a piece."""

from __future__ import annotations

from collections.abc import Iterable
from functools import lru_cache

import pyarrow as pa
import public_tokenizers
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textpairs.llm.byte_bpe import RANKS, read_ranks
from textpairs.llm.common import col

CACHED = 200_000
COUNTED = "struct<n_words:bigint,n_tokens:bigint,n_unknown:bigint>"


class PieceCounter:
    """Trie over the pieces with failure links that say how many pieces are settled when they are followed.

    A word is read once from left to right. Where the trie goes no further, the failure link leads to the node that
    stands for what is left after the longest pieces are taken off, and the number of those pieces is stored beside
    it. ``starts`` are pieces at the beginning of a word, ``rest`` those after it.
    """

    START, REST = 0, 1

    def __init__(self, starts: Iterable[bytes], rest: Iterable[bytes], cached: int = CACHED):
        self.edges: dict[int, int] = {}
        self.known: dict[bytes, int] = {}
        self.cached = cached
        whole, depth_first = {}, [[self.START, self.REST]]
        parents: list[tuple[int, int] | None] = [None, None]
        depths = [0, 0]
        for root, pieces in ((self.START, starts), (self.REST, rest)):
            for piece in pieces:
                if not piece:
                    continue
                node = root
                for byte in piece:
                    following = self.edges.get(node << 8 | byte)
                    if following is None:
                        following = self.edges[node << 8 | byte] = len(parents)
                        parents.append((node, byte))
                        depths.append(depths[node] + 1)
                        while len(depth_first) <= depths[following]:
                            depth_first.append([])
                        depth_first[depths[following]].append(following)
                    node = following
                whole[node] = True
        self.fail = [-1] * len(parents)
        self.settled = [0] * len(parents)
        for level in depth_first[1:]:
            for node in level:
                if node in whole:
                    self.fail[node], self.settled[node] = self.REST, 1
                    continue
                above, byte = parents[node]
                at, count = self.fail[above], self.settled[above]
                while at >= 0 and at << 8 | byte not in self.edges:
                    count += self.settled[at]
                    at = self.fail[at]
                if at >= 0:
                    self.fail[node], self.settled[node] = self.edges[at << 8 | byte], count

    def pieces(self, word: bytes) -> int:
        """Number of pieces of a word; 0 if the pieces cannot spell it."""
        edges, fail, settled = self.edges, self.fail, self.settled
        node = count = 0
        for byte in word:
            following = edges.get(node << 8 | byte)
            while following is None:
                count += settled[node]
                node = fail[node]
                if node < 0:
                    return 0
                following = edges.get(node << 8 | byte)
            node = following
        while node != self.REST:
            count += settled[node]
            node = fail[node]
            if node < 0:
                return 0
        return count

    def count(self, words: list[bytes]) -> tuple[int, int, int]:
        """Words, tokens, unknown words; an unknown word is one token."""
        known, total, unknown = self.known, 0, 0
        for word in words:
            n = known.get(word)
            if n is None:
                if len(known) >= self.cached:
                    known.clear()
                n = known[word] = self.pieces(word)
            if n:
                total += n
            else:
                unknown += 1
        return len(words), total + unknown, unknown


def split_vocabulary(tokens: Iterable[bytes]) -> tuple[set[bytes], set[bytes]]:
    """Tokens after a blank start a word, the others go on with it; single bytes may do both."""
    tokens = set(tokens)
    rest = {t for t in tokens if t[:1] != b" "}
    return {t[1:] for t in tokens if t[:1] == b" " and len(t) > 1} | {t for t in rest if len(t) == 1}, rest


@lru_cache(maxsize=2)
def counter(path: str) -> PieceCounter:
    """One per Python worker."""
    return PieceCounter(*split_vocabulary(read_ranks(path)))


def piece_counts(text: Column, path: str) -> Column:
    @F.arrow_udf(COUNTED)
    def count(texts: pa.Array) -> pa.Array:
        pieces = counter(path)
        rows = [pieces.count((t.as_py() or "").encode().split()) for t in texts]
        columns = zip(*rows, strict=True) if rows else [(), (), ()]
        return pa.StructArray.from_arrays(
            [pa.array(c, pa.int64()) for c in columns], names=["n_words", "n_tokens", "n_unknown"]
        )

    return count(text)


def count_tokens(docs: DataFrame, path: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    r"""``doc_id, n_words, n_tokens, n_unknown`` of every whole text.

    Words are runs other than ``[\\x20\\x09-\\x0D]``; each is cut from the left into the longest pieces of the vocabulary
    in ``path``, a rank file every executor can read. A word that cannot be cut so is one unknown token.

    Null or empty text has no words. Rows are independent: null and repeated keys stay, an empty table gives no rows,
    other columns are left out.
    """
    counted = piece_counts(col(text), path or public_tokenizers.path(RANKS))
    return docs.select(col(key).alias("doc_id"), counted.alias("c")).select("doc_id", "c.*")
