"""Merge-type sentence pieces: ids of whole texts by backtracking over longest matches, and texts of ids."""

from __future__ import annotations

import re
from array import array
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2

from textpairs.llm.common import col

MODEL = "piece_bpe_32k.model"
CACHED = 300_000
BLANK = "▁"
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6


class _Known(dict):
    """Ids of the stretches met so far, as 32-bit integers; emptied when full."""

    def __init__(self, model: PieceModel):
        super().__init__()
        self.model = model

    def __missing__(self, stretch: str) -> bytes:
        if len(self) >= self.model.cached:
            self.clear()
        ids = self[stretch] = self.model.ids(self.model.segment(stretch))
        return ids


class PieceModel:
    """Encoder and decoder of one vocabulary of scored pieces.

    The merges join the two neighbours whose union has the best score, the leftmost of equal ones, as long as some union is a
    piece. What they give is the one segmentation in which every token, and every two neighbours, come back unchanged when their
    text is merged on its own. So at each place the longest match is taken, given up for the next shorter one where it does not go
    with the token before, and a place from which nothing goes on is marked in a bitfield and never tried again.

    A character that is no piece is a token all the same and becomes its bytes in the end.
    """

    def __init__(self, model: bytes, cached: int = CACHED):
        proto = sentencepiece_model_pb2.ModelProto.FromString(model)
        types = {p.type for p in proto.pieces}
        rules = proto.normalizer_spec
        plain = not rules.precompiled_charsmap and not rules.remove_extra_whitespaces and not proto.trainer_spec.treat_whitespace_as_suffix
        if proto.trainer_spec.model_type != proto.trainer_spec.BPE or not plain or types != {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError("only merge models with byte pieces, without normalisation and without symbols of the user's")
        self.cached = cached
        self.prefix = BLANK if rules.add_dummy_prefix else ""
        self.begin, self.finish = proto.trainer_spec.bos_id, proto.trainer_spec.eos_id
        self.scores = {p.piece: p.score for p in proto.pieces if p.type == NORMAL}
        self.numbers = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == NORMAL}
        self.bytes = {int(p.piece[1:-1], 16): i for i, p in enumerate(proto.pieces) if p.type == BYTE}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        # Tokens are numbers of pieces, and behind these the other characters.
        self.n = len(proto.pieces)
        self.texts = [p.piece for p in proto.pieces]
        self.sizes = list(map(len, self.texts))
        # Run over a reversed stretch, it finds for each place the longest piece that starts there.
        self.backwards = ahocorasick.Automaton()
        for piece, number in self.numbers.items():
            self.backwards.add_word(piece[::-1], number)
        self.backwards.make_automaton()
        self.stretches = re.compile(self._stretches())
        self.known = _Known(self)
        self.pairs: dict[int, bool] = {}
        self.alone: dict[int, bool] = {}
        self.next_shorter: dict[int, int | None] = {}
        surface = {
            NORMAL: lambda p: p.piece.replace(BLANK, " ").encode(),
            UNKNOWN: lambda p: proto.trainer_spec.unk_surface.encode(),
            CONTROL: lambda p: b"",
            BYTE: lambda p: bytes([int(p.piece[1:-1], 16)]),
        }
        self.surfaces = pa.array([surface[p.type](p) for p in proto.pieces], pa.binary())
        self.opens = np.array([p.type == NORMAL and p.piece.startswith(BLANK) for p in proto.pieces])
        self.silent = np.array([p.type == CONTROL for p in proto.pieces])

    def merged(self, text: str) -> list[str]:
        """The merges done one by one; for the few characters of one or two tokens."""
        parts, worst = list(text), float("-inf")
        while len(parts) > 1:
            scores = [self.scores.get(a + b, worst) for a, b in zip(parts, parts[1:])]
            best = max(scores)
            if best == worst:
                break
            at = scores.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _stretches(self) -> str:
        """Pattern of the stretches that no merge joins: blanks with letters, or blanks with other characters.

        That holds where no piece has a letter beside a character that is none, or a blank behind another character. Letters that
        some piece has beside others count among these. For other vocabularies the whole text is one stretch.
        """
        beside = {pair for piece in self.scores for pair in zip(piece, piece[1:])}
        odd, letter = "", re.compile(r"[^\W\d_]")
        for _ in range(2):
            mixed = {a if letter.match(a) else b for a, b in beside if a != BLANK and bool(letter.match(a)) != bool(letter.match(b))}
            if not mixed:
                return f"{BLANK}*(?:[^\\W\\d_{odd}]+|(?:(?!{BLANK})[\\W\\d_{odd}])+)|{BLANK}+"
            odd = "".join(map(re.escape, sorted(mixed)))
            letter = re.compile(rf"[^\W\d_{odd}]")
        return "(?s).+" if any(b == BLANK != a for a, b in beside) else f"{BLANK}*[^{BLANK}]+|{BLANK}+"

    def _text(self, token: int) -> str:
        return self.texts[token] if token < self.n else chr(token - self.n)

    def _token(self, text: str) -> int:
        number = self.numbers.get(text)
        return self.n + ord(text) if number is None else number

    def _fits(self, last: int, token: int) -> bool:
        """Whether the merges leave a token, behind another one if ``last`` is not negative, as it is."""
        if last < 0:
            if token not in self.alone:
                if len(self.alone) >= 2 * self.cached:
                    self.alone.clear()
                text = self._text(token)
                self.alone[token] = self.merged(text) == [text]
            return self.alone[token]
        key = last << 32 | token
        found = self.pairs.get(key)
        if found is None:
            if len(self.pairs) >= 2 * self.cached:
                self.pairs.clear()
            two = [self._text(last), self._text(token)]
            found = self.pairs[key] = self.merged("".join(two)) == two
        return found

    def _shorter(self, token: int) -> int:
        """The next shorter token with which a token's text starts, -1 for none."""
        found = self.next_shorter.get(token)
        if found is None:
            text = self._text(token)
            starts = (text[:n] for n in range(len(text) - 1, 0, -1))
            found = next((self._token(t) for t in starts if len(t) == 1 or t in self.numbers), -1)
            if len(self.next_shorter) >= 2 * self.cached:
                self.next_shorter.clear()
            self.next_shorter[token] = found
        return found

    def segment(self, text: str) -> list[int]:
        """Tokens of a stretch of text."""
        n, sizes, count = len(text), self.sizes, self.n
        longest, width = [-1] * n, [0] * n
        for end, number in self.backwards.iter(text[::-1]):
            at = n - 1 - end
            if sizes[number] > width[at]:
                longest[at], width[at] = number, sizes[number]
        failed = bytearray(n // 8 + 1)
        pairs, fits, at, out, last = self.pairs.get, self._fits, 0, [], -1
        token = -2
        while at < n:
            if token == -2:
                token = longest[at]
                if token < 0:
                    token = count + ord(text[at])
            while token >= 0:
                end = at + (sizes[token] if token < count else 1)
                if not failed[end >> 3] >> (end & 7) & 1:
                    known = pairs(last << 32 | token) if last >= 0 else None
                    if fits(last, token) if known is None else known:
                        break
                token = self._shorter(token)
            if token >= 0:
                out.append(token)
                last, at, token = token, end, -2
            else:
                failed[at >> 3] |= 1 << (at & 7)
                token = out.pop()
                at -= sizes[token] if token < count else 1
                last, token = out[-1] if out else -1, self._shorter(token)
        return out

    def ids(self, tokens: list[int]) -> bytes:
        if not tokens or max(tokens) < self.n:
            return array("i", tokens).tobytes()
        out = []
        for token in tokens:
            if token < self.n:
                out.append(token)
            else:
                out.extend(self.bytes[b] for b in chr(token - self.n).encode())
        return array("i", out).tobytes()

    def encode(self, text: str, framed: bool = True) -> bytes:
        """Ids of a whole text as 32-bit integers; an empty one has none but the frame."""
        body = b"".join(map(self.known.__getitem__, self.stretches.findall((self.prefix if text else "") + text.replace(" ", BLANK))))
        if not framed:
            return body
        return np.int32(self.begin).tobytes() + body + np.int32(self.finish).tobytes()

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> list[str]:
        """Texts of many rows, whose ids lie one after the other and end at ``ends`` (from 0)."""
        if not len(ids):
            return [""] * (len(ends) - 1)
        _, offsets, data = self.surfaces.take(pa.array(ids)).buffers()
        cuts, data = np.frombuffer(offsets, np.int32), memoryview(data or b"")
        showing = np.flatnonzero(~self.silent[ids])
        first, behind = np.searchsorted(showing, ends[:-1]).tolist(), np.searchsorted(showing, ends[1:]).tolist()
        out = []
        for i, (a, b) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist())):
            if first[i] == behind[i]:
                out.append("")
                continue
            start, last, shown = showing[first[i]], showing[behind[i] - 1], behind[i] - first[i]
            dropped = int(bool(self.prefix) and bool(self.opens[ids[start]]))
            try:
                # A control id within the row parts the bytes on its sides.
                whole = last - start + 1 == shown
                out.append(str(data[cuts[a] + dropped : cuts[b]], "utf-8") if whole else self._decode_parted(ids[a:b].tolist(), dropped))
            except UnicodeDecodeError:
                out.append(self._decode_parted(ids[a:b].tolist(), dropped))
        return out

    def _decode_parted(self, ids: list[int], dropped: int) -> str:
        """Each run of bytes on its own; a byte that starts no character is one replacement character."""
        out, run = [], bytearray()

        def settle() -> None:
            at = 0
            while at < len(run):
                for size in (1, 2, 3, 4):
                    try:
                        out.append(run[at : at + size].decode())
                    except UnicodeDecodeError:
                        continue
                    at += size
                    break
                else:
                    out.append("�")
                    at += 1
            run.clear()

        for number in ids:
            if number in self.byte_of:
                run.append(self.byte_of[number])
                continue
            settle()
            out.append(self.surfaces[number].as_py().decode())
        settle()
        return "".join(out)[dropped:]


@lru_cache(maxsize=2)
def piece_model(path: str) -> PieceModel:
    """One per Python worker."""
    with open(path, "rb") as file:
        return PieceModel(file.read())


def pieces_of(text: Column, path: str, packed: bool) -> Column:

    @F.arrow_udf(f"struct<n_tokens:bigint,ids:{'binary' if packed else 'array<int>'},decoded:string>")
    def encode_texts(texts: pa.Array) -> pa.Array:
        model = piece_model(path)
        each = [model.encode(text.as_py() or "") for text in texts]
        ends = np.cumsum([0, *(len(ids) // 4 for ids in each)])
        ids = np.frombuffer(b"".join(each), dtype=np.int32)
        if packed:
            rows = pa.array([np.frombuffer(e, np.int32).astype("<i4").tobytes() for e in each], pa.binary())
        else:
            rows = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids))
        decoded = pa.array(model.decode(ids, ends), pa.string())
        return pa.StructArray.from_arrays([pa.array(np.diff(ends), pa.int64()), rows, decoded], names=["n_tokens", "ids", "decoded"])

    return encode_texts(text)


def encode_pieces(
    docs: DataFrame, path: str | None = None, key: str = "doc_id", text: str = "text", packed: bool = False
) -> DataFrame:
    """``doc_id, n_tokens, ids, decoded``: piece ids of every whole text, begin and end included, and the text they stand for.

    ``path`` names a merge model with byte pieces that every executor can read. ``packed`` gives the ids as little-endian 32-bit
    integers instead of an array.

    Null or empty text has the ids of begin and end only. Rows are independent: null or repeated keys are kept as they are, an empty
    table gives no rows, other columns are left out. A text is held in one task, nothing else. The text comes back as it was, but
    for a U+2581 of its own, which decodes to a space.
    """
    path = path or public_tokenizers.path(MODEL)
    rows = docs.select(col(key).alias("doc_id"), pieces_of(col(text), path, packed).alias("e"))
    return rows.select("doc_id", "e.n_tokens", "e.ids", "e.decoded")
