"""SentencePiece encoding and decoding as shortest paths through a weighted transducer.

The normaliser (a blank is read as U+2581, and one blank is put in front), the pieces and the byte fallback are compiled
into one transducer: an arc reads a piece's characters and writes its id; a character that no piece has is read by an
arc that writes its bytes' ids. Composed with a text it is a lattice over text positions, whose shortest path
in the tropical semiring is the encoding; one uniform-cost search finds it, the farthest position first among equal costs. Weights: a unigram
model's arcs cost minus the piece's score. In a merge (BPE) model an arc costs 0 after the piece before it if merging
the two pieces' characters gives back just these two, else infinity; exactly one path has a finite cost, and each prefix of
it is the only finite path to its end, so positions are states enough. No piece has U+2581 after another character, so the
lattice falls apart at blanks; the paths of short stretches are kept, in a cache of bounded size.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_pass

BLANK = "▁"
_STRETCH = re.compile(f"[ {BLANK}]*[^ {BLANK}]+|[ {BLANK}]+")
#: stretches of up to _SHORT characters and pairs of pieces that are kept: under 100 MB a process in all
_CACHE, _PAIRS, _SHORT, _RARE = 400_000, 400_000, 32, 1e6


def _read(model: str):
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto()
    with open(model, "rb") as f:
        proto.ParseFromString(f.read())
    return proto


class Decoder:
    """Ids to text: what each id writes, and nothing else."""

    def __init__(self, model: str):
        proto = _read(model)
        self.prefix = proto.normalizer_spec.add_dummy_prefix
        self.out = [bytes([int(p.piece[3:5], 16)]) if p.type == 6 else b"" if p.type == 3 else b" \xe2\x81\x87 " if p.type == 2 else p.piece.replace(BLANK, " ").encode() for p in proto.pieces]

    def decode(self, ids: bytes) -> str:
        raw = b"".join(map(self.out.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        return (raw[1:] if self.prefix and raw[:1] == b" " else raw).decode("utf-8", "replace")


class Transducer(dict):
    """Stretches of text to ids (little-endian 32-bit). ``model`` is the path of a model file."""

    def __init__(self, model: str):
        super().__init__()
        proto = _read(model)
        spec = proto.normalizer_spec
        if spec.precompiled_charsmap or not spec.escape_whitespaces or proto.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only identity normalisers with leading blanks are compiled")
        self.prefix, self.squeeze = spec.add_dummy_prefix, spec.remove_extra_whitespaces
        self.merges = proto.trainer_spec.model_type == 2
        self.names = [p.piece for p in proto.pieces]
        plain = [(i, p) for i, p in enumerate(proto.pieces) if p.type in (1, 4)]
        self.ids = {p.piece: i for i, p in plain}
        self.score = {p.piece: p.score for _, p in plain}
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(proto.pieces) if p.type == 6}
        self.unk = proto.trainer_spec.unk_id
        self.whole = any(BLANK in p.lstrip(BLANK) for p in self.ids)
        self.fits: dict[int, dict[int, bool]] = {}
        self.n_fits = 0
        self.arcs = self.compile(self.ids)

    @staticmethod
    def compile(pieces: dict[str, int]) -> dict:
        """States that read normalised pieces from raw text: by character the next state and the id to write there, or -1."""
        start: dict = {}
        for piece, i in sorted(pieces.items()):
            state = start
            for at, c in enumerate(piece, 1):
                old = state.get(c, (None, -1))
                hit = ({} if old[0] is None else old[0], i if at == len(piece) else old[1])
                state[c] = hit
                if c == BLANK:
                    state[" "] = hit
                state = hit[0]
        return start

    def merged(self, text: str) -> list[str]:
        """Merge the best-scored neighbours, the leftmost first among equals, until none make a piece."""
        parts, score = list(text), self.score
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _follows(self, before: int, piece: int) -> bool:
        """May the arc of ``piece`` follow that of ``before`` (-1: the start, or a character read by fallback)?"""
        one, two = self.names[before] if before >= 0 else "", self.names[piece]
        known = self.merged(one + two) == ([one, two] if one else [two])
        self.n_fits += 1
        if self.n_fits > _PAIRS:
            self.fits.clear()
            self.n_fits = 0
        self.fits.setdefault(before, {})[piece] = known
        return known

    def _fallback(self, char: str) -> list[int]:
        return [self.bytes[b] for b in char.encode()] if self.bytes else [self.unk]

    def path(self, text: str) -> list[int]:
        """Ids on the shortest path through the lattice of one stretch."""
        n, arcs, merges = len(text), self.arcs, self.merges
        came: list[tuple[int, int] | None] = [None] * (n + 1)  # where the arc into a settled position begins, its piece
        queue = [(0.0, 0, 0, -1)]  # cost, minus the position, where the arc begins, its piece
        while queue:
            cost, i, start, before = heapq.heappop(queue)
            i = -i
            if came[i] is not None:
                continue
            came[i] = (start, before)
            if i == n:
                break
            state, j = arcs, i
            row = self.fits.get(before) or {}
            while j < n and (hit := state.get(text[j])) is not None:
                j += 1
                state, piece = hit
                if piece < 0 or came[j] is not None:
                    continue
                if not merges:
                    heapq.heappush(queue, (cost - self.score[self.names[piece]], -j, i, piece))
                elif self._follows(before, piece) if (ok := row.get(piece)) is None else ok:
                    heapq.heappush(queue, (cost, -j, i, piece))
            if j == i or not merges and came[i + 1] is None:
                heapq.heappush(queue, (cost + _RARE, -i - 1, i, -1))
        out: list[int] = []
        while n:
            start, piece = came[n]
            out += [piece] if piece >= 0 else self._fallback(text[start])[::-1]
            n = start
        return out[::-1]

    def __missing__(self, stretch: str) -> bytes:
        ids = np.array(self.path(stretch), "<u4").tobytes()
        if len(stretch) <= _SHORT:
            if len(self) >= _CACHE:
                self.clear()
            self[stretch] = ids
        return ids

    def encode(self, text: str | None) -> bytes:
        if self.squeeze:
            text = re.sub(" +", " ", (text or "").strip(" "))
        if not text:
            return b""
        text = " " + text if self.prefix else text
        if self.whole:
            return np.array(self.path(text), "<u4").tobytes()
        return b"".join(map(self.__getitem__, _STRETCH.findall(text)))


@lru_cache(2)
def transducer(model: str) -> Transducer:
    return Transducer(model)


@lru_cache(2)
def decoder(model: str) -> Decoder:
    return Decoder(model)


def default_model() -> str:
    import public_tokenizers as p

    return p.path("piece_bpe_32k.model")


def encode(docs: DataFrame, model: str | None = None, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """(doc_id, text, n_ids, ids): ids little-endian unsigned 32-bit; null and empty texts have none.

    With ``decoded`` the text that the ids spell follows, from the same pass. Texts are encoded whole, however long: memory is
    that of a batch and of the longest text with its ids. Rows are independent: repeated rows, null ids and an empty
    table need no care; other columns are ignored. A text that holds U+2581 itself does not come back: it is read as a blank.
    """
    model = model or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = transducer(model)
        back = decoder(model) if decoded else None
        for b in batches:
            ids = [coder.encode(x) for x in b.column(1).to_pylist()]
            cols = [b.column(0), b.column(1), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())]
            if back:
                cols.append(pa.array([back.decode(x) for x in ids], pa.string()))
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "text", "n_ids", "ids", "decoded"][: len(cols)])

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return arrow_pass(src, run, "doc_id long, text string, n_ids long, ids binary" + ", decoded string" * decoded)


def decode(encoded: DataFrame, model: str | None = None, ids_col: str = "ids") -> DataFrame:
    """Adds ``decoded``, the text that ``ids`` spell; null ids give null. A column of that name is replaced."""
    model = model or default_model()
    encoded = encoded.select(*(F.col(c) for c in encoded.columns if c != "decoded"))
    names = encoded.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        back = decoder(model)
        for b in batches:
            got = [None if x is None else back.decode(x) for x in b.column(names.index(ids_col)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(got, pa.string())], [*names, "decoded"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema)
    return arrow_pass(encoded, run, f"{fields}, decoded string")
