"""Encoding and decoding with a SentencePiece BPE model, equal to the library's.

The library merges, again and again, the neighbouring symbols whose concatenation is the piece of highest score, the
leftmost among equals. The encoder here finds that result without merging the text: a sequence of pieces is it if
and only if each two neighbours come out unchanged when their own text is merged by itself, since no merge of the
whole can be the first to cross a border that its two neighbours alone would not cross. So it walks the text by the longest
pieces (Aho-Corasick over reversed pieces and text, so that matches are told where they begin), tries shorter ones where a neighbour
is not compatible, steps back where none is, and marks positions from which every way failed in a bitfield, so that
none is tried twice. Compatibility is tested by merging the two pieces' text again and kept.

Texts are cut where no piece can span, between characters that no piece holds side by side, and each distinct
cut is encoded once while a worker's bounded store holds it. A character in no piece is written as its bytes. Decoding
gathers the pieces' bytes.

Models taken: BPE with byte fallback, an identity normalizer with the dummy prefix and escaped white space, and no user-defined or
unused pieces; others raise an error.

Defined cases: a null or empty text is the end id alone and decodes to an empty text; a null doc_id is kept; repeated
rows are encoded each; an empty table gives no rows; a text of any length is walked in one pass, without a copy
of its matches. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from editloom.llm.base import ship
from editloom.llm.text import buffers, slices, steps
from editloom.llm.tokens import PieceEncoder

SPACE, END_ID = "▁", 2
WINDOW, PAIRS = 1 << 15, 1 << 20
_NORMAL, _UNKNOWN, _CONTROL, _BYTE = 1, 2, 3, 6  # the format's types of pieces
_models: dict[str, SentenceModel] = {}


def model(path: str) -> SentenceModel:
    """One model a worker and file."""
    if path not in _models:
        _models[path] = SentenceModel(path)
    return _models[path]


class Merger:
    """Merge-type encoding of a string over scored pieces."""

    def __init__(self, scores: dict[str, float]) -> None:
        import ahocorasick

        self.scores, self.longest = scores, max(map(len, scores), default=1)
        self.automaton = ahocorasick.Automaton()
        for piece in scores:
            self.automaton.add_word(piece[::-1], piece)
        self.automaton.make_automaton()
        self.shorter: dict[str, str | None] = {}
        self.pairs: dict[tuple[str, str], bool] = {}

    def merged(self, text: str) -> list[str]:
        """The pieces of a short text by merging."""
        parts, score = list(text), self.scores.get
        while len(parts) > 1:
            best, at = None, 0
            for i in range(len(parts) - 1):
                s = score(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def compatible(self, left: str, right: str) -> bool:
        key = left, right
        found = self.pairs.get(key)
        if found is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            found = self.pairs[key] = self.merged(left + right) == [left, right]
        return found

    def prefix(self, piece: str) -> str | None:
        """The longest piece, or else the single character, that ``piece`` begins with and is longer than."""
        if piece not in self.shorter:
            cut = next((piece[:n] for n in range(len(piece) - 1, 0, -1) if n == 1 or piece[:n] in self.scores), None)
            if len(self.shorter) >= PAIRS:
                self.shorter.clear()
            self.shorter[piece] = cut
        return self.shorter[piece]

    def matches(self, text: str) -> list[str]:
        """The longest piece that begins at each place, or the character there."""
        n, out = len(text), list(text)
        for end, piece in self.automaton.iter(text[::-1]):
            at = n - 1 - end
            if len(piece) > len(out[at]):
                out[at] = piece
        return out

    def encode(self, text: str) -> list[str]:
        """The pieces of ``text``; characters in no piece stand by themselves."""
        n, out, at = len(text), [], 0
        failed = bytearray(n // 8 + 1)
        begin, found = 0, self.matches(text[: WINDOW + self.longest])[:WINDOW]
        token = found[0] if n else None
        while token is not None:
            last = out[-1] if out else None
            while True:
                end = at + len(token)
                fits = self.compatible(last, token) if last is not None else len(token) == 1 or self.merged(token) == [token]
                if fits and not failed[end >> 3] >> (end & 7) & 1:
                    out.append(token)
                    at = end
                    if at == n:
                        return out
                    if at >= begin + WINDOW:
                        begin, found = at, self.matches(text[at : at + WINDOW + self.longest])[:WINDOW]
                    # Where it stepped back over a window's begin, the match is looked up by itself.
                    token = found[at - begin] if at >= begin else self.matches(text[at : at + self.longest])[0]
                    break
                token = self.prefix(token)
                if token is None:
                    failed[at >> 3] |= 1 << (at & 7)
                    token = out.pop()
                    at -= len(token)
                    break
        return out


class SentenceModel(PieceEncoder):
    """Pieces of a model file, with the store of encoded cuts of ``PieceEncoder``."""

    def __init__(self, path: str) -> None:
        from sentencepiece import sentencepiece_model_pb2

        told = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            told.ParseFromString(f.read())
        kinds, form = {p.type for p in told.pieces}, told.normalizer_spec
        if told.trainer_spec.model_type != told.trainer_spec.BPE or not told.trainer_spec.byte_fallback or kinds - {_NORMAL, _UNKNOWN, _CONTROL, _BYTE}:
            raise ValueError(f"{path} is no BPE model with byte fallback and normal pieces alone")
        if form.precompiled_charsmap or form.remove_extra_whitespaces or not form.add_dummy_prefix or not form.escape_whitespaces or told.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError(f"{path} normalizes texts otherwise than by a leading space")
        self.ids = {p.piece: i for i, p in enumerate(told.pieces) if p.type == _NORMAL}
        self.of_byte = {int(p.piece[3:5], 16): i for i, p in enumerate(told.pieces) if p.type == _BYTE}
        self.merger = Merger({p.piece: p.score for p in told.pieces if p.type == _NORMAL})
        self.dtype = np.dtype("<u2") if len(told.pieces) <= 1 << 16 else np.dtype("<u4")
        self.cuts, self.fold, self.added = True, False, []
        surface = {_CONTROL: lambda p: b"", _UNKNOWN: lambda p: told.trainer_spec.unk_surface.encode(), _BYTE: lambda p: bytes([int(p[3:5], 16)])}
        self.surface = [surface.get(p.type, lambda p: p.replace(SPACE, " ").encode())(p.piece) for p in told.pieces]
        self.decimal = [str(i).encode() for i in range(len(told.pieces))]
        self.is_byte = np.array([p.type == _BYTE for p in told.pieces])
        self.is_control = np.array([p.type == _CONTROL for p in told.pieces])
        self.leads = np.array([p.type == _NORMAL and p.piece.startswith(SPACE) for p in told.pieces])
        # Which ASCII characters stand side by side in a piece, and whether a space does after another character.
        self.beside, self.inner = np.zeros((256, 256), bool), False
        for piece in self.ids:
            for x, y in zip(piece, piece[1:]):
                x, y = x.replace(SPACE, " "), y.replace(SPACE, " ")
                self.inner |= y == " " and x != " "
                if ord(x) < 0x80 and ord(y) < 0x80:
                    self.beside[ord(x), ord(y)] = True
        self._clear()

    def _lists(self, pieces: list[bytes]) -> list[list[int]]:
        out = []
        for p in pieces:
            ids: list[int] = []
            for token in self.merger.encode(p.decode("utf-8", "replace").replace(" ", SPACE)):
                found = self.ids.get(token)
                if found is not None:
                    ids.append(found)
                else:
                    ids.extend(self.of_byte[b] for b in token.encode())
            out.append(ids)
        return out

    def _starts(self, raw: np.ndarray, off: np.ndarray) -> np.ndarray:
        begin = np.zeros(len(raw), bool)
        plain = raw < 0x80
        begin[1:] = plain[1:] & plain[:-1] & ~self.beside[raw[:-1], raw[1:]]
        if not self.inner:  # the last byte of U+2581, which stands for a space too, is 0x81
            begin[1:] |= (raw[1:] == 0x20) & ~plain[:-1] & (raw[:-1] != 0x81)
        begin[off[:-1][off[:-1] < len(raw)]] = True
        return np.flatnonzero(begin)

    def encode(self, column: pa.Array) -> list[np.ndarray]:
        """The ids of each text; a null text has none."""
        raw, off = buffers(column)
        out: list[np.ndarray] = []
        for a, b in slices(off):
            part, rel = raw[off[a] : off[b]], off[a : b + 1] - off[a]
            full = np.diff(rel) > 0
            led = np.insert(part, rel[:-1][full], 0x20)  # the leading space of each text
            out += self._slice(led, rel + np.concatenate([[0], np.cumsum(full)]))
        return out

    def decode(self, ids: np.ndarray) -> str:
        """The text of ``ids``: without the first space, with U+FFFD for each byte that is none of a character."""
        real = np.flatnonzero(~self.is_control[ids])
        if not len(real):
            return ""
        ids = ids[real[0] : real[-1] + 1]
        whole = b"".join(map(self.surface.__getitem__, ids.tolist()))
        try:
            if len(real) < len(ids):  # a control piece ends a run of bytes
                raise ValueError
            text = whole.decode()
        except ValueError:
            edges = np.flatnonzero(np.diff(self.is_byte[ids].astype(np.int8))) + 1
            text = "".join(_mended(b"".join(map(self.surface.__getitem__, run.tolist()))) for run in np.split(ids, edges))
        return text[1:] if self.leads[ids[0]] else text


def _mended(raw: bytes) -> str:
    out, at = [], 0
    while at < len(raw):
        for n in range(1, 5):
            try:
                out.append(raw[at : at + n].decode())
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            n = 1
        at += n
    return "".join(out)


def _each(docs: DataFrame, model_file: str, end_id: int | None, schema: str, tell: Callable[[SentenceModel, np.ndarray], tuple]) -> DataFrame:
    """doc_id and what ``tell`` makes of a text's ids."""
    from pyspark.sql.pandas.types import to_arrow_schema

    ship(docs.sparkSession)
    arrow = to_arrow_schema(T._parse_datatype_string(schema))
    end = [] if end_id is None else [end_id]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = model(model_file)
        for batch in steps(batches, 512):
            rows = [tell(held, np.append(ids, np.array(end, held.dtype))) for ids in held.encode(batch.column(1))]
            columns = [pa.array(c, f.type) for c, f in zip(zip(*rows), list(arrow)[1:])] if rows else [pa.array([], f.type) for f in list(arrow)[1:]]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], schema=arrow)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def encoded(docs: DataFrame, model_file: str, end_id: int | None = END_ID) -> DataFrame:
    """doc_id, ids of each row's ``text``, with ``end_id`` behind them."""
    return _each(docs, model_file, end_id, "doc_id long, ids array<int>", lambda held, ids: (ids,))


def decoded(rows: DataFrame, model_file: str) -> DataFrame:
    """doc_id, text of each row's ``ids``; null ids give a null text."""
    ship(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = model(model_file)
        for batch in steps(batches, 512):
            texts = [None if ids is None else held.decode(np.array(ids, np.int64)) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return rows.select(F.col("doc_id").cast("long"), F.col("ids").cast("array<int>")).mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, model_file: str, end_id: int | None = END_ID) -> DataFrame:
    """doc_id, n_tokens, and digests of the ids and of the text that they decode to, in one pass."""

    def tell(held: SentenceModel, ids: np.ndarray) -> tuple:
        told = b" ".join(map(held.decimal.__getitem__, ids.tolist()))
        return len(ids), sha256(told).hexdigest(), sha256(held.decode(ids).encode()).hexdigest()

    return _each(docs, model_file, end_id, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", tell)


def op12_sentencepiece(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("piece_bpe_32k.model"))
