"""Operator 2: SentencePiece encoding and decoding.

The pieces of a public vocabulary file form an Aho-Corasick automaton. One pass over the text reports, at each
position, the pieces that end there (the state's own and, along the output links, its suffixes, longest first);
each relaxes the best score of its end from that of its start. Following the winners back gives the ids. A
character that no piece of length one covers costs the unknown score and becomes its bytes' pieces.

The vocabulary's scores are taken as log-probabilities, so this is the unigram segmentation over the file's pieces
whatever kind of model the file was made as. Where no piece has the space mark after another character, a text
falls into segments at space marks that the best path never crosses; segments are remembered.

Defined results: null and empty texts have no ids; a text's own space marks (U+2581) come back as spaces;
repeated rows give equal results; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import array
import hashlib
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


SPACE, UNKNOWN_PENALTY = "▁", 10.0
MEMO, LONGEST = 400_000, 48
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a protocol-buffer message."""

    def varint(at: int) -> tuple[int, int]:
        n = shift = 0
        while True:
            b = data[at]
            n |= (b & 127) << shift
            at, shift = at + 1, shift + 7
            if b < 128:
                return n, at

    at = 0
    while at < len(data):
        tag, at = varint(at)
        kind = tag & 7
        if kind == 0:
            value, at = varint(at)
        elif kind == 2:
            n, at = varint(at)
            value, at = data[at : at + n], at + n
        else:
            n = 8 if kind == 1 else 4
            value, at = data[at : at + n], at + n
        yield tag >> 3, value


@dataclass
class Vocabulary:
    pieces: list[str]
    scores: list[float]
    kinds: list[int]
    dummy_prefix: bool = True
    one_space: bool = True

    @classmethod
    def read(cls, path: str) -> Vocabulary:
        out = cls([], [], [])
        with open(path, "rb") as f:
            for number, value in _fields(f.read()):
                if number == 1:
                    piece = dict(_fields(value))
                    out.pieces.append(piece[1].decode())
                    out.scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
                    out.kinds.append(piece.get(3, NORMAL))
                elif number == 3:
                    spec = dict(_fields(value))
                    if spec.get(2):
                        raise ValueError("vocabularies with a character map aren't supported")
                    out.dummy_prefix, out.one_space = bool(spec.get(3, 1)), bool(spec.get(4, 1))
        return out


class Segmenter:
    def __init__(self, vocabulary: Vocabulary):
        import ahocorasick

        self.v = vocabulary
        self.automaton = ahocorasick.Automaton()
        normal = [s for s, k in zip(vocabulary.scores, vocabulary.kinds, strict=True) if k == NORMAL]
        self.unknown = min(normal) - UNKNOWN_PENALTY
        top = max(normal)
        for i, (p, s, k) in enumerate(zip(vocabulary.pieces, vocabulary.scores, vocabulary.kinds, strict=True)):
            if k in (NORMAL, USER) and p:
                self.automaton.add_word(p, (i, len(p), s if k == NORMAL else len(p) * top - 0.1))
        self.automaton.make_automaton()
        self.byte = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(vocabulary.pieces, vocabulary.kinds, strict=True)) if k == BYTE}
        self.unk_id = vocabulary.kinds.index(UNKNOWN)
        cuts = not any(k in (NORMAL, USER) and re.search(f"[^{SPACE}]{SPACE}", p) for p, k in zip(vocabulary.pieces, vocabulary.kinds, strict=True))
        self.find = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+").findall if cuts else lambda t: [t]
        self.memo: dict[str, bytes] = {}
        self.out = [bytes([int(p[3:5], 16)]) if k == BYTE else b"" if k == CONTROL else p.encode() for p, k in zip(vocabulary.pieces, vocabulary.kinds, strict=True)]

    def best_path(self, text: str) -> list[int]:
        """Viterbi over one segment: ids, -1 - code point for a character without a piece."""
        n, floor = len(text), -1e300
        best, back = [0.0] + [floor] * n, [(-1, 0)] * (n + 1)
        done, covered = 0, False  # ends up to ``done`` are final; did a piece of length one end at done + 1?
        for last, (piece, size, score) in self.automaton.iter(text):
            end = last + 1
            while done < end - 1:
                self._close(best, back, done, covered, text)
                done, covered = done + 1, False
            s = best[end - size] + score
            if s > best[end]:
                best[end], back[end] = s, (piece, size)
            covered = covered or size == 1
        while done < n:
            self._close(best, back, done, covered, text)
            done, covered = done + 1, False
        out, at = [], n
        while at > 0:
            piece, size = back[at]
            out.append(piece)
            at -= size
        return out[::-1]

    def _close(self, best: list[float], back: list[tuple[int, int]], done: int, covered: bool, text: str) -> None:
        if not covered:
            s = best[done] + self.unknown
            if s > best[done + 1]:
                best[done + 1], back[done + 1] = s, (-1 - ord(text[done]), 1)

    def _segment(self, text: str) -> bytes:
        ids, was_unknown = array.array("I"), False
        for p in self.best_path(text):
            if p >= 0:
                ids.append(p)
            elif self.byte:
                ids.extend(self.byte[b] for b in chr(-1 - p).encode())
            elif not was_unknown:  # a run of unknown characters is one unknown piece
                ids.append(self.unk_id)
            was_unknown = p < 0
        return ids.tobytes()

    def encode(self, text: str) -> bytes:
        """The ids of a text, little-endian 32-bit."""
        if self.v.one_space:
            text = re.sub(" +", " ", text.strip(" "))
        if not text:
            return b""
        text = (SPACE if self.v.dummy_prefix else "") + text.replace(" ", SPACE)
        words = self.find(text)
        memo = self.memo
        for w in set(words).difference(memo):
            memo[w] = self._segment(w)
        out = b"".join(map(memo.__getitem__, words))
        if len(memo) > MEMO:
            memo.clear()
        else:
            for w in words:
                if len(w) > LONGEST:
                    memo.pop(w, None)
        return out

    def decode(self, ids: bytes) -> str:
        text = b"".join(map(self.out.__getitem__, array.array("I", ids))).decode("utf-8", "replace").replace(SPACE, " ")
        return text[1:] if self.v.dummy_prefix and text.startswith(" ") else text


_segmenters: dict[str, Segmenter] = {}


def segmenter(path: str) -> Segmenter:
    if path not in _segmenters:
        _segmenters[path] = Segmenter(Vocabulary.read(path))
    return _segmenters[path]


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids (binary, little-endian 32-bit) of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = segmenter(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([enc.encode(t or "") for t in b.column(1).to_pylist()], pa.binary())], ["doc_id", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, ids binary")


def decode_documents(ids: DataFrame, path: str) -> DataFrame:
    """doc_id and text from doc_id and ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = segmenter(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([enc.decode(x) for x in b.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    return ids.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """Per document, from one encoding and its decoding: n_tokens, ids_crc32, decoded_sha256, round_trip."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = segmenter(path)
        names, kinds = ["doc_id", "n_tokens", "ids_crc32", "decoded_sha256", "round_trip"], [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_()]
        for b in batches:
            out = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = enc.encode(text or "")
                back = enc.decode(ids)
                out.append((doc_id, len(ids) // 4, zlib.crc32(ids), hashlib.sha256(back.encode()).hexdigest(), back == (text or "")))
            columns = list(zip(*out, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_crc32 long, decoded_sha256 string, round_trip boolean")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: every whole text encoded and decoded."""
    import public_tokenizers

    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("piece_bpe_32k.model"))
