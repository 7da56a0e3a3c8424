"""Operator 13: alignment of two tokenizers' tokens, by DuckDB in each Arrow batch.

A text with a space before it is cut into segments at spaces after a visible character: neither tokenizer's tokens
cross such a place, so equal segments have equal tokens. The distinct segments of a chunk (a run of whole texts of
bounded bytes) are laid end to end; DuckDB holds both tokenizers' tokens as tables of intervals on this line:

* links: an ASOF join finds the B token under each A token's first byte, a range join those that begin inside it;
* groups: offsets at which both have an end are cuts, and a window sum over the cuts numbers the groups;
* partial counts: how many links of the chunk hold an id pair, every segment taken as often as it occurs.

Spark sums the partial counts, marks the best of each B id, and brings the sums back to the chunks (one row for each
chunk and pair of it), where the links of each document are added up. The chunks wait as rows of a staged table, so no
text is encoded twice, and nothing is broadcast.

Defined results: a null or empty text has no tokens, nor has one whose joined token bytes differ from the text with a
space before it (U+2581 does this); special tokens' strings are plain text; identifiers may be null or repeat, for
each row is its own document; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verigate.llm.common import discard, frugal, staged, text_runs
from verigate.llm.tokens import TokenEncoder, encoder

#: Bytes of text in a chunk, or one longer text.
CHUNK_BYTES = 2 << 20
SPACE = "▁"


def _alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: itself where it is printable Latin-1, else
    the characters from U+0100 on, in order of the bytes."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in own)}


class Pair:
    """Both tokenizers, with the bytes of each id."""

    def __init__(self, path_a: str, path_b: str, pattern: str | None):
        import sentencepiece

        self.a: TokenEncoder = encoder(path_a, pattern)
        alphabet = _alphabet()
        of = self.a.library.id_to_token
        self.bytes_a = [bytes(alphabet.get(c, 63) for c in of(k) or "") for k in range(self.a.vocabulary)]
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        ids = range(self.b.get_piece_size())
        pieces = [self.b.id_to_piece(k) for k in ids]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(k) else p.replace(SPACE, " ").encode() for k, p in zip(ids, pieces, strict=True)]
        self.splits = self.a.exact is not None and not any(SPACE in p.lstrip(SPACE) for p in pieces)
        self.alone = [self.b.piece_to_id(SPACE)]
        self.size_a, self.size_b = (np.array([len(x) for x in t], dtype=np.int64) for t in (self.bytes_a, self.bytes_b))

    def encode_b(self, segments: list[str]) -> list[list[int]]:
        """Ids of segments, whose first space the library puts there itself, but for a space that stands alone."""
        return [ids or self.alone for ids in self.b.encode([s[1:] for s in segments], num_threads=1)]


@cache
def _pair(path_a: str, path_b: str, pattern: str | None) -> Pair:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Pair(path_a, path_b, pattern)


@cache
def _database():
    import duckdb

    # bounded by the chunk, so it needs no folder to spill to
    return duckdb.connect(":memory:", config={"threads": 1, "temp_directory": "", "preserve_insertion_order": False})


def _spaced(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts of a run with a space before each that isn't empty."""
    size = np.diff(starts)
    new = np.append(0, np.cumsum(size + (size > 0)))
    out = np.full(int(new[-1]), 32, dtype=np.uint8)
    keep = np.ones(len(out), dtype=bool)
    keep[new[:-1][size > 0]] = False
    out[keep] = data
    return out, new


def segment_starts(data: np.ndarray, starts: np.ndarray, splits: bool) -> np.ndarray:
    """Where segments begin: at texts, and at a space after a character that isn't white space."""
    begin = np.zeros(len(data) + 1, dtype=bool)
    if splits and len(data) > 3:
        at = np.flatnonzero(data[1:] == 32) + 1
        one = data[at - 1]
        two, three = data[np.maximum(at - 2, 0)], data[np.maximum(at - 3, 0)]
        wide = ((two == 0xC2) & ((one == 0x85) | (one == 0xA0))) | ((three == 0xE1) & (two == 0x9A) & (one == 0x80)) | ((three == 0xE3) & (two == 0x80) & (one == 0x80))
        wide |= (three == 0xE2) & (((two == 0x80) & ((one <= 0x8A) | (one == 0xA8) | (one == 0xA9) | (one == 0xAF))) | ((two == 0x81) & (one == 0x9F)))
        begin[at[(one > 32) & ~wide]] = True
    begin[starts[:-1][np.diff(starts) > 0]] = True
    return np.flatnonzero(begin[:-1])


_LINKS = """
CREATE OR REPLACE TEMP TABLE links AS
SELECT a.seg, a.id AS a, b.id AS b FROM ta a ASOF JOIN tb b ON a.s >= b.s
UNION ALL
SELECT a.seg, a.id, b.id FROM ta a JOIN (SELECT id, s FROM tb ANTI JOIN ta USING (s)) b ON b.s > a.s AND b.s < a.e
"""
_GROUPS = """
WITH ends AS (SELECT e, (count(*) = 2)::INT AS cut FROM (SELECT e FROM ta UNION ALL SELECT e FROM tb) GROUP BY e),
g AS (SELECT e, sum(cut) OVER (ORDER BY e) - cut AS g FROM ends),
t AS (SELECT seg, 0 AS side, k, id, e FROM ta UNION ALL SELECT seg, 1, k, id, e FROM tb)
SELECT seg, g::BIGINT AS g, side, id FROM t JOIN g USING (e) ORDER BY g, side, k
"""
_PAIRS = "CREATE OR REPLACE TEMP TABLE pairs AS SELECT a, b, n, row_number() OVER () - 1 AS p FROM (SELECT a, b, sum(m)::BIGINT AS n FROM links JOIN times USING (seg) GROUP BY a, b)"


class Chunk:
    """The alignment of the texts of a run: per text seg (its segments), n_a, n_b, n_groups, n_links; per segment its
    groups as text and its links; the chunk's id pairs with their numbers of links."""

    def __init__(self, pair: Pair, data: np.ndarray, starts: np.ndarray):
        line, heads = _spaced(data, starts)
        begin = segment_starts(line, heads, pair.splits)
        n = len(starts) - 1
        column = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(np.append(begin, len(line)).astype(np.int64)), pa.py_buffer(line)])
        coded = column.dictionary_encode()
        raw = coded.dictionary.to_pylist()
        words = [x.decode() for x in raw]
        self.n_seg = len(raw)
        self.of_text = np.searchsorted(begin, heads)  # segments of text i: seg[of_text[i] : of_text[i + 1]]
        self.seg = coded.indices.to_numpy().astype(np.int64)
        tokens = {}
        ids_a, ids_b = pair.a.encode(words), pair.encode_b(words)
        many_a, many_b = (np.fromiter(map(len, x), np.int64, len(x)) for x in (ids_a, ids_b))
        flat_a = np.frombuffer(b"".join(ids_a), "<u4").astype(np.int64)
        flat_b = np.fromiter(chain.from_iterable(ids_b), np.int64, int(many_b.sum()))
        for name, many, flat, table in (("a", many_a // 4, flat_a, pair.bytes_a), ("b", many_b, flat_b, pair.bytes_b)):
            tokens[name] = many, flat, list(map(table.__getitem__, flat.tolist()))
        del ids_a, ids_b
        good = np.ones(len(raw), dtype=bool)
        for many, _, given in tokens.values():
            if b"".join(given) != b"".join(raw):
                ends = np.cumsum(many).tolist()
                good &= np.fromiter((b"".join(given[lo:hi]) == r for lo, hi, r in zip([0, *ends], ends, raw, strict=False)), bool, len(raw))
        tokens = {name: t[:2] for name, t in tokens.items()}
        text = np.repeat(np.arange(n), np.diff(self.of_text))
        self.whole = np.bincount(text[~good[self.seg]], minlength=n) == 0  # texts whose bytes both tokenizers give back
        del words, raw
        times = np.bincount(self.seg[self.whole[text]], minlength=self.n_seg)
        used = np.flatnonzero(times)
        db = _database()
        self.count = {}
        for name, sizes in (("a", pair.size_a), ("b", pair.size_b)):
            many, flat = tokens[name]
            flat = flat[np.repeat(times > 0, many)]
            self.count[name] = np.where(times > 0, many, 0)
            size = sizes[flat]
            ends = np.cumsum(size)  # the segments lie end to end, and their tokens fill them
            db.register(f"t{name}", pa.table({"seg": np.repeat(used, many[used]), "k": np.arange(len(flat)), "id": flat, "s": ends - size, "e": ends}))
        db.register("times", pa.table({"seg": used, "m": times[used]}))
        db.execute(_LINKS)
        self._take_groups(db.sql(_GROUPS).to_arrow_table().combine_chunks())
        db.execute(_PAIRS)
        self.pairs = db.sql("SELECT p, a, b, n FROM pairs ORDER BY p").to_arrow_table()
        links = db.sql("SELECT seg, p FROM links JOIN pairs USING (a, b) ORDER BY seg").to_arrow_table()
        self.links = links["p"].to_numpy()
        self.of_seg = np.append(0, np.cumsum(np.bincount(links["seg"].to_numpy(), minlength=self.n_seg)))
        db.execute("DROP TABLE links; DROP TABLE pairs")
        for name in ("ta", "tb", "times"):
            db.unregister(name)

    def _take_groups(self, rows: pa.Table) -> None:
        """From the tokens (seg, g, side, id), those of a group together and A's first, each segment's text."""
        seg, g, side = (rows[c].to_numpy() for c in ("seg", "g", "side"))
        first = np.ones(len(seg), dtype=bool)
        first[1:] = seg[1:] != seg[:-1]
        mark = np.where(np.append(True, side[1:] == side[:-1]) if len(seg) else side > 1, ",", "|")
        fresh = np.append(True, g[1:] != g[:-1]) if len(g) else side > 1
        self.groups = np.bincount(seg[fresh], minlength=self.n_seg)
        mark = np.where(first, "", np.where(fresh, ";", mark))
        parts = pc.binary_join_element_wise(pa.array(mark), rows["id"].cast(pa.string()).combine_chunks(), "")
        head = np.flatnonzero(first)
        lists = pa.LargeListArray.from_arrays(pa.array(np.append(head, len(seg))), parts)
        self.texts = [""] * self.n_seg
        for k, t in zip(seg[head].tolist(), pc.binary_join(lists, "").to_pylist(), strict=True):
            self.texts[k] = t

    def sums(self, per_segment: np.ndarray) -> np.ndarray:
        """Of each text, the sum of a value of its segments; 0 for texts without tokens."""
        total = np.append(0, np.cumsum(per_segment[self.seg]))
        return np.where(self.whole, total[self.of_text[1:]] - total[self.of_text[:-1]], 0)

    def group_text(self, i: int) -> str:
        own = self.seg[self.of_text[i] : self.of_text[i + 1]].tolist() if self.whole[i] else ()
        return ";".join(map(self.texts.__getitem__, own))

    def stats(self) -> list[np.ndarray]:
        return [self.sums(x) for x in (self.count["a"], self.count["b"], self.groups, np.diff(self.of_seg))]


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))


def _chunks(pair: Pair, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, Chunk]]:
    for b in batches:
        for lo, rows, data, starts in text_runs(b, "text", CHUNK_BYTES):
            yield b.column(0).slice(lo, rows), Chunk(pair, data, starts)


def align(docs: DataFrame, path_a: str, path_b: str, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the groups of every whole text, as text: ``a1,a2|b1;a3|b2,b3``, ids of A and B in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, chunk in _chunks(_pair(path_a, path_b, pattern), batches):
            yield pa.RecordBatch.from_arrays([ids, pa.array([chunk.group_text(i) for i in range(len(ids))], pa.string())], ["doc_id", "groups"])

    return _rows(docs, id_col, text_col).mapInArrow(frugal(run), "doc_id long, groups string")


def _packed(**columns) -> bytes:
    table = pa.table(columns)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpacked(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all().combine_chunks()


_STATS = ["n_a", "n_b", "n_groups", "n_links"]
_HELD = ["docs", "segs", "sizes", "links"]
_CHUNK = "chunk long, p int, a int, b int, n long, docs binary, segs binary, sizes binary, links binary"


def partial_counts(docs: DataFrame, path_a: str, path_b: str, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The chunks as a staged table: rows (chunk, p, a, b, n) for the id pairs of a chunk, and one row for the chunk
    itself with its documents, their segments, and the segments' links as numbers p, compressed."""
    kinds = pa.schema([("chunk", pa.int64()), ("p", pa.int32()), ("a", pa.int32()), ("b", pa.int32()), ("n", pa.int64()), *[(c, pa.binary()) for c in _HELD]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = TaskContext.get().partitionId() << 32
        for ids, c in _chunks(_pair(path_a, path_b, pattern), batches):
            stats = c.stats()
            some = stats[0] > 0
            sha = [hashlib.sha256(c.group_text(i).encode()).hexdigest() if some[i] else "" for i in range(len(ids))]
            size = np.where(c.whole, np.diff(c.of_text), 0)
            held = {
                "docs": _packed(doc_id=ids, **dict(zip(_STATS, stats, strict=True)), sha=pa.array(sha, pa.string()), size=size),
                "segs": _packed(seg=c.seg[np.repeat(c.whole, np.diff(c.of_text))].astype(np.uint32)),
                "sizes": _packed(size=np.diff(c.of_seg).astype(np.uint32)),
                "links": _packed(p=c.links.astype(np.uint32)),
            }
            yield pa.RecordBatch.from_pylist([{"chunk": own, **held}], schema=kinds)
            n = c.pairs.num_rows
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, own)), *[c.pairs[x].cast(kinds.field(x).type).combine_chunks() for x in ("p", "a", "b", "n")], *[pa.nulls(n, pa.binary())] * len(_HELD)], schema=kinds)
            own += 1

    return staged(_rows(docs, id_col, text_col).mapInArrow(frugal(run), _CHUNK), "aligned")


def pair_counts(chunks: DataFrame) -> DataFrame:
    """a, b, total (links of the pair in all documents), best (no other A id has more with this B id)."""
    totals = chunks.where("p is not null").groupBy("a", "b").agg(F.sum("n").alias("total"))
    most = totals.groupBy("b").agg(F.max("total").alias("most"))
    return totals.join(most, "b").select("a", "b", "total", (F.col("total") == F.col("most")).alias("best"))


def _added(held: pa.Table, counts: pa.Table) -> pa.Table:
    """The documents of a chunk with the sums over their links."""
    docs, segs, sizes, links = (_unpacked(held[c][0].as_py()) for c in _HELD)
    n = int(counts.num_rows)
    columns = []
    for name in ("best", "total"):
        of_pair = np.zeros(n, np.int64)
        of_pair[counts["p"].to_numpy()] = counts[name].to_numpy()
        of_link = np.append(0, np.cumsum(of_pair[links["p"].to_numpy()]))
        last = np.cumsum(sizes["size"].to_numpy().astype(np.int64))
        of_seg = of_link[last] - of_link[last - sizes["size"].to_numpy()]
        of_doc = np.append(0, np.cumsum(of_seg[segs["seg"].to_numpy()]))
        last = np.cumsum(docs["size"].to_numpy())
        columns.append(of_doc[last] - of_doc[last - docs["size"].to_numpy()])
    return pa.table([*[docs[c] for c in ("doc_id", *_STATS)], *map(pa.array, columns), docs["sha"]], ["doc_id", *_STATS, "n_best", "count_sum", "groups_sha256"])


def digests(docs: DataFrame, path_a: str, path_b: str, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    chunks = partial_counts(docs, path_a, path_b, pattern, id_col, text_col)
    counts = pair_counts(chunks)
    of_chunk = chunks.where("p is not null").select("chunk", "p", "a", "b").join(counts, ["a", "b"]).select(F.col("chunk").alias("of"), "p", "total", F.col("best").cast("long").alias("best"))
    held = chunks.where("p is null").select("chunk", *_HELD)
    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    out = staged(held.groupBy("chunk").cogroup(of_chunk.groupBy("of")).applyInArrow(_added, schema), "digests")
    discard(chunks)
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op13: every whole text by byte_bpe_50k (A) and piece_bpe_32k (B)."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return digests(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.PATTERN)
