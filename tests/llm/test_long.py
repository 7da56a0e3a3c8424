"""Texts of a million characters, with and without spaces and lines, through the operators; against plain code."""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections import Counter

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from verigate.llm import bytecnn, linededup, lzprint, minhash, packing, pieces, sharding, suffixes

BPE = public_tokenizers.path("byte_bpe_50k.json")
LINE = "A line of forty and more characters that many documents hold. "
WORDS = " ".join(f"word{i * i % 99_991}" for i in range(90_000))
TEXTS = ["x" * 1_000_000, WORDS, WORDS.replace("word1 ", "other ", 1), (LINE + "\n") * 16_000, *[f"{LINE}\nown {i}" for i in range(6)], "é" * 300_000 + " end", None, ""]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(TEXTS)], "doc_id long, text string, lang string, source string, n_chars long").repartition(4).cache()


def test_line_dedup(docs):
    key = lambda line: re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\v\f\r"))
    held: dict = {}
    for i, t in enumerate(TEXTS):
        for line in (t or "").split("\n"):
            held.setdefault(key(line), set()).add(i)
    want = {}
    for i, t in enumerate(TEXTS):
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(key(x)) >= 40 and len(held[key(x)]) >= 5 and i != max(held[key(x)]))]
        want[i] = hashlib.sha256("\n".join(kept).encode()).hexdigest()
    out = linededup.apply_bitmaps(docs, linededup.keep_bitmaps(docs), counts=None)
    assert {r.doc_id: hashlib.sha256((r.text or "").encode()).hexdigest() for r in out.select("doc_id", "text").collect()} == want


def test_near_duplicates(docs):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(docs, 85).collect()}
    words = [(t or "").lower().split() for t in TEXTS]
    sizes = [len({tuple(w[k : k + 5]) for k in range(len(w) - 4)}) if len(w) >= 5 else int(bool(w)) for w in words]
    assert [got[i][0] for i in range(len(TEXTS))] == sizes
    assert got[1][1] == got[2][1] == 1 and got[0][1] == 0 and got[3][1] == 3


def test_packing_and_pieces(docs):
    tok = Tokenizer.from_file(BPE)
    tok.encode_special_tokens = True
    rows = packing.pack(docs, BPE, public_tokenizers.PATTERN).collect()
    own: dict = {}
    for r in rows:
        own.setdefault(r.doc_id, []).append(r)
    for i in (0, 1, 3, 10, 11, 12):
        ids = tok.encode(TEXTS[i] or "", add_special_tokens=False).ids + [2]
        parts = sorted(own[i], key=lambda r: r.piece)
        assert [r.start for r in parts] == [sum(p.length for p in parts[:k]) for k in range(len(parts))] and sum(r.length for r in parts) == len(ids)
        assert all(zlib.crc32(struct.pack(f"<{r.length}I", *ids[r.start : r.start + r.length])) == r.ids_crc32 for r in parts)
    filled = Counter()
    for r in rows:
        filled[r.sequence_id] += r.length
    assert max(filled.values()) <= packing.LENGTH


def test_segmentation_round_trip(docs):
    out = pieces.digests(docs, public_tokenizers.path("piece_bpe_32k.model")).collect()
    assert all(r.round_trip for r in out) and all(r.decoded_sha256 == hashlib.sha256((TEXTS[r.doc_id] or "").encode()).hexdigest() for r in out)


def test_fingerprints_and_shards(docs):
    rows = {r.doc_id: r for r in lzprint.fingerprints(docs).collect()}
    assert [rows[i].n_chars for i in range(len(TEXTS))] == [len(t or "") for t in TEXTS]
    shards = Counter(r.shard for r in sharding.shard_documents(docs, 4).collect())
    assert max(shards.values()) - min(shards.values()) <= 1


def test_repeated_strings(docs):
    got = {r.doc_id: (r.n_bytes, r.n_removed) for r in suffixes.removals(docs).collect()}
    assert got[0] == (1_000_000, 1_000_000) and got[3] == (len(TEXTS[3]), len(TEXTS[3])) and got[11] == got[12] == (0, 0)
    assert got[1][1] > 0.99 * len(WORDS) and got[4][1] == 0 and got[10][1] == 600_000


def test_language(docs):
    out = bytecnn.predict(docs, bytecnn.learn(docs)).collect()
    assert len(out) == len(TEXTS) and {r.lang_pred for r in out if r.doc_id in (11, 12)} == {"und"} and {r.lang_pred for r in out if r.doc_id in (0, 1)} == {"en"}
