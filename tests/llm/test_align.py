"""Operator 13 against both libraries on whole texts and plain loops."""

from __future__ import annotations

import hashlib
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from verigate.llm import align

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    None, "", " ", "   ", "\n", "a", "don't I'll we've 'tis", "x▁y stands", "▁", "<|endoftext|> and <s> <unk> <0x41>", "tab\t then  two\n newlines\n\n end ",
    "naïve café Größe déjà vu", "no break 　wide em  line \u0085next x", "日本語 の text", "emoji 👩‍👩‍👧 🇩🇪 end", "a\x00b \x1c c\x7f d", "é́ combining", "trailing   ", "  leading",
    "word " * 500, "same", "same", "x" * 3000, "١٢٣ ²½ Ⅷ", "ﬁ ligature İ", "﻿bom ​zero",
]


def _bytes(pair_bytes, ids):
    return b"".join(pair_bytes[k] for k in ids)


def _expected(texts):
    """Per text (a ids, b ids, groups, links), by both libraries over the whole text."""
    tok = Tokenizer.from_file(A)
    tok.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=B)
    own = {chr(b): b for b in [*range(33, 127), *range(161, 173), *range(174, 256)]}
    rest = [b for b in range(256) if b not in own.values()]
    own |= {chr(256 + k): b for k, b in enumerate(rest)}
    a_bytes = lambda k: bytes(own[c] for c in tok.id_to_token(k))

    def b_bytes(k):
        piece = sp.id_to_piece(k)
        return bytes([int(piece[3:5], 16)]) if sp.is_byte(k) else piece.replace("▁", " ").encode()

    out = []
    for t in texts:
        empty = ([], [], [], [])
        if not t:
            out.append(empty)
            continue
        a, b, want = tok.encode(" " + t, add_special_tokens=False).ids, sp.encode(t), (" " + t).encode()
        spans = []
        for ids, of in ((a, a_bytes), (b, b_bytes)):
            at, own_spans = 0, []
            for k in ids:
                own_spans.append((at, at + len(of(k)), k))
                at += len(of(k))
            spans.append(own_spans)
        if b"".join(map(a_bytes, a)) != want or b"".join(map(b_bytes, b)) != want:
            out.append(empty)
            continue
        cuts = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
        place = {cut: g for g, cut in enumerate(cuts)}
        sides = [[[] for _ in cuts], [[] for _ in cuts]]
        for side, own_spans in zip(sides, spans):
            g = 0
            for _, e, k in own_spans:
                side[g].append(str(k))
                g = place.get(e, g - 1) + 1 if e in place else g
        groups = [",".join(x) + "|" + ",".join(y) for x, y in zip(*sides)]
        links = [(x, y) for s, e, x in spans[0] for s2, e2, y in spans[1] if s < e2 and s2 < e] if len(a) < 400 else _swept(*spans)
        out.append((a, b, groups, links))
    return out


def _swept(a, b):
    links, j = [], 0
    for s, e, x in a:
        while b[j][1] <= s:
            j += 1
        k = j
        while k < len(b) and b[k][0] < e:
            links.append((x, b[k][2]))
            k += 1
    return links


def _compare(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = _expected([t for _, t in rows])
    counts = Counter(x for *_, links in want for x in links)
    most: dict = {}
    for (_, y), n in counts.items():
        most[y] = max(most.get(y, 0), n)
    expected = []
    for (ident, _), (a, b, groups, links) in zip(rows, want):
        sha = hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""
        expected.append((ident, len(a), len(b), len(groups), len(links), sum(counts[x] == most[x[1]] for x in links), sum(counts[x] for x in links), sha))
    got = [tuple(r) for r in align.digests(df, A, B, public_tokenizers.PATTERN).collect()]
    key = lambda r: (str(r[0]), r)
    assert sorted(got, key=key) == sorted(expected, key=key)
    texts = sorted(((r.doc_id, r.groups) for r in align.align(df, A, B, public_tokenizers.PATTERN).collect()), key=str)
    assert texts == sorted(((i, ";".join(w[2])) for (i, _), w in zip(rows, want)), key=str)


def test_odd_texts(spark):
    _compare(spark, list(enumerate(ODD)))


def test_repeated_and_null_identifiers(spark):
    _compare(spark, [(None, "one text"), (None, "one text"), (7, "another"), (7, "third text"), (7, None)])


def test_a_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    _compare(spark, [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])


def test_a_very_long_text(spark):
    _compare(spark, [(1, "naïve word's " * 40_000), (2, "x▁ " * 1000), (3, "y" * 100_000), (4, "short")])


def test_chunks_do_not_matter(spark, monkeypatch):
    df = spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string").coalesce(1)
    whole = sorted(map(tuple, align.digests(df, A, B, public_tokenizers.PATTERN).collect()))
    split = sorted(map(tuple, align.digests(df.repartition(7), A, B, public_tokenizers.PATTERN).collect()))
    unsplit = sorted(map(tuple, align.digests(df, A, B, None).collect()))  # each text one segment
    assert whole == split == unsplit


def test_empty_table_and_clashing_names(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert align.digests(empty, A, B).count() == 0
    clash = spark.createDataFrame([(1, "some text")], "doc_id long, text string").withColumns({c: F.lit(c) for c in ["chunk", "p", "a", "b", "n", "n_a", "docs", "segs", "total", "best"]})
    row = align.digests(clash, A, B, public_tokenizers.PATTERN).first()
    assert row.n_a == 2 and row.n_best == row.n_links == row.count_sum
