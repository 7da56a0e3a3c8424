"""Odd tables for every operator and stage, and brute force where there is no SQL."""

import itertools
import re
import struct
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from verigate.llm import bytecnn, images, linededup, minhash, pieces, sharding, sstable, suffixes
from verigate.llm.tokens import TokenEncoder

BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
CLASH = "doc_id long, text string, lang string, source string, n_chars long, score double, lang_pred string, n_lines string, n_dropped int, part int, at int, n int, holder string, node string, shard string, key string"
OWN = (7.5, "mine", "99", 98, 1, 2, 3, "h", "n", "s", "k")
LINE = "This line of forty and more characters stands in many documents."


def clashing(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", 5, *OWN) for i, t, lang in rows], CLASH)


ROWS = [(None, None, "en"), (1, "", "en"), (2, "some plain english words stand here " * 20, "en"), (3, "des mots et encore des mots français ici " * 20, "fr"), (3, "some plain english words stand here " * 20, "en"), (4, "12 34", None), (4, "12 34", None)] + [(10 + i, f"{LINE}\nline {i}", "en") for i in range(6)]


def stages():
    import corpus_pipeline

    return dict(corpus_pipeline.STAGES)


@pytest.mark.parametrize("name", ["language_id", "line_dedup", "near_dedup", "suffix_dedup"])
def test_stage_keeps_clashing_columns(spark, name):
    docs = clashing(spark, ROWS)
    out = stages()[name](spark, docs, "")
    assert out.columns == docs.columns and out.schema == docs.schema
    rows = out.collect()
    assert rows and all(tuple(r)[5:] == OWN for r in rows)
    empty = docs.limit(0)
    assert stages()[name](spark, empty, "").count() == 0


def test_packing_stage_of_odd_tables(spark):
    out = stages()["best_fit_packing"](spark, clashing(spark, ROWS), "").collect()
    assert len(out) == len(ROWS) and sum(r.length for r in out if r.doc_id == 1) == 1
    assert stages()["best_fit_packing"](spark, clashing(spark, ROWS).limit(0), "").count() == 0


def lines_left(texts):
    white = " \t\n\x0b\x0c\r"
    key = lambda line: re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(white))
    holders = {}
    for i, t in texts.items():
        for line in t.split("\n"):
            holders.setdefault(key(line), set()).add(i)
    return {i: "\n".join(x for x in t.split("\n") if len(key(x)) < 40 or len(holders[key(x)]) < 5 or max(holders[key(x)]) == i) for i, t in texts.items()}


def words_of(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def groups_of(texts, percent):
    sets = {i: words_of(t) for i, t in texts.items()}
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    by = {}
    for i, s in sets.items():
        for x in s:
            by.setdefault(x, []).append(i)
    shared = Counter(p for ids in by.values() for p in itertools.combinations(sorted(ids), 2))
    for (a, b), n in shared.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: find(i) for i in texts}


def bytes_left(texts):
    data = {i: t.encode() for i, t in texts.items()}
    count = Counter(d[s : s + 200] for d in data.values() for s in range(len(d) - 199))
    out = {}
    for i, d in data.items():
        gone = np.zeros(len(d), dtype=bool)
        for s in range(len(d) - 199):
            if count[d[s : s + 200]] > 1:
                gone[s : s + 200] = True
        out[i] = bytes(b for b, g in zip(d, gone, strict=True) if not g).decode("utf-8", "ignore")
    return out


def test_stages_against_brute_force(spark):
    """The three stages between the classifier and the packing, on all documents of the smallest table."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    table = lambda d: {r.doc_id: r.text or "" for r in d.collect()}
    lined = stages()["line_dedup"](spark, docs, "").cache()
    want = lines_left(texts)
    assert table(lined) == want
    near = stages()["near_dedup"](spark, lined, "").cache()
    group = groups_of(want, 80)
    want = {i: t for i, t in want.items() if group[i] == i}
    assert table(near) == want
    cut = stages()["suffix_dedup"](spark, near, "")
    rows = cut.collect()
    assert {r.doc_id: r.text or "" for r in rows} == bytes_left(want)
    assert all(r.n_chars == len(r.text) for r in rows if r.text is not None)


@pytest.mark.parametrize("f", [
    lambda d: images.copies(d.select(F.col("doc_id").alias("id"), F.col("text").cast("binary").alias("image"))), lambda d: pieces.encode_documents(d, PIECES), sharding.shard_documents,
])
def test_odd_tables(spark, f):
    """Operators that no stage applies; the stages' tests do the same for all others."""
    docs = clashing(spark, ROWS)
    assert f(docs.limit(0)).count() == 0
    assert f(docs).count() == len(ROWS)


def test_near_duplicates_with_repeated_identifiers(spark):
    """Equal identifiers on unlike texts, in either order: links and groups are the same."""
    base = " ".join(f"w{i}" for i in range(60))
    other = " ".join(f"v{i}" for i in range(60))
    for rows in ([(1, other), (1, base), (2, base + " more")], [(2, base + " more"), (1, base), (1, other)]):
        got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 85).collect())
        assert got == [(1, 56, 1), (1, 56, 1), (2, 57, 1)]
    kept = minhash.deduplicate(spark.createDataFrame([(1, other), (1, base), (2, base + " more")], "doc_id long, text string"), 85)
    assert sorted(tuple(r) for r in kept.collect()) == sorted([(1, other), (1, base)])


def test_line_dedup_over_many_ranges(spark):
    """Hot lines that go over many ranges, documents with the same identifier, a line in four and one in five documents."""
    rows = [(i % 700, f"{LINE}\nown line {i}\n{LINE}\n{'rare line with enough characters in it, four of them' if i < 4 else ''}") for i in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        got = Counter((r.doc_id, r.text) for r in linededup.apply_bitmaps(docs, linededup.keep_bitmaps(docs), counts=None).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    want = Counter((i, t if i == 699 else t.replace(LINE + "\n", "")) for i, t in rows)
    assert got == want


def test_suffixes_over_many_ranges(spark, monkeypatch):
    """Copies, shifted copies and a period of one byte, in ranges so small that equal digits go over many of them."""
    rng = np.random.default_rng(11)
    body = "".join(rng.choice(list("abcdefgh "), 1500))
    texts = {i: t for i, t in enumerate([body, body, "x" + body[:700], body[300:900] + "é" * 120, "a" * 900, "a" * 450 + "b", body[:199], body[1:201] + "?", "unlike " * 3] + [body[100:420] + str(i) for i in range(30)])}
    monkeypatch.setattr(suffixes, "RANGE_BYTES", 64)
    monkeypatch.setattr(suffixes, "PART_BYTES", 256)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r.doc_id: r.text for r in suffixes.deduplicate(docs).collect()} == bytes_left(texts)


def test_shards_by_byte_ranges(spark, tmp_path):
    """One identifier on many rows goes over several shards; lookups read blocks, not shards."""
    texts = [f"text number {i} of the same identifier" for i in range(300)]
    docs = spark.createDataFrame([(5, t) for t in texts] + [(i, f"other {i}") for i in (1, 9)], "doc_id long, text string")
    folder = f"file://{tmp_path}/shards"
    sstable.write_shards(docs, folder, BPE, public_tokenizers.PATTERN, shards=6)
    shards = [s for _, s in sstable._opened(spark, folder)]
    assert sum(s.first_key == sstable.key_of(5) for s in shards) > 1
    enc = Tokenizer.from_file(BPE)
    want = Counter(struct.pack(f"<{len(ids) + 1}I", *ids, 0) for ids in (enc.encode(t, add_special_tokens=False).ids for t in texts))
    assert Counter(bytes(r.ids) for r in sstable.lookup(spark, folder, [5]).collect()) == want
    rows = sorted((r.start, r.doc_id, r.n_tokens) for r in sstable.read_shards(spark, folder).collect())
    assert len(rows) == 302 and [r[1] for r in rows] == [1] + [5] * 300 + [9]
    assert all(a[0] + a[2] == b[0] for a, b in itertools.pairwise(rows))


def test_special_tokens():
    """Ordinary text by default; the library's own treatment if asked for."""
    texts = ["see <|endoftext|> here", "plain", "<|endoftext|>"]
    lib = Tokenizer.from_file(BPE)
    for specials in (False, True):
        lib.encode_special_tokens = not specials
        got = TokenEncoder(BPE, public_tokenizers.PATTERN, specials).encode(texts)
        assert [list(struct.unpack(f"<{len(b) // 4}I", b)) for b in got] == [lib.encode(t, add_special_tokens=False).ids for t in texts]


def test_pieces_on_random_texts():
    """Best score, covered characters and the decoded text of random strings; ties give equal scores."""
    seg = pieces.segmenter(PIECES)
    score = dict(zip(seg.v.pieces, seg.v.scores, strict=True))
    own = {p for p, k in zip(seg.v.pieces, seg.v.kinds, strict=True) if k == pieces.NORMAL}
    longest = max(map(len, own))
    rng = np.random.default_rng(4)
    letters = list("aaabcdeeinorst  ést日\n")
    for n in (1, 2, 3, 10, 40, 200):
        for _ in range(8):
            t = "".join(rng.choice(letters, n)).strip() or "a"
            t = re.sub(" +", " ", t)
            whole = pieces.SPACE + t.replace(" ", pieces.SPACE)
            best = [0.0] + [-1e300] * len(whole)
            for e in range(1, len(whole) + 1):
                for s in range(max(0, e - longest), e):
                    if whole[s:e] in own:
                        best[e] = max(best[e], best[s] + score[whole[s:e]])
                if whole[e - 1] not in own:
                    best[e] = max(best[e], best[e - 1] + seg.unknown)
            path = [p for w in seg.find(whole) for p in seg.best_path(w)]
            assert sum(seg.v.scores[p] if p >= 0 else seg.unknown for p in path) == pytest.approx(best[-1])
            assert "".join(seg.v.pieces[p] if p >= 0 else chr(-1 - p) for p in path) == whole
            assert seg.decode(seg.encode(t)) == t


def test_network_against_loops():
    rng = np.random.default_rng(2)
    net = bytecnn.Network(["a", "b", "c"], [[rng.normal(0, 1, (256, bytecnn.FILTERS)) for _ in range(w)] for w in bytecnn.WIDTHS], rng.normal(0, 1, (48, 3)), rng.normal(0, 1, 3))
    x = rng.integers(0, 256, (4, bytecnn.WINDOW)).astype(np.uint8)
    pooled, _ = net.pooled(x)
    for i in range(4):
        for k, width in enumerate(bytecnn.WIDTHS):
            for f in (0, 7, 15):
                want = max(sum(net.tables[k][j][x[i, s + j], f] for j in range(width)) for s in range(bytecnn.WINDOW - width + 1))
                assert pooled[i, k * bytecnn.FILTERS + f] == pytest.approx(want)
    y, weight = np.array([0, 1, 2, 1]), np.array([1.0, 0.5, 2.0])
    _, grads = bytecnn.gradients(net, x, y, weight)
    params = [t for ts in net.tables for t in ts] + [net.dense, net.bias]
    for p, g in zip(params, grads, strict=True):
        for at in [tuple(rng.integers(0, n) for n in p.shape) for _ in range(3)] + [np.unravel_index(np.abs(g).argmax(), g.shape)]:
            old, h = p[at], 1e-6
            p[at] = old + h
            up = bytecnn.gradients(net, x, y, weight)[0]
            p[at] = old - h
            down = bytecnn.gradients(net, x, y, weight)[0]
            p[at] = old
            assert g[at] == pytest.approx((up - down) / (2 * h), abs=1e-5)


def test_sharding_keeps_groups_whole(spark):
    rows = [(i, f"group {i % 40}") for i in range(400)] + [(400 + i, f"hot {i // 90}") for i in range(180)] + [(1000 + i, f"alone {i}") for i in range(220)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sharding.shard_documents(docs, shards=4)
    found = {r.doc_id: r.shard for r in got.collect()}
    sizes = Counter(found.values())
    assert max(sizes.values()) - min(sizes.values()) <= 1
    cut = sharding.cut_links(got.join(docs.withColumnRenamed("text", "hub"), "doc_id")).first()
    assert cut.hubs == 42 and cut.links == 40 * 9 + 2 * 89 and cut.cut_links <= 0.02 * cut.links
    by_bytes = Counter()
    for r in sharding.shard_documents(docs, shards=4, law="bytes").collect():
        by_bytes[r.shard] += r.size
    assert max(by_bytes.values()) <= 1.1 * sum(by_bytes.values()) / 4


def test_image_recall():
    """Edited copies keep enough keys and agreeing corners; unlike pictures don't agree. The README has the table."""
    keys = lambda words: set(images.keys_of(words).tolist())
    found = Counter()
    n = 20
    whole = []
    for i in range(n):
        img = images.picture([float(i), 3.0])
        p, d = images.descriptors(img.astype(np.float32))
        whole.append((p, d))
        for kind in range(images.KINDS):
            q, e = images.descriptors(images.edited(img, kind).astype(np.float32))
            found[kind] += len(keys(d) & keys(e)) >= images.MIN_EDGES and images.agreeing(p, d, q, e) >= images.MIN_AGREEING
    assert all(found[k] >= 0.9 * n for k in range(images.KINDS)), found
    assert not any(images.agreeing(*a, *b) >= images.MIN_AGREEING for a, b in itertools.combinations(whole, 2))


@pytest.mark.parametrize("block", [1024, 3])
def test_image_keys_of_many_images_lose_no_pair(spark, monkeypatch, block):
    """All pairs that share two keys are candidates, of keys that many images hold too, dealt to blocks or not."""
    rng = np.random.default_rng(5)
    held = {i: {100} | set(rng.integers(0, 12, 2).tolist()) | set(rng.integers(200, 204, 1).tolist()) for i in range(40)} | {50: {7}, 51: {300}}
    monkeypatch.setattr(images, "BLOCK", block)
    monkeypatch.setattr(images, "_keys", lambda classes: classes)
    rows = spark.createDataFrame([(k, i) for i, keys in held.items() for k in sorted(keys)], "key long, node long")
    want = {(i, j) for i, j in itertools.combinations(sorted(held), 2) if len(held[i] & held[j]) >= images.MIN_EDGES}
    assert sorted((r.a, r.b) for r in images._candidates(rows).collect()) == sorted(want)


def test_image_edges():
    """The edges of sorted keys connect each key's images; up to four images all meet."""
    key, node = np.array([1, 2, 2, 3, 3, 3, 3, 9, 9, 9, 9, 9, 9]), np.array([5, 1, 2, 1, 2, 3, 4, 1, 2, 3, 4, 5, 6])
    a, b = images._linked(key, node)
    pairs = Counter(zip(a.tolist(), b.tolist(), strict=True))
    three = set(itertools.combinations(range(1, 5), 2))
    assert pairs[(1, 2)] == 3 and three <= set(pairs) and len(a) <= 3 * len(key)
    assert {(1, x) for x in range(2, 7)} | {(x, 6) for x in range(1, 6)} <= set(pairs)
