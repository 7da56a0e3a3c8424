"""The training-data operators against brute force, round trips and the tokenizer itself, on awkward rows."""

import bisect
import hashlib
import itertools
import re
import struct
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from verigate.llm import bytecnn, images, linededup, lzprint, minhash, packing, pieces, sharding, sstable, suffixes
from verigate.llm.components import components
from verigate.llm.tokens import TokenEncoder

BPE = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, size string"
LINE = "This line of forty and more characters stands in Many documents."
LONG = " ".join(f"word{i * i % 977}" for i in range(900))


@pytest.fixture(scope="module")
def texts():
    return [None, "", "A.", "x", LONG, LONG + " and one more word", LONG[:3000] + "Ünïcödé ²½ 　日本語 " + LONG[3000:], "same text " * 60, "same text " * 60, "a" * 700] + [f"doc {i}\n  {LINE.upper() if i % 2 else LINE}\t\nend of document {i}" for i in range(6)] + [f"   \n\n{chr(233)}t{chr(233)}  don't I'll\t {i}" for i in range(3)]


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", 0, "r", "z") for i, t in enumerate(texts)], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def ids_of(text):
    t = Tokenizer.from_file(BPE)
    t.encode_special_tokens = True
    return t.encode(text or "", add_special_tokens=False).ids


def test_encoder_equals_library(texts):
    enc = TokenEncoder(BPE, public_tokenizers.PATTERN)
    for _ in range(2):  # the second time from the memo
        assert [list(struct.unpack(f"<{len(b) // 4}I", b)) for b in enc.encode([t or "" for t in texts])] == [ids_of(t) for t in texts]


def test_sstable_round_trip(spark, docs, texts, tmp_path):
    folder = f"file://{tmp_path}/shards"
    sstable.write_shards(docs, folder, BPE, public_tokenizers.PATTERN, shards=3)
    got = {r.doc_id: (r.start, bytes(r.ids)) for r in sstable.read_shards(spark, folder).collect()}
    at = 0
    for i, t in enumerate(texts):
        want = ids_of(t) + [0]
        assert got[i] == (at, struct.pack(f"<{len(want)}I", *want))
        at += len(want)
    hits = sstable.lookup(spark, folder, [4, 999]).collect()
    assert [(r.doc_id, bytes(r.ids)) for r in hits] == [(4, got[4][1])]


def test_sstable_shard_of_many_keys():
    entries = [(sstable.key_of(i * 7 - 900), struct.pack("<2I", i, i + 1)) for i in range(40_000)]
    shard = sstable.Shard.of(b"".join(p + b"\n" for p in sstable.shard_parts(iter(entries), 2)))
    assert len(shard.blocks) > 1 and shard.n_docs == 40_000 and list(shard.documents()) == entries
    assert shard.lookup(7 * 31_234 - 900) == [struct.pack("<2I", 31_234, 31_235)] and shard.lookup(1) == [] and shard.lookup(10**9) == []


def test_pieces_best_score(texts):
    seg = pieces.segmenter(public_tokenizers.path("piece_bpe_32k.model"))
    score = dict(zip(seg.v.pieces, seg.v.scores, strict=True))
    own = {p for p, k in zip(seg.v.pieces, seg.v.kinds, strict=True) if k == pieces.NORMAL}
    longest = max(map(len, own))

    def best(t):
        b = [0.0] + [-1e300] * len(t)
        for e in range(1, len(t) + 1):
            for s in range(max(0, e - longest), e):
                if t[s:e] in own:
                    b[e] = max(b[e], b[s] + score[t[s:e]])
            if t[e - 1] not in own:
                b[e] = max(b[e], b[e - 1] + seg.unknown)
        return b[-1]

    for t in ["hello world", "Erthenin ariear", "été où 日本", "a  b\n\nc", LONG[:400]]:
        whole = pieces.SPACE + t.replace(" ", pieces.SPACE)
        path = [p for w in seg.find(whole) for p in seg.best_path(w)]
        assert sum(seg.v.scores[p] if p >= 0 else seg.unknown for p in path) == best(whole)
    for t in texts:
        assert seg.decode(seg.encode(t or "")) == (t or "")


def test_line_dedup(docs, texts):
    got = {r.doc_id: r for r in linededup.apply_bitmaps(docs, linededup.keep_bitmaps(docs)).collect()}
    white = " \t\n\x0b\x0c\r"
    key = lambda line: re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(white))
    holders = {}
    for i, t in enumerate(texts):
        for line in (t or "").split("\n"):
            holders.setdefault(key(line), set()).add(i)
    for i, t in enumerate(texts):
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < 40 or len(holders[key(x)]) < 5 or max(holders[key(x)]) == i]
        assert (got[i].text or "", got[i].n_lines, got[i].n_dropped) == ("\n".join(kept), len(lines), len(lines) - len(kept))
        assert got[i].row == "r"


def test_suffixes_brute_force(docs, texts):
    data = [(t or "").encode() for t in texts]
    count = Counter(d[s : s + 200] for d in data for s in range(len(d) - 199))
    got = {r.doc_id: r for r in suffixes.removals(docs).collect()}
    for i, d in enumerate(data):
        gone = np.zeros(len(d), dtype=bool)
        for s in range(len(d) - 199):
            if count[d[s : s + 200]] > 1:
                gone[s : s + 200] = True
        kept = bytes(b for b, g in zip(d, gone, strict=True) if not g)
        spans = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) == (len(d), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())


def shingle_set(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def test_minhash_brute_force(docs, texts):
    sets = [shingle_set(t) for t in texts]
    group = list(range(len(texts)))
    for _ in texts:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if a and b and 100 * len(a & b) >= 85 * len(a | b):
                    group[i] = group[j] = min(group[i], group[j])
    got = {r.doc_id: r for r in minhash.near_duplicates(docs, 85).collect()}
    assert [(got[i].n_shingles, got[i].component_id, got[i].kept) for i in range(len(texts))] == [(len(s), group[i], group[i] == i) for i, s in enumerate(sets)]
    kept = minhash.deduplicate(docs, 85)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [i for i in range(len(texts)) if group[i] == i]


def hot_texts(tails):
    """Texts of 20 shingles whose four smallest hashes, all their keys at 85 %, are of one passage."""
    rng = np.random.default_rng(5)
    heads = [" ".join(f"p{x}" for x in row) for row in rng.integers(0, 1 << 40, (60_000, 12))]
    data, starts = np.frombuffer("".join(heads).encode(), np.uint8), np.cumsum([0, *map(len, heads)])
    with np.errstate(over="ignore"):
        doc, h = minhash.shingles(data, starts)
        low = np.sort(h.reshape(-1, 8), axis=1)[:, 3]
        head, cut = heads[int(low.argmin())], low.min()
        out = []
        for tail in tails:
            for salt in itertools.count():
                words = [f"t{tail}x{salt}x{i}" for i in range(13)]
                pair = [" ".join([head, *words[:12]]), " ".join([head, *words[:11], words[12]])]
                data, starts = np.frombuffer("".join(pair).encode(), np.uint8), np.array([0, len(pair[0]), len(pair[0]) + len(pair[1])])
                doc, h = minhash.shingles(data, starts)
                if ((h <= cut).sum(), len(h)) == (8, 40):
                    out.append(pair)
                    break
    return out


def test_minhash_hot_buckets(spark):
    made = hot_texts(range(60))
    texts = [p[0] for p in made] + [p[1] for p in made[:4]]
    sets = [shingle_set(t) for t in texts]
    group = list(range(len(texts)))
    for j in range(60, 64):
        assert 100 * len(sets[j] & sets[j - 60]) >= 85 * len(sets[j] | sets[j - 60])
        group[j] = j - 60
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(rows, 85).collect()}
    assert [got[i] for i in range(64)] == group


def test_minhash_blocks(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 5)
    rows = spark.createDataFrame([(1, i, i, 100 + 3 * i) for i in range(40)] + [(2, i, i, 70) for i in range(4)], "key long, node long, root long, n long")
    blocks = {}
    for r in minhash._blocks(rows, 85).collect():
        blocks.setdefault((r.block, r.i, r.j), []).append(r)
    met = {(min(x.node, y.node), max(x.node, y.node)) for (_, i, j), b in blocks.items() for x, y in itertools.combinations(b, 2) if i == j or x.own != y.own}
    want = {(x, y) for x, y in itertools.combinations(range(40), 2) if 100 * (100 + 3 * x) >= 85 * (100 + 3 * y)}
    assert want <= met and max(map(len, blocks.values())) < 40


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (103, 101), (7, 7)] + [(500, x) for x in range(200, 230)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "u long, v long")).collect()))
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys([100, 101, 103], 100), **dict.fromkeys([*range(200, 230), 500], 200)}


def test_sharding(docs, texts):
    rows = sharding.shard_documents(docs, shards=4).collect()
    sizes = Counter(r.shard for r in rows)
    assert len(rows) == len(texts) and max(sizes.values()) - min(sizes.get(s, 0) for s in range(4)) <= 1
    for s in sizes:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sizes[s]))
    for r in rows:
        t = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law) == (len(t) + 1, zlib.crc32(t), "rows")


def test_lz_fingerprints(docs, texts):
    def phrases(t):
        known, w, out = set(), "", set()
        for c in t:
            w += c
            if w not in known:
                known.add(w)
                out.add(w)
                w = ""
        return out | {w} if w else out

    got = {r.doc_id: r for r in lzprint.fingerprints(docs, partitions=3).collect()}
    for i, t in enumerate(texts):
        t, after = t or "", texts[(i + 1) % len(texts)] or ""
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        for x in (t, edited):
            ends = lzprint.parsed(x)[0]
            assert {x[a:b] for a, b in zip([0, *ends], ends, strict=False)} == phrases(x)
        own, changed, following = (lzprint.parsed(x)[1] for x in (t, edited, after))
        want = (len(t), hashlib.sha256(edited.encode()).hexdigest(), lzprint._hex(own), lzprint._hex(changed), lzprint.likeness(own, changed), lzprint.likeness(own, following))
        assert tuple(got[i])[1:] == want


def test_language(spark):
    rng = np.random.default_rng(1)
    sounds = {"aa": "kalo mira tuno", "bb": "schprik worx zzet", "cc": "été où ça"}
    rows = []
    for i in range(240):
        lang = sorted(sounds)[i % 3]
        rows.append((i, " ".join(rng.choice(sounds[lang].split(), 60)), lang))
    rows += [(900, None, "aa"), (901, "123 !?", "bb"), (902, "", None), (903, rows[0][1], None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    net = bytecnn.learn(docs)
    got = {r.doc_id: r for r in bytecnn.predict(docs, net).withColumn("out", bytecnn.held_out()).collect()}
    assert net.langs == ["aa", "bb", "cc"]
    assert all(got[r[0]].lang_pred == r[2] and 0 <= got[r[0]].score <= 1 for r in rows[:240] if got[r[0]].out)
    assert [got[i].lang_pred for i in (900, 901, 902, 903)] == ["und", "und", "und", "aa"]
    assert got[5].out == (zlib.crc32(b"5") % 5 == 0)
    assert bytecnn.predict(docs, None).where("lang_pred <> 'und'").count() == 0


def test_packing(docs, texts):
    rows = packing.pack(docs, BPE, public_tokenizers.PATTERN, length=256).collect()
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for i, t in enumerate(texts):
        want, at = ids_of(t) + [2], 0
        for k, r in enumerate(sorted(by_doc[i], key=lambda r: r.piece)):
            part = want[at : at + r.length]
            assert (r.piece, r.start, r.ids_crc32) == (k, at, zlib.crc32(struct.pack(f"<{len(part)}I", *part)))
            assert r.length == 256 or k == 0
            at += r.length
        assert at == len(want)
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 256
    total = sum(r.length for r in rows)
    assert len(by_sequence) <= -(-total // 256) + 3


def best_fit(h, capacity=1024):
    room = []
    for length in range(capacity, 0, -1):
        for _ in range(int(h[length])):
            i = bisect.bisect_left(room, length)
            bisect.insort(room, (room.pop(i) if i < len(room) else capacity) - length)
    return room


def test_packing_plan_near_bound():
    """The program does the packing: its value lies next to the dual's bound and its configurations place the pieces."""
    sizes = np.arange(1025)
    rng = np.random.default_rng(3)
    for h in (np.bincount(rng.integers(1, 400, 20_000), minlength=1025), np.bincount(np.minimum(1024, rng.lognormal(6, 1, 12_000).astype(int) + 1), minlength=1025)):
        plan = packing.plan(h)
        assert (sum(a * n for a, n in plan.configurations) == h).all() and all((a * sizes).sum() <= 1024 for a, _ in plan.configurations)
        used, short = sum(n for _, n in plan.configurations), int(h[1:1024].sum())
        assert plan.by_program >= 0.9 * short and plan.by_program + plan.by_best_fit == short and plan.full == h[1024]
        assert plan.bound <= plan.use <= 1.005 * plan.bound and plan.bound + plan.full <= used <= 1.003 * (plan.bound + plan.full) + 3
        assert used <= 1.001 * len(best_fit(h)) + 2


def test_packing_prices():
    """The knapsack against all configurations of a few lengths; long pieces that can't share bound the program."""
    lengths, price = np.array([3, 5, 7]), np.array([0.31, 0.5, 0.75])
    best, counts = packing.knapsack(price, lengths, 20, np.full(3, 20))
    for room in range(21):
        want = max(price @ c for c in itertools.product(range(8), repeat=3) if lengths @ c <= room)
        assert best[room] == pytest.approx(want) and price @ counts[room] == pytest.approx(want) and lengths @ counts[room] <= room
    few, counts = packing.knapsack(price, lengths, 20, np.array([1, 1, 1]))
    assert few[20] == pytest.approx(1.56) and counts[20].tolist() == [1, 1, 1]
    h = np.zeros(1025, dtype=np.int64)
    h[[600, 700, 20]] = 50, 30, 3
    plan = packing.plan(h)
    assert plan.bound == pytest.approx(80) and sum(n for _, n in plan.configurations) == 80


def test_images(spark):
    vectors = spark.createDataFrame([(i, [float(i % 7), float(i // 60)]) for i in range(0, 110)] + [(None, None)], "vec_id long, embedding array<double>")
    pictures = images.with_edits(vectors).union(spark.createDataFrame([(5000, None), (5001, bytearray(b"no image"))], "id long, image binary"))
    got = {r.id: r for r in images.copies(pictures).collect() if r.id is not None}
    assert [got[i].group_id == got[-1 - i].group_id for i in (0, 50, 100)] == [True] * 3
    assert got[0].class_id == got[7].class_id == 0 and got[1].group_id != got[0].group_id
    assert got[5000].group_id == 5000 and got[5001].n_corners == 0


def test_images_corners_grow():
    """A small crop of a large picture keeps enough corners to be found."""
    big = images.picture([1.0, 2.0], side=800)
    whole, part = images.descriptors(big.astype(np.float32)), images.descriptors(big[320:440, 520:640].astype(np.float32))
    assert len(whole[1]) > 1000 and images.agreeing(*part, *whole) >= images.MIN_AGREEING


def test_images_third_centre(spark, monkeypatch):
    """Two copies (0, 1) all of whose keys an image unlike them (2) has too, and unlike images that share others."""
    first = images.picture([1.0])
    pictures = [first, images.edited(first), images.picture([2.0]), images.picture([3.0])]
    rows = spark.createDataFrame([(i, bytearray(images.to_pgm(p))) for i, p in enumerate(pictures)], "id long, image binary")
    own = F.when(F.col("label") < 2, F.sequence(F.lit(1), F.lit(6))).when(F.col("label") == 2, F.sequence(F.lit(1), F.lit(16))).otherwise(F.sequence(F.lit(7), F.lit(16)))
    monkeypatch.setattr(images, "_keys", lambda classes: classes.select(F.explode(own.cast("array<bigint>")).alias("key"), "node"))
    assert {r.id: r.group_id for r in images.copies(rows).collect()} == {0: 0, 1: 0, 2: 2, 3: 3}


@pytest.fixture(scope="module")
def logo_groups(spark):
    """Images that hold one logo, with five copies: (found groups, groups by brute force)."""
    logo = images.picture([9.0, 9.0], side=40)
    pictures = []
    for i in range(40):
        img = images.picture([float(i), 5.0])
        img[20:60, 20:60] = logo
        pictures.append((i, bytearray(images.to_pgm(img))))
        if i < 5:
            pictures.append((100 + i, bytearray(images.to_pgm((img[2:, 2:] * 0.8 + 12).astype(np.uint8)))))
    rows = spark.createDataFrame(pictures, "id long, image binary")
    classes = images.described(rows).collect()
    points = {r.id: (images._points(r.points), images._words(r.words)) for r in classes}
    keys = {r.id: set(images.keys_of(images._words(r.words)).tolist()) for r in classes}
    group = {i: i for i in points}
    linked = [(a, b) for a, b in itertools.combinations(sorted(points), 2) if len(keys[a] & keys[b]) >= images.MIN_EDGES and images.agreeing(*points[a], *points[b]) >= images.MIN_AGREEING]
    for _ in group:
        for a, b in linked:
            group[a] = group[b] = min(group[a], group[b])
    return {r.id: r.group_id for r in images.copies(rows).collect()}, group


def test_images_shared_logo(logo_groups):
    """Copies among many images that hold one logo are found, and nothing that brute force wouldn't link."""
    got, group = logo_groups
    assert all(got[100 + i] == got[i] for i in range(5)) and all(group[i] == group[got[i]] for i in got)


@pytest.mark.xfail(reason="lines and stars don't compare all pairs of a key: images that are alike only in a part that many others have can stay apart", strict=False)
def test_images_shared_logo_equals_brute_force(logo_groups):
    got, group = logo_groups
    assert got == group


def test_images_shared_logo_loses_no_link(logo_groups):
    """Images that are alike only in a part that all others have are linked as by brute force."""
    got, group = logo_groups
    assert got == group


@pytest.mark.parametrize("f", [
    lambda d: linededup.apply_bitmaps(d, linededup.keep_bitmaps(d)), suffixes.removals, lambda d: minhash.near_duplicates(d, 85),
    lzprint.fingerprints, lambda d: bytecnn.predict(d, bytecnn.learn(d)), lambda d: packing.pack(d, BPE, public_tokenizers.PATTERN), lambda d: pieces.digests(d, public_tokenizers.path("piece_bpe_32k.model")),
])
def test_empty_table(empty, f):
    assert f(empty).count() == 0


def test_empty_shards(spark, empty, tmp_path):
    sstable.write_shards(empty, f"file://{tmp_path}/none", BPE, public_tokenizers.PATTERN)
    assert sstable.read_shards(spark, f"file://{tmp_path}/none").count() == 0


def test_null_and_repeated_identifiers(spark):
    docs = spark.createDataFrame([(None, LONG), (3, LONG), (3, LONG), (3, "other words here for a change"), (None, None)], "doc_id long, text string")
    assert suffixes.removals(docs).agg(F.sum("n_removed")).first()[0] == 3 * len(LONG)
    for f in (lambda d: minhash.near_duplicates(d, 85), sharding.shard_documents, lzprint.fingerprints, lambda d: linededup.apply_bitmaps(d, linededup.keep_bitmaps(d)), lambda d: pieces.digests(d, public_tokenizers.path("piece_bpe_32k.model"))):
        assert f(docs).count() == 5


def test_deduplicate_null_and_repeated_identifiers(spark):
    other = "other words here for a change"
    rows = [(None, LONG), (3, LONG), (3, LONG), (3, other), (None, "a text of five words or more"), (None, "x y"), (4, other), (None, None), (5, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter(map(tuple, minhash.deduplicate(docs, 85).collect()))
    assert got == Counter([(None, LONG), (3, other), (None, "a text of five words or more"), (None, "x y"), (None, None), (5, "")])


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.count() > 0 and [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_dedup", "suffix_dedup", "best_fit_packing"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, "").columns == docs.columns
