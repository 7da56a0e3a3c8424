"""Operator 3: copies among images, by local descriptors.

Each image (a binary PGM column) gets corners on several scales, each with a 256-bit descriptor: intensity
comparisons at point pairs that turn with the patch's own orientation (its intensity centroid), by the angle itself and
not by steps of it. Every cell of a scale's grid gives its strongest corners, so their number grows with the image. The
descriptors' four 64-bit words are the keys of Hamming tables: descriptors that differ in fewer than four bits agree in
a word, others by chance; an image has hundreds of words, and a copy needs two.

All images that share a key meet in pairs, whatever their number: a key of more than ``BLOCK`` images is dealt to pairs
of blocks of them, so that no task holds all of it. Of each image the images that it met come together and are counted.
A pair that enough keys give is confirmed by geometry: matched corners vote for one scale, turn and shift, and enough of
them have to agree. A crop to two thirds, a turn, noise or a change of brightness or contrast leave that intact; another
size only near the ratios of ``SCALES``.

Images with equal bytes are one class first; edges run between classes only.

Defined results: a null or unreadable image, or one without corners, has no descriptors and is linked only with
images of equal bytes; null images are linked with nothing; repeated rows are one class; an empty table gives no
rows; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verigate.llm.common import discard, frugal, mix64, seeds64, staged
from verigate.llm.components import components

SCALES, PATCH, BITS, TABLES = (1.0, 0.75, 0.5), 9, 256, 4
MIN_EDGES, MIN_AGREEING, MAX_BITS = 2, 8, 48
#: So many images of a key meet as they stream by; more are dealt to blocks of about as many.
BLOCK = 1024
#: Each cell of so many pixels a side gives so many corners.
CELL, CELL_CORNERS = 26, 4
_raw = seeds64(4 * BITS, 3)
#: What tells the tables apart in their keys.
_TABLE = seeds64(TABLES, 33)
#: Point pairs (x1, y1, x2, y2) of the binary tests, within the patch.
PAIRS = ((_raw >> np.uint64(33)) % np.uint64(2 * PATCH - 5)).astype(np.int64).reshape(BITS, 4) - (PATCH - 3)


def to_pgm(pixels: np.ndarray) -> bytes:
    h, w = pixels.shape
    return b"P5\n%d %d\n255\n" % (w, h) + pixels.astype(np.uint8).tobytes()


def from_pgm(data: bytes | None) -> np.ndarray | None:
    m = re.match(rb"P5\s+(\d+)\s+(\d+)\s+255\s", data or b"")
    if not m:
        return None
    w, h = int(m[1]), int(m[2])
    body = data[m.end() : m.end() + w * h]
    return np.frombuffer(body, np.uint8).reshape(h, w).astype(np.float32) if len(body) == w * h and w * h else None


def _resized(img: np.ndarray, scale: float) -> np.ndarray:
    if scale == 1:
        return img
    h, w = max(1, int(img.shape[0] * scale)), max(1, int(img.shape[1] * scale))
    y, x = (np.arange(h) + 0.5) / scale - 0.5, (np.arange(w) + 0.5) / scale - 0.5
    y0, x0 = np.clip(y.astype(int), 0, img.shape[0] - 1), np.clip(x.astype(int), 0, img.shape[1] - 1)
    y1, x1 = np.minimum(y0 + 1, img.shape[0] - 1), np.minimum(x0 + 1, img.shape[1] - 1)
    fy, fx = np.clip(y - y0, 0, 1)[:, None], np.clip(x - x0, 0, 1)[None, :]
    return (img[np.ix_(y0, x0)] * (1 - fx) + img[np.ix_(y0, x1)] * fx) * (1 - fy) + (img[np.ix_(y1, x0)] * (1 - fx) + img[np.ix_(y1, x1)] * fx) * fy


def _smooth(a: np.ndarray) -> np.ndarray:
    p = np.pad(a, 1, mode="edge")
    a = p[:-2] + 2 * p[1:-1] + p[2:]
    return (a[:, :-2] + 2 * a[:, 1:-1] + a[:, 2:]) / 16


def descriptors(img: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Corners (x, y, scale, angle; in the image's own pixels) and their descriptors (n x 32 bytes)."""
    points, words = [], []
    for scale in SCALES:
        a = _smooth(_resized(img, scale))
        if min(a.shape) < 2 * PATCH + 3:
            continue
        gy, gx = np.gradient(a)
        xx, yy, xy = _smooth(gx * gx), _smooth(gy * gy), _smooth(gx * gy)
        corner = xx * yy - xy * xy - 0.05 * (xx + yy) ** 2
        inner = corner[PATCH:-PATCH, PATCH:-PATCH]
        around = np.max([corner[PATCH + dy : corner.shape[0] - PATCH + dy, PATCH + dx : corner.shape[1] - PATCH + dx] for dy in (-1, 0, 1) for dx in (-1, 0, 1)], axis=0)
        y, x = np.nonzero((inner >= around) & (inner > 1e-3 * max(float(corner.max()), 1e-6)))
        order = np.lexsort((x, y, -inner[y, x]))
        cell = (y[order] // CELL) * inner.shape[1] + x[order] // CELL
        by = np.argsort(cell, kind="stable")
        place = np.empty(len(by), dtype=np.int64)
        place[by] = np.arange(len(by)) - np.searchsorted(cell[by], cell[by])
        best = order[place < CELL_CORNERS]
        y, x = y[best] + PATCH, x[best] + PATCH
        if not len(x):
            continue
        r = np.arange(-PATCH + 1, PATCH)
        dy, dx = np.meshgrid(r, r, indexing="ij")
        disc = dx * dx + dy * dy < PATCH * PATCH
        dy, dx = dy[disc], dx[disc]
        patch = a[y[:, None] + dy, x[:, None] + dx]
        patch = patch - patch.mean(axis=1, keepdims=True)
        angle = np.arctan2(patch @ dy, patch @ dx)
        c, s = np.cos(angle)[:, None].astype(np.float32), np.sin(angle)[:, None].astype(np.float32)

        def at(px: np.ndarray, py: np.ndarray, a=a, x=x, y=y, c=c, s=s) -> np.ndarray:
            u, v = np.clip(x[:, None] + c * px - s * py, 0, a.shape[1] - 1.001), np.clip(y[:, None] + s * px + c * py, 0, a.shape[0] - 1.001)
            u0, v0 = u.astype(np.int32), v.astype(np.int32)
            fu, fv, flat, at0 = u - u0, v - v0, a.ravel(), v0 * a.shape[1] + u0
            top, low = flat[at0] * (1 - fu) + flat[at0 + 1] * fu, flat[at0 + a.shape[1]] * (1 - fu) + flat[at0 + a.shape[1] + 1] * fu
            return top * (1 - fv) + low * fv

        words.append(np.packbits(at(PAIRS[:, 0], PAIRS[:, 1]) < at(PAIRS[:, 2], PAIRS[:, 3]), axis=1))
        points.append(np.stack([x / scale, y / scale, np.full(len(x), scale), angle], axis=1))
    if not points:
        return np.zeros((0, 4), np.float32), np.zeros((0, BITS // 8), np.uint8)
    return np.concatenate(points).astype(np.float32), np.concatenate(words)


def agreeing(p1: np.ndarray, d1: np.ndarray, p2: np.ndarray, d2: np.ndarray) -> int:
    """How many matched corners agree on one scale, turn and shift, in the better of both directions."""
    if not len(d1) or not len(d2):
        return 0
    a, b = (np.unpackbits(d, axis=1).astype(np.float32) * 2 - 1 for d in (d1, d2))
    nearest, least = [np.zeros(len(d1), dtype=np.int64), np.zeros(len(d2), dtype=np.int64)], [np.zeros(len(d1), dtype=np.int64), np.full(len(d2), BITS + 1)]
    rows = max(1, (1 << 18) // len(b))
    for lo in range(0, len(a), rows):  # blocks, for images of many corners
        apart = ((BITS - a[lo : lo + rows] @ b.T) / 2).astype(np.int64)
        nearest[0][lo : lo + rows], least[0][lo : lo + rows] = apart.argmin(axis=1), apart.min(axis=1)
        best, at = apart.min(axis=0), apart.argmin(axis=0) + lo
        nearest[1], least[1] = np.where(best < least[1], at, nearest[1]), np.minimum(best, least[1])
    out = 0
    for (p, q), near, bits in (((p1, p2), nearest[0], least[0]), ((p2, p1), nearest[1], least[1])):
        i = np.flatnonzero(bits <= MAX_BITS)
        if len(i) >= MIN_AGREEING:
            out = max(out, _votes(p[i], q[near[i]], near[i]))
    return out


def _votes(p: np.ndarray, q: np.ndarray, j: np.ndarray) -> int:
    """Each match (corner p to corner q, the j-th) proposes a similarity transform; the others vote."""
    ratio, turn, best = p[:, 2] / q[:, 2], q[:, 3] - p[:, 3], 0
    c, s = np.cos(turn) * ratio, np.sin(turn) * ratio
    rows = max(1, (1 << 20) // len(j))
    for lo in range(0, len(j), rows):  # blocks, for images of many corners
        k = slice(lo, lo + rows)
        x, y = p[None, :, 0] - p[k, 0, None], p[None, :, 1] - p[k, 1, None]
        u = c[k, None] * x - s[k, None] * y + q[k, 0, None] - q[None, :, 0]
        v = s[k, None] * x + c[k, None] * y + q[k, 1, None] - q[None, :, 1]
        ok = u * u + v * v < 2.5 * 2.5
        votes = ok.sum(axis=1)
        for i in np.argsort(-votes, kind="stable").tolist():
            if votes[i] <= best:
                break
            best = max(best, len(np.unique(j[ok[i]])))
    return best


def described(images: DataFrame) -> DataFrame:
    """id, node (of equal images; null for a null image), points and words (binary) of each image."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            points, words = [], []
            for data in b.column(2).to_pylist():
                img = from_pgm(data)
                p, d = descriptors(img) if img is not None else (np.zeros((0, 4), np.float32), np.zeros((0, 32), np.uint8))
                points.append(p.tobytes())
                words.append(d.tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(points, pa.binary()), pa.array(words, pa.binary())], ["id", "node", "points", "words"])

    node = F.when(F.col("image").isNotNull(), F.xxhash64("image", F.md5("image")))
    return images.select("id", node.alias("node"), "image").mapInArrow(frugal(run), "id long, node long, points binary, words binary")


def keys_of(words: np.ndarray) -> np.ndarray:
    """The distinct keys of descriptors (n x 32 bytes): their words, hashed with the table's number."""
    with np.errstate(over="ignore"):
        return np.unique(mix64(np.ascontiguousarray(words).view(np.uint64).reshape(-1, TABLES) + _TABLE).view(np.int64))


def _keys(classes: DataFrame) -> DataFrame:
    """(key, node) for each key of each class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = [keys_of(_words(w.as_py())) for w in b.column(1)]
            if keys:
                nodes = np.repeat(b.column(0).to_numpy(), [len(k) for k in keys])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(nodes)], ["key", "node"])

    return classes.select("node", "words").mapInArrow(frugal(run), "key long, node long")


def _after(key: np.ndarray) -> np.ndarray:
    """How many rows of its key come after each of sorted rows."""
    new = np.flatnonzero(np.append(np.ones(min(len(key), 1), bool), key[1:] != key[:-1]))
    size = np.diff(np.append(new, len(key)))
    return np.repeat(new + size, size) - 1 - np.arange(len(key))


def _linked(key: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The edges of sorted (key, node): all pairs of each key's nodes."""
    after = _after(key)
    start = np.cumsum(after) - after
    return np.repeat(node, after), node[np.repeat(np.arange(len(key)) + 1 - start, after) + np.arange(after.sum())]


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (key, node): of each node of a key the nodes after it, packed. A key of more than BLOCK nodes gives its
    bare rows (no ``others``), as they stream by."""
    key = node = np.zeros(0, np.int64)
    wide = None
    for batch in chain(batches, [None]):
        if batch is not None:
            key, node = np.concatenate((key, batch.column(0).to_numpy())), np.concatenate((node, batch.column(1).to_numpy()))
        n = len(key)
        if batch is not None and n and key[-1] != wide:
            start = int(np.searchsorted(key, key[-1]))
            n = start if n - start <= BLOCK else n  # the last key may go on
        if n:
            k, a = key[:n], node[:n]
            bare = (np.searchsorted(k, k, "right") - np.searchsorted(k, k) > BLOCK) | (k == wide)
            wide = int(k[-1]) if bare[-1] else None
            if bare.any():
                yield pa.RecordBatch.from_arrays([pa.array(k[bare]), pa.array(a[bare]), pa.nulls(int(bare.sum()), pa.binary())], ["key", "a", "others"])
            k, a = k[~bare], a[~bare]
            after = _after(k)
            some = after > 0
            if some.any():
                ends = np.append(0, np.cumsum(after[some]) * 8).astype(np.int32)
                packed = pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(_linked(k, a)[1])])
                yield pa.RecordBatch.from_arrays([pa.array(k[some]), pa.array(a[some]), packed], ["key", "a", "others"])
        key, node = key[n:], node[n:]


def _met_in_blocks(rows: pa.Table) -> pa.Table:
    """The same of two blocks (i, j) of one key's nodes; of one block, where both are the same."""
    block, node = rows.column("block").to_numpy(), rows.column("node").to_numpy()
    sides = [np.sort(node[block == rows.column(c)[0].as_py()]) for c in ("i", "j")]
    turns = ((0, 1), (1, 0)) if rows.column("i")[0] != rows.column("j")[0] else ((0, 0),)
    found = [(a, sides[y][np.searchsorted(sides[y], a, "right") :].tobytes()) for x, y in turns for a in sides[x].tolist()]
    found = [(a, others) for a, others in found if others]
    return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "others": pa.array([o for _, o in found], pa.binary())})


def _tallied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of a: the pairs (a, b) that enough keys gave."""
    a = b = n = np.zeros(0, np.int64)
    for batch in chain(batches, [None]):
        if batch is not None:
            lists = [np.frombuffer(o.as_py(), np.int64) for o in batch.column(1)]
            a, b = np.concatenate((a, np.repeat(batch.column(0).to_numpy(), [len(x) for x in lists]))), np.concatenate((b, *lists))
            n = np.concatenate((n, np.ones(len(a) - len(n), np.int64)))
        if not len(a):
            continue
        order = np.lexsort((b, a))
        a, b, n = a[order], b[order], n[order]
        new = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
        a, b, n = a[new], b[new], np.add.reduceat(n, new)
        done = np.ones(len(a), bool) if batch is None else a != a[-1]  # the last may go on
        out = done & (n >= MIN_EDGES)
        if out.any():
            yield pa.RecordBatch.from_arrays([pa.array(a[out]), pa.array(b[out])], ["a", "b"])
        a, b, n = a[~done], b[~done], n[~done]


def _candidates(classes: DataFrame) -> DataFrame:
    """All pairs (a, b), a < b, of classes that share enough keys."""
    met = _keys(classes).repartition("key").sortWithinPartitions("key", "node").mapInArrow(frugal(_met), "key long, a long, others binary")
    bare = met.where("others is null").select("key", F.col("a").alias("node"))
    blocks = bare.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"))
    dealt = bare.join(blocks, "key").withColumn("block", F.pmod(F.xxhash64("node"), "blocks")).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = dealt.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node")
    wide = dealt.groupBy("key", "i", "j").applyInArrow(_met_in_blocks, "a long, others binary")
    every = met.where("others is not null").select("a", "others").union(wide)
    return staged(every.repartition("a").sortWithinPartitions("a").mapInArrow(frugal(_tallied), "a long, b long"), "pairs")


def copies(images: DataFrame, id_col: str = "id", image_col: str = "image") -> DataFrame:
    """Per image: id, class_id (smallest id with equal bytes), group_id (smallest id reachable by links), n_corners, n_links of its class."""
    rows = images.select(F.col(id_col).cast("long").alias("id"), F.col(image_col).alias("image"))
    found = staged(described(rows), "described")
    labels = found.where("node is not null").groupBy("node").agg(F.min("id").alias("label"))
    own = found.where("node is not null").dropDuplicates(["node"]).select("node", "points", "words")
    classes = staged(own.join(labels, "node"), "classes")
    rows = staged(found.select("id", "node"), "images")
    discard(found)
    pairs = _candidates(classes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            keep = []
            for p1, w1, p2, w2 in zip(*(t.column(i).to_pylist() for i in (2, 3, 4, 5)), strict=True):
                n = agreeing(*(f(x) for f, x in ((_points, p1), (_words, w1), (_points, p2), (_words, w2))))
                keep.append(n >= MIN_AGREEING)
            if keep:
                yield t.select([0, 1]).filter(pa.array(keep))

    a, b = (classes.select(F.col("node").alias(x), F.col("points").alias(f"p_{x}"), F.col("words").alias(f"w_{x}")) for x in "ab")
    both = pairs.join(a, "a").join(b, "b").select("a", "b", "p_a", "w_a", "p_b", "w_b")
    links = staged(both.mapInArrow(frugal(run), "a long, b long"), "links")
    joined = staged(components(links.select(F.col("a").alias("u"), F.col("b").alias("v"))), "components")
    least = joined.join(classes.select("node", "label"), "node").groupBy("root").agg(F.min("label").alias("least"))
    degree = links.select(F.col("a").alias("node")).union(links.select("b")).groupBy("node").agg(F.count(F.lit(1)).alias("n_links"))
    of = classes.select("node", "label", F.octet_length("words").alias("size")).join(joined, "node", "left").join(least, "root", "left").join(degree, "node", "left")
    of = staged(of.select("node", "label", "size", F.coalesce("least", "label").alias("least"), "n_links"), "groups")
    out = rows.select("id", "node").join(of, "node", "left")
    return out.select("id", F.coalesce("label", "id").alias("class_id"), F.coalesce("least", "id").alias("group_id"), (F.coalesce("size", F.lit(0)) / (BITS // 8)).cast("long").alias("n_corners"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def _points(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.float32).reshape(-1, 4)


def _words(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.uint8).reshape(-1, BITS // 8)


def picture(vector: list[float] | None, side: int = 96) -> np.ndarray:
    """A picture that depends on a vector only: random texture of several grains, seeded by its values."""
    seed = int.from_bytes(hashlib.blake2b(np.asarray(vector or [], dtype="<f4").tobytes(), digest_size=8).digest(), "little")
    rng = np.random.default_rng(seed)
    out = np.zeros((side, side), dtype=np.float32)
    for grain, weight in ((16, 0.3), (8, 0.3), (4, 0.4)):
        n = -(-side // grain) + 1
        out += weight * _resized(rng.integers(0, 256, (n, n)).astype(np.float32), float(grain))[:side, :side]
    out = (out - out.mean()) * (55 / max(float(out.std()), 1e-3)) + 128
    return np.clip(_smooth(out), 0, 255).astype(np.uint8)


def turned(img: np.ndarray, degrees: float) -> np.ndarray:
    """The picture turned about its middle, as large as before; what comes in from outside is grey."""
    h, w = img.shape
    c, s = np.cos(np.radians(degrees)), np.sin(np.radians(degrees))
    y, x = np.meshgrid(np.arange(h) - (h - 1) / 2, np.arange(w) - (w - 1) / 2, indexing="ij")
    u, v = c * x + s * y + (w - 1) / 2, -s * x + c * y + (h - 1) / 2
    inside = (u >= 0) & (u <= w - 1) & (v >= 0) & (v <= h - 1)
    u0, v0 = np.clip(u.astype(int), 0, w - 2), np.clip(v.astype(int), 0, h - 2)
    fu, fv = np.clip(u - u0, 0, 1), np.clip(v - v0, 0, 1)
    a = img.astype(np.float32)
    mixed = (a[v0, u0] * (1 - fu) + a[v0, u0 + 1] * fu) * (1 - fv) + (a[v0 + 1, u0] * (1 - fu) + a[v0 + 1, u0 + 1] * fu) * fv
    return np.where(inside, mixed, 128).astype(np.uint8)


def edited(img: np.ndarray, kind: int = 0) -> np.ndarray:
    """An edited copy: 0 cropped on all sides, darker and flatter; 1 two thirds of each side; 2 a quarter turn; 3 turned by
    20 degrees; 4 three quarters of the size; 5 noisy."""
    h, w = img.shape
    if kind == 0:
        return (img[7:-9, 11:-5] * 0.8 + 12).astype(np.uint8)
    if kind == 1:
        return img[h // 6 : h // 6 + 2 * h // 3, w // 6 : w // 6 + 2 * w // 3]
    if kind == 2:
        return np.rot90(img).copy()
    if kind == 3:
        return turned(img, 20)
    if kind == 4:
        return _resized(img.astype(np.float32), 0.75).astype(np.uint8)
    return np.clip(img + np.random.default_rng(1).normal(0, 6, img.shape), 0, 255).astype(np.uint8)


KINDS = 6


def with_edits(vectors: DataFrame) -> DataFrame:
    """The pictures of all vectors; of each whose id is divisible by 50 an edited copy too, as -1 - id, each of the kinds
    in its turn."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 1000):
                ids, images = [], []
                for i, v in zip(b.column(0)[lo : lo + 1000].to_pylist(), b.column(1)[lo : lo + 1000].to_pylist(), strict=True):
                    img = picture(v)
                    ids.append(i)
                    images.append(to_pgm(img))
                    if i is not None and i % 50 == 0:
                        ids.append(-1 - i)
                        images.append(to_pgm(edited(img, i // 50 % KINDS)))
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(images, pa.binary())], ["id", "image"])

    return vectors.select(F.col("vec_id").cast("long"), "embedding").mapInArrow(frugal(run), "id long, image binary")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: the tables hold no images, so every embedding is drawn as one; edited copies have to be found."""
    return copies(with_edits(spark.read.parquet(f"{sf_dir}/embeddings.parquet")))
