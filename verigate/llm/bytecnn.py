"""Operator 9: language identification by a byte convolutional network.

The network sees windows of ``WINDOW`` bytes: convolutions of several widths over the bytes, the largest value of
each filter in the window, a softmax over the languages. A convolution over one-hot bytes is a sum of table
rows, one table for each place in the filter. It is trained here, in numpy, on a bounded sample of labelled
rows: ``SAMPLE_DOCS`` documents (those with the smallest hashes of identifier and text), ``SAMPLE_WINDOWS`` windows
of each at hashed places of the whole text. Prediction covers every window of the whole text; a document's score is the softmax
of its windows' mean log-probabilities, weighted by their bytes.

Defined results: ``und`` with score 0 where the text is null or has no letter, or where there was nothing to learn
from; a row without a language is never learnt from; ties go to the language that sorts first; repeated rows
get equal predictions and are learnt from once; an empty table gives no rows; extra columns are kept (see ``predict``
for those that have the names of the results).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verigate.llm.common import frugal, text_runs, trim

WINDOW, WIDTHS, FILTERS = 256, (2, 3, 4), 16
SAMPLE_DOCS, SAMPLE_WINDOWS, EPOCHS, BATCH, RATE, SEED = 4000, 3, 3, 128, 0.02, 9
RUN_BYTES, CHUNK, MIN_SCORE, LEAST_STEPS = 1 << 20, 128, 0.35, 300
UNKNOWN = "und"


@dataclass
class Network:
    langs: list[str]
    tables: list[list[np.ndarray]]
    dense: np.ndarray
    bias: np.ndarray

    def pooled(self, x: np.ndarray, where: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """The largest value of each filter in each window (and its place)."""
        out, places = [], []
        for width, tables in zip(WIDTHS, self.tables, strict=True):
            n = WINDOW - width + 1
            conv = tables[0][x[:, :n]]
            for j in range(1, width):
                conv += tables[j][x[:, j : j + n]]
            if where:
                at = conv.argmax(axis=1)
                places.append(at)
                out.append(np.take_along_axis(conv, at[:, None, :], axis=1)[:, 0, :])
            else:
                out.append(conv.max(axis=1))
        return np.concatenate(out, axis=1), np.concatenate(places, axis=1) if where else None

    def log_probabilities(self, x: np.ndarray) -> np.ndarray:
        out = np.empty((len(x), len(self.langs)), dtype=np.float32)
        for lo in range(0, len(x), CHUNK):
            pooled, _ = self.pooled(x[lo : lo + CHUNK])
            z = np.maximum(pooled, 0) @ self.dense + self.bias
            z -= z.max(axis=1, keepdims=True)
            out[lo : lo + CHUNK] = z - np.log(np.exp(z).sum(axis=1, keepdims=True))
        return out


def windows(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows of the texts of a run (the last of each filled up with zeros): bytes, text, bytes held."""
    lengths = np.diff(starts)
    n = -(-lengths // WINDOW)
    text = np.repeat(np.arange(len(lengths)), n)
    k = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
    begin = starts[:-1][text] + k * WINDOW
    held = np.minimum(WINDOW, starts[1:][text] - begin)
    padded = np.concatenate((data, np.zeros(WINDOW, dtype=np.uint8)))
    x = np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[begin]
    x[np.arange(WINDOW) >= held[:, None]] = 0
    return x, text, held


def gradients(net: Network, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """The weighted cross-entropy of a batch, and its gradients by tables, dense and bias; only the places that won the
    pooling get one."""
    pooled, at = net.pooled(x, where=True)
    h = np.maximum(pooled, 0)
    z = h @ net.dense + net.bias
    p = np.exp(z - z.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    rows = np.arange(len(y))
    loss = float(-(weight[y] * np.log(p[rows, y])).sum() / len(y))
    p[rows, y] -= 1
    p *= weight[y][:, None] / len(y)
    back = (p @ net.dense.T) * (pooled > 0)
    grads = []
    for i, width in enumerate(WIDTHS):
        cols = slice(i * FILTERS, (i + 1) * FILTERS)
        for j in range(width):
            g = np.zeros((256, FILTERS), dtype=back.dtype)
            byte = np.take_along_axis(x, at[:, cols] + j, axis=1)
            np.add.at(g, (byte, np.broadcast_to(np.arange(FILTERS), byte.shape)), back[:, cols])
            grads.append(g)
    return loss, grads + [h.T @ p, p.sum(axis=0)]


def train(texts: list[bytes], labels: list[str]) -> Network:
    """Adam on the cross-entropy, languages weighted alike."""
    langs = sorted(set(labels))
    rng = np.random.default_rng(SEED)
    tables = [[rng.normal(0, 0.1, (256, FILTERS)).astype(np.float32) for _ in range(w)] for w in WIDTHS]
    net = Network(langs, tables, rng.normal(0, 0.1, (FILTERS * len(WIDTHS), len(langs))).astype(np.float32), np.zeros(len(langs), dtype=np.float32))
    starts = np.cumsum([0, *(min(len(t), WINDOW) for t in texts)])
    x, text, _ = windows(np.frombuffer(b"".join(t[:WINDOW] for t in texts), dtype=np.uint8), starts)
    y = np.searchsorted(langs, labels)[text]
    share = np.bincount(y, minlength=len(langs))
    weight = (len(y) / np.maximum(share, 1) / len(langs)).astype(np.float32)
    params = [t for ts in tables for t in ts] + [net.dense, net.bias]
    first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(max(EPOCHS, -(-LEAST_STEPS * BATCH // len(x)))):
        order = rng.permutation(len(x))
        for lo in range(0, len(order), BATCH):
            rows = order[lo : lo + BATCH]
            _, grads = gradients(net, x[rows], y[rows], weight)
            step += 1
            for q, g, m, v in zip(params, grads, first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                q -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return net


def held_out(id_col: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 5 == 0


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Network | None:
    """The network for the languages of the labelled rows that aren't held out; None without such rows.

    The sample are the ``SAMPLE_DOCS`` smallest hashes of identifier and text. A threshold on the hash, from the number
    of rows, leaves little more than the sample before anything is sorted or sent.
    """
    rows = docs.where(~held_out(id_col) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & (F.octet_length(text_col) > 0))
    blob = F.col(text_col).cast("binary")
    room = F.greatest(F.octet_length(text_col) - WINDOW + 1, F.lit(1))
    key = F.xxhash64(F.lit(SEED), F.col(id_col), text_col)
    n = rows.count()
    some = min(1.0, 2 * (SAMPLE_DOCS + 100) / max(n, 1))
    if some < 1:
        rows = rows.where(key < int((2 * some - 1) * (1 << 63)))
    parts = [F.substring(blob, (F.pmod(F.xxhash64(key, F.lit(i)), room) + 1).cast("int"), F.lit(WINDOW)) for i in range(SAMPLE_WINDOWS)]
    # repeated rows have one key; they are one row of the sample, and go as one over the exchange
    found = rows.groupBy(key.alias("key"), F.col(lang_col).cast("string").alias("lang")).agg(F.first(F.array(*parts)).alias("parts"))
    sample = found.orderBy("key", "lang").limit(SAMPLE_DOCS).collect()
    if not sample:
        return None
    net = train([bytes(p) for r in sample for p in r["parts"]], [r["lang"] for r in sample for _ in r["parts"]])
    del sample
    trim()  # what training took on the driver
    return net


def predict(docs: DataFrame, net: Network | None, text_col: str = "text", names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """Adds the predicted language and its score under ``names`` (columns that have these names are replaced); takes
    nothing but the text."""
    lang_name, score_name = names
    kept = [c for c in docs.columns if c not in names]
    base = docs.select(*[docs[n] for n in kept])
    letters = F.coalesce(F.col(text_col), F.lit("")).rlike(r"\p{L}")
    if net is None:
        return base.withColumns({lang_name: F.lit(UNKNOWN), score_name: F.lit(0.0)})
    kinds = base.schema.add("_vg_letter", "boolean").add(lang_name, "string").add(score_name, "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            best, score = [], []
            for _, rows, data, starts in text_runs(b, text_col, RUN_BYTES):
                total = np.zeros((rows, len(net.langs)))
                x, text, held = windows(data, starts)
                np.add.at(total, text, net.log_probabilities(x) * held[:, None])
                total /= np.maximum(np.diff(starts), 1)[:, None]
                p = np.exp(total - total.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                best += p.argmax(axis=1).tolist()
                score += p.max(axis=1).tolist()
            letter = b.column(b.num_columns - 1).to_pylist()
            lang = pa.array([net.langs[i] if ok else UNKNOWN for i, ok in zip(best, letter, strict=True)], pa.string())
            value = pa.array([s if ok else 0.0 for s, ok in zip(score, letter, strict=True)], pa.float64())
            yield pa.RecordBatch.from_arrays([*b.columns, lang, value], [*b.schema.names, lang_name, score_name])

    return base.withColumn("_vg_letter", letters).mapInArrow(frugal(run), kinds).drop("_vg_letter")


def keep_identified(docs: DataFrame, least: float = MIN_SCORE) -> DataFrame:
    """The documents whose language the network tells, all columns as they were; undetermined or doubtful ones (score
    under ``least``) go, and so do null texts and texts without a letter."""
    names = ("_vg_lang", "_vg_score")
    found = predict(docs, learn(docs), names=names)
    return found.where((F.col(names[0]) != UNKNOWN) & (F.col(names[1]) >= least)).select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9: every document's language."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    net = learn(docs)
    return predict(docs.select("doc_id", "text"), net).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
