"""Operator 6: sharding by balanced label propagation.

Linked documents share a hub (for equal texts: the text's hash), so links are a star around it and not all pairs. Hubs
heavier than a twentieth of a shard are few, whatever the input (twenty for each shard): they are placed first, the
heaviest where most room is, and only one that no shard has room for is cut. For all others an iteration lets every hub
take the shard that most of its documents are in, and joins that label back: a document elsewhere wants to move there.
How many may go from one shard to another is settled on the driver from the shards x shards table of wishes, so that no
shard passes its quota; a hash of the hub decides who goes, so that documents of a hub move together. After that every
shard is cut to its exact share: the rows that go last are those without links, so this last step cuts next to no edges.

The law is ``rows`` (counts at most one apart, exact) or ``bytes`` (sizes near equal, not exact: rows without links
stay where their hash puts them).

Defined results: null texts are empty and equal to each other; repeated rows are separate documents that count each; null
identifiers are placed like all others; an empty table gives no rows; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verigate.llm.common import discard, number_rows, staged

#: Iterations at most, the share of the weight whose wishes end them, and the room above an equal share while they run.
ROUNDS, SETTLED, SLACK = 12, 0.0002, 0.03
#: Hubs of more than this part of an equal share are placed one by one.
HEAVY = 0.05
_PARTS = 1 << 20


def moves_allowed(wishes: np.ndarray, sizes: np.ndarray, quota: float) -> np.ndarray:
    """The part (0 to 1) of the wishes i -> j that can be met, so that no shard ends above its quota."""
    part = np.where(wishes > 0, 1.0, 0.0)
    for _ in range(100):
        x = wishes * part
        after = sizes + x.sum(axis=0) - x.sum(axis=1)
        over = np.flatnonzero((after > quota * (1 + 1e-9)) & (x.sum(axis=0) > 0))
        if not len(over):
            break
        for j in over:
            incoming = x[:, j].sum()
            part[:, j] *= max(0.0, (incoming - (after[j] - quota)) / incoming)
    return part


def place_heavy(weights: list[int], shards: int, share: float) -> tuple[list[list[tuple[int, float]]], np.ndarray]:
    """For each heavy hub (by falling weight) its shards, each with the part of it up to there; and the shards' loads."""
    loads, out = np.zeros(shards), []
    for w in weights:
        parts, left = [], float(w)
        while left > 0:
            j = int(loads.argmin())
            room = max(share - loads[j], 0.0)
            n = left if left <= room or room <= 0 or left <= share * HEAVY else room
            loads[j] += n
            left -= n
            parts.append((j, float(1.0 - left / w)))
        out.append(parts)
    return out, loads


def propagate(rows: DataFrame, hubs: DataFrame, shards: int, law: str) -> DataFrame:
    """rows with doc_id, hub, weight to the same with linked (are there others of its hub?) and shard.

    ``hubs`` has hub, load (the weight of its rows) and copies (their number), of hubs with several rows.
    """
    spark = rows.sparkSession
    total = rows.agg(F.sum("weight").alias("w"), F.count(F.lit(1)).alias("n")).first()
    share = (total["w"] or 0) / shards
    heavy = hubs.where(F.col("load") > share * HEAVY).orderBy(F.col("load").desc(), "hub").collect()  # under shards / HEAVY rows
    parts, loads = place_heavy([r["load"] for r in heavy], shards, share)
    placed = spark.createDataFrame([(r["hub"], j, upto) for r, ps in zip(heavy, parts, strict=True) for j, upto in ps], "of long, to int, upto double")
    placed = placed.groupBy("of").agg(F.array_sort(F.collect_list(F.struct("upto", "to"))).alias("places"))
    kept = rows.join(F.broadcast(placed), rows["hub"] == placed["of"], "left").drop("of")
    draw = F.pmod(F.xxhash64("doc_id", F.lit("place")), F.lit(_PARTS)) / F.lit(float(_PARTS))
    fixed = F.get(F.filter("places", lambda p: p["upto"] > draw), 0)["to"]
    own = F.when(F.col("places").isNotNull(), F.coalesce(fixed, F.element_at("places", -1)["to"])).otherwise(F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int"))
    light = hubs.where(F.col("load") <= share * HEAVY).select(F.col("hub").alias("light"))
    now = kept.join(light, kept["hub"] == light["light"], "left").withColumns({"shard": own, "tied": F.col("light").isNotNull(), "linked": F.col("light").isNotNull() | F.col("places").isNotNull()})
    now = staged(now.select(*rows.columns, "shard", "tied", "linked"), "state")
    # rows without links fill up to exact counts at the end, so under the law ``rows`` only the linked have a quota
    counted = F.col("weight") if law == "bytes" else F.when(F.col("linked"), F.col("weight")).otherwise(0)
    bound = now.agg(F.sum(counted).alias("w")).first()["w"] or 0
    quota = max(share, bound / shards * (1 + SLACK))
    for turn in range(ROUNDS if total["n"] else 0):
        votes = now.where("tied").groupBy("hub", "shard").agg(F.sum("weight").alias("votes"))
        label = votes.groupBy("hub").agg(F.max(F.struct("votes", F.xxhash64("hub", "shard").alias("tie"), "shard")).alias("best")).select(F.col("hub").alias("of"), F.col("best.shard").alias("label"))
        wished = staged(now.join(label, F.when(F.col("tied"), F.col("hub")) == F.col("of"), "left").drop("of").withColumn("label", F.coalesce("label", "shard")), "wishes")
        sizes, wishes = np.zeros(shards), np.zeros((shards, shards))
        for r in wished.groupBy("shard", "label").agg(F.sum("weight").alias("w"), F.sum(counted).alias("c")).collect():  # shards x shards rows
            sizes[r["shard"]] += r["c"]
            if r["shard"] != r["label"]:
                wishes[r["shard"], r["label"]] = r["w"]
        part = moves_allowed(wishes, sizes, quota)
        if (wishes * part).sum() <= SETTLED * total["w"]:
            break
        table = F.array(*[F.lit(int(p * _PARTS)) for p in part.ravel()])
        goes = F.pmod(F.xxhash64(F.lit(turn), "hub"), F.lit(_PARTS)) < F.get(table, F.col("shard") * shards + F.col("label"))
        before, now = now, staged(wished.withColumn("shard", F.when(goes, F.col("label")).otherwise(F.col("shard"))).drop("label"), "state")
        discard(before, wished)
    return now


def cut_links(placed: DataFrame) -> DataFrame:
    """One row: hubs with several documents, those that stand in several shards, and links (star edges) that are cut."""
    per = placed.groupBy("hub", "shard").agg(F.count(F.lit(1)).alias("n")).groupBy("hub").agg(F.sum("n").alias("n"), F.max("n").alias("most"), F.count(F.lit(1)).alias("in"))
    return per.where("n > 1").agg(F.count(F.lit(1)).alias("hubs"), F.count_if(F.col("in") > 1).alias("cut"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("links"), F.coalesce(F.sum(F.col("n") - F.col("most")), F.lit(0)).alias("cut_links"))


def shard_documents(docs: DataFrame, shards: int = 8, law: str = "rows", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, size (bytes of its text and one), text_crc32, law, shard, slot. Equal texts are linked."""
    if law not in ("rows", "bytes"):
        raise ValueError(f"no such law: {law}")
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text, F.octet_length(text)).alias("hub"))
    base = staged(base, "nodes").withColumn("weight", F.lit(1).cast("long") if law == "rows" else F.col("size"))
    hubs = base.groupBy("hub").agg(F.sum("weight").alias("load"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    state = propagate(base, staged(hubs, "hubs"), shards, law)
    # linked rows first, a hub's rows together: what a shard has too many are rows without links, at its end
    hub = F.when(F.col("linked"), F.col("hub")).otherwise(F.xxhash64("doc_id"))
    placed = number_rows(state.select("doc_id", "size", "text_crc32", (~F.col("linked")).alias("free"), hub.alias("hub"), "shard"), ["shard"], ["free", "hub", "doc_id"], "slot")
    out = ["doc_id", "size", "text_crc32", F.lit(law).alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")]
    if law == "bytes":
        return placed.select(*out)
    placed = staged(placed, "placed")
    have = np.zeros(shards, dtype=np.int64)
    for r in placed.groupBy("shard").count().collect():  # one row for each shard
        have[r["shard"]] = r["count"]
    quota = np.full(shards, have.sum() // shards)
    quota[np.argsort(-have, kind="stable")[: have.sum() % shards]] += 1
    limits = F.array(*[F.lit(int(q)) for q in quota])
    kept = placed.where(F.col("slot") < F.get(limits, "shard"))
    excess = number_rows(placed.where(F.col("slot") >= F.get(limits, "shard")).withColumn("all", F.lit(0)), ["all"], ["free", "hub", "doc_id"], "nth")
    gaps, at = [], 0
    for j in range(shards):
        room = int(max(0, quota[j] - have[j]))
        gaps.append((j, at, at + room, int(have[j])))
        at += room
    gaps = docs.sparkSession.createDataFrame(gaps, "to int, first long, beyond long, used long")  # one row for each shard
    moved = excess.join(F.broadcast(gaps), (F.col("nth") >= F.col("first")) & (F.col("nth") < F.col("beyond")))
    moved = moved.select("doc_id", "size", "text_crc32", "free", "hub", F.col("to").alias("shard"), (F.col("used") + F.col("nth") - F.col("first")).alias("slot"))
    return kept.unionByName(moved).select(*out)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6: all documents in eight shards of equal counts."""
    return shard_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
