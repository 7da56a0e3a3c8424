"""The operators' queries by name, and SQL where it can express them."""

from __future__ import annotations

from verigate.llm import align, bytecnn, images, linededup, lzprint, merkle, minhash, overlap, packing, pieces, sharding, sstable, suffixes

QUERIES = {
    "op1_sstable": sstable.query,
    "op2_pieces": pieces.query,
    "op3_images": images.query,
    "op4_suffixes": suffixes.query,
    "op5_linededup": linededup.query,
    "op6_sharding": sharding.query,
    "op7_lzprint": lzprint.query,
    "op8_minhash": minhash.query,
    "op9_bytecnn": bytecnn.query,
    "op10_packing": packing.query,
    "op11_overlap": overlap.query,
    "op12_merkle": merkle.query,
    "op13_align": align.query,
}
ORACLE = {
    "op5_linededup": linededup.ORACLE,
    "op8_minhash": minhash.ORACLE,
    "op11_overlap": overlap.ORACLE,
    "op12_merkle": merkle.ORACLE,
}
