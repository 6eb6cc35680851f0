"""The subpackage's queries and the SQL that some of them must agree with."""

from __future__ import annotations

from . import ann_forest, bpe, cross_entropy, fuzzy_lines, jaccard, matroska, merkle, minhash, packing, quality, ranked, url_filter, warc

QUERIES = {
    f.__name__: f
    for f in (
        matroska.op1_matroska,
        cross_entropy.op2_cross_entropy,
        packing.op3_binary_packing,
        fuzzy_lines.op4_fuzzy_lines,
        quality.op5_quality,
        warc.op6_warc,
        ann_forest.op7_hash_forest,
        url_filter.op8_url_filter,
        bpe.op9_byte_bpe,
        jaccard.op10_jaccard_join,
        ranked.op11_ranked_search,
        minhash.op12_minhash_join,
        merkle.op13_merkle_manifest,
    )
}
ORACLES = {
    "op2_cross_entropy": cross_entropy.SQL,
    "op6_warc": warc.SQL,
    "op8_url_filter": url_filter.SQL,
    "op10_jaccard_join": jaccard.SQL,
    "op11_ranked_search": ranked.SQL,
    "op12_minhash_join": minhash.SQL,
    "op13_merkle_manifest": merkle.SQL,
}
