"""The queries of the training-data operators, and their SQL."""

from __future__ import annotations

from nearfield.llm import ans, kdshards, langid, media, mixing, packing, pivots, setsketch, urlfilter, warc

QUERIES = {
    "op1_language_ppm": langid.op1,
    "op2_mix_water_filling": mixing.op2,
    "op3_media_chunks": media.op3,
    "op4_pivot_permutation": pivots.op4,
    "op5_rans_ids": ans.op5,
    "op6_warc_segments": warc.op6,
    "op7_setsketch": setsketch.op7,
    "op8_grouping_genetic": packing.op8,
    "op9_bloom_cascade": urlfilter.op9,
    "op10_kd_shards": kdshards.op10,
}

ORACLE = {
    "op2_mix_water_filling": mixing.OP2_SQL,
    "op3_media_chunks": media.OP3_SQL,
    "op4_pivot_permutation": pivots.OP4_SQL,
    "op6_warc_segments": warc.OP6_SQL,
    "op7_setsketch": setsketch.OP7_SQL,
    "op9_bloom_cascade": urlfilter.OP9_SQL,
}
