"""One query for each operator of this subpackage, and the SQL of those that SQL can express."""

from . import bpe, html, jaccard, langid, licenses, mixing, neighbours, quality, sharding, substring

QUERIES = {
    "op1_substring_dedup": substring.op1,
    "op2_mix_sources": mixing.op2,
    "op3_main_text": html.op3,
    "op4_byte_bpe": bpe.op4,
    "op5_quality_rules": quality.op5,
    "op6_nearest": neighbours.op6,
    "op7_shards": sharding.op7,
    "op8_jaccard_join": jaccard.op8,
    "op9_language_id": langid.op9,
    "op10_license_scan": licenses.op10,
}
ORACLES = {"op1_substring_dedup": substring.OP1_SQL, "op2_mix_sources": mixing.OP2_SQL, "op8_jaccard_join": jaccard.OP8_SQL}
