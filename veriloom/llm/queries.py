"""The registered queries of this package."""

from . import (
    clusters,
    decontaminate,
    jaccard,
    mixing,
    odd_sketches,
    oracles,
    pseudonyms,
    quality,
    repeats,
    secrets,
    sharding,
    token_shards,
    vector_codes,
    vector_oracles,
    wrappers,
)

QUERIES = {
    "op1_mixing": mixing.op1_mixing,
    "op2_token_shards": token_shards.op2_token_shards,
    "op3_repeats": repeats.op3_repeats,
    "op4_secret_scan": secrets.op4_secret_scan,
    "op5_quality_rules": quality.op5_quality_rules,
    "op6_sharding": sharding.op6_sharding,
    "op7_jaccard_join": jaccard.op7_jaccard_join,
    "op8_decontamination": decontaminate.op8_decontamination,
    "op9_main_text": wrappers.op9_main_text,
    "op10_pseudonyms": pseudonyms.op10_pseudonyms,
    "op11_odd_sketches": odd_sketches.op11_odd_sketches,
    "op12_orchard_clusters": clusters.op12_orchard_clusters,
    "op13_vector_codes": vector_codes.op13_vector_codes,
}
#: The others have no SQL form: a permutation, a greedy schedule, inferred wrappers, keyed pseudonyms.
ORACLES = {
    "op1_mixing": mixing.OP1_SQL,
    "op3_repeats": oracles.OP3_SQL,
    "op4_secret_scan": oracles.OP4_SQL,
    "op5_quality_rules": quality.OP5_SQL,
    "op7_jaccard_join": oracles.OP7_SQL,
    "op8_decontamination": oracles.OP8_SQL,
    "op11_odd_sketches": oracles.OP11_SQL,
    "op12_orchard_clusters": vector_oracles.OP12_SQL,
    "op13_vector_codes": vector_oracles.OP13_SQL,
}
