"""The queries of this subpackage, and their SQL where SQL can express them."""

from . import decontamination, jaccard, media, packing, quality, sharding, suffix_array, suffix_tree, toxicity, warc
from .common import ship

OPERATORS = {
    "op1_decontamination": decontamination.op1,
    "op2_toxicity": toxicity.op2,
    "op3_ngram_jaccard": jaccard.op3,
    "op4_best_fit_packing": packing.op4,
    "op5_substring_dedup": suffix_tree.op5,
    "op6_media_chunks": media.op6,
    "op7_feistel_sharding": sharding.op7,
    "op8_quality": quality.op8,
    "op9_suffix_array_dedup": suffix_array.op9,
    "op10_warc_transactions": warc.op10,
}
QUERIES = {name: lambda spark, sf_dir, f=f: f(ship(spark), sf_dir) for name, f in OPERATORS.items()}
SQL = {
    "op1_decontamination": decontamination.OP1_SQL,
    "op3_ngram_jaccard": jaccard.OP3_SQL,
    "op5_substring_dedup": suffix_tree.OP5_SQL,
    "op7_feistel_sharding": sharding.OP7_SQL,
    "op9_suffix_array_dedup": suffix_array.OP9_SQL,
    "op10_warc_transactions": warc.OP10_SQL,
}
