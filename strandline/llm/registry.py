"""The queries of this subpackage, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import gif, importance, lengths, lexical, licenses, lm, mixing, neighbours, order_minhash, packing, quality, simhash, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": mixing.op1_mixing,
    "op2_licenses": licenses.op2_licenses,
    "op3_simhash": simhash.op3_simhash,
    "op4_packing": packing.op4_packing,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_neighbours": neighbours.op6_neighbours,
    "op7_gif": gif.op7_gif,
    "op8_language_model": lm.op8_language_model,
    "op9_quality": quality.op9_quality,
    "op10_token_counts": lengths.op10_token_counts,
    "op11_ranked_search": lexical.op11_ranked_search,
    "op12_importance": importance.op12_importance,
    "op13_order_minhash": order_minhash.op13_order_minhash,
}

#: What the others give is learned, scheduled or approximate, or takes a tokenizer or another engine's hash. ``neighbours.EXACT`` is what op6 is measured by.
ORACLES: dict[str, str] = {"op11_ranked_search": lexical.SQL, "op12_importance": importance.SQL}
