from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from strandline.llm import gru, lm
from strandline.llm import textops as tx
from strandline.llm.common import shipped


def test_all_training_documents_are_learned_from(spark):
    """Frequent words are those of the whole corpus, and every training token is fitted once over the rounds."""
    own = F.concat(F.lit("w"), (F.col("id") % 1200).cast("string"))
    text = F.when(F.col("id") % 100 == 7, F.lit("zig zag " * 20)).otherwise(F.concat_ws(" ", F.array_repeat(own, 20)))
    docs = shipped(spark).range(0, 3000, 1, 3).select(F.col("id").alias("doc_id"), text.alias("text"))
    d = docs.select("doc_id", "text", (~lm.held_out("doc_id", lm.MOD, lm.REST)).alias("train"), F.xxhash64("doc_id").alias("key"))
    texts = [r["text"] for r in d.where("train").collect()]
    counts = Counter(w for t in texts for w in t.split())
    v = lm.vocabulary(lm.common_words(lm.totals_of(d)), len(texts))
    of = {w: int(h) for w in counts for _, _, t in tx.chunks(pa.array([w])) for h in gru.words_of(t)[1]}
    least = sorted(counts.values(), reverse=True)[gru.FREQUENT - 1]
    chosen = set(v.hashes.tolist())
    assert len(chosen) == gru.FREQUENT and (np.diff(v.hashes.astype(object)) > 0).all()
    assert all((n >= least) if of[w] in chosen else (n <= least) for w, n in counts.items())
    model, tokens = gru.Model(v), 0
    for r in range(2):
        n, model.p = lm.averaged(lm.one_round(d, model, r, 2, 1).collect())
        tokens += n
    assert tokens == sum(counts.values()) + len(texts) > 1500 * 21
    ids, first = lm.token_ids(pa.array(["zig zag zig zag zig zag"]), v)
    assert model.score(ids, first)[0] > gru.Model(v).score(ids, first)[0]
