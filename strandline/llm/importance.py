"""Target-distribution importance resampling (DSIR), counted by DuckDB in each partition.

A task hands its Arrow batches to a DuckDB connection of its own. SQL there lower-cases
and splits the texts, unnests the words, joins runs of them to n-grams by windows,
hashes each with a registered function (zlib's CRC-32) and counts by document and by
bucket. The bucket counts of every document are written to Parquet in the shared checkpoint
folder; Spark merges them to the counts of the corpus, gives each bucket its
gain, and scores, draws and ranks the documents (Xie et al., 2023: importance
weights of hashed n-grams, resampled without replacement by Gumbel noise).

The noise is a hash of the id, so a document's score depends on nothing but its text, its
id and the two distributions.

Defined results: null and empty texts have no feature, weight 0, and are never drawn;
a null id counts as empty text in the noise and comes last among equal scores;
repeated rows are documents each, and rows that share an id and a score go by
n_features, then as they lie; without target rows all gains come from the smoothing alone;
other columns are ignored; no rows give no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textops as tx
from .common import checkpoint_dir, cut, ordered, table

NGRAM = 1
BUCKETS = 10_000
LEAST_WORDS = 20
PERCENT = 10
SALT = "2024"
#: Bytes of text that DuckDB is given at once: a window over n-grams holds their words.
CHUNK = 1 << 22

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_COUNTS = "doc_id long, n_words long, buckets array<int>, counts array<int>"


def counting_sql(ngram: int, buckets: int) -> str:
    """SQL over ``batch`` (row, text): row, n_words, and its buckets with their counts, of rows with words."""
    runs = " UNION ALL ".join(
        "SELECT row, " + " || ' ' || ".join(["word", *(f"lead(word, {j}) OVER w" for j in range(1, n))]) + " AS feature FROM words" + (" WINDOW w AS (PARTITION BY row ORDER BY place)" if n > 1 else "")
        for n in range(1, ngram + 1)
    )
    return f"""
        WITH split AS (SELECT row, regexp_extract_all(translate(text, '{_UPPER}', '{_UPPER.lower()}'), '{WORD}') AS word FROM batch),
        words AS (SELECT row, unnest(word) AS word, unnest(range(len(word))) AS place FROM split),
        features AS ({runs}),
        counted AS (SELECT row, crc(feature) % {buckets} AS bucket, count(*) AS n FROM features WHERE feature IS NOT NULL GROUP BY row, bucket),
        lists AS (SELECT row, list(CAST(bucket AS INTEGER) ORDER BY bucket) AS buckets, list(CAST(n AS INTEGER) ORDER BY bucket) AS counts FROM counted GROUP BY row)
        SELECT row, n_words, buckets, counts FROM lists JOIN (SELECT row, len(word) AS n_words FROM split) USING (row)
    """


def _crc(features: pa.ChunkedArray) -> pa.Array:
    return pa.array([zlib.crc32(x.encode()) for x in features.to_pylist()], pa.int64())


def bucket_counts(texts: DataFrame, ngram: int = NGRAM, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_words, and the buckets of a document's features (ascending) with their counts; a row for each of ``texts``."""
    query = counting_sql(ngram, buckets)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        with duckdb.connect(config={"threads": 1, "memory_limit": "512MB"}) as con:
            con.create_function("crc", _crc, ["VARCHAR"], "BIGINT", type="arrow")
            for whole in batches:
                for a, b, _ in tx.chunks(whole.column("text"), CHUNK):
                    part = whole.slice(a, b - a)
                    batch = pa.table({"row": pa.array(range(len(part)), pa.int32()), "text": part.column("text")})  # noqa: F841
                    con.register("batch", batch)
                    found = con.sql(query).to_arrow_table()
                    con.unregister("batch")
                    # rows without words have no counts
                    row = found.column("row").to_numpy()
                    at = pa.array([None] * len(part), pa.int64())
                    if len(row):
                        place = [None] * len(part)
                        for i, r in enumerate(row.tolist()):
                            place[r] = i
                        at = pa.array(place, pa.int64())
                    out = [found.column(c).combine_chunks().take(at) for c in ("n_words", "buckets", "counts")]
                    kinds = (pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()))
                    yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(x.cast(k) for x, k in zip(out, kinds))], ["doc_id", "n_words", "buckets", "counts"])

    return texts.mapInArrow(count, _COUNTS)


def spilled(counts: DataFrame, name: str) -> DataFrame:
    """The counts, written to Parquet in the shared checkpoint folder and read from there."""
    import uuid

    spark = counts.sparkSession
    checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
    counts.write.parquet(path)
    return spark.read.parquet(path)


def merged(counts: DataFrame) -> DataFrame:
    """bucket, n: at most as many rows as there are buckets."""
    return counts.select(F.explode(F.arrays_zip("buckets", "counts")).alias("x")).groupBy(F.col("x.buckets").alias("bucket")).agg(F.sum("x.counts").alias("n"))


def gains(source: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """One row: ``gains``, an array with the gain of each bucket in thousandths."""
    both = source.withColumnRenamed("n", "s").join(target.withColumnRenamed("n", "t"), "bucket", "full")
    every = source.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(both, "bucket", "left").fillna(0, ["s", "t"])
    total = every.agg(F.sum("s").alias("source_total"), F.sum("t").alias("target_total"))
    d = every.crossJoin(F.broadcast(total))  # one row
    up = (F.col("t") + 1).cast("double") * (F.col("source_total") + buckets).cast("double")
    down = (F.col("s") + 1).cast("double") * (F.col("target_total") + buckets).cast("double")
    gain = F.floor(1000 * F.ln(up / down)).cast("long")
    # ``buckets`` rows, by contract of the parameter
    return d.groupBy().agg(F.transform(F.sort_array(F.collect_list(F.struct("bucket", gain.alias("gain")))), lambda x: x["gain"]).alias("gains"))


def noise(doc_id: Column, salt: str = SALT) -> Column:
    """Gumbel noise in thousandths, rounded down, from a hash of the id."""
    text = F.concat(F.lit(f"{salt}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.ln(-F.ln((h + 0.5) / 4294967296.0))).cast("long")


def resampled(
    docs: DataFrame, target: DataFrame, ngram: int = NGRAM, buckets: int = BUCKETS, least_words: int = LEAST_WORDS, percent: int = PERCENT, salt: str = SALT
) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every row of ``docs``; rank is null where it isn't drawn. ``target`` has column text."""
    counts = spilled(bucket_counts(docs.select("doc_id", "text"), ngram, buckets), "dsir")
    wanted = bucket_counts(target.select(F.lit(0).cast("long").alias("doc_id"), "text"), ngram, buckets)
    gain = cut(gains(merged(counts), merged(wanted), buckets))
    n = F.aggregate(F.coalesce("counts", F.array().cast("array<int>")), F.lit(0).cast("long"), lambda a, x: a + x)
    sums = F.aggregate(F.zip_with("buckets", "counts", lambda b, c: F.element_at("gains", b + 1) * c), F.lit(0).cast("long"), lambda a, x: a + x)
    d = counts.crossJoin(F.broadcast(gain))  # one row of ``buckets`` numbers
    d = d.select("doc_id", F.coalesce("n_words", F.lit(0)).alias("n_words"), n.alias("n_features"), F.coalesce(sums, F.lit(0)).alias("sum"))
    # down also below zero
    mean = F.when(F.col("n_features") > 0, F.expr("(sum - pmod(sum, n_features)) div n_features")).otherwise(F.lit(0))
    d = d.select("doc_id", "n_words", "n_features", mean.cast("long").alias("weight"))
    d = d.withColumn("score", F.col("weight") + noise(F.col("doc_id"), salt)).withColumn("able", F.col("n_words") >= least_words)
    at = ordered(d.drop("n_words"), F.desc("able"), F.desc("score"), F.asc_nulls_last("doc_id"), F.col("n_features"), name="at")
    drawn = at.agg(F.expr(f"count_if(able) * {int(percent)} div 100")).first()[0]
    return at.select("doc_id", "n_features", "weight", "score", F.when(F.col("at") <= drawn, F.col("at")).cast("long").alias("rank"))


def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: CRC-32 by its definition: the remainders of all bytes, then a byte at a time over each different word.
SQL = rf"""
WITH RECURSIVE steps AS (
    SELECT range AS byte, range AS r, 0 AS n FROM range(256)
    UNION ALL
    SELECT byte, CASE WHEN r % 2 = 1 THEN xor(r // 2, 3988292384) ELSE r // 2 END, n + 1 FROM steps WHERE n < 8
),
rest AS (SELECT list(r ORDER BY byte) AS t FROM steps WHERE n = 8),
words AS (
    SELECT kind, row, doc_id, regexp_extract_all(translate(text, '{_UPPER}', '{_UPPER.lower()}'), '{WORD}') AS w
    FROM (SELECT 0 AS kind, row_number() OVER () AS row, doc_id, text FROM documents UNION ALL SELECT 1, row_number() OVER (), NULL, text FROM benchmark)
),
each_word AS (SELECT kind, row, unnest(w) AS word FROM words),
bytes AS (SELECT word, hex(encode(word)) AS x FROM (SELECT DISTINCT word FROM each_word)),
hashed AS (
    SELECT word, xor(list_reduce(list_prepend(4294967295, list_transform(range(len(x) // 2), lambda i: CAST('0x' || x[2 * i + 1 : 2 * i + 2] AS BIGINT))),
        lambda a, b: xor(a // 256, t[xor(a % 256, b) + 1])), 4294967295) % {BUCKETS} AS bucket
    FROM bytes, rest
),
features AS (SELECT kind, row, bucket FROM each_word JOIN hashed USING (word)),
totals AS (SELECT count(*) FILTER (kind = 0) AS s_all, count(*) FILTER (kind = 1) AS t_all FROM features),
gains AS (
    SELECT bucket, CAST(floor(1000 * ln((t + 1) * (s_all + {BUCKETS}) / ((s + 1) * (t_all + {BUCKETS})))) AS BIGINT) AS gain
    FROM (SELECT bucket, count(*) FILTER (kind = 0) AS s, count(*) FILTER (kind = 1) AS t FROM features GROUP BY bucket), totals
),
weights AS (
    SELECT row, count(*) AS n, CAST(floor(sum(gain) / count(*)) AS BIGINT) AS weight FROM features JOIN gains USING (bucket) WHERE kind = 0 GROUP BY row
),
scored AS (
    SELECT words.row, doc_id, CAST(len(w) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
        coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || sha256('{SALT}:' || doc_id)[1:8] AS BIGINT) + 0.5) / 4294967296))) AS BIGINT) AS score
    FROM words LEFT JOIN weights ON words.row = weights.row WHERE kind = 0
),
ranked AS (SELECT row, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM scored WHERE n_features >= {LEAST_WORDS}),
drawn AS (SELECT {PERCENT} * count(*) // 100 AS most FROM ranked)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= most THEN rank END AS rank FROM scored LEFT JOIN ranked USING (row), drawn
"""
