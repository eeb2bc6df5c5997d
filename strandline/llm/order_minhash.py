"""Document fingerprints by Order MinHash, in DataFrame functions alone.

A text is its run of words (``\\S`` runs, cut after ``WIDEST`` code points, so text without
spaces has words too); its k-mers are all runs of ``K`` words (fewer words: the whole run).
Each k-mer is numbered by its occurrence, so texts are sets of different elements
(Marcais et al., 2019). For each of ``TUPLES`` hash functions two elements are selected
and put in the order in which the text has them; a hash of the two is the tuple's
component of the signature. Two signatures agree in a component if the same
elements are least in both texts and stand in the same order, so the share of
equal components falls with every insertion, deletion, change or move.

An aggregate keeps one least value, so the two selected are the least of those whose
hash is even and the least of those whose hash is odd: two least elements of
halves that the same hash function draws.

Plan: texts are dealt once, by the hash of their row; what stands on them (k-mers,
occurrence numbers, minima) stays in that partitioning, so k-mers are never
shuffled. The sort that numbers occurrences leaves a document's k-mers together, so the
aggregate that follows works on one document's minima at a time.

Defined results: rows that repeat both id and text are one document, and each has
that document's result; documents of one id follow each other by a hash of the text.
The order is by descending doc_id, null last, and begins anew after its end, so an
only document is followed by itself. Null text is empty; texts without words have one
fingerprint, and likeness 1 to each other. In texts of over 2^28 k-mers
places are compared modulo 2^28. Other columns are ignored; no rows give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import cut, dealt, ordered, sweep, table

#: Words of a k-mer.
K = 2
#: Code points of a word at most.
WIDEST = 16
#: Components of a signature. With two minima each it stays under the 100 columns up to which Spark compiles a stage as one.
TUPLES = 48
#: Bits of a packed minimum that hold the place.
PLACE = 28
PLACES = (1 << PLACE) - 1
#: Code points of a partition.
PORTION = 1 << 22
#: Places are under this.
PART = 1 << 32
#: From here on a packed minimum says that its half has no element.
NONE = 1 << 62


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(rf"\S{{1,{WIDEST}}}"), F.lit(0))


def kmer_hashes(word: Column, k: int = K) -> Column:
    """Hashes of all runs of ``k`` words, by place."""
    first = F.when(F.size(word) > 0, F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(word) - (k - 1))))
    return F.transform(first, lambda i: F.xxhash64(F.slice(word, i, k)))


def _seed(t: int) -> Column:
    """Another number for each hash function: odd multiples of the golden ratio's bits, as signed longs."""
    x = (2 * t + 1) * 0x9E3779B97F4A7C15 % (1 << 64)
    return F.lit(x - (1 << 64) * (x >> 63)).cast("long")


def _component(even: Column, odd: Column) -> Column:
    """Sixteen bits of a hash of the two selected elements, in the order of their places."""
    there = [F.when(x < NONE, x) for x in (even, odd)]
    e, o = (F.shiftrightunsigned(x, PLACE) for x in there)
    at = [F.coalesce(x.bitwiseAND(F.lit(PLACES)), F.lit(-1)) for x in there]
    both = F.when(at[0] <= at[1], F.xxhash64(F.lit(0), e, F.lit(1), o)).otherwise(F.xxhash64(F.lit(1), o, F.lit(0), e))
    return F.shiftrightunsigned(both, 48).cast("int")


def _least(by: list[str], rows: DataFrame, tuples: int) -> DataFrame:
    """By ``by`` the least packed elements: a hash without its last two bits, those of the place below, and bit 62 set for the other half."""
    return rows.groupBy(*by).agg(*(F.min(c).alias(c) for t in range(tuples) for c in (f"e{t}", f"o{t}")))


def signatures(texts: DataFrame, by: list[str], k: int = K, tuples: int = TUPLES) -> DataFrame:
    """``by``, edited (boolean) and signature (array of ``tuples`` ints under 65536): of each row's text, and of what its edit makes of it.

    ``texts`` has, besides ``by``, which tells rows apart, columns text, kept (what the edit
    leaves of its beginning) and edited (kept, and what comes instead of the rest; null: no
    edit). Words before kept's last are the same in both, so their k-mers are hashed and
    numbered once. If ``texts`` is partitioned by ``by``, nothing is shuffled.
    """
    # words are columns of their own, or each k-mer would split the text again
    split = texts.select(*by, words(F.col("text")).alias("own"), words(F.col("edited")).alias("new"), F.size(words(F.col("kept"))).alias("same"))
    shared = F.greatest(F.lit(0), F.col("same") - k)  # k-mers of all words but the last
    split = split.select(*by, shared.alias("shared"), kmer_hashes(F.col("own"), k).alias("own"), kmer_hashes(F.slice("new", shared + 1, F.greatest(F.size("new"), F.lit(0))), k).alias("new"))
    none = F.array().cast("array<bigint>")
    own, new = (F.coalesce(F.col(c), none) for c in ("own", "new"))
    each = split.select(*by, "shared", F.size(own).alias("n"), F.posexplode(F.concat(own, new)).alias("at", "kmer"))
    # part (0: in both, 1: the text's own, 2: the edit's) and place in one number, which sorts
    new_place = F.col("at") - F.col("n") + F.col("shared")
    at = F.when(F.col("at") < F.col("shared"), F.col("at").cast("long")).when(F.col("at") < F.col("n"), F.col("at") + F.lit(PART)).otherwise(new_place + F.lit(2 * PART))
    each = each.select(*by, "kmer", at.alias("at"))
    # an occurrence's number counts those before it in its own text
    before = Window.partitionBy(*by, "kmer").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    part = F.shiftright("at", 32)
    counts = [F.sum(F.when(part == p, 1).otherwise(0)).over(before) for p in range(3)]
    number = counts[0] + F.when(part == 0, 0).when(part == 1, counts[1]).otherwise(counts[2])
    each = each.select(*by, part.cast("int").alias("part"), F.col("at").bitwiseAND(F.lit(PLACES)).alias("low"), F.xxhash64("kmer", number).alias("element"))
    each = each.select(*by, "part", "low", *(F.xxhash64(F.col("element").bitwiseXOR(_seed(t))).alias(f"h{t}") for t in range(tuples)))
    halves = []
    for t in range(tuples):
        h = F.col(f"h{t}")
        even = F.shiftrightunsigned(h, 2).bitwiseAND(F.lit(~PLACES)).bitwiseOR(F.col("low")).bitwiseOR(F.shiftleft(h, 62).bitwiseAND(F.lit(NONE)))
        halves.append(even.alias(f"e{t}"))
    each = each.select(*by, "part", *halves)
    each = each.groupBy(*by, "part").agg(*(x for t in range(tuples) for x in (F.min(f"e{t}").alias(f"e{t}"), F.min(F.col(f"e{t}").bitwiseXOR(F.lit(NONE))).alias(f"o{t}"))))
    of = F.when(F.col("part") == 0, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.col("part") == 2))
    mins = _least([*by, "is_edit"], each.withColumn("is_edit", F.explode(of)), tuples)
    return mins.select(*by, "is_edit", F.array(*(_component(F.col(f"e{t}"), F.col(f"o{t}")) for t in range(tuples))).alias("signature"))


def wordless(tuples: int = TUPLES) -> Column:
    """The signature of a text without words."""
    nothing = F.lit(NONE)
    return F.array_repeat(_component(nothing, nothing), tuples)


def as_text(signature: Column) -> Column:
    """Four hexadecimal digits for each component."""
    return F.concat_ws("", F.transform(signature, lambda x: F.lower(F.lpad(F.hex(x), 4, "0"))))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal components."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda same: same)) / F.size(a)


def rows_of(docs: DataFrame) -> DataFrame:
    """doc_id, text and (u, v): two hashes of both, which name a document."""
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return d.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("u"), F.xxhash64(F.lit(13), "text", "doc_id").alias("v"))


def followed(docs: DataFrame) -> DataFrame:
    """(u, v, next_u, next_v, n_chars) of each document: fixed in the checkpoint folder, no text in it."""
    d = rows_of(docs).select("u", "v", "doc_id", F.char_length("text").cast("long").alias("n_chars"))
    d = d.groupBy("u", "v").agg(F.first("doc_id").alias("doc_id"), F.first("n_chars").alias("n_chars"))
    n = ordered(d, F.desc("doc_id"), F.col("u"), F.col("v"), name="at")
    total = n.agg(F.count("*")).first()[0]
    after = n.select(F.pmod(F.col("at") - 2, F.lit(max(total, 1))).alias("at"), F.col("u").alias("next_u"), F.col("v").alias("next_v"))
    return cut(n.withColumn("at", F.col("at") - 1).join(after, "at").select("u", "v", "next_u", "next_v", "n_chars"))


def with_edits(docs: DataFrame, order: DataFrame) -> DataFrame:
    """(u, v, n_chars, text, kept, edited): the last third of each document's code points replaced by the first as many of the next one's."""
    texts = rows_of(docs).groupBy("u", "v").agg(F.first("text").alias("text"))
    wanted = order.select(F.col("u").alias("to_u"), F.col("v").alias("to_v"), F.col("next_u").alias("u"), F.col("next_v").alias("v"), "n_chars", F.expr("cast(n_chars div 3 as int)").alias("gone"))
    heads = texts.join(wanted, ["u", "v"]).select(F.col("to_u").alias("u"), F.col("to_v").alias("v"), "n_chars", "gone", F.substring("text", F.lit(1), F.col("gone")).alias("head"))
    kept = F.substring("text", F.lit(1), F.col("n_chars").cast("int") - F.col("gone"))
    d = texts.join(heads, ["u", "v"]).select("u", "v", "n_chars", "text", kept.alias("kept"), "head")
    return d.select("u", "v", "n_chars", "text", "kept", F.concat("kept", "head").alias("edited"))


def fingerprints(docs: DataFrame, k: int = K, tuples: int = TUPLES) -> DataFrame:
    """doc_id, fingerprint of every row."""
    texts = rows_of(docs).groupBy("u", "v").agg(F.first("text").alias("text"))
    texts = texts.select("u", "v", "text", F.col("text").alias("kept"), F.lit(None).cast("string").alias("edited"))
    prints = signatures(texts, ["u", "v"], k, tuples).where("NOT is_edit")
    rows = rows_of(docs).select("doc_id", "u", "v").join(prints, ["u", "v"], "left")
    return rows.select("doc_id", as_text(F.coalesce("signature", wordless(tuples))).alias("fingerprint"))


def edited_fingerprints(docs: DataFrame, k: int = K, tuples: int = TUPLES) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row."""
    order = followed(docs)
    sweep(docs.sparkSession)  # its exchanges are not kept beside those of the texts
    texts = with_edits(docs, order)
    of = lambda edited: F.first(F.when(F.col("is_edit") == edited, F.col("signature")), ignorenulls=True)
    prints = signatures(texts, ["u", "v"], k, tuples).groupBy("u", "v").agg(of(False).alias("signature"), of(True).alias("edited_signature"))
    facts = texts.select("u", "v", "n_chars", F.sha2("edited", 256).alias("edited_sha256"))
    prints = facts.join(prints, ["u", "v"], "left").withColumns({c: F.coalesce(c, wordless(tuples)) for c in ("signature", "edited_signature")})
    # so many partitions that the k-mers of one are sorted in memory, whatever the session's number is
    size = order.agg(F.coalesce(F.sum("n_chars"), F.lit(0))).first()[0]
    with dealt(docs.sparkSession, -(-size // PORTION)):
        prints = cut(prints)
    sweep(docs.sparkSession)  # nor those of the texts beside those of what follows
    following = prints.select(F.col("u").alias("next_u"), F.col("v").alias("next_v"), F.col("signature").alias("next_signature"))
    result = prints.join(order.drop("n_chars"), ["u", "v"]).join(following, ["next_u", "next_v"])
    result = result.select(
        "u",
        "v",
        "n_chars",
        "edited_sha256",
        as_text(F.col("signature")).alias("fingerprint"),
        as_text(F.col("edited_signature")).alias("edited_fingerprint"),
        likeness(F.col("signature"), F.col("edited_signature")).alias("near_edited"),
        likeness(F.col("signature"), F.col("next_signature")).alias("near_next"),
    )
    return rows_of(docs).select("doc_id", "u", "v").join(result, ["u", "v"]).drop("u", "v")


def op13_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(table(spark, sf_dir, "documents"))
