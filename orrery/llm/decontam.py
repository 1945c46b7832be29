"""Benchmark decontamination: a prefix-filtered set join in DataFrame functions alone.

A window is WINDOW consecutive words of an item, or all of a shorter item. As a set of shingles (SHINGLE consecutive
words) it is contained in a document only if its rarest shingle is, so that one shingle is its prefix. Documents meet
windows on this shingle; length and position bound where the window would lie; the words there are then compared.
A benchmark of few windows is broadcast. Of a larger one, a bit for each prefix is: the corpus passes this sieve, and what
is left meets the windows by a join.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import staged

#: Words of a window and of a shingle; pairs of window and item, or tokens, that are broadcast; items in a row; hit documents that are broadcast at most.
WINDOW, SHINGLE, BLOCK, ITEMS, BROADCAST_ROWS = 10, 3, 100_000, 1000, 500_000
#: A sieve for more of them: its buckets, bits for each token, and 64-bit words of a bucket at most (128 MB in all).
BUCKETS, BITS, MOST_WORDS = 1024, 16, 1 << 14

# What parts words, before and after A-Z are lower-cased.
BREAK = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def _words(text: Column) -> Column:
    """Words as written. The first or last is '' where text begins or ends with a break; '' matches nothing."""
    return F.split(text, BREAK)


def _shingle(words: Column, at: Column, size: int) -> Column:
    """Hash of size words from at (from 0); letters of either case alike, as what is found is compared later."""
    return F.xxhash64(*(F.lower(F.get(words, at + i)) for i in range(size)))


def windows(benchmark: DataFrame) -> DataFrame:
    """w (array), words (w as a string), len, items: each distinct window with the items that it is of.

    Null or wordless items have none. An item_id that repeats, or a window that repeats in an item, counts once. A window
    of more than ITEMS items has several rows, which part its items.
    """
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), F.filter(_words(_ascii_lower(F.col("text"))), lambda w: w != "").alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - WINDOW + 1))
    one = items.select("item", F.explode(F.transform(starts, lambda i: F.slice("w", i, WINDOW))).alias("w")).distinct()
    most = one.groupBy("w").count().agg(F.max("count")).first()[0] or 0
    salt = F.pmod(F.xxhash64("item"), F.lit(-(-most // ITEMS) or 1))
    return one.groupBy("w", salt.alias("salt")).agg(F.collect_set("item").alias("items")).select("w", F.array_join("w", " ").alias("words"), F.size("w").alias("len"), "items")


def prefixes(found: DataFrame, docs: DataFrame) -> DataFrame:
    """words, token, off: of each window the shingle that is rarest in docs, and where in the window it stands."""
    size = F.least(F.lit(SHINGLE), F.col("len"))
    options = found.select("w", "words", "len").distinct().withColumn("off", F.explode(F.sequence(F.lit(0), F.col("len") - size)))
    token = reduce(lambda c, k: c.when(size == k, _shingle(F.col("w"), F.col("off"), k)), range(1, SHINGLE + 1), F.when(F.lit(False), F.lit(0).cast("bigint")))
    options = options.select("words", "off", token.alias("token"))
    tokens = staged(options.select("token").distinct(), "tokens")
    sizes = _sizes(found)
    total = tokens.count()
    met = _met(docs, sizes).select("token")
    # what the sieve lets through besides is counted for nothing
    counted = (met.join(F.broadcast(tokens), "token") if total <= BLOCK else _sifted(met, tokens, total)).groupBy("token").count()
    rank = Window.partitionBy("words").orderBy(F.coalesce("count", F.lit(0)), "token", "off")
    return options.join(counted, "token", "left").withColumn("r", F.row_number().over(rank)).where("r = 1").drop("r", "count")


def _sizes(found: DataFrame) -> list[int]:
    """Sizes of the windows' shingles: SHINGLE, and less where a window is shorter."""
    return sorted(r[0] for r in found.select(F.least(F.lit(SHINGLE), F.col("len"))).distinct().collect()) or [SHINGLE]


def _sifted(met: DataFrame, tokens: DataFrame, total: int) -> DataFrame:
    """The rows of met whose token may be one of tokens: all that are, and few others."""
    words = 1
    while words < MOST_WORDS and words * 64 * BUCKETS < total * BITS:
        words *= 2
    # a token's hash says which bucket, which word of it and which bit
    bucket, word, bit = (F.col("token").bitwiseAND(BUCKETS - 1), F.shiftrightunsigned("token", 10).bitwiseAND(words - 1), F.shiftrightunsigned("token", 32).bitwiseAND(63).cast("int"))
    ones = tokens.select(bucket.alias("bucket"), word.alias("word"), bit.alias("bit")).selectExpr("bucket", "word", "shiftleft(1L, bit) as one").groupBy("bucket", "word").agg(F.bit_or("one").alias("bits"))
    every = tokens.sparkSession.range(BUCKETS * words).select((F.col("id") / words).cast("bigint").alias("bucket"), (F.col("id") % words).alias("word"))
    sieve = every.join(ones, ["bucket", "word"], "left").groupBy("bucket").agg(F.array_sort(F.collect_list(F.struct("word", F.coalesce("bits", F.lit(0).cast("bigint")).alias("bits")))).alias("all"))
    sieve = staged(sieve.select(F.col("bucket").alias("of_bucket"), F.transform("all", lambda w: w["bits"]).alias("bits")), "sieve")
    placed = met.withColumns({"in_bucket": bucket, "in_word": word.cast("int"), "in_bit": bit}).join(F.broadcast(sieve), F.col("in_bucket") == F.col("of_bucket"))
    return placed.where("(shiftrightunsigned(get(bits, in_word), in_bit) & 1L) = 1").drop("in_bucket", "in_word", "in_bit", "of_bucket", "bits")


def _met(docs: DataFrame, sizes: list[int]) -> DataFrame:
    """docs' columns, w (words), pos and token: every place of each document with the shingles of the given sizes there."""
    read = docs.withColumn("w", _words(F.col("text")))
    placed = read.select("*", F.explode(F.sequence(F.lit(0), F.size("w") - 1)).alias("pos"))
    if len(sizes) == 1:
        return placed.withColumn("token", _shingle(F.col("w"), F.col("pos"), sizes[0]))
    return placed.select("*", F.explode(F.array(*(_shingle(F.col("w"), F.col("pos"), k) for k in sizes))).alias("token"))


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for each row of docs (doc_id, text).

    n_hit counts words of the document inside any occurrence of any window, n_items the items of which a window occurs;
    items_sha256 is of their ids, sorted as strings and joined by commas. A null or empty text has no words. Repeated
    rows give a row each. Without windows nothing is hit. Other columns are not read.
    """
    row, had = docs.select("doc_id", _key(docs).alias("key")).alias("row"), judged(docs, benchmark).alias("had")
    each = row.join(had, F.col("row.doc_id").eqNullSafe(F.col("had.doc_id")) & (F.col("row.key") == F.col("had.key")))
    return each.select("row.doc_id", "n_words", "n_hit", "n_items", "items_sha256", (F.col("n_hit") > 0).alias("contaminated"))


def _key(docs: DataFrame) -> Column:
    """A text's hash; with the doc_id it names a row, so that equal rows meet, and meet alike when a task runs again."""
    return F.xxhash64(F.coalesce(docs["text"], F.lit("")))


def judged(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, key, n_words, n_hit, n_items, items_sha256 for each different row of docs."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    known = rows.withColumn("key", _key(rows))
    found = staged(windows(benchmark), "windows")
    total = found.agg(F.sum(F.size("items"))).first()[0] or 0
    sizes = _sizes(found)
    keyed = staged(found.drop("w").join(prefixes(found, rows), "words"), "keyed")
    n = (F.size("w") - (F.element_at("w", 1) == "").cast("int") - ((F.size("w") > 1) & (F.element_at("w", -1) == "")).cast("int")).cast("bigint")
    places = _met(known, sizes)
    if total <= BLOCK:  # besides what is found, the first place of each document is kept, for its number of words
        met = places.join(F.broadcast(keyed), "token", "left").where(F.col("off").isNotNull() | (F.col("pos") == 0))
    else:
        tokens = staged(keyed.select("token").distinct(), "tokens")
        met = _sifted(places, tokens, tokens.count()).join(keyed, "token")
    start = F.col("pos") - F.col("off")
    inside = (start >= 0) & (start + F.col("len") <= F.size("w"))
    same = inside & (_ascii_lower(F.array_join(F.slice("w", F.greatest(start, F.lit(0)) + 1, F.col("len")), " ")) == F.col("words"))
    hits = met.select("doc_id", "key", n.alias("n"), F.when(same, F.struct(start.alias("start"), F.col("len").alias("len"))).alias("hit"), F.when(same, F.col("items")).alias("items"), "pos").where(F.col("hit").isNotNull() | (F.col("pos") == 0)).drop("pos")
    if total > BLOCK:
        none = known.withColumn("w", _words(F.col("text"))).select("doc_id", "key", n.alias("n"))
        hits = hits.unionByName(none.select("*", *(F.lit(None).cast(hits.schema[c].dataType).alias(c) for c in ("hit", "items"))))
    one = hits.groupBy("doc_id", "key").agg(F.max("n").alias("n_words"), F.collect_set("hit").alias("hits"), F.collect_set("items").alias("items"))
    places = F.array_distinct(F.flatten(F.transform("hits", lambda h: F.sequence(h["start"], h["start"] + h["len"] - 1))))
    items = F.array_sort(F.array_distinct(F.flatten("items")))
    return one.select("doc_id", "key", "n_words", F.size(places).cast("bigint").alias("n_hit"), F.size(items).cast("bigint").alias("n_items"), F.sha2(F.array_join(items, ","), 256).alias("items_sha256"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, in which no window of the benchmark occurs.

    Null and empty texts have no words and stay; equal rows stay or go together; other columns may have any names. An
    empty table stays empty, and without windows every row stays. Texts of any length are read whole.
    """
    found = staged(judged(docs, benchmark).where("n_hit > 0").select("doc_id", "key"), "hit")
    found = F.broadcast(found) if found.count() <= BROADCAST_ROWS else found
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("doc_id").alias("id"), _key(docs).alias("text_key"))
    return rows.join(found, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("text_key") == F.col("key")), "left_anti").select("row.*")
