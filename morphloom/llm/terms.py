"""Frequency of every distinct term (problem 2): bitmaps of records per term.

The vertical layout holds, per term and chunk of 2^16 record numbers, a compressed
bitmap of the records and a counter of occurrences. A bitmap keeps only 64-bit
words with a bit set: of words with one bit the bit's place (2 bytes), of others
the word's number and its bits. So a rare term costs two bytes a record, a term of
every record a little more than a bit.

Bitmaps are built where their records lie, without an exchange, and then travel to
their term, where those of one chunk merge by union and their counters add up. A
very frequent term has one row a chunk there, not one a record. The number of
records is the sum of the cardinalities. The term ``null`` stands for all records.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from morphloom.llm.cooccur import packed, unpacked
from morphloom.operators.live import size_of, tasks_for

#: Bits of a record number within its chunk, and records that a bucket is given by estimate.
CHUNK_BITS, RECORDS_A_BUCKET = 16, 1 << 15
#: Bytes that a row of a table takes, at least, in the optimizer's estimate.
ROW_BYTES = 16
#: The chunk of records that are numbered apart.
APART = -1
CONTAINER = "struct<places array<smallint>, words array<struct<word smallint, bits bigint>>>"


def record_rows(df: DataFrame, term: str, record: list[str], within: str, hot: dict | None = None) -> DataFrame:
    """(lying, term, number, n): each record's terms with how often it holds them, and a number for the record.

    Rows lie partitioned by ``within`` at first and by ``lying`` in the end. What
    one part holds of a record travels as one text. Records are numbered within
    hash buckets by their order there, so numbers are dense, and neither a global
    sort nor a join is needed. Rows with null term are ignored; null is a record
    value like any other. Each record also has a row with null term and all its
    occurrences.

    hot: records (as ``packed`` makes them) that hold very many rows. They are
    numbered here and now and their terms stay where they lie, so no task ever
    holds one.
    """
    rows = df.filter(F.col(term).isNotNull()).select(F.col(within).alias("__within"), packed(*[F.col(c) for c in record]).alias("record"), packed(F.col(term)).alias("term"))
    counted = rows.groupBy("__within", "record", "term").agg(F.count(F.lit(1)).alias("n"))
    fixed = list(hot or {})
    apart = counted.filter(F.col("record").isin(fixed)) if fixed else None
    rest = counted.filter(~F.col("record").isin(fixed)) if fixed else counted
    buckets = min(max(tasks_for(df), size_of(df) // ROW_BYTES // RECORDS_A_BUCKET), 1 << 20)
    held = rest.groupBy("__within", "record").agg(F.array_join(F.collect_list(F.concat_ws(":", "n", "term")), "\n\u001f").alias("terms"))
    lying = held.select("record", "terms", F.pmod(F.xxhash64("record"), F.lit(buckets)).alias("lying")).repartition("lying")
    place = F.dense_rank().over(Window.partitionBy("lying").orderBy("record")).cast("bigint") - 1
    numbered = lying.withColumn("number", F.shiftleft(F.col("lying") + 1, 40) + place)
    items = numbered.select("lying", "number", F.explode(F.split("terms", "\n\u001f")).alias("x"))
    # a term has its separators escaped, so the first colon ends the count
    parted = items.select("lying", "number", F.substring_index("x", ":", 1).cast("bigint").alias("n"), F.expr("substr(x, instr(x, ':') + 1)").alias("t"))
    out = parted.select("lying", *unpacked(F.col("t"), ["term"]), "number", "n")
    if apart is None:
        return out
    numbers = F.create_map(*[F.lit(x) for i, r in enumerate(fixed) for x in (r, i)])
    own = apart.select(F.col("__within").cast("bigint").alias("lying"), *unpacked(F.col("term"), ["term"]), (F.element_at(numbers, F.col("record")) + F.lit(APART << 40)).cast("bigint").alias("number"), "n")
    return out.unionByName(own)


def _encoded(words: Column) -> Column:
    """A bitmap from its non-zero words (word, bits)."""
    one = lambda w: F.bit_count(w["bits"]) == 1
    bit = lambda bits: F.when(bits < 0, 63).otherwise(F.bit_count(F.nullif(bits, F.lit(-(1 << 63))) - 1).cast("int"))
    place = lambda w: (w["word"].cast("int") * 64 + bit(w["bits"]) - 32768).cast("smallint")
    return F.struct(F.transform(F.filter(words, one), place).alias("places"), F.filter(words, lambda w: ~one(w)).alias("words")).cast(CONTAINER)


def _words(bitmap: str) -> Column:
    """The non-zero words of a bitmap; words of several places may repeat."""
    place = lambda p: p.cast("int") + 32768
    single = F.transform(f"{bitmap}.places", lambda p: F.struct(F.shiftright(place(p), 6).cast("smallint").alias("word"), F.call_function("shiftleft", F.lit(1).cast("bigint"), place(p).bitwiseAND(63)).alias("bits")))
    return F.concat(single, F.col(f"{bitmap}.words"))


def term_bitmaps(rows: DataFrame, lying: str = "lying") -> DataFrame:
    """(term, chunk, bitmap, occurrences): bitmaps of the records in ``rows`` (lying, term, number, n).

    Rows lie partitioned by ``lying``; no exchange is needed, and a term and chunk
    has a bitmap for each part. Rows with null n are ignored. A null number is one
    record. Every number is also a record of the null term.
    """
    rows = rows.filter(F.col("n").isNotNull()).select(lying, F.explode(F.array(F.col("term"), F.lit(None).cast("string"))).alias("term"), "number", "n")
    low = F.coalesce(F.col("number").bitwiseAND((1 << CHUNK_BITS) - 1), F.lit(0)).cast("int")
    chunk = F.coalesce(F.shiftright("number", CHUNK_BITS), F.lit(-(1 << 62)))
    placed = rows.select(lying, "term", chunk.alias("chunk"), F.shiftright(low, 6).cast("smallint").alias("word"), low.bitwiseAND(63).alias("bit"), "n")
    words = placed.groupBy(lying, "term", "chunk", "word").agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("bit"))).alias("bits"), F.sum("n").alias("n"))
    return words.groupBy(lying, "term", "chunk").agg(_encoded(F.collect_list(F.struct("word", "bits"))).alias("bitmap"), F.sum("n").alias("occurrences")).drop(lying)


def merge_bitmaps(*parts: DataFrame) -> DataFrame:
    """One bitmap for each term and chunk: the union of those of the parts; counters add up."""
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    # to their term; from there on nothing is exchanged
    met = union.repartition("term")
    split = met.select("term", "chunk", F.posexplode(_words("bitmap")).alias("at", "w"), "occurrences")
    words = split.groupBy("term", "chunk", F.col("w.word").alias("word")).agg(F.bit_or("w.bits").alias("bits"), F.sum(F.when(F.col("at") == 0, F.col("occurrences"))).alias("n"))
    return words.groupBy("term", "chunk").agg(_encoded(F.collect_list(F.struct("word", "bits"))).alias("bitmap"), F.sum("n").alias("occurrences"))


def cardinality(bitmap: str) -> Column:
    """The records in a bitmap."""
    return F.size(f"{bitmap}.places").cast("bigint") + F.aggregate(f"{bitmap}.words", F.lit(0).cast("bigint"), lambda n, w: n + F.bit_count(w["bits"]))


def term_frequencies(bitmaps: DataFrame) -> DataFrame:
    """(term, occurrences, records): counters and cardinalities of merged bitmaps; a term without records is none."""
    return bitmaps.groupBy("term").agg(F.sum("occurrences").alias("occurrences"), F.sum(cardinality("bitmap")).alias("records")).filter("records > 0")


def mark_terms(frequencies: DataFrame, measure: str, rare_below: int, common_above: float) -> DataFrame:
    """(term, mark): ``rare`` if ``measure`` is below ``rare_below``, ``common`` if above that share of the null term's.

    A term of a very small table may be both and then has two rows.
    """
    total = frequencies.filter(F.col("term").isNull()).agg(F.max(measure).alias("total"))
    share = F.col(measure).cast("double") > F.lit(common_above) * total.scalar()
    marks = F.array_compact(F.array(F.when(F.col(measure) < rare_below, F.lit("rare")), F.when(share, F.lit("common"))))
    return frequencies.filter(F.col("term").isNotNull()).select("term", F.explode(marks).alias("mark"))
