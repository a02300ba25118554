"""Deduplication of lines over a corpus, in DataFrame operations alone.

Hashes of line keys are range-partitioned by (hash, document descending, position), so that a line in a third of all
documents spreads over many partitions. Each partition, a chunk, sorts its entries in that order and streams them: the
first entry of a hash names its latest document, and a running count over changes of document tells how many hold it. Only
the first and the last hash of a chunk can go on in another one, so the totals of at most two hashes a chunk are summed
apart and handed to the chunks in a table of one row each. No entry is joined by its hash.

The result is a compressed keep bitmap a document: 64 lines a word, words whose lines all stay left out; a document without
dropped lines has no row. Bitmaps travel instead of text; who wants the texts joins them to their documents, once.

A key is the line stripped of [\\x20\\x09-\\x0D] with A-Z lower-cased, as two 64-bit hashes of different seeds.

Defined cases: a null or empty text is one empty line; rows with one id and different texts are different documents;
equal rows repeat their verdict and count once; a null id ranks below all others; an empty table gives an empty result;
other columns of docs pass through under any name; texts of any length are split whole, a line of any length is one key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyveil.llm.shared import SPACES, ascii_lower, documents, private_name, stored

MIN_CHARS = 40
MIN_DOCS = 5


def _text() -> Column:
    return F.coalesce(F.col("text"), F.lit(""))


def line_occurrences(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, text_hash, pos, h1, h2, task) of each line whose key has min_chars code points. task tells equal rows
    apart, so that many of them can be dealt to several partitions."""
    lines = docs.select("doc_id", F.xxhash64(_text()).alias("text_hash"), F.posexplode(F.split(_text(), "\n")).alias("pos", "line"))
    lines = lines.select("doc_id", "text_hash", "pos", F.btrim(F.col("line"), F.lit(SPACES)).alias("line")).where(F.char_length("line") >= min_chars)
    key = ascii_lower(F.col("line"))
    return lines.select("doc_id", "text_hash", "pos", F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(1), key).alias("h2"), F.spark_partition_id().alias("task"))


def _later_first() -> list[Column]:
    return [F.col("doc_id").desc(), F.col("text_hash"), F.col("pos"), F.col("task")]


def chunks(occurrences: DataFrame) -> DataFrame:
    """occurrences with the number of the range partition that each belongs to. To be stored: a second run may cut elsewhere."""
    n = int(occurrences.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return occurrences.repartitionByRange(n, "h1", "h2", *_later_first()).withColumn("chunk", F.spark_partition_id())


def border_totals(dealt: DataFrame) -> DataFrame:
    """(chunk, low, high) of each chunk: its first and its last hash, each with h1, h2, the documents that hold it anywhere
    and the latest of them. As many rows as chunks."""
    key = F.struct("h1", "h2")
    ends = stored(dealt.groupBy("chunk").agg(F.min(key).alias("low"), F.max(key).alias("high")), "line_chunk_ends")
    own = dealt.join(F.broadcast(ends), "chunk").where((key == F.col("low")) | (key == F.col("high")))
    one = own.select("h1", "h2", "doc_id", "text_hash").distinct()
    totals = stored(one.groupBy("h1", "h2").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("keeper")), "line_totals")
    for side in ("low", "high"):
        told = totals.select(F.col("h1").alias(f"{side}_1"), F.col("h2").alias(f"{side}_2"), F.struct("h1", "h2", "n_docs", "keeper").alias(f"{side}_total"))
        ends = ends.join(told, (F.col(f"{side}.h1") == F.col(f"{side}_1")) & (F.col(f"{side}.h2") == F.col(f"{side}_2")))
    return ends.select("chunk", F.col("low_total").alias("low"), F.col("high_total").alias("high"))


def dropped_lines(dealt: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc_id, text_hash, pos) of the lines that go, streamed from each chunk in order."""
    n = int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    in_order = Window.partitionBy("chunk", "h1", "h2").orderBy(*_later_first())
    whole = in_order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    same = F.col("doc_id").eqNullSafe(F.lag("doc_id").over(in_order)) & F.col("text_hash").eqNullSafe(F.lag("text_hash").over(in_order))
    rows = dealt.repartitionById(n, "chunk").withColumn("new", F.when(same, 0).otherwise(1))
    rows = rows.withColumn("n_docs", F.sum("new").over(whole)).withColumn("keeper", F.first("doc_id").over(in_order))
    rows = rows.join(F.broadcast(border_totals(dealt)), "chunk")
    verdict = F.struct("n_docs", "keeper")
    for side in ("low", "high"):
        at_border = (F.col("h1") == F.col(f"{side}.h1")) & (F.col("h2") == F.col(f"{side}.h2"))
        verdict = F.when(at_border, F.struct(F.col(f"{side}.n_docs").alias("n_docs"), F.col(f"{side}.keeper").alias("keeper"))).otherwise(verdict)
    rows = rows.select("doc_id", "text_hash", "pos", verdict.alias("v"))
    return rows.where((F.col("v.n_docs") >= min_docs) & ~F.col("doc_id").eqNullSafe(F.col("v.keeper"))).select("doc_id", "text_hash", "pos")


def keep_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc_id, text_hash, keep map<int,bigint>) of the documents with dropped lines: bit pos % 64 of word pos div 64 is set
    where the line stays; lines past the last one, and words that are not in the map, are set throughout."""
    dealt = stored(chunks(stored(line_occurrences(docs, min_chars), "line_hashes")), "line_chunks")
    gone = F.bit_or(F.expr("shiftleft(1L, pos % 64)"))
    words = dropped_lines(dealt, min_docs).groupBy("doc_id", "text_hash", F.expr("pos div 64").cast("int").alias("word")).agg(F.bitwise_not(gone).alias("bits"))
    return words.groupBy("doc_id", "text_hash").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("keep"))


def with_bitmaps(docs: DataFrame, bitmaps: DataFrame, name: str) -> DataFrame:
    """docs with a column `name`: the words of the keep bitmap as an array, null where every line stays."""
    words = F.expr("transform(sequence(0, array_max(map_keys(keep))), w -> coalesce(try_element_at(keep, w), -1L))")
    r_id, r_hash = private_name(docs, "r_id"), private_name(docs, "r_hash")
    right = bitmaps.select(F.col("doc_id").alias(r_id), F.col("text_hash").alias(r_hash), words.alias(name))
    on = F.col("doc_id").eqNullSafe(F.col(r_id)) & (F.xxhash64(_text()) == F.col(r_hash))
    return docs.join(right, on, "left").drop(r_id, r_hash)


def _kept(words: str, i: Column) -> Column:
    word = F.coalesce(F.try_element_at(F.col(words), F.shiftright(i, 6) + 1), F.lit(-1).cast("long"))
    return F.getbit(word, i % 64) == 1


def kept_text(words: str) -> Column:
    """The text without its dropped lines; the text itself where nothing goes."""
    lines = F.filter(F.split(_text(), "\n"), lambda _, i: _kept(words, i))
    return F.when(F.col(words).isNull(), _text()).otherwise(F.array_join(lines, "\n"))


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """docs with the repeated lines taken out of text; all other columns as they are. A null text stays null."""
    name = private_name(docs, "kept_lines")
    joined = with_bitmaps(docs, keep_bitmaps(docs, min_chars, min_docs), name)
    text = F.when(F.col("text").isNotNull(), kept_text(name))
    return joined.select(*[text.alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns])


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    joined = with_bitmaps(docs, keep_bitmaps(docs), "words")
    n_dropped = F.coalesce(F.aggregate("words", F.lit(0).cast("long"), lambda a, w: a + F.bit_count(F.bitwise_not(w))), F.lit(0))
    n_lines = (F.char_length(_text()) - F.char_length(F.replace(_text(), F.lit("\n"), F.lit(""))) + 1).cast("long")
    return joined.select("doc_id", n_lines.alias("n_lines"), n_dropped.cast("long").alias("n_dropped"), F.sha2(kept_text("words"), 256).alias("kept_sha256"))
