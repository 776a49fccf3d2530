"""Benchmark decontamination over a distributed positional inverted index, with DataFrame functions only.

1. Corpus frequencies of the benchmark's terms are counted over all training tokens.
2. Every window of `window` consecutive item words (a shorter item is one window) must hold a seed: the place of its
   rarest term (ties: the first such place). Neighbouring windows share seeds.
3. The index stores the training postings of seed terms: document, place, and the terms at the `window - 1` offsets on
   either side, so that lists are intersected at adjusted offsets where they are stored.
4. A posting is aligned with each seed of its term. The run of equal terms around it, out to the item's ends, is an
   exact phrase match if it is as long as a window: it covers exactly the windows' occurrences that hold this seed.
   Where at least `near` of an item's distinct terms around a seed stand within the same offsets, in any order, it is
   a proximity match.
5. Matched ranges are united per document.

A passage in very many documents gives each of them a few rows (one a seed), not one a window. Seeds and term counts
follow the benchmark's size, not the corpus': they are broadcast while they have at most `broadcast_rows` rows. Beyond
that they are joined with narrow rows (document, place, term), and a document's words meet only its own postings, so that
no exchange carries words for every word. Rows are told apart by their id and a 256-bit digest of their text.

Defined cases: null texts have no words; items without words or id are no items; equal rows count alike and stay
separate rows; an empty benchmark hits nothing; an empty table gives no rows. Other columns are never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from planeworks.llm.text import bounded, shared_dir

WINDOW, NEAR, BROADCAST_ROWS = 10, 0.8, 200_000
#: Bytes between words, in text with ASCII capitals lowered.
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """Array of words. lower() is the same as lowering A-Z in a text of ASCII only, and faster."""
    t = F.coalesce(text, F.lit(""))
    low = F.when(F.octet_length(t) == F.char_length(t), F.lower(t)).otherwise(F.translate(t, _UPPER, _LOWER))
    return F.array_remove(F.split(low, _BETWEEN), "")


def key_of(docs: DataFrame, id_col: str, text_col: str) -> Column:
    """32 bytes that rows of equal id and text share; null and empty differ."""
    text = docs[text_col].cast("string")
    return F.unhex(F.sha2(F.concat(F.coalesce(docs[id_col].cast("string"), F.lit("-")), F.when(text.isNull(), F.lit(" -")).otherwise(F.concat(F.lit(" "), text))), 256))


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, key (of equal rows), words."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), key_of(docs, id_col, text_col).alias("key"), words(F.col(text_col)).alias("words"))


def seeds_of(items: DataFrame, counts: DataFrame, window: int = WINDOW) -> DataFrame:
    """item_id, item_words (their number), term, place, around (terms at offsets -(window-1) .. window-1, null beyond
    the ends): the rarest place of each window of each item."""
    spots = items.select("item_id", F.size("words").alias("item_words"), "words", F.posexplode("words").alias("place", "term"))
    ranked = spots.join(counts, "term", "left").select("item_id", "item_words", "words", "place", "term", F.coalesce("n", F.lit(0)).alias("n"))
    # the least (count, place) of each window, as a sliding minimum
    ahead = Window.partitionBy("item_id").orderBy("place").rowsBetween(0, window - 1)
    rare = ranked.withColumn("best", F.min(F.struct("n", "place")).over(ahead)["place"]).where((F.col("place") + F.least(F.lit(window), "item_words")) <= F.col("item_words"))
    chosen = rare.groupBy("item_id", "item_words", "best").agg(F.first("words").alias("words"))
    return chosen.select("item_id", "item_words", F.col("best").alias("place"), F.col("words")[F.col("best")].alias("term"), around(F.col("words"), F.col("best"), window).alias("around"))


def around(terms: Column, place: Column, window: int) -> Column:
    """terms[place - window + 1 .. place + window - 1], with null where there is none."""
    return F.transform(F.sequence(place - (window - 1), place + (window - 1)), lambda i: F.when(i >= 0, F.get(terms, i)))


def build_index(docs: DataFrame, terms: DataFrame, folder: str, window: int = WINDOW, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Writes and reads back the postings of `terms` (column term): key, term, place, around."""
    spark = docs.sparkSession
    if terms.limit(broadcast_rows + 1).count() <= broadcast_rows:
        found = docs.select("key", "words", F.posexplode("words").alias("place", "term")).join(F.broadcast(terms), "term")
    else:
        narrow = shared_dir(spark, "narrow-postings")
        docs.select("key", F.posexplode("words").alias("place", "term")).join(terms, "term").select("key", "place", "term").write.parquet(narrow)
        own = spark.read.parquet(narrow).groupBy("key").agg(F.collect_list(F.struct("place", "term")).alias("own"))
        found = docs.select("key", "words").join(own, "key").select("key", "words", F.explode("own").alias("one")).select("key", "words", "one.place", "one.term")
    found.select("key", "term", F.col("place").cast("long").alias("place"), around(F.col("words"), F.col("place"), window).alias("around")).write.parquet(folder)
    return spark.read.parquet(folder)


def _run(a: Column, b: Column) -> Column:
    """Equal terms from the start of two arrays on."""
    differs = F.array_position(F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False))), False)
    return F.when(differs == 0, F.size(a)).otherwise(differs - 1)


def match(index: DataFrame, seeds: DataFrame, window: int = WINDOW, near: float = NEAR) -> DataFrame:
    """key, item_id, lo, hi (document words, inclusive), exact, near: one row a matching (posting, seed)."""
    hit = index.withColumnRenamed("around", "found").join(seeds.withColumnRenamed("place", "item_place"), "term")
    left = _run(F.reverse(F.slice("found", 1, window - 1)), F.reverse(F.slice("around", 1, window - 1)))
    right = _run(F.slice("found", window + 1, window - 1), F.slice("around", window + 1, window - 1))
    distinct = F.array_compact(F.array_distinct("around"))
    out = hit.select(
        "key", "item_id",
        (F.col("place") - left).alias("lo"), (F.col("place") + right).alias("hi"),
        (left + right + 1 >= F.least(F.lit(window), "item_words")).alias("exact"),
        (F.size(F.array_intersect(F.array_compact("found"), distinct)) >= F.ceil(F.size(distinct) * near)).alias("near"),
    )
    return out.where("exact or near")


def hits_of(matches: DataFrame) -> DataFrame:
    """key, n_hit, n_items, items (sorted ids as strings), n_near (items with proximity matches only)."""
    reach = Window.partitionBy("key").orderBy("lo", "hi").rowsBetween(Window.unboundedPreceding, -1)
    spans = matches.select("key", "item_id", "lo", "hi", "exact").distinct()
    placed = spans.withColumn("before", F.max(F.when(F.col("exact"), F.col("hi"))).over(reach))
    fresh = F.greatest(F.lit(0), F.col("hi") - F.greatest(F.col("lo") - 1, F.coalesce("before", F.lit(-1))))
    found = placed.groupBy("key").agg(
        F.coalesce(F.sum(F.when(F.col("exact"), fresh)), F.lit(0)).cast("long").alias("n_hit"),
        F.collect_set(F.when(F.col("exact"), F.col("item_id").cast("string"))).alias("items"),
        F.collect_set(F.col("item_id").cast("string")).alias("every"),
    )
    return found.select("key", "n_hit", F.size("items").cast("long").alias("n_items"), F.sort_array("items").alias("items"), (F.size("every") - F.size("items")).cast("long").alias("n_near"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, near: float = NEAR, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """doc_id, key, n_words, n_hit, n_items, items, n_near for every row of docs."""
    spark = docs.sparkSession
    training = keyed(docs, id_col, text_col)
    items = benchmark.select(F.col(item_id_col).alias("item_id"), words(F.col(item_text_col)).alias("words")).where("item_id is not null and size(words) > 0").distinct()
    # several texts under one id are several items of that name: windows are kept apart, the id is reported once
    items = items.select(F.struct("item_id", F.xxhash64("words").alias("text")).alias("item_id"), "words")
    terms = items.select(F.explode("words").alias("term")).distinct()
    counted = shared_dir(spark, "term-counts")
    training.select(F.explode("words").alias("term")).join(bounded(terms, broadcast_rows), "term").groupBy("term").agg(F.count(F.lit(1)).alias("n")).write.parquet(counted)
    seed_folder = shared_dir(spark, "seeds")
    seeds_of(items, spark.read.parquet(counted), window).write.parquet(seed_folder)
    seeds = spark.read.parquet(seed_folder)
    index = build_index(training, seeds.select("term").distinct(), shared_dir(spark, "postings"), window, broadcast_rows)
    matches = match(index, bounded(seeds, broadcast_rows), window, near)
    hits = hits_of(matches.withColumn("item_id", F.col("item_id")["item_id"]))
    every = training.select("doc_id", "key", F.size("words").cast("long").alias("n_words"))
    zero = F.lit(0).cast("long")
    return every.join(hits, "key", "left").select("doc_id", "key", "n_words", F.coalesce("n_hit", zero).alias("n_hit"), F.coalesce("n_items", zero).alias("n_items"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), F.coalesce("n_near", zero).alias("n_near"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs, all columns, without an exact phrase match."""
    hit = decontaminate(docs, benchmark, id_col, text_col, **options).where("n_hit > 0").select(F.col("key").alias("__hit")).distinct()
    folder = shared_dir(docs.sparkSession, "contaminated")
    hit.write.parquet(folder)
    hit = bounded(docs.sparkSession.read.parquet(folder), options.get("broadcast_rows", BROADCAST_ROWS))
    return docs.join(hit, key_of(docs, id_col, text_col) == hit["__hit"], "left_anti")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), "n_near")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM documents
), b AS (
  SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM benchmark WHERE item_id IS NOT NULL
), wins AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS k, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM b WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT k FROM wins),
spots AS (
  SELECT doc_id, k, i, array_to_string(w[i : i + k - 1], ' ') AS win
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, sizes WHERE len(w) >= k)
), occ AS (SELECT s.doc_id, s.i, s.k, wins.item_id FROM spots s JOIN wins ON s.win = wins.win AND s.k = wins.k),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM occ) GROUP BY doc_id),
named AS (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM occ),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS items FROM named GROUP BY doc_id),
terms AS (SELECT DISTINCT unnest(w) AS t FROM b), cnt AS (SELECT t, count(*) AS n FROM (SELECT unnest(w) AS t FROM d) JOIN terms USING (t) GROUP BY t),
it AS (SELECT DISTINCT item_id, w FROM b WHERE len(w) > 0), place AS (SELECT item_id, w, unnest(range(1, len(w) + 1)) AS p FROM it),
counted AS (SELECT item_id, w, p, coalesce(n, 0) AS n FROM place LEFT JOIN cnt ON cnt.t = w[p]),
best AS (SELECT DISTINCT item_id, w, p FROM (SELECT c.item_id, c.w, c.p, row_number() OVER (PARTITION BY s.item_id, s.w, s.p ORDER BY c.n, c.p) AS k FROM place s JOIN counted c ON c.item_id = s.item_id AND c.w = s.w AND c.p BETWEEN s.p AND s.p + least(10, len(s.w)) - 1 WHERE s.p + least(10, len(s.w)) - 1 <= len(s.w)) WHERE k = 1),
seed AS (SELECT DISTINCT item_id, w[p] AS t, list_distinct(w[greatest(1, p - 9) : p + 9]) AS a FROM best),
post AS (SELECT doc_id, w[p] AS t, list_distinct(w[greatest(1, p - 9) : p + 9]) AS f FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM d) WHERE w[p] IN (SELECT t FROM seed)),
close AS (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM post JOIN seed USING (t) WHERE len(list_intersect(f, a)) >= ceil(len(a) * CAST(0.8 AS DOUBLE))),
near AS (SELECT doc_id, count(*) AS n_near FROM (SELECT * FROM close EXCEPT SELECT * FROM named) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, CAST(coalesce(n_near, 0) AS BIGINT) AS n_near
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id) LEFT JOIN near USING (doc_id)
"""
