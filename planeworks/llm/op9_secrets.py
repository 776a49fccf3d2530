"""Secret scans with multipart credential linking, with DataFrame functions only.

Parts of credentials are found by patterns, each part with its class: an identifier, a secret or an endpoint. Strong
parts (the base kinds) are reported always. Weak parts (identifiers and secrets too short to stand alone, endpoints)
are reported only if a part of another class, strong or weak, lies within `scope` code points in the same text: an
interval join of the parts, on the text and the scope-sized cells that a part's surroundings touch.

Places come from splitting a text by a pattern: the pieces and the matches alternate, so running sums of their lengths
are the matches' starts. Long texts with many matches cost what they hold, not its square; so does masking, which takes
a text apart into chunks first.

Defined cases: a null or empty text has no spans; repeated rows stay repeated rows (rows are told apart by a number
given on the scan and written with the parts); an empty table gives no rows. Other columns are never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from planeworks.llm.op8_decontaminate import key_of
from planeworks.llm.text import shared_dir

SCOPE = 200
#: Code points of a text that are cut out at once, and rows of stretches that are broadcast at most, once counted.
CHUNK, BROADCAST_ROWS = 1024, 200_000
#: Fixed values of the contract: the base kinds, in their order. {n,} says the same as + and dropping shorter matches
#: where a match is a whole run of its class.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
ASSIGN_LEAST = 6
#: The method's own weak kinds.
WEAK_ACCESS = r"AKIA[A-Z0-9]{8,15}(?![A-Z0-9])"
WEAK_HEX = r"(?<![0-9a-f])[0-9a-f]{16,23}(?![0-9a-f])"
ENDPOINT = r"https?://[A-Za-z0-9.-]+(?::[0-9]+)?"
#: (kind, order, pattern, class, strong)
KINDS = (
    ("assign", 0, ASSIGN, "secret", True),
    ("access", 1, ACCESS, "id", True),
    ("hex", 2, HEX, "secret", True),
    ("weak-access", 3, WEAK_ACCESS, "id", False),
    ("weak-hex", 4, WEAK_HEX, "secret", False),
    ("endpoint", 5, ENDPOINT, "endpoint", False),
)


def _pieces(text: Column, kind: str, order: int, pattern: str) -> Column:
    """array of (kind, i, gap: code points before the match since the last one, size, keep)."""
    whole, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    size = F.transform(whole, F.char_length)
    keep = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(2)), lambda x: F.char_length(x) >= ASSIGN_LEAST) if kind == "assign" else F.transform(whole, lambda x: F.lit(True))
    gap = F.transform(F.slice(between, F.lit(1), F.size(whole)), F.char_length)
    rows = F.transform(F.arrays_zip(gap.alias("gap"), size.alias("size"), keep.alias("keep")), lambda x, i: F.struct(F.lit(order).alias("kind"), i.alias("i"), x["gap"].alias("gap"), x["size"].alias("size"), x["keep"].alias("keep")))
    none = F.array().cast("array<struct<kind:int,i:int,gap:int,size:int,keep:boolean>>")
    return F.when(text.rlike(pattern), rows).otherwise(none)


def parts_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None) -> DataFrame:
    """row, key (of equal rows), doc_id, kind (order), start, end: every strong or weak part; a text without any has one row of nulls. The
    table is written to the shared folder, which fixes the row numbers."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), key_of(docs, id_col, text_col).alias("key"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    found = rows.select("row", "key", "doc_id", F.explode_outer(F.concat(*[_pieces(text, kind, order, pattern) for kind, order, pattern, _, _ in KINDS])).alias("p")).select("row", "key", "doc_id", "p.*")
    so_far = Window.partitionBy("row", "kind").orderBy("i")
    end = F.sum(F.col("gap") + F.col("size")).over(so_far)
    placed = found.select("row", "key", "doc_id", "kind", (end - F.col("size")).cast("int").alias("start"), end.cast("int").alias("end"), "keep")
    # a match that fails leaves its text's row in place
    kept = placed.select("row", "key", "doc_id", *[F.when(F.coalesce("keep", F.lit(False)), F.col(c)).alias(c) for c in ("kind", "start", "end")])
    folder = folder or shared_dir(spark, "credential-parts")
    kept.write.parquet(folder)
    return spark.read.parquet(folder)


def _kind_map(values: list) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), F.col("kind") + 1)


def linked(parts: DataFrame, scope: int = SCOPE) -> DataFrame:
    """row, key, doc_id, kind, start, end of strong parts, and of weak parts with a part of another class in scope."""
    named = parts.where("kind is not null").withColumn("class", _kind_map([k[3] for k in KINDS])).withColumn("strong", _kind_map([k[4] for k in KINDS]))
    cell = F.explode(F.sequence(F.floor((F.col("start") - scope) / scope), F.floor((F.col("end") + scope) / scope)))
    weak = named.where("not strong").select("row", "key", "doc_id", "kind", "start", "end", "class", cell.alias("cell"))
    others = named.select("row", F.col("class").alias("other"), F.col("start").alias("s"), F.col("end").alias("e"), F.floor(F.col("start") / scope).alias("cell"))
    # a part that began in an earlier cell than it touches is met at its start: its length is bounded by looking back
    long = named.where(F.col("end") - F.col("start") > scope).select("row", F.col("class").alias("other"), F.col("start").alias("s"), F.col("end").alias("e"), F.explode(F.sequence(F.floor(F.col("start") / scope) + 1, F.floor(F.col("end") / scope))).alias("cell"))
    near = (F.col("class") != F.col("other")) & (F.col("s") <= F.col("end") + scope) & (F.col("e") >= F.col("start") - scope)
    every = others.unionByName(long.select("row", "other", "s", "e", "cell"))
    pairs = weak.join(every, ["row", "cell"]).where(near).select("row", "key", "doc_id", "kind", "start", "end").distinct()
    return named.where("strong").select("row", "key", "doc_id", "kind", "start", "end").unionByName(pairs)


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE, folder: str | None = None) -> DataFrame:
    """row, key, doc_id, spans: array of (start, kind order, end), by start and then kind."""
    parts = parts_of(docs, id_col, text_col, folder)
    found = linked(parts, scope).groupBy("row").agg(F.sort_array(F.collect_set(F.struct("start", "kind", "end"))).alias("spans"))
    rows = parts.select("row", "key", "doc_id").distinct()
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    return rows.join(found, "row", "left").select("row", "key", "doc_id", F.coalesce("spans", none).alias("spans"))


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k[0]) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")


def digests(found: DataFrame) -> DataFrame:
    count = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long")
    base = F.filter("spans", lambda x: x["kind"] < 3)
    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


def stretches_of(found: DataFrame) -> DataFrame:
    """key, start, end of the maximal stretches of overlapping spans, once for all rows of a key."""
    one = found.join(found.groupBy("key").agg(F.min("row").alias("row")), ["key", "row"])
    ahead = Window.partitionBy("row").orderBy("start", "end")
    before = F.max("end").over(ahead.rowsBetween(Window.unboundedPreceding, -1))
    fresh = one.withColumn("fresh", F.when(before.isNull() | (F.col("start") >= before), 1).otherwise(0))
    named = fresh.withColumn("stretch", F.sum("fresh").over(ahead.rowsBetween(Window.unboundedPreceding, 0)))
    return named.groupBy("key", "row", "stretch").agg(F.min("start").alias("start"), F.max("end").alias("end")).select("key", "start", "end")


def masked(text: Column, stretches: Column, mask: str, chunk: int = CHUNK) -> Column:
    """The text with each stretch (ascending, disjoint) replaced; what stays is cut from chunks of the text, since
    finding a place in a string takes time in proportion to it."""
    size = F.char_length(text)
    starts = F.concat(F.array(F.lit(0)), F.transform(stretches, lambda x: x["end"]))
    ends = F.concat(F.transform(stretches, lambda x: x["start"]), F.array(size))
    held = F.struct(F.regexp_extract_all(text, F.lit("(?s).{1,%d}" % chunk), F.lit(0)).alias("chunks"), F.arrays_zip(starts.alias("a"), ends.alias("b")).alias("gaps"))

    def cut(chunks: Column, a: Column, b: Column) -> Column:
        number = lambda x: F.floor(x / chunk).cast("int")
        one = lambda k: F.substr(F.get(chunks, k), F.greatest(a - k * chunk, F.lit(0)) + 1, F.least(b - k * chunk, F.lit(chunk)) - F.greatest(a - k * chunk, F.lit(0)))
        return F.when(b > a, F.array_join(F.transform(F.sequence(number(a), number(b - 1)), one), "")).otherwise("")

    # a lambda's variable is computed once, however often it is used
    return F.transform(F.array(held), lambda h: F.array_join(F.transform(h["gaps"], lambda g: cut(h["chunks"], g["a"], g["b"])), mask))[0]


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str | None = "n_chars", mask: str = "[secret]", scope: int = SCOPE, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """All rows and columns of docs; each maximal stretch of overlapping spans is replaced by `mask`, and the column of
    text lengths, if there is one, follows. Texts without spans are as they were; null texts stay null; an empty table
    stays empty. Texts' stretches are broadcast if they are at most `broadcast_rows` in all; beyond that they are joined."""
    spark = docs.sparkSession
    folder = shared_dir(spark, "stretches")
    stretches_of(linked(parts_of(docs, id_col, text_col), scope)).write.parquet(folder)
    stretches = spark.read.parquet(folder)
    few = stretches.limit(broadcast_rows + 1).count() <= broadcast_rows
    found = stretches.groupBy(F.col("key").alias("__key")).agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("__stretches"))
    joined = docs.join(F.broadcast(found) if few else found, key_of(docs, id_col, text_col) == found["__key"], "left")
    text, hit = docs[text_col], F.col("__stretches").isNotNull()
    new = joined.withColumn("__new", F.when(hit, masked(text, F.col("__stretches"), mask)).otherwise(text))
    out = [F.col("__new").alias(c) if c == text_col else F.when(hit, F.char_length("__new").cast(docs.schema[c].dataType)).otherwise(docs[c]).alias(c) if c == chars_col else docs[c] for c in docs.columns]
    return new.select(*out)


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(scan_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet")))


def _oracle() -> str:
    """DuckDB SQL of the same spans. Its patterns have no look-around: weak parts are whole runs filtered by length."""
    kinds = [
        ("assign", 0, "secret", ASSIGN.replace("'", "''"), f"len(regexp_extract(m, '{ASSIGN.replace(chr(39), chr(39) * 2)}', 2)) >= {ASSIGN_LEAST}"), ("access", 1, "id", "AKIA[A-Z0-9]+", "len(m) >= 20"), ("hex", 2, "secret", HEX, "true"),
        ("weak-access", 3, "id", "AKIA[A-Z0-9]+", "len(m) BETWEEN 12 AND 19"), ("weak-hex", 4, "secret", "[0-9a-f]{16,}", "len(m) < 24"), ("endpoint", 5, "endpoint", ENDPOINT, "true"),
    ]
    each = " UNION ALL ".join(
        f"SELECT doc_id, '{name}' AS kind, {k} AS k, '{part}' AS part, {str(k < 3).lower()} AS strong, a AS start, b AS \"end\" FROM (SELECT doc_id, m, b - len(m) AS a, b FROM (SELECT doc_id, m, i, sum(len(g) + len(m)) OVER (PARTITION BY doc_id ORDER BY i) AS b FROM "
        f"(SELECT doc_id, unnest(regexp_extract_all(t, '{pattern}', 0)) AS m, unnest(string_split_regex(t, '{pattern}')[1 : -2]) AS g, unnest(range(len(regexp_extract_all(t, '{pattern}', 0)))) AS i FROM d WHERE regexp_matches(t, '{pattern}')))) WHERE {keep}"
        for name, k, part, pattern, keep in kinds
    )
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), p AS ({each}),
s AS (SELECT doc_id, kind, k, start, "end" FROM p WHERE strong OR EXISTS (SELECT 1 FROM p q WHERE q.doc_id = p.doc_id AND q.part <> p.part AND q.start <= p."end" + {SCOPE} AND q."end" >= p.start - {SCOPE})),
j AS (SELECT doc_id, count(*) FILTER (k = 0) AS a, count(*) FILTER (k = 1) AS c, count(*) FILTER (k = 2) AS h, string_agg(concat_ws(':', kind, CAST(start AS BIGINT), CAST("end" AS BIGINT)), ',' ORDER BY start, k) FILTER (k < 3) AS base, string_agg(concat_ws(':', kind, CAST(start AS BIGINT), CAST("end" AS BIGINT)), ',' ORDER BY start, k) AS spans FROM s GROUP BY doc_id)
SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(c, 0) AS n_access, coalesce(h, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN j USING (doc_id)
"""


ORACLE = _oracle()
