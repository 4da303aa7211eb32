"""Mixing sources to target weights by a low-discrepancy schedule, in DataFrame operations only.

* Targets. Sources are ordered by code point (null last) and weigh 1, 2, 3, repeating. They share all words of the corpus; no
  source gets more than CAP (3) times its own words, and what is over goes to the others by weight. Sorted by cap per weight, the
  capped sources come first, so prefix sums give the level at which all others are filled.
* Blocks. Each source's documents are shuffled by a digest of their id and laid end to end. Every BLOCK words of that stream are a
  block; documents are cut at block ends into pieces.
* Schedule. Slot t has the point t times the golden ratio, modulo one. It belongs to the source whose interval of cumulated
  weights holds the point, and takes the source's next block; after the last one the source's stream starts again.
  Neighbouring slots so draw from all sources nearly by weight, at every length of the schedule. Ranks that the discrepancy
  leaves out follow at the end, those beyond the target are dropped; the last block is cut, so a source gives its target's whole words.
* Pieces are joined with the slots of their block; a document's taken words are summed over them.

Every order over a source or over all slots is ranked in two steps, within buckets and by sums over buckets, so no source and no
schedule has to pass through one task. A source with a third of all documents is spread over as many buckets as its rows need.

Null texts have no words. Documents without words are not taken. Rows that repeat an id follow one another by text. Extra columns
are not read by the report; the pipeline form returns all of them. Without documents the result is empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitewright.llm import tables

CAP = 3
BLOCK = 256
#: Rows of a source in a bucket of its shuffled order, slots in a chunk of the schedule.
BUCKET, CHUNK = 5_000, 65_536
# fixed values: the golden ratio's step on a circle of 2**31 points
CIRCLE, GOLDEN = 1 << 31, 1_327_217_885
_WORD = r"[^\x20\x09-\x0D]+"


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size and a digest that orders the documents of a source."""
    size = F.coalesce(F.regexp_count("text", F.lit(_WORD)), F.lit(0)).cast("long")
    digest = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    return docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), size.alias("size"), digest.alias("digest"), tables.text_key().alias("text_key"))


def _prefix_sums(df: DataFrame, order: list[Column], sums: dict[str, str]) -> DataFrame:
    """Running sums, the row's own value left out, over an order of all rows: within range partitions, then over partitions."""
    ranged = tables.stored(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    within = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy("__part").agg(*[F.sum(F.expr(value)).alias(f"__{name}") for name, value in sums.items()])
    over = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each partition
    offsets = totals.select("__part", *[F.coalesce(F.sum(f"__{name}").over(over), F.lit(0)).alias(f"__{name}") for name in sums])
    joined = ranged.join(offsets, "__part")
    return joined.withColumns({name: F.coalesce(F.sum(F.expr(value)).over(within), F.lit(0)) + F.col(f"__{name}") for name, value in sums.items()}).drop("__part", *[f"__{name}" for name in sums])


def targets(sizes: DataFrame) -> DataFrame:
    """source, key, source_size, weight, target, and the interval [low, high) of the source on the circle, empty for sources without words."""
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = _prefix_sums(sources, [F.col("source").asc_nulls_last()], {"place": "1"})
    weighed = ranked.select("source", F.col("place").alias("key"), "source_size", (F.col("place") % 3 + 1).alias("weight"))
    ratio = F.col("source_size") / F.col("weight")
    leveled = tables.stored(_prefix_sums(weighed, [ratio.asc(), F.col("key").asc()], {"caps": f"{CAP} * source_size", "weights": "weight"}))
    total, weights = leveled.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    level = (F.lit(total) - F.col("caps")) / (F.lit(weights) - F.col("weights"))
    fits = F.col("weight") * level <= CAP * F.col("source_size")
    filled = leveled.where(fits).orderBy(F.col("caps"), F.col("weights")).select(level.alias("level")).first()
    target = F.least((CAP * F.col("source_size")).cast("double"), F.col("weight") * F.lit(filled["level"] if filled else 0.0))
    shares = _prefix_sums(leveled.select("source", "key", "source_size", "weight", target.alias("target"), F.floor(target).alias("words")), [F.col("key").asc()], {"before": "words"})
    whole = F.lit(max(1, shares.agg(F.coalesce(F.sum("words"), F.lit(0))).first()[0]))
    edge = lambda at: F.floor(at.cast("decimal(38,0)") * CIRCLE / whole).cast("long")
    return tables.stored(shares.select("source", "key", "source_size", "weight", "target", "words", edge(F.col("before")).alias("low"), edge(F.col("before") + F.col("words")).alias("high")))


def pieces(sizes: DataFrame, sources: DataFrame) -> DataFrame:
    """key, block, row, at (first word in its block) and count of every piece of a document with words."""
    keys = sources.select("key", F.col("source").alias("__source"))
    rows = sizes.where("size > 0").join(keys, F.col("source").eqNullSafe(F.col("__source")))
    spread = max(1, sizes.count() // BUCKET)
    bucket = F.floor(F.conv(F.substring("digest", 1, 8), 16, 10).cast("long") * F.lit(spread) / (1 << 32)).cast("long")
    rows = tables.stored(rows.select("key", bucket.alias("bucket"), "digest", "doc_id", "text_key", "row", "size"))
    sums = rows.groupBy("key", "bucket").agg(F.sum("size").alias("words"))
    before = sums.select("key", "bucket", F.coalesce(F.sum("words").over(Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    within = Window.partitionBy("key", "bucket").orderBy("digest", "doc_id", "size", "text_key", "row").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.join(before, ["key", "bucket"]).withColumn("start", F.col("base") + F.coalesce(F.sum("size").over(within), F.lit(0)))
    blocks = F.sequence(F.floor(F.col("start") / BLOCK), F.floor((F.col("start") + F.col("size") - 1) / BLOCK))
    cut = placed.select("key", "row", "start", "size", F.explode(blocks).alias("block"))
    low, high = F.greatest("start", F.col("block") * BLOCK), F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * BLOCK)
    return cut.select("key", "block", "row", (low - F.col("block") * BLOCK).alias("at"), (high - low).alias("count"))


def slots(sources: DataFrame) -> DataFrame:
    """t, key, rank, block and words of every slot of the schedule, in the order of t."""
    spark = sources.sparkSession
    blocks = F.ceil(F.col("source_size") / BLOCK)
    epoch = lambda rank: F.floor(rank / blocks)
    rest = lambda rank: F.col("words") - epoch(rank) * F.col("source_size") - (rank % blocks) * BLOCK
    # ranks whose first word lies before the source's whole target words
    need = F.floor(F.col("words") / F.col("source_size")) * blocks + F.ceil((F.col("words") % F.col("source_size")) / BLOCK)
    wanted = tables.stored(sources.where("words > 0").withColumn("need", need.cast("long")))
    length, count = wanted.agg(F.coalesce(F.sum("need"), F.lit(0)), F.count("*")).first()
    cells = max(1024, count)
    cell = lambda at: F.floor(at * cells / CIRCLE)
    ranges = wanted.where("low < high").select("key", "low", "high", F.explode(F.sequence(cell(F.col("low")), cell(F.col("high") - 1))).alias("cell"))
    point = (F.pmod(F.col("id"), F.lit(CIRCLE)) * GOLDEN) % CIRCLE
    drawn = spark.range(length).select(F.col("id").alias("t"), point.alias("point")).withColumn("cell", cell(F.col("point")))
    drawn = drawn.join(ranges, "cell").where("low <= point AND point < high").select("t", "key", F.floor(F.col("t") / CHUNK).alias("chunk"))
    drawn = tables.stored(drawn)
    counts = drawn.groupBy("key", "chunk").agg(F.count("*").alias("n"))
    before = counts.select("key", "chunk", F.coalesce(F.sum("n").over(Window.partitionBy("key").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    within = Window.partitionBy("key", "chunk").orderBy("t")
    ranked = drawn.join(before, ["key", "chunk"]).select("t", "key", (F.col("base") + F.row_number().over(within) - 1).alias("rank"))
    have = wanted.select("key", "need").join(counts.groupBy("key").agg(F.sum("n").alias("have")), "key", "left").select("key", "need", F.coalesce("have", F.lit(0)).alias("have"))
    late = have.where("have < need").select("key", F.explode(F.sequence(F.col("have"), F.col("need") - 1)).alias("rank")).select((F.col("rank") + length).alias("t"), "key", "rank")
    chosen = ranked.unionByName(late).join(wanted.select("key", "source_size", "words", "need"), "key").where("rank < need")
    size = F.least(F.lit(BLOCK), F.col("source_size") - (F.col("rank") % blocks) * BLOCK, rest(F.col("rank")))
    return chosen.select("t", "key", "rank", (F.col("rank") % blocks).cast("long").alias("block"), size.cast("long").alias("words"))


def taken(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, size, source, source_size, target and taken of every document."""
    # stored at once, so the row numbers stay as they are
    sizes = tables.stored(sized(docs).withColumn("row", F.monotonically_increasing_id()))
    sources = targets(sizes)
    per_block = slots(sources).groupBy("key", "block", "words").agg(F.count("*").alias("times"))
    share = F.greatest(F.lit(0), F.least("count", F.col("words") - F.col("at"))) * F.col("times")
    drawn = pieces(sizes, sources).join(per_block, ["key", "block"]).groupBy("row").agg(F.sum(share).alias("taken"))
    facts = sources.select(F.col("source").alias("__source"), "source_size", "target")
    named = sizes.join(facts, F.col("source").eqNullSafe(F.col("__source")))
    return named.join(drawn, "row", "left").select("doc_id", "text_key", "size", "source", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def report(docs: DataFrame) -> DataFrame:
    return taken(docs).drop("text_key")


def mixed(docs: DataFrame) -> DataFrame:
    """The documents that the mix takes, with all their columns, their source's target and the words taken of them, repeats counted."""
    found = taken(docs).where("taken > 0").groupBy(F.col("doc_id").alias("__doc"), F.col("text_key").alias("__key"))
    found = found.agg(F.max("target").alias("target"), F.max("taken").alias("taken"))
    keyed = docs.select(*[c for c in docs.columns if c not in ("target", "taken")], tables.text_key().alias("__text"))
    joined = keyed.join(found, keyed["doc_id"].eqNullSafe(F.col("__doc")) & (F.col("__text") == F.col("__key")))
    return joined.drop("__text", "__doc", "__key")


#: The closed form: what a source gives is a prefix of its repeated stream.
ORACLE = r"""
WITH sizes AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
sources AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS key FROM sizes GROUP BY source),
weighed AS (SELECT *, key % 3 + 1 AS weight FROM sources),
leveled AS (SELECT *,
    coalesce(sum(3 * source_size) OVER before, 0)::BIGINT AS caps, coalesce(sum(weight) OVER before, 0)::BIGINT AS weights
  FROM weighed WINDOW before AS (ORDER BY source_size / weight, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
totals AS (SELECT sum(source_size)::BIGINT AS all_words, sum(weight)::BIGINT AS all_weights FROM weighed),
levels AS (SELECT caps, weights, weight, source_size, (all_words - caps) / (all_weights - weights) AS level FROM leveled, totals),
level AS (SELECT level FROM levels WHERE weight * level <= 3 * source_size ORDER BY caps, weights LIMIT 1),
filled AS (SELECT source, source_size, least((3 * source_size)::DOUBLE, weight * level) AS target FROM weighed, level),
placed AS (SELECT s.doc_id, s.size, s.source, f.source_size, f.target, floor(f.target)::BIGINT AS words,
    coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY md5(coalesce(s.doc_id::VARCHAR, '')), s.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM sizes s JOIN filled f ON s.source IS NOT DISTINCT FROM f.source)
SELECT doc_id, size, source, source_size, target,
  CASE WHEN size = 0 THEN 0 ELSE (words // source_size) * size + greatest(0, least(start + size, words % source_size) - start) END::BIGINT AS taken
FROM placed
"""
