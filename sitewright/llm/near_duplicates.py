"""Near duplicates by b-bit MinHash: band candidates, bit-count estimates, exact confirmation, components.

A document's set holds its distinct runs of `size` words (5), A-Z lowered; with fewer words, the whole sequence; without words
it is empty and linked with nothing. Two documents are linked if 100 * |A and B| >= percent * |A or B|.

1. One pass makes the set's size and 128-bit fingerprint, the minima of some 170 permutations, their band keys and their two
   low bits, packed by bit plane.
2. Equal sets are one class, formed by an aggregate that combines before the shuffle. Only classes go on.
3. Classes that share a band bucket are candidates. Bands are so many that a pair at the threshold is missed with a chance
   below 1e-9. Small buckets give all their pairs. In a large one a few pivots are compared with all others; then the members that
   are not linked with its main pivot are compared with all others by longer sketches. No link between two components is lost. A
   bucket of thousands of copies of one text costs about its size; what is compared further is what is similar, but not linked.
4. A candidate whose collision-corrected estimate from the packed bits lies six deviations below the threshold is let go. All
   others are confirmed on their full sets.
5. Components spread the smallest label along the links, with pointer jumping.

Rows without an id come last in the order of ids; a component of such rows alone has no id. Rows that repeat id and text get
equal results. Other columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitewright.llm import tables, words

SHINGLE = 5
#: Chance that a pair exactly at the threshold shares no band.
MISS = 1e-9
MOST_BANDS = 40
#: Buckets up to this size give all pairs at once.
SMALL_BUCKET = 12
#: Members of a large bucket that are compared with all its others at first.
PIVOTS = 4
#: Bits of the sketches by which the other members of large buckets are compared, and members in one packed block.
SKETCH, BLOCK = 2048, 4096


@dataclass(frozen=True)
class Bands:
    percent: int
    bands: int
    rows: int

    @classmethod
    def of(cls, percent: int) -> Bands:
        """The longest bands that still miss less than MISS."""
        for rows in range(8, 0, -1):
            bands = math.ceil(math.log(MISS) / math.log1p(-((percent / 100) ** rows)))
            if bands <= MOST_BANDS or rows == 1:
                return cls(percent, bands, rows)
        raise AssertionError

    @property
    def count(self) -> int:
        return self.bands * self.rows

    @property
    def planes(self) -> list[str]:
        return [f"s{i}" for i in range(2 * math.ceil(self.count / 64))]


def _sets(piece: words.Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes with their rows, in the order of row and hash."""
    parts = [(piece.doc[at], hashes) for hashes, at in [words.runs(piece, size)]]
    counts = piece.counts
    for short in range(1, size):
        if (counts == short).any():
            hashes, at = words.runs(piece, short)
            whole = counts[piece.doc[at]] == short
            parts.append((piece.doc[at[whole]], hashes[whole]))
    doc, shingle = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((shingle, doc))
    doc, shingle = doc[order], shingle[order]
    fresh = np.ones(len(doc), dtype=bool)
    fresh[1:] = (doc[1:] != doc[:-1]) | (shingle[1:] != shingle[:-1])
    return doc[fresh], shingle[fresh]


def _signatures(plan: Bands, size: int):
    factors = words.mixed(np.arange(1, plan.count + 1, dtype=np.uint64)) | np.uint64(1)

    def of(piece: words.Words) -> dict[str, np.ndarray]:
        doc, shingle = _sets(piece, size)
        count = np.bincount(doc, minlength=piece.rows)
        out = {"n": count, "fp": np.zeros(piece.rows, dtype=np.uint64), "fp2": np.zeros(piece.rows, dtype=np.uint64)}
        lowest = np.zeros((piece.rows, plan.count), dtype=np.uint64)
        if len(doc):
            some = np.flatnonzero(count)
            first = np.flatnonzero(np.diff(doc, prepend=-1))
            out["fp"][some] = words.mixed(np.add.reduceat(shingle * np.uint64(0x9FB21C651E98DF25), first))
            out["fp2"][some] = words.mixed(np.add.reduceat(words.mixed(shingle), first))
            turned = np.empty_like(shingle)
            for j, factor in enumerate(factors):
                np.multiply(shingle, factor, out=turned)
                lowest[some, j] = np.minimum.reduceat(turned, first)
        low = (lowest >> np.uint64(8)) & np.uint64(3)
        wide = len(plan.planes) // 2
        for bit in (0, 1):
            packed = np.packbits(((low >> np.uint64(bit)) & np.uint64(1)).astype(np.uint8), axis=1)
            plane = np.zeros((piece.rows, 8 * wide), dtype=np.uint8)
            plane[:, : packed.shape[1]] = packed
            out |= {f"s{bit * wide + i}": column for i, column in enumerate(plane.view(np.int64).T)}
        keys = np.full((piece.rows, plan.bands), 1, dtype=np.uint64) * np.arange(1, plan.bands + 1, dtype=np.uint64)
        for i in range(plan.rows):
            keys = words.mixed(keys ^ lowest[:, i :: plan.rows])
        out["bands"] = keys
        return out

    return of


def _described(docs: DataFrame, plan: Bands, size: int) -> DataFrame:
    """One row per document: d, t, n, fingerprints, bit planes and band keys."""
    signatures = _signatures(plan, size)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in words.slices(batch.column(2), words.WHITE_SPACE, lower=True):
                found = signatures(piece)
                keys = found.pop("bands").view(np.int64)
                columns = {name: batch.column(i).slice(piece.row, piece.rows) for i, name in enumerate(("d", "t"))}
                columns |= {name: pa.array(np.ascontiguousarray(x).astype(np.int64, copy=False) if x.dtype != np.uint64 else x.view(np.int64)) for name, x in found.items()}
                columns["bands"] = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, keys.shape[1], dtype=np.int32)), pa.array(keys.reshape(-1)))
                yield pa.RecordBatch.from_pydict(columns)

    schema = "d long, t long, n long, fp long, fp2 long, " + "".join(f"{s} long, " for s in plan.planes) + "bands array<long>"
    return tables.batched(docs).select(tables.order_key().alias("d"), tables.text_key().alias("t"), "text").mapInArrow(rows, schema)


def _set_rows(docs: DataFrame, size: int) -> DataFrame:
    """Fingerprint and full set of each document."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in words.slices(batch.column(0), words.WHITE_SPACE, lower=True):
                doc, shingle = _sets(piece, size)
                if len(doc):
                    first = np.flatnonzero(np.diff(doc, prepend=-1))
                    print_ = words.mixed(np.add.reduceat(shingle * np.uint64(0x9FB21C651E98DF25), first))
                    bounds = pa.array(np.append(first, len(doc)).astype(np.int32))
                    yield pa.RecordBatch.from_arrays([pa.array(print_.view(np.int64)), pa.ListArray.from_arrays(bounds, pa.array(shingle.view(np.int64)))], ["fp", "shingles"])

    return tables.batched(docs).select("text").mapInArrow(rows, "fp long, shingles array<long>")


def _estimate(plan: Bands, left: str, right: str) -> Column:
    """Similarity from equal low bits, corrected for those that are equal by chance."""
    wide = len(plan.planes) // 2
    apart = [F.bit_count(F.col(f"{left}.s{i}").bitwiseXOR(F.col(f"{right}.s{i}")).bitwiseOR(F.col(f"{left}.s{wide + i}").bitwiseXOR(F.col(f"{right}.s{wide + i}")))) for i in range(wide)]
    equal = 1 - sum(apart[1:], apart[0]) / F.lit(float(plan.count))
    return (equal - 0.25) / 0.75


def _lowest_estimate(plan: Bands) -> float:
    chance = 0.25 + 0.75 * plan.percent / 100
    return plan.percent / 100 - 6 * math.sqrt(chance * (1 - chance) / plan.count) / 0.75


class _Links:
    """Confirms pairs of classes and gathers the links."""

    def __init__(self, plan: Bands, classes: DataFrame, sets: DataFrame) -> None:
        self.plan, self.classes, self.sets = plan, classes, sets
        self.links = None

    def confirm(self, pairs: DataFrame) -> None:
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()
        left, right = self.classes.alias("l"), self.classes.alias("r")
        close = pairs.join(left, F.col("a") == F.col("l.fp")).join(right, F.col("b") == F.col("r.fp")).where(_estimate(self.plan, "l", "r") >= _lowest_estimate(self.plan)).select("a", "b")
        one, other = (self.sets.select(F.col("fp").alias(key), F.col("shingles").alias(f"of_{key}")) for key in ("a", "b"))
        both = F.size(F.array_intersect("of_a", "of_b"))
        met = close.join(one, "a").join(other, "b").where(100 * both >= self.plan.percent * (F.size("of_a") + F.size("of_b") - both))
        links = tables.stored(met.select("a", "b").distinct())
        self.links = links if self.links is None else self.links.unionByName(links)

    def both_ways(self) -> DataFrame:
        return self.links.select("a", "b").unionByName(self.links.select(F.col("b").alias("a"), F.col("a").alias("b")))


def components(links: _Links) -> DataFrame:
    """(v, label): every end of a link with the smallest end that it reaches.

    Labels and links are stored, so that adaptive execution can split the joins on a much-linked end. Long chains are shortened by
    pointer jumping, from the third step on.
    """
    edges = tables.stored(links.both_ways().toDF("u", "v"))
    labels = tables.stored(edges.groupBy("v").agg(F.least("v", F.min("u")).alias("label")))
    state, step = None, 0
    facts = {"n": F.count("*"), "total": F.sum(F.col("label").cast("decimal(38,0)")), "mark": F.sum(F.xxhash64("v", "label").cast("decimal(38,0)"))}
    while True:
        step += 1
        heard = edges.join(labels.withColumnRenamed("v", "u"), "u").select("v", "label").unionByName(labels)
        labels, now = tables.stored_with(heard.groupBy("v").agg(F.min("label").alias("label")), **facts)
        if now == state:
            return labels
        state = now
        if step >= 3:
            ahead = labels.select(F.col("v").alias("label"), F.col("label").alias("next"))
            labels, state = tables.stored_with(labels.join(ahead, "label").select("v", F.col("next").alias("label")), **facts)


def _sketches(sets: DataFrame) -> DataFrame:
    """One low bit of SKETCH further minima for each set, packed."""
    factors = words.mixed(np.arange(1 << 20, (1 << 20) + SKETCH, dtype=np.uint64)) | np.uint64(1)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                lists = part.column(1)
                shingle = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
                first = np.append(0, np.cumsum([len(x) for x in lists]))[:-1]
                low = np.empty((part.num_rows, SKETCH), dtype=np.uint8)
                turned = np.empty_like(shingle)
                for j, factor in enumerate(factors):
                    np.multiply(shingle, factor, out=turned)
                    low[:, j] = (np.minimum.reduceat(turned, first) >> np.uint64(8)) & np.uint64(1)
                packed = np.packbits(low, axis=1)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([row.tobytes() for row in packed], pa.binary())], ["fp", "sketch"])

    return sets.select("fp", "shingles").mapInArrow(rows, "fp long, sketch binary")


@dataclass(frozen=True)
class _Block:
    """Members of a bucket as arrays; the buckets of each are filled up with its first one."""

    fp: np.ndarray
    label: np.ndarray
    sketch: np.ndarray
    buckets: np.ndarray

    @classmethod
    def of(cls, members: pa.StructArray) -> _Block:
        fp, label, sketch, buckets = (members.field(name) for name in ("fp", "label", "sketch", "buckets"))
        sizes = np.diff(buckets.offsets.to_numpy())
        at = np.arange(sizes.max())
        first = buckets.offsets.to_numpy()[:-1, None]
        filled = buckets.values.to_numpy()[first + np.where(at < sizes[:, None], at, 0)]
        return cls(fp.to_numpy(), label.to_numpy(), np.frombuffer(b"".join(sketch.to_pylist()), dtype=np.uint64).reshape(len(fp), -1), filled)


def _close_pairs(least: float):
    """Pairs from two blocks of a bucket, or from one, that differ in label, may be links by their sketches and share no smaller bucket."""
    most = math.floor((1 - least) * SKETCH / 2)

    def of(table: pa.Table) -> pa.Table:
        bucket, low, high = (table[name][0].as_py() for name in ("bucket", "low", "high"))
        found = {block: _Block.of(members.values) for block, members in zip(table["block"].to_pylist(), table["members"], strict=True)}
        pairs = [np.empty((2, 0), dtype=np.int64)]
        if low in found and high in found:
            x, y = found[low], found[high]
            for at in range(0, len(x.fp), 64):
                part = slice(at, at + 64)
                apart = np.zeros((len(x.fp[part]), len(y.fp)), dtype=np.uint16)
                for one, other in zip(x.sketch[part].T, y.sketch.T, strict=True):
                    apart += np.bitwise_count(one[:, None] ^ other)
                i, j = np.nonzero((apart <= most) & (x.label[part, None] != y.label))
                i += at
                if low == high:
                    i, j = i[i < j], j[i < j]
                for some in range(0, len(i), 4096):
                    left, right = i[some : some + 4096], j[some : some + 4096]
                    earlier = x.buckets[left] < bucket
                    met = (x.buckets[left][:, :, None] == y.buckets[right][:, None, :]).any(axis=2)
                    first = ~(earlier & met).any(axis=1)
                    pairs.append(np.stack([x.fp[left[first]], y.fp[right[first]]]))
        a, b = np.concatenate(pairs, axis=1)
        return pa.table({"a": a, "b": b})

    return of


def _candidates(members: DataFrame, links: _Links) -> None:
    """Confirms links until no bucket can hold one between two components.

    A text from which many copies were made shares buckets with most of them, so the members that meet the most others are the pivots.
    All that are linked with one pivot are in one component and need no comparison. Members of a large bucket outside its main
    component are compared with its other members, one pair of packed blocks at a time. The comparison is of longer sketches, and a pair
    counts in the first bucket that it shares; only what may be a link leaves it. Degrees, labels and sketches stay with a class and
    its buckets, one row for each class: no join makes a row for each bucket of each member.
    """
    sized = tables.stored(members.groupBy("bucket").agg(F.count("*").alias("size")))
    small = members.join(sized.where(F.col("size") <= SMALL_BUCKET).select("bucket"), "bucket")
    met = members.join(sized.where(F.col("size") > SMALL_BUCKET), "bucket")
    degrees, facts = tables.stored_with(met.groupBy("fp").agg(F.sum("size").alias("degree"), F.array_sort(F.collect_list("bucket")).alias("buckets")), n=F.count("*"))
    large = degrees.select(F.explode("buckets").alias("bucket"), "fp", "degree")
    pairs = small.alias("x").join(small.alias("y"), (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.fp") < F.col("y.fp"))).select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b"))
    if not facts["n"]:
        links.confirm(pairs)
        return
    rank = F.row_number().over(Window.partitionBy("bucket").orderBy(F.desc("degree"), "fp"))
    pivots = tables.stored(large.withColumn("rank", rank).where(F.col("rank") <= PIVOTS).select("bucket", F.col("fp").alias("a"), F.col("degree").alias("of")))
    links.confirm(pairs.unionByName(pivots.select("bucket", "a").join(large.select("bucket", F.col("fp").alias("b")), "bucket").select("a", "b")))
    hubs = pivots.select("a", "of").distinct()
    star = hubs.join(links.both_ways(), "a").unionByName(hubs.withColumn("b", F.col("a"))).groupBy(F.col("b").alias("fp")).agg(F.max_by("a", F.struct("of", "a")).alias("label"))
    known = tables.stored(degrees.select("fp", "buckets").join(star, "fp", "left").withColumn("label", F.coalesce("label", "fp")))
    shares = known.select(F.explode("buckets").alias("bucket"), "label").groupBy("bucket", "label").agg(F.count("*").alias("part"))
    split = shares.groupBy("bucket").agg(F.max_by("label", "part").alias("main"), F.sum("part").alias("size"), F.max("part").alias("most")).where("most < size")
    blocks = (F.ceil(count / BLOCK).cast("long") for count in (F.col("size") - F.col("most"), F.col("most")))
    split = split.select("bucket", "main", *[count.alias(name) for count, name in zip(blocks, ("lefts", "rests"), strict=True)])
    split = tables.stored(split.join(pivots.groupBy("bucket").agg(F.collect_list("a").alias("pivots")), "bucket"))

    def placed(classes: DataFrame) -> DataFrame:
        """Members of split buckets: those to be compared in the blocks below `lefts`, the others behind them."""
        mixed = F.xxhash64("fp")
        left = (F.col("label") != F.col("main")) & ~F.array_contains("pivots", F.col("fp"))
        block = F.when(left, F.pmod(mixed, F.col("lefts"))).otherwise(F.col("lefts") + F.pmod(mixed, F.col("rests")))
        return classes.withColumn("bucket", F.explode("buckets")).join(split, "bucket").withColumn("block", block)

    if placed(known).where("block < lefts").isEmpty():
        return
    sketched = tables.stored(known.join(_sketches(links.sets.join(placed(known).select("fp").distinct(), "fp", "left_semi")), "fp"))
    # Dealt by block and by pair of blocks: rows that lie by bucket already would stay so, and one task would compare a whole bucket.
    packed = placed(sketched).repartition("bucket", "block").groupBy("bucket", "lefts", "rests", "block").agg(F.collect_list(F.struct("fp", "label", "sketch", "buckets")).alias("members"))
    last = F.when(F.col("block") < F.col("lefts"), F.col("lefts") + F.col("rests")).otherwise(F.col("lefts")) - 1
    facing = packed.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    facing = facing.select("bucket", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "members")
    least = links.plan.percent / 100 - 12 * math.sqrt((1 - (links.plan.percent / 100) ** 2) / 4 / SKETCH)
    links.confirm(facing.repartition("bucket", "low", "high").groupBy("bucket", "low", "high").applyInArrow(_close_pairs(least), "a long, b long"))


def groups(docs: DataFrame, percent: int = 80, size: int = SHINGLE) -> DataFrame:
    """One row per document: d (id in order, last where null), t (text key), n_shingles and component (as d)."""
    plan = Bands.of(percent)
    rows = tables.stored(_described(docs, plan, size))
    classes = tables.stored(rows.where("n > 0").groupBy("fp", "fp2").agg(F.min("d").alias("d"), F.max("n").alias("n"), *[F.max(s).alias(s) for s in plan.planes]))
    spread = rows.where("n > 0").join(classes.select("fp", "fp2", "d"), ["fp", "fp2", "d"], "left_semi").select("fp", F.explode("bands").alias("bucket"))
    shared = tables.stored(spread.groupBy("bucket").agg(F.min("fp").alias("low"), F.max("fp").alias("high")).where("low < high").select("bucket"))
    members = tables.stored(spread.join(shared, "bucket").distinct())
    wanted = classes.join(members.select("fp").distinct(), "fp", "left_semi").select(F.col("d").alias("__d")).distinct()
    texts = docs.select("text", tables.order_key().alias("__d")).join(wanted, "__d", "left_semi")
    links = _Links(plan, classes, tables.stored(_set_rows(texts, size)))
    _candidates(members, links)
    labels = components(links).withColumnRenamed("v", "fp")
    named = labels.join(classes.select("fp", "d"), "fp")
    smallest = tables.stored(named.groupBy("label").agg(F.min("d").alias("component")))
    linked = labels.join(smallest, "label").select("fp", "component")
    found = tables.stored(classes.join(linked, "fp", "left").select("fp", "fp2", F.coalesce("component", "d").alias("component")))
    return rows.select("d", "t", "n", "fp", "fp2").join(found, ["fp", "fp2"], "left").select("d", "t", F.col("n").alias("n_shingles"), F.coalesce("component", "d").alias("component"))


def report(docs: DataFrame, percent: int) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every document."""
    own, component = (F.when(F.col(name) != tables.LAST, F.col(name)) for name in ("d", "component"))
    return groups(docs, percent).select(own.alias("doc_id"), "n_shingles", component.alias("component_id"), F.expr("d = component").alias("kept"))


def without_near_duplicates(docs: DataFrame, percent: int = 80) -> DataFrame:
    """The documents of smallest id of each group, with all their columns. Rows that repeat id and text are one document; rows without an id give way to rows with one, never to one another unless their texts are equal."""
    stay = groups(docs, percent).where("d = component").select(F.col("d").alias("__d"), F.col("t").alias("__t")).distinct()
    keyed = docs.withColumns({"__order": tables.order_key(), "__text": tables.text_key()})
    kept = keyed.join(stay, (F.col("__order") == F.col("__d")) & (F.col("__text") == F.col("__t")), "left_semi")
    return kept.dropDuplicates(["__order", "__text"]).select(*docs.columns)
