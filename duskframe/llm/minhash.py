"""Near-duplicate documents by similarity sketches.

A document is its set of distinct 5-word shingles (hashed to 64 bits). The sketch has COORDINATES bins. In
round 0, 1, ... every shingle is hashed to a bin and a value; a bin keeps its least (round, value). From
round COORDINATES on, round r fills bin r - COORDINATES with every shingle, so after at most twice
COORDINATES rounds no bin is empty; rounds stop as soon as none is. Bins of two sets agree with a
probability equal to their Jaccard likeness, concentrated as for independent hashes, at the cost of about
one hash for each shingle instead of COORDINATES.

Bands of ROWS bins are bucket keys; two sets that share two buckets or more are candidates. At likeness 0.75
a pair shares fewer with a probability of 5e-6. Candidates are confirmed on the full sets:

1. equal sets are one representative (the least id); the other ids are linked to it;
2. in each bucket, the member that meets most others is the leader; members that are candidates with their
   leader form clusters with it, so a group of edited copies is one cluster, whatever its size;
3. within a cluster all pairs meet as a product of 0/1 matrices, in tiles of TILE x TILE sets, so no table
   of pairs is made; of a tile only the links' components come out, a row for each set at most. A set is copied
   to every tile of its cluster; where that were more than LED copies, each member meets one leader first, the one
   it shares most bands with. Members of the component that then holds most of the cluster are connected already:
   they meet the others, and the others one another, but not themselves;
4. candidates of different clusters share buckets with members of several components. In these, members of the
   component that holds most of a bucket meet the others, and the others one another, in tiles of the same size;
   pairs within the first component are not met again, and no table of pairs is made here either.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textbytes
from .columns import small_batches
from .components import connected_components
from .scratch import Scratch

SHINGLE = 5
BANDS = 40
ROWS = 4
COORDINATES = BANDS * ROWS
LIKENESS_PERCENT = 75
#: Shared bands that make a candidate.
SHARED = 2
#: Sets on each side of a tile, and shingles that are multiplied at once.
TILE = 512
COLUMNS = 4096
#: Tiles for each set of a cluster beyond which its leaders are met first.
LED = 32
#: A tile's number is SIDE times the number of its one chunk, and that of its other one.
SIDE = 1 << 31
#: Sets, a copy for each of their tiles, of the small tiles that are met together.
BUNDLE = 1000

_EMPTY = np.uint64(2**64 - 1)
_ROUND = 0xA0761D6478BD642F
_MASK = 2**64 - 1


def _sets(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last + 1, distinct shingle hashes, their texts): sorted by text, then hash."""
    for i, j, hashes, text_of in textbytes.word_blocks(texts):
        hashes, owner = textbytes.shingle_hashes(hashes, text_of, j - i, SHINGLE)
        order = np.lexsort((hashes, owner))
        hashes, owner = hashes[order], owner[order]
        fresh = np.ones(len(hashes), bool)
        fresh[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
        yield i, j, hashes[fresh], owner[fresh]


def fill_bins(hashes: np.ndarray, owner: np.ndarray, n: int, t: int = COORDINATES) -> np.ndarray:
    """The sketches, n x t, of n sets given as (element hash, set) in order of set. Empty sets have empty bins."""
    bins = np.full(n * t, _EMPTY, np.uint64)
    with_rows = np.zeros(n, bool)
    with_rows[owner] = True
    for r in range(2 * t):
        drawn = textbytes.mix(hashes + np.uint64((r + 1) * _ROUND & _MASK))
        # 9 bits of round, 55 of value; the bin comes from another scramble.
        value = (np.uint64(min(r, 511)) << np.uint64(55)) | (drawn >> np.uint64(9))
        place = (textbytes.mix(drawn) % np.uint64(t)).astype(np.int64) if r < t else np.full(len(hashes), r - t)
        at = owner * t + place
        if len(at) > 4 * n:
            order = np.lexsort((value, at))
            at, value = at[order], value[order]
            first = np.ones(len(at), bool)
            first[1:] = at[1:] != at[:-1]
            at, value = at[first], value[first]
            bins[at] = np.minimum(bins[at], value)
        else:
            np.minimum.at(bins, at, value)
        open_sets = (bins.reshape(n, t) == _EMPTY).any(1) & with_rows
        if not open_sets.any():
            break
        left = open_sets[owner]
        if not left.all():
            hashes, owner = hashes[left], owner[left]
    return bins.reshape(n, t)


def band_keys(sketch: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """A 64-bit key for each band of each sketch; the band's number is part of it."""
    n, t = sketch.shape
    parts = sketch.reshape(n, bands, t // bands)
    keys = np.broadcast_to(np.arange(bands, dtype=np.uint64) + np.uint64(1), (n, bands)).copy()
    for k in range(t // bands):
        keys = textbytes.mix(keys * np.uint64(0xE7037ED1A0B428DB) + parts[:, :, k])
    return keys


def _sketch_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1)
        for i, j, hashes, owner in _sets(texts):
            n = j - i
            size = np.bincount(owner, minlength=n).astype(np.int64)
            sums = []
            for salt in (1, 2):
                total = np.zeros(n, np.uint64)
                np.add.at(total, owner, textbytes.mix(hashes ^ np.uint64(salt * _ROUND & _MASK)))
                sums.append(pa.array(total.view(np.int64)))
            keys = band_keys(fill_bins(hashes, owner, n))
            keys[size == 0] = 0
            offsets = np.arange(n + 1, dtype=np.int32) * BANDS
            yield pa.RecordBatch.from_arrays([ids.slice(i, n), pa.array(size), *sums, pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.view(np.int64).ravel()))], ["doc_id", "n_shingles", "set_a", "set_b", "bands"])


def _set_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1)
        for i, j, hashes, owner in _sets(texts):
            offsets = np.zeros(j - i + 1, np.int32)
            np.cumsum(np.bincount(owner, minlength=j - i), out=offsets[1:])
            yield pa.RecordBatch.from_arrays([ids.slice(i, j - i), pa.ListArray.from_arrays(pa.array(offsets), pa.array(hashes.view(np.int64)))], ["doc_id", "shingles"])


def sketches(df: DataFrame) -> DataFrame:
    """doc_id, n_shingles, set_a and set_b (sums over the set: equal for equal sets), bands; from doc_id, text."""
    schema = T.StructType([df.schema["doc_id"], *[T.StructField(c, T.LongType()) for c in ("n_shingles", "set_a", "set_b")], T.StructField("bands", T.ArrayType(T.LongType()))])
    small_batches(df.sparkSession)
    return df.select("doc_id", "text").mapInArrow(_sketch_batches, schema)


def shingle_sets(df: DataFrame) -> DataFrame:
    """doc_id, shingles: the distinct hashes in order; from doc_id, text."""
    schema = T.StructType([df.schema["doc_id"], T.StructField("shingles", T.ArrayType(T.LongType()))])
    small_batches(df.sparkSession)
    return df.select("doc_id", "text").mapInArrow(_set_batches, schema)


def shared_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Numbers of common elements of all sets of `left` with all of `right`."""
    total = np.zeros((len(left), len(right)), np.float32)
    elements = np.concatenate([*left, *right])
    owner = np.repeat(np.arange(len(left) + len(right)), [len(x) for x in (*left, *right)])
    _, column, count = np.unique(elements, return_inverse=True, return_counts=True)
    common = count[column] > 1  # others are in one set only, or on one side
    column, owner = column[common], owner[common]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    column = np.cumsum(np.r_[0, np.diff(column) > 0]) if len(column) else column
    for a in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        part = slice(*np.searchsorted(column, [a, a + COLUMNS]))
        ones = np.zeros((len(left) + len(right), COLUMNS), np.float32)
        ones[owner[part], column[part] - a] = 1
        total += ones[: len(left)] @ ones[len(left) :].T
    return total


def _link_tiles(percent: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        cluster, tile = table["cluster"].to_numpy(), table["tile"].to_numpy()
        chunk, ids = table["chunk"].to_numpy(), table["id"].to_numpy()
        sets = table["shingles"].combine_chunks()
        values, at = sets.values.to_numpy(), sets.offsets.to_numpy()
        order = np.lexsort((ids, tile, cluster))
        cut = np.flatnonzero((np.diff(cluster[order]) != 0) | (np.diff(tile[order]) != 0)) + 1
        nodes, roots = [], []
        for part in np.split(order, cut):
            rows, cols = divmod(int(tile[part[0]]), SIDE)
            left, right = (part[chunk[part] == c] for c in (rows, cols))
            own = [[values[at[k] : at[k + 1]] for k in side] for side in (left, right)]
            both = shared_counts(*own)
            sizes = [np.array([len(x) for x in side], np.float32) for side in own]
            linked = 100 * both >= percent * (sizes[0][:, None] + sizes[1][None, :] - both)
            least_l, least_r = ids[left].copy(), ids[right].copy()
            far = np.iinfo(np.int64).max
            while linked.any():
                new_l = np.minimum(least_l, np.where(linked, least_r[None, :], far).min(1))
                new_r = np.minimum(least_r, np.where(linked, new_l[:, None], far).min(0))
                if (new_l == least_l).all() and (new_r == least_r).all():
                    break
                least_l, least_r = new_l, new_r
            nodes += [ids[left], ids[right]]
            roots += [least_l, least_r]
        nodes, roots = np.concatenate(nodes), np.concatenate(roots)
        return pa.table({"a": roots[roots < nodes], "b": nodes[roots < nodes]})

    return run


def _link_clusters(clusters: DataFrame, docs: DataFrame, scratch: Scratch, percent: int) -> DataFrame:
    """Links (a, b) that span the components within each cluster of (id, cluster, known); an id may be in several.

    Members that are `known` don't meet one another, but all others.
    """
    chunks_of = lambda x: F.ceil(F.count_if(x) / TILE).cast("int")
    sizes = clusters.groupBy("cluster").agg(chunks_of(F.col("known")).alias("before"), chunks_of(~F.col("known")).alias("others"))
    sizes = scratch.save(sizes.filter("others > 0").select("cluster", "before", (F.col("before") + F.col("others")).alias("chunks")))
    # Chunks of known members come first.
    deal = lambda n: F.pmod(F.xxhash64("id"), n).cast("int")
    chunk = F.when(F.col("known"), deal(F.col("before"))).otherwise(F.col("before") + deal(F.col("chunks") - F.col("before")))
    rows = clusters.join(sizes, "cluster").withColumn("chunk", chunk)
    rows = scratch.save(rows)
    # A set is in a tile for each chunk of its cluster. Small tiles share a task; whole ones have their own.
    copies = rows.agg(F.sum(F.when(F.col("chunks") <= 2, F.col("chunks")))).first()[0] or 0
    bundles = copies // BUNDLE + 1
    sets = shingle_sets(docs.join(rows.select(F.col("id").alias("doc_id")), "doc_id", "left_semi"))
    first = F.when(F.col("known"), F.col("before")).otherwise(0)
    tiles = F.transform(F.sequence(first, F.col("chunks") - 1), lambda c: F.least(c, F.col("chunk")) * F.lit(SIDE) + F.greatest(c, F.col("chunk")))
    rows = rows.join(sets, F.col("id") == F.col("doc_id")).select("cluster", "chunks", "chunk", "id", "shingles", F.explode(tiles).alias("tile"))
    small = F.col("chunks") <= 2
    bundle = F.when(small, F.pmod(F.xxhash64("cluster", "tile"), F.lit(bundles)))
    alone = [F.when(~small, F.col(c)).alias(f"own_{c}") for c in ("cluster", "tile")]
    return scratch.save(rows.withColumn("bundle", bundle).groupBy("bundle", *alone).applyInArrow(_link_tiles(percent), "a long, b long").distinct())


def _link_leaders(stars: DataFrame, docs: DataFrame, scratch: Scratch, percent: int) -> DataFrame:
    """Links (a, b) among the pairs of (id, leader): about TILE ids meet their leader at once, so each set is sent once
    and a leader's once for each TILE of its ids."""
    sizes = scratch.save(stars.groupBy("leader").agg(F.ceil(F.count("*") / TILE).cast("int").alias("chunks")))
    stars = scratch.save(stars.join(sizes, "leader").select("id", F.col("leader").alias("cluster"), F.pmod(F.xxhash64("id"), "chunks").cast("int").alias("part")))
    # One tile for each part of a leader's ids: the leader is its chunk 0, the ids are its chunk 1.
    heads = stars.select(F.col("cluster").alias("id"), "cluster", "part", F.lit(0).alias("chunk")).distinct()
    rows = scratch.save(stars.withColumn("chunk", F.lit(1)).unionByName(heads))
    sets = shingle_sets(docs.join(rows.select(F.col("id").alias("doc_id")), "doc_id", "left_semi"))
    rows = rows.join(sets, F.col("id") == F.col("doc_id")).select("cluster", "part", "chunk", "id", "shingles", F.lit(1).cast("long").alias("tile"))
    return scratch.save(rows.groupBy("cluster", "part").applyInArrow(_link_tiles(percent), "a long, b long").distinct())


def _led(clusters: DataFrame, stars: DataFrame, docs: DataFrame, scratch: Scratch, percent: int) -> tuple[DataFrame, DataFrame | None]:
    """Clusters (id, cluster, known) and the links by which their known members are connected, none where no cluster
    is large. Stars are candidate pairs (a, b, shared) of leaders a and their members."""
    large = scratch.save(clusters.groupBy("cluster").agg(F.count("*").alias("n")).filter(F.col("n") > LED * TILE).select("cluster"))
    if not large.limit(1).count():
        return clusters.withColumn("known", F.lit(False)), None
    one = stars.groupBy(F.col("b").alias("id")).agg(F.max(F.struct("shared", -F.col("a"))).alias("top")).select("id", (-F.col("top.col2")).alias("leader"))
    members = scratch.save(clusters.join(large, "cluster", "left_semi"))
    links = _link_leaders(one.join(members.select("id"), "id", "left_semi"), docs, scratch, percent)
    parts = connected_components(links, scratch)
    parts = scratch.save(members.join(parts, F.col("id") == F.col("node"), "left").select("id", "cluster", F.coalesce("root", "id").alias("part")))
    most = parts.groupBy("cluster", "part").agg(F.count("*").alias("n")).groupBy("cluster").agg(F.max(F.struct("n", "part")).alias("most"))
    led = parts.join(scratch.save(most), "cluster").select("id", "cluster", (F.col("part") == F.col("most.part")).alias("known"))
    return scratch.save(clusters.join(large, "cluster", "left_anti").withColumn("known", F.lit(False)).unionByName(led)), links


def near_groups(df: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = LIKENESS_PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of `df`.

    Documents are linked when 100 * shared >= percent * union of their sets; component_id is the least id
    that links reach, kept marks that document. Texts that are null or hold no word have empty sets and
    link with nothing. Rows that repeat an id are one document, linked wherever one of its texts is. Null ids
    link with nothing and have a null component. An empty table gives no rows.
    """
    scratch = Scratch(df.sparkSession, "minhash")
    docs = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    drawn = scratch.save(sketches(docs))
    full = drawn.filter("n_shingles > 0 and doc_id is not null")
    first = scratch.save(full.groupBy("n_shingles", "set_a", "set_b").agg(F.min("doc_id").alias("rep")))
    rows = full.join(first, ["n_shingles", "set_a", "set_b"])
    rows = scratch.save(rows.select("doc_id", F.col("n_shingles").alias("n"), "rep", F.when(F.col("doc_id") == F.col("rep"), F.col("bands")).alias("bands")))
    copies = rows.filter("doc_id != rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))

    keyed = rows.filter("bands is not null").select(F.col("rep").alias("id"), F.explode("bands").alias("key")).distinct()
    mates = scratch.save(keyed.groupBy("key").agg(F.count("*").alias("mates")).filter("mates > 1"))
    members = scratch.save(keyed.join(mates, "key"))
    degree = scratch.save(members.groupBy("id").agg(F.sum("mates").alias("degree")))
    leaders = members.join(degree, "id").groupBy("key").agg(F.max(F.struct("degree", -F.col("id"))).alias("top")).select("key", (-F.col("top.col2")).alias("leader"))
    stars = members.join(scratch.save(leaders), "key").filter("id != leader").groupBy(F.col("leader").alias("a"), F.col("id").alias("b")).agg(F.count("*").alias("shared"))
    stars = scratch.save(stars.filter(F.col("shared") >= SHARED))
    parts = connected_components(stars.select("a", "b"), scratch)
    clusters = parts.select(F.col("node").alias("id"), F.col("root").alias("cluster"))
    clusters = scratch.save(clusters.unionByName(clusters.select(F.col("cluster").alias("id"), "cluster").distinct()))
    clusters, near = _led(clusters, stars, docs, scratch, percent)
    links = _link_clusters(clusters, docs, scratch, percent)
    links = links if near is None else links.unionByName(near)
    clusters = clusters.drop("known")

    parts = connected_components(links, scratch)
    placed = members.select("key", "id").join(clusters, "id", "left").join(parts, F.col("id") == F.col("node"), "left")
    placed = placed.select("key", "id", F.coalesce("cluster", "id").alias("cluster"), F.coalesce("root", "id").alias("part"))
    mixed = placed.groupBy("key").agg(F.min("cluster").alias("p"), F.max("cluster").alias("q")).filter("p < q").select("key")
    placed = scratch.save(placed.join(mixed, "key", "left_semi").select("key", "id", "part"))
    counts = placed.groupBy("key", "part").agg(F.count("*").alias("n"), F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("who"))
    buckets = counts.groupBy("key").agg(F.sum("n").alias("n"), F.count("*").alias("parts"), F.sum("who").alias("who"), F.max(F.struct("n", "part")).alias("most")).filter("parts > 1")
    # Of buckets of the same members one is met. One that fills no more than a tile is met whole.
    once = scratch.save(buckets.groupBy("n", "who").agg(F.min(F.struct("key", F.when(F.col("n") > TILE, F.col("most.part")).alias("most"))).alias("b")).select("b.key", "b.most"))
    apart = scratch.save(placed.join(once, "key").select("id", F.col("key").alias("cluster"), F.col("part").eqNullSafe(F.col("most")).alias("known")).distinct())
    links = links.unionByName(_link_clusters(apart, docs, scratch, percent))

    parts = connected_components(links.unionByName(copies), scratch)
    out = drawn.select("doc_id", "n_shingles").join(parts, F.col("doc_id") == F.col("node"), "left")
    return out.select("doc_id", "n_shingles", F.coalesce("root", "doc_id").alias("component_id"), (F.col("doc_id") == F.coalesce("root", "doc_id")).alias("kept"))


def drop_near_copies(df: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = LIKENESS_PERCENT) -> DataFrame:
    """The rows of `df` that stay: one document, that of the least id, of every group; one row where rows repeat it.

    Rows without an id can't be told apart by one and all stay.
    """
    groups = near_groups(df.filter(F.col(doc_id).isNotNull()), doc_id, text, percent).filter("kept").select(F.col("doc_id").alias("__kept")).distinct()
    kept = df.join(groups, F.col(doc_id) == F.col("__kept"), "left_semi").dropDuplicates([doc_id])
    return kept.unionByName(df.filter(F.col(doc_id).isNull()))
