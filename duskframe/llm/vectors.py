"""Near-duplicate vectors by collision counting over sorted one-dimensional projections.

Each vector is projected on many directions. Of each direction only the two ends are kept, as lists: a vector is
put on the lists on which it lies farthest out. Members of a list are sorted by their place on a second direction
of its own, on which unrelated members lie apart, and a window of WIDTH to either side slides along. Two vectors
collide once for every list on which they are in each other's window; vectors at cosine 0.9 do so several times,
random ones hardly ever. A pair that collides COUNT times or more is verified by its cosine in double precision.
`recall` measures, by simulation, how many pairs of a given cosine pass the count, and `window_share` how many of
the pairs on a list are in each other's window; COUNT, WIDTH and LISTS were set by them.

A direction is one of m half-directions for the first half of the coordinates and one of m for the second,
after one of TURNS random rotations. The farthest of the m * m sums are sums of the farthest terms, so a
vector finds its lists from m numbers. The number of directions grows with the number of vectors: lists keep
their mean length, and the work grows in proportion to the vectors.

A row of a list carries the vector and its other lists, so a pair is decided where it first collides; no table of
pairs is made. There the cosines of a window are one matrix product, which costs less than counting, so collisions
are counted for the pairs that pass it; a pair counts if it passes both. Counting ends at the first list before this
one, or at COUNT. A list that is long (a dense group) is parted into blocks, and each two blocks meet in a task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import connected_components
from .scratch import Scratch

COSINE = 0.9
#: Mean members of a list, rotations, and lists of a vector at each end of a rotation.
LIST = 24
TURNS = 4
ENDS = 4
LISTS = 2 * TURNS * ENDS
COUNT = 2
WIDTH = 1.1
#: Pairs of a list that are met at once.
PAIRS = 1 << 20
#: Numbers of a table of members and lists; beyond that places are looked for in order.
TABLE = 1 << 23
#: Members of a block of a long list, on average.
QUERIES = 4096
_SEED = 20240229


def half_directions(n: int) -> int:
    """m, so that the lists of n vectors have LIST members on average."""
    return max(4, math.ceil(math.sqrt(n * ENDS / LIST)))


def _name_type(n: int) -> type:
    return np.int32 if 2 * TURNS * half_directions(n) ** 2 < 2**31 else np.int64


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows at length 1, in double precision; scaled first, so that no square overflows."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _geometry(dim: int, m: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each rotation, the half-directions of its two halves."""
    rng, half, out = np.random.default_rng([_SEED, dim, m]), dim - dim // 2, []
    for _ in range(TURNS):
        turn, _r = np.linalg.qr(rng.standard_normal((dim, dim)))
        out.append((turn[:, :half] @ rng.standard_normal((half, m)), turn[:, half:] @ rng.standard_normal((dim - half, m))))
    return out


def lists_of(x: np.ndarray, geometry: list) -> tuple[np.ndarray, np.ndarray]:
    """The lists of each unit vector, in order, and its places along them: two arrays of n x LISTS."""
    lists, places = [], []
    rows = np.arange(len(x))[:, None]
    for r, (left, right) in enumerate(geometry):
        m = left.shape[1]
        s, t = x @ left, x @ right
        for end, sign in enumerate((1.0, -1.0)):
            i, j = (np.argpartition(-sign * v, ENDS - 1, axis=1)[:, :ENDS] for v in (s, t))
            sums = (sign * (s[rows, i][:, :, None] + t[rows, j][:, None, :])).reshape(len(x), -1)
            best = np.argpartition(-sums, ENDS - 1, axis=1)[:, :ENDS]
            i, j = i[rows, best // ENDS], j[rows, best % ENDS]
            lists.append(((r * m + i) * m + j) * 2 + end)
            places.append(s[rows, (i + 1) % m] + t[rows, (j + 1) % m])  # on the direction after the list's own
    lists, places = np.concatenate(lists, 1).astype(np.int64), np.concatenate(places, 1)
    order = np.argsort(lists, 1)
    return np.take_along_axis(lists, order, 1), np.take_along_axis(places, order, 1)


def recall(n: int, cosine: float = COSINE, dim: int = 64, pairs: int = 4000) -> float:
    """Share of simulated random pairs of the given cosine that pass the count, with the directions for n vectors."""
    rng = np.random.default_rng(5)
    a = _unit(rng.standard_normal((pairs, dim)))
    away = rng.standard_normal((pairs, dim))
    away = _unit(away - (away * a).sum(1, keepdims=True) * a)
    geometry = _geometry(dim, half_directions(n))
    (la, pa_), (lb, pb) = lists_of(a, geometry), lists_of(cosine * a + math.sqrt(1 - cosine**2) * away, geometry)
    hits = ((la[:, :, None] == lb[:, None, :]) & (np.abs(pa_[:, :, None] - pb[:, None, :]) <= WIDTH)).sum((1, 2))
    return float((hits >= COUNT).mean())


def window_share(n: int, dim: int = 64, vectors: int = 3000) -> float:
    """Share of the pairs of simulated unrelated vectors on one list that are in each other's window."""
    x = _unit(np.random.default_rng(6).standard_normal((vectors, dim)))
    lists, places = lists_of(x, _geometry(dim, half_directions(n)))
    order = np.argsort(lists.ravel(), kind="stable")
    name, place = lists.ravel()[order], places.ravel()[order]
    same = name[1:] == name[:-1]
    return float((np.abs(np.diff(place))[same] <= WIDTH).mean())


def _deal(n: int, kind: type):
    m, name = half_directions(n), _name_type(n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, tuple] = {}
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                vectors = part.column("vector").to_pylist()
                rows: dict[str, list] = {c: [] for c in ("list", "dim", "id", "copies", "vector", "lists", "places")}
                for dim in {len(v) for v in vectors}:
                    of = [i for i, v in enumerate(vectors) if len(v) == dim]
                    raw = np.array([vectors[i] for i in of], kind)
                    unit = _unit(raw)
                    if dim not in known:
                        known[dim] = _geometry(dim, m)
                    for i, u, lists, places in zip(of, raw, *lists_of(unit, known[dim])):
                        n_lists, places = len(lists), places.astype(np.float16)
                        rows["list"].append(lists)
                        rows["dim"] += [dim] * n_lists
                        rows["id"] += [part.column("id")[i].as_py()] * n_lists
                        rows["copies"] += [part.column("copies")[i].as_py()] * n_lists
                        rows["vector"] += [u.tobytes()] * n_lists
                        rows["lists"] += [lists.astype(name).tobytes()] * n_lists
                        rows["places"] += [places.tobytes()] * n_lists
                rows["list"] = np.concatenate(rows["list"]) if rows["list"] else []
                yield pa.RecordBatch.from_arrays([pa.array(rows["list"], pa.int64()), pa.array(rows["dim"], pa.int32()), pa.array(rows["id"], pa.int64()), pa.array(rows["copies"], pa.int64()), *[pa.array(rows[c], pa.binary()) for c in ("vector", "lists", "places")]], list(rows))

    return run


class _List:
    """The members of one list, and the places that they have on each other's lists."""

    def __init__(self, this: int, x: np.ndarray, lists: np.ndarray, places: np.ndarray):
        """`x`: unit vectors; `lists` and `places`: a row for each member, LISTS names in order and the places there."""
        self.x, self.place = x, places[lists == this]
        # Lists that only one member is on tell nothing of a pair; names count from 0, -1 for such a list.
        names, back, count = np.unique(lists, return_inverse=True, return_counts=True)
        shared = count[back.reshape(lists.shape)] > 1
        self.n_names = int((count > 1).sum())
        number = np.where(count > 1, np.cumsum(count > 1) - 1, -1)
        self.name, self.at = number[back.reshape(lists.shape)], places
        self.here = int(number[np.searchsorted(names, this)])
        member = np.broadcast_to(np.arange(len(x))[:, None], lists.shape)
        if len(x) * self.n_names <= TABLE:
            self.table = np.full((len(x), self.n_names), np.inf)
            self.table[member[shared], self.name[shared]] = places[shared]
        else:
            self.table = None
            self.keys = member[shared] * self.n_names + self.name[shared]  # in order already
            self.values = places[shared]

    def _places(self, member: np.ndarray, name: np.ndarray) -> np.ndarray:
        """Where members lie on lists; far off where they are not on them."""
        if self.table is not None:
            return self.table[member, name]
        key = member * self.n_names + name
        found = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[found] == key, self.values[found], np.inf)

    def near(self, cosine: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(queries, members) in each other's window on this list at a cosine of `cosine` or more, some queries at a time."""
        order = np.argsort(self.place, kind="stable")
        place, x = self.place[order], self.x[order]
        lo, hi = np.searchsorted(place, place - WIDTH, "left"), np.searchsorted(place, place + WIDTH, "right")
        step = max(1, PAIRS // (4 * len(place)))
        for q in range(0, len(place), step):
            some = slice(q, min(q + step, len(place)))
            first, last = int(lo[some][0]), int(hi[some][-1])
            like = x[some] @ x[first:last].T
            a, b = np.nonzero(like >= cosine - 1e-9)
            a, b = a + q, b + first
            inside = (b >= lo[a]) & (b < hi[a]) & (a != b)
            a, b = a[inside], b[inside]
            for k in range(0, len(a), PAIRS // 16):
                c, d = a[k : k + PAIRS // 16], b[k : k + PAIRS // 16]
                sure = np.einsum("ij,ij->i", x[c], x[d]) >= cosine
                yield order[c[sure]], order[d[sure]]

    def begin_here(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which pairs, in each other's window on this list, collide COUNT times or more, and on no list before this one."""
        count, alive = np.zeros(len(a), np.int64), np.arange(len(a))
        for k in range(self.name.shape[1]):
            name = self.name[a[alive], k]
            hit = np.zeros(len(alive), bool)
            on = np.flatnonzero(name >= 0)
            hit[on] = np.abs(self._places(b[alive[on]], name[on]) - self.at[a[alive[on]], k]) <= WIDTH
            count[alive[hit]] += 1
            before = hit & (name < self.here)
            count[alive[before]] = -LISTS  # found on that list
            alive = alive[~before & (count[alive] < COUNT)]
            if not len(alive):
                break
        return count >= COUNT


def _join(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels in which those of a and b are one, the least of both."""
    x, y = label[a], label[b]
    while len(x):
        apart = x != y
        x, y = np.minimum(x, y)[apart], np.maximum(x, y)[apart]
        to = np.arange(len(label))
        np.minimum.at(to, y, x)
        while (to[to] != to).any():
            to = to[to]
        label, x, y = to[label], to[x], to[y]
    return label


def _match(cosine: float, name: type, kind: type):
    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        of = table["list"].to_numpy()
        order = np.argsort(of, kind="stable")
        starts = np.flatnonzero(np.r_[True, of[order][1:] != of[order][:-1]])
        ids, copies, side = table["id"].to_numpy(), table["copies"].to_numpy(), table["side"].to_numpy()
        vectors, lists, places = (table[c].combine_chunks() for c in ("vector", "lists", "places"))
        rows = lambda column, part, kind: [np.frombuffer(column[int(i)].as_buffer(), kind) for i in part]
        out_id, out_links, out_least = [], [], []
        for part in np.split(order, starts[1:]):
            if len(part) < 2:
                continue
            x = _unit(np.array(rows(vectors, part, kind)))
            group = _List(int(of[part[0]]), x, np.stack(rows(lists, part, name)), np.stack(rows(places, part, np.float16)).astype(np.float64))
            label, links, own = np.arange(len(part)), np.zeros(len(part), np.int64), side[part]
            for a, b in group.near(cosine):
                across = (own[a] == 0) | (own[a] != own[b])
                a, b = a[across], b[across]
                mine = group.begin_here(a, b)
                a, b = a[mine], b[mine]
                links += np.bincount(a, copies[part][b], len(part)).astype(np.int64)
                label = _join(label, a, b)
            least = np.full(len(part), np.iinfo(np.int64).max)
            np.minimum.at(least, label, ids[part])
            touched = (links > 0) | (ids[part] != least[label])
            out_id.append(ids[part][touched])
            out_links.append(links[touched])
            out_least.append(least[label][touched])
        cat = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
        return pa.table({"id": cat(out_id), "links": cat(out_links), "least": cat(out_least)})

    return run


def vector_groups(df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", cosine: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of `df`.

    Vectors are linked at a cosine of `cosine` or more. Vectors that are null, empty, zero, or hold null or
    non-finite components link with nothing, nor do vectors of different lengths. Equal vectors are met once,
    as one, and count as linked with each other. Rows that repeat an id with one vector are vectors of their
    own; vectors of one id share its links and its component. Null ids link with nothing and have a null component. Other columns are
    not read. An empty table gives no rows.
    """
    spark, scratch = df.sparkSession, Scratch(df.sparkSession, "vectors")
    raw = F.col(embedding)
    kind, element = (np.float32, "float") if df.schema[embedding].dataType.elementType == T.FloatType() else (np.float64, "double")
    finite = F.forall(raw, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    usable = F.coalesce(raw.isNotNull() & finite & F.exists(raw, lambda x: x != 0), F.lit(False))
    rows = scratch.save(df.select(F.col(vec_id).alias("vec_id"), F.when(usable & F.col(vec_id).isNotNull(), raw.cast(f"array<{element}>")).alias("vector")))
    good = rows.filter("vector is not null")
    reps = scratch.save(good.groupBy("vector").agg(F.min("vec_id").cast("long").alias("id"), F.count("*").alias("copies")))
    n = reps.count()
    deal_schema = "list long, dim int, id long, copies long, vector binary, lists binary, places binary"
    dealt = reps.repartition(max(spark.sparkContext.defaultParallelism, n // 5000 + 1)).mapInArrow(_deal(n, kind), deal_schema)
    # Lists of more than QUERIES rows are parted into blocks; a row goes to the tiles of its block with each of
    # the list's blocks, where the members of one meet those of the other (side 0: a block meets itself). There
    # is at most one such list for every QUERIES / LISTS vectors.
    hot = dealt.groupBy("dim", "list").agg(F.count("*").alias("n")).filter(F.col("n") > QUERIES)
    hot = scratch.save(hot.select("dim", "list", F.ceil(F.col("n") / QUERIES).cast("int").alias("chunks")))
    lists = dealt.join(hot, ["dim", "list"], "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    lists = lists.withColumn("block", F.pmod(F.xxhash64("id"), F.col("chunks"))).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    lists = lists.withColumn("chunk", F.least("block", "with") * F.lit(1 << 20) + F.greatest("block", "with"))
    lists = lists.withColumn("side", F.when(F.col("block") == F.col("with"), 0).when(F.col("block") < F.col("with"), 1).otherwise(2))
    lists = lists.withColumn("own_list", F.when(F.col("chunks") > 1, F.col("list"))).drop("chunks", "block", "with")
    # Short lists are met some dozens at a time.
    bundle = F.pmod(F.xxhash64("list"), F.lit(2 * TURNS * half_directions(n) ** 2 // 32 + 1))
    met = lists.withColumn("bundle", bundle).groupBy("dim", "bundle", "own_list", "chunk").applyInArrow(_match(cosine, _name_type(n), kind), "id long, links long, least long")
    met = scratch.save(met.groupBy("id", "least").agg(F.sum("links").alias("links")))
    links = met.groupBy("id").agg(F.sum("links").alias("links"))
    parts = connected_components(met.select(F.col("id").alias("a"), F.col("least").alias("b")), scratch)
    summary = reps.join(links, "id", "left").join(parts, F.col("id") == F.col("node"), "left")
    summary = scratch.save(summary.select("vector", "copies", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "id").alias("component_id")))
    # Rows of a vector that many share are dealt by id; its summary goes to each part.
    parts = F.floor((F.col("copies") - 1) / QUERIES).cast("int")
    dealt = rows.join(summary.filter(F.col("copies") > QUERIES).select(F.col("vector").alias("__hot"), parts.alias("__parts")), F.col("vector") == F.col("__hot"), "left").drop("__hot")
    rows = dealt.withColumn("__part", F.when(F.col("__parts") > 0, F.pmod(F.xxhash64("vec_id"), F.col("__parts") + 1).cast("int")).otherwise(0)).drop("__parts")
    summary = summary.withColumn("__part", F.explode(F.sequence(F.lit(0), parts))).drop("copies")
    out = rows.join(summary, ["vector", "__part"], "left")
    part = F.coalesce("component_id", F.col("vec_id").cast("long"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), part.alias("component_id"), (F.col("vec_id") == part).alias("kept"))
