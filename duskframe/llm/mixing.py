"""Mixing sources to target weights by pivotal dependent rounding.

Every document starts with a fractional number of copies, the same for all documents of a source. Its whole
part is settled at once. Fractions meet in pairs: words move from one to the other, in a random direction
that keeps both expectations, until one fraction is 0 or 1. The other goes on. Each move keeps the words of
the pair, so a source ends within one document of its target.

Pairs meet in a tree: hashed buckets of about FAN documents each fold to one open document; FAN neighbouring
buckets then fold again, until one open document of each source is left, which a last draw settles. A source
of n documents takes log_FAN(n) rounds, each over 1/FAN of the rows before, however large the source is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .columns import uniform, word_count
from .scratch import Scratch

FAN = 64


def source_targets(sizes: DataFrame, source: str = "source", size: str = "size", weight_cycle: tuple[int, ...] = (1, 2, 3), most: float = 3.0) -> DataFrame:
    """One row for each source: source, source_size, n_docs, target.

    Sources in code point order, null last, take the weights of `weight_cycle` in turn and share the total
    size by weight. A target stops at `most` times its source's size; what that leaves over is shared by
    weight among the others until none is above. Works on one row for each source.
    """
    per = sizes.groupBy(source).agg(F.sum(size).alias("source_size"), F.count("*").alias("n_docs"))
    place = F.row_number().over(Window.orderBy(F.col(source).asc_nulls_last())) - 1
    cycle = F.array(*[F.lit(float(w)) for w in weight_cycle])
    per = per.withColumn("__w", F.element_at(cycle, (F.pmod(place, F.lit(len(weight_cycle))) + 1).cast("int")))
    per = per.withColumn("__cap", F.col("source_size") * F.lit(float(most)))
    # Sources fill up in the order of cap / weight; the common level is the first that fits all that are left.
    fill = Window.orderBy(F.col("__cap") / F.col("__w"), F.col(source).asc_nulls_last())
    before, after, whole = fill.rowsBetween(Window.unboundedPreceding, -1), fill.rowsBetween(0, Window.unboundedFollowing), fill.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(whole) - F.coalesce(F.sum("__cap").over(before), F.lit(0.0))) / F.sum("__w").over(after)
    per = per.withColumn("__level", level).withColumn("__rank", F.row_number().over(fill))
    fits = F.when(F.col("__cap") / F.col("__w") >= F.col("__level"), F.col("__rank"))
    per = per.withColumn("__common", F.min_by("__level", fits).over(whole))
    return per.select(source, "source_size", "n_docs", F.least(F.col("__cap"), F.coalesce(F.col("__common") * F.col("__w"), F.col("__cap"))).alias("target"))


def _meet(a: Column, b: Column, u: Column) -> Column:
    """Two open documents (row, size, part) meet: struct(settled, open)."""
    a_room, a_has = a["size"] * (1 - a["part"]), a["size"] * a["part"]
    b_room, b_has = b["size"] * (1 - b["part"]), b["size"] * b["part"]
    up, down = F.least(a_room, b_has), F.least(a_has, b_room)  # words that can go to a, and to b
    to_a = u * (up + down) <= down
    a_up = F.when(a_room <= b_has, F.lit(1.0)).otherwise(a["part"] + up / a["size"])
    b_down = F.when(b_has <= a_room, F.lit(0.0)).otherwise(b["part"] - up / b["size"])
    a_down = F.when(a_has <= b_room, F.lit(0.0)).otherwise(a["part"] - down / a["size"])
    b_up = F.when(b_room <= a_has, F.lit(1.0)).otherwise(b["part"] + down / b["size"])
    a_new, b_new = F.when(to_a, a_up).otherwise(a_down), F.when(to_a, b_down).otherwise(b_up)
    unit = lambda x, part: F.struct(x["row"].alias("row"), x["size"].alias("size"), part.alias("part"))
    whole = (a_new <= 0.0) | (a_new >= 1.0)
    return F.when(whole, F.struct(unit(a, a_new).alias("settled"), unit(b, b_new).alias("open"))).otherwise(F.struct(unit(b, b_new).alias("settled"), unit(a, a_new).alias("open")))


def _fold(units: Column, seed: Column) -> Column:
    """Fold an ordered array of open documents: struct(settled array, open)."""
    first = F.element_at(units, 1)
    start = F.struct(F.slice(units, 1, 0).alias("settled"), first.alias("open"))

    def step(acc: Column, x: Column) -> Column:
        met = F.transform(F.array(_meet(acc["open"], x, uniform(seed, acc["open"]["row"]["__draw"], x["row"]["__draw"]))), lambda m: F.struct(F.array_append(acc["settled"], m["settled"]).alias("settled"), m["open"].alias("open")))
        return F.element_at(met, 1)

    return F.aggregate(F.slice(units, 2, F.greatest(F.size(units) - 1, F.lit(1))), start, step)


#: Repeats of a row that are numbered at once.
REPEATS = 4096


def _number_repeats(rows: DataFrame) -> DataFrame:
    """Add `__rep`: 0, 1, ... for rows that are equal in every column, so that their draws differ.

    Equal rows are counted and dealt out again, so no task holds all repeats of a row at once.
    """
    counted = rows.groupBy(*rows.columns).agg(F.count("*").alias("__n"))
    parts = counted.withColumn("__part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("__n") - 1) / REPEATS).cast("long"))))
    first = F.col("__part") * REPEATS
    return parts.select(*rows.columns, F.explode(F.sequence(first, F.least(first + REPEATS, F.col("__n")) - 1)).alias("__rep"))


def mix_sources(df: DataFrame, doc_id: str = "doc_id", source: str = "source", size: Column | None = None, weight_cycle: tuple[int, ...] = (1, 2, 3), most: int = 3, seed: int = 17, keep: tuple[str, ...] = ()) -> DataFrame:
    """How often the mix takes each row of `df`: doc_id, source, size, source_size, target, copies, taken.

    `size` is words of `text` unless given. No row is taken more than `most` times. Rows of size 0 (null or
    blank text) are taken 0 times. Draws come from hashes of the ids, so reruns agree; rows that repeat an
    id are rounded one by one. A null source is a source, the last in order. An empty table gives no rows.
    `keep` names further columns to carry along, of types that can be grouped by.
    """
    scratch = Scratch(df.sparkSession, "mixing")
    size = word_count(F.col("text")) if size is None else size
    sizes = df.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), size.cast("long").alias("size"), *keep)
    sizes = scratch.save(_number_repeats(sizes))
    targets = scratch.save(source_targets(sizes, weight_cycle=weight_cycle, most=float(most)))
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most)))).otherwise(F.lit(0.0))
    rows = sizes.alias("d").join(targets.alias("t"), F.col("d.source").eqNullSafe(F.col("t.source")))
    rows = rows.select("d.*", "t.source_size", "t.target", "t.n_docs", rate.alias("__rate"))
    rows = rows.withColumn("__whole", F.floor(F.col("__rate") + F.lit(1e-12)).cast("int")).withColumn("__part", F.greatest(F.col("__rate") - F.col("__whole"), F.lit(0.0)))
    buckets = F.ceil(F.col("n_docs") / F.lit(FAN)).cast("long")
    rows = rows.withColumn("__draw", F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("size"), F.col("__rep"))).withColumn("__bucket", F.pmod(F.col("__draw"), buckets))
    open_rows = (F.col("__part") > 1e-12) & (F.col("size") > 0)
    columns = ["doc_id", "source", "size", "source_size", "target", *keep]
    done = [rows.filter(~open_rows).select(*columns, F.col("__whole").alias("copies"))]
    unit = F.struct(F.struct(*columns, "__whole", "__draw").alias("row"), F.col("size").cast("double").alias("size"), F.col("__part").alias("part"))
    units = rows.filter(open_rows).select("source", "__bucket", unit.alias("unit"))
    most_docs = targets.agg(F.max("n_docs")).first()[0] or 0
    buckets_left, level = -(-most_docs // FAN), 0
    settled = lambda x: [*[x["row"][c].alias(c) for c in columns], (x["row"]["__whole"] + x["part"].cast("int")).alias("copies")]
    while most_docs:
        met = units.groupBy("source", "__bucket").agg(F.array_sort(F.collect_list(F.struct((-F.col("unit")["size"]).alias("long_first"), F.col("unit")["row"]["__draw"].alias("draw"), F.col("unit").alias("unit")))).alias("at"))
        met = met.select("source", "__bucket", F.transform("at", lambda x: x["unit"]).alias("units"))
        met = scratch.save(met.select("source", "__bucket", _fold(F.col("units"), F.lit(seed * 1000 + level)).alias("met")))
        done.append(met.select(F.explode("met.settled").alias("x")).select(*settled(F.col("x"))))
        units = met.select("source", F.floor(F.col("__bucket") / F.lit(FAN)).cast("long").alias("__bucket"), F.col("met.open").alias("unit"))
        if buckets_left <= 1:
            break
        buckets_left, level = -(-buckets_left // FAN), level + 1
    last = F.col("unit")["part"]
    part = F.when(last >= 1.0, F.lit(1)).when(last <= 0.0, F.lit(0)).otherwise((uniform(F.lit(seed + 1), F.col("unit")["row"]["__draw"]) <= last).cast("int"))
    row = F.col("unit")["row"]
    if most_docs:
        done.append(units.select(*[row[c].alias(c) for c in columns], (row["__whole"] + part).alias("copies")))
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out.withColumn("taken", F.col("size") * F.col("copies").cast("long"))


def apply_mix(df: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", **options) -> DataFrame:
    """The mix itself: the rows of `df`, each as often as it is taken; columns as in `df`.

    Only ids, sources and sizes go through the rounding; the texts meet their numbers of copies in one join
    at the end. Rows that share an id, or have none, are told apart by source and size. Rows that share these
    too are numbered, in blocks of about REPEATS by the hashes of their texts and within a block by another hash and the
    text, so a rerun numbers them alike: the first so many are taken `most` times, the next once less, and so on. Null and blank texts are not taken; an empty table gives no rows.
    """
    mixed = mix_sources(df.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), F.col(text).alias("text")), **options)
    most = options.get("most", 3)
    # Nulls are equal in structs; the sizes are never null, so both sides have one type.
    key = lambda d, n, s: F.struct(d.alias("doc_id"), F.coalesce(n, F.lit(0).cast("long")).alias("size"), s.alias("source"))
    keyed = mixed.groupBy(key(F.col("doc_id"), F.col("size"), F.col("source")).alias("__key"))
    # How many rows are taken c times or more, for c = 1, 2, ...
    shares = keyed.agg(F.count("*").alias("__rows"), *[F.count_if(F.col("copies") >= c).alias(f"__at_least_{c}") for c in range(1, most + 1)]).filter("__at_least_1 > 0")
    scratch = Scratch(df.sparkSession, "mix")
    shares = scratch.save(shares.withColumn("__blocks", F.ceil(F.col("__rows") / REPEATS).cast("int")))
    # Keys of several blocks are few: their blocks are counted, and each begins where those before it end. Both tables
    # are written, so that their sizes are known before any text is dealt out for them.
    wide = scratch.save(shares.filter("__blocks > 1").select("__key", "__blocks"))
    block = F.pmod(F.xxhash64(F.col(text)), F.col("__blocks")).cast("int")
    rows = df.withColumn("__key", key(F.col(doc_id), word_count(F.col(text)), F.col(source)))
    counted = rows.select("__key", text).join(wide, "__key").groupBy("__key", block.alias("__block")).agg(F.count("*").alias("__n"))
    begins = F.coalesce(F.sum("__n").over(Window.partitionBy("__key").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    begins = scratch.save(counted.select(F.col("__key").alias("__key_of"), F.col("__block").alias("__block_of"), begins.alias("__begin")))
    rows = rows.join(shares, "__key").withColumn("__block", block)
    rows = rows.withColumn("__place", F.row_number().over(Window.partitionBy("__key", "__block").orderBy(F.xxhash64(F.lit("place"), text), text)))
    rows = rows.join(begins, (F.col("__key") == F.col("__key_of")) & (F.col("__block") == F.col("__block_of")), "left")
    place = F.col("__place") + F.coalesce("__begin", F.lit(0))
    copies = sum((F.when(place <= F.col(f"__at_least_{c}"), 1).otherwise(0) for c in range(2, most + 1)), F.when(place <= F.col("__at_least_1"), 1).otherwise(0))
    return rows.withColumn("__n", copies).filter("__n > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__n")))).select(*[F.col(c) for c in df.columns])
