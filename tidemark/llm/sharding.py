"""Sharding by balanced label propagation.

Documents that share a link (here: equal texts) should share a shard, and shards should be equally large. Rows
without a link to another row are filler. Linked rows start spread evenly (groups larger than a quarter of a
shard on as few shards as can hold them); in each round the rows of a link vote, each row asks for the open
shard that most rows of one of its links have, and shards admit asking rows up to their room, strongest links
first. What passes a bound is decided by a hash of the link, or of the row where the link is large, so no
order over all rows is needed. The rooms are sums over (shard, strength), at most `shards` * 64 rows.

At last the law is made exact: rows in order of (shard, link) keep their shard up to its quota, and what is
over, with the filler, takes the places that are left. The order is a range sort whose key ends with the row's
number, so it splits groups of any size; places are counted from partition sizes.

Law `rows`: shard sizes differ by one row at most. Defined cases: null and empty texts are equal to their own
kind and have size 8 (null) or 8 (empty); repeated ids are rows of their own; an empty table gives no rows;
columns other than id and text are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.base import table, written

SHARDS, ROUNDS = 24, 5


def propagate(members: DataFrame, shards: int, capacity: int, rounds: int = ROUNDS) -> DataFrame:
    """(row, link, label) from (row, link, n): n is the number of rows of the link, two at least; capacity is in rows."""
    spread = F.greatest(F.ceil(F.col("n") / capacity), F.lit(1))
    first = F.when(F.col("n") * 4 > capacity, F.xxhash64("link") + F.pmod(F.xxhash64("row"), spread)).otherwise(F.xxhash64("row"))
    state = written(members.select("row", "link", F.pmod(first, F.lit(shards)).cast("int").alias("label")), "round0")
    for step in range(1, rounds + 1):
        held = {r["label"]: r["n"] for r in state.groupBy("row").agg(F.first("label").alias("label")).groupBy("label").agg(F.count("*").alias("n")).collect()}
        full = [s for s in range(shards) if held.get(s, 0) >= 0.98 * capacity]
        votes = state.groupBy("link", "label").agg(F.count("*").alias("votes"))
        open_best = F.max(F.when(~F.col("label").isin(full), F.struct(F.col("votes").alias("most"), (-F.col("label")).alias("to"))))
        votes = written(votes.withColumn("best", open_best.over(Window.partitionBy("link"))), f"votes{step}")  # a link has a row a shard at most
        asks = state.join(votes, ["link", "label"])  # plain shuffles, so that Spark can split hot links
        stronger = (F.col("best.most") > F.col("votes")) | ((F.col("best.most") == F.col("votes")) & (-F.col("best.to") < F.col("label")))
        asks = asks.where(stronger).groupBy("row").agg(F.max(F.struct(F.col("best.most").alias("most"), F.col("best.to").alias("to"), "link")).alias("ask"), F.first("label").alias("from"))
        small = F.col("ask.most") * 64 < capacity
        draw = F.shiftrightunsigned(F.when(small, F.xxhash64("ask.link", F.lit(step))).otherwise(F.xxhash64("row", F.lit(step))), 11) / float(1 << 53)
        asks = written(asks.select("row", "from", (-F.col("ask.to")).alias("to"), F.floor(F.log2("ask.most")).cast("int").alias("strength"), draw.alias("draw")), f"asks{step}")
        wanted = asks.groupBy("to", "strength").agg(F.count("*").alias("n")).collect()
        if not wanted:
            break
        admitted, room = [], {s: max(0, capacity - held.get(s, 0)) for s in range(shards)}
        for r in sorted(wanted, key=lambda r: (r["to"], -r["strength"])):
            share = min(1.0, room[r["to"]] / r["n"])
            room[r["to"]] -= int(share * r["n"])
            admitted.append((r["to"], r["strength"], share))
        shares = state.sparkSession.createDataFrame(admitted, "to int, strength int, share double")
        moved = asks.join(F.broadcast(shares), ["to", "strength"]).where("draw < share").select("row", "to")
        state = written(state.join(moved, "row", "left").select("row", "link", F.coalesce("to", "label").alias("label")), f"round{step}")
    return state


def ranked(df: DataFrame, *keys: str) -> DataFrame:
    """`df` plus `rank`, its place from 0 in the order of `keys` (unique), without a single task over all rows."""
    n = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    placed = written(df.repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumn("__at", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright("__at", 33)
    sizes = placed.groupBy(part.alias("__part")).agg(F.count("*").alias("n"))
    starts = sizes.select("__part", (F.sum("n").over(Window.orderBy("__part")) - F.col("n")).alias("__start"))  # one row a partition
    out = placed.withColumn("__part", part).join(F.broadcast(starts), "__part")
    return out.withColumn("rank", F.col("__start") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))).drop("__at", "__part", "__start")


def balanced_shards(rows: DataFrame, links: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """(row, shard, slot) of `rows` (row: unique long) under `links` (row, link), by law `rows`.

    A row may have several links; the one of its final shard with most rows orders it.
    """
    spark = rows.sparkSession
    total = rows.count()
    sizes = written(links.groupBy("link").agg(F.count("*").alias("n")).where("n > 1"), "links")
    members = links.join(sizes, "link").select("row", "link", "n")
    state = propagate(members, shards, max(1, total // shards), rounds)
    own = state.groupBy("row").agg(F.first("label").alias("label"), F.min("link").alias("link"))
    every = rows.select("row").join(own, "row", "left").select("row", F.coalesce("label", F.lit(shards)).alias("label"), F.xxhash64("link").alias("group"))
    order = ranked(every, "label", "group", "row")
    held = {r["label"]: r["n"] for r in order.groupBy("label").agg(F.count("*").alias("n")).collect()}
    quota = [total // shards + (s < total % shards) for s in range(shards)]
    table, start, over, room = [], 0, held.get(shards, 0), 0
    for s in range(shards):
        n = held.get(s, 0)
        free = max(0, quota[s] - n)
        table.append((s, start, quota[s], over, room, free, min(n, quota[s])))
        start, over, room = start + n, over + max(0, n - quota[s]), room + free
    table.append((shards, start, 0, 0, 0, 0, 0))
    book = spark.createDataFrame(table, "label int, start long, quota long, over long, room long, free long, kept long")
    order = order.join(F.broadcast(book.select("label", "start", "quota", "over")), "label").withColumn("inside", F.col("rank") - F.col("start"))
    stays = (F.col("label") < shards) & (F.col("inside") < F.col("quota"))
    order = order.select("row", stays.alias("stays"), "label", "inside", (F.col("inside") - F.col("quota") + F.col("over")).alias("filler"))
    keep = order.where("stays").select("row", F.col("label").alias("shard"), F.col("inside").alias("slot"))
    places = F.broadcast(book.where(f"label < {shards}").select(F.col("label").alias("shard"), "room", "free", "kept"))
    fill = order.where("not stays").join(places, (F.col("filler") >= F.col("room")) & (F.col("filler") < F.col("room") + F.col("free")))
    return keep.unionByName(fill.select("row", "shard", (F.col("kept") + F.col("filler") - F.col("room")).alias("slot")))


def shard_documents(docs: DataFrame, shards: int = SHARDS, id: str = "doc_id", text: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """(id, size, text_crc32, shard, slot): equal texts together where the law lets them."""
    base = docs.select(
        F.col(id).alias("id"), (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"), F.coalesce(F.crc32(F.col(text).cast("binary")), F.lit(0)).cast("long").alias("crc"),
        F.struct(F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), F.col(text)).alias("h2")).alias("link"), F.monotonically_increasing_id().alias("row"),
    )
    base = written(base, "rows")
    placed = balanced_shards(base.select("row"), base.select("row", "link"), shards, rounds)
    return base.join(placed, "row").select(F.col("id").alias(id), "size", F.col("crc").alias("text_crc32"), F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard_documents(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
