"""Sharding by balanced label propagation.

Documents with equal texts are linked. Each starts in a shard drawn from its id and text, and the counts are made equal
to within one; then rounds of joins move documents towards the shards of their group. Groups that matter for a shard's room get
as many shards as their size needs, planned for all of them together; a smaller one gathers where most of it is. A move
needs room: shards take in as many as they give away, within quotas for every pair of shards, so sizes stay what they were.

A group is never listed: what travels is its number of documents by shard, and each shard's share of a quota.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newstide.operators.skew import sliced_join, stored

SLICES = 64  # hash slices that a shard is numbered in, at least
SLICE_ROWS = 200_000  # wanted rows of a slice
TURN = ["turn", "key"]  # order of documents: by a hash of what they are; rows that agree in it by their place in the input


def _numbered(rows: DataFrame, group: str, order: list[Column | str], out: str, of: Column | None = None) -> DataFrame:
    """Number the rows of each group from 0, gapless, without bringing a group into one task.

    Groups are cut into slices by a hash; slices are numbered apart and start where the slices before them end. The
    number of slices follows from the number of rows; ``of`` says what to hash.
    """
    slices = max(SLICES, -(-rows.count() // SLICE_ROWS))
    cut = rows.withColumn("_slice", F.pmod(F.xxhash64(of if of is not None else order[0]), F.lit(slices)).cast("int"))
    sizes = cut.groupBy(group, "_slice").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.withColumn("_before", F.sum("_n").over(Window.partitionBy(group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)))
    inside = F.row_number().over(Window.partitionBy(group, "_slice").orderBy(*order)) - 1
    at = cut.withColumn("_in", inside).join(before.drop("_n"), [group, "_slice"])
    return at.withColumn(out, (F.col("_in") + F.coalesce("_before", F.lit(0))).cast("long")).drop("_slice", "_in", "_before")


def _quotas(wishes: DataFrame) -> DataFrame:
    """For each pair of shards how many documents may move: what wishes to go the other way."""
    back = wishes.select(F.col("to").alias("shard"), F.col("shard").alias("to"), F.col("wish").alias("back"))
    return wishes.join(back, ["shard", "to"]).select("shard", "to", F.least("wish", "back").alias("quota"))


PART = 4  # groups of more than this part of a shard are planned for; there are fewer than PART for each shard


def _plan(held: list[tuple[str, int, int]], counts: dict[int, int]) -> tuple[dict[tuple[str, int], int], set[int]]:
    """How many documents of each group (group, shard, number held) each shard shall have, and the shards with room left.

    Largest groups first; one that no shard has room for fills the emptiest, and the rest of it goes where it fits, to
    the shard that holds most of it.
    """
    have: dict[str, dict[int, int]] = {}
    for group, shard, n in held:
        have.setdefault(group, {})[shard] = n
    left, takes = dict(counts), {}
    for group, ns in sorted(have.items(), key=lambda x: (-sum(x[1].values()), x[0])):
        need = sum(ns.values())
        while need:
            fits = [s for s in left if left[s] >= need]
            best = max(fits, key=lambda s: (ns.get(s, 0), -left[s], s)) if fits else max(left, key=lambda s: (left[s], ns.get(s, 0), s))
            takes[group, best] = take = min(need, left[best])
            left[best] -= take
            need -= take
    return takes, {s for s in left if left[s] > 0}


def _wishes(rows: DataFrame, takes: DataFrame, shards: int, room: set[int], shut: set[int]) -> DataFrame:
    """The linked documents that wish to move, with the shard they wish for (``to``).

    Of a planned group those beyond its planned number in a shard move to where it lacks some. Of others a shard with
    room in the plan is wished for, of these the one that holds most, of equally full ones one that is not shut (had no
    room for all wishes); what is not in a fullest shard that is shut gathers in the fullest of the others. A group
    without any document in a shard with room makes way for the planned ones.
    """
    linked = rows.where("size_of_group > 1")
    held = linked.groupBy("group", "shard").agg(F.count(F.lit(1)).alias("n"))
    planned = F.broadcast(takes.select("group").distinct())
    # the surplus of a shard and what others lack take numbers in a row
    both = held.join(planned, "group", "left_semi").join(takes, ["group", "shard"], "full").na.fill(0, ["n", "take"])
    up = Window.partitionBy("group").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    both = both.withColumn("_over", F.greatest(F.col("n") - F.col("take"), F.lit(0))).withColumn("_lack", F.greatest(F.col("take") - F.col("n"), F.lit(0)))
    both = stored(both.withColumn("_from", F.coalesce(F.sum("_over").over(up), F.lit(0))).withColumn("_lo", F.coalesce(F.sum("_lack").over(up), F.lit(0))), "plan")
    given = linked.join(F.broadcast(both.where("_over > 0").select("group", "shard", "take", "_from")), ["group", "shard"])
    given = _numbered(given.withColumn("_cell", F.xxhash64("group", "shard")), "_cell", TURN, "_in_cell").where("_in_cell >= take")
    lacking = F.broadcast(both.where("_lack > 0").select(F.col("group").alias("_g"), F.col("shard").alias("to"), "_lo", (F.col("_lo") + F.col("_lack")).alias("_hi")))
    seat = F.col("_in_cell") - F.col("take") + F.col("_from")
    big = given.join(lacking, (F.col("group") == F.col("_g")) & (seat >= F.col("_lo")) & (seat < F.col("_hi"))).select(*rows.columns, "to")
    isin = lambda some: F.col("shard").isin(sorted(some)) if some else F.lit(False)
    place = F.struct(F.col("n"), (~isin(shut)).alias("open"), F.xxhash64("group", "shard").alias("h"), "shard")
    best = held.join(planned, "group", "left_anti").groupBy("group").agg(F.max(F.when(isin(room), place)).alias("b"), F.max(F.when(isin(room - shut), place)).alias("o"))
    other = F.get(F.array(*map(F.lit, sorted(room))), F.pmod(F.xxhash64("group"), F.lit(len(room))).cast("int")) if room else F.lit(None).cast("int")
    best = best.select("group", F.coalesce("b.shard", F.lit(-1)).alias("_home"), F.coalesce("o.shard", "b.shard", other).alias("to"))
    return big.unionByName(linked.join(planned, "group", "left_anti").join(best, "group").where("shard <> to and shard <> _home").select(*rows.columns, "to"))


def propagate(rows: DataFrame, shards: int, gain: float, rounds: int) -> DataFrame:
    """``rows`` (key, turn, group, size_of_group, shard) after moves; groups of one document have no links and may be swapped in.

    Lonely documents stand in for room: those of a shard may move anywhere, and follow a group's members the other way, so
    that every swap keeps both sizes. Rounds end when nobody wishes to move or when a round moves at most the share
    ``gain`` of the linked documents, and after ``rounds`` of them.
    """
    spark = rows.sparkSession
    counts = {r["shard"]: r["n"] for r in rows.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each shard
    many = (F.col("size_of_group") > 1) & (F.col("size_of_group") * PART * shards > sum(counts.values()))
    large = rows.where(many)
    takes, open_shards = _plan([(r["group"], r["shard"], r["n"]) for r in large.groupBy("group", "shard").agg(F.count(F.lit(1)).alias("n")).collect()], counts)
    listed = F.from_json(F.lit(json.dumps([{"group": g, "shard": s, "take": n} for (g, s), n in takes.items()])), "array<struct<`group`:string,shard:int,take:bigint>>")
    takes = spark.range(1).select(F.inline(listed))
    linked = rows.where("size_of_group > 1").count()
    shut: set[int] = set()
    moves = linked
    for _ in range(rounds):
        if moves <= gain * linked:
            break
        wanting = _wishes(rows, takes, shards, open_shards, shut)
        wanting = stored(_numbered(stored(wanting.withColumn("_pair", F.col("shard") * shards + F.col("to")), "wishing"), "_pair", [F.col("group"), *TURN], "_place", F.when(many, F.col("turn")).otherwise(F.xxhash64("group"))), "wanting")
        wishes = stored(wanting.groupBy("shard", "to").agg(F.count(F.lit(1)).alias("wish")), "wishes")  # shards x shards rows
        direct = _quotas(wishes)
        open_ = wishes.join(direct, ["shard", "to"], "left").select("shard", "to", "wish", F.coalesce("quota", F.lit(0)).alias("direct"), (F.col("wish") - F.coalesce("quota", F.lit(0))).alias("rest"))
        lonely = rows.where("size_of_group = 1")
        spare = lonely.groupBy(F.col("shard").alias("to")).agg(F.count(F.lit(1)).alias("spare"))
        by_to = Window.partitionBy("to").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
        swaps = open_.join(spare, "to", "left").withColumn("_before", F.coalesce(F.sum("rest").over(by_to), F.lit(0)))
        room = F.greatest(F.coalesce("spare", F.lit(0)) - F.col("_before"), F.lit(0))
        swaps = stored(swaps.withColumn("swap", F.least("rest", room)), "swaps")
        moved = wanting.join(F.broadcast(swaps.select("shard", "to", (F.col("direct") + F.col("swap")).alias("quota"))), ["shard", "to"]).where("_place < quota").select("key", F.col("to").alias("moved"))
        # the lonely documents of a shard that go to where its new members came from
        places = _numbered(lonely.select("key", "turn", "shard"), "shard", TURN, "_place")
        ranges = F.broadcast(swaps.where("swap > 0").select(F.col("to").alias("shard"), F.col("_before").alias("_lo"), (F.col("_before") + F.col("swap")).alias("_hi"), F.col("shard").alias("moved")))
        out = places.join(ranges, "shard").where("_place >= _lo and _place < _hi").select("key", "moved")
        ends = swaps.groupBy("to").agg(F.sum(F.col("direct") + F.col("swap")).alias("moves"), F.sum(F.col("rest") - F.col("swap")).alias("unmet")).collect()  # a row for each shard
        moves, shut = sum(r["moves"] for r in ends), {r["to"] for r in ends if r["unmet"]}
        if not moves:
            return rows
        rows = stored(rows.join(moved.unionByName(out), "key", "left").withColumn("shard", F.coalesce("moved", "shard")).drop("moved"), "round")
    return rows


def _level(rows: DataFrame, shards: int) -> DataFrame:
    """Move the documents over a shard's count to the shards below theirs; counts differ by one at most then.

    Lonely documents go first, and of groups those with the fewest documents in the shard.
    """
    counts = rows.groupBy("shard").agg(F.count(F.lit(1)).alias("n"))
    every = rows.sparkSession.range(shards).select(F.col("id").cast("int").alias("shard"))
    total = Window.partitionBy(F.lit(0))  # a row for each shard
    full = every.join(counts, "shard", "left").withColumn("n", F.coalesce("n", F.lit(0))).withColumn("all", F.sum("n").over(total))
    fair = F.floor(F.col("all") / shards)
    by_size = Window.partitionBy(F.lit(0)).orderBy(F.desc("n"), "shard")
    full = full.withColumn("share", (fair + (F.row_number().over(by_size) <= F.col("all") % shards).cast("long")))
    up = Window.partitionBy(F.lit(0)).orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    full = stored(
        full.withColumn("over", F.greatest(F.col("n") - F.col("share"), F.lit(0))).withColumn("under", F.greatest(F.col("share") - F.col("n"), F.lit(0)))
        .withColumn("over_before", F.coalesce(F.sum("over").over(up), F.lit(0))).withColumn("under_before", F.coalesce(F.sum("under").over(up), F.lit(0))),
        "level",
    )
    if full.where("over > 0").isEmpty():
        return rows
    there = rows.groupBy("group", "shard").agg(F.count(F.lit(1)).alias("_here"))
    ranked = rows.join(F.broadcast(full.where("over > 0").select("shard")), "shard").join(there, ["group", "shard"])
    # of every shard the documents whose group is smallest there: a bucket of sizes is taken whole, the last one in part
    ranked = ranked.withColumn("_bucket", F.col("shard").cast("long") * 64 + F.least(F.floor(F.log2("_here")), F.lit(63)).cast("long"))
    ranked = _numbered(ranked.select("key", "turn", "shard", "_bucket"), "_bucket", TURN, "_in_bucket")
    sizes = ranked.groupBy("shard", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.withColumn("_b", F.coalesce(F.sum("_n").over(Window.partitionBy("shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    leaving = ranked.join(F.broadcast(before.select("_bucket", "_b")), "_bucket").withColumn("_place", F.col("_b") + F.col("_in_bucket"))
    leaving = leaving.join(F.broadcast(full.select("shard", "over", "over_before")), "shard").where("_place < over").select("key", (F.col("over_before") + F.col("_place")).alias("_seat"))
    seats = F.broadcast(full.where("under > 0").select(F.col("shard").alias("moved"), F.col("under_before").alias("_lo"), (F.col("under_before") + F.col("under")).alias("_hi")))
    moved = leaving.join(seats, (F.col("_seat") >= F.col("_lo")) & (F.col("_seat") < F.col("_hi"))).select("key", "moved")
    return rows.join(moved, "key", "left").withColumn("shard", F.coalesce("moved", "shard")).drop("moved")


def assign(docs: DataFrame, shards: int = 24, gain: float = 0.001, rounds: int = 50, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``id``, size (UTF-8 bytes of the text and 8), text_crc32, shard (from 0) and slot (from 0 in its shard, gapless).

    The law is ``rows``: the counts of any two shards differ by one at most. Documents with equal texts are held
    together as far as that leaves room: a group larger than a shard spans as few as hold it. Rounds of moves go on until
    one moves at most the share ``gain`` of the linked documents, ``rounds`` at most. A null text has no bytes and is
    a text of its own kind, equal to other nulls. Null and repeated ids are placed like others, row by row. Other
    columns are dropped. Places follow from ids and texts alone, not from the order or the files that rows come in; which
    of several rows that agree in id and text gets which place is not defined.
    """
    raw = docs.select(
        F.col(id).alias("id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"),
        F.when(F.col(text).isNotNull(), F.md5(F.col(text).cast("binary"))).alias("digest"),
    )
    rows = stored(raw.withColumn("key", F.monotonically_increasing_id()), "sharding")
    # equal rows are told apart by a number, so that they don't all start in one shard
    own = [F.col("id").isNull(), F.col("id"), F.coalesce("digest", F.lit(""))]
    twins = rows.withColumn("twin", F.xxhash64(*own))
    same = stored(twins.groupBy("twin").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "same")
    again = stored(sliced_join(twins.select("key", "twin"), same.select("twin"), ["twin"], same, "key"), "again")
    numbers = _numbered(again, "twin", ["key"], "number").select("key", "number")
    turn = F.xxhash64(*own, F.coalesce("number", F.lit(0).cast("long")))
    marked = rows.join(numbers, "key", "left").select("key", turn.alias("turn"), F.coalesce("digest", F.lit("")).alias("group"))
    groups = stored(marked.groupBy("group").agg(F.count(F.lit(1)).alias("n")), "groups")
    known = sliced_join(marked, groups.select("group", F.col("n").alias("size_of_group")), ["group"], groups, "key")
    start = stored(known.select("key", "turn", "group", "size_of_group", F.pmod("turn", F.lit(shards)).cast("int").alias("shard")), "start")
    placed = propagate(stored(_level(start, shards), "levelled"), shards, gain, rounds)
    named = rows.drop("digest").join(placed.select("key", "turn", "shard"), "key")
    out = _numbered(named, "shard", TURN, "slot")
    return out.select(F.col("id").alias(id), "size", "text_crc32", "shard", "slot")


def cut_links(placed: DataFrame) -> DataFrame:
    """Of the links between equal texts how many there are and how many are cut; a group counts the links to its fullest shard."""
    held = placed.groupBy("text_crc32", "size", "shard").agg(F.count(F.lit(1)).alias("n"))
    return held.groupBy("text_crc32", "size").agg(F.sum("n").alias("n"), F.max("n").alias("most")).agg(F.sum(F.col("n") - 1).alias("links"), F.sum(F.col("n") - F.col("most")).alias("cut"))
