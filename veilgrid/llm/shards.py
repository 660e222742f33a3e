"""Balanced label propagation: linked documents move towards their neighbours' shards under quotas. DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilgrid.llm.frames import fresh, hash_128
from veilgrid.llm.linededup import line_key, lines_of
from veilgrid.llm.ranks import running
from veilgrid.session import cut_lineage

#: Share of a shard's quota that a block fills of a link that no shard can hold.
FILL = 0.9
#: Rounds without more members next to each other after which propagation ends.
PATIENCE = 3
#: Members of a link that meet its row in one join key; larger links are salted.
SALT_ROWS = 50_000
#: Hash buckets of links, and of nodes in them, in which movers of one size and target are admitted.
TURNS = 16


def shard_documents(
    docs: DataFrame, links: DataFrame, *, doc_id: str = "doc_id", shards: int = 24, seed: int = 17,
    shard: str = "shard", slot: str = "slot",
) -> DataFrame:
    """``docs`` with ``shard`` (0 to ``shards`` - 1) and ``slot`` (gapless from 0 in each shard).

    ``links``: ``node`` (``hash_128`` of a doc_id) and ``link``, any value; documents that share a link are neighbours.
    Sizes of shards differ by one row at most. The start is a hash of the doc_id, but for the largest links of more than half a quota,
    which start in a shard each; linked documents beside them are dealt by the room these leave. In each round every link proposes
    the shard with room that can hold most of its members, of these the one that holds most; a document takes the
    proposal with most votes among its links if that is more than its own shard offers. Movers are admitted up to the room, link by link,
    the largest first; the rest of a link may follow in a later round. Documents without links have no votes and give way: room is the quota less the
    linked documents. It ends when nothing moves, or after ``PATIENCE`` rounds in which no more members came together (counted for
    each link in the shard that holds most of it); the best state counts. At last rows over a shard's quota, unlinked
    ones first, fill the shards below it.

    Links beyond a whole quota are cut into blocks of ``FILL`` of one, which propagate by themselves; smaller ones are not cut. Rows of one doc_id
    move together until the last step. Null is a doc_id. Existing columns ``shard`` and ``slot`` are replaced.
    """
    docs = docs.drop(*[c for c in docs.columns if c.lower() in (shard.lower(), slot.lower())])
    # a table of ids is placed; texts move once, to their shard and slot
    ids = cut_lineage(docs.select(hash_128(F.col(doc_id)).alias("node")), "nodes")
    total = ids.count()
    quota = [total // shards + (j < total % shards) for j in range(shards)]
    members = cut_lineage(_members(ids, links, max(1, total // shards)), "link-members")
    labels = cut_lineage(_propagated(members, quota, seed), "shards")
    placed = cut_lineage(_placed(ids, labels, quota, seed), "placed")
    node, copy, found, nth = fresh(docs, "node", "copy", "found", "nth")
    placed = placed.toDF(found, shard, slot)
    keyed = docs.withColumn(node, hash_128(F.col(doc_id)))
    repeated = cut_lineage(ids.groupBy("node").count().where("count > 1").select(F.col("node").alias(copy)), "repeated-nodes")
    single = placed.join(repeated, placed[found] == repeated[copy], "left_anti")
    out = keyed.join(single, keyed[node] == single[found]).select(*docs.columns, shard, slot)
    if repeated.isEmpty():
        return out
    # rows of one doc_id take their places in any order
    number = lambda c: F.row_number().over(Window.partitionBy(c).orderBy(F.lit(0)))
    rows = keyed.join(repeated, keyed[node] == repeated[copy], "left_semi").withColumn(nth, number(node))
    places = placed.join(repeated, placed[found] == repeated[copy], "left_semi").withColumn(copy, number(found))
    both = rows.join(places, (rows[node] == places[found]) & (rows[nth] == places[copy]))
    return out.unionByName(both.select(*docs.columns, shard, slot))


def _members(ids: DataFrame, links: DataFrame, most: int) -> DataFrame:
    """``link``, ``size``, ``salt``, ``node``, ``weight`` (rows of the node) for links of two documents or more.

    Links of more than ``most`` rows are cut.
    """
    nodes = ids.groupBy("node").agg(F.count("*").alias("weight"))
    of = cut_lineage(links.where("link is not null").select("node", F.struct(F.xxhash64(F.lit(1), "link").alias("a"), F.xxhash64(F.lit(2), "link").alias("b")).alias("link")).distinct().join(nodes, "node"), "weighed-links")
    # a table of its own: behind an aggregation by link, adaptive execution could not split a large link in the join
    sizes = cut_lineage(of.groupBy("link").agg(F.sum("weight").alias("size"), F.count("*").alias("n")).where("n > 1"), "link-sizes")
    blocks = F.when(F.col("size") > most, F.ceil(F.col("size") / max(1.0, FILL * most))).otherwise(F.lit(1)).cast("long")
    block = F.pmod(F.xxhash64(F.lit(3), "node.a", "node.b"), blocks).cast("int")
    cut = of.join(sizes, "link").select(
        F.struct(F.col("link.a"), F.col("link.b"), block.alias("block")).alias("link"), (F.col("size") / blocks).cast("long").alias("size"),
        "node", "weight")
    salts = F.ceil(F.col("size") / SALT_ROWS)
    return cut.withColumn("salt", F.pmod(F.xxhash64(F.lit(4), "node.a", "node.b"), salts).cast("int"))


def _start(node: str, shards: int, seed: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), f"{node}.a", f"{node}.b"), F.lit(shards)).cast("int")


def _numbers(values: list[int]) -> Column:
    return F.array(*[F.lit(v).cast("long") for v in values])


def _before(values: list[int]) -> list[int]:
    return [sum(values[:j]) for j in range(len(values))]


def _first_labels(members: DataFrame, quota: list[int], seed: int) -> DataFrame:
    """``node``, ``weight``, ``unit`` (a hash of a link of the node) and the ``shard`` in which it starts."""
    shards = len(quota)
    large = members.where(F.col("size") > min(quota) / 2).select("link", "size").distinct().orderBy(F.desc("size"), "link").limit(shards)
    alone = F.broadcast(large.select("link", (F.row_number().over(Window.orderBy(F.desc("size"), "link")) - 1).alias("given")))  # a row per shard
    nodes = members.join(alone, "link", "left").groupBy("node").agg(
        F.first("weight").alias("weight"), F.min("link").alias("unit"), F.min("given").alias("given"))
    nodes = cut_lineage(nodes, "linked")
    loads = dict(nodes.where("given is not null").groupBy("given").agg(F.sum("weight")).collect())  # one row per shard
    room = [max(0, q - loads.get(j, 0)) for j, q in enumerate(quota)]
    if not sum(room):
        room = [1] * shards
    turn = F.pmod(F.xxhash64(F.lit(seed), "node.a", "node.b"), F.lit(sum(room)))
    ends = [x + r for x, r in zip(_before(room), room, strict=True)]
    dealt = F.size(F.filter(_numbers(ends), lambda end: end <= turn))
    return nodes.select("node", "weight", "unit", F.coalesce("given", dealt).alias("shard"), F.lit(False).alias("moved"))


def _propagated(members: DataFrame, quota: list[int], seed: int) -> DataFrame:
    """``node``, ``unit`` (a hash of a link of the node) and ``shard`` of the linked nodes."""
    state = best = cut_lineage(_first_labels(members, quota, seed), "labels")
    most, stale, turn = -1, 0, seed
    while True:
        turn += 1
        loads = dict(state.groupBy("shard").agg(F.sum("weight")).collect())  # one row per shard
        room = [max(0, q - loads.get(j, 0)) for j, q in enumerate(quota)]
        member = members.join(state.select("node", "shard"), "node")
        tally = cut_lineage(_tally(member, room, turn), "votes")
        together = tally.agg(F.sum(F.array_max(F.map_values("votes")))).first()[0] or 0
        stale = 0 if together > most else stale + 1
        if together > most:
            most, best = together, state
        if stale == PATIENCE:
            break
        after = state.join(_moves(member, tally, room, turn), "node", "left")
        state = cut_lineage(after.select(
            "node", "weight", "unit", F.coalesce("target", "shard").alias("shard"), F.col("target").isNotNull().alias("moved")), "labels")
        if state.where("moved").isEmpty():
            break
    return best.select("node", "unit", "shard")


def _tally(member: DataFrame, room: list[int], turn: int) -> DataFrame:
    """``link``, ``size``, its ``votes`` (members by shard) and ``best``: the shard that it proposes."""
    free, reach = _numbers(room), _reach(room)
    votes = member.groupBy("link", "shard").agg(F.sum("weight").alias("n"), F.max("size").alias("size"))
    chance = F.xxhash64(F.lit(turn), "link", "shard")
    best = F.max_by(F.struct("shard", reach(F.col("n")).alias("reach"), "n"), F.when(F.get(free, F.col("shard")) > 0, F.struct(reach(F.col("n")), "n", chance)))
    return votes.groupBy("link").agg(
        best.alias("best"), F.max("size").alias("size"), F.map_from_entries(F.collect_list(F.struct("shard", "n"))).alias("votes"))


def _reach(room: list[int]) -> Callable[[Column], Column]:
    """What ``shard`` can hold of a link of which it has n members."""
    return lambda n: F.least(n + F.get(_numbers(room), F.col("shard")), F.col("size"))


def _moves(member: DataFrame, tally: DataFrame, room: list[int], turn: int) -> DataFrame:
    """``node`` and ``target`` of the nodes that move in this round."""
    # what a shard can hold of the link comes first, then what it holds
    free, reach = _numbers(room), _reach(room)
    salted = tally.select("*", F.explode(F.sequence(F.lit(0), (F.ceil(F.col("size") / SALT_ROWS) - 1).cast("int"))).alias("salt"))
    own = F.element_at("votes", F.col("shard"))
    heard = member.drop("size").join(salted, ["link", "salt"]).select(
        "node", "weight", "shard", F.struct("link", "size").alias("unit"), F.col("best.shard").alias("target"),
        F.struct(F.col("best.reach").alias("reach"), F.col("best.n").alias("n")).alias("there"), F.struct(reach(own).alias("reach"), own.alias("n")).alias("here"))
    sums = lambda c: F.struct(F.sum(f"{c}.reach").alias("reach"), F.sum(f"{c}.n").alias("n"))
    by_target = heard.groupBy("node", "weight", "shard", "target").agg(
        sums("there").alias("there"), sums("here").alias("here"), F.max_by("unit", "there").alias("unit"))
    chosen = by_target.groupBy("node", "weight", "shard").agg(
        F.max_by(F.struct("target", "there", "unit"), F.struct(F.when(F.col("target").isNotNull(), F.col("there")), F.xxhash64(F.lit(turn), "target"))).alias("to"),
        sums("here").alias("here"))
    gain = F.struct(F.col("to.there"), F.xxhash64(F.lit(turn), "to.unit.link", "to.target"))
    stay = F.struct(F.col("here"), F.xxhash64(F.lit(turn), "to.unit.link", "shard"))
    movers = chosen.where((F.col("to.target") != F.col("shard")) & (gain > stay)).select(
        "node", "weight", F.col("to.target").alias("target"), F.length(F.bin("to.unit.size")).alias("magnitude"),
        F.pmod(F.xxhash64(F.lit(turn), "to.unit.link"), F.lit(TURNS)).cast("int").alias("bucket"),
        F.pmod(F.xxhash64(F.lit(turn), "node.a", "node.b"), F.lit(TURNS)).cast("int").alias("part"))
    group = ["target", "magnitude", "bucket", "part"]
    mass = movers.groupBy(*group).agg(F.sum("weight").alias("mass"))  # at most shards * 64 * TURNS ** 2 rows
    fits = mass.where(F.col("mass") <= F.get(free, F.col("target")))
    upto = F.sum("mass").over(Window.partitionBy("target").orderBy(F.desc("magnitude"), "bucket", "part"))
    admitted = fits.withColumn("upto", upto).where(F.col("upto") <= F.get(free, F.col("target")))
    return movers.join(F.broadcast(admitted.select(*group)), group, "left_semi").select("node", "target")


def _placed(ids: DataFrame, labels: DataFrame, quota: list[int], seed: int) -> DataFrame:
    """``node``, ``shard``, ``slot``: a place for each row of ``ids``."""
    at, place = "at", "place"
    rows = ids.join(labels.withColumnRenamed("shard", at), "node", "left").withColumns({
        "alone": F.col("unit").isNull(), at: F.coalesce(at, _start("node", len(quota), seed)),
    })
    ranked = running(rows, [at], ["alone", "unit", "node"], before=place)
    counts = dict(rows.groupBy(at).count().collect())  # one row per shard
    over = [max(0, counts.get(j, 0) - q) for j, q in enumerate(quota)]
    under = [max(0, q - counts.get(j, 0)) for j, q in enumerate(quota)]
    limit = F.get(_numbers(quota), F.col(at))
    # the g-th row over all quotas takes the g-th free place
    g = F.get(_numbers(_before(over)), F.col(at)) + F.col(place) - limit
    target = F.size(F.filter(_numbers(_before(under)), lambda x: x <= g))
    # shards without free places share their start with the next one: the last start that is reached has a place
    target = (target - 1).cast("int")
    taken = F.get(_numbers([counts.get(j, 0) for j in range(len(quota))]), target) + g - F.get(_numbers(_before(under)), target)
    stays = F.col(place) < limit
    return ranked.select(
        "node", F.when(stays, F.col(at)).otherwise(target).alias("shard"), F.when(stays, F.col(place)).otherwise(taken).alias("slot"))


def node_of(doc_id: Column) -> Column:
    return hash_128(doc_id)


def text_link(text: Column) -> Column:
    """A link value that equal texts share; null for null, which is linked with nothing."""
    return F.when(text.isNotNull(), hash_128(text))


def equal_text_links(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Links for ``shard_documents`` between documents of equal texts."""
    return docs.select(node_of(F.col(doc_id)).alias("node"), text_link(F.col(text)).alias("link")).where("link IS NOT NULL")


def shared_line_links(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least_chars: int = 20) -> DataFrame:
    """Links for ``shard_documents`` between documents that share a line of ``least_chars`` characters or more, compared as line deduplication does."""
    lines = docs.select(node_of(F.col(doc_id)).alias("node"), F.explode(lines_of(F.col(text))).alias("line")).select("node", line_key(F.col("line")).alias("key"))
    return lines.where(F.length("key") >= least_chars).select("node", hash_128(F.lit("line"), F.col("key")).alias("link")).distinct()
