"""Near-duplicate groups: SuperMinHash signatures, banding, verification on full sets, union of links.

No group of similar texts is ever listed as pairs. Equal sets are folded to one node first. In each bucket of a band
the nodes are compared with one of them; nodes joined by verified links share a component. What is left after ``STARS``
such rounds, buckets that still hold different components, is compared inside tasks that hold cells of bounded size:
first signatures, to find families of nodes that may be linked, then the full sets of a family. A task returns no pairs
but the links that join components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newstide.llm.shingles import GOLDEN, fingerprint, mix, shingle_sets
from newstide.llm.worker import release
from newstide.operators.skew import sliced_join, stored

LENGTH = 128  # of a signature
BANDS = 32  # of four components: a pair at 0.75 shares no band with a chance of 5e-6
STARS = 1  # rounds of comparing buckets with one of their nodes
CELL = 512  # nodes of a bucket in a cell; two cells meet in one task, as signatures
FAMILY_CELL = 256  # nodes of a family in a cell; two cells meet in one task, as full sets
SLACK = 0.19  # of a similarity estimated from signatures: five standard deviations at 0.75
TASK_LINKS = 200_000  # links that one task joins by union-find
BROADCAST_ROWS = 1_000_000  # a list of ids up to this length is broadcast, a longer one is joined by shuffle


def signature(items: np.ndarray, length: int = LENGTH, chunk: int = 4096) -> np.ndarray:
    """SuperMinHash of a set of 64-bit numbers: ``length`` values, infinite for an empty set.

    Every item walks through a random permutation of the components; its j-th step offers j plus a uniform number. The
    components' values are the least offers, so a step is not taken once all values are below it: the early stop. The
    items of a chunk take each step together.
    """
    least = np.full(length, np.inf)
    for at in range(0, len(items), chunk):
        some = items[at : at + chunk]
        rows = np.arange(len(some))
        walk = None
        for j in range(length):
            if least.max() < j:
                break
            dice = mix(some + np.uint64((j + 1) * int(GOLDEN) & 0xFFFFFFFFFFFFFFFF))
            offer = (dice & np.uint64(0xFFFFFFFFFF)).astype(np.float64) / float(1 << 40) + j
            to = ((dice >> np.uint64(40)) * np.uint64(length - j) >> np.uint64(24)).astype(np.int64) + j
            if walk is None and j == 0:
                place = to  # nothing has been swapped yet
                first = to
            else:
                if walk is None:
                    walk = np.tile(np.arange(length, dtype=np.int16), (len(some), 1))
                    walk[rows, first] = 0
                    walk[rows, 0] = first
                place = walk[rows, to].astype(np.int64)
                walk[rows, to] = walk[:, j]
            np.minimum.at(least, place, offer)
    return least


def codes(least: np.ndarray) -> bytes:
    """Two bytes for each component; different values share them with a chance of 2 ** -16."""
    return (mix(least.view(np.uint64)) >> np.uint64(48)).astype("<u2").tobytes()


def signed(docs: DataFrame, id: str, text: str, width: int) -> DataFrame:
    """``id``, n_shingles, node (fingerprint of the set, null for an empty one) and sig."""
    kind = docs.schema[id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            release("powers")
            n, node, sig = [], [], []
            for items in shingle_sets(batch.column(1).to_pylist(), width):
                n.append(len(items))
                node.append(fingerprint(items) if len(items) else None)
                sig.append(codes(signature(items)) if len(items) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(node, pa.binary()), pa.array(sig, pa.binary())], names)

    names = [id, "n_shingles", "node", "sig"]
    return docs.select(id, text).mapInArrow(run, f"`{id}` {kind}, n_shingles long, node binary, sig binary")


def _sets(docs: DataFrame, text: str, width: int) -> DataFrame:
    """node and items, the whole set as little-endian 64-bit numbers in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            release("powers")
            sets = [s for s in shingle_sets(batch.column(0).to_pylist(), width) if len(s)]
            yield pa.RecordBatch.from_arrays([pa.array(map(fingerprint, sets), pa.binary()), pa.array([s.astype("<u8").tobytes() for s in sets], pa.binary())], ["node", "items"])

    return docs.select(text).mapInArrow(run, "node binary, items binary")


def small_or_shuffled(ids: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A stored list of ids with a broadcast hint if it has at most ``rows`` of them."""
    return F.broadcast(ids) if ids.limit(rows + 1).count() <= rows else ids


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    shared = int((both[1:] == both[:-1]).sum())
    return 100 * shared >= percent * (len(both) - shared)


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets share at least ``percent`` of their union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, x, y = (batch.column(k).to_pylist() for k in range(4))
            keep = [similar(np.frombuffer(left, "<u8"), np.frombuffer(right, "<u8"), percent) for left, right in zip(x, y, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([v for v, k in zip(c, keep, strict=True) if k], pa.binary()) for c in (a, b)], ["a", "b"])

    left = sets.select(F.col("node").alias("a"), F.col("items").alias("a_items"))
    right = sets.select(F.col("node").alias("b"), F.col("items").alias("b_items"))
    return pairs.select("a", "b").join(right, "b").join(left, "a").select("a", "b", "a_items", "b_items").mapInArrow(run, "a binary, b binary")


def _local(links: DataFrame) -> DataFrame:
    """The same components with fewer and shorter paths: each task joins its links by union-find and returns (node, root)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[bytes, bytes] = {}

        def root(x: bytes) -> bytes:
            top = x
            while parent.setdefault(top, top) != top:
                top = parent[top]
            while parent[x] != top:
                parent[x], x = top, parent[x]
            return top

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                low, high = sorted((root(a), root(b)))
                parent[high] = low
        pairs = [(x, r) for x in parent if (r := root(x)) != x]
        for at in range(0, len(pairs), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs[at : at + 10_000]], pa.binary()) for k in (0, 1)], ["a", "b"])

    tasks = max(1, -(-links.count() // TASK_LINKS))  # few large tasks join more than many small ones
    return links.select("a", "b").coalesce(tasks).mapInArrow(run, "a binary, b binary")


def components(links: DataFrame) -> DataFrame:
    """node and label, the smallest node it is linked with over any number of links; nodes without a link are not in it.

    Links are first joined within the tasks that read them. Then every round takes the least label among a node's
    neighbours, then the label of that label, until nothing changes.
    """
    few = _local(links)
    both = stored(few.union(few.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    degrees = stored(_counts(both, "b"), "degrees")  # a root has the links of all that a task joined to it
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least")).select("node", F.least("node", "least").alias("label")), "labels")
    while True:
        near = sliced_join(both, labels.select(F.col("node").alias("b"), "label"), ["b"], degrees, "a").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        step = stored(labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label")), "step")
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("over"))
        new = stored(sliced_join(step, jump, ["label"], stored(_counts(step, "label"), "held"), "node", "left").select("node", "old", F.least("label", "over").alias("label")), "labels")
        labels = new.select("node", "label")
        if new.where("old <> label").isEmpty():
            return labels


def _counts(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"))


def _split(members: DataFrame, labels: DataFrame, salt: int) -> DataFrame:
    """The members of buckets that still hold different components, with their label and ``p``, one node of the bucket.

    Buckets come as partial aggregates, and their members meet them in slices: a bucket may hold a large part of all rows.
    """
    named = members.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    order = F.xxhash64("node", F.lit(salt))
    picked = F.min(F.struct(order.alias("o"), "node", "label", "n")).alias("p")
    buckets = stored(named.groupBy("bucket").agg(F.count(F.lit(1)).alias("c"), F.min("label").alias("lo"), F.max("label").alias("hi"), picked), "buckets")
    return sliced_join(named, buckets.where("lo <> hi").select("bucket", "p"), ["bucket"], buckets.select("bucket", F.col("c").alias("n")), "node")


def _star(members: DataFrame, percent: int) -> DataFrame:
    """For each node the pair with the one node picked in most of its buckets, if that is of another component."""
    pairs = members.where("label <> p.label").where(_sizes("n", "p.n", percent))
    return (
        pairs.groupBy("node", F.col("p.node").alias("other")).agg(F.count(F.lit(1)).alias("times"))
        .groupBy("node").agg(F.max(F.struct("times", "other")).alias("m"))
        .select(F.least("node", "m.other").alias("a"), F.greatest("node", "m.other").alias("b")).distinct()
    )


def _sizes(a: str, b: str, percent: int):
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def _meetings(rows: DataFrame, key: str, size: int, counts: DataFrame) -> DataFrame:
    """Rows of a group dealt into cells of about ``size``; each row is repeated for every pair of cells it is in, (x, y).

    ``counts`` has the stored number of rows of each group, ``n``.
    """
    cells = counts.select(key, F.ceil(F.col("n") / size).cast("int").alias("cells"))
    placed = sliced_join(rows, cells, [key], counts, "node").withColumn("cell", F.pmod(F.xxhash64("node"), "cells").cast("int"))
    meets = F.transform(F.sequence(F.lit(0), F.col("cells") - 1), lambda k: F.struct(F.least(k, "cell").alias("x"), F.greatest(k, "cell").alias("y")))
    return placed.withColumn("meet", F.explode(meets)).drop("cells")


class _Cell:
    """The nodes of one meeting, with a union-find over their labels."""

    def __init__(self, key: tuple, rows: pa.Table, percent: int):
        self.node = rows["node"].to_pylist()
        self.sig = np.frombuffer(b"".join(rows["sig"].to_pylist()), "<u2").reshape(len(self.node), -1)
        self.cell, self.n = rows["cell"].to_numpy(), rows["n"].to_numpy()
        number: dict[bytes, int] = {}
        self.root = np.array([number.setdefault(v, len(number)) for v in rows["label"].to_pylist()])
        self.two, self.percent = key[1].as_py() != key[2].as_py(), percent

    def near(self, k: int) -> np.ndarray:
        """The nodes after k of other labels whose signature comes near the threshold, nearest first."""
        others = np.flatnonzero(self.root[k + 1 :] != self.root[k]) + k + 1
        others = others[100 * np.minimum(self.n[others], self.n[k]) >= self.percent * np.maximum(self.n[others], self.n[k])]
        if self.two:
            others = others[self.cell[others] != self.cell[k]]
        same = (self.sig[others] == self.sig[k]).sum(1)
        close = same >= (self.percent / 100 - SLACK) * self.sig.shape[1]
        return others[close][np.argsort(-same[close], kind="stable")]

    def join(self, a: int, b: int) -> None:
        self.root[self.root == self.root[b]] = self.root[a]


def _families(members: DataFrame, sigs: DataFrame, percent: int) -> DataFrame:
    """node and family: what pairs of different components with near signatures reach, by buckets and their cells.

    A cell gives one row for each node that has such a neighbour, not one for each pair.
    """

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        cell = _Cell(key, rows, percent)
        a, b = [], []
        for k in range(len(cell.node)):
            for o in cell.near(k):
                if cell.root[o] != cell.root[k]:
                    cell.join(k, int(o))
                    a.append(cell.node[k])
                    b.append(cell.node[o])
        return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})

    met = _meetings(members.join(sigs, "node"), "bucket", CELL, stored(_counts(members, "bucket"), "sizes"))
    stars = stored(met.select("bucket", "node", F.col("node").alias("label"), "n", "sig", "cell", "meet").groupBy("bucket", "meet.x", "meet.y").applyInArrow(run, "a binary, b binary").distinct(), "stars")
    return components(stars).select("node", F.col("label").alias("family"))


def _rest(members: DataFrame, sigs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Verified links between the different components that are left, at most one for each two of them in a cell."""
    families = _families(members, sigs, percent)
    named = stored(members.select("node", "label", "n").distinct().join(families, "node"), "families")
    sizes = stored(named.groupBy("family").agg(F.count(F.lit(1)).alias("n"), F.min("label").alias("lo"), F.max("label").alias("hi")), "sizes")
    counts = sizes.select("family", "n")
    mixed = sizes.where("lo <> hi").select("family")
    full = sliced_join(named, mixed, ["family"], counts, "node").join(sigs, "node").join(sets, "node")

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        cell = _Cell(key, rows, percent)
        items = [np.frombuffer(x, "<u8") for x in rows["items"].to_pylist()]
        a, b = [], []
        for k in range(len(cell.node)):
            for o in cell.near(k):
                if cell.root[o] != cell.root[k] and similar(items[k], items[o], percent):
                    cell.join(k, int(o))
                    a.append(cell.node[k])
                    b.append(cell.node[o])
        return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})

    met = _meetings(full, "family", FAMILY_CELL, counts)
    return met.select("family", "node", "label", "n", "sig", "items", "cell", "meet").groupBy("family", "meet.x", "meet.y").applyInArrow(run, "a binary, b binary")


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", percent: int = 75, width: int = 5) -> DataFrame:
    """``id``, n_shingles, component_id and kept for each row.

    Two rows are linked if 100 times the number of shingles they share is at least ``percent`` times the number in
    either; a component is what links reach. ``component_id`` is its smallest id, and ``kept`` marks rows with that id.
    Shingles are those of ``shingles.shingle_sets``: rows without a word, and null texts, have none and are linked with
    nothing. Rows without an id take no part: their component is null, and they are kept. Rows that repeat an id are
    judged each by its own text and share the component if their texts do. Columns other than ``id`` and ``text`` are dropped.
    """
    marked = stored(signed(docs, id, text, width), "signed")
    nodes = stored(marked.where(F.col(id).isNotNull() & F.col("node").isNotNull()).groupBy("node").agg(F.min(id).alias("first"), F.max("n_shingles").alias("n"), F.max("sig").alias("sig"), F.count(F.lit(1)).alias("rows")), "nodes")
    labels = stored(_labels(docs, nodes, id, text, percent, width), "components")
    groups = nodes.select("node", "first").join(labels, "node")
    lowest = stored(groups.groupBy("label").agg(F.min("first").alias("lowest"), F.count(F.lit(1)).alias("n")), "groups")
    linked = sliced_join(groups, lowest.select("label", "lowest"), ["label"], lowest.select("label", "n"), "node").select("node", "lowest")
    rest = nodes.select("node", F.col("first").alias("alone")).join(linked, "node", "left").select("node", F.coalesce("lowest", "alone").alias("component_id"))
    own = marked.select(id, "n_shingles", "node")
    out = sliced_join(own.where(F.col("node").isNotNull()), stored(rest, "lowest"), ["node"], nodes.select("node", F.col("rows").alias("n")), id, "left")
    out = out.unionByName(own.where(F.col("node").isNull()).withColumn("component_id", F.lit(None).cast(marked.schema[id].dataType)))
    component = F.when(F.col(id).isNotNull(), F.coalesce("component_id", id))
    return out.select(id, "n_shingles", component.alias("component_id"), F.coalesce(F.col(id) == component, F.lit(True)).alias("kept"))


def _labels(docs: DataFrame, nodes: DataFrame, id: str, text: str, percent: int, width: int) -> DataFrame:
    bytes_of_band = 2 * LENGTH // BANDS
    keys = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda k: F.xxhash64(k, F.substring("sig", k * bytes_of_band + 1, F.lit(bytes_of_band))))
    rows = nodes.select("node", "n", F.explode(keys).alias("bucket"))
    shared = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("bucket")
    members = stored(rows.join(shared, "bucket"), "members")
    wanted = members.select("node").distinct()
    ids = stored(nodes.join(wanted, "node").select(F.col("first").alias(id)).distinct(), "wanted")
    sets = stored(_sets(docs.select(id, text).join(small_or_shuffled(ids), id, "left_semi"), text, width).dropDuplicates(["node"]), "sets")
    links, labels = None, nodes.select("node", F.col("node").alias("label")).limit(0)
    for turn in range(STARS + 1):
        left = stored(_split(members, labels, turn), "left")
        if left.isEmpty():
            break
        links_now = verified(_star(left, percent), sets, percent) if turn < STARS else _rest(left, nodes.select("node", "sig"), sets, percent)
        found = stored(links_now, "verified")
        if found.isEmpty():
            continue
        links = found if links is None else links.union(found)
        labels = components(links)
    return labels


def drop_near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", percent: int = 75, width: int = 5) -> DataFrame:
    """The rows of ``docs`` with all their columns that ``near_duplicates`` keeps: one id for each component.

    A repeated id is dropped only if none of its rows is kept.
    """
    judged = stored(near_duplicates(docs, id, text, percent, width).where(F.col(id).isNotNull()).groupBy(id).agg(F.max("kept").alias("kept")), "judged")
    gone = judged.where(~F.col("kept")).select(id)
    return docs.join(small_or_shuffled(gone), id, "left_anti").select(docs.columns)
