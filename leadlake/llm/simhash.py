"""SimHash near-duplicates: exact pairs by vantage-point trees over the fingerprints."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadlake.llm.components import components
from leadlake.llm.work import saved, table

WORDS = 4            # words of a shingle
SEED = 42
DISTANCE = 4         # differing bits of linked fingerprints
SHARD = 1024         # fingerprints of a shard that a tree aims at
LIMIT = 4096         # larger shards get a tree of their own
SAMPLE = 1 << 16     # fingerprints, at most, that the trees of a round are fitted on (at the driver)
CANDIDATES = 24      # vantage points that are tried for a node
LEAST = 24           # sampled fingerprints below which a node isn't split
ROUNDS = 8           # rounds of trees
BLOCK = 256          # fingerprints compared with all others of a shard at once

_ALL = (1 << 64) - 1


def fingerprint(text: bytes | None, k: int = WORDS) -> int:
    """64-bit SimHash: a bit is set if it is set in over half the XXH64 digests of the shingles.

    Words are runs without ASCII white space, A-Z lower-cased; repeated shingles count each time;
    fewer than ``k`` words are one shingle; none give zero."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    whole = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    k = min(k, len(words))
    starts = np.concatenate([[0], ends[:-1] + 1])[:len(words) - k + 1].tolist()
    xxh = xxhash.xxh64_intdigest
    h = np.fromiter([xxh(whole[s:e], SEED) for s, e in zip(starts, ends[k - 1:].tolist(), strict=True)], np.uint64, len(starts))
    count = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 16):
        count += np.unpackbits(h[i:i + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * count > len(h)).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """Rows ``doc_id, fp`` (a signed long), one per row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.fromiter((fingerprint(t.as_py(), words) for t in batch.column("text")), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(run, "doc_id long, fp long")


def thirds(distance: int) -> list[tuple[int, int]]:
    """(bits, radius): of two fingerprints at most ``distance`` bits apart, some third of the bits
    differs in at most ``distance // 3`` of them."""
    cut = [0, 22, 43, 64]
    return [(((1 << b) - 1) ^ ((1 << a) - 1), distance // 3) for a, b in zip(cut, cut[1:])]


class Trees:
    """Vantage-point trees. A node has a vantage point, the bits that count, a threshold and a radius:
    a fingerprint goes to the inner child if its distance from the vantage point, d, is at most threshold +
    radius, and to the outer child if d is over the threshold, so those near the border go to both.

    By the triangle bound the distances of two fingerprints at most ``radius`` apart differ by at most
    ``radius``; so both go to the outer child, or both to the inner one: they meet in a leaf."""

    def __init__(self, first: int):
        self.nodes: list[tuple[int, int, int, int, int, int]] = []
        self.next = first  # number of the next leaf, that is, shard

    def grow(self, sample: np.ndarray, share: float, bits: int, radius: int, rng: np.random.Generator) -> int:
        """The root of a new tree: a node, or ~shard for a leaf. ``share`` is the number of fingerprints for
        which one of the sample stands; leaves are to have ``SHARD`` of them."""
        cut = None
        if len(sample) >= LEAST and len(sample) * share > SHARD:
            part = sample if len(sample) <= 2048 else rng.choice(sample, 2048, replace=False)
            best = 0.9  # of the pairs of the node, those that its children have together
            for vantage in rng.choice(part, min(CANDIDATES, len(part)), replace=False):
                d = np.bitwise_count((part ^ vantage) & np.uint64(bits))
                counts = np.cumsum(np.bincount(d, minlength=66 + radius)) / len(part)
                inner, outer = counts[radius:radius + 65], 1 - counts[:65]
                cost = inner ** 2 + outer ** 2
                at = int(np.argmin(cost))
                if cost[at] < best:
                    best, cut = cost[at], (int(vantage), at)
        if cut is None:
            self.next += 1
            return ~(self.next - 1)
        place = len(self.nodes)
        self.nodes.append((0,) * 6)
        d = np.bitwise_count((sample ^ np.uint64(cut[0])) & np.uint64(bits))
        children = [self.grow(sample[side], share, bits, radius, rng) for side in (d <= cut[1] + radius, d > cut[1])]
        self.nodes[place] = (cut[0], bits, cut[1], radius, *children)
        return place

    def route(self, root: int, fps: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(shard, places in ``fps``) of all the leaves that the fingerprints reach."""
        todo = [(root, np.arange(len(fps)))]
        while todo:
            node, at = todo.pop()
            if not len(at):
                continue
            if node < 0:
                yield ~node, at
                continue
            vantage, bits, threshold, radius, inner, outer = self.nodes[node]
            d = np.bitwise_count((fps[at] ^ np.uint64(vantage)) & np.uint64(bits))
            todo += [(inner, at[d <= threshold + radius]), (outer, at[d > threshold])]


def forest(fps: np.ndarray, other: np.ndarray | None = None, distance: int = DISTANCE) -> np.ndarray:
    """Links (rows of two) that connect the fingerprints as all pairs at most ``distance`` apart do: no
    more of them than fingerprints. With ``other``, only pairs across the two arrays count."""
    own = other is None
    other = fps if own else other
    near = np.zeros(len(fps), bool)
    for i in range(0, len(fps), BLOCK):
        close = np.bitwise_count(fps[i:i + BLOCK, None] ^ other[None, :]) <= distance
        near[i:i + BLOCK] = close.sum(axis=1) > own  # itself is no neighbour
    links = []
    if own:
        rest = fps[near]
        while len(rest):
            front, root, rest = rest[:1], rest[0], rest[1:]
            while len(front) and len(rest):
                hit = (np.bitwise_count(front[:BLOCK, None] ^ rest[None, :]) <= distance).any(axis=0)
                new = rest[hit]
                links.append(np.stack([np.repeat(root, len(new)), new], axis=1))
                front, rest = np.concatenate([front[BLOCK:], new]), rest[~hit]
    else:
        left, right = fps[near], other
        while len(left):
            front, root, left, side = left[:1], left[0], left[1:], 0
            while len(front):
                rest = left if side else right
                hit = np.zeros(len(rest), bool)
                for i in range(0, len(front), BLOCK):
                    hit |= (np.bitwise_count(front[i:i + BLOCK, None] ^ rest[None, :]) <= distance).any(axis=0)
                new = rest[hit]
                links.append(np.stack([np.repeat(root, len(new)), new], axis=1))
                left, right = (rest[~hit], right) if side else (left, rest[~hit])
                front, side = new, 1 - side
    return np.concatenate([x for x in links if len(x)]) if any(map(len, links)) else np.zeros((0, 2), np.uint64)


def _routed(rows: DataFrame, trees: Trees, roots: dict[int, list[int]]) -> DataFrame:
    """Rows ``shard, fp`` of the leaves that the rows (shard, fp) reach from the roots for their shard."""
    shared = rows.sparkSession.sparkContext.broadcast((trees, roots))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees, roots = shared.value
        for batch in batches:
            shard, fps = (batch.column(c).to_numpy() for c in ("shard", "fp"))
            order = np.argsort(shard, kind="stable")
            cuts = np.flatnonzero(np.diff(shard[order])) + 1
            for at in np.split(order, cuts):
                own = fps[at].view(np.uint64)
                for root in roots[int(shard[at[0]])] if len(at) else ():
                    for leaf, i in trees.route(root, own):
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), leaf)), pa.array(own[i].view(np.int64))], names=["shard", "fp"])

    return rows.mapInArrow(run, "shard long, fp long")


def near_links(distinct: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Links ``a, b`` that connect the fingerprints (rows ``fp``, no two equal) as all pairs at most
    ``distance`` bits apart do.

    First every third of the bits has a tree in which radius ``distance // 3`` is enough (see ``thirds``); shards
    that are still larger than ``LIMIT`` get a tree on all bits, round by round. Trees are fitted on a sample
    of at most ``SAMPLE`` fingerprints of the shards in question, all of which are then routed. A shard that no
    vantage point divides is compared in blocks of ``LIMIT`` rows, block by block, in tasks of their own. A task
    sends a spanning forest of its links, never the pairs."""
    pending = saved(distinct.select(F.lit(0).cast("long").alias("shard"), "fp"), "simhash-distinct")
    sizes = {0: pending.count()}
    done, first, rng = [], 1, np.random.default_rng(SEED)
    for turn in range(ROUNDS):
        total = sum(sizes.values())
        if not sizes or (turn == 0 and total <= SHARD):
            break
        # fingerprints with the lowest hashes: the same sample in every run, each shard by its share
        limit = -(1 << 63) + min((1 << 64) - 1, int((1 << 64) * min(1.0, 0.9 * SAMPLE / total)))
        sample = pending.where(F.xxhash64("shard", "fp") <= limit).limit(SAMPLE).toPandas()
        trees, roots = Trees(first), {}
        for shard, n in sorted(sizes.items()):
            fps = np.sort(sample.loc[sample["shard"] == shard, "fp"].to_numpy()).view(np.uint64)
            masks = thirds(distance) if turn == 0 else [(_ALL, distance)]
            roots[shard] = [trees.grow(fps, n / max(1, len(fps)), bits, radius, rng) for bits, radius in masks]
        stuck = [s for s, r in roots.items() if turn and r[0] < 0]  # no vantage point divides these
        if stuck:
            done.append(pending.where(F.col("shard").isin(stuck)))
            pending = pending.where(~F.col("shard").isin(stuck))
            roots = {s: r for s, r in roots.items() if s not in stuck}
        first = trees.next
        if not roots:
            sizes, pending = {}, None
            break
        routed = saved(_routed(pending, trees, roots), f"simhash-shards-{turn}")
        counts = saved(routed.groupBy("shard").count(), "simhash-sizes")  # as many rows as leaves
        large = counts.where(F.col("count") > LIMIT).select("shard")
        sizes = {r["shard"]: r["count"] for r in counts.where(F.col("count") > LIMIT).collect()}
        done.append(routed.join(F.broadcast(large), "shard", "left_anti"))
        pending = routed.where(F.col("shard").isin(list(sizes))) if sizes else None
    if pending is not None and sizes:
        done.append(pending)  # small as a whole, or larger than ``LIMIT`` after the last round
    rows = done[0]
    for d in done[1:]:
        rows = rows.unionByName(d)
    return _compared(rows, distance)


def _compared(rows: DataFrame, distance: int) -> DataFrame:
    """Links of all shards (rows ``shard, fp``). A shard of c blocks has a task for every two of them."""
    counts = saved(rows.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / LIMIT).cast("long").alias("blocks")), "simhash-blocks")
    one = rows.join(counts.where("blocks = 1"), "shard", "left_semi").select("shard", F.lit(0).cast("long").alias("x"), F.lit(0).cast("long").alias("y"), "fp", F.lit(0).cast("long").alias("block"))
    many = rows.join(counts.where("blocks > 1"), "shard").withColumn("block", F.pmod(F.xxhash64(F.lit("block"), "fp"), "blocks"))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    many = many.select("shard", "fp", "block", other.alias("other")).select(
        "shard", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "fp", "block")

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        fps, block = frame["fp"].to_numpy().view(np.uint64), frame["block"].to_numpy()
        low = block == block.min()
        links = forest(fps, None, distance) if low.all() else forest(fps[low], fps[~low], distance)
        return pd.DataFrame({"a": links[:, 0].view(np.int64) if len(links) else np.zeros(0, np.int64),
                             "b": links[:, 1].view(np.int64) if len(links) else np.zeros(0, np.int64)})

    return saved(one.unionByName(many).groupBy("shard", "x", "y").applyInPandas(compare, "a long, b long").distinct(), "simhash-links")


def near_duplicates(docs: DataFrame, words: int = WORDS, distance: int = DISTANCE) -> DataFrame:
    """Rows ``doc_id, fp, component_id``, one per row of ``docs``: documents whose fingerprints differ in at most
    ``distance`` bits are linked; ``component_id`` is the smallest doc_id reachable by links.

    Equal fingerprints are one node, so copies are never paired. Null or empty text, or one of white space
    only: fingerprint zero, linked like any other. Null doc_id: its row links like any other and gets
    the component's smallest id, null if no row of it has one. Repeated ids and rows are each
    returned. No rows give no rows."""
    prints = saved(fingerprints(docs, words), "simhash-prints")
    nodes = saved(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")), "simhash-nodes")
    labels = components(near_links(nodes.select("fp"), distance))
    placed = saved(nodes.join(labels, F.col("fp") == F.col("node"), "left").select("fp", "rep", F.coalesce("label", "fp").alias("label")), "simhash-labels")
    least = saved(placed.groupBy("label").agg(F.min("rep").alias("component_id")), "simhash-components")
    by_print = saved(placed.select("fp", "label").join(least, "label").select("fp", "component_id"), "simhash-placed")
    return prints.join(by_print, "fp").select("doc_id", "fp", "component_id")


def op13_simhash(spark, sf_dir):
    """Contract digest of ``near_duplicates`` over all documents."""
    n = near_duplicates(table(spark, sf_dir, "documents"))
    return n.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
