"""Exact Jaccard self-join of documents on word shingles by token-combination prefixes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadlake.llm.components import components
from leadlake.llm.work import batches_of, saved, table

WORDS = 5              # words of a shingle
LEAST_PERCENT = 67     # see ``shingle_components``
PERCENT = 75           # 100 * intersection >= PERCENT * union
FREQUENT = 12          # classes of texts, of 64 by their hash, in which a shingle must occur to be frequent
CLASS_BITS = 27        # hashed table of the frequent class: a fixed 16 MB
PIECE_BITS = 12        # first bits of a shingle's hash by which occurrences are dealt to tasks
MARKS = 1 << 20        # occurrences that a task sends together
BATCH_BYTES = 8 << 20  # of rows that are sent to a Python worker at once, or one row
SMALL_BUCKET = 32      # nodes of a signature that are compared in pairs; larger buckets go by pivots

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _B
    x = (x ^ (x >> np.uint64(29))) * _A
    return x ^ (x >> np.uint64(32))


def _distinct(values: np.ndarray) -> np.ndarray:
    """Ascending distinct values. ``np.unique`` builds a table of them in memory, many times the size
    of the values and slower than sorting."""
    values = np.sort(values)
    if len(values) < 2:
        return values
    new = np.ones(len(values), bool)
    np.not_equal(values[1:], values[:-1], out=new[1:])
    return values if new.all() else values[new]


def shingles(text: bytes | None, k: int = WORDS) -> np.ndarray:
    """Ascending 64-bit hashes of the distinct shingles of a text.

    Words are runs without ASCII white space, A-Z lower-cased (``bytes.split`` and
    ``bytes.lower`` know ASCII only). Fewer than ``k`` words are one shingle; no words, none."""
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    k = min(k, len(h))
    n = len(h) - k + 1
    out = np.full(n, k, np.uint64)
    for i in range(k):
        out = _mixed(out * _A + h[i:i + n])
    return _distinct(out)


def _allowed(n: int, percent: int) -> int:
    """Elements of a set of ``n`` that may be missing from a set linked with it."""
    return n - -(-n * percent // 100)


def by_class(tokens: np.ndarray, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The tokens of the rare and of the frequent class."""
    slot = tokens >> np.uint64(64 - CLASS_BITS)
    often = (frequent[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
    return tokens[~often], tokens[often]


def signatures(tokens: np.ndarray, frequent: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Keys such that two linked sets share one.

    All sets order their tokens alike: those of the rare class, then those of the frequent class,
    each by hash. A rare token of the prefix is a key by itself. Frequent tokens fall into m
    subclasses and are keys in pairs of one subclass. The prefix is the shortest with

        rare tokens + sum over subclasses of max(0, tokens - 1)  >  elements that may be missing

    because then, if every rare token and all but one token of each subclass are missing from the
    other set, more are missing than may be; so a key is shared. Which of two prefixes ends first
    doesn't matter: tokens in the shorter are in the longer as well.

    m grows with the size (2^g / 8 for 2^g <= n < 2^(g+1)) to keep the pairs about as many as the
    tokens. A set whose partners may be in the next size class gives its pairs for that too."""
    n = len(tokens)
    if n <= 2:  # linked with equal sets only
        return _mixed(tokens.sum(keepdims=True) + np.uint64(n)) if n else tokens
    missing = _allowed(n, percent)
    rare, freq = by_class(tokens, frequent)
    if len(rare) > missing:
        return rare[:missing + 1]
    level = n.bit_length() - 1
    pairs = []
    for g in (level, level + 1):
        if g > level and n * 100 < (1 << g) * percent:
            break
        m = max(1, (1 << g) // 8)
        sub = (_mixed(freq) % np.uint64(m)).astype(np.int64)
        _, first = np.unique(sub, return_index=True)
        gain = np.ones(len(freq), np.int64)
        gain[first] = 0
        end = int(np.searchsorted(len(rare) + np.cumsum(gain), missing + 1)) + 1
        order = np.argsort(sub[:end], kind="stable")
        t, s = freq[:end][order], sub[:end][order]
        for d in range(1, len(t)):
            together = s[d:] == s[:-d]
            if not together.any():
                break
            pairs.append(_mixed(_mixed(t[:-d][together]) * _A + t[d:][together] + np.uint64(g)))
    return np.concatenate([rare, *pairs])


def bitmap(tokens: np.ndarray) -> bytes:
    """One bit for each token by its low bits, at least four times as many bits as tokens."""
    size = max(64, 1 << (4 * len(tokens) - 1).bit_length()) if len(tokens) else 64
    bits = np.zeros(size, bool)
    bits[(tokens & np.uint64(size - 1)).astype(np.int64)] = True
    return np.packbits(bits).tobytes()


def residue(tokens: np.ndarray, frequent: np.ndarray, pivot: int, center: np.ndarray,
            percent: int = PERCENT) -> tuple[int, np.ndarray]:
    """(covered, keys) of a set in the bucket of a pivot with the tokens ``center``.

    ``covered`` counts the tokens that the pivot has too. Two sets of the bucket share at most the
    smaller of their ``covered`` among those; if that is too few for a link they must share others,
    and then one of the first of them in the common order, which are the keys: as many as may be
    missing plus one, or all if the covered tokens alone could be enough for some partner."""
    has = np.isin(tokens, center, assume_unique=True)
    covered, rest = int(has.sum()), np.concatenate(by_class(tokens[~has], frequent))
    needed = max(1, len(tokens) - _allowed(len(tokens), percent) - covered)
    return covered, _mixed(rest[:max(0, len(rest) - needed + 1)] * _A + np.uint64(pivot & 0xFFFFFFFFFFFFFFFF))


def may_link(n_a: int, n_b: int, bits_a: bytes, bits_b: bytes, percent: int = PERCENT) -> bool:
    """False only if the sets can't be linked: a bit of one that the other lacks is an element
    that the other lacks. A longer bitmap is folded to the length of the shorter."""
    a, b = (np.frombuffer(x, np.uint8) for x in (bits_a, bits_b))
    while len(a) != len(b):
        a, b = (a[:len(a) // 2] | a[len(a) // 2:], b) if len(a) > len(b) else (a, b[:len(b) // 2] | b[len(b) // 2:])
    shared = min(n_a - int(np.bitwise_count(a & ~b).sum()), n_b - int(np.bitwise_count(b & ~a).sum()))
    return 100 * shared >= percent * (n_a + n_b - shared)


def linked(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return bool(len(a)) and 100 * shared >= percent * (len(a) + len(b) - shared)


def _saved(df: DataFrame, name: str) -> DataFrame:
    """``saved`` for rows that Python functions make, with small Arrow batches."""
    with batches_of(df.sparkSession, BATCH_BYTES):
        return saved(df, name)


def _texts(docs: DataFrame) -> DataFrame:
    """Rows ``doc_id, th, th2, text`` with a 128-bit hash of the text."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return d.select("doc_id", F.xxhash64("text").alias("th"), F.xxhash64(F.lit("copy"), "text").alias("th2"), "text")


def _occurrences(docs: DataFrame, words: int) -> DataFrame:
    """Rows ``piece, marks``: the distinct shingles of every text by their first ``PIECE_BITS`` bits.

    A mark is a shingle's hash with the class of the text, a number below 64, in the low six bits.
    A task sends those of some texts together, ascending and each once."""

    def packed(held: list[np.ndarray]) -> pa.RecordBatch:
        marks = _distinct(np.concatenate(held))
        held.clear()
        pieces = np.arange(1 << PIECE_BITS, dtype=np.uint64)
        first = np.searchsorted(marks, pieces << np.uint64(64 - PIECE_BITS))
        piece = np.flatnonzero(np.diff(first, append=len(marks)))  # those that have marks
        ends = pa.py_buffer(np.append(first[piece], len(marks)).astype(np.int32) * np.int32(8))
        return pa.RecordBatch.from_arrays(
            [pa.array(piece.astype(np.int32)), pa.Array.from_buffers(pa.binary(), len(piece), [None, ends, pa.py_buffer(marks)])],
            names=["piece", "marks"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0
        for batch in batches:
            for th, text in zip(batch.column("th").to_pylist(), batch.column("text"), strict=True):
                held.append((shingles(text.as_py(), words) & ~np.uint64(63)) | np.uint64(th & 63))
                size += len(held[-1])
                if size >= MARKS:
                    yield packed(held)
                    size = 0
        if size:
            yield packed(held)

    return _texts(docs).select("th", F.col("text").cast("binary").alias("text")).mapInArrow(run, "piece int, marks binary")


def _frequent(docs: DataFrame, words: int) -> np.ndarray:
    """The table of the frequent class, a bit for each slot: the slots of the shingles that occur in
    texts of ``FREQUENT`` classes or more, counted over all texts. Equal texts are of one class, so
    copies don't make a shingle frequent.

    The class only decides how a shingle is indexed, never whether a link is found; slots that
    shingles share by chance do no harm. The table comes to the driver in pieces of 4 KB, 16 MB in
    all at any size."""
    width = 1 << (CLASS_BITS - PIECE_BITS)

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        marks = _distinct(np.concatenate([np.frombuffer(x, np.uint64) for x in frame["marks"]]))
        token = marks >> np.uint64(6)
        # a token's marks lie together, one for each class
        often = token[FREQUENT - 1:][token[FREQUENT - 1:] == token[:len(token) - FREQUENT + 1]] if len(token) >= FREQUENT else token[:0]
        slot = often >> np.uint64(64 - 6 - CLASS_BITS)
        bits = np.zeros(width, bool)
        bits[(slot & np.uint64(width - 1)).astype(np.int64)] = True
        return pd.DataFrame({"piece": [int(frame["piece"].iloc[0])], "bits": [np.packbits(bits, bitorder="little").tobytes()]})[:len(slot)]

    pieces = _saved(_occurrences(docs, words).groupBy("piece").applyInPandas(pack, "piece int, bits binary"), "frequent-class")
    frequent = np.zeros(1 << (CLASS_BITS - 3), np.uint8)
    for r in pieces.collect():
        at = r.piece * (width // 8)
        frequent[at:at + width // 8] = np.frombuffer(r.bits, np.uint8)
    return frequent


def _index(docs: DataFrame, frequent: np.ndarray, words: int, percent: int) -> DataFrame:
    """Rows ``th, th2, n, bits, keys``; of equal texts a task sends the first only."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, seen = shared.value, set()
        for batch in batches:
            rows: dict[str, list] = {k: [] for k in ("th", "th2", "n", "bits", "keys")}
            for th, th2, text in zip(batch.column("th").to_pylist(), batch.column("th2").to_pylist(), batch.column("text"), strict=True):
                if (th, th2) in seen:
                    continue
                seen.add((th, th2))
                tokens = shingles(text.as_py(), words)
                for k, v in (("th", th), ("th2", th2), ("n", len(tokens)), ("bits", bitmap(tokens)),
                             ("keys", signatures(tokens, frequent, percent).view(np.int64))):
                    rows[k].append(v)
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows["th"], pa.int64()), pa.array(rows["th2"], pa.int64()), pa.array(rows["n"], pa.int64()),
                 pa.array(rows["bits"], pa.binary()), pa.array(rows["keys"], pa.list_(pa.int64()))],
                names=list(rows))

    return _texts(docs).select("th", "th2", F.col("text").cast("binary").alias("text")).mapInArrow(
        run, "th long, th2 long, n long, bits binary, keys array<long>")


def _checked(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """Those of the pairs (a, b) that are linked: bitmaps first, then the whole texts of the rest."""

    def possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("n_a", "n_b", "bits_a", "bits_b")]
            yield batch.select(["a", "b"]).filter(pa.array([may_link(*x, percent) for x in zip(*cols, strict=True)], pa.bool_()))

    def certain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = [batch.column(c) for c in ("text_a", "text_b")]
            yield batch.select(["a", "b"]).filter(pa.array(
                [linked(*(shingles(t.as_py(), words) for t in x), percent) for x in zip(*cols, strict=True)], pa.bool_()))

    def beside(df: DataFrame, right: DataFrame, columns: list[str]) -> DataFrame:
        for side in ("a", "b"):
            r = right.select(F.col("rep").alias(f"rep_{side}"), *[F.col(c).alias(f"{c}_{side}") for c in columns])
            df = df.join(r, F.col(side) == F.col(f"rep_{side}")).drop(f"rep_{side}")
        return df

    left = _saved(beside(pairs, nodes, ["n", "bits"]).select("a", "b", "n_a", "n_b", "bits_a", "bits_b")
                 .mapInArrow(possible, "a long, b long"), "possible-links")
    wanted = left.select(F.explode(F.array("a", "b")).alias("rep")).distinct()
    texts = saved(docs.select(F.col("doc_id").cast("long").alias("rep"), F.col("text").cast("binary").alias("text"))
                  .join(wanted, "rep", "left_semi"), "texts-to-compare")
    return _saved(beside(left, texts, ["text"]).select("a", "b", "text_a", "text_b")
                 .mapInArrow(certain, "a long, b long").distinct(), "links")


def _residues(stars: DataFrame, docs: DataFrame, frequent: np.ndarray, words: int, percent: int) -> DataFrame:
    """Rows ``rep, pivot, n, covered, keys`` for the nodes of each pivot (see ``residue``)."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, center = None, np.zeros(0, np.uint64)
        for batch in batches:
            each, sizes = [], []
            for text, pivot, other in zip(batch.column("text"), batch.column("pivot").to_pylist(), batch.column("center"), strict=True):
                if pivot != last:  # the rows of a pivot come together
                    last, center = pivot, shingles(other.as_py(), words)
                tokens = shingles(text.as_py(), words)
                sizes.append(len(tokens))
                each.append(residue(tokens, shared.value, pivot, center, percent))
            yield pa.RecordBatch.from_arrays(
                [batch.column("rep"), batch.column("pivot"), pa.array(sizes, pa.int64()), pa.array([c for c, _ in each], pa.int64()),
                 pa.array([k.view(np.int64) for _, k in each], pa.list_(pa.int64()))], names=["rep", "pivot", "n", "covered", "keys"])

    wanted = stars.select(F.explode(F.array("rep", "pivot")).alias("rep")).distinct()
    texts = saved(docs.select(F.col("doc_id").cast("long").alias("rep"), F.col("text").cast("binary").alias("text"))
                  .join(wanted, "rep", "left_semi"), "texts-of-large-buckets")
    center = texts.select(F.col("rep").alias("pivot"), F.col("text").alias("center"))
    rows = stars.join(texts, "rep").join(center, "pivot").sortWithinPartitions("pivot")
    return rows.select("rep", "pivot", "text", "center").mapInArrow(run, "rep long, pivot long, n long, covered long, keys array<long>")


def _pairs(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of one key, in different clusters, whose sizes allow a link."""
    x, y = (rows.select("key", *[F.col(c).alias(f"{c}_{s}") for c in ("rep", "least", "most", "label")]) for s in "ab")
    return (x.join(y, "key").where("rep_a < rep_b AND label_a <> label_b").where(
        (F.col("most_a") * 100 >= F.col("least_b") * percent) & (F.col("most_b") * 100 >= F.col("least_a") * percent))
        .select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b")))


def _apart(rows: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(odd, all) rows of the keys whose rows are in several clusters; odd are those outside the key's largest
    cluster. Of two rows in different clusters one is odd, so a large cluster is matched with the few others
    only, and a key whose rows are all connected already costs nothing."""
    each = rows.groupBy(key, "label").agg(F.count(F.lit(1)).alias("size"))
    major = saved(each.groupBy(key).agg(F.max_by("label", F.struct("size", "label")).alias("major"), F.count(F.lit(1)).alias("clusters"))
                  .where("clusters > 1").select(key, "major"), "largest-clusters")
    several = rows.join(major, key)
    return several.where("label <> major").drop("major"), several.drop("major")


def _odd_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """``_pairs`` for keys of any size: the odd rows with the others."""
    odd, every = _apart(rows, "key")
    x, y = (d.select("key", *[F.col(c).alias(f"{c}_{s}") for c in ("rep", "least", "most", "label")]) for d, s in ((odd, "a"), (every, "b")))
    return (x.join(y, "key").where("label_a <> label_b").where(
        (F.col("most_a") * 100 >= F.col("least_b") * percent) & (F.col("most_b") * 100 >= F.col("least_a") * percent))
        .select(F.least("rep_a", "rep_b").alias("a"), F.greatest("rep_a", "rep_b").alias("b")))


def _covered(residues: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of one pivot in different clusters whose covered tokens alone may make a link."""
    odd, every = _apart(residues.select("rep", "pivot", "n", "covered", "label"), "pivot")
    x, y = (d.select("pivot", *[F.col(c).alias(f"{c}_{s}") for c in ("rep", "n", "covered", "label")]) for d, s in ((odd, "a"), (every, "b")))
    most = F.least("covered_a", "covered_b")
    return (x.join(y, "pivot").where("label_a <> label_b")
            .where(100 * most >= percent * (F.col("n_a") + F.col("n_b") - most))
            .select(F.least("rep_a", "rep_b").alias("a"), F.greatest("rep_a", "rep_b").alias("b")))


def shingle_components(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Rows ``doc_id, n_shingles, component_id``, one per row of ``docs``.

    Equal texts are one node, their smallest doc_id; their shingles are indexed once per task.
    Signatures (see ``signatures``) that two nodes share make buckets. A bucket of ``SMALL_BUCKET``
    nodes at most is compared in pairs. In a larger one all nodes are first checked against its
    pivot, its smallest node; those linked with it are one cluster. Any other link in the bucket then
    needs shingles that the pivot doesn't have, and is found through those (see ``residue``), or
    enough of those it has, which the counts of them show. Pairs inside a cluster can't change the
    components and are left out. So the work follows the number of signatures, not of pairs.

    Candidates are compared by size and bitmap, which are safe bounds, then by their whole texts.

    Null or empty text: no shingles, linked with nothing (component: its own doc_id). Rows with one
    doc_id are one node. Null doc_id: its component is that of its copies, null if there are none.
    No rows give no rows. ``percent`` below 67 raises: sets of two would have partners of three, for
    which ``signatures`` has no keys."""
    if not LEAST_PERCENT <= percent <= 100:
        raise ValueError(f"percent must be {LEAST_PERCENT} to 100, not {percent}")
    members = _texts(docs).select("doc_id", "th", "th2")
    groups = saved(members.groupBy("th", "th2").agg(F.min("doc_id").alias("rep")), "equal-texts")
    frequent = _frequent(docs, words)
    index = _saved(_index(docs, frequent, words, percent), "shingle-index")
    sizes = saved(index.select("th", "th2", "n").distinct().join(groups, ["th", "th2"]), "shingle-sizes")
    nodes = saved(index.where("n > 0").select("th", "th2", "n", "bits").join(groups.where("rep is not null"), ["th", "th2"])
                  .groupBy("rep", "n").agg(F.first("bits").alias("bits")), "shingle-nodes")

    # signatures of one text go; the sums of a task hold one row for each key, however hot
    keys = index.select("th", F.explode("keys").alias("key"))
    shared = saved(keys.groupBy("key").agg(F.min("th").alias("low"), F.max("th").alias("high"))
                   .where("low <> high").select("key"), "shared-signatures")
    rows = keys.join(shared, "key")
    rows = saved(rows.join(groups.where("rep is not null").select("th", "rep"), "th").select("key", "rep").distinct(), "signature-rows")

    buckets = saved(rows.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("rep").alias("pivot")), "buckets")
    large = rows.join(buckets.where(F.col("size") > SMALL_BUCKET), "key")
    stars = saved(large.where("rep <> pivot").select("rep", "pivot").distinct(), "stars")
    links = _checked(stars.select(F.col("pivot").alias("a"), F.col("rep").alias("b")), nodes, docs, words, percent)
    clusters = components(links)

    sized = saved(nodes.groupBy("rep").agg(F.min("n").alias("least"), F.max("n").alias("most"))
                  .join(clusters, F.col("rep") == F.col("node"), "left")
                  .select("rep", "least", "most", F.coalesce("label", "rep").alias("label")), "clusters")
    small = rows.join(buckets.where(F.col("size") <= SMALL_BUCKET).select("key"), "key").join(sized, "rep")
    residues = _saved(_residues(stars, docs, frequent, words, percent).join(sized.select("rep", "label"), "rep"), "residues")
    rest = residues.select("rep", F.explode("keys").alias("key"))
    met = rest.groupBy("key").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).where("low <> high").select("key")
    rest = rest.join(saved(met, "shared-residues"), "key").distinct().join(sized, "rep")
    second = _pairs(saved(small, "small-buckets"), percent).union(_odd_pairs(saved(rest, "residue-rows"), percent)).union(
        _covered(residues, percent)).distinct()
    more = _checked(second, nodes, docs, words, percent)
    whole = components(links.unionByName(more))

    placed_docs = members.join(sizes, ["th", "th2"]).join(whole, F.col("rep") == F.col("node"), "left")
    return placed_docs.select("doc_id", F.col("n").alias("n_shingles"),
                              F.when(F.col("n") > 0, F.coalesce("label", "rep")).otherwise(F.col("doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` whose doc_id is the smallest of its component (rows without id stay)."""
    gone = shingle_components(docs, words, percent).where("doc_id <> component_id").select(
        F.col("doc_id").alias("_gone_id")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["_gone_id"], "left_anti")


def op4_shingle_join(spark, sf_dir):
    """Contract digest: ``shingle_components`` over all documents."""
    return shingle_components(table(spark, sf_dir, "documents"))
