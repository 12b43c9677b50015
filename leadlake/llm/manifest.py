"""Merkle manifest of a dataset: leaf places by bitmap ranks, levels reduced in keyed slot arrays."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from leadlake.llm.work import same, saved, table

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
WORD_BITS = 6                    # ids of a bitmap word
CONTAINER_BITS = 12              # ids of a container: up to 64 words, of which it holds those that aren't zero
DIGITS = (13, 13, 13, 13)        # the directories above the containers, least digit first; 64 bits in all
SLOT_BITS = 10                   # levels that one slot array reduces
TIE_DIGITS = 3                   # rows with one id are ordered in 16^3 ranges of their leaves


def sha(*inputs: Column) -> Column:
    """Lower-case hexadecimal SHA-256 of the concatenated inputs."""
    return F.sha2(F.concat(*inputs).cast("binary"), 256)


def leaf_hash(values: Mapping[str, Column]) -> Column:
    """Digest of a row: every field as `-` if null, else its UTF-8 length, `:` and the value."""
    return sha(*[F.coalesce(F.concat(F.octet_length(v.cast("string")).cast("string"), F.lit(":"), v.cast("string")), F.lit("-"))
                 for v in values.values()])


def _bit(at: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), at.cast("int"))


def _below(at: Column) -> Column:
    """A word with the bits under ``at`` set (63 at most: the top bit alone less one would overflow)."""
    return F.bitwise_not(F.call_function("shiftleft", F.lit(-1).cast("long"), at.cast("int")))


def _words(leaves: DataFrame) -> DataFrame:
    """Rows ``lang, container, word_no, word, held``: the bitmap words that are not zero and the rows
    in each; the words of a task are merged before they are shuffled."""
    return (leaves.where(F.col("id").isNotNull())
            .groupBy("lang", F.shiftright("id", CONTAINER_BITS).alias("container"),
                     F.shiftright("id", WORD_BITS).bitwiseAND(63).cast("int").alias("word_no"))
            .agg(F.bit_or(_bit(F.col("id").bitwiseAND(63))).alias("word"), F.count(F.lit(1)).alias("held")))


def _containers(words: DataFrame, extras: DataFrame) -> DataFrame:
    """Compressed containers with their popcount directory, and the rows before each of them.

    ``mask`` tells which words there are, ``words`` holds them, ``before`` the rows in those before each,
    ``extras`` the surplus rows of ids that occur more than once. ``start`` counts the rows of the language in
    earlier containers: a directory for every digit of the container number has at most 2^13 entries under one
    parent, so no window holds more, however sparse the ids are."""
    each = F.sort_array(F.collect_list(F.struct("word_no", "word", "held")))
    c = words.groupBy("lang", "container").agg(
        F.bit_or(_bit(F.col("word_no"))).alias("mask"), each.alias("each"), F.sum("held").alias("held"))
    running = F.aggregate("each", F.array(F.lit(0).cast("long")), lambda acc, w: F.concat(acc, F.array(F.element_at(acc, -1) + w["held"])))
    c = c.select("lang", "container", "mask", F.col("each.word").alias("words"), running.alias("before"), "held")
    x = extras.groupBy("lang", F.shiftright("id", CONTAINER_BITS).alias("container")).agg(
        F.collect_list(F.struct(F.col("id").bitwiseAND((1 << CONTAINER_BITS) - 1).cast("int").alias("at"), "more")).alias("extras"))
    c = saved(c.join(x, same(c, x, ["lang", "container"]), "left").select(c["*"], x["extras"]), "manifest-containers")

    # counts by ever shorter prefixes of the container number, then running sums from the top down
    levels, shift = [c.select("lang", F.col("container").alias("node"), "held")], 0
    for bits in DIGITS[:-1]:
        shift += bits
        levels.append(levels[-1].groupBy("lang", F.shiftright("node", bits).alias("node")).agg(F.sum("held").alias("held")))
    starts = None
    for level, bits in zip(reversed(levels), reversed(DIGITS), strict=True):
        parent = F.lit(0).cast("long") if starts is None else F.shiftright("node", bits)  # the top digit has the sign
        run = F.sum("held").over(W.partitionBy("lang", parent).orderBy("node").rowsBetween(W.unboundedPreceding, -1))
        placed = level.select("lang", "node", parent.alias("parent"), F.coalesce(run, F.lit(0)).alias("start"))
        if starts is not None:
            up = starts.select(F.col("lang").alias("up_lang"), F.col("node").alias("up"), F.col("start").alias("up_start"))
            placed = placed.join(up, placed["lang"].eqNullSafe(up["up_lang"]) & (placed["parent"] == up["up"])).select(
                "lang", "node", (F.col("start") + F.col("up_start")).alias("start"))
        starts = placed.select("lang", "node", "start")
    s = starts.select(F.col("lang").alias("s_lang"), F.col("node").alias("s_node"), "start")
    return c.join(s, c["lang"].eqNullSafe(s["s_lang"]) & (c["container"] == s["s_node"])).drop("s_lang", "s_node")


def _ranked(leaves: DataFrame, langs: DataFrame, carried: list[str]) -> DataFrame:
    """Rows ``lang, id, leaf, *carried, pos``: places 0, 1, ... of each language's leaves in ascending order of
    id, null ids first; rows with one id go by their leaves, equal rows anyhow. Nothing is sorted but those."""
    words = saved(_words(leaves), "manifest-words")
    # ids that occur more than once are in words that hold more rows than bits
    twice = words.where(F.col("held") > F.bit_count("word")).select(
        F.col("lang").alias("t_lang"), F.col("container").alias("t_container"), F.col("word_no").alias("t_word_no"))
    in_twice = (leaves["lang"].eqNullSafe(F.col("t_lang")) & (F.shiftright(leaves["id"], CONTAINER_BITS) == F.col("t_container"))
                & (F.shiftright(leaves["id"], WORD_BITS).bitwiseAND(63) == F.col("t_word_no")))
    extras = saved(leaves.select("lang", "id").join(twice, in_twice, "left_semi").groupBy("lang", "id")
                   .agg((F.count(F.lit(1)) - 1).alias("more")).where("more > 0"), "manifest-extras")
    containers = saved(_containers(words, extras), "manifest-ranks")

    # rows with an id of their own, or the first of several: rank queries against the containers
    c = containers.select(F.col("lang").alias("c_lang"), "container", "mask", "words", "before", "extras", "start")
    j = leaves.where(F.col("id").isNotNull()).join(
        c, leaves["lang"].eqNullSafe(F.col("c_lang")) & (F.shiftright(leaves["id"], CONTAINER_BITS) == F.col("container")))
    low = F.col("id").bitwiseAND((1 << CONTAINER_BITS) - 1)
    word_no = F.shiftright(low, WORD_BITS)
    at = F.bit_count(F.col("mask").bitwiseAND(_below(word_no)))
    bits = F.bit_count(F.get("words", at).bitwiseAND(_below(F.col("id").bitwiseAND(63))))
    more = F.aggregate(F.filter("extras", lambda e: (e["at"] < low) & (F.shiftright(e["at"], WORD_BITS) == word_no)),
                       F.lit(0).cast("long"), lambda a, e: a + e["more"])
    rank = F.col("start") + F.get("before", at) + bits + F.coalesce(more, F.lit(0))
    own = F.coalesce(F.exists("extras", lambda e: e["at"] == low), F.lit(False))
    rows = j.select("lang", "id", "leaf", *carried, rank.alias("rank"), own.alias("tied"))
    none = leaves.where(F.col("id").isNull()).select("lang", "id", "leaf", *carried, F.lit(0).cast("long").alias("rank"), F.lit(True).alias("tied"))
    rows = saved(rows.unionByName(none), "manifest-places")

    # rows that share an id: equal ones are counted, the others ordered in ranges of their leaves
    d = saved(rows.where("tied").groupBy("lang", "id", "rank", "leaf", *carried).agg(F.count(F.lit(1)).alias("copies"))
              .withColumn("range", F.substring("leaf", 1, TIE_DIGITS)), "manifest-ties")
    key = ["lang", "id"]
    r = d.groupBy(*key, "range").agg(F.sum("copies").alias("held"))
    r = r.select(*[F.col(k).alias(f"r_{k}") for k in key], F.col("range").alias("r_range"), F.coalesce(
        F.sum("held").over(W.partitionBy(*key).orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))
    inside = F.coalesce(F.sum("copies").over(W.partitionBy(*key, "range").orderBy("leaf", *carried).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    t = d.withColumn("inside", inside).join(
        r, d["lang"].eqNullSafe(r["r_lang"]) & d["id"].eqNullSafe(r["r_id"]) & (d["range"] == r["r_range"]))
    ties = t.select("lang", "id", "leaf", *carried, (F.col("rank") + F.col("ahead") + F.col("inside")).alias("rank"),
                    F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("copy"))
    ties = ties.withColumn("rank", F.col("rank") + F.col("copy")).drop("copy")

    placed = rows.where(~F.col("tied")).drop("tied").unionByName(ties)
    nulls = langs.select(F.col("lang").alias("n_lang"), "nulls", F.col("n").alias("nodes"))  # one row per language
    return placed.join(nulls, placed["lang"].eqNullSafe(nulls["n_lang"])).select(
        "lang", "id", "leaf", *carried, "nodes",
        (F.col("rank") + F.when(F.col("id").isNull(), F.lit(0)).otherwise(F.col("nulls"))).alias("pos"))


def _slot_arrays(nodes: DataFrame, carried: list[str]) -> DataFrame:
    """Nodes (tree, nodes, pos, digest, *carried) as one row for every 2^SLOT_BITS places of a tree:
    ``slots``, an array in the order of the places."""
    return nodes.groupBy("tree", "nodes", F.shiftright("pos", SLOT_BITS).alias("block")).agg(
        F.sort_array(F.collect_list(F.struct("pos", "digest", *carried))).alias("slots"))


def _levels() -> Column:
    """The levels of a slot array from its digests up to its root, as an array of arrays.

    A level is halved while the whole tree has more than one node on it; a last node without a
    neighbour is hashed alone."""
    height = F.least(F.lit(SLOT_BITS), F.ceil(F.log2("nodes") - 1e-9).cast("int"))

    def halved(acc: Column, _: Column) -> Column:
        last = F.element_at(acc, -1)
        pairs = F.sequence(F.lit(0), F.ceil(F.size(last) / 2).cast("int") - 1)
        return F.concat(acc, F.array(F.transform(pairs, lambda i: sha(F.get(last, 2 * i), F.coalesce(F.get(last, 2 * i + 1), F.lit(""))))))

    start = F.array(F.col("slots.digest"))
    return F.when(height > 0, F.aggregate(F.sequence(F.lit(1), F.greatest(height, F.lit(1))), start, halved)).otherwise(start)


def _reduced(blocks: DataFrame) -> DataFrame:
    """The roots of the slot arrays as nodes of the next pass."""
    return blocks.select("tree", F.ceil(F.col("nodes") / (1 << SLOT_BITS)).cast("long").alias("nodes"), F.col("block").alias("pos"),
                         F.get(F.element_at(_levels(), -1), F.lit(0)).alias("digest"))


def _paths(blocks: DataFrame, above: DataFrame, carried: list[str]) -> DataFrame:
    """Rows ``tree, pos, digest, *carried, path``: the steps from each slot to the root. A step is L or R,
    the side of the sibling, with its digest, or - for a node that is hashed alone. ``above``
    (tree, pos, path) has the steps from the arrays' own roots."""
    a = above.select(F.col("tree").alias("a_tree"), F.col("pos").alias("a_pos"), F.col("path").alias("a_path"))
    b = blocks.join(a, blocks["tree"].eqNullSafe(a["a_tree"]) & (blocks["block"] == a["a_pos"]))

    def steps(levels: Column, i: Column) -> Column:
        def step(level: Column, k: Column) -> Column:
            at = F.call_function("shiftright", i, k)
            sibling = F.get(level, F.when(at % 2 == 0, at + 1).otherwise(at - 1))
            return F.coalesce(F.concat(F.when(at % 2 == 0, F.lit("R")).otherwise(F.lit("L")), sibling), F.lit("-"))
        return F.transform(F.slice(levels, 1, F.size(levels) - 1), step)

    # the levels are bound by a lambda, else they would be computed again for every slot
    each = F.transform(F.array(_levels()), lambda levels: F.transform(
        "slots", lambda s, i: F.struct(s.alias("slot"), steps(levels, i).alias("steps"))))
    e = b.select("tree", "a_path", F.explode(F.get(each, F.lit(0))).alias("e"))
    return e.select("tree", *[F.col(f"e.slot.{c}").alias(c) for c in ("pos", "digest", *carried)],
                    F.concat("e.steps", "a_path").alias("path"))


def _trees(nodes: DataFrame, name: str, carried: list[str]) -> tuple[list[DataFrame], DataFrame]:
    """(slot arrays of every pass, roots): one pass reduces 2^SLOT_BITS nodes of a tree to one."""
    passes = []
    while True:
        blocks = saved(_slot_arrays(nodes, carried if not passes else []), f"manifest-{name}-{len(passes)}")
        passes.append(blocks)
        nodes = _reduced(blocks)
        if (blocks.agg(F.max("nodes")).first()[0] or 0) <= 1 << SLOT_BITS:
            return passes, nodes.select("tree", "digest")


def _down(passes: list[DataFrame], above: DataFrame, carried: list[str], name: str) -> DataFrame:
    """Paths of the nodes of the first pass, from those of the roots (tree, pos, path)."""
    for k in range(len(passes) - 1, 0, -1):
        above = saved(_paths(passes[k], above, []).select("tree", "pos", "path"), f"manifest-{name}-paths-{k}")
    return _paths(passes[0], above, carried)


def merkle_manifest(docs: DataFrame, carry: Mapping[str, Column] | None = None) -> DataFrame:
    """Rows ``doc_id, lang, pos, leaf, path, subroot, root`` and the columns of ``carry``, one per row of ``docs``.

    ``leaf`` is the digest of the row (see ``leaf_hash``). The leaves of a language, ascending by
    doc_id, are the nodes of a tree in which two neighbours become the digest of both, and a last one
    alone the digest of itself, until one is left, the ``subroot``; the subroots in the order of the
    languages (null first, by UTF-8 bytes) become ``root`` likewise. ``path`` leads from the leaf to the
    root (see ``folded``). ``carry`` names narrow expressions over ``docs`` to go along; the text itself
    never leaves the scan.

    Places come from rank queries: ids are bits of compressed bitmaps per language that tasks build and
    a shuffle merges, with popcount directories above them; a leaf joins its container of 4096 ids and
    counts the bits before it. Each shuffle of the tree reduces ten levels, so a billion leaves take three.

    Null doc_id: before all others, by leaf. Rows with one doc_id go by leaf; equal rows have neighbouring
    places. Null language: a tree of its own. No rows give no rows."""
    carry = dict(carry or {})
    carried = list(carry)
    leaves = saved(docs.select(
        F.col("lang").cast("string").alias("lang"), F.col("doc_id").cast("long").alias("id"),
        leaf_hash({f: F.col(f) for f in FIELDS}).alias("leaf"), *[c.alias(k) for k, c in carry.items()]), "manifest-leaves")
    langs = saved(leaves.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("id").isNull()).alias("nulls")), "manifest-langs")
    placed = _ranked(leaves, langs, carried)
    nodes = placed.select(F.col("lang").alias("tree"), "nodes", "pos", F.col("leaf").alias("digest"), "id", *carried)
    passes, subroots = _trees(nodes, "lang", ["id", *carried])
    subroots = saved(subroots, "manifest-subroots")

    # the tree over the languages: one row for each of them
    order = W.orderBy(F.col("tree").asc_nulls_first())
    tops = subroots.select(F.lit("root").alias("tree"), F.count(F.lit(1)).over(W.partitionBy()).alias("nodes"),
                           (F.row_number().over(order) - 1).cast("long").alias("pos"), "digest", F.col("tree").alias("lang"))
    upper, roots = _trees(tops, "root", ["lang"])
    root = saved(roots, "manifest-root").select("digest").first()
    root = root.digest if root else None
    start = roots.select("tree", F.lit(0).cast("long").alias("pos"), F.array().cast("array<string>").alias("path"))
    of_lang = saved(_down(upper, start, ["lang"], "root").select(F.col("lang").alias("tree"), F.lit(0).cast("long").alias("pos"), "path",
                                                                F.col("digest").alias("subroot")), "manifest-lang-paths")
    found = _down(passes, of_lang.select("tree", "pos", "path"), ["id", *carried], "lang")
    s = of_lang.select(F.col("tree").alias("s_tree"), "subroot")
    return found.join(s, found["tree"].eqNullSafe(s["s_tree"])).select(
        F.col("id").alias("doc_id"), F.col("tree").alias("lang"), "pos", F.col("digest").alias("leaf"), *carried, "path", "subroot",
        F.lit(root).cast("string").alias("root"))


def proof(path: str = "path") -> Column:
    """Digest of the siblings of a path, the lowest first."""
    siblings = F.filter(path, lambda s: s != "-")
    return F.sha2(F.array_join(F.transform(siblings, lambda s: F.substring(s, 2, 64)), "").cast("binary"), 256)


def folded(leaf: Column, path: str = "path") -> Column:
    """The root that a leaf and the siblings of its path give."""
    def up(x: Column, s: Column) -> Column:
        side, sibling = F.substring(s, 1, 1), F.substring(s, 2, 64)
        return F.when(side == "L", sha(sibling, x)).when(side == "R", sha(x, sibling)).otherwise(sha(x))
    return F.aggregate(path, leaf, up)


def op11_manifest(spark, sf_dir):
    """Contract digest of ``merkle_manifest`` over all documents, a seventh of them tampered with."""
    docs = table(spark, sf_dir, "documents")
    changed = leaf_hash({f: F.try_add(F.col(f), F.lit(1)) if f == "n_chars" else F.col(f) for f in FIELDS})
    tampered = F.when((F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0) & F.col("n_chars").isNotNull(), changed)
    m = merkle_manifest(docs, {"tampered": tampered})
    m = m.select("doc_id", "leaf", "subroot", "root", proof().alias("proof_sha256"),
                 folded(F.coalesce("tampered", "leaf")).alias("folded_root"))
    return m.withColumn("verified", F.col("folded_root") == F.col("root"))


OP11_SQL = r"""
WITH RECURSIVE bits(b, v, k) AS (
  SELECT CAST(b AS BIGINT), CAST(b AS BIGINT), 0 FROM range(256) t(b)
  UNION ALL
  SELECT b, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1 FROM bits WHERE k < 8),
crc_table AS (SELECT list(v ORDER BY b) AS t FROM bits WHERE k = 8),
crc AS (SELECT doc_id, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
                                       lambda a, x: xor(t[1 + (xor(a, x) & 255)], a >> 8)), 4294967295::BIGINT) AS c
        FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL), crc_table),
f AS (SELECT documents.doc_id, lang, n_chars IS NOT NULL AND coalesce(c % 7 = 0, false) AS hit,
        coalesce(strlen(CAST(documents.doc_id AS VARCHAR)) || ':' || documents.doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
          || coalesce(strlen(lang) || ':' || lang, '-') AS head,
        coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS n0,
        coalesce(strlen(CAST(n_chars + 1 AS VARCHAR)) || ':' || (n_chars + 1), '-') AS n1,
        coalesce(strlen(text) || ':' || text, '-') AS tail
      FROM documents LEFT JOIN crc ON documents.doc_id = crc.doc_id),
h AS (SELECT doc_id, coalesce('l' || lang, 'a') AS tree, sha256(head || n0 || tail) AS leaf,
        CASE WHEN hit THEN sha256(head || n1 || tail) ELSE sha256(head || n0 || tail) END AS claimed FROM f),
p AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM h),
low(tree, level, a) AS (
  SELECT tree, 0, list(leaf ORDER BY pos) FROM p GROUP BY tree
  UNION ALL
  SELECT tree, level + 1, list_transform(range(0, len(a), 2), lambda i: sha256(a[i + 1] || coalesce(a[i + 2], ''))) FROM low WHERE len(a) > 1),
subs AS (SELECT tree, a[1] AS subroot, row_number() OVER (ORDER BY tree) - 1 AS place FROM low WHERE len(a) = 1),
high(level, a) AS (
  SELECT 0, list(subroot ORDER BY place) FROM subs
  UNION ALL
  SELECT level + 1, list_transform(range(0, len(a), 2), lambda i: sha256(a[i + 1] || coalesce(a[i + 2], ''))) FROM high WHERE len(a) > 1),
top AS (SELECT a[1] AS root FROM high WHERE len(a) = 1),
low_steps AS (
  SELECT p.tree, p.pos, level, a[CASE WHEN (pos >> level) % 2 = 0 THEN (pos >> level) + 2 ELSE pos >> level END] AS sibling,
         (pos >> level) % 2 = 1 AS is_left
  FROM p JOIN low ON p.tree = low.tree WHERE len(a) > 1),
high_steps AS (
  SELECT tree, 1000 + level AS level, a[CASE WHEN (place >> level) % 2 = 0 THEN (place >> level) + 2 ELSE place >> level END] AS sibling,
         (place >> level) % 2 = 1 AS is_left
  FROM subs, high WHERE len(a) > 1),
steps AS (
  SELECT tree, pos, list(coalesce(CASE WHEN is_left THEN 'L' ELSE 'R' END || sibling, '-') ORDER BY level) AS s FROM (
    SELECT tree, pos, level, sibling, is_left FROM low_steps
    UNION ALL SELECT p.tree, p.pos, level, sibling, is_left FROM p JOIN high_steps ON p.tree = high_steps.tree) GROUP BY tree, pos),
done AS (
  SELECT doc_id, leaf, subroot, root, sha256(list_aggregate(list_prepend('', list_transform(coalesce(s, []), lambda x: substr(x, 2))), 'string_agg', '')) AS proof_sha256,
         list_reduce(list_prepend(claimed, coalesce(s, [])), lambda x, y: CASE substr(y, 1, 1) WHEN 'L' THEN sha256(substr(y, 2) || x)
                                                             WHEN 'R' THEN sha256(x || substr(y, 2)) ELSE sha256(x) END) AS folded_root
  FROM p JOIN subs ON p.tree = subs.tree LEFT JOIN steps ON p.tree = steps.tree AND p.pos = steps.pos, top)
SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified FROM done
"""
