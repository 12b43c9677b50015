"""Token-id files: frequency-ranked ids in byte-aligned variable-length coding.

A token file set is a folder with two Parquet tables, written and committed by Spark:

``vocabulary``  rank, id, n: the ids in descending frequency (ties by id); rank 0 comes most often.
``blocks``      one row for each run of documents, in ascending order of doc_id over shards and
                blocks: shard, block, start (ids of the shard before the block), doc_ids,
                lengths (ids of each document), control, data.

``data`` holds each rank in 1 to 4 bytes, little-endian, without its leading zero bytes;
``control`` holds two bits for each rank (bytes - 1), four to a byte, lowest bits first. The
length of a block is the sum of ``lengths``; unused bits of the last control byte are 0.
"""

from __future__ import annotations

import gc
import re
import struct
import sys
import types
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from leadlake.llm.work import batches_of, parts, saved, table
from leadlake.session import ensure_checkpoint_dir

END_ID = 2            # appended to each document
BLOCK_DOCS = 512      # documents of a block at most
BLOCK_IDS = 1 << 20   # a block ends after the document that reaches so many ids
CACHED_BYTES = 32 << 20  # of a generation of pieces and their ids that a Python worker remembers; it has two
PIECE_BYTES = 150     # a remembered piece takes so much besides its characters and ids
ROWS = 256            # documents that are encoded together at most
TEXT_BYTES = 1 << 20  # a group of documents ends after the one that reaches so many bytes of text
BATCH_BYTES = 8 << 20  # of texts or ids that are sent to a Python worker at once, or one row

# --- variable-length coding -------------------------------------------------------------

_SHIFTS = np.array([0, 2, 4, 6], np.uint8)
#: bytes of the four ranks of every control byte
LENGTHS = ((np.arange(256)[:, None] >> _SHIFTS) & 3).astype(np.uint8) + 1


def pack(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """(control, data) of the ranks."""
    v = np.ascontiguousarray(ranks, "<u4")
    most = int(v.max(initial=0))
    size = 1 + (most > 0xFF) + (most > 0xFFFF) + (most > 0xFFFFFF)  # bytes of the largest
    used = np.ones((len(v), size), bool)
    padded = np.zeros(-(-len(v) // 4) * 4, np.uint8)
    for k in range(1, size):
        used[:, k] = v > (1 << 8 * k) - 1
        padded[:len(v)] += used[:, k]
    a, b, c, d = padded.reshape(-1, 4).T
    control = a | b << 2 | c << 4 | d << 6
    data = v.view(np.uint8).reshape(-1, 4)[:, :size][used]
    return control.tobytes(), data.tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The ``n`` ranks: the table gives the lengths of four ranks at a time, their running sum the
    places of the bytes."""
    size = LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    end = np.cumsum(size, dtype=np.int64)
    start = end - size
    raw = np.frombuffer(data, np.uint8)
    out = raw[start].astype(np.uint32)
    for k in range(1, 4):
        at = np.flatnonzero(size > k)
        if not len(at):
            break
        out[at] |= raw[start[at] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


# --- encoding ---------------------------------------------------------------------------

# A text of ASCII without the apostrophe and of the letters of Latin-1 is cut where the tokenizer
# cuts it: words, single digits and runs of marks.
_SIMPLE = re.compile(r"[ \t-\r!-&(-~À-ÖØ-öø-ÿ]*\Z")
_PIECE = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+|[0-9]|[!-/:-@\[-`{-~]+")


class _Pieces(dict):
    """Ids of a generation of pieces, each as bytes; a piece that is looked up and missing is taken
    from the generation before or made."""

    def __init__(self, make: Callable[[str], bytes], older: dict[str, bytes]):
        self.make, self.older, self.held = make, older, 0

    def __missing__(self, piece: str) -> bytes:
        ids = self.older.get(piece)
        if ids is None:
            ids = self.make(piece)
        self[piece] = ids
        self.held += PIECE_BYTES + len(piece) + len(ids)
        return ids


class Encoder:
    """Ids of texts under a tokenizer that never joins pieces across ASCII white space.

    Such a tokenizer gives the ids of a text as those of its chunks one after another, and those of
    a simple chunk or text (see ``_SIMPLE``) as those of its pieces; any other chunk is one piece.
    So a distinct piece goes through the library once and is then looked up. Pieces of simple
    texts are what the tokenizer's normalizer and pre-tokenizer make of them anyhow, so they go
    straight to its model; others go through all of it.

    A full generation of pieces becomes the older one and the older one goes; pieces that come
    again move to the new one, so rare pieces are forgotten and memory does not grow with the texts."""

    def __init__(self, description: str):
        from tokenizers import Tokenizer, pre_tokenizers
        self.tokenizer = Tokenizer.from_str(description)
        self.model = self.tokenizer.model
        self.model._resize_cache(0)  # every piece comes once
        to_bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        letters = {ord(c): to_bytes.pre_tokenize_str(c.lower())[0][0] for c in map(chr, range(0xC0, 0x100)) if _PIECE.match(c)}
        self.as_bytes = lambda piece: piece.translate(letters)
        probe = ["the", "qwzxv", "naïve", "straße", "7", "!!", "$%&", "été"]
        if [self._of_model(p) for p in probe] != [self._whole(p) for p in probe]:
            raise ValueError("the tokenizer does not cut words, digits and marks as token files need it")
        # strings that are one token wherever they stand, whatever their case there
        added = [t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile(b"|".join(re.escape(t.encode()) for t in added) or rb"(?!)").search
        self.wordy = any(_PIECE.fullmatch(t) for t in added)  # some can lie inside a piece
        self.older: dict[str, bytes] = {}
        self.pieces = _Pieces(self._of_piece, self.older)

    def _cut(self, text: bytes) -> list[str]:
        low = text.lower()  # A-Z only; the tokenizer lower-cases too
        if self.special(low):
            return [p for chunk in text.split() for p in self._beside_special(chunk)]
        whole = low.decode("utf-8", "replace")
        if _SIMPLE.match(whole):
            return _PIECE.findall(whole)
        out: list[str] = []
        for chunk in low.split():  # bytes.split: ASCII white space
            c = chunk.decode("utf-8", "replace")
            out += _PIECE.findall(c) if _SIMPLE.match(c) else (c,)
        return out

    def _beside_special(self, chunk: bytes) -> list[str]:
        """The pieces of a chunk of a text with an added token; a chunk that holds one stays as it stands."""
        return [chunk.decode("utf-8", "replace")] if self.special(chunk.lower()) else self._cut(chunk)

    def _whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _of_model(self, piece: str) -> list[int]:
        return [t.id for t in self.model.tokenize(piece if piece.isascii() else self.as_bytes(piece))]

    def _of_piece(self, piece: str) -> bytes:
        plain = _PIECE.fullmatch(piece) and not (self.wordy and self.special(piece.lower().encode()))
        ids = self._of_model(piece) if plain else self._whole(piece)
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        out = []
        for text in texts:
            if self.pieces.held > CACHED_BYTES:
                self.older = dict(self.pieces)
                self.pieces = _Pieces(self._of_piece, self.older)
            out.append(np.frombuffer(b"".join(map(self.pieces.__getitem__, self._cut(text))), "<u4"))
        return out


def encoder(description: str) -> Encoder:
    """The worker's encoder; it lives as long as the Python worker, not only for one task."""
    kept = sys.modules.setdefault("_token_file_encoders", types.ModuleType("_token_file_encoders")).__dict__
    key = f"{zlib.crc32(description.encode())}:{len(description)}"
    if key not in kept:
        gc.set_threshold(1_000_000)  # millions of strings in caches and no cycles among them
        kept[key] = Encoder(description)
    return kept[key]


def _encoded(batch: pa.RecordBatch, enc: Encoder, end_id: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, ids with the end id) of a batch."""
    end = np.array([end_id], "<u4")
    texts: list[bytes] = []
    size = 0
    for row, text in enumerate(batch.column("text")):
        texts.append(text.as_py() or b"")
        size += len(texts[-1])
        if len(texts) >= ROWS or size >= TEXT_BYTES or row + 1 == len(batch):
            for k, ids in enumerate(enc.encode(texts), row + 1 - len(texts)):
                yield k, np.concatenate([ids, end])
            texts, size = [], 0


RAW = "shard int, block int, start long, doc_ids array<long>, lengths array<int>, ids binary"


def raw_blocks(docs: DataFrame, description: str, end_id: int = END_ID) -> DataFrame:
    """The blocks with their ids as 32-bit integers, written beside the checkpoints.

    The texts are dealt into ranges of doc_id, so that shard k holds the ids before those of shard
    k + 1, sorted in their partitions and encoded there, each once."""
    shared = docs.sparkSession.sparkContext.broadcast(description)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, block, start, shard = encoder(shared.value), 0, 0, 0
        doc_ids: list[int | None] = []
        kept: list[np.ndarray] = []
        size = 0

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([shard], pa.int32()), pa.array([block], pa.int32()), pa.array([start], pa.int64()),
                 pa.array([doc_ids], pa.list_(pa.int64())), pa.array([[len(x) for x in kept]], pa.list_(pa.int32())),
                 pa.array([np.concatenate(kept).tobytes()], pa.binary())],
                names=["shard", "block", "start", "doc_ids", "lengths", "ids"])

        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            shard = batch.column("shard")[0].as_py() if len(batch) else shard
            for k, x in _encoded(batch, enc, end_id):
                doc_ids.append(ids[k])
                kept.append(x)
                size += len(x)
                if len(kept) >= BLOCK_DOCS or size >= BLOCK_IDS:
                    yield row()
                    block, start, size, doc_ids, kept = block + 1, start + size, 0, [], []
        if kept:
            yield row()

    dealt = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), F.col("text").cast("binary").alias("text"))
             .repartitionByRange(parts(docs.sparkSession), F.col("doc_id").asc_nulls_first(), "th")
             .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "th")
             .select("doc_id", "text", F.spark_partition_id().alias("shard")))
    with batches_of(docs.sparkSession, BATCH_BYTES):
        return saved(dealt.mapInArrow(run, RAW), "raw-ids")


def id_counts(raw: DataFrame) -> DataFrame:
    """Rows ``id, n`` over all blocks; each task sends a row per id that it saw."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for ids in batch.column("ids"):
                n = np.bincount(np.frombuffer(ids.as_py(), "<u4"), minlength=len(total))
                n[:len(total)] += total
                total = n
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], names=["id", "n"])

    return raw.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


BLOCKS = ("shard int, block int, start long, doc_ids array<long>, lengths array<int>, control binary, data binary")


def write_token_files(docs: DataFrame, path: str, tokenizer_file: str, end_id: int = END_ID) -> None:
    """Encode every text of ``docs`` and write the file set to ``path``.

    The texts are encoded once, into blocks of plain ids; the ids are counted over all blocks, the
    ranking has a row per id of the vocabulary and is broadcast, and each block is written again
    with ranks in the coding of the files, without a shuffle.

    Null text: only the end id. Null ids come first. Equal ids are ordered by a hash of their texts."""
    spark = docs.sparkSession
    with open(tokenizer_file, encoding="utf-8") as f:
        description = f.read()
    raw = raw_blocks(docs, description, end_id)
    with batches_of(spark, BATCH_BYTES):
        counted = [(r.id, r.n) for r in id_counts(raw).collect()]  # the vocabulary's size at most
    ranked = sorted(counted, key=lambda r: (-r[1], r[0]))
    spark.createDataFrame([(k, i, n) for k, (i, n) in enumerate(ranked)], "rank int, id int, n long").coalesce(1).write.parquet(f"{path}/vocabulary")
    rank_of = np.zeros(max((i for i, _ in ranked), default=0) + 1, "<u4")
    for k, (i, _) in enumerate(ranked):
        rank_of[i] = k
    shared = spark.sparkContext.broadcast(rank_of)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, ids in enumerate(batch.column("ids")):
                control, data = pack(shared.value[np.frombuffer(ids.as_py(), "<u4")])
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).slice(k, 1) for c in ("shard", "block", "start", "doc_ids", "lengths")),
                     pa.array([control], pa.binary()), pa.array([data], pa.binary())],
                    names=["shard", "block", "start", "doc_ids", "lengths", "control", "data"])

    with batches_of(spark, BATCH_BYTES):
        raw.mapInArrow(run, BLOCKS).write.option("compression", "none").parquet(f"{path}/blocks")


def _blocks(spark: SparkSession, path: str) -> DataFrame:
    """The blocks with ``base``, the number of ids in the shards before (one row per shard is summed)."""
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    sizes = blocks.select("shard", F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x).alias("n")).groupBy("shard").agg(F.sum("n").alias("n"))
    before = F.coalesce(F.sum("n").over(W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return blocks.join(sizes.select("shard", before.cast("long").alias("base")), "shard")


def _read(spark: SparkSession, path: str, schema: str, make) -> DataFrame:
    ids = spark.read.schema("rank int, id int, n long").parquet(f"{path}/vocabulary").orderBy("rank").select("id")
    shared = spark.sparkContext.broadcast(np.array([r.id for r in ids.collect()], "<u4"))  # the vocabulary's size at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        id_of = shared.value
        for batch in batches:
            for k in range(len(batch)):
                b = batch.slice(k, 1).to_pylist()[0]
                lengths = np.array(b["lengths"], np.int64)
                ends = np.cumsum(lengths)
                ids = id_of[unpack(b["control"], b["data"], int(ends[-1]))]
                starts = ends - lengths
                each = [ids[s:e] for s, e in zip(starts, ends, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(b["doc_ids"], pa.int64()), pa.array(starts + b["base"] + b["start"], pa.int64()),
                     pa.array(lengths, pa.int64()), make(each)], names=["doc_id", "start", "n_tokens", "made"])

    return _blocks(spark, path).mapInArrow(run, f"doc_id long, start long, n_tokens long, made {schema}")


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """Rows ``doc_id, start, n_tokens, ids`` decoded from the file set."""
    def arrays(each):
        return pa.array(each, pa.list_(pa.int32()))
    return _read(spark, path, "array<int>", arrays).withColumnRenamed("made", "ids")


def token_file_digests(spark: SparkSession, path: str) -> DataFrame:
    """Rows ``doc_id, start, n_tokens, ids_crc32`` decoded from the file set."""
    def crc(each):
        return pa.array([zlib.crc32(x.tobytes()) for x in each], pa.int64())
    return _read(spark, path, "long", crc).withColumnRenamed("made", "ids_crc32")


def encode_documents(docs: DataFrame, tokenizer_file: str, path: str | None = None) -> DataFrame:
    """Write the file set (to a folder beside the checkpoints unless ``path`` is given), read it
    back and return its digests, one row per document. No rows give no rows."""
    spark = docs.sparkSession
    if path is None:
        path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm/token-files-{uuid.uuid4().hex}"
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(folder)
    write_token_files(docs, path, tokenizer_file)
    return token_file_digests(spark, path)


def word_bpe() -> str:
    import public_tokenizers
    return str(public_tokenizers.path("word_bpe_49k.json"))


def op7_token_files(spark, sf_dir):
    """Contract digest of the file set of all documents."""
    return encode_documents(table(spark, sf_dir, "documents"), word_bpe())
