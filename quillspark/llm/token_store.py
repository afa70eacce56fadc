"""Token ids in a content-addressed store.

Texts are encoded with a public tokenizer file and an end id.  A rolling hash over 16 ids cuts
each id stream into chunks where the content says so, so copies and shared passages give equal
chunks.  The store holds each distinct chunk once under its hash; a document's recipe lists its
chunk hashes, and Merkle roots over chunks, documents and parts verify what is read back.

Layout under the store's path:
  chunks/    Parquet (hash, data, uid, doc_id, seq, n, after): one row for each use of a chunk; data, a
             zstd frame of little-endian unsigned 16- or 32-bit ids, is in one of a hash's rows only
  recipes/   Parquet in ascending id order (part, doc_id, start_in_part, n_tokens, root, chunks)
  manifest/  Parquet (part, start, n_docs, n_tokens, root, store_root): first id number, counts and Merkle
             root of each part, and in every row the root over all parts

Uses of a chunk that many documents share stay where they are and meet its check by broadcast.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import OrderedDict
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.llm import textvec as tv
from quillspark.llm.common import heavy_keys, scratch_path, shuffle_partitions, written

END_ID = 0
WINDOW = 16
#: A chunk ends where the rolling hash has so many zero bits, within these lengths in ids.
MASK_BITS, LEAST, MOST = 9, 256, 2048
#: Pieces of text whose ids a worker remembers, and chunks it remembers having sent.
REMEMBERED, SENT = 500_000, 50_000
#: Bytes of text that are cut and looked up at once.
STEP_BYTES = 512 << 10
_U = np.uint64

# Latin letters up to U+024F, an apostrophe among them included: with the space before it such a
# word is cut off by the byte-level pattern on both sides, whatever stands around it, but for other
# letters and for an apostrophe that begins a pre-token.  Of other white space the last one before a
# word is a pre-token of its own.
_LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
_ODD = re.compile(f"[^\\W\\d_{_LETTERS}]|[^\\x00-\\x7f\\w\\s](?=[{_LETTERS}])|(?<![{_LETTERS}])'(?=[{_LETTERS}])")
#: A byte that UTF-8 never has: it parts texts that are cut together.
_BREAK = 0xFF
_ASCII_LETTER = np.array([chr(b).isalpha() and b < 128 for b in range(256)])
_LAST_WHITE = np.isin(np.arange(256), [0x80, 0x85, 0x9F, 0xA0, 0xA8, 0xA9, 0xAF, *range(0x81, 0x8B)])


def _cut(data: np.ndarray) -> np.ndarray:
    """Starts of the pieces of texts that :data:`_ODD` doesn't find; ``data`` begins with three breaks
    and has one behind each text.

    Pieces are words with the space before them, the last other white space before a word, breaks,
    and whatever stands between these."""
    lead = np.flatnonzero((data >= 0xC3) & (data <= 0xC9))
    sign = (data[lead] == 0xC3) & ((data[lead + 1] == 0x97) | (data[lead + 1] == 0xB7))  # times, division
    inside = _ASCII_LETTER[data]
    inside[lead[~sign]] = inside[lead[~sign] + 1] = True
    marks = np.flatnonzero(data == 0x27)
    inside[marks[inside[marks - 1] & inside[np.minimum(marks + 1, len(data) - 1)]]] = True
    edge = np.diff(inside.astype(np.int8))
    begin, end = np.flatnonzero(edge == 1) + 1, np.flatnonzero(edge == -1) + 1
    starts = np.zeros(len(data) + 1, bool)
    starts[end] = True
    before = data[begin - 1]
    spaced = before == 0x20
    starts[begin - spaced] = True
    starts[begin[(before >= 9) & (before <= 13)] - 1] = True
    wide = begin[_LAST_WHITE[before]]
    one, two, three = data[wide - 1], data[wide - 2], data[wide - 3]
    starts[wide[(two == 0xC2) & ((one == 0x85) | (one == 0xA0))] - 2] = True
    general = (three == 0xE2) & (two == 0x80) & ((one <= 0x8A) | (one == 0xA8) | (one == 0xA9) | (one == 0xAF))
    rare = ((three == 0xE1) & (two == 0x9A) & (one == 0x80)) | ((three == 0xE2) & (two == 0x81) & (one == 0x9F)) | ((three == 0xE3) & (two == 0x80) & (one == 0x80))
    starts[wide[general | rare] - 3] = True
    breaks = np.flatnonzero(data == _BREAK)
    starts[breaks] = starts[breaks + 1] = True
    return np.flatnonzero(starts[: len(data)])


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the rest, in order, for
    characters from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: chr(b) if b in own else chr(256 + b - sum(x < b for x in own)) for b in range(256)}


class Encoder:
    """Encodes whole texts piece by piece; a piece seen before costs a look-up.

    As in a plain call of the tokenizer, the string of an added token in a text, such as
    ``<|endoftext|>``, is that token's id; a text that holds one is encoded as it stands.  Pieces are
    cut and hashed for many texts at once and looked up in an open hash table, by one 64-bit hash
    and checked by another; only new ones go to the tokenizer, single pre-tokens straight to its model.
    Beyond ``remembered`` pieces all are forgotten.
    """

    def __init__(self, path: str, remembered: int = REMEMBERED):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.model = self.tokenizer.model
        self.letters = _byte_letters()
        self.kind = np.dtype(np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32)
        self.remembered = remembered
        self._clear(1 << 12)

    def _clear(self, slots: int) -> None:
        """An empty table; of each slot the piece's hash (0 if it is free), its other hash, and where
        its ids are among all pieces' ids and how many."""
        self.mask, self.held = _U(slots - 1), 0
        self.key, self.other = np.zeros(slots, _U), np.zeros(slots, _U)
        self.at, self.n = np.zeros(slots, np.int64), np.zeros(slots, np.int32)
        self.ids, self.n_ids = np.zeros(1 << 12, self.kind), 0

    def _find(self, key: np.ndarray) -> np.ndarray:
        """Each hash's slot, or the free one where its search ends."""
        slot = (key & self.mask).astype(np.int64)
        going = np.flatnonzero((self.key[slot] != key) & (self.key[slot] != 0))
        while len(going):
            slot[going] = (slot[going] + 1) & int(self.mask)
            held = self.key[slot[going]]
            going = going[(held != key[going]) & (held != 0)]
        return slot

    def _put(self, key: np.ndarray, other: np.ndarray, at: np.ndarray, n: np.ndarray) -> None:
        """Adds distinct hashes that aren't there."""
        left = np.arange(len(key))
        while len(left):
            slot = self._find(key[left])
            own, first = np.unique(slot, return_index=True)  # of those that end at one slot the first gets it
            done = left[first]
            self.key[own], self.other[own], self.at[own], self.n[own] = key[done], other[done], at[done], n[done]
            left = np.delete(left, first)
        self.held += len(key)

    def _plain(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind)

    def _piece(self, piece: str) -> list[int]:
        word = piece[1:] if piece[0] == " " else piece
        if not word.isalpha():
            return self.tokenizer.encode(piece, add_special_tokens=False).ids
        if not word.isascii():  # one pre-token, as the following
            piece = piece.encode().decode("latin-1").translate(self.letters)
        elif word is not piece:
            piece = "\u0120" + word
        return [t.id for t in self.model.tokenize(piece)]

    def _learn(self, key: np.ndarray, other: np.ndarray, pieces: list[bytes]) -> None:
        """Adds pieces of new hashes."""
        lists = [[] if p[0] == _BREAK else self._piece(p.decode()) for p in pieces]
        n = np.fromiter(map(len, lists), np.int64, len(lists))
        total = int(n.sum())
        while self.n_ids + total > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.n_ids : self.n_ids + total] = np.fromiter(chain.from_iterable(lists), self.kind, total)
        first = self.n_ids + np.cumsum(n) - n
        self.n_ids += total
        if 2 * (self.held + len(key)) > len(self.key):  # at most half of the slots are taken
            full = np.flatnonzero(self.key)
            old = self.key[full], self.other[full], self.at[full], self.n[full]
            slots = len(self.key)
            while 2 * (self.held + len(key)) > slots:
                slots *= 2
            ids, n_ids = self.ids, self.n_ids
            self._clear(slots)
            self.ids, self.n_ids = ids, n_ids
            self._put(*old)
        self._put(key, other, first, n)

    def _by_piece(self, texts: list[str]) -> list[np.ndarray | None]:
        """Ids of texts without odd characters; None for one with a piece whose hash is another's."""
        if self.held > self.remembered:
            self._clear(1 << 12)
        mark = bytes([_BREAK])
        data = np.frombuffer(3 * mark + b"".join(t.encode() + mark for t in texts), np.uint8)
        start = _cut(data)
        size = np.diff(np.append(start, len(data)))
        place = np.arange(len(data), dtype=np.int32) - np.repeat(start.astype(np.int32), size)
        with np.errstate(over="ignore"):
            part = tv._BYTE[data] * tv.powers(int(size.max()) + 1)[place]
            key = np.maximum(tv.mix(np.add.reduceat(part, start) + size.astype(_U)), _U(1))
            other = np.add.reduceat(part ^ (part >> _U(29)), start)
        slot = self._find(key)
        new = np.flatnonzero(self.key[slot] == 0)
        if len(new):
            known, first = np.unique(key[new], return_index=True)
            where = new[first]
            self._learn(known, other[where], [data[a : a + n].tobytes() for a, n in zip(start[where].tolist(), size[where].tolist())])
            slot = self._find(key)
        n = self.n[slot].astype(np.int64)
        ends = np.cumsum(n)
        ids = self.ids[np.repeat(self.at[slot] - (ends - n), n) + np.arange(int(ends[-1]))]
        close = ends[np.flatnonzero(data[start] == _BREAK)[2:]]  # ids up to each break behind a text
        out: list[np.ndarray | None] = [ids[a:b] for a, b in zip(close[:-1].tolist(), close[1:].tolist())]
        strange = np.flatnonzero(self.other[slot] != other)
        if len(strange):
            row = np.cumsum(data == _BREAK)[start[strange]] - 3
            for i in np.unique(row).tolist():
                out[i] = None
        return out

    def _odd(self, texts: list[str]) -> list[bool]:
        """Which texts are encoded as they stand.  Only those with a byte beyond ASCII that isn't of a
        Latin letter, or an apostrophe before a letter but not behind one, need a closer look."""
        mark = bytes([_BREAK])
        data = np.frombuffer(b"".join(t.encode() + mark for t in texts) + mark, np.uint8)
        lead = (data >= 0xC3) & (data <= 0xC8)
        plain = (data < 0x80) | lead
        plain[1:] |= lead[:-1]
        letter = _ASCII_LETTER[data] | ((data >= 0x80) & (data != _BREAK))
        marks = np.flatnonzero(data == 0x27)
        plain[marks[letter[marks + 1] & ~letter[marks - 1]]] = False
        marks = np.flatnonzero((data == 0xC3) & np.append((data[1:] == 0x97) | (data[1:] == 0xB7), False))
        plain[marks] = False
        breaks = data == _BREAK
        plain |= breaks
        looked = np.zeros(len(texts) + 1, bool)
        looked[np.searchsorted(np.flatnonzero(breaks), np.flatnonzero(~plain))] = True
        return [bool(near and _ODD.search(t)) or any(x in t for x in self.added) for t, near in zip(texts, looked.tolist())]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, as ``tokenizer.encode(text, add_special_tokens=False)`` gives them; a text
        with characters that the cutting isn't sure of is encoded as it stands."""
        odd = self._odd(texts)
        sure = [t for t, x in zip(texts, odd) if not x]
        found = iter(self._by_piece(sure) if sure else ())
        out = [None if x else next(found) for x in odd]
        return [self._plain(t) if x is None else x for t, x in zip(texts, out)]


def marks_of(ids: np.ndarray) -> np.ndarray:
    """Whether a chunk may end behind each id: a hash of the 16 ids up to it says so.  Streams may
    stand one behind the other, as no chunk ends within its first ids."""
    roll = _id_hashes()[ids] if ids.dtype == np.dtype("<u2") else tv.mix(ids.astype(_U) + _U(1))
    span = 1
    while span < WINDOW:  # each step doubles the ids that a hash covers
        wide = roll.copy()
        wide[span:] += roll[:-span] * tv.powers(WINDOW + 1)[span]
        roll, span = wide, 2 * span
    return (tv.mix(roll) >> _U(64 - MASK_BITS)) == 0


@lru_cache(maxsize=1)
def _id_hashes() -> np.ndarray:
    return tv.mix(np.arange(1, (1 << 16) + 1, dtype=_U))


def boundaries(n: int, marks: np.ndarray) -> list[int]:
    """Ends of the chunks of a stream of ``n`` ids, from the sorted places behind its marks."""
    out, at = [], 0
    while n - at > LEAST:
        k = np.searchsorted(marks, at + LEAST)
        end = int(marks[k]) if k < len(marks) else n
        at = min(end, at + MOST, n)
        out.append(at)
    if at < n:
        out.append(n)
    return out


def chunk_hash(ids: np.ndarray) -> bytes:
    return hashlib.blake2b(ids.astype("<u4").tobytes(), digest_size=16).digest()


def merkle(leaves: list[bytes]) -> bytes:
    """Root of a binary hash tree; a level's odd node moves up as it is."""
    level = [hashlib.blake2b(b"\0" + x, digest_size=16).digest() for x in leaves] or [hashlib.blake2b(b"", digest_size=16).digest()]
    while len(level) > 1:
        up = [hashlib.blake2b(b"\1" + a + b, digest_size=16).digest() for a, b in zip(level[::2], level[1::2])]
        level = up + level[len(level) & ~1 :]
    return level[0]


def pack(ids: np.ndarray, press) -> bytes:
    """One byte that says how wide ids are, then their zstd frame."""
    small = not len(ids) or int(ids.max()) < 1 << 16
    return (b"\2" if small else b"\4") + press.compress(ids.astype("<u2" if small else "<u4").tobytes())


def unpack(data: bytes) -> np.ndarray:
    raw = zstandard.ZstdDecompressor().decompress(data[1:])
    return np.frombuffer(raw, "<u2" if data[:1] == b"\2" else "<u4").astype("<u4")


@lru_cache(maxsize=2)
def _encoder(path: str) -> Encoder:
    """One for each worker process: tasks that follow each other share what it remembers."""
    return Encoder(path)


def _encode(tokenizer: str):
    """Chunk rows; a chunk's data goes along only the first time that a task meets its hash."""

    def run(batches):
        encoder, press, sent = _encoder(tokenizer), zstandard.ZstdCompressor(level=1), OrderedDict()
        for batch in batches:
            _, offsets = tv.buffers(batch.column(2))
            for lo, hi in tv.cuts(offsets, STEP_BYTES):
                texts = batch.column(2).slice(lo, hi - lo).to_pylist()
                uids, docs = (batch.column(i).slice(lo, hi - lo).to_pylist() for i in (0, 1))
                rows, at = [], 0
                streams = [np.append(x, np.array([END_ID], x.dtype)) for x in encoder.encode([t or "" for t in texts])]
                marks = np.flatnonzero(marks_of(np.concatenate(streams))) + 1
                for uid, doc, ids in zip(uids, docs, streams):
                    own = np.searchsorted(marks, [at, at + len(ids)], "right")
                    ends = boundaries(len(ids), marks[own[0] : own[1]] - at)
                    at += len(ids)
                    for seq, (a, b) in enumerate(zip([0, *ends], ends)):
                        part = ids[a:b]
                        h = chunk_hash(part)
                        data = None
                        if h not in sent:
                            data = pack(part, press)
                            sent[h] = None
                            if len(sent) > SENT:
                                sent.popitem(last=False)
                        else:
                            sent.move_to_end(h)
                        rows.append((uid, doc, seq, b - a, len(ids) - b, h, data))
                cols = list(zip(*rows))
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["uid", "doc_id", "seq", "n", "after", "hash", "data"])

    return run


_CHUNK = "uid bigint, doc_id bigint, seq int, n bigint, after bigint, hash binary, data binary"


def _hash_lists(chunks: pa.Array) -> list[list[bytes]]:
    """The chunk hashes of each recipe."""
    flat = chunks.flatten().field("hash").to_pylist()
    ends = np.cumsum(pc.list_value_length(chunks).to_numpy()).tolist()
    return [flat[a:b] for a, b in zip([0, *ends], ends)]


def _number(batches):
    """Running token counts within a part, and each recipe's Merkle root."""
    total = 0
    for batch in batches:
        n = np.array(batch.column(2).to_pylist(), np.int64)
        start = total + np.cumsum(n) - n
        total += int(n.sum())
        roots = [merkle(hashes) for hashes in _hash_lists(batch.column(3))]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(start), batch.column(2), pa.array(roots, pa.binary()), batch.column(3)], ["part", "doc_id", "start_in_part", "n_tokens", "root", "chunks"])


def write(docs: DataFrame, path: str, tokenizer: str, *, doc_id: str = "doc_id", text: str = "text") -> None:
    """Encode every whole text and write the store.

    Null texts count as empty: one chunk with the end id.  Null ids sort first; rows that repeat
    an id are documents of their own, in the order of their place in the input.  Texts are
    encoded once and chunk data is shuffled once.
    """
    spark = docs.sparkSession
    n = shuffle_partitions(spark)
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    chunks = rows.mapInArrow(_encode(tokenizer), _CHUNK)
    # A row without data may go anywhere, so a chunk that a third of all documents share is spread.
    place = F.when(F.col("data").isNull(), F.xxhash64("uid", "seq")).otherwise(F.xxhash64("hash"))
    first = F.row_number().over(Window.partitionBy("place", "hash").orderBy("uid", "seq")) == 1
    dealt = chunks.withColumn("place", place).repartition(n, "place").withColumn("data", F.when(first, F.col("data"))).drop("place")
    dealt.write.parquet(f"{path}/chunks")
    staged = spark.read.schema(_CHUNK).parquet(f"{path}/chunks")
    recipes = staged.drop("data").groupBy("uid", "doc_id").agg(F.sum("n").alias("n_tokens"), F.sort_array(F.collect_list(F.struct("seq", "hash", "n", "after"))).alias("chunks"))
    recipes = recipes.repartitionByRange(n, "doc_id", "uid").sortWithinPartitions("doc_id", "uid")
    recipes = recipes.select(F.spark_partition_id().alias("part"), "doc_id", "n_tokens", "chunks")
    recipes.mapInArrow(_number, _RECIPE).write.parquet(f"{path}/recipes")
    starts, at, parts = [], 0, _parts(spark, path)
    top = merkle([p[3] for p in parts])
    for part, n_docs, n_tokens, root in parts:
        starts.append((part, at, n_docs, n_tokens, root, top))
        at += n_tokens
    spark.createDataFrame(starts, _MANIFEST).coalesce(1).write.parquet(f"{path}/manifest")


_MANIFEST = "part int, start bigint, n_docs bigint, n_tokens bigint, root binary, store_root binary"
_RECIPE = "part int, doc_id bigint, start_in_part bigint, n_tokens bigint, root binary, chunks array<struct<seq:int,hash:binary,n:bigint,after:bigint>>"


def _parts(spark: SparkSession, path: str) -> list[tuple[int, int, int, bytes]]:
    """(part, documents, tokens, root) of the recipes as they lie there, one row for each part."""
    named = spark.read.schema(_RECIPE).parquet(f"{path}/recipes").select("part", "n_tokens", "root", "start_in_part")
    parts = named.groupBy("part").applyInArrow(_whole, "part int, n_docs bigint, n_tokens bigint, root binary")
    return sorted((r.part, r.n_docs, r.n_tokens, bytes(r.root)) for r in parts.collect())


def verify_manifest(spark: SparkSession, path: str) -> None:
    """Fails unless the manifest agrees with itself and every part of the recipes, its documents,
    tokens and root, is as the manifest says: a lost or altered file of either is named."""
    rows = sorted(spark.read.schema(_MANIFEST).parquet(f"{path}/manifest").collect(), key=lambda r: r.part)  # one row for each part
    top, at = merkle([bytes(r.root) for r in rows]), 0
    for r in rows:
        if bytes(r.store_root) != top or r.start != at:
            raise ValueError(f"the manifest of {path} is unsound")
        at += r.n_tokens
    there = {p[0]: p[1:] for p in _parts(spark, path)}
    wrong = sorted({r.part for r in rows if there.get(r.part) != (r.n_docs, r.n_tokens, bytes(r.root))} | there.keys() - {r.part for r in rows})
    if wrong:
        raise ValueError(f"parts {wrong} of the recipes of {path} are missing or unsound")


def _whole(table: pa.Table) -> pa.Table:
    """Root, documents and tokens of one part, whose size is that of a partition."""
    table = table.sort_by("start_in_part")
    tokens = table.column("n_tokens").to_pylist()
    return pa.table({"part": pa.array([table.column("part")[0].as_py()], pa.int32()), "n_docs": pa.array([len(tokens)], pa.int64()), "n_tokens": pa.array([sum(tokens)], pa.int64()), "root": pa.array([merkle(table.column("root").to_pylist())], pa.binary())})


def _chunks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_CHUNK).parquet(f"{path}/chunks").where("data is not null").select("hash", "data")


_POLY = 0xEDB88320


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of CRC-32 polynomials in bit-reversed form."""
    out = np.zeros(np.broadcast(a, b).shape, np.uint32)
    b = np.broadcast_to(b, out.shape).astype(np.uint32)
    for k in range(31, -1, -1):
        out ^= np.where((a >> np.uint32(k)) & np.uint32(1), b, np.uint32(0)).astype(np.uint32)
        b = np.where(b & np.uint32(1), (b >> np.uint32(1)) ^ np.uint32(_POLY), b >> np.uint32(1)).astype(np.uint32)
    return out


def moved(crc: np.ndarray, after: np.ndarray) -> np.ndarray:
    """What a chunk's CRC-32 adds to that of a stream with ``after`` bytes behind the chunk."""
    out, square, after = np.asarray(crc, np.uint32), np.array([1 << 23], np.uint32), np.asarray(after, np.int64)  # x^8
    while after.any():
        odd = (after & 1).astype(bool)
        if odd.any():
            out = out.copy()
            out[odd] = _times(out[odd], square)
        after = after >> 1
        square = _times(square, square)
    return out


def _check(batches):
    """From each stored chunk's bytes: whether they have their hash, and their CRC-32."""
    for batch in batches:
        hashes = batch.column(0).to_pylist()
        ids = [unpack(d) for d in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([chunk_hash(x) == h for x, h in zip(ids, hashes)]), pa.array([len(x) for x in ids], pa.int64()), pa.array([zlib.crc32(x.tobytes()) for x in ids], pa.int64())],
            ["hash", "sound", "stored", "crc"],
        )


def _placed(batches):
    for batch in batches:
        crc = np.array(batch.column(4).to_pylist(), np.int64).astype(np.uint32)
        after = np.array(batch.column(5).to_pylist(), np.int64) * 4
        yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(4)), pa.array(moved(crc, after).astype(np.int64))], ["start", "doc_id", "sound", "n", "crc"])


def _roots(batches):
    for batch in batches:
        good = [merkle(hashes) == root for root, hashes in zip(batch.column(4).to_pylist(), _hash_lists(batch.column(5)))]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), batch.column(3), pa.array(good, pa.bool_()), batch.column(5)], ["part", "doc_id", "start_in_part", "n_tokens", "whole", "chunks"])


def _recipes(spark: SparkSession, path: str) -> DataFrame:
    """Recipes with their starts over the whole store, and whether their roots hold."""
    verify_manifest(spark, path)
    recipes = spark.read.schema(_RECIPE).parquet(f"{path}/recipes")
    checked = recipes.mapInArrow(_roots, recipes.withColumn("whole", F.lit(True)).select("part", "doc_id", "start_in_part", "n_tokens", "whole", "chunks").schema)
    manifest = spark.read.schema(_MANIFEST).parquet(f"{path}/manifest").select("part", F.col("start").alias("part_start"))
    return checked.join(F.broadcast(manifest), "part").withColumn("start", F.col("part_start") + F.col("start_in_part")).drop("part", "part_start", "start_in_part")


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, verified) of each document, from the files.

    Recipes and manifest that disagree fail the read; a document with an unsound or missing chunk
    isn't verified.  Chunk bytes are read where they lie and checked against their hash; the CRCs of a document's
    chunks, moved to their places, sum to that of its stream, so only small rows are shuffled.
    """
    recipes = _recipes(spark, path)
    uses = recipes.select("start", "doc_id", "whole", F.explode("chunks").alias("c")).select("start", "doc_id", "whole", "c.hash", "c.n", "c.after")
    checked = "hash binary, sound boolean, stored bigint, crc bigint"
    counts = spark.read.schema(_RECIPE).parquet(f"{path}/recipes").select(F.explode("chunks.hash").alias("hash")).groupBy("hash").agg(F.count("*").alias("n"))
    heavy = heavy_keys(counts, "hash")
    chunks = _chunks(spark, path)
    if heavy is None:
        both = uses.join(chunks.mapInArrow(_check, checked), "hash", "left")
    else:
        heavy = written(heavy, "heavy")
        few = F.broadcast(heavy)
        hot = chunks.join(few, "hash", "left_semi").mapInArrow(_check, checked)
        rest = chunks.join(few, "hash", "left_anti").mapInArrow(_check, checked)
        both = uses.join(few, "hash", "left_semi").join(F.broadcast(hot), "hash", "left").unionByName(uses.join(few, "hash", "left_anti").join(rest, "hash", "left"))
    met = both.select(
        "start", "doc_id", F.coalesce(F.col("whole") & F.col("sound") & (F.col("stored") == F.col("n")), F.lit(False)).alias("sound"), F.coalesce("stored", F.lit(0)).alias("n"),
        F.coalesce("crc", F.lit(0)).alias("crc"), "after",
    )
    placed = met.mapInArrow(_placed, "start bigint, doc_id bigint, sound boolean, n bigint, crc bigint")
    return placed.groupBy("start", "doc_id").agg(F.sum("n").alias("n_tokens"), F.bit_xor("crc").alias("ids_crc32"), F.min("sound").alias("verified")).select("doc_id", "start", "n_tokens", "ids_crc32", "verified")


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, ids): every document's ids rebuilt from recipe and chunks, end id included.
    An unsound or missing chunk fails the read."""
    uses = _recipes(spark, path).select("doc_id", "start", F.explode("chunks").alias("c")).select("doc_id", "start", "c.seq", "c.hash")
    parts = uses.join(_chunks(spark, path), "hash", "left").groupBy("doc_id", "start").agg(F.sort_array(F.collect_list(F.struct("seq", "hash", F.coalesce("data", F.lit(b"")).alias("data")))).alias("parts"))

    def run(batches):
        for batch in batches:
            out = []
            for parts in batch.column(2).to_pylist():
                ids = [unpack(p["data"]) if p["data"] else np.zeros(0, "<u4") for p in parts]
                for p, x in zip(parts, ids):
                    if chunk_hash(x) != p["hash"]:
                        raise ValueError(f"chunk {p['hash'].hex()} is missing or unsound")
                out.append(np.concatenate(ids).astype(np.int64).tolist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.int64()))], ["doc_id", "start", "ids"])

    return parts.mapInArrow(run, "doc_id bigint, start bigint, ids array<bigint>")


def round_trip(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Write a store in the shared folder and digest what is read back.

    One row for each row of ``docs``: a null text is empty and has the end id alone, null ids sort
    first, rows that repeat an id come in input order; other columns are left out; an empty table
    gives no rows."""
    path = scratch_path(docs.sparkSession, "store")
    write(docs, path, tokenizer)
    return read_digests(docs.sparkSession, path)
