"""Token ids as length-delimited binary records.

Every shard is a run of frames: length (uint64), masked checksum of the length (uint32), payload,
masked checksum of the payload (uint32), little endian. The payload is the doc_id (int64) and the ids
(uint16 where the vocabulary fits, else uint32). The checksum is CRC-32, rotated and offset as
mask() says. Beside each shard lies an index of (doc_id, offset, length), so rows can be read in any
order; the DataFrame returned is that index of all shards.

A task writes its shard under a name of its own and then gives it the name of its partition and bytes. A task that
runs twice, or whose executor is lost, so leaves the same file or, where its rows came in another order, another one:
the index knows whose rows count, and files that it doesn't name are deleted when it is complete. The vocabulary is
read on the driver and sent along.

Defined results: a null or empty text has a frame without ids (null: n_tokens is null). A null doc_id
is framed as -1 and stays null in the index. Repeated rows get a frame each. Empty tables give an
empty index. Other columns are left out. No text is cut short.
"""

from __future__ import annotations

import base64
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
import regex
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import units
from .shared import materialize, shared_dir, text_chunks, tidied, workers

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CHUNK = 1 << 20
SCHEMA = "doc_id long, shard string, offset long, length long, n_tokens int, checksum long"
_ODD = regex.compile(r"[^\S \n]|\s\s|\s$")
_LEADS = np.zeros(256, bool)
_LEADS[[9, 11, 12, 13, 28, 29, 30, 31, 0xC2, 0xE1, 0xE2, 0xE3]] = True


def mask(crc: int) -> int:
    return (((crc >> 15) | (crc << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    head = struct.pack("<Q", len(payload))
    return head + struct.pack("<I", mask(zlib.crc32(head))) + payload + struct.pack("<I", mask(zlib.crc32(payload)))


def unframe(raw: bytes, at: int = 0):
    """(payload, place of the next frame); raises ValueError where a checksum is wrong."""
    head = raw[at : at + 8]
    (n,), (c,) = struct.unpack("<Q", head), struct.unpack("<I", raw[at + 8 : at + 12])
    if mask(zlib.crc32(head)) != c:
        raise ValueError(f"length checksum at {at}")
    payload = raw[at + 12 : at + 12 + n]
    if len(payload) != n or mask(zlib.crc32(payload)) != struct.unpack("<I", raw[at + 12 + n : at + 16 + n])[0]:
        raise ValueError(f"payload checksum at {at}")
    return payload, at + 16 + n


def read_payload(payload: bytes, dtype):
    return struct.unpack("<q", payload[:8])[0], np.frombuffer(payload[8:], dtype)


def read_vocabulary(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


class Encoder:
    def __init__(self, vocabulary: bytes):
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
        self.bpe = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.newline = ranks[b"\n"]
        self.dtype = np.uint16 if max(ranks.values()) < 1 << 16 else np.uint32
        self.cache = units.Cache(self._units, self.dtype)

    def _units(self, items):
        """Distinct units, encoded in one call with line ends between them, which are tokens of their own."""
        out = [np.array([self.newline]) if w == b"\n" else None for w, _ in items]
        todo = [i for i, x in enumerate(out) if x is None]
        if todo:
            flat = np.array(self.bpe.encode_ordinary("\n".join(items[i][0].decode(errors="replace") for i in todo)), np.int64)
            cut = np.flatnonzero(flat == self.newline)
            for i, a, b in zip(todo, np.append(0, cut + 1), np.append(cut, len(flat))):
                out[i] = flat[a:b]
        return out

    def rows(self, data, offsets):
        """ids of each row. Rows whose white space isn't single blanks and single line ends inside the
        text go through the tokenizer whole, since there a blank may belong to either side."""
        raw = data.tobytes()
        special = _LEADS[data]
        white = (data == 32) | (data == 10)
        end = offsets[1:] - 1
        double = np.zeros(len(data), bool)
        double[:-1] = white[:-1] & white[1:]
        hits = np.append(0, np.cumsum(special | double))
        odd = hits[offsets[1:]] > hits[offsets[:-1]]
        full = offsets[1:] > offsets[:-1]
        odd[full] |= white[end[full]]
        start, stop, kind, row = units.cut(data, offsets, False)
        plain = ~odd[row]
        flat, n = self.cache.ids(data, start[plain], stop[plain], kind[plain])
        at = np.append(0, np.cumsum(np.bincount(row[plain], weights=n, minlength=len(offsets) - 1).astype(np.int64)))
        for r in range(len(offsets) - 1):
            if odd[r]:
                text = raw[offsets[r] : offsets[r + 1]].decode()
                if _ODD.search(text):
                    yield np.array(self.bpe.encode_ordinary(text), self.dtype)
                else:
                    one = np.array([0, len(text.encode())])
                    d = data[offsets[r] : offsets[r + 1]]
                    s, e, k, _ = units.cut(d, one, False)
                    yield self.cache.ids(d, s, e, k)[0]
            else:
                yield flat[at[r] : at[r + 1]]


_encoders: dict = {}


def _publish(store, own: str, final: str):
    """Give a file its name; where the same task left the same file before, that one stays."""
    there = lambda: store.get_file_info(final).type != fs.FileType.NotFound
    if not there():
        try:
            return store.move(own, final)
        except OSError:
            if not there():
                raise
    store.delete_file(own)


def _remove(store, *paths):
    for path in paths:
        if store.get_file_info(path).type != fs.FileType.NotFound:
            store.delete_file(path)


def _shards(folder: str):
    """The store, and the paths of all files of shards in the folder."""
    store, root = fs.FileSystem.from_uri(folder)
    return store, [f.path for f in store.get_file_info(fs.FileSelector(root, allow_not_found=True)) if f.base_name.lstrip(".").startswith("part-")]


def _write(folder: str, vocabulary):
    def run(batches):
        if vocabulary.value not in _encoders:
            _encoders[vocabulary.value] = Encoder(vocabulary.value)
        coder = _encoders[vocabulary.value]
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root)
        name = f"part-{TaskContext.get().partitionId():06d}"
        own = f"{root}/.{name}-{uuid.uuid4().hex}"
        at, whole, rows = 0, 0, []
        try:
            with store.open_output_stream(own + ".records") as out:
                for batch in batches:
                    doc, text = batch.column(0), batch.column(1)
                    null = np.asarray(text.is_null())
                    for lo, hi, data, offsets in text_chunks(text, CHUNK):
                        part, begin, length, count, sums = [], [], [], [], []
                        for d, ids in zip(doc.slice(lo, hi - lo).to_pylist(), coder.rows(data, offsets)):
                            payload = struct.pack("<q", -1 if d is None else d) + ids.tobytes()
                            piece = frame(payload)
                            part.append(piece)
                            begin.append(at)
                            length.append(len(piece))
                            count.append(len(ids))
                            sums.append(mask(zlib.crc32(payload)))
                            at += len(piece)
                        block = b"".join(part)
                        whole = zlib.crc32(block, whole)
                        out.write(block)
                        rows.append([doc.slice(lo, hi - lo), pa.array(begin), pa.array(length), pa.array(np.array(count, np.int32), mask=null[lo:hi]), pa.array(sums, pa.int64())])
            if not rows:
                store.delete_file(own + ".records")
                return
            name = f"{name}-{whole:08x}"
            indexes = [pa.RecordBatch.from_arrays([x[0], pa.array([f"{name}.records"] * len(x[0])), *x[1:]], names=["doc_id", "shard", "offset", "length", "n_tokens", "checksum"]) for x in rows]
            with store.open_output_stream(own + ".index") as out, pa.ipc.new_stream(out, indexes[0].schema) as w:
                for index in indexes:
                    w.write_batch(index)
            for kind in (".records", ".index"):
                _publish(store, own + kind, f"{root}/{name}{kind}")
        except BaseException:
            _remove(store, own + ".records", own + ".index")
            raise
        yield from indexes

    return run


def write_token_records(docs: DataFrame, folder: str | None = None, vocabulary: str = VOCABULARY) -> DataFrame:
    """Write the shards, once, and return their index; see the module for each edge case. folder: a URI that
    all executors reach and that holds no shards yet, by default a new one in the shared folder."""
    spark = workers(docs)
    folder = folder or f"{shared_dir(spark)}/records-{uuid.uuid4().hex}"
    if _shards(folder)[1]:
        raise ValueError(f"{folder} holds shards already")
    held = spark.sparkContext.broadcast(read_vocabulary(vocabulary))
    index = materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(tidied(_write(folder, held)), SCHEMA), "records-index")
    named = {r["shard"].removesuffix(".records") for r in index.select("shard").distinct().collect()}  # one for each task
    store, paths = _shards(folder)
    _remove(store, *[p for p in paths if p.rsplit("/", 1)[-1].rsplit(".", 1)[0] not in named])
    return index


def read_records(folder: str, shard: str, offsets, dtype=np.uint16):
    """Yield (doc_id, ids) of the frames at the given offsets, in the order given."""
    store, root = fs.FileSystem.from_uri(folder)
    with store.open_input_file(f"{root}/{shard}") as f:
        for at in offsets:
            f.seek(at)
            head = f.read(12)
            (n,) = struct.unpack("<Q", head[:8])
            yield read_payload(unframe(head + f.read(n + 4))[0], dtype)
