"""Token ids in bit-packed files.

Documents are dealt into ranges of doc_id, and each task writes the ids of its range to one file in the shared folder:

    b"TDPK", version, bits, ids in a block, documents, ids (little-endian, HEADER) | packed blocks |
    doc_id of each document, first id of each document | offset of each block | where the index begins

Every id takes the smallest number of bits that holds the vocabulary, so a block of BLOCK ids has a fixed number of
bytes, numpy unpacks it at once, and any document is read by its blocks alone. A task writes under a name of its own
and reports it; the manifest names one file for each range, so what a lost or repeated attempt left behind is ignored.

Null text is an empty text; each document ends with END. Documents stand in ascending (doc_id, text), null ids
first; repeated rows each stand there. An empty table makes no files and no rows.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidings.llm.common import shared_folder, written

END = 2
BLOCK = 1 << 15
HEADER = struct.Struct("<4sHHIQQ")


def pack(ids: np.ndarray, bits: int) -> bytes:
    """ids, lowest bit first, in bits bits each."""
    if bits == 16:
        return ids.astype("<u2").tobytes()
    spread = (ids.astype(np.uint64)[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)
    return np.packbits(spread.astype(np.uint8).reshape(-1), bitorder="little").tobytes()


def unpack(data: bytes, bits: int, n: int) -> np.ndarray:
    if bits == 16:
        return np.frombuffer(data, "<u2", n).astype(np.uint32)
    spread = np.unpackbits(np.frombuffer(data, np.uint8), count=n * bits, bitorder="little").reshape(n, bits)
    return (spread.astype(np.uint32) << np.arange(bits, dtype=np.uint32)).sum(axis=1, dtype=np.uint32)


def opened(path: str, mode: str):
    """A file of the shared folder: local paths as they are, others through pyarrow's file systems."""
    if "://" not in path.replace("file:///", "/") and not path.startswith("hdfs:"):
        path = re.sub(r"^file:(//)?", "", path)
        if "w" in mode:
            os.makedirs(os.path.dirname(path), exist_ok=True)
        return open(path, mode)
    from pyarrow import fs

    where, path = fs.FileSystem.from_uri(path)
    if "w" in mode:
        where.create_dir(os.path.dirname(path), recursive=True)
        return where.open_output_stream(path)
    return where.open_input_file(path)


class TokenWriter:
    def __init__(self, out, bits: int):
        self.out, self.bits, self.docs, self.starts, self.n = out, bits, [], [], 0
        self.held, self.held_n, self.offsets = [], 0, []
        out.write(bytes(HEADER.size))
        self.at = HEADER.size

    def add(self, doc_id: int, ids: np.ndarray) -> None:
        self.docs.append(doc_id)
        self.starts.append(self.n)
        self.n += len(ids)
        self.held.append(ids)
        self.held_n += len(ids)
        if self.held_n >= BLOCK:
            self.flush(self.held_n // BLOCK * BLOCK)

    def flush(self, n: int) -> None:
        ids = np.concatenate(self.held) if self.held else np.zeros(0, np.uint32)
        for a in range(0, n, BLOCK):
            data = pack(ids[a : min(a + BLOCK, n)], self.bits)
            self.offsets.append(self.at)
            self.out.write(data)
            self.at += len(data)
        self.held, self.held_n = [ids[n:]], len(ids) - n

    def close(self) -> None:
        self.flush(self.held_n)
        index = np.array(self.docs, "<i8").tobytes() + np.array(self.starts, "<i8").tobytes() + np.array(self.offsets, "<i8").tobytes()
        self.out.write(index + HEADER.pack(b"TDPK", 1, self.bits, BLOCK, len(self.docs), self.n) + struct.pack("<Q", self.at))
        self.out.close()


class TokenFile:
    """Random access: ids(k) of the k-th document, doc_ids, starts, total."""

    def __init__(self, source):
        self.source = source
        size = source.seek(0, 2)
        size = source.tell() if size is None else size
        source.seek(size - 8 - HEADER.size)
        tail = source.read(HEADER.size + 8)
        magic, _, self.bits, self.block, docs, self.total = HEADER.unpack(tail[: HEADER.size])
        if magic != b"TDPK":
            raise ValueError("not a token file")
        at = struct.unpack("<Q", tail[HEADER.size :])[0]
        source.seek(at)
        index = np.frombuffer(source.read(size - 8 - HEADER.size - at), "<i8")
        self.doc_ids, self.starts, self.offsets = index[:docs], np.r_[index[docs : 2 * docs], self.total], index[2 * docs :]
        self.held = (-1, np.zeros(0, np.uint32))

    def block_ids(self, k: int) -> np.ndarray:
        if self.held[0] != k:
            n = min(self.block, self.total - k * self.block)
            self.source.seek(int(self.offsets[k]))
            self.held = (k, unpack(self.source.read(-(-n * self.bits // 8)), self.bits, n))
        return self.held[1]

    def ids(self, k: int) -> np.ndarray:
        a, z = int(self.starts[k]), int(self.starts[k + 1])
        parts = [self.block_ids(b)[max(0, a - b * self.block) : z - b * self.block] for b in range(a // self.block, -(-z // self.block))]
        return np.concatenate(parts) if parts else np.zeros(0, np.uint32)


def breaks_at_spaces(tokenizer: dict) -> bool:
    """Whether a tokenizer (its JSON) is byte-level BPE with the usual splitting pattern, no normalizer, and no added token
    that has white space in it or takes some beside it."""
    model, pre = tokenizer.get("model") or {}, tokenizer.get("pre_tokenizer") or {}
    parts = pre.get("pretokenizers", [pre])
    plain = len(parts) == 1 and parts[0].get("type") == "ByteLevel" and parts[0].get("use_regex", True) and not parts[0].get("add_prefix_space")
    added = [a for a in tokenizer.get("added_tokens") or () if re.search(r"\s", a["content"]) or a.get("lstrip") or a.get("rstrip")]
    return bool(model.get("type") == "BPE" and plain and not tokenizer.get("normalizer") and not added and not model.get("dropout"))


class Encoder:
    """Whole texts to ids with the tokenizers library, each distinct chunk of a text once.

    A byte-level BPE whose splitting pattern always breaks before a space that stands before something else than white
    space lets a text be cut there: its chunks encoded on their own give the same ids. For any other tokenizer
    (see `breaks_at_spaces`) whole texts go to the library."""

    LIMIT, GLUED = 700_000, 32
    CUT = re.compile(r" (?=\S)")
    UNSAFE = re.compile(r" (?:\s|\Z)")

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.whole = not breaks_at_spaces(json.loads(self.lib.to_str()))
        vocab = self.lib.get_vocab(with_added_tokens=True)
        self.bits = max(1, int(max(vocab.values())).bit_length())
        self.bytes_of = np.zeros(max(vocab.values()) + 1, np.int64)
        for token, i in vocab.items():
            self.bytes_of[i] = len(token)
        self.known: dict[str, bytes] = {}

    def learn(self, chunks: list[str]) -> None:
        """Encodes chunks, GLUED to a text, and cuts the ids where the bytes of a chunk end."""
        if not chunks:
            return
        glued = [" " + " ".join(chunks[a : a + self.GLUED]) for a in range(0, len(chunks), self.GLUED)]
        ids = np.array([i for e in self.lib.encode_batch_fast(glued, add_special_tokens=False) for i in e.ids], "<u4")
        stops = np.cumsum([len(c.encode()) + 1 for c in chunks])
        reach = np.cumsum(self.bytes_of[ids])
        ends = np.searchsorted(reach, stops)
        if reach[-1] == stops[-1] and (reach[ends] == stops).all():
            raw, stop = ids.tobytes(), ((ends + 1) * 4).tolist()
            self.known.update((c, raw[a:z]) for c, a, z in zip(chunks, [0, *stop], stop))
        else:  # some text that the byte lengths can't follow (unknown bytes): one by one
            for c, one in zip(chunks, self.lib.encode_batch_fast([" " + c for c in chunks], add_special_tokens=False)):
                self.known[c] = np.array(one.ids, "<u4").tobytes()

    def encode(self, group: list[str]) -> list[np.ndarray]:
        if self.whole:
            return [np.array([*e.ids, END], "<u4") for e in self.lib.encode_batch(group, add_special_tokens=False)]
        if len(self.known) > self.LIMIT:
            self.known.clear()
        cut = [t.split(" ") if self.UNSAFE.search(t) is None else self.CUT.split(t) for t in group]
        firsts = self.lib.encode_batch([c[0] for c in cut], add_special_tokens=False)
        fresh = set()
        for c in cut:
            fresh.update(c[1:])
        self.learn(list(fresh.difference(self.known)))
        get = self.known.__getitem__
        end = np.array([END], "<u4").tobytes()
        return [np.frombuffer(b"".join([np.array(f.ids, "<u4").tobytes(), *map(get, c[1:]), end]), "<u4") for f, c in zip(firsts, cut)]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encoded(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Writes the files; the manifest: part, path, n_docs, n_ids, start (ids in the files before)."""
    tokenizer = tokenizer or default_tokenizer()
    folder = f"{shared_folder(docs.sparkSession)}/tokens-{uuid.uuid4().hex}"

    def run(batches):
        part = TaskContext.get().partitionId()
        path, writer = f"{folder}/{part:06d}-{uuid.uuid4().hex}.tdpk", None
        enc = encoder(tokenizer)
        for b in batches:
            for a in range(0, b.num_rows, 500):
                own = b.slice(a, 500)
                group = [t or "" for t in own.column(1).to_pylist()]
                for doc, ids in zip(own.column(0).to_pylist(), enc.encode(group)):
                    if writer is None:
                        writer = TokenWriter(opened(path, "wb"), enc.bits)
                    writer.add(NULL if doc is None else doc, ids)
        if writer is not None:
            writer.close()
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in ((part, pa.int32()), (path, pa.string()), (len(writer.docs), pa.int64()), (writer.n, pa.int64()))], names=["part", "path", "n_docs", "n_ids"])

    ordered = docs.select("doc_id", F.col("text").cast("string").alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    files = written(ordered.mapInArrow(run, "part int, path string, n_docs long, n_ids long"), "token-manifest")
    strays(folder, files)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each file
    return files.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def strays(folder: str, files: DataFrame) -> None:
    """Deletes files that the manifest does not name: what failed or repeated attempts of a task left behind. The driver sees a
    name for each file, of which a task writes one."""
    spark = files.sparkSession
    named = {r["path"].rsplit("/", 1)[-1] for r in files.select("path").collect()}
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    where = at.getFileSystem(spark._jsc.hadoopConfiguration())
    for status in where.listStatus(at) if where.exists(at) else ():
        if status.getPath().getName() not in named:
            where.delete(status.getPath(), True)


#: Stands for a null doc_id in a file.
NULL = -(1 << 63)


def read_back(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the files."""

    def run(batches):
        for b in batches:
            for path, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                with opened(path, "rb") as source:
                    f = TokenFile(source)
                    for a in range(0, len(f.doc_ids), 10_000):
                        some = range(a, min(a + 10_000, len(f.doc_ids)))
                        crc = [zlib.crc32(f.ids(k).astype("<u4").tobytes()) for k in some]
                        own = f.doc_ids[a : a + 10_000]
                        yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64(), mask=own == NULL), pa.array(start + f.starts[a : a + len(crc)]), pa.array(np.diff(f.starts[a : a + len(crc) + 1])), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    n = max(1, manifest.count())
    return manifest.select("path", "start").repartition(n).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_rows(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    return read_back(encoded(docs, tokenizer))
