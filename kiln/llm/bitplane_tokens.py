"""Token ids in bit-plane files.

Texts are encoded, ids are cut into blocks of a fixed number, the bytes (or bits) of a block are
transposed so that each plane holds the same byte (bit) of every id, and every plane is compressed with
zstandard on its own: the high planes are nearly constant and almost vanish.

File layout (little-endian)::

    b"KBP1" | block 0 | block 1 | ... | document index | chunk index | footer length (8 bytes) | b"KBP1"

A block is its planes, one zstandard frame each. The chunk index lists for every block its offset, its
number of ids and the sizes of its planes, so a reader can fetch any range of ids. The document index holds the
ids of the documents (with a flag for null) and where each one ends.

One Spark partition writes one file, holding a range of document ids. Files are written under a temporary
name and moved when complete; names and contents depend on the input and its cut into partitions alone, so a repeated task
replaces its file with the same bytes.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kiln.llm.common import materialise, small_batches, table
from kiln.llm.words import text_slices
from kiln.session import shared_dir

MAGIC = b"KBP1"
BLOCK_IDS = 1 << 16
#: Words in one generation of an encoder's memory (about 200 bytes each).
WORDS_KEPT = 300_000
LEVEL = 3


#: Words of these letters (lower case, composed) pass a lower-casing tokenizer's normaliser and splitter as they are.
_LETTERS = re.compile("[a-zß-öø-ÿ]+")


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class WordEncoder:
    """Ids of whole texts, equal to ``tokenizer.encode(text, add_special_tokens=False).ids`` for any vocabulary of the library.

    A tokenizer whose normaliser and splitter drop white space and never look across it (it lower-cases, and splits letters from
    marks) is used word by word: the text is cut at ASCII white space and every distinct word is encoded once; words are
    remembered in two generations, so that those in use outlive the others, and a word of plain letters, with or
    without full stops and commas after it, goes straight to the tokenizer's model. Every other tokenizer gets whole texts.
    """

    def __init__(self, vocabulary: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs one task per core
        from tokenizers import Tokenizer, pre_tokenizers

        if not os.path.isabs(vocabulary):
            import public_tokenizers

            vocabulary = public_tokenizers.path(vocabulary)
        self.tokenizer = Tokenizer.from_file(vocabulary)
        with open(vocabulary, encoding="utf-8") as f:
            parts = json.load(f)
        steps = lambda k, of: [x["type"] for x in (parts.get(k) or {}).get(of, [])]
        self.letters = (
            steps("normalizer", "normalizers") == ["NFC", "Replace", "Lowercase"]
            and steps("pre_tokenizer", "pretokenizers") == ["Split", "ByteLevel"]
            and "[\\p{L}]+" in parts["pre_tokenizer"]["pretokenizers"][0]["pattern"].get("Regex", "")
        )
        self.model = self.tokenizer.model
        spell = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.spelled = {chr(c): spell.pre_tokenize_str(chr(c))[0][0] for c in [*range(0xDF, 0x100)]}
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.tails: dict[bytes, bytes] = {b"": b""}

    def _whole(self, words: list[bytes]) -> list[bytes]:
        coded = self.tokenizer.encode_batch([w.decode("utf-8", "replace") for w in words], add_special_tokens=False)
        return [_packed(c.ids) for c in coded]

    def _learn(self, words: set[bytes]) -> None:
        rest = []
        for w in words:
            known = self.older.get(w)
            if known is None:
                bare = w.rstrip(b".,")
                text = bare.decode("utf-8", "replace").lower()
                if _LETTERS.fullmatch(text):
                    tail = w[len(bare) :]
                    if tail not in self.tails:
                        if len(self.tails) > 1000:
                            self.tails = {b"": b""}
                        self.tails[tail] = self._whole([tail])[0]
                    if not text.isascii():
                        text = "".join([self.spelled.get(c, c) for c in text])
                    known = _packed([t.id for t in self.model.tokenize(text)]) + self.tails[tail]
            if known is None:
                rest.append(w)
            else:
                self.known[w] = known
        self.known.update(zip(rest, self._whole(rest), strict=True))

    def encode(self, texts: list[bytes], end: int | None) -> list[bytes]:
        """Per text its ids as little-endian 32-bit numbers."""
        tail = b"" if end is None else end.to_bytes(4, "little")
        if not self.letters:
            return [ids + tail for ids in self._whole(texts)]
        texts = [t if b"<|" in t else t.lower() for t in texts]  # special tokens keep their spelling
        words = [t.split() for t in texts]
        fresh = {w for ws in words for w in ws}
        if len(self.known) > WORDS_KEPT:
            self.known, self.older = {}, self.known
        self._learn(fresh.difference(self.known))
        get = self.known.__getitem__
        return [b"".join(map(get, ws)) + tail for ws in words]


_ENCODERS: dict[str, WordEncoder] = {}


def encoder_of(vocabulary: str) -> WordEncoder:
    """The encoder of this Python worker: kept from task to task."""
    if vocabulary not in _ENCODERS:
        _ENCODERS[vocabulary] = WordEncoder(vocabulary)
    return _ENCODERS[vocabulary]


def to_planes(ids: np.ndarray, bits: bool) -> list[bytes]:
    """Byte planes (4) or bit planes (32) of 32-bit ids."""
    raw = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    if not bits:
        return [p.tobytes() for p in np.ascontiguousarray(raw.T)]
    return [p.tobytes() for p in np.packbits(np.unpackbits(raw, axis=1, bitorder="little").T, axis=1)]


def from_planes(planes: list[bytes], n: int, bits: bool) -> np.ndarray:
    if not bits:
        raw = np.stack([np.frombuffer(p, np.uint8) for p in planes])
    else:
        rows = np.stack([np.unpackbits(np.frombuffer(p, np.uint8), count=n) for p in planes])
        raw = np.packbits(rows.reshape(4, 8, n), axis=1, bitorder="little").reshape(4, n)
    return np.ascontiguousarray(raw.T).view("<u4").reshape(-1)


class Writer:
    """Writes one file to a binary stream."""

    def __init__(self, out, block_ids: int = BLOCK_IDS, bits: bool = False):
        self.out, self.block, self.bits = out, block_ids, bits
        self.packer = zstandard.ZstdCompressor(level=LEVEL)
        self.held, self.held_bytes, self.at = [], 0, len(MAGIC)
        self.chunks, self.doc_ids, self.ends, self.total = [], [], [], 0
        out.write(MAGIC)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.total += len(ids) // 4
        self.doc_ids.append(doc_id)
        self.ends.append(self.total)
        self.held.append(ids)
        self.held_bytes += len(ids)
        if self.held_bytes >= 4 * self.block:
            data = b"".join(self.held)
            whole = len(data) // (4 * self.block) * 4 * self.block
            for k in range(0, whole, 4 * self.block):
                self._put(data[k : k + 4 * self.block])
            self.held, self.held_bytes = [data[whole:]], len(data) - whole

    def _put(self, data: bytes) -> None:
        planes = [self.packer.compress(p) for p in to_planes(np.frombuffer(data, "<u4"), self.bits)]
        self.chunks.append([self.at, len(data) // 4, [len(p) for p in planes]])
        for p in planes:
            self.out.write(p)
            self.at += len(p)

    def close(self) -> None:
        if self.held_bytes:
            self._put(b"".join(self.held))
        ids = np.array([0 if d is None else d for d in self.doc_ids], "<i8")
        null = np.array([d is None for d in self.doc_ids], np.uint8)
        index = self.packer.compress(ids.tobytes() + np.array(self.ends, "<i8").tobytes() + null.tobytes())
        foot = {"bits": self.bits, "docs": len(ids), "index": [self.at, len(index)], "chunks": self.chunks}
        foot = json.dumps(foot).encode()
        self.out.write(index + foot + len(foot).to_bytes(8, "little") + MAGIC)


class Reader:
    """Reads one file from a seekable binary stream of ``size`` bytes."""

    def __init__(self, stream, size: int):
        self.stream = stream
        stream.seek(size - 12)
        tail = stream.read(12)
        if tail[8:] != MAGIC:
            raise ValueError("not a token file, or cut short")
        length = int.from_bytes(tail[:8], "little")
        stream.seek(size - 12 - length)
        foot = json.loads(stream.read(length))
        self.chunks, self.bits, n = foot["chunks"], foot["bits"], foot["docs"]
        self.unpacker = zstandard.ZstdDecompressor()
        stream.seek(foot["index"][0])
        raw = self.unpacker.decompress(stream.read(foot["index"][1]), max_output_size=17 * n)
        ids, null = np.frombuffer(raw, "<i8", n), np.frombuffer(raw, np.uint8, n, 16 * n)
        self.doc_ids = [None if z else int(d) for d, z in zip(ids, null, strict=True)]
        self.ends = np.frombuffer(raw, "<i8", n, 8 * n)

    def block(self, k: int) -> np.ndarray:
        at, n, sizes = self.chunks[k]
        self.stream.seek(at)
        raw = self.stream.read(sum(sizes))
        cuts = np.concatenate([[0], np.cumsum(sizes)])
        most = 4 * n
        planes = [self.unpacker.decompress(raw[a:b], max_output_size=most) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        return from_planes(planes, n, self.bits)

    def documents(self) -> Iterator[tuple[int | None, int, list[bytes]]]:
        """(doc_id, place of the first id in this file, pieces of its ids), holding one block at a time."""
        k, ids, left = -1, b"", 0
        start = 0
        for doc_id, end in zip(self.doc_ids, self.ends.tolist(), strict=True):
            pieces, need = [], 4 * (end - start)
            while need:
                if left == len(ids):
                    k += 1
                    ids, left = self.block(k).tobytes(), 0
                piece = ids[left : left + need]
                pieces.append(piece)
                left += len(piece)
                need -= len(piece)
            yield doc_id, start, pieces
            start = end

    def ids(self, first: int, n: int) -> np.ndarray:
        """Any range of ids, reading only the blocks that hold it."""
        sizes = np.cumsum([0] + [c[1] for c in self.chunks])
        a, b = np.searchsorted(sizes, first, "right") - 1, np.searchsorted(sizes, first + n, "left")
        got = [self.block(k) for k in range(max(a, 0), b)] or [np.zeros(0, "<u4")]
        return np.concatenate(got)[first - sizes[max(a, 0)] :][:n]


def write_tokens(
    docs: DataFrame,
    path: str,
    vocabulary: str = "word_bpe_49k.json",
    end: int | None = 1,
    block_ids: int = BLOCK_IDS,
    bits: bool = False,
) -> DataFrame:
    """Encode ``docs`` (doc_id, text) and write token files to the folder ``path``, in ascending doc_id order.

    ``path`` is a folder every executor reaches, as a URI or an absolute path; ``vocabulary`` a file of the tokenizers
    library, by path or by name among the installed public ones; ``end`` an id after every document.
    Returns the manifest: part, file, n_docs, n_ids, and start (ids in all files before it). Null texts are
    empty and still end with ``end``; null ids come first; rows of one id are ordered by text; an empty
    table writes no file; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        part, encoder, writer, n = TaskContext.get().partitionId(), None, None, 0
        files, folder = fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
        name = f"part-{part:06d}.kbp"
        temporary = f"{folder}/.{name}.{uuid.uuid4().hex}"
        for batch in batches:
            texts = batch.column("text")
            ids = batch.column("doc_id").to_pylist()
            for a, b, data, offsets in text_slices(texts):
                if writer is None:
                    encoder = encoder_of(vocabulary)
                    files.create_dir(folder, recursive=True)
                    stream = files.open_output_stream(temporary)
                    writer = Writer(stream, block_ids, bits)
                raw = data.tobytes()
                cut = [raw[x:y] for x, y in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                for doc_id, coded in zip(ids[a:b], encoder.encode(cut, end), strict=True):
                    writer.add(doc_id, coded)
                n += b - a
        if writer is not None:
            writer.close()
            stream.close()
            if files.get_file_info(f"{folder}/{name}").type != fs.FileType.NotFound:
                files.delete_file(f"{folder}/{name}")
            files.move(temporary, f"{folder}/{name}")
            yield pa.RecordBatch.from_pydict({"part": [part], "file": [name], "n_docs": [n], "n_ids": [writer.total]})

    small_batches(docs.sparkSession)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("_crc", F.crc32(F.encode("text", "UTF-8")))
    ordered = slim.repartitionByRange("doc_id", "_crc").sortWithinPartitions("doc_id", "_crc", "text").drop("_crc")
    written = ordered.mapInArrow(run, "part bigint, file string, n_docs bigint, n_ids bigint")
    manifest = materialise(written, "manifest")
    # one row per file
    return manifest.withColumn("start", F.sum("n_ids").over(Window.orderBy("part")) - F.col("n_ids"))


def read_tokens(manifest: DataFrame, path: str) -> DataFrame:
    """Read token files back: per document doc_id, start (ids of all documents before it), n_tokens and ids_crc32
    (of its ids as little-endian 32-bit numbers). Files are read by blocks, one file a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        files, folder = fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
        for batch in batches:
            for file, first in zip(batch.column("file").to_pylist(), batch.column("start").to_pylist(), strict=True):
                size = files.get_file_info(f"{folder}/{file}").size
                with files.open_input_file(f"{folder}/{file}") as stream:
                    rows = []
                    for doc_id, start, pieces in Reader(stream, size).documents():
                        crc = 0
                        for p in pieces:
                            crc = zlib.crc32(p, crc)
                        rows.append((doc_id, first + start, sum(map(len, pieces)) // 4, crc))
                        if len(rows) == 10_000:
                            yield _batch(rows)
                            rows = []
                    if rows:
                        yield _batch(rows)

    return spread_files(manifest).mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = ["doc_id", "start", "n_tokens", "ids_crc32"]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names)


def spread_files(manifest: DataFrame) -> DataFrame:
    """One task per file: the manifest itself is tiny and would be read by one."""
    return manifest.repartitionByRange(max(1, manifest.count()), "part")


def tokens_of(docs: DataFrame, vocabulary: str = "word_bpe_49k.json") -> DataFrame:
    """Write the documents' token files to a new shared folder and return what reading them back gives."""
    path = shared_dir(docs.sparkSession, "llm", f"tokens-{uuid.uuid4().hex}")
    return read_tokens(write_tokens(docs, path, vocabulary), path)


def op6_bitplane_tokens(spark, sf_dir):
    return tokens_of(table(spark, sf_dir, "documents"))
