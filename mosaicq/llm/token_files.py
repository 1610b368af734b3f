"""Token-id files: one independent zstandard frame a document, a checksum each, and a trailing seek table.

A file holds a skippable frame with its description, one frame for each document (little-endian ids, the
end id last), a skippable frame with the doc_ids, and a seek table in zstandard's seekable format: per frame
its compressed size, its size and the low 32 bits of its content's XXH64. A reader takes the table from the
end of the file and decompresses the frames of the documents it wants; any zstandard tool reads the whole.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mosaicq.llm.common import Places, chunk_count, cut, shared_dir, slices, table, text_bytes, texts

END_ID = 2
SHARD_BYTES = 32 << 20
#: Fixed values of zstandard's frame formats: a skippable frame, the seek table's frame, its last four bytes.
SKIPPABLE, SEEK_FRAME, SEEK_MAGIC = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
#: Distinct pieces of texts a worker remembers with their ids; beyond it starts anew, which changes no result.
MEMORY = 1_000_000
#: Bytes of text encoded in one go.
STEP = 2 << 20
#: Stands for a line break, and before the first piece of a line; texts that hold either are encoded whole.
_BREAK, _FIRST = "\x00", "\x01"
#: Marks after a word that end its piece make a piece of their own.
_LETTER = "A-Za-zªµºÀ-ÖØ-öø-ȳ"
_MARKS = (f"([{_LETTER}])([!-&(-/:-@\\[-`{{-~]+)( |\\z)", f"\\1 {_FIRST}\\2\\3")
#: Texts that hold one of these are encoded whole: rarer characters, and runs of blanks that byte-level BPE may take as one.
_WHOLE = r"[^\t\n -~¡-¬®-ȳ]|[\t\n ]{3}|[\t\n ]{2}\z"


class Encoder:
    """Ids of whole texts by the tokenizers library.

    Byte-level BPE never joins ids across a blank or a line break that stands alone or before one more, nor across the border of a
    word and the marks after it, so such texts are cut there and each distinct piece is encoded once, by the library, blank before it
    included. All others are encoded whole.
    """

    def __init__(self, definition: str, end_id: int = END_ID):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.end_id = Tokenizer.from_str(definition), end_id
        about = json.loads(definition)
        pre = about.get("pre_tokenizer") or {}
        self.by_piece = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not about.get("normalizer")
        self.whole = "|".join([_WHOLE, *(re.escape(t["content"]) for t in about.get("added_tokens", []))])
        self.dtype = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 1 << 16 and end_id < 1 << 16 else np.dtype("<u4")
        self._forget()

    def _forget(self) -> None:
        self.known = Places()
        self.flat, self.ends = np.empty(1 << 16, self.dtype), np.zeros(1, np.int64)

    def _learn(self, pieces: list[str]) -> None:
        spelt = ["\n" if p == _BREAK else p[1:] if p[:1] == _FIRST else " " + p for p in pieces]
        got = self.tokenizer.encode(spelt, is_pretokenized=True, add_special_tokens=False)
        ends = self.ends[-1] + np.cumsum(np.bincount(np.array(got.word_ids, np.int64), minlength=len(spelt)))
        while ends[-1] > len(self.flat):
            self.flat = np.concatenate((self.flat, np.empty_like(self.flat)))
        self.flat[self.ends[-1] : ends[-1]] = got.ids
        self.ends = np.concatenate((self.ends, ends))

    def _by_piece(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and where each text's end."""
        if len(self.known) > MEMORY:
            self._forget()
        first, nothing = (pa.scalar(x, texts.type) for x in (_FIRST, ""))
        marked = pc.binary_join_element_wise(first, pc.replace_substring(texts, "\n", f" {_BREAK} {_FIRST}"), nothing)
        pieces = pc.split_pattern(pc.replace_substring_regex(marked, *_MARKS), " ")
        coded = pc.dictionary_encode(pieces.flatten())
        place = np.fromiter(map(self.known.__getitem__, coded.dictionary.to_pylist()), np.int64, len(coded.dictionary))
        if len(self.known) >= len(self.ends):
            self._learn(list(islice(self.known, len(self.ends) - 1, None)))
        at = place[coded.indices.to_numpy(zero_copy_only=False)]
        start, n = self.ends[at], self.ends[at + 1] - self.ends[at]
        ends = np.concatenate(([0], np.cumsum(n)))
        ids = self.flat[np.repeat(start - ends[:-1], n) + np.arange(ends[-1])]
        return ids, ends[pieces.offsets.to_numpy()[1:] - pieces.offsets[0].as_py()]

    def encode(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """For each text, none of them null, its ids and the end id."""
        whole = pc.match_substring_regex(texts, self.whole) if self.by_piece else pa.array([True] * len(texts), pa.bool_())
        ids, ends = self._by_piece(texts.filter(pc.invert(whole))) if self.by_piece else (None, np.empty(0, np.int64))
        done, k = 0, 0
        for i, alone in enumerate(whole.to_pylist()):
            if alone:
                own = np.array(self.tokenizer.encode(texts[i].as_py(), add_special_tokens=False).ids, self.dtype)
            else:
                own, done, k = ids[done : ends[k]], ends[k], k + 1
            yield np.append(own, self.dtype.type(self.end_id))


_ENCODERS: dict[tuple[str, int], Encoder] = {}


def _encoder(definition: str, end_id: int) -> Encoder:
    """The worker's own, so that its tasks share what they learn."""
    if (definition, end_id) not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[definition, end_id] = Encoder(definition, end_id)
    return _ENCODERS[definition, end_id]


class Writer:
    """Appends frames to a binary stream and closes with the seek table."""

    def __init__(self, out, dtype: np.dtype, end_id: int):
        import zstandard

        self.out, self.entries, self.docs = out, [], []
        self.zstd = zstandard.ZstdCompressor(level=3, write_checksum=True)
        self._skippable(json.dumps({"format": "token-frames", "version": 1, "dtype": dtype.str, "end_id": end_id}).encode())

    def _skippable(self, content: bytes) -> None:
        self.out.write(struct.pack("<II", SKIPPABLE, len(content)) + content)
        self.entries.append((8 + len(content), 0, 0))

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        from xxhash import xxh64_intdigest

        raw = ids.tobytes()
        frame = self.zstd.compress(raw)
        self.out.write(frame)
        self.entries.append((len(frame), len(raw), xxh64_intdigest(raw) & 0xFFFFFFFF))
        self.docs.append((doc_id or 0, doc_id is not None))

    def close(self) -> int:
        ids = np.array([d for d, _ in self.docs], "<i8").tobytes() + np.array([k for _, k in self.docs], np.uint8).tobytes()
        self._skippable(self.zstd.compress(ids))
        rows = np.array(self.entries, "<u4").tobytes()
        self.out.write(struct.pack("<II", SEEK_FRAME, len(rows) + 9) + rows + struct.pack("<IBI", len(self.entries), 0x80, SEEK_MAGIC))
        return sum(e[0] for e in self.entries) + len(rows) + 17


class Reader:
    """Random access to a file: doc_ids in file order, and the ids of any document."""

    def __init__(self, source):
        import zstandard

        self.source, self.zstd = source, zstandard.ZstdDecompressor()
        size = source.size()
        source.seek(size - 9)
        n, flags, magic = struct.unpack("<IBI", source.read(9))
        if magic != SEEK_MAGIC or not flags & 0x80:
            raise ValueError("no seek table with checksums at the end of the file")
        source.seek(size - 9 - 12 * n)
        self.entries = np.frombuffer(source.read(12 * n), "<u4").reshape(n, 3)
        self.offsets = np.concatenate(([0], np.cumsum(self.entries[:, 0], dtype=np.int64)))
        source.seek(8)
        about = json.loads(source.read(int(self.entries[0, 0]) - 8))
        self.dtype, self.end_id = np.dtype(about["dtype"]), about["end_id"]
        source.seek(int(self.offsets[n - 1]) + 8)
        raw = self.zstd.decompress(source.read(int(self.entries[n - 1, 0]) - 8))
        self.doc_ids = [int(d) if k else None for d, k in zip(np.frombuffer(raw[: 8 * (n - 2)], "<i8"), raw[8 * (n - 2) :], strict=True)]

    def __len__(self) -> int:
        return len(self.doc_ids)

    def ids(self, k: int) -> np.ndarray:
        """Ids of the k-th document; only its frame is read and decompressed. A wrong checksum is an error."""
        from xxhash import xxh64_intdigest

        size, raw_size, check = (int(x) for x in self.entries[k + 1])
        self.source.seek(int(self.offsets[k + 1]))
        raw = self.zstd.decompress(self.source.read(size), max_output_size=raw_size)
        if len(raw) != raw_size or xxh64_intdigest(raw) & 0xFFFFFFFF != check:
            raise ValueError(f"frame {k}: its content doesn't match its checksum")
        return np.frombuffer(raw, self.dtype)


def _open(uri: str, mode: str):
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri)
    if mode == "r":
        return system.open_input_file(path)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    return system.open_output_stream(path, compression=None)


def _uri(folder: str) -> str:
    return folder if re.match(r"\w+:", folder) else f"file://{folder}"


def write(docs: DataFrame, tokenizer_path: str, folder: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Writes files of about SHARD_BYTES of text in ascending doc_id order, nulls first.

    Returns (file, shard, start, n_docs, n_tokens, n_bytes), one row a file; start counts the ids in earlier files. A
    task writes under a name of its own attempt and only finished attempts are listed, so lost executors and
    repeated tasks leave the listing whole. Null text: the end id alone. Repeated rows are written each.
    """
    spark = docs.sparkSession
    with open(tokenizer_path, encoding="utf-8") as f:
        definition = spark.sparkContext.broadcast(f.read())  # the size of one vocabulary
    folder = f"{_uri(folder or shared_dir(spark)).rstrip('/')}/tokens-{uuid.uuid4().hex[:12]}"
    rows = texts(docs)
    tie = F.xxhash64("text")
    ranged = rows.repartitionByRange(chunk_count(text_bytes(rows), SHARD_BYTES), F.col("doc_id").asc_nulls_first(), tie).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), tie, "text")

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, out, writer, tokens = TaskContext.get(), None, None, 0
        name = f"{folder}/shard-{task.partitionId():06d}-{task.taskAttemptId()}.zst"
        for batch in batches:
            if writer is None and batch.num_rows:
                encoder, out = _encoder(definition.value, end_id), _open(name, "w")
                writer = Writer(out, encoder.dtype, end_id)
            for part in slices(batch, STEP):
                column = part["text"].cast(pa.large_string())
                for doc_id, x in zip(part["doc_id"].to_pylist(), encoder.encode(column), strict=True):
                    writer.add(doc_id, x)
                    tokens += len(x)
        if writer is not None:
            n_bytes = writer.close()
            out.close()
            yield pa.RecordBatch.from_pylist([{"file": name, "shard": task.partitionId(), "n_docs": len(writer.docs), "n_tokens": tokens, "n_bytes": n_bytes}])

    listed = cut(ranged.mapInArrow(shard, "file string, shard long, n_docs long, n_tokens long, n_bytes long"))
    before = W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)  # a row for each file
    return listed.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def read(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files' own bytes."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for f in batch.to_pylist():
                with _open(f["file"], "r") as source:
                    r, start, rows = Reader(source), f["start"], []
                    for k, doc_id in enumerate(r.doc_ids):
                        ids = r.ids(k)
                        rows.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                        start += len(ids)
                columns = [pa.array(x, pa.int64()) for x in zip(*rows, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32"])

    n = max(1, files.count())
    return files.select("file", "start").repartition(n).mapInArrow(digest, "doc_id long, start long, n_tokens long, ids_crc32 long")


def documents(uri: str, doc_ids: Iterable[int]) -> dict[int, np.ndarray]:
    """The ids of some documents of one file."""
    wanted = set(doc_ids)
    with _open(_uri(uri), "r") as source:
        r = Reader(source)
        return {d: r.ids(k) for k, d in enumerate(r.doc_ids) if d in wanted}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(write(table(spark, sf_dir, "documents"), default_tokenizer()))
