"""Token-id files compressed with a shared zstandard dictionary (operator 6).

Documents are encoded with a public tokenizer file (a parameter) and an end
id; the ids are serialised as little-endian unsigned 32-bit integers.  A
dictionary is trained on the serialised ids of a bounded sample
(``DICT_ROWS`` documents of at most ``DICT_CHARS`` characters); each document
is then compressed on its own with it, so short documents compress well and
any document can be read alone.

File: magic, SHA-256 of the dictionary (zeros: none), the compressed
documents, an index with one entry per document (id, null flag, offset,
length, number of tokens), and a footer with the index's place.  Files and
their order hold the documents by ascending id (null ids first); equal ids
are ordered by length, then by their place in the input.

Words between spaces and newlines are looked up once for a group of texts,
encoded once per Python worker and kept (about ``CACHE`` of them): the tokenizer's normaliser and splitter
never look across a space or newline, so the ids are those of the whole text;
tests compare them.  Null text counts as empty: the end id alone.  An empty
table gives no files.  Other columns are never read.
"""

from __future__ import annotations

import hashlib
import operator
import os
import re
import struct
import sys
import types
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagegrove.llm.common import doc_groups, open_store, shared_path, stage, utf8

cloudpickle.register_pickle_by_value(sys.modules[__name__])

MAGIC = b"PGTOK001"
END_ID = 2
DICT_ROWS, DICT_CHARS, DICT_BYTES = 1000, 20_000, 64 << 10
LEVEL, CACHE = 1, 600_000
# Bytes of text that are encoded together (a longer text is encoded alone).
TEXT_BYTES = 8 << 20
# Capital letters of ASCII and Latin-1 (their small forms go with them), and marks.
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ" + "".join(chr(c) for c in range(0xC0, 0xDF) if c != 0xD7)
MARKS = ".,;:!?*#$%&)"
SIMPLE = re.compile(f"([A-Za-z\u00c0-\u00d6\u00d8-\u00de\u00e0-\u00f6\u00f8-\u00fe]+)([{re.escape(MARKS)}]*)")
ENTRY = np.dtype([("id", "<i8"), ("null", "u1"), ("offset", "<u8"), ("length", "<u4"), ("tokens", "<u4")])
FOOTER = "<QQ8s"


def strings(words: pa.Array) -> list[str]:
    return words.to_numpy(zero_copy_only=False).tolist()  # several times as fast as to_pylist


class _Parts(dict):
    """letters or marks of a word -> serialised ids; a new part is encoded when it is first asked for."""

    def __init__(self, encoder: Encoder) -> None:
        super().__init__()
        self.encoder = encoder

    def __missing__(self, part: str) -> bytes:
        if len(self) >= CACHE:
            self.clear()
        ids = [t.id for t in self.encoder.model.tokenize(part.translate(self.encoder.letters))]
        out = self[part] = struct.pack(f"<{len(ids)}I", *ids)
        return out


class Encoder:
    """text -> serialised ids with the end id; words of earlier texts are remembered.

    Most words are Latin letters with ASCII marks behind them.  Where the
    tokenizer lower-cases and splits such words between letters and marks
    (which ``_simple`` finds out by asking it), each part goes straight to
    its model; all other words go through the whole tokenizer.
    """

    def __init__(self, path: str, end_id: int | None = END_ID) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.end = b"" if end_id is None else struct.pack("<I", end_id)
        self.known: dict[str, bytes] = {}
        self.parts = _Parts(self)
        self.simple = self._simple()

    @classmethod
    def of(cls, path: str) -> Encoder:
        """One encoder for each file in a worker process."""
        home = sys.modules.setdefault("_pagegrove_encoders", types.ModuleType("_pagegrove_encoders")).__dict__
        if path not in home:
            home[path] = cls(path)
        return home[path]

    def _whole(self, words: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def _simple(self) -> bool:
        """Whether letters and marks can be encoded apart, as probes with every letter and mark tell."""
        if self.tokenizer.pre_tokenizer is None or self.tokenizer.normalizer is None:
            return False
        written = lambda c: "".join(x for x, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(c))
        self.letters = {ord(c): written(c) for c in LETTERS + LETTERS.lower()}
        probes = [c + "the" + c.lower() + m + m for c in LETTERS for m in ("", *MARKS)] + ["s" + m + "." + m for m in MARKS]
        return self._whole(probes) == [self._split(SIMPLE.fullmatch(w)) for w in probes]

    def _split(self, m: re.Match) -> bytes:
        word, marks = m.groups()
        return self.parts[word.lower()] + self.parts[marks]

    def _words(self, words: pa.Array) -> list[bytes]:
        """The serialised ids of words, each given once."""
        if not self.simple:
            return self._remembered(strings(words))
        simple = pc.match_substring_regex(words, f"^(?:{SIMPLE.pattern})$")
        plain = words.filter(simple)
        letters = pc.utf8_lower(pc.utf8_rtrim(plain, MARKS))
        marks = pc.utf8_ltrim(plain, LETTERS + LETTERS.lower())
        known = map(operator.add, *(map(self.parts.__getitem__, strings(x)) for x in (letters, marks)))
        other = iter(self._remembered(strings(words.filter(pc.invert(simple)))))
        return [next(known) if s else next(other) for s in simple.to_numpy(zero_copy_only=False).tolist()]

    def _remembered(self, words: list[str]) -> list[bytes]:
        if len(self.known) > CACHE // 2:
            self.known.clear()
        new = [w for w in words if w not in self.known]
        self.known.update(zip(new, self._whole(new), strict=True))
        return [self.known[w] for w in words]

    def encode(self, text: str) -> bytes:
        return self.encode_many(pa.array([text], pa.string()))[0].tobytes()

    def encode_many(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one behind the other, and where each text's ids start (one more at the end).

        Arrow splits the texts and numbers their words, and each word is looked up once.
        """
        words = pc.split_pattern(pc.replace_substring(texts.fill_null(""), "\n", " "), " ")
        first = words.offsets.to_numpy() - words.offsets[0].as_py()
        coded = words.flatten().dictionary_encode()
        known = self._words(coded.dictionary)
        ids = np.frombuffer(b"".join([*known, self.end]), "<u4")
        size = np.fromiter(map(len, known), np.int32, len(known)) // 4
        word = coded.indices.to_numpy()
        times = size[word]
        at = np.concatenate(([0], np.cumsum(times, dtype=np.int64)))  # of each word among the ids of all words
        take = np.arange(at[-1]) + np.repeat((np.cumsum(size, dtype=np.int64) - size)[word] - at[:-1], times)
        start = at[first]
        if self.end:
            take = np.insert(take, start[1:], len(ids) - 1)
            start = start + np.arange(len(start))
        return ids[take], start


def train_dictionary(docs: DataFrame, path: str, rows: int = DICT_ROWS, chars: int = DICT_CHARS, size: int = DICT_BYTES) -> bytes:
    """A dictionary from a bounded sample, taken by a hash of the id; empty if there is too little to train on."""
    import zstandard
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")).distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).collect()
    ids = docs.sparkSession.createDataFrame(ids, "doc_id long")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.length("text") <= chars)
    texts = texts.join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text")).collect()
    encoder = Encoder(path)
    samples = [encoder.encode(r.text) for r in sorted(texts, key=lambda r: r.doc_id)]
    try:
        return zstandard.train_dictionary(min(size, max(1024, sum(map(len, samples)) // 4)), samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def _dictionary(raw: bytes):
    import zstandard
    return zstandard.ZstdCompressionDict(raw) if raw else None


def _hash(raw: bytes) -> bytes:
    return hashlib.sha256(raw).digest() if raw else bytes(32)


def _encode(path: str, dictionary):
    def run(batches):
        import zstandard
        encoder = Encoder.of(path)
        pack = zstandard.ZstdCompressor(level=LEVEL, dict_data=_dictionary(dictionary.value), write_checksum=False)
        for b in batches:
            ids, text = b.column("doc_id"), b.column("text")
            for i, j in doc_groups(utf8(text)[1], TEXT_BYTES):
                raw, at = encoder.encode_many(text.slice(i, j - i))
                blobs = [pack.compress(raw[a:z]) for a, z in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([ids.slice(i, j - i), pa.array(blobs, pa.binary()), pa.array(np.diff(at))], ["doc_id", "blob", "n_tokens"])
    return run


def encoded(docs: DataFrame, path: str, dictionary) -> DataFrame:
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = texts.mapInArrow(_encode(path, dictionary), "doc_id long, blob binary, n_tokens long")
    return stage(out.withColumn("place", F.monotonically_increasing_id()), "tokens")


def _write(folder: str, digest: bytes):
    def run(batches):
        fs, root = open_store(folder)
        fs.create_dir(root, recursive=True)
        name = out = None
        at, tokens, index = 0, 0, []
        for b in batches:
            if out is None and len(b):
                name = f"{uuid.uuid4().hex}.tok"
                out = fs.open_output_stream(f"{root}/{name}", compression=None)
                out.write(MAGIC + digest)
                at = len(MAGIC) + len(digest)
            entry = np.zeros(len(b), ENTRY)
            blobs = b.column("blob").to_pylist()
            ids = b.column("doc_id")
            entry["null"] = ids.is_null().to_numpy(zero_copy_only=False)
            entry["id"] = ids.fill_null(0).to_numpy()
            entry["length"] = [len(x) for x in blobs]
            entry["offset"] = at + np.concatenate(([0], np.cumsum(entry["length"].astype(np.int64))[:-1])) if len(b) else 0
            entry["tokens"] = b.column("n_tokens").to_numpy()
            for x in blobs:
                out.write(x)
            at += int(entry["length"].sum())
            tokens += int(entry["tokens"].sum())
            index.append(entry.tobytes())
        if out is not None:
            raw = b"".join(index)
            out.write(raw + struct.pack(FOOTER, at, len(raw) // ENTRY.itemsize, MAGIC))
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([name]), pa.array([len(raw) // ENTRY.itemsize], pa.int64()),
                                              pa.array([tokens], pa.int64())], ["part", "file", "docs", "tokens"])
    return run


def write_store(docs: DataFrame, folder: str, path: str, files: int | None = None) -> DataFrame:
    """Token files of all rows in ``folder``, and the list ``(part, file, docs, tokens)`` in the order of ids."""
    spark = docs.sparkSession
    raw = train_dictionary(docs, path)
    if raw:
        fs, root = open_store(folder)
        fs.create_dir(root, recursive=True)
        with fs.open_output_stream(f"{root}/dictionary", compression=None) as out:
            out.write(raw)
    rows = encoded(docs, path, spark.sparkContext.broadcast(raw))
    keys = ["doc_id", "n_tokens", "place"]
    n = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = rows.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    return stage(parts.select("doc_id", "blob", "n_tokens").mapInArrow(_write(folder, _hash(raw)), "part long, file string, docs long, tokens long"), "token-files")


def read_index(src) -> np.ndarray:
    """The index of an open token file."""
    size = src.size()
    at, n, magic = struct.unpack(FOOTER, src.read_at(struct.calcsize(FOOTER), size - struct.calcsize(FOOTER)))
    if magic != MAGIC:
        raise ValueError("not a token file")
    return np.frombuffer(src.read_at(n * ENTRY.itemsize, at), ENTRY)


def open_reader(fs, root: str, src):
    """A decompressor for an open file, with the dictionary that its hash names."""
    import zstandard
    want = src.read_at(32, len(MAGIC))
    raw = b""
    if want != bytes(32):
        with fs.open_input_stream(f"{root}/dictionary", compression=None) as d:
            raw = d.read()
        if _hash(raw) != want:
            raise ValueError("the dictionary is not the one that the file was written with")
    return zstandard.ZstdDecompressor(dict_data=_dictionary(raw))


def _read(folder: str):
    def run(batches):
        fs, root = open_store(folder)
        for b in batches:
            for file, base in zip(b.column("file").to_pylist(), b.column("base").to_pylist(), strict=True):
                with fs.open_input_file(f"{root}/{file}") as src:
                    index, reader = read_index(src), open_reader(fs, root, src)
                    start = base + np.concatenate(([0], np.cumsum(index["tokens"].astype(np.int64))[:-1]))
                    crc, n = np.zeros(len(index), np.int64), np.zeros(len(index), np.int64)
                    i = 0
                    while i < len(index):  # neighbouring documents are read together
                        j = max(i + 1, int(np.searchsorted(index["offset"], index["offset"][i] + np.uint64(1 << 22))))
                        lo = int(index["offset"][i])
                        raw = src.read_at(int(index["offset"][j - 1] + index["length"][j - 1]) - lo, lo)
                        for k in range(i, j):
                            a = int(index["offset"][k]) - lo
                            ids = reader.decompress(raw[a:a + int(index["length"][k])])
                            crc[k], n[k] = zlib.crc32(ids), len(ids) // 4
                        i = j
                yield pa.RecordBatch.from_arrays([pa.array(index["id"], mask=index["null"].astype(bool)), pa.array(start), pa.array(n), pa.array(crc)],
                                                 ["doc_id", "start", "n_tokens", "ids_crc32"])
    return run


def read_store(files: DataFrame, folder: str) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` of every document in the files.

    The list of files (one row for each) passes through the driver to add up
    the tokens of the files before each.
    """
    rows = sorted(files.collect(), key=lambda r: r.part)
    base = np.concatenate(([0], np.cumsum([r.tokens for r in rows]))).tolist()
    spark = files.sparkSession
    todo = spark.createDataFrame([(r.file, b) for r, b in zip(rows, base[:-1], strict=True)], "file string, base long")
    return todo.repartition(max(1, len(rows))).mapInArrow(_read(folder), "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_table(docs: DataFrame, path: str) -> DataFrame:
    """Writes the token files of all rows of ``docs`` to the shared folder and reads them back."""
    folder = shared_path(docs.sparkSession, "token-store")
    return read_store(write_store(docs, folder, path), folder)
