"""Operator 5: token ids as Arrow files of equal-length sequences.

``write_packed`` encodes every text, appends the end id and lays all ids, in ascending order of the
document key, one after the other into files of the Arrow IPC file format.  ``tokens-*.arrow`` has
fixed-size-list batches of ``SEQUENCE`` ids and masks (mask false: padding at a file's end), so
sequence k is row ``k % ROWS`` of batch ``k // ROWS``, found without reading anything else and, on
a memory-mapped file, without a copy.  ``documents-*.arrow`` has each document's key, first place
and length.  ``read_documents`` reads both back.

A task writes under a name of its own and reports it only when the file is complete, so files of
failed or repeated tasks are never read.  The manifest has one row a file.

Defined results: a null text counts as empty and an empty text has the end id alone; null keys come
first; equal keys are ordered by their text's hash and repeated rows stay; an empty table gives an
empty manifest.  Other columns of the table are not written, so their names cannot clash.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import PieceCache, read_table, text_slices, texts_of, worker_store
from tidemark.runtime import materialize, shared_folder, ship_by_value

ship_by_value(__name__)

TOKENIZER_FILE = "byte_bpe_50k.json"
END_ID = 2
SEQUENCE = 2048                # ids a sequence
ROWS = 64                      # sequences a batch
CLOSING = ".,:;!?)*#%&$|"      # punctuation that often ends a part
JOINED = 2_000                 # cores encoded in one call
MANIFEST = ("part int, file string, documents string, n_tokens long, n_documents long")

# A blank before white space or at the end: there the blank does not open a new pre-token.
AWKWARD = re.compile(r" (?:\s|\Z)")


def cut_at_blanks(text: str) -> list[str]:
    """The text cut before every blank that text follows, blanks removed.

    The pattern of the tokenizer starts a pre-token at each such blank, so the parts can be encoded
    one by one: the first as it is, the others with a blank in front.
    """
    parts = text.split(" ")
    if AWKWARD.search(text) is None:
        return parts
    runs = [[parts[0]]]
    for part in parts[1:]:
        if not part or part[0].isspace():
            runs[-1].append(part)
        else:
            runs.append([part])
    return [" ".join(run) for run in runs]


class TextEncoder:
    """The tokenizers library over distinct parts of texts.

    Parts are cached whole, and what the library encodes are their cores without closing
    punctuation, many in one call: a blank before text always starts a pre-token, so joined cores
    are cut apart again by the bytes of their tokens.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        size = self.tokenizer.get_vocab_size()
        self.kind = np.uint16 if size <= 1 << 16 else np.uint32
        # A byte-level token has a character a byte.
        self.bytes = np.array([len(self.tokenizer.id_to_token(i)) for i in range(size)])
        self.first = PieceCache(self.encode, 50_000, 1_000_000)
        self.rest = PieceCache(self.encode_parts, 400_000, 6_000_000)
        self.cores = PieceCache(self.encode_joined, 500_000, 8_000_000)
        self.closing = PieceCache(self.encode, 10_000, 100_000)

    def encode(self, texts: list[str]) -> list[bytes]:
        coded = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(c.ids, self.kind).tobytes() for c in coded]

    def encode_parts(self, parts: list[str]) -> list[bytes]:
        """Ids of parts with a blank in front."""
        cores = [p.rstrip(CLOSING) for p in parts]
        # Between a letter or digit and punctuation there always is a boundary.
        cores = [c if c and c[-1].isalnum() else p for c, p in zip(cores, parts)]
        closing = self.closing.of([p[len(c):] for c, p in zip(cores, parts)])
        return list(map(bytes.__add__, self.cores.of(cores), closing))

    def encode_joined(self, cores: list[str]) -> list[bytes]:
        out = []
        for i in range(0, len(cores), JOINED):
            words = [" " + c for c in cores[i:i + JOINED]]
            coded = self.tokenizer.encode_batch_fast(["".join(words)], add_special_tokens=False)
            ids = np.array(coded[0].ids, self.kind)
            ends = np.cumsum([len(w.encode()) for w in words])
            cuts = np.searchsorted(np.cumsum(self.bytes[ids]), ends, side="right")
            data, width = ids.tobytes(), ids.itemsize
            places = (np.append(0, cuts) * width).tolist()
            out += [data[a:b] for a, b in zip(places, places[1:])]
        return out

    def ids(self, texts: list[str]) -> list[bytes]:
        """Ids of whole texts, as bytes of ``kind``."""
        plain = [i for i, t in enumerate(texts) if not any(s in t for s in self.specials)]
        out = [b""] * len(texts)
        whole = sorted(set(range(len(texts))).difference(plain))
        for i, ids in zip(whole, self.encode([texts[i] for i in whole])):
            out[i] = ids
        cut = [cut_at_blanks(texts[i]) for i in plain]
        first = self.first.of([parts[0] for parts in cut])
        rest = self.rest.of([p for parts in cut for p in parts[1:]])
        at = 0
        for i, parts, ids in zip(plain, cut, first):
            out[i] = ids + b"".join(rest[at:at + len(parts) - 1])
            at += len(parts) - 1
        return out


def _encoder(path: str) -> TextEncoder:
    store = worker_store()
    if ("encoder", path) not in store:
        store["encoder", path] = TextEncoder(path)
    return store["encoder", path]


class _Writer:
    """One file pair: ids gathered until a batch is full, then written."""

    def __init__(self, folder: str, kind: type) -> None:
        self.kind = kind
        target, root = fs.FileSystem.from_uri(folder)
        target.create_dir(root, recursive=True)
        name = uuid.uuid4().hex
        self.names = f"tokens-{name}.arrow", f"documents-{name}.arrow"
        ids = pa.list_(pa.from_numpy_dtype(kind), SEQUENCE)
        self.token_schema = pa.schema([("ids", ids), ("mask", pa.list_(pa.bool_(), SEQUENCE))])
        self.document_schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()),
                                          ("n_tokens", pa.int64())])
        self.streams = [target.open_output_stream(f"{root}/{n}") for n in self.names]
        self.tokens = pa.ipc.new_file(self.streams[0], self.token_schema)
        self.index = pa.ipc.new_file(self.streams[1], self.document_schema)
        self.held: list[bytes] = []
        self.held_bytes = 0
        self.n_tokens = self.n_documents = 0

    def add(self, keys: list, coded: list[bytes]) -> None:
        width = np.dtype(self.kind).itemsize
        lengths = np.fromiter(map(len, coded), np.int64, len(coded)) // width
        starts = self.n_tokens + np.cumsum(lengths) - lengths
        self.index.write_batch(pa.RecordBatch.from_arrays(
            [pa.array(keys, pa.int64()), pa.array(starts), pa.array(lengths)],
            schema=self.document_schema))
        self.n_tokens += int(lengths.sum())
        self.n_documents += len(keys)
        self.held += coded
        self.held_bytes += sum(map(len, coded))
        if self.held_bytes >= SEQUENCE * ROWS * width:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.frombuffer(b"".join(self.held), self.kind)
        full = SEQUENCE * ROWS
        place = 0
        while len(ids) - place >= full or last and place < len(ids):
            some = ids[place:place + full]
            place += len(some)
            n = -(-len(some) // SEQUENCE) * SEQUENCE
            mask = np.arange(n) < len(some)
            some = np.concatenate([some, np.zeros(n - len(some), self.kind)])
            self.tokens.write_batch(pa.RecordBatch.from_arrays(
                [pa.FixedSizeListArray.from_arrays(pa.array(some), SEQUENCE),
                 pa.FixedSizeListArray.from_arrays(pa.array(mask), SEQUENCE)],
                schema=self.token_schema))
        self.held, self.held_bytes = [ids[place:].tobytes()], (len(ids) - place) * ids.itemsize

    def close(self) -> None:
        self._flush(True)
        for part in (self.tokens, self.index, *self.streams):
            part.close()


def write_packed(docs: DataFrame, folder: str, path: str, key: str = "doc_id", text: str = "text",
                 end_id: int = END_ID) -> DataFrame:
    """Write all documents under ``folder`` and return the stored manifest.

    The texts are range-partitioned by key, the one shuffle this takes; each task then encodes and
    writes its range as one file pair.  ``part`` numbers the ranges in ascending order.
    """
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    rows = rows.repartitionByRange(F.col("doc_id").asc_nulls_first(), "tie")
    rows = rows.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "tie", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = None
        encoder = _encoder(path)
        end = np.array([end_id], encoder.kind).tobytes()
        for batch in batches:
            for part in text_slices(batch, "text"):
                writer = writer or _Writer(folder, encoder.kind)
                coded = [ids + end for ids in encoder.ids(texts_of(part, "text"))]
                writer.add(part.column("doc_id").to_pylist(), coded)
        if writer:
            writer.close()
            yield pa.RecordBatch.from_pydict({
                "part": pa.array([TaskContext.get().partitionId()], pa.int32()),
                "file": [writer.names[0]], "documents": [writer.names[1]],
                "n_tokens": [writer.n_tokens], "n_documents": [writer.n_documents]})

    return materialize(rows.select("doc_id", "text").mapInArrow(run, MANIFEST), "packed-manifest")


def open_file(folder: str, name: str) -> pa.ipc.RecordBatchFileReader:
    """Random access to a file's batches; memory-mapped, and so without copies, where local."""
    source, root = fs.FileSystem.from_uri(folder)
    where = f"{root}/{name}"
    local = isinstance(source, fs.LocalFileSystem)
    return pa.ipc.open_file(pa.memory_map(where) if local else source.open_input_file(where))


def sequence(reader: pa.ipc.RecordBatchFileReader, number: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids (a view of the file) and mask of one sequence."""
    batch, row = reader.get_batch(number // ROWS), number % ROWS
    mask = batch.column("mask")[row].values.to_numpy(zero_copy_only=False)
    return batch.column("ids")[row].values.to_numpy(), mask


def _document_ids(folder: str, manifest_row: dict) -> Iterator[tuple[int | None, int, np.ndarray]]:
    """Key, start in the file, and ids of each document of a file pair, one batch in memory."""
    tokens = open_file(folder, manifest_row["file"])
    index = open_file(folder, manifest_row["documents"])
    full, number, values = SEQUENCE * ROWS, -1, None
    for k in range(index.num_record_batches):
        batch = index.get_batch(k)
        for key, start, n in zip(*(batch.column(c).to_pylist() for c in range(3))):
            pieces, at = [], start
            while at < start + n:
                if at // full != number:
                    number = at // full
                    values = tokens.get_batch(number).column("ids").values.to_numpy()
                stop = min(start + n, (number + 1) * full)
                pieces.append(values[at - number * full:stop - number * full])
                at = stop
            yield key, start, pieces[0] if len(pieces) == 1 else np.concatenate(pieces)


def read_documents(manifest: DataFrame, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids (binary, little-endian
    unsigned 32-bit) of every document, from the files.  A task reads one file pair."""
    files = manifest.count()
    rows = manifest.withColumn("base", F.sum("n_tokens").over(_before()))
    rows = rows.withColumn("base", F.coalesce("base", F.lit(0)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                keys, starts, counts, coded, size = [], [], [], [], 0
                for key, start, ids in _document_ids(folder, row):
                    keys.append(key)
                    starts.append(row["base"] + start)
                    counts.append(len(ids))
                    coded.append(ids.astype(np.uint32).tobytes())
                    size += len(coded[-1])
                    if size >= 4 << 20:
                        yield _rows(keys, starts, counts, coded)
                        keys, starts, counts, coded, size = [], [], [], [], 0
                if keys:
                    yield _rows(keys, starts, counts, coded)

    return rows.repartition(max(files, 1), "part").mapInArrow(
        run, "doc_id long, start long, n_tokens long, ids binary")


def _before():
    """Files before this one.  The window has one row a file."""
    from pyspark.sql import Window

    return Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)


def _rows(keys: list, starts: list, counts: list, coded: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(keys, pa.int64()), pa.array(starts, pa.int64()), pa.array(counts, pa.int64()),
         pa.array(coded, pa.binary())], names=["doc_id", "start", "n_tokens", "ids"])




def op5_packed_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place, length and checksum of every document's ids, from the files written for it."""
    folder = f"{shared_folder(spark)}/packed-{uuid.uuid4().hex}"
    docs = read_table(spark, sf_dir, "documents")
    manifest = write_packed(docs, folder, public_tokenizers.path(TOKENIZER_FILE))
    return read_documents(manifest, folder).select("doc_id", "start", "n_tokens",
                                                   F.crc32("ids").alias("ids_crc32"))
