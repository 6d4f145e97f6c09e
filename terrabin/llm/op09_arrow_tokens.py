"""Token ids as Arrow files of equal-length sequences.

Documents are range-partitioned and sorted by doc_id and text hash.  Each task writes one Arrow file whose record batches
hold fixed-size lists of ids (uint16 where the vocabulary allows) and of the mask of real ids; being uncompressed and
of fixed size, sequence i is found at a computed offset and read without a copy (Sequences).  A second Arrow file
indexes the task's documents.  Files are written under a name of the attempt and moved into place, so that a retried
task or a lost executor leaves whole files; paths are opened through pyarrow's file systems, in spark.checkpoint.dir.

Texts are cut where the byte-level pre-tokenizer always cuts too, and each distinct piece is encoded by the tokenizers
library once; a piece is known again by two 64-bit hashes.  A tokenizer of another kind encodes whole texts.  Ids are
those of the file's tokenizer as it is: the content of an added token in a text is that token, and such a text is
encoded whole.

Edge cases: a null or empty text gives the end id alone; null ids come last; rows of one doc_id are separate documents,
in the order of their texts' hashes; an empty table gives no file and an empty result; other columns are ignored.
"""

from __future__ import annotations

import json
import math
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import kernels as K
from .exchange import release
from .session import prepare, shared_dir, stored, table, text_bytes

SEQUENCE, BATCH, END = 2048, 256, 0
#: Text behind a file: PART_BYTES, or more for inputs beyond 2 TB: the root of the input times 1 KB (330 MB at 100 TB).
PART_BYTES = 48 << 20
#: Text that is cut and encoded at a time.
TEXT_BYTES = 1 << 20
#: The cache: slots (a power of two) for pieces of so many bytes at most, and ids kept before it starts anew.
SLOT_BITS, PIECE_BYTES, KEPT_IDS = 21, 64, 8 << 20
#: New pieces that one call encodes.
JOINT = 4096

_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[[*range(65, 91), *range(97, 123)]] = True
#: Leads of the two-byte letters from U+00C0 to U+017F (two of them, the signs of multiplication and division, are none).
_LATIN_LEAD = np.zeros(256, bool)
_LATIN_LEAD[[0xC3, 0xC4, 0xC5]] = True


_WHITE = frozenset(" \t\n\v\f\r")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def piece_starts(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where pieces start: at each text, at ASCII white space after other characters, and where a Latin letter stands
    before an ASCII character that is none.  No token of the byte-level pattern crosses these places, and it matches on
    from them as if the text began there."""
    n = len(buf)
    start = np.zeros(n + 1, bool)
    if n > 1:
        last, cur = buf[:-1], buf[1:]
        two, three = np.zeros(n - 1, np.uint8), np.zeros(n - 1, np.uint8)
        two[1:], three[2:] = buf[:-2], buf[:-3]
        # white space beyond ASCII before the place: a run of white space must not be cut
        wide = (two == 0xC2) & ((last == 0x85) | (last == 0xA0))
        wide |= (three == 0xE2) & (two == 0x80) & ((last <= 0x8A) | (last == 0xA8) | (last == 0xA9) | (last == 0xAF))
        wide |= ((three == 0xE2) & (two == 0x81) & (last == 0x9F)) | ((three == 0xE3) & (two == 0x80) & (last == 0x80)) | ((three == 0xE1) & (two == 0x9A) & (last == 0x80))
        letter = _ASCII_LETTER[last] | (_LATIN_LEAD[two] & ((last & 0xC0) == 0x80) & ~((two == 0xC3) & ((last == 0x97) | (last == 0xB7))))
        start[1:n] = (K.SPACE[cur] & ~K.SPACE[last] & ~wide) | (letter & (cur < 0x80) & ~_ASCII_LETTER[cur])
    start[offsets] = True
    return np.flatnonzero(start[:n])


class Encoder:
    """Ids of texts, with a bounded cache of pieces."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [x.content.encode() for x in self.tokenizer.get_added_tokens_decoder().values() if x.content]
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 65536 else "<u4")
        spec = json.loads(Path(path).read_text())
        pre = spec.get("pre_tokenizer") or {}
        plain = not any(x.get("single_word") or x.get("lstrip") or x.get("rstrip") for x in spec.get("added_tokens") or [])
        self.by_piece = plain and not spec.get("normalizer") and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
        self._forget()

    def _forget(self) -> None:
        size = 1 << SLOT_BITS
        self.key, self.check = np.zeros(size, K.U64), np.zeros(size, K.U64)
        self.first, self.count = np.zeros(size, np.int32), np.full(size, -1, np.int32)
        self.ids, self.used = np.full(1 << 16, END, self.kind), 1  # the first id kept is the end

    def _keep(self, new: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        """Where each list's ids are kept, and how many."""
        count = np.array([len(x) for x in new], np.int64)
        upto = self.used + int(count.sum())
        if upto > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(upto, self.kind)])
        self.ids[self.used : upto] = np.fromiter((i for x in new for i in x), self.kind, upto - self.used)
        first = self.used + np.cumsum(count) - count
        self.used = upto
        return first, count

    def _whole(self, buf: np.ndarray, starts: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """starts without those inside texts that hold an added token's content, or all of them for other tokenizers."""
        if not self.by_piece:
            return np.unique(offsets[:-1][np.diff(offsets) > 0])
        text, odd = buf.tobytes(), set()
        for content in self.added:
            at = text.find(content)
            while at >= 0:
                odd.add(int(np.searchsorted(offsets, at, "right")) - 1)
                at = text.find(content, at + 1)
        for d in odd:
            starts = starts[(starts <= offsets[d]) | (starts >= offsets[d + 1])]
        return starts

    def _encoded(self, pieces: list[str]) -> list[list[int]]:
        """Ids of pieces.  Those that start with white space and end in a character of ASCII that is none are encoded as
        one text, in which they are cut apart as in any other; a token belongs to the piece in which it starts."""
        out: list[list[int]] = [[] for _ in pieces]
        joint = [k for k, x in enumerate(pieces) if x[0] in _WHITE and "!" <= x[-1] <= "~"] if self.by_piece else []
        for j in range(0, len(joint), JOINT):
            some = joint[j : j + JOINT]
            ends = np.cumsum([len(pieces[k]) for k in some])
            e = self.tokenizer.encode("".join(pieces[k] for k in some), add_special_tokens=False)
            of = np.searchsorted(ends, np.array([a for a, _ in e.offsets], np.int64), "right")
            ids, cut = e.ids, np.searchsorted(of, np.arange(len(some) + 1)).tolist()
            for k, a, b in zip(some, cut, cut[1:], strict=False):
                out[k] = ids[a:b]
        alone = [k for k, x in enumerate(out) if not x]
        for j in range(0, len(alone), JOINT):
            some = alone[j : j + JOINT]
            for k, e in zip(some, self.tokenizer.encode_batch([pieces[k] for k in some], add_special_tokens=False), strict=True):
                out[k] = e.ids
        return out

    def slice(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts buf[offsets[i]:offsets[i + 1]], an end after each, and how many each has."""
        if self.used > KEPT_IDS:
            self._forget()
        starts = self._whole(buf, piece_starts(buf, offsets), offsets)
        ends = np.append(starts[1:], len(buf))
        key = K.Poly(K.byte_values(buf)).of(starts, ends)
        check = K.Poly2(K.second_values(buf)).of(starts, ends)
        slot = (key >> K.U64(64 - SLOT_BITS)).astype(np.int64)
        first, count = self.first[slot].astype(np.int64), self.count[slot].astype(np.int64)
        new = np.flatnonzero((self.key[slot] != key) | (self.check[slot] != check) | (count < 0))
        if len(new):
            order, group = K.pair_groups(key[new], check[new])
            one = new[order[group]]
            text = buf.tobytes()
            pieces = [text[a:b].decode() for a, b in zip(starts[one].tolist(), ends[one].tolist(), strict=True)]
            at, n = self._keep(self._encoded(pieces))
            of = K.group_of(group, len(new))
            first[new[order]], count[new[order]] = at[of], n[of]
            small = ends[one] - starts[one] <= PIECE_BYTES
            s = slot[one[small]]
            self.key[s], self.check[s], self.first[s], self.count[s] = key[one[small]], check[one[small]], at[small], n[small]
            # of pieces that share a slot the last stays, in all four arrays alike
        doc = np.searchsorted(starts, offsets)
        first, count = np.insert(first, doc[1:], 0), np.insert(count, doc[1:], 1)
        where = np.repeat(first - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
        return self.ids[where], K.per_doc(count, doc + np.arange(len(doc)))

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text, its end included."""
        out = []
        for _, _, buf, offsets in K.text_slices(pa.array(texts, pa.string()), TEXT_BYTES):
            ids, count = self.slice(buf, offsets)
            out.extend(np.split(ids, np.cumsum(count)[:-1]))
        return out


@lru_cache(maxsize=1)
def encoder_of(path: str) -> Encoder:
    """A worker's encoder, with what its cache holds from task to task."""
    return Encoder(path)


class Writer:
    """One Arrow file of sequences, filled from a stream of ids."""

    def __init__(self, sink, kind: np.dtype, length: int = SEQUENCE, rows: int = BATCH):
        value = pa.from_numpy_dtype(kind)
        self.schema = pa.schema([("ids", pa.list_(value, length)), ("mask", pa.list_(pa.bool_(), length))], metadata={"sequence": str(length), "rows": str(rows)})
        self.kind, self.length, self.room = kind, length, rows * length
        self.file, self.held, self.size = pa.ipc.new_file(sink, self.schema), [], 0

    def add(self, ids: np.ndarray) -> None:
        self.held.append(ids)
        self.size += len(ids)
        if self.size >= self.room:
            whole = np.concatenate(self.held)
            cut = len(whole) - len(whole) % self.room
            for k in range(0, cut, self.room):
                self._batch(whole[k : k + self.room])
            self.held, self.size = [whole[cut:]], len(whole) - cut

    def _batch(self, ids: np.ndarray) -> None:
        rows = -(-len(ids) // self.length)
        full = np.zeros(rows * self.length, self.kind)
        full[: len(ids)] = ids
        mask = np.arange(len(full)) < len(ids)
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (full, mask)]
        self.file.write_batch(pa.RecordBatch.from_arrays(lists, schema=self.schema))

    def close(self) -> None:
        if self.size:
            self._batch(np.concatenate(self.held))
        self.file.close()


def placed(fs: pafs.FileSystem, path: str, write) -> None:
    """write(sink) to a name of this attempt, then moved to path."""
    temporary = f"{path}.{uuid.uuid4().hex}"
    with fs.open_output_stream(temporary) as sink:
        write(sink)
    fs.move(temporary, path)


def write_tokens(docs: DataFrame, tokenizer: str | None = None, folder: str | None = None) -> DataFrame:
    """Writes the files; the stored manifest has a row a file: part, ids, docs, path, first id."""
    spark = prepare(docs.sparkSession)
    tokenizer, folder = tokenizer or default_tokenizer(), folder or f"{shared_dir(spark)}/tokens"
    total = text_bytes(docs)
    parts = total // max(PART_BYTES, math.isqrt(total << 10)) + 1
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    order = F.col("doc_id").asc_nulls_last(), F.col("th").asc()
    docs = docs.withColumn("th", F.xxhash64("text")).repartitionByRange(parts, *order).sortWithinPartitions(*order).drop("th")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = encoder_of(tokenizer), TaskContext.get().partitionId()
        fs, base = pafs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        path, ids, counts = f"{base}/part-{part:06d}", [], []

        def fill(sink) -> None:
            writer = Writer(sink, encoder.kind)
            for b in batches:
                ids.append(b.column(0))
                for _, _, buf, offsets in K.text_slices(b.column(1), TEXT_BYTES):
                    tokens, count = encoder.slice(buf, offsets)
                    counts.append(count)
                    writer.add(tokens)
            writer.close()

        placed(fs, f"{path}.arrow", fill)
        counts = np.concatenate(counts) if counts else np.zeros(0, np.int64)
        index = pa.table({"doc_id": pa.chunked_array(ids, pa.int64()), "n_tokens": pa.array(counts, pa.int64())})

        def fill_index(sink) -> None:
            with pa.ipc.new_file(sink, index.schema) as f:
                f.write_table(index)

        placed(fs, f"{path}.docs.arrow", fill_index)
        release()
        yield pa.RecordBatch.from_pydict({"part": [part], "ids": pa.array([int(counts.sum())], pa.int64()), "docs": pa.array([len(counts)], pa.int64()), "file": [f"{folder}/part-{part:06d}"]}, pa.schema([("part", pa.int64()), ("ids", pa.int64()), ("docs", pa.int64()), ("file", pa.string())]))

    manifest = stored(docs.mapInArrow(run, "part long, ids long, docs long, file string"), "manifest")
    before = F.sum("ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))  # a row a file of PART_BYTES
    return manifest.withColumn("start", F.coalesce(before, F.lit(0)).cast("long"))


def opened(name: str) -> pa.ipc.RecordBatchFileReader:
    """An Arrow file, memory-mapped where its folder is local."""
    fs, path = pafs.FileSystem.from_uri(name)
    return pa.ipc.open_file(pa.memory_map(path) if isinstance(fs, pafs.LocalFileSystem) else fs.open_input_file(path))


class Sequences:
    """Random access to one part's sequences: a batch is found by division, read alone, and sliced without a copy."""

    def __init__(self, file: str):
        self.reader = opened(f"{file}.arrow")
        self.length, self.rows = (int(self.reader.schema.metadata[k]) for k in (b"sequence", b"rows"))
        self.at, self.held = -1, None

    def __len__(self) -> int:
        n = self.reader.num_record_batches
        return (n - 1) * self.rows + self._batch(n - 1).num_rows if n else 0

    def _batch(self, k: int) -> pa.RecordBatch:
        if k != self.at:
            self.at, self.held = k, self.reader.get_batch(k)
        return self.held

    def sequence(self, i: int) -> tuple[np.ndarray, pa.Array]:
        """Ids and mask of sequence i."""
        batch, row = self._batch(i // self.rows), i % self.rows
        return batch.column("ids")[row].values.to_numpy(zero_copy_only=True), batch.column("mask")[row].values

    def span(self, start: int, n: int) -> np.ndarray:
        """n ids from the part's id start on; a copy only where they cross batches."""
        room, out = self.rows * self.length, []
        while n:
            k, within = divmod(start, room)
            ids = self._batch(k).column("ids").flatten().to_numpy(zero_copy_only=True)[within : within + n]
            out.append(ids)
            start, n = start + len(ids), n - len(ids)
        return out[0] if len(out) == 1 else np.concatenate(out)


def read_tokens(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files."""
    kinds = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                part, index, at = Sequences(row["file"]), opened(f"{row['file']}.docs.arrow"), 0
                for k in range(index.num_record_batches):
                    docs = index.get_batch(k)
                    n = docs.column("n_tokens").to_numpy()
                    first = at + np.cumsum(n) - n
                    crc = [zlib.crc32(part.span(s, c).astype("<u4").tobytes()) for s, c in zip(first.tolist(), n.tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([docs.column("doc_id"), pa.array(first + row["start"]), docs.column("n_tokens"), pa.array(crc, pa.int64())], schema=kinds)
                    at += int(n.sum())

    files = manifest.select("part", "file", "start").where("docs > 0")
    spread = max(1, int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return files.repartition(spread, "part").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op9_arrow_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_tokens(write_tokens(table(spark, sf_dir, "documents")))
