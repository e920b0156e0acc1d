"""Token ids as patched frame-of-reference files.

Documents are range-partitioned by id; each task encodes its documents in order and writes one file of blocks: ids
minus the block's minimum, packed at a width that a percentile of the block fits, the others' high bits in an
exception list.  A footer indexes the start of every block and every document.  Files are named by task attempt and
only those of finished tasks enter the index, so a repeated task leaves no trace in the result.

File: magic, blocks, footer (little-endian: number of documents, ids, has-id flags, starts; number of blocks, offsets;
number of tokens), footer offset, magic.  Block: count u16, width u8, exceptions u16, minimum u32, packed bits
(least significant first), exception positions u16, exception high bits u32.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import NULL_ID, id_of, new_folder, open_filesystem, text_of, written
from .pieces import PieceCache, Words, held, ragged, slices
from .token_count import byte_symbols

MAGIC = b"PFOR0001"
BLOCK = 256
HEAD = struct.Struct("<HBHI")
#: Text bytes that are encoded at a time.
ENCODE_BYTES = 8 << 20
#: Blocks that are packed or read at a time.
GROUP = 1024


# ------------------------------------------------------------------------------------------------ codec

def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """(n, count) values below 2^width -> (n, bytes), least significant bit first."""
    if width in (8, 16, 32):
        return np.ascontiguousarray(values.astype(f"<u{width // 8}")).view(np.uint8)
    size = 2 if width <= 16 else 4
    bits = np.unpackbits(np.ascontiguousarray(values.astype(f"<u{size}")).view(np.uint8)
                         .reshape(*values.shape, size), axis=2, bitorder="little")[:, :, :width]
    return np.packbits(bits.reshape(len(values), -1), axis=1, bitorder="little")


def _unpack(packed: np.ndarray, count: int, width: int) -> np.ndarray:
    if width == 0:
        return np.zeros((len(packed), count), dtype=np.uint32)
    if width in (8, 16, 32):
        return np.ascontiguousarray(packed).view(f"<u{width // 8}").astype(np.uint32)
    size = 16 if width <= 16 else 32
    bits = np.unpackbits(packed, axis=1, count=count * width, bitorder="little").reshape(len(packed), count, width)
    full = np.zeros((len(packed), count, size), dtype=np.uint8)
    full[:, :, :width] = bits
    return np.packbits(full, axis=2, bitorder="little").view(f"<u{size // 8}")[:, :, 0].astype(np.uint32)


def encode_blocks(ids: np.ndarray, block: int = BLOCK, share: float = 0.99) -> list[bytes]:
    """The blocks of ``ids`` (uint32): all of ``block`` values but the last."""
    out = []
    whole = len(ids) // block * block
    for part in (ids[:whole].reshape(-1, block), ids[whole:].reshape(1, -1)):
        n, count = part.shape
        if not n or not count:
            continue
        low = part.min(axis=1)
        delta = part - low[:, None]
        at = min(count - 1, int(np.ceil(share * count)) - 1)
        widths = np.frexp(np.partition(delta, at, axis=1)[:, at].astype(np.float64))[1]
        blocks = [b""] * n
        for width in np.unique(widths).tolist():
            rows = np.flatnonzero(widths == width)
            own = delta[rows]
            packed = _pack(own & np.uint32((1 << width) - 1), width) if width else np.empty((len(rows), 0), np.uint8)
            high = own >> np.uint32(width) if width < 32 else np.zeros_like(own)
            over, where = np.nonzero(high)
            first = np.searchsorted(over, np.arange(len(rows) + 1))
            where16, high32 = where.astype("<u2"), high[over, where].astype("<u4")
            for i, row in enumerate(rows.tolist()):
                a, b = first[i], first[i + 1]
                blocks[row] = HEAD.pack(count, width, b - a, int(low[row])) + packed[i].tobytes() \
                    + where16[a:b].tobytes() + high32[a:b].tobytes()
        out += blocks
    return out


def decode_blocks(data: bytes, starts: list[int]) -> np.ndarray:
    """The ids of the blocks that begin at ``starts`` in ``data``."""
    heads = np.array([HEAD.unpack_from(data, s) for s in starts], dtype=np.int64).reshape(-1, 4)
    ends = np.cumsum(heads[:, 0])
    out = np.empty(int(ends[-1]) if len(ends) else 0, dtype=np.uint32)
    for count, width in {(c, w) for c, w, _, _ in heads.tolist()}:
        rows = np.flatnonzero((heads[:, 0] == count) & (heads[:, 1] == width))
        size = (count * width + 7) // 8
        at = [starts[i] + HEAD.size for i in rows.tolist()]
        values = _unpack(np.frombuffer(b"".join([data[p:p + size] for p in at]), np.uint8).reshape(len(rows), size),
                         count, width)
        over = heads[rows, 2]
        if over.any():
            bounds = [(p + size, n) for p, n in zip(at, over.tolist())]
            where = np.frombuffer(b"".join([data[p:p + 2 * n] for p, n in bounds]), "<u2")
            high = np.frombuffer(b"".join([data[p + 2 * n:p + 6 * n] for p, n in bounds]), "<u4")
            values[np.repeat(np.arange(len(rows)), over), where] |= high << np.uint32(width)
        values += heads[rows, 3].astype(np.uint32)[:, None]
        out[(ends[rows] - count)[:, None] + np.arange(count)] = values
    return out


class Writer:
    """One file: ``add_all`` documents in order, then ``close``."""

    def __init__(self, stream):
        self.stream, self.at = stream, 0
        self.ids, self.known, self.starts, self.offsets = [], [], [], []
        self.buffer, self.buffered, self.tokens = [], 0, 0
        self._put(MAGIC)

    def _put(self, data: bytes):
        self.stream.write(data)
        self.at += len(data)

    def add_all(self, doc_ids: list, ids: np.ndarray, size: np.ndarray):
        """Documents in order: their ids (None for a null one), all their tokens, the tokens of each."""
        self.ids += [i or 0 for i in doc_ids]
        self.known += [i is not None for i in doc_ids]
        self.starts += (self.tokens + np.cumsum(size) - size).tolist()
        self.tokens += len(ids)
        self.buffer.append(ids)
        self.buffered += len(ids)
        if self.buffered >= GROUP * BLOCK:
            self._flush(False)

    def _flush(self, end: bool):
        ids = np.concatenate(self.buffer).astype(np.uint32) if self.buffer else np.empty(0, np.uint32)
        cut = len(ids) if end else len(ids) // BLOCK * BLOCK
        for at in range(0, cut, GROUP * BLOCK):
            blocks = encode_blocks(ids[at:min(at + GROUP * BLOCK, cut)])
            for b in blocks:
                self.offsets.append(self.at)
                self.at += len(b)
            self.stream.write(b"".join(blocks))
        self.buffer, self.buffered = [ids[cut:]], len(ids) - cut

    def close(self):
        self._flush(True)
        at = self.at
        n, m = len(self.ids), len(self.offsets)
        self._put(struct.pack("<Q", n) + np.array(self.ids, "<i8").tobytes() + np.array(self.known, "u1").tobytes()
                  + np.array(self.starts, "<u8").tobytes() + struct.pack("<Q", m)
                  + np.array(self.offsets, "<u8").tobytes() + struct.pack("<Q", self.tokens))
        self._put(struct.pack("<Q", at) + MAGIC)


class Reader:
    """Random access to one file (a seekable stream): documents in order, or any range of blocks."""

    def __init__(self, stream, size: int):
        self.stream = stream
        at, magic = struct.unpack("<Q8s", self._range(size - 16, 16))
        if magic != MAGIC or self._range(0, 8) != MAGIC:
            raise ValueError("not a token file")
        foot = self._range(at, size - 16 - at)
        n, = struct.unpack_from("<Q", foot)
        p = 8
        self.ids = np.frombuffer(foot, "<i8", n, p)
        self.known = np.frombuffer(foot, "u1", n, p + 8 * n)
        self.starts = np.frombuffer(foot, "<u8", n, p + 9 * n).astype(np.int64)
        p += 17 * n
        m, = struct.unpack_from("<Q", foot, p)
        self.offsets = np.append(np.frombuffer(foot, "<u8", m, p + 8), at).astype(np.int64)
        self.tokens, = struct.unpack_from("<Q", foot, p + 8 + 8 * m)

    def _range(self, at: int, size: int) -> bytes:
        self.stream.seek(at)
        return self.stream.read(size)

    def blocks(self, first: int, last: int) -> np.ndarray:
        """The ids of blocks first to last, the last excluded."""
        lo, hi = int(self.offsets[first]), int(self.offsets[last])
        return decode_blocks(self._range(lo, hi - lo), (self.offsets[first:last] - lo).tolist())

    def documents(self):
        """(doc_id or None, start in the file, number of ids, CRC-32 of the ids as little-endian u32)."""
        ends = np.append(self.starts[1:], self.tokens)
        doc, crc, at = 0, 0, 0
        for first in range(0, len(self.offsets) - 1, GROUP):
            ids = self.blocks(first, min(first + GROUP, len(self.offsets) - 1)).astype("<u4")
            end = at + len(ids)
            while doc < len(self.ids):
                a, b = max(int(self.starts[doc]), at), min(int(ends[doc]), end)
                crc = zlib.crc32(ids[a - at:b - at], crc) if b > a else crc
                if ends[doc] > end:
                    break
                yield self._document(doc, ends, crc)
                doc, crc = doc + 1, 0
            at = end
        while doc < len(self.ids):  # empty documents at the end
            yield self._document(doc, ends, crc)
            doc, crc = doc + 1, 0

    def _document(self, doc, ends, crc):
        return (int(self.ids[doc]) if self.known[doc] else None, int(self.starts[doc]),
                int(ends[doc] - self.starts[doc]), crc)


# ------------------------------------------------------------------------------------------------ encoding

class PieceEncoder:
    """Texts -> ids with the tokenizers library, each distinct word between spaces encoded once per cache life.

    For vocabularies whose pre-tokenizer drops white space: tokens never span it, so words are independent.  A full
    stop or comma after what the library's normalizer leaves as a letter is a pre-token of its own and is looked up
    apart (a letter whose normal form ends in a combining mark is none).  A word of Latin letters is one
    pre-token: where the library's normalizer could only lower-case it, it goes straight to the library's model."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        self.direct = self._plain_letters_go_direct()
        self.stems = PieceCache(self._encode)
        self.letters: dict[str, bool] = {}

    def _tokens(self, word: str) -> list[int]:
        printable = word if word.isascii() else word.encode().decode("latin-1").translate(_PRINTABLE)
        return [t.id for t in self.model.tokenize(printable)]

    def _plain_letters_go_direct(self) -> bool:
        """Does the file's pipeline treat words of letters as its model alone does?"""
        probe = ["Hello", "straße", "éÀñ", "x"]
        return all(self.library.encode(w, add_special_tokens=False).ids == self._tokens(w.lower()) for w in probe)

    def _encode(self, stems: list[str]) -> list[bytes]:
        out, rest = [], []
        for i, s in enumerate(stems):
            low = s.lower()
            if self.direct and low.isalpha() and (low.isascii() or max(low) < "\u0250"):
                out.append(array("I", self._tokens(low)).tobytes())
            else:
                rest.append(i)
                out.append(b"")
        for i, e in zip(rest, self.library.encode_batch_fast([stems[i] for i in rest], add_special_tokens=False)):
            out[i] = array("I", e.ids).tobytes()
        return out

    def _stays_letter(self, letter: str) -> bool:
        """Does the letter's normal form still end in a letter?"""
        if letter not in self.letters:
            normal = self.library.normalizer.normalize_str(letter) if self.library.normalizer is not None else letter
            self.letters[letter] = normal[-1:].isalpha()
        return self.letters[letter]

    def _ids(self, words: list[str]) -> list[bytes]:
        """The ids of distinct words, as bytes of native unsigned 32-bit integers."""
        stems, place, cut = {}, [], []
        for i, w in enumerate(words):
            if w and w[-1] in ".," and len(w) > 1 and w[-2].isalpha() and (w[-2].isascii() or self._stays_letter(w[-2])):
                cut.append(i)
                w = w[:-1]
            place.append(stems.setdefault(w, len(stems)))
        marks = {m: stems.setdefault(m, len(stems)) for m in ".,"}
        ids = self.stems.values(list(stems))
        out = [ids[p] for p in place]
        for i in cut:
            out[i] += ids[marks[words[i][-1]]]
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids (uint32) and the number of ids of each text."""
        words = Words(pc.replace_substring(texts, "\n", " "))
        ids, size = ragged(self._ids(words.distinct), words.index, "u4")
        return ids, words.sums(size)


#: Bytes, as Latin-1 characters, to the printable alphabet of byte-level vocabularies.
_PRINTABLE = {byte: char for char, byte in byte_symbols().items()}


def encoder_of(path: str) -> PieceEncoder:
    """The encoder of this worker, with its cache."""
    return held(("encoder", path), lambda: PieceEncoder(path))


def write_token_files(docs: DataFrame, vocabulary: str, folder: str, end_id: int = 1) -> DataFrame:
    """Writes the files in ascending id order (null ids first, rows with equal ids by a hash of their texts, so that
    they may fill many files) and returns their index: path, first_id, first_hash, n_docs, n_tokens; one row per file.
    Every document ends with ``end_id``; null texts are empty; an empty table writes no file."""
    def write(batches):
        encoder, out = encoder_of(vocabulary), None
        for batch in batches:
            at = 0
            for texts in slices(batch.column(2), ENCODE_BYTES):
                tokens, size = encoder.encode(texts)
                ids = batch.column(0).slice(at, len(texts)).to_pylist()
                if out is None and ids:
                    first_hash = batch.column(1)[at].as_py()
                    fs, root = open_filesystem(folder)
                    fs.create_dir(root, recursive=True)
                    name, first = f"tokens-{uuid.uuid4().hex}.pfor", ids[0]
                    stream = fs.open_output_stream(f"{root}/{name}", compression=None)
                    out = Writer(stream)
                at += len(texts)
                ends = np.cumsum(size)
                out.add_all([None if i == NULL_ID else i for i in ids], np.insert(tokens, ends, end_id), size + 1)
        if out is not None:
            out.close()
            stream.close()
            yield pa.RecordBatch.from_pylist([{"path": f"{folder}/{name}", "first_id": first, "first_hash": first_hash,
                                               "n_docs": len(out.ids), "n_tokens": out.tokens}], pa.schema([
                ("path", pa.string()), ("first_id", pa.int64()), ("first_hash", pa.int64()), ("n_docs", pa.int64()),
                ("n_tokens", pa.int64())]))

    text = text_of()
    rows = docs.select(id_of().alias("did"), F.xxhash64(text).alias("th"), text.alias("text"))
    return rows.repartitionByRange("did", "th").sortWithinPartitions("did", "th") \
        .mapInArrow(write, "path string, first_id long, first_hash long, n_docs long, n_tokens long")


def read_token_files(index: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the files of ``index``, read back from them.

    ``start`` counts the ids of all documents before: a running sum over one row per file."""
    based = index.withColumn("base", F.sum("n_tokens").over(
        Window.orderBy("first_id", "first_hash").rowsBetween(Window.unboundedPreceding, -1)))

    def read(batches):
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                fs, name = open_filesystem(path)
                with fs.open_input_file(name) as stream:
                    rows = list(Reader(stream, stream.size()).documents())
                for at in range(0, len(rows), 10_000):
                    i, s, n, c = zip(*rows[at:at + 10_000])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(i, pa.int64()), pa.array([x + base for x in s], pa.int64()),
                         pa.array(n, pa.int64()), pa.array(c, pa.int64())],
                        ["doc_id", "start", "n_tokens", "ids_crc32"])

    files = max(1, index.count())
    return based.select("path", F.coalesce("base", F.lit(0).cast("long")).alias("base")).repartition(files) \
        .mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_output(docs: DataFrame, vocabulary: str, end_id: int = 1) -> DataFrame:
    """Writes token files of ``docs`` in the shared folder and returns what they hold per document."""
    index = written(write_token_files(docs, vocabulary, new_folder(docs.sparkSession, "tokens"), end_id),
                    "token-index")
    return read_token_files(index)
