"""Byte-level BPE encoding and decoding with segment trees.

Every pre-token has a segment tree over its adjacent pairs: a leaf holds the pair's rank and position, an inner node
the lesser of its children, so the root is the leftmost pair of lowest rank.  A merge changes the pair itself and its
two neighbours; their paths to the root are renewed, and the next root is read, until no pair has a rank.  Pre-tokens
of a batch do this side by side, as rows of one array of trees; long ones one at a time.
"""

from __future__ import annotations

import hashlib
import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import once, text_of
from .pieces import IRREGULAR, PieceCache, Words, held, ragged, slices, space_pieces
from .token_count import NO_RANK, PairTable, byte_symbols

#: Longer pre-tokens (in bytes) get a tree of their own.
WIDE = 128
#: Leaves of the trees that are worked on side by side.
BATCH_LEAVES = 1 << 18
NONE = np.int64(1) << np.int64(62)


# ------------------------------------------------------------------------------------------------ segment trees

def merge_side_by_side(symbols: np.ndarray, lengths: np.ndarray, table: PairTable) -> tuple[np.ndarray, np.ndarray]:
    """Merges every row of ``symbols`` (rows x 2^k, row i has lengths[i] symbols); returns symbols and which survive."""
    rows, width = symbols.shape
    symbols = np.concatenate((symbols, np.zeros((rows, 1), symbols.dtype)), axis=1)
    alive = np.arange(width) < lengths[:, None]
    left = np.tile(np.arange(-1, width), (rows, 1)).astype(np.int64)  # the living neighbour before, -1 for none
    right = np.tile(np.arange(1, width + 2), (rows, 1)).astype(np.int64)
    into = np.zeros((rows, width), np.int32)
    tree = np.full((rows, 2 * width), NONE)
    at, pos = np.nonzero(np.arange(1, width + 1) < lengths[:, None])
    rank, into[at, pos] = table.find(symbols[at, pos], symbols[at, pos + 1])
    tree[at, width + pos] = np.where(rank == NO_RANK, NONE, rank.astype(np.int64) * width + pos)
    level = width
    while level > 1:
        half = level // 2
        tree[:, half:level] = np.minimum(tree[:, level:2 * level:2], tree[:, level + 1:2 * level:2])
        level = half

    def set_pair(row, p):
        """The leaf of the pair that begins at p, after a change of one of its symbols."""
        q = right[row, p]
        whole = q < lengths[row]
        leaf = np.full(len(row), NONE)
        r, a, b = row[whole], p[whole], q[whole]
        rank, into[r, a] = table.find(symbols[r, a], symbols[r, b])
        leaf[whole] = np.where(rank == NO_RANK, NONE, rank.astype(np.int64) * width + a)
        tree[row, width + p] = leaf

    row = np.flatnonzero(tree[:, 1] < NONE) if width > 1 else np.empty(0, np.int64)
    while len(row):
        pos = tree[row, 1] % width
        gone = right[row, pos]
        after, before = right[row, gone], left[row, pos]
        symbols[row, pos] = into[row, pos]
        alive[row, gone] = False
        right[row, pos] = after
        left[row, np.minimum(after, width)] = pos
        set_pair(row, pos)
        tree[row, width + gone] = NONE
        has = before >= 0
        set_pair(row[has], before[has])
        nodes = [(row, width + pos), (row, width + gone), (row[has], width + before[has])]
        for _ in range(width.bit_length() - 1):
            nodes = [(r, n >> 1) for r, n in nodes]
            for r, n in nodes:
                tree[r, n] = np.minimum(tree[r, 2 * n], tree[r, 2 * n + 1])
        row = row[tree[row, 1] < NONE]
    return symbols[:, :width], alive


def merge_alone(symbols: list[int], merges: dict[tuple[int, int], tuple[int, int]]) -> list[int]:
    """Merges one long sequence with the pairs of ``merges``: (left, right) -> (rank, merged symbol)."""
    n = len(symbols)
    width = 1 << max(1, (n - 1).bit_length())
    none = (1 << 62, 0)
    tree = [none] * (2 * width)
    for i in range(n - 1):
        found = merges.get((symbols[i], symbols[i + 1]))
        if found is not None:
            tree[width + i] = (found[0], i)
    for k in range(width - 1, 0, -1):
        tree[k] = min(tree[2 * k], tree[2 * k + 1])
    symbols = list(symbols)
    left, right = list(range(-1, n)), list(range(1, n + 1))

    def renew(i, leaf):
        k = width + i
        tree[k] = leaf
        while k > 1:
            k >>= 1
            tree[k] = min(tree[2 * k], tree[2 * k + 1])

    def pair(i):
        found = merges.get((symbols[i], symbols[right[i]])) if right[i] < n else None
        return none if found is None else (found[0], i)

    while tree[1] is not none:
        i = tree[1][1]
        gone = right[i]
        symbols[i] = merges[symbols[i], symbols[gone]][1]
        symbols[gone] = -1
        right[i] = right[gone]
        left[right[i]] = i
        renew(gone, none)
        renew(i, pair(i))
        if left[i] >= 0:
            renew(left[i], pair(left[i]))
    return [s for s in symbols if s >= 0]


# ------------------------------------------------------------------------------------------------ the codec

class Codec:
    """Texts to ids and back for a byte-level BPE vocabulary file of the tokenizers library."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        left, right, into = ([vocab[p] for p in part] for part in zip(*((a, b, a + b) for a, b in merges)))
        self.table = PairTable(left, right, into)
        self.merges = {}
        for rank, (a, b, c) in enumerate(zip(left, right, into)):
            self.merges.setdefault((a, b), (rank, c))
        byte_of = byte_symbols()
        self.symbol = np.zeros(512, dtype=np.int32)
        for char in byte_of:
            self.symbol[ord(char)] = vocab[char]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of = [b""] * (1 + max([*vocab.values(), *self.special.values()]))
        for token, i in vocab.items():
            self.bytes_of[i] = bytes(map(byte_of.__getitem__, token)) if byte_of.keys() >= set(token) else token.encode()
        for token, i in self.special.items():
            self.bytes_of[i] = token.encode()
        self.pre = Tokenizer.from_file(path).pre_tokenizer
        self.words = PieceCache(self._encode_words)
        self.inner, self.first = PieceCache(self._encode_inner), PieceCache(lambda p: [self._encode_plain(t) for t in p])

    def _encode_words(self, words: list[str]) -> list[bytes]:
        """Ids (as u4 bytes) of pre-tokens in the printable alphabet; equal widths of trees go side by side."""
        out = [b""] * len(words)
        size = np.fromiter(map(len, words), np.int64, len(words))
        width = np.int64(1) << np.ceil(np.log2(np.maximum(size, 2))).astype(np.int64)
        for w in np.unique(width).tolist():
            which = np.flatnonzero(width == w)
            if w > WIDE:
                for i in which.tolist():
                    symbols = self.symbol[np.frombuffer(words[i].encode("utf-32-le"), "<u4")].tolist()
                    out[i] = np.array(merge_alone(symbols, self.merges), "<u4").tobytes()
                continue
            for part in np.array_split(which, -(-len(which) * w // BATCH_LEAVES)):
                flat = self.symbol[np.frombuffer("".join([words[i] for i in part.tolist()]).encode("utf-32-le"), "<u4")]
                symbols = np.zeros((len(part), w), np.int32)
                symbols[np.arange(w) < size[part][:, None]] = flat
                symbols, alive = merge_side_by_side(symbols, size[part], self.table)
                ids, n = symbols[alive].astype("<u4").tobytes(), alive.sum(axis=1)
                ends = 4 * np.cumsum(n)
                for i, a, b in zip(part.tolist(), (ends - 4 * n).tolist(), ends.tolist()):
                    out[i] = ids[a:b]
        return out

    def _pretokens(self, text: str) -> tuple[list[str], dict[str, bytes]]:
        """The pre-tokens of ``text`` in the printable alphabet (a character is a byte), and the ids of each."""
        words = [w for w, _ in self.pre.pre_tokenize_str(text)]
        distinct = list(set(words))
        return words, dict(zip(distinct, self.words.values(distinct)))

    def _encode_plain(self, text: str) -> bytes:
        words, ids = self._pretokens(text)
        return b"".join(map(ids.__getitem__, words))

    def _encode_inner(self, pieces: list[str]) -> list[bytes]:
        """Pieces that follow a space.  Those that end in no white space are pre-tokenized in one call, joined."""
        out = [b""] * len(pieces)
        plain = [i for i, p in enumerate(pieces) if p and not p[-1].isspace()]
        for i in set(range(len(pieces))).difference(plain):
            out[i] = self._encode_plain(" " + pieces[i])
        joined = [" " + pieces[i] for i in plain]
        words, ids = self._pretokens("".join(joined))
        stream = iter(words)
        for i, piece in zip(plain, joined):
            left, own = len(piece.encode()), []
            while left > 0:
                word = next(stream)
                own.append(ids[word])
                left -= len(word)
            out[i] = b"".join(own)
        return out

    def _encode_any(self, text: str) -> bytes:
        """Any text: special strings are their own ids, and what stands between them is encoded by itself."""
        parts = [text]
        for token in self.special:
            parts = [x for part in parts for x in (
                [part] if part in self.special else [y for s in part.split(token) for y in (token, s)][1:])]
        out = []
        for part in parts:
            if part in self.special:
                out.append(self.special[part].to_bytes(4, "little"))
            elif part:
                head, *tail = space_pieces(part)
                distinct = list(set(tail))
                ids = dict(zip(distinct, self.inner.values(distinct)))
                out += self.first.values([head]) + [ids[p] for p in tail]
        return b"".join(out)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids (u4) of the texts and the number of ids of each.  Texts with a special string, or a space after
        other white space, go one by one; the others share their distinct words."""
        odd = pc.match_substring_regex(texts, IRREGULAR)
        for token in self.special:
            odd = pc.or_(odd, pc.match_substring(texts, token))
        odd = odd.to_numpy(zero_copy_only=False)
        words = Words(pc.if_else(pa.array(odd), "", texts))
        values = self.inner.values(words.distinct)
        heads, place = np.unique(words.index[words.bounds[:-1]], return_inverse=True)
        # the first word of a text follows no space: an entry of its own
        index = words.index.astype(np.int64)
        index[words.bounds[:-1]] = len(values) + place
        values = [*values, *self.first.values([words.distinct[i] for i in heads.tolist()])]
        single = np.flatnonzero(odd)
        index[words.bounds[single]] = len(values) + np.arange(len(single))
        values += [self._encode_any(texts[i].as_py()) for i in single.tolist()]
        ids, size = ragged(values, index, "<u4")
        return ids, words.sums(size)

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids, special ones included; bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist())).decode("utf-8", "replace")


def codec_of(path: str) -> Codec:
    """The codec of this worker, with its caches."""
    return held(("codec", path), lambda: Codec(path))


# ------------------------------------------------------------------------------------------------ columns

def encode_column(text, vocabulary: str):
    """array<int> of the ids of each text for the vocabulary file at ``vocabulary`` (the same path everywhere)."""
    @F.arrow_udf("array<int>")
    def ids(texts: pa.Array) -> pa.Array:
        codec, parts = codec_of(vocabulary), []
        for part in slices(texts.fill_null("")):
            flat, size = codec.encode(part)
            parts.append(pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(size)), pa.int32()),
                                                  pa.array(flat.astype(np.int32))))
        return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.int32()))
    return once(ids)(text)


def decode_column(ids, vocabulary: str):
    """The text of each array of ids."""
    @F.arrow_udf("string")
    def texts(arrays: pa.Array) -> pa.Array:
        codec = codec_of(vocabulary)
        return pa.array([None if a is None else codec.decode(np.array(a, np.int64)) for a in arrays.to_pylist()],
                        pa.string())
    return once(texts)(ids)


DIGESTS = "struct<n_tokens:long,ids_sha256:string,decoded_sha256:string>"


def _digest_column(text, vocabulary: str):
    """Count and digest of the ids and digest of the text decoded from them, without keeping either."""
    @F.arrow_udf(DIGESTS)
    def digests(texts: pa.Array) -> pa.Array:
        codec, out = codec_of(vocabulary), []
        for part in slices(texts.fill_null("")):
            ids, size = codec.encode(part)
            ends = np.cumsum(size)
            for a, b in zip((ends - size).tolist(), ends.tolist()):
                own = ids[a:b]
                out.append({"n_tokens": b - a,
                            "ids_sha256": hashlib.sha256(",".join(map(str, own.tolist())).encode()).hexdigest(),
                            "decoded_sha256": hashlib.sha256(codec.decode(own).encode()).hexdigest()})
        return pa.array(out, pa.struct([("n_tokens", pa.int64()), ("ids_sha256", pa.string()),
                                        ("decoded_sha256", pa.string())]))
    return once(digests)(text)


def codec_report(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 per row of ``docs``: whole texts are encoded, the ids decoded.

    A null text is the empty one (no ids); a special string inside a text is its one id, as the library has it; ids of
    rows pass through (null or repeated ones too); an empty table gives no rows."""
    return docs.select("doc_id", _digest_column(text_of(), vocabulary).alias("d")).select("doc_id", "d.*")
