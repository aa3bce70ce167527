"""Token ids in wavelet-matrix shards.

Documents are ordered by id, encoded, and each shard of consecutive documents becomes one wavelet
matrix: one bit-plane per id bit, most significant first, the ids stably parted by each bit. Planes
carry running popcounts, so ``access``, ``rank``, ``select`` and occurrence lookup work on the
compressed planes alone. Spark writes the shards (atomic, on any store), one file per partition.

A null or empty text holds the end id alone. Rows with equal ids are ordered by text. An empty table
writes no shard. Further columns are ignored.
"""

from __future__ import annotations

import codecs
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from recordlake.llm.scratch import tidy
from recordlake.llm.wordcode import range_hashes, slices, text_buffer

SHARD_TOKENS = 4 << 20
BLOCK = 512
#: Bytes of text that are encoded at a time.
SLICE = 2 << 20
SHARD_SCHEMA = "part int, seq int, n_docs long, n_tokens long, doc_ids binary, ends binary, bits int, zeros binary, planes binary"


class WaveletMatrix:
    """Succinct sequence of non-negative ints."""

    def __init__(self, n: int, bits: int, zeros: np.ndarray, planes: np.ndarray):
        self.n, self.bits, self.zeros, self.planes = n, bits, zeros, planes
        self._ranks: list[np.ndarray | None] = [None] * bits

    @classmethod
    def build(cls, ids: np.ndarray, bits: int) -> WaveletMatrix:
        a = ids.astype(np.uint16 if bits <= 16 else np.uint32)
        zeros, planes = np.zeros(bits, np.int64), np.zeros((bits, -(-len(a) // 8)), np.uint8)
        for level in range(bits):
            one = (a & a.dtype.type(1 << (bits - 1 - level))) != 0
            planes[level] = np.packbits(one, bitorder="little")
            left = a[~one]
            zeros[level] = len(left)
            a = np.concatenate([left, a[one]])
        return cls(len(ids), bits, zeros, planes)

    def to_bytes(self) -> bytes:
        return zstandard.ZstdCompressor(level=1).compress(self.planes.tobytes())

    @classmethod
    def from_bytes(cls, n: int, bits: int, zeros: bytes, planes: bytes) -> WaveletMatrix:
        width = -(-n // 8)
        raw = zstandard.ZstdDecompressor().decompress(planes, max_output_size=max(1, bits * width)) if bits * width else b""
        return cls(n, bits, np.frombuffer(zeros, "<i8"), np.frombuffer(raw, np.uint8).reshape(bits, width))

    def decode(self) -> np.ndarray:
        """The whole sequence: planes are undone from the least significant up."""
        kind = np.uint16 if self.bits <= 16 else np.uint32
        a = np.zeros(self.n, kind)
        for level in range(self.bits - 1, -1, -1):
            one = np.unpackbits(self.planes[level], count=self.n, bitorder="little").view(bool)
            b = np.empty(self.n, kind)
            z = int(self.zeros[level])
            b[~one] = a[:z]
            b[one] = a[z:] | kind(1 << (self.bits - 1 - level))
            a = b
        return a

    def _ones(self, level: int, i: int) -> int:
        """Ones among the first ``i`` bits of a plane."""
        if self._ranks[level] is None:
            ones = np.bitwise_count(self.planes[level]).astype(np.int64)
            self._ranks[level] = np.concatenate([[0], np.add.reduceat(ones, np.arange(0, len(ones), BLOCK // 8)).cumsum() if len(ones) else []]).astype(np.int64)
        block = i // BLOCK
        rest = np.unpackbits(self.planes[level, block * BLOCK // 8 : (i + 7) // 8], bitorder="little")[: i - block * BLOCK]
        return int(self._ranks[level][block]) + int(rest.sum())

    def access(self, i: int) -> int:
        value = 0
        for level in range(self.bits):
            bit = int(self.planes[level, i >> 3] >> (i & 7)) & 1
            value = value * 2 + bit
            i = int(self.zeros[level]) + self._ones(level, i) if bit else i - self._ones(level, i)
        return value

    def _range(self, value: int, i: int) -> tuple[int, int]:
        low, high = 0, i
        if value >> self.bits:
            return 0, 0
        for level in range(self.bits):
            a, b = self._ones(level, low), self._ones(level, high)
            if value >> (self.bits - 1 - level) & 1:
                low, high = int(self.zeros[level]) + a, int(self.zeros[level]) + b
            else:
                low, high = low - a, high - b
        return low, high

    def rank(self, value: int, i: int) -> int:
        """Occurrences of ``value`` among the first ``i`` ids."""
        low, high = self._range(value, i)
        return high - low

    def _select_bit(self, level: int, bit: int, k: int) -> int:
        low, high = 0, self.n
        while low < high:
            mid = (low + high) // 2
            have = self._ones(level, mid + 1)
            if (have if bit else mid + 1 - have) > k:
                high = mid
            else:
                low = mid + 1
        return low

    def select(self, value: int, k: int) -> int:
        """Place of occurrence ``k`` (from 0) of ``value``."""
        low, high = self._range(value, self.n)
        if not 0 <= k < high - low:
            raise IndexError(k)
        i = low + k
        for level in range(self.bits - 1, -1, -1):
            if value >> (self.bits - 1 - level) & 1:
                i = self._select_bit(level, 1, i - int(self.zeros[level]))
            else:
                i = self._select_bit(level, 0, i)
        return i

    def occurrences(self, value: int) -> list[int]:
        return [self.select(value, k) for k in range(self.rank(value, self.n))]


_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
#: Texts are cut only where every match of the pre-tokeniser's pattern ends: before a space or newline
#: that follows a visible ASCII or Latin-1 character, and between a Latin letter and an ASCII mark or digit.
_ONE_WORD = re.compile(rf" ?[{_LETTERS}]+")
#: Pieces that may be encoded in one string: they begin with white space and end before it.
_JOINABLE = re.compile(r"[ \n].*[!-~À-ÿ]", re.S)
_BLANK = np.isin(np.arange(256), [0x20, 0x0A])
_ASCII_LETTER = np.array([chr(b).isalpha() and b < 128 for b in range(256)])
_MARK = np.array([0x21 <= b <= 0x7E and not chr(b).isalpha() for b in range(256)])


def piece_starts(data: np.ndarray, text_at: np.ndarray) -> np.ndarray:
    """Where pieces begin in the UTF-8 bytes of texts that begin at ``text_at``."""
    starts = np.zeros(len(data) + 1, bool)
    starts[text_at] = True
    starts = starts[:-1]
    if len(data) > 1:
        before, now = data[:-1], data[1:]
        latin = np.zeros(len(before), bool)  # the last byte of a character from U+00C0 to U+00FF
        latin[1:] = (before[:-1] == 0xC3) & (before[1:] >= 0x80) & (before[1:] <= 0xBF)
        visible = (before > 0x20) & (before < 0x7F)
        letter = _ASCII_LETTER[before] | (latin & (before != 0x97) & (before != 0xB7))
        starts[1:] |= (_BLANK[now] & (visible | latin)) | (_MARK[now] & letter)
    return np.flatnonzero(starts)


def _byte_alphabet() -> str:
    """The byte-level models' printable stand-ins: printable Latin-1 stays, other bytes follow from U+0100.

    The newline stays itself: it is the cut between words.
    """
    stays = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [b for b in range(256) if b not in stays]
    return "".join(chr(b) if b in stays or b == 10 else chr(256 + others.index(b)) for b in range(256))


class PieceEncoder:
    """Encodes texts piece by piece with the library.

    Pieces are told apart by two 64-bit hashes of their bytes; those met first stay in a bounded memo of
    sorted hashes and a pool of ids. Unknown pieces are encoded in a few strings and handed their ids by
    the byte lengths of tokens; single words need no pre-tokeniser but a cut at each line. A text that
    holds an added token's string is encoded whole, as is a slice in which two pieces share one hash.
    """

    MEMO, JOIN = 1_000_000, 5_000

    def __init__(self, tokenizer_file: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import CharDelimiterSplit

        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        self.lines = Tokenizer(self.tokenizer.model)
        self.lines.pre_tokenizer = CharDelimiterSplit("\n")
        size = self.tokenizer.get_vocab_size()
        self.bits = max(1, (size - 1).bit_length())
        added = self.tokenizer.get_added_tokens_decoder()
        self.lengths = np.array([len(added[i].content.encode()) if i in added else len(self.tokenizer.id_to_token(i) or "") for i in range(size)])
        self.added = re.compile("|".join(re.escape(t.content) for t in added.values()) or r"\Z\A.")
        self.alphabet = _byte_alphabet()
        self.keys, self.checks = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        self.place, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool, self.used = np.zeros(1 << 16, np.uint32), 0

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")

    def _encode_pieces(self, pieces: set[str]) -> dict[str, bytes]:
        out: dict[str, bytes] = {}
        words, joined = [], []
        for p in pieces:
            if _ONE_WORD.fullmatch(p):
                words.append(p)
            elif _JOINABLE.fullmatch(p):
                joined.append(p)
            else:
                out[p] = self._ids(p).tobytes()
        for at in range(0, len(words), self.JOIN):
            part = words[at : at + self.JOIN]
            text, _ = codecs.charmap_decode("\n".join(part).encode(), "strict", self.alphabet)
            self._deal(part, np.array(self.lines.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4"), out)
        for at in range(0, len(joined), self.JOIN):
            part = joined[at : at + self.JOIN]
            self._deal(part, self._ids("".join(part)), out)
        return out

    def _deal(self, pieces: list[str], ids: np.ndarray, out: dict[str, bytes]) -> None:
        """Hands the ids of joined pieces to each by their byte lengths."""
        ends = np.cumsum(self.lengths[ids])
        cuts = np.searchsorted(ends, np.cumsum([len(p.encode()) for p in pieces]), side="left") + 1
        body, a = ids.tobytes(), 0
        for p, b in zip(pieces, (4 * cuts).tolist(), strict=True):
            out[p] = body[a:b]
            a = b

    def _keep(self, ids: np.ndarray) -> int:
        """Adds ids to the pool; returns their place."""
        at, self.used = self.used, self.used + len(ids)
        if self.used > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(max(len(self.pool), len(ids)), np.uint32)])
        self.pool[at : self.used] = ids
        return at

    def encode_slice(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a null-free large_string array, and the count of each text's."""
        data, at = text_buffer(column)
        if self.added.search(body := data.tobytes().decode()):
            return self._encode_whole(column.to_pylist())
        del body
        start = piece_starts(data, at[:-1][np.diff(at) > 0])
        end = np.append(start[1:], len(data)) if len(start) else start
        key, check = range_hashes(data, start, end), range_hashes(data, start, end, 1)
        distinct, lead, of = np.unique(key, return_index=True, return_inverse=True)
        if not np.array_equal(check, check[lead][of]):
            return self._encode_whole(column.to_pylist())
        spot = np.minimum(np.searchsorted(self.keys, distinct), max(0, len(self.keys) - 1))
        known = (self.keys[spot] == distinct) & (self.checks[spot] == check[lead]) if len(self.keys) else np.zeros(len(distinct), bool)
        place, size = np.zeros(len(distinct), np.int64), np.zeros(len(distinct), np.int64)
        place[known], size[known] = self.place[spot[known]], self.size[spot[known]]
        new = np.flatnonzero(~known)
        pieces = [data[a:b].tobytes().decode() for a, b in zip(start[lead[new]].tolist(), end[lead[new]].tolist(), strict=True)]
        fresh = self._encode_pieces(set(pieces))
        parts = [fresh[p] for p in pieces]
        size[new] = [len(x) // 4 for x in parts]
        mark = self.used
        place[new] = self._keep(np.frombuffer(b"".join(parts), "<u4")) + np.cumsum(size[new]) - size[new]
        n = size[of]
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.pool[np.arange(total) + np.repeat(place[of] - ends + n, n)]
        before = np.concatenate([[0], ends])
        counts = np.diff(before[np.searchsorted(start, at)])
        if len(self.keys) + len(new) <= self.MEMO:
            into = np.searchsorted(self.keys, distinct[new])
            self.keys, self.checks = np.insert(self.keys, into, distinct[new]), np.insert(self.checks, into, check[lead][new])
            self.place, self.size = np.insert(self.place, into, place[new]), np.insert(self.size, into, size[new])
        else:
            self.used = mark
        return ids, counts

    def _encode_whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [self._ids(t) for t in texts]
        return np.concatenate(found), np.array([len(x) for x in found])


_encoders: dict[str, PieceEncoder] = {}


def _shard_row(part: int, seq: int, doc_ids: list[pa.Array], counts: list[np.ndarray], chunks: list[np.ndarray], bits: int, end_id: int) -> list:
    """One shard: each text's ids and the end id."""
    n, flat = np.concatenate(counts), np.concatenate(chunks)
    ends = np.cumsum(n + 1)
    ids = np.full(int(ends[-1]), end_id, np.uint32)
    ids[np.arange(len(flat)) + np.repeat(np.arange(len(n)), n)] = flat
    matrix = WaveletMatrix.build(ids, bits)
    known = pa.concat_arrays(doc_ids)
    missing = known.is_null().to_numpy(zero_copy_only=False)
    return [part, seq, len(n), len(ids), known.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8").tobytes() + missing.astype("u1").tobytes(), ends.astype("<i8").tobytes(), bits, matrix.zeros.astype("<i8").tobytes(), matrix.to_bytes()]


def _encode(tokenizer_file: str, end_id: int, shard_tokens: int):
    names = ["part", "seq", "n_docs", "n_tokens", "doc_ids", "ends", "bits", "zeros", "planes"]
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.binary(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoders.get(tokenizer_file) or _encoders.setdefault(tokenizer_file, PieceEncoder(tokenizer_file))
        part, seq, doc_ids, counts, chunks, held = TaskContext.get().partitionId(), 0, [], [], [], 0

        def flush():
            row = _shard_row(part, seq, doc_ids, counts, chunks, encoder.bits, end_id)
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names)

        for batch in batches:
            for at, texts in slices(batch.column(1), SLICE):
                ids, n = encoder.encode_slice(texts)
                doc_ids.append(batch.column(0).slice(at, len(texts)))
                counts.append(n)
                chunks.append(ids)
                held += len(ids) + len(n)
                if held >= shard_tokens:
                    yield flush()
                    seq, doc_ids, counts, chunks, held = seq + 1, [], [], [], 0
        if doc_ids:
            yield flush()

    return run


def write_token_shards(df: DataFrame, path: str, tokenizer_file: str, end_id: int = 0, key: str = "doc_id", text: str = "text", shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Write ``df`` as wavelet shards in ascending key order under ``path``; returns the written table."""
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = df.select(F.col(key).cast("long"), F.col(text).cast("string")).repartitionByRange(partitions, F.col(key).asc()).sortWithinPartitions(key, text)
    ordered.mapInArrow(tidy(_encode(tokenizer_file, end_id, shard_tokens)), SHARD_SCHEMA).write.option("compression", "none").parquet(path)
    return df.sparkSession.read.schema(SHARD_SCHEMA).parquet(path)


def _read_docs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in range(batch.num_rows):
            part, seq, n_docs, n_tokens, doc_ids, ends, bits, zeros, planes = (c[row].as_py() for c in batch.columns)
            ids = WaveletMatrix.from_bytes(n_tokens, bits, zeros, planes).decode().astype("<u4").tobytes()
            stop = np.frombuffer(ends, "<i8")
            start = np.concatenate([[0], stop[:-1]]) if n_docs else stop
            known = np.frombuffer(doc_ids, "<i8", count=n_docs)
            missing = np.frombuffer(doc_ids, "u1", offset=8 * n_docs).astype(bool)
            crcs = [zlib.crc32(ids[4 * a : 4 * b]) for a, b in zip(start, stop, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n_docs, part, np.int32)), pa.array(np.full(n_docs, seq, np.int32)), pa.array(known, pa.int64(), mask=missing), pa.array(start, pa.int64()), pa.array(stop - start, pa.int64()), pa.array(crcs, pa.int64())],
                ["part", "seq", "doc_id", "at", "n_tokens", "ids_crc32"],
            )


def document_digests(shards: DataFrame) -> DataFrame:
    """Per document, decoded from the shards: doc_id, start over the whole corpus, n_tokens, ids_crc32."""
    docs = shards.mapInArrow(tidy(_read_docs), "part int, seq int, doc_id long, at long, n_tokens long, ids_crc32 long")
    earlier = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    base = shards.select("part", "seq", F.coalesce(F.sum("n_tokens").over(earlier), F.lit(0)).alias("base"))
    return docs.join(base, ["part", "seq"]).select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")
