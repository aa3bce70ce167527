"""Byte-level BPE by a lazily determinised transducer, and its streaming decoder.

**Encoding.** A text is cut by the pre-tokeniser's pattern; each match goes through a transducer over bytes.
The encoding of every prefix of a match ends with one certain token: the one that fits behind the token before
it, where two tokens fit if merging their joined bytes gives just these two. So a nondeterministic transducer
guesses at each byte where a token ends. Its determinisation carries every place where an unfinished token may
begin: the node of that token in the vocabulary's trie and the token before it. Tokens that the encodings of all
places share are certain and are emitted; no place lies further back than the longest token. States and
transitions are made when a text first needs them and forgotten when there are ``MAX_STATES``.

**Decoding.** Ids become bytes in order; ``Utf8Stream`` holds back the bytes of an unfinished character, so that
every chunk that it gives out is whole text.

Results equal a tiktoken ``Encoding`` with the same ranks and pattern and without special tokens: a match that
is a token itself is encoded as that token. A null or empty text has no ids; null ids have no bytes. Texts are
cut in windows without changing a match, so long ones need no more memory than their ids. Unknown ids stop
with a ``ValueError``. Kept columns that are named like an output get an underscore behind their name.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordlake.llm.scratch import free_name, tidy

#: Determinised states in memory; matches in a worker's memo, and the longest that enters it.
MAX_STATES, MEMO, MEMO_CHARS = 500_000, 400_000, 40
#: Bytes between emissions within a match; bits of a token id.
STRIDE, BITS = 256, 24
LOW = (1 << BITS) - 1
#: Characters that the pattern sees at a time; a contraction spans 3, and a cut one shows as two matches.
WINDOW, UNSURE = 1 << 18, 3
#: Tokens that the decoder turns into bytes at a time.
CHUNK = 1 << 16
NEVER = 1 << 60


def read_ranks(path: str) -> dict[bytes, int]:
    """A .tiktoken file: one token a line, in base64, and its rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class Merges:
    """Which tokens may follow each other.

    ``stories``: a token's bytes merged on their own, step by step: rank of each merge, and the first and last
    part before it. Two neighbours merge independently as long as no merge across their border comes first, so
    two stories side by side tell whether one ever does.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.token = {i: t for t, i in ranks.items()}
        if len(self.token) < len(ranks) or any(bytes([b]) not in ranks for b in range(256)) or max(self.token) > LOW:
            raise ValueError("ranks must be unique, below 2**24, and hold every byte")
        self.stories: dict[int, tuple[list, list, list] | None] = {}
        self.known: dict[tuple[int, int], bool] = {}

    def story(self, token: int) -> tuple[list, list, list] | None:
        """Merge ranks, first parts and last parts; ``None`` if merging doesn't end in the token."""
        if token not in self.stories:
            parts = [bytes([b]) for b in self.token[token]]
            merges, firsts, lasts = [], [], []
            while True:
                firsts.append(parts[0])
                lasts.append(parts[-1])
                rank, at = min(((self.ranks.get(a + b, NEVER), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False))), default=(NEVER, 0))
                merges.append(rank)
                if rank == NEVER:
                    break
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            self.stories[token] = (merges, firsts, lasts) if len(parts) == 1 else None
        return self.stories[token]

    def fits(self, left: int, right: int) -> bool:
        """Whether the encoding of both tokens' bytes is just these two; ``left`` -1 stands for none."""
        found = self.known.get((left, right))
        if found is None:
            if len(self.known) > 2 * MAX_STATES:
                self.known.clear()
            found = self.known[left, right] = self._fits(left, right)
        return found

    def _fits(self, left: int, right: int) -> bool:
        b = self.story(right)
        if left < 0 or b is None:
            return b is not None
        a, i, j, get = self.story(left), 0, 0, self.ranks.get
        while True:
            mine, other = a[0][i], b[0][j]
            across = get(a[2][i] + b[1][j], NEVER)
            if across < mine and across <= other and across < NEVER:  # of equal ranks the leftmost merges first
                return False
            if mine == other == NEVER:
                return True
            if mine <= other:
                i += 1
            else:
                j += 1


class Transducer:
    """Deterministic states by number, made when first needed.

    A state lists the places where an unfinished token may begin, oldest first: the trie node reached from there and
    the last token before it. A step tells the token that ends at its byte, so the steps of a match are a tree of
    encodings: the token that ends at ``i`` hangs on the one that ends where it begins.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.merges, self.ranks = Merges(ranks), ranks
        self.children: list[dict[int, int]] = [{}]
        self.token_at, self.depth = [-1], [0]
        self.size = [0] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            node = 0
            for b in token:
                after = self.children[node].get(b)
                if after is None:
                    after = self.children[node][b] = len(self.children)
                    self.children.append({})
                    self.token_at.append(-1)
                    self.depth.append(self.depth[node] + 1)
                node = after
            self.token_at[node] = rank
            self.size[rank] = len(token)
        self.reset()

    def reset(self) -> None:
        start = (0, -1)
        self.states, self.numbers = [start], {start: 0}
        #: state * 256 + byte -> state << BITS | token that ends here
        self.steps: dict[int, int] = {}

    def _step(self, key: int) -> int:
        """Determinise one transition."""
        places, byte = self.states[key >> 8], key & 255
        moved, ended = [], -1
        children, token_at, fits = self.children, self.token_at, self.merges.fits
        for i in range(0, len(places), 2):
            child = children[places[i]].get(byte)
            if child is not None:
                if ended < 0 and token_at[child] >= 0 and fits(places[i + 1], token_at[child]):
                    ended = token_at[child]
                if children[child]:
                    moved += (child, places[i + 1])
        state = (*moved, 0, ended)
        number = self.numbers.get(state)
        if number is None:
            number = self.numbers[state] = len(self.states)
            self.states.append(state)
        self.steps[key] = number << BITS | ended
        return self.steps[key]

    def _chain(self, ends: list[int], i: int) -> list[int]:
        """Where the tokens of the encoding of the first ``i`` bytes end, last first; down to the first byte that is held."""
        out = []
        while i > 0:
            out.append(i)
            i -= self.size[ends[i - 1]]
        return out

    def encode(self, match: bytes) -> list[int]:
        if match in self.ranks:
            return [self.ranks[match]]
        out: list[int] = []
        if len(match) > STRIDE or len(self.states) > MAX_STATES:
            for part in self.stream(match):
                out += part
            return out
        ends, state, get, size = [], 0, self.steps.get, self.size
        for byte in match:
            step = get(state << 8 | byte)
            if step is None:
                step = self._step(state << 8 | byte)
            state = step >> BITS
            ends.append(step & LOW)
        i = len(ends)
        while i:
            token = ends[i - 1]
            out.append(token)
            i -= size[token]
        out.reverse()
        return out

    def stream(self, data: Iterable[int]) -> Iterator[list[int]]:
        """Tokens of the encoding, as soon as they are certain; held are the ends of at most a few ``STRIDE`` bytes."""
        ends: list[int] = []
        state, limit = 0, STRIDE
        if len(self.states) > MAX_STATES:
            self.reset()
        get, made = self.steps.get, self._step
        for byte in data:
            step = get(state << 8 | byte)
            if step is None:
                step = made(state << 8 | byte)
            state = step >> BITS
            ends.append(step & LOW)
            if len(ends) >= limit:
                places = self.states[state]
                agreed = set(self._chain(ends, len(ends)))
                for node in places[:-2:2]:
                    start = len(ends) - self.depth[node]
                    agreed.intersection_update(self._chain(ends, start)) if start else agreed.clear()
                upto = max(agreed, default=0)
                if upto:
                    yield [ends[i - 1] for i in reversed(self._chain(ends, upto))]
                    del ends[:upto]
                limit = len(ends) + STRIDE
                if len(self.states) > 2 * MAX_STATES:
                    kept = places
                    self.reset()
                    get = self.steps.get
                    if kept not in self.numbers:
                        self.numbers[kept] = len(self.states)
                        self.states.append(kept)
                    state = self.numbers[kept]
        yield [ends[i - 1] for i in reversed(self._chain(ends, len(ends)))]


def matches(pattern: regex.Pattern, text: str, window: int = WINDOW) -> Iterator[list[str]]:
    """Lists of the pattern's matches, window by window, the same as over the whole text.

    The pattern must look no further than one character ahead, cover all text, and change no match by a cut more
    than ``UNSURE`` matches before it; these are matched again with the next window.
    """
    at, size = 0, window
    while at < len(text):
        found = pattern.findall(text, at, at + size)
        if at + size >= len(text):
            yield found
            return
        sure = found[:-UNSURE]
        if sure:
            yield sure
            at, size = at + sum(map(len, sure)), window
        else:
            size *= 2  # one match fills the window


class Encoder(dict):
    """Encodes texts; as a dict it remembers the ids of short matches, as bytes, and makes those that are missing."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        super().__init__()
        self.transducer, self.pattern = Transducer(ranks), regex.compile(pattern)

    def __missing__(self, match: str) -> bytes:
        ids = array("i", self.transducer.encode(match.encode())).tobytes()
        if len(match) <= MEMO_CHARS:
            if len(self) >= MEMO:
                self.clear()
            self[match] = ids
        return ids

    def encode(self, text: str) -> np.ndarray:
        parts = [b"".join(map(self.__getitem__, found)) for found in matches(self.pattern, text)]
        return np.frombuffer(b"".join(parts), np.int32)


#: The byte classes of well-formed UTF-8: leading bytes by the number of bytes that follow, and the second byte's bounds where they are narrower.
_FOLLOW = np.select([np.arange(256) < 0x80, (np.arange(256) >= 0xC2) & (np.arange(256) < 0xE0), (np.arange(256) >= 0xE0) & (np.arange(256) < 0xF0), (np.arange(256) >= 0xF0) & (np.arange(256) < 0xF5)], [0, 1, 2, 3], -1).tolist()
_SECOND = {0xE0: (0xA0, 0xBF), 0xED: (0x80, 0x9F), 0xF0: (0x90, 0xBF), 0xF4: (0x80, 0x8F)}


class Utf8Stream:
    """An incremental UTF-8 decoder: gives whole characters, keeps an unfinished one for the next bytes.

    Its state is the bytes of the unfinished character, how many more follow and the bounds of the next. Ill-formed
    parts become U+FFFD, one for each longest beginning of a character.
    """

    def __init__(self):
        self.held = b""
        self.left, self.low, self.high = 0, 0x80, 0xBF

    def _byte(self, b: int, out: list[str]) -> None:
        if self.left:
            if self.low <= b <= self.high:
                self.held += bytes([b])
                self.left, self.low, self.high = self.left - 1, 0x80, 0xBF
                if not self.left:
                    out.append(self.held.decode())
                    self.held = b""
                return
            out.append("�")
            self.held, self.left, self.low, self.high = b"", 0, 0x80, 0xBF
        follow = _FOLLOW[b]
        if follow <= 0:
            out.append(chr(b) if follow == 0 else "�")
            return
        self.held, self.left = bytes([b]), follow
        self.low, self.high = _SECOND.get(b, (0x80, 0xBF))

    def feed(self, data: bytes) -> str:
        """The characters that ``data`` completes."""
        out: list[str] = []
        at = 0
        while self.left and at < len(data):
            self._byte(data[at], out)
            at += 1
        # From here characters begin anew: all but the last few bytes go at once if they are well formed.
        tail = max(at, len(data) - 3)
        while tail > at and data[tail] & 0xC0 == 0x80:
            tail -= 1
        try:
            out.append(data[at:tail].decode())
        except UnicodeDecodeError:
            tail = at
        for b in data[tail:]:
            self._byte(b, out)
        return "".join(out)

    def close(self) -> str:
        """U+FFFD for a character that never ended."""
        ended, self.held, self.left = self.held, b"", 0
        self.low, self.high = 0x80, 0xBF
        return "�" if ended else ""


class Decoder:
    def __init__(self, ranks: dict[bytes, int]):
        size = max(ranks.values()) + 1
        self.length = np.full(size, -1, np.int64)
        pool = [b""] * size
        for token, i in ranks.items():
            pool[i], self.length[i] = token, len(token)
        self.start = np.concatenate([[0], np.cumsum(np.maximum(self.length, 0))[:-1]])
        self.bytes = np.frombuffer(b"".join(pool), np.uint8)

    def bytes_of(self, ids: np.ndarray) -> bytes:
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.length) or self.length[ids].min() < 0):
            raise ValueError("an id is not in the vocabulary")
        n = self.length[ids]
        ends = np.cumsum(n)
        return self.bytes[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(self.start[ids] - ends + n, n)].tobytes()

    def stream(self, ids: np.ndarray, chunk: int = CHUNK) -> Iterator[str]:
        """The text of ids, chunk by chunk, each of whole characters."""
        held = Utf8Stream()
        for at in range(0, len(ids), chunk):
            yield held.feed(self.bytes_of(ids[at : at + chunk]))
        yield held.close()


_encoders: dict[tuple[str, str], Encoder] = {}
_decoders: dict[str, Decoder] = {}


def _encode(ranks_file: str, pattern: str, n_kept: int, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoders.get((ranks_file, pattern)) or _encoders.setdefault((ranks_file, pattern), Encoder(read_ranks(ranks_file), pattern))
        for batch in batches:
            found = [encoder.encode(t.as_py() or "") for t in batch.column(n_kept)]
            ends = np.concatenate([[0], np.cumsum([len(x) for x in found])])
            flat = np.concatenate([*found, np.zeros(0, np.int32)])
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:n_kept], ids], names)

    return run


def encode_texts(df: DataFrame, ranks_file: str, pattern: str, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` columns and ``ids``, an array of ints. The file must be readable on every executor."""
    names = [free_name(c, ["ids"]) for c in keep]
    fields = [f"`{n}` {df.schema[c].dataType.simpleString()}" for c, n in zip(keep, names, strict=True)]
    kept = (F.col(c).alias(n) for c, n in zip(keep, names, strict=True))
    return df.select(*kept, F.col(text).cast("string").alias("__text")).mapInArrow(tidy(_encode(ranks_file, pattern, len(keep), [*names, "ids"])), ", ".join([*fields, "ids array<int>"]))


def _decode(ranks_file: str, n_kept: int, names: list[str], as_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = _decoders.get(ranks_file) or _decoders.setdefault(ranks_file, Decoder(read_ranks(ranks_file)))
        for batch in batches:
            column = batch.column(n_kept)
            flat, at = column.flatten().to_numpy(zero_copy_only=False), 0
            out = []
            for n in column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).tolist():
                ids = flat[at : at + n]
                out.append("".join(decoder.stream(ids)) if as_text else decoder.bytes_of(ids))
                at += n
            yield pa.RecordBatch.from_arrays([*batch.columns[:n_kept], pa.array(out, pa.string() if as_text else pa.binary())], names)

    return run


def decode_ids(df: DataFrame, ranks_file: str, keep: list[str], ids: str = "ids", as_text: bool = False) -> DataFrame:
    """``keep`` columns and ``decoded``: the ids' bytes, or with ``as_text`` their text as streamed."""
    names = [free_name(c, ["decoded"]) for c in keep]
    fields = [f"`{n}` {df.schema[c].dataType.simpleString()}" for c, n in zip(keep, names, strict=True)]
    kept = (F.col(c).alias(n) for c, n in zip(keep, names, strict=True))
    return df.select(*kept, F.col(ids).cast("array<int>").alias("__ids")).mapInArrow(tidy(_decode(ranks_file, len(keep), [*names, "decoded"], as_text)), ", ".join([*fields, "decoded " + ("string" if as_text else "binary")]))
