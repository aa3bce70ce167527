"""Exact n-gram Jaccard join with a token-group matrix.

1. A document's set is its distinct word shingles (64-bit codes). Equal sets (128-bit digest) form a
   class; the classes are the nodes that links join, copies take no further part.
2. Sets are partitioned into groups of similar ones. By the pigeonhole principle two sets that reach the
   threshold agree on at least one of ``d + 1`` hashed parts, ``d`` being the most elements they may
   differ in; so sets that share no part signature cannot link. Most links share many: how many at
   least follows from the slack in the number of parts, and a set that shares fewer takes no further
   part. Sets agree on keys in a few rounds of majority votes along signatures. The sets of one key
   meet; of two keys those meet that share enough signatures with sets of the other. Each side is dealt
   by hash to blocks of bounded size, and a block's sets, ordered by their least token (a min-hash), to
   groups of ``GROUP``. Keys decide who meets in which task, never whether a pair meets.
3. In each task, sets that are too far from all others by small parity bitmaps (a lower bound of their
   symmetric difference) leave before any tokens are sent. The groups' token unions are the token-group
   matrix: a set's overlap with a union bounds its overlap with every member, and groups below the bound
   stay closed.
4. Opened groups are verified exactly. Tokens of many sets are columns of a matrix product, the others
   are met one by one. Links become components in Spark.

Common shingles (a line or passage of many documents) would make unlike sets agree on small parts. A
bounded list of the most frequent ones, counted over all documents, is left out of the parts of sets
that hold few of them; sets that hold many are also signed in full. The thresholds overlap, so that two
sets that link are signed alike at least once: any list gives the same result.

Signatures that stand on no token, or on one, are left out where the slack in the number of parts
allows, and kept where it doesn't, so no link is lost. Every pair of sets with a signature in common is
compared once, so a group of ``m`` unlike near copies costs ``m * m / 2`` comparisons, and each of its
sets is sent to ``m / BLOCK_SETS`` tasks.

A document with fewer words than the shingle is one element; one without words (null, empty) is empty,
is linked with nothing and is its own component. Rows with a null id take no part: their class and
component are null, their links 0. Rows with equal ids are rows of their own, each judged by its text.
Ids are integers; other types are refused. Other columns are ignored. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordlake.llm.components import connected_components
from recordlake.llm.scratch import bound_batches, discard, free_memory, integer_key, materialize, tidy
from recordlake.llm.wordcode import SPACE_WORDS, mix, slices, split_words, window_hashes

SHINGLE, PERCENT = 4, 85
GROUP = 64
#: At most so many common shingles are left out of signatures; of each so many elements counted at a time,
#: those that so many sets hold are reported.
COMMON, COUNTED, COMMON_IN_BATCH = 200_000, 1_000_000, 8
#: Share of common shingles up to which a set is signed without them, in percent.
COMMON_SHARE = 25
#: A block holds about so many sets and tokens at most; a task holds two blocks.
BLOCK_SETS, BLOCK_TOKENS = 8_192, 500_000
#: Signatures that a task takes in; more of them get more tasks.
SIGNATURES_A_TASK = 2_000_000
#: Rows that are worked on at once.
CHUNK = 500_000
#: Rounds in which keys are agreed on.
ROUNDS = 3
#: Bits of a tag that name a kind of parts.
KIND_BITS = 12
#: A code counts as a column of the matrix product if a product of it costs at most so many single meetings; columns at a time.
DENSE, COLUMNS = 256, 512
#: Rows of (node, id, mark) that may be broadcast: 24 MB.
BROADCAST_ROWS = 1_000_000


def shingle_sets(column: pa.Array, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle codes of the texts, and where each text's begin."""
    words = split_words(column, SPACE_WORDS, lower=True)
    codes, first = words.hashes(), words.first
    windows = window_hashes(codes, shingle)
    out, counts = [], np.zeros(len(first) - 1, np.int64)
    for i in range(len(counts)):
        a, b = int(first[i]), int(first[i + 1])
        if b - a >= shingle:
            own = np.sort(windows[a : b - shingle + 1])
            own = own[np.concatenate([[True], own[1:] != own[:-1]])]
        elif b > a:
            own = window_hashes(codes[a:b], b - a, 1)
        else:
            continue
        out.append(own)
        counts[i] = len(own)
    return np.concatenate(out) if out else np.zeros(0, np.uint64), np.concatenate([[0], np.cumsum(counts)])


def set_digests(tokens: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent order-free digests of each set."""
    out = []
    for salt in (3, 4):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(tokens, salt), dtype=np.uint64)])
        out.append(mix(sums[first[1:]] - sums[first[:-1]], salt))
    return out[0].view(np.int64), out[1].view(np.int64)


class SizeClasses:
    """Size classes with the number of parts that the pigeonhole principle needs."""

    def __init__(self, percent: int, largest: int):
        self.percent = percent
        bounds = [1]
        while bounds[-1] <= largest * 100 // percent + 1:
            bounds.append(max(bounds[-1] + 1, -(-bounds[-1] * 5 // 4), -(-bounds[-1] * 100 // percent)))  # a partner is in the next class at most
        self.low = np.array(bounds)
        differ = (100 - percent) * 2 * (self.low[1:] - 1) // (100 + percent)
        self.slack = -(-(differ + 1) * 20 // 100) * (differ > 0)
        self.parts = differ + 1 + self.slack

    def of(self, sizes: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.low, sizes, side="right") - 1


def signatures(tokens: np.ndarray, first: np.ndarray, percent: int, common: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(set row, signature) of all parts to compare; ``common`` is the sorted list of common codes."""
    return tagged_signatures(tokens, first, percent, common)[:2]


def tagged_signatures(tokens: np.ndarray, first: np.ndarray, percent: int, common: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(set row, signature, tag). A tag is the kind of parts (size class and choice of tokens), and above
    ``KIND_BITS`` how many signatures of that kind a set must share with one that it links with."""
    sizes = np.diff(first)
    if common is None or not len(common) or not len(tokens):
        return _part_signatures(tokens, first, sizes, percent, 0)
    spot = np.minimum(np.searchsorted(common, tokens), len(common) - 1)
    rare = common[spot] != tokens
    held = np.concatenate([[0], np.cumsum(~rare)])
    shared = 100 * (held[first[1:]] - held[first[:-1]])
    few = shared <= COMMON_SHARE * sizes
    # a set that links with one beyond the share holds at least (share - (100 - percent)) * percent / 100 per cent
    many = shared * 100 >= max(0, COMMON_SHARE - (100 - percent)) * percent * sizes
    owner = np.repeat(np.arange(len(sizes)), sizes)
    out = []
    for keep, chosen, salt in ((rare & few[owner], few, 1), (many[owner], many, 2)):
        kept = np.bincount(owner[keep], minlength=len(sizes))
        out.append(_part_signatures(tokens[keep], np.concatenate([[0], np.cumsum(kept)]), sizes * chosen, percent, salt))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _part_signatures(tokens: np.ndarray, first: np.ndarray, sizes: np.ndarray, percent: int, salt: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Signatures of sets that have ``sizes`` elements in all, from the tokens given."""
    have = np.diff(first)
    rows = np.flatnonzero(sizes)
    if not len(rows):
        return rows, np.zeros(0, np.uint64), np.zeros(0, np.int32)
    classes = SizeClasses(percent, int(sizes.max()))
    own = classes.of(sizes[rows])
    above = sizes[rows] * 100 // percent >= classes.low[own + 1]
    emit_row = np.concatenate([rows, rows[above]])
    emit_class = np.concatenate([own, own[above] + 1])
    parts = classes.parts[emit_class]
    begin = np.concatenate([[0], np.cumsum(parts)])
    n = have[emit_row]
    which = np.repeat(np.arange(len(emit_row)), n)
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[emit_row], n)
    token = tokens[at]
    spread = mix(token, 11) >> np.uint64(32)
    part = (spread * parts[which].astype(np.uint64)) >> np.uint64(32)
    slot = begin[which] + part.astype(np.int64)
    count = np.bincount(slot, minlength=begin[-1])
    sums = np.zeros(begin[-1], np.uint64)
    np.add.at(sums, slot, mix(token, 12))
    slot_emit = np.repeat(np.arange(len(emit_row)), parts)
    # two sets that link agree on more parts than the slack: as many of the poorest kinds as that can be left out
    spare = classes.slack[emit_class]
    per = lambda test: np.add.reduceat(test.astype(np.int64), begin[:-1])
    poor = per(count < 2)
    least = np.where(poor <= spare, 2, np.where(per(count < 1) <= spare, 1, 0))
    # of the 1 + spare parts that agree, the partner may have left out those that are poor, which are poor here too
    need = np.minimum(1 + spare - np.minimum(poor, spare), 1 << 18)
    tag = (need << KIND_BITS | emit_class * 4 + salt).astype(np.int32)
    keep = count >= least[slot_emit]
    inside = (np.arange(begin[-1]) - begin[slot_emit]).astype(np.uint64)
    place = emit_class[slot_emit].astype(np.uint64) << np.uint64(40) | inside
    signature = mix(sums + mix(place, 13 + salt), 14)
    return emit_row[slot_emit[keep]], signature[keep], tag[slot_emit[keep]]


def _describe(shingle: int):
    """Size and digests of each set; then, as rows of negative size, common shingles and their counts in what is at hand."""
    names = ["id", "mark", "n_shingles", "d1", "d2"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: set[tuple[int, int]] = set()
            held: list[np.ndarray] = []
            for at, part in slices(batch.column(2)):
                tokens, first = shingle_sets(part, shingle)
                one, two = set_digests(tokens, first)
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(at, len(part)) for i in (0, 1)), pa.array(np.diff(first)), pa.array(one), pa.array(two)], names)
                fresh = _unseen(one, two, seen)
                held.append(tokens[np.repeat(fresh, np.diff(first))])
                if sum(map(len, held)) >= COUNTED:
                    yield _common_rows(held, names)
                    held = []
            if held:
                yield _common_rows(held, names)

    return run


def _common_rows(held: list[np.ndarray], names: list[str]) -> pa.RecordBatch:
    """The shingles that enough of the sets at hand hold, as rows of negative size."""
    found, count = np.unique(np.concatenate(held), return_counts=True)
    often = count >= COMMON_IN_BATCH
    n = int(often.sum())
    return pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.array(-count[often]), pa.array(found[often].view(np.int64)), pa.array(np.zeros(n, np.int64))], names)


def _unseen(one: np.ndarray, two: np.ndarray, seen: set[tuple[int, int]]) -> np.ndarray:
    """Which sets are not in ``seen``; adds them."""
    fresh = np.zeros(len(one), bool)
    for i, pair in enumerate(zip(one.tolist(), two.tolist(), strict=True)):
        if pair not in seen:
            seen.add(pair)
            fresh[i] = True
    return fresh


def _sign(shingle: int, percent: int, bound):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: set[tuple[int, int]] = set()
            for _, part in slices(batch.column(0)):
                tokens, first = shingle_sets(part, shingle)
                one, two = set_digests(tokens, first)
                fresh = _unseen(one, two, seen)
                sizes = np.diff(first) * fresh
                tokens = tokens[np.repeat(fresh, np.diff(first))]
                rows, signature, tag = tagged_signatures(tokens, np.concatenate([[0], np.cumsum(sizes)]), percent, bound.value)
                yield pa.RecordBatch.from_arrays([pa.array(signature.view(np.int64)), pa.array(one[rows]), pa.array(tag)], ["sig", "node", "tag"])

    return run


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(sig, node, tag) of a partition that holds all rows of its signatures: those that several nodes share.

    What stays in memory is a node for each signature, dealt by hash; the rows of a signature, however
    many, pass through.
    """
    sigs, leads, tags, told = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, bool)
    for sig, node, tag in _chunks(batches):
        order = np.lexsort((node, sig))
        sig, node, tag = sig[order], node[order], tag[order]
        new = np.ones(len(sig), bool)
        new[1:] = (sig[1:] != sig[:-1]) | (node[1:] != node[:-1])
        sig, node, tag = sig[new], node[new], tag[new]
        at = np.flatnonzero(np.append(True, sig[1:] != sig[:-1]))
        own, many = sig[at], np.diff(np.append(at, len(sig)))
        place = np.searchsorted(sigs, own)
        known = np.zeros(len(own), bool)
        inside = place < len(sigs)
        known[inside] = sigs[place[inside]] == own[inside]
        lead, lead_tag, before = node[at].copy(), tag[at].copy(), np.zeros(len(own), bool)
        lead[known], lead_tag[known], before[known] = leads[place[known]], tags[place[known]], told[place[known]]
        apart = node != np.repeat(lead, many)
        several = np.add.reduceat(apart.astype(np.int64), at) > 0
        first = several & ~before  # these leads have not been told yet
        for columns in ((sig[apart], node[apart], tag[apart]), (own[first], lead[first], lead_tag[first])):
            for low in range(0, len(columns[0]), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(c[low : low + 50_000]) for c in columns], ["sig", "node", "tag"])
        told[place[known & first]] = True
        fresh = ~known
        into = place[fresh]
        sigs, leads, tags, told = (np.insert(old, into, late[fresh]) for old, late in ((sigs, own), (leads, lead), (tags, lead_tag), (told, first)))


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """The columns of the batches, ``CHUNK`` rows or more at a time."""
    held, rows = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append([np.asarray(c) for c in batch.columns])
            rows += batch.num_rows
        if rows >= CHUNK:
            yield tuple(np.concatenate(x) for x in zip(*held, strict=True))
            held, rows = [], 0
    if held:
        yield tuple(np.concatenate(x) for x in zip(*held, strict=True))


def parity_bits(tokens: np.ndarray) -> bytes:
    """A bitmap of about twice the set's size: each bit is the parity of the tokens that fall on it.

    Bits of two sets differ in no more places than the sets have elements apart. Halves of a bitmap
    combine by exclusive or into that of half the size.
    """
    size = max(64, 1 << int(2 * len(tokens) - 1).bit_length())
    odd = np.bincount((mix(tokens, 21) & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(bool), bitorder="little").tobytes()


def _load_sets(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, part in slices(batch.column(1)):
                tokens, first = shingle_sets(part, shingle)
                sets = [tokens[a:b] for a, b in zip(first, first[1:], strict=False)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(part)), pa.array(np.diff(first)), pa.array([parity_bits(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())],
                    ["node", "n_shingles", "bits", "tokens"],
                )

    return run


def near_bits(left: np.ndarray, right: np.ndarray, left_size: np.ndarray, right_size: np.ndarray, percent: int) -> Iterator[tuple[slice, np.ndarray]]:
    """For some rows on the left at a time: the pairs whose bitmaps (rows of 64-bit words) differ in few enough places for a link."""
    step = max(1, 4 * CHUNK // max(1, right.size))
    for at in range(0, len(left), step):
        rows = slice(at, at + step)
        apart = np.bitwise_count(left[rows, None, :] ^ right[None, :, :]).sum(2, dtype=np.int64)
        yield rows, apart * (100 + percent) <= (100 - percent) * (left_size[rows, None] + right_size[None, :])


def _likely(percent: int):
    """The rows of a task that some other set of it may link with, by their bitmaps.

    Linked sets differ in size by half at most, so their bitmaps by one doubling at most.
    """

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        side, sizes = np.asarray(table["side"]), np.asarray(table["n_shingles"])
        bits = [np.frombuffer(x, np.uint64) for x in table["bits"].to_pylist()]
        words = np.array([len(x) for x in bits])
        likely = np.zeros(len(side), bool)
        for width in np.unique(words):
            same = {w: np.flatnonzero(words == w) for w in (width, 2 * width)}
            rows = {w: np.array([bits[i] for i in i_s]) for w, i_s in same.items()}
            for wide in (width, 2 * width):
                if not len(same[wide]):
                    continue
                far = rows[wide] if wide == width else rows[wide][:, :width] ^ rows[wide][:, width:]
                for part, near in near_bits(rows[width], far, sizes[same[width]], sizes[same[wide]], percent):
                    own, other = same[width][part], same[wide]
                    near &= (own[:, None] != other[None, :]) & ((side[own][:, None] == 0) | (side[own][:, None] != side[other][None, :]))
                    likely[own] |= near.any(1)
                    likely[other] |= near.any(0)
        if len(side) > 2_000:
            free_memory()
        return table.filter(pa.array(likely)).drop_columns(["n_shingles", "bits"])

    return run


@dataclass
class Sets:
    """Sets as rows of (code, owner); codes are below ``codes``."""

    code: np.ndarray
    owner: np.ndarray
    n: int
    codes: int

    def pick(self, rows: np.ndarray) -> Sets:
        place = np.full(self.n, -1)
        place[rows] = np.arange(len(rows))
        keep = place[self.owner] >= 0
        return Sets(self.code[keep], place[self.owner[keep]], len(rows), self.codes)

    def indicator(self, chosen: np.ndarray) -> np.ndarray:
        place = np.full(self.codes, -1)
        place[chosen] = np.arange(len(chosen))
        spot = place[self.code]
        out = np.zeros((self.n, len(chosen)), np.float32)
        out[self.owner[spot >= 0], spot[spot >= 0]] = 1
        return out


def overlaps(left: Sets, right: Sets) -> np.ndarray:
    """How many codes each set on the left has in common with each on the right.

    Codes of many sets are columns of a matrix product, those of few are met one by one.
    """
    out = np.zeros((left.n, right.n), np.float32)
    have = np.bincount(left.code, minlength=left.codes)
    work = have * np.bincount(right.code, minlength=left.codes)
    heavy = work * DENSE > left.n * right.n
    for at in range(0, int(heavy.sum()), COLUMNS):
        chosen = np.flatnonzero(heavy)[at : at + COLUMNS]
        out += left.indicator(chosen) @ right.indicator(chosen).T
    light = ((work > 0) & ~heavy)[right.code]
    code, owner = right.code[light], right.owner[light]
    order = np.argsort(left.code, kind="stable")
    start = np.cumsum(have) - have
    ends = np.cumsum(have[code])
    low = 0
    while low < len(code):
        high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + CHUNK, side="right")))
        n = have[code[low:high]]
        at = np.arange(n.sum()) + np.repeat(start[code[low:high]] - np.cumsum(n) + n, n)
        np.add.at(out, (left.owner[order[at]], np.repeat(owner[low:high], n)), 1)
        low = high
    return out


def _merge(root: np.ndarray, linked: np.ndarray, left: np.ndarray, right: np.ndarray) -> None:
    """Joins the components of what is linked; ``root`` names each row's."""
    touched = np.unique(root[np.concatenate([left[linked.any(1)], right[linked.any(0)]])])
    for i in np.flatnonzero(linked.any(1)):
        if len(touched) <= 1:
            return
        own = np.unique(root[np.append(right[linked[i]], left[i])])
        if len(own) > 1:
            root[np.isin(root, own)] = own[0]
            touched = np.setdiff1d(touched, own[1:])


def _verify(percent: int, size: int):
    """Exact links between the left and the right sets of one task (side 0: within one block)."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        side, nodes, weight = (np.asarray(table[c]) for c in ("side", "node", "weight"))
        sets = [np.frombuffer(x, np.uint64) for x in table["tokens"].to_pylist()]
        sizes, least = np.array([len(s) for s in sets]), np.array([s[0] for s in sets])
        left, right = np.flatnonzero(side != 2), np.flatnonzero(side != 1)
        root, links = np.arange(len(nodes)), np.zeros(len(nodes), np.int64)
        if len(left) and len(right):
            _, code, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
            every = Sets(code, np.repeat(np.arange(len(sets)), sizes), len(sets), len(often))
            shared = often[code] > 1
            every.code, every.owner = every.code[shared], every.owner[shared]
            right = right[np.argsort(least[right], kind="stable")]  # groups of sets alike by min-hash
            queries, members = every.pick(left), every.pick(right)
            groups = -(-len(right) // size)
            union = np.unique(members.owner // size * every.codes + members.code)
            bound = overlaps(queries, Sets(union % every.codes, union // every.codes, groups, every.codes))
            opened = 100 * bound >= percent * sizes[left][:, None]
            for g in range(groups):
                rows, own = np.flatnonzero(opened[:, g]), np.arange(g * size, min(len(right), (g + 1) * size))
                if not len(rows):
                    continue
                common = overlaps(queries if len(rows) == len(left) else queries.pick(rows), members.pick(own))
                a, b = left[rows], right[own]
                linked = (100 * common >= percent * (sizes[a][:, None] + sizes[b][None, :] - common)) & (a[:, None] != b[None, :])
                links[a] += linked @ weight[b]
                if not (side == 0).any():
                    links[b] += weight[a] @ linked
                _merge(root, linked, a, b)
        told = np.flatnonzero(links)
        if len(nodes) > 2_000:
            free_memory()
        return pa.table({"node": pa.array(nodes[told]), "links": pa.array(links[told]), "root": pa.array(nodes[root[told]])})

    return run


def _enough(shared: DataFrame) -> DataFrame:
    """The postings of sets that share as many signatures of a kind as a link takes."""
    able = shared.groupBy("node", "tag").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= F.shiftright("tag", KIND_BITS)).select("node", "tag")
    return shared.join(able, ["node", "tag"]).select("sig", "node", "tag")


def _keys(postings: DataFrame, rounds: int) -> DataFrame:
    """(node, key): every set takes the label that most of its signatures have, a signature the least label of its sets.

    Labels begin as the sets' own. In the first round sets take the least label.
    """
    postings = postings.select("sig", "node")
    keys = postings.select("node", F.col("node").alias("key")).distinct()
    for turn in range(rounds):
        labelled = postings if turn == 0 else postings.join(keys, "node")
        label = F.col("node") if turn == 0 else F.col("key")
        labels = materialize(labelled.groupBy("sig").agg(F.min(label).alias("label")), "labels")
        found = postings.join(labels, "sig")
        if turn == 0:
            voted = found.groupBy("node").agg(F.min("label").alias("key"))
        else:
            votes = found.groupBy("node", "label").agg(F.count(F.lit(1)).alias("n"))
            voted = votes.groupBy("node").agg(F.min(F.struct(-F.col("n"), "label"))["label"].alias("key"))
        keys = materialize(voted, "labelled")
        discard(labels)
    return keys


def _tasks(postings: DataFrame, keys: DataFrame, block_sets: int, block_tokens: int) -> DataFrame:
    """(k1, k2, b1, b2, side, node, weight): which sets meet in which task.

    All sets of one key meet. Of two keys, those meet that share enough signatures with the other's sets.
    Signatures of the same sets (told by two sums of hashes) count as one that occurs several times.
    """
    postings = postings.select("sig", "node", "tag")
    keyed = postings.join(keys.select("node", "key"), "node")
    hashed, kind = F.xxhash64("node"), F.min(F.col("tag").bitwiseAND(2**KIND_BITS - 1))
    print_of = [F.sum(F.shiftrightunsigned(hashed, 32)), F.sum(hashed.bitwiseAND(2**32 - 1)), F.count(F.lit(1)), kind, F.min("key"), F.max("key")]
    mixed = keyed.groupBy("sig").agg(*(c.alias(f"p{i}") for i, c in enumerate(print_of))).filter("p4 != p5")
    mixed = materialize(mixed.groupBy(*(f"p{i}" for i in range(6))).agg(F.min("sig").alias("sig"), F.count(F.lit(1)).alias("times")).select("sig", "times"), "mixed")
    meeting = materialize(keyed.join(mixed, "sig").select("sig", "times", "node", "tag", "key"), "meeting")
    other = meeting.select("sig", F.col("key").alias("other")).distinct()
    across = meeting.join(other, "sig").filter("key != other")
    across = across.select(F.least("key", "other").alias("k1"), F.greatest("key", "other").alias("k2"), F.when(F.col("key") < F.col("other"), 1).otherwise(2).alias("side"), "node", "tag", "times")
    across = across.groupBy("k1", "k2", "side", "node", "tag").agg(F.sum("times").alias("n")).filter(F.col("n") >= F.shiftright("tag", KIND_BITS))
    across = across.select("k1", "k2", "side", "node").distinct()
    within = keys.select(F.col("key").alias("k1"), F.col("key").alias("k2"), F.lit(0).alias("side"), "node")
    rows = materialize(within.union(across).join(keys.select("node", "weight", "n_shingles"), "node"), "rows")
    count = F.count(F.lit(1))
    blocks = F.greatest(F.ceil(count / F.lit(block_sets)), F.ceil(F.sum("n_shingles") / F.lit(block_tokens))).cast("int")
    sizes = rows.groupBy("k1", "k2", "side").agg(blocks.alias("blocks"), count.alias("n")).filter("side > 0 or n > 1").drop("n")
    sizes = materialize(sizes, "sizes")
    facing = sizes.select("k1", "k2", F.pmod(3 - F.col("side"), F.lit(3)).alias("side"), F.col("blocks").alias("facing"))
    dealt = rows.join(sizes.join(facing, ["k1", "k2", "side"]), ["k1", "k2", "side"]).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    met = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("facing") - 1)))
    alone, own, far = F.col("side") == 0, F.col("block"), F.col("other")
    placed = met.select(
        "k1", "k2", F.when(alone, F.least(own, far)).when(F.col("side") == 1, own).otherwise(far).alias("b1"),
        F.when(alone, F.greatest(own, far)).when(F.col("side") == 1, far).otherwise(own).alias("b2"),
        F.when(alone, F.when(own == far, 0).when(own < far, 1).otherwise(2)).otherwise(F.col("side")).alias("side"), "node", "weight",
    )
    placed = materialize(placed, "placed")
    discard(mixed, meeting, rows, sizes)
    return placed


def _linked(texts: DataFrame, shingle: int, percent: int, group: int, block_sets: int, block_tokens: int) -> tuple[DataFrame, bool]:
    """Per row of ``texts(id, mark, text)``: id, mark, n_shingles, class_first, n_links, first, the firsts being
    (id, mark) of the smallest row of the class and of the component; and whether (id, mark) repeat."""
    if not 50 <= percent <= 100 or shingle < 1:
        raise ValueError("percent is from 50 to 100, shingle at least 1")
    spark = texts.sparkSession
    bound_batches(spark)
    found = materialize(texts.mapInArrow(tidy(_describe(shingle)), "id long, mark long, n_shingles long, d1 long, d2 long"), "sets")
    described = found.filter("n_shingles >= 0")
    often = found.filter("n_shingles < 0").groupBy("d1").agg(F.sum(-F.col("n_shingles")).alias("n")).orderBy(F.desc("n"), "d1").limit(COMMON)
    common = spark.sparkContext.broadcast(np.sort(np.asarray(often.select("d1").toArrow()["d1"].combine_chunks(), np.int64).view(np.uint64)))
    sets = described.filter("n_shingles > 0 and id is not null")
    classes = sets.groupBy("d1", "d2", "n_shingles").agg(F.min(F.struct("id", "mark")).alias("class_first"), F.count(F.lit(1)).alias("weight"))
    classes = materialize(classes.withColumn("node", F.col("d1")), "classes")
    repeats = not described.filter("id is not null").groupBy("id", "mark").count().filter("count > 1").isEmpty()

    expected = (sets.agg(F.sum("n_shingles")).first()[0] or 0) * (100 - percent) // 25
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-expected // SIGNATURES_A_TASK))
    signed = texts.filter("id is not null").select("text").mapInArrow(tidy(_sign(shingle, percent, common)), "sig long, node long, tag int")
    shared = materialize(signed.repartition(partitions, "sig").mapInArrow(tidy(_repeated), "sig long, node long, tag int"), "shared")
    postings = materialize(_enough(shared), "postings")
    discard(shared)
    keys = materialize(_keys(postings, ROUNDS).join(classes.select("node", "weight", "n_shingles", "class_first"), "node"), "keys")
    placed = _tasks(postings, keys, block_sets, block_tokens)
    discard(postings)

    holders = keys.select("node", "class_first.id", "class_first.mark")
    small = holders.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    wanted = texts.join(F.broadcast(holders) if small else holders, ["id", "mark"])
    wanted = wanted.dropDuplicates(["node"]) if repeats else wanted
    tokens = materialize(wanted.select("node", "text").mapInArrow(tidy(_load_sets(shingle)), "node long, n_shingles long, bits binary, tokens binary"), "tokens")
    task = ["k1", "b1", "k2", "b2"]
    bounded = placed.join(tokens.select("node", "n_shingles", "bits"), "node").select(*placed.columns, "n_shingles", "bits")
    likely = materialize(bounded.groupBy(*task).applyInArrow(_likely(percent), placed.schema), "likely")
    met = likely.join(tokens.select("node", "tokens"), "node").select(*task, "side", "node", "weight", "tokens")
    links = materialize(met.groupBy(*task).applyInArrow(_verify(percent, group), "node long, links long, root long"), "links")
    discard(keys, placed, likely, tokens)

    components = connected_components(links.select(F.col("node").alias("a"), F.col("root").alias("b")))
    least = components.join(classes.select("node", "class_first"), "node").groupBy("component").agg(F.min("class_first").alias("first"))
    linked = components.join(least, "component").join(links.groupBy("node").agg(F.sum("links").alias("links")), "node").select("node", "first", "links")
    info = materialize(classes.join(linked, "node", "left").drop("node"), "info")
    discard(classes, links)
    return described.join(info, ["d1", "d2", "n_shingles"], "left").select(
        "id", "mark", "n_shingles", F.when(F.col("id").isNotNull(), F.coalesce("class_first", F.struct("id", "mark"))).alias("class_first"),
        F.when(F.col("id").isNull(), 0).otherwise(F.coalesce("links", F.lit(0)) + F.coalesce("weight", F.lit(1)) - 1).alias("n_links"),
        F.when(F.col("id").isNotNull(), F.coalesce("first", "class_first", F.struct("id", "mark"))).alias("first"),
    ), repeats


def _texts(df: DataFrame, key: str, text: str) -> DataFrame:
    whole = F.col(text).cast("string")
    return df.select(integer_key(df, key).alias("id"), F.xxhash64(whole).alias("mark"), whole.alias("text"))


def jaccard_components(
    df: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, percent: int = PERCENT, group: int = GROUP,
    block_sets: int = BLOCK_SETS, block_tokens: int = BLOCK_TOKENS,
) -> DataFrame:
    """Per row of ``df``: key, n_shingles, class_id (smallest id with an equal set), n_links, component_id."""
    found, _ = _linked(_texts(df, key, text), shingle, percent, group, block_sets, block_tokens)
    return found.select(F.col("id").alias(key), "n_shingles", F.col("class_first.id").alias("class_id"), "n_links", F.col("first.id").alias("component_id"))


def drop_near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """``df`` with one row of each component, that of the smallest id; rows without id all stay.

    Each text without words is a component. Where an id occurs more than once in its component, the text of
    smallest hash stays, once.
    """
    found, repeats = _linked(_texts(df, key, text), shingle, percent, GROUP, BLOCK_SETS, BLOCK_TOKENS)
    own = F.struct("id", "mark")
    gone = materialize(found.filter((F.col("n_shingles") > 0) & (own != F.col("first"))).select("id", "mark").distinct(), "gone")
    small = gone.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    gone = F.broadcast(gone) if small else gone
    mark = F.xxhash64(F.col(text).cast("string"))
    left = df.join(gone, (df[key] == gone["id"]) & (mark == gone["mark"]), "left_anti")
    if not repeats:
        return left
    named = left[key].isNotNull()
    once = left.filter(named).withColumn("__mark", mark).dropDuplicates([key, "__mark"]).drop("__mark")
    return left.filter(~named).unionByName(once)
