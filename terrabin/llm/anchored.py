"""Repeated windows of bytes or words: their candidates, and the way of these between blocks and shards.

Each window of `window` units has an anchor: the leftmost of its `gram`-unit substrings with the smallest hash, which
depends on the window's content alone.  Neighbouring windows with one anchor form a piece (at most window - gram + 1
windows).  Equal windows have equal anchors, so an index over the pieces of one anchor finds all repeats.

    block:  its anchors, each once                                                     -> bucket of the anchor
    bucket: which anchors are met twice or more in all documents                       -> block
    block:  pieces of those anchors, each different one once, with its least doc_id    -> bucket of the anchor
    bucket: one holder of each different piece is asked for its units                  -> block
    block:  units of the asked pieces                                                  -> bucket
    bucket: an index over them finds the repeats; a piece with copies counts as often  -> every block that holds a piece
    block:  the repeats of each piece, at each of its occurrences

Anchors that only one piece has (most) cost a few bytes.  A hot passage costs a bucket one entry a block and different
piece, and the index one piece; neither collects occurrences.  An anchor under which blocks hold more than HOT different
pieces beyond one each is split: its windows become pieces of their own, whose anchors are their contents, so that
they spread over all buckets.  So a bucket gets at most HOT and an entry a block under one anchor.  Blocks grow with the
root of the input (exchange.block_bytes), so that messages between them keep their size.

Two independent 64-bit hashes of the content stand for a piece: pieces count as copies if both are equal; of m different
pieces of one anchor two agree with a chance of about m*m/2**129.  Fewer bits of an anchor only bring pieces together.
Texts are shuffled once, to blocks.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import exchange as X
from . import kernels as K

#: Units that one index of a shard holds, unless one anchor's pieces alone hold more.
SHARD_UNITS = 1 << 18
#: Different pieces of one anchor, beyond one a block, from which it is split.
HOT = 4096
LOWEST = np.iinfo(np.int64).min


@dataclass(frozen=True)
class Task:
    """window, gram: units; words: units are words, else bytes; decide: the shard's index, from (units, ends, windows,
    least doc_id and copies of each piece) to (group, piece, first unit, length, low) of the repeats in each piece: a
    repeat is removed from documents with a larger id than low."""

    window: int
    gram: int
    words: bool
    decide: Callable
    hot: int = HOT

    def slices(self, t: pa.Table):
        """(functions that give the units' hash sums and those of the second hash, offsets in units) of a block's slices,
        one at a time."""
        for _, _, buf, offsets in K.text_slices(t["text"]):
            starts = ends = None
            if self.words:
                starts, ends, offsets = K.runs(~K.SPACE[buf], offsets)

            def first(buf=buf, starts=starts, ends=ends) -> K.Poly:
                one = K.Poly(K.byte_values(buf))
                return K.Poly(one.of(starts, ends)) if self.words else one

            def second(buf=buf, starts=starts, ends=ends) -> K.Poly:
                other = K.Poly2(K.second_values(buf))
                return K.Poly2(other.of(starts, ends)) if self.words else other

            yield first, second, offsets

    def units(self, t: pa.Table, values: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """Units (words as hashes) of a whole block, if asked for, and offsets of its documents in units."""
        units, counts = [], []
        for _, _, buf, offsets in K.text_slices(t["text"]):
            if self.words:
                starts, ends, own = K.runs(~K.SPACE[buf], offsets)
                buf = K.Poly(K.byte_values(buf)).of(starts, ends) if values else buf[:0]
                offsets = own
            units.append(buf)
            counts.append(np.diff(offsets))
        n = np.concatenate(counts) if counts else np.zeros(0, np.int64)
        return np.concatenate(units) if units else np.zeros(0, np.uint8), np.concatenate([[0], np.cumsum(n)])


@dataclass
class Pieces:
    """Pieces of a block, in the order of their first units."""

    key: np.ndarray
    doc: np.ndarray
    start: np.ndarray
    windows: np.ndarray

    def take(self, at: np.ndarray) -> Pieces:
        return Pieces(self.key[at], self.doc[at], self.start[at], self.windows[at])


def slice_pieces(poly: K.Poly, offsets: np.ndarray, task: Task) -> tuple[np.ndarray, ...]:
    """Anchor hash, document, first unit and number of windows of each piece of a slice."""
    n = int(offsets[-1]) - task.window + 1
    if n <= 0:
        return (np.zeros(0, K.U64),) + (np.zeros(0, np.int64),) * 3
    hashes = poly.grams(task.gram)
    anchor = K.leftmost_minimum(hashes, task.window - task.gram + 1)
    inside = np.zeros(n + 1, np.int8)  # a window starts here and ends in the same document
    size = np.diff(offsets)
    long = size >= task.window
    inside[offsets[:-1][long]] += 1
    inside[offsets[1:][long] - task.window + 1] -= 1
    inside = np.cumsum(inside[:-1], dtype=np.int8).astype(bool)
    new = inside.copy()
    new[1:] &= (anchor[1:] != anchor[:-1]) | ~inside[:-1]
    start = np.flatnonzero(new)
    if not len(start):
        return (np.zeros(0, K.U64),) + (np.zeros(0, np.int64),) * 3
    windows = np.add.reduceat(inside, start, dtype=np.int64)
    # least hashes are small: mixed again, they spread evenly over the buckets, which go by high bits
    return K.mix(hashes[anchor[start]] + K.U64(0xA24BAED4963EE407)), np.searchsorted(offsets, start, "right") - 1, start, windows


def block_pieces(task: Task, t: pa.Table) -> tuple[Pieces, np.ndarray]:
    """slice_pieces() of a whole block, and the first content hash of each."""
    found, docs_before, units_before = [(np.zeros(0, K.U64),) + (np.zeros(0, np.int64),) * 3 + (np.zeros(0, K.U64),)], 0, 0
    for first, _, own in task.slices(t):
        poly = first()
        key, doc, start, windows = slice_pieces(poly, own, task)
        found.append((key, doc + docs_before, start + units_before, windows, poly.of(start, start + windows + task.window - 1)))
        docs_before += len(own) - 1
        units_before += int(own[-1])
    *p, content = (np.concatenate(x) for x in zip(*found, strict=True))
    return Pieces(*p), content


def contents(task: Task, t: pa.Table, start: np.ndarray, windows: np.ndarray, which: int) -> np.ndarray:
    """The first (0) or second (1) content hash of pieces that come in the order of their starts."""
    out = np.zeros(len(start), K.U64)
    before = 0
    for *hashes, own in task.slices(t):
        a, b = np.searchsorted(start, [before, before + int(own[-1])])
        if a < b:
            s = start[a:b] - before
            out[a:b] = hashes[which]().of(s, s + windows[a:b] + task.window - 1)
        before += int(own[-1])
    return out


def bucket_bounds(sorted_keys: np.ndarray, bits: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The buckets that some of the sorted keys (of so many bits) go to, by range, and where each one's keys start, and the end."""
    high = sorted_keys >> K.U64(bits - 32)
    bucket = ((high * K.U64(n)) >> K.U64(32)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else np.zeros(0, np.int64)
    return bucket[first], np.append(first, len(bucket))


def anchors(task: Task, n: int, bits: int):
    """A block's different anchors, whether each has several pieces here, and different pieces beyond one."""

    def run(t: pa.Table) -> pa.Table:
        block = t["block"][0].as_py()
        p, content = block_pieces(task, t)
        short, of, count = np.unique(p.key >> K.U64(64 - bits), return_inverse=True, return_counts=True)
        again = np.flatnonzero(count[of] > 1)
        order, first = K.pair_groups(content[again], of[again].astype(K.U64))
        more = np.bincount(of[again][order[first]], minlength=len(short)) - 1
        bucket, cut = bucket_bounds(short, bits, n)
        out = [X.pack(X.squeezed(short[a:b]), count[a:b] > 1, X.narrow(np.maximum(more[a:b], 0))) for a, b in zip(cut, cut[1:], strict=False)]
        return X.rows(X.MESSAGE, bucket=bucket, block=[block] * len(out), payload=out)

    return run


def judge(task: Task):
    """For each anchor that a block sent: 0 for one piece in all, 1 for several, 2 for a hot one."""

    def run(t: pa.Table) -> pa.Table:
        parts = [X.unpack(p.as_py()) for p in t["payload"]]
        sizes = np.cumsum([p[0].shape[1] for p in parts])[:-1]
        order, first = K.groups(np.concatenate([X.unsqueezed(p[0]) for p in parts]))
        of = np.empty(len(order), np.int64)
        of[order] = K.group_of(first, len(order))
        seen = np.bincount(of, np.concatenate([p[1] for p in parts]) + 1.0, len(first))
        more = np.bincount(of, np.concatenate([p[2] for p in parts]).astype(float), len(first))
        flag = (seen > 1).astype(np.uint8) + (more > task.hot)
        return X.rows(X.ANSWER, block=t["block"].to_pylist(), bucket=t["bucket"].to_pylist(), payload=[X.pack(x) for x in np.split(flag[of], sizes)])

    return run


def split(p: Pieces, hot: np.ndarray) -> tuple[Pieces, np.ndarray]:
    """Hot pieces as their single windows; which of the result are such."""
    n = np.where(hot, p.windows, 1)
    at = np.repeat(np.arange(len(n)), n)
    out = p.take(at)
    out.start = out.start + np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
    out.windows = np.where(hot[at], 1, out.windows)
    return out, hot[at]


def send(task: Task, n: int, bits: int):
    """A block's different pieces whose anchors are met twice or more."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not right.num_rows:
            return X.rows(X.MESSAGE, bucket=[], block=[], payload=[])
        t = X.ordered(left)
        block, ids = t["block"][0].as_py(), X.ids_of(t)
        p, content = block_pieces(task, t)
        answers = sorted(zip(right["bucket"].to_pylist(), right["payload"].to_pylist(), strict=True))
        flag = np.concatenate([X.unpack(x)[0] for _, x in answers])
        flag = flag[np.unique(p.key >> K.U64(64 - bits), return_inverse=True)[1]]
        content = content[flag > 0]
        p, hot = split(p.take(flag > 0), flag[flag > 0] > 1)
        if hot.any():
            content = contents(task, t, p.start, p.windows, 0)
        check = contents(task, t, p.start, p.windows, 1)
        key = np.where(hot, K.mix(content + K.U64(0x9E3779B97F4A7C15)), p.key)
        order, first = K.pair_groups(content, check)
        if not len(first):
            return X.rows(X.MESSAGE, bucket=[], block=[], payload=[])
        one, shown = order[first], np.where(hot, 0, p.windows)  # 0: one window of a hot anchor
        many = np.diff(np.append(first, len(order))) > 1
        least, head = np.minimum.reduceat(ids[p.doc][order], first), np.minimum.reduceat(p.start[order], first)
        bucket = (((key[one] >> K.U64(32)) * K.U64(n)) >> K.U64(32)).astype(np.int64)
        by = np.lexsort((head, bucket))
        cut = np.flatnonzero(np.r_[True, bucket[by][1:] != bucket[by][:-1], True])
        out = []
        for a, b in zip(cut, cut[1:], strict=False):
            s = by[a:b]
            o = one[s]
            out.append(X.pack(key[o].astype(np.uint32), content[o], check[o], np.diff(least[s], prepend=0), np.diff(head[s], prepend=0).astype(np.uint32), shown[o].astype(np.uint8), many[s]))
        return X.rows(X.MESSAGE, bucket=bucket[by][cut[:-1]], block=[block] * len(out), payload=out)

    return run


@dataclass
class Entries:
    """What blocks sent to a bucket, by block: each block's range, and for each entry its anchor, piece and place."""

    blocks: list
    cut: np.ndarray
    tag: np.ndarray
    of: np.ndarray  # the different piece that it is
    one: np.ndarray  # of each different piece, an entry
    least: np.ndarray
    head: np.ndarray
    windows: np.ndarray
    many: np.ndarray


def entries(t: pa.Table) -> Entries:
    t = t.sort_by("block")
    parts = [X.unpack(p.as_py()) for p in t["payload"]]
    tag, content, check, windows, many = (np.concatenate([p[k] for p in parts]) for k in (0, 1, 2, 5, 6))
    least, head = (np.concatenate([np.cumsum(p[k], dtype=kind) for p in parts]) for k, kind in ((3, np.int64), (4, np.uint32)))
    order, first = K.pair_groups(content, check)
    of = np.empty(len(tag), np.int64)
    of[order] = K.group_of(first, len(tag))
    return Entries(t["block"].to_pylist(), np.concatenate([[0], np.cumsum([len(p[0]) for p in parts])]), tag, of, order[first], least, head, windows, many)


def ask(t: pa.Table) -> pa.Table:
    """One holder of each different piece is asked, where the anchor is met twice or more."""
    e = entries(t)
    order, first = K.groups(e.tag.astype(K.U64))
    of_tag = np.empty(len(e.tag), np.int64)
    of_tag[order] = K.group_of(first, len(e.tag))
    asked = np.zeros(len(e.tag), bool)
    asked[e.one[np.bincount(of_tag, 1.0 + e.many)[of_tag[e.one]] > 1]] = True
    out = [(b, X.pack(e.head[x:y][asked[x:y]], e.windows[x:y][asked[x:y]])) for b, x, y in zip(e.blocks, e.cut, e.cut[1:], strict=False) if asked[x:y].any()]
    return X.rows(X.ANSWER, block=[x[0] for x in out], bucket=[t["bucket"][0].as_py()] * len(out), payload=[x[1] for x in out])


def own_windows(sent: np.ndarray) -> np.ndarray:
    """Numbers of windows as they are, of such as were sent."""
    return np.maximum(sent.astype(np.int64), 1)


def gather(units: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    at = np.repeat(start - (np.cumsum(length) - length), length) + np.arange(int(length.sum()))
    return units[at]


def tell(task: Task):
    """A block answers each bucket with the units of the pieces it asked for."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not right.num_rows:
            return X.rows(X.MESSAGE, bucket=[], block=[], payload=[])
        t = X.ordered(left)
        block = t["block"][0].as_py()
        units, _ = task.units(t)
        out = []
        for data in right["payload"].to_pylist():
            head, windows = X.unpack(data)
            out.append(X.pack(head, windows, gather(units, head.astype(np.int64), own_windows(windows) + task.window - 1)))
        return X.rows(X.MESSAGE, bucket=right["bucket"].to_pylist(), block=[block] * len(out), payload=out)

    return run


def indexed(task: Task, units: np.ndarray, windows: np.ndarray, tag: np.ndarray, least: np.ndarray, copies: np.ndarray) -> tuple[np.ndarray, ...]:
    """task.decide over parts of a shard of about SHARD_UNITS: pieces of one anchor share a tag and stay together."""
    length = windows + task.window - 1
    begin = np.cumsum(length) - length
    n = int(length.sum()) // SHARD_UNITS + 1
    by, cut = X.split_by(((K.mix(tag.astype(K.U64)) >> K.U64(32)) * K.U64(n) >> K.U64(32)).astype(np.int64), n)
    out, groups = [(np.zeros(0, np.int64),) * 5], 0
    for k in range(n):
        s = by[cut[k] : cut[k + 1]]
        if len(s):
            group, piece, first, run, low = task.decide(gather(units, begin[s], length[s]), np.cumsum(length[s]), windows[s], least[s], copies[s])
            out.append((group + groups, s[piece], first, run, low))
            groups += int(group.max()) + 1 if len(group) else 0
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def decide(task: Task, whole: bool):
    """Repeats of the pieces, for each block that holds them; without whole, only those that some document there loses."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return X.rows(X.ANSWER, block=[], bucket=[], payload=[])
        e = entries(right)
        bucket = right["bucket"][0].as_py()
        least = np.full(len(e.one), K.NULL_ID)
        np.minimum.at(least, e.of, e.least)
        copies = np.bincount(e.of, 1.0 + e.many, len(e.one)).astype(np.int64)
        place = (np.repeat(e.blocks, np.diff(e.cut)).astype(np.int64) << 32) | e.head
        place = place << 8 | e.windows
        by_place = np.argsort(place)
        told = [X.unpack(p.as_py()) for p in left["payload"]]
        head, windows, units = (np.concatenate([p[k] for p in told]) for k in range(3))
        own = ((np.repeat(left["block"].to_numpy(), [len(p[0]) for p in told]).astype(np.int64) << 32) | head) << 8 | windows
        of = e.of[by_place[np.searchsorted(place[by_place], own)]]
        group, piece, offset, length, low = indexed(task, units, own_windows(windows), e.tag[e.one[of]], least[of], copies[of])
        by, cut = X.split_by(of[piece], len(e.one))
        answers = []
        for b, x, y in zip(e.blocks, e.cut, e.cut[1:], strict=False):
            held = e.of[x:y]
            n = cut[held + 1] - cut[held]
            at, entry = gather(by, cut[held], n), np.repeat(np.arange(x, y), n)
            if not whole:
                some = e.many[entry] | (low[at] < e.least[entry])
                at, entry = at[some], entry[some]
            if len(at):
                more = (group[at] + (bucket << 40),) if whole else ()
                answers.append((b, X.pack(e.head[entry], e.windows[entry], offset[at].astype(np.uint8), length[at].astype(np.uint8), low[at], *more)))
        return X.rows(X.ANSWER, block=[a[0] for a in answers], bucket=[bucket] * len(answers), payload=[a[1] for a in answers])

    return run


def alike(keys: tuple[np.ndarray, np.ndarray], one: np.ndarray, second: Callable) -> tuple[np.ndarray, np.ndarray]:
    """Which of many hashes are among keys (pairs of two hashes), and which key each is; second(at) gives their second hashes."""
    by = np.lexsort((keys[1], keys[0]))
    a, b = keys[0][by], keys[1][by]
    at = np.searchsorted(a, one)
    met = np.flatnonzero(a[np.minimum(at, len(a) - 1)] == one)
    at, two, found = at[met], second(met), [(met[:0], by[:0])]
    while len(met):
        same = b[at] == two
        found.append((met[same], by[at[same]]))
        at = at + 1  # another key with the same first hash
        on = ~same & (a[np.minimum(at, len(a) - 1)] == one[met]) & (at < len(a))
        met, at, two = met[on], at[on], two[on]
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def occurrences(task: Task, t: pa.Table, head: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index, first unit, document) of all occurrences in a block of the different pieces that start at these places."""
    place, back = np.unique(head.astype(np.int64) << 8 | windows, return_inverse=True)
    start, hot = place >> 8, (place & 255) == 0
    if not len(start):
        return (np.zeros(0, np.int64),) * 3
    found = [(np.zeros(0, np.int64),) * 3]
    if not hot.all():
        p, one = block_pieces(task, t)
        heads = np.searchsorted(p.start, start[~hot])
        like = np.flatnonzero(np.isin(one, one[heads]))  # by the first hash; the second is needed of these alone
        two = contents(task, t, p.start[like], p.windows[like], 1)
        met, key = alike((one[heads], two[np.searchsorted(like, heads)]), one[like], lambda at: two[at])
        found.append((np.flatnonzero(~hot)[key], p.start[like[met]], p.doc[like[met]]))
    if hot.any():  # all windows of the block with their contents
        units_before, docs_before = 0, 0
        keys = [contents(task, t, start[hot], np.ones(int(hot.sum()), np.int64), k) for k in (0, 1)]
        for first, second, own in task.slices(t):
            at, d = K.windows(np.diff(own), task.window)
            met, key = alike((keys[0], keys[1]), first().of(at, at + task.window), lambda x, at=at, second=second: second().of(at[x], at[x] + task.window))
            found.append((np.flatnonzero(hot)[key], at[met] + units_before, d[met] + docs_before))
            units_before += int(own[-1])
            docs_before += len(own) - 1
    which, unit, doc = (np.concatenate(x) for x in zip(*found, strict=True))
    by, cut = X.split_by(which, len(place))
    n = (cut[1:] - cut[:-1])[back]
    at = gather(by, cut[:-1][back], n)
    return np.repeat(np.arange(len(back)), n), unit[at], doc[at]


def answers_of(right: pa.Table) -> list[np.ndarray]:
    return [np.concatenate(x) for x in zip(*(X.unpack(p) for p in right["payload"].to_pylist()), strict=True)]


def finish(task: Task, report: Callable):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        t = X.ordered(left)
        _, offsets = task.units(t, values=False)
        gone = np.zeros(int(offsets[-1]), bool)
        if right.num_rows:
            head, windows, offset, length, low = answers_of(right)
            which, start, doc = occurrences(task, t, head, windows)
            lost = X.ids_of(t)[doc] > low[which]
            which = which[lost]
            gone = K.covered(len(gone), start[lost] + offset[which], length[which].astype(np.int64))
        return report(t, offsets, gone)

    return run


def found(docs: DataFrame, task: Task, whole: bool, block_bytes: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Blocks of documents, and for each block the repeats in the pieces that it holds."""
    blocked, n, total = X.blocks(docs, block_bytes)
    bits = min(60, max(36, total.bit_length() + 4))
    per_block = blocked.groupBy("block")
    met = per_block.applyInArrow(X.frugal(anchors(task, n, bits)), X.MESSAGE).groupBy("bucket").applyInArrow(X.frugal(judge(task)), X.ANSWER)
    sent = per_block.cogroup(met.groupBy("block")).applyInArrow(X.frugal_pair(send(task, n, bits)), X.MESSAGE).groupBy("bucket")
    asked = sent.applyInArrow(X.frugal(ask), X.ANSWER)
    told = per_block.cogroup(asked.groupBy("block")).applyInArrow(X.frugal_pair(tell(task)), X.MESSAGE)
    return blocked, told.groupBy("bucket").cogroup(sent).applyInArrow(X.frugal_pair(decide(task, whole)), X.ANSWER)


def removed(docs: DataFrame, task: Task, report: Callable, schema: str, block_bytes: int | None = None) -> DataFrame:
    """report(block's documents, offsets in units, removed units) for every block."""
    blocked, answers = found(docs, task, False, block_bytes)
    return blocked.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(X.frugal_pair(finish(task, report)), schema)
