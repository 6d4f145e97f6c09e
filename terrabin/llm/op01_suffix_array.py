"""Substrings of WINDOW bytes that an earlier document holds, by enhanced suffix arrays.

Candidate pieces come from anchored.py: of each different piece whose anchor is met twice, one holder enters the index
of a shard, with the least doc_id and the number of its copies.  The suffixes that start a window are sorted, neighbours
give the longest common prefixes, and a stack scan visits the common-prefix interval tree:
each interval of at least WINDOW bytes whose suffixes differ in the byte before them is a maximal repeat, and so is a
piece with copies; its occurrences, those of copies included, form a group.  groups() returns the groups with all
occurrences; the query removes those outside a group's smallest document.  A piece ends where the next anchor takes over,
so a repeat longer than a piece is a chain of overlapping groups; the first window of a piece counts as left-diverse
for that reason.

Edge cases: null and empty texts have no bytes; documents of fewer than WINDOW bytes keep all; equal doc_ids are
not smaller than one another; null ids are larger than all others; repeated rows are separate; other columns are
ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import anchored as A
from . import exchange as X
from . import suffix
from .session import table

WINDOW, GRAM = 50, 20
SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def windows_sorted(units, ends, windows):
    """Position, piece, offset, common prefix with the one before and left symbol of the windows' suffixes, in order.

    Pieces are short, so suffixes are sorted as rows of bytes, and neighbours compared: bytes count from 1 (255 does not
    occur in UTF-8), and zeros stand between pieces, as many as the longest has windows."""
    starts = np.concatenate([[0], ends[:-1]])
    width = int((ends - starts).max())
    piece = np.repeat(np.arange(len(ends)), windows)
    offset = np.arange(len(piece)) - np.repeat(np.cumsum(windows) - windows, windows)
    at = starts[piece] + offset
    size = ends[piece] - at
    gap = int(windows.max())
    filled = np.zeros(len(units) + gap * len(ends), np.uint8)
    filled[np.arange(len(units)) + np.repeat(np.arange(len(ends)) * gap, ends - starts)] = units + np.uint8(1)
    rows = np.lib.stride_tricks.sliding_window_view(filled, width)[at + piece * gap]
    order = np.argsort(rows.view(f"V{width}").reshape(-1), kind="stable")
    rows, at, piece, offset, size = rows[order], at[order], piece[order], offset[order], size[order]
    differ = rows[1:] != rows[:-1]
    first = differ.argmax(1)
    first[~differ[np.arange(len(first)), first]] = width
    lcp = np.zeros(len(at), np.int64)
    lcp[1:] = np.minimum(first, np.minimum(size[1:], size[:-1]))
    return at, piece, offset, lcp, np.where(offset > 0, units[np.maximum(at - 1, 0)].astype(np.int64), -1)


def repeats(units, ends, windows, least, copies, window: int = WINDOW):
    """(group, piece, first byte, length, least doc_id of the group) of the occurrences of all maximal repeats."""
    at, piece, offset, lcp, left = windows_sorted(units, ends, windows)
    own = least[piece]
    # runs of suffixes that share a whole window
    first = np.flatnonzero(lcp < window)
    size = np.diff(np.append(first, len(at)))
    found = []
    for a, n in zip(first[size > 1].tolist(), size[size > 1].tolist(), strict=True):
        for i, j, length, low in suffix.maximal_repeats(lcp[a : a + n].tolist(), left[a : a + n].tolist(), own[a : a + n].tolist()):
            found.append((a + i, j - i + 1, length, low))
    i, n, length, low = np.array(found, np.int64).reshape(-1, 4).T
    who = A.gather(np.arange(len(at)), i, n)
    group, length, low = (np.repeat(x, n) for x in (np.arange(len(i)), length, low))
    # a piece with copies is a repeat, unless an interval has shown it whole
    whole = windows + window - 1
    seen = np.zeros(len(ends), bool)
    seen[piece[who][(offset[who] == 0) & (length == whole[piece[who]])]] = True
    more = np.flatnonzero((copies > 1) & ~seen)
    return tuple(np.concatenate(x) for x in ((group, len(i) + np.arange(len(more))), (piece[who], more), (offset[who], np.zeros(len(more), np.int64)), (length, whole[more]), (low, least[more])))


TASK = A.Task(WINDOW, GRAM, False, repeats)


def report(t: pa.Table, offsets: np.ndarray, gone: np.ndarray) -> pa.Table:
    texts = [(x or "").encode() for x in t["text"].to_pylist()]
    n, spans, digest = [], [], []
    for k, text in enumerate(texts):
        g = gone[offsets[k] : offsets[k + 1]]
        n.append(int(g.sum()))
        spans.append(int(g[:1].sum() + (g[1:] & ~g[:-1]).sum()))
        digest.append(hashlib.sha256(np.frombuffer(text, np.uint8)[~g].tobytes() if n[-1] else text).hexdigest())
    return X.rows(SCHEMA, doc_id=t["doc_id"].to_pylist(), n_bytes=[len(x) for x in texts], n_removed=n, n_spans=spans, kept_sha256=digest)


def without_repeats(t: pa.Table, offsets: np.ndarray, gone: np.ndarray) -> pa.Table:
    """The remaining bytes of each document; a cut may split a character, so they are bytes."""
    texts = [(x or "").encode() for x in t["text"].to_pylist()]
    kept = [np.frombuffer(x, np.uint8)[~gone[offsets[k] : offsets[k + 1]]].tobytes() for k, x in enumerate(texts)]
    return X.rows("doc_id long, kept binary", doc_id=t["doc_id"].to_pylist(), kept=kept)


def deduplicated(docs: DataFrame) -> DataFrame:
    """doc_id and kept bytes."""
    return A.removed(docs, TASK, without_repeats, "doc_id long, kept binary")


def groups(docs: DataFrame, block_bytes: int | None = None) -> DataFrame:
    """(group, doc_id, start, length): every occurrence, in bytes, of every maximal repeat group."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        t = X.ordered(left)
        _, offsets = TASK.units(t, values=False)
        head, windows, offset, length, _, group = A.answers_of(right) if right.num_rows else (np.zeros(0, np.int64),) * 6
        index, start, doc = A.occurrences(TASK, t, head, windows)
        ids = t["doc_id"].take(pa.array(doc))
        return pa.table({"group": group[index], "doc_id": ids, "start": start - offsets[doc] + offset[index], "length": length[index].astype(np.int64)})

    blocked, answers = A.found(docs, TASK, True, block_bytes)
    return blocked.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(X.frugal_pair(run), "group long, doc_id long, start long, length long")


def op1_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.removed(table(spark, sf_dir, "documents"), TASK, report, SCHEMA)


SQL = r"""
with d as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents),
p as (select doc_id, unnest(generate_series(0, cast(length(h) / 2 as bigint) - 50)) as s, h from d where length(h) >= 100),
g as (select doc_id, s, substr(h, cast(2 * s + 1 as bigint), 100) as w from p),
m as (select w, min(doc_id) as least from g group by w having count(distinct doc_id) > 1),
r as (select g.doc_id, g.s from g join m using (w) where g.doc_id > m.least),
b as (select distinct doc_id, unnest(generate_series(s, s + 49)) as k from r),
n as (select doc_id, count(*) as n_removed, sum(case when k - 1 = last then 0 else 1 end) as n_spans
  from (select doc_id, k, coalesce(lag(k) over (partition by doc_id order by k), -9) as last from b) q group by doc_id),
c as (select doc_id, unnest(generate_series(0, cast(length(h) / 2 as bigint) - 1)) as k, h from d where doc_id in (select doc_id from r)),
t as (select c.doc_id, string_agg(substr(h, cast(2 * c.k + 1 as bigint), 2), '' order by c.k) as h
  from c left join b on b.doc_id = c.doc_id and b.k = c.k where b.k is null group by c.doc_id)
select d.doc_id, cast(length(d.h) / 2 as bigint) as n_bytes, cast(coalesce(n.n_removed, 0) as bigint) as n_removed,
  cast(coalesce(n.n_spans, 0) as bigint) as n_spans, sha256(unhex(case when n.doc_id is null then d.h else coalesce(t.h, '') end)) as kept_sha256
from d left join n using (doc_id) left join t using (doc_id)
"""
