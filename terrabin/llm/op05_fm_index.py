"""Windows of WINDOW words that occur anywhere else, by a compressed FM-index per shard.

Candidate pieces come from anchored.py: of each different piece whose anchor is met twice, one holder enters the index
of a shard, counted as often as it has copies.  The index is an FM-index (wavelet matrix over packed bits of the
Burrows-Wheeler transform) with the longest common prefixes of neighbours.  All pieces are then streamed through it, from
their last word to their first: backward search keeps, for each, the longest match that starts at the current word and
occurs twice or more, and passes to the parent interval where no longer match goes on.  These are the matching
statistics, cut at WINDOW; windows where they reach WINDOW are reported.

Words are compared by 64-bit hashes.  Edge cases: null and empty texts have no words; documents of fewer than WINDOW
words keep all; repeated rows and rows with equal or null ids repeat one another; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import anchored as A
from . import exchange as X
from . import fm_index
from .session import table

WINDOW, GRAM = 35, 8
SCHEMA = "doc_id long, n_words long, n_removed long, kept_sha256 string"
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def intervals(units, ends, windows, least, copies, window: int = WINDOW):
    """(group, piece, first word, length, low) of the windows that occur twice or more; they go from all documents."""
    starts = np.concatenate([[0], ends[:-1]])
    index = fm_index.FMIndex(units, ends, window)
    index.weigh(copies)
    full = fm_index.matching_statistics(index, index.coded, starts, ends, window) == window
    piece = np.repeat(np.arange(len(ends)), ends - starts)[full]
    first = np.flatnonzero(full) - starts[piece]
    return np.arange(len(piece)), piece, first, np.full(len(piece), window), np.full(len(piece), A.LOWEST)


TASK = A.Task(WINDOW, GRAM, True, intervals)


def _kept(t: pa.Table, offsets: np.ndarray, gone: np.ndarray) -> tuple[list[str], np.ndarray]:
    texts, n = [], []
    for k, text in enumerate(t["text"].to_pylist()):
        g = gone[offsets[k] : offsets[k + 1]]
        words = _WORD.findall(text or "")
        n.append(int(g.sum()))
        texts.append(" ".join(w for w, x in zip(words, g.tolist(), strict=True) if not x) if n[-1] else " ".join(words))
    return texts, np.array(n, np.int64)


def report(t: pa.Table, offsets: np.ndarray, gone: np.ndarray) -> pa.Table:
    texts, n = _kept(t, offsets, gone)
    return X.rows(SCHEMA, doc_id=t["doc_id"].to_pylist(), n_words=np.diff(offsets), n_removed=n, kept_sha256=[hashlib.sha256(x.encode()).hexdigest() for x in texts])


def without_repeats(t: pa.Table, offsets: np.ndarray, gone: np.ndarray) -> pa.Table:
    return X.rows("doc_id long, text string", doc_id=t["doc_id"].to_pylist(), text=_kept(t, offsets, gone)[0])


def deduplicated(docs: DataFrame) -> DataFrame:
    """doc_id and the kept words."""
    return A.removed(docs, TASK, without_repeats, "doc_id long, text string")


def op5_fm_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.removed(table(spark, sf_dir, "documents"), TASK, report, SCHEMA)


SQL = r"""
with d as (select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
g as (select doc_id, s, sha256(array_to_string(w[s:s + 34], ' ')) as h from (select doc_id, w, unnest(generate_series(1, len(w) - 34)) as s from d where len(w) >= 35) q),
r as (select doc_id, s from g join (select h from g group by h having count(*) > 1) m using (h)),
b as (select distinct doc_id, unnest(generate_series(s, s + 34)) as k from r),
c as (select doc_id, unnest(w) as x, unnest(generate_series(1, len(w))) as k from d),
t as (select c.doc_id, string_agg(c.x, ' ' order by c.k) as kept from c left join b on b.doc_id = c.doc_id and b.k = c.k where b.k is null group by c.doc_id)
select d.doc_id, cast(len(d.w) as bigint) as n_words, cast((select count(*) from b where b.doc_id = d.doc_id) as bigint) as n_removed, sha256(coalesce(t.kept, '')) as kept_sha256
from d left join t using (doc_id)
"""
