"""Line-first cleaning: rules judge every line, failing lines go, then thin documents go.

Each text is split at line feeds. A line with words fails if it is
  navigation   separators or symbols make up too much of it, or it is a fragment of one or
               two words that no punctuation ends;
  punctuation  it is shouted: mostly capitals, with runs of exclamation marks;
  boilerplate  it repeats an earlier line of the text, or opens with a known notice and has at
               most `notice_words` words.
A document is rejected if the failing lines hold more than `max_lost` of its words, or if it
fails the base rules (fewer than `min_words` words, or more than `max_repeat` of the words in
5-word windows that the text has twice or more).

Defined results: a null, empty or blank text has no words and fails the base rule; a text or line of
any length is read whole, a text in one task; of equal lines the first stays, whatever stands
between; repeated rows and equal texts are judged alike, each by itself; an empty table gives an
empty one; other columns are not read, whatever their names. Work is one pass over the rows without
a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinmatch.llm.common import map_texts
from kinmatch.llm.text import Chunk, mix

#: How lines of notices begin, in lower case.
NOTICES = ("licensed under", "copyright", "all rights reserved", "spdx-license-identifier", "cookie", "click here", "sign in", "log in", "subscribe", "privacy policy", "terms of", "share this", "read more", "back to top", "lorem ipsum", "javascript")
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_ENDS = np.zeros(256, bool)
_ENDS[list(b".!?:;,)]\"'")] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = _UPPER.copy()
_LETTER[97:123] = True
_FACTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lost_words")


@dataclass(frozen=True)
class LineRules:
    max_symbols: float = 0.3  # symbols for each word of a line
    max_upper: float = 0.7  # of a line's ASCII letters, when it has exclamation runs
    notice_words: int = 40  # a longer line is prose, however it opens
    max_lost: float = 0.5
    min_words: int = 10
    max_repeat: int = 20  # per cent


def _repeated(key: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which entries occur again within their text, and which of those are not the first."""
    key = mix(key ^ mix(doc.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    later = np.zeros(len(key), bool)
    later[order[1:][same]] = True
    twice = later.copy()
    twice[order[:-1][same]] = True
    return twice, later


def line_facts(c: Chunk, rules: LineRules) -> dict[str, np.ndarray]:
    """Counts for each text, and for each line whether it fails."""
    inside = np.zeros(len(c.data) + 1, np.int32)
    inside[c.starts] += 1
    np.subtract.at(inside, c.stops, 1)
    in_word = np.cumsum(inside[:-1]) > 0
    before = lambda mask: np.concatenate([[0], np.cumsum(mask)])
    chars, symbols = before(in_word & ((c.data & 0xC0) != 0x80)), before(_SYMBOL[c.data])
    upper, letters = before(_UPPER[c.data]), before(_LETTER[c.data])
    bangs = before(np.append(c.data[:-1] == 33, False) & np.append(c.data[1:] == 33, False) if len(c.data) else np.zeros(0, bool))
    span = lambda x, a, b: x[b] - x[a]

    starts, stops, doc = c.lines()
    a, b = np.searchsorted(c.starts, starts), np.searchsorted(c.starts, stops)
    words = b - a
    full = np.flatnonzero(words > 0)
    _, later = _repeated(c.span_hash(starts[full], stops[full]), doc[full])
    last = c.data[np.minimum(c.stops[b[full] - 1], stops[full]) - 1]
    n, sym = words[full], span(symbols, starts[full], stops[full])
    shouted = (span(bangs, starts[full], stops[full]) > 0) & (span(upper, starts[full], stops[full]) > rules.max_upper * np.maximum(1, span(letters, starts[full], stops[full])))
    fragment = (n <= 2) & ~_ENDS[last] & (last < 0x80)
    fails = later | (sym > rules.max_symbols * n) | shouted | fragment
    text, begin = c.data.tobytes(), c.starts[a[full]]
    # Lines that begin like a notice, by their first three letters.
    head = np.zeros(len(full), np.int64)
    for j in range(3):
        head = head << 8 | _LOWER[c.data[np.minimum(begin + j, len(c.data) - 1)]]
    for k in np.flatnonzero(~fails & (n <= rules.notice_words) & np.isin(head, _NOTICE_HEADS)):
        fails[k] = text[begin[k] : begin[k] + _NOTICE_LENGTH].lower().startswith(_NOTICE_BYTES)
    bad = np.zeros(len(starts), bool)
    bad[full] = fails

    gram, gram_doc = c.grams(5)
    twice, _ = _repeated(gram, gram_doc)
    cover = np.zeros(len(c.starts) + 6, np.int32)
    at = c.gram_starts(5)[twice]
    cover[at] += 1
    cover[at + 5] -= 1
    covered = before(np.cumsum(cover)[: len(c.starts)] > 0)
    per = lambda x: np.bincount(doc, x, minlength=c.n).astype(np.int64)
    dup = np.zeros(len(starts))
    dup[full] = later
    return {
        "n_words": c.n_words.astype(np.int64), "word_chars": span(chars, c.begin, c.end), "n_symbols": span(symbols, c.begin, c.end),
        "n_dup_lines": per(dup), "n_repeat_words": span(covered, c.first[:-1], c.first[1:]), "lost_words": per(np.where(bad, words, 0)),
        "line_starts": starts, "line_stops": stops, "line_doc": doc, "line_fails": bad,
    }


_NOTICE_BYTES = tuple(x.encode() for x in NOTICES)
_NOTICE_HEADS = np.unique([int.from_bytes(x[:3]) for x in _NOTICE_BYTES])
_NOTICE_LENGTH = max(map(len, _NOTICE_BYTES))
_LOWER = np.arange(256)
_LOWER[65:91] += 32


def clean_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: LineRules = LineRules(), with_text: bool = True) -> DataFrame:
    """One row for each row of df: its id, the counts, base_failed, kept and the cleaned text."""

    def make():
        def one(rows: pa.RecordBatch, c: Chunk) -> pa.RecordBatch:
            facts = line_facts(c, rules)
            out = [rows.column("row_id"), *(pa.array(facts[k], pa.int64()) for k in _FACTS)]
            if with_text:
                data = c.data.tobytes()
                left: list[list[bytes]] = [[] for _ in range(c.n)]
                for d, a, b in zip(*(facts[k][~facts["line_fails"]] for k in ("line_doc", "line_starts", "line_stops")), strict=True):
                    left[d].append(data[a:b])
                out.append(pa.array([b"\n".join(x).decode() for x in left], pa.string()))
            return pa.RecordBatch.from_arrays(out, ["row_id", *_FACTS, *["cleaned"] * with_text])

        return one

    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("row_id"), F.col(text_col).cast("string").alias("text"))
    out = map_texts(rows, "text", make, f"row_id {kind}, " + ", ".join(f"{k} bigint" for k in _FACTS) + ", cleaned string" * with_text)
    failed = (F.col("n_words") < rules.min_words) | (100 * F.col("n_repeat_words") > rules.max_repeat * F.col("n_words"))
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("lost_words") <= rules.max_lost * F.col("n_words"))).withColumnRenamed("row_id", id_col)
