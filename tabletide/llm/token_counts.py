"""Token counts of sections by offset-mapped attribution.

A document is encoded once, whole. Each token has a span of characters: from the character of its first byte to that
of its last (a token may be a part of a character, which then belongs to several tokens). Sections are consecutive spans
of the text; the query's are its sentences, each with the white space behind it, to which the next word's token reaches. Spans and borders are joined as intervals by binary search,
and a token that crosses borders is given by `rule`:

- "first": to the section of its first character;
- "last": to the section of its last character;
- "most": to the section with most of its characters, the earliest of equals (the default);
- "share": to all that it touches, in proportion to its characters in each.

The counts of a document's sections add up to its tokens by any rule.

Cases: null and empty texts have one empty section with no tokens; rows that repeat are returned each; very long texts
are encoded whole; other columns are ignored; an empty table gives an empty result."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tabletide.llm.common import row_slices
from tabletide.llm.tokens import VOCABULARY, encoder

SCHEMA = "doc_id long, section int, start long, end long, n_tokens double, n_crossing long"
SENTENCE = r"[.!?]\s+|\n"
RULES = ("first", "last", "most", "share")


def token_spans(text: str, vocabulary: str = VOCABULARY) -> tuple[np.ndarray, np.ndarray]:
    """First and last character of each token."""
    own = encoder(vocabulary)
    ends = np.cumsum(own.token_bytes[own.ids(text)])
    starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    if len(data) == len(text):
        return starts, ends - 1
    char = np.cumsum((data & 0xC0) != 0x80) - 1
    return char[starts], char[ends - 1]


def attribute(first: np.ndarray, last: np.ndarray, borders: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """borders: where sections end, ascending, the last at the text's end. (tokens of each section, crossing tokens that
    begin in it)."""
    n = len(borders)
    a, b = np.searchsorted(borders, first, side="right"), np.searchsorted(borders, last, side="right")
    crossing = np.bincount(a[a != b], minlength=n)
    if rule == "last":
        return np.bincount(b, minlength=n).astype(float), crossing
    counts = np.bincount(a if rule == "first" else a[a == b], minlength=n).astype(float)
    if rule != "first":
        begin = np.concatenate([[0], borders[:-1]])
        one = np.flatnonzero(b == a + 1)  # all at once; tokens over more borders are rare
        before, behind = borders[a[one]] - first[one], last[one] + 1 - borders[a[one]]
        left = before / (before + behind) if rule == "share" else (before >= behind).astype(float)
        counts += np.bincount(a[one], left, minlength=n) + np.bincount(b[one], 1 - left, minlength=n)
        for i in np.flatnonzero(b > a + 1).tolist():
            k = np.arange(a[i], b[i] + 1)
            part = np.minimum(borders[k], last[i] + 1) - np.maximum(begin[k], first[i])
            if rule == "share":
                counts[k] += part / part.sum()
            else:
                counts[k[part.argmax()]] += 1
    return counts, crossing


def section_tokens(docs: DataFrame, border: str = SENTENCE, rule: str = "most", vocabulary: str = VOCABULARY) -> DataFrame:
    """One row for each section of each row of docs (doc_id, text): doc_id, section (from 0), start, end (characters),
    n_tokens, n_crossing (tokens that begin in it and end in a later one). A section ends behind each match of the
    regular expression `border`."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    pattern = re.compile(border)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in row_slices(batches, "text", 4 << 20):
            docs_, parts = [], []
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                text = text or ""
                borders = np.array([m.end() for m in pattern.finditer(text) if 0 < m.end() < len(text)] + [len(text)], np.int64)
                counts, crossing = attribute(*token_spans(text, vocabulary), borders, rule) if text else (np.zeros(1), np.zeros(1, np.int64))
                docs_ += [doc] * len(borders)
                parts.append((np.arange(len(borders)), np.concatenate([[0], borders[:-1]]), borders, counts, crossing))
            cells = [np.concatenate([p[i] for p in parts]) for i in range(5)]
            types = (pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.int64())
            yield pa.record_batch([pa.array(docs_, pa.int64()), *[pa.array(c, t) for c, t in zip(cells, types, strict=True)]], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)
