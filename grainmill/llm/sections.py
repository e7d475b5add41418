"""Token counts by section: whole documents are encoded once and token spans are joined to sections."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainmill.llm.bpe import Encoder, encoder, share_vocabulary

RULES = ("start", "end", "majority", "split")
RESULT = "array<struct<section:int,from:bigint,to:bigint,n_tokens:double>>"


@dataclass(frozen=True)
class SectionRules:
    """``separator`` ends a section and belongs to it.

    A token that crosses a boundary counts for the section of its first
    character (``start``), of its last (``end``), of most of its bytes
    (``majority``, the earlier one of equals), or for each by its share of the
    bytes (``split``).
    """

    separator: str = "\n"
    boundary: str = "majority"


def token_spans(one: Encoder, ids: np.ndarray) -> np.ndarray:
    """Byte offsets of the tokens' starts, and the end of the last: byte-level tokens tile the text."""
    return np.concatenate([[0], np.cumsum(one.lengths[ids])]).astype(np.int64)


def section_spans(data: bytes, separator: bytes) -> np.ndarray:
    """Byte offsets of the sections' starts, and the end of the last; one section at least."""
    starts, at = [0], data.find(separator)
    while at >= 0:
        starts.append(at + len(separator))
        at = data.find(separator, at + len(separator))
    if starts[-1] == len(data) and len(starts) > 1:
        starts.pop()
    return np.array([*starts, len(data)], np.int64)


def attribute(tokens: np.ndarray, sections: np.ndarray, rule: str) -> np.ndarray:
    """Tokens per section: an interval join of two ascending tilings, with the rule for tokens that cross."""
    starts, ends = tokens[:-1], tokens[1:]
    heads = sections[:-1]
    first = np.searchsorted(heads, starts, side="right") - 1
    last = np.searchsorted(heads, ends - 1, side="right") - 1
    counts = np.zeros(len(heads))
    within = first == last
    np.add.at(counts, first[within], 1)
    crossing = np.flatnonzero(~within)
    if rule == "start":
        np.add.at(counts, first[crossing], 1)
    elif rule == "end":
        np.add.at(counts, last[crossing], 1)
    else:
        for t in crossing.tolist():
            parts = np.arange(first[t], last[t] + 1)
            shares = np.minimum(sections[parts + 1], ends[t]) - np.maximum(sections[parts], starts[t])
            if rule == "split":
                counts[parts] += shares / (ends[t] - starts[t])
            else:
                counts[parts[shares.argmax()]] += 1
    return counts


def section_tokens(text: Column, shared, rules: SectionRules = SectionRules()) -> Column:
    """The sections of a text column with their byte spans and token counts."""
    if rules.boundary not in RULES:
        raise ValueError(f"boundary must be one of {RULES}")
    separator, rule = rules.separator.encode(), rules.boundary

    @F.arrow_udf(RESULT)
    def counted(texts: pa.Array) -> pa.Array:
        one = encoder(shared)
        sizes, number, froms, tos, counts = [0], [], [], [], []
        for t in texts:
            text = t.as_py() or ""
            sections = section_spans(text.encode("utf-8", "surrogatepass"), separator)
            number.append(np.arange(len(sections) - 1, dtype=np.int32))
            froms.append(sections[:-1])
            tos.append(sections[1:])
            counts.append(attribute(token_spans(one, one.encode(text)), sections, rule))
            sizes.append(sizes[-1] + len(sections) - 1)
        flat = [np.concatenate(x) if x else np.empty(0, d) for x, d in ((number, np.int32), (froms, np.int64), (tos, np.int64), (counts, float))]
        items = pa.StructArray.from_arrays([pa.array(x) for x in flat], ["section", "from", "to", "n_tokens"])
        return pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), items)

    return counted(text)


def count_section_tokens(docs: DataFrame, path: str, text: str = "text", out: str = "section", rules: SectionRules = SectionRules()) -> DataFrame:
    """One row per section: the document's columns and the struct ``out`` of (section, from, to, n_tokens).

    Each document is encoded once and whole, as a model would read it, so the
    counts of its sections sum to the count of the document; encoding sections
    apart would not.  Offsets are bytes of the UTF-8 text.

    A null or empty text is one empty section with no token.  Rows are
    independent; repeated rows give repeated sections; an empty table stays
    empty.  A column named as ``out`` is replaced; others pass.
    """
    shared = share_vocabulary(docs.sparkSession, path)
    marked = docs.drop(out).withColumn("__sections", section_tokens(F.col(f"`{text}`"), shared, rules))
    # No list is empty; explode() would add a filter that counts all sections a second time.
    return marked.withColumn(out, F.explode_outer("__sections")).drop("__sections")
