"""Fill-in-middle transformation: whole batches of texts are cut at line starts by one numpy kernel on their UTF-8 bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cinefold.llm.common import small_batches

#: The marks before prefix, suffix and middle; a text that contains one stays plain.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Per cent of the texts that are transformed, per cent of those with the suffix first, seed of the draws.
RATE, SUFFIX_FIRST, SEED = 100, 50, 7

#: Classes of bytes, as bits: the end of a line, the first byte of a code point, and the three bytes of a mark.
_LINE, _POINT, _OPEN, _NAME, _CLOSE = (1 << k for k in range(5))
_CLASS = np.zeros(256, np.uint8)
_CLASS[10] |= _LINE
_CLASS[:128] |= _POINT
_CLASS[192:] |= _POINT
for _mark in (PREFIX, SUFFIX, MIDDLE):
    for _bit, _byte in zip((_OPEN, _NAME, _CLOSE), _mark.encode(), strict=True):
        _CLASS[_byte] |= _bit


def marked(kinds: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether each text holds a mark: three bytes of the right classes, none of them another text's."""
    at = np.flatnonzero((kinds[:-2] & _OPEN > 0) & (kinds[1:-1] & _NAME > 0) & (kinds[2:] & _CLOSE > 0))
    text = np.searchsorted(offsets, at, side="right") - 1
    out = np.zeros(len(offsets) - 1, bool)
    out[text[at + 3 <= offsets[text + 1]]] = True
    return out


def cuts(data: np.ndarray, offsets: np.ndarray, first: np.ndarray, second: np.ndarray) -> dict[str, np.ndarray]:
    """Of texts that lie one after another in ``data``: their lines and the two cuts, all rows together.

    n, the byte where the middle begins and ends (``low``, ``high``), the code points of prefix and middle, and whether
    the text is marked. ``first`` and ``second`` are the draws: the cuts come after those numbers of lines, modulo n + 1.
    """
    kinds = _CLASS[data]
    starts = np.zeros(len(data), bool)
    starts[1:] = kinds[:-1] & _LINE > 0  # a line starts behind the end of one,
    starts[offsets[:-1][offsets[:-1] < offsets[1:]]] = True  # and where a text does
    lines = np.flatnonzero(starts)
    points = np.zeros(len(lines) + 1, np.int64)
    if len(lines):
        points[1:] = np.cumsum(np.add.reduceat((kinds & _POINT > 0).astype(np.uint8), lines, dtype=np.int64))
    own = np.searchsorted(lines, offsets)  # lines before each text: sums less their value there begin anew
    n = np.diff(own)
    drawn = np.sort(np.stack((first % (n + 1), second % (n + 1))), axis=0) + own[:-1]
    ends = np.append(lines, len(data))
    before = points[drawn] - points[own[:-1]]
    return {"n": n, "low": ends[drawn[0]], "high": ends[drawn[1]], "prefix_chars": before[0], "middle_chars": before[1] - before[0], "marked": marked(kinds, offsets)}


def transform(texts: pa.Array, draws: list[np.ndarray], rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> dict[str, pa.Array]:
    """n, form, prefix_chars, middle_chars and output of a batch of texts without nulls, with four draws a text."""
    texts = texts.cast(pa.large_string())
    rows = len(texts)
    _, at, held = texts.buffers()
    offsets = np.frombuffer(at, np.int64, rows + 1, texts.offset * 8) if rows else np.zeros(1, np.int64)
    data = np.frombuffer(held, np.uint8, offsets[-1]) if held is not None and offsets[-1] else np.zeros(0, np.uint8)
    base = offsets[0]
    found = cuts(data[base:], offsets - base, draws[0], draws[1])
    plain = (offsets[1:] == offsets[:-1]) | found["marked"] | (draws[2] % 100 >= rate)
    swapped = draws[3] % 100 < suffix_first
    # prefix, middle and suffix of all texts are one array over the same bytes
    edges = np.append(np.stack((offsets[:-1], found["low"] + base, found["high"] + base), axis=1).ravel(), offsets[-1])
    pieces = pa.LargeStringArray.from_buffers(3 * rows, pa.py_buffer(edges.astype(np.int64)), held if held is not None else pa.py_buffer(b""))
    head, flip, still = 3 * np.arange(rows), pa.array(swapped), pa.array(plain)
    one, two = pieces.take(pa.array(np.where(swapped, head + 2, head))), pieces.take(pa.array(np.where(swapped, head, head + 2)))
    wide = lambda x: pa.scalar(x, pa.large_string())
    joined = pc.binary_join_element_wise(pc.if_else(flip, wide(SUFFIX), wide(PREFIX)), one, pc.if_else(flip, wide(PREFIX), wide(SUFFIX)), two, wide(MIDDLE), pieces.take(pa.array(head + 1)), wide(""))
    return {
        "n": pa.array(found["n"], pa.int64()),
        "form": pc.if_else(still, "plain", pc.if_else(flip, "spm", "psm")),
        **{c: pa.array(found[c], pa.int64(), mask=plain) for c in ("prefix_chars", "middle_chars")},
        "output": pc.if_else(still, texts, joined),
    }


def fill_in_middle(docs: DataFrame, ident: str = "doc_id", text: str = "text", rate: int = RATE, suffix_first: int = SUFFIX_FIRST, seed: int = SEED) -> DataFrame:
    """(id, n, form, prefix_chars, middle_chars, output) of every row: its text, with the middle of its lines put last.

    Null texts are empty. Empty texts, texts with a mark and those that ``rate`` leaves out are plain: unchanged, without
    counts. The draws come from a row's id alone (a null id has no digits), so repeated rows come out alike. Other
    columns aren't looked at; an empty table gives no rows. What is held at a time is a batch of 4 MB or one text.
    """
    small_batches(docs.sparkSession)
    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(ident).cast("string"), F.lit(""))), 256)
    rows = docs.select(F.col(ident).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"), drawn.alias("drawn"))
    rows = rows.select("id", "text", *(F.conv(F.substring("drawn", 1 + 8 * k, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)))
    added = {"n": T.LongType(), "form": T.StringType(), "prefix_chars": T.LongType(), "middle_chars": T.LongType(), "output": T.StringType()}
    schema = T.StructType([rows.schema["id"], *(T.StructField(c, t) for c, t in added.items())])

    def moved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = transform(batch.column("text"), [batch.column(f"h{k}").to_numpy(zero_copy_only=False).astype(np.int64) for k in range(1, 5)], rate, suffix_first)
            kind = batch.schema.field("text").type
            columns = {"id": batch.column("id")} | {c: x.cast(kind) if c in ("form", "output") else x for c, x in out.items()}
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return rows.mapInArrow(moved, schema)


def restored(output: str | Column = "output", form: str | Column = "form") -> Column:
    """The text that ``fill_in_middle`` made an output from."""
    output, form = (F.col(c) if isinstance(c, str) else c for c in (output, form))
    body = F.substring(output, len(PREFIX) + 1, 2**31 - 1)
    part = lambda x, mark, k: F.split_part(x, F.lit(mark), F.lit(k))
    middle = part(body, MIDDLE, 2)
    psm = F.concat(part(body, SUFFIX, 1), middle, part(part(body, SUFFIX, 2), MIDDLE, 1))
    spm = F.concat(part(part(body, PREFIX, 2), MIDDLE, 1), middle, part(body, PREFIX, 1))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
l AS (SELECT *, regexp_extract_all(t, '[^\n]*\n|[^\n]+') AS u, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM d),
c AS (SELECT *, len(u) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b,
        CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM l),
p AS (SELECT *, array_to_string(u[1:a], '') AS pre, array_to_string(u[a + 1:b], '') AS mid, array_to_string(u[b + 1:n], '') AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
    sha256(t) AS restored_sha256
FROM p
"""
