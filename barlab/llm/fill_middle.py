"""Fill-in-the-middle by run-length class encoding.

A text is held as its maximal runs of one character class (white space: space
and 09-0D, or anything else), with the running count of units behind each run.
Cutting after k units is a binary search for the run that holds the k-th unit,
and arithmetic inside of it:

* unit ``token``: a run of other characters ends one unit, which takes in the
  white space before it; white space at the end of a text is a unit of its own.
* unit ``char``: every code point is a unit, so a cut lies inside a run.

All rows of an Arrow slice are one array of runs; units count on from row to
row, so one search finds the cuts of all rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from barlab.llm.kernels import is_space, slices, text_buffers

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN, PSM, SPM = "plain", "psm", "spm"


@dataclass
class Runs:
    """Runs of some rows: where each ends (byte, code point) and the units up to there, all counted over the rows together; per row the units and code points before it, and one more."""

    ends: np.ndarray
    points: np.ndarray
    units: np.ndarray
    row_units: np.ndarray
    row_points: np.ndarray
    unit: str

    def find(self, k: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes and code points before the end of the k-th unit of all rows (k from 0: nothing)."""
        if not len(self.ends):
            return np.zeros(len(k), np.int64), np.zeros(len(k), np.int64)
        run = np.searchsorted(self.units, k)  # the first with k units or more behind it
        if self.unit == "token":
            none = k == 0
            return np.where(none, 0, self.ends[run]), np.where(none, 0, self.points[run])
        back = self.points[run] - k  # code points of the run after the cut
        wide = self.ends[run] - np.where(run > 0, self.ends[run - 1], 0) > self.points[run] - np.where(run > 0, self.points[run - 1], 0)
        at = self.ends[run] - back
        if wide.any():  # code points of several bytes: count their heads within the run
            heads = np.concatenate((np.flatnonzero((data & 0xC0) != 0x80), [len(data)]))
            at[wide] = heads[k[wide]]
        return at, k


def encode_runs(data: np.ndarray, offsets: np.ndarray, unit: str = "token") -> Runs:
    """Runs of the rows that ``offsets`` cuts the UTF-8 bytes ``data`` into."""
    n = len(data)
    space = is_space(data)
    row_end = np.zeros(n + 1, bool)
    row_end[offsets[1:]] = True
    ends = np.flatnonzero(np.append(space[1:] != space[:-1], np.ones(min(1, n), bool)) | row_end[1:]) + 1
    heads = (data & 0xC0) != 0x80
    starts = np.concatenate((np.zeros(min(1, len(ends)), np.int64), ends[:-1]))
    points = np.cumsum(np.add.reduceat(heads, starts)) if n else np.zeros(0, np.int64)
    units = np.cumsum(~space[starts] | row_end[ends]) if unit == "token" else points
    edge = np.searchsorted(ends, offsets, "right")  # runs up to each row's edge
    before = lambda x: np.where(edge > 0, x[np.maximum(edge, 1) - 1], 0) if len(x) else np.zeros(len(offsets), np.int64)
    return Runs(ends, points, units, before(units), before(points), unit)


_SENTINEL = "|".join((PREFIX, SUFFIX, MIDDLE))


def _draws(seed: int, id_col: str) -> list[Column]:
    """Four integers of 32 bits from the seed and the id; a null id counts as the empty string."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def fill_in_middle(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", seed: int = 42, percent: int = 50, spm_percent: int = 80, unit: str = "token") -> DataFrame:
    """``docs`` with n, form, prefix_chars, middle_chars and output, which replace columns of these names.

    ``percent`` of the texts are cut in three at two units drawn by their id,
    and of these ``spm_percent`` put the suffix first (spm), the others the
    prefix (psm). A text that is empty, null or holds a sentinel stays plain:
    its output is the text (a null one the empty text), with null lengths.
    ``n``: units of the text. Cuts may coincide, so parts may be empty. Rows
    are independent: repeated ids and texts are cut alike, a null id like an
    empty one; an empty table gives no rows.
    """
    new = ["n", "form", "prefix_chars", "middle_chars", "output"]
    draws = _draws(seed, id_col)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    plain = (text == "") | text.rlike(_SENTINEL) | (draws[2] % 100 >= percent)
    form = F.when(plain, PLAIN).when(draws[3] % 100 < spm_percent, SPM).otherwise(PSM)
    own = [c for c in docs.columns if c not in new]
    drawn = docs.select(*[F.col(f"`{c}`") for c in own], text.alias("__text"), form.alias("form"), draws[0].alias("__a"), draws[1].alias("__b"))
    lead, types = len(own), (T.LongType(), T.StringType(), T.LongType(), T.LongType(), T.StringType())
    schema = T.StructType([*drawn.schema.fields[:lead], *[T.StructField(c, t) for c, t in zip(new, types, strict=True)]])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(lead)
            data, offsets = text_buffers(column)
            for i, j in slices(offsets):
                bytes_ = data[offsets[i] : offsets[j]]
                edges = offsets[i : j + 1] - offsets[i]
                forms = batch.column(lead + 1).slice(i, j - i)
                a, b = (batch.column(lead + k).slice(i, j - i).to_numpy(zero_copy_only=False) for k in (2, 3))
                made = _cut_rows(bytes_, edges, np.asarray(forms.to_pylist(), object), a, b, unit)
                yield pa.RecordBatch.from_arrays([*[x.slice(i, j - i) for x in batch.columns[:lead]], made[0], forms, *made[1:]], [*own, *new])

    return drawn.mapInArrow(cut, schema)


def _cut_rows(data: np.ndarray, offsets: np.ndarray, form: np.ndarray, a: np.ndarray, b: np.ndarray, unit: str) -> list[pa.Array]:
    """n, prefix_chars, middle_chars and output of each row."""
    runs = encode_runs(data, offsets, unit)
    n = np.diff(runs.row_units)
    first, second = a % (n + 1), b % (n + 1)
    low, high = np.minimum(first, second), np.maximum(first, second)
    base, origin, start = runs.row_units[:-1], runs.row_points[:-1], offsets[:-1]
    edges, points = [], []
    for k in (low, high):
        at, point = runs.find(base + k, data)
        edges.append(np.where(k == 0, start, at))  # before a row's first unit lies its own start
        points.append(np.where(k == 0, 0, point - origin))
    raw = data.tobytes()
    out = []
    for kind, s, x, y, e in zip(form, start, edges[0], edges[1], offsets[1:]):
        if kind == PLAIN:
            out.append(raw[s:e])
        elif kind == PSM:
            out.append(b"".join((PREFIX.encode(), raw[s:x], SUFFIX.encode(), raw[y:e], MIDDLE.encode(), raw[x:y])))
        else:
            out.append(b"".join((SUFFIX.encode(), raw[y:e], PREFIX.encode(), raw[s:x], MIDDLE.encode(), raw[x:y])))
    plain = form == PLAIN
    return [pa.array(n), pa.array(points[0], mask=plain), pa.array(points[1] - points[0], mask=plain), pa.array(out, pa.binary()).cast(pa.string())]


def restore(made: DataFrame, *, output_col: str = "output", form_col: str = "form", restored_col: str = "restored") -> DataFrame:
    """``made`` with the exact texts that its outputs were built from, by output and form alone.

    Parts hold no sentinel, so the first one found is the one that was put.
    An unknown or null form gives null.
    """
    out = F.col(output_col)

    def parts(one: str, two: str) -> tuple[Column, Column, Column]:
        at, mid = F.position(F.lit(two), out), F.position(F.lit(MIDDLE), out)
        skip = len(one) + 1
        return F.substring(out, F.lit(skip), at - skip), F.substring(out, at + len(two), mid - at - len(two)), F.substring(out, mid + len(MIDDLE), F.length(out))

    head, tail, middle = parts(PREFIX, SUFFIX)
    last, first, between = parts(SUFFIX, PREFIX)
    text = F.when(F.col(form_col) == PLAIN, out).when(F.col(form_col) == PSM, F.concat(head, middle, tail)).when(F.col(form_col) == SPM, F.concat(first, between, last))
    return made.withColumn(restored_col, text)


ORACLE = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS body, regexp_extract_all(coalesce(text, ''), '[ \t-\r]*[^ \t-\r]+|[ \t-\r]+') AS parts, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents
), d AS (
  SELECT doc_id, body, parts, len(parts) AS n, [('0x' || substr(h, 8 * i + 1, 8))::BIGINT FOR i IN range(4)] AS r FROM t
), f AS (
  SELECT *, least(r[1] % (n + 1), r[2] % (n + 1)) AS a, greatest(r[1] % (n + 1), r[2] % (n + 1)) AS b,
         CASE WHEN body = '' OR contains(body, '<P>') OR contains(body, '<S>') OR contains(body, '<M>') OR r[3] % 100 >= 50 THEN 'plain' WHEN r[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM d
), c AS (
  SELECT *, array_to_string(parts[1:a], '') AS prefix, array_to_string(parts[a + 1:b], '') AS middle, array_to_string(parts[b + 1:], '') AS suffix FROM f
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN body WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(body) AS restored_sha256
FROM c
"""
