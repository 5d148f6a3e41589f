"""Fill-in-middle texts by in-place block rotation, and the exact way back.

A text is cut at two places into prefix, middle and suffix. Its bytes are copied once into a buffer that already has the sentinels in
reading order (``<P>`` prefix ``<M>`` middle ``<S>`` suffix); the segments are then exchanged inside the buffer by rotations, each of which is
three reversals. :func:`restore` finds the sentinels again, rotates back by the other distance and takes them out.

Cuts count code points. They come from a hash of the row's id, so a lost task that runs again makes the same text. A row is worked on
alone: nothing is shuffled, and a task holds one slice of texts.

Results: a null text counts as empty; empty texts, texts that hold a sentinel and the share of rows left out by ``rate`` stay as they are
(``form`` plain, null lengths). Bytes that are no valid UTF-8 pass unchanged. A null id is hashed as the empty string; rows with equal ids
are cut by the same hash numbers, each over its own length. An empty table gives no rows. Input columns named like a result are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import without

PLAIN, PSM, SPM = "plain", "psm", "spm"
SLICE_BYTES = 4 << 20


@dataclass(frozen=True)
class Sentinels:
    """Marks before each segment. None may start with the end of another, or a mark could be read across a border."""

    prefix: bytes = b"<P>"
    suffix: bytes = b"<S>"
    middle: bytes = b"<M>"

    def __post_init__(self):
        marks = self.all()
        for a in marks:
            for b in marks:
                if not a or (a is not b and a in b) or any(a.endswith(b[:n]) for n in range(1, min(len(a), len(b)))):
                    raise ValueError(f"sentinels {a!r} and {b!r} can be confused")

    def all(self) -> tuple[bytes, bytes, bytes]:
        return self.prefix, self.suffix, self.middle


def hash_numbers(doc_id: str, seed: str = "1", count: int = 4) -> list[Column]:
    """Unsigned 32-bit numbers from the first groups of eight hex digits of sha256(``seed:id``)."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(count)]


def transform(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", rate: int = 90, spm: int = 20, seed: str = "1",
              marks: Sentinels = Sentinels(), check: bool = False) -> DataFrame:
    """The input with ``n``, ``form``, ``prefix_chars``, ``middle_chars`` and ``fim_text``.

    ``rate`` is the percentage of rows that are rearranged, ``spm`` the percentage of those that put the suffix first. ``check`` adds
    ``restored``, the text that :func:`restore` gives, in the same pass.
    """
    made = {"n": T.LongType(), "form": T.StringType(), "prefix_chars": T.LongType(), "middle_chars": T.LongType(), "fim_text": T.BinaryType()}
    if check:
        made["restored"] = T.BinaryType()
    h1, h2, h3, h4 = hash_numbers(doc_id, seed)
    wish = F.when(h3 % 100 >= rate, F.lit(PLAIN)).when(h4 % 100 < spm, F.lit(SPM)).otherwise(F.lit(PSM))
    kept = without(docs, *made, "__raw", "__h1", "__h2", "__wish")
    fed = kept.select("*", F.coalesce(F.col(text), F.lit("")).cast("binary").alias("__raw"), h1.alias("__h1"), h2.alias("__h2"), wish.alias("__wish"))
    fields = [*kept.schema.fields, *(T.StructField(k, v) for k, v in made.items())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _slices(batches, "__raw"):
            cols = {name: part.column(name).to_pylist() for name in ("__raw", "__h1", "__h2", "__wish")}
            rows = [rearrange(*row, marks) for row in zip(*cols.values())]
            if check:
                rows = [(*r, undo(r[4], r[1], marks)) for r in rows]
            own = [c for name, c in zip(part.schema.names, part.columns) if name not in cols]
            yield _batch(own, list(zip(*rows)), fields)

    out = fed.mapInArrow(run, T.StructType(fields))
    return _as_text(out, "fim_text", *(["restored"] if check else []))


def restore(docs: DataFrame, fim_text: str = "fim_text", form: str = "form", marks: Sentinels = Sentinels()) -> DataFrame:
    """The input with ``restored``: the exact text from the rearranged one and its form. Null texts count as empty."""
    kept = without(docs, "restored", "__raw")
    fed = kept.select("*", F.coalesce(F.col(fim_text), F.lit("")).cast("binary").alias("__raw"))
    fields = [*kept.schema.fields, T.StructField("restored", T.BinaryType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _slices(batches, "__raw"):
            rows = [undo(raw, how, marks) for raw, how in zip(part.column("__raw").to_pylist(), part.column(form).to_pylist())]
            yield _batch(part.columns[:-1], [rows], fields)

    return _as_text(fed.mapInArrow(run, T.StructType(fields)), "restored")


def _slices(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """Runs of rows with about SLICE_BYTES of text, one row at least."""
    for batch in batches:
        sizes = np.cumsum(pa.compute.binary_length(batch.column(column)).to_numpy(zero_copy_only=False)) if batch.num_rows else []
        start = 0
        while start < batch.num_rows:
            held = sizes[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(sizes, held + SLICE_BYTES)))
            yield batch.slice(start, end - start)
            start = end


def _batch(own: list, made: list, fields: list[T.StructField]) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    new = [pa.array(values, kinds[f.dataType.typeName()]) for values, f in zip(made, fields[len(own):])]
    return pa.RecordBatch.from_arrays([*own, *new], names=[f.name for f in fields])


def _as_text(df: DataFrame, *names: str) -> DataFrame:
    return df.select(*[F.col(c).cast("string").alias(c) if c in names else F.col(f"`{c}`") for c in df.columns])


def reverse(view: np.ndarray, start: int, end: int) -> None:
    """Turns a stretch round in place: two halves change places through one copy of half its size."""
    half = (end - start) // 2
    left = view[start : start + half].copy()
    view[start : start + half] = view[end - half : end][::-1]
    view[end - half : end] = left[::-1]


def rotate(view: np.ndarray, start: int, cut: int, end: int) -> None:
    """Exchanges the neighbours [start, cut) and [cut, end) by three reversals."""
    reverse(view, start, cut)
    reverse(view, cut, end)
    reverse(view, start, end)


def rearrange(raw: bytes, h1: int, h2: int, wish: str, marks: Sentinels) -> tuple:
    """(code points, form, prefix, middle, bytes) of one text."""
    data = np.frombuffer(raw, dtype=np.uint8)
    starts = (data & 0xC0) != 0x80  # all bytes but continuation bytes start a code point
    n = int(np.count_nonzero(starts))
    if not raw or wish == PLAIN or any(m in raw for m in marks.all()):
        return n, PLAIN, None, None, raw
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    at = [low, high] if n == len(raw) else [_offset(starts, low, n), _offset(starts, high, n)]
    buffer = bytearray().join((marks.prefix, raw[: at[0]], marks.middle, raw[at[0] : at[1]], marks.suffix, raw[at[1] :]))
    view = np.frombuffer(buffer, dtype=np.uint8)
    second = len(marks.prefix) + at[0]
    third = second + len(marks.middle) + at[1] - at[0]
    rotate(view, second if wish == PSM else 0, third, len(view))
    return n, wish, low, high - low, bytes(buffer)


def _offset(starts: np.ndarray, char: int, n: int) -> int:
    return len(starts) if char >= n else int(np.flatnonzero(starts)[char])


def undo(raw: bytes, form: str | None, marks: Sentinels) -> bytes:
    """The text behind a rearranged one: the same neighbours change places again, then the sentinels go."""
    if form not in (PSM, SPM):
        return raw
    buffer = bytearray(raw)
    view = np.frombuffer(buffer, dtype=np.uint8)
    suffix, middle = raw.index(marks.suffix), raw.index(marks.middle)
    if form == PSM:  # P prefix | S suffix | M middle: the last two change places
        rotate(view, suffix, middle, len(view))
    else:  # S suffix | P prefix M middle
        rotate(view, 0, raw.index(marks.prefix), len(view))
    whole = bytes(buffer)
    middle, suffix = whole.index(marks.middle), whole.index(marks.suffix)
    return b"".join((whole[len(marks.prefix) : middle], whole[middle + len(marks.middle) : suffix], whole[suffix + len(marks.suffix) :]))
