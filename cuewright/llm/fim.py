"""Fill-in-middle: a text is cut at two of its units' borders and written with its middle last.

The units are the matches of a pattern, and the two cuts are ranks among them that are drawn for each document.
A text is matched twice: the first pass only counts the units, the second advances a lazy iterator of matches to the
smaller and then to the larger rank. Neither pass keeps a match, so beside the text itself and the output the memory is
constant however long the text is. Documents are independent: there is no shuffle.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuewright.llm._shared import small_batches

LINES = r"[^\n]*\n|[^\n]+"


@dataclass(frozen=True)
class Settings:
    """``rate`` per cent of the documents are transformed, ``spm_rate`` per cent of those with the suffix first."""

    unit: str = LINES
    seed: int = 7
    rate: int = 100
    spm_rate: int = 50
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    def __post_init__(self) -> None:
        marks = (self.prefix, self.suffix, self.middle)
        clash = any(a and b and (a is not b and b in a or any(a.endswith(b[:k]) for k in range(1, len(b)))) for a in marks for b in marks)
        if not all(marks) or len(set(marks)) < 3 or clash:
            raise ValueError("marks must be three, not empty, and neither hold one another nor overlap")


def draws(seed: int, doc_id: object) -> tuple[int, int, int, int]:
    """Four 32-bit numbers fixed by the seed and the decimal id; no id is the empty text."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return tuple(int(digest[8 * k : 8 * k + 8], 16) for k in range(4))  # type: ignore[return-value]


def cuts(text: str, unit: re.Pattern, one: int, other: int) -> tuple[int, int, int]:
    """The number of units, and the places behind the smaller and the larger of the ranks ``one`` and ``other``,
    each taken modulo the number of units and one more."""
    n = sum(1 for _ in unit.finditer(text))
    low, high = sorted((one % (n + 1), other % (n + 1)))
    matches = unit.finditer(text)
    begin = _end_of(matches, low, 0)
    return n, begin, _end_of(matches, high - low, begin)


def _end_of(matches: Iterator[re.Match], steps: int, at: int) -> int:
    """Where the match ``steps`` further on ends; ``at`` if there is no step to take."""
    found = next(islice(matches, steps - 1, None), None) if steps else None
    return at if found is None else found.end()


def transform(docs: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, output`` for every row of ``docs``.

    ``form`` is ``psm``, ``spm`` or ``plain``: the text itself, where it is empty, holds a mark or is not drawn; the two
    lengths are null there. A null text is empty, a null id draws as the empty text. Equal rows give equal results; what
    the units leave uncovered belongs to the part in which it lies. Long texts are read whole, one text in memory at a time
    within a batch of bounded bytes. Other columns of ``docs`` do not matter. No rows give no rows.
    """
    small_batches(docs.sparkSession)
    s = settings
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"{id_col} {kind}, n long, form string, prefix_chars long, middle_chars long, output string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit = re.compile(s.unit)
        for batch in batches:
            rows = [_row(key, text, unit, s) for key, text in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist(), strict=True)]
            kinds = {"n": pa.int64(), "form": pa.string(), "prefix_chars": pa.int64(), "middle_chars": pa.int64(), "output": pa.string()}
            made = [pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds.values())]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *made], names=[id_col, *kinds])

    own = docs.select(F.col(id_col).alias("id"), F.col(id_col).cast("string").alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return own.mapInArrow(run, schema)


def _row(key: str | None, text: str, unit: re.Pattern, s: Settings) -> tuple:
    one, other, form, side = draws(s.seed, key)
    n, begin, end = cuts(text, unit, one, other)
    if not text or any(m in text for m in (s.prefix, s.suffix, s.middle)) or form % 100 >= s.rate:
        return n, "plain", None, None, text
    head, mid, tail = text[:begin], text[begin:end], text[end:]
    if side % 100 < s.spm_rate:
        return n, "spm", begin, end - begin, f"{s.suffix}{tail}{s.prefix}{head}{s.middle}{mid}"
    return n, "psm", begin, end - begin, f"{s.prefix}{head}{s.suffix}{tail}{s.middle}{mid}"


def restore(form: Column, output: Column, settings: Settings = Settings()) -> Column:
    """The text that ``transform`` made ``output`` of. The text holds no mark, so the first of each kind parts it."""
    s = settings
    first, second = F.when(form == "spm", s.suffix).otherwise(s.prefix), F.when(form == "spm", s.prefix).otherwise(s.suffix)
    head = F.substring_index(output, s.middle, 1)
    mid = F.substr(output, F.length(head) + len(s.middle) + 1)
    left = F.substr(head, F.length(first) + 1)
    one = F.when(form == "spm", F.substring_index(left, s.prefix, 1)).otherwise(F.substring_index(left, s.suffix, 1))
    two = F.substr(left, F.length(one) + F.length(second) + 1)
    return F.when(form == "plain", output).when(form == "spm", F.concat(two, mid, one)).otherwise(F.concat(one, mid, two))


def digest(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``transform`` with SHA-256 digests of the output and of the text restored from it, in place of the output."""
    made = transform(docs, settings)
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"), F.sha2(restore(F.col("form"), F.col("output"), settings), 256).alias("restored_sha256"),
    )
