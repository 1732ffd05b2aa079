"""Quality rules by distribution divergence.

Each language's reference is measured over all of its documents: a histogram of character classes
and one of its commonest words with a bin for all other words. A document's own two histograms are
compared with its language's by Jensen-Shannon distance (base 2, 0 to 1); it is rejected when a
distance is beyond its limit. Documents under the minimum lengths are too short to judge this way
and only meet the base rule.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cuewright.llm._shared import small_batches, written

CLASSES = ("lower", "upper", "digit", "space", "line", "stop", "bracket", "symbol", "other", "letter", "mark")
FLUSH_WORDS = 200_000
_SYMBOLS = b"#*$%&|<>"
_WINDOW = 8


@dataclass(frozen=True)
class Limits:
    """Minimum lengths in characters and words, largest distances, words in a reference.

    A short text's histograms stray from its language's by chance, about as the inverse root of
    its words, so each largest distance is ``base + slack / sqrt(n_words)``.
    """

    min_chars: int = 200
    min_words: int = 50
    class_base: float = 0.15
    class_slack: float = 1.6
    word_base: float = 0.20
    word_slack: float = 2.4
    common_words: int = 64


def _class_table() -> np.ndarray:
    """Class of each code point below 0x300; above: letters, but for the blocks of marks."""
    table = np.full(0x300, CLASSES.index("letter"), dtype=np.uint8)
    table[:128] = CLASSES.index("other")
    table[128:192] = CLASSES.index("mark")
    for name, chars in (
        ("lower", "abcdefghijklmnopqrstuvwxyz"),
        ("upper", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
        ("digit", "0123456789"),
        ("space", " \t\r\v\f"),
        ("line", "\n"),
        ("stop", ".,;:!?'\"-"),
        ("bracket", "()[]{}/"),
        ("symbol", "#*$%&|<>@^~_=+\\`"),
    ):
        table[[ord(c) for c in chars]] = CLASSES.index(name)
    return table


_TABLE = _class_table()
_PUNCTUATION = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())
_PLAIN = bytes(32 if chr(c) in _PUNCTUATION else c + 32 if 65 <= c <= 90 else c for c in range(256))


def class_counts(text: str) -> np.ndarray:
    """Characters of ``text`` in each of ``CLASSES``."""
    points = np.frombuffer(text.encode("utf-32-le", "replace"), dtype=np.uint32)
    kinds = _TABLE[np.minimum(points, 0x2FF)]
    high = points >= 0x2000
    if high.any():
        kinds[high & ((points < 0x2C00) | (points >= 0x1F000))] = CLASSES.index("mark")
    return np.bincount(kinds, minlength=len(CLASSES))


def plain_words(raw: bytes) -> list[bytes]:
    """Words for the histograms: A-Z lowered, ASCII punctuation as white space."""
    return raw.translate(_PLAIN).split()


def js_distance(p: np.ndarray, q: np.ndarray) -> float:
    """Jensen-Shannon distance of two histograms, base 2; 1 if exactly one is empty, 0 if both are."""
    if not p.sum() or not q.sum():
        return float(bool(p.sum()) != bool(q.sum()))
    p, q = p / p.sum(), q / q.sum()
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        left, right = np.where(p > 0, p * np.log2(p / m), 0), np.where(q > 0, q * np.log2(q / m), 0)
    return float(np.sqrt(max(0.0, (left.sum() + right.sum()) / 2)))


def repeat_words(words: list[bytes]) -> int:
    """Words that lie in a window of 8 words found twice or more in ``words``, the first included."""
    n = len(words) - _WINDOW + 1
    if n < 2:
        return 0
    own = np.fromiter(map(hash, words), dtype=np.int64, count=len(words)).view(np.uint64)
    mixed = (own ^ (own >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    code = np.zeros(n, dtype=np.uint64)
    for j in range(_WINDOW):
        code = code * np.uint64(0x9E3779B97F4A7C15) + mixed[j : j + n]
        code ^= code >> np.uint64(31)
    ranked = np.sort(code)
    if not (ranked[1:] == ranked[:-1]).any():
        return 0
    order = np.argsort(code)
    same = code[order[1:]] == code[order[:-1]]
    # Equal codes are only candidates: the words' own 64-bit hashes decide, place by place.
    left, right = order[:-1][same], order[1:][same]
    for j in range(_WINDOW):
        held = own[left + j] == own[right + j]
        left, right = left[held], right[held]
    twice = np.zeros(n, dtype=bool)
    twice[left] = twice[right] = True
    steps = np.zeros(len(words) + 1, dtype=np.int64)
    steps[:n] += twice
    steps[_WINDOW : _WINDOW + n] -= twice
    return int((np.cumsum(steps[:-1]) > 0).sum())


def base_counts(raw: bytes, text: str, words: list[bytes]) -> tuple[int, int, int, int, int, bool]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    blank = len(raw) - len(raw.translate(None, b" \t\n\v\f\r"))
    seen: set[bytes] = set()
    again = 0
    for line in raw.split(b"\n"):
        if line in seen:
            again += 1
        elif line.strip():
            seen.add(line)
    n, repeated = len(words), repeat_words(words)
    return n, len(text) - blank, len(raw) - len(raw.translate(None, _SYMBOLS)), again, repeated, n < 20 or 100 * repeated > 30 * n


MOST_LANGS = 256  # as many languages' references go to all tasks; those of more are joined to the documents


def reference_table(docs: DataFrame, text_col: str, lang_col: str, limits: Limits) -> DataFrame:
    """``lang, total, ref array<struct<is_class, word, n>>``: each language's class counts, commonest words with
    their counts, and number of words.

    All documents count. Partial counts are summed in each task, so that the shuffle carries a word
    once for each task and language; ties among the commonest words go to the smaller word. A null language
    is one of its own.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[str | None, Counter] = {}
        classes: dict[str | None, np.ndarray] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, counter in words.items():
                names = list(counter)
                for at in range(0, len(names), 50_000):
                    some = names[at : at + 50_000]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(some), pa.string()), pa.array(some, pa.binary()), pa.array([counter[w] for w in some], pa.int64())],
                        names=["lang", "word", "n"],
                    )
            words.clear()

        for batch in batches:
            for raw, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                raw = raw or b""
                words.setdefault(lang, Counter()).update(plain_words(raw))
                counts = class_counts(raw.decode("utf-8", "replace"))
                classes[lang] = classes[lang] + counts if lang in classes else counts
            if sum(map(len, words.values())) > FLUSH_WORDS:
                yield from flush()
        yield from flush()
        for lang, counts in classes.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(CLASSES), pa.string()), pa.array([b" %d" % k for k in range(len(CLASSES))], pa.binary()), pa.array(counts.tolist(), pa.int64())],
                names=["lang", "word", "n"],
            )

    slim = docs.select(F.col(text_col).cast("binary").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    summed = slim.mapInArrow(run, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    summed = summed.withColumn("is_class", F.expr("substring(word, 1, 1) = X'20'"))
    # Words are dealt into a few salts for each language: each salt keeps its own commonest, the language the commonest of those.
    salted = Window.partitionBy("lang", "is_class", F.expr("pmod(xxhash64(word), 64)")).orderBy(F.desc("n"), "word")
    whole = Window.partitionBy("lang", "is_class").orderBy(F.desc("n"), "word")
    summed = written(summed, "words")
    totals = summed.groupBy("lang").agg(F.coalesce(F.sum(F.when(~F.col("is_class"), F.col("n"))), F.lit(0)).alias("total"))
    top = summed.withColumn("r", F.row_number().over(salted)).where(F.col("r") <= limits.common_words)
    top = top.withColumn("r", F.row_number().over(whole)).where(F.col("r") <= limits.common_words)
    refs = top.groupBy(F.col("lang").alias("ref_lang")).agg(F.collect_list(F.struct("is_class", "word", "n")).alias("ref"))
    return written(totals.join(refs, F.col("lang").eqNullSafe(F.col("ref_lang"))).select("lang", "total", "ref"), "references")


def _reference(ref: list, total: int) -> dict:
    own = {"classes": np.zeros(len(CLASSES)), "words": {}, "total": total}
    for row in ref:
        if row["is_class"]:
            own["classes"][int(bytes(row["word"]))] = row["n"]
        else:
            own["words"][bytes(row["word"])] = row["n"]
    return own


def references(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", limits: Limits = Limits()) -> dict:
    """``reference_table`` on the driver, by language."""
    return {r["lang"]: _reference(r["ref"], r["total"]) for r in reference_table(docs, text_col, lang_col, limits).collect()}


class Judge:
    """A language's references in the form that comparing takes."""

    def __init__(self, found: dict):
        self.own: dict = {}
        for lang, ref in found.items():
            self.learn(lang, ref)

    def learn(self, lang: str | None, ref: dict) -> None:
        if lang not in self.own:
            place = {w: i for i, w in enumerate(sorted(ref["words"]))}
            counts = np.array([ref["words"][w] for w in place] + [ref["total"] - sum(ref["words"].values())], dtype=float)
            self.own[lang] = (np.asarray(ref["classes"], dtype=float), place, counts)

    def distances(self, raw: bytes, text: str, lang: str | None) -> tuple[float, float]:
        if lang not in self.own:
            return 0.0, 0.0
        classes, place, counts = self.own[lang]
        words = plain_words(raw)
        counter = Counter(words)
        mine = np.array([counter[w] for w in place] + [0], dtype=float)
        mine[-1] = len(words) - mine.sum()
        return js_distance(class_counts(text).astype(float), classes), js_distance(mine, counts)


def assess(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", limits: Limits = Limits(), keep_rows: bool = False, most_langs: int = MOST_LANGS) -> DataFrame:
    """One row for each row of ``docs``: ``id_col, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, kept, class_distance, word_distance``; with ``keep_rows`` the rows
    of ``docs`` that are kept, with their own columns alone. Distances are null where the text is under
    the minimum lengths. Null texts count as empty and fail the base rule; repeated rows, null ids and
    null languages are rows like any other. Texts of any length are judged whole. The references of up to
    ``most_langs`` languages go to all tasks, those of more are joined to the rows; the results are the same.
    """
    small_batches(docs.sparkSession)
    refs = reference_table(docs, text_col, lang_col, limits)
    rows_ = refs.limit(most_langs + 1).collect()
    joined = len(rows_) > most_langs
    found = {} if joined else {r["lang"]: _reference(r["ref"], r["total"]) for r in rows_}
    names = docs.columns

    def with_refs(df: DataFrame, lang: str) -> DataFrame:
        if not joined:
            return df
        own = refs.withColumnsRenamed({c: f"__cw_{c}" for c in refs.columns})
        return df.join(own.hint("merge"), F.col(lang).cast("string").eqNullSafe(F.col("__cw_lang")), "left").drop("__cw_lang")

    def learnt(judge: Judge, batch: pa.RecordBatch, langs: list) -> None:
        if joined:  # a batch brings its rows' references along
            if len(judge.own) > MOST_LANGS:
                judge.own.clear()
            totals, own = (batch.column(batch.schema.get_field_index(f"__cw_{c}")).to_pylist() for c in ("total", "ref"))
            for lang, total, ref in zip(langs, totals, own, strict=True):
                if lang not in judge.own:
                    judge.learn(lang, _reference(ref, total))

    def judged(raw: bytes | None, lang: str | None, judge: Judge):
        raw = raw or b""
        text = raw.decode("utf-8", "replace")
        counts = base_counts(raw, text, raw.split())
        if len(text) < limits.min_chars or counts[0] < limits.min_words:
            return *counts, not counts[-1], None, None
        a, b = judge.distances(raw, text, lang)
        root = counts[0] ** 0.5
        near = a <= limits.class_base + limits.class_slack / root and b <= limits.word_base + limits.word_slack / root
        return *counts, not counts[-1] and near, a, b

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(found)
        for batch in batches:
            langs = batch.column(2).to_pylist()
            learnt(judge, batch, langs)
            out = [judged(t, g, judge) for t, g in zip(batch.column(1).to_pylist(), langs, strict=True)]
            columns = list(zip(*out, strict=True)) if out else [[]] * 9
            kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()] * 2
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))],
                names=["id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "class_distance", "word_distance"],
            )

    def passing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(found)
        at, lang_at = names.index(text_col), names.index(lang_col)
        for batch in batches:
            texts, langs = batch.column(at).cast(pa.binary()).to_pylist(), batch.column(lang_at).cast(pa.string()).to_pylist()
            learnt(judge, batch, langs)
            yield batch.select(names).filter(pa.array([judged(t, g, judge)[6] for t, g in zip(texts, langs, strict=True)], pa.bool_()))

    if keep_rows:
        return with_refs(docs, lang_col).mapInArrow(passing, docs.schema)
    kind = docs.schema[id_col].dataType.simpleString()
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    return with_refs(slim, "lang").mapInArrow(
        rows,
        f"id {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, class_distance double, word_distance double",
    ).withColumnRenamed("id", id_col)
