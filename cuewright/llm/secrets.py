"""Secret scans through a trigram inverted index.

From each rule's regular expression a Boolean query over trigrams is derived: trigrams that every
match must hold. Documents are indexed block by block (trigram -> documents, restricted to the
trigrams that some query names), the queries' postings are intersected and united, and only the
candidates are verified with the expression itself. A rule without mandatory trigrams scans every
document. Index and queries fold A-Z to a-z, which only adds candidates.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from re import _constants as op
from re import _parser as sre

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuewright.llm._shared import small_batches

BLOCK_BYTES = 4 << 20
MAX_STRINGS = 64
REDACTED = "[SECRET]"


@dataclass(frozen=True)
class Rule:
    """A kind of secret: matches of ``pattern`` whose ``group`` has at least ``least`` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    flags: int = re.ASCII


# The base rules' expressions, then public token formats.
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, re.ASCII | re.IGNORECASE),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),
)
# A private key goes on to its END line. If none comes before the next BEGIN, its headers and lines of base64 belong to it
# however they are broken, quoted or escaped; the last line may be short, so that the word after whole lines goes with them.
_KEY_END = r"(?:(?!-----BEGIN )[\s\S])*?-----END [A-Z0-9 ]{0,30}PRIVATE KEY-----"
_KEY_GAP = r"""(?:[\s>#*|"'`,;]|\\[nrt])*+"""
_KEY_REST = rf"(?:{_KEY_GAP}[A-Za-z][A-Za-z-]*+:\x20[^\n\\]*+)*+(?:{_KEY_GAP}[A-Za-z0-9+/=]{{16,}}+)++(?:{_KEY_GAP}[A-Za-z0-9+/=]++)?"
_PEM = rf"-----BEGIN [A-Z0-9 ]{{0,30}}PRIVATE KEY-----(?:{_KEY_END}|{_KEY_REST})?"
MORE = (
    Rule("pem", _PEM),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+"),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]{16,}"),
    Rule("login", r"://[A-Za-z0-9._~-]{1,64}:[A-Za-z0-9._~!$&*+,;=%-]{3,64}@[A-Za-z0-9]"),
)
RULES = BASE + MORE

# A query is True (no condition), ("tri", t), ("and", parts) or ("or", parts).


def _and(parts: list) -> object:
    kept = list(dict.fromkeys(p for p in parts if p is not True))
    return True if not kept else kept[0] if len(kept) == 1 else ("and", tuple(kept))


def _or(parts: list) -> object:
    kept = list(dict.fromkeys(parts))
    return True if True in kept or not kept else kept[0] if len(kept) == 1 else ("or", tuple(kept))


def _of_strings(strings: set[str]) -> object:
    """What a text must hold if it holds one of ``strings``."""
    return _or([_and([("tri", s[i : i + 3]) for i in range(len(s) - 2)]) for s in sorted(strings)])


def _fold(code: int) -> str:
    """A literal in the index's alphabet; characters outside ASCII give nothing to look up."""
    return chr(code).lower() if code < 128 else ""


def _analyse(nodes) -> tuple[set[str] | None, object]:
    """The exact strings that ``nodes`` match, if they are few, and the query for a match."""
    exact, run, found = True, {""}, []

    def add(options: set[str]) -> None:
        nonlocal run, exact
        joined = {a + b for a in run for b in options}
        if len(joined) > MAX_STRINGS:
            cut()
            joined = options
        run = joined

    def cut() -> None:
        nonlocal run, exact
        found.append(_of_strings(run))
        run, exact = {""}, False

    for kind, value in nodes:
        if kind is op.LITERAL and _fold(value):
            add({_fold(value)})
        elif kind is op.IN and len(value) <= 8 and all(k is op.LITERAL and _fold(v) for k, v in value):
            add({_fold(v) for _, v in value})
        elif kind is op.AT:
            continue
        elif kind is op.SUBPATTERN or kind is op.ATOMIC_GROUP:
            inner, query = _analyse(value[-1] if kind is op.SUBPATTERN else value)
            if inner is not None:
                add(inner)
            else:
                cut()
                found.append(query)
        elif kind is op.BRANCH:
            inner = [_analyse(x) for x in value[1]]
            if all(x is not None for x, _ in inner):
                add(set().union(*(x for x, _ in inner)))
            else:
                cut()
                found.append(_or([q for _, q in inner]))
        elif kind in (op.MAX_REPEAT, op.MIN_REPEAT, op.POSSESSIVE_REPEAT):
            least, most, body = value
            inner, query = _analyse(body)
            if inner is not None and least == 0 and most == 1:
                add(inner | {""})
            elif inner is not None and least == most and least <= 4:
                for _ in range(least):
                    add(inner)
            elif least and inner is not None:
                add(inner)
                cut()
                add(inner)
                exact = False
            else:
                cut()
                found.append(query if least else True)
        else:
            cut()
    if exact:
        return run, _of_strings(run)
    return None, _and([*found, _of_strings(run)])


def trigram_query(pattern: str, flags: int = 0) -> object:
    """The query that every text with a match satisfies; True if no trigram is mandatory."""
    return _analyse(sre.parse(pattern, flags))[1]


def _trigrams(query: object) -> set[str]:
    if query is True:
        return set()
    return {query[1]} if query[0] == "tri" else set().union(*(_trigrams(q) for q in query[1]))


class Scanner:
    """Compiled rules with their queries; made once for each Python worker."""

    def __init__(self, rules: tuple[Rule, ...] = RULES):
        self.rules = rules
        self.compiled = [re.compile(r.pattern, r.flags) for r in rules]
        self.queries = [trigram_query(r.pattern, r.flags) for r in rules]
        self.names = sorted(set().union(*(_trigrams(q) for q in self.queries)))
        self.place = {t: i for i, t in enumerate(self.names)}
        self.table = np.zeros(1 << 24, dtype=np.uint16)
        for t, i in self.place.items():
            a, b, c = t.encode("latin-1")
            self.table[a << 16 | b << 8 | c] = i + 1
        self.fold = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))

    def index(self, texts: list[bytes]) -> np.ndarray:
        """Postings of the named trigrams: a row for each trigram, a column for each text."""
        postings = np.zeros((len(self.names), len(texts)), dtype=bool)
        data = np.frombuffer(b"\0\0".join(texts).translate(self.fold), dtype=np.uint8)
        if len(data) > 2 and self.names:
            codes = data[:-2].astype(np.uint32) << 16
            codes |= data[1:-1].astype(np.uint32) << 8
            codes |= data[2:]
            hit = self.table[codes]
            at = np.flatnonzero(hit)
            ends = np.cumsum([len(t) + 2 for t in texts])
            postings[hit[at].astype(np.int64) - 1, np.searchsorted(ends, at, side="right")] = True
        return postings

    def _select(self, query: object, postings: np.ndarray) -> np.ndarray:
        if query is True:
            return np.ones(postings.shape[1], dtype=bool)
        if query[0] == "tri":
            return postings[self.place[query[1]]]
        parts = [self._select(q, postings) for q in query[1]]
        return (np.logical_and if query[0] == "and" else np.logical_or).reduce(parts)

    def block(self, texts: list[bytes]) -> list[list[tuple[int, int, int]]]:
        """For each text its spans (start, rule, end) in code points, by start and then rule."""
        postings = self.index(texts)
        chosen = [self._select(q, postings) for q in self.queries]
        found = []
        for k, raw in enumerate(texts):
            spans, text = [], None
            for n, (rule, pattern) in enumerate(zip(self.rules, self.compiled, strict=True)):
                if chosen[n][k]:
                    text = raw.decode("utf-8", "replace") if text is None else text
                    spans += [(m.start(), n, m.end()) for m in pattern.finditer(text) if m.end(rule.group) - m.start(rule.group) >= rule.least]
            found.append(sorted(spans))
        return found

    def scan(self, texts: list[bytes | None]) -> Iterator[list[tuple[int, int, int]]]:
        """Spans of each text in order, indexed in blocks of bounded size; null counts as empty."""
        block, held = [], 0
        for t in texts:
            block.append(t or b"")
            held += len(block[-1])
            if held >= BLOCK_BYTES:
                yield from self.block(block)
                block, held = [], 0
        yield from self.block(block) if block else ()

    def label(self, spans: list[tuple[int, int, int]], first: int | None = None) -> str:
        return ",".join(f"{self.rules[n].kind}:{a}:{b}" for a, n, b in spans if first is None or n < first)


def redacted(text: str, spans: list[tuple[int, int, int]], mark: str = REDACTED) -> str:
    """``text`` with every maximal run of overlapping spans replaced by ``mark``."""
    out, at = [], 0
    end = None
    for a, _, b in spans:
        if end is not None and a < end:
            end = max(end, b)
            continue
        if end is not None:
            at = end
        out += [text[at:a], mark]
        end = b
    return "".join(out) + text[end if end is not None else 0 :]


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``, repeated rows and null ids included: ``id_col, n_assign,
    n_access, n_hex, base_sha256, spans``. Null texts count as empty: no spans, the digest of the
    empty string. Texts of any length are scanned whole. Spans are ``kind:start:end`` in code points, end
    exclusive. Other columns are not read.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner()
        for batch in batches:
            rows = list(scanner.scan(batch.column(1).to_pylist()))
            counts = [pa.array([sum(n == k for _, n, _ in r) for r in rows], pa.int64()) for k in range(len(BASE))]
            digests = [hashlib.sha256(scanner.label(r, len(BASE)).encode()).hexdigest() for r in rows]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *counts, pa.array(digests, pa.string()), pa.array([scanner.label(r) for r in rows], pa.string())],
                names=["id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    out = slim.mapInArrow(run, f"id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
    return out.withColumnRenamed("id", id_col)


def redact(docs: DataFrame, text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """``docs`` with the same columns and rows, secrets in ``text_col`` replaced by ``[SECRET]`` and
    ``length_col``, if there, set to the new length. Null texts stay null; texts without secrets,
    and their lengths, stay as they are.
    """
    small_batches(docs.sparkSession)
    names = docs.columns
    at, size_at = names.index(text_col), names.index(length_col) if length_col in names else -1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner()
        for batch in batches:
            texts = batch.column(at).cast(pa.binary()).to_pylist()
            columns = list(batch.columns)
            changed = {
                k: redacted(t.decode("utf-8", "replace"), spans)
                for k, (t, spans) in enumerate(zip(texts, scanner.scan(texts), strict=True))
                if spans
            }
            if changed:
                columns[at] = pa.array([changed.get(k, t) for k, t in enumerate(columns[at].to_pylist())], columns[at].type)
                if size_at >= 0:
                    sizes = columns[size_at].to_pylist()
                    columns[size_at] = pa.array([len(changed[k]) if k in changed else n for k, n in enumerate(sizes)], columns[size_at].type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)
