"""Fill-in-middle: against units kept in a list, round trips, edges."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from cuewright.llm import fim

SCHEMA = "doc_id long, text string, n long, form string, output string, key string"


def brute(doc_id, text, s):
    text = text or ""
    units = re.findall(s.unit, text)
    h = [int(hashlib.sha256(f"{s.seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, q = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= s.rate:
        return (doc_id, len(units), "plain", None, None, text)
    if h[3] % 100 < s.spm_rate:
        return (doc_id, len(units), "spm", len(p), len(m), f"<S>{q}<P>{p}<M>{m}")
    return (doc_id, len(units), "psm", len(p), len(m), f"<P>{p}<S>{q}<M>{m}")


def rows():
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab é😀\n\n\r<PSM>") for _ in range(rng.randint(0, 80))) for _ in range(300)]
    texts += ["", None, "\n", "\n\n\n", "one", "x<P>y\nz", "a<\nS>\n<M", "<S", "é b\x0bc\n", "line\n" * 200_000, "z" * 1_000_000]
    out = [(i, t) for i, t in enumerate(texts)] + [(None, "a\nb\nc"), (None, None), (-5, "m\nn"), (4, "again\n"), (4, "again\n"), (2**62 + 1, "big\nid\n")]
    return out


@pytest.mark.parametrize("rate", [100, 40, 0])
def test_against_lists(spark, rate):
    s = fim.Settings(rate=rate)
    docs = spark.createDataFrame([(i, t, 9, "z", "z", "z") for i, t in rows()], SCHEMA).repartition(3)
    made = fim.transform(docs, s)
    got = [tuple(r) for r in made.withColumn("back", fim.restore(F.col("form"), F.col("output"), s)).collect()]
    want = [brute(i, t, s) for i, t in rows()]
    order = lambda r: tuple((x is not None, x) for x in r)
    assert sorted((g[:6] for g in got), key=order) == sorted(want, key=order)
    assert sorted(g[6] for g in got) == sorted(t or "" for _, t in rows())
    assert {w[2] for w in want} == ({"plain", "psm", "spm"} if rate else {"plain"})


def test_words_as_units(spark):
    s = fim.Settings(unit=r"\w+")  # separators belong to the part in which they lie
    docs = spark.createDataFrame([(i, " one, two  three. ") for i in range(40)], "doc_id long, text string")
    got = fim.transform(docs, s).withColumn("back", fim.restore(F.col("form"), F.col("output"), s)).collect()
    assert {r["back"] for r in got} == {" one, two  three. "} and {r["n"] for r in got} == {3} and len({r["prefix_chars"] for r in got}) > 2


def test_no_rows_and_marks(spark):
    assert fim.digest(spark.createDataFrame([], SCHEMA)).count() == 0
    for marks in (("", "b", "c"), ("a", "a", "c"), ("<a>", "x<a>", "c"), ("ab", "ba", "c"), ("aba", "x", "c")):
        with pytest.raises(ValueError, match="marks"):
            fim.Settings(prefix=marks[0], suffix=marks[1], middle=marks[2])


def test_nothing_is_kept_while_matching():
    import tracemalloc

    text = "ab\n" * 400_000
    tracemalloc.start()
    n, begin, end = fim.cuts(text, re.compile(fim.LINES), 399_999, 1_000_003)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    low, high = sorted((399_999 % 400_001, 1_000_003 % 400_001))
    assert (n, begin, end) == (400_000, 3 * low, 3 * high) and peak < 100_000
