"""Every operator and stage on what tables may hold: very long and empty texts, nulls in every column, repeated
rows, columns with the names that the operators use themselves, no rows."""

import hashlib
import random

import pytest

import corpus_pipeline as P
import public_tokenizers
from cuewright.llm import bpe, fim, licenses, line_dedup, mixing, quality, secrets, sharding, simhash, suffixes, syncmers

NAMES = "id spans size node ka kb fp ref total lang_ text_ key digest more run matches shard tier target taken kept rank"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in NAMES.split())
EXTRA = ("z",) * len(NAMES.split())


def rows():
    rng = random.Random(7)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(3000)]
    long_ = " ".join(rng.choice(words) for _ in range(220_000))  # over a million characters: more than one piece of the suffix search
    few = " ".join(words[:90])
    out = [(1, long_, "en", "a"), (2, long_[:700_000] + " é other end", "en", "b"), (3, "", "en", "a"), (4, None, None, None), (None, few, "en", "a"), (None, few, "en", "a"), (5, few + " more", None, "b"), (5, few + " more", None, "b")]
    return [(i, t, g, s, None if t is None else len(t), *EXTRA) for i, t, g, s in out] + [(None,) * (5 + len(EXTRA))]


OPERATORS = {
    "syncmers": syncmers.edited_fingerprints,
    "bpe": lambda d: bpe.digest(d, bpe.load_ranks(d.sparkSession, public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), public_tokenizers.PATTERN),
    "simhash": simhash.near_duplicates,
    "quality": quality.assess,
    "licenses": licenses.scan,
    "mixing": mixing.mix_sizes,
    "suffixes": suffixes.dedup,
    "sharding": sharding.shard_documents,
    "secrets": secrets.scan,
    "lines": line_dedup.dedup,
    "fim": fim.transform,
}


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3).cache()


@pytest.mark.parametrize("name", list(OPERATORS))
def test_operator(spark, edges, name):
    got = OPERATORS[name](edges).collect()
    assert sorted((str(r["doc_id"]) for r in got)) == sorted(str(r[0]) for r in rows())
    assert OPERATORS[name](spark.createDataFrame([], SCHEMA)).count() == 0
    by = {r["doc_id"]: r for r in got}
    if name == "suffixes":
        text = rows()[0][1].encode()
        # All but the end that differs stands in both; the two agree for as long as the first 700,000 bytes do, and the next by chance.
        assert by[1]["n_bytes"] == len(text) and 700_000 <= by[1]["n_removed"] < 700_020 and by[1]["kept"] == text[by[1]["n_removed"] :]
        assert by[2]["n_spans"] == 1 and by[4]["kept_sha256"] == hashlib.sha256(b"").hexdigest()
    if name == "lines":  # of the rows that hold the same line, those without an id come first
        few = rows()[4][1]
        assert by[5]["kept"] == few + " more" and by[1]["kept"] == rows()[0][1] and by[3]["n_lines"] == by[4]["n_lines"] == 1
    if name == "fim":
        assert by[1]["n"] == 1 and by[3]["form"] == by[4]["form"] == "plain" and len(by[2]["output"]) == len(rows()[1][1]) + 9
    if name == "quality":
        assert by[1]["n_words"] == 220_000 and by[3]["base_failed"] and by[4]["base_failed"]
    if name == "mixing":
        assert by[1]["size"] == 220_000 and by[1]["taken"] <= 440_000
    if name == "simhash":
        assert by[3]["component_id"] == by[4]["component_id"] == 3 and by[3]["fingerprint"] == "0" * 16


def test_pipeline_stages(spark, edges):
    kept = edges
    for k, (name, stage) in enumerate(P.STAGES):
        assert stage(spark, spark.createDataFrame([], SCHEMA), "").count() == 0, name
        before, kept = kept, stage(spark, kept, "").cache()
        if k + 1 < len(P.STAGES):
            assert kept.columns == before.columns and kept.dtypes == before.dtypes
        if k == 1:  # of the three texts that begin alike, two the same and one a near copy, one is left
            assert kept.where(kept.text.startswith(rows()[4][1])).count() == 1
    assert kept.count() > 0
