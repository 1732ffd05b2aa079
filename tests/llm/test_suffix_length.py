"""The contract's length is 400 bytes, however many words or code points they are."""

import random
from hashlib import sha256

from cuewright.llm import queries as Q


def passage(seed, sevens):
    rng = random.Random(seed)
    return " ".join("".join(rng.choices("abcdefgh", k=7 if i < sevens else 6)) for i in range(51))


def test_shared_passages_of_51_words(spark, tmp_path):
    short, whole = passage(1, 43), passage(2, 44)
    accented = "é" + passage(3, 43)[1:]
    assert [len(p.encode()) for p in (short, whole, accented)] == [399, 400, 400] and len(accented) == 399
    rows = [(10 * k + i, f"{i}{p}{i}") for k, p in enumerate((short, whole, accented)) for i in (1, 2)]
    rows += [(31, f"one {short}, {whole[1:]}."), (32, None)]  # a second place with 399 bytes of each
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"], r["kept"]) for r in Q.op8_suffixes(spark, str(tmp_path)).collect()}
    want = {}
    for i, text in rows:
        text = text or ""
        kept = text.replace(whole, "").replace(accented, "")
        gone = len(text.encode()) - len(kept.encode())
        want[i] = (len(text.encode()), gone, gone // 400, sha256(kept.encode()).hexdigest(), kept)
    assert got == want and [want[i][1] for i in (1, 2, 11, 12, 21, 22, 31)] == [0, 0, 400, 400, 400, 400, 0]
