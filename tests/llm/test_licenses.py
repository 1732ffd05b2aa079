"""License scans: planted templates, alignment, clean texts."""

import random

from cuewright.llm import licenses as L


def test_alignment_is_an_increasing_match():
    rng = random.Random(1)
    for _ in range(200):
        a = [rng.choice("abcdefghijklmnop").encode() for _ in range(rng.randint(0, 30))]
        b = [rng.choice("abcdefghijklmnop").encode() for _ in range(rng.randint(0, 30))]
        pairs = L.align(a, b)
        assert all(a[i] == b[j] for i, j in pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:], strict=False))
    same = [str(i).encode() for i in range(50)]
    assert len(L.align(same, same)) == 50
    assert L._longest_rising([3, 1, 2, 5, 4, 6]) in ([1, 2, 4, 5], [1, 2, 3, 5])


def test_planted_templates():
    rng = random.Random(2)
    noise = "lorem ipsum dolor the of and to in software license copy".split()
    matcher = L.Matcher()
    for name, template in L.TEMPLATES.items():
        own = template.split()
        for _ in range(len(own) // 20):
            own[rng.randrange(len(own))] = "changed"
        body = [rng.choice(noise) for _ in range(300)]
        found = matcher.scan(L.words(" ".join(body + own + body + own).encode()))
        assert [m.name for m in found] == [name] * 2 and all(m.coverage >= 0.8 for m in found)
    assert matcher.scan(L.words(" ".join(noise * 100).encode())) == []


def test_operator(spark):
    mit = L.TEMPLATES["MIT"]
    rows = [(1, f"é {mit} tail", "x", 1.0), (2, "Released under the MIT License.", "x", 1.0), (2, "Released under the MIT License.", "x", 1.0), (3, None, "x", 1.0), (None, "", "x", 1.0), (4, "clean " * 20_000, "x", 1.0)]
    got = L.scan(spark.createDataFrame(rows, "doc_id long, text string, license string, coverage double")).collect()
    by = {r["doc_id"]: r for r in got}
    assert len(got) == 6 and by[1]["license"] == "MIT" and by[1]["coverage"] == 1.0
    name, a, b = by[1]["matches"].split(":")
    assert rows[0][1].encode()[int(a) : int(b)].decode() == mit.rstrip(".")
    assert by[2]["license"] == "MIT-statement" and [by[k]["n_licenses"] for k in (3, None, 4)] == [0, 0, 0]
    assert L.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def best_of_all_starts(matcher, name, text):
    own = matcher.templates[name]
    width = int(matcher.stretch * len(own)) + 1
    return max(len(L.align(text[i : i + width], own)) for i in range(len(text))) / len(own)


def test_no_start_is_passed_over():
    rng = random.Random(6)
    matcher = L.Matcher()
    name = "GPL-3.0-notice"
    notice = L.TEMPLATES[name]
    changed = notice.replace("This program is free software:", "Foo is free software:")
    header = "This program reads a table and writes it " + " ".join(rng.choice("of the and to a with it for file".split()) for _ in range(64))
    texts = [changed, f"some words {changed} some words", notice + " " + changed]
    for n in (0, 20, 45, 64):
        texts += [" ".join(header.split()[: 8 + n]) + " " + notice, " ".join(header.split()[: 8 + n]) + " " + changed]
    own = notice.split()
    for _ in range(10):
        edited = [w if rng.random() > 0.1 else "edited" for w in own]
        texts.append(" ".join([*own[: rng.randrange(60)], *edited, *own[rng.randrange(60) :][:20]]))
    for t in texts:
        text = L.words(t.encode())
        best = best_of_all_starts(matcher, name, text)
        found = [m for m in matcher.scan(text) if m.name == name]
        assert best < matcher.coverage or max((m.coverage for m in found), default=0) == best, t
    found = matcher.scan(L.words(changed.encode()))
    assert [m.name for m in found] == [name] and found[0].coverage == 94 / 96


def test_a_statement_must_name_its_license():
    matcher = L.Matcher()
    names = lambda t: [m.name for m in matcher.scan(L.words(t.encode()))]
    for text in ["Released under the Apache License.", "Licensed under the BSD License.", "it was released under the license of the city", "Licensed under CC BY-XY 4.0.", "This work is licensed under the GNU General Public License, version 1."]:
        assert names(text) == [], text
    assert names("Licensed under CC BY-ND 4.0.") == ["CC-BY-ND-4.0-statement"]
    assert names("Released under the permissive MIT License.") == ["MIT-statement"]
    assert names("This work is licensed under the GNU Lesser General Public License, version 3.") == ["LGPL-3.0-statement"]


def test_relatives_are_told_apart():
    matcher = L.Matcher()
    for name, template in L.TEMPLATES.items():
        found = matcher.scan(L.words(template.encode()))
        assert [(m.name, m.coverage) for m in found] == [(name, 1.0)]
    bsd = L.TEMPLATES["BSD-3-Clause"]
    assert bsd.endswith("SUCH DAMAGE.") and len(bsd.split()) > 200
    assert matcher.scan(L.words(bsd[: len(bsd) // 2].encode())) == []


def test_stretched_and_altered_matches():
    """Whatever whole-text alignment finds in a text of one template among other words is found."""
    rng = random.Random(8)
    matcher = L.Matcher()
    noise = [f"foreign{k}".encode() for k in range(400)]
    for name, own in matcher.templates.items():
        if len(own) < L.SHORT:
            continue
        for share in (0.3, 0.6, 1.0, 2.0):
            spread = [x for w in own for x in (w, *rng.sample(noise, int(share) + (rng.random() < share % 1)))]
            text = [*rng.sample(noise, 80), *spread, *rng.sample(noise, 80)]
            assert len(L.align(text, own)) >= matcher.coverage * len(own)
            assert [m.name for m in matcher.scan(text)] == [name], (name, share)
        # The first two words are altered and stand once more in the middle.
        half = len(own) // 2
        altered = [b"another", b"start", *own[2:half], *own[:2], *own[half:]]
        found = matcher.scan([*rng.sample(noise, 80), *altered, *rng.sample(noise, 80)])
        assert [m.name for m in found] == [name] and found[0].coverage >= 0.8


def test_templates_of_a_folder(spark, tmp_path):
    full = " ".join(f"clause{k} of the terms" for k in range(300))
    (tmp_path / "Some-1.0").write_text(full)
    found = L.templates_in(spark, str(tmp_path))
    df = spark.createDataFrame([(1, f"before {full} after"), (2, "clause1 of the terms")], "doc_id long, text string")
    got = {r["doc_id"]: (r["license"], r["coverage"]) for r in L.scan(df, found).collect()}
    assert found == {"Some-1.0": full} and got == {1: ("Some-1.0", 1.0), 2: (None, 0.0)}
