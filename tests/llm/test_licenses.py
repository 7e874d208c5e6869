import itertools
import random

from pyspark.sql import functions as F

from readloom.llm import licenses, queries


def plain_increasing(v):
    return max((len(c) for n in range(len(v) + 1) for c in itertools.combinations(v, n) if list(c) == sorted(c)), default=0)


def test_increasing():
    rng = random.Random(1)
    for _ in range(100):
        v = rng.sample(range(30), rng.randint(0, 9))
        k = licenses.increasing(v)
        assert [v[i] for i in k] == sorted(v[i] for i in k) and k == sorted(k) and len(k) == plain_increasing(v)


def test_align():
    rng = random.Random(2)
    for _ in range(200):
        a, b = ([rng.choice("abcdefgh") for _ in range(rng.randint(0, 12))] for _ in "ab")
        m = licenses.align(a, b)
        assert all(a[i] == b[j] for i, j in m) and all(x[0] < y[0] and x[1] < y[1] for x, y in itertools.pairwise(m))
    assert len(licenses.align(list("xaybz"), list("xqaybz"))) == 5


def plain_coverage(at, size):
    return max((q - p + 1) / max(size, at[q] - at[p] + 1) for p in range(len(at)) for q in range(p, len(at)))


def test_best_run():
    rng = random.Random(4)
    for _ in range(200):
        at, size = sorted(rng.sample(range(40), rng.randint(1, 12))), rng.randint(1, 20)
        p, q, share = licenses.best_run(at, size)
        assert share == plain_coverage(at, size) == (q - p + 1) / max(size, at[q] - at[p] + 1)


def test_stray_words_after_a_notice():
    words = licenses.TEMPLATES["MIT"][1].split()
    cut = " ".join(words[: int(0.87 * len(words))])
    text = f"start {cut} {'blank ' * 28}Software {'blank ' * 60}"
    assert [m[0] for m in licenses.Scanner().scan(text)] == ["MIT"]


def plain_scan(scanner, text):
    """Every stretch aligned, without the bounds; whether any reaches the coverage."""
    found = licenses.words(text)
    names = set()
    ids = [scanner.vocabulary.get(w, -1) for w in found]
    for name, t in scanner.templates:
        k = int(licenses.STRETCH * len(t)) + 1
        for s in range(len(ids)):
            if ids[s] in t and (m := licenses.align(t, ids[s : s + k])) and plain_coverage([j for _, j in m], len(t)) >= scanner.coverage:
                names.add(name)
    return names


def test_scan_loses_no_match():
    rng = random.Random(3)
    s = licenses.Scanner({k: v[:1] for k, v in licenses.TEMPLATES.items()})
    texts = [v[0] for v in licenses.TEMPLATES.values()]
    for _ in range(40):
        w = ("the of a license under " * 6).split() + rng.choice(texts).split()
        if rng.random() < 0.5:
            w.insert(rng.randrange(len(w)), "zzz")
        text = " ".join(w * rng.randint(1, 2))
        got = s.scan(text)
        assert {m[0] for m in got} <= plain_scan(s, text) and bool(got) == bool(plain_scan(s, text))


def test_stray_words_around_every_notice():
    """All templates together: whatever common words stand before and after a notice, it is found whole and by its own name."""
    rng = random.Random(6)
    scan = licenses.Scanner().scan
    stray = "the this of a license under and to in is work licensed released permission copyright software public version".split()
    for name, texts in licenses.TEMPLATES.items():
        for text in texts:
            n = len(licenses.words(text))
            for _ in range(12):
                before, after = (" ".join(rng.choice([*stray, "zzz"]) for _ in range(rng.randint(0, 9))) for _ in "ab")
                k = len(licenses.words(before))
                got = scan(f"qqq {before} xyz {text} xyz {after}")
                assert (name, k + 2, k + 2 + n, 1.0) in got, (name, before, got)
                near = scan(f"qqq {before} {text} xyz")  # a stray word can belong to a longer notice, not spoil this one
                assert any(m[0] == name and m[3] == 1.0 for m in near), (name, before, near)


def test_all_templates_against_every_window():
    """Of every stretch and template, aligned without bounds: what is found is a best match there, and nothing is missed."""
    rng = random.Random(13)
    s = licenses.Scanner()
    short = [t for ts in licenses.TEMPLATES.values() for t in ts if len(t.split()) < 20]
    for _ in range(25):
        w = []
        for _ in range(rng.randint(0, 3)):
            notice = rng.choice(short).split()
            if rng.random() < 0.4:
                notice.insert(rng.randrange(len(notice)), "zzz")
            w += [rng.choice("the of a license under this work gap".split()) for _ in range(rng.randint(0, 6))] + notice
        text = " ".join(w)
        got = s.scan(text)
        ids = [s.vocabulary.get(x, -1) for x in licenses.words(text)]
        spans = []
        for (name, t), named, variants in zip(s.templates, s.names, s.variants, strict=True):
            for b in range(len(ids)):
                m = licenses.align(t, ids[b : b + int(licenses.STRETCH * len(t)) + 1])
                run = s.agreeing(t, m, named) if m else None
                if run and run[2] >= s.coverage and not variants & set(ids[b + m[run[0]][1] : b + m[run[1]][1] + 1]):
                    spans.append((name, b + m[run[0]][1], b + m[run[1]][1] + 1, run[2]))
        assert {m[0] for m in got} <= {x[0] for x in spans}
        for x in spans:  # each is found, or overlaps what is found with a coverage no lower, or named more exactly
            assert any(m[1] < x[2] and x[1] < m[2] and (m[3] >= x[3] or x[0] in licenses.FAMILIES) for m in got), (text, x, got)


def test_notices_and_edge_rows(spark):
    rows = [(1, "x y\nLicensed under CC BY-NC 4.0.\nz"), (2, "This work is licensed under the GNU General Public License, version 3."), (3, None), (4, ""), (None, "Released under the MIT License. " * 3), (5, "licensed " * 50_000)]
    got = {r.doc_id: r for r in licenses.license_scan(spark.createDataFrame(rows, "doc_id long, text string").withColumn("coverage", F.lit(1))).collect()}
    assert (got[1].licenses, got[1].first_word, got[1].last_word, got[1].coverage) == ("CC-BY-NC-4.0", 2, 9, 1.0)
    assert got[2].best_license == "GPL-3.0" and got[2].n_matches == 1 and got[None].n_matches == 3
    assert [got[i].n_matches for i in (3, 4, 5)] == [0, 0, 0] and got[3].best_license is None
    assert licenses.license_scan(spark.createDataFrame(rows, "doc_id long, text string").limit(0)).count() == 0


def test_names_and_versions_must_agree():
    scan = licenses.Scanner().scan
    gpl = licenses.TEMPLATES["GPL-3.0"][1]
    bsd2, bsd3 = licenses.TEMPLATES["BSD-2-Clause"][0], licenses.TEMPLATES["BSD-3-Clause"][0]
    for text, want in [
        ("Released under the MIT License.", ["MIT"]), ("Released under the BSD License.", ["BSD"]), ("Released under the GPL License.", []),
        ("Released under the Apache License.", []), ("Released under the new License.", []), ("Licensed under the Apache License, Version 1.1.", []),
        ("Licensed under CC BY-SA 4.0.", ["CC-BY-SA-4.0"]), ("Licensed under CC BY-NC 4.0.", ["CC-BY-NC-4.0"]), ("Licensed under CC BY 4.0.", ["CC-BY-4.0"]),
        ("Licensed under CC BY-NC-ND 3.0.", ["CC-BY-NC-ND-3.0"]), ("Licensed under CC BY-SA 2.5.", []), ("Licensed under CC BY-XX 4.0.", ["CC-BY-4.0"]),
        ("This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.", ["CC-BY-NC-SA-4.0"]),
        ("This work is licensed under the GNU Lesser General Public License, version 3.", ["LGPL-3.0"]),
        ("This work is licensed under the GNU Lesser General Public License, version 9.", []),
        (gpl, ["GPL-3.0"]), (gpl.replace("version 3", "version 2"), ["GPL-2.0"]), (gpl.replace("General", "Affero General"), ["AGPL-3.0"]),
        (gpl.replace("General", "Lesser General"), ["LGPL-3.0"]),
        (bsd2, ["BSD-2-Clause"]), (bsd3, ["BSD-3-Clause"]), (bsd3.replace("the copyright holder nor", "Foo Bar Inc. nor"), ["BSD-3-Clause"]),
        (bsd2.split(":")[0], ["BSD"]), ("To the extent possible under law, Foo Bar has waived all copyright and related or neighboring rights to this work under CC0 1.0.", ["CC0-1.0"]),
    ]:
        assert [m[0] for m in scan(f"some words. {text} other words")] == want, text
    for name, texts in licenses.TEMPLATES.items():
        assert all([m[0] for m in scan(t)] == [name] for t in texts), name


def test_query(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = {r.doc_id: r for r in queries.op1_license_scan(spark, sf_dir).collect()}
    assert sorted(got) == sorted(docs)
    lines = {"Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0", "Released under the MIT License.": "MIT", "version 3.": "GPL-3.0", "Apache License, Version 2.0.": "Apache-2.0"}
    for i, t in docs.items():
        for line, name in lines.items():
            if line in t:
                assert name in got[i].licenses.split(",")
        if "icense" not in t:
            assert got[i].n_matches == 0
