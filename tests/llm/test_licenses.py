import random
import time

import pytest

from bundlelens.llm import licenses


def brute(text, templates=licenses.TEMPLATES, threshold=licenses.THRESHOLD):
    """Every run of lines against every template."""
    lines = (text or "").split("\n")
    best = {}
    for i in range(len(lines)):
        for j in range(i, len(lines)):
            if not (licenses.normalised(lines[i]) and licenses.normalised(lines[j])):
                continue
            a = licenses.bigrams(licenses.normalised("\n".join(lines[i : j + 1])))
            for name, template in templates:
                b = licenses.bigrams(licenses.normalised(template))
                value = 2 * len(a & b) / (len(a) + len(b))
                if value >= threshold - 1e-12:
                    best[name] = min(best.get(name, (0,)), (-value, i + 1, j + 1))
    return [(n, round(-k[0], 6), k[1], k[2]) for n, k in sorted(best.items())]


def texts():
    rng = random.Random(1)
    plain = "the software of any kind is licensed under public terms and the copyright notice shall be free".split()
    for name, template in licenses.TEMPLATES:
        words = template.split(" ")
        for noise in (0, 0.02, 0.1, 0.3):
            own = [w if rng.random() > noise else rng.choice(plain) for w in words]
            broken = "".join(w + rng.choice([" ", " ", " ", " ", "\n", "\n\n"]) for w in own)
            yield "\n".join([" ".join(rng.choice(plain) for _ in range(rng.randint(0, 12))) for _ in range(rng.randint(0, 3))] + [broken.upper() if noise else broken, "tail of it"])
    yield "\n".join(t for _, t in licenses.TEMPLATES[1:3])


def test_agrees_with_all_pairs():
    scanner = licenses.Scanner()
    found = [scanner.scan(t) for t in texts()]
    assert found == [brute(t) for t in texts()]
    assert sum(map(bool, found)) > 60


def strongest(text, templates):
    """Of all runs of lines the best ones that share none."""
    lines, found = text.split("\n"), []
    for i in range(len(lines)):
        for j in range(i, len(lines)):
            if licenses.normalised(lines[i]) and licenses.normalised(lines[j]):
                a = licenses.bigrams(licenses.normalised("\n".join(lines[i : j + 1])))
                for name, template in templates:
                    b = licenses.bigrams(licenses.normalised(template))
                    if 2 * len(a & b) >= licenses.THRESHOLD * (len(a) + len(b)) - 1e-12:
                        found.append((-2 * len(a & b) / (len(a) + len(b)), -len(a & b), i + 1, j + 1, name))
    taken, kept = set(), []
    for value, _, first, last, name in sorted(found):
        if taken.isdisjoint(range(first, last + 1)):
            taken.update(range(first, last + 1))
            kept.append((name, round(-value, 6), first, last))
    return sorted(kept, key=lambda x: x[2])


@pytest.mark.parametrize("seed", range(6))
def test_repeated_and_blank_lines(seed):
    """Few lines again and again, so that runs add nothing, or little, or what an earlier one had."""
    rng = random.Random(seed)
    own = [licenses.TEMPLATES[i] for i in rng.sample(range(len(licenses.TEMPLATES)), 8)]
    words = " ".join(t for _, t in own).split()
    pieces = ["", " ", "a a", "a a a", "MIT License", "The MIT License (MIT)", *[" ".join(words[i : i + rng.randint(1, 9)]) for i in rng.sample(range(len(words)), 6)], *[t for _, t in own[:3]]]
    text = "\n".join(rng.choices(pieces, k=40))
    scanner = licenses.Scanner()
    assert scanner.scan(text) == brute(text) and scanner.strongest(text) == strongest(text, licenses.TEMPLATES)


@pytest.mark.parametrize("lines", [["MIT License"], ["a a"], ["", "a b", "b a", "a a", "b b"], ["GNU General Public License", "as published by the Free", "Software Foundation"]])
def test_long_texts_take_linear_time(lines):
    def seconds(n):
        text = "MIT License\n" + "\n".join(lines[i % len(lines)] for i in range(n))
        begun = time.process_time()
        found = licenses.Scanner().strongest(text)
        return time.process_time() - begun, len(found)

    (short, few), (long, many) = seconds(10_000), seconds(100_000)
    assert long < 20 * short + 0.5 and long < 12 and (many > 9 * few if lines == ["MIT License"] else many < 200_000)


@pytest.mark.parametrize("threshold", [0.5, 1.0])
def test_other_thresholds(threshold):
    own = licenses.TEMPLATES[20:26]
    scanner = licenses.Scanner(own, threshold)
    for text in ["Licensed under CC BY NC 4.0", "licensed under cc by nc sa 4 0", "x\nLicensed under\nCC BY 4.0.\ny", "under CC"]:
        assert scanner.scan(text) == brute(text, own, threshold)


def test_query(spark, tmp_path):
    rows = [(1, "a b\nReleased under the MIT License.\nc"), (1, "Released under the MIT License."), (None, "LICENSED under\nthe MIT license"), (2, None), (3, ""), (4, "word " * 50_000), (5, "é licence")]
    spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, license string").write.parquet(f"{tmp_path}/documents.parquet")
    want = sorted(((i, *x) for i, t in rows if t is None or len(t) < 1000 for x in brute(t)), key=str)
    assert sorted(map(tuple, licenses.op2_licenses(spark, str(tmp_path)).collect()), key=str) == want
    assert len(want) == 3
    assert licenses.scan_licenses(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_the_strongest_of_overlapping_runs():
    """A notice goes by the version that it names, and a weaker licence elsewhere isn't lost to it."""
    scanner = licenses.Scanner()
    assert [x[0] for x in scanner.strongest(licenses._GPL_2)] == ["GPL-2.0"]
    assert [x[0] for x in scanner.strongest(licenses._GPL)] == ["GPL-3.0"]
    noisy = licenses._GPL.replace("useful", "of much use").replace("program is", "work of ours is")
    both = scanner.strongest(f"{licenses._GPL_2}\n\nplain words between them\n{noisy}")
    assert [(x[0], x[2], x[3]) for x in both] == [("GPL-2.0", 1, 3), ("GPL-3.0", 6, 8)] and both[1][1] < 1
    for line, name in [("MIT License", "MIT"), ("// SPDX-License-Identifier: GPL-2.0-or-later", "GPL-2.0"), ("# SPDX-License-Identifier: Apache-2.0", "Apache-2.0"), ("Licensed under the Apache License 2.0", "Apache-2.0"), ("Licensed under CC BY-NC-SA 4.0.", "CC-BY-NC-SA-4.0")]:
        assert [x[0] for x in scanner.strongest(f"some text\n{line}\nmore of it")] == [name], line


@pytest.mark.parametrize("name", sorted({n for n, _ in licenses.TEMPLATES}))
def test_every_template_is_its_own(name):
    scanner = licenses.Scanner()
    for own, text in licenses.TEMPLATES:
        if own == name:
            assert scanner.strongest(f"a title here\n\n{text}\n\nother words follow")[0][:2] == (name, 1.0)
