import random

import pytest

from bundlelens.operators import alignment


def length(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = row
        row = [0]
        for j, y in enumerate(b):
            row.append(max(row[j], before[j + 1], before[j] + (x == y)))
    return row[-1]


@pytest.mark.parametrize("bits", [alignment.TABLE_BITS, 40, 1])
def test_common_is_longest(monkeypatch, bits):
    monkeypatch.setattr(alignment, "TABLE_BITS", bits)
    rng = random.Random(bits)
    for _ in range(400):
        a, b = ([rng.randrange(rng.choice([1, 3, 9])) for _ in range(rng.randint(0, 14))] for _ in "ab")
        found = alignment.common(a, b)
        assert len(found) == length(a, b) and all(a[i] == b[j] for i, j in found)
        assert all(x < u and y < v for (x, y), (u, v) in zip(found, found[1:], strict=False))


def test_long_lists():
    a = [i % 7 for i in range(20_000)]
    assert len(alignment.common(["x", *a, "y"], ["z", *a, "q"])) == 20_000
    assert len(alignment.common(["x", *["li"] * 20_000], [*["li"] * 15_000, "z"])) == 15_000


def test_kinds(spark):
    before = "<div id=a>one</div><ul><li>1<li></ul><p>go<b>x</b></p><i>m</i><s class='u v'>t</s>"
    after = "<i>m</i><div id=a>two</div><em>new</em><ul><li>1<li></ul><s class='v u w'>t</s><s class='v  u'>t</s>"
    rows = [(1, before, after, "k"), (2, before, before, "k"), (3, None, "<p>", "k"), (4, "<p>", None, "k"), (5, None, "", "k")]
    found = {}
    for r in alignment.changes(spark.createDataFrame(rows, "page_id int, before string, after string, tag_ string"), ["page_id"]).collect():
        found.setdefault(r.page_id, []).append((r.tag, r.change))
    assert sorted(found[1]) == sorted([("div", "changed"), ("ul", "same"), ("li", "same"), ("li", "same"), ("p", "gone"), ("b", "gone"), ("i", "moved"), ("s", "changed"), ("em", "new"), ("s", "new")])
    assert {c for _, c in found[2]} == {"same"} and len(found[2]) == 8
    assert found[3] == [("p", "new")] and found[4] == [("p", "gone")] and 5 not in found


def test_every_element_once():
    rng = random.Random(5)

    def tree(depth):
        return "".join(f"<{t} class={rng.choice('ab')}>{rng.choice('xyz')}{tree(depth - 1)}</{t}>" for t in (rng.choice(["p", "i", "b"]) for _ in range(rng.randint(0, 4)))) if depth else ""

    for _ in range(60):
        a, b = tree(4), tree(4)
        found = alignment.compare(a, b)
        assert sorted(r[0] for r in found if r[0] is not None) == list(range(a.count("</")))
        assert sorted(r[1] for r in found if r[1] is not None) == list(range(b.count("</")))
        assert all((r[4] == "gone") == (r[1] is None) and (r[4] == "new") == (r[0] is None) for r in found)
        assert {r[4] for r in alignment.compare(a, a)} <= {"same"}
