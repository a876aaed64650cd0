"""Two versions of a document side by side: which elements stay, change, move, go and come.

A pair of versions is one row, and is aligned where it is. Children of elements that belong together are matched in
order, by a longest common subsequence of what identifies them.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import accumulate

from pyspark.sql import DataFrame

from bundlelens.operators.generate import generate
from bundlelens.operators.html import _Nodes

#: Bits of the table of a pair of lists; longer pairs are halved.
TABLE_BITS = 1 << 30
CHANGE = "before int, after int, depth int, tag string, change string"


def _rows(a: list, b: list) -> list[int]:
    """After each of a's elements a number whose bit j is unset where b's element j makes the common part longer."""
    full, where = (1 << len(b)) - 1, defaultdict(int)
    for j, x in enumerate(b):
        where[x] |= 1 << j
    v, rows = full, []
    for x in a:
        met = v & where.get(x, 0)
        v = ((v + met) | (v - met)) & full
        rows.append(v)
    return rows


def _lengths(a: list, b: list) -> list[int]:
    """The length that a has in common with each beginning of b, the empty one first."""
    v, full, where = (1 << len(b)) - 1, (1 << len(b)) - 1, defaultdict(int)
    for j, x in enumerate(b):
        where[x] |= 1 << j
    for x in a:
        met = v & where.get(x, 0)
        v = ((v + met) | (v - met)) & full
    return [0, *accumulate(int(bit == "0") for bit in reversed(format(v, f"0{len(b)}b")))] if b else [0]


def common(a: list, b: list) -> list[tuple[int, int]]:
    """Places of a longest common subsequence in both lists. Equal ends are matched first, then lists of words of bits, so
    long lists of equal elements cost little; of very long ones only halves are in memory."""
    head = 0
    while head < len(a) and head < len(b) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    ends = [(i, i) for i in range(head)], [(len(a) - tail + i, len(b) - tail + i) for i in range(tail)]
    both = set(a[head : len(a) - tail]) & set(b[head : len(b) - tail])  # what one list alone has can't be matched
    mine = [i for i in range(head, len(a) - tail) if a[i] in both]
    theirs = [j for j in range(head, len(b) - tail) if b[j] in both]
    x, y = [a[i] for i in mine], [b[j] for j in theirs]
    return [*ends[0], *((mine[i], theirs[j]) for i, j in _middle(x, y)), *ends[1]]


def _middle(a: list, b: list) -> list[tuple[int, int]]:
    if not a or not b:
        return []
    if len(a) * len(b) > TABLE_BITS and len(a) > 1:
        half = len(a) // 2
        front, back = _lengths(a[:half], b), _lengths(a[:half - 1 : -1], b[::-1])
        cut = max(range(len(b) + 1), key=lambda j: front[j] + back[len(b) - j])
        return [*_middle(a[:half], b[:cut]), *((i + half, j + cut) for i, j in _middle(a[half:], b[cut:]))]
    rows, i, j, found = _rows(a, b), len(a), len(b), []
    while i and j:
        bit = 1 << (j - 1)
        if rows[i - 1] & bit:
            j -= 1
            continue
        i -= 1
        if not i or rows[i - 1] & bit:
            j -= 1
            found.append((i, j))
    return found[::-1]


def _read(html: str | None) -> tuple[list[tuple], list[list[int]], list[int]]:
    """(tag, identity, all that is its own) of each element, the children of each, the document's last, and depths."""
    nodes = _Nodes()
    nodes.feed(html or "")
    nodes.close()
    rows, children, depth = [], [[] for _ in range(len(nodes.rows) + 1)], []
    for node, parent, tag, attrs, text in nodes.rows:
        identity = (tag, attrs.get("id"), tuple(sorted(set(attrs.get("class", "").split()))))
        rows.append((tag, identity, (tag, tuple(sorted(attrs.items())), " ".join("".join(text).split()))))
        children[-1 if parent is None else parent].append(node)
        depth.append(0 if parent is None else depth[parent] + 1)
    return rows, children, depth


def compare(before: str | None, after: str | None) -> list[tuple]:
    """Rows of `changes` for one pair."""
    (a, inside_a, depth_a), (b, inside_b, depth_b) = _read(before), _read(after)
    whole: dict[tuple, int] = {}  # equal subtrees have one number in both documents

    def subtrees(rows: list, inside: list) -> list[int]:
        of = [0] * len(rows)
        for node in range(len(rows) - 1, -1, -1):
            of[node] = whole.setdefault((rows[node][2], tuple(of[c] for c in inside[node])), len(whole))
        return of

    whole_a, whole_b = subtrees(a, inside_a), subtrees(b, inside_b)
    found, pairs, met_a, met_b = [], [(-1, -1)], set(), set()
    while pairs:
        x, y = pairs.pop()
        mine, theirs = inside_a[x], inside_b[y]
        stay = [(mine[i], theirs[j]) for i, j in common([a[n][1] for n in mine], [b[n][1] for n in theirs])]
        kept_a, kept_b = {n for n, _ in stay}, {n for _, n in stay}
        left = defaultdict(list)
        for n in theirs:
            if n not in kept_b:
                left[whole_b[n]].append(n)
        moved = []
        for n in mine:
            if n not in kept_a and left.get(whole_a[n]):
                moved.append((n, left[whole_a[n]].pop(0)))
        found += [(n, m, depth_a[n], a[n][0], "same" if a[n][2] == b[m][2] else "changed") for n, m in stay]
        found += [(n, m, depth_a[n], a[n][0], "moved") for n, m in moved]
        met_a.update(n for n, _ in stay + moved)
        met_b.update(m for _, m in stay + moved)
        pairs += stay + moved
    gone = [(n, None, depth_a[n], a[n][0], "gone") for n in range(len(a)) if n not in met_a]
    return found + gone + [(None, m, depth_b[m], b[m][0], "new") for m in range(len(b)) if m not in met_b]


def changes(pairs: DataFrame, keep: list[str], before: str = "before", after: str = "after") -> DataFrame:
    """One row per element of either version: the kept columns, its number in each (null where it isn't), depth, tag and
    change: `same` or `changed` (its own attributes or text) where it is matched in order under parents that belong
    together, by tag, id and classes; `moved` where an equal subtree stands elsewhere among the same parent's children;
    `gone` and `new` otherwise, with all that is inside. Inside what moved, elements are the same. A null version is an
    empty document."""
    return generate(pairs, keep, [before, after], compare, CHANGE)
