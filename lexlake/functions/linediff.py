"""Differences of two texts by lines: a longest common subsequence in linear space, by rows of bits."""

from __future__ import annotations

from collections.abc import Sequence

#: Bits of a stretch whose rows are all kept to trace it back; larger ones are split at their middle row.
TRACED_BITS = 1 << 25


def rows_of(a: Sequence[int], b: Sequence[int], keep: bool) -> list[int]:
    """Rows of the table of common subsequences' lengths over prefixes of a, all or the last: bit j is 0 where the length grows with b[j]."""
    where: dict[int, int] = {}
    for j, x in enumerate(b):
        where[x] = where.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1
    row, rows = full, []
    for x in a:
        if found := where.get(x):
            own = row & found
            row = (row + own | row - own) & full
        if keep:
            rows.append(row)
    return rows if keep else [row]


def lengths_of(row: int, width: int):
    """Lengths over all prefixes of b, the empty one first."""
    import numpy as np

    bits = np.unpackbits(np.frombuffer(row.to_bytes(width // 8 + 1, "little"), np.uint8), bitorder="little")[:width]
    return np.append(0, np.cumsum(1 - bits.astype(np.int64)))


def traced(a: Sequence[int], b: Sequence[int], at: int, to: int) -> list[tuple[int, int]]:
    rows, i, j, out = rows_of(a, b, True), len(a), len(b), []
    while i and j:
        if a[i - 1] == b[j - 1]:
            i, j = i - 1, j - 1
            out.append((at + i, to + j))
        elif rows[i - 1] >> (j - 1) & 1:
            j -= 1
        else:
            i -= 1
    return out[::-1]


def common(a: Sequence[int], b: Sequence[int]) -> list[tuple[int, int]]:
    """Places (in a, in b) of a longest common subsequence. Time is len(a) * len(b) bits of whole-word work, space linear."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        i, k, j, m = todo.pop()
        while i < k and j < m and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        tail = []
        while i < k and j < m and a[k - 1] == b[m - 1]:
            k, m = k - 1, m - 1
            tail.append((k, m))
        out += tail
        if i == k or j == m:
            continue
        if (k - i) * (m - j) <= TRACED_BITS or k - i == 1:
            out += traced(a[i:k], b[j:m], i, j)
            continue
        middle = (i + k) // 2
        left = lengths_of(rows_of(a[i:middle], b[j:m], False)[0], m - j)
        right = lengths_of(rows_of(a[middle:k][::-1], b[j:m][::-1], False)[0], m - j)[::-1]
        cut = j + int((left + right).argmax())
        todo += [(i, middle, j, cut), (middle, k, cut, m)]
    return sorted(out)


def opcodes(old: Sequence[str], new: Sequence[str]) -> list[tuple[str, int, int, int, int]]:
    """(op, i1, i2, j1, j2): equal, replace, delete or insert, in order and without gaps."""
    number: dict[str, int] = {}
    a, b = ([number.setdefault(x, len(number)) for x in side] for side in (old, new))
    out, i, j = [], 0, 0
    for p, q in [*common(a, b), (len(a), len(b))]:
        if p > i or q > j:
            out.append(("replace" if p > i and q > j else "delete" if p > i else "insert", i, p, j, q))
        if p < len(a):
            if out and out[-1][0] == "equal" and out[-1][2] == p:
                out[-1] = ("equal", out[-1][1], p + 1, out[-1][3], q + 1)
            else:
                out.append(("equal", p, p + 1, q, q + 1))
        i, j = p + 1, q + 1
    return out


def hunks(found: list[tuple[str, int, int, int, int]], context: int) -> list[list[tuple[str, int, int, int, int]]]:
    """The opcodes in groups with so many lines of context; groups further apart than twice that are separate."""
    out: list[list] = [[]]
    for n, (op, i, k, j, m) in enumerate(found):
        if op != "equal":
            out[-1].append((op, i, k, j, m))
            continue
        before, after = (0 if n == 0 else context), (0 if n == len(found) - 1 else context)
        if k - i <= before + after:
            out[-1].append((op, i, k, j, m))
            continue
        if before:
            out[-1].append((op, i, i + before, j, j + before))
        out.append([(op, k - after, k, m - after, m)] if after else [])
    return [h for h in out if any(x[0] != "equal" for x in h)]


def unified(old: Sequence[str], new: Sequence[str], context: int = 3) -> list[tuple[str, str]]:
    """(type, line) of a unified diff: meta, context, remove, add. A line of content that itself begins with --- or +++ counts as meta, too."""
    out: list[str] = []
    span = lambda a, b: f"{a + 1}" if b - a == 1 else f"{a + (b > a)},{b - a}"
    for h in hunks(opcodes(old, new), context):
        out += [] if out else ["--- ", "+++ "]
        out.append(f"@@ -{span(h[0][1], h[-1][2])} +{span(h[0][3], h[-1][4])} @@")
        for op, i, k, j, m in h:
            if op == "equal":
                out += [" " + x for x in old[i:k]]
                continue
            out += ["-" + x for x in old[i:k]] + ["+" + x for x in new[j:m]]
    kind = lambda x: "meta" if x.startswith(("---", "+++", "@@")) else {"+": "add", "-": "remove"}.get(x[0], "context")
    return [(kind(x), x) for x in out]
