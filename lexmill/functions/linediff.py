"""Line diffs by patience: anchors are lines that occur once on either side, in the longest order that both sides share.

Between anchors, and where a stretch has none, the same is done again on what lies there. A stretch without such lines is aligned by a longest common
subsequence over all pairs of equal lines; with more than ``PAIRS`` such pairs (many equal blank lines, say) the first of a line on one
side is paired with the first on the other, the second with the second, and so on. The edits always turn one text into the other.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

PAIRS = 1 << 20
_PLACES = ("before_from", "before_to", "after_from", "after_to")
_EDITS = ArrayType(StructType([StructField("op", StringType()), *[StructField(p, IntegerType()) for p in _PLACES], StructField("lines", ArrayType(StringType()))]))


def increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest chain of pairs that ascends in both numbers; of one first number the pairs come with descending second ones."""
    tops: list[int] = []
    ends: list[int] = []
    back: list[int] = []
    for k, (_, j) in enumerate(pairs):
        at = bisect_left(tops, j)
        back.append(ends[at - 1] if at else -1)
        if at == len(tops):
            tops.append(j)
            ends.append(k)
        else:
            tops[at], ends[at] = j, k
    chain, k = [], ends[-1] if ends else -1
    while k >= 0:
        chain.append(pairs[k])
        k = back[k]
    return chain[::-1]


def _anchors(a: list, b: list) -> tuple[list[tuple[int, int]], bool]:
    """Pairs of places of two stretches to hold on to, and whether what lies between may hold more."""
    left, right = Counter(a), Counter(b)
    where = {x: j for j, x in enumerate(b) if right[x] == 1 and left.get(x) == 1}
    if where:
        return increasing([(i, where[x]) for i, x in enumerate(a) if x in where]), True
    if sum(n * right[x] for x, n in left.items() if x in right) <= PAIRS:
        spots: dict = {}
        for j, x in enumerate(b):
            spots.setdefault(x, []).append(j)
        return increasing([(i, j) for i, x in enumerate(a) for j in reversed(spots.get(x, ()))]), False
    seen, numbered = Counter(), {}
    for j, x in enumerate(b):
        numbered[x, seen[x]] = j
        seen[x] += 1
    seen.clear()
    pairs = []
    for i, x in enumerate(a):
        if (j := numbered.get((x, seen[x]))) is not None:
            pairs.append((i, j))
        seen[x] += 1
    return increasing(pairs), bool(pairs)


def matches(a: list, b: list) -> list[tuple[int, int]]:
    """Places of lines that are kept, ascending on both sides."""
    kept, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        i, j, k, m = todo.pop()
        while i < j and k < m and a[i] == b[k]:
            kept.append((i, k))
            i, k = i + 1, k + 1
        while i < j and k < m and a[j - 1] == b[m - 1]:
            j, m = j - 1, m - 1
            kept.append((j, m))
        if i < j and k < m:
            last_i, last_k = i, k
            anchors, more = _anchors(a[i:j], b[k:m])
            for x, y in anchors:
                kept.append((x + i, y + k))
                if more:
                    todo.append((last_i, x + i, last_k, y + k))
                last_i, last_k = x + i + 1, y + k + 1
            if more:
                todo.append((last_i, j, last_k, m))
    return sorted(kept)


def edits(before: str, after: str) -> list[tuple[str, int, int, int, int]]:
    """(op, from and to in before, from and to in after): equal, delete, insert or replace, in order; together they cover both texts."""
    a, b = before.split("\n"), after.split("\n")
    out: list[tuple[str, int, int, int, int]] = []
    i = j = 0
    for x, y in [*matches(a, b), (len(a), len(b))]:
        if x > i or y > j:
            out.append(("replace" if x > i and y > j else "delete" if x > i else "insert", i, x, j, y))
        if x < len(a):
            if out and out[-1][0] == "equal" and out[-1][2] == x:
                out[-1] = ("equal", out[-1][1], x + 1, out[-1][3], y + 1)
            else:
                out.append(("equal", x, x + 1, y, y + 1))
        i, j = x + 1, y + 1
    return out


def _script(before: str | None, after: str | None) -> list[dict]:
    new = (after or "").split("\n")
    return [{"op": op, "before_from": i, "before_to": j, "after_from": k, "after_to": m, "lines": [] if op in ("equal", "delete") else new[k:m]} for op, i, j, k, m in edits(before or "", after or "")]


@F.pandas_udf(_EDITS)
def line_edits(before: pd.Series, after: pd.Series) -> pd.Series:
    """The edits of each pair of texts, with the lines that are new; null texts count as empty."""
    return pd.Series([_script(a, b) for a, b in zip(before, after, strict=True)])


def with_edits(rows: DataFrame, before: str, after: str, script: str) -> DataFrame:
    """The rows with ``line_edits`` of two of their columns, whatever these are made of.

    Over texts that were dealt out, Spark may write such a column's expression into the UDF's call (the one of ``drop_repeated_lines``, for one) and then
    not take the call out for Python, which fails. Here the columns are made below the step in Python.
    """
    kind = pa.list_(pa.struct([("op", pa.string()), *[(p, pa.int32()) for p in _PLACES], ("lines", pa.list_(pa.string()))]))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(*(batch.column(batch.schema.get_field_index(name)).to_pylist() for name in (before, after)), strict=True)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([_script(a, b) for a, b in pairs], kind)], [*batch.schema.names, script])

    return rows.mapInArrow(add, StructType([*rows.schema.fields, StructField(script, _EDITS)]))


def applied(before: Column, script: Column) -> Column:
    """The text that the edits make of the one before."""
    old = F.split(F.coalesce(before, F.lit("")), "\n", -1)

    def made(own: Column) -> Column:
        part = lambda e: F.when(e["op"] == "equal", F.slice(own, e["before_from"] + 1, e["before_to"] - e["before_from"])).otherwise(e["lines"])
        return F.array_join(F.flatten(F.transform(script, part)), "\n")

    # Bound as a lambda's variable, so the text is split once.
    return F.get(F.transform(F.array(old), made), 0)


def edited_lines(script: Column, ops: tuple[str, ...], side: str = "before") -> Column:
    """How many lines of a side the edits of these kinds cover."""
    own = F.filter(script, lambda e: e["op"].isin(*ops))
    return F.aggregate(own, F.lit(0), lambda s, e: s + e[f"{side}_to"] - e[f"{side}_from"])


def changed_lines(script: Column) -> Column:
    """Lines of replacements, of each the longer side."""
    own = F.filter(script, lambda e: e["op"] == "replace")
    return F.aggregate(own, F.lit(0), lambda s, e: s + F.greatest(e["before_to"] - e["before_from"], e["after_to"] - e["after_from"]))
