"""The most similar window of a text: longest common subsequences with all windows at once, and with many texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

U = np.uint64
#: Comparisons and window states that are held at once.
HELD = 1 << 20


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def combed(a: str, b: str) -> np.ndarray:
    """For each place of b where on top of the grid of a and b the strand starts that ends below it, negative if it comes from the side.

    Strands run through the grid from the left and the top; in a cell of equal letters they turn, elsewhere they cross unless they have
    crossed before (semi-local alignment by combing). The subsequence that a and b[i:j] share is j - i less the strands that start and end
    between i and j. Cells of one diagonal do not touch and are combed together.
    """
    m, n = len(a), len(b)
    left, right = _codes(a)[::-1], _codes(b)
    side, top = np.arange(m, dtype=np.int64), np.arange(m, m + n, dtype=np.int64)
    for d in range(m + n - 1):
        first, last = max(0, d - n + 1), min(d, m - 1)
        at, to = slice(m - 1 - last, m - first), slice(d - last, d - first + 1)
        h, v = side[at], top[to]
        turn = (left[at] == right[to]) | (h > v)
        side[at], top[to] = np.where(turn, v, h), np.where(turn, h, v)
    return top - m


def combed_together(pairs: list[tuple[str, str]]) -> list[np.ndarray]:
    """``combed`` of each pair, cells of one diagonal of all grids together.

    Grids are filled up to one size with letters that equal none. A row added below has a strand lower than all and a column added
    behind one higher than all: these cross nothing, so the others go as they would alone.
    """
    high, wide = max(len(a) for a, _ in pairs), max(len(b) for _, b in pairs)
    kind = np.int16 if 2 * high + wide < 1 << 15 else np.int64
    left, right = np.full((high, len(pairs)), 0xFFFFFFFF, np.uint32), np.full((wide, len(pairs)), 0xFFFFFFFE, np.uint32)
    m = np.array([len(a) for a, _ in pairs])
    for p, (a, b) in enumerate(pairs):
        left[high - len(a) :, p] = _codes(a)[::-1]
        right[: len(b), p] = _codes(b)
    side, top = (np.arange(high)[:, None] - (high - m)).astype(kind), (np.arange(wide)[:, None] + m).astype(kind)
    for d in range(high + wide - 1):
        first, last = max(0, d - wide + 1), min(d, high - 1)
        at, to = slice(high - 1 - last, high - first), slice(d - last, d - first + 1)
        h, v = side[at], top[to]
        turn = left[at] == right[to]
        turn |= h > v
        side[at], top[to] = np.where(turn, v, h), np.where(turn, h, v)
    top = top.astype(np.int64) - m
    return [top[: len(b), p] for p, (_, b) in enumerate(pairs)]


def window_scores(short: str, long: str, starts: np.ndarray | None = None) -> np.ndarray:
    """The ratio of ``short`` with each window of its length in ``long``; windows begin before the first letter and end behind the last one."""
    m, n = len(short), len(long)
    starts = combed(short, long) if starts is None else starts
    low, high = np.maximum(np.arange(1 - m, n), 0), np.minimum(np.arange(1, n + m), n)
    inside = np.empty(len(low), np.int64)
    padded = np.concatenate((starts, np.full(m, -1)))
    for at in range(0, n, step := max(1, HELD // m)):
        # From a start on: all m places behind it, those past the end never count.
        rows = np.lib.stride_tricks.sliding_window_view(padded[at : at + step + m - 1], m)[: n - at]
        inside[m - 1 + at : m - 1 + at + len(rows)] = (rows >= np.arange(at, at + len(rows))[:, None]).sum(1)
    # Windows that begin before the text hold its first letters.
    inside[:m] = np.cumsum(starts[: min(m, n)] >= 0)[np.minimum(high[:m], n) - 1]
    return 200.0 * (high - low - inside) / (m + high - low)


def best_window(a: str, b: str) -> tuple[float, int, int]:
    """The best ratio of the shorter text with a window of its length in the longer, and where that first is."""
    short, long = sorted((a, b), key=len)
    if not short:
        return (100.0 if not long else 0.0), 0, 0
    if (at := long.find(short)) >= 0:
        return 100.0, at, at + len(short)
    scores = window_scores(short, long)
    best = int(scores.argmax())
    return float(scores[best]), max(0, best + 1 - len(short)), min(len(long), best + 1)


def _groups(pairs: list[tuple[str, str]]) -> Iterator[list[int]]:
    """Places of pairs that are dearer apart: a step over a diagonal costs some microseconds, a cell some nanoseconds, filled up or not."""
    cost = lambda count, m, n: (m + n) * (10_000 + 4 * count * min(m, n)) if count * (m + n) <= HELD else float("inf")
    group, m, n = [], 0, 0
    for i in sorted(range(len(pairs)), key=lambda i: (len(pairs[i][0]).bit_length(), len(pairs[i][1]))):
        own_m, own_n = len(pairs[i][0]), len(pairs[i][1])
        if group and cost(len(group) + 1, max(m, own_m), max(n, own_n)) > cost(len(group), m, n) + cost(1, own_m, own_n):
            yield group
            group, m, n = [], 0, 0
        group.append(i)
        m, n = max(m, own_m), max(n, own_n)
    if group:
        yield group


def best_windows(pairs: list[tuple[str, str]]) -> list[tuple[float, int, int]]:
    """``best_window`` of each pair, pairs of like size together."""
    known = {}
    for pair in dict.fromkeys(tuple(sorted(p, key=len)) for p in pairs):
        known[pair] = best_window(*pair) if not pair[0] or pair[0] in pair[1] else None
    todo = [p for p, best in known.items() if best is None]
    for group in _groups(todo):
        own = [todo[i] for i in group]
        for (short, long), starts in zip(own, combed_together(own), strict=True):
            scores = window_scores(short, long, starts)
            best = int(scores.argmax())
            known[short, long] = float(scores[best]), max(0, best + 1 - len(short)), min(len(long), best + 1)
    return [known[tuple(sorted(p, key=len))] for p in pairs]


def best_scores(query: str, texts: list[str]) -> np.ndarray:
    """``best_window(query, text)[0]`` for many texts: those at least as long as the query are laid end to end, and all their windows take
    the query's letters in step, each a row of bits (the bit-parallel longest common subsequence)."""
    m = len(query)
    out = np.array([-1.0 if m and len(t) >= m else best_window(query, t)[0] for t in texts], np.float64)
    todo = np.flatnonzero(out < 0)
    # Nanoseconds: a step over an array costs a thousand and one for each element. Bits take a step for every letter and word, combing one for every diagonal.
    own_lengths = [len(texts[i]) for i in todo.tolist()]
    if sum((m + n) * (1000 + m) for n in own_lengths) < m * -(-m // 64) * (1000 + sum(own_lengths)):
        out[todo] = [score for score, _, _ in best_windows([(query, texts[i]) for i in todo.tolist()])]
        return out
    if not len(todo):
        return out
    words = -(-m // 64)
    letters, which = np.unique(_codes(query), return_inverse=True)
    masks = np.zeros((len(letters) + 1, words), U)
    for i, letter in enumerate(which.tolist()):
        masks[letter, i // 64] |= U(1 << i % 64)
    low = 0
    while low < len(todo):
        high, size = low, 0
        while high < len(todo) and (high == low or size < HELD // (4 * words)):
            size += len(texts[todo[high]]) + m
            high += 1
        own = [texts[i] for i in todo[low:high].tolist()]
        gap = "\x00" * (m - 1)
        codes = _codes(gap + gap.join(own) + gap)
        lengths = np.array([len(t) for t in own])
        begin = m - 1 + np.concatenate(([0], np.cumsum(lengths[:-1] + m - 1)))
        text = np.zeros(len(codes), bool)
        for b, n in zip(begin.tolist(), lengths.tolist(), strict=True):
            text[b : b + n] = True
        found = np.minimum(np.searchsorted(letters, codes), len(letters) - 1)
        place = np.where(text & (letters[found] == codes), found, len(letters))
        # A window starts at every place from m - 1 before a text to its last letter.
        windows = len(codes) - m + 1
        state = np.full((words, windows), ~U(0))
        for step in range(m):
            carry = np.zeros(windows, bool)
            hit = masks[place[step : step + windows]]
            for w in range(words):
                row = state[w]
                u = row & hit[:, w]
                total = row + u
                more = total < row
                added = total + carry.astype(U)
                carry = more | (added < total)
                state[w] = added | (row & ~u)
        spare = U((1 << (m - 64 * (words - 1))) - 1) if m % 64 else ~U(0)
        shared = sum((np.bitwise_count(~state[w] & (spare if w == words - 1 else ~U(0))).astype(np.int64) for w in range(words)), np.zeros(windows, np.int64))
        upto = np.concatenate(([0], np.cumsum(text)))
        length = upto[m:] - upto[:-m]
        score = np.where(length > 0, 200.0 * shared / (m + length), 0.0)
        # The windows of one text end where those of the next begin.
        out[todo[low:high]] = np.maximum.reduceat(score, begin - m + 1)
        low = high
    return out
