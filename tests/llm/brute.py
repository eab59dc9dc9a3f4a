"""Plain versions of the operators, for comparison on small tables."""

from collections import Counter


def edit_distance(a: str, b: str) -> int:
    """Myers' bit-parallel edit distance."""
    if not a:
        return len(b)
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    mask, last = (1 << len(a)) - 1, 1 << len(a) - 1
    up, down, score = mask, 0, len(a)
    for c in b:
        eq = at.get(c, 0)
        xv, xh = eq | down, (((eq & up) + up) ^ up) | eq
        ph, mh = down | ~(xh | up) & mask, up & xh
        score += bool(ph & last) - bool(mh & last)
        ph, mh = (ph << 1 | 1) & mask, mh << 1 & mask
        up, down = mh | ~(xv | ph) & mask, ph & xv
    return score


def agree(a: str, b: str, share: float = 0.05) -> bool:
    longer = max(len(a), len(b))
    k = int(longer * share + 1e-9)
    if abs(len(a) - len(b)) > k:
        return False
    if a == b:
        return True
    bags = Counter(a)
    bags.subtract(b)
    if sum(map(abs, bags.values())) > 2 * k:
        return False
    return edit_distance(a, b) <= k


def near_repeats(rows: list[tuple[str | None, int, int]]) -> set[tuple[int, int]]:
    """rows: (text, arrival, batch)."""
    accepted, cases = [], set()
    for text, arrival, batch in sorted({r for r in rows if (r[0] or "").strip(" \t\r\n")}, key=lambda r: r[1]):
        first = next((a for t, a in accepted if a < arrival and agree(t, text)), None)
        if batch and first is not None:
            cases.add((arrival, first))
        else:
            accepted.append((text, arrival))
    return cases
