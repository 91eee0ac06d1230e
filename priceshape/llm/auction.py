"""Cheapest edits of a conversation by the auction shortest-path algorithm.

Nodes are (rows consumed, state); the states of ``(s?(ua)+)?`` are 0 (nothing yet), 1 (after the
system turn), 2 (a user turn is open) and 3 (answered). Arcs are the edits with their integer costs:

* ``D`` deletes a row (2), ``K`` keeps it (0) and ``R`` gives it the role that comes next (1);
  rows that are blank or repeated can only be deleted, and keeping a truncated one costs 5 more;
* ``I`` inserts an empty turn of the role that comes next (5).

Every node has a price that never exceeds the cost of an arc plus the price behind it. A path grows
from the origin along an arc that attains this bound (extension); at a node that no arc attains, the
price rises to the least bound and the path steps back (contraction). When the path arrives, the
price of the origin is its distance. Long conversations are settled in pieces from the end, each from
all four states it can be entered in, so that the work stays linear in their length.

The prices stay feasible, so a path is cheapest exactly if all its arcs are tight. The least string of
labels follows by marking the nodes from which tight arcs arrive and taking, from the start, the least
label that leads to a marked node (a node has at most one arc of a label).
"""

from __future__ import annotations

import functools
from array import array

#: Fixed costs of the edits.
DELETE, KEEP, REROLE, INSERT, TRUNCATED = 2, 0, 1, 5, 5
#: A row is a byte: its initial (other, s, u, a) and four times its first fault.
INITIALS = " sua"
NONE, BLANK, DUPLICATE, CUT = range(4)
#: Rows that are settled at once.
PIECE = 64

#: State after a turn of the role that comes next, and whether that is the user.
_NEXT = (2, 2, 3, 2)


def _arcs(code: int) -> list[list[tuple[str, int, int, int]]]:
    """Per state the arcs of a row in order of their labels: label, rows consumed, state, cost."""
    initial, fault = INITIALS[code % 4], code // 4
    out = []
    for state, after in enumerate(_NEXT):
        arcs = [("D", 1, state, DELETE), ("I", 0, after, INSERT)]
        if fault in (NONE, CUT):
            more = TRUNCATED if fault == CUT else 0
            if state == 0 and initial == "s":
                arcs.append(("K", 1, 1, KEEP + more))
            elif initial == ("a" if state == 2 else "u"):
                arcs.append(("K", 1, after, KEEP + more))
            arcs.append(("R", 1, after, REROLE + more))
        out.append(arcs)
    return out


ARCS = [_arcs(code) for code in range(16)]
_INSERTS = [[("I", 0, after, INSERT)] for after in _NEXT]
_LEAST = [min(cost for arcs in ARCS[code] for _, rows, _, cost in arcs if rows) for code in range(16)]


def _settle(rows: bytes, prices: array, low: int, high: int, ends: list[int | None]) -> None:
    """Make the prices of the four nodes before row ``low`` exact, given the cost ``ends`` of leaving
    at ``high`` from each state (None: no way out there)."""
    least = min(e for e in ends if e is not None)
    for level in range(high, low - 1, -1):
        least += _LEAST[rows[level]] if level < high else 0
        for state in range(4):
            prices[4 * level + state] = least
    for origin in range(4 * low, 4 * low + 4):
        path = [origin]
        while True:
            node = path[-1]
            level, state = node >> 2, node & 3
            best, to = (ends[state], -1) if level == high else (None, -1)
            for _, step, after, cost in ARCS[rows[level]][state] if level < high else _INSERTS[state]:
                there = 4 * (level + step) + after
                if best is None or cost + prices[there] < best:
                    best, to = cost + prices[there], there
            if prices[node] < best:
                prices[node] = best
                if len(path) > 1:
                    path.pop()
            elif to < 0:
                break
            else:
                path.append(to)


def _plan(rows: bytes) -> tuple[int, str]:
    n = len(rows)
    prices = array("q", bytes(32 * (n + 1)))
    high, ends = n, [0, None, None, 0]
    while True:
        low = max(0, high - PIECE)
        held = prices[4 * high:4 * high + 4] if high < n else None
        _settle(rows, prices, low, high, ends)
        if held is not None:
            prices[4 * high:4 * high + 4] = held
        if low == 0:
            break
        high, ends = low, list(prices[4 * low:4 * low + 4])

    arrives = bytearray(4 * (n + 1))
    arrives[4 * n] = prices[4 * n] == 0
    arrives[4 * n + 3] = prices[4 * n + 3] == 0

    def tight(level: int, state: int):
        for label, step, after, cost in ARCS[rows[level]][state] if level < n else _INSERTS[state]:
            there = 4 * (level + step) + after
            if prices[4 * level + state] == cost + prices[there]:
                yield label, there

    for level in range(n, -1, -1):
        for _ in range(2):  # insertions stay on the level
            for state in (3, 2, 1, 0):
                node = 4 * level + state
                arrives[node] = arrives[node] or any(arrives[there] for _, there in tight(level, state))
    audit, node = [], 0
    while not (node >> 2 == n and node & 3 in (0, 3)):
        label, node = next((x, there) for x, there in tight(node >> 2, node & 3) if arrives[there])
        audit.append(label)
    return prices[0], "".join(audit)


_remembered = functools.lru_cache(1 << 16)(_plan)


def plan(rows: bytes) -> tuple[int, str]:
    """Cost and labels of the cheapest edits, of equally cheap ones the least string."""
    return (_remembered if len(rows) <= PIECE else _plan)(rows)


class Roles:
    """Roles of the repaired turns, as the labels come."""

    def __init__(self) -> None:
        self.state = 0

    def next(self, label: str, initial: str) -> str | None:
        """``user`` or ``assistant`` for R and I, and for K None as the row keeps its role."""
        if label == "K" and self.state == 0 and initial == "s":
            self.state = 1
            return None
        role = "assistant" if self.state == 2 else "user"
        self.state = _NEXT[self.state]
        return None if label == "K" else role
