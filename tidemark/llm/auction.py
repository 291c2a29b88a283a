"""Shortest paths by auction, over lattices of conversation rows.

Every node has a price, at first a lower bound of its distance to the sink. A path grows from
its origin: where some arc is tight (price = cost + price beyond) the path is extended along
it, else the price of its end rises to the least such sum and the path is contracted by one
node. Costs are integers and cycles have positive length, so it ends, with exact prices on all
shortest paths from the origin. A node that reaches the sink over tight arcs alone lies on
shortest paths only; tracing such arcs by their least letter gives the least of all shortest
paths.

A lattice has layers of four states: what of ``(s?(ua)+)?`` the roles kept so far have matched.
"""

from __future__ import annotations

from functools import lru_cache

INF = 1 << 60
STATES = 4
START, AFTER_S, AFTER_U, AFTER_A = range(STATES)
# The costs of edits.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
# What it costs to end in each state, and the inserts that do.
END_COSTS = (0, 2 * INSERT, INSERT, 0)
END_LETTERS = ("", "II", "I", "")
# Rows by code: the initial of the role, x for others, upper case if the text is cut short;
# b and d are blank and repeated rows, which have to go.
MUST_GO = "bd"

_KEPT = {
    "s": {START: AFTER_S},
    "u": {START: AFTER_U, AFTER_S: AFTER_U, AFTER_A: AFTER_U},
    "a": {AFTER_U: AFTER_A},
    "x": {},
}
_NEXT = (AFTER_U, AFTER_U, AFTER_A, AFTER_U)


def row_arcs(code: str) -> list[list[tuple[int, int, str]]]:
    """From each state the arcs over a row: the state after it, cost, letter."""
    out = [[(state, DELETE, "D")] for state in range(STATES)]
    if code not in MUST_GO:
        more = TRUNCATED if code.isupper() else 0
        kept = _KEPT[code.lower()]
        for state in range(STATES):
            if state in kept:
                out[state].append((kept[state], more, "K"))
            out[state].append((_NEXT[state], REROLE + more, "R"))
    return out


_ROWS = {code: row_arcs(code) for code in "suaxSUAXbd"}
_LEAST = {code: min(a[1] for arcs in rows for a in arcs) for code, rows in _ROWS.items()}


class Lattice:
    """Layers of four nodes and a sink; ``arcs[node]`` has (node, cost, letter)."""

    def __init__(self, layers: int) -> None:
        self.sink = STATES * layers
        self.arcs: list[list[tuple[int, int, str]]] = [[] for _ in range(self.sink + 1)]
        self.price = [0] * (self.sink + 1)

    def ends(self, costs: tuple[int, ...]) -> None:
        last = self.sink - STATES
        for state, cost in enumerate(costs):
            if cost < INF:
                self.arcs[last + state].append((self.sink, cost, ""))

    def lower(self, layer_least: list[int], end: int) -> None:
        """Starts prices at the sum of each later layer's cheapest arc."""
        bound = end
        for layer in range(len(layer_least), -1, -1):
            if layer < len(layer_least):
                bound += layer_least[layer]
            self.price[STATES * layer : STATES * (layer + 1)] = [bound] * STATES
        reached = self.reaching(tight=False)
        for node in range(self.sink):
            if not reached[node]:
                self.price[node] = INF

    def reaching(self, tight: bool) -> list[bool]:
        """The nodes from which the sink is reached, over tight arcs only if so wanted."""
        back: list[list[int]] = [[] for _ in self.arcs]
        for node, arcs in enumerate(self.arcs):
            for to, cost, _ in arcs:
                if not tight or self.price[node] == cost + self.price[to] < INF:
                    back[to].append(node)
        found = [False] * len(self.arcs)
        found[self.sink], todo = True, [self.sink]
        while todo:
            for node in back[todo.pop()]:
                if not found[node]:
                    found[node] = True
                    todo.append(node)
        return found

    def auction(self, origin: int) -> None:
        """Raises prices until a path of tight arcs leads from the origin to the sink."""
        price, arcs, sink = self.price, self.arcs, self.sink
        path = [origin]
        if price[origin] >= INF:
            return
        while (node := path[-1]) != sink:
            least, to = INF, -1
            for other, cost, _ in arcs[node]:
                value = cost + price[other]
                if value < least:
                    least, to = value, other
            if price[node] < least:
                price[node] = least
                if len(path) > 1:
                    path.pop()
            else:
                path.append(to)

    def trace(self, node: int, exact: list[bool]) -> tuple[int, str]:
        """Last node before the sink and the letters of the least shortest path."""
        letters = []
        while True:
            letter, to = min(
                (letter, to) for to, cost, letter in self.arcs[node]
                if exact[to] and self.price[node] == cost + self.price[to]
            )
            if to == self.sink:
                return node, "".join(letters)
            letters.append(letter)
            node = to


def row_lattice(codes: str, ends: tuple[int, ...]) -> Lattice:
    """The lattice of a run of rows. Inserts stand before rows; ``ends`` are the prices of
    the states behind the last row, INF where the sink is not to be reached from."""
    lattice = Lattice(len(codes) + 1)
    for i, code in enumerate(codes):
        for state, arcs in enumerate(_ROWS[code]):
            out = lattice.arcs[STATES * i + state]
            out.append((STATES * i + _NEXT[state], INSERT, "I"))
            out.extend((STATES * (i + 1) + to, cost, letter) for to, cost, letter in arcs)
    lattice.ends(ends)
    lattice.lower([_LEAST[code] for code in codes], min(ends))
    return lattice


def cell_lattice(cells: list[list[int]], ends: tuple[int, ...]) -> Lattice:
    """The lattice of a run of cells, each a table of 16 distances between its states."""
    lattice, least = Lattice(len(cells) + 1), []
    for i, cell in enumerate(cells):
        for place, cost in enumerate(cell):
            if cost < INF:
                state, to = divmod(place, STATES)
                lattice.arcs[STATES * i + state].append((STATES * (i + 1) + to, cost, ""))
        least.append(min(cell))
    lattice.ends(ends)
    lattice.lower(least, min(ends))
    return lattice


def _distances(build, content) -> list[int]:
    out = [INF] * (STATES * STATES)
    for to in range(STATES):
        lattice = build(content, tuple(0 if s == to else INF for s in range(STATES)))
        for state in range(STATES):
            lattice.auction(state)
            out[STATES * state + to] = lattice.price[state]
    return out


@lru_cache(maxsize=1 << 14)
def row_distances(codes: str) -> tuple[int, ...]:
    """Distances from each state before the rows to each state behind them."""
    return tuple(_distances(row_lattice, codes))


def cell_distances(cells: list[list[int]]) -> list[int]:
    return _distances(cell_lattice, cells)


def cell_ends(
    cells: list[list[int]], ends: tuple[int, ...], origins: list[int]
) -> list[tuple[int, ...]]:
    """For each cell the exact prices behind it, INF for states on no shortest path."""
    lattice = cell_lattice(cells, ends)
    for state in origins:
        lattice.auction(state)
    exact = lattice.reaching(tight=True)
    return [
        tuple(
            lattice.price[node] if exact[node] else INF
            for node in range(STATES * (i + 1), STATES * (i + 2))
        )
        for i in range(len(cells))
    ]


@lru_cache(maxsize=1 << 15)
def edits(codes: str, ends: tuple[int, ...], origins: tuple[int, ...]) -> tuple:
    """From each origin (distance, state behind the last row, letters), else None."""
    lattice = row_lattice(codes, ends)
    for state in origins:
        lattice.auction(state)
    exact = lattice.reaching(tight=True)
    out = []
    for state in range(STATES):
        if state in origins and exact[state] and lattice.price[state] < INF:
            node, letters = lattice.trace(state, exact)
            out.append((lattice.price[state], node % STATES, letters))
        else:
            out.append(None)
    return tuple(out)
