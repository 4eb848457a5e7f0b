"""Heaviest matching of a sparse graph, one cell after another.

Linear programming bounds a matching: every cell has a value, every odd set of
cells that is treated as one a surplus, and a pair's two values and the
surpluses of the sets that hold both are at least its weight. The matching is
heaviest once all its pairs just reach their weight, sets with a surplus are
matched within but for one cell, and cells without a partner are worth 0.

Cells join one by one. A new cell starts at the least value that bounds its
pairs with those before it, and a search from it alone lowers that value until
the state is right again: values of cells at even distance in the search tree
fall, those at odd distance rise, at the same pace. What happens next (a pair
reaches its weight, a cell is worth 0, a set has no surplus left) comes from a
heap, and a value is only written down when its pace changes, so a search costs
what it touches. Nothing later than the first cell to reach 0 is put on the heap.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heappop, heappush
from itertools import count

EVEN, ODD = 1, -1
#: What happens: a cell is worth 0, two cells reach their weight, an odd set has no surplus left.
_ZERO, _TIGHT, _SPENT = range(3)


class Matching:
    """The heaviest matching of the cells that have joined. Weights are positive whole numbers of any size."""

    def __init__(self, cells: int, weights: dict[tuple[int, int], int]) -> None:
        self.cells = cells
        self.near: list[dict[int, int]] = [{} for _ in range(cells)]
        for (a, b), w in weights.items():
            self.near[a][b] = self.near[b][a] = 2 * w  # doubled, so that halves of differences are whole
        self.mate = [-1] * cells
        self.joined = [False] * cells
        self.value, self.since = [0] * cells, [0] * cells
        # A node is a cell or a set of nodes around a ring; sets are numbered after the cells.
        self.inside, self.base, self.size = [-1] * cells, list(range(cells)), [1] * cells
        # Cells of an outermost node have a tag in common, which names the node; `merged` takes it on.
        self.tag, self.tagged = list(range(cells)), list(range(cells))
        self.ring: dict[int, list[int]] = {}
        self.links: dict[int, list[tuple[int, int]]] = {}  # (cell of this node, cell of the next) around the ring
        self.surplus: dict[int, int] = {}  # half of it
        self.surplus_since: dict[int, int] = {}
        self.merged: dict[int, int] = {}  # nodes that this search has put into a set, and a set around them
        self.side: dict[int, int] = {}
        self.entry: dict[int, tuple[int, int]] = {}  # of odd nodes: (cell of the even node before it, cell of its own)
        self.now, self.limit, self.heap, self.ticks = 0, 0, [], count()

    def solve(self) -> list[int]:
        """Partner of each cell, -1 for none."""
        for c in range(self.cells):
            self.join(c)
        return self.mate

    def within(self, node: int) -> Iterator[int]:
        """Cells of a node."""
        todo = [node]
        while todo:
            x = todo.pop()
            if x < self.cells:
                yield x
            else:
                todo += self.ring[x]

    def outer(self, c: int) -> int:
        """The outermost node of a cell."""
        node = self.tagged[self.tag[c]]
        if node not in self.merged:
            return node
        way = []
        while node in self.merged:
            way.append(node)
            node = self.merged[node]
        for x in way[:-1]:
            self.merged[x] = node
        return node

    def worth(self, c: int) -> int:
        side = self.side.get(self.outer(c), 0)
        return self.value[c] - side * (self.now - self.since[c]) if side else self.value[c]

    def left(self, node: int) -> int:
        """Half of the surplus of an outermost set."""
        side = self.side.get(node, 0)
        return self.surplus[node] + side * (self.now - self.surplus_since[node]) if side else self.surplus[node]

    def name(self, node: int) -> None:
        """Give the cells of an outermost node a tag in common, that of its first cell."""
        cells = list(self.within(node))
        tag = self.tag[cells[0]]
        for c in cells:
            self.tag[c] = tag
        self.tagged[tag] = node

    def settle(self, node: int) -> None:
        """Write down the values of an outermost node, before its pace changes."""
        for c in self.within(node):
            self.value[c], self.since[c] = self.worth(c), self.now
        if node in self.surplus:
            self.surplus[node], self.surplus_since[node] = self.left(node), self.now

    def later(self, wait: int, what: int, a: int, b: int = -1) -> None:
        at = self.now + wait
        if at <= self.limit:
            heappush(self.heap, (at, next(self.ticks), what, a, b))

    def scan(self, c: int) -> None:
        """Put on the heap what can happen to an even cell."""
        own, here = self.worth(c), self.outer(c)
        self.limit = min(self.limit, self.now + own)
        self.later(own, _ZERO, c)
        for other, weight in self.near[c].items():
            there = self.outer(other)
            if self.joined[other] and there != here:
                side = self.side.get(there, 0)
                if side != ODD:
                    gap = own + self.worth(other) - weight
                    self.later(gap // 2 if side == EVEN else gap, _TIGHT, c, other)

    def mark(self, node: int, side: int) -> None:
        """Set the side of an outermost node that has none."""
        self.settle(node)
        self.side[node] = side
        if side == ODD and node in self.surplus:
            self.later(self.surplus[node], _SPENT, node)

    def join(self, new: int) -> None:
        self.joined[new] = True
        self.now = 0
        self.value[new] = max([0, *(w - self.value[c] for c, w in self.near[new].items() if self.joined[c])])
        if not self.value[new]:
            return
        self.limit, self.heap = self.value[new], []
        self.mark(new, EVEN)
        self.scan(new)
        while True:
            self.now, _, what, a, b = heappop(self.heap)
            if what == _ZERO:
                if self.worth(a) == 0:
                    self.shift(a)
                    self.mate[a] = -1
                    break
            elif what == _SPENT:
                if self.side.get(a) == ODD and a in self.surplus and self.left(a) == 0:
                    self.open(a)
            elif self.reached(a, b):
                break
        for node in self.side:
            self.settle(node)
            self.name(node)
        self.side.clear()
        self.entry.clear()
        self.merged.clear()

    def reached(self, a: int, b: int) -> bool:
        """The even cell `a` and `b` reach their weight. True if the search ends with that."""
        here, there = self.outer(a), self.outer(b)
        side = self.side.get(there, 0)
        if here == there or side == ODD or self.worth(a) + self.worth(b) != self.near[a][b]:
            return False  # something came between
        if side == EVEN:
            self.close(a, b)
        elif self.mate[self.base[there]] < 0:
            self.shift(a)
            self.turn(there, b)
            self.mate[a], self.mate[b] = b, a
            return True
        else:
            self.mark(there, ODD)
            self.entry[there] = (a, b)
            following = self.outer(self.mate[self.base[there]])
            self.mark(following, EVEN)
            for c in list(self.within(following)):
                self.scan(c)
        return False

    def turn(self, node: int, cell: int) -> None:
        """Match a node's cells among themselves but for `cell`, its new base."""
        todo = [(node, cell)]
        while todo:
            node, cell = todo.pop()
            if self.base[node] == cell:
                continue
            part = cell
            while self.inside[part] != node:
                part = self.inside[part]
            at = self.ring[node].index(part)
            ring = self.ring[node] = self.ring[node][at:] + self.ring[node][:at]
            links = self.links[node] = self.links[node][at:] + self.links[node][:at]
            todo.append((part, cell))
            for i in range(1, len(ring), 2):
                a, b = links[i]
                todo += [(ring[i], a), (ring[i + 1], b)]
                self.mate[a], self.mate[b] = b, a
            self.base[node] = cell

    def shift(self, cell: int) -> None:
        """Swap matched and other pairs from the root to an even cell, which then has no partner within the tree."""
        pair = None
        while True:
            node = self.outer(cell)
            before = self.mate[self.base[node]]
            if pair:
                self.mate[pair[0]], self.mate[pair[1]] = pair[1], pair[0]
            self.turn(node, cell)
            if before < 0:
                return
            odd = self.outer(before)
            pair = self.entry[odd]
            self.turn(odd, pair[1])
            cell = pair[0]

    def above(self, node: int) -> int:
        """The even node two steps nearer the root, -1 at the root."""
        partner = self.mate[self.base[node]]
        return self.outer(self.entry[self.outer(partner)][0]) if partner >= 0 else -1

    def path(self, node: int, end: int) -> tuple[list[int], list[tuple[int, int]]]:
        """Nodes from an even one towards the root, before `end`, and the link from each to the next."""
        nodes, links = [], []
        while node != end:
            own = self.base[node]
            odd = self.outer(self.mate[own])
            far, near = self.entry[odd]
            nodes += [node, odd]
            links += [(own, self.mate[own]), (near, far)]
            node = self.outer(far)
        return nodes, links

    def close(self, a: int, b: int) -> None:
        """Two even nodes meet: the ring through them and the node where their paths meet becomes one even node."""
        passed, x, y = set(), self.outer(a), self.outer(b)
        while x not in passed:
            if x >= 0:
                passed.add(x)
                x = self.above(x)
            x, y = y, x
            if x < 0:
                x, y = y, x
        (left, back), (right, on) = self.path(self.outer(a), x), self.path(self.outer(b), x)
        ring = [x, *reversed(left), *right]
        new = len(self.base)
        self.base.append(self.base[x])
        self.inside.append(-1)
        self.size.append(sum(self.size[node] for node in ring))
        self.ring[new], self.links[new] = ring, [*((v, u) for u, v in reversed(back)), (a, b), *on]
        fresh: list[int] = []
        for node in ring:
            if self.side[node] == ODD:
                self.settle(node)
                fresh += self.within(node)
                del self.entry[node]
            elif node in self.surplus:  # cells of even nodes go on at the same pace
                self.surplus[node] = self.left(node)
            del self.side[node]
            self.inside[node], self.merged[node] = new, new
        self.surplus[new], self.surplus_since[new] = 0, self.now
        self.side[new] = EVEN
        for c in fresh:
            self.scan(c)

    def open(self, node: int) -> None:
        """An odd set without surplus: its ring is taken apart, the even way round it stays in the tree."""
        entry, ring, links = self.entry.pop(node), self.ring.pop(node), self.links.pop(node)
        del self.side[node], self.surplus[node], self.surplus_since[node]
        n, part = len(ring), entry[1]
        while self.inside[part] != node:
            part = self.inside[part]
        at = ring.index(part)
        way = list(range(at, -1, -1)) if at % 2 == 0 else [*range(at, n), 0]
        side = {i: EVEN if step % 2 else ODD for step, i in enumerate(way)}
        # The largest part keeps the tag, and parts that stay odd their pace, so that deep sets are opened at the cost of what leaves them.
        largest = max(range(n), key=lambda i: self.size[ring[i]])
        tag = self.tag[next(self.within(ring[largest]))]
        for i, part in enumerate(ring):
            self.inside[part] = -1
            if i != largest:
                own = list(self.within(part))
                fresh_tag = len(self.tagged)
                self.tagged.append(part)
                for c in own:
                    self.tag[c] = fresh_tag
            if side.get(i) != ODD:
                for c in self.within(part):
                    self.value[c], self.since[c] = self.value[c] + self.now - self.since[c], self.now
        self.tagged[tag] = ring[largest]
        fresh: list[int] = []
        for step, i in enumerate(way):
            part = ring[i]
            self.side[part] = side[i]
            if part in self.surplus:
                self.surplus_since[part] = self.now
                if side[i] == ODD:
                    self.later(self.surplus[part], _SPENT, part)
            if side[i] == EVEN:
                fresh += self.within(part)
            elif step:
                before = way[step - 1]
                self.entry[part] = links[before] if (before + 1) % n == i else links[i][::-1]
            else:
                self.entry[part] = entry
        for part in ring:
            if part not in self.side:
                for c in self.within(part):
                    for other, weight in self.near[c].items():
                        if self.joined[other] and self.side.get(self.outer(other)) == EVEN:
                            self.later(self.worth(other) + self.value[c] - weight, _TIGHT, other, c)
        for c in fresh:
            self.scan(c)


def heaviest_matching(cells: int, weights: dict[tuple[int, int], int]) -> list[int]:
    """Partner of each cell (-1: none) in the matching of largest weight; weights by pairs of numbers below `cells`."""
    return Matching(cells, weights).solve()
