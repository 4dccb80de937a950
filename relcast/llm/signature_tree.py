"""Self-join of sets by Jaccard similarity with a signature tree.

A node holds the OR of its sets' token bitmaps, the least and the greatest size below it and the most tokens that a set below
it has beyond its own bits. Two nodes are traversed together; the pair is left when the sizes can't agree, when the bits
that both have, and the tokens that may hide in one bit, can't make up the overlap that the smallest sets would need, or when
everything below both is one component already. Only links that join two components are returned.
"""

from __future__ import annotations

import numpy as np

FANOUT = 8


class Node:
    __slots__ = ("bits", "children", "excess", "high", "low", "member", "members", "one")

    def __init__(self, members: list[int], children: list[Node], member: int = -1):
        self.members, self.children, self.member, self.one = members, children, member, member >= 0

    @staticmethod
    def leaf(member: int, tokens: np.ndarray, words: int) -> Node:
        node = Node([member], [], member)
        node.bits = np.zeros(words, np.uint64)
        spot = tokens % np.uint64(words * 64)
        np.bitwise_or.at(node.bits, (spot >> np.uint64(6)).astype(np.int64), np.uint64(1) << (spot & np.uint64(63)))
        node.low = node.high = len(tokens)
        node.excess = len(tokens) - int(np.bitwise_count(node.bits).sum())
        return node

    @staticmethod
    def over(children: list[Node]) -> Node:
        node = Node([m for c in children for m in c.members], children)
        node.bits = np.bitwise_or.reduce([c.bits for c in children])
        node.low, node.high, node.excess = min(c.low for c in children), max(c.high for c in children), max(c.excess for c in children)
        return node


class TreeJoin:
    """Sets ``tokens`` (sorted, distinct, not empty) and the share ``over`` in hundredths; ``labels`` are known components."""

    def __init__(self, tokens: list[np.ndarray], over: int, labels: list[int] | None = None):
        self.tokens, self.over, self.links = tokens, over, []
        self.parent = list(range(len(tokens)))
        first: dict[int, int] = {}
        for i, label in enumerate(labels or []):
            self.parent[i] = first.setdefault(label, i)
        self.words = 1 << max(2, int(4 * max(map(len, tokens), default=1) - 1).bit_length() - 6)

    def find(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = i = self.parent[self.parent[i]]
        return i

    def tree(self, members: list[int]) -> Node:
        """Sets with the same least token, which similar ones mostly share, lie side by side."""
        level = [Node.leaf(m, self.tokens[m], self.words) for m in sorted(members, key=lambda m: (int(self.tokens[m][0]), len(self.tokens[m]), m))]
        while len(level) > 1:
            level = [Node.over(level[k : k + FANOUT]) if len(level[k : k + FANOUT]) > 1 else level[k] for k in range(0, len(level), FANOUT)]
        return level[0]

    def uniform(self, node: Node) -> bool:
        if not node.one:
            root = self.find(node.members[0])
            node.one = all(self.find(m) == root for m in node.members)
        return node.one

    def within(self, node: Node) -> None:
        for child in node.children:
            self.within(child)
        for i, a in enumerate(node.children):
            for b in node.children[i + 1 :]:
                self.across(a, b)

    def across(self, a: Node, b: Node) -> None:
        if self.find(a.members[0]) == self.find(b.members[0]) and self.uniform(a) and self.uniform(b):
            return
        over = self.over
        if 100 * a.high < over * b.low or 100 * b.high < over * a.low:
            return
        need = -(-over * (a.low + b.low) // (100 + over))
        if min(a.high, b.high) < need or int(np.bitwise_count(a.bits & b.bits).sum()) + min(a.excess, b.excess) < need:
            return
        if not a.children and not b.children:
            self.compare(a.member, b.member)
        elif len(a.members) >= len(b.members):
            for child in a.children:
                self.across(child, b)
        else:
            for child in b.children:
                self.across(a, child)

    def compare(self, i: int, j: int) -> None:
        x, y = self.tokens[i], self.tokens[j]
        both = np.sort(np.concatenate([x, y]), kind="stable")
        common = int((both[1:] == both[:-1]).sum())
        if 100 * common >= self.over * (len(x) + len(y) - common):
            self.links.append((i, j))
            self.parent[self.find(i)] = self.find(j)
