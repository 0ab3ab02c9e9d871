"""Deep-shallow sorting: multikey quicksort to a shallow depth, then blind tries for what still agrees."""

from __future__ import annotations

WORD = 8
SHALLOW = 16


def common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    differ = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (differ.bit_length() + 7) // 8


class BlindTrie:
    """A compacted trie that keeps branching bytes only; equal strings share a leaf.

    An inner node is (depth, children by the byte at that depth, -1 where a string ends); a leaf
    is a list of positions. A string first goes down blindly to some leaf; its common prefix with
    the string there tells where it really leaves the path.
    """

    def __init__(self, strings: list[bytes]):
        self.strings = strings
        self.root: tuple | list | None = None

    def _byte(self, string: bytes, depth: int) -> int:
        return string[depth] if depth < len(string) else -1

    def add(self, position: int) -> None:
        string = self.strings[position]
        if self.root is None:
            self.root = [position]
            return
        node = self.root
        while isinstance(node, tuple):
            children = node[1]
            node = children.get(self._byte(string, node[0])) or next(iter(children.values()))
        other = self.strings[node[0]]
        leaves = common_prefix(string, other)
        if leaves == len(string) == len(other):
            node.append(position)
            return
        parent, node = None, self.root
        while isinstance(node, tuple) and node[0] < leaves:
            parent, node = node, node[1][self._byte(string, node[0])]
        if isinstance(node, tuple) and node[0] == leaves:
            node[1][self._byte(string, leaves)] = [position]
            return
        branch = (leaves, {self._byte(other, leaves): node, self._byte(string, leaves): [position]})
        if parent is None:
            self.root = branch
        else:
            parent[1][self._byte(string, parent[0])] = branch

    def in_order(self) -> list[int]:
        found: list[int] = []
        waiting = [self.root] if self.root is not None else []
        while waiting:
            node = waiting.pop()
            if isinstance(node, tuple):
                waiting += [node[1][b] for b in sorted(node[1], reverse=True)]
            else:
                found += node
        return found


def deep_shallow_order(strings: list[bytes], agree: int = 0) -> list[int]:
    """Positions of the strings in sorted order; all of them agree in their first `agree` bytes."""
    found: list[int] = []
    waiting = [(list(range(len(strings))), agree)]
    while waiting:
        group, depth = waiting.pop()
        if len(group) < 2:
            found += group
        elif depth >= agree + SHALLOW:
            trie = BlindTrie(strings)
            for position in group:
                trie.add(position)
            found += trie.in_order()
        else:
            words = [strings[i][depth : depth + WORD] for i in group]
            pivot = words[len(words) // 2]
            less = [i for i, w in zip(group, words, strict=True) if w < pivot]
            same = [i for i, w in zip(group, words, strict=True) if w == pivot]
            more = [i for i, w in zip(group, words, strict=True) if w > pivot]
            waiting.append((more, depth))
            # Strings that end within the pivot word are equal as a whole.
            waiting.append((same, depth + WORD if len(pivot) == WORD else agree + SHALLOW))
            waiting.append((less, depth))
    return found
