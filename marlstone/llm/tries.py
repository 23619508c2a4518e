"""A compressed (radix) trie of byte strings."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any


class Node:
    """``label``: the bytes on the edge to it.  ``value``: what a text that ends
    here holds; None where none ends."""

    __slots__ = ("label", "children", "value")

    def __init__(self, label: bytes) -> None:
        self.label, self.children, self.value = label, {}, None


def shared(label: bytes, text: bytes, at: int) -> int:
    """How many bytes of ``label`` and of ``text`` from ``at`` agree; the first
    is known to."""
    lo, hi = 1, min(len(label), len(text) - at)
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if label[lo:mid] == text[at + lo : at + mid]:
            lo = mid
        else:
            hi = mid - 1
    return lo


class Trie:
    def __init__(self) -> None:
        self.root = Node(b"")

    def terminal(self, text: bytes) -> Node:
        """The node at which ``text`` ends, made if need be."""
        node, at = self.root, 0
        while at < len(text):
            child = node.children.get(text[at])
            if child is None:
                child = node.children[text[at]] = Node(text[at:])
                return child
            if not text.startswith(child.label, at):
                k = shared(child.label, text, at)
                upper = node.children[text[at]] = Node(child.label[:k])
                child.label = child.label[k:]
                upper.children[child.label[0]] = child
                child = upper
            node, at = child, at + len(child.label)
        return node

    def terminals(self) -> Iterator[tuple[bytes, Any]]:
        """(text, value) of every text, depth first."""
        stack = [(self.root, b"")]
        while stack:
            node, before = stack.pop()
            text = before + node.label
            if node.value is not None:
                yield text, node.value
            stack.extend((child, text) for child in node.children.values())

    def values(self) -> Iterator[Any]:
        stack = [self.root]
        while stack:
            node = stack.pop()
            if node.value is not None:
                yield node.value
            stack.extend(node.children.values())
