"""Tries and the generalised Levenshtein automata that walk them.

An automaton state is (position in the query, cost so far, edits in reserve); it
walks down a trie of words and never leaves the bound, so that every word
within the bound is found and subtrees beyond it are never entered.
"""

from __future__ import annotations


class Trie:
    """A set of words, each with a payload."""

    __slots__ = ("root",)

    def __init__(self, words=()):
        self.root: dict = {}
        for w in words:
            self.add(w, w)

    def add(self, word: str, payload) -> None:
        node = self.root
        for ch in word:
            node = node.setdefault(ch, {})
        node.setdefault("", []).append(payload)


def within(trie: Trie, query: str, bound: int, limits: tuple[tuple[int, int], ...] = ()) -> dict:
    """{payload: distance} of the words within `bound` edits (insert, delete, change, swap of neighbours).

    The automaton's states are sets of query positions, one set for each number of edits,
    kept as the bits of integers, and a set of swaps half read: one step takes a handful
    of operations. Where no edit is left the rest of the query is followed as it is.

    limits: (edits, more) for the depths from 0 on, as far as there are fewer edits than the bound: so many
    may lie in the letters read, and with insertions just behind them up to `more`. The distance
    is the least of the ways that keep to the limits.
    """
    n = len(query)
    full = (2 << n) - 1
    goal = 1 << n
    match: dict[str, int] = {}
    for i, ch in enumerate(query):
        match[ch] = match.get(ch, 0) | 2 << i
    most = limits[0][1] if limits else bound
    out: dict = {}
    stack = [(trie.root, [(2 << k) - 1 & full if k <= most else 0 for k in range(bound + 1)], [0] * bound, 1)]
    while stack:
        node, states, swaps, depth = stack.pop()
        limit = limits[depth] if depth < len(limits) else None
        children = node.items()
        if limit and not any(swaps) and not any(states[: limit[0]]):
            # no edit is left for this letter; behind it a swap may begin
            r, ahead, chars = states[limit[0]], limit[1] > limit[0], {""}
            while r:
                i = (r & -r).bit_length() - 1
                r &= r - 1
                chars.update(query[i : i + 1 + ahead])
            children = [(ch, node[ch]) for ch in chars if ch in node]
        for ch, child in children:
            if ch == "":
                for k, r in enumerate(states):
                    if r & goal:
                        for payload in child:
                            if k < out.get(payload, bound + 1):
                                out[payload] = k
                        break
                continue
            m = match.get(ch, 0)
            ahead = m >> 2
            before = states[0]
            r = before << 1 & m
            new, half, left = [r], [], 0
            for k in range(1, bound + 1):
                here = states[k]
                half.append(before & ahead)
                left |= r | before & ahead
                r = (here << 1 & m | before | (before | r) << 1 | (swaps[k - 1] << 1 & m) << 1) & full
                new.append(r)
                before = here
            if limit:
                for k in range(limit[0] + 1, bound + 1):
                    new[k] = new[k - 1] << 1 & full if k <= limit[1] else 0
                half[limit[1] :] = [0] * (bound - limit[1])
                left, r = any(new[:-1]) or any(half), new[-1]
            if left:
                stack.append((child, new, half, depth + 1))
            while r and not left:
                # no edit is left
                i = (r & -r).bit_length() - 1
                r &= r - 1
                end = child
                while i < n and end:
                    end = end.get(query[i])
                    i += 1
                for payload in end.get("", ()) if end else ():
                    out.setdefault(payload, bound)
    return out


def weighted(trie: Trie, query: str, confusions: dict[str, list[str]], bound: int, edit: int = 2) -> dict:
    """{payload: cost} of the words reachable from the query within `bound`.

    A confusion (a string seen for a true string) costs 1, any other edit `edit`.
    """
    out: dict = {}
    n = len(query)
    seen: dict[tuple[int, int], int] = {}
    stack = [(trie.root, 0, 0)]
    while stack:
        node, i, cost = stack.pop()
        if seen.get((id(node), i), bound + 1) <= cost:
            continue
        seen[id(node), i] = cost
        if i == n and "" in node:
            for payload in node[""]:
                if cost < out.get(payload, bound + 1):
                    out[payload] = cost
        if i < n and (child := node.get(query[i])) is not None:
            stack.append((child, i + 1, cost))
        if cost + 1 <= bound and i < n:
            for k in (1, 2, 3):
                for true in confusions.get(query[i : i + k], ()) if i + k <= n else ():
                    at = node
                    for ch in true:
                        at = at.get(ch)
                        if at is None:
                            break
                    else:
                        stack.append((at, i + k, cost + 1))
        if cost + edit <= bound:
            if i < n:
                stack.append((node, i + 1, cost + edit))
            for ch, child in node.items():
                if ch:
                    stack.append((child, i, cost + edit))
                    if i < n and ch != query[i]:
                        stack.append((child, i + 1, cost + edit))
    return out
