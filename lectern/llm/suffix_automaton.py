"""The suffix automaton of a sequence of numbers. A helper of license scans and run detection, for sequences that a task holds."""

from __future__ import annotations


def automaton(words: list[int]) -> tuple[list[int], list[int], list[int], list[dict[int, int]]]:
    """Length and suffix link of each state, the state of each prefix, and the transitions of each state."""
    length, link, following, prefix, last = [0], [-1], [{}], [], 0
    for i, c in enumerate(words):
        now, p = len(length), last
        length.append(i + 1)
        following.append({})
        while p >= 0 and c not in following[p]:
            following[p][c] = now
            p = link[p]
        if p < 0:
            link.append(0)
        else:
            q = following[p][c]
            if length[q] == length[p] + 1:
                link.append(q)
            else:
                link.append(now + 1)
                length.append(length[p] + 1)
                following.append(following[q].copy())
                link.append(link[q])
                while p >= 0 and following[p].get(c) == q:
                    following[p][c] = now + 1
                    p = link[p]
                link[q] = now + 1
        prefix.append(now)
        last = now
    return length, link, prefix, following
