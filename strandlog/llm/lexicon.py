"""A minimal acyclic automaton over words, with the ids of each word as its output, in one file to be memory-mapped.

Equal right languages share a state, so suffixes are stored once. Every arc carries how many words come before those
behind it; the sum along a path is the word's place in byte order, and that place finds its ids.

File (little-endian): magic, then six uint32 counts - states, arcs, words, ids, and two spare - then the arrays
first_arc (states + 1), target (arcs), before (arcs), first_id (words + 1), ids, and the bytes final (states), label (arcs).
"""

from __future__ import annotations

import mmap
import struct
from array import array
from collections.abc import Iterable

MAGIC = b"STRANDLX"
BYTE = [bytes([i]) for i in range(256)]


def compile_lexicon(entries: Iterable[tuple[bytes, tuple[int, ...]]]) -> bytes:
    """The file's bytes for (word, ids) pairs; words are distinct and not empty."""
    entries = sorted(entries)
    known: dict[tuple, int] = {}
    states: list[tuple[bool, tuple[tuple[int, int], ...], int]] = []  # final, (label, target)s, words behind
    open_states: list[tuple[list[bool], list[tuple[int, int]], int]] = [([False], [], -1)]

    def close(depth: int) -> int:
        """Turn the open states deeper than depth into stored ones, equal ones into one."""
        target = -1
        while len(open_states) > depth:
            final, arcs, label = open_states.pop()
            key = (final[0], tuple(arcs))
            if key not in known:
                known[key] = len(states)
                states.append((*key, final[0] + sum(states[t][2] for _, t in arcs)))
            target = known[key]
            if open_states:
                open_states[-1][1].append((label, target))
        return target

    last = b""
    for word, _ in entries:
        same = next((i for i, (x, y) in enumerate(zip(word, last)) if x != y), min(len(word), len(last)))
        close(same + 1)
        for byte in word[same:]:
            open_states.append(([False], [], byte))
        open_states[-1][0][0] = True
        last = word
    root = close(0)
    order = [root, *(i for i in range(len(states)) if i != root)]
    place = {old: new for new, old in enumerate(order)}
    first_arc, target, before, first_id, ids = (array("I") for _ in range(5))
    final, label = bytearray(), bytearray()
    for old in order:
        is_final, arcs, _ = states[old]
        first_arc.append(len(target))
        final.append(is_final)
        seen = int(is_final)
        for byte, to in arcs:
            label.append(byte)
            target.append(place[to])
            before.append(seen)
            seen += states[to][2]
    first_arc.append(len(target))
    for _, out in entries:
        first_id.append(len(ids))
        ids.extend(out)
    first_id.append(len(ids))
    head = MAGIC + struct.pack("<6I", len(order), len(target), len(entries), len(ids), 0, 0)
    return head + b"".join(x.tobytes() for x in (first_arc, target, before, first_id, ids)) + bytes(final) + bytes(label)


class Lexicon:
    """A compiled file, memory-mapped: looking a word up touches its path only."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as file:
            self.map = mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ)
        if self.map[:8] != MAGIC:
            raise ValueError(f"{path} is no compiled lexicon")
        self.states, arcs, self.words, n_ids, _, _ = struct.unpack_from("<6I", self.map, 8)
        view, at, parts = memoryview(self.map), 32, []
        for n in (self.states + 1, arcs, arcs, self.words + 1, n_ids):
            parts.append(view[at : at + 4 * n].cast("I"))
            at += 4 * n
        self.first_arc, self.target, self.before, self.first_id, self.ids = parts
        self.final, self.labels = view[at : at + self.states], at + self.states

    def get(self, word: bytes) -> tuple[int, ...] | None:
        state = place = 0
        find, first, shift = self.map.find, self.first_arc, self.labels
        for byte in word:
            arc = find(BYTE[byte], first[state] + shift, first[state + 1] + shift) - shift
            if arc < 0:
                return None
            place += self.before[arc]
            state = self.target[arc]
        if not self.final[state]:
            return None
        return tuple(self.ids[self.first_id[place] : self.first_id[place + 1]])
