"""Double-array tries over bytes, walked for many strings at once."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np


class DoubleArray:
    """``base``/``check`` arrays: node s has a child for byte c at ``base[s] + c`` if ``check`` there is s. ``value`` is -1 where no key ends."""

    def __init__(self, keys: Iterable[tuple[bytes, int]]) -> None:
        root: dict = {}
        for key, value in keys:
            node = root
            for c in key:
                node = node.setdefault(c, {})
            node[-1] = value
        room = 1 << 12
        base, check, value = [0] * room, [-1] * room, [-1] * room
        check[0] = 0
        free, hint, end = 1, 0, 1

        def grow(to: int) -> None:
            while len(base) < to:
                more = len(base)
                base.extend([0] * more)
                check.extend([-1] * more)
                value.extend([-1] * more)

        # wide nodes first find the room they need; single children fill the gaps
        level = [(0, root)]
        while level:
            below = []
            for at, node in sorted(level, key=lambda x: -len(x[1])):
                if -1 in node:
                    value[at] = node[-1]
                wanted = sorted(c for c in node if c >= 0)
                if not wanted:
                    continue
                while check[free] != -1:
                    free += 1
                    grow(free + 300)
                first, slot, tries = wanted[0], max(free, hint if len(wanted) > 1 else 0), 0
                while True:
                    b = slot - first
                    grow(slot + 300)
                    if b >= 1 and check[slot] == -1 and all(check[b + c] == -1 for c in wanted):
                        break
                    # after some misses a node goes behind all others; single children fill the gaps it leaves
                    tries += 1
                    slot = slot + 1 if tries < 64 else max(end, slot + 1)
                if tries >= 64:
                    hint = max(hint, slot - 2048)
                end = max(end, b + wanted[-1] + 1)
                base[at] = b
                for c in wanted:
                    check[b + c] = at
                    below.append((b + c, node[c]))
            level = below
        used = max(i for i, c in enumerate(check) if c != -1) + 300
        grow(used)
        self.base, self.check, self.value = (np.array(x[:used], dtype=np.int32) for x in (base, check, value))

    def step(self, nodes: np.ndarray, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The children for ``symbols``, and whether each exists."""
        to = self.base[nodes] + symbols
        return to, self.check[to] == nodes

    def get(self, key: bytes) -> int:
        at = 0
        for c in key:
            to = self.base[at] + c
            if self.check[to] != at:
                return -1
            at = to
        return int(self.value[at])
