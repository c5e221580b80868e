"""Small trees by rule, for queries that show what scoring makes of given node tables; the SQL walks the same nodes by joins."""

from __future__ import annotations

from gridlens.config import SIGNALS

TREES, LEVELS, LABELS = 12, 3, 10
SAMPLE, OFFSET = 256, -0.5
#: Borders of each signal, in the order of the signals.
BORDERS = {"voltage": (205.0, 215.5, 228.0, 240.25), "current": (1.5, 4.0, 7.75, 12.0), "power": (300.0, 900.0, 1700.0, 2600.0)}


def nodes() -> list[tuple]:
    """Rows (tree, node, feature, border, below, above, length, gain, weights); a leaf leads to itself.

    Tree ``t`` is full down to ``LEVELS``, but for the upper child of the root of every third one, which is a leaf.
    """
    out = []
    for tree in range(TREES):
        for node in range(2 ** (LEVELS + 1) - 1):
            level = (node + 1).bit_length() - 1
            cut = tree % 3 == 0
            if cut and node in (5, 6, 11, 12, 13, 14):
                continue
            leaf = level == LEVELS or (cut and node == 2)
            feature = (tree + 2 * level + node) % len(SIGNALS)
            border = BORDERS[SIGNALS[feature]][(tree + node) % 4]
            weights = [(7 * tree + 3 * node + 5 * k + node * k) % 11 + 1 for k in range(LABELS)]
            below, above = (node, node) if leaf else (2 * node + 1, 2 * node + 2)
            length = level + (tree + node) % 5 / 4 if leaf else 0.0
            out.append((tree, node, 0 if leaf else feature, float("inf") if leaf else border, below, above, length, 0.0 if leaf else float(tree + node + 1), weights))
    return out
