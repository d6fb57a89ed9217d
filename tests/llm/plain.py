"""Plain versions shared by tests."""

from __future__ import annotations


def plain_components(nodes, linked):
    """Smallest node reachable, by repeated sweeps."""
    component = {node: node for node in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            low = min(component[a], component[b])
            changed |= component[a] != low or component[b] != low
            component[a] = component[b] = low
    return component
