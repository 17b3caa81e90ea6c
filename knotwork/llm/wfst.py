"""A small weighted finite-state transducer over the tropical semiring."""

from __future__ import annotations

from collections.abc import Hashable, Iterable


class Wfst:
    """States are any hashable values; arcs are (label in, label out, weight, next state).

    Weights add along a path and the least sum wins. ``None`` as the label in matches any
    label that has no arc of its own from that state.
    """

    def __init__(self, start: Hashable):
        self.start = start
        self.arcs: dict[Hashable, dict[Hashable, list[tuple]]] = {}
        self.final: dict[Hashable, float] = {}

    def arc(self, state, label, out, weight: float, to) -> Wfst:
        self.arcs.setdefault(state, {}).setdefault(label, []).append((out, weight, to))
        return self

    def end(self, state, weight: float = 0.0) -> Wfst:
        self.final[state] = weight
        return self

    def compose(self, other: Wfst) -> Wfst:
        """The transducer that feeds this one's output into ``other``; both without empty labels."""
        out = Wfst((self.start, other.start))
        todo, seen = [out.start], {out.start}
        while todo:
            s, t = state = todo.pop()
            for label, arcs in self.arcs.get(s, {}).items():
                for middle, w, to in arcs:
                    theirs = other.arcs.get(t, {})
                    for last, v, then in theirs.get(middle, theirs.get(None, [])):
                        out.arc(state, label, last, w + v, (to, then))
                        if (to, then) not in seen:
                            seen.add((to, then))
                            todo.append((to, then))
            if s in self.final and t in other.final:
                out.end(state, self.final[s] + other.final[t])
        return out

    def shortest(self, labels: Iterable) -> tuple[float, list] | None:
        """Least weight of a path that reads ``labels``, and its outputs; None if there is none."""
        reached = {self.start: (0.0, None)}
        for label in labels:
            now: dict = {}
            for state, (cost, trail) in reached.items():
                arcs = self.arcs.get(state, {})
                for out, weight, to in arcs.get(label, arcs.get(None, ())):
                    if to not in now or cost + weight < now[to][0]:
                        now[to] = (cost + weight, (out, trail))
            reached = now
        ends = [(cost + self.final[s], trail) for s, (cost, trail) in reached.items() if s in self.final]
        if not ends:
            return None
        cost, trail = min(ends, key=lambda x: x[0])
        outs = []
        while trail is not None:
            outs.append(trail[0])
            trail = trail[1]
        return cost, outs[::-1]
