"""A text normaliser as two sequential transducers, composed with each text.

The speller rewrites spellings, the longest that starts at a place, and passes other characters
through: its states are the nodes of a trie, a node that has no arc for the next character falls
back to the last spelling it went past, writes its form and reads on behind it. The blank machine
has three states when blanks are squeezed (before a word, inside one, blanks held back after one)
and one state when they aren't. Each text has one path through both, so that composing gives one
string of characters, on which the lexicon's search goes on.
"""

from __future__ import annotations

import re
import struct

#: Bits of a unit of the double array in which model files keep their spellings (fixed by the file format).
LEAF, WIDE = 1 << 8, 1 << 9
LABEL = 1 << 31 | 0xFF
VALUE = (1 << 31) - 1


def spellings(packed: bytes) -> dict[str, str]:
    """Spelling -> form from the packed character map of a model file; empty for the identity."""
    if not packed:
        return {}
    import numpy as np

    (size,) = struct.unpack_from("<I", packed)
    units, forms = np.frombuffer(packed, "<u4", size // 4, 4).astype(np.int64), packed[4 + size :]
    step = lambda unit: (unit >> 10) << ((unit & WIDE) >> 6)
    letters, found = np.arange(1, 256), {}
    todo = [(b"", int(step(units[0])))]
    while todo:
        read, at = todo.pop()
        places = at ^ letters
        inside = places < len(units)
        for letter in letters[inside][units[places[inside]] & LABEL == letters[inside]].tolist():
            unit = int(units[at ^ letter])
            below = at ^ letter ^ step(unit)
            if unit & LEAF:
                begin = int(units[below]) & VALUE
                found[(read + bytes([letter])).decode()] = forms[begin : forms.index(b"\0", begin)].decode()
            todo.append((read + bytes([letter]), below))
    return found

#: What is dropped at the end of a squeezed text, blank marks of the text itself included.
MARKED = " ▁"


class Normaliser:
    def __init__(self, rules: dict[str, str], squeeze: bool):
        self.squeeze, self.trie = squeeze, {}
        for spelling, form in rules.items():
            node = self.trie
            for c in spelling:
                node = node.setdefault(c, {})
            node[""] = form
        #: Where the speller can leave its first state for good: all else it passes through unseen.
        alone = {s for s in rules if len(s) == 1}
        heads, seconds = {s[0] for s in rules if len(s) > 1} - alone, {s[1] for s in rules if len(s) > 1}
        some = lambda chars: "[" + "".join(map(re.escape, sorted(chars))) + "]"
        parts = ([some(alone)] if alone else []) + ([f"{some(heads)}(?={some(seconds)})"] if heads else [])
        self.starts = re.compile("|".join(parts)) if parts else None

    def spell(self, text: str) -> str:
        out, at, search = [], 0, self.starts.search
        while (m := search(text, at)) is not None:
            begin = m.start()
            out.append(text[at:begin])
            node, form, at = self.trie, text[begin], begin + 1
            for end in range(begin, len(text)):
                node = node.get(text[end])
                if node is None:
                    break
                if "" in node:
                    form, at = node[""], end + 1
            out.append(form)
        out.append(text[at:])
        return "".join(out)

    def blanks(self, text: str) -> str:
        """The blank machine over runs: leading and trailing runs write nothing, others one blank."""
        out, state = [], "before"
        for run in re.findall(" +|[^ ]+", text):
            if run[0] != " ":
                out.append(" " + run if state == "held" else run)
                state = "inside"
            elif state == "inside":
                state = "held"
        return "".join(out)

    def __call__(self, text: str) -> str:
        if self.starts is not None:
            text = self.spell(text)
        return self.blanks(text).rstrip(MARKED) if self.squeeze else text
