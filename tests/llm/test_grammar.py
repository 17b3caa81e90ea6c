from itertools import product

import pytest

from knotwork.llm import toxicity

MODEL = {"words": {"fool": 4.0}, "stems": {}, "offsets": toxicity.OFFSETS, "calibration": [1.0, 0.5, -2.0, -4.0]}


def test_target_after_the_hit_counts():
    s = toxicity.Scorer(MODEL)
    assert s.features("I will kill you")[::2] == (2.0, "aimed") and s.features("I will kill")[::2] == (0.5, "plain")
    assert s.features("a fool you are")[0] == s.features("you are a fool")[0] == 4.5 > s.features("a fool. you are")[0]
    assert s.features("a fool, not you")[::2] == (4.5, "aimed") and s.features("not a fool, you")[::2] == (2.0, "negated")


def test_composition_against_rules():
    """All class sequences of up to five words, scored by the rules written out."""
    g, o = toxicity.grammar(toxicity.OFFSETS), toxicity.OFFSETS
    for n in range(6):
        for kinds in product((None, "target", "negation", "report", "threat", ("insult", 40)), repeat=n):
            cost, scopes = 0.0, []
            for i, k in enumerate(kinds):
                if k == "threat" or isinstance(k, tuple):
                    turns = [x for x in kinds[:i] if x in ("negation", "report")]
                    before, after = "target" in kinds[:i], "target" in kinds[i:]
                    scope = {"negation": "negated", "report": "reported"}[turns[-1]] if turns else "aimed" if before or after else "plain"
                    worth = 4.0 if k != "threat" else 2.0 if turns or before else 1.5 if after else 0.5
                    cost -= max(0.0, worth + o[scope])
                    scopes.append(scope)
            found, outs = g.shortest(kinds)
            assert found == pytest.approx(cost)
            assert [x for x, k in zip(outs, kinds, strict=True) if k == "threat" or isinstance(k, tuple)] == scopes
