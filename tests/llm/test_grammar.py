"""The composed toxicity grammar against every path of its five transducers."""

import random

import numpy as np
import pytest

from quiltomics.llm import toxicity as T

WORDS = {"idiot": 4.0, "kill": 3.0, "scum": 5.0, "you": 0, "he": 0, "not": 0, "said": 0, '"': 0, "plain": 0, "fine": 0}


def paths(symbols):
    """Weights of all accepted paths: (place of the match, product of the arcs' weights on it)."""
    found = []

    def walk(place, near, denied, told, insult, threat, taken):
        if place == len(symbols):
            states = {insult, threat}
            if taken is not None and T.DONE in states and states <= {T.DONE, T.START}:
                found.append(taken)
            return
        for a, passed, _ in T.target_arcs(near, symbols[place]):
            for b, _, no in T.negation_arcs(denied, symbols[place]):
                for c, _, cited in T.report_arcs(told, symbols[place]):
                    for i, _, w in T.insult_arcs(insult, passed):
                        for t, _, v in T.threat_arcs(threat, passed):
                            new = (insult == T.START != i) + (threat == T.START != t)
                            if new > 1 or (new and taken is not None):
                                continue  # a path takes one match
                            weight = w if insult == T.START != i else v
                            walk(place + 1, a, b, c, i, t, (place, weight * no * cited) if new else taken)

    walk(0, 0, 0, 0, T.START, T.START, None)
    return found


@pytest.mark.parametrize("seed", range(6))
def test_clauses_equal_the_best_path(seed):
    rng = random.Random(seed)
    model = T.ToxicityModel({w: v for w, v in WORDS.items() if v}, {}, np.array([1.0, 0, 0, 0]))
    for _ in range(60):
        clauses = [[rng.choice(list(WORDS)) for _ in range(rng.randrange(1, 8))] for _ in range(3)]
        want = []
        for words in clauses:
            read = [model.symbol(w) for w in words]
            scores = [read[place][1] * weight for place, weight in paths([s for s, _ in read])]
            want += [max(scores)] if scores else []
        assert model.clauses(". ".join(" ".join(words) for words in clauses)) == pytest.approx(want)


def test_threats_need_a_target_and_clauses_end():
    model = T.ToxicityModel({"idiot": 4.0, "kill": 4.0}, {}, np.array([1.0, 0, 0, 0]))
    assert model.clauses("kill time") == [2.0] and model.clauses("kill you") == [6.0] == model.clauses("you will kill")
    assert model.clauses("what an idiot") == [4.0]
    # Somebody addressed in the next clause is not the target of this one.
    assert model.clauses("an idiot. you went home") == [4.0]
    assert model.clauses("idiot one two you") == [6.0] and model.clauses("idiot one two three you") == [4.0]
    assert model.clauses("not an idiot you") == pytest.approx([6.0 * 0.4])
