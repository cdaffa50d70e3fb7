"""The composed transducers against their parts, run one by one, and clauses in context."""

from __future__ import annotations

import itertools
import math

import pytest

from quillsieve.llm import toxicity as tx


def alone(parts, symbols):
    """Weights and outputs of each part by place, from the parts alone."""
    out = []
    for part in parts:
        state, found = part.start, []
        for s in symbols:
            state, weight, output = part.step(state, s)
            found.append((weight, output))
        out.append(found)
    return list(zip(*out))


@pytest.mark.parametrize("alphabet, length", [("IHTNRVQELo", 4), ("IHTo", 6), ("IHNQL", 5)])
def test_composition_is_its_parts(alphabet, length):
    for n in range(1, length + 1):
        for symbols in itertools.product(alphabet, repeat=n):
            back = alone(tx.FROM_RIGHT, symbols[::-1])[::-1]
            names = [next((o for _, o in step if o), s) for s, step in zip(symbols, back)]
            assert tx.renamed(tx.Machine.right, list(symbols)) == names
            state = 0
            for name, step in zip(names, alone(tx.FROM_LEFT, names)):
                state, weight, outputs = tx.Machine.left[state][name]
                assert weight == pytest.approx(math.prod(w for w, _ in step))
                assert outputs == {o for _, o in step if o}


def by_rule(symbols: str) -> dict[str, float]:
    """Summed weights by kind, from the rules in words, place by place."""
    total = dict.fromkeys(tx.FEATURES, 0.0)
    words = [i for i, s in enumerate(symbols) if s in tx.WORDS]
    for at, s in enumerate(symbols):
        if s not in "IH":
            continue
        clause = [i for i in words if not any(c in "EL" for c in symbols[min(i, at) : max(i, at)])]
        here = clause.index(at)
        before, after = clause[:here], clause[here + 1 :]
        near = [symbols[i] for i in before[-tx.TARGET_REACH :] + (after[: tx.TARGET_REACH] if s == "I" else after)]
        if s == "H" and "T" not in near:
            continue
        negated = "N" in [symbols[i] for i in before[-tx.NEGATION_REACH :]]
        line = symbols[symbols.rfind("L", 0, at) + 1 :].split("L")[0]
        quoted = symbols[symbols.rfind("L", 0, at) + 1 : at].count("Q")
        reported = "R" in [symbols[i] for i in before] or (quoted % 2 == 1 and quoted < line.count("Q"))
        boosted = s == "I" and "V" in [c for c in symbols[:at]] and not any(c in "oIEL" for c in symbols[symbols.rfind("V", 0, at) : at])
        weight = (tx.THREAT if s == "H" else 1.0) * (tx.BOOST if boosted else 1.0)
        weight *= tx.AIMED if s == "I" and "T" in near else 1.0
        weight *= (tx.NEGATED if negated else 1.0) * (tx.REPORTED if reported else 1.0)
        kind = "negated" if negated else "reported" if reported else "threat" if s == "H" else "aimed" if "T" in near else "plain"
        total[kind + ("_threat" if s == "H" and kind != "threat" else "")] += weight
    return total


@pytest.mark.parametrize("alphabet, length", [("IHTNRVQELo", 4), ("ITo", 7), ("HTNo", 6), ("IQLo", 7), ("IREo", 6)])
def test_weights_are_those_of_the_rules(alphabet, length):
    words = {"I": "idiot", "H": "kill", "T": "you", "N": "not", "R": "said", "V": "very", "Q": '"', "E": ".", "L": "\n", "o": "thing"}
    machine = tx.Machine({"idiot": 1.0}, {})
    for n in range(1, length + 1):
        for symbols in map("".join, itertools.product(alphabet, repeat=n)):
            if "I" in symbols or "H" in symbols:
                got = machine.features(" ".join(words[s] for s in symbols))
                assert got == pytest.approx([math.log2(1 + w) for w in by_rule(symbols).values()]), symbols


def test_contexts_weigh_and_do_not_silence():
    machine = tx.Machine({"idiot": 1.0}, {})

    def found(text):
        return {f: w for f, w in zip(tx.FEATURES, machine.features(text)) if w}

    assert set(found("I will not hesitate to kill you")) == {"negated_threat"}
    assert set(found("he said I will kill you")) == set(found('"I will kill you"')) == {"reported_threat"}
    assert set(found("we killed you")) == set(found("te mataré")) == {"threat"}
    assert found("not an idiot")["negated"] < found("you are no idiot")["negated"] < found("you idiot")["aimed"]
    assert set(found('5" wide, what an idiot')) == {"plain"}  # a mark that nothing closes
    assert found("idiot " * 8)["plain"] < found("idiot " * 800)["plain"]


def test_threats_are_learned(spark):
    rows = [(1, f"i shall gribble you {w}") for w in plain_words(60)] + [(0, f"they gribble the corn {w}") for w in plain_words(60, 100)]
    rows += [(0, f"i shall visit you {w}") for w in plain_words(300, 200)]
    frame = spark.createDataFrame(rows, "label int, text string")
    threats = tx.learn_threats(frame)
    assert set(threats) == {"gribble"}
    machine = tx.Machine(*tx.learn_insults(frame), threats)
    kinds = dict(zip(tx.FEATURES, machine.features("gribble you")))
    assert kinds["threat"] + kinds["aimed"] > 0


def plain_words(n, start=0):
    return ["".join(chr(97 + (start + i) // 26**k % 26) for k in range(4)) + "x" for i in range(n)]


