import itertools
import random

import pytest

from quiltomics.llm.chat import INSERT, MERGE, RELABEL, ROLES, repair

SCHEMA = "conv_id long, turn long, role string, text string, action string, position int"


def least_cost(roles):
    """Cheapest repair by trying every relabelling and keeping or merging equal neighbours."""
    best = None
    for choice in itertools.product(ROLES, repeat=len(roles)):
        cost = sum(RELABEL for a, b in zip(roles, choice) if a != b)
        if any(c == "system" and p != "system" for p, c in zip(choice, choice[1:])):
            continue
        state = None
        for name in choice:
            if name == state:
                # An equal neighbour is merged, or an empty turn of the other side is put between.
                cost += MERGE if name == "system" else min(MERGE, INSERT)
            elif name == "assistant" and state != "user":
                cost += INSERT
            state = name
        cost += {"user": INSERT, "system": 2 * INSERT}.get(state, 0)
        best = cost if best is None else min(best, cost)
    return best


def cost_of(rows, roles):
    cost = 0
    for row in rows:
        cost += INSERT if row.action == "insert" else MERGE if row.action == "merge" else 0
        if row.action != "insert" and roles[row.turn] != row.role:
            cost += RELABEL
    return cost


def legal(rows):
    opened = [r.role for r in rows if r.action != "merge"]
    if opened[:1] == ["system"]:
        opened = opened[1:]
    assert opened and len(opened) % 2 == 0 and opened == ["user", "assistant"] * (len(opened) // 2)


@pytest.mark.parametrize("stretch", [2, 512])
def test_repairs_are_legal_and_cheapest(spark, stretch):
    rng = random.Random(stretch)
    conversations = {c: [rng.choice([*ROLES, "user", "assistant", None, "bot"]) for _ in range(rng.randrange(1, 8))] for c in range(60)}
    data = [(c, t, r, f"text {c}.{t}" if t else None, "x", 1) for c, roles in conversations.items() for t, r in enumerate(roles)]
    rng.shuffle(data)
    rows = repair(spark.createDataFrame(data, SCHEMA), stretch).collect()
    for conv, roles in conversations.items():
        own = sorted((r for r in rows if r.conv_id == conv), key=lambda r: r.position)
        legal(own)
        assert [r.turn for r in own if r.action != "insert"] == list(range(len(roles)))
        assert cost_of(own, roles) == least_cost(roles)
        shown = "".join(r.rendered for r in own)
        assert all(f"text {conv}.{t}" in shown for t in range(1, len(roles)))
        for row in own:
            head = "\n" if row.action == "merge" else f"<|{row.role}|>\n"
            assert row.rendered == head + ("" if row.action == "insert" or not row.turn else f"text {conv}.{row.turn}")


def test_long_conversation_nulls_repeats_and_empty(spark):
    turns = [(1, t, ROLES[1 + t % 2], "x", "", 0) for t in range(3000)]
    odd = [(None, None, "user", "a", "", 0), (None, 4, None, None, "", 0), (2, 0, "user", "same", "", 0), (2, 0, "user", "same", "", 0)]
    rows = repair(spark.createDataFrame(turns + odd, SCHEMA), 64).collect()
    assert [r.action for r in rows if r.conv_id == 1] == ["keep"] * 3000
    for conv in (None, 2):
        legal(sorted((r for r in rows if r.conv_id == conv), key=lambda r: r.position))
    assert repair(spark.createDataFrame([], SCHEMA)).count() == 0
