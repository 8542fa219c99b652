"""The arcs of the piece transducer against their definition, and how many pieces are looked up for them."""

import random

from tripweave.llm.pieces import FALLBACK, MARK, MODEL, Transducer


class Counting(dict):
    asked = 0

    def get(self, key, default=None):
        self.asked += 1
        return super().get(key, default)

    def __contains__(self, key):
        self.asked += 1
        return super().__contains__(key)


def machine():
    with open(MODEL, "rb") as f:
        return Transducer(f.read())


def test_arcs_are_all_pieces_from_a_place_on():
    m, pick = machine(), random.Random(5)
    pieces = sorted(m.ids)
    for _ in range(300):
        part = MARK + "".join(pick.choice(pieces) for _ in range(3)) + pick.choice(["", "q", "Ж", "\U0001f600"])
        for at in range(len(part)):
            found = [(end, m.ids[part[at:end]]) for end in range(at + 1, len(part) + 1) if part[at:end] in m.ids]
            assert m._arcs(part, at) == (found if part[at] in m.ids else [(at + 1, FALLBACK), *found])


def test_no_piece_is_looked_up_that_cannot_be():
    m = machine()
    pair = next(a + b for a in "qxzjkw" for b in "xqzjwk" if not any(p.startswith(a + b) for p in m.ids))
    m.ids = Counting(m.ids)
    m._arcs(pair * 20, 0)
    assert m.ids.asked <= 2


def test_a_part_is_composed_once():
    m, asked, real = machine(), [], Transducer.best_path
    m.best_path = lambda part: asked.append(part) or real(m, part)
    first = m.encode("one two one two three")
    assert m.encode("three one two one two") != first and m.encode("one two one two three") == first
    assert len(asked) == len(set(asked)) == 3
