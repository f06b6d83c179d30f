"""Personal data that the patterns miss, planted beside numbers that are none; statistics of training against loops; messages against full rounds."""

import random
from collections import Counter

import numpy as np

from siltflow.llm import pii

WORDS = "the of report order page and we met in about with customer said after line note".split()


def card(rng):
    digits = "4" + "".join(str(rng.randrange(10)) for _ in range(14))
    return next(digits + str(c) for c in range(10) if pii.luhn(digits + str(c)))


def noise(rng):
    """A number that is no personal data."""
    return rng.choice([
        f"in {rng.randrange(1950, 2024)}", f"cost {rng.randrange(1, 999)}.{rng.randrange(10, 99)}", f"order {rng.randrange(10**7, 10**8)}",
        f"on 2024-0{rng.randrange(1, 9)}-1{rng.randrange(9)}", f"part A{rng.randrange(100, 999)}-{rng.randrange(10, 99)}", f"{rng.randrange(2, 90)} pages",
        f"id {rng.choice([n for n in (str(rng.randrange(10**15, 10**16)) for _ in range(40)) if not pii.luhn(n)])}", f"v{rng.randrange(9)}.{rng.randrange(9)}.{rng.randrange(20)}",
    ])


def plant(rng):
    """(text, spans that the patterns miss): a phone number without its plus, a card before another number, each after a form that is found."""
    say = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    kind = rng.randrange(5)
    area, line, n, c = rng.randrange(200, 999), f"{rng.randrange(200, 999)}-{rng.randrange(1000, 9999)}", rng.randrange(10**6, 10**7), card(rng)
    first, second, missed = [
        (f"+1 ({area}) {line}", f"({area}) {line}", (4, f"({area}) {line}")),
        (c, f"{c} {rng.randrange(10, 9999)}", (3, c)),
        (f"+44 20 {n}", f"020 {n}", (4, str(n))),
        (f"a.{rng.choice(WORDS)}@x{rng.randrange(99)}.com", "", None),
        (".".join(str(rng.randrange(256)) for _ in range(4)), f"and {area} and {line[-4:]}", None),
    ][kind]
    again = noise(rng)
    text = f"{say(5)} {noise(rng)}, {again} {say(3)} {first}, {say(rng.randrange(3, 30))} "
    at = len(text)
    text += f"{second}, {say(4)} {again} {noise(rng)}"
    return text, [] if missed is None else [(missed[0] - 1, text.index(missed[1], at), text.index(missed[1], at) + len(missed[1]))]


def test_planted_data_is_found(spark):
    rng = random.Random(11)
    docs = [plant(rng) for _ in range(2000)]
    model = pii.fit(spark.createDataFrame([(t,) for t, _ in docs], "text string"))
    hit = truth = right = added = 0
    for text, want in docs:
        base = pii.base_spans(text)
        more = pii.added_spans(text, base, model)
        meets = lambda x, y: x[0] == y[0] and x[1] < y[2] and y[1] < x[2]
        truth, added = truth + len(want), added + len(more)
        hit += sum(any(meets(w, m) for m in more) for w in want)
        right += sum(any(meets(w, m) for w in want) for m in more)
    print(f"recall {hit}/{truth}, precision {right}/{added}")
    assert truth > 1000 and hit >= 0.97 * truth and right >= 0.97 * added


def test_counts_equal_loops():
    rng = random.Random(2)
    for text in [plant(rng)[0] for _ in range(40)] + ["+1 (743) 555-3824 x 555-3824 or 555-3824", "a1", "none", "7 8, 9", "a@b.co A@B.CO"]:
        f = pii.Field(text, pii.base_spans(text))
        want: Counter = Counter()
        for i, label in enumerate(f.fixed.tolist()):
            twins = [a + b - i for a, b in f.skip if i in (a, b)]
            unknown = lambda v: any((f.fixed[a] > 0) != (f.fixed[b] > 0) and not f.fixed[v] for a, b in f.skip if v in (a, b))
            if unknown(i):
                continue
            sides = []
            for j in (i - 1, i + 1):
                edge = (min(i, j), max(i, j))
                seen = edge in f.chain and not unknown(j)
                sides.append(pii.LABELS * (f.start[edge[1]] - f.end[edge[0]] <= pii.TOUCH) + int(f.fixed[j]) if seen else pii.NOBODY)
            code = (f.shape[i] * 2 + f.firm[i]) * (pii.NOBODY + 1) ** 2 + sides[0] * (pii.NOBODY + 1) + sides[1]
            code = code * (pii.TWINS + 1) ** pii.LABELS + sum((pii.TWINS + 1) ** int(f.fixed[t]) for t in twins if not unknown(t))
            want[code, label] += 1
        assert pii.counts(text) == want


def test_training_fits_its_counts_and_ignores_their_order():
    rng = random.Random(3)
    total: Counter = Counter()
    for _ in range(300):
        total.update(pii.counts(plant(rng)[0]))
    rows = [(c, y, n) for (c, y), n in total.items()]
    one, two = pii.potentials(rows), pii.potentials(rows[::-1])
    assert all(np.array_equal(getattr(one, k), getattr(two, k)) for k in ("shape", "chain", "skip"))
    assert np.allclose(one.chain, one.chain.transpose(0, 2, 1)) and np.allclose(one.skip, one.skip.transpose(0, 2, 1))
    empty = pii.potentials([])
    assert (empty.shape[:, 1:] == -pii.HELD).all() and empty.shape.shape == (pii.SHAPES, pii.LABELS)


def test_messages_that_move_alone_equal_full_rounds():
    rng = np.random.default_rng(4)
    own, edges = rng.normal(size=(40, 5)) * 2, np.array([(i, i + 1) for i in range(39)] + [(0, 20), (5, 33), (12, 30)])
    pair = rng.normal(size=(len(edges), 5, 5))
    assert np.allclose(pii.marginals(own, edges, pair), pii.marginals(own, edges, pair, 500), atol=2e-3)
