import random
from types import SimpleNamespace

import ahocorasick
import numpy as np
import pandas as pd

from shelfmark.llm import phrase_dedup, suffix_dedup, windows


def segment(anchor, seg, doc, body, size, copy=0):
    return {"anchor": anchor, "seg": seg, "doc": doc, "tid": 0, "span": size << 1, "copy": copy, "body": body}


def marked(done):
    return {(a, s, c, o) for a, s, c, low, high in zip(*(done[k] for k in ("anchor", "seg", "copy", "low", "high")), strict=True) for o in range(low, high)}


def test_recurring_windows_are_compiled_as_whole_passages(monkeypatch):
    """The automaton of a shard grows with the text that recurs, not with a window's length times as much; passages that end, cross or repeat stay exact."""
    r = random.Random(3)
    make = lambda n: [f"w{r.randrange(10_000)}" for _ in range(n)]
    shared, other = make(120), make(60)
    texts = [shared, make(5) + shared, shared[10:90] + make(30), make(20) + shared[40:] + make(9), other + shared[:70], other, ["a"] * 130, ["a"] * 80, ["b", "c"] * 50, ["c", "b"] * 40, make(100)]
    texts += [shared[:60] + other[:55]] * 2
    pdf = pd.DataFrame([segment(7, k, k // 2 if k < 2 else k, " ".join(t).encode(), len(t) - 49) for k, t in enumerate(texts)])
    added = []

    class Counted:
        def __init__(self):
            machine = ahocorasick.Automaton()
            self.make_automaton, self.iter = machine.make_automaton, machine.iter
            self.add_word = lambda word, value: added.append(len(word)) or machine.add_word(word, value)

    monkeypatch.setattr(phrase_dedup, "ahocorasick", SimpleNamespace(Automaton=Counted))
    first, want = {}, set()
    for k, doc in enumerate(pdf["doc"]):
        for o in range(len(texts[k]) - 49):
            if first.setdefault(tuple(texts[k][o : o + 50]), doc) < doc:
                want.add((7, k, 0, o))
    assert marked(phrase_dedup._marker(50)(pdf)) == want and len(want) > 150
    assert sum(added) < 1_500  # each window by itself: 50 words for each of more than 90


def test_suffixes_are_ranked_once_and_within_their_segments(monkeypatch):
    """Starts of full factors are those that the factors themselves give; a shard sorts less than half of six times its bytes."""
    r = random.Random(4)
    make = lambda n, of="abcdefgh é": "".join(r.choices(of, k=n)).encode()[:n]
    bodies = [make(160) for _ in range(30)] + [b"a" * 160, b"ab" * 80, make(160, "ab")]
    bodies += [bodies[3][20:] + make(20), make(30) + bodies[4][:130], bodies[5][:99] + make(61), bodies[30][:110] + make(50)]
    pdf = windows._copies(pd.DataFrame([segment(k % 5, k, k, b, 61) | {"two": k % 2 == 0, "last_doc": 100 + k, "last_tid": 0, "last_span": 61 << 1} for k, b in enumerate(bodies)]).drop(columns="copy"))
    seen, want = set(), set()
    for x in pdf.sort_values(["doc"]).itertuples():
        for o in range(61):
            if x.body[o : o + 100] in seen:
                want.add((x.anchor, x.seg, x.copy, o))
            seen.add(x.body[o : o + 100])
    given = []
    dense = suffix_dedup._dense
    monkeypatch.setattr(suffix_dedup, "_dense", lambda key, most: given.append(len(key)) or dense(key, most))
    assert marked(suffix_dedup._marker(100)(pdf)) == want and len(want) > 1_200
    assert sum(given) < 3 * pdf["body"].str.len().sum()


def test_full_factors_are_found_without_measuring_shorter_ones():
    r = np.random.default_rng(5)
    for letters in (1, 2, 256):
        data = r.integers(0, letters, size=600).astype(np.uint8)
        data[400:520] = data[100:220]
        for length in (1, 3, 40):
            starts = np.arange(len(data) - length + 1)
            want = np.flatnonzero(suffix_dedup.longest_previous_factors(data, starts, length) >= length)
            assert suffix_dedup.repeated_starts(data, len(data) - np.arange(len(data)), starts, length).tolist() == want.tolist()
