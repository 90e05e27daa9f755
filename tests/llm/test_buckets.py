"""Bucket identifiers of suffixes, and what becomes of the result without their refinement."""

import random
from collections import Counter

import numpy as np

from podium.llm import runs, suffix_dedup


def _text(draw, size):
    return "".join(draw.choices("abcdefghijklmnopqrstuvwxyz ", k=size))


def _docs():
    """Texts that share passages longer and shorter than a window, at many distances, and texts of one letter."""
    draw = random.Random(4)
    long, short = [_text(draw, 330) for _ in range(3)], [_text(draw, 190) for _ in range(12)]
    rows = [_text(draw, 700) + p + _text(draw, 50 + i) for i, p in enumerate([*long, *long, *short, *short])]
    return list(enumerate([*rows, "a" * 200, "a" * 211, "b" * 199, "", None]))


def _removed(rows):
    data = {i: (t or "").encode() for i, t in rows}
    seen = Counter(b[i : i + 200] for b in data.values() for i in range(len(b) - 199))
    out = {}
    for k, b in data.items():
        gone = np.zeros(len(b), dtype=bool)
        for i in range(len(b) - 199):
            if seen[b[i : i + 200]] > 1:
                gone[i : i + 200] = True
        out[k] = int(gone.sum())
    return out


def test_refinement_decides(spark):
    rows = _docs()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    expected = _removed(rows)
    assert 0 < sum(map(bool, expected.values())) < 10

    def found(**options):
        out = runs.dedup(docs, suffix_dedup.shape(**options), sketched=False)
        return {r.doc_id: r.n_removed for r in out.collect()}

    assert found() == expected
    # identifiers that no later offset refines stay those of 50 bytes: shorter passages are taken for repeats
    unrefined = found(pair=lambda ids, later: ids)
    assert sum(unrefined[k] > n for k, n in expected.items()) >= 12


def test_identifiers_follow_bytes():
    draw = random.Random(5)
    data = np.frombuffer((_text(draw, 400) * 2 + "a" * 500).encode(), dtype=np.uint8)
    text = suffix_dedup.shape().text(np.array([0, len(data)]), data)
    names = {}
    for size in (50, 60, 100, 185, 200, 275, 351):
        at = np.arange(len(data) - size)
        for half in (0, 1):
            name = text.name(at, at + size, half)
            names.setdefault(half, set()).update(name.tolist())
            of = {}
            for i, x in zip(at.tolist(), name.tolist(), strict=True):
                of.setdefault(x, set()).add(data[i : i + size].tobytes())
            assert all(len(x) == 1 for x in of.values())
            assert len(of) == len({data[i : i + size].tobytes() for i in at.tolist()})
    assert not names[0] & names[1]
