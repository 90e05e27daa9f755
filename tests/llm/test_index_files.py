"""Centroids, ranked search and token files against plain Python, on small tables with every edge case."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

from podium.llm import centroids, id_coder, lexical_search, token_files

CLASH = "data string, score string, first int, shard int, n int, item int"


# -- token files --------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("top", [3, 900, 1 << 16, 1 << 32])
def test_blocks_come_back(top):
    r = np.random.default_rng(top)
    ids = r.zipf(1.3, (7, 700)) % top
    ids[2] = ids[2, 0]
    lengths = np.array([700, 1, 699, 350, 16, 513, 700])
    for row, n in zip(ids, lengths):
        row[n:] = 0
    blocks = id_coder.encode(ids.astype(np.uint32), lengths)
    for row, n, back in zip(ids, lengths, id_coder.decode(blocks)):
        assert back.tolist() == row[:n].tolist()
    # any block alone, and in any company
    assert id_coder.decode(blocks[3:4])[0].tolist() == ids[3, :350].tolist()
    assert len(blocks[2]) < 120  # one id over and over


def test_damage_is_seen():
    ids = np.random.default_rng(0).integers(0, 500, (1, 300)).astype(np.uint32)
    (block,) = id_coder.encode(ids, np.array([300]))
    for at in (2, 5, 9, 40, len(block) - 30):
        bad = bytearray(block)
        bad[at] ^= 0x55
        with pytest.raises(ValueError):
            id_coder.decode([bytes(bad)])


def test_mixture_beats_plain_counts():
    # the same phrase again and again: contexts say what follows, counts alone do not
    phrase = np.random.default_rng(1).permutation(64)
    ids = np.tile(phrase, 32)[None].astype(np.uint32)
    assert len(id_coder.encode(ids, np.array([2048]))[0]) < 2048 * 6 / 8 / 3


def library():
    return Tokenizer.from_file(token_files.vocabulary_path())


def test_units_are_the_librarys():
    r, lib = random.Random(1), library()
    bits = ["a", "b's", "'", "'ll", " ", "  ", "\n", "\t", " \n", "é", "1", "23", ",", "!!", "<|endoftext|>", "Foo"]
    bits += ["\x1c", "\x85", "\xa0", "　", "日本", "don't", "-", "_"]
    texts = ["".join(r.choice(bits) for _ in range(r.randint(0, 30))) for _ in range(3000)]
    units = token_files.Units(token_files.vocabulary_path(), most=50)
    for text, ids, want in zip(texts, units.encode(texts), lib.encode_batch(texts, add_special_tokens=False)):
        assert ids.tolist() == want.ids, text


def test_units_are_cut_where_pieces_end():
    # signs after a word and a line end before one do not make units of their own: the library sees each part once
    units = token_files.Units(token_files.vocabulary_path())
    units.encode(["a the, b the. c the;\nThe d the"])
    assert " the" in units.known and not {" the,", " the.", " the;\nThe"} & units.known.keys()
    texts = ["x.\nY", "x.\n\nY", "x\ny\nz", "a\n b", "é!\u2028 ", "it's'll x'", "a<|endoftext|>b, <|endoftext|", "\x01a,\x02b.\n\x01", "x²,3", ""]
    texts += ["".join(map(chr, range(1, 0x250))) + " the,"]  # no low character is left to mark ends by
    want = [e.ids for e in library().encode_batch(texts, add_special_tokens=False)]
    assert [ids.tolist() for ids in units.encode(texts)] == want


def test_blocks_too_long_are_refused():
    longest = id_coder.LONGEST + 1
    with pytest.raises(ValueError):
        id_coder.encode(np.zeros((1, longest), np.uint32), np.array([longest]))
    with pytest.raises(ValueError):
        id_coder.decode([id_coder.HEAD.pack(id_coder.MAGIC, longest, 0, 0)])


def test_token_files(spark, tmp_path):
    rows = [(9, "the end <|endoftext|> of it"), (3, None), (5, ""), (7, "word " * 900), (7, "word " * 900), (7, "other"),
            (None, "no id"), (1, "ünïcode\n\n  text"), (-4, "long tail, " * 300)]
    docs = spark.createDataFrame([(*r, *[None] * 6) for r in rows], f"doc_id long, text string, {CLASH}")
    path = f"file://{tmp_path}/files"
    token_files.write_ids(docs, path, token_files.vocabulary_path(), block_ids=64, at_once=3)
    found = token_files.digests(spark, path).collect()
    back = {r["start"]: r for r in token_files.read_ids(spark, path).collect()}
    lib, start = library(), 0
    order = lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["start"])
    left = Counter((i, t or "") for i, t in rows)
    for r in sorted(found, key=order):
        ids = back[r["start"]]["ids"]
        assert r["start"] == start and r["n_tokens"] == len(ids) and back[start]["doc_id"] == r["doc_id"]
        assert r["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes()) and ids[-1] == 2
        (text,) = [t for (i, t), n in left.items() if n and i == r["doc_id"] and lib.encode(t, add_special_tokens=False).ids == ids[:-1]]
        left[(r["doc_id"], text)] -= 1
        start += len(ids)
    assert not +left
    empty = f"file://{tmp_path}/none"
    token_files.write_ids(docs.limit(0), empty, token_files.vocabulary_path())
    assert token_files.digests(spark, empty).collect() == []


def test_checksums_join():
    r = random.Random(3)
    for _ in range(50):
        a, b = r.randbytes(r.randint(0, 300)), r.randbytes(r.randint(0, 5000))
        assert token_files._joined((zlib.crc32(a), len(a)), (zlib.crc32(b), len(b))) == (zlib.crc32(a + b), len(a + b))


# -- centroids ----------------------------------------------------------------------------------------------------


def test_search_is_exact():
    r = np.random.default_rng(0)
    x, c = r.integers(-30, 30, (500, 64)), r.integers(-30, 30, (16, 64))
    c[5] = c[3]  # equal centroids: the smaller number
    x[:9] = c[5]
    d = ((x[:, None] - c[None]) ** 2).sum(2)
    for own in (x, x.astype(object), x * (1 << 40)):
        number, distance = centroids.nearest(own, (c * (1 << 40) if own is not x and own.dtype != object else c).tolist())
        assert number.tolist() == d.argmin(1).tolist()
        assert [int(v) for v in distance] == [int(v) * ((1 << 80) if own.dtype != object and own is not x else 1) for v in d.min(1)]


def test_centroids_by_hand(spark):
    r = random.Random(5)
    rows = [(i, [r.uniform(-1, 1) for _ in range(64)]) for i in range(60)]
    odd = [(100, None), (101, [1.0] * 63), (102, [1.0] * 63 + [None]), (103, [float("nan")] * 64), (104, [float("inf")] * 64),
           (None, [0.5] * 64), (7, [0.25] * 64), (105, [])]
    frame = spark.createDataFrame([(*x, *[None] * 6) for x in rows + odd], f"vec_id long, embedding array<double>, {CLASH}")
    found, final = centroids.cluster(frame.repartition(3), k=4)
    import hashlib

    keep = [(i, [math.floor(64 * e) for e in v]) for i, v in rows + [odd[5], odd[6]]]
    name = lambda i: hashlib.sha256(f"1:{i}".encode()).hexdigest()
    cs = [v for _, v in sorted((x for x in keep if x[0] is not None), key=lambda x: (name(x[0]), x[1]))[:4]]
    dist = lambda a, b: sum((p - q) ** 2 for p, q in zip(a, b))
    for _ in range(3):
        near = [min(range(4), key=lambda k: (dist(v, cs[k]), k)) for _, v in keep]
        for k in range(4):
            own = [v for (_, v), n in zip(keep, near) if n == k]
            cs[k] = [sum(e) // len(own) for e in zip(*own)] if own else cs[k]
    assert final == cs
    want = [(i, *min((dist(v, c), k) for k, c in enumerate(cs))[::-1]) for i, v in keep]
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(want, key=repr)


def test_centroids_of_little(spark):
    frame = spark.createDataFrame([(1, [1e300] * 64), (2, [-1e300] * 64), (3, [0.5] * 64)], "vec_id long, embedding array<double>")
    found, final = centroids.cluster(frame)
    assert len(final) == 3 and sorted(r["distance"] for r in found.collect()) == [0, 0, 0]
    one, final = centroids.cluster(frame, k=1)
    assert len(final) == 1 and {r["distance"] for r in one.filter("vec_id < 3").collect()} == {None}
    none, final = centroids.cluster(frame.limit(0))
    assert none.collect() == [] and final == []


# -- ranked search ------------------------------------------------------------------------------------------------

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
FOLD = {c: c + 32 for c in range(65, 91)}


def brute(docs, items, k):
    terms = lambda t: TERM.findall((t or "").translate(FOLD))
    bags = [(i, terms(t)) for i, t in docs]
    bags = [(i, Counter(t), len(t)) for i, t in bags if t]
    n_all, l_all = len(bags), sum(n for _, _, n in bags)
    df = Counter(t for _, bag, _ in bags for t in bag)
    w = {t: math.floor(1000 * math.log((2 * n_all + 2) / (2 * n + 1))) for t, n in df.items()}
    out = []
    for item, text in items:
        rows = []
        for i, bag, n in bags:
            m = 50 + 50 * n * n_all // l_all
            score = sum(w[t] * (1_000_000_000 * bag[t] // (1000 * bag[t] + 20 * m)) for t in set(terms(text)) if t in bag)
            rows += [(-score, i is None, i or 0, i)] if score else []
        out += [(item, rank, r[3], -r[0]) for rank, r in enumerate(sorted(rows, key=lambda r: r[:3])[:k], 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("size", [30, 1_000_000])
def test_ranked_search(spark, size):
    r = random.Random(size)
    words = [f"w{i}" for i in range(40)] + ["É", "日本", "X1"]
    docs = [(i, " ".join(r.choice(words[: r.randint(1, 43)]) for _ in range(r.randint(1, 40)))) for i in range(150)]
    docs += [(200, None), (201, ""), (202, " .,! "), (None, "w1 w2 w3"), (5, docs[5][1]), (203, "W1;w1" * 500), (204, "w7")]
    docs += [(300 + i, "W9 rare copy") for i in range(40)]  # ties
    items = [(1, "w1 W2, é rare"), (2, "rare COPY w9"), (2, "w30 w31 w32 w33 日本 x1"), (None, "w5 w5"), (4, None), (5, "nowhere")]
    items += [(6, " ".join(words))]
    frame = spark.createDataFrame([(*x, *[None] * 6) for x in docs], f"doc_id long, text string, {CLASH}").coalesce(2)
    index = lexical_search.build_index(frame, segment_terms=size)
    asked = spark.createDataFrame([(*x, *[None] * 6) for x in items], f"item_id long, text string, {CLASH}")
    found = lexical_search.search(index, asked, k=6, block_items=3).collect()
    assert sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in found), key=repr) == brute(docs, items, 6)


def test_search_leaves_intervals_out(spark):
    # one document holds all the terms: once it is found, the bound of all other intervals is below its score
    docs = [(i, f"common filler{i}") for i in range(3000)] + [(3000, "common needle hay stack")]
    held = [(i, lexical_search.terms_of(t)) for i, t in docs]
    import pyarrow as pa

    schema = pa.schema([("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())),
                        *[(c, pa.binary()) for c in ("terms", "ends", "docs", "counts")]])
    row = lexical_search._segment(held, schema).to_pylist()[0]
    wanted = {t: i for i, t in enumerate([b"common", b"needle", b"hay", b"stack"])}
    segment = lexical_search.Segment(row, wanted)
    segment.prepare(len(docs), sum(len(t) for _, t in held))
    best, scored = lexical_search.Best(1), []
    offer = best.offer
    best.offer = lambda score, doc: (scored.append(doc), offer(score, doc))
    segment.search([0, 1, 2, 3], [1, 900, 900, 900], best)
    assert best.rows[0][2] == 3000 and len(scored) < 20


def test_search_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id string, text string")
    items = spark.createDataFrame([("a", "x")], "item_id string, text string")
    assert lexical_search.search(lexical_search.build_index(docs), items).collect() == []
    some = spark.createDataFrame([("d", "x y")], "doc_id string, text string")
    assert lexical_search.search(lexical_search.build_index(some), items.limit(0)).collect() == []
