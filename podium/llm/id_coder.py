"""Blocks of token ids, coded by an adaptive context-mixing range coder.

A block is coded on its own: all of the model starts anew with it, so any block can be read without the others. Three
predictions are mixed for each id: order 2 and order 1 each name the id that last followed the two ids or the one id before it,
with a degree of confidence; order 0 gives the ids of the block so far by their counts, and an
escape, as likely as ids were new of late, to an id's plain bits. Each order's part of the mixture is what it earned in this block: the share of ids it named
rightly at its present degree of confidence, learned as the block goes on; a range coder with carries codes from the mixture.

An id depends on all before it, so one block cannot be spread over a vector unit; many blocks can: `encode` and `decode` walk a
group of blocks in step, one array operation for all of them. Whole numbers are exact and floats are only multiplied, added,
divided and compared, each an exactly rounded operation, so any machine decodes what another one wrote.

Layout, little-endian: `PID2`, number of ids (4 bytes), crc32 of the ids as unsigned 32-bit integers (4 bytes), 1 where ids have
more than 16 bits and 0 else (1 byte), then the 16-bit words of the coder.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC, HEAD = b"PID2", struct.Struct("<4sIIB")
#: Ids a block may have, so that places and counts in it take 16 bits.
LONGEST = 1 << 15
#: The coder's window is 48 bits; a word of 16 leaves it whenever 32 bits or less are in use.
WINDOW, LEAST = 48, 1 << 32
#: Parts of 2**16 that the named ids can get together; the rest is always left to order 0.
NAMED = 65_000
ROWS = 1 << 10
#: Prior share of right ids by how sure an entry is (0: it names none), counted as so many trials; ids between new weights.
RIGHT, TRIED, STRIDE = np.array([0.01, 0.3, 0.5, 0.65, 0.75, 0.82, 0.87, 0.92]), 8.0, 64
#: What an entry gains by a miss and by a hit, by how sure it was; after a miss, those under 2 name the new id instead.
SURE = np.arange(8)
GAIN = np.concatenate([np.where(SURE < 2, 0, -(SURE + 1 >> 1)), np.minimum(SURE + 1, 7) - SURE])
#: Lanes whose order 0 the encoder counts at once.
STEP = 256
#: Parts of 2**16 that an escape gets at least, and beyond that at most.
ESCAPE, MOST_ESCAPE = 256, 65_000


def _counts_at(t: int) -> bool:
    """Whether order 0 counts the block anew after `t` ids: after 16, 64, 256, 512, 1,024, and then after every 1,024."""
    return t in (16, 64, 256, 512) or (t > 0 and t % 1024 == 0)


def _escape(distinct: np.ndarray, n: int, before: np.ndarray | int, n_before: int) -> np.ndarray:
    """The escape's part until the next count: the share of ids that were new since the last one."""
    return ESCAPE + MOST_ESCAPE * (distinct - before + 1) // (n - n_before + 2)


class _Mixture:
    """What the model knows of a group of blocks; the same on both sides. Row 0 of a pair is order 2, row 1 order 1."""

    def __init__(self, lanes: int, wide: bool):
        kind = np.int64 if wide else np.int32
        self.table, self.gain = np.zeros(2 * lanes * ROWS, kind), GAIN.astype(kind)
        self.base = np.arange(2 * lanes).reshape(2, lanes) * ROWS
        self.at, self.last = np.zeros((2, lanes), np.int64), np.zeros(lanes, np.int64)
        self.degree = np.arange(2 * lanes).reshape(2, lanes) * 8
        self.tried = np.full(16 * lanes, TRIED)
        self.right = np.tile(TRIED * RIGHT, 2 * lanes)
        #: Twice an order's degree of confidence, and 8 more where it was right.
        self.cells, self.cell_of = np.zeros((STRIDE, 2, lanes), np.int32), (2 * self.degree).astype(np.int32)
        self.t = 0
        self.context(self.last)
        self.weigh()

    def weigh(self) -> None:
        """An order's weight at each degree of confidence: the share of ids it named rightly there, in this block."""
        self.weight = (self.right / self.tried * NAMED).astype(np.uint16)
        self.weight[::8] = 0

    def context(self, ids: np.ndarray) -> None:
        """The rows of both orders after these ids."""
        one, two = self.at[1], self.at[0]
        np.multiply(ids, 40503, out=one)
        np.multiply(self.last, 48271, out=two)
        two ^= one
        self.at >>= 4
        self.at &= ROWS - 1
        self.at += self.base
        self.last = ids

    def predict(self) -> None:
        """The ids that both orders name, and the parts of 2**16 that order 2 and both together get: order 1 shares in what
        order 2 leaves, order 0 in what both leave."""
        self.entry = self.table.take(self.at)
        self.sure = self.entry & 7
        self.ids = (self.entry >> 3) - 1
        w2, w1 = self.weight.take(self.degree + self.sure).astype(np.int64)
        self.part2 = w2 + 1
        self.named = NAMED - w2
        self.named *= w1
        self.named >>= 16
        self.named += self.part2
        self.named += 1

    def learn(self, ids: np.ndarray) -> None:
        """Entries after these ids, and weights every few ids; an order is right even where the other names the id too."""
        own = ids.astype(self.entry.dtype)
        seen = (self.ids == own).astype(self.entry.dtype)
        seen <<= 3
        seen |= self.sure
        np.add(self.cell_of, seen, out=self.cells[self.t], casting="same_kind")
        self.t += 1
        if self.t == STRIDE:
            found = np.bincount(self.cells.ravel(), minlength=2 * self.right.size).reshape(-1, 2, 8)
            self.tried += found.sum(1).ravel()
            self.right += found[:, 1].ravel()
            self.weigh()
            self.t = 0
        # surer by a hit, half as sure by a miss; names the new id once it was not sure
        own <<= 3
        own += 9
        entry = self.entry
        own = own ^ entry
        own &= -(seen < 2).astype(own.dtype)
        entry += self.gain.take(seen)
        entry ^= own
        self.table[self.at] = entry
        self.context(ids)


class _Ranks:
    """Order 0 for the encoder, which knows the whole block: the ids' ranks in it, and the counts by rank so far."""

    def __init__(self, ids: np.ndarray):
        lanes, longest = ids.shape
        self.rank = np.zeros((lanes, longest), np.int32)
        # ids and their places in one number, so that a plain sort is enough
        kind = np.uint64 if ids.dtype.itemsize > 2 else np.uint32
        places = np.arange(longest, dtype=kind)
        for at in range(0, lanes, STEP):
            ordered = ids[at : at + STEP].astype(kind)
            ordered <<= kind(16)
            ordered |= places
            ordered.sort(axis=1)
            order = (ordered & kind(0xFFFF)).astype(np.int64)
            ordered >>= kind(16)
            rank = np.zeros(ordered.shape, np.int32)
            np.cumsum(ordered[:, 1:] != ordered[:, :-1], axis=1, out=rank[:, 1:])
            np.put_along_axis(self.rank[at : at + STEP], order, rank, 1)
        self.ranks = int(self.rank.max()) + 1
        self.rank += np.arange(lanes, dtype=np.int32)[:, None] * self.ranks
        self.distinct = np.zeros(lanes, np.int64)
        self.seen = np.zeros((lanes, self.ranks), np.int32)

    def upto(self, since: int, t: int, until: int) -> np.ndarray:
        """Count the ids from `since` to `t` too; first place << 16 | count, time by lane, of the ids from `t` to `until`."""
        lanes = len(self.rank)
        out = np.empty((until - t, lanes), np.int32)
        # some lanes at a time, whose counts fit a core's cache
        for at in range(0, lanes, STEP):
            seen, rank = self.seen[at : at + STEP], self.rank[at : at + STEP]
            counted = rank[:, since:t] - at * self.ranks
            seen += np.bincount(counted.ravel(), minlength=seen.size).reshape(seen.shape)
            both = np.cumsum(seen, axis=1, dtype=np.int32)
            both -= seen
            both <<= 16
            both |= seen
            out[:, at : at + STEP] = both.take(rank[:, t:until] - at * self.ranks).T
        before, self.distinct = self.distinct, np.count_nonzero(self.seen, axis=1)
        self.escape = _escape(self.distinct, t, before, since)
        return out


class _Counts:
    """Order 0 for the decoder: the ids so far, sorted, each with its first place among them and its count; flat by lane, as
    count << 48 | first place << 32 | id."""

    def __init__(self, ids: np.ndarray, before: _Counts | None):
        ids = np.sort(ids.astype(np.uint32), axis=1)  # sorted faster than 16 bits are
        lanes, self.n = ids.shape
        new = np.ones((lanes, self.n), bool)
        np.not_equal(ids[:, 1:], ids[:, :-1], out=new[:, 1:])
        self.distinct = new.sum(1)
        self.escape = _escape(self.distinct, self.n, *((before.distinct, before.n) if before else (0, 0)))
        at = np.flatnonzero(new)
        run = np.diff(at, append=new.size)
        self.packed = np.repeat(run << 48 | at % self.n << 32 | ids.ravel()[at].astype(np.int64), run)


def _spread(words: int, line: int) -> int:
    """At least as many words, an odd number of cache lines: equal places of many lanes do not share a part of the cache."""
    return (-(-words // line) | 1) * line


class _Writer:
    """The encoding end of the range coder, a lane a block. Carries stay in the words' upper halves until the end."""

    def __init__(self, lanes: int, words: int):
        self.low, self.range = np.zeros(lanes, np.int64), np.full(lanes, 1 << WINDOW, np.int64)
        self.words = _spread(words, 16)
        self.out, self.at = np.zeros(lanes * self.words, np.uint32), np.arange(lanes) * self.words

    def shift(self) -> None:
        """Words leave the window until every range is wide enough."""
        self.out[self.at] = self.low >> 32  # written again later where it stays
        one = (self.range < LEAST).astype(np.int64)
        self.at += one
        keep = one - 1
        keep |= LEAST - 1
        self.low &= keep
        one <<= 4
        self.low <<= one
        self.range <<= one
        lanes = np.flatnonzero(self.range < LEAST)
        while len(lanes):
            low, at, wider = self.low.take(lanes), self.at.take(lanes), self.range.take(lanes) << 16
            self.out[at] = low >> 32
            self.at[lanes], self.low[lanes], self.range[lanes] = at + 1, (low & (LEAST - 1)) << 16, wider
            lanes = lanes[wider < LEAST]

    def close(self) -> tuple[np.ndarray, np.ndarray]:
        """The words, lane by lane, and how many: one more, of a number inside the range, and all carries passed on; zeros
        follow."""
        self.out[self.at] = self.low + (LEAST - 1) >> 32
        size = self.at - np.arange(len(self.at)) * self.words + 1
        out = np.ascontiguousarray(self.out.reshape(-1, self.words)[:, : size.max()].T)
        for at in range(len(out) - 1, 0, -1):
            out[at - 1] += out[at] >> 16
        return np.ascontiguousarray(out.T.astype("<u2")), size


def encode(ids: np.ndarray, lengths: np.ndarray) -> list[bytes]:
    """The blocks of a group: `ids` is (blocks, longest), of which the first `lengths` count; what follows must be zeros."""
    lanes, longest = ids.shape
    if longest > LONGEST:
        raise ValueError(f"a block has {LONGEST} ids at most")
    wide = bool((ids > 0xFFFF).any())
    crcs = [zlib.crc32(row[:n].astype("<u4").tobytes()) for row, n in zip(ids, lengths)]
    ids = ids.astype(np.uint32 if wide else np.uint16)
    ranks = _Ranks(ids)
    ids = np.ascontiguousarray(ids.T)
    model, coder = _Mixture(lanes, wide), _Writer(lanes, (2 + wide) * longest + 8)
    counted = until = 0
    for t in range(longest):
        if t == until:
            since = t
            until = next((x for x in range(t + 1, longest) if _counts_at(x)), longest)
            if _counts_at(t):
                both = ranks.upto(counted, t, until)
                counted = t
        now = ids[t].astype(np.int64)
        model.predict()
        hit2, hit1 = model.ids == now
        part = coder.range >> 16
        named2, named = part * model.part2, part * model.named
        rest = np.flatnonzero(~(hit2 | hit1))
        bottom = named.take(rest)
        left = coder.range.take(rest) - bottom
        # the place and width of order 1, then those of order 2 where it is right
        is2 = -hit2.astype(np.int64)
        named -= named2
        width = named2 ^ named
        width &= is2
        width ^= named
        named2 &= ~is2
        if counted:
            first = both[t - since].take(rest).astype(np.int64)
            n = first & 0xFFFF
            first >>= 16
            plain = n == 0
            cut = (left >> 16) * ranks.escape.take(rest)
            one = (left - cut) // counted
            n *= one
            n += cut * plain
            first *= one
            first += cut
            first *= ~plain
            named2[rest] = bottom + first
            width[rest] = n
            rest = rest[plain]
        else:
            named2[rest], width[rest] = bottom, left
        coder.low += named2
        coder.range = width
        if len(rest):
            for bits in (16, 0) if wide else (0,):
                if wide:
                    coder.shift()
                part = coder.range[rest] >> 16
                coder.low[rest] += part * (now[rest] >> bits & 0xFFFF)
                coder.range[rest] = part
        coder.shift()
        model.learn(now)
    words, size = coder.close()
    return [
        HEAD.pack(MAGIC, int(n), crc, wide) + row[:m].tobytes()
        for n, crc, row, m in zip(lengths.tolist(), crcs, words, size.tolist())
    ]


class _Reader:
    """The decoding end: how far the code lies above the bottom of the range."""

    def __init__(self, words: np.ndarray):
        lanes, each = words.shape
        top = words[:, :3].astype(np.int64)
        self.words, self.at = words.ravel(), np.arange(lanes) * each + 3
        self.code = top[:, 0] << 32 | top[:, 1] << 16 | top[:, 2]
        self.range = np.full(lanes, 1 << WINDOW, np.int64)

    def shift(self) -> None:
        one = (self.range < LEAST).astype(np.int64)
        word = self.words.take(self.at, mode="clip").astype(np.int64)
        word &= -one
        self.at += one
        one <<= 4
        self.code <<= one
        self.code |= word
        self.range <<= one
        lanes = np.flatnonzero(self.range < LEAST)
        while len(lanes):
            at, wider = self.at.take(lanes), self.range.take(lanes) << 16
            self.code[lanes] = self.code.take(lanes) << 16 | self.words.take(at, mode="clip")
            self.at[lanes], self.range[lanes] = at + 1, wider
            lanes = lanes[wider < LEAST]


def decode(blocks: list[bytes]) -> list[np.ndarray]:
    """The ids of each block; a block that is not whole raises a ValueError."""
    heads = [HEAD.unpack_from(b) if len(b) >= HEAD.size else (b"",) * 4 for b in blocks]
    if any(h[0] != MAGIC or h[1] > LONGEST for h in heads):
        raise ValueError("not a block of token ids")
    out: list[np.ndarray] = [None] * len(blocks)
    for wide in {h[3] for h in heads}:
        these = [i for i, h in enumerate(heads) if h[3] == wide]
        found = _decode([blocks[i][HEAD.size :] for i in these], np.array([heads[i][1] for i in these]), bool(wide))
        for i, ids in zip(these, found):
            if zlib.crc32(ids.astype("<u4").tobytes()) != heads[i][2]:
                raise ValueError("a block of token ids does not match its checksum")
            out[i] = ids
    return out


def _decode(coded: list[bytes], lengths: np.ndarray, wide: bool) -> list[np.ndarray]:
    lanes, longest = len(coded), int(lengths.max())
    words = np.zeros((lanes, _spread(max(len(c) for c in coded) // 2 + 4, 32)), np.uint16)
    for lane, c in enumerate(coded):
        words[lane, : len(c) // 2] = np.frombuffer(c[: len(c) // 2 * 2], "<u2")
    ids = np.zeros((longest, lanes), np.uint32 if wide else np.uint16)
    model, coder, counts = _Mixture(lanes, wide), _Reader(words), None
    for t in range(longest):
        if _counts_at(t):
            counts = _Counts(np.ascontiguousarray(ids[:t].T), counts)
        model.predict()
        part = coder.range >> 16
        named2, named = part * model.part2, part * model.named
        above = coder.code - named
        rest = np.flatnonzero(above >= 0)
        code, left = above.take(rest), coder.range.take(rest) - named.take(rest)
        # all bits where order 2 is right, none else
        coder.code -= named2
        is2 = coder.code >> 63
        named -= named2
        coder.range = named2 ^ named
        coder.range &= is2
        coder.range ^= named
        named2 &= is2
        coder.code += named2
        now = model.ids[1].astype(np.int64)
        is2 &= model.ids[0] ^ now
        now ^= is2
        if counts is not None:
            cut = (left >> 16) * counts.escape.take(rest)
            left -= cut
            left //= counts.n
            above = code - cut
            plain = above < 0
            at = above // left
            np.minimum(at, counts.n - 1, out=at)
            np.maximum(at, 0, out=at)
            at += rest * counts.n
            found = counts.packed.take(at)
            now[rest] = found & 0xFFFFFFFF
            above -= left * (found >> 32 & 0xFFFF)
            left *= found >> 48
            left *= ~plain
            cut *= plain
            left += cut
            above += cut
            coder.code[rest], coder.range[rest] = above, left
            rest = rest[plain]
        else:
            coder.code[rest], coder.range[rest] = code, left
        if len(rest):
            now[rest] = 0
            for _ in range(1 + wide):
                if wide:
                    coder.shift()
                part = coder.range[rest] >> 16
                half = np.minimum(coder.code[rest] // part, 0xFFFF)
                coder.code[rest] -= part * half
                coder.range[rest] = part
                now[rest] = now[rest] << 16 | half
        coder.shift()
        ids[t] = now
        model.learn(now)
    return [ids[:n, lane].astype(np.uint32) for lane, n in enumerate(lengths)]
