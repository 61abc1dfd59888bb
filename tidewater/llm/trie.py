"""Binary trie self-join over bit fingerprints under a Hamming error budget.

The trie is held as sorted arrays: the nodes of a level are runs of equal fingerprint
prefixes. Two nodes are traversed together: their children are paired, the differing bits of
the new path pieces are added up, and a pair of nodes is dropped as soon as its bits exceed
the budget of the best pair of rows below it. A level is four bits deep (two binary nodes have
at most sixteen grandchildren's children), and the path below a node of one row is one edge,
whose bits are compared at once, so a family of like rows costs little beside another."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from tidewater.session import discard, materialize, release

#: Bits of a level.
STEP = 4
#: Pairs of nodes or rows that are expanded at once.
FRONTIER = 1 << 20
#: Rows of a signature that one tile side may hold.
TILE = 1 << 16
#: Larger groups are cut by further shared words, up to so many in all; of a set at most REST are
#: carried along.
SPLIT, DEPTH, REST = 96, 3, 64
#: Sets whose tiles are shuffled at once, and the passes that are made at most.
PASS, PASSES = 100_000, 8
MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)]
SIGNED = "key bigint, size int, p0 bigint, p1 bigint, sigs binary, pos binary, seen binary"
TILED = "tile bigint, key bigint, size int, at int, chunk int, cross boolean, p0 bigint, p1 bigint, rest binary"


class Budget:
    """Sets of sizes s and t whose Jaccard similarity is at least num/den differ in at most
    (s + t)(den - num)/(den + num) elements, and the smaller has at least num/den of the
    larger's. A parity fingerprint differs in no more bits than the sets in elements, so the
    budget never loses a pair."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den

    def bits(self, total: np.ndarray) -> np.ndarray:
        return total * (self.den - self.num) // (self.den + self.num)

    def prefixes(self, s: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """How many of its rarest words a set of s words must look at to share one with any
        similar set, where that is as large or larger and where it is smaller; and how many
        words it shares with any at least."""
        least = lambda t: -(-self.num * (s + t) // (self.den + self.num))
        fewest = least(-(-self.num * s // self.den))
        return s - least(s) + 1, s - fewest + 1, fewest

    def sizes_fit(self, lo_a, hi_a, lo_b, hi_b) -> np.ndarray:
        return (hi_a * self.den >= lo_b * self.num) & (hi_b * self.den >= lo_a * self.num)


def _cross(na: np.ndarray, nb: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each k all (i, j) with i < na[k], j < nb[k]: arrays of k, i, j."""
    n = na * nb
    k = np.repeat(np.arange(len(n)), n)
    pos = np.arange(len(k)) - np.repeat(np.cumsum(n) - n, n)
    return k, pos // nb[k], pos % nb[k]


class Trie:
    """``roots`` is a non-decreasing root number per row; rows of different roots share no
    node. ``prints`` is (rows, 2) of uint64, ``sizes`` the set size per row. Rows must be sorted
    by (root, prints). ``visited`` counts the pairs of nodes and of rows that were looked at."""

    def __init__(self, roots: np.ndarray, prints: np.ndarray, sizes: np.ndarray):
        n = len(prints)
        self.prints, self.sizes, self.visited = prints, sizes, 0
        change = np.empty(n, bool)
        change[0] = True
        change[1:] = roots[1:] != roots[:-1]
        self.starts, self.steps = [np.flatnonzero(change)], []
        for d in range(prints.shape[1] * 64 // STEP):
            if len(self.starts[-1]) == n:
                break
            piece = ((prints[:, d * STEP // 64] >> np.uint64(64 - STEP - d * STEP % 64)) & np.uint64((1 << STEP) - 1)).astype(np.uint8)
            change[1:] |= piece[1:] != piece[:-1]
            self.steps.append(piece)
            self.starts.append(np.flatnonzero(change))
        self.depth = len(self.steps)
        self.lo = [np.minimum.reduceat(sizes, s) for s in self.starts]
        self.hi = [np.maximum.reduceat(sizes, s) for s in self.starts]
        self.many = [np.diff(np.append(s, n)) for s in self.starts]
        # First child of each node, and one past the last, among the nodes of the next level.
        self.child = [np.append(np.searchsorted(b, a), len(b)) for a, b in zip(self.starts, self.starts[1:])]
        self.row = np.append(self.starts[-1], n)

    def _rows(self, x: np.ndarray, y: np.ndarray, budget: Budget) -> tuple[np.ndarray, np.ndarray]:
        """Those of the row pairs whose sizes fit and whose whole paths are within the budget."""
        self.visited += len(x)
        s, t = self.sizes[x], self.sizes[y]
        k = np.flatnonzero((x != y) & budget.sizes_fit(s, s, t, t))
        x, y = x[k], y[k]
        bits = np.bitwise_count(self.prints[x] ^ self.prints[y]).sum(1, dtype=np.int64)
        near = bits <= budget.bits(s[k] + t[k])
        return x[near], y[near]

    def join(self, a: np.ndarray, b: np.ndarray, budget: Budget) -> tuple[np.ndarray, np.ndarray]:
        """Row pairs below the root pairs (a, b) within the budget. A root joined with itself
        gives each pair of rows once, and no row with itself."""
        none = np.empty(0, np.int64)
        out: list[tuple[np.ndarray, np.ndarray]] = [(none, none)]
        stack = [(0, a, b, np.zeros(len(a), np.int32))]
        while stack:
            level, a, b, bits = stack.pop()
            # Below two nodes of one row each there is one edge each.
            one = (self.many[level][a] == 1) & (self.many[level][b] == 1)
            if one.any():
                out.append(self._rows(self.starts[level][a[one]], self.starts[level][b[one]], budget))
                a, b, bits = a[~one], b[~one], bits[~one]
            if not len(a):
                continue
            child = self.child[level] if level < self.depth else self.row
            na, nb = child[a + 1] - child[a], child[b + 1] - child[b]
            total = np.cumsum(na * nb)
            if len(total) > 1 and total[-1] > FRONTIER:
                cut = max(1, int(np.searchsorted(total, total[-1] // 2)))
                cut = min(cut, len(total) - 1)
                stack += [(level, a[:cut], b[:cut], bits[:cut]), (level, a[cut:], b[cut:], bits[cut:])]
                continue
            k, i, j = _cross(na, nb)
            ca, cb = child[a][k] + i, child[b][k] + j
            once = (a[k] != b[k]) | ((ca <= cb) if level < self.depth else (ca < cb))
            k, ca, cb = k[once], ca[once], cb[once]
            if level == self.depth:
                out.append(self._rows(ca, cb, budget))
                continue
            self.visited += len(ca)
            at = self.starts[level + 1]
            seen = bits[k] + np.bitwise_count(self.steps[level][at[ca]] ^ self.steps[level][at[cb]])
            lo, hi = self.lo[level + 1], self.hi[level + 1]
            good = (seen <= budget.bits(hi[ca] + hi[cb])) & budget.sizes_fit(lo[ca], hi[ca], lo[cb], hi[cb])
            if good.any():
                stack.append((level + 1, ca[good], cb[good], seen[good].astype(np.int32)))
        return np.concatenate([x for x, _ in out]), np.concatenate([y for _, y in out])


def _starts(x: np.ndarray) -> np.ndarray:
    new = np.ones(len(x), bool)
    new[1:] = x[1:] != x[:-1]
    return np.flatnonzero(new)


class Tiles:
    """The rows of some tiles. A tile of more than SPLIT rows is cut by the next word two sets
    share, and again by the one after that, as similar sets share several of their rarest words;
    what is small then is compared pair by pair, what stays large by the trie. ``visited`` counts
    the pairs that were looked at."""

    def __init__(self, t: pd.DataFrame, budget: Budget):
        self.budget = budget
        self.key, self.chunk, self.cross = t["key"].to_numpy(), t["chunk"].to_numpy(), t["cross"].to_numpy(bool)
        self.size, self.at = t["size"].to_numpy(np.int64), t["at"].to_numpy(np.int64)
        self.prints = np.ascontiguousarray(t[["p0", "p1"]].to_numpy(np.int64)).view(np.uint64)
        # Sets of too many words to be carried along, or of so few that no further one need be shared.
        self.whole = t["rest"].isna().to_numpy()
        rest = [b"" if x is None else x for x in t["rest"]]
        self.rest = np.frombuffer(b"".join(rest), np.uint32)
        self.off = np.append(0, np.cumsum([len(x) // 4 for x in rest])).astype(np.int64)
        self.short, self.long, self.least = budget.prefixes(self.size)
        self.found: list[np.ndarray] = []
        self.visited = 0
        self._cut(1, t["tile"].to_numpy(), np.arange(len(t)), self.off[:-1], self.at)

    def _cut(self, depth: int, group: np.ndarray, row: np.ndarray, after: np.ndarray, pos: np.ndarray) -> None:
        """Rows of one group are neighbours. ``after`` is where a row's further words begin and
        ``pos`` the place of the last shared one, of ``depth``."""
        if not len(row):
            return
        probe = pos >= self.short[row] + depth - 1
        start = _starts(group)
        n = np.diff(np.append(start, len(row)))
        some = np.repeat((n > 1) & ~np.logical_and.reduceat(probe, start), n)
        large = np.repeat(n > SPLIT, n)
        k = np.flatnonzero(some & ~large)
        self._compare(depth, group[k], row[k], pos[k], probe[k])
        k = np.flatnonzero(some & large)
        if not len(k):
            return
        group, row, after, pos, probe = group[k], row[k], after[k], pos[k], probe[k]
        if depth == DEPTH:
            self._trie(group, row, probe, np.ones(len(row), bool))
            return
        whole = self.whole[row] | (self.least[row] <= depth)
        if whole.any():
            here = np.isin(group, group[whole])
            self._trie(group[here], row[here], probe[here], whole[here])
        n = np.where(whole, 0, self.off[row + 1] - after)
        start = _starts(group)
        total, lo = np.append(np.add.reduceat(n, start), 0), 0
        ends = np.append(start, len(row))
        while lo < len(start):
            hi = max(lo + 1, int(np.searchsorted(np.cumsum(total[lo:]), FRONTIER, "right")) + lo)
            hi = min(hi, len(start))
            i = np.repeat(np.arange(ends[lo], ends[hi]), m := n[ends[lo] : ends[hi]])
            j = after[i] + np.arange(len(i)) - np.repeat(np.cumsum(m) - m, m)
            word = self.rest[j].astype(np.uint64)
            place = (word >> np.uint64(24)).astype(np.int64)
            sub = ((group[i].view(np.uint64) * MIX[0]) ^ ((word & np.uint64(0xFFFFFF)) * MIX[1])).view(np.int64)
            order = np.flatnonzero(place < self.long[row[i]] + depth)
            order = order[np.argsort(sub[order], kind="stable")]
            self._cut(depth + 1, sub[order], row[i[order]], j[order] + 1, place[order])
            lo = hi

    def _keep(self, x: np.ndarray, y: np.ndarray) -> None:
        a, b = self.key[x], self.key[y]
        self.found.append(np.stack([np.minimum(a, b), np.maximum(a, b)], 1)[a != b])

    def _compare(self, depth: int, group: np.ndarray, row: np.ndarray, pos: np.ndarray, probe: np.ndarray) -> None:
        start = _starts(group)
        rank = np.arange(len(row)) - np.repeat(start, np.diff(np.append(start, len(row))))
        ends, lo = np.cumsum(rank), 0
        while lo < len(row):
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + FRONTIER, "right")))
            r = rank[lo:hi]
            y = np.repeat(np.arange(lo, hi), r)
            x = y - 1 - (np.arange(len(y)) - np.repeat(np.cumsum(r) - r, r))
            lo = hi
            self.visited += len(y)
            both = self.size[row]
            most = self.budget.bits(both[x] + both[y])
            # The words before the last shared one that aren't shared are in one set only.
            k = np.flatnonzero(~(probe[x] & probe[y]) & (pos[x] + pos[y] - 2 * (depth - 1) <= most))
            most, x, y = most[k], row[x[k]], row[y[k]]
            s, t = self.size[x], self.size[y]
            near = self.budget.sizes_fit(s, s, t, t) & (~self.cross[x] | (self.chunk[x] != self.chunk[y]))
            near &= np.bitwise_count(self.prints[x] ^ self.prints[y]).sum(1, dtype=np.int64) <= most
            self._keep(x[near], y[near])

    def _trie(self, group: np.ndarray, row: np.ndarray, probe: np.ndarray, whole: np.ndarray) -> None:
        """Pairs of a group one of which is ``whole``, by the trie: a root per group, chunk and role."""
        roles = (group, self.chunk[row], whole, probe)
        order = np.lexsort((*self.prints[row].T[::-1], *roles[::-1]))
        row = row[order]
        rg, rc, rw, rp = roles = [x[order] for x in roles]
        new = np.ones(len(row), bool)
        new[1:] = np.logical_or.reduce([x[1:] != x[:-1] for x in roles])
        first = np.flatnonzero(new)
        trie = Trie(np.cumsum(new), self.prints[row], self.size[row])
        rg, rc, rw, rp, rx = rg[first], rc[first], rw[first], rp[first], self.cross[row[first]]
        a, b = [], []
        # Roots of one group are neighbours, at most eight of them.
        for gap in range(min(8, len(first))):
            i = np.arange(len(first) - gap)
            j = i + gap
            # Two words that only larger sets look at needn't meet; of a tile of two chunks
            # each chunk is joined with itself elsewhere.
            want = (rg[i] == rg[j]) & ~(rp[i] & rp[j]) & (~rx[i] | (rc[i] != rc[j])) & (rw[i] | rw[j])
            a.append(i[want])
            b.append(j[want])
        x, y = trie.join(np.concatenate(a), np.concatenate(b), self.budget)
        self.visited += trie.visited
        self._keep(row[x], row[y])

    def pairs(self) -> pd.DataFrame:
        got = np.unique(np.concatenate([np.empty((0, 2), np.int64), *self.found]), axis=0)
        return pd.DataFrame({"a": got[:, 0], "b": got[:, 1]})


def _join_tiles(budget: Budget):
    def shared(t: pd.DataFrame) -> pd.DataFrame:
        """Without the tiles of one row."""
        tile = t["tile"].to_numpy()
        twin = np.zeros(len(t), bool)
        same = tile[1:] == tile[:-1]
        twin[1:] |= same
        twin[:-1] |= same
        return t[twin].reset_index(drop=True)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come sorted by tile; whole tiles are joined many at a time."""
        held: list[pd.DataFrame] = []
        n = 0
        for b in batches:
            if not len(b):
                continue
            held.append(b)
            n += len(b)
            if n < 100_000 or b["tile"].iloc[-1] == held[0]["tile"].iloc[0]:
                continue
            t = pd.concat(held, ignore_index=True)
            last = t["tile"].to_numpy() == t["tile"].iloc[-1]  # its rows may go on
            if len(s := shared(t[~last])):
                yield Tiles(s, budget).pairs()
            held, n = [t[last]], int(last.sum())
        if n and len(s := shared(pd.concat(held, ignore_index=True))):
            yield Tiles(s, budget).pairs()

    return run


def _tiled(budget: Budget, tile_rows: int, turn: int, turns: int):
    """The rows of the tiles of a pass, from packed :data:`SIGNED`."""

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            sig, pos, seen = (np.frombuffer(b"".join(b[c]), kind).astype(np.int64) for c, kind in (("sigs", np.int64), ("pos", np.int32), ("seen", np.int32)))
            n = np.array([len(x) // 8 for x in b["sigs"]], np.int64)
            row, end = np.repeat(np.arange(len(n)), n), np.cumsum(n)
            size = b["size"].to_numpy(np.int64)
            long = budget.prefixes(size)[1]
            i = np.flatnonzero((pos < long[row]) & ((sig >> 7) % turns == turn))
            chunks = -(-seen[i] // tile_rows)
            k = np.repeat(np.arange(len(i)), chunks)
            other = np.arange(len(k)) - np.repeat(np.cumsum(chunks) - chunks, chunks)
            i, chunks = i[k], chunks[k]
            at = row[i]
            key = b["key"].to_numpy()[at]
            chunk = (key >> 3) % chunks
            lo, hi = np.minimum(chunk, other).view(np.uint64), np.maximum(chunk, other).view(np.uint64)
            tile = (sig[i].view(np.uint64) ^ (lo * MIX[0]) ^ (hi * MIX[1])).view(np.int64)
            item = ((np.minimum(pos, 255) << 24) | (sig & 0xFFFFFF)).astype(np.uint32).tobytes()
            # Of words that few sets have all pairs are compared anyway; of too many none is carried along.
            far = (end[at] - i - 1 > REST) | (pos[end[at] - 1] > 255)
            rest = [None if f else item[4 * (p + 1) : 4 * e] if h else b"" for p, e, f, h in zip(i.tolist(), end[at].tolist(), far.tolist(), (seen[i] > SPLIT).tolist())]
            out = {"tile": tile, "key": key, "size": size[at].astype(np.int32), "at": pos[i].astype(np.int32), "chunk": chunk.astype(np.int32), "cross": chunk != other}
            yield pd.DataFrame(out | {"p0": b["p0"].to_numpy()[at], "p1": b["p1"].to_numpy()[at], "rest": rest})

    return emit


def signature_join(signed: DataFrame, budget: Budget) -> DataFrame:
    """``(a, b)``, a < b: distinct pairs of keys that share a signature and whose fingerprints
    are within the budget. ``signed``: :data:`SIGNED`, a row a set: its rarest words, their places
    and how many sets may have them, packed, and 128 bits. A signature is the top of the trie,
    on which two rows must agree. A signature of more than TILE rows is cut into chunks, and each
    pair of chunks is a tile of its own, so no group is ever held whole and no pair is left out.
    The rows of the tiles are made and joined in up to PASSES passes, so that only a part of them
    is on disk at once."""
    signed = materialize(signed, "signed")
    spark = signed.sparkSession
    turns = max(1, min(PASSES, -(-signed.count() // PASS)))
    parts = []
    for turn in range(turns):
        release(spark)
        tiled = signed.mapInPandas(_tiled(budget, TILE, turn, turns), TILED).repartition("tile").sortWithinPartitions("tile")
        parts.append(materialize(tiled.mapInPandas(_join_tiles(budget), "a bigint, b bigint"), "near"))
    discard(signed)
    every = parts[0]
    for p in parts[1:]:
        every = every.union(p)
    every = materialize(every.distinct(), "near")
    discard(*parts)
    release(spark)
    return every
