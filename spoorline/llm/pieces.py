"""Operator 10: SentencePiece segmentation, sampled without replacement by Gumbel top-k, and decoding.

A text is a lattice of pieces. Pieces never reach over the start of a word, so the lattice falls into chunks, and equal
chunks of a batch share one lattice. Backward sums give the probability of every piece at every place given what is before
it. The search keeps sets of segmentations ("this prefix, then none of these pieces"), each with its perturbed best value:
a Gumbel draw of location log(mass), truncated at its parent's. That value is exact, so best-first search never expands a
set in vain: popping a set emits its best segmentation (its prefix completed by draws from the lattice) and splits the rest
by the first piece that differs. Only the next NEAR places are split one by one; all that differ later are one set, whose mass
is known too, and which is split when it is popped. The first k segmentations are distinct, sampled without replacement. The
value of the (k+1)-th gives each one's inclusion probability.

All draws come from hashes of the row's key, so that results don't depend on partitions or reruns. The model file holds
merge ranks instead of probabilities; piece weights follow Zipf's law in the rank, to the power ``alpha``. Characters
without a piece are spelled in bytes.

Defined results: null and empty texts have one segmentation, without pieces; texts with fewer than k segmentations give all
of them, with inclusion 1; null doc_ids are a key of their own; repeated rows get equal rows; an empty table gives an
empty table. The character U+2581 in a text decodes to a space, as in every SentencePiece model, and round_trip is false.
"""

from __future__ import annotations

import heapq
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix, powers, prefix_hashes, range_hashes

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SCHEMA = "doc_id long, sample int, n_pieces long, log_prob double, score double, log_inclusion double, round_trip boolean, ids array<int>"
CHUNK = 1 << 19
#: Characters of distinct chunks whose lattices are kept.
KEPT = 500_000
#: Places after a changed piece that are sets of their own.
NEAR = 64
#: Steps of a walk that one uniform number drives, by its rest after each choice.
DRIVEN = 4
_STEP, _ROUND, _PLACE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def uniform(key: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1) from 64-bit keys."""
    return ((mix(mix(key)) >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def gumbel(key: np.ndarray) -> np.ndarray:
    return -np.log(-np.log(uniform(key)))


def _ranges(start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """start[0], ..., stop[0] - 1, start[1], and so on."""
    size = (stop - start).astype(np.int64)
    return np.arange(int(size.sum())) + np.repeat(start - (np.cumsum(size) - size), size)


def chunk_hashes(codes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """64-bit hashes of runs of characters from each entry of at to the next: sums of one mixed number for each character at each place."""
    size = np.diff(at)
    place = np.arange(len(codes)) - np.repeat(at[:-1], size)
    total = np.zeros(len(codes) + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(mix((place.astype(np.uint64) << np.uint64(32) | codes) * _STEP + _PLACE), out=total[1:])
        return mix(total[at[1:]] - total[at[:-1]] + size.astype(np.uint64) * _ROUND)


class Model:
    """A SentencePiece model: pieces, weights, and what it takes to cut texts into chunks."""

    def __init__(self, path: str = MODEL, alpha: float = 1.0):
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.text = [sp.id_to_piece(i) for i in range(n)]
        self.byte = {int(t[3:5], 16): i for i, t in enumerate(self.text) if sp.is_byte(i)}
        self.raw = [t.replace("▁", " ").encode() for t in self.text]
        for b, i in self.byte.items():
            self.raw[i] = bytes([b])
        self.bytes = pa.array(self.raw, pa.binary())
        plain = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        score = np.array([sp.get_score(i) for i in plain])
        rank = np.empty(len(plain))
        rank[np.argsort(-score, kind="stable")] = np.arange(1, len(plain) + 1)
        self.weight = np.full(n, -np.inf)
        self.weight[plain] = -alpha * np.log(rank + 2.7)
        self.unknown = float(self.weight[plain].min()) - 10.0
        self.longest = max(len(self.text[i]) for i in plain)
        if any("▁" in self.text[i].lstrip("▁") for i in plain):
            raise ValueError("pieces reach over the start of a word")
        self.alone = not any("\n" in self.text[i] for i in plain)  # line ends are chunks of their own
        codes = np.frombuffer("".join(self.text[i] for i in plain).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
        ends = np.cumsum([len(self.text[i]) for i in plain])
        h = mix(range_hashes(prefix_hashes(codes + np.uint64(1)), np.append(0, ends[:-1]), ends))
        by = np.argsort(h)
        # The last entry ends every search.
        self.hash, self.id = np.append(h[by], np.uint64((1 << 64) - 1)), np.append(np.array(plain, dtype=np.int32)[by], np.int32(-1))
        # Where the hashes with given upper bits begin, and how many there are at most.
        self.near = np.searchsorted(self.hash[:-1] >> np.uint64(44), np.arange(1 << 20, dtype=np.uint64))
        self.crowd = int(np.diff(np.append(self.near, len(plain))).max())
        # Which hashes may begin a piece: a chunk's places are followed only as long as some piece starts that way.
        begins = np.append(0, ends[:-1])
        prefix = prefix_hashes(codes + np.uint64(1))
        self.may = np.zeros(1 << 22, dtype=bool)
        for length in range(1, self.longest + 1):
            some = ends - begins >= length
            self.may[mix(range_hashes(prefix, begins[some], begins[some] + length)) >> np.uint64(42)] = True

    def chunks(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Characters of all texts, each chunk's start (one more entry for the end), and each text's first chunk (likewise).

        A chunk begins with its text, with the first of some spaces, and at and after a line end that no piece holds.
        """
        codes = np.frombuffer("".join(f" {t}" if t else "" for t in texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).copy()
        codes[codes == 0x20] = 0x2581
        at = np.cumsum([0, *(len(t) + 1 if t else 0 for t in texts)])
        space = codes == 0x2581
        begins = space.copy()
        begins[1:] &= ~space[:-1]
        if self.alone:
            ends = codes == 0x0A
            begins |= ends
            begins[1:] |= ends[:-1]
        begins[at[:-1][at[:-1] < at[1:]]] = True
        start = np.flatnonzero(begins)
        return codes, np.append(start, len(codes)), np.searchsorted(start, at)

    @property
    def lattice(self) -> Lattice:
        if not hasattr(self, "_lattice"):
            self._lattice = Lattice(self)
        return self._lattice

    def decode(self, ids) -> str:
        """The text of a sequence of ids: what pieces stand for in UTF-8, end to end."""
        return b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "replace")[1:]


class Lattice:
    """The lattices of distinct chunks, end to end. An edge is a piece at a place; edges stand in order of place, long ones
    first, which are the likely ones.

    log_prob is an edge's probability given its place: the share of all segmentations from there on that begin with it.
    Chunks are kept between slices; when they outgrow KEPT characters, only those seen often stay.
    """

    def __init__(self, model: Model):
        self.model = model
        self.clear()

    def clear(self) -> None:
        # Chunks are known by a hash, in order of it, with their numbers.
        self.known, self.number = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
        self.seen = np.zeros(0, dtype=np.int64)
        self.codes = np.zeros(0, dtype=np.uint32)
        none = np.zeros(0, dtype=np.int32)
        self.start = self.stop = self.end = self.place = self.next = none
        self.ids, self.log_prob, self.opens = none.astype(np.int32), none.astype(np.float64), none.astype(bool)
        self.first, self.upto, self.prob = np.zeros(1, dtype=np.int32), np.zeros(0), np.zeros(0)
        self.spelled: list[list[int]] = []

    def numbers(self, codes: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The number of every chunk, given all chunks' characters and starts; new chunks get their lattices."""
        if len(self.end) > KEPT:
            often = np.flatnonzero(self.seen > 3)
            kept = _ranges(self.start[often], self.stop[often])
            kept, sizes = self.codes[kept], (self.stop - self.start)[often]
            self.clear()
            self.numbers(kept, np.append(0, np.cumsum(sizes)))
        every, first, each = np.unique(chunk_hashes(codes, at), return_index=True, return_inverse=True)
        have = len(self.known)
        to = np.searchsorted(self.known, every)
        new = self.known[np.minimum(to, have - 1)] != every if have else np.ones(len(every), dtype=bool)
        number = np.empty(len(every), dtype=np.int64)
        number[~new] = self.number[to[~new]]
        if new.any():
            come = np.argsort(first[new])  # numbers in order of coming
            rank = np.empty(len(come), dtype=np.int64)
            rank[come] = np.arange(have, have + len(come))
            number[new] = rank
            self.known, self.number = np.insert(self.known, to[new], every[new]), np.insert(self.number, to[new], rank)
            a = first[new][come]
            self.add(codes[_ranges(at[a], at[a + 1])], at[a + 1] - at[a])
            self.seen = np.append(self.seen, np.zeros(len(come), dtype=np.int64))
        out = number[each]
        self.seen += np.bincount(out, minlength=len(self.seen))
        return out

    def add(self, codes: np.ndarray, size: np.ndarray) -> None:
        n, e, spelled = len(self.end), len(self.place), self.spelled
        old = {k: self.__dict__.pop(k) for k in ("start", "stop", "end", "place", "next", "first", "log_prob", "opens", "ids", "upto", "prob")}
        self.spelled = []
        self.build(self.model, codes, size)
        self.codes = np.append(self.codes, codes)
        self.ids = np.where(self.ids < -1, self.ids - len(spelled), self.ids).astype(np.int32)
        self.spelled = spelled + self.spelled
        old["first"] = old["first"][:-1]
        for name, by in (("start", n), ("stop", n), ("end", n), ("place", n), ("next", n), ("first", e)):
            setattr(self, name, np.append(old.pop(name), (getattr(self, name) + by).astype(np.int32)))
        for name in list(old):
            setattr(self, name, np.append(old.pop(name), getattr(self, name)))

    def build(self, model: Model, codes: np.ndarray, size: np.ndarray) -> None:
        self.stop = np.cumsum(size)
        self.start = self.stop - size
        n = len(codes)
        self.end = np.repeat(self.stop, size)
        wide = codes.astype(np.uint64) + np.uint64(1)
        power = powers(model.longest)
        i, h, found = np.arange(n), np.zeros(n, dtype=np.uint64), []
        for length in range(1, model.longest + 1):
            fits = i + length <= self.end[i]
            i = i[fits]
            with np.errstate(over="ignore"):
                h = h[fits] + wide[i + (length - 1)] * power[length - 1]
            mixed = mix(h)
            begun = model.may[mixed >> np.uint64(42)]
            i, h, mixed = i[begun], h[begun], mixed[begun]
            if not len(i):
                break
            at = model.near[mixed >> np.uint64(44)]
            for _ in range(model.crowd):
                at = at + (model.hash[at] < mixed)
            hit = model.hash[at] == mixed
            found.append((i[hit], np.full(int(hit.sum()), length, dtype=np.int64), model.id[at[hit]]))
        single = np.zeros(n, dtype=bool)
        if found:
            single[found[0][0]] = True
        other, ids, weights = np.flatnonzero(~single), [], []
        for c in codes[other].tolist():
            b = [model.byte[x] for x in chr(c).encode("utf-8", "replace")]
            weights.append(model.unknown * len(b))
            if len(b) == 1:
                ids.append(b[0])
            else:
                self.spelled.append(b)
                ids.append(-1 - len(self.spelled))
        found.append((other, np.ones(len(other), dtype=np.int64), np.array(ids, dtype=np.int32)))
        place, length, ids = (np.concatenate(x) for x in zip(*found, strict=True))
        weight = model.weight[np.maximum(ids, 0)]
        weight[len(weight) - len(other) :] = weights
        # Backward sums, all chunks at once, by distance from the chunk's end; ends have slots of their own.
        slot = np.arange(n) + np.repeat(np.arange(len(size)), size)
        beta = np.zeros(n + len(size))
        left = self.end - np.arange(n)
        # Edges came by length, so counting gives every edge its rank at its place, a spelled one last, and no edges are sorted.
        many, nth = np.zeros(n, dtype=np.int64), []
        for i, _, _ in found:
            nth.append(many[i])
            many[i] += 1
        nth, every = np.concatenate(nth), np.arange(len(place))
        near = np.argsort(left.astype(np.uint16) if n < 1 << 16 or left.max() < 1 << 16 else left, kind="stable")
        begun, by = np.zeros(n, dtype=np.int64), np.empty_like(every)
        begun[near] = np.cumsum(many[near]) - many[near]
        by[begun[place] + nth] = every
        far, at, ahead, w = left[place[by]], slot[place[by]], slot[place[by]] + length[by], weight[by]
        cut = np.searchsorted(far, np.arange(1, int(far.max(initial=0)) + 2))
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            x, to = w[a:b] + beta[ahead[a:b]], at[a:b]
            new = np.flatnonzero(np.append(True, to[1:] != to[:-1]))
            top = np.maximum.reduceat(x, new)
            beta[to[new]] = top + np.log(np.add.reduceat(np.exp(x - np.repeat(top, np.diff(np.append(new, b - a)))), new))
        lp = np.minimum(w + beta[ahead] - beta[at], 0.0)
        each = np.empty(len(by))
        each[by] = lp
        # By place, long ones first: a spelled one is of one character, so it comes last here too.
        nth += ~single[place]
        nth[len(nth) - len(other) :] = 0
        self.first = np.append(0, np.cumsum(many))
        by[self.first[place] + many[place] - 1 - nth] = every
        self.place, self.next, self.ids, self.log_prob = place[by], (place + length)[by], ids[by], each[by]
        opens = np.zeros(n, dtype=bool)
        opens[self.start] = True
        self.opens = opens[self.place]
        rank = np.arange(len(by)) - self.first[self.place]
        # Sums of probabilities up to each edge of a place; the last edge takes what is left.
        self.prob = np.exp(self.log_prob)
        self.upto = self.prob.copy()
        for r in range(1, int(rank.max(initial=0)) + 1):
            i = np.flatnonzero(rank == r)
            self.upto[i] += self.upto[i - 1]
        self.upto[self.first[1:] - 1] = 2.0

    def others(self, edge: int, shut: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
        """The edges at an edge's place that are not shut, and their probabilities."""
        e = np.arange(self.first[self.place[edge]], self.first[self.place[edge] + 1])
        for x in shut:
            e = e[e != x]
        return e, self.prob[e]

    def walk(self, start: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Draw a path from each start to its chunk's end: the number of its pieces, and the edges of all, walk by walk."""
        live, now, step, u = np.arange(len(start)), start, 0, np.zeros(0)
        count, out = np.zeros(len(start), dtype=np.int64), []
        while len(live):
            if step % DRIVEN == 0:
                with np.errstate(over="ignore"):
                    u = uniform(key[live] + np.uint64(step) * _STEP)
            e = self.first[now]
            low = np.zeros(len(e))
            on = np.flatnonzero(u > self.upto[e])
            while len(on):
                low[on] = self.upto[e[on]]
                e[on] += 1
                on = on[u[on] > self.upto[e[on]]]
            out.append((live, e))
            after = self.next[e]
            on = np.flatnonzero(after < self.end[now])
            count[live] = step + 1
            e = e[on]
            # The last edge of a place has no more than what is left.
            u = np.clip((u[on] - low[on]) / self.prob[e], 0.0, 1.0)
            live, now, step = live[on], after[on], step + 1
        begin = np.cumsum(count) - count
        edges = np.empty(int(count.sum()), dtype=np.int32)
        for n, (live, e) in enumerate(out):
            edges[begin[live] + n] = e
        return count, edges

    def spell(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids with spelled characters in bytes, and how many ids came of each."""
        many = np.ones(len(ids), dtype=np.int64)
        odd = np.flatnonzero(ids < 0)
        if not len(odd):
            return ids, many
        words = [self.spelled[-2 - x] for x in ids[odd].tolist()]
        many[odd] = list(map(len, words))
        out = np.repeat(ids, many)
        out[np.repeat(ids < 0, many)] = list(chain.from_iterable(words))
        return out, many


class _Text:
    """The search of one text: what is left to pop, and where each of its paths stands (round, begin, end)."""

    __slots__ = ("heap", "paths")

    def __init__(self):
        self.heap: list[tuple] = []  # (-value, round, place, near or rest, shut)
        self.paths: list[tuple[int, int]] = []


def rounds(model: Model, texts: list[str], keys: np.ndarray, k: int) -> tuple[list[tuple], np.ndarray]:
    """For each sample 1..k (texts, log_prob, score, ids, ids of each text), and each text's (k+1)-th value."""
    lattice = model.lattice
    codes, at, first = model.chunks(texts)
    occ = lattice.numbers(codes, at)
    begin = lattice.start[occ]
    found = [_Text() for _ in texts]
    taken: list[np.ndarray] = []  # the edges of each round's paths
    out = []
    todo: list[tuple[int, float, tuple | None]] = [(d, v, None) for d, v in enumerate(gumbel(keys).tolist())]  # the set of all segmentations: location 0
    for r in range(1, k + 1):
        if not todo:
            break
        # What each path keeps of its parent's, and where this round's draws start: what is left of the chunk of the changed piece, and all chunks after it.
        heads, starts, offs, shuts = [], [], [], []
        for d, _, node in todo:
            o = int(first[d])
            if node is None:
                heads.append(np.zeros(0, dtype=np.int64))
                shuts.append(())
                offs.append(0)
            else:
                parent, t, shut = node
                a, _ = found[d].paths[parent]
                kept = taken[parent][a : a + t + 1]
                some, left = lattice.others(int(kept[t]), shut)
                with np.errstate(over="ignore"):
                    u = uniform(keys[d : d + 1] + np.uint64(r) * _ROUND + _PLACE)[0]
                sums = np.cumsum(left)
                e = int(some[min(np.searchsorted(sums, u * sums[-1]), len(some) - 1)])
                heads.append(np.append(kept[:t], e))
                shuts.append((*shut, e))
                place, after = lattice.place[e], lattice.next[e]
                o += int(np.count_nonzero(lattice.opens[kept]))  # chunks that the kept pieces have begun
                inside = after < lattice.end[place]
                if inside:
                    starts.append(np.array([after]))
                offs.append(o - int(first[d]) - int(inside))
            starts.append(begin[o : first[d + 1]])
        docs = np.array([d for d, _, _ in todo])
        offs = np.array(offs)
        size = first[docs + 1] - first[docs] - offs
        start = np.concatenate(starts)
        of = np.repeat(np.arange(len(todo)), size)
        nth = np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size) + offs[of]
        with np.errstate(over="ignore"):
            key = keys[docs][of] + np.uint64(r) * _ROUND + (nth + 1).astype(np.uint64) * _PLACE
        count, drawn = lattice.walk(start, key)
        tail = np.bincount(of, count, len(todo)).astype(np.int64)
        head = np.array(list(map(len, heads)), dtype=np.int64)
        total = head + tail
        ends = np.cumsum(total)
        begins = ends - total
        edges = np.empty(int(ends[-1]) if len(ends) else 0, dtype=np.int32)
        is_head = np.zeros(len(edges), dtype=bool)
        if head.any():
            at = np.repeat(begins, head) + np.arange(int(head.sum())) - np.repeat(np.cumsum(head) - head, head)
            edges[at] = np.concatenate(heads)
            is_head[at] = True
        edges[~is_head] = drawn
        taken.append(edges)
        lp = lattice.log_prob[edges]
        # Sums run within one text only, so that results don't depend on its neighbours.
        sums = [float(lp[a:b].sum()) for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]
        for x, (d, _, _) in enumerate(todo):
            found[d].paths.append((int(begins[x]), int(ends[x])))
        changed = np.array([-1 if node is None else node[1] for _, _, node in todo])
        _split(lattice, keys, r, [(found[d], d, v) for d, v, _ in todo], lp, begins, ends, changed, np.maximum(changed, 0), sums, shuts, k)
        ids, many = lattice.spell(lattice.ids[edges])
        n_ids = total if len(ids) == len(edges) else np.add.reduceat(np.append(many, 0), np.minimum(begins, len(many))) * (total > 0)
        out.append((docs, np.array(sums), np.array([v for _, v, _ in todo]), ids, n_ids))
        todo = []
        for d in docs.tolist():
            if (node := _popped(lattice, keys, found[d], d, taken, k)) is not None:
                todo.append((d, *node))
    kappa = np.full(len(texts), -np.inf)
    for d, v, _ in todo:
        kappa[d] = v
    return out, kappa


def _split(lattice: Lattice, keys: np.ndarray, r: int, owners: list, lp: np.ndarray, begins: np.ndarray, ends: np.ndarray, changed: np.ndarray, place: np.ndarray, sums: list[float], shuts: list, k: int) -> None:
    """Put the sets on the heaps that share a path of round r up to a place and differ there, from the changed piece on."""
    lane = np.arange(NEAR)
    at = (begins + place)[:, None] + lane
    inside = at < ends[:, None]
    own = np.where(inside, lp[np.minimum(at, max(len(lp) - 1, 0))], 0.0) if len(lp) else np.zeros(at.shape)
    upto = np.array([float(lp[a : a + t].sum()) for a, t in zip(begins.tolist(), place.tolist(), strict=True)])
    before = upto[:, None] + np.cumsum(own, axis=1)  # after each place
    with np.errstate(divide="ignore", over="ignore"):
        mass = np.where(inside, before - own + np.log(np.maximum(-np.expm1(own), 0.0)), -np.inf)
        for x in np.flatnonzero(changed >= 0).tolist():
            mass[x, 0] = upto[x] + np.log(lattice.others(shuts[x][-1], shuts[x])[1].sum())
        # All that differ later: what the places up to there leave, less the path itself.
        rest = np.minimum(np.array(sums) - before[:, -1], 0.0)
        last = before[:, -1] + np.where(begins + place + NEAR < ends, np.log(np.maximum(-np.expm1(rest), 0.0)), -np.inf)
        mass = np.column_stack([mass, last])
        base = keys[[d for _, d, _ in owners]] + np.uint64(r) * _STEP
        nth = (place[:, None] + np.arange(NEAR + 1) + 1).astype(np.uint64)
        salt = nth * _ROUND
        salt[:, -1] = nth[:, -1] * _PLACE + _ROUND
        best = np.array([v for _, _, v in owners])[:, None]
        value = np.where(np.isneginf(mass), np.inf, np.logaddexp(-best, -(mass + gumbel(base[:, None] + salt))))  # negated; truncated at the value of the set that it comes from
    few = np.argsort(value, axis=1, kind="stable")[:, : k + 1]
    for x, (text, _, _) in enumerate(owners):
        for i in few[x].tolist():
            if value[x, i] < np.inf:
                heapq.heappush(text.heap, (float(value[x, i]), r, int(place[x]) + i, i == NEAR, shuts[x] if i == 0 and changed[x] >= 0 else ()))


def _popped(lattice: Lattice, keys: np.ndarray, text: _Text, d: int, taken: list[np.ndarray], k: int) -> tuple[float, tuple] | None:
    """The best set's value and (path, place, shut edges). A set of all that differ later is split first: its value goes to one of its parts, by mass."""
    while text.heap:
        value, r, t, is_rest, shut = heapq.heappop(text.heap)
        a, b = text.paths[r - 1]
        path = taken[r - 1][a:b]
        if not is_rest:
            return -value, (r - 1, t, shut or (int(path[t]),))
        lp = lattice.log_prob[path]
        upto = min(len(path), t + max(NEAR, t))
        before = np.cumsum(lp) - lp
        with np.errstate(divide="ignore", over="ignore"):
            mass = before[t:upto] + np.log(np.maximum(-np.expm1(lp[t:upto]), 0.0))
            later = min(float(lp[upto:].sum()), 0.0)
            mass = np.append(mass, before[upto] + np.log(max(-np.expm1(later), 0.0)) if upto < len(path) else -np.inf)
            nth = np.arange(t + 1, upto + 2).astype(np.uint64)
            salt = keys[d] + np.uint64(r) * _STEP + nth * _ROUND
            salt[-1] = keys[d] + np.uint64(r) * _STEP + nth[-1] * _PLACE + _ROUND
            g = mass + gumbel(salt)
            # Gumbel-max picks the part that has the set's value; the others' are truncated by it.
            pick = int(np.argmax(mass + gumbel(salt ^ _PLACE)))
            values = np.where(np.isneginf(mass), np.inf, np.logaddexp(value, -g))
        values[pick] = value
        for i in np.argsort(values, kind="stable")[: k + 1].tolist():
            if values[i] < np.inf:
                heapq.heappush(text.heap, (float(values[i]), r, t + i, t + i == upto, ()))
    return None


def inclusion(log_prob: np.ndarray, kappa: np.ndarray) -> np.ndarray:
    """Log probability that a segmentation's perturbed value is above kappa."""
    z = log_prob - kappa
    with np.errstate(divide="ignore", over="ignore", invalid="ignore"):
        return np.where(np.isneginf(kappa), 0.0, np.where(z < -30, z, np.log(-np.expm1(-np.exp(np.minimum(z, 700.0))))))


def sample(model: Model, texts: list[str], keys: np.ndarray, k: int) -> list[list[tuple[float, float, float, np.ndarray]]]:
    """For each text up to k (log_prob, score, log_inclusion, ids), best score first."""
    found, kappa = rounds(model, texts, keys, k)
    out: list[list] = [[] for _ in texts]
    for docs, total, score, ids, n in found:
        ends = np.cumsum(n)
        for d, t, v, i, a, b in zip(docs.tolist(), total.tolist(), score.tolist(), inclusion(total, kappa[docs]).tolist(), (ends - n).tolist(), ends.tolist(), strict=True):
            out[d].append((t, v, i, ids[a:b]))
    return out


_models: dict[tuple[str, float], Model] = {}


def sampled_pieces(docs: DataFrame, k: int = 3, model_file: str = MODEL, alpha: float = 1.0, seed: int = 1) -> DataFrame:
    """Up to k rows for every document: doc_id, sample (1 is best), n_pieces, log_prob, score (perturbed), log_inclusion, round_trip and ids."""

    def rows(batches):
        if (model_file, alpha) not in _models:
            _models[model_file, alpha] = Model(model_file, alpha)
        model = _models[model_file, alpha]
        for batch in batches:
            ids, keys = batch["doc_id"], batch["key"].to_numpy().view(np.uint64)
            ends = np.cumsum(pc.utf8_length(batch["text"]).fill_null(0).to_numpy(zero_copy_only=False))
            a = 0
            while a < len(ends):
                b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + CHUNK, side="right")))
                texts = [x or "" for x in batch["text"].slice(a, b - a).to_pylist()]
                found, kappa = rounds(model, texts, keys[a:b], k)
                own = pa.array([("" if t == "" else " " + t).encode() for t in texts], pa.binary())
                for n, (at, total, score, pieces, many) in enumerate(found, 1):
                    bounds = pa.array(np.append(0, np.cumsum(many)), pa.int32())
                    said = pc.binary_join(pa.ListArray.from_arrays(bounds, model.bytes.take(pa.array(pieces))), b"")
                    columns = [ids.take(pa.array(at + a)), pa.array(np.full(len(at), n, dtype=np.int32)), pa.array(many), pa.array(total), pa.array(score), pa.array(inclusion(total, kappa[at])), pc.equal(said, own.take(pa.array(at)))]
                    yield pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(bounds, pa.array(pieces, pa.int32()))], names=[x.split()[0] for x in SCHEMA.split(", ")])
                a = b

    return docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64(F.lit(seed), "doc_id").alias("key")).mapInArrow(rows, SCHEMA)


def decoded(pieces: DataFrame, model_file: str = MODEL) -> DataFrame:
    """doc_id, sample and the text of ids, from rows of sampled_pieces()."""

    def rows(batches):
        if (model_file, 1.0) not in _models:
            _models[model_file, 1.0] = Model(model_file)
        for batch in batches:
            texts = [None if x is None else _models[model_file, 1.0].decode(x) for x in batch["ids"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["sample"], pa.array(texts, pa.string())], names=["doc_id", "sample", "text"])

    return pieces.select("doc_id", "sample", "ids").mapInArrow(rows, "doc_id long, sample int, text string")
