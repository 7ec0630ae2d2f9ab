"""SentencePiece encoding and decoding: distinct sampled segmentations by Gumbel top-k without replacement.

All ways to cut a text into the model's pieces form a lattice; each has a probability by the weights of its
pieces. A search over sets of segmentations, best first by perturbed log-mass, yields k of them in the order of
their perturbed log-probabilities, which makes them a sample without replacement. A set is all segmentations
with a common beginning, less some of its continuations; the perturbed value of a set is that of its best
member, so it bounds the rest (the heuristic of the A* search is exact). Taking a set from the queue fixes a
member: a fresh walk through the lattice; what the walk leaves aside at each step goes back to the queue.
Everything random follows from the row's key. The inclusion score of a sample is the probability that it
exceeds the perturbed value of the next one that wasn't taken.

Spaces stand in pieces as they do in the text, and characters without a piece become their bytes' pieces; so
decoding gives the text back whatever it holds.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prosemill.llm.common import col, mixed, slices

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SAMPLES = 2
#: How strongly frequent pieces are preferred: the exponent of a piece's rank. The more, the less varied.
SHARPNESS = 1.0
#: Texts go through the lattice in groups of so many bytes, or alone if longer.
GROUP_BYTES = 100_000
#: New units are added in parts of so many characters, or alone if longer.
PART_CHARS = 20_000
#: A worker's cache of lattices is begun anew beyond so many edges. These three bound what a worker needs, as executors
#: of long jobs have little memory left beside their JVM.
MOST_EDGES = 500_000
#: Steps of a segmentation whose alternatives the search weighs singly.
STEPS = 64
#: A choice of a log-probability above this leaves nothing aside.
SURE = -1e-12
MARK = "▁"


@dataclass(frozen=True)
class Pieces:
    """text and log-weight of each piece that a text can hold, and the pieces of the 256 bytes."""

    size: int
    ids: dict[str, int]
    weights: np.ndarray
    byte_ids: tuple[int, ...]

    @property
    def table(self) -> list[bytes]:
        out = [b""] * self.size
        for text, i in self.ids.items():
            out[i] = text.encode()
        for b, i in enumerate(self.byte_ids):
            out[i] = bytes([b])
        return out


def load_pieces(path: str = MODEL, sharpness: float = SHARPNESS) -> Pieces:
    """The pieces of a model with byte pieces. Models with ranks for scores (BPE) get weights by Zipf's law."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.vocab_size()
    special = [model.is_control(i) or model.is_unknown(i) or model.is_unused(i) for i in range(n)]
    byte_ids = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
    if not all(model.is_byte(i) for i in byte_ids):
        raise ValueError("the model has no byte pieces")
    ids = {model.id_to_piece(i).replace(MARK, " "): i for i in range(n) if not special[i] and not model.is_byte(i)}
    score = np.array([model.get_score(i) for i in range(n)])
    ranked = score.min() < -100
    weights = -sharpness * np.log(2 + np.minimum(-score, n)) if ranked else sharpness * score
    weights[byte_ids] = -sharpness * np.log(2 + n) if ranked else score.min()
    return Pieces(n, ids, weights, tuple(byte_ids))


class Lattices:
    """Lattices of units of text, side by side in arrays. A unit's nodes are the places between its characters.

    Edges are sorted by node, long ones first, as these are likely; upto is the probability of an edge and those
    before it. The arrays have room to grow at their ends.
    """

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        # a trie: state 0 is the root; moves are sorted (state, character) pairs
        states, moves = {"": 0}, {}
        for text in pieces.ids:
            for k in range(len(text)):
                if text[: k + 1] not in states:
                    states[text[: k + 1]] = len(states)
                moves[states[text[:k]] << 21 | ord(text[k])] = states[text[: k + 1]]
        order = sorted(moves)
        self.moves, self.to = np.array(order, np.int64), np.array([moves[m] for m in order], np.int64)
        self.final = np.full(len(states), -1, np.int64)
        for text, i in pieces.ids.items():
            self.final[states[text]] = i
        # where no piece reaches across, a text can be cut: before spaces, and around line feeds
        safe = not any(" " in t.lstrip(" ") or ("\n" in t and t != "\n") for t in pieces.ids)
        self.unit = re.compile(" +[^ \n]*|[^ \n]+|\n" if safe else ".+", re.S)
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.nodes = self.edges = 0
        self.upto, self.logp = np.empty(1 << 16), np.empty(1 << 16)
        self.dest, self.piece = np.empty(1 << 16, np.int32), np.empty(1 << 16, np.int32)
        self.first_edge, self.end = np.zeros(1 << 14, np.int64), np.empty(1 << 14, np.int64)

    def _put(self, name: str, at: int, values: np.ndarray) -> None:
        room = getattr(self, name)
        if at + len(values) > len(room):
            more = np.empty(max(2 * len(room), at + len(values)), room.dtype)
            more[:at] = room[:at]
            setattr(self, name, room := more)
        room[at : at + len(values)] = values

    def add(self, units: list[str]) -> None:
        """Lattices of new units (distinct, not empty)."""
        sizes = np.array([len(u) for u in units])
        base = np.cumsum(sizes + 1) - sizes - 1  # a unit's first node
        chars = np.frombuffer("\0".join([*units, ""]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        n = len(chars)
        end = np.repeat(base + sizes, sizes + 1)
        source, dest, piece = [], [], []
        at, state, length = np.flatnonzero(np.arange(n) < end), None, 0
        state = np.zeros(len(at), np.int64)
        single = np.full(n, False)
        while len(at):
            move = state << 21 | chars[at + length]
            k = np.minimum(np.searchsorted(self.moves, move), len(self.moves) - 1)
            ok = self.moves[k] == move
            at, state, length = at[ok], self.to[k[ok]], length + 1
            found = self.final[state] >= 0
            source.append(at[found]), dest.append(at[found] + length), piece.append(self.final[state[found]])
            if length == 1:
                single[at[found]] = True
            go = at + length < end[at]
            at, state = at[go], state[go]
        other = np.flatnonzero(~single & (np.arange(n) < end))  # by its bytes; of several, the character stands for them
        code = chars[other]
        source.append(other), dest.append(other + 1)
        piece.append(np.where(code < 128, np.array(self.pieces.byte_ids)[np.minimum(code, 127)], -1 - code))
        s, d, p = (np.concatenate(x[::-1]) for x in (source, dest, piece))
        order = np.argsort(s, kind="stable")  # long pieces first; each length is sorted already
        s, d, p = s[order], d[order], p[order]
        weight = self.pieces.weights[np.maximum(p, 0)]
        byte = p < 0
        if byte.any():
            weight[byte] = self.pieces.weights[self.pieces.byte_ids[0]] * _utf8_sizes(-1 - p[byte])
        first = np.searchsorted(s, np.arange(n + 1))
        # mass of what can follow a node, from the units' ends backwards
        beyond, from_end = np.zeros(n), end - np.arange(n)
        by_place = np.argsort(from_end, kind="stable")
        bounds = np.searchsorted(from_end[by_place], np.arange(1, sizes.max(initial=0) + 2))
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            nodes = by_place[a:b]
            count = first[nodes + 1] - first[nodes]
            edge = np.repeat(first[nodes] - np.cumsum(count) + count, count) + np.arange(count.sum())
            value, starts = weight[edge] + beyond[d[edge]], np.cumsum(count) - count
            top = np.maximum.reduceat(value, starts)
            beyond[nodes] = top + np.log(np.add.reduceat(np.exp(value - np.repeat(top, count)), starts))
        logp = weight + beyond[d] - beyond[s]
        total = np.cumsum(np.exp(logp))
        before = np.where(first[s] > 0, total[first[s] - 1], 0.0)
        upto = total - before
        upto[first[1:][np.diff(first) > 0] - 1] = 1.0
        self.known.update(zip(units, (base + self.nodes).tolist(), strict=True))
        for name, values in (("upto", upto), ("logp", logp), ("dest", d + self.nodes), ("piece", p)):
            self._put(name, self.edges, values)
        self._put("first_edge", self.nodes + 1, first[1:] + self.edges)
        self._put("end", self.nodes, end + self.nodes)
        self.nodes, self.edges = self.nodes + n, self.edges + len(s)

    def walk(self, node: np.ndarray, seed: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sampled ways from these nodes to their units' ends: lanes and edges, in order.

        The number that decides at a node follows from seed and place plus the characters gone since.
        """
        lanes, edges, steps = [], [], []
        lane, now, step = np.flatnonzero(node < self.end[node]), node, 0
        now, s, at = node[lane], seed[lane], place[lane]
        while len(lane):
            e, u = self.first_edge[now], uniform(s, at)
            more = np.flatnonzero(u >= self.upto[e])
            while len(more):
                e[more] = np.minimum(e[more] + 1, self.first_edge[now[more] + 1] - 1)
                more = more[(u[more] >= self.upto[e[more]]) & (e[more] + 1 < self.first_edge[now[more] + 1])]
            lanes.append(lane), edges.append(e), steps.append(np.full(len(lane), step))
            gone = self.dest[e].astype(np.int64)
            at, now = at + (gone - now), gone
            go = now < self.end[now]
            lane, now, s, at, step = lane[go], now[go], s[go], at[go], step + 1
        if not lanes:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        every, edge, order = (np.concatenate(x) for x in (lanes, edges, steps))
        count = np.bincount(every, minlength=len(node))
        where = (np.cumsum(count) - count)[every] + order
        out_lane, out_edge = np.empty(len(every), np.int64), np.empty(len(every), np.int64)
        out_lane[where], out_edge[where] = every, edge
        return out_lane, out_edge

    def ids(self, edges: np.ndarray) -> np.ndarray:
        found = self.piece[edges]
        if not (found < 0).any():
            return found
        parts: list[int] = []
        for p in found.tolist():
            parts += [p] if p >= 0 else [self.pieces.byte_ids[b] for b in chr(-1 - p).encode("utf-8", "surrogatepass")]
        return np.array(parts, np.int32)


def _utf8_sizes(codes: np.ndarray) -> np.ndarray:
    return 1 + (codes > 0x7F) + (codes > 0x7FF) + (codes > 0xFFFF)


def uniform(seed: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Numbers over 0 and under 1."""
    x = mixed(seed + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return ((x >> np.uint64(12)).astype(np.float64) + 0.5) / float(1 << 52)


def below(mass: np.ndarray, bound: float, u: np.ndarray) -> np.ndarray:
    """Perturbed values of sets of these log-masses, given that they don't exceed bound."""
    with np.errstate(divide="ignore", over="ignore"):
        return mass - np.log(np.exp(mass - bound) - np.log(u))


SALT = 0xD1B54A32D192ED03
WORD = (1 << 64) - 1


def _one(seed: int, place: int) -> float:
    """uniform() of a single number."""
    x = (seed + place * 0x9E3779B97F4A7C15) & WORD
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & WORD
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB & WORD
    return (((x ^ (x >> 31)) >> 12) + 0.5) / float(1 << 52)


def _below(mass: float, bound: float, u: float) -> float:
    return mass - math.log(math.exp(mass - bound) - math.log(u))


class Search:
    """The queue of one text. A path: edges, the units they lie in, and log-probabilities before each and at the end."""

    def __init__(self, lattices: Lattices, seed: int, k: int):
        self.lattices, self.salt, self.k = lattices, seed ^ SALT, k
        self.queue: list[tuple] = []
        self.paths: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.found: list[float] = []
        self.draws = 0

    def draw(self) -> float:
        self.draws += 1
        return _one(self.salt, self.draws - 1)

    def put(self, path: int, step: int, gone: tuple[int, ...], value: float) -> None:
        """A set: what has path's edges before step and none of gone there; without gone, what leaves path later."""
        if value > -math.inf:
            heapq.heappush(self.queue, (-value, len(self.queue), self.draws, path, step, gone))

    def next(self) -> tuple[int, int, int, float] | None:
        """Of the best set: its path, the step at which it leaves it, the edge it takes there, its value."""
        if not self.queue:
            return None
        value, _, _, path, step, gone = heapq.heappop(self.queue)
        edges, _, before = self.paths[path]
        if not gone:  # the step at which the best member leaves, by the masses; the others are sets of their own
            logp = self.lattices.logp[edges[step:]]
            with np.errstate(divide="ignore"):
                mass = np.where(logp > SURE, -np.inf, before[step:-1] + np.log(-np.expm1(np.minimum(logp, 0.0))))
            share = np.cumsum(np.exp(mass - mass.max()))
            k = int(min(np.searchsorted(share, self.draw() * share[-1], side="right"), len(mass) - 1))
            places = np.arange(self.draws, self.draws + len(mass))
            self.draws += len(mass)
            others = below(mass, -value, uniform(np.full(len(mass), self.salt, np.uint64), places))
            others[k] = -np.inf
            for t in np.argsort(-others)[: self.k + 1 - len(self.found)].tolist():
                self.put(path, step + t, (int(edges[step + t]),), float(others[t]))
            step, gone = step + k, (int(edges[step + k]),)
        first = self.lattices.first_edge
        node = int(np.searchsorted(first[: self.lattices.nodes + 1], edges[step], side="right")) - 1
        a, b = int(first[node]), int(first[node + 1])
        left = [e for e in range(a, b) if e not in gone]
        p = [math.exp(x) for e, x in enumerate(self.lattices.logp[a:b].tolist(), a) if e not in gone]
        at, total = self.draw() * sum(p), 0.0
        chosen = len(left) - 1
        for i, x in enumerate(p):
            total += x
            if at < total:
                chosen = i
                break
        rest, u = sum(x for i, x in enumerate(p) if i != chosen), self.draw()
        if rest > 0:
            self.put(path, step, (*gone, left[chosen]), _below(float(before[step]) + math.log(rest), -value, u))
        return path, step, left[chosen], -value

    @property
    def bound(self) -> float:
        return -self.queue[0][0] if self.queue else -np.inf


def take(searches: list[Search], edges: np.ndarray, units: np.ndarray, cut: np.ndarray, since: np.ndarray, values: np.ndarray) -> None:
    """A segmentation for each search, between its cuts of edges; all searches have found equally many so far.

    What it leaves aside from step since on joins the search's queue, as far as it can be taken. What it leaves
    aside after STEPS steps is one set for now; its mass is small as a rule.
    """
    lattices, most = searches[0].lattices, searches[0].k - len(searches[0].found)
    logp = lattices.logp[edges]
    sums = np.concatenate([[0.0], np.cumsum(logp)])
    sizes = np.diff(cut)
    until = np.minimum(sizes, since + STEPS)
    column = np.arange(int((until - since).max(initial=0)))
    at = np.minimum((cut[:-1] + since)[:, None] + column, max(0, len(edges) - 1))
    inside = column < (until - since)[:, None]
    salts = np.array([s.salt for s in searches], np.uint64)
    draws = np.array([s.draws for s in searches])
    start, end = sums[cut[:-1]], sums[cut[1:]]
    if at.size:
        own = logp[at]
        with np.errstate(divide="ignore"):
            mass = sums[at] - start[:, None] + np.log(-np.expm1(np.minimum(own, 0.0)))
        mass[~inside | (own > SURE)] = -np.inf
        found = below(mass, values[:, None], uniform(salts[:, None], draws[:, None] + column))
        best = np.argpartition(-found, most - 1, 1)[:, :most] if most < found.shape[1] else np.broadcast_to(column, found.shape)
        scores = np.take_along_axis(found, best, 1).tolist()
        best = best.tolist()
    rest = end - sums[cut[:-1] + until]
    with np.errstate(divide="ignore"):
        tail = np.where(rest < SURE, sums[cut[:-1] + until] - start + np.log(-np.expm1(np.minimum(rest, 0.0))), -np.inf)
    tails = below(tail, values, uniform(salts, draws + len(column))).tolist()
    for i, s in enumerate(searches):
        a, b, path = int(cut[i]), int(cut[i + 1]), len(s.paths)
        s.paths.append((edges[a:b], units[a:b], sums[a : b + 1] - sums[a]))
        s.found.append(float(values[i]))
        s.draws += len(column) + 1
        if at.size:
            for t, value in zip(best[i], scores[i], strict=True):
                if value > -math.inf:
                    step = int(since[i]) + t
                    s.put(path, step, (int(edges[a + step]),), value)
        s.put(path, int(until[i]), (), tails[i])


def groups(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges that cover all places in order; a range of more than one has a sum of at most `most`."""
    ends = np.cumsum(sizes)
    a = 0
    while a < len(ends):
        b = max(a + 1, int(np.searchsorted(ends, ends[a] - sizes[a] + most, side="right")))
        yield a, b
        a = b


def sample(lattices: Lattices, texts: list[str], seeds: np.ndarray, k: int) -> list[list[tuple[np.ndarray, float, float, float]]]:
    """For each text its samples: ids, log-probability, perturbed value and log inclusion probability."""
    units = [lattices.unit.findall(" " + t) if t else [] for t in texts]
    if lattices.edges > MOST_EDGES:  # no path of an earlier group is still in use
        lattices.clear()
    flat = list(chain.from_iterable(units))
    first_nodes = list(map(lattices.known.get, flat))
    if None in first_nodes:
        unknown = [i for i, x in enumerate(first_nodes) if x is None]
        new = list(dict.fromkeys(flat[i] for i in unknown))
        for a, b in groups(np.array([len(u) for u in new]), PART_CHARS):
            lattices.add(new[a:b])
        for i in unknown:
            first_nodes[i] = lattices.known[flat[i]]
    nodes = np.array(first_nodes, np.int64)
    sizes = lattices.end[nodes] - nodes
    counts = np.array([len(us) for us in units])
    starts = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
    gone = np.concatenate([[0], np.cumsum(sizes)])
    place = gone[:-1] - np.repeat(gone[starts[:-1]], counts)
    searches = [Search(lattices, int(s), k) for s in seeds]
    lane, edge = lattices.walk(nodes, np.repeat(seeds, counts), place)
    cut = np.searchsorted(lane, starts)
    values = np.array([-math.log(-math.log(s.draw())) for s in searches])
    if searches:
        take(searches, edge, lane - np.repeat(starts[:-1], np.diff(cut)), cut, np.zeros(len(searches), np.int64), values)
    for turn in range(1, k):
        wanted = [(i, x) for i, s in enumerate(searches) if (x := s.next())]
        if not wanted:
            break
        paths = [searches[i].paths[x[0]] for i, x in wanted]
        unit = np.array([path[1][x[1]] for (_, x), path in zip(wanted, paths, strict=True)])
        doc = np.array([i for i, _ in wanted])
        chosen = np.array([x[2] for _, x in wanted])
        count = starts[doc + 1] - starts[doc] - unit  # the units to walk through, from where the path is left
        heads = np.cumsum(count) - count
        own = np.arange(count.sum()) + np.repeat(starts[doc] + unit - heads, count)
        first, where = nodes[own], place[own]
        where[heads] += lattices.dest[chosen] - first[heads]
        first[heads] = lattices.dest[chosen]
        lane, edge = lattices.walk(first, np.repeat(mixed(seeds[doc] + np.uint64(turn)), count), where)
        parts = np.searchsorted(lane, np.append(heads, len(own)))
        lane = lane - np.repeat(heads - unit, np.diff(parts))
        edges, units_, since = [], [], []
        for j, ((_, (_, step, e, _)), (old, old_units, _)) in enumerate(zip(wanted, paths, strict=True)):
            edges += [old[:step], chosen[j : j + 1], edge[parts[j] : parts[j + 1]]]
            units_ += [old_units[:step], unit[j : j + 1], lane[parts[j] : parts[j + 1]]]
            since.append(step + 1)
        sizes = np.array([len(x) for x in edges]).reshape(-1, 3).sum(1)
        take([searches[i] for i, _ in wanted], np.concatenate(edges), np.concatenate(units_), np.concatenate([[0], np.cumsum(sizes)]), np.array(since), np.array([x[3] for _, x in wanted]))
    out = []
    for search in searches:
        bound, rows = search.bound, []
        for (edges, _, before), value in zip(search.paths, search.found, strict=True):
            inclusion = 0.0
            if bound > -math.inf:
                x = -math.exp(min(700.0, float(before[-1]) - bound))
                inclusion = math.log(-math.expm1(x)) if x < 0 else -math.inf
            rows.append((lattices.ids(edges), float(before[-1]), value, inclusion))
        out.append(rows)
    return out


def decode(table: list[bytes], ids: list[int]) -> bytes:
    """The text in UTF-8 of these pieces: the space that encoding puts first goes."""
    return b"".join(map(table.__getitem__, ids))[1:]


class Decoder:
    """decode() for the pieces of many texts at once."""

    def __init__(self, table: list[bytes]):
        self.sizes = np.array([len(x) for x in table])
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.bytes = np.frombuffer(b"".join(table), np.uint8)

    def decode(self, pieces: list[np.ndarray]) -> list[bytes]:
        ids = np.concatenate(pieces)
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        flat = self.bytes[np.repeat(self.starts[ids] - ends + sizes, sizes) + np.arange(int(ends[-1]) if len(ends) else 0)].tobytes()
        cuts = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum([len(x) for x in pieces])])].tolist()
        return [flat[a + 1 : b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


SCHEMA = (
    "doc_id long, sample int, n_pieces long, ids_sha256 string, log_prob double, perturbed double, log_inclusion double, "
    "round_trip boolean, ids array<int>"
)


def encoded(batches: Iterator[pa.RecordBatch], pieces: Pieces, samples: int, with_ids: bool) -> Iterator[pa.RecordBatch]:
    """Rows of SCHEMA for batches of id, text and seed."""
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    lattices, decoder = Lattices(pieces), Decoder(pieces.table)
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.float64(), pa.float64(), pa.float64(), pa.bool_()]
    for batch in slices(batches):
        ids, every = batch.column(0).to_pylist(), batch.column(1)
        seeds = batch.column(2).to_numpy(zero_copy_only=False).view(np.uint64)
        for a, b in groups(pc.fill_null(pc.binary_length(every), 0).to_numpy(zero_copy_only=False).astype(np.int64), GROUP_BYTES):
            texts = [x or "" for x in every.slice(a, b - a).to_pylist()]
            found = sample(lattices, texts, seeds[a:b], samples)
            cut = [x for rows in found for x, *_ in rows]
            decoded = iter(decoder.decode(cut))
            rows = []
            for i, text, samples_ in zip(ids[a:b], texts, found, strict=True):
                raw = text.encode("utf-8", "surrogatepass")
                for r, (x, lp, g, q) in enumerate(samples_, 1):
                    rows.append((i, r, len(x), hashlib.sha256(x.tobytes()).hexdigest(), lp, g, q, next(decoded) == raw))
            arrays = [pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
            if with_ids:
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in cut])]).astype(np.int32)
                arrays.append(pa.ListArray.from_arrays(offsets, np.concatenate(cut)))
            else:
                arrays.append(pa.nulls(len(rows), pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(arrays, names)


def sample_encodings(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL, samples: int = SAMPLES,
    sharpness: float = SHARPNESS, seed: int = 0, with_ids: bool = True,
) -> DataFrame:
    """Up to `samples` distinct segmentations for each row of docs (SCHEMA), fewer where there are fewer.

    The first is a sample of the text's segmentations, each later one of those that are left. A null or empty
    text has one, without pieces. Samples follow from doc_id and seed; rows equal in both and in text get the
    same. round_trip tells whether the ids decode to the text; ids_sha256 is of the ids as 32-bit little-endian
    numbers, ids are null if not asked for. The model is read on the driver and sent along.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(tuple(vars(load_pieces(model, sharpness)).values()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return encoded(batches, Pieces(*shared.value), samples, with_ids)

    plain = docs.select(
        col(id_col).cast("long").alias("doc_id"), col(text_col).cast("string").alias("text"),
        F.xxhash64(col(id_col).cast("long"), F.lit(seed)).alias("seed"),
    )
    return plain.mapInArrow(run, SCHEMA)


def decode_encodings(rows: DataFrame, ids_col: str = "ids", text_col: str = "decoded", model: str = MODEL) -> DataFrame:
    """rows, with all their columns, and the text of each array of piece ids as text_col.

    No pieces give the empty text, a null array gives null; an id that the model doesn't have is an error. Equal rows
    give equal texts, no rows none.
    """
    shared = rows.sparkSession.sparkContext.broadcast(load_pieces(model).table)

    @F.pandas_udf("string")
    def text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        decoder = Decoder(shared.value)
        for batch in batches:
            some = batch.notna()
            found = decoder.decode([np.asarray(x, np.int64) for x in batch[some]]) if some.any() else []
            out = pd.Series([None] * len(batch), dtype=object)
            out[some.to_numpy()] = [x.decode("utf-8", "surrogatepass") for x in found]
            yield out

    return rows.withColumn(text_col, text(col(ids_col)))
