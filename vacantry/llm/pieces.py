"""SentencePiece encoding by sampling distinct segmentations without replacement, and decoding."""

from __future__ import annotations

import functools
import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_GOLD, _M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


#: Bits of the fraction by which an edge is drawn; the rest of 64 are for the node's number.
DRAW_BITS = 40


def mixed(key: np.ndarray) -> np.ndarray:
    """64 bits from each 64-bit key (splitmix64's finalizer)."""
    with np.errstate(over="ignore"):
        z = key * _GOLD
        z = (z ^ (z >> np.uint64(30))) * _M1
        z = (z ^ (z >> np.uint64(27))) * _M2
        return z ^ (z >> np.uint64(31))


def uniform(key: np.ndarray) -> np.ndarray:
    """A number in (0, 1) from each 64-bit key."""
    return ((mixed(key) >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def uniform_of(key: int) -> float:
    """The same for one key."""
    full = (1 << 64) - 1
    z = key * int(_GOLD) & full
    z = (z ^ (z >> 30)) * int(_M1) & full
    z = (z ^ (z >> 27)) * int(_M2) & full
    return (((z ^ (z >> 31)) >> 11) + 0.5) * 2.0**-53


def truncated_gumbel(location: np.ndarray, bound: float | np.ndarray, u: np.ndarray) -> np.ndarray:
    """Gumbel variates at `location`, given that they are at most `bound`."""
    with np.errstate(over="ignore"):
        return location - np.log(np.exp(location - bound) - np.log(u))


class Vocabulary:
    """Pieces of a SentencePiece model with log probabilities after Zipf's law: a merge model has ranks only.

    A space stands for the model's space mark. A character that is no piece is spelt by byte pieces.
    """

    def __init__(self, model_file: str, sharpness: float = 1.0):
        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = sp.get_piece_size()
        self.texts: list[bytes] = [b""] * n
        self.byte_id = np.zeros(256, np.int64)
        pieces = {}
        for i in range(n):
            if sp.is_byte(i):
                b = int(sp.id_to_piece(i)[1:-1], 16)
                self.byte_id[b] = i
                self.texts[i] = bytes([b])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                p = sp.id_to_piece(i).replace("▁", " ")
                pieces[p] = i
                self.texts[i] = p.encode()
        if any(" " in p.lstrip(" ") for p in pieces):
            raise ValueError("a piece of this model crosses words")
        ranks = np.arange(1, n + 1, dtype=np.float64)
        ordinary = sorted(pieces.values())
        self.log_p = np.full(n, -np.inf)
        self.log_p[ordinary] = -sharpness * np.log(ranks[: len(ordinary)])
        self.log_byte = -sharpness * float(np.log(len(ordinary) + 1))
        self.log_p -= np.log(np.exp(self.log_p[ordinary]).sum() + 256 * np.exp(self.log_byte))
        self.log_byte -= np.log(np.exp(-sharpness * np.log(ranks[: len(ordinary)])).sum() + 256 * np.exp(self.log_byte))
        self._grow(pieces)
        self.lengths = np.array([len(t) for t in self.texts])
        self.flat = np.frombuffer(b"".join(self.texts), np.uint8)
        self.starts = np.cumsum(self.lengths) - self.lengths

    def _grow(self, pieces: dict[str, int]) -> None:
        """A trie of all beginnings of pieces: node 0 is none, `first` has the node of a first character, `step` those further on.

        `ends` is the piece that a node is, or -1; `row` its row of `step`, `kind` a character's column (0: in no piece but first).
        """
        begun = sorted({p[:k] for p in pieces for k in range(1, len(p) + 1)})
        node = {b: i + 1 for i, b in enumerate(begun)}
        later = {c: i + 1 for i, c in enumerate(sorted({c for p in pieces for c in p[1:]}))}
        inner = {b: i + 1 for i, b in enumerate(sorted({b[:-1] for b in begun if len(b) > 1}))}
        self.first, self.kind = np.zeros(0x110000, np.int32), np.zeros(0x110000, np.uint16)
        self.step = np.zeros((len(inner) + 1, len(later) + 1), np.int32)
        self.row = np.array([0, *(inner.get(b, 0) for b in begun)], np.int32)
        self.ends = np.array([-1, *(pieces.get(b, -1) for b in begun)], np.int32)
        for c, k in later.items():
            self.kind[ord(c)] = k
        for b, n in node.items():
            if len(b) == 1:
                self.first[ord(b)] = n
            else:
                self.step[inner[b[:-1]], later[b[-1]]] = n

    def spell(self, ids: np.ndarray) -> np.ndarray:
        """Replace -1 - c by the byte pieces of character c."""
        if not len(ids) or ids.min() >= 0:
            return ids
        ids = np.where((ids < 0) & (ids >= -128), self.byte_id[np.clip(-1 - ids, 0, 127)], ids)
        odd = np.flatnonzero(ids < 0)
        if not len(odd):
            return ids
        spelt = [self.byte_id[np.frombuffer(chr(-1 - c).encode("utf-8", "surrogatepass"), np.uint8)] for c in ids[odd]]
        sizes = np.ones(len(ids), np.int64)
        sizes[odd] = [len(s) for s in spelt]
        out = np.repeat(ids, sizes)
        ends = np.cumsum(sizes)
        for k, s in zip(odd, spelt, strict=True):
            out[ends[k] - len(s) : ends[k]] = s
        return out

    def bytes_of(self, ids: np.ndarray) -> np.ndarray:
        sizes = self.lengths[ids]
        return self.flat[np.repeat(self.starts[ids] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())]

    def decode_all(self, ids: np.ndarray, sizes: np.ndarray, null: np.ndarray) -> pa.Array:
        """The texts of many lists of piece ids that encode texts, as one array."""
        said = self.bytes_of(ids)
        ends = np.concatenate([[0], np.cumsum(self.lengths[ids])])[np.cumsum(sizes)]
        begins = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
        marks = begins[ends > begins]  # each text's first byte is the mark
        kept = np.delete(said, marks)
        offsets = np.concatenate([[0], ends - np.cumsum(ends > begins)]).astype(np.int64)
        valid = pa.array(~null).buffers()[1]
        return pa.Array.from_buffers(pa.large_string(), len(sizes), [valid, pa.py_buffer(offsets.tobytes()), pa.py_buffer(kept.tobytes())]).cast(pa.string())

    def decode(self, ids: np.ndarray) -> str:
        """The text of piece ids; its first space is the mark that encoding puts before a text."""
        return self.bytes_of(ids).tobytes().decode("utf-8", "replace")[1:] if len(ids) else ""


#: A word of more characters is parted where no piece of the vocabulary can lie across, in blocks of at least so many.
LONG = 1024


def split(text: str, v: Vocabulary) -> list:
    """The words of a text, a word being a space run and what follows it, without its last space; later blocks of a long word are 1-tuples.

    What stands on both sides of a place that no piece can lie across is segmented independently, so blocks have the
    very segmentations of the whole word; a long word without such a place stays whole.
    """
    parts = text.split(" ") if text else []
    if "" in parts:
        merged, spaces = [], 0
        for p in parts[:-1]:
            if p:
                merged.append(" " * spaces + p)
                spaces = 0
            else:
                spaces += 1
        parts = [*merged, " " * spaces + parts[-1]]
    if len(text) > LONG and max(map(len, parts)) > LONG:
        blocks = []
        for p in parts:
            if len(p) <= LONG:
                blocks.append(p)
                continue
            edges = uncrossed(" " + p, v) - 1
            at = [0]
            while (k := int(np.searchsorted(edges, at[-1] + LONG))) < len(edges):
                at.append(int(edges[k]))
            said = [p[a:b] for a, b in zip(at, [*at[1:], len(p)], strict=True)]
            blocks += [said[0], *((x,) for x in said[1:])]
        return blocks
    return parts


def uncrossed(word: str, v: Vocabulary) -> np.ndarray:
    """The places within a word that no piece of its characters lies across."""
    chars = np.frombuffer(word.encode("utf-32-le", "surrogatepass"), np.uint32)
    n, at = len(chars), np.arange(len(chars))
    far, node, size = at + 1, v.first[chars], 1
    while True:
        on = (node > 0) & (at + size < n)
        at = at[on]
        node = v.step[v.row[node[on]], v.kind[chars[at + size]]]
        if not len(at):
            break
        size += 1
        whole = at[v.ends[node] >= 0]
        far[whole] = whole + size
    return np.flatnonzero(np.maximum.accumulate(far)[:-1] == np.arange(1, n)) + 1


class _Numbers(dict):
    """word -> its number; a word not seen before gets the next one and waits in `new`."""

    def __init__(self):
        super().__init__()
        self.new = []

    def __missing__(self, word) -> int:
        self[word] = n = len(self)
        self.new.append(word)
        return n


class Lattices:
    """Segmentation lattices of words, built for many words at once, with each edge's probability given its start.

    Node numbers of a word follow one another; edge e leads `span[e]` nodes on. `reach` of the edges of node i
    rises from i to i + 1, in whole steps of 2**-DRAW_BITS, so that one sorted search draws an edge, and draws the
    same one whatever node number a word has got. `limit` bounds the edges that `make_room` leaves.
    """

    #: What is held of words, nodes and edges: a word's first node; where a node's edges end; and of each edge the rest.
    KINDS = {"first": np.int64, "edge_end": np.int64, "reach": np.uint64, "log_q": np.float64, "span": np.int32, "piece": np.int32}

    def __init__(self, vocabulary: Vocabulary, limit: int = 6_000_000):
        self.v, self.limit = vocabulary, limit
        self.room = {name: np.zeros(1 << 16, kind) for name, kind in self.KINDS.items()}
        self._clear()

    def _clear(self) -> None:
        self.known = _Numbers()
        self.but_one: dict[tuple, float] = {}
        for name in self.KINDS:
            setattr(self, name, self.room[name][:0])

    def make_room(self) -> None:
        """Forget all words if their lattices have grown too large; numbers given before are void then."""
        if len(self.reach) > self.limit:
            self._clear()

    def _append(self, name: str, more: np.ndarray) -> None:
        n, room = len(getattr(self, name)), self.room[name]
        if n + len(more) > len(room):
            self.room[name] = np.zeros(max(2 * len(room), n + len(more)), room.dtype)
            self.room[name][:n] = room[:n]
        self.room[name][n : n + len(more)] = more
        setattr(self, name, self.room[name][: n + len(more)])

    def numbers(self, texts: list[list]) -> list[np.ndarray]:
        """For each list of words (of `split`) their numbers."""
        out = [np.fromiter(map(self.known.__getitem__, words), np.int64, len(words)) for words in texts]
        self._build(self.known.new)
        self.known.new = []
        return out

    def _build(self, new: list, at_once: int = 1 << 17) -> None:
        size, some = 0, []
        for k, w in enumerate(new):
            some.append(w[0] if w.__class__ is tuple else " " + w)
            size += len(some[-1]) + 1
            if size >= at_once or k == len(new) - 1:
                first, ends, reach, log_q, span, piece = self._lattice(some)
                nodes, edges = len(self.edge_end), len(self.reach)
                for name, x in zip(self.KINDS, (first + nodes, ends + edges, reach + np.uint64(nodes << DRAW_BITS), log_q, span, piece), strict=True):
                    self._append(name, x)
                size, some = 0, []

    def _lattice(self, words: list[str]):
        v = self.v
        chars = np.frombuffer(("\0".join(words) + "\0").encode("utf-32-le", "surrogatepass"), np.uint32)  # \0 stands at a word's last node
        sizes = np.array([len(w) + 1 for w in words])
        ends = np.cumsum(sizes) - 1
        first, n = ends - sizes + 1, len(chars)
        left = np.repeat(ends, sizes) - np.arange(n)  # characters from here to the word's end
        kind, counts = v.kind[chars], (left > 0).astype(np.int64)  # each node but the last has an edge of one character
        at = np.flatnonzero(left)
        node = v.first[chars[at]]
        found, size = [], 1
        one = v.ends[node]
        alone = one < 0
        c = chars[at[alone]].astype(np.int64)
        log_one, id_one = v.log_p[one], one.copy()
        log_one[alone] = v.log_byte * (1 + (c > 0x7F).astype(int) + (c > 0x7FF) + (c > 0xFFFF))
        id_one[alone] = -1 - c
        found.append((at, np.zeros(len(at), np.int64), log_one, id_one))
        while True:
            on = (node > 0) & (left[at] > size)
            at = at[on]
            node = v.step[v.row[node[on]], kind[at + size]]
            if not len(at):
                break
            size += 1
            p = v.ends[node]
            whole = p >= 0
            a, p = at[whole], p[whole]
            found.append((a, counts[a], v.log_p[p], p))
            counts[a] += 1
        edge_end = np.cumsum(counts)
        begin, m = edge_end - counts, int(counts.sum())
        log_e, piece, span = np.zeros(m), np.zeros(m, np.int32), np.zeros(m, np.int32)
        for k, (a, rank, lp, p) in enumerate(found):
            e = begin[a] + rank
            log_e[e], piece[e], span[e] = lp, p, k + 1
        node = np.repeat(np.arange(n), counts)
        ahead = node + span
        beta = np.zeros(n)
        far = left.astype(np.int16) if len(left) and left.max() < 1 << 15 else left
        nodes = np.argsort(far, kind="stable")
        cuts = np.searchsorted(far[nodes], np.arange(int(far.max()) + 2))
        edges = np.argsort(far[node], kind="stable")  # nodes by their distance from the end, and their edges with them
        e_cuts = np.searchsorted(far[node][edges], np.arange(int(far.max()) + 2))
        for d in range(1, int(far.max()) + 1):
            here, e = nodes[cuts[d] : cuts[d + 1]], edges[e_cuts[d] : e_cuts[d + 1]]
            k = counts[here]
            starts = np.cumsum(k) - k
            x = log_e[e] + beta[ahead[e]]
            top = np.maximum.reduceat(x, starts)
            beta[here] = top + np.log(np.add.reduceat(np.exp(x - np.repeat(top, k)), starts))
        log_q = log_e + beta[ahead] - beta[node]
        q, reach = np.exp(log_q), np.zeros(m)
        for k in range(int(counts.max())):
            e = begin[counts > k] + k
            reach[e] = q[e] + (reach[e - 1] if k else 0.0)
        reach = np.minimum((reach * float(1 << DRAW_BITS)).astype(np.uint64), np.uint64(1 << DRAW_BITS))
        reach[edge_end[counts > 0] - 1] = 1 << DRAW_BITS
        return first, edge_end, reach + (node.astype(np.uint64) << np.uint64(DRAW_BITS)), log_q, span, piece

    def sample(self, words: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Draw a segmentation of each word: (pieces of all, number of each, log probability of each)."""
        order = np.argsort(words)  # equal words are drawn side by side, for the search's sake
        node = self.first[words[order]]
        live, log_p, count = order, np.zeros(len(words)), np.zeros(len(words), np.int64)
        steps, t = [], 0
        while len(live):
            e = self.edge_end[node] - 1
            several = np.flatnonzero(e > self.edge_end[node - 1] * (node > 0))
            with np.errstate(over="ignore"):
                u = mixed(keys[live[several]] + np.uint64(t) * _M1) >> np.uint64(64 - DRAW_BITS)
            e[several] = np.searchsorted(self.reach, (node[several].astype(np.uint64) << np.uint64(DRAW_BITS)) + u, side="right")
            log_p[live] += self.log_q[e]
            count[live] += 1
            steps.append((live, self.piece[e]))
            node = node + self.span[e]
            on = self.edge_end[node] > self.edge_end[node - 1]
            live, node, t = live[on], node[on], t + 1
        out, starts = np.zeros(count.sum(), np.int64), np.cumsum(count) - count
        for t, (at, pieces) in enumerate(steps):
            out[starts[at] + t] = pieces
        return out, count, np.minimum(log_p, 0.0)

    def edges(self, node: int) -> list[tuple[float, int, int]]:
        """(probability, nodes on, piece) of each edge of a node."""
        a, b = int(self.edge_end[node - 1]) if node else 0, int(self.edge_end[node])
        return [(math.exp(q), s, p) for q, s, p in zip(self.log_q[a:b].tolist(), self.span[a:b].tolist(), self.piece[a:b].tolist(), strict=True)]

    def _left_over(self, word: int, without: list[tuple]) -> tuple[list, list[float]]:
        """The paths of `without` as a tree of [edges, {piece: child}], and below each of its nodes what they leave of the probability.

        That is a sum of what branches off, so it is exact however little is left.
        """
        tree, todo = [], [(int(self.first[word]), without, 0, None)]
        while todo:
            node, rest, depth, parent = todo.pop()
            edges = self.edges(node)
            if parent is not None:
                tree[parent[0]][1][parent[1]] = len(tree)
            at = len(tree)
            tree.append((edges, {}))
            if edges:
                for q, span, piece in edges:
                    own = [r for r in rest if r[depth] == piece]
                    if own:
                        todo.append((node + span, own, depth + 1, (at, piece)))
        left = [0.0] * len(tree)
        for at in range(len(tree) - 1, -1, -1):
            edges, kids = tree[at]
            left[at] = sum(q * (left[kids[piece]] if piece in kids else 1.0) for q, _, piece in edges)
        return tree, left

    def remaining(self, word: int, without: list[tuple]) -> float:
        """The probability of all segmentations of a word but those in `without`."""
        return self._left_over(word, without)[1][0]

    def remaining_but(self, word: int, pieces: tuple) -> float:
        """`remaining` without one segmentation, remembered."""
        key = (word, pieces)
        if key not in self.but_one:
            self.but_one[key] = self.remaining(word, [pieces])
        return self.but_one[key]

    def sample_other(self, word: int, without: list[tuple], key: int) -> tuple[tuple, float] | None:
        """A segmentation that is none of `without`, drawn from the rest in proportion, and its log probability; null if there is none."""
        tree, left = self._left_over(word, without)
        if not left[0] > 0:
            return None
        node, log_p, out, t, at = int(self.first[word]), 0.0, [], 0, 0
        while edges := tree[at][0] if at is not None else self.edges(node):
            kids = tree[at][1] if at is not None else {}
            mass = [q * (left[kids[piece]] if piece in kids else 1.0) for q, _, piece in edges]
            u, k = uniform_of(key + t * 0x94D049BB133111EB) * sum(mass), 0
            last = max(j for j, m in enumerate(mass) if m > 0)
            while k < last and u >= mass[k]:
                u -= mass[k]
                k += 1
            q, span, piece = edges[k]
            out.append(piece)
            log_p, node, t, at = log_p + math.log(q), node + span, t + 1, kids.get(piece)
        return tuple(out), log_p


class Sampler:
    """Best-first search over sets of segmentations, each with the perturbed log probability of its best member.

    A set is all segmentations that begin like one already emitted, up to some word, and differ there. Its best
    member's perturbed value is a Gumbel variate at the set's log mass, truncated by the value of the set it was
    part of; that is an exact bound, so the sets are opened in the order of the values emitted.
    """

    #: Characters of one text beyond which its words are looked up in slices, lattices being held for a slice only.
    GIANT = 1 << 22
    #: Words of each set that are looked at first, for all texts together.
    AHEAD = 192

    def __init__(self, vocabulary: Vocabulary):
        self.v, self.lattices = vocabulary, Lattices(vocabulary)

    def encode(self, texts: list[str], seeds: np.ndarray, k: int) -> list[list[tuple[np.ndarray, float, float, float]]]:
        """For each text up to k of (pieces, log probability, perturbed value, inclusion), by falling perturbed value."""
        if len(texts) > 1 and any(len(t) > self.GIANT for t in texts):
            return [self.encode([t], seeds[i : i + 1], k)[0] for i, t in enumerate(texts)]
        self.lattices.make_room()
        words = [split(t, self.v) for t in texts]
        if not any(len(t) > self.GIANT for t in texts):
            words = self.lattices.numbers(words)
        with np.errstate(over="ignore"):
            keys = [seeds[i] * _GOLD for i in range(len(texts))]
        done: list[list] = [[] for _ in texts]
        heaps: list[list] = [[] for _ in texts]
        none = np.zeros(0, np.int64)
        todo = [(i, None, 0, none, np.zeros(0), none, float(-np.log(-np.log(uniform(np.array([keys[i]]))[0])))) for i in range(len(texts))]
        for r in range(k):
            self._emit(words, keys, todo, done, heaps, r, k)
            todo = []
            for i in range(len(texts)):
                opened = self._open(words[i], keys[i], heaps[i], done[i], r) if r + 1 < k else None
                if opened:
                    todo.append((i, *opened))
            if not todo:
                break
        out = []
        for i in range(len(texts)):
            bound = -heaps[i][0][0] if heaps[i] else -np.inf
            rows = []
            for pieces, _, log_ps, g, *_ in done[i]:
                total = float(log_ps.sum())
                rows.append((self.v.spell(pieces), total, g, 1.0 if bound == -np.inf else float(-math.expm1(-math.exp(total - bound)))))
            out.append(rows)
        return out

    def _sample(self, parts: list, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Draw all words of some texts: as numbers, or, of a giant text, as words, slice by slice."""
        if all(isinstance(p, np.ndarray) for p in parts):
            return self.lattices.sample(np.concatenate(parts), keys)
        (words,) = parts
        ends = np.cumsum([len(w[0]) if w.__class__ is tuple else len(w) for w in words])
        cuts = np.unique([1, *np.searchsorted(ends, np.arange(self.GIANT // 4, ends[-1] if len(ends) else 0, self.GIANT // 4)), len(words)])
        cuts = [int(c) for c in cuts if 0 < c <= len(words)] or [0]
        out, at = [], 0
        for end in cuts:
            self.lattices.make_room()
            (numbers,) = self.lattices.numbers([words[at:end]])
            out.append(self.lattices.sample(numbers, keys[at:end]))
            at = end
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def _number(self, words, at: int) -> int:
        return int(words[at]) if isinstance(words, np.ndarray) else int(self.lattices.numbers([[words[at]]])[0][0])

    def _emit(self, words, keys, todo, done, heaps, r: int, k: int) -> None:
        """Complete each opened set's best member by drawing the words after its prefix, and part what remains of the set."""
        if not todo:
            return
        parts = [words[i][len(log_ps) :] for i, _, _, _, log_ps, _, _ in todo]
        with np.errstate(over="ignore"):
            stream = [keys[i] + np.uint64(r + 1) * _M2 + np.arange(len(log_ps), len(words[i]), dtype=np.uint64) * _GOLD for i, _, _, _, log_ps, _, _ in todo]
        pieces, counts, log_p = self._sample(parts, np.concatenate(stream))
        w_at, p_at = 0, 0
        sets = []
        for (i, without, w, head, head_log, head_counts, g), part in zip(todo, parts, strict=True):
            own = counts[w_at : w_at + len(part)]
            n = int(own.sum())
            all_pieces = np.concatenate([head, pieces[p_at : p_at + n]])
            log_ps = np.concatenate([head_log, log_p[w_at : w_at + len(part)]])
            all_counts = np.concatenate([head_counts, own])
            w_at, p_at = w_at + len(part), p_at + n
            done[i].append((all_pieces, all_counts, log_ps, g))
            if without is not None:
                heapq.heappush(heaps[i], without)
            sets.append((i, len(head_log), log_ps, all_counts, all_pieces, g, len(done[i]) - 1))  # what differs before is not in this set
        self._part(words, keys, sets, r, k - r, heaps)

    def _part(self, words, keys, sets: list, r: int, most: int, heaps) -> None:
        """Push the `most` best of the sets that agree with a sample up to some word, from the first free one on, and differ there.

        A variate exceeds its location by less than 38, as its uniform number has 53 bits, and locations fall along
        the text. So only words are looked at whose location is not that far below the best values found: AHEAD
        words of all texts at once, and more of those texts that need more.
        """
        wide = min(self.AHEAD, max(len(log_ps) - begin for _, begin, log_ps, *_ in sets))
        if wide <= 0:
            return
        log_p = np.zeros((len(sets), wide))
        base, g, begins = np.zeros((len(sets), 1)), np.zeros((len(sets), 1)), np.zeros((len(sets), 1), np.uint64)
        own = np.array([keys[i] for i, *_ in sets], np.uint64)[:, None]
        for n, (_, begin, log_ps, _, _, bound, _) in enumerate(sets):
            x = log_ps[begin : begin + wide]
            log_p[n, : len(x)] = x
            base[n], g[n], begins[n] = log_ps[:begin].sum(), bound, begin
        before = base + np.cumsum(log_p, axis=1) - log_p
        values = self._values(words, sets, log_p, before, own, begins, g, r)
        order = np.argsort(-values, axis=1, kind="stable")[:, :most]
        for n, (i, begin, log_ps, _, _, _, s) in enumerate(sets):
            best = [(-float(values[n, j]), r, s, begin + int(j), None) for j in order[n] if values[n, j] > -np.inf]
            if len(log_ps) - begin > wide:
                best = self._further(words, keys[i], sets[n], r, most, best, wide)
            for x in best:
                heapq.heappush(heaps[i], x)

    def _further(self, words, key, one: tuple, r: int, most: int, best: list, at: int) -> list:
        """The same of one text from its word `at` on, in growing steps, until the rest lies too low."""
        _, begin, log_ps, _, _, g, s = one
        before = np.concatenate([[0.0], np.cumsum(log_ps)])[begin:-1]
        while True:
            bound = -best[-1][0] - 38 if len(best) == most else -np.inf
            until = min(len(before), int(np.searchsorted(-before, -bound, side="right")), 4 * at)
            if until <= at:
                return best
            part = slice(at, until)
            values = self._values(words, [one], log_ps[None, begin + at : begin + until], before[None, part], np.array([[key]], np.uint64), np.array([[begin + at]], np.uint64), np.array([[g]]), r)[0]
            best += [(-float(values[j]), r, s, begin + at + int(j), None) for j in np.argsort(-values, kind="stable")[:most] if values[j] > -np.inf]
            best = sorted(best, key=lambda x: x[:4])[:most]
            at = until

    def _values(self, words, sets: list, log_p, before, own, begins, g, r: int) -> np.ndarray:
        """Truncated Gumbel values of the sets that differ at each word; a row for each text, from its word `begins` on."""
        rest = -np.expm1(log_p)
        there = np.arange(log_p.shape[1]) < np.array([len(x[2]) for x in sets])[:, None] - begins.astype(np.int64)
        for n, j in zip(*np.nonzero((rest < 1e-9) & there), strict=True):  # so little that it may be rounding
            i, _, _, counts, pieces, _, _ = sets[n]
            x = int(begins[n, 0]) + int(j)
            end = int(counts[: x + 1].sum())
            rest[n, j] = self.lattices.remaining_but(self._number(words[i], x), tuple(pieces[end - counts[x] : end].tolist()))
        with np.errstate(divide="ignore", over="ignore"):
            at = begins + np.arange(log_p.shape[1], dtype=np.uint64)
            u = uniform(own * _M1 + np.uint64(r + 1) * _GOLD + at * _M2)
            return truncated_gumbel(before + np.log(rest), g, u)

    def _open(self, words, key, heap, done, r: int):
        """The best set's own best member: the prefix, a word that differs, and the set that is left at that word."""
        while heap:
            value, _, s, w, without = heapq.heappop(heap)
            pieces, counts, log_ps, _ = done[s]
            ends = np.cumsum(counts)
            start = int(ends[w] - counts[w])
            without = without or [tuple(pieces[start : int(ends[w])].tolist())]
            own = int(key) * int(_M2) + w * int(_GOLD) + (r + 1) * int(_M1)
            number = self._number(words, w)
            other = self.lattices.sample_other(number, without, own)
            if other is None:
                continue
            said, log_p = other
            head = np.concatenate([pieces[:start], np.array(said, np.int64)])
            head_log = np.concatenate([log_ps[:w], [min(0.0, log_p)]])
            head_counts = np.concatenate([counts[:w], [len(said)]])
            more = [*without, said]
            mass = self.lattices.remaining(number, more)
            left = None
            if mass > 0:
                u = np.array([uniform_of(own + 7)])
                v = truncated_gumbel(np.array([float(log_ps[:w].sum()) + np.log(mass)]), -value, u)[0]
                left = (-float(v), r + 1, s, w, more)
            return left, w, head, head_log, head_counts, -value
        return None


@functools.lru_cache(maxsize=2)
def sampler_of(model_file: str, sharpness: float) -> "Sampler":
    """The sampler of a model, once in a worker process, so that its tasks share the lattices of frequent words."""
    return Sampler(Vocabulary(model_file, sharpness))


def sample_encode(
    docs: DataFrame, *, model_file: str, k: int = 2, id_col: str = "doc_id", text_col: str = "text", seed: int = 42, sharpness: float = 1.0, copy_col: str | None = None, decoded: bool = False, chunk: int = 1 << 20
) -> DataFrame:
    """(id, sample, pieces, log_prob, perturbed, inclusion) for up to k distinct segmentations of each whole text.

    Segmentations are drawn without replacement from the model's lattice (see Vocabulary and Sampler), by falling
    perturbed log probability; `inclusion` is a segmentation's probability of being among those drawn, given the
    value that the next one would have had. The draw depends on (seed, id, text), not on how rows are dealt; rows
    with equal ids and texts draw the same, unless `copy_col` names a column that tells them apart.
    Texts are not normalised: pieces decode to the very text. A text with fewer than k segmentations has fewer
    rows, an empty text one of no pieces; a null text has one row of null pieces. Ids are passed through, nulls
    and repeats too; extra columns are ignored. `decoded` adds the column text, decoded from the pieces.
    A word is segmented whole, however long it is: it is parted only where no piece can lie across. model_file must be readable on all executors. About `chunk`
    characters are worked on at a time, or one longer text, and a lattice holds a word at least.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, sample int, pieces array<int>, log_prob double, perturbed double, inclusion double" + ", text string" * decoded

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = sampler_of(model_file, sharpness)
        for b in batches:
            texts, at = b.column(1).to_pylist(), 0
            seeds = b.column(2).to_numpy().view(np.uint64)
            while at < len(texts):
                end, size = at, 0
                while end < len(texts) and (end == at or size + len(texts[end] or "") <= chunk):
                    size += len(texts[end] or "")
                    end += 1
                found = sampler.encode([t or "" for t in texts[at:end]], seeds[at:end], k)
                rows = [(at + i, j, *s) for i, samples in enumerate(found) for j, s in enumerate(samples)]
                null = [texts[r[0]] is None for r in rows]
                sizes = np.array([0, *(len(r[2]) for r in rows)])
                ids = np.concatenate([r[2] for r in rows])
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum(sizes), pa.int32(), mask=np.array([*null, False])), pa.array(ids.astype(np.int32)))
                out = [b.column(0).take(pa.array([r[0] for r in rows])), pa.array([r[1] for r in rows], pa.int32()), lists]
                out += [pa.array([None if x else r[c] for r, x in zip(rows, null, strict=True)], pa.float64()) for c in (3, 4, 5)]
                if decoded:
                    out.append(sampler.v.decode_all(ids, sizes[1:], np.array(null)))
                yield pa.RecordBatch.from_arrays(out, names)
                at = end

    names = [id_col, "sample", "pieces", "log_prob", "perturbed", "inclusion"] + ["text"] * decoded
    text = F.col(text_col).cast("string")
    key = F.xxhash64(F.lit(seed), F.col(id_col), text, *([F.col(copy_col)] if copy_col else []))
    return docs.select(F.col(id_col), text.alias("__text"), key.alias("__key")).mapInArrow(run, schema)


def decode(df: DataFrame, *, model_file: str, id_col: str = "doc_id", pieces_col: str = "pieces") -> DataFrame:
    """(id, text): the text of each row's pieces; null pieces give a null text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = Vocabulary(model_file)
        for b in batches:
            texts = [None if p is None else v.decode(np.array(p, np.int64)) for p in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], [id_col, "text"])

    return df.select(id_col, pieces_col).mapInArrow(run, f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, text string")
