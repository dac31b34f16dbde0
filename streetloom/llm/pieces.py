"""SentencePiece encoding with N best segmentations, and decoding."""

from __future__ import annotations

import heapq
import re
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from streetloom.llm.common import slices

SPACE = "▁"
NBEST = 4
#: Bytes that the stretches kept by one worker may take, as ``cost`` counts them.
HELD = 160 << 20
#: Characters, and stretches, whose lattices are searched at once; a longer stretch goes alone.
FRESH, RUN = 2_000, 1 << 16
#: Texts of at most so many characters are searched side by side, if there are so many.
SHORT, MANY = 64, 64
SLICE = 1 << 20
UNKNOWN_PENALTY = 10.0


#: The best segmentations of a stretch of text: score and ids of each, best first.
Segment = list[tuple[float, bytes]]
#: The same of many stretches: scores, a row each (-inf where there are fewer), how many bytes of ids each has, and those ids one after the other.
Rows = tuple[np.ndarray, np.ndarray, bytes]


def cost(name: str) -> int:
    """Memory for what is kept of a stretch: its name, its numbers, and ids of its segmentations in proportion to its length."""
    return 320 + 16 * len(name)


class Pieces:
    """The piece lattice of a SentencePiece model: every piece that matches a stretch of the text is an edge with the piece's score. A
    character without a piece is an edge of its byte pieces (or the unknown piece), scored below all others."""

    def __init__(self, model_path: str):
        from sentencepiece import SentencePieceProcessor
        from sentencepiece.sentencepiece_model_pb2 import ModelProto
        self.sp = sp = SentencePieceProcessor(model_file=model_path)
        size = sp.get_piece_size()
        plain = [i for i in range(size) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i))]
        self.pieces = {sp.id_to_piece(i): i for i in plain}
        self.scores = np.array([sp.get_score(i) for i in range(size)])
        self.bytes = {int(sp.id_to_piece(i)[3:5], 16): i for i in range(size) if sp.is_byte(i)}
        self.unknown, self.worst = sp.unk_id(), (float(self.scores[plain].min()) if plain else 0.0) - UNKNOWN_PENALTY
        self.texts = [b""] * size
        for i in plain:
            self.texts[i] = sp.id_to_piece(i).replace(SPACE, " ").encode()
        for b, i in self.bytes.items():
            self.texts[i] = bytes([b])
        if self.unknown >= 0:
            self.texts[self.unknown] = " ⁇ ".encode()
        self.letters = np.frombuffer(b"".join(self.texts), dtype=np.uint8)
        self.widths = np.array(list(map(len, self.texts)), dtype=np.int64)
        self.places = np.cumsum(self.widths) - self.widths
        #: The same model for stretches of normalised text: nothing is normalised again, and no space mark is put in front.
        model = ModelProto.FromString(sp.serialized_model_proto())
        model.normalizer_spec.Clear()
        model.normalizer_spec.add_dummy_prefix = model.normalizer_spec.remove_extra_whitespaces = False
        self.inner = SentencePieceProcessor(model_proto=model.SerializeToString())
        self.cut = self.cutter()
        self.index()

    def cutter(self) -> re.Pattern:
        """Cuts a text where no piece can lie across: before a space mark that follows another character, if no piece has one inside, between characters that no
        chain of pieces brings together (a letter and the comma after it), and around characters that occur in no piece of several characters."""
        long = [p for p in self.pieces if len(p) > 1]
        if any(SPACE in p.lstrip(SPACE) for p in long):
            return re.compile(f"[{re.escape(''.join(sorted({c for p in long for c in p} - {SPACE})))}{SPACE}]+|.", re.DOTALL)
        group: dict[str, list[str]] = {}
        for p in long:
            for c in p.lstrip(SPACE):
                mine, other = group.setdefault(p.lstrip(SPACE)[0], [p.lstrip(SPACE)[0]]), group.setdefault(c, [c])
                if mine is not other:
                    mine, other = sorted((mine, other), key=len, reverse=True)
                    mine += other
                    group.update(dict.fromkeys(other, mine))
        groups = sorted({id(g): sorted(g) for g in group.values()}.values(), key=lambda g: (-len(g), g))
        runs = "|".join(f"[{re.escape(''.join(g))}]+" for g in groups)
        return re.compile(f"{SPACE}*(?:{runs})|{SPACE}+|.", re.DOTALL) if runs else re.compile(".", re.DOTALL)

    def index(self) -> None:
        """A hash table of all beginnings of pieces: hash, and the piece's id, or -1 if the beginning is no piece itself."""
        found = {p[:k]: -1 for p in self.pieces for k in range(1, len(p))} | self.pieces
        self.longest = max(map(len, found), default=1)
        hashes = np.zeros(len(found), dtype=np.uint64)
        names = list(found)
        lengths = np.array([len(x) for x in names], dtype=np.int64)
        codes = np.frombuffer("".join(names).encode("utf-32-le"), dtype="<u4").astype(np.uint64)
        begin = np.cumsum(lengths) - lengths
        for k in range(self.longest):
            on = lengths > k
            hashes[on] = step(hashes[on], codes[begin[on] + k])
        if len(np.unique(hashes)) != len(hashes):
            raise ValueError("two beginnings of pieces have the same hash")
        bits = max(4, int(2 * len(found)).bit_length() + 1)
        self.keys, self.values, self.shift = np.zeros(1 << bits, dtype=np.uint64), np.full(1 << bits, -1, dtype=np.int64), np.uint64(64 - bits)
        for h, i in zip(hashes.tolist(), found.values(), strict=True):
            at = h >> int(self.shift)
            while self.keys[at]:
                at = (at + 1) % len(self.keys)
            self.keys[at], self.values[at] = h, i

    def look(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which hashes are beginnings of pieces, and their piece ids."""
        at = (hashes >> self.shift).astype(np.int64)
        key = self.keys[at]
        open_ = np.nonzero((key != hashes) & (key != 0))[0]
        while len(open_):
            at[open_] = (at[open_] + 1) & (len(self.keys) - 1)
            key[open_] = self.keys[at[open_]]
            open_ = open_[(key[open_] != hashes[open_]) & (key[open_] != 0)]
        return key == hashes, self.values[at]

    def spare(self, char: str) -> list[int]:
        data = char.encode("utf-8", "replace")
        return [self.bytes[b] for b in data] if all(b in self.bytes for b in data) else [self.unknown]

    def text(self, ids: bytes) -> str:
        at = np.frombuffer(ids, dtype="<u4")
        width = self.widths[at]
        text = self.letters[gather(self.places[at], width)].tobytes().decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text

    def own(self, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """What the model itself makes of each text (its BPE merges, if it is a BPE model): the ids of ``sp.encode``, one text after the other, and how many each has."""
        ids = self.inner.encode(names, num_threads=1)
        return np.frombuffer(array("I", chain.from_iterable(ids)), dtype="<u4"), np.fromiter(map(len, ids), np.int64, len(ids))

    def spells(self, ids: np.ndarray, sizes: np.ndarray, names: list[str]) -> np.ndarray:
        """Whether the ids of each text, dealt by ``sizes``, are letter by letter that text."""
        width = self.widths[ids]
        letters = self.letters[gather(self.places[ids], width)].tobytes()
        ends = np.append(0, np.cumsum(width))[np.cumsum(sizes)].tolist()
        return np.array([letters[a:b] == x.replace(SPACE, " ").encode("utf-8", "surrogatepass") for a, b, x in zip([0, *ends], ends, names, strict=False)], dtype=bool)

    def best(self, names: list[str], n: int = NBEST) -> Iterator[Segment]:
        """The ``n`` best paths through the lattice of each text."""
        for scores, sizes, data in self.best_rows(names, n):
            end = np.cumsum(sizes).reshape(sizes.shape).tolist()
            for row, size, stop in zip(scores.tolist(), sizes.tolist(), end, strict=True):
                yield [(score, data[b - a : b]) for score, a, b in zip(row, size, stop, strict=True) if score > -np.inf]

    def best_rows(self, names: list[str], n: int = NBEST) -> Iterator[Rows]:
        """The ``n`` best paths through the lattice of each text, worked in runs."""
        start, held = 0, 0
        for i, name in enumerate(names):
            if i > start and (held + len(name) > RUN or i - start == FRESH):
                yield self.search_all(names[start:i], n)
                start, held = i, 0
            held += len(name)
        if start < len(names):
            yield self.search_all(names[start:], n)

    def search_all(self, names: list[str], n: int) -> Rows:
        """The ``n`` best paths through the lattice of each text. A forward Viterbi pass, over all texts side by side, gives the best score up to each
        place. Paths are then built from the end; the score of what is built plus the Viterbi score up to its start is exactly the best the path can come
        to, so a best-first (A*) search meets whole paths in order of their scores. Ties: the last piece that starts later, then the path reached first."""
        lengths = np.array([len(x) for x in names], dtype=np.int64)
        whole = "".join(names)
        codes = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
        owner = np.repeat(np.arange(len(names)), lengths)
        first = np.cumsum(lengths) - lengths
        left = first[owner] + lengths[owner] - np.arange(len(codes))
        on, h = np.arange(len(codes)), np.zeros(len(codes), dtype=np.uint64)
        starts, sizes, ids = [], [], []
        for k in range(1, self.longest + 1):
            enough = left[on] >= k
            on, h = on[enough], h[enough]
            if not len(on):
                break
            h = step(h, codes[on + k - 1])
            known, piece = self.look(h)
            edge = known & (piece >= 0)
            if k == 1:
                bare = on[~edge]
                starts.append(bare)
                sizes.append(np.ones(len(bare), dtype=np.int64))
                ids.append(np.full(len(bare), -1))
            starts.append(on[edge])
            sizes.append(np.full(np.count_nonzero(edge), k))
            ids.append(piece[edge])
            on, h = on[known], h[known]
        start, size, piece = np.concatenate(starts), np.concatenate(sizes), np.concatenate(ids)
        score = np.where(piece >= 0, self.scores[piece], self.worst)
        reach = start - first[owner[start]] + size  # end, counted within the text
        end = start + owner[start] + size
        order = np.argsort((reach * (len(codes) + len(names) + 1) + end) * (self.longest + 1) + size)
        start, size, piece, score, reach, end = start[order], size[order], piece[order], score[order], reach[order], end[order]
        place = start + owner[start]  # a text of n characters has n + 1 places
        forward = np.full(len(codes) + len(names), -np.inf)
        forward[first + np.arange(len(names))] = 0.0
        bounds = np.searchsorted(reach, np.arange(1, int(reach[-1]) + 2)).tolist()
        for a, b in zip(bounds, bounds[1:], strict=False):
            if a < b:  # edges of one reach, in order of their ends
                into = end[a:b]
                first_of = np.nonzero(np.append(True, into[1:] != into[:-1]))[0]
                forward[into[first_of]] = np.maximum.reduceat(forward[place[a:b]] + score[a:b], first_of)
        through = forward[place] + score
        order = np.lexsort((-through, end))
        edges = through[order], place[order], score[order], np.where(piece < 0, -1 - start, piece)[order]
        into = np.searchsorted(end[order], np.arange(len(forward) + 1))
        begin = first + np.arange(len(names))
        if len(names) >= MANY and 0 < lengths.min() and lengths.max() <= SHORT:
            return self.search_side_by_side(whole, edges, into, begin, begin + lengths, n)
        lists, places = tuple(x.tolist() for x in edges), into.tolist()
        scores, sizes, data = np.full((len(names), n), -np.inf), np.zeros((len(names), n), dtype=np.int64), []
        for i, (a, m) in enumerate(zip(begin.tolist(), lengths.tolist(), strict=True)):
            for k, (total, path) in enumerate(self.search(whole, lists, places, a, a + m, n)):
                scores[i, k], sizes[i, k] = total, len(path)
                data.append(path)
        return scores, sizes, b"".join(data)

    def search_side_by_side(self, whole: str, edges: tuple[np.ndarray, ...], into: np.ndarray, begin: np.ndarray, end: np.ndarray, n: int) -> Rows:
        """``search`` of many short texts, each with a queue of its own: in every round all texts follow their best edges to the beginning, step by step,
        then each takes the first entry of its queue. Of a queue only as many entries stay as paths are still wanted; those behind them never come out. Entries
        lie in the order they were queued in, and sorting is stable, so ties fall as in ``search``."""
        through, places, scores, ids = edges
        edge_of, parent_of, made = [], [], 0  # what is built, as nodes that name an edge and the node behind it
        rounds: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        queue = [np.empty(0, dtype=t) for t in (np.int64, np.float64, np.int64, np.float64, np.int64)]  # text, priority, edge, what is built: score and node
        text, place, behind, node = np.arange(len(begin)), end, np.zeros(len(begin)), np.full(len(begin), -1)
        while True:
            pushed, total, last = [queue], np.zeros(len(begin)), np.full(len(begin), -1)
            on, active = text, text
            while True:
                there = place == begin[on]
                total[on[there]], last[on[there]] = behind[there], node[there]
                if there.all():
                    break
                on, place, behind, node = on[~there], place[~there], behind[~there], node[~there]
                edge = into[place]
                others = np.minimum(into[place + 1] - edge - 1, n - 1 - len(rounds))  # best first
                of = np.repeat(np.arange(len(on)), others)
                other = edge[of] + 1 + np.arange(len(of)) - (np.cumsum(others) - others)[of]
                pushed.append([on[of], -(behind[of] + through[other]), other, behind[of], node[of]])
                edge_of.append(edge)
                parent_of.append(node)
                place, behind, node, made = places[edge], behind + scores[edge], np.arange(made, made + len(on)), made + len(on)
            rounds.append((active, total[active], last[active]))
            left = n - len(rounds)
            queue = [np.concatenate(x) for x in zip(*pushed, strict=True)]
            if not left or not len(queue[0]):
                break
            order = np.lexsort((queue[1], queue[0]))
            queue = [x[order] for x in queue]
            heads = np.nonzero(np.append(True, queue[0][1:] != queue[0][:-1]))[0]
            rank = np.arange(len(order)) - np.repeat(heads, np.diff(np.append(heads, len(order))))
            text, _, edge, behind, parent = (x[heads] for x in queue)
            queue = [x[(rank > 0) & (rank < left)] for x in queue]
            edge_of.append(edge)
            parent_of.append(parent)
            place, behind, node, made = places[edge], behind + scores[edge], np.arange(made, made + len(text)), made + len(text)
        owner = np.concatenate([t for t, _, _ in rounds])
        turn = np.repeat(np.arange(len(rounds)), [len(t) for t, _, _ in rounds])
        order = np.argsort(owner * n + turn)
        owner, turn = owner[order], turn[order]
        total, at = (np.concatenate([x[k] for x in rounds])[order] for k in (1, 2))
        value, parent = ids[np.concatenate(edge_of)], np.concatenate(parent_of)
        none, steps = np.iinfo(np.int64).min, []
        while (at >= 0).any():
            steps.append(np.where(at >= 0, value[at], none))
            at = np.where(at >= 0, parent[at], -1)
        paths = np.stack(steps, axis=1)
        built = paths != none
        flat, size = paths[built], np.count_nonzero(built, axis=1)
        bare = np.nonzero(flat < 0)[0]
        if len(bare):  # characters without a piece become the pieces they are made of
            spare = [self.spare(whole[-1 - p]) for p in flat[bare].tolist()]
            more = np.ones(len(flat), dtype=np.int64)
            more[bare] = list(map(len, spare))
            size = np.add.reduceat(more, np.cumsum(size) - size)
            at = np.repeat(flat < 0, more)
            flat = np.repeat(flat, more)
            flat[at] = [x for s in spare for x in s]
        scores, sizes = np.full((len(begin), n), -np.inf), np.zeros((len(begin), n), dtype=np.int64)
        scores[owner, turn], sizes[owner, turn] = total, 4 * size
        return scores, sizes, flat.astype(np.uint32).tobytes()

    def search(self, whole: str, edges: tuple[list, ...], into: list[int], begin: int, end: int, n: int) -> Segment:
        """A* from place ``end`` back to ``begin``. The first edge into each place is the one on the best way; it would be the next to come out, so it
        is followed at once and only the others are queued."""
        through, places, scores, ids = edges
        found: list[tuple[float, bytes]] = []
        queue: list[tuple[float, int, int, float, tuple]] = []
        turn, place, behind, parts, push = 0, end, 0.0, (), heapq.heappush
        while True:
            while place != begin:
                edge = into[place]
                for other in range(edge + 1, into[place + 1]):
                    turn += 1
                    push(queue, (-(behind + through[other]), turn, other, behind, parts))
                place, behind, parts = places[edge], behind + scores[edge], (ids[edge], parts)
            path = []
            while parts:
                if parts[0] < 0:
                    path += self.spare(whole[-1 - parts[0]])
                else:
                    path.append(parts[0])
                parts = parts[1]
            found.append((behind, array("I", path).tobytes()))
            if len(found) == n or not queue:
                break
            _, _, edge, behind, parts = heapq.heappop(queue)
            place, behind, parts = places[edge], behind + scores[edge], (ids[edge], parts)
        return found


def step(h: np.ndarray, codes: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h + codes + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        return h ^ (h >> np.uint64(29)) | np.uint64(1)


def gather(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of runs that start at ``first`` and have ``sizes`` entries, one run after the other."""
    return np.arange(sizes.sum()) + np.repeat(first - np.cumsum(sizes) + sizes, sizes)


class Known(dict):
    """Numbers of stretches; one that is not known yet gets the next number and waits in ``fresh``."""

    def __init__(self, names: list[str] = ()):
        super().__init__(zip(names, range(len(names)), strict=True))
        self.fresh: list[str] = []

    def __missing__(self, name: str) -> int:
        number = self[name] = len(self)
        self.fresh.append(name)
        return number


class Ids:
    """Ids of stretches, one stretch after the other."""

    def __init__(self):
        self.data, self.first, self.sizes = bytearray(), np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)

    def add(self, ids: np.ndarray, sizes: np.ndarray) -> None:
        self.first = np.concatenate((self.first, len(self.data) // 4 + np.cumsum(sizes) - sizes))
        self.sizes = np.concatenate((self.sizes, sizes))
        self.data += ids.astype("<u4").tobytes()

    def of(self, at: np.ndarray) -> np.ndarray:
        return np.frombuffer(self.data, dtype="<u4")[gather(self.first[at], self.sizes[at])]

    def only(self, at: np.ndarray) -> Ids:
        out = Ids()
        out.add(self.of(at), self.sizes[at])
        return out


class Encoder:
    """Segmentations of whole texts. A text falls into stretches that no piece lies across; those are kept for the next texts, about HELD bytes. When there
    are more, those stay that the last texts had more than once, most frequent first, in half of HELD.

    Of a stretch are kept: the model's own ids, the best ids, the ids of its other segmentations in one row (``ends`` has how many ids of it each leaves behind), whether its own
    and its best ids spell it, how often it came, and in ``numbers`` its score, its count of best ids and what each other segmentation loses."""

    def __init__(self, model_path: str, n: int = NBEST):
        self.pieces, self.n = Pieces(model_path), n
        self.forget()

    def forget(self) -> None:
        self.known = Known()
        self.owns, self.ids, self.others = Ids(), Ids(), Ids()
        self.numbers = np.empty((0, self.n + 1))
        self.ends = np.empty((0, self.n), dtype=np.int32)
        self.spelled, self.came = np.empty(0, dtype=bool), np.empty(0, dtype=np.int64)
        self.held = 0

    def keep(self) -> None:
        """Forgets what came once, and what has no room in half of HELD."""
        names = list(self.known)
        often = np.argsort(-self.came, kind="stable")[: np.count_nonzero(self.came > 1)]
        room = np.cumsum(np.fromiter((cost(names[i]) for i in often.tolist()), np.int64, len(often)))
        stay = np.sort(often[room <= HELD // 2])
        self.held = int(room[len(stay) - 1]) if len(stay) else 0
        self.known = Known([names[i] for i in stay.tolist()])
        self.owns, self.ids, self.others = self.owns.only(stay), self.ids.only(stay), self.others.only(stay)
        self.numbers, self.ends, self.spelled, self.came = self.numbers[stay], self.ends[stay], self.spelled[stay], np.ones(len(stay), dtype=np.int64)

    def learn(self) -> None:
        """Works out the segmentations of the stretches that wait."""
        fresh, self.known.fresh = self.known.fresh, []
        if not fresh:
            return
        self.held += sum(map(cost, fresh))
        numbers, ends, others, best = [self.numbers], [self.ends], [], []
        for scores, sizes, data in self.pieces.best_rows(fresh, self.n):
            ids, sizes = np.frombuffer(data, dtype="<u4"), sizes // 4
            first = np.zeros(sizes.shape, dtype=bool)
            first[:, 0] = True
            first = np.repeat(first.ravel(), sizes.ravel())
            best.append(ids[first])
            others.append(ids[~first])
            numbers.append(np.column_stack((scores[:, 0], sizes[:, 0], scores[:, :1] - scores[:, 1:])))
            ends.append(np.cumsum(sizes, axis=1, dtype=np.int32) - sizes[:, :1].astype(np.int32))
        counts, left = np.concatenate(numbers[1:])[:, 1].astype(np.int64), np.concatenate(ends[1:])[:, -1].astype(np.int64)
        best, (own, sizes) = np.concatenate(best), self.pieces.own(fresh)
        self.owns.add(own, sizes)
        self.ids.add(best, counts)
        self.others.add(np.concatenate(others), left)
        self.numbers, self.ends = np.concatenate(numbers), np.concatenate(ends)
        self.spelled = np.concatenate((self.spelled, self.pieces.spells(own, sizes, fresh) & self.pieces.spells(best, counts, fresh)))
        self.came = np.concatenate((self.came, np.zeros(len(fresh), dtype=np.int64)))

    def other(self, i: int, k: int) -> bytes:
        """Ids of the segmentation of stretch ``i`` that comes ``k`` after its best."""
        first = int(self.others.first[i])
        return bytes(self.others.data[4 * (first + int(self.ends[i, k - 1])) : 4 * (first + int(self.ends[i, k]))])

    def normal(self, text: str) -> str:
        return self.pieces.sp.normalize(text)

    def encode(self, text: str) -> tuple[bytes, list[tuple[float, list[tuple[int, int, bytes]]]]]:
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> list[tuple[bytes, list[tuple[float, list[tuple[int, int, bytes]]]]]]:
        return [(ids, best) for _, ids, best in self.encode_both(texts)]

    def encode_both(self, texts: list[str]) -> list[tuple[bytes, bytes, list[tuple[float, list[tuple[int, int, bytes]]]]]]:
        """For each text the model's own ids, the best ids, and for each of the N best its score and changes."""
        return [x[:3] for x in self.encode_normal([self.normal(t) if t else "" for t in texts])]

    def encode_normal(self, normals: list[str]) -> list[tuple[bytes, bytes, list[tuple[float, list[tuple[int, int, bytes]]]], bool]]:
        """For each text, normalised already, the model's own ids, the best ids, for each of the N best its score and changes (place in the best ids, ids taken out, ids put in; none
        for the first), and whether decoding own and best ids gives the text back. No piece lies across two stretches, so no merge does: ids of a text are those of its stretches."""
        if self.held > HELD:
            self.keep()
        find, number, flat, ends = self.pieces.cut.findall, self.known.__getitem__, array("q"), []
        for text in normals:
            flat.extend(map(number, find(text)))
            ends.append(len(flat))
        self.learn()
        at, ends = np.frombuffer(flat, dtype=np.int64), np.array(ends, dtype=np.int64)
        self.came += np.bincount(at, minlength=len(self.known))
        both = []
        for x in (self.owns, self.ids):
            data, stops = x.of(at).tobytes(), (4 * np.append(0, np.cumsum(x.sizes[at]))[ends]).tolist()
            both.append([data[a:b] for a, b in zip([0, *stops], stops, strict=False)])
        odd = np.append(0, np.cumsum(~self.spelled[at]))[np.append(0, ends)]
        same = [self.decode(own) == plain(text) == self.decode(ids) if bad else True for text, own, ids, bad in zip(normals, *both, np.diff(odd).tolist(), strict=True)]
        return list(zip(*both, self.combine(at, ends), same, strict=True))

    def combine(self, at: np.ndarray, ends: np.ndarray) -> list[list[tuple[float, list[tuple[int, int, bytes]]]]]:
        """Scores and changes of the N best of texts whose stretches stop at ``ends``.

        The score of a text is the sum over its stretches. One of the N best differs from the best in at most N - 1 stretches, and those are
        among the N - 1 whose second best loses least, so only these are combined."""
        out: list[list[tuple[float, list[tuple[int, int, bytes]]]]] = [[(0.0, [])] for _ in ends]
        sizes = np.diff(ends, prepend=0)
        texts = np.nonzero(sizes)[0]
        if not len(texts):
            return out
        first, sizes, numbers = (ends - sizes)[texts], sizes[texts], self.numbers[at]
        total, counts, rest = np.add.reduceat(numbers[:, 0], first), numbers[:, 1].astype(np.int64), numbers[:, 2].copy() if self.n > 1 else None
        before, picks = np.cumsum(counts) - counts, np.full((len(texts), self.n - 1), -1)
        for k in range(self.n - 1):
            least = np.minimum.reduceat(rest, first)
            hits = np.nonzero(rest == np.repeat(least, sizes))[0]
            place = hits[np.searchsorted(hits, first)]
            picks[:, k] = np.where(least < np.inf, place, -1)
            rest[place] = np.inf
        picks.sort(axis=1)
        losses = numbers[picks, 2:].tolist()
        for text, score, start, row, loss in zip(texts.tolist(), total.tolist(), before[first].tolist(), picks.tolist(), losses, strict=True):
            options: list[tuple[float, tuple[tuple[int, int], ...]]] = [(0.0, ())]
            for i, less in zip(row, loss, strict=True):
                if i >= 0:
                    choices = [(0.0, ())] + [(x, ((i, k + 1),)) for k, x in enumerate(less) if x < np.inf]
                    options = heapq.nsmallest(self.n, ((a + b, x + y) for a, x in options for b, y in choices))
            out[text] = [(score - x, [(int(before[i]) - start, int(counts[i]), self.other(int(at[i]), k)) for i, k in changes]) for x, changes in options]
        return out

    def decode(self, ids: bytes) -> str:
        """The text of ids: pieces one after the other, bytes joined to characters (what is no character becomes U+FFFD), space marks as spaces, without
        the one space that encoding puts in front."""
        return self.pieces.text(ids)


def plain(normal: str) -> str:
    """A normalised text as decoding writes it."""
    text = normal.replace(SPACE, " ")
    return text[1:] if text.startswith(" ") else text


_encoders: dict[tuple[str, int], Encoder] = {}


def encoder(model_path: str, n: int) -> Encoder:
    if (model_path, n) not in _encoders:
        _encoders[model_path, n] = Encoder(model_path, n)
    return _encoders[model_path, n]


def encode_pieces(docs: DataFrame, model_path: str, n: int = NBEST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, ids (the model's own encoding, little-endian unsigned 32-bit), best_ids (of the segmentation with the best sum of scores), nbest
    (score and changes to best_ids of each of the ``n`` best, best first; fewer if the text has fewer), round_trip (decoding ids and best_ids gives the normalised text back).
    A BPE model's scores are ranks of merges, so its ids are not the best sum. Null and empty texts have no ids and one segmentation of score 0."""
    change = pa.list_(pa.struct([("place", pa.int64()), ("out", pa.int32()), ("ids", pa.binary())]))
    kinds = [pa.binary(), pa.binary(), pa.list_(pa.struct([("score", pa.float64()), ("changes", change)])), pa.bool_()]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(model_path, n)
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                rows = [(own, ids, [{"score": x, "changes": [{"place": p, "out": o, "ids": i} for p, o, i in c]} for x, c in best], same)
                        for own, ids, best, same in e.encode_normal([e.normal(t) if t else "" for t in part.column("text").to_pylist()])]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))],
                                                 names=["doc_id", "ids", "best_ids", "nbest", "round_trip"])
        e.keep()  # the worker may wait long for its next task

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        encode, "doc_id long, ids binary, best_ids binary, nbest array<struct<score:double,changes:array<struct<place:long,out:int,ids:binary>>>>, round_trip boolean")


def decode_pieces(encoded: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and text of each row of ids. Null ids give a null text; ids outside of the model raise."""
    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(model_path, NBEST)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([None if i is None else e.decode(i) for i in batch.column("ids").to_pylist()], pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(decode, "doc_id long, text string")


def alternative(ids: bytes, changes: list[tuple[int, int, bytes]]) -> bytes:
    """The ids of one of the N best, from the best_ids and its changes."""
    out, at = [], 0
    for place, gone, put in changes:
        out += [ids[4 * at : 4 * place], put]
        at = place + gone
    return b"".join([*out, ids[4 * at :]])
