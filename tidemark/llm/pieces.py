"""SentencePiece encoding and decoding: distinct sampled segmentations by Gumbel top-k without replacement.

The lattice of a text has an edge for each vocabulary piece that matches there, and for a character without a
piece one edge of its byte pieces. A piece's log-weight is its score in the model times `scale`; without a scale it
is that of the piece's rank by Zipf's law, since the scores of merge vocabularies are ranks and no log-probabilities.
So a segmentation's probability is the product of its weights, normalised over the lattice by backward sums. Where no piece joins two characters the lattice falls into fields, and equal
fields share their sums.

The k segmentations with the largest log-probability plus Gumbel noise are found best first (perturbed A*): a
node is a prefix of a path, its exact bound the largest perturbed value below it. The root's best path is a
sample from the lattice; what leaves that path at an edge is a node whose perturbed value is a Gumbel of its
mass, truncated at the path's value. The best open node gives the next path, which opens new nodes in turn. All
texts of a slice do this side by side in numpy. The noise is a hash of the row's key, so results depend on the
key and text alone. With the (k + 1)-th value as threshold each sample has its inclusion probability.

Decoding is exact: a literal U+2581 goes as byte pieces, so spaces alone become that mark.

Defined cases: null and empty texts have one empty segmentation of probability 1; a text with fewer than k
segmentations gives all; equal keys and texts give equal samples; a null key is a key of its own; a text of any
length is taken whole.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.base import free, in_tasks, sliced, small_batches, table, without

SAMPLES, SLICE = 2, 250_000
MARK = "▁"
_P = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def uniform(seed: np.ndarray, place: np.ndarray, salt: int) -> np.ndarray:
    """Uniform numbers in (0, 1), a function of seed, place and salt."""
    x = mixed(seed + place.astype(np.uint64) * _P + np.uint64(salt * 0xD6E8FEB86659FD93 & (1 << 64) - 1))
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)


class Vocabulary:
    """Pieces as hashes of their prefixes, which characters pieces join, and the weights."""

    def __init__(self, path: str, scale: float | None = None):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        usual = [i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        self.pieces = [model.id_to_piece(i) for i in range(n)]
        self.byte_id = np.zeros(256, np.int32)
        for i in range(n):
            if model.is_byte(i):
                self.byte_id[int(self.pieces[i][1:-1], 16)] = i
        order = sorted(usual, key=lambda i: (-model.get_score(i), i))
        self.weight = np.full(n, -np.inf)
        if scale is None:
            self.weight[order] = -np.log(np.arange(len(order)) + 2.0)
            self.byte_weight = -float(np.log(n + 2.0))
        else:
            self.weight[order] = [scale * model.get_score(i) for i in order]
            self.byte_weight = float(self.weight[order].min()) - scale
        letters = sorted({c for i in usual for c in self.pieces[i]})
        number = {c: k + 1 for k, c in enumerate(letters)}
        self.number = np.zeros(0x110000, np.int32)
        self.number[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        self.number[0x20], self.number[0x2581] = number[MARK], 0
        self.joined = np.zeros((len(letters) + 1,) * 2, bool)
        self.longest = max(len(self.pieces[i]) for i in usual)
        found: dict[int, list] = {}
        for i in usual:
            codes = [number[c] for c in self.pieces[i]]
            self.joined[codes[:-1], codes[1:]] = True
            h = 0
            for k, c in enumerate(codes):
                h = (h * int(_P) + c) & (1 << 64) - 1
                entry = found.setdefault(h, [self.pieces[i][: k + 1], -1, False])
                assert entry[0] == self.pieces[i][: k + 1]
                if k + 1 == len(codes):
                    entry[1] = i
                else:
                    entry[2] = True
        self._table(found)
        spelled = [p.replace(MARK, " ").encode() for p in self.pieces]
        for i in range(n):
            if model.is_byte(i):
                spelled[i] = bytes([int(self.pieces[i][1:-1], 16)])
            elif not np.isfinite(self.weight[i]):
                spelled[i] = b""
        self.spelled = np.frombuffer(b"".join(spelled), np.uint8)
        self.spelled_at = np.cumsum([0, *map(len, spelled)])

    def _table(self, found: dict[int, list]) -> None:
        """An open-addressed table of the prefixes; slots without one hold hash 0, which no prefix has."""
        assert 0 not in found
        self.bits = max(4, (4 * len(found)).bit_length())
        size = 1 << self.bits
        self.prefix, self.prefix_id, self.goes_on = np.zeros(size, np.uint64), np.full(size, -1, np.int32), np.zeros(size, bool)
        for h, (_, piece, more) in found.items():
            at = int(self.slot(np.array([h], np.uint64))[0])
            while self.prefix[at]:
                at = (at + 1) % size
            self.prefix[at], self.prefix_id[at], self.goes_on[at] = h, piece, more

    def slot(self, h: np.ndarray) -> np.ndarray:
        return (((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - self.bits)).astype(np.int32)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Slots of prefix hashes; -1 for those that are none."""
        at = self.slot(h)
        held = self.prefix[at]
        out = np.where(held == h, at, -1)
        rest = np.flatnonzero((held != h) & (held != 0))
        while len(rest):
            at[rest] = (at[rest] + 1) & ((1 << self.bits) - 1)
            held = self.prefix[at[rest]]
            good = held == h[rest]
            out[rest[good]] = at[rest[good]]
            rest = rest[~good & (held != 0)]
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of piece ids, with the space before a text's first word."""
        begin, size = self.spelled_at[ids], self.spelled_at[ids + 1] - self.spelled_at[ids]
        total = np.cumsum(size)
        at = np.arange(total[-1] if len(total) else 0) + np.repeat(begin - total + size, size)
        return self.spelled[at].tobytes()


@functools.lru_cache(2)
def vocabulary_of(path: str, scale: float | None = None) -> Vocabulary:
    return Vocabulary(path, scale)


class Lattices:
    """The lattices of a slice of texts: one for each different field."""

    def __init__(self, words: Vocabulary, texts: list[str]):
        self.words = words
        joined = "".join(" " + t if t else "" for t in texts)
        self.points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        self.n = n = len(self.points)
        self.bounds = np.cumsum([0, *(len(t) + 1 if t else 0 for t in texts)])
        code = words.number[self.points]
        first = np.ones(n, bool)
        first[1:] = ~words.joined[code[:-1], code[1:]]
        first[self.bounds[:-1][self.bounds[:-1] < n]] = True
        self.field_at = np.flatnonzero(first)
        size = np.diff(np.append(self.field_at, n))
        # Equal fields by a hash of their points, confirmed point by point.
        power = powers(n + 1)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum((self.points.astype(np.uint64) + np.uint64(1)) * power[:n], out=total[1:])
        inverse = powers(n + 1, pow(int(_P), -1, 1 << 64))
        name = mixed((total[self.field_at + size] - total[self.field_at]) * inverse[self.field_at] + size.astype(np.uint64))
        _, one, same = np.unique(name, return_index=True, return_inverse=True)
        step = np.arange(n) - np.repeat(self.field_at, size)
        if not np.array_equal(self.points[np.repeat(self.field_at[one[same]], size) + step], self.points):
            one, same = np.arange(len(name)), np.arange(len(name))
        sizes = size[one]
        begin = np.cumsum(sizes) - sizes
        at = np.arange(sizes.sum()) + np.repeat(self.field_at[one] - begin, sizes)
        left = np.repeat(begin + sizes, sizes) - np.arange(len(at))
        self.field_size, self.field_row = size, begin[same]  # row of a field's first place in the tables below
        self._edges(code[at], self.points[at], left)

    def _edges(self, code, points, left):
        """Flat arrays of all edges, those of a row together, and by row and length their numbers and running shares."""
        words, n = self.words, len(code)
        self.bytes = 1 + (points >= 0x80).astype(np.int8) + (points >= 0x800) + (points >= 0x10000)
        self.point = points
        live = np.flatnonzero(code > 0).astype(np.int32)
        h = np.zeros(len(live), np.uint64)
        bare = np.ones(n, bool)
        rows, spans, pieces = [], [], []
        for k in range(words.longest):
            inside = left[live] > k
            live, h = live[inside], h[inside]
            if not len(live):
                break
            h = h * _P + code[live + k].astype(np.uint64)
            at = words.find(h)
            good = np.flatnonzero(at >= 0)
            live, h, at = live[good], h[good], at[good]
            piece = words.prefix_id[at]
            whole = piece >= 0
            rows.append(live[whole])
            pieces.append(piece[whole])
            spans.append(np.full(len(rows[-1]), k + 1, np.uint8))
            if k == 0:
                bare[rows[0]] = False
            more = words.goes_on[at]
            live, h = live[more], h[more]
        alone = np.flatnonzero(bare)
        row, piece, span = np.concatenate([*rows, alone]), np.concatenate([*pieces, np.full(len(alone), -1, np.int32)]), np.concatenate([*spans, np.ones(len(alone), np.uint8)])
        # By distance to the field's end, then row, then length: the sums go from ends to beginnings.
        count = np.bincount(row, minlength=n)
        rank = np.argsort(left.astype(np.int16) if left.max(initial=0) < 1 << 15 else left, kind="stable")  # two-byte keys sort by radix
        slot = np.empty(n, np.int64)
        slot[rank] = np.cumsum(count[rank]) - count[rank]
        order = np.empty(len(row), np.int64)
        at = 0
        for part in (*rows, alone):  # the parts come by length
            order[at : at + len(part)] = slot[part]
            slot[part] += 1
            at += len(part)
        self.piece = np.empty(len(row), np.int32)
        self.piece[order] = piece
        row, piece = np.empty_like(row), row
        row[order] = piece
        piece, span = span, np.empty_like(span)
        span[order] = piece
        weight = np.where(self.piece >= 0, words.weight[self.piece], words.byte_weight * self.bytes[row])
        head = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
        mass = np.zeros(n + 1)
        far = left[row]
        cuts = np.flatnonzero(np.concatenate([[True], far[1:] != far[:-1], [True]])) if len(row) else np.zeros(1, np.int64)
        heads = np.searchsorted(head, cuts)
        onward = np.where(far > span, row + span, n)  # the place n has mass 0 and stays so
        for a, b, x, y in zip(cuts, cuts[1:], heads, heads[1:]):
            score = weight[a:b] + mass[onward[a:b]]
            local = head[x:y] - a
            top = np.maximum.reduceat(score, local)
            size = np.diff(np.append(local, b - a))
            own = top + np.log(np.add.reduceat(np.exp(score - np.repeat(top, size)), local))
            mass[row[a:b][local]] = own
            weight[a:b] = score - np.repeat(own, size)
        self.log_prob = weight
        share = np.exp(weight)
        size = np.diff(np.append(head, len(row)))
        best = share == np.repeat(np.maximum.reduceat(share, head), size) if len(row) else np.zeros(0, bool)
        rest = np.repeat(np.add.reduceat(np.where(best, 0, share), head), size) if len(row) else np.zeros(0)
        with np.errstate(divide="ignore"):  # what is left when the edge goes; ties of the largest have a half or less
            self.log_rest = np.log(np.where(best & (share > 0.5), rest, 1 - np.minimum(share, 0.5)))
        self.width = int(span.max(initial=1))
        at = row * self.width + span - 1  # flat places are much faster to index than pairs
        self.edge = np.full((n, self.width), -1, np.int32)
        self.edge.ravel()[at] = np.arange(len(row), dtype=np.int32)
        below = np.zeros((n, self.width), np.float32)
        below.ravel()[at] = share
        np.cumsum(below, axis=1, out=below)
        # Eight comparisons are counted as one word, so rows are filled up to words.
        self.below = np.full((n, -(-self.width // 8) * 8), np.inf, np.float32)
        np.divide(below, below[:, -1:], out=self.below[:, : self.width])

    def allowed(self, row: np.ndarray, barred: np.ndarray) -> np.ndarray:
        """Log-probabilities of the rows' edges by length; -inf where there is none or its bit is barred."""
        edge = self.edge[row]
        return np.where((edge >= 0) & (barred[:, None] >> np.arange(self.width) & 1 == 0), self.log_prob[edge], -np.inf)

    def edge_of(self, row: np.ndarray, length: np.ndarray) -> np.ndarray:
        return self.edge.ravel().take(row.astype(np.int64) * self.width + length - 1)

    def drawn(self, row: np.ndarray, u: np.ndarray) -> np.ndarray:
        """The lengths of the rows' edges at which the running shares reach u."""
        passed = np.bitwise_count((u[:, None] > self.below.take(row, axis=0)).view(np.uint64))
        took = passed[:, 0] + 1
        for k in range(1, passed.shape[1]):
            took += passed[:, k]
        return np.minimum(took, self.width).astype(np.uint8)

    def ids(self, row: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of edges, and how many each edge has (bytes have several)."""
        piece = self.piece[self.edge_of(row, length)]
        bare = piece < 0
        count = np.where(bare, self.bytes[row], 1)
        out = np.repeat(piece, count)
        if bare.any():
            raw = np.frombuffer("".join(map(chr, self.point[row[bare]].tolist())).encode("utf-8", "surrogatepass"), np.uint8)
            out[np.repeat(bare, count)] = self.words.byte_id[raw]
        return out, count


_tables: dict[int, np.ndarray] = {}


def powers(n: int, base: int = int(_P)) -> np.ndarray:
    out = _tables.get(base, np.ones(1, np.uint64))
    while len(out) < n:
        out = np.concatenate([out, out * np.uint64(pow(base, len(out), 1 << 64))])
    _tables[base] = out
    return out[:n]


class Path:
    """One path of every text: its edges, and for each edge the value of the best path that leaves there."""

    def __init__(self, at, row, length, log_prob, text, value, branch, barred, bounds):
        self.at, self.row, self.length, self.log_prob, self.text, self.value, self.branch, self.barred = at, row, length, log_prob, text, value, branch, barred
        self.edge_bounds = np.searchsorted(at, bounds)
        self.total = np.add.reduceat(np.append(log_prob, 0.0), self.edge_bounds[:-1]) * (np.diff(self.edge_bounds) > 0)
        self.open = np.full(len(at), -np.inf)


def sample(lattices: Lattices, seeds: np.ndarray, k: int) -> tuple[list[Path], np.ndarray]:
    """The first k paths of every text (value -inf where it has no more) and the (k + 1)-th value."""
    bounds, n_texts = lattices.bounds, len(lattices.bounds) - 1
    start_of_text = bounds[:-1]
    text_of = np.repeat(np.arange(n_texts, dtype=np.int32), np.diff(bounds))
    row_of = np.repeat((lattices.field_row - lattices.field_at).astype(np.int32), lattices.field_size) + np.arange(lattices.n, dtype=np.int32)
    field_end = np.repeat((lattices.field_at + lattices.field_size).astype(np.int32), lattices.field_size)

    def walk(place, salt, length):
        """Follows drawn edges from each place to the end of its field; writes them to `length`."""
        while len(place):
            text = text_of[place]
            u = uniform(seeds[text], place - start_of_text[text], salt).astype(np.float32)
            took = lattices.drawn(row_of[place], u)
            length[place] = took
            place, end = place + took, field_end[place]
            place = place[place < end]

    def opened(length, value, branch, barred, salt):
        at = np.flatnonzero(length)
        row, text, took = row_of[at], text_of[at], length[at].astype(np.int64)
        edge = lattices.edge_of(row, took)
        log_prob = lattices.log_prob[edge]
        path = Path(at, row, took, log_prob, text, value, branch, barred, bounds)
        ahead = np.cumsum(log_prob) - log_prob
        ahead -= np.repeat(ahead[np.minimum(path.edge_bounds[:-1], max(0, len(at) - 1))] if len(at) else 0, np.diff(path.edge_bounds))
        leave = ahead + lattices.log_rest[edge]
        special = np.flatnonzero(at == branch[text])
        if len(special):
            with np.errstate(divide="ignore"):
                leave[special] = ahead[special] + np.log(np.exp(lattices.allowed(row[special], barred[text[special]])).sum(axis=1))
        noise = -np.log(uniform(seeds[text], at - start_of_text[text], salt))
        top = value[text]
        with np.errstate(over="ignore", invalid="ignore"):
            out = leave - np.log(np.exp(leave - top) + noise)
        out[~np.isfinite(leave) | ~np.isfinite(top) | (at < branch[text])] = -np.inf
        path.open = out
        return path

    root = -np.log(-np.log(uniform(seeds, np.zeros(n_texts), 1)))
    length = np.zeros(lattices.n, np.uint8)
    walk(lattices.field_at.copy(), 2, length)
    none = np.full(n_texts, -1)
    paths, lengths = [opened(length, root, none, np.zeros(n_texts, np.int64), 3)], [length]
    while True:
        best, parent, edge = np.full(n_texts, -np.inf), np.zeros(n_texts, np.int64), np.zeros(n_texts, np.int64)
        for i, path in enumerate(paths):
            some = np.flatnonzero(np.diff(path.edge_bounds) > 0)
            if not len(some):
                continue
            top = np.maximum.reduceat(path.open, path.edge_bounds[:-1][some])
            full = np.full(n_texts, -np.inf)
            full[some] = top
            hit = np.flatnonzero(path.open == full[path.text])
            where = np.zeros(n_texts, np.int64)
            where[path.text[hit][::-1]] = hit[::-1]
            better = full > best
            best[better], parent[better], edge[better] = full[better], i, where[better]
        if len(paths) == k:
            return paths, best
        number = len(paths)
        live = np.flatnonzero(np.isfinite(best))
        length = np.zeros(lattices.n, np.uint8)
        branch, barred = np.full(n_texts, -1), np.zeros(n_texts, np.int64)
        resume = []
        for i, path in enumerate(paths):
            mine = live[parent[live] == i]
            if not len(mine):
                continue
            e = edge[mine]
            at, row = path.at[e], path.row[e]
            mask = np.where(path.branch[mine] == at, path.barred[mine], np.int64(1) << (path.length[e] - 1))
            weight = lattices.allowed(row, mask)
            share = np.cumsum(np.exp(weight - weight.max(axis=1, keepdims=True)), axis=1)
            u = uniform(seeds[mine], at - start_of_text[mine], 10 * number + 4)
            took = np.minimum((u[:, None] * share[:, -1:] > share).sum(axis=1), lattices.width - 1) + 1
            path.open[e] = -np.inf  # the new path stands for the rest of this node
            limit = np.full(n_texts, -1)
            limit[mine] = at
            keep = lengths[i] * (np.arange(lattices.n) < np.repeat(limit, np.diff(bounds)))
            length += keep.astype(np.uint8)
            length[at] = took
            branch[mine], barred[mine] = at, mask | (np.int64(1) << (took - 1))
            resume.append(np.stack([mine, at + took, field_end[at]]))
        if resume:
            mine, place, end = np.concatenate(resume, axis=1)
            after = np.full(n_texts, lattices.n + 1)
            after[mine] = end
            fresh = lattices.field_at[lattices.field_at >= after[text_of[lattices.field_at]]]
            walk(np.sort(np.concatenate([place[place < end], fresh])), 10 * number + 2, length)
        paths.append(opened(length, best, branch, barred, 10 * number + 3))
        lengths.append(length)


FIELDS = [("sample", T.IntegerType()), ("ids", T.ArrayType(T.IntegerType())), ("log_prob", T.DoubleType()), ("perturbed", T.DoubleType()), ("inclusion", T.DoubleType()), ("round_trip", T.BooleanType())]


def encode_samples(docs: DataFrame, model: str, key: str, text: str = "text", k: int = SAMPLES, seed: int = 0, drop: bool = True, scale: float | None = None) -> DataFrame:
    """One row for each row of `docs` and sample: ids, log_prob, perturbed value, inclusion probability, round_trip.

    `round_trip` says that decoding the ids gives the text. `model` is a file that each Python worker can read.
    """
    kept = [c for c in without(docs.columns, *dict(FIELDS)) if not (drop and c == text)]
    source = docs.select(*[f"`{c}`" for c in kept], docs[text].alias(free(kept, "__text")), F.xxhash64(F.lit(seed), docs[key]).alias(free(kept, "__seed")))
    width = len(source.columns) - 2
    schema = T.StructType([*source.schema.fields[:width], *(T.StructField(*f) for f in FIELDS)])

    def run(batches):
        words = vocabulary_of(model, scale)
        for batch in batches:
            for part in sliced(batch, width, SLICE):
                yield _samples(part, width, words, k, schema.names)

    return small_batches(source).mapInArrow(in_tasks(run), schema)


def _samples(part: pa.RecordBatch, width: int, words: Vocabulary, k: int, names: list[str]) -> pa.RecordBatch:
    texts = [t or "" for t in part.column(width).to_pylist()]
    lattices = Lattices(words, texts)
    seeds = part.column(width + 1).to_numpy(zero_copy_only=False).view(np.uint64)
    paths, threshold = sample(lattices, seeds, k)
    rows, number, flat, sizes, log_prob, value, inclusion, whole = [], [], [], [], [], [], [], []
    raw = [b" " + t.encode() if t else b"" for t in texts]
    text_ends = np.cumsum([0, *map(len, raw)])
    joined = b"".join(raw)
    for j, path in enumerate(paths):
        ids, count = lattices.ids(path.row, path.length)
        ends = np.concatenate([[0], np.cumsum(count)])[path.edge_bounds]
        has = np.isfinite(path.value) if j else np.ones(len(texts), bool)
        at = np.flatnonzero(has)
        flat.append(ids)  # a text without this path has no edges in it
        if has.all() and words.decode(ids) == joined:
            whole.append(np.ones(len(at), bool))
        else:
            whole.append(np.array([words.decode(ids[ends[i] : ends[i + 1]]) == joined[text_ends[i] : text_ends[i + 1]] for i in at.tolist()], bool))
        rows.append(at)
        number.append(np.full(len(at), j + 1, np.int32))
        sizes.append(np.diff(ends)[at])
        log_prob.append(path.total[at])
        value.append(path.value[at])
        with np.errstate(over="ignore"):
            inclusion.append(-np.expm1(-np.exp(path.total[at] - threshold[at])))
    index = pa.array(np.concatenate(rows))
    offsets = np.concatenate([[0], np.cumsum(np.concatenate(sizes))]).astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(flat) if flat else np.empty(0, np.int32)))
    return pa.RecordBatch.from_arrays([*(part.column(i).take(index) for i in range(width)), pa.array(np.concatenate(number)), lists, *(pa.array(np.concatenate(x)) for x in (log_prob, value, inclusion)), pa.array(np.concatenate(whole))], names=names)


def decode_pieces(rows: DataFrame, model: str, ids: str = "ids", to: str = "decoded") -> DataFrame:
    """`rows` plus the text of the piece ids (null for null)."""
    kept = without(rows.columns, to)
    source = rows.select(*[f"`{c}`" for c in kept], F.col(ids).alias(free(kept, "__ids")))
    schema = T.StructType([*source.schema.fields[:-1], T.StructField(to, T.StringType())])

    def run(batches):
        words = vocabulary_of(model)
        for batch in batches:
            found = [None if x is None else words.decode(np.array(x, np.int64))[1:].decode() for x in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, pa.string())], names=schema.names)

    return small_batches(source).mapInArrow(in_tasks(run), schema)


def op5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = encode_samples(docs, public_tokenizers.path("piece_bpe_32k.model"), "doc_id")
    return out.select("doc_id", "sample", F.size("ids").cast("long").alias("n_pieces"), "ids", "log_prob", "perturbed", "inclusion", "round_trip")
