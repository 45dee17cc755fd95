"""Alignment of two tokenizers: groups of tokens that cover the same bytes, and links between token ids counted over all documents.

A (byte-level BPE, tokenizers' JSON) encodes a space and the text; B (sentencepiece with byte fallback) the text, to
which it adds the space. Byte offsets where tokens of both end cut them into groups; each A token of a group is linked to
each B token of it. An id pair's count is the number of documents that hold it linked.

1. A text falls into units, white space and what follows, at whose bounds both tokenizers end a token; units are
   encoded by the libraries once and kept in a bounded cache. All tokens of a slice are grouped side by side.
2. A text of more than `CHUNK` bytes is cut into byte ranges that tasks encode apart. A range takes the A tokens of the
   pre-tokens and the B tokens of the units that begin in it, so that either may reach over its end. Its fragment is
   an open head (tokens up to the first common end), closed groups, and an open tail (tokens after the last one).
   Fragments compose associatively: tail and head of neighbours are joined, and what gets a common end is closed. Tasks
   reduce a document's fragments as a tree, `FAN` at a time; closed groups stay where they are and are put in order once, at
   the end, by a stream over sorted rows.
3. Pairs of ids are counted by document. A document's sums look the counts up in sorted arrays, where these are few
   enough to be sent to all tasks, or else by a join; that choice changes the work, not the result.

Defined cases: null and empty texts, and texts whose tokens do not spell them (such as those with U+2581), have no
tokens and no links; rows count one by one, whatever their ids; columns other than id and text are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
import re
from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.base import Tables, in_tasks, sliced, small_batches, table, text_bytes
from tidemark.llm.token_counts import SPACE, SPLIT, byte_alphabet

CHUNK, FAN = 65_536, 16
CACHE = 300_000  # units of one worker
LINKS = 1 << 20  # links expanded at once
CHECKED_PAIRS = 2_000_000  # pairs of ids that may be sent to all tasks: 17 bytes each
_NONE = np.empty(0, np.int64)
_SIDES = ("a", "a_end", "b", "b_end")


class Tokens(NamedTuple):
    """Token ids of both sides and the byte offsets where they end."""

    a: np.ndarray
    a_end: np.ndarray
    b: np.ndarray
    b_end: np.ndarray

    def upto(self, end: int) -> Tokens:
        i, j = np.searchsorted(self.a_end, end, "right"), np.searchsorted(self.b_end, end, "right")
        return Tokens(self.a[:i], self.a_end[:i], self.b[:j], self.b_end[:j])

    def after(self, end: int) -> Tokens:
        i, j = np.searchsorted(self.a_end, end, "right"), np.searchsorted(self.b_end, end, "right")
        return Tokens(self.a[i:], self.a_end[i:], self.b[j:], self.b_end[j:])

    def before(self, other: Tokens) -> Tokens:
        return Tokens(*(np.concatenate(x) for x in zip(self, other)))


EMPTY = Tokens(_NONE, _NONE, _NONE, _NONE)


class Fragment(NamedTuple):
    """A stretch of a document. Open: a head that ends at the first common end (all tokens, if there is none), and a tail."""

    head: Tokens
    tail: Tokens
    closed: bool


def fragment(tokens: Tokens) -> tuple[Fragment, Tokens]:
    """The fragment of the tokens of a stretch, and the tokens of the groups that it closes."""
    common = np.intersect1d(tokens.a_end, tokens.b_end, assume_unique=True)
    if not len(common):
        return Fragment(tokens, EMPTY, False), EMPTY
    return Fragment(tokens.upto(common[0]), tokens.after(common[-1]), True), tokens.after(common[0]).upto(common[-1])


def composed(one: Fragment, two: Fragment) -> tuple[Fragment, Tokens]:
    """The fragment of both stretches together, and the tokens of the groups that their meeting closes."""
    if not one.closed:
        met, closed = fragment(one.head.before(two.head))
        return Fragment(met.head, two.tail if two.closed else met.tail, met.closed), closed
    met, closed = fragment(one.tail.before(two.head))
    if not met.closed:
        return Fragment(one.head, met.head, True), EMPTY
    return Fragment(one.head, two.tail if two.closed else met.tail, True), met.head.before(closed)


class Both:
    """The two tokenizers, and tables over their ids."""

    def __init__(self, a_path: str, b_path: str):
        from sentencepiece import sentencepiece_model_pb2
        from tokenizers import Tokenizer

        with open(a_path, encoding="utf-8") as f:
            spec = json.load(f)
        level = spec.get("pre_tokenizer") or {}
        if spec.get("normalizer") or level.get("type") != "ByteLevel" or level.get("add_prefix_space") or not level.get("use_regex", True):
            raise ValueError("A must be a byte-level BPE without a normalizer and without a space of its own")
        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        alphabet = byte_alphabet()
        self.a_bytes = [b""] * (1 + max(spec["model"]["vocab"].values(), default=-1))
        for piece, i in spec["model"]["vocab"].items():
            self.a_bytes[i] = bytes(alphabet[c] for c in piece) if all(c in alphabet for c in piece) else b""
        model = sentencepiece_model_pb2.ModelProto()
        with open(b_path, "rb") as f:
            model.ParseFromString(f.read())
        normal = model.normalizer_spec
        if not normal.add_dummy_prefix or normal.remove_extra_whitespaces or normal.precompiled_charsmap or model.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("B must add one space before the text and take the rest as it is")
        normal.add_dummy_prefix = False  # units bring their own space
        self.b = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
        n = self.b.get_piece_size()
        pieces = [self.b.id_to_piece(i) for i in range(n)]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        #: White space that some piece of B holds behind other characters does not begin a unit.
        inside = {c for p in pieces for d, c in zip(p, p[1:]) if c in SPACE + "▁" and d not in SPACE + "▁"}
        if "▁" in inside or " " in inside:
            raise ValueError("pieces of B must not reach over a space")
        begin = "".join(c for c in SPACE if c not in inside)
        glue = "".join(sorted(c for c in inside))
        more = f"(?:[{re.escape(glue)}][{SPACE}]*+[^{SPACE}]*+)*+" if glue else ""
        self.units = re.compile(f"[{SPACE}]*+[^{SPACE}]++{more}|[{SPACE}]++")
        self.bound = re.compile(f"(?<=[^{SPACE}])[{begin}]")
        self.words = regex.compile(SPLIT)
        self.pairs = n
        texts = [f"{i}{s}".encode() for i in range(max(len(self.a_bytes), n)) for s in ("", ",", "|", ";")]
        self.spelled, self.spelled_at = np.frombuffer(b"".join(texts), np.uint8), offsets_of(texts)
        self.sides = [(np.frombuffer(b"".join(x), np.uint8), offsets_of(x)) for x in (self.a_bytes, self.b_bytes)]
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        #: Of the known units, by number: bytes, whether they are spelled, and of each side where their tokens begin.
        self.size, self.good, self.at = _NONE, np.empty(0, bool), [np.zeros(1, np.int64)] * 2
        self.ids, self.ends = [np.empty(0, np.int32)] * 2, [np.empty(0, np.int32)] * 2

    def learn(self, units: list[str]) -> None:
        """Encodes the units that the cache lacks, all at once."""
        new = list(dict.fromkeys(u for u in units if u not in self.known))
        if new and len(self.known) + len(new) > CACHE:
            self.forget()
            new = list(dict.fromkeys(units))
        if not new:
            return
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        raw, raw_at = text_bytes(pa.array(new, pa.string()))
        size, good = np.diff(raw_at), np.ones(len(new), bool)
        for side, lists in enumerate(([e.ids for e in self.a.encode_batch_fast(new, add_special_tokens=False)], self.b.encode(new, num_threads=1))):
            count = np.fromiter(map(len, lists), np.int64, len(lists))
            ids = np.fromiter(chain.from_iterable(lists), np.int64, count.sum())
            data, at = self.sides[side]
            length = at[ids + 1] - at[ids]
            total = np.concatenate([[0], np.cumsum(length)])
            first = np.concatenate([[0], np.cumsum(count)])
            fit = np.diff(total[first]) == size
            spelled, own = data[ragged(at[ids], length)], raw[ragged(raw_at[:-1][fit], size[fit])]
            spelled = spelled[np.repeat(fit, np.diff(total[first]))]
            fit[np.flatnonzero(fit)[np.repeat(np.arange(fit.sum()), size[fit])[spelled != own]]] = False
            good &= fit
            self.ids[side] = np.concatenate([self.ids[side], ids.astype(np.int32)])
            self.ends[side] = np.concatenate([self.ends[side], (total[1:] - np.repeat(total[first[:-1]], count)).astype(np.int32)])
            self.at[side] = np.concatenate([self.at[side], self.at[side][-1] + first[1:]])
        self.size, self.good = np.concatenate([self.size, size]), np.concatenate([self.good, good])
        self.known.update(zip(new, range(len(self.known), len(self.known) + len(new))))

    def encoded(self, units: list[str], owner: np.ndarray) -> tuple[Tokens, list[np.ndarray], np.ndarray]:
        """Tokens of units that follow each other, the owners of the A and of the B tokens, and which units are not spelled."""
        self.learn(units)
        code = np.fromiter(map(self.known.__getitem__, units), np.int64, len(units))
        size = self.size[code]
        begin = np.cumsum(size) - size
        out, owners = [], []
        for side in (0, 1):
            n = self.at[side][code + 1] - self.at[side][code]
            at = ragged(self.at[side][code], n)
            out += [self.ids[side][at].astype(np.int64), self.ends[side][at] + np.repeat(begin, n)]
            owners.append(np.repeat(owner, n))
        return Tokens(*out), owners, ~self.good[code]

    def cut(self, text: str, chunk: int) -> Iterator[tuple[int, str, int, str, int]]:
        """(number, A's text, its byte offset, B's text, its offset) of ranges of about `chunk` bytes."""
        raw = text.encode()
        at = a_from = b_from = a_at = b_at = number = chars = 0
        while at < len(raw):
            end = min(at + chunk, len(raw))
            while end < len(raw) and raw[end] & 0xC0 == 0x80:
                end += 1
            chars += len(raw[at:end].decode())
            at = end
            a_to = b_to = len(text)
            if at < len(raw):
                b_to = m.start() if (m := self.bound.search(text, max(chars, b_from))) else len(text)
                a_to = self._word_from(text, a_from, max(chars, a_from))
            a_text, b_text = text[a_from:a_to], text[b_from:b_to]
            yield number, a_text, a_at, b_text, b_at
            a_at, b_at, a_from, b_from, number = a_at + len(a_text.encode()), b_at + len(b_text.encode()), a_to, b_to, number + 1

    def _word_from(self, text: str, known: int, at: int) -> int:
        """The first beginning of a pre-token from `at` on that follows no white space; `known` is one."""
        width, start = 256, known
        while known < at - width:
            last = None
            for last in self.bound.finditer(text, at - width, at):
                pass
            if last:
                start = last.start()
                break
            width *= 4
        for m in self.words.finditer(text, start):
            if m.start() >= at and m.start() > 0 and text[m.start() - 1] not in SPACE:
                return m.start()
        return len(text)


@functools.lru_cache(2)
def both_of(a_path: str, b_path: str) -> Both:
    return Both(a_path, b_path)


def offsets_of(parts: list[bytes]) -> np.ndarray:
    return np.cumsum([0, *map(len, parts)])


def ragged(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, ... (size[0] numbers), begin[1], ..."""
    total = np.cumsum(size)
    return np.arange(total[-1] if len(total) else 0) + np.repeat(begin - total + size, size)


class Summary(NamedTuple):
    """Of owners 0 .. n-1: counts, the groups' listing, and their id pairs with how often each is linked."""

    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    n_links: np.ndarray
    listing: list[bytes]
    pair_at: np.ndarray
    pair: np.ndarray
    times: np.ndarray


def summary(both: Both, tokens: Tokens, owner_a: np.ndarray, owner_b: np.ndarray, n: int) -> Summary:
    """Of tokens whose groups are all closed. Offsets ascend over all owners, and an owner's last end is common."""
    common = np.intersect1d(tokens.a_end, tokens.b_end, assume_unique=True)
    group_a, group_b = np.searchsorted(common, tokens.a_end), np.searchsorted(common, tokens.b_end)
    size_a, size_b = np.bincount(group_a, minlength=len(common)), np.bincount(group_b, minlength=len(common))
    owner = np.zeros(len(common), np.int64)
    owner[group_a] = owner_a
    sums = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[np.searchsorted(owner, np.arange(n + 1))])
    # The listing: each id with what follows it.
    order = np.argsort(np.concatenate([2 * group_a, 2 * group_b + 1]), kind="stable")
    ids, group = np.concatenate([tokens.a, tokens.b])[order], np.concatenate([group_a, group_b])[order]
    side, own = order >= len(tokens.a), owner[group]
    mark = np.zeros(len(ids), np.int64)
    if len(ids) > 1:
        mark[:-1] = np.where(own[1:] != own[:-1], 0, np.where(group[1:] != group[:-1], 3, np.where(side[1:] != side[:-1], 2, 1)))
    entry = 4 * ids + mark
    length = both.spelled_at[entry + 1] - both.spelled_at[entry]
    spelled = both.spelled[ragged(both.spelled_at[entry], length)]
    ends = np.concatenate([[0], np.cumsum(length)])[np.searchsorted(own, np.arange(n + 1))].tolist()
    listing = [spelled[a:b].tobytes() for a, b in zip(ends, ends[1:])]
    # The links, in blocks.
    every = size_b[group_a]
    first_b = np.cumsum(size_b) - size_b
    total = np.cumsum(every)
    found, start = [(_NONE, _NONE)], 0
    span = len(both.a_bytes) * both.pairs
    while start < len(every):
        stop = max(start + 1, int(np.searchsorted(total, (total[start - 1] if start else 0) + LINKS, "right")))
        part = slice(start, stop)
        other = tokens.b[ragged(first_b[group_a[part]], every[part])]
        key = np.repeat(owner_a[part] * span + tokens.a[part] * both.pairs, every[part]) + other
        found.append(np.unique(key, return_counts=True))
        start = stop
    key, times = merged(*(np.concatenate(x) for x in zip(*found)))
    pair_at = np.searchsorted(key, np.arange(n + 1) * span)
    return Summary(np.bincount(owner_a, minlength=n), np.bincount(owner_b, minlength=n), np.bincount(owner, minlength=n), sums(size_a * size_b), listing, pair_at, key % span, times)


def merged(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different keys, sorted, with the sum of their numbers."""
    order = np.argsort(key, kind="stable")
    key, total = key[order], np.concatenate([[0], np.cumsum(n[order])])
    last = np.flatnonzero(np.concatenate([key[1:] != key[:-1], [True]])) if len(key) else _NONE
    return key[last], np.diff(np.concatenate([[0], total[last + 1]]))


_LONGS = pa.list_(pa.int64())
_RESULT = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, groups string, pairs array<long>, times array<long>"
_FIRST = f"row long, id string, no int, a_text string, a_at long, b_text string, b_at long, {_RESULT}"
_OPEN = ", ".join(f"{part}_{side} array<long>" for part in ("head", "tail") for side in _SIDES)
_PIECE = f"row long, id string, no int, {_OPEN}, closed boolean, bad boolean, at long, n_a long, n_b long, n_groups long, n_links long, listing binary, pairs array<long>, times array<long>"


def _names(schema: str) -> list[str]:
    return [part.split()[0] for part in schema.split(", ")]


def _first(both: Both, chunk: int, groups: bool):
    """Rows (text, row, id) to results, or for long texts to their ranges."""

    def run(batches):
        for part in (p for batch in batches for p in sliced(batch, 0)):
            texts = part.column(0).to_pylist()
            short = [i for i, t in enumerate(texts) if not t or len(t) <= chunk and len(t.encode()) <= chunk]
            yield results(part, texts, short)
            taken = set(short)
            for i in (i for i in range(len(texts)) if i not in taken):
                row, name = part.column(1)[i].as_py(), part.column(2)[i].as_py()
                for cut in both.cut(" " + texts[i], chunk):
                    yield pa.RecordBatch.from_arrays([pa.array([row], pa.int64()), pa.array([name], pa.string()), pa.array([cut[0]], pa.int32()), *(pa.array([x]) for x in cut[1:]), *nothing(1)], names=_names(_FIRST))

    def nothing(n):
        return [*[pa.nulls(n, pa.int64())] * 4, *[pa.nulls(n, pa.string())] * 2, *[pa.nulls(n, _LONGS)] * 2]

    def results(part, texts, short):
        found = [both.units.findall(" " + texts[i]) if texts[i] else [] for i in short]
        units = [u for f in found for u in f]
        owner = np.repeat(np.arange(len(short)), [len(f) for f in found])
        tokens, (owner_a, owner_b), wrong = both.encoded(units, owner)
        bad = np.zeros(len(short), bool)
        bad[owner[wrong]] = True
        keep_a, keep_b = ~bad[owner_a], ~bad[owner_b]
        tokens = Tokens(tokens.a[keep_a], tokens.a_end[keep_a], tokens.b[keep_b], tokens.b_end[keep_b])
        s = summary(both, tokens, owner_a[keep_a], owner_b[keep_b], len(short))
        rows = pa.array(short, pa.int64())
        n = len(short)
        lists = [pa.ListArray.from_arrays(pa.array(s.pair_at, pa.int32()), pa.array(x)) for x in (s.pair, s.times)]
        digest = [hashlib.sha256(x).hexdigest() if x else "" for x in s.listing]
        listed = pa.array([x.decode() for x in s.listing]) if groups else pa.nulls(n, pa.string())
        counts = [pa.array(x, pa.int64()) for x in (s.n_a, s.n_b, s.n_groups, s.n_links)]
        empty = [pa.nulls(n, t) for t in (pa.int32(), pa.string(), pa.int64(), pa.string(), pa.int64())]
        return pa.RecordBatch.from_arrays([part.column(1).take(rows), part.column(2).take(rows), *empty, *counts, pa.array(digest, pa.string()), listed, *lists], names=_names(_FIRST))

    return run


def _piece(both: Both, row: int, name: str | None, no: int | None, bad: bool, made: Fragment | None, closed: Tokens) -> pa.RecordBatch:
    """A row with a fragment, if there is one, and with the summary of closed groups."""
    n_a, n_b = len(closed.a), len(closed.b)
    s = summary(both, closed, np.zeros(n_a, np.int64), np.zeros(n_b, np.int64), 1)
    open_ = [*made.head, *made.tail] if made else [None] * 8
    columns = [
        pa.array([row], pa.int64()), pa.array([name], pa.string()), pa.array([no], pa.int32()), *(pa.array([x], _LONGS) for x in open_),
        pa.array([made.closed if made else None], pa.bool_()), pa.array([bad]), pa.array([int(closed.a_end[-1]) if n_a else -1], pa.int64()),
        *(pa.array(x, pa.int64()) for x in (s.n_a, s.n_b, s.n_groups, s.n_links)), pa.array(s.listing, pa.binary()), pa.array([s.pair], _LONGS), pa.array([s.times], _LONGS),
    ]
    return pa.RecordBatch.from_arrays(columns, names=_names(_PIECE))


def _ranges(both: Both):
    """Rows (row, id, no, a_text, a_at, b_text, b_at) to fragments."""

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                sides, bad = [], False
                for side in "ab":
                    units = both.units.findall(r[f"{side}_text"])
                    tokens, _, wrong = both.encoded(units, np.zeros(len(units), np.int64))
                    ids, ends = (tokens.a, tokens.a_end) if side == "a" else (tokens.b, tokens.b_end)
                    sides += [ids, ends + r[f"{side}_at"]]
                    bad |= bool(wrong.any())
                made, closed = fragment(Tokens(*sides) if not bad else EMPTY)
                yield _piece(both, r["row"], r["id"], r["no"], bad, made, closed)

    return run


def _read_fragment(r: dict) -> Fragment:
    head, tail = (Tokens(*(np.array(r[f"{part}_{side}"], np.int64) for side in _SIDES)) for part in ("head", "tail"))
    return Fragment(head, tail, r["closed"])


def _reduced(a_path: str, b_path: str, last: bool):
    """For groupBy(row, part): the part's fragments, in order, to one, and the groups that this closes."""

    def run(rows):
        both = both_of(a_path, b_path)
        rows = sorted(rows.to_pylist(), key=lambda r: r["no"])
        made, out = None, []
        for r in rows:
            if made is None:
                made = _read_fragment(r)
                continue
            made, closed = composed(made, _read_fragment(r))
            if len(closed.a):
                out.append(_piece(both, r["row"], r["id"], None, False, None, closed))
        first = rows[0]
        if last:  # what precedes the first common end begins with the document
            rest = len(made.tail.a) + len(made.tail.b) + (0 if made.closed else len(made.head.a) + len(made.head.b))
            out.append(_piece(both, first["row"], first["id"], None, bool(rest), None, EMPTY if rest else made.head))
        else:
            out.append(_piece(both, first["row"], first["id"], first["no"] // FAN, False, made, EMPTY))
        return pa.Table.from_batches(out)

    return run


def _finished(groups: bool):
    """Pieces sorted by row and place, never a row in two tasks, to results."""

    class Open:
        def __init__(self, row, name):
            self.row, self.name, self.bad, self.counts = row, name, False, np.zeros(4, np.int64)
            self.sha, self.parts, self.key, self.times = hashlib.sha256(), [], _NONE, _NONE

        def add(self, r):
            self.bad |= r["bad"]
            self.counts += [r["n_a"], r["n_b"], r["n_groups"], r["n_links"]]
            if r["listing"]:
                text = b";" + r["listing"] if self.counts[2] > r["n_groups"] else r["listing"]
                self.sha.update(text)
                if groups:
                    self.parts.append(text)
            self.key, self.times = merged(np.concatenate([self.key, np.array(r["pairs"], np.int64)]), np.concatenate([self.times, np.array(r["times"], np.int64)]))

        def row_of(self):
            if self.bad or not self.counts[2]:
                self.counts, self.parts, self.key, self.times = np.zeros(4, np.int64), [], _NONE, _NONE
            digest = self.sha.hexdigest() if self.counts[2] else ""
            values = [self.row, self.name, *self.counts.tolist(), digest, b"".join(self.parts).decode() if groups else None, self.key, self.times]
            types = [pa.int64(), pa.string(), *[pa.int64()] * 4, pa.string(), pa.string(), _LONGS, _LONGS]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types)], names=["row", "id", *_names(_RESULT)])

    def run(batches):
        held = None
        for batch in batches:
            for i in range(batch.num_rows):
                r = batch.slice(i, 1).to_pylist()[0]
                if held is None or held.row != r["row"]:
                    if held:
                        yield held.row_of()
                    held = Open(r["row"], r["id"])
                held.add(r)
        if held:
            yield held.row_of()

    return run


def _counted(batches):
    """Lists of different pairs to (pair, n), added up in the task as far as memory is bounded."""
    parts, held = [], 0

    def flush():
        key, n = merged(*(np.concatenate(x) for x in zip(*parts)))
        return pa.RecordBatch.from_arrays([pa.array(key), pa.array(n)], names=["pair", "n"])

    for batch in batches:
        parts.append(np.unique(batch.column(0).flatten().to_numpy(), return_counts=True))
        held += len(parts[-1][0])
        if held > LINKS:
            parts = [merged(*(np.concatenate(x) for x in zip(*parts)))]
            if len(parts[0][0]) > LINKS // 2:
                yield flush()
                parts = []
            held = sum(len(p[0]) for p in parts)
    if parts:
        yield flush()


def aligned(docs: DataFrame, a_path: str, b_path: str, tables: Tables, id: str = "doc_id", text: str = "text", chunk: int = CHUNK, groups: bool = False) -> DataFrame:
    """(row, id as text, counts, groups_sha256, groups, pairs, times) of each row; the paths must be readable in tasks."""
    source = docs.select(F.col(text).alias("text"), F.monotonically_increasing_id().alias("row"), F.col(id).cast("string").alias("id"))
    with_both = lambda make: in_tasks(lambda batches: make(both_of(a_path, b_path))(batches))
    first = tables.written(small_batches(source).mapInArrow(with_both(lambda b: _first(b, chunk, groups)), _FIRST), "aligned")
    result = ["row", "id", *_names(_RESULT)]
    short, long = first.where("no is null").select(*result), first.where("no is not null")
    last = long.agg(F.max("no")).first()[0]
    if last is None:
        return short
    ranges = long.select("row", "id", "no", "a_text", "a_at", "b_text", "b_at").repartition("row", "no")
    made = tables.written(ranges.mapInArrow(with_both(_ranges), _PIECE), "fragments")
    pieces = made
    level = 0
    while True:
        last, level = last // FAN, level + 1
        some = made.where("no is not null").select("row", "id", "no", *_names(_OPEN), "closed", F.expr(f"no div {FAN}").alias("part"))
        made = tables.written(some.groupBy("row", "part").applyInArrow(_reduced(a_path, b_path, last == 0), _PIECE), f"reduced{level}")
        pieces = pieces.unionByName(made)
        if last == 0:
            break
    # A row of its own for each piece: the groups of a range, and those that ranges close where they meet.
    pieces = pieces.select("row", "id", "bad", "at", "n_a", "n_b", "n_groups", "n_links", "listing", "pairs", "times").repartition("row").sortWithinPartitions("row", "at")
    done = tables.written(pieces.mapInArrow(in_tasks(_finished(groups)), f"row long, id string, {_RESULT}"), "long_texts")
    return short.unionByName(done)


def pair_counts(found: DataFrame, b_size: int, tables: Tables) -> DataFrame:
    """(pair, a, b, n, best): in how many rows of `aligned` two ids are linked, and whether no id of B has a greater n with a."""
    counts = found.select("pairs").mapInArrow(in_tasks(_counted), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    counts = tables.written(counts.withColumns({"a": F.expr(f"pair div {b_size}"), "b": F.col("pair") % b_size}), "counts")
    most = tables.written(counts.groupBy("a").agg(F.max("n").alias("most")), "most")
    return tables.written(counts.join(most, "a").select("pair", "a", "b", "n", (F.col("n") == F.col("most")).alias("best")), "pair_counts")


def _looked_up(keys, n, best):
    """Rows (pairs, times, ...) to (..., n_best, count_sum)."""

    def run(batches):
        for batch in batches:
            pairs, times = batch.column(0), batch.column(1).flatten().to_numpy()
            at = np.searchsorted(keys.value, pairs.flatten().to_numpy())
            ends = np.concatenate([[0], np.cumsum(np.asarray(pairs.value_lengths()))])
            sums = [pa.array(np.diff(np.concatenate([[0], np.cumsum(times * x.value[at])])[ends])) for x in (best, n)]
            yield pa.RecordBatch.from_arrays([*batch.columns[2:], *sums], names=[*batch.schema.names[2:], "n_best", "count_sum"])

    return run


def align(docs: DataFrame, a_path: str, b_path: str, id: str = "doc_id", text: str = "text", chunk: int = CHUNK, groups: bool = False, checked_pairs: int = CHECKED_PAIRS) -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256), and the groups themselves if asked for.

    `checked_pairs`: up to so many pairs of ids are sent to all tasks.
    """
    spark, tables = docs.sparkSession, Tables()
    found = aligned(docs, a_path, b_path, tables, id, text, chunk, groups)
    counts = pair_counts(found, both_of(a_path, b_path).pairs, tables)
    kept = ["row", "id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", *(["groups"] if groups else [])]
    if counts.count() <= checked_pairs:
        known = counts.select("pair", "n", F.col("best").cast("long")).orderBy("pair").toArrow()
        sent = [spark.sparkContext.broadcast(c.to_numpy()) for c in known.columns]
        source = small_batches(found.select("pairs", "times", *kept))
        schema = T.StructType([*source.schema.fields[2:], T.StructField("n_best", T.LongType()), T.StructField("count_sum", T.LongType())])
        out = tables.written(source.mapInArrow(in_tasks(_looked_up(*sent)), schema), "sums")
        for s in sent:
            s.destroy()
    else:
        links = found.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
        sums = links.join(counts, "pair").groupBy("row").agg(F.sum(F.col("times") * F.col("best").cast("long")).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
        sums = tables.written(sums.withColumnRenamed("row", "of"), "link_sums")
        out = found.select(*kept).join(sums, F.col("row") == F.col("of"), "left").drop("of").fillna(0, ["n_best", "count_sum"])
        out = tables.written(out, "sums")
    tables.keep(out)
    return out.select(F.col("id").cast(docs.schema[id].dataType).alias(id), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", *(["groups"] if groups else []))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def brute_force(texts: list[str | None], a_path: str, b_path: str) -> list[tuple]:
    """(n_a, n_b, n_groups, n_links, n_best, count_sum, groups) of whole texts by the libraries, link by link; for tests."""
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(a_path), sentencepiece.SentencePieceProcessor(model_file=b_path)
    a.encode_special_tokens = True
    alphabet, docs, holders = byte_alphabet(), [], {}
    for number, text in enumerate(texts):
        groups: list[tuple[list[int], list[int]]] = []
        if text:
            raw = (" " + text).encode()
            ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
            bytes_a = [bytes(alphabet[c] for c in a.id_to_token(i)) for i in ids_a]
            bytes_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
            if b"".join(bytes_a) == raw == b"".join(bytes_b):
                ends_a, ends_b = (np.cumsum([len(x) for x in side]).tolist() for side in (bytes_a, bytes_b))
                start = 0
                for end in sorted(set(ends_a) & set(ends_b)):
                    groups.append(([i for i, e in zip(ids_a, ends_a) if start < e <= end], [i for i, e in zip(ids_b, ends_b) if start < e <= end]))
                    start = end
        docs.append(groups)
        for x, y in groups:
            for i in x:
                for j in y:
                    holders.setdefault((i, j), set()).add(number)
    count = {p: len(h) for p, h in holders.items()}
    most: dict[int, int] = {}
    for (i, _), n in count.items():
        most[i] = max(most.get(i, 0), n)
    out = []
    for groups in docs:
        links = [(i, j) for x, y in groups for i in x for j in y]
        listing = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups), len(groups), len(links), sum(count[p] == most[p[0]] for p in links), sum(count[p] for p in links), listing))
    return out
