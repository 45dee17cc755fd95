"""Exact token counts at every prefix, by dynamic programming over byte-level BPE.

For a word (a pre-token) the last token of each prefix is unique: it is the token t that ends the prefix and
whose pair with the last token before it is what the merges give for those bytes. So one pass over the word
gives the token count at each of its prefixes. A text is cut where no later character can change what was
counted (before white space that precedes a word), so its counts are the joined counts of its fields.

What is stored is the change of the count at each character, one signed byte each: the running sum at
character i is the number of tokens of text[:i]. Truncation and budget questions are answered from it.

Defined cases: null and empty texts have no characters and 0 tokens; special strings of the vocabulary inside
a text count one token from their last character on; a text of any length is taken whole. Vocabulary
files with what is not followed here (a normalizer, another split, tokens of over 128 bytes, ...) are refused.
"""

from __future__ import annotations

import functools
import json
import re

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.base import appended, table

#: The library's byte-level split, and Unicode's White_Space.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
CACHE = 500_000
TWO = (2,)


def byte_alphabet() -> dict[str, int]:
    """The characters that byte-level vocabularies write for the 256 bytes."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def refuse_unread(spec: dict) -> None:
    """Raises where a vocabulary file says something that the counts would not follow."""
    model, split = spec["model"], spec.get("pre_tokenizer") or {}
    alphabet = byte_alphabet()
    reasons = {
        "a model other than BPE": model.get("type", "BPE") != "BPE", "a normalizer": bool(spec.get("normalizer")), "a split other than the byte-level one": split.get("type") != "ByteLevel" or not split.get("use_regex", True),
        "a space of its own": bool(split.get("add_prefix_space")), "whole words before merges": bool(model.get("ignore_merges")), "marks of word ends": bool(model.get("end_of_word_suffix") or model.get("continuing_subword_prefix")),
        "added tokens that are not special": any(not t.get("special") for t in spec.get("added_tokens", [])), "tokens of over 128 bytes": any(len(t) > 128 for t in model.get("vocab", {}) if all(c in alphabet for c in t)),
    }
    if found := [name for name, wrong in reasons.items() if wrong]:
        raise ValueError("the vocabulary has " + ", ".join(found))


class PrefixCounter:
    """Counts of one vocabulary file (tokenizers' JSON, byte-level BPE)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        refuse_unread(spec)
        at = byte_alphabet()
        raw = lambda s: bytes(at[c] for c in s)
        pairs = [(raw(a), raw(b)) for a, b in (m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"])]
        #: A token's rank is that of the merge that makes it; single bytes come before all merges.
        self.rank = {bytes([b]): -1 for b in range(256)} | {a + b: i for i, (a, b) in reversed(list(enumerate(pairs)))}
        self.halves = {a + b: (a, b) for a, b in reversed(pairs)}
        self.ranks = {(a, b): i for i, (a, b) in reversed(list(enumerate(pairs)))}
        ends: dict[bytes, set[int]] = {}
        for t in self.rank:
            if len(t) > 2:
                ends.setdefault(t[-3:], set()).add(len(t))
        self.ends = {k: sorted(v | {2}, reverse=True) for k, v in ends.items()}
        self.seen, self.last, self.counts = b"", [b""], [0]
        self.special = [t["content"] for t in spec.get("added_tokens", []) if t.get("special")]
        self.pattern = regex.compile(SPLIT)
        self.fields = re.compile(f"[{SPACE}]*+[^{SPACE}]++|[{SPACE}]++")
        self.space = re.compile(f"[{SPACE}]*+")
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.fit: dict[tuple[bytes, bytes], bool] = {}
        self.word = Generations(self.word_changes)
        self.cache = Generations(self.field_changes)

    def fits(self, a: bytes, b: bytes) -> bool:
        """Whether the merges leave a and b side by side: no pair on their common border merges before both are made."""
        limit, left, right = 1 << 30, a, b
        while True:
            if self.ranks.get((left, right), limit) < limit:
                return False
            x, y = self.rank[left], self.rank[right]
            if x < 0 and y < 0:
                return True
            if x > y:  # the later merge is undone first; what merges before it would have taken the border
                limit, left = x, self.halves[left][1]
            else:
                limit, right = y + 1, self.halves[right][0]

    def byte_counts(self, data: bytes) -> list[int]:
        """Token count at each byte prefix of one pre-token; goes on from the prefix shared with the last one."""
        last, counts, rank, fit, ends, seen = self.last, self.counts, self.rank, self.fit, self.ends, self.seen
        p, most = 0, min(len(seen), len(data))
        while p < most and seen[p] == data[p]:
            p += 1
        del last[p + 1 :], counts[p + 1 :]
        self.seen = data
        for i in range(p + 1, len(data) + 1):
            for n in ends.get(data[i - 3 : i], TWO) if i > 2 else TWO:
                if n <= i and (t := data[i - n : i]) in rank:
                    if n == i:
                        break
                    key = last[i - n], t
                    good = fit.get(key)
                    if good is None:
                        if len(fit) >= CACHE:
                            fit.clear()
                        good = fit[key] = self.fits(*key)
                    if good:
                        break
            else:
                n = 1
                t = data[i - 1 : i]
            last.append(t)
            counts.append(counts[i - n] + 1)
        return counts[1:]

    def word_changes(self, word: str) -> bytes:
        if word in ("'re", "'ve", "'ll"):  # their first two characters are two pre-tokens while the third is missing
            counts = [1, 2, self.byte_counts(word.encode())[-1]]
        else:
            counts = self.byte_counts(word.encode())
            if len(counts) != len(word):
                ends = np.cumsum([len(c.encode()) for c in word]).tolist()
                counts = [counts[i - 1] for i in ends]
        return changes_of(counts)

    def field_changes(self, field: str) -> bytes:
        """Changes over white space and what follows it, up to the next white space."""
        if field[1:].isalpha() and (field[0] == " " or field[0].isalpha()):
            return self.word_changes(field)
        r = self.space.match(field).end()
        if not r:
            return b"".join(self.word[w] for w in self.pattern.findall(field))
        blank = self.word[field[:r]]
        if r == len(field):
            return blank
        # With a word behind it the last white space leaves the run and begins the word, if it is a plain space.
        before = total(self.word[field[: r - 1]]) if r > 1 else 0
        words = self.pattern.findall(field[r - 1 :] if field[r - 1] == " " else field[r:])
        rest = b"".join(self.word[w] for w in words)
        if field[r - 1] == " ":
            before += rest[0]
            rest = rest[1:]
        else:
            before += total(self.word[field[r - 1]])
        first = int(np.int8(np.uint8(rest[0]))) + before - total(blank)
        return blank + bytes([first & 255]) + rest[1:]

    def learn(self, texts: list[str | None]) -> None:
        """Counts the fields that the cache lacks in sorted order, so that neighbours share their prefixes."""
        found: set[str] = set()
        for text in texts:
            found.update(self.fields.findall(text or ""))
        for field in sorted(f for f in found if f not in self.cache):
            self.cache[field]

    def changes(self, text: str | None) -> bytes:
        """The stored form: the change of the token count at each character."""
        if not text:
            return b""
        if self.split_special is None or not any(s in text for s in self.special):
            return b"".join(map(self.cache.__getitem__, self.fields.findall(text)))
        out, tail = [], ""
        for i, part in enumerate(self.split_special.split(text)):
            if i % 2:  # until its last character a special string is ordinary text behind what precedes it
                before = self.piece(tail)
                counts = [total(self.piece(tail + part[:k])) - total(before) for k in range(1, len(part))]
                out.append(changes_of([*counts, 1]))
                tail = ""
            elif part:
                fields = self.fields.findall(part)
                out.append(b"".join(map(self.cache.__getitem__, fields)))
                tail = fields[-1]
        return b"".join(out)

    def piece(self, text: str) -> bytes:
        return b"".join(map(self.cache.__getitem__, self.fields.findall(text)))


class Generations(dict):
    """A cache of at most 2 * CACHE entries: when it is full, only what is used again is carried on."""

    def __init__(self, make):
        super().__init__()
        self.make, self.old = make, {}

    def __missing__(self, key):
        if len(self) >= CACHE:
            self.old = dict(self)
            self.clear()
        found = self.old.get(key)
        if found is None:
            found = self.make(key)
        self[key] = found
        return found


def changes_of(counts: list[int]) -> bytes:
    """A change lies in -127 .. 4: a character adds 4 bytes at most, and no token is longer than 128 bytes."""
    return bytes([(b - a) & 255 for a, b in zip([0, *counts], counts)])


def total(changes: bytes) -> int:
    return int(np.frombuffer(changes, np.int8).sum(dtype=np.int64)) if len(changes) > 40 else sum(c - 256 if c > 127 else c for c in changes)


@functools.lru_cache(2)
def counter_of(path: str) -> PrefixCounter:
    """One counter, and so one cache, for each worker process."""
    return PrefixCounter(path)


def prefix_counts(changes: bytes) -> np.ndarray:
    """Token count of text[:i] for i = 0 .. n."""
    return np.concatenate([[0], np.cumsum(np.frombuffer(changes, np.int8), dtype=np.int64)])


def longest_prefix(changes: bytes, budget: int) -> int:
    """Characters of the longest prefix with at most `budget` tokens."""
    return int(np.flatnonzero(prefix_counts(changes) <= budget)[-1])


def count_tokens(docs: DataFrame, vocabulary: str, text: str = "text", budget: int = 512, drop: bool = False) -> DataFrame:
    """`docs` plus `token_changes` (the store), `n_tokens` and `budget_chars`, the longest prefix within `budget`.

    `vocabulary` is a file that each Python worker can read, such as one in an installed package.
    """

    def make():
        counter = counter_of(vocabulary)

        def run(column: pa.Array) -> list[pa.Array]:
            stored, tokens, fit = [], [], []
            texts = column.to_pylist()
            counter.learn(texts)
            for s in texts:
                c = counter.changes(s)
                n = int(np.frombuffer(c, np.int8).sum(dtype=np.int64))
                stored.append(c)
                tokens.append(n)
                fit.append(len(c) if n <= budget else longest_prefix(c, budget))
            return [pa.array(stored, pa.binary()), pa.array(tokens, pa.int64()), pa.array(fit, pa.int64())]

        return run

    fields = [("token_changes", T.BinaryType()), ("n_tokens", T.LongType()), ("budget_chars", T.LongType())]
    return appended(docs, text, fields, make, drop)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("n_bytes"))
    out = count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"), drop=True)
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"), "budget_chars")
