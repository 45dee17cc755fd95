"""Language identification with interpolated Kneser-Ney character models.

Text is folded to lower-case letters and single spaces (letters beyond the basic plane share one symbol); a
gram of four symbols is one 64-bit number, and its mixed form, which is one-to-one, is its hash. Counts of
four-grams over all training documents are summed by Spark; from them follow the continuation counts of the
lower orders. The model holds, for each order, one sorted hash array over all languages with the full
interpolated log-probability in each language, and one for the back-off weights of the contexts. A text takes
the language of lowest cross-entropy per character.

Size: all grams are kept. The tables of grams and back-off weights are made by Spark; where they are small (grams times
languages, `CELLS`) they become arrays that every task holds, else texts are scored by joining their grams with the
tables, order by order. The way changes the work, not the result.

Calibration: one text in `LEFT_OUT`, but `LEAST_LEFT` texts where there are so few, and never over half, is left out of
the counts; up to `calibration_docs` rows of these calibrate.

Rejection: the cross-entropy of a text must not lie above what labelled texts of the language show that were left
out of the counts: more than `MARGIN` nats over their mean and `SPREAD` times the standardised excess that 99 in a
hundred of them keep within.

Defined cases: null texts and texts without letters are `und` with score 0 and rejected; without any training
document all are `und`; null languages train nothing; documents of any length are scored whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.base import appended, free, in_tasks, sliced, small_batches, table, without, written

ORDER = 4
PAD, SPACE, BEYOND = 1, 32, 2
CELLS, CALIBRATION_DOCS = 20_000_000, 20_000
HELD = 1_500_000  # grams that a task sums up before it hands them on
LEFT_OUT, LEAST_LEFT = 20, 200
MARGIN, SPREAD, USUAL, FEW = 0.8, 2.0, 0.99, 20
SYMBOLS = 65_536
_fold: list[np.ndarray] = []


def fold_table() -> np.ndarray:
    """Symbol of each code point: lower-case letter, else SPACE; PAD stands for itself."""
    if not _fold:
        out = np.full(0x110000, SPACE, np.uint16)
        for i in range(0x110000):
            c = chr(i)
            if c.isalpha():
                low = ord(c.lower()[0])
                out[i] = low if low < SYMBOLS else BEYOND
        out[PAD] = PAD
        _fold.append(out)
    return _fold[0]


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Four-grams (as numbers) that end at each symbol of the texts, and the bounds of each text in them."""
    pad = chr(PAD) * (ORDER - 1)
    joined = pad + pad.join(t.replace(chr(PAD), " ") for t in texts) + pad
    codes = fold_table()[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)]
    keep = np.ones(len(codes), bool)
    keep[1:] = (codes[1:] != SPACE) | (codes[:-1] != SPACE)
    codes = codes[keep].astype(np.uint64)
    key = codes[3:] | codes[2:-1] << np.uint64(16) | codes[1:-2] << np.uint64(32) | codes[:-3] << np.uint64(48)
    real = codes[3:] != PAD
    ends = np.cumsum([0, *map(len, texts)])[:-1] + (ORDER - 1) * np.arange(1, len(texts) + 1)  # each text's first code
    before = np.concatenate([[0], np.cumsum(keep)])[ends] - (ORDER - 1)
    count = np.concatenate([[0], np.cumsum(real)])
    return key[real], np.append(count[before], count[-1])


def hashed(key: np.ndarray) -> np.ndarray:
    """A one-to-one mixing of 64-bit numbers."""
    key = (key ^ (key >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    key = (key ^ (key >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return key ^ (key >> np.uint64(31))


def count_grams(docs: DataFrame, text: str, lang: str) -> DataFrame:
    """(lang, key, n): four-gram counts over all documents with a text and a language."""

    def run(batches):
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

        def merge(parts):
            keys, n = np.concatenate([k for k, _ in parts]), np.concatenate([n for _, n in parts])
            order = np.argsort(keys)
            keys = keys[order]
            first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            return [(keys[first], np.add.reduceat(n[order], first))]

        def summed():
            for name, parts in held.items():
                for keys, n in merge(parts):
                    yield pa.RecordBatch.from_arrays([pa.array([name]).take(pa.array(np.zeros(len(keys), np.int32))), pa.array(keys.view(np.int64)), pa.array(n)], names=["lang", "key", "n"])
            held.clear()

        for batch in batches:
            for part in sliced(batch, 0):
                of: dict[str, list[str]] = {}
                for t, name in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    of.setdefault(name, []).append(t)
                for name, texts in of.items():
                    key = np.sort(grams(texts)[0])
                    if len(key):
                        at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
                        parts = held.setdefault(name, [])
                        parts.append((key[at], np.diff(np.append(at, len(key)))))
                        if len(parts) > 32:
                            held[name] = merge(parts)
                if sum(len(k) for parts in held.values() for k, _ in parts) > HELD:
                    held.update({name: merge(parts) for name, parts in held.items()})
                    if sum(len(k) for parts in held.values() for k, _ in parts) > HELD // 2:
                        yield from summed()
        yield from summed()

    rows = small_batches(docs).where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(text).alias("text"), F.col(lang).alias("lang"))
    return rows.mapInArrow(in_tasks(run), "lang string, key long, n long").groupBy("lang", "key").agg(F.sum("n").alias("n"))


def discount_of(once: int, twice: int) -> float:
    return min(0.95, max(0.05, once / (once + 2 * twice))) if once else 0.05


def shares(keys: np.ndarray, n: np.ndarray, discount: float):
    """Grams, discounted share of each, contexts and their back-off weight (and the last weight)."""
    contexts, at = np.unique(keys >> np.uint64(16), return_inverse=True)
    total = np.bincount(at, n)
    weight = discount * np.bincount(at) / total
    return keys, (n - discount) / total[at], contexts, weight, float(weight[0])


class Orders:
    """The tables of all orders: grams (lang, key, share) and weights (lang, context, weight), of all counts."""

    def __init__(self, counts: DataFrame):
        spark = counts.sparkSession
        self.grams: list[DataFrame | None] = [None] * (ORDER + 1)
        self.weights: list[DataFrame | None] = [None] * (ORDER + 1)
        self.langs: list[str] = []
        for order in range(ORDER, 0, -1):
            rare = counts.groupBy("lang").agg(F.count_if(F.col("n") == 1).alias("once"), F.count_if(F.col("n") == 2).alias("twice")).collect()  # a row a language
            self.langs = sorted(r["lang"] for r in rare)
            discounts = spark.createDataFrame([(r["lang"], discount_of(r["once"], r["twice"])) for r in rare], "lang string, discount double")
            keyed = counts.join(F.broadcast(discounts), "lang").withColumn("context", F.shiftrightunsigned("key", 16))
            totals = written(keyed.groupBy("lang", "context").agg(F.sum("n").alias("total"), F.count("*").alias("kinds"), F.first("discount").alias("discount")), f"totals{order}")
            self.weights[order] = totals.select("lang", "context", (F.col("discount") * F.col("kinds") / F.col("total")).alias("weight"))
            self.grams[order] = written(keyed.join(totals.select("lang", "context", "total"), ["lang", "context"]).select("lang", "key", ((F.col("n") - F.col("discount")) / F.col("total")).alias("share")), f"shares{order}")
            if order > 1:  # of the next order: how many symbols precede each gram
                counts = written(counts.groupBy("lang", suffix("key", order - 1).alias("key")).agg(F.count("*").alias("n")), f"grams{order - 1}")

    def cells(self) -> int:
        """Entries of the arrays that hold a value of each language for each row."""
        return len(self.langs) * sum(t.count() for t in (*self.grams[1:], *self.weights[1:]))

    def arrays(self) -> dict[str, list]:
        """For each language the `shares` of all orders."""
        out: dict[str, list] = {name: [None] * (ORDER + 1) for name in self.langs}
        number = F.array_position(F.array(*map(F.lit, self.langs)), F.col("lang")).cast("int").alias("lang")
        for order in range(1, ORDER + 1):
            grams, weights = (t.select(number, *t.columns[1:]).toArrow() for t in (self.grams[order], self.weights[order]))
            for j, name in enumerate(self.langs, 1):
                columns = []
                for t in (grams, weights):
                    at = np.flatnonzero(t.column(0).to_numpy() == j)
                    keys = t.column(1).to_numpy()[at].view(np.uint64)
                    order_ = np.argsort(keys)
                    columns += [keys[order_], t.column(2).to_numpy()[at][order_]]
                out[name][order] = (*columns, float(columns[3][0]))
        return out


def suffix(key: str, order: int):
    """The last symbols of a gram."""
    return F.col(key).bitwiseAND(F.lit((1 << 16 * order) - 1)) if order < ORDER else F.col(key)


class JoinedModel:
    """The model as tables, for any number of grams and languages: texts are scored by joins."""

    def __init__(self, orders: Orders):
        self.langs = orders.langs
        floor = {r["lang"]: r["weight"] for r in orders.weights[1].collect()}  # a row a language
        self.unseen = [float(np.log(floor[x] / SYMBOLS)) for x in self.langs]
        self.weights = [None] + [t.select("lang", "context", F.log("weight").alias("weight")) for t in orders.weights[1:]]
        self.rows: list[DataFrame | None] = [None] * (ORDER + 1)
        for order in range(1, ORDER + 1):
            t = orders.grams[order].join(orders.weights[order].withColumnRenamed("context", "c"), (F.col("c") == F.shiftrightunsigned("key", 16)) & (orders.grams[order]["lang"] == orders.weights[order]["lang"])).drop(orders.weights[order]["lang"], "c")
            if order == 1:
                p = F.col("share") + F.col("weight") / SYMBOLS
            else:
                low = self.rows[order - 1].select(F.col("lang").alias("l"), F.col("key").alias("k"), "log_p")
                t = t.join(low, (F.col("l") == F.col("lang")) & (F.col("k") == suffix("key", order - 1)))
                p = F.col("share") + F.col("weight") * F.exp("log_p")
            self.rows[order] = written(t.select("lang", "key", F.log(p).alias("log_p")), f"log_p{order}")
        self.temperature, self.mean, self.deviation, self.excess = 1.0, None, None, None

    def entropies_of(self, docs: DataFrame) -> DataFrame:
        """(row, n, entropy: one for each language) of rows (row, text) that have symbols."""

        def run(batches):
            for part in (p for batch in batches for p in sliced(batch, 1)):
                keys, bounds = grams([t or "" for t in part.column(1).to_pylist()])
                owner = np.repeat(np.arange(part.num_rows), np.diff(bounds))
                order = np.lexsort((keys, owner))
                keys, owner = keys[order], owner[order]
                first = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])])) if len(keys) else np.empty(0, np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(owner[first])), pa.array(keys[first].view(np.int64)), pa.array(np.diff(np.append(first, len(keys))))], names=["row", "key", "times"])

        said = written(small_batches(docs).select("row", "text").mapInArrow(in_tasks(run), "row long, key long, times long"), "said")
        spark = docs.sparkSession
        langs = F.broadcast(spark.createDataFrame(list(zip(self.langs, range(len(self.langs)), self.unseen)), "lang string, at int, p double"))
        p = said.select("key").distinct().join(langs)  # every gram that is said, in every language
        for order in range(1, ORDER + 1):
            rows = self.rows[order].select(F.col("lang").alias("l1"), F.col("key").alias("k1"), "log_p")
            p = p.join(rows, (F.col("l1") == F.col("lang")) & (F.col("k1") == suffix("key", order)), "left")
            if order > 1:
                context = F.shiftrightunsigned(suffix("key", order), 16)
                weights = self.weights[order].select(F.col("lang").alias("l2"), F.col("context").alias("k2"), F.col("weight").alias("back"))
                p = p.join(weights, (F.col("l2") == F.col("lang")) & (F.col("k2") == context), "left").withColumn("p", F.coalesce("log_p", F.col("p") + F.coalesce("back", F.lit(0.0)))).drop("l2", "k2", "back")
            else:
                p = p.withColumn("p", F.coalesce("log_p", "p"))
            p = p.drop("l1", "k1", "log_p")
        p = written(p.select("key", "at", "p"), "scored_grams")
        sums = said.join(p, "key").groupBy("row", "at").agg(F.sum("times").alias("n"), (-F.sum(F.col("times") * F.col("p")) / F.sum("times")).alias("entropy"))
        return sums.groupBy("row").agg(F.first("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("at", "entropy"))), lambda x: x["entropy"]).alias("entropy"))


class LanguageModel:
    """Sorted hash arrays of all orders; built from each language's four-gram counts, or its `shares` of all orders."""

    def __init__(self, counts: dict[str, tuple[np.ndarray, np.ndarray] | list]):
        self.langs = sorted(counts)
        per_lang = [c if isinstance(c, list) else self._orders(*c) for c in map(counts.get, self.langs)]
        self.rows: list[tuple[np.ndarray, np.ndarray] | None] = [None] * (ORDER + 1)
        self.weights: list[tuple[np.ndarray, np.ndarray] | None] = [None] * (ORDER + 1)
        floor = np.array([orders[1][4] for orders in per_lang])  # weight of the uniform distribution
        self.unseen = np.log(floor / SYMBOLS)
        for n in range(1, ORDER + 1):
            keys = np.unique(np.concatenate([orders[n][0] for orders in per_lang]))
            contexts = np.unique(np.concatenate([orders[n][2] for orders in per_lang]))
            weight = np.zeros((len(contexts), len(self.langs)))
            for j, orders in enumerate(per_lang):
                weight[np.searchsorted(contexts, orders[n][2]), j] = np.log(orders[n][3])
            if n > 1:
                self.weights[n] = self._by_hash(contexts, weight)
                lower = self._log_prob(keys & np.uint64((1 << 16 * (n - 1)) - 1), n - 1) + self._weight(keys, n)
            else:
                lower = np.broadcast_to(self.unseen, (len(keys), len(self.langs)))
            full = np.exp(lower)
            for j, orders in enumerate(per_lang):
                full[np.searchsorted(keys, orders[n][0]), j] += orders[n][1]
            self.rows[n] = self._by_hash(keys, np.log(full))
        self.temperature, self.mean, self.deviation, self.excess = 1.0, None, None, None

    @staticmethod
    def _orders(keys: np.ndarray, n: np.ndarray):
        """For each order: grams, discounted share of each, contexts and their back-off weight (and the last weight)."""
        out: list = [None] * (ORDER + 1)
        for order in range(ORDER, 0, -1):
            out[order] = shares(keys, n, discount_of(int((n == 1).sum()), int((n == 2).sum())))
            if order > 1:  # of the next order: how many symbols precede each gram
                keys, n = np.unique(keys & np.uint64((1 << 16 * (order - 1)) - 1), return_counts=True)
        return out

    @staticmethod
    def _by_hash(keys, values):
        h = hashed(keys)
        order = np.argsort(h)
        return h[order], np.ascontiguousarray(values[order].astype(np.float32))

    @staticmethod
    def _find(array, keys):
        h = hashed(keys)
        at = np.minimum(np.searchsorted(array[0], h), len(array[0]) - 1)
        return at, array[0][at] == h

    def _weight(self, keys, n):
        at, found = self._find(self.weights[n], keys >> np.uint64(16))
        out = self.weights[n][1][at]
        out[~found] = 0
        return out

    def _log_prob(self, keys, n):
        at, found = self._find(self.rows[n], keys)
        out = self.rows[n][1][at]
        miss = np.flatnonzero(~found)
        if len(miss):
            rest = keys[miss]
            out[miss] = self._log_prob(rest & np.uint64((1 << 16 * (n - 1)) - 1), n - 1) + self._weight(rest, n) if n > 1 else self.unseen
        return out

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy in nats a symbol of each text in each language, and the number of its symbols."""
        keys, bounds = grams(texts)
        n = np.diff(bounds)
        out = np.zeros((len(texts), len(self.langs)))
        full = n > 0
        if len(keys):
            out[full] = -np.add.reduceat(self._log_prob(keys, ORDER), bounds[:-1][full], axis=0, dtype=np.float64) / n[full, None]
        return out, n

    def calibrate(self, entropy: np.ndarray, n: np.ndarray, truth: np.ndarray) -> None:
        """Sets the temperature of the scores and, for each language, what cross-entropy is usual."""
        def loss(beta):
            z = -beta * entropy * n[:, None]
            z -= z.max(axis=1, keepdims=True)
            return -(z[np.arange(len(z)), truth] - np.log(np.exp(z).sum(axis=1))).mean()

        self.temperature = min((2.0**-k for k in range(11)), key=loss)
        own = entropy[np.arange(len(truth)), truth]
        size = len(self.langs)
        self.mean, self.deviation, self.excess = np.zeros(size), np.ones(size), np.full(size, np.inf)
        for j in range(size):
            if (at := truth == j).any():
                self.mean[j] = np.average(own[at], weights=n[at])
                z = (own[at] - self.mean[j]) * np.sqrt(n[at])
                # Quantiles, so that a few long texts under a wrong label do not set the bar for all others.
                self.deviation[j] = max(1e-9, np.quantile(np.abs(z), 0.68))
                # Few texts do not show how far unusual ones go: the bar is the higher, the fewer they are.
                self.excess[j] = max(3.0, np.quantile(z / self.deviation[j], USUAL)) * (1 + FEW / at.sum())

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, float, bool]]:
        """(language, score, cross-entropy, rejected) of each text."""
        texts = [t or "" for t in texts]
        return self.decide(*self.entropies(texts), np.array([any(map(str.isalpha, t)) for t in texts], bool))

    def decide(self, entropy: np.ndarray, n: np.ndarray, letters: np.ndarray) -> list[tuple[str, float, float, bool]]:
        best = entropy.argmin(axis=1)
        z = -self.temperature * n[:, None] * (entropy - entropy.min(axis=1, keepdims=True))
        score = 1 / np.exp(z).sum(axis=1)
        least = entropy.min(axis=1)
        far = np.zeros(len(n), bool)
        if self.mean is not None:
            over = least - self.mean[best]
            far = (over > MARGIN) & (over * np.sqrt(n) > SPREAD * self.excess[best] * self.deviation[best])
        return [(self.langs[b], float(s), float(e), bool(f)) if ok else ("und", 0.0, 0.0, True) for ok, b, s, e, f in zip(letters.tolist(), best.tolist(), score, least, far)]


JoinedModel.calibrate, JoinedModel.decide = LanguageModel.calibrate, LanguageModel.decide


def train(docs: DataFrame, text: str = "text", lang: str = "lang", cells: int = CELLS, calibration_docs: int = CALIBRATION_DOCS) -> LanguageModel | JoinedModel | None:
    """The model of all rows of `docs` with a text and a language; None where there is none.

    `cells`: up to so many grams times languages are held by every task; beyond, texts are scored by joins.
    """
    labelled = docs.where(F.col(text).isNotNull() & F.col(lang).isNotNull())
    n_labelled = max(1, labelled.count())
    share = min(0.5, max(1 / LEFT_OUT, LEAST_LEFT / n_labelled), max(calibration_docs, LEAST_LEFT) / n_labelled)
    left_out = F.pmod(F.xxhash64(text), F.lit(1_000_000)) < int(1e6 * share) + 1
    counts = written(count_grams(labelled.where(~left_out), text, lang), "grams")
    if counts.isEmpty():  # no symbol but in what was left out
        counts = written(count_grams(labelled, text, lang), "grams")
        if counts.isEmpty():
            return None
    orders = Orders(counts)
    small = orders.cells() <= cells
    model = LanguageModel(orders.arrays()) if small else JoinedModel(orders)
    some = labelled.where(left_out).where(F.col(lang).isin(*model.langs))
    some = small_batches(some).select(F.col(text).alias("text"), F.col(lang).alias("lang")).distinct()  # a hot text counts once
    if small:
        shared = docs.sparkSession.sparkContext.broadcast(model)

        def measure(batches):
            own = shared.value
            for batch in batches:
                for part in sliced(batch, 0):
                    entropy, n = own.entropies(part.column(0).to_pylist())
                    yield pa.RecordBatch.from_arrays([part.column(1), pa.array(n.astype(np.int64)), pa.array(entropy.tolist(), pa.list_(pa.float64()))], names=["lang", "n", "entropy"])

        seen = some.mapInArrow(in_tasks(measure), "lang string, n long, entropy array<double>").where("n > 0").limit(2 * calibration_docs).toPandas()
        shared.destroy()
    else:
        some = written(some.limit(2 * calibration_docs).withColumn("row", F.monotonically_increasing_id()), "calibration")
        seen = some.join(model.entropies_of(some), "row").select("lang", "n", "entropy").toPandas()
    if len(seen):
        model.calibrate(np.stack(seen.entropy.to_numpy()), seen.n.to_numpy(), np.array([model.langs.index(x) for x in seen.lang]))
    return model


FIELDS = [("lang_pred", T.StringType()), ("score", T.DoubleType()), ("cross_entropy", T.DoubleType()), ("rejected", T.BooleanType())]


def identify(docs: DataFrame, model: LanguageModel | JoinedModel | None, text: str = "text", drop: bool = False, prefix: str = "") -> DataFrame:
    """`docs` plus lang_pred, score, cross_entropy and rejected (names after `prefix`)."""
    fields = [(prefix + n, t) for n, t in FIELDS]
    if isinstance(model, JoinedModel):
        return _identified_by_joins(docs, model, text, drop, fields)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        own = shared.value

        def run(column: pa.Array) -> list[pa.Array]:
            found = own.predict(column.to_pylist()) if own else [("und", 0.0, 0.0, True)] * len(column)
            return [pa.array([r[i] for r in found], kind) for i, kind in enumerate((pa.string(), pa.float64(), pa.float64(), pa.bool_()))]

        return run

    return appended(docs, text, fields, make, drop)


def _identified_by_joins(docs: DataFrame, model: JoinedModel, text: str, drop: bool, fields) -> DataFrame:
    row, said = free(docs.columns, "__row"), free(docs.columns, "__said")
    rows = written(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    found = model.entropies_of(rows.select(F.col(row).alias("row"), F.col(text).alias("text"))).withColumnsRenamed({"row": f"{row}_", "n": f"{row}_n", "entropy": f"{row}_e"})
    kept = [c for c in without(docs.columns, *(n for n, _ in fields)) if not (drop and c == text)]
    letters = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)).alias(said)
    joined = rows.select(*[F.col(f"`{c}`") for c in kept], letters, row).join(found, F.col(row) == F.col(f"{row}_"), "left").select(*[F.col(f"`{c}`") for c in kept], said, f"{row}_n", f"{row}_e")
    schema = T.StructType([*joined.schema.fields[:-3], *[T.StructField(n, t) for n, t in fields]])
    deciding = _Decisions(model)

    def run(batches):
        for batch in batches:
            k = batch.num_columns - 3
            n = pc.fill_null(batch.column(k + 1), 0).to_numpy(zero_copy_only=False)
            entropy = np.array([e if e else [0.0] * len(deciding.langs) for e in batch.column(k + 2).to_pylist()]).reshape(len(n), -1)
            made = deciding.decide(entropy, n, batch.column(k).to_numpy(zero_copy_only=False).astype(bool) & (n > 0))
            yield pa.RecordBatch.from_arrays([*batch.columns[:k], *(pa.array([r[i] for r in made], t) for i, t in enumerate((pa.string(), pa.float64(), pa.float64(), pa.bool_())))], names=schema.names)

    return joined.mapInArrow(in_tasks(run), schema)


class _Decisions:
    """What of a model decides, without its tables."""

    def __init__(self, model: JoinedModel):
        self.langs, self.temperature, self.mean, self.deviation, self.excess = model.langs, model.temperature, model.mean, model.deviation, model.excess

    decide = LanguageModel.decide


def fold_of(id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id).cast("string").cast("binary")) % 4, F.lit(0))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = fold_of() == 2
    out = identify(docs.select("doc_id", "text", held.alias("held_out")), train(docs.where(~held)), drop=True)
    return out.select("doc_id", "held_out", "lang_pred", "score", "cross_entropy", "rejected")
