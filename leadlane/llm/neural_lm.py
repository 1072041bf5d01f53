"""Log-bilinear language model: word counts over all training text, a neural model of word units, whole texts scored.

The vocabulary is all training tokens with their counts, which come from every block of texts and go back to it, so no
task holds the vocabulary. Tokens are predicted in two factors: the unit given the last units, and the word within the
unit by its count. Frequent words are units of their own, all others share units by their ending, and unknown tokens
have one. The unit model sums learned vectors of the last units, each place weighted by a learned vector, and compares
the sum with a vector per unit; it is trained in numpy by noise-contrastive estimation. Tasks train on their own
shard from common parameters, which are then averaged. Scoring normalises over all units in batched matrix products,
so probabilities over the vocabulary and the unknown token sum to one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadlane.llm.common import give_back, in_clean_worker, slices
from leadlane.sources.staging import Workspace

#: Text that shares one dictionary of words.
BLOCK_BYTES = 12 << 20
#: Units: the end of a text, unknown tokens, frequent words, endings.
END, UNKNOWN, WORDS = 0, 1, 2
FREQUENT = 174
ENDINGS = 80
UNITS = WORDS + FREQUENT + ENDINGS
#: Stands in front of a text; a context, never predicted.
START = UNITS
CONTEXT = 4
DIMENSIONS = 16
#: Each round trains on one position in so many of all training texts, so that together they train on every position once.
ROUNDS = 2
BATCH = 2048
NOISE = 32
#: Positions normalised over all units at a time; their logits stay in a core's cache.
SCORED = 512
#: Exponentials of numbers up to this far from zero, and their sums, are in the range of 32-bit numbers as they are.
SAFE_LOGIT = 60.0
RATE = 0.2
#: Set on words seen once of which half stand for unknown tokens while training.
AS_UNKNOWN = 0x8000

#: Place of every number in a table of units, as a flat array.
CELLS = np.arange((UNITS + 1) * DIMENSIONS).reshape(UNITS + 1, DIMENSIONS)


def held_out(doc_id: Column) -> Column:
    """Documents that nothing is learned from; null ids are learned from."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(7)) == 2, F.lit(False))


@in_clean_worker
def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts as numbers into the word list of their block, and one more row per word of that list."""
    task, number, held, size = TaskContext.get().partitionId(), 0, [], 0

    def finish(parts: list[pa.RecordBatch], block: int) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(parts).combine_chunks()
        parts.clear()
        lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(table.column("text").combine_chunks(), "")))
        table = table.drop_columns("text")
        offsets = lists.offsets.to_numpy().astype(np.int64)
        flat = lists.flatten()
        full = pc.greater(pc.binary_length(flat), 0)
        upto = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))])
        offsets = upto[offsets - offsets[0]]
        coded = flat.filter(full).dictionary_encode()
        del lists, flat, full, upto
        ids = coded.indices.to_numpy().astype("<u4")
        training = ~table.column("held_out").to_numpy()
        mine = np.repeat(training, np.diff(offsets))
        counts = np.bincount(ids[mine], minlength=len(coded.dictionary))
        n = table.num_rows
        rows = {
            "block": pa.array(np.full(n, block)),
            "doc_id": table.column("doc_id").combine_chunks(),
            "held_out": table.column("held_out").combine_chunks(),
            "ids": pa.array([ids[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:])], pa.binary()),
            "word": pa.nulls(n, pa.string()),
            "place": pa.nulls(n, pa.int32()),
            "n_train": pa.nulls(n, pa.int64()),
        }
        yield pa.RecordBatch.from_arrays(list(rows.values()), list(rows))
        n = len(counts)
        rows = {
            "block": pa.array(np.full(n, block)),
            "doc_id": pa.nulls(n, rows["doc_id"].type),
            "held_out": pa.nulls(n, pa.bool_()),
            "ids": pa.nulls(n, pa.binary()),
            "word": coded.dictionary,
            "place": pa.array(np.arange(n, dtype=np.int32)),
            "n_train": pa.array(counts),
        }
        yield pa.RecordBatch.from_arrays(list(rows.values()), list(rows))

    for part in slices(batches, "text"):
        held.append(part)
        size += part.column("text").nbytes
        if size >= BLOCK_BYTES:
            yield from finish(held, (task << 24) + number)
            held, size, number = [], 0, number + 1
    if held:
        yield from finish(held, (task << 24) + number)


@dataclass
class Units:
    """What the unit model is built on: totals of the training text, all bounded by the number of units."""

    train_tokens: int
    vocabulary: int
    train_docs: int
    tokens: np.ndarray  # training tokens of each unit
    mass: np.ndarray  # sum of count + 1 over the words of each unit
    as_unknown: int  # training tokens that stand for unknown ones

    @property
    def valid(self) -> np.ndarray:
        """Units that hold a known word, and the unknown one."""
        ok = self.mass > 0
        ok[UNKNOWN] = True
        return ok

    @property
    def prior(self) -> np.ndarray:
        p = np.where(self.valid, self.tokens + 0.5, 0)
        p[UNKNOWN] = self.as_unknown + 0.5
        return p / p.sum()


class Parameters:
    """All learned numbers in one array."""

    SIZES = ((UNITS + 1, DIMENSIONS), (UNITS, DIMENSIONS), (CONTEXT, DIMENSIONS), (UNITS,))

    def __init__(self, flat: np.ndarray):
        self.flat = flat
        edges = np.cumsum([0, *(int(np.prod(s)) for s in self.SIZES)])
        parts = [flat[a:b].reshape(s) for a, b, s in zip(edges, edges[1:], self.SIZES)]
        self.seen, self.next, self.places, self.bias = parts

    @classmethod
    def size(cls) -> int:
        return sum(int(np.prod(s)) for s in cls.SIZES)

    @classmethod
    def first(cls, units: Units) -> Parameters:
        rng = np.random.default_rng(1)
        out = cls(np.zeros(cls.size(), np.float32))
        out.seen[:] = rng.normal(0, 0.3, out.seen.shape)
        out.next[:] = rng.normal(0, 0.1, out.next.shape)
        out.places[:] = 1 / np.arange(1, CONTEXT + 1)[:, None] ** 0.5
        out.bias[:] = np.log(np.maximum(units.prior, 1e-30))
        return out

    def predicted(self, contexts: np.ndarray) -> np.ndarray:
        return self.summed([self.seen * place for place in self.places], contexts)

    @staticmethod
    def summed(placed: list[np.ndarray], contexts: np.ndarray) -> np.ndarray:
        """Sums over the places of a context, of each place's own table of units."""
        total = placed[0].take(contexts[:, 0], axis=0)
        for k in range(1, CONTEXT):
            total += placed[k].take(contexts[:, k], axis=0)
        return total

    def largest_logit(self, predicted: np.ndarray) -> float:
        """No logit of these predictions, of any unit, is farther from zero."""
        lengths = [np.sqrt(np.einsum("ij,ij->i", m, m).max()) for m in (predicted, self.next)]
        return float(lengths[0] * lengths[1] + np.abs(self.bias).max())


def contexts_of(units: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The last units before every position, nearest first, within the position's own text."""
    before = np.concatenate([np.full(CONTEXT, START, np.int64), units])
    out = np.empty((CONTEXT, len(units)), np.int64)
    for k in range(CONTEXT):
        out[k] = before[CONTEXT - 1 - k : len(before) - 1 - k]
    # The first positions of a text do not reach into the one before it.
    ends = np.append(starts[1:], len(units))
    for k in range(CONTEXT):
        out[k:, (starts + k)[starts + k < ends]] = START
    return out.T


def _sum_by_id(ids: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    """The rows of ``values``, of 64 bits each number, added up per id."""
    return np.bincount(CELLS.take(ids, axis=0).ravel(), values.ravel(), size * DIMENSIONS).reshape(size, DIMENSIONS)


def _sigmoid(negated: np.ndarray) -> np.ndarray:
    """1 / (1 + exp(x)), in the memory of x."""
    np.clip(negated, -30, 30, out=negated)
    np.exp(negated, out=negated)
    negated += 1
    return np.divide(1, negated, out=negated)


class Trainer:
    """Noise-contrastive steps with per-number step sizes."""

    def __init__(self, parameters: Parameters, prior: np.ndarray, seed: int):
        self.p = Parameters(parameters.flat.copy())
        self.squares = np.full(len(parameters.flat), 1e-3, np.float32)
        self.upto = prior.cumsum()
        self.upto /= self.upto[-1]
        self.log_noise = np.log(np.maximum(NOISE * prior, 1e-30)).astype(np.float32)
        self.rng = np.random.default_rng(seed)

    def step(self, contexts: np.ndarray, targets: np.ndarray) -> None:
        p, n = self.p, len(targets)
        q = p.predicted(contexts)
        noise = self.upto.searchsorted(self.rng.random(NOISE), side="right")
        chosen, drawn = p.next.take(targets, axis=0), p.next.take(noise, axis=0)
        offset = p.bias - self.log_noise
        of_target = (q * chosen).sum(axis=1) + p.bias.take(targets) - self.log_noise.take(targets)
        of_noise = q @ drawn.T
        of_noise += offset.take(noise)
        up = _sigmoid(of_target)
        down = _sigmoid(np.negative(of_noise, out=of_noise))
        np.negative(down, out=down)
        chosen *= up[:, None]
        chosen += down @ drawn
        to_q = chosen.astype(np.float64)
        gradient = Parameters(np.zeros_like(p.flat))
        gradient.next[:] = _sum_by_id(targets, (up[:, None] * q).astype(np.float64), UNITS)
        gradient.bias[:] = np.bincount(targets, up, UNITS)
        np.add.at(gradient.next, noise, down.T @ q)
        np.add.at(gradient.bias, noise, down.sum(axis=0))
        for k in range(CONTEXT):
            by_unit = _sum_by_id(contexts[:, k], to_q, UNITS + 1).astype(np.float32)
            gradient.places[k] = (by_unit * p.seen).sum(axis=0)
            by_unit *= p.places[k]
            gradient.seen += by_unit
        g = gradient.flat
        g /= n
        self.squares += g * g
        p.flat += RATE * g / np.sqrt(self.squares)


def log10_units(parameters: Parameters, valid: np.ndarray, units: np.ndarray, starts: np.ndarray, seen: list) -> np.ndarray:
    """log10 of each unit's probability, where contexts may differ from the units predicted."""
    given = units.copy()
    for start, data in zip(starts.tolist(), seen):
        if data is not None:
            other = np.frombuffer(data, "<u2")
            given[start : start + len(other)] = other
    out = np.empty(len(units))
    contexts = contexts_of(given, starts)
    targets = units.astype(np.int64)
    placed = [parameters.seen * place for place in parameters.places]
    # The last row of the weights, which meets a one in every prediction, adds the bias.
    weights = np.vstack([parameters.next.T, np.where(valid, parameters.bias, -np.inf)]).astype(np.float32)
    ones = np.ones(UNITS, np.float32)
    space = np.empty((SCORED, UNITS), np.float32)
    for a in range(0, len(units), BATCH):
        predicted = Parameters.summed(placed, contexts[a : a + BATCH])
        safe = parameters.largest_logit(predicted) <= SAFE_LOGIT
        predicted = np.pad(predicted, ((0, 0), (0, 1)), constant_values=1)
        for b in range(0, len(predicted), SCORED):
            piece = predicted[b : b + SCORED]
            n, at = len(piece), a + b
            logits = np.matmul(piece, weights, out=space[:n])
            picked = logits[np.arange(n), targets[at : at + n]].astype(np.float64)
            top = np.float32(0)
            if not safe:
                top = logits.max(axis=1)
                logits -= top[:, None]
            np.exp(logits, out=logits)
            out[at : at + n] = picked - top - np.log((logits @ ones).astype(np.float64))
    return out / np.log(10)


def _sequences(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    column = part.column("units")
    sizes = pc.binary_length(column).to_numpy().astype(np.int64) // 2
    return np.frombuffer(b"".join(column.to_pylist()), "<u2"), np.cumsum(sizes) - sizes


class LanguageModel:
    """Fits on ``docs`` (training part) and scores all of them; the tables stay in the workspace."""

    def __init__(self, docs: DataFrame, unseen: Column, id_col: str = "doc_id", text_col: str = "text", workspace: Workspace | None = None):
        self.workspace = workspace or Workspace(docs.sparkSession)
        rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), unseen.alias("held_out"))
        self.kind = rows.schema["doc_id"].dataType.simpleString()
        schema = f"block long, doc_id {self.kind}, held_out boolean, ids binary, word string, place int, n_train long"
        self.indexed = self.workspace.stage(rows.mapInArrow(_index, schema), "indexed")
        self.words = self._count_words()
        self.units, self.frequent = self._choose_units()
        self.sequences = self.workspace.stage(self._encode(), "sequences")
        self.parameters = Parameters.first(self.units)
        for k in range(ROUNDS if self.units.train_tokens else 0):
            self.parameters = self._train(k)

    def _count_words(self) -> DataFrame:
        """``block, place, word, c``: training count of each word of each block; ``first`` once per word.

        A word has one row per block, so no word's rows outnumber the blocks. The counts are summed on the map side; the
        rows of a frequent word, which are many, meet its count in a join that may be split.
        """
        rows = self.indexed.filter("word IS NOT NULL").select("block", "place", "word", "n_train")
        whole = rows.groupBy("word").agg(F.sum("n_train").alias("c"), F.min("block").alias("first_block"))
        counted = rows.select("block", "place", "word").join(whole, "word").withColumn("first", F.col("block") == F.col("first_block"))
        ending = F.pmod(F.crc32(F.substring("word", -2, 2).cast("binary")), F.lit(ENDINGS)).cast("int")
        half = (F.col("c") == 1) & (F.pmod(F.crc32(F.col("word").cast("binary")), F.lit(2)) == 0)
        return self.workspace.stage(
            counted.select("block", "place", "word", "c", "first", ending.alias("ending"), half.alias("half")),
            "word-counts",
        )

    def _choose_units(self) -> tuple[Units, list[str]]:
        known = self.words.filter("first AND c > 0")
        frequent = [r["word"] for r in known.orderBy(F.desc("c"), "word").limit(FREQUENT).collect()]
        docs = self.indexed.filter("held_out = false").count()
        sums = (
            self._with_unit(known, frequent)
            .groupBy("unit")
            .agg(F.sum("c").alias("tokens"), F.sum(F.col("c") + 1).alias("mass"), F.count("*").alias("n"), F.count_if("half").alias("half"))
            .collect()  # one row per unit
        )
        tokens, mass = np.zeros(UNITS), np.zeros(UNITS)
        for r in sums:
            tokens[r["unit"]], mass[r["unit"]] = r["tokens"], r["mass"]
        as_unknown = sum(r["half"] for r in sums)
        if docs:
            tokens[END], mass[END] = docs, docs + 1
        total = sum(r["tokens"] for r in sums) + docs
        size = sum(r["n"] for r in sums) + (docs > 0)
        return Units(total, size, docs, tokens, mass, as_unknown), frequent

    def _with_unit(self, words: DataFrame, frequent: list[str]) -> DataFrame:
        own = words.sparkSession.createDataFrame([(w, WORDS + k) for k, w in enumerate(frequent)], "word string, own int")
        by_ending = F.when(F.col("c") > 0, F.col("ending") + WORDS + FREQUENT).otherwise(UNKNOWN)
        return words.join(F.broadcast(own), "word", "left").withColumn("unit", F.coalesce("own", by_ending))

    def _encode(self) -> DataFrame:
        """Per document its counts, the score by counts, the words' share in their units, and its units."""
        units = self.units
        known = self._with_unit(self.words, self.frequent)
        known = known.select("block", "place", "c", "unit", F.col("ending") + WORDS + FREQUENT, "half").toDF(
            "block", "place", "c", "unit", "ending", "half"
        )
        log_total = np.log10(units.train_tokens + units.vocabulary + 1)
        log_mass = np.log10(np.maximum(units.mass, 1))

        def encode(docs: pa.Table, words: pa.Table) -> pa.Table:
            place = words.column("place").to_numpy()
            n = int(place.max(initial=-1)) + 1
            c, unit, seen, half = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, bool)
            c[place] = words.column("c").to_numpy()
            unit[place] = words.column("unit").to_numpy()
            half[place] = words.column("half").to_numpy()
            # As a context, an unknown word is known by its ending.
            seen[place] = np.where(words.column("unit").to_numpy() == UNKNOWN, words.column("ending").to_numpy(), unit[place])
            log_c = np.log10(c + 1) - log_total
            rare = unit >= WORDS + FREQUENT
            within = np.where(rare, np.log10(c + 1) - log_mass[unit], 0.0)
            end_c = units.train_docs
            out = {k: [] for k in ("n_tokens", "n_known", "base_score", "within", "units", "seen")}
            for data in docs.column("ids").to_pylist():
                ids = np.frombuffer(data, "<u4")
                out["n_tokens"].append(len(ids) + 1)
                out["n_known"].append(int((c[ids] > 0).sum()) + (end_c > 0))
                out["base_score"].append(float(log_c[ids].sum() + np.log10(end_c + 1) - log_total))
                out["within"].append(float(within[ids].sum()))
                own = np.where(half[ids] & rare[ids], unit[ids] | AS_UNKNOWN, unit[ids])
                out["units"].append(np.append(own, END if end_c else UNKNOWN).astype("<u2").tobytes())
                # Only where they differ from the units are the context units kept.
                out["seen"].append(seen[ids].astype("<u2").tobytes() if (unit[ids] == UNKNOWN).any() else None)
            kinds = {"n_tokens": pa.int64(), "n_known": pa.int64(), "base_score": pa.float64(), "within": pa.float64(), "units": pa.binary(), "seen": pa.binary()}
            columns = {"doc_id": docs.column("doc_id"), "held_out": docs.column("held_out")}
            done = pa.table(columns | {k: pa.array(v, kinds[k]) for k, v in out.items()})
            del out
            give_back()
            return done

        docs = self.indexed.filter("word IS NULL").select("block", "doc_id", "held_out", "ids")
        schema = f"doc_id {self.kind}, held_out boolean, n_tokens long, n_known long, base_score double, within double, units binary, seen binary"
        return docs.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(encode, schema)

    def _train(self, number: int) -> Parameters:
        """One round: every task trains on its shard from the same parameters; then their weighted mean."""
        parameters, prior = self.parameters, self.units.prior

        @in_clean_worker
        def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            trainer = Trainer(parameters, prior, number)
            steps, contexts, targets, n = 0, [], [], 0

            def run() -> None:
                nonlocal steps, contexts, targets, n
                x, y = np.concatenate(contexts), np.concatenate(targets)
                order = trainer.rng.permutation(len(y))
                for a in range(0, len(order), BATCH):
                    some = order[a : a + BATCH]
                    trainer.step(x.take(some, axis=0), y.take(some))
                steps += len(y)
                contexts, targets, n = [], [], 0

            for part in slices(batches, "units", 1 << 20):
                units, starts = _sequences(part)
                plain = (units & ~np.uint16(AS_UNKNOWN)).astype(np.int32)
                mine = slice(number, None, ROUNDS)
                contexts.append(np.ascontiguousarray(contexts_of(plain, starts)[mine], np.int32))
                targets.append(np.where(units[mine] & AS_UNKNOWN, UNKNOWN, plain[mine]))
                n += len(targets[-1])
                if n >= 64 * BATCH:
                    run()
            if n:
                run()
            # Sums weighted by positions; the last row holds the weight.
            place = np.arange(Parameters.size() + 1, dtype=np.int32)
            value = np.append(trainer.p.flat.astype(np.float64), 1.0) * steps
            yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(value)], ["place", "value"])

        shards = self.sequences.filter("NOT held_out").select("units")
        sums = shards.mapInArrow(train, "place int, value double").groupBy("place").agg(F.sum("value").alias("value"))
        total = np.zeros(Parameters.size() + 1)
        for r in sums.collect():  # as many short rows as the model has numbers
            total[r["place"]] = r["value"]
        if not total[-1]:
            return parameters
        return Parameters((total[:-1] / total[-1]).astype(np.float32))

    def score(self) -> DataFrame:
        """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every document.

        ``score`` is the log10 of the text's probability, its end included; ``base_score`` is that by word counts
        alone. Null and empty texts consist of their end. Equal rows are scored one by one (but all counted in
        training), null ids are learned from, other columns are not read, and an empty table gives an empty result.
        Without training texts every token is unknown and has probability 1.
        """
        parameters, valid = self.parameters, self.units.valid

        @in_clean_worker
        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            kept = ("doc_id", "held_out", "n_tokens", "n_known", "base_score")
            for part in slices(batches, "units", 1 << 20):
                units, starts = _sequences(part)
                units = (units & ~np.uint16(AS_UNKNOWN)).astype(np.int32)
                each = log10_units(parameters, valid, units, starts, part.column("seen").to_pylist())
                total = np.add.reduceat(each, starts) + part.column("within").to_numpy()
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.array(total)], [*kept, "score"])

        schema = f"doc_id {self.kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double"
        scored = self.sequences.mapInArrow(score, schema)
        return scored.select(
            "doc_id", "held_out", "n_tokens", "n_known", F.lit(self.units.train_tokens).cast("long").alias("train_tokens"), "base_score", "score"
        )
