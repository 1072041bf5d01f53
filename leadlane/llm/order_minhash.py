"""Near-duplicates by order min-hash, verified by banded alignment.

Every text becomes the list of its lower-case words; equal lists are one node. A sketch of a node picks the two
smallest of its shingles under a random order, repeated shingles told apart by a running number, and keeps the order
in which they stand in the text. Nodes with a sketch in common share a bucket; of buckets with the same nodes one is
kept. Within a bucket, a leader stands for the nodes that a lower bound of the edit distance lets pass; each such pair
is aligned, and pairs whose similarity (1 - edits / longer length, in words) is high enough are links. That joins most
of every class at a cost in proportion to its rows. Then the nodes of a bucket that the links so far leave in different
classes are compared with each other: those that the bound lets match any other are marked, and only they go on, with
their words. One task holds the marked nodes of a bucket, finds pairs by an index of the rarest words of each, aligns
them and joins the classes as it finds links, so it sends out fewer links than it has nodes. So the classes are those of
comparing all pairs within all buckets. Buckets too large for one task are split by ranges of word counts that overlap by the
budget, and what is still too large into pairs of blocks, so no two rows that may match are kept apart. Classes are
the connected components of the links.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadlane.llm.alignment import distance_within
from leadlane.llm.common import in_clean_worker, list_parts, word_hashes, words_of
from leadlane.llm.components import components
from leadlane.operators.key_filter import blocks_for, key_filter, with_may_hold
from leadlane.sources.staging import Workspace

SHINGLE = 5
#: Words of the shingles that sketches are made of: at similarity 0.8 half of them survive, of longer ones too few do.
SKETCH_SHINGLE = 3
SKETCHES = 40
PICKED = 2
#: Texts of at most so many words get further sketches, of as many single words.
SHORT_WORDS = 60
SHORT_SKETCHES = 16
SHORT_PICKED = 3
SIMILARITY = 0.8
#: Bins of word counts from which the lower bound of the edit distance is taken.
BINS = 256
#: Nodes of a bucket that one task handles together.
BUCKET_ROWS = 4000
#: Orders of the nodes in which buckets pick their leaders: with few of them much of a class is left to the comparison
#: of all pairs, with many the same links are found often. Classes do not depend on it.
LEADER_ORDERS = 16

_ODD = np.uint64(0x9E3779B97F4A7C15)
_ODD2 = np.uint64(0xC2B2AE3D27D4EB4F)
_SEEDS = np.random.default_rng(20240607).integers(1, 1 << 63, SKETCHES, dtype=np.uint64)
_SHORT_SEEDS = np.random.default_rng(20240608).integers(1, 1 << 63, SHORT_SKETCHES, dtype=np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _ODD
    x = (x ^ (x >> np.uint64(29))) * _ODD2
    return x ^ (x >> np.uint64(32))


def shingles(words: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """Hashes of the shingles, equal ones numbered; a shorter text is one shingle."""
    n = max(len(words) - size + 1, 1)
    code = np.zeros(n, np.uint64)
    for k in range(min(size, len(words))):
        code = _mix(code + words[k : k + n]) + np.uint64(k)
    order = np.argsort(code, kind="stable")
    same = np.concatenate([[False], np.diff(code[order]) == 0])
    if same.any():
        at = np.arange(n)
        begin = np.maximum.accumulate(np.where(same, 0, at))
        times = np.empty(n, np.uint64)
        times[order] = (at - begin).astype(np.uint64)
        # Only repeats change, so that a text with some still shares the rest with a text without.
        code = np.where(times > 0, _mix(code + times * _ODD2), code)
    return code


def sketch(words: np.ndarray) -> np.ndarray:
    """One key per sketch: the picked shingles in the order of the text."""
    keys = _pick(shingles(words, SKETCH_SHINGLE), PICKED, _SEEDS)
    if len(words) > SHORT_WORDS:
        return keys
    return np.concatenate([keys, _pick(shingles(words, 1), SHORT_PICKED, _SHORT_SEEDS)])


def _pick(code: np.ndarray, count: int, all_seeds: np.ndarray) -> np.ndarray:
    picked = min(count, len(code))
    keys = np.empty(len(all_seeds), np.uint64)
    step = max(1, (1 << 20) // len(code))
    for a in range(0, len(keys), step):
        seeds = all_seeds[a : a + step, None]
        values = _mix(code[None, :] ^ seeds)
        at = np.sort(np.argpartition(values, picked - 1, axis=1)[:, :picked], axis=1)
        key = seeds[:, 0].copy()
        for k in range(picked):
            key = _mix(key + code[at[:, k]])
        keys[a : a + step] = key
    return keys


@in_clean_worker
def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number of words, bins and sketches of every text."""
    for batch in batches:
        offsets, values = list_parts(batch.column("words"))
        values = values.astype(np.int64).view(np.uint64)
        bins, keys = [], []
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
            words = values[a:b]
            counts = np.bincount((words >> np.uint64(56)).astype(np.int64), minlength=BINS)
            bins.append(np.minimum(counts, 255).astype(np.uint8).tobytes())
            keys.append(sketch(words).view(np.int64) if len(words) else None)
        columns = {c: batch.column(c) for c in ("doc_id", "h1", "h2")}
        columns["n"] = pa.array(np.diff(offsets).astype(np.int64))
        columns["bins"] = pa.array(bins, pa.binary())
        columns["sketch"] = pa.array(keys, pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def _may_match(n: np.ndarray, bins: np.ndarray, leader_n: np.ndarray, leader_bins: np.ndarray, similarity: float) -> np.ndarray:
    """Whether the bag of words allows an edit distance within the budget; never False for a true link."""
    budget = np.floor((1 - similarity) * np.maximum(n, leader_n) + 1e-9)
    gap = bins.astype(np.int16) - leader_bins.astype(np.int16)
    more = np.where(gap > 0, gap, 0).sum(axis=1, dtype=np.int32)
    return (np.abs(n - leader_n) <= budget) & (np.maximum(more, more - gap.sum(axis=1, dtype=np.int32)) <= budget)


def _bins_of(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), BINS)


def _distance(a: str, b: str, similarity: float) -> int | None:
    """Edits between two texts of space-separated words if they are similar enough."""
    x, y = a.split(" "), b.split(" ")
    return distance_within(x, y, int((1 - similarity) * max(len(x), len(y)) + 1e-9))


def _by_group(of_group, names: tuple[str, ...]):
    """Arrow function over rows sorted by ``part``: the pairs that ``of_group`` finds in the rows of each."""

    @in_clean_worker
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def finish(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
            table = pa.Table.from_batches(rows).combine_chunks()
            part = table.column("part").to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
            found = [p for a, b in zip(edges, edges[1:]) if b - a > 1 for p in of_group(table.slice(a, b - a))]
            columns = list(zip(*found)) or [[] for _ in names]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], list(names))

        for batch in batches:
            if not batch.num_rows:
                continue
            # The last group of a batch may go on in the next one.
            part = batch.column("part").to_numpy()
            last = int(np.searchsorted(part, part[-1]))
            if last:
                yield finish([*held, batch.slice(0, last)])
                held = []
            held.append(batch.slice(last))
        if held:
            yield finish(held)

    return run


def _lead(similarity: float):
    """Pairs every row of a group with the first leader that may match it."""

    def of_group(rows: pa.Table) -> Iterator[tuple[int, int]]:
        node, n = rows.column("node").to_numpy(), rows.column("n").to_numpy()
        bins, left = _bins_of(rows.column("bins")), np.arange(rows.num_rows)
        while len(left) > 1:
            first, left = left[0], left[1:]
            taken = _may_match(n[left], bins[left], n[first], bins[first], similarity)
            for k in left[taken].tolist():
                yield int(node[k]), int(node[first])
            left = left[~taken]

    return _by_group(of_group, ("node", "leader"))


def _mark(similarity: float):
    """The rows of a group that the bag of words lets match a row of another root; each comes once."""

    def of_group(rows: pa.Table) -> Iterator[tuple[int, int]]:
        part, node, n, root = (rows.column(c).to_numpy() for c in ("part", "node", "n", "root"))
        if (root == root[0]).all():
            return
        bins, marked = _bins_of(rows.column("bins")), np.zeros(len(node), bool)
        for k in range(len(node) - 1):
            other = np.flatnonzero(root[k + 1 :] != root[k]) + k + 1
            other = other[np.abs(n[other] - n[k]) <= (1 - similarity) * np.maximum(n[other], n[k]) + 1e-9]
            other = other[_may_match(n[other], bins[other], n[k], bins[k], similarity)]
            marked[other] = True
            marked[k] |= len(other) > 0
        for k in np.flatnonzero(marked).tolist():
            yield int(part[k]), int(node[k])

    return _by_group(of_group, ("part", "node"))


def _prefixes(tokens: list[np.ndarray], similarity: float) -> Iterator[list[int]]:
    """Groups of rows that share one of their rarest words, such that rows that may match share a group.

    Rows within b edits have all but b words of the longer one in common, so if the words of each are put in one order,
    here by how rare they are in the group, the first b + 1 of both have one in common.
    """
    words, place, times = np.unique(np.concatenate(tokens), return_inverse=True, return_counts=True)
    rarity = np.empty(len(words), np.int64)
    rarity[np.argsort(times, kind="stable")] = np.arange(len(words))
    ends = np.cumsum([len(t) for t in tokens])
    chosen, rows = [], []
    for k, (end, token) in enumerate(zip(ends.tolist(), tokens)):
        rank = np.sort(rarity[place[end - len(token) : end]])[: int((1 - similarity) * len(token) + 1e-9) + 1]
        chosen.append(rank)
        rows.append(np.full(len(rank), k))
    rank, row = np.concatenate(chosen), np.concatenate(rows)
    order = np.argsort(rank, kind="stable")
    rank, row = rank[order], row[order]
    edges = [0, *(np.flatnonzero(np.diff(rank)) + 1).tolist(), len(rank)]
    for a, b in zip(edges, edges[1:]):
        if b - a > 1:
            yield row[a:b].tolist()


def _cross(similarity: float):
    """Links between the rows of a group that have different roots; once two roots are linked, they count as one.

    A pair is aligned in the smallest of the groups that both of its rows are in, and in no other.
    """

    def of_group(rows: pa.Table) -> Iterator[tuple[int, int, int]]:
        part = rows.column("part")[0].as_py()
        node, root = rows.column("node").to_pylist(), rows.column("root").to_pylist()
        parts = [frozenset(p) for p in rows.column("parts").to_pylist()]
        offsets, values = list_parts(rows.column("words").combine_chunks() if rows.num_rows else rows.column("words"))
        words = [values[a:b].astype(np.int64).view(np.uint64) for a, b in zip(offsets, offsets[1:])]
        tokens = [np.sort(shingles(w, 1)) for w in words]
        parent = {r: r for r in root}

        def top(r: int) -> int:
            while parent[r] != r:
                parent[r] = r = parent[parent[r]]
            return r

        tried = set()
        def similar(i: int, j: int) -> int | None:
            longer = max(len(words[i]), len(words[j]))
            budget = int((1 - similarity) * longer + 1e-9)
            if abs(len(words[i]) - len(words[j])) > budget or min(parts[i] & parts[j]) != part:
                return None
            if longer - len(np.intersect1d(tokens[i], tokens[j], assume_unique=True)) > budget:
                return None
            return distance_within(words[i].tolist(), words[j].tolist(), budget)

        for group in _prefixes(tokens, similarity):
            classes: dict[int, list[int]] = {}
            for i in group:
                classes.setdefault(top(root[i]), []).append(i)
            members = list(classes.values())
            for at, some in enumerate(members):
                for others in members[at + 1 :]:
                    for i, j in product(some, others):
                        low, high = sorted((top(root[i]), top(root[j])))
                        if low == high:
                            break
                        if (i, j) in tried:
                            continue
                        tried.add((i, j))
                        edits = similar(i, j)
                        if edits is not None:
                            parent[high] = low
                            yield max(node[i], node[j]), min(node[i], node[j]), edits

    return _by_group(of_group, ("node", "leader", "edits"))


def _join_leaders(similarity: float):
    """Arrow function over rows joined with their bucket's leader: the pairs that may match."""

    @in_clean_worker
    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, leader_n = (batch.column(c).to_numpy() for c in ("n", "leader_n"))
            ok = _may_match(n, _bins_of(batch.column("bins")), leader_n, _bins_of(batch.column("leader_bins")), similarity)
            yield batch.select(["node", "leader"]).filter(pa.array(ok))

    return decide


def _align(similarity: float):
    @in_clean_worker
    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pydict()
            edits = [_distance(a, b, similarity) for a, b in zip(rows["words_a"], rows["words_b"])]
            yield pa.RecordBatch.from_arrays(
                [batch.column("node"), batch.column("leader"), pa.array(edits, pa.int64())], ["node", "leader", "edits"]
            )

    return align


class NearDuplicates:
    """The tables of one run: ``members`` (document rows and their node), ``nodes``, ``links`` between nodes."""

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, workspace: Workspace | None = None):
        self.workspace = workspace or Workspace(docs.sparkSession)
        self.similarity = similarity
        rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
        self.kind = rows.schema["doc_id"].dataType.simpleString()
        self.docs = rows
        stage = self.workspace.stage
        hashed = rows.select("doc_id", word_hashes(F.col("text")).alias("words")).select("doc_id", *node_key("words"), "words")
        described = hashed.mapInArrow(
            _describe, f"doc_id {self.kind}, h1 long, h2 long, n long, bins binary, sketch array<long>"
        )
        self.members = stage(described, "described")
        one = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "n", "bins", "sketch")).alias("one")
        nodes = self.members.groupBy("h1", "h2").agg(one).select("h1", "h2", *[f"one.{c}" for c in ("doc_id", "n", "bins", "sketch")])
        self.nodes = stage(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
        self.links = self._find_links()

    def _buckets(self) -> DataFrame:
        """Rows of buckets with more than one row, with the bucket's size; one of those that hold the same nodes."""
        stage = self.workspace.stage
        keys = stage(self.nodes.select(F.explode(F.array_distinct("sketch")).alias("key"), "node"), "keys")
        marks = [F.bit_xor(F.xxhash64("node")).alias("m1"), F.bit_xor(F.xxhash64(F.lit(1), "node")).alias("m2")]
        sizes = stage(keys.groupBy("key").agg(F.count("*").alias("size"), *marks).filter("size > 1"), "sizes")
        sizes = stage(sizes.groupBy("size", "m1", "m2").agg(F.min("key").alias("key")).select("key", "size"), "buckets")
        about = self.nodes.select("node", "n", "bins")
        return stage(keys.join(sizes.hint("merge"), "key").join(about.hint("merge"), "node"), "active")

    def _no_links(self) -> DataFrame:
        # A range needs no Python workers, as rows given by a list do.
        return self.nodes.sparkSession.range(0).select(*[F.col("id").alias(c) for c in ("node", "leader", "edits")])

    def _find_links(self) -> DataFrame:
        stage = self.workspace.stage
        active = self._buckets()
        links = self._no_links()
        if active.isEmpty():
            return links
        small, large = active.filter(F.col("size") <= BUCKET_ROWS), active.filter(F.col("size") > BUCKET_ROWS)
        parts = small.withColumn("part", F.col("key")).unionAll(self._ranges(large, whole=False))
        pairs = self._in_groups(parts, _lead, ["part", "node", "n", "bins"]).unionAll(self._large(large))
        links = links.unionAll(self._verify(pairs.distinct()).filter("edits IS NOT NULL"))
        # What a leader refused, or failed to align with, may still match others of the bucket: all pairs of rows that
        # the links so far leave apart are tried.
        roots = components(links.select(F.col("node").alias("a"), F.col("leader").alias("b")), self.workspace)
        rooted = active.join(roots.hint("merge"), "node", "left").withColumn("root", F.coalesce("root", "node"))
        rooted = stage(rooted, "rooted-rows")
        open_keys = rooted.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high")
        rooted = rooted.join(stage(open_keys.select("key"), "open-buckets").hint("merge"), "key")
        small, large = rooted.filter(F.col("size") <= BUCKET_ROWS), rooted.filter(F.col("size") > BUCKET_ROWS)
        parts = small.withColumn("part", F.col("key")).unionAll(self._ranges(large, whole=True))
        marked = self._in_groups(parts, _mark, ["part", "node", "n", "bins", "root"], "part long, node long")
        return links.unionAll(self._align_marked(stage(marked, "marked"), roots))

    def _align_marked(self, marked: DataFrame, roots: DataFrame) -> DataFrame:
        """Links between marked rows of a part, found in one task each that holds their words."""
        stage = self.workspace.stage
        if marked.isEmpty():
            return self._no_links()
        # A node has few sketches, so it is in few parts.
        about = marked.groupBy("node").agg(F.sort_array(F.collect_set("part")).alias("parts")).join(roots.hint("merge"), "node", "left")
        about = stage(about.select("node", "parts", F.coalesce("root", "node").alias("root")), "marked-nodes")
        words = stage(self._rows_of(about.select("node")).select("node", "words").dropDuplicates(["node"]), "marked-words")
        rows = marked.distinct().join(about.join(words.hint("merge"), "node").hint("merge"), "node")
        return stage(self._in_groups(rows, _cross, ["part", "node", "root", "parts", "words"], "node long, leader long, edits long"), "crossed")

    def _rows_of(self, nodes: DataFrame) -> DataFrame:
        """``node, text, words`` of the document that stands for each of some nodes; only these rows are shuffled."""
        stage = self.workspace.stage
        wanted = stage(nodes.join(self.nodes.select("node", "h1", "h2", "doc_id"), "node"), "wanted")
        id_key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
        blocks = blocks_for(wanted.count())
        held = stage(key_filter(wanted.select(id_key.alias("id_key")), "id_key", blocks), "wanted-ids")
        rows = with_may_hold(self.docs, held, id_key, blocks, "may_be_wanted").filter("may_be_wanted")
        rows = rows.withColumn("words", word_hashes(F.col("text"))).select("doc_id", "text", "words", *node_key("words"))
        theirs = (rows["h1"] == wanted["h1"]) & (rows["h2"] == wanted["h2"]) & rows["doc_id"].eqNullSafe(wanted["doc_id"])
        return rows.join(wanted.hint("merge"), theirs).select("node", "text", "words")

    def _ranges(self, large: DataFrame, whole: bool) -> DataFrame:
        """Large buckets in parts that fit one task, as ``part``.

        With ``whole``, any two rows of a bucket whose word counts are within the budget share a part: a row goes to
        its range of word counts and the next, and of ranges that are still too large to every pair of blocks with its
        own. Without, every row goes to one part only.
        """
        # Ranges are wide enough that rows that may match are in the same or in neighbouring ones.
        level = F.floor(F.log(F.greatest("n", F.lit(1)).cast("double")) / math.log(1.01 / max(self.similarity, 0.1)))
        levels = F.array(level, level + 1) if whole else F.array(level)
        rows = large.select("*", F.explode(levels).alias("level")).withColumn("part", F.xxhash64("key", "level")).drop("level")
        sizes = rows.groupBy("part").agg(F.count("*").alias("rows"))
        blocks = F.when(F.col("rows") <= BUCKET_ROWS, 1).otherwise(F.ceil(2 * F.col("rows") / BUCKET_ROWS)).cast("int")
        sizes = self.workspace.stage(sizes.select("part", blocks.alias("blocks")), "blocks")
        rows = rows.join(sizes.hint("merge"), "part").withColumn("own", F.pmod(F.xxhash64("node", "part"), "blocks"))
        other = F.sequence(F.lit(0), F.col("blocks") - 1) if whole else F.array("own")
        rows = rows.withColumn("other", F.explode(other))
        part = F.xxhash64("part", F.least("own", "other"), F.greatest("own", "other"))
        return rows.withColumn("part", part).select(*large.columns, "part")

    def _in_groups(self, parts: DataFrame, function, columns: list[str], schema: str = "node long, leader long") -> DataFrame:
        """What an Arrow function finds in each part."""
        # With few orders of the nodes, most buckets of a class have the same leaders, so links are found once.
        order = F.xxhash64("node", F.pmod("part", F.lit(LEADER_ORDERS)))
        ordered = parts.select(*columns).repartition("part").sortWithinPartitions("part", order)
        return ordered.mapInArrow(function(self.similarity), schema)

    def _large(self, large: DataFrame) -> DataFrame:
        """Rows of large buckets that one leader each may match, by a join that can split the bucket."""
        large = self.workspace.stage(large.select("key", "node", "n", "bins"), "large")
        first = F.min(F.struct(F.xxhash64("node", F.pmod("key", F.lit(LEADER_ORDERS))), "node", "n", "bins")).alias("first")
        leaders = large.groupBy("key").agg(first).select(
            "key", F.col("first.node").alias("leader"), F.col("first.n").alias("leader_n"), F.col("first.bins").alias("leader_bins")
        )
        leaders = self.workspace.stage(leaders, "leaders")
        joined = large.join(leaders, "key").filter("node != leader")
        return joined.select("node", "leader", "n", "bins", "leader_n", "leader_bins").mapInArrow(
            _join_leaders(self.similarity), "node long, leader long"
        )

    def _verify(self, pairs: DataFrame) -> DataFrame:
        """``node, leader, edits`` of every pair; edits are null beyond the budget."""
        stage = self.workspace.stage
        pairs = stage(pairs, "pairs")
        wanted = pairs.select("node").unionAll(pairs.select(F.col("leader").alias("node"))).distinct()
        texts = self._rows_of(wanted).select("node", F.concat_ws(" ", words_of(F.lower("text"))).alias("words"))
        # Repeated rows of one document are the only copies left here.
        texts = stage(texts.dropDuplicates(["node"]), "texts")
        both = pairs.join(texts.withColumnRenamed("words", "words_a").hint("merge"), "node")
        both = both.join(texts.select(F.col("node").alias("leader"), F.col("words").alias("words_b")).hint("merge"), "leader")
        aligned = both.select("node", "leader", "words_a", "words_b").mapInArrow(
            _align(self.similarity), "node long, leader long, edits long"
        )
        return stage(aligned, "aligned")

    def classes(self, with_root: bool = False) -> DataFrame:
        """``h1, h2, class_id`` of every node; the class id is the smallest document id in the class.

        ``with_root`` gives the class's smallest node, ``root``, instead.
        """
        found = components(self.links.select(F.col("node").alias("a"), F.col("leader").alias("b")), self.workspace)
        rooted = self.nodes.join(found, "node", "left").select(
            "h1", "h2", "doc_id", F.coalesce("root", "node").alias("root")
        )
        rooted = self.workspace.stage(rooted, "rooted")
        if with_root:
            return rooted.drop("doc_id")
        smallest = rooted.groupBy("root").agg(F.min("doc_id").alias("class_id"))
        smallest = self.workspace.stage(smallest, "class-ids")
        return self.workspace.stage(rooted.join(smallest, "root").select("h1", "h2", "class_id"), "classes")


def node_key(words: str) -> list:
    """Two hashes that stand for a list of words."""
    return [F.xxhash64(words).alias("h1"), F.xxhash64(F.lit(1), F.col(words)).alias("h2")]


def near_duplicate_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, workspace: Workspace | None = None) -> DataFrame:
    """``doc_id, class_id, n_words`` of every row of ``docs``.

    Documents of a class are near-duplicates, linked directly or by others; the class id is their smallest document
    id, so a document without any has its own. Null, empty and blank texts have no words and are copies of each
    other. Equal rows are in one class. A class id is null only if all ids of its class are. Other columns are not
    read, and an empty table gives an empty result.
    """
    found = NearDuplicates(docs, id_col, text_col, similarity, workspace)
    return found.members.join(found.classes(), ["h1", "h2"]).select("doc_id", "class_id", F.col("n").alias("n_words"))


def one_of_each_class(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, workspace: Workspace | None = None) -> DataFrame:
    """One row of ``docs`` per class of near-duplicates, with all its columns: one with the smallest id."""
    workspace = workspace or Workspace(docs.sparkSession)
    found = NearDuplicates(docs, id_col, text_col, similarity, workspace)
    members = found.members.select("doc_id", "h1", "h2").join(found.classes(with_root=True), ["h1", "h2"])
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "h1", "h2")).alias("first")
    kept = workspace.stage(members.groupBy("root").agg(first).select(*[F.col(f"first.{c}").alias(c) for c in ("doc_id", "h1", "h2")]), "kept")
    inner = [f"c{i}" for i in range(len(docs.columns))]
    rows = docs.toDF(*inner)
    own_id, own_text = (F.col(inner[docs.columns.index(c)]) for c in (id_col, text_col))
    rows = rows.withColumn("words", word_hashes(own_text)).select(*inner, *node_key("words"))
    kept = kept.toDF("kept_id", "k1", "k2")
    out = rows.join(kept, (F.col("h1") == F.col("k1")) & (F.col("h2") == F.col("k2")) & own_id.eqNullSafe(F.col("kept_id")))
    # Rows that repeat an id with the same words are rare, and only they need another pass.
    if not found.members.groupBy("doc_id", "h1", "h2").count().filter("count > 1").isEmpty():
        out = out.dropDuplicates(["k1", "k2"])
    return out.select(*inner).toDF(*docs.columns)
