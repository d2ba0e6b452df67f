"""Near-duplicate documents by a chosen-path set similarity join.

Documents are sets of word shingles. A tree's root branches every document by the minimum of its
set under some hash functions (its minwise tokens); two documents with Jaccard similarity s meet
in one branch with probability s. Nodes that are still large branch again by further tokens, which
keeps a pair with probability ``1 - (1 - s) ** branch`` a level; small ones are compared exhaustively,
and independent trees are repeated. With 3 trees of 3 branches a pair at the threshold of 0.8 is
missed with a probability of 0.2 ** 9 = 5e-7 if its nodes are small, 2e-6 if they branch 6 times.

Comparisons inside a node use 8-bit minwise signatures to find candidates (a pair at the threshold
fails that with a probability of 2e-8); every link that counts
is confirmed on the full sets, built from the texts. Only connectivity matters to the
result, so a node first proposes a spanning forest of its likely links. When those are confirmed
or refuted, nodes whose documents are not all in one component are compared again: documents
with a candidate in another component get their full sets of shingle hashes, all such pairs of the
node are compared on these, and a spanning forest of the true links is confirmed. Pairs that
fail never leave the node.

Nodes that do not shrink by branching (near copies, pages made from one template) are linked
through a few pivots. Then the documents outside a node's largest component meet the whole node in
blocks if they are few. If they are many, an exact prefix filter keeps the work in proportion: in the
order of their frequency in the node, rarest first, a linked pair has its first common shingle
among the first of both. Shingles of at most RARE documents make nodes of their own; a pair whose
first common shingle is more frequent has so few rare ones, and such sizes, that it is looked for
among documents of fitting sizes only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tideline.llm.batches import TwoGenerations, map_rows
from tideline.storage import materialize, scratch

#: Signature bytes; standard errors below the threshold at which a pair is still a candidate.
SIGNATURE, MARGIN = 128, 6.0
#: Nodes up to SMALL documents are compared exhaustively; pivots of a dense node; a child with
#: DENSE of its parent's documents does not shrink; levels of branching.
SMALL, PIVOTS, DENSE, DEPTH = 1024, 4, 0.5, 6
#: Documents that share a shingle that is rare in a crowded node; sizes in one band differ by less than this.
RARE, BAND = 64, 1.02
#: Tables of ids up to this many rows are broadcast.
MOST_BROADCAST = 200_000
#: Bytes of full sets that a node is compared on at once; beyond, its pairs are confirmed on texts.
MOST_BYTES = 32 << 20
U = np.uint64


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer, elementwise."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def word_hash(word: bytes) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(word)


def tokens(text: str | None) -> list[bytes]:
    """Words between [\\x20\\x09-\\x0D], A-Z lower-cased (bytes methods touch ASCII only)."""
    return text.encode("utf-8", "replace").lower().split() if text else []


def shingle_hashes(words: list[bytes], k: int, hashed: Callable[[bytes], int]) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles; fewer words are one shingle, none are none."""
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashed, words), np.uint64, len(words))
    n = max(1, len(h) - k + 1)
    out = np.full(n, len(h) if len(h) < k else k, np.uint64)
    for i in range(min(k, len(h))):
        out = mixed(out * U(0x9E3779B97F4A7C15) + h[i : i + n])
    return np.unique(out)


def exact_set(words: list[bytes], k: int) -> set:
    """The shingles themselves, for confirming links."""
    return {tuple(words)} if len(words) < k and words else set(zip(*(words[i:] for i in range(k)), strict=False))


def signatures(docs: DataFrame, k: int, roots: int, seed: int) -> DataFrame:
    """``doc_id, n, hi, lo`` (the set's size and 128-bit hash), ``roots`` (minwise tokens of the
    trees' roots) and ``sig`` (SIGNATURE bytes). Long sets are hashed in blocks."""
    types = dict(docs.dtypes)

    def make():
        rng = np.random.default_rng(seed)
        a = rng.integers(0, 1 << 63, SIGNATURE, dtype=np.uint64) * U(2) + U(1)
        cached = TwoGenerations(word_hash, half=400_000)

        def work(rows):
            out = []
            for doc, text in rows:
                s = shingle_hashes(tokens(text), k, cached.__getitem__)
                if not len(s):
                    out.append((doc, 0, 0, 0, [], b""))
                    continue
                least = np.full(SIGNATURE, ~U(0))
                for i in range(0, len(s), 2048):
                    x = s[i : i + 2048, None] * a
                    np.minimum(least, (x ^ (x >> U(32))).min(0), out=least)
                least = mixed(least)
                both = np.array([s.sum(), mixed(s ^ U(0x5851F42D4C957F2D)).sum()], np.uint64).view(np.int64)
                out.append((doc, len(s), int(both[0]), int(both[1]), least[:roots].view(np.int64).tolist(), (least & U(255)).astype(np.uint8).tobytes()))
            return out

        return work

    fields = [("doc_id", types["doc_id"]), ("n", "bigint"), ("hi", "bigint"), ("lo", "bigint"), ("roots", "array<bigint>"), ("sig", "binary")]
    return map_rows(docs.select("doc_id", "text"), make, fields)


def floor_of(percent: int) -> float:
    """Share of equal signature bytes from which a pair is a candidate."""
    t = percent / 100
    return t - MARGIN * np.sqrt(t * (1 - t) / SIGNATURE)


def likely(sig_a: np.ndarray, n_a: np.ndarray, sig_b: np.ndarray, n_b: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Candidate places (i, j) between two blocks of documents and their shares of equal bytes."""
    found = []
    for i in range(len(sig_a)):
        share = (sig_b == sig_a[i]).mean(1)
        ok = (share >= floor_of(percent)) & (100 * np.minimum(n_b, n_a[i]) >= percent * np.maximum(n_b, n_a[i]))
        j = np.flatnonzero(ok)
        if len(j):
            found.append((np.full(len(j), i), j, share[j]))
    if not found:
        return np.empty(0, int), np.empty(0, int), np.empty(0)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


class Union:
    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = i = self.up[self.up[i]]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        self.up[max(i, j)] = min(i, j)
        return i != j


def candidate_pairs(c: dict, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Candidate places i < j of different documents of one node, in blocks, with their shares."""
    ids, n, sig = c["id"], c["n"], c["sig"]
    edges = []
    for at in range(0, len(ids), 256):
        i, j, share = likely(sig[at : at + 256], n[at : at + 256], sig[at:], n[at:], percent)
        i, j = i + at, j + at
        keep = (i < j) & (ids[i] != ids[j])
        edges.append((i[keep], j[keep], share[keep]))
    return tuple(np.concatenate(x) for x in zip(*edges, strict=True))


def ordered(a: int, b: int) -> tuple[int, int]:
    return (a, b) if a < b else (b, a)


def forest(c: dict, percent: int) -> list[tuple]:
    """A spanning forest of the likeliest candidate pairs of a node."""
    i, j, share = candidate_pairs(c, percent)
    order = np.argsort(-share, kind="stable")
    tree = Union(len(c["id"]))
    return [ordered(int(c["id"][a]), int(c["id"][b])) for a, b in zip(i[order].tolist(), j[order].tolist(), strict=True) if tree.join(a, b)]


def involved(c: dict, percent: int) -> list[tuple]:
    """``node, id, label, pair`` of the documents with a candidate in another component. Rows with a
    ``side`` are candidates across sides only, and only if both are in the other's ``reach``. Where the
    full sets would be too large to hold, the candidate pairs themselves (``pair`` is 1)."""
    if (c["label"] == c["label"][0]).all():
        return []
    if "side" in c:
        p, q = np.flatnonzero(c["side"] == 0), np.flatnonzero(c["side"] == 1)
        i, j, _ = likely(c["sig"][p], c["n"][p], c["sig"][q], c["n"][q], percent)
        i, j = p[i], q[j]
        near = (c["n"][i] <= c["reach"][j]) & (c["n"][j] <= c["reach"][i])
        i, j = i[near], j[near]
    else:
        i, j, _ = candidate_pairs(c, percent)
    across = c["label"][i] != c["label"][j]
    i, j = i[across], j[across]
    at = np.unique(np.concatenate([i, j]))
    if 8 * c["n"][at].sum() > MOST_BYTES:
        return [(*ordered(int(c["id"][a]), int(c["id"][b])), 0, 1) for a, b in zip(i.tolist(), j.tolist(), strict=True)]
    return [(int(c["node"][k]), int(c["id"][k]), int(c["label"][k]), 0) for k in at]


def true_links(c: dict, percent: int) -> list[tuple]:
    """A spanning forest of the links across components of a node, compared on the full sets."""
    sets, ids = c["set"], c["id"]
    tree, known = Union(len(ids)), {}
    for i, label in enumerate(c["label"].tolist()):
        tree.join(known.setdefault(label, i), i)
    values, flat = np.unique(np.concatenate(sets), return_inverse=True)
    sizes = np.array([len(x) for x in sets])
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    out = []
    for i in range(len(ids) - 1):
        mark = np.zeros(len(values), bool)
        mark[flat[starts[i] : starts[i] + sizes[i]]] = True
        common = np.add.reduceat(mark[flat[starts[i + 1] :]], starts[i + 1 :] - starts[i + 1], dtype=np.int64)
        linked = 100 * common >= percent * (sizes[i] + sizes[i + 1 :] - common)
        out += [ordered(int(ids[i]), int(ids[j])) for j in (np.flatnonzero(linked) + i + 1).tolist() if tree.join(i, j)]
    return out


def by_node(rows: DataFrame, work: Callable[[dict], list[tuple]], names: tuple[str, ...] = ("a", "b")) -> DataFrame:
    """The distinct results of ``work`` on the rows of every node with several. Nodes are of bounded
    size (SMALL, or two blocks of half of it) and, with full sets, of bounded bytes; rows come
    sorted by node, and a batch's last node waits for the next batch."""
    schema = T.StructType([T.StructField(x, T.LongType()) for x in names])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if rest is None else pa.concat_tables([rest, table])
            node = table.column("node").to_numpy()
            cut = int(np.flatnonzero(node != node[-1])[-1]) + 1 if len(node) and node[0] != node[-1] else 0
            if cut:
                yield results(table.slice(0, cut))
            rest = table.slice(cut)
        if rest is not None and rest.num_rows:
            yield results(rest)

    def results(table: pa.Table) -> pa.RecordBatch:
        columns: dict = {c: table.column(c).to_numpy() for c in table.column_names if c not in ("sig", "set")}
        if "sig" in table.column_names:
            columns["sig"] = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint8).reshape(-1, SIGNATURE)
        if "set" in table.column_names:
            columns["set"] = [np.frombuffer(x, np.uint64) for x in table.column("set").to_pylist()]
        starts = np.concatenate([[0], np.flatnonzero(np.diff(columns["node"])) + 1, [table.num_rows]])
        out: set[tuple] = set()
        for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
            if b - a > 1:
                out.update(work({c: v[a:b] for c, v in columns.items()}))
        found = list(zip(*out, strict=True)) if out else [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], schema=arrow)

    return rows.repartition("node").sortWithinPartitions("node").mapInArrow(run, schema)


def components(edges: DataFrame) -> DataFrame:
    """``id, label``: the smallest id that every end of an edge reaches. Rounds of taking the least
    label among neighbours and then the label's label (which halves paths), until none changes."""
    both = materialize(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "near-edges")
    labels = materialize(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("label")), "near-labels")
    while True:
        around = both.join(labels.select(F.col("id").alias("b"), F.col("label").alias("m")), "b").groupBy("a").agg(F.min("m").alias("m"))
        lower = labels.join(around, labels.id == around.a, "left").select("id", F.col("label").alias("old"), F.least("label", F.coalesce("m", "label")).alias("label"))
        lower = materialize(lower, "near-lower")
        jump = lower.select(F.col("id").alias("label"), F.col("label").alias("j"))
        labels = materialize(lower.join(jump, "label", "left").select("id", "old", F.least("label", F.coalesce("j", "label")).alias("label")), "near-labels")
        if labels.where(F.col("label") != F.col("old")).isEmpty():
            return labels.select("id", "label")


class NearJoin:
    """One run of the join over ``docs`` (``doc_id, text``)."""

    def __init__(self, docs: DataFrame, k: int, percent: int, trees: int, branch: int, seed: int):
        self.docs, self.k, self.percent, self.branch, self.seed = docs.select("doc_id", "text"), k, percent, branch, seed
        self.sets = materialize(signatures(self.docs, k, trees * branch, seed), "near-sets")
        same = self.sets.where("n > 0").groupBy("hi", "lo", "n").agg(F.min("doc_id").alias("id"))
        self.same = materialize(same.where("id is not null"), "near-same")
        first = self.sets.where("n > 0").select("hi", "lo", "n", F.col("doc_id").alias("id"), "sig", "roots").dropDuplicates(["hi", "lo", "n", "id"])
        self.reps = materialize(self.same.join(first, ["hi", "lo", "n", "id"]).select("id", "hi", "n", "sig", "roots"), "near-reps")

    def near(self, table: DataFrame) -> DataFrame:
        return F.broadcast(table) if table.count() <= MOST_BROADCAST else table

    def nodes(self) -> tuple[DataFrame, DataFrame]:
        """Members (``node, id``) of the small nodes of all trees, and of the dense ones."""
        at = self.reps.select("id", F.posexplode("roots").alias("place", "token")).select(F.xxhash64("place", "token").alias("node"), "id", F.lit(1 << 62).alias("parent"))
        small, dense, level = [], [], 0
        while True:
            # a table of its own, so that the join deals both sides anew and a hot node's rows can be split
            sizes = materialize(at.groupBy("node").agg(F.count(F.lit(1)).alias("size"), F.max("parent").alias("parent")).where("size > 1"), f"near-sizes{level}")
            grown = materialize(at.select("node", "id").join(sizes, "node"), f"near-nodes{level}")
            stuck = (F.col("size") > SMALL) & ((F.col("size") >= DENSE * F.col("parent")) | F.lit(level >= DEPTH))
            small.append(grown.where(F.col("size") <= SMALL).select("node", "id"))
            dense.append(grown.where(stuck).select("node", "id"))
            large = grown.where((F.col("size") > SMALL) & ~stuck)
            if level >= DEPTH or large.isEmpty():
                return reduce(DataFrame.union, small), reduce(DataFrame.union, dense)
            # every node draws its own places of the signature
            step = F.explode(F.sequence(F.lit(0), F.lit(self.branch - 1))).alias("step")
            children = large.join(self.reps.select("id", "sig"), "id").select("node", "id", "size", "sig", step)
            place = F.pmod(F.xxhash64("node", "step"), F.lit(SIGNATURE)).cast("int") + 1
            at = children.select(F.xxhash64("node", "step", F.substring("sig", place, F.lit(1))).alias("node"), "id", F.col("size").alias("parent"))
            level += 1

    def with_sets(self, members: DataFrame) -> DataFrame:
        return members.join(self.reps.select("id", "hi", "n", "sig"), "id")

    def pivot_pairs(self, dense: DataFrame) -> DataFrame:
        """Every member of a dense node with the likeliest of the node's pivots."""
        salted = [F.min_by("id", F.xxhash64("id", F.lit(i))).alias(f"p{i}") for i in range(PIVOTS)]
        pivots = dense.groupBy("node").agg(*salted).select("node", F.explode(F.array(*(f"p{i}" for i in range(PIVOTS)))).alias("pivot")).distinct()
        pivots = self.with_sets(pivots.withColumnRenamed("pivot", "id")).select("node", F.col("id").alias("pivot"), F.col("n").alias("pivot_n"), F.col("sig").alias("pivot_sig"))
        met = self.with_sets(dense).join(self.near(materialize(pivots, "near-pivots")), "node").where("id <> pivot")
        percent = self.percent

        def work(rows):
            x = np.frombuffer(b"".join(r[3] for r in rows), np.uint8).reshape(-1, SIGNATURE)
            y = np.frombuffer(b"".join(r[5] for r in rows), np.uint8).reshape(-1, SIGNATURE)
            share = (x == y).mean(1)
            sized = np.array([100 * min(r[2], r[4]) >= percent * max(r[2], r[4]) for r in rows])
            return [(r[0], r[1], r[6], float(s)) for r, s, ok in zip(rows, share, sized & (share >= floor_of(percent)), strict=True) if ok]

        shares = map_rows(met.select("node", "id", "n", "sig", "pivot_n", "pivot_sig", "pivot"), lambda: work, [("node", "bigint"), ("id", "bigint"), ("pivot", "bigint"), ("share", "double")])
        best = shares.groupBy("node", "id").agg(F.max_by("pivot", F.struct("share", "pivot")).alias("pivot"))
        return best.select(F.least("id", "pivot").alias("a"), F.greatest("id", "pivot").alias("b"))

    def blocks(self, left: DataFrame, right: DataFrame) -> DataFrame:
        """Every left row (``node, id, n, sig, label, reach``) meets every right row of its node, in cells
        of two blocks of bounded size."""
        half = SMALL // 2
        sizes = left.groupBy("node").agg(F.ceil(F.count(F.lit(1)) / half).alias("l")).join(right.groupBy("node").agg(F.ceil(F.count(F.lit(1)) / half).alias("r")), "node")
        sizes = self.near(materialize(sizes, "near-blocks"))
        spot, each = F.xxhash64("id", F.lit(3)), lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), n - 1))
        left = left.join(sizes, "node").withColumns({"i": F.pmod(spot, F.col("l")), "j": each(F.col("r"))})
        right = right.join(sizes, "node").withColumns({"i": each(F.col("l")), "j": F.pmod(spot, F.col("r"))})
        cell = F.xxhash64("node", "i", "j").alias("node")
        return left.select(cell, "id", "n", "sig", "label", "reach", F.lit(0).alias("side")).union(right.select(cell, "id", "n", "sig", "label", "reach", F.lit(1).alias("side")))

    def cells(self, dense: DataFrame, main: DataFrame) -> DataFrame:
        """What is not in a node's largest component meets the whole node."""
        rows = self.with_sets(dense.join(self.near(main.select("node", "main")), "node")).withColumn("reach", F.lit((1 << 62)).cast("double"))
        return self.blocks(rows.where("label <> main"), rows)

    def full_sets(self, ids: DataFrame, kind: str) -> DataFrame:
        """``id, hi, set`` of every different text of the documents ``id``; ``kind`` is binary or array<bigint>."""
        k = self.k
        texts = self.docs.join(self.near(materialize(ids.select(F.col("id").alias("doc_id")).distinct(), "near-across")), "doc_id").dropDuplicates()

        def make():
            cached = TwoGenerations(word_hash)

            def work(rows):
                sets = ((i, shingle_hashes(tokens(t), k, cached.__getitem__)) for i, t in rows)
                return [(i, int(s.sum().view(np.int64)), s.tobytes() if kind == "binary" else s.view(np.int64).tolist()) for i, s in sets if len(s)]

            return work

        return materialize(map_rows(texts, make, [("id", "bigint"), ("hi", "bigint"), ("set", kind)]), "near-full")

    def crowded(self, dense: DataFrame, main: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The prefix filter over nodes with many documents outside their largest component ``main``:
        small nodes (``node, id, label``) of the documents that share a rare shingle among the first of
        theirs, and cells of documents whose sizes allow links without one.

        With threshold t a link needs ``t / (1 + t) * (n + m)`` common shingles. If the first one is not
        among the r rare ones of a document of n, the other has at most ``n / t - r * (1 + t) / t``: the
        document's ``reach``. Shingles of one document are the first in order and meet nothing: they are
        only counted (``lone``), not joined."""
        t = self.percent / 100
        rows = self.with_sets(dense.join(self.near(main.select("node", "main")), "node"))
        # rows with equal ids may be members twice, and two of their texts the same set
        members = materialize(rows.select("node", "id", "hi", "label", "main", "n").distinct(), "near-crowd")
        sets = self.full_sets(members, "array<bigint>").dropDuplicates(["id", "hi"])
        held = members.join(sets.select("id", "hi", F.explode("set").alias("token")), ["id", "hi"])
        rare = held.groupBy("node", "token").agg(F.count(F.lit(1)).alias("f"), F.min("id").alias("id"), F.min("hi").alias("hi")).where(F.col("f") <= RARE)
        alone = F.col("f") == 1
        rare = materialize(rare.select("node", "f", F.when(~alone, F.col("token")).alias("token"), F.when(alone, F.col("id")).alias("id"), F.when(alone, F.col("hi")).alias("hi")), "near-rare")
        own = ["node", "id", "hi"]
        lone = materialize(rare.where(alone).groupBy(*own).agg(F.count(F.lit(1)).alias("lone")), "near-lone")
        shared = held.join(rare.where(~alone).select("node", "token", "f"), ["node", "token"]).join(lone, own, "left")
        each = Window.partitionBy(*own)
        ranked = shared.withColumns({"rank": F.row_number().over(each.orderBy("f", "token")), "r": F.count(F.lit(1)).over(each)})
        ranked = ranked.withColumn("met", F.col("rank") + F.coalesce("lone", F.lit(0)) <= F.col("n") - F.ceil(F.col("n") * self.percent / 100) + 1)
        ranked = materialize(ranked.where("rank = 1 or met"), "near-ranked")
        shared = ranked.where("met").select(F.xxhash64("node", "token").alias("node"), "id", "label").distinct()

        counts = ranked.where("rank = 1").select(*own, "r")
        r = F.coalesce("r", F.lit(0)) + F.coalesce("lone", F.lit(0))
        reach = F.col("n") / t - r * (1 + t) / t + 1e-6
        able = members.join(counts, own, "left").join(lone, own, "left").withColumn("reach", reach).where(F.col("reach") >= t * F.col("n"))
        able = materialize(able.join(self.reps.select("id", "hi", "sig"), ["id", "hi"]), "near-able")
        band = lambda n: F.floor(F.log(n) / float(np.log(BAND)))
        larger = able.withColumn("band", F.explode(F.sequence(band(F.ceil(t * F.col("n") - 1e-6)), band(F.greatest(F.floor(F.least("reach", F.col("n").cast("double"))), F.lit(1))))))
        smaller = able.withColumn("band", band(F.col("n")))
        outside, shape = F.col("label") != F.col("main"), lambda df, kind: df.select(F.xxhash64("node", "band", F.lit(kind)).alias("node"), "id", "n", "sig", "label", "reach")
        first = self.blocks(shape(larger.where(outside), 0), shape(smaller, 0))
        return shared, first.union(self.blocks(shape(larger.where(~outside), 1), shape(smaller.where(outside), 1)))

    def links_across(self, rows: DataFrame) -> DataFrame:
        """True links across components among the rows (``node, id, n, sig, label``) of nodes or cells."""
        percent = self.percent
        found = materialize(by_node(rows, lambda c: involved(c, percent), ("node", "id", "label", "pair")), "near-involved")
        sets = self.full_sets(found.where("pair = 0"), "binary")
        links = by_node(found.where("pair = 0").join(sets, "id"), lambda c: true_links(c, percent))
        return links.union(found.where("pair = 1").select(F.col("node").alias("a"), F.col("id").alias("b")))

    def confirm(self, pairs: DataFrame) -> DataFrame:
        """``a, b, linked``: whether the full sets of shingles are similar enough."""
        pairs = materialize(pairs.distinct(), "near-pairs")
        ids = materialize(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "near-ids")
        texts = materialize(self.docs.join(self.near(ids), "doc_id").dropDuplicates(), "near-texts")
        both = pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("x")), "a").join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("y")), "b")
        k, percent = self.k, self.percent

        def make():
            last: dict = {}

            def shingles(i, text):
                if last.get("key") != (i, text):
                    last.update(key=(i, text), value=exact_set(tokens(text), k))
                return last["value"]

            def work(rows):
                out = []
                for a, b, x, y in rows:
                    one, two = shingles(b, y), exact_set(tokens(x), k)
                    common = len(one & two)
                    out.append((a, b, 100 * common >= percent * (len(one) + len(two) - common) and common > 0))
                return out

            return work

        return materialize(map_rows(both.select("a", "b", "x", "y"), make, [("a", "bigint"), ("b", "bigint"), ("linked", "boolean")]), "near-confirmed")

    def labels(self) -> DataFrame:
        """``id, label`` of all representatives that are linked with another one."""
        small, dense = self.nodes()
        percent = self.percent
        first = by_node(self.with_sets(small), lambda c: forest(c, percent))
        linked = self.confirm(first.union(self.pivot_pairs(dense))).where("linked")
        labels = components(linked)
        named = F.coalesce("label", F.col("id"))
        small, dense = (x.join(labels, "id", "left").select("node", "id", named.alias("label")) for x in (small, dense))
        open_nodes = small.groupBy("node").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("node")
        again = self.links_across(self.with_sets(small.join(open_nodes, "node")))
        counts = materialize(dense.groupBy("node", "label").count(), "near-dense")
        main = counts.groupBy("node").agg(F.max_by("label", F.struct("count", "label")).alias("main"), F.sum("count").alias("all"), F.max("count").alias("most")).where("`all` > most")
        main = materialize(main.withColumn("many", F.col("all") - F.col("most") > SMALL // 2), "near-main")
        if not main.isEmpty():
            again = again.union(self.links_across(self.cells(dense, main.where("not many"))))
        if not main.where("many").isEmpty():
            shared, sized = self.crowded(dense, main.where("many"))
            again = again.union(self.links_across(self.with_sets(shared))).union(self.links_across(sized))
        again = self.confirm(again).where("linked")
        return labels if again.isEmpty() else components(linked.union(again))


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, trees: int = 3, branch: int = 3, seed: int = 41) -> DataFrame:
    """Components of near-duplicate documents of ``docs`` (``doc_id, text``).

    Returns ``doc_id``, ``n_shingles``, ``component_id`` (the smallest id that is reached over links,
    itself included) and ``kept`` (``doc_id = component_id``). A text is the set of its
    ``words``-word shingles; with fewer words the whole sequence is one; null texts and texts
    without words are empty sets and linked with nothing. Links are pairs with ``100 * common >=
    percent * union``. Equal sets are linked and handled once. Rows with equal ids are one document
    that has the links of all its texts; rows with a null id are linked with nothing.
    """
    with scratch(docs.sparkSession) as keep:
        join = NearJoin(docs, words, percent, trees, branch, seed)
        keep(join.sets)
        labels = join.labels()
        same = join.same.join(labels, "id", "left").select("hi", "lo", F.col("n").alias("m"), F.coalesce("label", F.col("id")).alias("component"))
        same = keep(materialize(same.groupBy("hi", "lo", "m").agg(F.min("component").alias("component")), "near-components"))
    rows = join.sets.select("doc_id", "n", "hi", "lo")
    found = rows.join(same, (rows.hi == same.hi) & (rows.lo == same.lo) & (rows.n == same.m), "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", F.col("doc_id")))
    return found.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))
