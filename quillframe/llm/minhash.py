"""Near-duplicates by a chosen-path similarity join.

Documents descend trees: a node picks one or two coordinates of the min-wise signature, and a document goes to the child named by
its token there. Small nodes are compared exhaustively, independent trees are repeated to the target recall. Links are confirmed on
full shingle sets, and only a spanning forest of a job's links leaves it, so no group is expanded into pairs.

What a node still has to find are links between different components. Members of a large node meet the nearest of eight pivots, in
blocks that are compared exhaustively, and components are taken of all links so far. A node of one component is done. One with few
members outside its largest component compares these with all of the node, block by block, which is linear in the node; nodes with the
same largest component do so as one where they overlap. The others
branch on, with longer signatures. A pair at the threshold has more than one common child a node on average and members of lesser similarity fewer, so neither
does recall fall nor do rows grow with the depth.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillframe.llm.common import salted_left, small_batches, stored
from quillframe.llm.components import components

WORDS = 5
COORDINATES = 64
#: Coordinates at the roots of the trees. A pair of similarity 0.75 that no root keeps together has probability 0.25 ** 14.
ROOTS = 14
#: Members of a node that are compared exhaustively, and of a block of a larger one.
LIMIT = 256
#: Blocks of members outside the largest component that meet the rest of their node; beyond it a node branches.
CHUNKS = 4
#: Rows of a task from the second level on, where few are left.
TASK_ROWS = 4000
#: Coordinates of the signatures that are compared in large nodes.
WIDE = 256
#: Share of matching coordinates from which a pair is looked at, by their number: similarity 0.75 falls below with probability 4e-6.
NEAR = {COORDINATES: 0.5, WIDE: 0.625}
#: Pivots of a large node.
PIVOTS = 8
#: Nodes that are large and mixed at this level are compared in full, block by block. Their members agree in more coordinates than
#: sets can that are not linked, so it is no more than a guard; a smaller number serves tests.
DEEPEST = 40
#: Rows of jobs up to this many are broadcast to choose texts (24 bytes each).
BROADCAST_JOBS = 1_000_000

_rng = np.random.default_rng(20)
_MIX = (_rng.integers(1, 1 << 63, WORDS, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_MULTIPLY = (_rng.integers(1, 1 << 63, WIDE, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_ADD = _rng.integers(0, 1 << 63, WIDE, dtype=np.uint64)


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of the 5-word shingles; of the whole sequence where there are fewer words; empty without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # on bytes: A-Z alone are lowered, white space is 20 and 09 to 0D
    if not words:
        return np.zeros(0, np.uint64)
    known = {w: xxhash.xxh64_intdigest(w) for w in set(words)}
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    if len(words) < WORDS:
        h = np.concatenate([h, np.full(WORDS - len(words), np.uint64(len(words)))])
    n = len(h) - WORDS + 1
    s = h[:n] * _MIX[0]
    for k in range(1, WORDS):
        s ^= s >> np.uint64(29)
        s = s * _MIX[k] + h[k : k + n]
    s ^= s >> np.uint64(32)
    s *= np.uint64(0xD6E8FEB86659FD93)
    s ^= s >> np.uint64(32)
    return np.unique(s)


def signature(s: np.ndarray, width: int = COORDINATES) -> np.ndarray:
    """The min-wise tokens, one a coordinate."""
    out = np.full(width, np.uint64(0xFFFFFFFFFFFFFFFF))
    for at in range(0, len(s), 2048):
        np.minimum(out, (s[at : at + 2048, None] * _MULTIPLY[:width] + _ADD[:width]).min(axis=0), out=out)
    return (out >> np.uint64(32)).astype(np.uint32)


def brief(tokens: np.ndarray) -> bytes:
    return (tokens & np.uint32(255)).astype(np.uint8).tobytes()


def fingerprint(s: np.ndarray) -> tuple[int, int]:
    f = np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), np.int64)
    return int(f[0]), int(f[1])


def _order(s: np.ndarray) -> tuple[int, int, int]:
    """By which the least of several sets under one doc_id is chosen."""
    return (len(s), *fingerprint(s))


def _sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = []
        for text in b["text"]:
            s = shingles(text)
            t = signature(s)
            rows.append((len(s), *fingerprint(s), t.view(np.int32), brief(t)))
        out = pd.DataFrame(rows, columns=["n_shingles", "f1", "f2", "tokens", "brief"])
        out.insert(0, "doc_id", b["doc_id"].array)
        yield out


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, f1, f2 (fingerprint of the set), tokens (signature), brief (a byte of each token)."""
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(_sketch, "doc_id long, n_shingles long, f1 long, f2 long, tokens array<int>, brief binary")


# --- comparing ------------------------------------------------------------------------------------------------------------------


class Union:
    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        if x == y:
            return False
        self.up[max(x, y)] = min(x, y)
        return True


def _matrix(briefs) -> np.ndarray:
    return np.frombuffer(b"".join(map(bytes, briefs)), np.uint8).reshape(len(briefs), -1)


def _candidates(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """From nodes (ids, briefs, labels) the jobs (job, id, label): groups that near signatures under different labels hold together."""
    for b in batches:
        jobs, out, under = [], [], []
        for ids, briefs, labels in zip(b["ids"], b["briefs"], b["labels"], strict=True):
            ids, first = np.unique(ids, return_index=True)
            if len(ids) < 2:
                continue
            m, label = _matrix([briefs[k] for k in first]), labels[first]
            least = NEAR[m.shape[1]] * m.shape[1]
            u = Union(len(ids))
            for k in range(len(ids) - 1):
                for j in np.flatnonzero(((m[k + 1 :] == m[k]).sum(axis=1) >= least) & (label[k + 1 :] != label[k])).tolist():
                    u.join(k, k + 1 + j)
            groups: dict[int, list[int]] = {}
            for k in range(len(ids)):
                groups.setdefault(u.find(k), []).append(k)
            for g in groups.values():
                if len(g) > 1:
                    jobs += [xxhash.xxh64_intdigest(ids[g].tobytes())] * len(g)
                    out += ids[g].tolist()
                    under += label[g].tolist()
        yield pd.DataFrame({"job": np.array(jobs, np.uint64).view(np.int64), "id": np.array(out, np.int64), "label": np.array(under, np.int64)})


def _nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """From members (path, id, brief, label, and the pivots' ids, briefs, labels) rows (pivot, pivot_label, id, label): the nearest pivot under another label."""
    for b in batches:
        found = [np.zeros((0, 4), np.int64)]
        for _, rows in b.groupby("path"):
            pivots, theirs, own, label = rows["ids"].iloc[0], rows["labels"].iloc[0], rows["id"].to_numpy(), rows["label"].to_numpy()
            m, p = _matrix(rows["brief"].tolist()), _matrix(rows["briefs"].iloc[0])
            same = np.stack([(m == x).sum(axis=1) for x in p], axis=1)
            same[theirs[None, :] == label[:, None]] = -1  # its own label is a pivot's own, too
            best = same.argmax(axis=1)
            near = same[np.arange(len(own)), best] >= NEAR[m.shape[1]] * m.shape[1]
            found.append(np.stack([pivots[best[near]], theirs[best[near]], own[near], label[near]], axis=1))
        yield pd.DataFrame(np.concatenate(found), columns=["pivot", "pivot_label", "id", "label"])


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs of sorted sets, by products of 0-1 matrices over runs of their common members."""
    both = np.zeros((len(sets), len(sets)), np.float64)
    _, at, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    common = np.cumsum(n > 1) - 1  # column of each member that two sets have
    held = n[at] > 1
    row, column = row[held], common[at[held]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    for first in range(0, int(common[-1]) + 1, 4096):
        lo, hi = np.searchsorted(column, (first, first + 4096))
        m = np.zeros((len(sets), 4096), np.float32)
        m[row[lo:hi], column[lo:hi] - first] = 1
        both += m @ m.T
    return both.astype(np.int64)


def _confirm(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """From rows (job, id, label, text), sorted by job, links that span what each job's links connect beyond the labels."""
    out: list[tuple[int, int]] = []

    def settle(held: dict[int, np.ndarray], labels: dict[int, int]):
        ids = sorted(held)
        u, first = Union(len(ids)), {}
        for k, i in enumerate(ids):
            u.join(first.setdefault(labels[i], k), k)
        n = np.array([len(held[i]) for i in ids])
        both = overlaps([held[i] for i in ids])
        either = n[:, None] + n - both
        for x, y in np.argwhere(np.triu(100 * both >= 75 * either, 1)).tolist():
            if u.join(x, y):
                out.append((ids[x], ids[y]))

    job, held, labels = None, {}, {}
    for batch in batches:
        for j, i, label, text in zip(batch["job"].tolist(), batch["id"].tolist(), batch["label"].tolist(), batch["text"], strict=True):
            if j != job:
                if len(held) > 1:
                    settle(held, labels)
                job, held, labels = j, {}, {}
            s, labels[i] = shingles(text), label
            if i not in held or _order(s) < _order(held[i]):
                held[i] = s
        if len(out) > 10_000:
            yield pd.DataFrame(out, columns=["a", "b"])
            out.clear()
    if len(held) > 1:
        settle(held, labels)
    yield pd.DataFrame(out, columns=["a", "b"])


def confirmed(jobs: DataFrame, texts: DataFrame, tasks: int) -> DataFrame:
    """a, b of the links that full sets confirm. jobs: job, id, label; a job's rows go to one task and are few. texts: id, text."""
    jobs = stored(jobs.distinct().coalesce(tasks), "minhash-jobs")  # 24 bytes a row, broadcast up to BROADCAST_JOBS
    few = jobs.count() <= BROADCAST_JOBS
    # only texts that are in a job are shuffled, once
    rows = texts.join(F.broadcast(jobs) if few else jobs, "id").select("job", "id", "label", "text").repartition(_tasks(texts), "job").sortWithinPartitions("job")
    return stored(rows.mapInPandas(_confirm, "a long, b long"), "minhash-links")


# --- trees ----------------------------------------------------------------------------------------------------------------------


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _tasks(df: DataFrame) -> int:
    """Tasks of work in Python, whose rows are small and dear: Spark would put too many of them together by their bytes."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _members(rows: DataFrame) -> DataFrame:
    """path, ids, briefs, labels of rows (path, id, brief, label)."""
    nodes = rows.repartition(_tasks(rows), "path").groupBy("path").agg(F.collect_list(F.struct("id", "brief", "label")).alias("m"))
    return nodes.select("path", F.col("m.id").alias("ids"), F.col("m.brief").alias("briefs"), F.col("m.label").alias("labels"))


def _jobs(rows: DataFrame, held: DataFrame, tasks: int) -> DataFrame:
    """Jobs of nodes given as rows (path, id)."""
    nodes = _members(rows.join(held.select("id", "brief", "label"), "id").coalesce(tasks)).filter(F.size("ids") > 1)
    return nodes.select("ids", "briefs", "labels").coalesce(tasks).mapInPandas(_candidates, "job long, id long, label long")


def _stars(large: DataFrame, held: DataFrame, limit: int, level: int, tasks: int) -> DataFrame:
    """Jobs of the members of large nodes (path, id): blocks of those that are nearest to the same pivot, each with it."""
    bucket = F.pmod(F.xxhash64("id", F.lit(level)), F.lit(PIVOTS))
    chosen = large.groupBy("path").agg(F.array_compact(F.array(*[F.min(F.when(bucket == b, F.col("id"))) for b in range(PIVOTS)])).alias("p")).coalesce(tasks)
    members = held.select("id", "brief", "label")
    pivots = _members(chosen.select("path", F.explode("p").alias("id")).join(members, "id").coalesce(tasks)).coalesce(tasks)
    near = large.join(members, "id").coalesce(tasks).join(pivots, "path").coalesce(tasks).repartition(_tasks(large), "path", F.pmod(F.xxhash64("id"), F.lit(32))).coalesce(tasks)
    near = stored(near.mapInPandas(_nearest, "pivot long, pivot_label long, id long, label long").distinct().coalesce(tasks), "minhash-near")
    blocks = near.groupBy("pivot").agg(F.first("pivot_label").alias("label"), F.ceil(F.count("*") / (limit // 2)).cast("int").alias("blocks")).coalesce(tasks)
    dealt = salted_left(near, blocks.select("pivot", "blocks"), "pivot", F.col("id")).coalesce(tasks)
    dealt = dealt.select("pivot", "id", "label", F.pmod(F.xxhash64("id", F.lit(4)), F.col("blocks")).cast("int").alias("block"))
    own = blocks.select("pivot", F.col("pivot").alias("id"), "label", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    return dealt.unionByName(own).select(F.xxhash64("pivot", "block", F.lit(2)).alias("job"), "id", "label")


def _sharpen(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        sets = [shingles(t) for t in b["text"]]
        yield pd.DataFrame({"id": b["id"], "f1": [fingerprint(s)[0] for s in sets], "brief": [brief(signature(s, WIDE)) for s in sets]})


def _pooled(state: DataFrame, nodes: DataFrame, size: int, tasks: int) -> tuple[DataFrame, DataFrame]:
    """state (path, id, label) and nodes (path, top, n, most) with nodes of one top label put together where that makes fewer rows.

    Roots hold much the same members of a large group, and each would compare these again. A pool holds all members of its nodes, so
    whatever meets in one of them meets in the pool.
    """
    state, nodes = state.select("path", "id", "label"), nodes.select("path", "top", "n", "most")
    outside = F.col("n") - F.col("most")
    made = outside * F.ceil(F.col("n") / size) + F.col("n") * F.ceil(outside / size)
    apart = nodes.groupBy("top").agg(F.sum(made).alias("apart"), F.count("*").alias("nodes")).filter("nodes > 1").coalesce(tasks)
    under = state.join(nodes.select("path", "top"), "path").coalesce(tasks).join(apart.select("top"), "top", "left_semi").select("top", "id", "label").distinct()
    under = stored(under.coalesce(tasks), "minhash-under")
    pools = under.groupBy("top").agg(F.count("*").alias("n"), F.count_if(F.col("label") == F.col("top")).alias("most")).coalesce(tasks).join(apart, "top")
    pools = stored(pools.filter(made <= F.col("apart")).select(F.xxhash64("top", F.lit(7)).alias("path"), "top", "n", "most").coalesce(tasks), "minhash-pools")
    state = state.unionByName(under.join(pools.select("path", "top"), "top").coalesce(tasks).select("path", "id", "label"))
    return state, nodes.join(pools.select("top"), "top", "left_anti").unionByName(pools)


def _cells(state: DataFrame, nodes: DataFrame, size: int, tasks: int) -> DataFrame:
    """Rows (path, id) that bring together, in each node (path, top, n, most), what isn't labelled top and all of the node, in blocks."""
    state, nodes = _pooled(state, nodes, size, tasks)
    pick = lambda seed, n: F.pmod(F.xxhash64("id", F.lit(seed)), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    dealt = state.join(nodes.withColumns({"chunks": F.ceil((F.col("n") - F.col("most")) / size).cast("int"), "blocks": F.ceil(F.col("n") / size).cast("int")}), "path").coalesce(tasks)
    other = F.col("label") != F.col("top")
    outside = dealt.filter(other).select("path", "id", pick(5, "chunks").alias("chunk"), each("blocks").alias("block"))
    inside = dealt.filter(~other | (F.col("chunks") > 1)).select("path", "id", pick(6, "blocks").alias("block"), each("chunks").alias("chunk"))
    return outside.unionByName(inside).select(F.xxhash64("path", "chunk", "block").alias("path"), "id")


def _children(rows: DataFrame, held: DataFrame, roots: int, tasks: int) -> DataFrame:
    """Rows (path, id) of the children: every node has one coordinate, every second one two."""
    choice = lambda k: F.pmod(F.xxhash64("path", F.lit(10 + k)), F.lit(COORDINATES - roots)).cast("int") + roots
    child = lambda k: F.xxhash64("path", choice(k), F.element_at("tokens", choice(k) + 1))
    second = F.when((F.pmod(F.xxhash64("path", F.lit(9)), F.lit(2)) == 0) & (choice(1) != choice(0)), child(1))
    return rows.join(held.select("id", "tokens"), "id").coalesce(tasks).select("id", F.explode(F.array_compact(F.array(child(0), second))).alias("path"))


def links(nodes: DataFrame, texts: DataFrame, limit: int = LIMIT, roots: int = ROOTS, deepest: int = DEEPEST) -> DataFrame:
    """Confirmed links (a, b) that connect what is linked. nodes: id, f1, tokens, brief of distinct sets; texts: id, text."""
    held = nodes.withColumn("label", F.col("id"))
    rows = nodes.select("id", F.explode(F.array(*[F.xxhash64(F.lit(c), F.element_at("tokens", c + 1)) for c in range(roots)])).alias("path"))
    pending: list[DataFrame] = []
    found: list[DataFrame] = []
    level, tasks = 1, _tasks(nodes)  # a table of few rows takes few tasks
    while True:
        sizes = stored(rows.groupBy("path").agg(F.count("*").alias("n")).filter("n > 1").coalesce(tasks), "minhash-sizes")
        pending.append(_jobs(rows.join(sizes.filter(F.col("n") <= limit).select("path"), "path").coalesce(tasks), held, tasks))
        in_large = sizes.filter(F.col("n") > limit).agg(F.sum("n")).first()[0] or 0
        if in_large:
            large = stored(rows.join(sizes.filter(F.col("n") > limit).select("path"), "path").select("path", "id").coalesce(tasks), "minhash-large")
            tasks = 6 + in_large // TASK_ROWS
            pending.append(_stars(large, held, limit, level, tasks))
        found.append(confirmed(_union(pending), texts, max(tasks, 6)))
        if not in_large:
            return _union(found)
        if level == 1 or not found[-1].isEmpty():
            labels = components(_union(found))
        ids = large.select("id").distinct().coalesce(tasks)
        if level == 1:  # from here on only texts of large nodes are read
            ids = stored(ids, "minhash-ids")
            few = ids.count() <= BROADCAST_JOBS
            texts = stored(texts.join(F.broadcast(ids) if few else ids, "id", "left_semi"), "minhash-texts")
            wide = texts.mapInPandas(_sharpen, "id long, f1 long, brief binary").dropDuplicates(["id", "f1"]).coalesce(tasks)
            held = held.drop("brief").join(wide, ["id", "f1"]).coalesce(tasks)
        held = held.drop("label").join(ids, "id", "left_semi").coalesce(tasks).join(labels.select(F.col("node").alias("id"), "component"), "id", "left")
        held = stored(held.select("id", "f1", "tokens", "brief", F.coalesce("component", "id").alias("label")).coalesce(tasks), "minhash-held")
        state = stored(large.join(held.select("id", "label"), "id").coalesce(tasks), "minhash-state")
        counts = state.groupBy("path", "label").agg(F.count("*").alias("m")).coalesce(tasks)
        mixed = counts.groupBy("path").agg(F.max_by("label", F.struct("m", "label")).alias("top"), F.max("m").alias("most"), F.sum("m").alias("n"))
        mixed = stored(mixed.filter("most < n").coalesce(tasks), "minhash-mixed")
        ready = (F.col("n") - F.col("most") <= CHUNKS * limit) | F.lit(level >= deepest)
        pending = [_jobs(_cells(state, mixed.filter(ready), limit, tasks), held, tasks)]
        rows = state.join(mixed.filter(~ready).select("path"), "path").select("path", "id").coalesce(tasks)
        rows = stored(_children(rows, held, roots, tasks), "minhash-rows")
        level += 1


def near_duplicates(docs: DataFrame, limit: int = LIMIT, deepest: int = DEEPEST) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of each row of `docs` (doc_id, text): near-duplicates at Jaccard 0.75 of 5-word shingles.

    Equal sets are one class from the start, so copies never meet in pairs. component_id is the smallest doc_id that links reach. Null
    and empty texts are linked with nothing. Rows of one doc_id are one document: they share a component, and where they hold different
    texts one of the texts is compared. Rows with a null doc_id are linked with nothing and kept, with a null component_id. An empty
    table gives no rows; other columns are not read.
    """
    sketched = stored(sketches(docs), "minhash-sketches")
    usable = sketched.filter("n_shingles > 0 and doc_id is not null")
    classes = stored(usable.groupBy("f1", "f2").agg(F.min("doc_id").alias("first"), F.count("*").alias("n"), F.first("n_shingles").alias("n_shingles")), "minhash-classes")
    # of classes that begin with the same doc_id (one id, several texts) the least set stands for the document
    own = classes.groupBy(F.col("first").alias("doc_id")).agg(F.min(F.struct("n_shingles", "f1", "f2")).alias("_s")).select("doc_id", "_s.f1", "_s.f2")
    mine = usable.join(own, ["f1", "f2", "doc_id"])
    nodes = stored(mine.select(F.col("doc_id").alias("id"), "f1", "tokens", "brief").dropDuplicates(["id"]), "minhash-nodes")
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    labels = components(links(nodes, texts, limit, deepest=deepest))
    linked = classes.join(labels, classes["first"] == labels["node"], "left").select("f1", "f2", F.coalesce("component", "first").alias("_component"), "n", "first")
    # only classes of several rows or in larger components say more than a row knows of itself
    linked = linked.filter((F.col("n") > 1) | (F.col("_component") != F.col("first")))
    linked = linked.select(F.struct("f1", "f2").alias("_key"), "_component")
    rows = sketched.select("doc_id", "n_shingles", F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.struct("f1", "f2")).alias("_key"))
    rows = salted_left(rows, linked, "_key", F.xxhash64("doc_id"))
    component = F.coalesce("_component", "doc_id")
    return rows.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))
