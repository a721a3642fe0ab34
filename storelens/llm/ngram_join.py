"""Exact n-gram Jaccard join with signature trees (operator 8).

Two documents link when their sets of five-word shingles have a Jaccard
similarity of at least t. The result is complete: every step that skips a pair
has a bound that proves it cannot link, or that both are in one component
already.

1. Documents with equal sets become one set (``sid``).
2. Prefix index: tokens are ordered by how often they repeat (rare first); two
   sets with an overlap of o share at least l of their first |set| - o + l
   tokens. Only tokens that several sets have stay. A set that has s of them in
   its prefix of p tokens overlaps any other in at most s + |set| - p tokens,
   which rules out most sets at once. Two sets that must share c prefix tokens
   are paired only at tokens that both have c of from there on: their first
   common token is one.
3. Sets left that share one of three MinHash values are compared with the set of
   that value that has the fewest tokens of its own: cheap links that join groups
   of near copies early.
4. Signature trees: the sets of one component are the leaves of nodes of some
   ``NODE`` sets that hold the OR of their token bitmaps and their range of
   sizes. Node pairs of different components that share enough prefix tokens are
   traversed together, if their shared prefix tokens and what lies behind the
   prefixes can make up the overlap: first the node summaries alone, and, where the largest
   possible overlap is enough, the halves and finally the sets. A node pair ends
   at its first link, as both sides are connected in themselves.
5. Connected components of all links.

Scale: a group of near copies is one component after step 3, so later steps see
its nodes, not its pairs; tokens of a common passage come last in the order and
so into few prefixes. Document texts are never shuffled; token sets are, and only
those of sets that take part in a comparison. The order of tokens comes from the
counts of tokens that repeat inside a task, summed over all tasks, in a table of
fixed size; it affects cost, not results. Broadcast are that table (1 MB) and bit
filters of at most ``FILTER_BITS``.

Defined results: null and empty texts, and texts without words, have no shingles
and are their own component; with fewer than n words the whole sequence is one
shingle; repeated rows are one set; a null doc_id takes part in links and gets
the smallest non-null id of its component, null if there is none; extra columns
are not carried over.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from storelens.llm.common import checkpointed, table
from storelens.llm.graph import components
from storelens.llm.textops import U, group_shingles, mix, text_groups

LEVEL_BITS = 20             #: buckets of the table of token frequencies: 2^20
NODE = 128                  #: sets of a tree node, about
FILTER_BITS = 1 << 27
SLACK = 32                  #: prefixes are longer by 1/32 of the set, so that pairs must share more than one token
PACK = 6                    #: bytes of a token in a shipped set

_SEEDS = (U(0x243F6A8885A308D3), U(0x13198A2E03707344), U(0xA4093822299F31D0))


def set_ids(sets: list[np.ndarray]) -> np.ndarray:
    """64-bit ids of non-empty sets, the same for equal sets."""
    size = np.array([len(s) for s in sets])
    total = np.add.reduceat(mix(np.concatenate(sets)), np.concatenate(([0], np.cumsum(size)[:-1])))
    return mix(total + size.astype(U)).view(np.int64)


def prefix(size: int | np.ndarray, pct: int) -> np.ndarray:
    """Length of the prefix of a set of this size."""
    return np.minimum(np.asarray(size), np.asarray(size) - needed(size, pct) + shared_least(size))


def overlap_needed(size_a, size_b, pct: int):
    """The least overlap with which sets of these sizes link."""
    return -(-pct * (np.asarray(size_a) + size_b) // (100 + pct))


def needed(size: int | np.ndarray, pct: int) -> np.ndarray:
    """The least overlap of a set of this size in any link: ceil(pct% of it)."""
    return -(-(np.asarray(size) * pct) // 100)


def shared_least(size: int | np.ndarray) -> np.ndarray:
    """l: how many prefix tokens a link of this set must share at least."""
    return 1 + np.asarray(size) // SLACK


def links(overlap, size_a, size_b, pct: int):
    """100 * intersection >= pct * union, in whole numbers."""
    return 100 * overlap >= pct * (size_a + size_b - overlap)


def _describe(docs: DataFrame, words: int) -> DataFrame:
    """Rows of kind 0: a document's size, set id and MinHash values; of kind 1: a token that repeats in a task's sets."""
    names = ["kind", "doc_id", "n", "sid", "m1", "m2", "m3", "token", "times"]

    def run(batches):
        held, size, known = [], 0, set()

        def repeats():
            key, n = np.unique(np.concatenate(held), return_counts=True)
            key, n = key[n > 1].view(np.int64), n[n > 1]
            return pa.RecordBatch.from_arrays([pa.array(np.ones(len(key), np.int32)), *[pa.nulls(len(key), pa.int64())] * 6,
                                               pa.array(key), pa.array(n.astype(np.int64))], names)

        for b in batches:
            ids = b.column(0)
            for first, texts in text_groups(b.column(1)):
                sets = group_shingles(texts, words)
                n = np.array([len(s) for s in sets])
                some = np.flatnonzero(n)
                cols = np.zeros((4, len(n)), np.int64)
                if len(some):
                    full = [sets[k] for k in some]
                    start = np.concatenate(([0], np.cumsum(n[some])[:-1]))
                    every = np.concatenate(full)
                    cols[0, some] = set_ids(full)
                    for j, seed in enumerate(_SEEDS):
                        cols[j + 1, some] = np.minimum.reduceat(mix(every ^ seed), start).view(np.int64)
                    for sid, s in zip(cols[0, some].tolist(), full):
                        if sid not in known:
                            known.add(sid)
                            held.append(s)
                            size += len(s)
                none = pa.nulls(len(n), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.zeros(len(n), np.int32)), ids.slice(first, len(n)), pa.array(n),
                     *[pa.array(c, mask=n == 0) for c in cols], none, none], names)
                if size > 1 << 21:
                    yield repeats()
                    held, size = [], 0
        if held:
            yield repeats()

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(
        run, "kind int, doc_id long, n long, sid long, m1 long, m2 long, m3 long, token long, times long")


def _frequency_levels(repeats: DataFrame) -> np.ndarray:
    """Level (log2 of the count, 0: rare) per bucket of tokens: a table of 2^LEVEL_BITS bytes."""
    bucket = F.shiftrightunsigned("token", 64 - LEVEL_BITS).cast("int")
    rows = (repeats.groupBy("token").agg(F.sum("times").alias("n")).where("n >= 4")
            .groupBy(bucket.alias("b")).agg(F.max(F.floor(F.log2("n"))).cast("int").alias("level")).toArrow())
    out = np.zeros(1 << LEVEL_BITS, np.uint8)
    out[rows["b"].to_numpy()] = rows["level"].to_numpy()
    return out


def _index(docs: DataFrame, levels: np.ndarray, words: int, pct: int) -> DataFrame:
    """(token, sid, n, pos): prefix tokens that at least two sets have, and their places in the order of the set."""
    shared = docs.sparkSession.sparkContext.broadcast(levels)

    def prefixes(batches):
        known = set()
        for b in batches:
            for _, texts in text_groups(b.column(0)):
                sets = [s for s in group_shingles(texts, words) if len(s)]
                if not sets:
                    continue
                tokens, sids, at_size = [], [], []
                level = shared.value[(np.concatenate(sets) >> U(64 - LEVEL_BITS)).astype(np.int64)]
                at = 0
                for s, sid in zip(sets, set_ids(sets).tolist()):
                    own, at = level[at:at + len(s)], at + len(s)
                    if sid in known:
                        continue
                    known.add(sid)
                    p = int(prefix(len(s), pct))
                    # s is sorted: equal levels stay in token order
                    tokens.append(s[np.argsort(own, kind="stable")[:p]] if own[:p].any() else s[:p])
                    sids.append(np.full(p, sid, np.int64))
                    at_size.append(np.arange(p) + (len(s) << 32))  # place and size in one number
                if tokens:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array((np.concatenate(tokens) >> U(16)).view(np.int64)), pa.array(np.concatenate(sids)),
                         pa.array(np.concatenate(at_size))], ["token", "sid", "np"])

    rows = docs.select("text").mapInArrow(prefixes, "token long, sid long, np long")
    rows = _runs(rows, ["token", "sid", "np"], "sid", "token long, sid long, np long", _shared_rows)
    return rows.select("token", "sid", F.shiftright("np", 32).alias("n"), F.col("np").bitwiseAND(F.lit(0xFFFFFFFF)).alias("pos"))


def _runs(rows: DataFrame, cols: list[str], member: str, schema: str, fn) -> DataFrame:
    """``fn`` over whole runs of equal tokens, distinct by ``member``: rows are sorted, nothing is grouped in memory."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches):
        rest = None
        for b in batches:
            c = [b.column(k).to_numpy() for k in range(len(cols))]
            c = c if rest is None else [np.concatenate(x) for x in zip(rest, c)]
            if not len(c[0]):
                continue
            cut = int(np.searchsorted(c[0], c[0][-1]))  # the last run may go on
            rest = [x[cut:] for x in c]
            if cut:
                yield from fn([x[:cut] for x in c])
        if rest is not None and len(rest[0]):
            yield from fn(rest)

    return rows.repartition(n, "token").sortWithinPartitions("token", member).select(*cols).mapInArrow(run, schema)


def _shared_rows(c: list[np.ndarray]):
    token, sid, place = c
    new = np.ones(len(token), bool)
    new[1:] = (token[1:] != token[:-1]) | (sid[1:] != sid[:-1])
    token, sid, place = token[new], sid[new], place[new]
    same = token[1:] == token[:-1]
    keep = np.concatenate(([False], same)) | np.concatenate((same, [False]))
    if keep.any():
        yield pa.RecordBatch.from_arrays([pa.array(token[keep]), pa.array(sid[keep]), pa.array(place[keep])], ["token", "sid", "np"])


def prefix_shared(low_a, low_b, rest_a, rest_b, pct: int):
    """How many prefix tokens two nodes of these smallest sizes must share to link, ``rest`` being behind the prefixes."""
    least = np.minimum(shared_least(low_a), shared_least(low_b))
    return np.maximum(least, overlap_needed(low_a, low_b, pct) - np.maximum(rest_a, rest_b))


def _node_pairs(pct: int):
    """A function over runs: pairs of nodes of different components that share a token and may still link.

    Rows: token, node, root, and of a member its size, the tokens behind its
    prefix and how many shared tokens its prefix has from this one on.
    """
    def fn(c: list[np.ndarray]):
        token, node, root, n, rest, ahead = c
        at = np.flatnonzero(np.concatenate(([True], (token[1:] != token[:-1]) | (node[1:] != node[:-1]))))
        low, high, rest, ahead = (f.reduceat(x, at) for f, x in ((np.minimum, n), (np.maximum, n), (np.maximum, rest), (np.maximum, ahead)))
        token, node, root = token[at], node[at], root[at]
        edge = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1], [True])))
        out, held = [], 0
        for s, e in zip(edge[:-1], edge[1:]):
            if e - s < 2 or (root[s:e] == root[s]).all():
                continue
            for i in range(s, e - 1):  # a node with those after it: node ids ascend in a run
                j = slice(i + 1, e)
                ok = ((root[j] != root[i]) & (100 * high[j] >= pct * low[i]) & (100 * high[i] >= pct * low[j])
                      & (np.minimum(ahead[j], ahead[i]) >= prefix_shared(low[j], low[i], rest[j], rest[i], pct)))
                if ok.any():
                    other = node[j][ok]
                    out.append((np.full(len(other), node[i]), other))
                    held += len(other)
            if held > 1_000_000:
                yield _pair_batch(out)
                out, held = [], 0
        if out:
            yield _pair_batch(out)
    return fn


def _pair_batch(out: list) -> pa.RecordBatch:
    """Distinct pairs."""
    pairs = np.unique(np.stack([np.concatenate([x[k] for x in out]) for k in (0, 1)]), axis=1)
    return pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["a", "b"])


def _enough_shared(pairs: DataFrame, lists: DataFrame, pct: int) -> DataFrame:
    """The (a, b) node pairs that share as many prefix tokens as a link of theirs must.

    lists: (node, low, high, rest, tokens), tokens being the shared prefix tokens of the node's sets.
    """
    def run(batches):
        for b in batches:
            c = {k: b.column(k) for k in range(2, 8)}
            low, high, rest = ([c[k].to_numpy() for k in ks] for ks in ((2, 3), (4, 5), (6, 7)))
            must = prefix_shared(*low, *rest, pct)
            size = (100 * high[0] >= pct * low[1]) & (100 * high[1] >= pct * low[0])
            keep = [ok and len(np.intersect1d(x.values.to_numpy(), y.values.to_numpy(), assume_unique=True)) >= m
                    for ok, x, y, m in zip(size.tolist(), b.column(8), b.column(9), must.tolist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    cols = ["low", "high", "rest", "tokens"]
    a = lists.select(F.col("node").alias("a"), *[F.col(c).alias(f"{c}_a") for c in cols])
    b = lists.select(F.col("node").alias("b"), *[F.col(c).alias(f"{c}_b") for c in cols])
    rows = pairs.join(a, "a").join(b, "b").select("a", "b", *[f"{c}_{s}" for c in cols for s in "ab"])
    return rows.mapInArrow(run, "a long, b long")


def _bit_filter(keys: DataFrame) -> np.ndarray:
    """Bitmap over hashes of column ``sid``: no false negatives, some false positives; bounded by FILTER_BITS."""
    count = keys.count()
    bits = 1 << min(FILTER_BITS.bit_length() - 1, max(16, (16 * count).bit_length()))
    step = 1 << 16
    at = F.pmod(F.col("sid"), F.lit(bits))

    def build(batches):
        now, held = None, None
        for b in batches:
            place = b.column(0).to_numpy()
            for s in np.unique(place >> 16):
                if s != now:
                    if now is not None:
                        yield pa.RecordBatch.from_arrays([pa.array([now]), pa.array([np.packbits(held, bitorder="little").tobytes()])], ["s", "b"])
                    now, held = int(s), np.zeros(step, np.uint8)
                held[place[place >> 16 == s] & (step - 1)] = 1
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now]), pa.array([np.packbits(held, bitorder="little").tobytes()])], ["s", "b"])

    n = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = (keys.select(at.alias("at")).repartitionByRange(n, F.shiftright("at", 16)).sortWithinPartitions("at")
            .mapInArrow(build, "s long, b binary").collect())  # bits / 8 bytes at most
    out = np.zeros(bits // 8, np.uint8)
    for r in rows:
        out[r.s * step // 8:(r.s + 1) * step // 8] = np.frombuffer(r.b, np.uint8)
    return out


def _token_sets(docs: DataFrame, keys: DataFrame, words: int) -> DataFrame:
    """(sid, n, tokens): packed sorted tokens of the sets named in ``keys``, made again from the texts."""
    shared = docs.sparkSession.sparkContext.broadcast(_bit_filter(keys))

    def run(batches):
        bits, known = shared.value, set()
        for b in batches:
            for _, texts in text_groups(b.column(0)):
                got = []
                sets = [s for s in group_shingles(texts, words) if len(s)]
                for s, sid in zip(sets, set_ids(sets).tolist() if sets else []):
                    at = sid % (8 * len(bits))
                    if sid in known or not bits[at >> 3] >> (at & 7) & 1:
                        continue
                    known.add(sid)
                    got.append((sid, len(s), _pack(s)))
                if got:
                    yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], pa.int64()),
                                                      pa.array([g[1] for g in got], pa.int64()),
                                                      pa.array([g[2] for g in got], pa.binary())], ["sid", "n", "tokens"])

    rows = docs.select("text").mapInArrow(run, "sid long, n long, tokens binary")
    return rows.join(keys.select("sid").distinct(), "sid", "left_semi").dropDuplicates(["sid"])


def _pack(tokens: np.ndarray) -> bytes:
    """The upper 48 bits of every token; sorted as the tokens are."""
    return np.ascontiguousarray(tokens.astype(">u8").view(np.uint8).reshape(-1, 8)[:, :PACK]).tobytes()


def _unpack(raw: bytes | pa.Buffer) -> np.ndarray:
    flat = np.frombuffer(raw, np.uint8)
    out = np.zeros((len(flat) // PACK, 8), np.uint8)
    out[:, :PACK] = flat.reshape(-1, PACK)
    return out.view(">u8").ravel().astype(U)


def _rows(batch: pa.RecordBatch):
    """The rows of a batch as dicts, one at a time: wide rows are not held twice."""
    for k in range(batch.num_rows):
        yield batch.slice(k, 1).to_pylist()[0]


def _overlap(a: np.ndarray, b: np.ndarray) -> int:
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    return int((b[at] == a).sum())


def _verify(pairs: DataFrame, sets: DataFrame, pct: int) -> DataFrame:
    """The (a, b) pairs of set ids that link."""
    def run(batches):
        for b in batches:
            hit = []
            for x, y in zip(b.column(2), b.column(3)):
                x, y = _unpack(x.as_buffer()), _unpack(y.as_buffer())
                hit.append(bool(links(_overlap(x, y), len(x), len(y), pct)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(hit, pa.bool_()))

    left = sets.select(F.col("sid").alias("a"), F.col("tokens").alias("ta"))
    right = sets.select(F.col("sid").alias("b"), F.col("tokens").alias("tb"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


class Node:
    """Sets of a tree node, sorted by size, with the OR of their bitmaps."""

    def __init__(self, sets: list[np.ndarray], bits: int):
        self.sets, self.bits = sets, bits
        self.low, self.high = len(sets[0]), len(sets[-1])
        self.mask = np.zeros(bits, bool)
        for s in sets:
            self.mask[(s >> U(20) & U(bits - 1)).astype(np.int64)] = True

    @classmethod
    def of(cls, packed: list[bytes], bits: int) -> Node:
        return cls(sorted(map(_unpack, packed), key=len), bits)

    def halves(self) -> list[Node]:
        m = len(self.sets) // 2
        return [Node(self.sets[:m], self.bits), Node(self.sets[m:], self.bits)]


def _most(mask: np.ndarray, node: Node) -> int:
    """Largest number of tokens that any set of a node can have in common with sets under ``mask``, less its need."""
    return max(int(mask[(s >> U(20) & U(node.bits - 1)).astype(np.int64)].sum()) for s in node.sets)


def possible(a: Node, b: Node, pct: int) -> bool:
    """Whether some set of a and some set of b may link, from sizes and bitmaps."""
    if a.high * 100 < pct * b.low or b.high * 100 < pct * a.low:
        return False
    least = -(-pct * (a.low + b.low) // (100 + pct))  # the overlap that the smallest sizes need
    return _most(b.mask, a) >= least and _most(a.mask, b) >= least


def first_link(a: Node, b: Node, pct: int) -> bool:
    """Dual traversal: whether any set of a links with any set of b."""
    stack = [(a, b)]
    while stack:
        x, y = stack.pop()
        if not possible(x, y, pct):
            continue
        if len(x.sets) == len(y.sets) == 1:
            if links(_overlap(x.sets[0], y.sets[0]), x.low, y.low, pct):
                return True
        elif len(x.sets) >= len(y.sets):
            stack += [(h, y) for h in x.halves()]
        else:
            stack += [(x, h) for h in y.halves()]
    return False


def _width(tokens: int) -> int:
    """Bits of a bitmap: four per token of the largest set."""
    return 1 << max(8, int(4 * tokens - 1).bit_length())


def _summaries(nodes: DataFrame) -> DataFrame:
    """(node, low, high, most, bits): a node's size range, largest set and OR bitmap; bitmaps of one width per node."""
    def run(batches):
        for b in batches:
            for r in _rows(b):
                x = Node.of(r["sets"], _width(r["high"]))
                yield pa.RecordBatch.from_arrays([pa.array([r["node"]]), pa.array([x.low], pa.int64()), pa.array([x.high], pa.int64()),
                                                  pa.array([len(x.sets)], pa.int64()),
                                                  pa.array([np.packbits(x.mask, bitorder="little").tobytes()])],
                                                 ["node", "low", "high", "members", "mask"])
    return nodes.select("node", "high", "sets").mapInArrow(run, "node long, low long, high long, members long, mask binary")


def _survivors(pairs: DataFrame, summaries: DataFrame, pct: int) -> DataFrame:
    """Node pairs that may link, judged by their summaries alone.

    A set of size s cannot share more than the common bits allow once its other
    bits are known to be missing; for a node of one set its bitmap counts them:
    overlap <= size - (bits of the set that the other bitmap lacks).
    """
    def fold_to(mask: np.ndarray, width: int) -> np.ndarray:
        return mask.reshape(-1, width).any(0)  # the low bits of a place are its place in a narrower bitmap

    def run(batches):
        for b in batches:
            keep = []
            for r in _rows(b):
                if r["ha"] * 100 < pct * r["lb"] or r["hb"] * 100 < pct * r["la"]:
                    keep.append(False)
                    continue
                x, y = (np.unpackbits(np.frombuffer(r[k], np.uint8), bitorder="little").astype(bool) for k in ("ma", "mb"))
                width = min(len(x), len(y))
                x, y = fold_to(x, width), fold_to(y, width)
                least = -(-pct * (r["la"] + r["lb"]) // (100 + pct))
                # only a one-set node's bitmap proves tokens missing: each lone bit is at least one token
                top = min([r["ha"] - int((x & ~y).sum())] * (r["na"] == 1) + [r["hb"] - int((y & ~x).sum())] * (r["nb"] == 1)
                          + [max(r["ha"], r["hb"])])
                keep.append(top >= least)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    a = summaries.select(F.col("node").alias("a"), F.col("low").alias("la"), F.col("high").alias("ha"),
                         F.col("members").alias("na"), F.col("mask").alias("ma"))
    b = summaries.select(F.col("node").alias("b"), F.col("low").alias("lb"), F.col("high").alias("hb"),
                         F.col("members").alias("nb"), F.col("mask").alias("mb"))
    rows = pairs.select("a", "b").join(a, "a").join(b, "b")
    return rows.select("a", "b", "la", "ha", "na", "ma", "lb", "hb", "nb", "mb").mapInArrow(run, "a long, b long")


def _traverse(pairs: DataFrame, nodes: DataFrame, pct: int) -> DataFrame:
    """(a, b) set ids, one of each node of a pair that links."""
    def run(batches):
        for b in batches:
            for r in _rows(b):
                bits = _width(max(r["ha"], r["hb"]))
                if first_link(Node.of(r["sa"], bits), Node.of(r["sb"], bits), pct):
                    yield pa.RecordBatch.from_arrays([pa.array([r["ra"]]), pa.array([r["rb"]])], ["a", "b"])

    a = nodes.select(F.col("node").alias("a"), F.col("root").alias("ra"), F.col("high").alias("ha"), F.col("sets").alias("sa"))
    b = nodes.select(F.col("node").alias("b"), F.col("root").alias("rb"), F.col("high").alias("hb"), F.col("sets").alias("sb"))
    n = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (pairs.join(a, "a").join(b, "b").select("a", "b", "ra", "rb", "ha", "hb", "sa", "sb")
            .repartition(n, "a", "b").mapInArrow(run, "a long, b long"))


def jaccard_components(docs: DataFrame, words: int = 5, pct: int = 75) -> DataFrame:
    """doc_id, n_shingles and component_id for every row of (doc_id, text)."""
    docs = docs.select("doc_id", "text")
    described = checkpointed(_describe(docs, words))
    rows = described.where("kind = 0").select("doc_id", "n", "sid", "m1", "m2", "m3")
    levels = _frequency_levels(described.where("kind = 1"))
    sets = rows.where("sid is not null").groupBy("sid").agg(*[F.first(f"m{k}").alias(f"m{k}") for k in (1, 2, 3)])

    # the prefix index, and what each set can overlap with any other at most
    index = checkpointed(_index(docs, levels, words, pct))
    p = F.col("n") - F.ceil(F.col("n") * pct / 100) + F.floor(F.col("n") / SLACK) + 1
    rest = F.greatest(F.col("n") - p, F.lit(0)).cast("long")
    own = index.groupBy("sid").agg(F.first("n").alias("n"), F.count(F.lit(1)).alias("s"))
    able = checkpointed(own.withColumn("rest", rest).where(F.col("s") + rest >= F.ceil(F.col("n") * pct / 100)))

    # early links: each set with the least edited one that has the same MinHash value
    seeds = sets.select("sid", "m1", "m2", "m3").join(able, "sid")
    either = seeds.select("sid", "n", (F.least(p, F.col("n")) - F.col("s")).alias("alone"), F.explode(F.array(*[
        F.struct(F.lit(k).alias("k"), F.col(f"m{k}").alias("m")) for k in (1, 2, 3)])).alias("v"))
    either = checkpointed(either.select("sid", "n", "alone", "v.k", "v.m"))
    center = either.groupBy("k", "m").agg(F.min(F.struct("alone", "sid", "n")).alias("c"), F.count(F.lit(1)).alias("of")).where("of > 1")
    stars = (either.join(center, ["k", "m"]).where("sid <> c.sid")
             .where((F.col("n") * 100 >= F.col("c.n") * pct) & (F.col("c.n") * 100 >= F.col("n") * pct))
             .select(F.col("sid").alias("a"), F.col("c.sid").alias("b")).distinct())
    stars = checkpointed(stars)
    ends = lambda p: p.select(F.explode(F.array("a", "b")).alias("sid")).distinct()
    near = checkpointed(_token_sets(docs, checkpointed(ends(stars)), words))
    early = checkpointed(_verify(stars, near, pct))
    joined = components(early)

    # complete search over the nodes of the components so far
    size = joined.groupBy("root").agg(F.count(F.lit(1)).alias("of"))
    part = F.pmod(F.xxhash64("sid"), F.expr(f"cast(ceil(of / {NODE}) as bigint)"))
    member = joined.withColumnRenamed("node", "sid").join(size, "root").select(
        "sid", "root", F.when(F.col("of") <= NODE, F.col("root")).otherwise(F.xxhash64("root", part)).alias("node"))
    at_node = checkpointed(able.join(member, "sid", "left").select(
        "sid", "n", "s", "rest", F.coalesce("node", "sid").alias("node"), F.coalesce("root", "sid").alias("root")))
    # a set's shared prefix tokens from each one on, in the order of the set: a set's tokens are few
    ahead = F.row_number().over(Window.partitionBy("sid").orderBy(F.desc("pos"))).cast("long")
    placed = (index.join(at_node.drop("n"), "sid").withColumn("ahead", ahead)
              .select("token", "node", "root", F.col("n").cast("long").alias("n"), "rest", "ahead"))
    cols = placed.columns
    pairs = _runs(placed, cols, "node", "a long, b long", _node_pairs(pct)).distinct()
    pairs = checkpointed(pairs)
    used = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    lists = (index.join(at_node.drop("n"), "sid").join(used, "node", "left_semi").groupBy("node").agg(
        F.min("n").cast("long").alias("low"), F.max("n").cast("long").alias("high"), F.max("rest").alias("rest"),
        F.array_sort(F.collect_set("token")).alias("tokens")))
    pairs = checkpointed(_enough_shared(pairs, checkpointed(lists), pct))
    used = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    at_node = at_node.select("sid", "node", "root").join(used, "node")
    packed = _token_sets(docs, checkpointed(at_node.select("sid")), words).select("sid", "n", "tokens")
    nodes = checkpointed(packed.join(at_node, "sid").groupBy("node").agg(
        F.first("root").alias("root"), F.max("n").alias("high"), F.collect_list("tokens").alias("sets")))
    pairs = checkpointed(_survivors(pairs, checkpointed(_summaries(nodes)), pct))
    late = checkpointed(_traverse(pairs, nodes, pct))

    # roots of the early components, linked further; then the smallest document of each
    final = components(late.unionByName(joined.select(F.col("node").alias("a"), F.col("root").alias("b"))))
    known = sets.select("sid").join(final.withColumnRenamed("node", "sid"), "sid", "left").select("sid", F.coalesce("root", "sid").alias("root"))
    least = rows.where("sid is not null").groupBy("sid").agg(F.min("doc_id").alias("least")).join(known, "sid")
    smallest = least.groupBy("root").agg(F.min("least").alias("component_id"))
    of_set = least.join(smallest, "root").select("sid", "component_id")
    return (rows.select("doc_id", "n", "sid").join(of_set, "sid", "left")
            .select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id")))


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents").select("doc_id", "text"))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of every group of near copies one document stays, the one with the smallest (id, text hash).

    Rows are told apart by id and text, so rows without an id, and different texts
    under one id, are documents of their own; a null id comes last in its group.
    Rows that repeat id and text stay once (the smallest of their other columns).
    Rows without words stay.
    """
    cols = ["doc_id", "text", "lang", "source", "n_chars"]
    docs = docs.select(*cols).withColumn("_key", F.xxhash64("doc_id", F.coalesce("text", F.lit(""))))
    rows = jaccard_components(docs.select(F.col("_key").alias("doc_id"), "text")).where("n_shingles > 0")
    keys = checkpointed(rows.groupBy(F.col("doc_id").alias("_key")).agg(F.min("component_id").alias("_group"),
                                                                       F.count(F.lit(1)).alias("_times")))
    shared = keys.groupBy("_group").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    members = keys.join(shared, "_group", "left_semi").select("_key", "_group")
    named = docs.select("_key", "doc_id").join(members, "_key")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_key"))
    stays = named.groupBy("_group").agg(first.alias("_first")).select(F.col("_first._key").alias("_key"))
    gone = members.join(stays, "_key", "left_anti").select("_key", F.lit(True).alias("_gone"))
    flags = keys.join(gone, "_key", "left").where("_gone or _times > 1").select("_key", "_times", "_gone")
    left = docs.join(flags, "_key", "left").where("_gone is null")
    again = left.where("_times is not null").groupBy("_key").agg(
        F.min(F.struct("lang", "source", "n_chars", "doc_id", "text")).alias("r")).select(*[f"r.{c}" for c in cols])
    return left.where("_times is null").select(*cols).unionByName(again)
