"""Merkle manifest of a table by butterfly exchange (operator 12).

Every row is a leaf: the SHA-256 of its fields, each with its length. The leaves of
a group (``lang``) ascend by id and are hashed up in runs of ``FANOUT`` to the
group's subroot; the subroots, ordered by group, are hashed up to the root in the
same way.

Positions come from one range sort by (group, id), whose partitions count their
rows. ``FANOUT ** LEVELS`` consecutive leaves are a block, hashed in one task. Above
the blocks the trees are hashed by a butterfly: in round r the blocks that agree in
everything but digit r of their number (base ``FANOUT``) swap their digests, so
each of them hashes the same parent and keeps the others as its part of the proof.
After the last round every block holds the root and its upper proof; nothing is sent
down again. Where the last run of a level is short, its blocks stand in for the
missing partners: copy c of a block answers for number + c * (blocks there), so
each block hears from every sibling once. The subroots are joined into the root by
the same exchange.

A round shuffles one row per block and no row is larger than a proof
(``FANOUT - 1`` digests a level). The leaves are shuffled twice as ids and digests,
never with their texts.

Defined results: a null field counts as ``-``; a null id comes first and is never
tampered with; repeated rows are leaves each (equal rows take turns, with equal
digests); a null group is a group, ordered first; extra columns are not carried
over; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from storelens.llm.common import checkpointed, table
from storelens.llm.ranks import positions

FANOUT = 8
LEVELS = 4  #: levels hashed inside a block: 4,096 leaves
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _hash(parts: list[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_digest(fields: list[Column]) -> Column:
    """SHA-256 of the fields, each ``-`` if null, else byte count, colon, value."""
    def item(c: Column) -> Column:
        s = c.cast("string")
        return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))
    return F.sha2(F.concat(*[item(c) for c in fields]), 256)


def _climb(nodes: list[str], levels: int | None) -> list[list[str]]:
    """The levels above ``nodes``, lowest first, ``levels`` of them (None: until one node is left)."""
    out = [nodes]
    while (len(out[-1]) > 1) if levels is None else (len(out) <= levels):
        last = out[-1]
        out.append([_hash(last[i:i + FANOUT]) for i in range(0, len(last), FANOUT)])
    return out


def _height(nodes: int) -> int:
    """Levels above ``nodes`` nodes."""
    h = 0
    while nodes > 1:
        nodes, h = -(-nodes // FANOUT), h + 1
    return h


def butterfly(blocks: DataFrame, rounds: int, group: list[str]) -> DataFrame:
    """Every block's ``root`` and upper ``proof``, by rounds of swaps among aligned runs of ``FANOUT``.

    ``blocks`` has the group columns, ``block`` (its number), ``blocks`` (how many
    the group has) and ``digest``. ``proof`` is an array of (before, after): the
    concatenated digests to the left and to the right of the way up, per level;
    groups of less height leave levels out.
    """
    state = blocks.withColumn("proof", F.expr("cast(array() as array<struct<before: string, after: string>>)"))
    for r in range(rounds):
        low, run = FANOUT ** r, FANOUT ** (r + 1)
        # blocks of the subtree this block stands for: its aligned run of `low`, cut off at the end
        state = (state.withColumn("_start", F.expr(f"block div {low} * {low}L"))
                 .withColumn("_held", F.least(F.lit(low), F.col("blocks") - F.col("_start")))
                 .withColumn("_active", F.expr(f"blocks > {low}L")))
        # a subtree answers once for every offset that a sibling may ask from; alone in its run, its blocks ask it only
        told = (state.where("_active")
                .withColumn("_most", F.when(F.col("_start") % run == 0, F.col("_held")).otherwise(F.lit(low)))
                .withColumn("_slot", F.explode(F.expr("sequence(block - _start, _most - 1, _held)")))
                .select(*group, F.expr(f"block div {run}L").alias("_run"), "_slot",
                        F.expr(f"cast(block div {low}L % {FANOUT} as int)").alias("_digit"), "digest"))
        heard = (told.groupBy(*group, "_run", "_slot")
                 .agg(F.sort_array(F.collect_list(F.struct("_digit", "digest"))).alias("_nodes")))  # FANOUT at most
        asks = state.select("*", F.expr(f"block div {run}L").alias("_run"), (F.col("block") - F.col("_start")).alias("_slot"),
                            F.expr(f"cast(block div {low}L % {FANOUT} as int)").alias("_own"))

        def joined(nodes: Column) -> Column:
            return F.array_join(F.transform(nodes, lambda x: x["digest"]), "")
        way = F.struct(joined(F.filter("_nodes", lambda x: x["_digit"] < F.col("_own"))).alias("before"),
                       joined(F.filter("_nodes", lambda x: x["_digit"] > F.col("_own"))).alias("after"))
        state = asks.join(heard, [*group, "_run", "_slot"], "left").select(
            *group, "block", "blocks",
            F.when(F.col("_active"), F.sha2(joined(F.col("_nodes")), 256)).otherwise(F.col("digest")).alias("digest"),
            F.when(F.col("_active"), F.concat("proof", F.array(way))).otherwise(F.col("proof")).alias("proof"))
        state = checkpointed(state)
    return state.withColumnRenamed("digest", "root")


def _rounds(blocks: DataFrame) -> int:
    return _height(blocks.agg(F.max("blocks")).first()[0] or 0)


def _block_levels(rows: pd.DataFrame, levels: int) -> list[list[str]]:
    return _climb(rows["leaf"].tolist(), None if rows["size"].iloc[0] <= FANOUT ** levels else levels)


def _block_root(rows: pd.DataFrame, levels: int) -> pd.DataFrame:
    digest = _block_levels(rows.sort_values("pos"), levels)[-1][0]
    return pd.DataFrame({"gid": rows["gid"].iloc[:1], "block": rows["block"].iloc[:1], "digest": [digest]})


def _prove(rows: pd.DataFrame, upper: pd.DataFrame, levels: int) -> pd.DataFrame:
    """Proof digests and refolded roots of a block's leaves."""
    rows = rows.sort_values("pos").reset_index(drop=True)
    top = upper.iloc[0]
    inside = _block_levels(rows, levels)[:-1]
    above = [(p["before"], p["after"]) for p in [*top["proof"], *top["top_proof"]]]
    tail = "".join(b + a for b, a in above)
    proofs, folded = [], []
    for i, value in enumerate(rows["shown"].tolist()):
        seen, at = [], i
        for level in inside:
            start = at // FANOUT * FANOUT
            before, after = "".join(level[start:at]), "".join(level[at + 1:start + FANOUT])
            seen += (before, after)
            value = _hash([before, value, after])
            at //= FANOUT
        for before, after in above:
            value = _hash([before, value, after])
        proofs.append(_hash([*seen, tail]))
        folded.append(value)
    return pd.DataFrame({"doc_id": rows["doc_id"], "leaf": rows["leaf"], "subroot": top["subroot"], "root": top["root"],
                         "proof_sha256": proofs, "folded_root": folded,
                         "verified": [f == top["root"] for f in folded]})


def manifest(leaves: DataFrame, levels: int = LEVELS) -> DataFrame:
    """Proofs of all leaves: from (doc_id, lang, leaf, shown) rows, where ``shown`` is the leaf to refold.

    ``levels``: how many levels one task hashes before the butterfly.
    """
    id_type = leaves.schema["doc_id"].dataType.simpleString()
    placed = positions(leaves, ["doc_id", "leaf"], "lang")
    # groups are numbered in their order; (position, size) per group is what the top tree needs
    groups = positions(placed.groupBy("lang").agg(F.count(F.lit(1)).alias("n")), ["lang"])
    groups = checkpointed(groups.select("lang", F.col("pos").alias("gid"), F.col("size").alias("groups"), "n"))
    size = FANOUT ** levels
    rows = checkpointed(
        placed.alias("p").join(groups.alias("g"), F.col("p.lang").eqNullSafe(F.col("g.lang")))
        .select("gid", F.expr(f"pos div {size}").alias("block"), "pos", F.col("p.size").alias("size"), "doc_id", "leaf", "shown"))
    roots = rows.select("gid", "block", "pos", "size", "leaf").groupBy("gid", "block").applyInPandas(
        lambda rows: _block_root(rows, levels), "gid bigint, block bigint, digest string")
    blocks = checkpointed(roots.join(groups.select("gid", F.expr(f"cast(ceil(n / {size}) as bigint)").alias("blocks")), "gid"))
    inner = butterfly(blocks, _rounds(blocks), ["gid"]).withColumnRenamed("root", "subroot")
    tops = (inner.where("block = 0").join(groups.select("gid", "groups"), "gid")
            .select(F.lit(0).alias("tree"), F.col("gid").alias("block"), F.col("groups").alias("blocks"),
                    F.col("subroot").alias("digest")))
    tops = checkpointed(tops)
    outer = butterfly(tops, _rounds(tops), ["tree"])
    upper = inner.join(outer.select(F.col("block").alias("gid"), "root", F.col("proof").alias("top_proof")), "gid")
    return (rows.groupBy("gid", "block").cogroup(upper.groupBy("gid", "block"))
            .applyInPandas(lambda rows, upper: _prove(rows, upper, levels), f"doc_id {id_type}, leaf string, subroot string, root string, proof_sha256 string, "
                                   "folded_root string, verified boolean"))


def document_leaves(docs: DataFrame) -> DataFrame:
    """Leaves of ``documents`` rows; where 3 divides crc32 of the id, the shown leaf is of the text in lower case."""
    own = leaf_digest([F.col(c) for c in FIELDS])
    altered = leaf_digest([F.translate("text", _UPPER, _LOWER) if c == "text" else F.col(c) for c in FIELDS])
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, F.lit(False))
    return docs.select("doc_id", "lang", own.alias("leaf"), F.when(hit, altered).alias("_altered")).select(
        "doc_id", "lang", "leaf", F.coalesce("_altered", "leaf").alias("shown"))


def op12_merkle_butterfly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merkle manifest of all documents, with each row's proof and the root refolded from what is shown."""
    return manifest(document_leaves(table(spark, sf_dir, "documents")))
