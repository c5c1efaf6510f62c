"""Prefix trie of conversations by truncation peeling.

Conversations enter at their own depth.  From the deepest level down, those that
end at a level are merged with the nodes that survived from below, the groups are
that level's nodes, and their last turn is stripped: the shorter rows meet in the
next round.  Members, children, leaves and shared words are added up on the way,
so a node's whole subtree is known when the node is found.

The upper levels, where most conversations meet, are one grouped aggregation each,
summed before the shuffle, so a first turn that every conversation shares is no hot
key.  Below ``upper_levels`` the subtrees are small and many: each is peeled by the
task that holds it, which keeps the number of rounds from following the longest
conversation.  Where one such subtree would be large, the border moves down.

Turns are compared by 128 bits of SHA-256 and prefixes by a chained 128-bit hash.

Defined results: rows without conv_id belong to no conversation; turns with equal
``turn`` follow the hash of role and text; a NULL turn comes first; NULL role or text
is empty; repeated rows are turns of their own; an empty table has no nodes; further
columns are not read.  A conversation passes a task as 24 bytes a turn.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from itertools import groupby
from operator import itemgetter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traitlens.llm.common import settle

FAMILY, MOST_HEAD = 20, 4
UPPER_LEVELS = 4
#: Turns below one border node that one task may peel, unless they are of one conversation.
SUBTREE_TURNS = 200_000
ROOT = bytes(16)
_EMPTY_SHA = hashlib.sha256(b"").hexdigest()
_CHUNK_IDS = 10_000
_BATCH_NODES = 10_000
_NODE = "key binary, depth int, conv long, parent binary, n long, children long, leaves long, saved long"
_NAMES = [c.split()[0] for c in _NODE.split(", ")]


def conversations(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id and its turns in order, each as fingerprint and number of words."""
    said, spoken = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role, text))
    body = F.concat(F.length(said).cast("string"), F.lit(":"), said, spoken)
    rows = turns.where(F.col(conv_id).isNotNull()).select(
        F.col(conv_id).cast("long").alias("conv_id"),
        F.struct(
            F.col(turn).alias("turn"),
            F.substring(F.unhex(F.sha2(body, 256)), 1, 16).alias("print"),
            F.regexp_count(spoken, F.lit(r"[^ \t-\r]+")).cast("long").alias("words"),
        ).alias("one"),
    )
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("one")).alias("turns"))


def with_family_heads(convs: DataFrame) -> DataFrame:
    """Every conversation with its first h turns replaced by those of its family's first one, h = crc32(id) % 4."""
    convs = settle(convs)
    heads = convs.where(F.col("conv_id") % FAMILY == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, MOST_HEAD - 1).alias("head"))
    joined = convs.join(heads, F.col("conv_id") - F.col("conv_id") % FAMILY == F.col("base"), "left")
    h = (F.crc32(F.col("conv_id").cast("string")) % MOST_HEAD).cast("int")
    own = F.slice("turns", h + 1, F.size("turns"))
    taken = F.when(F.col("head").isNull(), F.slice("turns", 1, 0)).otherwise(F.slice("head", 1, h))
    return joined.select("conv_id", F.concat(taken, own).alias("turns"))


def with_prefix_keys(convs: DataFrame) -> DataFrame:
    """conv_id, depth, key of the whole sequence, keys of all its prefixes end to end, words per turn."""

    def keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for conv, prints, words in zip(batch["conv_id"], batch["prints"], batch["words"]):
                key, path = ROOT, []
                for one in prints:
                    key = hashlib.blake2b(key + bytes(one), digest_size=16).digest()
                    path.append(key)
                rows.append((conv, len(path), key, b"".join(path), words))
            yield pd.DataFrame(rows, columns=["conv_id", "depth", "key", "path", "words"])

    flat = convs.select("conv_id", F.col("turns.print").alias("prints"), F.col("turns.words").alias("words"))
    return flat.mapInPandas(keyed, "conv_id long, depth int, key binary, path binary, words array<long>")


def _key_at(depth: Column | int) -> Column:
    """The key of a path's prefix; the root's key at depth 0."""
    at = depth if isinstance(depth, Column) else F.lit(depth)
    return F.when(at < 1, F.lit(ROOT)).otherwise(F.expr("path").substr(16 * at - 15, F.lit(16)))


def ended(keyed: DataFrame) -> DataFrame:
    """One row per distinct sequence: its members enter the trie there together."""
    counts = keyed.groupBy("key", "depth").agg(F.count("*").alias("n"), F.min("conv_id").alias("conv"), F.first("path").alias("path"), F.first("words").alias("words"))
    return counts.withColumns({c: F.lit(0).cast("long") for c in ("children", "leaves", "saved")})


def border(classes: DataFrame, upper_levels: int = UPPER_LEVELS, subtree_turns: int = SUBTREE_TURNS) -> int:
    """The depth below which every subtree of several sequences is small enough for one task."""
    deepest = classes.agg(F.max("depth")).first()[0] or 0
    level = upper_levels
    while level < deepest:
        below = classes.where(F.col("depth") > level).groupBy(_key_at(level)).agg(F.count("*").alias("n"), F.sum(F.col("depth") - level).alias("turns"))
        if below.where((F.col("n") > 1) & (F.col("turns") > subtree_turns)).isEmpty():
            break
        level *= 2
    return min(level, deepest)


def _peel_group(rows: list[tuple], bottom: int, nodes: list[tuple]) -> list[tuple]:
    """Nodes of one subtree below ``bottom``, deepest first; what survives is the node at ``bottom``."""
    entering: dict[int, list[tuple]] = {}
    for row in rows:
        entering.setdefault(row[1], []).append(row)
    surviving: list[tuple] = []
    for depth in range(max(entering), bottom, -1):
        level: dict[bytes, list] = {}
        for key, _, n, conv, path, words, children, leaves, saved in [*entering.get(depth, ()), *surviving]:
            node = level.get(key)
            if node is None:
                level[key] = [n, conv, path, words, children, leaves, saved]
            else:
                node[0] += n
                node[1] = min(node[1], conv)
                node[4] += children
                node[5] += leaves
                node[6] += saved
        surviving = []
        for key, (n, conv, path, words, children, leaves, saved) in level.items():
            parent = path[16 * depth - 32 : 16 * depth - 16] if depth > 1 else ROOT
            leaves, saved = leaves or 1, saved + (n - 1) * int(words[depth - 1])
            nodes.append((key, depth, conv, parent, n, children, leaves, saved, None, None))
            surviving.append((parent, depth - 1, n, conv, path, words, 1, leaves, saved))
    return surviving


def peel_below(classes: DataFrame, bottom: int) -> DataFrame:
    """Nodes deeper than ``bottom``, and rows with a path: the survivors at ``bottom``."""
    columns = ["key", "depth", "n", "conv", "path", "words", "children", "leaves", "saved"]
    names = [*_NAMES, "path", "words"]

    def peel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = (row for batch in batches for row in zip(*(batch[c].tolist() for c in ["cut", *columns])))
        out: list[tuple] = []
        for _, group in groupby(rows, itemgetter(0)):
            for key, depth, n, conv, path, words, children, leaves, saved in _peel_group([row[1:] for row in group], bottom, out):
                out.append((key, depth, conv, None, n, children, leaves, saved, path[: 16 * bottom], words[:bottom]))
            if len(out) >= _BATCH_NODES:
                yield pd.DataFrame(out, columns=names)
                out = []
        yield pd.DataFrame(out, columns=names)

    deep = classes.where(F.col("depth") > bottom).select(_key_at(bottom).alias("cut"), *columns)
    return deep.repartition("cut").sortWithinPartitions("cut").mapInPandas(peel, f"{_NODE}, path binary, words array<long>")


def peel_level(rows: DataFrame, depth: int) -> DataFrame:
    """The nodes of one level from the conversations that end there and the survivors from below."""
    sums = {"n": F.sum("n"), "conv": F.min("conv"), "children": F.sum("children"), "leaves": F.sum("leaves"), "saved": F.sum("saved"), "path": F.first("path"), "words": F.first("words")}
    found = rows.groupBy("key").agg(*[c.alias(n) for n, c in sums.items()])
    shared = (F.col("n") - 1) * F.element_at("words", depth) if depth else F.lit(0)
    return found.select(
        "key", F.lit(depth).alias("depth"), "conv", (_key_at(depth - 1) if depth else F.lit(None).cast("binary")).alias("parent"), "n", "children",
        F.greatest("leaves", F.lit(1)).alias("leaves"), (F.col("saved") + shared).cast("long").alias("saved"), "path", "words",
    )


def stripped(level: DataFrame, depth: int) -> DataFrame:
    """Survivors of a level, their last turn removed."""
    return level.select(
        F.col("parent").alias("key"), "n", "conv", F.expr(f"substring(path, 1, {16 * (depth - 1)})").alias("path"), F.slice("words", 1, depth - 1).alias("words"),
        F.lit(1).cast("long").alias("children"), "leaves", "saved",
    )


def end_hashes(keyed: DataFrame) -> DataFrame:
    """Per sequence the SHA-256 of its members' ids in order.

    Ids are joined in pieces on ranges of (key, id), so copies in any number are
    spread; only the pieces of one sequence meet, to be hashed one after another.
    """

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            keys, ids = batch["key"].tolist(), batch["conv_id"].tolist()
            at = 0
            while at < len(keys):
                to = at + 1
                while to < len(keys) and to - at < _CHUNK_IDS and keys[to] == keys[at]:
                    to += 1
                rows.append((keys[at], ids[at], ",".join(map(str, ids[at:to]))))
                at = to
            yield pd.DataFrame(rows, columns=["key", "first", "ids"])

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, None
        for batch in batches:
            rows = []
            for one, ids in zip(batch["key"], batch["ids"]):
                if one == key:
                    state.update(b"," + ids.encode())
                    continue
                if state is not None:
                    rows.append((key, state.hexdigest()))
                key, state = one, hashlib.sha256(ids.encode())
            yield pd.DataFrame(rows, columns=["key", "ends_sha256"])
        if state is not None:
            yield pd.DataFrame([(key, state.hexdigest())], columns=["key", "ends_sha256"])

    ids = keyed.select("key", "conv_id").repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id")
    joined = ids.mapInPandas(pieces, "key binary, first long, ids string")
    return joined.repartition("key").sortWithinPartitions("key", "first").mapInPandas(hashed, "key binary, ends_sha256 string")


def trie(convs: DataFrame, upper_levels: int = UPPER_LEVELS, subtree_turns: int = SUBTREE_TURNS) -> DataFrame:
    """All nodes of the trie over (conv_id, turns): key, parent key, and the node's figures."""
    keyed = settle(with_prefix_keys(convs))
    classes = settle(ended(keyed))
    bottom = border(classes, upper_levels, subtree_turns)
    below = settle(peel_below(classes, bottom))
    entering = ["key", "n", "conv", "path", "words", "children", "leaves", "saved"]
    parts = [below.where("path IS NULL")]
    surviving = below.where("path IS NOT NULL").select(entering)
    for depth in range(bottom, -1, -1):
        rows = classes.where(F.col("depth") == depth).select(entering).unionByName(surviving)
        level = settle(peel_level(rows, depth))
        parts.append(level)
        if depth:
            surviving = stripped(level, depth)
    nodes = reduce(DataFrame.unionByName, [p.select(_NAMES) for p in parts])
    return nodes.join(end_hashes(keyed), "key", "left").fillna(_EMPTY_SHA, ["ends_sha256"])


def trie_nodes(turns: DataFrame) -> DataFrame:
    """The nodes of the rebuilt conversations, each with the smallest member of its parent."""
    nodes = settle(trie(with_family_heads(conversations(turns))))
    parents = nodes.select(F.col("key").alias("parent"), F.col("conv").alias("parent_conv_id"))
    return nodes.join(parents, "parent", "left").select(
        F.col("conv").alias("conv_id"), F.col("depth").cast("long").alias("depth"), "parent_conv_id", F.col("n").alias("n_convs"), F.col("children").alias("n_children"),
        F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), "ends_sha256",
    )
