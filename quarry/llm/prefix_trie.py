"""Prefix trie of conversations by burst tries.

A turn's id is the first half of the SHA-256 of its role and text. Equal conversations are one suffix with a weight, so that
a group of copies of any size is one entry. At first one container under the root holds every suffix. A container of more
than LIMIT turns bursts: the turns that all its suffixes share become a chain of trie heads, and where they part there is a
container for each next turn id. The containers that remain have at most LIMIT turns, or a single suffix: the latter are
nodes as they stand, of any length; the former are dealt over the tasks (shards), and each is sorted and swept into nodes.
Sums over subtrees are made within a container by its sweep, and from container to container by going back over the bursts.

Rounds of bursts: at most as many as the deepest branching above containers of more than LIMIT turns. Joins with the facts of
containers are salted, since one container can hold all rows.

Null role or text counts as empty. Rows without conv_id are left out: they belong to no conversation. Turns are ordered by
turn, null first; equal ones by their id, repeated rows both stay. Texts of any length count by their digest and code points.
A conversation without turns is a member of the root. An empty table has no nodes. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.base import filled, written
from quarry.operators.statistics import ranks

#: Turns of the largest container that is swept in one piece.
LIMIT = 1024
SALTS = 32
#: Members of one piece of a digested list.
PIECE = 512
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long"
BOX = ["top", "depth"]


def numbered(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, id, chars): every turn with its place from 0 in its conversation, its id and its text's code points."""
    role, text = filled("role"), filled("text")
    named = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)
    turns = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.unhex(F.substring(named, 1, 32)).alias("id"), F.length(text).cast("long").alias("chars")
    )
    placed = ranks(turns, ["conv_id", "turn", "id"], "turns")
    first = placed.groupBy("conv_id").agg(F.min("place").alias("first"))
    return placed.join(first, "conv_id").select("conv_id", (F.col("place") - F.col("first")).alias("pos"), "id", "chars")


def grafted(turns: DataFrame, heads: Column, most: int, base: Column) -> tuple[DataFrame, DataFrame]:
    """(ids, turns) of rebuilt conversations: the first `heads` (at most `most`) turns of conversation `base`, all if it has
    fewer and none if it is absent, then the own turns after the first `heads`. Both are expressions over conv_id."""
    convs = turns.groupBy("conv_id").agg(F.count("*").alias("n"))
    plan = convs.select("conv_id", heads.cast("long").alias("h"), base.alias("base"))
    lent = plan.join(convs.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n")), "base", "left")
    lent = written(lent.select("conv_id", "base", "h", F.least("h", F.coalesce("base_n", F.lit(0))).alias("taken")), "grafts")
    begin = turns.where(F.col("pos") < most).withColumnRenamed("conv_id", "base")
    front = lent.where("taken > 0").join(begin, "base").where("pos < h").select("conv_id", "pos", "id", "chars")
    own = turns.join(lent, "conv_id").where("pos >= h").select("conv_id", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "id", "chars")
    return lent.select("conv_id"), front.union(own)


def beside(many: DataFrame, few: DataFrame, keys: list[str]) -> DataFrame:
    """many with the row of few (one a key) of its keys; any number of rows may share a key, so that both sides are salted."""
    salted = few.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return many.withColumn("_salt", F.pmod(F.xxhash64("seq"), F.lit(SALTS)).cast("int")).join(salted, [*keys, "_salt"]).drop("_salt")


def digested(members: DataFrame) -> DataFrame:
    """(seq, ends_sha256): the digest of each group's members (seq, conv_id), ascending and joined by commas. Ranges are packed
    into pieces first; then a group is a stream of pieces through one hash, which holds no list."""

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            group = batch["seq"].ne(batch["seq"].shift()).cumsum()
            piece = batch.groupby([group, batch.groupby(group).cumcount() // PIECE])
            yield piece.agg(seq=("seq", "first"), first=("conv_id", "first"), listed=("conv_id", lambda s: ",".join(map(str, s)))).reset_index(drop=True)

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = None, None
        for batch in batches:
            out = []
            for seq, listed in zip(batch["seq"].tolist(), batch["listed"], strict=True):
                if seq != now:
                    if state:
                        out.append((now, state.hexdigest()))
                    now, state = seq, hashlib.sha256(listed.encode())
                else:
                    state.update(b"," + listed.encode())
            yield pd.DataFrame(out, columns=["seq", "ends_sha256"]).astype({"seq": "int64"})
        if state:
            yield pd.DataFrame([(now, state.hexdigest())], columns=["seq", "ends_sha256"])

    ranged = members.select("seq", "conv_id").repartitionByRange("seq", "conv_id").sortWithinPartitions("seq", "conv_id")
    pieces = ranged.mapInPandas(packed, "seq long, first long, listed string")
    return pieces.repartition("seq").sortWithinPartitions("seq", "first").mapInPandas(hashed, "seq long, ends_sha256 string")


def distinct_sequences(ids: DataFrame, turns: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(suffixes (seq, n, len), their turns (seq, pos, id, chars), digests (seq, ends_sha256)): conversations of equal turns are
    one, named by its smallest member. Equality is that of two sums of 64-bit hashes of placed turns, so that no conversation
    is gathered."""
    mark = lambda k: F.sum(F.xxhash64(F.lit(k), "pos", "id").cast("decimal(20,0)"))
    marks = turns.groupBy("conv_id").agg(F.count("*").alias("len"), mark(1).alias("a"), mark(2).alias("b"))
    zero = F.lit(0).cast("decimal(30,0)")
    known = ids.join(marks, "conv_id", "left").select("conv_id", F.coalesce("len", F.lit(0)).alias("len"), F.coalesce("a", zero).alias("a"), F.coalesce("b", zero).alias("b"))
    known = written(known, "marks")
    groups = written(known.groupBy("len", "a", "b").agg(F.min("conv_id").alias("seq"), F.count("*").alias("n")), "sequences")
    copies = known.join(groups.where("n > 1"), ["len", "a", "b"])
    alone = groups.where("n = 1").select("seq", F.sha2(F.col("seq").cast("string"), 256).alias("ends_sha256"))
    suffixes = groups.select("seq", "n", "len")
    own = turns.withColumnRenamed("conv_id", "seq").join(suffixes.select("seq"), "seq")
    return suffixes, written(own.select("seq", "pos", "id", "chars"), "suffix-turns"), alone.union(digested(copies))


def sweep(held: list[tuple[list, list, int, int]]) -> list[list]:
    """Nodes below a container's top from its suffixes (ids, chars, n, seq), sorted: [depth, conv_id, n_convs, n_children,
    n_leaves, saved, ends, parent] in order of their opening, with depths below the top, and parent a place in the list. The
    first is the top itself, with what lies below it."""
    held.sort(key=lambda s: s[0])
    nodes = [[0, None, 0, 0, 0, 0, None, -1]]
    path, owned, before = [0], [0], []

    def close() -> None:
        node = nodes[path.pop()]
        node[4] = node[4] or 1
        node[5] += (node[2] - 1) * owned.pop()
        up = nodes[node[7]]
        up[1] = node[1] if up[1] is None else min(up[1], node[1])
        up[2], up[3], up[4], up[5] = up[2] + node[2], up[3] + 1, up[4] + node[4], up[5] + node[5]

    for ids, chars, n, seq in held:
        same = 0
        for x, y in zip(before, ids):  # noqa: B905  a shared beginning
            if x != y:
                break
            same += 1
        while len(path) > same + 1:
            close()
        for k in range(same, len(ids)):
            nodes.append([k + 1, None, 0, 0, 0, 0, None, path[-1]])
            path.append(len(nodes) - 1)
            owned.append(chars[k])
        node = nodes[path[-1]]
        node[1] = seq if node[1] is None else min(node[1], seq)
        node[2], node[6] = node[2] + n, seq
        before = ids
    while len(path) > 1:
        close()
    return nodes


def swept(rows: DataFrame) -> DataFrame:
    """Nodes of the containers of several suffixes: rows (top, depth, seq, pos, id, chars, n). top_row marks a container's own row,
    with what lies below its top."""
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]

    def of_container(top: int, depth: int, part: pd.DataFrame) -> list[tuple]:
        held = []
        for seq, own in part.groupby("seq", sort=False):
            held.append((own["id"].tolist(), own["chars"].tolist(), int(own["n"].iloc[0]), int(seq)))
        nodes = sweep(held)
        out = [(top, depth, None, None, nodes[0][3], nodes[0][4], nodes[0][5], None, True)]
        for below, conv, n, children, leaves, saved, ends, parent in nodes[1:]:
            up = nodes[parent][1] if parent else top
            out.append((conv, depth + below, up, n, children, leaves, saved, ends, False))
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest, names = None, [*columns, "ends", "top_row"]
        kinds = {c: "Int64" for c in names[:-1]}
        for batch in batches:
            batch = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            last = batch.iloc[-1] if len(batch) else None
            open_ = (batch["top"] == last["top"]) & (batch["depth"] == last["depth"]) if last is not None else None
            rest = batch[open_] if last is not None else None
            out = [r for (top, depth), part in (batch[~open_].groupby(BOX, sort=False) if last is not None else ()) for r in of_container(int(top), int(depth), part)]
            yield pd.DataFrame(out, columns=names).astype(kinds | {"top_row": bool})
        if rest is not None:
            yield pd.DataFrame(of_container(int(rest["top"].iloc[0]), int(rest["depth"].iloc[0]), rest), columns=names).astype(kinds | {"top_row": bool})

    dealt = rows.repartition(*BOX).sortWithinPartitions(*BOX, "seq", "pos")
    return dealt.mapInPandas(run, f"{NODE}, ends long, top_row boolean")


def burst(state: DataFrame, turns: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """One round over containers that are too large: state (seq, n, len, top, depth, seqs, n_convs), turns (seq, pos, id, chars).
    Returns (the next state, the turns left, the new tops, the chains, ends in chains)."""
    rows = written(turns.join(state, "seq").where("pos >= depth"), "burst")
    at = rows.groupBy(*BOX, "pos").agg(F.count("*").alias("c"), F.min("id").alias("low"), F.max("id").alias("high"), F.min("chars").alias("chars"), F.max("seqs").alias("seqs"), F.max("n_convs").alias("n_convs"))
    at = written(at.withColumn("shared", (F.col("c") == F.col("seqs")) & (F.col("low") == F.col("high"))), "places")
    stop = written(at.where("NOT shared").groupBy(*BOX).agg(F.min("pos").alias("stop")), "stops")
    chain = written(at.join(stop, BOX).where("pos < stop").select(*BOX, "stop", (F.col("pos") + 1).alias("at"), "chars", "n_convs"), "chains")
    parting = beside(rows, stop, BOX)
    here = parting.where("pos = stop")
    tops = written(here.groupBy(*BOX, "stop", "id").agg(F.min("seq").alias("new"), F.sum("n").alias("n_convs"), F.min("chars").alias("chars")), "tops")
    after = beside(here.select(*BOX, "id", "seq", "n", "len"), tops.select(*BOX, "id", "new", (F.col("stop") + 1).alias("new_depth")), [*BOX, "id"])
    state = written(after.select("seq", "n", "len", F.col("new").alias("top"), F.col("new_depth").alias("depth")), "state")
    kids = tops.select(F.col("new").alias("top"), (F.col("stop") + 1).alias("depth"), F.col("top").alias("up"), F.col("depth").alias("up_depth"), "stop", "chars", "n_convs")
    # a suffix that ends where the others part, below the container's top
    last = parting.where("stop > depth AND len = stop AND pos = stop - 1").select(F.col("top").alias("conv_id"), F.col("stop").alias("depth"), F.col("seq").alias("ends"))
    return state, rows.select("seq", "pos", "id", "chars"), kids, chain, last


def chained(chain: DataFrame, tops: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes of chains, what lies below the tops of the containers that burst), from the new tops with their sums."""
    below = tops.groupBy("up", "up_depth", "stop").agg(F.count("*").alias("kids"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
    below = below.withColumnsRenamed({"up": "top", "up_depth": "depth"})
    own = (F.col("n_convs") - 1) * F.col("chars")
    down = Window.partitionBy(*BOX).orderBy(F.desc("at")).rowsBetween(Window.unboundedPreceding, 0)
    linked = chain.withColumn("own", F.sum(own).over(down)).join(below.drop("stop"), BOX)
    children = F.when(F.col("at") == F.col("stop"), F.col("kids")).otherwise(F.lit(1))
    nodes = linked.select(F.col("top").alias("conv_id"), F.col("at").alias("depth"), F.col("top").alias("parent_conv_id"), "n_convs", children.alias("n_children"), F.col("leaves").alias("n_leaves"), (F.col("saved") + F.col("own")).alias("saved_tokens"))
    total = chain.groupBy(*BOX).agg(F.sum(own).alias("own"))
    inner = below.join(total, BOX, "left").select(
        *BOX, F.when(F.col("depth") == F.col("stop"), F.col("kids")).otherwise(F.lit(1)).alias("n_children"), F.col("leaves").alias("n_leaves"),
        (F.col("saved") + F.coalesce("own", F.lit(0))).alias("below"),
    )
    return nodes, inner


def build(ids: DataFrame, turns: DataFrame, limit: int = LIMIT) -> DataFrame:
    """The trie's nodes: columns of NODE and ends_sha256. ids: (conv_id), each once; turns: (conv_id, pos, id, chars).

    A node is named by its smallest member and its depth. n_leaves counts childless nodes in its subtree, saved_tokens sums
    there (members - 1) times the code points of a node's last text; ends_sha256 digests the members that end at it."""
    suffixes, suffix_turns, digests = distinct_sequences(ids, turns)
    root = suffixes.agg(F.min("seq").alias("top"), F.sum("n").alias("n_convs")).where("top IS NOT NULL")
    root = written(root.select("top", F.lit(0).cast("long").alias("depth"), "n_convs"), "root")
    state = suffixes.join(F.broadcast(root.select(*BOX)), on=F.lit(True))  # one row
    left, finished, ended, bursts = suffix_turns, [], [], []
    while True:
        ended.append(state.where("len = depth").select(F.col("top").alias("conv_id"), "depth", F.col("seq").alias("ends")))
        sizes = state.groupBy(*BOX).agg(F.count("*").alias("seqs"), F.sum(F.col("len") - F.col("depth")).alias("size"), F.sum("n").alias("n_convs"))
        facts = written(beside(state, sizes, BOX), "containers")
        large = (F.col("seqs") > 1) & (F.col("size") > limit)
        finished.append(facts.where(~large))
        if facts.where(large).isEmpty():
            break
        state, left, kids, chain, last = burst(facts.where(large).drop("size"), left)
        ended.append(last)
        bursts.append((kids, chain))
    boxes = reduce(DataFrame.unionByName, finished)
    several = suffix_turns.join(boxes.where("seqs > 1").select(*BOX, "seq", "n"), "seq").where("pos >= depth")
    found = written(swept(several), "swept")
    single = suffix_turns.join(boxes.where("seqs = 1").select("depth", "seq", "n", "len"), "seq").where("pos >= depth")
    down = Window.partitionBy("seq").orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, 0)
    copied = single.where("n > 1").withColumn("saved", (F.col("n") - 1) * F.sum("chars").over(down))
    lines = copied.union(single.where("n = 1").withColumn("saved", F.lit(0).cast("long")))
    lone = lines.select(
        F.col("seq").alias("conv_id"), (F.col("pos") + 1).alias("depth"), F.col("seq").alias("parent_conv_id"), F.col("n").alias("n_convs"),
        (F.col("pos") + 1 < F.col("len")).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), F.col("saved").alias("saved_tokens"),
    )
    under = single.where("n > 1").groupBy("seq", "depth").agg((F.sum("chars") * (F.first("n") - 1)).alias("below"))
    bare = boxes.where("seqs = 1").select("seq", F.col("depth"), "len").join(under, ["seq", "depth"], "left")
    inner = bare.select(F.col("seq").alias("top"), "depth", (F.col("len") > F.col("depth")).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), F.coalesce("below", F.lit(0)).alias("below"))
    inner = written(inner.union(found.where("top_row").select(F.col("conv_id").alias("top"), "depth", "n_children", "n_leaves", F.col("saved_tokens").alias("below"))), "inner")
    columns = [c.split()[0] for c in NODE.split(", ")]
    nodes = [found.where("NOT top_row").select(columns), lone.select(columns)]
    ended += [found.where("NOT top_row AND ends IS NOT NULL").select("conv_id", "depth", "ends"), boxes.where("seqs = 1 AND len > depth").select(F.col("seq").alias("conv_id"), F.col("len").alias("depth"), F.col("seq").alias("ends"))]
    for kids, chain in reversed(bursts):
        tops = written(kids.join(inner, BOX).withColumn("saved_tokens", F.col("below") + (F.col("n_convs") - 1) * F.col("chars")), "heads")
        links, more = chained(chain, tops)
        nodes += [tops.select(F.col("top").alias("conv_id"), "depth", F.col("up").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens"), links.select(columns)]
        inner = written(inner.union(more.select(inner.columns)), "inner")
    nodes.append(root.join(inner, BOX).select(F.col("top").alias("conv_id"), "depth", F.lit(None).cast("long").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", F.col("below").alias("saved_tokens")))
    last = reduce(DataFrame.union, ended).join(digests.withColumnRenamed("seq", "ends"), "ends").drop("ends")
    nothing = hashlib.sha256(b"").hexdigest()
    whole = reduce(DataFrame.union, nodes).join(last, ["conv_id", "depth"], "left")
    return whole.select(*columns, F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256"))


def trie(conversations: DataFrame, limit: int = LIMIT) -> DataFrame:
    """The trie of conversations as they are: (conv_id, turn, role, text)."""
    turns = written(numbered(conversations), "numbered")
    return build(turns.select("conv_id").distinct(), turns, limit)
