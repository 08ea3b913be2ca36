"""Prefix trie of conversations by blocks of turns.

Every turn has a digest of its place, role and text, and a prefix of a conversation the exclusive
or of its turns' digests. Turns are first grouped into blocks of ``BLOCK``; the digest of a
block with all before it tells which conversations go the same way, so each distinct block is
one row with the number of its members, however many they are. A block without
siblings gives a node per turn at once, as all its turns have the block's members. Only where
siblings diverge are the blocks opened and grouped turn by turn.

What a node needs of its whole subtree comes from sums over its members. A node belongs to
its smallest member. A member's own nodes are the end of its path, so for all members but the
smallest they lie inside the subtree, and of the smallest those above the node are taken off
by a running sum along its path. No path is ever expanded into pairs of nodes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinlens.llm.texts import as_batch
from twinlens.operators.hotkeys import lookup
from twinlens.operators.scan import running
from twinlens.session import stored

#: Turns of a block.
BLOCK = 4
#: Characters of ids that travel as one row to the node's digest.
ID_TEXT = 1 << 16
_KEY = ["hi", "lo"]


def ordered(df: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, pos, first, second, chars) of every turn: pos counts from 1 by turn (null first); turns
    with one number follow by role, then digest. first and second are digests of role
    and text, chars the code points of the text. Null roles and texts are empty; a null id, or one
    that is no whole number, takes no part. Texts stay where they are: only digests travel."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    rows = df.select(
        F.col(id_col).try_cast("long").alias("conv_id"),
        F.col(turn_col).alias("turn"),
        role.alias("role"),
        F.xxhash64(F.lit(1), role, text).alias("first"),
        F.xxhash64(F.lit(2), text, role).alias("second"),
        F.char_length(text).cast("long").alias("chars"),
    ).where("conv_id is not null")
    order = [F.col("turn").asc_nulls_first(), "role", "first", "second"]
    return running(rows, ["conv_id"], order, {"pos": ("count", F.lit(1))}).select("conv_id", "pos", "first", "second", "chars")


def head_turns(conv_id: Column, most: int) -> Column:
    """How many turns a conversation takes over: crc32 of its decimal id modulo ``most``."""
    return F.pmod(F.crc32(conv_id.cast("string")), F.lit(most))


def grafted(turns: DataFrame, every: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """(turns, ids): each conversation c begins with the first h turns of c - c % ``every``, its own
    follow after the first h of them; h is ``head_turns``. At most ``every`` conversations
    (twice as many around 0) share a head, of fewer than ``most`` turns."""
    own = F.col("conv_id")
    sizes = turns.groupBy("conv_id").agg(F.max("pos").alias("size"))
    heads = sizes.select(F.col("conv_id").alias("base"), F.col("size").alias("there"))
    ids = stored(
        sizes.select("conv_id", (own - own % every).alias("base"), head_turns(own, most).alias("h"))
        .join(heads, "base", "left")
        .withColumn("there", F.least("h", F.coalesce("there", F.lit(0)))),
        "conversations",
    )
    first = turns.where((own % every == 0) & (F.col("pos") < most)).withColumnRenamed("conv_id", "base")
    head = first.join(ids, "base").where(F.col("pos") <= F.col("h")).select("conv_id", "pos", "first", "second", "chars")
    rest = turns.where(F.col("pos") > head_turns(own, most))
    moved = lookup(rest, ids.select("conv_id", (F.col("there") - F.col("h")).alias("by")), ["conv_id"])
    rest = moved.select("conv_id", (F.col("pos") + F.col("by")).alias("pos"), "first", "second", "chars")
    return head.unionByName(rest), ids.select("conv_id")


def _blocks(turns: DataFrame, block: int) -> tuple[DataFrame, DataFrame]:
    """(blocks, ends): the blocks of each conversation, (conv_id, block, hi, lo, above_hi, above_lo, turns),
    and the key (hi, lo) of each conversation's last prefix."""
    mark = lambda seed: F.xxhash64(F.lit(seed), "pos", "first", "second")
    own = turns.select("conv_id", "pos", "chars", mark(3).alias("own_hi"), mark(4).alias("own_lo"))
    rows = running(own, ["conv_id"], ["pos"], {"hi": ("xor", "own_hi"), "lo": ("xor", "own_lo")})
    rows = rows.withColumns({"up_hi": F.col("hi").bitwiseXOR(F.col("own_hi")), "up_lo": F.col("lo").bitwiseXOR(F.col("own_lo"))})
    turn = F.struct(F.col("pos").alias("depth"), "hi", "lo", "up_hi", "up_lo", "chars")
    grouped = rows.groupBy("conv_id", F.floor((F.col("pos") - 1) / block).alias("block")).agg(F.sort_array(F.collect_list(turn)).alias("turns"))  # ``block`` turns at most
    last = F.element_at("turns", -1)
    blocks = grouped.select(
        "conv_id", "block", last["hi"].alias("hi"), last["lo"].alias("lo"), F.col("turns")[0]["up_hi"].alias("above_hi"), F.col("turns")[0]["up_lo"].alias("above_lo"), "turns"
    )
    ends = rows.groupBy("conv_id").agg(F.max(F.struct("pos", "hi", "lo")).alias("e")).select("conv_id", "e.hi", "e.lo")
    return stored(blocks, "blocks"), ends


def _opened(ways: DataFrame, sums: dict[str, Column], diverged: bool) -> DataFrame:
    """Nodes of distinct blocks: (hi, lo, depth, up_hi, up_lo, chars, ...). Turns of blocks that
    diverge are grouped by their prefix; those of a block without siblings are nodes as they are."""
    carried = list(sums)
    rows = ways.select(*carried, F.explode("turns").alias("t")).select("t.*", *carried)
    if not diverged:
        return rows.select("hi", "lo", "depth", "up_hi", "up_lo", "chars", *carried)
    same = [F.min(c).alias(c) for c in ("depth", "up_hi", "up_lo", "chars")]
    return rows.groupBy("hi", "lo").agg(*same, *[c.alias(n) for n, c in sums.items()])


def id_digests(ends: DataFrame) -> DataFrame:
    """(hi, lo, ends_sha256): SHA-256 of the comma-joined ascending ids of each node's ``ends`` (conv_id, hi, lo).

    Ids are dealt by ranges, so a node that many conversations end at is written out by many
    tasks; what one task hashes for it are a few long texts, fed in order."""
    parts = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = ends.repartitionByRange(parts, "hi", "lo", "conv_id").sortWithinPartitions("hi", "lo", "conv_id")
    text_schema = pa.schema([("hi", pa.int64()), ("lo", pa.int64()), ("least", pa.int64()), ("ids", pa.string())])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, least, texts, size = None, None, [], 0
        done: list[tuple] = []
        for batch in batches:
            for i, hi, lo in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "hi", "lo")), strict=True):
                if key != (hi, lo) or size > ID_TEXT:
                    if texts:
                        done.append((*key, least, ",".join(texts)))
                    key, least, texts, size = (hi, lo), i, [], 0
                texts.append(str(i))
                size += len(texts[-1]) + 1
            if done:
                yield as_batch(text_schema, *zip(*done, strict=True))
                done = []
        if texts:
            yield as_batch(text_schema, *zip(*[(*key, least, ",".join(texts))], strict=True))

    written = rows.mapInArrow(write, "hi long, lo long, least long, ids string").repartition(parts, "hi", "lo").sortWithinPartitions("hi", "lo", "least")
    digest_schema = pa.schema([("hi", pa.int64()), ("lo", pa.int64()), ("ends_sha256", pa.string())])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            done: list[tuple] = []
            for hi, lo, ids in zip(*(batch.column(c).to_pylist() for c in ("hi", "lo", "ids")), strict=True):
                if key == (hi, lo):
                    state.update(b",")
                else:
                    if key is not None:
                        done.append((*key, state.hexdigest()))
                    key, state = (hi, lo), hashlib.sha256()
                state.update(ids.encode())
            if done:
                yield as_batch(digest_schema, *zip(*done, strict=True))
        if key is not None:
            yield as_batch(digest_schema, *zip(*[(*key, state.hexdigest())], strict=True))

    return written.mapInArrow(digest, "hi long, lo long, ends_sha256 string")


def trie(turns: DataFrame, ids: DataFrame | None = None, block: int = BLOCK) -> DataFrame:
    """The nodes of the prefix trie of ``turns`` (conv_id, pos, first, second, chars), one row each:
    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens and ends_sha256. The root is the node of depth 0.

    ``ids`` (conv_id) lists all conversations, also those without a turn, which end at the root.
    pos counts each conversation's turns from 1. Without any conversation there is no
    node, and no root. Prefixes are told apart by 128 bits."""
    ids = turns.select("conv_id").distinct() if ids is None else ids
    paths, ends = _blocks(turns, block)
    ends = stored(ids.join(ends, "conv_id", "left").select("conv_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in _KEY]), "ends")

    # distinct blocks, and those with siblings
    ways = stored(
        paths.groupBy("block", "hi", "lo", "above_hi", "above_lo").agg(F.first("turns").alias("turns"), F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id")), "ways"
    )
    several = ways.where("block > 0").groupBy("above_hi", "above_lo").agg(F.count(F.lit(1)).alias("kids")).where("kids > 1").drop("kids")
    above = ["above_hi", "above_lo"]
    later = ways.where("block > 0")
    split = stored(ways.where("block = 0").select(*_KEY).unionByName(lookup(later, several, above, "left_semi").select(*_KEY)), "diverged")
    open_ways, plain_ways = ways.join(split, _KEY, "left_semi"), ways.join(split, _KEY, "left_anti")

    members = {"n_convs": F.sum("n_convs"), "conv_id": F.min("conv_id")}
    bare = _opened(open_ways, members, True).unionByName(_opened(plain_ways, members, False))
    kids = bare.groupBy(F.col("up_hi").alias("hi"), F.col("up_lo").alias("lo")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = bare.join(kids, _KEY, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    saved = ((F.col("n_convs") - 1) * F.col("chars")).alias("saved")
    # along each conversation's own nodes: what is saved up to a node
    nodes = running(nodes.select("*", saved), ["conv_id"], ["depth"], {"upto": ("count", "saved")})

    # a conversation's own nodes, summed at all the nodes it is a member of
    owned = nodes.groupBy("conv_id").agg(F.sum("saved").alias("own_saved"), F.count(F.when(F.col("n_children") == 0, 1)).alias("own_leaves"))
    steps = lookup(paths.select("conv_id", *_KEY), owned, ["conv_id"])
    below = steps.groupBy(*_KEY).agg(F.sum("own_saved").alias("all_saved"), F.sum("own_leaves").alias("n_leaves"))
    sums = {"all_saved": F.sum("all_saved"), "n_leaves": F.sum("n_leaves")}
    whole = _opened(open_ways.join(below, _KEY), sums, True).unionByName(_opened(plain_ways.join(below, _KEY), sums, False)).select(*_KEY, *sums)

    # each node's parent; the children of the root need no join
    smallest = ends.agg(F.min("conv_id")).scalar()
    up = nodes.select(F.col("hi").alias("up_hi"), F.col("lo").alias("up_lo"), F.col("conv_id").alias("parent_conv_id"))
    deep = lookup(nodes.where("depth > 1"), up, ["up_hi", "up_lo"]).select(*_KEY, "parent_conv_id")
    parents = nodes.where("depth = 1").select(*_KEY, smallest.alias("parent_conv_id")).unionByName(deep)

    digests = id_digests(ends)
    none = F.sha2(F.lit("").cast("binary"), 256)
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    inner = (
        nodes.join(whole, _KEY)
        .join(parents, _KEY)
        .join(digests, _KEY, "left")
        .withColumn("saved_tokens", F.col("all_saved") - F.col("upto") + F.col("saved"))
        .withColumn("ends_sha256", F.coalesce("ends_sha256", none))
        .select(*names)
    )
    zero = F.lit(0).cast("long")
    at_root = digests.where("hi = 0 and lo = 0").select("ends_sha256").scalar()
    total = nodes.agg(F.coalesce(F.sum("saved"), zero).alias("saved"), F.count(F.when(F.col("n_children") == 0, 1)).alias("leaves"), F.count(F.when(F.col("depth") == 1, 1)).alias("kids"))
    root = ends.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0")
    root = root.select(
        "conv_id",
        zero.alias("depth"),
        F.lit(None).cast("long").alias("parent_conv_id"),
        "n_convs",
        total.select("kids").scalar().alias("n_children"),
        F.greatest(total.select("leaves").scalar(), F.lit(1)).alias("n_leaves"),
        total.select("saved").scalar().alias("saved_tokens"),
        F.coalesce(at_root, none).alias("ends_sha256"),
    )
    return inner.unionByName(root)
