"""Prefix trie of conversations by depth-band rollup.

A node is a sequence of first turns. Its name is its depth and two 64-bit digests: each turn's hash with its place, combined by exclusive or over the
turns so far, so that names come from running totals within chunks of 1,024 turns and need neither the text nor a pass along a whole conversation.
Two of n nodes share a name by chance with odds of n²/2¹²⁹.

What a subtree adds up to is rolled up along bands of a fixed height. A node hands its value to its ancestors within its band only. Those lie on the
path of its smallest member, so a window over (conversation, band), 16 rows at most, adds up what is handed to each ancestor before it is shuffled.
The tops of bands, with their bands' totals, are a tree of a sixteenth of the depth and are rolled up alike, level by level; then completed totals of
band tops go down again, each to the ancestors in the band above it. A trie of depth d takes 2 log16(d) rounds, and no level makes more rows than the
paths have.

Defined results: null roles and texts are empty; rows without conv_id belong to no conversation and are left out; null turns come first, and rows that
tie in turn come in the order of the MD5 of their role and text; repeated rows are turns of their own; an empty table has no nodes, not even a root;
of other columns none is read.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framejobs.llm._joins import join_frequent
from framejobs.llm._session import with_checkpoints
from framejobs.operators.scan import ranked

#: Levels of a band, turns of a chunk of running digests, and conversation ids that are joined to one piece of text before they are hashed.
BAND, CHUNK, IDS = 16, 1024, 8192
KEY = ["depth", "k1", "k2"]


def ordered_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, digest, n_chars, n_turns): turns by their place from 1, with the hash of their role and text, code points of the text, and the
    number of turns of the conversation."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text))
    cut = turns.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn"), digest.alias("digest"), F.length(text).cast("long").alias("n_chars")
    )
    return ranked(cut, ["conv_id"], [F.col("turn").asc_nulls_first(), F.col("digest").asc()], "depth", total="n_turns").drop("turn")


def with_shared_heads(turns: DataFrame, group: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """Conversations c rebuilt from ordered turns: the first h turns of conversation c - c % group, h = crc32(c) % most, then c's own after its
    first h. Returns the turns (conv_id, depth, digest, n_chars) and the conversations (conv_id, n_turns), which may have none."""
    own = turns.groupBy("conv_id").agg(F.max("n_turns").alias("n_own"))
    own = own.withColumns({"h": F.crc32(F.col("conv_id").cast("string").cast("binary")) % most, "base": F.col("conv_id") - F.col("conv_id") % group})
    bases = own.select(F.col("conv_id").alias("base"), F.col("n_own").alias("n_base"))
    plan = own.join(bases, "base", "left").withColumn("n_head", F.least("h", F.coalesce("n_base", F.lit(0))))
    plan = plan.withColumn("n_turns", F.col("n_head") + F.greatest(F.lit(0), F.col("n_own") - F.col("h"))).checkpoint()

    heads = turns.filter(F.col("depth") < most).select(F.col("conv_id").alias("base"), "depth", "digest", "n_chars")
    heads = plan.join(heads, "base").filter("depth <= n_head").select("conv_id", "depth", "digest", "n_chars")
    # A conversation's own turns need two small numbers of it. Those of long ones are many rows with one key, so the long ones' plans are broadcast.
    rest = join_frequent(turns.select("conv_id", "depth", "digest", "n_chars"), plan.select("conv_id", "h", "n_head", "n_own"), "conv_id", "n_own", plan.agg(F.sum("n_own")).first()[0] or 0)
    rest = rest.filter("depth > h").select("conv_id", (F.col("depth") - F.col("h") + F.col("n_head")).alias("depth"), "digest", "n_chars")
    return heads.unionByName(rest), plan.select("conv_id", "n_turns")


def _named(turns: DataFrame) -> DataFrame:
    """Adds the digests k1 and k2 of each turn's prefix, and p1 and p2 of the prefix before it."""
    hashes = {"h1": F.xxhash64("depth", "digest"), "h2": F.xxhash64("digest", "depth", F.lit("second"))}
    rows = turns.withColumns(hashes).withColumn("chunk", F.floor((F.col("depth") - 1) / CHUNK))
    so_far = Window.partitionBy("conv_id", "chunk").orderBy("depth")
    local = rows.withColumns({f"k{i}": F.bit_xor(f"h{i}").over(so_far) for i in (1, 2)})
    chunks = rows.groupBy("conv_id", "chunk").agg(*(F.bit_xor(f"h{i}").alias(f"t{i}") for i in (1, 2)))
    before = Window.partitionBy("conv_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = chunks.select("conv_id", "chunk", *(F.bit_xor(f"t{i}").over(before).alias(f"b{i}") for i in (1, 2))).filter("chunk > 0")
    out = local.join(chunks, ["conv_id", "chunk"], "left").withColumns({f"k{i}": F.col(f"k{i}").bitwiseXOR(F.coalesce(f"b{i}", F.lit(0))) for i in (1, 2)})
    return out.select("conv_id", "depth", "k1", "k2", *(F.col(f"k{i}").bitwiseXOR(F.col(f"h{i}")).alias(f"p{i}") for i in (1, 2)), "n_chars")


def roll_up(paths: DataFrame, values: DataFrame, deepest: int, band: int = BAND) -> DataFrame:
    """(depth, k1, k2, leaves, saved): for each node the sums over its subtree.

    ``paths``: (conv_id, depth, k1, k2) of every conversation from depth 0. ``values``: (conv_id, depth, leaves, saved) of every node, with its smallest
    member, on whose path its ancestors lie.
    """
    sums = [F.sum(c).alias(c) for c in ("leaves", "saved")]
    name = [F.min("conv_id").alias("conv_id"), *sums]  # the smallest member of a node is among those that hand it something
    levels, step = [], 1
    while True:
        # Up: each node to its ancestors within the band; those of one conversation are added up on its path.
        rows = paths.filter(F.col("depth") % step == 0).select("conv_id", *KEY, F.lit(None).cast("long").alias("leaves"), F.lit(None).cast("long").alias("saved"))
        given = values.select("conv_id", "depth", F.lit(None).cast("long").alias("k1"), F.lit(None).cast("long").alias("k2"), "leaves", "saved")
        below = Window.partitionBy("conv_id", F.floor(F.col("depth") / (step * band))).orderBy(F.col("depth").desc()).rangeBetween(Window.unboundedPreceding, 0)
        handed = rows.unionByName(given).withColumns({c: F.sum(c).over(below) for c in ("leaves", "saved")}).filter("k1 is not null and leaves is not null")
        levels.append(handed.groupBy(*KEY).agg(*name).checkpoint())
        if step * band > deepest:
            break
        step *= band
        values = levels[-1].filter(F.col("depth") % step == 0).select("conv_id", "depth", "leaves", "saved")
    done = levels.pop()
    while levels:
        # Down: the completed top of a band to its ancestors in the band above.
        low = step // band
        tops = done.filter("depth > 0").select("conv_id", F.floor(F.col("depth") / step - 1).alias("band"), "leaves", "saved")
        rows = paths.filter(F.col("depth") % low == 0).withColumn("band", F.floor(F.col("depth") / step))
        handed = rows.join(tops, ["conv_id", "band"]).select("conv_id", *KEY, "leaves", "saved")
        done = levels.pop().unionByName(handed).groupBy(*KEY).agg(*name)
        if levels:
            done = done.checkpoint()
        step = low
    return done.select(*KEY, "leaves", "saved")


def _ends(conversations: DataFrame, paths: DataFrame) -> DataFrame:
    """(depth, k1, k2, ends_sha256): digest of the ids of the conversations that end in a node. Ids are joined to pieces of text of one range of ids
    each; a node's pieces pass through the digest one after the other, so that no list of them is ever held."""
    at = paths.select("conv_id", *KEY).join(conversations.select("conv_id", F.col("n_turns").alias("depth")), ["conv_id", "depth"])
    pieces = at.groupBy(*KEY, F.floor(F.col("conv_id") / IDS).alias("piece")).agg(F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))

    def digest(batches):
        key = sha = None
        for b in batches:
            out = []
            for *this, ids in zip(*(b.column(c).to_pylist() for c in (*KEY, "ids")), strict=True):
                if this != key:
                    if sha:
                        out.append((*key, sha.hexdigest()))
                    key, sha = this, hashlib.sha256(ids.encode())
                else:
                    sha.update(b"," + ids.encode())
            yield _rows(out)
        if sha:
            yield _rows([(*key, sha.hexdigest())])

    sorted_pieces = pieces.repartition(*KEY).sortWithinPartitions(*KEY, "piece")
    return sorted_pieces.mapInArrow(digest, "depth long, k1 long, k2 long, ends_sha256 string")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64()] * 3 + [pa.string()], strict=True)], names=[*KEY, "ends_sha256"])


def prefix_trie(turns: DataFrame, conversations: DataFrame, band: int = BAND) -> DataFrame:
    """One row for each distinct sequence of first turns, from the empty one: conv_id (its smallest member), depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256. ``turns``: (conv_id, depth, digest, n_chars); ``conversations``: (conv_id, n_turns), each once.
    A node's own turn is turn ``depth`` of its ``conv_id``."""
    with_checkpoints(turns.sparkSession)
    zero = {c: F.lit(0).cast("long") for c in ("depth", "k1", "k2", "p1", "p2", "n_chars")}
    paths = _named(turns).unionByName(conversations.select("conv_id").withColumns(zero)).checkpoint()
    nodes = paths.groupBy(*KEY).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), *(F.first(c).alias(c) for c in ("p1", "p2", "n_chars")))
    up = [(F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2")]
    children = nodes.filter("depth > 0").select(*up).groupBy(*KEY).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(children, KEY, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))).checkpoint()
    n, deepest = nodes.agg(F.count("*"), F.max("depth")).first()

    own = nodes.select("conv_id", "depth", F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long").alias("leaves"), ((F.col("n_convs") - 1) * F.col("n_chars")).alias("saved"))
    totals = roll_up(paths.select("conv_id", *KEY), own, deepest or 0, band)

    parents = nodes.filter("n_children > 0").select(*KEY, F.col("conv_id").alias("parent_conv_id"), "n_children")
    lower = nodes.filter("depth > 0").select(*up, F.col("depth").alias("d"), F.col("k1").alias("a"), F.col("k2").alias("b"))
    named = join_frequent(lower, parents, KEY, "n_children", n).select(F.col("d").alias("depth"), F.col("a").alias("k1"), F.col("b").alias("k2"), "parent_conv_id")

    out = nodes.join(totals, KEY).join(named, KEY, "left").join(_ends(conversations, paths), KEY, "left")
    return out.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of rebuilt conversations."""
    turns = ordered_turns(with_checkpoints(spark).read.parquet(f"{sf_dir}/conversations.parquet"))
    return prefix_trie(*with_shared_heads(turns))


OP13_SQL = """with o as (select conv_id, coalesce(role, '') as role, coalesce(text, '') as text,
  row_number() over (partition by conv_id order by turn nulls first, md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) as pos
  from conversations where conv_id is not null),
b as (select conv_id as c, conv_id - conv_id % 100 as base, conv_id::varchar as s from (select distinct conv_id from o)),
x as (select c, base, list_reduce(list_prepend(4294967295::bigint, list_transform(range(1, length(s) + 1), lambda i: unicode(substr(s, i, 1))::bigint)),
  lambda a, v: list_reduce(list_prepend(xor(a, v), [0, 0, 0, 0, 0, 0, 0, 0]::bigint[]), lambda p, z: case when p & 1 = 1 then xor(p >> 1, 3988292384) else p >> 1 end)) as raw from b),
k as (select c, base, xor(raw, 4294967295) % 6 as h from x),
head as (select c, pos, role, text from k join o on o.conv_id = base and pos <= h),
heads as (select c, count(*) as n from head group by 1),
r as (select * from head union all select k.c, coalesce(n, 0) + pos - h, role, text from k join o on o.conv_id = k.c and pos > h left join heads on heads.c = k.c),
p as (select c, pos as depth, length(text) as chars, list({'r': role, 't': text}) over w as path from r window w as (partition by c order by pos)
  union all select c, 0, 0, [] from k),
q as (select c, depth, chars, md5(path::varchar) as key, md5(list_slice(path, 1, depth - 1)::varchar) as up, depth = max(depth) over (partition by c) as ends from p),
n as (select depth, key, min(c) as conv_id, any_value(up) as up, count(*) as n_convs, any_value(chars) as chars,
  sha256(coalesce(string_agg(c::varchar, ',' order by c) filter (ends), '')) as ends_sha256 from q group by 1, 2),
f as (select up as key, depth - 1 as depth, count(*) as n_children from n where depth > 0 group by 1, 2),
m as (select n.*, coalesce(n_children, 0) as n_children from n left join f on f.key = n.key and f.depth = n.depth),
t as (select q.key, q.depth, sum((m.n_children = 0)::int) as n_leaves, sum((m.n_convs - 1) * m.chars) as saved_tokens from m join q on q.c = m.conv_id and q.depth <= m.depth group by 1, 2)
select m.conv_id, m.depth::bigint as depth, u.conv_id as parent_conv_id, m.n_convs, m.n_children, n_leaves::bigint as n_leaves, saved_tokens::bigint as saved_tokens, m.ends_sha256
from m join t on t.key = m.key and t.depth = m.depth left join m u on u.key = m.up and u.depth = m.depth - 1"""
