"""The trie of conversation prefixes, from composable fingerprints of stored turns.

Every conversation is rebuilt from the head of a base conversation and the suffix of its own turns. No rebuilt text is ever made. A
stored turn has a letter (two 64-bit hashes of its role and text), and a sequence of turns has the product of its letters in a
monoid: (letters a, value x) * (letters b, value y) = (a + b, x B**b + y) modulo a prime, in two lanes. One scan over the turns
in order gives each turn the product of its conversation up to there; the product of a base's head and an own suffix follows
from three of those by arithmetic, and so does the product without the last turn, that is, the parent's.

Rebuilt prefixes with equal depth and product form a node. Both kinds of hashes are verified by way of the stored turns that they
refer to: equal letters must come from equal role and text, and all members of a node must have the same last letter and the same
parent's product; by induction their whole sequences are equal. If that ever fails, everything is hashed anew in another way (``SCHEMES``).

Skew: turns are dealt by range of (conv_id, turn), so a long conversation spans tasks, and the products of the conversations
at the edges of tasks (two a task) are composed on the driver. Subtree sums need no walk over the tree: a conversation *owns* the
nodes of which it is the smallest member, which are the last ones of its path; a node's leaves are the members that own a childless
node, and the words of its subtree's nodes are sums over its members, too. So everything comes from sums by node, partly made before
shuffles; joins on a conversation or parent tell hot keys (a thousandth of the rows or more, so at most a thousand of them) by
broadcast. Only the hash of a node's member ids runs through one task, in order, by chunks of ``CHUNK`` ids, in bounded memory:
SHA-256 can't be computed otherwise.

Turns are ordered by turn number, null first; of equal numbers by the MD5 of role, newline and text, and repeated rows count each. Null role
or text is empty. Rows without conv_id belong to no conversation and are left out; without conversations there is no root. Extra
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from linkweave.llm.common import cut

#: A conversation's base is the last multiple of so many; its head has fewer turns than HEADS.
FAMILY, HEADS = 20, 4
WORD = r"[^\x20\x09-\x0D]+"
CHUNK = 4096
#: Keys with one in so many rows are hot.
SHARE = 1000
NODE = ["depth", "fp1", "fp2"]


@dataclass(frozen=True)
class Scheme:
    """A way to hash: seed of letters and bases, bits of a letter, prime modulus of products."""

    seed: int
    bits: int = 64
    modulus: int = 2**61 - 1

    @property
    def bases(self) -> tuple[int, int]:
        a, b = (int.from_bytes(hashlib.sha256(f"{self.seed}:{i}".encode()).digest()[:8], "little") for i in (1, 2))
        return a % (self.modulus - 2) + 2, b % (self.modulus - 2) + 2


SCHEMES = tuple(Scheme(seed) for seed in range(1, 9))


class Collision(Exception):
    """Different turns or sequences have equal hashes."""


def stored_turns(conversations: DataFrame, scheme: Scheme) -> DataFrame:
    """(conv_id, turn, role, text, h1, h2) of each row that has a conversation."""
    t = conversations.select("conv_id", "turn", *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")]).filter("conv_id is not null")

    def letter(lane: int) -> Column:
        h = F.xxhash64(F.lit(2 * scheme.seed + lane), "role", "text")
        return h if scheme.bits == 64 else F.pmod(h, F.lit(1 << scheme.bits))

    return t.withColumns({"h1": letter(0), "h2": letter(1)})


def verify_letters(turns: DataFrame) -> None:
    """Equal letters refer to equal turns: contents are told apart exactly, copies go before the shuffle."""
    contents = turns.select("h1", "h2", "role", "text").distinct()
    if not contents.groupBy("h1", "h2").count().filter("count > 1").isEmpty():
        raise Collision


def in_order(turns: DataFrame) -> DataFrame:
    """(conv_id, h1, h2, words) dealt and sorted by conversation and turn."""
    t = turns.select("conv_id", "turn", F.md5(F.concat_ws("\n", "role", "text").cast("binary")).alias("tie"), "h1", "h2", F.regexp_count("text", F.lit(WORD)).cast("long").alias("words"))
    order = ["conv_id", F.asc_nulls_first("turn"), "tie"]
    return cut(t.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "h1", "h2", "words"))


class Product:
    """The product of some turns of one conversation: number, value of both lanes, words."""

    def __init__(self, scheme: Scheme, n: int = 0, v1: int = 0, v2: int = 0, words: int = 0):
        self.scheme, self.n, self.v1, self.v2, self.words = scheme, n, v1, v2, words

    def add(self, h1: int, h2: int, words: int) -> None:
        (b1, b2), m = self.scheme.bases, self.scheme.modulus
        self.n, self.v1, self.v2, self.words = self.n + 1, (self.v1 * b1 + h1) % m, (self.v2 * b2 + h2) % m, self.words + words

    def then(self, other: Product) -> Product:
        (b1, b2), m = self.scheme.bases, self.scheme.modulus
        return Product(self.scheme, self.n + other.n, (self.v1 * pow(b1, other.n, m) + other.v1) % m, (self.v2 * pow(b2, other.n, m) + other.v2) % m, self.words + other.words)


def carried(ordered: DataFrame, scheme: Scheme) -> dict[int, tuple[int, int, int, int, int]]:
    """For each task whose first conversation began before it: that conversation and the product of its turns so far."""

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, at = [], None
        for batch in batches:
            for c, h1, h2, w in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if c != at:
                    at = c
                    found = [*found[:1], (c, Product(scheme))]
                found[-1][1].add(h1, h2, w)
        if found:
            rows = [(TaskContext.get().partitionId(), i, c, p.n, p.v1, p.v2, p.words) for i, (c, p) in enumerate(found)]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows)], ["task", "i", "conv_id", "n", "v1", "v2", "words"])

    out, open_conv, so_far = {}, None, Product(scheme)
    for r in sorted(ordered.mapInArrow(edges, "task long, i long, conv_id long, n long, v1 long, v2 long, words long").collect()):
        mine = Product(scheme, *r[3:])
        if r["i"] == 0 and r["conv_id"] == open_conv:
            out[r["task"]] = (open_conv, so_far.n, so_far.v1, so_far.v2, so_far.words)
            so_far = so_far.then(mine)
        else:
            open_conv, so_far = r["conv_id"], mine
    return out


def scanned(ordered: DataFrame, scheme: Scheme) -> DataFrame:
    """(conv_id, pos, h1, h2, words, v1, v2, total): of each turn its place from 1, and product and words of its conversation up to it."""
    carry = carried(ordered, scheme)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, *rest = carry.get(TaskContext.get().partitionId(), (None,))
        p = Product(scheme, *rest)
        for batch in batches:
            rows = []
            for c, h1, h2, w in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if c != at:
                    at, p = c, Product(scheme)
                p.add(h1, h2, w)
                rows.append((c, p.n, h1, h2, w, p.v1, p.v2, p.words))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows)], ["conv_id", "pos", "h1", "h2", "words", "v1", "v2", "total"])

    return cut(ordered.mapInArrow(scan, "conv_id long, pos long, h1 long, h2 long, words long, v1 long, v2 long, total long"))


def joined(rows: DataFrame, told: DataFrame, keys: list[str], weight: str, total: int) -> DataFrame:
    """``rows`` with the columns of ``told`` (one row a key, ``weight`` rows of ``rows`` have it): hot keys by broadcast, others by shuffle."""
    hot = cut(told.filter(F.col(weight) * SHARE >= total))
    if hot.isEmpty():
        return rows.join(told, keys)
    cold = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(told.filter(F.col(weight) * SHARE < total), keys)
    return rows.join(F.broadcast(hot), keys).select(*cold.columns).unionByName(cold)


def rebuilt(turns: DataFrame, modulus: int) -> DataFrame:
    """Per conversation: length, all_words, its head (up to three stored turns), and what an own turn's product and words lack:
    (d1, d2) times the power of the own turns since the head, and ``more`` words."""
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(HEADS))
    t = turns.withColumn("h", h)
    at_h = [F.coalesce(F.max(F.when(F.col("pos") == F.col("h"), F.col(c))), F.lit(0)).alias(f"own_{c}") for c in ("v1", "v2", "total")]
    own = t.groupBy("conv_id", "h").agg(F.max("pos").alias("n"), F.max("total").alias("all_own"), *at_h).withColumn("base", F.col("conv_id") - F.col("conv_id") % FAMILY)
    stored = F.sort_array(F.collect_list(F.struct("pos", "h1", "h2", "words", "v1", "v2", "total")))  # fewer than HEADS
    heads = turns.filter((F.col("conv_id") % FAMILY == 0) & (F.col("pos") < HEADS)).groupBy(F.col("conv_id").alias("base")).agg(stored.alias("head"))
    c = own.join(heads, "base", "left").withColumn("head", F.expr("if(head is null or h = 0, null, slice(head, 1, cast(h as int)))"))
    c = c.withColumn("hp", F.coalesce(F.size("head"), F.lit(0)).cast("long")).withColumn("hp", F.greatest("hp", F.lit(0)))
    last = {x: F.coalesce(F.element_at("head", -1)[x], F.lit(0)) for x in ("v1", "v2", "total")}
    rest = F.greatest(F.col("n") - F.col("h"), F.lit(0))
    return cut(c.select(
        "conv_id", "h", "hp", "head", (F.col("hp") + rest).alias("length"), F.col("n").alias("own_rows"),
        F.pmod(last["v1"] - F.col("own_v1"), F.lit(modulus)).alias("d1"), F.pmod(last["v2"] - F.col("own_v2"), F.lit(modulus)).alias("d2"),
        (last["total"] - F.col("own_total")).alias("more"), (last["total"] + F.when(rest > 0, F.col("all_own") - F.col("own_total")).otherwise(F.lit(0))).alias("all_words"),
    ))


def prefixes(turns: DataFrame, convs: DataFrame, scheme: Scheme) -> DataFrame:
    """One row a rebuilt turn: conv_id, depth, product (fp1, fp2), the parent's (up1, up2), letter, words, total, last."""
    head = convs.select("conv_id", "length", F.explode("head").alias("t")).select("conv_id", F.col("t.pos").alias("depth"), *[f"t.{x}" for x in ("h1", "h2", "words", "v1", "v2", "total")], (F.col("t.pos") == F.col("length")).alias("last"), F.lit(0).cast("long").alias("d1"), F.lit(0).cast("long").alias("d2"), F.lit(0).cast("long").alias("j"))
    own = joined(turns, convs.drop("head"), ["conv_id"], "own_rows", turns.count()).filter("pos > h").withColumns({"j": F.col("pos") - F.col("h"), "total": F.col("total") + F.col("more")})
    own = own.withColumn("depth", F.col("hp") + F.col("j")).withColumn("last", F.col("depth") == F.col("length")).select(*head.columns)
    (b1, b2), m = scheme.bases, scheme.modulus
    i1, i2 = pow(b1, -1, m), pow(b2, -1, m)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = {x: batch.column(x).to_pylist() for x in ("h1", "h2", "v1", "v2", "d1", "d2", "j")}
            fp = [((v + d * pow(b1, j, m)) % m, (w + e * pow(b2, j, m)) % m) for v, w, d, e, j in zip(col["v1"], col["v2"], col["d1"], col["d2"], col["j"])]
            up = [((f - h) * i1 % m, (g - k) * i2 % m) for (f, g), h, k in zip(fp, col["h1"], col["h2"])]
            made = [pa.array([x[i] for x in y], pa.int64()) for y in (fp, up) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*[batch.column(x) for x in ("conv_id", "depth", "h1", "h2", "words", "total", "last")], *made], ["conv_id", "depth", "h1", "h2", "words", "total", "last", "fp1", "fp2", "up1", "up2"])

    return cut(head.unionByName(own).mapInArrow(finish, "conv_id long, depth long, h1 long, h2 long, words long, total long, last boolean, fp1 long, fp2 long, up1 long, up2 long"))


def nodes_of(rows: DataFrame) -> DataFrame:
    """Nodes under the root: smallest member, number of members, words, words up to it, parent; verified."""
    same = [f(x).alias(f"{n}_{x}") for x in ("h1", "h2", "up1", "up2") for n, f in (("min", F.min), ("max", F.max))]
    n = rows.groupBy(*NODE).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.min("words").alias("words"), F.min("total").alias("total"), *same)
    n = cut(n.withColumnsRenamed({"min_up1": "up1", "min_up2": "up2"}))
    if not n.filter("min_h1 <> max_h1 or min_h2 <> max_h2 or up1 <> max_up1 or up2 <> max_up2").isEmpty():
        raise Collision
    return n.select(*NODE, "conv_id", "n_convs", "words", "total", "up1", "up2")


def with_family(nodes: DataFrame) -> DataFrame:
    """Adds n_children and parent_conv_id (null under the root)."""
    children = nodes.groupBy((F.col("depth") - 1).alias("depth"), F.col("up1").alias("fp1"), F.col("up2").alias("fp2")).agg(F.count("*").alias("n_children"))
    n = cut(nodes.join(children, NODE, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))))
    parents = n.filter("n_children > 0").select((F.col("depth") + 1).alias("depth"), F.col("fp1").alias("up1"), F.col("fp2").alias("up2"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("k"))
    lower = joined(n.filter("depth > 1"), parents, ["depth", "up1", "up2"], "k", n.count()).drop("k")
    return cut(lower.unionByName(n.filter("depth = 1").withColumn("parent_conv_id", F.lit(None).cast("long"))))


def subtree_sums(rows: DataFrame, nodes: DataFrame, convs: DataFrame) -> DataFrame:
    """Per node: n_leaves and saved_tokens of its subtree, as sums over its members."""
    own = nodes.groupBy("conv_id").agg(F.min("depth").alias("d0"), F.min(F.col("total") - F.col("words")).alias("before"), F.max((F.col("n_children") == 0).cast("long")).alias("leaf"))
    told = convs.filter("length > 0").select("conv_id", "length", "all_words").join(own, "conv_id", "left")
    r = joined(rows.select("conv_id", *NODE, (F.col("total") - F.col("words")).alias("sofar")), told, ["conv_id"], "length", rows.count())
    once = F.when(F.col("d0").isNull(), F.lit(0)).otherwise(F.col("all_words") - F.greatest("sofar", "before"))
    return r.groupBy(*NODE).agg(F.sum(F.coalesce("leaf", F.lit(0))).alias("n_leaves"), F.sum(F.col("all_words") - F.col("sofar") - once).alias("saved_tokens"))


def ends(rows: DataFrame) -> DataFrame:
    """Per node that has some: ``ends_sha256`` of the ids of ``rows`` (NODE, conv_id), ascending, comma-joined."""
    order = [*NODE, "conv_id"]

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[list] = []
            for *node, c in zip(*(batch.column(x).to_pylist() for x in order)):
                if not found or found[-1][0] != node or len(found[-1][1]) == CHUNK:
                    found.append([node, []])
                found[-1][1].append(c)
            if found:
                cols = [*(pa.array(x, pa.int64()) for x in zip(*(n for n, _ in found))), pa.array([ids[0] for _, ids in found], pa.int64()), pa.array([",".join(map(str, ids)) for _, ids in found])]
                yield pa.RecordBatch.from_arrays(cols, [*order, "ids"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, sha = None, None
        for batch in batches:
            done = []
            for *node, ids in zip(*(batch.column(x).to_pylist() for x in [*NODE, "ids"])):
                if node != at:
                    done += [(*at, sha.hexdigest())] if at else []
                    at, sha = node, hashlib.sha256(ids.encode())
                else:
                    sha.update(b"," + ids.encode())
            if done:
                yield pa.RecordBatch.from_arrays(list(map(pa.array, zip(*done))), [*NODE, "ends_sha256"])
        if at:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*at, sha.hexdigest())], [*NODE, "ends_sha256"])

    parts = rows.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(chunks, "depth long, fp1 long, fp2 long, conv_id long, ids string")
    return parts.repartition(*NODE).sortWithinPartitions(*order).mapInArrow(hashed, "depth long, fp1 long, fp2 long, ends_sha256 string")


def root_of(convs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The root's row, or none without conversations."""
    n, least = convs.agg(F.count("*"), F.min("conv_id")).first()
    first, leaves, saved = nodes.agg(F.count_if(F.col("depth") == 1), F.count_if(F.col("n_children") == 0), F.coalesce(F.sum((F.col("n_convs") - 1) * F.col("words")), F.lit(0))).first()
    row = {"depth": 0, "fp1": 0, "fp2": 0, "conv_id": least, "parent_conv_id": None, "n_convs": n, "n_children": first, "n_leaves": leaves or 1, "saved_tokens": saved}
    return convs.sparkSession.range(1 if n else 0).select(*[F.lit(v).cast("long").alias(k) for k, v in row.items()])


def _trie(conversations: DataFrame, scheme: Scheme) -> DataFrame:
    turns = stored_turns(conversations, scheme)
    verify_letters(turns)
    turns = scanned(in_order(turns), scheme)
    convs = rebuilt(turns, scheme.modulus)
    rows = prefixes(turns, convs, scheme)
    nodes = with_family(nodes_of(rows))
    root = root_of(convs, nodes)
    least = convs.agg(F.min("conv_id")).first()[0]
    under = nodes.join(subtree_sums(rows, nodes, convs), NODE).withColumn("parent_conv_id", F.coalesce("parent_conv_id", F.lit(least).cast("long")))
    turnless = convs.filter("length = 0").select(*[F.lit(0).cast("long").alias(x) for x in NODE], "conv_id")
    closed = ends(rows.filter("last").select(*NODE, "conv_id").unionByName(turnless))
    out = under.select(*root.columns).unionByName(root).join(closed, NODE, "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """Per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    for scheme in SCHEMES:
        try:
            return _trie(conversations, scheme)
        except Collision:
            continue
    raise RuntimeError("hashes collide under all schemes")


def _oracle() -> str:
    table = []
    for x in range(16):  # the CRC-32 of a nibble
        for _ in range(4):
            x = x >> 1 ^ (0xEDB88320 if x & 1 else 0)
        table.append(x)
    nibbles = "flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda ch: [ascii(ch) & 15, ascii(ch) >> 4]))"
    crc = f"list_reduce(list_prepend(4294967295, list_transform({nibbles}, lambda x: CAST(x AS BIGINT))), lambda c, b: xor(c >> 4, {table}[(xor(c, b) & 15) + 1]))"
    return f"""WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(coalesce(role, '') || chr(10) || coalesce(text, ''))) AS pos, coalesce(role, '') AS role, coalesce(text, '') AS text
 FROM conversations WHERE conv_id IS NOT NULL), c0 AS (SELECT conv_id, max(pos) AS n, xor({crc}, 4294967295) % 4 AS h FROM t GROUP BY conv_id),
 c AS (SELECT c0.*, least(c0.h, coalesce(b.n, 0)) AS hp FROM c0 LEFT JOIN c0 b ON b.conv_id = c0.conv_id - c0.conv_id % 20),
 r AS (SELECT c.conv_id, pos AS depth, role, text FROM c JOIN t ON t.conv_id = c.conv_id - c.conv_id % 20 AND pos <= h UNION ALL SELECT c.conv_id, pos - h + hp, role, text FROM c JOIN t ON t.conv_id = c.conv_id AND pos > h),
 p AS (SELECT conv_id, depth, array_agg([role, text]) OVER w AS path, len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS words, lead(depth) OVER w IS NULL AS last FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY depth)),
 m AS (SELECT * FROM p UNION ALL SELECT conv_id, 0, [], 0, conv_id NOT IN (SELECT conv_id FROM r) FROM c),
 n AS (SELECT depth, path, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(words) AS words, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (last), '')) AS ends_sha256 FROM m GROUP BY 1, 2),
 k AS (SELECT depth - 1 AS depth, path[1 : depth - 1] AS path, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1, 2),
 f AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k ON k.depth = n.depth AND k.path = n.path),
 s AS (SELECT v.depth, v.path, count(*) FILTER (w.n_children = 0) AS n_leaves, sum((w.n_convs - 1) * w.words) AS saved FROM f v JOIN f w ON w.depth >= v.depth AND w.path[1 : v.depth] = v.path GROUP BY 1, 2)
 SELECT f.conv_id, CAST(f.depth AS BIGINT) AS depth, u.conv_id AS parent_conv_id, f.n_convs, f.n_children, n_leaves, CAST(saved AS BIGINT) AS saved_tokens, f.ends_sha256
 FROM f JOIN s ON s.depth = f.depth AND s.path = f.path LEFT JOIN f u ON u.depth = f.depth - 1 AND u.path = f.path[1 : f.depth - 1]"""


ORACLE = _oracle()
