"""N-gram Jaccard join by vertical partitioning, and the connected components of its links.

A document's set holds its distinct shingles of ``width`` words. Two documents link when their Jaccard coefficient is
``percent``/100 or more. Documents with equal sets form a class; only one member of a class takes part.

The global n-gram order is by hash, and it is cut into fragments that count on their own; counts are summed per document or pair.

1. Documents that can't link with any other are left out. Of each set the first ``SENT`` percent in the order go to
   their fragments, and each fragment counts which of them another set holds too. The counts are summed per
   document: a set that links shares (percent + SENT - 100) percent of its n-grams there. N-grams are told by 24 bits of their
   hash in a fragment, so counts may be too high, never too low. The sets that stay are written once.
2. Among those the order puts the most frequent n-grams (a bounded list of heavy hitters) at its end, and links
   start from prefixes in it: the shorter set shares an n-gram of its short prefix with one of the longer set's long
   prefix, and the positions bound the overlap. Each fragment finds the candidates among its own n-grams. An n-gram of at most
   ``LIST`` classes gives all its pairs; entries of others, and of heavy hitters, go on as rows.
3. Those long lists are joined in two rounds, so that no group emits all its pairs: first each entry with its list's leader (the
   class with the largest share of its prefix in long lists) and some members drawn by hash; once these links' components are known, each
   entry outside its list's main component with all entries of other components, under the
   bounds of lengths, places and bitmaps. Pairs within a component need no test.
4. Candidates whose sets can't overlap enough fall to an upper bound: hashed parity bitmaps, four bits per n-gram or more,
   differ in no more places than the sets do.
5. The others are verified by partial overlaps: both sets are cut at fixed points of the order, each fragment
   counts its common n-grams, and the counts are summed per pair. A leader of many pairs is salted.

The result is exact up to collisions of 64-bit n-gram hashes. Words are runs without ASCII white space, A-Z
lower-cased; with fewer words than ``width`` the whole sequence is one n-gram; null or blank texts have an empty set and link
with nothing. Repeated rows are members of one class; a row with a null doc_id takes part only through a class that has
an id, whose component it then gets. Extra columns
are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from linkweave.llm import shingles
from linkweave.llm.common import cut
from linkweave.operators.components import connected_components

#: Longest list of classes whose pairs are all taken in a fragment; longer ones are joined in rounds.
LIST = 8
#: Heavy hitters: at most so many n-grams, each in at least so many documents of one batch and in all.
HEAVY, HEAVY_IN_BATCH, HEAVY_IN_ALL = 100_000, 4, 32
ENTRIES_PER_FRAGMENT = 200_000
#: Percent of each set that the count of shared n-grams sees; its fragments hold about SHARED_PER_FRAGMENT of 2**CODE_BITS codes.
SENT, SHARED_PER_FRAGMENT, CODE_BITS = 40, 1_000_000, 24
#: N-grams and sets (told by 16 bits) of a batch whose messages go out together; MANY: held by several sets of the batch.
BATCH_ENTRIES, BATCH_SETS, MANY = 1_000_000, 20_000, 0xFFFF
#: Bytes of text for an n-gram, about.
GRAM_TEXT = 6
#: Fragments of the order in which partial overlaps are counted, and pairs of one leader in one task.
OVERLAP_FRAGMENTS, PAIRS_PER_SALT = 4, 512
#: Sets that are needed are told to a scan by broadcast up to this many, else by shuffle join.
BROADCAST_SETS = 400_000
ROWS = 512
#: Sets whose n-grams a task holds together.
SLICE = 2_048
LEAST_BITS, MOST_BITS = 256, 1 << 20
#: Long lists are joined under a bound from bitmaps of so many longs.
SKETCH = 32
#: Members of a list, drawn by hash, that all its entries are first compared with besides the leader.
PROBES = 2
#: N-grams before each entry of a long list that tell whether two sets have met already.
BEFORE = 8


@dataclass(frozen=True)
class Likeness:
    percent: int = 75
    width: int = 5
    sent_percent: int = SENT
    gram_text: int = GRAM_TEXT

    def sets(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """Of each text its sorted distinct 64-bit hashes."""
        return shingles.sets(texts, self.width)

    def name(self, h: np.ndarray) -> bytes:
        """A set's class, of the same length for all sets."""
        return digest(h)

    def probe(self, n: np.ndarray) -> np.ndarray:
        return n - -(-self.percent * n // 100) + 1

    def index(self, n: np.ndarray) -> np.ndarray:
        return n - -(-2 * self.percent * n // (100 + self.percent)) + 1

    def sent(self, n: int) -> int:
        """How many n-grams of a set of n take part in the count of shared ones: never fewer than its long prefix."""
        return max(-(-self.sent_percent * n // 100), n - -(-self.percent * n // 100) + 1)

    def least_shared(self, n: int) -> int:
        """So many of those are shared if the set links. A link has percent/100 * max(n, m) common n-grams or more, and the
        sets of n and m leave out (100 - sent_percent)/100 * max(n, m) at most."""
        return max(1, (self.percent + self.sent_percent - 100) * n // 100)

    def linked(self, common: str, a: str, b: str) -> str:
        return f"{100 + self.percent} * {common} >= {self.percent} * ({a} + {b})"


def digest(h: np.ndarray) -> bytes:
    """A set's class: two independent 64-bit sums over its hashes."""
    return np.array([h.sum(), shingles.mixed(h ^ np.uint64(0x5851F42D4C957F2D)).sum()], np.uint64).tobytes()


def parity(h: np.ndarray) -> bytes:
    """A bitmap of four bits per n-gram or more: whether an odd number of hashes fall on each place."""
    bits = min(max(LEAST_BITS, 1 << max(4 * len(h) - 1, 1).bit_length()), MOST_BITS)
    return np.packbits((np.bincount((h & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)).tobytes()


def sketch(h: np.ndarray) -> list[int]:
    """A parity bitmap of 64 * SKETCH places as longs."""
    odd = (np.bincount((h & np.uint64(64 * SKETCH - 1)).astype(np.int64), minlength=64 * SKETCH) & 1).astype(np.uint8)
    return np.packbits(odd).view(np.int64).tolist()


def differing(a: bytes, b: bytes) -> int:
    """Places in which two bitmaps differ: at most the size of the sets' symmetric difference. Longer ones are folded."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def all_sets(texts: pd.Series, like: Likeness) -> Iterator[np.ndarray]:
    for at in range(0, len(texts), ROWS):
        yield from like.sets(list(texts.iloc[at : at + ROWS]))


def shapes(like: Likeness):
    """A column function: size and class (null for the empty set) of each text."""

    @F.pandas_udf("n long, class binary")
    def of(texts: pd.Series) -> pd.DataFrame:
        found = [(len(h), digest(h) if len(h) else None) for h in all_sets(texts, like)]
        return pd.DataFrame(found, columns=["n", "class"])

    return of


MESSAGE = "batch long, fragment int, classes binary, body binary"


def batch_messages(classes: list[bytes], sizes: list[int], held: list[np.ndarray], fragments: int, like: Likeness) -> pd.DataFrame:
    """MESSAGE rows of some sets. One row has the classes, and in ``body`` how many shared n-grams each needs from other
    batches; the others have a fragment's codes, each once, and their owners."""
    owner, grams = np.repeat(np.arange(len(held)), [len(h) for h in held]), np.concatenate(held)
    key = (((grams >> np.uint64(32)) * np.uint64(fragments)) >> np.uint64(32)).astype(np.int64) << CODE_BITS
    key |= (grams & np.uint64((1 << CODE_BITS) - 1)).astype(np.int64)
    order = np.argsort(key)
    key, owner = key[order], owner[order]
    first = np.append(True, key[1:] != key[:-1])
    shared = ~first
    shared[:-1] |= shared[1:]
    needed = np.array([like.least_shared(n) for n in sizes]) - np.bincount(owner[shared], minlength=len(sizes))
    key, owner = key[first], np.where(shared, MANY, owner)[first].astype("<u2")
    code = np.ascontiguousarray((key & ((1 << CODE_BITS) - 1)).astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3])
    all_classes = b"".join(classes)
    batch = int.from_bytes(hashlib.blake2b(all_classes, digest_size=8).digest(), "little", signed=True)
    cuts = np.searchsorted(key, np.arange(fragments + 1) << CODE_BITS).tolist()
    used = [f for f in range(fragments) if cuts[f + 1] > cuts[f]]
    bodies = [code[cuts[f] : cuts[f + 1]].tobytes() + owner[cuts[f] : cuts[f + 1]].tobytes() for f in used]
    return pd.DataFrame({"batch": batch, "fragment": [batch % fragments, *used], "classes": [all_classes, *[None] * len(used)], "body": [needed.astype("<i4").tobytes(), *bodies]})


def messages(documents: DataFrame, fragments: int, like: Likeness) -> DataFrame:
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        classes, sizes, held, total = {}, [], [], 0
        for p in parts:
            for h in all_sets(p["text"], like):
                if not len(h) or (c := like.name(h)) in classes:
                    continue
                classes[c] = len(sizes)
                sizes.append(len(h))
                held.append(h[: like.sent(len(h))].copy())
                total += len(held[-1])
                if total >= BATCH_ENTRIES or len(sizes) >= BATCH_SETS:
                    yield batch_messages(list(classes), sizes, held, fragments, like)
                    classes, sizes, held, total = {}, [], [], 0
        if sizes:
            yield batch_messages(list(classes), sizes, held, fragments, like)

    return documents.select("text").mapInPandas(run, MESSAGE)


def opened(body: bytes) -> tuple[np.ndarray, np.ndarray]:
    m = len(body) // 5
    code = np.zeros((m, 4), np.uint8)
    code[:, :3] = np.frombuffer(body, np.uint8, 3 * m).reshape(m, 3)
    return code.view("<u4").ravel(), np.frombuffer(body, "<u2", m, 3 * m)


def shared_codes(held: list[tuple[int, bytes]]) -> Iterator[tuple[int, bytes]]:
    """For each batch of a fragment the owners of codes that another batch has too, once for each code."""
    once, twice = np.zeros(1 << CODE_BITS, bool), np.zeros(1 << CODE_BITS, bool)
    for _, body in held:
        code, _ = opened(body)
        twice[code[once[code]]] = True
        once[code] = True
    for batch, body in held:
        code, owner = opened(body)
        hit = owner[twice[code] & (owner != MANY)]
        if len(hit):
            yield batch, hit.tobytes()


def linkable(documents: DataFrame, like: Likeness) -> DataFrame:
    """(class): the sets that share enough of their first n-grams with other sets to have a link."""
    size = documents.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    fragments = max(12, size * like.sent_percent // 100 // like.gram_text // SHARED_PER_FRAGMENT)

    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, held = None, []
        for p in parts:
            whole = p[p["classes"].notna()]
            if len(whole):
                yield whole[["batch", "classes", "body"]]
            for f, batch, classes, body in zip(p["fragment"].tolist(), p["batch"].tolist(), p["classes"], p["body"]):
                if classes is not None:
                    continue
                if f != now and held:
                    yield pd.DataFrame([(b, None, raw) for b, raw in shared_codes(held)], columns=["batch", "classes", "body"])
                    held = []
                now = f
                held.append((batch, body))
        if held:
            yield pd.DataFrame([(b, None, raw) for b, raw in shared_codes(held)], columns=["batch", "classes", "body"])

    def enough(classes: bytes, needed: bytes, hits: list[bytes]) -> pd.DataFrame:
        left = np.frombuffer(needed, "<i4")
        width = len(classes) // len(left)
        left = left - np.bincount(np.frombuffer(b"".join(hits), "<u2"), minlength=len(left))
        return pd.DataFrame({"class": [classes[width * i : width * i + width] for i in np.flatnonzero(left <= 0).tolist()]})

    def total(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, whole, hits = None, None, []
        for p in parts:
            for batch, classes, body in zip(p["batch"].tolist(), p["classes"], p["body"]):
                if batch != now and whole is not None:
                    yield enough(*whole, hits)
                    whole, hits = None, []
                now = batch
                if classes is None:
                    hits.append(body)
                else:
                    whole = (classes, body)
        if whole is not None:
            yield enough(*whole, hits)

    sent = messages(documents, fragments, like).repartition(fragments, "fragment").sortWithinPartitions("fragment")
    counted = sent.mapInPandas(count, "batch long, classes binary, body binary").repartition("batch").sortWithinPartitions("batch")
    return counted.mapInPandas(total, "class binary").distinct()


SET = "class binary, n long, grams binary, bits binary, sketch array<long>"


def sets_of(documents: DataFrame, need: DataFrame, like: Likeness) -> DataFrame:
    """SET rows of the texts of ``need`` (doc_id, class); a doc_id that repeats with its text repeats its row."""
    if need.limit(BROADCAST_SETS + 1).count() <= BROADCAST_SETS:
        need = F.broadcast(need)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            for at in range(0, len(p), ROWS):
                q = p.iloc[at : at + ROWS]
                # another text under the same doc_id is not meant
                good = [(c, h) for c, h in zip(q["class"], all_sets(q["text"], like)) if len(h) and digest(h) == bytes(c)]
                if good:
                    yield pd.DataFrame({"class": [c for c, _ in good], "n": [len(h) for _, h in good], "grams": [h.tobytes() for _, h in good], "bits": [parity(h) for _, h in good], "sketch": [sketch(h) for _, h in good]})

    return documents.select("doc_id", "text").join(need, "doc_id").select("class", "text").mapInPandas(run, SET)


def slices(parts: Iterator[pd.DataFrame]) -> Iterator[tuple[list[bytes], list[np.ndarray]]]:
    """Classes and n-grams of some SET rows at a time, each class once."""
    for p in parts:
        for at in range(0, len(p), SLICE):
            q = p.iloc[at : at + SLICE]
            found = {bytes(c): raw for c, raw in zip(q["class"], q["grams"])}
            yield list(found), [np.frombuffer(raw, np.uint64) for raw in found.values()]


def heavy_hitters(sets: DataFrame) -> np.ndarray:
    """The most frequent n-grams, least frequent first; at most HEAVY, so that their list may go to all tasks."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _, held in slices(parts):
            grams, times = np.unique(np.concatenate(held), return_counts=True)
            often = times >= HEAVY_IN_BATCH
            if often.any():
                yield pd.DataFrame({"gram": grams[often].view(np.int64), "times": times[often]})

    found = sets.select("class", "grams").mapInPandas(run, "gram long, times long").groupBy("gram").agg(F.sum("times").alias("times")).filter(F.col("times") >= HEAVY_IN_ALL)
    top = found.orderBy(F.desc("times"), "gram").limit(HEAVY).collect()
    return np.array([r["gram"] for r in reversed(top)], np.int64).view(np.uint64)


def pack(classes: list[bytes], sizes: np.ndarray, owner: np.ndarray, grams: np.ndarray, places: np.ndarray) -> bytes:
    used, owner = np.unique(owner, return_inverse=True)
    head = np.array([len(used), len(grams)], np.uint32).tobytes()
    return head + b"".join(classes[i] for i in used) + sizes[used].astype(np.uint32).tobytes() + owner.astype(np.uint32).tobytes() + places.astype(np.uint32).tobytes() + grams.tobytes()


def unpack(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    k, m = np.frombuffer(raw, np.uint32, 2).tolist()
    at = 8
    classes = np.frombuffer(raw, np.uint64, 2 * k, at).reshape(k, 2)
    sizes = np.frombuffer(raw, np.uint32, k, at := at + 16 * k)
    owner = np.frombuffer(raw, np.uint32, m, at := at + 4 * k)
    places = np.frombuffer(raw, np.uint32, m, at := at + 4 * m)
    return classes, sizes, owner, places, np.frombuffer(raw[at + 4 * m :], np.uint64, m)


def class_bytes(classes: np.ndarray) -> list[bytes]:
    raw = np.ascontiguousarray(classes).tobytes()
    return [raw[i : i + 16] for i in range(0, len(raw), 16)]


ENTRY = "fragment int, blob binary, a binary, gram long, n long, place long"
CANDIDATE = "a binary, b binary, gram long, n long, place long"


def prefix_entries(sets: DataFrame, heavy: np.ndarray, fragments: int, like: Likeness) -> DataFrame:
    """Prefix n-grams of each class that a batch holds, packed by fragment; heavy hitters as rows, dealt at random."""
    by_value = np.argsort(heavy)
    known = heavy[by_value]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for classes, found in slices(parts):
            sizes, owner, places, grams, ranks = [], [], [], [], []
            for h in found:
                rank = np.zeros(len(h), np.int64)
                if len(known):
                    at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                    rank = np.where(known[at] == h, by_value[at] + 1, 0)
                    order = np.argsort(rank, kind="stable")
                    h, rank = h[order], rank[order]
                m = int(like.probe(np.int64(len(h))))
                owner.append(np.full(m, len(sizes)))
                places.append(np.arange(m))
                grams.append(h[:m])
                ranks.append(rank[:m])
                sizes.append(len(h))
            n, own, place, gram = np.array(sizes), np.concatenate(owner), np.concatenate(places), np.concatenate(grams)
            rare = np.concatenate(ranks) == 0
            if not rare.all():
                hot = np.flatnonzero(~rare)
                yield pd.DataFrame({"fragment": hot % fragments, "blob": None, "a": [classes[i] for i in own[hot]], "gram": gram[hot].view(np.int64), "n": n[own[hot]], "place": place[hot]})
            own, place, gram = own[rare], place[rare], gram[rare]
            piece = ((gram >> np.uint64(32)) * np.uint64(fragments) >> np.uint64(32)).astype(np.int64)
            order = np.argsort(piece, kind="stable")
            cuts = np.searchsorted(piece[order], np.arange(fragments + 1))
            held = [(f, order[cuts[f] : cuts[f + 1]]) for f in range(fragments) if cuts[f + 1] > cuts[f]]
            yield pd.DataFrame({"fragment": [f for f, _ in held], "blob": [pack(classes, n, own[i], gram[i], place[i]) for _, i in held], "a": None, "gram": 0, "n": 0, "place": 0})

    return sets.select("class", "grams").mapInPandas(run, ENTRY)


def bounded(like: Likeness, na: np.ndarray, ia: np.ndarray, nb: np.ndarray, ib: np.ndarray) -> np.ndarray:
    """Whether sets of these sizes that share an n-gram at these places may link by it (the shorter one by its short prefix)."""
    p = like.percent
    lengths = p * np.maximum(na, nb) <= 100 * np.minimum(na, nb)
    overlap = (100 + p) * np.minimum(na - ia, nb - ib) >= p * (na + nb)
    short = np.where(na < nb, ia < like.index(na), np.where(nb < na, ib < like.index(nb), (ia < like.index(na)) | (ib < like.index(nb))))
    return lengths & overlap & short


def fragment_candidates(blobs: list[bytes], like: Likeness) -> Iterator[pd.DataFrame]:
    """CANDIDATE rows of one fragment."""
    tables, sizes, owners, places, grams, base = [], [], [], [], [], 0
    for raw in blobs:
        c, n, o, i, g = unpack(raw)
        tables.append(c)
        sizes.append(n)
        owners.append(o.astype(np.int64) + base)
        places.append(i)
        grams.append(g)
        base += len(c)
    table, first, number = np.unique(np.ascontiguousarray(np.concatenate(tables)).view("V16").ravel(), return_index=True, return_inverse=True)
    size = np.concatenate(sizes).astype(np.int64)[first]
    owner, place, gram = number[np.concatenate(owners)], np.concatenate(places).astype(np.int64), np.concatenate(grams)
    order = np.lexsort((owner, gram))
    owner, place, gram = owner[order], place[order], gram[order]
    fresh = np.ones(len(gram), bool)
    fresh[1:] = (gram[1:] != gram[:-1]) | (owner[1:] != owner[:-1])
    owner, place, gram = owner[fresh], place[fresh], gram[fresh]
    _, at, times = np.unique(gram, return_index=True, return_counts=True)
    length = np.repeat(times, times)
    short = (length > 1) & (length <= LIST)
    rank = np.arange(len(gram)) - np.repeat(at, times)
    pairs = []
    for step in range(1, LIST):
        i = np.flatnonzero(short & (rank + step < length))
        j = i + step
        ok = bounded(like, size[owner[i]], place[i], size[owner[j]], place[j])
        pairs.append(np.stack([owner[i[ok]], owner[j[ok]]], axis=1))
    found = np.unique(np.concatenate(pairs), axis=0)
    keys = [x.tobytes() for x in table] if len(found) or (length > LIST).any() else []
    if len(found):
        yield pd.DataFrame({"a": [keys[i] for i in found[:, 0]], "b": [keys[i] for i in found[:, 1]], "gram": 0, "n": 0, "place": 0})
    long = np.flatnonzero(length > LIST)
    if len(long):
        yield pd.DataFrame({"a": [keys[i] for i in owner[long]], "b": None, "gram": gram[long].view(np.int64), "n": size[owner[long]], "place": place[long]})


def candidates(entries: DataFrame, fragments: int, like: Likeness) -> DataFrame:
    """Pairs of classes (a, b) from short lists; entries (a, gram, n, place), with b null, of long lists and heavy hitters."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, blobs = None, []
        for p in parts:
            hot = p[p["blob"].isna()]
            if len(hot):
                yield pd.DataFrame({"a": hot["a"], "b": None, "gram": hot["gram"], "n": hot["n"], "place": hot["place"]})
            for f, raw in zip(p["fragment"].tolist(), p["blob"]):
                if raw is None:
                    continue
                if f != now and blobs:
                    yield from fragment_candidates(blobs, like)
                    blobs = []
                now = f
                blobs.append(raw)
        if blobs:
            yield from fragment_candidates(blobs, like)

    return entries.repartition(fragments, "fragment").sortWithinPartitions("fragment").mapInPandas(run, CANDIDATE)


def plausible(pairs: DataFrame, classes: DataFrame, like: Likeness) -> DataFrame:
    """The pairs (a, b) whose bitmaps allow enough overlap: common <= (na + nb - differing) / 2."""

    @F.pandas_udf("boolean")
    def allowed(x: pd.Series, nx: pd.Series, y: pd.Series, ny: pd.Series) -> pd.Series:
        total = nx.to_numpy() + ny.to_numpy()
        apart = np.array([differing(a, b) for a, b in zip(x, y)], np.int64)
        return pd.Series((100 + like.percent) * ((total - apart) // 2) >= like.percent * total)

    one = classes.select(F.col("class").alias("a"), F.col("n").alias("na"), F.col("bits").alias("xa"))
    two = classes.select(F.col("class").alias("b"), F.col("n").alias("nb"), F.col("bits").alias("xb"))
    return pairs.join(one, "a").join(two, "b").filter(allowed("xa", "na", "xb", "nb")).select("a", "b")


def verified(sets: DataFrame, classes: DataFrame, pairs: DataFrame, like: Likeness) -> DataFrame:
    """The pairs of classes (a, b) that link, by partial overlaps; ``classes``: (class, n, bits), one row each."""
    pairs = cut(plausible(pairs, classes, like))
    load = pairs.groupBy("a").agg((F.floor(F.count("*") / PAIRS_PER_SALT) + 1).cast("int").alias("salts"))
    members = pairs.join(load, "a").select(F.col("b").alias("class"), F.col("a").alias("leader"), F.pmod(F.crc32("b"), F.col("salts")).cast("int").alias("salt"), F.lit(False).alias("leads"))
    leaders = load.select(F.col("a").alias("class"), F.col("a").alias("leader"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(True).alias("leads"))
    need = cut(members.unionByName(leaders).groupBy("class").agg(F.collect_list(F.struct("leader", "salt", "leads")).alias("places")))
    if need.agg(F.coalesce(F.sum(F.size("places") + 1), F.lit(0))).first()[0] <= BROADCAST_SETS:
        need = F.broadcast(need)

    def spread(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        edges = np.array([i << 62 for i in range(1, OVERLAP_FRAGMENTS)], np.uint64)
        for p in parts:
            for at in range(0, len(p), ROWS):
                q, out = p.iloc[at : at + ROWS], []
                for c, places, grams in zip(q["class"], q["places"], q["grams"]):
                    h = np.frombuffer(grams, np.uint64)
                    cuts = [0, *np.searchsorted(h, edges).tolist(), len(h)]
                    pieces = [h[x:y].tobytes() for x, y in zip(cuts, cuts[1:])]
                    out += [(w["leader"], f, w["salt"], not w["leads"], c, len(h), raw) for w in places for f, raw in enumerate(pieces)]
                yield pd.DataFrame(out, columns=["leader", "fragment", "salt", "follows", "class", "n", "grams"])

    pieces = sets.select("class", "grams").join(need, "class").mapInPandas(spread, "leader binary, fragment int, salt int, follows boolean, class binary, n long, grams binary")
    pieces = pieces.repartition("leader", "fragment", "salt").sortWithinPartitions("leader", "fragment", "salt", "follows", "class")

    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, lead, lead_n, last = None, None, 0, None
        for p in parts:
            out = []
            for leader, f, salt, follows, c, n, raw in zip(p["leader"], p["fragment"].tolist(), p["salt"].tolist(), p["follows"].tolist(), p["class"], p["n"].tolist(), p["grams"]):
                h = np.frombuffer(raw, np.uint64)
                if not follows:
                    group, lead, lead_n, last = (leader, f, salt), h, n, None
                elif c != last:
                    assert group == (leader, f, salt), "a leader's set is missing"
                    at = np.searchsorted(lead, h)
                    common = int((lead[np.minimum(at, len(lead) - 1)] == h).sum()) if len(lead) else 0
                    out.append((leader, c, lead_n, n, common))
                    last = c
            if out:
                yield pd.DataFrame(out, columns=["a", "b", "na", "nb", "common"])

    sums = pieces.mapInPandas(count, "a binary, b binary, na long, nb long, common long").groupBy("a", "b").agg(F.sum("common").alias("common"), F.first("na").alias("na"), F.first("nb").alias("nb"))
    return sums.filter(like.linked("common", "na", "nb")).select("a", "b")


def ordered(pairs: DataFrame) -> DataFrame:
    """Distinct pairs (a, b) with a before b."""
    return pairs.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def link_components(documents: DataFrame, like: Likeness | None = None) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (the smallest doc_id reachable by links, itself included)."""
    like = like or Likeness()
    rows = cut(documents.select("doc_id", shapes(like)("text").alias("s")).select("doc_id", "s.n", "s.class"))
    reps = cut(rows.filter("class is not null").groupBy("class").agg(F.min("doc_id").alias("rep")).filter("rep is not null"))
    need = cut(linkable(documents, like).join(reps, "class").select(F.col("rep").alias("doc_id"), "class"))
    sets = cut(sets_of(documents, need, like))
    classes = cut(sets.groupBy("class").agg(*[F.first(c).alias(c) for c in ("n", "bits", "sketch")]))
    total = classes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    fragments = max(12, -(-total * (100 - like.percent) // 100 // ENTRIES_PER_FRAGMENT))
    found = cut(candidates(prefix_entries(sets, heavy_hitters(sets), fragments, like), fragments, like))

    # short lists in full, long ones with their leaders: sets of like size under one n-gram
    entries = found.filter("b is null").select("a", "gram", "n", "place").distinct()
    entries = cut(entries.withColumn("step", F.floor(F.ln("n") / F.ln(F.lit(100 / like.percent))).cast("int")))
    central = entries.groupBy("a").agg((F.count("*") / F.max("n")).alias("share"))
    entries = cut(entries.join(central, "a"))
    drawn = [F.min(F.struct(F.xxhash64("a", F.lit(i)).alias("h"), "a"))["a"] for i in range(PROBES)]
    leaders = entries.groupBy("gram", "step").agg(F.array_distinct(F.array(F.max(F.struct("share", "a"))["a"], *drawn)).alias("b"))
    star = entries.join(leaders, ["gram", "step"]).select("a", F.explode("b").alias("b"))
    pairs = cut(ordered(found.filter("b is not null").select("a", "b").unionByName(star)))
    links = cut(verified(sets, classes, pairs, like))
    labels = class_components(links, classes)

    # what is left of long lists: entries outside their list's main component, with all entries of other components
    rest = cut(ordered(list_pairs(entries, labels, classes, like)).join(pairs, ["a", "b"], "left_anti"))
    if not rest.isEmpty():
        labels = class_components(cut(links.unionByName(verified(sets, classes, rest, like))), classes)
    names = labels.join(reps, "class").groupBy("label").agg(F.min("rep").alias("component_id"))
    named = reps.join(labels, "class", "left").join(names, "label", "left").select("class", F.coalesce("component_id", "rep").alias("component_id"))
    return rows.join(named, "class", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def list_pairs(entries: DataFrame, labels: DataFrame, classes: DataFrame, like: Likeness) -> DataFrame:
    """Pairs (a, b) of one long list in different components: each entry outside the list's main component with
    all entries of other components that the bounds of lengths, places and bitmaps allow.
    Two sets that share one of the BEFORE n-grams before this one have met there (their places allowed more) and are not told again."""
    part = cut(entries.join(labels, F.col("a") == F.col("class"), "left").select("a", "gram", "n", "place", F.coalesce("label", "a").alias("label")))
    held = part.groupBy("gram", "label").agg(F.count("*").alias("k"))
    mixed = held.groupBy("gram").agg(F.max(F.struct("k", "label")).alias("most"), F.count("*").alias("labels")).filter("labels > 1").select("gram", F.col("most.label").alias("main"))
    open_ = cut(part.join(mixed, "gram"))
    earlier = W.partitionBy("a").orderBy("place").rowsBetween(-BEFORE, -1)
    open_ = open_.withColumn("before", F.collect_list("gram").over(earlier)).join(classes.select(F.col("class").alias("a"), *[F.col("sketch")[i].alias(f"x{i}") for i in range(SKETCH)]), "a")
    named = lambda i: [F.col(c).alias(f"{c}_{i}") for c in ("a", "n", "place", "label", "before", *[f"x{k}" for k in range(SKETCH)])]
    one, two = open_.filter("label <> main").select("gram", *named(1)), open_.select("gram", *named(2))
    p, w = like.percent, 100 + like.percent
    apart = " + ".join(f"bit_count(x{k}_1 ^ x{k}_2)" for k in range(SKETCH))
    fits = F.expr(f"label_1 <> label_2 and {p} * greatest(n_1, n_2) <= 100 * least(n_1, n_2) and {w} * least(n_1 - place_1, n_2 - place_2) >= {p} * (n_1 + n_2) and {w} * ((n_1 + n_2 - ({apart})) div 2) >= {p} * (n_1 + n_2) and not arrays_overlap(before_1, before_2)")
    return one.join(two, (one["gram"] == two["gram"]) & fits).select(F.col("a_1").alias("a"), F.col("a_2").alias("b"))


def class_components(links: DataFrame, classes: DataFrame) -> DataFrame:
    """(class, label) of the classes that have a link; a label is a class."""
    return connected_components(links, "a", "b").select(F.col("node").alias("class"), F.col("component").alias("label"))


def one_of_each(documents: DataFrame, like: Likeness | None = None) -> DataFrame:
    """The documents that are their component's smallest doc_id (one row of repeated ones), and those with a null doc_id."""
    found = link_components(documents, like)
    found = cut(found)
    keep = found.filter("doc_id = component_id").select("doc_id").distinct()
    kept = documents.join(keep, "doc_id", "left_semi")
    if found.filter("doc_id = component_id").groupBy("doc_id").count().filter("count > 1").limit(1).count():
        kept = kept.dropDuplicates(["doc_id"])
    return kept.unionByName(documents.filter("doc_id is null"))
