"""Document fingerprints: SpotSigs, with Jaccard likeness to the edited and to the next document.

Words are runs of letters, digits and any characters beyond ASCII, lower-cased. Each common word (``ANCHORS``) that is followed by ``CHAIN`` content
words (not common ones) forms a spot: the anchor and that chain. A text's signature set is the set of hashes of its
spots; a text with words but no spot has one signature of all its words, a text without words one of itself when it
is not empty. The fingerprint is the sorted set, 32 bits each in base64: a pure function of the text.

``near_classes`` joins the whole corpus. Documents with equal sets form a class of which one takes part. Two classes link when the
Jaccard coefficient of their sets is ``LEAST`` or more; ``near_class`` is the smallest doc_id that a document reaches by
links, itself included (texts without signature have equal sets; rows with a null doc_id get the class of equal sets that have one, else null).

1. One pass counts signatures, so that the most frequent (a bounded list; only their place in the order depends on it)
   come last in the global order, and notes the class of each document.
2. Sets that can't link with any other are left out, by ``ngram_join.linkable``: fragments of the hash order count how many of
   a set's signatures any other set holds too. Texts of one vocabulary share some signatures with ever more others as the corpus
   grows; pairs of them are never made. The sets that stay are written once, with their bitmaps.
3. Of these a set sends the rarest signatures of its order, as many as any set that links must share one of, to inverted lists,
   which are partitioned by set length. An entry brings the length of its set and a 64-bit bitmap of it, so that lists of at most
   ``LIST`` sets give only those pairs that lengths and bitmaps allow. Where these are more than ``PAIRS`` an entry, and
   in longer lists and those of frequent signatures, the entries go on as rows.
4. Those long lists first compare each member with few others of its own and the next length class: the leader (the set with the
   largest share of its signatures in long lists) and ``PROBES`` members drawn anew for each list, so that a set of a large
   group meets different ones in each of its lists. Once the components of all links so
   far are known, members outside a list's main component meet the members of other components of the same or of
   neighbouring length classes, in the first list that they share; pairs within a component need no test. Lengths and bitmaps of
   ``WORDS`` longs are part of this join's condition. The components are then joined by what was found.
5. The pairs left are pruned by larger bitmaps, and the others compared exactly.

The join is exact up to collisions of the 64-bit hashes that tell spots and classes.

``dealt`` brings each document before its successor by descending doc_id (null ids last, equal ids by text): rows are
dealt to ranges of doc_id with bounds from quantiles, the first row of each range also goes to the range before it
as its tail, and each range is sorted and streamed, so no task holds more than two rows at a time.
"""

from __future__ import annotations

import base64
import hashlib
import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from linkweave.llm import ngram_join
from linkweave.llm.common import cut, exact_id
from linkweave.operators.components import connected_components

# Common words of English, German, French and Spanish.
ANCHORS = frozenset(
    "the a an of to and in is was that for on with as it be by at from this are or have not they you which "
    "der die das und den dem von zu mit sich auf für ist nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über "
    "le la les de des un une et que qui dans en du est pour par sur pas au plus ne se ce il sont avec "
    "el los las del que y por con para como una su al lo más pero sus le ya o este".split()
)
CHAIN, GAP = 2, 5
NO_WORD = re.compile(rb"[^0-9a-z\x80-\xff]")
IN_WORD = np.array([NO_WORD.match(bytes([i])) is None for i in range(256)])
#: Bytes that are cut into words together, and code points of texts whose spots are found together, about.
PIECE, TOGETHER = 1 << 18, 1 << 20
#: Documents in a range of doc_id, about.
RANGE_DOCS = 1_000
MAX_RANGES = 65_536
#: Least Jaccard coefficient of a link; the longest inverted list whose pairs are looked at in one place, and the most of them
#: an entry that it may give.
LEAST, LIST, PAIRS = 0.75, 32, 2
#: Bits of a set's bitmap for each signature, about, and at most.
SKETCH_BITS, MOST_BITS = 4, 4_096
#: Frequent signatures: at most so many, each so often in one batch of documents and in all.
FREQUENT, OFTEN_IN_BATCH, OFTEN_IN_ALL = 100_000, 4, 32
#: Entries of inverted lists in one fragment, about, and fragments at least; entries of a batch.
FRAGMENT_ENTRIES, LEAST_FRAGMENTS, BATCH_ENTRIES = 250_000, 12, 1_000_000
#: Percent of each set that the count of shared signatures sees, and bytes of text for a signature, about.
SENT, SIGNATURE_TEXT = 60, 20
#: Members of a long list that all its entries are first compared with, besides the leader; longs of the bitmaps under which the
#: last comparison joins, and entries of a set before one that tell whether two sets have met already.
PROBES, WORDS, BEFORE = 2, 16, 8
#: Classes that are told by broadcast up to this many, else by shuffle join.
BROADCAST_CLASSES = 400_000

_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * _M1
    h = (h ^ (h >> np.uint64(32))) * _M2
    return h ^ (h >> np.uint64(31))


def weights(n: int) -> np.ndarray:
    """Odd 64-bit multipliers for places 0 to n - 1."""
    return _mixed(np.arange(1, n + 1, dtype=np.uint64)) | np.uint64(1)


FEW = weights(64)


def words_of(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start and 64-bit hash (a sum of bytes weighted by place, mixed) of each word, a bounded piece at a time."""
    starts, codes, at = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], 0
    while at < len(raw):
        stop = NO_WORD.search(raw, at + PIECE)
        end = stop.start() if stop else len(raw)
        b = np.frombuffer(raw, np.uint8, end - at, at)
        held = IN_WORD[b]
        turns = np.flatnonzero(np.diff(held.view(np.int8), prepend=0, append=0))
        if len(turns):
            first, n = turns[::2], turns[1::2] - turns[::2]
            before = np.cumsum(n) - n
            longest = int(n.max())
            by_place = (FEW if longest <= len(FEW) else weights(longest))[np.arange(int(n.sum())) - np.repeat(before, n)]
            codes.append(_mixed(np.add.reduceat(by_place * (b[held].astype(np.uint64) + np.uint64(1)), before) + n.astype(np.uint64)))
            starts.append(first + at)
        at = end
    return np.concatenate(starts), np.concatenate(codes)


ANCHOR_CODES = np.sort(np.concatenate([words_of(w.encode())[1] for w in ANCHORS]))


def together(texts: list[str]) -> Iterator[list[str]]:
    """Runs of texts of a bounded size, or of one text."""
    held, size = [], 0
    for t in texts:
        if held and size + len(t) > TOGETHER:
            yield held
            held, size = [], 0
        held.append(t)
        size += len(t)
    if held:
        yield held


def wide_sets(texts: list[str]) -> list[np.ndarray]:
    """Of each text the 64-bit hashes of its spots, sorted; their upper halves are the signatures, each of them once."""
    return [x for run in together(texts) for x in _wide_sets(run)]


def _wide_sets(texts: list[str]) -> list[np.ndarray]:
    raw = [t.lower().encode("utf-8", "replace") for t in texts]
    ends = np.cumsum([len(x) + 1 for x in raw])
    starts, codes = words_of(b" ".join(raw))
    owner = np.searchsorted(ends, starts, side="right")
    word_ends = np.searchsorted(owner, np.arange(len(texts)), side="right")
    word_starts = np.concatenate([[0], word_ends[:-1]])
    place = np.arange(len(codes))
    if len(codes):
        anchor = ANCHOR_CODES[np.minimum(np.searchsorted(ANCHOR_CODES, codes), len(ANCHOR_CODES) - 1)] == codes
        start = word_starts[owner]
        last = np.maximum.accumulate(np.where(anchor, place, np.where(place == start, place - 1, -1)))
        last = np.maximum(last, start - 1)
        stand_in = ~anchor & ((place - last) % GAP == 1) & ((place - last > 1) | (last < start))
        content = np.flatnonzero(~anchor)
        at = np.flatnonzero(anchor | stand_in)
        nth = np.searchsorted(content, at)
        good = nth + CHAIN <= len(content)
        at, nth = at[good], nth[good]
        good = owner[content[nth + CHAIN - 1]] == owner[at]
        at, nth = at[good], nth[good]
        h = _mixed(np.where(anchor[at], codes[at], np.uint64(0)))
        for i in range(CHAIN):
            h = _mixed(h + codes[content[nth + i]])
        by = np.lexsort((h, owner[at]))
        h, of = h[by], owner[at][by]
        upper = h >> np.uint64(32)
        new = np.concatenate([[True], (upper[1:] != upper[:-1]) | (of[1:] != of[:-1])]) if len(h) else np.zeros(0, bool)
        h, of = h[new], of[new]
        cuts = np.searchsorted(of, np.arange(len(texts) + 1))
    else:
        h, cuts = np.zeros(0, np.uint64), np.zeros(len(texts) + 1, int)
    out = []
    for i, text in enumerate(texts):
        found = h[cuts[i] : cuts[i + 1]]
        if not len(found) and text:
            own = codes[word_starts[i] : word_ends[i]]
            own = own if len(own) else np.array([zlib.crc32(raw[i])], np.uint64)
            found = _mixed(np.array([np.sum(own * weights(len(own)))], np.uint64))
        out.append(found)
    return out


def upper(wide: np.ndarray) -> np.ndarray:
    return (wide >> np.uint64(32)).astype(np.uint32)


def signatures(texts: list[str]) -> list[np.ndarray]:
    """Of each text its sorted distinct 32-bit signatures."""
    return [upper(x) for x in wide_sets(texts)]


def fingerprint(sigs: np.ndarray) -> str:
    return base64.b64encode(sigs.astype("<u4").tobytes()).decode()


def likeness(a: np.ndarray, b: np.ndarray, least: float = 0.0) -> float:
    """Jaccard coefficient of two sorted sets, 0 where it can't reach ``least``; two empty sets are alike."""
    small, large = sorted((len(a), len(b)))
    if large == 0:
        return 1.0
    if small == 0 or small < least * large:
        return 0.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    found = both / (small + large - both)
    return found if found >= least else 0.0


def edited(text: str, following: str) -> str:
    """The last third of a text replaced by as many first code points (or all) of the following one."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


def ranges(ids: DataFrame) -> tuple[np.ndarray, dict[int, int]]:
    """Ascending bounds of doc_id ranges (a range holds its upper bound) and the largest doc_id of each range."""
    ids = ids.filter("doc_id is not null")
    wanted = max(1, min(MAX_RANGES, ids.count() // RANGE_DOCS))
    cuts = ids.approxQuantile("doc_id", [i / wanted for i in range(1, wanted)], 0.25 / wanted) if wanted > 1 else []
    bounds = np.unique(np.array(cuts, np.int64))
    found = ids.groupBy(number(bounds)(F.col("doc_id")).alias("r")).agg(F.max("doc_id").alias("m")).collect()
    return bounds, {r["r"]: r["m"] for r in found}


def number(bounds: np.ndarray):
    """A function that gives the number of the range that holds a doc_id (0 for null)."""

    @F.pandas_udf("int")
    def of(doc_id: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, doc_id.to_numpy(np.int64), side="left").astype(np.int32))

    # a null would make the whole column floating, which holds no large id
    return lambda doc_id: F.when(doc_id.isNull(), 0).otherwise(of(F.coalesce(doc_id, F.lit(0))))


def dealt(documents: DataFrame) -> DataFrame:
    """doc_id, text, range, tail: each row in its range, and each range's first rows again as tails of the range before."""
    bounds, largest = ranges(documents.select("doc_id"))
    held = sorted(largest)
    if not held:
        return documents.select("doc_id", "text", F.lit(0).alias("range"), F.lit(False).alias("tail")).repartition(1).sortWithinPartitions("text")
    above = dict(zip(held, [*held[1:], held[0]]))  # descending order: what follows range r is the first row below it
    firsts = {largest[r]: above[r] for r in held}
    keys, values = np.array(sorted(firsts), np.int64), np.array([firsts[k] for k in sorted(firsts)], np.int32)

    @F.pandas_udf("int")
    def tail_of(doc_id: pd.Series) -> pd.Series:
        ids = doc_id.to_numpy(np.int64)
        at = np.minimum(np.searchsorted(keys, ids), len(keys) - 1)
        return pd.Series(np.where(keys[at] == ids, values[at], -1).astype(np.int32))

    other = F.when(F.col("doc_id").isNull(), -1).otherwise(tail_of(F.coalesce("doc_id", F.lit(0))))
    rows = documents.select("doc_id", "text", number(bounds)(F.col("doc_id")).alias("own"), other.alias("other"))
    place = F.when(F.col("other") < 0, F.array(F.struct(F.col("own").alias("range"), F.lit(False).alias("tail"))))
    place = place.otherwise(F.array(F.struct(F.col("own").alias("range"), F.lit(False).alias("tail")), F.struct(F.col("other").alias("range"), F.lit(True).alias("tail"))))
    rows = rows.select("doc_id", "text", F.explode(place).alias("p")).select("doc_id", "text", "p.range", "p.tail")
    return rows.repartition(max(1, min(len(held), 2_000)), "range").sortWithinPartitions("range", "tail", F.col("doc_id").desc_nulls_last(), "text")


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, length_class int, class long"


def length_class(n: int, least: float = LEAST) -> int:
    """The partition of a set by its length: sets as like as ``least`` lie in the same or in neighbouring ones."""
    return int(math.log(n) / -math.log(least)) if n else -1


def length_classes(n: np.ndarray) -> np.ndarray:
    """``length_class`` of sets that are not empty."""
    return (np.log(n) / -math.log(LEAST)).astype(np.int64)


def set_class(sigs: np.ndarray) -> int:
    """A 64-bit hash of a set, the same for equal sets."""
    return int.from_bytes(hashlib.blake2b(sigs.astype("<u4").tobytes(), digest_size=8).digest(), "little", signed=True)


def fingerprints(documents: DataFrame) -> DataFrame:
    """Per row: see SCHEMA. ``near_next`` compares with the next document by descending doc_id, the last with the first."""

    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def compared(todo: list[tuple[tuple, tuple]]) -> pd.DataFrame:
        out, new = [], [edited(row[2], following[2]) for row, following in todo]
        for ((_, doc_id, text, sigs), following), changed, other in zip(todo, new, signatures(new)):
            digest = hashlib.sha256(changed.encode("utf-8", "replace")).hexdigest()
            out.append((doc_id, len(text), digest, fingerprint(sigs), fingerprint(other), likeness(sigs, other), likeness(sigs, following[3]), length_class(len(sigs)), set_class(sigs)))
        return pd.DataFrame(out, columns=names)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, first = None, None  # (range, doc_id, text, signatures) of the row before, and of the range's first row
        done = False  # the range's own rows are all compared
        for p in parts:
            ids, places, tails, nth = p["doc_id"].tolist(), p["range"].tolist(), p["tail"].tolist(), 0
            for texts in together([t or "" for t in p["text"]]):
                todo = []
                for text, sigs in zip(texts, signatures(texts)):
                    doc_id, r, tail = ids[nth], places[nth], tails[nth]
                    nth += 1
                    if held is not None and held[0] == r and done:
                        continue
                    row = (r, doc_id, text, sigs)
                    if held is not None and not done:
                        todo.append((held, row if held[0] == r else first))
                    if held is None or held[0] != r:
                        first = row
                    held, done = row, tail
                if todo:
                    yield compared(todo)
        if held is not None and not done:
            yield compared([(held, first)])

    rows = dealt(documents).withColumn("doc_id", exact_id("doc_id")).mapInPandas(run, SCHEMA.replace("doc_id long", "doc_id string"))
    return rows.withColumn("doc_id", F.col("doc_id").cast("long"))


def counted(documents: DataFrame) -> DataFrame:
    """Rows (kind, key, value): 0, signature, count in a batch when it is high; 1, class, doc_id (null too)."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            sets = signatures([t or "" for t in p["text"]])
            yield pd.DataFrame({"kind": 1, "key": [set_class(x) for x in sets], "value": p["doc_id"].to_numpy()})
            sig, n = np.unique(np.concatenate(sets), return_counts=True) if sets else (np.zeros(0, np.uint32), np.zeros(0, np.int64))
            often = n >= OFTEN_IN_BATCH
            yield pd.DataFrame({"kind": 0, "key": sig[often].astype(np.int64), "value": n[often].astype(str)})

    rows = documents.select(exact_id("doc_id"), "text").mapInPandas(run, "kind int, key long, value string")
    return cut(rows.withColumn("value", F.col("value").cast("long")))


def prefix(wide: np.ndarray, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first signatures of a set in the global order (frequent ones last): every set at least ``LEAST`` like it
    holds one of them among its own first ones. Also tells which of them are frequent."""
    sigs = upper(wide)
    at = np.minimum(np.searchsorted(frequent, sigs), max(len(frequent) - 1, 0))
    late = frequent[at] == sigs if len(frequent) else np.zeros(len(sigs), bool)
    first = np.argsort(late, kind="stable")[: len(wide) - math.ceil(LEAST * len(wide) - 1e-9) + 1]
    return wide[first], late[first]


@dataclass(frozen=True)
class Spots(ngram_join.Likeness):
    """Signature sets as ``ngram_join.linkable`` counts them; the name of a set is its class, highest byte first."""

    percent: int = int(100 * LEAST)
    sent_percent: int = SENT
    gram_text: int = SIGNATURE_TEXT

    def sets(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        return iter(wide_sets([t or "" for t in texts]))

    def name(self, h: np.ndarray) -> bytes:
        return set_class(upper(h)).to_bytes(8, "big", signed=True)


def linkable_owners(documents: DataFrame, members: DataFrame) -> DataFrame:
    """(class, doc_id of one of its documents) of the sets that share enough signatures with others to have a link."""
    like = Spots()
    named = members.filter("doc_id is not null").select(F.unhex(F.lpad(F.hex("class"), 16, "0")).alias("name"), "class", "doc_id")
    return cut(named.join(ngram_join.linkable(documents, like).withColumnRenamed("class", "name"), "name", "left_semi").select("class", "doc_id"))


SET = "class long, n int, held array<int>, low array<int>, sketch array<long>, bitmap array<long>"


def sets_of(documents: DataFrame, owners: DataFrame) -> DataFrame:
    """SET rows, once of each class of ``owners`` (class, doc_id of one of its documents): the signatures, the lower halves of
    their hashes, the sketch and a bitmap of ``WORDS`` longs."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            wide = wide_sets([t or "" for t in p["text"]])
            sigs = [upper(x) for x in wide]
            low = [(x & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32) for x in wide]
            yield pd.DataFrame({"class": [set_class(x) for x in sigs], "n": [len(x) for x in sigs], "held": [x.view(np.int32) for x in sigs], "low": low, "sketch": [sketch(x) for x in sigs], "bitmap": [parity(x, 64 * WORDS) for x in sigs]})

    told = F.broadcast if owners.count() <= BROADCAST_CLASSES else lambda x: x
    rows = documents.select("doc_id", "text").join(told(owners.select("doc_id").distinct()), "doc_id", "left_semi")
    found = cut(rows.select("text").mapInPandas(run, SET).join(told(owners.select("class")), "class", "left_semi"))
    # only a doc_id that repeats with its text repeats a class
    return found if found.count() == found.select("class").distinct().count() else cut(found.dropDuplicates(["class"]))


ENTRY = "fragment int, body binary, key long, class long, length int, n long, bitmap long"
FOUND = "a long, b long, key long, length int, n long, bitmap long"


def entries(sets: DataFrame, frequent: np.ndarray, fragments: int) -> DataFrame:
    """Inverted lists as ENTRY: a body packs the keys, classes, lengths and 64-bit bitmaps of a batch in one fragment;
    entries of frequent signatures are rows of their own, in any fragment."""

    def packed(held: list[tuple[np.ndarray, np.ndarray, int, int, int]]) -> pd.DataFrame:
        nth = np.repeat(np.arange(len(held)), [len(x[0]) for x in held])
        keys, late = np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held])
        cls, n = np.array([x[2] for x in held], np.int64), np.array([x[3] for x in held], np.uint32)
        bitmap = np.array([x[4] for x in held], np.int64)
        of = cls[nth[late]]
        rows = pd.DataFrame({"fragment": (of % fragments).astype(np.int32), "body": None, "key": keys[late].view(np.int64), "class": of, "length": length_classes(n)[nth[late]], "n": n[nth[late]].astype(np.int64), "bitmap": bitmap[nth[late]]})
        keys, nth = keys[~late], nth[~late]
        where = (_mixed(keys) % np.uint64(fragments)).astype(np.int32)
        by = np.lexsort((keys & np.uint64(0xFFFFFFFF), where))
        keys, nth, where = (keys & np.uint64(0xFFFFFFFF)).astype(np.uint32)[by], nth[by], where[by]
        cuts = np.flatnonzero(np.diff(where, prepend=-1))
        columns = [keys, cls[nth], n[nth], bitmap[nth]]
        bodies = [b"".join(x[i:j].tobytes() for x in columns) for i, j in zip(cuts, [*cuts[1:], len(keys)])]
        bodies = pd.DataFrame({"fragment": where[cuts], "body": bodies, "key": 0, "class": 0, "length": 0, "n": 0, "bitmap": 0})
        return pd.concat([rows, bodies]) if len(rows) else bodies

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, total = [], 0
        for p in parts:
            for cls, sigs, low, bitmap in zip(p["class"].tolist(), p["held"], p["low"], p["bitmap"]):
                wide = (np.asarray(sigs, np.int32).view(np.uint32).astype(np.uint64) << np.uint64(32)) | np.asarray(low, np.int32).view(np.uint32)
                held.append((*prefix(wide, frequent), cls, len(wide), int(np.bitwise_xor.reduce(np.asarray(bitmap, np.int64)))))
                total += len(held[-1][0])
                if total >= BATCH_ENTRIES:
                    yield packed(held)
                    held, total = [], 0
        if held:
            yield packed(held)

    return sets.filter("n > 0").select("class", "held", "low", "bitmap").mapInPandas(run, ENTRY)


def list_members(g: pd.DataFrame) -> pd.DataFrame:
    """Of one fragment: pairs (a, b) of short lists that may link, and the entries (key, a, length; b null) of others."""
    bodies = [x for x in g["body"] if x is not None]
    passed = g[g["body"].isnull()]
    fragment, out = int(g["fragment"].iloc[0]), [passed[["key", "length", "n", "bitmap"]].assign(a=passed["class"], b=None)]
    if bodies:
        sizes = [len(x) // 24 for x in bodies]
        column = lambda kind, at: np.concatenate([np.frombuffer(x, kind, n, at * n) for x, n in zip(bodies, sizes)])
        keys, cls, lengths, bitmap = column(np.uint32, 0), column(np.int64, 4), column(np.uint32, 12).astype(np.int64), column(np.uint64, 16)
        by = np.lexsort((cls, lengths, keys))
        keys, cls, lengths, bitmap = keys[by], cls[by], lengths[by], bitmap[by]
        new = (np.diff(keys, prepend=~keys[:1]) != 0) | (np.diff(cls, prepend=~cls[:1]) != 0)
        keys, cls, lengths, bitmap = keys[new], cls[new], lengths[new], bitmap[new]
        _, nth, n = np.unique(keys, return_inverse=True, return_counts=True)
        at = np.flatnonzero((n[nth] <= LIST) & (n[nth] > 1))
        first, second = [np.zeros(0, int)], [np.zeros(0, int)]
        for d in range(1, LIST):
            at = at[at + d < len(keys)]
            at = at[(keys[at] == keys[at + d]) & (lengths[at] >= LEAST * lengths[at + d])]  # lists ascend by length
            apart = np.bitwise_count(bitmap[at] ^ bitmap[at + d])
            near = at[apart * (1 + LEAST) <= (1 - LEAST) * (lengths[at] + lengths[at + d]) + 1e-6]
            first.append(near)
            second.append(near + d)
        first, second = np.concatenate(first), np.concatenate(second)
        given = np.bincount(nth[first], minlength=len(n))
        dense = (n > LIST) | (given > PAIRS * n)
        told = ~dense[nth[first]]
        x, y = cls[first[told]], cls[second[told]]
        pairs = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)], 1), axis=0)
        out.append(pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1], "key": None, "length": None, "n": None, "bitmap": None}))
        long = n[nth] > LIST
        long[first[~told]] = long[second[~told]] = True
        wide = (keys[long].astype(np.int64) << 31) ^ fragment  # lists of different fragments stay apart
        out.append(pd.DataFrame({"a": cls[long], "b": None, "key": wide, "length": length_classes(lengths[long]), "n": lengths[long], "bitmap": bitmap[long].view(np.int64)}))
    return pd.concat([x[["a", "b", "key", "length", "n", "bitmap"]].astype("Int64") for x in out])


def sketch(sigs: np.ndarray, most: int = MOST_BITS) -> np.ndarray:
    """A parity bitmap as 64-bit words, whose size is a power of two: sets can't differ in fewer places than their
    bitmaps do. Folding a bitmap gives the one of half its size."""
    bits = 64
    while bits < min(SKETCH_BITS * len(sigs), most):
        bits *= 2
    return parity(sigs, bits)


def parity(sigs: np.ndarray, bits: int) -> np.ndarray:
    """Whether an odd number of signatures fall on each place."""
    at = _mixed(sigs.astype(np.uint64)) & np.uint64(bits - 1)
    odd = (np.bincount(at.astype(np.int64), minlength=bits) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view(np.int64)


def near_enough(na: str, nb: str, apart: Column) -> Column:
    """Whether lengths and bitmaps allow a link. Sets alike to J differ in at most (1 - J) / (1 + J) of the sum of
    their lengths."""
    return (F.least(na, nb) >= LEAST * F.greatest(na, nb)) & (apart * (1 + LEAST) <= (1 - LEAST) * (F.col(na) + F.col(nb)) + 1e-6)


def bits_apart(x: str, y: str) -> Column:
    return F.bit_count(F.col(x).bitwiseXOR(F.col(y)))


def plausible(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sketches allow a link."""
    sketches = sets.select("class", "n", "sketch")
    folded = lambda x, y: F.when(F.size(x) <= F.size(y), F.col(x)).when(
        F.size(x) == 2 * F.size(y), F.zip_with(F.slice(x, 1, F.size(y)), F.slice(x, F.size(y) + 1, F.size(y)), lambda i, j: i.bitwiseXOR(j))
    )
    apart = F.aggregate(F.zip_with(folded("sa", "sb"), folded("sb", "sa"), lambda i, j: F.bit_count(i.bitwiseXOR(j))), F.lit(0), lambda x, y: x + y)
    met = pairs.distinct().join(sketches.toDF("a", "na", "sa"), "a").join(sketches.toDF("b", "nb", "sb"), "b")
    return cut(met.filter(near_enough("na", "nb", apart)).select("a", "b"))


def linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets are at least ``LEAST`` like each other; signatures are brought together only where sketches
    allow it."""
    pairs = plausible(pairs, sets)
    needed = cut(pairs.select(F.explode(F.array("a", "b")).alias("class")).distinct())
    told = F.broadcast if needed.count() <= BROADCAST_CLASSES else lambda x: x
    held = sets.select("class", "n", "held").join(told(needed), "class", "left_semi")
    met = pairs.join(held.toDF("a", "na", "sa"), "a").join(held.toDF("b", "nb", "sb"), "b").withColumn("both", F.size(F.array_intersect("sa", "sb")))
    return cut(met.filter(100 * F.col("both") >= int(100 * LEAST) * (F.col("na") + F.col("nb") - F.col("both"))).select("a", "b"))


def led(long: DataFrame) -> DataFrame:
    """Pairs (a, b) of each entry of a long list (key, length, class, n, bitmap) with its leader and its probes, and with those of
    the next length class, as far as lengths and bitmaps allow a link."""
    central = long.groupBy("class").agg((F.count("*") / F.max("n")).alias("share"))
    held = F.struct("class", "n", "bitmap")
    drawn = [F.min_by(held, F.xxhash64("class", "key", F.lit(i))) for i in range(PROBES)]
    leaders = long.join(central, "class").groupBy("key", "length").agg(F.array_distinct(F.array(F.max_by(held, F.struct("share", "class")), *drawn)).alias("l"))
    leaders = leaders.select("key", F.explode(F.array("length", F.col("length") - 1)).alias("length"), "l")
    met = long.toDF("key", "length", "x", "nx", "sx").join(leaders, ["key", "length"]).select("x", "nx", "sx", F.explode("l").alias("l"))
    met = met.select("x", "nx", "sx", F.col("l.class").alias("y"), F.col("l.n").alias("ny"), F.col("l.bitmap").alias("sy"))
    met = met.filter("x <> y").filter(near_enough("nx", "ny", bits_apart("sx", "sy")))
    return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def across(long: DataFrame, parts: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) of long lists in different components: each entry outside its list's main component with those
    of all others, in the first list that two sets share (as far as BEFORE entries tell)."""
    entry = long.select("key", "length", "class", "n").join(parts.withColumnRenamed("node", "class"), "class", "left").withColumn("part", F.coalesce("component", "class")).drop("component")
    main = entry.groupBy("key", "part").agg(F.count("*").alias("n_part")).groupBy("key").agg(F.max_by("part", F.struct("n_part", "part")).alias("main"), F.count("*").alias("parts"))
    entry = cut(entry.join(main.filter("parts > 1"), "key"))
    earlier = W.partitionBy("class").orderBy("key").rowsBetween(-BEFORE, -1)
    entry = entry.withColumn("before", F.collect_list("key").over(earlier)).join(sets.select("class", *[F.col("bitmap")[i].alias(f"w{i}") for i in range(WORDS)]), "class")
    named = lambda x: [F.col("class").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in ("n", "part", "before", *[f"w{i}" for i in range(WORDS)])]]
    other = entry.select("key", "length", *named("y"))
    lengths = F.explode(F.array(F.col("length") - 1, "length", F.col("length") + 1)).alias("length")
    outer = entry.filter("part <> main").select("key", lengths, "main", *named("x"))
    apart = F.expr(" + ".join(f"bit_count(w{i}_x ^ w{i}_y)" for i in range(WORDS)))
    # of two entries outside the main component one is enough
    fits = F.expr("part_x <> part_y and (part_y = main or x < y)") & near_enough("n_x", "n_y", apart) & ~F.arrays_overlap("before_x", "before_y")
    return outer.join(other, ["key", "length"]).filter(fits).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def near_classes(documents: DataFrame) -> DataFrame:
    """(class, near_class) of the classes that hold several rows or link with others; see the module."""
    noted = counted(documents)
    often = noted.filter("kind = 0").groupBy("key").agg(F.sum("value").alias("n")).filter(F.col("n") >= OFTEN_IN_ALL)
    frequent = np.array(sorted(r["key"] for r in often.orderBy(F.desc("n"), "key").limit(FREQUENT).collect()), np.uint32)
    members = noted.filter("kind = 1").groupBy(F.col("key").alias("class")).agg(F.min("value").alias("doc_id"), F.count("*").alias("n_rows"))
    sets = sets_of(documents, linkable_owners(documents, members))
    total = sets.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    fragments = max(LEAST_FRAGMENTS, int(total * (1 - LEAST)) // FRAGMENT_ENTRIES + 1)
    lists = entries(sets, frequent, fragments).repartition(fragments, "fragment")
    found = cut(lists.groupBy("fragment").applyInPandas(list_members, FOUND))

    short = found.filter("b is not null").select("a", "b")
    long = found.filter("b is null").select("key", "length", F.col("a").alias("class"), "n", "bitmap")
    links = linked(short.unionByName(led(long)), sets)
    parts = connected_components(links, "a", "b")
    links = linked(across(long, parts, sets), sets)
    if not links.isEmpty():
        alone = links.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(parts, "node", "left_anti")
        parts = cut(parts.unionByName(alone.withColumn("component", F.col("node"))))
        arcs = links.join(parts.toDF("a", "of_a"), "a").join(parts.toDF("b", "of_b"), "b")
        wider = connected_components(arcs, "of_a", "of_b").toDF("component", "wider")
        parts = parts.join(wider, "component", "left").select("node", F.coalesce("wider", "component").alias("component"))

    named = members.join(parts.withColumnRenamed("node", "class"), "class", "left").withColumn("part", F.coalesce("component", "class"))
    first = named.filter("component is not null").groupBy("part").agg(F.min("doc_id").alias("least"))
    named = named.filter("component is not null or n_rows > 1").join(first, "part", "left")
    return cut(named.select("class", F.coalesce("least", "doc_id").alias("near_class")))


def fingerprint_classes(documents: DataFrame) -> DataFrame:
    """``fingerprints`` with the ``near_class`` of each row instead of the hash of its set."""
    classes = near_classes(documents)
    told = F.broadcast if classes.count() <= BROADCAST_CLASSES else lambda x: x
    rows = fingerprints(documents).join(told(classes), "class", "left")
    return rows.withColumn("near_class", F.coalesce("near_class", "doc_id")).drop("class")
