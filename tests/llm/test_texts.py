"""Dedup, packing, fingerprints, media and the n-gram join against brute force, with odd cases."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest

from linkweave.llm import bwt, media, ngram_join, packing, spotsigs, suffix_dedup
from tests.conftest import TINY
from tests.llm.helpers import LONG, empty, table


def made_documents(spark, seed=5, n=60):
    """Texts that share passages, with near copies."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(200)]
    text = lambda k: " ".join(rng.choice(words) for _ in range(k))
    passages, texts = [text(14) for _ in range(4)], []
    for i in range(n):
        if i > 5 and rng.random() < 0.5:
            w = texts[rng.randrange(len(texts))].split()
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = rng.choice(words)
            texts.append(" ".join(w))
        else:
            texts.append(f"{text(rng.randint(3, 40))} {rng.choice(passages)} {text(rng.randint(0, 40))}")
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)


def with_odd_cases(spark):
    return made_documents(spark).unionByName(table(spark).filter("doc_id is null or doc_id <> 8").selectExpr("doc_id + 1000 as doc_id", "text"))


@pytest.mark.parametrize("least", [1, 3, 8, 20])
def test_bwt_repeats(least):
    rng = random.Random(least)
    for _ in range(30):
        base = bytes(rng.choice(b"abc") for _ in range(40))
        pieces = [base[(a := rng.randrange(40)) : a + rng.randrange(30)] + bytes(rng.choice(b"ab\x00") for _ in range(rng.randrange(12))) for _ in range(5)]
        seen = {}
        for i, p in enumerate(pieces):
            for o in range(len(p) - least + 1):
                seen.setdefault(p[o : o + least], set()).add((i, o))
        got = {}
        for g, i, o in zip(*(x.tolist() for x in bwt.repeats(pieces, least))):
            got.setdefault(g, set()).add((i, o))
        assert {frozenset(v) for v in got.values() if len(v) > 1} == {frozenset(v) for v in seen.values() if len(v) > 1}


@pytest.mark.parametrize("hot", [False, True])
def test_substring_dedup(spark, monkeypatch, hot):
    if hot:
        monkeypatch.setattr(suffix_dedup, "HOT", 1)
        monkeypatch.setattr(suffix_dedup, "HOT_IN_BATCH", 1)
    docs = with_odd_cases(spark)
    texts = sorted({(r["doc_id"], r["text"] or "") for r in docs.collect() if r["doc_id"] is not None})
    first = {}
    for d, t in texts:
        b = t.encode()
        for o in range(len(b) - 49):
            first.setdefault(b[o : o + 50], d)
    got = {r["doc_id"]: r for r in suffix_dedup.dedup_substrings(docs).collect()}
    for d, t in texts:
        b = t.encode()
        gone = np.zeros(len(b), bool)
        for o in range(len(b) - 49):
            if first[b[o : o + 50]] < d:
                gone[o : o + 50] = True
        left = bytes(np.frombuffer(b, np.uint8)[~gone])
        spans = int((gone & ~np.append(False, gone[:-1])).sum()) if len(b) else 0
        r = got[d]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == (len(b), int(gone.sum()), spans, hashlib.sha256(left).hexdigest())
    assert got[None]["n_removed"] == 0
    assert suffix_dedup.dedup_substrings(empty(spark)).count() == 0


def test_long_text_runs_do_not_depend_on_pieces(monkeypatch):
    raw = LONG.encode()[:20_000]
    whole = suffix_dedup.runs(raw)
    monkeypatch.setattr(suffix_dedup, "PIECE_BYTES", 1000)
    cut = suffix_dedup.runs(raw)
    strings = lambda x: [(s + i, a) for s, n, a in zip(x[0].tolist(), x[1].tolist(), x[3].tolist()) for i in range(n)]
    assert strings(whole) == strings(cut)


def shingles(text, width=5):
    w = [x for x in re.split("[ \t\n\x0b\x0c\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if x]
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())


@pytest.mark.parametrize("longest", [8, 2])
def test_ngram_join(spark, monkeypatch, longest):
    monkeypatch.setattr(ngram_join, "LIST", longest)
    monkeypatch.setattr(ngram_join, "HEAVY_IN_BATCH", 2)
    monkeypatch.setattr(ngram_join, "HEAVY_IN_ALL", 3)
    docs = with_odd_cases(spark)
    rows = docs.collect()
    ids = sorted({(r["doc_id"], r["text"]) for r in rows if r["doc_id"] is not None})
    sets = {d: shingles(t) for d, t in ids}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 75 * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    got = ngram_join.link_components(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] is not None:
            assert (r["n_shingles"], r["component_id"]) == (len(sets[r["doc_id"]]), find(r["doc_id"]))
    kept = ngram_join.one_of_each(docs)
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == sorted({find(d) for d in sets})


def test_ngram_join_of_nothing(spark):
    assert ngram_join.link_components(empty(spark)).count() == 0
    assert ngram_join.one_of_each(table(spark)).columns == table(spark).columns


def test_bitmap_bound():
    rng = np.random.default_rng(1)
    for _ in range(50):
        a, b = (np.unique(rng.integers(0, 400, rng.integers(1, 300)).astype(np.uint64)) for _ in range(2))
        a, b = a * np.uint64(0x9E3779B97F4A7C15), b * np.uint64(0x9E3779B97F4A7C15)
        apart = len(np.setxor1d(a, b))
        assert ngram_join.differing(ngram_join.parity(a), ngram_join.parity(b)) <= apart
        assert int(np.bitwise_count((np.array(ngram_join.sketch(a)) ^ np.array(ngram_join.sketch(b))).view(np.uint64)).sum()) <= apart


def test_packing(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    docs = table(spark)
    rows = packing.pack_documents(docs, path).collect()
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert set(by) == set(texts)
    for d, t in texts.items():
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        times = 2 if d == 3 else 1
        covered = np.zeros(len(ids), int)
        for r in by[d]:
            covered[r["start"] : r["start"] + r["length"]] += 1
        assert (covered == times).all() and sum(r["length"] for r in by[d]) == times * len(ids)
        for r in by[d]:
            assert r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes())
    seqs = {}
    for r in rows:
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in seqs.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 2048 and end & (end - 1) == 0  # no padding at all
    assert packing.pack_documents(empty(spark), path).count() == 0


def test_harmonic_classes(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    rows = packing.pack_documents(spark.read.parquet(f"{TINY.replace('sf0.001', 'sf0.01')}/documents.parquet"), path).collect()
    documents, sequences, pieces = {}, {}, 0
    for r in rows:
        documents.setdefault(r["doc_id"], r["doc_tokens"])
        sequences.setdefault(r["sequence_id"], []).append(r)
        pieces += 1
    assert sum(documents.values()) == sum(r["length"] for r in rows)
    full = [s for s in sequences.values() if sum(r["length"] for r in s) == packing.CAPACITY]
    assert all((n := sum(r["length"] for r in s)) & (n - 1) == 0 for s in sequences.values()) and len(sequences) - len(full) < 12
    # a cut for each sequence, and no more: documents keep together
    assert pieces <= len(documents) + len(sequences) and pieces / len(documents) < 1.6
    # a full bin starts with a fixed number of pieces of one class; the rest of it is filler
    packer, out = packing.Packer(0), []
    for i in range(200):
        out += packer.add(i, bytes(4 * (150 + 37 * i % 1500)))
    by = {}
    for r in out:
        by.setdefault(r[5], []).append(r[2])
    assert len(by) > 50 and all(m == 1 or {packing.CAPACITY // n for n in s[:m]} == {m} for s in by.values() for m in [packing.CAPACITY // s[0]])



def test_tokens_equal_the_tokenizer():
    tok = packing.Tokens(public_tokenizers.path("word_bpe_49k.json"))
    for t in ["It's İstanbul ‘x’ <|endoftext|>", "ábc ﬁ", "Ñandú's ²3 don't'll 'S x y­", "ΑΣ Σ", "", "日本 12３", "a_b--c'd 'relax'ten", "é x", "tab\tand nbsp\x1fend"]:
        assert tok.encode([t])[0] == tok.whole(t), t


def test_fingerprints(spark):
    docs = with_odd_cases(spark)
    rows = docs.collect()
    order = sorted(rows, key=lambda r: (r["doc_id"] is None, -(r["doc_id"] or 0), r["text"] or ""))
    got = spotsigs.fingerprints(docs).collect()
    assert len(got) == len(rows)
    seen = {}
    for r in got:
        seen.setdefault(r["doc_id"], []).append(r)
    for a, b in zip(order, [*order[1:], order[0]]):
        t, u = a["text"] or "", b["text"] or ""
        new = spotsigs.edited(t, u)
        n = len(t) // 3
        assert new == t[: len(t) - n] + u[:n]
        x, y, z = spotsigs.signatures([t, new, u])
        want = (len(t), hashlib.sha256(new.encode()).hexdigest(), spotsigs.fingerprint(x), spotsigs.fingerprint(y), spotsigs.likeness(x, y), spotsigs.likeness(x, z))
        assert want in [(r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"], r["near_edited"], r["near_next"]) for r in seen[a["doc_id"]]]
    assert spotsigs.fingerprints(empty(spark)).count() == 0
    one = spotsigs.fingerprints(docs.filter("doc_id = 3")).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0


def test_ranges_split(spark, monkeypatch):
    monkeypatch.setattr(spotsigs, "RANGE_DOCS", 7)
    test_fingerprints(spark)


def spots_by_hand(text):
    """Spots of a text as tuples of words, by a plain loop."""
    words = [w for w in "".join(c if c.isalnum() or ord(c) > 127 else " " for c in text.lower()).split(" ") if w]
    out, last = set(), None
    for i, w in enumerate(words):
        common = w in spotsigs.ANCHORS
        since = i + 1 if last is None else i - last
        last = i if common else last
        if common or (since % spotsigs.GAP == 1 and (since > 1 or last is None)):
            chain = [x for x in words[i + (1 if common else 0) :] if x not in spotsigs.ANCHORS][: spotsigs.CHAIN]
            if len(chain) == spotsigs.CHAIN:
                out.add((w if common else "", *chain))
    return out or ({tuple(words) or text} if text else set())


def test_spots(spark, monkeypatch):
    texts = [r["text"] or "" for r in with_odd_cases(spark).collect()] + ["the", "a b c", "x_y the__Cat sat on it", "é" * 300, "w " * 70 + "z" * 90]
    for piece, together in ((1 << 18, 1 << 20), (7, 300)):
        monkeypatch.setattr(spotsigs, "PIECE", piece)
        monkeypatch.setattr(spotsigs, "TOGETHER", together)
        got = spotsigs.wide_sets(texts)
        want = [spots_by_hand(t) for t in texts]
        assert [len(x) for x in got] == [len(x) for x in want]
        known = {}
        for x, y in zip(got, want):
            if len(y) == 1:
                assert known.setdefault(next(iter(y)), x[0]) == x[0]
        for i in range(0, len(texts), 3):
            for j in range(i, min(i + 40, len(texts))):
                assert len(np.intersect1d(got[i], got[j])) == len(want[i] & want[j])


def near_by_brute_force(rows):
    """The smallest doc_id that each set reaches through sets of a Jaccard coefficient of 0.75 or more."""
    sets = {}
    for r in rows:
        sets.setdefault(frozenset(spotsigs.signatures([r["text"] or ""])[0].tolist()), []).append(r["doc_id"])
    left, label = set(sets), {}
    while left:
        todo = [left.pop()]
        group = list(todo)
        while todo:
            x = todo.pop()
            near = [y for y in left if x and y and len(x & y) >= 0.75 * len(x | y)]
            left -= set(near)
            todo += near
            group += near
        ids = [i for x in group for i in sets[x] if i is not None]
        label.update({x: min(ids, default=None) for x in group})
    return label


@pytest.mark.parametrize("longest", [32, 1])
def test_near_classes(spark, monkeypatch, longest):
    monkeypatch.setattr(spotsigs, "LIST", longest)
    monkeypatch.setattr(spotsigs, "OFTEN_IN_ALL", 32 if longest == 32 else 12)
    monkeypatch.setattr(spotsigs, "FRAGMENT_ENTRIES", 100)
    if longest == 1:
        monkeypatch.setattr(spotsigs, "BROADCAST_CLASSES", 0)
    short = spark.createDataFrame([(5000 + i, f"the red {w} of a big {w} x{i % 3}") for i in range(40) for w in ("cat", "dog")], "doc_id long, text string")
    docs = with_odd_cases(spark).unionByName(short).unionByName(spark.read.parquet(f"{TINY}/documents.parquet").selectExpr("doc_id + 9000 as doc_id", "text"))
    rows = docs.collect()
    label = near_by_brute_force(rows)
    want = sorted(((r["doc_id"], label[frozenset(spotsigs.signatures([r["text"] or ""])[0].tolist())]) for r in rows), key=str)
    got = spotsigs.fingerprint_classes(docs)
    assert sorted(((r["doc_id"], r["near_class"]) for r in got.collect()), key=str) == want
    assert len({b for _, b in want}) < len(want) - 60
    assert "class" not in got.columns and spotsigs.fingerprint_classes(empty(spark)).count() == 0


def test_near_classes_make_few_pairs(spark, monkeypatch):
    """A large group whose members are about as like as a link needs, and texts of one vocabulary that share some signatures."""
    rng, copies, others = random.Random(5), 600, 300
    base = [f"the b{i} c{i}" for i in range(60)]
    texts = []
    for d in range(copies):
        new = set(rng.sample(range(60), rng.randint(1, 8)))
        texts.append(" ".join(f"the d{d} e{i}" if i in new else u for i, u in enumerate(base)))
    texts += [" ".join(f"the v{rng.randrange(300)} v{rng.randrange(300)}" for _ in range(150)) for _ in range(others)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    class_of = [spotsigs.set_class(x) for x in spotsigs.signatures(texts)]
    made, linked = set(), spotsigs.linked

    def noted(pairs, *rest):
        made.update((r["a"], r["b"]) for r in pairs.distinct().collect())
        return linked(pairs, *rest)

    monkeypatch.setattr(spotsigs, "linked", noted)
    got = {r["class"]: r["near_class"] for r in spotsigs.near_classes(docs).collect()}
    label = near_by_brute_force(docs.collect())
    want = [label[frozenset(x.tolist())] for x in spotsigs.signatures(texts)]
    assert [got.get(c, i) for i, c in enumerate(class_of)] == want and want.count(0) > 500
    unlike = set(class_of[copies:])
    assert sum(a in unlike or b in unlike for a, b in made) == 0
    assert len(made) < 60 * copies


def test_pruned_jaccard():
    a, b = np.arange(10, dtype=np.uint32), np.arange(5, 40, dtype=np.uint32)
    assert spotsigs.likeness(a, b) == 5 / 40 and spotsigs.likeness(a, b, 0.5) == 0 and spotsigs.likeness(a[:0], a[:0]) == 1 and spotsigs.likeness(a, a[:0]) == 0


def test_media_round_trip(spark):
    docs = table(spark)
    got = media.media_digests(docs).collect()
    assert len(got) == 16
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in got:
        raw = (texts[r["doc_id"]] or "").encode()
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    assert media.media_digests(empty(spark)).count() == 0


def test_media_ranges_and_retries(spark, monkeypatch):
    import zipfile

    from linkweave.llm.common import shared_dir

    folder = shared_dir(spark, "archives")
    media.write_archives(table(spark), folder)
    assert {r["doc_id"] for r in media.read_archives(spark, folder, 512).collect()} == {r["doc_id"] for r in table(spark).collect()}
    store, base = media._place(folder)
    name = next(x for x in media.ArchiveReader(folder, 1 << 30).partitions() if x.name).name
    with store.open_input_file(f"{base}/{name}") as f, zipfile.ZipFile(f) as archive:
        info = archive.infolist()[0]
        good, failed = archive.read(info), []

        class Broken:
            def read(self, _):
                failed.append(1)
                raise OSError("lost")

        assert media.member(store, f"{base}/{name}", Broken(), info) == (good, None) and failed == [1]
        info.header_offset += 7
        data, error = media.member(store, f"{base}/{name}", archive, info)
        assert data is None and error


def test_png_is_lossless():
    for text in (None, "", "x", "é" * 100, "a" * 64):
        n, payload = media.payload_of(text)
        assert len(payload) % 64 == 0 and len(payload) >= 64 and media.from_png(media.to_png(payload)) == payload
    with pytest.raises(ValueError):
        media.from_png(media.to_png(b"a" * 64)[:-14] + b"X" + media.to_png(b"a" * 64)[-13:])
