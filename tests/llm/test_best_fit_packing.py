"""Best-fit packing: the plan against full searches, pieces against the tokenizer file."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest

from linkweave.llm import best_fit_packing as B, bin_plan
from tests.llm.helpers import A, LONG, empty, table

PATH = public_tokenizers.path("byte_bpe_50k.json")


def fewest(items, capacity):
    items, best = sorted(items, reverse=True), [len(items)]

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(items):
            best[0] = len(bins)
            return
        for k in [k for k, room in enumerate(bins) if room >= items[i] and room not in bins[:k]]:
            go(i + 1, [*bins[:k], bins[k] - items[i], *bins[k + 1 :]])
        go(i + 1, [*bins, capacity - items[i]])

    go(0, [])
    return best[0]


def test_fixed_sets_leave_the_optimum():
    rng, fixed = random.Random(6), 0
    for _ in range(1500):
        capacity = rng.choice([10, 17, 30])
        items = [rng.randint(1, capacity) for _ in range(rng.randint(1, 9))]
        stock = bin_plan.Stock(Counter(items), capacity)
        plan = bin_plan.reduced(stock)
        rest = [x for x in range(capacity + 1) for _ in range(stock.n[x])]
        assert fewest(items, capacity) == sum(plan.values()) + fewest(rest, capacity)
        fixed += sum(len(k) * v for k, v in plan.items())
    assert fixed > 3000


def test_best_fit_is_item_by_item():
    rng = random.Random(2)
    for _ in range(300):
        items = sorted((rng.randint(1, 30) for _ in range(rng.randint(0, 60))), reverse=True)
        room = []
        for x in items:
            fits = [i for i, r in enumerate(room) if r >= x]
            if fits:
                room[min(fits, key=lambda i: room[i])] -= x
            else:
                room.append(30 - x)
        plan = bin_plan.best_fit(bin_plan.Stock(Counter(items), 30))
        assert sorted(30 - sum(k) for k, v in plan.items() for _ in range(v)) == sorted(room)
        assert sorted(x for k, v in plan.items() for x in k * v) == sorted(items)


def test_large_plan_is_near_the_bound():
    counts = {x: random.Random(x).randint(0, 4000) for x in range(1, 1024)}
    plan = bin_plan.planned(counts, 1024)
    assert sum(plan.values()) <= 1.01 * sum(x * n for x, n in counts.items()) / 1024 and len(plan) < 5000


@pytest.mark.parametrize("text", ["", " ", "a", "  a  b\n\n c\t\td ", A, "it's we'll DON'T 12ab 3.5", "日本語 ünï😀  x y", "<|endoftext|> x <|y|>", "x" * 30_000, " " * 3000 + "y", "a" + "\n" * 20_000 + "y", "\n" * 500, "Ⅷ²³ ٣٤ ñandú", LONG[:50_000], "\x00\x1f ­"])
def test_ids_are_the_files(text):
    from tokenizers import Tokenizer

    want = Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids
    assert np.frombuffer(B.ids_of(PATH).encode(text), "<u4").tolist() == want


def test_pieces(spark):
    docs = table(spark).unionByName(table(spark).selectExpr("doc_id + 100 as doc_id", "concat(text, ' and more') as text", "lang", "source", "n_chars", "tag", "class", "share", "bucket")).repartition(4)
    rows = B.pack_documents(docs, PATH).collect()
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(PATH)
    want = Counter()
    for r in docs.collect():
        ids = [*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 2]
        n, start, stop = len(ids), 0, (len(ids) - 1) % 1024 + 1
        for piece in range(-(-n // 1024)):
            want[r["doc_id"], piece, start, stop - start, zlib.crc32(np.array(ids[start:stop], "<u4").tobytes())] += 1
            start, stop = stop, stop + 1024
    assert Counter(tuple(r)[:5] for r in rows) == want
    held = defaultdict(list)
    for r in rows:
        held[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in held.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(held) <= sum(r["length"] for r in rows) // 1024 + 2
    assert B.pack_documents(empty(spark), PATH).collect() == []
