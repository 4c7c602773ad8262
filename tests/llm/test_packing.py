import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from lorewell.llm.packing import cuts, fillings, pack

from .cases import ROWS, clashing, docs, empty


def test_pieces_and_places(spark):
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tok.encode_special_tokens = True
    rows = pack(docs(spark), keep_ids=True).collect()
    by_doc, bins = defaultdict(list), defaultdict(list)
    for r in rows:
        assert r.length == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        by_doc[r.doc_id].append(r)
        bins[r.sequence_id].append((r.offset, r.length))
    for places in bins.values():
        end = 0
        for a, n in sorted(places):
            assert a == end
            end += n
        assert end <= 1024
    for i, t, _ in ROWS:
        if i == 10:
            continue
        ids = tok.encode(t or "", add_special_tokens=False).ids + [2]
        parts = sorted(by_doc[i], key=lambda r: r.piece)
        assert [x for p in parts for x in p.ids] == ids
        assert [(p.start, p.length) for p in parts] == cuts(len(ids), 1024)
    assert len(by_doc[10]) == 2
    total = sum(r.length for r in rows)
    assert len(bins) <= -(-total // 1024) + 1


def test_extra_columns_and_empty_table(spark):
    assert pack(clashing(docs(spark))).count() == pack(docs(spark)).count()
    assert pack(empty(spark)).collect() == []


def test_remainder_comes_first():
    assert cuts(2500, 1024) == [(0, 452), (452, 1024), (1476, 1024)]
    assert cuts(2048, 1024) == [(0, 1024), (1024, 1024)]
    assert cuts(1, 1024) == [(0, 1)]


def test_two_fit_replaces_the_smallest():
    # greedy 6+3 leaves 1; taking 3 out, 2+2 fills the gap of 4 exactly
    assert ((6, 2, 2), 1) in fillings({6: 1, 3: 1, 2: 2}, 10)


def best_fit_decreasing(counts, room):
    gaps = []
    for x in sorted(counts.elements(), reverse=True):
        k = min((i for i, g in enumerate(gaps) if g >= x), key=gaps.__getitem__, default=None)
        if k is None:
            gaps.append(room - x)
        else:
            gaps[k] -= x
    return len(gaps)


def test_fillings_hold_each_piece_once():
    r = random.Random(1)
    for _ in range(30):
        counts = Counter(r.choices(range(1, 65), k=r.randint(0, 400)))
        plan = fillings(counts, 64)
        used = Counter()
        for lengths, times in plan:
            assert sum(lengths) <= 64
            for k in lengths:
                used[k] += times
        assert used == +counts
        assert sum(t for _, t in plan) <= best_fit_decreasing(counts, 64) + 1


def test_long_runs_of_blanks(spark):
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tok.encode_special_tokens = True
    n = 1_000_000
    texts = [" " * n, "a" + " " * n + "b", "it's\n" + "\n" * n + "'s 1", "x \u3000" + " \t\u2003" * (n // 3) + "\x1c!", " " * 70_000 + "a" + "\xa0" * 70_000 + "\u4e2d" + " " * 65_535 + "c  "]
    got = defaultdict(list)
    for r in sorted(pack(docs(spark, [(i, t, "s") for i, t in enumerate(texts)]), keep_ids=True).collect(), key=lambda r: r.piece):
        got[r.doc_id] += r.ids
    for i, t in enumerate(texts):
        assert got[i] == tok.encode(t, add_special_tokens=False).ids + [2]


def test_strings_of_special_tokens(spark):
    """Ordinary text as the vocabulary's description encodes them, or tokens on request."""
    text = "hello <|endoftext|> world<|endoftext|>"
    for special in (None, {"<|endoftext|>": 50256}):
        tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
        tok.encode_special_tokens = special is None
        (r,) = pack(docs(spark, [(1, text, "s")]), keep_ids=True, special_tokens=special).collect()
        assert r.ids == tok.encode(text, add_special_tokens=False).ids + [2] and (50256 in r.ids) == (special is not None)
