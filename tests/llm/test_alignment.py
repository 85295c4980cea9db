"""The alignment of two tokenizers against whole texts encoded by the libraries and pairs compared one by one."""

import hashlib
import json
import random
from collections import Counter, defaultdict
from functools import cache

import numpy as np
import pytest

from txsieve.llm import alignment
from txsieve.llm.bpe import byte_letters, vocabulary_path

ODD = [" ", "  ", "\n", "\n\n", "\t", "\r", "\r\n", " \r", "\x85", "\x1c", " ", "　", " ", "é", "é", "ß", "中文", "😀", "ﬁ", "½", "\x00", "​", "<s>",
       "<0x0A>", "<|endoftext|>", "the", "of", "ing", "1234", "'s", "));", "{", "}", "x" * 40, "▁"]


@pytest.fixture(scope="module")
def coders():
    with open(vocabulary_path(), encoding="utf-8") as a, open(alignment.pieces_path(), "rb") as b:
        return alignment.Tokenizers(a.read(), b.read())


@cache
def a_names(tokenizer):
    return {i: t for t, i in json.loads(tokenizer.to_str())["model"]["vocab"].items()}


def brute(coders, text):
    """(groups, links) of one text: libraries on the whole text, every pair of tokens compared."""
    if not text:
        return [], []
    a = coders.a.encode(" " + text, add_special_tokens=False).ids
    b = coders.b.encode(text)
    letters, vocab = byte_letters(), a_names(coders.a)
    a_bytes = [bytes(letters[c] for c in vocab[i]) for i in a]
    names = [coders.b.id_to_piece(i) for i in b]
    b_bytes = [bytes((int(n[3:5], 16),)) if coders.b.is_byte(i) else n.replace("▁", " ").encode() for i, n in zip(b, names, strict=True)]
    whole = (" " + text).encode()
    if b"".join(a_bytes) != whole or b"".join(b_bytes) != whole:
        return [], []
    a_span, b_span = [], []
    for parts, spans in ((a_bytes, a_span), (b_bytes, b_span)):
        at = 0
        for part in parts:
            spans.append((at, at + len(part)))
            at += len(part)
    ends = sorted({e for _, e in a_span} & {e for _, e in b_span})
    groups, start = [], 0
    for end in ends:
        inside = [[i for i, (x, y) in zip(ids, spans, strict=True) if start <= x and y <= end] for ids, spans in ((a, a_span), (b, b_span))]
        groups.append(inside)
        start = end
    links = [(i, j) for i, (x, y) in zip(a, a_span, strict=True) for j, (u, v) in zip(b, b_span, strict=True) if x < v and u < y]
    return groups, links


def expected(coders, rows):
    found = [(i, *brute(coders, t)) for i, t in rows]
    count = Counter(link for _, _, links in found for link in links)
    highest = defaultdict(int)
    for (_, b), n in count.items():
        highest[b] = max(highest[b], n)
    out = []
    for i, groups, links in found:
        shown = ";".join("|".join(",".join(map(str, side)) for side in g) for g in groups)
        digest = hashlib.sha256(shown.encode()).hexdigest() if groups else ""
        out.append((i, sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), len(links),
                    sum(count[x] == highest[x[1]] for x in links), sum(count[x] for x in links), digest))
    return out, count, highest


def odd_texts(n, seed=3):
    draw = random.Random(seed)
    return ["".join(draw.choice([*ODD, " ", " "]) for _ in range(draw.randrange(0, 30))) for _ in range(n)]


def as_documents(spark, rows):
    """With columns that have the names of results and of inner columns."""
    named = [(i, t, 1, 2, "x", "y") for i, t in rows]
    return spark.createDataFrame(named, "doc_id long, text string, n_a long, block long, groups string, pair string")


def aligned(documents):
    blocks = alignment.aligned_blocks(documents)
    return alignment.aligned_documents(blocks, alignment.id_links(blocks))


def test_equals_whole_texts_and_all_pairs(spark, coders):
    texts = odd_texts(400)
    rows = [*enumerate(texts), (3, texts[5]), (3, texts[5]), (None, texts[7]), (None, None), (1000, None), (1001, ""), (1002, " "), (1003, "\n"), (1004, "a▁b")]
    wanted, _, _ = expected(coders, rows)
    got = aligned(as_documents(spark, rows).repartition(5)).collect()
    assert Counter(map(tuple, got)) == Counter(wanted)


def test_links_and_groups_are_given_themselves(spark, coders):
    rows = list(enumerate(odd_texts(60, seed=8)))
    _, count, highest = expected(coders, rows)
    links = alignment.id_links(alignment.aligned_blocks(as_documents(spark, rows)))
    assert {(r.a_id, r.b_id): (r.n, r.best) for r in links.collect()} == {k: (n, n == highest[k[1]]) for k, n in count.items()}
    got = {r.doc_id: [[list(g.a), list(g.b)] for g in r.groups] for r in alignment.document_groups(as_documents(spark, rows)).collect()}
    assert got == {i: brute(coders, t)[0] for i, t in rows}


def test_empty_table(spark):
    assert aligned(as_documents(spark, [])).collect() == []


def test_only_texts_without_tokens(spark):
    got = aligned(as_documents(spark, [(1, None), (2, ""), (2, "▁")])).collect()
    assert [tuple(r)[1:] for r in got] == [(0, 0, 0, 0, 0, 0, "")] * 3


def test_long_text(spark, coders):
    """Several megabytes in one row, which fill a block of their own: as many of everything as in the repeated part, and its borders."""
    part = "the tionsh of ingly was thereof 1234.\n"
    groups, links = brute(coders, part * 3)
    once, again = brute(coders, part * 2), brute(coders, part)
    step = len(once[0]) - len(again[0])
    got = aligned(as_documents(spark, [(1, part * 100_000), (2, "a")])).filter("doc_id = 1").first()
    assert len(groups) - len(once[0]) == step
    assert got.n_groups == len(again[0]) + 99_999 * step
    assert got.n_links == len(again[1]) + 99_999 * (len(links) - len(once[1]))
    assert got.count_sum >= got.n_links


def test_table_is_started_again_within_its_bound(coders, monkeypatch):
    with open(vocabulary_path(), encoding="utf-8") as a, open(alignment.pieces_path(), "rb") as b:
        units = alignment.UnitTable(a.read(), b.read())
    monkeypatch.setattr(alignment, "TABLE_BYTES", 200_000)
    draw = random.Random(1)
    most = 0
    for _ in range(30):
        text = " ".join("".join(draw.choice("abcdefgh") for _ in range(6)) for _ in range(500))
        (codes,) = units.codes([text])
        groups, links = brute(coders, text)
        assert units.digest(codes) == hashlib.sha256(";".join("|".join(",".join(map(str, s)) for s in g) for g in groups).encode()).hexdigest()
        assert int(units.sizes[3][codes].sum()) == len(links)
        most = max(most, units.bytes)
    assert most < 200_000 + 500 * 500


def test_pointer_jumping_equals_common_ends():
    draw = random.Random(6)
    for _ in range(200):
        size = draw.randrange(1, 80)
        a, b = (np.array(sorted({*draw.sample(range(1, size + 1), draw.randrange(0, size)), size})) for _ in range(2))
        last = alignment.terminals(a, b)
        ends = np.concatenate([a, b])
        common = np.array(sorted(set(a) & set(b)))
        assert (ends[last] == common[np.searchsorted(common, ends)]).all()
        assert (last >= len(a)).all()
        left, right = alignment.overlaps(a, b)
        starts = [np.concatenate([[0], x[:-1]]) for x in (a, b)]
        assert set(zip(left.tolist(), right.tolist(), strict=True)) == {
            (i, j) for i in range(len(a)) for j in range(len(b)) if starts[0][i] < b[j] and starts[1][j] < a[i]
        }
