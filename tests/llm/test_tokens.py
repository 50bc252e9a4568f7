"""Spelling variants, tree BPE and token alignment against plain versions and the public libraries."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from renewlens.llm import alignment, bpe_tree, chunks, spelling

RANKS = public_tokenizers.path(bpe_tree.VOCABULARY)
ODD = [
    "a  b  c   d \n\n x  ", " ", "\n", "don't DON'T we'll x'y 12 345 +-*/", "a" * 3000, "=" * 700, "ab" * 900 + " z",
    "naïve Ünïcödé × ÷ 汉字漢字かな", "▁x y▁", "<|endoftext|> <s> </s> <0x41>", "a\u0000b \u0085 c", "\U0001f600 \U0001f600 !", "　 x",
]


def near_brute(rows):
    """rows: (doc_id, text) -> (word, form, root, n, n_near, form_n)."""
    n = Counter()
    upper = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for d, t in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = w.translate(upper)
            h = zlib.crc32(f"{'' if d is None else d}:{w}".encode())
            if h % 97 == 0:
                k = h % len(w)
                w = w[:k] + w[k + 1:]
            n[w] += 1
    n = {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))

    links = {w: [v for v in n if abs(len(v) - len(w)) < 2 and v != w and near(w, v)] for w in n}
    form = {}
    for w, found in links.items():
        best = min(found, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n[w], len(links[w]), n.get(form[w])))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def misspelt():
    rng = random.Random(5)
    base = ["".join(rng.choice("abcdeé") for _ in range(rng.choice([5, 6, 7, 12, 70]))) for _ in range(60)]
    rows = []
    for i in range(200):
        words = []
        for _ in range(40):
            w = base[int(len(base) * rng.random() ** 2)]
            if rng.random() < 0.3:
                k = rng.randrange(len(w))
                w = rng.choice([w[:k] + w[k + 1:], w[:k] + "ab"[k % 2] + w[k:], w[:k] + "ÿ" + w[k + 1:]])
            words.append(w.upper() if rng.random() < 0.1 else w)
        rows.append((i, " ".join(words)))
    long = "x" * 5000 + "y" * 300
    rows += [(None, " ".join(base[:9])), (7, None), (8, ""), (9, f"{long} {long} {long} {long[1:]}, {long[1:]}; {long[1:]}"), (3, rows[3][1])]
    return rows


def words_of(found):
    columns = ("word", "form", "root", "n", "n_near", "form_n")
    return sorted((tuple(r) for r in found.select(*columns).collect()), key=repr)


def test_spelling(spark, misspelt):
    docs = spark.createDataFrame([(*r, 1, "a") for r in misspelt], "doc_id long, text string, n int, word string").repartition(4)
    expected = near_brute(misspelt)
    assert words_of(spelling.spelling_variants(docs)) == expected
    # chains of forms are among them
    assert any(r[1] and r[1] != r[2] for r in expected)
    # many filters in many rounds
    assert words_of(spelling.spelling_variants(docs, shard_words=40, round_bytes=300)) == expected
    assert words_of(spelling.spelling_variants(docs.limit(0))) == []


def test_filters_lose_no_word():
    words = [f"word{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}" for i in range(600)]
    shards = spelling.Shards({6: 600}, 100)
    points = spelling._code_points(words, 6)
    hashes = spelling._spread(spelling._terms(points, np.arange(6)).sum(axis=1, dtype=np.uint64), 6)
    numbers = shards.shard(hashes, 6)
    bits = {}
    for k in range(len(shards.blocks)):
        own = hashes[numbers == k]
        filled = np.zeros(shards.blocks[k], dtype=np.uint64)
        np.bitwise_or.at(filled, shards.block(own, np.full(len(own), k)), spelling._mask(own))
        bits[k] = filled.tobytes()
    assert len(spelling.Probe(shards, bits).test(hashes, 6)) == 600


@pytest.fixture(scope="module")
def library():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe_tree.read_ranks(RANKS), special_tokens={})


@pytest.mark.parametrize("leaf", [1, 5, 24])
def test_tree_joins(library, leaf):
    encoder = bpe_tree.TreeEncoder(bpe_tree.read_ranks(RANKS), leaf=leaf, pairs=500)
    rng = random.Random(leaf)
    for size in [1, 2, 3, 7, 30, 90, 400] * 25:
        word = "".join(rng.choice("abcdeinrst" if size % 2 else "aab") for _ in range(size))
        assert encoder.encode(word.encode()) == library.encode_ordinary(word)
    for word in ("a" * 6000, "ab" * 4000, "-=" * 999):
        assert encoder.encode(word.encode()) == library.encode_ordinary(word)


def test_leaves_side_by_side():
    ranks = bpe_tree.read_ranks(RANKS)
    tree = bpe_tree.TreeEncoder(ranks)
    rng = random.Random(1)
    words = [bytes(rng.choice(b" etaoinsrhl\xc3\xa9") for _ in range(rng.randrange(1, 25))) for _ in range(2000)]
    assert bpe_tree.LeafEncoder(ranks).encode(words) == [[ranks[t] for t in tree.merged(w)] for w in words]
    assert all(tree.merged(w) == tree._merged_long(w) for w in words)


def test_encode_and_decode(spark, docs, rows, library):
    more = spark.createDataFrame([(-1 - i, None, t, "a", 1, "b", "c", "d", "e") for i, t in enumerate(ODD)], docs.schema)
    found = bpe_tree.decode_ids(bpe_tree.encode_texts(docs.unionByName(more), RANKS, public_tokenizers.PATTERN), RANKS)
    assert found.columns == [*docs.columns, "ids", "decoded"]
    out = found.collect()
    assert len(out) == len(rows) + len(ODD)
    for r in out:
        assert np.frombuffer(r.ids, "<u4").tolist() == library.encode_ordinary(r.text or "")
        assert bytes(r.decoded) == (r.text or "").encode()
    assert bpe_tree.encode_texts(docs.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0
    with pytest.raises(ValueError):
        bpe_tree.encode_texts(docs.withColumn("ids", F.lit(1)), RANKS, public_tokenizers.PATTERN)
    none = spark.createDataFrame([(None,), (b"",)], "ids binary")
    assert {r.decoded for r in bpe_tree.decode_ids(none, RANKS).collect()} == {None, b""}


def test_decoding_tree(library):
    ids = library.encode_ordinary("some words in a row " * 50)
    for leaf in (1, 7, 1 << 16):
        decoder = bpe_tree.TreeDecoder(bpe_tree.read_ranks(RANKS), leaf)
        assert decoder.decode(np.array(ids)) == ("some words in a row " * 50).encode()


def test_galloping():
    rng = random.Random(2)
    for _ in range(300):
        cuts, parts, starts = [0, *sorted(rng.sample(range(1, 900), 5)), 1000], ([], []), ([], [])
        for lo, hi in zip(cuts, cuts[1:]):
            for part, start in zip(parts, starts):
                start.append(len(part))
                part += sorted(rng.sample(range(lo + 1, hi + 1), rng.randrange(0, hi - lo)))
        a, b = (np.array(x, dtype=np.int64) for x in parts)
        rank, common = alignment.matched(a, b, *map(np.array, starts))
        assert rank.tolist() == [sum(y < x for y in parts[1]) for x in parts[0]]
        assert common.tolist() == [x in set(parts[1]) for x in parts[0]]


def test_memo_drops_what_is_not_asked_for():
    made = []
    memo = chunks.Memo(lambda x: made.extend(x) or [p * 2 for p in x], entries=3, longest=4)
    for k in range(50):
        assert memo.get([b"a", b"%d" % k, b"long piece"]) == [b"aa", b"%d%d" % (k, k), b"long piecelong piece"]
    assert made.count(b"a") == 1 and made.count(b"long piece") == 50 and len(memo.young) + len(memo.old) < 9


def align_brute(rows):
    """Whole texts through both libraries: (doc_id, counts, groups) with overlaps by comparing ranges."""
    import sentencepiece
    from tokenizers import Tokenizer

    first = Tokenizer.from_file(public_tokenizers.path(alignment.FIRST))
    first.encode_special_tokens = True
    second = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(alignment.SECOND))
    letter = alignment.byte_letters()

    def bytes_b(i):
        p = second.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode()

    def spans(ids, spelt):
        ends = np.cumsum([len(spelt(i)) for i in ids]).tolist()
        return list(zip([0, *ends], ends))

    found, count = [], Counter()
    for d, t in rows:
        a = first.encode(" " + t, add_special_tokens=False).ids if t else []
        b = second.encode(t) if t else []
        spell_a = lambda i: bytes(letter[c] for c in first.id_to_token(i))
        if not t or not b"".join(map(spell_a, a)) == b"".join(map(bytes_b, b)) == (" " + t).encode():
            a, b = [], []
        at_a, at_b = spans(a, spell_a), spans(b, bytes_b)
        ends = sorted({e for _, e in at_a} & {e for _, e in at_b})
        by_end = lambda ids, at: [",".join(str(i) for i, (_, e) in zip(ids, at) if lo < e <= hi) for lo, hi in zip([0, *ends], ends)]
        groups = ";".join(map("|".join, zip(by_end(a, at_a), by_end(b, at_b))))
        links = [(x, y) for x, (s, e) in zip(a, at_a) for y, (u, v) in zip(b, at_b) if s < v and u < e]
        count.update(links)
        found.append((d, len(a), len(b), len(ends), links, groups))
    top = {}
    for (_, y), n in count.items():
        top[y] = max(top.get(y, 0), n)
    return sorted(
        ((d, na, nb, g, len(links), groups, sum(count[p] == top[p[1]] for p in links), sum(count[p] for p in links))
         for d, na, nb, g, links, groups in found), key=repr)


def test_alignment(spark, rows, nothing, monkeypatch):
    some = [(d, t) for d, _, t in rows if t is None or len(t) < 2000] + [(-1 - i, t[:900]) for i, t in enumerate(ODD)]
    some += [some[0], (None, "one of no id")]
    docs = spark.createDataFrame([(*r, 1, "x", "y") for r in some], "doc_id long, text string, row int, slice string, pairs string")
    paths = [public_tokenizers.path(x) for x in (alignment.FIRST, alignment.SECOND)]
    columns = ("doc_id", *alignment.COUNTS, "groups", "n_best", "count_sum")
    expected = align_brute(some)
    for parts in (1, 5):
        got = alignment.align(docs.repartition(parts), *paths)
        assert tuple(got.columns) == columns
        assert sorted((tuple(r) for r in got.collect()), key=repr) == expected
    assert any(r[1] == 0 and r[0] is not None and r[0] < 0 for r in expected)  # a text that a tokenizer changes
    assert alignment.align(nothing, *paths).count() == 0


def test_packing():
    for values in ([], [0], [5, -3, 1 << 62, 7], list(range(1000))):
        x = np.array(values, dtype=np.int64)
        assert alignment.unpack(alignment.pack(x), len(x)).tolist() == values
