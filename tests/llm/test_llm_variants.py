"""Spelling variants, fingerprint groups and token alignment against plain Python."""

import random
import re
import zlib
from collections import Counter, defaultdict
from hashlib import sha256

import llm_plain as plain
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tokenizers
import xxhash
from pyspark.sql import functions as F

from gaugemill.llm import alignment, covering, queries, spelling
from gaugemill.llm.groups import components
from gaugemill.llm.perfecthash import PerfectHash

LAST = (1 << 63) - 1


def _groups(nodes, linked):
    """The smallest node reachable from each; ``nodes`` in order."""
    up = list(range(len(nodes)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(nodes)):
        for j in range(i):
            if linked(nodes[i], nodes[j]):
                a, b = top(i), top(j)
                up[max(a, b)] = min(a, b)
    return [top(i) for i in range(len(nodes))]


# spelling variants


def _letters(text):
    return [r.encode().lower().decode() for r in re.findall("[A-Za-zÀ-ÿ]+", text or "")]


def _one_apart(x, y):
    if len(x) == len(y):
        return sum(a != b for a, b in zip(x, y, strict=True)) == 1
    x, y = sorted((x, y), key=len)
    return len(y) == len(x) + 1 and any(y[:i] + y[i + 1:] == x for i in range(len(y)))


def _plain_variants(docs, least=7, occurrences=2, ratio=10):
    n = Counter()
    for d, t in docs:
        for run in _letters(t):
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % 31 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1:]
            if len(run) >= least:
                n[run] += 1
    words = sorted(w for w, k in n.items() if k >= occurrences)
    near = {w: [x for x in words if _one_apart(w, x)] for w in words}
    form = {}
    for w in words:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= ratio * n[w] else None
    out = set()
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return out


@pytest.fixture(scope="module")
def misspelt():
    pick = random.Random(3)
    base = ["aardvark", "bookkeeper", "committee", "mississippi", "élévation", "straÞenname", "aaaaaaaa", "aaaaaaa", "letterbox", "x÷xxxxxx"]
    base += ["".join(pick.choice("abc") for _ in range(pick.randint(7, 9))) for _ in range(60)]

    def wrong(w):
        at, kind = pick.randrange(len(w)), pick.randrange(3)
        return w[:at] + ("" if kind == 0 else pick.choice("abcéÿ") + (w[at:] if kind == 2 else w[at + 1:]))[:len(w) + 1] + (w[at + 1:] if kind == 0 else "")

    docs = [(1, None), (2, ""), (3, "short words do not count"), (None, "Aardvark, AARDVARK; aardvark"), (4, "ÉLÉVATION élévation Élévation")]
    for d in range(5, 90):
        words = [w if pick.random() < 0.9 else wrong(w) for w in pick.choices(base, [1 / (k + 1) for k in range(len(base))], k=60)]
        docs.append((d, pick.choice([" ", "-", "\n", "1"]).join(w.upper() if pick.random() < 0.1 and w.isascii() else w for w in words)))
    docs += [docs[10], docs[10]]
    docs.append((200, "bookkeeper " * 3000 + "bookkeper bookkeper bookeper bookeper"))
    return docs


def test_spelling_variants(spark, misspelt):
    table = spark.createDataFrame(misspelt, "doc_id long, text string").repartition(4)
    want = _plain_variants(misspelt)
    got = spelling.spelling_variants(table).select("word", "form", "root", "n", "n_near", "form_n").collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    assert any(form for _, form, *_ in want) and any(near > 1 for *_, near, _ in want)


def test_spelling_chain(spark):
    """Forms are followed over several steps, and ties go to the first in code-point order."""
    words = {"abcdefg": 1000, "abcdefgh": 100, "abcdefghi": 10, "abcdefghij": 1, "zzzzzzz": 20, "zzzzzzy": 20, "zzzzzzx": 2}
    table = spark.createDataFrame([(k, w) for k, (w, n) in enumerate(words.items()) for _ in range(n)], "doc_id long, text string")
    rows = {r.word: r for r in spelling.spelling_variants(table, occurrences=1, deletes=None).collect()}
    assert [rows[w].root for w in ("abcdefghij", "abcdefghi", "abcdefgh", "abcdefg")] == ["abcdefg"] * 4
    assert rows["abcdefghij"].form == "abcdefghi" and rows["zzzzzzx"].form == "zzzzzzy" and rows["zzzzzzy"].n_near == 2


def test_task_passes_counts_on_in_parts(spark, misspelt, monkeypatch):
    monkeypatch.setattr(spelling, "MOST_HELD", 5)
    table = spark.createDataFrame(misspelt, "doc_id long, text string")
    counts = {r.word: r.n for r in spelling.count_words(table, deletes=None).collect()}
    assert counts == {w: n for w, n in Counter(w for _, t in misspelt for w in _letters(t)).items() if len(w) >= 7}


def test_spelling_of_nothing(nothing, table):
    assert spelling.spelling_variants(nothing).count() == 0
    assert spelling.spelling_variants(table).columns == ["word", "form", "root", "n", "n_near", "form_n"]


# fingerprints


def _plain_fingerprint(text):
    words = [w for w in re.split("[ \t-\r]+", (text or "").encode().lower().decode()) if w]
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else [" ".join(words)][:len(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints_and_groups(spark, docs, table):
    got = covering.near_fingerprints(table)
    assert got.columns == ["doc_id", "lang", "source", "n_chars", "n_words", "N_LINES", "part", "node", "score", "ids", "count", "fingerprint", "component_id"]
    rows = sorted(((LAST if d is None else d), _plain_fingerprint(t)) for d, t in docs)
    tops = _groups([f for _, f in rows], lambda x, y: (x ^ y).bit_count() <= 3)
    want = Counter((d, f, rows[top][0]) for (d, f), top in zip(rows, tops, strict=True))
    found = Counter((LAST if r.doc_id is None else r.doc_id, r.fingerprint % (1 << 64), r.component_id) for r in got.collect())
    assert found == want
    assert {r.doc_id for r in got.where("fingerprint = 0").collect()} == {1, 2, 3}


def test_spark_hashes_shingles_alike(spark):
    """The seed of Spark's own function is the contract's, so SQL users can check single shingles."""
    assert spark.sql("SELECT xxhash64('ab c dé')").first()[0] % (1 << 64) == xxhash.xxh64_intdigest("ab c dé".encode(), 42)


@pytest.mark.parametrize("fixed", [0, (1 << 34) - 1, 0x0F0F0F0F0F0F0F0F, ((1 << 64) - 1) ^ 0b1011011])
def test_masks_cover(fixed):
    """Any three free bits are missed by some mask, and each mask fixes a bit more."""
    masks = covering.masks_below(fixed, 3)
    free = [i for i in range(64) if not fixed >> i & 1]
    pick = random.Random(1)
    for _ in range(2000):
        chosen = sum(1 << b for b in pick.sample(free, 3))
        assert any(not (m & chosen) for m in masks)
    assert all(m & fixed == fixed and m != fixed for m in masks) and len(masks) == 15


@pytest.mark.parametrize("most", [2, 32])
def test_close_pairs_of_a_crowd(spark, most, monkeypatch):
    """A crowd of alike fingerprints, with large buckets, loses no pair."""
    monkeypatch.setattr(covering, "MOST_COMPARED", most)
    pick = random.Random(2)
    base, nodes = pick.getrandbits(64), set()
    while len(nodes) < 300:
        x = base
        for bit in pick.sample(range(10 if most > 2 else 40), pick.randint(0, 5)):
            x ^= 1 << bit
        nodes.add(x)
    nodes |= {pick.getrandbits(64) for _ in range(200)}
    signed = [x - (1 << 64) if x >> 63 else x for x in nodes]
    want = {(a, b) for a in signed for b in signed if a < b and ((a ^ b) % (1 << 64)).bit_count() <= 3}
    if most == 2:
        monkeypatch.setattr(covering, "MOST_COMPARED", 8)
    got = covering.close_pairs(spark.createDataFrame([(x,) for x in signed], "node long"))
    assert len(want) > 300 and Counter((r.a, r.b) for r in got.collect()) == Counter(want)


def test_long_text_in_chunks(monkeypatch):
    text = " ".join(str(k) for k in range(500))
    want = covering.fingerprint_of(text)
    monkeypatch.setattr(covering, "CHUNK", 7)
    assert covering.fingerprint_of(text) == want == _plain_fingerprint(text)


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    assert {(r.node, r.comp) for r in components(edges).collect()} == {(k, 0) for k in range(41)} | {(100, 100), (101, 100)}


def test_fingerprints_of_nothing(nothing):
    assert covering.near_fingerprints(nothing).count() == 0


# alignment


@pytest.fixture(scope="module")
def tokenizer_files():
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f, open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as g:
        return f.read(), g.read()


def _plain_alignment(texts, files):
    first = tokenizers.Tokenizer.from_str(files[0])
    first.encode_special_tokens = True
    second = sentencepiece.SentencePieceProcessor(model_proto=files[1])
    table = {}
    n = 0
    for b in range(256):  # the usual byte-level alphabet
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255:
            table[chr(b)] = b
        else:
            table[chr(256 + n)] = b
            n += 1

    def of_piece(i):
        piece = second.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", piece) else piece.replace("▁", " ").encode()

    kept = []
    for text in texts:
        whole = b" " + (text or "").encode()
        a = first.encode(" " + text, add_special_tokens=False) if text else None
        b = second.encode(text, num_threads=1) if text else None
        a_bytes = [bytes(table[c] for c in first.id_to_token(i)) for i in a.ids] if text else []
        b_bytes = [of_piece(i) for i in b] if text else []
        if not text or b"".join(a_bytes) != whole or b"".join(b_bytes) != whole:
            kept.append(None)
            continue
        a_ends, b_ends = np.cumsum([len(x) for x in a_bytes]).tolist(), np.cumsum([len(x) for x in b_bytes]).tolist()
        both = sorted(set(a_ends) & set(b_ends))
        groups, links, start = [], [], 0
        for end in both:
            x = [i for i, e in zip(a.ids, a_ends, strict=True) if start < e <= end]
            y = [i for i, e in zip(b, b_ends, strict=True) if start < e <= end]
            groups.append(",".join(map(str, x)) + "|" + ",".join(map(str, y)))
            spans_a = [(e - len(p), e, i) for p, e, i in zip(a_bytes, a_ends, a.ids, strict=True) if start < e <= end]
            spans_b = [(e - len(p), e, i) for p, e, i in zip(b_bytes, b_ends, b, strict=True) if start < e <= end]
            links += [(i, j) for s, e, i in spans_a for t, u, j in spans_b if s < u and t < e]
            start = end
        kept.append((len(a.ids), len(b), groups, links))
    counts = Counter(p for k in kept if k for p in set(k[3]))
    best = defaultdict(int)
    for (i, _), k in counts.items():
        best[i] = max(best[i], k)
    return [
        (0, 0, 0, 0, 0, 0, "") if k is None else
        (k[0], k[1], len(k[2]), len(k[3]), sum(counts[p] == best[p[0]] for p in k[3]), sum(counts[p] for p in k[3]), ";".join(k[2]))
        for k in kept]


HARD = ["", None, " ", "  ", "\n", "a", " a", "a ", "two words", "  two   words  ", "tab\tand\nnew\r\nline", "it's we'll o'clock 'tis", "<|endoftext|> a <s> b </s><unk>",
        "<0x41> literally", "mark ▁ inside", "▁", "naïve façade Ünïcode ñandú", "日本語 のテキスト", "emoji 👩‍👩‍👧 done", "x\x00y \x07 z", "ﬁ ligature Å", "3 cats, 4.5 dogs (and 12) 'quoted' \"both\"",
        "été été", "a" * 3000, "don't  stop", "word" * 700 + " next word", "á b̀ c", " hard blank here", "﻿bom first", "end of line \n next line"]


@pytest.mark.parametrize("band", [None, 3000])
def test_alignment(spark, docs, table, tokenizer_files, band, monkeypatch):
    if band:
        monkeypatch.setattr(alignment, "SHARD", 64)
    monkeypatch.setattr(alignment, "BLOCK", 100)
    extra = [(1000 + k, t) for k, t in enumerate(HARD)] + [(2000, HARD[8]), (2000, HARD[8])]
    more = spark.createDataFrame(extra, "doc_id long, text string")
    all_ = table.where("coalesce(length(text), 0) < 5000" if band is None else "doc_id <= 13").select("doc_id", "text").unionByName(more)
    given = [(r.doc_id, r.text) for r in all_.collect()]
    assert len(given) >= 14 + len(extra)
    want = Counter((d, *x) for (d, _), x in zip(given, _plain_alignment([t for _, t in given], tokenizer_files), strict=True))
    got = alignment.align(all_.withColumn("n_a", F.lit("x")).withColumn("pair", F.lit("y")), *tokenizer_files, band=band)
    assert got.columns == ["doc_id", "pair", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]
    assert Counter(tuple(r) for r in got.drop("pair").collect()) == want
    hashed = got.select(F.col("groups"), alignment.groups_hash().alias("h")).distinct().collect()
    assert all(r.h == (sha256(r.groups.encode()).hexdigest() if r.groups else "") for r in hashed)


def test_units_change_nothing(tokenizer_files):
    """A text cut into units has the tokens of the whole text."""
    pick = random.Random(5)
    aligner = alignment.Aligner(*tokenizer_files)
    assert aligner.cut
    parts = ["word", "Été", "3", "12.5", "it's", "(see", "note)", "a-b", "end.", "\n", "  ", "日本", "x÷y", "×", "'s", "ß", "—", "▁"]
    for _ in range(400):
        text = "".join(pick.choice(parts) + pick.choice([" ", " ", " ", "", "  "]) for _ in range(pick.randint(1, 30)))
        units = aligner.numbers([text])[0]
        aligner.learn([text])
        whole = aligner.known[text]
        if aligner.counts[whole, 2] < 0:
            assert not len(units)
            continue
        assert aligner.counts[units].sum(axis=0).tolist() == aligner.counts[whole].tolist()
        assert ";".join(aligner.groups[u] for u in units) == aligner.groups[whole]
        assert aligner.links_of(units)[0].tolist() == aligner.links_of(np.array([whole]))[0].tolist()


def test_worker_forgets_units(tokenizer_files, monkeypatch):
    monkeypatch.setattr(alignment, "REMEMBERED", 3)
    aligner = alignment.Aligner(*tokenizer_files)
    for _ in range(3):
        units, sizes = aligner.numbers(["some words here", None, "more of them"])
        assert sizes.tolist() == [3, 0, 3] and units.tolist() == list(range(6))


def test_alignment_of_nothing(spark, nothing, tokenizer_files):
    got = alignment.align(nothing, *tokenizer_files)
    assert got.count() == 0 and "groups" in got.columns
    only = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert {tuple(r) for r in alignment.align(only, *tokenizer_files).collect()} == {(d, 0, 0, 0, 0, 0, 0, "") for d in (1, 2)}


@pytest.mark.parametrize("n", [0, 1, 2, 63, 5000])
def test_perfect_hash(n):
    keys = np.random.default_rng(n).integers(0, 1 << 63, n, dtype=np.uint64)
    keys = np.unique(keys)
    hashed = PerfectHash.of(keys)
    assert sorted(hashed.index(keys).tolist()) == list(range(len(keys)))
    again = PerfectHash.unpacked(hashed.packed())
    assert np.array_equal(again.index(keys), hashed.index(keys))
    others = np.setdiff1d(np.arange(1000, dtype=np.uint64), keys)
    found = again.index(others)
    kept = np.zeros(len(keys), np.uint64)
    kept[hashed.index(keys)] = keys
    assert all(i < 0 or kept[i] != k for i, k in zip(found.tolist(), others.tolist(), strict=True))


def test_queries_have_the_columns(spark):
    for name, columns in {
        "op11_spelling_variants": ["word", "form", "root", "n", "n_near", "form_n"],
        "op12_simhash_groups": ["doc_id", "fingerprint", "component_id"],
        "op13_token_alignment": ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"],
    }.items():
        got = queries.QUERIES[name](spark, "/root/testdata/sf0.001")
        assert got.columns == columns
        if name.startswith("op12"):
            rows = got.join(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text"), "doc_id").collect()
            assert all(r.fingerprint == f"{_plain_fingerprint(r.text):016x}" for r in rows)
        assert dict(got.dtypes)[columns[-1]] in ("bigint", "string")


def test_words_are_those_of_the_other_operators():
    assert plain.words("A\x1cb\x85 c\x0bd") == ["A\x1cb\x85", "c", "d"]
    assert _plain_fingerprint("A\x1cb\x85 c\x0bd") == covering.fingerprint_of("A\x1cb\x85 c\x0bd")
