"""Every operator against plain Python, on a table of hard cases, on an empty one, and with clashing columns."""

import random
import re
import time
from collections import Counter

import llm_plain as plain
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from gaugemill.llm import (
    bpe, decontaminate, groups, htmltext, jaccard, linededup, ruleensemble, rules, substrings, suffixes, windows, wordpiece,
)


def rows_of(frame, *columns):
    return Counter(tuple(r) for r in frame.select(*columns).collect())


def keyed(docs, found):
    return Counter((d, *f) for (d, _), f in zip(docs, found, strict=True))


def test_token_counts(table, docs, nothing):
    from tokenizers import Tokenizer, models

    pieces = wordpiece.read_pieces(public_tokenizers.path("piece_bpe_32k.model"))
    vocabulary = {}
    for p in pieces:
        body = p.removeprefix("▁")
        if body and "▁" not in body:
            vocabulary.setdefault(body if p.startswith("▁") else "##" + body, len(vocabulary))
    vocabulary["[UNK]"] = len(vocabulary)
    model = Tokenizer(models.WordPiece(vocabulary, unk_token="[UNK]", max_input_chars_per_word=10**6))

    def counts(text):
        found = [model.encode(w).tokens for w in plain.words(text)]
        return len(found), sum(map(len, found)), sum(f == ["[UNK]"] for f in found)

    got = wordpiece.count_tokens(table, pieces, ["doc_id"])
    assert rows_of(got, "doc_id", "n_words", "n_tokens", "n_unknown") == keyed(docs, [counts(t) for _, t in docs])
    assert wordpiece.count_tokens(nothing, pieces, ["doc_id"]).count() == 0


def test_automaton_takes_the_longest_piece():
    a = wordpiece.Automaton(["▁ab", "▁abcd", "c", "ce", "▁x", "d"])
    assert [a.count(w) for w in ("ab", "abcd", "abce", "abcdd", "abq", "x")] == [1, 1, 2, 2, 0, 1]


def test_whole_vocabulary_is_matched(spark, tmp_path):
    from gaugemill.llm import queries

    pieces = set(wordpiece.read_pieces(public_tokenizers.path("piece_bpe_32k.model")))
    longest = max(map(len, pieces))

    def split(word):
        left, n = "▁" + word, 0
        while left:
            size = next((k for k in range(min(longest, len(left)), 0, -1) if left[:k] in pieces), 0)
            if not size:
                return 0
            left, n = left[size:], n + 1
        return n

    texts = ["2024", "ñandú", "ça", "ß 日本語 a▁b ▁ ▁the x▁▁▁▁y 7", "the year 1999 was", "\U00012345 a\U00012345", "", None]
    docs = list(enumerate(texts))
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = [[split(w) for w in plain.words(t)] for t in texts]
    assert [sum(f) for f in found[:3]] == [5, 4, 2] and found[5] == [0, 0]
    got = queries.op1_token_counts(spark, str(tmp_path))
    assert rows_of(got, "doc_id", "n_words", "n_tokens", "n_unknown") == keyed(
        docs, [(len(f), sum(f) + f.count(0), f.count(0)) for f in found])


def test_whole_automaton_is_the_longest_match():
    import random

    pick = random.Random(3)
    for _ in range(300):
        pieces = {"".join(pick.choice("▁abc") for _ in range(pick.randint(1, 4))) for _ in range(pick.randint(1, 9))}
        a = wordpiece.Automaton(pieces, whole=True)
        for _ in range(40):
            word = "".join(pick.choice("abc▁") for _ in range(pick.randint(1, 9)))
            left, n = "▁" + word, 0
            while left and (size := max((len(p) for p in pieces if left.startswith(p)), default=0)):
                left, n = left[size:], n + 1
            assert a.count(word) == (0 if left else n), (pieces, word)


def test_rules(table, docs, nothing):
    got = rules.ledger(table.drop("n_words", "N_LINES"), ["doc_id"])
    assert rows_of(got, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words") == keyed(
        docs, [plain.rules(t) for _, t in docs])
    assert rules.ledger(nothing.drop("n_words", "N_LINES"), ["doc_id"]).count() == 0


def test_policies_and_ablations_read_bits(table):
    entries = rules.ledger(table, ["doc_id"]).cache()
    bits = [r[0] for r in entries.select("failed_bits").collect()]
    for policy in rules.POLICIES.values():
        assert entries.where(rules.passes(policy)).count() == sum(b & policy.mask == 0 for b in bits)
        for r in rules.ablations(entries, policy).collect():
            bit = 1 << list(rules.RULES).index(r.rule)
            assert (r.failing, r.failing_alone) == (sum(b & bit > 0 for b in bits), sum(b & policy.mask == bit for b in bits))


def test_passing_keeps_columns_as_they_are(table, nothing):
    kept = rules.passing(table, rules.BASE)
    assert kept.columns == table.columns and 0 < kept.count() < table.count()
    assert kept.subtract(table).count() == 0
    assert rules.passing(nothing, rules.STRICT).count() == 0


def test_lines(table, docs, nothing):
    got = linededup.drop_shared_lines(table)
    assert rows_of(got, "doc_id", "N_LINES", "n_dropped", "text") == keyed(docs, plain.lines(docs))
    assert rows_of(linededup.drop_shared_lines(table, min_docs=3).select(F.sum("n_dropped").alias("n")), "n")
    assert linededup.drop_shared_lines(nothing).count() == 0


@pytest.mark.parametrize("window", [50, 7])
def test_passages(table, docs, nothing, window):
    got = substrings.cut_passages(table, window=window)
    assert rows_of(got, "doc_id", "n_words", "n_removed", "text") == keyed(docs, plain.passages(docs, window))
    assert substrings.cut_passages(nothing).count() == 0


@pytest.mark.parametrize("pieces", [4000, 2])
def test_strings(table, docs, nothing, monkeypatch, pieces):
    monkeypatch.setattr(suffixes, "SHARD_PIECES", pieces)
    got = suffixes.cut_repeats(table).withColumn("n_spans", F.size("spans")).withColumn("text", F.sha2("text", 256))
    want = [(n, lost, spans, plain.sha(t)) for n, lost, spans, t in plain.strings(docs, 200)]
    assert rows_of(got, "doc_id", "n_bytes", "n_removed", "n_spans", "text") == keyed(docs, want)
    assert suffixes.cut_repeats(nothing).count() == 0


def test_chunks_of_a_long_text_hold_all_windows(monkeypatch):
    import numpy as np

    values = windows.mixed(np.random.default_rng(2).integers(0, 9, 5000).astype(np.uint64))
    for chunk in (1 << 20, 700):
        monkeypatch.setattr(windows, "CHUNK", chunk)
        found = windows.runs(values, np.array([0, 30, 30, 4000, 5000]), 50, 10)
        at = Counter((t, f + k) for t, f, n in zip(found["text"], found["first"], found["n"], strict=True) for k in range(n))
        assert at == Counter((t, i) for t, size in ((2, 3970), (3, 1000)) for i in range(size - 49))


def test_groups(table, docs, nothing):
    got = jaccard.near_duplicates(table)
    assert rows_of(got, "doc_id", "n_shingles", "component_id") == keyed(docs, plain.groups(docs))
    assert jaccard.near_duplicates(nothing).count() == 0


def test_one_row_of_each_group_stays(table, docs):
    kept = jaccard.first_of_groups(table)
    assert kept.columns == table.columns
    want = {c for n, c in plain.groups(docs) if n}
    got = [r.doc_id for r in kept.where(F.length(F.btrim("text", F.lit(" \t\n\x0b"))) > 0).collect()]
    assert {plain.order(d) for d in got} == want and len(got) == len(want) + 1  # the two texts of id 13 are no copies


def test_small_sets_join_by_subsets(spark):
    import random

    pick, docs = random.Random(4), []
    for k in range(160):
        base = [f"w{random.Random(k % 17).random()}"] + [f"{k % 17}-{i}" for i in range(4 + k % 11)]
        if k % 3:
            base[pick.randrange(len(base))] = "other"
        docs.append((k, " ".join(base)))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = jaccard.near_duplicates(frame)
    assert rows_of(got, "doc_id", "n_shingles", "component_id") == keyed(docs, plain.groups(docs))


@pytest.mark.parametrize("own", [[75], [20, 40, 48, 50, 52, 60, 75, 90]])
def test_shared_boilerplate_ends(spark, own):
    block = " ".join(f"b{i}" for i in range(304))  # 300 shingles: of 375 they link none, of 350 or fewer in both they do
    docs = [(k, " ".join([f"{k}-{i}" for i in range(own[k % len(own)])] + [block])) for k in range(240)]
    got = jaccard.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"))
    assert rows_of(got, "doc_id", "n_shingles", "component_id") == keyed(docs, plain.groups(docs))


def test_groups_by_place(spark, table, docs, monkeypatch):
    import random

    monkeypatch.setattr(jaccard, "_to_hubs", lambda open_, *_: open_.limit(0).select("node", "node").toDF("a", "b"))
    got = jaccard.near_duplicates(table)
    assert rows_of(got, "doc_id", "n_shingles", "component_id") == keyed(docs, plain.groups(docs))
    pick, more = random.Random(8), []
    for k in range(150):
        words = [f"{k % 10}-{i}" for i in range(60 + k % 10)]
        for _ in range(pick.randint(0, 3)):
            words[pick.randrange(len(words))] = f"new{pick.random()}"
        more.append((k, " ".join(words[pick.randint(0, 8):])))
    got = jaccard.near_duplicates(spark.createDataFrame(more, "doc_id long, text string"))
    assert rows_of(got, "doc_id", "n_shingles", "component_id") == keyed(more, plain.groups(more))


def test_near_copies_fall_together_before_prefixes_are_compared(spark, monkeypatch):
    import random

    pick, docs, written = random.Random(5), [], {}
    for k in range(120):  # a group in which most pairs meet
        words = [f"c{i}" for i in range(200)]
        for _ in range(3):
            words[pick.randrange(200)] = f"new{pick.random()}"
        docs.append((k, " ".join(words)))
    keep = jaccard.stage

    def stage(df, name):
        table = keep(df, name)
        written.setdefault(name, []).append(table.count())
        return table

    monkeypatch.setattr(jaccard, "stage", stage)
    monkeypatch.setattr(jaccard, "_to_hubs", lambda open_, *_: open_.limit(0).select("node", "node").toDF("a", "b"))
    got = jaccard.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"))
    assert rows_of(got, "doc_id", "n_shingles", "component_id") == keyed(docs, plain.groups(docs))
    assert sum(written.get("jaccard-able", [])) <= 2 * len(docs)


def test_texts_made_from_one_are_not_paired_with_each_other(spark, monkeypatch):
    import random

    pick, docs, written = random.Random(9), [], {}
    for k in range(160):  # linked with text 70, few with each other
        words = [f"c{i}" for i in range(130)]
        for i in (pick.randrange(4, 62), pick.randrange(66, 126)) if k != 70 else ():
            words[i] = f"new{pick.random()}"
        docs.append((k, " ".join(words)))
    keep = jaccard.stage

    def stage(df, name):
        table = keep(df, name)
        written[name] = written.get(name, 0) + table.count()
        return table

    monkeypatch.setattr(jaccard, "stage", stage)
    got = jaccard.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"))
    assert rows_of(got, "doc_id", "n_shingles", "component_id") == keyed(docs, plain.groups(docs))
    assert written["jaccard-part"] <= len(docs), written


def test_entries_are_made_in_shares(spark, table, docs, monkeypatch):
    written = []
    monkeypatch.setattr(jaccard, "ONE_BLOCK", 10)
    monkeypatch.setattr(jaccard, "stage", lambda df, name, keep=jaccard.stage: written.append(name) or keep(df, name))
    got = jaccard.near_duplicates(table)
    assert rows_of(got, "doc_id", "n_shingles", "component_id") == keyed(docs, plain.groups(docs))
    assert written.count("jaccard-entries") == jaccard.BLOCKS


@pytest.mark.parametrize("percent", [75, 20])
def test_long_sketches_keep_links_and_drop_texts_less_alike(spark, percent):
    import numpy as np

    docs, pairs, similar = [], [], {}
    for k, (size, share, more) in enumerate(
            (size, share, more) for size in (70, 130, 1100, 4100) for share in (0.05, 0.3, 0.6, 0.9) for more in (1, 1.3, 3.5)):
        first = [f"{k}-{i}" for i in range(size)]
        second = first[:int(share * size)] + [f"{k}-{i}-other" for i in range(int(more * size) - int(share * size))]
        docs += [(2 * k, " ".join(first)), (2 * k + 1, " ".join(second))]
    rows = jaccard.with_row_keys(spark.createDataFrame(docs, "doc_id long, text string"), "doc_id", "text")
    base = jaccard._prefixes(rows, "text", 5, percent, np.zeros(0, np.int64), 0)
    node = {r["__gm_id"]: r.node for r in base.collect()}
    for k in range(len(docs) // 2):
        a, b = (plain.shingles(docs[2 * k + x][1]) for x in (0, 1))
        if 100 * min(len(a), len(b)) >= percent * max(len(a), len(b)):
            pairs.append((node[2 * k], node[2 * k + 1]))
            similar[pairs[-1]] = 100 * len(a & b) / len(a | b)
    able = {(r.a, r.b) for r in jaccard._able(spark.createDataFrame(pairs, "a long, b long"), base, percent).collect()}
    assert able >= {p for p, v in similar.items() if v >= percent} and able
    assert not able & {p for p, v in similar.items() if v < percent - 25}


def test_few_tables_are_written_for_near_duplicates(spark, monkeypatch):
    import random

    pick, docs, written = random.Random(6), [], []
    for k in range(90):  # pairs that link by one word changed, and texts of a source whose passage does not link them
        words = [f"{k // 2}-{i}" for i in range(80)] if k < 60 else [f"s{i}" for i in range(50)] + [f"{k}-{i}" for i in range(40)]
        words[pick.randrange(50, len(words))] = f"new{k}"
        docs.append((k, " ".join(words)))
    for module in (jaccard, groups):
        monkeypatch.setattr(module, "stage", lambda df, name, keep=module.stage: written.append(name) or keep(df, name))
    got = jaccard.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"))
    assert rows_of(got, "doc_id", "n_shingles", "component_id") == keyed(docs, plain.groups(docs))
    assert len(written) <= 16, written  # each is a job or several, which on 0.1 GB take longer to start than to run


def test_copies_and_near_copies_dealt_over_tasks(spark):
    import random

    pick, docs = random.Random(7), []
    for k in range(60):
        words = [f"{k % 3}-{i}" for i in range(70)]
        if k % 4:
            words[pick.randrange(70)] = f"new{k % 20}"
        docs += [(k, " ".join(words)), (200 + k, " ".join(words)), (None if k == 5 else 400 + k, " ".join(words))]
    got = jaccard.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string").repartition(7))
    assert rows_of(got, "doc_id", "n_shingles", "component_id") == keyed(docs, plain.groups(docs))


def test_texts_are_dealt_out_once_for_first_of_groups(table):
    plan = jaccard.first_of_groups(table)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("InMemoryRelation") == 1


def test_leaks(spark, table, docs, nothing):
    pick = dict((d, t) for d, t in docs if t)
    cut = lambda d, a, b: " ".join(plain.words(pick[d])[a:b])
    changed = plain.words(pick[14])[900:950]
    changed[20] = "new"
    items = [(0, cut(12, 5, 40).upper()), (1, " ".join(changed)), (2, "two words"), (3, None), (4, ""), (5, "never said by anyone at all here"), (5, cut(10, 0, 20))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.similarity, r.start) for r in decontaminate.find_leaks(table, bench).collect()}
    want = plain.leaks([x for x in docs if x[0] != 17], items)
    assert got == pytest.approx(want) if not want else {k: (round(s, 9), a) for k, (s, a) in got.items()} == {k: (round(s, 9), a) for k, (s, a) in want.items()}
    kept = decontaminate.without_leaks(table, bench)
    assert kept.columns == table.columns
    assert {r.doc_id for r in kept.collect()} == {d for d, _ in docs} - {d for d, _ in want}
    assert decontaminate.find_leaks(nothing, bench).count() == 0
    assert decontaminate.without_leaks(table, bench.limit(0)).count() == table.count()


def test_texts_shorter_than_the_item_leak(spark):
    import random

    pick = random.Random(6)
    items = [(k, " ".join(f"w{pick.randrange(10**6)}" for _ in range(39))) for k in range(6)] + [(6, "a b c d e f g h"), (7, "a b c d")]
    say = dict((k, t.split()) for k, t in items)
    texts = {  # 35 shingles: similarity 34/35, 30/35, 27/35, 26/35
        0: say[0][:38], 1: say[1][5:], 2: say[2][:31], 3: say[3][4:34], 4: ["x", *say[4][:36]], 5: say[5], 6: say[6][:7], 7: say[7][:3],
    }
    docs = spark.createDataFrame([(d, " ".join(w).upper()) for d, w in texts.items()], "doc_id long, text string")
    grams = lambda w: Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)])
    want = {}
    for d, w in texts.items():
        for item, q in say.items():
            m = min(len(w), len(q))
            found = []
            for start in range(len(w) - m + 1):
                a, b = grams(w[start:start + m]), grams(q)
                if 100 * (a & b).total() >= 75 * (a | b).total():
                    found.append((-(a & b).total() / (a | b).total(), start, m))
            if found:
                want[d, item] = min(found)
    assert {d for d, _ in want} == {0, 1, 2, 4, 5, 6} and want[0, 0] == (-34 / 35, 0, 38)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): (-r.similarity, r.start, r.n_words) for r in decontaminate.find_leaks(docs, bench).collect()}
    assert got == want
    assert {r.doc_id for r in decontaminate.without_leaks(docs, bench).collect()} == {3, 7}


def test_bpe(table, docs, nothing):
    import tiktoken

    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    known = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    encoded = bpe.encode(table, ranks, public_tokenizers.PATTERN)
    got = Counter((r.doc_id, tuple(bpe.id_list(r.ids))) for r in encoded.collect())
    assert got == Counter((d, tuple(known.encode_ordinary(t or ""))) for d, t in docs)
    back = bpe.decode(encoded.select("doc_id", "ids"), ranks)
    assert Counter((r.doc_id, bytes(r.decoded)) for r in back.collect()) == Counter((d, (t or "").encode()) for d, t in docs)
    assert bpe.encode(nothing, ranks, public_tokenizers.PATTERN).count() == 0


@pytest.mark.parametrize("text", ["a" * 3000, "-=" * 2000, "aab" * 900, "thetion" * 400, "é" * 700, "x" * 17, "0" * 129])
def test_joined_halves_are_the_encoding(text):
    import tiktoken

    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    known = tiktoken.Encoding("own", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
    assert bpe.id_list(bpe.Monoid(ranks).packed(text)) == known.encode_ordinary(text)


def test_classifier(spark, table, nothing):
    good = [(k, " ".join(f"w{(k * i) % 97}" for i in range(40)) + ".") for k in range(1, 200)]
    bad = [(k, "BUY!! NOW### $$$ " * (3 + k % 9)) for k in range(200, 300)]
    docs = spark.createDataFrame(good + bad, "doc_id long, text string")
    labels = spark.createDataFrame([(d, int(d < 200)) for d, _ in good + bad] + [(None, 1), (1, None)], "doc_id long, quality int")
    model = ruleensemble.fit(docs.where("doc_id % 2 = 0"), labels)
    assert 0 < len(model.rules) < 100
    scored = ruleensemble.score(docs.where("doc_id % 2 = 1"), model, ["doc_id"]).collect()
    assert all((r.score >= 0.5) == (r.doc_id < 200) for r in scored)
    hard = ruleensemble.score(table, model, ["doc_id"]).collect()
    assert len(hard) == table.count() and all(0 <= r.score <= 1 for r in hard)
    assert ruleensemble.score(nothing, model, ["doc_id"]).count() == 0
    assert ruleensemble.fit(docs, labels.limit(0)).rules == ()


PAGE = """<html><head><title>T</title><script>var a = "<p>no</p>";</script></head><body class="has-sidebar"><header><h2>Site</h2></header>
<nav><ul><li><a href="/">Home</a></li></ul></nav><div class="cookie-notice">We use cookies</div><form>Mail <input></form>
<article><h1>A &amp; B</h1><p>First <b>bo</b>ld&nbsp;text<br>line   two<p>Open <i>tags<p>End</p><!-- no --><div class="ad">Buy</div><ul><li>one<li>two</ul>
<aside>Side</aside><section id="comments"><p>Nice</p></section></article><footer>&copy; x</footer>"""
TEXT = "A & B\nFirst bold text\nline two\nOpen tags\nEnd\none\ntwo"


def test_pages(spark, nothing):
    plain_page = "<body><div id=menu><a href=1>Home</a></div><div><h1>Title here</h1><p>Some text to read here.</p></div><div class=sidebar>x y</div>"
    pages = [(1, PAGE), (2, None), (3, ""), (4, "just text < here"), (5, "<p"), (6, "<div><!-- open"), (7, PAGE), (8, plain_page), (None, "<article></article>")]
    frame = spark.createDataFrame(pages, "page_id long, html string")
    got = {r.page_id: r.text for r in htmltext.extract(frame, ["page_id"]).collect()}
    assert got == {1: TEXT, 2: "", 3: "", 4: "just text < here", 5: "<p", 6: "", 7: TEXT, 8: "Title here\nSome text to read here.", None: ""}
    assert htmltext.extract(frame.limit(0), ["page_id"]).count() == 0


def test_ids_of_headings_stay_and_comments_go():
    weights = {"word:p": 1.0, "word:h2": 1.0}
    page = ('<body><article><h1>T</h1><section id="discussion"><h2 id="related-work">Related work</h2><p>We discuss.</p></section>'
            '<h2 id="search">Search</h2><p>End.</p></article>')
    want = "T\nRelated work\nWe discuss.\nSearch\nEnd."
    for after in ('<section class="comments"><article class="comment"><p>Nice read, many words here to bridge a gap of tags</p></article></section>',
                  '<section class="comments"><article><p>Nice read, many words here to bridge a gap of tags</p></article></section>',
                  '<article class="comment"><p>Nice read, many words here to bridge a gap of tags</p></article>', ""):
        assert htmltext.main_text(page + after, weights) == want
    assert htmltext.main_text('<div class="nav">x<article><p>never ended</p></article>', weights) == "never ended"


def test_best_stretch_is_kadanes():
    import random

    pick = random.Random(1)
    for _ in range(200):
        scores = [pick.choice([-3, -1, 1, 2, 0]) for _ in range(pick.randint(0, 12))]
        start, end = htmltext.best_stretch(scores)
        assert sum(scores[start:end]) == max([0, *(sum(scores[a:b]) for a in range(len(scores)) for b in range(a + 1, len(scores) + 1))])


def _nested(rng, pieces):
    """Broken markup of many shapes: tags that never end, ends without a beginning, articles in menus and comments."""
    names = ["b", "i", "p", "div", "li", "ul", "article", "nav", "main", "section", "br", "td", "h2", "body"]
    kinds = ["<{0}>", "</{0}>", "<{0} class='comment'>", "word {0} ", " ", "<{0} id=x>", "&amp;"]
    return "".join(rng.choice(kinds).format(rng.choice(names)) for _ in range(pieces))


def _plain_places(source):
    """The element around every text of a page without special elements, by searching all that are open."""
    open_, around = [], []
    for end, name, text in re.findall(r"<(/?)(\w+)>|([^<]+)", source):
        if text:
            around += [next((n for n in reversed(open_) if n in ("div", "section")), "body")] if not text.isspace() else []
        elif not end:
            open_.append(name)
        elif name in open_:
            del open_[len(open_) - 1 - open_[::-1].index(name):]
    return around


def test_html_places_equal_a_search_of_all_open_elements():
    rng = random.Random(5)
    for _ in range(300):
        source = "".join(rng.choice(["<{0}>", "</{0}>", "x "]).format(rng.choice(["b", "i", "em", "div", "section"])) for _ in range(40))
        merged = [f.removeprefix("word:") for f in htmltext.parse(source).features if f.startswith("word:")]
        assert merged == _plain_places(source)


def test_html_best_text_equals_trying_every_stretch():
    """Pages without an article mark: the text is that of the best of all stretches, the first of equals."""
    weights = {"word:p": 0.5, "word:div": 0.25, "tag:p": -0.5, "tag:div": -1.0, "tag:a": -2.0, "word:body": 0.25}
    rng = random.Random(6)
    for _ in range(200):
        source = "".join(rng.choice(["<p>", "</p>", "<div>", "</div>", "<a>", "</a>", "one ", "two three "]) for _ in range(25))
        page = htmltext.parse(source)
        scores = [c * weights.get(f, htmltext.UNSEEN_WORD if f.startswith("word:") else htmltext.UNSEEN_TAG) for f, c in zip(page.features, page.counts)]
        stretches = [(sum(scores[i:j]), i, j) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)]
        best = max((t for t, _, _ in stretches), default=0)
        texts = {""} if best <= 0 else set()
        for total, i, j in stretches:
            if total == best > 0:
                blocks = range(page.blocks[i], page.blocks[j - 1] + 1)
                lines = ["".join(t for t, b in zip(page.texts, page.blocks) if b == block) for block in blocks]
                texts.add("\n".join(" ".join(line.split()) for line in lines if line.split()))
        assert htmltext.main_text(source, weights) in texts


def test_html_of_a_long_page_of_open_tags_is_read_at_once():
    rng = random.Random(7)
    started = time.process_time()
    for page in ("<b>" * 150_000 + "</i>" * 150_000, "<b>x" * 150_000, "<nav>" * 100_000 + "<article>" * 50_000, _nested(rng, 100_000)):
        htmltext.main_text(page, {})
    assert time.process_time() - started < 30  # by search, minutes


def test_html_weights_come_from_different_pages(spark):
    """Copies of one page count once, and pages beyond the smallest hashes not at all."""
    pages = [f"<nav>{'m ' * n}</nav><article><p>{'w ' * n}</p></article>" for n in range(1, 30)]
    one = htmltext.learn_weights(spark.createDataFrame([(p,) for p in pages], "html string"))
    many = htmltext.learn_weights(spark.createDataFrame([(p,) for p in pages + pages[:1] * 200] + [(None,)], "html string"))
    assert one == many and one["word:p"] > 0
    assert htmltext.learn_weights(spark.createDataFrame([(pages[3],)] * 50, "html string"), labelled_pages=1)
    assert htmltext.learn_weights(spark.createDataFrame([("<p>x</p>",)], "html string")) == {}
