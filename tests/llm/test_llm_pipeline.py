"""The pipeline's stages against plain Python, each on what the one before kept."""

from collections import Counter

import llm_plain as plain
import public_tokenizers
import tiktoken

import corpus_pipeline
from gaugemill.llm import bpe, rules
from gaugemill.llm.textstats import MEASURES, measures_of


def _good(text):
    m = dict(zip(MEASURES, measures_of((text or "").encode()), strict=True))
    return not any(eval(c.replace(" = ", " == "), {}, m) for c in rules.RULES.values())  # noqa: S307 our own constants


def _stages(docs, items):
    docs = [x for x in docs if _good(x[1])]
    yield docs
    docs = [(d, t) for (d, _), (_, _, t) in zip(docs, plain.lines(docs), strict=True)]
    yield docs
    seen, kept = set(), []
    for (d, t), (n, group) in sorted(zip(docs, plain.groups(docs), strict=True), key=lambda x: plain.order(x[0][0])):
        if not n or plain.order(d) == group and group not in seen:
            kept.append((d, t))
            seen.add(group)
    yield kept
    leaked = {d for d, _ in plain.leaks(kept, items)}
    yield [x for x in kept if x[0] not in leaked]


def test_stages(spark, docs, table, tmp_path):
    # which row of one id stays is a matter of hashes, and the groups above are told apart by ids
    docs = [x for x in docs if x[0] != 9 and not (x[1] or "").startswith("other text")]
    frame = table.where("(doc_id <> 9 or doc_id is null) and not coalesce(text, '') like 'other text%'")
    items = [(0, " ".join(plain.words(dict(docs)[10])[2:30])), (1, "nothing of this is anywhere in the documents")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for k, ((name, step), want) in enumerate(zip(corpus_pipeline.STAGES, _stages(docs, items), strict=False)):
        step(spark, now, str(tmp_path)).write.parquet(f"{tmp_path}/{k}.parquet")
        now = spark.read.parquet(f"{tmp_path}/{k}.parquet")
        assert now.columns == table.columns, name
        assert Counter((r.doc_id, r.text) for r in now.collect()) == Counter(want), name
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    known = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = Counter((r.doc_id, tuple(bpe.id_list(r.ids)), r.n_tokens, r.decoded_sha256) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert got == Counter((d, tuple(i := known.encode_ordinary(t or "")), len(i), plain.sha(t or "")) for d, t in want)


def test_stages_take_empty_tables(spark, nothing, tmp_path):
    spark.createDataFrame([(1, "some text")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, step in corpus_pipeline.STAGES:
        assert step(spark, nothing, str(tmp_path)).count() == 0, name
