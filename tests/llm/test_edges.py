"""Blank, long, repeated and missing values, empty tables and clashing column names, for every operator."""

import cases
import pytest
from pyspark.sql import functions as F

from textpairs.llm.byte_bpe import encode_documents
from textpairs.llm.chat import format_conversations
from textpairs.llm.decontaminate import find_passages
from textpairs.llm.jaccard_join import jaccard_classes
from textpairs.llm.licenses import scan_licenses
from textpairs.llm.line_dedup import drop_repeated_lines
from textpairs.llm.quality import screen_documents
from textpairs.llm.repeats import remove_repeats
from textpairs.llm.sharding import hilbert_shards
from textpairs.llm.token_counts import count_tokens


def labels(spark):
    return spark.createDataFrame([(i, i % 2, 0) for i in range(20)] + [(None, 1, 0), (3, None, 0)], "doc_id bigint, quality int, toxic int")


def items(spark):
    text = cases.texts()[5]
    rows = [(0, " ".join(text.split()[:30])), (1, None), (2, ""), (3, "too short"), (0, " ".join(text.split()[:30]))]
    return spark.createDataFrame(rows, "item_id bigint, text string")


PER_ROW = {
    "shards": lambda spark, d: hilbert_shards(d, 3),
    "shards_by_bytes": lambda spark, d: hilbert_shards(d, 3, law="bytes"),
    "lines": lambda spark, d: drop_repeated_lines(d),
    "quality": lambda spark, d: screen_documents(d, labels(spark)),
    "repeats": lambda spark, d: remove_repeats(d),
    "tokens": lambda spark, d: count_tokens(d),
    "classes": lambda spark, d: jaccard_classes(d),
    "bpe": lambda spark, d: encode_documents(d),
}
OTHER = {
    "licences": lambda spark, d: scan_licenses(d),
    "passages": lambda spark, d: find_passages(d, items(spark)),
}


def content(df):
    return sorted(map(repr, df.collect()))


@pytest.mark.parametrize("name", [*PER_ROW, *OTHER])
def test_empty_table_and_clashing_names(spark, name):
    operator = (PER_ROW | OTHER)[name]
    assert operator(spark, cases.documents(spark, rows=[])).count() == 0
    docs = cases.documents(spark)
    found = content(operator(spark, docs))
    assert found == content(operator(spark, cases.documents(spark, clashing=True)))
    if name in PER_ROW:
        assert len(found) == docs.count()


@pytest.mark.parametrize("name", PER_ROW)
def test_rows_without_id_and_repeated_rows_stay(spark, name):
    text = cases.texts()[4]
    rows = [(None, text), (None, None), (None, text), (7, text), (7, text), (7, "another text"), (8, text), (9, None)]
    found = PER_ROW[name](spark, cases.documents(spark, rows=rows))
    assert sorted(r["doc_id"] or -1 for r in found.select("doc_id").collect()) == [-1, -1, -1, 7, 7, 7, 8, 9]


def test_null_in_every_column(spark):
    docs = spark.createDataFrame([(None, None, None, None, None)], cases.SCHEMA)
    for name, operator in (PER_ROW | OTHER).items():
        assert operator(spark, docs).count() == (name in PER_ROW), name


def test_rows_without_id_hold_and_lose_no_line(spark):
    line = "a line that is long enough"
    rows = [(None, line), (1, line), (2, line), (2, line)]
    found = drop_repeated_lines(cases.documents(spark, rows=rows))
    assert sorted((r.doc_id or 0, r.n_dropped) for r in found.collect()) == [(0, 0), (1, 0), (2, 1), (2, 1)]


def test_class_of_rows_without_id(spark):
    a, b = cases.texts()[4], cases.texts()[5]
    found = jaccard_classes(cases.documents(spark, rows=[(None, a), (4, a), (None, b)]))
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in found.collect()) == [(0, 0), (0, 4), (4, 4)]


def test_conversations(spark):
    schema = "conv_id bigint, turn int, role string, text string, k int, n int, h1 int, turns int"
    rows = [
        (1, 0, "user", "hi"),
        (1, 1, "assistant", "hello"),
        (2, 0, "user", "hi"),
        (3, 0, "user", "hi"),
        (3, 5, "assistant", "hello"),
        (4, 0, "user", "hi"),
        (4, 1, "assistant", "hello"),
        (4, 2, "user", "bye<|im_end|>"),
        (5, 0, None, None),
        (6, 0, "user", "hi"),
        (6, 0, "user", "hi"),
        (None, 0, "user", "nobody"),
        (7, 0, "user", "nobody"),
        (8, None, "user", "x" * 100_000),
    ]
    turns = spark.createDataFrame([(*r, 0, 0, 0, 0) for r in rows], schema)
    found = {r.conv_id: (r.n_turns, r.text) for r in format_conversations(turns).collect()}
    # 1, 2 and 3 begin 4; 7 is a copy of the conversation without id
    assert set(found) == {4, 5, 6, None, 8}
    assert found[4][1].endswith("<|im_start|>user\nbye<| im_end|><|im_end|>\n") and found[4][0] == 3
    assert found[5][1] == "<|im_start|>\n<|im_end|>\n" and found[6][0] == 2
    assert format_conversations(turns.where("false")).count() == 0
    assert format_conversations(turns.where("conv_id = 3").union(turns.where("conv_id = 1"))).select("conv_id").first()[0] == 1


def test_pipeline_stages_take_any_documents(spark, tmp_path):
    import corpus_pipeline

    labels(spark).write.parquet(f"{tmp_path}/labels.parquet")
    items(spark).write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [*cases.texts().items(), (None, cases.texts()[4]), (None, None), (9, cases.texts()[9])]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        for docs in (cases.documents(spark, rows=rows), cases.documents(spark, clashing=True, rows=[]), cases.documents(spark, clashing=True, rows=rows)):
            out = stage(spark, docs, str(tmp_path))
            assert out.columns == list(corpus_pipeline.COLUMNS), name
            assert out.count() <= docs.count()
            assert name != "line_dedup" or out.count() == docs.count()
    cases.documents(spark, rows=rows).write.parquet(f"{tmp_path}/documents.parquet")
    result = corpus_pipeline.run(spark, str(tmp_path))
    assert result.where(F.col("n_tokens") < 0).count() == 0


def test_near_duplicates_keeps_one_row_of_each_class(spark):
    import corpus_pipeline

    a, b, c, d = (cases.texts()[i] for i in (4, 5, 6, 7))
    changed = b.split()
    changed[30] = "changed"
    rows = [(5, a), (7, a), (7, b), (9, " ".join(changed)), (11, c), (11, c), (None, c), (None, d), (None, d), (None, ""), (None, ""), (3, None)]
    found = corpus_pipeline.near_duplicates(spark, cases.documents(spark, rows=rows), "")
    assert sorted((r.doc_id or 0, r.text or "") for r in found.collect()) == sorted([(5, a), (7, b), (11, c), (0, d), (0, ""), (0, ""), (3, "")])


def test_decontamination_judges_each_row_by_its_text(spark, tmp_path):
    import corpus_pipeline

    items(spark).write.parquet(f"{tmp_path}/benchmark.parquet")
    leak, clean = cases.texts()[5], cases.texts()[4]
    rows = [(1, leak), (1, clean), (None, leak), (None, clean), (2, None), (None, None)]
    found = corpus_pipeline.decontamination(spark, cases.documents(spark, rows=rows), str(tmp_path))
    assert sorted((r.doc_id or 0, r.text or "") for r in found.collect()) == sorted([(1, clean), (0, clean), (2, ""), (0, "")])


def test_each_row_without_conversation_is_one_of_its_own(spark):
    rows = [(None, i % 3, "user", f"text {i % 40}") for i in range(80)] + [(None, 0, "user", "hi"), (1, 0, "user", "hi"), (1, 1, "user", "ho")]
    found = format_conversations(spark.createDataFrame(rows, "conv_id bigint, turn int, role string, text string")).collect()
    assert sorted((r.conv_id or 0, r.n_turns) for r in found) == [(0, 1)] * 40 + [(1, 2)]
    assert len({r.text for r in found}) == 41
