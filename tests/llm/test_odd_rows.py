"""Every operator and every pipeline stage on odd rows and on empty tables."""

import pytest

from ledgerline.llm import chat, decontaminate, lines, media, packing, pages, quality, secrets, simhash, token_counts


def operators(labels, items):
    return {
        "to_avi": media.to_avi, "clips": lambda d: media.clips(media.to_avi(d)), "classify": lambda d: quality.classify(d, labels), "keep_good": lambda d: quality.keep_good(d, labels),
        "near_duplicates": simhash.near_duplicates, "pack": packing.pack_documents, "scan": secrets.scan_documents, "find": secrets.find_secrets,
        "lines": lambda d: lines.drop_recurring_lines(d, counts=True), "leaks": lambda d: decontaminate.leaks(d, items), "without_leaks": lambda d: decontaminate.without_leaks(d, items),
        "count": token_counts.count_tokens,
    }


PER_ROW = ["to_avi", "classify", "near_duplicates", "scan", "lines", "count"]


@pytest.mark.parametrize("name", list(operators(None, None)))
def test_odd_rows(name, odd_docs, no_docs, odd_labels, odd_items):
    f = operators(odd_labels, odd_items)[name]
    rows = f(odd_docs).collect()
    if name in PER_ROW:
        assert len(rows) == odd_docs.count()
    assert f(no_docs).collect() == []
    assert f(no_docs.select("doc_id", "text", "lang")).columns is not None


def test_without_labels_or_items(odd_docs, odd_labels, odd_items):
    assert all(r["keep"] for r in quality.classify(odd_docs, odd_labels.where("false")).collect())
    assert decontaminate.leaks(odd_docs, odd_items.where("false")).collect() == []


def test_extra_columns_stay(odd_docs, odd_labels, odd_items):
    for out in (quality.keep_good(odd_docs, odd_labels), lines.drop_recurring_lines(odd_docs), decontaminate.without_leaks(odd_docs, odd_items)):
        assert out.columns == odd_docs.columns
        assert {r["fp"] for r in out.collect()} == {"extra"}


def test_pipeline_stages(spark, odd_docs, no_docs, odd_labels, odd_items, tmp_path):
    import corpus_pipeline

    odd_labels.write.parquet(f"{tmp_path}/labels.parquet")
    odd_items.write.parquet(f"{tmp_path}/benchmark.parquet")
    for docs in (odd_docs, no_docs):
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, str(tmp_path))
            if k < len(corpus_pipeline.STAGES) - 1:
                assert out.columns == docs.columns
            path = f"{tmp_path}/{'some' if docs is odd_docs or docs.count() else 'none'}{k}"
            out.write.mode("overwrite").parquet(path)
            docs = spark.read.parquet(path)


def test_odd_pages(spark):
    rows = [(1, "u", None), (2, None, ""), (3, "u", "no tags & no end"), (4, "u", "<"), (5, "u", "<p"), (6, "u", "<script>never ends"), (None, "u", "<p>a<p>b"), (7, "u", "<div>" * 3000 + "deep text, here." + "</div>" * 10), (7, "u", "<!-- x")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = {(r["page_id"], r["text"]) for r in pages.extract_pages(df).collect()}
    assert {(1, ""), (2, ""), (3, "no tags & no end"), (6, ""), (None, "a\nb"), (7, "deep text, here.")} <= got
    assert pages.extract_pages(df.where("false")).collect() == []


def test_odd_turns(spark):
    rows = [(1, 0, "user", None), (1, 0, "user", None), (1, None, None, "x"), (None, 1, "assistant", "ok <|im_end|> <\\|x"), (2, 5, "a\nb\\n<|", ""), (2, 5, "assistant", "y\n")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_chat(df)).collect()}
    assert {k: r["n_turns"] for k, r in got.items()} == {1: 3, None: 1, 2: 2}
    assert got[None]["loss_chars"] == len(rows[3][3])
    assert chat.read_back(chat.format_chat(df.where("false"))).collect() == []
