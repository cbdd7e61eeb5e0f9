import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline as C
from tests.check_oracles import compare, connect
from tests.llm import test_decontamination, test_line_dedup, test_near_dups
from tidemark.llm import bpe, quality
from tidemark.llm import queries as Q

SF_DIR = "/root/testdata/sf0.001"


def test_registered():
    assert [name.split("_")[0] for name in Q.QUERIES] == [f"op{n}" for n in range(1, 11)]
    assert set(entry.queries()) >= {*Q.QUERIES, "pipeline"} and set(Q.ORACLES) <= set(Q.QUERIES)


@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_query_matches_oracle(spark, name):
    verdict, *_ = compare(spark, connect(SF_DIR), SF_DIR, name)
    assert verdict == "ok", verdict


def brute_force(spark, documents):
    """The stages on the driver; the quality model's verdict alone is taken from the operator, which has its own test."""
    kept = {r[0] for r in quality.quality_rules(documents, Q.trusted_ids(spark, SF_DIR)).filter("kept").select("doc_id").collect()}
    rows = [(i, t) for i, t in documents.select("doc_id", "text").collect() if i in kept]
    rows = [(i, text) for i, _, _, text in test_line_dedup.brute_force(rows)]
    kept = {i for i, _, _, keep in test_near_dups.brute_force(rows, 5, 80) if keep}
    rows = [(i, t) for i, t in rows if i in kept]
    items = [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").select("item_id", "text").collect()]
    judged = {i: test_decontamination.brute_force(t, items) for i, t in rows}
    return {i: (t, judged[i]) for i, t in rows if judged[i][1] <= 0.5 * judged[i][0]}


def test_stages_match_brute_force(spark, documents):
    wanted = brute_force(spark, documents)
    out = {r["doc_id"]: r for r in C.run(spark, SF_DIR).collect()}
    assert set(out) == set(wanted)
    library = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, special_tokens={},
                                mergeable_ranks=dict(bpe.read_ranks(public_tokenizers.path(Q.RANKS))))
    for doc_id, (text, (n_words, n_hit, _, contaminated)) in wanted.items():
        row = out[doc_id]
        if not contaminated:
            assert row["text"] == text
        else:
            assert len(test_decontamination.D.words_of(row["text"])) == n_words - n_hit
        assert row["ids"] == library.encode_ordinary(row["text"]) and row["n_tokens"] == len(row["ids"])
        assert row["decoded"] == row["text"] and row["n_chars"] == len(row["text"] if n_hit or row["text"] != documents else "")


def test_stages_on_odd_and_empty_tables(spark, odd, nothing):
    for docs in (odd, nothing):
        for name, stage in C.STAGES:
            out = stage(spark, docs, SF_DIR)
            rows = out.collect()
            if name != "byte-level BPE":
                assert out.columns == docs.columns, name
            assert len(rows) <= docs.count()
            if name in ("line dedup", "byte-level BPE"):
                assert len(rows) == docs.count()
            assert docs.count() == 0 or rows or name == "quality rules"


def test_clean_documents_come_through(spark, documents):
    """Labelled good documents without a copy, shared line or test passage are unchanged at the end."""
    out = C.run(spark, SF_DIR).select("doc_id", "text")
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet").filter("quality = 1").select("doc_id")
    good = documents.join(labels, "doc_id").filter(F.size(F.split("text", r"\s+")) >= 60).select("doc_id", F.col("text").alias("was"))
    both = good.join(out, "doc_id").count()
    assert both >= 0.8 * good.count()
