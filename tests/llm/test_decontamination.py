from pyspark.sql import functions as F

from tidemark.llm import decontamination as D


def brute_force(text, items, window=10):
    words, hit, names = D.words_of(text), set(), set()
    for name, item in items:
        own = D.words_of(item)
        n = min(window, len(own))
        for p in range(len(own) - n + 1 if n else 0):
            for q in range(len(words) - n + 1):
                if words[q : q + n] == own[p : p + n]:
                    hit |= set(range(q, q + n))
                    names.add("" if name is None else str(name))
    return len(words), len(hit), sorted(names), bool(hit)


def check(docs, benchmark, **settings):
    items = [tuple(r) for r in benchmark.select("item_id", "text").collect()]
    out = D.decontaminate(docs, benchmark, **settings).collect()
    assert len(out) == docs.count()
    for r in out:
        assert (r["n_words"], r["n_hit"], r["items"], r["contaminated"]) == brute_force(r["text"], items), r["doc_id"]
        assert sum(s["end"] - s["first"] for s in r["spans"]) == r["n_hit"]
        if not r["contaminated"]:
            assert r["clean_text"] == (r["text"] or "")
        elif r["n_hit"] <= 0.5 * r["n_words"]:
            assert len(D.words_of(r["clean_text"])) == r["n_words"] - r["n_hit"]
        else:
            assert r["clean_text"] == ""
    return out


def bench(spark):
    return spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")


def test_documents(spark, documents):
    docs = documents.filter("length(text) < 3000")
    assert any(r["contaminated"] for r in check(docs, bench(spark)))


def test_groups_of_items_give_the_same(spark, documents):
    docs = documents.filter("length(text) < 2000")
    check(docs, bench(spark), group_words=100)


def test_planted_and_odd_rows(spark, odd, nothing):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu"
    items = spark.createDataFrame([
        (1, item), (2, item.replace("mu nu", "xi pi")), (3, "short item"), (4, "Item"), (5, None), (6, " .,! "), (None, "gamma delta"),
        (7, item), (3, "short item"), (8, "a a a a a a a a a a a a"), (9, "b a a a"), (10, "漢字 かな"),
    ], "item_id long, text string")
    texts = [item, item.upper().replace(" ", ", "), "x " + " ".join(item.split()[2:12]) + " y", " ".join(item.split()[:9]),
             "a short item and a short, item", "item item", "a " * 40 + "b a a a a b", "so alpha beta gamma delta epsilon", "漢字 かな 한글",
             " ".join(item.split()[1:11]) + " " + " ".join(item.split()[3:13])]
    docs = odd.unionByName(spark.createDataFrame([(500 + i, t) for i, t in enumerate(texts)], "doc_id long, text string"),
                           allowMissingColumns=True)
    out = check(docs, items)
    assert sum(r["contaminated"] for r in out) >= len(texts) - 1 and "extra" in out[0].asDict()
    check(docs, items, group_words=2)
    check(docs, items.limit(0))
    assert D.decontaminate(nothing, items).count() == 0


def test_cut_texts(spark):
    items = spark.createDataFrame([("q", "one two three four five six seven eight nine ten eleven")], "item_id string, text string")
    text = "Before it: ONE two three, four five six seven eight nine ten. After it come many more words of its own, and so on."
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    row = D.decontaminate(docs, items).first()
    assert row["clean_text"] == "Before it: . After it come many more words of its own, and so on."
    assert D.decontaminate(docs, items, max_share=0.1).select(F.col("clean_text")).first()[0] == ""
