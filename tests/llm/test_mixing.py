import math
import re
from collections import Counter, defaultdict

import xxhash
from pyspark.sql import functions as F

from tidemark.llm import mixing as M

WORD = re.compile("[^\x20\x09-\x0d]+")


def hashed(*values):
    seed = 42
    for v in values:
        seed = xxhash.xxh64_intdigest(int(v).to_bytes(8, "little", signed=True), seed)
    return seed - (1 << 64) if seed >> 63 else seed


def targets(sizes, weights=(5, 2, 1), share=1.5, most=2):
    """The contract word for word: stop at the limit, reshare the excess by weight until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    stopped, whole = {}, share * sum(sizes.values())
    while True:
        free = [s for s in names if s not in stopped]
        rest, total = whole - sum(stopped.values()), sum(weight[s] for s in free)
        found = {s: rest * weight[s] / total for s in free}
        above = [s for s in free if found[s] > most * sizes[s]]
        if not above:
            return names, {**stopped, **found}
        stopped.update({s: float(most * sizes[s]) for s in above})


def permuted(x, n, sid, again):
    for r in range(M.ROUNDS):
        partner = (hashed(M.SEED, r, sid, again) - x) % n
        if hashed(M.SEED + 1, r, sid, again, max(x, partner)) & 1:
            x = partner
    return x


def wanted_blocks(sizes, block_words, shard_slots):
    """(sid, block) -> times, drawn slot by slot."""
    names, goal = targets(sizes)
    blocks = [-(-sizes[s] // block_words) for s in names]
    quota = [min(2 * b, math.floor(goal[s] * b / sizes[s] + 0.5)) if b else 0 for s, b in zip(names, blocks, strict=True)]
    n, ticket = sum(quota), {}
    for sid in range(len(names)):
        low, high = (math.floor(sum(quota[: sid + k]) * (M.TICKETS / n)) for k in (0, 1))
        ticket.update(dict.fromkeys(range(low, high), sid))
    counts = Counter((i // shard_slots, ticket[hashed(M.SEED, i) % M.TICKETS]) for i in range(n) if hashed(M.SEED, i) % M.TICKETS in ticket)
    drawn = [sum(c for (_, s), c in counts.items() if s == sid) for sid in range(len(names))]
    taken = Counter()
    for sid, q in enumerate(quota):  # quotas are met whoever drew the slot
        for k in range(q):
            taken[sid, permuted(k % blocks[sid], blocks[sid], sid, k // blocks[sid])] += 1
    return taken, counts, drawn, quota


def test_targets_and_draws_equal_brute_force(documents):
    rows, sources = M.pack(documents, "doc_id", "source", "text", M.WEIGHTS, M.SHARE, M.MOST, M.BLOCK_WORDS)
    sizes = Counter()
    for r in documents.collect():
        sizes[r["source"]] += len(WORD.findall(r["text"] or ""))
    names, goal = targets(sizes)
    for r in sources.collect():
        assert names[r["sid"]] == r["source"] and sizes[r["source"]] == r["source_size"]
        assert math.isclose(goal[r["source"]], r["target"], rel_tol=1e-9)
    taken, counts, drawn, quota = wanted_blocks(sizes, M.BLOCK_WORDS, 16)
    slots = M.draw_slots(sources, 16).collect()
    assert Counter((r["sid"], r["block"]) for r in slots) == taken and max(taken.values()) <= 2
    assert sorted((r["sid"], r["k"]) for r in slots) == sorted((s, k) for s, q in enumerate(quota) for k in range(q))
    # a shard's counts are those drawn, but for slots beyond a quota
    kept = Counter((r["shard"], r["sid"]) for r in slots)
    over = sum(max(0, d - q) for d, q in zip(drawn, quota, strict=True))
    assert sum((counts - kept).values()) == over and sum(kept.values()) == sum(counts.values()) and over < 0.2 * sum(quota)


def test_taken_equals_the_words_of_the_mixed_blocks(spark):
    rows = [(i, f"s{i % 4}" if i % 5 else None, " ".join(f"d{i}_{k}" for k in range((i * 37) % 300))) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    words = Counter()
    for r in M.mixed_blocks(docs, shard_slots=8).collect():
        words.update(w.split("_")[0] for w in r["words"])
    out = {r["doc_id"]: r for r in M.mix(docs, shard_slots=8).collect()}
    assert len(out) == 120
    for i, _, text in rows:
        assert out[i]["taken"] == words[f"d{i}"] and out[i]["size"] == len(text.split()) and out[i]["taken"] <= 2 * out[i]["size"]


def test_sources_come_near_their_targets_and_reruns_agree(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    first = {r["doc_id"]: tuple(r) for r in M.mix(docs).collect()}
    assert first == {r["doc_id"]: tuple(r) for r in M.mix(docs.repartition(13)).collect()}
    source = {r["doc_id"]: r["source"] for r in docs.select("doc_id", "source").collect()}
    taken, goal = Counter(), {}
    for doc_id, size, source_size, target, n in first.values():
        taken[source[doc_id]] += n
        goal[source[doc_id]] = target
        assert n <= 2 * size
    for s, target in goal.items():
        assert abs(taken[s] - target) <= M.BLOCK_WORDS


def test_permutation_is_one(spark):
    for n in (1, 2, 7, 1000):
        out = spark.range(n).select(M.permuted(F.col("id"), F.lit(n), [F.lit(3), F.lit(0)]).alias("x")).collect()
        assert sorted(r["x"] for r in out) == list(range(n))
    assert [r["x"] for r in out] != sorted(r["x"] for r in out)


def test_running_totals_by_cells(spark):
    rows = [(g, i % 7, i, i * i % 11) for g in "ab" for i in range(100)]
    out = M.running_totals(spark.createDataFrame(rows, "g string, c int, i int, v int"), ["g"], "c", ["i"], "v", "t").collect()
    for g in "ab":
        total = 0
        for r in sorted((r for r in out if r["g"] == g), key=lambda r: (r["c"], r["i"])):
            assert r["t"] == total
            total += r["v"]


def test_odd_rows(spark, odd, nothing):
    out = M.mix(odd).collect()
    assert len(out) == odd.count()
    assert sorted((repr(r["doc_id"]), r["size"]) for r in out) == sorted(
        (repr(r["doc_id"]), len(WORD.findall(r["text"] or ""))) for r in odd.collect())
    assert all(r["taken"] <= 2 * r["size"] for r in out)
    by_source = defaultdict(int)
    for r in odd.collect():
        by_source[r["source"]] += len(WORD.findall(r["text"] or ""))
    assert {r["target"] for r in out} == set(targets(by_source)[1].values())
    assert M.mix(nothing).count() == 0 and M.mixed_blocks(nothing).count() == 0
    empty = M.mix(odd.withColumn("text", F.lit(""))).collect()
    assert len(empty) == len(out) and all(r["taken"] == 0 and r["target"] == 0 for r in empty)


def test_main_path_runs_no_python(documents):
    for frame in (M.mix(documents), M.mixed_blocks(documents)):
        assert not re.search("Python|Arrow|Pandas", frame._jdf.queryExecution().toString())
