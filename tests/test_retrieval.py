"""Gold sets, evaluation, feedback, lexical and vector retrieval."""

import math
import random
import re
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from ticketmill import schemas
from ticketmill.functions.rules import metadata_filter
from ticketmill.operators import feedback, gold, lexical, search, vector_index, vectors
from ticketmill.sources import records

FIX = "Swapped the toner drum and ran the cleaning page on the copier."
CORPUS = [
    (101, "Copier prints grey stripes since the toner change", FIX, "Copiers", ["3-Lisbon"]),
    (102, "Grey stripes on copies after the new toner went in", FIX, "Copiers", ["3-Lisbon"]),
    (103, "Bakery scale shows no weight", "Reset the load cell and tared the scale twice.", "Hardware", ["6-Turin"]),
]
HITS = "query_ticket_id bigint, rank int, ticket_id bigint"


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(CORPUS, "ticket_id bigint, symptom_text string, resolution_text string, category string, store array<string>")
    return df.withColumn("sub_category", F.lit(None).cast("string")).cache()


def expected(df):
    return {r.query_ticket_id: r.expected_ticket_ids for r in df.collect()}


def test_gold_groups_and_round_trip(spark, docs, tmp_path):
    assert sorted(r["size"] for r in gold.cluster_by_resolution(docs).collect()) == [1, 2]
    items, members = gold.build_gold(docs, n=10), gold.gold_members(docs)

    def rows(items_):
        return sorted(tuple(r) for r in gold.expected_rows(items_, members).collect())

    assert rows(items) == [(101, 101), (101, 102), (102, 101), (102, 102), (103, 103)]
    alone = gold.build_gold(docs, n=10, include_mates=False)
    assert {r.query_ticket_id: (r.fix_key, r.expected_count) for r in alone.collect()} == {i: (f"ticket:{i}", 1) for i in (101, 102, 103)}
    s = gold.gold_summary(items).first()
    assert (s["items"], s.single_fix, s.with_mates) == (3, 1, 2)
    records.write_gold(items, str(tmp_path / "g"))
    assert rows(records.read_gold(spark, str(tmp_path / "g"))) == rows(items)
    (tmp_path / "h").mkdir()
    (tmp_path / "h" / "x.json").write_text('{"query_ticket_id": 1, "query_text": "q"}\n')
    bare = records.read_gold(spark, str(tmp_path / "h")).first()
    assert (bare.expected_ticket_ids, bare.store, bare.labeled) == ([], [], False)


def test_groups_have_one_shape_whatever_their_size(spark):
    texts = [(i, "s", "the same fix, for the large group" if i < 300 else "a fix of its own, for this ticket", "c", []) for i in range(301)]
    many = spark.createDataFrame(texts, "ticket_id bigint, symptom_text string, resolution_text string, category string, store array<string>")
    items = gold.build_gold(many.withColumn("sub_category", F.lit(None).cast("string")), n=0).collect()
    assert {(r.expected_ticket_ids, r.expected_count, len(r.fix_key)) for r in items} == {(None, 300, 64), (None, 1, 64)}


def test_hand_labels_and_groups_are_judged_alike(spark, docs):
    named, members = gold.build_gold(docs, n=0), gold.gold_members(docs)
    lists = gold.expected_rows(named, members).groupBy("query_ticket_id").agg(F.collect_list("ticket_id").alias("expected_ticket_ids"))
    listed = named.drop("expected_ticket_ids").join(lists, "query_ticket_id")
    hits = spark.createDataFrame([(101, 1, 102), (102, 1, 999), (102, 2, 101), (103, 1, 103)], HITS)
    for loo in (True, False):
        a = gold.evaluate_retrieval(listed, hits, 3, loo).collect()
        assert a == gold.evaluate_retrieval(named, hits, 3, loo, members).collect()


def test_evaluation_modes(spark, docs):
    items, members = gold.build_gold(docs, n=10), gold.gold_members(docs)
    hits = spark.createDataFrame([(101, 1, 102), (101, 2, 999), (102, 1, 101), (102, 2, 998), (103, 1, 103)], HITS)
    loo = gold.evaluate_retrieval(items, hits, 3, True, members).first()
    assert (loo["items"], loo.evaluated, loo.hit_at_1, loo.hit_at_k, loo.mrr, loo.miss_count) == (3, 2, 1.0, 1.0, 1.0, 0)
    integrity = gold.evaluate_retrieval(items, hits, 3, False, members).first()
    assert (integrity.evaluated, integrity.hit_at_k, integrity.recall_at_k) == (3, 1.0, round(2 / 3, 4))
    assert gold.quality_gate(gold.evaluate_retrieval(items, hits.filter("rank > 1"), 3, True, members)).first().passed is False


def test_misses(spark):
    row = "query_ticket_id bigint, query_text string, expected_ticket_ids array<bigint>, expected_count bigint, fix_key string"
    items = spark.createDataFrame([(101, "q" * 200, [102], 1, None), (1, "x", [], 0, None), (103, "y", [103], 1, None)], row)
    none = spark.createDataFrame([(101, 1, 5), (101, 2, 6)], HITS)
    loo = gold.eval_misses(items, none, 3, True).collect()
    assert [(r.ticket_id, len(r.query), r.expected, r.got) for r in loo] == [(101, 200, [102], [5, 6])]
    assert len(gold.eval_misses(items, none, 3, True, query_chars=160).first().query) == 160
    integrity = {r.ticket_id: r.reason for r in gold.eval_misses(items, none, 3, False).collect()}
    assert integrity == {101: None, 103: None, 1: "no_expected_ids"}
    report = gold.evaluate_retrieval(items, none, 3, False).first()
    assert (report.evaluated, report.miss_count) == (2, 3)


def test_seeded_sample(docs):
    draw = [r.ticket_id for r in gold.sample_gold_queries(docs, 2, 1).collect()]
    assert len(draw) == 2 and draw == [r.ticket_id for r in gold.sample_gold_queries(docs, 2, 1).collect()]
    assert gold.sample_gold_queries(docs, 0).count() == 3


def log(spark, *rows):
    base = {f.split()[0]: None for f in schemas.FEEDBACK.replace("\n", " ").split(", ")}
    full = [{**base, "kind": "retrieval", "accepted": False, "seq": i, **r} for i, r in enumerate(rows)]
    return spark.createDataFrame(full, schemas.FEEDBACK)


def test_feedback_rates_and_boosts(spark):
    events = log(
        spark,
        {"ticket_id": 1, "suggested_ticket_id": 101, "accepted": True, "resolved": True},
        {"ticket_id": 2, "suggested_ticket_id": 101, "accepted": True, "resolved": False},
        {"ticket_id": 3, "suggested_ticket_id": 101},
        {"ticket_id": 4, "suggested_ticket_id": 202},
        {"ticket_id": 4, "suggested_ticket_id": 202, "accepted": True, "resolved": True},
        {"ticket_id": 9, "suggested_ticket_id": 777},
        {"kind": "cluster", "alert_id": 7, "verdict": "accept"},
    )
    stats = {r.suggested_ticket_id: r for r in feedback.suggestion_stats(events).collect()}
    s = stats[101]
    assert (s.shown, s.accepted, s.resolved_after_accept, s.accept_rate, s.success_rate) == (3, 2, 1, 0.6667, 0.5)
    assert (stats[202].shown, stats[202].accepted) == (1, 1) and set(stats) == {101, 202, 777}
    boosts = {r.ticket_id: r.boost for r in feedback.boost_table(feedback.suggestion_stats(events)).collect()}
    assert boosts == {101: 1.3, 202: 1.5}


def test_feedback_log(spark, tmp_path):
    path = str(tmp_path / "log")
    records.append_feedback(spark.createDataFrame([(1, 101, True)], "ticket_id bigint, suggested_ticket_id bigint, accepted boolean"), path)
    verdict = spark.createDataFrame([(7, "accept", "app:engage")], "alert_id bigint, verdict string, cluster_key string")
    records.cluster_verdicts(verdict).write.mode("append").json(path)
    got = {r.kind: r for r in records.read_feedback(spark, path).collect()}
    assert got["retrieval"].accepted and got["retrieval"].at is not None and got["retrieval"].resolved is None
    assert (got["cluster"].alert_id, got["cluster"].verdict, got["cluster"].accepted) == (7, "accept", False)


def brute_bm25(docs, queries, k1=1.2, b=0.75):
    toks = {d: t.lower().split() for d, t in docs}
    avg = sum(map(len, toks.values())) / len(toks)
    df = {}
    for words in toks.values():
        for w in set(words):
            df[w] = df.get(w, 0) + 1
    out = {}
    for q, text in queries:
        for d, words in toks.items():
            score = sum(
                math.log(1 + (len(toks) - df[w] + 0.5) / (df[w] + 0.5)) * words.count(w) * (k1 + 1)
                / (words.count(w) + k1 * (1 - b + b * len(words) / avg))
                for w in set(text.lower().split()) if w in words
            )
            if score:
                out[q, d] = round(score, 6)
    return out


@pytest.mark.parametrize("block_docs", [lexical.BLOCK_DOCS, 4])
def test_bm25_against_brute_force(spark, block_docs, tmp_path):
    rng = random.Random(5)
    words = ["mail", "vpn", "disk", "login", "slow", "print", "the", "a"]
    texts = [(i, " ".join(rng.choices(words, [1, 1, 1, 1, 1, 1, 9, 5], k=rng.randint(1, 40)))) for i in range(150)]
    texts += [(i, "vpn vpn slow") for i in range(150, 220)]  # a third are copies
    asks = [(1, "vpn slow"), (2, "the disk"), (3, "nothing known"), (4, "print print mail")]
    d = spark.createDataFrame(texts, "ticket_id bigint, symptom_text string")
    q = spark.createDataFrame(asks, "query_id bigint, text string").withColumn("exclude_id", F.lit(150).cast("bigint"))
    want = {k: v for k, v in brute_bm25(texts, asks).items() if k[1] != 150}
    index = lexical.write_index(d, str(tmp_path / "index"), ("symptom_text",), block_docs=block_docs)
    got = lexical.bm25_scores(d, q, 1000, index=index).collect()
    assert {(r.query_id, r.ticket_id): round(r.score, 6) for r in got} == want
    top = lexical.bm25_scores(d, q, 5, ("symptom_text",), index=index if block_docs == 4 else None).filter("query_id = 1").orderBy("rank").collect()
    order = sorted((k for k in want if k[0] == 1), key=lambda k: (-want[k], k[1]))
    assert [r.ticket_id for r in top] == [k[1] for k in order[:5]]


def test_stored_index_several_exclusions_and_large_ids(spark, tmp_path):
    big = 2**53 + 1
    texts = [(big, "vpn slow"), (big + 1, "vpn slow"), (big + 2, "vpn"), (4, "vpn disk"), (5, "other"), (None, "vpn vpn")]
    d = spark.createDataFrame(texts, "ticket_id bigint, symptom_text string")
    asks = [(1, "vpn slow", big), (1, "vpn slow", big + 1), (2, "vpn slow", None), (3, " ", 4), (3, " ", 5), (4, "unknown", None)]
    q = spark.createDataFrame(asks, "query_id bigint, text string, exclude_id bigint")
    lexical.write_index(d, str(tmp_path / "index"), ("symptom_text",))
    index = lexical.open_index(spark, str(tmp_path / "index"))
    got = {(r.query_id, r["rank"]): r.ticket_id for r in lexical.bm25_search(index, q, 2).collect()}
    assert got == {(1, 1): big + 2, (1, 2): 4, (2, 1): big, (2, 2): big + 1, (3, 1): big, (3, 2): big + 1}
    adhoc = lexical.bm25_scores(d, q, 2, ("symptom_text",)).collect()
    assert {(r.query_id, r["rank"]): r.ticket_id for r in adhoc} == got
    none = lexical.write_index(d.limit(0), str(tmp_path / "empty"), ("symptom_text",))
    assert lexical.bm25_search(none, q, 2).count() == 0


def test_blocks_that_cannot_reach_the_top_are_not_read(spark, tmp_path, monkeypatch):
    rng = random.Random(8)
    filler = [f"w{k}" for k in range(50)]
    texts = [(i, " ".join(["common"] + rng.choices(filler, k=rng.choice([3, 9, 30, 90, 270])))) for i in range(3000)]
    texts += [(3000 + i, "rare common " + " ".join(rng.choices(filler, k=4))) for i in range(12)]
    d = spark.createDataFrame(texts, "ticket_id bigint, symptom_text string")
    q = spark.createDataFrame([(1, "rare common"), (2, "common"), (3, "w7 common w9")], "query_id bigint, text string")
    index = lexical.write_index(d, str(tmp_path / "index"), ("symptom_text",), block_docs=8)
    asked, read = [], []
    further, scores = lexical.further_blocks, lexical._scores
    monkeypatch.setattr(lexical, "further_blocks", lambda b, *a: asked.append(b) or further(b, *a))
    monkeypatch.setattr(lexical, "_scores", lambda i, w, b, *a: read.append(b) or scores(i, w, b, *a))
    got = lexical.bm25_search(index, q, 5).collect()
    want = brute_bm25(texts, [(r.query_id, r.text) for r in q.collect()])
    for query in (1, 2, 3):
        best = sorted((k for k in want if k[0] == query), key=lambda k: (-want[k], k[1]))[:5]
        assert [r.ticket_id for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == query] == [k[1] for k in best]
    have = {r.query_id: r["count"] for r in asked[0].groupBy("query_id").count().collect()}
    seen = {}
    for blocks in read:
        for r in blocks.groupBy("query_id").count().collect():
            seen[r.query_id] = seen.get(r.query_id, 0) + r["count"]
    assert have[1] > 100 and seen[1] < have[1] / 10 and seen[2] < have[2] / 2 and seen[3] < have[3]


@pytest.mark.parametrize("few", [True, False])
def test_rows_of_a_block_are_sent_once_and_not_per_query(spark, tmp_path, monkeypatch, few):
    """A posting used to be shuffled once for every query that has its word."""
    if not few:
        for name, value in {"TILE_QUERIES": 2, "TILE_TERMS": 3, "PIECE_WORDS": 40, "BROADCAST_TILES": 1, "BROADCAST_WORDS": 1}.items():
            monkeypatch.setattr(lexical, name, value, raising=False)
    rng = random.Random(4)
    words = ["mail", "vpn", "disk", "login", "slow", "print", "the", "a"]
    texts = [(i, " ".join(rng.choices(words, k=rng.randint(0, 30)))) for i in range(120)]
    asks = [(i, " ".join(rng.sample(words, 3))) for i in range(9)]
    d = spark.createDataFrame(texts, "ticket_id bigint, symptom_text string")
    q = spark.createDataFrame(asks, "query_id bigint, text string")
    plans, scores = [], lexical._scores
    monkeypatch.setattr(lexical, "_scores", lambda *a: plans.append(scores(*a)) or plans[-1])
    index = lexical.write_index(d, str(tmp_path / "index"), ("symptom_text",), block_docs=4)
    found = [lexical.bm25_search(index, q, 5).collect(), lexical.bm25_scores(d, q, 5, ("symptom_text",)).collect()]
    want = brute_bm25(texts, asks)
    best = {}
    for query in range(9):
        order = sorted((k for k in want if k[0] == query), key=lambda k: (-want[k], k[1]))[:5]
        best |= {(query, rank): i for rank, (_, i) in enumerate(order, 1)}
    assert index.n == 120 and {r.ticket_id for r in index.docs.collect()} == set(range(120))
    for got in found:
        assert {(r.query_id, r["rank"]): r.ticket_id for r in got} == best
    for plan in plans:
        shown = plan._jdf.queryExecution().executedPlan().toString()
        assert not re.search(r"hashpartitioning\(query_id#\d+L?, block", shown)


def test_rows_of_one_id_and_length_are_one_document(spark, tmp_path):
    rows = [(1, "vpn slow"), (1, "vpn disk"), (1, "vpn"), (2, "")]
    d = spark.createDataFrame(rows, "ticket_id bigint, symptom_text string")
    index = lexical.write_index(d, str(tmp_path / "index"), ("symptom_text",))
    assert sorted(map(tuple, index.docs.collect())) == [(1, 1), (1, 2), (2, 0)] and index.avgdl == 1.0
    found = index.postings.select("term", F.inline("entries")).collect()
    assert sorted(map(tuple, found)) == [("disk", 1, 1, 2), ("slow", 1, 1, 2), ("vpn", 1, 1, 1), ("vpn", 1, 2, 2)]


def test_query_without_words_matches_all(spark, docs):
    q = spark.createDataFrame([(1, " ,. "), (2, "scale")], "query_id bigint, text string")
    got = lexical.bm25_scores(docs, q, 2, ("symptom_text",)).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.ticket_id, r.score) for r in got if r.query_id == 1] == [(1, 101, 1.0), (1, 102, 1.0)]
    assert [r.ticket_id for r in got if r.query_id == 2] == [103]


@pytest.mark.parametrize("limit", [vectors.BROADCAST_BYTES, 8 * 6 * 3])
def test_knn_against_brute_force(spark, limit):
    rng = np.random.default_rng(3)
    mat = rng.normal(size=(60, 6)).astype(np.float32)
    mat[40:] = mat[40]  # copies tie and go by id
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(mat)], "ticket_id bigint, symptom_vector array<float>").repartition(5)
    q = d.limit(10).select(F.col("ticket_id").alias("query_id"), F.col("symptom_vector").alias("vector"), F.col("ticket_id").alias("exclude_id")).cache()
    unit = mat.astype(np.float64) / np.linalg.norm(mat.astype(np.float64), axis=1, keepdims=True)
    got = vectors.knn(d, q, 7, broadcast_bytes=limit).collect()
    for query in {r.query_id for r in got}:
        sims = np.round(unit @ unit[query], 12)
        want = sorted((i for i in range(60) if i != query), key=lambda i: (-sims[i], i))[:7]
        assert [r.ticket_id for r in sorted((r for r in got if r.query_id == query), key=lambda r: r.rank)] == want


def test_scores_held_at_once_do_not_grow_with_the_queries():
    rng = np.random.default_rng(8)
    mat = rng.normal(size=(6_000, 8)).round(1)
    mat[3_000:5_000] = mat[0]  # ties over several tiles
    ids = rng.permutation(len(mat)).astype(np.int64)
    few = vectors.TopK(ids[:700], ids[:700], 5)
    for at in range(0, len(mat), 2_500):
        vectors.add_vectors(few, mat[:700], ids[at : at + 2_500], mat[at : at + 2_500])
    got = few.batch().to_pydict()
    scores = np.round(mat[:700] @ mat.T, 12)
    want = [(int(ids[q]), int(i)) for q in range(700) for i in ids[np.lexsort((ids, -scores[q]))] if i != ids[q]]
    want = [pair for at in range(0, len(want), len(mat) - 1) for pair in want[at : at + 5]]
    assert list(zip(got["query_id"], got["ticket_id"])) == want
    many = np.repeat(mat, 5, axis=0)
    tracemalloc.start()
    vectors.add_vectors(vectors.TopK(np.arange(len(many)), None, 5), many, ids[:4_096], mat[:4_096])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 400 << 20  # 30,000 by 4,096 scores are 983 MB


def vector_rows(spark, mat, ids=None):
    rows = [(int(i), None if v is None else [float(x) for x in v]) for i, v in zip(ids if ids is not None else range(len(mat)), mat)]
    return spark.createDataFrame(rows, "ticket_id bigint, symptom_vector array<float>")


def hits(df):
    return sorted((r.query_id, r["rank"], r.ticket_id, r.score) for r in df.collect())


def test_indexed_knn_equals_the_full_comparison(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(12)
    centres = rng.normal(size=(12, 8)) * 4
    mat = [*(centres[rng.integers(12, size=900)] + rng.normal(size=(900, 8)) * 0.2).astype(np.float32)]
    mat += [mat[7]] * 400 + [np.zeros(8, np.float32)] * 5  # a large group of copies, and vectors without direction
    ids = [2**53 + i for i in range(len(mat))]
    d = vector_rows(spark, mat, ids).unionByName(vector_rows(spark, [None, [1.0], mat[0]], [1, 2, 3])).unionByName(
        spark.createDataFrame([(None, [1.0] * 8), (4, [1.0, None] + [0.0] * 6)], "ticket_id bigint, symptom_vector array<float>"))
    monkeypatch.setattr(vector_index, "CELL_DOCS", 50)
    index = vector_index.write_index(d, str(tmp_path / "index"), lists=16)
    asked = [0, 7, 8, 500, 1000, 1302]
    q = spark.createDataFrame([(i, [float(x) for x in mat[i]]) for i in asked], "query_id bigint, vector array<float>")
    q = q.withColumn("exclude_id", F.lit(2**53).cast("bigint") + F.col("query_id"))
    read = []
    pairs = vector_index.wanted_cells
    monkeypatch.setattr(vector_index, "wanted_cells", lambda *a: read.append(pairs(*a)) or read[-1])
    want = hits(vectors.knn(d, q, 9))
    assert hits(vector_index.knn(index, q, 9)) == want and len(want) == 9 * len(asked)
    # lists that cannot reach the ninth score are not read
    cells = index.cells.count()
    used = sum(r.select("query_id", "cell").distinct().count() for r in read if "cell" in r.columns)
    assert cells > 12 and used < cells * len(asked) / 2
    several = q.unionByName(q.withColumn("exclude_id", F.lit(2**53 + 7).cast("bigint")))
    found = hits(vector_index.knn(index, several, 9))
    assert not {r[2] for r in found if r[0] == 7} & {2**53 + 7}
    assert all(r[2] not in (2**53 + r[0], 2**53 + 7) for r in found)
    opened = vector_index.open_index(spark, str(tmp_path / "index"))
    assert hits(vector_index.knn(opened, q.limit(2), 3)) == hits(vectors.knn(d, q.limit(2), 3))


def test_pairs_of_queries_and_cells_are_handed_on_in_pieces(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(4)
    mat = rng.normal(size=(400, 5)).astype(np.float32)
    d = vector_rows(spark, mat)
    index = vector_index.write_index(d, str(tmp_path / "a"), lists=16)
    monkeypatch.setattr(vector_index, "PICKED_PAIRS", 2 * index.cells.count())
    q = d.coalesce(1).select(F.col("ticket_id").alias("query_id"), F.col("symptom_vector").alias("vector"))
    handed = []

    def watch(queries, *rest):
        # an iterator's batches as the tasks hand them on
        class Rows:
            sparkSession = queries.sparkSession

            def select(self, *names):
                self.table = queries.select(*names).toArrow()
                return self

            def mapInArrow(self, fn, schema):
                handed.extend(b.num_rows for b in fn(iter(self.table.to_batches())))
                return queries.select(*["query_id", "vector", "more", "floor"]).mapInArrow(fn, schema)

        return picked(Rows(), *rest)

    picked = vector_index.wanted_cells
    monkeypatch.setattr(vector_index, "wanted_cells", watch)
    assert hits(vector_index.knn(index, q, 20)) == hits(vectors.knn(d, q, 20))
    assert len(handed) == 400 and max(handed) <= 2 * index.cells.count()


def test_indexed_knn_of_spread_vectors_and_empty_tables(spark, tmp_path):
    rng = np.random.default_rng(2)
    mat = rng.normal(size=(300, 5)).astype(np.float32)
    d = vector_rows(spark, mat)
    q = spark.createDataFrame([(i, [float(x) for x in rng.normal(size=5)]) for i in range(20)], "query_id bigint, vector array<float>")
    index = vector_index.write_index(d, str(tmp_path / "a"), lists=8)
    assert hits(vector_index.knn(index, q, 400)) == hits(vectors.knn(d, q, 400))
    assert hits(vector_index.knn(index, q, 1)) == hits(vectors.knn(d, q, 1))
    empty = vector_index.write_index(d.limit(0), str(tmp_path / "b"), lists=8)
    assert vector_index.knn(empty, q, 3).count() == 0 and vector_index.knn(index, q.limit(0), 3).count() == 0


def test_embedding_batches_and_order(spark, docs):
    def fn(texts):
        assert len(texts) <= 2
        return [[float(len(t)), 1.0] for t in texts]

    got = vectors.embed_documents(docs, fn, batch_size=2).collect()
    assert {r.ticket_id: r.symptom_vector[0] for r in got} == {c[0]: float(len(c[1])) for c in CORPUS}
    assert vectors.hashing_vector(["a b", ""], 8)[1] == [0.0] * 8


def kb(docs):
    none = F.array().cast("array<string>")
    return docs.withColumns({
        "display_id": F.lit("x"), "subject": F.lit(""), "resolution_source": F.lit("reply"), "has_resolution": F.lit(True),
        "apps": F.array(F.lit("outlook")), "error_codes": none, "linked_itglue_urls": F.lit(None).cast("array<string>"),
        "age_days": F.when(F.col("ticket_id") == 101, 900).otherwise(5),
    })


def test_search_kb_modes_filters_and_projection(spark, docs):
    q = spark.createDataFrame([(1, "grey stripes toner")], "query_id bigint, text string")
    got = search.search_kb(kb(docs), q, 2).orderBy("rank").collect()
    assert [r.ticket_id for r in got] == [102, 101] and got[0].mode == "bm25-only" and got[0].itglue_urls == []
    assert got[0].symptom.startswith("Grey stripes")
    boosted = search.search_kb(kb(docs), q, 1, boosts=spark.createDataFrame([(101, 1.5)], "ticket_id bigint, boost double"))
    assert boosted.first().ticket_id == 101
    keep = metadata_filter(category="Hardware", store="6-Turin", app="outlook")
    assert search.search_kb(kb(docs), q, 3, keep).count() == 0
    assert kb(docs).filter(metadata_filter(category="O'Brien")).count() == 0


def test_hybrid_fuses_and_withholds_self(spark, docs):
    emb = vectors.embed_documents(docs)
    q = emb.select(F.col("ticket_id").alias("query_id"), F.col("symptom_text").alias("text"),
                   F.col("symptom_vector").alias("vector"), F.col("ticket_id").alias("exclude_id")).cache()
    docs_v = emb.withColumn("subject", F.lit(""))
    loo = search.hybrid_search(docs_v, q, top=3, exclude_self=True)
    assert loo.filter("query_id = ticket_id").count() == 0 and loo.filter("mode <> 'hybrid'").count() == 0
    own = search.hybrid_search(docs_v, q, top=1).collect()
    assert all(r.query_id == r.ticket_id for r in own) and round(own[0].score, 9) == round(2 / 61, 9)
    items = gold.build_gold(docs, n=0)
    report = gold.score_search(items, lambda qs, loo_, k: search.hybrid_search(
        docs_v, qs.join(q.select("query_id", "vector"), "query_id"), top=k, exclude_self=loo_), 3, True, gold.gold_members(docs)).first()
    assert (report.evaluated, report.hit_at_1) == (2, 1.0)


def test_rerank_prefers_reranker_then_score(spark):
    hits = spark.createDataFrame(
        [(1, 1, 1.0, None, 900, 1.0), (1, 2, 1.0, None, 5, 1.0), (1, 3, 0.1, 3.0, None, 1.0), (1, 4, None, 0.0, None, 1.0)],
        "query_id bigint, ticket_id bigint, score double, reranker_score double, age_days int, boost double")
    got = search.rerank_topk(hits, 4).orderBy("rank").collect()
    assert [(r.ticket_id, round(r.score, 4)) for r in got] == [(3, 3.0), (2, 1.15), (1, 0.9), (4, 0.0)]
