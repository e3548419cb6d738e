"""Signals, confidence, changes, metrics, versions, pools and digests."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from ticketmill import defaults as D
from ticketmill import schemas
from ticketmill.operators import contains, digest, evidence as ev, intervals, ordered
from ticketmill.operators.monitor import to_alerts

NOW = datetime(2025, 3, 19, 12, 0, 0)
SIG = "cluster_id string, signal_key string, role string, stream string, mode string, count bigint, prior bigint, threshold_hit boolean"


def before(minutes):
    return NOW - timedelta(minutes=minutes)


@pytest.fixture(scope="module")
def cluster(spark):
    return spark.createDataFrame([("c1", "app:engage", before(60), NOW)], "cluster_id string, key string, window_start timestamp, window_end timestamp").cache()


@pytest.fixture(scope="module")
def catalog(spark):
    rows = [("vdi.push", "cause", "horizon", "PUSH"), ("vdi.error", "effect", "horizon", "CLONE"), ("vdi.error", "effect", "horizon", "NOT_READY")]
    return spark.createDataFrame(rows, "key string, role string, stream string, value string").cache()


def logs(spark, *groups):
    rows = [("horizon", before(m), "host", kind, pool, f"Pool {pool}", "u", "x", i * 1000 + j)
            for i, (kind, n, m, pool) in enumerate(groups) for j in range(n)]
    return spark.createDataFrame(rows, "stream string, timestamp timestamp, source string, event_type string, desktop_id string, desktop string, user string, severity string, event_id bigint")


@pytest.mark.parametrize(
    "cause, effect, prior, want",
    [(2, 10, 3, "likely"), (2, 1, 0, "consistent with"), (0, 9, 2, "consistent with"), (0, 0, 0, "none"), (0, 8, 8, "none")],
)
def test_confidence_tiers(spark, cluster, catalog, cause, effect, prior, want):
    events = logs(spark, ("PUSH", cause, 300, "a"), ("CLONE", effect, 30, "a"), ("NOT_READY", prior, 150, "a"), ("AGENT", 5, 10, "a"))
    signals = ev.signal_counts(events, cluster, catalog)
    got = {r.signal_key: (r["count"], r.prior) for r in signals.collect()}
    assert got == {"vdi.push": (cause, 0), "vdi.error": (effect, prior)}
    assert ev.confidence_tier(signals).first().confidence == want


def test_window_edges_are_half_open(spark, cluster, catalog):
    # effect window [10:00, 12:00], prior [08:00, 10:00)
    events = logs(spark, ("CLONE", 1, 0, "a"), ("CLONE", 1, 120, "a"), ("CLONE", 1, 240, "a"), ("CLONE", 1, 241, "a"), ("CLONE", 1, -1, "a"))
    got = ev.signal_counts(events, cluster, catalog).filter("signal_key = 'vdi.error'").first()
    assert (got["count"], got.prior) == (2, 1)


def test_pool_scope(spark, cluster, catalog):
    events = logs(spark, ("CLONE", 4, 30, "kio4-vdi"), ("CLONE", 13, 30, "dep2-vdi"))
    scoped = cluster.withColumn("pool", F.lit("kio4-vdi"))
    count = lambda c: ev.signal_counts(events, c, catalog).filter("signal_key = 'vdi.error'").first()["count"]
    assert (count(scoped), count(cluster)) == (4, 17)


def pools(spark, man, bos):
    return spark.createDataFrame([(0, "kio4-vdi", "Lisbon Kiosk Pool", man), (1, "dep2-vdi", "Lisbon Depot Pool", bos)], "ord int, name string, display_name string, error_count int")


def test_pools(spark, cluster):
    hinted = cluster.withColumn("pool_hint", F.lit("KIO4"))
    plain = cluster.withColumn("pool_hint", F.lit(None).cast("string"))
    count = lambda c, p: ev.pool_error_signal(c, p).first()["count"]
    assert [count(hinted, pools(spark, 4, 0)), count(hinted, pools(spark, 0, 13)), count(plain, pools(spark, 4, 13))] == [4, 0, 17]
    assert ev.resolve_pool(hinted, pools(spark, 0, 0)).first().pool == "kio4-vdi"
    assert ev.resolve_pool(hinted.withColumn("pool_hint", F.lit("x9")), pools(spark, 0, 0)).first().pool is None
    assert ev.resolve_pool(hinted.withColumn("pool_hint", F.lit("lisbon")), pools(spark, 0, 0)).first().pool == "kio4-vdi"
    assert [r.pool for r in ev.pool_error_samples(pools(spark, 4, 0)).collect()] == ["Lisbon Kiosk Pool"]
    samples = spark.createDataFrame([("c1", "a", 0, "kio4-vdi", "Lis Kiosk"), ("c1", "b", 0, "bos1", "x")], "cluster_id string, signal_key string, ord int, name string, pool string")
    assert ev.aligned_pools(samples, hinted).first().aligned == "kio4-vdi"
    assert ev.aligned_pools(samples, hinted.withColumn("pool_hint", F.lit("zz"))).first().aligned == "none matched"


def test_samples_are_the_newest(spark, cluster, catalog):
    events = logs(spark, *[("CLONE", 1, m, f"p{m % 2}") for m in range(5, 100, 5)], ("PUSH", 2, 3000, "a"))
    samples = ev.signal_samples(events, cluster, catalog, 3)
    got = sorted((r.ord, r.timestamp) for r in samples.collect())
    assert got == [(0, before(5)), (1, before(10)), (2, before(15))]
    assert ev.limit_samples(samples, 1).count() == 1


def test_samples_and_pools_follow_the_cluster_pool(spark, cluster, catalog):
    # the newest events are of another pool than the cluster's
    events = logs(spark, ("CLONE", 4, 40, "p0"), ("PUSH", 1, 300, "p0"), ("CLONE", 9, 5, "p1"), ("NOT_READY", 2, 6, "p2"))
    scoped = cluster.withColumn("pool", F.lit("p0"))
    both = {name: ev.signal_samples(events, c, catalog, 3).collect() for name, c in (("own", scoped), ("all", cluster))}
    assert {r.desktop_id for r in both["own"]} == {"p0"} and len(both["own"]) == 4
    assert {r.desktop_id for r in both["all"] if r.signal_key == "vdi.error"} == {"p1"}
    counted = {(r.name, r.pool, r.n) for r in ev.pool_counts(events, cluster, catalog).collect()}
    assert counted == {("p0", "Pool p0", 5), ("p1", "Pool p1", 9), ("p2", "Pool p2", 2)}
    own = ev.pool_counts(events, scoped, catalog)
    assert [(r.pool, r.n) for r in ev.pools_seen(own).collect()] == [("Pool p0", 5)]
    seen = ev.pools_seen(ev.pool_counts(events, cluster, catalog), 2).orderBy("rank").collect()
    assert [(r.pool, r.n) for r in seen] == [("Pool p1", 9), ("Pool p0", 5)]


def changes(spark, *rows):
    base = {"description_text": None, "status": "Closed", "risk": "Low", "impacted_services": [], "updated_at": "2025-03-19T08:00:00Z"}
    return ev.parsed_changes(spark.createDataFrame([{**base, **r} for r in rows], schemas.CHANGES))


IN = {"planned_start_date": "2025-03-19T11:45:00Z", "planned_end_date": "2025-03-19T12:30:00Z"}
PAST = {"planned_start_date": "2025-03-18T04:00:00Z", "planned_end_date": "2025-03-18T04:30:00Z"}


def matched(cluster, rows, words, overlap=True):
    asked = cluster.withColumn("keywords", F.array(*map(F.lit, words)).cast("array<string>"))
    pairs = ev.change_keyword_match(ev.change_overlap(asked, rows, require_overlap=overlap))
    count = ev.change_feed_signal(asked, pairs).first()["count"]
    ids = sorted(r.id for r in pairs.collect())
    assert count == len(ids)
    return ids


def test_changes(spark, cluster):
    engage = {"subject": "New build for Engage", "impacted_services": ["Engage"]}
    rows = changes(
        spark, {"id": 1, "subject": "Cable tidying", "impacted_services": ["Engage"], **IN},
        {"id": 2, "subject": "Engage hosts get more memory", **IN}, {"id": 3, "subject": "Scanner batteries", **IN},
        {"id": 4, **engage, **PAST}, {"id": 5, **engage},
        {"id": 6, **engage, "planned_start_date": "2025-03-19T11:00:00Z"},
        {"id": 7, **engage, "planned_start_date": "2025-02-18T00:00:00Z", "planned_end_date": "2025-04-08T00:00:00Z"},
        {"id": 8, **engage, **IN, "updated_at": "2025-03-09T00:00:00Z"},
    )
    assert matched(cluster, rows, ["engage"]) == [1, 2, 6, 7]
    assert matched(cluster, rows, []) == [1, 2, 3, 6, 7]
    assert matched(cluster, rows, ["engage"], overlap=False) == [1, 2, 4, 5, 6, 7]
    assert ev.change_updates(cluster, rows).first()["count"] == 7


def test_keywords_and_hint(spark, cluster):
    t = spark.createDataFrame(
        [("c1", 2, before(5), "x", "at DEP2-VDI-9", "engage/engage till"), ("c1", 1, before(9), "x", "KIO4-VDI-207 crawls", "checkout/with vpn")],
        "cluster_id string, id bigint, created_at timestamp, subject string, description_text string, system_key string")
    assert ev.cluster_keywords(cluster, t).first().keywords == ["checkout", "engage", "till"]
    assert ev.cluster_pool_hint(t).first().pool_hint == "kio4"


def test_log_error_rate(spark, cluster):
    rows = [("Engage", "Error", before(30), "m", "s")] * 40 + [("Engage", "Warning", before(90), "m", "s")] * 5 + [("Engage", "Info", before(30), "m", "s")] * 9
    df = spark.createDataFrame(rows, "app string, level string, timestamp timestamp, machine string, session string")
    got = ev.log_error_rate(df, cluster, "Engage").withColumn("up", ev.elevated()).first()
    assert (got.signal_key, got["count"], got.prior, got.up) == ("engage.log_errors", 40, 5, True)
    assert ev.log_error_rate(df, cluster, "Engage", machine="other").first()["count"] == 0


def test_vendor_status(spark, cluster):
    pages = spark.createDataFrame([("A", "A status is up"), ("B", "B status is down"), ("C", "hello"), ("D", None)], "vendor string, html string")
    assert ev.vendor_status_signal(cluster, pages).first()["count"] == 2
    assert {r.vendor: r.status for r in ev.vendor_statuses(pages).collect()} == {"A": "up", "B": "issues", "C": "unknown", "D": "unreachable"}


def test_metric_picks_and_elevation(spark, cluster, one):
    picks = one([["engage", "slow"], ["vdi"], ["unrelated"], ["engage", "vdi"]], lambda t: F.transform(ev.pick_metrics(t), lambda m: m["metric_key"]), "array<string>")
    assert picks[0] == ["sql.lock_waits", "sql.procs_blocked", "sql.query_time"] and picks[3] == picks[0] + picks[1]
    assert picks[1] == ["vdi.host_mem", "vdi.cpu_latency"] and picks[2] == ["sql.lock_waits", "vdi.host_mem"]
    values = [("sqlserver.stats.lock_waits", before(20), 6.0), ("sqlserver.stats.lock_waits", before(80), 1.0),
              ("vsphere.mem.usage.avg", before(10), 92.0), ("vsphere.mem.usage.avg", before(70), 91.0)]
    points = spark.createDataFrame(values, "metric string, ts timestamp, value double")
    asked = cluster.withColumn("metrics", ev.pick_metrics(F.array(F.lit("unrelated"))))
    got = {r.signal_key: (r["count"], r.prior, r.up) for r in ev.metric_signal(ev.metric_elevation(points, asked)).withColumn("up", ev.elevated()).collect()}
    assert got == {"metric.sql.lock_waits": (6, 1, True), "metric.vdi.host_mem": (92, 91, True)}


def test_version_change(spark, cluster):
    snap = "app string, observed_at timestamp, last_modified string, version string"
    old, new = "Fri, 14 Mar 2025 14:52:54 GMT", "Tue, 18 Mar 2025 16:00:00 GMT"
    count = lambda c, rows: [r["count"] for r in ev.version_change_signal(c, spark.createDataFrame(rows, snap)).collect()]
    both = ("Engage Till prod", "Engage Till lab")
    assert count(cluster, [(a, before(90), old, "4.0.2.7") for a in both]) == []
    moved = [(a, before(90), old, "4.0.2.7") for a in both] + [(a, before(5), new, "4.0.2.8") for a in both]
    assert count(cluster, moved) == [2]
    assert count(cluster, [(a, before(5), new, "1") for a in both]) == [1]  # recent, production only
    assert count(cluster.withColumn("key", F.lit("print:printer")), moved) == []
    rows = spark.createDataFrame([("Engage Till prod", True), ("Engage Till prod", False), ("Till lab", False)], "a string, c boolean")
    assert [r[0] for r in rows.select(ev.version_weight(F.col("a"), F.col("c"))).collect()] == [1.0, 0.7, 0.21]


def test_evidence_digest_and_parts(spark):
    signals = spark.createDataFrame([("1", "vdi.push", "cause", "horizon", "presence", 1, 0, False), ("1", "vdi.error", "effect", "horizon", "elevation", 10, 3, False)], SIG)
    seen = spark.createDataFrame([("1", 1, "North <Pool>")], "cluster_id string, rank int, pool string")
    fired = spark.createDataFrame([("app:engage", NOW, 3, 5200)], "key string, tick timestamp, count bigint, first_ticket_id bigint")
    alerts = to_alerts(fired)
    proof = ev.alert_evidence(signals, seen).withColumn("cluster_id", F.lit(alerts.first().id))
    struct = proof.first().evidence
    assert struct.confidence == "likely" and struct.pools == ["North <Pool>"] and [s.elevated for s in struct.signals] == [True, True]
    assert '"confidence":"likely"' in proof.select(ev.evidence_json(F.col("evidence"))).first()[0]
    t = spark.createDataFrame([("app:engage", 5200 + i, before(30 - i), f" a<b>\n{i}", "engage/engage till") for i in range(3)],
                              "key string, id bigint, created_at timestamp, subject string, system_key string")
    listed = digest.alert_tickets(alerts, t)
    note = digest.compose_digest(alerts, listed, proof).first().note
    assert "#5200" in note and "#5202" in note and "a&lt;b&gt; 0" in note and "Engage (app:engage)" in note
    assert "<li>[effect] <b>vdi.error</b> @ horizon: 10 events (prior window 3) *</li>" in note
    assert "<li>[cause] <b>vdi.push</b> @ horizon: 1 event</li>" in note and "North &lt;Pool&gt;" in note
    bare = digest.compose_digest(alerts, listed).first().note
    assert "Corroborators" not in bare and "engage/engage till" in bare
    parts = digest.compose_digest(alerts, digest.alert_tickets(alerts, t, note_tickets=2)).orderBy("part").collect()
    assert len(parts) == 2 and "#5202" in parts[1].note and "#5202" not in parts[0].note
    box = digest.alert_outbox(alerts, digest.compose_digest(alerts, listed)).first()
    assert (box.label, box["count"], box.first_ticket_id, box.parts) == ("Engage", 3, 5200, 1) and box.note == bare
    cut = digest.alert_tickets(alerts, t, note_tickets=2)
    boxes = digest.alert_outbox(alerts, digest.compose_digest(alerts, cut)).collect()
    assert [b.parts for b in boxes] == [2]
    assert [(r.ticket_id, r.part) for r in digest.outbox_tickets(cut).orderBy("rank").collect()] == [(5200, 0), (5201, 0), (5202, 1)]


def test_default_catalogue_of_rules_is_consistent():
    assert {r.weight for r in D.CLUSTER_RULES} == {90, 80, 70, 60, 50, 40}
    assert {m.flavour for m in D.METRICS} == set(D.METRIC_WORDS)


# --- joins that must hold for long names, many pools, hot days and long changes ---
def test_contains_pairs_against_brute_force(spark):
    rng = random.Random(6)
    letters = "ab é-1"
    names = [(i, "".join(rng.choices(letters, k=rng.randrange(0, 12)))) for i in range(150)] + [(900, None), (901, "")]
    long_name = "".join(rng.choices("xyz ", k=10_000)) + "needle"
    names.append((999, long_name))
    hints = ["".join(rng.choices(letters, k=n)) for n in (1, 1, 2, 2, 2, 3, 3, 3, 4, 4, 5) for _ in range(4)] + ["needle", "", None, "zz", "absent here"]
    n = spark.createDataFrame(names, "ord int, t string")
    h = spark.createDataFrame([(x,) for x in hints], "hint string")
    got = sorted((r.hint, r.ord) for r in contains.contains_pairs(h, "hint", n, "t", "ord").collect())
    assert got == sorted({(x, i) for x in hints if x for i, t in names if t and x in t})


def test_resolve_pool_in_a_long_name(spark, cluster):
    stock = spark.createDataFrame([(1, "other", "p" * 10_000 + "KIO4" + "q" * 9_000, 3), (2, "kio4-late", None, 5)], "ord int, name string, display_name string, error_count int")
    hinted = cluster.withColumn("pool_hint", F.lit("Kio4"))
    assert ev.resolve_pool(hinted, stock).first().pool == "other"
    assert ev.pool_error_signal(hinted, stock).first()["count"] == 8
    assert ev.resolve_pool(hinted.withColumn("pool_hint", F.lit("q")), stock).first().pool == "other"


def test_signal_predicates_compare_their_own_field(spark, cluster):
    events = logs(spark, ("CLONE", 2, 30, "a"), ("PUSH", 3, 30, "CLONE"))
    rows = [("e", "effect", "horizon", "EventType", "CLONE"), ("e", "effect", "horizon", "DesktopId", "a"),
            ("d", "effect", "horizon", "DesktopId", "CLONE"), ("n", "cause", "horizon", "Nowhere", "CLONE")]
    by_field = spark.createDataFrame(rows, "key string, role string, stream string, field string, value string")
    counts = lambda: {r.signal_key: r["count"] for r in ev.signal_counts(events, cluster, by_field).collect()}
    # an event that meets two predicates of a signal counts once; another field is no match
    assert counts() == {"e": 2, "d": 3, "n": 0}
    kept, ev.CATALOG_ROWS = ev.CATALOG_ROWS, 1
    try:
        assert counts() == {"e": 2, "d": 3, "n": 0}
    finally:
        ev.CATALOG_ROWS = kept


def test_dyadic_nodes(spark):
    rng = random.Random(3)
    spans = [(lo, lo + rng.choice([0, 1, 2, 5, 40, 1000])) for lo in [rng.randrange(-300, 300) for _ in range(60)]]
    df = spark.createDataFrame(spans, "lo long, hi long").select("lo", "hi", intervals.cover(F.col("lo"), F.col("hi"), 12).alias("nodes"))
    for r in df.collect():
        cells = [c for n in r.nodes for c in range(n.node << n.level, (n.node + 1) << n.level)]
        assert sorted(cells) == list(range(r.lo, r.hi + 1)) and len(r.nodes) <= 2 * 11
    up = spark.createDataFrame([(-5,), (0,), (77,)], "c long").select("c", intervals.above(F.col("c"), 4).alias("n")).collect()
    assert all([(n.level, n.node) for n in r.n] == [(k, r.c >> k) for k in range(5)] for r in up)


def counted(spark, column):
    """``column`` as it is, and an accumulator of how often it was made."""
    made = spark.sparkContext.accumulator(0)

    def plain(value):
        made.add(1)
        return value

    return F.udf(plain, "string")(column), made


def test_changes_and_clusters_are_read_once(spark):
    changes = spark.createDataFrame(
        [(i, f"1995-01-{1 + i % 20:02d}T00:00:00Z", f"1995-01-{3 + i % 20:02d}T00:00:00Z") for i in range(200)],
        "id bigint, planned_start_date string, planned_end_date string",
    )
    subject, subjects = counted(spark, F.concat(F.lit("s"), F.col("id").cast("string")))
    changes = changes.withColumns({"updated_at": F.col("planned_start_date"), "subject": subject})
    clusters = spark.createDataFrame([(f"{d}", f"1995-01-{d:02d} 00:00:00") for d in range(1, 25)], "day string, at string")
    name, names = counted(spark, F.concat(F.lit("c"), F.col("day")))
    start = F.col("at").cast("timestamp")
    clusters = clusters.select(
        name.alias("cluster_id"), start.alias("window_start"), (start + F.expr("interval 1 hour")).alias("window_end")
    )
    pairs = ev.change_overlap(clusters, ev.parsed_changes(changes))
    rows = pairs.select("cluster_id", "id", "subject").collect()
    assert len(rows) == 600 and all(r.subject == f"s{r.id}" for r in rows)
    assert (subjects.value, names.value) == (200, 24)


def test_corroborate_makes_its_clusters_once(spark):
    clusters = spark.createDataFrame([(d, f"1995-01-{d:02d} 00:00:00") for d in range(1, 9)], "day int, at string")
    name, names = counted(spark, F.concat(F.lit("c"), F.col("day").cast("string")))
    start = F.col("at").cast("timestamp")
    clusters = clusters.select(
        name.alias("cluster_id"), F.lit("vpn").alias("key"), start.alias("window_start"),
        (start + F.expr("interval 1 hour")).alias("window_end"),
    )
    logs = spark.createDataFrame([("vpn", "Error", "1995-01-02 00:10:00")], "app string, level string, at string")
    logs = logs.select("app", "level", F.col("at").cast("timestamp").alias("timestamp"))
    pages = spark.createDataFrame([("v", "<p>ok</p>")], "vendor string, html string")
    found = ev.corroborate(clusters, app_logs=logs, app="vpn", pages=pages).select("cluster_id").collect()
    assert sorted(r.cluster_id for r in found) == [f"c{d}" for d in range(1, 9)] and names.value == 8


def test_change_overlap_against_brute_force(spark, monkeypatch):
    rng = random.Random(7)
    hour = timedelta(hours=1)
    windows = [(t, t + rng.choice([timedelta(0), hour, 30 * hour])) for t in [NOW - rng.randrange(0, 4000) * hour / 3 for _ in range(25)]]
    plans = [(t, t + rng.choice([timedelta(0), hour / 7, 5 * hour, 3000 * hour])) for t in [NOW - rng.randrange(0, 5000) * hour / 3 for _ in range(60)]]
    plans += [(NOW - 87_660 * hour, NOW), (windows[0][0], windows[0][0]), (windows[1][1], windows[1][1] + hour), (NOW, NOW - hour)]
    c = spark.createDataFrame([(f"c{i}", a, b) for i, (a, b) in enumerate(windows)], "cluster_id string, window_start timestamp, window_end timestamp")
    rows = [(i, a, b, NOW - rng.randrange(0, 2000) * hour) for i, (a, b) in enumerate(plans)] + [(500, None, None, NOW), (501, NOW, None, NOW)]
    ch = spark.createDataFrame(rows, "id int, start timestamp, end timestamp, updated timestamp")
    want = sorted((f"c{i}", j) for i, (a, b) in enumerate(windows) for j, s, e, u in rows
                  if s and e and s <= e and s <= b and e >= a and u >= a - 72 * hour)
    for tile in (20_000, 3):
        monkeypatch.setattr(intervals.stab, "__defaults__", (tile,))
        got = sorted((r.cluster_id, r.id) for r in ev.change_overlap(c, ch).collect())
        assert got == want and len(want) > 50
    anyhow = sorted((r.cluster_id, r.id) for r in ev.change_overlap(c, ch, require_overlap=False).collect())
    assert anyhow == sorted((f"c{i}", j) for i, (a, b) in enumerate(windows) for j, s, e, u in rows if u >= a - 72 * hour)


def test_hot_day_of_changes(spark, cluster):
    minute = "timestampadd(SECOND, cast(id % 3600 as int), timestamp'2025-03-19 11:00:00')"
    many = spark.range(100_000).selectExpr("id", f"{minute} start", f"{minute} end", "timestamp'2025-03-19 08:00:00' updated")
    assert ev.change_overlap(cluster, many).count() == 100_000
    late = cluster.withColumn("window_end", F.col("window_start"))
    assert ev.change_overlap(late, many).count() == 28


def test_pool_counts_meet_active_pools_only(spark, catalog):
    quiet = [("CLONE", 1, 60 * 24 * 30 + i, f"p{i}") for i in range(3000)]
    events = logs(spark, *quiet, ("CLONE", 4, 30, "p1"), ("PUSH", 2, 300, "p7"))
    clusters = spark.createDataFrame([(f"c{i}", "k", before(60), NOW) for i in range(20)], "cluster_id string, key string, window_start timestamp, window_end timestamp")
    seen = []
    counts = ordered.range_counts
    try:
        ordered.range_counts = lambda e, p, *a, **k: seen.append(p) or counts(e, p, *a, **k)
        got = ev.pool_counts(events, clusters, catalog).collect()
    finally:
        ordered.range_counts = counts
    assert {(r.cluster_id, r.name, r.n) for r in got} == {(f"c{i}", p, n) for i in range(20) for p, n in (("p1", 4), ("p7", 2))}
    assert seen[0].count() == 40  # not 20 clusters by 3,000 pools


def test_version_intervals_against_brute_force(spark):
    rng = random.Random(5)
    stamp = lambda t: t.strftime("%a, %d %b %Y %H:%M:%S GMT")
    rows = []
    for app in ("Kiosk prod", "Kiosk lab", "Other Prod"):
        at = NOW - timedelta(hours=900)
        for _ in range(25):
            at += timedelta(hours=rng.choice([0, 1, 30, 60]))
            rows.append((app, at, rng.choice([stamp(at - timedelta(hours=rng.choice([0, 99, 100, 150]))), "bad date", None]), rng.choice(["1", "2"])))
    ends = [NOW - timedelta(hours=rng.randrange(0, 1000)) for _ in range(40)] + [rows[5][1], rows[5][1] - timedelta(seconds=1)]
    snap = spark.createDataFrame(rows, "app string, observed_at timestamp, last_modified string, version string")
    c = spark.createDataFrame([(f"c{i}", "app:kiosk", e, e) for i, e in enumerate(ends)], "cluster_id string, key string, window_start timestamp, window_end timestamp")

    def brute(end):
        n = 0
        for app in {r[0] for r in rows}:
            mine = sorted((r[1], f"{r[3]}|{r[2] or 'None'}", r[2]) for r in rows if r[0] == app)
            upto = [k for k, r in enumerate(mine) if r[0] <= end]
            if not upto:
                continue
            k = upto[-1]
            changed = k > 0 and mine[k][1] != mine[k - 1][1]
            text = mine[k][2]
            recent = text not in (None, "bad date") and end - datetime.strptime(text, "%a, %d %b %Y %H:%M:%S GMT") <= timedelta(hours=100)
            n += changed or ("prod" in app.lower() and recent)
        return n

    got = {r.cluster_id: r["count"] for r in ev.version_change_signal(c, snap, "kiosk").collect()}
    want = {f"c{i}": n for i, e in enumerate(ends) if (n := brute(e))}
    assert got == want and len(set(want.values())) > 1
