from __future__ import annotations

import random

from ticketmill.plans import queries
from ticketmill.sources import landed


def test_no_conversation_is_collected_whole(spark, tmp_path, monkeypatch):
    rows = [(1, t, ("system", "user", "assistant")[t % 3], f"text {t}") for t in range(1000)]
    rows += [(2, t, "user", None) for t in (-70, 5, 10**12)] + [(None, 0, None, "x"), (None, 3, "user", "y"), (3, None, "user", "late"), (3, 7, "user", "early")]
    random.Random(1).shuffle(rows)
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    sizes = []

    def watched(tickets, explode=landed.explode_conversations):
        sizes.append(tickets.selectExpr("max(size(conversations)) AS n").first().n)
        return explode(tickets)

    monkeypatch.setattr(landed, "explode_conversations", watched)
    out = queries.REGISTRY["explode_conversations"](spark, str(tmp_path))
    assert sizes == [64]
    assert dict(out.dtypes)["seq"] == "int" and dict(out.dtypes)["ticket_id"] == "bigint"
    want = []
    for conv in (1, 2, 3, None):
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is None, r[1]))
        want += [(conv, i, r and r == "system", r and r == "user", t) for i, (_, _, r, t) in enumerate(own)]
    assert sorted(map(tuple, out.collect()), key=repr) == sorted(want, key=repr)
