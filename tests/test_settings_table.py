"""Settings with versions: what held when, for whom."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from gristmill.operators.pipelines import analyze_prompts
from gristmill.operators.settings import as_of, by_row, versions

SCHEMA = "tenant string, valid_from int, block_threshold int, redact_threshold int, user_role string"


def plain(changes, tenant, at):
    block, redact, role = 75, 45, "engineering"
    times = sorted({c[1] for c in changes if c[0] == tenant and c[1] <= at})
    out = (block, redact, role)
    for t in times:
        here = [c for c in changes if c[0] == tenant and c[1] == t]
        new = [max((c[k] for c in here if c[k] is not None), default=None) for k in (2, 3, 4)]
        block, redact, role = (n if n is not None else o for n, o in zip(new, (block, redact, role), strict=True))
        b, r = block, redact
        if r > b:
            b, r = (b, b) if new[0] is not None else (r, r)
        out = (b, r, role)
    return out


def test_as_of_equals_the_plain_way(spark):
    r = random.Random(2)
    pick = lambda *xs: r.choice(xs)
    changes = [(pick("a", "b", None), r.randrange(40), pick(None, 50, 60, 90), pick(None, 20, 55, 80), pick(None, "hr", "finance")) for _ in range(60)]
    sent = [(k, pick("a", "b", "c", None), r.randrange(-3, 45)) for k in range(300)]
    rows, subs = spark.createDataFrame(changes, SCHEMA), spark.createDataFrame(sent, "id long, tenant string, ts int").withColumn("user_role", F.lit("clash"))
    for few in (100_000, 0):
        got = {x.id: (x.block_threshold, x.redact_threshold, x.user_role) for x in as_of(subs, rows, few=few).collect()}
        assert got == {k: plain(changes, tenant, at) for k, tenant, at in sent}
    assert versions(rows.limit(0)).count() == 0 and as_of(subs, rows.limit(0)).filter("block_threshold = 75").count() == 300


def test_thresholds_by_row(spark):
    df = spark.createDataFrame([(1, "x a@b.com", 35, 20), (2, "x a@b.com", 75, 45), (3, "x a@b.com", 200, 200)], "id long, prompt_text string, block_threshold int, redact_threshold int")
    got = {x.id: x.action for x in analyze_prompts(df.withColumn("destination_domain", F.lit("chatgpt.com")), by_row()).collect()}
    assert got == {1: "block", 2: "redact", 3: "redact"}
