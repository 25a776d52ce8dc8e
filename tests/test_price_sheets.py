from __future__ import annotations

import tempfile

from pyspark.sql import functions as F

from tallyspark.fixed_values import USAGE_LIMIT_ID
from tallyspark.sources.manifest import manifest_diff
from tallyspark.sources.price_sheets import load_current_prices, parse_price_sheets, save_prices
from tallyspark.sources.responses import parse_accounts, parse_rate_limits

HEAD = (
    "| Model | Short context input | Short context cached input | Short context cache writes | Short context output "
    "| Long context input | Long context cached input | Long context cache writes | Long context output |"
)
RULE = "|" + " --- |" * 9
THRESHOLD = "Short context: ≤272K input tokens. Long context: >272K input tokens."


def table(tier, scale):
    s = scale
    return [
        f"### {tier} pricing data",
        "",
        HEAD,
        RULE,
        f"| `alpha` | ${1 * s}.00 | ${s}.50 | - | ${8 * s} | - | - | - | - |",
        f"| beta (≤272K context length) | ${2 * s} | - | - | ${9 * s} | - | - | - | - |",
        f"| gamma | $2,000.00 | $1 | - | $3 | $4,000 | - | - | $6 |",
    ]


def sheet(edit=lambda lines: lines):
    lines = ["# Pricing", "## Flagship models", "Prices per 1M tokens.", THRESHOLD]
    for tier, scale in (("Standard", 1), ("Fast", 2), ("Ultrafast", 4)):
        lines += table(tier, scale)
    lines += [
        "### Batch pricing data", "| broken | table", "",
        "## Cyber models", "Prices per 1M tokens.", HEAD, RULE, "| cyber-x | $1 | $1 | - | $1 | - | - | - | - |",
        "## Specialized models", "Prices per 1M tokens.", "### Standard",
        "| Category | Model | Input | Cached input | Output | More |", "| - | :-: | - | - | - | - |",
        "| Search | delta | $5 | - | $6 | x |", "| Embedding | not a model! | ? | ? | ? | ? |",
        "## Image generation models", "| Model | Price |", "| - | - |", "| z | free |",
    ]
    return "\n".join(edit(lines))


def swap(old, new):
    return lambda lines: [new if line == old else line for line in lines]


def replace(old, new):
    return lambda lines: [line.replace(old, new) for line in lines]


def test_sound_sheet_and_rejects(spark):
    variants = {
        "good": sheet(),
        "crlf": sheet().replace("\n", "\r\n"),
        "reordered": sheet(lambda ls: [
            "|" + "|".join(reversed(x.strip("|").split("|"))) + "|" if x.count("|") == 10 else x for x in ls]),
        "same twice": sheet(lambda ls: [y for x in ls for y in ([x, x] if "alpha" in x else [x])]),
        "wrong unit": sheet(replace("Prices per 1M tokens.", "Prices per 1K tokens.")),
        "wrong threshold": sheet(replace("≤272K", "≤200K")),
        "no threshold": sheet(replace("Short context: ", "")),
        "missing column": sheet(replace("Long context output", "Other")),
        "extra cell": sheet(lambda ls: [x + " y |" if "gamma" in x else x for x in ls]),
        "negative": sheet(replace("$2,000.00", "$-2")),
        "nan": sheet(replace("$2,000.00", "$NaN")),
        "no dollar": sheet(replace("$2,000.00", "2000")),
        "conflict": sheet(lambda ls: [y for x in ls for y in ([x, x.replace("$8", "$7")] if "alpha" in x else [x])]),
        "bad separator": sheet(swap(RULE, RULE.replace("---", "x--", 1))),
        "no fast": sheet(lambda ls: [x for x in ls if x != "### Fast pricing data"][:9] + ls[-3:]),
        "bad model": sheet(replace("gamma", "gam ma")),
        "repeated column": sheet(replace("Short context cache writes", "Short context input")),
    }
    sheets = spark.createDataFrame([(k, v) for k, v in variants.items()], "sheet_id string, text string")
    prices, faults = parse_price_sheets(sheets)
    rejected = {r.sheet_id for r in faults.select("sheet_id").distinct().collect()}
    assert rejected == set(variants) - {"good", "crlf", "reordered", "same twice"}
    rows = {(r.sheet_id, r.model, r.tier): r for r in prices.collect()}
    assert {k[0] for k in rows} == {"good", "crlf", "reordered", "same twice"}
    for name in ("good", "crlf", "reordered", "same twice"):
        alpha = rows[name, "alpha", "standard"]
        assert (alpha.is_split, tuple(alpha.short), alpha.long) == (False, (1.0, 1.5, 8.0), None)
        beta = rows[name, "beta", "fast"]
        assert (beta.is_split, tuple(beta.short), beta.long) == (True, (4.0, None, 18.0), None)
        gamma = rows[name, "gamma", "ultrafast"]
        assert (gamma.is_split, tuple(gamma.short), tuple(gamma.long)) == (True, (2000.0, 1.0, 3.0), (4000.0, None, 6.0))
        assert tuple(rows[name, "cyber-x", "standard"].short) == (1.0, 1.0, 1.0)
        assert tuple(rows[name, "delta", "standard"].short) == (5.0, None, 6.0)
        assert len([k for k in rows if k[0] == name]) == 11


def test_snapshot_store_keeps_newest_sound(spark):
    target = tempfile.mkdtemp(prefix="tally-prices-")
    sheets = spark.createDataFrame([("a", sheet()), ("b", sheet(replace("$8", "$80")))], "sheet_id string, text string")
    prices, _ = parse_price_sheets(sheets)
    when = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "sheet_id string, effective_at int")
    save_prices(prices, when, target)
    spoiled = prices.where("sheet_id = 'b'").withColumn("sheet_id", F.lit("c")).withColumn(
        "short", F.struct(F.lit(-1.0).alias("input"), F.col("short.cached_input"), F.col("short.output"))
    )
    save_prices(spoiled, when, target)
    current = load_current_prices(spark, target)
    assert current.where("model = 'alpha' and tier = 'standard'").collect()[0].short.output == 80.0


def test_rate_limit_responses(spark):
    import json

    def w(percent=1.0, minutes=300, resets=100):
        return {"usedPercent": percent, "windowDurationMins": minutes, "resetsAt": resets}

    bucket = {"limitId": USAGE_LIMIT_ID, "primary": w(), "secondary": w(2.0, 10080, 200), "unknownFutureField": {"x": 1}}
    general = {"limitId": "other", "primary": w(9.0)}
    bodies = {
        "by id": {"rateLimits": general, "rateLimitsByLimitId": {USAGE_LIMIT_ID: bucket}},
        "general": {"rateLimits": general, "rateLimitsByLimitId": {"x": general}},
        "null general": {"rateLimits": None, "rateLimitsByLimitId": {USAGE_LIMIT_ID: bucket}},
        "nothing": {},
        "no primary": {"rateLimits": {"limitId": "a"}},
        "negative": {"rateLimits": {"limitId": "a", "primary": w(resets=-1)}},
        "negative second": {"rateLimits": {"limitId": "a", "primary": w(), "secondary": w(resets=-1)}},
        "text percent": {"rateLimits": {"limitId": "a", "primary": {**w(), "usedPercent": "x"}}},
    }
    rows = spark.createDataFrame(
        [(k, None, 5, json.dumps(v)) for k, v in bodies.items()], "home string, account_id string, received_nanos bigint, body string"
    )
    snapshots, rejects = parse_rate_limits(rows)
    got = {r.home: (r.limit_id, r.primary.used_percent, r.secondary and r.secondary.window_minutes) for r in snapshots.collect()}
    assert got == {"by id": (USAGE_LIMIT_ID, 1.0, 10080), "general": ("other", 9.0, None), "null general": (USAGE_LIMIT_ID, 1.0, 10080)}
    assert {r.home: r.reason for r in rejects.collect()} == {
        "nothing": "no bucket", "no primary": "no primary window", "negative": "negative reset",
        "negative second": "negative reset", "text percent": "malformed",
    }
    plans = spark.createDataFrame(
        [("a", 1, '{"account": {"planType": "plus", "x": 1}}'), ("b", 1, '{"account": null}'), ("c", 1, "oops")],
        "home string, received_nanos bigint, body string",
    )
    assert {r.home: r.plan_type for r in parse_accounts(plans).collect()} == {"a": "plus", "b": None}


def test_bodies_are_parsed_once(spark):
    """Conditions on a parsed body read its fields; none of them parses the text again."""
    rows = spark.range(1).selectExpr("'a' as home", "'b' as account_id", "id as received_nanos", "concat('{', id, '}') as body")
    for parsed in (*parse_rate_limits(rows), parse_accounts(rows)):
        assert parsed._jdf.queryExecution().optimizedPlan().toString().count("from_json(") == 1


def test_manifest_diff(spark):
    schema = "home string, path string, identity string, length bigint, consumed bigint, modified_at bigint"
    old = spark.createDataFrame(
        [("h", "same", "1", 10, 10, 1), ("h", "more", "2", 10, 8, 1), ("h", "cut", "3", 10, 10, 1), ("h", "touched", "4", 10, 10, 1),
         ("h", "from", "5", 10, 9, 1), ("h", "gone", "6", 10, 10, 1), ("h", "swap", "7", 10, 10, 1)], schema)
    new = spark.createDataFrame(
        [("h", "same", "1", 10, None, 1), ("h", "more", "2", 12, None, 2), ("h", "cut", "3", 9, None, 2), ("h", "touched", "4", 10, None, 2),
         ("h", "to", "5", 10, None, 5), ("h", "fresh", "8", 1, None, 1), ("h", "swap", "9", 20, None, 1)], schema)
    got = {r.path: (r.change, r.moved_from, r.resume_at) for r in manifest_diff(new, old).collect()}
    assert got == {
        "same": ("unchanged", None, None), "more": ("appended", None, 8), "cut": ("rewritten", None, 0), "touched": ("rewritten", None, 0),
        "to": ("renamed", "from", 9), "from": ("moved away", None, None), "gone": ("deleted", None, None), "fresh": ("new", None, 0),
        "swap": ("rewritten", None, 0),
    }


def test_sheets_are_scanned_once(spark):
    """The checks read stored rows; none of them sorts the lines of all sheets again."""
    sheets = spark.createDataFrame([("a", "nothing here")], "sheet_id string, text string")
    _, faults = parse_price_sheets(sheets)
    assert "Window" not in faults._jdf.queryExecution().optimizedPlan().toString()
    assert {r["fault"] for r in faults.collect()} == {"missing main table", "context threshold"}
