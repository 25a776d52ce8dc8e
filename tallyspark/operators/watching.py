"""The full alert rules over looks at accounts, as columns over carried values.

A look is what one observation saw: ``home, observed_nanos``, the reading that
was newest then (``received, account, limit`` and the flat windows
``primary_used, primary_seconds, primary_resets_at``, likewise ``secondary_``;
all NULL when there was none) and ``overflow_credits``, the credits spent beyond
the plan in the current period, or NULL. Other columns come along.

The same rules serve history and streams: what a home's looks leave behind is
one row (``state_after``), and a batch of later looks goes on from it
(``streaming.alerts``).

* Looks further apart than the blind limit leave a gap; nothing is reported for
  what happened in it.
* A reading is *leading* if it is not older than any before. Leading readings
  form runs: a run ends when the limit or a known account changes. The reset of
  a window is compared with the latest one that its run has seen for that
  window length, so a late record of an old period changes nothing.
* Windows that have been replaced by their successor, or that were given back
  early to the same signed-in account, are ``reset`` alerts; the first reading
  of a quota period at which credits flow, after one in the same stretch of
  watching at which they did not, is an ``overflow`` alert. A period has one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.fixed_values import (
    OVERFLOW_ALERT_CREDITS,
    RESET_DRIFT_SHARE,
    RESTORED_MAX_USED,
    RESTORED_MIN_DROP,
    SHORT_WINDOW_MAX_SECONDS,
)
from tallyspark.operators.alerts import ROLES, blind_gap_nanos
from tallyspark.operators.blocks import join_dimension, ordered_slices, running
from tallyspark.operators.quota import NANOS

ORDER = ("observed_nanos", "received", "place")
WINDOW = {"used": "double", "seconds": "bigint", "resets_at": "bigint"}
_WINDOW = f"struct<{','.join(f'{n}:{t}' for n, t in WINDOW.items())}>"
_READING = f"struct<received:bigint,account:string,limit:string,{','.join(f'{r}:{_WINDOW}' for r in ROLES)}>"
#: What the looks of a home leave behind: times, the period last looked at, the readings that later ones are
#: compared with, the latest reset of the present run for each window, and whether credits were seen to be unused.
STATE = (
    f"struct<seen:bigint,top:bigint,signed_top:bigint,look:struct<period:bigint>,lead:{_READING},sign:{_READING},account:string,"
    f"{','.join(f'last_{r}:bigint' for r in ROLES)},armed:boolean>"
)


def _windows(looks: DataFrame) -> DataFrame:
    """The shorter and the longer window of each reading; a single one by its length."""

    def window(side: str) -> Column:
        whole = F.struct(*[F.col(f"{side}_{n}").cast(t).alias(n) for n, t in WINDOW.items()])
        return F.when(F.col(f"{side}_seconds").isNotNull(), whole)

    first, second = window("primary"), window("secondary")
    is_short = F.col("primary_seconds") <= SHORT_WINDOW_MAX_SECONDS
    swapped = F.col("primary_seconds") > F.col("secondary_seconds")
    return looks.withColumns(
        {
            "short": F.when(second.isNull(), F.when(is_short, first)).when(swapped, second).otherwise(first),
            "long": F.when(second.isNull(), F.when(~is_short, first)).when(swapped, first).otherwise(second),
        }
    )


def _left(window: Column) -> Column:
    return F.least(F.lit(100.0), F.greatest(F.lit(0.0), 100.0 - window["used"]))


def _open(window: Column) -> Column:
    """The window exists and its reset is still to come."""
    return F.coalesce(window["resets_at"] * NANOS > F.col("observed_nanos"), F.lit(False))


def judge_looks(looks: DataFrame, refresh_seconds: int, state: DataFrame | None = None) -> DataFrame:
    """Looks with what came before each of them, in columns that begin with ``_``.

    ``state``: ``home, state`` as ``state_after`` returned it for earlier looks.
    """
    limit = blind_gap_nanos(refresh_seconds)
    no, home = F.lit(False), ["home"]
    flat = {f"{s}_{n}" for s in ("primary", "secondary") for n in WINDOW}
    extra = [c for c in looks.columns if c not in flat | {"home", "observed_nanos", "received", "account", "limit", "overflow_credits"}]
    # The last key only makes the order of equal looks a stable one.
    rows = _windows(looks).withColumn("place", F.xxhash64("account", "limit", *sorted(flat), "overflow_credits"))
    rows = ordered_slices(rows.select(*home, *ORDER, "account", "limit", "overflow_credits", *ROLES, *extra), home, ORDER)
    if state is None:
        rows = rows.withColumn("_state", F.lit(None).cast(STATE))
    else:
        rows = join_dimension(rows, state.select("home", F.col("state").cast(STATE).alias("_state")), home, ORDER)
    old = lambda name: F.col(f"_state.{name}")
    rows = running(
        rows, home, ORDER,
        {
            "_seen": ("last", F.col("observed_nanos"), False),
            "_top": ("max", F.col("received"), False),
            "_signed_top": ("max", F.when(F.col("account").isNotNull(), F.col("received")), False),
            "_look": ("last", F.struct(F.col("long.resets_at").alias("period")), False),
        },
    )
    rows = rows.withColumns(
        {
            "_seen": F.coalesce("_seen", old("seen")), "_top": F.greatest("_top", old("top")),
            "_signed_top": F.greatest("_signed_top", old("signed_top")), "_look": F.coalesce("_look", old("look")),
        }
    )
    leading = F.col("received").isNotNull() & F.coalesce(F.col("received") >= F.col("_top"), F.lit(True))
    signed = F.col("account").isNotNull() & F.coalesce(F.col("received") > F.col("_signed_top"), F.lit(True))
    rows = rows.withColumn("_leads", leading).withColumn("_signs", signed & F.col("received").isNotNull())
    rows = running(
        rows, home, ORDER,
        {
            "_lead": ("last", F.when(F.col("_leads"), _reading()), False),
            "_sign": ("last", F.when(F.col("_signs"), _reading()), False),
            "_account": ("last", F.when(F.col("_leads"), F.col("account")), False),
        },
    )
    rows = rows.withColumns({f"_{n}": F.coalesce(f"_{n}", old(n)) for n in ("lead", "sign", "account")})
    other = F.coalesce(F.col("account") != F.col("_account"), no)
    turn = F.coalesce(F.col("limit") != F.col("_lead.limit"), no) | other
    blind = F.coalesce(F.col("observed_nanos") - F.col("_seen") > limit, no)
    stale = F.coalesce(F.col("observed_nanos") - F.col("received") > limit, no)
    moved = ~F.col("long.resets_at").eqNullSafe(F.col("_look.period"))
    rows = rows.withColumns({"_other": other, "_blind": blind, "_stale": stale})
    count = lambda c: F.when(c, 1).otherwise(0).cast("bigint")
    steps = {f"_turn_{r}": count(F.col("_leads") & (turn | ~F.col(f"{r}.seconds").eqNullSafe(F.col(f"_lead.{r}.seconds")))) for r in ROLES}
    steps["_cut"] = count(F.col("_blind") | F.col("_stale") | moved)
    rows = rows.withColumns(steps)
    rows = running(rows, home, ORDER, {n.replace("_turn_", "_run_").replace("_cut", "_stretch"): ("sum", F.col(n), True) for n in steps})
    for role in ROLES:
        seen = F.when(F.col("_leads"), F.col(f"{role}.resets_at"))
        rows = running(rows, ["home", f"_run_{role}"], ORDER, {f"_last_{role}": ("max", seen, False)})
        # Until the first turn the run is the one that the state left.
        rows = rows.withColumn(f"_last_{role}", F.greatest(f"_last_{role}", F.when(F.col(f"_run_{role}") == 0, old(f"last_{role}"))))
    rows = running(rows, ["home", "_stretch"], ORDER, {"_armed": ("max", _low(), False)})
    return rows.withColumn("_armed", F.coalesce("_armed", no) | ((F.col("_stretch") == 0) & F.coalesce(old("armed"), no)))


def _reading() -> Column:
    return F.struct("received", "account", "limit", *ROLES).cast(_READING)


def _low() -> Column:
    """A fresh look at which hardly any credits were spent."""
    return ~F.col("_stale") & F.coalesce(F.col("overflow_credits") < OVERFLOW_ALERT_CREDITS, F.lit(False))


def state_after(rows: DataFrame) -> DataFrame:
    """``home, state`` after judged looks: one row for each home."""
    order, leads = F.struct(*ORDER), F.col("_leads")
    ends = rows.groupBy("home").agg(
        F.max_by("_state", order).alias("old"),
        F.max("observed_nanos").alias("seen"),
        F.max("received").alias("top"),
        F.max(F.when(F.col("account").isNotNull(), F.col("received"))).alias("signed_top"),
        F.max_by(F.struct(F.col("long.resets_at").alias("period")), order).alias("look"),
        F.max_by(_reading(), F.when(leads, order)).alias("lead"),
        F.max_by(_reading(), F.when(F.col("_signs"), order)).alias("sign"),
        F.max_by("account", F.when(leads & F.col("account").isNotNull(), order)).alias("account"),
        *[F.max(F.struct(F.col(f"_run_{r}").alias("run"), F.when(leads, F.col(f"{r}.resets_at")).alias("last"))).alias(r) for r in ROLES],
        F.max(F.struct(F.col("_stretch").alias("stretch"), _low().alias("low"))).alias("end"),
    )
    late = F.coalesce(F.col("old.seen") > F.col("seen"), F.lit(False))
    fields = {
        "seen": F.greatest("seen", "old.seen"), "top": F.greatest("top", "old.top"), "signed_top": F.greatest("signed_top", "old.signed_top"),
        "look": F.when(late, F.col("old.look")).otherwise(F.col("look")),
        **{n: F.coalesce(n, f"old.{n}") for n in ("lead", "sign", "account")},
        **{f"last_{r}": F.greatest(f"{r}.last", F.when(F.col(f"{r}.run") == 0, F.col(f"old.last_{r}"))) for r in ROLES},
        "armed": F.col("end.low") | ((F.col("end.stretch") == 0) & F.coalesce("old.armed", F.lit(False))),
    }
    return ends.select("home", F.struct(*[c.alias(n) for n, c in fields.items()]).cast(STATE).alias("state"))


def find_alerts(looks: DataFrame, refresh_seconds: int, resets: bool = True, overflow: bool = True) -> DataFrame:
    """``home, observed_nanos, kind, seconds, value`` and the look's other columns.

    A switched-off kind is found and used up, but not returned.
    """
    return alerts_in(judge_looks(looks, refresh_seconds), refresh_seconds, resets, overflow)[0]


def alerts_in(
    rows: DataFrame, refresh_seconds: int, resets: bool = True, overflow: bool = True, fired: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """Alerts of judged looks, and the quota periods (``home, period``) whose overflow alert they used up.

    ``fired``: periods that have had theirs.
    """
    limit, no = blind_gap_nanos(refresh_seconds), F.lit(False)
    own = {"home", *ORDER, "account", "limit", "overflow_credits", *ROLES, "block"}
    extra = [c for c in rows.columns if c not in own and not c.startswith("_")]

    def follows(new: Column, seconds: Column, resets_at: Column) -> Column:
        return (new["seconds"] == seconds) & (F.abs(new["resets_at"] - resets_at - seconds) <= seconds * RESET_DRIFT_SHARE)

    def continuous(earlier: str) -> Column:
        since = F.col("received") - F.col(f"{earlier}.received")
        age = F.col("observed_nanos") - F.col("received")
        return (F.col("limit") == F.col(f"{earlier}.limit")) & (since > 0) & (since <= limit) & (age >= 0) & (age <= limit)

    used_up = no
    for role in ROLES:
        used_up = used_up | F.coalesce(_open(F.col(role)) & (_left(F.col(role)) <= 0), no)
    watching = ~F.col("_blind") & ~used_up
    entries = []
    for role in ROLES:
        new, old = F.col(role), F.col(f"_sign.{role}")
        replaced = watching & continuous("_lead") & ~F.col("_other") & follows(new, F.col(f"_lead.{role}.seconds"), F.col(f"_last_{role}"))
        given_back = (
            watching & continuous("_sign") & (F.col("account") == F.col("_sign.account"))
            & (new["seconds"] == old["seconds"]) & ~follows(new, old["seconds"], old["resets_at"]) & _open(new)
            & old["used"].between(0.0, 100.0) & new["used"].between(0.0, RESTORED_MAX_USED)
            & (old["used"] - new["used"] >= RESTORED_MIN_DROP) & (new["resets_at"] >= old["resets_at"])
        )
        hit = F.coalesce(replaced, no) | F.coalesce(given_back, no)
        entries.append(F.struct(hit.alias("hit"), new["seconds"].alias("seconds"), _left(new).alias("value")))
    out = ["home", "observed_nanos", *extra]
    found = rows.select(*out, F.explode(F.filter(F.array(*entries), lambda e: e["hit"])).alias("_e"))
    found = found.select(*out, F.lit("reset").alias("kind"), "_e.seconds", "_e.value")

    credits = F.col("overflow_credits")
    firing = rows.where(~F.col("_stale") & (credits >= OVERFLOW_ALERT_CREDITS) & F.col("_armed") & F.col("long").isNotNull())
    first = firing.groupBy("home", F.col("long.resets_at").alias("period")).agg(
        F.min_by(F.struct(*out[1:], "long", "overflow_credits"), F.struct(*ORDER)).alias("_f")
    )
    if fired is not None:
        # Periods without a reset are one period too.
        again = fired.select(F.col("home").alias("_home"), F.col("period").alias("_period"))
        first = first.join(again, (F.col("home") == F.col("_home")) & F.col("period").eqNullSafe(F.col("_period")), "left_anti")
    spent = first.select("home", "_f.*").select(*out, F.lit("overflow").alias("kind"), "long.seconds", F.col("overflow_credits").alias("value"))
    return found.where(F.lit(resets)).unionByName(spent.where(F.lit(overflow))), first.select("home", "period")
