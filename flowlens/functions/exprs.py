"""Column expressions with the engine's exact arithmetic."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, functions as F

HOUR = 3_600_000
I64_MIN, I64_MAX = -(2**63), 2**63 - 1


def hour_start(ms: Column) -> Column:
    """Start of the hour, rounded toward minus infinity."""
    return ms - F.pmod(ms, F.lit(HOUR))


def shown_available_at() -> Column:
    """0 stands for "since it was created"."""
    return F.when(F.col("available_at") == 0, F.col("created_at")).otherwise(F.col("available_at"))


def live_lease(now: int) -> Column:
    return F.col("lease_expires_at") > F.lit(now)


def expired_lease(now: int) -> Column:
    """Also without an expiry: an activity's lease must have one."""
    return (F.col("lease_expires_at") <= F.lit(now)) | F.col("lease_expires_at").isNull()


def stale_lease(now: int, after: int) -> Column:
    return expired_lease(max(now - after, I64_MIN))


def effective_approval_status(now: int) -> Column:
    """A pending approval past its expiry counts as expired before anyone marks it."""
    due = (F.col("status") == "pending") & (F.col("expires_at") <= F.lit(now))
    return F.when(F.coalesce(due, F.lit(False)), F.lit("expired")).otherwise(F.col("status"))


def byte_length(column: str) -> Column:
    return F.octet_length(column).cast("long")


def json_summary(column: str) -> Column:
    """Whether a document is present, and its bytes; the body itself stays out of lists."""
    return F.struct(F.col(column).isNotNull().alias("present"), F.coalesce(byte_length(column), F.lit(0).cast("long")).alias("bytes"))


def truncate_bytes(text: Column, most: int) -> Column:
    """The longest beginning of ``text`` of at most ``most`` bytes in UTF-8 that ends between characters."""
    raw = text.cast("binary")
    # A byte of the form 10xxxxxx right behind the cut means that it fell inside a character, which has at most four bytes.
    inside = lambda k: F.hex(F.substring(raw, k + 1, 1)).between("80", "BF")
    cut = F.lit(most)
    for back in (3, 2, 1):
        all_inside = F.lit(True)
        for k in range(most, most - back, -1):
            all_inside = all_inside & inside(k)
        cut = F.when(all_inside & (cut == most), F.lit(most - back)).otherwise(cut) if most >= back else cut
    return F.when(F.octet_length(text) <= most, text).otherwise(F.decode(F.substring(raw, F.lit(1), F.greatest(cut, F.lit(0))), "UTF-8"))


def valid_topic_key(column: Column) -> Column:
    """A lower-case letter or digit, then these, ``.``, ``_`` and ``-`` in any order."""
    return F.coalesce(column.rlike(r"\A[a-z0-9][a-z0-9._-]*\z"), F.lit(False))


def valid_schedule_key(column: Column, most_bytes: int = 191) -> Column:
    """Lower-case letters and digits with single ``_`` between, of bounded length."""
    return F.coalesce(column.rlike(r"\A[a-z0-9]+(_[a-z0-9]+)*\z") & (F.octet_length(column) <= most_bytes), F.lit(False))


def tie_breaker(rank: int, *parts: str) -> Column:
    return F.concat_ws(":", F.lit(str(rank)), *[F.lpad(F.col(p).cast("string"), 20, "0") for p in parts])


def child_key(parent: Column, command: Column) -> Column:
    return F.concat_ws(":", F.lit("child"), parent.cast("string"), command.cast("string"))


def step_key(workflow: Column, step: Column) -> Column:
    return F.concat(F.lit("wf:"), workflow.cast("string"), F.lit(":step:"), step.cast("string"))


def correction_key(root: Column, number: Column) -> Column:
    return F.concat(F.lit("durable:activity:"), root.cast("string"), F.lit(":correction:"), number.cast("string"))


def jitter_percentile(seed: Column) -> Column:
    """0 to 100: the first two bytes of the seed's SHA-256, little endian, modulo 101."""
    h = F.sha2(seed, 256)
    byte = lambda k: F.conv(F.substring(h, k, 2), 16, 10).cast("long")
    return (byte(3) * 256 + byte(1)) % 101


#: The longest delay of a retry policy in seconds; a hundred per cent more still fits into milliseconds.
MOST_DELAY = I64_MAX // 2_000


def retry_policy(policy_json: Column) -> Column:
    """A stored policy as ``fixed, initial, most, percent`` in seconds; null where it is unreadable or out of bounds."""

    def number(path):
        text = F.get_json_object(policy_json, f"$.backoff.{path}")
        return F.when(text.rlike(r"\A[0-9]{1,20}\z"), text.cast("decimal(20,0)"))

    fixed, initial, most, percent = number("Fixed.delay_secs"), number("Exponential.initial_secs"), number("Exponential.max_secs"), number("Exponential.jitter_percent")
    valid = fixed.between(1, MOST_DELAY) | ((initial >= 1) & (most >= initial) & (most <= MOST_DELAY) & (percent <= 100))
    return F.when(valid, F.struct(fixed.cast("long").alias("fixed"), initial.cast("long").alias("initial"), most.cast("long").alias("most"), percent.cast("long").alias("percent")))


def backoff(policy_json: Column, attempt: Column, seed: Column) -> Column:
    """Milliseconds to wait after failed attempt ``attempt`` (from 1); null if the policy is not valid.

    ``Fixed`` waits ``delay_secs``. ``Exponential`` waits ``initial_secs`` doubled for each further attempt, at most
    ``max_secs``, give or take ``jitter_percent``: of that share of the delay in whole seconds, a seed at percentile p
    adds 2p - 100 hundredths, rounded toward zero. All products are of whole numbers that fit.
    """
    policy = retry_policy(policy_json)
    div = lambda a, b: F.call_function("div", a, F.lit(b).cast("long"))
    # 2^62 is beyond any bound already.
    times = F.call_function("shiftleft", F.lit(1).cast("long"), F.least(F.greatest(attempt - 1, F.lit(0)), F.lit(62)).cast("int"))
    base = F.least(policy["initial"].cast("decimal(19,0)") * times.cast("decimal(19,0)"), policy["most"].cast("decimal(38,0)")).cast("long")
    spread = div(base * policy["percent"], 100)
    jittered = F.greatest(base + div(spread * (2 * jitter_percentile(seed) - 100), 100), F.lit(0))
    return F.when(policy.isNotNull(), F.coalesce(policy["fixed"], jittered) * 1000)


def fnv1a(data: bytes) -> str:
    """64-bit FNV-1a as 16 hexadecimal digits."""
    h = 0xCBF29CE484222325
    for b in data:
        h = ((h ^ b) * 0x100000001B3) % 2**64
    return f"{h:016x}"


def sha256_hex(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
