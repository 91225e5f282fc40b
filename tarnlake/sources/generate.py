"""Synthetic lending data whose values depend on keys alone, however rows are partitioned."""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnlake.functions.columns import band, stable_share

# The chance that a due date is missed, by risk band; that a delinquent loan cures, by depth; that it is
# restructured (30 days or more), charged off (90 days or more), and settled after that, in each cycle; rates of disorder in payments.
MISS = {"R1": 0.010, "R2": 0.018, "R3": 0.028, "R4": 0.045, "R5": 0.075, "R6": 0.110, "R7": 0.160}
CURE, RESTRUCTURE, CHARGE_OFF, SETTLED = (0.55, 0.35, 0.20, 0.08), 0.06, 0.35, 0.30
DUPLICATE, REVERSAL, NSF, LATE, CORRUPT = 0.01, 0.02, 0.015, 0.04, 0.003
# Risk bands with their scores and shares; daily contacts by depth; channels, outcomes and their shares.
BANDS = (("R1", 780, 850, 0.14), ("R2", 740, 779, 0.18), ("R3", 700, 739, 0.22), ("R4", 660, 699, 0.20), ("R5", 620, 659, 0.15), ("R6", 580, 619, 0.08), ("R7", 300, 579, 0.03))
CONTACTED = {1: 0.09, 2: 0.16, 3: 0.22, 4: 0.28, 5: 0.10}
CHANNELS = (("OUTBOUND_CALL", 0.35), ("SMS", 0.25), ("IVR", 0.15), ("EMAIL", 0.15), ("LETTER", 0.10))
LIVE = (("Right Party Contact", 0.55), ("Wrong Party", 0.10), ("No Answer", 0.20), ("Voicemail", 0.10), ("Busy", 0.05))
AUTOMATED, WRITTEN = (("Delivered", 0.85), ("Undeliverable", 0.15)), (("Delivered", 0.90), ("Returned Mail", 0.10))
COMPLAINT, PROMISED, KEPT, PARTIAL, DELAYED, APPROVED, JOINT = 0.003, 0.55, 0.65, 0.4, 0.05, 0.92, 0.15
TEAMS = ("Early Stage 1-29", "Mid Stage 30-59", "Late Stage 60-89", "Late Stage 90+", "Recovery")


def choice(u: Column, shares) -> Column:
    """The value whose share of [0, 1) holds ``u``; the last one takes what is left."""
    at, out = 0.0, None
    for value, share in shares[:-1]:
        at += share
        out = F.when(u < at, value) if out is None else out.when(u < at, value)
    return F.lit(shares[-1][0]) if out is None else out.otherwise(shares[-1][0])


def between(u: Column, low: int, high: int) -> Column:
    """A whole number of low..high."""
    return (low + F.floor(u * (high - low + 1))).cast("int")


def loans(spark: SparkSession, n: int) -> DataFrame:
    i = F.col("id")
    kinds = F.array(*[F.lit(x) for x in ("Auto", "Personal", "Credit Card", "HELOC", "Mortgage")])
    return spark.range(n).select(
        F.format_string("LN-%07d", i).alias("loan_id"),
        F.format_string("CU-%07d", F.pmod(F.xxhash64(i, F.lit(1)), F.lit(max(1, n * 4 // 5)))).alias("customer_id"),
        F.element_at(kinds, (F.pmod(F.xxhash64(i, F.lit(2)), F.lit(5)) + 1).cast("int")).alias("loan_type"),
        F.round(1000 + 50_000 * stable_share(i, seed=3), 2).alias("origination_amount"),
        (1 + F.pmod(F.xxhash64(i, F.lit(4)), F.lit(28))).cast("int").alias("due_day"),
        choice(stable_share(i, seed=5), [(b[0], b[3]) for b in BANDS]).alias("risk_band_code"),
    )


def applications(spark: SparkSession, n: int) -> DataFrame:
    """An application for each loan, and beside them the declined ones."""
    u = F.col("id")
    all_ = spark.range(n).select(F.format_string("AP-%07d", u).alias("application_id"), F.format_string("LN-%07d", u).alias("loan_id"), F.lit("Approved").alias("decision"))
    declined = spark.range(round(n / APPROVED) - n).select(F.format_string("AP-D%06d", u).alias("application_id"), F.lit(None).cast("string").alias("loan_id"), F.lit("Declined").alias("decision"))
    return all_.unionByName(declined)


def loan_customers(of: DataFrame) -> DataFrame:
    """The bridge of loans and customers: a primary one each, and a joint one for some."""
    primary = of.select("loan_id", "customer_id", F.lit("Primary").alias("role"))
    joint = of.where(stable_share(F.col("loan_id"), seed=6) < JOINT)
    return primary.unionByName(joint.select("loan_id", F.concat("customer_id", F.lit("-J")).alias("customer_id"), F.lit("Joint").alias("role")))


def collectors(spark: SparkSession, n: int = 120) -> DataFrame:
    i = F.col("id")
    team = F.element_at(F.array(*[F.lit(t) for t in TEAMS]), (i % len(TEAMS) + 1).cast("int"))
    return spark.range(n).select(F.format_string("COL-%04d", 1000 + i).alias("collector_id"), team.alias("team_name"))


#: Loans in a frame on their way back from Python: what a task holds is bounded, however many loans there are.
_FRAME = 500
_DAY = "snapshot_date date, bucket_index int, dpd int, restructured boolean"


def _life(days: int, first: str):
    # The days are made once; all loans share them.
    dates = [(d.date(), d.day) for d in pd.date_range(first, periods=days)]

    def life(r):
        out = []
        bucket, dpd, changed, left, draw = 0, 0, False, None, int(r.seed)

        def chance(p):
            nonlocal draw
            draw = (draw * 6364136223846793005 + 1442695040888963407) % 2**64
            return draw / 2**64 < p

        for date, day in dates:
            if 0 < bucket < 5:
                dpd += 1
            if left is not None:
                left -= 1
                bucket, left = (6, None) if left == 0 else (bucket, left)
            if day == r.due_day and bucket < 5:
                if bucket == 0:
                    bucket = int(chance(MISS[r.risk_band_code]))
                elif chance(CURE[bucket - 1]):
                    bucket, dpd = 0, 0
                elif bucket > 1 and not changed and chance(RESTRUCTURE):
                    bucket, dpd, changed = 0, 0, True
                elif bucket < 4:
                    bucket += 1
                elif chance(CHARGE_OFF):
                    bucket = 5
                    if chance(SETTLED):
                        left = 15 + draw // 2**40 % 45
            out.append((date, bucket, dpd, changed))
        return out

    kind = list(pa.schema([("snapshot_date", pa.date32()), ("bucket_index", pa.int32()), ("dpd", pa.int32()), ("restructured", pa.bool_())]))

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, _FRAME):
                part = b.slice(at, _FRAME)
                flat = [x for r in part.to_pandas().itertuples() for x in life(r)]
                columns = [pa.array([x[k] for x in flat], t.type) for k, t in enumerate(kind)]
                offsets = pa.array([k * days for k in range(part.num_rows + 1)], pa.int32())
                lists = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(columns, fields=kind))
                yield pa.RecordBatch.from_arrays([part["loan_id"], part["risk_band_code"], lists], ["loan_id", "risk_band_code", "days"])

    return run


def lives(spark: SparkSession, n: int, first: str, days: int) -> DataFrame:
    """A row for each loan with its days in order: missed and cured due dates, rolls, restructured loans, charge-offs (5) and settlements (6)."""
    seeded = loans(spark, n).select("loan_id", "risk_band_code", "due_day", F.shiftrightunsigned(F.xxhash64("loan_id", F.lit(9)), 1).alias("seed"))
    return seeded.mapInArrow(_life(days, first), f"loan_id string, risk_band_code string, days array<struct<{_DAY.replace(' ', ':').replace(',:', ',')}>>")


def portfolio(spark: SparkSession, n: int, first: str, days: int) -> DataFrame:
    """The days of ``lives``, a row for each loan and day."""
    return lives(spark, n, first, days).select("loan_id", "risk_band_code", F.inline("days"))


def contacts(days: DataFrame, n_collectors: int = 120) -> DataFrame:
    """Contacts with delinquent loans of a portfolio's days: channel, outcome, right party, length of a call, complaint."""
    u = lambda seed: stable_share(F.col("loan_id"), F.col("snapshot_date"), seed=seed)
    chance = F.create_map(*[F.lit(x) for pair in CONTACTED.items() for x in pair])[F.col("bucket_index")]
    live, party = F.col("channel_code") == "OUTBOUND_CALL", F.col("contact_outcome") == "Right Party Contact"
    outcome = F.when(live, choice(u(23), LIVE)).when(F.col("channel_code") == "LETTER", choice(u(23), WRITTEN)).otherwise(choice(u(23), AUTOMATED))
    # A collector of the team of this depth: numbers of one team lie len(TEAMS) apart.
    number = 1000 + F.col("bucket_index") - 1 + len(TEAMS) * between(u(24), 0, n_collectors // len(TEAMS) - 1)
    c = days.where(u(21) < chance).withColumn("channel_code", choice(u(22), CHANNELS)).withColumn("contact_outcome", outcome)
    return c.select(
        F.concat_ws("-", F.lit("CTC"), "loan_id", F.date_format("snapshot_date", "yyyyMMdd")).alias("contact_id"),
        "loan_id",
        F.col("snapshot_date").alias("contact_date"),
        "dpd",
        F.when(live, F.format_string("COL-%04d", number)).alias("collector_id"),
        "channel_code",
        "contact_outcome",
        (party | (F.col("contact_outcome") == "Delivered")).alias("is_rpc_flag"),
        F.when(live, F.when(party, between(u(25), 45, 719)).otherwise(between(u(25), 5, 44))).alias("call_duration_seconds"),
        (u(26) < COMPLAINT).alias("complaint_flag"),
    )


def promises_to_pay(of: DataFrame) -> DataFrame:
    """Promises out of calls that reached the right party: kept, kept in part, or broken."""
    u = lambda seed: stable_share(F.col("contact_id"), seed=seed)
    status = F.when(u(32) < KEPT, "Kept").when(u(33) < PARTIAL, "Partial").otherwise("Broken")
    amount = F.round(F.greatest(F.lit(50.0), F.col("dpd") * (3 + 6 * u(34))), 2)
    made = of.where((F.col("contact_outcome") == "Right Party Contact") & (u(31) < PROMISED)).withColumn("ptp_amount", amount).withColumn("ptp_status", status)
    paid = F.when(F.col("ptp_status") == "Kept", F.col("ptp_amount")).when(F.col("ptp_status") == "Partial", F.round(F.col("ptp_amount") * (0.2 + 0.5 * u(35)), 2)).otherwise(0.0)
    made = made.withColumn("wait", between(u(36), 2, 14))
    due = F.date_add("contact_date", F.col("wait"))
    met = F.when(F.col("ptp_status") == "Kept", F.date_add("contact_date", F.floor(u(37) * (F.col("wait") + 3)).cast("int"))).when(F.col("ptp_status") == "Partial", due)
    return made.select(
        F.concat(F.lit("PTP-"), "contact_id").alias("ptp_id"), "loan_id", "contact_id", "collector_id", F.col("contact_date").alias("ptp_created_date"),
        due.alias("ptp_promised_date"), "ptp_amount", "ptp_status", paid.alias("amount_paid_against_ptp"), met.alias("fulfillment_date"),
    )


def bureau(of: DataFrame, first: str, last: str, outage: list[str]) -> DataFrame:
    """A score for each customer and month on its third day, none on days of ``outage``; some scores come a week or two late."""
    u = lambda seed: stable_share(F.col("customer_id"), F.col("file_date"), seed=seed)
    mid = F.create_map(*[F.lit(x) for b in BANDS for x in (b[0], (b[1] + b[2]) / 2)])[F.col("risk_band_code")]
    months = F.sequence(F.trunc(F.lit(first).cast("date"), "month"), F.lit(last).cast("date"), F.expr("interval 1 month"))
    customers = of.groupBy("customer_id").agg(F.min_by("risk_band_code", "loan_id").alias("risk_band_code"))
    landed = F.col("file_date").between(first, last) & ~F.date_format("file_date", "yyyy-MM-dd").isin(outage or [""])
    each = customers.select("*", F.explode(months).alias("month")).withColumn("file_date", F.date_add("month", 2)).where(landed)
    # The sum of twelve shares is nearly normal, with a deviation of one.
    normal = sum((u(50 + k) for k in range(12)), F.lit(-6.0))
    score = F.greatest(F.lit(300), F.least(F.lit(850), F.floor(mid + 12 * normal).cast("int")))
    late = u(41) < DELAYED
    held = each.withColumn("fico_score", score).withColumn("is_late_arrival", late)
    return held.select(
        "customer_id", "file_date", F.when(F.col("is_late_arrival"), F.date_add("file_date", between(u(42), 7, 14))).otherwise(F.col("file_date")).alias("source_updated_at"),
        "fico_score", band(F.col("fico_score"), [(b[0], b[1], b[2]) for b in reversed(BANDS)]).alias("risk_band_code"), "is_late_arrival",
    )


def messy(payments: DataFrame, key: str = "payment_id") -> DataFrame:
    """Payments with duplicates, reversals, returned, late and corrupt records at the fixed rates."""
    u = lambda seed: stable_share(F.col(key), seed=seed)
    p = payments.withColumn("nsf_flag", u(13) < NSF).withColumn("is_late_arrival", u(14) < LATE).withColumn("is_corrupt_record", u(15) < CORRUPT)
    p = p.withColumn("ingestion_date", F.when(F.col("is_late_arrival"), F.expr("effective_date + interval 5 days")).otherwise(F.col("effective_date")))
    p = p.withColumn("payment_amount", F.when(F.col("is_corrupt_record"), F.negate(F.col("payment_amount"))).otherwise(F.col("payment_amount")))
    p = p.withColumn("is_reversal_flag", F.lit(False)).withColumn("original_payment_id", F.lit(None).cast("string"))
    back = p.where(u(12) < REVERSAL).withColumns({"original_payment_id": F.col(key), key: F.concat(key, F.lit("-REV")), "payment_amount": F.negate("payment_amount"), "is_reversal_flag": F.lit(True)})
    again = p.where(u(11) < DUPLICATE)
    return p.unionByName(again).unionByName(back)


def rates(messy_payments: DataFrame) -> DataFrame:
    """The achieved rates of disorder."""
    n = F.count("*")
    return messy_payments.agg(*[(F.count_if(c) / n).alias(c) for c in ("nsf_flag", "is_late_arrival", "is_corrupt_record", "is_reversal_flag")])
