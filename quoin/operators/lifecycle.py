"""Job states, quotas, estimates of time and progress, event folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Transient states, seconds a step takes for 50 pages, steps of the tracker.
TRANSIENT = ["pending", "extracting", "processing", "annotating"]
STEP_SECONDS = {"extract": 3, "analyse": 120, "factcheck": 30, "annotate": 8}
STEP_FROM = [5, 15, 75, 88]
SECONDS_50, EXTRA = 50, 25
#: Requests that a user may make in a minute.
LIMITS = {"upload": 10, "confirm": 20}


def latest(states: DataFrame) -> DataFrame:
    """The last state of each job, later events of one time by id."""
    return states.groupBy("job_id").agg(F.max_by("status", F.struct("ts", "event_id")).alias("status"), F.max("ts").alias("updated_at"))


def after_restart(jobs: DataFrame) -> DataFrame:
    return jobs.withColumn("status", F.when(F.col("status").isin(TRANSIENT), "error").otherwise(F.col("status")))


def rolled_over(users: DataFrame, now: Column) -> DataFrame:
    same = F.trunc("last_reset_at", "MM") == F.trunc(now, "MM")
    return users.withColumn("spend", F.when(same, F.col("current_month_spend_usd")).otherwise(0.0))


def monthly_spend(jobs: DataFrame) -> DataFrame:
    return jobs.groupBy("user_id", F.date_format("created_at", "yyyy-MM").alias("month")).agg(F.round(F.sum("actual_cost_usd"), 6).alias("spend"))


def blocked(limit: Column, spent: Column) -> Column:
    return (limit > 0) & (spent >= limit)


def step_seconds(pages: Column) -> dict[str, Column]:
    ratio = F.greatest(F.lit(1), pages) / SECONDS_50
    extra = F.when(pages > 100, F.floor((pages - 100) / 60) * EXTRA).otherwise(0)
    return {k: v * ratio + (extra if k == "analyse" else 0) for k, v in STEP_SECONDS.items()}


def remaining(jobs: DataFrame) -> DataFrame:
    """Seconds each step takes and what is left from its start on."""
    steps = F.array(*(F.struct(F.lit(i).alias("step_no"), F.lit(k).alias("step"), s.cast("double").alias("seconds")) for i, (k, s) in enumerate(step_seconds(F.col("pages_count")).items())))
    rows = jobs.select("id", F.explode(steps).alias("s")).select("id", "s.*")
    onward = Window.partitionBy("id").orderBy("step_no").rowsBetween(0, Window.unboundedFollowing)
    return rows.withColumn("remaining", F.round(F.sum("seconds").over(onward), 6)).withColumn("label", duration(F.sum("seconds").over(onward)))


def duration(seconds: Column) -> Column:
    return F.when(seconds < 5, "presque terminé…").when(seconds < 60, F.concat(F.lit("~"), F.floor(seconds).cast("string"), F.lit("s"))).otherwise(F.concat(F.lit("~"), F.floor(seconds / 60).cast("string"), F.lit(" min")))


def active_step(progress: Column) -> Column:
    out = F.lit(0)
    for i, least in enumerate(STEP_FROM):
        out = F.when(progress >= least, i).otherwise(out)
    return out


def extrapolated(progress: Column, elapsed: Column) -> Column:
    return F.when((progress > 5) & (elapsed > 5), (100 - progress) / (progress / elapsed))


def pass_progress(done: Column, total: Column) -> Column:
    return 12 + F.floor(F.least(done / F.greatest(total, F.lit(1)), F.lit(1.0)) * 0.65 * 66).cast("int")


def fact_progress(done: Column, total: Column) -> Column:
    return 78 + F.floor(done / F.greatest(total, F.lit(1)) * 10).cast("int")


def timeout(pages: Column, pass1: Column, pass2: Column) -> Column:
    size = F.when(pages <= 30, 3).when(pages <= 100, 4).otherwise(5)
    rounds = F.ceil(F.ceil(pages / size) / F.when(pages > 80, 2).otherwise(4))
    first = F.when(pass1, rounds * 40 + 60 + F.when(pages >= 8, 60).otherwise(0)).otherwise(0)
    return F.greatest(F.lit(180), first + F.when(pass2, 90).otherwise(0) + 120)


def per_minute(events: DataFrame, limits: dict[str, int] = LIMITS) -> DataFrame:
    """Requests of each user and minute, and how many of them each limit refuses."""
    rows = events.groupBy("user_id", F.window("ts", "1 minute").alias("w")).agg(F.count("*").alias("n"))
    return rows.select("user_id", F.col("w.start").alias("minute"), "n", *(F.greatest(F.lit(0), F.col("n") - most).alias(f"refused_{name}") for name, most in limits.items()))


def running(states: DataFrame) -> DataFrame:
    """For each event of a job how many it had by then, of how many, and seconds since the first."""
    job = Window.partitionBy("job_id")
    upto = job.orderBy("ts", "event_id")
    return states.select("job_id", "event_id", F.row_number().over(upto).alias("done"), F.count("*").over(job).alias("total"), (F.unix_timestamp("ts") - F.unix_timestamp(F.min("ts").over(job))).alias("elapsed"))


def toggled(events: DataFrame) -> DataFrame:
    """Pins and likes as the folded log leaves them: on after an odd number of toggles."""
    return events.groupBy("user_id", "event_type").agg((F.count("*") % 2 == 1).alias("on"))


def user_problems(users: DataFrame) -> DataFrame:
    """What each user record is refused for, if anything."""
    email = F.lower(F.trim("email"))
    seen = F.count("*").over(Window.partitionBy(email))
    problem = F.when(~F.contains(email, F.lit("@")), "email").when(seen > 1, "duplicate").when(~F.col("role").isin("user", "admin"), "role").when(F.col("monthly_limit_usd") < 0, "limit")
    return users.select("id", email.alias("email"), problem.alias("problem"))
