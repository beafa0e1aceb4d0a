"""Totals, scores, gates, orders and renderings of findings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sieveline.operators.places import numbered
from sieveline.operators.staging import staged
from sieveline.schema import SEVERITIES, severity_rank, severity_weight


def order_key() -> list[Column]:
    """The total order: worst first, then file, line, column, id, message; missing places first."""
    return [severity_rank().desc(), F.asc("file"), F.asc_nulls_first("line"), F.asc_nulls_first("column"), F.asc("id"), F.asc("message")]


def sort_struct() -> Column:
    """The total order as one comparable value, so that firsts are minimum aggregations instead of sorts."""
    return F.struct((-severity_rank()).alias("r"), F.col("file"), F.col("line"), F.col("column"), F.col("id"), F.col("message"))


def at_least(df: DataFrame, severity: str) -> DataFrame:
    return df.where(severity_rank() >= dict((s, r) for s, r, _ in SEVERITIES)[severity])


def summary(df: DataFrame, *by: str) -> DataFrame:
    """Counts by severity, and of fixable findings."""
    return df.groupBy(*by).agg(*(F.count_if(F.col("severity") == s).alias(s) for s, _, _ in SEVERITIES), F.count_if("fixable").alias("fixable"))


def at_or_above(df: DataFrame) -> DataFrame:
    """By severity: findings, and findings of that severity or worse."""
    counts = df.groupBy("severity").agg(F.count("*").alias("n")).withColumn("rank", severity_rank())
    worse = Window.orderBy(F.desc("rank")).rowsBetween(Window.unboundedPreceding, 0)  # five rows
    return counts.select("severity", "rank", "n", F.sum("n").over(worse).alias("at_or_above"))


def score_value() -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(100), F.lit(100) - F.coalesce(F.sum(severity_weight()), F.lit(0)))).cast("int")


def score(df: DataFrame, *by: str) -> DataFrame:
    """100 less the weights of the findings, from 0 to 100."""
    return df.groupBy(*by).agg(score_value().alias("score"))


#: Exit codes of a run: nothing found, the gate fails, wrong use, an error.
EXIT_CODES = {"pass": 0, "fail": 1, "usage": 2, "error": 3}


def parse_fail_on(value: str) -> str:
    """A severity that a gate may ask for; info may not, as it never fails."""
    if value not in [s for s, _, _ in SEVERITIES] or value == "info":
        raise ValueError(f"{value}: not one of critical, high, medium, low")
    return value


def gate_row(df: DataFrame, fail_on: str | None = None, min_score: int | None = None, scored: bool = True) -> DataFrame:
    """(critical, .., fixable, score, failed_severity, failed_score, failed, exit_code) of all findings; the least score counts only where there is a score."""
    limit = dict((s, r) for s, r, _ in SEVERITIES).get(fail_on)
    total = df.agg(*(F.count_if(F.col("severity") == s).alias(s) for s, _, _ in SEVERITIES), F.count_if("fixable").alias("fixable"), score_value().alias("score"), F.max(severity_rank()).alias("worst"))
    total = total.withColumn("score", F.col("score") if scored else F.lit(None).cast("int"))
    bad = F.coalesce(F.col("worst") >= limit, F.lit(False)) if limit is not None else F.lit(False)
    low = F.coalesce(F.col("score") < min_score, F.lit(False)) if min_score is not None else F.lit(False)
    judged = total.withColumns({"failed_severity": bad, "failed_score": low})
    return judged.withColumn("failed", F.col("failed_severity") | F.col("failed_score")).withColumn("exit_code", F.when(F.col("failed"), EXIT_CODES["fail"]).otherwise(EXIT_CODES["pass"])).drop("worst")


def gate(df: DataFrame, by: str, fail_on: str = "high", least: int = 50) -> DataFrame:
    """By group: the worst rank, the score, and whether the gate passes: nothing of fail_on or worse, and the score reaches least."""
    worst = F.max(severity_rank())
    limit = dict((s, r) for s, r, _ in SEVERITIES)[fail_on]
    return df.groupBy(by).agg(worst.alias("worst_rank"), score_value().alias("score")).withColumn("passes", (F.col("worst_rank") < limit) & (F.col("score") >= least))


def tally(df: DataFrame) -> DataFrame:
    """Counts by file and severity, a column each."""
    return df.groupBy("file").pivot("severity", [s for s, _, _ in SEVERITIES]).count().na.fill(0)


def top(df: DataFrame, n: int) -> DataFrame:
    """The first n findings of the total order, with their place."""
    first = df.orderBy(*order_key()).limit(n)
    return first.withColumn("place", F.row_number().over(Window.orderBy(*order_key())))  # n rows


def top_by_file(df: DataFrame, n: int) -> DataFrame:
    w = Window.partitionBy("file").orderBy(*order_key())
    return df.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


def file_order(df: DataFrame) -> DataFrame:
    """Files with their first finding in the total order; the order of these is that of the files."""
    return df.groupBy("file").agg(F.min(sort_struct()).alias("first"), F.count("*").alias("n")).select("file", (-F.col("first.r")).alias("worst_rank"), F.col("first.line").alias("first_line"), F.col("first.id").alias("first_id"), "n")


def next_actions(df: DataFrame, action: Column, n: int = 10) -> DataFrame:
    """The first n different actions by the total order, and how many more there are."""
    firsts = df.groupBy(action.alias("action")).agg(F.min(sort_struct()).alias("first"))
    total = firsts.agg(F.count("*").alias("all"))
    listed = firsts.orderBy("first", "action").limit(n).withColumn("place", F.row_number().over(Window.orderBy("first", "action")))
    return listed.crossJoin(F.broadcast(total)).select("place", "action", F.greatest(F.col("all") - n, F.lit(0)).alias("more"))  # total is one row


def envelope(df: DataFrame, project: str, stack: list[str] = (), generated_at: str | None = None, skipped: DataFrame | None = None, version: str = "0.1.0") -> DataFrame:
    """One JSON document of all findings in the total order, with project, score, summary and skipped files; nulls are left out.

    A report is one document, so it holds what one document can hold; larger results stay tables.
    """
    fields = [c for c in df.columns if c not in ("seed_kind", "seed_text")]
    item = F.struct(*(F.col(c) for c in fields))
    listed = F.transform(F.array_sort(F.collect_list(F.struct(sort_struct().alias("o"), item.alias("f")))), lambda x: x["f"])
    totals = F.struct(*(F.count_if(F.col("severity") == s).alias(s) for s, _, _ in SEVERITIES), F.count_if("fixable").alias("fixable"))
    one = df.agg(listed.alias("findings"), totals.alias("summary"), score_value().alias("score"))
    left = (skipped if skipped is not None else df.sparkSession.createDataFrame([], "path string, reason string")).agg(F.array_sort(F.collect_list(F.struct("path", "reason"))).alias("skipped"))
    document = F.struct(
        F.lit("1").alias("schema_version"), F.lit(version).alias("tool_version"), F.lit(generated_at).cast("string").alias("generated_at"),
        F.struct(F.lit(project).alias("path"), F.array(*map(F.lit, stack)).cast("array<string>").alias("stack")).alias("project"), "score", "summary", "findings", "skipped",
    )
    return one.crossJoin(left).select(F.to_json(document, {"ignoreNullFields": "true"}).alias("json"))  # one row each


def write_report(df: DataFrame, path: str) -> None:
    """Findings as JSON lines, without the columns that only name them."""
    df.drop("seed_kind", "seed_text").write.mode("overwrite").json(path)


def write_envelope(df: DataFrame, path: str, project: str, **more) -> None:
    envelope(df, project, **more).coalesce(1).write.mode("overwrite").text(path)


def agent_line() -> Column:
    """A finding as a line: severity, place, rule and message."""
    place = F.concat(F.col("file"), F.coalesce(F.concat(F.lit(":"), F.col("line").cast("string")), F.lit("")))
    return F.concat(F.lit("["), F.upper("severity"), F.lit("] "), place, F.lit(" "), F.col("id"), F.lit(" - "), F.col("message"))


def _place(df_file: str = "file") -> Column:
    line = F.when(F.col("line").isNotNull(), F.concat(F.lit(":"), F.col("line").cast("string"), F.coalesce(F.concat(F.lit(":"), F.col("column").cast("string")), F.lit(""))))
    return F.concat(F.col(df_file), F.coalesce(line, F.lit("")))


def _doubt() -> Column:
    return F.when(F.col("confidence") == "high", "").otherwise(F.concat(F.lit(" (confidence: "), "confidence", F.lit(")")))


def ranked(df: DataFrame) -> DataFrame:
    """df with `place` in the total order, counted over ranges of it, so that no task sorts all findings."""
    return numbered(df, order_key())


def next_step() -> Column:
    """What to do about a finding: its suggestion, else its remediation."""
    return F.coalesce("suggestion", "remediation")


def agent_report(df: DataFrame, fail_on: str | None = None, min_score: int | None = None, scored: bool = True, actions: int = 10) -> DataFrame:
    """(part, no, line) of the report for machines that read text: gate, summary, findings and next actions; findings carry their tokens."""
    total = gate_row(df, fail_on, min_score, scored)
    why_score = F.when(F.col("failed_score"), F.concat(F.lit(" · score "), F.col("score").cast("string"), F.lit(f"/100 < min {min_score}"))).otherwise("")
    why_severity = F.when(F.col("failed_severity"), F.lit(f" · {fail_on}+ findings ≥ {fail_on}")).otherwise("")
    gate_line = F.concat(F.lit("GATE: "), F.when(F.col("failed"), "fail").otherwise("pass"), why_score, why_severity)
    n = sum((F.col(s) for s, _, _ in SEVERITIES), F.lit(0))
    counts = F.concat(F.lit("SUMMARY: "), n.cast("string"), F.lit(" findings"), *(F.concat(F.lit(" · "), F.col(s).cast("string"), F.lit(f" {s}")) for s in [*(s for s, _, _ in SEVERITIES), "fixable"]), F.coalesce(F.concat(F.lit(" · score "), F.col("score").cast("string"), F.lit("/100")), F.lit("")))
    clean = F.when(n == 0, F.array(F.lit("no findings — clean"))).otherwise(F.array(F.lit("FINDINGS:")))
    head = total.select(F.lit(0).alias("part"), F.posexplode(F.concat(F.array(gate_line, counts), clean)).alias("no", "line"))
    text = F.concat("severity", F.lit(" "), "id", F.lit(" "), _place(), F.lit(" — "), "message", _doubt(), F.when(F.col("fixable"), " [fixable]").otherwise(""), F.lit(" "), F.coalesce("fingerprint", F.lit("gdv1:?")))
    found = ranked(df).select(F.lit(1).alias("part"), F.col("place").alias("no"), text.alias("line"))
    firsts = df.where(next_step().isNotNull()).groupBy(next_step().alias("action")).agg(F.min(sort_struct()).alias("first"))
    listed = firsts.orderBy("first", "action").limit(actions).withColumn("no", F.row_number().over(Window.orderBy("first", "action")))
    steps = listed.select(F.lit(3).alias("part"), "no", F.concat(F.lit("- "), "action").alias("line"))
    title = total.where(n > 0).select(F.lit(2).alias("part"), F.lit(0).alias("no"), F.lit("NEXT ACTIONS:").alias("line"))
    more = firsts.agg(F.count("*").alias("all")).where(F.col("all") > actions).select(F.lit(4).alias("part"), F.lit(0).alias("no"), F.concat(F.lit("… ("), (F.col("all") - actions).cast("string"), F.lit(" more)")).alias("line"))
    return head.unionByName(found).unionByName(title).unionByName(steps).unionByName(more)


#: Findings beyond which a terminal shows the first three alone, widths, and the mark of each severity.
SHORT_BEYOND, POSITION, SEVERITY_WIDTH, BANNER = 25, 8, 8, 46
GLYPHS = {"critical": "✖", "high": "▲", "medium": "●", "low": "○", "info": "·"}


def finding_line() -> Column:
    """A finding under its file's heading: position, mark, severity, message, rule."""
    position = F.when(F.col("line").isNull(), "—").otherwise(F.concat(F.col("line").cast("string"), F.coalesce(F.concat(F.lit(":"), F.col("column").cast("string")), F.lit(""))))
    glyph = F.create_map(*(F.lit(x) for pair in GLYPHS.items() for x in pair))[F.col("severity")]
    padded = F.when(F.length(position) < POSITION, F.lpad(position, POSITION, " ")).otherwise(position)
    return F.concat(F.lit("  "), padded, F.lit(" "), glyph, F.lit(" "), F.rpad("severity", SEVERITY_WIDTH, " "), F.lit(" "), "message", _doubt(), F.lit("  "), "id")


def step_line() -> Column:
    """The line below a finding that says what to do; null without one."""
    return F.concat(F.lit("  " + " " * POSITION + " → "), next_step())


def terminal_report(df: DataFrame, scored: bool = True, verbose: bool = False) -> DataFrame:
    """(part, file_no, no, line) of the report for people: banner, findings by file with the worst file first, the first three, the tally.

    With more than SHORT_BEYOND findings only the banner, the first three and the tally, unless verbose.
    """
    total = gate_row(df, scored=scored)
    n = sum((F.col(s) for s, _, _ in SEVERITIES), F.lit(0))
    score_text = F.concat(F.lit("  Score: "), F.col("score").cast("string"), F.lit("/100"))
    counted = F.concat(F.lit("  "), F.concat_ws(" · ", *(F.concat(F.col(s).cast("string"), F.lit(f" {s}")) for s, _, _ in SEVERITIES[:4])))
    box = F.array(F.lit("┌─ check " + "─" * (BANNER - 8) + "┐"), F.concat(F.lit("│"), F.rpad(score_text, BANNER, " "), F.lit("│")), F.concat(F.lit("│"), F.rpad(counted, BANNER, " "), F.lit("│")), F.lit("└" + "─" * BANNER + "┘"))
    banner = total.where("score is not null").select(F.lit(0).alias("part"), F.lit(0).alias("file_no"), F.posexplode(box).alias("no", "line"))
    clean = total.where((n == 0) & F.col("score").isNull()).select(F.lit(0).alias("part"), F.lit(0).alias("file_no"), F.lit(0).alias("no"), F.lit("no findings — clean").alias("line"))
    short = not verbose and df.limit(SHORT_BEYOND + 1).count() > SHORT_BEYOND  # decided first, as the order of all findings is needed only for the whole report
    parts = [banner, clean]
    if not short:
        placed = staged(ranked(df))
        groups = placed.groupBy("file").agg(F.min("place").alias("file_no"), F.count("*").alias("n"), *(F.count_if(F.col("severity") == s).alias(s) for s, _, _ in SEVERITIES))
        kinds = F.concat_ws(" · ", *(F.when(F.col(s) > 0, F.concat(F.col(s).cast("string"), F.lit(f" {s}"))) for s, _, _ in SEVERITIES))
        heads = groups.select(F.lit(1).alias("part"), "file_no", F.lit(0).alias("no"), F.concat("file", F.lit(" — "), F.col("n").cast("string"), F.when(F.col("n") == 1, " finding").otherwise(" findings"), F.lit(" · "), kinds).alias("line"))
        body = placed.join(groups.select("file", "file_no"), "file").select(F.lit(1).alias("part"), "file_no", (F.col("place") * 2).alias("no"), F.array_compact(F.array(finding_line(), step_line())).alias("lines"))
        parts += [heads, body.select("part", "file_no", "no", F.posexplode("lines").alias("k", "line")).select("part", "file_no", (F.col("no") + F.col("k")).alias("no"), "line")]
    if scored or short:
        parts.append(top(df, 3).select(F.lit(2).alias("part"), F.lit(0).alias("file_no"), F.col("place").alias("no"), F.concat(F.lit("  "), F.col("place").cast("string"), F.lit(". "), "id", F.lit(" "), F.col("file"), F.coalesce(F.concat(F.lit(":"), F.col("line").cast("string")), F.lit("")), F.lit(" — "), "message").alias("line")))
    last = F.concat(n.cast("string"), F.lit(" findings: "), F.concat_ws(" · ", *(F.concat(F.col(s).cast("string"), F.lit(f" {s}")) for s, _, _ in SEVERITIES)), F.lit(" ("), F.col("fixable").cast("string"), F.lit(" fixable)"))
    tally_ = total.where(n > 0).select(F.lit(3).alias("part"), F.lit(0).alias("file_no"), F.lit(0).alias("no"), last.alias("line"))
    return reduce(DataFrame.unionByName, [*parts, tally_])


def place_order() -> list[Column]:
    """The order of deployment findings: file, line, column, id, message; missing places first."""
    return [F.asc("file"), F.asc_nulls_first("line"), F.asc_nulls_first("column"), F.asc("id"), F.asc("message")]


def plan_order() -> list[Column]:
    """The order of a rewriting plan: worst first, then file and line."""
    return [severity_rank().desc(), F.asc("file"), F.asc_nulls_first("line")]


def corpus_metrics(findings: DataFrame, expected: DataFrame, files: DataFrame) -> DataFrame:
    """By rule: expected, found, recall, true and false findings, precision, and false findings of medium or worse per file.

    findings: (app, id, severity, file); expected: (app, id, file); files: (app, path) of sources.
    """
    own = findings.groupBy("app", "id", "file").agg(F.max(severity_rank()).alias("worst"), F.count("*").alias("n"))
    both = own.join(expected.select("app", "id", "file").distinct().withColumn("wanted", F.lit(True)), ["app", "id", "file"], "full_outer")
    total = files.agg(F.count("*").alias("files"))
    by = both.groupBy("id").agg(
        F.count_if("wanted").alias("expected"), F.count_if(F.col("wanted") & (F.col("n") > 0)).alias("found"), F.coalesce(F.sum(F.when(F.col("wanted"), F.col("n"))), F.lit(0)).alias("true"),
        F.coalesce(F.sum(F.when(F.col("wanted").isNull(), F.col("n"))), F.lit(0)).alias("false"), F.coalesce(F.sum(F.when(F.col("wanted").isNull() & (F.col("worst") >= 2), F.col("n"))), F.lit(0)).alias("loud"),
    )
    rated = by.crossJoin(F.broadcast(total))  # one row
    share = lambda a, b: F.when(b > 0, F.round(a / b, 6))
    return rated.select("id", "expected", "found", share(F.col("found"), F.col("expected")).alias("recall"), "true", "false", share(F.col("true"), F.col("true") + F.col("false")).alias("precision"), share(F.col("loud"), F.col("files")).alias("false_rate"))
