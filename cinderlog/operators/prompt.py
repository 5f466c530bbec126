"""The text that a model is asked with, built from a request's columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cinderlog.functions import regex

MAX_FILES, MAX_DIFFS = 20, 5


def timing_ratio(duration: Column, baseline: Column) -> Column:
    """How many times the usual duration, as text with one decimal; null without a baseline."""
    return F.when(baseline > 0, F.format_number(duration / baseline, 1))


def _section(title: str, body: Column) -> Column:
    return F.concat(F.lit(f"# {title}\n"), body)


def _lines(items: Column) -> Column:
    return regex.nonempty(F.array_join(items, "\n"))


def render(request: str, classification: str, excerpt: Column, similar: Column | None = None, knowledge: Column | None = None, history: Column | None = None) -> Column:
    """Sections for what the request has; those without data are left out."""
    r, c = F.col(request), F.col(classification)
    project, pipeline, job, failure = r["project"], r["pipeline"], r["job"], r["failure"]
    changed = pipeline["changed_files"]
    head = F.concat_ws(
        "\n", F.concat(F.lit("project: "), project["name"]), F.concat(F.lit("stack: "), regex.nonempty(F.array_join(project["tech_stack"], ", "))),
        F.concat(F.lit("branch: "), pipeline["ref"], F.when(pipeline["ref"] == project["default_branch"], F.lit(" (default)")).otherwise("")),
        F.concat(F.lit("job: "), F.coalesce(job["stage_name"], F.lit("unknown")), F.lit(" / "), F.coalesce(job["name"], F.lit("unknown"))),
        F.concat(F.lit("exit code: "), F.coalesce(job["exit_code"].cast("string"), F.lit("unknown"))),
        F.when(failure["occurrence_index"] > 1, F.concat(F.lit("occurrence: "), failure["occurrence_index"].cast("string"))),
        F.when(failure["is_flaky"], F.lit("the job passed before on this commit: it may be flaky")),
    )
    prior = F.concat_ws("\n", F.concat(F.concat_ws(" / ", c["category"], c["subcategory"]), F.lit(" at "), c["confidence"].cast("string"), F.lit(" by "), c["source"]), F.concat(F.lit("rules: "), regex.nonempty(F.array_join(c["matched_rules"], ", "))))
    files = _lines(F.transform(F.slice(changed, 1, MAX_FILES), lambda f: F.concat(f["path"], F.lit(" "), F.coalesce(f["change_type"], F.lit("")), F.when(f["is_config"], F.lit(" [config]")).otherwise(""), F.when(f["is_dependency"], F.lit(" [dependency]")).otherwise(""))))
    diffs = _lines(F.transform(F.slice(F.filter(changed, lambda f: regex.nonempty(f["patch"]).isNotNull()), 1, MAX_DIFFS), lambda f: F.concat(f["path"], F.lit("\n"), f["patch"], F.when(f["patch_truncated"], F.lit("\n(cut)")).otherwise(""))))
    before = F.when(pipeline["previous_status"] == "success", F.lit("the pipeline before passed: look for a regression")).when(pipeline["previous_status"] == "failed", F.lit("the pipeline before failed too"))
    sources = _lines(F.transform(r["source_context"], lambda w: F.concat(w["path"], F.lit(":"), w["start_line"].cast("string"), F.lit("-"), w["end_line"].cast("string"), F.lit("\n"), w["content"])))
    n = (F.length(excerpt) - F.length(F.replace(excerpt, F.lit("\n"), F.lit(""))) + 1).cast("string")
    parts = [
        _section("Failure", head), _section("Rules say", prior), _section("Changed files", files), _section("Diffs", diffs), _section("Before", before), _section("Source", sources),
        _section("Timing", F.concat(timing_ratio(job["duration_seconds"], job["baseline_duration_seconds"]), F.lit(" times as long as usual"))),
        _section("Log", F.concat(F.lit("lines 1-"), n, F.lit(" of "), n, F.lit("; [REDACTED_*] marks what was taken out\n"), excerpt)),
        _section("Stack trace", regex.nonempty(r["stack_trace"])),
    ]
    if history is not None:
        parts.append(F.when(history["is_known"], _section("Known", F.concat_ws("\n", history["known_root_cause"], history["known_resolution"]))))
    if similar is not None:
        parts.append(_section("Similar failures", _lines(F.transform(similar, lambda s: F.concat_ws(" | ", F.round(s["similarity"] * 100).cast("int").cast("string"), s["project_name"], F.coalesce(s["resolution"], F.lit("never resolved")))))))
    if knowledge is not None:
        parts.append(_section("Documentation", _lines(F.transform(knowledge, lambda k: F.concat(k["title"], F.lit("\n"), k["content"])))))
    parts.append(F.lit("# Task\nAnswer as JSON in the given schema. Cite only what stands above."))
    return F.concat_ws("\n\n", *parts)
