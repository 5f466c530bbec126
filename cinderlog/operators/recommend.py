"""Recommendations: risk by action, patches in scope only, bounds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cinderlog import rules
from cinderlog.functions import regex

MAX_RECOMMENDATIONS, MAX_FILES, MAX_PATCH_CHARS = 5, 20, 8000


def clamp(value: Column) -> Column:
    """A number within 0 and 1; what isn't a number is 0.5."""
    number = F.coalesce(value.cast("string").try_cast("double"), F.lit(0.5))
    return F.when(F.isnan(number), F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), number)))


def _bare(path: Column) -> Column:
    return regex.replace(path, r"\A[./]+", "")


def valid_patch(patch: Column, known_files: Column | None) -> Column:
    """The patch if it is a diff that a reader can take in and touches known files alone, else null."""
    files = F.array_except(F.regexp_extract_all(patch, F.lit(regex.rx(rules.DIFF_FILE, "m")), F.lit(1)), F.array(F.lit("/dev/null")))
    sound = (regex.strip(patch) != "") & (F.length(patch) <= MAX_PATCH_CHARS) & regex.matches(patch, rules.HUNK, "m") & (F.size(files) > 0)
    if known_files is not None:
        allowed = F.transform(known_files, _bare)

        def in_scope(path: Column) -> Column:
            own = _bare(path)
            return F.exists(allowed, lambda a: (own == a) | F.endswith(own, F.concat(F.lit("/"), a)) | F.endswith(a, F.concat(F.lit("/"), own)))

        sound = sound & (known_files.isNull() | F.forall(files, in_scope))
    return F.when(sound, patch)


def _lookup(values: dict[str, str], key: Column) -> Column:
    table = F.create_map(*(F.lit(x) for pair in values.items() for x in pair))
    return F.try_element_at(table, key)


def sanitised(items: Column, on_default_branch: Column, known_files: Column | None) -> Column:
    """The first recommendations with action, risk, confidence, files and patch made safe."""
    order = F.array(*(F.lit(x) for x in rules.RISKS))

    def one(x: Column) -> Column:
        asked = F.coalesce(x["action_type"], F.lit("manual"))
        known = F.when(asked.isin(*rules.ACTION_RISK), asked).otherwise("manual")
        patch = valid_patch(x["patch"], known_files)
        promoted = patch.isNotNull() & known.isin(*rules.PATCHABLE)
        action = F.when(promoted, "create_merge_request").otherwise(known)
        level = F.greatest(F.array_position(order, _lookup(rules.ACTION_RISK, known)), F.array_position(order, _lookup(rules.ACTION_RISK, action)))
        raised = F.when(on_default_branch & (level > 1), F.least(level + 1, F.lit(len(rules.RISKS)))).otherwise(level)
        return F.struct(
            x["title"].alias("title"), x["description"].alias("description"), x["rationale"].alias("rationale"), action.alias("action_type"), F.get(order, (raised - 1).cast("int")).alias("risk"),
            clamp(x["confidence"]).alias("confidence"), F.slice(F.coalesce(x["affected_files"], F.array().cast("array<string>")), 1, MAX_FILES).alias("affected_files"), patch.alias("patch"),
        )

    return F.transform(F.slice(F.coalesce(items, F.slice(items, 1, 0)), 1, MAX_RECOMMENDATIONS), one)
