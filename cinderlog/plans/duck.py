"""DuckDB SQL for the log path, made from the same fixed values on another engine.

Its patterns have neither lookaround nor possessive groups, so rules that need them are
left to tests.
"""

from __future__ import annotations

from cinderlog import rules
from cinderlog.functions.numbers import rounded_sql
from cinderlog.plans.views import CI_LOGS, plain

MARK = "\ue000"


def text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def pattern(p: str, flags: str = "") -> str:
    p = p.replace("++)", "+)").replace("{2,}+", "{2,}").replace(")*+", ")*")
    return text((f"(?{flags})" if flags else "") + p)


def replace(x: str, p: str, to: str, flags: str = "") -> str:
    for i in range(1, 4):
        to = to.replace(f"${i}", f"\\{i}")
    return f"regexp_replace({x}, {pattern(p, flags)}, {text(to)}, 'g')"


def matches(x: str, p: str, flags: str = "") -> str:
    return f"regexp_matches({x}, {pattern(p, flags)})"


def count(x: str, p: str, flags: str = "") -> str:
    return f"len(regexp_extract_all({x}, {pattern(p, flags)}))"


def strip(x: str) -> str:
    return f"trim({x}, ' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12))"


def steps(name: str, source: str, column: str, expressions: list[str]) -> tuple[str, str]:
    """CTEs that rewrite a column step by step; each expression has {x} for it. Returns (CTEs, last name)."""
    out = []
    for i, e in enumerate(expressions):
        out.append(f"{name}{i} AS (SELECT * REPLACE ({e.replace('{x}', column)} AS {column}) FROM {source})")
        source = f"{name}{i}"
    return ", ".join(out), source


def cleaned() -> tuple[str, str]:
    """(CTEs, name) of ci_logs with column t, its cleaned text."""
    own = [(p, f, r) for p, f, r in rules.CLEANERS if "(?!" not in p]  # ci_logs has no carriage returns
    ctes, last = steps("c", "src", "t", [replace("{x}", p, r, f) for p, f, r in own] + [strip("{x}")])
    return f"src AS (SELECT *, raw_log AS t FROM ({plain(CI_LOGS)}) q), {ctes}", last


def extracted() -> tuple[str, str]:
    """(CTEs, name) with fam, lines, hits, first, blk (error block), msg (error message)."""
    ctes, last = cleaned()
    fam = "CASE " + " ".join(f"WHEN {matches('t', p, f)} THEN {text(n)}" for n, p, f in rules.FAMILIES) + " END"
    marked = "CASE fam " + " ".join(f"WHEN {text(n)} THEN {replace('t', p, MARK + chr(92) + '0', f)}" for n, p, f in rules.FAMILIES) + " END"
    useful = f"list_filter(list_transform(lines, lambda x: {strip('x')}), lambda x: x <> '' AND substr(x, 1, 1) NOT IN ('$', '+', '#'))"
    ctes += f""", fam AS (SELECT *, {fam} AS fam, string_split(t, chr(10)) AS lines FROM {last}), mk AS (SELECT *, string_split({marked}, chr(10)) AS ml FROM fam),
      ht AS (SELECT *, CASE WHEN fam IS NULL THEN [] ELSE list_filter(range(len(ml)), lambda i: contains(ml[i + 1], '{MARK}')) END AS hits FROM mk),
      ex AS (SELECT *, hits[1] AS first, array_to_string(lines[hits[1] + 1 : hits[1] + 30], chr(10)) AS blk, {useful} AS useful FROM ht),
      ext AS (SELECT *, CASE WHEN fam IS NOT NULL THEN nullif(substr({strip('lines[first + 1]')}, 1, 500), '')
                        ELSE substr(coalesce(list_filter(useful, lambda x: length(x) > 10)[-1], useful[-1]), 1, 500) END AS msg FROM ex)"""
    return ctes, "ext"


def signed() -> tuple[str, str]:
    """(CTEs, name) with basis, norm and signature_hash."""
    ctes, last = extracted()
    ctes += f", bs AS (SELECT *, coalesce(nullif(CASE WHEN fam IS NOT NULL THEN blk END, ''), nullif(msg, ''), right(t, 2000)) AS basis FROM {last})"
    ctes += f", pk AS (SELECT *, string_split(regexp_replace(substr({strip('basis')}, 1, 2000), {pattern(rules.MEANINGFUL_NUMBER, 'i')}, '{MARK}\\0{MARK}', 'g'), '{MARK}') AS parts FROM bs)"
    slots = f"list_transform(range(len(parts)), lambda i: CASE WHEN i % 2 = 1 THEN chr(1) || 'PM' || CAST((i - 1) // 2 AS VARCHAR) || chr(1) ELSE parts[i + 1] END)"
    ctes += f", n AS (SELECT *, array_to_string({slots}, '') AS norm FROM pk)"
    more, last = steps("n", "n", "norm", [replace("{x}", p, token, f) for p, f, token in rules.NORMALISERS])
    back = "norm"
    for i in range(6):
        back = f"replace({back}, chr(1) || 'PM{i}' || chr(1), coalesce(parts[{2 * i + 2}], ''))"
    ctes += f", {more}, nb AS (SELECT * REPLACE (lower({strip(f'regexp_replace({back}, {text(chr(92) + chr(115) + chr(43))}, chr(32), {text(chr(103))})')}) AS norm) FROM {last})"
    ctes += ", sg AS (SELECT *, sha256(coalesce(fam, 'unknown') || '::' || norm) AS signature_hash FROM nb)"
    return ctes, "sg"


def scored(source: str, column: str) -> str:
    """CTEs h, sc and cl over a source: hits, category scores and the classification's parts."""
    hit = ", ".join(f"{count(column, c.pattern, 'im')} AS h{i}" for i, c in enumerate(rules.CAUSES))
    one = [f"CASE WHEN h{i} > 0 THEN CAST({c.weight} AS DOUBLE) * least(CAST(1 + (h{i} - 1) * CAST(0.1 AS DOUBLE) AS DOUBLE), CAST(1.5 AS DOUBLE)) ELSE CAST(0 AS DOUBLE) END AS s{i}" for i, c in enumerate(rules.CAUSES)]
    by = {}
    for i, c in enumerate(rules.CAUSES):
        by.setdefault(c.category, []).append(i)
    cats = []
    for name, at in by.items():
        first = "CASE " + " ".join(f"WHEN h{i} > 0 THEN {i}" for i in at) + " END"
        cats.append(f"{{'score': {' + '.join(f's{i}' for i in at)}, 'first': -({first}), 'category': '{name}'}}")
    subs = [f"{{'score': s{i}, 'first': {-i}, 'category': '{c.category}', 'subcategory': '{c.subcategory}'}}" for i, c in enumerate(rules.CAUSES)]
    symptoms = ", ".join(text(x) for x in rules.SYMPTOMS)
    return f"""h AS (SELECT *, {hit} FROM {source}), s AS (SELECT *, {', '.join(one)} FROM h),
      sc AS (SELECT *, list_filter([{', '.join(cats)}], lambda x: x.score > 0) AS scores, list_filter([{', '.join(subs)}], lambda x: x.score > 0) AS found FROM s),
      b AS (SELECT *, list_sort(scores, 'DESC')[1] AS best FROM sc),
      cl AS (SELECT *, coalesce(best.category, 'UNKNOWN') AS category, list_sort(list_filter(found, lambda x: x.category = best.category), 'DESC')[1].subcategory AS subcategory,
               CASE WHEN best IS NULL THEN 0.0 ELSE {rounded_sql(f"""least(CAST(0.98 AS DOUBLE), best.score / list_sum(list_transform(list_filter(scores, lambda x: x.category NOT IN ({symptoms}) OR best.category IN ({symptoms})), lambda x: x.score)) * least(best.score, CAST(1 AS DOUBLE)))""", 3)} END AS confidence,
               array_to_string(list_sort(list_distinct(list_transform(found, lambda x: x.category || '/' || x.subcategory))), ',') AS matched_rules FROM b)"""


def redacted(source: str, column: str, names: list[str]) -> tuple[str, str]:
    """(CTEs, name) of a source with t, the text after the named rules, and k_<name> counts."""
    ctes, last = f"r AS (SELECT *, {column} AS t, lower({column}) AS low FROM {source})", "r"
    for rule in rules.REDACTIONS:
        if rule.name not in names:
            continue
        gate = " OR ".join(f"contains(low, {text(x)})" for x in rule.literals) or "true"
        if rule.name == "email":
            parts = f"string_split(regexp_replace(t, {pattern(rule.pattern, rule.flags)}, '{MARK}\\0{MARK}', 'g'), '{MARK}')"
            hit = f"i % 2 = 1 AND NOT {matches('parts[i + 1]', rules.EMAIL_ALLOWED, 'i')}"
            ctes += f", p_email AS (SELECT *, {parts} AS parts FROM {last})"
            ctes += f", r_email AS (SELECT * EXCLUDE (parts) REPLACE (array_to_string(list_transform(range(len(parts)), lambda i: CASE WHEN {hit} THEN {text(rule.replacement)} ELSE parts[i + 1] END), '') AS t), len(list_filter(range(len(parts)), lambda i: {hit})) AS k_email FROM p_email)"
        else:
            ctes += f", r_{rule.name} AS (SELECT * REPLACE (CASE WHEN {gate} THEN {replace('t', rule.pattern, rule.replacement, rule.flags)} ELSE t END AS t), CASE WHEN {gate} THEN {count('t', rule.pattern, rule.flags)} ELSE 0 END AS k_{rule.name} FROM {last})"
        last = f"r_{rule.name}"
    return ctes, last
