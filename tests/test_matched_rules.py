"""Names of rules that hit: by literals alone where these are whole alternatives, and never counted or scored."""

from __future__ import annotations

import random
import re

from pyspark.sql import functions as F
from test_process_logs import ODD, SF, plain_logs_templates

from cinderlog import rules
from cinderlog.functions.literals import Literals, Prefilter, folded, scanner, whole
from cinderlog.operators import classify
from cinderlog.plans import queries

PATTERNS = [x.pattern for x in rules.CAUSES]


def texts(n: int) -> list[str]:
    """Odd texts, templates, and texts put together from pieces and whole alternatives of the patterns, also with letters that fold to ASCII."""
    rng = random.Random(11)
    pieces = [w for p in PATTERNS for w in [*re.findall(r"[A-Za-z✕✗✖]+|\d+|[\[\]():#\"$]+", p), *whole(p)]] + ["\n", " ", ": ", "\nFAIL\t", "K", "ſ", "İ", "ı", "é"]
    made = ["".join(rng.choice(["", " ", "\n"]) + rng.choice(pieces) for _ in range(rng.randint(1, 9))) for _ in range(n)]
    made += [x.translate(str.maketrans("skiI", "ſKıİ")) for x in made[::4]]
    left = [re.sub(r"\(\?:|[\\^()?*+]|\[\^?.*?\]", "", x) + tail for p in PATTERNS for x in p.split("|") for tail in ("", " 1", "\n")]
    return [x for x in [*ODD, *plain_logs_templates(), "npm ERR! ETIMEDOUT at the registry"] if x is not None] + left + made


def test_names_are_those_of_the_classification(spark):
    df = spark.createDataFrame([(x,) for x in [*texts(4000), "", None]], "t string")
    got = classify.matched_rules(df, "t").select("t", "matched_rules").collect()
    want = df.select("t", classify.classified(F.col("t"))["matched_rules"].alias("matched_rules")).collect()
    assert got == want
    assert len({x for r in want for x in r.matched_rules}) == len(PATTERNS)


def test_names_with_rules_of_a_callers_own(spark):
    """Two rules of one name count once; a rule without literals is always tried."""
    own = [rules.Cause("B", "x", r"\d{3}", 1.0), rules.Cause("A", "y", r"boom|bang \d", 0.5), rules.Cause("A", "y", "BOOM!", 0.5)]
    df = spark.createDataFrame([(x,) for x in ["Boom! 404", "bang 1", "bang", "", None]], "t string")
    got = [r.m for r in classify.matched_rules(df, "t", "m", own).collect()]
    assert got == [["A/y", "B/x"], ["A/y"], [], [], []]


def test_whole_alternatives():
    assert whole(r"OOMKilled|Killed\s+process|out of memory") == {"oomkilled", "out of memory"}
    assert whole("plain text") == {"plain text"} and whole(r"^start|✖ one|(gr)oup|opt?|[ab]") == frozenset()
    assert whole("(") == frozenset()
    for x in texts(20000):
        for p in PATTERNS:
            if any(w in folded(x) for w in whole(p)):
                assert re.search(p, x, re.IGNORECASE | re.MULTILINE), (p, x)


def test_the_query_counts_no_matches_and_tries_few_patterns(spark):
    """Before, every match of 0.875 rules a log was counted, and all were scored."""
    plan = queries.matched_rules(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "regexp_extract_all" not in plan.lower() and "RLIKE" in plan
    sure = [whole(p) for p in PATTERNS]
    find, n = scanner([*classify.prefilter().sets, *sure], True), len(PATTERNS)
    logs = [r.raw_log for r in queries.logs(spark, SF).select("raw_log").collect()]
    bits = [a | b << 62 for a, b in (find(x, 2) for x in logs)]
    assert sum((b & ~(b >> n) & (1 << n) - 1).bit_count() for b in bits) < 0.25 * len(logs)


def test_one_pass_gives_the_gates_of_searches():
    """The gates by their definition: some literal, and all sets of an alternative, at a line's start after a newline."""
    plain = [frozenset(["tests:", "\nfail"]), None, frozenset()]
    sets = [*Prefilter.of_patterns([*PATTERNS, r"\nab", r"^(?:ab|c)d|e\nf^g"]).sets, *plain]
    find, words = scanner(sets, True), -(-len(sets) // 62)
    some = 0
    for text in ["FAIL a", "abd", *texts(5000)]:
        low = folded(text)
        want = 0
        for i, x in enumerate(sets):
            branches = x.branches if isinstance(x, Literals) else ()
            if any(y in low for y in x or ()) and (not branches or any(all(any(y in "\n" + low for y in of) for of in branch) for branch in branches)):
                want |= 1 << i
        some += want > 0
        assert sum(b << 62 * i for i, b in enumerate(find(text, words))) == want, text
    assert some > 2000
