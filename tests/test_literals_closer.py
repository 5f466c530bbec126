"""Gates that look at all literals of a pattern's alternatives."""

from __future__ import annotations

import random
import re

from pyspark import cloudpickle
from test_process_logs import ODD, plain_logs_templates

from cinderlog import rules
from cinderlog.functions.literals import Prefilter, literals, scanner
from cinderlog.operators import classify

UNIT_TEST = next(i for i, x in enumerate(rules.CAUSES) if x.subcategory == "UnitTest")


def test_a_failed_job_opens_no_gate_of_test_rules():
    sets = classify.prefilter().sets
    find = scanner(cloudpickle.loads(cloudpickle.dumps(sets)), True)
    is_open = lambda text: find(text, 1)[0] >> UNIT_TEST & 1
    assert not is_open("step done\nERROR: Job failed: exit code 1\n")
    assert all(map(is_open, ["FAIL a", "x\nfailed y", "✗ z", "a\n✕ b", "Tests: 2 failed", "test: 1 failed", "Failures: 3", "9 failing", "ok\nnot ok 3", "# fail 2"]))


def test_no_match_is_gated_away():
    """Texts put together from pieces of patterns and of logs: where a pattern matches, its gate is open."""
    rng = random.Random(7)
    patterns = [*(x.pattern for x in rules.CAUSES), *(p for _, p, _ in rules.FAMILIES), r"^\s*ab|cd(?:ef|^gh)+x", r"a^b|(?:^|;)key=", r"^(?:ab|c)d|e\nf^g"]
    pieces = [w for p in patterns for w in re.findall(r"[A-Za-z✕✗✖]+|\d+|[\[\]():#\"$]+", p)] + ["\n", " ", ": ", "ab", ";key=", "\nabd", "e\nfg", "K", "ſ", "İ", "3"]
    texts = [*(x for x in [*ODD, *plain_logs_templates()] if x), *("".join(rng.choice(["", " ", "\n"]) + rng.choice(pieces) for _ in range(rng.randint(1, 9))) for _ in range(30000))]
    # what is left of a pattern's own text is often a match of it
    texts += [re.sub(r"\(\?:|[\\^()?*+]|\[\^?.*?\]", "", x) + tail for p in patterns for x in p.split("|") for tail in ("", " 1", "\n")]
    found = Prefilter.of_patterns(patterns)
    find, words = scanner(found.sets, True), -(-len(patterns) // 62)
    hits = 0
    for text in texts:
        bits = sum(b << 62 * i for i, b in enumerate(find(text, words)))
        for i, p in enumerate(patterns):
            if found.sets[i] is not None and re.search(p, text, re.IGNORECASE | re.MULTILINE):
                hits += 1
                assert bits >> i & 1, (p, text)
    assert hits > 2000


def test_alternatives_without_literals_are_left_alone():
    assert literals(r"\d+") is None and literals(r"abc\d").branches and not literals(r"(?:ab|\d)abc").branches == ((),)


def test_few_rules_are_tried_in_vain(spark):
    """matched_rules counts 0.875 rules a log; before, 1.94 were tried."""
    from pyspark.sql import functions as F

    from cinderlog.plans import queries

    found = classify.prefilter()
    logs = queries.logs(spark, "/root/testdata/sf0.001").withColumn("b", found.column(F.col("raw_log")))
    tried = sum((x.cast("int") for x in found.gates(F.col("b"))), F.lit(0))
    assert logs.agg(F.avg(tried)).first()[0] < 1.2
