"""The log path in plain Python, one log at a time: what tests hold the Spark plan against."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

from cinderlog import rules


def rx(pattern, flags=""):
    return re.compile(pattern.replace(r"\z", r"\Z"), (re.I if "i" in flags else 0) | (re.M if "m" in flags else 0))


def swap(replacement):
    return re.sub(r"\$(\d)", r"\\\1", replacement)


def entropy(x):
    return -sum(n / len(x) * math.log2(n / len(x)) for n in Counter(x).values()) if x else 0.0


def redact(text, strict=True):
    low, total, kinds = text.lower(), 0, []

    def some(pattern, flags, hit, replacement, name):
        nonlocal text, total
        n = 0

        def one(m):
            nonlocal n
            if not hit(m.group(0)):
                return m.group(0)
            n += 1
            return replacement

        text = rx(pattern, flags).sub(one, text)
        if n:
            total += n
            kinds.append(name)

    for rule in rules.REDACTIONS:
        if rule.literals and not any(x in low for x in rule.literals):
            continue
        if rule.name == "email":
            some(rule.pattern, rule.flags, lambda x: not rx(rules.EMAIL_ALLOWED, "i").search(x), rule.replacement, rule.name)
            continue
        text, n = rx(rule.pattern, rule.flags).subn(swap(rule.replacement), text)
        if n:
            total += n
            kinds.append(rule.name)
    if strict:
        some(rules.ENTROPY_CANDIDATE, "", lambda x: not rx(rules.ENTROPY_EXCLUDED, "i").search(x) and entropy(x) >= 4.2, "[REDACTED_HIGH_ENTROPY]", "high_entropy")
    return text, total, sorted(kinds)


def clean(text):
    for pattern, flags, replacement in rules.CLEANERS:
        text = rx(pattern, flags).sub(swap(replacement), text)
    return text.strip()


def last_meaningful(lines):
    useful = [x for x in map(str.strip, lines) if x and x[0] not in "$+#"]
    long = [x for x in useful if len(x) > 10]
    return (long or useful or [None])[-1] and (long or useful)[-1][:500]


def extract(text):
    lines = text.split("\n")
    codes = rx(rules.EXIT_CODE, "i").findall(text)
    out = {"exit_code": int(codes[-1]) if codes else None, "total_lines": len(lines), "stack_trace": None}
    for name, pattern, flags in rules.FAMILIES:
        hits = sorted({text.count("\n", 0, m.start()) for m in rx(pattern, flags).finditer(text)})
        if hits:
            break
    else:
        tail = "\n".join(lines[-120:])[-60_000:]
        return out | {"excerpt": tail, "excerpt_start_line": max(0, len(lines) - 120) + 1, "excerpt_end_line": len(lines), "error_block": None, "ecosystem": None, "error_message": last_meaningful(lines), "matched_lines": []}
    start, end = max(0, hits[0] - 15), min(len(lines), hits[-1] + 16)
    excerpt = "\n".join(lines[start:end])
    if end - start > 400:
        end = min(len(lines), hits[0] + 200)
        excerpt = "\n".join(lines[start:end]) + "\n…\n" + "\n".join(lines[-40:])
    trace = rx(rules.STACK_TRACES[name], "m").search(text) if name in rules.STACK_TRACES else None
    return out | {
        "excerpt": excerpt[:60_000], "excerpt_start_line": start + 1, "excerpt_end_line": end, "error_block": "\n".join(lines[hits[0] : hits[0] + 30]), "ecosystem": name,
        "error_message": lines[hits[0]].strip()[:500] or None, "matched_lines": [x + 1 for x in hits[:50]], "stack_trace": trace.group(0)[:4000] if trace and trace.group(0) else None,
    }


def normalise(text):
    text, parked = text.strip()[:2000], []

    def park(m):
        parked.append(m.group(0))
        return f"\0PM{len(parked) - 1}\0"

    text = rx(rules.MEANINGFUL_NUMBER, "i").sub(park, text)
    for pattern, flags, token in rules.NORMALISERS:
        text = rx(pattern, flags).sub(swap(token), text)
    for i, x in enumerate(parked):
        text = text.replace(f"\0PM{i}\0", x)
    return re.sub(r"\s+", " ", text).strip().lower()


def classify(text):
    found = []
    for i, c in enumerate(rules.CAUSES):
        n = len(rx(c.pattern, "im").findall(text))
        if n:
            found.append((c, i, c.weight * min(1 + (n - 1) * 0.1, 1.5)))
    if not found:
        return {"category": "UNKNOWN", "subcategory": None, "confidence": 0.0, "source": "rules", "matched_rules": []}
    scores, first = {}, {}
    for c, i, score in found:
        scores[c.category] = scores.get(c.category, 0.0) + score
        first.setdefault(c.category, i)
    best = max(scores, key=lambda k: (scores[k], -first[k]))
    sub = max((x for x in found if x[0].category == best), key=lambda x: (x[2], -x[1]))[0].subcategory
    total = sum(v for k, v in scores.items() if k not in rules.SYMPTOMS or best in rules.SYMPTOMS)
    confidence = round(min(0.98, scores[best] / total * min(scores[best], 1.0)), 3)
    return {"category": best, "subcategory": sub, "confidence": confidence, "source": "rules", "matched_rules": sorted({f"{c.category}/{c.subcategory}" for c, _, _ in found})}


def process(raw, strict=True):
    text, count, types = redact(raw, strict)
    cleaned = clean(text)
    e = extract(cleaned)
    basis = e["error_block"] or e["error_message"] or cleaned[-2000:]
    normalised = normalise(basis)
    digest = hashlib.sha256(f"{e['ecosystem'] or 'unknown'}::{normalised}".encode()).hexdigest()
    ratio = round(1 - len(e["excerpt"]) / max(1, len(raw)), 4)
    return {"redaction": {"text": text, "count": count, "types": types}, "cleaned": cleaned, "extraction": e, "normalised": normalised, "signature_hash": digest, "classification": classify(basis), "reduction": {"original_chars": len(raw), "excerpt_chars": len(e["excerpt"]), "ratio": ratio}}
