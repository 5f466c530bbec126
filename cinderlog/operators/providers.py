"""Model providers: the canned one, JSON from chatty answers, kinds of errors, and an interface for real ones."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterable, Iterator, Mapping
from dataclasses import dataclass, replace
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinderlog import rules
from cinderlog.functions import regex
from cinderlog.operators.classify import classify_rules

#: What a model's answer holds.
ANSWER = (
    "struct<category:string,subcategory:string,severity:string,confidence:string,summary:string,root_cause:string,explanation:string,is_transient:boolean,retry_recommended:boolean,"
    "evidence:array<struct<type:string,content:string,source_ref:string,line_number:int,related_failure_uuid:string,weight:string>>,"
    "recommendations:array<struct<title:string,description:string,rationale:string,action_type:string,confidence:string,affected_files:array<string>,patch:string>>>"
)
SHORT_LIVED = ("NETWORK", "INFRASTRUCTURE")


@dataclass(frozen=True)
class Reply:
    """A model's answer and what it took."""

    text: str
    model: str = ""
    provider: str = ""
    prompt_tokens: int = 0
    completion_tokens: int = 0
    fell_back_from: str | None = None


class Provider(Protocol):
    """A model service; made once a task, so it may hold a connection. A failure is a ProviderError."""

    name: str

    def ask(self, prompt: str) -> Reply: ...

    def cost(self, prompt_tokens: int, completion_tokens: int) -> float: ...


def stub(df: DataFrame, prompt: str, out: str = "answer") -> DataFrame:
    """Adds the canned answer, from the rules over the whole prompt, and says that it is one."""
    df = classify_rules(df, prompt, "__stub")
    c = F.col("__stub")
    matched = F.coalesce(regex.nonempty(F.array_join(c["matched_rules"], ", ")), F.lit("no specific pattern"))
    text = F.lit(None).cast("string")
    evidence = F.array(F.struct(F.lit("log_line").alias("type"), F.concat(F.lit("Matched by the rule classifier: "), matched).alias("content"), F.lit("classifier").alias("source_ref"), F.lit(None).cast("int").alias("line_number"), text.alias("related_failure_uuid"), c["confidence"].cast("string").alias("weight")))
    advice = F.array(F.struct(F.lit("Set up a model provider").alias("title"), F.lit("This answer comes from the rules alone.").alias("description"), text.alias("rationale"), F.lit("investigate").alias("action_type"), F.lit("1.0").alias("confidence"), F.array().cast("array<string>").alias("affected_files"), text.alias("patch")))
    short = c["category"].isin(*SHORT_LIVED)
    value = F.struct(
        c["category"].alias("category"), c["subcategory"].alias("subcategory"), F.when(c["confidence"] > 0.8, "high").otherwise("medium").alias("severity"),
        F.round(F.least(F.lit(0.93), F.greatest(F.lit(0.45), c["confidence"])), 3).cast("string").alias("confidence"), F.concat(F.lit("[stub] "), c["category"], F.lit(" failure.")).alias("summary"),
        F.concat(F.lit("[stub] Rules matched: "), matched).alias("root_cause"), text.alias("explanation"), short.alias("is_transient"), short.alias("retry_recommended"), evidence.alias("evidence"), advice.alias("recommendations"),
    )
    usage = F.struct(F.lit("stub").alias("provider"), F.lit("stub-v1").alias("model"), F.floor(F.length(prompt) / 4).cast("int").alias("prompt_tokens"), F.lit(180).alias("completion_tokens"), F.lit(0.0).alias("cost_usd"))
    return df.withColumns({out: value, f"{out}_usage": usage}).drop("__stub")


def salvage(text: Column, schema: str = ANSWER) -> Column:
    """The first JSON object in a text: a fenced block, the outermost braces, or all of it."""
    return F.from_json(salvage_text(text), schema)


def salvage_text(text: Column) -> Column:
    """The JSON text of that object."""
    fenced = F.regexp_extract(text, r"```(?:json)?\s*([\s\S]+?)\s*```", 1)
    braced = F.regexp_extract(text, r"\{[\s\S]*\}", 0)

    def sound(x: Column) -> Column:
        return F.when(F.startswith(F.ltrim(x), F.lit("{")) & F.try_parse_json(x).isNotNull(), x)

    return F.coalesce(sound(fenced), sound(braced), sound(regex.strip(text)))


def error_kind(message: Column) -> Column:
    """struct<kind, code, status, retryable> of a provider's message; credentials are looked for first."""
    low = F.lower(message)

    def row(kind: str, code: str, status: int, retryable: bool) -> Column:
        return F.struct(F.lit(kind).alias("kind"), F.lit(code).alias("code"), F.lit(status).alias("status"), F.lit(retryable).alias("retryable"))

    value = row(*rules.PROVIDER_ERROR_ELSE)
    for kind, code, status, retryable, words in reversed(rules.PROVIDER_ERRORS):
        hit = F.lit(False)
        for word in words:
            hit = hit | F.contains(low, F.lit(word))
        value = F.when(hit, row(kind, code, status, retryable)).otherwise(value)
    return value


#: Errors that aren't told from a message: struct fields of error_kind.
OTHER_ERRORS = (("invalid", "AI_INVALID_RESPONSE", 502, True), ("budget", "AI_BUDGET_EXCEEDED", 402, False))


def error_row(kind: Column, message: Column) -> Column:
    """struct<kind, code, status, retryable, message> of a kind of error; null without one."""
    table = [x[:4] for x in rules.PROVIDER_ERRORS] + [rules.PROVIDER_ERROR_ELSE, *OTHER_ERRORS]
    value = F.lit(None).cast(ERROR)
    for name, code, status, retryable in table:
        value = F.when(kind == name, F.struct(F.lit(name).alias("kind"), F.lit(code).alias("code"), F.lit(status).alias("status"), F.lit(retryable).alias("retryable"), message.alias("message"))).otherwise(value)
    return value


ERROR = "struct<kind:string,code:string,status:int,retryable:boolean,message:string>"
RETRYABLE = ("rate_limit", "timeout", "unavailable")
#: Kinds that a provider tries again by itself before it gives up.
TRIED_AGAIN = ("rate_limit", "timeout")
ATTEMPTS, FIRST_WAIT, LONGEST_WAIT = 3, 2.0, 30.0


class ProviderError(Exception):
    """A provider's failure; kind is as error_kind names it, or "invalid" for an answer that isn't JSON."""

    def __init__(self, kind: str, message: str = "") -> None:
        super().__init__(message or kind)
        self.kind = kind


def kind_of(message: str) -> str:
    """error_kind for one message on a worker."""
    low = message.lower()
    return next((kind for kind, _, _, _, words in rules.PROVIDER_ERRORS if any(x in low for x in words)), rules.PROVIDER_ERROR_ELSE[0])


@dataclass(frozen=True)
class Spec:
    """Which service to ask, as whom, and at what price per 1,000 tokens."""

    kind: str
    model: str = ""
    api_key: str = ""
    base_url: str = ""
    input_cost_per_1k: float = 0.0
    output_cost_per_1k: float = 0.0
    thinking_level: str = ""
    fallback: Spec | None = None


_HTTP_KINDS = {"gemini": "gemini", "ollama": "ollama", "openai": "openai", "openai_compatible": "openai", "azure_openai": "openai"}
_URLS = {"gemini": "https://generativelanguage.googleapis.com/v1beta", "ollama": "http://localhost:11434", "openai": "https://api.openai.com/v1"}


def spec_of(override: str | dict | None, environment: Mapping[str, str] | None = None, allow_environment: bool = True, allow_stub: bool = True) -> Spec:
    """The spec of a request: its own override (JSON or a dict), else the environment's.

    allow_environment: False when a credential is tested, so that no other one answers for it.
    Settings of the environment are named LLM_PROVIDER and, by kind, GEMINI_API_KEY and so on.
    """
    try:
        own = json.loads(override) if isinstance(override, str) and override.strip() else override or {}
    except ValueError:
        raise ProviderError("unavailable", "The provider settings of the request are no JSON.") from None
    if not isinstance(own, dict):
        raise ProviderError("unavailable", "The provider settings of the request are no object.")
    outer = environment or {}
    kind = own.get("provider") or outer.get("LLM_PROVIDER") or "stub"
    if kind == "stub":
        if not allow_stub:
            raise ProviderError("unavailable", "The stub provider isn't allowed here.")
        return Spec("stub")
    if kind not in _HTTP_KINDS:
        raise ProviderError("unavailable", f"Unknown provider: {kind}")
    family = _HTTP_KINDS[kind]

    def setting(name: str, default: str = "", secret: bool = False) -> str:
        return own.get(name) or (outer.get(f"{family}_{name}".upper(), "") if allow_environment or not secret else "") or default

    second = own.get("fallback")
    return Spec(
        family, setting("model"), setting("api_key", secret=True), setting("base_url", _URLS[family]), float(own.get("input_cost_per_1k") or 0), float(own.get("output_cost_per_1k") or 0), setting("thinking_level"),
        spec_of(second, environment, allow_environment, allow_stub) if second else None,
    )


#: Sends JSON and returns what comes back: (url, headers, body or None for a read, seconds).
Transport = Callable[[str, dict, dict | None, float], dict]


def http(url: str, headers: dict, body: dict | None, seconds: float) -> dict:
    from urllib import error, request

    sent = request.Request(url, None if body is None else json.dumps(body).encode(), {"Content-Type": "application/json", **headers})
    try:
        with request.urlopen(sent, timeout=seconds) as answer:
            return json.load(answer)
    except error.HTTPError as e:
        raise OSError(f"{e.code} {e.reason}: {e.read(500).decode(errors='replace')}") from e


class HttpProvider:
    """One of the services that Spec names, asked for JSON in the answer's schema."""

    def __init__(self, spec: Spec, transport: Transport = http, sleep: Callable[[float], None] = time.sleep, seconds: float = 90.0, temperature: float = 0.2, max_tokens: int = 4096) -> None:
        self.spec, self.name = spec, spec.kind
        self.transport, self.sleep, self.seconds = transport, sleep, seconds
        self.temperature, self.max_tokens = temperature, max_tokens

    def _send(self, path: str, body: dict | None) -> dict:
        spec = self.spec
        headers = {"gemini": {"x-goog-api-key": spec.api_key}, "openai": {"Authorization": f"Bearer {spec.api_key}"}}.get(spec.kind, {})
        try:
            return self.transport(spec.base_url.rstrip("/") + path, headers, body, self.seconds)
        except TimeoutError as e:
            raise ProviderError("timeout", str(e)) from e
        except Exception as e:
            raise ProviderError(kind_of(str(e)) if spec.kind != "ollama" or "time" in str(e).lower() else "unavailable", str(e)) from e

    def _once(self, prompt: str) -> Reply:
        spec = self.spec
        schema = json.loads(answer_schema())
        if spec.kind == "gemini":
            options: dict = {"temperature": self.temperature, "maxOutputTokens": self.max_tokens, "responseMimeType": "application/json", "responseSchema": schema}
            if spec.thinking_level:
                options["thinkingConfig"] = {"thinkingLevel": spec.thinking_level}
            got = self._send(f"/models/{spec.model}:generateContent", {"contents": [{"role": "user", "parts": [{"text": prompt}]}], "generationConfig": options})
            parts = (((got.get("candidates") or [{}])[0].get("content") or {}).get("parts")) or []
            used = got.get("usageMetadata") or {}
            # thinking is billed as output but isn't in the text
            reply = Reply("".join(x.get("text", "") for x in parts), spec.model, self.name, used.get("promptTokenCount") or 0, (used.get("candidatesTokenCount") or 0) + (used.get("thoughtsTokenCount") or 0))
        elif spec.kind == "openai":
            body = {"model": spec.model, "messages": [{"role": "user", "content": prompt}], "temperature": self.temperature, "max_tokens": self.max_tokens}
            got = self._send("/chat/completions", body | {"response_format": {"type": "json_schema", "json_schema": {"name": "analysis", "schema": schema, "strict": True}}})
            used = got.get("usage") or {}
            reply = Reply(((got.get("choices") or [{}])[0].get("message") or {}).get("content") or "", spec.model, self.name, used.get("prompt_tokens") or 0, used.get("completion_tokens") or 0)
        else:
            got = self._send("/api/generate", {"model": spec.model, "prompt": prompt, "stream": False, "format": "json", "options": {"temperature": self.temperature, "num_predict": self.max_tokens}})
            reply = Reply(got.get("response") or "", spec.model, self.name, int(got.get("prompt_eval_count") or 0), int(got.get("eval_count") or 0))
        if "{" not in reply.text:
            raise ProviderError("invalid", f"no JSON in the answer: {reply.text[:200]}")
        return reply

    def ask(self, prompt: str) -> Reply:
        wait = FIRST_WAIT
        for left in range(ATTEMPTS - 1, -1, -1):
            try:
                return self._once(prompt)
            except ProviderError as e:
                if e.kind not in TRIED_AGAIN or self.spec.kind == "ollama" or not left:
                    raise
            self.sleep(wait)
            wait = min(LONGEST_WAIT, wait * 2)
        raise AssertionError

    def cost(self, prompt_tokens: int, completion_tokens: int) -> float:
        return round(prompt_tokens / 1000 * self.spec.input_cost_per_1k + completion_tokens / 1000 * self.spec.output_cost_per_1k, 6)

    def models(self) -> list[str]:
        """What the credential may use."""
        got = self._send({"gemini": "/models", "openai": "/models", "ollama": "/api/tags"}[self.spec.kind], None)
        rows = got.get("models") or got.get("data") or []
        return sorted((x.get("name") or x.get("id") or "").removeprefix("models/") for x in rows)


class CannedProvider:
    """Answers without a service, for tests and where none is set up."""

    name = "stub"

    def ask(self, prompt: str) -> Reply:
        return Reply('{"category": null, "summary": "[stub] No model was asked.", "confidence": "0.45"}', "stub-v1", self.name, len(prompt) // 4, 180)

    def cost(self, prompt_tokens: int, completion_tokens: int) -> float:
        return 0.0

    def models(self) -> list[str]:
        return ["stub-v1"]


class FallbackProvider:
    """The second provider answers where the first is out, slow or over its rate, never where a credential is wrong.

    Its replies say from which provider they fell back, and cost what the first one's would.
    """

    def __init__(self, first: Provider, second: Provider) -> None:
        self.first, self.second, self.name = first, second, first.name

    def ask(self, prompt: str) -> Reply:
        try:
            return self.first.ask(prompt)
        except ProviderError as error:
            if error.kind not in RETRYABLE:
                raise
            return replace(self.second.ask(prompt), fell_back_from=self.first.name)

    def cost(self, prompt_tokens: int, completion_tokens: int) -> float:
        return self.first.cost(prompt_tokens, completion_tokens)


def provider_of(spec: Spec, transport: Transport = http, sleep: Callable[[float], None] = time.sleep) -> Provider:
    """The provider that a spec names, with its fallback if it has one."""
    first = CannedProvider() if spec.kind == "stub" else HttpProvider(spec, transport, sleep)
    return FallbackProvider(first, provider_of(spec.fallback, transport, sleep)) if spec.fallback else first


CHECK = "ok boolean, provider string, model string, models array<string>, message string, latency_ms long"


def verify(spec: Spec, transport: Transport = http) -> dict:
    """Whether a spec's service accepts its credential and has its model, and whether a small question is answered."""
    began = time.monotonic()

    def record(ok: bool, names: list[str], message: str) -> dict:
        return {"ok": ok, "provider": spec.kind, "model": spec.model, "models": names, "message": message, "latency_ms": int((time.monotonic() - began) * 1000)}

    provider = provider_of(replace(spec, fallback=None), transport, lambda _: None)
    names: list[str] = []
    try:
        names = provider.models()
        if spec.model and spec.model not in names and f"{spec.model}:latest" not in names:
            found = record(False, names, f"The credential works, but it has no model '{spec.model}'.")
        else:
            provider.ask('Answer {"category": "UNKNOWN"} and nothing else.')
            found = record(True, names, f"Connected. '{spec.model or provider.name}' answered.")
    except ProviderError as e:
        found = record(False, names, str(e))
    if found["ok"] or spec.fallback is None:
        return found
    second = verify(spec.fallback, transport)
    if not second["ok"]:
        return found
    # the first one's failure isn't hidden behind the second
    return second | {"provider": f"{spec.kind} -> {spec.fallback.kind}", "message": f"{spec.kind} can't be used ({found['message']}); {spec.fallback.kind} will answer instead."}


def verify_rows(df: DataFrame, override: str, transport: Transport = http, environment: Mapping[str, str] | None = None) -> DataFrame:
    """Adds struct `check` of each row's provider settings (JSON); the environment's credentials never stand in."""
    from cinderlog.workers import workers_find_package

    @F.pandas_udf(CHECK)
    def run(parts: pd.Series) -> pd.DataFrame:
        out = []
        for x in parts:
            try:
                out.append(verify(spec_of(x, environment, allow_environment=False), transport))
            except ProviderError as e:
                out.append({"ok": False, "provider": None, "model": None, "models": [], "message": str(e), "latency_ms": 0})
        return pd.DataFrame(out, columns=["ok", "provider", "model", "models", "message", "latency_ms"])

    workers_find_package(df.sparkSession)
    return df.withColumn("check", run(F.col(override)))


REPLY = "text string, provider string, model string, prompt_tokens int, completion_tokens int, cost_usd double, fell_back_from string, error_kind string, error_message string"


def answered(make: Callable[[str | None], Provider], made: dict, override: str | None, prompt: str) -> tuple:
    """One row of REPLY; a provider's failure is a row with error_kind, never a failed job."""
    try:
        if override not in made:
            made[override] = make(override)
        r = made[override].ask(prompt)
        return (r.text, r.provider or made[override].name, r.model, r.prompt_tokens, r.completion_tokens, made[override].cost(r.prompt_tokens, r.completion_tokens), r.fell_back_from, None, None)
    except ProviderError as e:
        kind, message = e.kind, str(e)
    except Exception as e:  # noqa: BLE001
        kind, message = kind_of(str(e)), str(e)
    return (None, getattr(made.get(override), "name", None), None, 0, 0, 0.0, None, kind, message[:500])


def complete(df: DataFrame, prompt: str, make: Callable[[str | None], Provider], out: str = "reply", override: str | None = None) -> DataFrame:
    """Adds struct `out` (REPLY) of real providers' answers. Rows that need none must be filtered out before.

    make: a provider for a row's override, called once a task for each different one.
    """
    from cinderlog.workers import workers_find_package

    names = [x.split()[0] for x in REPLY.split(", ")]

    @F.pandas_udf(REPLY)
    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        made: dict = {}
        for prompts, overrides in parts:
            rows = [answered(make, made, o or None, p or "") for p, o in zip(prompts, overrides, strict=True)]
            yield pd.DataFrame(rows, columns=names)

    workers_find_package(df.sparkSession)
    return df.withColumn(out, run(F.col(prompt), F.col(override) if override else F.lit("")))


def answer_schema() -> str:
    """The answer's JSON schema, for services that can be held to one."""
    text, number, flag = {"type": "string"}, {"type": "number"}, {"type": "boolean"}

    def one_of(values: Iterable[str]) -> dict:
        return {"type": "string", "enum": sorted(values)}

    def listed(required: list[str], **fields: dict) -> dict:
        return {"type": "array", "items": {"type": "object", "required": required, "properties": fields}}

    schema = {
        "type": "object", "required": rules.ANSWER_REQUIRED,
        "properties": {
            "category": one_of([*rules.CATEGORIES, "UNKNOWN"]), "subcategory": text, "severity": one_of(rules.RISKS), "confidence": number, "summary": text, "root_cause": text, "explanation": text, "is_transient": flag, "retry_recommended": flag,
            "evidence": listed(["type", "content"], type=one_of(rules.EVIDENCE_TYPES), content=text, source_ref=text, line_number={"type": "integer"}, weight=number),
            "recommendations": listed(["title", "action_type"], title=text, description=text, rationale=text, action_type=one_of(rules.ACTION_RISK), confidence=number, affected_files={"type": "array", "items": text}, patch=text),
        },
    }
    return json.dumps(schema, sort_keys=True)
