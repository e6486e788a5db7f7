"""Language-model providers: the protocol, a deterministic stand-in, and one that asks a service over HTTP; answers are parsed the same way."""

from __future__ import annotations

import json
import re
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class LlmProvider(Protocol):
    def complete(self, prompt: str) -> str: ...

    def propose(self, rows: Sequence[tuple[str, str]]) -> list[dict]: ...

    def validate(self, content: str, known: Sequence[str]) -> dict: ...


WAVE = 8


def complete_batch(provider: LlmProvider, prompts: Sequence[str]) -> list[str]:
    return [provider.complete(p) for p in prompts]


def complete_parallel(provider: LlmProvider, prompts: Sequence[str], wave: int = WAVE) -> list[str]:
    """Answers in the order of the prompts, `wave` of which are asked at a time by threads of the task."""
    with ThreadPoolExecutor(wave) as pool:
        return [a for at in range(0, len(prompts), wave) for a in pool.map(provider.complete, prompts[at : at + wave])]


class MockProvider:
    """Proposes one insight a cluster, accepts all, and answers with one proposition a text."""

    def complete(self, prompt: str) -> str:
        return json.dumps({"propositions": [{"text": prompt.strip().splitlines()[-1][:200] if prompt.strip() else "", "confidence": 0.9}], "entities": [], "relations": []})

    def propose(self, rows: Sequence[tuple[str, str]]) -> list[dict]:
        return [{"content": f"{len(rows)} memories agree: {rows[0][1]}", "confidence": 0.85, "sources": [r[0] for r in rows], "tags": ["mock"]}]

    def validate(self, content: str, known: Sequence[str]) -> dict:
        return {"verdict": "merged" if content in known else "accepted", "confidence": 0.85}


def post_json(url: str, headers: dict[str, str], body: dict, timeout: float = 60.0) -> dict:
    request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json", **headers})
    with urllib.request.urlopen(request, timeout=timeout) as answer:
        return json.load(answer)


def with_retries(call: Callable[[], dict], attempts: int = 3, pause: float = 0.5) -> dict:
    """call's result; it is called again after a pause that doubles if the connection fails or the service is overloaded."""
    for k in range(attempts):
        try:
            return call()
        except urllib.error.HTTPError as e:
            if (e.code != 429 and e.code < 500) or k == attempts - 1:
                raise
        except OSError:
            if k == attempts - 1:
                raise
        time.sleep(pause * 2**k)
    raise AssertionError


#: What a service wants to be asked, and where its answer stands.
STYLES: dict[str, tuple[Callable[[str, str, int], dict], Callable[[dict], str]]] = {
    "messages": (lambda model, prompt, most: {"model": model, "max_tokens": most, "messages": [{"role": "user", "content": prompt}]}, lambda a: "".join(x.get("text", "") for x in a["content"])),
    "chat": (lambda model, prompt, most: {"model": model, "max_tokens": most, "messages": [{"role": "user", "content": prompt}]}, lambda a: a["choices"][0]["message"]["content"]),
    "parts": (lambda model, prompt, most: {"contents": [{"parts": [{"text": prompt}]}], "generationConfig": {"maxOutputTokens": most}}, lambda a: "".join(x.get("text", "") for x in a["candidates"][0]["content"]["parts"])),
    "generate": (lambda model, prompt, most: {"model": model, "prompt": prompt, "stream": False, "options": {"num_predict": most}}, lambda a: a["response"]),
}


@dataclass
class HttpProvider:
    """A service that answers prompts over HTTP, in one of STYLES. `post` sends a body and returns the parsed answer."""

    url: str
    model: str
    style: str = "chat"
    headers: dict[str, str] = field(default_factory=dict)
    most: int = 2048
    post: Callable[[str, dict[str, str], dict], dict] = post_json

    def complete(self, prompt: str) -> str:
        ask, read = STYLES[self.style]
        return read(with_retries(lambda: self.post(self.url, self.headers, ask(self.model, prompt, self.most))))

    def propose(self, rows: Sequence[tuple[str, str]]) -> list[dict]:
        found = json.loads(json_of(self.complete(proposal_prompt(rows))))
        return [{"content": p["content"], "confidence": float(p.get("confidence", 0.5)), "sources": p.get("sources", []), "tags": p.get("tags", [])} for p in found.get("insights", []) if p.get("content")]

    def validate(self, content: str, known: Sequence[str]) -> dict:
        found = json.loads(json_of(self.complete(validation_prompt(content, known))))
        return {"verdict": "rejected", "confidence": 0.0} | found


PROPOSITIONS = "struct<propositions: array<struct<text: string, confidence: double>>, entities: array<struct<name: string, type: string>>, relations: array<struct<source: string, target: string, type: string>>>"
VERDICT = "struct<verdict: string, confidence: double, reasoning: string>"


def json_of(answer: str) -> str:
    """The JSON object in an answer that may stand in a code fence or between words."""
    m = re.search(r"\{.*\}", answer, re.DOTALL)
    return m.group(0) if m else "{}"


def parse(answers: DataFrame, column: str, schema: str = PROPOSITIONS) -> DataFrame:
    return answers.withColumn("parsed", F.from_json(column, schema))


def map_prompts(df: DataFrame, prompt_col: str, provider: LlmProvider) -> DataFrame:
    """df with the column `answer`: one provider a task, one batch at a time."""
    schema = df.schema

    def run(batches: Iterator) -> Iterator:
        for pdf in batches:
            pdf["answer"] = [json_of(a) for a in complete_parallel(provider, pdf[prompt_col].fillna("").tolist())]
            yield pdf

    return df.mapInPandas(run, f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in schema)}, answer string")


def extraction_prompt(title: str, text: str) -> str:
    return f"Extract propositions, entities and relations as JSON.\n# {title}\n{text}"


def contradiction_prompt(a: str, b: str) -> str:
    return f"Do these statements contradict, revise or agree? Answer as JSON with verdict and confidence.\nA: {a}\nB: {b}"


def within_budget(rows: Sequence[tuple[str, str]], token_budget: int = 4000) -> list[tuple[str, str]]:
    """Memories in the order given, until the budget of four characters a token is spent; the first in any case."""
    kept, left = [], 4 * token_budget
    for i, (memory_id, content) in enumerate(rows):
        size = len(memory_id) + len(content) + 3
        if i and size > left:
            break
        kept.append((memory_id, content))
        left -= size
    return kept


def proposal_prompt(rows: Sequence[tuple[str, str]], token_budget: int = 4000) -> str:
    lines = [f"[{memory_id}] {content}" for memory_id, content in within_budget(rows, token_budget)]
    return "Consolidate these memories into insights. Answer as JSON: insights, each with content, confidence, sources and tags.\n" + "\n".join(lines)


def summary_prompt(title: str, text: str) -> str:
    return f"Summarise this note in a few sentences. Answer as JSON with summary.\n# {title}\n{text}"


def summarize(notes: DataFrame, provider: LlmProvider) -> DataFrame:
    """(file_path, summary) of notes (file_path, content); null where the answer holds none."""
    prompt = F.concat(F.lit(summary_prompt("", "").split("#")[0] + "# "), F.col("file_path"), F.lit("\n"), F.col("content"))
    return parse(map_prompts(notes.select("file_path", prompt.alias("prompt")), "prompt", provider), "answer", "struct<summary: string>").select("file_path", F.col("parsed.summary").alias("summary"))


def validation_prompt(content: str, known: Sequence[str]) -> str:
    return "Is this insight new and supported? Answer as JSON.\n" + content + "\nKnown:\n" + "\n".join(known)
