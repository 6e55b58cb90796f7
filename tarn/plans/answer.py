"""From a question to an answer with checked citations, or to a refusal, over ranked jobs."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from tarn.functions import lexicon as L

# Answers that refuse.
OUT_OF_SCOPE = "这个知识库只包含招聘岗位信息，无法回答该问题。"
NO_AMOUNT = "岗位描述未提供具体薪资金额，知识库证据不足，无法判断。"


def intent(question: str) -> str:
    """refusal before global_aggregate before aggregate; else evidence."""
    return next((name for name, p in L.ROUTES if re.search(p, question.strip())), "evidence")


def check_citations(answer: str, sources: int) -> dict:
    cited = sorted({int(n) for n in re.findall(r"\[(\d+)\]", answer)})
    good = [n for n in cited if 1 <= n <= sources]
    return {"valid": good, "invalid": [n for n in cited if n not in good], "passed": bool(good) and len(good) == len(cited)}


def pay_refusal(question: str, texts: list[str]) -> str | None:
    """Why a question about pay cannot be answered from these texts, or None."""
    if not re.search(L.PAY_QUESTION, question):
        return None
    n = sum(any(re.search(p, t) for p in L.PAY_AMOUNTS) for t in texts)
    if not n:
        return NO_AMOUNT
    if re.search(L.PAY_COMPARISON, question) and n < max(len(texts), 2):
        return f"仅 {n}/{len(texts)} 个相关岗位提供具体薪资金额，其余岗位信息不全，无法可靠比较高低。"
    return None


@dataclass
class Answer:
    text: str
    intent: str
    sources: list[dict] = field(default_factory=list)
    statistics: list[dict] | None = None
    validation: dict | None = None
    telemetry: dict | None = None


def evidence_context(jobs: list[dict]) -> str:
    """Numbered evidence: a header and the chunks of each job."""
    return "\n\n".join(f"[{i}] {j['title']} / {j.get('company') or '-'}\n" + "\n".join(j["chunks"]) for i, j in enumerate(jobs, 1))


def statistics_context(rows: list[dict], total: int) -> str:
    return "\n".join([f"[统计] {total}", *(f"- {r['skill']}: {r['jobs']} ({r['percentage']}%)" for r in rows)])


def extract(jobs: list[dict], statistics: list[dict] | None) -> str:
    """An answer that only quotes what was found; stands in for a model, and for a model whose citations fail."""
    if statistics is not None:
        number = {j["job_id"]: i for i, j in enumerate(jobs, 1)}
        return "\n".join(f"- {r['skill']}: {r['jobs']}/{len(jobs)} ({r['percentage']}%)" + "".join(f"[{number[i]}]" for i in r.get("job_ids") or [] if i in number) for r in statistics[:8])
    return "\n".join(f"- {j['title']} ({j.get('company') or '-'}) [{i}]" for i, j in enumerate(jobs[:5], 1))


def compose(question: str, jobs: list[dict], statistics: list[dict] | None, generate: Callable[[str, str], str] | None = None) -> Answer:
    """The answer to a question from its ranked jobs (job_id, title, company, chunks) and their statistics.

    generate(question, context) may be a language model; an answer whose citations fail is replaced by extract().
    """
    kind = intent(question)
    if kind == "refusal" or not jobs:
        return Answer(OUT_OF_SCOPE, "refusal")
    why = pay_refusal(question, ["\n".join(j["chunks"]) for j in jobs])
    if why:
        return Answer(why, "refusal", jobs, statistics)
    context = evidence_context(jobs) + ("\n\n" + statistics_context(statistics, len(jobs)) if statistics else "")
    text = generate(question, context) if generate else extract(jobs, statistics)
    found = check_citations(text, len(jobs))
    if not found["passed"]:
        text, found = extract(jobs, statistics), found | {"fallback": True}
    return Answer(text, kind, jobs, statistics, found)
