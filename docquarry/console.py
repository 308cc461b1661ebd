"""What a person at a console sees of contexts, answers and findings; a handful of rows each."""

from __future__ import annotations

from pyspark.sql import DataFrame


def context_lines(contexts: DataFrame, most: int = 20, chars: int = 300) -> list[str]:
    """Two lines for each context of a question, best first."""
    out = []
    for r in contexts.orderBy("query_id", "rank").limit(most).collect():
        score = "pinned" if r["pinned"] else "no score" if r["rerank_score"] is None else f"{r['rerank_score']:+.2f}"
        out += [f"{r['query_id']} #{r['rank']} {r['parent_id']} ({score})", "    " + " ".join((r["context"] or "").split())[:chars]]
    return out or ["I don't know: nothing relevant was found."]


def answer_lines(answers: DataFrame, most: int = 20) -> list[str]:
    """A question's answer or refusal, its citations, and numbers that need review."""
    out = []
    for r in answers.orderBy("query_id").limit(most).collect():
        out += [f"Q: {r['question']}", f"A: {r['text']}" + (f" ({r['refusal_reason']})" if r["refused"] else "")]
        out += [f"    [{c['label']}] {c['citation'] or c['source']}" for c in r["citations"]]
        out += [f"    check {f['raw']}: found in {', '.join(f['found_in']) or 'no source'}" for f in r["flagged"]]
    return out


def finding_lines(findings: DataFrame, most: int = 50) -> list[str]:
    """Findings that wait for a decision."""
    return [f"{r['item_id']}: {r['outcome']} ({r['outcome_reason']})" for r in findings.orderBy("item_id").limit(most).collect()]


def decide(findings: DataFrame, ask) -> list[tuple[str, int, str, str | None, str | None]]:
    """Decisions (item_id, pos, action, outcome, note) for findings that wait; ask(line) gives 'approve', or 'edit <outcome> [note]'."""
    out = []
    for pos, r in enumerate(findings.orderBy("item_id").collect()):
        words = ask(f"{r['item_id']}: {r['outcome']} ({r['outcome_reason']})").split(None, 2)
        out.append((r["item_id"], pos, words[0] if words else "", words[1] if len(words) > 1 else None, words[2] if len(words) > 2 else None))
    return out
