"""Lines for a console, from collected rows."""

from __future__ import annotations

import textwrap
from collections.abc import Iterable


def load_lines(rows: Iterable) -> list[str]:
    """Of a load report: one tenant after another."""
    out = []
    for r in rows:
        if r["refused"]:
            out.append(f"  {r['domain']}: refused, {r['refused']}")
            continue
        counts = ", ".join(f"{r[c] or 0} {c}" for c in ("inserted", "updated", "unchanged", "reordered", "relabelled"))
        out.append(f"  {r['domain']}: {counts}; {len(r['removed'] or [])} removed" + (f"; {r['held']}" if r["held"] else ""))
        out += [f"    {url}" for url in r["removed"] or []]
    return out


def embed_lines(counts, model: str, over_window: int, price: float | None) -> list[str]:
    lines = [f"  chunks {counts['chunks']}, embedded {counts['embedded']}, pending tokens {counts['pending_tokens']:,}", f"  model {model}"]
    if over_window:
        lines.append(f"  {over_window} inputs are longer than the model reads; the rest of them is not embedded")
    return lines + ([f"  cost {price:.4f} $"] if price is not None else [])


def hit_lines(hits: Iterable, width: int = 100) -> list[str]:
    """Of ranked hits, their scores in sight."""
    out = []
    for n, h in enumerate(hits, 1):
        out += [f"  {n:>3}  {h['score']:.4f}  [{h['kind']}]  {h['source_url']}", "       " + textwrap.shorten(" ".join(h["content"].split()), width, placeholder=" …")]
    return out or ["  nothing was retrieved"]


def answer_lines(answer) -> list[str]:
    cites = [f"[{n}]" for n in answer.passages] + ["[S]"] * answer.cites_signals
    return [
        f"  question: {answer.question}", *(f"  {line}" for line in textwrap.wrap(answer.text, 90) or ["(empty)"]), f"  cites: {', '.join(cites) or 'nothing'}",
        f"  checks: {'declined' if answer.declined else 'answered'}; {'; '.join(answer.problems) or 'no detectable problem'}",
        f"  model {answer.model}, {answer.prompt_version}, {answer.seconds:.1f} s",
    ]


def share(value: float | None) -> str:
    return "not measured" if value is None else f"{value:.2f}"


def run_lines(pairs: Iterable, recall: Iterable, coverage: Iterable, signals: Iterable) -> list[str]:
    """Of an evaluation: statuses, recall at each cut-off, missing sources with their reason, signals."""
    out = [f"  {p['domain']} {p['question_id']}: {p['status']}" for p in pairs]
    out += [f"  recall@{r['k']}: {share(r['recall'])} of {r['scored']}" for r in recall] or ["  recall: not measured"]
    for c in coverage:
        if c["state"] != "present":
            out.append(f"  missing source {c['url']}: {c['outcome'] or 'never attempted'}")
    for s in signals:
        out.append(f"  {s['domain']} signals: {share(s['accuracy'])} of {s['compared']}" + (f", wrong: {', '.join(s['mismatches'])}" if s["mismatches"] else ""))
    return out


def document_lines(documents: Iterable) -> list[str]:
    return [f"  [{d['kind']}] {len((d['text'] or '').split()):>6} words  {d['url']}  {d['title'] or ''}".rstrip() for d in documents] or ["  no document"]


def text_lines(document, width: int = 90) -> list[str]:
    return [line for part in (document["text"] or "").splitlines() for line in textwrap.wrap(part, width) or [""]]


def validation_lines(report) -> list[str]:
    out = [f"  {f.severity}: {f.file} {f.where} {f.message}" for f in report.findings]
    return [*out, f"  files {report.files}, pairs {report.pairs}, insufficient evidence {report.insufficient}", f"  {len(report.errors)} to fix" if report.errors else "  structurally valid"]
