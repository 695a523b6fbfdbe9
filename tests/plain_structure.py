"""The structural parser once more, as loops over one text, to compare the relational one with."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from corpusloom.functions.text import CHARS_PER_TOKEN
from corpusloom.operators.chunking import MAX_TOKENS, MIN_TOKENS, OVERLAP_TOKENS, merge_small
from corpusloom.operators.structure import ANNEX, ANNEX_HEADING, ARTICLE, DEFINITION_MARK, EU_HEADINGS, LABEL, LAW_HEADINGS, PARAGRAPH_MARK, PREAMBLE, RECITAL, RECITAL_MARK, Source


@dataclass
class Passage:
    text: str
    kind: str
    path: str
    fields: dict = field(default_factory=dict)
    #: The path as headers show it, where it differs.
    shown: str = ""


def tokens(text: str) -> int:
    return len(text) // CHARS_PER_TOKEN


def cleaned(text: str, footers: tuple[str, ...] = ()) -> str:
    for f in footers:
        text = re.sub(f, "", text)
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"(\w)-\s*\n\s*(\w)", r"\1\2", text)).strip()


def stretches(text: str, mark: str) -> tuple[str, list[tuple[re.Match, str]]]:
    """The text before the first mark, and each mark with what follows it up to the next."""
    found = list(re.finditer(mark, text, re.M))
    if not found:
        return text, []
    ends = [m.start() for m in found[1:]] + [len(text)]
    return text[: found[0].start()], [(m, text[m.end() : e]) for m, e in zip(found, ends, strict=True)]


def packed(text: str, budget: int = MAX_TOKENS, overlap: int = OVERLAP_TOKENS) -> list[str]:
    """Sentences filled into chunks of at most budget tokens, each next one with the last sentences that fit the overlap."""
    parts = [p for s in re.split(r"(?<=[.;:])\s+|\n{2,}", text) if (p := s.strip())]
    out, start = [], 0
    sums = [0]
    for p in parts:
        sums.append(sums[-1] + tokens(p))
    opened = 0
    for i in range(len(parts)):
        if i > opened and sums[i + 1] - sums[start] > budget:
            out.append(" ".join(parts[start:i]))
            opened, start = i, next(j for j in range(start, i + 1) if sums[i] - sums[j] <= overlap)
    return out + [" ".join(parts[start:])] if parts else out


def within_budget(p: Passage) -> list[Passage]:
    if tokens(p.text) <= MAX_TOKENS:
        return [p]
    parts = packed(p.text)
    if len(parts) < 2:
        return [Passage(t, p.kind, p.path, p.fields, p.shown) for t in parts]
    return [Passage(t, p.kind, f"{p.path} (deel {i}/{len(parts)})", p.fields) for i, t in enumerate(parts, 1)]


def recitals(text: str) -> list[Passage]:
    """Numbered recitals; of several marks of a number the last counts, and text before the first is no recital."""
    last: dict[int, re.Match] = {}
    for m in re.finditer(RECITAL_MARK, text, re.M):
        last[int(m[1] or m[2])] = m
    marks = sorted(last.items(), key=lambda x: x[1].start())
    ends = [m.start() for _, m in marks[1:]] + [len(text)] * bool(marks)
    found = [Passage(text[m.end() : e].strip(), RECITAL, f"Overwegingen > ({n})", {"paragraph_number": n}, f"Overwegingen > Overweging ({n})") for (n, m), e in zip(marks, ends, strict=True)]
    return [q for p in found for q in within_budget(p)]


def _paragraphs(p: Passage, mark: str) -> list[Passage]:
    """The passage, or its numbered paragraphs if it is too long and has several; what stands before the first goes with it."""
    intro, parts = stretches(p.text, mark)
    if tokens(p.text) <= MAX_TOKENS or len(parts) < 2:
        return within_budget(p)
    out = []
    for k, (m, body) in enumerate(parts):
        text = (m[0] + body).strip()
        if k == 0 and intro.strip():
            text = f"{intro.strip()}\n\n{text}"
        out += within_budget(Passage(text, p.kind, f"{p.path} > Lid {m[1]}", p.fields | {"paragraph_number": int(m[1])}))
    return out


def _definitions(p: Passage) -> list[Passage]:
    """Items of a definitions article; a small one joins the passage before. An article without items gives nothing."""
    intro, parts = stretches(p.text, DEFINITION_MARK)
    intro = intro.strip()
    out = [Passage(intro, p.kind, f"{p.path} > Inleiding", p.fields)] if parts and tokens(intro) >= MIN_TOKENS else []
    for m, body in parts:
        text = (m[0] + body).strip()
        item = Passage(text, p.kind, f"{p.path} > Definitie {m[1]}", p.fields | {"paragraph_number": int(m[1])})
        if out and tokens(text) < MIN_TOKENS:
            before = out[-1]
            out[-1] = Passage(f"{before.text}\n\n{text}", before.kind, f"{before.path}, {m[1]}", before.fields, before.shown or before.path)
        else:
            out.append(item)
    return out


def articles(text: str, source: Source) -> list[Passage]:
    """Articles with the chapter and section that hold at their heading. In a regulation the title is the body's first line, in a law it stands in the heading."""
    eu = source.layout == "eu"
    headings, label = EU_HEADINGS if eu else LAW_HEADINGS, LABEL[source.layout]
    marks = sorted(((m.start(), kind, m) for kind, rx in headings.items() for m in re.finditer(rx, text, re.M)), key=lambda x: x[0])
    state = {"chapter": "", "chapter_number": "", "section": ""}
    out: list[Passage] = []
    for k, (_, kind, m) in enumerate(marks):
        if kind != "article":
            number, title = m[1].strip(), m[2].strip()
            if kind == "chapter":
                state = {"chapter": f"{label[kind].format(number)} — {re.sub(r'\s+', ' ', title) if eu else title}", "chapter_number": number, "section": ""}
            else:
                state = state | {"section": f"{label[kind].format(number)} — {title}"}
            continue
        # A section's heading does not close the article before it.
        end = next((at for at, other, _ in marks[k + 1 :] if other != "section"), len(text))
        body = text[m.end() : end].strip()
        title = body.partition("\n")[0].strip() if eu else m[2].strip()
        own = f"Artikel {m[1]} — {title}" if title or not eu else f"Artikel {m[1]}"
        lead = [state["chapter"]] if eu or state["chapter"] else []
        path = " > ".join([*lead, *([state["section"]] if state["section"] else []), own])
        n = int(re.match(r"\d+", m[1])[0])
        p = Passage(body, ARTICLE, path, state | {"article_number": n, "article_title": title})
        out += _definitions(p) if eu and n == source.definitions_article else _paragraphs(p, PARAGRAPH_MARK[source.layout])
    return out


def annexes(text: str) -> list[Passage]:
    """Annexes; the line below an annex's heading is its title and no part of its text."""
    out = []
    for m, body in stretches(text, ANNEX_HEADING)[1]:
        title = (m[2] or "").strip()
        path = f"Bijlage {m[1]} — {title}" if title else f"Bijlage {m[1]}"
        out += within_budget(Passage(body.strip(), ANNEX, path, {"annex_number": m[1], "annex_title": title}))
    return out


def regions(text: str, source: Source) -> tuple[str, str, str]:
    """What comes before the articles, the articles, and the annexes."""
    if source.layout == "law":
        m = re.search(LAW_HEADINGS["chapter"], text, re.M)
        at = m.start() if m else 0
        return text[:at], text[at:], ""
    first = re.search(r"^Artikel\s+1\s*$", text, re.M)
    at = 0
    if first:
        chapter = text.rfind("HOOFDSTUK I", 0, first.start())
        at = chapter if chapter >= 0 else first.start()
    end = re.search(r"^BIJLAGE\s+I\s*$", text, re.M) if source.annexes else None
    stop = end.start() if end else len(text)
    return text[:at], text[at:stop], text[stop:]


def passages(text: str, source: Source) -> list[dict]:
    """A document's chunks, small ones merged and numbered from 0."""
    if source.layout == "law":  # plain text: only footers go
        for f in source.footers:
            text = re.sub(f, "", text)
    else:
        text = cleaned(text, source.footers)
    if source.end_marker and source.end_marker in text:
        text = text[: text.index(source.end_marker)].strip()
    head, body, tail = regions(text, source)
    if source.layout == "law":
        found = within_budget(Passage(head.strip(), PREAMBLE, "Preambule")) if tokens(head.strip()) >= MIN_TOKENS else []
    else:
        found = recitals(head)
    found += articles(body, source) + annexes(tail)
    rows = [
        {"text": p.text, "tokens": tokens(p.text), "section_type": p.kind, "hierarchy_path": p.path, "context_header": f"{source.display} > {p.shown or p.path}:"}
        | {k: p.fields.get(k, "") for k in ("chapter", "chapter_number", "section", "article_title", "annex_number", "annex_title")}
        | {k: p.fields.get(k) for k in ("article_number", "paragraph_number")}
        for p in found
    ]
    return [r | {"source": source.label, "chunk_id": i, "token_estimate": r["tokens"]} for i, r in enumerate(merge_small(rows))]
