"""Structured legal texts to passages: regions, headings with the state they set, bodies, paragraphs, definitions and annexes.

A text's headings are a relation: each kind's matches and the stretches between them give the offsets at which they begin and end. A heading's body ends at the next heading that closes it, and what a heading
sets (chapter, section) holds until the next one of its kind; both are windows over a document's headings. Bodies are then cut at their marks, packed into the budget, and small ones merged.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import clean_page, sentences, strip, token_estimate
from corpusloom.operators.chunking import MAX_TOKENS, MIN_TOKENS, merge_small, pack
from corpusloom.sources.tables import materialize

CHUNK = "source string, chunk_id long, text string, section_type string, chapter string, chapter_number string, section string, article_number int, article_title string, paragraph_number int, annex_number string, annex_title string, hierarchy_path string, token_estimate int, context_header string"

# Names of kinds of passages, words of their paths, and the headings and marks of the two formats, in which a line ends at a line feed only.
RECITAL, ARTICLE, ANNEX, PREAMBLE = "overweging", "artikel", "bijlage", "preambule"
EU_HEADINGS = {
    "chapter": r"(HOOFDSTUK\s+[IVXLC]+)\s*\n\s*((?![Aa][Ff][Dd][Ee][Ll][Ii][Nn][Gg])[A-Z][A-Z\- ,À-Þ]{2,}(?:\n(?![Aa][Ff][Dd][Ee][Ll][Ii][Nn][Gg])[A-Z][A-Z\- ,À-Þ]{2,})*)",
    "section": r"(Afdeling\s+\d+)\s*\n\s*(.+?)(?=\n)",
    "article": r"^Artikel\s+(\d+)\s*$",
}
LAW_HEADINGS = {
    "chapter": r"^Hoofdstuk\s+(\d+)\.\s+(.+)$",
    "section": r"^Paragraaf\s+([\d.]+)\.\s+(.+)$",
    "article": r"^Artikel\s+(\d+[a-z]?)\.\s+(.+)$",
}
RECITAL_MARK = r"^\((\d+)\)\s*$|^\((\d+)\)\s+(?=[A-Z])"
ANNEX_HEADING = r"^BIJLAGE\s+([IVXLC]+)\s*(?:\n(.+?))?(?=\n)"
DEFINITION_MARK = r"^(\d+)\)"
PARAGRAPH_MARK = {"eu": r"^(\d+)\.\s*$", "law": r"^(\d+)\.\t"}
LABEL = {"eu": {"chapter": "{}", "section": "{}"}, "law": {"chapter": "Hoofdstuk {}", "section": "Paragraaf {}"}}


@dataclass(frozen=True)
class Source:
    """What is known of a source: how its texts are laid out and how they are cleaned."""

    label: str
    display: str
    layout: str = "eu"
    footers: tuple[str, ...] = ()
    definitions_article: int | None = None
    annexes: bool = False
    end_marker: str | None = None


#: Unicode classes, lines that end at a line feed, and marks at the beginning of any line.
_FLAGS = "(?Udm)"
_FIELDS = ("chapter", "chapter_number", "section", "article_title", "annex_number", "annex_title")
_PASSAGE = ("doc", "part", "seat", "text", "section_type", "path", "shown", *_FIELDS, "article_number", "paragraph_number")


def _between(text: Column, mark: str) -> Column:
    """The stretches before, between and behind the matches of a mark."""
    return F.split(text, _FLAGS + mark, -1)


def _all(text: Column, mark: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(_FLAGS + mark), F.lit(group))


def _cut(text: Column, at: Column, to: Column | None = None) -> Column:
    """Code points [at, to) of a text, none if to is before at."""
    return F.substring(text, at + 1, F.greatest(F.lit(0), (F.length(text) if to is None else to) - at))


def _marks(docs: DataFrame, text: str, kinds: dict[str, str], groups: int) -> DataFrame:
    """doc, kind, at, to, g1 .. of all matches of each kind's pattern in a column of docs, with the code points at which they begin and end."""

    def of(kind: str, pattern: str) -> DataFrame:
        parts = {"gap": _between(F.col(text), pattern), "whole": _all(F.col(text), pattern)} | {f"g{i}": _all(F.col(text), pattern, i) for i in range(1, groups + 1)}
        each = docs.select("doc", F.posexplode(F.arrays_zip(*[v.alias(n) for n, v in parts.items()])).alias("n", "m")).where("m.whole is not null")
        to = F.sum(F.length("m.gap") + F.length("m.whole")).over(Window.partitionBy("doc").orderBy("n").rowsBetween(Window.unboundedPreceding, 0))
        return each.select("doc", F.lit(kind).alias("kind"), (to - F.length("m.whole")).alias("at"), to.alias("to"), *[F.col(f"m.g{i}") for i in range(1, groups + 1)])

    return reduce(DataFrame.union, [of(k, p) for k, p in kinds.items()])


def _bodies(docs: DataFrame, text: str, ranges: DataFrame, *columns: str) -> DataFrame:
    """ranges(doc, at, to, end, columns) with ``body``, what a column of docs has between to and end; a null end is the text's. A document's text is read once for all its ranges."""
    listed = ranges.groupBy("doc").agg(F.collect_list(F.struct("at", "to", "end", *columns)).alias("ranges"))
    cut = F.transform("ranges", lambda r: r.withField("body", strip(_cut(F.col(text), r["to"], F.coalesce(r["end"], F.length(text))))))
    return docs.join(listed, "doc").select("doc", F.explode(cut).alias("r")).select("doc", "r.*")


def _passages(rows: DataFrame, part: int, kind: str, **columns: Column) -> DataFrame:
    """rows as passages of a kind; fields that are not given are empty."""
    given = {"doc": F.col("doc"), "part": F.lit(part), "section_type": F.lit(kind)} | {f: F.lit("") for f in _FIELDS} | {f: F.lit(None).cast("int") for f in ("article_number", "paragraph_number")} | columns
    given.setdefault("shown", given["path"])
    return rows.select(*[given[c].alias(c) for c in _PASSAGE])


def within_budget(passages: DataFrame) -> DataFrame:
    """Passages that are too long, packed: what they are cut into says so in its path."""
    parts = F.when(token_estimate(F.col("text")) > MAX_TOKENS, pack(sentences(F.col("text")))).otherwise(F.array("text"))
    cut = passages.withColumn("parts", parts).select("*", F.size("parts").alias("n"), F.posexplode("parts").alias("i", "t"))
    several = F.col("n") > 1
    path = F.when(several, F.format_string("%s (deel %d/%d)", "path", F.col("i") + 1, "n")).otherwise(F.col("path"))
    made = {"seat": F.concat("seat", F.array("i")), "text": F.col("t"), "path": path, "shown": F.when(several, path).otherwise(F.col("shown"))}
    return cut.select(*[made.get(c, F.col(c)).alias(c) for c in _PASSAGE])


def recitals(docs: DataFrame) -> DataFrame:
    """Numbered recitals of head; of several marks of a number the last counts, and text before the first is no recital."""
    marks = _marks(docs, "head", {"recital": RECITAL_MARK}, 2).withColumn("number", F.coalesce(F.nullif("g1", F.lit("")), F.col("g2")).cast("int"))
    last = F.row_number().over(Window.partitionBy("doc", "number").orderBy(F.desc("at")))
    kept = marks.withColumn("last", last).where("last = 1").withColumn("end", F.lead("at").over(Window.partitionBy("doc").orderBy("at")))
    found = _bodies(docs, "head", kept, "number")
    made = _passages(found, 0, RECITAL, seat=F.array(F.col("at").cast("int")), text=F.col("body"), path=F.format_string("Overwegingen > (%d)", "number"), shown=F.format_string("Overwegingen > Overweging (%d)", "number"), paragraph_number=F.col("number"))
    return within_budget(made)


def _paragraphs(passages: DataFrame, mark: str) -> DataFrame:
    """The passages, or the numbered paragraphs of those that are too long and have several; what stands before the first goes with it."""
    gaps, heads, numbers = _between(F.col("text"), mark), _all(F.col("text"), mark), _all(F.col("text"), mark, 1)
    found = passages.withColumns({"gaps": gaps, "heads": heads, "numbers": numbers})
    intro = strip(F.col("gaps")[0])
    text = lambda h, i: strip(F.concat(h, F.get("gaps", i + 1)))
    paragraph = lambda h, i: F.struct(F.when((i == 0) & (intro != ""), F.concat(intro, F.lit("\n\n"), text(h, i))).otherwise(text(h, i)).alias("t"), F.get("numbers", i).alias("number"))
    whole = F.array(F.struct(F.col("text").alias("t"), F.lit(None).cast("string").alias("number")))
    items = F.when((token_estimate(F.col("text")) > MAX_TOKENS) & (F.size("heads") > 1), F.transform("heads", paragraph)).otherwise(whole)
    each = found.select("*", F.posexplode(items).alias("i", "p"))
    path = F.when(F.col("p.number").isNull(), F.col("path")).otherwise(F.concat("path", F.lit(" > Lid "), "p.number"))
    made = {"seat": F.concat("seat", F.array("i")), "text": F.col("p.t"), "path": path, "shown": path, "paragraph_number": F.col("p.number").cast("int")}
    return within_budget(each.select(*[made.get(c, F.col(c)).alias(c) for c in _PASSAGE]))


def _definitions(passages: DataFrame) -> DataFrame:
    """Items of a definitions article; a small one joins the passage before. An article without items gives nothing."""
    text = F.col("text")
    found = passages.withColumns({"gaps": _between(text, DEFINITION_MARK), "heads": _all(text, DEFINITION_MARK), "numbers": _all(text, DEFINITION_MARK, 1)}).where(F.size("heads") > 0)
    intro = strip(F.col("gaps")[0])
    item = lambda t, n, p: F.struct(t.alias("t"), n.alias("number"), p.alias("own"))
    items = F.transform("heads", lambda h, i: item(strip(F.concat(h, F.get("gaps", i + 1))), F.get("numbers", i), F.concat("path", F.lit(" > Definitie "), F.get("numbers", i))))
    first = F.when(token_estimate(intro) >= MIN_TOKENS, F.array(item(intro, F.lit(None).cast("string"), F.concat("path", F.lit(" > Inleiding")))))
    each = found.select("*", F.posexplode(F.concat(F.coalesce(first, F.slice(items, 1, 0)), items)).alias("i", "d"))
    opens = (F.col("i") == 0) | (token_estimate(F.col("d.t")) >= MIN_TOKENS)
    each = each.withColumn("group", F.count_if(opens).over(Window.partitionBy("doc", "seat").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)))
    groups = each.groupBy("doc", "seat", "group").agg(F.array_sort(F.collect_list(F.struct("i", "d"))).alias("ds"), *[F.first(c).alias(c) for c in _PASSAGE if c not in ("doc", "seat", "text", "path", "shown", "paragraph_number")])
    ds, own = F.col("ds"), F.col("ds")[0]["d"]
    more = F.transform(F.slice(ds, 2, F.greatest(F.lit(0), F.size(ds) - 1)), lambda x: F.concat(F.lit(", "), x["d"]["number"]))
    made = {"seat": F.concat("seat", F.array(F.col("group").cast("int"))), "text": F.array_join(F.transform(ds, lambda x: x["d"]["t"]), "\n\n"), "path": F.concat(own["own"], F.array_join(more, "")), "shown": own["own"], "paragraph_number": own["number"].cast("int")}
    return groups.select(*[made.get(c, F.col(c)).alias(c) for c in _PASSAGE])


def articles(docs: DataFrame, source: Source) -> DataFrame:
    """Articles of body with the chapter and section that hold at their heading. In a regulation the title is the body's first line, in a law it stands in the heading."""
    eu, label = source.layout == "eu", LABEL[source.layout]
    headings = EU_HEADINGS if eu else LAW_HEADINGS
    other = {k: p for k, p in headings.items() if not (eu and k == "article")}
    marks = _marks(docs, "body", other, 2)
    if eu:  # whose heading has no title
        marks = marks.union(_marks(docs, "body", {"article": headings["article"]}, 1).withColumn("g2", F.lit("")))
    order = F.when(F.col("kind") == "chapter", 0).when(F.col("kind") == "section", 1).otherwise(2)
    so_far, after = (Window.partitionBy("doc").orderBy("at", order).rowsBetween(*r) for r in ((Window.unboundedPreceding, 0), (1, Window.unboundedFollowing)))
    number, title = strip(F.col("g1")), strip(F.col("g2"))
    named = lambda kind, t: F.concat(F.lit(label[kind].format("")), number, F.lit(" — "), t)
    # What holds is the last chapter, and the last section if no chapter has come since.
    chapter = F.struct(F.col("at"), order.alias("o"), named("chapter", F.regexp_replace(title, r"(?U)\s+", " ") if eu else title).alias("name"), number.alias("number"))
    section = F.struct(F.col("at"), order.alias("o"), named("section", title).alias("name"))
    held = marks.withColumns({
        "c": F.last(F.when(F.col("kind") == "chapter", chapter), ignorenulls=True).over(so_far),
        "s": F.last(F.when(F.col("kind") == "section", section), ignorenulls=True).over(so_far),
        # A section's heading does not close the article before it.
        "end": F.first(F.when(F.col("kind") != "section", F.col("at")), ignorenulls=True).over(after),
    }).where("kind = 'article'")
    lasts = F.col("c").isNull() | (F.col("s.at") > F.col("c.at")) | ((F.col("s.at") == F.col("c.at")) & (F.col("s.o") > F.col("c.o")))
    empty = lambda c: F.coalesce(c, F.lit(""))
    held = held.withColumns({"chapter": empty(F.col("c.name")), "chapter_number": empty(F.col("c.number")), "section": empty(F.when(lasts, F.col("s.name")))})
    found = _bodies(docs, "body", held, "g1", "g2", "chapter", "chapter_number", "section")
    title = strip(F.substring_index("body", "\n", 1)) if eu else strip(F.col("g2"))
    own = F.concat(F.lit("Artikel "), F.col("g1"), F.when((title != "") | F.lit(not eu), F.concat(F.lit(" — "), title)).otherwise(""))
    lead = F.array("chapter") if eu else F.when(F.col("chapter") != "", F.array("chapter")).otherwise(F.array().cast("array<string>"))
    path = F.array_join(F.concat(lead, F.when(F.col("section") != "", F.array("section")).otherwise(F.array().cast("array<string>")), F.array(own)), " > ")
    same = {c: F.col(c) for c in ("chapter", "chapter_number", "section")}
    made = _passages(found, 1, ARTICLE, seat=F.array(F.col("at").cast("int")), text=F.col("body"), path=path, article_title=title, article_number=F.regexp_extract("g1", r"\d+", 0).cast("int"), **same)
    if not eu or source.definitions_article is None:
        return _paragraphs(made, PARAGRAPH_MARK[source.layout])
    defining = F.col("article_number") == source.definitions_article
    return _paragraphs(made.where(~defining), PARAGRAPH_MARK["eu"]).union(_definitions(made.where(defining)))


def annexes(docs: DataFrame) -> DataFrame:
    """Annexes of tail; the line below an annex's heading is its title and no part of its text."""
    marks = _marks(docs, "tail", {"annex": ANNEX_HEADING}, 2).withColumn("end", F.lead("at").over(Window.partitionBy("doc").orderBy("at")))
    found = _bodies(docs, "tail", marks, "g1", "g2").withColumn("title", strip(F.col("g2")))
    path = F.concat(F.lit("Bijlage "), "g1", F.when(F.col("title") != "", F.concat(F.lit(" — "), "title")).otherwise(""))
    return within_budget(_passages(found, 2, ANNEX, seat=F.array(F.col("at").cast("int")), text=F.col("body"), path=path, annex_number=F.col("g1"), annex_title=F.col("title")))


def regions(text: Column, source: Source) -> tuple[Column, Column, Column]:
    """What comes before the articles, the articles, and the annexes."""
    before = lambda mark: F.split(text, _FLAGS + mark, 2)
    if source.layout == "law":
        parts = before(LAW_HEADINGS["chapter"])
        at = F.when(F.size(parts) > 1, F.length(parts[0])).otherwise(0)
        return _cut(text, F.lit(0), at), _cut(text, at), F.lit("")
    first, opening = before(r"^Artikel\s+1\s*$"), "HOOFDSTUK I"
    lead = F.length(first[0]) - F.when(F.contains(first[0], F.lit(opening)), F.length(F.substring_index(first[0], opening, -1)) + len(opening)).otherwise(0)
    at = F.when(F.size(first) > 1, lead).otherwise(0)
    end = before(r"^BIJLAGE\s+I\s*$")
    stop = F.when(F.size(end) > 1, F.length(end[0])).otherwise(F.length(text)) if source.annexes else F.length(text)
    return _cut(text, F.lit(0), at), _cut(text, at, stop), _cut(text, stop)


def _text(source: Source) -> Column:
    """A text as it is parsed: a law is plain text, of which only footers go."""
    text = F.coalesce("text", F.lit(""))
    text = reduce(lambda t, f: F.regexp_replace(t, f, ""), source.footers, text) if source.layout == "law" else clean_page(text, source.footers)
    if source.end_marker:
        text = F.when(F.contains(text, F.lit(source.end_marker)), strip(F.substring_index(text, source.end_marker, 1))).otherwise(text)
    return text


def passages(docs: DataFrame, source: Source) -> DataFrame:
    """All passages of docs(doc, text) of one source, in columns ``_PASSAGE``; part and seat are their order."""
    cleaned = docs.select("doc", _text(source).alias("text"))
    parts = cleaned.select("doc", *[r.alias(n) for n, r in zip(("head", "body", "tail"), regions(F.col("text"), source), strict=True)])
    if source.layout == "law":
        lead = parts.select("doc", strip(F.col("head")).alias("lead")).where(token_estimate(F.col("lead")) >= MIN_TOKENS)
        first = within_budget(_passages(lead, 0, PREAMBLE, seat=F.array(F.lit(0)), text=F.col("lead"), path=F.lit("Preambule")))
    else:
        first = recitals(parts)
    return first.union(articles(parts, source)).union(annexes(parts))


def _merged(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.astype(object).where(rows.notna(), None)
    found = sorted(rows.to_dict("records"), key=lambda r: (r["part"], tuple(r["seat"])))
    out = pd.DataFrame([r | {"chunk_id": i, "token_estimate": r["tokens"]} for i, r in enumerate(merge_small(found))])
    return out[["doc", *[c.split()[0] for c in CHUNK.split(", ")]]]


def chunked(docs: DataFrame, sources: Sequence[Source], key: str | None = None) -> DataFrame:
    """Chunks of docs(source, text), one document per row; sources without a description are left out. ``key`` names a column that tells documents of a source apart and is kept."""
    own = F.col(key).cast("string") if key else F.lit(None).cast("string")
    numbered = materialize(docs.sparkSession, docs.select(F.monotonically_increasing_id().alias("doc"), own.alias("_key"), "source", "text"), "legal")
    found = []
    for s in sources:
        header = F.concat(F.lit(f"{s.display} > "), "shown", F.lit(":"))
        one = passages(numbered.where(F.col("source") == s.label).select("doc", "text"), s)
        found.append(one.select("*", F.lit(s.label).alias("source"), header.alias("context_header"), F.col("path").alias("hierarchy_path"), token_estimate(F.col("text")).alias("tokens")).drop("path", "shown"))
    # One group is one document's passages.
    made = reduce(DataFrame.union, found).groupBy("doc").applyInPandas(_merged, f"doc long, {CHUNK}")
    kept = made.join(numbered.select("doc", "_key"), "doc").drop("doc")
    return kept.withColumnRenamed("_key", key) if key else kept.drop("_key")


def statistics(chunks: DataFrame) -> DataFrame:
    """One row: number of chunks, least, most and total tokens, their mean rounded down, and the number of each section type as a map."""
    by_type = chunks.groupBy("section_type").agg(F.count(F.lit(1)).alias("n"), F.min("token_estimate").alias("lo"), F.max("token_estimate").alias("hi"), F.sum("token_estimate").alias("sum"))
    total = by_type.agg(F.sum("n").alias("n_chunks"), F.min("lo").alias("min_tokens"), F.max("hi").alias("max_tokens"), F.sum("sum").alias("total_tokens"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("section_type", "n")))).alias("by_type"))
    return total.withColumn("mean_tokens", F.floor(F.try_divide("total_tokens", "n_chunks")))
