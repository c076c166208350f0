"""Documents (doc_id, text) to chunks, one row each.

What a document is cut at (headings, chapters) is told within its own row, so cutting is narrow: a text is never shuffled. Only the parents
of sections, and groups of sentences, need a window over one document.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import chunk_id, guarded_sentences, prefixed_hash, stripped

#: Verbs, one of which a dictionary line must have. Fixed values.
VERBS = (
    "is", "are", "was", "were", "be", "been", "being", "means", "mean", "meant", "refers", "refer", "referred", "denotes", "denote", "denoted", "designates", "designate", "defines", "define", "defined",
    "describes", "describe", "described", "represents", "represent", "involves", "involve", "includes", "include", "contains", "contain", "equals", "equal", "has", "have", "had",
    "depends", "depend", "depended", "requires", "require", "required", "causes", "cause", "caused", "affects", "affect", "produces", "produce", "produced",
)
HEADING_WORDS = ("definition", "definitions", "overview", "introduction")


def document_chunks(docs: DataFrame, least: int = 40) -> DataFrame:
    """doc_id, seq, text: paragraphs (blank-line separated) of `least` characters or more; seq counts non-empty ones."""
    parts = F.filter(F.transform(F.split("text", "\n\n"), lambda p: stripped(p)), lambda p: p != "")
    return docs.select("doc_id", F.posexplode(parts).alias("seq", "text")).filter(F.char_length("text") >= least)


def lines(docs: DataFrame) -> DataFrame:
    """doc_id, line (from 1), text."""
    return docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "text")).select("doc_id", (F.col("pos") + 1).alias("line"), "text")


def is_dictionary_line(text: Column) -> Column:
    """Two words or more, not punctuation only, with a known verb as a word (which is a letter too); two searches, no arrays."""
    return text.rlike(r"(?i)(?:^|\s)(?:" + "|".join(VERBS) + r")[.,;:!?]*(?:\s|$)") & text.rlike(r"\S\s+\S")


def dictionary_chunks(docs: DataFrame, least: int = 5) -> DataFrame:
    """doc_id, line, text, chunk_id, location: lines that pass the dictionary filter."""
    kept = lines(docs).withColumn("text", stripped("text")).filter((F.char_length("text") >= least) & is_dictionary_line(F.col("text")))
    return kept.select("doc_id", "line", "text", chunk_id(F.concat(F.lit("doc:"), F.col("doc_id").cast("string")), "dictionary", F.col("line"), F.col("text")).alias("chunk_id"), F.concat(F.lit("line:"), F.col("line").cast("string")).alias("location"))


def _heading(text: Column) -> Column:
    """level and heading of a line as a struct, null where it is no heading; see headings()."""
    t = F.rtrim(text)
    words = F.size(F.filter(F.split(stripped(t), r"\s+"), lambda w: w != ""))
    marks = F.when(t.startswith("#"), F.regexp_extract(t, r"^(#{1,6})\s+(.+)$", 1)).otherwise("")  # most lines are told by their first letter
    capitals = (t == F.upper(t)) & t.rlike(r"^[\p{L} ]+$") & t.rlike(r"\p{Lu}") & (words <= 10)
    colon = t.endswith(":") & (F.char_length(t) <= 50)
    is_level = lambda level, title: F.struct(level.cast("int").alias("level"), title.alias("heading"))
    return F.when(marks != "", is_level(F.char_length(marks), stripped(F.regexp_extract(t, r"^(#{1,6})\s+(.+)$", 2)))).when(capitals, is_level(F.lit(1), F.initcap(F.lower(t)))).when(colon, is_level(F.lit(2), stripped(F.left(t, F.char_length(t) - 1))))


def headings(docs: DataFrame) -> DataFrame:
    """doc_id, line, text, level, heading: every line, with level null where it is no heading.

    #-marks (level by count), lines of at most 10 words in capitals (level 1), and lines of at most 50 characters that end
    with a colon (level 2).
    """
    told = lines(docs).withColumn("_h", _heading(F.col("text")))
    return told.select("doc_id", "line", "text", F.col("_h.level").alias("level"), F.col("_h.heading").alias("heading"))


def _parts(docs: DataFrame, head: Callable[[Column], Column]) -> DataFrame:
    """docs with `_n` (from 0), `_at`, `_end` (first and last line, from 0), `_head` and `_body` (array of lines) in place of text: a row for each head and what stands below it.

    Lines before the first head are dropped; a text without one is one part, whose `_head` is null. Null texts have no parts.
    """
    rest = [c for c in docs.columns if c != "text"]
    cut = docs.select(*rest, F.split("text", "\n").alias("_lines"))
    found = F.filter(F.transform("_lines", lambda t, i: F.struct(i.alias("at"), head(t).alias("head"))), lambda x: x["head"].isNotNull())
    cut = cut.withColumn("_heads", found)
    # the outer form never asks for the array twice, as a filter on its size would
    each = cut.select(*rest, "_lines", "_heads", F.posexplode_outer(F.when(F.size("_heads") > 0, F.col("_heads")).when(F.col("_lines").isNotNull(), F.array(F.get("_heads", F.lit(0))))).alias("_n", "_x")).filter("_n is not null")
    at, after = F.coalesce("_x.at", F.lit(-1)), F.get(F.col("_heads"), F.col("_n") + 1)["at"]
    each = each.select(*rest, "_n", "_lines", F.col("_x.head").alias("_head"), at.alias("_from"), (F.coalesce(after, F.size("_lines")) - 1).alias("_end"))
    return each.select(*rest, "_n", F.greatest(F.col("_from"), F.lit(0)).alias("_at"), "_end", "_head", F.slice("_lines", F.col("_from") + 2, F.col("_end") - F.col("_from")).alias("_body"))


def _section_id(head: Column, at: Column) -> Column:
    """From the heading of a part and the line (from 0) where it starts."""
    return prefixed_hash("sec_", 8, F.coalesce(head["level"], F.lit(0)).cast("string"), F.lit("::"), F.coalesce(head["heading"], F.lit("")), F.lit("::"), (at + 1).cast("string"))


def _sections(docs: DataFrame) -> DataFrame:
    """sections() without parents, narrow."""
    return _parts(docs, _heading).select("doc_id", (F.col("_n") + 1).cast("long").alias("section"), F.coalesce("_head.level", F.lit(0)).alias("level"), F.col("_head.heading").alias("heading"), (F.col("_at") + 1).alias("start_line"), F.array_join("_body", "\n").alias("text"), _section_id(F.col("_head"), F.col("_at")).alias("section_id"))


def sections(docs: DataFrame) -> DataFrame:
    """doc_id, section (from 1), level, heading, start_line, section_id, parent, text.

    Text before the first heading is dropped; a document without headings is one section of level 0. The parent is the
    nearest earlier heading of a smaller level. Windows run within one document.
    """
    before = Window.partitionBy("doc_id").orderBy("section").rowsBetween(Window.unboundedPreceding, -1)
    last = [F.max(F.when(F.col("level") == i, F.col("section"))).over(before) for i in range(1, 6)]  # of a level; levels are 1 to 6
    out = _sections(docs).select("*", *[x.alias(f"_last{i}") for i, x in enumerate(last, 1)])
    parent = F.array_max(F.array(*[F.when(F.col("level") > i, F.col(f"_last{i}")) for i in range(1, 6)]))
    return out.select("doc_id", "section", "level", "heading", "start_line", "section_id", parent.alias("parent"), "text")


def structured_chunks(docs: DataFrame, least: int = 40) -> DataFrame:
    """doc_id, section, para, text, location, chunk_id, boost (0.1 below headings that announce definitions)."""
    parts = _sections(docs).select("doc_id", "section", "section_id", "heading", F.posexplode(F.split("text", "\n\n")).alias("para", "text")).withColumn("text", stripped("text")).filter(F.char_length("text") >= least)
    place = F.concat(F.lit("section:"), F.col("section_id"), F.lit(":para:"), F.col("para").cast("string"))
    path = F.concat(F.lit("doc:"), F.col("doc_id").cast("string"))
    boost = F.when(F.lower("heading").rlike("|".join(HEADING_WORDS)), 0.1).otherwise(0.0)
    return parts.select("doc_id", "section", "para", "text", place.alias("location"), prefixed_hash("chunk_", 8, path, F.lit("::document_structured::"), place, F.lit("::"), F.lower("text")).alias("chunk_id"), boost.alias("boost"))


def sentences(docs: DataFrame) -> DataFrame:
    """doc_id, para, pos, text: sentences of blank-line separated paragraphs."""
    paras = docs.select("doc_id", F.posexplode(F.split("text", "\n{2,}")).alias("para", "p")).withColumn("p", stripped("p")).filter("p <> ''")
    return paras.select("doc_id", "para", F.posexplode(guarded_sentences(F.col("p"))).alias("pos", "text"))


def glossary_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_valid, mean_length, is_glossary: documents that read as line-by-line definitions."""
    filled = lines(docs).withColumn("text", stripped("text")).filter("text <> ''")
    valid = is_dictionary_line(F.col("text"))
    says = F.col("text").rlike(r"(?i)^.{1,60} (is|depends on) ")
    out = filled.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_lines"), F.count_if(valid).alias("n_valid"), F.avg(F.char_length("text")).alias("mean_length"), F.count_if(says).alias("n_says"))
    return out.select("doc_id", "n_lines", "n_valid", "mean_length", ((F.col("n_valid") >= 3) & (F.col("n_valid") * 2 >= F.col("n_lines")) & (F.col("mean_length") <= 120) & (F.col("n_says") >= 2)).alias("is_glossary"))


def is_glossary(text: Column) -> Column:
    """Whether a text reads as line-by-line definitions, as in glossary_documents, told of each row by itself."""
    says = r"(?i)^.{1,60} (is|depends on) "

    def of(filled: Column) -> Column:  # what costs least first: the verbs are looked for where all else fits, once
        n = F.size(filled)
        length = F.aggregate(filled, F.lit(0).cast("long"), lambda total, x: total + F.char_length(x))
        valid = F.element_at(F.transform(F.array(F.size(F.filter(filled, is_dictionary_line))), lambda v: (v >= 3) & (v * 2 >= n)), 1)
        return (n >= 3) & (length <= 120 * n) & (F.size(F.filter(filled, lambda x: x.rlike(says))) >= 2) & valid

    filled = F.filter(F.transform(F.split(text, "\n"), stripped), lambda x: x != "")
    return F.coalesce(F.element_at(F.transform(F.array(filled), of), 1), F.lit(False))  # bound by transform, so computed once


#: Words and phrases at the start of a sentence that continues what was said. Fixed values.
PRONOUNS = ("it", "its", "this", "that", "these", "those", "they", "their", "them", "he", "his", "she", "her", "we", "our", "us", "such", "both", "each", "which")
CONNECTIVES = (
    "therefore", "however", "because", "since", "thus", "hence", "moreover", "furthermore", "in addition", "for example", "for instance", "as a result", "consequently", "nevertheless", "specifically",
    "that is", "in other words", "so ", "but ", "and ", "or ", "also ", "additionally", "likewise", "nonetheless", "instead", "otherwise", "indeed", "in fact", "of course", "naturally", "meaning ",
)
SUBJECT = r"(?d)^.+?\s+(?:is|means|refers to|is defined as|is known as)\s+"


def coherent_groups(docs: DataFrame) -> DataFrame:
    """doc_id, para, pos, text, group (from 0): sentences, in groups that speak of one subject.

    A group ends with its paragraph, or where a sentence defines another subject than the group's; sentences that start with a
    pronoun or a connective, and questions, always continue. The group's subject so far is the last one that a sentence without
    such a start named, else the first that any sentence named: two window values, no fold.
    """
    said = sentences(docs)
    first = F.regexp_replace(F.lower(F.element_at(F.split("text", r"\s+"), 1)), r"^[.,;:!?()]+|[.,;:!?()]+$", "")
    continues = F.regexp_replace(F.lower(F.element_at(F.split("text", r"\s+"), 1)), r"[.,;:!?()]+$", "").isin(*PRONOUNS) | F.lower("text").rlike("^(?:" + "|".join(CONNECTIVES) + ")") | F.col("text").endswith("?")
    said = said.withColumns({"_subject": F.when(F.lower("text").rlike(SUBJECT), first), "_free": ~continues})
    before = Window.partitionBy("doc_id", "para").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    now = F.coalesce(F.last(F.when(F.col("_free"), F.col("_subject")), ignorenulls=True).over(before), F.first("_subject", ignorenulls=True).over(before))
    starts = (F.col("pos") == 0) | F.coalesce(F.col("_free") & (F.col("_subject") != now), F.lit(False))
    said = said.withColumn("_starts", starts.cast("int"))
    return said.select("doc_id", "para", "pos", "text", (F.sum("_starts").over(Window.partitionBy("doc_id").orderBy("para", "pos")) - 1).alias("group"))


def semantic_chunks(docs: DataFrame, least: int = 10) -> DataFrame:
    """doc_id, para, group, text, location, chunk_id: groups of coherent_groups() of `least` characters or more."""
    parts = coherent_groups(docs).groupBy("doc_id", "para", "group").agg(F.array_sort(F.collect_list(F.struct("pos", "text"))).alias("s"))
    out = parts.select("doc_id", "para", "group", F.array_join(F.transform("s", lambda x: x["text"]), " ").alias("text")).filter(F.char_length("text") >= least)
    place = F.concat(F.lit("semantic:para:"), F.col("para").cast("string"), F.lit(":group:"), F.col("group").cast("string"))
    return out.select("*", place.alias("location"), chunk_id(F.concat(F.lit("doc:"), F.col("doc_id").cast("string")), "semantic", F.col("group"), F.col("text")).alias("chunk_id"))


def _chapter_title(text: Column) -> Column:
    """The title of a line that starts a chapter, else null; see chapters()."""
    t = F.rtrim(text)
    words = F.size(F.filter(F.split(t, r"\s+"), lambda w: w != ""))
    plain = (t.startswith("Chapter") | t.startswith("CHAPTER")) & t.rlike(r"^(Chapter|CHAPTER)\s+\S+(\s*[:.\-]\s*.*)?$")
    marked = t.startswith("#") & t.rlike(r"(?i)^#{1,3}\s+chapter\s+")
    capitals = (t == F.upper(t)) & t.rlike(r"^[\p{L} ]+$") & words.between(1, 5)
    return F.when(plain, t).when(marked, stripped(F.regexp_replace(t, r"^#{1,3}\s+", ""))).when(capitals, F.initcap(F.lower(t)))


def chapters(books: DataFrame) -> DataFrame:
    """doc_id, chapter (from 0), chapter_id, title, start_line, end_line (from 0), text: one row per chapter.

    Headings: "Chapter X" with or without a title, # marks before "Chapter", and lines of at most five words in capitals. What
    stands before the first one is dropped; a book without any is one chapter without a title.
    """
    book = prefixed_hash("", 16, F.lit("doc:"), F.col("doc_id").cast("string"), F.lit("::"), F.octet_length("text").cast("string"), F.lit("::"), F.substring("text", 1, 1000))
    parts = _parts(books.select("doc_id", book.alias("_book"), "text"), _chapter_title).select("doc_id", "_book", F.col("_n").cast("long").alias("chapter"), F.col("_head").alias("title"), F.col("_at").alias("start_line"), F.col("_end").alias("end_line"), stripped(F.array_join("_body", "\n")).alias("text"))
    named = prefixed_hash("chap_", 12, F.col("_book"), F.lit("::chapter::"), F.col("chapter").cast("string"), F.lit("::"), F.coalesce("title", F.lit("")))
    return parts.select("doc_id", "chapter", named.alias("chapter_id"), "title", "start_line", "end_line", "text")


def book_chunks(books: DataFrame, least: int = 40) -> DataFrame:
    """The chunks of all chapters of books; see chapter_chunks."""
    return chapter_chunks(chapters(books), least)


def chapter_chunks(parts: DataFrame, least: int = 40) -> DataFrame:
    """doc_id, chapter_id, mode (glossary or paragraph), position, text, location, chunk_id: chunks of rows of chapters().

    Chapters that read as glossaries give their definition lines (position: line from 0), others the paragraphs of their sections
    (position: paragraph from 0).
    """
    told = parts.select("doc_id", "chapter_id", "text", is_glossary(F.col("text")).alias("_glossary"))
    glossary = F.col("_glossary")
    # a glossary is one part, so that all chapters are cut in one pass
    cut = _parts(told, lambda t: F.when(~glossary, _heading(t))).select("doc_id", "chapter_id", "_glossary", _section_id(F.col("_head"), F.col("_at")).alias("_section"), F.array_join("_body", "\n").alias("_text"))
    pieces = cut.select("doc_id", "chapter_id", "_glossary", "_section", F.posexplode(F.when(glossary, F.split("_text", "\n")).otherwise(F.split("_text", "\n\n"))).alias("position", "text")).withColumn("text", stripped("text"))
    kept = pieces.filter(F.when(glossary, is_dictionary_line(F.col("text"))).otherwise(F.char_length("text") >= least))
    at = F.col("position").cast("string")
    place = F.when(glossary, F.concat(F.lit("chapter:"), "chapter_id", F.lit(":line:"), at)).otherwise(F.concat(F.lit("section:"), "_section", F.lit(":para:"), at))
    path = F.concat(F.lit("doc:"), F.col("doc_id").cast("string"))
    named = F.when(glossary, chunk_id(path, "book_glossary", F.col("position"), F.col("text"))).otherwise(prefixed_hash("chunk_", 8, path, F.lit("::document_structured::"), F.col("location"), F.lit("::"), F.lower("text")))
    out = kept.select("doc_id", "chapter_id", F.when(glossary, "glossary").otherwise("paragraph").alias("mode"), "position", "text", place.alias("location"), "_glossary")
    return out.select("doc_id", "chapter_id", "mode", "position", "text", "location", named.alias("chunk_id"))
