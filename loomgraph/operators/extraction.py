"""Chunks (doc_id, text) to definitions, claims, procedures and relationship triples; all narrow."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import extraction_term, plain_sentences, stripped

#: (name, relation, pattern); the first that matches a sentence counts, groups after the first are targets. Fixed values.
RELATIONSHIPS = (
    ("is_times", "depends_on", r"^(.+?)\s+is\s+(.+?)\s+times\s+(.+?)\.?$"),
    ("rate_of_change", "depends_on", r"^(.+?)\s+is\s+the\s+rate\s+of\s+change\s+of\s+(.+?)\.?$"),
    ("consists_of", "depends_on", r"^(.+?)\s+consists?\s+of\s+(.+?)\s+and\s+(.+?)\.?$"),
    ("defined_as", "is_a", r"^(.+?)\s+is\s+(?:defined|known)\s+as\s+(.+?)\.?$"),
    ("uses", "depends_on", r"^(.+?)\s+uses?\s+(.+?)\.?$"),
    ("is_a_article", "is_a", r"^(.+?)\s+is\s+an?\s+(.+?)\.?$"),
    ("is_plain", "is_a", r"^(.+?)\s+is\s+(.+?)\.?$"),
)
#: Definition patterns in order. Fixed values.
DEFINITIONS = tuple(rf"^([A-Z][^.]{{1,60}}) {verb} ([^.]+)\." for verb in ("is", "means", "refers to", "(?:is defined as|is known as)"))
STEP = r"(?m)^\s*(?:\d+[.)]\s+|[-•]\s+)(.+)"
SEQUENCE = r"(?i)\b(first|second|third|then|next|finally|lastly)\b"


def _pieces(chunks: DataFrame) -> DataFrame:
    return chunks.select("*", F.posexplode(F.split("text", r"\.")).alias("pos", "_p")).withColumn("_p", stripped("_p"))


#: What one of the verbs of definitions matches in a sentence, in one search.
_DEFINES = " (?i:is|means|refers to) "


def definitions(chunks: DataFrame, base_confidence: float = 0.8) -> DataFrame:
    """doc_id, pos, term, definition, confidence: sentences of over 15 characters that a pattern reads as a definition.

    A pattern is tried only on sentences with its verb, and all that it gives comes from one expression per sentence.
    """
    said = _pieces(chunks).filter((F.char_length("_p") > 15) & F.col("_p").rlike(_DEFINES)).withColumns({"_s": F.concat("_p", F.lit(".")), "_l": F.lower("_p")})
    verbs = ((" is ",), (" means ",), (" refers to ",), (" is defined as ", " is known as "))
    has = lambda words: sum((F.col("_l").contains(w).cast("int") for w in words[1:]), F.col("_l").contains(words[0]).cast("int")) > 0
    found = F.coalesce(*[F.when(has(v) & F.col("_s").rlike("(?i)" + p), F.struct(*[stripped(F.regexp_extract("_s", "(?i)" + p, k)).alias(c) for k, c in ((1, "term"), (2, "definition"))])) for v, p in zip(verbs, DEFINITIONS, strict=True)])
    boost = F.col("boost") if "boost" in chunks.columns else F.lit(0.0)
    one = said.select("doc_id", "pos", boost.alias("_b"), F.explode(F.array(found)).alias("_f")).filter("_f is not null")
    return one.select("doc_id", "pos", "_f.term", "_f.definition", (F.lit(base_confidence) + F.col("_b")).alias("confidence"))


def claims(chunks: DataFrame) -> DataFrame:
    """doc_id, pos, claim: sentences of 20 characters or more that are no questions and don't start with define or step."""
    said = _pieces(chunks).filter((F.char_length("_p") >= 20) & ~F.col("_p").endswith("?") & ~F.lower("_p").rlike("^(define|step)"))
    return said.select("doc_id", "pos", F.concat("_p", F.lit(".")).alias("claim"))


def procedures(chunks: DataFrame) -> DataFrame:
    """doc_id, method, confidence, n_steps, steps: one row at most per chunk; lists of 2 steps or more, else 2 sentences with sequence words."""
    listed = F.regexp_extract_all(F.col("text"), F.lit(STEP), F.lit(1))
    told = F.filter(F.split("text", r"\."), lambda s: s.rlike(SEQUENCE))
    both = chunks.select("doc_id", F.transform(listed, lambda s: stripped(s)).alias("listed"), F.transform(told, lambda s: stripped(s)).alias("told")).filter((F.size("listed") >= 2) | (F.size("told") >= 2))
    is_list = F.size("listed") >= 2
    steps = F.when(is_list, F.col("listed")).otherwise(F.col("told"))
    return both.select("doc_id", F.when(is_list, "list_v1").otherwise("sequence_v1").alias("method"), F.when(is_list, 0.75).otherwise(0.6).alias("confidence"), F.size(steps).alias("n_steps"), F.array_join(steps, " | ").alias("steps"))


#: Text that a sentence must hold for a pattern to match, in lower case.
_HOLDS = {"is_times": " is|times", "rate_of_change": " is|rate", "consists_of": "consist|of", "defined_as": " is| as", "uses": "use", "is_a_article": "is", "is_plain": "is"}


#: A verb that a sentence must hold, in one search.
_RELATES = r"\s(?i:is\s|consist|use)"
#: Characters that . does not match. In a sentence with one of them a later try of a pattern's first part can match more.
LINE_BREAK = "[\n\r\u0085\u2028\u2029]"


def _in_one_pass(pattern: str) -> str:
    """The pattern with its first part atomic, for sentences of one line: a later try of that part could match nothing more, so no search over all pairs of words."""
    for part in (r"^(.+?)\s+is\s+(.+?)\s+times", r"^(.+?)\s+consists?\s+of\s+(.+?)\s+and"):
        if pattern.startswith(part):
            at = pattern.index("(.+?)", 2)
            return "^(?>" + pattern[1:at] + ")" + pattern[at:]
    return pattern


def relationships(chunks: DataFrame) -> DataFrame:
    """doc_id, pos, pattern, src, relation, dst: triples with terms of 2 characters or more.

    Sentences without any of the verbs are passed over, a pattern is tried only where its words stand, and the first that
    matches gives all its terms from one expression, which the explode evaluates once.
    """
    said = chunks.select("doc_id", F.posexplode(plain_sentences(F.col("text"))).alias("pos", "s")).filter(F.col("s").rlike(_RELATES)).withColumns({"_l": F.regexp_replace(F.lower("s"), r"\s", " "), "_broken": F.col("s").rlike(LINE_BREAK)})
    found = []
    for name, relation, pattern in RELATIONSHIPS:
        fits = F.lit(True)
        for word in _HOLDS[name].split("|"):
            fits = fits & F.col("_l").contains(word)
        quick = "(?i)" + _in_one_pass(pattern)
        whole = "(?i)" + pattern
        either = lambda of, quick=quick, whole=whole: of(quick) if quick == whole else F.when(F.col("_broken"), of(whole)).otherwise(of(quick))
        group = lambda k, either=either: extraction_term(either(lambda p: F.regexp_extract("s", p, k)))
        triple = lambda k, name=name, relation=relation, group=group: F.struct(F.lit(name).alias("pattern"), group(1).alias("src"), F.lit(relation).alias("relation"), group(k).alias("dst"))
        found.append(F.when(fits & either(lambda p: F.col("s").rlike(p)), F.array(*[triple(k) for k in range(2, pattern.count("(.+?)") + 1)])))
    out = said.select("doc_id", "pos", F.explode(F.coalesce(*found)).alias("_t")).select("doc_id", "pos", "_t.pattern", "_t.src", "_t.relation", "_t.dst")
    return out.filter((F.char_length("src") >= 2) & (F.char_length("dst") >= 2))


def contradictions(new: DataFrame, known: DataFrame) -> DataFrame:
    """doc_id, claim, against: new claims whose negation some known claim states; an equi-join on the lower-cased negation.

    Of known claims with the same text the last (greatest doc_id) counts, picked by an aggregate before the join.
    """
    negated = F.lower(F.replace(F.replace("claim", F.lit(" is "), F.lit(" is not ")), F.lit(" can "), F.lit(" cannot ")))
    asked = new.select("doc_id", "claim", negated.alias("_k")).filter(F.col("_k") != F.lower("claim"))
    build = known.groupBy(F.lower("claim").alias("_k")).agg(F.max("doc_id").alias("against"))
    return asked.join(build, "_k").select("doc_id", "claim", "against")
