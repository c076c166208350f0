"""Questions to operators: keyword rules over tokens, and the slots that a rule asks for.

Rules are a small fixed table. A question's tokens are reduced to the keywords among them once; whether a rule fits is a test on
these few, all in one projection: no join, no shuffle; a table of any number of questions is routed in the scan. Rank among
fitting rules is by priority, then operator and rule id: ranked_rules() sorts them, and the first that fits is the answer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (rule id, operator, keywords, required slots, optional slots, priority). Fixed values.
RULES = (
    ("discourse.def.what_is", "discourse.GET_DEFINITION", ("what", "is"), ("term",), (), 200),
    ("discourse.def.define", "discourse.GET_DEFINITION", ("define",), ("term",), (), 200),
    ("discourse.def.definition_of", "discourse.GET_DEFINITION", ("definition", "of"), ("term",), (), 200),
    ("discourse.def.what_does_mean", "discourse.GET_DEFINITION", ("what", "does", "mean"), ("term",), (), 200),
    ("para.def.explain", "discourse.GET_DEFINITION", ("explain",), ("term",), (), 200),
    ("para.def.tell_me_about", "discourse.GET_DEFINITION", ("tell", "about"), ("term",), (), 200),
    ("para.def.what_is_about", "discourse.GET_DEFINITION", ("what", "is", "about"), ("term",), (), 200),
    ("para.def.give_definition", "discourse.GET_DEFINITION", ("give", "definition"), ("term",), (), 200),
    ("para.rel.what_affects", "discourse.GET_RELATIONSHIPS", ("what", "affects"), ("term", "relation_type"), (), 190),
    ("para.rel.what_influences", "discourse.GET_RELATIONSHIPS", ("what", "influences"), ("term", "relation_type"), (), 190),
    ("para.rel.based_on", "discourse.GET_RELATIONSHIPS", ("based", "on"), ("term", "relation_type"), (), 201),
    ("para.rel.what_determines", "discourse.GET_RELATIONSHIPS", ("what", "determines"), ("term", "relation_type"), (), 190),
    ("para.rel.dependencies_of", "discourse.GET_RELATIONSHIPS", ("dependencies", "of"), ("term", "relation_type"), (), 190),
    ("para.rel.rely_on", "discourse.GET_RELATIONSHIPS", ("what", "does", "rely", "on"), ("term", "relation_type"), (), 190),
    ("para.mh.full_dependencies", "discourse.GET_RELATIONSHIP_CLOSURE", ("full", "dependencies", "of"), ("term", "relation_type"), ("max_depth",), 195),
    ("para.mh.all_dependencies", "discourse.GET_RELATIONSHIP_CLOSURE", ("all", "dependencies", "of"), ("term", "relation_type"), ("max_depth",), 195),
    ("para.mh.dependency_graph", "discourse.GET_RELATIONSHIP_CLOSURE", ("dependency", "graph", "for"), ("term", "relation_type"), ("max_depth",), 195),
    ("para.cr.indirectly_affects", "discourse.COMPOSE_RELATIONSHIPS", ("what", "indirectly", "affects"), ("term", "relation_type"), ("max_depth",), 196),
    ("para.cr.ultimately_based_on", "discourse.COMPOSE_RELATIONSHIPS", ("ultimately", "based"), ("term", "relation_type"), ("max_depth",), 202),
    ("para.cr.derived_dependencies", "discourse.COMPOSE_RELATIONSHIPS", ("derived", "dependencies"), ("term", "relation_type"), ("max_depth",), 196),
    ("para.cr.indirect_dependencies", "discourse.COMPOSE_RELATIONSHIPS", ("indirect", "dependencies"), ("term", "relation_type"), ("max_depth",), 196),
    ("discourse.cr.indirectly_depends_on", "discourse.COMPOSE_RELATIONSHIPS", ("what", "does", "indirectly", "depend", "on"), ("term", "relation_type"), ("max_depth",), 196),
    ("discourse.cr.ultimately_depends_on", "discourse.COMPOSE_RELATIONSHIPS", ("what", "does", "ultimately", "depend", "on"), ("term", "relation_type"), ("max_depth",), 196),
    ("discourse.cr.indirect_dependencies", "discourse.COMPOSE_RELATIONSHIPS", ("what", "are", "indirect", "dependencies", "of"), ("term", "relation_type"), ("max_depth",), 196),
    ("discourse.cr.derive_dependencies", "discourse.COMPOSE_RELATIONSHIPS", ("derive", "dependencies", "of"), ("term", "relation_type"), ("max_depth",), 196),
    ("discourse.mh.ultimately_depends_on", "discourse.GET_RELATIONSHIP_CLOSURE", ("what", "does", "ultimately", "depend", "on"), ("term", "relation_type"), ("max_depth",), 195),
    ("discourse.mh.indirectly_depends_on", "discourse.GET_RELATIONSHIP_CLOSURE", ("what", "does", "indirectly", "depend", "on"), ("term", "relation_type"), ("max_depth",), 195),
    ("discourse.mh.all_dependencies", "discourse.GET_RELATIONSHIP_CLOSURE", ("what", "are", "all", "dependencies", "of"), ("term", "relation_type"), ("max_depth",), 195),
    ("discourse.mh.dependency_chain", "discourse.GET_RELATIONSHIP_CLOSURE", ("show", "dependency", "chain", "for"), ("term", "relation_type"), ("max_depth",), 195),
    ("discourse.rel.depends_on", "discourse.GET_RELATIONSHIPS", ("what", "does", "depend", "on"), ("term", "relation_type"), (), 190),
    ("discourse.rel.related_to", "discourse.GET_RELATIONSHIPS", ("what", "is", "related", "to"), ("term", "relation_type"), (), 190),
    ("discourse.rel.causes", "discourse.GET_RELATIONSHIPS", ("what", "causes"), ("term", "relation_type"), (), 190),
    ("discourse.rel.part_of_fwd", "discourse.GET_RELATIONSHIPS", ("what", "is", "part", "of"), ("term", "relation_type"), (), 190),
    ("geo.capital_of.region", "geography.CAPITAL_OF", ("capital", "of"), ("region",), (), 100),
    ("geo.located_in", "geography.LOCATED_IN", ("located", "in"), ("region",), (), 90),
    ("geo.population_of", "geography.POPULATION_OF", ("population", "of"), ("region",), (), 90),
    ("geo.border_with", "geography.BORDER_WITH", ("border", "countries"), ("region",), (), 85),
    ("geo.country_of", "geography.COUNTRY_OF", ("country", "of"), ("region",), (), 85),
    ("prog.lookup_key", "programming.LOOKUP_KEY", ("lookup", "dictionary"), (), (), 100),
    ("prog.lookup_key.get", "programming.LOOKUP_KEY", ("get", "from"), (), (), 85),
    ("prog.iterate", "programming.ITERATE", ("iterate", "loop"), (), ("collection",), 95),
    ("prog.find_first", "programming.ITERATE", ("find", "first", "in"), ("predicate", "collection"), (), 105),
    ("prog.filter", "programming.FILTER", ("filter",), (), ("collection",), 95),
    ("prog.define_function", "programming.DEFINE_FUNCTION", ("function", "returns"), (), (), 100),
    ("prog.conditional", "programming.CONDITIONAL_BRANCH", ("if",), (), (), 80),
    ("prog.compare", "programming.COMPARE_VALUES", ("compare",), (), (), 80),
    ("math.simplify", "math.SIMPLIFY", ("simplify",), ("expression",), (), 100),
    ("math.expand", "math.EXPAND", ("expand",), ("expression",), (), 100),
    ("math.factor", "math.FACTOR", ("factor",), ("expression",), (), 100),
    ("math.solve", "math.SOLVE", ("solve",), ("expression",), ("variable",), 95),
    ("math.derive", "math.DERIVE", ("differentiate",), ("expression",), ("variable",), 95),
    ("math.integrate", "math.INTEGRATE", ("integrate",), ("expression",), ("variable",), 95),
    ("math.add", "math.ADD", ("add",), (), (), 80),
    ("math.evaluate_fn", "math.EVALUATE_FUNCTION", ("evaluate",), ("expression",), (), 85),
    ("physics.compute_acceleration", "physics.COMPUTE_ACCELERATION", ("acceleration", "force", "mass"), ("force", "mass"), (), 110),
    ("physics.compute_acceleration.calculate", "physics.COMPUTE_ACCELERATION", ("calculate", "acceleration"), (), ("force", "mass"), 95),
    ("physics.kinetic_energy", "physics.COMPUTE_KINETIC_ENERGY", ("kinetic", "energy"), (), (), 100),
    ("physics.potential_energy", "physics.COMPUTE_POTENTIAL_ENERGY", ("potential", "energy"), (), (), 100),
    ("physics.update_velocity", "physics.UPDATE_VELOCITY", ("velocity",), (), ("time",), 85),
    ("physics.update_position", "physics.UPDATE_POSITION", ("position",), (), ("time",), 85),
    ("physics.detect_collision", "physics.DETECT_COLLISION", ("collision",), (), (), 90),
    ("physics.conserve_energy", "physics.CONSERVE_ENERGY", ("energy", "conserved"), (), (), 95),
    ("bio.photosynthesis", "biology.PHOTOSYNTHESIS", ("photosynthesis",), (), (), 110),
    ("bio.cell_respiration", "biology.CELL_RESPIRATION", ("respiration",), (), (), 105),
    ("bio.cell_respiration.energy", "biology.CELL_RESPIRATION", ("cells", "energy"), (), (), 90),
    ("bio.protein_synthesis", "biology.PROTEIN_SYNTHESIS", ("protein",), (), (), 100),
    ("bio.cell_division", "biology.DIVIDE_CELL", ("cell", "divide"), (), (), 95),
    ("bio.inhibit", "biology.INHIBIT", ("inhibit",), (), ("substance",), 95),
    ("bio.activate", "biology.ACTIVATE", ("activate",), (), ("substance",), 95),
    ("bio.measure_level", "biology.MEASURE_LEVEL", ("level", "of"), ("substance",), (), 85),
    ("fin.deposit", "finance.DEPOSIT", ("deposit",), ("account",), ("amount",), 100),
    ("fin.withdraw", "finance.WITHDRAW", ("withdraw",), ("account",), ("amount",), 100),
    ("fin.transfer", "finance.TRANSFER", ("transfer",), (), ("amount", "account"), 100),
    ("fin.compound_interest", "finance.COMPUTE_COMPOUND_INTEREST", ("compound", "interest"), (), ("principal", "rate"), 110),
    ("fin.interest", "finance.COMPUTE_INTEREST", ("interest",), (), ("principal", "rate"), 95),
    ("fin.portfolio_value", "finance.COMPUTE_PORTFOLIO_VALUE", ("portfolio", "value"), (), (), 100),
    ("fin.evaluate_risk", "finance.EVALUATE_RISK", ("risk",), (), (), 90),
    ("fin.calculate_return", "finance.CALCULATE_RETURN", ("return", "investment"), (), (), 95),
    ("legal.check_prohibition.illegal", "legal.CHECK_PROHIBITION", ("illegal",), (), ("action",), 105),
    ("legal.check_prohibition.prohibited", "legal.CHECK_PROHIBITION", ("prohibited",), (), ("action",), 105),
    ("legal.check_permission.legal", "legal.CHECK_PERMISSION", ("legal",), (), ("actor", "action"), 100),
    ("legal.check_permission.allowed", "legal.CHECK_PERMISSION", ("allowed",), (), ("actor", "action"), 100),
    ("legal.check_permission.permitted", "legal.CHECK_PERMISSION", ("permitted",), (), ("actor", "action"), 100),
    ("legal.detect_violation", "legal.DETECT_VIOLATION", ("violation", "violated"), (), ("rule", "case"), 105),
    ("legal.resolve_conflict", "legal.RESOLVE_CONFLICT", ("conflict", "resolve"), (), (), 100),
    ("legal.establish_precedence", "legal.ESTABLISH_PRECEDENCE", ("override", "precedence"), (), (), 100),
    ("legal.validate_compliance", "legal.VALIDATE_COMPLIANCE", ("compliant", "compliance"), (), ("case", "rule"), 100),
    ("legal.apply_rule", "legal.APPLY_RULE", ("apply", "rule"), (), ("rule", "case"), 90),
    ("legal.classify_case", "legal.CLASSIFY_CASE", ("classify", "case"), (), (), 90),
)
#: Words that are no part of a term. Fixed values.
NO_TERM = (
    "what", "is", "a", "an", "are", "define", "definition", "of", "does", "mean", "?", "the", "depend", "depends", "on", "related", "part", "causes", "cause", "to", "ultimately",
    "indirectly", "indirect", "all", "dependencies", "dependency", "chain", "show", "for", "derive", "explain", "tell", "about", "give", "affects", "affect", "influences",
    "influence", "based", "determines", "determine", "relies", "rely", "full", "graph", "derived", "me", "please", "can", "you", "could",
)
#: Words that name a relation, in order. Fixed values.
RELATION_WORDS = (
    ("depends_on", ("depend", "depends", "dependencies", "dependency", "affects", "affect", "influences", "influence", "determines", "determine", "relies", "rely", "based")),
    ("related_to", ("related",)),
    ("causes", ("causes", "cause")),
    ("part_of", ("part",)),
)
TOKEN = r"[\p{L}\p{N}_]+(?:'[\p{L}\p{N}_]+)?|[^\p{L}\p{N}_\s]"
#: Tokens that are punctuation.
PUNCTUATION = r"^[.,!?;:()\[\]{}\"'-]+$"
POLITE = r"^(can you|could you|show me|tell me|please)( |$)"


def ranked_rules() -> list[tuple]:
    return sorted(RULES, key=lambda r: (-r[5], r[1], r[0]))


def normalized_query(text: Column) -> Column:
    """Lower case, no ASCII punctuation, white space collapsed, one leading polite phrase dropped."""
    from ..functions.text import query_term

    return F.trim(F.regexp_replace(query_term(text), POLITE, ""))


def _after(tokens: Column, lower: Column, word: str) -> Column:
    at = F.array_position(lower, word)
    rest = F.array_join(F.slice(tokens, (at + 1).cast("int"), F.greatest(F.lit(0), F.size(tokens) - at.cast("int"))), " ")
    return F.when((at > 0) & (rest != ""), rest)


def _until(tokens: Column, lower: Column, word: str, *stops: str) -> Column:
    """What stands after a word, up to the first of the stops or the end."""
    at = F.array_position(lower, word).cast("int")
    rest = F.slice(tokens, at + 1, F.greatest(F.lit(0), F.size(tokens) - at))
    stop = F.array_position(F.transform(F.slice(lower, at + 1, F.greatest(F.lit(0), F.size(lower) - at)), lambda t: t.isin(*stops)), True).cast("int")
    said = F.array_join(F.when(stop > 0, F.slice(rest, 1, stop - 1)).otherwise(rest), " ")
    return F.when((at > 0) & (said != ""), said)


def _between(tokens: Column, lower: Column, word: str, end: str) -> Column:
    """What stands between two words; null without either of them."""
    at = F.array_position(lower, word).cast("int")
    after = F.array_position(F.slice(lower, at + 1, F.greatest(F.lit(0), F.size(lower) - at)), end).cast("int")
    return F.when((at > 0) & (after > 1), F.array_join(F.slice(tokens, at + 1, after - 1), " "))


def slots(tokens: Column, lower: Column) -> dict[str, Column]:
    """Slot values; null where a slot cannot be filled."""
    words = F.filter(tokens, lambda t: ~t.isin("?", ".", ",", "!", ";", ":"))
    low = F.filter(lower, lambda t: ~t.isin("?", ".", ",", "!", ";", ":"))
    term = F.array_join(F.filter(words, lambda t: ~F.lower(t).isin(*NO_TERM)), " ")
    relation = F.lit(None).cast("string")
    for name, family in reversed(RELATION_WORDS):
        relation = F.when(F.arrays_overlap(lower, F.array(*map(F.lit, family))), name).otherwise(relation)
    some = lambda c: F.when(c != "", c)
    tail = some(F.array_join(F.slice(words, 2, F.greatest(F.lit(0), F.size(words) - 1)), " "))
    verbs = ("simplify", "expand", "factor", "solve", "calculate", "compute", "differentiate", "integrate", "evaluate")
    first_verb = F.array_position(F.transform(low, lambda t: t.isin(*verbs)), True)
    behind = some(F.array_join(F.slice(words, (first_verb + 1).cast("int"), F.greatest(F.lit(0), F.size(words) - first_verb.cast("int"))), " "))
    after = lambda *names: F.coalesce(*[_after(words, low, w) for w in names])
    first = lambda c: F.split_part(c, F.lit(" "), F.lit(1))
    number = F.try_element_at(F.filter(words, lambda t: t.rlike(r"^\d+(\.\d+)?$")), F.lit(1))
    raw, last = some(F.array_join(tokens, " ")), F.try_element_at(words, F.lit(-1))
    named = F.try_element_at(F.filter(words, lambda t: t.rlike(r"^\p{Lu}") & ~F.lower(t).isin("the", "a", "an", "is", "was", "are", "were", "be")), F.lit(1))
    return {
        "term": some(F.trim(term)), "relation_type": relation, "region": after("of"), "expression": F.when(first_verb > 0, behind).otherwise(tail), "variable": F.coalesce(first(after("to", "for")), last),
        "force": F.coalesce(_between(words, low, "force", "and"), _until(words, low, "force", "and", "mass")), "mass": after("mass", "weight"), "time": after("time", "after", "for"),
        "predicate": _between(words, low, "first", "in"), "collection": after("in"), "substance": F.coalesce(after("of"), tail), "account": after("into", "from", "account"), "amount": number, "principal": number, "rate": first(after("rate", "at")),
        "actor": F.coalesce(named, F.try_element_at(words, F.lit(1))), "action": after("can", "may", "must"), "rule": after("rule", "law", "under"), "case": F.coalesce(after("case"), raw), "max_depth": F.lit("3"), "raw_text": raw, "last": last,
    }


SLOTS = ("term", "relation_type", "region", "expression", "amount")
MORE_SLOTS = ("variable", "force", "mass", "time", "predicate", "collection", "substance", "account", "principal", "rate", "actor", "action", "rule", "case", "max_depth", "raw_text", "last")


def route(questions: DataFrame, text: str = "text", more: bool = False) -> DataFrame:
    """questions and rule, operator, priority, the slots SLOTS; no rule: operator generic. more: also confidence, ambiguous, all other slots as slot_<name>, and `slots`.

    Rules with one keyword set and slots are tests on arrays of the same row. Confidence is 1.3 and a thousandth of the priority,
    0 without a rule; a question is ambiguous if two of its rules have the greatest one. `slots` is a map of what the rule asks for,
    required and optional, as far as it is filled; empty without a rule. Slots that neither a rule requires nor the result has are not built.
    """
    words = sorted({w for rule in RULES for w in rule[2]})
    tokens = questions.withColumn("_t", F.regexp_extract_all(F.col(text), F.lit(TOKEN), F.lit(0)))
    tokens = tokens.withColumn("_l", F.transform("_t", lambda t: F.lower(t)))
    used = {slot for rule in RULES for slot in rule[3]} | set(SLOTS) | (set(MORE_SLOTS) if more else set())
    made = {k: v for k, v in slots(F.col("_t"), F.col("_l")).items() if k in used}
    filled = tokens.withColumns({"_s": F.struct(*[v.alias(k) for k, v in made.items()]), "_k": F.array_intersect("_l", F.array(*map(F.lit, words)))})
    fits = []
    for rule, operator, keywords, required, optional, priority in ranked_rules():
        test = F.lit(True)
        for word in keywords:
            test = test & F.array_contains("_k", word)
        for slot in required:
            test = test & F.col(f"_s.{slot}").isNotNull()
        asks = [F.array(*map(F.lit, (*required, *optional))).cast("array<string>").alias("asks")] if more else []
        fits.append(F.when(test, F.struct(F.lit(rule).alias("rule"), F.lit(operator).alias("operator"), F.lit(priority).alias("priority"), *asks)))
    extra = []
    if more:
        out = filled.withColumn("_f", F.filter(F.array(*fits), lambda x: x.isNotNull())).withColumn("_r", F.get("_f", F.lit(0)))
        top = F.filter("_f", lambda x: x["priority"] == F.col("_r.priority"))
        every = F.map_from_arrays(F.array(*map(F.lit, made)), F.array(*[F.col(f"_s.{s}") for s in made]))
        kept = F.map_filter(every, lambda k, v: v.isNotNull() & F.coalesce(F.array_contains("_r.asks", k), F.lit(False)))
        extra = [F.coalesce(1.3 + F.col("_r.priority") / 1000, F.lit(0.0)).alias("confidence"), (F.size(top) > 1).alias("ambiguous"), *[F.col(f"_s.{s}").alias(f"slot_{s}") for s in MORE_SLOTS], kept.alias("slots")]
    else:
        out = filled.withColumn("_r", F.coalesce(*fits))
    return out.select(*questions.columns, F.col("_r.rule").alias("rule"), F.coalesce("_r.operator", F.lit("generic")).alias("operator"), F.col("_r.priority").alias("priority"), *[F.col(f"_s.{s}").alias(s) for s in SLOTS], *extra)


def tagged(tokens: Column) -> Column:
    """Array of WORD, NUMBER, PUNCT or SYMBOL for an array of tokens."""
    number = r"(?i)^([+-]?(\d[\d_]*\.?\d*|\.\d+)(e[+-]?\d+)?|inf|infinity|nan)$"
    return F.transform(tokens, lambda t: F.when(t.rlike(number), "NUMBER").when(t.rlike(r"^[\p{L}']*\p{L}[\p{L}']*$"), "WORD").when(t.rlike(PUNCTUATION), "PUNCT").otherwise("SYMBOL"))


def hydrated(domain: Column, slot: Column, value: Column) -> Column:
    """Slot text as a struct kind (number, quantity, list, constraint, text), number, unit, items, text, by the domain's rules.

    Physics reads quantities, finance rates (a percentage is a hundredth) and amounts with thousands commas; numbers and lists
    are read for all others; what fits nothing stays text.
    """
    v = F.trim(value)
    number = v.rlike(r"^[-+]?\d+(\.\d+)?$")
    quantity = r"^([-+]?\d+(?:\.\d+)?)\s*([a-zA-Z/²³°]+.*)$"
    rate, plain = F.replace(v, F.lit("%"), F.lit("")), F.replace(v, F.lit(","), F.lit(""))

    def made(kind: str, n: Column | None = None, unit: Column | None = None, items: Column | None = None) -> Column:
        return F.struct(F.lit(kind).alias("kind"), (F.lit(None) if n is None else n).cast("double").alias("number"), (F.lit(None) if unit is None else unit).cast("string").alias("unit"), (F.lit(None) if items is None else items).cast("array<string>").alias("items"), value.alias("text"))

    items = F.filter(F.transform(F.split(F.regexp_extract(v, r"^\[(.*)\]$", 1), ","), lambda x: F.regexp_replace(F.trim(x), r"^['\"]|['\"]$", "")), lambda x: x != "")
    physics = F.when(v.rlike(quantity), made("quantity", F.regexp_extract(v, quantity, 1).try_cast("double"), F.trim(F.regexp_extract(v, quantity, 2)))).when(number, made("quantity", v.try_cast("double"), F.lit("unknown")))
    rated = F.trim(rate).try_cast("double")
    finance = F.when((slot == "rate") & rated.isNotNull(), made("constraint", F.when(v.contains("%"), rated / 100).otherwise(rated))).when(slot == "rate", made("constraint")).when(slot.isin("amount", "principal") & plain.try_cast("double").isNotNull(), made("number", plain.try_cast("double")))
    listed = v.rlike(r"^\[.*\]$") & ~domain.isin("physics", "math", "finance")
    generic = F.when(number & (domain != "finance"), made("number", v.try_cast("double"))).when(listed, made("list", items=items)).otherwise(made("text"))
    return F.when((domain == "physics") & (v.rlike(quantity) | number), physics).when((domain == "finance") & slot.isin("rate", "amount", "principal"), F.coalesce(finance, made("text"))).otherwise(generic)
