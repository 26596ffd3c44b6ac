"""Scalar functions over text columns, all built from JVM expressions."""

from __future__ import annotations

import string
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

STOPWORDS = tuple("why who the for and are how was this that with when what into from where which their a an as at be by in is it of on or to".split())
_LINE_END = r"[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"
WORD = r"[\p{L}\p{N}_]+"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def blank_to_null(c: Column) -> Column:
    return F.when(c != "", c)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body with value computed once: an expression inside a lambda is otherwise evaluated for every element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(c: Column | str) -> Column:
    """Unicode white space off both ends."""
    return F.regexp_replace(col(c), r"(?U)^\s+|\s+$", "")


def whitespace_tokens(c: Column | str) -> Column:
    return F.filter(F.split(col(c), r"(?U)\s+"), lambda x: x != "")


def count_tokens(c: Column | str) -> Column:
    return F.size(whitespace_tokens(c))


def sentences(c: Column | str) -> Column:
    """Split after . ! ? and white space, and at line ends; blanks dropped."""
    return F.filter(F.transform(F.split(col(c), r"(?<=[.!?])(?U:\s+)|\n+"), strip), lambda x: x != "")


def lexical_tokens(c: Column | str) -> Column:
    return F.regexp_extract_all(F.lower(col(c)), F.lit(f"({WORD})"), 1)


def keywords(c: Column | str) -> Column:
    stop = F.array(*map(F.lit, STOPWORDS))
    return F.filter(lexical_tokens(c), lambda t: ~F.array_contains(stop, t))


def normalize_answer(c: Column | str) -> Column:
    """Lower case, ASCII punctuation deleted, English articles blanked, white space collapsed."""
    bare = F.translate(F.lower(col(c)), string.punctuation, "")
    without = F.regexp_replace(bare, r"(?U)\b(?:the|an|a)\b", " ")
    return F.trim(F.regexp_replace(without, r"(?U)\s+", " "))


def exact_match(prediction: Column | str, gold: Column | str) -> Column:
    return (normalize_answer(prediction) == normalize_answer(gold)).cast("double")


def _shared(p: Column, g: Column) -> Column:
    """Size of the multiset intersection."""
    times = lambda a, t: F.size(F.filter(a, lambda x: x == t))
    return F.aggregate(F.array_distinct(p), F.lit(0), lambda n, t: n + F.least(times(p, t), times(g, t)))


def token_f1(prediction: Column | str, gold: Column | str) -> Column:
    p, g = (F.filter(F.split(normalize_answer(x), " "), lambda t: t != "") for x in (prediction, gold))

    def score(s: Column) -> Column:
        n, a, b = _shared(s["p"], s["g"]), F.size(s["p"]), F.size(s["g"])
        some = let(n, lambda n: F.when(n == 0, 0.0).otherwise(2.0 * (n / a) * (n / b) / (n / a + n / b)))
        return F.when((a == 0) & (b == 0), 1.0).when((a == 0) | (b == 0), 0.0).otherwise(some)

    return let(F.struct(p.alias("p"), g.alias("g")), score)


def _best(score, prediction: Column | str, golds: Column | str) -> Column:
    none = (normalize_answer(prediction) == "").cast("double")
    return F.when(F.size(col(golds)) == 0, none).otherwise(F.array_max(F.transform(col(golds), lambda g: score(prediction, g))))


def best_exact_match(prediction: Column | str, golds: Column | str) -> Column:
    return _best(exact_match, prediction, golds)


def best_f1(prediction: Column | str, golds: Column | str) -> Column:
    return _best(token_f1, prediction, golds)


def contains_answer(text: Column | str, answers: Column | str) -> Column:
    """Whether some answer that is not blank is a substring, both normalised."""
    return let(normalize_answer(text), lambda whole: F.exists(F.transform(col(answers), normalize_answer), lambda a: (a != "") & F.contains(whole, a)))


def sanitize_identifier(c: Column | str) -> Column:
    slug = F.regexp_replace(F.regexp_replace(F.lower(col(c)), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.coalesce(blank_to_null(slug), F.lit("document"))


def decode_bytes(c: Column | str) -> Column:
    """UTF-8 where the bytes are valid, else ISO 8859-1; a byte order mark stays."""
    return F.coalesce(F.try_validate_utf8(F.decode(F.when(F.is_valid_utf8(col(c).cast("string")), col(c)), "UTF-8")), F.decode(col(c), "ISO-8859-1"))


def distinct_in_order(c: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(c, strip), lambda x: x != ""))


def query_variants(question: Column | str, most: int = 4) -> Column:
    """The question, its keywords, its first two capitalised phrases, and halves of the keywords."""
    return let(keywords(question), lambda k: _variants(col(question), k, most))


def _variants(q: Column, k: Column, most: int) -> Column:
    n, half = F.size(k), F.floor(F.size(k) / 2).cast("int")
    join = lambda a: F.array_join(a, " ")
    phrases = F.regexp_extract_all(q, F.lit(r"((?:[A-Z][\p{L}\p{N}_/-]*(?U:\s*)){1,4})"), 1)
    parts = [
        strip(q),
        F.when(n > 0, join(F.slice(k, 1, 12))),
        F.when(F.size(phrases) > 0, join(F.slice(distinct_in_order(phrases), 1, 2))),
        F.when(n >= 6, join(F.slice(k, F.lit(1), half))),
        F.when(n >= 6, join(F.slice(k, half + 1, n))),
    ]
    return F.slice(distinct_in_order(F.array_compact(F.array(*parts))), 1, most)


def plan_subqueries(question: Column | str, most: int = 3) -> Column:
    def windows(k: Column) -> Column:
        width = F.greatest(F.lit(2), F.floor(F.size(k) / most).cast("int"))
        each = F.transform(F.sequence(F.lit(0), F.ceil(F.size(k) / width).cast("int") - 1), lambda i: F.array_join(F.slice(k, i * width + 1, width), " "))
        return F.when(F.size(k) <= 4, F.array().cast("array<string>")).otherwise(F.slice(distinct_in_order(each), 1, most))

    return let(query_variants(question, most + 1), lambda v: F.when(F.size(v) > 1, F.slice(v, 2, most)).otherwise(let(keywords(question), windows)))


def support(answer: Column | str, evidence: Column) -> Column:
    """Share of the answer's distinct keywords in the texts of evidence; 1 if it has none."""
    terms = F.array_distinct(keywords(answer))
    seen = F.flatten(F.transform(evidence, lexical_tokens))
    return F.when(F.size(terms) == 0, 1.0).otherwise(F.size(F.array_intersect(terms, seen)) / F.size(terms))


def support_label(score: Column | str) -> Column:
    return F.when(col(score) >= 0.75, "high").when(col(score) >= 0.4, "medium").otherwise("low")


def qa_prompt(question: Column | str, context: Column | str) -> Column:
    """Plain prompt; wording is this engine's own."""
    with_context = F.concat(F.lit("Use the passages below and nothing else. Say 'unanswerable' if they do not settle it.\n\nPassages:\n"), col(context), F.lit("\n\nQuestion: "), col(question), F.lit("\n\nAnswer:"))
    return F.when(F.coalesce(col(context), F.lit("")) != "", with_context).otherwise(F.concat(F.lit("Give the shortest answer.\n\nQuestion: "), col(question), F.lit("\n\nAnswer:")))


def _message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def chat_messages(question: Column | str, context: Column | str) -> Column:
    system = F.when(F.coalesce(col(context), F.lit("")) != "", F.lit("Quote the briefest span of the passages that answers, with no reasoning; otherwise reply 'unanswerable'.")).otherwise(F.lit("Reply with a short phrase."))
    return F.array(_message("system", system), _message("user", qa_prompt(question, context)))


def refinement_messages(question: Column | str, draft: Column | str, context: Column | str) -> Column:
    block = F.when(F.coalesce(col(context), F.lit("")) != "", F.concat(F.lit("Passages:\n"), col(context), F.lit("\n\n"))).otherwise("")
    return F.array(_message("system", F.lit("Shorten the draft to the least exact span.")), _message("user", F.concat(F.lit("Question: "), col(question), F.lit("\n\n"), block, F.lit("Draft: "), col(draft))))


def chat_prompt(messages: Column | str) -> Column:
    """One text of role and content lines; messages without content are left out."""
    said = F.filter(F.transform(col(messages), lambda m: F.struct(F.initcap(strip(m["role"])).alias("role"), strip(m["content"]).alias("content"))), lambda m: m["content"] != "")
    lines = F.transform(said, lambda m: F.concat(m["role"], F.lit(": "), m["content"]))
    return F.array_join(F.concat(F.array(F.lit("Talk with the user; ask back if something is unclear."), F.lit("")), lines, F.array(F.lit("Assistant:"))), "\n")


def _replace_all(c: Column, *rules: tuple[str, str]) -> Column:
    return reduce(lambda x, r: F.regexp_replace(x, r[0], r[1]), rules, c)


def normalize_response(c: Column | str) -> Column:
    """First line of a model's reply without citation marks, lead-ins, quotes and closing signs."""
    line = strip(F.split(strip(c), _LINE_END)[0])
    line = _replace_all(line, (r"^\s*\[\d+\]\s*", ""), (r"(?i)^\s*(?:final answer|answer)\s*:\s*", ""), (r"(?i)^\s*the answer is\s+", ""))
    line = strip(F.regexp_replace(strip(line), "^[\"'`]+|[\"'`]+$", ""))
    line = _replace_all(line, (r"\s+\[\d+\]\s*$", ""), (r"(?i)\s*\([^)]*implies[^)]*\)\s*$", ""), (r"[ .;:]+$", ""))
    low = F.lower(line)
    refused = reduce(lambda a, b: a | b, (F.contains(low, F.lit(x)) for x in ("unanswerable", "not answerable", "not supported")))
    return F.when(refused, "unanswerable").otherwise(line)


_NUMBER_WORDS = sorted("one two three four five six seven eight nine ten eleven twelve twenty".split() + [x + "teen" for x in "thir four fif six seven eigh nine".split()])
_NUMBER = r"(?:\d[\d,]*(?:\.\d+)?|" + "|".join(_NUMBER_WORDS) + ")"
_ABOUT = r"(?:(?:" + "|".join(["over", "about", "around", "approximately"]) + r")\s+|at least\s+)?"
_SCALE = ["million", "billion", "thousand", "hundred"]
QUANTITY = rf"{_ABOUT}{_NUMBER}(?:\s+or\s+{_NUMBER})?(?:\s+(?:{'|'.join(_SCALE)}))?"
_MONTHS = "|".join("January February March April May June July August September October November December".split())
DATE = rf"\b(?:{_MONTHS})\s+\d{{1,2}},\s+\d{{4}}\b|\b\d{{4}}\b"
_VERBS = "|".join(sorted("is was are were has have had did does do disliked founded owned performed played caused expanded includes include contains contain premiered defended lies lie located".split(), key=lambda v: (-len(v), v)))
_ARTICLE = r"(?:an?\s+|the\s+)?"
PREDICATES = (rf"(?:{'|'.join(['are', 'is', 'were', 'was'])})\s+(?:now\s+)?{_ARTICLE}([^.;]+)", rf"have\s+{_ARTICLE}([^.;]+)", r"means\s+([^.;]+)", r"refers to\s+([^.;]+)", rf"restrain(?:ed|s)?\s+{_ARTICLE}([^.;]+)")


def _first(c: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match, null if there is none."""
    return F.when(c.rlike(pattern), F.regexp_extract(c, pattern, group))


def compress_answer(question: Column | str, answer: Column | str) -> Column:
    """The first rule that fires gives the shortened answer: quantity, date, subject, place, owner, founder, cause, predicate."""
    given = strip(answer)
    a = F.regexp_replace(strip(F.regexp_replace(given, r"(?i)\s*\((?:source|passage|see|from)[^)]*\)\s*$", "")), "[ .;:,]+$", "")
    q, low = strip(F.lower(col(question))), F.lower(a)
    has = lambda x, s: F.contains(x, F.lit(s))
    comma = lambda x: F.regexp_replace(strip(x), "^,+|,+$", "")
    amount = strip(_first(a, rf"(?i)\b{QUANTITY}", 0))
    acts = F.when(a.rlike(r"(?i)\bacts?\b"), F.concat(amount, F.lit(" acts"))).otherwise(amount)
    place = F.coalesce(*(strip(_first(a, rf"(?i)\b{p}\s+(the\s+[^,.;]+|[^,.;]+)")) for p in ("in", "at")))
    start = strip(_first(a, r"(?i)\bfrom\s+([^,.;]+?)(?:\s+to\b|$)"))
    rules = [
        F.when(q.startswith("how many") | has(q, "population"), acts),
        F.when(q.startswith("when") | has(q, "what year"), _first(a, DATE, 0)),
        F.when(q.startswith("who"), comma(_first(a, rf"(?i)^(.+?)\s+(?:{_VERBS})\b"))),
        F.when(q.startswith("where") & (has(q, "start") | has(q, "begin")), start),
        F.when(q.startswith("where"), place),
        F.when(has(low, "owned by"), comma(_first(a, r"(?i)\bowned by\s+(.+)$"))),
        F.when(has(low, "founded by"), comma(_first(a, r"(?i)\bfounded by\s+(.+)$"))),
        F.when(has(low, "caused"), strip(_first(a, r"(?i)\bcaused\s+([^,.;]+)"))),
        F.when(q.startswith("what") | q.startswith("which"), F.coalesce(*(strip(_first(a, rf"(?i)\b{p}")) for p in PREDICATES))),
    ]
    return F.when((given == "") | (given == "unanswerable"), given).otherwise(F.coalesce(*rules, a))


_MARKS = r"[\[\]():]"
_LONG_SIGNS = ("is", "are", "was", "were", "from", "to", "implies", "owned by", "founded by", "performed by", "played by")
_WHOLE_QUANTITY = rf"(?i)^(?:{_ABOUT}{_NUMBER}(?:\s+or\s+{_NUMBER})?(?:\s+(?:{'|'.join(_SCALE)}|acts?))?)$"


def should_refine(answer: Column | str) -> Column:
    """Whether a second, shortening call is worth it."""
    a = F.coalesce(col(answer), F.lit(""))
    words = F.size(F.regexp_extract_all(a, F.lit(f"({WORD})"), 1))
    marked, low = a.rlike(_MARKS), F.lower(a)
    phrase = reduce(lambda x, y: x | y, (F.contains(low, F.lit(f" {p} ")) for p in _LONG_SIGNS))
    quiet = a.isin("", "unanswerable") | ((words <= 4) & ~marked) | a.rlike(_WHOLE_QUANTITY)
    return F.when(quiet, False).otherwise((words >= 7) | marked | phrase)


def percent(c: Column | str) -> Column:
    return F.when(col(c).isNotNull(), F.format_string("%.1f", col(c) * 100)).otherwise("--")


def decimal(c: Column | str) -> Column:
    return F.when(col(c).isNotNull(), F.format_string("%.1f", col(c))).otherwise("--")


def int_or_dash(c: Column | str) -> Column:
    return F.coalesce(col(c).cast("string"), F.lit("--"))


def latex_escape(c: Column | str) -> Column:
    return F.replace(col(c), F.lit("_"), F.lit("\\_"))


def highlight(value: Column | str, greatest: Column | str, rendered: Column) -> Column:
    return F.when(F.abs(col(value) - col(greatest)) < 1e-12, F.concat(F.lit("\\textbf{"), rendered, F.lit("}"))).otherwise(rendered)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(a: Column) -> Column:
    """The vector over its length; a zero vector stays."""
    over = lambda v, n: F.transform(v, lambda x: x.cast("double") / n)
    return let(a, lambda v: let(F.sqrt(dot(v, v)), lambda n: over(v, F.when(n > 0, n).otherwise(1.0))))


def chunk_size_of(system: Column | str) -> Column:
    return F.nullif(F.regexp_extract(col(system), r"_(\d+)$", 1), F.lit("")).cast("int")
