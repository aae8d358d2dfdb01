"""Scalar rules on text: checks of numbers, support of claims, budgets, claims, hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
STOPWORDS = (
    "a an and are as at be been by for from had has have in into is it its of on or that the their there these they this to was were "
    "what when where which who will with your you our we"
).split()
NEGATIONS = "no not never none cannot without except excluding denied".split()
MIN_SUPPORT = 0.45
NEGATION_FACTOR = 0.6
CHARS_PER_TOKEN = 4
CONTEXT_OVERHEAD = 24
MAX_CONTEXT_CHARS = 8_000
MAX_REQUEST_TOKENS = 4_000
EXPECTED_OUTPUT_TOKENS = 400
PRINCIPAL_TOKENS_A_DAY = 200_000
GLOBAL_TOKENS_A_DAY = 5_000_000
MAX_K = 50


def luhn_valid(c: Column) -> Column:
    return F.coalesce(F.call_function("luhn_check", F.regexp_replace(c, r"[^0-9]", "")), F.lit(False))


def iban_valid(c: Column) -> Column:
    """15 to 34 letters and digits without blanks, mod 97 of the turned number is 1."""
    compact = F.upper(F.replace(c, F.lit(" "), F.lit("")))
    turned = F.concat(F.substring(compact, F.lit(5), F.length(compact)), F.substring(compact, 1, 4))
    code = lambda ch: F.ascii(ch)
    value = lambda ch: F.when(code(ch) >= 65, code(ch) - 55).otherwise(code(ch) - 48)
    step = lambda acc, ch: (F.when(code(ch) >= 65, acc * 100).otherwise(acc * 10) + value(ch)) % 97
    rest = F.aggregate(F.filter(F.split(turned, ""), lambda ch: ch != ""), F.lit(0), step)
    return F.coalesce(F.length(compact).between(15, 34) & compact.rlike("^[A-Z0-9]+$") & (rest == 1), F.lit(False))


def ip_valid(c: Column) -> Column:
    parts = F.split(c, r"\.")
    return F.coalesce((F.size(parts) == 4) & F.forall(parts, lambda p: p.rlike("^[0-9]{1,9}$") & (p.try_cast("int") <= 255)), F.lit(False))


def support_tokens(c: Column) -> Column:
    """Lower-case runs of word characters and ``£$€%.,/-``, without full stops and commas at their ends."""
    raw = F.regexp_extract_all(F.lower(c), F.lit(r"([\p{L}\p{N}_£$€%.,/\-]+)"), 1)
    return F.filter(F.transform(raw, lambda t: F.regexp_replace(t, r"^[.,]+|[.,]+$", "")), lambda t: t != "")


def _content(tokens: Column) -> Column:
    return F.array_distinct(F.filter(tokens, lambda t: (F.length(t) > 2) & ~t.isin(STOPWORDS)))


def _number(t: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(t, r"[£$€,]", ""), r"\.+$", "")


def _is_number(t: Column) -> Column:
    return t.rlike(r"^[£$€]?[0-9][0-9.,/%\-]*$")


def _numbers(tokens: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(F.filter(tokens, _is_number), _number), lambda t: t != ""))


def _number_units(tokens: Column) -> Column:
    n = F.size(tokens)
    shifted = F.slice(tokens, 2, F.greatest(n - 1, F.lit(0)))
    pairs = F.arrays_zip(F.slice(tokens, F.lit(1), F.greatest(n - 1, F.lit(0))).alias("a"), shifted.alias("b"))
    kept = F.filter(pairs, lambda p: _is_number(p["a"]) & p["b"].rlike(r"^\p{L}{2,}$"))
    return F.array_distinct(F.transform(kept, lambda p: F.concat(_number(p["a"]), F.lit(" "), p["b"])))


def support_of(claim_tokens: Column, evidence_tokens: Column) -> Column:
    """From 0 to 1: shared content words over those of the claim; 0 if a number, or a number with its
    next word, is not in the evidence; less if only one of both is negated."""
    claim, evidence = _content(claim_tokens), _content(evidence_tokens)
    share = F.size(F.array_intersect(claim, evidence)) / F.size(claim)
    lost = lambda f: F.size(F.array_except(f(claim_tokens), f(evidence_tokens))) > 0
    words = F.array(*[F.lit(w) for w in NEGATIONS])
    negated = lambda t: F.arrays_overlap(t, words)
    score = F.when(negated(claim_tokens) != negated(evidence_tokens), share * NEGATION_FACTOR).otherwise(share)
    return F.when(F.size(claim) == 0, 0.0).when(lost(_numbers) | lost(_number_units), 0.0).otherwise(score)


def support_score(claim: Column, evidence: Column) -> Column:
    return support_of(support_tokens(claim), support_tokens(evidence))


def budget_tokens(c: Column) -> Column:
    return F.ceil(F.length(F.coalesce(c, F.lit(""))) / CHARS_PER_TOKEN).cast("bigint")


def generation_tokens(c: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(F.coalesce(c, F.lit(""))) / CHARS_PER_TOKEN)).cast("bigint")


def budget_rung(n_hits: Column, context_chars: Column, question: Column) -> Column:
    tokens = budget_tokens(question) + F.ceil(context_chars / CHARS_PER_TOKEN) + EXPECTED_OUTPUT_TOKENS
    return F.when(n_hits == 0, "refuse").when(context_chars > MAX_CONTEXT_CHARS, "extractive").when(tokens > MAX_REQUEST_TOKENS, "extractive").otherwise("full")


def query_hash(c: Column) -> Column:
    """Unkeyed hash of a question: blanks squeezed, lower case."""
    squeezed = F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))
    return F.concat(F.lit("u:"), F.substring(F.sha2(F.concat(F.lit("quillrock/query/v1\n"), squeezed), 256), 1, 32))


def parsed_claims(reply: Column) -> Column:
    """``array<struct<text, chunk_ids>>`` of a reply: the JSON between the outer braces; blank texts and
    unparseable replies give nothing."""
    body = F.regexp_extract(reply, r"(?s)(\{.*\})", 1)
    read = F.from_json(body, "struct<claims: array<struct<text: string, chunk_ids: array<string>>>>")["claims"]
    return F.filter(F.coalesce(read, F.array().cast("array<struct<text: string, chunk_ids: array<string>>>")), lambda c: F.coalesce(F.trim(c["text"]) != "", F.lit(False)))
