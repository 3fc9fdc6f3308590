"""Text normalisation and scalar rules as native column expressions.

White space is Unicode-aware ((?U)\\s), unlike Spark's own trim.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WS = r"(?U)\s"

#: Question types and their names.
TYPE_NAMES = {"单选题": "single_choice", "判断题": "true_false", "多选题": "multiple_choice", "填空题": "fill_in_the_blank"}
#: Words without weight in the leakage test.
STOP_WORDS = ["a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or", "that", "the", "to", "with"]
#: The score of a judge's choice.
CHOICE_SCORES = {"A": 0.5, "B": 1.0, "C": 1.0, "D": 0.0, "E": 1.0}

CJK = r"\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{F900}-\x{FAFF}"
CJK_BASIC = r"\x{4E00}-\x{9FFF}"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    return F.regexp_replace(_col(c), rf"^{WS}+|{WS}+$", "")


def squeeze(c: Column | str) -> Column:
    """White space runs as one blank, none at the ends."""
    return strip(F.regexp_replace(_col(c), rf"{WS}+", " "))


def normalize_text(c: Column | str) -> Column:
    """Lower case, single blanks, without one leading item number and without empty parentheses at the end."""
    x = F.regexp_replace(strip(c), rf"^\d+\.{WS}*", "")
    x = F.regexp_replace(F.lower(x), rf"{WS}+", " ")
    return strip(F.regexp_replace(x, rf"{WS}*\({WS}*\){WS}*$", ""))


def is_null_like(c: Column | str) -> Column:
    """Null, blank, or the word null."""
    return _col(c).isNull() | F.lower(strip(c)).isin("", "null")


def options_length(options: Column | str) -> Column:
    """Characters of all options that are not null-like."""
    return F.coalesce(F.aggregate(F.filter(F.map_values(_col(options)), lambda v: ~is_null_like(v)), F.lit(0), lambda a, v: a + F.length(v)), F.lit(0))


def comparison_text(question: Column | str, options: Column | str, answer: Column | str) -> Column:
    """Normalised question, options by key and upper-case answer, parted by bars."""
    entries = F.array_sort(F.map_entries(F.coalesce(_col(options), F.create_map().cast("map<string,string>"))))
    joined = F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit(":"), normalize_text(F.coalesce(e["value"], F.lit(""))))), " ")
    return F.concat_ws(" | ", normalize_text(F.coalesce(_col(question), F.lit(""))), joined, F.upper(F.coalesce(_col(answer), F.lit(""))))


def prompt_text(question: Column | str, options: Column | str, answer: Column | str | None = None) -> Column:
    """A question with one option a line, and its answer if given."""
    lines = F.transform(F.array_sort(F.map_entries(_col(options))), lambda e: F.concat_ws(". ", e["key"], e["value"]))
    parts = [F.concat(F.lit("Question: "), _col(question)), F.array_join(lines, "\n")]
    if answer is not None:
        parts.append(F.concat(F.lit("Answer: "), _col(answer)))
    return F.concat_ws("\n", *parts)


def option_ids(ids: Column | str) -> Column:
    """Trimmed upper-case ids, without empty and repeated ones."""
    return F.array_distinct(F.filter(F.transform(_col(ids), lambda x: F.upper(strip(x))), lambda x: x != ""))


def output_ids(output: Column | str) -> Column:
    """Predicted ids of a task's output (JSON): its answerId, else its answerIds, else none."""
    v = F.try_parse_json(_col(output))
    one = F.try_variant_get(v, "$.answerId", "string")
    many = F.try_variant_get(v, "$.answerIds", "array<string>")
    return F.when(one.isNotNull(), F.array(one)).otherwise(F.coalesce(many, F.array().cast("array<string>")))


def type_name(c: Column | str) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in TYPE_NAMES.items() for x in kv])[_col(c)], _col(c))


def answer_letters(answer: Column | str, valid: Column) -> Column:
    """Ids of an answer text: parts by comma if all are valid, else single characters that are; empty if none."""
    parts = option_ids(F.split(_col(answer), "[,，]"))
    chars = option_ids(F.split(F.regexp_replace(_col(answer), rf"[,，]|{WS}", ""), ""))
    good = F.array_intersect(parts, valid)
    return F.when((F.size(parts) > 0) & (F.size(good) == F.size(parts)), parts).otherwise(F.array_intersect(chars, valid))


_IMG = r"(?i)<img\b[^>]*>"
_SRC = r"""(?i)\bsrc\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))"""


def image_sources(c: Column | str) -> Column:
    """Sources of all img tags, in order, without empty, null and ... ones."""
    def source(t: Column) -> Column:
        return F.concat(F.regexp_extract(t, _SRC, 1), F.regexp_extract(t, _SRC, 2), F.regexp_extract(t, _SRC, 3))

    return F.filter(F.transform(F.regexp_extract_all(_col(c), F.lit(f"({_IMG})"), F.lit(1)), lambda t: strip(source(t))), lambda s: ~s.isin("", "null", "..."))


def images_valid(c: Column | str) -> Column:
    return F.forall(image_sources(c), lambda s: s.rlike("^https?://"))


def without_images(c: Column | str) -> Column:
    return strip(F.regexp_replace(F.regexp_replace(_col(c), _IMG, ""), rf"(?i)({WS}*<br\s*/?>{WS}*)+$", ""))


def strip_tags(c: Column | str) -> Column:
    """Without HTML tags; a < before a digit stays."""
    return F.regexp_replace(_col(c), "</?[a-zA-Z][^>]*>", "")


def _count(c: Column, kind: str) -> Column:
    return F.length(F.regexp_replace(c, f"[^{kind}]", ""))


def has_cjk(c: Column | str) -> Column:
    return _col(c).rlike(f"[{CJK}]")


def cjk_ratio(values: Column) -> Column:
    """CJK characters over CJK and ASCII letters, in all strings of an array; 0 if there are none."""
    text = F.array_join(values, "")
    zh, en = _count(text, CJK), _count(text, "A-Za-z")
    return F.when(zh + en > 0, zh / (zh + en)).otherwise(F.lit(0.0))


def language_of_question(question: Column | str, values: Column) -> Column:
    r = cjk_ratio(values)
    return F.when(has_cjk(question) | (r >= 0.6), "chinese").when(r >= 0.4, "mixed").otherwise("english")


def is_english(c: Column | str) -> Column:
    """Less than a tenth of the characters but white space are CJK; false if there are none."""
    solid = F.regexp_replace(F.coalesce(_col(c), F.lit("")), rf"{WS}+", "")
    return F.when(F.length(solid) > 0, _count(solid, CJK_BASIC) / F.length(solid) < 0.1).otherwise(F.lit(False))


def default_options(kind: Column | str, options: Column | str, yes: str = "正确", no: str = "错误") -> Column:
    """True/false questions without options get two."""
    empty = _col(options).isNull() | (F.size(_col(options)) == 0)
    return F.when((_col(kind) == "判断题") & empty, F.create_map(F.lit("A"), F.lit(yes), F.lit("B"), F.lit(no))).otherwise(_col(options))


def slug(title: Column | str, prefix: str | None = None, most: int = 60) -> Column:
    """First characters in lower case, blanks and slashes as dashes, without dots, commas and parentheses."""
    x = F.translate(F.lower(F.substring(_col(title), 1, most)), " /.,()", "--")
    return x if prefix is None else F.concat(F.lit(f"{prefix}-"), x)


def content_key(source: Column | str, method: Column | str, start: Column | str, end: Column | str, text: Column | str) -> Column:
    return F.sha2(F.concat_ws("|", _col(source), _col(method), _col(start).cast("string"), _col(end).cast("string"), F.sha2(_col(text), 256)), 256)


def fnv1a(c: Column | str) -> Column:
    """32-bit FNV-1a over UTF-16 code units."""
    units = F.hex(F.encode(_col(c), "UTF-16BE"))
    places = F.when(F.length(units) > 0, F.sequence(F.lit(1), F.length(units), F.lit(4))).otherwise(F.array().cast("array<int>"))
    one = F.transform(places, lambda i: F.conv(F.substring(units, i, F.lit(4)), 16, 10).cast("long"))
    return F.aggregate(one, F.lit(2166136261).cast("long"), lambda h, x: (h.bitwiseXOR(x) * F.lit(16777619)).bitwiseAND(F.lit(4294967295)))


def canonical_json(c: Column | str) -> Column:
    """JSON with sorted keys; null if it can't be parsed."""
    return F.to_json(F.try_parse_json(_col(c)))


def alias(c: Column | str, names: dict[str, str]) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in names.items() for x in kv])[_col(c)], _col(c)) if names else _col(c)


def group_label(metadata: Column | str) -> Column:
    """The model's id, and for retrieval runs how they retrieve."""
    v = F.try_parse_json(_col(metadata))

    def at(path: str, kind: str = "string") -> Column:
        return F.try_variant_get(v, path, kind)

    names = F.concat_ws("+", *(at(f"$.embeddings.{k}.model") for k in ("dense", "sparse", "late")))
    parts = F.concat_ws(
        ", ",
        F.lit("RAG"),
        F.concat(F.lit("k="), at("$.retrieval.limit", "int").cast("string")),
        F.concat(F.lit("prefetch="), at("$.retrieval.prefetchLimit", "int").cast("string")),
        F.concat(F.lit("collection="), F.nullif(at("$.retrieval.collection"), F.lit(""))),
        F.nullif(names, F.lit("")),
        F.concat(F.lit("chunking="), at("$.chunking.method")),
    )
    return F.when(is_retrieval(metadata), F.concat(at("$.model.id"), F.lit(" ("), parts, F.lit(")"))).otherwise(at("$.model.id"))


def is_retrieval(metadata: Column | str) -> Column:
    """Whether the metadata's retrieval is an object."""
    return F.coalesce(F.get_json_object(_col(metadata), "$.retrieval").startswith("{"), F.lit(False))


def matches_keyword(keywords: list[str], *texts: Column) -> Column:
    """Whether any keyword, in lower case, lies in any of the texts."""
    out = F.lit(False)
    for k in keywords:
        for t in texts:
            out = out | F.coalesce(F.contains(F.lower(t), F.lit(k.lower())), F.lit(False))
    return out


def leak_text(c: Column | str) -> Column:
    return squeeze(F.regexp_replace(F.lower(_col(c)), r"[^\p{L}\p{N}\s]", " "))


def significant_tokens(c: Column | str) -> Column:
    return F.filter(F.split(leak_text(c), " "), lambda t: (F.length(t) >= 3) & ~t.isin(*STOP_WORDS))


def answer_leaks(question: Column | str, answer: Column | str) -> Column:
    """The answer stands in the question, or 4 in 5 of its three or more weighty words do."""
    # One struct, bound once: else each expression would be evaluated again for every word.
    one = F.array(F.struct(leak_text(question).alias("q"), leak_text(answer).alias("a"), significant_tokens(question).alias("known"), significant_tokens(answer).alias("words")))

    def leaks(x: Column) -> Column:
        found = F.size(F.filter(x["words"], lambda t: F.array_contains(x["known"], t)))
        most = (F.size(x["words"]) >= 3) & (found >= 0.8 * F.size(x["words"]))
        return (x["q"] != "") & (x["a"] != "") & (((F.length(x["a"]) >= 8) & F.contains(x["q"], x["a"])) | most)

    return F.coalesce(F.get(F.transform(one, leaks), F.lit(0)), F.lit(False))


def clarify_inland(c: Column | str) -> Column:
    return F.regexp_replace(_col(c), r"(?<!US )\bINLAND\b", "US INLAND")


def scope_category(c: Column | str) -> Column:
    x = F.upper(_col(c))
    has = lambda s: F.contains(x, F.lit(s))
    return F.when(has("INLAND ONLY"), "inland").when(has("INTERNATIONAL ONLY"), "international").when(has("INTERNATIONAL") & has("INLAND"), "both").otherwise("unknown")


def distinct_matches(c: Column | str, pattern: str) -> Column:
    """Matches of the pattern's first group in upper case, each once, in order."""
    return F.array_distinct(F.regexp_extract_all(F.upper(_col(c)), F.lit(pattern), F.lit(1)))


def percent(part: Column, whole: Column, digits: int = 1) -> Column:
    """100 * part / whole, halves rounded up; 0 of nothing is 0."""
    scale = 10**digits
    return F.when(whole > 0, F.floor(F.lit(100.0 * scale) * part / whole + 0.5) / scale).otherwise(F.lit(0.0))


def trace_id(c: Column | str) -> Column:
    """The trace's own id, from base64 once or twice."""
    def decode(x: Column) -> Column:
        return F.when(x.rlike("^[A-Za-z0-9+/]+={0,2}$") & (F.length(x) % 4 == 0), F.try_to_binary(x, F.lit("base64")).cast("string"))

    one = decode(_col(c))
    two = decode(F.regexp_extract(one, "Trace:(.+)", 1))
    return F.coalesce(*(F.nullif(F.regexp_extract(x, "Trace:(.+)", 1), F.lit("")) for x in (two, one)), _col(c))


def score_label(score: Column | str) -> Column:
    return F.when(_col(score) == 1, "perfect").when(_col(score) == 0, "none").otherwise("partial")


def choice_score(choice: Column | str) -> Column:
    return F.create_map(*[F.lit(x) for kv in CHOICE_SCORES.items() for x in kv])[_col(choice)]


def legacy_choice(score: Column | str, explanation: Column | str, stored: Column | None = None) -> Column:
    """The judge's choice: the stored one, else the one named in the explanation, else by the old score."""
    near = lambda v: F.abs(_col(score) - v) < 1e-9
    text = F.lower(F.coalesce(_col(explanation), F.lit("")))
    by_score = F.when(near(0.4) | near(0.5), "A").when(near(0.6), "B").when(near(0.0), "D").when(near(1.0), F.when(text.rlike("don't matter|do not matter"), "E").otherwise("C"))
    named = F.nullif(F.regexp_extract(F.coalesce(_col(explanation), F.lit("")), r"judgment=([A-E])", 1), F.lit(""))
    return F.coalesce(*([stored] if stored is not None else []), named, by_score)


def quality_verdict(response: Column | str) -> Column:
    """GOOD or BAD as a model's answer says; null if neither or unclear."""
    x = F.upper(strip(response))
    return F.when(x.startswith("GOOD"), "GOOD").when(x.startswith("BAD"), "BAD").when(F.contains(x, F.lit("BAD")), "BAD").when(F.contains(x, F.lit("GOOD")), "GOOD")


def duplicate_verdict(response: Column | str) -> Column:
    """DUPLICATE or DIFFERENT: by the first line, else the last, else by which word occurs more often."""
    x = F.upper(strip(response))
    lines = F.filter(F.split(x, "\n"), lambda s: strip(s) != "")

    def of(line: Column) -> Column:
        dup, dif = F.contains(line, F.lit("DUPLICATE")), F.contains(line, F.lit("DIFFERENT"))
        return F.when(dup & ~dif, "DUPLICATE").when(dif & ~dup, "DIFFERENT")

    dup = F.size(F.split(x, "DUPLICATE")) - 1
    dif = F.size(F.split(x, "DIFFERENT")) - 1
    return F.coalesce(of(F.get(lines, F.lit(0))), of(F.element_at(F.when(F.size(lines) > 0, lines).otherwise(F.array(F.lit(""))), -1)), F.when(dup > dif, "DUPLICATE").when(dif > dup, "DIFFERENT"))


def question_number(c: Column | str, place: Column) -> Column:
    """Digits without leading zeros, else the place; four wide."""
    digits = F.regexp_replace(F.regexp_replace(F.coalesce(_col(c).cast("string"), F.lit("")), "[^0-9]", ""), "^0+", "")
    x = F.coalesce(F.nullif(digits, F.lit("")), place.cast("string"))
    return F.when(F.length(x) < 4, F.lpad(x, 4, "0")).otherwise(x)


def normal_url(c: Column | str) -> Column:
    """Without fragment, scheme and host in lower case; null unless http or https."""
    x = F.regexp_replace(strip(c), "#.*$", "")
    head = F.regexp_extract(x, r"^([a-zA-Z]+://[^/?]+)", 1)
    return F.when(x.rlike("(?i)^https?://[^/]+"), F.concat(F.lower(head), F.substring(x, F.length(head) + 1, F.length(x))))


def url_in_scope(c: Column | str, hosts: list[str], path: str = ".*") -> Column:
    u = normal_url(c)
    return F.coalesce(F.regexp_extract(u, "^https?://([^/:?]+)", 1).isin(*hosts) & F.regexp_extract(u, "^https?://[^/]+(.*)$", 1).rlike(path), F.lit(False))


def timestamp_or_never(c: Column | str) -> Column:
    """A time; missing or unreadable ones come before all others."""
    return F.coalesce(F.try_to_timestamp(_col(c).cast("string")), F.lit("0001-01-01 00:00:00").cast("timestamp"))


def same_as_above(c: Column | str) -> Column:
    return F.regexp_replace(_col(c), r"^[\s:：,，.。;；>]+", "").startswith("同上")
